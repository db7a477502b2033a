"""Simulated dynamical systems as collections: each series is integrated in its own group."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession

from tideline.functions.linalg import runge_kutta
from tideline.operators.collection import Collection

Field = Callable[[float, np.ndarray, np.ndarray], np.ndarray]


def three_stable_points(t, x, u):
    return np.array([x[0] * (1 - x[1]), x[0] ** 2 - 2 * x[1]])


def hopf(t, x, u, mu: float = 1.0):
    r2 = x[0] ** 2 + x[1] ** 2
    return np.array([-x[1] + x[0] * (mu - r2), x[0] + x[1] * (mu - r2)])


def limit_cycle(t, x, u, mu: float = 1.0):
    return hopf(t, x, u, mu)


def pendulum(t, x, u, friction: float = 0.0, gravity: float = 9.81, length: float = 1.0):
    return np.array([x[1], -gravity / length * np.sin(x[0]) - friction * x[1]])


def inverted_pendulum(t, x, u, cart: float = 1.0, bob: float = 0.2, length: float = 0.5, gravity: float = 9.81, friction: float = 0.1):
    """Cart position, cart speed, angle from upright, its rate; u: force on the cart."""
    force = float(u[0]) if len(u) else 0.0
    s, c = np.sin(x[2]), np.cos(x[2])
    push = (force - friction * x[1] + bob * length * x[3] ** 2 * s) / (cart + bob)
    turn = (gravity * s - c * push) / (length * (4 / 3 - bob * c * c / (cart + bob)))
    return np.array([x[1], push - bob * length * turn * c / (cart + bob), x[3], turn])


#: Constant, own rate and coupling by the input, of the current and of the speed.
MOTOR = ((19.10828025, -39.3153, -32.2293), (-3.333333333, -1.6599, 22.9478))


def dc_motor(t, x, u):
    force = float(u[0]) if len(u) else 0.0
    return np.array([c + own * x[k] + turn * x[1 - k] * force for k, (c, own, turn) in enumerate(MOTOR)])


def van_der_pol(t, x, u, mu: float = 1.0):
    return np.array([x[1], mu * (1 - x[0] ** 2) * x[1] - x[0] + (float(u[0]) if len(u) else 0.0)])


def duffing(t, x, u, alpha: float = -1.0, beta: float = 1.0, delta: float = 0.6):
    return np.array([x[1], -delta * x[1] - x[0] * (alpha + beta * x[0] ** 2)])


def lorenz(t, x, u, sigma: float = 10.0, rho: float = 28.0, beta: float = 8 / 3):
    return np.array([sigma * (x[1] - x[0]), x[0] * (rho - x[2]) - x[1], x[0] * x[1] - beta * x[2]])


def burger(t, x, u, nu: float = 0.01, length: float = 2 * np.pi):
    """Periodic Burgers equation on a grid, central differences."""
    h = length / len(x)
    left, right = np.roll(x, 1, axis=0), np.roll(x, -1, axis=0)
    return -x * (right - left) / (2 * h) + nu * (right - 2 * x + left) / (h * h) + (u if len(u) == len(x) else 0.0)


def closed_curve(times: np.ndarray) -> np.ndarray:
    return np.column_stack([np.cos(times), np.sin(2 * times) / 2, np.sin(times)])


def simulate(spark: SparkSession, system: Field, states: np.ndarray, times: np.ndarray, controls: np.ndarray | None = None, names: Sequence[str] | None = None, substeps: int = 20, **parameters) -> Collection:
    """Series from each initial state (row of states) at `times`; controls: (series, times - 1, inputs), each held over its interval."""
    states, times = np.atleast_2d(np.asarray(states, float)), np.asarray(times, float)
    names = list(names or (f"x{k}" for k in range(states.shape[1])))

    def run(frames):
        for frame in frames:
            for i in frame["id"]:
                out = [states[i]]
                for k in range(len(times) - 1):
                    u = controls[i, k] if controls is not None else np.zeros(0)
                    out.append(runge_kutta(lambda t, x, u=u: system(t, x, u, **parameters), out[-1], times[k : k + 2], substeps)[-1])
                made = pd.DataFrame(np.array(out), columns=names)
                made.insert(0, "time", times)
                made.insert(0, "id", i)
                yield made

    schema = "id long, time double, " + ", ".join(f"`{n}` double" for n in names)
    return Collection.of(spark.range(len(states)).mapInPandas(run, schema), features=names)


def simulate_from(initial: Collection, system: Field, times: np.ndarray, substeps: int = 20, one_by_one: bool = False, **parameters) -> Collection:
    """Series from each row of a collection of initial states, at `times` after its own time. States stay where they are.

    The system is given all states of a batch at once, a column each; one_by_one: a single state at a time."""
    times, names = np.asarray(times, float), list(initial.features)

    def moved(x: np.ndarray) -> np.ndarray:
        return runge_kutta(lambda t, x: system(t, x, np.zeros(0), **parameters), x, times, substeps)

    def run(frames):
        for frame in frames:
            x = frame[names].to_numpy(float)
            made = np.array([moved(row) for row in x]).reshape(len(x), len(times), -1) if one_by_one or not len(x) else moved(x.T).transpose(2, 0, 1)
            when = frame.iloc[:, 1].to_numpy(float)[:, None] + times
            yield pd.DataFrame({"id": np.repeat(frame.iloc[:, 0].to_numpy(), len(times)), "time": when.ravel(), **{n: made[:, :, k].ravel() if len(x) else [] for k, n in enumerate(names)}})

    schema = "id long, time double, " + ", ".join(f"`{n}` double" for n in names)
    return Collection.of(initial.df.select(initial.id, initial.time, *names).mapInPandas(run, schema), features=names)
