"""Control with learnt linear models: quadratic regulator and model-predictive control, for many initial states at once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tideline.functions.linalg import box_qp, dare
from tideline.operators.collection import Collection
from tideline.operators.dynamics import LinearSystem


def cost_matrix(cost: float | Sequence[float] | np.ndarray, n: int) -> np.ndarray:
    cost = np.asarray(cost, float)
    return np.eye(n) * cost if cost.ndim == 0 else np.diag(cost) if cost.ndim == 1 else cost


@dataclass
class Regulator:
    """u = -F (z - z_ref), F from the Riccati equation."""

    system: LinearSystem
    state_cost: float | np.ndarray = 1.0
    input_cost: float | np.ndarray = 1.0

    def __post_init__(self) -> None:
        a, b = self.system.matrix, self.system.control
        q, r = cost_matrix(self.state_cost, len(a)), cost_matrix(self.input_cost, b.shape[1])
        self.riccati = dare(a, b, q, r)
        self.gain = np.linalg.solve(r + b.T @ self.riccati @ b, b.T @ self.riccati @ a)

    def control(self, states: np.ndarray, target: np.ndarray | None = None) -> np.ndarray:
        return -(np.atleast_2d(states) - (0 if target is None else target)) @ self.gain.T


@dataclass
class Predictive:
    """Inputs over a horizon that bring outputs C z near a reference, within input and state bounds: one small quadratic programme."""

    system: LinearSystem
    horizon: int
    input_bounds: np.ndarray  # (inputs, 2)
    output: np.ndarray | None = None
    cost_running: float | np.ndarray = 1.0
    cost_terminal: float | np.ndarray | None = None
    cost_input: float | np.ndarray = 0.01
    state_bounds: np.ndarray | None = None  # (outputs, 2)

    def __post_init__(self) -> None:
        a, b = self.system.matrix, self.system.control
        n, m = b.shape
        c = np.eye(n) if self.output is None else self.output
        h = self.horizon
        powers = [np.eye(n)]
        for _ in range(h):
            powers.append(a @ powers[-1])
        self.free = np.vstack([c @ p for p in powers])
        self.forced = np.zeros((len(c) * (h + 1), m * h))
        for row in range(1, h + 1):
            for col in range(row):
                self.forced[row * len(c) : (row + 1) * len(c), col * m : (col + 1) * m] = c @ powers[row - 1 - col] @ b
        run, end = cost_matrix(self.cost_running, len(c)), cost_matrix(self.cost_running if self.cost_terminal is None else self.cost_terminal, len(c))
        self.q = np.kron(np.eye(h + 1), run)
        self.q[-len(c) :, -len(c) :] = end
        self.r = np.kron(np.eye(h), cost_matrix(self.cost_input, m))
        self.h = 2 * (self.forced.T @ self.q @ self.forced + self.r)
        self.inputs, self.outputs = m, len(c)

    def plan(self, state: np.ndarray, reference: np.ndarray) -> np.ndarray:
        """Inputs (horizon, inputs) from a state, or one such array for each row of states; reference: (horizon + 1, outputs), or one output to hold."""
        states = np.atleast_2d(state)
        reference = np.broadcast_to(reference, (self.horizon + 1, self.outputs)).ravel()
        away = states @ self.free.T - reference
        low, high = (np.tile(self.input_bounds[:, k], self.horizon) for k in (0, 1))
        g = bound = None
        if self.state_bounds is not None:
            lo, hi = (np.tile(self.state_bounds[:, k], self.horizon + 1) for k in (0, 1))
            g, bound = np.vstack([self.forced, -self.forced]), np.hstack([hi - states @ self.free.T, states @ self.free.T - lo])
            ok = np.isfinite(bound).all(axis=0)
            g, bound = g[ok], bound[:, ok]
        made = box_qp(self.h, 2 * away @ self.q @ self.forced, low, high, g, bound).reshape(len(states), self.horizon, self.inputs)
        return made if np.ndim(state) == 2 else made[0]

    def closed_loop(self, plant, state: np.ndarray, reference: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """States and inputs of `plant(state, input)` under the first input of each plan."""
        states, inputs = [np.asarray(state, float)], []
        for k in range(steps):
            part = reference[k : k + self.horizon + 1] if reference.ndim == 2 else reference
            if reference.ndim == 2 and len(part) <= self.horizon:
                part = np.vstack([part, np.repeat(part[-1:], self.horizon + 1 - len(part), axis=0)])
            inputs.append(self.plan(states[-1], part)[0])
            states.append(plant(states[-1], inputs[-1]))
        return np.array(states), np.array(inputs)

    def plan_all(self, initial: Collection, reference: np.ndarray) -> DataFrame:
        """Plans for every initial state: id, step, u0, u1, ...; states are dealt over tasks."""
        features, names, key = list(initial.features), [f"u{k}" for k in range(self.inputs)], initial.id
        schema = StructType([StructField(initial.id, LongType()), StructField("step", LongType()), *(StructField(n, DoubleType()) for n in names)])

        def run(frames):
            for frame in frames:
                made = self.plan(frame[features].to_numpy(float), reference)
                steps = np.tile(np.arange(self.horizon), len(frame))
                yield pd.DataFrame({key: np.repeat(frame[key].to_numpy(), self.horizon), "step": steps, **{n: made[:, :, k].ravel() for k, n in enumerate(names)}})

        return initial.df.mapInPandas(run, schema)
