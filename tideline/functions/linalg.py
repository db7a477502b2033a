"""Small dense linear algebra on NumPy, for the driver and for Arrow batches. Sizes are those of features, never of rows."""

from __future__ import annotations

import math

import numpy as np


class NumericalError(ArithmeticError):
    """A factorisation gave something that isn't usable."""


def fd_stencil(scheme: str, order: int, accuracy: int) -> tuple[list[int], list[float]]:
    """Offsets and coefficients (for unit spacing) of a finite difference of any order and accuracy."""
    if order < 1 or accuracy < 1:
        raise ValueError("order and accuracy are at least 1")
    if scheme == "center":
        half = (order + 1) // 2 - 1 + (accuracy + 1) // 2
        offsets = list(range(-half, half + 1))
    elif scheme in ("forward", "backward"):
        offsets = list(range(order + accuracy))
        offsets = offsets if scheme == "forward" else [-o for o in reversed(offsets)]
    else:
        raise ValueError(f"scheme {scheme!r}")
    n = len(offsets)
    system = np.vander(np.array(offsets, float), n, increasing=True).T
    target = np.zeros(n)
    target[order] = math.factorial(order)
    coefficients = np.linalg.solve(system, target)
    coefficients[np.abs(coefficients) < 1e-12] = 0.0
    return offsets, coefficients.tolist()


def expm(a: np.ndarray) -> np.ndarray:
    """Matrix exponential: scaling and squaring of a Taylor polynomial whose error is below double precision."""
    a = np.asarray(a)
    norm = np.linalg.norm(a, 1) if a.size else 0.0
    halvings = max(0, int(math.ceil(math.log2(norm))) + 3) if norm > 0 else 0
    small, term = a / 2.0**halvings, np.eye(len(a), dtype=a.dtype if np.iscomplexobj(a) else float)
    out = term.copy()
    for k in range(1, 19):
        term = term @ small / k
        out = out + term
    for _ in range(halvings):
        out = out @ out
    return out


def spectral_function(a: np.ndarray, f) -> np.ndarray:
    """f of a diagonalisable matrix. A nearly defective one raises: its eigenvectors can't be inverted reliably."""
    values, right = np.linalg.eig(a)
    if np.linalg.cond(right) > 1e12:
        raise NumericalError("the matrix is (nearly) defective")
    return right @ np.diag(f(values.astype(complex))) @ np.linalg.inv(right)


def logm(a: np.ndarray) -> np.ndarray:
    return spectral_function(a, np.log)


def matrix_power(a: np.ndarray, exponent: float) -> np.ndarray:
    """Integer powers by repetition; others on the principal branch of the spectrum."""
    if abs(exponent - round(exponent)) < 1e-12:
        return np.linalg.matrix_power(a, int(round(exponent)))
    return spectral_function(a, lambda v: v**exponent)


def sort_spectrum(values: np.ndarray, *vectors: np.ndarray) -> tuple[np.ndarray, ...]:
    """Eigenvalues by (real, imaginary) part, descending, with the columns of `vectors` in step."""
    order = np.lexsort((values.imag, values.real))[::-1]
    return (values[order], *(v[:, order] for v in vectors))


def spectrum(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues, right and left eigenvectors (rows of `left` so that left @ right = identity)."""
    values, right = np.linalg.eig(a)
    values, right = sort_spectrum(values, right)
    return values, right, np.linalg.pinv(right)


def symmetric_top(a: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n largest eigenpairs of a symmetric matrix, largest first; each vector's largest entry is positive."""
    if not np.isfinite(a).all():
        raise NumericalError("the matrix has entries that aren't finite")
    values, vectors = np.linalg.eigh((a + a.T) / 2)
    values, vectors = values[::-1][:n], vectors[:, ::-1][:, :n]
    return values, vectors * signs(vectors)


def signs(vectors: np.ndarray) -> np.ndarray:
    """+1 or -1 for each column, such that its entry of largest size gets positive."""
    at = np.abs(vectors).argmax(axis=0)
    s = np.sign(vectors[at, np.arange(vectors.shape[1])])
    return np.where(s == 0, 1.0, s)


def equal_up_to_sign(a: np.ndarray, b: np.ndarray, tol: float = 1e-8) -> bool:
    return all(np.allclose(x, y, atol=tol) or np.allclose(x, -y, atol=tol) for x, y in zip(a.T, b.T, strict=True))


def least_squares(gram: np.ndarray, cross: np.ndarray, rcond: float | None = None) -> np.ndarray:
    """The matrix A with target = A source, from source'source (gram) and source'target (cross)."""
    return np.linalg.lstsq(gram, cross, rcond=rcond)[0].T


def dare(a: np.ndarray, b: np.ndarray, q: np.ndarray, r: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Stabilising solution of the discrete algebraic Riccati equation by structured doubling."""
    n = len(a)
    g, h, f = b @ np.linalg.solve(r, b.T), q.astype(float).copy(), a.astype(float).copy()
    for _ in range(rounds):
        w = np.linalg.inv(np.eye(n) + g @ h)
        step = f.T @ h @ w @ f
        g, h, f = g + f @ w @ g @ f.T, h + step, f @ w @ f
        if np.abs(step).max(initial=0.0) <= 1e-14 * max(1.0, np.abs(h).max()):
            return (h + h.T) / 2
    raise NumericalError("no stabilising solution was reached")


def box_qp(h: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray, g: np.ndarray | None = None, bound: np.ndarray | None = None, rounds: int = 20_000, tol: float = 1e-9) -> np.ndarray:
    """argmin x'Hx / 2 + q'x with low <= x <= high and, if given, G x <= bound, by operator splitting on the stacked constraints.

    q, and bound, may have a row for each of many programmes with the same H and G; they are solved together.
    """
    many, q = q.ndim == 2, np.atleast_2d(q)
    n = q.shape[1]
    a = np.eye(n) if g is None else np.vstack([np.eye(n), g])
    lo = np.broadcast_to(low, q.shape) if g is None else np.hstack([np.broadcast_to(low, q.shape), np.full((len(q), len(g)), -np.inf)])
    hi = np.broadcast_to(high, q.shape) if g is None else np.hstack([np.broadcast_to(high, q.shape), np.broadcast_to(bound, (len(q), len(g)))])
    spectrum_of = np.linalg.eigvalsh(h)
    rho = max(float(np.sqrt(max(spectrum_of[0], 1e-9) * max(spectrum_of[-1], 1e-9))), 1e-6)
    inverse = np.linalg.inv(h + rho * a.T @ a + 1e-12 * np.eye(n))
    x, z, y = np.zeros_like(q), np.clip(np.zeros((len(q), len(a))), lo, hi), np.zeros((len(q), len(a)))
    for k in range(rounds):
        x = ((rho * z - y) @ a - q) @ inverse
        ax = 1.6 * x @ a.T - 0.6 * z
        fresh = np.clip(ax + y / rho, lo, hi)
        y += rho * (ax - fresh)
        gap, z = np.abs(fresh - z).max(initial=0), fresh
        if k % 10 == 9 and max(gap, np.abs(x @ a.T - z).max(initial=0)) < tol * max(1.0, np.abs(z).max(initial=0)):
            break
    else:
        raise NumericalError(f"no solution after {rounds} rounds: the last step was {gap:.2g}")
    x = np.clip(x, low, high)
    return x if many else x[0]


def runge_kutta(f, x: np.ndarray, times: np.ndarray, substeps: int = 20) -> np.ndarray:
    """States at `times` (the first is x) of x' = f(t, x), by the classical fourth-order method with fixed sub-steps."""
    out = [np.asarray(x, float)]
    for t0, t1 in zip(times[:-1], times[1:], strict=True):
        h, x = (t1 - t0) / substeps, out[-1]
        for i in range(substeps):
            t = t0 + i * h
            k1 = f(t, x)
            k2 = f(t + h / 2, x + h / 2 * k1)
            k3 = f(t + h / 2, x + h / 2 * k2)
            k4 = f(t + h, x + h * k3)
            x = x + h / 6 * (k1 + 2 * k2 + 2 * k3 + k4)
        out.append(x)
    return np.array(out)


def scale_columns(matrix: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
    return matrix * diagonal[None, :]


def scale_rows(diagonal: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    return diagonal[:, None] * matrix


def symmetrize(matrix: np.ndarray) -> np.ndarray:
    return (matrix + matrix.T) / 2


def is_symmetric(matrix: np.ndarray, tol: float = 0.0) -> bool:
    return matrix.ndim == 2 and matrix.shape[0] == matrix.shape[1] and bool(np.abs(matrix - matrix.T).max(initial=0) <= tol)


def is_stochastic(matrix: np.ndarray, axis: int = 1, tol: float = 1e-13) -> bool:
    return bool(np.abs(matrix.sum(axis=axis) - 1).max(initial=0) <= tol)
