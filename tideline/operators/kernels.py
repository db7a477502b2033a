"""Kernels as Column expressions over edge lists, and their normalisations as aggregations and joins.

Edges are (i, j, d) going in and (i, j, w) coming out; what isn't an edge is 0.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.vectors import dot, fold, sqeuclidean
from tideline.operators.collection import Collection
from tideline.operators.distance import distances, full
from tideline.operators.windows import finite_difference


@dataclass(frozen=True)
class Kernel:
    """A function of the distance in `metric`, as a Column expression and, for blocks of distances, on arrays; of_points instead, where it
    depends on more than the distance: all rows of a with all rows of b."""

    name: str
    metric: str
    of: Callable[[Column], Column]
    epsilon: float | None = None
    values: Callable[[np.ndarray], np.ndarray] | None = None
    of_points: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None

    def edges(self, distance: DataFrame) -> DataFrame:
        return distance.select("i", "j", self.of(F.col("d")).alias("w"))

    def __call__(self, x: DataFrame, y: DataFrame | None = None, **how) -> DataFrame:
        return self.edges(distances(x, y, self.metric, **how))


def gaussian(epsilon: float = 1.0) -> Kernel:
    return Kernel("gaussian", "sqeuclidean", lambda d: F.exp(-d / F.lit(2.0 * epsilon)), epsilon, lambda d: np.exp(-d / (2.0 * epsilon)))


def multiquadric(epsilon: float = 1.0) -> Kernel:
    return Kernel("multiquadric", "sqeuclidean", lambda d: F.sqrt(d / F.lit(2.0 * epsilon) + F.lit(1.0)), epsilon, lambda d: np.sqrt(d / (2.0 * epsilon) + 1.0))


def inverse_multiquadric(epsilon: float = 1.0) -> Kernel:
    return Kernel("inverse_multiquadric", "sqeuclidean", lambda d: F.lit(1.0) / F.sqrt(d / F.lit(2.0 * epsilon) + F.lit(1.0)), epsilon, lambda d: 1.0 / np.sqrt(d / (2.0 * epsilon) + 1.0))


def inverse_quadratic(epsilon: float = 1.0) -> Kernel:
    return Kernel("inverse_quadratic", "sqeuclidean", lambda d: F.lit(1.0) / (d / F.lit(2.0 * epsilon) + F.lit(1.0)), epsilon, lambda d: 1.0 / (d / (2.0 * epsilon) + 1.0))


def thinplate() -> Kernel:
    return Kernel("thinplate", "euclidean", lambda d: F.when(d <= 0, F.lit(0.0)).otherwise(d * d * F.ln(F.greatest(d, F.lit(5e-324)))), values=lambda d: np.where(d <= 0, 0.0, d * d * np.log(np.maximum(d, 5e-324))))


def cubic() -> Kernel:
    return Kernel("cubic", "euclidean", lambda d: d * d * d, values=lambda d: d * d * d)


def quintic() -> Kernel:
    return Kernel("quintic", "euclidean", lambda d: d * d * d * d * d, values=lambda d: d * d * d * d * d)


BY_NAME: dict[str, Callable[..., Kernel]] = {k.__name__: k for k in (gaussian, multiquadric, inverse_multiquadric, inverse_quadratic, thinplate, cubic, quintic)}


def kth_distance(distance: DataFrame, k: int, out: str = "dk") -> DataFrame:
    """Per query the k-th smallest distance, its own zero included; rows with fewer have none."""
    from tideline.operators.distance import nearest as best

    return best(distance, k).groupBy("i").agg(F.when(F.count(F.lit(1)) >= k, F.max("d")).alias(out)).where(F.col(out).isNotNull())


def continuous_knn(distance: DataFrame, k: int = 10, delta: float = 1.0, reference: DataFrame | None = None) -> DataFrame:
    """Adjacency: pairs with d / sqrt(dk(i) * dk(j)) < delta. reference: (i, dk) of the fitted cloud when the queries are others."""
    own = kth_distance(distance, k)
    fitted = own if reference is None else reference
    joined = distance.join(own.withColumnRenamed("dk", "di"), "i").join(fitted.select(F.col("i").alias("j"), F.col("dk").alias("dj")), "j")
    near = F.coalesce(F.try_divide(F.col("d"), F.sqrt(F.col("di") * F.col("dj"))), F.when(F.col("d") == 0, 0.0).otherwise(float("inf"))) < delta
    return joined.where(near).select("i", "j", F.lit(True).alias("w"))


def row_sums(edges: DataFrame, alpha: float = 1.0, by: str = "i", out: str = "q") -> DataFrame:
    return edges.groupBy(by).agg((F.pow(F.sum("w"), F.lit(float(alpha))) if alpha != 1.0 else F.sum("w")).alias(out))


def divide(edges: DataFrame, left: DataFrame, right: DataFrame | None = None, scalar: float = 1.0, zero: float | None = None) -> DataFrame:
    """w / (q_i * q_j * scalar); left, right: (i, q). Division by zero gives `zero`, null if that is None."""
    right = left if right is None else right
    joined = edges.join(left.select("i", F.col("q").alias("qi")), "i").join(right.select(F.col("i").alias("j"), F.col("q").alias("qj")), "j")
    value = F.try_divide(F.col("w"), F.col("qi") * F.col("qj") * F.lit(scalar))
    return joined.select("i", "j", (value if zero is None else F.coalesce(value, F.lit(zero))).alias("w"))


def density_normalized(edges: DataFrame, alpha: float = 1.0, fitted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """K_ij / (q_i^a q_j^a) and (i, q^a). fitted: those of the reference cloud, for queries from elsewhere."""
    own = row_sums(edges, alpha)
    return divide(edges, own, fitted), own


def stochastic(edges: DataFrame, copies: str | None = None) -> DataFrame:
    """Rows that add up to 1; a zero row stays zero. copies: a column that tells how many equal entries of its row an entry stands for."""
    own = edges if copies is None else edges.withColumn("w", F.col("w") * F.col(copies))
    sums = row_sums(own, out="r")
    return edges.join(sums, "i").select("i", "j", F.coalesce(F.try_divide(F.col("w"), F.col("r")), F.lit(0.0)).alias("w"), *([] if copies is None else [copies]))


def conjugate(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K_ij / sqrt(r_i r_j), symmetric and with the spectrum of the stochastic matrix; and (i, b) with b = 1 / sqrt(r)."""
    sums = row_sums(edges, out="q").withColumn("q", F.sqrt("q"))
    return divide(edges, sums), sums.select("i", F.try_divide(F.lit(1.0), F.col("q")).alias("b"))


def diffusion(edges: DataFrame, alpha: float = 1.0, is_stochastic: bool = True, symmetrize: bool = True) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Density normalisation, then conjugate or stochastic: (edges, densities, basis change)."""
    if not is_stochastic:
        return edges, None, None
    density = None
    if alpha > 0:
        edges, density = density_normalized(edges, alpha)
    if symmetrize:
        edges, basis = conjugate(edges)
        return edges, density, basis
    return stochastic(edges), density, None


def landmark(edges: DataFrame, alpha: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Landmark kernel (i a point, j a landmark): optional density division, then rows scaled by (W colsum)^(-1/2).
    Returns edges and the scale (i, s)."""
    if alpha > 0:
        columns = row_sums(edges, 1.0, by="j", out="c")
        q = edges.join(columns, "j").groupBy("i").agg(F.pow(F.sum(F.col("w") * F.col("c")), F.lit(alpha)).alias("q"))
        edges = edges.join(q, "i").select("i", "j", F.try_divide(F.col("w"), F.col("q")).alias("w"))
    columns = row_sums(edges, 1.0, by="j", out="c")
    scale = edges.join(columns, "j").groupBy("i").agg(F.try_divide(F.lit(1.0), F.sqrt(F.sum(F.col("w") * F.col("c")))).alias("s"))
    return edges.join(scale, "i").select("i", "j", (F.col("w") * F.col("s")).alias("w")), scale


def mahalanobis(x: DataFrame, inverse_covariances: DataFrame, epsilon: float) -> DataFrame:
    """exp(-m / (2 epsilon)) with m = (x_i - x_j)'(C_i + C_j)(x_i - x_j) / 2; inverse_covariances: point_id, c (array of rows)."""
    with_c = x.join(inverse_covariances, "point_id")
    left = with_c.select(F.col("point_id").alias("i"), F.col("x").alias("xi"), F.col("c").alias("ci"))
    right = with_c.select(F.col("point_id").alias("j"), F.col("x").alias("xj"), F.col("c").alias("cj"))
    pairs = left.crossJoin(right).withColumn("g", F.zip_with("xi", "xj", lambda a, b: a - b))
    form = lambda c: dot(F.transform(F.col(c), lambda row: dot(row, F.col("g"))), F.col("g"))
    return pairs.select("i", "j", F.exp(-(F.lit(0.5) * (form("ci") + form("cj"))) / F.lit(2 * epsilon)).alias("w"))


def flow(tsc: Collection, delta: float, accuracy: int = 2) -> DataFrame:
    """Collections as states with velocities (id, time, point_id, x, v): central differences, at the stencil's last sample; rows near a
    series' beginning have none and are left out. point_id is a hash of id and time."""
    moves = finite_difference(tsc, delta, "center", 1, accuracy, shift_index=True, suffix="_dot")
    both = tsc.df.join(moves.df, [tsc.id, tsc.time])
    x, v = (F.array(*(F.col(f"{f}{s}") for f in tsc.features)) for s in ("", "_dot"))
    return both.select(tsc.id, tsc.time, F.xxhash64(tsc.id, tsc.time).alias("point_id"), x.alias("x"), v.alias("v"))


def cone(states: DataFrame, zeta: float, epsilon: float, delta: float) -> DataFrame:
    """Time-aware kernel of states with velocities (point_id, x, v): near along the flow, less so across it.

    The cosine of a velocity with the difference of two states counts as 0 where either is (nearly) zero; a pair with a velocity of
    zero has the kernel value 1. All pairs are formed: for small clouds."""
    norm = lambda c: F.sqrt(dot(F.col(c), F.col(c)))
    sized = states.withColumn("s", norm("v"))
    left, right = (sized.select(F.col("point_id").alias(k), *(F.col(c).alias(f"{c}{k}") for c in "xvs")) for k in "ij")
    pairs = left.crossJoin(right).withColumn("g", F.zip_with("xi", "xj", lambda a, b: a - b)).withColumn("d", norm("g"))

    def shrink(k: str) -> Column:
        size = F.col(f"s{k}") * F.col("d")
        angle = F.cos(F.when(size > 1e-14, dot(F.col(f"v{k}"), F.col("g")) / size).otherwise(0.0))
        return F.lit(1.0) - F.lit(zeta) * angle * angle

    shrunk = F.sqrt(shrink("i") * shrink("j")) if zeta else F.lit(1.0)
    factor = F.coalesce(F.try_divide(shrunk, F.col("si") * F.col("sj") * F.lit(float(epsilon * delta * delta))), F.lit(0.0))
    return pairs.select("i", "j", F.exp(-F.col("d") * F.col("d") * factor).alias("w"))


def cone_of_points(zeta: float, epsilon: float, delta: float) -> Kernel:
    """cone() for blocks of points whose components are those of the state, then those of the velocity."""

    def of_points(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        m = a.shape[1] // 2
        (x, v), (y, w) = (a[:, :m], a[:, m:]), (b[:, :m], b[:, m:])
        d2, along_i, along_j = (np.zeros((len(a), len(b))) for _ in range(3))
        for k in range(m):
            gap = x[:, k, None] - y[None, :, k]
            d2 += gap * gap
            along_i += v[:, k, None] * gap
            along_j += w[None, :, k] * gap
        d, si, sj = np.sqrt(d2), np.sqrt((v * v).sum(axis=1))[:, None], np.sqrt((w * w).sum(axis=1))[None]

        def shrink(size: np.ndarray, along: np.ndarray) -> np.ndarray:
            angle = np.cos(np.divide(along, size, out=np.zeros_like(size), where=size > 1e-14))
            return 1.0 - zeta * angle * angle

        shrunk = np.sqrt(shrink(si * d, along_i) * shrink(sj * d, along_j)) if zeta else np.ones_like(d)
        scale = si * sj * (epsilon * delta * delta)
        return np.exp(-d2 * np.divide(shrunk, scale, out=np.zeros_like(d), where=scale != 0))

    return Kernel("cone", "euclidean", lambda d: d, epsilon, of_points=of_points)


def drift(dimension: float, beta: float) -> float:
    """The power of the density in variable_bandwidth."""
    alpha = -dimension / 4
    if (c2 := 0.5 - 2 * alpha + 2 * dimension * alpha + dimension * beta / 2 + beta) >= 0:
        raise ValueError(f"dimension {dimension} and beta {beta} give {c2}, which isn't negative")
    return alpha


def variable_bandwidth(x: DataFrame, epsilon: float, k: int, dimension: float, beta: float) -> tuple[DataFrame, DataFrame]:
    """Kernel with a bandwidth for each point from a k-nearest-neighbour density, and divided by the density that it implies:
    (edges, (i, rho, q)). For some thousand points.

    The pilot bandwidth is relative to its mean, whose square is the pilot scale; so is rho = q0**beta to its own mean. The power of
    the density is -dimension / 4, which with beta has to give a negative drift coefficient."""
    alpha = drift(dimension, beta)
    d2 = full(x, metric="sqeuclidean")
    rho0 = nearest_mean(d2, k)
    mean0 = rho0.agg(F.avg("rho0")).first()[0]
    # exp(-d / (2 eps0 a b)) with eps0 = mean0**2 and a, b relative to the mean: the means cancel.
    q0 = d2.join(rho0.withColumnRenamed("rho0", "a"), "i").join(rho0.select(F.col("i").alias("j"), F.col("rho0").alias("b")), "j")
    q0 = q0.groupBy("i").agg((F.sum(F.exp(-F.col("d") / (2 * F.col("a") * F.col("b")))) * F.lit((2 * math.pi * mean0 * mean0) ** (-dimension / 2)) / F.pow(F.first("a"), F.lit(float(dimension))) / F.count(F.lit(1))).alias("q0"))
    rho = q0.select("i", F.pow("q0", F.lit(float(beta))).alias("rho"))
    mean = rho.agg(F.avg("rho")).first()[0]
    rho = rho.select("i", (F.col("rho") / F.lit(mean)).alias("rho"))
    joined = d2.join(rho.withColumnRenamed("rho", "a"), "i").join(rho.select(F.col("i").alias("j"), F.col("rho").alias("b")), "j")
    edges = joined.select("i", "j", "a", F.exp(-F.col("d") / (4 * epsilon * F.col("a") * F.col("b"))).alias("w"))
    q = edges.groupBy("i").agg((F.sum("w") / F.pow(F.first("a"), F.lit(float(dimension)))).alias("q"))
    return divide(edges.select("i", "j", "w"), q.select("i", F.pow("q", F.lit(alpha)).alias("q"))), rho.join(q, "i")


def nearest_mean(d2: DataFrame, k: int) -> DataFrame:
    """Root of the mean squared distance to the k nearest others."""
    from tideline.operators.distance import nearest as best

    return best(d2.where("i <> j"), k).groupBy("i").agg(F.sqrt(F.avg("d")).alias("rho0"))


def quadratic_form(matrix: Column, vector: Column) -> Column:
    return fold(F.transform(matrix, lambda row: dot(row, vector)), lambda s, v: s + v)
