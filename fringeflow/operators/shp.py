"""Statistically homogeneous pixels: likelihood-ratio and Kolmogorov-Smirnov tests over a window."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringeflow.functions.cx import cx, magnitude
from fringeflow.operators.grid import Offset, neighbours, rectangle

PIXEL = ["scene", "row", "col"]
METHODS = ("rect", "glrt", "ks")


def chi_square_quantile(alpha: float) -> float:
    """1 - alpha quantile with one degree of freedom."""
    return NormalDist().inv_cdf(1 - alpha / 2) ** 2


def ks_critical_distance(n: int, alpha: float) -> float:
    """The least distance 0.01 + 0.001 k whose Kolmogorov probability, for two samples of n, is alpha or less."""
    half = n / 2
    for k in range(1000):
        d = 0.01 + 0.001 * k
        v = d * (math.sqrt(half) + 0.12 + 0.11 / math.sqrt(half))
        if 2 * sum((-1) ** (j - 1) * math.exp(-2 * v * v * j * j) for j in range(1, 101)) <= alpha:
            return d
    return 1.0


def _middles(pixels: DataFrame, strides: Offset) -> DataFrame:
    """The pixels at the looks' middles, numbered as output pixels; the input's numbers stay as row and col, out_row and out_col are added."""
    at = {c: F.col(c) - (s // 2 if s > 1 else 0) for c, s in zip(("row", "col"), strides, strict=True)}
    inside = [F.pmod(at[c], F.lit(s)) == 0 for c, s in zip(("row", "col"), strides, strict=True)]
    named = [F.floor(at[c] / s).cast("int").alias(f"out_{c}") for c, s in zip(("row", "col"), strides, strict=True)]
    return pixels.filter(inside[0] & inside[1]).select("*", *named)


def _outputs(near: DataFrame, *more) -> DataFrame:
    return near.select("scene", F.col("out_row").alias("row"), F.col("out_col").alias("col"), "dr", "dc", *more)


def rect(stats: DataFrame, half_window: tuple[int, int], strides: Offset = (1, 1)) -> DataFrame:
    """All pixels of the window, the centre included: scene, row, col (of the output pixel), dr, dc."""
    return _outputs(neighbours(_middles(stats.select(*PIXEL), strides), stats.select(*PIXEL), rectangle(*half_window), ["scene"], []))


def glrt(stats: DataFrame, half_window: tuple[int, int], n: int, alpha: float = 0.001, strides: Offset = (1, 1)) -> DataFrame:
    """Neighbours whose Rayleigh scale can't be told from the centre's; stats: PIXEL, mean, var (of the amplitude). The centre
    isn't its own neighbour; with strides, centres are the looks' middles."""
    scaled = stats.select(*PIXEL, ((F.col("var") + F.col("mean") ** 2) / 2).alias("s")).filter("s > 0")
    near = neighbours(_middles(scaled, strides), scaled, rectangle(*half_window, centre=False), ["scene"], ["s"])
    test = F.lit(float(n)) * (2 * F.log((F.col("s") + F.col("s_n")) / 2) - F.log("s") - F.log("s_n"))
    return _outputs(near.filter(test < chi_square_quantile(alpha)))


def ks_distances(stack: DataFrame, half_window: tuple[int, int], strides: Offset = (1, 1)) -> DataFrame:
    """PIXEL, dr, dc, distance: the largest gap of the two empirical distributions of amplitude. Ties advance both.

    A sorted array's share up to a value is its last place, so the gap is sought at the values of either array, each
    looked up in the other: of the sorted union the running difference of shares, in one pass."""
    amplitude = stack.select(*PIXEL, magnitude(cx()).alias("a")).groupBy(*PIXEL).agg(F.sort_array(F.collect_list("a")).alias("x"))
    near = neighbours(_middles(amplitude, strides), amplitude, rectangle(*half_window, centre=False), ["scene"], ["x"])
    # Each value with the array that it is from, in order; counts are whole, and the gap counts where the next value is another one.
    gap = F.expr(
        "aggregate(sort_array(concat(transform(x, a -> struct(a AS v, 1 AS i, 0 AS j)), transform(x_n, a -> struct(a AS v, 0 AS i, 1 AS j)))), "
        "named_struct('v', CAST(NULL AS DOUBLE), 'i', 0, 'j', 0, 'most', 0D), "
        "(s, e) -> named_struct('v', e.v, 'i', s.i + e.i, 'j', s.j + e.j, 'most', IF(s.v < e.v, greatest(s.most, abs(s.i / size(x) - s.j / size(x_n))), s.most)), s -> s.most)"
    )
    return _outputs(near, gap.alias("distance"))


def ks(stack: DataFrame, half_window: tuple[int, int], n: int, alpha: float = 0.05, strides: Offset = (1, 1)) -> DataFrame:
    return ks_distances(stack, half_window, strides).filter(F.col("distance") < ks_critical_distance(n, alpha)).select(*PIXEL, "dr", "dc")


def estimate(method: str, half_window: tuple[int, int], stats: DataFrame | None = None, stack: DataFrame | None = None, n: int | None = None, alpha: float = 0.001, strides: Offset = (1, 1)) -> DataFrame:
    """Neighbours by method; glrt needs stats and n, ks needs stack and n, rect needs stats."""
    method = method.lower()
    if method not in METHODS:
        raise ValueError(f"unknown method {method}; known: {', '.join(METHODS)}")
    if method == "ks":
        if stack is None or n is None:
            raise ValueError("ks needs the stack and its number of dates")
        return ks(stack, half_window, n, alpha, strides)
    if stats is None or (method == "glrt" and n is None):
        raise ValueError(f"{method} needs amplitude statistics" + " and the number of dates" * (method == "glrt"))
    return rect(stats, half_window, strides) if method == "rect" else glrt(stats, half_window, n, alpha, strides)


def counts(edges: DataFrame, centres: DataFrame, method: str = "glrt") -> DataFrame:
    """shp_count per centre; 0 for plain windows, which choose nothing."""
    if method == "rect":
        return centres.select(*PIXEL, F.lit(0).cast("long").alias("shp_count"))
    found = edges.groupBy(*PIXEL).agg(F.count("*").alias("n"))
    return centres.select(*PIXEL).join(found, PIXEL, "left").select(*PIXEL, F.coalesce("n", F.lit(0)).cast("long").alias("shp_count"))
