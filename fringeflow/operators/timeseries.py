"""Network inversion, residuals, velocity and referencing. `unw`: scene, ref_t, sec_t, row, col, phase."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringeflow.operators.network import PAIR

PIXEL = ["scene", "row", "col"]
DAYS_PER_YEAR = 365.25


def referenced(unw: DataFrame, row: int, col: int, value: str = "phase", keys: list[str] | None = None) -> DataFrame:
    """value less its value at the reference pixel of the same image; unchanged where that is missing."""
    keys = keys or PAIR
    at = unw.filter((F.col("row") == row) & (F.col("col") == col)).select(*keys, F.col(value).alias("__ref"))
    out = unw.join(at, keys, "left")
    return out.select(*((F.col(value) - F.coalesce("__ref", F.lit(0.0))).alias(value) if c == value else F.col(c) for c in unw.columns))


def pseudo_inverse(edges: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, float]]:
    """(scene, ref_t, sec_t, t, coef) rows of each scene's inverted incidence matrix; edges: (scene, ref_t, sec_t)."""
    out = []
    by_scene: dict[int, list[tuple[int, int]]] = {}
    for scene, a, b in edges:
        by_scene.setdefault(scene, []).append((a, b))
    solved: dict[tuple, tuple[list[int], np.ndarray]] = {}
    for scene, pairs in by_scene.items():
        key = tuple(sorted(pairs))
        if key not in solved:
            days = sorted({x for p in key for x in p})
            matrix = np.zeros((len(key), len(days)))
            for k, (a, b) in enumerate(key):
                matrix[k, days.index(a)], matrix[k, days.index(b)] = -1, 1
            solved[key] = days[1:], np.linalg.pinv(matrix[:, 1:])
        days, inverse = solved[key]
        out += [(scene, a, b, t, float(inverse[i, k])) for i, t in enumerate(days) for k, (a, b) in enumerate(key)]
    return out


def inverse_of(edges: DataFrame) -> DataFrame:
    """pseudo_inverse as a frame, solved where the edges are: one group per scene, a few hundred edges each."""
    def solve(frame):
        import pandas as pd

        found = pseudo_inverse(list(frame[["scene", "ref_t", "sec_t"]].itertuples(index=False, name=None)))
        return pd.DataFrame(found, columns=["scene", "ref_t", "sec_t", "t", "coef"])

    return edges.select(*PAIR).distinct().groupBy("scene").applyInPandas(solve, "scene int, ref_t int, sec_t int, t int, coef double")


def invert_l2(unw: DataFrame, inverse: DataFrame, n_edges: DataFrame) -> DataFrame:
    """scene, row, col, t, phase: unweighted least squares as one join with the inverted matrix and one sum.

    A pixel that misses any interferogram is left out. n_edges: scene, n."""
    whole = unw.filter("phase IS NOT NULL").groupBy(*PIXEL).agg(F.count("*").alias("k")).join(n_edges, "scene").filter("k = n").select(*PIXEL)
    terms = unw.join(whole, PIXEL, "left_semi").join(inverse, PAIR)
    return terms.groupBy(*PIXEL, "t").agg(F.sum(F.col("coef") * F.col("phase")).alias("phase"))


def residuals(unw: DataFrame, series: DataFrame) -> DataFrame:
    """PAIR, row, col, residual: the modelled less the observed phase; the first date is 0."""
    at = lambda t, n: series.select("scene", F.col("t").alias(t), "row", "col", F.col("phase").alias(n))
    some = unw.join(series.select(*PIXEL).distinct(), PIXEL, "left_semi")
    both = some.join(at("sec_t", "late"), ["scene", "sec_t", "row", "col"], "left").join(at("ref_t", "early"), ["scene", "ref_t", "row", "col"], "left")
    return both.select(*PAIR, "row", "col", (F.coalesce("late", F.lit(0.0)) - F.coalesce("early", F.lit(0.0)) - F.col("phase")).alias("residual"))


def residuals_per_date(found: DataFrame) -> DataFrame:
    """scene, row, col, t, residual: the sum of the absolute residuals of a date's interferograms; the first date isn't one."""
    first = found.groupBy("scene").agg(F.min("ref_t").alias("first_t"))
    each = found.select("scene", "row", "col", F.explode(F.array("ref_t", "sec_t")).alias("t"), F.abs("residual").alias("r")).join(first, "scene").filter("t <> first_t")
    return each.groupBy(*PIXEL, "t").agg(F.sum("r").alias("residual"))


SOLVED = "refs array<int>, secs array<int>, residuals array<double>, days array<int>, phases array<double>, sums array<double>"


def solved_networks(unw: DataFrame, n_edges: DataFrame) -> DataFrame:
    """PIXEL, refs, secs, residuals (by pair), days, phases, sums of absolute residuals (by date after the first): invert_l2 and its
    residuals for each pixel that has all pairs of its scene, inside the pixel's row. unw is shuffled once.

    Pixels of one network, mostly of all scenes, are solved together."""
    entry = F.struct(F.col("ref_t").cast("int").alias("ref_t"), F.col("sec_t").cast("int").alias("sec_t"), F.col("phase").cast("double").alias("phase"))
    vectors = unw.filter("phase IS NOT NULL").groupBy(*PIXEL).agg(F.sort_array(F.collect_list(entry)).alias("v"))
    whole = vectors.join(n_edges, "scene").filter(F.size("v") == F.col("n")).select(*PIXEL, *(F.col(f"v.{c}").alias(c) for c in ("ref_t", "sec_t", "phase")))

    def run(batches):
        import pyarrow as pa

        lists = lambda values: pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(np.ascontiguousarray(values).reshape(-1)))
        for batch in batches:
            n = batch.column("phase").value_lengths().to_numpy()
            starts = np.cumsum(n) - n
            refs, secs, phases = (batch.column(c).flatten().to_numpy() for c in ("ref_t", "sec_t", "phase"))
            ends, networks = np.stack([refs, secs], axis=1), {}
            for k, (a, m) in enumerate(zip(starts.tolist(), n.tolist(), strict=True)):
                networks.setdefault(ends[a : a + m].tobytes(), []).append(k)
            for key, members in networks.items():
                pairs, which = np.frombuffer(key, dtype=ends.dtype).reshape(-1, 2), np.array(members)
                matrix = matrix_of([tuple(p) for p in pairs.tolist()])
                given = phases[starts[which][:, None] + np.arange(len(pairs))]
                found = given @ np.linalg.pinv(matrix).T
                left = found @ matrix.T - given
                same = lambda x: lists(np.broadcast_to(x.astype(np.int32), (len(which), len(x))))  # noqa: E731, B023
                columns = [same(pairs[:, 0]), same(pairs[:, 1]), lists(left), same(np.unique(pairs)[1:]), lists(found), lists(np.abs(left) @ np.abs(matrix))]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(which)) for k in PIXEL), *columns], [*PIXEL, *(c.split()[0] for c in SOLVED.split(", "))])

    kinds = dict(whole.dtypes)
    return whole.mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in PIXEL), SOLVED]))


def series_of(solved: DataFrame) -> DataFrame:
    """scene, row, col, t, phase of solved networks."""
    return solved.select(*PIXEL, F.inline(F.arrays_zip(F.col("days").alias("t"), F.col("phases").alias("phase"))))


def residuals_of(solved: DataFrame) -> DataFrame:
    """PAIR, row, col, residual of solved networks."""
    found = solved.select(*PIXEL, F.inline(F.arrays_zip(F.col("refs").alias("ref_t"), F.col("secs").alias("sec_t"), F.col("residuals").alias("residual"))))
    return found.select(*PAIR, "row", "col", "residual")


def dated_residuals_of(solved: DataFrame) -> DataFrame:
    """scene, row, col, t, residual as residuals_per_date gives it, of solved networks."""
    return solved.select(*PIXEL, F.inline(F.arrays_zip(F.col("days").alias("t"), F.col("sums").alias("residual"))))


def velocity(series: DataFrame, days: str = "days", value: str = "phase", weight: str | None = None) -> DataFrame:
    """scene, row, col, velocity per year. Weights multiply the residuals, so they count squared; without spread in time it is null."""
    if weight is None:
        return series.groupBy(*PIXEL).agg((F.regr_slope(value, days) * DAYS_PER_YEAR).alias("velocity"))
    w, x, y = F.col(weight) ** 2, F.col(days), F.col(value)
    s = series.filter(y.isNotNull()).groupBy(*PIXEL).agg(F.sum(w).alias("w"), F.sum(w * x).alias("wx"), F.sum(w * y).alias("wy"), F.sum(w * x * x).alias("wxx"), F.sum(w * x * y).alias("wxy"))
    slope = F.try_divide(F.col("w") * F.col("wxy") - F.col("wx") * F.col("wy"), F.col("w") * F.col("wxx") - F.col("wx") ** 2)
    return s.select(*PIXEL, (slope * DAYS_PER_YEAR).alias("velocity"))


def thresholded_weights(correlation: str, least: float):
    return F.when(F.col(correlation) < least, F.lit(0.0)).otherwise(F.col(correlation))


def rereferenced_in_time(series: DataFrame, extra: int) -> DataFrame:
    """Dates after `extra` less that date's image; earlier dates stay. A pixel without that image keeps its phases null after it."""
    at = series.filter(F.col("t") == extra).select(*PIXEL, F.col("phase").alias("__ref"))
    out = series.join(at, PIXEL, "left")
    return out.select(*PIXEL, "t", F.when(F.col("t") > extra, F.col("phase") - F.col("__ref")).otherwise(F.col("phase")).alias("phase"))


def valid_counts(conncomp: DataFrame) -> DataFrame:
    """scene, row, col, t, n: how many of a date's interferograms have a nonzero component label."""
    each = conncomp.select("scene", "row", "col", F.explode(F.array("ref_t", "sec_t")).alias("t"), (F.coalesce("label", F.lit(0)) != 0).cast("int").alias("v"))
    return each.groupBy(*PIXEL, "t").agg(F.sum("v").cast("long").alias("n"))


def component_intersection(conncomp: DataFrame) -> DataFrame:
    """scene, row, col, inside: in a labelled component of every interferogram; null where any is nodata."""
    found = conncomp.groupBy(*PIXEL).agg(F.bool_and(F.col("label") > 0).alias("all_in"), F.bool_or(F.col("label").isNull()).alias("any_missing"))
    return found.select(*PIXEL, F.when(~F.col("any_missing"), F.col("all_in")).alias("inside"))


def temporal_average(stack: DataFrame, value: str, how: str = "mean", zero_is_nodata: bool = False) -> DataFrame:
    from fringeflow.operators.grid import REDUCERS

    v = F.nullif(F.col(value), F.lit(0.0)) if zero_is_nodata else F.col(value)
    return stack.select(*PIXEL, v.alias(value)).groupBy(*PIXEL).agg(REDUCERS[how](F.col(value)).alias(value))


def _solver(kernel):
    """A pandas kernel over pixel rows (PIXEL, phases by edge order, weights) -> PIXEL, solution, residual."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            if len(frame):
                b = np.array(frame["phases"].tolist(), dtype=float)
                w = np.array(frame["weights"].tolist(), dtype=float)
                x, r = kernel(b, w)
                yield pd.DataFrame({"scene": frame["scene"], "row": frame["row"], "col": frame["col"], "solution": list(x), "residual": r})

    return run


def matrix_of(pairs: list[tuple[int, int]]) -> np.ndarray:
    days = sorted({x for p in pairs for x in p})
    matrix = np.zeros((len(pairs), len(days)))
    for k, (a, b) in enumerate(pairs):
        matrix[k, days.index(a)], matrix[k, days.index(b)] = -1, 1
    return matrix[:, 1:]


def weighted_l2(matrix: np.ndarray):
    """Rows scaled by the root of their weights; all pixels of a batch at once. Residual: the weighted sum of squares."""

    def kernel(b: np.ndarray, w: np.ndarray):
        normal = np.einsum("ei,pe,ej->pij", matrix, w, matrix) + 1e-12 * np.eye(matrix.shape[1])
        x = np.linalg.solve(normal, np.einsum("ei,pe->pi", matrix, w * b)[..., None])[..., 0]
        return x, (w * (x @ matrix.T - b) ** 2).sum(axis=1)

    return kernel


def censored_l2(matrix: np.ndarray):
    """Weights 0 and 1 mark missing and present data; dates that nothing ties get the least-norm solution. Residual: the norm."""

    def kernel(b: np.ndarray, w: np.ndarray):
        m = (w > 0).astype(float)
        normal = np.einsum("ei,pe,ej->pij", matrix, m, matrix)
        x = (np.linalg.pinv(normal, hermitian=True) @ np.einsum("ei,pe->pi", matrix, m * b)[..., None])[..., 0]
        return x, np.sqrt((m * (x @ matrix.T - b) ** 2).sum(axis=1))

    return kernel


def least_absolute(matrix: np.ndarray, rounds: int = 20, rho: float = 0.4, alpha: float = 1.0):
    """L1 by the alternating direction method of multipliers, with one factorisation for all pixels. Residual: the sum of absolutes."""
    solve = np.linalg.inv(matrix.T @ matrix) @ matrix.T

    def kernel(b: np.ndarray, w: np.ndarray):
        z = np.zeros_like(b)
        u = np.zeros_like(b)
        for _ in range(rounds):
            x = (b + z - u) @ solve.T
            h = alpha * (x @ matrix.T) + (1 - alpha) * (z + b)
            v = h - b + u
            z = np.sign(v) * np.maximum(np.abs(v) - 1 / rho, 0)
            u = u + h - z - b
        return x, np.abs(x @ matrix.T - b).sum(axis=1)

    return kernel


def solve_pixels(unw: DataFrame, pairs: list[tuple[int, int]], method: str, weight: str | None = None) -> DataFrame:
    """scene, row, col, solution (array by date after the first), residual for pixels with all `pairs`; method: l1, weighted or censored.

    phase may be null for censored only; weights default to 1 where there is a phase."""
    kernel = {"l1": least_absolute, "weighted": weighted_l2, "censored": censored_l2}[method](matrix_of(pairs))
    order = unw.sparkSession.createDataFrame([(a, b, k) for k, (a, b) in enumerate(pairs)], "ref_t int, sec_t int, k int")
    w = F.coalesce(F.col(weight), F.lit(0.0)) if weight else F.col("phase").isNotNull().cast("double")
    entry = F.struct("k", F.coalesce("phase", F.lit(0.0)).alias("phase"), w.alias("w"))
    # `pairs` came as a list: the frame is as small as the list.
    vectors = unw.join(F.broadcast(order), ["ref_t", "sec_t"]).groupBy(*PIXEL).agg(F.sort_array(F.collect_list(entry)).alias("v")).filter(F.size("v") == len(pairs))
    if method != "censored":
        vectors = vectors.filter(~F.exists("v", lambda x: x["w"].isNull()))
    rows = vectors.select(*PIXEL, F.transform("v", lambda x: x["phase"]).alias("phases"), F.transform("v", lambda x: x["w"]).alias("weights"))
    return rows.mapInPandas(_solver(kernel), "scene int, row int, col int, solution array<double>, residual double")
