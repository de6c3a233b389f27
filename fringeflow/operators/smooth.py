"""Separable smoothing: sums along both axes inside tiles with a halo of the kernel."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringeflow.functions.cx import cx, expj
from fringeflow.operators.grid import PLACES, TILE, each_group, places, tiles_near


def _along(values: np.ndarray, axis: int, taps: list[tuple[int, float]], reach: int) -> np.ndarray:
    """Sums of images (any x height x width) over the taps along an axis, whose first and last `reach` places are a border and stay 0."""
    out, n = np.zeros_like(values), values.shape[axis] - 2 * reach
    at = lambda first: tuple(slice(first, first + n) if k == axis else slice(None) for k in range(3))
    out[at(reach)] = sum(w * values[at(reach - o)] for o, w in taps)
    return out


def separable(pixels: DataFrame, keys: list[str], values: list[str], row_taps: list[tuple[int, float]], col_taps: list[tuple[int, float]], normalise: bool = True, keep: list[str] | None = None) -> DataFrame:
    """keys, row, col, values smoothed over both axes of a dense grid (nodata: null values in present rows), and the columns to keep.

    normalise: divide by the weights that met a value, so that nodata and the border don't pull toward 0. Pixels go to
    tiles with a halo of the taps, once; both axes are summed inside a tile."""
    taps, keep, at = (row_taps, col_taps), keep or [], ["tile_row", "tile_col"]
    reach = [max(abs(o) for o, _ in t) for t in taps]
    side = [max(TILE, 2 * h) for h in reach]
    dealt = pixels.select(*keys, "row", "col", *(F.col(v).cast("double").alias(v) for v in values), *keep)
    for c, n, h, name in zip(("row", "col"), side, reach, at, strict=True):
        dealt = dealt.withColumn(name, F.explode(tiles_near(c, n, h)))
    names = [*keys, "row", "col", *values, *keep]

    def smoothed(table, group, row, col, box):
        """Of a few groups: each value and its weights."""
        shape = (group[-1] - group[0] + 1, box[0] + 2 * reach[0], box[1] + 2 * reach[1])
        where = (group - group[0], row + reach[0], col + reach[1])
        there = np.zeros(shape, dtype=bool)
        there[where] = True
        for v in values:
            given = table.column(v)
            both = []
            for part in (given.fill_null(0.0).to_numpy(), given.is_valid().to_numpy().astype(float)):
                image = np.zeros(shape)
                image[where] = part
                for axis in (0, 1):
                    image = np.where(there, _along(image, axis + 1, taps[axis], reach[axis]), 0.0)
                both.append(image[where])
            yield v, *both

    def fn(table, starts):
        group, row, col, box = places(table, starts, ("row", "col"))
        own = np.logical_and.reduce([(table.column(c).to_numpy() + n // 2) // n == table.column(t).to_numpy() for c, n, t in zip(("row", "col"), side, at, strict=True)])
        step = max(1, PLACES // ((box[0] + 2 * reach[0]) * (box[1] + 2 * reach[1])))
        for g in range(0, len(starts) - 1, step):
            part = slice(starts[g], starts[min(g + step, len(starts) - 1)])
            some = table.slice(part.start, part.stop - part.start)
            done = {}
            for v, total, weight in smoothed(some, group[part], row[part], col[part], box):
                divided = np.divide(total, weight, out=np.zeros_like(total), where=weight != 0)
                done[v] = pa.array(divided, mask=weight == 0) if normalise else pa.array(total)
            yield pa.table([done[c] if c in done else some.column(c) for c in names], names=names).filter(pa.array(own[part]))

    kinds = {f.name: f.dataType.simpleString() for f in dealt.schema.fields}
    return each_group(dealt, [*keys, *at], fn, ", ".join(f"`{c}` {kinds[c]}" for c in names))


def gaussian_taps(sigma: float, truncate: float = 4.0) -> list[tuple[int, float]]:
    """Weights of a sampled Gaussian, cut at `truncate` deviations and summing to 1."""
    reach = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    return [(k - reach, w / sum(raw)) for k, w in enumerate(raw)]


def box_taps(size: int) -> list[tuple[int, float]]:
    first = -(size // 2)
    return [(first + k, 1.0 / size) for k in range(size)]


def gaussian(pixels: DataFrame, keys: list[str], value: str, sigma: tuple[float, float]) -> DataFrame:
    """Nan-aware Gaussian smoothing; nodata pixels stay nodata."""
    rows = pixels.select(*keys, "row", "col", F.col(value).alias("__v"), F.col(value).alias("__own"))
    done = separable(rows, keys, ["__v"], gaussian_taps(sigma[0]), gaussian_taps(sigma[1]), keep=["__own"])
    return done.select(*keys, "row", "col", F.when(F.col("__own").isNotNull(), F.col("__v")).alias(value))


def box_mean(pixels: DataFrame, keys: list[str], value: str, size: tuple[int, int]) -> DataFrame:
    """The mean over a moving box, of the pixels it meets."""
    return separable(pixels, keys, [value], box_taps(size[0]), box_taps(size[1]))


def correlation(ifgs: DataFrame, keys: list[str], window: tuple[int, int], ignore_invalid: bool = False) -> DataFrame:
    """Correlation of an interferogram's phase with its surroundings: the length of the Gaussian mean (deviation a third of the window) of its phasors.

    Invalid pixels (null or 0) come out null or 0; by default they enter the mean as phase 0, like a file's zeros,
    and with ignore_invalid they don't."""
    zero = (F.col("re") == 0) & (F.col("im") == 0)
    phase = F.coalesce(F.atan2("im", "re"), F.lit(0.0))
    one = expj(phase)
    seen = F.when(F.col("re").isNotNull() & ~zero, F.lit(True)) if ignore_invalid else F.lit(True)
    grid = ifgs.select(*keys, "row", "col", F.when(seen, one.re).alias("c"), F.when(seen, one.im).alias("s"), F.col("re").alias("__re"), F.col("im").alias("__im"))
    back = separable(grid, keys, ["c", "s"], gaussian_taps(window[0] / 3), gaussian_taps(window[1] / 3), normalise=True, keep=["__re", "__im"])
    size = F.sqrt(F.col("c") ** 2 + F.col("s") ** 2)
    own = cx("__")
    value = F.when(own.re.isNull(), F.lit(None)).when((own.re == 0) & (own.im == 0), F.lit(0.0)).otherwise(F.least(F.greatest(size, F.lit(0.0)), F.lit(1.0)))
    return back.select(*keys, "row", "col", value.alias("correlation"))
