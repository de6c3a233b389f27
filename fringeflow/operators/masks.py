"""Masks: one convention inside, `valid` (null counts as not valid), and adapters for both of the file conventions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fringeflow.operators.grid import neighbours, rectangle


def to_valid(value: Column, zero_is_nodata: bool = True, nodata: float | None = None) -> Column:
    """valid from a raster's value: by default 0 is nodata, else 1 is; the file's own nodata value and null aren't valid."""
    good = value != 0 if zero_is_nodata else value == 0
    if nodata is not None:
        good = good & (value != nodata)
    return F.coalesce(good, F.lit(False))


def from_valid(valid: Column, zero_is_nodata: bool = True) -> Column:
    good = F.coalesce(valid, F.lit(False))
    return (good if zero_is_nodata else ~good).cast("int")


def combined(masks: list[DataFrame], keys: list[str], how: str = "any", raise_on_empty: bool = False) -> DataFrame:
    """keys, valid. "any": a pixel is masked out if any mask does so; "all": only if all do. A pixel that a mask lacks is masked out by it."""
    rows = reduce(DataFrame.unionByName, [m.select(*keys, F.coalesce("valid", F.lit(False)).cast("int").alias("v")) for m in masks])
    good = F.sum("v") == len(masks) if how == "any" else F.sum("v") > 0
    out = rows.groupBy(*keys).agg(good.alias("valid"))
    if raise_on_empty and out.filter("valid").isEmpty():
        raise ValueError("no valid pixel is left")
    return out


def within_bounds(meta_x: Column, meta_y: Column, bounds: tuple[float, float, float, float]) -> Column:
    left, bottom, right, top = bounds
    return meta_x.between(left, right) & meta_y.between(bottom, top)


def within_polygon(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd rule over a closed ring of vertices."""
    crossings = F.lit(0)
    for (x0, y0), (x1, y1) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if y0 != y1:
            spans = (F.lit(y0) > y) != (F.lit(y1) > y)
            crossings = crossings + (spans & (x < F.lit(x1 - x0) * (y - F.lit(y0)) / F.lit(y1 - y0) + F.lit(x0))).cast("int")
    return crossings % 2 == 1


def complete_in_time(stack: DataFrame, n_dates: DataFrame | Column | int, keys: list[str]) -> DataFrame:
    """keys, valid: pixels with a value on every date (n_dates: a number, or a frame of scene and n)."""
    counted = stack.groupBy(*keys).agg(F.count("re").alias("__n"))
    if isinstance(n_dates, DataFrame):
        return counted.join(n_dates, "scene").select(*keys, (F.col("__n") == F.col("n")).alias("valid"))
    return counted.select(*keys, (F.col("__n") == n_dates).alias("valid"))


def without_nodata_ps(ps: DataFrame, valid: DataFrame, keys: list[str]) -> DataFrame:
    """ps, false where not valid."""
    return ps.join(valid.select(*keys, "valid"), keys, "left").withColumn("ps", F.coalesce(F.col("ps"), F.lit(False)) & F.coalesce("valid", F.lit(False))).drop("valid")


def empty_images(stack: DataFrame, keys: list[str], value: str = "re") -> DataFrame:
    """keys of the images without any value."""
    return stack.groupBy(*keys).agg(F.count(value).alias("n")).filter("n = 0").drop("n")


def require_images(stack: DataFrame, keys: list[str], value: str = "re") -> DataFrame:
    """stack; raises where an image has no value at all."""
    if not empty_images(stack, keys, value).isEmpty():
        raise ValueError("an image has no valid pixel")
    return stack


def masked(values: DataFrame, mask: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """columns null where the mask isn't valid."""
    out = values.join(mask.select(*keys, "valid"), keys, "left")
    return out.select(*(F.when(F.coalesce("valid", F.lit(False)), F.col(c)).alias(c) if c in columns else F.col(c) for c in values.columns))


def zeroed(values: DataFrame, mask: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """columns 0 where the mask isn't valid. Both must cover the same pixels."""
    out = values.join(mask.select(*keys, "valid"), keys, "left")
    return out.select(*(F.when(F.coalesce("valid", F.lit(False)), F.col(c)).otherwise(F.lit(0)).alias(c) if c in columns else F.col(c) for c in values.columns))


def grown_nodata(pixels: DataFrame, keys: list[str], value: str, n: int) -> DataFrame:
    """pixels with value null where a null lies within n rows and columns."""
    bad = neighbours(pixels.filter(F.col(value).isNull()).select(*keys, "row", "col"), pixels.select(*keys, "row", "col"), rectangle(n, n), keys, ["row", "col"])
    hit = bad.select(*keys, F.col("row_n").alias("row"), F.col("col_n").alias("col")).distinct().withColumn("__bad", F.lit(True))
    out = pixels.join(hit, [*keys, "row", "col"], "left")
    return out.select(*(F.when(F.col("__bad").isNull(), F.col(value)).alias(value) if c == value else F.col(c) for c in pixels.columns))


def useful_tiles(pixels: DataFrame, tile: tuple[int, int], keys: list[str], value: str) -> DataFrame:
    """The pixels of tiles that hold any value."""
    at = [F.floor(F.col("row") / tile[0]).cast("int").alias("tile_row"), F.floor(F.col("col") / tile[1]).cast("int").alias("tile_col")]
    dealt = pixels.select("*", *at)
    some = dealt.filter(F.col(value).isNotNull()).select(*keys, "tile_row", "tile_col").distinct()
    return dealt.join(some, [*keys, "tile_row", "tile_col"], "left_semi")


def unwrap_points(temp_coh: Column, similarity: Column, valid: Column, least_coh: float = 0.7, least_sim: float = 0.5) -> Column:
    return ((temp_coh > least_coh) | (similarity > least_sim)) & valid


def interpolation_points(correlation: Column, similarity: Column, least_cor: float = 0.25, least_sim: float = 0.3) -> Column:
    return (correlation >= least_cor) & (similarity >= least_sim)
