"""Mosaics, resampling, cropping and frame splitting. Images: image (order), x, y in grid units, value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merged(images: DataFrame, keys: list[str], order: str = "image", nodata: float | None = None, bounds: tuple[float, float, float, float] | None = None, out_nodata: float | None = None) -> DataFrame:
    """keys, x, y, value: later images overwrite earlier ones, nodata (null, or the given value) never does; clipped to bounds (left, bottom, right, top), both ends included.

    With out_nodata, places that only hold nodata come out with that value."""
    value = F.nullif(F.col("value"), F.lit(nodata)) if nodata is not None else F.col("value")
    rows = images.select(*keys, "x", "y", F.col(order).alias("__order"), value.alias("value"))
    if bounds:
        rows = rows.filter(F.col("x").between(bounds[0], bounds[2]) & F.col("y").between(bounds[1], bounds[3]))
    last = rows.groupBy(*keys, "x", "y").agg(F.max_by("value", F.when(F.col("value").isNotNull(), F.col("__order"))).alias("value"))
    return last.withColumn("value", F.coalesce("value", F.lit(out_nodata))) if out_nodata is not None else last.filter("value IS NOT NULL")


def filled_nodata(image: DataFrame, nodata: float) -> DataFrame:
    """Null and NaN become the nodata value."""
    return image.withColumn("value", F.coalesce(F.nanvl("value", F.lit(None).cast("double")), F.lit(nodata)))


def downsampled(image: DataFrame, row_stride: int, col_stride: int) -> DataFrame:
    """Every stride-th pixel, from the middle of its look, renumbered."""
    r, c = F.col("row") - row_stride // 2, F.col("col") - col_stride // 2
    kept = image.filter((r >= 0) & (c >= 0) & (r % row_stride == 0) & (c % col_stride == 0))
    return kept.withColumn("row", F.floor(F.col("row") / row_stride).cast("int")).withColumn("col", F.floor(F.col("col") / col_stride).cast("int"))


def to_xy(row: Column, col: Column, transform: tuple[float, float, float, float, float, float]) -> tuple[Column, Column]:
    """Map coordinates of a pixel by an affine transform (x0, dx, rx, y0, ry, dy)."""
    x0, dx, rx, y0, ry, dy = transform
    return F.lit(x0) + dx * col + rx * row, F.lit(y0) + ry * col + dy * row


def to_rowcol(x: Column, y: Column, transform: tuple[float, float, float, float, float, float]) -> tuple[Column, Column]:
    x0, dx, rx, y0, ry, dy = transform
    det = dx * dy - rx * ry
    if det == 0:
        raise ValueError("the transform can't be inverted")
    return (dx * (y - y0) - ry * (x - x0)) / det, (dy * (x - x0) - rx * (y - y0)) / det


def matched(image: DataFrame, transform: tuple, target: DataFrame, target_transform: tuple, keys: list[str]) -> DataFrame:
    """The image on the target's grid (keys, row, col) in the same projection: nearest pixel, null outside."""
    x, y = to_xy(F.col("row") + 0.5, F.col("col") + 0.5, target_transform)
    row, col = to_rowcol(x, y, transform)
    at = target.withColumn("__r", F.floor(row).cast("int")).withColumn("__c", F.floor(col).cast("int"))
    side = image.select(*keys, F.col("row").alias("__r"), F.col("col").alias("__c"), "value")
    return at.join(side, [*keys, "__r", "__c"], "left").drop("__r", "__c")


def combined_bounds(meta: DataFrame, keys: list[str], align: tuple[float, float] | None = None) -> DataFrame:
    """left, bottom, right, top over a group's images, widened to multiples of `align`, their number and resolutions."""
    out = meta.groupBy(*keys).agg(F.min("left").alias("left"), F.min("bottom").alias("bottom"), F.max("right").alias("right"), F.max("top").alias("top"), F.count("*").alias("images"), F.count_distinct("dx", "dy").alias("resolutions"))
    if align:
        for c, step, pick in (("left", align[0], F.floor), ("bottom", align[1], F.floor), ("right", align[0], F.ceil), ("top", align[1], F.ceil)):
            out = out.withColumn(c, pick(F.col(c) / step) * step)
    return out


def mode_projection(meta: DataFrame, keys: list[str], column: str = "epsg") -> DataFrame:
    """The most frequent projection of each group, the least of equals."""
    n = meta.groupBy(*keys, column).agg(F.count("*").alias("n"))
    return n.groupBy(*keys).agg(F.max_by(column, F.struct("n", -F.col(column))).alias(column))


def azimuth_blocks(n_rows: int, n_blocks: int, halo: int) -> list[dict[str, int]]:
    """Blocks of rows: the core of each (the last takes the remainder) and what it reads with its halo."""
    size = n_rows // n_blocks
    if size <= 2 * halo:
        raise ValueError("blocks must have more than two halos' rows")
    out = []
    for k in range(n_blocks):
        first, end = k * size, n_rows if k == n_blocks - 1 else (k + 1) * size
        out.append({"block": k, "first": first, "end": end, "read_first": max(0, first - halo), "read_end": min(n_rows, end + halo)})
    return out


def least_halo(half_row: int, row_stride: int) -> int:
    return max(half_row, 7 * row_stride, 5 * row_stride) + 5


def split_rows(stack: DataFrame, blocks: list[dict[str, int]]) -> DataFrame:
    """Each row of the stack with every block that reads it; core: whether the block owns it."""
    table = F.explode(F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in b.items())) for b in blocks)))
    dealt = stack.withColumn("__b", table).filter((F.col("row") >= F.col("__b.read_first")) & (F.col("row") < F.col("__b.read_end")))
    core = (F.col("row") >= F.col("__b.first")) & (F.col("row") < F.col("__b.end"))
    return dealt.select(F.col("__b.block").alias("block"), *stack.columns, core.alias("core"))


def central(split: DataFrame) -> DataFrame:
    """The rows that blocks own: together each row of the frame once."""
    return split.filter("core").drop("core")


def stale(written: DataFrame, requested: DataFrame) -> DataFrame:
    """Pairs that were written and aren't asked for, and pairs of a date with itself."""
    return written.join(requested, written.columns, "left_anti").unionByName(requested.filter("ref_t = sec_t")).distinct()
