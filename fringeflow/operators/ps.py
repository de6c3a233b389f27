"""Persistent scatterers: amplitude statistics, their mergeable forms, looked masks and filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fringeflow.functions.cx import angle, cx, expj, magnitude, mul_conj
from fringeflow.operators.grid import take_looks, upsample

THRESHOLD = 0.25


def flag(dispersion: Column, threshold: float = THRESHOLD) -> Column:
    """True below the threshold, null where the dispersion is 0 or missing."""
    return F.when(dispersion > 0, dispersion < threshold)


def amplitude_stats(stack: DataFrame, keys: list[str], threshold: float = THRESHOLD, min_count: int | None = None) -> DataFrame:
    """n, mean amplitude, dispersion (population deviation over mean; null with fewer than min_count dates) and ps per pixel. Zero amplitudes are nodata."""
    amplitude = F.nullif(magnitude(cx()), F.lit(0.0))
    stats = stack.select(*keys, amplitude.alias("a")).groupBy(*keys).agg(F.count("a").alias("n"), F.avg("a").alias("mean"), F.stddev_pop("a").alias("std"))
    enough = F.col("n") >= (min_count or 1)
    return stats.select(*keys, F.col("n").cast("long").alias("n"), "mean", F.when(enough, F.try_divide("std", "mean")).alias("dispersion")).withColumn("ps", flag(F.col("dispersion"), threshold))


def from_dispersion(rasters: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """ps from an existing dispersion; the other columns are kept."""
    return rasters.withColumn("ps", flag(F.col("dispersion"), threshold))


def combined(groups: DataFrame, keys: list[str]) -> DataFrame:
    """n, mean and dispersion of the union of disjoint groups of dates from each group's n, mean and dispersion."""
    n, mean, disp = F.col("n"), F.col("mean"), F.col("dispersion")
    sums = groups.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(n * mean).alias("s1"), F.sum(n * ((disp * mean) ** 2 + mean * mean)).alias("s2"))
    merged = sums.select(*keys, "n", F.try_divide("s1", "n").alias("mean"), F.try_divide("s2", "n").alias("second"))
    spread = F.sqrt(F.greatest(F.col("second") - F.col("mean") * F.col("mean"), F.lit(0.0)))
    return merged.select(*keys, F.col("n").cast("long").alias("n"), "mean", F.try_divide(spread, F.col("mean")).alias("dispersion"))


def looked(stats: DataFrame, row_looks: int, col_looks: int, keys: list[str], shape: tuple[int, int] | None = None) -> DataFrame:
    """Any ps and the least dispersion of each block."""
    return take_looks(stats, row_looks, col_looks, {"ps": "any", "dispersion": "min"}, keys, shape)


def brightest(stats: DataFrame, row_looks: int, col_looks: int, keys: list[str], shape: tuple[int, int] | None = None) -> DataFrame:
    """The brightest pixel of each block (with a shape, of each full one), the first in row-major order among equals: row, col (of the block), ps_row, ps_col."""
    inside = stats.filter(F.col("mean").isNotNull())
    if shape:
        inside = inside.filter((F.col("row") < shape[0] // row_looks * row_looks) & (F.col("col") < shape[1] // col_looks * col_looks))
    block = inside.select(*keys, F.floor(F.col("row") / row_looks).cast("int").alias("r"), F.floor(F.col("col") / col_looks).cast("int").alias("c"), F.struct("mean", -F.col("row"), -F.col("col")).alias("rank"), F.struct("row", "col").alias("at"))
    best = block.groupBy(*keys, "r", "c").agg(F.max_by("at", "rank").alias("at"))
    return best.select(*keys, F.col("r").alias("row"), F.col("c").alias("col"), F.col("at.row").alias("ps_row"), F.col("at.col").alias("ps_col"))


def filled(linked: DataFrame, stack: DataFrame, stats: DataFrame, row_looks: int, col_looks: int, shape: tuple[int, int] | None = None, reference: int = 0, mode: str = "max") -> DataFrame:
    """Linked phases (scene, t, row, col, re, im, temp_coh) with the look's PS phase where the look holds a PS.

    "max": the brightest PS's phase, "avg": the phase of the sum of the PS; both referenced to date `reference`. The
    amplitude stays and temp_coh becomes 1."""
    points = stats.filter("ps").select("scene", "row", "col", "mean")
    if mode == "max":
        chosen = brightest(points, row_looks, col_looks, ["scene"], shape)
        own = stack.select("scene", "t", F.col("row").alias("ps_row"), F.col("col").alias("ps_col"), "re", "im")
        phases = chosen.join(own, ["scene", "ps_row", "ps_col"]).select("scene", "t", "row", "col", F.col("re").alias("pre"), F.col("im").alias("pim"))
    else:
        own = stack.join(points, ["scene", "row", "col"])
        phases = take_looks(own, row_looks, col_looks, {"re": "sum", "im": "sum"}, ["scene", "t"], shape).withColumnsRenamed({"re": "pre", "im": "pim"})
    ref = phases.filter(F.col("t") == reference).select("scene", "row", "col", F.col("pre").alias("rre"), F.col("pim").alias("rim"))
    turned = mul_conj(cx("p"), cx("r"))
    ps = phases.join(ref, ["scene", "row", "col"]).select("scene", "t", "row", "col", angle(turned).alias("ps_phase"))
    size = magnitude(cx())
    out = linked.join(ps, ["scene", "t", "row", "col"], "left")
    new = expj(F.col("ps_phase"))
    is_ps = F.col("ps_phase").isNotNull()
    keep = [c for c in linked.columns if c not in ("re", "im", "temp_coh")]
    return out.select(*keep, F.when(is_ps, size * new.re).otherwise(F.col("re")).alias("re"), F.when(is_ps, size * new.im).otherwise(F.col("im")).alias("im"), F.when(is_ps, F.lit(1.0)).otherwise(F.col("temp_coh")).alias("temp_coh"))


def compressed(stack: DataFrame, linked: DataFrame, stats: DataFrame, row_looks: int, col_looks: int, first_real: int = 0, reference: int = 0) -> DataFrame:
    """One image that sums up a stack: each date turned back by its linked phase (referenced, upsampled), the phase of the
    sum over real dates, and the mean amplitude of those dates. stats: scene, row, col, mean."""
    ref = linked.filter(F.col("t") == reference).select("scene", "row", "col", F.col("re").alias("rre"), F.col("im").alias("rim"))
    turned = linked.filter(F.col("t") >= first_real).join(ref, ["scene", "row", "col"]).select("scene", "t", "row", "col", *(c.alias(n) for c, n in zip(mul_conj(cx(), cx("r")), ("lre", "lim"), strict=True)))
    real = stack.filter(F.col("t") >= first_real)
    joined = upsample(turned, real, row_looks, col_looks, ["scene", "t"], ["lre", "lim"])
    product = mul_conj(cx(), cx("l"))
    summed = joined.groupBy("scene", "row", "col").agg(F.sum(product.re).alias("sre"), F.sum(product.im).alias("sim"))
    out = summed.join(stats.select("scene", "row", "col", "mean"), ["scene", "row", "col"])
    phase = F.when((F.col("sre") != 0) | (F.col("sim") != 0), angle(cx("s")))
    return out.select("scene", "row", "col", (F.col("mean") * F.cos(phase)).alias("re"), (F.col("mean") * F.sin(phase)).alias("im"))
