"""Interferogram networks: joins of the dates with themselves. `dates`: scene, t, dt."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAIR = ["scene", "ref_t", "sec_t"]


def _pairs(dates: DataFrame) -> DataFrame:
    """scene, ref_t, sec_t, ref_dt, sec_dt, ref_i, sec_i of all ordered pairs; dates per scene are few."""
    ranked = dates.withColumn("i", F.row_number().over(Window.partitionBy("scene").orderBy("t")) - 1)
    a = ranked.select("scene", F.col("t").alias("ref_t"), F.col("dt").alias("ref_dt"), F.col("i").alias("ref_i"))
    b = ranked.select("scene", F.col("t").alias("sec_t"), F.col("dt").alias("sec_dt"), F.col("i").alias("sec_i"))
    return a.join(b, "scene").filter("ref_i < sec_i")


def all_pairs(dates: DataFrame) -> DataFrame:
    return _pairs(dates).select(*PAIR)


def by_bandwidth(dates: DataFrame, n: int) -> DataFrame:
    """Pairs at most n places apart."""
    return _pairs(dates).filter(F.col("sec_i") - F.col("ref_i") <= n).select(*PAIR)


def by_baseline(dates: DataFrame, days: float) -> DataFrame:
    return _pairs(dates).filter(F.datediff("sec_dt", "ref_dt") <= days).select(*PAIR)


def annual(dates: DataFrame, buffer_days: float = 30, mode: str = "closest") -> DataFrame:
    """For each date the later one about a year on: within buffer_days of 365, the closest ("last": the latest)."""
    off = F.abs(F.datediff("sec_dt", "ref_dt") - 365)
    order = [off, F.col("sec_t")] if mode == "closest" else [F.desc("sec_t")]
    near = _pairs(dates).filter(off <= buffer_days)
    return near.withColumn("k", F.row_number().over(Window.partitionBy("scene", "ref_t").orderBy(*order))).filter("k = 1").select(*PAIR)


def star(dates: DataFrame, reference: int = 0) -> DataFrame:
    """Each date with the one at place `reference`, stored earlier first."""
    both = _pairs(dates)
    return both.filter((F.col("ref_i") == reference) | (F.col("sec_i") == reference)).select(*PAIR)


def manual(dates: DataFrame, indexes: list[tuple[int, int]]) -> DataFrame:
    """Pairs by place; negative places count from the end."""
    n = F.count("*").over(Window.partitionBy("scene"))
    sized = dates.withColumn("n", n).withColumn("i", F.row_number().over(Window.partitionBy("scene").orderBy("t")) - 1)
    wanted = sized.select("scene", F.col("t").alias("at"), "i", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.when(F.lit(a) < 0, F.col("n") + a).otherwise(F.lit(a)).alias("a"), F.when(F.lit(b) < 0, F.col("n") + b).otherwise(F.lit(b)).alias("b")) for k, (a, b) in enumerate(indexes)))).alias("w"))
    ends = wanted.select("scene", F.col("w.k").alias("k"), F.when(F.col("i") == F.col("w.a"), F.col("at")).alias("ref_t"), F.when(F.col("i") == F.col("w.b"), F.col("at")).alias("sec_t"))
    return ends.groupBy("scene", "k").agg(F.max("ref_t").alias("ref_t"), F.max("sec_t").alias("sec_t")).filter("ref_t IS NOT NULL AND sec_t IS NOT NULL").select(*PAIR)


def network(dates: DataFrame, bandwidth: int | None = None, baseline: float | None = None, annual_buffer: float | None = None, reference: int | None = None, indexes: list[tuple[int, int]] | None = None, nearest_default: int = 3) -> DataFrame:
    """The distinct union of the networks that are asked for; the nearest-3 network where none is."""
    parts = []
    if bandwidth is not None:
        parts.append(by_bandwidth(dates, bandwidth))
    if baseline is not None:
        parts.append(by_baseline(dates, baseline))
    if annual_buffer is not None:
        parts.append(annual(dates, annual_buffer))
    if reference is not None:
        parts.append(star(dates, reference))
    if indexes:
        parts.append(manual(dates, indexes))
    parts = parts or [by_bandwidth(dates, nearest_default)]
    return reduce(DataFrame.unionByName, parts).distinct()


def is_single_reference(edges: DataFrame) -> DataFrame:
    """scene, single: all pairs share their reference, and each other date is met once."""
    return edges.groupBy("scene").agg(((F.count_distinct("ref_t") == 1) & (F.count("*") == F.count_distinct("sec_t"))).alias("single"))


def incidence(edges: DataFrame) -> DataFrame:
    """scene, ref_t, sec_t, t, coef: -1 at the earlier and 1 at the later date; the first date of a scene has no column."""
    first = edges.groupBy("scene").agg(F.min("ref_t").alias("first_t"))
    ends = edges.select(*PAIR, F.explode(F.array(F.struct(F.col("ref_t").alias("t"), F.lit(-1).alias("coef")), F.struct(F.col("sec_t").alias("t"), F.lit(1).alias("coef")))).alias("e"))
    return ends.select(*PAIR, F.col("e.t").alias("t"), F.col("e.coef").alias("coef")).join(first, "scene").filter("t <> first_t").drop("first_t")


def plan_with_compressed(dates: DataFrame, n_compressed: int, bandwidth: int | None = None, extra_reference: int | None = None) -> DataFrame:
    """Pairs of phase-linked dates that follow compressed ones: a star from the newest compressed date (or, from the extra
    reference on, from that date), with an optional bandwidth network among the real dates; distinct."""
    ranked = dates.withColumn("i", F.row_number().over(Window.partitionBy("scene").orderBy("t")) - 1)
    base = ranked.filter(F.col("i") == max(0, n_compressed - 1)).select("scene", F.col("t").alias("ref_t"))
    real = ranked.filter(F.col("i") >= n_compressed)
    stars = real.select("scene", F.col("t").alias("sec_t"), "i").join(base, "scene").filter("sec_t > ref_t")
    if extra_reference is not None:
        extra = ranked.filter(F.col("i") == extra_reference).select("scene", F.col("t").alias("extra_t"))
        stars = stars.join(extra, "scene", "left").withColumn("ref_t", F.when(F.col("sec_t") > F.col("extra_t"), F.col("extra_t")).otherwise(F.col("ref_t")))
    out = stars.select(*PAIR)
    if bandwidth:
        out = out.unionByName(by_bandwidth(real.select("scene", "t", "dt"), bandwidth))
    return out.distinct()
