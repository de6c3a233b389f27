"""Mergeable running statistics and windows over event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_stats(events: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean and m2 (the sum of squared deviations) per key; as a stream, in update mode. Spark merges partial moments like the batch operators do."""
    return events.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count(value)).alias("m2"))


def merged_stats(parts: DataFrame, keys: list[str]) -> DataFrame:
    """running_stats of the union from those of disjoint parts."""
    sums = parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mean")).alias("s"), F.sum(F.col("m2") + F.col("n") * F.col("mean") ** 2).alias("q"))
    mean = F.try_divide("s", "n")
    return sums.select(*keys, "n", mean.alias("mean"), (F.col("q") - F.col("n") * mean**2).alias("m2"))


def tumbling(events: DataFrame, keys: list[str], duration: str, value: str, time: str = "ts", late: str | None = None) -> DataFrame:
    """n and total per key and window; with `late`, a watermark lets a stream close windows."""
    rows = events.withWatermark(time, late) if late else events
    out = rows.groupBy(F.window(time, duration), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(*keys, F.col("window.start").alias("start"), "n", "total")


def sessions(events: DataFrame, keys: list[str], gap: str, time: str = "ts", late: str | None = None) -> DataFrame:
    rows = events.withWatermark(time, late) if late else events
    out = rows.groupBy(F.session_window(time, gap).alias("session"), *keys).agg(F.count("*").alias("n"))
    return out.select(*keys, F.col("session.start").alias("start"), F.col("session.end").alias("end"), "n")
