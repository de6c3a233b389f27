"""Streaming and incremental queries, and plain engine surface beyond the pixel stack."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fringeflow.functions.scalars import rounded
from fringeflow.plans.catalog import query
from fringeflow.plans.scans import table
from fringeflow.plans.sql import with_
from fringeflow.sources.virtual import slc
from fringeflow.streaming import sequential, statistics
from fringeflow.tables import shared_dir


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def _streamed(spark, source, transform, mode: str):
    """transform over a stream of source's rows, worked off once into a table in the shared folder."""
    folder = _folder(spark)
    source.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(source.schema).parquet(f"{folder}/in")
    out = transform(stream)

    def put(frame, index):
        frame.write.mode("overwrite").parquet(f"{folder}/out")

    if mode == "append":
        out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    else:
        out.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query("st7_running_stats", "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(var_pop(value) * count(value), 2) AS m2 FROM events GROUP BY event_type")
def st7(spark, sf_dir):
    """Mean and squared deviations kept by a stream."""
    found = _streamed(spark, table(spark, sf_dir, "events"), lambda s: statistics.running_stats(s, ["event_type"], "value"), "complete")
    return found.select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("m2", 2).alias("m2"))


@query("st7_merged_stats", "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(var_pop(value) * count(value), 2) AS m2 FROM events GROUP BY event_type")
def st7_merged(spark, sf_dir):
    """The same from the users' own statistics."""
    parts = statistics.running_stats(table(spark, sf_dir, "events"), ["event_type", "user_id"], "value")
    return statistics.merged_stats(parts, ["event_type"]).select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("m2", 2).alias("m2"))


@query("st9_tumbling_windows", "SELECT event_type, strftime(time_bucket(INTERVAL 6 HOURS, ts), '%Y-%m-%d %H:%M') AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def st9(spark, sf_dir):
    found = _streamed(spark, table(spark, sf_dir, "events"), lambda s: statistics.tumbling(s, ["event_type"], "6 hours", "value"), "complete")
    return found.select("event_type", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n", F.round("total", 4).alias("total"))


@query(
    "st9_session_windows",
    "WITH o AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOURS THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), "
    "s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o) "
    "SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k",
)
def st9_sessions(spark, sf_dir):
    found = statistics.sessions(table(spark, sf_dir, "events"), ["user_id"], "2 hours")
    return found.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("st1_sequential")
def st1(spark, sf_dir):
    """The sequential estimator over a stream: each file of new dates is a ministack that carries the compressed images before it."""
    folder = _folder(spark)
    stack = slc(spark, sf_dir)
    estimator = sequential.SequentialEstimator(spark, folder, (1, 1))
    for days in ([0, 1, 2, 3], [4, 5, 6]):
        stack.filter(F.col("t").isin(days)).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(stack.schema).parquet(f"{folder}/in")
        estimator.start(stream, f"{folder}/state").awaitTermination()
    return estimator.linked().select("scene", "row", "col", "t", rounded(F.col("phase"), 4).alias("phase"), rounded(F.col("temp_coh"), 4).alias("temp_coh"))


def _estimator(spark, sf_dir, parts, **options):
    """An estimator that has worked off the parts of the stack, and its folder."""
    stack, folder = slc(spark, sf_dir), _folder(spark)
    estimator = sequential.SequentialEstimator(spark, folder, sequential.LinkOptions(half_window=(1, 1), fill_ps=None), **options)
    for k, days in enumerate(parts):
        estimator.process(stack.filter(F.col("t").isin(days)), k)
    return stack, estimator


@query("st2_bounded_state", "SELECT * FROM (VALUES (0, 0, 1, 0), (0, 2, 3, 1), (0, 4, 5, 1), (0, 6, 6, 1)) AS v(ref_t, start_t, end_t, held)")
def st2(spark, sf_dir):
    """Ministacks that carry one compressed image only: its keys, and how many images the state held when it was made."""
    _, estimator = _estimator(spark, sf_dir, ([0, 1], [2, 3], [4, 5], [6]), most_compressed=1)
    n = [min(k, estimator.most) for k in range(4)]
    return spark.createDataFrame([(*key, held) for key, held in zip(estimator.keys(), n, strict=True)], "ref_t int, start_t int, end_t int, held int")


@query("st4_late_dates", with_("slc", 'SELECT scene, t, count(*) AS n FROM slc WHERE t IN (0, 3) GROUP BY ALL'))
def st4(spark, sf_dir):
    """A batch with dates that are linked already: they are set aside, and the new ones linked."""
    _, estimator = _estimator(spark, sf_dir, ([0, 1, 2, 3], [0, 3, 4, 5, 6]))
    return estimator.rejected().groupBy("scene", "t").agg(F.count("*").alias("n"))


@query("st5_restart", with_("slc", 'SELECT t, count(*) AS n FROM (SELECT scene, t FROM slc GROUP BY ALL) GROUP BY t'))
def st5(spark, sf_dir):
    """A finished ministack isn't done again; one whose last table is missing is written anew, with the same result."""
    from fringeflow.tables import delete

    stack, estimator = _estimator(spark, sf_dir, ([0, 1, 2, 3], [4, 5, 6]))
    estimator.process(stack.filter("t < 2"), 0)
    delete(spark, [f"{estimator.folder}/compressed/000001"])
    estimator.process(stack.filter("t > 3"), 1)
    return estimator.linked().select("scene", "t").distinct().groupBy("t").agg(F.count("*").alias("n"))


@query("st9_count_windows", with_("slc", 'SELECT scene, CAST((row_number() OVER (PARTITION BY scene ORDER BY t) - 1) // 3 AS INT) AS batch, t FROM (SELECT DISTINCT scene, t FROM slc)'))
def st9_count(spark, sf_dir):
    """Tumbling windows by count: each scene's dates in threes."""
    found = slc(spark, sf_dir).select("scene", "t").distinct()
    return sequential.chunked(found, 3).select("scene", "batch", "t")


@query("e1_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, CAST(GROUPING(l_returnflag) * 2 + GROUPING(l_linestatus) AS BIGINT) AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def e1(spark, sf_dir):
    """Plain engine surface."""
    cube = table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus")
    return cube.agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.grouping_id().alias("level"))
