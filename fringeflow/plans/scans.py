"""Scans, sources and sinks."""

from __future__ import annotations

import sys
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fringeflow.functions.cx import cx, magnitude
from fringeflow.functions.scalars import rounded
from fringeflow.operators import grid, mosaic
from fringeflow.plans.catalog import query
from fringeflow.plans.sql import r, with_
from fringeflow.sources import ionex, raster, simulate
from fringeflow.sources.virtual import COLS, DATES, FIRST_YEAR, ROWS, slc
from fringeflow.tables import shared_dir


def amplitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slc(spark, sf_dir).select("scene", "t", "row", "col", magnitude(cx()).alias("value"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("s1_window_scan", with_("slc amp", f'SELECT scene, t, CAST("row" // 2 AS INT) AS "row", CAST(col // 2 AS INT) AS col, {r("a", "value")} FROM amp WHERE "row" BETWEEN 2 AND 13 AND col BETWEEN 1 AND 8 AND "row" % 2 = 0 AND col % 2 = 0'))
def s1(spark, sf_dir):
    return raster.window(amplitude(spark, sf_dir), (2, 14), (1, 9), 2, shape=(ROWS, COLS)).withColumn("value", rounded(F.col("value")))


@query("s8_virtual_stack", with_("slc amp", f"SELECT scene, CAST({FIRST_YEAR} + t AS VARCHAR) || '-05-01' AS dt, count(*) AS n, {r('sum(a)', 'total', 4)} FROM amp GROUP BY scene, t"))
def s8(spark, sf_dir):
    rows = amplitude(spark, sf_dir)
    frames = {f"{FIRST_YEAR + t}0501": rows.filter(F.col("t") == t).drop("t") for t in range(DATES)}
    whole = raster.virtual_stack(frames, {k: (ROWS, COLS) for k in frames})
    return whole.groupBy("scene", F.date_format("dt", "yyyy-MM-dd").alias("dt")).agg(F.count("*").alias("n"), rounded(F.sum("value"), 4).alias("total"))


@query("s13_round_mantissa", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round_even(v / s, 0) * s AS kept FROM (SELECT *, l_extendedprice AS v, pow(2.0, floor(log2(abs(l_extendedprice))) - 10) AS s FROM lineitem)")
def s13(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", raster.round_mantissa(F.col("l_extendedprice"), 10).alias("kept"))


def _overview_sql(pick: str) -> str:
    return with_("slc amp stats", f'SELECT level, scene, CAST("row" // level AS INT) AS "row", CAST(col // level AS INT) AS col, {r(pick, "mean")} FROM stats, (VALUES (2), (4), (8)) AS l(level) GROUP BY level, scene, "row" // level, col // level')


def _overviews(spark, sf_dir, how):
    mean = amplitude(spark, sf_dir).groupBy("scene", "row", "col").agg(F.avg(F.nullif("value", F.lit(0.0))).alias("mean"))
    return grid.overviews(mean, [2, 4, 8], "mean", ["scene"], how).withColumn("mean", rounded(F.col("mean")))


@query("s14_overview_avg", _overview_sql("avg(mean)"))
def s14_avg(spark, sf_dir):
    return _overviews(spark, sf_dir, "average")


@query("s14_overview_nearest", _overview_sql('arg_min(mean, "row" * 1000 + col)'))
def s14_nearest(spark, sf_dir):
    return _overviews(spark, sf_dir, "nearest")


@query("s15_metadata_bounds", "SELECT CAST(s_suppkey AS VARCHAR) AS raster_id, 500.0 * s_nationkey AS \"left\", s_suppkey % 100 * 30.0 - 10.0 * (50 + s_nationkey) AS bottom, 500.0 * s_nationkey + 5.0 * (100 + s_suppkey % 7) AS \"right\", s_suppkey % 100 * 30.0 AS top FROM supplier")
def s15(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier")
    meta = rows.select(
        F.col("s_suppkey").cast("string").alias("raster_id"), (50 + F.col("s_nationkey")).alias("n_rows"), (100 + F.col("s_suppkey") % 7).alias("n_cols"),
        (500.0 * F.col("s_nationkey")).alias("x0"), F.lit(5.0).alias("dx"), (F.col("s_suppkey") % 100 * 30.0).alias("y0"), F.lit(-10.0).alias("dy"),
    )
    return raster.bounds(meta)


TRANSFORM = (500000.0, 5.0, 0.5, 4000000.0, -0.25, -10.0)


@query("s16_rowcol_xy", with_("slc", f'SELECT DISTINCT scene, "row", col, 500000.0 + 5.0 * col + 0.5 * "row" AS x, 4000000.0 - 0.25 * col - 10.0 * "row" AS y, CAST("row" AS DOUBLE) AS back_row, CAST(col AS DOUBLE) AS back_col FROM slc'))
def s16(spark, sf_dir):
    pixels = slc(spark, sf_dir).select("scene", "row", "col").distinct()
    x, y = mosaic.to_xy(F.col("row"), F.col("col"), TRANSFORM)
    placed = pixels.select("*", x.alias("x"), y.alias("y"))
    row, col = mosaic.to_rowcol(F.col("x"), F.col("y"), TRANSFORM)
    return placed.select("*", rounded(row, 4).alias("back_row"), rounded(col, 4).alias("back_col"))


@query("s19_group_by_burst", "SELECT 't' || lpad(CAST(c_nationkey AS VARCHAR), 3, '0') || '_iw' || CAST(1 + o_custkey % 3 AS VARCHAR) AS burst, count(*) AS files, strftime(min(o_orderdate), '%Y%m%d') AS first_date, strftime(max(o_orderdate), '%Y%m%d') AS last_date FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def s19(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    name = F.concat(F.lit("t"), F.lpad(F.col("c_nationkey").cast("string"), 3, "0"), F.lit("_iw"), (1 + F.col("o_custkey") % 3).cast("string"), F.lit("_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit(".h5"))
    files = rows.select(name.alias("name"))
    burst, date = F.regexp_extract("name", r"t[0-9]{3}_iw[1-3]", 0), F.regexp_extract("name", r"_([0-9]{8})\.", 1)
    return files.groupBy(burst.alias("burst")).agg(F.count("*").alias("files"), F.min(date).alias("first_date"), F.max(date).alias("last_date"))


def _ionex_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per customer segment: two maps, a latitude per region, 5 longitudes, values from counted customers. They are written in
    hundredths, so that no count looks like the format's 9999, and apart from each other, as counts outgrow its columns of five."""
    counted = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    cells = counted.groupBy("c_mktsegment", "n_regionkey", (F.col("n_nationkey") % 5).alias("k")).agg(F.count("*").alias("n"))
    full = cells.groupBy("c_mktsegment", "n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("m"))
    pad = lambda text: F.rpad(text, 60, " ")
    values = F.concat_ws("", F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.lpad(F.coalesce(F.element_at("m", k.cast("int")) * 10, F.lit(9999)).cast("string"), 20, " ")))
    lat = F.lpad(F.format_number(F.lit(87.5) - F.col("n_regionkey") * 2.5, 1), 6, " ")
    band = F.concat(pad(F.concat(F.lit("  "), lat, F.lit("-180.0 180.0   5.0 450.0"))), F.lit("LAT/LON1/LON2/DLON/H\n"), values, F.lit("\n"))
    body = full.groupBy("c_mktsegment").agg(F.concat_ws("", F.sort_array(F.collect_list(band), False)).alias("bands"))
    one = lambda hour: F.concat(pad(F.lit("     1")), F.lit("START OF TEC MAP\n"), pad(F.lit(f"  2022     1     1{hour:6d}     0     0")), F.lit("EPOCH OF CURRENT MAP\n"), F.col("bands"), pad(F.lit("     1")), F.lit("END OF TEC MAP\n"))
    return body.select(F.col("c_mktsegment").alias("file"), F.concat(pad(F.lit("    -2")), F.lit("EXPONENT\n"), one(0), one(2)).alias("body"))


@query(
    "s20_ionex",
    "WITH c AS (SELECT c_mktsegment AS file, n_regionkey AS g, n_nationkey % 5 AS k, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL), "
    "b AS (SELECT DISTINCT file, g FROM c) SELECT b.file, m.minute, 87.5 - b.g * 2.5 AS lat, -180.0 + 5.0 * ks.k AS lon, round(c.n / 10.0, 6) AS tec "
    "FROM b CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS ks(k) CROSS JOIN (VALUES (0.0::DOUBLE), (120.0::DOUBLE)) AS m(minute) LEFT JOIN c ON c.file = b.file AND c.g = b.g AND c.k = ks.k",
)
def s20(spark, sf_dir):
    return ionex.parsed(_ionex_bodies(spark, sf_dir)).withColumn("tec", F.round("tec", 6))


@query("s22_coherence_model", "SELECT o_orderkey, round((0.99 - 0.3) * exp(-abs(d) / 72.0) + 0.3, 6) AS gamma, round(((0.99 - 0.3) * exp(-abs(d) / 72.0) + 0.3) * (1 - 0.4 * (1 - cos(2 * pi() * d / 365.25)) / 2), 6) AS seasonal FROM (SELECT o_orderkey, date_diff('day', DATE '1998-01-01', CAST(o_orderdate AS DATE)) AS d FROM orders)")
def s22(spark, sf_dir):
    d = F.datediff("o_orderdate", F.lit("1998-01-01").cast("date"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(simulate.coherence_model(d), 6).alias("gamma"), F.round(simulate.coherence_model(d, seasonal=0.4), 6).alias("seasonal"))


@query("s9_useful_tiles", with_("slc", 'SELECT scene, CAST("row" // 4 AS INT) AS tile_row, CAST(col // 5 AS INT) AS tile_col, count(*) AS n FROM (SELECT scene, "row", col, count(*) AS k FROM slc GROUP BY ALL) GROUP BY ALL HAVING count(*) FILTER (k = 7) > 0'))
def s9(spark, sf_dir):
    from fringeflow.operators.masks import useful_tiles

    counted = slc(spark, sf_dir).groupBy("scene", "row", "col").agg(F.count("*").alias("k"))
    pixels = counted.withColumn("whole", F.when(F.col("k") == DATES, F.lit(1)))
    return useful_tiles(pixels, (4, 5), ["scene"], "whole").groupBy("scene", "tile_row", "tile_col").agg(F.count("*").alias("n"))


@query("s10_tiled_table", with_("slc amp", f'SELECT scene, t, "row", col, {r("a", "value")} FROM amp WHERE "row" BETWEEN 3 AND 11 AND col BETWEEN 2 AND 6'))
def s10(spark, sf_dir):
    """Written as tiles in the folder that all executors share, appended in two blocks, and read back by window."""
    path = f"{shared_dir(spark)}/tiles-{uuid.uuid4().hex}"
    rows = amplitude(spark, sf_dir)
    raster.write_tiles(rows.filter("row < 8"), path, (4, 5))
    lower = rows.filter("row >= 8").withColumn("row", F.col("row") - 8)
    raster.write_block(lower, path, 8, 0, (4, 5))
    return raster.read_tiles(spark, path, (3, 12), (2, 7), (4, 5)).withColumn("value", rounded(F.col("value")))


def _cells(spark, sf_dir):
    """The whole table as one image: the quantity on each cell."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy((F.col("l_partkey") % ROWS).cast("int").alias("row"), (F.col("l_suppkey") % COLS).cast("int").alias("col")).agg(F.sum("l_quantity").alias("value"))


#: Missing places of an image are NaN, and cells that are there but have no value are this.
HOLE, VOID = float("nan"), -sys.float_info.max


def _flat_path(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}.bin"


def _flat_file(spark, name: str, value: float = -1.0) -> raster.FlatRaster | raster.StoredRaster:
    """An empty image in the shared folder, wherever that is."""
    return raster.flat_raster(spark, _flat_path(spark, name), (ROWS, COLS)).create(value)


def _voided(cells: DataFrame) -> DataFrame:
    return cells.withColumn("value", F.coalesce(F.nanvl("value", F.lit(None).cast("double")), F.lit(VOID)))


def _held(pixels: DataFrame) -> DataFrame:
    """The cells that _voided() wrote, without the image's holes."""
    return pixels.filter(F.col("value").isNotNull()).withColumn("value", F.round(F.nullif("value", F.lit(VOID)), 2))


_CELLS = 'SELECT CAST(l_partkey % 16 AS INT) AS "row", CAST(l_suppkey % 10 AS INT) AS col, round(sum(l_quantity), 2) AS value FROM lineitem GROUP BY ALL'


@query("s4_flat_file", _CELLS)
def s4(spark, sf_dir):
    """An image written by blocks to a headerless file and scanned from there as bytes."""
    path = _flat_path(spark, "flat")
    file = raster.flat_raster(spark, path, (ROWS, COLS)).create(HOLE)
    raster.write_blocks(_voided(_cells(spark, sf_dir)), file, (8, 5), fill=HOLE)
    return _held(raster.read_flat(spark, path, file.shape, file.dtype, HOLE)).select("row", "col", "value")


@query("s7_stack_readers", f"SELECT 'f' || f AS file, \"row\", col, round(value * f, 2) AS value FROM ({_CELLS}), (VALUES (1), (2)) AS n(f)")
def s7(spark, sf_dir):
    """Two files as one stack, by readers that each task calls for its blocks."""
    files = {f"f{k}": _flat_file(spark, f"stack{k}", HOLE) for k in (1, 2)}
    for k, file in enumerate(files.values(), 1):
        raster.write_blocks(_voided(_cells(spark, sf_dir).withColumn("value", F.round("value", 2) * k)), file, (5, 4), fill=HOLE)
    return _held(raster.read_blocks(spark, files, (6, 7)))


@query("s11_write_window", f'SELECT r.range::INT AS "row", k.range::INT AS col, CASE WHEN r.range BETWEEN 4 AND 11 AND k.range BETWEEN 2 AND 7 THEN c.value ELSE -1.0 END AS value FROM range({ROWS}) r CROSS JOIN range({COLS}) k LEFT JOIN ({_CELLS}) c ON c."row" = r.range AND c.col = k.range')
def s11(spark, sf_dir):
    """A window written into an image that is there already, holes too; the rest of it stays."""
    file = _flat_file(spark, "window")
    places = spark.range(8 * 6).selectExpr("CAST(4 + id DIV 6 AS INT) AS row", "CAST(2 + id % 6 AS INT) AS col")
    raster.write_blocks(places.join(_cells(spark, sf_dir), ["row", "col"], "left"), file, (4, 3), fill=HOLE, row_start=4, col_start=2)
    return raster.read_blocks(spark, {"w": file}, (8, 5)).select("row", "col", F.round("value", 2).alias("value"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
