"""Mosaics, resampling and frame splitting."""

from __future__ import annotations

from pyspark.sql import functions as F

from fringeflow.operators import geometry, mosaic
from fringeflow.plans.aggregates import KEYS, _out
from fringeflow.plans.catalog import query
from fringeflow.plans.scans import amplitude
from fringeflow.plans.sql import r, with_
from fringeflow.sources.virtual import ROWS, dates, slc

#: Scenes overlap: each is moved by 3 rows, and frames hold 4 scenes.
_IMG = 'img AS (SELECT scene // 4 AS frame, scene AS image, t, col AS x, "row" + 3 * (scene % 4) AS y, CASE WHEN a < 15 THEN 0.0 ELSE a END AS value FROM amp)'


def images(spark, sf_dir):
    rows = amplitude(spark, sf_dir)
    return rows.select(F.floor(F.col("scene") / 4).cast("int").alias("frame"), F.col("scene").alias("image"), "t", F.col("col").alias("x"), (F.col("row") + 3 * (F.col("scene") % 4)).alias("y"), F.when(F.col("value") < 15, F.lit(0.0)).otherwise(F.col("value")).alias("value"))


_LAST = "arg_max(value, image) FILTER (value <> 0)"


@query("u1_mosaic", with_("slc amp", f"SELECT CAST(frame AS INT) AS frame, x, y, {r('v', 'value')} FROM (SELECT frame, x, y, {_LAST} AS v FROM img WHERE t = 2 AND x BETWEEN 1 AND 8 AND y BETWEEN 0 AND 20 GROUP BY ALL) WHERE v IS NOT NULL", _IMG))
def u1(spark, sf_dir):
    return _out(mosaic.merged(images(spark, sf_dir).filter("t = 2"), ["frame"], nodata=0.0, bounds=(1, 0, 8, 20)), "value")


@query("u2_merge_by_date", with_("slc amp", f"SELECT CAST(frame AS INT) AS frame, t, x, y, {r(f'coalesce({_LAST}, -1)', 'value')} FROM img GROUP BY ALL", _IMG))
def u2(spark, sf_dir):
    return _out(mosaic.merged(images(spark, sf_dir), ["frame", "t"], nodata=0.0, out_nodata=-1.0), "value")


@query("u3_fill_nodata", with_("slc amp", f"SELECT CAST(frame AS INT) AS frame, image, t, x, y, {r('coalesce(nullif(value, 0), -9999)', 'value')} FROM img", _IMG))
def u3(spark, sf_dir):
    rows = images(spark, sf_dir).withColumn("value", F.nullif("value", F.lit(0.0)))
    return _out(mosaic.filled_nodata(rows, -9999.0), "value")


@query("u4_downsample", with_("slc amp", f'SELECT scene, t, CAST("row" // 3 AS INT) AS "row", CAST(col // 4 AS INT) AS col, {r("a", "value")} FROM amp WHERE "row" % 3 = 1 AND col % 4 = 2'))
def u4(spark, sf_dir):
    return _out(mosaic.downsampled(amplitude(spark, sf_dir), 3, 4), "value")


_T1, _T2 = (100.0, 10.0, 0.0, 500.0, 0.0, -10.0), (112.0, 7.0, 0.0, 489.0, 0.0, -6.0)


@query("u5_resample", with_("slc amp", f'SELECT g.scene, g.t, CAST(g."row" AS INT) AS "row", CAST(g.col AS INT) AS col, {r("a.a", "value")} FROM (SELECT s.scene, s.t, y.range AS "row", x.range AS col FROM (SELECT DISTINCT scene, t FROM slc) s, range(26) y, range(14) x) g LEFT JOIN amp a ON a.scene = g.scene AND a.t = g.t AND a."row" = floor((489.0 - 6 * (g."row" + 0.5) - 500) / -10) AND a.col = floor((112.0 + 7 * (g.col + 0.5) - 100) / 10)'))
def u5(spark, sf_dir):
    rows = amplitude(spark, sf_dir)
    target = rows.select("scene", "t").distinct().withColumn("row", F.explode(F.expr("sequence(0, 25)"))).withColumn("col", F.explode(F.expr("sequence(0, 13)")))
    return _out(mosaic.matched(rows, _T1, target, _T2, ["scene", "t"]), "value")


_PRODUCTS = ("max", "avg", "min")


@query("u6_stitched_products", with_("slc amp", " UNION ALL ".join(f"SELECT '{p}' AS product, CAST(frame AS INT) AS frame, x, y, {r('arg_max(v, image)', 'value')} FROM (SELECT frame, image, x, y, {p}(value) AS v FROM img GROUP BY ALL) GROUP BY ALL" for p in _PRODUCTS), _IMG))
def u6(spark, sf_dir):
    """Several per-scene products, each stitched over the frame."""
    per = images(spark, sf_dir).groupBy("frame", "image", "x", "y").agg(*(getattr(F, p)("value").alias(p) for p in _PRODUCTS))
    long = per.select("frame", "image", "x", "y", F.explode(F.array(*(F.struct(F.lit(p).alias("product"), F.col(p).alias("value")) for p in _PRODUCTS))).alias("p")).select("frame", "image", "x", "y", "p.product", "p.value")
    return _out(mosaic.merged(long, ["product", "frame"]), "value")


@query("u7_crop_mosaic", with_("slc amp", f'SELECT scene, t, "row", col, {r("a", "value")} FROM amp'))
def u7(spark, sf_dir):
    """Blocks with halos, cropped to their cores: the frame again."""
    split = mosaic.split_rows(amplitude(spark, sf_dir), mosaic.azimuth_blocks(ROWS, 3, 2))
    return _out(mosaic.central(split).drop("block"), "value")


@query("u8_azimuth_blocks", with_("slc", 'SELECT CAST(b.k AS INT) AS block, scene, count(*) AS n, count(*) FILTER ("row" >= b.f AND "row" < b.e) AS core FROM slc JOIN (VALUES (0, 0, 5, 0, 7), (1, 5, 10, 3, 12), (2, 10, 16, 8, 16)) AS b(k, f, e, rf, re) ON "row" >= rf AND "row" < b.re GROUP BY b.k, scene'))
def u8(spark, sf_dir):
    split = mosaic.split_rows(slc(spark, sf_dir), mosaic.azimuth_blocks(ROWS, 3, 2))
    return split.groupBy("block", "scene").agg(F.count("*").alias("n"), F.count_if("core").alias("core"))


@query("u9_distinct_edges", with_("slc dates pairs", "SELECT scene, ref_t, sec_t FROM pairs WHERE sec_i - ref_i <= 2 OR ref_i = 0"))
def u9(spark, sf_dir):
    from fringeflow.operators import network

    found = dates(spark, sf_dir)
    return network.by_bandwidth(found, 2).unionByName(network.star(found, 0)).distinct()


@query("ud8_geocode", with_("slc amp", f'SELECT scene, CAST(r AS INT) AS "row", CAST(c AS INT) AS col, {r("v", "value")} FROM (SELECT scene, floor(y) AS r, floor(x) AS c, a AS v, row_number() OVER (PARTITION BY scene, floor(y), floor(x) ORDER BY (x - floor(x) - 0.5) * (x - floor(x) - 0.5) + (y - floor(y) - 0.5) * (y - floor(y) - 0.5), "row", col) AS k FROM (SELECT scene, "row", col, a, (10.0 + 0.015625 * col + 0.00390625 * "row" - 9.875) / 0.03125 AS x, (50.0 + 0.0234375 * "row" - 0.00390625 * col - 49.875) / 0.0625 AS y FROM amp WHERE t = 1)) WHERE k = 1'))
def ud8(spark, sf_dir):
    rows = amplitude(spark, sf_dir).filter("t = 1").select(*KEYS, "value")
    places = rows.select("row", "col").distinct().select("row", "col", (10.0 + 0.015625 * F.col("col") + 0.00390625 * F.col("row")).alias("lon"), (50.0 + 0.0234375 * F.col("row") - 0.00390625 * F.col("col")).alias("lat"))
    return _out(geometry.geocoded(rows, places, ["scene"], (9.875, 49.875), (0.03125, 0.0625)), "value")


@query("ud3_summary_functions", with_("slc amp", f'SELECT scene, t, {r("median(a)", "median")}, {r("max(a)", "max")}, {r("stddev_pop(a)", "std")} FROM amp GROUP BY ALL'))
def ud3(spark, sf_dir):
    """Reducers chosen by name."""
    from fringeflow.operators.grid import REDUCERS

    rows = amplitude(spark, sf_dir)
    return _out(rows.groupBy("scene", "t").agg(*(REDUCERS[n](F.col("value")).alias(n) for n in ("median", "max", "std"))), "median", "max", "std")


@query("ud9_ionosphere_correction", with_("slc amp", f'SELECT a.scene, a.t, a."row", a.col, {r("a.a / cos(asin(sin(radians(30.0 + a.col)) / (1 + 1.379862e-2 * a.a))) * 1.379862e-2", "delay")} FROM amp a'))
def ud9(spark, sf_dir):
    """Delay of each pixel's TEC at its incidence, for a carrier whose bend is a round number."""
    import math

    from fringeflow.functions.scalars import K_IONO, TEC_UNIT, range_delay

    frequency = math.sqrt(K_IONO * TEC_UNIT / 1.379862e-2)
    return _out(amplitude(spark, sf_dir).select("scene", "t", "row", "col", range_delay(F.col("value"), 30.0 + F.col("col"), frequency).alias("delay")), "delay")


