"""Networks, pixel joins and masks."""

from __future__ import annotations

from pyspark.sql import functions as F


from fringeflow.functions.scalars import rounded
from fringeflow.operators import coherence, geometry, grid, interp, masks, network
from fringeflow.plans.catalog import query

from fringeflow.plans.scans import amplitude, table
from fringeflow.plans.sql import offsets, r, with_
from fringeflow.sources.virtual import COLS, DATES, ROWS, dates, slc

EDGES = "SELECT scene, ref_t, sec_t FROM pairs WHERE "
_STAR = "ref_i = 1 OR sec_i = 1"
_ANNUAL = "SELECT scene, ref_t, sec_t FROM (SELECT *, row_number() OVER (PARTITION BY scene, ref_t ORDER BY abs(date_diff('day', ref_dt, sec_dt) - 365), sec_t) AS k FROM pairs WHERE abs(date_diff('day', ref_dt, sec_dt) - 365) <= 30) WHERE k = 1"


@query("j1_all_pairs", with_("slc dates pairs", EDGES + "TRUE"))
def j1(spark, sf_dir):
    return network.all_pairs(dates(spark, sf_dir))


@query("j2_bandwidth", with_("slc dates pairs", EDGES + "sec_i - ref_i <= 2"))
def j2(spark, sf_dir):
    return network.by_bandwidth(dates(spark, sf_dir), 2)


@query("j3_baseline", with_("slc dates pairs", EDGES + "date_diff('day', ref_dt, sec_dt) <= 750"))
def j3(spark, sf_dir):
    return network.by_baseline(dates(spark, sf_dir), 750)


@query("j4_annual", with_("slc dates pairs", _ANNUAL))
def j4(spark, sf_dir):
    return network.annual(dates(spark, sf_dir))


@query("j5_star", with_("slc dates pairs", EDGES + _STAR))
def j5(spark, sf_dir):
    return network.star(dates(spark, sf_dir), 1)


@query("j6_manual", with_("slc dates pairs", "SELECT p.scene, p.ref_t, p.sec_t FROM pairs p JOIN (SELECT scene, count(*) AS n FROM dates GROUP BY scene) USING (scene) WHERE (ref_i = 0 AND sec_i = n - 1) OR (ref_i = 1 AND sec_i = 3) OR (ref_i = n - 3 AND sec_i = n - 2)"))
def j6(spark, sf_dir):
    return network.manual(dates(spark, sf_dir), [(0, -1), (1, 3), (-3, -2)]).filter("ref_t < sec_t")


@query("j7_union", with_("slc dates pairs", f"{EDGES} sec_i - ref_i <= 1 UNION {EDGES} {_STAR} UNION {_ANNUAL}"))
def j7(spark, sf_dir):
    return network.network(dates(spark, sf_dir), bandwidth=1, annual_buffer=30, reference=1)


@query("g1_network", with_("slc dates pairs", "SELECT DISTINCT scene, ref_t, sec_t FROM pairs WHERE sec_i - ref_i <= 3"))
def g1(spark, sf_dir):
    """The network that is built where none is asked for: the nearest three."""
    return network.network(dates(spark, sf_dir)).select("scene", "ref_t", "sec_t")


@query("g2_rank", with_("slc dates pairs", "SELECT scene, count(DISTINCT t) - 1 AS unknowns FROM (SELECT scene, ref_t AS t FROM pairs UNION ALL SELECT scene, sec_t FROM pairs) GROUP BY scene"))
def g2(spark, sf_dir):
    """The columns of a network's incidence matrix: its dates but the first."""
    found = network.incidence(network.by_bandwidth(dates(spark, sf_dir), 2))
    return found.groupBy("scene").agg(F.count_distinct("t").alias("unknowns"))


@query("j8_nearest_n", with_("slc dates pairs", EDGES + "sec_i - ref_i <= 3"))
def j8(spark, sf_dir):
    return network.network(dates(spark, sf_dir))


WIN = grid.rectangle(1, 1)
NEAR = 'near AS (SELECT a.scene, a.t, a."row", a.col, b.a AS v FROM amp a CROSS JOIN offsets o JOIN amp b ON b.scene = a.scene AND b.t = a.t AND b."row" = a."row" + o.dr AND b.col = a.col + o.dc)'


@query("j9_window_join", with_("slc amp", f'SELECT scene, t, "row", col, count(*) AS n, {r("sum(v)", "total", 4)} FROM near GROUP BY ALL', offsets(WIN), NEAR))
def j9(spark, sf_dir):
    rows = amplitude(spark, sf_dir)
    near = grid.neighbours(rows.select("scene", "t", "row", "col"), rows, WIN, ["scene", "t"], ["value"])
    return near.groupBy("scene", "t", "row", "col").agg(F.count("*").alias("n"), rounded(F.sum("value_n"), 4).alias("total"))


DISK = grid.disk(4)


@query("j10_disk_join", with_("slc amp", f'SELECT scene, t, "row", col, count(*) AS n, {r("max(v)", "most")} FROM near GROUP BY ALL', offsets(DISK), NEAR))
def j10(spark, sf_dir):
    rows = amplitude(spark, sf_dir)
    near = grid.neighbours(rows.select("scene", "t", "row", "col"), rows, DISK, ["scene", "t"], ["value"])
    return near.groupBy("scene", "t", "row", "col").agg(F.count("*").alias("n"), rounded(F.max("value_n")).alias("most"))


SPIRAL = grid.disk(5, spiral=True)
_KNN = 'SELECT scene, t, "row", col, rank, v FROM (SELECT a.scene, a.t, a."row", a.col, o.rank, b.a AS v, row_number() OVER (PARTITION BY a.scene, a.t, a."row", a.col ORDER BY o.rank) AS k FROM amp a CROSS JOIN offsets o JOIN amp b ON b.scene = a.scene AND b.t = a.t AND b."row" = a."row" + o.dr AND b.col = a.col + o.dc WHERE b.a > 60) WHERE k <= 4'


@query("j11_nearest_in_spiral", with_("slc amp", f'SELECT scene, t, "row", col, count(*) AS n, CAST(max(rank) AS INT) AS last_rank, {r("sum(v)", "total", 4)} FROM ({_KNN}) GROUP BY ALL', offsets(SPIRAL)))
def j11(spark, sf_dir):
    rows = amplitude(spark, sf_dir)
    near = interp.nearest_k(rows.select("scene", "t", "row", "col"), rows.filter("value > 60"), ["scene", "t"], ["value"], 4, 5)
    return near.groupBy("scene", "t", "row", "col").agg(F.count("*").alias("n"), F.max("rank").alias("last_rank"), rounded(F.sum("value_n"), 4).alias("total"))


@query(
    "j12_nearest_lookup",
    with_("slc amp", f'SELECT scene, t, "row", col, {r("v", "value")} FROM (SELECT g.scene, g.t, g."row", g.col, p.a AS v, row_number() OVER (PARTITION BY g.scene, g.t, g."row", g.col ORDER BY (g."row" - p."row")^2 + (g.col - p.col)^2, p."row", p.col) AS k FROM amp g JOIN amp p ON p.scene = g.scene AND p.t = g.t AND p.a > 70 WHERE g.a < 10) WHERE k = 1'),
)
def j12(spark, sf_dir):
    rows = amplitude(spark, sf_dir)
    return interp.nearest_value(rows.filter("value < 10"), rows.filter("value > 70"), ["scene", "t"], "value", bucket=4).withColumn("value", rounded(F.col("value")))


@query("j13_without_ps", with_("slc amp stats", 'SELECT a.scene, a.t, count(*) AS n FROM amp a ANTI JOIN (SELECT * FROM stats WHERE dispersion > 0 AND dispersion < 0.4) s ON a.scene = s.scene AND a."row" = s."row" AND a.col = s.col GROUP BY ALL'))
def j13(spark, sf_dir):
    from fringeflow.operators.ps import amplitude_stats

    stack = slc(spark, sf_dir)
    ps = amplitude_stats(stack, ["scene", "row", "col"], 0.4).filter("ps")
    return stack.join(ps, ["scene", "row", "col"], "left_anti").groupBy("scene", "t").agg(F.count("*").alias("n"))


@query("j14_reformed_phase", with_("slc dates pairs", f'SELECT p.scene, p.ref_t, p.sec_t, a."row", a.col, {r("atan2(b.im * a.re - b.re * a.im, b.re * a.re + b.im * a.im)", "phase")} FROM pairs p JOIN slc a ON a.scene = p.scene AND a.t = p.ref_t JOIN slc b ON b.scene = p.scene AND b.t = p.sec_t AND b."row" = a."row" AND b.col = a.col WHERE p.sec_i - p.ref_i <= 1'))
def j14(spark, sf_dir):
    found = coherence.reformed(slc(spark, sf_dir), network.by_bandwidth(dates(spark, sf_dir), 1))
    return found.withColumn("phase", rounded(F.col("phase")))


@query("j15_upsample", with_("slc amp", f'SELECT a.scene, a.t, a."row", a.col, {r("b.v", "value", 4)} FROM amp a LEFT JOIN (SELECT scene, t, "row" // 4 AS r, col // 3 AS c, sum(a) AS v FROM amp WHERE col < 9 GROUP BY ALL) b ON a.scene = b.scene AND a.t = b.t AND a."row" // 4 = b.r AND a.col // 3 = b.c'))
def j15(spark, sf_dir):
    rows = amplitude(spark, sf_dir)
    coarse = grid.take_looks(rows, 4, 3, {"value": "sum"}, ["scene", "t"], (ROWS, COLS))
    return grid.upsample(coarse, rows.select("scene", "t", "row", "col"), 4, 3, ["scene", "t"], ["value"]).withColumn("value", rounded(F.col("value"), 4))


_DELAY = "delays AS (SELECT scene, t, \"row\", col, a / 10 AS delay FROM amp)"


@query("j16_interferogram_delay", with_("slc amp dates pairs", f'SELECT p.scene, p.ref_t, p.sec_t, a."row", a.col, {r("a.delay - b.delay", "delay")} FROM pairs p JOIN delays a ON a.scene = p.scene AND a.t = p.ref_t JOIN delays b ON b.scene = p.scene AND b.t = p.sec_t AND b."row" = a."row" AND b.col = a.col WHERE p.sec_i - p.ref_i <= 1', _DELAY))
def j16(spark, sf_dir):
    delays = amplitude(spark, sf_dir).select("scene", "t", "row", "col", (F.col("value") / 10).alias("delay"))
    return geometry.interferogram_delays(delays, network.by_bandwidth(dates(spark, sf_dir), 1)).withColumn("delay", rounded(F.col("delay")))


_GRID = "g AS (SELECT scene AS day, t * 60.0 AS minute, \"row\" * 2.5 AS lat, col * 5.0 AS lon, a AS tec FROM amp)"
_POINTS = "pt AS (SELECT p_partkey AS id, p_partkey % 13 AS day, 10.0 + p_size * 6 AS minute, 1.0 + p_retailprice / 100.0 AS lat, 0.5 + p_size * 0.8 AS lon FROM part)"
_CORNER = (
    "SELECT id, CASE WHEN sum(w) FILTER (tec IS NOT NULL) > 1 - 1e-9 THEN round(sum(w * tec), 4) END AS tec FROM (SELECT pt.id, "
    "(CASE WHEN b.a = 1 THEN minute / 60 - floor(minute / 60) ELSE 1 - minute / 60 + floor(minute / 60) END) * (CASE WHEN b.b = 1 THEN lat / 2.5 - floor(lat / 2.5) ELSE 1 - lat / 2.5 + floor(lat / 2.5) END) * (CASE WHEN b.c = 1 THEN lon / 5 - floor(lon / 5) ELSE 1 - lon / 5 + floor(lon / 5) END) AS w, "
    "k.tec FROM pt CROSS JOIN (SELECT x.v AS a, y.v AS b, z.v AS c FROM (VALUES (0), (1)) x(v), (VALUES (0), (1)) y(v), (VALUES (0), (1)) z(v)) b "
    "LEFT JOIN (SELECT day, CAST(round(minute / 60) AS INT) AS m, CAST(round(lat / 2.5) AS INT) AS y, CAST(round(lon / 5) AS INT) AS x, tec FROM g) k ON k.day = pt.day AND k.m = floor(pt.minute / 60) + b.a AND k.y = floor(pt.lat / 2.5) + b.b AND k.x = floor(pt.lon / 5) + b.c) WHERE w > 0 GROUP BY id"
)


@query("j17_trilinear", with_("slc amp", _CORNER, _GRID, _POINTS))
def j17(spark, sf_dir):
    g = amplitude(spark, sf_dir).select(F.col("scene").alias("day"), (F.col("t") * 60.0).alias("minute"), (F.col("row") * 2.5).alias("lat"), (F.col("col") * 5.0).alias("lon"), F.col("value").alias("tec"))
    points = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 13).alias("day"), (10.0 + F.col("p_size") * 6).alias("minute"), (1.0 + F.col("p_retailprice") / 100.0).alias("lat"), (0.5 + F.col("p_size") * 0.8).alias("lon"))
    return geometry.trilinear(points, g, (60.0, 2.5, 5.0), ["id"]).withColumn("tec", F.round("tec", 4))


@query("k17_incidence", with_("slc dates pairs", "SELECT e.* FROM (SELECT scene, ref_t, sec_t, ref_t AS t, -1 AS coef FROM pairs WHERE sec_i - ref_i <= 2 UNION ALL SELECT scene, ref_t, sec_t, sec_t, 1 FROM pairs WHERE sec_i - ref_i <= 2) e JOIN (SELECT scene, min(t) AS f FROM dates GROUP BY scene) USING (scene) WHERE e.t <> f"))
def k17(spark, sf_dir):
    return network.incidence(network.by_bandwidth(dates(spark, sf_dir), 2))


@query("g3_single_reference", with_("slc dates pairs", "SELECT scene, count(DISTINCT ref_t) = 1 AND count(*) = count(DISTINCT sec_t) AS single FROM pairs WHERE ref_i = 0 OR (scene % 2 = 0 AND sec_i - ref_i <= 1) GROUP BY scene"))
def g3(spark, sf_dir):
    found = dates(spark, sf_dir)
    edges = network.star(found, 0).unionByName(network.by_bandwidth(found.filter("scene % 2 = 0"), 1)).distinct()
    return network.is_single_reference(edges)


@query("g6_compressed_network", with_("slc dates pairs", "SELECT scene, CASE WHEN sec_t > x THEN x ELSE ref_t END AS ref_t, sec_t FROM (SELECT p.scene, p.ref_t, p.sec_t, e.t AS x FROM pairs p LEFT JOIN ranked e ON e.scene = p.scene AND e.i = 4 WHERE p.ref_i = 1 AND p.sec_i >= 2) UNION SELECT scene, ref_t, sec_t FROM pairs WHERE ref_i >= 2 AND sec_i - ref_i <= 1"))
def g6(spark, sf_dir):
    return network.plan_with_compressed(dates(spark, sf_dir), 2, bandwidth=1, extra_reference=4)


_TWO = 'm1 AS (SELECT scene, "row", col, count(*) = 7 AS valid FROM slc GROUP BY ALL), m2 AS (SELECT scene, "row", col, max(a) < 90 AS valid FROM amp GROUP BY ALL)'


def _two_masks(spark, sf_dir):
    rows = amplitude(spark, sf_dir)
    by = rows.groupBy("scene", "row", "col")
    return [by.agg((F.count("*") == DATES).alias("valid")), by.agg((F.max("value") < 90).alias("valid"))]


@query("f1_mask_any", with_("slc amp", 'SELECT scene, "row", col, m1.valid AND m2.valid AS valid FROM m1 JOIN m2 USING (scene, "row", col)', _TWO))
def f1_any(spark, sf_dir):
    return masks.combined(_two_masks(spark, sf_dir), ["scene", "row", "col"], raise_on_empty=False)


@query("f1_mask_all", with_("slc amp", 'SELECT scene, "row", col, m1.valid OR m2.valid AS valid FROM m1 JOIN m2 USING (scene, "row", col)', _TWO))
def f1_all(spark, sf_dir):
    return masks.combined(_two_masks(spark, sf_dir), ["scene", "row", "col"], "all")


@query("f2_mask_convention", "SELECT p_partkey, p_size % 3 <> 0 AS valid, CAST(p_size % 3 = 0 AS INT) AS inverted FROM part")
def f2(spark, sf_dir):
    valid = masks.to_valid(F.col("p_size") % 3)
    return table(spark, sf_dir, "part").select("p_partkey", valid.alias("valid"), masks.from_valid(valid, False).alias("inverted"))


_XY = 'SELECT DISTINCT scene, "row", col, 3.0 * col AS x, 100 - 2.0 * "row" AS y FROM slc'


def _placed(spark, sf_dir):
    return slc(spark, sf_dir).select("scene", "row", "col").distinct().withColumns({"x": 3.0 * F.col("col"), "y": 100 - 2.0 * F.col("row")})


@query("f3_bbox_mask", with_("slc", f"SELECT *, x BETWEEN 5 AND 20 AND y BETWEEN 80 AND 95 AS inside FROM ({_XY})"))
def f3_bbox(spark, sf_dir):
    return _placed(spark, sf_dir).withColumn("inside", masks.within_bounds(F.col("x"), F.col("y"), (5, 80, 20, 95)))


RING = [(1.0, 71.0), (26.5, 73.0), (20.0, 85.0), (25.0, 99.0), (2.5, 97.0), (9.0, 83.0)]
_CROSS = " + ".join(f"CAST((({y0} > y) <> ({y1} > y)) AND x < ({x1 - x0}) * (y - {y0}) / ({y1 - y0}) + {x0} AS INT)" for (x0, y0), (x1, y1) in zip(RING, [*RING[1:], RING[0]], strict=True))


@query("f3_polygon_mask", with_("slc", f"SELECT *, ({_CROSS}) % 2 = 1 AS inside FROM ({_XY})"))
def f3_polygon(spark, sf_dir):
    return _placed(spark, sf_dir).withColumn("inside", masks.within_polygon(F.col("x"), F.col("y"), RING))


@query("f4_footprint_mask", with_("slc", f"SELECT scene, \"row\", col, x BETWEEN 5 AND 20 AND y BETWEEN 80 AND 95 AND ({_CROSS}) % 2 = 1 AS valid FROM ({_XY})"))
def f4(spark, sf_dir):
    placed = _placed(spark, sf_dir)
    keys = ["scene", "row", "col"]
    box = placed.select(*keys, masks.within_bounds(F.col("x"), F.col("y"), (5, 80, 20, 95)).alias("valid"))
    footprint = placed.select(*keys, masks.within_polygon(F.col("x"), F.col("y"), RING).alias("valid"))
    return masks.combined([box, footprint], keys)


@query("f5_nodata_any_time", with_("slc amp stats", 'SELECT s.scene, s."row", s.col, n = 7 AS valid, coalesce(n = 7 AND dispersion > 0 AND dispersion < 0.4, FALSE) AS ps FROM stats s'))
def f5(spark, sf_dir):
    from fringeflow.operators.ps import amplitude_stats

    keys = ["scene", "row", "col"]
    stack = slc(spark, sf_dir)
    valid = masks.complete_in_time(stack, DATES, keys)
    ps = masks.without_nodata_ps(amplitude_stats(stack, keys, 0.4).select(*keys, "ps"), valid, keys)
    return valid.join(ps, keys)


@query("f6_empty_images", with_("slc amp", "SELECT scene, t FROM amp GROUP BY ALL HAVING count(CASE WHEN a > 110 THEN a END) = 0"))
def f6(spark, sf_dir):
    rows = amplitude(spark, sf_dir).withColumn("value", F.when(F.col("value") > 110, F.col("value")))
    return masks.empty_images(rows, ["scene", "t"], "value")


@query("f7_combined_mask", with_("slc amp", 'SELECT a.scene, a.t, a."row", a.col, m1.valid AND a.a > 20 AS valid FROM amp a JOIN m1 USING (scene, "row", col)', _TWO))
def f7(spark, sf_dir):
    rows = amplitude(spark, sf_dir)
    return rows.join(_two_masks(spark, sf_dir)[0], ["scene", "row", "col"]).select("scene", "t", "row", "col", (F.col("valid") & (F.col("value") > 20)).alias("valid"))


@query("f8_propagate_nodata", with_("slc amp", f'SELECT a.scene, a.t, a."row", a.col, CASE WHEN m2.valid THEN {r("a.a", "value").rsplit(" AS ", 1)[0]} END AS value FROM amp a LEFT JOIN m2 USING (scene, "row", col)', _TWO))
def f8(spark, sf_dir):
    rows = amplitude(spark, sf_dir).select("scene", "t", "row", "col", rounded(F.col("value")).alias("value"))
    return masks.masked(rows, _two_masks(spark, sf_dir)[1], ["scene", "row", "col"], ["value"])


@query("f9_zero_where_masked", with_("slc amp", f'SELECT a.scene, a.t, a."row", a.col, CASE WHEN m2.valid THEN {r("a.a", "value").rsplit(" AS ", 1)[0]} ELSE 0 END AS value FROM amp a LEFT JOIN m2 USING (scene, "row", col)', _TWO))
def f9(spark, sf_dir):
    rows = amplitude(spark, sf_dir).select("scene", "t", "row", "col", rounded(F.col("value")).alias("value"))
    return masks.zeroed(rows, _two_masks(spark, sf_dir)[1], ["scene", "row", "col"], ["value"])


@query("f10_grow_nodata", with_("slc amp", f'SELECT a.scene, a.t, a."row", a.col, CASE WHEN bool_or(b.a < 5) THEN NULL ELSE {r("any_value(a.a)", "value").rsplit(" AS ", 1)[0]} END AS value FROM amp a CROSS JOIN offsets o LEFT JOIN amp b ON b.scene = a.scene AND b.t = a.t AND b."row" = a."row" + o.dr AND b.col = a.col + o.dc GROUP BY a.scene, a.t, a."row", a.col', offsets(WIN)))
def f10(spark, sf_dir):
    rows = amplitude(spark, sf_dir).withColumn("value", F.when(F.col("value") >= 5, F.col("value")))
    return masks.grown_nodata(rows, ["scene", "t"], "value", 1).withColumn("value", rounded(F.col("value")))


@query("f12_tile_pruning", with_("slc amp", f'SELECT scene, t, "row", col, {r("a", "value")} FROM amp WHERE (scene, t, "row" // 8, col // 5) IN (SELECT (scene, t, "row" // 8, col // 5) FROM amp WHERE a > 85)'))
def f12(spark, sf_dir):
    rows = amplitude(spark, sf_dir).withColumn("bright", F.when(F.col("value") > 85, F.col("value")))
    return masks.useful_tiles(rows, (8, 5), ["scene", "t"], "bright").select("scene", "t", "row", "col", rounded(F.col("value")).alias("value"))


@query("f13_point_selection", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE (l_discount * 10 > 0.75 OR l_tax * 10 > 0.55) AND l_returnflag <> 'R'")
def f13(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").filter(masks.unwrap_points(F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_returnflag") != "R", 0.75, 0.55)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("f14_interpolation_mask", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount * 10 >= 0.25 AND l_tax * 10 >= 0.35 AS keep FROM lineitem")
def f14(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", masks.interpolation_points(F.col("l_discount") * 10, F.col("l_tax") * 10, 0.25, 0.35).alias("keep"))


@query("u10_stale_pairs", with_("slc dates pairs", "SELECT scene, ref_t, sec_t FROM pairs WHERE sec_i - ref_i <= 3 EXCEPT SELECT scene, ref_t, sec_t FROM pairs WHERE ref_i = 0 OR sec_i - ref_i <= 1"))
def u10(spark, sf_dir):
    from fringeflow.operators.mosaic import stale

    found = dates(spark, sf_dir)
    return stale(network.by_bandwidth(found, 3), network.network(found, bandwidth=1, reference=0))


