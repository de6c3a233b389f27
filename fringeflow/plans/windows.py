"""Homogeneous pixels, smoothing, interpolation, blocks and ministack planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from fringeflow.functions.cx import angle, cx
from fringeflow.functions.scalars import rounded
from fringeflow.operators import grid, interp, ps, shp, smooth, timeseries
from fringeflow.plans.aggregates import KEYS, PX, _out, stats
from fringeflow.plans.catalog import query
from fringeflow.plans.scans import amplitude
from fringeflow.plans.sql import offsets, r, with_
from fringeflow.sources.virtual import COLS, DATES, ROWS, dates, slc
from fringeflow.streaming import sequential

HALF = (1, 2)
AROUND = grid.rectangle(*HALF, centre=False)
CHI = shp.chi_square_quantile(0.05)
GLRT = f'shp AS (SELECT a.scene, a."row", a.col, o.dr, o.dc FROM s a CROSS JOIN offsets o JOIN s b ON b.scene = a.scene AND b."row" = a."row" + o.dr AND b.col = a.col + o.dc WHERE {float(DATES)} * (2 * ln((a.s + b.s) / 2) - ln(a.s) - ln(b.s)) < {CHI!r})'
_S = 's AS (SELECT scene, "row", col, (var + mean * mean) / 2 AS s FROM stats)'


def _glrt(spark, sf_dir):
    found = stats(spark, sf_dir).select(*KEYS, "mean", ((F.col("dispersion") * F.col("mean")) ** 2).alias("var"))
    return found, shp.estimate("glrt", HALF, stats=found, n=DATES, alpha=0.05)


@query("k1_glrt", with_("slc amp stats", f"SELECT {PX}, dr, dc FROM shp", _S, offsets(AROUND), GLRT))
def k1(spark, sf_dir):
    return _glrt(spark, sf_dir)[1]


@query("a15_shp_counts", with_("slc amp stats", f'SELECT s.scene, s."row", s.col, count(h.dr) AS shp_count FROM stats s LEFT JOIN shp h USING (scene, "row", col) GROUP BY ALL', _S, offsets(AROUND), GLRT))
def a15(spark, sf_dir):
    found, edges = _glrt(spark, sf_dir)
    return shp.counts(edges, found)


_KS = (
    'ecdf AS (SELECT a.scene, a."row", a.col, o.dr, o.dc, a.xs AS x, b.xs AS y FROM (SELECT scene, "row", col, list(a) AS xs FROM amp GROUP BY ALL) a CROSS JOIN offsets o '
    'JOIN (SELECT scene, "row", col, list(a) AS xs FROM amp GROUP BY ALL) b ON b.scene = a.scene AND b."row" = a."row" + o.dr AND b.col = a.col + o.dc), '
    "ks AS (SELECT scene, \"row\", col, dr, dc, list_max(list_transform(list_concat(x, y), lambda v: abs(len(list_filter(x, lambda u: u <= v)) / len(x) - len(list_filter(y, lambda u: u <= v)) / len(y)))) AS distance FROM ecdf)"
)


@query("k2_ks_distance", with_("slc amp", f"SELECT {PX}, dr, dc, {r('distance')} FROM ks", offsets(AROUND), _KS))
def k2_distance(spark, sf_dir):
    return _out(shp.ks_distances(slc(spark, sf_dir), HALF), "distance")


@query("k2_ks", with_("slc amp", f"SELECT {PX}, dr, dc FROM ks WHERE distance < {shp.ks_critical_distance(DATES, 0.05)!r}", offsets(AROUND), _KS))
def k2(spark, sf_dir):
    return shp.estimate("ks", HALF, stack=slc(spark, sf_dir), n=DATES, alpha=0.05)


def _kolmogorov_sql(d: str) -> str:
    """Twice the alternating sum of the Kolmogorov distribution for two samples of n."""
    v = f"({d} * (sqrt(n / 2.0) + 0.12 + 0.11 / sqrt(n / 2.0)))"
    return f"2 * list_sum(list_transform(range(1, 101), lambda j: (CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * {v} * {v} * j * j)))"


@query("k3_ks_critical", f"SELECT n, alpha, CAST(round(min(0.01 + 0.001 * k), 3) AS DOUBLE) AS distance FROM (SELECT DISTINCT 5 + p_size AS n FROM part), (VALUES (0.05::DOUBLE), (0.01::DOUBLE)) AS a(alpha), (SELECT range AS k FROM range(1000)) WHERE {_kolmogorov_sql('(0.01 + 0.001 * k)')} <= alpha GROUP BY ALL")
def k3(spark, sf_dir):
    """Critical distances for as many dates as parts have sizes: a few dozen values, found on the driver."""
    sizes = [x[0] for x in spark.read.parquet(f"{sf_dir}/part.parquet").select((F.col("p_size") + 5).alias("n")).distinct().collect()]
    found = [(n, a, round(shp.ks_critical_distance(n, a), 3)) for n in sizes for a in (0.05, 0.01)]
    return spark.createDataFrame(found, "n int, alpha double, distance double")


@query("k5_rect_window", with_("slc", f'SELECT a.scene, a."row", a.col, o.dr, o.dc FROM (SELECT DISTINCT {PX} FROM slc) a CROSS JOIN offsets o JOIN (SELECT DISTINCT {PX} FROM slc) b ON b.scene = a.scene AND b."row" = a."row" + o.dr AND b.col = a.col + o.dc', offsets(grid.rectangle(*HALF))))
def k5(spark, sf_dir):
    return shp.estimate("rect", HALF, stats=stats(spark, sf_dir))


@query("w2_ministack_plan", with_("slc dates", "SELECT scene, t, CASE WHEN i < 1 THEN -1 ELSE CAST((i - 1) // 3 AS INT) END AS batch FROM (SELECT scene, t, row_number() OVER (PARTITION BY scene ORDER BY t) - 1 AS i FROM dates)"))
def w2(spark, sf_dir):
    return sequential.chunked(dates(spark, sf_dir), 3, 1)


@query("w3_triplet_names", with_("slc dates", "SELECT * FROM (SELECT scene, t, strftime(dt, '%Y%m%d') || '_' || strftime(lead(dt, 1) OVER w, '%Y%m%d') || '_' || strftime(lead(dt, 2) OVER w, '%Y%m%d') AS name FROM dates WINDOW w AS (PARTITION BY scene ORDER BY t)) WHERE name IS NOT NULL"))
def w3(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("scene").orderBy("t")
    day = lambda c: F.date_format(c, "yyyyMMdd")
    rows = dates(spark, sf_dir).select("scene", "t", "dt", F.lead("dt", 1).over(w).alias("d1"), F.lead("dt", 2).over(w).alias("d2")).filter("d2 IS NOT NULL")
    return rows.select("scene", "t", F.concat_ws("_", day("dt"), day("d1"), day("d2")).alias("name"))


@query("w4_extra_reference", with_("slc amp", f'SELECT a.scene, a."row", a.col, a.t, CASE WHEN a.t > 3 THEN {r("a.p - b.p", "x").rsplit(" AS ", 1)[0]} ELSE {r("a.p", "x").rsplit(" AS ", 1)[0]} END AS phase FROM amp a LEFT JOIN amp b ON a.scene = b.scene AND a."row" = b."row" AND a.col = b.col AND b.t = 3'))
def w4(spark, sf_dir):
    series = slc(spark, sf_dir).select(*KEYS, "t", angle(cx()).alias("phase"))
    return _out(timeseries.rereferenced_in_time(series, 3), "phase")


@query("w5_rereference", with_("slc", f'SELECT a.scene, a.t, a."row", a.col, {r("(a.re * b.re + a.im * b.im) / sqrt(b.re * b.re + b.im * b.im)", "re")}, {r("(a.im * b.re - a.re * b.im) / sqrt(b.re * b.re + b.im * b.im)", "im")} FROM slc a JOIN slc b ON a.scene = b.scene AND a."row" = b."row" AND a.col = b.col AND b.t = 2'))
def w5(spark, sf_dir):
    from fringeflow.functions.cx import Cx, magnitude, mul_conj

    stack = slc(spark, sf_dir)
    ref = stack.filter("t = 2").select(*KEYS, F.col("re").alias("rre"), F.col("im").alias("rim"))
    turned = mul_conj(cx(), cx("r"))
    size = magnitude(cx("r"))
    out = Cx(turned.re / size, turned.im / size)
    return stack.join(ref, KEYS).select("scene", "t", "row", "col", rounded(out.re).alias("re"), rounded(out.im).alias("im"))


DENSE = f'dense AS (SELECT s.scene, s.t, g."row", g.col, a.a, a.re, a.im FROM (SELECT DISTINCT scene, t FROM slc) s CROSS JOIN (SELECT x.range AS "row", y.range AS col FROM range({ROWS}) x, range({COLS}) y) g LEFT JOIN amp a ON a.scene = s.scene AND a.t = s.t AND a."row" = g."row" AND a.col = g.col)'


def dense(spark, sf_dir):
    """Every place of every image: missing samples as null."""
    stack = slc(spark, sf_dir)
    places = stack.select("scene", "t").distinct().withColumn("row", F.explode(F.expr(f"sequence(0, {ROWS - 1})"))).withColumn("col", F.explode(F.expr(f"sequence(0, {COLS - 1})")))
    return places.join(stack, ["scene", "t", "row", "col"], "left").withColumn("a", F.sqrt(F.col("re") ** 2 + F.col("im") ** 2))


def taps_sql(taps, name):
    return f"{name} AS (SELECT * FROM (VALUES " + ", ".join(f"({o}, {w!r}::DOUBLE)" for o, w in taps) + ") AS v(o, w))"


def smooth_sql(value: str, own: str) -> str:
    """Smoothed value over the taps tr and tc; own: what decides whether the pixel itself counts."""
    return f'SELECT d.scene, d.t, CAST(d."row" AS INT) AS "row", CAST(d.col AS INT) AS col, {own} FROM dense d CROSS JOIN tr CROSS JOIN tc LEFT JOIN dense b ON b.scene = d.scene AND b.t = d.t AND b."row" = d."row" - tr.o AND b.col = d.col - tc.o GROUP BY d.scene, d.t, d."row", d.col'


_BOX = smooth_sql("a", r("sum(tr.w * tc.w * b.a) / nullif(sum(CASE WHEN b.a IS NOT NULL THEN tr.w * tc.w END), 0)", "a"))


@query("w6_box_mean", with_("slc amp", _BOX, DENSE, taps_sql(smooth.box_taps(3), "tr"), taps_sql(smooth.box_taps(5), "tc")))
def w6(spark, sf_dir):
    return _out(smooth.box_mean(dense(spark, sf_dir).select("scene", "t", "row", "col", "a"), ["scene", "t"], "a", (3, 5)), "a")


_GAUSS = smooth_sql("a", "CASE WHEN any_value(d.a) IS NOT NULL THEN " + r("sum(tr.w * tc.w * b.a) / nullif(sum(CASE WHEN b.a IS NOT NULL THEN tr.w * tc.w END), 0)", "x").rsplit(" AS ", 1)[0] + " END AS a")


@query("w7_gaussian_nan", with_("slc amp", _GAUSS, DENSE, taps_sql(smooth.gaussian_taps(0.8), "tr"), taps_sql(smooth.gaussian_taps(1.1), "tc")))
def w7(spark, sf_dir):
    return _out(smooth.gaussian(dense(spark, sf_dir).select("scene", "t", "row", "col", "a"), ["scene", "t"], "a", (0.8, 1.1)), "a")


_ONE = "coalesce(atan2(b.im, b.re), 0)"
_COR = smooth_sql("a", f"CASE WHEN any_value(d.re) IS NULL THEN NULL ELSE round(least(greatest(sqrt(sum(CASE WHEN b.scene IS NOT NULL THEN tr.w * tc.w * cos({_ONE}) END) ^ 2 + sum(CASE WHEN b.scene IS NOT NULL THEN tr.w * tc.w * sin({_ONE}) END) ^ 2) / sum(CASE WHEN b.scene IS NOT NULL THEN tr.w * tc.w END), 0), 1), 6) + 0.0 END AS correlation")


@query("w8_correlation", with_("slc amp", _COR, DENSE, taps_sql(smooth.gaussian_taps(1.0), "tr"), taps_sql(smooth.gaussian_taps(5 / 3), "tc")))
def w8(spark, sf_dir):
    return _out(smooth.correlation(dense(spark, sf_dir), ["scene", "t"], (3, 5)), "correlation")


@query("w9_blocks", "SELECT p_partkey, CAST(r AS INT) AS r0, CAST(least(r + 20, 101) AS INT) AS r1, CAST(c AS INT) AS c0, CAST(least(c + 30, 90 + p_size) AS INT) AS c1 FROM part, range(0, 101, 16) AS a(r), range(0, 140, 25) AS b(c) WHERE (r = 0 OR r + 4 < 101) AND (c = 0 OR c + 5 < 90 + p_size)")
def w9(spark, sf_dir):
    """Overlapping blocks of an image per part, whose width follows the part."""
    from fringeflow.plans.scans import table

    sizes = table(spark, sf_dir, "part").select("p_partkey", (90 + F.col("p_size")).alias("cols"))
    plans = {w: grid.block_ranges((101, w), (20, 30), (4, 5)) for w in range(91, 141)}
    blocks = spark.createDataFrame([(w, *b) for w, found in plans.items() for b in found], "cols int, r0 int, r1 int, c0 int, c1 int")
    # 50 widths: a table of fixed size.
    return sizes.join(F.broadcast(blocks), "cols").drop("cols")


@query("w10_strided_blocks", with_("slc amp", f'SELECT scene, t, CAST("row" // 3 AS INT) AS "row", CAST(col // 2 AS INT) AS col, {r("avg(a)", "value")} FROM amp WHERE "row" // 3 BETWEEN 1 AND 3 AND col // 2 BETWEEN 1 AND 3 GROUP BY scene, t, "row" // 3, col // 2'))
def w10(spark, sf_dir):
    """Looks of the planned cores: outputs without a full window aren't planned."""
    inside = grid.in_cores(amplitude(spark, sf_dir), grid.strided_blocks((ROWS, COLS), (6, 4), (3, 2), (4, 2)))
    return _out(grid.take_looks(inside.select("scene", "t", "row", "col", "value"), 3, 2, {"value": "mean"}, ["scene", "t"]), "value")


@query("t1_sort_by_date", with_("slc dates", "SELECT scene, t, CAST(row_number() OVER (PARTITION BY scene ORDER BY dt, t) AS INT) AS place FROM dates"))
def t1(spark, sf_dir):
    from pyspark.sql import Window

    return dates(spark, sf_dir).select("scene", "t", F.row_number().over(Window.partitionBy("scene").orderBy("dt", "t")).alias("place"))


@query("t2_brightest_ps", with_("slc amp stats", 'SELECT scene, CAST(r AS INT) AS "row", CAST(c AS INT) AS col, "row" AS ps_row, col AS ps_col FROM (SELECT *, "row" // 4 AS r, col // 3 AS c, row_number() OVER (PARTITION BY scene, "row" // 4, col // 3 ORDER BY mean DESC, "row", col) AS k FROM stats WHERE dispersion < 0.4 AND dispersion > 0 AND col < 9) WHERE k = 1'))
def t2(spark, sf_dir):
    return ps.brightest(stats(spark, sf_dir).filter("ps"), 4, 3, ["scene"], (ROWS, COLS))


@query("t3_sorted_amplitudes", with_("slc amp", f"SELECT {PX}, CAST(row_number() OVER (PARTITION BY {PX} ORDER BY a) - 1 AS INT) AS place, {r('a', 'value')} FROM amp"))
def t3(spark, sf_dir):
    listed = amplitude(spark, sf_dir).groupBy(*KEYS).agg(F.sort_array(F.collect_list("value")).alias("v"))
    return _out(listed.select(*KEYS, F.posexplode("v").alias("place", "value")), "value")


@query("t7_newest_compressed", with_("slc dates", "SELECT scene, CAST(max(t) AS INT) AS end_t, CAST(arg_max(t0, t) AS INT) AS start_t FROM (SELECT scene, t, t - t % 3 AS t0 FROM dates) GROUP BY scene"))
def t7(spark, sf_dir):
    ranges = dates(spark, sf_dir).select("scene", "t", (F.col("t") - F.col("t") % 3).alias("t0"))
    return ranges.groupBy("scene").agg(F.max("t").alias("end_t"), F.max_by("t0", "t").alias("start_t"))


@query("k14_decimate", with_("slc amp", f'SELECT scene, t, CAST(("row" - 2) // 4 AS INT) AS "row", CAST((col - 1) // 3 AS INT) AS col, {r("a", "value")} FROM amp WHERE "row" % 4 = 2 AND col % 3 = 1 AND col < 9'))
def k14(spark, sf_dir):
    return _out(grid.decimate(amplitude(spark, sf_dir), 4, 3, (ROWS, COLS)), "value")


_FILL = """
points AS (SELECT *, "row" // 4 AS r, col // 3 AS c FROM stats WHERE dispersion > 0 AND dispersion < 0.4 AND col < 9),
best AS (SELECT scene, r, c, arg_max("row", (mean, -"row", -col)) AS br, arg_max(col, (mean, -"row", -col)) AS bc FROM points GROUP BY ALL),
looked AS (SELECT scene, t, "row" // 4 AS r, col // 3 AS c, sum(re) AS re, sum(im) AS im FROM slc WHERE col < 9 GROUP BY ALL)
"""


def _fill_sql(source: str) -> str:
    turned = "atan2(p.im * q.re - p.re * q.im, p.re * q.re + p.im * q.im)"
    return with_(
        "slc amp stats",
        f'SELECT l.scene, l.t, CAST(l.r AS INT) AS "row", CAST(l.c AS INT) AS col, {r(f"CASE WHEN p.re IS NOT NULL AND q.re IS NOT NULL THEN sqrt(l.re * l.re + l.im * l.im) * cos({turned}) ELSE l.re END", "re", 4)}, {r(f"CASE WHEN p.re IS NOT NULL AND q.re IS NOT NULL THEN sqrt(l.re * l.re + l.im * l.im) * sin({turned}) ELSE l.im END", "im", 4)}, CASE WHEN p.re IS NOT NULL AND q.re IS NOT NULL THEN 1.0 ELSE 0.5 END AS temp_coh FROM looked l LEFT JOIN chosen p ON p.scene = l.scene AND p.t = l.t AND p.r = l.r AND p.c = l.c LEFT JOIN chosen q ON q.scene = l.scene AND q.t = 0 AND q.r = l.r AND q.c = l.c',
        _FILL, source,
    )


def _filled(spark, sf_dir, mode):
    stack = slc(spark, sf_dir)
    looked = grid.take_looks(stack, 4, 3, {"re": "sum", "im": "sum"}, ["scene", "t"], (ROWS, COLS)).withColumn("temp_coh", F.lit(0.5))
    out = ps.filled(looked, stack, stats(spark, sf_dir), 4, 3, (ROWS, COLS), 0, mode)
    return _out(out, "re", "im", digits=4).select("scene", "t", "row", "col", "re", "im", "temp_coh")


@query("k13_ps_fill_max", _fill_sql('chosen AS (SELECT s.scene, s.t, b.r, b.c, s.re, s.im FROM best b JOIN slc s ON s.scene = b.scene AND s."row" = b.br AND s.col = b.bc)'))
def k13_max(spark, sf_dir):
    return _filled(spark, sf_dir, "max")


@query("k13_ps_fill_avg", _fill_sql('chosen AS (SELECT s.scene, s.t, p.r, p.c, sum(s.re) AS re, sum(s.im) AS im FROM points p JOIN slc s ON s.scene = p.scene AND s."row" = p."row" AND s.col = p.col GROUP BY ALL)'))
def k13_avg(spark, sf_dir):
    return _filled(spark, sf_dir, "avg")


_COMP = """
linked AS (SELECT scene, t, "row" // 4 AS r, col // 3 AS c, cos(atan2(sum(im), sum(re))) AS re, sin(atan2(sum(im), sum(re))) AS im FROM slc WHERE col < 9 GROUP BY scene, t, "row" // 4, col // 3),
turned AS (SELECT a.scene, a.t, a.r, a.c, a.re * b.re + a.im * b.im AS re, a.im * b.re - a.re * b.im AS im FROM linked a JOIN linked b ON a.scene = b.scene AND a.r = b.r AND a.c = b.c AND b.t = 1 WHERE a.t >= 2),
summed AS (SELECT s.scene, s."row", s.col, sum(s.re * l.re + s.im * l.im) AS re, sum(s.im * l.re - s.re * l.im) AS im FROM slc s LEFT JOIN turned l ON l.scene = s.scene AND l.t = s.t AND l.r = s."row" // 4 AND l.c = s.col // 3 WHERE s.t >= 2 GROUP BY ALL)
"""


@query("k15_compress", with_("slc amp stats", f'SELECT u.scene, u."row", u.col, {r("s.mean * cos(CASE WHEN u.re <> 0 OR u.im <> 0 THEN atan2(u.im, u.re) END)", "re", 4)}, {r("s.mean * sin(CASE WHEN u.re <> 0 OR u.im <> 0 THEN atan2(u.im, u.re) END)", "im", 4)} FROM summed u JOIN stats s USING (scene, "row", col)', _COMP))
def k15(spark, sf_dir):
    stack = slc(spark, sf_dir)
    looked = grid.take_looks(stack, 4, 3, {"re": "sum", "im": "sum"}, ["scene", "t"], (ROWS, COLS))
    linked = looked.select("scene", "t", "row", "col", F.cos(F.atan2("im", "re")).alias("re"), F.sin(F.atan2("im", "re")).alias("im"))
    return _out(ps.compressed(stack, linked, stats(spark, sf_dir), 4, 3, first_real=2, reference=1), "re", "im", digits=4)


SPIRAL = grid.disk(4, spiral=True)
_INT = """
z AS (SELECT scene, t, "row", col, re, im, a, p, (re + 100) / 200 AS w FROM amp),
k AS (SELECT * FROM (SELECT a.scene, a.t, a."row", a.col, o.dr * o.dr + o.dc * o.dc AS r2, o.rank, b.p AS q, row_number() OVER (PARTITION BY a.scene, a.t, a."row", a.col ORDER BY o.rank) AS n FROM z a CROSS JOIN offsets o JOIN z b ON b.scene = a.scene AND b.t = a.t AND b."row" = a."row" + o.dr AND b.col = a.col + o.dc WHERE a.w < 0.5 AND b.w >= 0.5) WHERE n <= 4),
n AS (SELECT *, pow(arg_max(r2, rank) OVER (PARTITION BY scene, t, "row", col ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0.75) / 2 AS norm FROM k),
f AS (SELECT scene, t, "row", col, atan2(sum(exp(-r2 / norm) * sin(q)), sum(exp(-r2 / norm) * cos(q))) AS phase FROM n GROUP BY ALL)
"""


@query("x4_interpolate", with_("slc amp", f'SELECT z.scene, z.t, z."row", z.col, {r("CASE WHEN w >= 0.5 THEN re ELSE a * cos(coalesce(phase, 0)) END", "re", 4)}, {r("CASE WHEN w >= 0.5 THEN im ELSE a * sin(coalesce(phase, 0)) END", "im", 4)} FROM z LEFT JOIN f USING (scene, t, "row", col)', offsets(SPIRAL), _INT))
def x4(spark, sf_dir):
    rows = slc(spark, sf_dir).withColumn("w", (F.col("re") + 100) / 200)
    return _out(interp.interpolated(rows, ["scene", "t"], "w", 0.5, 4, 4), "re", "im", digits=4).select("scene", "t", "row", "col", "re", "im")


@query("x5_ambiguity_fill", with_("slc amp", f'SELECT u.scene, u.t, u."row", u.col, {r("coalesce(unw, p + 2 * pi() * n)", "unw", 4)} FROM u LEFT JOIN (SELECT * FROM (SELECT g.scene, g.t, g."row", g.col, round_even((b.unw - b.p) / (2 * pi()), 0) AS n, row_number() OVER (PARTITION BY g.scene, g.t, g."row", g.col ORDER BY (g."row" - b."row")^2 + (g.col - b.col)^2, b."row", b.col) AS k FROM u g JOIN u b ON b.scene = g.scene AND b.t = g.t AND b.unw IS NOT NULL WHERE g.unw IS NULL) WHERE k = 1) f USING (scene, t, "row", col)', 'u AS (SELECT scene, t, "row", col, p, CASE WHEN a > 40 THEN p + 2 * pi() * floor(a / 25) END AS unw FROM amp)'))
def x5(spark, sf_dir):
    import math

    rows = slc(spark, sf_dir).select("scene", "t", "row", "col", angle(cx()).alias("phase"), F.sqrt(F.col("re") ** 2 + F.col("im") ** 2).alias("a"))
    unw = rows.withColumn("unw", F.when(F.col("a") > 40, F.col("phase") + F.lit(2 * math.pi) * F.floor(F.col("a") / 25)))
    return _out(interp.filled_ambiguities(unw, ["scene", "t"], reach=8), "unw", digits=4)


@query("x6_disk_offsets", "SELECT p_partkey, count(*) AS n FROM (SELECT p_partkey, 1 + p_size % 9 AS m, r.range AS dr, c.range AS dc FROM part, range(-9, 10) r, range(-9, 10) c) WHERE (dr <> 0 OR dc <> 0) AND greatest(abs(dr), abs(dc)) <= m AND greatest(abs(dr), abs(dc)) ^ 2 - greatest(abs(dr), abs(dc)) + least(abs(dr), abs(dc)) ^ 2 <= m * m GROUP BY p_partkey")
def x6(spark, sf_dir):
    """How many neighbours a disk of each part's radius has."""
    from fringeflow.plans.scans import table

    sizes = spark.createDataFrame([(m, len(grid.disk(m + 1))) for m in range(1, 10)], "m int, n long")
    return table(spark, sf_dir, "part").select("p_partkey", (1 + F.col("p_size") % 9).alias("m")).join(F.broadcast(sizes), "m").select("p_partkey", "n")


def _bilinear_sql():
    w = "(CASE WHEN b.a = 1 THEN y - floor(y) ELSE 1 - y + floor(y) END) * (CASE WHEN b.b = 1 THEN x - floor(x) ELSE 1 - x + floor(x) END)"
    return with_("slc amp", f'SELECT q.scene, q.id, {r("sum(w * s.v)", "value", 4)} FROM (SELECT pt.scene, id, CAST(floor(y) + b.a AS INT) AS yr, CAST(floor(x) + b.b AS INT) AS xc, {w} AS w FROM pt CROSS JOIN (SELECT p.v AS a, q.v AS b FROM (VALUES (0), (1)) p(v), (VALUES (0), (1)) q(v)) b) q JOIN (SELECT scene, "row", col, sum(a) AS v FROM amp GROUP BY ALL) s ON s.scene = q.scene AND s."row" = yr AND s.col = xc WHERE w > 0 GROUP BY q.scene, q.id', "pt AS (SELECT CAST(p_partkey % 12 AS INT) AS scene, p_partkey AS id, p_size / 4.0 AS y, p_retailprice / 300.0 AS x FROM part)")


@query("x7_bilinear_zoom", _bilinear_sql())
def x7(spark, sf_dir):
    from fringeflow.operators.geometry import bilinear
    from fringeflow.plans.scans import table

    points = table(spark, sf_dir, "part").select((F.col("p_partkey") % 12).cast("int").alias("scene"), F.col("p_partkey").alias("id"), (F.col("p_size") / 4.0).alias("y"), (F.col("p_retailprice") / 300.0).alias("x"))
    summed = amplitude(spark, sf_dir).groupBy(*KEYS).agg(F.sum("value").alias("value"))
    return _out(bilinear(points, summed, ["scene"], "value"), "value", digits=4)
