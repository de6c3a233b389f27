"""Reductions over time, looks and windows."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from fringeflow.functions.cx import angle, cx, magnitude
from fringeflow.functions.scalars import rounded
from fringeflow.operators import coherence, grid, mosaic, network, ps, timeseries
from fringeflow.plans.catalog import query
from fringeflow.plans.scans import amplitude, table
from fringeflow.plans.sql import offsets, r, with_
from fringeflow.sources.virtual import COLS, DATES, ROWS, dates, slc, vectors

KEYS = ["scene", "row", "col"]
PX = 'scene, "row", col'
THR = 0.4
#: Masks in files are 0 and 1, with 255 for nodata.
_PS = f"CASE WHEN dispersion > 0 THEN dispersion < {THR} END"


def byte(flag):
    return F.coalesce(flag.cast("int"), F.lit(255))


def byte_sql(flag: str) -> str:
    return f"coalesce(CAST({flag} AS INT), 255)"



def stats(spark, sf_dir, min_count=None):
    return ps.amplitude_stats(slc(spark, sf_dir), KEYS, THR, min_count)


def _out(df, *columns, digits=6):
    return df.withColumns({c: rounded(F.col(c), digits) for c in columns})


@query("a1_ps_block", with_("slc amp stats", f"SELECT {PX}, n, {r('mean')}, CASE WHEN n >= 6 THEN {r('dispersion', 'd').rsplit(' AS ', 1)[0]} END AS dispersion, {byte_sql(f'CASE WHEN n >= 6 AND dispersion > 0 THEN dispersion < {THR} END')} AS ps FROM stats"))
def a1(spark, sf_dir):
    return _out(stats(spark, sf_dir, 6), "mean", "dispersion").withColumn("ps", byte(F.col("ps")))


@query("a2_ps_all_dates", with_("slc amp stats", f"SELECT {PX}, {r('mean')}, {r('dispersion')}, {byte_sql(_PS)} AS ps FROM stats WHERE n = {DATES}"))
def a2(spark, sf_dir):
    whole = stats(spark, sf_dir, DATES).filter("dispersion IS NOT NULL")
    return _out(whole, "mean", "dispersion").drop("n").withColumn("ps", byte(F.col("ps")))


@query("a3_ps_from_dispersion", with_("slc amp stats", f"SELECT {PX}, {r('dispersion')}, {byte_sql('CASE WHEN dispersion > 0 THEN dispersion < 0.55 END')} AS ps FROM stats"))
def a3(spark, sf_dir):
    return _out(ps.from_dispersion(stats(spark, sf_dir).drop("ps", "mean", "n"), 0.55), "dispersion").withColumn("ps", byte(F.col("ps")))


def _parts(spark, sf_dir):
    stack = slc(spark, sf_dir).withColumn("part", F.floor(F.col("t") / 3))
    return ps.amplitude_stats(stack, [*KEYS, "part"])


@query("a4_combine_means", with_("slc amp stats", f"SELECT {PX}, n, {r('mean')} FROM stats"))
def a4(spark, sf_dir):
    return _out(ps.combined(_parts(spark, sf_dir), KEYS).drop("dispersion"), "mean")


@query("a5_combine_dispersion", with_("slc amp stats", f"SELECT {PX}, {r('dispersion')} FROM stats WHERE n > 1"))
def a5(spark, sf_dir):
    return _out(ps.combined(_parts(spark, sf_dir), KEYS).filter("n > 1").select(*KEYS, "dispersion"), "dispersion")


def _looks(name, how, expression, edge="cutoff"):
    where = "WHERE col < 9" if edge == "cutoff" else ""
    boolean = how in ("any", "all")
    value = f"{expression} AS value" if boolean else r(expression, "value", 4)

    @query(name, with_("slc amp", f'SELECT scene, t, CAST("row" // 4 AS INT) AS "row", CAST(col // 3 AS INT) AS col, {value} FROM amp {where} GROUP BY scene, t, "row" // 4, col // 3'))
    def run(spark, sf_dir):
        rows = amplitude(spark, sf_dir)
        rows = rows.withColumn("value", F.col("value") > 80) if boolean else rows
        out = grid.take_looks(rows, 4, 3, {"value": how}, ["scene", "t"], (ROWS, COLS), edge)
        return out if boolean else _out(out, "value", digits=4)


_looks("a6_looks_sum", "sum", "sum(a)")
_looks("a6_looks_mean", "mean", "avg(a)")
_looks("a6_looks_min", "min", "min(a)")
_looks("a6_looks_median", "median", "median(a)")
_looks("a6_looks_any", "any", "bool_or(a > 80)")
_looks("a6_looks_all", "all", "bool_and(a > 80)")
_looks("a6_looks_pad", "mean", "avg(a)", "pad")


@query("a7_ps_looked", with_("slc amp stats", f'SELECT scene, CAST("row" // 4 AS INT) AS "row", CAST(col // 5 AS INT) AS col, {byte_sql(f'bool_or({_PS})')} AS ps, {r("min(dispersion)", "dispersion")} FROM stats GROUP BY scene, "row" // 4, col // 5'))
def a7(spark, sf_dir):
    """The flagship: amplitude statistics, persistent scatterers and their looks."""
    return _out(ps.looked(stats(spark, sf_dir), 4, 5, ["scene"], (ROWS, COLS)), "dispersion").withColumn("ps", byte(F.col("ps")))


WIN = grid.rectangle(1, 1)
COH = (
    'cells AS (SELECT a.scene, a."row", a.col, b.t, b.re, b.im FROM (SELECT DISTINCT scene, "row", col FROM slc) a CROSS JOIN offsets o JOIN slc b ON b.scene = a.scene AND b."row" = a."row" + o.dr AND b.col = a.col + o.dc), '
)


def coh_sql(source: str = "slc", centre: str = 'SELECT DISTINCT scene, "row", col FROM slc', row: str = 'a."row" + o.dr', col: str = "a.col + o.dc", extra: str = "") -> str:
    """coh (scene, row, col, i, j, re, im) from windows of the offsets around the centres."""
    return (
        f'members AS (SELECT a.scene, a."row", a.col, {row} AS mr, {col} AS mc FROM ({centre}) a CROSS JOIN offsets o {extra}), '
        f'power AS (SELECT m.scene, m."row", m.col, b.t, sum(b.re * b.re + b.im * b.im) AS w FROM members m JOIN {source} b ON b.scene = m.scene AND b."row" = mr AND b.col = mc GROUP BY ALL), '
        f'crossed AS (SELECT m.scene, m."row", m.col, b.t AS i, c.t AS j, sum(b.re * c.re + b.im * c.im) AS re, sum(b.im * c.re - b.re * c.im) AS im FROM members m JOIN {source} b ON b.scene = m.scene AND b."row" = mr AND b.col = mc JOIN {source} c ON c.scene = m.scene AND c."row" = mr AND c.col = mc AND c.t > b.t GROUP BY ALL), '
        'coh AS (SELECT x.scene, x."row", x.col, i, j, CASE WHEN sqrt(p.w * q.w) > 1e-6 THEN x.re / sqrt(p.w * q.w) ELSE 0.0 END AS re, CASE WHEN sqrt(p.w * q.w) > 1e-6 THEN x.im / sqrt(p.w * q.w) ELSE 0.0 END AS im '
        'FROM crossed x JOIN power p ON p.scene = x.scene AND p."row" = x."row" AND p.col = x.col AND p.t = i JOIN power q ON q.scene = x.scene AND q."row" = x."row" AND q.col = x.col AND q.t = j)'
    )


COH_SELECT = f"SELECT {PX}, i, j, {r('re')}, {r('im')} FROM coh"


def packed(spark, sf_dir):
    return coherence.packed_matrix(slc(spark, sf_dir), WIN)


def matrix(spark, sf_dir):
    return coherence.unpacked(packed(spark, sf_dir))


@query("a8_coherence", with_("slc", COH_SELECT, offsets(WIN), coh_sql()))
def a8(spark, sf_dir):
    return _out(matrix(spark, sf_dir), "re", "im")


_STRIDED = coh_sql(centre='SELECT DISTINCT scene, CAST("row" // 4 AS INT) AS "row", CAST(col // 5 AS INT) AS col FROM slc', row='a."row" * 4 + 2 + o.dr', col="a.col * 5 + 2 + o.dc")


@query("a9_coherence_strided", with_("slc", COH_SELECT, offsets(grid.rectangle(2, 3)), _STRIDED))
def a9(spark, sf_dir):
    return _out(coherence.coherence_matrix(slc(spark, sf_dir), grid.rectangle(2, 3), (4, 5)), "re", "im")


@query("p11_lag_mask", with_("slc", f"SELECT {PX}, i, j, CASE WHEN j - i < 3 THEN {r('re').rsplit(' AS ', 1)[0]} ELSE 0.0 END AS re, CASE WHEN j - i < 3 THEN {r('im').rsplit(' AS ', 1)[0]} ELSE 0.0 END AS im FROM coh", offsets(WIN), coh_sql()))
def p11(spark, sf_dir):
    return _out(coherence.lagged(matrix(spark, sf_dir), 3), "re", "im")


@query("a10_temporal_average", with_("slc amp", f"SELECT {PX}, {r('median(a)', 'value')} FROM amp GROUP BY ALL"))
def a10(spark, sf_dir):
    return _out(timeseries.temporal_average(amplitude(spark, sf_dir), "value", "median"), "value")


@query("ud2_axis_reducer", with_("slc amp", f"SELECT {PX}, {r('max(a)', 'value')} FROM amp GROUP BY ALL"))
def ud2(spark, sf_dir):
    """Another reducer along time, by name."""
    return _out(timeseries.temporal_average(amplitude(spark, sf_dir), "value", "max"), "value")


_looks("ud4_looks_by_name", "nanmedian", "median(a)")


@query("a11_average_nonzero", with_("slc amp", f"SELECT {PX}, {r('avg(nullif(CASE WHEN a < 30 THEN 0 ELSE a END, 0))', 'value')} FROM amp GROUP BY ALL"))
def a11(spark, sf_dir):
    rows = amplitude(spark, sf_dir).withColumn("value", F.when(F.col("value") < 30, F.lit(0.0)).otherwise(F.col("value")))
    return _out(timeseries.temporal_average(rows, "value", zero_is_nodata=True), "value")


CONN = 'conn AS (SELECT p.scene, p.ref_t, p.sec_t, a."row", a.col, CASE WHEN a.a > 12 THEN CAST(floor(b.a / 12) AS INT) END AS label FROM pairs p JOIN amp a ON a.scene = p.scene AND a.t = p.ref_t JOIN amp b ON b.scene = p.scene AND b.t = p.sec_t AND b."row" = a."row" AND b.col = a.col WHERE p.sec_i - p.ref_i <= 2)'


def conncomps(spark, sf_dir):
    rows, edges = amplitude(spark, sf_dir), network.by_bandwidth(dates(spark, sf_dir), 2)
    a = rows.select("scene", F.col("t").alias("ref_t"), "row", "col", F.col("value").alias("a"))
    b = rows.select("scene", F.col("t").alias("sec_t"), "row", "col", F.col("value").alias("b"))
    both = a.join(edges, ["scene", "ref_t"]).join(b, ["scene", "sec_t", "row", "col"])
    return both.select("scene", "ref_t", "sec_t", "row", "col", F.when(F.col("a") > 12, F.floor(F.col("b") / 12).cast("int")).alias("label"))


@query("a12_conncomp_intersection", with_("slc amp dates pairs", f"SELECT {PX}, {byte_sql('CASE WHEN NOT bool_or(label IS NULL) THEN bool_and(label > 0) END')} AS inside FROM conn GROUP BY ALL", CONN))
def a12(spark, sf_dir):
    return timeseries.component_intersection(conncomps(spark, sf_dir)).withColumn("inside", byte(F.col("inside")))


@query("a13_valid_counts", with_("slc amp dates pairs", f"SELECT {PX}, t, CAST(sum(v) AS BIGINT) AS n FROM (SELECT {PX}, ref_t AS t, CAST(coalesce(label, 0) <> 0 AS INT) AS v FROM conn UNION ALL SELECT {PX}, sec_t, CAST(coalesce(label, 0) <> 0 AS INT) FROM conn) GROUP BY ALL", CONN))
def a13(spark, sf_dir):
    return timeseries.valid_counts(conncomps(spark, sf_dir))


_PHASES = 'lp AS (SELECT scene, t, "row", col, p AS phase FROM amp)'


def _temp_coh(weight):
    return f'SELECT {PX}, {r("coalesce(sqrt(c * c + s * s) / nullif(w, 0), 0)", "temp_coh")} FROM (SELECT {PX}, sum(w) AS w, sum(w * cos(d)) AS c, sum(w * sin(d)) AS s FROM (SELECT c.scene, c."row", c.col, {weight} AS w, atan2(c.im, c.re) - (a.phase - b.phase) AS d FROM coh c JOIN lp a ON a.scene = c.scene AND a.t = i AND a."row" = c."row" AND a.col = c.col JOIN lp b ON b.scene = c.scene AND b.t = j AND b."row" = c."row" AND b.col = c.col) GROUP BY ALL)'


def linked_phases(spark, sf_dir):
    return slc(spark, sf_dir).select("scene", "t", "row", "col", angle(cx()).alias("phase"))


@query("a16_temp_coh", with_("slc amp", _temp_coh("1.0"), _PHASES, offsets(WIN), coh_sql()))
def a16(spark, sf_dir):
    return _out(coherence.temporal_coherence(packed(spark, sf_dir), linked_phases(spark, sf_dir)), "temp_coh")


@query("a16_temp_coh_weighted", with_("slc amp", _temp_coh("sqrt(c.re * c.re + c.im * c.im)"), _PHASES, offsets(WIN), coh_sql()))
def a16_weighted(spark, sf_dir):
    return _out(coherence.temporal_coherence(packed(spark, sf_dir), linked_phases(spark, sf_dir), True), "temp_coh")


DISK = grid.disk(3)
_SIM = 'SELECT a.scene, a."row", a.col, m(s) AS similarity FROM (SELECT a.scene, a."row", a.col, o.rank, avg(cos(a.p - b.p)) AS s FROM amp a CROSS JOIN offsets o JOIN amp b ON b.scene = a.scene AND b.t = a.t AND b."row" = a."row" + o.dr AND b.col = a.col + o.dc GROUP BY ALL) a GROUP BY ALL'


@query("a17_similarity_median", with_("slc amp", _SIM.replace("m(s) AS similarity", r("median(s)", "similarity")), offsets(DISK)))
def a17_median(spark, sf_dir):
    return _out(coherence.similarity(slc(spark, sf_dir), DISK), "similarity")


@query("a17_similarity_max", with_("slc amp", _SIM.replace("m(s) AS similarity", r("max(s)", "similarity")), offsets(DISK)))
def a17_max(spark, sf_dir):
    return _out(coherence.similarity(slc(spark, sf_dir), DISK, "max"), "similarity")


_DIFF = 'amp2 AS (SELECT a.scene, a."row", a.col, a.t * 1000 + b.t AS t, b.p - a.p AS p FROM amp a JOIN amp b ON a.scene = b.scene AND a."row" = b."row" AND a.col = b.col AND b.t > a.t AND b.t - a.t <= 2)'


@query("a18_nearest_n_similarity", with_("slc amp", _SIM.replace("m(s) AS similarity", r("median(s)", "similarity")).replace("FROM amp a", "FROM amp2 a").replace("JOIN amp b", "JOIN amp2 b"), _DIFF, offsets(DISK)))
def a18(spark, sf_dir):
    return _out(coherence.similarity(coherence.nearest_differences(linked_phases(spark, sf_dir), 2), DISK), "similarity")


@query("a17_vector_similarity", "SELECT label, count(*) AS n, round(avg(s), 6) AS similarity FROM (SELECT a.vec_id, a.label, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) GROUP BY label")
def a17_vectors(spark, sf_dir):
    """Cosines of vectors whose ids follow each other, over the long form of the whole table."""
    long = vectors(spark, sf_dir)
    later = long.select((F.col("id") - 1).alias("id"), "t", F.col("value").alias("next"))
    sums = long.join(later, ["id", "t"]).groupBy("id").agg(F.sum(F.col("value") * F.col("next")).alias("ab"), F.sum(F.col("value") ** 2).alias("aa"), F.sum(F.col("next") ** 2).alias("bb"))
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return sums.join(labels, "id").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))), 6).alias("similarity"))


@query("a22_rmse", with_("slc amp", f"SELECT a.scene, {r('sqrt(avg((a.a - b.a) ^ 2))', 'rmse')}, {r('sqrt(avg(atan2(sin(a.p - b.p), cos(a.p - b.p)) ^ 2))', 'angle_rmse')} FROM amp a JOIN amp b ON a.scene = b.scene AND a.\"row\" = b.\"row\" AND a.col = b.col AND b.t = a.t + 1 GROUP BY a.scene"))
def a22(spark, sf_dir):
    rows = slc(spark, sf_dir).select("scene", "t", "row", "col", magnitude(cx()).alias("a"), angle(cx()).alias("p"))
    later = rows.select("scene", (F.col("t") - 1).alias("t"), "row", "col", F.col("a").alias("a2"), F.col("p").alias("p2"))
    d = F.col("p") - F.col("p2")
    both = rows.join(later, ["scene", "t", "row", "col"])
    return both.groupBy("scene").agg(rounded(F.sqrt(F.avg((F.col("a") - F.col("a2")) ** 2))).alias("rmse"), rounded(F.sqrt(F.avg(F.atan2(F.sin(d), F.cos(d)) ** 2))).alias("angle_rmse"))


@query("a23_mode_projection", "SELECT g AS nation, CAST(arg_max(epsg, n * 100000 - epsg) AS INT) AS epsg FROM (SELECT c_nationkey AS g, 32601 + CAST(c_custkey % 7 AS INT) AS epsg, count(*) AS n FROM customer GROUP BY ALL) GROUP BY g")
def a23(spark, sf_dir):
    meta = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), (32601 + F.col("c_custkey") % 7).cast("int").alias("epsg"))
    return mosaic.mode_projection(meta, ["nation"])


@query("a24_bounds", "SELECT s_nationkey AS nation, floor(min(s_suppkey * 13 % 997) / 30.0) * 30 AS \"left\", floor(min(s_suppkey * 7 % 991) / 30.0) * 30 AS bottom, ceil(max(s_suppkey * 13 % 997 + 100) / 30.0) * 30 AS \"right\", ceil(max(s_suppkey * 7 % 991 + 50) / 30.0) * 30 AS top, count(*) AS images FROM supplier GROUP BY 1")
def a24(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier")
    x, y = (F.col("s_suppkey") * 13 % 997).cast("double"), (F.col("s_suppkey") * 7 % 991).cast("double")
    meta = rows.select(F.col("s_nationkey").alias("nation"), x.alias("left"), y.alias("bottom"), (x + 100).alias("right"), (y + 50).alias("top"), F.lit(5).alias("dx"), F.lit(10).alias("dy"))
    out = mosaic.combined_bounds(meta, ["nation"], (30.0, 30.0)).drop("resolutions")
    return out.withColumns({c: F.col(c).cast("double") for c in ("left", "bottom", "right", "top")})


CLOSURE = 'clo AS (SELECT a.scene, a."row", a.col, a.i, atan2((a.re * b.im + a.im * b.re) * c.re - (a.re * b.re - a.im * b.im) * c.im, (a.re * b.re - a.im * b.im) * c.re + (a.re * b.im + a.im * b.re) * c.im) AS closure FROM coh a JOIN coh b ON a.scene = b.scene AND a."row" = b."row" AND a.col = b.col AND b.i = a.i + 1 AND b.j = a.i + 2 JOIN coh c ON a.scene = c.scene AND a."row" = c."row" AND a.col = c.col AND c.i = a.i AND c.j = a.i + 2 WHERE a.j = a.i + 1)'


@query("w1_closure", with_("slc", f"SELECT {PX}, i, {r('closure')} FROM clo", offsets(WIN), coh_sql(), CLOSURE))
def w1(spark, sf_dir):
    return _out(coherence.closure_phases(packed(spark, sf_dir)), "closure")


_K = -0.0554658 / (4 * math.pi)


@query("a25_cumulative_closure", with_("slc", f"SELECT {PX}, i, {r(f'sum(closure) OVER (PARTITION BY {PX} ORDER BY i) * {_K!r}', 'cumulative', 8)} FROM clo", offsets(WIN), coh_sql(), CLOSURE))
def a25(spark, sf_dir):
    return _out(coherence.cumulative(coherence.closure_phases(packed(spark, sf_dir)), _K), "cumulative", digits=8)
