"""Element-wise expressions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from fringeflow.functions import scalars as S
from fringeflow.functions.cx import angle, conj, cx, magnitude, unit
from fringeflow.functions.scalars import rounded
from fringeflow.operators import coherence, geometry, interp, network, timeseries
from fringeflow.plans.catalog import query
from fringeflow.plans.scans import table
from fringeflow.plans.sql import r, with_
from fringeflow.sources.virtual import dates, slc

IFG = "ifg AS (SELECT p.scene, p.ref_t, p.sec_t, a.\"row\", a.col, a.re * b.re + a.im * b.im AS re, a.im * b.re - a.re * b.im AS im FROM pairs p JOIN slc a ON a.scene = p.scene AND a.t = p.ref_t JOIN slc b ON b.scene = p.scene AND b.t = p.sec_t AND b.\"row\" = a.\"row\" AND b.col = a.col WHERE p.sec_i - p.ref_i <= 1)"
PIX = 'scene, t, "row", col'


@query("p1_interferogram", with_("slc dates pairs", f'SELECT scene, ref_t, sec_t, "row", col, {r("re", digits=4)}, {r("im", digits=4)} FROM ifg', IFG))
def p1(spark, sf_dir):
    found = coherence.interferograms(slc(spark, sf_dir), network.by_bandwidth(dates(spark, sf_dir), 1))
    return found.withColumns({c: rounded(F.col(c), 4) for c in ("re", "im")})


@query("p2_conjugate", with_("slc", f"SELECT {PIX}, {r('re')}, {r('-im', 'im')} FROM slc"))
def p2(spark, sf_dir):
    turned = conj(cx())
    return slc(spark, sf_dir).select("scene", "t", "row", "col", rounded(turned.re).alias("re"), rounded(turned.im).alias("im"))


@query("p3_unit_phasor", with_("slc amp", f"SELECT {PIX}, {r('a')}, {r('cos(p)', 're')}, {r('sin(p)', 'im')} FROM amp"))
def p3(spark, sf_dir):
    one = unit(cx())
    return slc(spark, sf_dir).select("scene", "t", "row", "col", rounded(magnitude(cx())).alias("a"), rounded(one.re).alias("re"), rounded(one.im).alias("im"))


_REWRAP = "(x + pi() - 2 * pi() * floor((x + pi()) / (2 * pi())) - pi())"


@query("p4_rewrap", with_("slc", f"SELECT {PIX}, {r(_REWRAP, 'phase')} FROM (SELECT *, re / 7 AS x FROM slc)"))
def p4(spark, sf_dir):
    return slc(spark, sf_dir).select("scene", "t", "row", "col", rounded(S.rewrap(F.col("re") / 7)).alias("phase"))


@query("p5_ambiguity", with_("slc", f"SELECT {PIX}, round_even((x - {_REWRAP}) / (2 * pi()), 0) + 0.0 AS cycles FROM (SELECT *, re / 7 AS x FROM slc)"))
def p5(spark, sf_dir):
    return slc(spark, sf_dir).select("scene", "t", "row", "col", (S.ambiguity(F.col("re") / 7) + F.lit(0.0)).alias("cycles"))


@query("p6_transfer_ambiguities", with_("slc amp", f"SELECT {PIX}, {r('p + 2 * pi() * round_even((re / 7 - p) / (2 * pi()), 0)', 'unw')} FROM amp"))
def p6(spark, sf_dir):
    return slc(spark, sf_dir).select("scene", "t", "row", "col", rounded(S.transfer_ambiguity(angle(cx()), F.col("re") / 7)).alias("unw"))


@query("p7_corr_variance", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((1 - c * c) / (2 * 50 * c * c + 1e-6), 4) AS variance FROM (SELECT *, 0.05 + 9 * l_discount AS c FROM lineitem)")
def p7(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(S.phase_variance(0.05 + 9 * F.col("l_discount"), 50), 4).alias("variance"))


_LAMBDA = S.displacement_factor(S.SENTINEL_1_WAVELENGTH)


@query("p8_displacement", with_("slc amp", f"SELECT a.scene, a.t, a.\"row\", a.col, {r(f'(a.p - coalesce(b.p, 0)) * {_LAMBDA!r}', 'metres', 8)} FROM amp a LEFT JOIN amp b ON a.scene = b.scene AND a.t = b.t AND b.\"row\" = 5 AND b.col = 5"))
def p8(spark, sf_dir):
    phase = slc(spark, sf_dir).select("scene", "t", "row", "col", angle(cx()).alias("phase"))
    moved = timeseries.referenced(phase, 5, 5, keys=["scene", "t"])
    return moved.select("scene", "t", "row", "col", rounded(F.col("phase") * F.lit(_LAMBDA), 8).alias("metres"))


@query("p9_amplitude_variance", with_("slc amp stats", 'SELECT scene, "row", col, ' + r("dispersion * mean * dispersion * mean", "var") + " FROM stats"))
def p9(spark, sf_dir):
    from fringeflow.operators.ps import amplitude_stats

    found = amplitude_stats(slc(spark, sf_dir), ["scene", "row", "col"])
    return found.select("scene", "row", "col", rounded(S.amplitude_variance(F.col("dispersion"), F.col("mean"))).alias("var"))


@query("p10_regularise", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN g < 0.355 THEN 0.0 ELSE round(g, 6) END AS gamma FROM (SELECT *, (1 - 0.1) * (l_discount * 10) AS g FROM lineitem)")
def p10(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(coherence.regularised(F.col("l_discount") * 10, 0.1, 0.355), 6).alias("gamma"))


_RATIO = S.EARTH_RADIUS / (S.EARTH_RADIUS + S.SHELL_HEIGHT)
_BEND = S.K_IONO * S.TEC_UNIT / S.SENTINEL_1_WAVELENGTH**-2 / 299792458.0**2


@query("p12_iono_incidence", f"SELECT p_partkey, round(degrees(asin({_RATIO!r} * sin(radians(20.0 + p_size % 30)))), 6) AS incidence FROM part")
def p12(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(S.shell_incidence(20.0 + F.col("p_size") % 30), 6).alias("incidence"))


_F = 5.405e9
_K = S.K_IONO * S.TEC_UNIT / _F**2


@query("p13_tec_delay", f"SELECT p_partkey, round(tec / cos(asin(sin(radians(nullif(inc, 0))) / (1 + {_K!r} * tec))) * {_K!r}, 6) AS delay FROM (SELECT p_partkey, p_retailprice / 50.0 AS tec, 1.0 * (p_size % 45) AS inc FROM part)")
def p13(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(S.range_delay(F.col("p_retailprice") / 50.0, 1.0 * (F.col("p_size") % 45), _F), 6).alias("delay"))


@query("p14_los_incidence", "SELECT p_partkey, round(acos(sqrt(1 - e * e - n * n)), 6) AS incidence FROM (SELECT p_partkey, 0.3 + p_size / 200.0 AS e, 0.1 - p_size / 500.0 AS n FROM part)")
def p14(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(S.incidence_of_los(0.3 + F.col("p_size") / 200.0, 0.1 - F.col("p_size") / 500.0), 6).alias("incidence"))


@query(
    "p15_perp_baseline",
    "WITH v AS (SELECT p_partkey, 7.0e6 AS sx, 0.0 AS sy, 0.0 AS sz, 7.0e6 + p_size AS bx, 10.0 * p_size - 150 AS b_y, 40.0 AS bz, 6.378e6 AS tx, 6.0e5 + p_retailprice AS ty, 1000.0 AS tz FROM part), "
    "d AS (SELECT *, sqrt((tx - sx)^2 + (ty - sy)^2 + (tz - sz)^2) AS r1, sqrt((tx - bx)^2 + (ty - b_y)^2 + (tz - bz)^2) AS r2, sqrt((bx - sx)^2 + (b_y - sy)^2 + (bz - sz)^2) AS b FROM v), "
    "c AS (SELECT *, (r1 * r1 + b * b - r2 * r2) / (2 * r1 * b) AS k FROM d) "
    "SELECT p_partkey, round(sign(((ty - sy) * (bz - sz) - (tz - sz) * (b_y - sy)) * 0 + ((tz - sz) * (bx - sx) - (tx - sx) * (bz - sz)) * 0 + ((tx - sx) * (b_y - sy) - (ty - sy) * (bx - sx)) * 7500) * b * sqrt(greatest(1 - k * k, 0)), 4) AS baseline FROM c",
)
def p15(spark, sf_dir):
    ref = (F.lit(7.0e6), F.lit(0.0), F.lit(0.0))
    sec = (7.0e6 + F.col("p_size"), 10.0 * F.col("p_size") - 150, F.lit(40.0))
    target = (F.lit(6.378e6), 6.0e5 + F.col("p_retailprice"), F.lit(1000.0))
    away = lambda a: F.sqrt(sum((x - y) ** 2 for x, y in zip(target, a, strict=True)))
    found = geometry.perpendicular_baseline(target, ref, sec, away(ref), away(sec), (F.lit(0.0), F.lit(0.0), F.lit(7500.0)))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(found, 4).alias("baseline"))


@query("p17_dates", with_("slc dates pairs", "SELECT scene, ref_t, sec_t, CAST(date_diff('day', ref_dt, sec_dt) AS DOUBLE) AS days, strftime(ref_dt, '%Y%m%d') || '_' || strftime(sec_dt, '%Y%m%d') AS name FROM pairs"))
def p17(spark, sf_dir):
    found = dates(spark, sf_dir)
    a = found.select("scene", F.col("t").alias("ref_t"), F.col("dt").alias("ref_dt"))
    b = found.select("scene", F.col("t").alias("sec_t"), F.col("dt").alias("sec_dt"))
    both = a.join(b, "scene").filter("ref_t < sec_t")
    return both.select("scene", "ref_t", "sec_t", S.days_between(F.col("sec_dt").cast("timestamp"), F.col("ref_dt").cast("timestamp")).alias("days"), S.pair_name(F.col("ref_dt"), F.col("sec_dt")).alias("name"))


@query("p18_strings", "SELECT page_id, coalesce(regexp_extract(string_split(url, '/')[-1], '(\\..*)$', 1), '') AS suffix, regexp_extract('x/slc_' || regexp_replace(url, '[^a-z]', '', 'g') || '20220101.tif', '^(.*?)[0-9]{8}', 1) AS prefix, regexp_replace(replace(url, '://', ':/'), '^(https?):/+', '\\1://') AS url FROM pages")
def p18(spark, sf_dir):
    name = F.concat(F.lit("x/slc_"), F.regexp_replace("url", "[^a-z]", ""), F.lit("20220101.tif"))
    return table(spark, sf_dir, "pages").select("page_id", S.full_suffix(F.col("url")).alias("suffix"), S.prefix_before_date(name).alias("prefix"), S.repaired_url(F.replace("url", F.lit("://"), F.lit(":/"))).alias("url"))


@query("p19_filter_sigma", f"SELECT p_partkey, round(p_retailprice * 10 * {math.sqrt(-math.log(0.5)) / (math.sqrt(2) * math.pi)!r} / 30.0, 6) AS sigma FROM part")
def p19(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(F.col("p_retailprice") * 10 * F.lit(S.gaussian_sigma(1.0, 30.0)), 6).alias("sigma"))


@query("p20_argmax", with_("slc amp", 'SELECT scene, t, m["row"] AS max_row, m.col AS max_col, n["row"] AS min_row, n.col AS min_col FROM (SELECT scene, t, arg_max({"row": "row", col: col}, {a: a, b: -"row", c: -col}) AS m, arg_min({"row": "row", col: col}, {a: a, b: "row", c: col}) AS n FROM amp GROUP BY ALL)'.replace('m["row"]', "m['row']").replace('n["row"]', "n['row']")))
def p20(spark, sf_dir):
    rows = slc(spark, sf_dir).select("scene", "t", "row", "col", magnitude(cx()).alias("a"))
    most = interp.extreme_index(rows, ["scene", "t"], "a").withColumnsRenamed({"row": "max_row", "col": "max_col"})
    least = interp.extreme_index(rows, ["scene", "t"], "a", False).withColumnsRenamed({"row": "min_row", "col": "min_col"})
    return most.join(least, ["scene", "t"])
