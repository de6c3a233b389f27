"""Network inversion, velocity, components and reference points."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from fringeflow.operators import interp, network, timeseries
from fringeflow.plans.aggregates import KEYS, PX, _out
from fringeflow.plans.catalog import query
from fringeflow.plans.scans import amplitude
from fringeflow.plans.sql import r, with_
from fringeflow.sources.virtual import DATES, dates

#: Pairs of places whose inverted matrix the oracle holds as constants; scenes with all dates use them.
NET = [(i, j) for i in range(DATES) for j in range(i + 1, min(DATES, i + 3))]


def _inverse() -> np.ndarray:
    return np.linalg.pinv(timeseries.matrix_of(NET))


def values_sql(rows: list[tuple], names: str) -> str:
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(repr(x) if not isinstance(x, float) else f"{x!r}::DOUBLE" for x in row) + ")" for row in rows) + f") AS v({names}))"


_PINV = "pinv AS " + values_sql([(a, b, i + 1, float(_inverse()[i, k])) for i in range(DATES - 1) for k, (a, b) in enumerate(NET)], "ref_t, sec_t, t, coef")
NET_SQL = "net AS " + values_sql(NET, "ref_t, sec_t")
UNW = 'unw AS (SELECT a.scene, n.ref_t, n.sec_t, a."row", a.col, (b.a - a.a) / 10 + 0.01 * (n.ref_t + n.sec_t) AS phase FROM net n JOIN amp a ON a.t = n.ref_t JOIN amp b ON b.t = n.sec_t AND b.scene = a.scene AND b."row" = a."row" AND b.col = a.col)'
SERIES = f'whole AS (SELECT {PX} FROM unw GROUP BY ALL HAVING count(*) = {len(NET)}), series AS (SELECT u.scene, u."row", u.col, p.t, sum(p.coef * u.phase) AS phase FROM unw u SEMI JOIN whole w ON u.scene = w.scene AND u."row" = w."row" AND u.col = w.col JOIN pinv p ON p.ref_t = u.ref_t AND p.sec_t = u.sec_t GROUP BY ALL)'


def unwrapped(spark, sf_dir):
    """An 'unwrapped' network whose phases are amplitude differences with a closure error, so that the inversion has residuals."""
    rows = amplitude(spark, sf_dir)
    edges = network.by_bandwidth(dates(spark, sf_dir), 2)
    a = rows.select("scene", F.col("t").alias("ref_t"), "row", "col", F.col("value").alias("a"))
    b = rows.select("scene", F.col("t").alias("sec_t"), "row", "col", F.col("value").alias("b"))
    both = a.join(edges, ["scene", "ref_t"]).join(b, ["scene", "sec_t", "row", "col"])
    return both.select("scene", "ref_t", "sec_t", "row", "col", ((F.col("b") - F.col("a")) / 10 + 0.01 * (F.col("ref_t") + F.col("sec_t"))).alias("phase")), edges


def solved(spark, sf_dir):
    unw, edges = unwrapped(spark, sf_dir)
    return timeseries.solved_networks(unw, edges.groupBy("scene").agg(F.count("*").alias("n")))


@query("k18_l2_inversion", with_("slc amp", f"SELECT {PX}, t, {r('phase')} FROM series", NET_SQL, _PINV, UNW, SERIES))
def k18(spark, sf_dir):
    return _out(timeseries.series_of(solved(spark, sf_dir)), "phase")


_RES = 'res AS (SELECT u.scene, u.ref_t, u.sec_t, u."row", u.col, coalesce(b.phase, 0) - coalesce(a.phase, 0) - u.phase AS residual FROM unw u SEMI JOIN whole w ON u.scene = w.scene AND u."row" = w."row" AND u.col = w.col LEFT JOIN series a ON a.scene = u.scene AND a."row" = u."row" AND a.col = u.col AND a.t = u.ref_t LEFT JOIN series b ON b.scene = u.scene AND b."row" = u."row" AND b.col = u.col AND b.t = u.sec_t)'


@query("j18_residuals", with_("slc amp", f"SELECT scene, ref_t, sec_t, \"row\", col, {r('residual')} FROM res", NET_SQL, _PINV, UNW, SERIES, _RES))
def j18(spark, sf_dir):
    return _out(timeseries.residuals_of(solved(spark, sf_dir)), "residual")


@query("a14_residuals_per_date", with_("slc amp", f"SELECT {PX}, t, {r('sum(v)', 'residual')} FROM (SELECT {PX}, ref_t AS t, abs(residual) AS v FROM res UNION ALL SELECT {PX}, sec_t, abs(residual) FROM res) WHERE t <> 0 GROUP BY ALL", NET_SQL, _PINV, UNW, SERIES, _RES))
def a14(spark, sf_dir):
    return _out(timeseries.dated_residuals_of(solved(spark, sf_dir)), "residual")


_DAYS = 'days AS (SELECT scene, t, date_diff(\'day\', min(dt) OVER (PARTITION BY scene), dt) AS days FROM dates), obs AS (SELECT a.scene, a."row", a.col, a.t, d.days, a.a / 50 AS phase, least(a.a / 150, 1.0) AS w FROM amp a JOIN days d ON d.scene = a.scene AND d.t = a.t)'


def observed(spark, sf_dir):
    from pyspark.sql import Window

    first = F.min("dt").over(Window.partitionBy("scene"))
    days = dates(spark, sf_dir).select("scene", "t", F.datediff("dt", first).alias("days"))
    rows = amplitude(spark, sf_dir).join(days, ["scene", "t"])
    return rows.select(*KEYS, "t", "days", (F.col("value") / 50).alias("phase"), F.least(F.col("value") / 150, F.lit(1.0)).alias("w"))


@query("a19_velocity", with_("slc dates amp", f"SELECT {PX}, {r('regr_slope(phase, days) * 365.25', 'velocity')} FROM obs GROUP BY ALL HAVING count(*) > 1", _DAYS))
def a19(spark, sf_dir):
    return _out(timeseries.velocity(observed(spark, sf_dir)).filter("velocity IS NOT NULL"), "velocity")


_WLS = "(sw * sxy - sx * sy) / nullif(sw * sxx - sx * sx, 0) * 365.25"


def _weighted(w: str, digits: int = 5) -> str:
    return with_("slc dates amp", f"SELECT {PX}, {r(_WLS, 'velocity', digits)} FROM (SELECT {PX}, sum(v) AS sw, sum(v * days) AS sx, sum(v * phase) AS sy, sum(v * days * days) AS sxx, sum(v * days * phase) AS sxy, count(*) FILTER (v > 0) AS n FROM (SELECT *, ({w}) * ({w}) AS v FROM obs) GROUP BY ALL) WHERE n > 1", _DAYS)


@query("a20_weighted_velocity", _weighted("w"))
def a20(spark, sf_dir):
    rows = observed(spark, sf_dir)
    some = rows.groupBy(*KEYS).agg(F.count("*").alias("k")).filter("k > 1").select(*KEYS)
    return _out(timeseries.velocity(rows.join(some, KEYS, "left_semi"), weight="w"), "velocity", digits=5)


@query("a21_velocity_masked", _weighted("CASE WHEN w < 0.2 THEN 0.0 ELSE w END"))
def a21(spark, sf_dir):
    rows = observed(spark, sf_dir).withColumn("w", timeseries.thresholded_weights("w", 0.2))
    some = rows.filter("w > 0").groupBy(*KEYS).agg(F.count("*").alias("k")).filter("k > 1").select(*KEYS)
    return _out(timeseries.velocity(rows.join(some, KEYS, "left_semi"), weight="w"), "velocity", digits=5)


_INSIDE = 'inside AS (SELECT scene, "row", col FROM amp WHERE t = 3 AND a > 55)'
_LABELS = (
    'walk AS (SELECT scene, "row", col, "row" * 1000 + col AS root FROM inside UNION SELECT b.scene, b."row", b.col, w.root FROM walk w JOIN inside b ON b.scene = w.scene AND abs(b."row" - w."row") <= 1 AND abs(b.col - w.col) <= 1), '
    'least AS (SELECT scene, "row", col, min(root) AS root FROM walk GROUP BY ALL), '
    'labels AS (SELECT scene, "row", col, CAST(dense_rank() OVER (PARTITION BY scene ORDER BY root) AS INT) AS label FROM least)'
)


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def inside(spark, sf_dir):
    return amplitude(spark, sf_dir).filter("t = 3").select(*KEYS, (F.col("value") > 55).alias("inside"))


@query("g4_components", _recursive(with_("slc amp", f"SELECT {PX}, label FROM labels", _INSIDE, _LABELS)))
def g4(spark, sf_dir):
    return interp.components(inside(spark, sf_dir), ["scene"])


@query("t5_largest_component", _recursive(with_("slc amp", "SELECT scene, CAST(arg_max(label, (n, -label)) AS INT) AS label, max(n) AS n FROM (SELECT scene, label, count(*) AS n FROM labels GROUP BY ALL) GROUP BY scene", _INSIDE, _LABELS)))
def t5(spark, sf_dir):
    return interp.largest_component(interp.components(inside(spark, sf_dir), ["scene"]), ["scene"])


_POINT = (
    'region AS (SELECT l.* FROM labels l JOIN (SELECT scene, arg_max(label, (n, -label)) AS label FROM (SELECT scene, label, count(*) AS n FROM labels GROUP BY ALL) GROUP BY scene) b USING (scene, label)), '
    'middle AS (SELECT scene, avg("row") AS mr, avg(col) AS mc FROM region GROUP BY scene), '
    'chosen AS (SELECT scene, "row", col FROM (SELECT r.scene, r."row", r.col, row_number() OVER (PARTITION BY r.scene ORDER BY (r."row" - mr) * (r."row" - mr) + (r.col - mc) * (r.col - mc), r."row", r.col) AS k FROM region r JOIN middle USING (scene)) WHERE k = 1), '
    'best AS (SELECT scene, "row", col FROM (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY a DESC, "row", col) AS k FROM amp WHERE t = 3) WHERE k = 1)'
)


@query("g5_reference_point", _recursive(with_("slc amp", 'SELECT b.scene, CAST(coalesce(c."row", b."row") AS INT) AS "row", CAST(coalesce(c.col, b.col) AS INT) AS col FROM best b LEFT JOIN chosen c USING (scene)', _INSIDE, _LABELS, _POINT)))
def g5(spark, sf_dir):
    quality = amplitude(spark, sf_dir).filter("t = 3").select(*KEYS, F.col("value").alias("quality"))
    return interp.reference_point(quality, ["scene"], 55)




_GROWN = (
    'inside AS (SELECT DISTINCT a.scene, a."row" + dr.range AS "row", a.col + dc.range AS col FROM amp a, range(-1, 2) dr, range(-1, 2) dc WHERE a.t = 3 AND a.a > 95)'
)
_LABELS4 = _LABELS.replace('abs(b."row" - w."row") <= 1 AND abs(b.col - w.col) <= 1', 'abs(b."row" - w."row") + abs(b.col - w.col) <= 1')


@query("f11_components_of_mask", _recursive(with_("slc amp", 'SELECT l.scene, CAST(l."row" AS INT) AS "row", CAST(l.col AS INT) AS col, l.label FROM labels l SEMI JOIN (SELECT * FROM amp WHERE t = 3 AND a > 95) p ON p.scene = l.scene AND p."row" = l."row" AND p.col = l.col', _GROWN, _LABELS4)))
def f11(spark, sf_dir):
    """Components of a mask after a dilation."""
    bright = amplitude(spark, sf_dir).filter("t = 3").select(*KEYS, (F.col("value") > 95).alias("inside"))
    return interp.components_of_mask(bright, ["scene"], 3)
