"""Queries on per-pixel and per-image kernels. Where SQL can't express them (eigenvectors, spectra, iterations), tests/test_kernel_queries.py
computes the query's own rows with plain NumPy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from fringeflow.functions.cx import angle, cx
from fringeflow.functions.scalars import gaussian_sigma, rounded
from fringeflow.operators import coherence, geometry, grid, images, network, phaselink, shp, timeseries
from fringeflow.plans.aggregates import KEYS, PX, packed, stats
from fringeflow.plans.catalog import query
from fringeflow.plans.inversion import NET, UNW, NET_SQL, unwrapped, values_sql
from fringeflow.plans.scans import amplitude, table
from fringeflow.plans.sql import offsets, r, with_
from fringeflow.plans.windows import CHI, GLRT, dense
from fringeflow.sources.virtual import COLS, DATES, ROWS, dates, slc


def _linked(spark, sf_dir, **options):
    found = phaselink.linked_pixels(packed(spark, sf_dir), DATES, 3.0, **options)
    arrays = ("phases", "crlb")
    return found.select(*KEYS, *(F.transform(c, lambda x: F.round(x, 4)).alias(c) for c in arrays), *(rounded(F.col(c), 4).alias(c) for c in ("temp_coh", "eigenvalue")), "estimator")


@query("k7_evd")
def k7(spark, sf_dir):
    return _linked(spark, sf_dir, use_evd=True)


@query("k8_nearest_eigenpair")
def k8(spark, sf_dir):
    """The eigenvalue nearest 0.99 of each pixel's coherence matrix, and how well its vector solves for it."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            # A few hundred pixels at a time bound the matrices in memory.
            for start in range(0, batch.num_rows, 512):
                piece = batch.slice(start, 512)
                c = phaselink.dense_matrices(*(piece.column(x) for x in ("dates", "re", "im")), DATES)
                values, vectors = phaselink.nearest_eigenpair(c, 0.99)
                left = np.linalg.norm(np.einsum("pij,pj->pi", c, vectors) - values[:, None] * vectors, axis=1)
                yield pa.RecordBatch.from_arrays([*(piece.column(k) for k in KEYS), pa.array(values), pa.array(left)], [*KEYS, "eigenvalue", "left"])

    found = packed(spark, sf_dir).mapInArrow(run, "scene int, row int, col int, eigenvalue double, left double")
    return found.select(*KEYS, rounded(F.col("eigenvalue"), 3).alias("eigenvalue"), (F.col("left") < 0.1).cast("int").alias("solved"))


@query("k9_emi")
def k9(spark, sf_dir):
    return _linked(spark, sf_dir, beta=0.05, zero_threshold=0.05)


@query("k10_phase_link")
def k10(spark, sf_dir):
    """The whole pixel pipeline: similar pixels, strided windows, lag mask, linking."""
    edges = shp.glrt(stats(spark, sf_dir).select(*KEYS, "mean", ((F.col("dispersion") * F.col("mean")) ** 2).alias("var")), (2, 2), DATES, 0.001)
    return phaselink.run_phase_linking(slc(spark, sf_dir), DATES, (2, 2), edges=edges, lag=5).select(*KEYS, "temp_coh", "estimator")


@query("k11_phase_link_strided")
def k11(spark, sf_dir):
    return phaselink.run_phase_linking(slc(spark, sf_dir), DATES, (2, 3), (4, 5)).select(*KEYS, "temp_coh", "estimator")


@query("k12_crlb")
def k12(spark, sf_dir):
    return _linked(spark, sf_dir).select(*KEYS, F.posexplode("crlb").alias("t", "std"))


#: Steps inside a window from the centre over chosen neighbours that touch.
_K6 = (
    's AS (SELECT scene, "row", col, (var + mean * mean) / 2 AS s FROM stats), '
    + GLRT.replace(repr(CHI), repr(shp.chi_square_quantile(0.3)))
    + ', walk AS (SELECT DISTINCT scene, "row", col, 0 AS dr, 0 AS dc FROM shp UNION SELECT w.scene, w."row", w.col, h.dr, h.dc FROM walk w JOIN shp h ON h.scene = w.scene AND h."row" = w."row" AND h.col = w.col AND abs(h.dr - w.dr) <= 1 AND abs(h.dc - w.dc) <= 1)'
)


@query("k6_prune", with_("slc amp stats", f"SELECT {PX}, dr, dc FROM walk WHERE dr <> 0 OR dc <> 0", offsets(grid.rectangle(1, 2, centre=False)), _K6).replace("WITH ", "WITH RECURSIVE ", 1))
def k6(spark, sf_dir):
    edges = shp.glrt(stats(spark, sf_dir).select(*KEYS, "mean", ((F.col("dispersion") * F.col("mean")) ** 2).alias("var")), (1, 2), DATES, 0.3)
    return phaselink.pruned(edges, (1, 2))


def _solved(spark, sf_dir, method, weight=None):
    unw, _ = unwrapped(spark, sf_dir)
    unw = unw.withColumn("w", F.lit(0.5) + (F.col("row") + F.col("ref_t")) % 3)
    found = timeseries.solve_pixels(unw, NET, method, weight)
    return found.select(*KEYS, F.posexplode("solution").alias("t", "phase"), rounded(F.col("residual"), 4).alias("residual")).withColumn("phase", rounded(F.col("phase"), 4))


def _weighted_inverse(m: int) -> np.ndarray:
    """The solution's matrix where the weights are 0.5 + (m + ref_t) % 3."""
    a, w = timeseries.matrix_of(NET), np.array([0.5 + (m + a) % 3 for a, _ in NET])
    return np.linalg.solve(a.T @ (w[:, None] * a), a.T * w)


_WINV = "winv AS " + values_sql([(m, a, b, i, float(x[i, k])) for m in range(3) for x in [_weighted_inverse(m)] for i in range(DATES - 1) for k, (a, b) in enumerate(NET)], "m, ref_t, sec_t, t, coef")
_WHOLE = f"whole AS (SELECT {PX} FROM unw GROUP BY ALL HAVING count(*) = {len(NET)})"


def _solved_sql(matrix: str, weight: str, residual: str) -> str:
    return with_(
        "slc amp", f"SELECT s.scene, s.\"row\", s.col, s.t, {r('s.phase', 'phase', 4)}, {r('e.residual', 'residual', 4)} FROM series s JOIN err e USING (scene, \"row\", col)",
        NET_SQL, matrix, UNW, _WHOLE,
        'kept AS (SELECT u.* FROM unw u SEMI JOIN whole w ON u.scene = w.scene AND u."row" = w."row" AND u.col = w.col)',
        f'series AS (SELECT u.scene, u."row", u.col, p.t, sum(p.coef * u.phase) AS phase FROM kept u JOIN winv p ON p.ref_t = u.ref_t AND p.sec_t = u.sec_t AND p.m = {weight} GROUP BY ALL)',
        'fit AS (SELECT u.*, coalesce(b.phase, 0) - coalesce(a.phase, 0) - u.phase AS d FROM kept u LEFT JOIN series a ON a.scene = u.scene AND a."row" = u."row" AND a.col = u.col AND a.t + 1 = u.ref_t LEFT JOIN series b ON b.scene = u.scene AND b."row" = u."row" AND b.col = u.col AND b.t + 1 = u.sec_t)',
        f"err AS (SELECT {PX}, {residual} AS residual FROM fit GROUP BY ALL)",
    )


@query("k19_weighted_l2", _solved_sql(_WINV, '(u."row" % 3)', 'sum((0.5 + ("row" + ref_t) % 3) * d * d)'))
def k19(spark, sf_dir):
    return _solved(spark, sf_dir, "weighted", "w")


_PLAIN = "winv AS " + values_sql([(0, a, b, i, float(x)) for i, line in enumerate(np.linalg.pinv(timeseries.matrix_of(NET))) for (a, b), x in zip(NET, line, strict=True)], "m, ref_t, sec_t, t, coef")


@query("k20_censored_l2", _solved_sql(_PLAIN, "0", "sqrt(sum(d * d))"))
def k20(spark, sf_dir):
    return _solved(spark, sf_dir, "censored")


@query("k21_l1_inversion")
def k21(spark, sf_dir):
    return _solved(spark, sf_dir, "l1")


def _ifgs(spark, sf_dir):
    return coherence.interferograms(slc(spark, sf_dir), network.by_bandwidth(dates(spark, sf_dir), 1))


@query("x1_goldstein")
def x1(spark, sf_dir):
    return images.goldstein_images(_ifgs(spark, sf_dir), ["scene", "ref_t", "sec_t"], 0.5, 8)


def _low_pass(n: int) -> list[tuple[int, float]]:
    """The circular Gaussian by distance along a line of n pixels."""
    response = np.exp(-2 * (np.pi * gaussian_sigma(300.0, 30.0) * np.fft.fftfreq(n)) ** 2)
    return [(k, float(x)) for k, x in enumerate(np.fft.ifft(response).real)]


def _long_sql(gap: str) -> str:
    places = f'places AS (SELECT s.scene, s.t, r.range AS "row", c.range AS col FROM (SELECT DISTINCT scene, t FROM slc) s, range({ROWS}) r, range({COLS}) c)'
    full = f'full_ AS (SELECT p.*, a.a, coalesce({gap}, false) OR a.a IS NULL AS gap FROM places p LEFT JOIN amp a USING (scene, t, "row", col))'
    near = 'near AS (SELECT * FROM (SELECT g.scene, g.t, g."row", g.col, p.a AS v, row_number() OVER (PARTITION BY g.scene, g.t, g."row", g.col ORDER BY (g."row" - p."row")^2 + (g.col - p.col)^2, p."row", p.col) AS k FROM full_ g JOIN full_ p ON p.scene = g.scene AND p.t = g.t AND NOT p.gap WHERE g.gap AND (g."row" - p."row")^2 + (g.col - p.col)^2 <= 25) WHERE k = 1)'
    filled = 'filled AS (SELECT f.*, CASE WHEN f.gap THEN coalesce(n.v, 0) ELSE f.a END AS v FROM full_ f LEFT JOIN near n USING (scene, t, "row", col))'
    along = f'along AS (SELECT f.scene, f.t, f."row", g.range AS col, sum(f.v * w.x) AS v FROM filled f, range({COLS}) g JOIN wc w ON w.k = (g.range - f.col + {COLS}) % {COLS} GROUP BY ALL)'
    low = f'low AS (SELECT f.scene, f.t, g.range AS "row", f.col, sum(f.v * w.x) AS v FROM along f, range({ROWS}) g JOIN wr w ON w.k = (g.range - f."row" + {ROWS}) % {ROWS} GROUP BY ALL)'
    return with_(
        "slc amp", f'SELECT f.scene, f.t, CAST(f."row" AS INT) AS "row", CAST(f.col AS INT) AS col, {r("CASE WHEN coalesce(f.a, 0) <> 0 THEN f.v - l.v ELSE 0 END", "value")} FROM filled f JOIN low l USING (scene, t, "row", col)',
        "wr AS " + values_sql(_low_pass(ROWS), "k, x"), "wc AS " + values_sql(_low_pass(COLS), "k, x"), places, full, near, filled, along, low,
    )


@query("x2_longwave", _long_sql("false"))
def x2(spark, sf_dir):
    rows = dense(spark, sf_dir).select("scene", "t", "row", "col", F.col("a").alias("value"))
    return images.long_wave_images(rows, ["scene", "t"], "value", 300.0, 30.0).withColumn("value", rounded(F.col("value")))


@query("x3_longwave_masked", _long_sql("a.a < 8"))
def x3(spark, sf_dir):
    rows = dense(spark, sf_dir).select("scene", "t", "row", "col", F.col("a").alias("value"), (F.col("a") < 8).cast("double").alias("bad"))
    return images.long_wave_images(rows, ["scene", "t"], "value", 300.0, 30.0, "bad").withColumn("value", rounded(F.col("value")))


@query("unwrap_builtin")
def unwrap(spark, sf_dir):
    wrapped = _ifgs(spark, sf_dir).select("scene", "ref_t", "sec_t", "row", "col", angle(cx()).alias("phase"), F.lit(0.5).alias("correlation"))
    return images.unwrapped_images(wrapped, ["scene", "ref_t", "sec_t"])


@query("ud1_tile_map", with_("slc amp", f'SELECT a.scene, a.t, a."row", a.col, {r("max(b.a)", "most")} FROM amp a JOIN amp b ON b.scene = a.scene AND b.t = a.t AND abs(b."row" - a."row") <= 1 AND abs(b.col - a.col) <= 1 GROUP BY ALL'))
def ud1(spark, sf_dir):
    """A user's function over tiles with halos: here each pixel's largest neighbour."""

    def fn(frame):
        import numpy as np

        # All tiles are laid into one array, each with a border.
        tile = frame["tile"].to_numpy()
        starts = np.flatnonzero(np.diff(tile, prepend=-1))
        r, c = (x - np.minimum.reduceat(x, starts)[tile] + 1 for x in (frame[k].to_numpy() for k in ("row", "col")))
        images = np.full((len(starts), r.max() + 2, c.max() + 2), -np.inf)
        images[tile, r, c] = frame["value"]
        most = np.lib.stride_tricks.sliding_window_view(images, (3, 3), axis=(1, 2)).max(axis=(3, 4))
        return frame[["scene", "t", "row", "col", "tile"]].assign(most=most[tile, r - 1, c - 1])

    return grid.tile_map(amplitude(spark, sf_dir), fn, "scene int, t int, row int, col int, most double", (8, 5), (1, 1), ["scene", "t"], together=True).withColumn("most", rounded(F.col("most")))


@query("p16_baseline_grid")
def p16(spark, sf_dir):
    """Baselines over a lon/lat grid: zero-Doppler positions on two nearly parallel orbits."""
    import numpy as np

    parts = table(spark, sf_dir, "part").select("p_partkey", (10.0 + F.col("p_size") / 10).alias("lon"), (45.0 + F.col("p_retailprice") / 1000).alias("lat"))
    x, y, z = geometry.to_ecef(F.col("lon"), F.col("lat"), F.lit(100.0))
    times = np.arange(-60.0, 61.0, 10.0)
    angle_ = np.radians(45) + times * 7500 / 7.07e6

    def orbit(radius, lon):
        flat, up = radius * np.cos(angle_), radius * np.sin(angle_)
        turn = radius * 7500 / 7.07e6
        where = np.stack([flat * np.cos(lon), flat * np.sin(lon), up], axis=1)
        speed = turn * np.stack([-np.sin(angle_) * np.cos(lon), -np.sin(angle_) * np.sin(lon), np.cos(angle_)], axis=1)
        return geometry.Orbit(times, where, speed)

    found = geometry.baseline_grid(parts.select("p_partkey", x.alias("x"), y.alias("y"), z.alias("z")), orbit(7.07e6, np.radians(5)), orbit(7.07e6 + 60, np.radians(5.001)), "p_partkey")
    return parts.join(found, "p_partkey").select("p_partkey", "lon", "lat", F.round("baseline", 3).alias("baseline"))
