"""Known answers and plain NumPy for grids, statistics, linking, images and inversion."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fringeflow.operators import geometry, grid, images, interp, masks, mosaic, network, phaselink, ps, shp, timeseries
from fringeflow.sources import ionex, raster, simulate

SLC = "scene int, t int, row int, col int, re double, im double"


def frame_of(spark, cube, scene=0):
    """dates x rows x cols complex -> SLC rows; NaN pixels are left out."""
    t, r, c = np.indices(cube.shape)
    keep = ~np.isnan(cube)
    rows = [(scene, int(a), int(b), int(d), float(z.real), float(z.imag)) for a, b, d, z in zip(t[keep], r[keep], c[keep], cube[keep], strict=True)]
    return spark.createDataFrame(rows, SLC)


# --- grid


def test_disk():
    assert grid.disk(3) == sorted((a, b) for a in range(-2, 3) for b in range(-2, 3) if 0 < a * a + b * b <= 5)
    assert len(grid.disk(2)) == 8 and grid.disk(1) == []
    assert set(grid.disk(6, 3)) == set(grid.disk(6)) - set(grid.disk(4))
    spiral = [a * a + b * b for a, b in grid.disk(8, spiral=True)]
    assert spiral == sorted(spiral)


@settings(max_examples=60, deadline=None)
@given(st.integers(20, 120), st.integers(20, 120), st.integers(8, 40), st.integers(8, 40), st.integers(0, 7), st.integers(0, 7))
def test_blocks_cover(rows, cols, br, bc, orow, ocol):
    seen = np.zeros((rows, cols), dtype=int)
    for r0, r1, c0, c1 in grid.block_ranges((rows, cols), (br, bc), (orow, ocol)):
        assert r1 - r0 <= br and c1 - c0 <= bc
        seen[r0:r1, c0:c1] += 1
    assert seen.min() == 1
    assert seen.max() == 1 or orow or ocol


@pytest.mark.parametrize("shape", [(100, 200), (101, 201)])
@pytest.mark.parametrize("strides", [(1, 1), (1, 3), (3, 3)])
@pytest.mark.parametrize("block", [(15, 15), (20, 30), (17, 27)])
def test_strided_blocks(shape, strides, block):
    half = (5, 7)
    out = np.zeros((shape[0] // strides[0], shape[1] // strides[1]), dtype=int)
    for plan in grid.strided_blocks(shape, block, strides, half):
        r0, r1, c0, c1 = plan["out"]
        out[r0:r1, c0:c1] += 1
        a0, a1, b0, b1 = plan["read"]
        assert 0 <= a0 and a1 <= shape[0] and 0 <= b0 and b1 <= shape[1]
        assert plan["core"] == (r0 * strides[0], r1 * strides[0], c0 * strides[1], c1 * strides[1])
    margin = [round(h / s) for h, s in zip(half, strides, strict=True)]
    inner = out[margin[0] : out.shape[0] - margin[0], margin[1] : out.shape[1] - margin[1]]
    assert (inner == 1).all() and out.sum() == inner.size


def test_tile_map_matches_whole(spark):
    draw = np.random.default_rng(3)
    image = draw.normal(size=(23, 17))
    rows = [(int(r), int(c), float(image[r, c])) for r in range(23) for c in range(17)]
    pixels = spark.createDataFrame(rows, "row int, col int, value double")

    def fn(frame):
        r0, c0 = frame["row"].min(), frame["col"].min()
        part = np.full((frame["row"].max() - r0 + 5, frame["col"].max() - c0 + 5), np.nan)
        part[frame["row"] - r0 + 2, frame["col"] - c0 + 2] = frame["value"]
        mean = np.nanmean(np.lib.stride_tricks.sliding_window_view(part, (5, 5)), axis=(2, 3))
        return frame[["row", "col"]].assign(mean=mean[frame["row"] - r0, frame["col"] - c0])

    found = {(r["row"], r["col"]): r["mean"] for r in grid.tile_map(pixels, fn, "row int, col int, mean double", (7, 6), (2, 2), []).collect()}
    padded = np.pad(image, 2, constant_values=np.nan)
    want = np.nanmean(np.lib.stride_tricks.sliding_window_view(padded, (5, 5)), axis=(2, 3))
    assert len(found) == image.size
    assert np.allclose([found[(r, c)] for r in range(23) for c in range(17)], want.ravel())


@pytest.mark.parametrize("most", [None, 2])
@pytest.mark.parametrize("strides", [(1, 1), (2, 3)])
def test_neighbours_in_tiles(spark, monkeypatch, most, strides):
    """Windows across tiles' borders and below 0, places with two pixels, images of one pixel and missing keys, against a loop over all pairs."""
    monkeypatch.setattr(grid, "TILE", 4)
    monkeypatch.setattr(grid, "ROWS_OUT", 50)
    draw = np.random.default_rng(5)
    pixels = [(int(s), int(r), int(c), k) for k, (s, r, c) in enumerate(zip(draw.integers(0, 3, 300), draw.integers(-7, 12, 300), draw.integers(-3, 9, 300), strict=True))] + [(9, 2, 2, 300)]
    centres = [(int(s), int(r), int(c), f"c{k}") for k, (s, r, c) in enumerate(zip(draw.integers(0, 4, 60), draw.integers(-4, 6, 60), draw.integers(-2, 4, 60), strict=True))]
    offsets = grid.disk(4, spiral=True)
    frame = lambda rows, kind: spark.createDataFrame([*rows, (None, 0, 0, None)], f"scene int, row int, col int, {kind}")
    found = grid.neighbours(frame(centres, "name string"), frame(pixels, "v int"), offsets, ["scene"], ["v"], strides=strides, most=most)
    assert found.columns == ["scene", "row", "col", "name", "rank", "dr", "dc", "v_n"]
    want = []
    for s, r, c, name in centres:
        at = [x * k + (k // 2 if k > 1 else 0) for x, k in zip((r, c), strides, strict=True)]
        met = [(s, r, c, name, i, dr, dc, v) for i, (dr, dc) in enumerate(offsets) for t, y, x, v in pixels if (t, y, x) == (s, at[0] + dr, at[1] + dc)]
        want += met[:most] if most else met
    got = [tuple(r) for r in found.collect()]
    # Of pixels at one place any may be the last.
    assert sorted(got) == sorted(want) if most is None else sorted(r[:-1] for r in got) == sorted(r[:-1] for r in want)


def test_tile_map_together(spark):
    """A function that gets many tiles at once finds what one does that gets each by itself."""
    pixels = spark.createDataFrame([(i, r, c, float((r * 7 + c * 3 + i) % 11)) for i in range(3) for r in range(9) for c in range(8) if (r + c + i) % 5], "image int, row int, col int, value double")
    alone = lambda f: f[["image", "row", "col"]].assign(total=f["value"].sum(), n=len(f))

    def many(f):
        by = f.groupby("tile")["value"]
        return f[["image", "row", "col", "tile"]].assign(total=by.transform("sum"), n=by.transform("size"))

    schema, args = "image int, row int, col int, total double, n long", ((4, 3), (1, 2), ["image"])
    each = sorted(tuple(r) for r in grid.tile_map(pixels, alone, schema, *args).collect())
    assert each == sorted(tuple(r) for r in grid.tile_map(pixels, many, schema, *args, together=True).collect()) and len(each) == pixels.count()


def test_separable_in_tiles(spark, monkeypatch):
    """Sums over tiles' borders, with nodata and missing places, against a loop; kept columns stay with their pixels."""
    from fringeflow.operators import smooth

    monkeypatch.setattr(smooth, "TILE", 4)
    rows = [(s, r, c, None if (r * c + s) % 7 == 3 else float((r * 5 + c * 11 + s) % 13), f"{s}.{r}.{c}") for s in range(2) for r in range(-2, 9) for c in range(7) if (r + 2 * c + s) % 6]
    row_taps, col_taps = [(-1, 0.5), (0, 1.0), (2, 0.25)], [(-2, 0.3), (0, 0.7)]
    found = smooth.separable(spark.createDataFrame(rows, "scene int, row int, col int, v double, name string"), ["scene"], ["v"], row_taps, col_taps, keep=["name"]).collect()
    first = {}
    for s, r, c, *_ in rows:
        met = [(w, x[3]) for o, w in row_taps for x in rows if x[:3] == (s, r - o, c) and x[3] is not None]
        first[s, r, c] = (sum(w * v for w, v in met), sum(w for w, _ in met))
    assert len(found) == len(rows)
    for x in found:
        met = [(w, *first[k]) for o, w in col_taps if (k := (x["scene"], x["row"], x["col"] - o)) in first]
        weight = sum(w * n for w, _, n in met)
        assert x["name"] == f"{x['scene']}.{x['row']}.{x['col']}"
        assert x["v"] == pytest.approx(sum(w * v for w, v, _ in met) / weight) if weight else x["v"] is None


def test_near_looks_need_no_outline(spark, monkeypatch):
    """As long as looks stay inside a tile's lookup, all points take part; ties go to the first in row-major order."""
    monkeypatch.setattr(interp, "_outline", lambda *_: pytest.fail("the outline isn't needed"))
    points = spark.createDataFrame([(0, 0, 2, 1.0), (0, 2, 0, 2.0), (0, 30, 30, 3.0), (1, 5, 5, 4.0)], "scene int, row int, col int, v double")
    gaps = spark.createDataFrame([(0, 1, 1), (0, 12, 12), (0, 20, 20), (1, 0, 0), (2, 0, 0)], "scene int, row int, col int")
    found = {tuple(r)[:3]: r["v"] for r in interp.nearest_value(gaps, points, ["scene"], "v", bucket=4).collect()}
    assert found == {(0, 1, 1): 1.0, (0, 12, 12): 1.0, (0, 20, 20): 3.0, (1, 0, 0): 4.0}


def test_nearest_pairs_are_not_sorted(spark):
    """Far looks compare pairs by one number, so that they are summed up as they come."""
    gaps, points = (spark.createDataFrame([(0, 1, 1, 1.0), (0, 99, 5, 2.0)], "scene int, row int, col int, v double") for _ in range(2))
    found = interp._nearest_within(gaps, points, ["scene"], "v", 64, 2)
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 2


# --- statistics


def test_merged_statistics(spark):
    draw = np.random.default_rng(1)
    cube = draw.normal(size=(10, 4, 4)) + 1j * draw.normal(size=(10, 4, 4))
    stack = frame_of(spark, cube)
    whole = {(r["row"], r["col"]): r for r in ps.amplitude_stats(stack, ["row", "col"]).collect()}
    part = stack.withColumn("part", F.when(F.col("t") < 5, 0).when(F.col("t") < 9, 1).otherwise(2))
    merged = ps.combined(ps.amplitude_stats(part, ["row", "col", "part"]), ["row", "col"]).collect()
    for r in merged:
        a = np.abs(cube[:, r["row"], r["col"]])
        assert r["mean"] == pytest.approx(a.mean()) and r["dispersion"] == pytest.approx(a.std() / a.mean())
        assert whole[(r["row"], r["col"])]["dispersion"] == pytest.approx(a.std() / a.mean())


def test_shp_homogeneous(spark):
    draw = np.random.default_rng(5)
    cube = 20 * (draw.normal(size=(30, 11, 11)) + 1j * draw.normal(size=(30, 11, 11)))
    stack = frame_of(spark, cube)
    stats = ps.amplitude_stats(stack, ["scene", "row", "col"]).select("scene", "row", "col", "mean", ((F.col("dispersion") * F.col("mean")) ** 2).alias("var"))
    edges = shp.estimate("glrt", (5, 5), stats=stats, n=30, alpha=1e-4)
    n = {(r["row"], r["col"]): r["shp_count"] for r in shp.counts(edges, stats).collect()}
    assert n[(5, 5)] >= 118
    false_alarms = 1 - shp.glrt(stats, (2, 2), 30, 0.05).count() / shp.rect(stats, (2, 2)).filter("dr <> 0 OR dc <> 0").count()
    assert 0.001 < false_alarms < 0.05
    with pytest.raises(ValueError):
        shp.estimate("glrt", (1, 1), stats=stats)
    with pytest.raises(ValueError):
        shp.estimate("none", (1, 1))


def test_ks_critical_distance():
    assert shp.ks_critical_distance(30, 0.05) == pytest.approx(0.34, abs=0.02)
    assert shp.ks_critical_distance(30, 0.001) > shp.ks_critical_distance(30, 0.05) > shp.ks_critical_distance(100, 0.05)


# --- phase linking


def truth(n=30, seed=0):
    phases = np.random.default_rng(seed).uniform(-1.5, 1.5, n)
    phases[0] = 0
    return phases, simulate.coherence_matrix(n, 1.0, 0.99, 0.95, 72.0, phases)


def test_eigenpairs():
    draw = np.random.default_rng(2)
    a = draw.normal(size=(20, 6, 6)) + 1j * draw.normal(size=(20, 6, 6))
    a = a @ a.conj().transpose(0, 2, 1)
    values, vectors = phaselink.largest_eigenpair(a)
    assert np.allclose(values, np.linalg.eigvalsh(a)[:, -1], rtol=1e-3)
    mu = np.linalg.eigvalsh(a)[:, 0].min() * 0.9
    values, vectors = phaselink.nearest_eigenpair(a, mu)
    want = np.linalg.eigvalsh(a)
    want = np.take_along_axis(want, np.abs(want - mu).argmin(axis=1)[:, None], 1)[:, 0]
    assert np.allclose(values, want, rtol=1e-3)
    assert np.allclose(np.abs(np.einsum("pij,pj->pi", a, vectors) - values[:, None] * vectors).max(axis=1) / np.abs(values), 0, atol=0.05)


@pytest.mark.parametrize("use_evd", [True, False])
def test_link_recovers_phases(use_evd):
    phases, c = truth()
    samples = np.stack([simulate.samples(c, 121, k) for k in range(20)])
    cross = samples @ samples.conj().transpose(0, 2, 1)
    power = np.sqrt(np.einsum("pii->pi", cross).real)
    found = phaselink.link(cross / (power[:, :, None] * power[:, None, :]), use_evd)
    off = np.angle(np.exp(1j * (np.angle(found.vectors) - phases)))
    assert np.degrees(np.sqrt((off**2).mean())) < 10
    assert (found.estimator == (phaselink.EVD if use_evd else phaselink.EMI)).all()
    if not use_evd:
        assert (found.eigenvalues > 0.99).all()
    assert (phaselink.temporal_coherence(c[None], np.exp(1j * phases)[None]) > 0.9999).all()


def test_link_singular_falls_back():
    c = np.eye(4, dtype=complex) + 2 * (np.eye(4, k=1) + np.eye(4, k=-1))  # not positive definite
    found = phaselink.link(np.stack([c, np.eye(4, dtype=complex)]), with_bound=False)
    assert found.estimator.tolist() == [phaselink.EVD, phaselink.EMI]


def test_lower_bound():
    _, c = truth(8)
    gamma = np.abs(c)[None]
    looks = 50
    x = 2 * looks * (gamma[0] * np.linalg.inv(gamma[0] + 1e-6 * np.eye(8)) - np.eye(8))
    want = np.sqrt(np.diag(np.linalg.inv(np.delete(np.delete(x, 2, 0), 2, 1) + 1e-6 * np.eye(7))))
    found = phaselink.lower_bound(gamma, looks, 2)[0]
    assert found[2] == 0 and np.allclose(np.delete(found, 2), want)
    assert (phaselink.lower_bound(gamma, looks, 2, aps_variance=0.1)[0] >= found - 1e-9).all()


@pytest.mark.parametrize("strides", [(1, 1), (2, 3)])
def test_window_coherence_two_ways(spark, strides):
    """The relational matrix and the tile kernel agree."""
    from fringeflow.operators.coherence import coherence_matrix

    draw = np.random.default_rng(4)
    cube = draw.normal(size=(4, 9, 10)) + 1j * draw.normal(size=(4, 9, 10))
    cube[1, 3, 4] = np.nan
    tile = phaselink.stack_covariance(cube, (1, 2), strides)
    out_rows, out_cols = tile.shape[:2]
    centres = spark.createDataFrame([(0, r, c) for r in range(out_rows) for c in range(out_cols)], "scene int, row int, col int")
    rows = coherence_matrix(frame_of(spark, cube), grid.rectangle(1, 2), strides, centres).collect()
    assert len(rows) == out_rows * out_cols * 6
    for r in rows:
        assert complex(r["re"], r["im"]) == pytest.approx(tile[r["row"], r["col"], r["i"], r["j"]], abs=1e-9)


def test_pipeline_on_simulated_stack(spark):
    phases, c = truth(6, 3)
    stack = simulate.stack(spark, (12, 12), c, seed=11)
    rows = phaselink.run_phase_linking(stack, 6, (3, 3)).filter("row BETWEEN 4 AND 8 AND col BETWEEN 4 AND 8").collect()
    assert len(rows) == 25
    off = np.angle(np.exp(1j * (np.array([r["phases"] for r in rows]) - phases)))
    assert np.degrees(np.sqrt((off**2).mean())) < 10


def test_prune():
    window = np.zeros((5, 5), dtype=bool)
    window[2, 3] = window[1, 4] = window[0, 0] = True
    out = phaselink.prune_unconnected(window)
    assert out[2, 3] and out[1, 4] and not out[0, 0]


# --- images


def test_goldstein():
    r, c = np.indices((50, 43))
    clean = np.exp(1j * (0.2 * r + 0.1 * c))
    draw = np.random.default_rng(0)
    noisy = clean * np.exp(1j * draw.normal(0, 0.8, clean.shape))
    out = images.goldstein(noisy, 0.9, 16)
    error = lambda z: np.angle(z * clean.conj()).std()
    assert error(out) < 0.7 * error(noisy)
    assert np.allclose(np.angle(images.goldstein(clean, 0.0, 16) * clean.conj()), 0, atol=1e-6)
    assert (images.goldstein(np.zeros((8, 8), dtype=complex), 0.5, 8) == 0).all()
    with pytest.raises(ValueError):
        images.goldstein(clean, -1)


def test_long_waves():
    r, c = np.indices((64, 64))
    long, short = 5 * np.cos(2 * np.pi * r / 64), 0.5 * np.cos(2 * np.pi * c / 8)
    bad = np.zeros((64, 64), dtype=bool)
    out = images.without_long_waves(long + short + 20, bad, 14 * 30.0, 30.0)
    assert np.abs(out - short).max() < 0.25
    with pytest.raises(ValueError):
        images.without_long_waves(long, bad, 1e6, 30.0)
    bad[10:13, 10:13] = True
    filled = images.nearest_filled(np.where(bad, 1e6, long), bad, 5)
    assert np.abs(filled).max() < 6


def test_unwrap():
    r, c = np.indices((40, 50))
    phase = 0.3 * r + 0.01 * c**2
    wrapped = np.angle(np.exp(1j * phase))
    unw, label = images.least_squares_unwrap(wrapped, np.ones_like(wrapped))
    assert np.allclose((unw - phase) - (unw - phase)[0, 0], 0, atol=1e-6) and label.all()
    assert np.allclose(np.exp(1j * unw), np.exp(1j * wrapped))
    with pytest.raises(NotImplementedError):
        images.unwrapper("elsewhere")
    images.register("own", lambda w, c: (w, c))
    assert images.unwrapper("own")(1, 2) == (1, 2)


# --- inversion


def ramp(spark, n=10, size=6):
    """All pairs of n dates of a linear ramp of 5 radians a year."""
    rate = np.linspace(0, 5, size * size).reshape(size, size)
    days = 12 * np.arange(n)
    rows = [(0, i, j, int(r), int(c), float(rate[r, c] * (days[j] - days[i]) / 365.25)) for i in range(n) for j in range(i + 1, n) for r in range(size) for c in range(size)]
    return spark.createDataFrame(rows, "scene int, ref_t int, sec_t int, row int, col int, phase double"), rate, days


def test_l2_inversion_and_velocity(spark):
    unw, rate, days = ramp(spark)
    edges = unw.select("scene", "ref_t", "sec_t").distinct()
    series = timeseries.invert_l2(unw, timeseries.inverse_of(edges), edges.groupBy("scene").agg(F.count("*").alias("n")))
    rows = series.collect()
    assert len(rows) == 9 * 36
    assert max(abs(r["phase"] - rate[r["row"], r["col"]] * days[r["t"]] / 365.25) for r in rows) < 1e-5
    assert timeseries.residuals(unw, series).agg(F.max(F.abs("residual"))).first()[0] < 1e-9
    speed = timeseries.velocity(series.withColumn("days", F.col("t") * 12))
    assert max(abs(r["velocity"] - rate[r["row"], r["col"]]) for r in speed.collect()) < 1e-5
    missing = unw.withColumn("phase", F.when(~((F.col("row") == 0) & (F.col("col") == 0) & (F.col("ref_t") == 0) & (F.col("sec_t") == 1)), F.col("phase")))
    assert timeseries.invert_l2(missing, timeseries.inverse_of(edges), edges.groupBy("scene").agg(F.count("*").alias("n"))).count() == 9 * 35


def test_l1_ignores_an_outlier(spark):
    unw, rate, days = ramp(spark)
    pairs = sorted((r["ref_t"], r["sec_t"]) for r in unw.select("ref_t", "sec_t").distinct().collect())
    spoiled = unw.withColumn("phase", F.col("phase") + F.when((F.col("ref_t") == 2) & (F.col("sec_t") == 7), 100.0).otherwise(0.0))
    for r in timeseries.solve_pixels(spoiled, pairs, "l1").collect():
        assert np.allclose(r["solution"], rate[r["row"], r["col"]] * days[1:] / 365.25, atol=1e-3)
        assert r["residual"] == pytest.approx(100, abs=0.1)
    weighted = spoiled.withColumn("w", F.when((F.col("ref_t") == 2) & (F.col("sec_t") == 7), 1e-9).otherwise(1.0))
    for r in timeseries.solve_pixels(weighted, pairs, "weighted", "w").collect():
        assert np.allclose(r["solution"], rate[r["row"], r["col"]] * days[1:] / 365.25, atol=1e-3)
    censored = spoiled.withColumn("phase", F.when((F.col("ref_t") != 2) | (F.col("sec_t") != 7), F.col("phase")))
    for r in timeseries.solve_pixels(censored, pairs, "censored").collect():
        assert np.allclose(r["solution"], rate[r["row"], r["col"]] * days[1:] / 365.25, atol=1e-6)


def test_weighted_velocity_is_polyfit(spark):
    draw = np.random.default_rng(6)
    x, y, w = np.cumsum(draw.integers(5, 30, 12)), draw.normal(size=12), draw.uniform(0.1, 1, 12)
    rows = [(0, 0, 0, int(a), float(b), float(c)) for a, b, c in zip(x, y, w, strict=True)]
    frame = spark.createDataFrame(rows, "scene int, row int, col int, days int, phase double, w double")
    assert timeseries.velocity(frame, weight="w").first()["velocity"] == pytest.approx(np.polyfit(x, y, 1, w=w)[0] * 365.25)
    assert timeseries.velocity(frame).first()["velocity"] == pytest.approx(np.polyfit(x, y, 1)[0] * 365.25)


def test_networks(spark):
    days = ["2021-01-01", "2021-02-01", "2022-01-04", "2022-06-01"]
    dates = spark.createDataFrame([(0, i, d) for i, d in enumerate(days)], "scene int, t int, dt string").withColumn("dt", F.to_date("dt"))
    pairs = lambda f: sorted((r["ref_t"], r["sec_t"]) for r in f.collect())
    assert pairs(network.annual(dates)) == [(0, 2), (1, 2)]
    assert pairs(network.by_bandwidth(dates, 1)) == [(0, 1), (1, 2), (2, 3)]
    assert pairs(network.star(dates, 1)) == [(0, 1), (1, 2), (1, 3)]
    assert pairs(network.manual(dates, [(0, -1), (1, 2)])) == [(0, 3), (1, 2)]
    assert pairs(network.by_baseline(dates, 40)) == [(0, 1)]
    assert len(pairs(network.network(dates))) == 6
    assert network.is_single_reference(network.star(dates, 0)).first()["single"]


# --- masks, components, mosaics, geometry


def test_masks(spark):
    keys = ["row", "col"]
    a = spark.createDataFrame([(0, 0, True), (0, 1, True), (1, 0, False), (1, 1, None)], "row int, col int, valid boolean")
    b = spark.createDataFrame([(0, 0, True), (0, 1, False), (1, 0, False), (1, 1, True)], "row int, col int, valid boolean")
    found = lambda how: sorted((r["row"], r["col"]) for r in masks.combined([a, b], keys, how).collect() if r["valid"])
    assert found("any") == [(0, 0)] and found("all") == [(0, 0), (0, 1), (1, 1)]
    with pytest.raises(ValueError):
        masks.combined([a.filter("NOT valid"), b], keys, raise_on_empty=True)
    stack = spark.createDataFrame([(0, 0, 1.0), (1, 0, None)], "t int, row int, re double")
    with pytest.raises(ValueError):
        masks.require_images(stack, ["t"])


def test_components_snake(spark):
    picture = ["##.#####", ".#.#...#", ".#.#.#.#", ".#...#.#", ".#####.#", ".......#", "#.######", ".#......"]
    rows = [(0, r, c, x == "#") for r, line in enumerate(picture) for c, x in enumerate(line)]
    mask = spark.createDataFrame(rows, "scene int, row int, col int, inside boolean")
    labels = {(r["row"], r["col"]): r["label"] for r in interp.components(mask, ["scene"]).collect()}
    assert labels[(0, 0)] == labels[(2, 5)] == 1 and labels[(0, 3)] == labels[(6, 2)] == 2
    assert labels[(6, 0)] == labels[(7, 1)] == labels[(6, 2)] or labels[(6, 0)] == labels[(7, 1)]
    four = interp.components(mask, ["scene"], 4)
    assert four.select("label").distinct().count() == 4
    assert interp.largest_component(interp.components(mask, ["scene"]), ["scene"]).first()["label"] == 2


def test_reference_point(spark):
    keys = ["scene"]
    grid_of = lambda value: spark.createDataFrame([(0, r, c, float(value(r, c))) for r in range(31) for c in range(31)], "scene int, row int, col int, quality double")
    point = lambda f, **k: tuple(f and interp.reference_point(f, keys, **k).first()[1:])
    assert point(grid_of(lambda r, c: 1)) == (15, 15)
    assert point(grid_of(lambda r, c: 0.99 if c > 15 else 0.3)) == (15, 23)
    bottom = spark.createDataFrame([(0, r, c, r > 15) for r in range(31) for c in range(31)], "scene int, row int, col int, inside boolean")
    assert point(grid_of(lambda r, c: 0.99 if c > 15 else 0.3), inside=bottom) == (23, 23)
    assert point(grid_of(lambda r, c: 0.5 if (r, c) == (3, 4) else 0.1)) == (3, 4)


def test_azimuth_blocks(spark):
    blocks = mosaic.azimuth_blocks(101, 4, 5)
    stack = spark.range(101).select(F.col("id").cast("int").alias("row"))
    assert sorted(r["row"] for r in mosaic.central(mosaic.split_rows(stack, blocks)).collect()) == list(range(101))
    assert blocks[-1]["end"] == 101 and mosaic.least_halo(11, 3) == 26
    with pytest.raises(ValueError):
        mosaic.azimuth_blocks(20, 4, 5)


def test_baseline(spark):
    """For parallel tracks the perpendicular baseline is the distance across the line of sight."""
    one = lambda *v: tuple(F.lit(float(x)) for x in v)
    target, ref, sec, v = (0, 0, 0), (0, -500e3, 700e3), (0, -500e3 + 80, 700e3 + 60), (7500, 0, 0)
    r1, r2 = (math.dist(target, p) for p in (ref, sec))
    look = np.array(target) - np.array(ref)
    b = np.array(sec) - np.array(ref)
    want = np.linalg.norm(np.cross(look / np.linalg.norm(look), b))
    found = spark.range(1).select(geometry.perpendicular_baseline(one(*target), one(*ref), one(*sec), F.lit(r1), F.lit(r2), one(*v)).alias("b")).first()["b"]
    assert abs(found) == pytest.approx(want, rel=1e-3)
    swapped = spark.range(1).select(geometry.perpendicular_baseline(one(*target), one(*sec), one(*ref), F.lit(r2), F.lit(r1), one(*v)).alias("b")).first()["b"]
    assert np.sign(found) == -np.sign(swapped)


# --- sources


def test_flat_files(spark, tmp_path):
    draw = np.random.default_rng(8)
    data = (draw.normal(size=(7, 9)) + 1j * draw.normal(size=(7, 9))).astype("complex64")
    data[2, 3] = 0
    data.tofile(tmp_path / "20220101.slc")
    rows = raster.read_flat(spark, f"file://{tmp_path}/*.slc", (7, 9), "complex64", nodata=0).collect()
    assert len(rows) == 63
    for r in rows:
        if (r["row"], r["col"]) == (2, 3):
            assert r["value"] is None and r["im"] is None
        else:
            assert complex(r["value"], r["im"]) == pytest.approx(complex(data[r["row"], r["col"]]))
    with pytest.raises(Exception, match="not 7 x 8"):
        raster.read_flat(spark, f"file://{tmp_path}/*.slc", (7, 8), "complex64").count()


def test_stored_raster(spark, tmp_path):
    """Blocks of one image in two writes, on a file system that Python can't open: the second leaves the rest of the first."""
    store = f"{tmp_path.parent.name}{tmp_path.name}".replace("_", "-")
    spark.sparkContext._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.{store}.link./s", f"file://{tmp_path}")
    file = raster.flat_raster(spark, f"viewfs://{store}/s/a.bin", (7, 9)).create(-1.0)
    assert isinstance(file, raster.StoredRaster)
    want = np.arange(63.0).reshape(7, 9)
    pixels = spark.range(63).selectExpr("cast(id div 9 as int) as row", "cast(id % 9 as int) as col", "cast(id as double) as value")
    assert raster.write_blocks(pixels, file, (3, 4)) == 9
    assert (np.fromfile(tmp_path / "a.bin").reshape(7, 9) == want).all()
    assert raster.write_blocks(pixels.filter("row between 2 and 4 and col > 5").withColumn("value", -F.col("value")), file, (2, 2), row_start=2, col_start=6) == 4
    want[2:5, 6:] *= -1
    assert (np.fromfile(tmp_path / "a.bin").reshape(7, 9) == want).all()


@pytest.mark.parametrize("dtype, nodata", [("float64", None), ("float64", 4.0), ("int16", 4), ("complex64", None), ("complex64", 4 - 1j)])
def test_stored_rasters_read_as_files_do(spark, tmp_path, dtype, nodata):
    """Files that Python can't open, split among tasks, give the pixels of the same files read by blocks; also beside such files."""
    store = f"{tmp_path.parent.name}{tmp_path.name}".replace("_", "-")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set(f"fs.viewfs.mounttable.{store}.link./s", f"file://{tmp_path}")
    data = np.arange(63.0).reshape(7, 9)
    data = data - 1j * data / 4 if dtype == "complex64" else data
    if dtype != "int16":
        data[2, 3] = np.nan
    for k in (1, 2):
        (data * k).astype(dtype).tofile(tmp_path / f"{k}.bin")
    files = {f"f{k}": raster.FlatRaster(str(tmp_path / f"{k}.bin"), (7, 9), dtype) for k in (1, 2)}
    stored = {f"f{k}": raster.flat_raster(spark, f"viewfs://{store}/s/{k}.bin", (7, 9), dtype) for k in (1, 2)}
    read = lambda readers: sorted(map(tuple, raster.read_blocks(spark, readers, (2, 4), nodata).collect()), key=lambda x: x[:3])
    conf.set("mapreduce.input.fileinputformat.split.maxsize", "60")
    try:
        assert stored["f1"].lines().getNumPartitions() > 1
        want = read(files)
        assert len(want) == 126 and read(stored) == want == read({"f1": files["f1"], "f2": stored["f2"]})
    finally:
        conf.unset("mapreduce.input.fileinputformat.split.maxsize")
    with pytest.raises(ValueError, match="holds"):
        raster.read_blocks(spark, {"a": raster.flat_raster(spark, f"viewfs://{store}/s/1.bin", (8, 9), dtype)})


def test_blocks_outside_an_image_raise(tmp_path):
    file = raster.FlatRaster(str(tmp_path / "deeper" / "a.bin"), (4, 5)).create(0.0)
    for place in ((-2, 0), (0, -2), (3, 0), (0, 4)):
        with pytest.raises(IndexError):
            file.write(np.ones((2, 2)), *place)
    assert (file.read(slice(0, 4), slice(0, 5)) == 0).all()


def test_integer_pairs(spark, tmp_path):
    pairs = np.array([[1, -2], [3, 4], [0, 5], [-6, 7]], dtype=">i2")
    pairs.tofile(tmp_path / "a.int")
    rows = raster.read_flat(spark, f"file://{tmp_path}/a.int", (2, 2), ">cint16").orderBy("row", "col").collect()
    assert [(r["value"], r["im"]) for r in rows] == [(1, -2), (3, 4), (0, 5), (-6, 7)]


def test_orbits(spark):
    """A straight track: the closest point is the foot of the perpendicular."""
    times = np.arange(0.0, 100.0, 10.0)
    track = lambda y, z: geometry.Orbit(times, np.stack([7500 * times, 0 * times + y, 0 * times + z], axis=1), np.tile([7500.0, 0, 0], (10, 1)))
    targets = np.array([[300e3, 400e3, 0.0], [123456.0, 350e3, 10.0]])
    t, distance, _, _ = track(0, 700e3).closest(targets)
    assert np.allclose(t, targets[:, 0] / 7500) and np.allclose(distance, np.hypot(targets[:, 1], 700e3 - targets[:, 2]))
    points = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(targets)], "k int, x double, y double, z double")
    found = [r["baseline"] for r in geometry.baseline_grid(points, track(0, 700e3), track(60, 700e3 + 80), "k").orderBy("k").collect()]
    for value, target in zip(found, targets, strict=True):
        look = np.array([0, target[1], target[2] - 700e3])
        assert abs(value) == pytest.approx(np.linalg.norm(np.cross(look / np.linalg.norm(look), [0, 60, 80])), rel=1e-3)


def test_components_of_mask(spark):
    mask = spark.createDataFrame([(0, r, c, True) for r, c in [(0, 0), (0, 3), (0, 9), (9, 5)]], "scene int, row int, col int, inside boolean")
    labels = {(r["row"], r["col"]): r["label"] for r in interp.components_of_mask(mask, ["scene"], 5).collect()}
    assert labels[(0, 0)] == labels[(0, 3)] != labels[(0, 9)] and len(labels) == 4


def test_window_and_metadata(spark):
    pixels = spark.createDataFrame([(r, c, float(r * c)) for r in range(10) for c in range(10)], "row int, col int, value double")
    assert raster.window(pixels, (2, 20), (0, 3), shape=(10, 10)).count() == 24
    assert raster.window(pixels, nodata=0.0).filter("value IS NULL").count() == 19
    with pytest.raises(IndexError):
        raster.window(pixels, (12, 20), shape=(10, 10))
    meta = raster.metadata(spark, [{"raster_id": "a", "n_rows": 10, "n_cols": 5, "x0": 0.0, "dx": 2.0, "y0": 0.0, "dy": -3.0, "epsg": 32615}, {"raster_id": "b", "n_rows": 9, "n_cols": 5, "x0": 0.0, "dx": 2.0, "y0": 0.0, "dy": -3.0, "epsg": 32615}])
    assert tuple(raster.bounds(meta).filter("raster_id = 'a'").first())[1:] == (0.0, -30.0, 10.0, 0.0)
    with pytest.raises(ValueError):
        raster.require_same_grid(meta)
    assert raster.require_same_grid(raster.updated_metadata(meta, "b", n_rows=10)).count() == 2
    assert raster.subdataset_name("a.nc", "/x/VV") == 'NETCDF:"a.nc":"//x/VV"'


def test_mantissa(spark):
    values = [1.0, 1.0 + 2**-11, 1.0 + 3 * 2**-11, -math.pi, 1e-300, 0.0, None, float("nan"), float("inf")]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(raster.round_mantissa(F.col("v"), 10).alias("v")).collect()
    found = [r["v"] for r in rows]
    assert found[0] == 1.0 and found[1] == 1.0 and found[2] == 1.0 + 2**-9 and found[5] == 0.0 and found[6] is None
    assert abs(found[3] + math.pi) < 2**-9 and math.isnan(found[7]) and math.isinf(found[8])


def test_ionex(spark):
    line = lambda text, label: f"{text:<60}{label}\n"
    body = line("    -1", "EXPONENT") + line("", "END OF HEADER")
    for k, hour in enumerate((0, 2)):
        body += line(f"{k + 1:6d}", "START OF TEC MAP") + line(f"  2022     1     1{hour:6d}     0     0", "EPOCH OF CURRENT MAP")
        for lat in (87.5, 85.0):
            body += line(f"  {lat:6.1f}-180.0 180.0   5.0 450.0", "LAT/LON1/LON2/DLON/H")
            values = [int(lat) * 10 + i + 100 * k for i in range(20)]
            values[3] = 9999
            body += "".join(f"{v:5d}" for v in values[:16]) + "\n" + "".join(f"{v:5d}" for v in values[16:]) + "\n"
        body += line(f"{k + 1:6d}", "END OF TEC MAP")
    rows = {(r["minute"], r["lat"], r["lon"]): r["tec"] for r in ionex.parsed(spark.createDataFrame([("f", body)], "file string, body string")).collect()}
    assert len(rows) == 2 * 2 * 20
    assert rows[(0.0, 87.5, -180.0)] == pytest.approx(87.0) and rows[(120.0, 85.0, -85.0)] == pytest.approx(96.9)
    assert rows[(0.0, 87.5, -165.0)] is None


def test_ionex_columns(spark):
    """Full columns of five touch; lines in other columns are told apart by spaces."""
    line = lambda text, label: f"{text:<60}{label}\n"
    head = line("     1", "START OF TEC MAP") + line("  2022     1     1     0     0     0", "EPOCH OF CURRENT MAP")
    bands = {10.0: "   1012345-1234 999999999\n    7\n", 7.5: "1 22 333\n4444 55555 -6\n"}
    body = line("    -1", "EXPONENT") + head + "".join(line(f"  {lat:6.1f}   0.0  25.0   5.0 450.0", "LAT/LON1/LON2/DLON/H") + text for lat, text in bands.items()) + line("     1", "END OF TEC MAP")
    rows = ionex.parsed(spark.createDataFrame([("f", body)], "file string, body string")).orderBy("lon").collect()
    found = {lat: [r["tec"] if r["tec"] is None else round(r["tec"], 6) for r in rows if r["lat"] == lat] for lat in bands}
    assert found == {10.0: [1.0, 1234.5, -123.4, None, 9999.9, 0.7], 7.5: [0.1, 2.2, 33.3, 444.4, 5555.5, -0.6]}


def test_solved_networks(spark):
    """Series and residuals of each pixel with all pairs of its scene, for scenes of different networks, as by the joins."""
    draw = np.random.default_rng(8)
    nets = {0: [(0, 1), (0, 2), (1, 2), (1, 3), (2, 3)], 1: [(2, 4), (2, 5), (4, 5)], 2: [(0, 1), (3, 4)]}
    rows = [(s, a, b, r, c, float(draw.normal())) for s, net in nets.items() for a, b in net for r in range(3) for c in range(2) if (s, a, r, c) != (0, 1, 2, 1)]
    unw = spark.createDataFrame([*rows, (1, 2, 4, 9, 9, None)], "scene int, ref_t int, sec_t int, row int, col int, phase double")
    edges = spark.createDataFrame([(s, a, b) for s, net in nets.items() for a, b in net], "scene int, ref_t int, sec_t int")
    n = edges.groupBy("scene").agg(F.count("*").alias("n"))
    series = timeseries.invert_l2(unw, timeseries.inverse_of(edges), n)
    left = timeseries.residuals(unw.filter("phase IS NOT NULL"), series)
    solved = timeseries.solved_networks(unw, n)
    for one, other in ((series, timeseries.series_of(solved)), (left, timeseries.residuals_of(solved)), (timeseries.residuals_per_date(left), timeseries.dated_residuals_of(solved))):
        value = one.columns[-1]
        keys = [c for c in one.columns if c != value]
        want, got = ({tuple(r[k] for k in keys): r[value] for r in x.collect()} for x in (one, other))
        assert want.keys() == got.keys() and want and all(got[k] == pytest.approx(v, abs=1e-12) for k, v in want.items())


@pytest.mark.parametrize("small", [0, 60, 1000])
def test_unwrapped_images_of_any_size(spark, monkeypatch, small):
    """Images that are solved at once, in lines, and both beside each other, with gaps and null keys, as one by one."""
    from fringeflow.operators import images

    monkeypatch.setattr(images, "SMALL", small)
    draw = np.random.default_rng(4)
    shapes = {0: (6, 5), 1: (9, 8), 2: (6, 5), 3: (1, 7), None: (7, 9)}
    whole = {k: np.where(draw.random(s) < 0.15, np.nan, (np.cumsum(draw.normal(size=s), axis=0) + np.pi) % (2 * np.pi) - np.pi) for k, s in shapes.items()}
    for image in whole.values():
        image[-1, -1] = 0.5
    rows = [(k, r, c, None if np.isnan(v) else float(v), 0.5) for k, image in whole.items() for (r, c), v in np.ndenumerate(image) if (r, c) != (0, 1)]
    for image in whole.values():
        image[0, 1] = np.nan
    found = images.unwrapped_images(spark.createDataFrame(rows, "image int, row int, col int, phase double, correlation double").filter("image IS NOT NULL" if small < 1000 else "true"), ["image"]).collect()
    want = {k: images.least_squares_unwrap(image, image)[0] for k, image in whole.items() if k is not None or small == 1000}
    assert len(found) == sum(1 for r in rows if r[0] is not None or small == 1000)
    for r in found:
        w = want[r["image"]][r["row"], r["col"]]
        assert r["unw"] is None and r["conncomp"] == 0 if np.isnan(w) else r["unw"] == pytest.approx(w) and r["conncomp"] == 1


def test_a_ministack_computes_its_batch_once(spark, tmp_path):
    """However many tables are made of a batch, where it comes from is asked once; the copy is gone afterwards."""
    from fringeflow.streaming import sequential

    asked = tmp_path / "asked"

    def seen(batches):
        for batch in batches:
            with open(asked, "a") as out:
                out.write("x" * batch.num_rows)
            yield batch

    draw = np.random.default_rng(2)
    rows = [(0, t, r, c, float(draw.normal()), float(draw.normal())) for t in range(3) for r in range(4) for c in range(3)]
    batch = spark.createDataFrame(rows, "scene int, t int, row int, col int, re double, im double")
    estimator = sequential.SequentialEstimator(spark, f"file://{tmp_path}/state", (1, 1))
    estimator.process(batch.mapInArrow(seen, batch.schema), 0)
    assert len(asked.read_text()) == len(rows)
    assert estimator.linked().count() == len(rows) and not (tmp_path / "state" / "given" / "000000").exists()


def test_simulated_coherence():
    c = simulate.coherence_matrix(5, 12.0)
    z = simulate.samples(c, 200_000, 1)
    assert np.abs(z @ z.conj().T / z.shape[1] - c).max() < 0.02


def test_components_of_a_snake(spark):
    """A winding path much longer than the grid is wide is one component."""
    rows = [(0, r, c, r % 2 == 0 or c == (39 if r % 4 == 1 else 0)) for r in range(81) for c in range(40)]
    mask = spark.createDataFrame(rows, "scene int, row int, col int, inside boolean")
    labels = interp.components(mask, ["scene"], 4)
    assert labels.count() == 41 * 40 + 40
    assert [r["label"] for r in labels.select("label").distinct().collect()] == [1]


def test_nearest_value_of_a_far_gap(spark):
    """A gap farther off than many first looks is filled all the same; ties go to the first in row-major order."""
    points = spark.createDataFrame([(0, 0, 0, 1.0), (0, 0, 1, 2.0), (0, 300, 0, 3.0)], "scene int, row int, col int, v double")
    gaps = spark.createDataFrame([(0, 0, 500), (0, 150, 0), (0, 151, 0), (1, 0, 0)], "scene int, row int, col int")
    found = {(r["scene"], r["row"], r["col"]): r["v"] for r in interp.nearest_value(gaps, points, ["scene"], "v", bucket=2).collect()}
    assert found == {(0, 0, 500): 2.0, (0, 150, 0): 1.0, (0, 151, 0): 3.0}


def test_nearest_value_equals_brute_force(spark):
    import random

    draw = random.Random(3)
    cells = {(r, c): draw.random() for r in range(25) for c in range(25)}
    # blocks of points, so that most are inside and only the outline takes part
    points = [(0, r, c, v) for (r, c), v in cells.items() if (r // 6 + c // 6) % 3 == 0]
    gaps = [(0, r, c) for r, c in cells if (r // 6 + c // 6) % 3]
    found = interp.nearest_value(spark.createDataFrame(gaps, "scene int, row int, col int"), spark.createDataFrame(points, "scene int, row int, col int, v double"), ["scene"], "v", bucket=1, rings=1)
    expected = {(r, c): min(points, key=lambda p: ((p[1] - r) ** 2 + (p[2] - c) ** 2, p[1], p[2]))[3] for _, r, c in gaps}
    assert {(x["row"], x["col"]): x["v"] for x in found.collect()} == expected
