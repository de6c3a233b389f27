"""Queries that SQL can't express, against plain NumPy over their own rows: dense eigen-decompositions, direct Fourier sums and loops."""

import numpy as np
import pytest

from fringeflow.operators import images, phaselink, timeseries
from fringeflow.plans import catalog
from fringeflow.plans.inversion import NET
from fringeflow.sources.virtual import COLS, DATES, ROWS, slc

QUERIES = catalog.queries()


@pytest.fixture(scope="module")
def cubes(spark, tables):
    """scene -> dates x rows x cols, NaN where a sample is missing."""
    out = {}
    for r in slc(spark, tables).collect():
        cube = out.setdefault(r["scene"], np.full((DATES, ROWS, COLS), np.nan, dtype=complex))
        cube[r["t"], r["row"], r["col"]] = complex(r["re"], r["im"])
    return out


def coherence(cube, row, col, half, allowed=None):
    """Over the window around a pixel; a missing sample is 0 on its own date."""
    rows = [r for r in range(row - half[0], row + half[0] + 1) if 0 <= r < ROWS]
    cols = [c for c in range(col - half[1], col + half[1] + 1) if 0 <= c < COLS]
    z = np.array([[np.nan_to_num(cube[t, r, c]) for r in rows for c in cols if allowed is None or (r - row, c - col) in allowed] for t in range(DATES)])
    cross = z @ z.conj().T
    power = np.sqrt(np.outer(np.diag(cross).real, np.diag(cross).real))
    out = np.where(power > 1e-6, cross / np.maximum(power, 1e-300), 0)
    np.fill_diagonal(out, 1)
    return out


def linked(c, evd=False, beta=0.0, threshold=0.0):
    """(phases, eigenvalue, ratio to the next eigenvalue, estimator, the dates' weights) by full decompositions."""
    n = len(c)
    gamma = (1 - beta) * np.abs(c) + beta * np.eye(n)
    gamma = np.where(gamma < threshold, 0, gamma)
    good = np.linalg.eigvalsh(gamma + 1e-6 * np.eye(n))[0] > 0 and not evd
    matrix = np.linalg.inv(gamma + 1e-6 * np.eye(n)) * c if good else c * gamma
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(abs(values - 0.99)) if good else np.argsort(-values)
    v = vectors[:, order[0]]
    near = abs(values[order] - 0.99) if good else values[order]
    return np.angle(v * np.exp(-1j * np.angle(v[0]))), values[order[0]], (near[0] / max(near[1], 1e-12)) if good else near[1] / near[0], int(good), np.abs(v) ** 2


def fit(c, phases):
    i, j = np.triu_indices(len(c), 1)
    return abs(np.exp(1j * (np.angle(c[i, j]) - (phases[i] - phases[j]))).mean())


def turned(d):
    return np.angle(np.exp(1j * np.asarray(d)))


@pytest.mark.parametrize(("name", "options"), [("k7_evd", {"evd": True}), ("k9_emi", {"beta": 0.05, "threshold": 0.05})])
def test_linked(spark, tables, cubes, name, options):
    rows = QUERIES[name](spark, tables).collect()
    assert len(rows) == sum(len(np.argwhere(~np.isnan(c).all(axis=0))) for c in cubes.values())
    sure = 0
    for r in rows:
        c = coherence(cubes[r["scene"]], r["row"], r["col"], (1, 1))
        phases, value, ratio, estimator, weights = linked(c, **options)
        assert r["estimator"] == estimator
        assert r["temp_coh"] == pytest.approx(fit(c, np.array(r["phases"])), abs=2e-3)
        # An iteration settles in its bounded rounds only where the next eigenvalue is well apart. Dates of little weight have
        # no phase to speak of; the reference date's may be one, so a common turn doesn't count.
        if ratio < 0.8:
            sure += 1
            assert r["eigenvalue"] == pytest.approx(value, rel=2e-3, abs=2e-3)
            assert abs((weights * np.exp(1j * (np.array(r["phases"]) - phases))).sum()) > 0.999
    assert sure > len(rows) / 4


def test_nearest_eigenpair(spark, tables, cubes):
    rows = QUERIES["k8_nearest_eigenpair"](spark, tables).collect()
    assert len(rows) > 100
    for r in rows:
        if r["solved"]:
            values = np.linalg.eigvalsh(coherence(cubes[r["scene"]], r["row"], r["col"], (1, 1)))
            assert abs(values - r["eigenvalue"]).min() < 0.1  # as the residual bounds it
    assert np.mean([r["solved"] for r in rows]) > 0.8


def test_lower_bound(spark, tables, cubes):
    rows = QUERIES["k12_crlb"](spark, tables).collect()
    found = {}
    for r in rows:
        found.setdefault((r["scene"], r["row"], r["col"]), {})[r["t"]] = r["std"]
    checked = 0
    for (scene, row, col), std in found.items():
        gamma = np.abs(coherence(cubes[scene], row, col, (1, 1)))
        if np.linalg.eigvalsh(gamma + 1e-6 * np.eye(DATES))[0] <= 1e-3:
            continue
        fisher = 2 * 3.0 * (gamma * np.linalg.inv(gamma + 1e-6 * np.eye(DATES)) - np.eye(DATES))[1:, 1:] + 1e-6 * np.eye(DATES - 1)
        expected = np.sqrt(np.maximum(np.diag(np.linalg.inv(fisher)), 0))
        assert std[0] == 0 and np.allclose([std[t] for t in range(1, DATES)], expected, rtol=1e-3, atol=2e-4)
        checked += 1
    assert checked > len(found) / 2


def test_whole_pipeline(spark, tables, cubes):
    """Similar pixels by the likelihood ratio, windows cut at the border, pixels with a gap left out, lag mask; and strided windows."""
    from statistics import NormalDist

    limit = NormalDist().inv_cdf(1 - 0.001 / 2) ** 2
    rows = {(r["scene"], r["row"], r["col"]): r for r in QUERIES["k10_phase_link"](spark, tables).collect()}
    seen = 0
    for scene, cube in cubes.items():
        amplitude = np.where(np.abs(cube) > 0, np.abs(cube), np.nan)
        with np.errstate(all="ignore"):
            scale = (np.nanvar(amplitude, axis=0) + np.nanmean(amplitude, axis=0) ** 2) / 2
        whole = ~np.isnan(cube).any(axis=0)
        kept = np.where(whole, cube, np.nan)
        for row, col in np.ndindex(ROWS, COLS):
            near = {(a, b) for a in range(-2, 3) for b in range(-2, 3) if (a, b) != (0, 0) and 0 <= row + a < ROWS and 0 <= col + b < COLS}
            s = scale[row, col]
            near = {(a, b) for a, b in near if DATES * (2 * np.log((s + scale[row + a, col + b]) / 2) - np.log(s) - np.log(scale[row + a, col + b])) < limit and whole[row + a, col + b]}
            if not near or not whole[row, col]:
                assert (scene, row, col) not in rows
                continue
            c = coherence(kept, row, col, (2, 2), near)
            c = np.where(abs(np.subtract.outer(np.arange(DATES), np.arange(DATES))) < 5, c, 0)
            phases, _, ratio, estimator, _ = linked(c)
            r = rows[scene, row, col]
            assert r["estimator"] == estimator
            if ratio < 0.5:
                assert r["temp_coh"] == pytest.approx(fit(c, phases), abs=0.02)
                seen += 1
    assert seen > 20
    strided = {(r["scene"], r["row"], r["col"]): r for r in QUERIES["k11_phase_link_strided"](spark, tables).collect()}
    sure = 0
    for (scene, row, col), r in strided.items():
        cube = np.where(~np.isnan(cubes[scene]).any(axis=0), cubes[scene], np.nan)
        c = coherence(cube, row * 4 + 2, col * 5 + 2, (2, 3))
        phases, _, ratio, estimator, _ = linked(c)
        assert r["estimator"] == estimator
        if ratio < 0.5:
            assert r["temp_coh"] == pytest.approx(fit(c, phases), abs=0.02)
            sure += 1
    assert sure > 1


def test_least_absolute(spark, tables, cubes):
    """The sum of absolute residuals is near the least one that any exact fit of as many pairs as unknowns has."""
    import itertools

    rows = {}
    for r in QUERIES["k21_l1_inversion"](spark, tables).collect():
        rows.setdefault((r["scene"], r["row"], r["col"]), (r["residual"], {}))[1][r["t"]] = r["phase"]
    a = timeseries.matrix_of(NET)
    bases = [list(b) for b in itertools.combinations(range(len(NET)), DATES - 1)]
    bases = [b for b in bases if abs(np.linalg.det(a[b])) > 0.5]
    inverse = np.array([np.linalg.inv(a[b]) for b in bases])
    draw = np.random.default_rng(1).permutation(len(rows))[:40]
    for key in [sorted(rows)[k] for k in draw]:
        scene, row, col = key
        size = np.abs(cubes[scene][:, row, col])
        b = np.array([(size[j] - size[i]) / 10 + 0.01 * (i + j) for i, j in NET])
        best = np.abs(np.einsum("bij,bj->bi", inverse, b[np.array(bases)]) @ a.T - b).sum(axis=1).min()
        residual, solution = rows[key]
        assert residual == pytest.approx(np.abs(a @ np.array([solution[t] for t in range(DATES - 1)]) - b).sum(), abs=2e-3)
        assert best - 2e-3 <= residual <= 1.1 * best + 0.05


def test_goldstein(spark, tables, cubes):
    """Each output pixel is the blend of its patches, filtered one by one with explicit Fourier sums."""
    size, step, alpha = 8, 4, 0.5
    k = np.arange(size)
    f = np.exp(-2j * np.pi * np.outer(k, k) / size)
    side = np.concatenate([k[:step] / (step - 1), k[:step][::-1] / (step - 1)])
    window = np.outer(side, side)
    got = {}
    for r in QUERIES["x1_goldstein"](spark, tables).collect():
        got.setdefault((r["scene"], r["ref_t"], r["sec_t"]), {})[r["row"], r["col"]] = complex(r["re"], r["im"])
    assert got
    for (scene, a, b), pixels in got.items():
        cube = cubes[scene]
        image = np.nan_to_num(cube[a] * cube[b].conj())
        shape = (max(r for r, _ in pixels) + 1, max(c for _, c in pixels) + 1)
        image = image[: shape[0], : shape[1]]
        mirror = lambda x, n: (x if 0 <= x % (2 * n - 2) < n else 2 * n - 2 - x % (2 * n - 2)) % (2 * n - 2)
        starts = [range(-step, n + (step + -n % step) - size + 1, step) for n in shape]
        total, weight = np.zeros(shape, dtype=complex), np.zeros(shape)
        for r0 in starts[0]:
            for c0 in starts[1]:
                rows, cols = [mirror(r0 + x, shape[0]) for x in k], [mirror(c0 + x, shape[1]) for x in k]
                spectrum = f @ image[np.ix_(rows, cols)] @ f.T
                patch = f.conj() @ (spectrum * np.abs(spectrum) ** alpha) @ f.conj().T / size**2 * window
                for x in k:
                    for y in k:
                        if 0 <= r0 + x < shape[0] and 0 <= c0 + y < shape[1]:
                            total[r0 + x, c0 + y] += patch[x, y]
                            weight[r0 + x, c0 + y] += window[x, y]
        expected = np.where((image == 0) | (weight == 0), 0, total / np.maximum(weight, 1e-300))
        for at, value in pixels.items():
            assert abs(value - expected[at]) < 1e-6 * max(1.0, np.abs(expected).max())


def test_unwrapped(spark, tables, cubes):
    """The table form of the solver gives what the array form does."""
    got = {}
    for r in QUERIES["unwrap_builtin"](spark, tables).collect():
        got.setdefault((r["scene"], r["ref_t"], r["sec_t"]), {})[r["row"], r["col"]] = (r["unw"], r["conncomp"])
    for (scene, a, b), pixels in got.items():
        cube = cubes[scene]
        wrapped = np.angle(cube[a] * cube[b].conj())
        wrapped[np.isnan(cube[a]) | np.isnan(cube[b])] = np.nan
        wrapped = wrapped[: max(r for r, _ in pixels) + 1, : max(c for _, c in pixels) + 1]
        expected, _ = images.least_squares_unwrap(wrapped, np.ones_like(wrapped))
        assert len(pixels) == np.isfinite(wrapped).sum()
        off = np.array([value - expected[at] for at, (value, _) in pixels.items()])
        assert np.abs(off / (2 * np.pi) - np.rint(off / (2 * np.pi))).max() < 1e-6  # whole cycles, which a tie may move
        assert np.mean(np.abs(off) < 1e-6) > 0.99 and all(c == 1 for _, c in pixels.values())


def test_sequential(spark, tables, cubes):
    """The estimator's chain by hand: a batch, its compressed image, and the batch that carries it."""
    rows = {(r["scene"], r["row"], r["col"], r["t"]): r for r in QUERIES["st1_sequential"](spark, tables).collect()}
    for scene, cube in cubes.items():
        size = np.abs(cube)

        def chain(part, first_real):
            n = len(part)
            whole = ~np.isnan(part).any(axis=0)
            kept = np.where(whole, part, np.nan)
            phases, coh = np.full(part.shape, np.nan), np.full(part.shape[1:], np.nan)
            c = phaselink.stack_covariance(kept, (1, 1))
            for row, col in np.argwhere(whole):
                one = c[row, col].copy()
                np.fill_diagonal(one, 1)
                done = phaselink.link(one[None], looks=3.0, reference=max(0, first_real - 1), first_real=first_real)
                phases[:, row, col] = np.angle(done.vectors[0])
                coh[row, col] = phaselink.temporal_coherence(one[None], done.vectors)[0]
            assert n
            return phases, coh, whole

        def scatterers(dates):
            part = np.where(size[dates] > 0, size[dates], np.nan)
            with np.errstate(all="ignore"):
                spread = np.nanstd(part, axis=0) / np.nanmean(part, axis=0)
            return (spread > 0) & (spread < 0.25)

        first, second = [0, 1, 2, 3], [4, 5, 6]
        phases, coh, whole = chain(cube[first], 0)
        own = scatterers(first) & whole
        phases = np.where(own, np.angle(cube[first] * np.exp(-1j * np.angle(cube[0]))), phases)
        coh = np.where(own, 1, coh)
        mean = np.nanmean(np.where(size[first] > 0, size[first], np.nan), axis=0) if whole.any() else np.zeros((ROWS, COLS))
        summed = np.nansum(np.where(whole, cube[first] * np.exp(-1j * phases), 0), axis=0)
        image = np.where(whole, mean * np.exp(1j * np.angle(summed)), np.nan)
        later, coh2, whole2 = chain(np.concatenate([image[None], cube[second]]), 1)
        own2 = scatterers(first + second) & whole2
        turned_ = np.angle(cube[second] * np.exp(-1j * np.angle(image)))
        for row, col in np.ndindex(ROWS, COLS):
            for k, t in enumerate(first):
                if not whole[row, col]:
                    assert (scene, row, col, t) not in rows
                    continue
                r = rows[scene, row, col, t]
                assert abs(turned(r["phase"] - phases[k, row, col])) < 2e-3 and r["temp_coh"] == pytest.approx(coh[row, col], abs=2e-3)
            for k, t in enumerate(second):
                if not whole2[row, col]:
                    assert (scene, row, col, t) not in rows
                    continue
                r = rows[scene, row, col, t]
                expected = turned_[k, row, col] if own2[row, col] else later[k + 1, row, col]
                assert abs(turned(r["phase"] - expected)) < 5e-3
                assert r["temp_coh"] == pytest.approx(1 if own2[row, col] else coh2[row, col], abs=5e-3)


def test_baselines(spark, tables):
    """The distance of two orbits seen from a point, with the sign of the side, by a fine search over time."""
    rows = QUERIES["p16_baseline_grid"](spark, tables).collect()
    radius, turn = 7.07e6, 7500 / 7.07e6

    def at(t, r, lon):
        a = np.radians(45) + t * turn
        flat = r * np.cos(a)
        return np.stack([flat * np.cos(lon), flat * np.sin(lon), r * np.sin(a)], axis=-1)

    def nearest(point, r, lon):
        t = np.linspace(-60, 60, 4001)
        best = t[np.linalg.norm(at(t, r, lon) - point, axis=1).argmin()]
        t = np.linspace(best - 0.05, best + 0.05, 4001)
        return at(t, r, lon)[np.linalg.norm(at(t, r, lon) - point, axis=1).argmin()]

    a, e2 = 6378137.0, 6.69437999014e-3
    for row in rows[:: max(1, len(rows) // 20)]:
        lon, lat = np.radians(row["lon"]), np.radians(row["lat"])
        n = a / np.sqrt(1 - e2 * np.sin(lat) ** 2)
        point = np.array([(n + 100) * np.cos(lat) * np.cos(lon), (n + 100) * np.cos(lat) * np.sin(lon), (n * (1 - e2) + 100) * np.sin(lat)])
        p, q = nearest(point, radius, np.radians(5)), nearest(point, radius + 60, np.radians(5.001))
        look = (p - point) / np.linalg.norm(p - point)
        base = q - p
        across = np.linalg.norm(base - look * (base @ look))
        assert abs(row["baseline"]) == pytest.approx(across, abs=2.0)
