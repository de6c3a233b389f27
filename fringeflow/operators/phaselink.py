"""Phase linking: eigen-solvers, the estimator over coherence matrices, its lower bound and the pixel pipeline.

Kernels are NumPy over whole Arrow batches of pixels; frames carry a pixel's matrix as flat arrays of its pairs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOLERANCE, MOST_ROUNDS = 1e-5, 50
EVD, EMI = 0, 1


def _normed(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-300)


def _iterate(step, n_pixels: int, n: int) -> np.ndarray:
    """Fixed-point iteration from equal parts; pixels stop when their vector moves by TOLERANCE or less."""
    v = np.full((n_pixels, n), 1 / np.sqrt(n), dtype=complex)
    live = np.arange(n_pixels)
    for _ in range(MOST_ROUNDS):
        new = _normed(step(live, v[live]))
        moved = np.linalg.norm(new - v[live], axis=1)
        v[live] = new
        live = live[moved > TOLERANCE]
        if not len(live):
            break
    return v


def _rayleigh(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.einsum("pi,pij,pj->p", v.conj(), a, v).real


def largest_eigenpair(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalue and vector of the largest eigenvalue of each Hermitian matrix, by power iteration."""
    v = _iterate(lambda live, x: np.einsum("pij,pj->pi", a[live], x), *a.shape[:2])
    return _rayleigh(a, v), v


def nearest_eigenpair(a: np.ndarray, mu: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalue and vector nearest mu, by shifted inverse iteration with one factorisation per matrix."""
    n = a.shape[1]
    shifted = a - mu * np.eye(n)
    with np.errstate(all="ignore"):
        try:
            inverse = np.linalg.inv(shifted)
        except np.linalg.LinAlgError:
            inverse = np.linalg.pinv(shifted)

    def step(live, x):
        new = np.einsum("pij,pj->pi", inverse[live], x)
        # Vectors flip sign below mu; they count as the same.
        sign = np.sign(np.einsum("pi,pi->p", x.conj(), new).real)
        return new * np.where(sign == 0, 1, sign)[:, None]

    v = _iterate(step, *a.shape[:2])
    return _rayleigh(a, v), v


def _inverted(gamma: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inverses of |C| + 1e-6 I and whether the matrix was positive definite."""
    n = gamma.shape[1]
    jittered = gamma + 1e-6 * np.eye(n)
    good = np.linalg.eigvalsh(jittered)[:, 0] > 0
    out = np.full_like(jittered, np.nan)
    if good.any():
        out[good] = np.linalg.inv(jittered[good])
    return out, good


def lower_bound(gamma: np.ndarray, looks: float, reference: int, inverse: np.ndarray | None = None, aps_variance: float = 0.0) -> np.ndarray:
    """Cramer-Rao standard deviation of each date's phase relative to the reference, where it is 0.

    With aps_variance, atmospheric phase noise of that variance adds to every date."""
    inverse = _inverted(gamma)[0] if inverse is None else inverse
    n = gamma.shape[1]
    fisher = 2 * looks * (gamma * inverse - np.eye(n))
    keep = [i for i in range(n) if i != reference]
    if aps_variance > 0:
        theta = np.zeros((n, n - 1))
        theta[keep, range(n - 1)] = 1
        inner = np.linalg.inv(fisher + np.eye(n) / aps_variance)
        reduced = theta.T @ (fisher - fisher @ inner @ fisher) @ theta
    else:
        reduced = fisher[:, keep][:, :, keep]
    bad = ~np.isfinite(reduced).all(axis=(1, 2))
    reduced = np.where(bad[:, None, None], np.eye(n - 1), reduced) + 1e-6 * np.eye(n - 1)
    std = np.sqrt(np.maximum(np.diagonal(np.linalg.inv(reduced), axis1=1, axis2=2), 0))
    std[bad] = np.nan
    return np.insert(std, reference, 0.0, axis=1)


class Linked(NamedTuple):
    vectors: np.ndarray  # pixels x dates, phases relative to the reference
    eigenvalues: np.ndarray
    estimator: np.ndarray
    bound: np.ndarray | None


def link(c: np.ndarray, use_evd: bool = False, beta: float = 0.0, zero_threshold: float = 0.0, reference: int = 0, looks: float = 1.0, first_real: int = 0, with_bound: bool = True) -> Linked:
    """Phases from coherence matrices: EMI (the vector of inv(|C|) o C nearest 0.99, of norm sqrt n), or EVD (the
    dominant vector of C o |C|) on request and where |C| can't be inverted. The bound refers to the last compressed date."""
    n = c.shape[1]
    reference = reference % n
    gamma = np.abs(c)
    if beta > 0:
        gamma = (1 - beta) * gamma + beta * np.eye(n)
    if zero_threshold > 0:
        gamma = np.where(gamma < zero_threshold, 0.0, gamma)
    inverse, good = _inverted(gamma)
    if use_evd:
        good = np.zeros_like(good)
    vectors, values = np.empty(c.shape[:2], dtype=complex), np.empty(len(c))
    if good.any():
        values[good], v = nearest_eigenpair(inverse[good] * c[good], 0.99)
        vectors[good] = v * np.sqrt(n)
    if not good.all():
        values[~good], vectors[~good] = largest_eigenpair(c[~good] * gamma[~good])
    vectors = vectors * np.exp(-1j * np.angle(vectors[:, [reference]]))
    bound = lower_bound(gamma, looks, max(first_real - 1, 0), inverse) if with_bound else None
    return Linked(vectors, values, np.where(good, EMI, EVD), bound)


def temporal_coherence(c: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    i, j = np.triu_indices(c.shape[1], 1)
    off = np.exp(1j * (np.angle(c[:, i, j]) - np.angle(vectors[:, i] * vectors[:, j].conj())))
    return np.abs(np.nan_to_num(off).mean(axis=1)) if len(i) else np.zeros(len(c))


def dense_matrices(dates: pa.ListArray, re: pa.ListArray, im: pa.ListArray, n: int) -> np.ndarray:
    """Hermitian matrices (pixels x n x n, unit diagonal) from the flat arrays of packed matrices over dates 0 .. n - 1; missing pairs
    are 0. Pixels with the same dates, mostly all, are filled at once."""
    out = np.tile(np.eye(n, dtype=complex), (len(dates), 1, 1))
    flat = np.nan_to_num(re.flatten().to_numpy()) + 1j * np.nan_to_num(im.flatten().to_numpy())
    sizes, starts = dates.value_lengths().to_numpy(), np.concatenate([[0], np.cumsum(re.value_lengths().to_numpy())])
    axes, at = dates.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)])
    patterns: dict[bytes, list[int]] = {}
    for p in range(len(dates)):
        patterns.setdefault(axes[at[p] : at[p + 1]].tobytes(), []).append(p)
    for key, members in patterns.items():
        axis, which = np.frombuffer(key, dtype=axes.dtype), np.array(members)
        a, b = np.triu_indices(len(axis), 1)
        values = flat[starts[which][:, None] + np.arange(len(a))]
        out[which[:, None], axis[a], axis[b]] = values
        out[which[:, None], axis[b], axis[a]] = values.conj()
    return out


def _lists(values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.reshape(-1)))


def closures(c: np.ndarray) -> np.ndarray:
    """Of each matrix the closure phases of dates (k, k + 1, k + 2)."""
    k = np.arange(max(0, c.shape[1] - 2))
    return np.angle(c[:, k, k + 1] * c[:, k + 1, k + 2] * c[:, k, k + 2].conj())


SCHEMA = "row int, col int, phases array<double>, temp_coh double, eigenvalue double, estimator int, crlb array<double>, closures array<double>"


def linked_pixels(packed: DataFrame, n_dates: int, looks: float, lag: int | None = None, **options) -> DataFrame:
    """scene, row, col, phases (by date), temp_coh, eigenvalue, estimator, crlb and closures of each pixel's packed coherence matrix
    over dates 0 .. n - 1. Missing pairs count as 0, and so do those of dates `lag` or more apart."""
    scene = packed.schema["scene"].dataType.simpleString()

    def run(batches):
        far = None if lag is None else np.abs(np.subtract.outer(np.arange(n_dates), np.arange(n_dates))) >= lag
        for batch in batches:
            # A few hundred pixels at a time bound the matrices in memory.
            for start in range(0, batch.num_rows, 512):
                piece = batch.slice(start, 512)
                c = dense_matrices(*(piece.column(x) for x in ("dates", "re", "im")), n_dates)
                if far is not None:
                    c[:, far] = 0
                done = link(c, looks=looks, **options)
                bound = pa.nulls(len(c), pa.list_(pa.float64())) if done.bound is None else _lists(done.bound)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("scene"), piece.column("row"), piece.column("col"), _lists(np.angle(done.vectors)), pa.array(temporal_coherence(c, done.vectors)), pa.array(done.eigenvalues), pa.array(done.estimator.astype(np.int32)), bound, _lists(closures(c))],
                    ["scene", "row", "col", "phases", "temp_coh", "eigenvalue", "estimator", "crlb", "closures"],
                )

    return packed.select("scene", "row", "col", "dates", "re", "im").mapInArrow(run, f"scene {scene}, {SCHEMA}")


def phases_long(linked: DataFrame) -> DataFrame:
    return linked.select("scene", "row", "col", F.posexplode("phases").alias("t", "phase"))


def run_phase_linking(stack: DataFrame, n_dates: int, half_window: tuple[int, int], strides: tuple[int, int] = (1, 1), edges: DataFrame | None = None, lag: int | None = None, **options) -> DataFrame:
    """Window coherence, optional lag mask, and linking; pixels with any missing date are nodata and left out first. edges: see
    packed_matrix; their row and col are output pixels."""
    from fringeflow.operators.coherence import packed_matrix
    from fringeflow.operators.grid import rectangle
    from fringeflow.operators.masks import complete_in_time

    keys = ["scene", "row", "col"]
    whole = complete_in_time(stack, n_dates, keys).filter("valid").select(*keys)
    packed = packed_matrix(stack.join(whole, keys, "left_semi"), rectangle(*half_window), strides, edges)
    return linked_pixels(packed, n_dates, float(np.sqrt((2 * half_window[0] + 1) * (2 * half_window[1] + 1))), lag, **options)


@dataclass(frozen=True)
class LinkOptions:
    """How a stack is linked, in one batch or many. shp_dates: how many dates the amplitude statistics stand for, by default those of
    the linked stack. fill_ps: "max" takes the phase of a look's brightest scatterer, "avg" that of their sum, None
    leaves scatterers as they are. slc_amplitude: the amplitude of the look's middle pixel in place of 1."""

    half_window: tuple[int, int] = (7, 14)
    strides: tuple[int, int] = (1, 1)
    shp_method: str = "rect"
    shp_alpha: float = 0.001
    shp_dates: int | None = None
    lag: int | None = None
    use_evd: bool = False
    beta: float = 0.0
    zero_threshold: float = 0.0
    mask_input_ps: bool = False
    fill_ps: str | None = "max"
    slc_amplitude: bool = False
    with_bound: bool = True


class LinkedStack(NamedTuple):
    """dates: scene, row, col, t, re, im, temp_coh; pixels: the arrays that linked_pixels returns."""

    dates: DataFrame
    pixels: DataFrame


def link_stack(stack: DataFrame, n_dates: int, options: LinkOptions, stats: DataFrame | None = None, reference: int = 0, first_real: int = 0, keep: Callable[[DataFrame], DataFrame] | None = None) -> LinkedStack:
    """All of phase linking for dates 0 .. n - 1 of a stack: similar pixels, coherence, linking, scatterers filled in, amplitude.

    stats: scene, row, col, mean, dispersion, ps of the amplitude; needed for glrt, and for scatterers to be masked or
    filled; ks takes amplitudes from first_real on. keep: writes the linked pixels and reads them again, so that
    what is made from them doesn't link anew. A look whose
    pixels all miss a date isn't returned; one without similar pixels has a temp_coh of 0 and phases of 0, unless
    a scatterer fills it."""
    from fringeflow.operators import ps, shp
    from fringeflow.operators.masks import complete_in_time

    keys, (sy, sx) = ["scene", "row", "col"], options.strides
    whole = complete_in_time(stack, n_dates, keys).filter("valid").select(*keys)
    stack = stack.join(whole, keys, "left_semi")
    used = stack.join(stats.filter("ps").select(*keys), keys, "left_anti") if options.mask_input_ps and stats is not None else stack
    edges = None
    if options.shp_method != "rect":
        real = stack.filter(F.col("t") >= first_real)
        var = None if stats is None else stats.select(*keys, "mean", ((F.col("dispersion") * F.col("mean")) ** 2).alias("var"))
        edges = shp.estimate(options.shp_method, options.half_window, var, real, options.shp_dates or n_dates - first_real, options.shp_alpha, options.strides)
    pixels = run_phase_linking(
        used, n_dates, options.half_window, options.strides, edges, options.lag,
        use_evd=options.use_evd, beta=options.beta, zero_threshold=options.zero_threshold, reference=reference, first_real=first_real, with_bound=options.with_bound,
    )
    pixels = pixels if keep is None else keep(pixels)
    looks = whole.select("scene", F.floor(F.col("row") / sy).cast("int").alias("row"), F.floor(F.col("col") / sx).cast("int").alias("col")).distinct()
    phases = F.coalesce("phases", F.array_repeat(F.lit(0.0), n_dates))
    every = looks.join(pixels.select(*keys, "phases", "temp_coh"), keys, "left").select(*keys, F.coalesce("temp_coh", F.lit(0.0)).alias("temp_coh"), F.posexplode(phases).alias("t", "phase"))
    dates = every.select("scene", "t", "row", "col", F.cos("phase").alias("re"), F.sin("phase").alias("im"), "temp_coh")
    if options.fill_ps and stats is not None:
        dates = ps.filled(dates, stack, stats, sy, sx, None, reference, options.fill_ps)
    if options.slc_amplitude:
        middle = [(F.col(c) - (s // 2 if s > 1 else 0)) for c, s in (("row", sy), ("col", sx))]
        own = stack.filter((F.pmod(middle[0], F.lit(sy)) == 0) & (F.pmod(middle[1], F.lit(sx)) == 0))
        size = own.select("scene", "t", F.floor(middle[0] / sy).cast("int").alias("row"), F.floor(middle[1] / sx).cast("int").alias("col"), F.sqrt(F.col("re") ** 2 + F.col("im") ** 2).alias("size"))
        dates = dates.join(size, ["scene", "t", "row", "col"], "left").withColumns({c: F.col(c) * F.col("size") for c in ("re", "im")}).drop("size")
    return LinkedStack(dates.select(*keys, "t", "re", "im", "temp_coh"), pixels)


def stack_covariance(stack: np.ndarray, half_window: tuple[int, int], strides: tuple[int, int] = (1, 1)) -> np.ndarray:
    """Coherence of a dense tile (dates x rows x cols, NaN: nodata) at the looks' middles, windows cut at the border:
    (rows, cols, dates, dates). The tile form for windows too large to explode."""
    n, rows, cols = stack.shape
    (hy, hx), (sy, sx) = half_window, strides
    z = np.nan_to_num(stack)
    pad = np.pad(z, ((0, 0), (hy, hy), (hx, hx)))
    r = np.arange(rows // sy) * sy + (sy // 2 if sy > 1 else 0)
    c = np.arange(cols // sx) * sx + (sx // 2 if sx > 1 else 0)
    view = np.lib.stride_tricks.sliding_window_view(pad, (2 * hy + 1, 2 * hx + 1), axis=(1, 2))[:, r][:, :, c]
    flat = view.reshape(n, len(r), len(c), -1).transpose(1, 2, 0, 3)
    cross = flat @ flat.conj().swapaxes(-1, -2)
    power = np.einsum("rcii->rci", cross).real
    scale = np.sqrt(power[..., :, None] * power[..., None, :])
    return np.where(scale > 1e-6, cross / np.maximum(scale, 1e-300), 0)


def prune_unconnected(window: np.ndarray) -> np.ndarray:
    """A boolean window without the neighbours that no 8-connected path ties to its middle."""
    out = np.zeros_like(window)
    todo = [(window.shape[0] // 2, window.shape[1] // 2)]
    seen = set(todo)
    while todo:
        r, c = todo.pop()
        for a in range(max(0, r - 1), min(window.shape[0], r + 2)):
            for b in range(max(0, c - 1), min(window.shape[1], c + 2)):
                if window[a, b] and (a, b) not in seen:
                    seen.add((a, b))
                    out[a, b] = True
                    todo.append((a, b))
    return out


def pruned(edges: DataFrame, half_window: tuple[int, int]) -> DataFrame:
    """edges (scene, row, col, dr, dc) without those that prune_unconnected drops."""
    shape = (2 * half_window[0] + 1, 2 * half_window[1] + 1)

    def run(frames):
        import pandas as pd

        for frame in frames:
            out = []
            for x in frame.itertuples(index=False):
                window = np.zeros(shape, dtype=bool)
                for o in x.offsets:
                    window[o["dr"] + half_window[0], o["dc"] + half_window[1]] = True
                out += [(x.scene, x.row, x.col, int(a) - half_window[0], int(b) - half_window[1]) for a, b in np.argwhere(prune_unconnected(window))]
            yield pd.DataFrame(out, columns=["scene", "row", "col", "dr", "dc"])

    packed = edges.groupBy("scene", "row", "col").agg(F.collect_list(F.struct("dr", "dc")).alias("offsets"))
    return packed.mapInPandas(run, "scene int, row int, col int, dr int, dc int")
