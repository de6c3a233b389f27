"""Goldstein filter, long-wavelength removal and unwrapping: kernels over arrays, and the same over tables of pixels, where no task
holds an image. The filter works on tiles with a halo; transforms of whole images go along rows, then along columns.
Only solvers that are registered from elsewhere get an image at once."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringeflow.functions.scalars import gaussian_sigma
from fringeflow.operators.grid import each_group, tile_map
from fringeflow.operators.interp import nearest_value
from fringeflow.tables import materialise


def triangle(size: int) -> np.ndarray:
    """Weights that rise from 0 at the border of a patch to 1 in its middle, along both axes."""
    half = size // 2
    rise = np.arange(half) / (half - 1)
    side = np.concatenate([rise, rise[::-1]])
    return np.outer(side, side)


def _blended(padded: np.ndarray, alpha: float, size: int) -> np.ndarray:
    """Filtered patches at each multiple of half a patch, blended."""
    step, window = size // 2, triangle(size)
    patches = np.lib.stride_tricks.sliding_window_view(padded, (size, size))[::step, ::step]
    spectrum = np.fft.fft2(patches)
    smooth = np.fft.ifft2(spectrum * np.abs(spectrum) ** alpha) * window
    out, weight = np.zeros_like(padded, dtype=complex), np.zeros(padded.shape)
    for a in range(patches.shape[0]):
        for b in range(patches.shape[1]):
            at = (slice(a * step, a * step + size), slice(b * step, b * step + size))
            out[at] += smooth[a, b]
            weight[at] += window
    return np.divide(out, weight, out=np.zeros_like(out), where=weight > 0)


def goldstein(image: np.ndarray, alpha: float, size: int = 32, at: tuple[int, int] = (0, 0), shape: tuple[int, int] | None = None) -> np.ndarray:
    """Patches of half overlap whose spectrum is weighted by its own magnitude to the power alpha, blended by triangles.

    Real input is taken as phase. Zero and NaN pixels come out 0; an image of nothing else is returned as it is. With
    `at` and `shape`, image is the part of an image of that shape that starts at the row and column `at`, multiples of
    half a patch; its pixels a patch or more away from a cut are as in the whole."""
    if alpha < 0:
        raise ValueError(f"alpha must not be negative: {alpha}")
    data = np.asarray(image) if np.iscomplexobj(image) else np.exp(1j * np.asarray(image))
    empty = np.isnan(data) | (data == 0)
    if empty.all():
        return data
    step = size // 2
    # Mirrored at the image's own borders, not at cuts.
    before = [0 if first else step for first in at]
    after = [step + -n % step if first + m >= n else 0 for m, first, n in zip(data.shape, at, shape or data.shape, strict=True)]
    padded = np.pad(data, tuple(zip(before, after, strict=True)), mode="reflect")
    out = _blended(padded, alpha, size)[before[0] : before[0] + data.shape[0], before[1] : before[1] + data.shape[1]]
    return np.where(empty, 0, out)


def nearest_filled(values: np.ndarray, bad: np.ndarray, reach: int) -> np.ndarray:
    """Bad pixels take the nearest good one's value within `reach` pixels, else 0: rings grow from the good pixels, in order of distance."""
    out = np.where(bad, 0.0, values)
    if not bad.any() or bad.all():
        return out
    best = np.where(bad, np.inf, 0.0)
    rows, cols = values.shape
    limit = min(reach, max(rows, cols))
    offsets = sorted((r * r + c * c, r, c) for r in range(-limit, limit + 1) for c in range(-limit, limit + 1) if 0 < r * r + c * c <= reach * reach)
    for d2, r, c in offsets:
        if abs(r) >= rows or abs(c) >= cols:
            continue
        to = (slice(max(0, -r), rows - max(0, r)), slice(max(0, -c), cols - max(0, c)))
        of = (slice(max(0, r), rows - max(0, -r)), slice(max(0, c), cols - max(0, -c)))
        take = ~bad[of] & (best[to] > d2)
        out[to] = np.where(take, values[of], out[to])
        best[to] = np.where(take, d2, best[to])
        if not np.isinf(best).any():
            break
    return out


def without_long_waves(phase: np.ndarray, bad: np.ndarray, cutoff: float, spacing: float, fill_value: float | None = None) -> np.ndarray:
    """phase less its Gaussian low-pass (half response at the cutoff wavelength); bad pixels are filled before. NaN and 0 are nodata."""
    sigma = gaussian_sigma(cutoff, spacing)
    if sigma > min(phase.shape):
        raise ValueError(f"a cutoff of {cutoff} is too long for {phase.shape} pixels of {spacing}")
    values = np.nan_to_num(phase)
    inside = values != 0
    filled = nearest_filled(values, bad, int(cutoff / 2 / spacing))
    response = [np.exp(-2 * (np.pi * sigma * np.fft.fftfreq(n)) ** 2) for n in phase.shape]
    low = np.fft.ifft2(np.fft.fft2(filled) * np.outer(*response)).real
    out = (filled - low) * inside
    return out if fill_value is None else np.where(inside & ~bad, out, fill_value)


class Unwrapper(Protocol):
    """A wrapped phase image (NaN: nodata) and its correlation give the unwrapped phase and component labels."""

    def __call__(self, wrapped: np.ndarray, correlation: np.ndarray) -> tuple[np.ndarray, np.ndarray]: ...


def _turned(d: np.ndarray) -> np.ndarray:
    return (d + np.pi) % (2 * np.pi) - np.pi


def _bend(lines: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Along each line the difference of the wrapped steps before and after a pixel; a step with an invalid end is 0."""
    steps = np.pad(np.where(valid[:, 1:] & valid[:, :-1], _turned(np.diff(lines, axis=1)), 0.0), ((0, 0), (1, 1)))
    return np.diff(steps, axis=1)


def cosine(lines: np.ndarray) -> np.ndarray:
    """Of each line the sums over j of x[j] cos(pi / n (j + 1/2) k)."""
    n = lines.shape[1]
    both = np.fft.fft(np.concatenate([lines, lines[:, ::-1]], axis=1), axis=1)[:, :n]
    return (both * np.exp(-0.5j * np.pi / n * np.arange(n))).real / 2


def inverse_cosine(lines: np.ndarray) -> np.ndarray:
    n = lines.shape[1]
    half = 2 * lines * np.exp(0.5j * np.pi / n * np.arange(n))
    mirrored = np.concatenate([half, np.zeros((len(lines), 1)), half[:, :0:-1].conj()], axis=1)
    return np.fft.ifft(mirrored, axis=1).real[:, :n]


def _solved(spectrum: np.ndarray, row: np.ndarray, rows: int, col: np.ndarray, cols: int) -> np.ndarray:
    """The spectrum of Poisson's solution: divided by the Laplacian's eigenvalues, without a constant."""
    eigen = 2 * np.cos(np.pi * row / rows) + 2 * np.cos(np.pi * col / cols) - 4
    return np.divide(spectrum, eigen, out=np.zeros_like(spectrum), where=(row != 0) | (col != 0))


def least_squares_unwrap(wrapped: np.ndarray, correlation: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Poisson's equation on the wrapped differences by cosine transforms, made congruent with the wrapped phase.

    Exact where no residue lies; not a substitute for network-flow solvers. One component: the valid pixels."""
    valid = np.isfinite(wrapped)
    phase = np.where(valid, wrapped, 0.0)
    rows, cols = phase.shape
    rho = _bend(phase, valid) + _bend(phase.T, valid.T).T
    spectrum = cosine(cosine(rho).T).T
    smooth = inverse_cosine(inverse_cosine(_solved(spectrum, np.arange(rows)[:, None], rows, np.arange(cols)[None, :], cols)).T).T
    whole = phase + 2 * np.pi * np.rint((smooth + (phase - smooth)[valid].mean() - phase) / (2 * np.pi)) if valid.any() else phase
    return np.where(valid, whole, np.nan), valid.astype(int)


#: Solvers by name; those of other packages are added by register().
UNWRAPPERS: dict[str, Callable] = {"least_squares": least_squares_unwrap}
#: Names of solvers that want interferograms of a single reference.
SINGLE_REFERENCE: set[str] = set()


def register(name: str, solver: Unwrapper, single_reference: bool = False) -> None:
    UNWRAPPERS[name] = solver
    if single_reference:
        SINGLE_REFERENCE.add(name)


def unwrapper(name: str) -> Callable:
    if name not in UNWRAPPERS:
        raise NotImplementedError(f"no unwrapper {name} is registered; known: {', '.join(UNWRAPPERS)}")
    return UNWRAPPERS[name]


def _grids(frame, columns: list[str]) -> list[np.ndarray]:
    shape = (int(frame["row"].max()) + 1, int(frame["col"].max()) + 1)
    out = []
    for c in columns:
        grid = np.full(shape, np.nan)
        grid[frame["row"], frame["col"]] = frame[c].astype(float)
        out.append(grid)
    return out


def each_image(images: DataFrame, keys: list[str], columns: list[str], fn: Callable[..., dict[str, np.ndarray]], outputs: list[str]) -> DataFrame:
    """fn(grids of the columns) -> grids by name, for each image; pixels that the image lacks are NaN for fn and not returned.

    An image is one task's unit here, because its kernel couples all its pixels; a stack's images run in parallel."""
    kinds = dict(images.dtypes)

    def run(frame):
        done = fn(*_grids(frame, columns))
        out = frame[[*keys, "row", "col"]].copy()
        for name in outputs:
            found = done[name][frame["row"], frame["col"]]
            out[name] = np.where(np.isnan(found), None, found) if found.dtype.kind == "f" else found.astype(float)
        return out

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in [*keys, "row", "col"]), *(f"{n} double" for n in outputs)])
    return images.groupBy(*keys).applyInPandas(run, schema)


def shapes(images: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_rows, n_cols: the extent of each image from row and column 0."""
    return images.groupBy(*keys).agg((F.max("row") + 1).alias("n_rows"), (F.max("col") + 1).alias("n_cols"))


def dense(images: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, row, col, n_rows, n_cols, columns with a row for each pixel of each image's extent; null where the image has none."""
    extent = shapes(images, keys)
    lines = extent.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1))).repartition(*keys, "row")
    every = lines.withColumn("col", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)))
    return every.join(images.select(*keys, "row", "col", *columns), [*keys, "row", "col"], "left")


def each_line(pixels: DataFrame, keys: list[str], along: str, columns: list[str], fn: Callable[..., dict[str, np.ndarray]], outputs: list[str]) -> DataFrame:
    """keys, row, col, outputs: fn(lines x length arrays of the columns) -> arrays by name, for the rows (along col) or columns
    (along row) of dense images. Lines of one length are handed over together; a line is the unit of a task."""
    across = "row" if along == "col" else "col"
    kinds = dict(pixels.dtypes)
    line = pixels.groupBy(*keys, across).agg(F.sort_array(F.collect_list(F.struct(along, *(F.col(c).cast("double").alias(c) for c in columns)))).alias("line"))
    packed = line.select(*keys, across, *(F.col(f"line.{c}").alias(c) for c in columns))

    def run(batches):
        for batch in batches:
            sizes = batch.column(columns[0]).value_lengths().to_numpy()
            for n in np.unique(sizes):
                some = pa.RecordBatch.from_arrays(batch.columns, batch.schema.names).filter(pa.array(sizes == n))
                done = fn(*(some.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, n) for c in columns))
                ends = pa.array(np.arange(some.num_rows + 1) * n, pa.int32())
                yield pa.RecordBatch.from_arrays([*(some.column(k) for k in [*keys, across]), *(pa.ListArray.from_arrays(ends, pa.array(done[name].reshape(-1))) for name in outputs)], [*keys, across, *outputs])

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in [*keys, across]), *(f"{name} array<double>" for name in outputs)])
    found = packed.mapInArrow(run, schema).select(*keys, across, F.posexplode(F.arrays_zip(*outputs)).alias(along, "__o"))
    return found.select(*keys, "row", "col", *(F.col(f"__o.{name}").alias(name) for name in outputs))


def goldstein_images(ifgs: DataFrame, keys: list[str], alpha: float = 0.5, size: int = 32, tile: int = 512) -> DataFrame:
    """goldstein() of each image, tile by tile: a tile's pixels only depend on those within a patch."""
    step = size // 2
    tile = max(step, tile // step * step)
    kinds = dict(ifgs.dtypes)

    def fn(frame):
        shape = (int(frame["n_rows"].iloc[0]), int(frame["n_cols"].iloc[0]))
        at = tuple(max(0, int(frame[c].iloc[0]) * tile - size) for c in ("tile_row", "tile_col"))
        end = tuple(min(n, (int(frame[c].iloc[0]) + 1) * tile + size) for n, c in zip(shape, ("tile_row", "tile_col"), strict=True))
        part = np.zeros((end[0] - at[0], end[1] - at[1]), dtype=complex)
        part[frame["row"] - at[0], frame["col"] - at[1]] = np.nan_to_num(frame["re"].astype(float)) + 1j * np.nan_to_num(frame["im"].astype(float))
        found = goldstein(part, alpha, size, at, shape)[frame["row"] - at[0], frame["col"] - at[1]]
        out = frame[[*keys, "row", "col"]].copy()
        out["re"], out["im"] = found.real, found.imag
        return out

    rows = ifgs.select(*keys, "row", "col", "re", "im").join(shapes(ifgs, keys), keys)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in [*keys, "row", "col"]), "re double", "im double"])
    return tile_map(rows, fn, schema, (tile, tile), (size, size), keys)


def long_wave_images(unw: DataFrame, keys: list[str], value: str, cutoff: float, spacing: float, bad: str | None = None) -> DataFrame:
    """without_long_waves() of each image: gaps are filled by a search over pixels, and the low-pass goes along rows, then columns."""
    sigma, reach = gaussian_sigma(cutoff, spacing), int(cutoff / 2 / spacing)

    def low(lines):
        n = lines.shape[1]
        if sigma > n:
            raise ValueError(f"a cutoff of {cutoff} is too long for {n} pixels of {spacing}")
        return {"__low": np.fft.ifft(np.fft.fft(lines, axis=1) * np.exp(-2 * (np.pi * sigma * np.fft.fftfreq(n)) ** 2), axis=1).real}

    own = F.when(F.isnan(value), F.lit(None)).otherwise(F.col(value).cast("double"))
    grid = dense(unw.select(*keys, "row", "col", own.alias("__v"), (F.coalesce(F.col(bad).cast("double"), F.lit(0.0)) > 0 if bad else F.lit(False)).alias("__bad")), keys, ["__v", "__bad"])
    grid = materialise(grid.withColumn("__gap", F.col("__v").isNull() | F.col("__bad")), "grid", keep=True)
    points = grid.filter("NOT __gap").select(*keys, "row", "col", F.struct(F.col("__v").alias("v"), F.col("row").alias("r"), F.col("col").alias("c")).alias("__near"))
    near = nearest_value(grid.filter("__gap"), points, keys, "__near", bucket=max(1, min(reach, 64) // 2), reach=reach)
    distance = (F.col("row") - F.col("__near.r")) ** 2 + (F.col("col") - F.col("__near.c")) ** 2
    close = near.filter(distance <= reach * reach).select(*keys, "row", "col", F.col("__near.v").alias("__n"))
    filled = grid.join(close, [*keys, "row", "col"], "left").withColumn("__f", F.when(F.col("__gap"), F.coalesce("__n", F.lit(0.0))).otherwise(F.col("__v")))
    filled = materialise(filled.select(*keys, "row", "col", "__v", "__f"), "filled", keep=True)
    smooth = each_line(each_line(filled, keys, "col", ["__f"], low, ["__low"]), keys, "row", ["__low"], low, ["__low"])
    out = filled.filter("__v IS NOT NULL").join(smooth, [*keys, "row", "col"])
    out = out.select(*keys, "row", "col", F.when(F.col("__v") != 0, F.col("__f") - F.col("__low")).otherwise(F.lit(0.0)).alias("__out"))
    # Pixels without a value are 0, as every pixel outside.
    return unw.select(*keys, "row", "col").join(out, [*keys, "row", "col"], "left").select(*keys, "row", "col", F.coalesce("__out", F.lit(0.0)).alias(value))


def least_squares_stack(wrapped: np.ndarray) -> np.ndarray:
    """least_squares_unwrap() of images of one shape (images x rows x cols) at once."""
    m, rows, cols = wrapped.shape
    valid = np.isfinite(wrapped)
    phase = np.where(valid, wrapped, 0.0)
    turned = lambda x: x.swapaxes(1, 2)
    lines = lambda fn, *x: fn(*(a.reshape(-1, a.shape[2]) for a in x)).reshape(m, x[0].shape[1], -1)
    rho = lines(_bend, phase, valid) + turned(lines(_bend, turned(phase), turned(valid)))
    spectrum = lines(cosine, turned(lines(cosine, turned(rho))))
    spectrum = _solved(spectrum, np.arange(rows)[None, :, None], rows, np.arange(cols)[None, None, :], cols)
    smooth = turned(lines(inverse_cosine, turned(lines(inverse_cosine, spectrum))))
    n = np.maximum(valid.sum(axis=(1, 2), keepdims=True), 1)
    level = np.where(valid, phase - smooth, 0.0).sum(axis=(1, 2), keepdims=True) / n
    return np.where(valid, phase + 2 * np.pi * np.rint((smooth + level - phase) / (2 * np.pi)), np.nan)


#: Places of an image that is solved at once, and of the images that are solved together.
SMALL = 1 << 18


def _least_squares_images(wrapped: DataFrame, keys: list[str]) -> DataFrame:
    """least_squares_unwrap() of each image: those of SMALL places or fewer at once, many in a call; larger ones along rows and
    columns in turn, so that no task holds one of them."""
    at, kinds = [*keys, "row", "col"], dict(wrapped.dtypes)
    phase = F.when(F.isnan("phase"), F.lit(None)).otherwise(F.col("phase"))
    rows = materialise(wrapped.select(*at, phase.cast("double").alias("phase")), "wrapped", keep=True)
    extent = shapes(rows, keys)
    large = materialise(extent.filter(F.col("n_rows").cast("long") * F.col("n_cols") > SMALL).select(*keys), "large", keep=True)
    if large.isEmpty():
        return _small_images(rows, keys)
    # Keys may be null, which no join finds.
    same = [rows[k].eqNullSafe(large[k]) for k in keys]
    return _small_images(rows.join(large, same, "left_anti"), keys).unionByName(_large_images(rows.join(large, same, "left_semi"), keys, kinds))


def _small_images(wrapped: DataFrame, keys: list[str]) -> DataFrame:
    at, kinds = [*keys, "row", "col"], dict(wrapped.dtypes)

    def fn(table, starts):
        group = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        row, col = (table.column(c).to_numpy().astype(np.int64) for c in ("row", "col"))
        given = table.column("phase")
        values = given.fill_null(np.nan).to_numpy()
        shape = np.stack([np.maximum.reduceat(x, starts[:-1]) + 1 for x in (row, col)], axis=1)
        unw = np.full(len(group), np.nan)
        for height, width in np.unique(shape, axis=0).tolist():
            images = np.flatnonzero((shape == (height, width)).all(axis=1))
            step = max(1, SMALL // (height * width))
            for some in (images[k : k + step] for k in range(0, len(images), step)):
                place = np.full(len(shape), -1)
                place[some] = np.arange(len(some))
                mine = np.flatnonzero(place[group] >= 0)
                stack = np.full((len(some), height, width), np.nan)
                where = (place[group[mine]], row[mine], col[mine])
                stack[where] = values[mine]
                unw[mine] = least_squares_stack(stack)[where]
        there = given.is_valid().to_numpy()
        yield pa.table([*(table.column(c) for c in at), pa.array(unw, mask=~there), pa.array(there.astype(float))], names=[*at, "unw", "conncomp"])

    return each_group(wrapped, keys, fn, ", ".join([*(f"`{c}` {kinds[c]}" for c in at), "unw double, conncomp double"]))


def _large_images(wrapped: DataFrame, keys: list[str], kinds: dict[str, str]) -> DataFrame:
    at, phase = [*keys, "row", "col"], F.col("phase")
    grid = materialise(dense(wrapped.select(*at, phase.alias("phase")), keys, ["phase"]), "grid", keep=True)
    whole = grid.select(*at, "n_rows", F.coalesce("phase", F.lit(0.0)).alias("p"), F.col("phase").isNotNull().cast("double").alias("ok"))

    def bend(p, ok):
        return {"rho_c": _bend(p, ok > 0)}

    def first(p, ok, rho_c):
        return {"s": cosine(_bend(p, ok > 0) + rho_c)}

    def second(s, row, n_rows):
        n = s.shape[1]
        return {"s": inverse_cosine(_solved(cosine(s), row, n_rows, np.broadcast_to(np.arange(n), s.shape), n))}

    def last(s):
        return {"smooth": inverse_cosine(s)}

    bent = each_line(whole, keys, "col", ["p", "ok"], bend, ["rho_c"])
    spectrum = each_line(whole.join(bent, at), keys, "row", ["p", "ok", "rho_c"], first, ["s"])
    placed = spectrum.join(shapes(wrapped, keys), keys).select(*at, "s", F.col("row").cast("double").alias("at"), F.col("n_rows").cast("double").alias("n_rows"))
    smooth = each_line(each_line(placed, keys, "col", ["s", "at", "n_rows"], second, ["s"]), keys, "row", ["s"], last, ["smooth"])
    both = materialise(wrapped.select(*at, phase.alias("phase")).join(smooth, at, "left"), "smooth", keep=True)
    level = both.filter("phase IS NOT NULL").groupBy(*keys).agg(F.avg(F.col("phase") - F.col("smooth")).alias("level"))
    turns = F.rint((F.col("smooth") + F.col("level") - F.col("phase")) / F.lit(2 * np.pi))
    out = both.join(level, keys, "left").select(*at, (F.col("phase") + F.lit(2 * np.pi) * turns).alias("unw"), F.col("phase").isNotNull().cast("double").alias("conncomp"))
    return out.select(*(F.col(c).cast(kinds[c]).alias(c) for c in at), "unw", "conncomp")


def unwrapped_images(wrapped: DataFrame, keys: list[str], method: str = "least_squares") -> DataFrame:
    """unw and conncomp of each image's phase and correlation. A registered solver gets an image at once, in one task."""
    solve = unwrapper(method)
    if solve is least_squares_unwrap:
        return _least_squares_images(wrapped, keys)

    def fn(phase, correlation):
        unw, label = solve(phase, correlation)
        return {"unw": unw, "conncomp": label.astype(float)}

    return each_image(wrapped, keys, ["phase", "correlation"], fn, ["unw", "conncomp"])
