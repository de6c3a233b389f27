"""Interferograms, coherence matrices over windows, closure phases, temporal coherence and phase similarity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fringeflow.functions.cx import Cx, angle, cx, expj, magnitude, mul_conj, unit
from fringeflow.operators.grid import Offset, each_group, neighbours

PIXEL = ["scene", "row", "col"]
LEAST_POWER = 1e-6


def interferograms(stack: DataFrame, edges: DataFrame) -> DataFrame:
    """scene, ref_t, sec_t, row, col, re, im: reference times the conjugate of the secondary."""
    ref = stack.select("scene", F.col("t").alias("ref_t"), "row", "col", F.col("re").alias("re1"), F.col("im").alias("im1"))
    sec = stack.select("scene", F.col("t").alias("sec_t"), "row", "col", F.col("re").alias("re2"), F.col("im").alias("im2"))
    pairs = ref.join(edges, ["scene", "ref_t"]).join(sec, ["scene", "sec_t", "row", "col"])
    return pairs.select("scene", "ref_t", "sec_t", "row", "col", *mul_conj(cx(suffix="1"), cx(suffix="2")).aliased())


def reformed(single_reference: DataFrame, edges: DataFrame) -> DataFrame:
    """The wrapped interferogram of each edge from single-reference ones (scene, t, row, col, re, im): conj(a) * b of their ends."""
    a = single_reference.select("scene", F.col("t").alias("ref_t"), "row", "col", F.col("re").alias("re1"), F.col("im").alias("im1"))
    b = single_reference.select("scene", F.col("t").alias("sec_t"), "row", "col", F.col("re").alias("re2"), F.col("im").alias("im2"))
    both = a.join(edges, ["scene", "ref_t"]).join(b, ["scene", "sec_t", "row", "col"])
    return both.select("scene", "ref_t", "sec_t", "row", "col", angle(mul_conj(cx(suffix="2"), cx(suffix="1"))).alias("phase"))


def as_vectors(stack: DataFrame) -> DataFrame:
    """scene, row, col, samples: array of (t, re, im) by date."""
    return stack.groupBy(*PIXEL).agg(F.sort_array(F.collect_list(F.struct("t", "re", "im"))).alias("samples"))


#: Output pixels of a tile and side: about this many input pixels.
TILE = 64


def window_sums(images: np.ndarray, rows: np.ndarray, cols: np.ndarray, offsets: list[Offset], allowed: np.ndarray | None = None) -> np.ndarray:
    """Sums over the windows around rows x cols of images (any x height x width), which must hold all the windows: (any, rows, cols).
    A whole rectangle is summed along rows, then columns. allowed: offsets x rows x cols, which pixels count."""
    drs, dcs = sorted({r for r, _ in offsets}), sorted({c for _, c in offsets})
    if allowed is None and len(offsets) == len(drs) * len(dcs):
        first = sum(images[:, rows + d] for d in drs)
        return sum(first[:, :, cols + d] for d in dcs)
    out = np.zeros((len(images), len(rows), len(cols)), dtype=images.dtype)
    for k, (r, c) in enumerate(offsets):
        part = images[:, (rows + r)[:, None], (cols + c)[None, :]]
        out += part if allowed is None else np.where(allowed[k], part, 0)
    return out


def tile_coherence(cube: np.ndarray, rows: np.ndarray, cols: np.ndarray, offsets: list[Offset], allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of a dense tile (dates x height x width, NaN: nodata) the coherence of each pair of dates i < j over the windows around
    rows x cols (pairs x rows x cols, in the order of np.triu_indices; NaN where no pixel has both dates), and which dates a window
    has (dates x rows x cols). Products are formed for one date with the later ones at a time, so memory is that of the dates, not of the pairs."""
    n, (top, left) = len(cube), (max(0, -min(o[k] for o in offsets)) for k in (0, 1))
    bottom, right = (max(0, max(o[k] for o in offsets)) for k in (0, 1))
    there = ~np.isnan(cube)
    gaps = not there.all(axis=0)[there.any(axis=0)].all()
    z = np.pad(np.where(there, cube, 0), ((0, 0), (top, bottom), (left, right)))
    there = np.pad(there, ((0, 0), (top, bottom), (left, right)))
    r, c = rows + top, cols + left
    power = window_sums(z.real**2 + z.imag**2, r, c, offsets, allowed)
    out = []
    for i in range(n - 1):
        cross = window_sums(z[i] * z[i + 1 :].conj(), r, c, offsets, allowed)
        scale = np.sqrt(power[i] * power[i + 1 :])
        one = np.where(scale > LEAST_POWER, cross / np.maximum(scale, 1e-300), 0)
        if gaps:  # else dates that a window has share all its pixels
            one[window_sums((there[i] & there[i + 1 :]).astype(np.int32), r, c, offsets, allowed) == 0] = np.nan
        out.append(one)
    found = np.concatenate(out) if out else np.zeros((0, len(rows), len(cols)), dtype=complex)
    return found, window_sums(there.astype(np.int32), r, c, offsets, allowed) > 0


PACKED = "row int, col int, dates array<int>, re array<double>, im array<double>"


def _packed_tile(rows: np.ndarray, cols: np.ndarray, dates: np.ndarray, values: np.ndarray, tile: tuple[int, int], size: tuple[int, int], offsets: list[Offset], strides: Offset, edges: tuple[np.ndarray, ...] | None) -> pa.Table:
    """PACKED rows of the output pixels of a tile that have an input pixel in their own look (and edges, where given)."""
    (sy, sx), (r0, c0) = strides, (int(rows.min()), int(cols.min()))
    axis, at = np.unique(dates, return_inverse=True)
    cube = np.full((len(axis), int(rows.max()) - r0 + 1, int(cols.max()) - c0 + 1), np.nan, dtype=complex)
    cube[at, rows - r0, cols - c0] = values
    own = np.unique(np.stack([rows // sy, cols // sx], axis=1), axis=0)
    own = own[((own + np.array(size) // 2) // size == tile).all(axis=1)]
    if not len(own):
        return None
    out_r, out_c = np.arange(own[:, 0].min(), own[:, 0].max() + 1), np.arange(own[:, 1].min(), own[:, 1].max() + 1)
    mid_r, mid_c = out_r * sy + (sy // 2 if sy > 1 else 0) - r0, out_c * sx + (sx // 2 if sx > 1 else 0) - c0
    # Middles of looks may lie outside what the tile's pixels cover.
    low, high = (max(0, -int(m.min())) for m in (mid_r, mid_c)), (max(0, int(m.max()) - s + 1) for m, s in zip((mid_r, mid_c), cube.shape[1:], strict=True))
    (low_r, low_c), (high_r, high_c) = low, high
    cube = np.pad(cube, ((0, 0), (low_r, high_r), (low_c, high_c)), constant_values=np.nan)
    allowed = None
    if edges is not None:
        place = {o: k for k, o in enumerate(offsets)}
        allowed = np.zeros((len(offsets), len(out_r), len(out_c)), dtype=bool)
        er, ec, dr, dc = edges
        k = np.array([place.get(o, -1) for o in zip(dr.tolist(), dc.tolist(), strict=True)], dtype=int)
        inside = (k >= 0) & (er >= out_r[0]) & (er <= out_r[-1]) & (ec >= out_c[0]) & (ec <= out_c[-1])
        allowed[k[inside], er[inside] - out_r[0], ec[inside] - out_c[0]] = True
    found, there = tile_coherence(cube, mid_r + low_r, mid_c + low_c, offsets, allowed)
    i, j = np.triu_indices(len(axis), 1)
    pick_r, pick_c = own[:, 0] - out_r[0], own[:, 1] - out_c[0]
    found, there = found[:, pick_r, pick_c].T, there[:, pick_r, pick_c].T
    some = there.any(axis=1)
    own, found, there = own[some], found[some], there[some]
    both = there[:, i] & there[:, j]
    lists = lambda flat, counts: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(flat))
    each = np.broadcast_to(axis.astype(np.int32), there.shape)[there]
    return pa.table(
        {
            "row": pa.array(own[:, 0], pa.int32()), "col": pa.array(own[:, 1], pa.int32()), "dates": lists(each, there.sum(axis=1)),
            "re": lists(found.real[both], both.sum(axis=1)), "im": lists(found.imag[both], both.sum(axis=1)),
        }
    )


def packed_matrix(stack: DataFrame, offsets: list[Offset], strides: Offset = (1, 1), edges: DataFrame | None = None) -> DataFrame:
    """scene, row, col, dates, re, im: each output pixel's sample coherence over its window, the pairs of its dates flat in the order
    (0, 1), (0, 2) .. (1, 2) .., NaN where no pixel of the window has both.

    A missing sample counts as 0 on its own date only. Output pixels are the stack's own or, with strides, its looks,
    whose windows sit at their middles; edges (PIXEL, dr, dc) restrict each window, e.g. to similar pixels, and drop
    pixels without any. The stack goes to tiles of TILE x TILE pixels with a halo of half a window, once: what is
    shuffled is a few times the stack, however large the window and however many the pairs, and a tile bounds a task."""
    (sy, sx), keys = strides, ["scene", "tile_row", "tile_col"]
    size = (max(1, TILE // sy), max(1, TILE // sx))
    reach = [(min(o[k] for o in offsets), max(o[k] for o in offsets)) for k in (0, 1)]

    def tiles(c: str, step: int, span: tuple[int, int], tile: int) -> Column:
        # Output pixels whose window or look holds the pixel, then their tiles.
        middle = step // 2 if step > 1 else 0
        own = F.floor(F.col(c) / step)
        first, last = F.ceil((F.col(c) - span[1] - middle) / step), F.floor((F.col(c) - span[0] - middle) / step)
        # As in grid.tiles_near, the tile around 0 lies on both sides of it.
        return F.sequence(F.floor((F.least(first, own) + tile // 2) / tile), F.floor((F.greatest(last, own) + tile // 2) / tile))

    pixels = stack.filter("re IS NOT NULL AND im IS NOT NULL").select("scene", F.col("t").cast("int").alias("t"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("re").cast("double").alias("re"), F.col("im").cast("double").alias("im"))
    dealt = pixels.withColumn("tile_row", F.explode(tiles("row", sy, reach[0], size[0]))).withColumn("tile_col", F.explode(tiles("col", sx, reach[1], size[1])))
    scene = stack.schema["scene"].dataType.simpleString()
    schema = f"scene {scene}, {PACKED}"
    arrow = pa.schema([("row", pa.int32()), ("col", pa.int32()), ("dates", pa.list_(pa.int32())), ("re", pa.list_(pa.float64())), ("im", pa.list_(pa.float64()))])

    def built(key, table: pa.Table, near: pa.Table | None) -> pa.Table:
        """The rows of a tile, whose key is a tuple of scalars."""
        found = None
        if table.num_rows and (near is None or near.num_rows):
            r, c, t, re, im = (table.column(x).to_numpy() for x in ("row", "col", "t", "re", "im"))
            edge = None if near is None else tuple(near.column(x).to_numpy() for x in ("row", "col", "dr", "dc"))
            found = _packed_tile(r, c, t, re + 1j * im, (key[1].as_py(), key[2].as_py()), size, offsets, strides, edge)
        found = arrow.empty_table() if found is None else found
        return found.add_column(0, pa.field("scene", key[0].type), pa.array([key[0].as_py()] * found.num_rows, key[0].type))

    def several(table: pa.Table, starts: np.ndarray):
        made, n = [], 0
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            made.append(built(tuple(table.column(k)[a] for k in keys), table.slice(a, b - a), None))
            n += made[-1].num_rows
            if n >= 4096:
                yield pa.concat_tables(made).combine_chunks()
                made, n = [], 0
        if n:
            yield pa.concat_tables(made).combine_chunks()

    if edges is None:
        return each_group(dealt, keys, several, schema)
    # New names for all columns: edges mostly come from the same stack.
    near = edges.select(F.col("scene").alias("scene"), F.floor((F.col("row") + size[0] // 2) / size[0]).alias("tile_row"), F.floor((F.col("col") + size[1] // 2) / size[1]).alias("tile_col"), *(F.col(c).cast("int").alias(c) for c in ("row", "col", "dr", "dc")))
    return dealt.groupBy(*keys).cogroup(near.groupBy(*keys)).applyInArrow(lambda key, table, own: built(key, table, own), schema)


def unpacked(packed: DataFrame) -> DataFrame:
    """scene, row, col, i, j (i < j), re, im of a packed matrix."""
    pairs = F.expr(
        "flatten(transform(dates, (a, x) -> transform(slice(dates, x + 2, size(dates)), (b, y) -> "
        "struct(a AS i, b AS j, re[CAST(x * size(dates) - x * (x + 1) / 2 + y AS INT)] AS re, im[CAST(x * size(dates) - x * (x + 1) / 2 + y AS INT)] AS im))))"
    )
    return packed.select(*PIXEL, F.inline(pairs)).filter("NOT isnan(re)")


def coherence_matrix(stack: DataFrame, offsets: list[Offset], strides: Offset = (1, 1), centres: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
    """packed_matrix in long form: scene, row, col, i, j (i < j), re, im; centres (scene, row, col) restrict the output pixels."""
    packed = packed_matrix(stack, offsets, strides, edges)
    return unpacked(packed if centres is None else packed.join(centres.select(*PIXEL).distinct(), PIXEL, "left_semi"))


def lagged(matrix: DataFrame, lag: int) -> DataFrame:
    """0 where the dates are `lag` or more places apart."""
    near = F.abs(F.col("i") - F.col("j")) < lag
    return matrix.withColumns({c: F.when(near, F.col(c)).otherwise(F.lit(0.0)) for c in ("re", "im")})


def regularised(correlation: Column, beta: float = 0.0, threshold: float = 0.0) -> Column:
    """Off-diagonal |C| shrunk by beta and set to 0 below the threshold."""
    shrunk = correlation * F.lit(1.0 - beta)
    return F.when(shrunk < threshold, F.lit(0.0)).otherwise(shrunk)


def _pair(a: str, b: str) -> str:
    """The place of dates number a and b in the flat arrays of a packed matrix."""
    return f"CAST({a} * size(dates) - {a} * ({a} + 1) / 2 + {b} - {a} - 1 AS INT)"


def closure_phases(packed: DataFrame) -> DataFrame:
    """scene, row, col, i, closure: the angle of C[i,i+1] C[i+1,i+2] conj(C[i,i+2]), inside each row of a packed matrix."""
    places = [f"{c}[{_pair(*ends)}] AS {c}{n}" for n, ends in ((1, ("x", "x + 1")), (2, ("(x + 1)", "x + 2")), (3, ("x", "x + 2"))) for c in ("re", "im")]
    three = packed.select(*PIXEL, F.expr(f"inline(transform(filter(transform(dates, (a, x) -> CAST(x AS INT)), x -> get(dates, x + 2) = dates[x] + 2 AND get(dates, x + 1) = dates[x] + 1), x -> struct(dates[x] AS i, {', '.join(places)})))"))
    a, b = cx(suffix="1"), cx(suffix="2")
    product = Cx(a.re * b.re - a.im * b.im, a.re * b.im + a.im * b.re)
    return three.filter("NOT isnan(re1 + re2 + re3)").select(*PIXEL, "i", angle(mul_conj(product, cx(suffix="3"))).alias("closure"))


def cumulative(closures: DataFrame, factor: float) -> DataFrame:
    """closure summed along time, times a factor."""
    from pyspark.sql import Window

    run = Window.partitionBy(*PIXEL).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return closures.select(*PIXEL, "i", (F.sum("closure").over(run) * factor).alias("cumulative"))


def temporal_coherence(packed: DataFrame, linked: DataFrame, weighted: bool = False) -> DataFrame:
    """scene, row, col, temp_coh: how well linked phases (scene, t, row, col, phase) fit a packed matrix's, over i < j. Pairs
    without both phases don't count. One join of pixels; pairs stay inside the rows."""
    phases = linked.groupBy(*PIXEL).agg(F.map_from_entries(F.collect_list(F.struct(F.col("t").cast("int"), "phase"))).alias("phases"))
    both = packed.join(phases, PIXEL).withColumn("p", F.expr("transform(dates, t -> phases[t])"))
    weight = "sqrt(re[k] * re[k] + im[k] * im[k])" if weighted else "1D"
    place = _pair("x", "x + 1 + y")
    pairs = F.expr(
        f"filter(flatten(transform(p, (a, x) -> transform(slice(p, x + 2, size(p)), (b, y) -> transform(array({place}), k -> "
        f"struct({weight} AS w, atan2(im[k], re[k]) - (a - b) AS off))[0]))), z -> z.off IS NOT NULL AND NOT isnan(z.off))"
    )
    total = lambda x: F.expr(f"aggregate(pairs, 0D, (s, z) -> s + {x})")
    sums = both.select(*PIXEL, pairs.alias("pairs")).select(*PIXEL, total("z.w").alias("w"), total("z.w * cos(z.off)").alias("c"), total("z.w * sin(z.off)").alias("s"), F.size("pairs").alias("n"))
    return sums.filter("n > 0").select(*PIXEL, F.coalesce(F.try_divide(F.sqrt(F.col("c") ** 2 + F.col("s") ** 2), F.col("w")), F.lit(0.0)).alias("temp_coh"))


def similarity(phasors: DataFrame, offsets: list[Offset], how: str = "median") -> DataFrame:
    """scene, row, col, similarity: the median or maximum over a pixel's neighbours of the mean cosine of their phase differences.

    phasors: scene, t, row, col, re, im; a pixel without any signal has no similarity and is no one's neighbour."""
    one = unit(cx())
    units = phasors.filter("re <> 0 OR im <> 0").select("scene", "t", "row", "col", one.re.alias("re"), one.im.alias("im"))
    vectors = as_vectors(units)
    near = neighbours(vectors, vectors, offsets, ["scene"], ["samples"])
    # Pixels with the same dates, the common case, are aligned by place; only others look for each date.
    cosine = F.expr(
        "IF(samples.t = samples_n.t, zip_with(samples, samples_n, (a, b) -> a.re * b.re + a.im * b.im), "
        "transform(filter(samples, a -> array_contains(samples_n.t, a.t)), "
        "a -> aggregate(filter(samples_n, b -> b.t = a.t), 0D, (s, b) -> s + a.re * b.re + a.im * b.im)))"
    )
    alike = near.select(*PIXEL, cosine.alias("c")).filter("size(c) > 0").select(*PIXEL, F.expr("aggregate(c, 0D, (s, x) -> s + x) / size(c)").alias("s"))
    pick = F.median("s") if how == "median" else F.max("s")
    return alike.groupBy(*PIXEL).agg(pick.alias("similarity"))


def nearest_differences(single_reference: DataFrame, n: int = 3) -> DataFrame:
    """Phasors of the differences of single-reference phases (scene, t, row, col, phase) at most n dates apart; t numbers the pairs."""
    a = single_reference.select("scene", F.col("t").alias("t1"), "row", "col", F.col("phase").alias("p1"))
    b = single_reference.select("scene", F.col("t").alias("t2"), "row", "col", F.col("phase").alias("p2"))
    pairs = a.join(b, PIXEL).filter((F.col("t2") > F.col("t1")) & (F.col("t2") - F.col("t1") <= n))
    difference = expj(F.col("p2") - F.col("p1"))
    return pairs.select("scene", (F.col("t1") * 1000 + F.col("t2")).alias("t"), "row", "col", *difference.aliased())
