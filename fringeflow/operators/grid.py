"""Windows, looks, tiles and blocks on a pixel grid."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Offset = tuple[int, int]
#: The least side of a tile, the places that a kernel's lookup holds at once, and the rows that it hands on at once.
TILE, PLACES, ROWS_OUT = 64, 4_000_000, 100_000


def rectangle(half_row: int, half_col: int, centre: bool = True) -> list[Offset]:
    """Offsets of a window of (2 half + 1) rows and columns, in row-major order."""
    every = [(r, c) for r in range(-half_row, half_row + 1) for c in range(-half_col, half_col + 1)]
    return [o for o in every if centre or o != (0, 0)]


def disk(max_radius: int, min_radius: int = 0, spiral: bool = False) -> list[Offset]:
    """Offsets inside the digital circle of radius max_radius - 1 and outside that of min_radius, without the centre.

    A digital circle of radius r holds the offsets whose larger part, moved half a pixel inward, lies within r. Order:
    row-major, or by distance (then row-major) for a spiral."""

    def inside(r: int, c: int, radius: int) -> bool:
        most, least = max(abs(r), abs(c)), min(abs(r), abs(c))
        return most <= radius and most * most - most + least * least <= radius * radius

    reach = range(1 - max_radius, max_radius)
    found = [(r, c) for r in reach for c in reach if (r, c) != (0, 0) and inside(r, c, max_radius - 1) and not (min_radius and inside(r, c, min_radius))]
    return sorted(found, key=lambda o: (o[0] ** 2 + o[1] ** 2, o)) if spiral else found


def offsets_column(offsets: Iterable[Offset]) -> Column:
    """A literal array of (rank, dr, dc), to be exploded."""
    return F.array(*(F.struct(F.lit(i).alias("rank"), F.lit(r).alias("dr"), F.lit(c).alias("dc")) for i, (r, c) in enumerate(offsets)))


def _begins(table: pa.Table, keys: list[str]) -> np.ndarray:
    """The rows (but the first) whose keys differ from those of the row before."""
    found = np.zeros(max(0, table.num_rows - 1), dtype=bool)
    for k in keys:
        column = table.column(k).combine_chunks()
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        one, other = column[1:], column[:-1]
        found |= pa.compute.coalesce(pa.compute.not_equal(one, other), pa.compute.xor(one.is_null(), other.is_null())).to_numpy(zero_copy_only=False)
    return np.flatnonzero(found) + 1


def each_group(rows: DataFrame, keys: list[str], fn: Callable[[pa.Table, np.ndarray], Iterator[pa.Table]], schema: str) -> DataFrame:
    """fn(table, starts) for runs of whole groups of the same keys: starts are the groups' first rows in the table, and its end.

    The rows are shuffled once and sorted, so that groups lie one after another, and many small ones are one call of fn;
    memory is that of an Arrow batch and of the largest group."""

    def run(batches):
        held: list[pa.Table] = []

        def done(tables, begins):
            table = pa.concat_tables(tables).combine_chunks()
            for out in fn(table, np.array([0, *begins, table.num_rows])):
                yield from out.to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            before = [held[-1].slice(held[-1].num_rows - 1)] if held else []
            begins = _begins(pa.concat_tables([*before, table]), keys) - len(before)
            if len(begins):
                end, offset = int(begins[-1]), sum(t.num_rows for t in held)
                yield from done([*held, table.slice(0, end)], begins[:-1] + offset)
                held = [table.slice(end)]
            else:
                held.append(table)
        if held:
            yield from done(held, [])

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def tiles_near(c: str, tile: int, halo: int) -> Column:
    """The tiles whose extent with a halo holds a place. The tile around 0 lies on both sides of it, so that a small image is one tile."""
    return F.sequence(F.floor((F.col(c) + (tile // 2 - halo)) / tile).cast("int"), F.floor((F.col(c) + (tile // 2 + halo)) / tile).cast("int"))


def places(table: pa.Table, starts: np.ndarray, names: tuple[str, str] = ("__row", "__col")) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[int, int]]:
    """Of each row of a table the number of its group, its row and column in a box that fits each of the groups, and that box's size."""
    group = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    at = []
    for c in names:
        x = table.column(c).to_numpy().astype(np.int64)
        at.append(x - np.minimum.reduceat(x, starts[:-1])[group])
    return group, *at, tuple(int(x.max()) + 1 for x in at)


def _pairs(group: np.ndarray, row: np.ndarray, col: np.ndarray, box: tuple[int, int], centre: np.ndarray, offsets: list[Offset], most: int | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place of the offset, rows of centres, rows of their pixels) of all windows, or of the first `most` pixels of each."""
    up, left = (max(abs(o[k]) for o in offsets) for k in (0, 1))
    height, width = box[0] + 2 * up, box[1] + 2 * left
    code = ((group - group[0]) * height + row + up) * width + col + left
    mine, other = np.flatnonzero(centre), np.flatnonzero(~centre)
    if not len(mine) or not len(other):
        return
    other = other[np.argsort(code[other], kind="stable")]
    some, start, n = np.unique(code[other], return_index=True, return_counts=True)
    first, count = (np.zeros((group[-1] - group[0] + 1) * height * width, dtype=np.int32) for _ in range(2))
    first[some], count[some] = start, n
    base, live, have = code[mine], np.arange(len(mine)), np.zeros(len(mine), dtype=np.int64)
    for k, (dr, dc) in enumerate(offsets):
        at = base[live] + (dr * width + dc)
        hit = count[at]
        met = np.flatnonzero(hit)
        if not len(met):
            continue
        times = hit[met] if most is None else np.minimum(hit[met], most - have[live[met]])
        who = np.repeat(live[met], times)
        which = np.repeat(first[at[met]] - np.cumsum(times) + times, times) + np.arange(len(who))
        yield k, mine[who], other[which]
        if most is not None:
            have[live[met]] += times
            live = live[have[live] < most]
            if not len(live):
                return


def neighbours(centres: DataFrame, pixels: DataFrame, offsets: list[Offset], keys: list[str], values: list[str], suffix: str = "_n", strides: Offset = (1, 1), most: int | None = None) -> DataFrame:
    """Each centre (all its columns) with each pixel of its window: rank, dr, dc and the pixel's values with a suffix. most: only with
    the first so many pixels in the order of the offsets.

    Both go to tiles with a halo of the window, once: what is shuffled is about the input, whatever the window, and the
    windows are looked up inside a tile. keys (scene, date, ...) must agree. With strides, centres are output pixels
    whose window sits at the middle of their look."""
    (sy, sx), at = strides, ["tile_row", "tile_col"]
    reach = [max(abs(o[k]) for o in offsets) for k in (0, 1)]
    side = [max(TILE, 2 * h) for h in reach]
    own, kinds = [c for c in centres.columns if c not in keys], dict(centres.dtypes)
    middle = [F.col("row") * sy + (sy // 2 if sy > 1 else 0), F.col("col") * sx + (sx // 2 if sx > 1 else 0)]
    mine = centres.select(*keys, *(m.cast("int").alias(c) for m, c in zip(middle, ("__row", "__col"), strict=True)), F.struct(*own).alias("__own"))
    mine = mine.select("*", *(F.floor((F.col(c) + t // 2) / t).cast("int").alias(n) for c, t, n in zip(("__row", "__col"), side, at, strict=True)))
    there = pixels.select(*(F.col(k).cast(kinds[k]).alias(k) for k in keys), F.col("row").cast("int").alias("__row"), F.col("col").cast("int").alias("__col"), F.struct(*(F.col(v).alias(f"{v}{suffix}") for v in values), F.lit(True).alias("__there")).alias("__pixel"))
    for c, t, h, n in zip(("__row", "__col"), side, reach, at, strict=True):
        there = there.withColumn(n, F.explode(tiles_near(c, t, h)))
    both = mine.withColumn("__pixel", F.lit(None).cast(there.schema["__pixel"].dataType)).unionByName(there.withColumn("__own", F.lit(None).cast(mine.schema["__own"].dataType)))
    # As in an equi-join, missing keys meet nothing.
    both = both.dropna(subset=[*keys, "__row", "__col"])
    drs, dcs = (np.array([o[k] for o in offsets], dtype=np.int32) for k in (0, 1))
    names = [*keys, *own, "rank", "dr", "dc", *(f"{v}{suffix}" for v in values)]

    def fn(table, starts):
        group, row, col, box = places(table, starts)
        centre = table.column("__own").combine_chunks().is_valid().to_numpy(zero_copy_only=False)
        parts = {c: x for c in ("__own", "__pixel") for x in [table.column(c).combine_chunks()]}
        inner = {c: dict(zip((f.name for f in x.type), x.flatten(), strict=True)) for c, x in parts.items()}

        def out(found):
            rank = np.repeat(np.array([k for k, _, _ in found], dtype=np.int32), [len(a) for _, a, _ in found])
            a, b = (pa.array(np.concatenate([f[i] for f in found])) for i in (1, 2))
            columns = [*(table.column(k).take(a) for k in keys), *(inner["__own"][c].take(a) for c in own), rank, drs[rank], dcs[rank], *(inner["__pixel"][f"{v}{suffix}"].take(b) for v in values)]
            return pa.table(columns, names=names)

        step = max(1, PLACES // ((box[0] + 2 * reach[0]) * (box[1] + 2 * reach[1])))
        found, n = [], 0
        for g in range(0, len(starts) - 1, step):
            part = slice(starts[g], starts[min(g + step, len(starts) - 1)])
            for k, a, b in _pairs(group[part], row[part], col[part], box, centre[part], offsets, most):
                found.append((k, a + part.start, b + part.start))
                n += len(a)
                if n >= ROWS_OUT:
                    yield out(found)
                    found, n = [], 0
        if found:
            yield out(found)

    kind = lambda frame, c: frame.schema[c].dataType.simpleString()
    pixel = {f.name: f.dataType.simpleString() for f in there.schema["__pixel"].dataType.fields}
    schema = ", ".join([*(f"`{c}` {kind(centres, c)}" for c in [*keys, *own]), "rank int, dr int, dc int", *(f"`{v}{suffix}` {pixel[v + suffix]}" for v in values)])
    return each_group(both, [*keys, *at], fn, schema)


#: Reducers by name; nulls are nodata and don't count.
REDUCERS: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum, "nansum": F.sum, "mean": F.avg, "nanmean": F.avg, "min": F.min, "nanmin": F.min, "max": F.max, "nanmax": F.max,
    "median": F.median, "nanmedian": F.median, "std": F.stddev_pop, "any": F.bool_or, "all": F.bool_and, "count": F.count,
}


def take_looks(pixels: DataFrame, row_looks: int, col_looks: int, values: dict[str, str], keys: list[str], shape: tuple[int, int] | None = None, edge: str = "cutoff") -> DataFrame:
    """One row for each block of row_looks x col_looks pixels; values: column -> reducer's name.

    edge: "cutoff" drops the ragged last rows and columns of a grid of `shape`, "pad" keeps them as smaller blocks."""
    if edge not in ("cutoff", "pad"):
        raise ValueError(f"unknown edge strategy {edge}")
    if edge == "cutoff" and shape:
        pixels = pixels.filter((F.col("row") < shape[0] // row_looks * row_looks) & (F.col("col") < shape[1] // col_looks * col_looks))
    block = [F.floor(F.col("row") / row_looks).cast("int").alias("row"), F.floor(F.col("col") / col_looks).cast("int").alias("col")]
    return pixels.select(*keys, *block, *values).groupBy(*keys, "row", "col").agg(*(REDUCERS[how](F.col(c)).alias(c) for c, how in values.items()))


def upsample(coarse: DataFrame, fine: DataFrame, row_looks: int, col_looks: int, keys: list[str], values: list[str]) -> DataFrame:
    """The fine grid's pixels with the values of the coarse pixel that covers them; null outside."""
    at = fine.withColumn("__r", F.floor(F.col("row") / row_looks).cast("int")).withColumn("__c", F.floor(F.col("col") / col_looks).cast("int"))
    side = coarse.select(*keys, F.col("row").alias("__r"), F.col("col").alias("__c"), *values)
    return at.join(side, [*keys, "__r", "__c"], "left").drop("__r", "__c")


def decimate(pixels: DataFrame, row_stride: int, col_stride: int, shape: tuple[int, int]) -> DataFrame:
    """The pixels at the middles of the full looks, renumbered."""
    r, c = F.col("row") - row_stride // 2, F.col("col") - col_stride // 2
    inside = (r >= 0) & (c >= 0) & (r % row_stride == 0) & (c % col_stride == 0) & (r / row_stride < shape[0] // row_stride) & (c / col_stride < shape[1] // col_stride)
    return pixels.filter(inside).withColumn("row", F.expr(f"CAST((row - {row_stride // 2}) DIV {row_stride} AS INT)")).withColumn("col", F.expr(f"CAST((col - {col_stride // 2}) DIV {col_stride} AS INT)"))


def overviews(pixels: DataFrame, levels: list[int], value: str, keys: list[str], how: str = "average") -> DataFrame:
    """A pyramid in long form: level, keys, row, col, value; "average" of the block, or "nearest": its upper left pixel."""
    each = pixels.withColumn("level", F.explode(F.array(*(F.lit(x) for x in levels))))
    each = each.select("level", *keys, (F.floor(F.col("row") / F.col("level"))).cast("int").alias("r"), (F.floor(F.col("col") / F.col("level"))).cast("int").alias("c"), "row", "col", value)
    pick = F.avg(value) if how == "average" else F.min_by(value, F.struct("row", "col"))
    return each.groupBy("level", *keys, "r", "c").agg(pick.alias(value)).withColumnsRenamed({"r": "row", "c": "col"})


def block_ranges(shape: tuple[int, int], block: tuple[int, int], overlaps: tuple[int, int] = (0, 0), start: tuple[int, int] = (0, 0), margin: tuple[int, int] = (0, 0)) -> list[tuple[int, int, int, int]]:
    """Half-open (row, row end, col, col end) of overlapping blocks from `start` to the shape less margin."""

    def along(size: int, step: int, overlap: int, first: int, last: int) -> list[tuple[int, int]]:
        if step <= overlap:
            raise ValueError("a block must be larger than its overlap")
        out, at, end = [], first, size - last
        while at < end:
            out.append((at, min(at + step, end)))
            if at + step >= end:
                break
            at += step - overlap
        return out

    rows = along(shape[0], block[0], overlaps[0], start[0], margin[0])
    cols = along(shape[1], block[1], overlaps[1], start[1], margin[1])
    return [(*r, *c) for r in rows for c in cols]


def strided_blocks(shape: tuple[int, int], block: tuple[int, int], strides: Offset = (1, 1), half_window: Offset = (0, 0)) -> list[dict[str, tuple[int, int, int, int]]]:
    """For each block of the output grid: `out` (its place), `core` (the input it stands for) and `read` (core with a margin).

    The margin in output pixels is half the window over the stride, rounded half to even; border outputs of that width
    have no full window and aren't planned."""
    margin = tuple(round(h / s) for h, s in zip(half_window, strides, strict=True))
    out_shape = tuple(n // s for n, s in zip(shape, strides, strict=True))
    out_block = tuple(max(1, b // s) for b, s in zip(block, strides, strict=True))
    plans = []
    for r0, r1, c0, c1 in block_ranges(out_shape, out_block, start=margin, margin=margin):
        core = (r0 * strides[0], r1 * strides[0], c0 * strides[1], c1 * strides[1])
        pad = (margin[0] * strides[0], margin[1] * strides[1])
        plans.append({"out": (r0, r1, c0, c1), "core": core, "read": (core[0] - pad[0], core[1] + pad[0], core[2] - pad[1], core[3] + pad[1])})
    return plans


def in_cores(pixels: DataFrame, plans: list[dict[str, tuple[int, int, int, int]]]) -> DataFrame:
    """The pixels inside the cores of strided_blocks, with block, the plan's place. A pixel's block follows from its row and column, as
    cores lie on a grid: an equi-join with a row for each plan."""
    starts = [sorted({p["core"][k] for p in plans}) for k in (0, 2)]
    sizes = [max(p["core"][k + 1] - p["core"][k] for p in plans) for k in (0, 2)]
    cores = [(k, starts[0].index(p["core"][0]), starts[1].index(p["core"][2]), p["core"][1], p["core"][3]) for k, p in enumerate(plans)]
    frame = pixels.sparkSession.createDataFrame(cores, "block int, __r int, __c int, __r1 int, __c1 int")
    at = [F.floor((F.col(c) - s[0]) / n).cast("int").alias(f"__{c[0]}") for c, s, n in zip(("row", "col"), starts, sizes, strict=True)]
    dealt = pixels.select("*", *at).join(frame, ["__r", "__c"])
    return dealt.filter((F.col("row") < F.col("__r1")) & (F.col("col") < F.col("__c1"))).drop("__r", "__c", "__r1", "__c1")


def tile_map(pixels: DataFrame, fn: Callable, schema: str, tile: tuple[int, int], halo: tuple[int, int], keys: list[str], together: bool = False) -> DataFrame:
    """fn(pandas frame of a tile with its halo) for each tile, trimmed to the tile's own pixels.

    Each pixel goes to every tile whose padded extent holds it (4 at most for a halo under half a tile). A tile's size
    bounds the rows of a task, whatever the image's size. together: fn gets the rows of many tiles at once, tile after
    tile, with their number in `tile`, and returns that column too; for tiles so small that a call for each is dear."""
    near = F.explode(
        F.expr(
            f"flatten(transform(sequence((row - {halo[0]}) DIV {tile[0]} - IF(row < {halo[0]}, 1, 0), (row + {halo[0]}) DIV {tile[0]}), "
            f"a -> transform(sequence((col - {halo[1]}) DIV {tile[1]} - IF(col < {halo[1]}, 1, 0), (col + {halo[1]}) DIV {tile[1]}), b -> struct(a AS tr, b AS tc))))"
        )
    )
    dealt = pixels.withColumn("__t", near).withColumn("tile_row", F.col("__t.tr").cast("int")).withColumn("tile_col", F.col("__t.tc").cast("int")).drop("__t").filter("tile_row >= 0 AND tile_col >= 0")

    def run(table, starts):
        rows = table.to_pandas()
        first = rows.iloc[starts[:-1]][["tile_row", "tile_col"]].to_numpy()
        if together:
            done = fn(rows.assign(tile=np.repeat(np.arange(len(starts) - 1), np.diff(starts))))
            own = first[done["tile"]]
            made = [done[((done[["row", "col"]].to_numpy() // tile) == own).all(axis=1)].drop(columns="tile")]
        else:
            parts = [fn(rows.iloc[a:b].reset_index(drop=True)) for a, b in zip(starts[:-1], starts[1:], strict=True)]
            made = [part[((part[["row", "col"]].to_numpy() // tile) == at).all(axis=1)] for part, at in zip(parts, first, strict=True)]
        for part in made:
            if len(part):
                yield pa.Table.from_pandas(part[out.names], out, preserve_index=False)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))
    return each_group(dealt, [*keys, "tile_row", "tile_col"], run, schema)
