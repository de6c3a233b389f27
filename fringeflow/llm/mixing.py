"""Mixing sources to target weights: exact block quotas, split among output shards by a multivariate-hypergeometric tree."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fringeflow.llm.common import n_words_of, table, tasks_for, text_of
from fringeflow.tables import materialise

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0
#: Blocks of a source: a power of 4, so that the permutation works on two halves.
BLOCKS = 4096
SHARDS = 16
#: How many single documents that fit best are taken before the cut goes on along the permuted order, until nothing fits.
FITS = 4
#: A source that misses its target by more than this share is filled again with the document that doesn't fit taken first, as long as that helps.
AGAIN = 0.001
SEED = 97
#: The plan has a row for each source, on the driver and in each task; more sources than this raise an error.
MAX_SOURCES = 100_000


def source_key(source: Column) -> Column:
    """A null-safe key: null is a source of its own."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def targets(sizes: list[float], weights: list[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """share times the total by weight; a target stops at most times its source's size and the excess goes to the rest, by weight, until none is above."""
    left, found, open_ = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        whole = sum(weights[i] for i in open_)
        above = {i for i in open_ if left * weights[i] / whole > most * sizes[i]}
        if not above:
            for i in open_:
                found[i] = left * weights[i] / whole
            break
        for i in above:
            found[i] = most * sizes[i]
        left -= sum(found[i] for i in above)
        open_ -= above
    return found


def splitting_tree(quotas: np.ndarray, shards: int, draw: np.random.Generator) -> np.ndarray:
    """shards x sources block counts: at each node the left half of the shards gets its part of the node's blocks by a
    multivariate-hypergeometric draw, the right half the rest. Columns add up to quotas exactly."""
    if shards == 1:
        return quotas[None, :]
    left = shards // 2
    # numpy's method takes fewer than 10^9 blocks in all: MAX_SOURCES * BLOCKS * MOST is below.
    taken = draw.multivariate_hypergeometric(quotas, int(quotas.sum()) * left // shards, method="marginals")
    return np.concatenate([splitting_tree(taken, left, draw), splitting_tree(quotas - taken, shards - left, draw)])


def permuted(block: Column, key: Column, seed: int = SEED) -> Column:
    """The block's place among its source's blocks: a Feistel permutation of 0 .. BLOCKS - 1, keyed by the source."""
    half = int(BLOCKS**0.5)
    high, low = F.floor(block / half), F.pmod(block, F.lit(half))
    for k in range(4):
        high, low = low, high.bitwiseXOR(F.pmod(F.xxhash64(F.lit(seed), F.lit(k), key, low), F.lit(half)))
    return high * half + low


#: Before all rows of a source.
START = (-1, -(2**63))
SPOT = "struct<place:int,order:long>"
SPOTS = f"array<{SPOT}>"
RUNS = f"array<struct<most:double,after:{SPOT},before:{SPOT}>>"


@dataclass
class Filled:
    """A source's last block, the cut up to which all is taken, what is missing, and where the next run starts; then single
    rows and runs of rows (largest size, after and before which place) that fill it, and the row of fits that overshoots."""

    last: int
    cut: tuple[int, int]
    gap: float
    at: tuple[int, int]
    fits: list[tuple[int, int]] = field(default_factory=list)
    runs: list[tuple[float, tuple[int, int], tuple[int, int]]] = field(default_factory=list)
    over: tuple[int, int, int] | None = None


@dataclass
class Mixed:
    """rows: the columns of docs, then __key, __size, __order, __place, __source_size, __target and __draws (array of pass and shard).
    sources: a row per source, with the passes, the last block and the ends of the shards (all but the last) that the tree dealt it."""

    rows: DataFrame
    sources: DataFrame


def draw(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, shards: int = SHARDS, seed: int = SEED) -> Mixed:
    """How often, and to which shard, each row of docs is drawn.

    A row's size is its number of words; null or empty texts have 0 and are drawn with their block, to no effect. A
    source takes whole passes over its blocks, then blocks in permuted order up to its target, the last one in part.
    What is then missing is filled from later documents: FITS that fit it best, then those along the permuted order,
    skipping what is larger than the gap, and so on until none that is left fits; at last one that overshoots by less
    than the gap. Where only documents much longer than the gap are left, the shortest of them is taken first and the
    rest of the target is filled anew. No document is drawn more than `most` times, rounded up. Rows go to blocks by a hash of doc_id and text, so null ids spread too; exact repeats of a row share a place
    and are drawn alike. All choices are hashes and seeded draws: reruns agree.

    Text columns aren't shuffled. Gathered are sums per source (MAX_SOURCES at most) and per block (BLOCKS a source)."""
    place = F.xxhash64(F.lit(seed), F.col(f"`{doc_id}`"), text_of(F.col(f"`{text}`")))
    rows = docs.select("*", source_key(F.col(f"`{source}`")).alias("__key"), n_words_of(text_of(F.col(f"`{text}`"))).alias("__size"), place.alias("__order"))
    rows = rows.withColumn("__place", permuted(F.pmod("__order", F.lit(BLOCKS)), F.col("__key"), seed)).withColumn("__order", F.xxhash64(F.lit(seed + 1), "__order"))
    spark = docs.sparkSession
    small = materialise(rows.select("__key", "__size", "__place", "__order"), "mix-sizes")

    totals = small.groupBy("__key").agg(F.sum("__size").alias("total"), F.min("__key").alias("name")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    names = sorted((x["name"] for x in totals), key=lambda name: (name[0] == "n", name))
    total = {x["name"]: x["total"] for x in totals}
    goal = dict(zip(names, targets([total[n] for n in names], [weights[i % len(weights)] for i in range(len(names))], share, most), strict=True))
    passes = {n: int(goal[n] // total[n]) if total[n] else 0 for n in names}
    rest = {n: goal[n] - passes[n] * total[n] for n in names}

    plan = spark.createDataFrame([(n, float(rest[n])) for n in names], "__key string, rest double")
    by_place = Window.partitionBy("__key").orderBy("__place")
    blocks = small.groupBy("__key", "__place").agg(F.sum("__size").alias("size")).withColumn("upto", F.sum("size").over(by_place))
    # The block that passes the rest of its source's target is taken in part.
    last = blocks.join(F.broadcast(plan), "__key").filter("upto > rest AND upto - size <= rest AND rest > 0")
    last = materialise(last.select("__key", "__place", (F.col("rest") - (F.col("upto") - F.col("size"))).alias("need")), "mix-last")
    inside = small.join(F.broadcast(last), ["__key", "__place"]).groupBy("__key", "__place", "need", "__order").agg(F.sum("__size").alias("size"))
    run = inside.withColumn("upto", F.sum("size").over(Window.partitionBy("__key").orderBy("__order")))
    cut = run.filter("upto <= need").groupBy("__key").agg(F.max("__order").alias("cut"), F.max("upto").alias("taken"))
    least = START[1]
    ended = materialise(last.join(cut, "__key", "left").select("__key", F.col("__place").alias("last"), F.coalesce("cut", F.lit(least)).alias("cut"), (F.col("need") - F.coalesce("taken", F.lit(0))).alias("gap")), "mix-ended")
    # What is still missing is less than the next document. Later rows fill it; exact repeats are taken together.
    gaps = {x["__key"]: (x["last"], x["cut"], x["gap"]) for x in ended.collect()}
    found = {n: Filled(place, (place, upto), float(gap), (place, upto)) for n, (place, upto, gap) in gaps.items()}
    later = small.join(F.broadcast(ended), "__key").filter("(__place > last OR __place = last AND __order > cut) AND __size > 0 AND __size < 2 * gap")
    later = materialise(later.groupBy("__key", "__place", "__order").agg(F.max("__size").alias("__size"), F.sum("__size").alias("whole")), "mix-later")
    _fill(later, found)
    _fill_again(small, found, rest, goal)

    # A source without a last block (its rest is 0) takes whole passes only.
    quotas = np.array([passes[n] * BLOCKS + (found[n].last + 1 if n in found else 0) for n in names], dtype=np.int64)
    ends = splitting_tree(quotas, shards, np.random.default_rng(seed)).cumsum(axis=0) if names else np.zeros((shards, 0), dtype=np.int64)
    known = []
    for i, n in enumerate(names):
        own = found.get(n, Filled(-1, START, 0.0, START))
        known.append((n, int(total[n]), float(goal[n]), passes[n], own.last, own.cut, own.fits, own.runs, [int(x) for x in ends[:-1, i]]))
    sources = spark.createDataFrame(known, f"__key string, __source_size long, __target double, __passes int, __last int, __cut {SPOT}, __fits {SPOTS}, __runs {RUNS}, __ends array<long>")

    here = (_spot() <= F.col("__cut")) | _filling()
    times = F.col("__passes") + here.cast("int")
    # Rows that fill a gap lie beyond the quotas; they are spread by their hash.
    beyond = F.pmod(F.xxhash64(F.lit(seed + 2), "__order"), F.lit(shards)).cast("int")
    shard = lambda p: F.when((p == F.col("__passes")) & (F.col("__place") > F.col("__last")), beyond).otherwise(F.size(F.filter("__ends", lambda e: e <= p * BLOCKS + F.col("__place"))))
    numbered = F.transform(F.sequence(F.lit(0), F.greatest(times, F.lit(1)) - 1), lambda p: F.struct(p.alias("pass"), shard(p).alias("shard")))
    drawn = F.when(times > 0, numbered).otherwise(F.array().cast(numbered_type()))
    joined = rows.join(F.broadcast(sources), "__key")
    return Mixed(joined.select(*(F.col(f"`{c}`") for c in docs.columns), "__key", "__size", "__order", "__place", "__source_size", "__target", drawn.alias("__draws")), sources)


def _spot() -> Column:
    return F.struct(F.col("__place").cast("int").alias("place"), F.col("__order").alias("order"))


def _filling() -> Column:
    """Whether a row is one of its source's __fits or lies in one of its __runs."""
    inside = lambda r: (F.col("__size") > 0) & (F.col("__size") <= r["most"]) & (_spot() > r["after"]) & (_spot() < r["before"])
    return F.array_contains("__fits", _spot()) | F.exists("__runs", inside)


def _fill(later: DataFrame, found: dict[str, Filled], fresh: bool = False) -> None:
    """Adds to each source's fits and runs until no row of later that isn't taken is within the source's gap.

    A run goes on along the permuted order from where the one before it stopped, over rows within the gap, up to the
    first that doesn't fit any more; so what it leaves behind is larger than the gap and needs no second look."""

    def left(keys: list[str]) -> DataFrame:
        known = [(n, found[n].gap, found[n].at, found[n].fits, found[n].runs) for n in keys]
        state = later.sparkSession.createDataFrame(known, f"__key string, gap double, at {SPOT}, __fits {SPOTS}, __runs {RUNS}")
        return later.join(F.broadcast(state), "__key").filter(~_filling())

    def take(fits: DataFrame, order: Column, last: bool = False) -> list[str]:
        taken = fits.groupBy("__key").agg(F.min_by(F.struct("__place", "__order", "whole"), order).alias("fit")).collect()
        for x in taken:
            found[x["__key"]].fits.append((x["fit"]["__place"], x["fit"]["__order"]))
            found[x["__key"]].gap -= x["fit"]["whole"]
            found[x["__key"]].over = tuple(x["fit"]) if last else None
        return [x["__key"] for x in taken]

    def run(keys: list[str]) -> None:
        rows = left(keys).filter((_spot() > F.col("at")) & (F.col("__size") <= F.col("gap")))
        by_place = Window.partitionBy("__key").orderBy("__place")
        blocks = rows.groupBy("__key", "gap", "__place").agg(F.sum("whole").alias("size")).withColumn("upto", F.sum("size").over(by_place))
        ends = blocks.groupBy("__key", "gap").agg(F.max("upto").alias("all"), F.min(F.when(F.col("upto") > F.col("gap"), F.struct("__place", (F.col("upto") - F.col("size")).alias("before")))).alias("end"))
        ends = materialise(ends.select("__key", "gap", "all", F.col("end.__place").alias("__place"), F.col("end.before").alias("before")), "mix-ends")
        inside = rows.drop("gap").join(F.broadcast(ends), ["__key", "__place"])
        upto = inside.withColumn("upto", F.col("before") + F.sum("whole").over(Window.partitionBy("__key").orderBy("__order")))
        over = F.col("upto") > F.col("gap")
        stops = upto.groupBy("__key").agg(F.min(F.when(over, F.col("__order"))).alias("stop"), F.max(F.when(~over, F.col("upto"))).alias("upto"))
        for x in ends.join(F.broadcast(stops), "__key", "left").collect():
            own = found[x["__key"]]
            whole = x["__place"] is None
            stop = (BLOCKS, 0) if whole else (x["__place"], x["stop"])
            own.runs.append((own.gap, own.at, stop))
            own.gap -= x["all"] if whole else x["before"] if x["upto"] is None else x["upto"]
            own.at = stop

    keys = list(found)
    if fresh and keys:
        run(keys)
        for n in keys:
            found[n].last = min(found[n].at[0], BLOCKS - 1)
    while keys:
        for _ in range(FITS):
            keys = take(left(keys).filter("whole <= gap"), F.struct(-F.col("whole"), "__place", "__order")) if keys else []
        if keys:
            run(keys)
    # Nothing fits now; a row that overshoots by less than the gap brings the sum nearer.
    if found:
        take(left(list(found)).filter("whole < 2 * gap"), F.struct("whole", "__place", "__order"), last=True)


def _fill_again(small: DataFrame, found: dict[str, Filled], rest: dict[str, float], goal: dict[str, float]) -> None:
    """Of sources that miss their target by more than AGAIN: takes the row that overshoots, or else the shortest that is left, first and fills what then remains along the whole permuted order. The better outcome is kept."""
    first: dict[str, list[tuple[int, int, int]]] = {n: [] for n in found}
    keys = [n for n in found if abs(found[n].gap) > AGAIN * goal[n]]
    while keys:
        state = small.sparkSession.createDataFrame([(n, found[n].cut, found[n].fits, found[n].runs) for n in keys], f"__key string, cut {SPOT}, __fits {SPOTS}, __runs {RUNS}")
        own = small.filter("__size > 0").join(F.broadcast(state), "__key").withColumn("left", (_spot() > F.col("cut")) & ~_filling())
        rows = materialise(own.groupBy("__key", "__place", "__order").agg(F.max("__size").alias("__size"), F.sum("__size").alias("whole"), F.max("left").alias("left")), "mix-again")
        shortest = {x["__key"]: tuple(x["row"]) for x in rows.filter("left").groupBy("__key").agg(F.min_by(F.struct("__place", "__order", "whole"), F.struct("whole", "__place", "__order")).alias("row")).collect()}
        again = {}
        for n in keys:
            row = found[n].over or shortest.get(n)
            taken = [*first[n], row] if row else []
            gap = rest[n] - sum(x[2] for x in taken)
            if row and row not in first[n] and gap >= 0:
                again[n], first[n] = Filled(-1, START, gap, START, [x[:2] for x in taken]), taken
        _fill(rows.drop("left"), again, fresh=True)
        better = [n for n in again if abs(again[n].gap) < abs(found[n].gap)]
        found |= {n: again[n] for n in better}
        keys = [n for n in better if abs(found[n].gap) > AGAIN * goal[n]]


def numbered_type() -> str:
    return "array<struct<pass:int,shard:int>>"


def mix(docs: DataFrame, shard: str | None = None, **options) -> DataFrame:
    """The mixed rows, columns of docs only (and the output shard's number, if `shard` names a column for it), dealt to the output
    shards and shuffled inside each: a written table's files are in that order.

    A null source is one of its own. Rows that repeat each other are drawn alike, as often as there are of them. Null and
    empty texts have no words and go with their block. An empty table gives none."""
    shards = options.get("shards", SHARDS)
    drawn = draw(docs, **options).rows
    hidden = [F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(docs.columns)]
    each = drawn.select(*hidden, "__order", F.explode("__draws").alias("__draw"))
    # Within a shard, rows are spread over as many tasks as the input's bytes ask for, and ordered by a hash there.
    local = F.xxhash64("__order", "__draw.pass")
    spread = -(-tasks_for(docs) // shards)
    dealt = each.withColumn("__local", local).repartition(shards * spread, F.col("__draw.shard"), F.pmod("__local", F.lit(spread))).sortWithinPartitions("__draw.shard", "__local")
    number = [F.col("__draw.shard").alias(shard)] if shard else []
    return dealt.select(*(F.col(f"__c{i}").alias(c) for i, c in enumerate(docs.columns)), *number)


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is taken, and to which output shards the tree deals it; see draw and mix for nulls and repeated rows."""
    rows = draw(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).rows
    shards = F.transform("__draws", lambda d: d["shard"]).alias("shards")
    return rows.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__size") * F.size("__draws")).alias("taken"), shards)
