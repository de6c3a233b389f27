"""MinHash near-dedup: one-permutation hashing, optimal densification, banded buckets, star-shaped candidate edges."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fringeflow.llm.common import LOWER, UPPER, table, text_batches, text_of
from fringeflow.operators.graph import connected
from fringeflow.tables import materialise, scratch

#: 50 bands of 6 bins: a pair at the threshold 0.8 misses every bucket with probability (1 - 0.8^6)^50 = 3e-7.
BANDS, ROWS = 50, 6
#: Percent of the union that two linked sets share at least.
LEAST_PERCENT = 80
#: A pair whose sketches agree in fewer bins isn't compared in full; at similarity 0.8, 0.68 of 300 bins is 5 standard deviations off.
LEAST_SKETCH = 0.68
#: Smaller sets collide in the bins, so that the estimate spreads wider: pairs of them skip the sketches.
SMALL = 200
#: How many members of an undecided bucket become centres in the first further round, and how many times as many in the next.
GROWTH = 16.0
#: Undecided buckets with LARGE members or more are decided around a consensus set, drawn from some CONSENSUS members of each family.
LARGE, CONSENSUS = 64, 256
#: Partitions of the tables between the steps are joined up to so many bytes: most of these tables are small, and each file costs a task.
TABLE_BYTES = 4 << 20
SEED = 20240229

_ONE = np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; wraps around."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _tables(length: int) -> tuple[np.ndarray, ...]:
    """Of each byte: its lower-case form's random value, whether it is white space; then powers of an odd number and of its inverse."""
    draw = np.random.default_rng(SEED)
    byte = draw.integers(0, 2**64, 256, dtype=np.uint64)
    byte[ord("A") : ord("Z") + 1] = byte[ord("a") : ord("z") + 1]
    space = np.zeros(256, dtype=np.int8)
    space[[9, 10, 11, 12, 13, 32]] = 1
    base = int(draw.integers(0, 2**64, dtype=np.uint64)) | 1
    powers = np.cumprod(np.full(length, base, dtype=np.uint64))
    inverse = np.cumprod(np.full(length, pow(base, -1, 2**64), dtype=np.uint64))
    return byte, space, powers, inverse


@cache
def _probes(bins: int) -> np.ndarray:
    """For each bin an order of all bins, drawn by a hash that all documents share: an empty bin takes the value of the first occupied one."""
    draw = np.random.default_rng(SEED + bins)
    return np.stack([draw.permutation(bins) for _ in range(bins)]).astype(np.int32)


def word_hashes(text: bytes, piece: int = 1 << 16) -> np.ndarray:
    """A 64-bit hash of each word of the A-Z lower-cased UTF-8 text. Works in pieces cut at white space, so memory stays near that of the result."""
    found, at = [], 0
    while at < len(text):
        end = at + piece
        if end < len(text):
            cut = max(text.rfind(b" ", at, end), text.rfind(b"\n", at, end))
            if cut <= at:  # a very long word
                after = [x for x in (text.find(b" ", end), text.find(b"\n", end)) if x >= 0]
                cut = min(after, default=len(text))
            end = cut
        raw = np.frombuffer(text, dtype=np.uint8, count=min(end, len(text)) - at, offset=at)
        byte, space, powers, inverse = _tables(max(piece, 1 << (len(raw)).bit_length()))
        edge = np.flatnonzero(np.diff(space[raw], prepend=1, append=1))
        starts, ends = edge[0::2], edge[1::2]
        total = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(byte[raw] * powers[: len(raw)], out=total[1:])
        found.append(_mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)))
        at = end if end > at else at + 1
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles of `width` words; with fewer words the whole sequence is one, without words none."""
    words = word_hashes((text or "").encode("utf-8", "surrogatepass"))
    if not len(words):
        return words
    n = max(1, len(words) - width + 1)
    used = min(width, len(words))
    value = np.full(n, used, dtype=np.uint64)
    for k in range(used):
        value = _mix(value * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n])
    return np.unique(value)


def signature(shingles: np.ndarray, bins: int) -> np.ndarray:
    """The least shingle of each bin of one permutation; empty bins are filled by optimal densification. shingles: sorted, not empty."""
    place = (((shingles >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    value, full = np.zeros(bins, dtype=np.uint64), np.zeros(bins, dtype=bool)
    value[place[first]], full[place[first]] = shingles[first], True
    empty = np.flatnonzero(~full)
    if len(empty):
        order = _probes(bins)[empty]
        value[empty] = value[order[np.arange(len(empty)), full[order].argmax(axis=1)]]
    return value


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    folded = np.arange(bands, dtype=np.uint64)
    for column in values.reshape(bands, rows).T:
        folded = _mix(folded * np.uint64(0x9E3779B97F4A7C15) + column)
    return folded.view(np.int64)


def _features(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 512):
                piece = batch.slice(part, 512)
                out: list[tuple] = []
                for text in piece.column("body"):
                    found = shingle_set(text.as_py(), width)
                    if len(found):
                        values = signature(found, bands * rows)
                        whole = np.frombuffer(hashlib.blake2b(found.tobytes(), digest_size=16).digest(), dtype=np.int64)
                        out.append((len(found), int(whole[0]), int(whole[1]), band_keys(values, bands, rows), (values >> np.uint64(3)).astype(np.uint8).tobytes()))
                    else:
                        out.append((0, None, None, None, None))
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("id"), piece.column("version"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.list_(pa.int64())), pa.array(columns[4], pa.binary())],
                    ["id", "version", "n_shingles", "h1", "h2", "bands", "sketch"],
                )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 256):
                piece = batch.slice(part, 256)
                found = [shingle_set(text.as_py(), width).view(np.int64) for text in piece.column("body")]
                yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(found, pa.list_(pa.int64()))], ["id", "shingles"])

    return run


def _agreeing(least: float, least_percent: int):
    """Keeps the pairs whose sketches agree in `least` of the bins, and those of a SMALL set if their sizes allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1) for c in ("sketch_a", "sketch_b"))
                pairs = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"])
                low, high = (f(batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()) for f in (np.minimum, np.maximum))
                yield pairs.filter(pa.array(np.where(low < SMALL, low * 100 >= high * least_percent, (a == b).mean(axis=1) >= least)))

    return run


@contextmanager
def _few_files(spark: SparkSession) -> Iterator[None]:
    """Inside, adaptive execution makes partitions of TABLE_BYTES, if there is so much, rather than one for each core. Nothing is
    joined beyond its advisory size, and a session that asks for larger ones keeps them."""
    name = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    before = spark.conf.get(name)
    as_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    advised = as_bytes(spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes"))
    spark.conf.set(name, f"{max(as_bytes(before), min(TABLE_BYTES, advised))}b")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """pairs with the components ca and cb of a and b, where they differ."""
    both = pairs.join(labels.select(F.col("id").alias("a"), F.col("comp").alias("ca")), "a").join(labels.select(F.col("id").alias("b"), F.col("comp").alias("cb")), "b")
    return both.filter("ca <> cb")


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (id, comp) after joining the components that the links (a, b) connect."""
    roots = connected(_apart(links, labels).select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    if roots is None:
        return labels
    moved = labels.join(materialise(roots, "roots").select(F.col("v").alias("comp"), "root"), "comp", "left")
    return materialise(moved.select("id", F.coalesce("root", "comp").alias("comp")), "labels")


def _families(crowd: DataFrame) -> DataFrame:
    """family, id: the members of large buckets (bucket, id, order, first, first_order), each bucket with the family of its
    first member. A member's own family is named by the earliest first of its buckets, so the buckets of one group of
    near copies meet in a few families, and two members of a bucket are in one family at least."""
    home = crowd.groupBy("id").agg(F.min_by("first", "first_order").alias("family"))
    of_bucket = crowd.select("bucket", "first").distinct().join(home.select(F.col("id").alias("first"), "family"), "first")
    pairs = crowd.join(of_bucket.select("bucket", "family"), "bucket")
    return materialise(pairs.select("family", "id", "order").distinct(), "families")


def _deltas(families: DataFrame, sets: DataFrame, least_percent: int) -> DataFrame:
    """family, id, size, dist, excess, delta: what a member's set and its family's consensus set don't share.

    The consensus holds the shingles that most of some CONSENSUS members have. It only serves to tell members apart:
    with any other set, the results are the same. excess is (100 + p) dist - (100 - p) size for a threshold of p
    percent. The sets of a and b with x common elements of their deltas are linked if and only if
    excess_a + excess_b <= 2 (100 + p) x."""
    drawn = families.join(families.groupBy("family").agg(F.count("*").alias("n")), "family").filter(F.col("order") * F.col("n") <= CONSENSUS)
    drawn = materialise(drawn.select("family", "id"), "drawn")
    held = drawn.join(sets, "id").select("family", F.explode("shingles").alias("s")).groupBy("family", "s").agg(F.count("*").alias("held"))
    most = held.join(drawn.groupBy("family").agg(F.count("*").alias("n")), "family").filter(2 * F.col("held") > F.col("n"))
    core = materialise(most.groupBy("family").agg(F.collect_list("s").alias("core")), "cores")
    both = families.select("family", "id").join(core, "family", "left").join(sets, "id")
    none = F.array().cast("array<bigint>")
    both = both.select("family", "id", "shingles", F.coalesce("core", none).alias("core"))
    found = both.select("family", "id", F.size("shingles").cast("long").alias("size"), F.concat(F.array_except("shingles", "core"), F.array_except("core", "shingles")).alias("delta"))
    found = found.withColumn("dist", F.size("delta").cast("long"))
    return materialise(found.withColumn("excess", (100 + least_percent) * F.col("dist") - (100 - least_percent) * F.col("size")), "deltas")


def _stars(deltas: DataFrame) -> DataFrame:
    """Links (a, b) of each family's centre, the member nearest the consensus, that hold whatever the deltas share: no set is read for them."""
    centres = deltas.groupBy("family").agg(F.min("excess").alias("low"), F.min_by("id", F.struct("excess", "id")).alias("a"))
    return deltas.join(materialise(centres, "centres"), "family").filter((F.col("excess") + F.col("low") <= 0) & (F.col("id") != F.col("a"))).select("a", F.col("id").alias("b"))


def _crowded_pairs(deltas: DataFrame, labels: DataFrame, least_percent: int) -> DataFrame:
    """Pairs (a, id) with all the links between members of one family that lie in different components.

    Such a link needs common elements in the deltas. Elements that only one component has can't be common; a member
    whose remaining ones are too few for any partner is left out by itself, without a pair. Of the others, those outside
    the component of the family's centre ask, with their rarest elements: as many as must hold a common one."""
    twice, rest = 2 * (100 + least_percent), (100 - least_percent) / least_percent
    now = deltas.join(labels, "id")
    spread = now.groupBy("family").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.min_by("comp", F.struct("excess", "id")).alias("main")).filter("least <> most")
    mains = materialise(spread.select("family", "main"), "mains")
    open_ = now.join(mains, "family")
    each = materialise(open_.select("family", "id", "comp", "main", "size", "dist", "excess", F.explode("delta").alias("s")), "elements")
    held = each.groupBy("family", "s").agg(F.count("*").alias("held"), F.min("comp").alias("least"), F.max("comp").alias("most")).filter("least <> most")
    shared = materialise(each.join(materialise(held.select("family", "s", "held"), "held"), ["family", "s"]), "shared")
    per = materialise(shared.groupBy("family", "id").agg(*(F.first(c).alias(c) for c in ("comp", "main", "size", "dist", "excess")), F.count("*").alias("d")), "counted")

    def need(low: str):
        """The fewest common elements that a link of this member to one with an excess of `low` or more has."""
        return F.greatest(F.lit(1), F.ceil((F.col("excess") + F.col(low)) / twice), F.ceil(F.col("dist") - F.col("size") * rest - 1e-9))

    def within(rows: DataFrame, bounds: DataFrame) -> DataFrame:
        """The members that can be linked with one inside the bounds of their family, with need."""
        limits = bounds.groupBy("family").agg(F.min("excess").alias("low"), F.max(twice * F.col("d") - F.col("excess")).alias("top"))
        near = rows.join(materialise(limits, "limits"), "family").withColumn("need", need("low"))
        return near.filter((F.col("excess") <= F.col("top")) & (F.col("d") >= F.col("need"))).drop("low", "top")

    asks = materialise(within(per.filter("comp <> main"), per), "asks")
    partners = materialise(within(per, asks), "partners")
    place = F.row_number().over(Window.partitionBy("family", "id").orderBy("held", "s"))
    either = asks.select("family", "id").unionByName(partners.select("family", "id")).distinct()
    ranked = shared.select("family", "id", "s", "held").join(either, ["family", "id"]).withColumn("k", place)
    ranked = materialise(ranked, "ranked")

    def prefix(rows: DataFrame) -> DataFrame:
        return ranked.join(rows, ["family", "id"]).filter(F.col("k") <= F.col("d") - F.col("need") + 1)

    left = prefix(asks).select("family", "s", "id", "comp", "size", "excess", "d", "k")
    right = prefix(partners).select("family", "s", F.col("id").alias("a"), F.col("comp").alias("comp_a"), F.col("main").alias("main_a"), F.col("size").alias("size_a"), F.col("excess").alias("excess_a"), F.col("d").alias("d_a"), F.col("k").alias("k_a"))
    common = F.least("k", "k_a") + F.least(F.col("d") - F.col("k"), F.col("d_a") - F.col("k_a"))
    fits = (F.col("excess") + F.col("excess_a") <= twice * common) & (F.least("size", "size_a") * 100 >= F.greatest("size", "size_a") * least_percent)
    once = (F.col("comp_a") == F.col("main_a")) | (F.col("a") < F.col("id"))
    return left.join(right, ["family", "s"]).filter((F.col("comp") != F.col("comp_a")) & once & fits).select("a", "id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, least_percent: int = LEAST_PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id linked to it, itself included) and kept (doc_id = component_id), a row for each row of docs.

    Texts are A-Z lower-cased; a set holds the distinct shingles of `width` words. Documents are linked if 100 times
    the intersection is at least least_percent of the union of their whole sets.

    Sets that are equal (by 128-bit hashes) form a class, and one text of each goes on; classes that share a doc_id are
    linked. The bands of a class deal it into
    buckets; in each bucket the members are compared with a centre, never with each other. Where a bucket then still
    holds more than one component, links between its other members may be missing. Large buckets are decided around a
    consensus set of their family: one star around the member nearest to it, then the few pairs of members of different
    components that what they don't share with it can't rule out (see _deltas). In small ones (under LARGE members)
    more members become centres, GROWTH times as many in each round, until the bucket is one component or all its
    members have been centres. So no link between members that share a bucket is lost. Sketches rule out most pairs of
    sets of SMALL shingles or more; the rest are compared on the full sets.

    An empty or null text has an empty set and is linked with nothing. Rows that repeat a doc_id are reported each and
    share a component; where their texts differ, each is compared with other ids' texts. A row
    without doc_id isn't linked: component_id null, kept true."""
    with scratch(docs.sparkSession), text_batches(docs.sparkSession), _few_files(docs.sparkSession):
        features, of_class = _components_of_classes(docs, doc_id, text, width, least_percent, bands, rows)
    found = features.select("id", "n_shingles", "h1", "h2").join(of_class, ["h1", "h2"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return found.select(F.col("id").alias(doc_id), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _components_of_classes(docs: DataFrame, doc_id: str, text: str, width: int, least_percent: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """The features of each row, and the component of each class (h1, h2): two tables that stay."""
    body = docs.select(F.col(doc_id).alias("id"), text_of(text).alias("body")).withColumn("version", F.xxhash64("body"))
    kind = body.schema["id"].dataType.simpleString()
    features = materialise(body.mapInArrow(_features(width, bands, rows), f"id {kind}, version bigint, n_shingles bigint, h1 bigint, h2 bigint, bands array<bigint>, sketch binary"), "features", keep=True)
    full = features.filter("n_shingles > 0 AND id IS NOT NULL")

    # A class is named by one of its hashes, or by both where two classes share that one.
    classes = full.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.min(F.struct("id", "version")).alias("row"))
    classes = materialise(classes.select("h1", "h2", "first", F.col("row.version").alias("version")), "classes")
    twice = materialise(classes.groupBy("h1").agg(F.count("*").alias("n")).filter("n > 1").select("h1"), "twice")
    named = classes.withColumn("node", F.col("h1"))
    if not twice.isEmpty():
        named = classes.join(twice.withColumn("twice", F.lit(True)), "h1", "left").withColumn("node", F.when(F.col("twice"), F.xxhash64("h1", "h2")).otherwise(F.col("h1"))).drop("twice")
    classes = materialise(named, "named-classes")
    firsts = classes.select(F.col("first").alias("id"), "version", "h1", "h2", "node")
    chosen = full.join(firsts, ["id", "version", "h1", "h2"]).select(F.col("node").alias("id"), F.col("id").alias("doc"), "version", "n_shingles", "bands", "sketch")
    chosen = materialise(chosen.dropDuplicates(["id"]), "chosen")

    # Classes that share a doc_id are linked from the start.
    several = materialise(full.groupBy("id").agg(F.min("h1").alias("low1"), F.max("h1").alias("high1"), F.min("h2").alias("low2"), F.max("h2").alias("high2")).filter("low1 <> high1 OR low2 <> high2").select("id"), "several")
    met = full.select("id", "h1", "h2").join(several, "id").join(classes.select("h1", "h2", "node"), ["h1", "h2"]).select("id", "node").distinct()
    met = materialise(met, "shared")
    ties = met.join(met.groupBy("id").agg(F.min("node").alias("a")), "id").select("a", F.col("node").alias("b"))

    dealt = chosen.select("id", F.explode("bands").alias("bucket"))
    sizes = materialise(dealt.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    # One order for all buckets: the same few members are centres in all the bands of a large group.
    order = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / float(1 << 40)
    members = materialise(dealt.join(sizes.select("bucket"), "bucket").withColumn("order", order), "members")
    alike = materialise(members.select("id").distinct(), "alike")
    tied = not met.isEmpty()
    labels = materialise((alike.unionByName(met.select(F.col("node").alias("id"))).distinct() if tied else alike).withColumn("comp", F.col("id")), "labels")
    if tied:
        labels = _relabelled(labels, ties)
    sketches = materialise(chosen.join(alike, "id", "left_semi").select("id", "n_shingles", "sketch"), "sketches")
    wanted = chosen.join(alike, "id", "left_semi").select(F.col("id").alias("node"), F.col("doc").alias("id"), "version")
    texts = body.join(wanted, ["id", "version"]).dropDuplicates(["node"]).select(F.col("node").alias("id"), "body")
    sets = materialise(texts.mapInArrow(_sets(width), "id bigint, shingles array<bigint>"), "sets")

    def linked(pairs: DataFrame) -> DataFrame:
        sides = [sets.select(F.col("id").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab"]
        shared = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", F.size(F.array_intersect("set_a", "set_b")).alias("common"), (F.size("set_a") + F.size("set_b")).alias("both"))
        return shared.filter(F.col("common") * 100 >= (F.col("both") - F.col("common")) * least_percent).select("a", "b")

    def close(pairs: DataFrame) -> DataFrame:
        sides = [sketches.select(F.col("id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in "ab"]
        drawn = pairs.join(sides[0], "a").join(sides[1], "b")
        return materialise(drawn.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(_agreeing(LEAST_SKETCH, least_percent), "a bigint, b bigint"), "close")

    def undecided(members: DataFrame) -> DataFrame:
        """The members, with comp, least (whether first in order) and the first member, of buckets that hold several components."""
        now = members.join(labels, "id")
        mixed = now.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min(F.struct("order", "id")).alias("least")).filter("low <> high")
        mixed = materialise(mixed.select("bucket", F.col("least.id").alias("first"), F.col("least.order").alias("first_order")), "mixed")
        return materialise(now.join(mixed, "bucket").withColumn("least", F.col("id") == F.col("first")), "open")

    def facing(members: DataFrame, centres: DataFrame) -> DataFrame:
        return members.join(centres.select("bucket", F.col("id").alias("a"), F.col("comp").alias("comp_a"), F.col("order").alias("order_a"), *([F.col("decided").alias("decided_a")] if "decided" in centres.columns else [])), "bucket").filter("comp <> comp_a")

    def paired(rows: DataFrame) -> DataFrame:
        return rows.select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct()

    members = undecided(members)
    if not members.isEmpty():
        met = facing(members, members.filter("least"))
        one = met.groupBy("id").agg(F.min_by("a", "order_a").alias("a"))
        labels = _relabelled(labels, linked(close(paired(one))))
        seen = close(_apart(paired(met), labels).select("a", "b"))
        labels = _relabelled(labels, linked(seen))
        members = undecided(members.select("bucket", "id", "order"))
        counts = materialise(members.groupBy("bucket").agg(F.count("*").alias("n")), "counts")
        rows = members.join(counts, "bucket")
        members = rows.filter(F.col("n") < LARGE).select("bucket", "id", "order", "n")
        crowd = materialise(rows.filter(F.col("n") >= LARGE), "crowd")
        if not crowd.isEmpty():
            deltas = _deltas(_families(crowd), sets, least_percent)
            labels = _relabelled(labels, _stars(deltas))
            labels = _relabelled(labels, linked(paired(_crowded_pairs(deltas, labels, least_percent))))
            # Pairs of one family are decided, whichever buckets they share.
            members = members.join(deltas.groupBy("id").agg(F.collect_set("family").alias("decided")), "id", "left")
        else:
            members = members.withColumn("decided", F.lit(None).cast("array<bigint>"))
        members = materialise(members, "small-buckets")

        # A bucket's centres are those whose order times its size is up to share, and its first; those up to done were some already.
        share, done = GROWTH, 0.0
        while done < LARGE:
            members = undecided(members.select("bucket", "id", "order", "n", "decided"))
            if members.isEmpty():
                break
            up_to = lambda limit: F.col("least") | (F.col("order") * F.col("n") <= limit)
            early = up_to(done) if done else F.lit(False)
            met = facing(members.filter(~early), members.filter(up_to(share) & ~early)).filter(~F.coalesce(F.arrays_overlap("decided", "decided_a"), F.lit(False)))
            found = close(paired(met).join(seen, ["a", "b"], "left_anti"))
            labels = _relabelled(labels, linked(found))
            seen = seen.unionByName(found)
            done, share = share, share * GROWTH

    placed = materialise(classes.join(labels.select(F.col("id").alias("node"), "comp"), "node", "left").select("h1", "h2", "first", F.coalesce("comp", "node").alias("comp")), "placed")
    lowest = materialise(placed.groupBy("comp").agg(F.min("first").alias("component")), "lowest")
    of_class = materialise(placed.join(lowest, "comp").select("h1", "h2", "component"), "components", keep=True)
    return features, of_class


def distinct_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row, all columns, of each group of rows that near_duplicates links: the one with the smallest doc_id (rows without
    doc_id come after all others, then by a hash of the text). A row goes or stays by its own text: rows that share a
    doc_id, or have none, are told apart by their texts. Of rows with the same doc_id and text, which are one document,
    one stays. Each row without words is a document of its own, unless doc_id and text repeat another's."""
    row = lambda: F.struct(F.col(f"`{doc_id}`").isNull().alias("unnamed"), F.col(f"`{doc_id}`").alias("id"), F.xxhash64(text_of(F.col(f"`{text}`"))).alias("version"))
    rows = docs.select(row().alias("__row"), F.col(f"`{text}`").alias("__text"))
    found = near_duplicates(rows, "__row", "__text", **options).filter("kept").select(F.col("__row").alias("__kept")).distinct()
    return docs.withColumn("__row", row()).join(found, F.col("__row") == F.col("__kept"), "left_semi").dropDuplicates(["__row"]).drop("__row")


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sets' sizes and components of all documents on two-word shingles; see near_duplicates for nulls and repeated rows."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


#: All pairs that share a shingle, and a walk along the links: for small tables.
ORACLE_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(list_transform(range(1, greatest(2, len(w))), lambda i: array_to_string(list_slice(w, i, i + 1), ' '))) AS s FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL) p
  JOIN sizes a ON a.doc_id = p.a JOIN sizes b ON b.doc_id = p.b WHERE 100 * common >= {LEAST_PERCENT} * (a.n + b.n - common)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
walk AS (SELECT doc_id, doc_id AS reached FROM documents UNION SELECT w.doc_id, e.b FROM walk w JOIN both_ways e ON e.a = w.reached)
SELECT d.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(w.reached) AS component_id, d.doc_id = min(w.reached) AS kept
FROM documents d JOIN walk w ON w.doc_id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""
