"""Benchmark decontamination by spaced seeds: hashes that skip some token positions, then substitution-tolerant overlaps around the hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fringeflow.llm.common import LOWER, UPPER, ascii_lower, let, table, text_of
from fringeflow.tables import materialise

#: Fixed masks: a word at a 1 counts, a word at a 0 may differ. An item of 13 words or more keeps a seed whatever one word is replaced.
MASKS = ("11101101", "110100111")
#: With these, by enumeration, every run that makes an item of 15 words or more count holds a seed,
MORE_MASKS = ("11101000001", "111101")
#: and with this one every run that makes a shorter item count. Documents are searched for it only where there are such items.
SHORT_WORDS, SHORT_MASKS = 15, ("11101",)
#: Runs of ASCII characters other than letters and digits part words; letters beyond ASCII belong to words.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: An overlap counts if its best run has so many equal words, or nearly the whole of a shorter item.
LEAST_WORDS, LEAST_SHARE = 12, 0.8
#: In a run an equal word counts 1 and a different one as much against it.
PENALTY = 2
#: Seeds of the benchmark up to this number are broadcast (24 bytes each), and its words; beyond, both sides are shuffled.
BROADCAST_SEEDS = 2_000_000
#: Up to so many beginnings of seeds are part of the plan, so that most places of a document are never hashed for a mask.
MOST_HEADS = 20_000


def tokens(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), BREAK, -1), lambda w: w != "")


def word_hashes(text: Column) -> Column:
    return F.transform(tokens(text), lambda w: F.xxhash64(w))


def _starts(words: Column, span: int) -> Column:
    """0 .. the last place where `span` words fit; empty where they don't."""
    last = F.size(words) - span
    return F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def _seed(words: Column, mask: str, at: Column) -> Column:
    return F.xxhash64(F.lit(mask), *(F.get(words, at + i) for i, bit in enumerate(mask) if bit == "1"))


def seeds(words: Column, mask: str) -> Column:
    """The hash of each place of the mask over the words, in order."""
    return F.transform(_starts(words, len(mask)), lambda at: _seed(words, mask, at))


def _head_size(masks: tuple[str, ...]) -> int:
    """How many words at a place's start count in every mask."""
    return min(len(m) - len(m.lstrip("1")) for m in masks)


def _head(words: Column, size: int, at: Column) -> Column:
    return F.xxhash64(*(F.get(words, at + i) for i in range(size)))


def _heads(items: DataFrame, size: int) -> list[int] | None:
    """The hashes of all runs of `size` words in the items, the only places of a document that can hold a seed of theirs; None if
    there are more than MOST_HEADS."""
    each = items.select(F.explode(let(word_hashes(F.col("body")), lambda w: F.transform(_starts(w, size), lambda at: _head(w, size, at)))).alias("h")).distinct()
    found = [r["h"] for r in each.limit(MOST_HEADS + 1).collect()]
    return found if len(found) <= MOST_HEADS else None


def _seeded(table_: DataFrame, key: str, masks: tuple[str, ...], heads: list[int] | None = None) -> DataFrame:
    """key, seed and at (place in the text): small rows, whatever a text's length. With heads, only of places that start with one: these
    are looked for once, before any mask is hashed."""
    size = _head_size(masks)

    def of_places(words: Column, places: Column) -> Column:
        each = lambda m: F.transform(F.filter(places, lambda at: at + len(m) <= F.size(words)), lambda at: F.struct(_seed(words, m, at).alias("seed"), at.alias("at")))
        return F.flatten(F.array(*map(each, masks)))

    def listed(words: Column) -> Column:
        places = _starts(words, size)
        if heads is not None:
            places = F.filter(places, lambda at: _head(words, size, at).isin(heads)) if heads else F.array().cast("array<int>")
        return let(places, lambda p: of_places(words, p))

    return table_.select(key, F.explode(let(word_hashes(F.col("body")), listed)).alias("s")).select(key, "s.seed", "s.at")


def best_run(equal: Column, penalty: int = PENALTY) -> Column:
    """Of an array of 0 and 1: how many 1 the best-scoring run has (each 1 scores 1, each 0 loses `penalty`)."""
    zero = F.struct(F.lit(0).alias("score"), F.lit(0).alias("hits"), F.lit(0).alias("best"), F.lit(0).alias("found"))

    def step(s: Column, x: Column) -> Column:
        score = s["score"] + F.when(x == 1, F.lit(1)).otherwise(F.lit(-penalty))
        hits = s["hits"] + x
        alive = score > 0
        better = alive & (score > s["best"])
        return F.struct(
            F.when(alive, score).otherwise(0).alias("score"),
            F.when(alive, hits).otherwise(0).alias("hits"),
            F.when(better, score).otherwise(s["best"]).alias("best"),
            F.when(better, hits).otherwise(s["found"]).alias("found"),
        )

    return F.aggregate(equal, zero, step, lambda s: s["found"])


def overlaps(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", masks: tuple[str, ...] = MASKS + MORE_MASKS, short_masks: tuple[str, ...] = SHORT_MASKS, least_words: int = LEAST_WORDS, least_share: float = LEAST_SHARE) -> DataFrame:
    """doc_id, item_id, matched (equal words of the best run), item_words: a row for each document and item that overlap.

    A hit of a seed fixes how item and document are aligned; along it, words are compared over the whole item, so words
    may be replaced between and around the seed's. The pair counts if the best run has least_words equal words, or
    least_share of the item's words where that is less (and 5 at least). Null and empty texts overlap with nothing,
    nor do items of fewer than 5 words. Other bounds than the given ones may need other masks. Rows that repeat a doc_id or an item_id give one row, with
    the best match; rows without doc_id or item_id are left out.

    The first pass moves only hits; texts are then joined with the hits of their document, so an alignment costs its
    item's words and not its text's."""
    body = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("body")).filter("doc_id IS NOT NULL")
    test = items.select(F.col(item_id).alias("item_id"), text_of(item_text).alias("body")).filter("item_id IS NOT NULL")
    short = test.filter(F.size(tokens(F.col("body"))).between(5, SHORT_WORDS - 1))
    theirs, used = _seeded(test, "item_id", masks), masks
    if not short.isEmpty():
        theirs, used = theirs.unionByName(_seeded(short, "item_id", short_masks)), masks + short_masks
    theirs = theirs.select("item_id", "seed", F.col("at").alias("item_at"))
    small = theirs.count() <= BROADCAST_SEEDS
    hits = _seeded(body, "doc_id", used, _heads(test, _head_size(used))).join(F.broadcast(theirs) if small else theirs, "seed")
    found = materialise(hits.select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct(), "seed-hits")
    # Only the words of items with a hit are needed; short items have words and no seeds, so these are counted by themselves.
    words = materialise(test.select("item_id", word_hashes(F.col("body")).alias("item")).join(found.select("item_id").distinct(), "item_id", "left_semi"), "hit-items")
    few = (words.agg(F.sum(F.size("item"))).first()[0] or 0) <= BROADCAST_SEEDS
    # A text is hashed once, whatever the number of its hits.
    hit = body.join(found.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", word_hashes(F.col("body")).alias("own"))
    met = hit.join(found, "doc_id").join(F.broadcast(words) if few else words, "item_id")
    aligned = F.transform("item", lambda w, i: F.coalesce((F.get("own", F.col("shift") + i) == w).cast("int"), F.lit(0)))
    scored = met.select("doc_id", "item_id", F.size("item").alias("item_words"), best_run(aligned).alias("matched"))
    enough = F.col("matched") >= F.greatest(F.lit(5), F.least(F.lit(least_words), F.ceil(F.col("item_words") * least_share)))
    return scored.filter(enough).groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"), F.max("item_words").alias("item_words"))


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs that overlap with no item, all columns. A row goes or stays by its own text: rows that share a doc_id,
    or have none, are told apart by their texts, and repeated rows go together."""
    key = F.struct(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(text_of(F.col(f"`{text}`"))).alias("version"))
    rows = docs.select(key.alias("__row"), F.col(f"`{text}`").alias("__text"))
    found = overlaps(rows, items, "__row", "__text", **options).select(F.col("doc_id").alias("__leak")).distinct()
    return docs.join(found, key == F.col("__leak"), "left_anti")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All overlaps of documents with benchmark items; see overlaps for nulls and repeated rows."""
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _seed_sql(mask: str) -> str:
    ones = [i for i, bit in enumerate(mask) if bit == "1"]
    words = ", ".join(f"w[i + {k}]" for k in ones)
    return f"SELECT kind, id, i, concat_ws('|', '{mask}', {words}) AS seed FROM (SELECT kind, id, w, unnest(range(1, len(w) - {len(mask) - 2})) AS i FROM words WHERE len(w) >= {len(mask)})"


_ZERO = "{'score': 0, 'hits': 0, 'best': 0, 'found': 0}"
_STEP = (
    "{'score': CASE WHEN s.score + x.score > 0 THEN s.score + x.score ELSE 0 END, 'hits': CASE WHEN s.score + x.score > 0 THEN s.hits + x.hits ELSE 0 END, "
    "'best': CASE WHEN s.score + x.score > 0 AND s.score + x.score > s.best THEN s.score + x.score ELSE s.best END, "
    "'found': CASE WHEN s.score + x.score > 0 AND s.score + x.score > s.best THEN s.hits + x.hits ELSE s.found END}"
)

ORACLE_SQL = rf"""
WITH words AS (
  SELECT kind, id, list_filter(string_split_regex(translate(body, '{UPPER}', '{LOWER}'), '{BREAK}'), lambda w: w <> '') AS w FROM (
    SELECT 'd' AS kind, doc_id AS id, coalesce(text, '') AS body FROM documents UNION ALL SELECT 'i', item_id, coalesce(text, '') FROM benchmark)),
seeds AS ({" UNION ALL ".join(_seed_sql(m) for m in MASKS)}),
shifts AS (
  SELECT DISTINCT d.id AS doc_id, t.id AS item_id, d.i - t.i AS shift FROM seeds d JOIN seeds t ON d.seed = t.seed WHERE d.kind = 'd' AND t.kind = 'i'),
aligned AS (
  SELECT doc_id, item_id, len(t.w) AS item_words,
         list_transform(range(1, len(t.w) + 1), lambda k: CASE WHEN k + shift >= 1 AND d.w[k + shift] = t.w[k] THEN 1 ELSE 0 END) AS equal
  FROM shifts s JOIN words d ON d.kind = 'd' AND d.id = s.doc_id JOIN words t ON t.kind = 'i' AND t.id = s.item_id),
scored AS (
  SELECT doc_id, item_id, item_words, list_reduce(list_prepend({_ZERO}, list_transform(equal, lambda e: {{'score': CASE WHEN e = 1 THEN 1 ELSE -{PENALTY} END, 'hits': e, 'best': 0, 'found': 0}})), lambda s, x: {_STEP}).found AS matched
  FROM aligned)
SELECT doc_id, item_id, CAST(max(matched) AS INT) AS matched, CAST(max(item_words) AS INT) AS item_words FROM scored
WHERE matched >= greatest(5, least({LEAST_WORDS}, ceil(item_words * {LEAST_SHARE}))) GROUP BY doc_id, item_id
"""
