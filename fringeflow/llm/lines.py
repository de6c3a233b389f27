"""Line dedup: lines that many documents share go, except in the last document that holds them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fringeflow.llm.common import LOWER, SPACE_CHARS, UPPER, ascii_lower, skewed_join, table, text_of, trimmed
from fringeflow.tables import materialise

MIN_CHARS, MIN_DOCS = 20, 3


def _kept_lines(lines: Column, dropped: Column) -> Column:
    """lines without those at the sorted positions `dropped`: slices between neighbours, linear in the lines."""
    before = F.transform(dropped, lambda p, k: F.slice(lines, F.coalesce(F.get(dropped, k - 1), F.lit(-1)) + 2, p - F.coalesce(F.get(dropped, k - 1), F.lit(-1)) - 1))
    last = F.element_at(dropped, -1)
    after = F.slice(lines, last + 2, F.size(lines) - last - 1)
    return F.flatten(F.concat(before, F.array(after)))


def drop_shared_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, text (what stays, lines joined by \\n), n_lines (before dropping) and n_dropped, a row for each row of docs.

    A line's key is the line without white space at its ends, A-Z lower-cased. Keys of min_chars code points or
    more that min_docs distinct documents hold lose all their lines but those in the largest doc_id holding it.

    A null or empty text is one empty line. Rows that repeat a doc_id are one document for the counts; each is
    returned. A row without doc_id counts for nothing and keeps all its lines. Only (hash, doc_id, position) of long
    lines is shuffled for the counts, with 128-bit hashes; a key that a large share of lines has is counted by partial
    sums and salted in the join."""
    body = docs.select(F.col(doc_id).alias("id"), text_of(text).alias("body")).withColumn("version", F.xxhash64("body"))
    exploded = body.filter(F.col("id").isNotNull()).select("id", "version", F.posexplode(F.split("body", "\n", -1)).alias("pos", "line"))
    key = exploded.select("id", "version", "pos", trimmed(F.col("line")).alias("line")).filter(F.char_length("line") >= min_chars).withColumn("key", ascii_lower(F.col("line")))
    found = materialise(key.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"), "id", "version", "pos"), "lines")

    counted = found.groupBy("h1", "h2", "id").agg(F.count("*").alias("rows")).groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("id").alias("keeper"), F.sum("rows").alias("rows"))
    shared = materialise(counted.filter(F.col("docs") >= min_docs).select("h1", "h2", "keeper", "rows"), "shared-lines")
    keepers = shared.select("h1", "h2", "keeper")
    gone = skewed_join(found, keepers, ["h1", "h2"], "id", counts=shared.select("h1", "h2", "rows")).filter(F.col("id") != F.col("keeper"))
    drops = gone.groupBy("id", "version").agg(F.sort_array(F.collect_set("pos")).alias("gone"))

    lines = F.split("body", "\n", -1)
    joined = body.join(drops, ["id", "version"], "left").select("id", "body", lines.alias("lines"), "gone")
    some = F.col("gone").isNotNull()
    return joined.select(
        F.col("id").alias(doc_id),
        F.when(some, F.array_join(_kept_lines(F.col("lines"), F.col("gone")), "\n")).otherwise(F.col("body")).alias(text),
        F.size("lines").cast("long").alias("n_lines"),
        F.when(some, F.size("gone")).otherwise(0).cast("long").alias("n_dropped"),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that every document loses, and what is left; see drop_shared_lines for nulls, ties and repeated rows."""
    kept = drop_shared_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


_TRIM = " || ".join(f"chr({ord(c)})" for c in SPACE_CHARS)

ORACLE_SQL = f"""
WITH lines AS (
  SELECT doc_id, pos, lines[pos] AS line, translate(trim(lines[pos], {_TRIM}), '{UPPER}', '{LOWER}') AS key
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
shared AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= {MIN_CHARS}
  GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
marked AS (
  SELECT l.doc_id, l.pos, l.line, s.key IS NOT NULL AND l.doc_id <> s.keeper AS gone
  FROM lines l LEFT JOIN shared s ON l.key = s.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
