"""Quality rules: a threshold table compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fringeflow.llm.common import let, table, text_of, trimmed, words_of

WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to a in is that it was for on with as be by are this at from "
    "de la le et les des en du un une que pour est qui dans par sur pas avec au "
    "der die und den von das zu mit sich für nicht auf ist im dem ein eine als "
    "el y las los se del no con por para su al lo una"
).split()


@dataclass(frozen=True)
class Rule:
    """A document fails if 100 * metric lies outside [100 * least, 100 * most] per `per` (a metric's name, or None for a plain count)."""

    metric: str
    per: str | None = None
    least: float | None = None
    most: float | None = None


#: Base rules of the contract, then the method's own.
BASE_RULES = (Rule("n_words", least=20), Rule("n_repeat_words", "n_words", most=0.30))
RULES = (
    Rule("word_chars", "n_words", least=2.0, most=15.0),
    Rule("n_symbols", "n_words", most=0.25),
    Rule("n_stop_words", "n_words", least=0.03),
    Rule("n_dup_lines", "n_lines", most=0.60),
)


def compiled(rules: tuple[Rule, ...]) -> Column:
    """True where any rule fails. Ratios are compared by whole numbers, a zero divisor never fails."""
    failed = F.lit(False)
    for rule in rules:
        scale = 100 if rule.per else 1
        per = F.col(rule.per) if rule.per else F.lit(1)
        if rule.least is not None:
            failed = failed | (F.col(rule.metric) * scale < per * F.lit(round(rule.least * scale)))
        if rule.most is not None:
            failed = failed | (F.col(rule.metric) * scale > per * F.lit(round(rule.most * scale)))
    return failed


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in a window of `window` words that the text has twice or more.

    Windows are compared by 64-bit hashes of their words' hashes. Only a text with a repeated window is
    sorted: O(n log n), with no step that grows with the number of repeats times the text's length."""

    def covered(starts: Column) -> Column:
        reach = F.transform(starts, lambda p, k: F.least(F.lit(window), F.coalesce(F.get(starts, k + 1) - p, F.lit(window))))
        return F.aggregate(reach, F.lit(0), lambda total, n: total + n)

    def repeated(ordered: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(ordered, k)["h"] == x["h"], F.lit(False))
        marked = F.transform(ordered, lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"]))
        return F.sort_array(F.filter(marked, lambda i: i.isNotNull()))

    def of_windows(hashes: Column) -> Column:
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        found = let(F.sort_array(pairs), lambda ordered: let(repeated(ordered), covered))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(found)

    def of_words(each: Column) -> Column:
        last = F.size(each) - window
        hashes = F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.xxhash64(F.slice(each, i, F.lit(window))))
        return F.when(last < 0, F.lit(0)).otherwise(let(hashes, of_windows))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of_words).cast("long")


def measures(docs: DataFrame, keep: list[str], text: str = "text", stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """`keep` and the metrics: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (with a word), n_stop_words."""
    body = docs.select(*keep, text_of(text).alias("__text"))
    lines = F.filter(F.split("__text", "\n", -1), lambda x: trimmed(x) != "")

    def of_lines(each: Column) -> Column:
        return F.struct(F.size(each).cast("long").alias("n"), (F.size(each) - F.size(F.array_distinct(each))).cast("long").alias("dup"))

    def of_words(each: Column) -> Column:
        listed = F.filter(each, lambda w: F.rtrim(w, F.lit(".,;:")).isin(stop_words))
        return F.struct(F.size(each).cast("long").alias("n"), repeat_words(each).alias("repeat"), F.size(listed).cast("long").alias("stop"))

    space = F.regexp_count("__text", F.lit(r"[\x20\x09-\x0D]"))
    return body.select(
        *keep,
        let(words_of(F.col("__text")), of_words).alias("__w"),
        (F.char_length("__text") - space).cast("long").alias("word_chars"),
        F.regexp_count("__text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, of_lines).alias("__l"),
    ).select(
        *keep,
        F.col("__w.n").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("__l.dup").alias("n_dup_lines"),
        F.col("__w.repeat").alias("n_repeat_words"),
        F.col("__l.n").alias("n_lines"),
        F.col("__w.stop").alias("n_stop_words"),
    )


def judge(docs: DataFrame, keep: list[str], text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """measures() with base_failed and kept. A null or empty text has no words: base_failed, not kept. Every
    row gets its own verdict, so repeated rows agree; columns other than `keep` and the text aren't read."""
    return measures(docs, keep, text).withColumn("base_failed", compiled(BASE_RULES)).withColumn("kept", ~F.col("base_failed") & ~compiled(rules))


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs, all columns, that pass every rule. Each row is judged by its own text: repeated rows agree, a null or empty
    text has no words and goes."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row")
    packed = docs.select(whole, text_of(text).alias("__body"))
    kept = judge(packed, ["__row"], "__body", rules).filter("kept")
    return kept.select(*(F.col("__row").getField(c).alias(c) for c in docs.columns))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base measures and the verdict of every document; see judge for nulls and repeated rows."""
    found = judge(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _in_sql() -> str:
    return ", ".join(f"'{w}'" for w in STOP_WORDS)


def _failed_sql(rules: tuple[Rule, ...]) -> str:
    parts = []
    for rule in rules:
        scale, per = (100, rule.per) if rule.per else (1, "1")
        if rule.least is not None:
            parts.append(f"{rule.metric} * {scale} < {per} * {round(rule.least * scale)}")
        if rule.most is not None:
            parts.append(f"{rule.metric} * {scale} > {per} * {round(rule.most * scale)}")
    return " OR ".join(parts)


ORACLE_SQL = rf"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(list_slice(words, i, i + {WINDOW - 1}), ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM base WHERE len(words) >= {WINDOW})),
repeats AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM (
      SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS times FROM windows) WHERE times >= 2)
  GROUP BY doc_id),
metrics AS (
  SELECT b.doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(body) - len(regexp_extract_all(body, '[\x20\x09-\x0D]')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(body, '{SYMBOLS}')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(list_filter(words, lambda w: rtrim(w, '.,;:') IN ({_in_sql()}))) AS BIGINT) AS n_stop_words
  FROM base b LEFT JOIN repeats r ON b.doc_id IS NOT DISTINCT FROM r.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       ({_failed_sql(BASE_RULES)}) AS base_failed,
       NOT ({_failed_sql(BASE_RULES)}) AND NOT ({_failed_sql(RULES)}) AS kept
FROM metrics
"""
