"""Expressions and helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import fringeflow.llm
from fringeflow.tables import materialise

# Kernels travel with their code, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(fringeflow.llm)

#: The white space of the contracts: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column = "text") -> Column:
    """The column as a string; null counts as empty."""
    return F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit(""))


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


def words_of(text: Column) -> Column:
    """The runs of characters other than white space, in order."""
    bare = trimmed(text)
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE + "+", -1))


def n_words_of(text: Column) -> Column:
    """size(words_of(text)) without building the words."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else untouched. Pure ASCII takes the byte-wise path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), evaluating value once even where body's lambdas use it for every element."""
    return F.transform(F.array(value), body)[0]


#: Rows of whole texts that go to a Python worker at once; Spark's own default is made for short rows.
TEXT_ROWS = 1000


@contextmanager
def text_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> Iterator[None]:
    """Inside, what is written goes to Python workers in batches of so many rows at most, so that neither side holds many texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Bytes of input for each task that shuffles whole texts; no more tasks than that for any input.
TASK_BYTES, MOST_TASKS = 128 << 20, 1_000_000


def tasks_for(docs: DataFrame, task_bytes: int = TASK_BYTES) -> int:
    """One task for each so many bytes of the tables that docs is made from, and at least as many as the session deals to. Where
    Spark doesn't know a table's size, it counts as nothing."""
    leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    size = sum(x for x in sizes if x < 1 << 60)
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, -(-size // task_bytes)))


#: A key is hot if it has at least this share of all rows, so there are at most 1 / HOT_SHARE such keys.
HOT_SHARE = 0.001


def skewed_join(big: DataFrame, lookup: DataFrame, keys: list[str], spread: str, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """big joined with lookup on keys, where a few keys may have a large share of big's rows.

    A hot key's rows are dealt over as many salts as it has thousandths of the rows, by a hash of the column `spread`,
    and its lookup rows are repeated for each salt. Only the hot keys, at most 1 / HOT_SHARE of them whatever the
    input's size, are broadcast. counts: keys and `rows` of big, where they are known already."""
    least = max(100.0, big.count() * HOT_SHARE)
    counts = big.groupBy(*keys).agg(F.count("*").alias("rows")) if counts is None else counts
    hot = materialise(counts.filter(F.col("rows") >= least).select(*keys, F.ceil(F.col("rows") / least).cast("int").alias("__copies")), "hot-keys")
    if hot.isEmpty():
        return big.join(lookup, keys, how)
    copies = F.coalesce("__copies", F.lit(1))
    salted = big.join(F.broadcast(hot), keys, "left").withColumn("__salt", F.pmod(F.xxhash64(spread), copies).cast("int")).drop("__copies")
    repeated = lookup.join(F.broadcast(hot), keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), copies - 1))).drop("__copies")
    return salted.join(repeated, [*keys, "__salt"], how).drop("__salt")
