"""A training corpus from raw documents: quality rules, near-dedup, decontamination, mixing, token files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fringeflow.llm import decontam, minhash, mixing, quality, tokens
from fringeflow.llm.common import table
from fringeflow.tables import shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the base rules and the threshold table. Each row is judged by itself: repeated rows agree, and
    a null or empty text has no words, so it goes."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group that five-word shingles link at a similarity of 0.8. Rows that
    share an id, or have none, are judged by their own texts; rows that repeat both id and text are one document. Each
    row without words stays."""
    return minhash.distinct_documents(docs, width=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that overlap with no benchmark item. Rows that share an id, or have none, are judged by their own texts;
    a null or empty text overlaps with nothing."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks, dealt to output shards and shuffled in each: the files are in
    that order. A null source is one of its own; repeated rows are drawn alike; texts without words go with their block."""
    return mixing.mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The digests of the token files, read back from them. The files keep the order of the mix's, without a shuffle, so repeated
    documents stay apart. A null or empty text is the end id alone; a null id is written as null."""
    return tokens.encoded(docs, ordered=False)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix_sources", mix_sources), ("token_output", token_output)]

#: SQL can't express near-dedup's reachability, the mix's draws or the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents, each stage's rows written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
