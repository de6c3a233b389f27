"""Token-ID output: Parquet files of token lists in document order, with controlled encodings, row groups and pages."""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fringeflow.llm.common import table, tasks_for, text_batches, text_of
from fringeflow.tables import shared_dir

#: Words, and letter runs, whose ids a Python worker keeps over its tasks (some 120 bytes each); others are encoded again.
CACHED_WORDS = 300_000
#: A run of Latin letters, then ASCII signs other than the apostrophe, which can join a letter in one pre-token.
SIMPLE = r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)([!-&(-/:-@\[-`{-~]*)"
#: ids draw on one vocabulary, so they take a dictionary; the other columns rise or vary little, so they take deltas (format v2).
LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.page.row.count.limit": "2000",
}


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if it is printable Latin-1, else one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class WordEncoder:
    """A tokenizer's ids of a text, word by word, as little-endian 32-bit integers.

    Words are cut at spaces and line ends, which no normal form, pre-token or special token of the vocabularies meant
    here reaches over, so the ids are those of the whole text. A word of Latin letters and signs is lower-cased and given
    to the merges at once, without normaliser and pre-tokenizer, which leave it as it is; all others take the full way."""

    def __init__(self, vocabulary: bytes, cached_words: int = CACHED_WORDS):
        import json
        import re

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(vocabulary)
        self.model, self.most = self.tokenizer.model, cached_words
        self.known: dict[str, bytes] = {"": b""}
        self.runs: dict[str, bytes] = {}
        config = json.loads(vocabulary)
        kinds = [x.get("type") for x in (config.get("normalizer") or {}).get("normalizers", [])]
        split = [x.get("type") for x in (config.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        # The short way is for this chain of steps only.
        self.simple = re.compile(SIMPLE) if kinds == ["NFC", "Replace", "Lowercase"] and split == ["Split", "ByteLevel"] else None
        self.letters = byte_letters()

    def _full(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<i4").tobytes()

    def _run(self, run: str) -> bytes:
        found = self.runs.get(run)
        if found is None:
            text = run if run.isascii() else run.encode().decode("latin-1").translate(self.letters)
            found = np.array([t.id for t in self.model.tokenize(text)], dtype="<i4").tobytes()
            if len(self.runs) < self.most and len(run) < 64:
                self.runs[run] = found
        return found

    def fresh(self, word: str) -> bytes:
        m = self.simple.fullmatch(word) if self.simple else None
        if m:
            signs = m[2]
            found = self._run(m[1].lower())
            if signs:
                tail = self.runs.get(signs)
                if tail is None:
                    tail = self._full(signs)
                    if len(self.runs) < self.most and len(signs) < 64:
                        self.runs[signs] = tail
                found += tail
        else:
            found = self._full(word)
        if len(self.known) < self.most and len(word) < 64:
            self.known[word] = found
        return found

    def encode(self, text: str) -> bytes:
        words = text.replace("\n", " ").split(" ")
        parts = list(map(self.known.get, words))
        at = -1
        try:
            while True:
                at = parts.index(None, at + 1)
                parts[at] = self.fresh(words[at])
        except ValueError:
            return b"".join(parts)


def _encode(vocabulary: bytes, end_id: int, cached_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sys
        import types

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import TaskContext

        # A worker process serves many tasks; the module outlives this function's own globals.
        kept = sys.modules.setdefault("_word_encoders", types.ModuleType("_word_encoders"))
        key = zlib.crc32(vocabulary)
        if getattr(kept, "key", None) != key:
            kept.key, kept.encoder = key, WordEncoder(vocabulary, cached_words)
        encoder = kept.encoder
        shard, start = TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype="<i4").tobytes()
        for batch in batches:
            for part in range(0, batch.num_rows, 256):
                piece = batch.slice(part, 256)
                ids = [encoder.encode(x) + end for x in piece.column("body").to_pylist()]
                sizes = np.array([len(x) // 4 for x in ids], dtype=np.int64)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                values = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(np.full(len(ids), shard, dtype=np.int32)), pa.array(start + ends[:-1]), pa.array(sizes), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)],
                    ["doc_id", "shard", "shard_start", "n_tokens", "ids"],
                )
                start += int(ends[-1])

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 1, doc_id: str = "doc_id", text: str = "text", shards: int | None = None, ordered: bool = True, layout: dict[str, str] = LAYOUT) -> None:
    """Writes path/tokens (doc_id, shard, shard_start, n_tokens, ids) and path/shards (shard, n_docs, n_tokens, base).

    Each file holds a range of the documents in ascending doc_id order, null first; rows of one doc_id are in the
    order of a hash of their text, so repeated rows are told apart only by place. There are as many files as the input's bytes ask for,
    unless shards says how many. If not ordered, a file holds a partition of docs
    as it comes, without a shuffle: for a table that was shuffled when it was written. A null or empty text is end_id
    alone. Other columns of docs aren't written. vocabulary: a file that the driver reads; its bytes go with the
    tasks. A failed task writes its range again, from the same sorted rows."""
    spark = docs.sparkSession
    with open(vocabulary, "rb") as file:
        content = file.read()
    body = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("body"))
    if ordered:
        tied = body.withColumn("tie", F.xxhash64("body"))
        body = tied.repartitionByRange(shards or tasks_for(body), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "body")
    kind = body.schema["doc_id"].dataType.simpleString()
    coded = body.mapInArrow(_encode(content, end_id, CACHED_WORDS), f"doc_id {kind}, shard int, shard_start bigint, n_tokens bigint, ids array<int>")
    with text_batches(spark):
        coded.write.options(**layout).parquet(f"{path}/tokens")

    # One row per file: only the small columns are read, and what is gathered grows with the files, not the documents.
    sums = spark.read.parquet(f"{path}/tokens").groupBy("shard").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sums.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).coalesce(1).write.parquet(f"{path}/shards")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids. Unused columns aren't read from the files."""
    rows = spark.read.parquet(f"{path}/tokens")
    bases = spark.read.parquet(f"{path}/shards").select("shard", "base")
    # One row of two numbers for each written file.
    return rows.join(F.broadcast(bases), "shard").select("doc_id", (F.col("base") + F.col("shard_start")).alias("start"), "n_tokens", "ids")


def read_range(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """read_tokens() of the documents whose doc_id lies between first and last, both included. Files, row groups and, by the
    page indexes, pages of other documents are skipped, those of ids too. Ordered files hold them side by side."""
    found = read_tokens(spark, path)
    if first is not None:
        found = found.filter(F.col("doc_id") >= first)
    return found.filter(F.col("doc_id") <= last) if last is not None else found


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        values, ends = np.asarray(lists.flatten(), dtype="<u4"), np.asarray(lists.offsets, dtype=np.int64)
        ends = ends - ends[0]
        sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(np.diff(ends)), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def digests(tokens: DataFrame) -> DataFrame:
    """Per document of read_tokens(): doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""
    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "start", "ids").mapInArrow(_digests, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded(docs: DataFrame, ordered: bool = True) -> DataFrame:
    """Writes the tokens of docs to a new folder beside the checkpoints and returns the digests read back from it."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, vocabulary_path(), ordered=ordered)
    return digests(read_tokens(spark, path))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of all documents' tokens, read back from the files; see write_tokens for nulls and repeated rows."""
    return encoded(table(spark, sf_dir, "documents"))
