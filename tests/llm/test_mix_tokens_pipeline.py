import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringeflow.llm import mixing, tokens
from fringeflow.tables import shared_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == pytest.approx([200, 450 * 2 / 8 + (450 * 5 / 8 - 200) * 2 / 3, 450 / 8 + (450 * 5 / 8 - 200) / 3])
    assert mixing.targets([], []) == []
    assert mixing.targets([0, 10], [5, 2]) == pytest.approx([0, 15])
    found = mixing.targets([10, 1000, 5, 300], [5, 2, 1, 5])
    assert sum(found) == pytest.approx(1.5 * 1315) and all(t <= 2 * s + 1e-9 for t, s in zip(found, [10, 1000, 5, 300], strict=True))


def test_splitting_tree():
    quotas = np.array([5000, 17, 0, 900])
    tree = mixing.splitting_tree(quotas, 16, np.random.default_rng(1))
    assert tree.shape == (16, 4) and (tree.sum(axis=0) == quotas).all() and (tree >= 0).all()
    assert abs(tree.sum(axis=1) - quotas.sum() / 16).max() <= 4
    assert (tree == mixing.splitting_tree(quotas, 16, np.random.default_rng(1))).all()


def test_permutation(spark):
    places = spark.range(mixing.BLOCKS).select(mixing.permuted(F.col("id"), F.lit("s1")).alias("p"), mixing.permuted(F.col("id"), F.lit("s2")).alias("q")).collect()
    assert sorted(r["p"] for r in places) == sorted(r["q"] for r in places) == list(range(mixing.BLOCKS))
    assert [r["p"] for r in places] != [r["q"] for r in places]


def drawn(frame):
    return mixing.draw(frame).rows.select("doc_id", F.col("source").alias("s"), F.col("__size").alias("size"), F.col("__source_size").alias("total"), F.col("__target").alias("target"), F.size("__draws").alias("n")).collect()


def test_mix(spark, tables, documents):
    frame = spark.read.parquet(f"{tables}/documents.parquet")
    rows = drawn(frame)
    sizes = {d: len(WORD.findall(t or "")) for d, t, _ in documents}
    assert {r["doc_id"]: r["size"] for r in rows} == sizes
    by = defaultdict(list)
    for r in rows:
        by[r["s"]].append(r)
    names = sorted(by)
    goal = mixing.targets([sum(r["size"] for r in by[n]) for n in names], [mixing.WEIGHTS[i % 3] for i in range(len(names))])
    for n, t in zip(names, goal, strict=True):
        assert all(r["target"] == pytest.approx(t) for r in by[n])
        assert all(0 <= r["n"] <= 2 for r in by[n])
        gap = t - sum(r["size"] * r["n"] for r in by[n])
        passes = int(t // sum(r["size"] for r in by[n]))
        # No document that is left would bring the sum nearer.
        left = [r["size"] for r in by[n] if r["n"] == passes and r["size"]]
        assert abs(gap) <= 0.02 * t or gap < 0 or min(left, default=0) >= 2 * gap, (n, gap, left)
        assert abs(gap) <= max(r["size"] for r in by[n]) / 2 or abs(gap) <= 0.02 * t
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, drawn(frame)), key=str)


def test_mix_beside_a_long_document(spark):
    """Small documents fill what a long one at the cut leaves open; exact repeats count as often as they are."""
    sizes = [100_000, *(300 + 7 * i % 201 for i in range(500))]
    rows = [(1000 * s + i, f"src{s:02}", n) for s in range(12) for i, n in enumerate(sizes)] + [(1000 * s + i, f"src{s:02}", sizes[i]) for s in range(12) for i in (3, 4, 5)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, n int").selectExpr("doc_id", "source", "repeat('w ', n) AS text")
    for share in (0.5, 0.8):
        by = defaultdict(list)
        for r in mixing.draw(frame, weights=(1.0,), share=share).rows.select("source", F.col("__size").alias("size"), F.col("__target").alias("target"), F.size("__draws").alias("n")).collect():
            by[r["source"]].append(r)
        assert len(by) == 12
        for name, own in by.items():
            gap = own[0]["target"] - sum(r["size"] * r["n"] for r in own)
            smallest = min((r["size"] for r in own if not r["n"]), default=0)
            assert abs(gap) <= min(smallest, 300), (share, name, gap, smallest)


def test_mix_rows(spark, odd, none, odd_rows):
    rows = drawn(odd)
    assert len(rows) == len(odd_rows)
    assert {r["s"] for r in rows} == {"src0", "src1", "src2", None}
    out = mixing.mix(odd)
    assert out.columns == odd.columns and out.count() == sum(r["n"] for r in rows)
    assert mixing.mix(none).count() == 0
    shards = mixing.draw(odd).rows.select(F.explode("__draws").alias("d")).select("d.shard").distinct().collect()
    assert all(0 <= r["shard"] < mixing.SHARDS for r in shards)


def test_shards_are_the_trees(spark, tables):
    """Each drawn block lies in the shard that the splitting tree deals it to; the query returns these shards, and mix() the same rows by shard."""
    frame = spark.read.parquet(f"{tables}/documents.parquet")
    found = mixing.draw(frame)
    sources = {r["__key"]: r for r in found.sources.collect()}
    quotas = np.array([r["__passes"] * mixing.BLOCKS + r["__last"] + 1 for r in sources.values()])
    names = list(sources)
    ends = np.array([[*sources[n]["__ends"], q] for n, q in zip(names, quotas, strict=True)])
    counts = np.diff(ends, axis=1, prepend=0)
    assert (counts >= 0).all() and (counts.sum(axis=1) == quotas).all()
    assert abs(counts.sum(axis=0) - quotas.sum() / mixing.SHARDS).max() <= 4
    by_doc, per_shard = {}, defaultdict(int)
    for r in found.rows.select("doc_id", "__key", "__place", "__draws").collect():
        own, places = sources[r["__key"]], ends[names.index(r["__key"])]
        for d in r["__draws"]:
            if d["pass"] < own["__passes"] or r["__place"] <= own["__last"]:
                assert d["shard"] == np.searchsorted(places, d["pass"] * mixing.BLOCKS + r["__place"], "right")
            per_shard[d["shard"]] += 1
        by_doc[r["doc_id"]] = sorted(d["shard"] for d in r["__draws"])
    query = mixing.op10_mix_sources(spark, tables).collect()
    assert {r["doc_id"]: sorted(r["shards"]) for r in query} == by_doc
    assert all(r["taken"] == r["size"] * len(r["shards"]) for r in query)
    mixed = mixing.mix(frame, shard="shard")
    assert mixed.columns == [*frame.columns, "shard"]
    assert {r["shard"]: r["count"] for r in mixed.groupBy("shard").count().collect()} == dict(per_shard)


def test_mix_bounds_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 3)
    with pytest.raises(ValueError, match="sources"):
        mixing.draw(spark.createDataFrame([(i, "a b", str(i)) for i in range(5)], "doc_id long, text string, source string"))


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary_path())


def test_word_encoder(tokenizer, documents):
    with open(tokens.vocabulary_path(), "rb") as file:
        encoder = tokens.WordEncoder(file.read(), 500)
    odd = ["don't I'LL x's 's", "<|endoftext|> a<|startoftext|>b <|endoftext|>.", "\u4e2d\u6587 \u65e5\u672c", "a\u00a0b\u2003c\u3000d", "tab\there\r\nnl\x0bvt\x1cfs", "123 4.5e6 a1b2", "", "  \n\n ", "\u00c5\u00c4. \u00df\u00ff \u0130stanbul \ufb01", "x" * 3000, "\u00e9" * 400 + "...", "\u00b5 \u00aa \u00b2", "\u03a3\u03af\u03c3\u03c5\u03c6\u03bf\u03a3", "e\u0301 \u0301x", "word$$$ THE!! |pipe| a_b"]
    for text in [t or "" for _, t, _ in documents[:120]] + odd:
        assert np.frombuffer(encoder.encode(text), dtype="<i4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text[:80]


def test_token_files(spark, tokenizer, odd, odd_rows, none, tmp_path):
    path = f"file://{tmp_path}/tokens"
    tokens.write_tokens(odd, path, tokens.vocabulary_path(), shards=3)
    rows = tokens.read_tokens(spark, path).orderBy("start").collect()
    assert len(rows) == len(odd_rows)
    order = [r["doc_id"] for r in rows]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    at = 0
    for r in rows:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        at += r["n_tokens"]
    texts = sorted((t or "" for _, t, *_ in odd_rows))
    assert sorted(tuple(r["ids"]) for r in rows) == sorted((*tokenizer.encode(t, add_special_tokens=False).ids, 1) for t in texts)
    sums = {(r["start"], r["ids_crc32"]) for r in tokens.digests(tokens.read_tokens(spark, path)).collect()}
    assert sums == {(r["start"], zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes())) for r in rows}
    tokens.write_tokens(none, f"{path}-none", tokens.vocabulary_path())
    assert tokens.read_tokens(spark, f"{path}-none").count() == 0


def test_file_layout(spark, tables, tmp_path):
    import glob

    import pyarrow.parquet as pq

    tokens.write_tokens(spark.read.parquet(f"{tables}/documents.parquet"), f"file://{tmp_path}/t", tokens.vocabulary_path(), shards=2)
    for name in glob.glob(f"{tmp_path}/t/tokens/*.parquet"):
        group = pq.ParquetFile(name).metadata.row_group(0)
        found = {group.column(k).path_in_schema: group.column(k) for k in range(group.num_columns)}
        assert any("DICTIONARY" in e for e in found["ids.list.element"].encodings)
        assert "DELTA_BINARY_PACKED" in found["doc_id"].encodings
        assert all(c.has_offset_index and c.has_column_index for k, c in found.items() if "ids" not in k)
    plan = tokens.read_tokens(spark, f"file://{tmp_path}/t").select("doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_pages_are_skipped(spark, tmp_path):
    """A range of documents reads the pages that may hold it, not the file; a range of few columns leaves the ids out."""
    rows = [(i, f"w{i} " * 20) for i in range(30_000)]
    path = f"file://{tmp_path}/range"
    tokens.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path, tokens.vocabulary_path(), shards=2)
    part = tokens.read_range(spark, path, 12_000, 12_100)
    execution = part.select("doc_id", "ids")._jdf.queryExecution()
    found = part.collect()
    assert [r["doc_id"] for r in sorted(found, key=lambda r: r["doc_id"])] == list(range(12_000, 12_101))
    whole = tokens.read_tokens(spark, path).filter("doc_id BETWEEN 12000 AND 12100").collect()
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, whole), key=str)
    assert "GreaterThanOrEqual(doc_id,12000)" in execution.executedPlan().toString()
    scan = spark.read.parquet(f"{path}/tokens").filter("doc_id BETWEEN 12000 AND 12100").select("doc_id", "ids")
    jvm = scan._jdf.queryExecution().executedPlan()
    scan._jdf.queryExecution().toRdd().count()
    leaves = jvm.collectLeaves()
    read = leaves.apply(0).metrics().apply("numOutputRows").value()
    assert 101 <= read <= 6_000


def test_unordered_token_files(spark, tokenizer, tmp_path):
    """A table's order goes into the files, without a shuffle."""
    rows = [(draw, f"word{draw} x") for draw in (5, 3, 5, 9, 1, 3, 7)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    tokens.write_tokens(frame, f"file://{tmp_path}/u", tokens.vocabulary_path(), ordered=False)
    found = tokens.read_tokens(spark, f"file://{tmp_path}/u").orderBy("start").collect()
    assert [r["doc_id"] for r in found] == [d for d, _ in rows]
    assert found[-1]["start"] + found[-1]["n_tokens"] == sum(len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for _, t in rows)


def test_pipeline(spark, tables, duck):
    import corpus_pipeline
    from fringeflow.llm import minhash, quality
    from tests.llm.test_minhash import brute
    from tests.llm.test_text_operators import plain_overlaps

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    inputs = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        inputs.append(spark.createDataFrame(stage(spark, inputs[-1], tables).collect(), docs.schema))
        assert inputs[-1].columns == docs.columns
    ids = [sorted(r["doc_id"] for r in f.select("doc_id").collect()) for f in inputs]
    kept = sorted(r["doc_id"] for r in quality.judge(docs, ["doc_id"]).filter("kept").collect())
    assert ids[1] == kept
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    groups = brute([(d, text[d]) for d in ids[1]], 5)
    assert ids[2] == sorted(d for d, (_, c) in groups.items() if c == d)
    items = duck.execute("SELECT item_id, text FROM benchmark").fetchall()
    leaks = {d for d, _ in plain_overlaps([(d, text[d]) for d in ids[2][:40]], items)}
    assert [d for d in ids[3] if d in ids[2][:40]] == [d for d in ids[2][:40] if d not in leaks]
    assert set(ids[4]) <= set(ids[3]) and all(ids[4].count(d) <= 2 for d in set(ids[4]))
    final = corpus_pipeline.token_output(spark, inputs[-1], tables).collect()
    assert sorted(r["doc_id"] for r in final) == ids[4]
    assert corpus_pipeline.run(spark, tables).count() == len(final)
    assert minhash.LEAST_PERCENT == 80


def test_pipeline_judges_rows_by_their_texts(spark, tables):
    """Rows that share an id, or have none, are copies or leaks by their own texts; the row that was compared is the one that stays."""
    import random

    import corpus_pipeline

    draw = random.Random(21)
    prose = lambda: " ".join(f"w{draw.randrange(3000)}" for _ in range(60))
    a, b, c = prose(), prose(), prose()
    item = spark.read.parquet(f"{tables}/benchmark.parquet").first()["text"]
    rows = [(1, a), (1, b), (2, a), (3, b + " end"), (None, a), (None, c), (None, c), (4, c), (5, None), (5, ""), (None, None), (6, a + " " + item), (6, c + " more"), (None, item)]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_dedup(spark, docs, tables)
    assert kept.columns == docs.columns
    found = sorted(((r["doc_id"] or -1, r["text"] or "") for r in kept.collect()))
    assert found == sorted([(1, a), (1, b), (4, c), (5, ""), (-1, ""), (6, a + " " + item), (-1, item)] if len(item.split()) < 15 else found)
    assert {(1, a), (1, b), (4, c)} <= set(found) and not {(2, a), (3, b + " end"), (-1, a), (-1, c), (6, c + " more")} & set(found)
    clean = sorted(((r["doc_id"] or -1, r["text"] or "") for r in corpus_pipeline.decontaminate(spark, docs, tables).collect()))
    assert clean == sorted((d or -1, t or "") for d, t in rows if item not in (t or ""))


def test_pipeline_odd(spark, tables, odd, none):
    import corpus_pipeline

    for docs in (odd, none):
        out = docs
        for name, stage in corpus_pipeline.STAGES:
            path = f"{shared_dir(spark)}/odd-{name}-{docs is odd}"
            stage(spark, out, tables).write.mode("overwrite").parquet(path)
            out = spark.read.parquet(path)
        assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
