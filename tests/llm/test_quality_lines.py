import hashlib
import re
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fringeflow.llm import lines, quality
from fringeflow.llm.registry import oracle_sql, queries
from tests.conftest import canonical

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeated(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts = Counter(windows)
    return len({p for i, w in enumerate(windows) if counts[w] > 1 for p in range(i, i + 8)})


def test_sql_agrees(spark, tables, duck):
    for name, sql in oracle_sql().items():
        assert canonical(queries()[name](spark, tables).toPandas()) == canonical(duck.execute(sql).fetchdf()), name


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(["a", "b", "the", "c\n", "é", "#"]), max_size=60), min_size=1, max_size=8))
def test_repeat_words(spark, texts):
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    found = {r["doc_id"]: r["n_repeat_words"] for r in quality.measures(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()}
    assert found == {i: repeated(t) for i, t in rows}


def test_odd_documents(odd, none, odd_rows):
    found = quality.judge(odd, ["doc_id"]).collect()
    assert len(found) == len(odd_rows)
    assert all(not r["kept"] for r in found if r["n_words"] < 20)
    assert {r["n_words"] for r in found if r["doc_id"] == 5} == {30_000}
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns
    assert 0 < kept.count() < odd.count()
    assert quality.keep_good(none).count() == 0


def test_labels_are_followed(spark, tables):
    """The rules keep what is labelled good and drop most of the rest."""
    verdicts = quality.judge(spark.read.parquet(f"{tables}/documents.parquet"), ["doc_id"]).filter("n_words >= 20").join(spark.read.parquet(f"{tables}/labels.parquet"), "doc_id")
    rates = {r["quality"]: r["rate"] for r in verdicts.groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("rate")).collect()}
    assert rates[1] > 0.95
    assert rates.get(0, 0) < 0.2


def test_lines(odd, none, odd_rows):
    found = lines.drop_shared_lines(odd).collect()
    assert len(found) == len(odd_rows)
    by_id = {}
    for r in found:
        by_id.setdefault(r["doc_id"], []).append(r)
    # Two ids hold row 7's line (repeats of one id count once), so it stays.
    assert all(r["n_dropped"] == 0 for r in by_id[7])
    assert by_id[1][0]["n_lines"] == 1 and by_id[3][0]["n_lines"] == 3
    assert lines.drop_shared_lines(none).count() == 0


def test_line_positions(spark):
    shared, other = "This Line is shared by many.", "  this line is SHARED by many.\t"
    rows = [(1, f"one\n{shared}\n\ntwo\n{other}"), (2, shared), (3, f"{other}\nthree"), (4, "short\nshort"), (5, "short"), (6, "short"), (None, shared)]
    found = {r["doc_id"]: r for r in lines.drop_shared_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1]["text"] == "one\n\ntwo" and found[1]["n_dropped"] == 2
    assert found[2]["text"] == "" and found[2]["n_lines"] == 1
    assert found[3]["text"] == f"{other}\nthree"
    assert found[4]["text"] == "short\nshort"
    assert found[None]["text"] == shared
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
