import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from fringeflow.llm import minhash
from fringeflow.operators import graph
from fringeflow.tables import materialise

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, width):
    sets = {}
    for d, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets[d] = frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders, common = defaultdict(list), Counter()
    for d, s in sets.items():
        for g in s:
            holders[g].append(d)
    for found in holders.values():
        common.update(itertools.combinations(sorted(found), 2))
    for (a, b), n in common.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in sets}


def got(frame):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in frame.collect()}


@pytest.mark.parametrize("width", [2, 5])
def test_documents(spark, tables, documents, width):
    found = minhash.near_duplicates(spark.read.parquet(f"{tables}/documents.parquet"), width=width)
    assert got(found) == brute([(d, t) for d, t, _ in documents], width)


def test_chains_and_threshold(spark):
    """Texts that drift apart link in a chain, and pairs just under the threshold don't."""
    draw = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, k = [], 0
    for _ in range(12):
        words = [draw.choice(vocabulary) for _ in range(draw.choice([12, 40, 150]))]
        for _ in range(8):
            rows.append((k, " ".join(words)))
            k += 1
            for _ in range(max(1, len(words) // draw.choice([15, 25, 40]))):
                words[draw.randrange(len(words))] = draw.choice(vocabulary)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(minhash.near_duplicates(frame, width=2)) == brute(rows, 2)


def test_large_group(spark):
    """One large group of near copies: many components in shared buckets are told apart."""
    draw = random.Random(9)
    base = [f"b{draw.randrange(200)}" for _ in range(100)]
    rows = []
    for k in range(150):
        words = list(base)
        for _ in range(draw.randrange(0, 14)):
            words[draw.randrange(100)] = f"b{draw.randrange(200)}"
        rows.append((k, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(minhash.near_duplicates(frame, width=2)) == brute(rows, 2)


def test_odd_documents(odd, none, odd_rows):
    found = minhash.near_duplicates(odd).collect()
    assert len(found) == len(odd_rows)
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[100]["component_id"] == 7 and not by_id[100]["kept"]
    assert by_id[0]["n_shingles"] == 0 and by_id[0]["component_id"] == 0
    assert by_id[None]["component_id"] is None and by_id[None]["kept"]
    assert minhash.near_duplicates(none).count() == 0


def test_word_hashes_by_pieces():
    text = ("One two\tthree " * 500 + "y" * 3000 + " END").encode()
    whole, pieces = minhash.word_hashes(text, 1 << 16), minhash.word_hashes(text, 64)
    assert np.array_equal(whole, pieces)
    assert len(whole) == 1502
    assert np.array_equal(minhash.word_hashes(b"The THE the"), np.repeat(minhash.word_hashes(b"the"), 3))


def test_sketches_estimate():
    draw = np.random.default_rng(1)
    for n in (4, 30, 2000):
        common = draw.integers(0, 2**63, n, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([common, draw.integers(0, 2**63, n // 4, dtype=np.uint64)])) for _ in "ab")
        near = (minhash.signature(a, 300) == minhash.signature(b, 300)).mean()
        assert abs(near - n / (n + 2 * (n // 4))) < 0.17


def test_short_pairs_skip_the_sketch(spark):
    """Sets of 5 and 4 shingles at the threshold whose sketches agree in too few bins."""
    draw, rows = random.Random(4), []
    while len(rows) < 6:
        words = [f"v{draw.randrange(10**6)}" for _ in range(6)]
        sets = [minhash.shingle_set(" ".join(w), 2) for w in (words, words[:5])]
        values = [minhash.signature(s, minhash.BANDS * minhash.ROWS) for s in sets]
        shared = (minhash.band_keys(values[0], minhash.BANDS, minhash.ROWS) == minhash.band_keys(values[1], minhash.BANDS, minhash.ROWS)).any()
        if shared and (values[0] == values[1]).mean() < minhash.LEAST_SKETCH:
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words[:5]))]
    assert got(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2)) == brute(rows, 2)


def test_every_text_of_an_id_is_compared(spark):
    """Whichever text of id 1 has the least hash, ids 5 and 6 are linked, and so is 1 with both and with 8."""
    draw = random.Random(11)
    prose = lambda: [f"t{draw.randrange(10**6)}" for _ in range(60)]
    one, two, other = prose(), prose(), prose()
    near = lambda w: " ".join([*w[:-1], "changed"])
    for a, b in ((one, two), (two, one)):
        rows = [(1, " ".join(a)), (1, " ".join(b)), (5, " ".join(b)), (6, near(b)), (8, near(a)), (9, " ".join(other)), (9, ""), (None, " ".join(b))]
        found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()
        assert sorted((r["doc_id"], r["component_id"]) for r in found if r["doc_id"]) == [(1, 1), (1, 1), (5, 1), (6, 1), (8, 1), (9, 9), (9, 9)]


def test_components(spark):
    draw = random.Random(2)
    pairs = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [tuple(draw.sample(range(200, 260), 2)) for _ in range(40)]
    roots = {r["v"]: r["root"] for r in graph.connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    parent = {v: v for p in pairs for v in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[root(a)] = root(b)
    groups = lambda f: {frozenset(v for v in parent if f(v) == f(u)) for u in parent}
    assert groups(root) == groups(roots.get)
    assert graph.connected(spark.createDataFrame([(1, 1)], "a long, b long")) is None


@pytest.mark.parametrize("width", [2, 5])
def test_large_group_of_near_copies(spark, width):
    """Hundreds of copies of one text, changed in zero to many places, about the threshold of each other: their consensus
    tells all components apart, those of several copies that only share changes included; a second text joins the buckets."""
    draw = random.Random(11)
    base, other = ([f"w{draw.randrange(800)}" for _ in range(90)] for _ in range(2))
    changed = [list(base) for _ in range(4)]  # changes that some copies have in common
    for words in changed:
        for i in draw.sample(range(90), 6 if width == 5 else 12):
            words[i] = f"c{draw.randrange(10**6)}"
    rows = []
    for k in range(500):
        words = list(draw.choice([base, base, base, other, *changed]))
        for i in draw.sample(range(90), draw.choice([0, 1, 2, 3, 4, 5, 8, 12])):
            words[i] = f"x{draw.randrange(40)}"
        rows.append((k, " ".join(words)))
    expected = brute(rows, width)
    assert 2 < len({c for _, c in expected.values()}) < 480
    assert got(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=width)) == expected


def test_consensus_does_not_matter(spark, monkeypatch):
    """Any consensus gives the same components, an empty one too."""
    draw = random.Random(12)
    base = [f"w{draw.randrange(500)}" for _ in range(60)]
    rows = []
    for k in range(200):
        words = list(base)
        for i in draw.sample(range(60), draw.choice([1, 3, 5, 7])):
            words[i] = f"x{draw.randrange(30)}"
        rows.append((k, " ".join(words)))
    docs, expected = spark.createDataFrame(rows, "doc_id long, text string"), brute(rows, 2)
    for members in (-1, 3, 256):
        monkeypatch.setattr(minhash, "CONSENSUS", members)
        assert got(minhash.near_duplicates(docs, width=2)) == expected


def test_few_files_between_the_steps(spark, monkeypatch):
    """Small tables between the steps are written as a file or two, not as one for each core, and the session's setting comes back."""
    draw = random.Random(13)
    rows = []
    for _ in range(1500):
        words = [f"w{draw.randrange(20000)}" for _ in range(150)]
        for _ in range(2):
            rows.append((len(rows), " ".join(words)))
            words[draw.randrange(150)] = "changed"
    files = Counter()

    def counted(df, name, keep=False):
        made = materialise(df, name, keep)
        files[name] += len(made.inputFiles())
        return made

    monkeypatch.setattr(minhash, "materialise", counted)
    name = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    before = spark.conf.get(name)
    found = got(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), width=2))
    assert spark.conf.get(name) == before
    assert all(c == d - d % 2 for d, (_, c) in found.items())
    assert files["sets"] == files["members"] == 1 and "links" not in files
