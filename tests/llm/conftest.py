import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, body string, words long, rows long, target double, last int, key string"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    draw = random.Random(7)
    vocabulary = [*(["the", "of", "and", "to", "a"] * 16), *("".join(draw.choice("abcdefghij") for _ in range(6)) for _ in range(400))]
    prose = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    long = prose(30_000)
    texts = [None, "", " ", "\n\n", "word", long, "x" * 200_000, prose(60), prose(60), prose(80) + "\n" + prose(40), "é à ü\t" * 30, "\u4e2d\u6587 " * 40, "1" * 5000, "@" * 3000, "+1 " * 500]
    rows = [(i, t, "en", f"src{i % 3}", len(t or ""), 1, "b", 2, 3, 4.0, 5, "k") for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (100, texts[7], None, None, None, None, None, None, None, None, None, None), (None, texts[8], "en", "src1", 1, 1, "b", 2, 3, 4.0, 5, "k"), (None, None, None, None, None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(duck):
    return duck.execute("SELECT doc_id, text, source FROM documents ORDER BY doc_id").fetchall()
