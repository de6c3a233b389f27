import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TESTDATA = os.environ.get("TESTDATA_DIR", "/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from fringeflow.session import get_session

    shared = tmp_path_factory.mktemp("shared")
    session = get_session("local[4]", 8, **{"spark.checkpoint.dir": f"file://{shared}", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables():
    """The smallest given tables."""
    path = f"{TESTDATA}/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("the given tables aren't here")
    return path


@pytest.fixture(scope="session")
def duck(tables):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tables}/{name}.parquet'")
    return connection


def canonical(frame) -> list[tuple]:
    """Rows as sorted tuples of texts, columns by name."""

    def text(x):
        if x is None or x != x:
            return ""
        return repr(round(float(x), 9)) if isinstance(x, float) else str(x)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(text(v) for v in row) for row in frame.itertuples(index=False))
