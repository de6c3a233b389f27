"""Every query with an oracle agrees with DuckDB; every other one runs."""

import datetime
import uuid

import pytest

import __spark_entry__ as entry
from fringeflow.plans import catalog, scans
from tests.conftest import canonical

QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, tables, duck, name):
    assert canonical(QUERIES[name](spark, tables).toPandas()) == canonical(duck.execute(ORACLE[name]).fetchdf())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, tables, name):
    frame = QUERIES[name](spark, tables)
    assert frame.count() > 0 and len(set(frame.columns)) == len(frame.columns)


def test_entry(spark, tables, monkeypatch):
    monkeypatch.setattr(entry, "FLAGSHIP_DIR", tables)
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, tables):
    """No nested loops over pixels; scans read what is used; constant matrices and looks need one exchange each."""
    for name in ("j9_window_join", "j10_disk_join", "a8_coherence", "k1_glrt", "a17_similarity_median", "f10_grow_nodata", "x4_interpolate"):
        assert "NestedLoop" not in plan(QUERIES[name](spark, tables)) and "Cartesian" not in plan(QUERIES[name](spark, tables)), name
    scan = plan(QUERIES["a7_ps_looked"](spark, tables))
    assert "l_comment" not in scan and scan.count("ReadSchema") == 1
    assert "PushedFilters: [IsNotNull" in plan(spark.read.parquet(f"{tables}/lineitem.parquet").filter("l_quantity > 10"))


@pytest.mark.parametrize("name", ["j10_disk_join", "j11_nearest_in_spiral", "x4_interpolate"])
def test_windows_are_not_shuffled(spark, tables, name):
    """Windows are looked up inside tiles: their places aren't rows of an exchange, and the nearest few need no ranking."""
    found = plan(QUERIES[name](spark, tables))
    assert "MapInArrow" in found and "dr" not in "".join(x for x in found.splitlines() if "Exchange" in x)
    assert name == "x4_interpolate" or "Window [" not in found


@pytest.mark.parametrize("name", ["a8_coherence", "k8_nearest_eigenpair"])
def test_tiles_are_many_in_a_call(spark, tables, name):
    """Coherence takes the tiles of an Arrow batch at once, not each in a call of its own."""
    found = plan(QUERIES[name](spark, tables))
    assert "MapInArrow" in found and "FlatMapGroups" not in found


@pytest.fixture(params=["file", "plain", "viewfs"])
def folder(request, spark, tmp_path, monkeypatch):
    """The shared folder as a file: path, as a path without a scheme, and on a file system that Python can't open."""
    shared = tmp_path / "shared"
    shared.mkdir()
    store = uuid.uuid4().hex
    spark.sparkContext._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.{store}.link./shared", f"file://{shared}")
    path = {"file": f"file://{shared}", "plain": f"{shared}/deeper", "viewfs": f"viewfs://{store}/shared"}[request.param]
    monkeypatch.setattr(scans, "shared_dir", lambda _: path)
    return path


@pytest.fixture
def few_lines(spark, tmp_path):
    """Lines on a few cells only: several on one, sums of -1 and 0, and cells whose quantities are all null."""
    lines = [(1, 1, 5.0), (1, 1, 2.5), (17, 11, 1.0), (5, 3, -1.0), (5, 4, 0.0), (6, 5, None), (20, 6, 3.25), (15, 9, 7.0), (0, 0, 2.0), (2, 2, None)]
    spark.createDataFrame(lines, "l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"file://{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def agrees(spark, name: str, sf_dir: str, files: str = "lineitem.parquet") -> bool:
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{sf_dir}/{files}'")
    return canonical(QUERIES[name](spark, sf_dir).toPandas()) == canonical(connection.execute(ORACLE[name]).fetchdf())


def test_flat_file_in_any_folder(spark, folder, tables, few_lines):
    assert agrees(spark, "s4_flat_file", tables)
    assert agrees(spark, "s4_flat_file", few_lines, "lineitem.parquet/*.parquet")


def test_stack_readers_in_any_folder(spark, folder, tables, few_lines):
    assert agrees(spark, "s7_stack_readers", tables)
    assert agrees(spark, "s7_stack_readers", few_lines, "lineitem.parquet/*.parquet")


def test_write_window_in_any_folder(spark, folder, tables, few_lines):
    assert agrees(spark, "s11_write_window", tables)
    assert agrees(spark, "s11_write_window", few_lines, "lineitem.parquet/*.parquet")


#: Queries whose thresholds or ties lie on whole amplitudes.
WHOLE = ["a11_average_nonzero", "a12_conncomp_intersection", "a13_valid_counts", "a21_velocity_masked", "f7_combined_mask", "k2_ks", "k2_ks_distance", "p20_argmax", "u1_mosaic", "j12_nearest_lookup", "u2_merge_by_date", "u3_fill_nodata", "u6_stitched_products"]


@pytest.fixture(scope="module")
def lone_lines(spark, tmp_path_factory):
    """Cells with one line each, whose cosine and sine differ between the JVM and the C library in the last bit: the amplitude is the
    line's quantity, or next to it."""
    prices = [963.51, 914.47, 933.46, 942.39, 955.99, 965.63, 985.53, 987.12, 988.1, 1028.9, 1033.46, 1055.99]
    sizes = [10, 12, 15, 20, 24, 30, 70, 90]
    lines = []
    for n in range(8 * 1120):
        scene, t, row, col = n // 1120, n % 7, n // 7 % 16, n // 112 % 10
        lines.append((scene * 1120, row, col, float(sizes[n * 5 // 7 % 8]), prices[n // 3 % 12], datetime.datetime(1995 + t, 6, 1)))
    folder = tmp_path_factory.mktemp("lone")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_shipdate timestamp_ntz").write.parquet(f"file://{folder}/lineitem.parquet")
    return str(folder)


@pytest.mark.parametrize("name", WHOLE)
def test_whole_amplitudes(spark, lone_lines, name):
    assert agrees(spark, name, lone_lines, "lineitem.parquet/*.parquet")


def test_ionex_of_many_customers(spark, tmp_path):
    """Counts of five digits fill the format's columns, one equals its missing value, and one is too large for them."""
    duckdb = pytest.importorskip("duckdb")
    counts = {0: 12_000, 1: 9_999, 2: 10_500, 6: 100_001, 8: 3}
    rows = spark.sql(f"SELECT explode(array_repeat(c_nationkey, n)) AS c_nationkey, 'A' AS c_mktsegment FROM VALUES {', '.join(map(str, counts.items()))} AS v(c_nationkey, n)")
    rows.write.parquet(f"file://{tmp_path}/customer.parquet")
    spark.createDataFrame([(k, k // 10) for k in counts], "n_nationkey int, n_regionkey int").write.parquet(f"file://{tmp_path}/nation.parquet")
    connection = duckdb.connect()
    for name in ("customer", "nation"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert canonical(QUERIES["s20_ionex"](spark, str(tmp_path)).toPandas()) == canonical(connection.execute(ORACLE["s20_ionex"]).fetchdf())
