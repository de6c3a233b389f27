"""Settings, ministacks, the stream of new dates, the workflow and the command line."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringeflow import cli
from fringeflow.operators import images
from fringeflow.plans import config, workflow
from fringeflow.sources import simulate
from fringeflow.streaming import sequential, statistics


def test_settings_round_trip(tmp_path):
    settings = config.Workflow(work_directory="w", inputs=config.InputOptions(stack="s", dates="d"))
    settings.phase_linking.half_window.y = 3
    settings.network.indexes = [(0, 1), (1, -1)]
    settings.to_yaml(tmp_path / "c.yaml")
    assert config.Workflow.from_yaml(tmp_path / "c.yaml") == settings
    with pytest.raises(ValueError, match="unknown settings"):
        config.Workflow.from_dict({"nothing": 1})
    with pytest.raises(ValueError):
        config.Workflow.from_dict({"timeseries": {"method": "L3"}})
    images.register("stars", lambda w, c: (w, c), single_reference=True)
    stars = config.Workflow.from_dict({"unwrap": {"unwrap_method": "stars"}, "network": {"max_bandwidth": 3}})
    assert stars.network == config.InterferogramNetwork(reference_idx=0)


def test_file_lists(tmp_path):
    (tmp_path / "b.tif").touch()
    (tmp_path / "a.tif").touch()
    (tmp_path / "list.txt").write_text("b.tif\n# no\ns3://x/c.tif\n/abs/d.tif\n")
    assert config.file_list(str(tmp_path / "*.tif")) == [str(tmp_path / "a.tif"), str(tmp_path / "b.tif")]
    assert config.file_list(f"@{tmp_path}/list.txt") == sorted([str(tmp_path / "b.tif"), "s3://x/c.tif", "/abs/d.tif"])
    assert config.file_list("x\ny\n") == ["x", "y"]


def test_ministack_plan():
    found = sequential.plan(list(range(10)), 4)
    assert [m.real for m in found] == [(0, 1, 2, 3), (4, 5, 6, 7), (8, 9)]
    assert found[1].compressed == ((0, 0, 3),) and found[2].compressed == ((0, 0, 3), (0, 4, 7))
    assert found[2].output_reference == 1
    assert len(sequential.plan(list(range(30)), 3, most_compressed=2)[-1].compressed) == 2
    assert sequential.plan(list(range(4)), 4, scheme="last_per_ministack")[0].produces == (3, 0, 3)
    assert sequential.plan(list(range(6)), 3, scheme="first_per_ministack")[1].produces == (3, 3, 5)
    for bad in ({"scheme": "x"}, {"scheme": "last_per_ministack"}, {"size": 1}):
        with pytest.raises(ValueError):
            sequential.plan(list(range(10)), **({"size": 4} | bad))
    with pytest.raises(ValueError):
        sequential.check_new([0, 5], [(0, 0, 3)])


@pytest.fixture(scope="module")
def stack(spark):
    phases = np.array([0, 0.3, -0.5, 0.8, 1.1, -0.2])
    c = simulate.coherence_matrix(6, 12.0, 0.99, 0.9, 72.0, phases)
    return simulate.stack(spark, (12, 12), c, seed=5).persist(), phases


def test_sequential_stream(spark, stack, tmp_path):
    rows, phases = stack
    estimator = sequential.SequentialEstimator(spark, f"file://{tmp_path}/out", (2, 2))
    for days in ([0, 1, 2], [3, 4, 5]):
        rows.filter(F.col("t").isin(days)).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        estimator.start(spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in"), f"file://{tmp_path}/state").awaitTermination()
    assert estimator.keys() == [(0, 0, 2), (0, 3, 5)]
    linked = estimator.linked().filter("row BETWEEN 3 AND 8 AND col BETWEEN 3 AND 8").collect()
    assert len(linked) == 36 * 6
    for t in range(6):
        mean = np.angle(np.mean([np.exp(1j * r["phase"]) for r in linked if r["t"] == t]))
        assert abs(np.angle(np.exp(1j * (mean - phases[t])))) < 0.25
    estimator.process(rows.filter("t < 0"), 1)  # finished: not done again
    assert estimator.keys() == [(0, 0, 2), (0, 3, 5)]


def test_workflow(spark, stack, tmp_path):
    rows, _ = stack
    rows.write.parquet(f"file://{tmp_path}/stack")
    spark.createDataFrame([(0, t, f"2022-0{t + 1}-01") for t in range(6)], "scene int, t int, dt string").withColumn("dt", F.to_date("dt")).write.parquet(f"file://{tmp_path}/dates")
    args = ["config", "--stack", f"file://{tmp_path}/stack", "--dates", f"file://{tmp_path}/dates", "--work-directory", f"file://{tmp_path}/work", "--out", f"{tmp_path}/c.yaml"]
    assert cli.main(args) == 0
    settings = config.Workflow.from_yaml(f"{tmp_path}/c.yaml")
    settings.phase_linking.half_window = config.HalfWindow(2, 2)
    settings.phase_linking.shp_method = "rect"
    settings.inputs.wavelength = 0.055
    settings.to_yaml(f"{tmp_path}/c.yaml")
    assert cli.main(["run", f"{tmp_path}/c.yaml"]) == 0
    read = lambda name: spark.read.parquet(f"file://{tmp_path}/work/{name}")
    assert read("network").count() == 12
    assert read("timeseries").count() == 144 * 5
    assert read("velocity").filter("velocity IS NOT NULL").count() == 144
    assert read("linked").agg(F.min("temp_coh")).first()[0] > 0.5
    read("unwrapped").select("scene", "ref_t", "sec_t", "row", "col", F.col("unw").alias("phase")).write.parquet(f"file://{tmp_path}/unw")
    assert cli.main(["timeseries", f"file://{tmp_path}/unw", f"file://{tmp_path}/ts"]) == 0
    assert spark.read.parquet(f"file://{tmp_path}/ts").count() == 144 * 5
    out = workflow.displacement(spark, settings)
    assert set(out) >= {"ps", "linked", "similarity", "ifg", "correlation", "unwrapped", "timeseries", "velocity"}


def test_workflow_ministacks(spark, stack):
    rows, phases = stack
    settings = config.Workflow()
    settings.phase_linking.ministack_size = 3
    settings.phase_linking.half_window = config.HalfWindow(2, 2)
    linked = workflow.linked_phases(rows, workflow.scatterers(rows, settings), settings)
    assert linked.select("t").distinct().count() == 6


def options(**changes):
    settings = config.Workflow()
    settings.phase_linking.half_window = config.HalfWindow(2, 2)
    settings.phase_linking.shp_method = "rect"
    settings.phase_linking.fill_ps = False
    for name, value in changes.items():
        setattr(settings.phase_linking, name, value)
    return settings


def phases_of(frame):
    return {(r["row"], r["col"], r["t"]): (r["phase"], r["temp_coh"]) for r in frame.collect()}


@pytest.fixture(scope="module")
def plain_phases(stack):
    """Of a ministack size: statistics with some scatterers, and the phases without any option."""
    rows, _ = stack
    stats = workflow.scatterers(rows, options()).withColumn("ps", (F.col("row") == 5) & (F.col("col") % 3 == 0)).persist()
    known = {}

    def of(size):
        if size not in known:
            known[size] = phases_of(workflow.linked_phases(rows, stats, options(ministack_size=size)))
        return stats, known[size]

    return of


@pytest.mark.parametrize("size", [15, 3])
@pytest.mark.parametrize(
    "change",
    [{"shp_method": "glrt", "shp_alpha": 0.3}, {"shp_method": "ks", "shp_alpha": 0.2}, {"use_evd": True}, {"beta": 0.3}, {"zero_correlation_threshold": 0.95}, {"baseline_lag": 2}, {"fill_ps": True}, {"mask_input_ps": True}],
    ids=lambda c: next(iter(c)),
)
def test_options_in_every_path(spark, stack, plain_phases, change, size):
    """Each option changes what is linked, in one batch and in several."""
    rows, _ = stack
    stats, a = plain_phases(size)
    b = phases_of(workflow.linked_phases(rows, stats, options(ministack_size=size, **change)))
    assert len(a) == 144 * 6 and set(a) == set(b)
    assert max(abs(a[k][1] - b[k][1]) for k in a) > 1e-6
    if change == {"fill_ps": True}:
        own = {(r["row"], r["col"], r["t"]): complex(r["re"], r["im"]) for r in rows.collect()}
        for c in range(0, 12, 3):
            assert all(b[5, c, t][1] == 1.0 for t in range(6))
            at = lambda t: np.angle(own[5, c, t] * np.conj(own[5, c, 0]))  # noqa: B023, E731
            assert all(abs(np.angle(np.exp(1j * (b[5, c, t][0] - at(t))))) < 1e-9 for t in range(3))


def test_one_batch_is_one_batch(spark, stack):
    """The workflow, run_batch and the stream's estimator link a single batch alike."""
    rows, _ = stack
    settings = options(shp_method="glrt", shp_alpha=0.05, use_evd=True, beta=0.1, baseline_lag=4, fill_ps=True)
    stats = workflow.scatterers(rows, settings)
    a = phases_of(workflow.linked_phases(rows, stats, settings))
    b = phases_of(sequential.run_batch(rows, None, sequential.plan(list(range(6)), 6)[0], workflow.link_options(settings, 6), stats).linked)
    assert set(a) == set(b) and max(abs(a[k][0] - b[k][0]) for k in a) < 1e-9


def test_strides_keep_similar_pixels(spark, stack):
    rows, _ = stack
    stats = workflow.scatterers(rows, options())
    plain, similar = (phases_of(workflow.linked_phases(rows, stats, s)) for s in (options(), options(shp_method="glrt", shp_alpha=0.5)))
    for settings in (one := options(), two := options(shp_method="glrt", shp_alpha=0.5)):
        settings.output.strides_y, settings.output.strides_x = 3, 2
    coarse, coarse_similar = (phases_of(workflow.linked_phases(rows, stats, s)) for s in (one, two))
    assert len(coarse) == len(coarse_similar) == 4 * 6 * 6
    for fine, few in ((plain, coarse), (similar, coarse_similar)):
        assert all(abs(np.angle(np.exp(1j * (few[r, c, t][0] - fine[3 * r + 1, 2 * c + 1, t][0])))) < 1e-9 for r in range(4) for c in range(6) for t in range(6))
    assert any(abs(coarse[k][1] - coarse_similar[k][1]) > 1e-6 for k in coarse)


def test_late_dates_and_policies(spark, stack, tmp_path):
    """Dates that were linked before are set aside, the new ones of the same trigger linked; reference policies; an extra reference."""
    rows, _ = stack
    part = lambda *days: rows.filter(F.col("t").isin(list(days)))
    estimator = sequential.SequentialEstimator(spark, f"file://{tmp_path}/late", (1, 1))
    estimator.process(part(0, 1, 2), 0)
    estimator.process(part(0, 2), 3)  # nothing new
    estimator.process(part(2, 3, 4, 5), 4)
    assert estimator.finished() == [0, 4] and estimator.keys() == [(0, 0, 2), (0, 3, 5)]
    assert sorted(r["t"] for r in estimator.rejected().select("t").distinct().collect()) == [0, 2]
    assert estimator.linked().groupBy("row", "col", "t").count().agg(F.max("count")).first()[0] == 1
    first = sequential.SequentialEstimator(spark, f"file://{tmp_path}/first", (1, 1), scheme="first_per_ministack", extra_reference=4)
    first.process(part(0, 1, 2), 0)
    first.process(part(3, 4, 5), 1)
    assert first.keys() == [(0, 0, 2), (3, 3, 5)]
    assert all(abs(r["phase"]) < 4 for r in first.linked().filter("t = 5").collect())
    raw = phases_of(spark.read.parquet(f"file://{tmp_path}/first/linked/*"))
    turned = phases_of(first.linked())
    assert all(abs(np.angle(np.exp(1j * (turned[r, c, 5][0] - raw[r, c, 5][0] + raw[r, c, 4][0])))) < 1e-9 for r, c, t in raw if t == 5)
    last = sequential.SequentialEstimator(spark, f"file://{tmp_path}/last", (1, 1), scheme="last_per_ministack")
    last.process(part(0, 1, 2), 0)
    with pytest.raises(ValueError, match="single"):
        last.process(part(3, 4), 1)
    with pytest.raises(ValueError, match="scheme"):
        sequential.SequentialEstimator(spark, f"file://{tmp_path}/x", (1, 1), scheme="x")


def test_every_setting_works(spark, stack, tmp_path):
    """A run with masks, bounds, bursts, weights, an extra reference and all outputs; each of these leaves its mark."""
    rows, _ = stack
    at = lambda name: f"file://{tmp_path}/{name}"
    other = rows.withColumn("scene", F.lit(1))
    rows.unionByName(other).write.parquet(at("stack"))
    spark.createDataFrame([(s, t, f"2022-0{t + 1}-01") for s in (0, 1) for t in range(6)], "scene int, t int, dt string").withColumn("dt", F.to_date("dt")).write.parquet(at("dates"))
    spark.createDataFrame([(s, r, c, not (r == 6 and c < 6)) for s in (0, 1) for r in range(12) for c in range(12)], "scene int, row int, col int, valid boolean").write.parquet(at("mask"))
    spark.createDataFrame([(0, 7, 0, 0), (1, 7, 0, 10)], "scene int, frame int, row0 int, col0 int").write.parquet(at("bursts"))
    spark.createDataFrame([(7, r, c, t, 0.001 * t) for r in range(12) for c in range(22) for t in range(6)], "scene int, row int, col int, t int, delay double").write.parquet(at("delay"))
    settings = options(write_closure_phase=True, fill_ps=True)
    settings.work_directory = at("work")
    settings.inputs = config.InputOptions(stack=at("stack"), dates=at("dates"), wavelength=0.055, mask=at("mask"), bursts=at("bursts"), ionosphere=at("delay"))
    settings.output.bounds, settings.output.overview_levels = (0, 11, 0, 12), (2, 4)
    settings.unwrap.zero_where_masked = settings.unwrap.run_goldstein = settings.unwrap.run_interpolation = True
    settings.timeseries.method, settings.timeseries.weighting = "L2", "correlation"
    found = workflow.displacement(spark, settings)
    linked = found["linked"].collect()
    assert {r["row"] for r in linked} == set(range(11)) and not any(r["row"] == 6 and r["col"] < 6 for r in linked)
    assert {r["scene"] for r in found["stitched"].select("scene").distinct().collect()} == {7}
    assert found["stitched"].agg(F.max("col")).first()[0] == 21
    assert found["crlb"].filter("std > 0").count() > 0 and found["closure"].select("t").distinct().count() == 4
    assert found["overviews"].select("level").distinct().count() == 2
    assert found["residuals"].count() > 0 and found["valid_counts"].filter("n > 0").count() > 0
    assert found["velocity"].filter("velocity IS NOT NULL").count() > 0
    series = found["timeseries"].filter("t = 5").collect()
    factor = -0.055 / (4 * np.pi)
    assert all(abs(r["displacement"] - (r["phase"] * factor - 0.005)) < 1e-9 for r in series)
    settings.work_directory, settings.output.extra_reference_date, settings.timeseries.weighting = at("work2"), 3, "conncomp"
    again = workflow.displacement(spark, settings)
    plain = {(r["row"], r["col"], r["t"]): r["phase"] for r in workflow.inverted(spark.read.parquet(at("work2") + "/referenced").withColumn("phase", F.when(F.col("label") != 0, F.col("phase"))), again["network"], "L2", None, True).collect()}
    for r in again["timeseries"].collect():
        k = (r["row"], r["col"])
        expected = plain[(*k, r["t"])] - (plain[(*k, 3)] if r["t"] > 3 else 0)
        assert abs(r["phase"] - expected) < 1e-6


def test_sessions_and_windows(spark):
    rows = [(1, "2024-01-01 00:00:00", 1.0), (1, "2024-01-01 00:10:00", 2.0), (1, "2024-01-01 05:00:00", 3.0)]
    events = spark.createDataFrame(rows, "user int, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r["n"] for r in statistics.sessions(events, ["user"], "1 hour").collect()) == [1, 2]
    assert sorted(r["total"] for r in statistics.tumbling(events, ["user"], "1 hour", "value", late="1 day").collect()) == [3.0, 3.0]


def test_other_commands(spark, tmp_path):
    r, c = np.indices((24, 20))
    wave = 0.3 * r + 0.1 * c
    rows = [(0, 0, 1, int(a), int(b), float(np.angle(np.exp(1j * wave[a, b]))), 0.9) for a, b in zip(r.ravel(), c.ravel(), strict=True)]
    spark.createDataFrame(rows, "scene int, ref_t int, sec_t int, row int, col int, phase double, correlation double").write.parquet(f"file://{tmp_path}/wrapped")
    assert cli.main(["unwrap", f"file://{tmp_path}/wrapped", f"file://{tmp_path}/unw"]) == 0
    found = {(x["row"], x["col"]): x["unw"] for x in spark.read.parquet(f"file://{tmp_path}/unw").collect()}
    offset = found[(0, 0)] - wave[0, 0]
    assert all(abs(v - wave[k] - offset) < 1e-6 for k, v in found.items())

    images_ = [(0, 0, int(a), int(b), float(5 + np.cos(2 * np.pi * b / 4))) for a, b in zip(r.ravel(), c.ravel(), strict=True)]
    spark.createDataFrame(images_, "scene int, t int, row int, col int, phase double").write.parquet(f"file://{tmp_path}/image")
    assert cli.main(["filter", f"file://{tmp_path}/image", f"file://{tmp_path}/filtered", "--cutoff", "300", "--spacing", "30"]) == 0
    assert abs(spark.read.parquet(f"file://{tmp_path}/filtered").agg(F.avg("phase")).first()[0]) < 1e-6

    spark.createDataFrame([(0, int(a), int(b), float(a * 100 + b)) for a, b in zip(r.ravel(), c.ravel(), strict=True)], "scene int, row int, col int, value double").write.parquet(f"file://{tmp_path}/values")
    spark.createDataFrame([(int(a), int(b), float(10 + 0.5 * b + 0.25), float(50 + 0.5 * a + 0.25)) for a, b in zip(r.ravel(), c.ravel(), strict=True)], "row int, col int, lon double, lat double").write.parquet(f"file://{tmp_path}/places")
    assert cli.main(["geocode", f"file://{tmp_path}/values", f"file://{tmp_path}/map", "--locations", f"file://{tmp_path}/places", "--origin", "10", "50", "--pixel", "0.5", "0.5"]) == 0
    assert all(x["value"] == x["row"] * 100 + x["col"] for x in spark.read.parquet(f"file://{tmp_path}/map").collect())
    with pytest.raises(SystemExit):
        cli.main(["nothing"])
