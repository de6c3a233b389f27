"""The displacement workflow over one stack: scatterers, linking, network, unwrapping, inversion, velocity."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fringeflow.functions.cx import angle, cx
from fringeflow.functions.scalars import displacement_factor, phase_variance
from fringeflow.operators import coherence, grid, images, interp, masks, network, phaselink, ps, smooth, timeseries
from fringeflow.plans.config import Workflow
from fringeflow.streaming.sequential import plan, run_batch

PIXEL = ["scene", "row", "col"]
PAIR = ["scene", "ref_t", "sec_t"]


class Stages:
    """Named tables under the work directory; one that is complete is read rather than made again."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def done(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def make(self, name: str, build) -> DataFrame:
        if not self.done(name):
            build().write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.spark.read.parquet(f"{self.folder}/{name}")


def scatterers(stack: DataFrame, config: Workflow) -> DataFrame:
    n = stack.agg(F.count_distinct("t")).first()[0]
    return ps.amplitude_stats(stack, PIXEL, config.ps.amp_dispersion_threshold, n)


def link_options(config: Workflow, n_dates: int) -> phaselink.LinkOptions:
    o = config.phase_linking
    return phaselink.LinkOptions(
        half_window=(o.half_window.y, o.half_window.x), strides=(config.output.strides_y, config.output.strides_x), shp_method=o.shp_method, shp_alpha=o.shp_alpha, shp_dates=n_dates,
        lag=o.baseline_lag, use_evd=o.use_evd, beta=o.beta, zero_threshold=o.zero_correlation_threshold, mask_input_ps=o.mask_input_ps,
        fill_ps=("max" if o.use_max_ps else "avg") if o.fill_ps else None, slc_amplitude=o.use_slc_amplitude, with_bound=o.write_crlb,
    )


class Linked(NamedTuple):
    """dates: scene, row, col, t, phase, temp_coh, a row for each date; pixels: scene, row, col, batch, dates, crlb, closures."""

    dates: DataFrame
    pixels: DataFrame


def linked_stack(stack: DataFrame, stats: DataFrame, config: Workflow, keep=None) -> Linked:
    """All dates linked in ministacks, one if there are few. Every batch takes the same options. keep(name, frame): writes a batch's
    compressed image and reads it again, so that a later batch doesn't compute it anew."""
    options = config.phase_linking
    days = sorted(r[0] for r in stack.select("t").distinct().collect())
    link = link_options(config, len(days))
    keep = keep or (lambda name, frame: frame)
    held: list[DataFrame] = []
    dates = pixels = None
    for batch in plan(days, options.ministack_size, 0, options.max_num_compressed, options.compressed_slc_plan, options.output_reference_idx):
        union = None
        for k, one in enumerate(held[-options.max_num_compressed :]):
            one = one.withColumn("key", F.lit(k))
            union = one if union is None else union.unionByName(one)
        found = run_batch(stack, union, batch, link, stats, lambda pixels, k=batch.index: keep(f"pixels-{k:03d}", pixels))
        if batch.real[-1] != days[-1]:
            held.append(keep(f"compressed-{batch.index:03d}", found.compressed))
        axis = F.array(*(F.lit(t) for t in [*(c[0] for c in batch.compressed), *batch.real]))
        own = found.pixels.select(*PIXEL, F.lit(batch.index).alias("batch"), axis.alias("dates"), "crlb", "closures")
        dates = found.linked if dates is None else dates.unionByName(found.linked)
        pixels = own if pixels is None else pixels.unionByName(own)
    return Linked(dates, pixels)


def linked_phases(stack: DataFrame, stats: DataFrame, config: Workflow) -> DataFrame:
    """scene, row, col, t, phase, temp_coh of all dates."""
    return linked_stack(stack, stats, config).dates


def useful(stack: DataFrame, config: Workflow, spark: SparkSession) -> DataFrame:
    """The stack's pixels inside the bounds and the mask; the others are nodata from the start."""
    if config.output.bounds:
        r0, r1, c0, c1 = config.output.bounds
        stack = stack.filter((F.col("row") >= r0) & (F.col("row") < r1) & (F.col("col") >= c0) & (F.col("col") < c1))
    if config.inputs.mask:
        stack = stack.join(spark.read.parquet(config.inputs.mask).filter("valid").select(*PIXEL), PIXEL, "left_semi")
    return stack


def stitched(images_: DataFrame, bursts: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Images of bursts as images of frames, scene the frame: each pixel at its place there; where bursts overlap, the first by number counts."""
    placed = images_.join(bursts.select("scene", "frame", "row0", "col0"), "scene")
    at = [F.col("frame").alias("scene"), *keys, (F.col("row") + F.col("row0")).cast("int").alias("row"), (F.col("col") + F.col("col0")).cast("int").alias("col")]
    moved = placed.select(*at, F.col("scene").alias("burst"), F.struct(*values).alias("v"))
    return moved.groupBy("scene", *keys, "row", "col").agg(F.min_by("v", "burst").alias("v")).select("scene", *keys, "row", "col", *(F.col(f"v.{c}").alias(c) for c in values))


def inverted(unw: DataFrame, pairs: DataFrame, method: str, weight: str | None = None, censored: bool = False) -> DataFrame:
    """scene, row, col, t, phase of each date after the first; unw: PAIR, row, col, phase, and the weight's column. A pixel without a
    phase in each of its scene's pairs is left out, unless censored. Scenes of one network are solved together."""
    if method.upper() == "L2" and weight is None and not censored:
        return timeseries.invert_l2(unw, timeseries.inverse_of(pairs), pairs.groupBy("scene").agg(F.count("*").alias("n")))
    kind = "l1" if method.upper() == "L1" else "censored" if censored else "weighted"
    networks = pairs.groupBy("scene").agg(F.sort_array(F.collect_list(F.struct("ref_t", "sec_t"))).alias("e"))
    found = None
    for row in networks.select("e").distinct().collect():
        listed = [(x["ref_t"], x["sec_t"]) for x in row["e"]]
        days = sorted({x for p in listed for x in p})[1:]
        same = networks.filter(F.col("e") == F.array(*(F.struct(F.lit(a).alias("ref_t"), F.lit(b).alias("sec_t")) for a, b in listed))).select("scene")
        one = timeseries.solve_pixels(unw.join(same, "scene", "left_semi"), listed, kind, weight)
        one = one.select(*PIXEL, F.posexplode("solution").alias("i", "phase")).select(*PIXEL, F.element_at(F.array(*(F.lit(t) for t in days)), F.col("i") + 1).alias("t"), "phase")
        found = one if found is None else found.unionByName(one)
    return found


def displacement(spark: SparkSession, config: Workflow) -> dict[str, DataFrame]:
    """Every stage's table by name, each written under the work directory."""
    stages = Stages(spark, config.work_directory)
    stack, dates = useful(spark.read.parquet(config.inputs.stack), config, spark), spark.read.parquet(config.inputs.dates)
    keep = lambda name, frame: stages.make(name, lambda: frame)
    out = {"ps": stages.make("ps", lambda: scatterers(stack, config))}
    if not (stages.done("linked") and stages.done("pixels")):
        whole = linked_stack(stack, out["ps"], config, keep)
        stages.make("linked", lambda: whole.dates)
        stages.make("pixels", lambda: whole.pixels)
    out["linked"], pixels = keep("linked", None), keep("pixels", None)
    if config.phase_linking.write_crlb:
        out["crlb"] = stages.make("crlb", lambda: pixels.selectExpr(*PIXEL, "batch", "inline(arrays_zip(dates, crlb)) AS (t, std)"))
    if config.phase_linking.write_closure_phase:
        out["closure"] = stages.make("closure", lambda: pixels.select(*PIXEL, "batch", "dates", F.posexplode("closures").alias("k", "closure")).select(*PIXEL, "batch", F.get("dates", F.col("k")).alias("t"), "closure"))
    linked = out["linked"]
    if config.inputs.bursts:
        bursts = spark.read.parquet(config.inputs.bursts)
        out["stitched"] = linked = stages.make("stitched", lambda: stitched(out["linked"], bursts, ["t"], ["phase", "temp_coh"]))
        dates = dates.join(bursts.select("scene", "frame"), "scene").select(F.col("frame").alias("scene"), "t", "dt").distinct()
    phasor = linked.select("scene", "t", "row", "col", F.cos("phase").alias("re"), F.sin("phase").alias("im"))
    out["similarity"] = stages.make("similarity", lambda: coherence.similarity(phasor, grid.disk(7)))

    net = config.network
    edges = network.network(dates, net.max_bandwidth, net.max_temporal_baseline, net.annual_buffer_days if net.include_annual else None, net.reference_idx, net.indexes)
    out["network"] = stages.make("network", lambda: edges)
    out["ifg"] = stages.make("ifg", lambda: coherence.interferograms(phasor, out["network"]))
    out["correlation"] = stages.make("correlation", lambda: smooth.correlation(out["ifg"], PAIR, (11, 11)))
    quality = stages.make("quality", lambda: linked.groupBy(*PIXEL).agg(F.avg("temp_coh").alias("quality")))
    if config.output.add_overviews:
        out["overviews"] = stages.make("overviews", lambda: grid.overviews(quality, list(config.output.overview_levels), "quality", ["scene"]))
    if not config.unwrap.run_unwrap:
        return out

    def ready() -> DataFrame:
        ifg = out["ifg"]
        if config.unwrap.run_goldstein:
            ifg = images.goldstein_images(ifg, PAIR, config.unwrap.alpha)
        if config.unwrap.run_interpolation:
            weighted = ifg.join(out["correlation"], [*PAIR, "row", "col"]).join(out["similarity"], PIXEL, "left")
            points = masks.interpolation_points(F.col("correlation"), F.coalesce("similarity", F.lit(0.0)), config.unwrap.interpolation_cor_threshold, config.unwrap.interpolation_similarity_threshold)
            ifg = interp.interpolated(weighted.withColumn("good", points.cast("double")), PAIR, "good", 0.5, max_radius=config.unwrap.max_radius)
        both = ifg.join(out["correlation"], [*PAIR, "row", "col"])
        if config.unwrap.zero_where_masked and config.inputs.mask:
            valid = grid.take_looks(spark.read.parquet(config.inputs.mask), config.output.strides_y, config.output.strides_x, {"valid": "any"}, ["scene"], edge="pad")
            both = masks.zeroed(both, stitched(valid, spark.read.parquet(config.inputs.bursts), [], ["valid"]) if config.inputs.bursts else valid, PIXEL, ["re", "im", "correlation"])
        return images.unwrapped_images(both.select(*PAIR, "row", "col", angle(cx()).alias("phase"), "correlation"), PAIR, config.unwrap.unwrap_method)

    out["unwrapped"] = stages.make("unwrapped", ready)
    if not config.timeseries.run_inversion:
        return out

    options = config.timeseries
    point = options.reference_point
    chosen = spark.createDataFrame([point], "r int, c int") if point else None
    refs = quality.select("scene").distinct().crossJoin(F.broadcast(chosen)) if chosen is not None else interp.reference_point(quality, ["scene"]).withColumnsRenamed({"row": "r", "col": "c"})
    unw = out["unwrapped"].join(out["correlation"], [*PAIR, "row", "col"], "left").select(*PAIR, "row", "col", F.col("unw").alias("phase"), F.col("conncomp").cast("int").alias("label"), "correlation")
    at = unw.join(refs, "scene").filter("row = r AND col = c").select(*PAIR, F.col("phase").alias("ref"))
    unw = unw.join(at, PAIR, "left").withColumn("phase", F.col("phase") - F.coalesce("ref", F.lit(0.0))).drop("ref")
    if options.apply_mask_to_timeseries:
        # A pixel that isn't unwrapped in each interferogram gives no series.
        inside = timeseries.component_intersection(unw).filter("inside IS NOT NULL").select(*PIXEL)
        unw = unw.join(inside, PIXEL, "left_semi")
    unw = stages.make("referenced", lambda: unw)
    factor = displacement_factor(config.inputs.wavelength)

    def series() -> DataFrame:
        rows, weight = unw, None
        if options.weighting == "correlation":
            looks = (2 * 11 + 1) ** 2
            good = F.when(F.col("correlation") >= options.correlation_threshold, 1 / (phase_variance(F.col("correlation"), looks) + 1e-6)).otherwise(F.lit(0.0))
            rows, weight = unw.withColumn("w", good), "w"
        elif options.weighting == "conncomp":
            rows = unw.withColumn("phase", F.when(F.coalesce("label", F.lit(0)) != 0, F.col("phase")))
        found = inverted(rows, out["network"], options.method, weight, options.weighting == "conncomp")
        if config.output.extra_reference_date is not None:
            found = timeseries.rereferenced_in_time(found, config.output.extra_reference_date)
        found = found.withColumn("displacement", F.col("phase") * factor)
        if config.inputs.ionosphere:
            delay = spark.read.parquet(config.inputs.ionosphere).select(*PIXEL, "t", "delay")
            first = out["network"].groupBy("scene").agg(F.min("ref_t").alias("t"))
            start = delay.join(first, ["scene", "t"]).select(*PIXEL, F.col("delay").alias("delay0"))
            found = found.join(delay, [*PIXEL, "t"], "left").join(start, PIXEL, "left").withColumn("displacement", F.col("displacement") - F.coalesce(F.col("delay") - F.col("delay0"), F.lit(0.0))).drop("delay", "delay0")
        return found

    out["timeseries"] = stages.make("timeseries", series)
    if config.output.extra_reference_date is None:
        out["residuals"] = stages.make("residuals", lambda: timeseries.residuals_per_date(timeseries.residuals(unw, out["timeseries"])))
    out["valid_counts"] = stages.make("valid_counts", lambda: timeseries.valid_counts(unw))
    if options.run_velocity:
        first = dates.groupBy("scene").agg(F.min("dt").alias("first"))
        days = dates.join(first, "scene").select("scene", "t", F.datediff("dt", "first").alias("days"))

        def rate() -> DataFrame:
            rows = out["timeseries"].join(days, ["scene", "t"])
            if options.correlation_threshold <= 0:
                return timeseries.velocity(rows, value="displacement")
            ends = unw.select(*PIXEL, F.explode(F.array("ref_t", "sec_t")).alias("t"), "correlation").groupBy(*PIXEL, "t").agg(F.avg("correlation").alias("cor"))
            weighted = rows.join(ends, [*PIXEL, "t"], "left").withColumn("w", timeseries.thresholded_weights("cor", options.correlation_threshold))
            return timeseries.velocity(weighted, value="displacement", weight="w")

        out["velocity"] = stages.make("velocity", rate)
    return out


def filtered(unwrapped: DataFrame, keys: list[str], cutoff: float, spacing: float) -> DataFrame:
    """Unwrapped images without long wavelengths."""
    return images.long_wave_images(unwrapped, keys, "phase", cutoff, spacing)


