"""Filling pixels from their neighbours, and connected components with what is chosen from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fringeflow.functions.cx import angle, cx, magnitude
from fringeflow.operators.graph import connected
from fringeflow.operators.grid import disk, neighbours, rectangle
from fringeflow.tables import materialise, scratch


def nearest_k(centres: DataFrame, points: DataFrame, keys: list[str], values: list[str], k: int, max_radius: int, min_radius: int = 0) -> DataFrame:
    """For each centre the first k points of a spiral around it: rank, dr, dc and values_n."""
    return neighbours(centres, points, disk(max_radius, min_radius, spiral=True), keys, values, most=k)


def interpolated(ifg: DataFrame, keys: list[str], weight: str, cutoff: float, k: int = 20, max_radius: int = 51, min_radius: int = 0, alpha: float = 0.75) -> DataFrame:
    """keys, row, col, re, im: pixels below the cutoff take the phase of their k nearest good ones, weighted by a Gaussian whose width follows the farthest; the amplitude stays. Without a good neighbour the phase is 0; a zero pixel stays 0."""
    good = ifgs_good(ifg, weight, cutoff)
    need = ifg.filter((F.col(weight) < cutoff) & ((F.col("re") != 0) | (F.col("im") != 0)))
    points = good.select(*keys, "row", "col", F.atan2("im", "re").alias("p"))
    near = nearest_k(need.select(*keys, "row", "col"), points, keys, ["p"], k, max_radius, min_radius)
    r2 = (F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc")).cast("double")
    far = near.withColumn("r2", r2).withColumn("norm", F.pow(F.last("r2").over(Window.partitionBy(*keys, "row", "col").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(alpha)) / 2)
    w = F.exp(-F.col("r2") / F.col("norm"))
    sums = far.groupBy(*keys, "row", "col").agg(F.sum(w * F.cos("p_n")).alias("nre"), F.sum(w * F.sin("p_n")).alias("nim"))
    out = ifg.join(sums, [*keys, "row", "col"], "left")
    size, phase = magnitude(cx()), F.coalesce(angle(cx("n")), F.lit(0.0))
    keep = (F.col(weight) >= cutoff) | ((F.col("re") == 0) & (F.col("im") == 0))
    return out.select(*keys, "row", "col", F.when(keep, F.col("re")).otherwise(size * F.cos(phase)).alias("re"), F.when(keep, F.col("im")).otherwise(size * F.sin(phase)).alias("im"))


def ifgs_good(ifg: DataFrame, weight: str, cutoff: float) -> DataFrame:
    return ifg.filter((F.col(weight) >= cutoff) & ((F.col("re") != 0) | (F.col("im") != 0)))


def _outline(points: DataFrame, keys: list[str]) -> DataFrame:
    """The points with a free pixel beside them: from anywhere else, the nearest points are among these, all ties included."""
    at = [*keys, "row", "col"]
    closed = neighbours(points.select(*at), points, [(-1, 0), (0, -1), (0, 1), (1, 0)], keys, []).groupBy(*at).agg(F.count("*").alias("__n")).filter("__n = 4")
    return points.join(closed.select(*at), at, "left_anti")


#: The farthest look that goes through each place of a tile in order of distance.
NEAR = 32


def _nearest_within(gaps: DataFrame, points: DataFrame, keys: list[str], value: str, bucket: int, rings: int) -> DataFrame:
    """The nearest point of each gap that has one rings * bucket pixels away or nearer: up to NEAR the first in a tile's lookup. Beyond,
    points are dealt to square buckets, and a gap looks into its own and the surrounding rings of them."""
    far = rings * bucket
    if far <= NEAR:
        around = sorted(((r, c) for r, c in rectangle(far, far) if r * r + c * c <= far * far), key=lambda o: (o[0] ** 2 + o[1] ** 2, o))
        first = neighbours(gaps.select(*keys, "row", "col"), points, around, keys, [value], most=1)
        return first.select(*keys, "row", "col", F.col(f"{value}_n").alias(value))
    at = [F.floor(F.col("row") / bucket).cast("int").alias("br"), F.floor(F.col("col") / bucket).cast("int").alias("bc")]
    around = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in rectangle(rings, rings))))
    asks = gaps.select(*keys, "row", "col", *at).withColumn("o", around).select(*keys, "row", "col", (F.col("br") + F.col("o.a")).alias("br"), (F.col("bc") + F.col("o.b")).alias("bc"))
    has = points.select(*keys, F.col("row").alias("r"), F.col("col").alias("c"), F.col(value).alias("v"), *at)
    both = asks.join(has, [*keys, "br", "bc"])
    distance = (F.col("row") - F.col("r")) ** 2 + (F.col("col") - F.col("c")) ** 2
    near = both.filter(distance <= far * far)
    # One number for distance, row and column: a struct would have all pairs sorted before they are summed up.
    size = F.lit(2 * far + 1).cast("long")
    order = (distance.cast("long") * size + (F.col("r") - F.col("row") + far)) * size + (F.col("c") - F.col("col") + far)
    order = order if far <= 30_000 else F.struct(distance, "r", "c")
    return near.groupBy(*keys, "row", "col").agg(F.min_by("v", order).alias(value))


def nearest_value(gaps: DataFrame, points: DataFrame, keys: list[str], value: str, bucket: int = 8, rings: int = 2, reach: int | None = None) -> DataFrame:
    """keys, row, col, value of the nearest point, however far; among equals the first in row-major order. A gap without
    any point of its keys isn't returned. With reach, gaps that are farther from every point needn't be.

    Gaps look rings * bucket pixels far, and those that find nothing twice as far in the next round; the rounds grow
    with the logarithm of the widest gap. In looks beyond NEAR only the outline of the points takes part."""
    points = outline = materialise(points.select(*keys, "row", "col", value), "points", keep=True)
    left = gaps.select(*keys, "row", "col").join(points.select(*keys).distinct(), keys, "left_semi")
    found = None
    while True:
        if rings * bucket > NEAR and outline is points:
            outline = materialise(_outline(points, keys), "outline", keep=True)
        near = materialise(_nearest_within(left, outline, keys, value, bucket, rings), "nearest", keep=True)
        found = near if found is None else found.unionByName(near)
        left = materialise(left.join(near, [*keys, "row", "col"], "left_anti"), "gaps", keep=True)
        if left.isEmpty() or (reach is not None and rings * bucket >= reach):
            return found
        bucket *= 2


def filled_ambiguities(unw: DataFrame, keys: list[str], unwrapped: str = "unw", wrapped: str = "phase", reach: int = 16) -> DataFrame:
    """unw where it exists; else the wrapped phase plus the nearest unwrapped pixel's whole cycles, however far it is (reach: of
    the first look). Null where an image has no unwrapped pixel or the wrapped phase is null."""
    import math

    cycles = F.rint((F.col(unwrapped) - F.col(wrapped)) / F.lit(2 * math.pi))
    points = unw.filter(F.col(unwrapped).isNotNull()).select(*keys, "row", "col", cycles.alias("n"))
    gaps = unw.filter(F.col(unwrapped).isNull() & F.col(wrapped).isNotNull())
    found = nearest_value(gaps, points, keys, "n", bucket=max(1, reach // 2))
    out = unw.join(found, [*keys, "row", "col"], "left")
    return out.select(*keys, "row", "col", F.coalesce(F.col(unwrapped), F.col(wrapped) + F.lit(2 * math.pi) * F.col("n")).alias(unwrapped))


def components(mask: DataFrame, keys: list[str], connectivity: int = 8) -> DataFrame:
    """keys, row, col, label of the pixels of mask (rows with a true `inside`): labels 1, 2, ... by each component's first pixel in row-major order.

    Pixels that follow each other in a row form a run; runs that touch the next row's are edges, which are contracted
    until none is left, in rounds that grow with the logarithm of the runs, however long and winding a component is."""
    in_row = Window.partitionBy(*keys, "row").orderBy("col")
    points = mask.filter("inside").select(*keys, "row", "col").distinct()
    runs = points.withColumn("__run", F.col("col") - F.row_number().over(in_row))
    runs = runs.withColumn("__start", F.min("col").over(Window.partitionBy(*keys, "row", "__run")))
    vertex = F.struct(*keys, "row", F.col("__start").alias("col"))
    placed = materialise(runs.select(*keys, "row", "col", vertex.alias("__v")), "runs", keep=True)
    below = placed.select(*keys, (F.col("row") - 1).alias("row"), "col", F.col("__v").alias("b"))
    reach = [-1, 0, 1] if connectivity == 8 else [0]
    touching = placed.withColumn("col", F.explode(F.array(*(F.col("col") + d for d in reach)))).withColumnRenamed("__v", "a").join(below, [*keys, "row", "col"]).select("a", "b").distinct()
    with scratch(mask.sparkSession):
        roots = connected(touching)
        merged = placed.select("__v").distinct()
        if roots is None:
            merged = merged.withColumn("__root", F.col("__v"))
        else:
            merged = merged.join(roots.select(F.col("v").alias("__v"), F.col("root").alias("__root")), "__v", "left").withColumn("__root", F.coalesce("__root", "__v"))
        merged = materialise(merged, "roots", keep=True)
    first = merged.groupBy("__root").agg(F.min("__v").alias("__first"))
    numbered = first.select("__root", F.row_number().over(Window.partitionBy(*(F.col(f"__first.{k}") for k in keys)).orderBy("__first")).alias("label"))
    return placed.join(merged, "__v").join(numbered, "__root").select(*keys, "row", "col", "label")


def components_of_mask(mask: DataFrame, keys: list[str], size: int = 25, connectivity: int = 4) -> DataFrame:
    """keys, row, col, label of the true pixels of `inside` after a dilation by a box of size x size: parts that the
    dilation joins share a label. The box is two passes over rows and columns; only pixels of the mask are returned."""
    half = size // 2
    points = mask.filter("inside").select(*keys, "row", "col")
    along = lambda df, axis: df.withColumn(axis, F.explode(F.sequence(F.col(axis) - half, F.col(axis) + (size - 1 - half)))).distinct()
    grown = along(along(points, "row"), "col").withColumn("inside", F.lit(True))
    return components(grown, keys, connectivity).join(points, [*keys, "row", "col"], "left_semi")


def largest_component(labels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, label, n: the largest component, the least label among equals."""
    n = labels.groupBy(*keys, "label").agg(F.count("*").alias("n"))
    return n.groupBy(*keys).agg(F.max_by(F.struct("label", "n"), F.struct("n", -F.col("label"))).alias("x")).select(*keys, "x.label", "x.n")


def reference_point(quality: DataFrame, keys: list[str], threshold: float = 0.95, inside: DataFrame | None = None) -> DataFrame:
    """keys, row, col: of the pixels above the threshold (and inside the mask's largest component), the largest 8-connected
    region's pixel nearest its centroid, first in row-major order; without such pixels the one of the best quality."""
    good = quality.withColumn("inside", F.col("quality") > threshold)
    if inside is not None:
        labelled = components(inside, keys)
        big = labelled.join(largest_component(labelled, keys), [*keys, "label"]).select(*keys, "row", "col")
        good = good.join(big.withColumn("__in", F.lit(True)), [*keys, "row", "col"], "left").withColumn("inside", F.col("inside") & F.coalesce("__in", F.lit(False))).drop("__in")
    labels = components(good.select(*keys, "row", "col", "inside"), keys)
    region = labels.join(largest_component(labels, keys).drop("n"), [*keys, "label"])
    middle = region.groupBy(*keys).agg(F.avg("row").alias("mr"), F.avg("col").alias("mc"))
    distance = (F.col("row") - F.col("mr")) ** 2 + (F.col("col") - F.col("mc")) ** 2
    chosen = region.join(middle, keys).groupBy(*keys).agg(F.min(F.struct(distance.alias("d"), "row", "col")).alias("p")).select(*keys, F.col("p.row").alias("row"), F.col("p.col").alias("col"))
    best = quality.groupBy(*keys).agg(F.max_by(F.struct("row", "col"), F.struct("quality", -F.col("row"), -F.col("col"))).alias("b"))
    return best.join(chosen, keys, "left").select(*keys, F.coalesce("row", "b.row").alias("row"), F.coalesce("col", "b.col").alias("col"))


def extreme_index(pixels: DataFrame, keys: list[str], value: str, largest: bool = True) -> DataFrame:
    """The first pixel in row-major order with the largest (or least) value."""
    at = F.struct("row", "col")
    pick = F.max_by(at, F.struct(F.col(value), -F.col("row"), -F.col("col"))) if largest else F.min_by(at, F.struct(F.col(value), "row", "col"))
    return pixels.filter(F.col(value).isNotNull()).groupBy(*keys).agg(pick.alias("at")).select(*keys, F.col("at.row").alias("row"), F.col("at.col").alias("col"))
