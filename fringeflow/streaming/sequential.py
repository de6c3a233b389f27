"""Ministacks: the plan of a sequential estimator, its batch loop, and the same over a stream of new dates."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fringeflow.operators import ps
from fringeflow.operators.phaselink import LinkOptions, link_stack
from fringeflow.tables import delete

PIXEL = ["scene", "row", "col"]
PLANS = ("always_first", "first_per_ministack", "last_per_ministack")


@dataclass(frozen=True)
class Ministack:
    """A batch: places of its real dates, keys (reference, first, last) of the compressed images before it, reference places."""

    index: int
    real: tuple[int, ...]
    compressed: tuple[tuple[int, int, int], ...]
    output_reference: int
    compressed_reference: int
    produces: tuple[int, int, int] = field(default=(0, 0, 0))


def plan(dates: list[int], size: int, n_compressed: int = 0, most_compressed: int = 10, scheme: str = "always_first", reference: int | None = None) -> list[Ministack]:
    """Batches of `size` real dates after the first n_compressed; each carries the newest most_compressed compressed images.

    The output reference is the newest compressed image's place (or 0). always_first compresses to the same reference,
    first_per_ministack to the batch's first real date, last_per_ministack (one batch only) to its last."""
    if scheme not in PLANS:
        raise ValueError(f"unknown scheme {scheme}")
    if size < 2:
        raise ValueError("a ministack needs two dates")
    real = dates[n_compressed:]
    if scheme == "last_per_ministack" and len(real) > size:
        raise ValueError("last_per_ministack is for a single ministack")
    held = [(d, d, d) for d in dates[:n_compressed]]
    out = []
    for k, at in enumerate(range(0, len(real), size)):
        part = real[at : at + size]
        now = tuple(held[-most_compressed:])
        own = max(0, len(now) - 1) if reference is None else reference
        to = {"always_first": own, "first_per_ministack": len(now), "last_per_ministack": len(now) + len(part) - 1}[scheme]
        axis = [c[0] for c in now] + part
        made = (axis[to], part[0], part[-1])
        out.append(Ministack(k, tuple(part), now, own, to, made))
        held.append(made)
    return out


def check_new(dates: list[int], held: list[tuple[int, int, int]]) -> None:
    """A real date may not be the newest compressed image's reference."""
    if held and max(held, key=lambda c: c[2])[0] in dates:
        raise ValueError("a new date equals the reference of the newest compressed image")


def chunked(dates: DataFrame, size: int, first_real: int = 0) -> DataFrame:
    """scene, t, batch: places of the dates in runs of `size`, counted per scene; compressed dates have batch -1."""
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("scene").orderBy("t")) - 1
    ranked = dates.withColumn("i", i)
    return ranked.select("scene", "t", F.when(F.col("i") < first_real, F.lit(-1)).otherwise(F.floor((F.col("i") - first_real) / size).cast("int")).alias("batch"))


class Batch(NamedTuple):
    """linked: scene, row, col, t, phase, temp_coh of the batch's dates; compressed: the image that sums it up; pixels: linked_pixels'
    arrays over the compressed dates and then the batch's."""

    linked: DataFrame
    compressed: DataFrame
    pixels: DataFrame


def run_batch(batch: DataFrame, held: DataFrame | None, ministack: Ministack, options: LinkOptions, stats: DataFrame | None = None, keep: Callable[[DataFrame], DataFrame] | None = None) -> Batch:
    """Links a batch as link_stack does, whatever batch of how many it is.

    batch: scene, t, row, col, re, im of the batch's dates; held: the compressed images (key: place in ministack.compressed);
    stats: amplitude statistics for similar pixels and scatterers, by default the batch's own; keep: see link_stack."""
    n_held = len(ministack.compressed)
    place = F.element_at(F.create_map(*(F.lit(x) for i, t in enumerate(ministack.real) for x in (t, n_held + i))), F.col("t"))
    stack = batch.filter(F.col("t").isin(list(ministack.real))).withColumn("t", place.cast("int")).select("scene", "t", "row", "col", "re", "im")
    if held is not None and n_held:
        stack = stack.unionByName(held.select("scene", F.col("key").cast("int").alias("t"), "row", "col", "re", "im"))
    n, real = n_held + len(ministack.real), stack.filter(F.col("t") >= n_held)
    own = ps.amplitude_stats(real, PIXEL)
    found = link_stack(stack, n, options, own if stats is None else stats, ministack.output_reference, n_held, keep)
    phasor = found.dates.select("scene", "t", "row", "col", F.cos(F.atan2("im", "re")).alias("re"), F.sin(F.atan2("im", "re")).alias("im"))
    made = ps.compressed(stack, phasor, own, *options.strides, first_real=n_held, reference=ministack.compressed_reference)
    back = F.element_at(F.create_map(*(F.lit(x) for i, t in enumerate(ministack.real) for x in (n_held + i, t))), F.col("t"))
    linked = found.dates.filter(F.col("t") >= n_held).select(*PIXEL, back.cast("int").alias("t"), F.atan2("im", "re").alias("phase"), "temp_coh")
    return Batch(linked, made, found.pixels)


class SequentialEstimator:
    """State on disk: tables under a folder, one sub-folder per ministack. `compressed`, written last, marks one finished; it isn't done
    again, and one that isn't marked is written anew.

    Feed it batches in order (process), or a stream of dates (start): each trigger's new dates are one ministack. Dates
    that were linked before, or that are the newest compressed image's reference, go to `rejected` and not into the
    ministack. Similar pixels and scatterers come from the amplitude of all dates so far."""

    def __init__(self, spark: SparkSession, folder: str, options: LinkOptions | tuple[int, int], strides: tuple[int, int] = (1, 1), most_compressed: int = 10, scheme: str = "always_first", extra_reference: int | None = None):
        if scheme not in PLANS:
            raise ValueError(f"unknown scheme {scheme}")
        self.spark, self.folder, self.most, self.scheme, self.extra_reference = spark, folder, most_compressed, scheme, extra_reference
        self.options = options if isinstance(options, LinkOptions) else LinkOptions(half_window=options, strides=strides)

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def finished(self) -> list[int]:
        """The numbers of the finished ministacks; numbers may be missing where a trigger had no new date."""
        fs, where = self._fs(f"{self.folder}/compressed")
        names = [x.getPath().getName() for x in fs.listStatus(where)] if fs.exists(where) else []
        return sorted(int(x) for x in names if self._done(f"compressed/{x}"))

    def _done(self, name: str) -> bool:
        fs, where = self._fs(f"{self.folder}/{name}/_SUCCESS")
        return fs.exists(where)

    def _read(self, name: str, index: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}/{index:06d}")

    def _write(self, frame: DataFrame, name: str, index: int) -> DataFrame:
        frame.write.mode("overwrite").parquet(f"{self.folder}/{name}/{index:06d}")
        return self._read(name, index)

    def keys(self, before: int | None = None) -> list[tuple[int, int, int]]:
        """(reference, first, last date) of the compressed images so far."""
        rows = [self._read("keys", k).first() for k in self.finished() if before is None or k < before]
        return [(r["ref_t"], r["start_t"], r["end_t"]) for r in rows]

    def process(self, batch: DataFrame, index: int) -> None:
        """One ministack; writes rejected rows, linked dates and statistics, then the compressed image. All of them read the batch from a
        table that is deleted in the end, so that it is computed once, whatever it comes from."""
        earlier = [k for k in self.finished() if k < index]
        if self._done(f"compressed/{index:06d}"):
            return
        try:
            self._process(self._write(batch, "given", index), index, earlier)
        finally:
            delete(self.spark, [f"{self.folder}/given/{index:06d}"])

    def _process(self, batch: DataFrame, index: int, earlier: list[int]) -> None:
        held = self.keys(index)
        known = {r["t"] for k in earlier for r in self._read("days", k).collect()}
        if held:
            known.add(max(held, key=lambda c: c[2])[0])
        late = F.col("t").isin(sorted(known)) if known else F.lit(False)
        self._write(batch.filter(late), "rejected", index)
        batch = batch.filter(~late)
        days = sorted(r[0] for r in batch.select("t").distinct().collect())
        if not days:
            return
        now, kept = held[-self.most :], earlier[-self.most :]
        if self.scheme == "last_per_ministack" and earlier:
            raise ValueError("last_per_ministack is for a single ministack")
        own = max(0, len(now) - 1)
        to = {"always_first": own, "first_per_ministack": len(now), "last_per_ministack": len(now) + len(days) - 1}[self.scheme]
        stack = Ministack(index, tuple(days), tuple(now), own, to)
        union = None
        for place, k in enumerate(kept):
            one = self._read("compressed", k).withColumn("key", F.lit(place))
            union = one if union is None else union.unionByName(one)
        self._write(ps.amplitude_stats(batch, PIXEL), "stats", index)
        stats = None
        for k in [*earlier, index]:
            one = self._read("stats", k).select(*PIXEL, "n", "mean", "dispersion")
            stats = one if stats is None else stats.unionByName(one)
        stats = ps.from_dispersion(ps.combined(stats, PIXEL))
        dates = len(known | set(days)) if self.options.shp_dates is None else self.options.shp_dates
        found = run_batch(batch, union, stack, replace(self.options, shp_dates=dates), stats, lambda pixels: self._write(pixels, "pixels", index))
        axis = [c[0] for c in now] + days
        self._write(found.linked, "linked", index)
        self._write(self.spark.createDataFrame([(t,) for t in days], "t int"), "days", index)
        self._write(self.spark.createDataFrame([(axis[to], days[0], days[-1])], "ref_t int, start_t int, end_t int"), "keys", index)
        self._write(found.compressed, "compressed", index)

    def start(self, stream: DataFrame, checkpoint: str):
        """A query over a stream of (scene, t, row, col, re, im) rows; available data is worked off in one ministack per micro-batch."""
        return stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def rejected(self) -> DataFrame:
        """The rows that came too late."""
        return self.spark.read.parquet(f"{self.folder}/rejected/*")

    def linked(self) -> DataFrame:
        """All linked dates; those after the extra reference date, if there is one, refer to it."""
        found = self.spark.read.parquet(f"{self.folder}/linked/*")
        if self.extra_reference is None:
            return found
        at = found.filter(F.col("t") == self.extra_reference).select(*PIXEL, F.col("phase").alias("__ref"))
        turned = F.col("phase") - F.col("__ref")
        return found.join(at, PIXEL, "left").withColumn("phase", F.when(F.col("t") > self.extra_reference, F.atan2(F.sin(turned), F.cos(turned))).otherwise(F.col("phase"))).drop("__ref")
