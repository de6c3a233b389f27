"""Ionosphere delays, baselines and geocoding."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def trilinear(points: DataFrame, grid: DataFrame, steps: tuple[float, float, float], key: list[str]) -> DataFrame:
    """points (key, minute, lat, lon) with tec, interpolated from a regular grid (day, minute, lat, lon, tec) of the given steps.

    Eight equi-joins in one: each point asks for its cell's corners by their whole grid indices. A point outside the
    grid, so without all its corners of positive weight, gets null."""
    names = ("minute", "lat", "lon")
    at = points
    for n, step in zip(names, steps, strict=True):
        at = at.withColumn(f"__f_{n}", F.col(n) / step)
    corners = F.explode(F.array(*(F.struct(*(F.lit(b).alias(n) for n, b in zip(names, bits, strict=True))) for bits in itertools.product((0, 1), repeat=3))))
    spread = at.withColumn("__b", corners)
    weight = F.lit(1.0)
    for n in names:
        low = F.floor(f"__f_{n}")
        part = F.col(f"__f_{n}") - low
        weight = weight * F.when(F.col(f"__b.{n}") == 1, part).otherwise(1 - part)
        spread = spread.withColumn(f"__i_{n}", (low + F.col(f"__b.{n}")).cast("long"))
    asks = spread.withColumn("__w", weight).filter("__w > 0")
    held = grid.select("day", *(F.round(F.col(n) / step).cast("long").alias(f"__i_{n}") for n, step in zip(names, steps, strict=True)), F.col("tec").alias("__tec"))
    met = asks.join(held, ["day", *(f"__i_{n}" for n in names)], "left")
    sums = met.groupBy(*key).agg(F.sum(F.col("__w") * F.col("__tec")).alias("tec"), F.sum(F.when(F.col("__tec").isNotNull(), F.col("__w"))).alias("w"))
    return sums.select(*key, F.when(F.col("w") > 1 - 1e-9, F.col("tec")).alias("tec"))


def bilinear(points: DataFrame, grid: DataFrame, keys: list[str], value: str) -> DataFrame:
    """points (keys, id, y, x in grid units) with the grid's (keys, row, col) bilinear value; places past the last row or column take its edge."""
    edge = grid.groupBy(*keys).agg(F.max("row").alias("__mr"), F.max("col").alias("__mc"))
    p = points.join(edge, keys).withColumn("__y", F.least(F.greatest("y", F.lit(0.0)), "__mr")).withColumn("__x", F.least(F.greatest("x", F.lit(0.0)), "__mc"))
    spread = p.withColumn("__b", F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)))))
    fy, fx = F.col("__y") - F.floor("__y"), F.col("__x") - F.floor("__x")
    w = F.when(F.col("__b.a") == 1, fy).otherwise(1 - fy) * F.when(F.col("__b.b") == 1, fx).otherwise(1 - fx)
    asks = spread.select(*keys, "id", (F.floor("__y") + F.col("__b.a")).cast("int").alias("row"), (F.floor("__x") + F.col("__b.b")).cast("int").alias("col"), w.alias("__w")).filter("__w > 0")
    return asks.join(grid.select(*keys, "row", "col", value), [*keys, "row", "col"]).groupBy(*keys, "id").agg(F.sum(F.col("__w") * F.col(value)).alias(value))


def interferogram_delays(delays: DataFrame, edges: DataFrame) -> DataFrame:
    """Reference less secondary delay of each pair: delays (scene, t, row, col, delay)."""
    ref = delays.select("scene", F.col("t").alias("ref_t"), "row", "col", F.col("delay").alias("a"))
    sec = delays.select("scene", F.col("t").alias("sec_t"), "row", "col", F.col("delay").alias("b"))
    return ref.join(edges, ["scene", "ref_t"]).join(sec, ["scene", "sec_t", "row", "col"]).select("scene", "ref_t", "sec_t", "row", "col", (F.col("a") - F.col("b")).alias("delay"))


Vector = tuple[Column, Column, Column]


def _minus(a: Vector, b: Vector) -> Vector:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def _dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def perpendicular_baseline(target: Vector, ref: Vector, sec: Vector, ref_range: Column, sec_range: Column, velocity: Vector) -> Column:
    """By the law of cosines between both ranges and the distance of the sensors; signed by the side of the track."""
    between = _minus(sec, ref)
    length = F.sqrt(_dot(between, between))
    cosine = F.try_divide(ref_range**2 + length**2 - sec_range**2, 2 * ref_range * length)
    across = length * F.sqrt(F.greatest(1 - cosine**2, F.lit(0.0)))
    return F.signum(_dot(_cross(_minus(target, ref), between), velocity)) * across


class Orbit:
    """Positions and velocities of a sensor at some times; between them a cubic Hermite curve."""

    def __init__(self, times, positions, velocities):
        import numpy as np

        self.t, self.x, self.v = (np.asarray(a, dtype=float) for a in (times, positions, velocities))
        if len(self.t) < 2 or (np.diff(self.t) <= 0).any():
            raise ValueError("an orbit needs two states or more, in order of time")

    def at(self, t):
        """Position and velocity at each time, extrapolated from the end segments."""
        import numpy as np

        k = np.clip(np.searchsorted(self.t, t) - 1, 0, len(self.t) - 2)
        h = self.t[k + 1] - self.t[k]
        u = ((t - self.t[k]) / h)[:, None]
        h = h[:, None]
        a, b, va, vb = self.x[k], self.x[k + 1], self.v[k] * h, self.v[k + 1] * h
        x = a * (2 * u**3 - 3 * u**2 + 1) + va * (u**3 - 2 * u**2 + u) + b * (3 * u**2 - 2 * u**3) + vb * (u**3 - u**2)
        v = (a * (6 * u**2 - 6 * u) + va * (3 * u**2 - 4 * u + 1) + b * (6 * u - 6 * u**2) + vb * (3 * u**2 - 2 * u)) / h
        return x, v

    def closest(self, targets, rounds: int = 50):
        """Zero-Doppler time, range, position and velocity for each target: Newton steps on the projection of the line of sight onto the track."""
        import numpy as np

        t = np.full(len(targets), (self.t[0] + self.t[-1]) / 2)
        for _ in range(rounds):
            x, v = self.at(t)
            step = ((targets - x) * v).sum(axis=1) / (v * v).sum(axis=1)
            t = t + step
            if not len(step) or np.abs(step).max() < 1e-9:
                break
        x, v = self.at(t)
        return t, np.linalg.norm(targets - x, axis=1), x, v


def baseline_grid(points: DataFrame, reference: Orbit, secondary: Orbit, key: str) -> DataFrame:
    """key and baseline: the perpendicular baseline at each point (key, x, y, z; earth-fixed metres) of two orbits.

    The orbits, a few states each, go with the tasks; points are solved by whole Arrow batches."""
    kind = points.schema[key].dataType.simpleString()

    def run(frames):
        import numpy as np
        import pandas as pd

        for frame in frames:
            target = frame[["x", "y", "z"]].to_numpy(float)
            _, r1, ref, v = reference.closest(target)
            _, r2, sec, _ = secondary.closest(target)
            between = sec - ref
            length = np.linalg.norm(between, axis=1)
            cosine = np.divide(r1**2 + length**2 - r2**2, 2 * r1 * length, out=np.ones_like(r1), where=length > 0)
            across = length * np.sqrt(np.maximum(1 - cosine**2, 0))
            side = np.sign((np.cross(target - ref, between) * v).sum(axis=1))
            yield pd.DataFrame({key: frame[key], "baseline": side * across})

    return points.select(key, "x", "y", "z").mapInPandas(run, f"{key} {kind}, baseline double")


def to_ecef(lon: Column, lat: Column, height: Column) -> Vector:
    """WGS84 degrees and metres to earth-fixed metres."""
    a, e2 = 6378137.0, 6.69437999014e-3
    n = F.lit(a) / F.sqrt(1 - F.lit(e2) * F.sin(F.radians(lat)) ** 2)
    flat = (n + height) * F.cos(F.radians(lat))
    return flat * F.cos(F.radians(lon)), flat * F.sin(F.radians(lon)), (n * (1 - e2) + height) * F.sin(F.radians(lat))


def geocoded(pixels: DataFrame, locations: DataFrame, keys: list[str], origin: tuple[float, float], spacing: tuple[float, float]) -> DataFrame:
    """keys, row, col, value on a regular lon/lat grid: each output cell takes the input pixel nearest its middle (first in row-major order among equals); cells that no pixel falls into are absent.

    locations: row, col, lon, lat of the input pixels."""
    placed = pixels.join(locations, ["row", "col"])
    x, y = (F.col("lon") - origin[0]) / spacing[0], (F.col("lat") - origin[1]) / spacing[1]
    cell = placed.select(*keys, F.floor(y).cast("int").alias("r"), F.floor(x).cast("int").alias("c"), "value", "row", "col", ((x - F.floor(x) - 0.5) ** 2 + (y - F.floor(y) - 0.5) ** 2).alias("d"))
    return cell.groupBy(*keys, "r", "c").agg(F.min_by("value", F.struct("d", "row", "col")).alias("value")).withColumnsRenamed({"r": "row", "c": "col"})
