"""Stacks derived from plain tables: whole tables become scenes of complex samples.

A scene is a run of orders. A sample's row, column and date follow from a line's part, supplier and shipping year, and
its value is the coherent sum of the lines that fall on it, as a resolution cell sums its scatterers. The number of
scenes grows with the table; a scene's size doesn't. Cells without a line are missing data."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

ROWS, COLS, DATES, ORDERS = 16, 10, 7, 1120
FIRST_YEAR = 1995


@F.arrow_udf(StructType([StructField("re", DoubleType()), StructField("im", DoubleType())]))
def phasor(size: pa.Array, phase: pa.Array) -> pa.Array:
    """size * (cos(phase), sin(phase)) with the C library's functions, as the oracle takes them: the JVM's differ in the last bit of some
    values, and a line that is alone on its cell has a whole number as its amplitude, where thresholds and ties lie."""
    given = np.asarray(phase.to_numpy(zero_copy_only=False), dtype=float).tolist()
    length = np.asarray(size.to_numpy(zero_copy_only=False), dtype=float)
    parts = [length * np.fromiter(map(fn, given), float, len(given)) for fn in (math.cos, math.sin)]
    missing = pa.compute.or_(size.is_null(), phase.is_null()).to_numpy(zero_copy_only=False)
    return pa.StructArray.from_arrays([pa.array(x, mask=missing) for x in parts], ["re", "im"])


def slc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene, t, row, col, re, im."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    phase = F.lit(2 * math.pi / 100) * F.pmod(F.col("l_extendedprice"), F.lit(100.0)) - F.lit(math.pi)
    cell = [
        F.floor((F.col("l_orderkey")) / ORDERS).cast("int").alias("scene"),
        (F.year("l_shipdate") - FIRST_YEAR).cast("int").alias("t"),
        (F.col("l_partkey") % ROWS).cast("int").alias("row"),
        (F.col("l_suppkey") % COLS).cast("int").alias("col"),
    ]
    points = lines.select(*cell, phasor(F.col("l_quantity").cast("double"), phase).alias("z")).select("scene", "t", "row", "col", "z.re", "z.im")
    return points.groupBy("scene", "t", "row", "col").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


SLC_SQL = f"""slc AS (
  SELECT scene, t, "row", col, sum(q * cos(p)) AS re, sum(q * sin(p)) AS im FROM (
    SELECT CAST(floor(l_orderkey / {ORDERS}.0) AS INT) AS scene, CAST(year(l_shipdate) - {FIRST_YEAR} AS INT) AS t,
           CAST(l_partkey % {ROWS} AS INT) AS "row", CAST(l_suppkey % {COLS} AS INT) AS col, l_quantity AS q,
           2 * pi() / 100 * (l_extendedprice - 100 * floor(l_extendedprice / 100)) - pi() AS p
    FROM lineitem) GROUP BY ALL)"""


def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene, t, dt: the dates of each scene's images; the year's first of May, shifted by the scene so that intervals vary."""
    found = slc(spark, sf_dir).select("scene", "t").distinct()
    return found.withColumn("dt", F.expr(f"date_add(make_date({FIRST_YEAR} + t, 5, 1), (scene * 7 + t * 11) % 40)"))


DATES_SQL = f"""dates AS (
  SELECT scene, t, make_date({FIRST_YEAR} + t, 5, 1) + CAST((scene * 7 + t * 11) % 40 AS INT) AS dt
  FROM (SELECT DISTINCT scene, t FROM slc))"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, t, value: embeddings as time series."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("t", "value")).withColumn("value", F.col("value").cast("double"))
