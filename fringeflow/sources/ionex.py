"""IONEX text: TEC maps on a regular grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LABEL_AT = 60
#: A line of values that are right-aligned in columns of five.
FIXED = "^([0-9]{5}|[ -][0-9]{4}| [ -][0-9]{3}|  [ -][0-9]{2}|   [ -][0-9])+$"


def read(spark: SparkSession, path: str) -> DataFrame:
    """file, minute, lat, lon, tec from files matched by path; each file is parsed in one row."""
    return parsed(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("body")))


def _field(line: Column, at: int, width: int) -> Column:
    return F.btrim(F.substring(line, at + 1, width)).try_cast("double")


def parsed(files: DataFrame) -> DataFrame:
    """file, minute (of the maps' day), lat, lon, tec of IONEX bodies (file, body), by built-in string functions.

    A body is cut at its map starts; a map at its latitude headers, whose values follow in lines of 16 and count along
    the header's longitudes. Lines whose values sit in the format's columns of five are cut there, as full columns touch; in other
    lines spaces separate the values. Values are scaled by ten to the file's exponent (-1 by default); 9999 is missing."""
    body = files.select("file", "body", F.regexp_extract("body", r"(?m)^\s*(-?[0-9]+)\s+EXPONENT", 1).try_cast("int").alias("e"))
    maps = body.select("file", "e", F.posexplode(F.split("body", r"(?m)^.{60}START OF TEC MAP.*$")).alias("k", "map")).filter("k > 0")
    maps = maps.withColumn("map", F.split("map", r"(?m)^.{60}END OF TEC MAP")[0])
    epoch = F.regexp_extract("map", r"(?m)^(.{60})EPOCH OF CURRENT MAP", 1)
    minute = _field(epoch, 18, 6) * 60 + _field(epoch, 24, 6) + _field(epoch, 30, 6) / 60
    bands = maps.select("file", "e", minute.alias("minute"), F.explode(F.regexp_extract_all("map", F.lit(r"(?m)^(.{60}LAT/LON1/LON2/DLON/H.*\n(?:(?!.{60}LAT/LON1).*\n?)*)"), 1)).alias("band"))
    head = F.substring("band", 1, LABEL_AT)
    lines = F.split(F.regexp_replace("band", r"^.*\n", ""), r"\n")
    spaced = F.transform(lines, lambda x: F.when(F.rtrim(x).rlike(FIXED), F.regexp_replace(x, r"(.{5})", "$1 ")).otherwise(x))
    values = F.filter(F.split(F.array_join(spaced, " "), r"\s+"), lambda v: v.rlike(r"^-?[0-9]+$"))
    rows = bands.select("file", "e", "minute", _field(head, 2, 6).alias("lat"), _field(head, 8, 6).alias("lon1"), _field(head, 20, 6).alias("dlon"), F.posexplode(values).alias("i", "v"))
    tec = F.when(F.col("v").cast("long") != 9999, F.col("v").cast("double") * F.pow(F.lit(10.0), F.coalesce("e", F.lit(-1))))
    return rows.select("file", "minute", "lat", (F.col("lon1") + F.col("i") * F.col("dlon")).alias("lon"), tec.alias("tec"))
