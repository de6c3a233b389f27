"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a run on one machine
    (tests) makes a temporary folder which becomes the session's setting; a cluster has no such folder, so it's an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialise(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Writes df to a new table in the shared folder and reads it back: lineage ends there, and a lost
    executor costs a re-read rather than a recomputation. Inside scratch() the table is deleted at the end, unless keep."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    made = _scratch.get()
    if made is not None and not keep:
        made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that materialise() makes inside, when the block ends, however it ends."""
    made: list[str] = []
    before = _scratch.set(made)
    try:
        yield
    finally:
        _scratch.reset(before)
        delete(spark, made)
