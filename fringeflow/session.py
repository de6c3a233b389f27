"""Session defaults shared by tests, the bench and the command line."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Settings that results rely on or that keep small runs quick; a cluster's own settings win elsewhere.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """The active session, or a new one with DEFAULTS (and local[*] where no master is given)."""
    builder = SparkSession.builder.appName("fringeflow")
    if master or "SPARK_MASTER" not in os.environ:
        builder = builder.master(master or "local[*]")
    for key, value in (DEFAULTS | conf).items():
        builder = builder.config(key, value)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()
