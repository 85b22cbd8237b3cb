"""Session defaults."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a hub's or a large group's rows are split from this size on, not from 256 MB
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64m",
    # readers of terragrid.sources prune by view and row count
    "spark.sql.python.filterPushdown.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with DEFAULTS; ``conf`` adds to them or overrides them."""
    builder = SparkSession.builder.appName("terragrid")
    if master:
        builder = builder.master(master)
    for k, v in (DEFAULTS | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where the session has none, a temporary one on a local master, which is one process."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="terragrid-"))
        configured = sc.getCheckpointDir()
    return configured
