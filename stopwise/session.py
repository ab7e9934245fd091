"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession

# Set only where the submitter has not chosen a value.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.parquet.compression.codec": "zstd",
}


def build_session(app_name: str = "stopwise", master: str | None = None, **conf: str) -> SparkSession:
    """Session with this library's defaults; ``conf`` keys use ``__`` for the dot.

    What was given on the command line of ``spark-submit``, or is set in a session that already runs, stands
    above the defaults; ``conf`` stands above both.
    """
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    given = {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in given.items():
        builder = builder.config(key, value)
    running = SparkSession.getActiveSession() is not None
    spark = builder.getOrCreate()
    chosen = {**dict(spark.sparkContext.getConf().getAll()), **given}
    for key, value in DEFAULTS.items():
        if not running and key not in chosen:
            spark.conf.set(key, value)
    return spark


@cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="stopwise-")


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, the storage every executor can reach.

    A temporary folder is taken only where that setting is absent and the master is local: on a cluster every
    executor would write to a disk of its own, so there the absence is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _local_root()
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
