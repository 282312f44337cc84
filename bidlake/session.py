"""Session settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "bidlake", master: str | None = None, **settings: str) -> SparkSession:
    """A session with UTC, ANSI and adaptive execution. On a cluster leave ``master`` to the launcher."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in settings.items()}
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Where driver and executors both write: ``spark.checkpoint.dir``; unset, a temporary folder, on a single machine only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "/tmp/bidlake-checkpoints"
    return folder
