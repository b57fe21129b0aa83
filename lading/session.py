"""A session with the settings that the library's plans count on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.python.filterPushdown.enabled": "true",
    "spark.sql.redaction.options.regex": "(?i)password|secret|token|url",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or under a
    local master that names none a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="lading-"))
    return _own[0]


_own: list[str] = []


def session(master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """The active session, or one with :data:`SETTINGS` and ``conf``; ``master`` only where none is set from outside."""
    builder = SparkSession.builder.appName("lading").config(map=SETTINGS | (conf or {}))
    if master:
        builder = builder.master(master)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
