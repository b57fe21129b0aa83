"""Structured Streaming over a folder of arriving archives (an addition of this library)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lading.sources.archive import content, members

BINARY = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """Files of ``folder`` (path, content, modificationTime) as they appear, each once."""
    return spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(folder)


def arriving_members(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Members of arriving archives; ids are places in the archive, so a replay gives the same rows."""
    return members(arriving(spark, folder), **options)


def arriving_content(spark: SparkSession, folder: str, **options) -> DataFrame:
    return content(arriving(spark, folder), **options)


def new_files(spark: SparkSession, folder: str, delay: str = "1 hour", **options) -> DataFrame:
    """Files not seen before by size and stored checksum, among archives whose files were
    written at most ``delay`` apart: event time is the archive's modification time, so a
    replay keeps and drops the same rows."""
    arrived = arriving(spark, folder).select(F.concat(F.unix_micros("modificationTime").cast("string"), F.lit("|"), F.col("path")).alias("path"), "content")
    rows = members(arrived, **options).filter("type = 'file'").withColumn("crc32", F.lower(F.hex(F.col("hashes")["crc32"])))
    seen = F.timestamp_micros(F.substring_index("archive_id", "|", 1).cast("long"))
    stamped = rows.withColumn("seen_at", seen).withColumn("archive_id", F.regexp_replace("archive_id", "^[0-9]+\\|", "")).withWatermark("seen_at", delay)
    return stamped.dropDuplicatesWithinWatermark(["size", "crc32"]).select("archive_id", "member_id", "name", "size", "crc32")
