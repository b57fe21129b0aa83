"""Integrity: verdicts of full reads, digests of content, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lading.functions.digests import combined_crc32
from lading.sources.archive import member_digests


def verdicts(content: DataFrame) -> DataFrame:
    """A row for each member read: ``verdict`` (ok, unverified, error), fault and bytes."""
    return content.filter("member_id is not null").groupBy("archive_id", "member_id").agg(
        F.max("name").alias("name"), F.max("verdict").alias("verdict"), F.max("error.code").alias("error_code"), F.sum(F.coalesce(F.octet_length("data"), F.lit(0))).cast("long").alias("bytes")
    )


def test_summary(content: DataFrame) -> DataFrame:
    """How many members of each archive are sound, damaged, or without a stored digest."""
    v = verdicts(content)
    return v.groupBy("archive_id").agg(*(F.count_if(F.col("verdict") == k).alias(k) for k in ("ok", "error", "unverified")))


def chunk_checksums(content: DataFrame) -> DataFrame:
    """CRC-32 and length of each chunk, by built-in functions."""
    return content.filter("data is not null").select("archive_id", "member_id", "chunk_index", F.crc32("data").alias("crc"), F.octet_length("data").cast("long").alias("n"))


def member_checksums(content: DataFrame) -> DataFrame:
    """CRC-32 of each member from its chunks' own, without their bytes meeting anywhere."""
    return combined_crc32(chunk_checksums(content), ["archive_id", "member_id"], "chunk_index")


def duplicates_by_digest(members: DataFrame) -> DataFrame:
    """Groups of current files with one size and stored CRC-32: nothing is decoded."""
    files = members.filter((F.col("type") == "file") & F.col("is_current") & F.col("hashes")["crc32"].isNotNull())
    return files.groupBy("size", F.lower(F.hex(F.col("hashes")["crc32"])).alias("crc32")).agg(F.count("*").alias("copies"), F.min(F.concat_ws("!", "archive_id", "name")).alias("first")).filter("copies > 1")


def confirmed_duplicates(members: DataFrame, files: DataFrame, **options) -> DataFrame:
    """Those groups told apart by the SHA-256 of their content; only candidates are
    hashed, as they are decoded, so no member meets in one value. ``files`` (path, content)
    are the archives of ``members``."""
    few = duplicates_by_digest(members).select("size", "crc32")
    rows = members.filter("type = 'file' and is_current").withColumn("crc32", F.lower(F.hex(F.col("hashes")["crc32"]))).join(few, ["size", "crc32"], "left_semi").select("archive_id", "member_id", "size", "crc32")
    hashed = member_digests(files, "sha256", rows, **options).filter("verdict <> 'error'").select("archive_id", "member_id", F.col("digest").alias("sha256"))
    return rows.join(hashed, ["archive_id", "member_id"]).groupBy("size", "crc32", "sha256").agg(F.count("*").alias("copies")).filter("copies > 1")


def io_stats(members: DataFrame, content: DataFrame) -> DataFrame:
    """Of each archive: bytes decoded, members read, and the packed bytes of those whose packed size is known."""
    read = verdicts(content).select("archive_id", "member_id", "bytes")
    rows = read.join(members.select("archive_id", "member_id", "compressed_size"), ["archive_id", "member_id"])
    return rows.groupBy("archive_id").agg(F.sum("bytes").alias("bytes_decoded"), F.sum("compressed_size").alias("bytes_packed"), F.count("*").alias("members_read"))
