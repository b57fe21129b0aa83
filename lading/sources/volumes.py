"""Volume sets: parts of one archive found by their names and joined in order."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NUMBERED, _PART, _R = r"(?i)^(.*\.(?:7z|zip))\.(\d{3,})$", r"(?i)^(.*)\.part(\d+)\.rar$", r"(?i)^(.*)\.r(\d\d)$"


def volume_place(path: str) -> tuple[str, int]:
    """The set (folded name) that a file belongs to and its place in it, as :func:`volume_keys` says of rows."""
    if m := re.match(_NUMBERED, path):
        return m[1].lower(), int(m[2])
    if m := re.match(_PART, path):
        return m[1].lower() + ".rar", int(m[2])
    if m := re.match(_R, path):
        return m[1].lower() + ".rar", int(m[2]) + 2
    return path.lower() if path.lower().endswith(".rar") else path, 1


def volume_keys(files: DataFrame) -> DataFrame:
    """``files`` with ``base`` (folded name of the set) and ``part`` (from 1); a file of no set is its own."""
    path = F.col("path")
    get = lambda pattern, k: F.regexp_extract(path, pattern, k)
    base = (
        F.when(path.rlike(_NUMBERED), F.lower(get(_NUMBERED, 1)))
        .when(path.rlike(_PART), F.lower(F.concat(get(_PART, 1), F.lit(".rar"))))
        .when(path.rlike(_R), F.lower(F.concat(get(_R, 1), F.lit(".rar"))))
        .when(F.lower(path).endswith(".rar"), F.lower(path))
        .otherwise(path)
    )
    part = F.when(path.rlike(_NUMBERED), get(_NUMBERED, 2).cast("int")).when(path.rlike(_PART), get(_PART, 2).cast("int")).when(path.rlike(_R), get(_R, 2).cast("int") + 2).otherwise(1)
    return files.withColumn("base", base).withColumn("part", part)


def volume_sets(files: DataFrame) -> DataFrame:
    """``base``, ``paths`` and ``parts`` in order, ``volumes`` and ``complete`` (parts 1 to n without a gap)."""
    sets = volume_keys(files).groupBy("base").agg(F.array_sort(F.collect_list(F.struct("part", "path"))).alias("v"))
    return sets.select("base", F.col("v.path").alias("paths"), F.col("v.part").alias("parts"), F.size("v").alias("volumes"), (F.col("v.part") == F.sequence(F.lit(1), F.size("v"))).alias("complete"))


def joined_volumes(files: DataFrame) -> DataFrame:
    """``path`` (of the first volume), ``content`` (of all in order) and ``volumes``;
    sets with a gap are left out. Only files that are parts of a set are shuffled. A set
    must fit a row (2 GiB); larger ones are read by ``format('archive')`` with the option
    ``volumes``, which joins nothing."""
    keyed = volume_keys(files)
    lone = keyed.filter((F.col("base") == F.col("path")) & ~F.lower("path").endswith(".rar")).select("path", "content", F.lit(1).alias("volumes"))
    parts = keyed.filter((F.col("base") != F.col("path")) | F.lower("path").endswith(".rar"))
    sets = parts.groupBy("base").agg(F.array_sort(F.collect_list(F.struct("part", "path", "content"))).alias("v")).filter(F.col("v.part") == F.sequence(F.lit(1), F.size("v")))
    whole = F.aggregate("v", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["content"]))
    return lone.unionByName(sets.select(F.col("v")[0]["path"].alias("path"), whole.alias("content"), F.size("v").alias("volumes")))
