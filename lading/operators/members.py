"""Selection, lookup, supersession and limits of members."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lading.functions.names import glob_regex, matches_globs
from lading.functions.values import text_bytes

KEY = ["archive_id", "member_id"]


def with_current(members: DataFrame) -> DataFrame:
    """Of several members with one name in an archive the last is current; a name's only member keeps its flag."""
    w = Window.partitionBy("archive_id", "name")
    last = F.col("member_id") == F.max("member_id").over(w)
    return members.withColumn("is_current", F.when(F.count("*").over(w) > 1, last).otherwise(F.col("is_current")))


def get(members: DataFrame, name: str) -> DataFrame:
    """The last member of each archive with exactly this name."""
    rows = members.filter(F.col("name") == name)
    whole = F.struct(*members.columns)
    return rows.groupBy("archive_id").agg(F.max_by(whole, "member_id").alias("m")).select("m.*")


def contains(members: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``wanted`` (archive_id, member_id) that are members. Names are not
    looked up here: identity is the pair."""
    return wanted.join(members.select(*KEY), KEY, "left_semi")


def selected(members: DataFrame, names: Sequence[str] | None = None, ids: DataFrame | None = None, where=None) -> DataFrame:
    """Members by name, by identity or by a predicate; by any of those given, all if none is."""
    if names is None and ids is None and where is None:
        return members
    keep = F.lit(False)
    if names is not None:
        keep = keep | F.col("name").isin(list(names))
    if where is not None:
        keep = keep | where
    if ids is None:
        return members.filter(keep)
    mark = ids.select(*KEY).distinct().withColumn("_chosen", F.lit(True))
    return members.join(mark, KEY, "left").filter(keep | F.col("_chosen")).drop("_chosen")


def globbed(members: DataFrame, includes: Sequence[str] = (), excludes: Sequence[str] = ()) -> DataFrame:
    return members.filter(matches_globs(F.col("name"), includes, excludes))


def unmatched_includes(members: DataFrame, includes: Sequence[str]) -> DataFrame:
    """``position`` and ``pattern`` of the includes that no member matches: one pass that
    carries a flag for each pattern."""
    if not includes:
        return members.sparkSession.createDataFrame([], "position int, pattern string")
    hits = members.agg(*(F.max(F.col("name").rlike(glob_regex(p))).alias(f"h{i}") for i, p in enumerate(includes)))
    rows = F.array(*(F.struct(F.lit(i).alias("position"), F.lit(p).alias("pattern"), F.coalesce(F.col(f"h{i}"), F.lit(False)).alias("hit")) for i, p in enumerate(includes)))
    return hits.select(F.inline(rows)).filter(~F.col("hit")).select("position", "pattern")


def top_names(members: DataFrame) -> DataFrame:
    """Distinct first segments of each archive, and whether there is just one (then it
    extracts in place, else into a directory of its own)."""
    first = F.element_at(F.filter(F.split("name", "/"), lambda s: ~s.isin("", ".")), 1)
    return members.groupBy("archive_id").agg(F.count_distinct(first).cast("long").alias("roots")).withColumn("single_root", F.col("roots") == 1)


def total_size(members: DataFrame) -> DataFrame:
    """Bytes of each archive's files, null if any size is unknown, and their number."""
    files = members.filter(F.col("type") == "file")
    return files.groupBy("archive_id").agg(F.when(F.count_if(F.col("size").isNull()) == 0, F.sum("size")).alias("total_size"), F.count("*").alias("files"))


def listing_audit(members: DataFrame, most_members: int = 1_048_576, most_bytes: int = 64 << 20) -> DataFrame:
    """Running count and metadata bytes in each archive, and whether a limit is crossed by then."""
    own = sum((text_bytes(F.col(c)) for c in ("name", "uname", "gname", "comment", "link_target")), F.coalesce(F.octet_length("raw_name"), F.lit(0)))
    w = Window.partitionBy("archive_id").orderBy("member_id").rowsBetween(Window.unboundedPreceding, 0)
    out = members.select(*KEY, own.cast("long").alias("metadata_bytes"))
    out = out.withColumn("running_members", F.count("*").over(w)).withColumn("running_bytes", F.sum("metadata_bytes").over(w))
    return out.withColumn("crossed", (F.col("running_members") > most_members) | (F.col("running_bytes") > most_bytes))


def block_offsets(members: DataFrame) -> DataFrame:
    """The decoded bytes that lie before each member in its block."""
    w = Window.partitionBy("archive_id", "block").orderBy("block_position", "member_id").rowsBetween(Window.unboundedPreceding, -1)
    return members.withColumn("block_offset", F.coalesce(F.sum("size").over(w), F.lit(0)))


def blocks(members: DataFrame) -> DataFrame:
    """Members and bytes of each independently decodable block, the unit of parallel reads."""
    return members.filter(F.col("type") == "file").groupBy("archive_id", "block").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
