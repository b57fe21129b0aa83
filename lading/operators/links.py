"""Links between members of an archive."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lading.functions.names import link_target_name


def link_steps(members: DataFrame, forward: bool = True) -> DataFrame:
    """``archive_id``, ``member_id``, ``target_id`` of each link: a hard link's is the
    latest member of that name before it (the last of all, if there is none before and
    ``forward``); a symbolic link's the last of that name. A directory's name may lack
    its slash. Null where nothing fits."""
    links = members.filter(F.col("type").isin("symlink", "hardlink")).select("archive_id", "member_id", "type", link_target_name(F.col("name"), F.col("link_target"), F.col("type")).alias("to"))
    keys = F.array(F.struct(F.lit(0).alias("rank"), F.col("to").alias("key")), F.struct(F.lit(1).alias("rank"), F.concat("to", F.lit("/")).alias("key")))
    probe = links.filter("to is not null").select("archive_id", "member_id", "type", F.inline(keys))
    found = probe.join(members.select("archive_id", F.col("name").alias("key"), F.col("member_id").alias("at")), ["archive_id", "key"])
    best = found.groupBy("archive_id", "member_id", "type").agg(
        F.max(F.when(F.col("at") < F.col("member_id"), F.col("at"))).alias("before"), F.max(F.when(F.col("rank") == 0, F.col("at"))).alias("bare"), F.max(F.when(F.col("rank") == 1, F.col("at"))).alias("slash")
    )
    last = F.coalesce("bare", "slash")
    target = F.when(F.col("type") == "symlink", last).otherwise(F.coalesce("before", last) if forward else F.col("before"))
    return links.select("archive_id", "member_id").join(best.select("archive_id", "member_id", target.alias("target_id")), ["archive_id", "member_id"], "left")


def with_link_targets(members: DataFrame, forward: bool = True) -> DataFrame:
    """``members`` with ``link_target_id``: where a link leads through all links between;
    null for other members, for links that lead nowhere and for those in a circle.
    An archive's links are followed together; a listing's limit bounds how many there are."""

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        step = {int(a): None if pd.isna(b) else int(b) for a, b in zip(pdf["member_id"], pdf["target_id"])}
        ends: dict[int, int | None] = {}
        for start in step:
            path, at = [], start
            while at in step and at not in ends and at is not None:
                path.append(at)
                ends[at] = None  # a circle ends here
                at = step[at]
            end = ends[at] if at in step and at is not None else at
            for x in path:
                ends[x] = end
        return pd.DataFrame({"archive_id": pdf["archive_id"], "member_id": pdf["member_id"], "link_target_id": pd.array([ends[int(x)] for x in pdf["member_id"]], "Int32")})

    found = link_steps(members, forward).groupBy("archive_id").applyInPandas(follow, "archive_id string, member_id int, link_target_id int")
    return members.join(found, ["archive_id", "member_id"], "left")


def readable(members: DataFrame) -> DataFrame:
    """``archive_id``, ``member_id`` and ``content_id``, the member whose content a read of it gives: its own, or its target's."""
    return with_link_targets(members).select("archive_id", "member_id", F.when(F.col("type").isin("symlink", "hardlink"), F.col("link_target_id")).otherwise(F.col("member_id")).alias("content_id"))
