"""Diagnostics as rows: counts, policies, retention, what is new."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lading.functions.names import has_bidi


def counts(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.groupBy("code").agg(F.count("*").alias("n"))


def under_policy(diagnostics: DataFrame, policy: dict[str, str]) -> DataFrame:
    """Codes are collected unless the policy says ``ignore`` or ``raise``; an action on the result fails at the first of the latter."""
    ignored, fatal = ([c for c, p in policy.items() if p == what] for what in ("ignore", "raise"))
    out = diagnostics.filter(~F.col("code").isin(ignored)) if ignored else diagnostics
    if fatal:
        message = F.concat(F.lit("diagnostic "), F.col("code"), F.lit(": "), F.col("message"))
        out = out.filter(F.when(F.col("code").isin(fatal), F.raise_error(message).cast("boolean")).otherwise(True))
    return out


def retained(diagnostics: DataFrame, most: int = 256) -> DataFrame:
    """The first ``most`` of each archive; counts stay exact through :func:`counts`."""
    w = Window.partitionBy("archive_id").orderBy("seq")
    return diagnostics.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")


def since(diagnostics: DataFrame, seq: int) -> DataFrame:
    """Counts of what came after a cursor."""
    return counts(diagnostics.filter(F.col("seq") > seq))


def name_warnings(members: DataFrame) -> DataFrame:
    """Names with characters that turn the direction of text."""
    return members.filter(has_bidi(F.col("name"))).select("archive_id", "member_id", F.lit("bidi_control").alias("code"), "name")
