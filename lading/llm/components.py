"""Connected components of a link table by alternating large-star and small-star
steps, after a local union-find in each partition. No step gathers the links."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lading.llm.common import discard, lean, materialise


def forest(pairs) -> list[tuple[int, int]]:
    """(node, smallest node of its tree) for the nodes of ``pairs`` that aren't smallest."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return [(x, root(x)) for x in up]


def _contract(batches):
    """Union-find over one partition; a forest is passed on once it grows large, which
    costs nothing but links that a later step contracts."""
    found: list[tuple[int, int]] = []
    for batch in batches:
        found += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        if len(found) > 1_000_000:
            found = forest(found)
            if len(found) > 500_000:
                yield pa.record_batch([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["hi", "lo"])
                found = []
    found = forest(found)
    yield pa.record_batch([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["hi", "lo"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    joined = edges.join(least, "hi")
    return joined.select(F.col("hi"), F.col("m").alias("lo")).unionByName(joined.filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether each node has one edge to a smaller one, which has none: stars."""
    ends = edges.select(F.col("hi").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("lo").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1").isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component`` (the smallest node that it reaches) for every node
    of a link that isn't its component's smallest. Self-links, repeated links and
    links with a null end are ignored; no links give no rows."""
    edges = links.select(F.greatest(a, b).cast("long").alias("hi"), F.least(a, b).cast("long").alias("lo")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("hi") != F.col("lo")))
    edges = materialise(edges.mapInArrow(lean(_contract), "hi long, lo long"), "links")
    while not _settled(edges):
        step = materialise(_small_star(_large_star(edges)), "links")
        discard(edges)
        edges = step
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
