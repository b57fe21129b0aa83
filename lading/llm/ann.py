"""Nearest neighbours by cosine through stable low-dimensional projections and kd-trees.

Unit vectors are projected to a few dimensions by one Gaussian matrix; for vectors at
distance d the squared projected distance is d*d times a chi-square variable. A kd-tree
over the projections, its upper part fitted on a bounded sample and its lower parts
built in each block of vectors, gives a query's neighbours in order of projected
distance; they are verified on the original vectors until the chi-square test says that
a vector nearer than the k-th best would hardly still be unseen. A query first visits
its own cell, then a few near ones, then those that its bound still reaches."""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lading.llm.common import discard, materialise, q

#: Vectors in a block of the index, queries in a bundle, vectors in a leaf.
BLOCK, QUERIES, LEAF = 4096, 1024, 256
#: Vectors that the upper tree is fitted on, and its cells, at most.
SAMPLE, CELLS = 20_000, 4096
#: Projected dimensions.
DIMS = 16
#: The least probability with which a near vector has been seen when a search stops.
SURE = 0.97
#: Cells that a query visits in its first rounds; the last takes all that its bound reaches.
VISITS = (1, 4)
#: Cosines that differ by less may be equal.
CLOSE = 1e-12


def chi_square_cdf(x: float, dims: int) -> float:
    """Lower regularised gamma function at (dims/2, x/2), by its series."""
    if x <= 0:
        return 0.0
    a, z = dims / 2, x / 2
    if z > 40 + 4 * a:
        return 1.0
    term = total = 1 / a
    n = a
    while term > total * 1e-12:
        n += 1
        term *= z / n
        total += term
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a)))


def chi_square_quantile(p: float, dims: int) -> float:
    low, high = 0.0, 1.0
    while chi_square_cdf(high, dims) < p:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_cdf(middle, dims) < p else (low, middle)
    return high


def projection(width: int, dims: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((width, dims))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector times a power of two, its largest component between 1/2 and 1: cosines
    stay the same to the last bit, and no sum of squares leaves the range of a double."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1, keepdims=True))[1])


def projected(vectors: np.ndarray, dims: int) -> np.ndarray:
    """Projections of the unit vectors of ``scaled`` ones."""
    norms = np.sqrt((vectors * vectors).sum(1, keepdims=True))
    return (vectors / norms) @ projection(vectors.shape[1], dims)


def halves(points: np.ndarray, at: np.ndarray) -> tuple[int, float, np.ndarray, np.ndarray]:
    """The widest dimension of the points, its median, and those below and not below it."""
    axis = int(np.argmax(np.ptp(points[at], axis=0)))
    cut = float(np.median(points[at, axis]))
    below = points[at, axis] < cut
    return axis, cut, at[below], at[~below]


def upper_tree(points: np.ndarray, cells: int) -> list[tuple[int, float, int, int]]:
    """A kd-tree with about ``cells`` leaves as rows (axis, cut, child below, child not
    below); a negative child -c - 1 is the cell c."""
    tree: list[tuple[int, float, int, int]] = []
    made = 0

    def grow(at: np.ndarray, share: int) -> int:
        nonlocal made
        if share > 1 and len(at) > 1:
            axis, cut, low, high = halves(points, at)
            if len(low) and len(high):
                me = len(tree)
                tree.append((0, 0.0, 0, 0))
                tree[me] = (axis, cut, grow(low, share // 2), grow(high, share - share // 2))
                return me
        made += 1
        return -made

    grow(np.arange(len(points)), cells)
    return tree


def route(tree: list[tuple[int, float, int, int]], points: np.ndarray) -> np.ndarray:
    """The cell of each point."""
    if not tree:
        return np.zeros(len(points), np.int64)
    axis, cut, low, high = (np.array(c) for c in zip(*tree))
    node = np.zeros(len(points), np.int64)
    while (inner := np.flatnonzero(node >= 0)).size:
        n = node[inner]
        node[inner] = np.where(points[inner, axis[n]] < cut[n], low[n], high[n])
    return -node - 1


@dataclass
class Block:
    """The leaves of a kd-tree: runs of ``ids`` and ``vectors``, their projections and boxes."""

    ids: np.ndarray
    vectors: np.ndarray
    norms: np.ndarray
    points: np.ndarray
    starts: np.ndarray
    low: np.ndarray
    high: np.ndarray
    repeats: int  # rows of the id that has most


def build(ids: np.ndarray, vectors: np.ndarray, dims: int = DIMS, leaf: int = 0) -> Block:
    """Of ``scaled`` vectors. Splits at the median of the widest projected dimension down to leaves."""
    points = projected(vectors, dims)
    leaves, stack = [], [np.arange(len(ids))]
    while stack:
        at = stack.pop()
        if len(at) > (leaf or LEAF):
            _, _, low, high = halves(points, at)
            if len(low) and len(high):
                stack += [high, low]
                continue
        leaves.append(at)
    order = np.concatenate(leaves)
    starts = np.cumsum([0, *map(len, leaves)])
    points, vectors = np.ascontiguousarray(points[order]), np.ascontiguousarray(vectors[order])
    repeats = int(np.unique(ids, return_counts=True)[1].max())
    return Block(ids[order], vectors, np.sqrt((vectors * vectors).sum(1)), points, starts, np.minimum.reduceat(points, starts[:-1]), np.maximum.reduceat(points, starts[:-1]), repeats)


def outside(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points from boxes, a row a point."""
    out = np.zeros((len(points), len(low)))
    for k in range(points.shape[1]):
        gap = np.maximum(np.maximum(low[None, :, k] - points[:, k, None], points[:, k, None] - high[None, :, k]), 0)
        out += gap * gap
    return out


def search(block: Block, own: np.ndarray, vectors: np.ndarray, least: np.ndarray, k: int, bound: float, dims: int = DIMS) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query's place, id, cosine) of the ``k`` nearest distinct ids in the block that the
    search finds for each of the queries, whose k-th best elsewhere is ``least`` (-inf if
    there are fewer), and the number of pairs verified. ``bound`` is the chi-square
    quantile of the stopping test: a query visits leaves in order of projected distance
    until the next is farther than ``bound`` times the squared distance of its k-th best."""
    points = projected(vectors, dims)
    norms = np.sqrt((vectors * vectors).sum(1))
    away = outside(points, block.low, block.high)
    order = np.argsort(away, axis=1, kind="stable")
    rows = min(k * block.repeats, len(block.ids))  # as many rows hold k ids
    best = np.full((len(own), rows), -np.inf)
    limit = least - CLOSE
    reach = np.where(np.isfinite(limit), bound * np.maximum(0, 2 - 2 * limit) + 1e-9, np.inf)
    square, own_square = (block.points * block.points).sum(1), (points * points).sum(1)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    asking, verified = np.arange(len(own)), 0
    for turn in range(len(block.low)):
        asking = asking[away[asking, order[asking, turn]] <= reach[asking]]
        if not len(asking):
            break
        leaf = order[asking, turn]
        for x in np.unique(leaf):
            at = asking[leaf == x]
            s, e = block.starts[x], block.starts[x + 1]
            gap = own_square[at, None] + square[None, s:e] - 2 * (points[at] @ block.points[s:e].T)
            fine = (gap <= reach[at, None] + 1e-9) & (block.ids[None, s:e] != own[at, None])
            verified += int(fine.sum())
            score = (vectors[at] @ block.vectors[s:e].T) / (norms[at, None] * block.norms[None, s:e])
            score[~fine] = -np.inf
            both = np.concatenate([best[at], score], 1)
            best[at] = -np.partition(-both, rows - 1, axis=1)[:, :rows]
            limit[at] = np.maximum(limit[at], best[at].min(1) - CLOSE)
            r, c = np.nonzero(fine & (score >= limit[at, None]))
            found.append((at[r], s + c, score[r, c]))
        known = np.isfinite(limit[asking])
        reach[asking[known]] = bound * np.maximum(0, 2 - 2 * limit[asking[known]]) + 1e-9
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), verified
    of, near, score = (np.concatenate(c) for c in zip(*found))
    some = score >= limit[of]
    of, near = of[some], near[some]
    # of the same pair the same score, wherever it was met
    score = (block.vectors[near] * vectors[of]).sum(1) / (block.norms[near] * norms[of])
    ids = block.ids[near]
    order = np.lexsort((ids, -score, of))
    of, ids, score = of[order], ids[order], score[order]
    _, first = np.unique(np.stack([of, ids], 1), axis=0, return_index=True)
    first.sort()
    of, ids, score = of[first], ids[first], score[first]
    starts = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
    rank = np.arange(len(of)) - np.repeat(starts, np.diff(np.append(starts, len(of))))
    return of[rank < k], ids[rank < k], score[rank < k], verified


def _usable(vector):
    """Neither null nor zero, without null, NaN or infinite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return F.coalesce(fine, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    v = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1).astype(np.float64)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, dims: int = DIMS, sure: float = SURE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row of ``queries`` (same columns) its ``k`` nearest rows of ``vectors``
    that the search finds, without the row of its own id: ``query_id``, ``rank`` (from
    1), ``vec_id`` and ``score``, the cosine of the original vectors in double precision.
    Nearest first, ties to smaller ids; all candidates if fewer.

    Rows with a null id or vector, a zero vector, or null or non-finite components take
    no part; vectors of another length than the query's are no candidates. Rows that
    share an id are candidates each but the nearest counts once. Other columns are
    ignored; an empty table gives no rows.

    Of equal vectors only the ``k + 1`` smallest ids can ever be in a result; the others
    are left out before the index is built, so that large groups of copies cost nothing.
    The upper tree is fitted on about ``SAMPLE`` vectors (those with the smallest hashed
    ids) and has at most ``CELLS`` cells; every vector is indexed, a cell in blocks of
    about ``BLOCK``. Only the cells' boxes come to the driver."""
    spark = vectors.sparkSession
    clean = lambda df: df.select(q(id_col).cast("long").alias("id"), q(vector_col).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & _usable("v"))
    once = Window.partitionBy("h", "v").orderBy("id")  # the hash spares most comparisons of vectors
    kept = materialise(clean(vectors).distinct().withColumn("h", F.xxhash64("v")).withColumn("r", F.row_number().over(once)).filter(F.col("r") <= k + 1).select("id", "v", F.size("v").alias("width")), "vectors")
    asked = materialise(clean(queries).distinct().withColumn("width", F.size("v")), "queries")
    total = kept.count()
    share = min(1.0, SAMPLE / max(total, 1))
    chosen = kept.filter(F.pmod(F.xxhash64(F.lit("fit"), "id"), F.lit(1 << 20)) < F.lit(math.ceil(share * (1 << 20)))).select("width", "v").limit(2 * SAMPLE).collect()  # at most 2 * SAMPLE rows
    by_width: dict[int, list] = {}
    for r in chosen:
        by_width.setdefault(r["width"], []).append(r["v"])
    trees = {}
    for w, rows in by_width.items():
        points = projected(scaled(np.array(sorted(rows), np.float64)), dims)
        trees[w] = upper_tree(points, min(CELLS, -(-total * len(rows) // (len(chosen) * BLOCK))))
    shared = spark.sparkContext.broadcast(trees)
    bound = chi_square_quantile(sure, dims)

    def cells(batches):
        for batch in batches:
            width = batch.column(2).to_numpy()
            cell = np.zeros(batch.num_rows, np.int64)
            for w in np.unique(width):
                at = np.flatnonzero(width == w)
                if tree := shared.value.get(int(w)):
                    cell[at] = route(tree, projected(scaled(_matrix(batch.column(1).take(pa.array(at)))), dims))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=["id", "v", "width", "cell"])

    def index_block(table: pa.Table) -> pa.Table:
        made = build(table.column("id").to_numpy(), scaled(_matrix(table.column("v"))), dims)
        box = [pa.array([x], pa.list_(pa.float64())) for x in (made.low.min(0), made.high.max(0))]
        return pa.table([*(table.column(c).slice(0, 1) for c in ("width", "cell", "sub")), *box, pa.array([pickle.dumps(made)], pa.binary())], names=["width", "cell", "sub", "low", "high", "block"])

    dealt = materialise(kept.select("id", "v", "width").mapInArrow(cells, "id long, v array<double>, width int, cell long"), "cells")
    subs = dealt.groupBy("width", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("subs"))
    blocks = dealt.join(F.broadcast(subs), ["width", "cell"]).withColumn("sub", F.pmod(F.xxhash64("id"), F.col("subs")).cast("int")).groupBy("width", "cell", "sub").applyInArrow(index_block, "width int, cell long, sub int, low array<double>, high array<double>, block binary")
    blocks = materialise(blocks, "index")
    boxes = blocks.groupBy("width", "cell").agg(F.max("sub").alias("last"), *(F.min(F.col("low")[i]).alias(f"l{i}") for i in range(dims)), *(F.max(F.col("high")[i]).alias(f"h{i}") for i in range(dims))).collect()  # at most CELLS rows and one for each length of vectors
    places: dict[int, tuple] = {}
    for w in {r["width"] for r in boxes}:
        own = sorted((r for r in boxes if r["width"] == w), key=lambda r: r["cell"])
        places[w] = (np.array([r["cell"] for r in own]), *(np.array([[r[f"{side}{i}"] for i in range(dims)] for r in own]) for side in "lh"))
    boxes_shared = spark.sparkContext.broadcast(places)

    def visits(first: int, last: int | None):
        """The cells that a query visits in a round: of those in reach, nearest first, the places from ``first`` up to ``last``."""

        def step(batches):
            for batch in batches:
                width, least = batch.column(2).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)
                rows, cell = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for w in np.unique(width):
                    if int(w) not in boxes_shared.value:
                        continue
                    at = np.flatnonzero(width == w)
                    names, low, high = boxes_shared.value[int(w)]
                    for i in range(0, len(at), QUERIES):
                        some = at[i : i + QUERIES]
                        away = outside(projected(scaled(_matrix(batch.column(1).take(pa.array(some)))), dims), low, high)
                        reach = np.where(np.isfinite(least[some]), bound * np.maximum(0, 2 - 2 * (least[some] - CLOSE)) + 1e-9, np.inf)
                        order = np.argsort(away, axis=1, kind="stable")[:, first:last]
                        r, c = np.nonzero(np.take_along_axis(away, order, 1) <= reach[:, None])
                        rows.append(some[r]), cell.append(names[order[r, c]])
                at = np.concatenate(rows)
                yield pa.RecordBatch.from_arrays([*(batch.column(n).take(pa.array(at)) for n in (0, 1, 2, 3)), pa.array(np.concatenate(cell))], names=["id", "v", "width", "least", "cell"])

        return step

    def bundle(table: pa.Table) -> pa.Table:
        made = (table.column("id").to_numpy(), scaled(_matrix(table.column("v"))), table.column("least").to_numpy())
        return pa.table([*(table.column(c).slice(0, 1) for c in ("width", "cell")), pa.array([pickle.dumps(made)], pa.binary())], names=["width", "cell", "asked"])

    def look(batches):
        for batch in batches:
            for b, a in zip(batch.column(0), batch.column(1)):
                ids, vs, least = pickle.loads(a.as_py())
                of, near, score, _ = search(pickle.loads(b.as_py()), ids, vs, least, k, bound, dims)
                yield pa.record_batch([pa.array(ids[of], pa.int64()), pa.array(near, pa.int64()), pa.array(score, pa.float64())], names=["query_id", "vec_id", "score"])

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def ranked(found: DataFrame) -> DataFrame:
        best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    size = F.broadcast(blocks.groupBy("width", "cell").agg(F.max("sub").alias("last")))
    found, first = None, 0
    for last in [*np.cumsum(VISITS).tolist(), None]:
        if found is None:
            ready = asked.withColumn("least", F.lit(-math.inf))
        else:
            kth = found.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
            ready = asked.join(kth, "id", "left").select("id", "v", "width", F.coalesce("least", F.lit(-math.inf)).alias("least"))
        trips = materialise(ready.mapInArrow(visits(first, last), "id long, v array<double>, width int, least double, cell long"), "visits")
        loads = trips.groupBy("width", "cell").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("loads"))
        bundles = trips.join(F.broadcast(loads), ["width", "cell"]).withColumn("load", F.pmod(F.xxhash64("id"), F.col("loads"))).groupBy("width", "cell", "load").applyInArrow(bundle, "width int, cell long, asked binary")
        work = bundles.join(size, ["width", "cell"]).withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("last")))).join(blocks.select("width", "cell", "sub", "block"), ["width", "cell", "sub"])
        here = work.select("block", "asked").mapInArrow(look, "query_id long, vec_id long, score double")
        here = materialise(ranked(here if found is None else here.unionByName(found.select("query_id", "vec_id", "score"))), "found")
        discard(trips)
        if found is not None:
            discard(found)
        found, first = here, last
    for x in (kept, asked, dealt, blocks):
        discard(x)
    return found
