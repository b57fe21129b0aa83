"""N-gram Jaccard join: exact similarity join of whole texts on their sets of
n-word shingles, reported as connected components."""

from __future__ import annotations

import struct
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lading.llm.common import hot_join, lean, materialise, mix, parts, q, row_shingles
from lading.llm.similarity import BLOBS, RECORD, linked_components, packed

#: Cells of each of the two rows of the frequency sketch (4 bytes each).
CELLS = 1 << 20
#: The sketch travels in slices of so many cells.
SLICE = 1 << 16
_SEEDS = (np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E6C63D0876A9A47))
#: Prefix records that a bucket should hold.
BUCKET_RECORDS = 250_000
#: Sets remembered as seen in a task.
_SEEN = 200_000


def _cells(h: np.ndarray) -> list[np.ndarray]:
    return [(mix(h ^ s) >> np.uint64(44)).astype(np.int64) for s in _SEEDS]


def _digest(h: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of shingles."""
    return int(mix(h ^ _SEEDS[0]).sum(dtype=np.uint64)), int(mix(h ^ _SEEDS[1]).sum(dtype=np.uint64))


def _profile(batches, n: int):
    """Each row's shingle count and set digest; and the task's frequency sketch."""
    counts = np.zeros((len(_SEEDS), CELLS), np.uint32)
    for batch in batches:
        size, digest = [], []
        for h in row_shingles(batch.column(1), n):
            for row, at in zip(counts, _cells(h)):
                np.add.at(row, at, 1)
            size.append(len(h))
            digest.append(_digest(h))
        d = np.array(digest, np.uint64).reshape(-1, 2).view(np.int64)
        yield _row(batch.column(0), size, d, [None] * len(size), [None] * len(size))
    blobs = [zlib.compress(counts[k, i : i + SLICE].tobytes(), 1) for k in range(len(_SEEDS)) for i in range(0, CELLS, SLICE)]
    none = [None] * len(blobs)
    yield _row(pa.array(none, pa.int64()), none, None, list(range(len(blobs))), blobs)


def _row(ids, size, digest, at, blobs):
    n = len(blobs)
    d = [pa.nulls(n, pa.int64())] * 2 if digest is None else [pa.array(digest[:, k].copy(), pa.int64()) for k in (0, 1)]
    return pa.record_batch([ids, pa.array(size, pa.int64()), *d, pa.array(at, pa.int32()), pa.array(blobs, pa.binary())], names=["id", "n", "d1", "d2", "slot", "blob"])


def _summed(table: pa.Table) -> pa.Table:
    total = np.zeros(SLICE, np.uint64)
    for x in table.column("blob"):
        total += np.frombuffer(zlib.decompress(x.as_py()), np.uint32)
    return pa.table([table.column("slot").slice(0, 1), pa.array([np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())], names=["slot", "blob"])


def overlap(nx, ny, num: int, den: int):
    """The least intersection of sets of these sizes with ``den * i >= num * union``."""
    return -((-num * (nx + ny)) // (num + den))


def suffix_summary(h: np.ndarray) -> int:
    """How many shingles lie in each eighth of the order of hashes, at most 255, a byte each."""
    counts = np.bincount((h >> np.uint64(61)).astype(np.int64), minlength=8)
    return int(np.minimum(counts, 255).astype(np.uint8).view("<u8")[0])


def _admit(nx, px, sx, ny, py, sy, num: int, den: int):
    """Length, positional and suffix filter. What precedes the first common shingle is
    not common, so the overlap is at most what is left of either set. Parted at fixed
    pivots, sets differ by at least the sum of the differences of their parts' sizes."""
    nx, px, ny, py = (np.asarray(v).astype(np.int64) for v in (nx, px, ny, py))
    need = overlap(nx, ny, num, den)
    ok = (den * np.minimum(nx, ny) >= num * np.maximum(nx, ny)) & (np.minimum(nx - px, ny - py) >= need)
    if ok.any():
        sx, sy = np.asarray(sx).astype(np.uint64), np.asarray(sy).astype(np.uint64)
        differ = sum(np.abs((sx >> np.uint64(k) & np.uint64(255)).astype(np.int16) - (sy >> np.uint64(k) & np.uint64(255)).astype(np.int16)).astype(np.int64) for k in range(0, 64, 8))
        ok = ok & (2 * need <= nx + ny - differ)
    return ok


def _linked(nx: int, ny: int, common: int, num: int, den: int) -> bool:
    return common > 0 and den * common >= num * (nx + ny - common)


def _features(text: str, n: int) -> np.ndarray:
    return next(row_shingles(pa.array([text], pa.string()), n))


def ngram_join(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: the id, ``n_shingles`` (size of its set of
    ``n``-word shingles, A-Z folded, words parted by space and \\t-\\r) and
    ``component_id``: the smallest id reachable by links, itself included. Two texts
    link when ``den * intersection >= num * union``.

    A text of fewer than ``n`` words is one shingle, its whole sequence. Null and
    wordless texts have no shingles and link with nothing. A null id gets a null
    component; rows that share an id are one document with the links of all of them.
    Other columns are ignored; an empty table gives no rows. Shingles are compared by
    64-bit hashes.

    Shingles are ordered rare-first by a frequency sketch of all documents (two rows
    of counters of fixed size; any total order gives right results, the sketch only
    makes it selective). A set's prefix is what must hold a common shingle with each
    partner. Prefix shingles meet in buckets; length, positional and suffix filters thin
    the pairs, a pair is verified once on whole sets, and groups of similar texts are
    resolved without expanding them into all pairs (see ``similarity``). Of the copies of
    a set in a task one emits its prefix; copies are linked by their 128-bit digest."""
    spark = docs.sparkSession
    rows = docs.select(q(id_col).cast("long").alias("id"), q(text_col).cast("string").alias("text"))
    profile = materialise(rows.mapInArrow(lean(partial(_profile, n=n)), "id long, n long, d1 long, d2 long, slot int, blob binary"), "profile")
    sketch = np.zeros(len(_SEEDS) * CELLS, np.uint32)
    for x in profile.filter("slot is not null").select("slot", "blob").groupBy("slot").applyInArrow(_summed, "slot int, blob binary").collect():  # fixed size
        sketch[x["slot"] * SLICE : (x["slot"] + 1) * SLICE] = np.frombuffer(bytes(x["blob"]), np.uint32)
    known = profile.filter("slot is null").select("id", "n", "d1", "d2")
    total = known.agg(F.sum("n")).first()[0] or 0
    buckets = max(parts(spark), int(total * (den - num) / den / BUCKET_RECORDS))
    shared = spark.sparkContext.broadcast(sketch.reshape(len(_SEEDS), CELLS))

    def prefixes(batches):
        def found():
            seen: set[bytes] = set()
            for batch in batches:
                if len(seen) > _SEEN:
                    seen = set()
                for d, h in zip(batch.column(0).to_pylist(), row_shingles(batch.column(1), n)):
                    size = len(h)
                    if not size or d is None or (key := struct.pack("<QQI", *_digest(h), size & 0xFFFFFFFF)) in seen:
                        continue  # a copy, linked by its digest, stands for this row
                    seen.add(key)
                    freq = np.minimum(*(row[at] for row, at in zip(shared.value, _cells(h))))
                    length = size - -((-num * size) // den) + 1
                    order = np.lexsort((h, freq))[:length]
                    r = np.empty(len(order), RECORD)
                    r["t"], r["d"], r["n"], r["p"] = h[order], d, size, np.arange(len(order))
                    r["s"] = suffix_summary(h)
                    yield r

        yield from packed(found(), buckets)

    # copies: same set, so linked whatever the threshold
    same = known.filter("n > 0 and id is not null").groupBy("d1", "d2", "n").agg(F.min("id").alias("a"), F.count("*").alias("k")).filter("k > 1")
    copies = hot_join(known, materialise(same, "same"), ["d1", "d2", "n"], "k").filter("id <> a").select("a", F.col("id").alias("b"))
    blobs = rows.mapInArrow(lean(prefixes), BLOBS)
    found = linked_components(blobs, rows, partial(_features, n=n), partial(_linked, num=num, den=den), partial(_admit, num=num, den=den), copies)
    out = known.join(found.withColumnRenamed("node", "id"), "id", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
