"""Toxicity by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lading.llm.common import discard, lean, materialise, others, q, slices, smallest_hashes

#: Labelled documents of each label at most.
SAMPLE = 2000
#: Features that the model keeps.
FEATURES = 2048
#: A document is flagged from this probability of any severity on.
FLAG = 0.5
#: Words whose features a task remembers.
_KNOWN = 300_000
_WORD = re.compile(r"\w+")


def word_features(word: str) -> list[int]:
    """Hashes of the word and of its prefixes of 4 to 6 characters."""
    return [zlib.crc32(b"w" + word.encode("utf-8", "surrogatepass")), *(zlib.crc32(b"p" + word[:n].encode("utf-8", "surrogatepass")) for n in (4, 5, 6) if len(word) > n)]


def features(text: str) -> np.ndarray:
    """Sorted distinct feature hashes of a text."""
    return np.array(sorted({f for w in set(_WORD.findall(text.lower())) for f in word_features(w)}), np.uint32)


@dataclass
class Ordinal:
    """P(grade <= k) = sigmoid(cuts[k] - x.weights): one weight vector for all ordered cuts."""

    columns: dict[int, int]  # feature hash -> place
    weights: np.ndarray
    cuts: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each cut k."""
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - score[:, None], -40, 40)))


def fit(x: np.ndarray, grade: np.ndarray, grades: int, ridge: float = 1e-4, steps: int = 400, rate: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing cuts by accelerated gradient steps on the mean negative
    log-likelihood of the cumulative-link model."""
    n, d = x.shape
    share = np.clip([(grade <= k).mean() for k in range(grades - 1)], 1e-3, 1 - 1e-3)
    first = np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(first), 1e-2))
    theta = np.concatenate([np.zeros(d), first[:1], gaps])
    momentum = np.zeros_like(theta)
    square = np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, cuts = theta[:d], np.cumsum(np.concatenate([theta[d : d + 1], np.exp(theta[d + 1 :])]))
        z = 1 / (1 + np.exp(np.clip(-(cuts[None, :] - (x @ w.astype(x.dtype))[:, None]), -40, 40)))
        full = np.concatenate([np.zeros((n, 1)), z, np.ones((n, 1))], 1)
        p = np.maximum(full[np.arange(n), grade + 1] - full[np.arange(n), grade], 1e-9)
        slope = np.concatenate([np.zeros((n, 1)), z * (1 - z), np.zeros((n, 1))], 1)
        up, low = slope[np.arange(n), grade + 1] / p, slope[np.arange(n), grade] / p
        by_cut = np.zeros((n, grades + 1))
        by_cut[np.arange(n), grade + 1] -= up
        by_cut[np.arange(n), grade] += low
        cut = by_cut[:, 1:grades].mean(0)
        tail = np.cumsum(cut[::-1])[::-1]
        g = np.concatenate([(up - low).astype(x.dtype) @ x / n + ridge * w, tail[:1], tail[1:] * np.exp(theta[d + 1 :])])
        momentum = 0.9 * momentum + 0.1 * g
        square = 0.99 * square + 0.01 * g * g
        theta = theta - rate * 0.1 * (momentum / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8) * (1 - step / (steps + 1))
    return theta[:d], np.cumsum(np.concatenate([theta[d : d + 1], np.exp(theta[d + 1 :])]))


def train(rows: Iterable[tuple[np.ndarray, int]], keep: int = FEATURES) -> Ordinal:
    """An ordinal model of (feature hashes, grade) rows; of the features, the ``keep``
    with the largest chi-square against any severity at all stay."""
    rows = list(rows)
    grade = np.array([g for _, g in rows], int)
    if not len(rows) or grade.max() == grade.min():
        return Ordinal({}, np.zeros(0), np.full(1, 40.0))
    flat = np.concatenate([f for f, _ in rows])
    names, column = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(len(rows)), [len(f) for f, _ in rows])
    bad = grade > grade.min()
    hit = np.bincount(column, weights=bad[owner], minlength=len(names))
    seen = np.bincount(column, minlength=len(names))
    n, b = len(rows), bad.sum()
    expected = seen * b / n
    chi = (hit - expected) ** 2 / np.maximum(expected * (1 - b / n) * (1 - seen / n), 1e-9)
    chi[(seen < 3) | (seen > 0.9 * n)] = 0
    best = np.argsort(-chi, kind="stable")[:keep]
    best = best[chi[best] > 0]
    place = np.full(len(names), -1)
    place[best] = np.arange(len(best))
    x = np.zeros((n, len(best)), np.float32)
    used = place[column] >= 0
    x[owner[used], place[column][used]] = 1
    weights, cuts = fit(x, grade, int(grade.max()) + 1)
    return Ordinal({int(names[c]): k for k, c in enumerate(best)}, weights, cuts)


def train_on_labels(docs: DataFrame, labels: DataFrame, grade: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Ordinal:
    """A model of at most ``sample`` documents of each grade, those with the smallest
    hashed id. ``grade`` is a column of ordered whole numbers, 0 for harmless; the grades
    that occur are learnt in their order. Null grades and ids take no part; of a
    document's several labels the largest counts, and of rows that share an id one. Their
    feature hashes come to the driver, not their texts."""
    known = labels.filter(q(grade).isNotNull() & q(id_col).isNotNull()).groupBy(q(id_col).alias("id")).agg(F.max(q(grade)).cast("int").alias("y"))
    chosen = materialise(smallest_hashes(known, "id", "y", sample), "sample")  # at most sample rows a grade
    rows = docs.select(q(id_col).alias("id"), q(text_col).alias("text")).join(F.broadcast(chosen), "id")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            fresh = [k for k, i in enumerate(ids) if not (i in seen or seen.add(i))]  # no more than were chosen
            some = batch.take(pa.array(fresh, pa.int64()))
            yield pa.record_batch([some.column(0), some.column(2), pa.array([features(t or "").tobytes() for few in slices(some) for t in few.column(1).to_pylist()], pa.binary())], names=["id", "y", "f"])

    kind = dict(rows.dtypes)["id"]
    found = rows.select("id", "text", "y").mapInArrow(hashed, f"id {kind}, y int, f binary")
    found = found.groupBy("id", "y").agg(F.min("f").alias("f")).collect()  # a row an id
    discard(chosen)
    found.sort(key=lambda r: (r["y"], str(r["id"])))
    order = {y: k for k, y in enumerate(sorted({r["y"] for r in found}))}
    return train([(np.frombuffer(bytes(r["f"]), np.uint32), order[r["y"]]) for r in found])


def score_toxicity(docs: DataFrame, model: Ordinal, flag: float = FLAG, text_col: str = "text") -> DataFrame:
    """``docs`` with ``severity`` (the expected grade), ``p_toxic`` (probability of a
    grade above 0), ``grade`` (the median: as many as there are thresholds passed with
    probability ``flag``) and ``toxic`` (``p_toxic >= flag``, a grade above 0) after
    its columns, read from whole texts. A null or empty text has no features and gets
    what the cuts alone say. Other columns stay; ones named like the four are replaced.
    An untrained model finds nothing toxic. An empty table gives an empty table."""
    names = others(docs, "severity", "p_toxic", "grade", "toxic")
    whole = docs.select(*(q(c) for c in names))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = names.index(text_col)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        known: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            total = np.zeros(batch.num_rows)
            for k, text in enumerate(t for few in slices(batch) for t in few.column(at).to_pylist()):
                found: set[int] = set()
                for w in set(_WORD.findall((text or "").lower())):
                    if (f := known.get(w)) is None:
                        f = known[w] = tuple(c for h in word_features(w) if (c := m.columns.get(h)) is not None)
                    if f:
                        found.update(f)
                total[k] = m.weights[sorted(found)].sum() if found else 0.0
                if len(known) > _KNOWN:
                    known.clear()
            above = m.above(total)
            new = [pa.array(above.sum(1)), pa.array(above[:, 0].copy()), pa.array((above >= flag).sum(1).astype(np.int32)), pa.array(above[:, 0] >= flag)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*names, "severity", "p_toxic", "grade", "toxic"])

    more = [T.StructField("severity", T.DoubleType()), T.StructField("p_toxic", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("toxic", T.BooleanType())]
    return whole.mapInArrow(lean(scored), T.StructType([*whole.schema.fields, *more]))
