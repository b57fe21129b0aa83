"""Language identification by a string kernel: presence of blended-spectrum n-grams,
Nyström landmarks, one-versus-rest kernel ridge regression."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lading.llm.common import discard, lean, materialise, others, q, slices, smallest_hashes

#: Hashed n-gram bins.
BINS = 1 << 14
#: Training documents of each language at most.
SAMPLE = 400
#: Landmarks of each language at most.
LANDMARKS = 24
RIDGE = 1e-2
UNKNOWN = "und"
#: Texts scored by one matrix product.
ROWS = 128
#: Characters hashed at once.
PIECE = 1 << 18


def presence(text: str, longest: int) -> np.ndarray:
    """Which bins hold an n-gram of 1 to ``longest`` characters of ``text`` (lower case)."""
    out = np.zeros(BINS, bool)
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    for i in range(0, len(c), PIECE):
        piece = c[i : i + PIECE + longest - 1]
        h = np.zeros(len(piece), np.uint64)
        for n in range(1, longest + 1):
            if len(piece) < n:
                break
            h = h[: len(piece) - n + 1] * np.uint64(0x100000001B3) + piece[n - 1 :] + np.uint64(n)
            out[(h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50)] = True
    return out


@dataclass
class Kernel:
    """A trained classifier; its size is fixed by its parameters."""

    languages: list[str]
    landmarks: np.ndarray  # landmarks x BINS, rows of norm 1
    weights: np.ndarray  # landmarks x languages
    longest: int

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return similarity(rows, self.landmarks) @ self.weights


def similarity(rows: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Normalised presence kernel: common bins over the root of both counts."""
    x = rows.astype(np.float32)
    return (x @ landmarks.T) / np.maximum(np.sqrt(x.sum(1)), 1)[:, None]


def fit(labels: list[str], rows: np.ndarray, longest: int, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Kernel:
    """Ridge regression of +1/-1 targets on the Nyström map of the landmarks (the first rows of each language)."""
    languages = sorted(set(labels))
    at = np.array([languages.index(x) for x in labels])
    chosen = np.concatenate([np.flatnonzero(at == k)[:landmarks] for k in range(len(languages))])
    marks = rows[chosen].astype(np.float32)
    marks /= np.maximum(np.sqrt(marks.sum(1)), 1)[:, None]
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    mapped = similarity(rows, marks).astype(np.float64) @ root
    counts = np.bincount(at, minlength=len(languages))
    weight = (len(at) / (len(languages) * counts))[at]
    target = np.where(at[:, None] == np.arange(len(languages)), 1.0, -1.0)
    gram = mapped.T @ (mapped * weight[:, None]) + ridge * len(at) * np.eye(mapped.shape[1])
    beta = np.linalg.solve(gram, mapped.T @ (target * weight[:, None]))
    return Kernel(languages, marks, (root @ beta).astype(np.float32), longest)


def train(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, longest: int = 3) -> Kernel:
    """A classifier learnt from at most ``sample`` documents of each language, those
    whose hashed id is smallest; null languages and texts take no part, and of rows that
    share an id and a language one does. Only their packed n-gram bins come to the driver."""
    known = docs.filter(q(lang_col).isNotNull() & q(text_col).isNotNull()).select(q(id_col).alias("id"), q(lang_col).cast("string").alias("lang")).distinct()
    chosen = materialise(smallest_hashes(known, "id", "lang", sample), "sample")  # at most sample rows a language
    rows = docs.select(q(id_col).alias("id"), q(lang_col).cast("string").alias("lang"), q(text_col).alias("text")).filter("text is not null").join(F.broadcast(chosen), ["id", "lang"], "left_semi")

    def bins(batches):
        seen: set = set()
        for batch in batches:
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            fresh = [k for k, key in enumerate(keys) if not (key in seen or seen.add(key))]  # no more than were chosen
            some = batch.take(pa.array(fresh, pa.int64()))
            packed = [np.packbits(presence(t or "", longest)).tobytes() for few in slices(some) for t in few.column(2).to_pylist()]
            yield pa.record_batch([some.column(0), some.column(1), pa.array(packed, pa.binary())], names=["id", "lang", "bins"])

    kind = dict(rows.dtypes)["id"]
    found = rows.mapInArrow(lean(bins), f"id {kind}, lang string, bins binary").groupBy("id", "lang").agg(F.min("bins").alias("bins")).collect()  # a row for each that was chosen
    discard(chosen)
    if not found:
        return Kernel([], np.zeros((0, BINS), np.float32), np.zeros((0, 0), np.float32), longest)
    found.sort(key=lambda r: (r["lang"], zlib.crc32(str(r["id"]).encode()), str(r["id"])))
    return fit([r["lang"] for r in found], np.stack([np.unpackbits(np.frombuffer(bytes(r["bins"]), np.uint8)).astype(bool) for r in found]), longest)


def classify(docs: DataFrame, kernel: Kernel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` after its columns, read from the text
    alone. ``score`` is the softmax of the one-versus-rest scores at the winner. A text
    that is null or has no letter is ``und`` with score 0, as is every text if nothing
    was learnt; equal scores go to the first language by name. Other columns stay; ones
    named like the two are replaced. An empty table gives an empty table."""
    names = others(docs, "lang_pred", "score")
    whole = docs.select(*(q(c) for c in names))
    shared = docs.sparkSession.sparkContext.broadcast(kernel)
    at = names.index(text_col)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            langs, scores = [], []
            texts = batch.column(at)
            for i in range(0, batch.num_rows, ROWS):
                some = texts.slice(i, ROWS).to_pylist()
                fine = [k for k, t in enumerate(some) if model.languages and t and any(map(str.isalpha, t))]
                lang, score = [UNKNOWN] * len(some), [0.0] * len(some)
                if fine:
                    s = model.scores(np.stack([presence(some[k], model.longest) for k in fine])).astype(np.float64)
                    best = s.argmax(1)
                    e = np.exp(4 * (s - s.max(1, keepdims=True)))
                    for k, b, p in zip(fine, best, 1 / e.sum(1)):
                        lang[k], score[k] = model.languages[b], float(p)
                langs += lang
                scores += score
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"])

    from pyspark.sql import types as T

    schema = T.StructType([*whole.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return whole.mapInArrow(lean(label), schema)


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(q(id_col).cast("string")) % 5 == 0, F.lit(False))
