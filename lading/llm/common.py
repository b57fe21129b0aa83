"""Helpers shared by the training-data operators: the shared folder, tables that
cut lineage, bounded samples, and vectorised hashing of Arrow text columns."""

from __future__ import annotations

import ctypes
import tempfile
import threading
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Everything that separates the words of the positional operators (ASCII apart from letters and digits).
WORD_GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: The same for text whose capitals aren't folded yet.
CASED_GAP = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"

_SETTING = "spark.checkpoint.dir"
_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a
    local master gets a temporary folder; on a cluster that is an error."""
    base = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_SETTING} to a folder that all executors share")
    return _own_folder.setdefault("path", "file://" + tempfile.mkdtemp(prefix="lading-"))


_made = threading.local()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back: lineage ends
    there, and a lost executor costs no recomputation. Tables lie in a folder of the
    application's own; :func:`discard`, :class:`Scratch` and :func:`sweep` delete them."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lading/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._lading_path = path
    for kept in getattr(_made, "lists", []):
        kept.append(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`materialise` that nothing reads any more."""
    path = getattr(df, "_lading_path", None)
    if path:
        _delete(df.sparkSession, path)


def sweep(spark: SparkSession) -> None:
    """Delete all tables that this application has made: for its end, once its results are written elsewhere."""
    _delete(spark, f"{shared_folder(spark)}/lading/{spark.sparkContext.applicationId}")


class Scratch:
    """``with Scratch(spark) as scratch:`` the tables that this thread makes inside are
    deleted at the end, apart from those that were kept by ``scratch.keep(table)``."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.kept = spark, [], set()

    def keep(self, table: DataFrame) -> DataFrame:
        self.kept.add(table._lading_path)
        return table

    def __enter__(self) -> Scratch:
        _made.lists = [*getattr(_made, "lists", []), self.paths]
        return self

    def __exit__(self, *fault) -> None:
        _made.lists = [x for x in _made.lists if x is not self.paths]
        for path in self.paths:
            if path not in self.kept:
                _delete(self.spark, path)


def q(name: str):
    """The column of exactly this name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def others(df: DataFrame, *taken: str) -> list[str]:
    """``df``'s columns apart from those that an operator's own columns replace."""
    return [c for c in df.columns if c.lower() not in {t.lower() for t in taken}]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lowered(col):
    """``col`` with A-Z, and only those, in lower case; null counts as empty."""
    return F.translate(F.coalesce(col, F.lit("")), UPPER, LOWER)


def word_array(col):
    """The lower-cased words of ``col`` in order; none for null or empty text."""
    return F.array_remove(F.split(lowered(col), WORD_GAP), "")


#: Of a group's rows so many times as many as are wanted go to its window.
SPARE = 4


def place_of(key):
    """Where a key's hash lies between 0 and 1."""
    return F.shiftrightunsigned(F.xxhash64(key), 11) / float(1 << 53)


def smallest_hashes(df: DataFrame, key: str, group: str, bound: int) -> DataFrame:
    """At most ``bound`` rows of each ``group``, those whose ``key`` is hashed to the
    smallest places; keys should be distinct in a group, groups not null and few. Of a
    group of n rows only those hashed below ``SPARE * bound / n`` are shuffled: about
    ``SPARE * bound`` rows, among which fewer than ``bound`` never are by chance."""
    sizes = df.groupBy(group).agg(F.count("*").alias("_n"))
    some = df.join(F.broadcast(sizes), group).filter(place_of(F.col(key)) * F.col("_n") <= SPARE * bound).drop("_n")
    w = Window.partitionBy(group).orderBy(place_of(F.col(key)), F.col(key))
    return some.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= bound).drop("_rank")


def hot_join(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, most: int = 50_000) -> DataFrame:
    """Inner join of ``rows`` with ``groups`` (one row a key) on ``keys``, where ``size``
    counts each key's ``rows``. The largest groups, at most ``most`` as their sizes add up
    to no more than all rows, are broadcast; the others are joined by hash."""
    limit = max(1000, (groups.agg(F.sum(size)).first()[0] or 0) // most)
    heavy = groups.filter(F.col(size) > limit)
    rest = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(heavy), keys).unionByName(rest.join(groups.filter(F.col(size) <= limit), keys))


# --- hashing of Arrow string columns -----------------------------------------

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_BASE = np.uint64(0x100000001B3)
_fold = np.arange(256, dtype=np.uint64)
_fold[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x + _M1
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the offsets of each row; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    if not len(column):
        offsets = np.zeros(1, np.int64)
    return data, offsets


def raw_texts(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each row, without the way over strings, one at a time; null rows are empty."""
    data, offsets = text_buffers(column)
    whole = memoryview(data)
    a = int(offsets[0])
    for b in offsets[1:].tolist():
        yield whole[a:b].tobytes()
        a = b


def _release() -> None:
    """Give back to the system what this worker holds but doesn't use; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(step):
    """A step of ``mapInArrow`` whose worker keeps no unused memory."""

    def over_batches(batches):
        try:
            yield from step(batches)
        finally:
            _release()

    return over_batches


def lean_group(step):
    """The same of a step over one table."""

    def over_table(table):
        try:
            return step(table)
        finally:
            _release()

    return over_table


def lean_pair(step):
    """The same of a step over two tables."""

    def over_tables(left, right):
        try:
            return step(left, right)
        finally:
            _release()

    return over_tables


#: Rows of a batch that are Python objects at once.
FEW_ROWS = 256


def slices(batch: pa.RecordBatch, rows: int = FEW_ROWS) -> Iterator[pa.RecordBatch]:
    """The batch in small parts, so that no more of it than one part is held twice."""
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def spans(offsets: np.ndarray, most: int = 1 << 20):
    """Ranges of rows with about ``most`` bytes each, so that temporaries stay small."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_gap_space = np.zeros(256, bool)
_gap_space[[0x20, *range(0x09, 0x0E)]] = True


def word_hashes(data: np.ndarray, offsets: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs of other than space and \\t-\\r, A-Z folded)
    of rows i..j, and the offsets of each row's words among them."""
    lo, hi = int(offsets[i]), int(offsets[j])
    b = data[lo:hi]
    starts_at = offsets[i:j] - lo
    if not len(b):
        return np.zeros(0, np.uint64), np.zeros(j - i + 1, np.int64)
    word = ~_gap_space[b]
    before = np.empty_like(word)
    before[0] = False
    before[1:] = word[:-1]
    inside = starts_at[starts_at < len(b)]
    before[inside] = False
    starts = np.flatnonzero(word & ~before)
    counts = np.searchsorted(starts, np.append(starts_at, len(b)))
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    place = np.arange(len(b), dtype=np.int64)
    lengths = np.diff(np.append(starts, len(b)))
    place[: starts[0]] = 0
    place[starts[0] :] -= np.repeat(starts, lengths)
    powers = np.full(int(lengths.max()) + int(starts[0]) + 1, _BASE, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    value = (_fold[b] + np.uint64(1)) * powers[place]
    value[~word] = 0
    return mix(np.add.reduceat(value, starts)), counts


def shingles(words: np.ndarray, counts: np.ndarray, n: int) -> list[np.ndarray]:
    """Each row's sorted distinct hashes of ``n`` consecutive words; with fewer
    words the whole sequence is one; without words there is none."""
    if len(words) >= n:
        acc = np.zeros(len(words) - n + 1, np.uint64)
        for k in range(n):
            acc = (acc + words[k : len(words) - n + 1 + k]) * (_M2 + np.uint64(2 * k)) + np.uint64(k + 1)
        acc = mix(acc)
    else:
        acc = np.zeros(0, np.uint64)
    out = []
    for s, e in zip(counts[:-1].tolist(), counts[1:].tolist()):
        if e - s >= n:
            out.append(np.unique(acc[s : e - n + 1]))
        elif e > s:
            h = np.uint64(e - s)
            with np.errstate(over="ignore"):
                for w in words[s:e]:
                    h = h * _M3 + w
            out.append(mix(np.array([h], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def row_shingles(column, n: int):
    """Yields each row's sorted distinct word-shingle hashes, in order."""
    data, offsets = text_buffers(column)
    for i, j in spans(offsets):
        yield from shingles(*word_hashes(data, offsets, i, j), n)


def char_shingles(text: str, k: int) -> np.ndarray:
    """Hashes (not distinct, 64 bits) of the ``k``-character shingles of ``text``;
    a shorter text is one shingle."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(c) < k:
        c = np.append(c, np.zeros(k - len(c), np.uint64))
    h, width, r = c + np.uint64(1), 1, int(_BASE)
    while width * 2 <= k:
        h = h[:-width] * np.uint64(r) + h[width:]
        r, width = r * r % 2**64, width * 2
    if width < k:
        h = h[: len(h) - (k - width)] * np.uint64(r) + h[k - width :]
    return mix(h)


def sorted_distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.append(True, h[1:] != h[:-1])] if len(h) else h
