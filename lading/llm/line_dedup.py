"""Fuzzy line deduplication over all documents by MinHash."""

from __future__ import annotations

import hashlib
import struct
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lading.llm.common import LOWER, UPPER, char_shingles, free_name, hot_join, lean, materialise, mix, others, parts, q, raw_texts, slices, sorted_distinct
from lading.llm.similarity import BLOBS, linked_components, packed

#: key, line, and the number of its distinct shingles, as far as it goes
_LINE = np.dtype([("t", "<u8"), ("d", "<i8"), ("n", "<u2")])
_FOLD = bytes.maketrans(UPPER.encode() + b"\t\r\v\f", LOWER.encode() + b"    ")
#: Characters in a shingle of the registered queries.
SHINGLE = 5
#: Bands, and minima in each, of the registered queries. Half as many bands hold each minimum once; the others hold them again in another order.
BANDS, ROWS = 36, 6
#: Bytes of lines hashed at once.
_CHUNK = 1 << 17
#: Lines that are held at once.
_LINES = 4096
#: Rounds in which each shingle picks one bin, before bins that are still empty ask all shingles.
_ROUNDS = 16
#: Records that a bucket should hold.
_BUCKET = 500_000
#: Lines remembered as seen in a task.
_SEEN = 250_000
_NONE = np.uint32(2**32 - 1)
#: Ids up to this many go to the tasks that fetch lines (8 bytes each); more are joined.
FEW_IDS = 1_000_000


def normals(text: bytes) -> list[bytes]:
    """The lines of a text as they are compared: A-Z folded, runs of ASCII white space one blank, ends trimmed."""
    out = []
    for line in text.translate(_FOLD).split(b"\n"):
        line = line.strip()
        out.append(b" ".join(line.split()) if b"  " in line else line)
    return out


_PAIR = struct.Struct("<qq").unpack


def _digests(line: bytes) -> tuple[int, int]:
    """128 bits that tell equal lines; the bands know a line by the first half."""
    return _PAIR(hashlib.blake2b(line, digest_size=16).digest())


def _places(batches):
    """A row for each line that isn't blank: document, text hash, line number, digests."""
    for batch in batches:
        counts, numbers, lines = [], [], []
        for text in raw_texts(batch.column(2)):
            before = len(lines)
            for k, line in enumerate(normals(text)):
                if line:
                    numbers.append(k)
                    lines.append(_digests(line))
            counts.append(len(lines) - before)
        at = pa.array(np.repeat(np.arange(len(counts)), counts))
        yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), pa.array(numbers, pa.int32()), pa.array([d for d, _ in lines], pa.int64()), pa.array([e for _, e in lines], pa.int64())], names=["id", "th", "line", "d", "e"])


def _distinct(batches):
    """(digest, normal line) for the lines of a partition, most repeats left out, some at a time."""
    seen: set[int] = set()
    out = []
    for batch in batches:
        for text in raw_texts(batch.column(batch.num_columns - 1)):
            for line in normals(text):
                if line and (d := _digests(line)[0]) not in seen:
                    seen.add(d)
                    out.append((d, line))
            if len(out) >= _LINES:
                yield out
                out = []
        if len(seen) > _SEEN:
            seen = set()
    yield out


def _line_texts(batches):
    for out in _distinct(batches):
        yield pa.record_batch([pa.array([d for d, _ in out], pa.int64()), pa.array([x.decode("utf-8", "replace") for _, x in out], pa.string())], names=["id", "text"])


_BOTH = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("line", pa.int32()), ("d", pa.int64()), ("e", pa.int64()), ("text", pa.string())])


def _places_and_texts(batches, wanted):
    """Rows as of :func:`_places`; the first one in a task of a line that ``wanted`` (sorted) names has its normal form too."""
    known, seen = wanted.value, set()
    for batch in (few for whole in batches for few in slices(whole, 1024)):
        counts, numbers, lines, plain = [], [], [], []
        for text in raw_texts(batch.column(2)):
            before = len(lines)
            for k, line in enumerate(normals(text)):
                if line:
                    numbers.append(k)
                    lines.append(_digests(line))
                    plain.append(line)
            counts.append(len(lines) - before)
        at = pa.array(np.repeat(np.arange(len(counts)), counts))
        both = np.array(lines, np.int64).reshape(-1, 2)
        texts: list[str | None] = [None] * len(lines)
        if len(known) and len(lines):
            d = both[:, 0]
            for k in np.flatnonzero(known[np.minimum(np.searchsorted(known, d), len(known) - 1)] == d).tolist():
                if lines[k][0] not in seen:
                    seen.add(lines[k][0])
                    texts[k] = plain[k].decode("utf-8", "replace")
        columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(numbers, pa.int32()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], schema=_BOTH)


def _scramble(h: np.ndarray, seed: int) -> np.ndarray:
    """A hash of 32-bit hashes, another one for each ``seed``."""
    x = (h ^ np.uint32(seed * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0x27D4EB2F)
    x ^= x >> np.uint32(16)
    return x


def _rehash(h: np.ndarray, seed: int) -> np.ndarray:
    """The same, in fewer steps, of hashes that are scrambled already."""
    x = h ^ np.uint32((seed + 1) * 0x9E3779B1 & 0xFFFFFFFF)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0xC2B2AE35)
    return x


def _chunk_shingles(lines: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes (32 bits) of the ``k``-character shingles of each line, sorted by line, their lines, and how many are distinct in each."""
    padded = [x.decode("utf-8", "replace").ljust(k, "\0") for x in lines]
    lengths = np.array([len(x) for x in padded])
    c = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    h, width, r = c * np.uint32(0x9E3779B1), 1, 0x01000193
    while width < k:  # the window doubles, the last step overlaps
        step = min(width, k - width)
        h = h[:-step] * np.uint32(r) + h[step:]
        width, r = width + step, r * r % 2**32
    ends = np.cumsum(lengths)
    starts = ends - lengths
    for over in range(1, k):  # instead of the shingles that run over a line's end its last one stands again
        h[ends[:-1] - over] = h[ends[:-1] - k]
    lengths[-1] -= k - 1
    both = np.repeat(np.arange(len(lines), dtype=np.uint64) << np.uint64(32), lengths)
    both |= _scramble(h, 0)
    both.sort()
    new = np.ones(len(both), bool)
    np.not_equal(both[1:], both[:-1], out=new[1:])
    distinct = np.add.reduceat(new, starts, dtype=np.int64)
    h = both.astype(np.uint32)
    both >>= np.uint64(32)
    return h, both.view(np.int64), distinct


def signatures(lines: list[bytes], k: int, bins: int, sizes: np.ndarray | None = None) -> np.ndarray:
    """MinHash signatures (a row a line) of the ``k``-character shingles of ``lines``: two
    lines agree in each bin with the probability of their Jaccard similarity, however
    short they are. In each of some rounds every shingle throws a hash into a bin that
    the round picks for it; what an earlier round threw wins, then the smaller hash.
    Lines whose bins are all taken are done. Bins that stay empty take the smallest of
    the hashes, a new one for each bin, of all shingles of their line. ``sizes`` takes
    the numbers of distinct shingles."""
    out = np.empty((len(lines), bins), np.uint32)
    order = sorted(range(len(lines)), key=lambda n: len(lines[n]))  # lines of like length take as many rounds
    i = 0
    while i < len(order):
        j, size = i, 0
        while j < len(order) and (j == i or size + len(lines[order[j]]) <= _CHUNK):
            size += max(len(lines[order[j]]), k)
            j += 1
        slots = np.full((j - i) * bins, _NONE, np.uint32)
        here = slots.reshape(j - i, bins)
        h, owner, distinct = _chunk_shingles([lines[n] for n in order[i:j]], k)
        if sizes is not None:
            sizes[order[i:j]] = distinct
        base, wanting = owner * bins, np.arange(j - i)
        count = np.bincount(owner, minlength=j - i)  # of the lines in ``wanting``
        for n in range(_ROUNDS):
            x = _rehash(h, n) * np.uint64(bins)  # the bin, and the place in it as a fraction
            value = x.astype(np.uint32)
            value >>= np.uint32(5)
            value |= np.uint32(n << 27)
            x >>= np.uint64(32)
            place = x.view(np.int64)
            place += base
            np.minimum.at(slots, place, value)
            left = here[wanting].max(1) == _NONE
            if not left.all():
                more = np.repeat(left, count)
                h, base, count, wanting = h[more], base[more], count[left], wanting[left]
                if not len(wanting):
                    break
        some, at = np.nonzero(here[wanting] == _NONE)
        line, begins = wanting[some], np.cumsum(count) - count
        for s in range(0, len(line), 50_000):
            bin_ = at[s : s + 50_000]
            each_count = count[some[s : s + 50_000]]
            begin = np.cumsum(each_count) - each_count
            each = np.repeat(begins[some[s : s + 50_000]] - begin, each_count) + np.arange(each_count.sum())
            value = _scramble(h[each] ^ np.repeat(bin_.astype(np.uint32), each_count) * np.uint32(0x9E3779B1), _ROUNDS + 1)
            here[line[s : s + 50_000], bin_] = np.uint32(_ROUNDS << 27) | np.minimum.reduceat(value, begin) >> np.uint32(5)
        out[order[i:j]] = here
        i = j
    return out


def arranged(bands: int, rows: int) -> np.ndarray:
    """Which minima each band (a column) is made of."""
    bins = (bands + 1) // 2 * rows
    twice = [np.arange(bins), np.random.default_rng(1).permutation(bins)]
    return np.concatenate([x.reshape(-1, rows) for x in twice])[:bands].T


def records(lines: list[bytes], digests: list[int], k: int, bands: int, rows: int) -> np.ndarray:
    """A record for each line and band."""
    sizes = np.zeros(len(lines), np.int64)
    s = signatures(lines, k, (bands + 1) // 2 * rows, sizes)
    own = arranged(bands, rows)
    own = np.concatenate([own, own[: rows % 2]]) if rows % 2 else own
    two = s.take(own.T.ravel(), axis=1).view(np.uint64).reshape(len(lines), bands, len(own) // 2)  # two minima at once
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(lines), bands)).copy()
    for n in range(two.shape[2]):
        key *= np.uint64(0x9E3779B97F4A7C15)
        key ^= two[:, :, n]
    r = np.empty(key.size, _LINE)
    r["t"], r["d"], r["n"] = mix(key).ravel(), np.repeat(digests, bands), np.repeat(np.minimum(sizes, 65535), bands)
    return r


def _bands(batches, k: int, bands: int, rows: int, buckets: int):
    some = (out[i : i + _LINES] for out in _distinct(batches) for i in range(0, len(out), _LINES))
    yield from packed((records([x for _, x in few], [d for d, _ in few], k, bands, rows) for few in some), buckets)


def _sized(nx, px, sx, ny, py, sy, num: int, den: int):
    """False only where two lines can't be alike: their sets differ too much in size."""
    nx, ny = np.asarray(nx).astype(np.int64), np.asarray(ny).astype(np.int64)
    return den * np.minimum(nx, ny) >= num * np.maximum(nx, ny)


def _alike(nx, ny, common, num: int, den: int):
    """Of sizes and common counts, as numbers or arrays."""
    return den * common >= num * (nx + ny - common)


def _features(line: str, k: int) -> np.ndarray:
    return sorted_distinct(char_shingles(line, k))


def line_dedup(docs: DataFrame, k: int = 8, num: int = 80, den: int = 100, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one line kept of each group of like lines in the whole table, and
    the columns ``n_lines`` and ``n_dropped`` after them.

    Lines end at ``\\n``; they are compared with A-Z folded and white space collapsed.
    Two lines are alike when ``den * intersection >= num * union`` of their sets of
    ``k``-character shingles (a shorter line is one shingle). Groups are the connected
    components of the likeness that the MinHash bands find: a pair with Jaccard 0.8 shares
    one of 36 bands of 6 minima with probability 0.9999, short lines included, and a likelier pair more surely. Every
    pair of a band is verified, or connected already.
    The line with the smallest (id, line number) stays. Blank lines are never compared
    or dropped. A null text stays null, with 0 lines; an empty text has one blank line.
    Rows with a null id stay as they are. Rows that share an id and a text are one
    document: they keep or lose the same lines. Other columns stay; ones named
    ``n_lines`` or ``n_dropped`` are replaced. An empty table gives an empty table.

    The band groups hold each distinct line of a task once, however often it occurs, and are
    resolved without expanding them into pairs; the components are not gathered in one
    place. Copies of a line are told by 128 bits, lines in bands by 64 of them."""
    spark = docs.sparkSession
    rows_in = docs.select(q(id_col).cast("long").alias("id"), F.xxhash64(q(text_col)).alias("th"), q(text_col).cast("string").alias("text")).filter("id is not null and text is not null")
    newlines = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    lines = rows_in.agg(F.sum(newlines.cast("long"))).first()[0] or 0
    buckets = max(parts(spark), lines * bands // _BUCKET)
    only = rows_in.select("text")
    blobs = only.mapInArrow(lean(partial(_bands, k=k, bands=bands, rows=rows, buckets=buckets)), BLOBS)
    held: list[DataFrame] = []

    def texts(need: DataFrame) -> DataFrame:
        """The texts of the needed lines; places come from the same pass, if the needed ids are few."""
        if need.count() > FEW_IDS:
            held.append(materialise(rows_in.mapInArrow(lean(_places), "id long, th long, line int, d long, e long"), "lines"))
            return only.mapInArrow(lean(_line_texts), "id long, text string").join(need, "id", "left_semi")
        ids = np.sort(need.toArrow()["id"].to_numpy())  # at most FEW_IDS
        whole = rows_in.mapInArrow(lean(partial(_places_and_texts, wanted=spark.sparkContext.broadcast(ids))), "id long, th long, line int, d long, e long, text string")
        held.append(materialise(whole, "lines"))
        return held[0].filter("text is not null").select(F.col("d").alias("id"), "text")

    like = linked_components(blobs, texts, partial(_features, k=k), partial(_alike, num=num, den=den), partial(_sized, num=num, den=den), record=_LINE, dense=True)
    places = held[0].select("id", "th", "line", "d", "e")
    like = like.select(F.col("node").alias("d"), "component")
    like = like.unionByName(like.select(F.col("component").alias("d"), "component").distinct())
    # a class: a line with copies, or one that is like another
    classes = places.groupBy("d", "e").agg(F.count("*").alias("n")).join(like, "d", "left").filter("n > 1 or component is not null")
    classes = materialise(classes.select("d", "e", "n", F.coalesce("component", "d").alias("c"), F.when(F.col("component").isNull(), F.col("e")).otherwise(0).alias("c2")), "classes")
    copies = materialise(hot_join(places, classes, ["d", "e"], "n").select("id", "th", "line", "c", "c2"), "copies")
    kept = materialise(copies.groupBy("c", "c2").agg(F.min(F.struct("id", "line")).alias("kept"), F.count("*").alias("n")), "kept")
    gone = hot_join(copies, kept, ["c", "c2"], "n").filter((F.col("id") != F.col("kept.id")) | (F.col("line") != F.col("kept.line")))
    gone = gone.groupBy("id", "th").agg(F.collect_set("line").alias("gone"))
    whole = docs.select(*(q(c) for c in others(docs, "n_lines", "n_dropped")))
    # the operator's own columns stand in one struct, whose name no column of the table has
    own = free_name(whole, "own")
    gone = gone.select(F.struct("id", "th", "gone").alias(own))
    joined = whole.join(gone.hint("shuffle_hash"), (F.col(f"{own}.id") == q(id_col).cast("long")) & (F.col(f"{own}.th") == F.xxhash64(q(text_col))), "left")
    split = free_name(whole, "split")
    none = F.col(own).isNull()
    # an attribute, so that the lambda below doesn't split the text again for each line
    joined = joined.select("*", F.explode_outer(F.array(F.when(~none, F.split(q(text_col), "\n")))).alias(split))
    stay = F.transform(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(f"{own}.gone")), lambda i: F.get(F.col(split), i))
    text = F.when(none, q(text_col)).otherwise(F.array_join(stay, "\n"))
    counts = {"n_lines": F.when(q(text_col).isNull(), 0).otherwise(F.octet_length(q(text_col)) - F.octet_length(F.replace(q(text_col), F.lit("\n"), F.lit(""))) + 1), "n_dropped": F.when(none, 0).otherwise(F.size(f"{own}.gone"))}
    return joined.select(*(text.alias(c) if c == text_col else q(c) for c in whole.columns), *(x.cast("long").alias(c) for c, x in counts.items()))
