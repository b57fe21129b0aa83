"""Best-fit packing into bins of several permitted lengths."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lading.llm.common import lean_group, materialise, q

CAPACITIES = (512, 1024, 2048, 4096)
#: Pieces that are packed together.
SHARD = 20_000


def training_cost(capacity: int) -> float:
    """What a sequence of this length costs: its tokens and their attention, and a share for the sequence itself."""
    return capacity * (1 + capacity / 16384) + 32


def pack(lengths: np.ndarray, capacities: Sequence[int], cost: Callable[[int], float] = training_cost) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bin of each piece, its place in the bin, and the capacity of each bin.

    Longest first, a piece goes to the open bin that it leaves least room in (the one
    opened last, if several). If none has room, a bin is opened of the permitted size
    that costs least for each token it can come to hold: no more than the piece and all
    pieces yet to come. At last each bin shrinks to the smallest size that holds it."""
    sizes = sorted(capacities)
    costs = [cost(c) for c in sizes]
    order = np.argsort(-lengths, kind="stable")
    left = int(lengths.sum())
    bins, places = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    used: list[int] = []
    opened: list[int] = []
    room: dict[int, list[int]] = {}
    mask = 0  # bit r: some open bin has room for r
    for i in order.tolist():
        n = int(lengths[i])
        fit = mask >> n
        if fit:
            r = n + (fit & -fit).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask &= ~(1 << r)
        else:
            c = min((costs[k] / min(c, left), c) for k, c in enumerate(sizes) if c >= n)[1]
            b, r = len(used), c
            used.append(0), opened.append(c)
        bins[i], places[i] = b, used[b]
        used[b] += n
        left -= n
        if r - n:
            room.setdefault(r - n, []).append(b)
            mask |= 1 << (r - n)
    return bins, places, np.array([next(c for c in sizes if c >= u) for u in used], np.int64)


def word_count(col: Column) -> Column:
    """Words of a text, parted by space and \\t-\\r; the built-in measure of length."""
    return F.size(F.array_remove(F.split(F.coalesce(col, F.lit("")), "[\\x20\\x09-\\x0D]+"), ""))


def token_lengths(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens``, counted by the public tokenizer file at ``vocabulary``
    (a path that all executors can read); 0 for null and empty texts."""
    from pyspark.sql import types as T

    def count(batches):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            n = [len(tokenizer.encode(t, add_special_tokens=False).ids) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], names=[*batch.schema.names, "n_tokens"])

    return docs.mapInArrow(count, T.StructType([*docs.schema.fields, T.StructField("n_tokens", T.LongType())]))


def best_fit(docs: DataFrame, capacities: Sequence[int] = CAPACITIES, length: Column | None = None, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece of each row of ``docs``: id, ``piece`` (from 0), ``start``
    (its first token in the document), ``length``, ``bin_id``, ``place`` (its first token
    in the bin) and ``capacity`` (of the bin, at most the largest permitted).

    ``length`` is a column of token counts; by default the words are counted. A document
    longer than the largest capacity is cut into pieces of that length and a rest; all
    others stay whole. One without tokens (null or empty) is a single piece of length 0
    in no bin (null ``bin_id``, ``place`` and ``capacity``). Null ids are allowed, rows that
    repeat are packed each, other columns are ignored, an empty table gives no rows.

    Only ids and lengths are shuffled. Pieces are dealt by hash of id, text and row into shards of about
    ``shard`` pieces, also where an id or a row repeats without end, packed each by :func:`pack`; a shard's last few bins are all that
    a single packing could save."""
    sizes = sorted(capacities)
    most = sizes[-1]
    count = (word_count(q(text_col)) if length is None else F.coalesce(length, F.lit(0))).cast("long")
    rows = docs.select(q(id_col).alias("id"), F.xxhash64(q(text_col)).alias("th"), count.alias("n"))
    cuts = F.sequence(F.lit(0).cast("long"), F.greatest((F.col("n") - 1), F.lit(0)), F.lit(most).cast("long"))
    # the row's number, written with it, deals rows that repeat to different shards
    pieces = rows.withColumn("row", F.monotonically_increasing_id()).select("id", "th", "n", "row", F.posexplode(cuts).alias("piece", "start")).withColumn("length", F.least(F.col("n") - F.col("start"), F.lit(most)))
    pieces = materialise(pieces.select("id", "th", "row", "piece", "start", "length"), "pieces")
    shards = max(1, -(-pieces.filter("length > 0").count() // shard))
    full = pieces.filter("length > 0").withColumn("shard", F.pmod(F.xxhash64("id", "th", "row", "piece"), F.lit(shards))).drop("row")

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("id", "ascending"), ("piece", "ascending"), ("th", "ascending")])
        bins, places, caps = pack(table.column("length").to_numpy(), sizes)
        ids = (table.column("shard").to_numpy() << 32) + bins
        return pa.table([table.column("id"), table.column("piece"), table.column("start"), table.column("length"), pa.array(ids), pa.array(places), pa.array(caps[bins])], names=["id", "piece", "start", "length", "bin_id", "place", "capacity"])

    kind = dict(pieces.dtypes)["id"]
    done = full.groupBy("shard").applyInArrow(lean_group(packed), f"id {kind}, piece int, start long, length long, bin_id long, place long, capacity long")
    none = [F.lit(None).cast("long").alias(c) for c in ("bin_id", "place", "capacity")]
    out = done.unionByName(pieces.filter("length <= 0").select("id", "piece", "start", "length", *none))
    return out.withColumnRenamed("id", id_col)
