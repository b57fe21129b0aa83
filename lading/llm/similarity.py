"""Candidate search shared by the two near-duplicate operators.

Items that share a key are candidates. A key's group of g items is never expanded
into its g*g pairs. First each member is paired with a leading item; those pairs are
verified and their components found. Then only pairs of members that still lie in
different components, and that the pair filter admits, are verified. Every admitted
pair of a group is thus verified or already connected, so the components are those of
the full join.

Keys travel as packed arrays, a few rows for each bucket and task. A task that holds a
long run of one key sends the run to a group of its own and only the run's leader to
the key's group, so that a key that a third of all items have meets in no single task;
groups whose members are all connected are then found by a partial aggregate and
never gathered. What is gathered are the groups of a key that stay in several components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lading.llm.common import discard, lean, lean_group, lean_pair, materialise, mix, parts, slices
from lading.llm.components import components

#: key, item, digest of the item's content, its size, the key's position in it, a summary of it
RECORD = np.dtype([("t", "<u8"), ("d", "<i8"), ("n", "<u4"), ("p", "<u4"), ("s", "<u8")])
BLOBS = "bucket int, part long, blob binary"
#: Packed bytes held back in a task before they are passed on.
HELD = 8 << 20
#: Records of one key in a task's pack from which on they form a group of their own.
RUN = 4096
#: Ids up to this many are broadcast to thin out the texts before they are joined (8 bytes each); more are joined.
FEW_IDS = 1_000_000
#: Rows of the groups left over that a bucket should hold.
REST = 100_000
#: Features that a task remembers while it verifies pairs.
KNOWN = 2_000_000

#: Takes size, position and summary of one side and of the other, and says which pairs may link.
Admit = Callable[..., np.ndarray]


def wire(record: np.dtype) -> np.dtype:
    """The packed form: the bucket says the rest of the key."""
    return np.dtype([("t", "<u4"), *((f, record[f]) for f in record.names if f != "t")])


def _leading(r: np.ndarray) -> np.ndarray:
    """Where the item stands that leads a group (least position, then least item), and one
    other: the group that gets both has a third row, if it has any more to compare with."""
    least = r["p"] == r["p"].min() if "p" in r.dtype.names else np.ones(len(r), bool)
    lead = np.flatnonzero(least)[np.argmin(r["d"][least])]
    return np.append(lead, np.flatnonzero(r["d"] != r["d"][lead])[:1])


def packed(found: Iterator[np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    """Records dealt to ``buckets`` by their key, long runs of a key as parts of their own."""

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        r = np.concatenate(held)
        t = np.ascontiguousarray(r["t"])
        at = (t % np.uint64(buckets)).astype(np.int32)
        out = np.empty(len(r), wire(r.dtype))
        out["t"] = t >> np.uint64(32)
        for f in r.dtype.names[1:]:
            out[f] = r[f]
        keep, rows = np.ones(len(r), bool), []
        for places in _runs(t, out["t"], at):
            run = out[places]
            keep[places] = False
            keep[places[_leading(run)]] = True
            rows.append((int(at[places[0]]), 1 + (int(run["d"].sum(dtype=np.int64)) & (2**62 - 1)), run.tobytes()))
        if not keep.all():
            out, at = out[keep], at[keep]
        order = np.argsort(at.astype(np.uint16) if buckets <= 1 << 16 else at, kind="stable")  # short numbers are sorted by digits
        at = at[order]
        whole = out.view(f"V{out.itemsize}").take(order).tobytes()
        first = _groups(at)
        rows += [(int(at[i]), 0, whole[i * out.itemsize : j * out.itemsize]) for i, j in zip(first.tolist(), [*first[1:].tolist(), len(at)])]
        bucket, part, blob = zip(*rows) if rows else ((), (), ())
        return pa.record_batch([pa.array(bucket, pa.int32()), pa.array(part, pa.int64()), pa.array(blob, pa.binary())], names=["bucket", "part", "blob"])

    held: list[np.ndarray] = []
    size = 0
    for r in found:
        held.append(r)
        size += r.nbytes
        if size >= HELD:
            yield flush(held)
            held, size = [], 0
    if held:
        yield flush(held)


def _runs(t: np.ndarray, own: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """Places of the records of each key (bucket ``at``, rest ``own``) that has ``RUN`` or more; only keys whose first 16 bits as many records share are sorted."""
    top = (t >> np.uint64(48)).astype(np.int64)
    full = np.bincount(top, minlength=1 << 16) >= RUN
    some = np.flatnonzero(full[top]) if full.any() else np.zeros(0, np.int64)
    key = at[some].astype(np.uint64) << np.uint64(32) | own[some]
    order = np.argsort(key, kind="stable")
    some, key = some[order], key[order]
    starts = _groups(key)
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(key)]):
        if e - s >= RUN:
            yield some[s:e]


def _groups(t: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values."""
    return np.flatnonzero(np.append(True, t[1:] != t[:-1])) if len(t) else np.zeros(0, np.int64)


def _shared(r: np.ndarray) -> np.ndarray:
    """The rows, sorted by key, whose key another row has."""
    starts = _groups(r["t"])
    return r[np.repeat(np.diff(np.append(starts, len(r))) > 1, np.diff(np.append(starts, len(r))))]


def stars(r: np.ndarray, admit: Admit) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of each group's leading item (least position) with its members, and the
    rows of the groups that have other pairs too. ``r`` has the fields of ``RECORD``."""
    r = r[np.lexsort((r["s"], r["n"], r["d"], r["p"], r["t"]))]
    if len(r):
        r = _shared(r[np.append(True, (r[1:] != r[:-1]))])
    starts = _groups(r["t"])
    sizes = np.diff(np.append(starts, len(r)))
    lead = r[np.repeat(starts, sizes)]
    ok = (lead["d"] != r["d"]) & admit(lead["n"], lead["p"], lead["s"], r["n"], r["p"], r["s"])
    pairs = np.stack([np.minimum(lead["d"], r["d"])[ok], np.maximum(lead["d"], r["d"])[ok]], 1)
    return np.unique(pairs, axis=0) if len(pairs) else pairs, r[np.repeat(sizes > 2, sizes)]


def crossing(t, d, n, p, s, c, admit: Admit) -> np.ndarray:
    """Admitted pairs of a group's items in different components."""
    order = np.argsort(t, kind="stable")
    t, d, n, p, sums, c = (x[order] for x in (t, d, n, p, s, c))
    starts = _groups(t)
    out = []
    if len(starts):
        mixed = np.minimum.reduceat(c, starts) != np.maximum.reduceat(c, starts)
        for s, e in zip(starts[mixed], np.append(starts[1:], len(t))[mixed]):
            for i in range(s, e, 256):
                j = min(i + 256, e)
                x, y = np.nonzero(admit(n[i:j, None], p[i:j, None], sums[i:j, None], n[None, s:e], p[None, s:e], sums[None, s:e]) & (c[i:j, None] != c[None, s:e]))
                x, y = d[i + x], d[s + y]
                out.append(np.unique(np.stack([x, y], 1)[x < y], axis=0))
    return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)


_STARS = pa.schema([("kind", pa.int32()), ("t", pa.int64()), ("x", pa.int64()), ("y", pa.int64()), ("p", pa.int64()), ("s", pa.int64()), ("xs", pa.list_(pa.int64()))])
STARS = "kind int, t long, x long, y long, p long, s long, xs array<long>"


def _star_step(admit: Admit, record: np.dtype, dense: bool):
    """Of a bucket: pairs (kind 0: x, y); and the rows of the larger groups (kind 1: key,
    item, size, position, summary), or, if ``dense``, these groups (kind 1: key, digest of
    its items, how many, items; kind 2 for a run of its own)."""
    packing = wire(record)

    def step(table: pa.Table) -> pa.Table:
        got = np.frombuffer(b"".join(table.column("blob").to_pylist()), packing)
        got = _shared(got[np.argsort(got["t"])])
        r = np.zeros(len(got), RECORD)
        for f in packing.names:
            r[f] = got[f]
        r["t"] |= np.uint64(table.column("bucket")[0].as_py()) << np.uint64(32)
        pairs, rest = stars(r, admit)
        zero, kind = np.zeros(len(pairs), np.int64), 1
        if dense:
            kind = 2 if table.column("part")[0].as_py() else 1
            rest = rest[np.lexsort((rest["d"], rest["t"]))]
            starts = _groups(rest["t"])
            sizes = np.diff(np.append(starts, len(rest)))
            sig = mix(np.add.reduceat(mix(rest["d"].view(np.uint64)), starts)) if len(rest) else rest["t"]
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(rest)), pa.int32()), pa.array(rest["d"], pa.int64()))
            cols = [rest["t"][starts].astype(np.int64), sig.view(np.int64), sizes.astype(np.int64), np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)]
        else:
            lists = pa.nulls(len(rest), pa.list_(pa.int64()))
            cols = [rest["t"].astype(np.int64), rest["d"], rest["n"].astype(np.int64), rest["p"].astype(np.int64), np.ascontiguousarray(rest["s"]).view(np.int64)]
        one = [np.zeros(len(pairs), np.int32), zero, np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1]), zero, zero]
        both = [pa.concat_arrays([pa.array(u, f.type), pa.array(v, f.type)]) for u, v, f in zip(one, [np.full(len(cols[0]), kind, np.int32), *cols], _STARS)]
        return pa.Table.from_arrays([*both, pa.concat_arrays([pa.nulls(len(pairs), pa.list_(pa.int64())), lists])], schema=_STARS)

    return step


def _cross_step(admit: Admit):
    def step(table: pa.Table) -> pa.Table:
        t, d, n, p, s, c = (table.column(k).to_numpy() for k in ("t", "x", "y", "p", "s", "c"))
        pairs = crossing(t, d, n, p, s, c, admit)
        return pa.table([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], names=["a", "b"])

    return step


def fetched(texts: DataFrame | Callable[[DataFrame], DataFrame], need: DataFrame) -> DataFrame:
    """The rows of ``texts`` (id, text), each once, whose id ``need`` has; a function
    finds them itself."""
    if callable(texts):
        return materialise(texts(need).dropDuplicates(["id"]), "texts")
    few = need.count() <= FEW_IDS
    return materialise(texts.join(F.broadcast(need) if few else need, "id", "left_semi").distinct(), "texts")


def _holds(linked: Callable[[int, int, int], bool], u: np.ndarray, v: np.ndarray) -> bool:
    """Of two sorted sets; those that can't link by their sizes aren't intersected."""
    if not linked(len(u), len(v), min(len(u), len(v))):
        return False
    both = np.concatenate([u, v])
    both.sort(kind="stable")  # two runs to merge
    return bool(linked(len(u), len(v), int(np.count_nonzero(both[1:] == both[:-1]))))


def verify(pairs: DataFrame, some: DataFrame, features: Callable[[str], np.ndarray], linked: Callable[[int, int, int], bool]) -> DataFrame:
    """The ``pairs`` (a, b) for which ``linked(size a, size b, common)`` holds, with
    sizes of the distinct ``features`` of the texts in ``some`` (id, text), each pair once."""

    def step(batches):
        for batch in batches:
            known: dict[tuple[int, str], np.ndarray] = {}
            held, keep = 0, []
            for x, y, s, t in (r for few in slices(batch) for r in zip(*(c.to_pylist() for c in few.columns))):
                both = []
                for k in ((x, s), (y, t)):
                    if (f := known.get(k)) is None:
                        f = known[k] = features(k[1] or "")
                        held += len(f)
                    both.append(f)
                keep.append(_holds(linked, *both))
                if held > KNOWN:
                    known, held = {}, 0
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(some.select(F.col("id").alias("a"), F.col("text").alias("s")), "a").join(some.select(F.col("id").alias("b"), F.col("text").alias("t")), "b")
    return materialise(joined.select("a", "b", "s", "t").mapInArrow(lean(step), "a long, b long"), "verified")


#: Rows of a group that are compared with as many others in one matrix product.
SIDE = 128


def group_links(features: list[np.ndarray], c: np.ndarray, holds: Callable) -> list[tuple[int, int]]:
    """Pairs of places in a group, of different components, for which ``holds`` (sizes,
    sizes, common counts as arrays) says so: only as many as join components. Intersections
    are matrix products of blocks, so no pair of rows is ever written out."""
    order = np.argsort(c, kind="stable")
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            x = y
        return x

    out, sizes = [], np.array([len(f) for f in features])
    for i in range(0, len(order), SIDE):
        rows = order[i : i + SIDE]
        own = np.concatenate([features[k] for k in rows])
        names, column = np.unique(own, return_inverse=True)
        a = np.zeros((len(rows), len(names)), np.float32)
        a[np.repeat(np.arange(len(rows)), sizes[rows]), column] = 1
        for j in range(i, len(order), SIDE):
            cols = order[j : j + SIDE]
            if c[rows].min() == c[rows].max() == c[cols].min() == c[cols].max():
                continue
            other = np.concatenate([features[k] for k in cols])
            at = np.minimum(np.searchsorted(names, other), max(len(names) - 1, 0))
            known = names[at] == other if len(names) else np.zeros(len(other), bool)
            b = np.zeros((len(cols), len(names)), np.float32)
            b[np.repeat(np.arange(len(cols)), sizes[cols])[known], at[known]] = 1
            ok = holds(sizes[rows][:, None], sizes[cols][None], np.rint(a @ b.T).astype(np.int64)) & (c[rows][:, None] != c[cols][None])
            for x, y in zip(*np.nonzero(ok)):
                p, r = root(int(c[rows[x]])), root(int(c[cols[y]]))
                if p != r:
                    up[max(p, r)] = min(p, r)
                    out.append((int(rows[x]), int(cols[y])))
    return out


#: Rows of a group up to which its pairs are compared one by one.
SMALL = 24


def _resolve_step(features, holds):
    """Links between components, of the groups (t, x, c) of a bucket whose texts (id,
    text) come along, each once. A pair that several groups hold is compared once, and
    not at all once the bucket's links have joined its components."""

    def step(groups: pa.Table, texts: pa.Table) -> pa.Table:
        t, d, c = (groups.column(k).to_numpy() for k in ("t", "x", "c"))
        place = {x: k for k, x in enumerate(texts.column("id").to_pylist())}
        text = texts.column("text")
        known: dict[int, np.ndarray] = {}
        tried: set[tuple[int, int]] = set()
        up: dict[int, int] = {}
        held = 0

        def root(x: int) -> int:
            while (y := up.get(x, x)) != x:
                x = y
            return x

        def feature(x: int) -> np.ndarray:
            nonlocal held
            if (f := known.get(x)) is None:
                if held > KNOWN:
                    known.clear()
                    held = 0
                f = known[x] = features((text[place[x]].as_py() if x in place else "") or "")
                held += len(f)
            return f

        def join(x: int, y: int) -> None:
            a.append(c[x]), b.append(c[y])
            p, r = root(int(c[x])), root(int(c[y]))
            up[max(p, r)] = min(p, r)

        a, b = [], []
        order = np.lexsort((d, t))
        for rows in np.split(order, _groups(t[order])[1:]) if len(t) else []:
            if len(rows) > SMALL:
                tops = np.array([root(int(x)) for x in c[rows]])
                if tops.min() != tops.max():
                    for x, y in group_links([feature(int(x)) for x in d[rows]], tops, holds):
                        join(rows[x], rows[y])
                continue
            for i, x in enumerate(rows):
                for y in rows[i + 1 :]:
                    pair = (int(d[x]), int(d[y]))
                    if c[x] == c[y] or pair in tried or root(int(c[x])) == root(int(c[y])):
                        continue
                    tried.add(pair)
                    u, v = feature(pair[0]), feature(pair[1])
                    if _holds(holds, u, v):
                        join(x, y)
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return step


def _open_groups(first: DataFrame, labels: DataFrame, dense: bool) -> DataFrame:
    """The rows (t, x, y, p, s, c, place) of the groups that hold several components; of
    the groups with the same items, dense comparison takes one. Groups that hold the
    same pairs share a ``place`` as far as they have the same first item."""
    if dense:
        hot = materialise(first.filter("kind = 2").select("t").distinct(), "hot")
        few = F.broadcast(hot) if hot.count() <= FEW_IDS else hot
        groups = first.filter("kind > 0").select("t", F.col("x").alias("sig"), F.col("y").alias("n"), "xs")
        once = groups.join(few, "t", "left_anti").groupBy("sig", "n").agg(F.min_by("xs", "t").alias("xs"), F.min("t").alias("t"))
        none = [F.lit(0).cast("long").alias(c) for c in "yps"]
        rows = once.select("t", "xs").unionByName(groups.join(few, "t", "left_semi").select("t", "xs")).select("t", F.explode("xs").alias("x"), *none)
    else:
        rows = first.filter("kind = 1").select("t", "x", "y", "p", "s")
    held = materialise(rows.join(labels.withColumnRenamed("node", "x"), "x", "left").select("t", "x", "y", "p", "s", F.coalesce("component", "x").alias("c")), "labelled")
    mixed = held.groupBy("t").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.min("x").alias("place")).filter("low <> high").select("t", "place" if dense else F.col("t").alias("place"))
    out = materialise(held.join(mixed, "t"), "open")
    discard(held)
    return out


def linked_components(blobs: DataFrame, texts, features, linked, admit: Admit, links: DataFrame | None = None, record: np.dtype = RECORD, dense: bool = False) -> DataFrame:
    """Components (``node``, ``component``) of the items in ``blobs`` under
    ``linked``; ``links`` (a, b) are known already, such as those of copies.
    ``record`` may lack all but key and item; what it lacks tells nothing. With
    ``dense``, for pair filters that can't tell near misses from links, the pairs left
    over are compared group by group, those of large groups in blocks of matrix products."""
    first = materialise(blobs.groupBy("bucket", "part").applyInArrow(lean_group(_star_step(admit, record, dense)), STARS), "stars")
    pairs = materialise(first.filter("kind = 0").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    need = materialise((ids.unionByName(first.filter("kind > 0").select(F.explode("xs").alias("id")).distinct()) if dense else ids).distinct(), "ids")
    some = fetched(texts, need)
    sure = verify(pairs, some, features, linked)
    labels = components(sure if links is None else sure.unionByName(links))
    rest = _open_groups(first, labels, dense)
    buckets = max(parts(blobs.sparkSession), rest.count() // REST)
    dealt = rest.withColumn("bucket", F.pmod(F.xxhash64("place"), F.lit(buckets)))
    gone = [first, pairs, need, sure]
    if dense:
        own = dealt.select("bucket", F.col("x").alias("id")).distinct().join(some, "id").select(F.col("bucket").alias("own"), "id", "text")
        more = materialise(dealt.select("bucket", "t", "x", "c").groupBy("bucket").cogroup(own.groupBy("own")).applyInArrow(lean_pair(_resolve_step(features, linked)), "a long, b long"), "crossing")
    else:
        crossing_pairs = materialise(dealt.groupBy("bucket").applyInArrow(lean_group(_cross_step(admit)), "a long, b long").distinct(), "crossing")
        need = materialise(crossing_pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
        again = fetched(texts, need)
        found = verify(crossing_pairs, again, features, linked)
        gone += [crossing_pairs, need, again]
        for end in "ab":  # from items to their components
            found = found.join(labels.select(F.col("node").alias(end), F.col("component").alias("c")), end, "left").withColumn(end, F.coalesce("c", end)).drop("c")
        more = materialise(found.select("a", "b"), "joined")
    over = components(more)
    size = over.count()
    if size:
        side = over.select(F.col("node").alias("component"), F.col("component").alias("top"))
        moved = labels.join(F.broadcast(side) if size <= FEW_IDS else side, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
        labels = moved.unionByName(over)
    for x in [*gone, some, rest, more]:
        discard(x)
    return labels
