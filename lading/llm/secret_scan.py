"""Secret scan: fixed patterns, and a character convolutional network that judges
every other candidate with its context."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lading.llm.common import discard, lean, lean_group, materialise, q, slices

# The base patterns and the least length of what they must match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
KINDS = ("assign", "access", "hex", "net")

#: Other candidates: tokens of eight characters or more.
TOKEN = re.compile(r"[A-Za-z0-9+/_.=@-]{8,}")
_ALONE, _END = r"(?<![A-Za-z0-9+/_.=@-])", r"(?![A-Za-z0-9+/_=@-])"
#: What the network learns as harmless: addresses, words, words as long as candidates, numbers, short ids.
HARMLESS = [re.compile(p) for p in (r"(?<=:)//[A-Za-z0-9./_-]+|[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z]+", _ALONE + "[A-Za-z]+" + _END, _ALONE + "[A-Za-z]{8,}" + _END, _ALONE + "[0-9]+(?:[.,:/-][0-9]+)*" + _END, _ALONE + "(?=[A-Za-z_-]*[0-9])(?=[0-9_-]*[A-Za-z])[A-Za-z0-9_-]{2,11}" + _END)]
_DIGIT = re.compile("[0-9]")
BEFORE, INSIDE, AFTER = 24, 48, 16
WIDTH = BEFORE + INSIDE + AFTER
#: A kind of harmless text weighs as much as so many of its windows at most.
KIND = 1500
#: Windows that one task descends on; of more, tasks descend on such shards and their weights are averaged.
SHARD = 16384
#: Steps in the first shard at least, and then rounds over all shards.
START, OVER_ALL = 1500, 2
#: Scores are counted in steps of this size for the calibration.
_STEP = 1e-3
#: The least share of held-out labelled findings that the threshold must keep.
RECALL = 0.98
#: Candidates judged by one matrix product.
ROWS = 512

_CLASSES = 40
_class = np.full(65536, 39, np.uint8)
_class[0] = 0
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyz"):
    _class[ord(_c)] = 1 + _i // 2
    _class[ord(_c.upper())] = 14 + _i // 2
for _i, _c in enumerate("0123456789"):
    _class[ord(_c)] = 27
for _i, _c in enumerate(" =:\"'+/_.-@"):
    _class[ord(_c)] = 28 + _i


def base_findings(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, leftmost and non-overlapping in each
    kind, matches that are too short left out; sorted by start and kind."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def candidates(text: str, found: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Tokens that might be secrets, those inside a base finding left out."""
    out, k, reach, taken = [], 0, 0, sorted((s, e) for s, e, _ in found)
    for m in TOKEN.finditer(text):
        while k < len(taken) and taken[k][0] <= m.start():
            reach, k = max(reach, taken[k][1]), k + 1
        if reach < m.end():
            out.append(m.span())
    return out


def harmless(text: str, found: list[tuple[int, int, str]], key: int) -> list[tuple[int, int, int]]:
    """(kind, start, end) of at most one match of each of ``HARMLESS`` that touches no
    base finding, after a place that ``key`` picks; and words after the first findings,
    of the last kind. Other tokens have no label."""
    out, at = [], key % max(len(text), 1)
    digits = _DIGIT.search(text) is not None
    for n, pattern in enumerate(HARMLESS):
        if not (digits if n >= 3 else n > 0 or "@" in text or "//" in text):
            continue  # nothing of this kind can be there
        m = pattern.search(text, at) or pattern.search(text)
        if m and not any(s < m.end() and m.start() < e for s, e, _ in found):
            out.append((n, *m.span()))
    for _, at, _ in found[:2]:  # words whose context holds a finding
        for _ in range(3):
            m = HARMLESS[1].search(text, at)
            if not m or m.start() > at + BEFORE:
                break
            if not any(s < m.end() and m.start() < e for s, e, _ in found):
                out.append((len(HARMLESS), *m.span()))
            at = m.end()
    return out


def encode(text: str, start: int, end: int) -> np.ndarray:
    """Character classes of a candidate's first characters and its context on both sides."""
    window = text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0") + text[start : min(end, start + INSIDE)].ljust(INSIDE, "\0") + text[end : end + AFTER].ljust(AFTER, "\0")
    return _class[np.minimum(np.frombuffer(window.encode("utf-32-le", "surrogatepass"), np.uint32), 65535)]


def windows_of(start: int, end: int) -> list[tuple[int, int]]:
    """Windows over a whole candidate, each half over the one before."""
    if end - start <= INSIDE:
        return [(start, end)]
    return [(s, s + INSIDE) for s in [*range(start, end - INSIDE, INSIDE // 2), end - INSIDE]]


def encodings(text: str, start: int, end: int) -> list[np.ndarray]:
    return [encode(text, s, e) for s, e in windows_of(start, end)]


def encode_all(text: str, windows: list[tuple[int, int]]) -> np.ndarray:
    """What :func:`encode` gives for each window, a row each; the classes of the part of
    the text that they lie in are looked up once."""
    at = np.array(windows, np.int64).reshape(-1, 2)
    low = max(0, int(at[:, 0].min(initial=len(text))) - BEFORE)
    part = text[low : int(at[:, 1].max(initial=0)) + AFTER]
    c = np.zeros(BEFORE + len(part) + INSIDE + AFTER, np.uint8)
    c[BEFORE : BEFORE + len(part)] = _class[np.minimum(np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32), 65535)]
    a, b = at[:, :1] - low, at[:, 1:] - low
    inside = np.arange(INSIDE)
    return np.concatenate([c[a + np.arange(BEFORE)], c[BEFORE + a + inside] * (inside < b - a), c[BEFORE + b + np.arange(AFTER)]], 1)


@dataclass
class Network:
    """One convolution over character classes, rectified, its maximum and mean over
    places, a logistic output; scores are calibrated by (slope, shift)."""

    filters: np.ndarray | None = None  # taps x classes x filters
    bias: np.ndarray | None = None
    out: np.ndarray | None = None
    shift: float = 0.0
    platt: tuple[float, float] = field(default=(1.0, 0.0))
    threshold: float = 2.0

    def tables(self) -> list[np.ndarray]:
        """What each pair of neighbouring classes adds under two taps (the bias is in the
        first), and each class under the last tap if their number is odd."""
        f, n = self.filters, self.filters.shape[2]
        pairs = [(f[t][:, None] + f[t + 1][None] + (self.bias if t == 0 else 0)).reshape(-1, n).astype(np.float32) for t in range(0, len(f) - 1, 2)]
        return pairs + ([f[-1] + (self.bias if len(f) == 1 else 0)] if len(f) % 2 else [])

    def hidden(self, x: np.ndarray, tables: list[np.ndarray] | None = None) -> np.ndarray:
        tables = self.tables() if tables is None else tables
        taps = len(self.filters)
        n = x.shape[1] - taps + 1
        one = x.astype(np.int64)
        pair = one[:, :-1] * _CLASSES + one[:, 1:]
        h = None
        for t, table in zip(range(0, taps, 2), tables):
            part = table.take((pair if t + 1 < taps else one)[:, t : t + n], axis=0)
            h = part if h is None else np.add(h, part, out=h)
        return np.maximum(h, 0, out=h)

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Scores, a few windows at a time: their activations fit the processor's cache."""
        tables, out = self.tables(), []
        for i in range(0, len(x), 64):
            h = self.hidden(x[i : i + 64], tables)
            out.append(np.concatenate([h.max(1), h.mean(1)], 1) @ self.out + self.shift)
        return np.concatenate(out) if out else np.zeros(0, np.float32)

    def calibrated(self, s: np.ndarray) -> np.ndarray:
        a, b = self.platt
        return 1 / (1 + np.exp(-np.clip(a * s + b, -40, 40)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.calibrated(self.raw(x))


def _start(filters: int, taps: int, rng) -> Network:
    return Network(rng.normal(0, 0.1, (taps, _CLASSES, filters)).astype(np.float32), np.zeros(filters, np.float32), rng.normal(0, 0.1, 2 * filters).astype(np.float32))


def descend(net: Network, x: np.ndarray, y: np.ndarray, weight: np.ndarray, used: np.ndarray, rounds: int, rng, rate: float = 0.01, size: int = 64) -> None:
    """Adam on the rows ``used``, each once a round, ``size`` of them a step."""
    taps, _, filters = net.filters.shape
    params = [net.filters, net.bias, net.out]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for _ in range(rounds):
        rng.shuffle(used)
        for i in range(0, len(used), size):
            at = used[i : i + size]
            b = x[at]
            h = net.hidden(b)
            n = h.shape[1]
            pooled = np.concatenate([h.max(1), h.mean(1)], 1)
            p = 1 / (1 + np.exp(-np.clip(pooled @ net.out + net.shift, -40, 40)))
            e = ((p - y[at]) * weight[at] / len(at)).astype(np.float32)
            grad_out = pooled.T @ e + 1e-4 * net.out
            net.shift -= 5 * rate * float(e.sum())
            gp = e[:, None] * net.out[None]
            gh = np.repeat(gp[:, None, filters:] / n, n, 1)
            rows, cols = np.arange(len(at))[:, None], np.arange(filters)[None]
            gh[rows, h.argmax(1), cols] += gp[:, :filters]
            gh *= h > 0
            grad_f = np.zeros_like(net.filters)
            for t in range(taps):
                np.add.at(grad_f[t], b[:, t : t + n].ravel(), gh.reshape(-1, filters))
            step += 1
            for p_, g, (m, v) in zip(params, (grad_f, gh.sum((0, 1)), grad_out), moments):
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                p_ -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)


def _platt(s: np.ndarray, t: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and shift that calibrate the scores ``s`` of labels ``t``, ``n`` of each."""
    a, b, share = 1.0, 0.0, n / n.sum()
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * s + b, -40, 40)))
        a, b = a - 0.05 * (((p - t) * s * share).sum() + 1e-3 * (a - 1)), b - 0.05 * ((p - t) * share).sum()
    return float(a), float(b)


def _place(n: int) -> int:
    """Which of ``n`` findings, likeliest first, is the last that the threshold keeps."""
    return min(n - 1, int(np.ceil(RECALL * n)) - 1)


def _folds(both) -> tuple[range, range]:
    """The folds that calibrate and that set the threshold; ``both`` tells whether some folds have both labels."""
    spare = range(4) if both(range(4)) else range(4, 10)
    return tuple(at if both(at) else spare for at in (range(2), range(2, 4)))


def fit(x: np.ndarray, y: np.ndarray, filters: int = 24, taps: int = 5, rounds: int = 20, seed: int = 7, fold: np.ndarray | None = None, weight: np.ndarray | None = None) -> Network:
    """A network trained on encoded candidates ``x`` labelled ``y``. Of the ten folds
    (``fold``, by document; by chance where none is given) 0 and 1 calibrate its scores and 2 and 3
    set the threshold, the largest that keeps the share ``RECALL`` of their findings; a
    step whose folds lack labels of either kind uses all four. Without 20 labels, or labels of
    both kinds outside of these folds, it finds nothing."""
    rng = np.random.default_rng(seed)
    fold = rng.integers(0, 10, len(y)) if fold is None else fold
    used = np.flatnonzero(fold >= 4)
    if len(y) < 20 or not len(used) or y[used].min() == y[used].max():
        return Network()
    both = lambda at: len(here := y[np.isin(fold, at)]) > 0 and here.min() != here.max()
    calibrate, decide = (np.flatnonzero(np.isin(fold, at)) for at in _folds(both))
    net = _start(filters, taps, rng)
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)) if weight is None else weight
    descend(net, x, y, weight, used, rounds, rng)
    net.platt = _platt(net.raw(x[calibrate]).astype(np.float64), y[calibrate], np.ones(len(calibrate)))
    found = np.sort(net.probability(x[decide])[y[decide] == 1])[::-1]
    net.threshold = float(found[_place(len(found))])
    return net


def _packed(net: Network) -> bytes:
    return b"".join(np.asarray(p, np.float64).tobytes() for p in (net.filters, net.bias, net.out, net.shift))


def _unpacked(data: np.ndarray, filters: int = 24, taps: int = 5) -> Network:
    a, b = taps * _CLASSES * filters, filters
    f32 = lambda v: v.astype(np.float32)
    return Network(f32(data[:a]).reshape(taps, _CLASSES, filters), f32(data[a : a + b]), f32(data[a + b : a + 3 * b]), float(data[-1]))


def _encoded(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, WIDTH)


def fit_all(windows: DataFrame, weights: dict[int, float], shards: int, learnt: int, seed: int = 7) -> Network:
    """:func:`fit` on a table of windows (y, below 0 for findings; x; fold) that no single
    task holds, ``learnt`` of them in the folds that it descends on. It starts from one shard; then every shard descends from the same
    weights, and these are averaged by the shards' sizes. All windows of the folds 0 to 3
    calibrate and set the threshold: scores are counted in steps of ``_STEP``, and the
    threshold is the exact score of the finding at its place."""
    spark = windows.sparkSession
    labelled = windows.withColumn("shard", F.pmod(F.xxhash64("x", "y"), F.lit(shards)).cast("int"))
    table = labelled.filter("fold >= 4")

    def descended(net: Network, rounds: int, rate: float, size: int):
        sent = spark.sparkContext.broadcast(_packed(net))

        def step(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by([("y", "ascending"), ("x", "ascending")])
            own, kinds, shard = _unpacked(np.frombuffer(sent.value)), rows.column("y").to_numpy(), rows.column("shard")[0].as_py()
            weight = np.array([weights[k] for k in kinds.tolist()])
            descend(own, _encoded(rows.column("x")), (kinds < 0).astype(int), weight, np.arange(len(kinds)), rounds, np.random.default_rng([seed, shard]), rate, size)
            return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([len(kinds)], pa.int64()), "net": pa.array([_packed(own)], pa.binary())})

        return lean_group(step)

    def averaged(some: DataFrame, net: Network, *how) -> Network:
        got = some.groupBy("shard").applyInArrow(descended(net, *how), "shard int, n long, net binary").collect()  # a row a shard
        total, size = 0.0, sum(r["n"] for r in got)
        for r in sorted(got, key=lambda r: r["shard"]):
            total = total + np.frombuffer(r["net"]) * (r["n"] / size)
        return _unpacked(total)

    net = averaged(table.filter("shard = 0"), _start(24, 5, np.random.default_rng(seed)), math.ceil(START * 64 * shards / learnt), 0.01, 64)
    for _ in range(OVER_ALL):
        net = averaged(table, net, 1, 0.003, 128)
    sent = spark.sparkContext.broadcast(net)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (few for whole in batches for few in slices(whole, 4096)):
            s = sent.value.raw(_encoded(batch.column(0)))
            yield pa.record_batch([batch.column(1), batch.column(2), pa.array(s, pa.float32())], names=["y", "fold", "s"])

    has = {(r["fold"], r["f"]) for r in windows.select("fold", (F.col("y") < 0).alias("f")).distinct().collect()}  # at most 20 rows
    calibrate, decide = _folds(lambda at: all(any((k, f) in has for k in at) for f in (True, False)))
    scored = windows.filter(F.col("fold").isin(sorted({*calibrate, *decide}))).select("x", (F.col("y") < 0).cast("int").alias("y"), F.col("fold").cast("int").alias("fold"))
    scored = materialise(scored.mapInArrow(lean(score), "y int, fold int, s float").withColumn("step", F.round(F.greatest(F.lit(-60.0), F.least(F.lit(60.0), F.col("s"))) / _STEP).cast("int")), "scores")
    # at most 120,000 steps of each label
    counts = scored.filter(F.col("fold").isin(list(calibrate))).groupBy("y", "step").agg(F.count("*").alias("n")).orderBy("y", "step").toArrow()
    net.platt = _platt(counts["step"].to_numpy() * _STEP, counts["y"].to_numpy(), counts["n"].to_numpy())
    found = scored.filter((F.col("y") == 1) & F.col("fold").isin(list(decide)))
    steps = found.groupBy("step").agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect()
    left = _place(sum(r["n"] for r in steps))
    for at in steps:
        if left < at["n"]:
            break
        left -= at["n"]
    for r in found.filter(F.col("step") == at["step"]).groupBy("s").agg(F.count("*").alias("n")).orderBy(F.desc("s")).toLocalIterator():
        last = r["s"]
        if left < r["n"]:
            break
        left -= r["n"]
    net.threshold = float(net.calibrated(np.array([last], np.float32))[0])
    discard(scored)
    return net


def train(docs: DataFrame, text_col: str = "text") -> Network:
    """A network trained on all distinct windows of base findings, without what stands
    before them in half, and of the harmless text that :func:`harmless` picks of each document. A kind of
    harmless text weighs as much as ``KIND`` of its windows at most, findings as much as all of it. Tokens that
    only look like secrets have no label. Up to two shards of windows are fitted on the
    driver, more by tasks (:func:`fit_all`)."""
    rows = docs.filter(q(text_col).isNotNull()).select(F.xxhash64(q(text_col)).alias("h"), q(text_col).alias("text"))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (few for whole in batches for few in slices(whole)):
            h, y, x = [], [], []

            def add(key, label, w):
                if key & 1:
                    w[:BEFORE] = 0
                h.append(own), y.append(label), x.append(w.tobytes())

            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found, own = base_findings(text), key % 10
                for k, (s, e, kind) in enumerate(found):
                    lead = re.search(r"[A-Za-z0-9+/_.=-]+\Z", text[s:e])
                    at = s + lead.start() if kind == "assign" and lead else s
                    for w in encodings(text, at, e):
                        add(key + k, -1, w)
                for k, (n, s, e) in enumerate(harmless(text, found, key)):
                    for w in encodings(text, s, e):
                        add(key + k, n, w)
            yield pa.record_batch([pa.array(h, pa.int64()), pa.array(y, pa.int32()), pa.array(x, pa.binary())], names=["h", "y", "x"])

    windows = rows.mapInArrow(label, "h long, y int, x binary")
    distinct = materialise(windows.groupBy("y", "x").agg(F.min("h").alias("fold")), "windows")
    sizes = {(r["y"], r["used"]): r["n"] for r in distinct.groupBy("y", (F.col("fold") >= 4).alias("used")).agg(F.count("*").alias("n")).collect()}  # two rows a kind
    count = {k: sizes.get((k, True), 0) + sizes.get((k, False), 0) for k, _ in sizes}
    total, least = sum(count.values()), {k: min(n, KIND) for k, n in count.items() if k >= 0}
    weights = {k: total * 0.5 / n * (1 if k < 0 else least[k] / sum(least.values())) for k, n in count.items()}
    learnt = sum(n for (_, used), n in sizes.items() if used)
    if total < 20 or len({k < 0 for k, used in sizes if used}) < 2:
        net = Network()
    elif total > 2 * SHARD:
        net = fit_all(distinct, weights, math.ceil(learnt / SHARD), learnt)
    else:
        some = distinct.collect()  # at most two shards
        some.sort(key=lambda r: (r["y"] >= 0, bytes(r["x"]), r["y"]))
        x, y = np.frombuffer(b"".join(bytes(r["x"]) for r in some), np.uint8).reshape(len(some), WIDTH), np.array([r["y"] for r in some], int)
        net = fit(x, (y < 0).astype(int), fold=np.array([r["fold"] for r in some], int), weight=np.array([weights[k] for k in y.tolist()]))
    discard(distinct)
    return net


def findings(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: id and ``found``, an array of (kind, start, end,
    p) sorted by start and kind: the base findings (p null without a trained network) and the other candidates
    whose calibrated probability reaches the threshold. Starts and ends count code
    points, ends exclusive. Null counts as empty text and has none; null ids stay; rows
    that repeat get equal rows; other columns are ignored; an empty table gives none."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))
        for batch in (few for whole in batches for few in slices(whole)):
            rows, bases, place, x, best = [], [], [], [], {}

            def judge():
                if x:
                    for at, p in zip(place, model.probability(np.concatenate(x)).tolist()):
                        best[at] = max(best.get(at, 0.0), p)
                    place.clear(), x.clear()

            for text in batch.column(1).to_pylist():
                text = text or ""
                base = base_findings(text)
                rows.append([])
                bases.append(base)
                if model.filters is not None:
                    some = [(s, e, w) for s, e in sorted({*candidates(text, base), *((s, e) for s, e, _ in base)}) for w in windows_of(s, e)]
                    for i in range(0, len(some), ROWS):
                        place += [(len(rows) - 1, s, e) for s, e, _ in some[i : i + ROWS]]
                        x.append(encode_all(text, [w for _, _, w in some[i : i + ROWS]]))
                        if len(place) >= ROWS:
                            judge()
            judge()
            for k, base in enumerate(bases):
                rows[k] = [(*f, best.get((k, *f[:2]))) for f in base]
                for f in base:
                    best.pop((k, *f[:2]), None)
            for (k, s, e), p in best.items():
                if p >= model.threshold:
                    rows[k].append((s, e, "net", p))
            out = [[{"kind": c, "start": s, "end": e, "p": p} for s, e, c, p in sorted(r, key=lambda f: (f[0], KINDS.index(f[2]), f[1]))] for r in rows]
            yield pa.record_batch([batch.column(0), pa.array(out, kind)], names=["id", "found"])

    rows = docs.select(q(id_col).cast("long").alias("id"), q(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(scan), "id long, found array<struct<kind:string,start:bigint,end:bigint,p:double>>").withColumnRenamed("id", id_col)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by base kind, the hash of the base spans and all spans as text."""
    span = lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))
    base = F.filter("found", lambda f: f["kind"] != "net")
    count = lambda kind: F.size(F.filter("found", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(q(id_col), *map(count, KINDS[:3]), F.sha2(F.array_join(F.transform(base, span), ","), 256).alias("base_sha256"), F.array_join(F.transform("found", span), ",").alias("spans"))
