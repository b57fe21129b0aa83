import numpy as np
import pytest
from pyspark.sql import types as T

from lading.llm.components import forest
from lading.llm.common import char_shingles
from lading.llm.line_dedup import BANDS, ROWS, SHINGLE, line_dedup, normals, records, signatures
from lading.llm.queries import QUERIES

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_lines", T.StringType())])


def brute(rows, k=8):
    """Lines kept by exact Jaccard over all pairs of distinct lines."""
    first, where = {}, []
    for i, t in rows:
        for n, line in enumerate(normals((t or "").encode())):
            if line:
                where.append((i, n, line))
                first[line] = min(first.get(line, (i, n)), (i, n))
    lines = sorted(first)
    sets = [set(np.unique(char_shingles(x.decode(), k)).tolist()) for x in lines]
    index = {}
    for n, s in enumerate(sets):
        for h in s:
            index.setdefault(h, []).append(n)
    links = []
    for n, s in enumerate(sets):
        common = {}
        for h in s:
            for m in index[h]:
                if m < n:
                    common[m] = common.get(m, 0) + 1
        links += [(n, m) for m, c in common.items() if 100 * c >= 80 * (len(s) + len(sets[m]) - c)]
    top = dict(forest(links))
    kept = {}
    for n, x in enumerate(lines):
        c = top.get(n, n)
        kept[c] = min(kept.get(c, first[x]), first[x])
    at = {x: n for n, x in enumerate(lines)}
    gone = {(i, n) for i, n, x in where if (i, n) != kept[top.get(at[x], at[x])]}
    return {i: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in rows}


def run(spark, rows):
    out = line_dedup(spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA))
    assert out.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    return {r.doc_id: r for r in out.collect()}


def test_against_brute_force_on_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got, want = run(spark, rows), brute(rows)
    same = sum(got[i].text == want[i] for i in want)
    assert len(got) == len(want) and same >= 0.99 * len(want), (same, len(want))


@pytest.mark.parametrize("few", [0, 1000])
def test_edge_cases(spark, monkeypatch, few):
    """``few`` 0: all that is broadcast while it is small is joined by hash."""
    import lading.llm.line_dedup as module
    import lading.llm.similarity as shared

    monkeypatch.setattr(module, "FEW_IDS", few)
    monkeypatch.setattr(shared, "FEW_IDS", few)
    line = "the quick brown fox jumps over the lazy dog and runs away from all the hounds of the county"
    near = line.replace("lazy", "lazi")
    rows = [(5, None), (6, ""), (7, "\n\n"), (1, f"A\n{line}\n\nB"), (2, f"{near}\nb\n"), (3, line.upper() + "\r"), (None, line), (8, " \t\n" + line + "\n" + line)]
    got = run(spark, rows)
    assert got[5].text is None and (got[5].n_lines, got[5].n_dropped) == (0, 0)
    assert got[6].text == "" and got[6].n_lines == 1 and got[7].text == "\n\n"
    assert got[1].text == f"A\n{line}\n\nB" and got[2].text == "" and got[3].text == "" and got[2].n_dropped == 2
    assert got[None].text == line and got[8].text == " \t" and got[8].n_dropped == 2


def test_repeated_rows_and_empty_table(spark):
    out = line_dedup(spark.createDataFrame([(1, "same words here\nother", "x"), (1, "same words here\nother", "x"), (2, "same words here", "x")], SCHEMA)).collect()
    assert sorted((r.doc_id, r.text) for r in out) == [(1, "same words here\nother"), (1, "same words here\nother"), (2, "")]
    assert line_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_large_group_of_like_lines(spark):
    base = [f"word{i}" for i in range(40)]
    rows = [(i, " ".join([*base[: i % 40], f"x{i}", *base[i % 40 + 1 :]])) for i in range(300)]
    got = run(spark, rows)
    assert got[0].text and sum(bool(r.text) for r in got.values()) == 1


def test_signatures_estimate_jaccard():
    a = " ".join(f"w{i * 7919 % 1000}" for i in range(80))
    b = " ".join(f"w{i * 7919 % 1000}" for i in range(8, 88))
    s = signatures([a.encode(), b.encode()], 8, 256)
    u, v = (set(char_shingles(x, 8).tolist()) for x in (a, b))
    assert abs((s[0] == s[1]).mean() - len(u & v) / len(u | v)) < 0.12


def test_one_changed_character_in_the_middle_of_a_line(spark):
    lines = ["the committee met on tuesday to discuss the annual budget", "seven grey herons stood beside the frozen river at dawn today"]
    near = [x[:30] + "#" + x[31:] for x in lines]  # 5-character shingles: Jaccard above 0.8; 8-character ones: below
    docs = spark.createDataFrame([(1, "\n".join(lines), "x"), (2, "\n".join(near), "x")], SCHEMA)
    got = {r.doc_id: r for r in line_dedup(docs, SHINGLE).collect()}
    assert got[1].n_dropped == 0 and got[2].n_dropped == 2


def test_against_brute_force_with_short_shingles(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got, want = {r.doc_id: r.text for r in QUERIES["op10_line_dedup"](spark, "/root/testdata/sf0.001").collect()}, brute(rows, 5)
    same = sum(got[i] == want[i] for i in want)
    assert same >= 0.995 * len(want), (same, len(want))


def planted_pairs(rng, length, pairs=2000):
    """Pairs of random lines of about ``length`` characters with Jaccard 0.80 to 0.88."""
    out = []
    while len(out) < pairs:
        x = "".join(rng.choice(list("abcdefghijklmnop "), length))
        edits = rng.integers(0, length + 1, max(1, length // 50))
        y = list(x)
        for at in edits:
            if rng.integers(2):
                y[at : at + 1] = "z"
            else:
                y.insert(at, "z")
        y = "".join(y)
        if rng.integers(2):
            y = x[: len(x) - int(rng.integers(0, max(2, length // 8)))]
        u, v = (set(char_shingles(t, 5).tolist()) for t in (x, y))
        if x != y and 0.8 <= len(u & v) / len(u | v) <= 0.88:
            out.append((x.encode(), y.encode()))
    return out


@pytest.mark.parametrize("length", [12, 15, 20, 30, 50, 200])
def test_bands_find_planted_pairs_of_any_length(length):
    lines = [x for p in planted_pairs(np.random.default_rng(length), length, 2000 if length < 200 else 600) for x in p]
    t = records(lines, list(range(len(lines))), 5, BANDS, ROWS)["t"].reshape(-1, 2, BANDS)
    assert (t[:, 0] == t[:, 1]).any(1).mean() >= 0.998


def test_a_run_of_one_key_is_a_group_of_its_own():
    """What a task deals out of a hot key: its run apart, two of it to the key's group."""
    from functools import partial

    from lading.llm.line_dedup import _LINE, _sized
    from lading.llm.similarity import RUN, packed, _star_step
    import pyarrow as pa

    r = np.zeros(RUN + 5, _LINE)
    r["t"], r["d"] = 7 << 32, np.arange(RUN + 5)
    r["t"][-5:] = np.arange(100, 105) << 32
    one = next(packed(iter([r]), 3))
    rest = r[:3].copy()
    rest["t"], rest["d"] = 7 << 32, 10**6 + np.arange(3)
    other = next(packed(iter([rest]), 3))
    rows = pa.concat_tables([pa.Table.from_batches([x]) for x in (one, other)]).to_pylist()
    assert sum(x["part"] != 0 for x in rows) == 1
    groups = {}
    for x in rows:
        groups.setdefault((x["bucket"], x["part"]), []).append(x)
    out = pa.concat_tables([_star_step(partial(_sized, num=80, den=100), _LINE, True)(pa.Table.from_pylist(g, schema=one.schema)) for g in groups.values()]).to_pylist()
    up = dict(forest([(x["x"], x["y"]) for x in out if x["kind"] == 0]))
    assert len({up.get(k, k) for k in [*range(RUN), *(10**6 + np.arange(3)).tolist()]}) == 1
    assert {d for x in out if x["kind"] for d in x["xs"]} == {*range(RUN), *(10**6 + np.arange(3)).tolist()}
    assert sorted(x["kind"] for x in out if x["kind"]) == [1, 2] and len({x["t"] for x in out if x["kind"]}) == 1


def test_columns_named_like_the_operators_own(spark):
    docs = spark.createDataFrame([(1, "a line of words\nx", "p", 5, 6), (2, "a line of words", "q", 7, 8)], "doc_id long, text string, __gone string, own int, split int")
    out = line_dedup(docs)
    assert out.columns == ["doc_id", "text", "__gone", "own", "split", "n_lines", "n_dropped"]
    assert sorted(map(tuple, out.collect())) == [(1, "a line of words\nx", "p", 5, 6, 2, 0), (2, "", "q", 7, 8, 1, 1)]


@pytest.mark.parametrize("k", [1, 2, 5, 8])
def test_sizes_count_each_lines_own_distinct_shingles(k):
    lines = ["abababab", "a", "", "the end of one line", "line and the beginning of another", "é𝄞" * 9, "xxxxxxxxxxxx", "b"]
    sizes = np.zeros(len(lines), np.int64)
    signatures([x.encode() for x in lines], k, 12, sizes)
    padded = [x.ljust(k, "\0") for x in lines]
    assert sizes.tolist() == [len({x[i : i + k] for i in range(len(x) - k + 1)}) for x in padded]
    assert records([], [], k, BANDS, ROWS).shape == (0,)


@pytest.mark.parametrize("buckets", [1, 7, 70_000])
def test_packs_hold_every_record_and_only_long_runs_stand_apart(buckets):
    from lading.llm.line_dedup import _LINE
    from lading.llm.similarity import RUN, _runs, packed, wire

    rng = np.random.default_rng(0)
    r = np.empty(40_000, _LINE)
    r["t"], r["d"], r["n"] = rng.integers(0, 2**63, len(r), dtype=np.uint64), np.arange(len(r)), 5
    hot, like = 3 << 48, (3 << 48) + (1 << 33)  # two keys that begin alike, one with a long run
    r["t"][: RUN + 9], r["t"][RUN + 9 : 2 * RUN] = hot, like
    r = r[rng.permutation(len(r))]
    at = (r["t"] % np.uint64(buckets)).astype(np.int32)
    runs = list(_runs(r["t"].copy(), r["t"] >> np.uint64(32), at))
    assert [sorted(r["d"][x].tolist()) for x in runs] == [list(range(RUN + 9))]
    rows = [x for b in packed(iter([r]), buckets) for x in b.to_pylist()]
    apart = [np.frombuffer(x["blob"], wire(_LINE)) for x in rows if x["part"]]
    assert len(apart) == 1 and sorted(apart[0]["d"].tolist()) == list(range(RUN + 9))
    rest = {}
    for x in rows:
        if not x["part"]:
            rest |= {d: (x["bucket"], t) for t, d in zip(*(np.frombuffer(x["blob"], wire(_LINE))[f].tolist() for f in "td"))}
    want = {d: (t % buckets, t >> 32) for t, d in zip(r["t"].tolist(), r["d"].tolist())}
    assert all(want[d] == v for d, v in rest.items()) and 0 in rest
    assert len(want) - len(rest) == RUN + 9 - 2
