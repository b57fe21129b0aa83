import re

import pytest
from pyspark.sql import types as T

from lading.llm.components import components, forest
from lading.llm.ngram_join import ngram_join

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("component_id", T.StringType())])


def words(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def brute(rows, n, num, den):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    ids = sorted(sets)
    links = []
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if den * min(len(sets[a]), len(sets[b])) < num * max(len(sets[a]), len(sets[b])):
                continue
            common = len(sets[a] & sets[b])
            if common and den * common >= num * len(sets[a] | sets[b]):
                links.append((a, b))
    top = dict(forest(links))
    return {i: (len(sets[i]), top.get(i, i)) for i in ids}


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(df, **kw).collect()}


def test_against_brute_force_on_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert run(spark, rows, n=4, num=85, den=100) == brute(rows, 4, 85, 100)


@pytest.mark.parametrize("few", [0, 1000])
def test_a_group_whose_leader_links_with_few(spark, monkeypatch, few):
    """Chains: neighbours link, distant members don't, so no star holds the group."""
    import lading.llm.similarity as shared

    monkeypatch.setattr(shared, "FEW_IDS", few)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(40):
        w = base[:]
        w[: 2 * k] = [f"v{i}" for i in range(2 * k)]
        rows.append((k * 7 + 3, " ".join(w)))
    rows += [(1000 + i, rows[5][1]) for i in range(30)]
    got = run(spark, rows, n=4, num=85, den=100)
    assert got == brute(rows, 4, 85, 100)
    assert len({c for _, c in got.values()}) == 1


def test_edge_cases(spark):
    long = " ".join(f"x{i}" for i in range(30000))
    rows = [(1, None), (2, ""), (3, "  \t\n"), (4, "One Two"), (5, "one two"), (6, "one\ttwo three"), (7, long), (8, long + " end"), (9, "É b c d e f"), (10, "é b c d e f"), (None, "one two")]
    got = run(spark, rows, n=4, num=85, den=100)
    assert got[1] == got[2][:1] + (1,) == (0, 1) and got[3] == (0, 3)
    assert got[4] == (1, 4) and got[5] == (1, 4) and got[6] == (1, 6)
    assert got[7] == (29997, 7) and got[8] == (29998, 7)
    assert got[9][1] == 9 and got[10][1] == 10 and got[None] == (1, None)


def test_repeated_rows_and_empty_table(spark):
    got = ngram_join(spark.createDataFrame([(1, "a b c d e", "x"), (1, "a b c d e", "x"), (2, "a b c d e", "x")], SCHEMA)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (1, 1), (2, 1)]
    assert ngram_join(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("links", [[], [(1, 1)], [(5, 3), (3, 9), (2, 8), (8, 2)], [(i, i + 1) for i in range(200)], [(0, i) for i in range(1, 300)]])
def test_components(spark, links):
    df = spark.createDataFrame(links, "a long, b long").repartition(4)
    got = {(r.node, r.component) for r in components(df).collect()}
    assert got == {x for x in forest(links) if x[0] != x[1]}


def test_filters_never_lose_a_pair():
    import numpy as np

    from lading.llm.ngram_join import _admit, suffix_summary

    rng = np.random.default_rng(0)
    lost = pruned = 0
    for _ in range(3000):
        base = rng.integers(0, 2**64, rng.integers(1, 80), dtype=np.uint64)
        x = np.unique(base)
        y = np.unique(np.where(rng.random(len(base)) < rng.choice([0.02, 0.1, 0.5]), rng.integers(0, 2**64, len(base), dtype=np.uint64), base))
        common = np.intersect1d(x, y)
        if not len(common):
            continue
        px, py = np.searchsorted(x, common[0]), np.searchsorted(y, common[0])
        links = 100 * len(common) >= 85 * (len(x) + len(y) - len(common))
        ok = bool(_admit(len(x), px, suffix_summary(x), len(y), py, suffix_summary(y), 85, 100))
        lost += links and not ok
        pruned += not links and not ok
    assert lost == 0 and pruned > 500


def test_copies_in_many_tasks(spark):
    """Copies and near copies spread over tasks: the same components as brute force."""
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base)) for i in range(30)] + [(100 + i, " ".join([*base[:59], f"z{i}"])) for i in range(40)] + [(200 + i, " ".join([*base[: 40], *(f"y{i}_{k}" for k in range(20))])) for i in range(10)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(df, n=4, num=85, den=100).collect()}
    assert got == brute(rows, 4, 85, 100)
