"""Nearest neighbours, URL filter, packing."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lading.llm import packing
from lading.llm.ann import chi_square_cdf, chi_square_quantile, nearest
from lading.llm.queries import QUERIES
from lading.llm.url_filter import FEW_BLOCKS, canonical, url_filter

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("v", T.StringType())])


def exact(rows, queries, k):
    out = {}
    for i, v in queries:
        scored = []
        for j, w in rows:
            if j != i and len(w) == len(v):
                a, b = np.array(v, float), np.array(w, float)
                scored.append((-float((a * b).sum() / (math.sqrt((a * a).sum()) * math.sqrt((b * b).sum()))), j))
        out[i] = [(j, -s) for s, j in sorted(scored)[:k]]
    return out


def test_recall_against_brute_force(spark):
    vectors = [(r.vec_id, list(map(float, r.embedding))) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    got = {}
    for r in QUERIES["op2_nearest_neighbours"](spark, "/root/testdata/sf0.01").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = exact(vectors, [v for v in vectors if v[0] % 50 == 0], 5)
    assert set(got) == set(want)
    hits = sum(len({j for j, _ in got[q]} & {j for j, _ in w}) for q, w in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))
    true = dict(vectors)
    for q, found in got.items():
        for j, s in found:
            a, b = np.array(true[q]), np.array(true[j])
            assert abs(s - a @ b / (np.linalg.norm(a) * np.linalg.norm(b))) < 1e-12


def test_copies_ties_and_unusable_vectors(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(300, 0, -1)] + [(1000, [1.0, 0.0, 0.0]), (1001, [2.0, 4.0, 6.0]), (1002, None), (1003, [0.0, 0.0, 0.0]), (1004, [float("nan"), 1.0, 1.0]), (1005, [float("inf"), 1.0, 1.0]), (None, [1.0, 2.0, 3.0]), (1006, [1.0, 2.0]), (1007, [1.0, None, 2.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], VECTORS)
    got = {}
    for r in nearest(df, df.filter("vec_id in (2, 1000, 1002, 1003, 1004, 1006)"), k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got[2] == [1, 3, 4, 5, 6] and got[1000] == [1, 2, 3, 4, 5] and set(got) == {2, 1000}
    assert nearest(df.limit(0), df).collect() == [] and nearest(df, df.limit(0)).collect() == []


def test_repeated_rows_and_ids(spark):
    same, rng = [1.0, 2.0, 3.0], np.random.default_rng(3)
    df = spark.createDataFrame([(i, v, "x") for i, v in [*[(7, same)] * 6, (8, same), (9, same), (10, [1.0, 2.0, 3.5])]], VECTORS)
    got = nearest(df, df.filter("vec_id = 10"), k=2).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [7, 8]
    got = nearest(df, df.filter("vec_id = 10"), k=5).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [7, 8, 9]
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(40)] + [(3, [1.0] * 7 + [float(j) / 50]) for j in range(10)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows * 2], VECTORS)
    ask = spark.createDataFrame([(99, [1.0] * 8, "x")], VECTORS)
    got = [(r.vec_id, r.score) for r in nearest(df, ask, k=5).orderBy("rank").collect()]
    kept = {}
    for i, s in exact([(r.vec_id, list(r.embedding)) for r in df.collect()], [(99, [1.0] * 8)], 200)[99]:
        kept.setdefault(i, s)
    assert len(got) == 5 and [i for i, _ in got] == list(kept)[:5]


def test_extreme_magnitudes_and_opposites(spark):
    """Finite vectors take part at any magnitude: components of 1e200 and 1e-200."""
    rng = np.random.default_rng(9)
    base = rng.standard_normal((60, 6))
    size = np.array([1e200, 1.0, 1e-200])[np.arange(60) % 3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base * size[:, None])], "vec_id long, embedding array<double>")
    got = {}
    for r in nearest(df, df.filter("vec_id % 7 = 0"), k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    for i, found in got.items():
        cos = unit @ unit[i]
        cos[i] = -2
        assert [j for j, _ in found] == np.argsort(-cos)[:5].tolist()
        assert all(abs(s - cos[j]) < 1e-12 for j, s in found)


def test_rounds_over_cells_and_share_verified(spark, monkeypatch):
    """Many cells and blocks on structured vectors: recall 0.9 at least, and few pairs verified."""
    import lading.llm.ann as module

    rng = np.random.default_rng(6)
    centres = rng.standard_normal((40, 32)) * 2
    v = centres[np.arange(4000) % 40] + rng.standard_normal((4000, 32)) * 0.5
    block = module.build(np.arange(4000), module.scaled(v))
    ask = np.arange(0, 4000, 40)
    of, near, score, verified = module.search(block, ask, module.scaled(v[ask]), np.full(len(ask), -np.inf), 5, chi_square_quantile(module.SURE, module.DIMS))
    print("share verified", verified / (len(ask) * 4000))
    assert verified < 0.15 * len(ask) * 4000
    monkeypatch.setattr(module, "BLOCK", 128)
    monkeypatch.setattr(module, "QUERIES", 16)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {}
    for r in nearest(df, df.filter("vec_id % 40 = 3"), k=5).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    hits = 0
    for i in range(3, 4000, 40):
        cos = unit @ unit[i]
        cos[i] = -2
        hits += len(got[i] & set(np.argsort(-cos)[:5].tolist()))
    assert hits >= 0.9 * 500


def test_several_blocks(spark, monkeypatch):
    import lading.llm.ann as module

    monkeypatch.setattr(module, "BLOCK", 100)
    monkeypatch.setattr(module, "QUERIES", 7)
    rng = np.random.default_rng(5)
    rows = [(i, (rng.standard_normal(16) + 3 * (np.arange(16) == i % 16)).tolist()) for i in range(700)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], VECTORS)
    got = {}
    for r in nearest(df, df.filter("vec_id % 30 = 0"), k=5).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    rounded = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    want = exact(rounded, [v for v in rounded if v[0] % 30 == 0], 5)
    assert sum(len(got[q] & {j for j, _ in w}) for q, w in want.items()) >= 0.9 * 5 * len(want)


def test_chi_square():
    assert abs(chi_square_cdf(15.507, 8) - 0.95) < 1e-4 and abs(chi_square_quantile(0.99, 6) - 16.812) < 1e-2 and chi_square_cdf(0, 3) == 0


def test_urls(spark):
    urls = ["http://EXAMPLE.org/es/x", "https://a.example.org/en/12?q", "x://com/fr/", "http://my.com/de/", "http://com", "no scheme", None, "http://org/", "http://notorg/", "http://example.org/es", "a://b://c/d", "http://bad.net/p/?utm_source=1#f", "", "http://u@h.org:80/x"]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    listed = spark.createDataFrame([("https://www.bad.net/p",), (None,), ("https://www.bad.net/p",), ("junk",)], "url string")
    got = {r.page_id: r for r in url_filter(df, listed).collect()}
    want = {0: "example.org/es/", 1: "example.org/en/1", 2: "com/fr/", 3: "com/de/", 4: None, 5: None, 6: None, 7: "org/", 8: None, 9: "org/", 10: None, 11: None, 12: None, 13: None}
    assert {k: r.rule for k, r in got.items()} == want
    assert got[0].verdict == "block" and got[2].verdict == "allow" and got[11].verdict == "block" and got[11].listed and got[5].verdict == "allow"
    assert (got[10].host, got[10].path) == ("b:", "//c/d") and (got[6].host, got[6].path) == ("", "") and got[0].host == "example.org"
    assert not any(r.listed for r in url_filter(df, listed.limit(0)).collect()) and url_filter(df.limit(0), listed).collect() == []


def test_bloom_passes_all_that_is_listed(spark, monkeypatch):
    import lading.llm.url_filter as module

    df = spark.range(4000).select("id", F.concat(F.lit("http://h"), (F.col("id") % 50).cast("string"), F.lit(".com/"), F.col("id").cast("string")).alias("url"))
    want = set(range(0, 4000, 3))
    for few in (FEW_BLOCKS, 0):
        monkeypatch.setattr(module, "FEW_BLOCKS", few)
        monkeypatch.setattr(module, "FEW_URLS", few)
        rows = url_filter(df, df.filter("id % 3 = 0").select("url"))
        assert {r.id for r in rows.filter("listed").collect()} == want and rows.count() == 4000


def test_canonical(spark):
    df = spark.createDataFrame([("HTTP://WWW.A.com:443/x/?b=2&utm_x=1&a=1#f",)], "u string")
    assert df.select(canonical(F.col("u"))).first()[0] == "a.com/x?a=1&b=2"


def check(lengths, caps):
    lengths = np.array(lengths)
    bins, places, sizes = packing.pack(lengths, caps)
    for b in range(len(sizes)):
        own = sorted((int(p), int(n)) for p, n in zip(places[bins == b], lengths[bins == b]))
        at = 0
        for p, n in own:
            assert p == at
            at += n
        assert at <= sizes[b] and sizes[b] == min(c for c in caps if c >= at)
    return bins, sizes


def test_packing_invariants():
    rng = np.random.default_rng(2)
    for n in (0, 1, 5, 400):
        lengths = rng.integers(1, 4097, n)
        bins, sizes = check(lengths, packing.CAPACITIES)
        assert len(bins) == n
    lengths = np.minimum(rng.zipf(1.3, 5000), 4096)
    bins, sizes = check(lengths, packing.CAPACITIES)
    assert sizes.sum() < 1.02 * lengths.sum()


def test_packing_is_best_fit():
    bins, places, sizes = packing.pack(np.array([3, 5, 2]), [8])
    assert bins.tolist() == [0, 0, 1] and sizes.tolist() == [8, 8]
    assert packing.pack(np.array([100]), [512, 4096])[2].tolist() == [512]
    bins, _, sizes = packing.pack(np.array([6, 5, 3, 2]), [8], cost=float)
    assert bins.tolist() == [0, 1, 1, 0] and sizes.tolist() == [8, 8]


def test_packing_documents(spark):
    rows = [(1, "a b c"), (2, None), (3, ""), (4, "w " * 10000), (None, "x y"), (1, "a b c"), (5, "tab\tand\nline")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, length string")
    got = packing.best_fit(df, shard=3).collect()
    per = {}
    for r in got:
        per.setdefault(r.doc_id, []).append(r)
    assert sorted(r.length for r in per[4]) == [1808, 4096, 4096] and sum(r.length for r in got) == 3 + 10000 + 2 + 3 + 3
    assert per[2][0].bin_id is None and per[3][0].length == 0 and len(per[1]) == 2
    used = {}
    for r in got:
        if r.bin_id is not None:
            used.setdefault(r.bin_id, []).append(r)
    for rs in used.values():
        assert sum(r.length for r in rs) <= rs[0].capacity and len({r.place for r in rs}) == len(rs)
    assert packing.best_fit(df.limit(0)).collect() == []


def test_token_lengths(spark):
    path = "/opt/tokenizers/byte_bpe_50k.json"
    try:
        open(path).close()
    except OSError:
        pytest.skip("no vocabulary file")
    df = spark.createDataFrame([(1, "some plain words"), (2, None), (3, "")], "doc_id long, text string")
    n = {r.doc_id: r.n_tokens for r in packing.token_lengths(df, path).collect()}
    assert n[1] > 0 and n[2] == n[3] == 0


def test_packing_against_a_naive_packer():
    """The same rules without the index of free room: each open bin is looked at for each piece."""
    rng = np.random.default_rng(8)
    for n in (0, 1, 7, 300):
        lengths = rng.integers(1, 4097, n) if n != 7 else np.array([512, 512, 512, 100, 100, 4096, 1])
        sizes = sorted(packing.CAPACITIES)
        used, opened, left = [], [], int(lengths.sum())
        for length in sorted(lengths.tolist(), reverse=True):
            fits = [(opened[b] - used[b] - length, -b) for b in range(len(used)) if opened[b] - used[b] >= length]
            if fits:
                used[-min(fits)[1]] += length
            else:
                opened.append(min((packing.training_cost(c) / min(c, left), c) for c in sizes if c >= length)[1])
                used.append(length)
            left -= length
        want = sorted((u, min(c for c in sizes if c >= u)) for u in used)
        bins, places, caps = packing.pack(lengths.astype(np.int64), packing.CAPACITIES)
        got = sorted((int(lengths[bins == b].sum()), int(caps[b])) for b in range(len(caps)))
        assert sum(u for u, _ in got) == lengths.sum() and sum(c for _, c in got) <= sum(c for _, c in want) * 1.02 and abs(len(got) - len(want)) <= max(1, len(want) // 50)


def test_rows_that_repeat_are_dealt_to_many_shards(spark):
    docs = spark.createDataFrame([(None, "a b c")] * 3000, "doc_id long, text string")
    rows = packing.best_fit(docs, shard=100).groupBy(F.expr("shiftright(bin_id, 32)").alias("shard")).count().collect()
    assert len(rows) >= 25 and max(r["count"] for r in rows) <= 200


def test_url_filter_with_columns_named_like_its_own(spark):
    docs = spark.createDataFrame([(1, "http://bad.net/p", 1, 2, 3, 4, "k")], "page_id long, url string, may int, block int, words int, hit int, canonical string")
    out = url_filter(docs, spark.createDataFrame([("https://www.bad.net/p/",)], "url string"))
    assert out.columns == ["page_id", "url", "may", "block", "words", "hit", "canonical", "host", "path", "rule", "listed", "verdict"]
    r = out.first()
    assert (r.may, r.block, r.words, r.hit, r.canonical, r.listed, r.verdict) == (1, 2, 3, 4, "k", True, "block")
