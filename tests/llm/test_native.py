"""Decontamination and licence scan: brute force, edge cases, proximity."""

import hashlib
import re

import pytest
from compare import same
from pyspark.sql import types as T

from lading.llm.decontaminate import decontaminate, near_matches, postings, proximity_matches
from lading.llm.license_scan import BASE, license_scan
from lading.llm.queries import ORACLES, QUERIES

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("words", T.StringType()), T.StructField("term", T.LongType())])


def words(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS)


@pytest.mark.parametrize("name", ["op3_benchmark_decontamination", "op4_license_scan", "op8_url_filter"])
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_against_sql(spark, name, sf):
    folder = f"/root/testdata/{sf}"
    same(QUERIES[name](spark, folder), ORACLES[name], folder)


def test_windows_by_brute_force(spark):
    items = [(1, "a b c d e f g h i j k l"), (2, "short Item"), (3, None), (4, ""), (5, "the the the the the the the the the the the"), (None, "q r"), (6, "solo"), (2, "short Item")]
    rows = [(1, "x A B C D E F G H I J K L y"), (2, "a b c d e f g h i"), (3, None), (4, ""), (5, "the " * 25), (6, "SHORT, item! solo"), (7, "q r"), (None, "zz solo"), (8, "b c d e f g h i j k b c d e f g h i j k l"), (8, "solo"), (8, "solo")]
    got = decontaminate(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"), width=10)

    def brute(t):
        w, hit, ids = words(t), set(), set()
        for i, text in items:
            v = words(text)
            n = min(10, len(v))
            if i is None or not n:
                continue
            for g in {tuple(v[k : k + n]) for k in range(len(v) - n + 1)}:
                for s in range(len(w) - n + 1):
                    if tuple(w[s : s + n]) == g:
                        hit |= set(range(s, s + n))
                        ids.add(str(i))
        return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)

    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(((i, *brute(t)) for i, t in rows), key=key)


@pytest.mark.parametrize("few", [5, 1000])
def test_blocks_of_windows_and_empty_tables(spark, monkeypatch, few):
    import lading.llm.decontaminate as module

    items = spark.createDataFrame([(i, f"alpha{i} beta{i} gamma{i}") for i in range(30)], "item_id long, text string")
    d = docs(spark, [(i, f"x alpha{i} beta{i} gamma{i} y") for i in range(30)])
    monkeypatch.setattr(module, "BLOCK_WINDOWS", 7)
    monkeypatch.setattr(module, "FEW_TERMS", few)
    rows = decontaminate(d, items, proximity=True).collect()
    assert len(rows) == 30 and all(r.n_near_items == 1 for r in rows) and all((r.n_words, r.n_hit, r.n_items) == (5, 3, 1) for r in rows)
    assert decontaminate(docs(spark, []), items).collect() == []
    assert not any(r.contaminated for r in decontaminate(d, items.limit(0)).collect())


def test_proximity(spark):
    d = docs(spark, [(1, "cat a b dog"), (2, "dog cat"), (3, "cat " + "x " * 20 + "dog"), (4, "cat")])
    index = postings(d, spark.createDataFrame([("cat",), ("dog",)], "term string"), 2)
    got = proximity_matches(index, spark.createDataFrame([(7, "cat", "dog")], "item long, term1 string, term2 string"), 3)
    assert {(r.id, r.pos1, r.pos2) for r in got.collect()} == {(1, 0, 3), (2, 1, 0)}


def test_a_passage_with_changed_words_is_near(spark):
    item = [f"w{k}" for k in range(30)]
    changed = [f"x{k}" if k % 8 == 4 else w for k, w in enumerate(item)]
    rows = [(1, " ".join(changed)), (2, "nothing of it"), (3, " ".join(item)), (4, None), (1, " ".join(changed)), (5, "w4 w12 w20 w28 " * 9)]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, "other words")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate(docs(spark, rows), bench, proximity=True).collect()}
    assert (got[1].contaminated, got[1].n_near_items, got[3].contaminated, got[3].n_near_items) == (False, 1, True, 1)
    assert got[1].n_near > 0 and (got[2].n_near, got[2].n_near_items, got[4].n_near) == (0, 0, 0)
    index = postings(docs(spark, [(1, "cat a dog dog cat"), (2, "dog x x x x cat")]), spark.createDataFrame([("cat",), ("dog",)], "term string"), 3)
    pairs = spark.createDataFrame([(7, "cat", "dog"), (8, "dog", "dog")], "item long, term1 string, term2 string")
    assert {tuple(r) for r in near_matches(index, pairs, 3).collect()} == {tuple(r) for r in proximity_matches(index, pairs, 3).collect()}


def test_licences_by_brute_force(spark):
    rows = [(1, "All Rights Reserved. all rights reserved"), (2, None), (3, ""), (4, "CC BY-NC 4.0"), (5, "GNU General Public License, version 3"), (6, "general public"), (7, "Apache License, Version 2.0"), (None, "MIT License"), (8, "x " * 50000 + "CC-BY"), (9, "version 3 of the general public license"), (8, "cc by")]
    got = license_scan(docs(spark, rows)).collect()
    labels = {(r.doc_id, r.n_words): r.labels for r in got}
    for r in got:
        t = next(t for i, t in rows if i == r.doc_id and len(words(t)) == r.n_words)
        w = words(t)
        starts = sorted((k, label) for p, label in BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        assert (r.n_base, r.first_word, r.last_word) == (len(starts), starts[0][0] if starts else None, starts[-1][0] if starts else None)
        assert r.base_labels == ",".join(sorted({x for _, x in starts}))
    assert labels[(4, 5)] == "cc-by,cc-by-nc" and labels[(5, 6)] == "gpl,gpl-3.0" and labels[(7, 5)] == "apache-2.0" and labels[(None, 2)] == "mit" and labels[(9, 7)] == "gpl"
    assert next(r for r in got if r.doc_id == 6).score == pytest.approx(0.0) or next(r for r in got if r.doc_id == 6).score > 0
    assert license_scan(docs(spark, [])).collect() == []


def test_licence_bodies_without_their_names(spark):
    """Whole bodies, one without its first half, one with a changed word, and text that only shares words with them."""
    from lading.llm.license_scan import BODIES, body_words

    rows, want = [], {}
    for n, (label, (text, _)) in enumerate(BODIES.items()):
        rows.append((n, "some code before it " * 3 + text + " and code after"))
        want[n] = label
    mit = body_words(BODIES["mit"][0])
    rows += [(100, " ".join(mit[: len(mit) // 4])), (101, " ".join(["changed" if k == 40 else w for k, w in enumerate(mit)])), (102, " ".join(sorted(mit))), (103, "software permission distribute copies"), (None, " ".join(mit)), (104, " ".join(mit * 300))]
    got = {r.doc_id: r for r in license_scan(docs(spark, rows)).collect()}
    assert {n: label in got[n].labels.split(",") for n, label in want.items()} == dict.fromkeys(want, True)
    assert "mit" in got[101].labels and "mit" in got[None].labels and got[104].labels == "mit" and got[101].score > 0
    assert got[102].labels == "" and got[103].labels == "" and got[100].labels == ""


def test_templates_of_many_places_and_steps(spark):
    """Phrases that follow each other, far from and near to cell borders, against a naive search."""
    templates = {"two": ("a b", "c"), "three": ("a b", "c", "d e")}
    rng = __import__("random").Random(4)
    rows = [(i, " ".join(rng.choice(["a", "b", "a b", "c", "d e", "x", "x x x"]) for _ in range(60 if i < 40 else 4000))) for i in range(42)]
    got = {r.doc_id: r.labels for r in license_scan(docs(spark, rows), base={"zz": "zz"}, templates=templates, bodies={}, reach=5).collect()}

    def follows(w, start, rest):
        return not rest or any(w[k : k + len(rest[0].split())] == rest[0].split() and follows(w, k, rest[1:]) for k in range(start + 1, min(len(w), start + 6)))

    for i, t in rows:
        w = t.split()
        want = [n for n, ps in templates.items() if any(w[k : k + 2] == ["a", "b"] and follows(w, k, ps[1:]) for k in range(len(w)))]
        assert got[i] == ",".join(sorted(want)), i
