"""The pipeline's stages on planted cases."""

import time
from pathlib import Path

import corpus_pipeline as cp
import pytest
from lading.llm.common import shared_folder
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def test_stage_order_and_columns(spark):
    assert [n for n, _ in cp.STAGES] == ["language id", "line dedup", "ngram jaccard join", "benchmark decontamination", "best-fit packing"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = docs
    for name, stage in cp.STAGES[:-1]:
        kept = cp.materialise(stage(spark, kept, "/root/testdata/sf0.001"), "test")
        assert kept.columns == docs.columns, name
        assert 0 < kept.count() <= docs.count()
    rows = cp.STAGES[-1][1](spark, kept, "/root/testdata/sf0.001").collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in kept.select("doc_id").collect()}


@pytest.mark.parametrize("few", [0, 1000])
def test_planted_documents(spark, tmp_path, monkeypatch, few):
    """``few`` 0: all that is broadcast while it is small is joined by hash."""
    monkeypatch.setattr(cp, "FEW_IDS", few)
    words = [f"{a}{b}" for a in ("the", "of", "in", "on", "er", "st", "an") for b in ("ing", "ed", "ly", "er", "est", "ion", "al", "ic")]
    own = lambda k, n=60: " ".join(f"{words[(k * 31 + i * i + i * k) % len(words)]}{chr(97 + (k + i) % 26)}" for i in range(n))
    passage = " ".join(f"bench{i}" for i in range(12))
    near = own(3).split()
    near[30] = "changed"
    rows = [(1, own(1)), (2, own(2)), (3, own(3)), (4, " ".join(near)), (5, own(2)), (6, own(6) + " " + passage + " " + own(7, 20)), (7, "12345 !!"), (8, None), (9, own(1) + "\n" + own(9)), (10, own(10)), (10, own(10))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    spark.createDataFrame([(1, passage), (2, "another item that nothing holds at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    began = time.time()
    got = cp.run(spark, str(tmp_path))
    ids = {r.doc_id for r in got.collect()}
    assert ids == {1, 2, 3, 9, 10}
    assert {r.doc_id: r.length for r in got.collect()}[9] == 60
    left = [p for p in (Path(shared_folder(spark).removeprefix("file://")) / "lading" / spark.sparkContext.applicationId).iterdir() if p.name.startswith(("stage-", "near", "gone", "now"))]
    assert [p.name.startswith("stage-best-fit") for p in left if p.stat().st_mtime >= began] == [True]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, str(tmp_path)) if docs.columns[:1] == ["doc_id"] else docs
    assert docs.collect() == []


def test_no_fragments_of_near_copies(spark, tmp_path):
    """Near copies of many lines, of which line dedup leaves only the changed ones; repeated rows and a very long text."""
    word = lambda k: f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676 % 26)}ing"
    line = lambda k, n: " ".join(word(k * 977 + n * 131 + i * 17 * (k + 3)) for i in range(14))
    body = lambda k: [line(k, n) for n in range(30)]
    near = lambda k: [" ".join(word(5 + i * (k + 41)) for i in range(14)) if n == 11 else x for n, x in enumerate(body(k))]
    rows = [(k, "\n".join(body(k))) for k in range(8)] + [(100 + k, "\n".join(near(k))) for k in range(8)] + [(300, "\n".join(line(50 + n % 97, n) for n in range(3000)))] * 2
    rows.append((400, "\n".join(body(2)[:3] + [line(900 + n, n) for n in range(20)])))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept = cp.materialise(cp.lines(spark, docs, str(tmp_path)), "test")
    assert 100 in {r.doc_id for r in kept.collect()}  # fragments are there
    left = cp.near_copies(spark, kept, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in left) == [*range(8), 300, 400]
    shared = cp.near_copies(spark, docs, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in shared) == [*range(8), 300, 400]


def test_extra_columns_and_nulls(spark, tmp_path):
    """Other columns of documents are left out; null ids, texts and languages don't stop a stage."""
    text = "the quick brown fox of the north jumps over all the lazy dogs in the yard of the old mill"
    rows = [(1, text, "en", "s", 5, 1), (None, text, None, None, None, 2), (3, None, "en", "s", 0, 3), (4, "", "en", "s", 0, 4), (5, "der schnelle fuchs und die alten hunde sind in dem garten", "de", "s", 9, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, th int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "nothing of it")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = docs
    for name, stage in cp.STAGES[:-1]:
        kept = cp.materialise(stage(spark, kept, str(tmp_path)), "test")
        assert kept.columns == cp.COLUMNS, name
    assert {r.doc_id for r in kept.collect()} >= {1, 5}
