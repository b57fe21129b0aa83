"""The corpus pipeline: language, repeated lines, near copies, benchmark passages, packing.

Every stage but the last returns the columns of ``documents``. ``run`` applies the
stages to ``documents``, each written as Parquet and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lading.llm import decontaminate as bench
from lading.llm.common import Scratch, discard, materialise
from lading.llm.language_id import UNKNOWN, classify, held_out, train
from lading.llm.line_dedup import SHINGLE, line_dedup
from lading.llm.ngram_join import ngram_join
from lading.llm.packing import best_fit

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A language is taken as recognised from this score on (chance among four is 0.25).
LEAST_SCORE = 0.3
#: Ids up to this many are broadcast (8 bytes each); more are joined by hash.
FEW_IDS = 1_000_000


def _without(docs: DataFrame, gone: DataFrame, on) -> DataFrame:
    """``docs`` that match no row of ``gone``, which is broadcast if it is small."""
    gone = materialise(gone.distinct(), "gone")
    side = F.broadcast(gone) if gone.count() <= FEW_IDS else gone.hint("shuffle_hash")
    return docs.join(side, on, "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or whose language isn't recognised, go."""
    kernel = train(docs.filter(~held_out()))
    return classify(docs, kernel).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of like lines in all documents one stays; documents that lose all their text go."""
    out = line_dedup(docs, SHINGLE).filter((F.col("n_dropped") == 0) | F.col("text").rlike("\\S"))
    return out.withColumn("n_chars", F.when(F.col("n_dropped") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(COLUMNS)


def _before(docs: DataFrame, whole: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents of ``docs`` whose text isn't the one in ``whole``:
    their texts as ``whole`` has them. Only ids and hashes are compared."""
    keyed = lambda df: df.select("doc_id", F.xxhash64("text").alias("th"))
    now = materialise(keyed(docs).distinct(), "now")
    changed = materialise(keyed(whole).join(now, ["doc_id", "th"], "left_anti").join(now.select("doc_id"), "doc_id", "left_semi").distinct(), "changed")
    side = F.broadcast(changed) if changed.count() <= FEW_IDS else changed.hint("shuffle_hash")
    return whole.select("doc_id", "text", F.xxhash64("text").alias("th")).join(side, ["doc_id", "th"], "left_semi").select("doc_id", "text")


def _there(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, in whatever file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by links (five words, similarity 0.8) the one with the smallest
    id stays. Documents link by their texts as they are, or as they stood in ``documents``
    before lines were taken out of them, if ``sf_dir`` has that table: what line dedup left
    of a near copy goes too."""
    texts = docs.select("doc_id", "text")
    if _there(spark, path := f"{sf_dir}/documents.parquet"):
        texts = texts.unionByName(_before(docs, spark.read.parquet(path).select("doc_id", "text")))
    found = materialise(ngram_join(texts, n=5, num=80, den=100), "near")
    rest = _without(docs, found.filter("component_id <> doc_id").select("doc_id"), ["doc_id"])
    twice = materialise(docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "twice")
    if twice.isEmpty():
        return rest.select(COLUMNS)
    single = _without(rest, twice, ["doc_id"])
    return single.select(COLUMNS).unionByName(rest.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(COLUMNS))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or a shorter item, go."""
    found = bench.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), width=10, text_hash="th")
    gone = found.filter("contaminated").select(F.col("doc_id").alias("gone_id"), "th")
    keyed = docs.withColumn("th", F.xxhash64("text"))
    gone = gone.withColumnRenamed("th", "gone_th")
    return _without(keyed, gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("th") == F.col("gone_th"))).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in bins of the permitted lengths."""
    return best_fit(docs)


STAGES = [("language id", language), ("line dedup", lines), ("ngram jaccard join", near_copies), ("benchmark decontamination", benchmark), ("best-fit packing", packing)]

#: SQL can't express the language classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with Scratch(spark) as scratch:
            docs = scratch.keep(materialise(stage(spark, before, sf_dir), "stage-" + name.replace(" ", "-")))
        discard(before)  # written by this loop, and read for the last time
        before = docs
    return docs
