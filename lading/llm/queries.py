"""The queries of the training-data operators and their SQL, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lading.llm.ann import nearest
from lading.llm.decontaminate import decontaminate
from lading.llm.language_id import classify, held_out
from lading.llm.language_id import train as train_language
from lading.llm.license_scan import BASE, BODIES, FILE_WORDS, LETTERS, REACH, SLACK, TEMPLATES, VOTES, body_words, license_scan
from lading.llm.line_dedup import SHINGLE, line_dedup
from lading.llm.ngram_join import ngram_join
from lading.llm.packing import best_fit
from lading.llm.secret_scan import digests, findings
from lading.llm.secret_scan import train as train_secrets
from lading.llm.toxicity import score_toxicity, train_on_labels
from lading.llm.url_filter import url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity as labelled: 0 harmless, 1 toxic, 2 toxic and of low quality."""
    docs = _table(spark, sf_dir, "documents")
    grade = F.when(F.col("toxic") == 0, 0).when(F.coalesce(F.col("quality"), F.lit(1)) == 0, 2).when(F.col("toxic").isNotNull(), 1)
    model = train_on_labels(docs, _table(spark, sf_dir, "labels").select("doc_id", grade.alias("grade")), "grade")
    return score_toxicity(docs.select("doc_id", "text"), model).drop("text")


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact matches, and the proximity matches of each window's two rarest terms in columns of their own."""
    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), width=10, proximity=True)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(_table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return digests(findings(docs, train_secrets(docs)))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out())
    kernel = train_language(docs.filter(~F.col("held_out")))
    return classify(docs.drop("lang"), kernel).drop("text")


#: First labels of hosts whose pages the list of the URL filter names.
LISTED_LABELS = "^(www\\.)?(ads|track|ads-track|cheap-pills|casino|win-prize)[.-]"


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: the canonical URLs of pages on hosts named like advertising and spam."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.filter(F.regexp_extract("url", "://([^/?#]*)", 1).rlike(LISTED_LABELS)).select("url")
    return url_filter(pages, listed).select("page_id", "host", "path", "rule", "verdict", "listed")


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(_table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(_table(spark, sf_dir, "documents"), SHINGLE).select("doc_id", "n_lines", "n_dropped", "text")


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_nearest_neighbours, op3_benchmark_decontamination, op4_license_scan, op5_best_fit_packing, op6_secret_scan, op7_language_id, op8_url_filter, op9_ngram_jaccard_join, op10_line_dedup)}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _licence_sql() -> str:
    phrases = sorted({*BASE, *(p for ps in TEMPLATES.values() for p in ps), *(p for _, ps in BODIES.values() for p in ps)})
    words = ", ".join(f"('{p}', {len(p.split())}, {k}, '{w}')" for p in phrases for k, w in enumerate(p.split()))
    base = ", ".join(f"('{p}', '{label}')" for p, label in BASE.items())
    single = ", ".join(f"('{ps[0]}', '{label}')" for label, ps in TEMPLATES.items() if len(ps) == 1)
    double = ", ".join(f"('{ps[0]}', '{ps[1]}', '{label}')" for label, ps in TEMPLATES.items() if len(ps) == 2)
    bodies = ", ".join(f"('{label}', {k}, '{w}')" for label, (text, _) in BODIES.items() for k, w in enumerate(body_words(text)) if len(w) >= LETTERS)
    keys = ", ".join(f"('{label}', '{p}', {len(ps)}, {len(body_words(text))})" for label, (text, ps) in BODIES.items() for p in ps)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
pw(phrase, len, k, term) AS (VALUES {words}),
bw(label, k, term) AS (VALUES {bodies}),
bk(label, phrase, n, len) AS (VALUES {keys}),
t AS (SELECT r, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM d),
hit AS (SELECT * FROM t WHERE term IN (SELECT term FROM pw UNION SELECT term FROM bw)),
df AS (SELECT term, count(DISTINCT (d.doc_id, d.w)) AS df FROM hit JOIN d USING (r) GROUP BY term),
ranked AS (SELECT pw.*, row_number() OVER (PARTITION BY phrase ORDER BY coalesce(df, 0), k) = 1 AS rarest FROM pw LEFT JOIN df USING (term)),
votes AS (SELECT r, phrase, pos - k AS start, len, count(DISTINCT k) AS found, bool_or(rarest) AS rarest FROM hit JOIN ranked USING (term) WHERE pos >= k GROUP BY ALL),
places AS (SELECT * FROM votes WHERE rarest),
whole AS (SELECT r, phrase, start FROM places WHERE found = len),
b AS (SELECT r, label, start FROM whole JOIN (VALUES {base}) v(phrase, label) USING (phrase)),
rare AS (SELECT r, term FROM (SELECT DISTINCT r, term, df FROM hit JOIN df USING (term) WHERE term IN (SELECT term FROM bw)) QUALIFY row_number() OVER (PARTITION BY r ORDER BY df, term) <= {FILE_WORDS}),
aligned AS (SELECT r, label, pos - k AS start, count(DISTINCT k) AS found FROM hit JOIN rare USING (r, term) JOIN bw USING (term) GROUP BY ALL HAVING count(DISTINCT k) >= {VOTES}),
body AS (SELECT a.r, a.label, a.found FROM aligned a JOIN bk ON bk.label = a.label JOIN whole x ON x.r = a.r AND x.phrase = bk.phrase AND x.start BETWEEN a.start - {SLACK} AND a.start + bk.len + {SLACK}
      GROUP BY a.r, a.label, a.start, a.found HAVING count(DISTINCT bk.phrase) = max(bk.n)),
m AS (SELECT r, label FROM b UNION SELECT r, label FROM whole JOIN (VALUES {single}) v(phrase, label) USING (phrase) UNION SELECT r, label FROM body
      UNION SELECT x.r, label FROM whole x JOIN (VALUES {double}) v(one, two, label) ON x.phrase = one JOIN whole y ON y.r = x.r AND y.phrase = two AND y.start > x.start AND y.start <= x.start + {REACH})
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN (SELECT r, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, array_to_string(list_sort(list(DISTINCT label)), ',') AS base_labels FROM b GROUP BY r) USING (r)
LEFT JOIN (SELECT r, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM m GROUP BY r) USING (r)
LEFT JOIN (SELECT r, max(s) AS score FROM (SELECT r, found / len AS s FROM places UNION ALL SELECT r, least(found / {FILE_WORDS}, 1) FROM body) GROUP BY r) USING (r)"""


ORACLES: dict[str, str] = {
    "op3_benchmark_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, n, list_slice(w, o + 1, o + n) AS g FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(len(w) - least(len(w), 10) + 1)) AS o FROM i WHERE len(w) > 0)),
g AS (SELECT r, n, o, list_slice(w, o + 1, o + n) AS g FROM (SELECT r, w, n, unnest(range(len(w) - n + 1)) AS o FROM d JOIN (SELECT DISTINCT n FROM win) ON len(w) >= n)),
hit AS (SELECT r, o, n, item_id FROM g JOIN win USING (g, n)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(o, o + n)) AS p FROM hit) GROUP BY r),
ids AS (SELECT r, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS ids FROM hit GROUP BY r),
place AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, w, unnest(range(len(w) - least(len(w), 10) + 1)) AS o FROM i WHERE len(w) > 1),
each AS (SELECT item_id, o, k, w[o + k + 1] AS term FROM (SELECT *, unnest(range(n)) AS k FROM place)),
t AS (SELECT r, unnest(w) AS term, generate_subscripts(w, 1) AS p FROM d),
freq AS (SELECT term, count(*) AS freq FROM t WHERE term IN (SELECT term FROM each) GROUP BY term),
two AS (SELECT item_id, o, term FROM each LEFT JOIN freq USING (term) QUALIFY row_number() OVER (PARTITION BY item_id, o ORDER BY coalesce(freq, 0), term, k) <= 2),
pairs AS (SELECT DISTINCT item_id, one, two FROM (SELECT item_id, o, min(term) AS one, max(term) AS two FROM two GROUP BY item_id, o)),
near AS (SELECT x.r, item_id, x.p AS p1, y.p AS p2 FROM pairs JOIN t x ON x.term = one JOIN t y ON y.r = x.r AND y.term = two AND y.p <> x.p AND abs(y.p - x.p) <= 10),
around AS (SELECT r, count(DISTINCT p) AS n_near, count(DISTINCT item_id) AS n_near_items FROM (SELECT r, item_id, unnest([p1, p2]) AS p FROM near) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  coalesce(n_near, 0)::BIGINT AS n_near, coalesce(n_near_items, 0)::BIGINT AS n_near_items
FROM d LEFT JOIN words USING (r) LEFT JOIN ids USING (r) LEFT JOIN around USING (r)""",
    "op4_license_scan": _licence_sql(),
    "op8_url_filter": r"""
WITH p AS (SELECT row_number() OVER () AS r, page_id, url, CASE WHEN contains(url, '://') THEN url[strpos(url, '://') + 3:] ELSE '' END AS rest FROM pages),
h AS (SELECT r, page_id, url, rest, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest[length(regexp_extract(rest, '^[^/?#]*')) + 1:], '^[^?#]*') AS path FROM p),
c AS (SELECT *, CASE WHEN contains(url, '://') THEN regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '')
  || CASE WHEN len(q) > 0 THEN '?' || array_to_string(list_sort(q), '&') ELSE '' END END AS canon
  FROM (SELECT *, [x FOR x IN string_split(regexp_extract(coalesce(url, ''), '^[^?#]*\?([^#]*)', 1), '&') IF x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref)(=|$)')] AS q FROM h)),
listed AS (SELECT DISTINCT canon FROM c WHERE canon IS NOT NULL AND regexp_matches(regexp_extract(url, '://([^/?#]*)', 1), '^(www\.)?(ads|track|ads-track|cheap-pills|casino|win-prize)[.-]')),
rules(rule, domain, prefix, action) AS (VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'), ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
best AS (SELECT r, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action FROM c JOIN rules ON (host = domain OR ends_with(host, '.' || domain)) AND starts_with(path, prefix) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN listed.canon IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, listed.canon IS NOT NULL AS listed
FROM c LEFT JOIN best USING (r) LEFT JOIN listed USING (canon)""",
}
