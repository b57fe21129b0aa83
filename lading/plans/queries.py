"""One query for each operator of the archive engine, over archives packed from the
test tables, and the SQL that gives the same rows from the tables themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lading.functions import digests, names, values
from lading.operators import diagnostics as diag
from lading.operators import extraction, integrity, links, members as ops
from lading.plans.pack import compressed, concatenated, packed
from lading.sources import archive as src
from lading.sources.splits import split_decode
from lading.sources.detect import by_extension, by_magic, detect
from lading.sources.volumes import joined_volumes, volume_sets

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "f10_duplicates_by_digest"
#: Documents, pages or turns that share an archive.
SHARE = 200


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _documents(spark: SparkSession, sf: str, end: str = "zip") -> DataFrame:
    d = _table(spark, sf, "documents")
    return d.select(F.concat(F.lit("docs-"), F.expr(f"doc_id div {SHARE}"), F.lit(f".{end}")).alias("archive"), F.concat_ws("/", "lang", F.concat(F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".txt"))).alias("name"), F.encode("text", "utf-8").alias("data"))


def _zips(spark: SparkSession, sf: str, kind: str = "zip") -> DataFrame:
    return packed(_documents(spark, sf), kind)


def _tars(spark: SparkSession, sf: str, kind: str = "tar") -> DataFrame:
    return packed(_documents(spark, sf, kind), kind)


def _own(end: str = "zip") -> str:
    return f"""d AS (SELECT 'docs-' || (doc_id // {SHARE}) || '.{end}' AS archive_id, lang || '/' || lpad(doc_id::VARCHAR, 9, '0') || '.txt' AS name,
  encode(text) AS data, octet_length(encode(text)) AS size, lang, text, doc_id FROM documents),
m AS (SELECT *, row_number() OVER (PARTITION BY archive_id ORDER BY name) - 1 AS member_id FROM d)"""


_LIST = f"WITH {_own()} SELECT archive_id, member_id::INT AS member_id, name, size::BIGINT AS size, 'file' AS type FROM m"


@query(_LIST)
def a05_members(spark, sf):
    return src.members(_zips(spark, sf)).select("archive_id", "member_id", "name", "size", "type")


@query(f"WITH {_own()} SELECT archive_id, count(*)::INT AS member_count, 'zip' AS container, 'certain' AS confidence, 'indexed' AS listing, 'direct' AS access FROM m GROUP BY archive_id")
def a14_archives(spark, sf):
    return src.archives(_zips(spark, sf)).select("archive_id", "member_count", "format.container", "confidence", "cost.listing", "cost.access")


@query(f"WITH {_own()} SELECT archive_id, count(*)::INT AS member_count FROM m GROUP BY archive_id UNION ALL SELECT DISTINCT replace(archive_id, '.zip', '.tar'), NULL::INT FROM m")
def a07_index_only_count(spark, sf):
    both = _zips(spark, sf).unionByName(_tars(spark, sf))
    return src.archives(both, listing="index_only").select("archive_id", "member_count")


@query("WITH t AS (SELECT 'x' AS a, lang || '/' || (doc_id % 7) AS name, doc_id FROM documents) SELECT name, max(doc_id)::INT AS member_id FROM t WHERE name = 'en/3' GROUP BY name")
def a09_get_last_wins(spark, sf):
    d = _table(spark, sf, "documents").select(F.lit("x").alias("archive_id"), F.concat_ws("/", "lang", (F.col("doc_id") % 7).cast("string")).alias("name"), F.col("doc_id").cast("int").alias("member_id"))
    return ops.get(d, "en/3").select("name", "member_id")


@query(f"WITH {_own()} SELECT archive_id, member_id::INT AS member_id FROM m WHERE member_id % 3 = 0")
def a10_contains(spark, sf):
    m = src.members(_zips(spark, sf))
    wanted = m.select("archive_id", (F.col("member_id") * 3).alias("member_id"))
    return ops.contains(m, wanted)


@query(f"WITH {_own()} SELECT archive_id, member_id::INT AS member_id, sha256(data) AS sha256, 'ok' AS verdict FROM m")
def a11_read_content(spark, sf):
    return src.content(_zips(spark, sf)).select("archive_id", "member_id", F.sha2("data", 256).alias("sha256"), "verdict")


@query(f"WITH {_own()} SELECT archive_id, member_id::INT AS member_id, text FROM m WHERE lang = 'fr'")
def a12_selected_content(spark, sf):
    z = _zips(spark, sf)
    wanted = src.members(z).filter(F.col("name").startswith("fr/"))
    return src.content(z, wanted=wanted).select("archive_id", "member_id", F.decode("data", "utf-8").alias("text"))


@query("SELECT 'doc-' || doc_id || '.gz' AS path, sha256(encode(text)) AS sha256 FROM documents")
def a02_open_stream(spark, sf):
    d = _table(spark, sf, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".gz")).alias("path"), F.encode("text", "utf-8").alias("data"))
    return src.decompressed(compressed(d, "gz")).select("path", F.sha2("data", 256).alias("sha256"))


@query()
def a17_format_availability(spark, sf):
    return src.format_table(spark)


_KINDS = {"zip": ("zip", "uncompressed"), "tar": ("tar", "uncompressed"), "tar.gz": ("tar", "gz"), "tar.bz2": ("tar", "bz2"), "tar.xz": ("tar", "xz"), "tar.zst": ("tar", "zst"), "tar.lz4": ("tar", "lz4")}


@query(" UNION ALL ".join(f"SELECT DISTINCT 'docs-' || (doc_id // {SHARE}) || '.{k}' AS path, '{c}' AS container, '{s}' AS stream, '{'certain' if s == 'uncompressed' else 'probable'}' AS confidence, false AS extension_conflict FROM documents" for k, (c, s) in _KINDS.items()))
def a04_detect_format(spark, sf):
    found = None
    for kind in _KINDS:
        part = detect(_zips(spark, sf) if kind == "zip" else _tars(spark, sf, kind))
        found = part if found is None else found.unionByName(part)
    return found.select("path", "format.container", "format.stream", "confidence", "extension_conflict")


@query(f"SELECT DISTINCT 'docs-' || (doc_id // {SHARE}) || '.zip' AS path, 'zip' AS container FROM documents")
def d01_exact_magic(spark, sf):
    return _zips(spark, sf).select("path", by_magic(F.col("content"))["container"].alias("container"))


@query("SELECT url || e AS path, c AS container, s AS stream FROM pages, (VALUES ('.zip', 'zip', 'uncompressed'), ('.TAR.GZ', 'tar', 'gz'), ('.tgz', 'tar', 'gz'), ('.gz', 'raw_stream', 'gz'), ('.tbz2', 'tar', 'bz2'), ('.txt', NULL, NULL)) v(e, c, s)")
def d02_extension_map(spark, sf):
    ends = F.explode(F.array(*map(F.lit, (".zip", ".TAR.GZ", ".tgz", ".gz", ".tbz2", ".txt"))))
    p = _table(spark, sf, "pages").select("url", ends.alias("e")).select(F.concat("url", "e").alias("path"))
    found = by_extension(F.col("path"))
    return p.select("path", found["container"].alias("container"), found["stream"].alias("stream"))


@query()
def d03_content_probes(spark, sf):
    d = _table(spark, sf, "documents").filter("text is not null").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("path"), F.encode("text", "utf-8").alias("data"))
    found = None
    for stream in ("zz", "lzma"):
        part = detect(compressed(d, stream)).groupBy("format.stream", "confidence").count().withColumn("packed", F.lit(stream))
        found = part if found is None else found.unionByName(part)
    return found


@query(f"SELECT DISTINCT 'docs-' || (doc_id // {SHARE}) || '.zip' AS path, true AS extension_conflict FROM documents")
def d07_extension_conflict(spark, sf):
    wrong = packed(_documents(spark, sf, "zip"), "tar")
    return detect(wrong).select("path", "extension_conflict")


@query(f"WITH {_own('tar')} SELECT archive_id, member_id::INT AS member_id, name, size::BIGINT AS size, 416::INT AS mode, 1577836800::BIGINT AS mtime FROM m")
def b08_tar_members(spark, sf):
    return src.members(_tars(spark, sf)).select("archive_id", "member_id", "name", "size", "mode", F.col("modified.utc").cast("long").alias("mtime"))


def _round_trip(kind: str):
    end = kind if kind.startswith("tar") else "zip"

    def run(spark, sf):
        z = _tars(spark, sf, kind) if kind.startswith("tar") else _zips(spark, sf, kind)
        return src.content(z).select("archive_id", "name", F.sha2("data", 256).alias("sha256"))

    run.__name__ = {"zip-stored": "c01_stored", "zip-bz2": "b07_zip_bzip2", "zip-lzma": "c07_zip_lzma", "tar.gz": "c02_tar_gzip", "tar.bz2": "c03_tar_bzip2", "tar.xz": "c04_tar_xz", "tar.zst": "c09_tar_zstd", "tar.lz4": "c10_tar_lz4"}[kind]
    query(f"WITH {_own(end)} SELECT archive_id, name, sha256(data) AS sha256 FROM m")(run)


for _kind in ("zip-stored", "zip-bz2", "zip-lzma", "tar.gz", "tar.bz2", "tar.xz", "tar.zst", "tar.lz4"):
    _round_trip(_kind)


def _stream(stream: str, name: str):
    def run(spark, sf):
        d = _table(spark, sf, "documents").filter("text <> ''").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(f".{stream}")).alias("path"), F.encode("text", "utf-8").alias("data"))
        return src.content(compressed(d, stream)).select("archive_id", "name", F.sha2("data", 256).alias("sha256"))

    run.__name__ = name
    query(f"SELECT 'doc-' || doc_id || '.{stream}' AS archive_id, 'doc-' || doc_id AS name, sha256(encode(text)) AS sha256 FROM documents WHERE text <> ''")(run)


for _s, _n in (("gz", "b16_single_gzip"), ("xz", "c04_single_xz"), ("lzma", "c06_lzma_alone"), ("zz", "c08_zlib"), ("br", "c11_brotli"), ("lz", "c05_lzip")):
    _stream(_s, _n)


@query("SELECT lower(host || '.7z') AS base, count(*)::INT AS volumes, true AS complete FROM (SELECT DISTINCT regexp_extract(url, '://([^/]+)', 1) AS host, v FROM pages, range(1, 4) r(v)) GROUP BY host")
def b02_volume_sets(spark, sf):
    p = _table(spark, sf, "pages").select(F.regexp_extract("url", "://([^/]+)", 1).alias("host")).distinct()
    files = p.select("host", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("v")).select(F.concat("host", F.lit(".7z."), F.lpad(F.col("v").cast("string"), 3, "0")).alias("path"))
    return volume_sets(files).select("base", "volumes", "complete")


@query(f"WITH {_own()} SELECT archive_id || '.001' AS path, count(*)::INT AS member_count, 3::INT AS volumes FROM m GROUP BY archive_id")
def b03_joined_volumes(spark, sf):
    z = _zips(spark, sf)
    n = F.length("content")
    cut = F.array(*(F.struct(F.lit(i + 1).alias("part"), F.substring("content", F.call_function("div", n * i, F.lit(3)).cast("int") + 1, F.call_function("div", n * (i + 1), F.lit(3)).cast("int") - F.call_function("div", n * i, F.lit(3)).cast("int")).alias("content")) for i in range(3)))
    parts = z.select("path", F.inline(cut)).select(F.concat("path", F.lit("."), F.lpad(F.col("part").cast("string"), 3, "0")).alias("path"), "content")
    whole = joined_volumes(parts)
    return src.archives(whole).select(F.col("archive_id").alias("path"), "member_count").join(whole.select("path", "volumes"), "path")


_NAMES = "SELECT page_id, regexp_replace(url, '^[a-z]+:/', '') AS name, CASE page_id % 3 WHEN 0 THEN 'directory' ELSE 'file' END AS type FROM pages"


def _url_names(spark, sf):
    return _table(spark, sf, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+:/", "").alias("name"), F.when(F.col("page_id") % 3 == 0, "directory").otherwise("file").alias("type"))


@query(f"WITH n AS ({_NAMES}), s AS (SELECT *, list_filter(string_split(replace(name, '?', '/./'), '/'), lambda x: x <> '' AND x <> '.') AS p FROM n) SELECT page_id, '/' || array_to_string(p, '/') || CASE type WHEN 'directory' THEN '/' ELSE '' END AS name FROM s")
def e08_normal_name(spark, sf):
    n = _url_names(spark, sf)
    return n.select("page_id", names.normal_name(F.replace("name", F.lit("?"), F.lit("/./")), F.col("type")).alias("name"))


#: A page's path, and the path of the next one relative to its folder: ``..`` for each of its folders.
_LINKS = """p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS name FROM pages WHERE page_id IS NOT NULL AND url IS NOT NULL),
l AS (SELECT a.page_id, a.name, repeat('../', (a.page_id % 5)::INT) || './' || b.name AS target FROM p a JOIN p b ON b.page_id = a.page_id + 1)"""


def _links(spark, sf):
    p = _table(spark, sf, "pages").filter("page_id is not null and url is not null").select("page_id", F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("name"))
    after = p.select((F.col("page_id") - 1).alias("page_id"), F.col("name").alias("next"))
    return p.join(after, "page_id").select("page_id", "name", F.concat(F.expr("repeat('../', cast(page_id % 5 as int))"), F.lit("./"), "next").alias("target"))


@query(f"""WITH {_LINKS}, s AS (SELECT *, list_filter(string_split(regexp_replace(regexp_replace(name, '/+$', ''), '[^/]*$', '') || target, '/'), lambda x: x <> '' AND x <> '.') AS w FROM l),
r AS (SELECT page_id, list_reduce(list_transform(w, lambda x: [x]), lambda a, x: CASE WHEN x[1] = '..' AND len(a) > 0 AND a[-1] <> '..' THEN a[:-2] ELSE list_concat(a, x) END, []::VARCHAR[]) AS w FROM s)
SELECT page_id, CASE WHEN len(w) > 0 AND w[1] <> '..' THEN array_to_string(w, '/') END AS resolved FROM r""")
def e09_link_target_name(spark, sf):
    return _links(spark, sf).select("page_id", names.link_target_name(F.col("name"), F.col("target"), F.lit("symlink")).alias("resolved"))


@query("""WITH b AS (SELECT page_id, regexp_extract(regexp_replace(url, '/+$', ''), '[^/]*$', 0) AS b FROM pages)
SELECT page_id, CASE WHEN b IS NULL OR b IN ('', '.', '..') THEN 'data' WHEN ends_with(lower(b), '.html') AND length(b) > 5 THEN b[:-6] WHEN ends_with(lower(b), '#top') AND length(b) > 4 THEN b[:-5] ELSE b || '.uncompressed' END AS name FROM b""")
def e10_inferred_name(spark, sf):
    return _table(spark, sf, "pages").select("page_id", names.inferred_name(F.col("url"), (".HTML", "#top")).alias("name"))


@query("SELECT doc_id, regexp_matches(coalesce(text, ''), '[\u061c\u200e\u200f\u202a-\u202e\u2066-\u2069]') OR doc_id % 97 = 0 AS bidi FROM documents")
def e11_bidi_warning(spark, sf):
    marked = F.when(F.col("doc_id") % 97 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("\u2067"))).otherwise(F.coalesce("text", F.lit("")))
    return _table(spark, sf, "documents").select("doc_id", names.has_bidi(marked).alias("bidi"))


@query("SELECT archive_id, name, count(*)::BIGINT AS n FROM (WITH " + _own() + " SELECT * FROM m) WHERE (name LIKE 'fr/%' OR name LIKE '%7.txt') AND NOT name LIKE 'de/%' GROUP BY ALL")
def e02_globs(spark, sf):
    return ops.globbed(src.members(_zips(spark, sf)), ["fr/*", "*7.txt"], ["de/[0-9]*"]).groupBy("archive_id", "name").agg(F.count("*").alias("n"))


@query("SELECT * FROM (VALUES (1::INT, 'xx/*'), (3::INT, '*.bin')) v(position, pattern)")
def e03_unmatched_includes(spark, sf):
    return ops.unmatched_includes(src.members(_zips(spark, sf)), ["en/*", "xx/*", "*.txt", "*.bin"])


@query(f"WITH {_own()} SELECT count(*)::BIGINT AS n FROM m WHERE name LIKE 'en/%'")
def e04_count_selected(spark, sf):
    return ops.globbed(src.members(_zips(spark, sf)), ["en/*"]).agg(F.count("*").alias("n"))


@query(f"WITH {_own()} SELECT archive_id, name FROM m WHERE name = 'en/000000001.txt' OR member_id = 0")
def e01_selector(spark, sf):
    m = src.members(_zips(spark, sf))
    return ops.selected(m, names=["en/000000001.txt"], ids=m.filter("member_id = 0")).select("archive_id", "name")


@query("SELECT o_orderkey, make_timestamp(1577836800000000 + o_orderkey * 1000003) AS at FROM orders")
def e15_filetime(spark, sf):
    ticks = (F.lit(1577836800000000) + F.col("o_orderkey") * 1000003 + F.lit(11644473600000000)) * 10
    return _table(spark, sf, "orders").select("o_orderkey", values.filetime_to_timestamp(ticks).cast("timestamp_ntz").alias("at"))


@query("SELECT o_orderkey, lower(printf('%08x', o_orderkey)) AS digest FROM orders")
def e19_crc32_digest(spark, sf):
    return _table(spark, sf, "orders").select("o_orderkey", F.lower(F.hex(values.crc32_digest(F.col("o_orderkey")))).alias("digest"))


#: Sentences of documents as names: they end in dots, hold spaces, colons and slashes.
_SAID = "s AS (SELECT doc_id, unnest(string_split(replace(coalesce(text, ''), ', ', '/'), chr(10))) AS name FROM documents)"


def _said(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", F.explode(F.split(F.replace(F.coalesce("text", F.lit("")), F.lit(", "), F.lit("/")), "\n")).alias("name"))


@query(f"""WITH {_SAID}, c AS (SELECT doc_id, name, list_transform(string_split(name, '/'), lambda x: CASE WHEN x IN ('', '.', '..') THEN x ELSE rtrim(x, '. ') END) AS w, string_split(name, '/') AS o FROM s)
SELECT doc_id, CASE WHEN len(list_filter(list_zip(w, o), lambda z: z[1] = '' AND z[2] NOT IN ('', '.', '..'))) = 0 THEN array_to_string(w, '/') END AS name FROM c""")
def e22_without_trailing_dots(spark, sf):
    return _said(spark, sf).select("doc_id", names.without_trailing_dots(F.col("name")).alias("name"))


_DEVICES = "'CON', 'PRN', 'AUX', 'NUL', " + ", ".join(f"'{d}{i}'" for d in ("COM", "LPT") for i in range(1, 10))


@query(f"""WITH {_SAID}, c AS (SELECT doc_id, list_filter(string_split(replace(name, chr(92), '/'), '/'), lambda x: x <> '') AS w FROM s)
SELECT doc_id, CASE WHEN len(list_filter(w, lambda x: upper(trim(string_split(x, '.')[1])) IN ({_DEVICES}))) > 0 THEN 'reserved_name' WHEN len(list_filter(w, lambda x: contains(x, ':'))) > 0 THEN 'colon' END AS reason FROM c""")
def e23_unportable(spark, sf):
    return _said(spark, sf).select("doc_id", names.unportable(F.col("name")).alias("reason"))


@query("""WITH m AS (SELECT l_orderkey, l_linenumber, (l_orderkey * 37 + l_linenumber) % 4096 AS mode FROM lineitem)
SELECT l_orderkey, l_linenumber, least(mode & 438, 420)::INT AS strict, (mode & 511)::INT AS standard, concat(CASE WHEN mode & 256 > 0 THEN 'r' ELSE '-' END, CASE WHEN mode & 128 > 0 THEN 'w' ELSE '-' END, CASE WHEN mode & 64 > 0 THEN 'x' ELSE '-' END,
 CASE WHEN mode & 32 > 0 THEN 'r' ELSE '-' END, CASE WHEN mode & 16 > 0 THEN 'w' ELSE '-' END, CASE WHEN mode & 8 > 0 THEN 'x' ELSE '-' END, CASE WHEN mode & 4 > 0 THEN 'r' ELSE '-' END, CASE WHEN mode & 2 > 0 THEN 'w' ELSE '-' END, CASE WHEN mode & 1 > 0 THEN 'x' ELSE '-' END) AS shown FROM m""")
def e24_modes(spark, sf):
    mode, kind = ((F.col("l_orderkey") * 37 + F.col("l_linenumber")) % 4096).cast("int"), F.lit("file")
    return _table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", values.strict_mode(mode, kind).alias("strict"), values.standard_mode(mode, kind).alias("standard"), values.format_mode(mode).alias("shown"))


@query(f"""WITH {_LINKS}, s AS (SELECT *, regexp_replace(regexp_replace(name, '/+$', ''), '[^/]*$', '') || target AS path FROM l),
d AS (SELECT page_id, list_filter(string_split(path, '/'), lambda x: x <> '' AND x <> '.') AS w FROM s)
SELECT page_id, CASE WHEN list_min(list_transform(range(1, len(w) + 1), lambda i: len(w[1:i]) - 2 * len(list_filter(w[1:i], lambda x: x = '..')))) < 0 THEN 'link_escape' END AS reason FROM d
UNION ALL SELECT page_id, CASE WHEN regexp_matches(url, '^[A-Za-z]:') OR starts_with(url, '/') THEN 'absolute' WHEN list_contains(string_split(url, '/'), '..') THEN 'traversal' END FROM pages
UNION ALL SELECT page_id, 'absolute' FROM p UNION ALL SELECT page_id, 'traversal' FROM p""")
def e25_unsafe(spark, sf):
    reason = lambda name, kind, target=None: names.unsafe(name, F.lit(kind), F.lit(None).cast("string") if target is None else target).alias("reason")
    p = _table(spark, sf, "pages")
    named = p.filter("page_id is not null and url is not null").select("page_id", F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("name"))
    out = _links(spark, sf).select("page_id", reason(F.col("name"), "symlink", F.col("target"))).unionByName(p.select("page_id", reason(F.col("url"), "file")))
    return out.unionByName(named.select("page_id", reason(F.concat(F.lit("/"), "name"), "file"))).unionByName(named.select("page_id", reason(F.concat("name", F.lit("/../x")), "file")))


@query("SELECT doc_id, (CASE WHEN octet_length(encode(text)) = length(text) THEN length(text) ELSE 4 * length(text) END)::INT AS metadata_bytes FROM documents")
def e26_metadata_bytes(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", values.text_bytes(F.col("text")).cast("int").alias("metadata_bytes"))


@query(f"WITH {_own()} SELECT archive_id, '--  rw-r--r--  ' || CASE WHEN length(size::VARCHAR) < 10 THEN lpad(size::VARCHAR, 10, ' ') ELSE size::VARCHAR END || '  2020-01-01 00:00  ' || name AS line FROM m")
def e29_member_lines(spark, sf):
    return src.members(_zips(spark, sf)).select("archive_id", values.member_line().alias("line"))


@query(f"SELECT DISTINCT 'docs-' || (doc_id // {SHARE}) || '.tar.gz' AS archive_id, 'solid (listing requires decompression; 1 solid block)' AS access FROM documents")
def e30_access_summary(spark, sf):
    return src.archives(_tars(spark, sf, "tar.gz")).select("archive_id", values.access_summary(F.col("cost")).alias("access"))


@query(f"WITH {_own()} SELECT archive_id, member_id::INT AS member_id, base64(encode(name)) AS raw FROM m")
def e31_raw_name_base64(spark, sf):
    return src.members(_zips(spark, sf)).select("archive_id", "member_id", F.base64("raw_name").alias("raw"))


@query(f"WITH {_own()} SELECT archive_id, count(*)::BIGINT AS ok, 0::BIGINT AS error, 0::BIGINT AS unverified FROM m GROUP BY archive_id")
def f11_test_archives(spark, sf):
    return integrity.test_summary(src.content(_zips(spark, sf)))


@query(f"WITH {_own()} SELECT archive_id, count(*)::BIGINT AS members, count(*)::BIGINT AS matching FROM m GROUP BY archive_id")
def f07_crc32_combine(spark, sf):
    z = _zips(spark, sf)
    stored = src.members(z).select("archive_id", "member_id", F.conv(F.hex(F.col("hashes")["crc32"]), 16, 10).cast("long").alias("stored"))
    both = stored.join(integrity.member_checksums(src.content(z)), ["archive_id", "member_id"], "left")
    return both.groupBy("archive_id").agg(F.count("*").alias("members"), F.count_if((F.col("stored") == F.col("crc32")) | ((F.col("stored") == 0) & F.col("crc32").isNull())).alias("matching"))


@query()
def f02_blake2sp(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", F.lower(F.hex(digests.blake2sp_of(F.encode("text", "utf-8")))).alias("blake2sp"))


@query("SELECT doc_id, sha256(encode(text)) AS sha256, md5(text) AS md5 FROM documents")
def f03_digests(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"))


@query(f"WITH {_own()} SELECT size::BIGINT AS size, count(*)::BIGINT AS copies, min(archive_id || '!' || name) AS first FROM m GROUP BY size, sha256(data) HAVING count(*) > 1")
def f10_duplicates_by_digest(spark, sf):
    return integrity.duplicates_by_digest(ops.with_current(src.members(_zips(spark, sf)))).select("size", "copies", "first")


@query(f"WITH {_own()} SELECT size::BIGINT AS size, sha256(data) AS sha256, count(*)::BIGINT AS copies FROM m GROUP BY size, sha256(data) HAVING count(*) > 1")
def f10_confirmed_duplicates(spark, sf):
    z = _zips(spark, sf)
    return integrity.confirmed_duplicates(ops.with_current(src.members(z)), z).select("size", "sha256", "copies")


_TURNS = "SELECT 'c' || (conv_id // 100) AS archive_id, role || '/' || (conv_id % 100) || '.txt' AS name, turn, conv_id, text, row_number() OVER (PARTITION BY conv_id // 100 ORDER BY conv_id, turn, text) - 1 AS member_id FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL"


def _turns(spark, sf):
    """Conversations as archives: one for each hundred, members that share names."""
    from pyspark.sql.window import Window

    c = _table(spark, sf, "conversations").filter("conv_id is not null and turn is not null")
    number = F.row_number().over(Window.partitionBy(F.expr("conv_id div 100")).orderBy("conv_id", "turn", "text")) - 1
    return c.select(
        F.concat(F.lit("c"), F.expr("conv_id div 100").cast("string")).alias("archive_id"), number.cast("int").alias("member_id"), F.concat("role", F.lit("/"), (F.col("conv_id") % 100).cast("string"), F.lit(".txt")).alias("name"),
        F.lit(True).alias("is_current"), F.when(F.length("text") % 5 == 0, "symlink").otherwise("file").alias("type"), F.length("text").cast("long").alias("size"), F.lit(None).cast("long").alias("compressed_size"), F.lit(420).alias("mode"),
        F.when(F.length("text") % 5 == 0, F.concat(F.lit("../user/"), (F.col("conv_id") % 100).cast("string"), F.lit(".txt"))).alias("link_target"),
    )


@query(f"WITH t AS ({_TURNS}) SELECT archive_id, member_id::INT AS member_id, name, member_id = max(member_id) OVER (PARTITION BY archive_id, name) AS is_current FROM t")
def j01_last_entry_wins(spark, sf):
    return ops.with_current(_turns(spark, sf)).select("archive_id", "member_id", "name", "is_current")


@query(f"""WITH t AS ({_TURNS}), l AS (SELECT *, 'user/' || (conv_id % 100) || '.txt' AS to_name FROM t WHERE length(text) % 5 = 0)
SELECT l.archive_id, l.member_id::INT AS member_id, max(CASE WHEN m.member_id < l.member_id THEN m.member_id END)::INT AS before, max(m.member_id)::INT AS last FROM l LEFT JOIN t m ON m.archive_id = l.archive_id AND m.name = l.to_name GROUP BY ALL""")
def j02_link_lookups(spark, sf):
    t = _turns(spark, sf)
    hard = t.withColumn("type", F.when(F.col("type") == "symlink", "hardlink").otherwise(F.col("type"))).withColumn("link_target", F.regexp_replace("link_target", r"^\.\./", ""))
    before = links.link_steps(hard, forward=False).withColumnRenamed("target_id", "before")
    last = links.link_steps(t).withColumnRenamed("target_id", "last")
    return before.join(last, ["archive_id", "member_id"])


@query(f"""WITH RECURSIVE t AS ({_TURNS}), l AS (SELECT archive_id, member_id, 'user/' || (conv_id % 100) || '.txt' AS to_name FROM t WHERE length(text) % 5 = 0),
s AS (SELECT l.archive_id, l.member_id, max(m.member_id) AS target FROM l LEFT JOIN t m ON m.archive_id = l.archive_id AND m.name = l.to_name GROUP BY ALL),
w AS (SELECT archive_id, member_id, target AS goal, [member_id] AS path FROM s UNION ALL SELECT w.archive_id, w.member_id, s.target, list_append(w.path, w.goal) FROM w JOIN s ON s.archive_id = w.archive_id AND s.member_id = w.goal WHERE NOT list_contains(w.path, w.goal))
SELECT archive_id, member_id::INT AS member_id, max(CASE WHEN NOT EXISTS (SELECT 1 FROM s WHERE s.archive_id = w.archive_id AND s.member_id = w.goal) THEN goal END)::INT AS link_target_id FROM w GROUP BY ALL""")
def j04_link_closure(spark, sf):
    return links.with_link_targets(_turns(spark, sf)).filter("type = 'symlink'").select("archive_id", "member_id", "link_target_id")


@query(f"WITH t AS ({_TURNS}) SELECT archive_id, name, list_sort(list(member_id::INT)) AS ids FROM t GROUP BY ALL")
def j05_name_index(spark, sf):
    return _turns(spark, sf).groupBy("archive_id", "name").agg(F.array_sort(F.collect_list("member_id")).alias("ids"))


@query(f"WITH {_own('tar.gz')} SELECT archive_id, member_id::INT AS member_id, coalesce(sum(size) OVER (PARTITION BY archive_id ORDER BY member_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS block_offset FROM m")
def j06_block_offsets(spark, sf):
    return ops.block_offsets(src.members(_tars(spark, sf, "tar.gz"))).select("archive_id", "member_id", "block_offset")


@query(f"WITH {_own('tar.gz')} SELECT archive_id, 0::INT AS block, count(*)::BIGINT AS files, sum(size)::BIGINT AS bytes FROM m GROUP BY archive_id")
def j07_blocks(spark, sf):
    return ops.blocks(src.members(_tars(spark, sf, "tar.gz")))


@query(f"WITH t AS ({_TURNS}) SELECT archive_id, count(DISTINCT role)::BIGINT AS roots, count(DISTINCT role) = 1 AS single_root FROM (SELECT archive_id, string_split(name, '/')[1] AS role FROM t) GROUP BY archive_id")
def g14_top_names(spark, sf):
    return ops.top_names(_turns(spark, sf))


@query(f"WITH {_own()} SELECT archive_id, sum(size)::BIGINT AS total_size, count(*)::BIGINT AS files FROM m GROUP BY archive_id")
def g12_total_size(spark, sf):
    return ops.total_size(src.members(_zips(spark, sf)))


_PLAN = f"""WITH t AS ({_TURNS}), k AS (SELECT *, length(text) % 5 = 0 AS link, member_id = max(member_id) OVER (PARTITION BY archive_id, name) AS cur FROM t)"""


@query(_PLAN + " SELECT archive_id, member_id::INT AS member_id, CASE WHEN NOT cur THEN 'superseded' ELSE 'write' END AS action, CASE WHEN link THEN 420 ELSE 420 END::INT AS final_mode FROM k")
def g01_extraction_plan(spark, sf):
    return extraction.planned(_turns(spark, sf)).select("archive_id", "member_id", "action", "final_mode")


@query("""WITH d AS (SELECT 'a' || (doc_id // 500) AS archive_id, (doc_id % 500)::INT AS member_id, CASE WHEN doc_id % 2 = 0 THEN 'Read' ELSE 'READ' END || (doc_id % 25) // 2 AS name FROM documents)
SELECT archive_id, member_id, CASE WHEN member_id <> last THEN 'superseded' WHEN row_number() OVER (PARTITION BY archive_id, lower(name), member_id = last ORDER BY member_id) > 1 THEN 'collides' ELSE 'write' END AS action
FROM (SELECT *, max(member_id) OVER (PARTITION BY archive_id, name) AS last FROM d)""")
def g04_collisions(spark, sf):
    name = F.concat(F.when(F.col("doc_id") % 2 == 0, "Read").otherwise("READ"), F.expr("(doc_id % 25) div 2").cast("string"))
    d = _table(spark, sf, "documents").select(
        F.concat(F.lit("a"), F.expr("doc_id div 500").cast("string")).alias("archive_id"), (F.col("doc_id") % 500).cast("int").alias("member_id"), name.alias("name"), F.lit(True).alias("is_current"), F.lit("file").alias("type"),
        F.lit(1).cast("long").alias("size"), F.lit(None).cast("long").alias("compressed_size"), F.lit(None).cast("int").alias("mode"), F.lit(None).cast("string").alias("link_target"),
    )
    return extraction.planned(d, overwrite="skip").select("archive_id", "member_id", "action")


@query(f"""WITH {_own()}, r AS (SELECT archive_id, member_id, count(*) OVER w AS running_members, sum(octet_length(encode(name)) + length(name)) OVER w AS running_bytes FROM m WINDOW w AS (PARTITION BY archive_id ORDER BY member_id))
SELECT archive_id, member_id::INT AS member_id, running_members::BIGINT AS running_members, running_bytes::BIGINT AS running_bytes, running_members > 50 AS crossed FROM r""")
def h03_listing_audit(spark, sf):
    return ops.listing_audit(src.members(_zips(spark, sf)), most_members=50).select("archive_id", "member_id", "running_members", "running_bytes", "crossed")


@query(f"WITH {_own()} SELECT 'name_normalized' AS code, count(*)::BIGINT AS n FROM m")
def h02_diagnostic_counts(spark, sf):
    d = _documents(spark, sf).withColumn("name", F.concat(F.lit("./"), "name"))
    return diag.counts(src.diagnostics(packed(d, "zip")))


@query("SELECT CASE WHEN size IS NULL THEN '-' ELSE size::VARCHAR END AS shown, count(*)::BIGINT AS n FROM (SELECT nullif(o_orderkey % 10, 3) AS size FROM orders) GROUP BY ALL")
def e28_format_size(spark, sf):
    size = F.nullif(F.col("o_orderkey") % 10, F.lit(3))
    return _table(spark, sf, "orders").select(values.format_size(size).alias("shown")).groupBy("shown").agg(F.count("*").alias("n"))


@query("SELECT doc_id, replace(lower(nfc_normalize(regexp_replace(replace(text, chr(92), '/'), '/+$', ''))), 'ß', 'ss') AS key FROM documents")
def e20_collision_key(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", names.collision_key(F.col("text"), "strict").alias("key"))


@query("SELECT doc_id, replace(replace(replace(replace(text, chr(92), '\\\\'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t') AS shown FROM documents")
def e27_escaped_names(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", names.escaped("text").alias("shown"))


@query("""SELECT container || stream AS format, CASE WHEN container = 'raw_stream' THEN stream WHEN stream = 'uncompressed' THEN container ELSE container || '.' || stream END AS extension, label AS display_name FROM (VALUES ('zip', 'uncompressed', 'ZIP'), ('tar', 'gz', 'TAR_GZ'), ('raw_stream', 'lz', 'LZIP'), ('7z', 'uncompressed', 'SEVEN_Z'), ('raw_stream', 'gz', 'GZ')) v(container, stream, label)""")
def e18_format_labels(spark, sf):
    f = spark.createDataFrame([("zip", "uncompressed"), ("tar", "gz"), ("raw_stream", "lz"), ("7z", "uncompressed"), ("raw_stream", "gz")], "container string, stream string")
    fmt = F.struct("container", "stream")
    return f.select(F.concat("container", "stream").alias("format"), names.file_extension(fmt).alias("extension"), names.display_name(fmt).alias("display_name"))


def _split(stream: str, name: str):
    def run(spark, sf):
        files = concatenated(_documents(spark, sf, stream).filter("octet_length(data) > 0"), stream)
        return split_decode(files).select(F.col("path").alias("archive_id"), "split", "start", F.sha2("data", 256).alias("sha256"))

    run.__name__ = name
    query(f"""WITH {_own(stream)}, n AS (SELECT *, row_number() OVER w - 1 AS split, coalesce(sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM m WHERE size > 0 WINDOW w AS (PARTITION BY archive_id ORDER BY name))
SELECT archive_id, split::INT AS split, start::BIGINT AS start, sha256(data) AS sha256 FROM n""")(run)


_split("xz", "c17_split_decode_xz")
_split("lz", "c17_split_decode_lzip")


@query("SELECT o_orderkey, CASE o_orderkey % 2 WHEN 0 THEN o_orderdate::TIMESTAMP ELSE o_orderdate::TIMESTAMP - INTERVAL 5 HOUR END AS at FROM orders")
def e14_modified_utc(spark, sf):
    wall, even = F.col("o_orderdate").cast("timestamp_ntz"), F.col("o_orderkey") % 2 == 0
    utc = F.col("o_orderdate").cast("timestamp")
    time = F.struct(F.when(~even, wall).alias("wall"), F.when(even, utc).alias("utc"))
    return _table(spark, sf, "orders").select("o_orderkey", values.modified_utc(time, "Etc/GMT-5").cast("timestamp_ntz").alias("at"))


@query(f"WITH {_own()} SELECT archive_id, sum(size)::BIGINT AS bytes_decoded, count(*)::BIGINT AS members_read FROM m GROUP BY archive_id")
def a15_io_stats(spark, sf):
    z = _zips(spark, sf)
    return integrity.io_stats(src.members(z), src.content(z)).select("archive_id", "bytes_decoded", "members_read")


@query(f"WITH t AS ({_TURNS}) SELECT archive_id, count(*) FILTER (WHERE length(text) % 5 = 0)::BIGINT AS links, count(*) FILTER (WHERE length(text) % 5 <> 0)::BIGINT AS files FROM t GROUP BY archive_id")
def e05_type_predicates(spark, sf):
    kind = values.type_predicates(F.col("type"))
    return _turns(spark, sf).groupBy("archive_id").agg(F.count_if(kind["is_link"]).alias("links"), F.count_if(kind["is_file"]).alias("files"))


from lading.plans import formats as _formats  # noqa: E402, F401  registers its queries
