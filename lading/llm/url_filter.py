"""URL filter: host and path rules, and a list of canonical URLs looked up through a
blocked Bloom filter and an exact join. Built-in functions throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lading.llm.common import LOWER, UPPER, free_name, materialise, others, q

# The rules of the query, as (action, host and path).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: 64-bit words of a block; each listed URL sets one bit in each.
WORDS = 8
#: Bits for each listed URL.
BITS = 16
#: Blocks up to this many are broadcast (72 bytes each); a larger filter is joined.
FEW_BLOCKS = 1 << 18
#: Listed URLs up to this many are broadcast to the exact join; more are joined by hash.
FEW_URLS = 50_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z folded;
    path: from there to ``?``, ``#`` or the end. Empty for null and without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(F.coalesce(host, F.lit("")), UPPER, LOWER), F.coalesce(F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0), F.lit(""))


def canonical(url: Column) -> Column:
    """Scheme, fragment, leading ``www.``, default ports, trailing slashes, and the
    query's tracking parameters are left out; the other parameters are sorted."""
    host, path = host_and_path(url)
    host = F.regexp_replace(F.regexp_replace(host, "^www\\.", ""), ":(80|443)$", "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), "^[^?#]*\\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[^=]*|ref)(=|$)")))
    return F.concat(host, F.regexp_replace(path, "/+$", ""), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def rule_for(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits (its host or a subdomain, its path a prefix) and its
    action; null where none fits. Of equally long rules the first by name wins."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, text in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        own, _, prefix = text.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit("/" + prefix))
        rule, action = F.when(fits, text).otherwise(rule), F.when(fits, act).otherwise(action)
    return rule, action


def _bits(url: Column) -> tuple[Column, list[Column]]:
    """A hash that picks the block, and the bit of each word."""
    h = F.xxhash64(url, F.lit("bit"))
    return F.xxhash64(url), [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 7 * k).bitwiseAND(63).cast("int")) for k in range(WORDS)]


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """The filter of ``listed`` (column url): a row of words for each block in use."""
    pick, bits = _bits(F.col("url"))
    return listed.select(F.pmod(pick, F.lit(blocks)).alias("block"), *(b.alias(f"w{k}") for k, b in enumerate(bits))).groupBy("block").agg(*(F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)))


def listed_rows(rows: DataFrame, url: str, listed: DataFrame, flag: str) -> DataFrame:
    """``rows`` without the column ``url`` (canonical URLs) and with the column ``flag``:
    whether ``listed`` (column url) has it. What the Bloom filter passes goes to the exact
    join, the rest not. The columns that this needs have names that no column of ``rows`` has."""
    listed = materialise(listed.filter("url is not null").distinct(), "listed")
    count = listed.count()
    blocks = max(1, -(-count * BITS // (64 * WORDS)))
    table = bloom(listed, blocks)
    block, words, may, hit = (free_name(rows, c) for c in ("block", "words", "may", "hit"))
    pick, bits = _bits(F.col(url))
    probe = rows.withColumn(block, F.pmod(pick, F.lit(blocks)))
    table = table.select(F.col("block").alias(block), F.array(*(F.col(f"w{k}") for k in range(WORDS))).alias(words))
    probe = probe.join(F.broadcast(table) if blocks <= FEW_BLOCKS else table, block, "left")
    passes = F.col(words).isNotNull()
    for k, b in enumerate(bits):
        passes = passes & (F.col(words)[k].bitwiseAND(b) == b)
    probe = probe.withColumn(may, F.coalesce(passes, F.lit(False))).drop(block, words)
    exact = listed.select(F.col("url").alias(url), F.lit(True).alias(hit))
    sure = probe.filter(F.col(may)).join(F.broadcast(exact) if count <= FEW_URLS else exact, url, "left")
    sure = sure.withColumn(flag, F.coalesce(hit, F.lit(False))).drop(hit)
    return sure.unionByName(probe.filter(~F.col(may)).withColumn(flag, F.lit(False))).drop(may, url)


def url_filter(pages: DataFrame, listed: DataFrame, rules=RULES, url_col: str = "url", listed_col: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (the longest that fits, else null),
    ``listed`` (whether ``listed`` holds the same canonical URL) and ``verdict`` (the
    rule's action; else block if listed, else allow) after its columns.

    Nulls and texts without ``://`` have empty host and path, fit no rule and are never
    listed. Listed URLs may repeat or be null. Rows that repeat get equal results; other
    columns stay, ones named like the operator's are replaced. An empty list blocks
    nothing; an empty table gives an empty table."""
    names = others(pages, "host", "path", "rule", "listed", "verdict")
    host, path = host_and_path(q(url_col))
    real = lambda c: F.when(F.instr(c, "://") > 0, canonical(c))
    key = free_name(pages, "canonical")
    rows = pages.select(*(q(c) for c in names), real(q(url_col)).alias(key), host.alias("host"), path.alias("path"))
    found = listed_rows(rows, key, listed.select(real(q(listed_col)).alias("url")), "listed")
    rule, action = rule_for(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(action, F.when(F.col("listed"), "block").otherwise("allow"))
    return found.select(*(q(c) for c in names), "host", "path", rule.alias("rule"), "listed", verdict.alias("verdict"))
