"""Benchmark decontamination by a positional inverted index of the training texts.
Built-in functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lading.llm.common import WORD_GAP, lowered, materialise, q, word_array

#: Windows that are broadcast at once (about 100 bytes each); more are taken in blocks, whichever items they are of.
BLOCK_WINDOWS = 200_000
#: Terms up to this many are broadcast to the documents' words; more are joined by hash.
FEW_TERMS = 500_000


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, words): the words are an attribute, so that they are split once. The
    outer generators keep wordless rows and spare a filter that would split again."""
    return docs.select(q(id_col).alias("id"), F.xxhash64(q(text_col)).alias("th"), F.explode_outer(F.array(F.split(lowered(q(text_col)), WORD_GAP))).alias("words")).withColumn("words", F.array_remove("words", ""))


def _bounded(table: DataFrame) -> DataFrame:
    """``table`` of terms, to be broadcast if it is small."""
    return F.broadcast(table) if table.count() <= FEW_TERMS else table


def term_counts(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How often each of ``terms`` (column term) occurs in all texts."""
    found = docs.select(F.explode_outer(F.split(lowered(q(text_col)), WORD_GAP)).alias("term"))
    if terms.count() <= FEW_TERMS:
        return found.join(F.broadcast(terms), "term").groupBy("term").agg(F.count("*").alias("freq"))
    return found.groupBy("term").agg(F.count("*").alias("freq")).join(terms, "term")


def postings(docs: DataFrame, terms: DataFrame, reach: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index: a row (id, th, n_words, term, pos, base, near) for each occurrence of
    one of ``terms``, where ``near`` holds the words from ``base`` up to ``reach`` after
    ``pos``; and a row with null term for each document."""
    rows = _documents(docs, id_col, text_col).select("id", "th", "words", F.posexplode_outer("words").alias("pos", "word"))
    rows = rows.join(_bounded(terms.select(F.col("term"))), F.col("word") == F.col("term"), "left")
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    rows = rows.filter(F.col("term").isNotNull() | first)
    base = F.greatest(F.col("pos") - reach, F.lit(0))
    near = F.slice("words", base + 1, 2 * reach + 1)
    posting = F.struct("term", F.col("pos"), base.alias("base"), near.alias("near"))
    document = F.struct(F.lit(None).cast("string").alias("term"), F.lit(None).cast("int").alias("pos"), F.lit(None).cast("int").alias("base"), F.lit(None).cast("array<string>").alias("near"))
    kinds = F.when(first & F.col("term").isNotNull(), F.array(document, posting)).when(first, F.array(document)).otherwise(F.array(posting))
    return rows.select("id", "th", F.size("words").alias("n_words"), F.inline_outer(kinds))


def windows(items: DataFrame, freq: DataFrame, width: int) -> DataFrame:
    """(item, o, w, words, q1, q2): windows of the items with the places of their rarest
    two terms by ``freq`` (q2 is null in a window of one word)."""
    spread = items.select("item", "words", F.least(F.size("words"), F.lit(width)).alias("w")).filter("w > 0")
    spread = spread.select("item", "w", "words", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("w"))).alias("o"))
    spread = spread.select("item", "o", "w", F.slice("words", F.col("o") + 1, F.col("w")).alias("words")).distinct()
    each = spread.select("item", "o", F.posexplode("words").alias("k", "term")).join(freq, "term", "left")
    order = Window.partitionBy("item", "o").orderBy(F.coalesce("freq", F.lit(0)), "term", "k")
    two = each.withColumn("r", F.row_number().over(order)).filter("r <= 2").groupBy("item", "o").agg(F.max(F.when(F.col("r") == 1, F.col("k"))).alias("k1"), F.max(F.when(F.col("r") == 2, F.col("k"))).alias("k2"))
    return spread.join(two, ["item", "o"]).select("item", "o", "w", "words", (F.col("o") + F.col("k1")).alias("q1"), (F.col("o") + F.col("k2")).alias("q2"))


def _hits(index: DataFrame, wins: DataFrame) -> DataFrame:
    """(id, th, item, start, w) of exact phrase matches. Postings adjusted by the term's
    place in an item agree on where the item would begin; a window is looked at where
    the lists of its two rarest terms agree, then compared in whole."""
    anchors = wins.select("item", F.explode(F.array_compact(F.array(F.struct(F.col("q1").alias("at"), F.element_at("words", F.col("q1") - F.col("o") + 1).alias("term")), F.when(F.col("q2").isNotNull(), F.struct(F.col("q2").alias("at"), F.element_at("words", F.col("q2") - F.col("o") + 1).alias("term")))))).alias("a")).select("item", "a.at", "a.term").distinct()
    lists = index.filter("term is not null").join(F.broadcast(anchors), "term").select("id", "th", "n_words", "item", "at", (F.col("pos") - F.col("at")).alias("d"), "base", "near")
    aligned = lists.groupBy("id", "th", "item", "d", "n_words").agg(F.collect_set("at").alias("ats"))
    # each place is looked up among the windows whose rarest term it would hold
    led = aligned.select("*", F.explode("ats").alias("q1")).join(F.broadcast(wins), ["item", "q1"]).filter(F.col("q2").isNull() | F.array_contains("ats", F.col("q2"))).drop("ats")
    both = led.withColumn("start", F.col("d") + F.col("o")).filter((F.col("start") >= 0) & (F.col("start") + F.col("w") <= F.col("n_words")))
    a, b = both.alias("a"), lists.alias("b")
    same = F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.th") == F.col("b.th")) & (F.col("a.item") == F.col("b.item")) & (F.col("a.d") == F.col("b.d")) & (F.col("a.q1") == F.col("b.at"))
    whole = F.slice(F.col("b.near"), F.col("a.start") - F.col("b.base") + 1, F.col("a.w")) == F.col("a.words")
    return a.join(b, same).filter(whole).select("a.id", "a.th", "a.item", "a.start", "a.w").distinct()


def proximity_matches(index: DataFrame, pairs: DataFrame, slop: int) -> DataFrame:
    """(id, th, item, pos1, pos2): places where the terms of ``pairs`` (item, term1,
    term2; of bounded size) stand at most ``slop`` words apart, in either order. Postings
    meet in cells of ``slop`` words of one document."""
    found = index.filter("term is not null").select("id", "th", "term", "pos")
    one = found.join(F.broadcast(pairs), found.term == pairs.term1).select("id", "th", "item", F.col("pos").alias("pos1"), F.explode(F.expr(f"sequence(pos div {slop} - 1, pos div {slop} + 1)")).alias("cell"))
    two = found.join(F.broadcast(pairs), found.term == pairs.term2).select("id", "th", "item", F.col("pos").alias("pos2"), F.expr(f"pos div {slop}").alias("cell"))
    a, b = one.alias("a"), two.alias("b")
    near = F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.th") == F.col("b.th")) & (F.col("a.item") == F.col("b.item")) & (F.col("a.cell") == F.col("b.cell"))
    return a.join(b, near).filter((F.abs(F.col("a.pos1") - F.col("b.pos2")) <= slop) & (F.col("a.pos1") != F.col("b.pos2"))).select("a.id", "a.th", "a.item", "pos1", "pos2").distinct()


def _rare_pairs(wins: DataFrame) -> DataFrame:
    """(item, term1, term2): the two rarest terms of each window, in order of the terms."""
    word = lambda at: F.element_at("words", F.col(at) - F.col("o") + 1)
    return wins.filter("q2 is not null").select("item", F.least(word("q1"), word("q2")).alias("term1"), F.greatest(word("q1"), word("q2")).alias("term2")).distinct()


def near_matches(index: DataFrame, pairs: DataFrame, slop: int) -> DataFrame:
    """(id, th, item, pos1, pos2) as of ``proximity_matches``, from an index whose reach
    is ``slop`` at least: a posting of the first term meets the second in its own ``near``."""
    found = index.filter("term is not null").join(F.broadcast(pairs), F.col("term") == F.col("term1"))
    there = found.select("id", "th", "item", "term2", F.col("pos").alias("pos1"), "base", F.posexplode("near").alias("k", "word")).filter("word = term2")
    return there.withColumn("pos2", F.col("base") + F.col("k")).filter((F.col("pos2") != F.col("pos1")) & (F.abs(F.col("pos2") - F.col("pos1")) <= slop)).select("id", "th", "item", "pos1", "pos2")


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", text_hash: str | None = None, proximity: bool = False) -> DataFrame:
    """A row for each row of ``docs``: id, ``n_words``, ``n_hit`` (words inside an
    occurrence of a window), ``n_items`` (items with occurring windows),
    ``items_sha256`` (of their ids, sorted as strings, joined by commas),
    ``contaminated`` (any word hit); with ``proximity``, ``n_near`` (words at proximity matches: places where
    a window's two rarest terms stand at most ``width`` words apart, in either order) and
    ``n_near_items`` (items with such places; exact matches of two words or more are among
    them); and, if ``text_hash`` names it, the text's hash.

    Words are runs of letters, digits and non-ASCII characters, A-Z folded. A window is
    ``width`` consecutive words of an item; a shorter item is one window; an item without
    words or with a null id has none. A null or empty text has no words. Null ids are
    allowed; rows that share an id and a text get the same row each. Items that repeat
    count once. Other columns are ignored. An empty ``docs`` gives no rows; an empty
    ``benchmark`` leaves every document clean."""
    items = benchmark.filter(q(item_col).isNotNull()).select(q(item_col).alias("item"), word_array(q(item_text)).alias("words")).distinct()
    items = materialise(items, "items")
    vocabulary = materialise(items.select(F.explode("words").alias("term")).distinct(), "vocabulary")
    wins = windows(items, materialise(term_counts(docs, vocabulary, id_col, text_col), "counts"), width)
    wins = materialise(wins, "windows")
    blocks = max(1, -(-wins.count() // BLOCK_WINDOWS))
    terms = wins.select(F.explode(F.array(F.element_at("words", F.col("q1") - F.col("o") + 1), F.element_at("words", F.coalesce("q2", "q1") - F.col("o") + 1))).alias("term")).distinct()
    index = materialise(postings(docs, materialise(terms, "terms"), width if proximity else width - 1, id_col, text_col), "postings")
    count = index.filter("term is null").select("id", "th", "n_words")
    hits, near = None, None
    for k in range(blocks):
        own = wins.filter(F.pmod(F.xxhash64("item", "o"), F.lit(blocks)) == k)
        found = _hits(index, own)
        hits = found if hits is None else hits.unionByName(found)
        if proximity:
            close = near_matches(index, materialise(_rare_pairs(own), "pairs"), width)
            near = close if near is None else near.unionByName(close)
    ids = F.array_sort(F.transform(F.collect_set("item"), lambda x: x.cast("string")))
    # the words of a text's hits: the union of their ranges, in order of their starts
    grow = lambda acc, x: F.struct((acc["n"] + F.greatest(x["end"] - F.greatest(x["start"], acc["reach"]), F.lit(0))).alias("n"), F.greatest(acc["reach"], x["end"]).alias("reach"))
    ranges = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("w")).alias("end"))))
    hits = hits.groupBy("id", "th").agg(F.aggregate(ranges, F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach")), grow)["n"].alias("n_hit"), F.size(F.collect_set("item")).alias("n_items"), F.array_join(ids, ",").alias("ids"))
    a, b = count.alias("a"), hits.alias("b")
    out = a.join(b, F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.th") == F.col("b.th")), "left")
    if proximity:
        near = near.groupBy("id", "th").agg(F.size(F.array_union(F.collect_set("pos1"), F.collect_set("pos2"))).alias("n_near"), F.size(F.collect_set("item")).alias("n_near_items"))
        c = near.alias("c")
        out = out.join(c, F.col("a.id").eqNullSafe(F.col("c.id")) & (F.col("a.th") == F.col("c.th")), "left")
    return out.select(
        F.col("a.id").alias(id_col),
        F.col("a.n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_near", "n_near_items") if proximity),
        *([F.col("a.th").alias(text_hash)] if text_hash else []),
    )
