"""Benchmark decontamination over a distributed positional inverted index, in DataFrame operations only.

The index holds postings (term, row, position) of the training texts for the terms that queries look up: of each
benchmark window the rarest terms by corpus frequency, counted over all documents. Lists are adjusted by the term's
offset in the item, so that equal (row, item, diagonal) means an alignment; lists of a window's terms are intersected
on it, and the windows that survive are compared word for word with blocks of the texts that hold them.

No row grows beyond a text or an item: alignments, windows and blocks are rows, which only meet in joins. Of windows of
one item with equal words one is looked up, so an item that repeats a word costs a text that repeats it a row per word.

Nulls, empty texts: no words, so no hits; n_words 0. Null item text: no window. A null item_id still marks words as
hit, but is not listed among the items. Repeated document rows each give a row; repeated items count once. Rows of
one doc_id with different texts are judged apart. Extra columns of the inputs are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, carried, dropped, row_key, small, stored

#: After folding A-Z: the complement of [\x00-\x2F\x3A-\x60\x7B-\x7F], said positively, which Java matches many times faster.
WORDS = r"[0-9a-z\x{80}-\x{10FFFF}]+"
#: Window starts of one block of a text.
BLOCK = 256


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORDS), F.lit(0)), F.array().cast("array<string>"))


def items_of(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, item_id, terms): distinct items that have a word."""
    own = benchmark.select(F.col(item_id).alias("item_id"), F.col(text).cast("string").alias("_text")).distinct()
    return own.select(row_key("item_id", "_text").alias("item"), "item_id", words(F.col("_text")).alias("terms")).where(F.size("terms") > 0)


def rows_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(row, doc_id, text, carried); row stands for the id and the text together."""
    own = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"), *carried(docs, carry))
    return own.select(row_key("doc_id", "text").alias("row"), *own.columns)


def term_bytes(items: DataFrame) -> int:
    """Measured bytes of the benchmark's words, the bound of all its derived tables up to a factor."""
    total = items.agg(F.sum(F.expr("aggregate(terms, 0L, (a, t) -> a + octet_length(t) + 16)"))).first()[0]
    return 4 * int(total or 0)


def frequencies(rows: DataFrame, items: DataFrame, measured: int) -> DataFrame:
    """(term, n): how often each benchmark term occurs in all documents."""
    vocabulary = items.select(F.explode("terms").alias("term")).distinct()
    return rows.select(F.explode(words(F.col("text"))).alias("term")).join(small(vocabulary, measured), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))


def windows_of(items: DataFrame, counts: DataFrame, measured: int, width: int, lookups: int, distinct: bool = True) -> DataFrame:
    """(item, item_id, terms, windows): of each window that can occur its start s in the item and the positions ps of its
    rarest terms there; of equal windows of an item only the first, if distinct.

    A window with a term that no document has is left out, as it can't occur.
    """
    placed = items.select("item", F.posexplode("terms").alias("p", "term")).join(small(counts, measured), "term", "left")
    listed = placed.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("p", F.coalesce("n", F.lit(0)).alias("n")))).alias("ns"))
    rarest = F.expr(f"slice(array_sort(transform(slice(ns, s + 1, w), x -> struct(x.n as n, x.p as p))), 1, {lookups})")
    cut = (
        items.join(small(listed, measured), "item")
        .withColumn("w", F.least(F.lit(width), F.size("terms")))
        .select("item", "terms", "ns", "w", F.explode(F.expr("sequence(0, size(terms) - w)")).alias("s"))
        .select("item", "s", F.expr("slice(terms, s + 1, w)").alias("words"), rarest.alias("r"))
        .where("r[0].n > 0")
        .select("item", "words", F.struct("s", F.col("r.p").alias("ps")).alias("window"))
    )
    if distinct:
        cut = cut.groupBy("item", "words").agg(F.min("window").alias("window"))
    windows = cut.groupBy("item").agg(F.sort_array(F.collect_list("window")).alias("windows"))
    return items.join(windows, "item").select("item", "item_id", "terms", "windows")


def postings(rows: DataFrame, anchors: DataFrame, measured: int) -> DataFrame:
    """(term, row, pos) of the terms looked up; no shuffle, each task lists its own documents."""
    tokens = rows.select("row", F.posexplode(words(F.col("text"))).alias("pos", "term"))
    return tokens.join(small(anchors.select("term").distinct(), measured), "term", "left_semi").select("term", "row", "pos")


def alignments(index: DataFrame, anchors: DataFrame, windowed: DataFrame, measured: int, lookups: int) -> DataFrame:
    """(row, block, item, diagonal, ss): where the rarest terms of the windows that begin at ss in the item stand in a text
    as in the item, shifted by the diagonal; of a block's windows only, so at most BLOCK. Not yet compared."""
    lists = index.join(small(anchors, measured), "term").select("row", "item", (F.col("pos") - F.col("p")).alias("diagonal"), "p")
    met = lists.groupBy("row", "item", "diagonal").agg(F.collect_set("p").alias("ps"))
    fits = F.expr("transform(filter(windows, x -> size(array_except(x.ps, ps)) = 0 and x.s + diagonal >= 0), x -> x.s)")
    starts = met.join(small(windowed.select("item", "windows"), measured * lookups * 2), "item").select("row", "item", "diagonal", F.explode(fits).alias("s"))
    return starts.withColumn("block", F.expr(f"cast((diagonal + s) div {BLOCK} as int)")).groupBy("row", "item", "diagonal", "block").agg(F.collect_list("s").alias("ss"))


def blocks_of(rows: DataFrame, asked: DataFrame, width: int) -> DataFrame:
    """(row, block, ws): the words of each block asked for, with those that its last window runs on to."""
    wanted = asked.groupBy("row").agg(F.collect_set("block").alias("blocks"))
    held = 8 * (asked.count() + 4 * wanted.count())
    cut = F.transform(F.array(words(F.col("text"))), lambda ws: F.transform("blocks", lambda b: F.struct(b.alias("block"), F.slice(ws, b * BLOCK + 1, F.lit(BLOCK + width - 1)).alias("ws"))))[0]
    return rows.select("row", "text").join(small(wanted, held), "row").select("row", F.explode(cut).alias("b")).select("row", "b.block", "b.ws")


def occurrences(rows: DataFrame, items: DataFrame, width: int, lookups: int) -> DataFrame:
    """(row, hits, items), stored: of each text with a window its words inside windows and the items they belong to."""
    measured = term_bytes(items)
    counts = stored(frequencies(rows, items, measured), "term-counts")
    windowed = stored(windows_of(items, counts, measured, width, lookups), "windows")
    anchors = windowed.select("item", "terms", F.explode(F.array_distinct(F.flatten("windows.ps"))).alias("p")).select("item", "p", F.expr("terms[p]").alias("term"))
    index = stored(postings(rows, anchors, measured), "postings")
    asked = stored(alignments(index, anchors, windowed, measured, lookups), "alignments")
    wide = f"least({width}, size(terms))"
    same = F.expr(f"filter(ss, s -> slice(ws, diagonal + s - block * {BLOCK} + 1, {wide}) = slice(terms, s + 1, {wide}))")
    met = blocks_of(rows, asked, width).join(asked, ["row", "block"]).join(small(items, measured), "item")
    found = met.select("row", "item_id", "diagonal", F.expr(wide).alias("w"), F.explode(same).alias("s")).select("row", "item_id", (F.col("diagonal") + F.col("s")).alias("at"), "w")
    told = found.groupBy("row").agg(F.collect_set(F.struct("at", "w")).alias("at"), F.collect_set("item_id").alias("items"))
    hits = F.expr("sort_array(array_distinct(flatten(transform(at, x -> sequence(x.at, x.at + x.w - 1)))))")
    out = stored(told.select("row", hits.alias("hits"), "items"), "hits")
    dropped(counts, windowed, index, asked)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 13, lookups: int = 2, share: float = 0.05, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Exact phrase matches: per document row doc_id, text, n_words, hits (positions of words inside a benchmark window,
    ascending), items (ids of items with a window in the text) and contaminated (hit share of the words at least `share`).

    lookups: of how many of a window's rarest terms the postings are intersected before the comparison. A struct
    `carried` holds the columns in `carry`.
    """
    rows, items = rows_of(docs, doc_id, text, carry), items_of(benchmark)
    found = occurrences(rows, items, width, lookups)
    held = found.agg(F.sum(4 * F.size("hits") + 24 * F.size("items") + 64)).first()[0] or 0
    joined = rows.join(small(found, held), "row", "left")
    none = lambda c: F.coalesce(c, F.array().cast(found.schema[c].dataType))
    return (
        joined.withColumn("n_words", F.coalesce(F.regexp_count("text", F.lit(WORDS.replace("a-z", "A-Za-z"))), F.lit(0)).cast("long"))
        .withColumns({"hits": none("hits"), "items": none("items")})
        .withColumn("contaminated", (F.size("hits") > 0) & (F.size("hits") >= F.lit(share) * F.col("n_words")))
        .select(*rows.columns[1:], "n_words", "hits", "items", "contaminated")
    )


def proximity(docs: DataFrame, benchmark: DataFrame, slop: int = 3, width: int = 13, lookups: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Proximity matches: (doc_id, item_id, at), where the rarest terms of a window stand within `slop` words of their
    places in the item, each at its own shift; `at` is the place of the item's first word by the first term's shift.

    Postings are dealt by shift in blocks of slop + 1: the first term to its own block, the others to theirs and those on
    both sides, so that all terms within `slop` of a first term stand in its block, on whichever side of it.
    """
    rows = rows_of(docs, doc_id, text)
    items = items_of(benchmark)
    measured = term_bytes(items)
    counts = stored(frequencies(rows, items, measured), "term-counts")
    windowed = stored(windows_of(items, counts, measured, width, lookups, distinct=False), "windows")
    looked = windowed.select("item", "item_id", "terms", F.posexplode("windows.ps").alias("window", "ps")).select("item", "item_id", "window", F.size("ps").alias("k"), F.posexplode("ps").alias("j", "p"), "terms").select("item", "item_id", "window", "k", "j", "p", F.expr("terms[p]").alias("term"))
    index = stored(postings(rows, looked, measured), "postings")
    shifts = index.join(small(looked, measured * lookups), "term").select("row", "item", "item_id", "window", "k", "j", (F.col("pos") - F.col("p")).alias("shift"))
    own = F.floor(F.col("shift") / (slop + 1))
    dealt = shifts.withColumn("block", F.explode(F.when(F.col("j") == 0, F.array(own)).otherwise(F.array(own - 1, own, own + 1))))
    met = dealt.groupBy("row", "item", "item_id", "window", "block", "k").agg(F.sort_array(F.collect_set(F.struct("j", "shift"))).alias("found"))
    hit = met.withColumn("at", F.explode(F.expr("filter(filter(found, x -> x.j = 0).shift, a -> size(array_distinct(filter(found, x -> abs(x.shift - a) <= {}).j)) = k)".format(slop))))
    return hit.select("row", "item_id", "at").distinct().join(rows.select("row", "doc_id"), "row").select("doc_id", "item_id", "at").distinct()
