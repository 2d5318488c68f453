"""Document fingerprints by Order MinHash, in DataFrame operations only.

A text's units are runs of up to 16 ASCII letters, digits and _, and every other visible character by itself; its k-mers
are k consecutive units (the whole of a shorter text is one k-mer). k-mers are numbered by occurrence, so that a repeated
one counts each time. A hash of (k-mer, occurrence) puts each into one of 64 buckets; of each bucket the `take` smallest
are kept, put back into text order, and hashed as a tuple. The fingerprint lists bucket and tuple hash, eight hex digits
for each bucket that has a k-mer. Likeness is the share of equal entries among the buckets that either text fills: moving
text about changes tuples even where the set of k-mers stays, which plain MinHash doesn't see. A bucket with one k-mer has no
order, so for short texts (under some hundred units) much of this is lost.

All of it is computed within the row: two sorts of longs and a few array functions; a long holds 32 bits of hash and 32
bits of place, which no text outgrows. Null counts as empty; an empty text, or one of white space,
has the empty fingerprint; two such are alike by 1, one such and another by 0. Equal texts have equal fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions_for, stored

UNITS = r"[0-9A-Za-z_]{1,16}|[!-~\x{80}-\x{10FFFF}]"
NO_ID = (1 << 63) - 1


def _let(value: str, name: str, body: str) -> str:
    """body with `name` bound to value, computed once a row."""
    return f"transform(array({value}), {name} -> {body})[0]"


def fingerprint(text: str, k: int = 3, take: int = 2) -> Column:
    """array<string> of the column of that name: an entry of eight hex digits per filled bucket, in bucket order."""
    kmer = ", ".join(f"ts[i + {j}]" for j in range(k))
    bucket = lambda x: f"shiftright({x}, 58)"
    mers = f"if(size(ts) >= {k}, transform(sequence(0, size(ts) - {k}), i -> shiftleft(xxhash64({kmer}), 32) + i), if(size(ts) > 0, array(shiftleft(xxhash64(ts), 32)), array()))"
    # where a new k-mer begins in sorted order; the distance from there is the occurrence
    runs = "filter(sequence(0, size(ss) - 1), i -> i = 0 or shiftright(ss[i], 32) <> shiftright(ss[greatest(i - 1, 0)], 32))"
    numbers = "if(size(rs) = size(ss), array(), flatten(transform(rs, (s, j) -> sequence(0, coalesce(get(rs, j + 1), size(ss)) - s - 1))))"
    drawn = "sort_array(transform(ss, (s, i) -> shiftleft(shiftright(xxhash64(shiftright(s, 32), coalesce(get(os, i), 0)), 32), 32) + (s & 4294967295L)))"
    least = f"filter(us, (u, i) -> i < {take} or {bucket(f'us[greatest(i - {take}, 0)]')} <> {bucket('u')})"
    firsts = f"filter(sequence(0, size(ms) - 1), i -> i = 0 or {bucket('ms[greatest(i - 1, 0)]')} <> {bucket('ms[i]')})"
    in_order = "transform(sort_array(transform(slice(ms, i + 1, coalesce(get(fs, j + 1), size(ms)) - i), x -> shiftleft(x, 32) + shiftrightunsigned(x, 32))), y -> y & 4294967295L)"
    entry = f"concat(lpad(hex({bucket('ms[i]')} + 32L), 2, '0'), right(lpad(hex(xxhash64({in_order})), 16, '0'), 6))"
    listed = _let(firsts, "fs", f"transform(fs, (i, j) -> {entry})")
    body = _let(runs, "rs", _let(numbers, "os", _let(drawn, "us", _let(least, "ms", listed))))
    whole = _let(f"sort_array({mers})", "ss", f"if(size(ss) = 0, cast(array() as array<string>), {body})")
    units = f"regexp_extract_all(coalesce({text}, ''), r'{UNITS}', 0)"
    return F.expr(_let(units, "ts", whole))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: equal entries over buckets filled in either."""
    buckets = lambda x: F.transform(x, lambda e: F.substring(e, 1, 2))
    either = F.size(F.array_union(buckets(a), buckets(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def followers(rows: DataFrame) -> DataFrame:
    """(id, key, n, copies, next_id, next_key): for each distinct (id, key) the next in descending id, the last followed by
    the first. Ids are dealt by range and stored; only the first of each range meets the others'."""
    order = [F.desc_nulls_last("doc_id"), F.asc("key")]
    distinct = rows.groupBy("doc_id", "key").agg(F.first("n").alias("n"), F.count("*").alias("copies"))
    parts = partitions_for(rows.select("doc_id"), 8 << 20, rows.sparkSession.sparkContext.defaultParallelism)
    dealt = stored(distinct.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ids")
    own = Window.partitionBy("part").orderBy(*order)
    told = dealt.withColumn("at", F.row_number().over(own)).withColumn("next", F.lead(F.struct("doc_id", "key")).over(own))
    heads = told.where("at = 1").select("part", F.struct("doc_id", "key").alias("head"))
    turn = Window.orderBy("part")  # a row for each range
    ends = heads.select("part", F.coalesce(F.lead("head").over(turn), F.first("head").over(turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    return told.join(F.broadcast(ends), "part").withColumn("next", F.coalesce("next", "after")).select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "key", "n", "copies", F.coalesce("next.doc_id", F.lit(NO_ID)).alias("next_id"), F.col("next.key").alias("next_key")
    )


def with_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n, text, edited, own and next row's keys: the last floor(n/3) code points give way to the first as many of
    the next document in descending id. Identical rows are one document in that order; null ids come last."""
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    links = stored(followers(rows.select("doc_id", "key", F.length("text").alias("n"))), "links")
    # both joins read these columns and no other, so that one shuffle of the texts serves both
    texts = rows.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "key", "text")
    asked = links.select(F.col("next_id").alias("id"), F.col("next_key").alias("key"), F.col("id").alias("asker"), F.col("key").alias("asker_key"), F.floor(F.col("n") / 3).cast("int").alias("q"))
    heads = texts.join(asked.hint("shuffle_hash"), ["id", "key"]).select(F.col("asker").alias("id"), F.col("asker_key").alias("key"), F.expr("left(text, q)").alias("head"))
    if links.where("copies > 1").limit(1).count():
        heads = heads.dropDuplicates(["id", "key"])
    joined = texts.join(links.select("id", "key", "n", "copies", "next_id", "next_key").hint("shuffle_hash"), ["id", "key"]).join(heads.hint("shuffle_hash"), ["id", "key"])
    edited = F.concat(F.expr("left(text, n - cast(floor(n / 3) as int))"), F.col("head"))
    return joined.select(F.nullif("id", F.lit(NO_ID)).alias("doc_id"), "id", "key", "copies", "next_id", "next_key", F.col("n").cast("long").alias("n"), "text", edited.alias("edited"))


def fingerprints(docs: DataFrame, k: int = 3, take: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row doc_id, text, fingerprint."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("fingerprint", fingerprint("text", k, take))


def _entries(packed: str) -> Column:
    return F.regexp_extract_all(F.hex(packed), F.lit(".{8}"), F.lit(0))


def compare_edits(docs: DataFrame, k: int = 3, take: int = 2) -> DataFrame:
    """Per row doc_id, n, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    pairs = with_edits(docs)
    keys = ("doc_id", "id", "key", "next_id", "next_key", "n", "copies")
    printed = pairs.select(*keys, F.unhex(F.sha2(F.col("edited").cast("binary"), 256)).alias("sha"), fingerprint("text", k, take).alias("own"), fingerprint("edited", k, take).alias("other"))
    packed = lambda x: F.unhex(F.array_join(x, "")).alias(x)
    own = stored(printed.select(*keys, "sha", packed("own"), packed("other"), likeness(F.col("own"), F.col("other")).alias("near_edited")), "fingerprints")
    nexts = own.select(F.col("id").alias("next_id"), F.col("key").alias("next_key"), F.col("own").alias("next"))
    if own.where("copies > 1").limit(1).count():
        nexts = nexts.dropDuplicates(["next_id", "next_key"])
    return own.join(nexts.hint("shuffle_hash"), ["next_id", "next_key"]).select(
        "doc_id", "n", F.lower(F.hex("sha")).alias("edited_sha256"), F.hex("own").alias("fingerprint"), F.hex("other").alias("edited_fingerprint"), "near_edited", likeness(_entries("own"), _entries("next")).alias("near_next")
    )
