"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, licences, quality, toxicity
from .common import fold, stored
from .decontaminate import decontaminate
from .fingerprint import compare_edits
from .near_dup import near_duplicates
from .packing import pack
from .substring import substring_dedup
from .warc import read_records, resolve, write_archives


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return found.select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"),
        ((F.size("hits") > 0) & (20 * F.size("hits") >= F.col("n_words"))).alias("contaminated"),
    )


OP1_SQL = r"""
with d as (select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as ws from documents),
b as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark where text is not null),
bw as (select distinct item_id, w, array_to_string(ws[s : s + w - 1], ' ') as key
       from (select item_id, ws, w, unnest(range(1, len(ws) - w + 2)) as s from (select *, least(13, len(ws)) as w from b where len(ws) > 0))),
dw as (select doc_id, p, w, array_to_string(ws[p : p + w - 1], ' ') as key
       from (select doc_id, ws, w, unnest(range(1, len(ws) - w + 2)) as p from d, (select distinct w from bw) where len(ws) >= w)),
m as (select doc_id, p, dw.w as w, item_id from dw join bw using (w, key)),
h as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + w)) as q from m) group by doc_id),
i as (select doc_id, count(*) as n_items, string_agg(x, ',' order by x) as ids from (select distinct doc_id, cast(item_id as varchar) as x from m) group by doc_id)
select doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from d left join h using (doc_id) left join i using (doc_id)
"""


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, similarity="0.85")


OP3_SQL = r"""
with recursive w as (select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) as ws from documents),
s as (select doc_id, case when len(ws) >= 3 then list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i : i + 2], ' ')))
                          when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end as sh from w),
e as (select doc_id, unnest(sh) as x from s),
pairs as (select a.doc_id as u, b.doc_id as v, count(*) as c from e a join e b on a.x = b.x and a.doc_id < b.doc_id group by all),
links as (select u, v from pairs join s p on p.doc_id = u join s q on q.doc_id = v where 100 * c >= 85 * (len(p.sh) + len(q.sh) - c)),
bi as (select u, v from links union select v, u from links),
reach as (select doc_id, doc_id as to_id from s union select reach.doc_id, bi.v from reach join bi on reach.to_id = bi.u),
comp as (select doc_id, min(to_id) as component_id from reach group by doc_id)
select doc_id, cast(len(sh) as bigint) as n_shingles, component_id, doc_id = component_id as kept from s join comp using (doc_id)
"""


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_archives(table(spark, sf_dir, "pages"))
    return resolve(stored(read_records(index, payloads=False), "warc-records")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
with p as (select page_id, strlen(coalesce(html, '')) as n, sha256(coalesce(html, '')) as d from pages),
f as (select d, min(page_id) as m from p where n >= 100 group by d)
select page_id, n as payload_bytes, d as payload_digest, case when m is not null and m <> page_id then 'revisit' else 'response' end as record_type,
       case when m is not null and m <> page_id then m end as refers_to
from p left join f using (d)
"""


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents"))
    kept = F.trim(F.regexp_replace(F.coalesce("kept_text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    removed = F.expr("aggregate(removed, 0L, (a, x) -> a + x.end - x.start)")
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(kept, 256).alias("kept_sha256"))


OP7_SQL = r"""
with d as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as ws from documents),
w as (select doc_id, p, array_to_string(ws[p : p + 12], ' ') as key from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as p from d where len(ws) >= 13)),
m as (select key, min(doc_id) as least from w group by key having count(distinct doc_id) > 1),
r as (select doc_id, list(distinct q) as gone from (select doc_id, unnest(range(p, p + 13)) as q from w join m using (key) where doc_id > least) group by doc_id)
select doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(len(gone), 0) as bigint) as n_removed,
       sha256(coalesce(array_to_string(list_transform(list_filter(range(1, len(ws) + 1), lambda i: not list_contains(coalesce(gone, []), i)), lambda i: ws[i]), ' '), '')) as kept_sha256
from d left join r using (doc_id)
"""


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())



def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = licences.scan_documents(docs, licences.fit(docs))
    return found.select("doc_id", "n_paragraphs", "n_licensed", F.array_join("families", ",").alias("families"), "probability")


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edits(table(spark, sf_dir, "documents")).withColumnRenamed("n", "n_chars")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("matches").alias("n_matches"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.prototypes(docs.where(fold(F.col("doc_id"), 3) != 1)))
    return found.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate, "op2_quality": op2_quality, "op3_near_dup": op3_near_dup, "op4_warc": op4_warc, "op5_licences": op5_licences, "op6_fingerprint": op6_fingerprint,
    "op7_substring_dedup": op7_substring_dedup, "op8_pack": op8_pack, "op9_toxicity": op9_toxicity, "op10_language": op10_language,
}
SQL: dict[str, str] = {"op1_decontaminate": OP1_SQL, "op3_near_dup": OP3_SQL, "op4_warc": OP4_SQL, "op7_substring_dedup": OP7_SQL}
