"""The training-data pipeline: quality, near-duplicates, repeated passages, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns of
`documents`. Null texts pass as they are; a null doc_id is never a duplicate of another document, but of rows that repeat
its text without an id, as of rows that repeat an id and its text, one stays. Rows of one doc_id with different texts are
documents of their own: near duplicates go row by row, so a text that nothing repeats stays whatever its id. A text whose
every word is a repeat goes. Tables that a stage stores for itself, and its input, are deleted once its output is stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import quality
from strandline.llm.common import dropped, plan_bytes, scratch, small, stored
from strandline.llm.decontaminate import decontaminate
from strandline.llm.near_dup import near_duplicates
from strandline.llm.packing import pack
from strandline.llm.queries import table, tokenizer_path
from strandline.llm.substring import substring_dedup

REJECT_BELOW = 0.3


def _others(docs: DataFrame) -> tuple[str, ...]:
    return tuple(c for c in docs.columns if c not in ("doc_id", "text"))


def _restore(found: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    own = {"doc_id": F.col("doc_id"), "text": F.col(text)}
    return found.select(*((own[c] if c in own else F.col("carried")[c]).alias(c) for c in docs.columns))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return _restore(quality.score(docs, model, carry=_others(docs)).where(F.col("score") >= REJECT_BELOW), docs)


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row, that with the least other columns, of each doc_id and text, null ids included. Only rows whose id
    and text hash occur again are compared; null texts stay as they are."""
    told = docs.withColumn("_hash", F.when(F.col("text").isNotNull(), F.xxhash64("text")))
    again = stored(told.where("text is not null").groupBy("doc_id", "_hash").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_id"), F.col("_hash").alias("_again")), "repeated-rows")
    if again.isEmpty():
        return docs
    again, same = small(again, plan_bytes(again)), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_again"))
    least = told.join(again, same, "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(F.lit(0), *_others(docs))).alias("carried"))
    return told.join(again, same, "left_anti").select(*docs.columns).unionByName(_restore(least, docs))


def numbered(docs: DataFrame) -> DataFrame:
    """docs with an id with a number of its own for each row, `_row`, in the order of the ids; stored, so that it stays."""
    own = docs.where("doc_id is not null").withColumn("_hash", F.xxhash64("text"))
    parts = max(own.sparkSession.sparkContext.defaultParallelism, plan_bytes(docs) >> 26)
    dealt = own.repartitionByRange(parts, "doc_id", "_hash").sortWithinPartitions("doc_id", "_hash")
    return stored(dealt.select(*docs.columns, F.monotonically_increasing_id().alias("_row")), "numbered")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group linked by five-word shingles at 0.8; one row of repeated ones."""
    docs = one_of_each(docs)
    gone = lambda rows, key: near_duplicates(rows, doc_id=key).where(~F.col("kept")).select(F.col("doc_id").alias(key)).hint("shuffle_hash")
    if docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return docs.join(gone(docs, "doc_id"), "doc_id", "left_anti").select(*docs.columns)
    rows = numbered(docs)
    kept = rows.join(gone(rows, "_row"), "_row", "left_anti").select(*docs.columns)
    return kept.union(docs.where("doc_id is null"))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document with a smaller id has; texts that were nothing else go."""
    found = substring_dedup(docs, carry=_others(docs))
    changed = F.size("removed") > 0
    out = _restore(found.where(~changed | (F.trim(F.regexp_replace("kept_text", r"[\x09-\x0D]", " ")) != "")), docs, "kept_text")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lie in benchmark windows."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), carry=_others(docs))
    hits = F.size("hits")
    return _restore(found.where((hits == 0) | (20 * hits < F.col("n_words"))), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer_path())


STAGES = [("quality", keep_quality), ("near duplicates", drop_near_duplicates), ("repeated passages", drop_repeats), ("decontamination", drop_contaminated), ("packing", pack_sequences)]
#: The quality model can't be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with scratch():
            out = stage(spark, docs, sf_dir)
            docs = stored(out, f"stage-{k}", lasting=True)
        if last is not None:
            dropped(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
