"""Streams over files, run to their end, against the batch operators."""

from pyspark.sql import functions as F

from strandline.functions import sequence
from strandline.streaming.kmers import count_stream, grouped_events


def test_kmer_stream_equals_batch(spark, tmp_path):
    for i, reads in enumerate((["ACGTACGTNACG", "TTTT"], ["ACGTACGT"])):
        spark.createDataFrame([(r,) for r in reads], "seq string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("seq string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = count_stream(stream, 3).writeStream.format("memory").queryName("kmers").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r["kmer"]: r["n"] for r in spark.table("kmers").collect()}
    batch = spark.read.parquet(str(tmp_path / "in")).select(F.explode(sequence.canonical_kmers("seq", 3)).alias("kmer")).groupBy("kmer").count()
    assert got == {r["kmer"]: r["count"] for r in batch.collect()} and got


def test_grouped_events(spark, tmp_path):
    rows = [("u", t) for t in (0, 10, 100, 105, 10_000)]
    spark.createDataFrame(rows, "user string, at int").select("user", F.timestamp_seconds("at").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user string, ts timestamp").parquet(str(tmp_path / "in"))
    query = grouped_events(stream, "30 seconds", "1 minute", "ts", "user").writeStream.format("memory").queryName("groups").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r["n_events"] for r in spark.table("groups").collect()) == [2, 2]
