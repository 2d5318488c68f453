"""k-mer counts and event groups over Structured Streaming, with the same expressions as their batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import sequence


def count_stream(reads: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """kmer, n over a stream of reads: a running count, for update or complete mode. State holds a row for each k-mer."""
    return reads.select(F.explode(sequence.canonical_kmers(seq, k)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))


def grouped_events(events: DataFrame, gap: str, late: str, time: str = "ts", *by: str) -> DataFrame:
    """start, end, n_events of groups of events no more than `gap` apart (gaps and islands on event time); a group is given
    out once the watermark, `late` behind the newest event, has passed its end."""
    return (
        events.withWatermark(time, late)
        .groupBy(F.session_window(time, gap).alias("w"), *by)
        .agg(F.count("*").alias("n_events"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n_events")
    )
