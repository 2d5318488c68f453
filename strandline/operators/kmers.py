"""k-mer tables: counting, sharing between clusters and groups, classes, joins, and count models.

Everything is keyed by the k-mer, so each operator is a hash aggregation with a map-side part or an equi-join whose side
to broadcast Spark picks by size; counts of one k-mer, however frequent, are summed before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import sequence

LARGEST, MULTIPLICITY_LIMIT = 255, 127


def explode_kmers(runs: DataFrame, k: int, run: str = "run", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each k-mer of each run: the columns in keep, and kmer (canonical)."""
    return runs.select(*keep, F.explode(F.transform(sequence.kmers(run, k), sequence.canonical)).alias("kmer"))


def count_kmers(occurrences: DataFrame, sequence_id: str = "seq_id") -> DataFrame:
    return occurrences.groupBy("kmer").agg(F.count("*").alias("occurrences"), F.countDistinct(sequence_id).alias("n_sequences"))


def composition(occurrences: DataFrame) -> DataFrame:
    return occurrences.select(*sequence.base_counts("kmer")).groupBy("n_a", "n_c", "n_g", "n_t").agg(F.count("*").alias("n_kmers"))


def gc_histogram(occurrences: DataFrame, bins: int) -> DataFrame:
    return occurrences.groupBy(sequence.gc_bin("kmer", bins).alias("gc_bin")).agg(F.count("*").alias("n_kmers"))


def shared_between(occurrences: DataFrame, cluster: Column, group: Column) -> DataFrame:
    """kmer, n_groups, n_clusters, multigroup (in two groups), multicluster (in two clusters)."""
    per = occurrences.groupBy("kmer").agg(F.countDistinct(group).alias("n_groups"), F.countDistinct(cluster).alias("n_clusters"))
    return per.withColumn("multigroup", F.col("n_groups") > 1).withColumn("multicluster", F.col("n_clusters") > 1)


def census(occurrences: DataFrame, cluster: Column, group: Column, decoy: Column, limit: int = MULTIPLICITY_LIMIT, inside: Column | None = None) -> DataFrame:
    """class, n_kmers: non_cluster (never `inside` a cluster), then decoy before max_multiplicity (over `limit` in a cluster)
    before multigroup, multicluster, unique. Occurrences outside count for decoys only."""
    told = occurrences.select("kmer", group.alias("g"), cluster.alias("c"), decoy.cast("int").alias("d"), (inside if inside is not None else F.lit(True)).cast("int").alias("i"))
    per_cluster = told.groupBy("kmer", "g", "c", "i").agg(F.count("*").alias("n"), F.max("d").alias("d"))
    own = lambda x: F.when(F.col("i") == 1, x)
    per = per_cluster.groupBy("kmer").agg(F.max(own(F.col("n"))).alias("n"), F.max("d").alias("d"), F.countDistinct(own(F.col("g"))).alias("gs"), F.sum("i").alias("cs"))
    kind = F.when(F.col("cs") == 0, "non_cluster").when(F.col("d") == 1, "decoy").when(F.col("n") > limit, "max_multiplicity").when(F.col("gs") > 1, "multigroup").when(F.col("cs") > 1, "multicluster").otherwise("unique")
    return per.groupBy(kind.alias("class")).agg(F.count("*").alias("n_kmers"))


def excluded(decoy: str, over: str, multigroup: str) -> Column:
    return F.col(decoy) | F.col(over) | F.col(multigroup)


def members(kmers: DataFrame, others: DataFrame) -> DataFrame:
    """Exact membership, where a Bloom filter would guess."""
    return kmers.join(others.select("kmer"), "kmer", "left_semi")


def strangers(kmers: DataFrame, others: DataFrame) -> DataFrame:
    return kmers.join(others.select("kmer"), "kmer", "left_anti")


def with_counts(kmers: DataFrame, counts: DataFrame, count: str = "n") -> DataFrame:
    """Left join: a k-mer that was not counted has 0."""
    return kmers.join(counts, "kmer", "left").withColumn(count, F.coalesce(F.col(count), F.lit(0)))


def sampled_values(occurrences: DataFrame, decoy: Column, share: float = 1.0, seed: int = 0) -> DataFrame:
    """kmer, value: true unless one occurrence lies in a decoy, or the draw says no."""
    return occurrences.groupBy("kmer").agg((F.max(decoy.cast("int")) == 0).alias("clear")).select("kmer", (F.col("clear") & sequence.drawn("kmer", share, seed)).alias("value"))


def saturating_counts(occurrences: DataFrame, cluster: Column, haplotype: Column) -> DataFrame:
    """kmer, multiplicity (largest over haplotypes, summed over clusters, at most 255), over (a haplotype has over 127)."""
    per = occurrences.groupBy("kmer", cluster.alias("c"), haplotype.alias("h")).agg(F.count("*").alias("n"))
    most = per.groupBy("kmer", "c").agg(F.max("n").alias("n"))
    return most.groupBy("kmer").agg(F.least(F.lit(LARGEST), F.sum("n")).cast("int").alias("multiplicity"), (F.max("n") > MULTIPLICITY_LIMIT).alias("over"))


def intercluster_multiplicity(occurrences: DataFrame, female: Column, male: Column, decoy: Column, paths: DataFrame | None = None) -> DataFrame:
    """kmer, female, male (ploidies summed), haploid (occurrences), each at most 255, and decoy; of the k-mers in paths alone, if
    given."""
    if paths is not None:
        occurrences = members(occurrences, paths)
    cap = lambda x, name: F.least(F.lit(LARGEST), F.sum(x)).cast("int").alias(name)
    return occurrences.groupBy("kmer").agg(cap(female, "female"), cap(male, "male"), cap(F.lit(1), "haploid"), F.max(decoy.cast("int")).cast("boolean").alias("decoy"))


def multiplicity_stats(counts: DataFrame) -> DataFrame:
    """Of (sample, kmer, multiplicity, n): per sample and multiplicity n_kmers, mean and variance of n."""
    return counts.groupBy("sample", "multiplicity").agg(F.count("*").alias("n_kmers"), F.avg("n").alias("mean"), F.var_samp("n").alias("variance"))


def negative_binomial_fit(stats: DataFrame, most: int = 32) -> DataFrame:
    """Per sample the multiplicity (1 to `most`) with most k-mers, and its model scaled to one copy: p, size, mean, variance."""
    own = Window.partitionBy("sample").orderBy(F.desc("n_kmers"), "multiplicity")  # at most `most` rows a sample
    best = stats.where(f"multiplicity between 1 and {most}").withColumn("at", F.row_number().over(own)).where("at = 1")
    p = F.least(F.lit(0.99), F.col("mean") / F.col("variance"))
    size = F.col("mean") * F.col("p") / (1 - F.col("p")) / F.col("multiplicity")
    return best.where("variance > 0 and mean > 0").withColumn("p", p).withColumn("size", size).select(
        "sample", "multiplicity", "n_kmers", "p", "size", (F.col("size") * (1 - F.col("p")) / F.col("p")).alias("haploid_mean"), (F.col("size") * (1 - F.col("p")) / F.pow("p", F.lit(2))).alias("haploid_variance")
    )


def noise_histogram(counts: DataFrame) -> DataFrame:
    """sample, n (0 to 255), n_kmers of k-mers without a copy."""
    return counts.where("multiplicity = 0").groupBy("sample", F.least("n", F.lit(LARGEST)).alias("n")).agg(F.count("*").alias("n_kmers"))


def drawn_sample(kmers: DataFrame, most: int, seed: int) -> DataFrame:
    """`most` k-mers in the order of a seeded hash."""
    return kmers.orderBy(F.xxhash64("kmer", F.lit(seed)), "kmer").limit(most)
