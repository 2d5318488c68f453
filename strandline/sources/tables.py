"""The small tables: samples, ploidy, k-mers, regions, repeats, parameters, haplotype transmission, summaries; and sinks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.shared import first_lines

from . import fasta


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """sample, female, prefix; a sex that is none of F, Female, M, Male raises when it is read."""
    raw = spark.read.csv(path, sep="\t", schema="sample string, sex string, prefix string")
    sex = F.when(F.col("sex").isin("F", "Female"), True).when(F.col("sex").isin("M", "Male"), False).otherwise(F.raise_error(F.concat(F.lit("unknown sex: "), F.coalesce("sex", F.lit("null")))).cast("boolean"))
    return raw.select("sample", sex.alias("female"), "prefix")


def read_ploidy(spark: SparkSession, path: str, contigs: DataFrame | None = None) -> DataFrame:
    """chrom, female, male. A ploidy outside 0 to 2, or a contig of contigs (chrom) that the file lacks, raises when it is read."""
    raw = spark.read.csv(path, sep="\t", schema="chrom string, female string, male string")
    if contigs is not None:
        raw = contigs.select("chrom").join(raw, "chrom", "left")
    value = lambda c: F.when(F.col(c).isin("0", "1", "2"), F.col(c).cast("int")).otherwise(F.raise_error(F.concat(F.lit("no ploidy of "), "chrom", F.lit(": "), F.coalesce(c, F.lit("none")))).cast("int"))
    return raw.select("chrom", value("female").alias("female"), value("male").alias("male"))


def with_ploidy(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Add ploidy to (chrom, female, …) by the table of read_ploidy, which has a row for each contig."""
    own = table.select("chrom", F.col("female").alias("_f"), F.col("male").alias("_m"))
    return rows.join(own, "chrom").withColumn("ploidy", F.when(F.col("female"), F.col("_f")).otherwise(F.col("_m"))).drop("_f", "_m")


def read_kmers(spark: SparkSession, path: str, k: int | None = None) -> DataFrame:
    """kmer, n (at most 255) from Parquet or tab-separated text; with k, a k-mer of another size raises when it is read."""
    raw = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.csv(path, sep="\t", schema="kmer string, n long")
    kmer = F.col(raw.columns[0])
    if k is not None:
        kmer = F.when(F.length(kmer) == k, kmer).otherwise(F.raise_error(F.concat(F.lit(f"not a {k}-mer: "), kmer)).cast("string"))
    return raw.select(kmer.alias("kmer"), F.least(F.lit(255), F.col(raw.columns[1])).cast("int").alias("n"))


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="chrom string, is_decoy int, start int, end int").withColumn("is_decoy", F.col("is_decoy") == 1)


def regions(spark: SparkSession, spec: str) -> DataFrame:
    """contig, region_start, region_end of `chrom:start-end,chrom`; a contig alone is whole (null bounds). A contig may be given
    whole once, or in parts; anything else raises."""
    rows, whole = [], set()
    for part in filter(None, spec.split(",")):
        m = re.fullmatch(r"([^:]+)(?::(-?\d+)-(-?\d+))?", part)
        if not m or m[1] in whole or (m[2] is None and any(r[0] == m[1] for r in rows)) or (m[2] is not None and int(m[2]) > int(m[3])):
            raise ValueError(f"not a region, or a contig twice: {part}")
        if m[2] is None:
            whole.add(m[1])
        rows.append((m[1], None if m[2] is None else int(m[2]), None if m[3] is None else int(m[3])))
    return spark.createDataFrame(rows, "contig string, region_start int, region_end int")


def write_regions(regions: DataFrame, path: str) -> None:
    """The longest first."""
    regions.orderBy(F.desc(F.col("end") - F.col("start")), "chrom", "start").select("chrom", F.col("is_decoy").cast("int"), "start", "end").write.csv(path, sep="\t", compression="gzip")


def read_parameter_kmers(spark: SparkSession, path: str, k: int) -> DataFrame:
    """kmer of the lines after `>k<size>`; a file of another size raises."""
    head = first_lines(spark, path, ">")
    if head != [f">k{k}"]:
        raise ValueError(f"k-mers of another size: {head}")
    return spark.read.text(path).where(~F.col("value").startswith(">")).select(F.col("value").alias("kmer"))


def write_parameter_kmers(kmers: DataFrame, path: str, k: int, most: int, wanted: Column | None = None) -> None:
    """A line `>k<size>`, then at most `most` of the k-mers for which `wanted` holds."""
    spark = kmers.sparkSession
    head = spark.createDataFrame([(f">k{k}",)], "value string")
    own = kmers if wanted is None else kmers.where(wanted)
    head.coalesce(1).union(own.select("kmer").limit(most)).write.option("compression", "gzip").text(path)


def read_repeats(spark: SparkSession, path: str) -> DataFrame:
    """key, start, end, family of a RepeatMasker table, each row also under the family All."""
    c = F.split(F.trim("value"), " +")
    rows = spark.read.text(path).where(F.trim("value").rlike("^[0-9]")).select(c[4].alias("key"), c[5].cast("int").alias("start"), c[6].cast("int").alias("end"), c[10].alias("family"))
    return rows.unionByName(rows.withColumn("family", F.lit("All")))


def read_coverage(spark: SparkSession, path: str) -> DataFrame:
    """sample, mean, variance from the genomic-parameter table."""
    return spark.read.csv(path, sep="\t", header=True, schema="Sample string, Mean double, Variance double").toDF("sample", "mean", "variance")


def write_coverage(fit: DataFrame, path: str) -> None:
    fit.select(F.col("sample").alias("Sample"), F.col("haploid_mean").alias("Mean"), F.col("haploid_variance").alias("Variance")).orderBy("Sample").coalesce(1).write.csv(path, sep="\t", header=True)


def read_transmission(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end, sample, first, second (null for one letter)."""
    raw = spark.read.csv(path, sep="\t", header=True)
    names = [c.lstrip("#") for c in raw.columns]
    raw = raw.toDF(*names)
    long_ = raw.unpivot(names[:3], names[3:], "sample", "letters")
    return long_.select(F.col(names[0]).alias("chrom"), F.col(names[1]).cast("int").alias("start"), F.col(names[2]).cast("int").alias("end"), "sample", F.left("letters", F.lit(1)).alias("first"), F.expr("nullif(substring(letters, 2, 1), '')").alias("second"))


def read_summary(spark: SparkSession, path: str, counts: int) -> DataFrame:
    """n_0 … and key: the first columns are counts, the rest of a line is the key."""
    c = F.split("value", "\t", counts + 1)
    return spark.read.text(path).select(*(c[i].cast("long").alias(f"n_{i}") for i in range(counts)), c[counts].alias("key"))


def read_callsets(spark: SparkSession, spec: str, reader) -> DataFrame:
    """`name:path,name:path`, each read by `reader(spark, path)` and marked with its name."""
    out = None
    for part in spec.split(","):
        name, _, path = part.partition(":")
        own = reader(spark, path).withColumn("callset", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


def pedigree_of_names(samples: list[str]) -> list[tuple[str, str, str, str]]:
    """(family, father, mother, child) of samples named `<family>-01` (father), `-02` (mother) and `-03`, `-04`, … (children);
    families without both parents or without a child have no trio, a name of another form raises."""
    families: dict[str, dict[int, str]] = {}
    for name in samples:
        family, _, member = name.rpartition("-")
        if not family or not member.isdigit():
            raise ValueError(f"no family in the name {name}")
        families.setdefault(family, {})[int(member)] = name
    return [(f, own[1], own[2], own[n]) for f, own in sorted(families.items()) if {1, 2} <= own.keys() for n in sorted(own) if n > 2]


def pedigree(spec: str) -> list[tuple[int, str, str, str]]:
    """(family, father, mother, child) of `father,mother,child:father,mother,child`."""
    found = [x.split(",") for x in spec.split(":")]
    if any(len(x) != 3 for x in found):
        raise ValueError(f"a trio has three ids: {spec}")
    return [(i, *x) for i, x in enumerate(found)]


def contig_order(lists: list[list[str]]) -> list[str]:
    """A merge of ordered contig lists that keeps the order of each; lists that contradict one another raise."""
    out: list[str] = []
    pending = [list(x) for x in lists]
    while any(pending):
        heads = [x[0] for x in pending if x]
        free = next((h for h in heads if not any(h in x[1:] for x in pending)), None)
        if free is None:
            raise ValueError("contig orders contradict one another")
        out.append(free)
        pending = [x[1:] if x and x[0] == free else x for x in pending]
    return out


def write_bed(intervals: DataFrame, path: str) -> None:
    intervals.select("contig", "start", "end").orderBy("contig", "start").write.csv(path, sep="\t")


def write_units(units: DataFrame, path: str) -> None:
    """A folder for each unit; what is there already is not written over."""
    units.write.partitionBy("unit").mode("errorifexists").parquet(path)


def read_units(spark: SparkSession, path: str, units: list[int] | None = None) -> DataFrame:
    """The rows of these units, or of all; only their folders are read."""
    rows = spark.read.parquet(path)
    return rows if units is None else rows.where(F.col("unit").isin(units))


def concatenated(parts: list[DataFrame], *order: str) -> DataFrame:
    """Tables of the units of one run, in one order; their columns must be the same, in any order."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.orderBy(*order)


def write_noise_trace(trace: DataFrame, path: str, burn_in: int = 100) -> None:
    """Tab-separated Chain, Iteration and a column of rates for each sample; the last row, 0 and 0, has the means after the
    burn-in."""
    names = [r[0] for r in trace.select("sample").distinct().orderBy("sample").collect()]  # the samples of a run
    rows = trace.groupBy("chain", "iteration").pivot("sample", names).agg(F.first("rate"))
    means = trace.where(F.col("iteration") >= burn_in).groupBy().pivot("sample", names).agg(F.avg("rate")).select(F.lit(0).alias("chain"), F.lit(0).alias("iteration"), *(F.col(f"`{n}`") for n in names))
    whole = rows.withColumn("_last", F.lit(0)).unionByName(means.withColumn("_last", F.lit(1)))
    whole.orderBy("_last", "chain", "iteration").drop("_last").toDF("Chain", "Iteration", *map(str, names)).coalesce(1).write.csv(path, sep="\t", header=True)


def write_haplotypes(haplotypes: DataFrame, path: str, width: int = 60) -> None:
    """FASTA records `chrom_hap`, a folder for each sample. haplotypes: chrom, sample, hap, seq."""
    records = haplotypes.select("sample", F.concat_ws("_", "chrom", "hap").alias("id"), "seq")
    records.select("sample", fasta.record("id", "seq", width).alias("value")).write.partitionBy("sample").text(path)
