"""Queries of sources and sinks: a table is written in the file's format to the shared folder and read back from there."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions import alleles
from strandline.operators import callsets, genotyping, intervals
from strandline.shared import new_dir
from strandline.sources import fasta, tables, vcf

from .adapters import K, duck, load
from .catalogue import COMBINE, CONTIGS, GROUPED, TRIM, SAMPLE_COUNTS, sample_counts
from .registry import registered

GROUPED_ALTS = f"""{COMBINE}, va as (select replace(chrom, ' ', '_') as chrom, pos, ref, string_agg(alt, ',' order by alt) as alts, string_agg(aco, ',' order by alt) as aco, count(*)::int as n from cs group by chrom, pos, ref)"""


def _written_vcf(spark, d):
    """(path, header) of a gzipped VCF of the combined call sets with two samples, undeclared keys and an annotation line."""
    rows = callsets.combine(load(spark, d, "callset")).groupBy("chrom", "pos", "ref").agg(F.sort_array(F.collect_list(F.struct("alt", "aco"))).alias("x"))
    none = F.array().cast("array<string>")
    raw = F.array(F.concat(F.lit("0/"), F.size("x").cast("string"), F.lit(":"), F.col("pos").cast("string"), F.lit(":0.5,0.25")), F.when(F.col("pos") % 2 == 0, ".").otherwise(F.lit("1|.:7:.,1")))
    info = F.create_map(F.lit("ACO"), F.array_join(F.transform("x.aco", lambda a: F.replace(a, F.lit(" "), F.lit("_"))), ","), F.lit("XX"), F.lit("1"))
    variants = rows.select(
        F.dense_rank().over(Window.orderBy("chrom")).alias("contig_idx"), F.replace("chrom", F.lit(" "), F.lit("_")).alias("chrom"), "pos", none.alias("ids"), "ref", F.col("x.alt").alias("alts"), F.lit(1.5).alias("qual"), F.array(F.lit("PASS")).alias("filters"),
        F.when(F.col("pos") % 3 == 0, F.map_concat(info, F.create_map(F.lit("FL"), F.lit("")))).otherwise(info).alias("info"), F.array(F.lit("GT"), F.lit("DP"), F.lit("AP")).alias("format"), raw.alias("raw"),
    )
    contigs = sorted({r[0] for r in variants.select("chrom").distinct().collect()})  # the contigs of a genome
    declared = {"INFO": {"ACO": {"ID": "ACO", "Number": "A", "Type": "String", "Description": "origin, of an allele"}, "FL": {"ID": "FL", "Number": "0", "Type": "Flag", "Description": "flag"}}, "contig": {c: {"ID": c, "length": "100"} for c in contigs}}
    path = new_dir(spark, "vcf")
    vcf.write(variants, vcf.Header(declared, ["##fileformat=VCFv4.2", "##note=x"], ["s2", "s1"]), path, gzip=True)
    return path, vcf.read_header(spark, path)


@registered("vcf_scan", f"{GROUPED_ALTS} select chrom, pos, ref, alts, replace(aco, ' ', '_') as aco, pos % 3 = 0 as flag, 1 + (pos % 3 = 0)::int as n_info, 1.5 as qual, 'PASS' as filters, dense_rank() over (order by chrom) - 1 as contig_idx, 2 as n_samples from va")
def vcf_scan(spark, d):
    path, header = _written_vcf(spark, d)
    rows = vcf.read_variants(spark, path, header)
    return rows.select(
        "chrom", "pos", "ref", F.array_join("alts", ",").alias("alts"), vcf.info_value("ACO").alias("aco"), F.map_contains_key("info", "FL").alias("flag"), F.size("info").alias("n_info"), "qual", F.array_join("filters", ";").alias("filters"),
        F.col("contig_idx").cast("long").alias("contig_idx"), F.lit(len(header.samples)).alias("n_samples"),
    )


@registered("vcf_header", "select * from (values (0, '##fileformat=VCFv4.2'), (1, '##note=x')) v(line, value) union all select 2, '##INFO=<ID=ACO,Number=A,Type=String,Description=\"origin, of an allele\">' union all select 3, '##INFO=<ID=FL,Number=0,Type=Flag,Description=\"flag\">' union all select 3 + row_number() over (order by c)::int, '##contig=<ID=' || c || ',length=100>' from (select distinct replace(p_brand, ' ', '_') as c from part) b")
def vcf_header(spark, d):
    _, header = _written_vcf(spark, d)
    return spark.createDataFrame([(i, x) for i, x in enumerate(header.lines()[:-1])], "line int, value string")


@registered("vcf_alleles", f"{COMBINE} select replace(chrom, ' ', '_') as chrom, pos, ref, alt, replace(aco, ' ', '_') as aco, cast(row_number() over (partition by chrom, pos order by alt) as int) as alt_idx from cs")
def vcf_alleles(spark, d):
    path, header = _written_vcf(spark, d)
    return vcf.explode_alleles(vcf.read_variants(spark, path, header), ("ACO",)).select("chrom", "pos", "ref", "alt", "aco", "alt_idx")


@registered(
    "vcf_calls",
    f"""{GROUPED_ALTS} select chrom, pos, 's2' as sample, '0,' || n as gt, false as phased, 2 as ploidy, 'Complete' as status, cast(pos as varchar) as dp, '0.5,0.25' as ap from va
    union all select chrom, pos, 's1', case when pos % 2 = 0 then '' else '1' end, true, case when pos % 2 = 0 then 1 else 2 end, case when pos % 2 = 0 then 'Missing' else 'Partial' end, case when pos % 2 = 0 then null else '7' end, case when pos % 2 = 0 then null else '1' end from va""",
)
def vcf_calls(spark, d):
    path, header = _written_vcf(spark, d)
    calls = vcf.explode_calls(vcf.read_variants(spark, path, header), header)
    ap = vcf.by_number("fields", "AP", "R")
    return calls.select("chrom", "pos", "sample", F.array_join(F.col("gt").cast("array<string>"), ",").alias("gt"), "phased", "ploidy", "status", vcf.by_number("fields", "DP", "1").alias("dp"), F.when(ap.isNotNull(), F.array_join(ap, ",")).alias("ap"))


@registered("vcf_pruned", f"{GROUPED_ALTS} select chrom, pos, (pos % 3 = 0)::int as n_info, 'GT:AP' as format, '0/' || n || ':0.5,0.25' as s2, case when pos % 2 = 0 then '.' else '1|.:.,1' end as s1 from va")
def vcf_pruned(spark, d):
    path, header = _written_vcf(spark, d)
    rows = vcf.keep_declared(vcf.read_variants(spark, path, header), ["FL"], [], ["GT", "AP"])
    return rows.select("chrom", "pos", F.size("info").alias("n_info"), F.array_join("format", ":").alias("format"), F.get("raw", F.lit(0)).alias("s2"), F.get("raw", F.lit(1)).alias("s1"))


@registered(
    "vcf_order",
    "with l as (select event_id as line, cast(user_id % 3 as int) as c, cast(floor(value) as int) as p from events), b as (select line, c, p, lag(line) over (order by line) as pl, lag(c) over (order by line) as pc, lag(p) over (order by line) as pp from l) select line, case when c < pc then 'contig' else 'position' end as why from b where pl = line - 1 and (c < pc or (c = pc and p < pp))",
)
def vcf_order(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("line"), (F.col("user_id") % 3).cast("int").alias("contig_idx"), F.floor("value").cast("int").alias("pos"))
    return vcf.out_of_order(rows)


GENOME = f"{duck('seq')}, g as (select cast(seq_id as varchar) as id, string_agg(run, '' order by run) as seq from seq group by seq_id)"


def _genome(spark, d):
    return load(spark, d, "seq").groupBy(F.col("seq_id").cast("string").alias("id")).agg(F.array_join(F.sort_array(F.collect_list("run")), "").alias("seq"))


@registered("fasta_scan", f"{GENOME} select id, seq, cast(id as int) % 2 = 1 as is_decoy from g")
def fasta_scan(spark, d):
    files = []
    for decoy in (False, True):
        path = new_dir(spark, "fasta")
        own = _genome(spark, d).where((F.col("id").cast("int") % 2 == 1) == decoy)
        fasta.to_lines(own.select(F.concat("id", F.lit(" about it")).alias("id"), F.lower("seq").alias("seq")), 17).write.text(path)
        files.append((path, decoy))
    return fasta.read_genome(spark, files)


@registered("indel_fasta", f"{TRIM} select chrom || '_' || pos || '_' || variant_id as id, case when tr = '' then ta else tr end as seq from t where alt <> '*' and alt <> ref and (tr = '' or ta = '')")
def indel_fasta(spark, d):
    t = alleles.trimmed(load(spark, d, "allele").where("alt <> '*' and alt <> ref")).withColumnRenamed("variant_id", "alt_idx").withColumn("chrom", F.replace("chrom", F.lit(" "), F.lit("~")))
    path = new_dir(spark, "indels")
    fasta.to_lines(fasta.indel_records(t), 5).write.text(path)
    return fasta.read(spark, path).select(F.replace("id", F.lit("~"), F.lit(" ")).alias("id"), "seq")


@registered("haplotype_fasta", f"{GENOME} select 's' || (cast(id as int) % 2) as sample, id || '_0' as id, seq from g")
def haplotype_fasta(spark, d):
    path = new_dir(spark, "haplotypes")
    haps = _genome(spark, d).select(F.col("id").alias("chrom"), F.concat(F.lit("s"), (F.col("id").cast("int") % 2).cast("string")).alias("sample"), F.lit(0).alias("hap"), "seq")
    tables.write_haplotypes(haps, path, 13)
    return fasta.read(spark, f"{path}/sample=s0").select(F.lit("s0").alias("sample"), "id", "seq").union(fasta.read(spark, f"{path}/sample=s1").select(F.lit("s1"), "id", "seq"))


@registered("kmer_table", f"{duck('occ')} select kmer, cast(least(255, count(*) * 100) as int) as n from occ group by kmer")
def kmer_table(spark, d):
    path = new_dir(spark, "kmers")
    load(spark, d, "occ").groupBy("kmer").agg((F.count("*") * 100).alias("n")).write.csv(path, sep="\t")
    return tables.read_kmers(spark, path, K)


@registered("parameter_kmers", f"{duck('occ')} select distinct kmer from occ where kmer like 'A%'")
def parameter_kmers(spark, d):
    path = new_dir(spark, "parameter-kmers")
    tables.write_parameter_kmers(load(spark, d, "occ").select("kmer").distinct(), path, K, 1_000_000_000, F.col("kmer").startswith("A"))
    return tables.read_parameter_kmers(spark, path, K)


@registered("sample_sheet", "select n_name as sample, n_nationkey % 4 < 2 as female, 'p' || n_nationkey as prefix from nation")
def sample_sheet(spark, d):
    path, k = new_dir(spark, "samples"), F.col("n_nationkey")
    sex = F.get(F.array(*map(F.lit, ("F", "Female", "M", "Male"))), k % 4)
    spark.read.parquet(f"{d}/nation.parquet").select("n_name", sex, F.concat(F.lit("p"), k)).write.csv(path, sep="\t")
    return tables.read_samples(spark, path)


@registered("ploidy_table", "select n_name as chrom, s.n as sample, case when s.n % 2 = 0 then n_nationkey % 3 else (n_nationkey + 1) % 3 end as ploidy from nation cross join (select n_regionkey as n from (select distinct n_regionkey from nation) r) s")
def ploidy_table(spark, d):
    nation, path, k = spark.read.parquet(f"{d}/nation.parquet"), new_dir(spark, "ploidy"), F.col("n_nationkey")
    nation.select("n_name", k % 3, (k + 1) % 3).write.csv(path, sep="\t")
    table = tables.read_ploidy(spark, path, nation.select(F.col("n_name").alias("chrom")))
    people = nation.select(F.col("n_regionkey").alias("sample")).distinct()
    rows = nation.select(F.col("n_name").alias("chrom"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("sample")).join(people, "sample").withColumn("female", F.col("sample") % 2 == 0)
    return tables.with_ploidy(rows, table).select("chrom", "sample", "ploidy")


@registered(
    "intercluster_regions",
    f"""{GROUPED}, {CONTIGS}, r as (select contig, coalesce(b + 1, first) as start, pos - 1 as "end" from n join c using (contig)
    union all select contig, coalesce(m + 1, first), last from c left join (select contig, max(end_pos) as m from ivl group by contig) using (contig)) select cast(contig as varchar) as chrom, contig % 7 = 0 as is_decoy, cast(start as int) as start, cast("end" as int) as "end" from r where "end" - start + 1 >= 3""",
)
def intercluster_regions(spark, d):
    contigs = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("contig"), F.lit(-1200).alias("first"), F.lit(2600).alias("last"))
    path = new_dir(spark, "regions")
    tables.write_regions(intervals.complement(load(spark, d, "ivl"), contigs, 3).select(F.col("contig").alias("chrom"), (F.col("contig") % 7 == 0).alias("is_decoy"), "start", "end"), path)
    return tables.read_regions(spark, path)


UNITS = "select l_orderkey, l_linenumber, cast(l_orderkey % 4 as int) as unit from lineitem"


@registered("unit_files", f"select l_orderkey, l_linenumber, unit from ({UNITS}) u where unit in (1, 3)")
def unit_files(spark, d):
    path = new_dir(spark, "units")
    tables.write_units(spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") % 4).cast("int").alias("unit")), path)
    return tables.read_units(spark, path, [1, 3])


@registered("unit_concatenation", UNITS)
def unit_concatenation(spark, d):
    path = new_dir(spark, "units")
    tables.write_units(spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") % 4).cast("int").alias("unit")), path)
    return tables.concatenated([tables.read_units(spark, path, [u]) for u in range(4)], "l_orderkey", "l_linenumber")


@registered(
    "repeat_table",
    "with r as (select 'c_' || l_partkey || '_1' as key, l_linenumber as start, l_linenumber + cast(l_quantity as int) as \"end\", l_returnflag || '/x' as family from lineitem) select * from r union all select key, start, \"end\", 'All' from r",
)
def repeat_table(spark, d):
    path = new_dir(spark, "repeats")
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    head = spark.createDataFrame([("   SW   perc perc perc  query position in query",), ("score   div. del. ins.  sequence  begin end",), ("",)], "value string")
    end = F.col("l_linenumber") + F.col("l_quantity").cast("int")
    rows = li.select(F.concat_ws("  ", F.lit(" 463"), F.lit("1.3"), F.lit("0.6"), F.lit("1.7"), F.concat(F.lit("c_"), "l_partkey", F.lit("_1")), "l_linenumber", end, F.lit("(0)"), F.lit("+"), F.lit("Alu"), F.concat("l_returnflag", F.lit("/x")), F.lit("1 2 (3) 4")).alias("value"))
    head.coalesce(1).union(rows).write.text(path)
    return tables.read_repeats(spark, path)


@registered("coverage_file", f"""{SAMPLE_COUNTS}, b as (select * from st where multiplicity = 1) select sample, round(mean, 6) as mean, round(variance, 6) as variance from b where variance is not null""")
def coverage_file(spark, d):
    from strandline.operators import kmers

    path = new_dir(spark, "coverage")
    stats = kmers.multiplicity_stats(sample_counts(spark, d)).where("multiplicity = 1 and variance is not null")
    tables.write_coverage(stats.select("sample", F.col("mean").alias("haploid_mean"), F.col("variance").alias("haploid_variance")), path)
    return tables.read_coverage(spark, path).select("sample", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"))


@registered(
    "transmission_table",
    """with t as (select 'c' || n_regionkey as chrom, n_nationkey * 10 as start, n_nationkey * 10 + 9 as "end", substr('ABCD', 1 + n_nationkey % 4, 1) as x, substr('CDAB', 1 + n_nationkey % 3, 1) as y from nation)
    select chrom, start, "end", 's1' as sample, x as first, y as second from t union all select chrom, start, "end", 's2', y, null from t""",
)
def transmission_table(spark, d):
    path, k = new_dir(spark, "transmission"), F.col("n_nationkey")
    letter = lambda letters, n: F.get(F.split(F.lit(letters), ""), k % n)
    x, y = letter("ABCD", 4), letter("CDAB", 3)
    nation = spark.read.parquet(f"{d}/nation.parquet")
    nation.select(F.concat(F.lit("c"), "n_regionkey").alias("#chrom"), (k * 10).alias("start"), (k * 10 + 9).alias("end"), F.concat(x, y).alias("s1"), y.alias("s2")).write.csv(path, sep="\t", header=True)
    return tables.read_transmission(spark, path)


@registered("summary_file", f"{duck('call')} select a || chr(9) || b as key, sum(nak)::bigint as n_0, count(*) as n_1 from call group by a, b")
def summary_file(spark, d):
    path = new_dir(spark, "summary")
    load(spark, d, "call").groupBy("sample", "a", "b").agg(F.sum("nak").alias("s"), F.count("*").alias("n")).select(F.concat_ws("\t", "s", "n", "a", "b").alias("value")).write.text(path)
    return genotyping.collapse(tables.read_summary(spark, path, 2), ["n_0", "n_1"])


@registered("callset_list", "select n_name as name, 'x' as callset from nation where n_nationkey % 2 = 0 union all select n_name, 'y' from nation where n_nationkey % 3 = 0")
def callset_list(spark, d):
    paths = {}
    for name, n in (("x", 2), ("y", 3)):
        paths[name] = new_dir(spark, "callset")
        spark.read.parquet(f"{d}/nation.parquet").where(F.col("n_nationkey") % n == 0).select(F.col("n_name").alias("value")).write.text(paths[name])
    return tables.read_callsets(spark, ",".join(f"{n}:{p}" for n, p in paths.items()), lambda s, p: s.read.text(p).withColumnRenamed("value", "name"))


def _bed_sql() -> str:
    from .registry import SQL

    return f"select cast(contig as varchar) as contig, start, \"end\" from ({SQL['genomic_intervals']}) t"


@registered("bed_file", _bed_sql())
def bed_file(spark, d):
    from .catalogue import genomic_intervals

    path = new_dir(spark, "bed")
    tables.write_bed(genomic_intervals(spark, d), path)
    return spark.read.csv(path, sep="\t", schema="contig string, start int, end int")


@registered(
    "noise_trace_file",
    """with t as (select cast(l_suppkey % 3 as int) as chain, cast(l_partkey % 40 as int) as iteration, l_returnflag as sample, max(l_extendedprice) as rate from lineitem group by all)
    select chain as "Chain", iteration as "Iteration", max(case when sample = 'A' then rate end) as "A", max(case when sample = 'N' then rate end) as "N", max(case when sample = 'R' then rate end) as "R" from t group by chain, iteration
    union all select 0, 0, round(avg(case when sample = 'A' then rate end), 4), round(avg(case when sample = 'N' then rate end), 4), round(avg(case when sample = 'R' then rate end), 4) from t where iteration >= 10""",
)
def noise_trace_file(spark, d):
    path = new_dir(spark, "noise")
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    trace = li.groupBy((F.col("l_suppkey") % 3).cast("int").alias("chain"), (F.col("l_partkey") % 40).cast("int").alias("iteration"), F.col("l_returnflag").alias("sample")).agg(F.max("l_extendedprice").alias("rate"))
    tables.write_noise_trace(trace, path, 10)
    return spark.read.csv(path, sep="\t", header=True, schema="Chain int, Iteration int, A double, N double, R double").select("Chain", "Iteration", *(F.round(c, 4).alias(c) for c in "ANR"))
