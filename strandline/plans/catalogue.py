"""Registered queries of the genotyping operators over the adapters, each with its DuckDB text where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import alleles, genotypes, sequence
from strandline.operators import callsets, genotyping, graph, inference, intervals, kmers, tools
from strandline.sources import fasta, tables, vcf

from .adapters import K, duck, load
from .registry import QUERIES, SQL, registered, rounded

# ---- k-mers


@registered("kmer_count", f"{duck('occ')} select kmer, count(*) as occurrences, count(distinct seq_id) as n_sequences from occ group by kmer")
def kmer_count(spark, d):
    return kmers.count_kmers(load(spark, d, "occ"))


@registered(
    "kmer_composition",
    f"""{duck('occ')} select cast(length(kmer) - length(replace(kmer, 'A', '')) as int) as n_a, cast(length(kmer) - length(replace(kmer, 'C', '')) as int) as n_c, cast(length(kmer) - length(replace(kmer, 'G', '')) as int) as n_g,
    cast(length(kmer) - length(replace(kmer, 'T', '')) as int) as n_t, count(*) as n_kmers from occ group by all""",
)
def kmer_composition(spark, d):
    return kmers.composition(load(spark, d, "occ"))


@registered(
    "kmer_gc_bins",
    f"""{duck('occ')} select greatest(0, cast(ceil(length(regexp_replace(kmer, '[AT]', '', 'g')) * 5 / {K}) as int) - 1) as gc_bin, count(*) as n_kmers from occ group by 1""",
)
def kmer_gc_bins(spark, d):
    return kmers.gc_histogram(load(spark, d, "occ"), 5)


@registered(
    "revcomp_runs",
    f"""{duck('seq')} select seq_id, run, reverse(translate(run, 'ACGT', 'TGCA')) as revcomp, regexp_full_match(run, '[ACGT]+') as valid, run = reverse(translate(run, 'ACGT', 'TGCA')) as palindrome from seq""",
)
def revcomp_runs(spark, d):
    rc = sequence.reverse_complement("run")
    return load(spark, d, "seq").select("seq_id", "run", rc.alias("revcomp"), sequence.is_nucleotides("run").alias("valid"), (F.col("run") == rc).alias("palindrome"))


@registered(
    "kmer_packed",
    f"""{duck('occ')}, k as (select distinct kmer from occ) select kmer, list_sum(list_transform(range(1, {K} + 1), lambda i: (strpos('ACGT', substr(kmer, i, 1)) - 1) * cast(power(4, {K} - i) as bigint)))::bigint as bits, kmer as back from k""",
)
def kmer_packed(spark, d):
    return load(spark, d, "occ").select("kmer").distinct().withColumn("bits", sequence.packed("kmer")).withColumn("back", sequence.unpacked("bits", K))


@registered(
    "kmer_multigroup",
    f"{duck('occ')} select kmer, count(distinct source) as n_groups, count(distinct source || '/' || lang) as n_clusters, count(distinct source) > 1 as multigroup, count(distinct source || '/' || lang) > 1 as multicluster from occ group by kmer",
)
def kmer_multigroup(spark, d):
    return kmers.shared_between(load(spark, d, "occ"), F.concat_ws("/", "source", "lang"), F.col("source"))


@registered(
    "kmer_class_census",
    f"""{duck('occ')}, o as (select *, seq_id % 3 > 0 as inside from occ), p as (select kmer, source as g, lang as c, count(*) as n from o where inside group by all), d as (select kmer, max(cast(source = 'src0' as int)) as d from o group by kmer),
    q as (select kmer, max(n) as n, count(distinct g) as gs, count(*) as cs from p group by kmer)
    select case when cs is null then 'non_cluster' when d = 1 then 'decoy' when n > 2 then 'max_multiplicity' when gs > 1 then 'multigroup' when cs > 1 then 'multicluster' else 'unique' end as class, count(*) as n_kmers from d left join q using (kmer) group by 1""",
)
def kmer_class_census(spark, d):
    return kmers.census(load(spark, d, "occ"), F.col("lang"), F.col("source"), F.col("source") == "src0", limit=2, inside=F.col("seq_id") % 3 > 0)


@registered("allele_kmers", f"{duck('occ')} select seq_id, count(distinct kmer) as n_kmers, min(kmer) as first, max(kmer) as last from occ group by seq_id")
def allele_kmers(spark, d):
    """The set of canonical k-mers of each sequence, all its runs together."""
    sets = load(spark, d, "seq").groupBy("seq_id").agg(F.array_join(F.collect_list("run"), "N").alias("allele")).select("seq_id", F.array_distinct(sequence.canonical_kmers("allele", K)).alias("ks"))
    return sets.select("seq_id", F.size("ks").cast("long").alias("n_kmers"), F.array_min("ks").alias("first"), F.array_max("ks").alias("last"))


@registered("kmer_semi_join", f"{duck('occ')}, k as (select kmer, count(*) as n from occ where lang = 'de' group by kmer) select * from k where kmer in (select kmer from occ where lang = 'en')")
def kmer_semi_join(spark, d):
    occ = load(spark, d, "occ")
    return kmers.members(occ.where("lang = 'de'").groupBy("kmer").agg(F.count("*").alias("n")), occ.where("lang = 'en'"))


@registered("kmer_anti_join", f"{duck('occ')}, k as (select kmer, count(*) as n from occ where lang = 'de' group by kmer) select * from k where kmer not in (select kmer from occ where lang = 'en')")
def kmer_anti_join(spark, d):
    occ = load(spark, d, "occ")
    return kmers.strangers(occ.where("lang = 'de'").groupBy("kmer").agg(F.count("*").alias("n")), occ.where("lang = 'en'"))


@registered(
    "kmer_left_counts",
    f"{duck('occ', 'bench_occ')}, k as (select distinct kmer from occ), c as (select kmer, count(*) as n from bench_occ group by kmer) select kmer, coalesce(n, 0) as n from k left join c using (kmer)",
)
def kmer_left_counts(spark, d):
    return kmers.with_counts(load(spark, d, "occ").select("kmer").distinct(), load(spark, d, "bench_occ").groupBy("kmer").agg(F.count("*").alias("n")))


@registered("kmer_decoy_override", f"{duck('occ')} select kmer, max(cast(source = 'src0' as int)) = 0 as value from occ group by kmer")
def kmer_decoy_override(spark, d):
    return kmers.sampled_values(load(spark, d, "occ"), F.col("source") == "src0")


@registered(
    "kmer_saturating_counts",
    f"""{duck('occ')}, p as (select kmer, source as c, lang as h, count(*) as n from occ group by all), m as (select kmer, c, max(n) as n from p group by kmer, c)
    select kmer, cast(least(255, sum(n)) as int) as multiplicity, max(n) > 127 as over from m group by kmer""",
)
def kmer_saturating_counts(spark, d):
    return kmers.saturating_counts(load(spark, d, "occ"), F.col("source"), F.col("lang"))


@registered(
    "kmer_intercluster",
    f"""{duck('occ', 'talk_occ')} select kmer, cast(least(255, sum(case when lang = 'de' then 2 when lang = 'fr' then 0 else 2 end)) as int) as female, cast(least(255, sum(case when lang in ('de', 'fr') then 1 else 2 end)) as int) as male,
    cast(least(255, count(*)) as int) as haploid, bool_or(source = 'src0') as decoy from occ where kmer in (select kmer from talk_occ) group by kmer""",
)
def kmer_intercluster(spark, d):
    female, male = F.when(F.col("lang") == "fr", 0).otherwise(2), F.when(F.col("lang").isin("de", "fr"), 1).otherwise(2)
    return kmers.intercluster_multiplicity(load(spark, d, "occ"), female, male, F.col("source") == "src0", load(spark, d, "talk_occ"))


def sample_counts(spark, d) -> DataFrame:
    """(sample, kmer, multiplicity, n): counts of talk k-mers by role at the multiplicity that documents have them."""
    copies = load(spark, d, "occ").groupBy("kmer").agg(F.count("*").cast("int").alias("multiplicity"))
    return load(spark, d, "talk").join(copies, "kmer", "left").withColumn("multiplicity", F.coalesce("multiplicity", F.lit(0)))


SAMPLE_COUNTS = f"{duck('talk', 'occ')}, copies as (select kmer, cast(count(*) as int) as multiplicity from occ group by kmer), sc as (select sample, kmer, coalesce(multiplicity, 0) as multiplicity, n from talk left join copies using (kmer)), st as (select sample, multiplicity, count(*) as n_kmers, avg(n) as mean, var_samp(n) as variance from sc group by sample, multiplicity)"


@registered("kmer_param_stats", f"{SAMPLE_COUNTS} select sample, multiplicity, n_kmers, round(mean, 6) as mean, round(variance, 6) as variance from st")
def kmer_param_stats(spark, d):
    return rounded(kmers.multiplicity_stats(sample_counts(spark, d)), "mean", "variance")


@registered(
    "nb_fit",
    f"""{SAMPLE_COUNTS}, b as (select * from st where multiplicity between 1 and 32 qualify row_number() over (partition by sample order by n_kmers desc, multiplicity) = 1),
    f as (select *, least(0.99, mean / variance) as p from b where variance > 0 and mean > 0), g as (select *, mean * p / (1 - p) / multiplicity as size from f)
    select sample, multiplicity, n_kmers, round(p, 6) as p, round(size, 6) as size, round(size * (1 - p) / p, 6) as haploid_mean, round(size * (1 - p) / pow(p, 2), 6) as haploid_variance from g""",
)
def nb_fit(spark, d):
    return rounded(kmers.negative_binomial_fit(kmers.multiplicity_stats(sample_counts(spark, d))), "p", "size", "haploid_mean", "haploid_variance")


@registered("noise_histogram", f"{SAMPLE_COUNTS} select sample, least(n, 255) as n, count(*) as n_kmers from sc where multiplicity = 0 group by all")
def noise_histogram(spark, d):
    return kmers.noise_histogram(sample_counts(spark, d))


@registered("nb_logpmf", "select cast(l_linenumber as int) as mult, cast(l_quantity as int) as n, round(lgamma(n + mult * 3.5) - lgamma(n + 1) - lgamma(mult * 3.5) + mult * 3.5 * ln(0.4) + n * ln(0.6), 6) as lp from (select distinct l_linenumber, l_quantity from lineitem) x")
def nb_logpmf(spark, d):
    pairs = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_linenumber").cast("int").alias("mult"), F.col("l_quantity").cast("int").alias("n")).distinct()
    return pairs.withColumn("lp", F.round(genotypes.negative_binomial_log_pmf("n", "0.4D", "(mult * 3.5D)"), 6))


@registered("poisson_logpmf", "select distinct cast(l_quantity as int) as n, round(cast(l_quantity as int) * ln(2.5) - 2.5 - lgamma(cast(l_quantity as int) + 1), 6) as lp from lineitem")
def poisson_logpmf(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_quantity").cast("int").alias("n")).distinct().withColumn("lp", F.round(genotypes.poisson_log_pmf("n", "2.5D"), 6))


@registered("kmer_hash_sample")
def kmer_hash_sample(spark, d):
    return kmers.drawn_sample(load(spark, d, "occ").select("kmer").distinct().where(sequence.drawn("kmer", 0.5, 7)), 1000, 7)


@registered("ambiguous_bases", f"{duck('seq')} select seq_id, run, cast(length(run) + 2 as int) as length, true as kept, true as filled from seq")
def ambiguous_bases(spark, d):
    """Runs with two ambiguous bases behind: the known ones stay, the others become bases."""
    told = load(spark, d, "seq").withColumn("x", sequence.sample_ambiguous(F.concat("run", F.lit("NN")), F.col("seq_id"), 1))
    return told.select("seq_id", "run", F.length("x").alias("length"), F.startswith("x", "run").alias("kept"), sequence.is_nucleotides("x").alias("filled"))


# ---- intervals

GROUPED = f"""{duck('ivl')}, pl as (select contig, pos, max(end_pos) as m from ivl group by contig, pos), pb as (select *, max(m) over (partition by contig order by pos rows between unbounded preceding and 1 preceding) as pe from pl),
pn as (select *, sum(case when pe is null or pos - pe >= 3 then 1 else 0 end) over (partition by contig order by pos rows unbounded preceding) - 1 as group_no from pb),
w as (select *, max(end_pos) over (partition by contig order by pos, end_pos rows between unbounded preceding and 1 preceding) as b from ivl), n as (select w.*, group_no from w join pn using (contig, pos)),
e as (select contig, cast(group_no as int) as group_no, min(pos) as start, max(end_pos) as "end", count(*) as n_variants from n group by contig, group_no)"""


@registered("interval_groups", f"{GROUPED} select * from e")
def interval_groups(spark, d):
    return intervals.group_extents(load(spark, d, "ivl"), 3)


CONTIGS = "c as (select contig, -1200 as first, 2600 as last from (select distinct p_partkey as contig from part))"


@registered(
    "interval_complement",
    f"""{GROUPED}, {CONTIGS}, r as (select contig, coalesce(b + 1, first) as start, pos - 1 as "end" from n join c using (contig)
    union all select contig, coalesce(m + 1, first), last from c left join (select contig, max(end_pos) as m from ivl group by contig) using (contig)) select * from r where "end" - start + 1 >= 3""",
)
def interval_complement(spark, d):
    contigs = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("contig"), F.lit(-1200).alias("first"), F.lit(2600).alias("last"))
    return intervals.complement(load(spark, d, "ivl"), contigs, 3)


@registered("interval_cover", f"{GROUPED} select contig, cast(sum(greatest(0, end_pos - greatest(pos - 1, coalesce(b, pos - 1)))) as bigint) as covered from n group by contig")
def interval_cover(spark, d):
    return intervals.covered(load(spark, d, "ivl"))


@registered(
    "interval_dependency",
    f"""{duck('ivl')} select contig, pos, end_pos, coalesce(max(end_pos) over (partition by contig order by pos range between unbounded preceding and 1 preceding) >= pos, false) as has_dependency from ivl""",
)
def interval_dependency(spark, d):
    return intervals.dependency(load(spark, d, "ivl")).select("contig", "pos", "end_pos", "has_dependency")


@registered(
    "unit_split",
    f"""{GROUPED}, t as (select *, coalesce(sum(n_variants) over (order by contig, group_no rows between unbounded preceding and 1 preceding), 0) as before from e),
    z as (select ceil(sum(n_variants) / greatest(1, floor(sum(n_variants) / 5000))) as size from e),
    u as (select 0 as unit, cast(0 as hugeint) as first union all select u.unit + 1, cast(min(t.before) as hugeint) from u, t, z where t.before >= u.first + z.size group by u.unit)
    select contig, group_no, n_variants, cast(max(unit) as int) as unit from t join u on first <= before group by all""",
)
def unit_split(spark, d):
    return intervals.units(intervals.group_extents(load(spark, d, "ivl"), 3), 5000).select("contig", "group_no", "n_variants", "unit")


@registered(
    "containment_join",
    f"""{duck('ivl')}, b as (select distinct contig, cast(floor(pos / 100) as int) as block from ivl), bl as (select contig, block, 100 * block as block_start, 100 * block + 79 as block_end from b)
    select contig, pos, end_pos, block from ivl join bl using (contig) where block_start <= pos and end_pos <= block_end""",
)
def containment_join(spark, d):
    ivl = load(spark, d, "ivl")
    blocks = ivl.select("contig", F.floor(F.col("pos") / 100).cast("int").alias("block")).distinct().withColumn("block_start", F.col("block") * 100).withColumn("block_end", F.col("block") * 100 + 79)
    return intervals.contained_in(ivl, blocks).select("contig", "pos", "end_pos", "block")


@registered(
    "nearest_enclosing",
    f"""{duck('ivl')}, i as (select distinct contig, pos, end_pos from ivl) select a.contig, a.pos, a.end_pos, b.pos as outer_pos, b.end_pos as outer_end from i a join i b on a.contig = b.contig and b.pos < a.pos and a.end_pos < b.end_pos
    qualify row_number() over (partition by a.contig, a.pos, a.end_pos order by b.end_pos - b.pos, b.pos) = 1""",
)
def nearest_enclosing(spark, d):
    return intervals.nearest_enclosing(load(spark, d, "ivl"))


@registered(
    "region_filter",
    f"""{duck('ivl')}, r as (select * from (values (7, 100, 400), (11, -500, 20), (11, 300, 301), (13, null, null), (17, 250, null)) v(contig, a, b))
    select contig, pos, end_pos, len from ivl where exists (select 1 from r where r.contig = ivl.contig and (r.b is null or pos <= r.b) and (r.a is null or end_pos >= r.a))""",
)
def region_filter(spark, d):
    regions = tables.regions(spark, "7:100-400,11:-500-20,11:300-301,13").withColumn("contig", F.col("contig").cast("long"))
    return intervals.overlapping(load(spark, d, "ivl"), regions.unionByName(spark.createDataFrame([(17, 250, None)], "contig long, region_start int, region_end int"))).select("contig", "pos", "end_pos", "len")


@registered(
    "genomic_intervals",
    f"""{GROUPED.replace("pos - pe >= 3", "pos - pe >= 1")}, t as (select contig, start + 1201 as start, coalesce(sum(n_variants) over (partition by contig order by group_no rows between unbounded preceding and 1 preceding), 0) as before from e),
    r as (select distinct contig, cast(0 as hugeint) as before, 1 as start from e union all select t.contig, cast(min(t.before) as hugeint), min(t.start) from r join t on t.contig = r.contig where t.before >= r.before + 5 group by t.contig)
    select contig, start - 1 as start, coalesce(lead(start) over (partition by contig order by start) - 2, 3999) as "end" from r""",
)
def genomic_intervals(spark, d):
    ivl = load(spark, d, "ivl").withColumns({"pos": F.col("pos") + 1201, "end_pos": F.col("end_pos") + 1201})
    return intervals.genomic_bins(ivl, ivl.select("contig").distinct().withColumn("length", F.lit(4000)), 5)


@registered(
    "cluster_components",
    f"""{duck('ivl')}, i as (select distinct contig, pos, end_pos from ivl), n as (select *, row_number() over (partition by contig order by pos, end_pos) as n from i),
    fl as (select contig, n, end_pos as f from n union select contig, n, pos from n where end_pos - pos >= 3),
    ed as (select distinct b.contig, a.n as u, b.n as v from fl a join n b on a.contig = b.contig and a.n < b.n and b.pos - a.f < 3 and (abs(b.pos - a.f) + 1 <= 3 or abs(b.end_pos - a.f) + 1 <= 3 or (b.pos < a.f and a.f < b.end_pos))),
    bi as (select contig, u, v from ed union all select contig, v, u from ed), re as (select contig, n, n as m from n union select re.contig, re.n, bi.v from re join bi on re.contig = bi.contig and re.m = bi.u),
    lo as (select contig, n, min(m) as m from re group by contig, n) select a.contig, a.pos, a.end_pos, b.pos as cluster from n a join lo using (contig, n) join n b on b.contig = a.contig and b.n = lo.m""",
)
def cluster_components(spark, d):
    return intervals.cluster_components(load(spark, d, "ivl").select("contig", "pos", "end_pos").distinct(), 3).select("contig", "pos", "end_pos", "cluster")


# ---- alleles and call sets

TRIM = f"""{duck('allele')}, t0 as (select *, least(length(ref), length(alt)) as n from allele),
t1 as (select *, cast(len(list_filter(range(1, n), lambda i: right(ref, i) = right(alt, i))) as int) as "right" from t0),
t2 as (select *, left(ref, length(ref) - "right") as r, left(alt, length(alt) - "right") as a from t1),
t3 as (select *, cast(len(list_filter(range(1, least(length(r), length(a)) + 1), lambda i: left(r, i) = left(a, i))) as int) as "left" from t2),
t as (select *, substr(r, "left" + 1) as tr, substr(a, "left" + 1) as ta from t3),
ty as (select *, case when alt = '*' then 'Missing' when alt = ref then 'Reference' when length(tr) = 1 and length(ta) = 1 then 'SNP' when length(tr) = length(ta) then 'Complex'
 when length(ta) = 0 then 'Deletion' when length(tr) = 0 then 'Insertion' else 'Complex' end as base_type,
 length(tr) = length(ta) and length(tr) >= 10 and len(list_filter(range(1, length(ta) + 1), lambda i: substr(reverse(translate(ta, 'ACGT', 'TGCA')), i, 1) = substr(tr, i, 1))) >= 0.95 * length(ta) as inv from t)"""


@registered("allele_trim", f'{TRIM} select variant_id, "right", "left", tr as trimmed_ref, ta as trimmed_alt from t where alt <> \'*\'')
def allele_trim(spark, d):
    return alleles.trimmed(load(spark, d, "allele").where("alt <> '*'")).select("variant_id", "right", "left", "trimmed_ref", "trimmed_alt")


@registered(
    "allele_type",
    f"""{TRIM} select variant_id, case when base_type = 'Complex' and inv then 'Inversion' else base_type end as type, cast(case when alt = '*' then 0 when alt = ref then length(alt) else length(ta) end as int) as length,
    cast(case when alt = '*' or alt = ref then 0 else length(ta) - length(tr) end as int) as sv_length from ty""",
)
def allele_type(spark, d):
    return alleles.allele_type(load(spark, d, "allele")).select("variant_id", "type", "length", "sv_length")


@registered(
    "allele_class",
    f"""{TRIM} select variant_id, case when length(tr) = 1 and length(ta) = 1 then 'SNV' when length(tr) = 0 then 'Insertion' when length(ta) = 0 then 'Deletion' else 'Complex' end as class from t where alt <> '*' and alt <> ref""",
)
def allele_class(spark, d):
    return alleles.allele_class(load(spark, d, "allele").where("alt <> '*' and alt <> ref")).select("variant_id", "class")


@registered(
    "inversion_test",
    f"""{duck('seq')}, p as (select seq_id, run, case when seq_id % 2 = 0 then reverse(translate(run, 'ACGT', 'TGCA')) else translate(run, 'A', 'C') end as other from seq)
    select seq_id, run, length(run) >= 10 and len(list_filter(range(1, length(run) + 1), lambda i: substr(reverse(translate(other, 'ACGT', 'TGCA')), i, 1) = substr(run, i, 1))) >= 0.95 * length(run) as inversion from p""",
)
def inversion_test(spark, d):
    p = load(spark, d, "seq").withColumn("other", F.when(F.col("seq_id") % 2 == 0, sequence.reverse_complement("run")).otherwise(F.translate("run", "A", "C")))
    return p.select("seq_id", "run", alleles.is_inversion("other", "run").alias("inversion"))


@registered(
    "homopolymer_run",
    f"""{duck('seq')}, p as (select seq_id, run, substr(run, 6, 1) as base, left(run, 5) as l, substr(run, 7) as r from seq)
    select seq_id, run, base, cast(1 + length(l) - length(rtrim(l, base)) + length(r) - length(ltrim(r, base)) as int) as run_length from p""",
)
def homopolymer_run(spark, d):
    base, length = alleles.homopolymer("run", "5")
    return load(spark, d, "seq").select("seq_id", "run", base.alias("base"), length.cast("int").alias("run_length"))


COMBINE = f"""{duck('callset')}, o as (select * from callset where ref <> alt), l as (select chrom, pos, max_by(ref, (length(ref), ref)) as full_ref from o group by chrom, pos),
cb as (select chrom, pos, full_ref as ref, alt || substr(full_ref, length(ref) + 1) as alt, callset from o join l using (chrom, pos)),
cs as (select chrom, pos, ref, alt, string_agg(distinct callset, ':' order by callset) as aco from cb group by chrom, pos, ref, alt)"""


@registered("combine_callsets", f"{COMBINE} select * from cs")
def combine_callsets(spark, d):
    return callsets.combine(load(spark, d, "callset"))


@registered("variant_origins", f"{COMBINE}, t as (select chrom, pos, unnest(string_split(aco, ':')) as tag from cs) select chrom, pos, string_agg(distinct tag, ':' order by tag) as origins from t group by chrom, pos")
def variant_origins(spark, d):
    return callsets.combine(load(spark, d, "callset")).groupBy("chrom", "pos").agg(F.collect_list("aco").alias("tags")).select("chrom", "pos", alleles.origins("tags").alias("origins"))


@registered("origin_filter", f"{COMBINE} select * from cs where len(list_filter(string_split(aco, ':'), lambda x: x <> 'PROMO BRUSHED STEEL' and x not like 'ECONOMY%')) > 0")
def origin_filter(spark, d):
    combined = callsets.combine(load(spark, d, "callset"))
    tags = [r[0] for r in load(spark, d, "callset").select("callset").distinct().where("callset like 'ECONOMY%'").collect()]
    return callsets.origin_filter(combined, [*tags, "PROMO BRUSHED STEEL"])


@registered("sv_filter", f"{TRIM} select variant_id, ref, alt, pos, chrom, cast(length(ta) - length(tr) as int) as sv_length from t where alt <> '*' and alt <> ref and length(alt) <= 20 and length(ta) - length(tr) between -2 and 3")
def sv_filter(spark, d):
    return callsets.sv_filter(load(spark, d, "allele").where("alt <> '*' and alt <> ref"), 20, -2, 3)


@registered(
    "annotate_similarity",
    f"""{TRIM}, q as (select variant_id, chrom, pos + "left" as p, tr, ta, cast(ceil(3.0 * greatest(length(tr), length(ta))) as int) as w from t where alt <> '*' and alt <> ref),
    an as (select variant_id as annotation_id, chrom, p as ap, tr as ar, ta as aa, unnest(list_distinct([p, p + greatest(0, length(tr) - 1)])) as place from q)
    select distinct variant_id, annotation_id from q join an on q.chrom = an.chrom and place between p - w and p + length(tr) + w - 1
    where case when length(tr) = 1 and length(ta) = 1 then p = place and tr = ar and ta = aa
      else 1 - (case when tr = '' or ar = '' then length(tr) + length(ar) else levenshtein(tr, ar) end + case when ta = '' or aa = '' then length(ta) + length(aa) else levenshtein(ta, aa) end) / (greatest(length(tr), length(ar)) + greatest(length(ta), length(aa))) >= 0.5 end""",
)
def annotate_similarity(spark, d):
    own = load(spark, d, "allele")
    return callsets.annotate(own, own.withColumnRenamed("variant_id", "annotation_id"))


# ---- genotypes


@registered("genotype_index", f"{duck('call')} select variant_id, sample, a, b, cast(b * (b + 1) / 2 + a as int) as g, a as low, b as high, 6 as n_genotypes from call")
def genotype_index(spark, d):
    c = load(spark, d, "call").withColumn("g", genotypes.genotype_index("a", "b"))
    low, high = genotypes.genotype_pair("g")
    return c.select("variant_id", "sample", "a", "b", "g", low.alias("low"), high.alias("high"), genotypes.possible_genotypes(F.lit(3), F.lit(2)).alias("n_genotypes"))


@registered(
    "allele_stats",
    f"""{duck('call')}, x as (select variant_id, unnest([a, b]) as allele from call where missing = 0), p as (select variant_id, allele, count(*) as ac from x group by all)
    select variant_id, allele, ac, sum(ac) over (partition by variant_id)::bigint as an, round(ac / sum(ac) over (partition by variant_id), 6) as af from p""",
)
def allele_stats(spark, d):
    return rounded(genotyping.allele_stats(load(spark, d, "call"), F.col("missing") == 1), "af")


@registered(
    "inbreeding",
    f"""{duck('call')}, o as (select * from call where missing = 0 and sample < 9 and nak >= 2), p as (select variant_id, count(*) as n, sum(case when a <> b then 1 else 0 end) as h from o group by variant_id),
    c as (select variant_id, allele, count(*) as k from (select variant_id, unnest([a, b]) as allele from o) group by all), s as (select variant_id, sum(k * k) as sq from c group by variant_id)
    select variant_id, n as n_samples, round(case when h > 0 then 1 - h / (n * (1 - sq / (4.0 * n * n))) end, 6) as ibc from p join s using (variant_id)""",
)
def inbreeding(spark, d):
    return rounded(genotyping.inbreeding(load(spark, d, "call"), F.expr("missing = 0 and sample < 9 and nak >= 2")), "ibc")


@registered("summary_table", f"{duck('call')} select a, b, missing, app >= 0.95 as confident, count(*) as n_rows from call group by all")
def summary_table(spark, d):
    return genotyping.summary(load(spark, d, "call").withColumn("confident", F.col("app") >= 0.95), "a", "b", "missing", "confident")


@registered("collapse_summary", f"{duck('call')} select a, b, missing, count(*)::bigint as n_rows, sum(nak)::bigint as nak from call group by all")
def collapse_summary(spark, d):
    per = load(spark, d, "call").groupBy("sample", "a", "b", "missing").agg(F.count("*").alias("n_rows"), F.sum("nak").alias("nak"))
    return genotyping.collapse(per.drop("sample"), ["n_rows", "nak"])


@registered("genotype_counts", f"{duck('call')} select variant_id, cast(b * (b + 1) / 2 + a as int) as genotype, count(*) as n from call where missing = 0 group by all")
def genotype_counts(spark, d):
    return genotyping.genotype_counts(load(spark, d, "call"))


@registered(
    "ploidy_lookup",
    """select n_nationkey as sample, chrom, case when n_nationkey % 2 = 0 then case chrom when 'chrX' then 2 when 'Y' then 0 else 2 end else case when chrom in ('chrX', 'Y') then 1 else 2 end end as ploidy,
    case chrom when 'chrX' then 'x' when 'Y' then 'y' when 'chrMT' then 'mt' when 'GL1' then 'unknown' else 'autosomal' end as class from nation, (values ('chrX'), ('Y'), ('chr7'), ('chrMT'), ('GL1')) v(chrom)""",
)
def ploidy_lookup(spark, d):
    who = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("sample"), F.explode(F.array(*map(F.lit, ("chrX", "Y", "chr7", "chrMT", "GL1")))).alias("chrom"))
    return who.select("sample", "chrom", alleles.default_ploidy("chrom", F.col("sample") % 2 == 0).alias("ploidy"), alleles.contig_class("chrom").alias("class"))


@registered(
    "nested_genotypes",
    f"""{duck('ivl')}, c as (select contig, pos, len % 3 as allele, len % 4 > 0 as phased, len % 3 = 2 and pos % 2 = 0 as missing, case when len % 3 = 0 or (len % 3 = 2 and pos % 2 = 0) then 1 else len end as span from ivl),
    m as (select contig, pos, min(struct_pack(span := span, allele := allele, phased := phased, missing := missing)) as x from c group by contig, pos),
    n as (select contig, pos, x.allele as allele, x.phased as phased, x.missing as missing, x.span as span, row_number() over (partition by contig order by pos) as n from m),
    r as (select contig, n, pos, true as clear, pos + span - 1 as last from n where n = 1 union all select n.contig, n.n, n.pos, r.last < n.pos, case when r.last < n.pos then n.pos + n.span - 1 else r.last end from r join n on n.contig = r.contig and n.n = r.n + 1)
    select contig as chrom, pos, case when case when phased then not clear else missing end then 0 else allele end as allele from n join r using (contig, n, pos)""",
)
def nested_genotypes(spark, d):
    c = load(spark, d, "ivl").withColumns({"allele": F.col("len") % 3, "phased": F.col("len") % 4 > 0, "missing": (F.col("len") % 3 == 2) & (F.col("pos") % 2 == 0)})
    rows = c.withColumn("span", F.when((F.col("allele") == 0) | F.col("missing"), 1).otherwise(F.col("len")))
    calls = rows.groupBy(F.col("contig").alias("chrom"), "pos").agg(F.min(F.struct("span", "allele", "phased", "missing")).alias("x")).select("chrom", F.lit(1).alias("sample"), F.lit(0).alias("hap"), "pos", "x.*")
    return genotyping.nested_genotypes(calls).select("chrom", "pos", "allele")


# ---- inference

MODEL = inference.CountModel(p=0.5, size=2.0, rate=0.5)


@registered(
    "exact_posterior",
    f"""{duck('hap', 'talk')}, s as (select distinct sample from talk), h as (select cluster, count(distinct hap) as h from hap group by cluster), hh as (select distinct cluster, hap from hap), k as (select distinct cluster, kmer from hap),
    pr as (select a.cluster, a.hap as hap1, b.hap as hap2 from hh a join hh b on a.cluster = b.cluster and a.hap <= b.hap),
    x as (select pr.cluster, s.sample, hap1, hap2, coalesce(m1.mult, 0) + coalesce(m2.mult, 0) as mult, least(255, coalesce(t.n, 0)) as n from pr join k using (cluster) cross join s
      left join hap m1 on m1.cluster = pr.cluster and m1.hap = hap1 and m1.kmer = k.kmer left join hap m2 on m2.cluster = pr.cluster and m2.hap = hap2 and m2.kmer = k.kmer left join talk t on t.kmer = k.kmer and t.sample = s.sample),
    y as (select cluster, sample, hap1, hap2, sum(case when mult = 0 then n * ln(0.5) - 0.5 - lgamma(n + 1) else lgamma(n + mult * 2.0) - lgamma(n + 1) - lgamma(mult * 2.0) + mult * 2.0 * ln(0.5) + n * ln(0.5) end) as ll from x group by all),
    z as (select *, ll - 2 * ln(h) + case when hap1 = hap2 then 0 else ln(2) end as zz from y join h using (cluster)), e as (select *, exp(zz - max(zz) over (partition by cluster, sample)) as w from z)
    select cluster, sample, hap1, hap2, round(w / sum(w) over (partition by cluster, sample), 6) as posterior from e""",
)
def exact_posterior(spark, d):
    counts = load(spark, d, "talk")
    return rounded(inference.exact_posterior(load(spark, d, "hap"), counts, counts.select("sample").distinct(), MODEL), "posterior")


@registered("gibbs_posterior")
def gibbs_posterior(spark, d):
    counts = load(spark, d, "talk")
    return inference.gibbs_posterior(load(spark, d, "hap"), counts, counts.select("sample").distinct(), MODEL)


@registered("noise_trace")
def noise_trace(spark, d):
    return inference.noise_trace(kmers.noise_histogram(sample_counts(spark, d)))


# ---- tools, lookups and text forms


@registered(
    "genotype_parse",
    f"""{duck('call')} select variant_id, sample, case when missing = 1 then 1 else 2 end as ploidy, missing = 1 or sample % 2 = 1 as phased, case when missing = 1 then 'Missing' when a = 2 then 'Partial' else 'Complete' end as status,
    case when missing = 1 then -1 when a = 2 then -1 else a end as first from call""",
)
def genotype_parse(spark, d):
    sep = F.when(F.col("sample") % 2 == 1, "|").otherwise("/")
    gt = F.when(F.col("missing") == 1, ".").otherwise(F.concat(F.when(F.col("a") == 2, ".").otherwise(F.col("a").cast("string")), sep, F.col("b").cast("string")))
    parsed = load(spark, d, "call").withColumn("_gt", gt).withColumns(genotypes.parse("_gt"))
    return parsed.select("variant_id", "sample", "ploidy", "phased", "status", F.coalesce(F.get("gt", F.lit(0)), F.lit(-1)).alias("first"))


@registered("remove_alleles", f"{duck('call')} select variant_id, sample, case a when 0 then 0 when 2 then 1 else -1 end as a, case b when 0 then 0 when 2 then 1 else -1 end as b, case b when 2 then 1 else 0 end as to_ref from call")
def remove_alleles(spark, d):
    c = load(spark, d, "call").withColumn("gt", F.array("a", "b"))
    keep = F.array(F.lit(2))
    gone = alleles.remove_alleles("gt", keep)
    return c.select("variant_id", "sample", F.coalesce(gone[0], F.lit(-1)).alias("a"), F.coalesce(gone[1], F.lit(-1)).alias("b"), alleles.remove_alleles("gt", keep, True)[1].alias("to_ref"))


@registered(
    "symbolic_expand",
    """with p as (select p_partkey as id, substr('ACGTTGCATC', 1 + cast(p_partkey % 10 as int), 1) as ref, substr(repeat('ACGTTGCATC', 3), 2 + cast(p_partkey % 10 as int), 1 + cast(p_size % 9 as int)) as segment, p_partkey % 6 as kind from part)
    select id, case when kind = 5 then ref else ref || segment end as new_ref, case kind when 0 then ref when 1 then ref || segment || segment when 2 then ref || reverse(translate(segment, 'ACGT', 'TGCA')) when 3 then ref || segment || segment || segment when 4 then null else ref || 'TTT' end as new_alt from p""",
)
def symbolic_expand(spark, d):
    k = F.col("p_partkey") % 10
    p = spark.read.parquet(f"{d}/part.parquet").select(
        F.col("p_partkey").alias("id"), F.substr(F.lit("ACGTTGCATC"), (1 + k).cast("int"), F.lit(1)).alias("ref"), F.substr(F.lit("ACGTTGCATC" * 3), (2 + k).cast("int"), (1 + F.col("p_size") % 9).cast("int")).alias("segment"),
        F.get(F.array(*map(F.lit, ("<DEL>", "<DUP>", "<INV>", "<CN3>", "<XX>", "<INS>"))), (F.col("p_partkey") % 6).cast("int")).alias("alt"), F.lit("TTT").alias("insert"),
    )
    return callsets.expand_symbolic(p).select("id", "new_ref", "new_alt")


@registered("genome_lookup", f"{duck('seq')}, g as (select cast(seq_id as varchar) as id, string_agg(run, '' order by run) as seq from seq group by seq_id) select id as chrom, cast(x as int) as \"at\", nullif(substr(seq, cast(x as int) + 1, 4), '') as bases from g, (select unnest(range(0, 57, 7)) as x) a")
def genome_lookup(spark, d):
    g = load(spark, d, "seq").groupBy(F.col("seq_id").cast("string").alias("id")).agg(F.array_join(F.sort_array(F.collect_list("run")), "").alias("seq"))
    places = g.select(F.col("id").alias("chrom"), F.explode(F.sequence(F.lit(0), F.lit(56), F.lit(7))).alias("at")).withColumn("n", F.lit(4))
    return fasta.lookup(places, fasta.chunks(g, 16, 3), 16).select("chrom", "at", F.nullif("bases", F.lit("")).alias("bases"))


@registered("vcf_lines", f"{COMBINE}, a as (select chrom, pos, ref, string_agg(alt, ',' order by alt) as alts, string_agg(aco, ',' order by alt) as aco from cs group by all) select replace(chrom, ' ', '_') || chr(9) || pos || chr(9) || '.' || chr(9) || ref || chr(9) || alts || chr(9) || '.' || chr(9) || 'PASS' || chr(9) || 'ACO=' || aco as value from a")
def vcf_lines(spark, d):
    rows = callsets.combine(load(spark, d, "callset")).groupBy("chrom", "pos", "ref").agg(F.sort_array(F.collect_list(F.struct("alt", "aco"))).alias("x"))
    none = F.array().cast("array<string>")
    return vcf.to_lines(
        rows.select(F.replace("chrom", F.lit(" "), F.lit("_")).alias("chrom"), "pos", none.alias("ids"), "ref", F.col("x.alt").alias("alts"), F.lit(None).cast("double").alias("qual"), F.array(F.lit("PASS")).alias("filters"), F.create_map(F.lit("ACO"), F.array_join(F.col("x.aco"), ",")).alias("info"), none.alias("format"), none.alias("raw"))
    )


@registered("repeat_attribute", f"{GROUPED}, k as (select contig, sum(greatest(0, end_pos - greatest(pos - 1, coalesce(b, pos - 1)))) as c from n group by contig) select 'c' as chrom, cast(contig as int) as pos, 1 as alt_idx, 'All#' || cast(c as bigint) as rma from k")
def repeat_attribute(spark, d):
    ivl = load(spark, d, "ivl")
    repeats = ivl.select(F.concat_ws("_", F.lit("c"), "contig", F.lit(1)).alias("key"), F.col("pos").alias("start"), F.col("end_pos").alias("end"), F.lit("All").alias("family"))
    return tools.repeat_attribute(ivl.select(F.lit("c").alias("chrom"), F.col("contig").cast("int").alias("pos"), F.lit(1).alias("alt_idx")).distinct(), repeats).select("chrom", "pos", "alt_idx", "rma")


@registered("value_format", f"{duck('call')} select variant_id, sample, case when missing = 1 then '1' else '0' end as flag, case when missing = 1 then 'NA' else printf('%.4f', app) end as app, case when a = 2 then 'NA' else cast(a as varchar) end as a from call")
def value_format(spark, d):
    c = load(spark, d, "call")
    app = tools.formatted(F.when(F.col("missing") == 0, F.col("app")), "float")
    return c.select("variant_id", "sample", tools.formatted(F.col("missing") == 1, "flag").alias("flag"), app.alias("app"), tools.formatted(F.when(F.col("a") != 2, F.col("a")), "int").alias("a"))


@registered("haplotype_graph")
def haplotype_graph(spark, d):
    """Candidate haplotypes of the combined call sets: places within k of one another are a cluster, each with its graph."""
    reference = "ACGTTGCATCAG" * 8
    rows = callsets.combine(load(spark, d, "callset")).withColumn("pos", F.col("pos") - 1)
    places = rows.groupBy("chrom", "pos", "ref").agg(F.sort_array(F.collect_set("alt")).alias("alts"))
    told = intervals.groups(places.select(F.col("chrom").alias("contig"), "pos", (F.col("pos") + F.length("ref") - 1).alias("end_pos"), "ref", "alts"), 5)
    clusters = told.groupBy("contig", "group_no").agg(F.sort_array(F.collect_list(F.struct("pos", "ref", "alts"))).alias("variants"))
    ready = clusters.select(F.concat_ws("/", "contig", F.col("group_no").cast("string")).alias("cluster"), "variants", F.lit(reference).alias("reference"), F.lit(0).alias("first"), sequence.canonical_kmers(F.lit(reference), 5).alias("kmers"))
    return graph.haplotypes(ready, 5)


@registered("annotate_self", SQL["annotate_similarity"].replace("    where case when", "    where not (p = ap and tr = ar and ta = aa) and case when"))
def annotate_self(spark, d):
    own = load(spark, d, "allele")
    return callsets.annotate(own, own.withColumnRenamed("variant_id", "annotation_id"), skip_same=True)


@registered("homopolymer_alleles", f"{TRIM} select variant_id, length(replace(tr, 'A', '')) = 0 and length(replace(ta, 'A', '')) = 0 and abs(length(tr) - length(ta)) between 1 and 3 as change from t where alt <> '*' and alt <> ref")
def homopolymer_alleles(spark, d):
    t = alleles.trimmed(load(spark, d, "allele").where("alt <> '*' and alt <> ref")).withColumn("base", F.lit("A"))
    return t.select("variant_id", alleles.is_homopolymer_change("trimmed_ref", "trimmed_alt", "base", 3).alias("change"))


@registered("joint_noise")
def joint_noise(spark, d):
    counts = load(spark, d, "talk")
    terms = inference.diplotype_terms(load(spark, d, "hap"), counts, counts.select("sample").distinct(), MODEL)
    return inference.joint_noise(terms, chains=4)


@registered("kmer_subsample", f"{duck('hap')}, r as (select *, row_number() over (partition by cluster, hap order by kmer) as n from hap) select * from hap where (cluster, kmer) in (select (cluster, kmer) from r where n <= 5)")
def kmer_subsample(spark, d):
    """The first five k-mers of each haplotype of each cluster, with their copies in the others."""
    return inference.subsample_kmers(load(spark, d, "hap").withColumn("variants", F.array(F.lit(0))), 1.0, 5, None).drop("variants")


@registered(
    "diplotypes",
    f"""{COMBINE}, a as (select chrom, cast(length(alt) % 2 as int) as hap, pos - 1 as pos, min(struct_pack(ref := ref, alt := alt)) as x from cs group by all),
    n as (select chrom, hap, pos, pos + length(x.ref) as last, x.alt as alt, row_number() over (partition by chrom, hap order by pos) as n from a),
    r as (select chrom, hap, n, pos, 0 as since, true as clear, last from n where n = 1 union all
      select n.chrom, n.hap, n.n, n.pos, r.last, r.last <= n.pos, case when r.last <= n.pos then n.last else r.last end from r join n on n.chrom = r.chrom and n.hap = r.hap and n.n = r.n + 1)
    select chrom, 1 as sample, hap, string_agg(substr(repeat('ACGTTGCATCAG', 8), cast(since + 1 as int), cast(pos - since as int)) || alt, '' order by pos) || substr(repeat('ACGTTGCATCAG', 8), cast(max(last) + 1 as int)) as seq
    from r join n using (chrom, hap, n, pos, last) where clear group by chrom, hap""",
)
def diplotypes(spark, d):
    """Two haplotypes of each brand's sequence with the call sets' alleles put in."""
    calls = callsets.combine(load(spark, d, "callset")).select(F.col("chrom"), F.lit(1).alias("sample"), (F.length("alt") % 2).alias("hap"), (F.col("pos") - 1).alias("pos"), "ref", "alt")
    return tools.diplotypes(calls, calls.select(F.col("chrom").alias("id")).distinct().withColumn("seq", F.lit("ACGTTGCATCAG" * 8)))


from . import output, roundtrips, runs, variants  # noqa: E402, F401  (they register their queries)
