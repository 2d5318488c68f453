"""Queries of genotype output: filters, estimates, statistics and VCF text of calls with all that a genotyper tells."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions.genotypes import six_digits
from strandline.operators import calling, genotyping, tools

from .adapters import duck, load
from .registry import registered, rounded

#: Least share of observed k-mers of each sample.
SHARE = "1 - exp(-0.275 * (1 + cast(sample as double) / 4))"
GENOTYPES = "['0/0', '0/1', '1/1', '0/2', '1/2', '2/2']"

ESTIMATED = f"""{duck('rich')}, es0 as (select *, {SHARE} as ls, list_max(gpp) as m from rich),
es1 as (select *, list_transform(range(1, len(app) + 1), lambda i: case when app[i] = 0 then 0 else (case when nak[i] < 1 then 1 else 0 end) + (case when nak[i] <> 0 and fak[i] < ls then 2 else 0 end) end) as saf,
  case when len(list_filter(gpp, lambda x: x = m)) = 1 then list_position(gpp, m) - 1 end as best from es0),
es2 as (select *, case ploidy when 2 then case best when 0 then [0, 0] when 1 then [0, 1] when 2 then [1, 1] when 3 then [0, 2] when 4 then [1, 2] when 5 then [2, 2] end when 1 then case when best is not null then [best] end end as gt from es1),
es as (select *, case when gt is not null and m >= 0.6 and len(list_filter(gt, lambda g: saf[g + 1] > 0)) = 0 then gt end as genotype from es2)"""

STATS = f"""{ESTIMATED}, al as (select variant_id, sample, genotype, saf, app, unnest(range(0, 3)) as i from es),
ct as (select variant_id, i, sum(case when genotype is null then 0 else len(list_filter(genotype, lambda g: g = i)) end)::int as n, max(case when len(app) > 0 and saf[i + 1] = 0 then app[i + 1] else 0 end) as p from al group by variant_id, i),
st as (select variant_id, sum(n)::int as an, max(case when i = 1 then n end) as ac1, max(case when i = 2 then n end) as ac2, max(case when i = 0 then p end) as acp0, max(case when i = 1 then p end) as acp1, max(case when i = 2 then p end) as acp2 from ct group by variant_id),
sq as (select *, greatest(acp1, acp2) as mp from st), sr as (select *, case when abs(mp - 1) < 1e-5 then 99.0 when mp = 0 then 0.0 else -10 * log10(1 - mp) end as qual from sq)"""


def rich(spark, d):
    return load(spark, d, "rich").withColumn("least_share", F.expr(SHARE))


def estimated(spark, d):
    return calling.estimate(rich(spark, d), 0.6, 1.0)


@registered(
    "genotype_filter",
    f"""{ESTIMATED} select variant_id, sample, coalesce(array_to_string(saf, ','), '') as saf, case when ploidy = 0 then '' when genotype is not null then array_to_string(genotype, '/') when ploidy = 2 then './.' else '.' end as genotype,
    case when ploidy = 0 then null when abs(m - 1) < 1e-5 then 99 else cast(floor(-10 * log10(1 - m)) as int) end as gq from es""",
)
def genotype_filter(spark, d):
    text = F.array_join(F.transform("genotype", lambda g: F.coalesce(g.cast("string"), F.lit("."))), "/")
    return estimated(spark, d).select("variant_id", "sample", F.array_join(F.col("saf").cast("array<string>"), ",").alias("saf"), text.alias("genotype"), "gq")


@registered("variant_statistics", f"""{STATS} select variant_id, an, ac1 || ',' || ac2 as ac, round(case when an > 0 then ac2 / an else 0 end, 6) as af2, round(acp0, 6) as acp0, round(acp1, 6) as acp1, round(qual, 5) as qual, case when an = 0 then 'AN0' else 'PASS' end as filter from sr""")
def variant_statistics(spark, d):
    told = calling.statistics(estimated(spark, d))
    return rounded(told.select("variant_id", "an", F.array_join(F.col("ac").cast("array<string>"), ",").alias("ac"), F.col("af")[1].alias("af2"), F.col("acp")[0].alias("acp0"), F.col("acp")[1].alias("acp1"), F.round("qual", 5).alias("qual"), "filter"), "af2", "acp0", "acp1")


@registered("variant_statistics_samples", f"""{STATS.replace("from es)", "from es where regexp_full_match(cast(sample as varchar), '[0-4]'))", 1)} select variant_id, an, ac1, ac2 from sr""")
def variant_statistics_samples(spark, d):
    own = estimated(spark, d)
    told = calling.statistics(own, samples="[0-4]").where(F.size("ac") > 0)
    return told.select("variant_id", "an", F.col("ac")[0].alias("ac1"), F.col("ac")[1].alias("ac2"))


FILTERED = f"""{STATS}, ho as (select variant_id, sum(case when ploidy = 0 then 1 when gt is not null and gt[1] = gt[-1] then 1 else 0 end) as n_homozygotes from es group by variant_id),
fi as (select variant_id, an, n_homozygotes::bigint as n_homozygotes, round(qual, 5) as qual, case when an = 0 and n_homozygotes < 2 then 'AN0;HOM' when an = 0 then 'AN0' when n_homozygotes < 2 then 'HOM' else 'PASS' end as filter from sr join ho using (variant_id))"""


def filtered(spark, d):
    return calling.filtered(rich(spark, d), 2, 0.6, 1.0)


@registered("filter_tool", f"{FILTERED} select * from fi")
def filter_tool(spark, d):
    return filtered(spark, d).select("variant_id", "an", "n_homozygotes", F.round("qual", 5).alias("qual"), "filter")


@registered("filter_counts", f"{FILTERED} select filter, count(*) as n from fi group by filter")
def filter_counts(spark, d):
    return tools.filter_counts(filtered(spark, d))


@registered("reset_filters", f"{ESTIMATED} select variant_id, sample, case when ploidy = 0 then '' when gt is not null then array_to_string(gt, '/') when ploidy = 2 then './.' else '.' end as genotype, coalesce(list_sum(list_transform(app, lambda x: 0)), 0)::int as saf from es")
def reset_filters(spark, d):
    told = calling.reset(rich(spark, d))
    return told.select("variant_id", "sample", F.array_join(F.transform("genotype", lambda g: F.coalesce(g.cast("string"), F.lit("."))), "/").alias("genotype"), F.aggregate("saf", F.lit(0), lambda s, x: s + x).alias("saf"))


@registered(
    "called_alleles",
    f"""{duck('rich')} select variant_id, sample, coalesce(array_to_string(list_filter(range(0, len(app)), lambda i: app[i + 1] >= 0.3), ','), '') as called, coalesce(array_to_string(list_filter(range(0, len(app)), lambda i: app[i + 1] <> 0), ','), '') as possible from rich""",
)
def called_alleles(spark, d):
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    return load(spark, d, "rich").select("variant_id", "sample", text(calling.called_alleles("app", 0.3)).alias("called"), text(calling.possible_alleles("app")).alias("possible"))


@registered("six_digits", "select distinct x, case when x = 0 then '0' else printf('%g', x) end as told from (select unnest([sqrt(l_extendedprice), sqrt(l_extendedprice) / 1e8, 1 / l_quantity, l_discount, l_tax / 7, sqrt(l_extendedprice) * 1e6, l_quantity]) as x from lineitem) y")
def six_digit_texts(spark, d):
    x = F.expr("explode(array(sqrt(l_extendedprice), sqrt(l_extendedprice) / 100000000D, 1D / l_quantity, l_discount, l_tax / 7D, sqrt(l_extendedprice) * 1000000D, l_quantity))")
    return spark.read.parquet(f"{d}/lineitem.parquet").select(x.alias("x")).distinct().withColumn("told", F.expr(six_digits("x")))


NUMBERS = "array_to_string(list_transform({0}, lambda x: case when x = 0 then '0' else printf('%g', x) end), ',')"
SAMPLES = list(range(10))


@registered(
    "genotype_vcf",
    f"""{STATS}, tx as (select variant_id, sample, case when ploidy = 0 then ':.:.:.:.:.:.' else case when genotype is not null then array_to_string(genotype, '/') when ploidy = 2 then './.' else '.' end || ':' ||
      cast(case when abs(m - 1) < 1e-5 then 99 else cast(floor(-10 * log10(1 - m)) as int) end as varchar) || ':' || {NUMBERS.format('gpp')} || ':' || {NUMBERS.format('app')} || ':' || {NUMBERS.format('nak')} || ':' || {NUMBERS.format('fak')} || ':' || {NUMBERS.format('mac')} || ':' || array_to_string(saf, ',') end as t from es),
    gr as (select variant_id, s.s as sample, coalesce(tx.t, ':.:.:.:.:.:.') as t from (select distinct variant_id from es) v cross join range(10) s(s) left join tx using (variant_id) where tx.sample = s.s or tx.sample is null),
    al2 as (select v.variant_id, s.s as sample, coalesce(tx.t, ':.:.:.:.:.:.') as t from (select distinct variant_id from es) v cross join range(10) s(s) left join tx on tx.variant_id = v.variant_id and tx.sample = s.s),
    ag as (select variant_id, string_agg(t, chr(9) order by sample) as ts from al2 group by variant_id)
    select 'c' || (variant_id % 5) || chr(9) || variant_id || chr(9) || 'v' || variant_id || chr(9) || 'A' || chr(9) || 'C,G' || chr(9) || case when qual = 0 then '0' else printf('%g', qual) end || chr(9) || case when an = 0 then 'AN0' else 'PASS' end || chr(9) ||
      'AC=' || ac1 || ',' || ac2 || ';ACO=x,.;ACP=' || {NUMBERS.format('[acp0, acp1, acp2]')} || ';AF=' || {NUMBERS.format('[case when an > 0 then ac1 / an else 0 end, case when an > 0 then ac2 / an else 0 end]')} || ';AN=' || an
      || case when variant_id % 2 = 0 then ';ANC=0,2' else '' end || ';HC=4;VCGR=g:1-9;VCGS=3;VCR=r:1-5;VCS=2' || chr(9) || 'GT:GQ:GPP:APP:NAK:FAK:MAC:SAF' || chr(9) || ts as value from sr join ag using (variant_id)""",
)
def genotype_vcf(spark, d):
    from strandline.sources import vcf

    calls = estimated(spark, d)
    none = F.array().cast("array<int>")
    sites = calls.select("variant_id").distinct().select(
        "variant_id", (F.col("variant_id") % 5).alias("contig_idx"), F.concat(F.lit("c"), F.col("variant_id") % 5).alias("chrom"), F.col("variant_id").alias("pos"), F.concat(F.lit("v"), "variant_id").alias("id"), F.lit("A").alias("ref"),
        F.array(F.lit("C"), F.lit("G")).alias("alts"), F.lit(2).alias("vcs"), F.lit("r:1-5").alias("vcr"), F.lit(3).alias("vcgs"), F.lit("g:1-9").alias("vcgr"), F.lit(4).alias("hc"),
        F.when(F.col("variant_id") % 2 == 0, F.array(F.lit(2), F.lit(0))).otherwise(none).alias("anc"), F.array(F.lit("x"), F.lit(None).cast("string")).alias("aco"),
    )
    return vcf.to_lines(calling.genotyped(sites, calls, SAMPLES))


@registered("inbreeding_attribute", f"{duck('call')}, o as (select * from call where missing = 0), p as (select variant_id, count(*) as n, sum(case when a <> b then 1 else 0 end) as h from o group by variant_id), c as (select variant_id, allele, count(*) as k from (select variant_id, unnest([a, b]) as allele from o) group by all), s as (select variant_id, sum(k * k) as sq from c group by variant_id) select variant_id, case when h > 0 then printf('%.6f', 1 - h / (n * (1 - sq / (4.0 * n * n)))) else 'NA' end || ':' || n as ibc from p join s using (variant_id)")
def inbreeding_attribute(spark, d):
    return tools.inbreeding_attribute(load(spark, d, "call"))


@registered(
    "least_kmers",
    f"""{duck('rich')}, x as (select variant_id, unnest(range(0, 3)) as allele, nak, fak from rich where len(app) > 0) select variant_id, cast(allele as int) as allele, min(nak[allele + 1]) as nak, min(case when fak[allele + 1] <> -1 then fak[allele + 1] end) as fak from x group by all""",
)
def least_kmers(spark, d):
    return genotyping.least_kmers(load(spark, d, "rich"))
