"""Queries of variants with all their alts, and of the call-set tools as wholes."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import alleles, genotypes, variants
from strandline.operators import callsets, genotyping, intervals
from strandline.sources import tables, vcf

from . import genotype
from .adapters import duck, load
from .catalogue import COMBINE, TRIM
from .registry import registered

REPEAT = "ACGTTGCATCAG" * 8
SITES = f"{COMBINE}, si as (select chrom, pos, ref, list(alt order by alt) as alts, list(aco order by alt) as aco, min(length(ref)) as n from cs group by chrom, pos, ref)"
COMMON = "len(list_filter(range(1, least(length({0}), length({1}))), lambda i: right({0}, i) = right({1}, i)))"
RT = f"{SITES}, rt as (select *, list_min(list_transform(alts, lambda a: {COMMON.format('ref', 'a')})) as trimmed from si)"


def sites(spark, d):
    rows = callsets.combine(load(spark, d, "callset")).groupBy("chrom", "pos", "ref").agg(F.sort_array(F.collect_list(F.struct("alt", "aco"))).alias("x"))
    return rows.select("chrom", "pos", "ref", F.col("x.alt").alias("alts"), F.col("x.aco").alias("aco"))


def joined(df, *names):
    return df.withColumns({n: F.array_join(F.col(n).cast("array<string>"), ",") for n in names})


@registered("variant_right_trim", f"{RT} select chrom, pos, left(ref, length(ref) - trimmed) as ref, array_to_string(list_transform(alts, lambda a: left(a, length(a) - trimmed)), ',') as alts, cast(trimmed as int) as trimmed from rt")
def variant_right_trim(spark, d):
    return joined(variants.right_trimmed(sites(spark, d)), "alts").select("chrom", "pos", "ref", "alts", "trimmed")


@registered("combine_tool", f"{RT} select chrom, pos, left(ref, length(ref) - trimmed) as ref, array_to_string(list_transform(alts, lambda a: left(a, length(a) - trimmed)), ',') as alts, array_to_string(aco, ',') as aco from rt")
def combine_tool(spark, d):
    return joined(callsets.combined(load(spark, d, "callset"), unambiguous=True), "alts", "aco")


@registered(
    "variant_types",
    f"""{TRIM}, al as (select variant_id, case when base_type = 'Complex' and inv then 'Inversion' else base_type end as type from ty where alt <> '*' and alt <> ref) select variant_id, case when variant_id % 4 = 3 then 'Multi' else type end as type, variant_id % 2 = 1 as missing from al""",
)
def variant_types(spark, d):
    rows = load(spark, d, "allele").where("alt <> '*' and ref <> alt")
    more = F.when(F.col("variant_id") % 4 == 3, F.array("alt", F.lit("TTTTT"), F.lit("*"))).when(F.col("variant_id") % 4 == 1, F.array("alt", F.lit("*"))).otherwise(F.array("alt"))
    return variants.variant_type(rows.select("variant_id", "ref", more.alias("alts"))).select("variant_id", "type", variants.has_missing("alts").alias("missing"))


CLASSES = f"""{TRIM}, c as (select chrom, pos, case when length(ref) < 8 then null when length(tr) = 1 and length(ta) = 1 then 'SNV' when length(tr) = 0 then 'Insertion' when length(ta) = 0 then 'Deletion' else 'Complex' end as class from t where alt <> '*' and alt <> ref),
g as (select chrom || '/' || pos as variant_id, min(class) as a, max(class) as b from c group by 1) select variant_id, case when a is null then 'Unsupported' when a <> b then 'Mixture' else a end as class from g"""


@registered("variant_classes", CLASSES)
def variant_classes(spark, d):
    rows = load(spark, d, "allele").where("alt <> '*' and ref <> alt").withColumn("variant_id", F.concat_ws("/", "chrom", "pos"))
    return variants.variant_class(rows, excluded=F.length("ref") < 8)


@registered(
    "variant_predicates",
    """select p_partkey as variant_id, p_partkey % 3 = 0 or p_partkey % 5 = 0 as ambiguous, p_partkey % 7 = 0 as missing, p_partkey % 4 = 1 as annotated, case when p_partkey % 2 = 0 then p_size else 0 end as alu,
    case when p_partkey % 5 = 0 then 'invalid' when p_partkey % 7 = 0 then 'missing' when p_partkey % 11 = 0 then 'id' when p_partkey % 13 = 0 then 'id' else 'sequence' end as kind from part""",
)
def variant_predicates(spark, d):
    k = F.col("p_partkey")
    alt = F.when(k % 5 == 0, "ACZ").when(k % 7 == 0, "*").when(k % 11 == 0, "<DEL>").when(k % 13 == 0, "G]17:198982]").otherwise(F.lit("acR"))
    p = spark.read.parquet(f"{d}/part.parquet").select(
        k.alias("variant_id"), F.when(k % 3 == 0, "ANG").otherwise(F.lit("ACG")).alias("ref"), F.array(F.when(k % 5 == 0, "ACN").otherwise(F.lit("<INS>")), F.when(k % 7 == 0, "*").otherwise(F.lit("T"))).alias("alts"),
        F.get(F.array(F.array(F.lit("."), F.lit(None)), F.array(F.lit("."), F.lit("rs1")), F.array(F.lit(None).cast("string")), F.array(F.lit("."))), (k % 4).cast("int")).alias("aai"),
        F.when(k % 2 == 0, F.concat(F.lit("All#99:Alu#"), "p_size")).when(k % 3 == 0, "All#5").otherwise(F.lit(".")).alias("rma"), alt.alias("alt"),
    )
    length = F.coalesce(alleles.repeat_length("rma", "Alu"), F.lit(0))
    return p.select("variant_id", variants.has_ambiguous("ref", "alts").alias("ambiguous"), variants.has_missing("alts").alias("missing"), variants.is_set("aai").alias("annotated"), length.alias("alu"), alleles.kind("alt").alias("kind"))


HOMO = """with p as (select p_partkey as id, 'G' || repeat('A', 2 + cast(p_size % 3 as int)) || 'T' as ref, ['G' || repeat('A', cast(p_partkey % 6 as int)) || 'T', 'G' || repeat('A', 2 + cast(p_size % 3 as int)) || 'C', 'GCAT'] as alts from part)"""


@registered(
    "homopolymer_pairs",
    HOMO
    + f""", e as (select id, ref, unnest([ref] || alts) as alt, unnest(range(0, 4)) as i from p), t0 as (select *, {COMMON.format('ref', 'alt')} as r from e), t1 as (select *, left(ref, length(ref) - r) as x, left(alt, length(alt) - r) as y from t0),
    t2 as (select *, len(list_filter(range(1, least(length(x), length(y)) + 1), lambda j: left(x, j) = left(y, j))) as l from t1), t as (select id, i, alt, substr(x, l + 1) as x, substr(y, l + 1) as y from t2),
    h as (select *, replace(x, 'A', '') = '' and replace(y, 'A', '') = '' as h from t), f as (select a.id, a.i, bool_or(a.alt <> b.alt and a.h and b.h and abs(length(a.x) - length(b.x)) + abs(length(a.y) - length(b.y)) <= 1) as f from h a join h b on a.id = b.id and a.i <> b.i group by a.id, a.i)
    select id as variant_id, string_agg(case when f then '1' else '0' end, '' order by i) as flags from f group by id""",
)
def homopolymer_pairs(spark, d):
    n, k = (2 + F.col("p_size") % 3).cast("int"), (F.col("p_partkey") % 6).cast("int")
    a = F.lit("A")
    p = spark.read.parquet(f"{d}/part.parquet").select(
        F.col("p_partkey").alias("variant_id"), a.alias("base"), F.concat(F.lit("G"), F.repeat(a, n), F.lit("T")).alias("ref"), F.array(F.concat(F.lit("G"), F.repeat(a, k), F.lit("T")), F.concat(F.lit("G"), F.repeat(a, n), F.lit("C")), F.lit("GCAT")).alias("alts")
    )
    return variants.homopolymer_alleles(p, 1).select("variant_id", F.array_join(F.transform("flags", lambda x: x.cast("int").cast("string")), "").alias("flags"))


@registered(
    "allele_edits",
    """with c as (select p_partkey as id, p_partkey % 3 as a, p_size % 4 as b, ['T', 'C', 'T'] as alts from part)
    select id, case when a = 0 then 'T,C,T' when a = 1 then 'T,C,T,G' else 'T,C,T,*' end as added, 'T,C' as distinct_alts, '1,2' as kept,
      array_to_string(list_filter([a, b], lambda g: g <> 3), ',') as genotype, array_to_string(list_transform([a, b], lambda g: case when g = 3 then 0 else g end), ',') as to_reference, greatest(b - 1, 0) as nested, case when a = 0 then 'x,y' else 'x,y,z' end as ids from c""",
)
def allele_edits(spark, d):
    a, b = (F.col("p_partkey") % 3).cast("int"), (F.col("p_size") % 4).cast("int")
    rows = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), a.alias("a"), b.alias("b"), F.array(a, b).alias("gt"), F.array(*map(F.lit, "TCT")).alias("alts"), F.array(*map(F.lit, "xyx")).alias("ids"))
    new = F.get(F.array(*map(F.lit, "CG*")), F.col("a"))
    told, kept = variants.distinct_alts("alts")
    rows = rows.withColumns({"added": variants.with_alt("alts", new), "distinct_alts": told, "kept": kept, "ids": variants.with_value("ids", F.when(F.col("a") == 0, "y").otherwise(F.lit("z")))})
    rows = rows.withColumns({"genotype": variants.without_alleles("gt", F.col("kept")), "to_reference": variants.without_alleles("gt", F.col("kept"), True), "nested": variants.nested_ploidy("b").cast("long")})
    return joined(rows, "added", "distinct_alts", "kept", "ids", "genotype", "to_reference").select("id", "added", "distinct_alts", "kept", "genotype", "to_reference", "nested", "ids")


@registered(
    "attribute_filters",
    f"""{duck('rich')}, x as (select variant_id, sample, ploidy, app, case ploidy when 2 then [variant_id % 3, sample % 3] when 1 then [variant_id % 3] end as gt from rich)
    select variant_id, sample, ploidy > 0 and coalesce(list_bool_or(list_transform(gt, lambda g: app[g + 1] >= 0.3)), false) as one, ploidy > 0 and coalesce(list_bool_and(list_transform(gt, lambda g: app[g + 1] >= 0.3)), false) as every,
      case when ploidy = 0 then false when len(list_filter(gt, lambda g: g <> 2)) = 0 then true else list_bool_and(list_transform(list_filter(gt, lambda g: g <> 2), lambda g: app[g + 1] < 0.5)) end as open,
      variant_id % 2 = 0 as flag, case when variant_id % 2 = 0 then sample <> 3 else false end as compared, ploidy between 1 and 2 as informative from x""",
)
def attribute_filters(spark, d):
    gt = F.when(F.col("ploidy") == 2, F.array((F.col("variant_id") % 3).cast("int"), (F.col("sample") % 3).cast("int"))).when(F.col("ploidy") == 1, F.array((F.col("variant_id") % 3).cast("int"))).otherwise(F.array().cast("array<int>"))
    even = F.col("variant_id") % 2 == 0
    info = F.when(even, F.create_map(F.lit("S"), F.col("sample").cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    rows = load(spark, d, "rich").withColumns({"gt": gt, "info": info, "alts": F.array(F.lit("C"), F.lit("*")), "status": F.lit("Complete")})
    return rows.select(
        "variant_id", "sample", variants.alleles_pass("gt", "app", ">=", 0.3, False).alias("one"), variants.alleles_pass("gt", "app", ">=", 0.3, True).alias("every"), variants.alleles_pass("gt", "app", "<", 0.5, True, "alts").alias("open"), variants.has_flag("info", "S").alias("flag"),
        variants.compared(F.try_element_at("info", F.lit("S")).cast("int"), "!=", 3).alias("compared"), variants.is_informative("status", "ploidy").alias("informative"),
    )


@registered("split_texts", "with t as (select p_partkey as id, case p_partkey % 4 when 0 then 'a:b::c:' when 1 then '' when 2 then ':' else 'x' end as t from part) select id, case t when 'a:b::c:' then 'a|b||c' when ':' then '' else t end as every, case t when 'a:b::c:' then 'a|b|c' when 'x' then 'x' else '' end as some, case t when 'a:b::c:' then 'a|b::c:' when ':' then '' else t end as two from t")
def split_texts(spark, d):
    t = F.get(F.array(*map(F.lit, ("a:b::c:", "", ":", "x"))), (F.col("p_partkey") % 4).cast("int"))
    rows = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), t.alias("t"))
    text = lambda c: F.array_join(c, "|")
    return rows.select("id", text(variants.split_elements("t", ":")).alias("every"), text(variants.split_elements("t", ":", False)).alias("some"), text(variants.split_elements("t", ":", most=2)).alias("two"))


@registered("tolerant_numbers", "with x as (select distinct l_quantity / 50 as a, l_quantity / 50 * (1 + l_linenumber * 4e-6) as b from lineitem) select a, b, abs(a - b) < a * 1.1920928955078125e-05 as equal, abs(a - b) >= a * 1.1920928955078125e-05 and a < b as less, round(ln(exp(a) + exp(b)), 6) as added from x")
def tolerant_numbers(spark, d):
    a = F.col("l_quantity") / 50
    x = spark.read.parquet(f"{d}/lineitem.parquet").select(a.alias("a"), (a * (1 + F.col("l_linenumber") * 4e-6)).alias("b")).distinct()
    return x.select("a", "b", genotypes.float_equal(F.col("a"), F.col("b")).alias("equal"), genotypes.float_less(F.col("a"), F.col("b")).alias("less"), F.round(genotypes.log_add(F.col("a"), F.col("b")), 6).alias("added"))


@registered(
    "origin_filter_tool",
    f"""{SITES}, k as (select *, list_filter(range(1, len(alts) + 1), lambda i: aco[i] is null or len(list_filter(string_split(aco[i], ':'), lambda x: x not like 'ECONOMY%' and x not like 'SMALL%')) > 0) as keep from si),
    lf as (select chrom, pos, ref, alts, list_transform(keep, lambda i: alts[i]) as na, len(keep) < len(alts) as changed, keep from k where len(keep) > 0), m as (select *, case when changed then list_min(list_transform(na, lambda a: {COMMON.format('ref', 'a')})) else 0 end as t from lf)
    select chrom, pos, left(ref, length(ref) - t) as ref, array_to_string(list_transform(na, lambda a: left(a, length(a) - t)), ',') as alts, array_to_string(keep, ',') as keep from m""",
)
def origin_filter_tool(spark, d):
    tags = [r[0] for r in load(spark, d, "callset").select("callset").distinct().where("callset like 'ECONOMY%' or callset like 'SMALL%'").collect()]  # the call sets of a run
    return joined(callsets.without_origins(sites(spark, d), tags), "alts", "keep").select("chrom", "pos", "ref", "alts", "keep")


@registered(
    "exclusions",
    f"""{duck('callset')}, r as (select variant_id, chrom, pos + case when variant_id % 9 = 0 then 1 else 0 end as pos, ref, alt, {COMMON.format('ref', 'alt')} as cut from callset where ref <> alt and chrom <> 'Brand#11'),
    x as (select *, length(ref) - cut as nr, length(alt) - cut as na, substr(repeat('ACGTTGCATCAG', 8), cast(pos as int), length(ref)) <> ref as differs, pos < 5 as first from r where chrom <> 'Brand#12'),
    y as (select variant_id, array_to_string(list_filter([case when differs then 'reference' end, case when first or (not differs and pos - 2 + nr + 5 > 50) then 'end' end, case when not differs and not first and pos - 2 + nr + 5 <= 50 and greatest(nr, na) > 4 then 'length' end], lambda z: z is not null), ',') as reasons
      from (select variant_id, pos, nr, na, first, differs or pos + length(ref) - 1 > 50 as differs from x) w) select * from y union all select variant_id, 'decoy' from r where chrom = 'Brand#12' union all select variant_id, 'contig' from callset where ref <> alt and chrom = 'Brand#11'""",
)
def exclusions(spark, d):
    return joined(excluded(spark, d), "reasons").select("variant_id", "reasons")


def excluded(spark, d):
    c = load(spark, d, "callset").where("ref <> alt").withColumn("pos", (F.col("pos") + F.when((F.col("variant_id") % 9 == 0) & (F.col("chrom") != "Brand#11"), 1).otherwise(0)).cast("int"))
    genome = c.select(F.col("chrom").alias("id")).distinct().where("id <> 'Brand#11'").select("id", F.lit(REPEAT[:50]).alias("seq"), (F.col("id") == "Brand#12").alias("is_decoy"))
    return genotype.exclusions(c.select("variant_id", "chrom", "pos", "ref", "alt"), genome, 5, 4)


def _exclusion_sql() -> str:
    from .registry import SQL

    head, body = SQL["exclusions"].split("select * from y union all", 1)
    return f"{head}, ex as (select * from y union all{body}) select reason, count(*) as n from (select unnest(string_split(reasons, ',')) as reason from ex where reasons <> '' union all select 'total' from ex) q group by reason"


@registered("exclusion_counts", _exclusion_sql())
def exclusion_counts(spark, d):
    return genotype.exclusion_counts(excluded(spark, d))


@registered("genome_reference", f"{duck('callset')}, r as (select variant_id, chrom, pos, case when variant_id % 3 = 0 then 'N' when variant_id % 5 = 0 then 'TTT' else ref end as ref from callset), s as (select variant_id, chrom, pos, case when ref = 'N' then substr(repeat('ACGTTGCATCAG', 8), pos, 1) else ref end as ref from r) select * from s where substr(repeat('ACGTTGCATCAG', 8), pos, length(ref)) = ref")
def genome_reference(spark, d):
    c = load(spark, d, "callset")
    rows = c.select("variant_id", "chrom", "pos", F.when(F.col("variant_id") % 3 == 0, "N").when(F.col("variant_id") % 5 == 0, "TTT").otherwise(F.col("ref")).alias("ref"))
    return vcf.with_genome_reference(rows, c.select(F.col("chrom").alias("id")).distinct().withColumn("seq", F.lit(REPEAT)))


@registered(
    "annotate_tool",
    """with q as (select p_partkey as id, p_brand as chrom, p_size as pos, p_partkey % 4 as kind from part), a as (select distinct chrom, pos from q where kind < 2)
    select q.id as variant_id, case when kind = 3 then 'own' else '' end || case when a.pos is not null and kind = 3 then ',' else '' end || case when a.pos is not null then 's-' || q.chrom || '-' || q.pos else '' end as ids,
      case when a.pos is not null and kind = 2 then 'old:s-' || q.chrom || '-' || q.pos when a.pos is not null then 's-' || q.chrom || '-' || q.pos when kind = 2 then 'old' else '.' end || ',.' as aai from q left join a using (chrom, pos)""",
)
def annotate_tool(spark, d):
    k = F.col("p_partkey") % 4
    p = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("variant_id"), F.col("p_brand").alias("chrom"), F.col("p_size").alias("pos"), k.alias("kind"))
    calls = p.select("variant_id", "chrom", "pos", F.when(F.col("kind") == 3, F.array(F.lit("own"))).alias("ids"), F.lit("A").alias("ref"), F.array(F.lit("C"), F.lit("*")).alias("alts"), F.array(F.when(F.col("kind") == 2, "old"), F.lit(".")).alias("aai"))
    known = p.where("kind < 2").select(F.concat_ws("-", F.lit("s"), "chrom", "pos").alias("annotation_id"), "chrom", "pos", F.lit("A").alias("ref"), F.lit("C").alias("alt")).distinct()
    return joined(callsets.annotated(calls, known), "ids", "aai").select("variant_id", "ids", "aai")


#: id: alt, info and what it is spelled as after a base `b` with a segment `s` behind it (ref, alts, how far pos moves).
SYMBOLS = [
    ("<DEL>", "", ("b||s", "b", 0)), ("<DEL:ME>", "", ("b||s", "b", 0)), ("<DUP:TANDEM>", "", ("b||s", "b||s||s", 0)), ("<INV>", "", ("s", "reverse(translate(s, 'ACGT', 'TGCA'))", 1)), ("<CN0>", "", ("b||s", "b", 0)), ("<CN1>", "", None), ("<CN3>", "", ("b||s", "b||s||s||s", 0)),
    ("<CNV>", "GSCNDIST=2,9,0,1", ("b||s", "b||','||b||s||s||s", 0)), ("<INS>", "SVINSSEQ=GGG", ("b", "b||'GGG'", 0)), ("<INS>", "SEQ=TT;SVINSSEQ=GGG", ("b", "b||'TT'", 0)), ("<INS>", "LEFT_SVINSSEQ=A;RIGHT_SVINSSEQ=C", ("b", "b||'ANNNNNNNNNNC'", 0)), ("<HERV>", "", ("b", "b||'CCCCA'", 0)),
    ("<INS:ME:ALU>", "MEINFO=AluY,2,4,+", ("b", "b||'GTA'", 0)), ("<INS:ME:ALU>", "MEINFO=AluY,1,3,-", ("b", "b||'CCT'", 0)), ("<INS:ME:L1>", "MEINFO=L1,1,3,-", None), ("<TRA>", "", None), ("<DEL>", "IMPRECISE", None), ("T]7:1]", "", None), ("GA", "", ("b", "'GA'", 0)), ("<UNKNOWN>", "", None),
]


def _convert_sql() -> str:
    cases = lambda i: " ".join(f"when {n} then {x[2][i]}" for n, x in enumerate(SYMBOLS) if x[2])
    lost = ", ".join(str(n) for n, x in enumerate(SYMBOLS) if not x[2])
    return f"""with p as (select p_partkey as id, cast(1 + p_partkey % 40 as int) as pos, cast(1 + p_size % 9 as int) as n, p_partkey % {len(SYMBOLS)} as kind from part), q as (select *, substr(repeat('ACGTTGCATCAG', 8), pos, 1) as b, substr(repeat('ACGTTGCATCAG', 8), pos + 1, n) as s from p)
    select id, pos + case kind {cases(2)} end as pos, case kind {cases(0)} end as ref, case kind {cases(1)} end as alts from q where kind not in ({lost})"""


@registered("convert_alleles", _convert_sql())
def convert_alleles(spark, d):
    k = (F.col("p_partkey") % len(SYMBOLS)).cast("int")
    info = F.get(F.array(*(F.lit(x[1]) for x in SYMBOLS)), k)
    pos = (1 + F.col("p_partkey") % 40).cast("int")
    rows = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_partkey").cast("string").alias("chrom"), pos.alias("pos"), F.lit("N").alias("ref"), F.array(F.get(F.array(*(F.lit(x[0]) for x in SYMBOLS)), k)).alias("alts"), F.str_to_map(F.concat_ws(";", F.nullif(info, F.lit("")), F.concat(F.lit("END="), pos + 1 + (F.col("p_size") % 9))), F.lit(";"), F.lit("=")).alias("info"))
    genome = rows.select(F.col("chrom").alias("id"), F.lit(REPEAT).alias("seq"))
    named = spark.createDataFrame([("<HERV>", "CCCCA")], "id string, seq string")
    elements = spark.createDataFrame([("ALU", "GGTAAGG")], "id string, seq string")
    return joined(callsets.convert_alleles(rows, genome, named, elements, partial=True), "alts").select("id", "pos", "ref", "alts")


@registered(
    "sequence_to_symbol",
    f"""with p as (select p_partkey as id, cast(2 + p_partkey % 40 as int) as pos, cast(3 + p_size % 9 as int) as n, p_partkey % 7 as kind from part), g as (select *, substr(repeat('ACGTTGCATCAG', 8), pos, n) as r, substr(repeat('ACGTTGCATCAG', 8), pos, 1) as b from p),
    c as (select *, reverse(translate(r, 'ACGT', 'TGCA')) as rc, reverse(translate(substr(r, 2), 'ACGT', 'TGCA')) as rc2 from g),
    v as (select id, pos, n, kind, b, case kind when 0 then r when 2 then r when 3 then r when 4 then r when 5 then 'A' else b end as ref, case kind when 0 then b when 1 then r when 2 then rc when 3 then b || rc2 when 4 then b || 'T' || substr(r, 2) when 5 then 'C' else b || 'GGGGG' end as alt from c),
    w as (select *, {COMMON.format('ref', 'alt')} as cut from v), x as (select *, left(ref, length(ref) - cut) as tr, left(alt, length(alt) - cut) as ta from w),
    y as (select *, length(tr) as lr, length(ta) as la, left(tr, 1) = left(ta, 1) as anchored from x),
    z as (select *, case when lr > 1 and la = 1 and anchored and lr - 1 >= 3 then 'DEL' when lr = 1 and la > 1 and anchored and la - 1 >= 3 then 'DUP' when lr = la and lr > 1 and anchored and lr - 1 >= 3 and substr(tr, 2) = reverse(translate(substr(ta, 2), 'ACGT', 'TGCA')) then 'INV'
      when lr = la and lr > 1 and not anchored and lr >= 3 and tr = reverse(translate(ta, 'ACGT', 'TGCA')) then 'INV' end as svtype from y)
    select cast(id as varchar) as chrom, case when svtype = 'INV' and not anchored then pos - 1 else pos end as pos, case when svtype = 'INV' and not anchored then substr(repeat('ACGTTGCATCAG', 8), pos - 1, 1) else left(tr, 1) end as ref, '<' || svtype || '>' as alt,
      cast(pos + case when svtype = 'DUP' then la else lr end - 1 as int) as "end", svtype, '0,0' as cipos, '0,0' as ciend from z where svtype is not null and (svtype <> 'DUP' or substr(repeat('ACGTTGCATCAG', 8), pos, la) = ta)""",
)
def sequence_to_symbol(spark, d):
    return callsets.to_symbolic(structural(spark, d), structural_genome(spark, d), 3)


def structural_genome(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").cast("string").alias("id"), F.lit(REPEAT).alias("seq"))


def structural(spark, d):
    from strandline.functions.sequence import reverse_complement

    k, pos, n = F.col("p_partkey") % 7, (2 + F.col("p_partkey") % 40).cast("int"), (3 + F.col("p_size") % 9).cast("int")
    g = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").cast("string").alias("chrom"), pos.alias("pos"), k.alias("kind"), F.substr(F.lit(REPEAT), pos, n).alias("r"), F.substr(F.lit(REPEAT), pos, F.lit(1)).alias("b"))
    rest = F.expr("substring(r, 2)")
    ref = F.when(F.col("kind").isin(0, 2, 3, 4), F.col("r")).when(F.col("kind") == 5, "A").otherwise(F.col("b"))
    alt = F.when(F.col("kind") == 0, F.col("b")).when(F.col("kind") == 1, F.col("r")).when(F.col("kind") == 2, reverse_complement("r")).when(F.col("kind") == 3, F.concat("b", reverse_complement(rest))).when(F.col("kind") == 4, F.concat("b", F.lit("T"), rest)).when(F.col("kind") == 5, "C").otherwise(F.concat("b", F.lit("GGGGG")))
    return g.select("chrom", "pos", ref.alias("ref"), alt.alias("alt"))


CONC = f"""{duck('call')}, v as (select variant_id, sample, 'A' || case when variant_id % 2 = 0 then 'CC' else '' end as ref, a, b, missing from call),
tt as (select variant_id, sample, missing, ['A', 'G', 'T'][a + 1] as x, ['A', 'G', 'T'][b + 1] as y, a, b from call where sample < 7), cc as (select variant_id, sample, nak > 3 as hap, ['A', 'T', 'G'][a + 1] as x, ['A', 'T', 'G'][b + 1] as y, a, b from call where sample > 3),
j as (select coalesce(tt.variant_id, cc.variant_id) as variant_id, coalesce(tt.sample, cc.sample) as sample, tt.variant_id is not null as ht, cc.variant_id is not null as hc,
  case when tt.variant_id is not null and cc.variant_id is not null then case when (case when missing = 1 then 0 else 2 end) <> (case when hap then 1 else 2 end) then 'F' when (tt.x = cc.x and tt.y = cc.y) or (tt.x = cc.y and tt.y = cc.x) then 'T' when tt.x = cc.x or tt.y = cc.y or tt.x = cc.y or tt.y = cc.x then 'P' else 'F' end
    when tt.variant_id is not null then case when missing = 1 then 'I' when greatest(tt.a, tt.b) = 0 then 'T' when least(tt.a, tt.b) = 0 then 'P' else 'F' end
    else case when hap then case when cc.a = 0 then 'T' else 'F' end when greatest(cc.a, cc.b) = 0 then 'T' when least(cc.a, cc.b) = 0 then 'P' else 'F' end end as gtco from tt full join cc on tt.variant_id = cc.variant_id and tt.sample = cc.sample)"""


@registered("concordance", f"{CONC} select 'truth' as side, variant_id as id, sample, gtco from j where ht union all select 'call', variant_id, sample, gtco from j where hc")
def concordance(spark, d):
    """Two call sets with different alts, one with a longer REF, missing and single-copy calls."""
    c = load(spark, d, "call").select(F.col("variant_id").alias("id"), F.lit("c").alias("chrom"), F.col("variant_id").alias("pos"), "sample", "a", "b", "missing", "nak")
    truth = c.where("sample < 7").select("id", "chrom", "pos", "sample", F.lit("ACC").alias("ref"), F.array(F.lit("GCC"), F.lit("TCC")).alias("alts"), F.when(F.col("missing") == 1, F.array(F.lit(None).cast("int"), F.lit(None).cast("int"))).otherwise(F.array("a", "b")).alias("genotype"))
    calls = c.where("sample > 3").select("id", "chrom", "pos", "sample", F.lit("A").alias("ref"), F.array(F.lit("T"), F.lit("G")).alias("alts"), F.when(F.col("nak") > 3, F.array("a")).otherwise(F.array("a", "b")).alias("genotype"))
    return genotyping.concordance(truth, calls)


@registered(
    "concordance_windows",
    f"""{duck('ivl')}, u as (select 'truth' as side, contig, pos, end_pos + 10 as e from ivl where len % 2 = 0 union all select 'call', contig, pos, end_pos + 10 from ivl where len % 3 = 0), pl as (select contig, pos, max(e) as e from u group by contig, pos),
    w as (select *, max(e) over (partition by contig order by pos rows between unbounded preceding and 1 preceding) as b from pl), n as (select *, sum(case when b is null or pos > b then 1 else 0 end) over (partition by contig order by pos rows unbounded preceding) - 1 as g from w)
    select contig, cast(g as int) as group_no, min(pos) as start, max(u.e) as "end", count(*) filter (where side = 'truth') as n_truth, count(*) filter (where side = 'call') as n_call from n join u using (contig, pos) group by contig, g""",
)
def concordance_windows(spark, d):
    """Windows of two call sets whose variants lie within a read's length of one another."""
    ivl = load(spark, d, "ivl").withColumn("end_pos", F.col("end_pos") + 10)
    both = ivl.where("len % 2 = 0").withColumn("side", F.lit("truth")).union(ivl.where("len % 3 = 0").withColumn("side", F.lit("call")))
    told = intervals.groups(both, 1).groupBy("contig", "group_no")
    return told.agg(F.min("pos").alias("start"), F.max("end_pos").alias("end"), F.sum((F.col("side") == "truth").cast("long")).alias("n_truth"), F.sum((F.col("side") == "call").cast("long")).alias("n_call"))


LETTERS = [(0, "A", "B"), (1, "C", "D"), (2, "A", "C"), (3, "B", "D"), (4, "A", None)]


@registered(
    "haplotype_transmission",
    f"""{duck('call')}, l as (select * from (values {', '.join(f"({s}, '{a}', {'null' if b is None else repr(b)})" for s, a, b in LETTERS)}) v(sample, f, s)), w as (select a.i as "A", b.i as "B", c.i as "C", d.i as "D" from range(3) a(i), range(3) b(i), range(3) c(i), range(3) d(i)),
    vs as (select distinct variant_id, (variant_id % 100) < 80 as inside from call), o as (select variant_id, f, s, case when sample = 4 and nak > 2 then [a] else list_sort([a, b]) end as g from call join l using (sample) where missing = 0),
    p as (select variant_id, w.*, case f when 'A' then "A" when 'B' then "B" when 'C' then "C" else "D" end as x, case s when 'A' then "A" when 'B' then "B" when 'C' then "C" when 'D' then "D" end as y, g from o, w),
    x as (select variant_id, "A", "B", "C", "D", bool_and(g = case when y is null then [x] else [least(x, y), greatest(x, y)] end) as fits from p group by variant_id, "A", "B", "C", "D"),
    n as (select variant_id, sum(cast(fits as int))::bigint as n from x group by variant_id), r as (select variant_id, case when inside then coalesce(n, 81) end as n_ways from vs left join n using (variant_id))
    select variant_id, n_ways, case when n_ways is null then 'NA' when n_ways = 0 then 'FALSE' when n_ways = 1 then 'TRUE' else 'MULTI-TRUE' end as htv from r""",
)
def haplotype_transmission(spark, d):
    c = load(spark, d, "call")
    told = c.select("variant_id").distinct().select("variant_id", F.lit("c").alias("chrom"), F.col("variant_id").alias("pos"), F.col("variant_id").alias("end_pos"), F.lit(3).alias("n_alleles"))
    blocks = told.select((F.floor(F.col("pos") / 100) * 100).alias("start")).distinct()
    told_of = F.explode(F.array(*(F.struct(F.lit(s).alias("sample"), F.lit(a).alias("first"), F.lit(b).cast("string").alias("second")) for s, a, b in LETTERS)))
    letters = blocks.select(F.lit("c").alias("chrom"), "start", (F.col("start") + 79).alias("end"), told_of.alias("x")).select("chrom", "start", "end", "x.*")
    genotype_ = F.when((F.col("sample") == 4) & (F.col("nak") > 2), F.array("a")).otherwise(F.array("a", "b"))
    return genotyping.transmission(told, c.where("missing = 0 and sample < 5").select("variant_id", "sample", genotype_.alias("genotype")), letters)


@registered("pedigree_names", "select 'F' || n_regionkey as family, 'F' || n_regionkey || '-01' as father, 'F' || n_regionkey || '-02' as mother, 'F' || n_regionkey || '-03' as child from (select distinct n_regionkey from nation) r")
def pedigree_names(spark, d):
    names = [f"F{r[0]}-0{n}" for r in spark.read.parquet(f"{d}/nation.parquet").select("n_regionkey").distinct().collect() for n in (1, 2, 3)]  # the samples of a run
    return spark.createDataFrame(tables.pedigree_of_names(names), "family string, father string, mother string, child string")


TRIOS = f"""{duck('rich')}, gc as (select variant_id, sample, ploidy, case when ploidy = 0 then [] when missing = 1 then case ploidy when 2 then [null, null] else [null] end when ploidy = 2 then [a, b] else [a] end as g, variant_id % 2 = 0 as open from (select r.variant_id, r.sample, r.ploidy, c.a, c.b, c.missing from rich r join call c using (variant_id, sample)) z),
t as (select f.variant_id, cast(f.sample / 3 as int) as family, f.g as f, m.g as m, c.g as c, f.ploidy as fp, m.ploidy as mp, c.ploidy as cp, c.open as open, len(list_filter(f.g || m.g || c.g, lambda x: x is null)) > 0 as filtered
  from gc f join gc m on f.variant_id = m.variant_id and m.sample = f.sample + 1 join gc c on f.variant_id = c.variant_id and c.sample = f.sample + 2 where f.sample in (1, 4, 7)),
u as (select *, fp = 2 and mp = 2 and cp = 2 as diploid, c[1] as x, c[-1] as y, coalesce(list_contains(f, c[1]), false) as xf, coalesce(list_contains(m, c[1]), false) as xm, coalesce(list_contains(f, c[-1]), false) as yf, coalesce(list_contains(m, c[-1]), false) as ym from t),
v as (select *, not filtered and cp > 0 and ((xf and ym) or (yf and xm)) as concordant, case when not xf and not xm and (yf or ym) then x when not yf and not ym and (xf or xm) then y else 0 end as nw,
  cp = 2 and x <> y and fp > 0 and mp > 0 and f[1] = f[-1] and m[1] = m[-1] as alone from u),
w as (select *, coalesce(not filtered and diploid and alone and not concordant and not (open and list_contains(f || m || c, 2)) and nw > 0, false) as de_novo from v)"""


@registered(
    "trio_concordance",
    f"""{TRIOS} select variant_id, family, filtered, diploid, filtered or cp > 0 as informative, concordant, false as simple_heterozygote, not filtered and len(list_filter(f || m || c, lambda x: x > 0)) = 0 as reference_call, de_novo,
    case when de_novo then case when nw = f[1] then m[1] else f[1] end end as ancestral, case when de_novo then nw end as new from w""",
)
def trio_concordance(spark, d):
    return genotyping.trios(trio_calls(spark, d), spark.createDataFrame([(round(f / 3), f, f + 1, f + 2) for f in (1, 4, 7)], "family int, father int, mother int, child int"))


def trio_calls(spark, d):
    """Calls with missing ones, one copy in sample 9 and none in some of sample 8."""
    none = F.lit(None).cast("int")
    whole = load(spark, d, "rich").select("variant_id", "sample", "ploidy").join(load(spark, d, "call").select("variant_id", "sample", "a", "b", "missing"), ["variant_id", "sample"])
    genotype_ = F.when(F.col("ploidy") == 0, F.array().cast("array<int>")).when(F.col("missing") == 1, F.when(F.col("ploidy") == 2, F.array(none, none)).otherwise(F.array(none))).when(F.col("ploidy") == 2, F.array("a", "b")).otherwise(F.array("a"))
    return whole.select("variant_id", "sample", "ploidy", genotype_.alias("genotype"), F.lit(3).alias("n_alleles"), (F.col("variant_id") % 2 == 0).alias("open"))


@registered("concordance_attribute", f"{TRIOS} select variant_id, sum(concordant::int)::varchar || '/' || count(*) as conc from w where not filtered and cp > 0 group by variant_id")
def concordance_attribute(spark, d):
    from strandline.operators import tools

    return tools.concordance_attribute(trio_calls(spark, d), spark.createDataFrame([(f, f, f + 1, f + 2) for f in (1, 4, 7)], "family int, father int, mother int, child int"))


@registered("uncovered_alleles", f"{duck('call')}, v as (select distinct variant_id from call), e as (select variant_id as cluster, cast(p as int) as variant, cast(i as int) as allele from v, range(2) p(p), range(3) i(i)), t as (select variant_id as cluster, 0 as variant, a as allele from call union select variant_id, 1, b from call) select * from e anti join t using (cluster, variant, allele)")
def uncovered_alleles(spark, d):
    from strandline.operators import graph

    haps = load(spark, d, "call").select(F.col("variant_id").alias("cluster"), F.array("a", "b").alias("alleles"))
    told = haps.select("cluster").distinct().select("cluster", F.explode(F.array(F.lit(0), F.lit(1))).alias("variant"), F.lit(3).alias("n_alleles"))
    return graph.uncovered_alleles(told, haps)


@registered("kmer_excluded", f"{duck('occ')}, p as (select kmer, source, count(*) as n from occ group by kmer, source) select kmer, max(cast(source = 'src0' as int)) = 1 or max(n) > 2 or count(*) > 1 as excluded from p group by kmer")
def kmer_excluded(spark, d):
    from strandline.operators import kmers

    p = load(spark, d, "occ").groupBy("kmer", "source").agg(F.count("*").alias("n"))
    told = p.groupBy("kmer").agg((F.max((F.col("source") == "src0").cast("int")) == 1).alias("decoy"), (F.max("n") > 2).alias("over"), (F.count("*") > 1).alias("multigroup"))
    return told.select("kmer", kmers.excluded("decoy", "over", "multigroup").alias("excluded"))


@registered("contig_order", "select cast(row_number() over (order by n_nationkey) - 1 as int) as place, n_name as contig from nation")
def contig_order(spark, d):
    names = [(r[0], r[1]) for r in spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()]  # the contigs of a genome
    merged = tables.contig_order([[n for k, n in names if k % 3 != 1], [n for k, n in names if k % 3 != 2], [n for k, n in names if k % 2 == 0 or k % 3 == 0]] + [[n for _, n in names[i : i + 2]] for i in range(len(names) - 1)])
    return spark.createDataFrame(list(enumerate(merged)), "place int, contig string")


SUMMARY = f"""{duck('rich')}, g as (select *, case when ploidy = 0 then [] when ploidy = 1 then [variant_id % 3] when sample % 4 = 3 then [null, null] else [variant_id % 2, sample % 3] end as gt, case when ploidy > 0 then [0, sample % 2, 0] else [] end as saf from rich),
al as (select variant_id, sample, i, gt, saf, app, nak, fak from g, range(3) i(i)), ct as (select variant_id, i, sum(len(list_filter(gt, lambda x: x = i and saf[x + 1] = 0)))::int as n, max(case when len(app) > 0 and saf[i + 1] = 0 then app[i + 1] else 0 end) as p, min(case when nak[i + 1] <> -1 then nak[i + 1] end) as nak, min(case when fak[i + 1] <> -1 then fak[i + 1] end) as fak from al group by variant_id, i),
sm as (select variant_id, sum(len(list_filter(gt, lambda x: x is null)) = 0)::int as complete, sum((sample % 3 = 0)::int)::int as yes, sum((sample % 3 = 1)::int)::int as no from g group by variant_id),
vt as (select variant_id, list(n order by i) as acs, list(p order by i) as acp, list(nak order by i) as nak, list(fak order by i) as fak, sum(n)::int as an from ct group by variant_id),
sv as (select *, variant_id % 2 = 0 as two, case when variant_id % 2 = 0 then ['A', 'C', 'AT'] else ['A', 'G', '*'] end as als from vt join sm using (variant_id)),
cm as (select *, case variant_id % 3 when 0 then 'x' when 1 then 'autosomal' else 'unknown' end as ct, case when variant_id % 5 = 0 then 'NA' else 'PASS' end as fl, len(list_filter(acs, lambda n: n > 0)) as eff, case when variant_id % 2 = 0 then '3' else 'NA' end as hpl, case when variant_id % 7 = 0 then '1' else 'NA' end as htv from sv)"""


@registered(
    "summary_variants",
    SUMMARY
    + """, r as (select ct as "ChromType", fl as "Filter", case when two then 'Multi' else 'SNP' end as "VariantType", case when two then '0' else '1' end as "HasMissing", '0' as "HasRedundant", '3' as "NumAlleles", cast(eff as varchar) as "EffectiveNumAlleles", printf('%.2f', greatest(acp[2], acp[3])) as "MaxAltACP",
    cast(greatest(acs[2], acs[3]) as varchar) as "MaxAltAC", cast(an as varchar) as "AN", 'x:y' as "ACO", hpl as "HPL", case when two then '1' else 'NA' end as "HasHomopolymer", htv as "HTV", cast(complete as varchar) as "NumCompleteSamples", cast(yes as varchar) as "NumCONCTrue", cast(no as varchar) as "NumCONCFalse", 'b' as "BASE", 'NA' as "CALL", 'NA' as "GTCO", 'NA' as "MED" from cm)
    select *, count(*) as n_rows from r group by all""",
)
def summary_variants(spark, d):
    rows, _ = genotyping.summary_attributes(*summary_inputs(spark, d))
    return genotyping.summary(rows, *rows.columns)


@registered(
    "summary_alleles",
    SUMMARY
    + """, e as (select *, unnest(range(0, 3)) as i from cm), r as (select ct as "ChromType", fl as "Filter", case when i = 0 then 'Reference' when i = 1 then 'SNP' when two then 'Insertion' else 'Missing' end as "AlleleType", case when i = 2 and not two then '0' else '1' end as "AlleleLength", case when i = 2 and two then '1' else '0' end as "AlleleSVLength", '0' as "IsRedundant", '3' as "NumAlleles",
    cast(eff as varchar) as "EffectiveNumAlleles", printf('%.2f', acp[i + 1]) as "ACP", cast(acs[i + 1] as varchar) as "AC", cast(an as varchar) as "AN", case i when 0 then 'NA' when 1 then 'y:x' else 'NA' end as "ACO", hpl as "HPL", case when two then case when i = 1 then '0' else '1' end else 'NA' end as "IsHomopolymer", htv as "HTV",
    cast(complete as varchar) as "NumCompleteSamples", cast(yes as varchar) as "NumCONCTrue", cast(no as varchar) as "NumCONCFalse", 'b' as "BASE", 'NA' as "CALL", 'NA' as "GTCO", 'NA' as "MED", case when nak[i + 1] is null then 'NA' else printf('%.1f', nak[i + 1]) end as "MinNAK", case when fak[i + 1] is null then 'NA' else printf('%.2f', fak[i + 1]) end as "MinFAK" from e)
    select *, count(*) as n_rows from r group by all""",
)
def summary_alleles(spark, d):
    _, rows = genotyping.summary_attributes(*summary_inputs(spark, d))
    return genotyping.summary(rows, *rows.columns)


def summary_inputs(spark, d):
    """(variants, calls) with every attribute that a summary tells."""
    rich, v, s = load(spark, d, "rich"), F.col("variant_id"), F.col("sample")
    none, ints = F.lit(None).cast("int"), F.array().cast("array<int>")
    genotype_ = F.when(F.col("ploidy") == 0, ints).when(F.col("ploidy") == 1, F.array((v % 3).cast("int"))).when(s % 4 == 3, F.array(none, none)).otherwise(F.array((v % 2).cast("int"), (s % 3).cast("int")))
    conc = F.create_map(F.lit("CONC"), F.when(s % 3 == 0, "TRUE").when(s % 3 == 1, "FALSE").otherwise(F.lit("NA")), F.lit("GTCO"), F.lit("T"))
    calls = rich.select("variant_id", "sample", "ploidy", genotype_.alias("genotype"), F.when(F.col("ploidy") > 0, F.array(F.lit(0), (s % 2).cast("int"), F.lit(0))).otherwise(ints).alias("saf"), "app", "nak", "fak", conc.alias("info"))
    two = v % 2 == 0
    info = F.map_filter(F.create_map(F.lit("HTV"), F.when(v % 7 == 0, "TRUE"), F.lit("BASE"), F.lit("b"), F.lit("CALL"), F.lit(".")), lambda _, x: x.isNotNull())
    told = rich.select("variant_id").distinct().select(
        "variant_id", F.when(v % 3 == 0, "chrX").when(v % 3 == 1, "7").otherwise(F.lit("GL1")).alias("chrom"), F.when(v % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("PASS"))).alias("filters"), F.lit("A").alias("ref"),
        F.when(two, F.array(F.lit("C"), F.lit("AT"))).otherwise(F.array(F.lit("G"), F.lit("*"))).alias("alts"), F.array(F.lit("y:x"), F.lit(".")).alias("aco"), F.when(two, "3:T").otherwise(F.lit(".")).alias("hpl"), info.alias("info"),
    )
    return told, calls
