"""Genotype tables: (variant_id, sample, a, b, …) a row for each call; statistics, filters, trios, concordance, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.alleles import _prefix
from strandline.functions.genotypes import genotype_index

from .intervals import clear_of_earlier, contained_in


def allele_stats(calls: DataFrame, filtered: Column | None = None) -> DataFrame:
    """variant_id, allele, ac, an, af over called, unfiltered alleles."""
    own = calls.where(~filtered) if filtered is not None else calls
    per = own.select("variant_id", F.explode(F.array("a", "b")).alias("allele")).where("allele is not null").groupBy("variant_id", "allele").agg(F.count("*").alias("ac"))
    totals = per.groupBy("variant_id").agg(F.sum("ac").alias("an"))
    return per.join(totals, "variant_id").withColumn("af", F.col("ac") / F.col("an"))


def inbreeding(calls: DataFrame, eligible: Column | None = None) -> DataFrame:
    """variant_id, n_samples, ibc (1 - observed / expected heterozygotes; null where none was observed) over complete diploid
    calls of which neither allele is filtered; eligible: which rows these are (those without `missing` by default)."""
    own = calls.where(F.col("missing") == 0 if eligible is None else eligible)
    per = own.groupBy("variant_id").agg(F.count("*").alias("n_samples"), F.sum(F.when(F.col("a") != F.col("b"), 1).otherwise(0)).alias("observed"))
    counts = own.select("variant_id", F.explode(F.array("a", "b")).alias("allele")).groupBy("variant_id", "allele").agg(F.count("*").alias("n"))
    squares = counts.groupBy("variant_id").agg(F.sum(F.col("n") * F.col("n")).alias("squares"))
    expected = F.col("n_samples") * (1 - F.col("squares") / (4 * F.col("n_samples") * F.col("n_samples")))
    return per.join(squares, "variant_id").select("variant_id", "n_samples", F.when(F.col("observed") > 0, 1 - F.col("observed") / expected).alias("ibc"))


def trios(calls: DataFrame, pedigree: DataFrame) -> DataFrame:
    """Per (variant_id, family) of calls (variant_id, sample, ploidy, genotype: allele indices with nulls for none, n_alleles,
    open: whether the last allele is `*`) and pedigree (family, father, mother, child): filtered, diploid, informative,
    concordant, simple_heterozygote, reference_call, de_novo, ancestral and new (alleles of a new mutation).

    filtered: not all three are whole; informative: the child has a copy; concordant: its alleles come from either parent;
    simple_heterozygote: both parents are, of two alleles; de_novo: the child alone is heterozygous, all have two copies, and
    one of its alleles is neither parent's. A call set's calls meet the small pedigree by sample; no self-join."""
    roles = pedigree.select("family", F.explode(F.map_from_arrays(F.array(F.lit("father"), F.lit("mother"), F.lit("child")), F.array("father", "mother", "child"))).alias("role", "sample"))
    own = F.struct("ploidy", "genotype", "n_alleles", "open")
    per = calls.join(roles, "sample").groupBy("variant_id", "family").agg(*(F.max(F.when(F.col("role") == r, own)).alias(r[0]) for r in ("father", "mother", "child")))
    whole = per.where("f is not null and m is not null and c is not null")
    out = whole.withColumns({
        "filtered": F.expr("exists(array(f, m, c), x -> exists(x.genotype, g -> g is null))"), "diploid": F.expr("f.ploidy = 2 and m.ploidy = 2 and c.ploidy = 2"),
        "_x": F.expr("get(c.genotype, 0)"), "_y": F.expr("get(c.genotype, size(c.genotype) - 1)"), "_f": F.expr("get(f.genotype, 0)"), "_m": F.expr("get(m.genotype, 0)"), "_all": F.expr("flatten(array(f.genotype, m.genotype, c.genotype))"),
    })
    told = lambda x: F.coalesce(F.expr(x), F.lit(False)) & ~F.col("filtered")
    out = out.withColumns({f"_{c}{p}": F.expr(f"coalesce(array_contains({p}.genotype, _{c}), false)") for c in "xy" for p in "fm"})
    out = out.withColumns({
        "informative": F.col("filtered") | (F.col("c.ploidy") > 0), "concordant": told("c.ploidy > 0 and ((_xf and _ym) or (_yf and _xm))"), "reference_call": told("forall(_all, g -> g = 0)"),
        "simple_heterozygote": told("c.ploidy > 0 and c.n_alleles = 2 and size(f.genotype) = 2 and size(m.genotype) = 2 and f.genotype[0] <> f.genotype[1] and m.genotype[0] <> m.genotype[1]"),
        "_alone": told("c.ploidy = 2 and _x <> _y and f.ploidy > 0 and m.ploidy > 0 and _f = get(f.genotype, size(f.genotype) - 1) and _m = get(m.genotype, size(m.genotype) - 1)"),
        "new": F.expr("case when not _xf and not _xm and (_yf or _ym) then _x when not _yf and not _ym and (_xf or _xm) then _y else 0 end"),
    })
    de_novo = told("diploid and _alone and not concordant and not (c.open and array_contains(_all, c.n_alleles - 1)) and new > 0")
    out = out.withColumn("de_novo", de_novo)
    return out.select(
        "variant_id", "family", "filtered", "diploid", "informative", "concordant", "simple_heterozygote", "reference_call", "de_novo",
        F.when(F.col("de_novo"), F.when(F.col("new") == F.col("_f"), F.col("_m")).otherwise(F.col("_f"))).alias("ancestral"), F.when(F.col("de_novo"), F.col("new")).alias("new"),
    )


def allele_pairs(genotype: str, ref: str, alts: str) -> Column:
    """Of each called allele REF and allele without the suffix that they share; nulls (not called) go."""
    own = f"if(g = 0, {ref}, {alts}[g - 1])"
    cut = _prefix("reverse(p.r)", "reverse(p.a)", "least(length(p.r), length(p.a)) - 1")
    spelled = f"transform(filter({genotype}, g -> g is not null), g -> named_struct('g', g, 'r', {ref}, 'a', {own}))"
    return F.expr(f"transform({spelled}, p -> named_struct('g', p.g, 'r', left(p.r, length(p.r) - {cut}), 'a', left(p.a, length(p.a) - {cut})))")


def concordance(truth: DataFrame, calls: DataFrame) -> DataFrame:
    """side (truth or call), id, sample, gtco of two call sets (id, chrom, pos, sample, ref, alts, genotype: allele indices).

    Where both have the place: F for unequal numbers of called alleles, I for none, else T, P or F as all, some or none of the
    trimmed alleles agree in any order; of several rows at the place a truth row takes the best. Where one has it: I without
    a called allele, T for the reference alone, P with it, else F."""
    pairs = lambda df: df.select("id", "chrom", "pos", "sample", allele_pairs("genotype", "ref", "alts").alias("x"))
    t, c = pairs(truth).toDF("t_id", "chrom", "pos", "sample", "tx"), pairs(calls).toDF("c_id", "chrom", "pos", "sample", "cx")
    both = t.join(c, ["chrom", "pos", "sample"], "full_outer")
    spelled = lambda x, i: f"concat_ws('>', {x}[{i}].r, {x}[{i}].a)"
    eq = lambda i, j: f"{spelled('tx', i)} = {spelled('cx', j)}"
    two = f"case when ({eq(0, 0)} and {eq(1, 1)}) or ({eq(0, 1)} and {eq(1, 0)}) then 'T' when {eq(0, 0)} or {eq(1, 1)} or {eq(0, 1)} or {eq(1, 0)} then 'P' else 'F' end"
    met = f"case when size(tx) <> size(cx) then 'F' when size(tx) = 2 then {two} when size(tx) = 1 then if({eq(0, 0)}, 'T', 'F') else 'I' end"
    alone = "case when size(x) = 0 then 'I' when array_max(x.g) = 0 then 'T' when array_min(x.g) = 0 then 'P' else 'F' end"
    told = both.withColumn("x", F.coalesce("tx", "cx")).withColumn("gtco", F.expr(f"if(tx is not null and cx is not null, {met}, {alone})"))
    best = F.element_at(F.array(*map(F.lit, "IFPT")), F.max(F.expr("array_position(array('I', 'F', 'P', 'T'), gtco)")).cast("int"))
    of_truth = told.where("t_id is not null").groupBy(F.col("t_id").alias("id"), "sample").agg(best.alias("gtco"))
    of_calls = told.where("c_id is not null").select(F.col("c_id").alias("id"), "sample", "gtco")
    return of_truth.select(F.lit("truth").alias("side"), "id", "sample", "gtco").unionByName(of_calls.select(F.lit("call").alias("side"), "id", "sample", "gtco"))


def transmission(variants: DataFrame, calls: DataFrame, letters: DataFrame) -> DataFrame:
    """variant_id, n_ways, htv: over all assignments of alleles to the four founder haplotypes A to D, how many agree with every
    complete call: FALSE for none, TRUE for one, MULTI-TRUE for more; NA for a variant that no block holds.

    variants: variant_id, chrom, pos, end_pos, n_alleles; calls: variant_id, sample, genotype (array), the complete ones;
    letters: chrom, start, end (blocks that don't overlap), sample, first, second (null for one haplotype). A haplotype that
    a call has can only carry one of its alleles, so at most two are tried for each; one that none has may carry any.
    """
    blocks = letters.select(F.col("chrom").alias("contig"), F.col("start").alias("block_start"), F.col("end").alias("block_end")).distinct()
    placed = contained_in(variants.select("variant_id", F.col("chrom").alias("contig"), "pos", "end_pos"), blocks).select("variant_id", F.col("contig").alias("chrom"), F.col("block_start").alias("start"))
    told = calls.join(placed, "variant_id").join(letters.select("chrom", "start", "sample", "first", "second"), ["chrom", "start", "sample"])
    need = F.struct("first", "second", F.array_sort("genotype").alias("g"))
    needs = told.groupBy("variant_id").agg(F.collect_set(need).alias("needs"))  # at most a row for each sample
    per = placed.select("variant_id").join(needs, "variant_id", "left").join(variants.select("variant_id", "n_alleles"), "variant_id").withColumn("needs", F.coalesce("needs", F.array().cast(needs.schema["needs"].dataType)))
    choices = lambda h: f"if(exists(needs, n -> n.first = '{h}' or n.second = '{h}'), aggregate(transform(filter(needs, n -> n.first = '{h}' or n.second = '{h}'), n -> array_distinct(n.g)), cast(null as array<int>), (s, x) -> if(s is null, x, array_intersect(s, x))), array(-1))"
    per = per.withColumns({h: F.expr(choices(h)) for h in "ABCD"})
    ways = "flatten(flatten(flatten(transform(A, a -> transform(B, b -> transform(C, c -> transform(D, d -> map('A', a, 'B', b, 'C', c, 'D', d))))))))"
    agrees = "forall(needs, n -> n.g = if(n.second is null, array(w[n.first]), array_sort(array(w[n.first], w[n.second]))))"
    free = " * ".join(f"if({h} = array(-1), n_alleles, 1)" for h in "ABCD")
    counts = per.select("variant_id", F.expr(f"cast(size(filter({ways}, w -> {agrees})) * {free} as bigint)").alias("n_ways"))
    out = variants.select("variant_id").join(counts, "variant_id", "left")
    return out.withColumn("htv", F.when(F.col("n_ways").isNull(), "NA").when(F.col("n_ways") == 0, "FALSE").when(F.col("n_ways") == 1, "TRUE").otherwise("MULTI-TRUE"))


def summary(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n_rows"))


def collapse(rows: DataFrame, counts: list[str]) -> DataFrame:
    """Sum the counts over rows that agree in everything else."""
    return rows.groupBy(*(c for c in rows.columns if c not in counts)).agg(*(F.sum(c).alias(c) for c in counts))


def nested_genotypes(calls: DataFrame) -> DataFrame:
    """Of (chrom, sample, hap, pos, allele, span, phased, missing) with allele changed to 0 where a phased one lies under an
    earlier allele of its haplotype that lies under none itself, or where an unphased one is `*`.

    span: reference bases of the allele after the right trim, 1 for the reference and for `*`; the reference takes its base
    as any other allele."""
    rows = calls.withColumnRenamed("chrom", "contig").withColumn("end_pos", F.col("pos") + F.col("span") - 1)
    told = clear_of_earlier(rows, "sample", "hap", ties=("allele", "phased", "missing"))
    gone = F.when(F.col("phased"), ~F.col("clear")).otherwise(F.col("missing"))
    return told.withColumn("allele", F.when(gone, 0).otherwise(F.col("allele")).cast(dict(calls.dtypes)["allele"])).withColumnRenamed("contig", "chrom").select(*calls.columns)


def genotype_counts(calls: DataFrame) -> DataFrame:
    """variant_id, genotype (G index), n."""
    return calls.where("missing = 0").groupBy("variant_id", genotype_index("a", "b").alias("genotype")).agg(F.count("*").alias("n"))


def least_kmers(calls: DataFrame) -> DataFrame:
    """variant_id, allele, nak, fak: the least over samples, of those that were sampled (-1 stands for none)."""
    each = calls.select("variant_id", F.posexplode(F.arrays_zip("nak", "fak")).alias("allele", "x"))
    known = lambda c: F.min(F.when(F.col(f"x.{c}") != -1, F.col(f"x.{c}"))).alias(c)
    return each.groupBy("variant_id", "allele").agg(known("nak"), known("fak"))


#: The attributes that variants and alleles are summarised by.
VARIANT_ATTRIBUTES = ["ChromType", "Filter", "VariantType", "HasMissing", "HasRedundant", "NumAlleles", "EffectiveNumAlleles", "MaxAltACP", "MaxAltAC", "AN", "ACO", "HPL", "HasHomopolymer", "HTV", "NumCompleteSamples", "NumCONCTrue", "NumCONCFalse", "BASE", "CALL", "GTCO", "MED"]
ALLELE_ATTRIBUTES = ["ChromType", "Filter", "AlleleType", "AlleleLength", "AlleleSVLength", "IsRedundant", "NumAlleles", "EffectiveNumAlleles", "ACP", "AC", "AN", "ACO", "HPL", "IsHomopolymer", "HTV", "NumCompleteSamples", "NumCONCTrue", "NumCONCFalse", "BASE", "CALL", "GTCO", "MED", "MinNAK", "MinFAK"]


def _text(value: Column, kind: str = "text", digits: int = 2) -> Column:
    """As summaries spell it: NA for null and `.`, 1 and 0 for TRUE and FALSE."""
    if kind == "flag":
        return F.when(value.isNull(), "NA").otherwise(value.cast("int").cast("string"))
    if kind == "float":
        return F.when(value.isNull(), "NA").otherwise(F.format_string(f"%.{digits}f", value))
    text = value.cast("string")
    return F.when(text.isNull() | (text == "."), "NA").when(text == "TRUE", "1").when(text == "FALSE", "0").otherwise(text)


def summary_attributes(variants: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a row a variant with VARIANT_ATTRIBUTES, a row an allele with ALLELE_ATTRIBUTES), all as text.

    variants: variant_id, chrom, filters, ref, alts, aco (array), hpl (`length:base`), info (map: HTV, BASE, CALL); calls:
    variant_id, sample, ploidy, genotype, saf, app, nak, fak and info (map: CONC, GTCO, MED). GTCO and MED are told for a
    single sample only. Statistics leave filtered alleles out; HPL counts as a base whose alleles differ by one.
    """
    from strandline.functions.alleles import allele_type, contig_class
    from strandline.functions.variants import has_missing, homopolymer_alleles, variant_type

    from . import calling

    stats = calling.statistics(calls, missing="false")
    given = lambda k: F.try_element_at("info", F.lit(k))
    conc = given("CONC")
    per = calls.groupBy("variant_id").agg(
        F.sum(F.expr("cast(not exists(genotype, g -> g is null) as int)")).alias("complete"), F.sum(conc.isin("TRUE", "1").cast("int")).alias("yes"), F.sum(conc.isin("FALSE", "0").cast("int")).alias("no"), F.count("*").alias("samples"),
        F.first(given("GTCO")).alias("gtco"), F.first(given("MED")).alias("med"),
    )
    least = least_kmers(calls)
    # the reference's own count, which the alts' are told of the total
    counts = stats.withColumn("acs", F.concat(F.array(F.col("an") - F.aggregate("ac", F.lit(0), lambda s, x: s + x)), "ac"))
    base, length = F.get(F.split("hpl", ":"), F.lit(1)), F.get(F.split("hpl", ":"), F.lit(0))
    homo = homopolymer_alleles(variants.where("hpl is not null and hpl <> '.'").withColumn("base", base), 1)
    told = variant_type(variants).withColumn("missing", has_missing("alts")).join(counts.drop("filter", "qual"), "variant_id").join(per, "variant_id", "left").join(homo, "variant_id", "left")
    every = F.concat(F.array("ref"), "alts")
    told = told.withColumn("alleles", every).withColumn("repeated", F.transform(every, lambda a: F.size(F.filter(F.col("alleles"), lambda b: a == b)) > 1))
    one = F.col("samples") == 1
    aco = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter("aco", lambda x: F.coalesce(x != ".", F.lit(False))), lambda x: F.split(x, ":"))))), ":")
    filters = F.when(F.size("filters") == 0, "NA").otherwise(F.array_join("filters", ";"))
    shared = {
        "ChromType": contig_class("chrom"), "Filter": filters, "NumAlleles": _text(F.size("alleles")), "EffectiveNumAlleles": _text(F.size(F.filter("acs", lambda n: n > 0))), "AN": _text(F.col("an")), "HPL": _text(length), "HTV": _text(given("HTV")),
        "NumCompleteSamples": _text(F.coalesce("complete", F.lit(0))), "NumCONCTrue": _text(F.coalesce("yes", F.lit(0))), "NumCONCFalse": _text(F.coalesce("no", F.lit(0))), "BASE": _text(given("BASE")), "CALL": _text(given("CALL")),
        "GTCO": _text(F.when(one, F.col("gtco"))), "MED": _text(F.when(one, F.col("med")).cast("double"), "float"),
    }
    alt = lambda c: F.array_max(F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))))
    whole = shared | {
        "VariantType": F.col("type"), "HasMissing": _text(F.col("missing"), "flag"), "HasRedundant": _text(F.array_contains("repeated", True), "flag"), "MaxAltACP": _text(F.coalesce(alt("acp"), F.lit(0.0)), "float"), "MaxAltAC": _text(F.coalesce(alt("acs"), F.lit(0))),
        "ACO": _text(F.nullif(aco, F.lit(""))), "HasHomopolymer": _text(F.array_contains("flags", True), "flag"),
    }
    rows = told.select(*(whole[c].alias(c) for c in VARIANT_ATTRIBUTES))
    each = told.withColumn("acs", F.when(F.size("ac") > 0, F.col("acs")).otherwise(F.transform("alleles", lambda _: F.lit(0)))).select("*", F.posexplode("alleles").alias("allele", "alt"))
    each = allele_type(each.withColumnRenamed("type", "_type")).join(least, ["variant_id", "allele"], "left")
    at = lambda c: F.get(c, F.col("allele"))
    own = shared | {
        "AlleleType": F.col("type"), "AlleleLength": _text(F.col("length")), "AlleleSVLength": _text(F.col("sv_length")), "IsRedundant": _text(at("repeated"), "flag"), "ACP": _text(F.coalesce(at("acp"), F.lit(0.0)), "float"), "AC": _text(F.coalesce(at("acs"), F.lit(0))),
        "ACO": _text(F.when(F.col("allele") > 0, F.get("aco", F.col("allele") - 1))), "IsHomopolymer": _text(at("flags"), "flag"), "MinNAK": _text(F.col("nak"), "float", 1), "MinFAK": _text(F.col("fak"), "float", 2),
    }
    return rows, each.select(*(own[c].alias(c) for c in ALLELE_ATTRIBUTES))
