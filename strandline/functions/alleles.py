"""Alleles and variants. REF and ALT are given by column name; results are built-in expressions without a UDF.

Common prefixes are found by bisection, so a pair of alleles of n bases costs n log n and not n squared.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _prefix(a: str, b: str, most: str) -> str:
    """SQL: length of the common prefix of a and b, at most `most`."""
    mid = "cast((s.hi + s.lo + 1) div 2 as int)"
    step = f"if(left({a}, {mid}) = left({b}, {mid}), named_struct('lo', {mid}, 'hi', s.hi), named_struct('lo', s.lo, 'hi', {mid} - 1))"
    return f"aggregate(sequence(0, 31), named_struct('lo', 0, 'hi', greatest({most}, 0)), (s, i) -> if(s.lo >= s.hi, s, {step})).lo"


def kind(allele: str) -> Column:
    """id (symbolic or breakend), missing (*), sequence (of IUPAC letters, in any case) or invalid."""
    a = F.col(allele)
    return F.when(a == "*", "missing").when(a.rlike(r"^<.*>$|^[\[\]]|[\[\]]$"), "id").when(a.rlike("^[ACGTRYSWKMBDHVNacgtryswkmbdhvn]+$"), "sequence").otherwise("invalid")


def right_trim(ref: str, alt: str) -> Column:
    """Bases of the common suffix, keeping one of each."""
    return F.expr(_prefix(f"reverse({ref})", f"reverse({alt})", f"least(length({ref}), length({alt})) - 1"))


def left_trim(ref: str, alt: str, right: str, full: bool) -> Column:
    """Bases of the common prefix behind which the right trim has been taken off, keeping one of each, or none if full."""
    r, a = (f"left({x}, length({x}) - {right})" for x in (ref, alt))
    return F.expr(_prefix(r, a, f"least(length({ref}), length({alt})) - {right} - {0 if full else 1}"))


def trimmed(df, ref: str = "ref", alt: str = "alt"):
    """Add right, left (full trim), trimmed_ref and trimmed_alt."""
    out = df.withColumn("right", right_trim(ref, alt)).withColumn("left", left_trim(ref, alt, "right", full=True))
    for x in (ref, alt):
        out = out.withColumn(f"trimmed_{'ref' if x == ref else 'alt'}", F.expr(f"substring({x}, left + 1, length({x}) - left - right)"))
    return out


def inversion_matches(a: str, b: str) -> Column:
    """Bases of the reverse complement of a that equal b's; N never matches."""
    return F.expr(f"size(filter(zip_with(split(reverse(translate({a}, 'ACGTN', 'TGCAN')), ''), split({b}, ''), (x, y) -> x = y and x <> 'N'), m -> m))")


def is_inversion(a: str, b: str, share: float = 0.95, least: int = 10) -> Column:
    return F.when((F.length(a) == F.length(b)) & (F.length(a) >= least), inversion_matches(a, b) / F.length(a) >= share).otherwise(False)


def allele_type(df, ref: str = "ref", alt: str = "alt"):
    """Add type, length, n_ambiguous and sv_length by the full trim (and the trim's columns)."""
    t = trimmed(df, ref, alt)
    r, a = F.length("trimmed_ref"), F.length("trimmed_alt")
    missing, same = F.col(alt) == "*", F.col(alt) == F.col(ref)
    by_length = F.when((r == 1) & (a == 1), "SNP").when((r == a) & is_inversion("trimmed_alt", "trimmed_ref"), "Inversion").when(r == a, "Complex").when(a == 0, "Deletion").when(r == 0, "Insertion").otherwise("Complex")
    n_of = lambda x: F.length(x) - F.length(F.replace(F.col(x), F.lit("N")))
    return (
        t.withColumn("type", F.when(missing, "Missing").when(same, "Reference").otherwise(by_length))
        .withColumn("length", F.when(missing, 0).when(same, F.length(alt)).otherwise(a))
        .withColumn("n_ambiguous", F.when(missing, 0).when(same, n_of(alt)).otherwise(n_of("trimmed_alt")))
        .withColumn("sv_length", F.when(missing | same, 0).otherwise(a - r))
    )


def allele_class(df, ref: str = "ref", alt: str = "alt"):
    """Add class: SNV, Insertion, Deletion or Complex, as the genotyper sees an allele (right trim, then whole left prefix)."""
    t = trimmed(df, ref, alt)
    r, a = F.length("trimmed_ref"), F.length("trimmed_alt")
    return t.withColumn("class", F.when((r == 1) & (a == 1), "SNV").when((r == 0) & (a > 0), "Insertion").when((a == 0) & (r > 0), "Deletion").otherwise("Complex"))


def homopolymer(seq: str, at: str) -> tuple[Column, Column]:
    """(base, length of its run around place `at`, from 0); null past the ends."""
    base = F.expr(f"nullif(substring({seq}, {at} + 1, 1), '')")
    left = F.expr(f"length(left({seq}, {at})) - length(rtrim(substring({seq}, {at} + 1, 1), left({seq}, {at})))")
    right = F.expr(f"length(substring({seq}, {at} + 2)) - length(ltrim(substring({seq}, {at} + 1, 1), substring({seq}, {at} + 2)))")
    return base, F.when(base.isNotNull(), 1 + left + right)


def origins(tags: str) -> Column:
    """Sorted distinct tags of an array of colon lists, joined by colons."""
    return F.array_join(F.array_sort(F.array_distinct(F.flatten(F.transform(F.col(tags), lambda t: F.split(t, ":"))))), ":")


def contig_class(chrom: str) -> Column:
    name = F.lower(F.regexp_replace(F.col(chrom), "^[cC][hH][rR]", ""))
    return F.when(name.rlike("^[0-9]+$"), "autosomal").when(name == "x", "x").when(name == "y", "y").when(name.isin("m", "mt"), "mt").otherwise("unknown")


def default_ploidy(chrom: str, female: Column) -> Column:
    kind_ = contig_class(chrom)
    return F.when(kind_ == "x", F.when(female, 2).otherwise(1)).when(kind_ == "y", F.when(female, 0).otherwise(1)).otherwise(2)


def repeat_length(rma: str, family: str) -> Column:
    """Nucleotides of a family in `family#n:family#n`."""
    return F.element_at(F.str_to_map(F.col(rma), F.lit(":"), F.lit("#")), family).cast("int")


def remove_alleles(gt: str, keep: Column, to_reference: bool = False) -> Column:
    """Genotype indices after alts are removed; keep: the kept alt indices (from 1), ascending. A removed allele gets
    null, or 0."""
    return F.transform(F.col(gt), lambda g: F.when((g == 0) | g.isNull(), g).when(F.array_contains(keep, g), F.array_position(keep, g).cast("int")).otherwise(F.lit(0 if to_reference else None).cast("int")))


def is_homopolymer_change(trimmed_ref: str, trimmed_alt: str, base: str, most: int) -> Column:
    """Both trimmed alleles are runs of the base (or empty), and together differ by at most `most` bases."""
    only = lambda x: F.length(F.replace(F.col(x), F.col(base))) == 0
    return only(trimmed_ref) & only(trimmed_alt) & (F.abs(F.length(trimmed_ref) - F.length(trimmed_alt)).between(1, most))


def without_trailing_missing(alts: str, dependent: Column | None = None) -> Column:
    """The alts without a last `*`; one of a variant that depends on no earlier one raises, where `dependent` tells."""
    a = F.col(alts)
    cut = F.slice(a, 1, F.size(a) - 1)
    if dependent is not None:
        cut = F.when(dependent, cut).otherwise(F.raise_error(F.lit("a missing allele without an earlier variant over it")).cast("array<string>"))
    return F.when(F.element_at(a, -1) == "*", cut).otherwise(a)
