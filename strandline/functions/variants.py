"""Variants with all their alts: trimming, types, predicates, fields and attribute filters. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import alleles
from .alleles import _prefix

COMPARISONS = {"=": "__eq__", "!=": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}


def shared_suffix(ref: str, alts: str) -> Column:
    """Bases at the end that REF and all alts share, keeping one of each; 0 beside an alt `*`."""
    own = _prefix(f"reverse({ref})", "reverse(alt)", f"least(length({ref}), length(alt)) - 1")
    return F.expr(f"array_min(transform({alts}, alt -> {own}))")


def right_trimmed(variants: DataFrame) -> DataFrame:
    """(…, ref, alts) without the suffix that REF shares with every alt, and `trimmed`, its length."""
    told = variants.withColumn("trimmed", shared_suffix("ref", "alts"))
    cut = lambda x: F.expr(f"left({x}, length({x}) - trimmed)")
    return told.withColumn("ref", cut("ref")).withColumn("alts", F.expr("transform(alts, alt -> left(alt, length(alt) - trimmed))"))


def has_missing(alts: str) -> Column:
    return F.array_contains(alts, "*")


def has_ambiguous(ref: str, alts: str) -> Column:
    """Whether a sequence allele holds another letter than A, C, G and T."""
    each = F.concat(F.array(ref), alts)
    return F.exists(each, lambda a: ~a.rlike(r"^<.*>$|^[\[\]]|[\[\]]$") & (a != "*") & a.rlike("[^ACGT]"))


def is_set(values: str) -> Column:
    """Whether an alt has a value (of AAI: annotated; of RMA: a repeat); `.` and null are none."""
    return F.exists(values, lambda x: F.coalesce(x != ".", F.lit(False)))


def variant_type(variants: DataFrame) -> DataFrame:
    """Add type: Multi with more than one alt beside `*`, else that alt's."""
    own = F.filter("alts", lambda a: a != "*")
    told = alleles.allele_type(variants.withColumn("_alt", F.get(own, F.lit(0))), "ref", "_alt")
    return told.withColumn("type", F.when(F.size(own) > 1, "Multi").otherwise(F.col("type"))).select(*variants.columns, "type")


def variant_class(rows: DataFrame, key: str = "variant_id", excluded: Column | None = None) -> DataFrame:
    """key, class of (key, ref, alt, an allele a row): that of its usable alleles, Mixture where they differ, Unsupported
    where none is usable."""
    told = alleles.allele_class(rows).withColumn("class", F.when(~F.coalesce(excluded, F.lit(False)) if excluded is not None else F.lit(True), F.col("class")))
    per = told.groupBy(key).agg(F.min("class").alias("a"), F.max("class").alias("b"))
    return per.select(key, F.when(F.col("a").isNull(), "Unsupported").when(F.col("a") != F.col("b"), "Mixture").otherwise(F.col("a")).alias("class"))


def homopolymer_alleles(variants: DataFrame, most: int, key: str = "variant_id") -> DataFrame:
    """key, flags of (key, ref, alts, base): whether each allele, REF first, differs from another one by no more than `most`
    copies of the base and by nothing else."""
    each = variants.select(key, "base", "ref", F.posexplode(F.concat(F.array("ref"), "alts")).alias("i", "alt"))
    t = alleles.trimmed(each).select(key, "base", F.struct("i", "alt", F.col("trimmed_ref").alias("r"), F.col("trimmed_alt").alias("a")).alias("x"))
    per = t.groupBy(key, "base").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    only = lambda x: f"replace({x}.r, base, '') = '' and replace({x}.a, base, '') = ''"
    near = f"abs(length(x.r) - length(y.r)) + abs(length(x.a) - length(y.a)) <= {most}"
    return per.select(key, F.expr(f"transform(xs, x -> exists(xs, y -> x.alt <> y.alt and {only('x')} and {only('y')} and {near}))").alias("flags"))


def with_alt(alts: str, alt: Column) -> Column:
    """The alts and, if it is not among them, another one at the end; indices of the others stay."""
    return F.when(F.array_contains(alts, alt), F.col(alts)).otherwise(F.array_append(alts, alt))


def distinct_alts(alts: str) -> tuple[Column, Column]:
    """(the alts without repeats, the places, from 1, of those that stay)."""
    return F.array_distinct(alts), F.filter(F.sequence(F.lit(1), F.size(alts)), lambda i: F.array_position(alts, F.get(alts, i - 1)) == i)


def without_alleles(genotype: str, keep: Column, to_reference: bool = False) -> Column:
    """A genotype's indices after alts were removed (keep: the places of those that stay, from 1): a removed one goes, or
    becomes the reference."""
    own = alleles.remove_alleles(genotype, keep, to_reference)
    return own if to_reference else F.array_compact(own)


def with_value(field: str, value: Column) -> Column:
    """A field of ids or filters with one more, if it is not there; repeats in it go as well."""
    return F.array_union(F.coalesce(field, F.array().cast("array<string>")), F.array(value))


def is_informative(status: str, ploidy: str) -> Column:
    """A called sample of one or two copies."""
    return (F.col(status) != "Missing") & F.col(ploidy).between(1, 2)


def allele_is_missing(index: Column, alts: str) -> Column:
    """Whether an index is that of `*`, which is the last alt."""
    return (F.element_at(F.col(alts), -1) == "*") & (index == F.size(alts))


def split_elements(text: str, mark: str, keep_empty: bool = True, most: int | None = None) -> Column:
    """Elements between single characters: without the empty ones, or the last of `most` with all that is left. A mark at the
    end begins no element."""
    whole = F.when(F.col(text) == "", F.array().cast("array<string>")).otherwise(F.split(text, f"\\Q{mark}\\E", most or -1))
    ended = F.when(F.col(text).endswith(mark) & (F.element_at(whole, -1) == ""), F.slice(whole, 1, F.size(whole) - 1)).otherwise(whole)
    return ended if keep_empty else F.filter(ended, lambda x: x != "")


def nested_ploidy(ploidy: str) -> Column:
    """Copies of what lies inside an allele that one haplotype lacks."""
    return F.greatest(F.col(ploidy) - 1, F.lit(0))


def has_flag(info: str, key: str) -> Column:
    return F.map_contains_key(info, F.lit(key))


def compared(value: Column, op: str, other) -> Column:
    """value op other; a value that is not there passes nothing."""
    return F.coalesce(getattr(value, COMPARISONS[op])(F.lit(other)), F.lit(False))


def alleles_pass(genotype: str, values: str, op: str, other, every: bool, alts: str | None = None) -> Column:
    """Whether the called alleles' values (an array by allele) pass, both or one of them; `*` is passed over, and a genotype of
    nothing else passes. A sample without a call doesn't."""
    known = F.filter(genotype, lambda g: g.isNotNull())
    told = F.filter(known, lambda g: ~allele_is_missing(g, alts)) if alts else known
    test = lambda g: compared(F.get(values, g), op, other)
    passed = F.forall(told, test) if every else F.exists(told, test)
    return F.when(F.size(known) == 0, False).when(F.size(told) == 0, True).otherwise(passed)
