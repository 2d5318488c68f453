"""Genotypes, posteriors and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1.1920928955078125e-07  # of 32-bit floats


def parse(gt: str) -> dict[str, Column]:
    """gt (array of indices, null for a missing one), phased, ploidy, status of a GT field; `.` or empty: no allele."""
    raw = F.split(F.col(gt), r"[/|]")
    indices = F.transform(raw, lambda x: x.try_cast("int"))
    none = F.col(gt).isNull() | (F.col(gt) == "")
    known = F.size(F.filter(indices, lambda x: x.isNotNull()))
    return {
        "gt": F.when(none, F.array().cast("array<int>")).otherwise(indices), "phased": F.coalesce(~F.contains(F.col(gt), F.lit("/")), F.lit(True)), "ploidy": F.when(none, 0).otherwise(F.size(raw)),
        "status": F.when(none | (known == F.size(raw)), "Complete").when(known == 0, "Missing").otherwise("Partial"),
    }


def genotype_index(a: str | Column, b: str | Column) -> Column:
    """Place of the genotype {a, b} in G order."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    low, high = F.least(a, b), F.greatest(a, b)
    return (F.expr("0") + high * (high + 1) / 2 + low).cast("int")


def genotype_pair(index: str) -> tuple[Column, Column]:
    """(a, b), a <= b, of a place in G order."""
    i = F.col(index)
    b = F.floor((F.sqrt(8 * i + 1) - 1) / 2).cast("int")
    return (i - b * (b + 1) / 2).cast("int"), b


def possible_genotypes(alleles: str | Column, ploidy: str | Column) -> Column:
    n, p = (F.col(x) if isinstance(x, str) else x for x in (alleles, ploidy))
    return F.when(p == 2, (n * (n + 1) / 2).cast("int")).when(p == 1, n).otherwise(0)


def float_equal(a: Column, b: Column) -> Column:
    """Relative: the difference is under 100 epsilons of the smaller; 0 equals 0 only."""
    return (a == b) | (F.abs(a - b) < F.abs(F.least(a, b)) * EPSILON * 100)


def float_less(a: Column, b: Column) -> Column:
    return ~float_equal(a, b) & (a < b)


def phred(p: Column) -> Column:
    """99 at 1, 0 at 0, else -10 log10(1 - p)."""
    return F.when(float_equal(p, F.lit(1.0)), 99.0).when(p == 0, 0.0).otherwise(-10 * F.log10(1 - p))


def log_add(a: Column, b: Column) -> Column:
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def best_genotype(posteriors: str) -> Column:
    """Index of the largest posterior; null if it is shared, or if a posterior is missing."""
    p = F.col(posteriors)
    unique = F.size(F.filter(p, lambda x: x == F.array_max(p))) == 1
    whole = ~F.exists(p, lambda x: x.isNull()) & (F.size(p) > 0)
    return F.when(whole & unique, (F.array_position(p, F.array_max(p)) - 1).cast("int"))


def _log_gamma_ratio(x: str, r: str) -> str:
    """SQL: log gamma(x + r) - log gamma(r) for a whole number x."""
    return f"aggregate(if({x} > 0, sequence(0, cast({x} as int) - 1), cast(array() as array<int>)), 0D, (s, i) -> s + ln({r} + i))"


def negative_binomial_log_pmf(x: str, p: str, size: str) -> Column:
    """log pmf of count x; p: chance of success, size: number of successes (any positive number)."""
    return F.expr(f"{_log_gamma_ratio(x, size)} - aggregate(if({x} > 0, sequence(1, cast({x} as int)), cast(array() as array<int>)), 0D, (s, i) -> s + ln(i)) + {size} * ln({p}) + {x} * ln(1 - {p})")


def poisson_log_pmf(x: str, rate: str) -> Column:
    return F.expr(f"{x} * ln({rate}) - {rate} - aggregate(if({x} > 0, sequence(1, cast({x} as int)), cast(array() as array<int>)), 0D, (s, i) -> s + ln(i))")


def least_observed_share(mean: Column, beta: float = 0.275) -> Column:
    """Least share of observed k-mers of an allele, by the mean coverage of a k-mer."""
    return 1 - F.exp(-beta * mean)


def six_digits(x: str) -> str:
    """SQL: a number's text with six significant digits at most, as %g gives it (1e-05, 0.0001, 99, 1e+06); a tie goes up."""
    short = f"format_string('%.5e', cast({x} as double))"
    plain = f"regexp_replace(format_string('%.10f', cast({short} as double)), '[.]?0+$', '')"
    return f"case when {x} is null then null when {x} = 0 then '0' when abs(cast({short} as double)) >= 0.0001D and abs(cast({short} as double)) < 1000000D then {plain} else regexp_replace({short}, '[.]?0+e', 'e') end"
