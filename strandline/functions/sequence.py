"""Nucleotide sequences and k-mers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def reverse_complement(seq: str | Column) -> Column:
    """Upper-case reverse complement; an ambiguous base stays N."""
    return F.reverse(F.translate(_c(seq), "ACGTacgtNn", "TGCATGCANN"))


def is_nucleotides(seq: str | Column) -> Column:
    return _c(seq).rlike("^[ACGT]+$")


def canonical(kmer: str | Column) -> Column:
    """The smaller of a k-mer and its reverse complement (A < C < G < T)."""
    return F.least(_c(kmer), F.reverse(F.translate(_c(kmer), "ACGT", "TGCA")))


def runs(seq: str | Column, k: int) -> Column:
    """Unambiguous stretches of at least k bases: any other letter ends a k-mer window."""
    return F.regexp_extract_all(F.upper(_c(seq)), F.lit(f"([ACGT]{{{k},}})"), F.lit(1))


def kmers(run: str | Column, k: int) -> Column:
    """All k-mers of a run, in order. They are cut from its bytes, as a place in a string is found by reading up to it."""
    run = _c(run)
    cut = lambda b: F.transform(F.sequence(F.lit(1), F.length(b) - (k - 1)), lambda i: F.substr(b, i, F.lit(k)).cast("string"))
    return F.when(F.octet_length(run) >= k, F.transform(F.array(run.cast("binary")), cut)[0]).otherwise(F.array().cast("array<string>"))


def canonical_kmers(seq: str | Column, k: int) -> Column:
    """Canonical k-mers of all runs of a sequence. The other strand of a run is made once; there the k-mers stand from its end."""
    def of_run(run: Column) -> Column:
        strands = F.struct(run.cast("binary").alias("a"), reverse_complement(run).cast("binary").alias("b"), F.octet_length(run).alias("n"))
        least = lambda x, i: F.least(F.substr(x["a"], i, F.lit(k)), F.substr(x["b"], x["n"] - (k - 2) - i, F.lit(k))).cast("string")
        return F.transform(F.array(strands), lambda x: F.transform(F.sequence(F.lit(1), x["n"] - (k - 1)), lambda i: least(x, i)))[0]

    return F.flatten(F.transform(runs(seq, k), of_run))


def packed(kmer: str | Column) -> Column:
    """Two bits a base, A=0 C=1 G=2 T=3, as a decimal that holds up to 63 bases by halves of 31 and less; for k <= 31 a long."""
    return F.conv(F.translate(F.upper(_c(kmer)), "ACGT", "0123"), 4, 10).cast("decimal(20,0)").cast("long")


def unpacked(bits: str | Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(_c(bits).cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def gc_bin(kmer: str | Column, bins: int) -> Column:
    """ceil(gc * bins / k) - 1, not below 0."""
    gc = F.length(F.regexp_replace(_c(kmer), "[AT]", ""))
    return F.greatest(F.lit(0), F.ceil(gc * bins / F.length(_c(kmer))).cast("int") - 1)


def base_counts(kmer: str | Column) -> list[Column]:
    """n_a, n_c, n_g, n_t."""
    k = _c(kmer)
    return [(F.length(k) - F.length(F.replace(k, F.lit(b)))).alias(f"n_{b.lower()}") for b in "ACGT"]


def sample_ambiguous(seq: str | Column, key: str | Column, seed: int) -> Column:
    """Each N becomes a base drawn by (key, place, seed): the same on every run and partitioning."""
    bases = F.array(*map(F.lit, "ACGT"))
    return F.array_join(F.transform(F.split(F.upper(_c(seq)), ""), lambda c, i: F.when(c == "N", F.get(bases, F.pmod(F.xxhash64(_c(key), i, F.lit(seed)), F.lit(4)).cast("int"))).otherwise(c)), "")


def shard(kmer: str | Column, n: int) -> Column:
    return F.pmod(F.xxhash64(_c(kmer)), F.lit(n))


def drawn(kmer: str | Column, share: float, seed: int) -> Column:
    """A sample by hash, that any run of the same seed repeats."""
    return F.pmod(F.xxhash64(_c(kmer), F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20))
