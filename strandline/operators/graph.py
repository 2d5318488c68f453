"""Variant graphs, candidate haplotype paths, haplotype k-mers, redundant alleles and copy-number extension, by cluster.

A cluster is small and independent once groups are known, so its graph lives in one row's turn of a pandas call; everything
before and after (grouping, the sample's k-mers, k-mer tables of the paths) is DataFrame work.
"""

from __future__ import annotations

from collections.abc import Container
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPLEMENT = str.maketrans("ACGT", "TGCA")
VERTEX_KMERS = 2  # a vertex counts as observed from so many of the sample's k-mers on


def canonical(kmer: str) -> str:
    return min(kmer, kmer.translate(COMPLEMENT)[::-1])


def canonical_kmers(seq: str, k: int) -> list[str]:
    """Canonical k-mers in order; a window with any other letter gives none."""
    out, clean = [], 0
    for i, base in enumerate(seq):
        clean = clean + 1 if base in "ACGT" else 0
        if clean >= k:
            out.append(canonical(seq[i - k + 1 : i + 1]))
    return out


@dataclass
class Vertex:
    seq: str
    start: int  # place on the reference of the first base, or of the variant
    end: int  # place behind the last reference base that it stands for
    variant: int | None = None
    allele: int | None = None
    before: list[int] = field(default_factory=list)


def build(variants: list[tuple[int, str, list[str]]], reference: str, offset: int, k: int) -> list[Vertex]:
    """Vertices in topological order. variants: (pos, ref, alts) in order of pos; reference begins at place `offset`.

    The reference is cut wherever a variant begins or ends; each piece is a vertex, each alt another between the pieces
    around it. k - 1 bases stand on both sides. `*` stands for an allele that a variant further out removes.
    """
    first, last = min(v[0] for v in variants), max(v[0] + len(v[1]) for v in variants)
    low, high = max(offset, first - k + 1), min(offset + len(reference), last + k - 1)
    cuts = sorted({low, high, *(v[0] for v in variants), *(v[0] + len(v[1]) for v in variants)})
    vertices = [Vertex(reference[a - offset : b - offset], a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
    for i, (pos, ref, alts) in enumerate(variants):
        vertices += [Vertex(alt, pos, pos + len(ref), i, j) for j, alt in enumerate(alts, 1) if alt != "*"]
    vertices.sort(key=lambda v: (v.start, v.end, v.variant is not None, v.variant or 0, v.allele or 0))
    by_end: dict[int, list[int]] = {}
    for n, v in enumerate(vertices):
        v.before = list(by_end.get(v.start, []))
        by_end.setdefault(v.end, []).append(n)
    # an empty span (an insertion before its own place) would follow itself only by order; spans here always move on
    return vertices


@dataclass(frozen=True)
class Path:
    seq: str
    alleles: tuple[tuple[int, int], ...]  # (variant, allele) of the alts taken
    hits: int
    total: int
    seen: frozenset[int]  # observed vertices

    @property
    def score(self) -> float:
        return self.hits / self.total if self.total else 1.0


class Lookup:
    """The sample's k-mers as far as they were looked up; `missing` gathers those that are asked for and were not."""

    def __init__(self, seen: set[str], known: set[str]) -> None:
        self.seen, self.known, self.missing = seen, known, set()

    def __contains__(self, kmer: str) -> bool:
        if kmer not in self.known:
            self.missing.add(kmer)
        return kmer in self.seen


def local_kmers(vertices: list[Vertex], k: int, wide: int) -> set[str]:
    """k-mers of windows of the graph. Of each vertex at most `wide` endings of k - 1 bases go on to the next."""
    out, ends = set(), []
    for v in vertices:
        own = {}
        for s in dict.fromkeys(e for b in v.before for e in ends[b]) if v.before else ("",):
            out.update(canonical_kmers(s + v.seq[: k - 1], k))
            own[(s + v.seq)[-(k - 1) :] if k > 1 else ""] = None
        out.update(canonical_kmers(v.seq, k))
        ends.append(list(own)[:wide])
    return out


def extend(path: Path | None, n: int, vertex: Vertex, observed: Container[str], k: int) -> Path:
    seq = (path.seq if path else "") + vertex.seq
    own = canonical_kmers(seq[max(0, len(seq) - len(vertex.seq) - k + 1) :], k)
    hits = sum(x in observed for x in own)
    alleles = path.alleles if path else ()
    seen = path.seen if path else frozenset()
    if vertex.variant is not None:
        alleles = (*alleles, (vertex.variant, vertex.allele))
    if hits >= min(VERTEX_KMERS, max(1, len(own))):
        seen = seen | {n}
    return Path(seq, alleles, (path.hits if path else 0) + hits, (path.total if path else 0) + len(own), seen)


def choose(paths: list[Path], most: int) -> list[Path]:
    """At most `most`: first, best score first, those that add an observed vertex; then by score alone."""
    left, out, covered = sorted(paths, key=lambda p: (-p.score, p.alleles)), [], set()
    while left and len(out) < most:
        best = next((p for p in left if p.seen - covered), None)
        if best is None:
            break
        covered |= best.seen
        out.append(best)
        left.remove(best)
    return (out + left)[:most]


def find_paths(vertices: list[Vertex], observed: Container[str], k: int, most: int = 32) -> list[Path]:
    """The beam's paths over the whole graph; paths that spell the same sequence are one, that with more alts."""
    at: list[list[Path]] = []
    for n, v in enumerate(vertices):
        incoming = [p for b in v.before for p in at[b]] if v.before else [None]
        best: dict[str, Path] = {}
        for p in incoming:
            new = extend(p, n, v, observed, k)
            if new.seq not in best or len(new.alleles) > len(best[new.seq].alleles):
                best[new.seq] = new
        at.append(choose(list(best.values()), most))
    end = vertices[-1].end
    final: dict[str, Path] = {}
    for n, v in enumerate(vertices):
        if v.end == end:
            for p in at[n]:
                final.setdefault(p.seq, p)
    return choose(list(final.values()), most)


def ordered(variants: list) -> list[tuple[int, str, list[str]]]:
    return sorted(((v["pos"], v["ref"], list(v["alts"])) for v in variants), key=lambda v: (v[0], len(v[1])))


def described(path: Path, variants: list[tuple[int, str, list[str]]], low: int, missing: list[int]) -> tuple[list[int], list[tuple[int, int]]]:
    """(allele of each variant, where it stands in the path's sequence). The path begins at place `low`. Of a variant whose place
    an earlier allele of the path removes, the allele is missing[v] (0 where that is -1) and stands nowhere, (0, -1); as do
    reference alleles of which a part is removed. A first base that REF and allele share isn't counted."""
    taken, at, length, kept = dict(path.alleles), low, 0, []
    where: dict[int, tuple[int, int]] = {}
    for v, allele in path.alleles:
        pos, ref, alts = variants[v]
        kept.append((at, pos, length))
        length += pos - at
        alt = alts[allele - 1]
        where[v] = (length + (alt[0] == ref[0]), length + len(alt))
        at, length = pos + len(ref), length + len(alt)
    kept.append((at, 1 << 62, length))
    alleles, places = [], []
    for v, (pos, ref, alts) in enumerate(variants):
        if v in taken:
            alleles.append(taken[v])
            places.append(where[v])
            continue
        whole = next(((a, n) for a, b, n in kept if a <= pos and pos + len(ref) <= b), None)
        gone = not any(a <= pos < b for a, b, _ in kept)
        alleles.append(max(0, missing[v]) if gone else 0)
        shared = any(x[0] == ref[0] for x in alts if x != "*")
        places.append((whole[1] + pos - whole[0] + shared, whole[1] + pos - whole[0] + len(ref)) if whole else (0, -1))
    return alleles, places


def removers(path: Path, variants: list[tuple[int, str, list[str]]], inner: dict) -> dict:
    """Of the inner clusters (name: first place, last place) those that an allele of the path removes, and whose: the variant."""
    out = {}
    for v, allele in path.alleles:
        pos, ref, alts = variants[v]
        for name, (first, last) in inner.items():
            if pos + len(alts[allele - 1]) <= first and last < pos + len(ref):
                out[name] = v
    return out


def haplotypes(clusters: DataFrame, k: int, most: int = 32) -> DataFrame:
    """cluster, hap (from 0), seq, alleles (an index per variant, 0 for the reference). clusters: cluster, variants (array of
    struct pos, ref, alts), reference (its bases), first (their place), kmers (the sample's canonical k-mers there)."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in rows.itertuples(index=False):
            variants = ordered(r.variants)
            for h, p in enumerate(find_paths(build(variants, r.reference, r.first, k), set(r.kmers), k, most)):
                taken = dict(p.alleles)
                out.append((r.cluster, h, p.seq, [taken.get(i, 0) for i in range(len(variants))]))
        return pd.DataFrame(out, columns=["cluster", "hap", "seq", "alleles"])

    kind = dict(clusters.dtypes)["cluster"]
    return clusters.mapInPandas(lambda batches: map(run, batches), f"cluster {kind}, hap int, seq string, alleles array<int>")


def windows(clusters: DataFrame, k: int, wide: int) -> DataFrame:
    """cluster, kmer: local_kmers of each cluster's graph. clusters as for `haplotypes`, without kmers."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = [(r.cluster, x) for r in rows.itertuples(index=False) for x in sorted(local_kmers(build(ordered(r.variants), r.reference, r.first, k), k, wide))]
        return pd.DataFrame(out, columns=["cluster", "kmer"])

    return clusters.mapInPandas(lambda batches: map(run, batches), f"cluster {dict(clusters.dtypes)['cluster']}, kmer string")


def looked_up(clusters: DataFrame, k: int, most: int = 32) -> DataFrame:
    """Candidate haplotypes where some of the sample's k-mers may not have been looked up: clusters has `known` (those looked up)
    beside kmers (those found). A cluster whose beam asks for others gives them, in rows with a kmer and no hap, instead.

    Beside hap, seq and alleles: places (start and end of each variant's allele in seq) and lacks (inner cluster -> the variant
    that removes it), by the columns missing (index of `*` of each variant, -1 for none) and inner (array of struct name,
    first, last) of clusters, where they are given."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in rows.itertuples(index=False):
            variants, seen = ordered(r.variants), Lookup(set(r.kmers), set(r.known))
            vertices = build(variants, r.reference, r.first, k)
            paths = find_paths(vertices, seen, k, most)
            if seen.missing:
                out += [(r.cluster, None, None, None, None, None, x) for x in sorted(seen.missing)]
                continue
            missing = list(getattr(r, "missing", [-1] * len(variants)))
            inner = {x["name"]: (x["first"], x["last"]) for x in getattr(r, "inner", [])}
            for h, p in enumerate(paths):
                alleles, places = described(p, variants, vertices[0].start, missing)
                out.append((r.cluster, h, p.seq, alleles, [{"start": a, "end": b} for a, b in places], removers(p, variants, inner), None))
        return pd.DataFrame(out, columns=["cluster", "hap", "seq", "alleles", "places", "lacks", "kmer"]).astype({"hap": "Int32"})

    kind = dict(clusters.dtypes)["cluster"]
    return clusters.mapInPandas(lambda batches: map(run, batches), f"cluster {kind}, hap int, seq string, alleles array<int>, places array<struct<start: int, end: int>>, lacks map<{kind}, int>, kmer string")


def covering_kmers(haps: DataFrame, k: int) -> DataFrame:
    """cluster, hap, kmer, mult (at most 255), variants: which of the haplotype's variants the k-mer covers, by a base of the
    allele or, where it has none of its own, by the bases on both sides. Row by row, without a shuffle."""
    def run(batches):
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                found: dict[str, list] = {}
                clean = 0
                for i, base in enumerate(r.seq):
                    clean = clean + 1 if base in "ACGT" else 0
                    if clean >= k:
                        own = found.setdefault(canonical(r.seq[i - k + 1 : i + 1]), [0, set()])
                        own[0] += 1
                        own[1].update(v for v, x in enumerate(r.places) if i - k + 1 < x["end"] and i >= x["start"])
                out += [(r.cluster, r.hap, x, min(255, n), sorted(vs)) for x, (n, vs) in found.items()]
            yield pd.DataFrame(out, columns=["cluster", "hap", "kmer", "mult", "variants"])

    kind = dict(haps.dtypes)["cluster"]
    return haps.select("cluster", "hap", "seq", "places").mapInPandas(run, f"cluster {kind}, hap int, kmer string, mult int, variants array<int>")


def haplotype_kmers(haps: DataFrame, k: int, most: int | None = 255) -> DataFrame:
    """cluster, hap, kmer, mult (at most 255, or `most`; None: as many as there are)."""
    from strandline.functions.sequence import canonical_kmers as kmers_of

    rows = haps.select("cluster", "hap", F.explode(kmers_of("seq", k)).alias("kmer"))
    many = F.count("*") if most is None else F.least(F.lit(most), F.count("*"))
    return rows.groupBy("cluster", "hap", "kmer").agg(many.cast("int").alias("mult"))


def uncovered_alleles(variants: DataFrame, haps: DataFrame) -> DataFrame:
    """cluster, variant (its place in the cluster), allele: alleles that no candidate haplotype takes. variants: cluster,
    variant, n_alleles."""
    taken = haps.select("cluster", F.posexplode("alleles").alias("variant", "allele")).distinct()
    every = variants.select("cluster", "variant", F.explode(F.sequence(F.lit(0), F.col("n_alleles") - 1)).alias("allele"))
    return every.join(taken, ["cluster", "variant", "allele"], "left_anti")


def copy_number_extension(allele: str, after: str, k: int, threshold: float = 0.5) -> int:
    """How far copies of an allele go on behind it: windows of its length whose k-mers are its own to the threshold; of a
    window the best prefix counts, the longer of equals."""
    if len(allele) < k:
        return 0
    own, done = set(canonical_kmers(allele, k)), 0
    while True:
        window = after[done : done + len(allele)]
        hits, best, length = 0, -1.0, 0
        for n in range(k, len(window) + 1):
            mer = window[n - k : n]
            hits += canonical(mer) in own if set(mer) <= set("ACGT") else 0
            if (share := hits / (n - k + 1)) >= best:
                best, length = share, n
        if not length or best < threshold:
            return done
        done += length


def extension(allele: str, after: str, k: int, threshold: float = 0.5) -> Column:
    """copy_number_extension of two string columns; alleles of k bases are rare, so the pandas call sees few rows."""
    @F.pandas_udf("int")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([copy_number_extension(x or "", y or "", k, threshold) for x, y in zip(a, b, strict=True)])

    return F.when(F.length(allele) >= k, run(F.col(allele), F.col(after))).otherwise(0)


def spelled_by_others(ref: str, alt: str, pos: int, others: list[tuple[int, str, list[str]]], reference: str, offset: int) -> list[tuple[int, int]] | None:
    """Whether two or more alleles in a row, with the reference between them, spell the change ref -> alt at pos: their
    (variant, allele) from left to right, or None. Depth first over variants inside the span of ref."""
    end = pos + len(ref)
    inside = sorted(i for i, (p, r, _) in enumerate(others) if p >= pos and p + len(r) <= end)

    def go(at: int, spelled: int, taken: list[tuple[int, int]]) -> list[tuple[int, int]] | None:
        if at == end and spelled == len(alt):
            return taken if len(taken) >= 2 else None
        rest = reference[at - offset : end - offset]
        if len(taken) >= 2 and alt[spelled:] == rest:
            return taken
        for i in inside:
            p, r, alts = others[i]
            between = reference[at - offset : p - offset]
            if p < at or alt[spelled : spelled + len(between)] != between:
                continue
            for j, a in enumerate(alts, 1):
                here = spelled + len(between)
                if (p, r, a) != (pos, ref, alt) and alt[here : here + len(a)] == a and (found := go(p + len(r), here + len(a), [*taken, (i, j)])):
                    return found
        return None

    return go(pos, 0, [])
