"""Hand-made cases and properties of the genotyping operators, sources and sinks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import alleles, genotypes, sequence
from strandline.operators import callsets, calling, genotyping, graph, inference, intervals, tools
from strandline.sources import fasta, tables, vcf


def one(df):
    return df.first()


def test_sequences(spark):
    row = one(
        spark.createDataFrame([("TTT", "ACNGTA", "acgn")], "a string, b string, c string").select(
            sequence.canonical("a").alias("canonical"), sequence.canonical_kmers("b", 3).alias("reset"), sequence.reverse_complement("c").alias("rc"), sequence.gc_bin("a", 1).alias("bin"), sequence.unpacked(sequence.packed("a"), 3).alias("back")
        )
    )
    assert row.asDict() == {"canonical": "AAA", "reset": ["GTA"], "rc": "NCGT", "bin": 0, "back": "TTT"}


@pytest.mark.parametrize(
    ("ref", "alt", "expected"),
    [("CAG", "CTG", ("A", "T", "SNP", 0)), ("ACGT", "A", ("CGT", "", "Deletion", -3)), ("A", "ATT", ("", "TT", "Insertion", 2)), ("ACGTACGTTT", "AAACGTACGT", ("CGTACGTT", "AACGTACG", "Complex", 0)), ("GATTACAGGCT", "AGCCTGTAATC", ("GATTACAGGCT", "AGCCTGTAATC", "Inversion", 0)), ("GATTACAGGC", "GCCTGTAATC", ("ATTACAGG", "CCTGTAAT", "Complex", 0)), ("AAAA", "AAAA", ("", "", "Reference", 0))],
)
def test_trim_and_type(spark, ref, alt, expected):
    row = one(alleles.allele_type(spark.createDataFrame([(ref, alt)], "ref string, alt string")))
    assert (row["trimmed_ref"], row["trimmed_alt"], row["type"], row["sv_length"]) == expected


def test_inversion(spark):
    ref = "ACCGTTAGGCA"
    rc = ref.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    df = spark.createDataFrame([(rc, ref), (rc[:5], ref[:5]), (ref, ref)], "a string, b string")
    assert [r[0] for r in df.select(alleles.is_inversion("a", "b")).collect()] == [True, False, False]


def test_genotypes(spark):
    df = spark.createDataFrame([("0/1",), ("1|.",), (".",), ("",), ("2",)], "g string")
    got = [tuple(r) for r in df.select(*(c.alias(n) for n, c in genotypes.parse("g").items())).collect()]
    assert got == [([0, 1], False, 2, "Complete"), ([1, None], True, 2, "Partial"), ([None], True, 1, "Missing"), ([], True, 0, "Complete"), ([2], True, 1, "Complete")]
    pairs = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (0, 2), (3, 1)], "a int, b int").withColumn("g", genotypes.genotype_index("a", "b"))
    low, high = genotypes.genotype_pair("g")
    assert [tuple(r) for r in pairs.select("g", low, high).collect()] == [(0, 0, 0), (1, 0, 1), (2, 1, 1), (3, 0, 2), (7, 1, 3)]
    best = spark.createDataFrame([([0.5, 0.5, 0.0],), ([0.1, 0.9, 0.0],), ([0.1, None],), ([],)], "p array<double>")
    assert [r[0] for r in best.select(genotypes.best_genotype("p")).collect()] == [None, 1, None, None]
    q = spark.createDataFrame([(1.0,), (0.99,), (0.0,)], "p double").select(F.round(genotypes.phred(F.col("p")), 6))
    assert [r[0] for r in q.collect()] == [99.0, 20.0, 0.0]
    share = one(spark.range(1).select(genotypes.least_observed_share(F.lit(15.0))))[0]
    assert abs(share - 0.98383) < 1e-4
    assert abs(one(spark.range(1).select(genotypes.log_add(F.lit(-1000.0), F.lit(-1000.0))))[0] - (-1000 + np.log(2))) < 1e-9
    kept = one(spark.createDataFrame([([0, 2, 1, None],)], "gt array<int>").select(alleles.remove_alleles("gt", F.array(F.lit(2))).alias("x"), alleles.remove_alleles("gt", F.array(F.lit(2)), True).alias("y")))
    assert (kept["x"], kept["y"]) == ([0, 1, None, None], [0, 1, 0, None])


def ivl(spark, rows):
    return spark.createDataFrame(rows, "contig string, pos int, end_pos int")


def test_intervals(spark):
    rows = [("c", 100, 100), ("c", 154, 154), ("c", 209, 209)]
    assert [r["group_no"] for r in intervals.groups(ivl(spark, rows), 55).orderBy("pos").collect()] == [0, 0, 1]
    cover = intervals.covered(ivl(spark, [("c", 1, 10), ("c", 5, 12), ("c", 20, 21)]))
    assert one(cover)["covered"] == 14
    nested = intervals.nearest_enclosing(ivl(spark, [("c", 100, 400), ("c", 90, 500), ("c", 250, 250), ("d", 250, 250)])).orderBy("pos").collect()
    assert [(r["pos"], r["outer_pos"]) for r in nested] == [(100, 90), (250, 100)]
    told = intervals.dependency(ivl(spark, [("c", 100, 400), ("c", 250, 250), ("c", 401, 401)])).orderBy("pos").collect()
    assert [r["has_dependency"] for r in told] == [False, True, False]
    gaps = intervals.complement(ivl(spark, [("c", 5, 10)]), spark.createDataFrame([("c", 1, 20), ("e", 1, 9)], "contig string, first int, last int"), 2)
    assert sorted((r["contig"], r["start"], r["end"]) for r in gaps.collect()) == [("c", 1, 4), ("c", 11, 20), ("e", 1, 9)]
    empty = ivl(spark, [])
    assert intervals.groups(empty, 5).count() == intervals.covered(empty).count() == intervals.nearest_enclosing(empty).count() == 0
    clusters = intervals.cluster_components(ivl(spark, [("c", 1, 1), ("c", 3, 3), ("c", 5, 5), ("c", 40, 40)]), 3).orderBy("pos").collect()
    assert [r["cluster"] for r in clusters] == [1, 1, 1, 40]


def test_tiles_and_units(spark):
    rows = [("c", 3, 9), ("c", 4, 5), ("c", 7, 8), ("c", 10, 10), ("c", 30, 31), ("d", 8, 8)]
    lengths = spark.createDataFrame([("c", 50), ("d", 20), ("e", 5)], "contig string, length int")
    tiles = intervals.genomic_bins(ivl(spark, rows), lengths, 2).orderBy("contig", "start").collect()
    # 3-9 holds three, 10 begins a tile although it touches, which then takes 30 for its second
    assert [tuple(r) for r in tiles] == [("c", 0, 8), ("c", 9, 49), ("d", 0, 19)]
    assert [tuple(r) for r in intervals.genomic_bins(ivl(spark, rows), lengths, 1).where("contig = 'c'").orderBy("start").collect()] == [("c", 0, 8), ("c", 9, 28), ("c", 29, 49)]
    extents = lambda sizes: spark.createDataFrame([("c", i, 10 * i, 10 * i + 5, n) for i, n in enumerate(sizes)], "contig string, group_no int, start int, end int, n_variants long")
    units = lambda sizes, least: [r["unit"] for r in intervals.units(extents(sizes), least).orderBy("group_no").collect()]
    assert units([9, 9, 9, 9], 12) == [0, 0, 1, 1]  # three units of twelve are asked for, but each counts from 0
    assert units([30, 1, 1, 1, 30], 20) == [0, 1, 1, 1, 1] and units([1, 1], 100) == [0, 0] and units([], 5) == []


def test_overlapping_runs_cross_bins(spark):
    """Intervals that reach over many bins of places, against a plain loop."""
    draw = random.Random(8)
    rows = sorted({("c", a := draw.randrange(1_000_000), a + draw.choice([0, 3, 5000, 200_000])) for _ in range(300)})
    last, group, groups, before = None, -1, [], []
    for _, a, b in rows:
        before.append(last)
        group += last is None or a - last >= 40
        groups.append(group)
        last = b if last is None else max(last, b)
    df = ivl(spark, rows)
    got = intervals.groups(df, 40).orderBy("pos", "end_pos").collect()
    assert [r["group_no"] for r in got] == groups
    covered, end = 0, -1
    for _, a, b in rows:
        covered += max(0, b - max(a - 1, end))
        end = max(end, b)
    assert one(intervals.covered(df))["covered"] == covered
    clear, reach = [], -1
    for _, a, b in rows:
        clear.append(reach < a)
        reach = b if reach < a else reach
    assert [r["clear"] for r in intervals.clear_of_earlier(df).orderBy("pos", "end_pos").collect()] == clear
    nearest = {}
    for _, a, b in rows:
        around = [(d - c, c, d) for _, c, d in rows if c < a and b < d]
        if around:
            nearest[a, b] = min(around)[1:]
    assert {(r["pos"], r["end_pos"]): (r["outer_pos"], r["outer_end"]) for r in intervals.nearest_enclosing(df).collect()} == nearest


def test_combine_and_filters(spark):
    calls = spark.createDataFrame([("c", 5, "x", "A", "T"), ("c", 5, "y", "AC", "A"), ("c", 5, "y", "A", "T"), ("c", 5, "z", "A", "*"), ("c", 9, "x", "G", "<DEL>")], "chrom string, pos int, callset string, ref string, alt string")
    got = {(r["ref"], r["alt"]): r["aco"] for r in callsets.combine(calls).collect()}
    assert got == {("AC", "TC"): "x:y", ("AC", "A"): "y"}
    assert callsets.origin_filter(callsets.combine(calls), ["y"]).count() == 1
    symbolic = spark.createDataFrame(
        [("A", "<DEL>", "CGT", None), ("A", "<DUP>", "CGT", None), ("A", "<INV>", "CGG", None), ("A", "<CN0>", "CG", None), ("A", "<CN3>", "CG", None), ("A", "<INS>", "", "TT"), ("A", "<XYZ>", "C", None)], "ref string, alt string, segment string, insert string"
    )
    assert [r["new_alt"] for r in callsets.expand_symbolic(symbolic).collect()] == ["A", "ACGTCGT", "ACCG", "A", "ACGCGCG", "ATT", None]
    genome = spark.createDataFrame([("c", "GGACGTACGTTCCC")], "id string, seq string")
    rows = [(3, "ACGTACGT", "A"), (3, "A", "ACGTACG"), (3, "A", "AGGGGGG"), (3, "A", "C"), (3, "ACGTACGT", "ACGTACGG"), (9, "GTTCC", "GGGAA"), (9, "GTTCC", "GGAAC"), (10, "TTCCC", "GGGAA"), (3, "ACGT", "A")]
    back = callsets.to_symbolic(spark.createDataFrame([("c", *r) for r in rows], "chrom string, pos int, ref string, alt string"), genome, 4)
    got = sorted((r["pos"], r["ref"], r["alt"], r["end"]) for r in back.collect())
    assert got == [(3, "A", "<DEL>", 10), (3, "A", "<DUP>", 9), (9, "G", "<INV>", 13), (9, "G", "<INV>", 14)]


def test_convert_alleles(spark):
    genome = spark.createDataFrame([("c", "GGACGTACGTTCCC")], "id string, seq string")
    rows = [(1, 3, "A", ["<DEL>", "G"], {"END": "6"}), (2, 3, "A", ["<CNV>"], {"END": "5", "GSCNDIST": "1,5,0,2"}), (3, 3, "N", ["<INV>"], {"END": "7"}), (4, 3, "T", ["G"], {}), (5, 3, "A", ["<DUP>"], {"END": "3"}), (6, 3, "A", ["<DUP>", "*"], {"END": "5", "IMPRECISE": ""}), (7, 3, "A", ["<CN2>", "<TRA>", "<CN1>"], {"END": "4"}), (8, 3, "A", ["<INS:ME:ALU>"], {"MEINFO": "AluY,0,0,+"})]
    df = spark.createDataFrame([(i, "c", p, r, a, x) for i, p, r, a, x in rows], "id int, chrom string, pos int, ref string, alts array<string>, info map<string, string>")
    elements = spark.createDataFrame([("ALU", "GGTA")], "id string, seq string")
    got = {r["id"]: (r["pos"], r["ref"], r["alts"]) for r in callsets.convert_alleles(df, genome, elements=elements).collect()}
    assert got == {1: (3, "ACGT", ["A", "GCGT"]), 2: (3, "ACG", ["A", "ACGCGCG"]), 3: (4, "CGTA", ["TACG"]), 7: (3, "AC", ["ACC"])}
    assert {r["id"] for r in callsets.convert_alleles(df, genome, imprecise=True).collect()} == {1, 2, 3, 6, 7}


def test_concordance(spark):
    kinds = "id int, chrom string, pos int, sample string, ref string, alts array<string>, genotype array<int>"
    truth = spark.createDataFrame([(1, "c", 5, "s", "AC", ["GC"], [0, 1]), (2, "c", 6, "s", "A", ["G"], [1, 1]), (3, "c", 7, "s", "A", ["G"], []), (4, "c", 8, "s", "A", ["G"], [0, 1]), (5, "c", 9, "s", "A", ["G"], [None, None]), (6, "c", 10, "s", "A", ["G"], [0, 1]), (7, "c", 11, "s", "A", ["G"], [1])], kinds)
    calls = spark.createDataFrame([(1, "c", 5, "s", "A", ["G"], [1, 0]), (2, "c", 6, "s", "A", ["T", "G"], [0, 2]), (3, "c", 7, "s", "A", ["G"], [None]), (4, "c", 8, "s", "A", ["G"], [1]), (6, "c", 10, "s", "A", ["T"], [1, 1]), (8, "c", 10, "s", "A", ["G"], [0, 0]), (7, "c", 11, "s", "A", ["G"], [1]), (9, "d", 1, "s", "A", ["G"], [0, 0])], kinds)
    got = {(r["side"], r["id"]): r["gtco"] for r in genotyping.concordance(truth, calls).collect()}
    assert got == {("truth", 1): "T", ("call", 1): "T", ("truth", 2): "P", ("call", 2): "P", ("truth", 3): "I", ("call", 3): "I", ("truth", 4): "F", ("call", 4): "F", ("truth", 5): "I", ("truth", 6): "P", ("call", 6): "F", ("call", 8): "P", ("truth", 7): "T", ("call", 7): "T", ("call", 9): "T"}


def test_transmission(spark):
    letters = spark.createDataFrame([("c", 1, 100, s, a, b) for s, a, b in [("f", "A", "B"), ("m", "C", "D"), ("k", "A", "C"), ("y", "B", None)]], "chrom string, start int, end int, sample string, first string, second string")
    told = spark.createDataFrame([(1, "c", 10, 12, 2), (2, "c", 10, 12, 2), (3, "c", 10, 12, 3), (4, "c", 95, 105, 2), (5, "d", 10, 10, 2), (6, "c", 50, 50, 2), (7, "c", 60, 60, 2)], "variant_id int, chrom string, pos int, end_pos int, n_alleles int")
    calls = [(1, "f", [0, 1]), (1, "m", [0, 0]), (1, "k", [1, 0]), (2, "f", [0, 1]), (2, "m", [0, 0]), (2, "k", [1, 1]), (3, "k", [0, 2]), (6, "y", [0, 1]), (7, "f", [0, 1]), (7, "y", [1])]
    got = {r["variant_id"]: (r["n_ways"], r["htv"]) for r in genotyping.transmission(told, spark.createDataFrame(calls, "variant_id int, sample string, genotype array<int>"), letters).collect()}
    # 3: two ways for A and C, three each for B and D; 6: two alleles called of one haplotype; 7: A and B are settled, C and D free
    assert got == {1: (1, "TRUE"), 2: (0, "FALSE"), 3: (18, "MULTI-TRUE"), 4: (None, "NA"), 5: (None, "NA"), 6: (0, "FALSE"), 7: (4, "MULTI-TRUE")}


def test_annotate_needs_the_place_for_single_bases(spark):
    q = spark.createDataFrame([(1, "c", 10, "A", "T"), (2, "c", 50, "A", "ACGTACGT")], "variant_id int, chrom string, pos int, ref string, alt string")
    a = spark.createDataFrame([("s", "c", 10, "A", "T"), ("t", "c", 11, "A", "T"), ("u", "c", 52, "A", "ACGTACGA"), ("v", "c", 52, "A", "AC")], "annotation_id string, chrom string, pos int, ref string, alt string")
    assert {tuple(r) for r in callsets.annotate(q, a).collect()} == {(1, "s"), (2, "u")}


def test_statistics(spark):
    calls = spark.createDataFrame([(1, 0, 0, 0), (1, 1, 0, 1), (1, 2, 1, 1), (1, 3, 0, 1)], "variant_id int, sample int, a int, b int").withColumns({"app": F.lit(1.0), "nak": F.lit(5), "fak": F.lit(1.0), "missing": F.lit(0)})
    assert one(genotyping.inbreeding(calls))["ibc"] == 0
    assert one(genotyping.inbreeding(calls, F.col("sample") < 3))["n_samples"] == 3


def test_trios(spark):
    """father, mother, child, n_alleles, open: what is told."""
    cases = {
        1: ([0, 0], [0, 0], [0, 1], 2, False, {"de_novo", "diploid", "informative"}, 0, 1), 2: ([0, 1], [0, 1], [1, 1], 2, False, {"concordant", "simple_heterozygote", "diploid", "informative"}, None, None), 3: ([0, 0], [0, 0], [0, 0], 3, False, {"concordant", "reference_call", "diploid", "informative"}, None, None),
        4: ([0, None], [0, 0], [0, 0], 2, False, {"filtered", "diploid", "informative"}, None, None), 5: ([0, 0], [0, 0], [0, 2], 3, True, {"diploid", "informative"}, None, None), 6: ([1], [0, 0], [1], 2, False, {"informative"}, None, None), 7: ([0], [0, 0], [], 2, False, {"reference_call"}, None, None),
        8: ([1, 1], [0, 0], [1, 2], 3, False, {"de_novo", "diploid", "informative"}, 1, 2), 9: ([0, 1], [0, 1], [0, 1], 3, False, {"concordant", "diploid", "informative"}, None, None),
    }
    calls = [(i, s, len(g), g, c[3], c[4]) for i, c in cases.items() for s, g in zip("fmk", c[:3], strict=True)]
    df = spark.createDataFrame(calls, "variant_id int, sample string, ploidy int, genotype array<int>, n_alleles int, open boolean")
    told = ("filtered", "diploid", "informative", "concordant", "simple_heterozygote", "reference_call", "de_novo")
    got = {r["variant_id"]: ({c for c in told if r[c]}, r["ancestral"], r["new"]) for r in genotyping.trios(df, spark.createDataFrame([(0, "f", "m", "k")], "family int, father string, mother string, child string")).collect()}
    assert got == {i: c[5:] for i, c in cases.items()}
    assert one(tools.concordance_attribute(df.where("variant_id = 6"), spark.createDataFrame([(0, "f", "m", "k")], "family int, father string, mother string, child string")))["conc"] == "0/1"


RICH = "variant_id int, sample string, ploidy int, gpp array<double>, app array<double>, nak array<double>, fak array<double>, mac array<double>"


def test_allele_filters_and_estimates(spark):
    """One sample a case: sure, too few k-mers, k-mers unseen, both, a filtered allele that no posterior speaks for, a tie, not
    sure enough, one copy, none; comparisons allow a little."""
    few, dark = [5.0, 0.5], [0.99, 0.1]
    cases = {
        "sure": (2, [0.0, 1.0, 0.0], [1.0, 1.0], [5.0, 5.0], [0.99, 0.99], [0, 0], [0, 1], 99), "few": (2, [0.0, 1.0, 0.0], [1.0, 1.0], few, [0.99, 0.99], [0, 1], [None, None], 99), "dark": (2, [0.0, 1.0, 0.0], [1.0, 1.0], [5.0, 5.0], dark, [0, 2], [None, None], 99),
        "both": (2, [0.0, 1.0, 0.0], [1.0, 1.0], few, dark, [0, 3], [None, None], 99), "none spoken for": (2, [1.0, 0.0, 0.0], [1.0, 0.0], few, dark, [0, 0], [0, 0], 99), "no k-mer": (2, [1.0, 0.0, 0.0], [1.0, 0.0], [0.0, 0.0], [-1.0, -1.0], [1, 0], [None, None], 99),
        "tie": (2, [0.5, 0.5, 0.0], [1.0, 0.5], [5.0, 5.0], [0.99, 0.99], [0, 0], [None, None], 3), "unsure": (2, [0.1, 0.9, 0.0], [1.0, 0.9], [5.0, 5.0], [0.99, 0.99], [0, 0], [None, None], 10), "nearly": (2, [0.01, 0.9899999, 0.0], [1.0, 0.99], [0.9999999, 5.0], [0.99, 0.99], [0, 0], [0, 1], 19),
        "one copy": (1, [0.0, 1.0], [0.0, 1.0], [5.0, 5.0], [0.99, 0.99], [0, 0], [1], 99), "no copy": (0, [], [], [], [], [], [], None),
    }
    calls = spark.createDataFrame([(1, n, p, g, a, k, f, f) for n, (p, g, a, k, f, *_) in cases.items()], RICH)
    own = calling.estimate(calls, least_share="0.5D")
    got = {r["sample"]: (r["saf"], r["genotype"], r["gq"]) for r in own.collect()}
    assert got == {n: tuple(c[5:]) for n, c in cases.items()}
    stats = one(calling.statistics(own))
    assert (stats["an"], stats["ac"], stats["af"], stats["acp"], stats["qual"], stats["filter"]) == (7, [3], [3 / 7], [1.0, 1.0], 99.0, "PASS")
    assert one(calling.statistics(own, samples="tie|unsure"))["filter"] == "AN0" and one(calling.statistics(own, samples="no copy"))["an"] == 0
    told = one(calling.filtered(calls, 9, least_share="0.5D"))
    assert (told["n_homozygotes"], told["filter"], told["an"]) == (4, "HOM", 7)
    assert one(calling.filtered(calls.where("sample = 'tie'"), 1, least_share="0.5D"))["filter"] == "AN0;HOM"
    texts = {r["sample"]: r[1] for r in own.select("sample", calling.sample_field()).collect()}
    assert texts["sure"] == "0/1:99:0,1,0:1,1:5,5:0.99,0.99:0.99,0.99:0,0" and texts["no copy"] == ":.:.:.:.:.:." and texts["tie"].startswith("./.:3:")


def test_genotyped_vcf_round_trip(spark, tmp_path):
    calls = calling.estimate(spark.createDataFrame([(1, "a", 2, [0.0, 0.0, 0.0, 1.0, 0.0, 0.0], [1.0, 0.0, 1.0], [5.0] * 3, [0.9] * 3, [12.5] * 3), (1, "b", 2, [0.0, 1.0, 0.0, 0.0, 0.0, 0.0], [1.0, 1.0, 0.0], [5.0] * 3, [0.9] * 3, [1e-5] * 3)], RICH), least_share="0.5D")
    sites = spark.createDataFrame([(1, 0, "c", 7, "rs1", "AC", ["A", "*"], 2, "c:7-8", 1, "c:7-8", 3, [2], ["x:y", None])], "variant_id int, contig_idx int, chrom string, pos int, id string, ref string, alts array<string>, vcs int, vcr string, vcgs int, vcgr string, hc int, anc array<int>, aco array<string>")
    head = calling.header([("c", 100)], ["a", "b"], "/g.fa", ["##options=k:5"])
    vcf.write(calling.genotyped(sites, calls, ["a", "b"]), head, str(tmp_path / "out"))
    again = vcf.read_header(spark, str(tmp_path / "out"))
    assert again.samples == ["a", "b"] and again.contigs() == ["c"] and again.other == head.other
    assert set(again.declared["INFO"]) == {i for i, *_ in calling.INFO} and set(again.declared["FORMAT"]) == {i for i, *_ in calling.FORMAT} and set(again.declared["FILTER"]) == {"AN0"}
    row = one(vcf.read_variants(spark, str(tmp_path / "out"), again))
    assert row["info"] == {"AC": "1,1", "AF": "0.25,0.25", "AN": "4", "ACP": "1,1,1", "VCS": "2", "VCR": "c:7-8", "VCGS": "1", "VCGR": "c:7-8", "HC": "3", "ANC": "2", "ACO": "x:y,."} and row["qual"] == 99 and row["filters"] == ["PASS"]
    fields = {r["sample"]: r["fields"] for r in vcf.explode_calls(vcf.read_variants(spark, str(tmp_path / "out"), again), again).collect()}
    assert fields["a"]["GT"] == "0/2" and fields["b"]["MAC"] == "1e-05,1e-05,1e-05" and fields["b"]["SAF"] == "0,0,0"


def test_nested_and_diplotypes(spark):
    rows = [(1, 10, 1, 11, True, False), (1, 15, 2, 1, True, False), (1, 21, 1, 1, True, False), (2, 15, 2, 1, True, False), (3, 10, 0, 1, True, False), (3, 10, 1, 5, True, False), (4, 10, 1, 5, False, False), (4, 12, 2, 1, False, True), (4, 13, 1, 1, False, False)]
    calls = spark.createDataFrame([("c", s, 0, p, a, n, x, m) for s, p, a, n, x, m in rows], "chrom string, sample int, hap int, pos int, allele int, span int, phased boolean, missing boolean")
    got = sorted((r["sample"], r["pos"], r["span"], r["allele"]) for r in genotyping.nested_genotypes(calls).collect())
    # 3: the reference base at 10 comes first and covers the other row there; 4: only `*` goes where nothing is phased
    assert got == [(1, 10, 11, 1), (1, 15, 1, 0), (1, 21, 1, 1), (2, 15, 1, 2), (3, 10, 1, 0), (3, 10, 5, 0), (4, 10, 5, 1), (4, 12, 1, 0), (4, 13, 1, 1)]
    refs = spark.createDataFrame([("c", "AACCGGTT")], "id string, seq string")
    edits = spark.createDataFrame([("c", 1, 0, 2, "CC", "T"), ("c", 1, 0, 3, "C", "G"), ("c", 1, 0, 6, "T", "TAA"), ("c", 1, 1, 0, "A", "G"), ("c", 1, 1, 7, "T", "")], "chrom string, sample int, hap int, pos int, ref string, alt string")
    assert {r["hap"]: r["seq"] for r in tools.diplotypes(edits, refs).collect()} == {0: "AATGGTAAT", 1: "GACCGGT"}


def test_copy_numbers_have_no_cap(spark):
    told = {"<CN1>": "ACG", "<CN10>": "A" + "CG" * 10, "<CN11>": "A" + "CG" * 11, "<CN12>": "A" + "CG" * 12, "<CN250>": "A" + "CG" * 250, "<CN1073741824>": None, "<CN99999999999>": None, "<CNx>": None}
    rows = spark.createDataFrame([("A", alt, "CG", None) for alt in told], "ref string, alt string, segment string, insert string")
    assert {r["alt"]: r["new_alt"] for r in callsets.expand_symbolic(rows).collect()} == told
    assert callsets.expand_symbolic(rows.limit(1).withColumns({"alt": F.lit("<CN99>"), "segment": F.lit("")})).first()["new_alt"] == "A"
    assert callsets.expand_symbolic(rows.limit(1).withColumns({"alt": F.lit("<CN99>"), "segment": F.lit(None).cast("string")})).first()["new_alt"] is None


def test_graph_spells_every_haplotype():
    draw = random.Random(3)
    reference = "".join(draw.choices("ACGT", k=60))
    variants = [(20, reference[20], ["A" if reference[20] != "A" else "C"]), (25, reference[25:28], [reference[25]]), (30, reference[30], [reference[30] + "GG"])]
    vertices = graph.build(variants, reference, 0, 5)
    found = graph.find_paths(vertices, set(), 5, most=100)
    expected = set()
    for mask in range(8):
        seq, at = "", 16
        for i, (pos, ref, alts) in enumerate(variants):
            if mask >> i & 1:
                seq, at = seq + reference[at:pos] + alts[0], pos + len(ref)
        expected.add(seq + reference[at:35])
    assert {p.seq for p in found} == expected
    truth = sorted(expected)[3]
    best = graph.find_paths(vertices, set(graph.canonical_kmers(truth, 5)), 5, most=1)
    assert best[0].seq == truth and best[0].score == 1


def test_graph_overlapping_variants_exclude_each_other():
    reference = "ACGTTGCATCAGGATTACCA"
    found = graph.find_paths(graph.build([(5, reference[5:12], [reference[5]]), (8, reference[8], ["G"])], reference, 0, 4), set(), 4, most=50)
    assert sorted(p.alleles for p in found) == [(), ((0, 1),), ((1, 1),)]


def test_haplotypes_end_to_end(spark):
    reference = "ACGTTGCATCAGGATTACCAGT"
    observed = graph.canonical_kmers(reference[:8] + "G" + reference[9:], 4)
    clusters = spark.createDataFrame([(1, [(8, reference[8], ["G"])], reference, 0, observed)], "cluster int, variants array<struct<pos: int, ref: string, alts: array<string>>>, reference string, first int, kmers array<string>")
    haps = graph.haplotypes(clusters, 4)
    rows = {tuple(r["alleles"]): r["seq"] for r in haps.collect()}
    assert rows == {(0,): reference[5:12], (1,): reference[5:8] + "G" + reference[9:12]}
    assert graph.haplotype_kmers(haps, 4).groupBy("hap").agg(F.sum("mult")).count() == 2
    assert graph.uncovered_alleles(spark.createDataFrame([(1, 0, 3)], "cluster int, variant int, n_alleles int"), haps).collect()[0]["allele"] == 2


def test_copy_number_and_spelled_alleles():
    unit = "ACGTTGCATC"
    assert graph.copy_number_extension(unit, unit * 2 + "T" * 20, 4) >= 20
    assert graph.copy_number_extension(unit, "T" * 30, 4) == 0 and graph.copy_number_extension("ACG", unit, 4) == 0
    reference = "AACCGGTTAACC"
    others = [(2, "C", ["T"]), (4, "G", ["A"])]
    assert graph.spelled_by_others("CCG", "TCA", 2, others, reference, 0) == [(0, 1), (1, 1)]
    assert graph.spelled_by_others("CCG", "TCC", 2, others, reference, 0) is None


def test_gibbs_agrees_with_the_exact_posterior(spark):
    model = inference.CountModel(p=0.5, size=10.0, rate=0.05)
    haps = spark.createDataFrame([(1, h, f"k{i}", 1) for h in range(2) for i in range(6) if i % 2 == h or i > 3], "cluster int, hap int, kmer string, mult int")
    counts = spark.createDataFrame([("a", f"k{i}", n) for i, n in enumerate([4, 3, 5, 4, 8, 9])] + [("b", f"k{i}", n) for i, n in enumerate([9, 0, 8, 1, 9, 8])], "sample string, kmer string, n int")
    people = counts.select("sample").distinct()
    exact = {(r["sample"], r["hap1"], r["hap2"]): r["posterior"] for r in inference.exact_posterior(haps, counts, people, model).collect()}
    drawn = {(r["sample"], r["hap1"], r["hap2"]): r["posterior"] for r in inference.gibbs_posterior(haps, counts, people, model, 50, 4000, sparse=False).collect()}
    assert exact.keys() == drawn.keys()
    assert all(abs(exact[k] - drawn[k]) < 0.04 for k in exact)
    assert abs(sum(v for k, v in exact.items() if k[0] == "a") - 1) < 1e-9
    f = inference.sparse_frequencies(np.random.default_rng(1), np.array([5, 0, 0, 3]), 0.5)
    assert abs(f.sum() - 1) < 1e-9 and f[0] > 0 and f[3] > 0


def test_noise_rate_follows_the_gamma_posterior(spark):
    hist = spark.createDataFrame([("s", 0, 60), ("s", 1, 30), ("s", 2, 10)], "sample string, n int, n_kmers int")
    rate = one(inference.noise_rates(inference.noise_trace(hist, chains=4, iterations=600)))["rate"]
    assert abs(rate - 51 * 0.005) < 0.02


VCF = """##fileformat=VCFv4.2
##INFO=<ID=ACO,Number=A,Type=String,Description="origin, of an allele">
##INFO=<ID=FL,Number=0,Type=Flag,Description="flag">
##FORMAT=<ID=GT,Number=1,Type=String,Description="genotype">
##contig=<ID=c1,length=100>
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts2\ts1
c1\t5\trs1\tA\tT,AC\t9.5\tPASS\tACO=x:y,z;FL\tGT:GQ\t0/1:9\t1|.:7
c1\t9\t.\tG\t*\t.\t.\tXX=1\tGT\t.\t2/2
"""


def test_vcf_round_trip(spark, tmp_path):
    (tmp_path / "in.vcf").write_text(VCF)
    path = str(tmp_path / "in.vcf")
    header = vcf.read_header(spark, path)
    assert header.samples == ["s2", "s1"] and header.contigs() == ["c1"] and header.declared["INFO"]["ACO"]["Description"] == "origin, of an allele"
    variants = vcf.read_variants(spark, path, header)
    first, second = variants.orderBy("pos").collect()
    assert first["alts"] == ["T", "AC"] and first["info"] == {"ACO": "x:y,z", "FL": ""} and first["filters"] == ["PASS"] and first["qual"] == 9.5
    assert second["info"] == {} and second["ids"] == [] and second["qual"] is None
    own = vcf.explode_alleles(variants, ("ACO",)).orderBy("pos", "alt_idx").collect()
    assert [(r["alt"], r["aco"]) for r in own] == [("T", "x:y"), ("AC", "z"), ("*", None)]
    calls = {(r["pos"], r["sample"]): (r["gt"], r["status"], r["fields"].get("GQ")) for r in vcf.explode_calls(variants, header).collect()}
    assert calls == {(5, "s2"): ([0, 1], "Complete", "9"), (5, "s1"): ([1, None], "Partial", "7"), (9, "s2"): ([None], "Missing", None), (9, "s1"): ([2, 2], "Complete", None)}
    vcf.write(variants, header, str(tmp_path / "out"), gzip=True)
    again = vcf.read_variants(spark, str(tmp_path / "out"), vcf.read_header(spark, str(tmp_path / "out")))
    assert [tuple(r) for r in again.orderBy("pos").collect()] == [tuple(r) for r in variants.orderBy("pos").collect()]
    assert {r["why"] for r in vcf.check_order(variants.union(variants.limit(1)), {"c1": 8}).collect()} == {"contig", "repeated"}


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one first\nACGT\nnnac\n>two\nTTTTGGGGCCCC\n")
    records = fasta.read(spark, str(tmp_path / "a.fa"))
    assert {r["id"]: r["seq"] for r in records.collect()} == {"one": "ACGTNNAC", "two": "TTTTGGGGCCCC"}
    pieces = fasta.chunks(records, 5, 3)
    places = spark.createDataFrame([("two", i, 4) for i in range(9)] + [("none", 0, 2)], "chrom string, at int, n int")
    got = {(r["chrom"], r["at"]): r["bases"] for r in fasta.lookup(places, pieces, 5).collect()}
    assert got == {("two", i): "TTTTGGGGCCCC"[i : i + 4] for i in range(9)} | {("none", 0): None}
    assert one(fasta.to_lines(records.where("id = 'two'"), 5))["value"] == ">two\nTTTTG\nGGGCC\nCC"


def test_small_tables(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("a\tF\tpa\nb\tMale\tpb\n")
    assert [tuple(r) for r in tables.read_samples(spark, str(tmp_path / "s.tsv")).orderBy("sample").collect()] == [("a", True, "pa"), ("b", False, "pb")]
    (tmp_path / "bad.tsv").write_text("a\tX\tpa\n")
    with pytest.raises(Exception, match="unknown sex"):
        tables.read_samples(spark, str(tmp_path / "bad.tsv")).collect()
    (tmp_path / "k.tsv").write_text("ACG\t300\nCCC\t2\n")
    assert {r["kmer"]: r["n"] for r in tables.read_kmers(spark, str(tmp_path / "k.tsv")).collect()} == {"ACG": 255, "CCC": 2}
    (tmp_path / "r.out").write_text("  SW perc\nscore\n\n 1 2 3 4 c1_5_1 1 10 (0) + AluY SINE/Alu 1 2\n 1 2 3 4 c1_5_1 5 12 (0) + L1 LINE/L1 1 2\n")
    repeats = tables.read_repeats(spark, str(tmp_path / "r.out"))
    alts = spark.createDataFrame([("c1", 5, 1), ("c1", 5, 2)], "chrom string, pos int, alt_idx int")
    assert {r["alt_idx"]: r["rma"] for r in tools.repeat_attribute(alts, repeats).collect()} == {1: "All#12:LINE/L1#8:SINE/Alu#10", 2: None}
    tables.write_parameter_kmers(spark.createDataFrame([("ACG",), ("CCC",)], "kmer string"), str(tmp_path / "p"), 3, 10)
    assert tables.read_parameter_kmers(spark, str(tmp_path / "p"), 3).count() == 2
    assert tables.pedigree("f,m,c:x,y,z") == [(0, "f", "m", "c"), (1, "x", "y", "z")]
    assert tables.contig_order([["1", "3"], ["1", "2", "3"]]) == ["1", "2", "3"]
    with pytest.raises(ValueError):
        tables.contig_order([["1", "2"], ["2", "1"]])
    (tmp_path / "t.tsv").write_text("#chrom\tstart\tend\ts1\ts2\nc\t1\t9\tAB\tC\n")
    assert sorted(tuple(r)[3:] for r in tables.read_transmission(spark, str(tmp_path / "t.tsv")).collect()) == [("s1", "A", "B"), ("s2", "C", None)]


def test_redundant_alleles_pass_their_origins_on(spark):
    genome = spark.createDataFrame([("c", "AACCGGTTAACC")], "id string, seq string")
    calls = spark.createDataFrame([("c", 3, "C", "T", "x"), ("c", 5, "G", "A", "y"), ("c", 3, "CCG", "TCA", "z"), ("c", 9, "A", "T", "x")], "chrom string, pos int, ref string, alt string, aco string")
    got = {(r["pos"], r["alt"]): r["aco"] for r in callsets.resolve_redundant(calls, genome).collect()}
    assert got == {(3, "T"): "x:z", (5, "A"): "y:z", (9, "T"): "x"}


def test_joint_noise_finds_the_rate(spark):
    rng = np.random.default_rng(2)
    model = inference.CountModel(p=0.5, size=12.0, rate=0.05)
    haps, counts = [], []
    for c in range(12):
        for h in range(2):
            haps += [(c, h, f"k{c}-{h}-{i}", 1) for i in range(25)]
        taken = c % 2
        counts += [("s", f"k{c}-{h}-{i}", int(rng.poisson(24 if h == taken else 0.4))) for h in range(2) for i in range(25)]
    haps = spark.createDataFrame(haps, "cluster int, hap int, kmer string, mult int")
    counts = spark.createDataFrame(counts, "sample string, kmer string, n int").where("n > 0")
    terms = inference.diplotype_terms(haps, counts, counts.select("sample").distinct(), model)
    rate = one(inference.noise_rates(inference.joint_noise(terms, chains=2, burn_in=50, draws=150, shape=1.0, scale=1.0), 50))["rate"]
    assert 0.25 < rate < 0.55
    sizes = spark.createDataFrame([(c, 1 + c % 3) for c in range(12)], "cluster int, n_variants int")
    for want in (1, 5, 11, 100):
        batch = inference.drawn_batch(sizes, want, 1).join(sizes, "cluster").collect()
        held = sum(r["n_variants"] for r in batch)
        assert len({r["cluster"] for r in batch}) == len(batch) and (held == 24 if want == 100 else want <= held < want + 3)
    drawn = inference.subsample_kmers(haps.withColumn("variants", F.array(F.lit(0))), 0.5, 4, 1)
    assert drawn.groupBy("cluster", "hap").agg(F.countDistinct("kmer").alias("n")).where("n > 4").count() == 0 and drawn.count() > 50


def test_vcf_pruning_and_small_predicates(spark, tmp_path):
    (tmp_path / "in.vcf").write_text(VCF.replace("FL\tGT:GQ", "FL;IMPRECISE\tGT:GQ").replace("##INFO=<ID=FL", '##INFO=<ID=IMPRECISE,Number=0,Type=Flag,Description="x">\n##INFO=<ID=FL'))
    variants = vcf.read_variants(spark, str(tmp_path / "in.vcf"))
    assert [r["pos"] for r in vcf.precise(variants).collect()] == [9]
    kept = vcf.keep_declared(variants, ["FL"], []).orderBy("pos").first()
    assert kept["info"] == {"FL": ""} and kept["filters"] == []
    alts = variants.orderBy("pos").select(alleles.without_trailing_missing("alts")).collect()
    assert [r[0] for r in alts] == [["T", "AC"], []]
    df = spark.createDataFrame([("", "AA", "A"), ("A", "AAAAA", "A"), ("", "AT", "A")], "r string, a string, base string")
    assert [r[0] for r in df.select(alleles.is_homopolymer_change("r", "a", "base", 3)).collect()] == [True, False, False]


def test_copy_number_extension_of_columns(spark):
    unit = "ACGTTGCATC"
    rows = spark.createDataFrame([(unit, unit * 2 + "T" * 20), (unit, "T" * 30), ("ACG", unit), (unit, None), (None, unit)], "allele string, after string")
    got = [r[0] for r in rows.select(graph.extension("allele", "after", 4)).collect()]
    assert got == [graph.copy_number_extension(a or "", b or "", 4) for a, b in [(unit, unit * 2 + "T" * 20), (unit, "T" * 30), ("ACG", unit), (unit, None), (None, unit)]] and got[0] >= 20
    reached = ivl(spark, [("c", 1, 5), ("c", 20, 20), ("c", 40, 40)]).withColumn("copies_end", F.col("end_pos") + F.when(F.col("pos") == 1, 30).otherwise(0))
    assert [r["group_no"] for r in intervals.groups(reached, 10, end="copies_end").orderBy("pos").collect()] == [0, 0, 0]
    assert [r["group_no"] for r in intervals.groups(reached, 10).orderBy("pos").collect()] == [0, 1, 2]


def test_only_the_training_subpackage_may_be_missing(tmp_path):
    """The entry point imports without the subpackage, and doesn't hide a dependency that is missing."""
    import shutil
    import subprocess
    import sys

    root = __import__("pathlib").Path(__file__).resolve().parent.parent
    for name in ("strandline", "__spark_entry__.py", "corpus_pipeline.py"):
        source = root / name
        if source.exists():
            (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    told = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(sum(q.startswith('op') for q in e.queries()), len(e.queries()) > 50)"], cwd=tmp_path, capture_output=True, text=True)
    if (tmp_path / "strandline" / "llm").exists():
        assert told().stdout.split() == ["10", "True"]
        common = tmp_path / "strandline" / "llm" / "common.py"
        text = common.read_text()
        common.write_text(text + "\nimport no_such_module\n")
        assert "no_such_module" in told().stderr
        shutil.rmtree(tmp_path / "strandline" / "llm")
    assert told().stdout.split() == ["0", "True"]
    (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    assert told().stdout.split() == ["0", "True"]


def test_regions_of_a_text(spark):
    got = [tuple(r) for r in tables.regions(spark, "chr1:5-9,chr2,chr1:20-20").collect()]
    assert got == [("chr1", 5, 9), ("chr2", None, None), ("chr1", 20, 20)] and tables.regions(spark, "").count() == 0
    for bad in ("chr1,chr1:1-2", "chr1:1-2,chr1", "chr1:9-5", "chr1:x-5", "a:b:c"):
        with pytest.raises(ValueError):
            tables.regions(spark, bad)
