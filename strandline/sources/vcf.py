"""VCF text to the normal form and back: variants (a row a line), alleles (a row an alt), calls (a row a sample).

Lines are read as text, so an uncompressed file splits by block; a gzip file is one task, whose rows are dealt out again.
The header is read on the driver; it is bounded by the file's declarations, not by its rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.genotypes import parse, six_digits
from strandline.shared import first_lines

from . import fasta

FIXED = ("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info")
FIELD = re.compile(r'(\w+)=("(?:[^"\\]|\\.)*"|[^,]*)(?:,|$)')


@dataclass
class Header:
    """Declarations by kind (INFO, FILTER, FORMAT, contig: id -> attributes), other lines, sample ids in file order."""

    declared: dict[str, dict[str, dict[str, str]]] = field(default_factory=dict)
    other: list[str] = field(default_factory=list)
    samples: list[str] = field(default_factory=list)

    def contigs(self) -> list[str]:
        return list(self.declared.get("contig", {}))

    def lines(self) -> list[str]:
        def spelled(attributes: dict[str, str]) -> str:
            return ",".join(f'{k}="{v}"' if k == "Description" else f"{k}={v}" for k, v in attributes.items())

        body = [f"##{kind}=<{spelled(a)}>" for kind in ("INFO", "FILTER", "FORMAT", "contig") for a in self.declared.get(kind, {}).values()]
        columns = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", *(["FORMAT", *self.samples] if self.samples else [])]
        return [*self.other, *body, "\t".join(columns)]


def parse_header(lines: list[str]) -> Header:
    out = Header()
    for line in lines:
        if m := re.match(r"##(INFO|FILTER|FORMAT|contig)=<(.*)>$", line):
            attributes = {k: v[1:-1] if v.startswith('"') else v for k, v in FIELD.findall(m[2])}
            out.declared.setdefault(m[1], {})[attributes["ID"]] = attributes
        elif line.startswith("#CHROM"):
            out.samples = line.split("\t")[9:]
        elif line.startswith("##"):
            out.other.append(line)
    return out


def read_header(spark: SparkSession, path: str) -> Header:
    """The lines at the head that start with #; the rest of the file is not read."""
    return parse_header(first_lines(spark, path, "#"))


def read_variants(spark: SparkSession, path: str, header: Header | None = None, partitions: int | None = None) -> DataFrame:
    """contig_idx, chrom, pos, ids, ref, alts, qual, filters, info (map of the declared keys; a flag maps to ''), format
    (array), raw (array of the samples' texts, in file order). `.` is null or an empty array."""
    header = header or read_header(spark, path)
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.col("value") != ""))
    if path.endswith(".gz"):
        lines = lines.repartition(partitions or spark.sparkContext.defaultParallelism)
    c = F.split("value", "\t")
    listed = lambda i, sep: F.when(F.get(c, F.lit(i)) == ".", F.array().cast("array<string>")).otherwise(F.split(F.get(c, F.lit(i)), sep))
    info = F.when(F.get(c, F.lit(7)) == ".", F.create_map().cast("map<string,string>")).otherwise(F.map_from_entries(F.transform(F.split(F.get(c, F.lit(7)), ";"), lambda x: F.struct(F.split(x, "=", 2)[0].alias("k"), F.coalesce(F.get(F.split(x, "=", 2), F.lit(1)), F.lit("")).alias("v")))))
    known = list(header.declared.get("INFO", {}))
    out = lines.select(
        c[0].alias("chrom"), c[1].cast("int").alias("pos"), listed(2, ";").alias("ids"), F.upper(c[3]).alias("ref"), listed(4, ",").alias("alts"), F.when(c[5] != ".", c[5]).cast("double").alias("qual"),
        listed(6, ";").alias("filters"), info.alias("info"), F.when(F.size(c) > 8, F.split(F.get(c, F.lit(8)), ":")).alias("format"), F.when(F.size(c) > 9, F.slice(c, 10, F.size(c))).otherwise(F.array().cast("array<string>")).alias("raw"),
    )
    if known:
        out = out.withColumn("info", F.map_filter("info", lambda k, _: k.isin(known)))
    order = header.contigs()
    index = F.array_position(F.array(*map(F.lit, order)), F.col("chrom")) - 1 if order else F.lit(0)
    return out.select(index.cast("int").alias("contig_idx"), *out.columns)


def info_value(key: str) -> Column:
    return F.expr(f"try_element_at(info, '{key}')")


def explode_alleles(variants: DataFrame, per_allele: tuple[str, ...] = ()) -> DataFrame:
    """A row an alt: alt_idx (from 1), alt, and of each INFO key in per_allele (Number=A) the alt's own value."""
    own = variants.select("*", F.posexplode("alts").alias("_i", "alt")).withColumn("alt_idx", F.col("_i") + 1)
    for key in per_allele:
        own = own.withColumn(key.lower(), F.get(F.split(info_value(key), ","), F.col("_i")))
    return own.drop("_i")


def explode_calls(variants: DataFrame, header: Header) -> DataFrame:
    """A row a sample: sample, fields (map of the FORMAT keys), gt, phased, ploidy, status."""
    names = F.array(*map(F.lit, header.samples))
    own = variants.select("*", F.posexplode("raw").alias("_i", "_raw")).withColumn("sample", F.get(names, F.col("_i")))
    values = F.split("_raw", ":")
    own = own.withColumn("fields", F.map_from_arrays(F.slice("format", 1, F.size(values)), values)).withColumn("_gt", F.expr("try_element_at(fields, 'GT')"))
    return own.withColumns(parse("_gt")).drop("_i", "_raw", "_gt", "raw", "format")


def precise(variants: DataFrame) -> DataFrame:
    """Variants without the IMPRECISE flag."""
    return variants.where(~F.map_contains_key("info", "IMPRECISE"))


def keep_declared(variants: DataFrame, info: list[str], filters: list[str], formats: list[str] | None = None) -> DataFrame:
    """Only these INFO keys, FILTER labels and, if asked, FORMAT keys (with the samples' values) stay."""
    out = variants.withColumn("info", F.map_filter("info", lambda k, _: k.isin(info))).withColumn("filters", F.filter("filters", lambda x: x.isin(filters)))
    if formats is None:
        return out
    kept = F.filter(F.sequence(F.lit(0), F.size("format") - 1), lambda i: F.get("format", i).isin(formats))
    values = F.transform("raw", lambda r: F.array_join(F.array_compact(F.transform(F.col("_kept"), lambda i: F.get(F.split(r, ":"), i))), ":"))
    return out.withColumn("_kept", kept).withColumn("raw", values).withColumn("format", F.transform("_kept", lambda i: F.get("format", i))).drop("_kept")


def by_number(fields: str, key: str, number: str) -> Column:
    """A FORMAT value of a call by its declared Number: an array for A, R and G (the places of alts, alleles, genotypes; `.` is
    null), else the text."""
    value = F.try_element_at(F.col(fields), F.lit(key))
    return F.transform(F.split(value, ","), lambda x: F.when(x != ".", x)) if number in ("A", "R", "G") else F.when(value != ".", value)


def with_genome_reference(variants: DataFrame, genome: DataFrame) -> DataFrame:
    """variants whose REF is the genome's (id, seq) at their place; a REF of N takes the genome's base first."""
    pieces = fasta.chunks(genome, fasta.CHUNK, 0)
    found = fasta.lookup(variants.select("chrom", "pos").distinct().withColumns({"at": F.col("pos") - 1, "n": F.lit(1)}), pieces, fasta.CHUNK).select("chrom", "pos", F.col("bases").alias("_base"))
    named = variants.join(found, ["chrom", "pos"]).withColumn("ref", F.when(F.col("ref") == "N", F.col("_base")).otherwise(F.col("ref"))).drop("_base")
    places = named.select(F.struct("chrom", "pos", F.length("ref").alias("n")).alias("key")).distinct()
    spans = places.select("key", F.col("key.chrom").alias("chrom"), (F.col("key.pos") - 1).alias("start"), (F.col("key.pos") - 1 + F.col("key.n")).alias("end"))
    bases = fasta.segments(spans, genome).select("key", "bases")
    return named.withColumn("key", F.struct("chrom", "pos", F.length("ref").alias("n"))).join(bases, "key").where("bases = ref").drop("key", "bases")


def out_of_order(rows: DataFrame) -> DataFrame:
    """line, why (contig, position) of (line, contig_idx, pos), lines numbered without gaps: a contig that comes before the last
    line's, or a place before it on the same contig. A line meets the one before it by number, so no sort is needed."""
    before = rows.select((F.col("line") + 1).alias("line"), F.col("contig_idx").alias("_c"), F.col("pos").alias("_p"))
    why = F.when(F.col("contig_idx") < F.col("_c"), "contig").when((F.col("contig_idx") == F.col("_c")) & (F.col("pos") < F.col("_p")), "position")
    return rows.join(before, "line").select("line", why.alias("why")).where("why is not null")


def check_order(variants: DataFrame, lengths: dict[str, int]) -> DataFrame:
    """Rows whose contig is not declared, whose place is past the contig's end, or that repeat a place: what strict readers
    refuse."""
    known = F.create_map(*(F.lit(x) for kv in lengths.items() for x in kv))
    repeats = variants.groupBy("chrom", "pos").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    end = F.expr("1") * F.try_element_at(known, F.col("chrom"))
    lost = variants.where(end.isNull() | (F.col("pos") > end) | (F.col("pos") < 1)).select("chrom", "pos", F.lit("contig").alias("why"))
    return lost.unionByName(repeats.select("chrom", "pos", F.lit("repeated").alias("why")))


def to_lines(variants: DataFrame) -> DataFrame:
    """value: a VCF line for each variant (columns as read_variants gives them; INFO keys in alphabetical order)."""
    joined = lambda name, sep: F.when(F.coalesce(F.size(name), F.lit(0)) > 0, F.array_join(name, sep)).otherwise(".")
    keys = F.array_sort(F.map_keys("info"))
    info = F.when(F.size("info") > 0, F.array_join(F.transform(keys, lambda k: F.when(F.col("info")[k] == "", k).otherwise(F.concat(k, F.lit("="), F.col("info")[k]))), ";")).otherwise(".")
    qual = F.coalesce(F.expr(six_digits("qual")), F.lit("."))
    tail = F.when(F.size("raw") > 0, F.concat(F.lit("\t"), F.array_join("format", ":"), F.lit("\t"), F.array_join("raw", "\t"))).otherwise("")
    return variants.select(F.concat(F.concat_ws("\t", "chrom", F.col("pos").cast("string"), joined("ids", ";"), "ref", joined("alts", ","), qual, joined("filters", ";"), info), tail).alias("value"))


def write(variants: DataFrame, header: Header, path: str, gzip: bool = False) -> None:
    """One directory of text parts in contig and place order, the header as the first part's first lines."""
    spark = variants.sparkSession
    ordered = variants.orderBy("contig_idx", "pos")
    body = to_lines(ordered).select(F.monotonically_increasing_id().alias("n"), "value")
    head = spark.createDataFrame([(i - len(header.lines()) - 1, x) for i, x in enumerate(header.lines())], "n long, value string")
    out = head.coalesce(1).union(body).select("value")
    out.write.mode("errorifexists").option("compression", "gzip" if gzip else "none").text(path)
