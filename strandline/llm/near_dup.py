"""MinHash near-dedup: banded candidates, sequential Bayesian verification on signatures, exact check of the survivors.

Texts with equal word sequences fall together first, so a group of exact copies is one node. Each node has a MinHash
signature cut into bands; nodes that share a band are candidates. Bands and rows are chosen so that a pair at the
threshold misses all bands with a probability of at most MISS. A candidate's signatures are compared batch by batch; it
goes as soon as the posterior probability (uniform prior) that its similarity reaches the threshold is below MISS.
Survivors are confirmed on the full shingle sets.

Only components are asked for, so pairs are not listed: in a bucket every node meets one leader (a row per member, two
aggregations and a join that Spark can split); what this joins becomes one component. A second round takes other
leaders. What is left are nodes of one bucket in different components. Of such a node only shingles that also occur in
another component can be shared by a new link; their number bounds its similarity to anything in the bucket, exactly, and
most nodes go by that. The rest are dealt into blocks, of which each pair meets in a task that counts all intersections of
their sets and returns only links, so none is lost and no other pair is ever a row. They meet bucket by bucket, or, where
their buckets overlap so much that this is less work, in all connected buckets at once. Components are found by star
contraction in stored tables. A bucket, or a class of equal texts, with many of the rows is looked up in a broadcast.

Shingles are compared by 64-bit hashes. Nulls, empty texts: no shingles, linked with nothing. A null doc_id is linked
with nothing, component_id null, kept. Rows that share a doc_id are one node, so each such row gets that component.
Extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, looked_up, stored
from .components import components
from .tokens import ODD, chunks, mix, split_words, trimmed, trimmed_group, word_hashes

#: Chosen probability of missing a pair that lies at the threshold, by the bands and by the pruning.
MISS, SIGNATURE, BATCH = 1e-6, 120, 20
#: Nodes of a block (and 512 times as many shingles), and shingles of a slice.
BLOCK, SLICE = 512, 4096
SIGNED = "doc_id bigint, class binary, n_shingles bigint, signature binary, bands array<bigint>"
CHECKED = "u bigint, v bigint"


def banding(similarity: float) -> tuple[int, int]:
    """(bands, rows): the longest rows by which a pair at the threshold is missed with at most MISS."""
    for rows in range(12, 0, -1):
        if (1 - similarity**rows) ** (SIGNATURE // rows) <= MISS:
            return SIGNATURE // rows, rows
    return SIGNATURE, 1


def least_matches(similarity: float) -> list[tuple[int, int]]:
    """(n, m): after n hashes, fewer than m equal ones make the pair's reaching the threshold unlikelier than MISS."""

    def reach(n: int, m: int) -> float:
        # P(S >= t | m of n) under a uniform prior is the chance of at most m successes in n + 1 trials at t
        return sum(comb(n + 1, i) * similarity**i * (1 - similarity) ** (n + 1 - i) for i in range(m + 1))

    return [(n, next(m for m in range(n + 1) if reach(n, m) >= MISS)) for n in range(BATCH, SIGNATURE + 1, BATCH)]


def shingle_sets(text: pa.Array, k: int) -> Iterator[tuple[np.ndarray, bytes]]:
    """(sorted distinct shingle hashes, digest of the whole word sequence) of each text, lower-cased in A-Z."""
    offsets, words = split_words(pa.compute.ascii_lower(pa.compute.fill_null(text, "")))
    hashes = word_hashes(words)
    n = max(0, len(hashes) - k + 1)
    rolled = np.zeros(n, np.uint64)
    for i in range(k):
        rolled = rolled * ODD + hashes[i : i + n]
    rolled = mix(rolled)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        own = hashes[a:b]
        if b - a >= k:
            found = np.unique(rolled[a : b - k + 1])
        elif b > a:
            found = np.array([xxhash.xxh3_64_intdigest(own.tobytes(), seed=b - a)], np.uint64)
        else:
            found = np.zeros(0, np.uint64)
        yield found, xxhash.xxh3_128_digest(own.tobytes())


def signer(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = np.random.default_rng(7)
        a = draw.integers(0, 1 << 63, SIGNATURE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        b = draw.integers(0, 1 << 63, SIGNATURE, dtype=np.uint64)
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64) * ODD)
        for batch in batches:
            for part in chunks(batch, "text"):
                classes, sizes, signatures, keys = [], [], [], []
                for found, digest in shingle_sets(part.column("text"), k):
                    classes.append(digest)
                    sizes.append(len(found))
                    if not len(found):
                        signatures.append(b"")
                        keys.append([])
                        continue
                    least = np.full(SIGNATURE, np.iinfo(np.uint64).max)
                    for i in range(0, len(found), 2048):
                        x = found[i : i + 2048, None] * a
                        x += b
                        np.minimum(least, x.min(axis=0), out=least)
                    least = mix(least)
                    signatures.append((least >> np.uint64(32)).astype("<u4").tobytes())
                    key = salt.copy()
                    for r in range(rows):
                        key = mix(key * ODD + least[r : bands * rows : rows])
                    keys.append(key.view(np.int64).tolist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(classes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(signatures, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    names=["doc_id", "class", "n_shingles", "signature", "bands"],
                )

    return run


def pruner(similarity: float):
    steps = least_matches(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(n, SIGNATURE) for c in ("su", "sv"))
            alive, same = np.arange(n), np.zeros(n, np.int64)
            for done, least in steps:
                same[alive] += (left[alive, done - BATCH : done] == right[alive, done - BATCH : done]).sum(axis=1)
                alive = alive[same[alive] >= least]
            yield pa.RecordBatch.from_arrays([batch.column("u").take(pa.array(alive)), batch.column("v").take(pa.array(alive))], names=["u", "v"])

    return run


def confirmer(k: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "tv"):
                # equal texts stand next to each other in u (one leader, many members): each is cut once
                texts = pa.concat_arrays([part.column("tu"), part.column("tv")]).dictionary_encode()
                sets = [s for s, _ in shingle_sets(texts.dictionary, k)]
                at = texts.indices.to_numpy()
                n, keep = part.num_rows, []
                for i in range(n):
                    x, y = sets[at[i]], sets[at[n + i]]
                    both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) * den >= num * max(len(x), len(y)) else 0
                    keep.append(both > 0 and den * both >= num * (len(x) + len(y) - both))
                mask = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("u").filter(mask), part.column("v").filter(mask)], names=["u", "v"])

    return run


def shingler(k: int):
    """(node, shingle) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                sets = [s for s, _ in shingle_sets(part.column("text"), k)]
                nodes = np.repeat(part.column("node").to_numpy(), [len(s) for s in sets])
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(np.concatenate(sets).view(np.int64))], names=["node", "shingle"])

    return run


def blocks(similarity: Fraction):
    """Linked pairs (u, v) of one block of a cluster against one block of its nodes outside the main component: sizes of
    all intersections by products of the 0/1 matrices of nodes and shingles, a slice of shingles at a time."""
    num, den = similarity.numerator, similarity.denominator

    def run(group: pa.Table) -> pa.Table:
        guest = group.column("guest").to_numpy() == 1
        node, comp, size = (group.column(c).to_numpy() for c in ("node", "comp", "n_shingles"))
        lists = group.column("shingles").combine_chunks()
        owner = np.repeat(np.arange(len(node)), np.diff(lists.offsets.to_numpy()))
        rank = np.cumsum(guest) * guest + np.cumsum(~guest) * ~guest - 1  # place among the guests, or among the others
        shingle = np.unique(lists.flatten().to_numpy(), return_inverse=True)[1]
        order = np.argsort(shingle, kind="stable")
        shingle, owner = shingle[order], owner[order]
        both = np.zeros((int(guest.sum()), int((~guest).sum())), np.float32)
        for a in range(0, int(shingle[-1]) + 1 if len(shingle) else 0, SLICE):
            at = slice(*np.searchsorted(shingle, (a, a + SLICE)))
            sides = []
            for side in (guest, ~guest):
                mine = side[owner[at]]
                sides.append(np.zeros((int(side.sum()), SLICE), np.float32))
                sides[-1][rank[owner[at][mine]], shingle[at][mine] - a] = 1
            both += sides[0] @ sides[1].T
        g, o = np.flatnonzero(guest), np.flatnonzero(~guest)
        x, y = np.nonzero((den * both >= num * (size[g][:, None] + size[o][None, :] - both)) & (comp[g][:, None] != comp[o][None, :]))
        u, v = node[g[x]], node[o[y]]
        return pa.table({"u": pa.array(np.minimum(u, v)), "v": pa.array(np.maximum(u, v))})

    return run


class _Search:
    """One run: the nodes with their bands, and what was compared and linked so far, all in stored tables."""

    def __init__(self, rows: DataFrame, k: int, similarity: Fraction) -> None:
        self.k, self.similarity, self.scratch = k, similarity, []
        bands, length = banding(float(similarity))
        self.signed = stored(rows.mapInArrow(trimmed(signer(k, bands, length)), SIGNED), "signed")
        has = self.signed.where("n_shingles > 0 and doc_id is not null")
        self.classes = stored(has.groupBy("class").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")), "classes")
        # a class's smallest document stands for it
        own = has.join(self.classes.select("class", F.col("node").alias("doc_id")), ["class", "doc_id"]).dropDuplicates(["doc_id", "class"])
        self.nodes = self.held(own.select(F.col("doc_id").alias("node"), "signature", "bands", "n_shingles"), "nodes")
        members = self.nodes.select("node", F.explode("bands").alias("band"), "n_shingles")
        self.members = self.held(self.shared(members, "node"), "members")
        # the texts of nodes that share a bucket, taken from all texts once
        self.texts = self.held(rows.join(self.members.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("node"), "text"), "texts")
        self.compared = self.links = None

    def held(self, df: DataFrame, name: str) -> DataFrame:
        """A stored table that the search alone reads."""
        out = stored(df, name)
        self.scratch.append(out)
        return out

    def shared(self, members: DataFrame, what: str) -> DataFrame:
        """Those of buckets in which `what` is not the same throughout."""
        met = members.groupBy("band").agg(F.min(what).alias("a"), F.max(what).alias("b"), F.count("*").alias("n")).where("a < b")
        told = looked_up(members, self.held(met.select("band", "n", F.lit(True).alias("_met")), "buckets"), "band", F.col("node"))
        return told.where("_met").drop("_met")

    def compare(self, pairs: DataFrame) -> DataFrame:
        """Pairs (u < v) that were not compared before, through pruning and confirmation; returns the new links."""
        if self.compared is not None:
            pairs = pairs.join(self.compared, ["u", "v"], "left_anti")
        pairs = self.held(pairs, "pairs")
        self.compared = pairs if self.compared is None else self.compared.union(pairs)
        sides = self.nodes.select("node", "signature")
        signed = pairs.join(sides.select(F.col("node").alias("u"), F.col("signature").alias("su")), "u").join(sides.select(F.col("node").alias("v"), F.col("signature").alias("sv")), "v")
        alive = self.held(signed.mapInArrow(trimmed(pruner(float(self.similarity))), CHECKED), "alive")
        asked = self.texts.join(alive.select(F.col("u").alias("node")).union(alive.select(F.col("v").alias("node"))).distinct(), "node", "left_semi")
        full = alive.join(asked.select(F.col("node").alias("v"), F.col("text").alias("tv")), "v").join(asked.select(F.col("node").alias("u"), F.col("text").alias("tu")), "u")
        new = self.held(full.select("u", "v", "tu", "tv").mapInArrow(trimmed(confirmer(self.k, self.similarity.numerator, self.similarity.denominator)), CHECKED).distinct(), "links")
        self.links = new if self.links is None else self.links.union(new)
        return new

    def open(self, labels: DataFrame | None) -> DataFrame:
        """(band, node, comp, n_shingles) of the buckets that hold more than one component."""
        if labels is None:
            return self.members.withColumn("comp", F.col("node"))
        told = self.members.join(labels, "node", "left").withColumn("comp", F.coalesce("component", F.col("node"))).drop("component")
        return self.held(self.shared(told, "comp"), "open")

    def near(self) -> str:
        """Sizes that can be of similar sets."""
        num, den = self.similarity.numerator, self.similarity.denominator
        return f"least(x.n_shingles, y.n_shingles) * {den} >= greatest(x.n_shingles, y.n_shingles) * {num}"

    def by_leader(self, around: DataFrame, turn: int) -> DataFrame:
        order = F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "comp", "n_shingles")
        leaders = self.held(around.groupBy("band").agg(F.min(order).alias("y"), F.count("*").alias("n")).select("band", "n", "y"), "leaders")
        met = looked_up(around.select("band", "node", F.struct("node", "comp", "n_shingles").alias("x")), leaders, "band", F.col("node"))
        return met.where(f"x.comp <> y.comp and {self.near()}").select(F.least("x.node", "y.node").alias("u"), F.greatest("x.node", "y.node").alias("v")).distinct()

    def bounded(self, around: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(members that may still have a link to another component of their bucket; node, shingle: those of their
        shingles that occur in another component at all)."""
        nodes = around.select("node", "comp").distinct()
        shingles = self.held(self.texts.join(nodes.select("node"), "node", "left_semi").mapInArrow(trimmed(shingler(self.k)), "node bigint, shingle bigint").distinct().join(nodes, "node"), "shingles")
        common = shingles.groupBy("shingle").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a < b").select("shingle")
        shared = self.held(shingles.join(common, "shingle").select("node", "shingle"), "shared")
        left = around.join(shared.groupBy("node").agg(F.count("*").alias("shared")), "node")
        num, den = self.similarity.numerator, self.similarity.denominator
        for _ in range(2):
            # the similarity to a set of n is at most shared / (n_shingles + n - shared), and n is at least `shared`
            told = left.groupBy("band").agg(F.min("n_shingles").alias("least"), F.min("comp").alias("a"), F.max("comp").alias("b"), F.count("*").alias("n")).where("a < b")
            sized = looked_up(left, self.held(told.select("band", "n", "least"), "least"), "band", F.col("node"))
            left = self.held(sized.where(f"least is not null and {den} * shared >= {num} * (n_shingles + greatest(least, shared) - shared)").drop("least"), "bounded")
        return left, shared

    def all_left(self, around: DataFrame, shared: DataFrame) -> DataFrame:
        """Links between different components. Nodes that share a bucket, directly or over others, are a cluster. Of a bucket,
        or of a whole cluster where this makes fewer pairs than its buckets one by one, the nodes outside its main component
        meet all, block by block: only links leave as rows, and no block outgrows a task."""
        stars = around.groupBy("band").agg(F.min("node").alias("v")).join(around.select("band", F.col("node").alias("u")), "band").select("u", "v")
        placed = self.held(around.join(components(stars), "node").withColumnRenamed("component", "cluster"), "placed")
        nodes = placed.select("cluster", F.lit(None).cast("long").alias("band"), "node", "comp", "n_shingles", "shared").distinct()
        either = nodes.union(placed.select(*nodes.columns))
        group = ("cluster", "band")
        per = either.groupBy(*group, "comp").agg(F.count("*").alias("n"), F.sum("shared").alias("w")).groupBy(*group).agg(
            F.sum("n").alias("n"), F.sum("w").alias("w"), F.max(F.struct("n", "w", "comp")).alias("main")
        )
        work = F.col("n").cast("double") * (F.col("n") - F.col("main.n"))
        cheaper = per.groupBy("cluster").agg((F.sum(F.when(F.col("band").isNull(), work)) <= F.sum(F.when(F.col("band").isNotNull(), work))).alias("whole"))
        many = lambda n, w: F.greatest(F.ceil(n / BLOCK), F.ceil(w / (BLOCK * 512)), F.lit(1))
        per = per.where("n > main.n").join(cheaper, "cluster").where("whole = (band is null)")
        per = per.select(*group, F.col("main.comp").alias("main"), many(F.col("n"), F.col("w")).alias("rows"), many(F.col("n") - F.col("main.n"), F.col("w") - F.col("main.w")).alias("guests"))
        sets = shared.join(placed.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.collect_list("shingle").alias("shingles"))
        same = (F.col("x.cluster") == F.col("y.cluster")) & F.col("x.band").eqNullSafe(F.col("y.band"))
        told = either.alias("x").join(per.alias("y"), same).select("x.*", "y.main", "y.rows", "y.guests").join(sets, "node")
        columns = (*group, "node", "comp", "n_shingles", "shingles")
        hashed = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
        own = told.select(*columns, hashed("rows").alias("i"), F.explode(F.sequence(F.lit(0), F.col("guests") - 1)).alias("j"), F.lit(0).alias("guest"))
        guests = told.where("comp <> main").select(*columns, F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), hashed("guests").alias("j"), F.lit(1).alias("guest"))
        return own.union(guests).groupBy(*group, "i", "j").applyInArrow(trimmed_group(blocks(self.similarity)), CHECKED).distinct()

    def labels(self) -> DataFrame:
        """(node, component) of linked nodes."""
        self.compare(self.by_leader(self.open(None), 0))
        told = components(self.links)
        around = self.open(told)
        self.compare(self.by_leader(around, 1))
        told = components(self.links)
        around = self.open(told)
        self.compare(self.all_left(*self.bounded(around)))
        told = stored(components(self.links), "components")
        dropped(*self.scratch)
        return told


def near_duplicates(docs: DataFrame, k: int = 5, similarity: float | str = "0.8", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row doc_id, n_shingles, component_id (the smallest doc_id reachable over links, itself included), kept.

    Two documents are linked if their sets of `k`-word shingles have a Jaccard similarity of at least `similarity`; a
    text of fewer words has its whole sequence as its one shingle.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    search = _Search(rows, k, Fraction(str(similarity)))
    labels = search.labels()
    groups = stored(search.classes.join(labels, "node", "left").select("class", "n", F.coalesce("component", F.col("node")).alias("component_id")), "groups")
    told = looked_up(search.signed.select("doc_id", "class", "n_shingles"), groups, "class", F.col("doc_id"))
    # rows of one doc_id are one node even where their texts differ
    own = F.when(F.col("n_shingles") > 0, F.least("component_id", F.col("doc_id"))).otherwise(F.col("doc_id"))
    return told.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )
