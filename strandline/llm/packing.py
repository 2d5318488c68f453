"""Best-fit packing of token sequences by exact complements.

Only the histogram of piece lengths (at most `capacity` entries) meets on the driver. There the plan is made over whole
length classes: the longest open length asks an index of sums for its gap: sums of one, two and three lengths that fill it
exactly are taken from it while the counts still allow them; what no such sum fills is packed best-fit in decreasing
length. The plan says,
for the n-th piece of each length, in which sequence and where it goes. Pieces are numbered by their task and their place
in it, with offsets from counts per task and length, so no length, however common, meets in one task.

Null and empty texts are one piece of the end token alone. Ties and repeated rows each get a piece of their own. Texts of
any length are cut into pieces of `capacity` tokens, the last shorter. An empty table gives no rows. Extra columns are
ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .tokens import chunks, split_words, trimmed

#: Stems whose ids a task remembers before it starts anew, stems looked up together, and bytes of text worked on at once.
REMEMBERED, TOGETHER, PART_BYTES = 400_000, 20_000, 4 << 20
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint"
PLACED = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"


class Remembered:
    """Texts and their ids: one flat array, and where each text's ids begin."""

    def __init__(self) -> None:
        self.slots: dict[str, int] = {}
        self.ids, self.sizes, self.firsts = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, texts: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.slots.update(zip(texts, range(len(self.slots), len(self.slots) + len(texts)), strict=True))
        self.ids, self.sizes = np.concatenate((self.ids, ids)), np.concatenate((self.sizes, sizes))
        self.firsts = np.cumsum(self.sizes) - self.sizes

    def of(self, texts: list[str]) -> np.ndarray:
        return np.fromiter(map(self.slots.__getitem__, texts), np.int64, len(texts))

    def new(self, texts: list[str]) -> list[str]:
        return [x for x in texts if x not in self.slots]


def gathered(ids: np.ndarray, firsts: np.ndarray, sizes: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all ids of these slots, one after the other; ids of each)."""
    count = sizes[slots]
    before = np.cumsum(count) - count
    return ids[np.repeat(firsts[slots] - before, count) + np.arange(count.sum())], count


class WordTokenizer:
    """Ids of whole texts from a tokenizer file whose pre-tokens never cross ASCII white space and whose normaliser lowers
    case: each distinct word of a batch is encoded once. A plain word is a stem of small Latin letters, then a comma or a
    full stop or nothing; it needs neither normaliser nor pattern, so its stem goes to the same model alone and is
    remembered. Other words take the whole way."""

    PLAIN = "^[a-z\u00df-\u00f6\u00f8-\u00ff]+$"

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.stemmer = Tokenizer(self.tokenizer.model)  # the same model, held once
        for t in (self.tokenizer, self.stemmer):
            t.no_padding()
            t.no_truncation()
        self.stemmer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        marks = [self.tokenizer.encode(x, add_special_tokens=False).ids for x in ",."]
        probe = ["thing", "a", "\u00e9t\u00e9", "zzq"]
        self.stems_work = all(len(x) == 1 for x in marks) and all(
            self.stemmer.encode(f"{a} {b}", add_special_tokens=False).ids == [i for x in (a, b) for i in self.tokenizer.encode(x + ",", add_special_tokens=False).ids[:-1]] for a in probe for b in probe
        )
        self.marks = np.array([x[0] for x in marks], np.uint32)
        self.lowers = self.tokenizer.encode("A", add_special_tokens=False).ids == self.tokenizer.encode("a", add_special_tokens=False).ids
        self.stems, self.others = Remembered(), Remembered()

    def learn_stems(self, stems: list[str]) -> None:
        if len(self.stems.slots) > REMEMBERED:
            self.stems = Remembered()
        if new := self.stems.new(stems):
            # each stem is one pre-token, which the model closes by its last id
            parts = [np.array(self.stemmer.encode_batch_fast([" ".join(new[i : i + TOGETHER])], add_special_tokens=False)[0].ids, np.uint32) for i in range(0, len(new), TOGETHER)]
            ids = np.concatenate(parts)
            self.stems.add(new, ids, np.diff(np.flatnonzero(self.closes[ids]), prepend=-1))

    def learn_others(self, words: list[str]) -> None:
        if len(self.others.slots) > REMEMBERED // 4:
            self.others = Remembered()
        new = self.others.new(words)
        for i in range(0, len(new), TOGETHER // 8):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(new[i : i + TOGETHER // 8], add_special_tokens=False)]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            self.others.add(new[i : i + TOGETHER // 8], np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes)

    def spell(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each word's begin, how many) of distinct words."""
        mark = pc.if_else(pc.ends_with(words, ","), 0, pc.if_else(pc.ends_with(words, "."), 1, -1))
        stems = pc.if_else(pc.greater_equal(mark, 0), pc.utf8_slice_codeunits(words, 0, -1), words)
        plain = pc.match_substring_regex(stems, self.PLAIN).to_numpy(zero_copy_only=False) & self.stems_work
        coded = stems.filter(pa.array(plain)).dictionary_encode()
        distinct, rest = coded.dictionary.to_pylist(), words.filter(pa.array(~plain)).to_pylist()
        self.learn_stems(distinct)
        self.learn_others(rest)
        ids, count = gathered(self.stems.ids, self.stems.firsts, self.stems.sizes, self.stems.of(distinct)[coded.indices.to_numpy()]) if distinct else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        mark = mark.to_numpy(zero_copy_only=False)[plain].astype(np.int64)
        ids, count = np.insert(ids, np.cumsum(count)[mark >= 0], self.marks[mark[mark >= 0]]), count + (mark >= 0)
        more, other = gathered(self.others.ids, self.others.firsts, self.others.sizes, self.others.of(rest)) if rest else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        sizes, firsts = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        sizes[plain], sizes[~plain] = count, other
        firsts[plain], firsts[~plain] = np.cumsum(count) - count, len(ids) + np.cumsum(other) - other
        return np.concatenate((ids, more)), firsts, sizes

    def encode(self, text: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each closed by `end`; where each text begins, and the total)."""
        if self.lowers and not pc.any(pc.match_substring(text, "<|")).as_py():  # special tokens keep their case
            text = pc.ascii_lower(text)
        offsets, words = split_words(text)
        coded = words.dictionary_encode()
        ids, count = gathered(*self.spell(coded.dictionary), coded.indices.to_numpy())
        before = np.concatenate(([0], np.cumsum(count)))[offsets]
        return np.insert(ids, before[1:], np.uint32(end)), before + np.arange(len(offsets))


def cutter(path: str, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, seen, part_id = WordTokenizer(path), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            for part in chunks(batch, "text", PART_BYTES):
                ids, bounds = tokenizer.encode(part.column("text"), end)
                view = memoryview(ids.astype("<u4", copy=False)).cast("B")
                total = np.diff(bounds)
                pieces = -(-total // capacity)
                doc = np.repeat(np.arange(len(total)), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(capacity, total[doc] - start)
                first = bounds[:-1][doc] + start
                crc = [zlib.crc32(view[4 * a : 4 * (a + n)]) for a, n in zip(first.tolist(), length.tolist(), strict=True)]
                # the n-th piece of its length in this task
                order = np.argsort(length, kind="stable")
                rank = np.empty(len(length), np.int64)
                sizes = np.bincount(length, minlength=capacity + 1)
                rank[order] = np.arange(len(length)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                nth = seen[length] + rank
                seen += sizes
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part_id), pa.int32()), pa.array(nth, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
                )

    return run


class SumIndex:
    """Sums of one, two and three lengths of a histogram, and which of them the counts still allow.

    Pairs are listed by their sum, the largest length first; a triple is its largest length and a pair of the rest. Counts
    only fall, so what they once forbid they always will: each sum keeps a place in its list and never looks back.
    """

    def __init__(self, counts: np.ndarray) -> None:
        self.counts, self.lengths = counts, np.flatnonzero(counts)[::-1]
        a, b = (x.ravel() for x in np.meshgrid(self.lengths, self.lengths, indexing="ij"))
        fits = (a >= b) & (a + b < len(counts))
        a, b = a[fits], b[fits]
        order = np.argsort(a + b, kind="stable")
        self.first, self.second = a[order], b[order]
        self.ends = np.cumsum(np.bincount(a + b, minlength=len(counts)))
        self.pair_at = self.ends - np.bincount(a + b, minlength=len(counts))
        self.triple_at = np.zeros(len(counts), np.int64)

    def allows(self, *lengths: int) -> bool:
        return all(self.counts[x] >= lengths.count(x) for x in lengths)

    def pair(self, total: int, beside: tuple[int, ...], most: int) -> tuple[int, int] | None:
        """The first pair of this sum, no length over `most`, that the counts allow beside other lengths."""
        while self.pair_at[total] < self.ends[total] and not self.allows(int(self.first[self.pair_at[total]]), int(self.second[self.pair_at[total]])):
            self.pair_at[total] += 1
        begin, end = int(self.pair_at[total]), int(self.ends[total])
        begin += int(np.searchsorted(-self.first[begin:end], -most))  # the largest lengths come first
        for at in range(begin, end):
            found = int(self.first[at]), int(self.second[at])
            if self.allows(*found, *beside):
                return found
        return None

    def triple(self, total: int, beside: int) -> tuple[int, ...] | None:
        while (at := self.triple_at[total]) < len(self.lengths) and (a := int(self.lengths[at])) * 3 >= total:
            if a < total - 1 and self.counts[a] and (rest := self.pair(total - a, (a, beside), a)):
                return a, *rest
            self.triple_at[total] += 1
        return None

    def fill(self, gap: int, beside: int) -> tuple[int, ...] | None:
        """One, two or three lengths that sum to the gap, available beside a piece of length `beside`."""
        if gap > 0 and self.counts[gap] and self.allows(gap, beside):
            return (gap,)
        return (self.pair(gap, (beside,), gap) or self.triple(gap, beside)) if gap > 1 else None


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(how many sequences, lengths in each), from the number of pieces of each length."""
    open_ = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        open_[length] = n
    found: list[tuple[int, list[int]]] = []
    if open_[capacity]:
        found.append((int(open_[capacity]), [capacity]))
        open_[capacity] = 0
    index = SumIndex(open_)
    for longest in range(capacity - 1, 0, -1):
        while open_[longest] > 0 and (rest := index.fill(capacity - longest, longest)):
            lengths = [longest, *rest]
            needs = {x: lengths.count(x) for x in lengths}
            times = int(min(open_[x] // n for x, n in needs.items()))
            for x, n in needs.items():
                open_[x] -= n * times
            found.append((times, lengths))
    # the rest, best-fit in decreasing length: gaps[g] holds (how many sequences, lengths) with g tokens free
    gaps: dict[int, list[tuple[int, list[int]]]] = {}
    for length in range(capacity - 1, 0, -1):
        left = int(open_[length])
        while left:
            fitting = [g for g in gaps if g >= length]
            if fitting:
                g = min(fitting)
                many, lengths = gaps[g].pop()
                times = min(many, left)
                if many > times:
                    gaps[g].append((many - times, lengths))
                if not gaps[g]:
                    del gaps[g]
                left -= times
                gaps.setdefault(g - length, []).append((times, [*lengths, length]))
                continue
            each = capacity // length
            times, took = (left // each, each) if left >= each else (1, left)
            gaps.setdefault(capacity - took * length, []).append((times, [length] * took))
            left -= times * took
    return found + [x for own in gaps.values() for x in own]


def _slots(patterns: list[tuple[int, list[int]]], capacity: int) -> tuple[np.ndarray, ...]:
    """Runs of equal slots, by length and rank: length, first rank, first sequence, offset."""
    rows, sequence, taken = [], 0, np.zeros(capacity + 1, np.int64)
    for times, lengths in patterns:
        offset = 0
        for length in lengths:
            rows.append((length, int(taken[length]), sequence, offset))
            taken[length] += times
            offset += length
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return table[:, 0], table[:, 1], table[:, 2], table[:, 3]


def placer(slots: tuple[np.ndarray, ...]):
    lengths, ranks, sequences, offsets = slots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            # the last run of this length that begins at or before the rank
            low, high = np.searchsorted(lengths, length), np.searchsorted(lengths, length, side="right") - 1
            while (low < high).any():
                mid = (low + high + 1) // 2
                up = ranks[mid] <= rank
                low, high = np.where(up, mid, low), np.where(up, high, mid - 1)
            out = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*out, pa.array(sequences[low] + rank - ranks[low]), pa.array(offsets[low])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pieces_of(docs: DataFrame, path: str, capacity: int = 2048, end: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """PIECES of every text, stored: the numbering by task must not change once it is counted."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return stored(rows.mapInArrow(trimmed(cutter(path, capacity, end)), PIECES), "pieces")


def pack(docs: DataFrame, path: str, capacity: int = 2048, end: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per piece doc_id, piece, start, length, ids_crc32, sequence_id, offset; path: the tokenizer's file."""
    cut = pieces_of(docs, path, capacity, end, doc_id, text)
    counts = cut.groupBy("part", "length").agg((F.max("nth") + 1).alias("n"))
    before = counts.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    slots = _slots(plan(histogram, capacity), capacity)
    ranked = cut.join(before.select("part", "length", "base"), ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(placer(slots), PLACED)
