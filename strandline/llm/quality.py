"""Quality classifier: supervised subword embeddings.

A text's features are its words, their character n-grams (the word between < and >) and its word bigrams, all hashed to
BUCKETS vectors; a word that repeats the one before makes one bigram for all such pairs. Their vectors are averaged per
document and go to a softmax of two classes. numpy trains vectors and output by stochastic gradient descent, a document
a step, on a sample of at most `size` labelled ids outside the held-out fold (a parameter; nothing else is bounded).

As the mean and the output before the softmax are linear, scoring needs one number per feature: each distinct word of a
batch is looked up once. Null and empty texts have no feature and get the score of the bias. Without labels the score is
0.5. Repeated rows each give a row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import carried
from .samples import labelled_sample
from .tokens import ODD, chunks, mix, split_words, trimmed, word_hashes

BUCKETS, GRAMS, SAMPLE = 1 << 17, (2, 3, 4), 3000
DIMENSIONS, EPOCHS, RATE, SEED = 8, 12, 2.0, 5
#: Text worked on at once: its words' n-grams take many times its size.
PART_BYTES = 1 << 19
#: Features are averaged, so one of thousands gets a tiny gradient; it is taken so many times larger.
SHARPEN = 20.0


def word_features(words: pa.Array, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all words' features, where each word's begin): the word itself and its character n-grams."""
    texts = words.to_pylist()
    codes = np.frombuffer("".join(f"<{w}>" for w in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    left = ends[owner] - np.arange(len(codes))  # code points from here to the word's end
    parts, owners = [hashes], [np.arange(len(texts))]
    for n in GRAMS:
        rolled = np.full(max(0, len(codes) - n + 1), n, np.uint64)
        for i in range(n):
            rolled = rolled * ODD + codes[i : len(codes) - n + 1 + i]
        own = np.flatnonzero(left[: len(rolled)] >= n)
        parts.append(mix(rolled[own]))
        owners.append(owner[own])
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    buckets = (np.concatenate(parts)[order] % np.uint64(BUCKETS)).astype(np.int64)
    return buckets, np.concatenate(([0], np.cumsum(np.bincount(owners, minlength=len(texts)))))


def bigram_features(offsets: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all bigrams, the text of each)."""
    if len(hashes) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = np.ones(len(hashes), bool)
    inside[offsets[1:-1][offsets[1:-1] < len(hashes)]] = False
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[1:][inside[1:]]
    pair = np.where(hashes[1:] == hashes[:-1], np.uint64(1), hashes[:-1] * ODD + hashes[1:] * np.uint64(3))[inside[1:]]
    return (mix(pair) % np.uint64(BUCKETS)).astype(np.int64), owner


def features(text: pa.Array) -> tuple[np.ndarray, ...]:
    """(word buckets, where each distinct word's begin, the words as indices, text offsets, bigram buckets, their texts)."""
    offsets, words = split_words(text)
    coded = words.dictionary_encode()
    own = word_hashes(coded.dictionary)
    buckets, begins = word_features(coded.dictionary, own)
    index = coded.indices.to_numpy()
    pairs, owner = bigram_features(offsets, own[index] if len(own) else own)
    return buckets, begins, index, offsets, pairs, owner


def zipped(values: np.ndarray) -> bytes:
    """How many, then the values, compressed: a sample of texts with thousands of features each goes to the driver."""
    return len(values).to_bytes(4, "little") + pa.compress(values.astype("<u4").tobytes(), codec="zstd", asbytes=True)


def unzipped(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    return np.frombuffer(pa.decompress(data[4:], 4 * n, codec="zstd", asbytes=True), "<u4")


def counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct buckets and their counts of each labelled text."""
    for batch in batches:
        for part in chunks(batch, "text", PART_BYTES):
            buckets, begins, index, offsets, pairs, owner = features(part.column("text"))
            cuts = np.searchsorted(owner, np.arange(part.num_rows + 1))
            rows = []
            for i in range(part.num_rows):
                words, n = np.unique(index[offsets[i] : offsets[i + 1]], return_counts=True)
                sizes = begins[words + 1] - begins[words]
                at = np.repeat(begins[words] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                bins = np.bincount(np.concatenate((buckets[at], pairs[cuts[i] : cuts[i + 1]])), weights=np.concatenate((np.repeat(n, sizes), np.ones(cuts[i + 1] - cuts[i]))), minlength=BUCKETS)
                some = np.flatnonzero(bins)
                rows.append((zipped(np.diff(some, prepend=0)), zipped(bins[some])))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), *(pa.array(x, pa.binary()) for x in zip(*rows, strict=True))], names=["doc_id", "y", "buckets", "counts"])


def train(examples: list[tuple[int, bytes, bytes]]) -> tuple[np.ndarray, float]:
    """(a number for each bucket, the bias): the difference of the two classes' outputs. Examples: label, zipped steps between
    the buckets, zipped counts."""
    draw = np.random.default_rng(SEED)
    vectors = (draw.random((BUCKETS, DIMENSIONS), np.float32) - np.float32(0.5)) / DIMENSIONS
    output, bias = np.zeros((2, DIMENSIONS), np.float32), np.zeros(2, np.float32)
    steps, done = max(1, EPOCHS * len(examples)), 0
    for _ in range(EPOCHS):
        for i in draw.permutation(len(examples)).tolist():
            y, buckets, counts = examples[i]
            buckets, counts = np.cumsum(unzipped(buckets), dtype=np.int64), unzipped(counts)
            share = (counts / max(1, counts.sum())).astype(np.float32)
            rate = np.float32(RATE * (1 - done / steps))
            done += 1
            own = vectors[buckets]
            mean = share @ own if len(buckets) else np.zeros(DIMENSIONS, np.float32)
            z = output @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = p @ output
            output -= rate * np.outer(p, mean)
            bias -= rate * np.float32(0.02) * p
            vectors[buckets] = own - (rate * share)[:, None] * back * np.float32(SHARPEN)
    return vectors @ (output[1] - output[0]), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", size: int = SAMPLE) -> tuple[np.ndarray, float]:
    sample = labelled_sample(docs, labels, target, size).mapInArrow(trimmed(counter), "doc_id bigint, y int, buckets binary, counts binary")
    rows = sorted(sample.collect(), key=lambda r: (r["doc_id"], r["buckets"], r["counts"]))  # at most `size` labelled ids
    return train([(r["y"], bytes(r["buckets"]), bytes(r["counts"])) for r in rows])


def scorer(weights: np.ndarray, bias: float):
    sent = weights.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", PART_BYTES):
                buckets, begins, index, offsets, pairs, owner = features(part.column("text"))
                many = part.num_rows
                own = np.concatenate(([0.0], np.cumsum(sent[buckets], dtype=np.float64)))
                word, sizes = own[begins[1:]] - own[begins[:-1]], np.diff(begins)
                text = np.repeat(np.arange(many), np.diff(offsets))
                total = np.bincount(text, weights=word[index], minlength=many) + np.bincount(owner, weights=sent[pairs], minlength=many)
                n = np.bincount(text, weights=sizes[index], minlength=many) + np.bincount(owner, minlength=many)
                z = np.divide(total, n, out=np.zeros(many), where=n > 0) + bias
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50))))], names=[*part.schema.names, "score"])

    return run


def score(docs: DataFrame, model: tuple[np.ndarray, float], doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row doc_id, text, score (the probability of label 1), and a struct `carried` of the columns in `carry`."""
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"), *carried(docs, carry))
    return rows.mapInArrow(trimmed(scorer(*model)), T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())]))
