"""Language ID by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A trigram's vector binds (multiplies) its
letters' vectors, each permuted (rotated) by its place; a document's vector bundles (adds) its trigrams' vectors. A
language's prototype bundles the unit vectors of its training documents; a document gets the language whose prototype
has the largest cosine. Case is folded; a run of anything but letters is one blank, as are both ends of a text.

Prototypes are learned from at most about `per_language` documents of each language, taken by a hash of doc_id; all
other work covers whole texts of all documents. Null texts and texts without a letter: `und`, score 0. Ties go to the
language first in the alphabet. No labelled document: `und` throughout. Rows with a null doc_id are scored, and learned
from as any other. Repeated rows each give a row. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import chunks

DIMENSIONS, BLOCK, ROWS = 1024, 4096, 128
CODE_POINTS = 0x110000


def letter_vector(code: int) -> np.ndarray:
    return np.random.default_rng([11, int(code)]).integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1


class Bundler:
    """Document vectors of a batch of texts; remembers letters' vectors and which code points are letters."""

    def __init__(self) -> None:
        self.vectors: dict[int, np.ndarray] = {0: letter_vector(0)}

    def trigrams(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(letters' code points, with 0 for the blank at 0; trigrams as indices into them, distinct; for each text where
        its trigrams begin in the list of all, and that list)."""
        whole = " " + " ".join(pc.utf8_lower(pc.fill_null(text, "")).to_pylist()) + " "
        sizes = pc.utf8_length(pc.utf8_lower(pc.fill_null(text, ""))).to_numpy().astype(np.int64)
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        there = np.zeros(CODE_POINTS, bool)
        there[codes] = True
        letters = np.array([0, *(c for c in np.flatnonzero(there).tolist() if chr(c).isalpha())], np.int64)
        index = np.zeros(CODE_POINTS, np.int32)
        index[letters[1:]] = np.arange(1, len(letters))
        seq = index[codes]
        keep = np.ones(len(seq), bool)
        keep[1:] = (seq[1:] > 0) | (seq[:-1] > 0)
        blanks = np.concatenate(([0], np.cumsum(sizes + 1)))  # where the blank before each text, and the last, stands
        bounds = np.cumsum(keep)[blanks] - 1
        seq = seq[keep].astype(np.int64)
        n = np.maximum(0, np.diff(bounds) - 1)
        starts = np.repeat(bounds[:-1] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        k = len(letters)
        found = (seq[starts] * k + seq[starts + 1]) * k + seq[starts + 2] if len(starts) else np.zeros(0, np.int64)
        if k**3 <= 1 << 24:
            seen = np.zeros(k**3, bool)
            seen[found] = True
            distinct = np.flatnonzero(seen)
            place = np.zeros(k**3, np.int32)
            place[distinct] = np.arange(len(distinct))
            ids = place[found]
        else:
            distinct, ids = np.unique(found, return_inverse=True)
        return letters, np.stack([distinct // k // k, distinct // k % k, distinct % k]), np.concatenate(([0], np.cumsum(n))), ids

    def vectors_of(self, text: pa.Array) -> np.ndarray:
        letters, grams, bounds, ids = self.trigrams(text)
        for code in letters.tolist():
            if code not in self.vectors:
                self.vectors[code] = letter_vector(code)
        table = np.stack([self.vectors[c] for c in letters.tolist()])
        first, second = np.roll(table, 2, axis=1), np.roll(table, 1, axis=1)
        out = np.zeros((len(bounds) - 1, DIMENSIONS), np.float32)
        many = grams.shape[1]
        for r in range(0, len(out), ROWS):
            end = min(len(out), r + ROWS)
            own = ids[bounds[r] : bounds[end]].astype(np.int64)
            doc = np.repeat(np.arange(end - r), np.diff(bounds[r : end + 1]))
            used, place = np.unique(own, return_inverse=True) if many > 1 << 20 else (None, own)
            wide = many if used is None else len(used)
            counts = np.bincount(doc * wide + place, minlength=(end - r) * wide).reshape(end - r, wide).astype(np.float32)
            for b in range(0, wide, BLOCK):
                g = grams[:, b : b + BLOCK] if used is None else grams[:, used[b : b + BLOCK]]
                key = (b, many) if used is None else None
                bound = self.block.get(key) if key else None
                if bound is None:
                    bound = (first[g[0]] * second[g[1]] * table[g[2]]).astype(np.float32)
                    if key and len(self.block) < 4:
                        self.block[key] = bound
                out[r:end] += counts[:, b : b + BLOCK] @ bound
        return out

    def bundle(self, text: pa.Array) -> np.ndarray:
        """Unit vectors, a row for each text; zeros for a text without a letter."""
        self.block: dict = {}  # bound trigrams of this batch, kept for its next rows
        out = self.vectors_of(text)
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, size, out=np.zeros_like(out), where=size > 0)


def learner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bundler, sums = Bundler(), {}
    for batch in batches:
        for part in chunks(batch, "text"):
            vectors = bundler.bundle(part.column("text"))
            langs = part.column("lang").dictionary_encode()
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                sums[lang] = sums.get(lang, 0) + vectors[langs.indices.to_numpy() == i].sum(axis=0, dtype=np.float64)
    for lang, total in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * DIMENSIONS, pa.string()), pa.array(np.arange(DIMENSIONS), pa.int32()), pa.array(total)], names=["lang", "i", "value"])


def prototypes(labelled: DataFrame, per_language: int = 1000, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages in alphabetical order, their unit prototypes) from labelled documents."""
    rows = labelled.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not counts:
        return [], np.zeros((0, DIMENSIONS), np.float32)
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, per_language / n)))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) / float(1 << 30) < F.element_at(share, F.col("lang"))
    sums = rows.where(drawn).select("text", "lang").mapInArrow(learner, "lang string, i int, value double").groupBy("lang", "i").agg(F.sum("value").alias("value"))
    found = {}
    for r in sums.collect():  # DIMENSIONS numbers for each language
        found.setdefault(r["lang"], np.zeros(DIMENSIONS))[r["i"]] = r["value"]
    names = sorted(x for x, v in found.items() if np.linalg.norm(v) > 0)
    return names, np.array([found[x] / np.linalg.norm(found[x]) for x in names], np.float32).reshape(-1, DIMENSIONS)


def comparer(names: list[str], vectors: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundler = Bundler()
        for batch in batches:
            for part in chunks(batch, "text"):
                if names:
                    own = bundler.bundle(part.column("text"))
                    cosines = own @ vectors.T
                    best = cosines.argmax(axis=1)
                    some = own.any(axis=1)
                    langs = [names[b] if s else "und" for b, s in zip(best.tolist(), some.tolist(), strict=True)]
                    scores = np.where(some, np.clip(cosines.max(axis=1), 0, 1), 0).astype(np.float64)
                else:
                    langs, scores = ["und"] * part.num_rows, np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row doc_id, lang_pred, score (the cosine, negative ones as 0)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(comparer(*model), "doc_id bigint, lang_pred string, score double")
