"""Toxicity: a weighted lexicon, matched by Aho-Corasick in folded text.

Folding lower-cases, composes accents and drops marks that compose with nothing, writes homoglyphs of other scripts as the Latin letters that they look like, and
undoes digits and signs put for letters. Lexicon entries are whole folded words; a match inside a longer word doesn't
count, nor does one inside an exception phrase. Words, weights (smoothed log-odds) and exception phrases (a word with
its neighbours that only clean documents hold) are learned from labelled documents: candidates are counted in Spark,
then taken greedily, each for toxic documents that those before it leave unexplained, so words that merely stand beside
toxic ones stay out. The sum of weights, also divided by the text's length, goes to a logistic regression.

The sample holds at most `size` labelled ids outside the held-out fold (a parameter; nothing else is bounded): all of its
words that occur in `least` toxic documents, and in as many of them as of clean ones, are candidates.
Null and empty texts match nothing and get the score of a text without matches. A null doc_id is scored as any other row
and never labelled. Without labels or toxic examples all scores are 0. Of candidates with equal gain the last in the
alphabet goes first. Repeated rows each give a row; an empty table gives none; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .samples import labelled_sample
from .tokens import chunks, split_words

SAMPLE = 40_000
#: Letters of other scripts and the Latin letters that they look like, then digits and signs put for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ɡ": "g", "ո": "n", "ս": "u",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ħ": "h",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "l"}
TABLE = {ord(a): b for a, b in (HOMOGLYPHS | DIGITS).items()} | dict.fromkeys([*range(0x300, 0x370), 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD])
SIGN = re.compile(r"(?<=[a-z])[@$!|](?=[a-z])")
WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.translate(TABLE)
    return SIGN.sub(lambda m: SIGNS[m[0]], text)


def term_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, toxic, n): in how many texts of this batch each folded word is."""
    for batch in batches:
        for part in chunks(batch, "text"):
            found = (Counter(), Counter())
            for y, text in zip(part.column("y").to_pylist(), part.column("text").to_pylist(), strict=True):
                found[y > 0].update(set(WORD.findall(fold(text or ""))))
            rows = [(w, y, n) for y in (0, 1) for w, n in found[y].items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int64()), strict=True)], names=["term", "toxic", "n"])


def holder(terms: list[str]):
    """For each labelled text: y, its number of words, and of each occurrence of a term the term, and it with the word
    before and with the word behind."""
    wanted = frozenset(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                rows = []
                for y, text in zip(part.column("y").to_pylist(), part.column("text").to_pylist(), strict=True):
                    words = WORD.findall(fold(text or ""))
                    at = [i for i, w in enumerate(words) if w in wanted]
                    rows.append((int(y > 0), len((text or "").split()), [words[i] for i in at], [" ".join(words[max(0, i - 1) : i + 1]) for i in at], [" ".join(words[i : i + 2]) for i in at]))
                kinds = (pa.int32(), pa.int64(), *[pa.list_(pa.string())] * 3)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["y", "n_words", "terms", "before", "behind"])

    return run


def inputs(weight: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """What the regression sees of a text: whether it matches, how much, and how much for its length."""
    length = 1 + n_words
    return np.stack([weight > 0, np.log1p(weight), weight / np.sqrt(length), weight / length], axis=1).astype(np.float64)


def regress(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Coefficients and, last, the bias, by Newton's method with a ridge on the coefficients."""
    full = np.column_stack([x, np.ones(len(x))])
    beta, penalty = np.zeros(full.shape[1]), np.diag([ridge] * x.shape[1] + [1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(full @ beta, -30, 30)))
        step = np.linalg.solve(full.T @ (full * (p * (1 - p) + 1e-9)[:, None]) + penalty, full.T @ (y - p) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


class Model:
    def __init__(self, weights: dict[str, float], exceptions: set[str], beta: np.ndarray | None) -> None:
        self.weights, self.exceptions, self.beta = weights, exceptions, beta

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for phrase in sorted(self.weights.keys() | self.exceptions):
            found.add_word(phrase, phrase)
        found.make_automaton()
        return found

    def matches(self, automaton, text: str) -> list[tuple[int, str]]:
        """(start, term) of the matches that count, in the folded text."""
        folded = fold(text)
        hits = [(end - len(x) + 1, end + 1, x) for end, x in automaton.iter(folded)]
        hits = [(a, b, x) for a, b, x in hits if not (a and folded[a - 1].isalnum()) and not (b < len(folded) and folded[b].isalnum())]
        out = [(a, b) for a, b, x in hits if x in self.exceptions]
        return [(a, x) for a, b, x in hits if x in self.weights and not any(s <= a and b <= e for s, e in out)]

    def probability(self, weight: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        if self.beta is None:
            return np.zeros(len(weight))
        return 1 / (1 + np.exp(-np.clip(inputs(weight, n_words) @ self.beta[:-1] + self.beta[-1], -50, 50)))


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", size: int = SAMPLE, least: int = 3) -> Model:
    """least: a word must explain so many toxic documents of the sample that no word before it does."""
    sample = labelled_sample(docs, labels, target, size)
    counts = sample.mapInArrow(term_counter, "term string, toxic int, n bigint").groupBy("term").agg(F.sum(F.col("n") * F.col("toxic")).alias("bad"), F.sum("n").alias("n"))
    terms = [r["term"] for r in counts.where(f"bad >= {least} and bad * 2 >= n").select("term").collect()]  # words of `size` labelled ids, as rare as `least` allows
    rows = sample.mapInArrow(holder(terms), "y int, n_words bigint, terms array<string>, before array<string>, behind array<string>").collect()  # at most `size` labelled ids
    y = np.array([r["y"] for r in rows], np.float64)
    if not y.sum():
        return Model({}, set(), None)
    # phrases with a word on one side at least, that clean texts hold and toxic ones don't
    phrases = [{p for p in (*r["before"], *r["behind"]) if " " in p} for r in rows]
    seen = Counter(p for r, own in zip(rows, phrases, strict=True) if not r["y"] for p in own)
    toxic = {p for r, own in zip(rows, phrases, strict=True) if r["y"] for p in own}
    exceptions = {p for p, n in seen.items() if n >= least and p not in toxic}
    counted = [Counter(t for t, a, b in zip(r["terms"], r["before"], r["behind"], strict=True) if a not in exceptions and b not in exceptions) for r in rows]
    has = {t: set() for t in terms}
    for i, own in enumerate(counted):
        for t in own:
            has[t].add(i)
    bad = {i for i, r in enumerate(rows) if r["y"]}
    # what a word explains only shrinks as others are taken, so the head of the queue, counted anew, is the best if it stays
    queue = [(3 * len(has[t] - bad) - len(has[t] & bad), -i, t) for i, t in enumerate(sorted(has))]
    heapq.heapify(queue)
    left, clean, weights = set(bad), len(rows) - len(bad), {}
    while queue and -queue[0][0] >= least:
        _, i, best = heapq.heappop(queue)
        own = has[best]
        new = len(own & left) - 3 * len(own - bad)
        if new < least:
            continue
        if queue and new < -queue[0][0]:
            heapq.heappush(queue, (-new, i, best))
            continue
        weights[best] = float(np.log((len(own & bad) + 0.5) / (len(bad) + 1)) - np.log((len(own - bad) + 0.5) / (clean + 1)))
        left -= own
    weights = {t: w for t, w in weights.items() if w > 0}
    if not weights:
        return Model({}, set(), None)
    total = np.array([sum(weights.get(t, 0) * n for t, n in own.items()) for own in counted])
    beta = regress(inputs(total, np.array([r["n_words"] for r in rows], np.float64)), y)
    return Model(weights, {p for p in exceptions if any(w in weights for w in p.split())}, beta)


def scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton() if model.weights else None
        for batch in batches:
            for part in chunks(batch, "text"):
                n_words = np.diff(split_words(part.column("text"))[0])
                found = [model.matches(automaton, t) if automaton and t else [] for t in part.column("text").to_pylist()]
                weight = np.array([sum(model.weights[x] for _, x in f) for f in found], np.float64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(model.probability(weight, n_words.astype(np.float64))), pa.array([[{"at": a, "term": x} for a, x in f] for f in found], pa.list_(pa.struct([("at", pa.int32()), ("term", pa.string())])))],
                    names=["doc_id", "score", "matches"],
                )

    return run


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row doc_id, score (the probability of label 1), matches (place in the folded text, term)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(scorer(model), "doc_id bigint, score double, matches array<struct<at: int, term: string>>")
