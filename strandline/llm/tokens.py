"""Word splitting and hashing in Arrow and numpy, for the operators that run in Python workers."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: A piece of a batch holds about so many bytes of text, or one longer text.
CHUNK_BYTES = 2 << 20
ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's finish)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def give_back() -> None:
    """Return freed memory to the system: workers live on between tasks, and allocators would keep what one task needed."""
    if pa.default_memory_pool().backend_name != "system":
        pa.set_memory_pool(pa.system_memory_pool())
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run):
    """A function of batches that gives its memory back when it ends: a worker that then idles beside others would keep it."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped


def trimmed_group(run):
    """The same for a function of one group."""

    def wrapped(group: pa.Table) -> pa.Table:
        out = run(group)
        del group
        give_back()
        return out

    return wrapped


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batch, in order, each of about `most` bytes in the column."""
    if not batch.num_rows:
        return
    give_back()
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, end - start)
        start = end
    give_back()


def split_words(text: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(offsets, words): the words `[^\\x20\\x09-\\x0D]+` of all texts, one after the other; a null text has none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(text, ""))
    offsets, flat = lists.offsets.to_numpy().astype(np.int64), lists.flatten()
    offsets = offsets - offsets[0]
    some = pc.greater(pc.binary_length(flat), 0)
    kept = np.concatenate(([0], np.cumsum(some.to_numpy(zero_copy_only=False))))
    return kept[offsets].astype(np.int64), flat.filter(some)


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word; each distinct word is hashed once."""
    coded = words.dictionary_encode()
    digest = xxhash.xxh3_64_intdigest
    own = np.fromiter((digest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()), dtype=np.uint64, count=len(coded.dictionary))
    return own[coded.indices.to_numpy()] if len(own) else np.zeros(0, np.uint64)


def word_hash_pairs(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each word, the halves of one of 128 bits."""
    coded = words.dictionary_encode()
    digest = xxhash.xxh3_128_digest
    own = np.frombuffer(b"".join(digest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()), "<u8").reshape(-1, 2)
    index = coded.indices.to_numpy()
    return own[index, 0], own[index, 1]


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp: the polynomial hash, modulo 2^64, of the window of `width` words that starts at each word."""
    n = max(0, len(hashes) - width + 1)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out *= ODD
        out += hashes[i : i + n]
    return mix(out)
