"""Memory of what Python workers run, by bytes a window: a worker shares its executor's memory with the JVM and another one."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

from strandline.llm import substring

WIDTH, BUCKETS, DOCS, WORDS = 13, 16, 1600, 300


def batches(docs: int, words: int) -> list[pa.RecordBatch]:
    """Texts of random words, of which every fourth ends as the one before."""
    draw = np.random.default_rng(3)
    texts = draw.integers(0, 1 << 40, (docs, words))
    texts[3::4, words // 2 :] = texts[2::4, words // 2 :]
    text = pa.array([" ".join(map(str, t)) for t in texts.tolist()])
    return [pa.RecordBatch.from_arrays([pa.array(np.arange(docs)), pa.array(np.zeros(docs, np.int64)), text], names=["id", "crc", "text"])]


def peak(run) -> tuple[object, int]:
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_bucket_is_settled_in_little_more_than_its_hashes():
    packed = [r for part in (0, 1) for r in substring.hasher(WIDTH, 1)(iter([b.slice(part * DOCS // 2, DOCS // 2) for b in batches(DOCS, WORDS)]))]
    bucket = pa.Table.from_batches(packed)
    windows = sum(bucket["n"].to_pylist())
    settled, most = peak(lambda: substring.settler(BUCKETS)(bucket))
    covered = substring.gather(settled)
    assert covered["id"].to_pylist() == list(range(3, DOCS, 4))
    assert {len(x) // 4 for x in covered["places"].to_pylist()} == {WORDS // 2 - WIDTH + 1}
    assert windows > 400_000 and most < 60 * windows, most / windows


def test_a_map_task_packs_a_flush_in_pieces():
    packed = [r.num_rows for r in substring.hasher(WIDTH, BUCKETS)(iter(batches(DOCS, WORDS)))]
    assert len(packed) > 1 and BUCKETS <= sum(packed) <= BUCKETS + 1
    assert max(packed) < BUCKETS
