"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted over all documents.

Map tasks hash every window twice, by independent word hashes; the second hash chooses the bucket, and per bucket one
packed row of (first hash, document, place) is sent. What a task sees twice it settles itself: of equal windows of one
document it sends the first, of those of several documents that of the smallest, and marks the others as covered, so a
window that a third of the documents share costs each reducer a row per task, not per document. A reducer sorts one bucket,
marks windows that also start in a smaller document, and returns their places, packed by parts of the document ids; a
second one gathers a document's places. Equal windows of those documents are found again in their texts, and the windows
merge into maximal intervals. Buckets grow in number with the input, so that one fits in a worker, and each has a task.

Windows are equal if their first hashes and their buckets are. As buckets hold about BUCKET_BYTES of input each, the bits
compared grow with the input: N windows in N / c buckets make c N / 2^65 false pairs to expect, 0.4 for 10^13 windows.

Nulls, empty texts: no words, nothing removed. Texts shorter than a window stay. A null doc_id counts as larger than every
other. Rows that repeat a doc_id don't cover one another; identical rows each give a row. Extra columns of the input are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, plan_bytes
from .tokens import chunks, mix, rolling, split_words, trimmed, trimmed_group, word_hash_pairs

NO_ID = (1 << 63) - 1
#: A map task packs so many windows at a time; a bucket is for so many bytes of (compressed) input.
FLUSH_WINDOWS, BUCKET_BYTES = 1 << 20, 4 << 20
#: Hashes are sorted in ranges by so many high bits; a batch of packed rows holds about so many bytes, or one row.
SLICE_BITS, BATCH_BYTES = 4, 2 << 20
WORD = re.compile(r"[^ \t-\r]+")
PACKED = "bucket int, n int, n_docs int, docs binary, counts binary, hashes binary, places binary"
SETTLED = "part int, n int, ids binary, crcs binary, places binary"
COVERED = "id bigint, crc bigint, places binary"
INTERVALS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
SPLIT = [T.StructField("kept_text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("removed", INTERVALS)]


def _zip(a: np.ndarray) -> bytes:
    return pa.compress(a.tobytes(), codec="zstd", asbytes=True)


def _unzip(blob: bytes, dtype: type, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, n * np.dtype(dtype).itemsize, codec="zstd", asbytes=True), dtype)


def _pack(bucket: int, doc: np.ndarray, place: np.ndarray, hashes: np.ndarray | None, ids: np.ndarray) -> tuple:
    """doc ascending, and place within it: indices into ids, which holds (id, crc) rows. Places go as steps from the one
    before, low bytes and the rest apart, of which the rest is nearly all zeros."""
    first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    counts = np.diff(np.append(first, len(doc)))
    steps = np.diff(place.astype(np.int64), prepend=0)
    steps[first] = place[first]
    planes = steps.astype("<u4").view(np.uint8).reshape(-1, 4).T.ravel()
    return bucket, len(doc), len(first), _zip(ids[doc[first]].T.copy()), _zip(counts.astype("<u4")), b"" if hashes is None else hashes.tobytes(), _zip(planes)


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, crcs, places), an entry each."""
    ids, crcs, counts = _documents(row)
    return np.repeat(ids, counts), np.repeat(crcs, counts), _places(row, counts)


def _documents(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, crcs, counts) of the documents of a packed row."""
    counts = np.frombuffer(pa.decompress(row["counts"], 4 * row["n_docs"], codec="zstd", asbytes=True), "<u4")
    return (*_unzip(row["docs"], np.int64, 2 * len(counts)).reshape(2, -1), counts)


def _places(row: dict, counts: np.ndarray) -> np.ndarray:
    steps = np.ascontiguousarray(_unzip(row["places"], np.uint8, 4 * row["n"]).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
    total, first = np.cumsum(steps), np.cumsum(counts) - counts
    return total - np.repeat(total[first] - steps[first], counts)


def _slices(hashes: np.ndarray) -> Iterator[np.ndarray]:
    """The indices of the hashes of each range by SLICE_BITS that has any: equal ones fall together, and a sort of one range
    needs a small part of the memory that a sort of all would take."""
    high = (hashes >> np.uint64(64 - SLICE_BITS)).astype(np.uint8)
    for s in range(1 << SLICE_BITS):
        at = np.flatnonzero(high == s)
        if len(at):
            yield at


def window_hashes(text: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first hash, second hash, document, place) of every window of these texts."""
    offsets, words = split_words(text)
    one, two = (rolling(h, width) for h in word_hash_pairs(words))
    counts = np.maximum(0, np.diff(offsets) - width + 1)
    docs = np.repeat(np.arange(len(counts)), counts)
    places = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = offsets[:-1][docs] + places
    return one[starts], two[starts], docs, places.astype(np.uint32)


def hasher(width: int, buckets: int):
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), ("n_docs", pa.int32()), ("docs", pa.binary()), ("counts", pa.binary()), ("hashes", pa.binary()), ("places", pa.binary())])

    def batch_of(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def flush(held: list, ids: list) -> Iterator[pa.RecordBatch]:
        columns = [list(x) for x in zip(*held, strict=True)]
        held.clear()
        hashes, bucket, docs, places = (np.concatenate(columns.pop(0)) for _ in range(4))
        known = np.array(ids, np.int64).reshape(-1, 2)
        # of equal windows of one document the first speaks for all, and says so in the low bit of its place; a stable sort
        # by hash keeps documents and places in order
        places *= np.uint32(2)
        sent, covered = np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
        for order in _slices(hashes):
            order = order[np.argsort(hashes[order], kind="stable")]
            h, k, d = hashes[order], bucket[order], docs[order]
            new = np.concatenate(([True], (h[1:] != h[:-1]) | (k[1:] != k[:-1])))
            heads = np.flatnonzero(new | np.concatenate(([True], d[1:] != d[:-1])))
            many = np.diff(np.append(heads, len(order))) > 1
            order, new, d = order[heads], new[heads], known[d[heads], 0]
            places[order[many]] += np.uint32(1)
            first = np.flatnonzero(new)
            mine = d == np.repeat(np.minimum.reduceat(d, first), np.diff(np.append(first, len(d))))
            sent[order[mine]], covered[order[~mine]] = True, True
        rows, held_bytes = [], 0
        if covered.any():
            rows.append(_pack(int(bucket[0]), docs[covered], places[covered], None, known))
        order = np.flatnonzero(sent)
        order = order[np.argsort(bucket[order].astype(np.uint16) if buckets <= 1 << 16 else bucket[order], kind="stable")]
        edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        for own in np.split(order, edges[1:]):
            rows.append(_pack(int(bucket[own[0]]), docs[own], places[own], hashes[own], known))
            held_bytes += 8 * len(own)
            if held_bytes >= BATCH_BYTES:
                yield batch_of(rows)
                rows, held_bytes = [], 0
        if rows:
            yield batch_of(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, windows = [], [], 0
        for batch in batches:
            for part in chunks(batch, "text"):
                one, two, docs, places = window_hashes(part.column("text"), width)
                if len(one):
                    held.append((one, (two % np.uint64(buckets)).astype(np.int32), (docs + len(ids)).astype(np.int32), places))
                ids += zip(part.column("id").to_pylist(), part.column("crc").to_pylist(), strict=True)
                windows += len(one)
                if windows >= FLUSH_WINDOWS:
                    yield from flush(held, ids)
                    held, ids, windows = [], [], 0
        if windows:
            yield from flush(held, ids)

    return run


def spread(starts: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The places of all windows of a document that are equal to one of those at `starts`."""
    if len(np.unique(one)) == len(one):
        return starts
    codes = np.unique(np.stack([one, two]), axis=1, return_inverse=True)[1].ravel()
    covered = np.zeros(codes.max() + 1, bool)
    covered[codes[starts]] = True
    return np.flatnonzero(covered[codes])


def _by_document(ids: np.ndarray, crcs: np.ndarray, places: np.ndarray) -> pa.Table:
    order = np.lexsort((places, crcs, ids))
    ids, crcs, places = ids[order], crcs[order], places[order]
    new = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (crcs[1:] != crcs[:-1])))) if len(ids) else np.zeros(0, np.int64)
    ends = np.append(new[1:], len(ids))[: len(new)]
    return pa.table({"id": pa.array(ids[new]), "crc": pa.array(crcs[new]), "places": pa.array([places[a:b].astype("<u4").tobytes() for a, b in zip(new, ends, strict=True)], pa.binary())})


def settler(parts: int):
    def settle(bucket: pa.Table) -> pa.Table:
        """The covered windows of one bucket, packed by parts of the document ids."""
        rows = [{c: x.as_buffer() if pa.types.is_binary(x.type) else x.as_py() for c, x in zip(bucket.column_names, own, strict=True)} for batch in bucket.to_batches() for own in zip(*batch.columns, strict=True)]
        done = [_unpack(r) for r in rows if not len(r["hashes"])]
        open_ = [(r, np.frombuffer(r["hashes"], np.uint64)) for r in rows if len(r["hashes"])]
        if open_:
            told = [_documents(r) for r, _ in open_]
            known = np.unique(np.concatenate([ids for ids, _, _ in told]))
            rank = np.concatenate([np.repeat(np.searchsorted(known, ids).astype(np.int32), counts) for ids, _, counts in told])
            hashes, covered = np.concatenate([h for _, h in open_]), np.zeros(len(rank), bool)
            for order in _slices(hashes):
                order = order[np.argsort(hashes[order], kind="stable")]
                h, d = hashes[order], rank[order]
                first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
                covered[order[d > np.repeat(np.minimum.reduceat(d, first), np.diff(np.append(first, len(d))))]] = True
            del hashes, rank
            starts = np.cumsum([0, *(r["n"] for r, _ in open_)]).tolist()
            for (r, _), (ids, crcs, counts), a in zip(open_, told, starts[:-1], strict=True):
                own = covered[a : a + r["n"]]
                if own.any():
                    at = np.repeat(np.arange(len(ids)), counts)[own]
                    done.append((ids[at], crcs[at], _places(r, counts)[own]))
        done.append((np.zeros(0, np.int64),) * 3)
        ids, crcs, places = (np.concatenate(x) for x in zip(*done, strict=True))
        del done
        part = (mix(ids.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((places, crcs, ids, part))
        ids, crcs, places, part = ids[order], crcs[order], places[order], part[order]
        out = []
        for p in np.unique(part).tolist():
            a, b = np.searchsorted(part, (p, p + 1)).tolist()
            out.append((p, b - a, _zip(ids[a:b]), _zip(crcs[a:b]), _zip(places[a:b].astype("<u4"))))
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        columns = zip(*out, strict=True) if out else [[]] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["part", "n", "ids", "crcs", "places"])

    return settle


def gather(part: pa.Table) -> pa.Table:
    """One row for each document of a part that has covered windows: all their places."""
    found = [(_unzip(r["ids"], np.int64, r["n"]), _unzip(r["crcs"], np.int64, r["n"]), _unzip(r["places"], np.uint32, r["n"])) for r in part.to_pylist()]
    return _by_document(*(np.concatenate(x) for x in zip(*found, strict=True)))


def cutter(width: int):
    def cut(text: str, mask: np.ndarray) -> tuple[str, list]:
        edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
        spans = [m.start() for m in WORD.finditer(text)]
        out, at, removed = [], 0, []
        for a, b in edges.reshape(-1, 2).tolist():
            out.append(text[at : spans[a]])
            at = spans[b] if b < len(spans) else len(text)
            removed.append({"start": a, "end": b})
        return "".join(out) + text[at:], removed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                n_words = np.diff(split_words(part.column("text"))[0])
                kept, removed = part.column("text"), [[]] * part.num_rows
                places = part.column("places")
                some = np.flatnonzero(pc.is_valid(places).to_numpy(zero_copy_only=False))
                if len(some):
                    kept = kept.to_pylist()
                    for i in some.tolist():
                        marked = np.frombuffer(places[i].as_py(), "<u4").astype(np.int64)
                        starts = marked >> 1
                        if (marked & 1).any():
                            one, two, _, _ = window_hashes(part.column("text").slice(i, 1), width)
                            starts = spread(starts, one, two)
                        edge = np.bincount(starts, minlength=n_words[i] + 1)[: n_words[i] + 1] > 0
                        since = np.maximum.accumulate(np.where(edge, np.arange(n_words[i] + 1), -width))
                        kept[i], removed[i] = cut(kept[i], (np.arange(n_words[i] + 1) - since < width)[:-1])
                through = [n for n in part.schema.names if n != "places"]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(n) for n in through), pa.array(kept, pa.string()) if len(some) else kept, pa.array(n_words, pa.int64()), pa.array(removed, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                    names=[*through, "kept_text", "n_words", "removed"],
                )

    return run


def substring_dedup(docs: DataFrame, width: int = 13, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row doc_id, text, kept_text (the text without its removed words and the white space behind each; null stays),
    n_words, removed (maximal word intervals, end excluded), and a struct `carried` of the columns in `carry`.

    A word goes if a window of `width` words around it also starts in a document with a smaller id.
    """
    own = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"), *carried(docs, carry))
    rows = own.withColumn("id", F.coalesce("doc_id", F.lit(NO_ID)))
    # only where ids repeat does a row need more than its id to be told from others
    repeated = rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() > 0
    rows = rows.withColumn("crc", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")) if repeated else F.lit(0).cast("long"))
    buckets = max(16, -(-plan_bytes(docs.select(text)) // BUCKET_BYTES))
    packed = rows.select("id", "crc", "text").mapInArrow(trimmed(hasher(width, buckets)), PACKED)
    # as many tasks as buckets, so that what one reads doesn't grow with the input
    settled = packed.repartitionById(buckets, "bucket").groupBy("bucket").applyInArrow(trimmed_group(settler(buckets)), SETTLED)
    covered = settled.repartitionById(buckets, "part").groupBy("part").applyInArrow(trimmed_group(gather), COVERED)
    joined = rows.join(covered.hint("shuffle_hash"), ["id", "crc"], "left").select(*own.columns, "places")
    return joined.mapInArrow(trimmed(cutter(width)), T.StructType([*own.schema.fields, *SPLIT]))
