"""Decontamination, near-duplicates, substring dedup, WARC, packing and fingerprints against brute force on small cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import common, queries
from strandline.llm.components import components
from strandline.llm.decontaminate import decontaminate, proximity
from strandline.llm.fingerprint import compare_edits, fingerprints
from strandline.llm.near_dup import banding, least_matches, near_duplicates
from strandline.llm.packing import SumIndex, WordTokenizer, pack, plan
from strandline.llm.substring import substring_dedup
from strandline.llm.warc import parse, read_records, record, resolve, write_archives

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, id int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus(seed=1, n=60, vocabulary=400):
    """Texts with exact and near copies, shared passages, repeated words, nulls, empties, odd characters and one long text."""
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["Ünder", "naïve", "中文", "don't", "A.B"]
    texts = [" ".join(draw.choices(words, k=draw.choice([1, 2, 5, 14, 40, 90]))) for _ in range(n)]
    for i in range(0, n, 6):
        own = draw.choice(texts).split()
        if len(own) > 20:
            own[draw.randrange(len(own))] = "edit"
        texts.append(" ".join(own))
    texts += [texts[3], texts[3] + "\n", "", "  \n\t", None, "same " * 50, "Same " * 50, " ".join(draw.choices(words, k=6000))]
    passage = " ".join(draw.choices(words, k=30))
    texts += [f"{draw.choice(words)} {passage} {draw.choice(words)}" for _ in range(12)]
    return list(enumerate(texts))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None, 0.5, "x", 1) for i, t in rows], DOCS)


def words_of(text, pattern):
    return re.findall(pattern, text or "")


def test_decontaminate_matches_brute_force(spark):
    rows = corpus()
    draw = random.Random(2)
    items = [(k, " ".join(t.split()[4:30])) for k, (_, t) in enumerate(draw.sample([r for r in rows if r[1] and len(r[1].split()) > 20], 8))]
    items += [(90, "w1"), (91, "w1"), (92, ""), (93, None), (94, "!!"), (95, "W2, w3"), (None, "w7 w8"), (0, items[0][1])]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, terms string")
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    cut = {}
    for i, t in items:
        ws = words_of(t and t.translate(LOWER), pattern)
        w = min(13, len(ws))
        for s in range(len(ws) - w + 1 if ws else 0):
            cut.setdefault(tuple(ws[s : s + w]), set()).add(i)
    expected = {}
    for i, t in rows:
        ws, hit, found = words_of(t and t.translate(LOWER), pattern), set(), set()
        for w in {len(k) for k in cut}:
            for p in range(len(ws) - w + 1):
                if own := cut.get(tuple(ws[p : p + w])):
                    hit |= set(range(p, p + w))
                    found |= own - {None}
        expected[i] = (len(ws), sorted(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(ws))
    got = decontaminate(frame(spark, rows), bench, carry=("lang", "score")).collect()
    assert {r["doc_id"]: (r["n_words"], r["hits"], sorted(r["items"]), r["contaminated"]) for r in got} == expected
    assert all(r["carried"]["lang"] == "en" for r in got)
    assert decontaminate(frame(spark, []), bench).count() == 0
    assert {r["contaminated"] for r in decontaminate(frame(spark, rows), bench.limit(0)).collect()} == {False}


def test_decontaminate_repeated_and_null_ids(spark):
    item = " ".join(f"q{i}" for i in range(20))
    docs = frame(spark, [(1, item), (1, item), (1, "clean text"), (None, item), (None, None)])
    bench = spark.createDataFrame([(5, item)], "item_id long, text string")
    got = sorted((r["doc_id"] or -1, len(r["hits"])) for r in decontaminate(docs, bench).collect())
    assert got == [(-1, 0), (-1, 20), (1, 0), (1, 20), (1, 20)]


def test_decontaminate_words_repeated_without_end(spark):
    item, text = " ".join(["the"] * 200), " ".join(["the"] * 100_000)
    docs = frame(spark, [(1, text), (2, "the " * 12), (3, "a " * 300 + "the " * 13 + "b")])
    bench = spark.createDataFrame([(7, item), (8, item + " end")], "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["hits"], sorted(r["items"])) for r in decontaminate(docs, bench).collect()}
    assert got[1] == (100_000, list(range(100_000)), [7, 8])
    assert got[2] == (12, [], []) and got[3] == (314, list(range(300, 313)), [7, 8])


def test_decontaminate_across_blocks(spark):
    draw = random.Random(9)
    ws = [f"w{draw.randrange(30)}" for _ in range(1500)]
    items = [(k, " ".join(ws[a : a + n])) for k, (a, n) in enumerate([(0, 13), (245, 20), (250, 600), (1487, 13), (1490, 10), (511, 14)])]
    got = decontaminate(frame(spark, [(1, " ".join(ws))]), spark.createDataFrame(items, "item_id long, text string")).first()
    assert sorted(got["items"]) == [0, 1, 2, 3, 4, 5]
    cut = {tuple(t.split()[s : s + 13]) for _, t in items for s in range(max(1, len(t.split()) - 12))}
    assert got["hits"] == sorted({q for c in cut for p in range(1500) if tuple(ws[p : p + len(c)]) == c for q in range(p, p + len(c))})


def test_proximity_edges(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (1, "alpha beta"), (None, "alpha beta"), (2, ""), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "alpha beta"), (None, "beta alpha"), (2, None), (3, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in proximity(docs, bench, slop=1).collect()}
    assert got == {(1, 1), (None, 1)}
    assert proximity(docs.limit(0), bench).count() == 0 and proximity(docs, bench.limit(0)).count() == 0


def test_proximity(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "alpha x beta gamma"), (2, "alpha beta gamma"), (3, "alpha x x x x x x beta gamma"), (4, None)], "doc_id long, text string")
    assert {r["doc_id"] for r in proximity(docs, bench, slop=2).collect()} == {1, 2}


def test_proximity_matches_brute_force(spark):
    rows, slop = [], 3
    for a in range(12, 20):
        for d in range(-4, 5):
            for e in range(-4, 5):
                places = {a + d: "alpha", a + 1: "beta", a + e + 2: "gamma"}
                if len(places) == 3:
                    rows.append((len(rows), " ".join(places.get(i, f"f{i}") for i in range(30))))
    rows += [(len(rows) + i, "alpha gamma") for i in range(5)]  # so that the middle word is the rarest
    rows += [(len(rows) + i, "alpha x x gamma x alpha beta x x alpha x gamma beta") for i in range(2)]
    item = ["alpha", "beta", "gamma"]
    counts = {t: sum(text.split().count(t) for _, text in rows) for t in item}
    first, *rest = sorted(range(3), key=lambda p: (counts[item[p]], p))
    assert first == 1
    expected = set()
    for i, text in rows:
        shifts = [[at - p for at, w in enumerate(text.split()) if w == item[p]] for p in range(3)]
        expected |= {(i, 1, a) for a in shifts[first] if all(any(abs(s - a) <= slop for s in shifts[p]) for p in rest)}
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in proximity(docs, bench, slop=slop).collect()} == expected


def brute_components(rows, k, num, den):
    sets = {}
    for i, t in rows:
        ws = words_of(t and t.translate(LOWER), r"[^\x20\x09-\x0D]+")
        sets[i] = {tuple(ws[j : j + k]) for j in range(len(ws) - k + 1)} if len(ws) >= k else {tuple(ws)} - {()}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                both = len(sets[x] & sets[y])
                if den * both >= num * (len(sets[x]) + len(sets[y]) - both):
                    a, b = sorted((root(x), root(y)))
                    parent[b] = a
    return {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


@pytest.mark.parametrize(("k", "similarity", "num", "small"), [(3, "0.85", 85, True), (5, "0.8", 80, False)])
def test_near_duplicates_match_brute_force(spark, k, similarity, num, small, monkeypatch):
    if not small:  # as on tables too large to broadcast
        monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(common, "KEYS_BYTES", 0)
    rows = corpus(3)
    draw = random.Random(4)
    base = [f"b{i}" for i in range(120)]
    for i in range(60):  # a chain and a cloud of copies about the threshold
        own = list(base)
        for _ in range(draw.randrange(0, 9)):
            own[draw.randrange(len(own))] = f"e{i}-{draw.randrange(99)}"
        rows.append((1000 + i, " ".join(own)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(frame(spark, rows), k, similarity).collect()}
    assert got == brute_components(rows, k, num, 100)


def test_what_is_left_meets_by_bucket_or_by_cluster(spark):
    """Nodes 0 to 29 in a chain of buckets of three (by bucket), 100 to 129 all in five buckets (by cluster)."""
    from fractions import Fraction

    from strandline.llm.near_dup import _Search

    draw = random.Random(14)
    sets = {i: {*range(10 * (i // 2), 10 * (i // 2) + 10)} | {1000 + i} for i in range(30)} | {i: {*range(500, 560), *draw.sample(range(600, 700), 6)} for i in range(100, 130)}
    bands = [(b, i) for b in range(28) for i in (b, b + 1, b + 2)] + [(100 + b, i) for b in range(5) for i in range(100, 130)]
    around = spark.createDataFrame([(b, i, i, len(sets[i]), len(sets[i])) for b, i in bands], "band long, node long, comp long, n_shingles long, shared long")
    shared = spark.createDataFrame([(i, x) for i, s in sets.items() for x in s], "node long, shingle long")
    search = _Search.__new__(_Search)
    search.similarity, search.scratch = Fraction("0.8"), []
    got = {tuple(r) for r in search.all_left(around, shared).collect()}
    expected = {(u, v) for u in sets for v in sets if u < v and 10 * len(sets[u] & sets[v]) >= 8 * len(sets[u] | sets[v]) and any((b, u) in bands and (b, v) in bands for b in {b for b, _ in bands})}
    assert got == expected and any(u < 30 for u, _ in got) and any(u >= 100 for u, _ in got)


def test_near_duplicates_edges(spark):
    got = near_duplicates(frame(spark, [(5, "a b c d"), (5, "a b c d"), (3, "a b c d"), (None, "a b c d"), (7, ""), (8, None)]), 3, "0.85").collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in got) == [(-1, -1, True), (3, 3, True), (5, 3, False), (5, 3, False), (7, 7, True), (8, 8, True)]
    assert near_duplicates(frame(spark, []), 3, "0.85").count() == 0


def test_banding_and_pruning_bounds():
    for s in (0.8, 0.85, 0.9):
        bands, rows = banding(s)
        assert bands * rows <= 120 and (1 - s**rows) ** bands <= 1e-6
    assert all(0 < m < n * 0.85 for n, m in least_matches(0.85) if n > 20)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 150: 100, 200: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_substring_matches_brute_force(spark):
    rows = corpus(5)
    first = {}
    for i, t in sorted(rows):
        ws = words_of(t, r"[^\x20\x09-\x0D]+")
        for p in range(len(ws) - 12):
            first.setdefault(tuple(ws[p : p + 13]), i)
    expected = {}
    for i, t in rows:
        ws, gone = words_of(t, r"[^\x20\x09-\x0D]+"), set()
        for p in range(len(ws) - 12):
            if first[tuple(ws[p : p + 13])] < i:
                gone |= set(range(p, p + 13))
        expected[i] = (len(ws), gone, " ".join(w for q, w in enumerate(ws) if q not in gone))
    got = substring_dedup(frame(spark, rows).repartition(3), carry=("score", "id")).collect()
    assert {r["doc_id"]: (r["n_words"], {q for x in r["removed"] for q in range(x["start"], x["end"])}, " ".join((r["kept_text"] or "").split())) for r in got} == expected
    for r in got:
        assert r["removed"] or r["kept_text"] == r["text"]
        assert all(a["end"] < b["start"] for a, b in zip(r["removed"], r["removed"][1:]))
    assert substring_dedup(frame(spark, [])).count() == 0


def test_substring_equal_windows_of_one_document(spark):
    """Windows that a document repeats, alone, beside copies in smaller and larger documents, and within one flush."""
    same, line = "same " * 40, " ".join(f"q{i}" for i in range(13))
    rows = [(1, f"{line} a {line}"), (2, f"b {line} c {line} {line}"), (3, same), (4, same + same), (5, f"x {line}"), (6, f"y y {same}z")]
    first, expected = {}, {}
    for i, t in rows:
        ws, gone = t.split(), set()
        for p in range(len(ws) - 12):
            if first.setdefault(tuple(ws[p : p + 13]), i) < i:
                gone |= set(range(p, p + 13))
        expected[i] = sorted(gone)
    for parts in (1, 6):
        got = substring_dedup(frame(spark, rows).repartition(parts, "doc_id")).collect()
        assert {r["doc_id"]: [q for x in r["removed"] for q in range(x["start"], x["end"])] for r in got} == expected


def test_substring_buckets_have_a_task_each(spark):
    docs = frame(spark, corpus(5))
    plan = substring_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2 and "hashpartitioning(bucket" not in plan and "hashpartitioning(part" not in plan


def test_substring_repeated_and_null_ids(spark):
    t = " ".join(f"z{i}" for i in range(15))
    got = substring_dedup(frame(spark, [(1, t), (1, t), (1, t + " end"), (2, t), (None, t), (None, None)])).collect()
    assert sorted((r["doc_id"] or -1, sum(x["end"] - x["start"] for x in r["removed"])) for r in got) == [(-1, 0), (-1, 15), (1, 0), (1, 0), (1, 0), (2, 15)]


def test_warc_round_trip(spark):
    big = "<p>" + "x" * 200 + "é</p>"
    rows = [(4, "http://a", big), (2, "http://b", big), (9, None, big), (1, "http://s", "tiny"), (3, "http://t\r\nX: y", "tiny"), (5, "u", None), (6, "u", ""), (None, "n", big), (7, "long", "y" * 300_000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, first int")
    index = write_archives(pages)
    assert index.count() == len(rows)
    got = {r["page_id"]: r for r in resolve(read_records(index)).collect()}
    for i, _, html in rows:
        data, r = (html or "").encode(), got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha256(data).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", 2) if html == big and i != 2 else ("response", None))
        if r["record_type"] == "response":
            assert bytes(r["payload"]) == data
    chosen = read_records(index.where("page_id in (1, 7)")).collect()
    assert sorted(r["page_id"] for r in chosen) == [1, 7]
    assert read_records(write_archives(pages.limit(0))).count() == 0
    data = record("f:0", 3, "u", "d", "response", None, None, b"a\r\n\r\nb")
    fields, payload = parse(data)
    assert payload == b"a\r\n\r\nb" and fields["WARC-Type"] == "response" and fields["Content-Type"] == "application/http; msgtype=response"
    assert data.partition(b"\r\n\r\n")[2].startswith(b"HTTP/1.1 200 OK\r\n") and data.endswith(b"b\r\n\r\n")
    fields, payload = parse(record("f:9", 4, "v", "d", "revisit", 3, "u", b"x"))
    assert payload == b"" and fields["WARC-Refers-To-Target-URI"] == "u" and fields["Refers-To-Page-ID"] == "3"


def test_warc_files_are_gzip_members_with_names_of_their_own(spark, tmp_path):
    import gzip

    big = "z" * 150
    pages = spark.createDataFrame([(1, "a", big), (1, "b", big), (2, "c", big), (2, "c", big), (None, "d", big), (None, None, "s"), (None, None, "s")], "page_id long, url string, html string")
    index = write_archives(pages, f"file://{tmp_path}/warc")
    whole = b"".join(gzip.decompress(f.read_bytes()) for f in sorted((tmp_path / "warc").iterdir()))
    names = re.findall(rb"WARC-Record-ID: (\S+)", whole)
    assert len(names) == len(set(names)) == 7 and whole.count(b"WARC/1.1\r\n") == 7
    got = sorted(((r["page_id"], r["url"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in resolve(read_records(index)).collect()), key=repr)
    assert got == sorted([(1, "a", "response", None, 150), (1, "b", "response", None, 150), (2, "c", "revisit", 1, 150), (2, "c", "revisit", 1, 150), (None, "d", "revisit", 1, 150), (None, "", "response", None, 1), (None, "", "response", None, 1)], key=repr)
    assert whole.count(b"WARC-Refers-To-Target-URI: a\r\n") == 3


def test_keys_are_looked_up_alike_whatever_the_size(spark, monkeypatch):
    draw = random.Random(3)
    rows = spark.createDataFrame([(i, draw.choice(["hot"] * 400 + [f"k{j}" for j in range(300)] + [None])) for i in range(2000)], "id long, k string")
    table = common.stored(rows.where("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least")).where("n > 1"), "keys")
    ask = F.col("id") % 3 > 0
    told = lambda: sorted(map(tuple, common.looked_up(rows, table, "k", F.col("id"), ask).collect()), key=repr)
    small_ = told()
    least = {r["k"]: r["least"] for r in table.collect()}
    assert small_ == sorted(((r["id"], r["k"], least.get(r["k"]) if r["id"] % 3 else None) for r in rows.collect()), key=repr)
    monkeypatch.setattr(common, "KEYS_BYTES", 0)
    assert told() == small_


def test_plan_packs_every_piece_once():
    draw = random.Random(6)
    for _ in range(20):
        pieces = [min(64, int(draw.expovariate(1 / 20)) + 1) for _ in range(draw.randrange(1, 300))]
        counts = {x: pieces.count(x) for x in set(pieces)}
        found = plan(counts, 64)
        used = {}
        for times, lengths in found:
            assert times > 0 and sum(lengths) <= 64
            for x in lengths:
                used[x] = used.get(x, 0) + times
        assert used == counts
        assert sum(t for t, _ in found) <= -(-sum(pieces) // 64) + 2
    assert plan({}, 64) == []


def test_sum_index_finds_a_filling_whenever_there_is_one():
    """Against all combinations of one to three lengths, while counts fall as the plan lets them: the longest goes first."""
    from itertools import combinations_with_replacement

    draw = random.Random(17)
    for _ in range(60):
        capacity = draw.randrange(6, 40)
        counts = np.zeros(capacity + 1, np.int64)
        for _ in range(draw.randrange(1, 14)):
            counts[draw.randrange(1, capacity)] += draw.randrange(1, 4)
        index = SumIndex(counts)
        for longest in range(capacity - 1, 0, -1):
            while counts[longest]:
                found = index.fill(capacity - longest, longest)
                free = counts.copy()
                free[longest] -= 1
                possible = [c for n in (1, 2, 3) for c in combinations_with_replacement(range(1, capacity), n) if sum(c) == capacity - longest and all(free[x] >= c.count(x) for x in c)]
                assert (found is not None) == bool(possible) and (found is None or tuple(sorted(found)) in possible)
                for x in found or ():
                    counts[x] -= 1
                counts[longest] -= 1


def test_pack_matches_the_tokenizer(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    t = Tokenizer.from_file(path)
    rows = corpus(7) + [(500, "<|endoftext|> it's <|start"), (503, "<|ENDOFTEXT|> The End, the end. THE END... été, ÉTÉ. e\u0301te ß, İx don't 12a a12, ﬁn"), (501, "a b c é ΑΣ"), (502, "b" * 3000)]
    got = pack(frame(spark, rows).repartition(3), path).collect()
    expected = {}
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        for p in range(0, len(ids), 2048):
            own = ids[p : p + 2048]
            expected[i, p // 2048] = (p, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == expected
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= -(-sum(r["length"] for r in got) // 2048) + 1
    assert pack(frame(spark, []), path).count() == 0
    assert pack(frame(spark, [(None, None), (1, "a"), (1, "a")]), path).count() == 3
    assert WordTokenizer(path).stems_work and WordTokenizer(path).lowers


def entries(fingerprint):
    """bucket: tuple hash."""
    return {fingerprint[a : a + 2]: fingerprint[a + 2 : a + 8] for a in range(0, len(fingerprint), 8)}


def alike(a, b):
    either = a.keys() | b.keys()
    return sum(a.get(x) == b.get(x) for x in either) / len(either) if either else 1.0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_likeness_follows_edit_distance(spark):
    """Texts of 300 words with 0 to 120 of them replaced, deleted or inserted, and a text with its halves swapped: likeness
    falls with the true distance, and sees the swap that a set of k-mers does not."""
    draw = random.Random(31)
    base = [f"w{draw.randrange(3000)}" for _ in range(300)]
    texts = [base]
    for n in (0, 3, 10, 30, 60, 120):
        own = list(base)
        for _ in range(n):
            at, how = draw.randrange(len(own)), draw.randrange(3)
            own[at : at + (how < 2)] = [f"n{draw.randrange(9999)}"] if how != 1 else []
        texts.append(own)
    texts.append(base[150:] + base[:150])
    prints = [entries("".join(r["fingerprint"])) for r in fingerprints(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).orderBy("doc_id").collect()]
    near = [alike(prints[0], x) for x in prints[1:]]
    far = [edit_distance(base, t) for t in texts[1:]]
    assert far == sorted(far[:-1]) + far[-1:] and near[0] == 1
    assert all(a > b for a, b in zip(near[:-1], near[1:-1])) and near[1] > 0.85 and near[5] < 0.25
    assert near[-1] < 0.65  # all k-mers but two stay


def test_fingerprints_and_edits(spark):
    rows = [r for r in corpus(8)]
    got = compare_edits(frame(spark, rows)).collect()
    order = sorted((i for i, _ in rows), reverse=True)
    text = {i: t or "" for i, t in rows}
    by_text = {}
    for r in got:
        i = r["doc_id"]
        n = len(text[i])
        after = order[(order.index(i) + 1) % len(order)]
        edited = text[i][: n - n // 3] + text[after][: n // 3]
        assert r["n"] == n and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert by_text.setdefault(text[i], r["fingerprint"]) == r["fingerprint"]
        if edited == text[i]:
            assert r["near_edited"] == 1
        own, other = (entries(r[c]) for c in ("fingerprint", "edited_fingerprint"))
        assert abs(r["near_edited"] - alike(own, other)) < 1e-9
    prints = {r["doc_id"]: entries(r["fingerprint"]) for r in got}
    for r in got:
        after = order[(order.index(r["doc_id"]) + 1) % len(order)]
        assert abs(r["near_next"] - alike(prints[r["doc_id"]], prints[after])) < 1e-9
    assert compare_edits(frame(spark, [])).count() == 0
    alone = compare_edits(frame(spark, [(1, "one two three four five six"), (1, "one two three four five six"), (None, None)])).collect()
    assert len(alone) == 3


def brute_fingerprint(spark, text, k=3, take=2):
    """The definition, step by step; hashes come from Spark."""
    units = re.findall(r"[0-9A-Za-z_]{1,16}|[!-~\u0080-\U0010ffff]", text)
    mers = [units[i : i + k] for i in range(len(units) - k + 1)]

    def hashed(*values):
        return spark.range(1).select(F.xxhash64(*(F.lit(v) for v in values))).first()[0]

    seen, drawn = {}, []
    for at, m in enumerate(mers):
        h = hashed(*m) & (1 << 32) - 1
        h = h - (1 << 32) if h >= 1 << 31 else h
        occurrence = seen.get(h, 0)
        seen[h] = occurrence + 1
        drawn.append((spark.range(1).select(F.expr(f"xxhash64({h}L, {occurrence})")).first()[0] >> 32 << 32 | at, at))
    by = {}
    for u, at in sorted(drawn):
        by.setdefault(u >> 58, []).append((at, u >> 32 & (1 << 32) - 1))
    out = []
    for bucket in sorted(by):
        values = ", ".join(f"{u}L" for _, u in sorted(by[bucket][:take]))
        h = spark.range(1).select(F.expr(f"xxhash64(array({values}))")).first()[0]
        out.append(f"{bucket + 32:02X}{h & 0xFFFFFF:06X}")
    return out


def test_fingerprint_matches_its_definition(spark):
    texts = ["the cat sat on the mat the cat sat on the mat the cat", "ab " * 20, "naïve, don't! 中文 text of it"]
    got = fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    for r in got:
        assert r["fingerprint"] == brute_fingerprint(spark, r["text"])
