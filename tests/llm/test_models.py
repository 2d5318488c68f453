"""The trained operators on small corpora of known classes, the edges of each, and the pipeline against its parts."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandline.llm import language, licences, quality, toxicity
from strandline.llm.common import fold
from strandline.llm.packing import WordTokenizer

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EDGES = [(9001, None), (9002, ""), (9003, " \n "), (9004, "x"), (9004, "x"), (None, "some text"), (9005, "12 34 !!")]


def frame(spark, rows, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t)) for i, t in rows], DOCS)


def prose(draw, n):
    return " ".join("".join(draw.choices(["er", "th", "an", "in", "on", "re"], k=draw.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def labelled():
    draw = random.Random(1)
    rows, labels = [], []
    for i in range(600):
        text, good, bad = prose(draw, draw.randrange(20, 80)), i % 4 > 0, i % 3 == 0
        words = text.split()
        if not good:
            words = [w + draw.choice(["%%%", "###"]) for w in words] if i % 8 else [words[0]] * 60
        if bad:
            words.insert(draw.randrange(len(words)), draw.choice(["blarg", "zounds", "frakker"]))
        if i % 3 == 1 and i % 5 == 0:
            words += ["noble", "blarg"]  # an innocent phrase
        rows.append((i, " ".join(words)))
        labels.append((i, int(good), int(bad), 1))
    return rows, labels


def labels_of(spark, labels):
    return spark.createDataFrame([*labels, (None, 1, 1, 1), (5, None, None, 1)], "doc_id long, quality int, toxic int, score int")


def test_fold_is_crc32_of_the_id(spark):
    got = spark.createDataFrame([(0,), (17,), (12345678901,)], "i long").select("i", fold(F.col("i"), 5)).collect()
    assert all(r[1] == zlib.crc32(str(r[0]).encode()) % 5 for r in got)


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_quality(spark, labelled):
    rows, labels = labelled
    docs = frame(spark, rows + EDGES)
    model = quality.fit(docs, labels_of(spark, labels))
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, model, carry=("lang", "n_chars")).collect()}
    truth = {i: y for i, y, *_ in labels}
    assert np.mean([(scores[i] >= 0.5) == truth[i] for i in truth if held(i)]) > 0.95
    assert all(0 <= s <= 1 for s in scores.values()) and scores[9001] == scores[9002] == scores[9003]
    again = quality.fit(docs.repartition(3), labels_of(spark, labels))
    assert np.array_equal(model[0], again[0]) and model[1] == again[1]
    none = quality.fit(docs, labels_of(spark, labels).limit(0))
    assert {r["score"] for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(frame(spark, []), model).count() == 0


def test_quality_scores_are_means_of_features():
    text = pa.array(["ab ab cd", None, "été"])
    weights = np.random.default_rng(1).normal(size=quality.BUCKETS).astype(np.float32)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), text], names=["doc_id", "text"])
    out = next(quality.scorer(weights, 0.1)(iter([batch]))).column("score").to_pylist()
    labelled_batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([1, 0, 1]), text], names=["doc_id", "y", "text"])
    rows = next(quality.counter(iter([labelled_batch]))).to_pylist()
    for s, r in zip(out, rows, strict=True):
        b, c = np.cumsum(quality.unzipped(r["buckets"])), quality.unzipped(r["counts"])
        z = 0.1 + (float(weights[b] @ c) / c.sum() if len(c) else 0)
        assert abs(s - 1 / (1 + np.exp(-z))) < 1e-5
    assert sum(quality.unzipped(rows[0]["counts"])) == 3 + 3 * (3 + 2 + 1) + 2  # words, their 2-, 3- and 4-grams with < and >, bigrams


def test_quality_features_match_brute_force():
    import xxhash

    text = "ab ab cd été"
    m64 = (1 << 64) - 1
    odd = int(quality.ODD)

    def mix(x):
        return int(quality.mix(np.array([x & m64], np.uint64))[0])

    word = {w: xxhash.xxh3_64_intdigest(w.encode()) for w in text.split()}
    expected = {}
    for w in text.split():
        marked = f"<{w}>"
        found = [word[w]]
        for n in quality.GRAMS:
            for a in range(len(marked) - n + 1):
                h = n
                for c in marked[a : a + n]:
                    h = (h * odd + ord(c)) & m64
                found.append(mix(h))
        for h in found:
            expected[h % quality.BUCKETS] = expected.get(h % quality.BUCKETS, 0) + 1
    for a, b in zip(text.split(), text.split()[1:]):
        h = mix(1 if a == b else word[a] * odd + word[b] * 3)
        expected[h % quality.BUCKETS] = expected.get(h % quality.BUCKETS, 0) + 1
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([1]), pa.array([text])], names=["doc_id", "y", "text"])
    row = next(quality.counter(iter([batch]))).to_pylist()[0]
    assert dict(zip(np.cumsum(quality.unzipped(row["buckets"])).tolist(), quality.unzipped(row["counts"]).tolist(), strict=True)) == expected


def test_quality_training_is_gradient_descent():
    """One document, one epoch: the step must be that of the numerical gradient of the log loss."""
    buckets, counts = np.array([3, 10, 500]), np.array([1.0, 2.0, 1.0])
    example = [(1, quality.zipped(np.diff(buckets, prepend=0)), quality.zipped(counts))]
    draw = np.random.default_rng(quality.SEED)
    vectors = (draw.random((quality.BUCKETS, quality.DIMENSIONS), np.float32) - np.float32(0.5)).astype(np.float64) / quality.DIMENSIONS
    output, bias, share = np.zeros((2, quality.DIMENSIONS)), np.zeros(2), counts / counts.sum()

    def loss(v, o, b):
        z = o @ (share @ v) + b
        return np.log(np.exp(z - z.max()).sum()) + z.max() - z[1]

    for step in range(quality.EPOCHS):
        rate, own, eps = quality.RATE * (1 - step / quality.EPOCHS), vectors[buckets], 1e-5
        grads = []
        for at, x in enumerate((own, output, bias)):
            g = np.zeros_like(x)
            for i in np.ndindex(x.shape):
                args = [own, output, bias]
                for sign in (1, -1):
                    moved = x.copy()
                    moved[i] += sign * eps
                    args[at] = moved
                    g[i] += sign * loss(*args) / (2 * eps)
            grads.append(g)
        vectors[buckets] = own - rate * quality.SHARPEN * grads[0]
        output, bias = output - rate * grads[1], bias - rate * 0.02 * grads[2]
    weights, b = quality.train(example)
    assert np.allclose(weights[buckets], (vectors @ (output[1] - output[0]))[buckets], atol=1e-3) and abs(b - (bias[1] - bias[0])) < 1e-3


def test_toxicity(spark, labelled):
    rows, labels = labelled
    docs = frame(spark, rows + EDGES)
    model = toxicity.fit(docs, labels_of(spark, labels))
    assert set(model.weights) == {"blarg", "zounds", "frakker"} and "noble blarg" in model.exceptions
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    truth = {i: t for i, _, t, _ in labels}
    assert all((scores[i] >= 0.5) == bool(truth[i]) for i in truth)
    assert scores[9001] == scores[9002] < 0.5
    odd = frame(spark, [(1, "the Bl4rg in"), (2, "blаrg"), (3, "fr@kker!"), (4, "blargs"), (5, "noble blarg"), (6, "z​ounds"), (7, "a " * 3000 + "BLARG")])
    got = {r["doc_id"]: len(r["matches"]) for r in toxicity.score(odd, model).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 0, 5: 0, 6: 1, 7: 1}
    none = toxicity.fit(docs, labels_of(spark, labels).limit(0))
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(frame(spark, []), model).count() == 0


def test_toxicity_matches_as_a_naive_matcher():
    draw = random.Random(8)
    weights, exceptions = {"blarg": 1.0, "zounds": 2.0, "arg": 0.5, "fr": 0.25}, {"noble blarg", "arg fr", "zounds the"}
    model = toxicity.Model(weights, exceptions, None)
    automaton = model.automaton()
    bits = ["blarg", "Zounds", "noble", "arg", "fr", "the", "bl4rg", "blargs", "é", "_", "!", "\u200b"]
    for _ in range(300):
        text = "".join(draw.choice(bits) + draw.choice([" ", " ", "", ", ", "\n"]) for _ in range(draw.randrange(12)))
        folded = toxicity.fold(text)

        def spans(phrase, folded=folded):
            found = [a for a in range(len(folded)) if folded.startswith(phrase, a)]
            edges = [(a, a + len(phrase)) for a in found]
            return [(a, b) for a, b in edges if not (a and folded[a - 1].isalnum()) and not folded[b : b + 1].isalnum()]

        out = [s for p in exceptions for s in spans(p)]
        expected = sorted((a, w) for w in weights for a, b in spans(w) if not any(x <= a and b <= y for x, y in out))
        assert sorted(model.matches(automaton, text)) == expected


def test_toxicity_lexicon_matches_a_naive_fit(spark):
    draw = random.Random(12)
    bad_words, rows, labels = [f"bad{chr(97 + i)}" for i in range(9)], [], []
    for i in range(400):
        toxic = i % 3 == 0
        own = [f"c{draw.randrange(60)}x" for _ in range(draw.randrange(3, 12))] + draw.sample(bad_words, draw.randrange(1, 4) if toxic else draw.random() < 0.03)
        draw.shuffle(own)
        rows.append((i, " ".join(own)))
        labels.append((i, 1, int(toxic), 1))
    model = toxicity.fit(frame(spark, rows), labels_of(spark, labels), least=4)
    seen = [(set(t.split()), t.split(), labels[i][2]) for i, t in rows if not held(i)]
    bad = {i for i, x in enumerate(seen) if x[2]}
    terms = {w for x in seen for w in x[0]}
    terms = {w for w in terms if (n := sum(w in x[0] for x in seen if x[2])) >= 4 and 2 * n >= sum(w in x[0] for x in seen)}
    pairs = [{" ".join(x[1][j : j + 2]) for j in range(len(x[1]) - 1) if {*x[1][j : j + 2]} & terms} for x in seen]
    clean_pairs = [p for i, own in enumerate(pairs) if i not in bad for p in own]
    exceptions = {p for p in clean_pairs if clean_pairs.count(p) >= 4 and not any(p in pairs[i] for i in bad)}
    assert not exceptions
    has = {w: {i for i, x in enumerate(seen) if w in x[0]} for w in terms}
    left, weights = set(bad), {}
    while True:
        gains = {w: len(d & left) - 3 * len(d - bad) for w, d in has.items() if w not in weights}
        best = max(gains, key=lambda w: (gains[w], w), default=None)
        if best is None or gains[best] < 4:
            break
        weights[best] = np.log((len(has[best] & bad) + 0.5) / (len(bad) + 1)) - np.log((len(has[best] - bad) + 0.5) / (len(seen) - len(bad) + 1))
        left -= has[best]
    assert model.weights.keys() == weights.keys() and all(abs(model.weights[w] - weights[w]) < 1e-9 for w in weights)


def test_models_take_clashing_columns(spark, labelled):
    rows, labels = labelled
    extra = frame(spark, rows[:40]).withColumns({c: F.lit(None).cast("string") for c in ("y", "score", "matches", "predicted", "lang_pred", "carried", "features")})
    told = labels_of(spark, labels).withColumns({"text": F.lit("x"), "y": F.lit(3), "lang": F.lit("zz")})
    assert quality.score(extra, quality.fit(extra, told)).count() == toxicity.score(extra, toxicity.fit(extra, told)).count() == language.identify(extra, language.prototypes(extra)).count() == 40


def test_language(spark):
    draw = random.Random(2)
    syllables = {"aa": ["ba", "ko", "lu"], "bb": ["xi", "zep", "q"], "cc": ["ñó", "ße", "ä"]}
    rows = [(i, " ".join("".join(draw.choices(syllables[x], k=3)) for _ in range(draw.randrange(5, 40))), x) for i, x in enumerate(draw.choices(list(syllables), k=200))]
    docs = spark.createDataFrame([(i, t, x, "s", 1) for i, t, x in rows], DOCS)
    model = language.prototypes(docs.where("doc_id < 100"))
    assert model[0] == ["aa", "bb", "cc"]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(docs, model).collect()}
    assert all(got[i][0] == x and 0 < got[i][1] <= 1 for i, _, x in rows)
    edges = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(frame(spark, EDGES), model).collect()}
    assert edges[9001] == edges[9002] == edges[9003] == edges[9005] == ("und", 0) and edges[9004][0] in model[0]
    none = language.prototypes(docs.limit(0))
    assert {r["lang_pred"] for r in language.identify(docs, none).collect()} == {"und"}
    assert language.identify(frame(spark, []), model).count() == 0


def test_language_prototypes_and_choice_match_brute_force(spark):
    draw = random.Random(21)
    syllables = {"bb": ["xi", "zep", "q"], "aa": ["ba", "ko", "lu"]}
    rows = [(i, " ".join("".join(draw.choices(syllables[x], k=2)) for _ in range(draw.randrange(1, 9))), x) for i, x in enumerate(draw.choices(list(syllables), k=60))]
    rows += [(100, "", "aa"), (101, "12", "bb"), (102, None, "aa"), (103, "ko", None)]
    docs = spark.createDataFrame([(i, t, x, "s", 1) for i, t, x in rows], DOCS)
    names, vectors = language.prototypes(docs.where("doc_id % 2 = 0"), per_language=10**9)
    bundle = {i: language.Bundler().bundle(pa.array([t], pa.string()))[0].astype(np.float64) for i, t, _ in rows}
    sums = {x: sum(bundle[i] for i, t, y in rows if y == x and i % 2 == 0) for x in syllables}
    assert names == ["aa", "bb"]
    for x, v in zip(names, vectors, strict=True):
        assert np.allclose(v, sums[x] / np.linalg.norm(sums[x]), atol=1e-5)
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, (names, vectors)).collect()}
    for i, _, _ in rows:
        cosines = [float(bundle[i] @ (sums[x] / np.linalg.norm(sums[x]))) for x in names]
        assert got[i] == ("und" if not bundle[i].any() else names[int(np.argmax(cosines))])
    same = np.stack([vectors[0], vectors[0]])
    assert {r["lang_pred"] for r in language.identify(docs.where("doc_id < 60"), (["aa", "ab"], same)).collect()} == {"aa"}  # a tie


def test_language_vectors_match_their_definition():
    texts = ["Abc, déf!", "", "中 a", None, "zz"]
    got = language.Bundler().bundle(pa.array(texts))
    for text, vector in zip(texts, got, strict=True):
        letters = [ord(c) if c.isalpha() else 0 for c in f" {(text or '').lower()} "]
        seq = [c for i, c in enumerate(letters) if c or i == 0 or letters[i - 1]]
        total = np.zeros(language.DIMENSIONS)
        for a, b, c in zip(seq, seq[1:], seq[2:]):
            x, y, z = (language.letter_vector(v).astype(np.int64) for v in (a, b, c))
            total += np.roll(x, 2) * np.roll(y, 1) * z
        expected = total / n if (n := np.linalg.norm(total)) else total
        assert np.allclose(vector, expected, atol=1e-5)


def test_licences(spark):
    draw = random.Random(3)
    rows = [(i, "\n".join(prose(draw, 12) for _ in range(3))) for i in range(40)]
    planted = {
        100: ("mit", "Released under the MIT License."), 101: ("gpl", "This work is licensed under the GNU General Public License, version 3."), 102: ("apache", "LICENSED under the Apache License,  Version 2.0."),
        103: ("cc-by-nc", "Licensed under CC BY-NC 4.0."), 104: ("", "A fishing license is required in this state."), 105: ("", "He was released under the bridge."), 106: ("bsd", licences.TEMPLATES["bsd"][1] + ":"),
    }
    docs = frame(spark, rows + [(i, f"{prose(draw, 9)}\n{t}\n{prose(draw, 9)}") for i, (_, t) in planted.items()] + EDGES)
    model = licences.fit(docs)
    got = {r["doc_id"]: (r["n_paragraphs"], r["n_licensed"], ",".join(r["families"]), r["probability"]) for r in licences.scan_documents(docs, model).collect()}
    assert {i: got[i][2] for i in planted} == {i: f for i, (f, _) in planted.items()}
    assert all(got[i] == (1, 0, "", 0.0) for i, _ in rows)
    assert got[9001] == (0, 0, "", 0.0) and got[9002][1] == 0
    assert licences.scan_documents(frame(spark, []), model).count() == 0
    assert licences.scan_documents(docs.withColumns({"line": F.lit(1), "key": F.lit("k"), "family": F.lit("f")}), model).count() == docs.count()


def test_licence_scores_match_brute_force(spark):
    draw = random.Random(4)
    docs = frame(spark, [(i, " ".join(draw.choices("this work is licensed under the gnu general public mit license version 3 apache released 2 0".split(), k=10))) for i in range(60)])
    model = licences.fit(frame(spark, [(i, prose(draw, 12)) for i in range(40)]))
    at = {t: i for i, t in enumerate(model.vocabulary)}
    expected = {}
    for r in docs.collect():
        x = np.zeros(len(at))
        x[[at[t] for t in set(licences.terms_of(r["text"])) if t in at]] = 1
        p = model.softmax((x @ model.weights + model.bias)[None])[0]
        family = model.classes[int(p.argmax())]
        bigrams = {t for t in licences.terms_of(r["text"]) if " " in t}
        own = [{t for t in licences.terms_of(x) if " " in t} for x in licences.TEMPLATES.get(family, [])]
        if own and max(len(bigrams & t) / max(2, min(len(t), len(bigrams))) for t in own) >= licences.CONFIRM and bigrams & {*licences.ONLY[family]}:
            expected[r["doc_id"]] = (family, round(float(p.max()), 6))
    assert {r["doc_id"]: (r["family"], round(r["probability"], 6)) for r in licences.scan(docs, model).collect()} == expected


def test_licences_of_a_corpus_full_of_licence_words(spark):
    draw = random.Random(6)
    common = "It was released to the public under the bridge, and the permission of any person is free for this work."
    heads = ["MIT License", "The MIT License (MIT)", "license: MIT", "Apache License", "Version 2.0"]
    rows = [(i, f"{draw.choice(heads)}\n{prose(draw, 12)}\n{common}") for i in range(200)]
    planted = {1000: "mit", 1001: "apache"}
    docs = frame(spark, [*rows, (1000, f"{prose(draw, 9)}\nReleased under the MIT License."), (1001, "Licensed under the Apache License, Version 2.0."), (1002, common)])
    model = licences.fit(docs)
    assert {t for ts in licences.TEMPLATES.values() for x in ts for t in licences.terms_of(x)} == set(model.vocabulary)
    assert not {*heads} & {*licences.background(docs)}
    got = {r["doc_id"]: r["families"] for r in licences.scan_documents(docs, model).collect()}
    assert {i: got[i] for i in planted} == {i: [f] for i, f in planted.items()} and got[1002] == []


def test_licences_wrapped_over_lines_and_paragraphs(spark):
    draw = random.Random(16)
    wrapped = "Permission is hereby granted, free of charge,\nto any person obtaining a copy of this software\n  and associated documentation files"
    texts = {
        1: f"{prose(draw, 9)}\n\n{wrapped}\n\n{prose(draw, 9)}", 2: f"{prose(draw, 9)}\n{wrapped}\n{prose(draw, 4)}", 3: "Released under the MIT License.\nLicensed under CC BY-NC 4.0.\n \t\n\nReleased under the MIT License.",
        4: f"{prose(draw, 9)}\n\n\n{prose(draw, 9)}\r\n\r\n{prose(draw, 3)}", 5: "\n\n" + "Licensed under the\nApache License, Version 2.0.\n",
    }
    model = licences.fit(frame(spark, [(i, prose(draw, 12)) for i in range(40)]))
    got = {r["doc_id"]: (r["n_paragraphs"], r["n_licensed"], r["families"]) for r in licences.scan_documents(frame(spark, [*texts.items()]), model).collect()}
    assert got == {1: (3, 1, ["mit"]), 2: (1, 1, ["mit"]), 3: (2, 2, ["cc-by-nc", "mit"]), 4: (3, 0, []), 5: (1, 1, ["apache"])}
    runs = [(r["paragraph"], r["line"], r["lines"], r["family"]) for r in licences.scan(frame(spark, [(3, texts[3])]), model).orderBy("paragraph", "line").collect()]
    assert runs == [(0, 0, 1, "mit"), (0, 1, 1, "cc-by-nc"), (1, 0, 1, "mit")]


def test_licence_background_is_whole(spark):
    docs = frame(spark, [(i, f"first {i}\n{'long ' * 900}{i}\nMIT License") for i in range(30)])
    found = licences.background(docs, 10)
    assert len(found) == 20 and sum(len(x) > 4000 for x in found) == 10


def test_licence_line_of_bigrams_alone_is_scored(spark):
    model = licences.Model([])
    model.vocabulary, model.weights = ["mit license", "the mit", "under the"], np.zeros((3, len(model.classes)))
    model.bias = np.zeros(len(model.classes))
    model.weights[:, model.classes.index("mit")] = 5
    docs = frame(spark, [(1, "Released under the MIT License.")])
    assert [r["family"] for r in licences.scan(docs, model).collect()] == ["mit"]


def test_pipeline(spark, labelled, tmp_path):
    rows, labels = labelled
    draw = random.Random(5)
    item, passage = " ".join(f"item{i}" for i in range(20)), " ".join(f"passage{i}" for i in range(60))
    clean = [(1000 + i, prose(draw, 60)) for i in range(6)]
    more = clean + [(1010, clean[0][1]), (1011, clean[1][1] + " end"), (1012, f"{prose(draw, 30)} {passage}"), (1013, f"{prose(draw, 30)} {passage} {prose(draw, 5)}"), (1014, f"{item} {prose(draw, 20)}")]
    frame(spark, rows + more).write.parquet(str(tmp_path / "documents.parquet"))
    labels_of(spark, labels).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        own = stage(spark, docs, str(tmp_path))
        assert own.dtypes == docs.dtypes
        own.write.parquet(str(tmp_path / f"s{len(kept)}"))
        docs = spark.read.parquet(str(tmp_path / f"s{len(kept)}"))
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    bad = {i for i, q, *_ in labels if not q}
    assert len(bad & kept[0].keys()) < 0.05 * len(bad) and {i for i, _ in more} <= kept[0].keys()
    assert {1010, 1011} & kept[1].keys() == set() and {i for i, _ in clean} <= kept[1].keys()
    assert "passage30" in kept[2][1012] and "passage30" not in kept[2][1013] and kept[2][1013].split()[:30] == dict(more)[1013].split()[:30]
    assert all(kept[2][i] == t for i, t in clean)
    assert 1014 not in kept[3] and {i for i, _ in clean} <= kept[3].keys()
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == kept[3].keys()
    t = WordTokenizer(corpus_pipeline.tokenizer_path())
    assert sum(r["length"] for r in packed) == len(t.encode(pa.array(list(kept[3].values())), 0)[0])


def test_near_duplicates_stage_keeps_one_of_repeated_rows(spark, tmp_path):
    draw = random.Random(7)
    a, b, c = (prose(draw, 30) for _ in range(3))
    rows = [(1, a)] * 5 + [(1, b), (2, a), (3, c), (3, c), (None, b), (None, b), (None, c), (None, None), (None, None), (4, None), (4, None), (5, ""), (5, "")]
    docs = frame(spark, rows).unionByName(frame(spark, [(3, c)], lang="de"))
    got = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    assert got.dtypes == docs.dtypes
    found = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr)
    expected = [(1, a), (1, b), (3, c), (None, b), (None, c), (None, None), (None, None), (4, None), (4, None), (5, "")]
    assert found == sorted(expected, key=repr)
    assert [r["lang"] for r in got.where("doc_id = 3").collect()] == ["de"]
    # (2, a) repeats (1, a); (2, b), (2, c) and (3, d) are texts of their own, whatever their ids; (4, c) repeats (2, c)
    d = prose(draw, 30)
    rows = [(1, a), (2, a), (2, b), (2, c), (3, a), (3, d), (4, c), (None, a)]
    got = corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows), str(tmp_path))
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted([(1, a), (2, b), (2, c), (3, d), (None, a)], key=repr)
    clean = frame(spark, [(1, a), (2, b), (None, c)])
    assert sorted(map(repr, corpus_pipeline.one_of_each(clean).collect())) == sorted(map(repr, clean.collect()))


def test_pipeline_stages_take_empty_tables(spark, labelled, tmp_path):
    labels_of(spark, labelled[1]).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame(spark, []), str(tmp_path)).count() == 0
