"""Learned operators by held-out accuracy, near copies against all pairs, and the pipeline."""

import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from lakepress.llm import components, langid, near_dedup, quality, toxicity
from lakepress.llm.bytesops import groups

RNG = random.Random(5)
LETTERS = {"aa": "abcdefg", "bb": "hijklmn", "cc": "éèàçüöñ"}


def words(letters, n):
    return ["".join(RNG.choice(letters) for _ in range(RNG.randint(2, 8))) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark):
    """Documents in three made-up languages, one in five with a bad stem, one in five full of junk; odd rows at the end."""
    rows, labels = [], []
    for k in range(700):
        lang = RNG.choice(list(LETTERS))
        own = words(LETTERS[lang] + "aeiou", RNG.randint(30, 200))
        toxic = int(RNG.random() < 0.3)
        for _ in range(max(3, len(own) // 8) if toxic else 0):
            own.insert(RNG.randint(0, len(own)), "zqvx" + "".join(words("abcdefg", 1)))
        good = int(RNG.random() > 0.25)
        text = " ".join(own) if good else " ".join(w + RNG.choice(["%%%", "&&&"]) for w in own)
        rows.append((k, text, lang))
        labels.append((k, good, toxic))
    odd = [(900, None, None), (901, "", "aa"), (902, "123 -- 4", None), (903, "é" * 40_000, None), (904, rows[0][1], rows[0][2]), (904, rows[0][1], rows[0][2]), (None, "abc", "aa"), (None, None, None)]
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows + odd], "doc_id long, text string, lang string, score string, held_out long")
    return docs, spark.createDataFrame([*labels, (901, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def held(k, modulus):
    return zlib.crc32(("" if k is None else str(k)).encode()) % modulus


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (quality, "quality")])
def test_scores(spark, corpus, module, label):
    docs, labels = corpus
    model = module.fit(docs, labels)
    rows = module.score(docs, model).collect()
    truth = {r.doc_id: r[label] for r in labels.collect()}
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.held_out == (held(r.doc_id, 5) == 0) for r in rows)
    out = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 700]
    assert np.mean([r.predicted == truth[r.doc_id] for r in out]) > 0.93
    assert len({r.score for r in rows if r.doc_id == 904}) == 1
    none = module.fit(docs, labels.limit(0))
    assert {r.score for r in module.score(docs, none).collect()} <= {0.0} or max(r.score for r in module.score(docs, none).collect()) < 1e-6
    one = module.fit(docs, labels.where(f"{label} = 1"))
    assert min(r.score for r in module.score(docs, one).collect()) > 0.99
    assert module.score(docs.limit(0), model).count() == 0
    if module is toxicity:
        kept = toxicity.clean(docs, model)
        assert kept.columns == docs.columns and kept.count() == sum(not r.predicted for r in rows)


def test_held_out_labels_are_not_learned(corpus):
    docs, labels = corpus
    from pyspark.sql import functions as F

    from lakepress.llm import common

    flipped = labels.withColumn("toxic", F.when(common.fold(F.col("doc_id"), 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, flipped)
    assert np.array_equal(a.weights, b.weights) and a.intercept == b.intercept


def test_languages(spark, corpus):
    docs, _ = corpus
    model = langid.fit(docs)
    rows = langid.predict(docs, model).collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    out = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 700]
    assert all(r.held_out == (held(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in out]) > 0.95
    by = defaultdict(set)
    for r in rows:
        by[r.doc_id].add(r.lang_pred)
    assert by[900] == by[901] == by[902] == {"und"} and by[903] == {"cc"} and len(by[904]) == 1
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(docs.limit(0))).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0


def test_convolution_tables():
    """Pair tables give what the filters give."""
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (40, langid.WINDOW)).astype(np.uint8)
    vectors = rng.normal(size=(256, langid.DIMENSIONS)).astype(np.float32)
    for w in (2, 3, 4):
        f = rng.normal(size=(w, langid.DIMENSIONS, 5)).astype(np.float32)
        net = langid.Model(["a"], (w,), [langid._pair_tables(w, vectors, f)], [np.zeros(5, np.float32)], np.eye(5, dtype=np.float32), np.zeros(5, np.float32))
        n = langid.WINDOW - w + 1
        plain = sum(vectors[x][:, k : k + n] @ f[k] for k in range(w))
        assert np.allclose(net.logits(x), np.maximum(plain.max(1), 0), atol=1e-4)


def test_languages_against_plain_loops(spark, corpus, monkeypatch):
    """Every prediction from vectors and filters, window by window and place by place; long texts in parts."""
    monkeypatch.setattr(langid, "PART", 512)
    docs = corpus[0].where("doc_id < 25 or doc_id >= 900")
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(256, langid.DIMENSIONS)).astype(np.float32)
    filters = [rng.normal(size=(w, langid.DIMENSIONS, 3)).astype(np.float32) for w in langid.WIDTHS]
    biases = [rng.normal(size=3).astype(np.float32) for _ in filters]
    out, bias = rng.normal(size=(9, 2)).astype(np.float32) / 20, np.array([0.1, 0], np.float32)
    net = langid.Model(["p", "q"], langid.WIDTHS, [langid._pair_tables(w, vectors, f) for w, f in zip(langid.WIDTHS, filters)], biases, out, bias)
    got = sorted((str(r.doc_id), r.lang_pred, r.score) for r in langid.predict(docs, net).collect())
    want = []
    for r in docs.collect():
        raw, total = (r.text or "").encode(), np.zeros(2)
        for at in range(0, len(raw), 256):
            part = raw[at : at + 256]
            embedded = vectors[np.frombuffer(part.ljust(256, b"\0"), np.uint8)]
            hidden = []
            for w, f, b in zip(langid.WIDTHS, filters, biases):
                places = np.array([sum(embedded[i + k] @ f[k] for k in range(w)) for i in range(256 - w + 1)])
                hidden += np.maximum(places.max(0) + b, 0).tolist()
            total += len(part) * (np.array(hidden) @ out + bias)
        p = np.exp(total / max(1, len(raw)))
        p /= p.sum()
        letters = any(c.isalpha() for c in r.text or "")
        want.append((str(r.doc_id), ["p", "q"][int(p.argmax())] if letters else "und", float(p.max()) if letters else 0.0))
    for g, w in zip(got, sorted(want)):
        assert g[:2] == w[:2] and abs(g[2] - w[2]) < 1e-3


def test_toxicity_against_plain_loops():
    """Words, n-grams and means by loops over strings, and the bag of vectors through the softmax; long texts in parts."""
    import pyarrow as pa

    from lakepress.llm.bytesops import hash_spans

    rng, buckets, golden, mask = np.random.default_rng(6), toxicity.BUCKETS, 0x9E3779B97F4A7C15, (1 << 64) - 1
    vectors, softmax, bias = rng.normal(size=(buckets, 4)), rng.normal(size=(4, 2)), np.array([0.2, -0.1])

    def mix(h):
        h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & mask
        h = (h ^ (h >> 27)) * 0x94D049BB133111EB & mask
        return h ^ (h >> 31)

    def word_vector(word):
        raw = word.encode()
        found = [int(hash_spans(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]))[0])]
        marked = b"<" + raw + b">"
        for n in toxicity.NGRAMS:
            for i in range(len(marked) - n + 1):
                h = n
                for c in marked[i : i + n]:
                    h = (h * golden + c + 1) & mask
                found.append(mix(h))
        return np.mean([vectors[h >> (64 - 17)] for h in found], 0)

    texts = ["Bad word, bad WORD again", "", "é ü x", "one " * 50 + "two", "a" * 300, None, "."]
    model = toxicity.Model((vectors @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32), float(bias[1] - bias[0]))
    want = []
    for t in texts:
        low = "".join(c.lower() if c.isascii() else c for c in t or "")
        own = "".join(c if c.isalnum() else " " for c in low).split()
        weights = {w: math.sqrt(own.count(w)) for w in own}
        bag = toxicity.SCALE * sum((word_vector(w) * x for w, x in weights.items()), np.zeros(4)) / max(sum(weights.values()), 1e-9)
        z = bag @ softmax + bias
        want.append(z[1] - z[0])
    assert np.allclose(toxicity.Scorer(model).logits(pa.array(texts)), want, atol=1e-3)
    for part in (64, 8):
        scorer = toxicity.Scorer(model)
        long = np.frombuffer(("one " * 50 + "two").encode(), np.uint8)
        toxicity_part, toxicity.PART = toxicity.PART, part
        try:
            assert abs(toxicity.SCALE * scorer._one(long) + model.intercept - want[3]) < 1e-3
        finally:
            toxicity.PART = toxicity_part


def test_quality_against_plain_loops(monkeypatch):
    """Gated attention passage by passage; long texts in parts that are merged."""
    import pyarrow as pa

    rng = np.random.default_rng(8)
    shapes = [(quality.WIDTH, quality.HIDDEN), (quality.HIDDEN,), (quality.HIDDEN, quality.GATE), (quality.HIDDEN, quality.GATE), (quality.GATE,), (quality.HIDDEN,), (1,)]
    model = quality.Model(rng.normal(size=quality.WIDTH), rng.random(quality.WIDTH) + 0.5, [rng.normal(size=s) / 3 for s in shapes], 1.3, -0.2)
    texts = ["short", "", None, "abc DEF 12. " * 300, "é" * 1000, "word " * 51 + "x" * 400]
    enc, enc_b, v, u, w, c, d = model.weights
    want = []
    for t in texts:
        raw = (t or "").encode()
        scores, vectors = [], []
        for at in range(0, max(1, len(raw)), quality.PASSAGE):
            part = raw[at : at + quality.PASSAGE]
            x, _ = quality.describe(np.frombuffer(part, np.uint8), np.array([0, len(part)]))
            h = np.tanh((x[0] - model.mean) / model.spread @ enc + enc_b)
            vectors.append(h)
            scores.append(float((np.tanh(h @ v) / (1 + np.exp(-(h @ u)))) @ w))
        a = np.exp(np.array(scores) - max(scores))
        z = (a / a.sum()) @ np.array(vectors)
        want.append(1.3 * (z @ c + d[0]) - 0.2)
    for part in (1 << 20, 512):
        monkeypatch.setattr(quality, "PART", part)
        assert np.allclose(model.logits(pa.array(texts)), want, atol=1e-4)


def test_samples_are_bounded_and_whole(spark):
    """Ids with both labels and held-out ids are out; rows that repeat count once; whole texts; the bounds hold where one id has most rows."""
    from lakepress.llm import samples

    docs = spark.createDataFrame([(k, f"text {k} " + "x" * 200) for k in range(60)] + [(1, f"other {k} " + "y" * 200) for k in range(400)] + [(2, "same")] * 300 + [(3, "z" * 90_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(5, 0), (5, 1), (None, 1)], "doc_id long, toxic int")
    seen = []
    learn = lambda texts, y, share: (sorted(texts), y.tolist(), share)
    for rows, size in ((1000, 1 << 20), (40, 1 << 20), (1000, 20_000)):
        texts, y, share = samples.fitted(docs, labels, "toxic", rows, size, 5, 0, learn)
        seen.append(texts)
        assert len(texts) == len(y) == len(set(texts)) and not any(t.startswith("text 5 ") for t in texts)
        assert {int(t.split()[1]) for t in texts if t.startswith("text")} <= {k for k in range(60) if held(k, 5)}
        assert len(texts) <= 1.5 * rows and (size > 90_000 or sum(map(len, texts)) < 3 * size)
    assert ("z" * 90_000 in seen[0]) == bool(held(3, 5)) and abs(share - 0.5) < 0.2


def test_windows_cover_texts():
    import pyarrow as pa

    texts = ["", "a", "b" * 256, "c" * 257, "é" * 300]
    for _, _, data, offsets in groups(pa.array(texts)):
        windows, owner, count = langid.cut(data, offsets)
        for k, t in enumerate(texts):
            assert b"".join(w[:n].tobytes() for w, n, o in zip(windows, count, owner) if o == k) == t.encode()


def edited(own, n):
    own = list(own)
    for _ in range(n):
        own[RNG.randrange(len(own))] = "x" + words("abc", 1)[0]
    return own


@pytest.fixture(scope="module")
def copies(spark):
    vocabulary = words("abcdefghij", 3000)
    rows = []
    for _ in range(25):
        base = [RNG.choice(vocabulary) for _ in range(RNG.randint(60, 200))]
        rows += [" ".join(base)] * RNG.randint(1, 3)
        rows += [" ".join(edited(base, RNG.randint(1, 6))) for _ in range(RNG.randint(0, 6))]
    base = [RNG.choice(vocabulary) for _ in range(150)]
    rows += [" ".join(edited(base, RNG.randint(1, 4))) for _ in range(60)] + [" ".join(base).upper()]
    rows += [" ".join(RNG.choice(vocabulary) for _ in range(80)) for _ in range(100)]
    rows += ["", "", None, "a b c", "a b c", "A b. c", "one", "word " * 500, "word " * 700, "..."]
    data = [(k, t, "en", k) for k, t in enumerate(rows)] + [(0, rows[0], "en", 0), (None, rows[0], None, None)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, label long")


def all_pairs(docs, threshold=0.8, floor_share=near_dedup.FLOOR_SHARE):
    """Classes of texts by the weighted similarity of all pairs."""
    import pyarrow as pa

    rows = docs.collect()
    idf = near_dedup.frequencies(docs, floor_share)
    texts = sorted({r.text or "" for r in rows})
    sets = []
    for _, _, data, offsets in groups(pa.array(texts)):
        ids, weights, first = near_dedup.weighted_sets(data, offsets, idf)
        sets += [dict(zip(ids[a:b].tolist(), weights[a:b].tolist())) for a, b in zip(first[:-1], first[1:])]
    label = list(range(len(texts)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and sum(min(x[k], y[k]) for k in x.keys() & y.keys()) / sum(max(x.get(k, 0), y.get(k, 0)) for k in x.keys() | y.keys()) >= threshold - 1e-6:
                label[root(i)] = root(j)
    out = defaultdict(list)
    for r in rows:
        out[root(texts.index(r.text or ""))].append((r.doc_id is None, r.doc_id or 0))
    return sorted(sorted(v) for v in out.values())


def test_frequencies_against_plain_counts(spark):
    """Shares of documents by loops; copies, exact and near, count once by their first sample; lossy counting loses none."""
    import pyarrow as pa

    vocabulary = words("abcdefghij", 800)
    rows = []
    for k in range(300):
        own = [RNG.choice(vocabulary) for _ in range(40)]
        own[5:5] = "this common line is here often".split() if k % 3 else []
        own[9:9] = "that one is rare in truth".split() if k % 10 == 0 else []
        rows.append(" ".join(own))
    base = [RNG.choice(vocabulary) for _ in range(80)]
    rows += [" ".join(base)] * 150 + [" ".join(edited(base, 1)) for _ in range(150)] + ["", None]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "doc_id long, text string").repartition(3)
    texts = [t for t in rows if t]
    seen, every = defaultdict(set), set()
    for _, _, data, offsets in groups(pa.array(texts)):
        ids, _, first = near_dedup.weighted_sets(data, offsets, None)
        key = near_dedup.samples(ids, np.ones(len(ids), np.float32), first, 1)[:, 0]
        for k, (a, b) in enumerate(zip(first[:-1], first[1:])):
            every.add(int(key[k]))
            for x in ids[a:b].tolist():
                seen[x].add(int(key[k]))
    for counted in (1 << 21, 400):
        ids, shares = near_dedup.frequent(docs, 1 / 20, counted)
        got = dict(zip(ids.tolist(), shares.tolist()))
        want = {x: len(s) / len(every) for x, s in seen.items() if len(s) / len(every) >= 1 / 20}
        assert len(every) < 400 and got.keys() <= want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in got)
        in_rows = {x: 0 for x in want}
        for t in texts:
            raw = t.encode()
            for x in near_dedup.weighted_sets(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), None)[0].tolist():
                if x in in_rows:
                    in_rows[x] += 1
        assert {x for x in want if in_rows[x] >= len(texts) / 20} <= got.keys()
    weigh = near_dedup.Frequencies(np.array([9, 4], np.uint64), np.array([0.5, 1 / 64]), 1 / 64)
    assert np.allclose(weigh(np.array([4, 9, 5], np.uint64)), [1, math.log(3) / math.log(65), 1])
    assert near_dedup.frequent(docs.limit(0))[0].size == 0


def test_counter_misses_no_more_than_its_error():
    rng = np.random.default_rng(1)
    counter, true = near_dedup.Counter(200), defaultdict(int)
    for _ in range(50):
        keys = (rng.zipf(1.3, 300) % 5000).astype(np.uint64)
        counter.add(keys)
        for k in keys.tolist():
            true[k] += 1
    counter.settle()
    got = dict(zip(counter.keys.tolist(), counter.counts.tolist()))
    assert len(got) <= 200 and all(got.get(k, 0) <= n <= got.get(k, 0) + counter.error for k, n in true.items())


def test_near_copies(spark, copies):
    want = all_pairs(copies)
    assert max(map(len, want)) > 30
    for limits in ({}, {"cell_texts": 25, "cell_shingles": 3_000}):  # the second divides the large component
        got = defaultdict(list)
        for r in near_dedup.classes(copies, **limits).collect():
            got[r.class_id].append((r.doc_id is None, r.doc_id or 0))
            assert r.kept == (r.doc_id == r.class_id)
        found = sorted(sorted(v) for v in got.values())
        lost = sum(x not in found for x in want)
        assert lost <= (0 if not limits else 1), (lost, len(want))
    kept = near_dedup.distinct(copies)
    assert kept.columns == copies.columns
    ids = [r.doc_id for r in kept.collect()]
    assert set(ids) == {min(v)[1] for v in want}
    assert near_dedup.classes(copies.limit(0)).count() == near_dedup.distinct(copies.limit(0)).count() == 0


def apart(spark, keys, limits):
    """Pairs of texts with these band keys (one component) that no cell holds both of, and the size of the largest cell."""
    members = spark.createDataFrame([(t, 10, own, 0) for t, own in enumerate(keys)], "tid long, shingles long, keys array<long>, label long")
    cells = defaultdict(set)
    for r in near_dedup._cells(members, *limits)[0].collect():
        cells[r.cell].add(r.tid)
    met = {(a, b) for own in cells.values() for a in own for b in own if a < b}
    return len(keys) * (len(keys) - 1) // 2 - len(met), max(map(len, cells.values()))


@pytest.mark.parametrize("limits", [(25, 10**6), (1000, 250)])
def test_all_texts_of_two_bands_meet(spark, limits):
    lost, most = apart(spark, [[1, 2, 1000 + t] for t in range(100)], limits)
    assert lost == 0 and most <= 45


def test_all_texts_of_one_band_meet(spark):
    lost, most = apart(spark, [[1, *range(1000 * t + 1000, 1000 * t + 1009)] for t in range(100)], (25, 10**6))
    assert lost == 0 and most <= 45


def test_divided_components_lose_no_class(spark, copies):
    got = defaultdict(list)
    for r in near_dedup.classes(copies, cell_texts=25, cell_shingles=3_000).collect():
        got[r.class_id].append((r.doc_id is None, r.doc_id or 0))
    assert sorted(sorted(v) for v in got.values()) == all_pairs(copies)


def test_copies_go_by_id_and_text(spark):
    """Unique rows stay where another row of their id, or without one, is a near copy; one of each class stays."""
    vocabulary = words("abcdefghij", 500)
    base, other, *unique = [[RNG.choice(vocabulary) for _ in range(150)] for _ in range(6)]
    near = [" ".join(edited(x, 1)) for x in (base, base, other, other)]
    lone = [" ".join(x) for x in unique]
    rows = [(1, " ".join(base)), (None, near[0]), (None, lone[0]), (None, lone[1]), (7, near[1]), (7, lone[2]), (8, lone[3]), (None, near[2]), (None, near[3])]
    kept = [(r.doc_id, r.text) for r in near_dedup.distinct(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sum(t in near[2:] for _, t in kept) == 1  # a class without ids
    assert {x for x in kept if x[1] not in near[2:]} == {(1, " ".join(base)), (None, lone[0]), (None, lone[1]), (7, lone[2]), (8, lone[3])} and len(kept) == 6


def test_clashing_names_and_repeated_rows(spark, copies):
    """distinct() gives the rows that stay as they were, next to columns with names that operators use."""
    from pyspark.sql import functions as F

    import os

    clash = copies.withColumns({k: F.lit(j) for j, k in enumerate(("__own", "__maybe", "__TID", "__bucket", "__part", "__b", "class", "tid", "keys"))})
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(folder))
    kept = near_dedup.distinct(clash)
    rows = kept.collect()
    assert kept.columns == clash.columns and {tuple(r) for r in rows} <= {tuple(r) for r in clash.collect()}
    assert len(rows) == len(all_pairs(copies))  # one of each class, also of the class with a repeated row
    assert len(set(os.listdir(folder)) - before) == 1
    near_dedup.common.dropped(kept)
    assert set(os.listdir(folder)) == before


def test_recall_of_near_copies(spark):
    """Of pairs at a similarity of 0.8 or more, made by edits of known number, at least 0.9 share a class."""
    vocabulary = words("abcdefghijkl", 4000)
    rows, pairs = [], []
    for k in range(150):
        base = [RNG.choice(vocabulary) for _ in range(RNG.randint(80, 300))]
        copy = edited(base, max(1, len(base) // 60))
        x, y = ({" ".join(t[i : i + 5]) for i in range(len(t) - 4)} for t in (base, copy))
        if len(x & y) / len(x | y) >= 0.8:
            pairs.append((2 * k, 2 * k + 1))
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
    of = {r.doc_id: r.class_id for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(pairs) > 60 and np.mean([of[a] == of[b] for a, b in pairs]) >= 0.9


def test_sampling_estimates_weighted_similarity():
    rng = np.random.default_rng(2)
    ids = np.arange(1, 401, dtype=np.uint64) * np.uint64(7919)
    a, b = rng.choice([1.0, 2.0, 0.5], 400).astype(np.float32), rng.choice([1.0, 2.0, 0.5], 400).astype(np.float32)
    b[:200] = a[:200]
    first = np.array([0, 400])
    x, y = (near_dedup.samples(ids, w, first, 250) for w in (a, b))
    assert abs((x == y).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 4 * math.sqrt(0.25 / 250)


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (101, 102), (200, 200), (300, 299)] + [(k, 500) for k in range(400, 450)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 102: 100, 299: 299, 300: 299, **{k: 400 for k in range(400, 450)}, 500: 400}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_pipeline(spark, tables):
    """Each stage against a plain version on its own input."""
    import corpus_pipeline
    from lakepress.llm import common, decontaminate, exact_dedup, packing

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, bench = docs.columns, spark.read.parquet(f"{tables}/benchmark.parquet")
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(common.written(stage(spark, frames[-1], tables), name))
    assert all(f.columns == columns for f in frames[:-1])
    ids = [{r.doc_id for r in f.select("doc_id").collect()} for f in frames]
    assert all(b <= a for a, b in zip(ids, ids[1:]))
    model = toxicity.fit(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    assert ids[1] == {r.doc_id for r in toxicity.score(docs, model).where("predicted = 0").collect()}
    last = {}
    for r in frames[1].collect():
        last[r.text or ""] = max(r.doc_id, last.get(r.text or "", -1))
    assert ids[2] == set(last.values()) and exact_dedup.groups(frames[2]).where("group_size > 1").count() == 0
    assert ids[3] == {min(v)[1] for v in all_pairs(frames[2])}
    assert ids[4] == {r.doc_id for r in decontaminate.search(frames[3], bench).where("not contaminated").collect()}
    assert ids[5] == ids[4] and frames[5].count() == packing.pack(frames[4]).count()
    assert corpus_pipeline.run(spark, tables).count() == frames[5].count()


def test_pipeline_on_odd_documents(spark, tmp_path, copies):
    """Null and empty texts, null and repeated ids, repeated rows, a long text, clashing names; and no documents at all."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    from lakepress.llm import common

    odd = copies.withColumns({k: F.lit(j) for j, k in enumerate(("__n", "__text", "__own", "__bucket", "keep", "score"))})
    long = [("w%d " * 30_000) % tuple(range(30_000)), "a b c d e f g h"]
    odd = odd.unionByName(spark.createDataFrame([(5000 + k, t, None, None, *range(6)) for k, t in enumerate(long)], odd.schema))
    for name, frame in (("some", odd), ("none", odd.limit(0))):
        folder = str(tmp_path / name)
        frame.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(k, int(k % 7 > 0), 0) for k in range(50)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, "b c d e"), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        source = {tuple(r) for r in docs.collect()}
        for step, stage in corpus_pipeline.STAGES[:-1]:
            docs = common.written(stage(spark, docs, folder), step)
            rows = [tuple(r) for r in docs.collect()]
            assert docs.columns == frame.columns and set(rows) <= source
            if step == "exact_dedup":
                assert len({r[1] or "" for r in rows}) == len(rows)
        packed = corpus_pipeline.run(spark, folder).collect()
        assert sorted({str(r.doc_id) for r in packed}) == sorted({str(r[0]) for r in rows})
        if name == "some":
            assert any(r[0] == 5000 for r in rows) and not any(r[0] == 5001 for r in rows)


def test_the_rest_stands_alone():
    """Nothing else imports this subpackage, and the entry file works without it."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = "import sys; sys.modules['lakepress.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert e.oracle_sql()"
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-500:]
    for folder in ("functions", "operators", "plans", "sources", "streaming"):
        for name in os.listdir(f"{root}/lakepress/{folder}"):
            if name.endswith(".py"):
                assert "lakepress.llm" not in open(f"{root}/lakepress/{folder}/{name}").read()
