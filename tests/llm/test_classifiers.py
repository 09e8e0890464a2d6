import collections
import math
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociframe.llm import langid, quality_cnn, toxicity

LOWER = {i: i + 32 for i in range(65, 91)}
SF = os.environ.get("TEST_LLM_SF_DIR", "/root/testdata/sf0.1")


def held(i, folds, fold):
    return zlib.crc32(str(i).encode()) % folds == fold


def auc(rows):
    rows = sorted(rows)
    ranks = {}
    for k, (s, _) in enumerate(rows):
        ranks.setdefault(s, []).append(k + 1)
    n1 = sum(y for _, y in rows)
    r1 = sum(sum(ranks[s]) / len(ranks[s]) for s, y in rows if y)
    return (r1 - n1 * (n1 + 1) / 2) / (n1 * (len(rows) - n1))


def toy(spark, seed=1, n=240):
    rng = random.Random(seed)
    common = ["the", "and", "house", "tree", "walk", "green", "little", "river"]
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        w = [rng.choice(common) + rng.choice(["", "s", "ed", "."]) for _ in range(rng.randint(10, 60))]
        if bad:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["scoundrel", "scoundrels", "rotten"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(not bad), int(bad)))
    rows += [(1000, None), (1001, ""), (1002, "  \n"), (3, "the house")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("label", F.lit(9)), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_toy(spark):
    docs, labels = toy(spark)
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == docs.count()
    assert all(r.held_out == held(r.doc_id, 5, 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert auc([(r.score, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]) > 0.97
    assert len({r.score for r in got if r.doc_id >= 1000}) == 1


def test_without_labels_or_rows(spark):
    docs, labels = toy(spark, n=20)
    none = labels.limit(0)
    assert {r.score for r in toxicity.classify(docs, none).collect()} == {0.5}
    assert {r.score for r in quality_cnn.classify(docs, none).collect()} == {0.5}
    assert toxicity.classify(docs.limit(0), labels).collect() == []
    assert langid.identify(docs.limit(0).withColumn("lang", F.lit("en"))).collect() == []
    und = langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in und} == {"und"}


def test_quality_gradient_learns(spark):
    rng = np.random.default_rng(0)
    good = [rng.integers(97, 123, 300).astype(np.uint8) for _ in range(40)]
    bad = [np.where(np.arange(300) % 7 == 0, 33, rng.integers(65, 91, 300)).astype(np.uint8) for _ in range(40)]
    m = quality_cnn.train(good[:30] + bad[:30], np.array([1.0] * 30 + [0.0] * 30, np.float32), np.ones(60))
    s = quality_cnn.scores(m, good[30:] + bad[30:] + [np.zeros(0, np.uint8)])
    assert s[:10].min() > 0.5 > s[10:20].max() and 0 <= s[20] <= 1
    long = np.concatenate([good[0]] * 2000)
    assert quality_cnn.scores(m, [long])[0] == pytest.approx(quality_cnn.scores(m, [long, good[1]])[0])


def test_long_texts_have_no_seams(monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab c.\u00e9\u03a3 ") for _ in range(n)) for n in (0, 1, 2, 5, 50, 700)] + [None, "   ", "." * 30]
    whole = langid.counts(texts)
    for piece in (1, 2, 3, 7):
        monkeypatch.setattr(langid, "_PIECE", piece)
        assert (langid.counts(texts) == whole).all()


def test_language_equals_plain_cosine(spark):
    rng = random.Random(6)
    words = {"xx": ["lorem", "ipsum", "dolor"], "yy": ["kala", "moja", "tuli"]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(30)), lang) for i in range(40) for lang in [("xx", "yy")[i % 2]]]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    idf, langs, centres = langid.fit(train)
    df = collections.Counter()
    for _, t, _ in rows:
        df.update(np.flatnonzero(langid.counts([t])[0]).tolist())
    assert idf == pytest.approx([math.log(41 / (1 + df[d])) + 1 for d in range(langid.DIMS)], rel=1e-5)
    assert np.linalg.norm(centres, axis=1) == pytest.approx(np.ones(len(centres)), abs=1e-5)
    for r in langid.predict(train, (idf, langs, centres)).join(train, "doc_id").collect():
        n = langid.counts([r.text])[0].astype(float)
        v = np.where(n > 0, 1 + np.log(np.maximum(n, 1)), 0) * idf
        cos = centres @ v / np.linalg.norm(v)
        assert r.score == pytest.approx(cos.max(), abs=1e-4) and r.lang_pred == langs[int(cos.argmax())]


def test_long_labelled_texts_are_learnt_from(spark, monkeypatch):
    """All texts are of 100 KB: they are in the sample, the classes part, and pieces give what one pass gives."""
    rng = np.random.default_rng(3)
    rows = [(i, "".join(chr(97 + 13 * (i % 2) + c) for c in rng.integers(0, 13, 100_000))) for i in range(24)]
    labels = [(i, i % 2) for i in range(24)]
    df, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    monkeypatch.setattr(quality_cnn, "EPOCHS", 4)
    texts = [np.frombuffer(t.encode(), np.uint8) for _, t in rows[:8]]
    y, w = np.array([i % 2 for i in range(8)], np.float32), np.ones(8)
    whole = quality_cnn.train(texts, y, w)
    monkeypatch.setattr(quality_cnn, "_PIECE_CHUNKS", 50)
    pieces = quality_cnn.train(texts, y, w)
    assert all(np.allclose(whole[k], pieces[k], atol=1e-5) for k in whole)
    monkeypatch.setattr(quality_cnn, "EPOCHS", 60)
    got = quality_cnn.classify(df, known).collect()
    by = {c: np.mean([r.score for r in got if r.doc_id % 2 == c]) for c in (0, 1)}
    assert by[1] > by[0] + 0.2


def test_quality_scores_equal_a_plain_forward_pass():
    rng = np.random.default_rng(2)
    texts = [rng.integers(97, 123, 600).astype(np.uint8) for _ in range(6)]
    y = np.array([1, 0, 1, 0, 1, 0], np.float32)
    m = quality_cnn.train(texts, y, np.ones(6))
    plain = []
    for t in texts:
        pooled = np.array([[max(sum(m["filters"][j][c[p + j]][f] for j in range(quality_cnn.WIDTH)) for p in range(quality_cnn.CHUNK - quality_cnn.WIDTH + 1)) for f in range(quality_cnn.FILTERS)] for c in quality_cnn.chunks_of(t)])
        hidden = np.maximum(np.maximum(pooled + m["fb"], 0) @ m["w1"] + m["b1"], 0).max(axis=0)
        plain.append(1 / (1 + np.exp(-(hidden @ m["w2"] + m["b2"][0]))))
    assert quality_cnn.scores(m, texts) == pytest.approx(np.array(plain), abs=1e-4)


def test_chunks_cover_everything():
    for n in (0, 1, 255, 256, 257, 448, 449, 5000):
        c = quality_cnn.chunks_of(np.ones(n, np.uint8))
        assert sum(int(x.sum()) for x in c) >= n and c.shape[1] == quality_cnn.CHUNK
        assert (len(c) - 1) * quality_cnn.STRIDE + quality_cnn.CHUNK >= n


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    lang = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in lang) / len(lang) > 0.97
    truth = {r.doc_id: r for r in labels.collect()}
    q = [(r.score, truth[r.doc_id].quality) for r in quality_cnn.classify(docs, labels).where("held_out").collect() if r.doc_id in truth]
    assert auc(q) > 0.97
    t = [(r.score, truth[r.doc_id].toxic) for r in toxicity.classify(docs, labels).where("held_out").collect() if r.doc_id in truth]
    found = sum(s >= 0.5 for s, y in t if y)
    assert found >= 0.9 * sum(y for _, y in t) and found >= 0.9 * sum(s >= 0.5 for s, _ in t)


def test_keep_good_keeps_columns_and_clean_rows(spark):
    docs, labels = toy(spark)
    kept = quality_cnn.keep_good(docs, labels)
    assert kept.schema == docs.schema and kept.count() > 0


def plain_parts(text):
    out = []
    for w in (text or "").translate(LOWER).encode().split():
        w = [w[i : i + toxicity.PART] for i in range(0, len(w), toxicity.PART)]
        out += [*w[:-1], w[-1] + bytes([toxicity.END])]
    return out


def plain_measures(docs, train):
    """d, top and next of each text by modified Kneser-Ney with plain dictionaries, nothing left out."""
    texts = collections.defaultdict(lambda: [0, 0])
    for text, label in train:
        for x in set(plain_parts(text)):
            texts[x][label] += 1
    count = collections.defaultdict(lambda: [0, 0, 0])  # ordinary texts, toxic texts, words
    for x, c in texts.items():
        for n in range(1, len(x) + 1):
            count[x[:n]] = [count[x[:n]][0] + c[0], count[x[:n]][1] + c[1], count[x[:n]][2] + 1]
    after = collections.defaultdict(list)
    for h in count:
        after[h[:-1]].append(h)
    ends = collections.Counter(h[-1] for h in count)
    D = [toxicity.CLASS_DISCOUNTS, toxicity.CLASS_DISCOUNTS, toxicity.SHARED_DISCOUNTS]
    taken = sum(max(n - D[2][1], 0) for n in ends.values())

    def p(hb, k):
        known = hb in count
        if k == 3:
            return (max(ends[hb[-1]] - D[2][1], 0) + (sum(ends.values()) - taken) / 256) / sum(ends.values())
        same = [count[x][k] for x in after[hb[:-1]]]
        lower = p(hb, 3) if k == 2 else p(hb, 2)
        if not sum(same):
            return lower if k < 2 else 1.0
        if k == 2 and not known:
            return 1.0
        own = count[hb][k] if known else 0
        return (own - D[k][min(own, 3)] + sum(D[k][min(c, 3)] for c in same) * lower) / sum(same)

    def value(x):
        return sum(math.log(p(x[:n], 1) / p(x[:n], 0)) for n in range(1, len(x) + 1))

    out = []
    for t in docs:
        v = sorted((value(x) for x in plain_parts(t)), reverse=True)
        out.append((sum(v) / max(1, len(v)), v[0] if v else 0, v[min(1, len(v) - 1)] if v else 0, math.log1p(len(v))))
    return out


@pytest.mark.parametrize("buckets", [2, 9])
def test_toxicity_models_equal_plain_ones(spark, buckets):
    train = [("the house and the tree", 0), ("a green tree walks", 0), ("the rotten knave", 1), ("a vile zug zug", 1), ("The trees", 0), ("knave and knaves", 1), (None, 1)]
    train += [("a-long-and-hyphenated-house", 0), ("the river-and-the-little-tree", 0), ("a-long-and-hyphenated-knave", 1), ("\u6211\u4eec\u4eca\u5929\u53bb\u516c\u56ed\u6563\u6b65", 0)]
    docs = ["zug", "the zug of the house", "knaves", "", None, " \n ", "tree Rotter zu", "qqq", "a-long-and-hyphenated-knave", "\u6211\u4eec\u4eca\u5929\u53bb\u574f\u86cb", "x" * 300 + "-knave " + "y" * 70, "nul\0 \x01byte", "word " * 5000 + "knave"]
    docs = [*docs, *docs]
    labelled = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(train)], "id long, txt string, label int")
    rows = spark.createDataFrame([(None if i == 3 else i, t, 5) for i, t in enumerate(docs)], "doc_id long, text string, size int")
    got = toxicity.measures(rows, labelled, "doc_id", "text", buckets).collect()
    want = dict(enumerate(plain_measures([d.replace("\0", "\x01") if d else d for d in docs], train)))
    assert len(got) == len(docs)
    for r in got:
        assert (r.d, r.top, r.next, r.size) == pytest.approx(want[3 if r.id is None else r.id], abs=1e-5)


def test_logistic_equals_plain_newton(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 2)) * [3, 0.1] + [1, 5]
    y = (rng.random(200) < 1 / (1 + np.exp(-(x[:, 0] - 1 + 8 * (x[:, 1] - 5))))).astype(int)
    got = toxicity.fit_logistic(spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "a double, b double, label int"), ("a", "b"), "label", 1e-9)
    z = np.c_[x, np.ones(200)]
    p = 1 / (1 + np.exp(-z @ got))
    assert np.abs(z.T @ (y - p)).max() < 1e-3  # the likelihood's gradient is 0
    assert toxicity.fit_logistic(spark.createDataFrame([(1.0, 1.0, 1)], "a double, b double, label int"), ("a", "b"), "label") is None
