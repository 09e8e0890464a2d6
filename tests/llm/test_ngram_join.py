import collections
import random
import re
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lociframe.llm import ngram_join
from lociframe.llm.components import connected_components
from lociframe.llm.ngram_join import jaccard_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x = len(sets[a] & sets[b])
            if x and 100 * x >= 80 * (len(sets[a]) + len(sets[b]) - x):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def make(seed, n):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    words = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passage = words(40)
    rows = [(0, None), (1, ""), (2, "  \n\t"), (3, "one two"), (4, "ONE\ttwo"), (5, "One two three")]
    bases = [words(rng.randint(8, 120)) for _ in range(n)]
    i = 6
    for base in bases:
        for _ in range(rng.choice([1, 1, 2, 5, 12])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                at = rng.randrange(len(w))
                kind = rng.randrange(3)
                w[at : at + 1] = [rng.choice(vocabulary)] if kind == 0 else [] if kind == 1 else [w[at], rng.choice(vocabulary)]
            if rng.random() < 0.3:
                w = w + passage if rng.random() < 0.5 else passage + w
            rows.append((i, " ".join(x.upper() if rng.random() < 0.1 and x.isascii() else x for x in w)))
            i += 1
    rng.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    for seed, n in ((1, 40), (2, 25)):
        rows = make(seed, n)
        df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("tok", F.lit("x")).repartition(5)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df).collect()}
        assert got == brute(rows)


def test_many_buckets_and_blocks(spark, monkeypatch):
    rows = make(7, 30)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df, buckets=500).collect()}
    assert got == brute(rows)


def test_pieces_do_not_grow_with_the_number_of_buckets(monkeypatch):
    """The first exchange at 1,250 buckets, about what 30 GB have."""
    rng = np.random.default_rng(1)
    vocabulary = ["".join(map(chr, rng.integers(97, 123, n))) for n in rng.integers(1, 11, 50_000)]
    texts = [" ".join(vocabulary[i] for i in rng.integers(0, 50_000, n)) for n in rng.integers(50, 900, 3400)]
    monkeypatch.setattr(ngram_join, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    sizes = {}
    for buckets in (16, 1250):
        batches = ngram_join._deal(5, buckets)(iter(pa.record_batch([pa.array(texts)], names=["txt"]).slice(i, 500) for i in range(0, len(texts), 500)))
        sizes[buckets] = sum(len(p.as_py()) + 28 for b in batches for p in b.column(3))
    assert sizes[1250] <= 1.4 * sum(map(len, texts)) and sizes[1250] <= 1.15 * sizes[16]


def test_one_large_family(spark):
    """Near copies of one text, each with edits of its own, many of them not similar to each other."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10_000)}" for _ in range(60)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(w))
            if rng.random() < 0.5:
                w[at] = rng.choice(["alpha", "beta", f"own{i}"])
            else:
                del w[at]
        rows.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_empty_and_repeated(spark):
    e = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_components(e).collect() == []
    d = spark.createDataFrame([(7, "a b c d e f"), (7, "a b c d e f"), (3, "a b c d e f")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in jaccard_components(d).collect()) == [(3, 3), (7, 3), (7, 3)]
    base = [f"w{i}" for i in range(40)]
    a, b, c = " ".join(base), " ".join([*base, "x"]), " ".join(f"q{i}" for i in range(9))
    d = spark.createDataFrame([(1, a), (2, a), (2, c), (5, b), (5, c), (9, c), (None, b), (None, None), (4, " ".join(base * 3000))], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(d).collect()), key=str)
    assert got == sorted([(1, 36, 1), (2, 36, 1), (2, 5, 2), (5, 37, 1), (5, 5, 2), (9, 5, 2), (None, 37, None), (None, 0, None), (4, 40, 1)], key=str)


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(25)] + [(500, 500), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = collections.defaultdict(set)
    for a, b in edges:
        if a != b:
            parent[a].add(b)
            parent[b].add(a)
    for start in parent:
        seen, todo = {start}, [start]
        while todo:
            for y in parent[todo.pop()]:
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        assert got[start] == min(seen)
    assert set(got) == set(parent)
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
