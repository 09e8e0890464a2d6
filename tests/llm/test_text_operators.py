import glob
import hashlib
import random
import re
import zlib
from urllib.parse import urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociframe.llm import bpe, decontam, license, telephony, urlgraph
from lociframe.llm.shared import shared_folder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("r")).withColumn("hits", F.lit(0))


def test_bpe_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    pytest.importorskip("public_tokenizers")
    vocabulary = bpe.load_vocabulary()
    t = tokenizers.Tokenizer.from_str(vocabulary)
    rng = random.Random(1)
    alphabet = list("aB.,;:!?'\"-_ \n\t\r\x0b\x0c09éÉßſḰ  😀<|>") + ["'s", "'ll", "<|endoftext|>", "<|EndOfText|>", "日本"]
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "word " * 3000), (1003, "x" * 4000), (5, "again, again."), (None, "no id"), (None, None)]
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids), r.decoded) for r in bpe.encode(docs(spark, rows).repartition(3), keep_ids=True, keep_text=True).collect()]
    want = []
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        text = t.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), tuple(ids), text))
    assert sorted(got, key=str) == sorted(want, key=str)
    back = bpe.decode(spark.createDataFrame([(1, [320, 539]), (2, []), (3, None)], "k int, ids array<int>"), vocabulary)
    assert {r.k: r.decoded for r in back.collect()} == {1: t.decode([320, 539], skip_special_tokens=False), 2: "", 3: ""}
    assert bpe.encode(docs(spark, []).limit(0)).collect() == []


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_decontamination_finds_what_brute_force_finds(spark):
    rng = random.Random(2)
    words = [f"v{i}" for i in range(800)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, say(rng.randint(3, 90))) for i in range(40)] + [(98, ""), (99, None)]
    rows = [(0, None), (1, ""), (2, items[0][1])]
    for i in range(3, 120):
        text = say(rng.choice([3, 50, 400, 3000]))
        if i % 2:
            w = rng.choice(items[:40])[1].split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                w[rng.randrange(len(w))] = "edited"
            at = rng.randrange(len(text) + 1)
            text = text[:at] + " " + " ".join(w).upper() + " " + text[at:]
        rows.append((i, text))
    got = {(r.doc_id, r.item_id): r.n_shared for r in decontam.contaminated(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for d, t in rows:
        s = shingles(t)
        for i, x in items:
            q = shingles(x)
            if q and 100 * len(q & s) >= 80 * len(q):
                want[d, i] = len(q & s)
    assert len(want) > 20
    assert got.items() <= want.items()
    assert len(got) >= 0.99 * len(want)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(docs(spark, rows), none).collect() == []


def test_license_places(spark):
    phrases = {t.label: t.words.split() for t in license.PHRASES}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    rows = [(0, None), (1, ""), (2, "CC-BY, cc by cc BY. All rights\nreserved! all rights rights reserved"), (3, "GNU General  Public-License general public General Public License " * 40), (4, "Permission is hereby granted, free of charge, to any person obtaining a copy of this fine software and associated documentation files (the Software), to deal in the Software without restriction"), (5, "é all rights reserved"), (2, "cc by")]
    got = license.labels(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    left = list(rows)
    for r in got:
        pick = next(x for x in left if x[0] == r.doc_id and len(word.findall((x[1] or "").translate(LOWER))) == r.n_words)
        left.remove(pick)
        w = word.findall((pick[1] or "").translate(LOWER))
        places = [(j, k) for k, p in phrases.items() for j in range(len(w) - len(p) + 1) if w[j : j + len(p)] == p]
        assert r.n_base == len(places)
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({k for _, k in places}))
        assert 0 <= r.score <= 1
    assert "grant-mit" in next(r.labels for r in got if r.doc_id == 4)
    assert license.labels(docs(spark, []).limit(0)).collect() == []


def test_license_bodies(spark):
    body = {t.label: t.words for t in license.BODIES}["mit"]
    rng = random.Random(5)
    words = body.split()
    for i in rng.sample(range(len(words)), 8):
        words[i] = rng.choice(["", "changed", "two words"])
    mixed = words[:40] + ["other"] * 200 + words[40:80] + ["more"] * 200
    rows = [(1, "x " * 50 + " ".join(words) + " y" * 50), (2, " ".join(mixed)), (3, " ".join(w for t in license.BODIES for w in t.words.split()[:12])), (None, body + " " + body)]
    got = {r.doc_id: r for r in license.labels(docs(spark, rows)).collect()}
    assert "mit" in got[1].labels.split(",") and 0.7 < got[1].score < 1
    assert not {"mit", "isc", "bsd-3-clause"} & set(got[2].labels.split(","))  # halves far apart
    assert not {t.label for t in license.BODIES} & set(got[3].labels.split(","))
    assert "mit" in got[None].labels.split(",") and got[None].score == 1
    spans = license.scan(docs(spark, rows[3:]))[1].where("label = 'mit'").orderBy("first").collect()
    n = len(re.findall(r"[a-z0-9]+", body.lower()))
    assert [(r["first"], r["last"]) for r in spans] == [(0, n - 1), (n, 2 * n - 1)]


def ima(block):
    """Sample by sample, as the format says."""
    value = int.from_bytes(block[:2], "little", signed=True)
    index, out = min(block[2], 88), []
    out.append(value)
    for byte in block[4:]:
        for nibble in (byte & 15, byte >> 4):
            step = int(telephony.STEPS[index])
            change = (step >> 3) + (step if nibble & 4 else 0) + (step >> 1 if nibble & 2 else 0) + (step >> 2 if nibble & 1 else 0)
            value = max(-32768, min(32767, value - change if nibble & 8 else value + change))
            index = max(0, min(88, index + int(telephony.CHANGES[nibble])))
            out.append(value)
    return out


def test_telephony(spark):
    assert telephony.mulaw_table()[[0, 127, 128, 255]].tolist() == [-32124, 0, 32124, 0]
    assert telephony.alaw_table()[[0xD5, 0x55, 0xAA, 0x2A]].tolist() == [8, -8, 32256, -32256]
    rng = np.random.default_rng(3)
    blocks = rng.integers(0, 256, (7, 40), dtype=np.uint8)
    assert telephony.decode_adpcm(blocks).tolist() == [ima(b.tobytes()) for b in blocks]
    rows = [(0, None), (1, ""), (2, "hello é"), (3, "x" * 192), (4, "y" * 193), (5, "hello é"), (6, "z" * 100_000)] + [(10 + i, f"text {i}") for i in range(30)]
    got = {r.doc_id: r for r in telephony.media_features(docs(spark, rows)).collect()}
    for i, t in rows:
        raw = (t or "").encode()
        pay = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-16:]))
    assert got[2][1:] == got[5][1:] and got[0][1:] == got[1][1:]
    assert {r.feature.split(":")[0] for r in got.values()} == {"mulaw", "alaw", "adpcm"}
    media = telephony.text_media(docs(spark, rows))
    pcm = telephony.pcm_media(media, "doc_id").collect()
    assert all(telephony.parse(r.media)[0] == 1 and r.rate == 16000 for r in pcm)
    broken = spark.createDataFrame([(1, None), (2, bytearray(b"RIFFxxxx"))], "id int, media binary")
    assert [r.media for r in telephony.pcm_media(broken).collect()] == [None, None]
    assert telephony.resample(np.array([0, 10], np.int16)).tolist() == [0, 5, 10, 10]


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("rank", F.lit(1))


def test_url_rules_and_graph(spark):
    a = '<a href="http://{}/x">y</a>'
    rows = [
        (1, "http://A.example.COM/en/1", ""), (2, "https://www.example.com/en/2?x#y", None), (3, "https://www.example.com", ""), (4, "http://x.net/es/", ""), (5, "no url", ""), (6, None, ""),
        (7, "http://good.org/a", a.format("site.com")), (8, "http://bad.org/", a.format("x.net") * 3), (9, "http://liked.org/", ""), (10, "http://site.com/z", a.format("liked.org")), (11, "ftp://notexample.com.evil/en/?://com/", ""), (12, "http://com/", ""), (12, "http://com/", ""),
    ]
    got = {}
    for r in urlgraph.judge(pages(spark, rows)).collect():
        got.setdefault(r.page_id, []).append(r)
    assert [len(v) for _, v in sorted(got.items())] == [1] * 11 + [2]
    one = lambda i: (got[i][0]["host"], got[i][0]["path"], got[i][0]["rule"], got[i][0]["verdict"])
    assert one(1) == ("a.example.com", "/en/1", "example.com/en/", "block")
    assert one(2) == ("www.example.com", "/en/2", "www.example.com/en/", "allow")
    assert one(3) == ("www.example.com", "", None, one(3)[3])
    assert one(4) == ("x.net", "/es/", "net/es/", "block")
    assert one(5) == one(6) == ("", "", None, "allow")
    assert one(8)[2:] == (None, "block")  # links to a blocked host
    assert one(9)[2:] == (None, "allow")
    assert one(11)[:3] == ("notexample.com.evil", "/en/", None)
    assert one(12)[2] == "com/"
    assert got[9][0].trust > 0  # linked from a trusted host
    assert urlgraph.judge(pages(spark, []).limit(0)).collect() == []


def test_ranks_equal_plain_iteration(spark):
    edges = [("a", "b", 1.0), ("b", "c", 2.0), ("b", "a", 1.0), ("d", "a", 4.0), ("d", "e", 1.0), ("f", "f2", 1.0)]
    seeds = {"a": 1.0, "d": 3.0, "g": 0.0}
    both = lambda rows, cols: spark.createDataFrame([(k, *r) for r in rows for k in ("x", "y")], "kind string, " + cols)
    found = urlgraph.personalised_ranks(both(edges, "src string, dst string, weight double"), both(list(seeds.items()), "host string, weight double"), tolerance=1e-9).collect()
    out = {}
    for s, _, w in edges:
        out[s] = out.get(s, 0) + w
    start = {h: w / 4 for h, w in seeds.items() if w}
    rank = dict(start)
    for _ in range(200):
        new = {}
        for s, d, w in edges:
            if s in rank:
                new[d] = new.get(d, 0) + urlgraph.DAMPING * rank[s] * w / out[s]
        rest = 1 - sum(new.values())
        for h, w in start.items():
            new[h] = new.get(h, 0) + rest * w
        rank = new
    for kind in ("x", "y"):
        got = {r.host: r["rank"] for r in found if r.kind == kind}
        assert got.keys() == rank.keys() and all(abs(got[h] - rank[h]) < 1e-8 for h in rank)
        assert abs(sum(got.values()) - 1) < 1e-9


def test_links_and_kinship_turn_verdicts(spark):
    seeds = [(1, "http://x.net/es/", ""), (2, "http://y.com/", "")]
    verdicts = lambda rows: {r.page_id: (r.verdict, r.trust, r.distrust) for r in urlgraph.judge(pages(spark, seeds + rows)).collect()}
    assert verdicts([(3, "http://a.org/", "")])[3] == ("allow", 0, 0)
    assert verdicts([(3, "http://a.org/", '<link rel=canonical href="http://x.net/es/">')])[3][0] == "block"
    assert verdicts([(3, "http://a.org/", '<meta http-equiv=refresh content="0;url=http://x.net/">')])[3][0] == "block"
    kin = verdicts([(3, "http://m.bad.org/", '<a href="http://x.net/">x</a>'), (4, "http://www.bad.org/", ""), (5, "http://10.0.0.1/", "")])
    assert kin[4][0] == "block" and kin[5] == ("allow", 0, 0)
    tie = verdicts([(3, "http://a.com.x/", ""), (4, "http://t.org/", "")])
    assert tie[4][0] == "allow"
    got = urlgraph.kin_edges(spark.createDataFrame([("a.b.c.d",), ("b.c.d",), ("c.d",), ("d",), ("1.2.3.4:80",)], "host string")).collect()
    assert {(r.src, r.dst) for r in got} == {("a.b.c.d", "b.c.d"), ("b.c.d", "c.d"), ("b.c.d", "a.b.c.d"), ("c.d", "b.c.d")} and len(got) == 4


def test_stored_media_reads_back(spark, tmp_path):
    rows = [(1, "hello"), (None, None), (2, "y" * 5000)]
    kept = telephony.store_media(docs(spark, rows), f"file://{tmp_path}/media", factor=3).collect()
    assert {r.doc_id for r in kept} == {1, 2, None}
    for r in kept:
        tag, align, data = telephony.parse(bytes(r.media))
        assert telephony.read_back(tag, align, data).decode().rstrip(" ") == (dict(rows)[r.doc_id] or "")
        samples = telephony.to_pcm([(tag, align, data)])[0]
        assert np.array_equal(np.frombuffer(telephony.parse(bytes(r.pcm))[2], "<i2"), telephony.resample(samples, 3))
    digests = {r.doc_id: r for r in telephony.media_features(docs(spark, rows), factor=3).collect()}
    assert all((digests[r.doc_id].pcm_bytes, digests[r.doc_id].pcm_sha256) == (len(r.pcm), hashlib.sha256(bytes(r.pcm)).hexdigest()) for r in kept)


def test_query_stores_both_media(spark):
    """The resampled PCM is a stored column beside the telephony audio, and what the query describes is what is stored."""
    rows = [(1, "hello"), (None, None), (2, "y" * 5000), (3, "".join(chr(33 + i * i % 90) for i in range(3000)))] + [(10 + i, f"text {i}") for i in range(12)]
    before = set(glob.glob(f"{urlparse(shared_folder(spark)).path}/media*"))
    got = {r.doc_id: r for r in telephony.media_features(docs(spark, rows)).collect()}
    (path,) = set(glob.glob(f"{urlparse(shared_folder(spark)).path}/media*")) - before
    kept = spark.read.parquet(f"file://{path}").collect()
    assert {r.id for r in kept} == set(dict(rows)) and {bytes(r.pcm)[0] for r in kept} <= {1, 2}
    for r in kept:
        pcm = telephony.unpack(bytes(r.pcm))
        samples = telephony.to_pcm([telephony.parse(bytes(r.media))])[0]
        assert np.array_equal(np.frombuffer(telephony.parse(pcm)[2], "<i2"), telephony.resample(samples, 2))
        assert (got[r.id].pcm_bytes, got[r.id].pcm_sha256) == (len(pcm), hashlib.sha256(pcm).hexdigest())


def test_packed_pcm_comes_back():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 255, 600):
        for x in (rng.integers(-32768, 32768, n), rng.integers(-3, 3, n)):
            file = telephony.wave(1, x.astype("<i2").tobytes())
            assert telephony.unpack(telephony.pack(file)) == file
            fine = telephony.wave(1, telephony.resample(x.astype(np.int16), 3).astype("<i2").tobytes())
            assert telephony.unpack(telephony.pack(fine)) == fine
    for odd in (b"", b"x", b"RIFF" * 20, telephony.wave(1, b""), telephony.wave(7, b"abc")):
        assert telephony.unpack(telephony.pack(odd)) == odd


def test_packed_pcm_is_small():
    """A packed file has a byte a sample between, none for interpolated ones, and what has no code stands after them."""
    rng = np.random.default_rng(5)
    words = [bytes(rng.integers(97, 123, rng.integers(2, 10), np.uint8)) for _ in range(300)]
    seen = set()
    for i in range(30):
        payload = telephony.payload_of(b" ".join(words[j] for j in rng.integers(0, 300, 400 + i)))
        media = telephony.store(payload)
        pcm = telephony._expanded([media], 2)[0]
        packed = telephony.pack(pcm)
        adpcm = telephony.parse(media)[0] == telephony.ADPCM
        assert telephony.unpack(packed) == pcm and len(packed) < (2.6 if adpcm else 1.1) * len(payload)
        seen.add(packed[0])
    assert seen == {1, 2}


def test_packed_pcm_of_any_samples_comes_back():
    rng = np.random.default_rng(6)
    edges = np.array([0, 1, -1, 32767, -32768, 32766, -32767])
    for x in (rng.choice(edges, 500), np.cumsum(rng.choice(telephony.RISES, 500)), np.repeat(edges, 40), rng.choice(telephony.EXPAND[telephony.ALAW], 301), np.zeros(7)):
        x = x.astype(np.int64).astype(np.int16)
        for samples in (x, telephony.resample(x), telephony.resample(x, 3), np.append(telephony.resample(x), x[:1])):
            file = telephony.wave(1, samples.astype("<i2").tobytes())
            assert telephony.unpack(telephony.pack(file)) == file


def test_decontamination_of_short_and_repeated_items(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    items, rows = [], []
    for i in range(160):
        own = [word() for _ in range(1 + i % 16)]
        items.append((i, " ".join(own)))
        rows.append((i, " ".join([word() for _ in range(300)] + own + [word() for _ in range(300)]) if len(own) >= 5 else " ".join(own)))
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {(i, i) for i in range(160)} <= got
    twice = spark.createDataFrame([(1, "a b c d e f g h i j"), (1, "q r s t u"), (None, "v w x y z"), (2, None), (3, "")], "item_id long, text string")
    found = decontam.contaminated(docs(spark, [(7, "a b c d e f g h i"), (7, "q r s t u v w x y z"), (None, "v w x y z"), (9, "a b")]), twice).collect()
    assert {(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in found} == {(7, 1, 1, 1), (7, None, 1, 1), (None, None, 1, 1)}
