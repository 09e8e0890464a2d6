import hashlib
import random

import pytest
import zstandard
from pyspark.sql import functions as F

from lociframe.llm import warc
from lociframe.llm.shared import fresh_path, spread_join

SCHEMA = "page_id long, url string, html string, content string, digest string"
BIG = "<p>é" + "x" * 200
ROWS = [
    (5, "https://a.example/ä b?q=%20", BIG, "", ""), (2, None, BIG, "", ""), (9, "", BIG, "", ""),
    (1, "u", "tiny", "", ""), (4, "u", "tiny", "", ""), (6, "u", None, "", ""), (7, "u", "", "", ""),
    (None, "u", BIG, "", ""), (None, "u", "only " * 40, "", ""), (None, "u", "only " * 40, "", ""),
    (8, "u\r\nInjected: 1", "z" * 99, "", ""), (10, "u", "z" * 99, "", ""), (11, "u", "z" * 100, "", ""), (12, "u", "z" * 100, "", ""),
    (13, "u", "WARC/1.1\r\n\r\n" * 30_000, "", ""), (14, "u", "same", "", ""), (14, "u", "same", "", ""), (15, "u", "\0" * 150, "", ""),
]


def plain(rows):
    first = {}
    for i, _, html, *_ in rows:
        x = (html or "").encode()
        if len(x) >= 100 and i is not None:
            first[x] = min(i, first.get(x, i))
    out = []
    for i, _, html, *_ in rows:
        x = (html or "").encode()
        f = first.get(x)
        again = f is not None and (i is None or i > f)
        out.append((i, len(x), hashlib.sha256(x).hexdigest(), "revisit" if again else "response", f if again else None))
    return sorted(out, key=repr)


def test_against_plain(spark):
    got = warc.archived_pages(spark.createDataFrame(ROWS, SCHEMA).repartition(4), fresh_path(spark, "warc"))
    assert sorted((tuple(r)[:5] for r in got.collect()), key=repr) == plain(ROWS)
    assert warc.archived_pages(spark.createDataFrame([], SCHEMA), fresh_path(spark, "warc")).collect() == []


def test_bundles_are_seekable():
    rng = random.Random(2)
    records = [(f"r{i}", rng.randbytes(rng.choice([1, 10, 5000]))) for i in range(400)]
    made = list(warc.bundles(iter(records), 4000, 60_000))
    assert len(made) > 3
    back = {}
    for content, entries in made:
        places = warc.read_seek_table(content)
        frames = [warc.read_frame(content, p) for p in places]
        # any reader of Zstandard gets the same bytes, and passes over the table
        assert zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(content[: sum(p[1] for p in places)]) == b"".join(frames)
        for name, frame, start, length in entries:
            back[name] = frames[frame][start : start + length]
    assert back == dict(records)
    content = bytearray(made[0][0])
    content[3] ^= 255
    with pytest.raises((ValueError, zstandard.ZstdError)):
        warc.read_frame(bytes(content), warc.read_seek_table(bytes(content))[0])


def test_records_round_trip():
    d = hashlib.sha256(b"x\r\n\r\ny").hexdigest()
    fields, http, payload = warc.parse_record(warc.make_record("a:b c", "ü\r\nX: 1".encode(), b"x\r\n\r\ny", d, None))
    assert payload == b"x\r\n\r\ny" and fields["warc-target-uri"] == "%C3%BC%0D%0AX:%201" and "x" not in fields and http.startswith(b"HTTP/1.1 200")
    fields, _, payload = warc.parse_record(warc.make_record(None, None, b"abc", d, "urn:x"))
    assert payload == b"" and fields["warc-type"] == "revisit" and fields["warc-refers-to"] == "<urn:x>" and "warc-target-uri" not in fields


def test_fetch_inflates_only_named_frames(spark, tmp_path):
    rows = [(i, f"u{i}", f"page {i} " * 300) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    archive = warc.write_archive(pages, fresh_path(spark, "warc"), "page_id", "url", "html", frame=20_000, bundle=2_500)
    assert archive.count() > 6 and warc.index(archive).groupBy("bundle").agg(F.max("frame")).where("`max(frame)` > 1").count() > 3
    names = [warc.record_name(str(i), hashlib.sha256((f"page {i} " * 300).encode()).hexdigest()) for i in (7, 250)]
    # every frame but those of the two records is destroyed, and they are still read
    keep = {(r.bundle, r.frame) for r in warc.index(archive).where(F.col("record_id").isin(names)).collect()}
    broken = []
    for r in archive.collect():
        content = bytearray(r.content)
        for k, (at, size, _, _) in enumerate(warc.read_seek_table(r.content)):
            if (r.bundle, k) not in keep:
                content[at : at + size] = b"\xff" * size
        broken.append((r.bundle, content, r.entries))
    got = warc.fetch(spark.createDataFrame(broken, warc.ARCHIVE), spark.createDataFrame([(n,) for n in [*names, "none"]], "record_id string")).collect()
    assert sorted(bytes(r.payload).decode()[:8].strip() for r in got) == ["page 250", "page 7 p"]
    warc.export(archive, str(tmp_path))
    files = list(tmp_path.iterdir())
    assert len(files) == archive.count() and all(f.name.endswith(".warc.zst") and len(warc.read_seek_table(f.read_bytes())) for f in files)


def test_text_ids(spark):
    pages = spark.createDataFrame([("a:b/ü+", "u", BIG), ("!", "u", BIG), ("-", "u", "q")], "page_id string, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.archived_pages(pages, fresh_path(spark, "warc")).collect()}
    assert got == {"!": ("response", None), "a:b/ü+": ("revisit", "!"), "-": ("response", None)}


def test_spread_join_of_hot_keys(spark):
    rows = spark.range(6000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    values = spark.createDataFrame([("hot", 1), ("0", 2)], "k string, v int")
    for most in (10, 0):
        got = spread_join(rows, values, "k", most)
        assert got.count() == 6000 and got.where("v = 1").count() == 4000 and got.where("v = 2").count() == 1
