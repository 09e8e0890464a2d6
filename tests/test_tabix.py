"""Indexed scans equal a filter of the whole file, and read a small part of it."""

import random
import struct
import zlib

import pytest

from lociframe import sources
from lociframe.sources import tabix, vcf


def block(data):
    packed = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packed.compress(data) + packed.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def level_bin(start, stop, shift, depth):
    """The finest bin that holds positions start to stop, from 0."""
    for level in range(depth, -1, -1):
        s = shift + 3 * (depth - level)
        if start >> s == stop >> s:
            return ((1 << 3 * level) - 1) // 7 + (start >> s)


def put_indexed(folder, name, header, records, csi=False, size=3000):
    """A bgzipped file of records (chrom, start, stop, line), and its index, by the published layout."""
    data, out, marks = b"", b"", []
    place = lambda: len(out) << 16 | len(data)

    def add(line):
        nonlocal data, out
        data += line.encode() + b"\n"
        if len(data) >= size:
            out += block(data)
            data = b""

    for line in header:
        add(line)
    for r in records:
        begin = place()
        add(r[3])
        marks.append((begin, place()))
    out += (block(data) if data else b"") + block(b"")
    (folder / name).write_bytes(out)
    shift, depth = (12, 6) if csi else (14, 5)
    names = list(dict.fromkeys(r[0] for r in records))
    refs = b""
    for c in names:
        bins, windows, floors = {}, {}, {}
        for (chrom, start, stop, _), (b, e) in zip(records, marks):
            if chrom != c:
                continue
            k = level_bin(start - 1, stop - 1, shift, depth)
            chunks = bins.setdefault(k, [])
            if chunks and chunks[-1][1] == b:
                chunks[-1] = (chunks[-1][0], e)
            else:
                chunks.append((b, e))
            for w in range((start - 1) >> shift, ((stop - 1) >> shift) + 1):
                windows.setdefault(w, b)
        for k in bins:
            first, level = 0, 0
            while first + (1 << 3 * level) <= k:
                first += 1 << 3 * level
                level += 1
            w = (k - first) << 3 * (depth - level)
            later = [windows[x] for x in sorted(windows) if x >= w]
            floors[k] = later[0] if later else 0
        refs += struct.pack("<i", len(bins))
        for k, chunks in bins.items():
            refs += struct.pack("<I", k) + (struct.pack("<Q", floors[k]) if csi else b"") + struct.pack("<i", len(chunks)) + b"".join(struct.pack("<QQ", *x) for x in chunks)
        if not csi:
            n = max(windows) + 1
            filled, last = [], 0
            for w in range(n):
                last = windows.get(w, last)
                filled.append(last)
            refs += struct.pack("<i", n) + struct.pack(f"<{n}Q", *filled)
    listed = b"".join(x.encode() + b"\0" for x in names)
    layout = struct.pack("<7i", 2, 1, 2, 0, ord("#"), 0, len(listed)) + listed
    index = b"CSI\x01" + struct.pack("<iii", shift, depth, len(layout)) + layout + struct.pack("<i", len(names)) + refs if csi else b"TBI\x01" + struct.pack("<i", len(names)) + layout + refs
    (folder / f"{name}.{'csi' if csi else 'tbi'}").write_bytes(block(index) + block(b""))


def variants(seed, n=3000):
    rng = random.Random(seed)
    out = []
    for chrom in ("1", "2", "X"):
        pos = 1
        for i in range(n):
            pos += rng.choice([0, 1, 50, 400, 5000])
            ref = "A" * rng.choice([1, 1, 1, 3, 120])
            info, stop = ".", pos + len(ref) - 1
            if rng.random() < 0.01:
                stop = pos + rng.choice([10, 30_000, 200_000])
                info = f"DB;END={stop}"
            out.append((chrom, pos, stop, f"{chrom}\t{pos}\tv{chrom}_{i}\t{ref}\tG\t.\tPASS\t{info}\tGT\t0/1\t{rng.choice(['0/0', '1/1', './.'])}"))
    return out


HEADER = ["##fileformat=VCFv4.2", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2"]


@pytest.mark.parametrize("csi", [False, True])
def test_regions_equal_a_filter_of_all(spark, tmp_path, csi):
    records = variants(1)
    put_indexed(tmp_path, "a.vcf.gz", HEADER, records, csi)
    rng = random.Random(2)
    top = max(r[2] for r in records)
    regions = [(rng.choice("12X"), a := rng.randrange(1, top), a + rng.choice([0, 10, 3000, 100_000, top])) for _ in range(12)] + [("1", 1, 1), ("9", 1, 1000), ("2", 5, 4), ("X", top + 10**6, top + 10**7), ("1", -5, 10**9)]
    for piece in (1 << 23, 4000):
        got = tabix.read_lines(spark, f"file://{tmp_path}/*.vcf.gz", regions, piece).select("line").collect()
        want = [r[3] for c, a, z in regions for r in records if r[0] == c and r[1] <= z and r[2] >= a]
        assert sorted(r.line for r in got) == sorted(want)


def test_long_ranges_are_cut_for_tasks(spark, tmp_path):
    put_indexed(tmp_path, "a.vcf.gz", HEADER, variants(1))
    all_ = [("1", 1, 10**8)]
    assert tabix.plan(spark, f"file://{tmp_path}/a.vcf.gz", all_).count() == 1
    assert tabix.plan(spark, f"file://{tmp_path}/a.vcf.gz", all_, 2000).count() > 5


def test_only_the_region_is_read(spark, tmp_path):
    """All blocks but those of the plan are destroyed: the region still comes, the whole does not."""
    records = variants(3)
    put_indexed(tmp_path, "a.vcf.gz", HEADER, records)
    path = tmp_path / "a.vcf.gz"
    region = ("2", 1_000_000, 1_050_000)
    want = sorted(r[3] for r in records if r[0] == "2" and r[1] <= region[2] and r[2] >= region[1])
    content = bytearray(path.read_bytes())
    keep = bytearray(len(content))
    for r in tabix.plan(spark, f"file://{path}", [region]).collect():
        assert (r.end >> 16) - (r.begin >> 16) < len(content) / 4
        for at in range(r.begin >> 16, min(len(content), (r.end >> 16) + 2000)):
            keep[at] = 1
    assert 0 < sum(keep) < len(content) / 3
    path.write_bytes(bytes(c if k else 0 for c, k in zip(content, keep)))
    assert sorted(r.line for r in tabix.read_lines(spark, f"file://{path}", [region]).collect()) == want
    with pytest.raises(Exception):
        tabix.read_lines(spark, f"file://{path}", [("1", 1, 10**8)]).collect()


def test_variants_of_a_region(spark, tmp_path):
    records = variants(4, 500)
    put_indexed(tmp_path, "a.vcf.gz", HEADER, records)
    a, z = 100_000, 300_000
    got = sources.read_region(spark, f"file://{tmp_path}/a.vcf.gz", "1", a, z)
    whole = vcf.read(spark, f"file://{tmp_path}/a.vcf.gz").where(f"chrom = '1' and pos between {a} and {z}")
    inside = {r[3].split("\t")[2] for r in records if r[0] == "1" and r[1] <= z and r[2] >= a}
    assert {r.id for r in got.collect()} == inside
    assert sorted(map(str, got.where(f"pos >= {a}").collect())) == sorted(map(str, whole.collect()))


def test_missing_index(spark, tmp_path):
    put_indexed(tmp_path, "a.vcf.gz", HEADER, variants(4, 10))
    (tmp_path / "a.vcf.gz.tbi").unlink()
    with pytest.raises(Exception, match="no .tbi or .csi"):
        tabix.read_lines(spark, f"file://{tmp_path}/a.vcf.gz", [("1", 1, 2)]).collect()
