"""Regions of bgzipped, position-sorted text files by their .tbi or .csi index.

A task reads a file's index and turns each region into ranges of virtual offsets: the chunks of the bins that overlap it,
less what the linear index tells to lie before it, merged, and cut where they are long at places that the index knows
to begin a record. Tasks then inflate these ranges alone, and keep the lines that overlap the region.

Fixed values and layouts are those of the published format: bins of 2 ** 14 positions and five levels in .tbi, any in .csi."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranges import open_file, sizes, spread

#: Compressed bytes of one range, about.
PIECE = 8 << 20
BLOCK = 1 << 16  # a block's most bytes, compressed or not

_PLAN = "file string, chrom string, first long, last long, begin long, end long, format int, seq int, low int, high int, meta int"


def inflate(f: BinaryIO, begin: int, end: int | None = None) -> Iterator[bytes]:
    """The bytes between two virtual offsets (block's place << 16 | place in the block), a block at a time; to the file's end without one."""
    at, skip = begin >> 16, begin & 0xFFFF
    f.seek(at)
    held = b""
    while end is None or at < (end >> 16) or (at == end >> 16 and (end & 0xFFFF) > 0):
        while len(held) < BLOCK and (more := f.read(4 * BLOCK)):
            held += more
        if not held:
            return
        if held[:4] != b"\x1f\x8b\x08\x04":
            raise ValueError("not a block of a bgzipped file")
        extra = held[12 : 12 + struct.unpack_from("<H", held, 10)[0]]
        size = 0
        while extra:  # subfields: two letters, a length, the data
            n = struct.unpack_from("<H", extra, 2)[0]
            if extra[:2] == b"BC":
                size = struct.unpack_from("<H", extra, 4)[0] + 1
            extra = extra[4 + n :]
        if not size or size > len(held):
            raise ValueError("a block of a bgzipped file is cut short")
        data = zlib.decompress(held[:size], 31)
        stop = end & 0xFFFF if end is not None and at == end >> 16 else len(data)
        if data[skip:stop]:
            yield data[skip:stop]
        held, at, skip = held[size:], at + size, 0


def lines(f: BinaryIO, begin: int, end: int | None = None) -> Iterator[bytes]:
    rest = b""
    for data in inflate(f, begin, end):
        *whole, rest = (rest + data).split(b"\n")
        yield from whole
    if rest:
        yield rest


class Index:
    """A .tbi or .csi index: names of sequences, their bins' chunks, and the first offset at or after each window or bin."""

    def __init__(self, content: bytes):
        data = memoryview(content)
        at = 4
        if content[:4] == b"TBI\x01":
            self.shift, self.depth = 14, 5
            count = struct.unpack_from("<i", data, at)[0]
            at = self._layout(data, at + 4)
        elif content[:4] == b"CSI\x01":
            self.shift, self.depth, extra = struct.unpack_from("<iii", data, at)
            self._layout(data, at + 12)
            at += 12 + extra
            count = struct.unpack_from("<i", data, at)[0]
            at += 4
        else:
            raise ValueError("not a .tbi or .csi index")
        self.bins: list[dict[int, list[tuple[int, int]]]] = []
        self.floor: list[dict[int, int]] = []
        self.windows: list[list[int]] = []
        for _ in range(count):
            n = struct.unpack_from("<i", data, at)[0]
            at += 4
            bins, floor = {}, {}
            for _ in range(n):
                number = struct.unpack_from("<I", data, at)[0]
                at += 4
                if content[:3] == b"CSI":
                    floor[number] = struct.unpack_from("<Q", data, at)[0]
                    at += 8
                k = struct.unpack_from("<i", data, at)[0]
                at += 4
                bins[number] = [struct.unpack_from("<QQ", data, at + 16 * i) for i in range(k)]
                at += 16 * k
            windows: list[int] = []
            if content[:3] == b"TBI":
                k = struct.unpack_from("<i", data, at)[0]
                windows = list(struct.unpack_from(f"<{k}Q", data, at + 4))
                at += 4 + 8 * k
            self.bins.append(bins)
            self.floor.append(floor)
            self.windows.append(windows)

    def _layout(self, data: memoryview, at: int) -> int:
        self.format, self.seq, self.low, self.high, self.meta, _, size = struct.unpack_from("<7i", data, at)
        at += 28
        self.names = [x.decode() for x in bytes(data[at : at + size]).split(b"\0")[:-1]]
        return at + size

    def _overlapping(self, first: int, last: int) -> Iterator[int]:
        """Numbers of the bins of all levels that overlap positions from first to last, counted from 0."""
        start = 0
        for level in range(self.depth + 1):
            shift = self.shift + 3 * (self.depth - level)
            yield from range(start + (first >> shift), start + (last >> shift) + 1)
            start += 1 << 3 * level

    def ranges(self, chrom: str, first: int, last: int, piece: int = PIECE) -> list[tuple[int, int]]:
        """Virtual offsets (begin, end) that hold all records that overlap positions first to last (from 1), in pieces of about so many bytes."""
        if chrom not in self.names or last < first or last < 1:
            return []
        i = self.names.index(chrom)
        low, high = max(0, first - 1), min(last, 1 << self.shift + 3 * self.depth) - 1
        windows, bins = self.windows[i], self.bins[i]
        least = 0
        if windows:
            least = windows[min(low >> self.shift, len(windows) - 1)]
        else:  # the nearest bin of the finest level at or before the region, or one that holds it
            number = ((1 << 3 * self.depth) - 1) // 7 + (low >> self.shift)
            while number and number not in self.floor[i]:
                number = (number - 1) >> 3
            least = self.floor[i].get(number, 0)
        found = sorted((b, e) for n in self._overlapping(low, high) for b, e in bins.get(n, ()) if e > least)
        merged: list[list[int]] = []
        for b, e in found:
            b = max(b, least)
            if merged and b >> 16 <= merged[-1][1] >> 16:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([b, e])
        cuts = sorted({w for w in windows} | {b for chunks in bins.values() for b, _ in chunks}) if any((e >> 16) - (b >> 16) > piece for b, e in merged) else []
        out = []
        for b, e in merged:
            for c in cuts:
                if b < c < e and (c >> 16) - (b >> 16) >= piece:
                    out.append((b, c))
                    b = c
            out.append((b, e))
        return out


def read_index(name: str) -> Index:
    """The index beside a file: name.tbi, else name.csi."""
    for suffix in (".tbi", ".csi"):
        try:
            with open_file(name + suffix) as f:
                return Index(b"".join(inflate(f, 0)))
        except FileNotFoundError:
            continue
    raise FileNotFoundError(f"no .tbi or .csi index beside {name}")


def plan(spark: SparkSession, path: str, regions: list[tuple[str, int, int]], piece: int = PIECE) -> DataFrame:
    """(file, chrom, first, last, begin, end, ...): what of the files at a path or glob is to be inflated for regions (chromosome, first,
    last), positions from 1, both ends included. Regions that overlap give their common records more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _PLAN.split(", ")]
        kinds = [pa.string(), pa.string()] + [pa.int64()] * 4 + [pa.int32()] * 5
        for batch in batches:
            for file in batch.column(0).to_pylist():
                x = read_index(file)
                rows = [(file, c, a, z, b, e, x.format, x.seq, x.low, x.high, x.meta) for c, a, z in regions for b, e in x.ranges(c, a, z, piece)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    return spread(sizes(spark, path)).mapInArrow(run, _PLAN)


_END = re.compile(rb"(?:^|;)END=(\d+)")


def span(fields: list[bytes], format_: int, low: int, high: int) -> tuple[int, int]:
    """First and last position, from 1, of a record's fields."""
    start = int(fields[low - 1]) + (1 if format_ & 0x10000 else 0)
    if format_ & 0xFFFF == 2:  # VCF: the reference allele, or an END
        end = _END.search(fields[7]) if len(fields) > 7 else None
        return start, int(end[1]) if end else start + max(1, len(fields[3])) - 1
    if high and high != low:
        return start, int(fields[high - 1])
    return start, start


def read_lines(spark: SparkSession, path: str, regions: list[tuple[str, int, int]], piece: int = PIECE) -> DataFrame:
    """(file, chrom, start, stop, line) of the records that overlap a region."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows = []
                with open_file(r["file"]) as f:
                    for line in lines(f, r["begin"], r["end"]):
                        if not line or line[0] == r["meta"]:
                            continue
                        fields = line.rstrip(b"\r").split(b"\t")
                        if fields[r["seq"] - 1].decode() != r["chrom"]:
                            continue
                        start, stop = span(fields, r["format"], r["low"], r["high"])
                        if start > r["last"]:
                            break
                        if stop >= r["first"]:
                            rows.append((r["file"], r["chrom"], start, stop, line.rstrip(b"\r").decode()))
                        if len(rows) == 1024:
                            yield pack(rows)
                            rows = []
                if rows:
                    yield pack(rows)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(kinds)], names=["file", "chrom", "start", "stop", "line"])

    wanted = plan(spark, path, regions, piece)
    return wanted.repartition(spark.sparkContext.defaultParallelism, "file", "begin").mapInArrow(run, "file string, chrom string, start long, stop long, line string")


def read_vcf(spark: SparkSession, path: str, regions: list[tuple[str, int, int]], least_probability: float = 0.4) -> DataFrame:
    """The variants of bgzipped VCF files that overlap a region, as vcf.read gives them."""
    from . import vcf

    return vcf.parse(read_lines(spark, path, regions).select(F.col("line").alias("value")), least_probability)
