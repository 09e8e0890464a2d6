"""BGEN 1.1 and 1.2 with BGI indexes.

Variants are read in runs of bytes: an index, or, without one, a pass over the variants' heads, tells where each
begins, and tasks read the runs that they are dealt."""

from __future__ import annotations

import sqlite3
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .parts import local, write_parts
from .ranges import CHUNK, open_file, plain_name, sizes, spread

_INDEX = "file string, chrom string, pos long, id string, alleles int, ref string, alt string, start long, size long"


def _text(data: bytes, at: int, size: str) -> tuple[str, int]:
    n = struct.unpack_from(size, data, at)[0]
    at += struct.calcsize(size)
    return data[at : at + n].decode(), at + n


def header(data: bytes) -> tuple[int, int, int, int, list[str]]:
    """(offset of the first variant, samples, compression, layout, sample names)."""
    offset, length, _, n, magic = struct.unpack_from("<IIII4s", data)
    if magic not in (b"bgen", b"\0\0\0\0"):
        raise ValueError("not a BGEN file")
    flags = struct.unpack_from("<I", data, length)[0]
    names = []
    if flags >> 31:
        at = 4 + length + 8
        for _ in range(n):
            name, at = _text(data, at, "<H")
            names.append(name)
    return offset + 4, n, flags & 3, (flags >> 2) & 15, names


def variant_head(data: bytes, at: int, layout: int) -> tuple[str, int, str, list[str], int]:
    """(chromosome, position, id, alleles, where the genotypes are)."""
    if layout == 1:
        at += 4
    _, at = _text(data, at, "<H")
    rsid, at = _text(data, at, "<H")
    chrom, at = _text(data, at, "<H")
    pos = struct.unpack_from("<I", data, at)[0]
    at += 4
    k = 2
    if layout == 2:
        k = struct.unpack_from("<H", data, at)[0]
        at += 2
    alleles = []
    for _ in range(k):
        a, at = _text(data, at, "<I")
        alleles.append(a)
    return chrom, pos, rsid, alleles, at


def _unpack(data: bytes, at: int, n: int, compression: int, layout: int) -> tuple[bytes, int]:
    """The genotype block and where the next variant is."""
    if layout == 1 and compression == 0:
        return data[at : at + 6 * n], at + 6 * n
    size = struct.unpack_from("<I", data, at)[0]
    end = at + 4 + size
    body = data[at + 4 : end]
    if layout == 2 and compression:
        body = body[4:]
    return (zlib.decompress(body) if compression == 1 else zstandard.decompress(body) if compression == 2 else body), end


def probabilities(block: bytes, n: int, layout: int) -> np.ndarray:
    """(samples, 3): probabilities of 0, 1 and 2 copies of the second allele of biallelic diploid samples; nan
    is missing. Phased samples are taken as independent."""
    if layout == 1:
        p = np.frombuffer(block, "<u2", 3 * n).reshape(n, 3) / 32768
        p = p.copy()
        p[p.sum(axis=1) == 0] = np.nan
        return p
    k = struct.unpack_from("<H", block, 4)[0]
    ploidy = np.frombuffer(block, np.uint8, n, 8)
    phased, bits = block[8 + n], block[9 + n]
    if k != 2 or ((ploidy & 63) != 2).any():
        raise ValueError("only biallelic variants of diploid samples")
    raw = np.frombuffer(block, np.uint8, offset=10 + n)
    if bits in (8, 16, 32):
        v = raw.view(f"<u{bits // 8}")[: 2 * n].astype(float)
    else:
        v = np.unpackbits(raw, bitorder="little")[: 2 * n * bits].reshape(2 * n, bits) @ (2.0 ** np.arange(bits))
    v = v.reshape(n, 2) / (2.0**bits - 1)
    if phased:
        a, b = v[:, 0], v[:, 1]
        p = np.stack([a * b, a * (1 - b) + (1 - a) * b, (1 - a) * (1 - b)], axis=1)
    else:
        p = np.stack([v[:, 0], v[:, 1], np.maximum(0, 1 - v[:, 0] - v[:, 1])], axis=1)
    p[ploidy >= 128] = np.nan
    return p


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(file, chrom, pos, id, alleles, ref, alt, start, size) of BGI indexes at a path or glob."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                db = sqlite3.connect(":memory:")
                db.deserialize(content)
                rows = db.execute("SELECT chromosome, position, rsid, number_of_alleles, allele1, allele2, file_start_position, size_in_bytes FROM Variant ORDER BY file_start_position").fetchall()
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([file.removesuffix(".bgi")] * len(rows)), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], names=["file", "chrom", "pos", "id", "alleles", "ref", "alt", "start", "size"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, _INDEX)


def skim(spark: SparkSession, path: str) -> DataFrame:
    """The same as read_index of files without an index: a task steps through each file from variant to variant and reads their heads only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, size in zip(*(c.to_pylist() for c in batch.columns)):
                with open_file(file) as f:
                    at, n, compression, layout = _start(f)
                    rows: list[tuple] = []
                    while at < size or rows:
                        if at >= size or len(rows) == 4096:
                            kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64())
                            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["file", "chrom", "pos", "id", "alleles", "ref", "alt", "start", "size"])
                            rows = []
                            continue
                        chrom, pos, rsid, alleles, body = _head_at(f, at, layout)
                        end = body + 6 * n
                        if layout == 2 or compression:
                            f.seek(body)
                            end = body + 4 + struct.unpack("<I", f.read(4))[0]
                        rows.append((file, chrom, pos, rsid, len(alleles), alleles[0], alleles[1] if len(alleles) > 1 else None, at, end - at))
                        at = end

    return spread(sizes(spark, path)).mapInArrow(run, _INDEX)


def _start(f) -> tuple[int, int, int, int]:
    """(offset of the first variant, samples, compression, layout), without the list of samples."""
    head = f.read(24)
    f.seek(0)
    head = f.read(4 + struct.unpack_from("<I", head, 4)[0])
    offset, length, _, n, magic = struct.unpack_from("<IIII4s", head)
    if magic not in (b"bgen", b"\0\0\0\0"):
        raise ValueError("not a BGEN file")
    flags = struct.unpack_from("<I", head, length)[0]
    return offset + 4, n, flags & 3, (flags >> 2) & 15


def _head_at(f, at: int, layout: int) -> tuple[str, int, str, list[str], int]:
    """variant_head of a file, from as few bytes as it takes."""
    size = 512
    while True:
        f.seek(at)
        data = f.read(size)
        try:
            chrom, pos, rsid, alleles, end = variant_head(data, 0, layout)
            if end <= len(data):
                return chrom, pos, rsid, alleles, at + end
        except (struct.error, UnicodeDecodeError):  # cut short: more is read
            pass
        if len(data) < size:
            raise ValueError("a BGEN file ends within a variant")
        size *= 4


def variant_runs(entries: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(file, start, stop, starts): the variants of an index in runs of about chunk bytes."""
    runs = entries.groupBy("file", F.floor(F.col("start") / chunk).alias("run")).agg(F.min("start").alias("first"), F.max(F.col("start") + F.col("size")).alias("stop"), F.sort_array(F.collect_list("start")).alias("starts"))
    return runs.select("file", F.col("first").alias("start"), "stop", "starts")


def read(spark: SparkSession, path: str, region: tuple[str, int, int] | None = None, chunk: int = CHUNK) -> DataFrame:
    """(chrom, pos, id, ref, alt, probabilities, dosages) of BGEN files at a path or glob; dosages count the second
    allele. Tasks read runs of variants by their bytes, of files of any size. With a region (chromosome, first, last) the indexes beside the
    files (path.bgi) tell the variants, and no other bytes are read; without one the files are skimmed."""
    if region:
        chrom, first, last = region
        entries = read_index(spark, f"{path}.bgi").withColumn("file", plain_name(F.col("file"))).where((F.col("chrom") == chrom) & F.col("pos").between(first, last))
    else:
        entries = skim(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["chrom", "pos", "id", "ref", "alt", "probabilities", "dosages"]
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.list_(pa.float64())), pa.list_(pa.float64()))
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)
        for batch in batches:
            for file, start, stop, starts in zip(*(c.to_pylist() for c in batch.columns)):
                with open_file(file) as f:
                    _, n, compression, layout = _start(f)
                    rows: list[tuple] = []
                    for at, end in zip(starts, [*starts[1:], stop]):
                        f.seek(at)
                        data = f.read(end - at)
                        chrom, pos, rsid, alleles, body = variant_head(data, 0, layout)
                        p = probabilities(_unpack(data, body, n, compression, layout)[0], n, layout)
                        d = p[:, 1] + 2 * p[:, 2]
                        rows.append((chrom, pos, rsid, alleles[0], alleles[1], [None if np.isnan(x[0]) else x.tolist() for x in p], [None if np.isnan(x) else float(x) for x in d]))
                        if len(rows) * n >= 1 << 18:
                            yield pack(rows)
                            rows = []
                    if rows:
                        yield pack(rows)

    return spread(variant_runs(entries, chunk)).mapInArrow(run, "chrom string, pos long, id string, ref string, alt string, probabilities array<array<double>>, dosages array<double>")


def _three(d: np.ndarray) -> np.ndarray:
    """Probabilities of 0, 1 and 2 that have these means: the two nearest counts share each."""
    low = np.clip(np.floor(np.nan_to_num(d)), 0, 1)
    share = np.nan_to_num(d) - low
    p = np.zeros((len(d), 3))
    rows = np.arange(len(d))
    p[rows, low.astype(int)] = 1 - share
    p[rows, low.astype(int) + 1] = share
    return p


def write(variants: DataFrame, folder: str, samples: list[str], bits: int = 16) -> list[str]:
    """folder/part-xxxxx.bgen, each a BGEN 1.2 file (zlib) of its variants and all samples, with its index .bgen.bgi."""

    def put(stem: str, rows: Iterator[dict]) -> None:
        names = [s.encode() for s in samples]
        listed = b"".join(struct.pack("<H", len(s)) + s for s in names)
        block = struct.pack("<II", 8 + len(listed), len(names)) + listed
        head = struct.pack("<III4sI", 20, 0, len(names), b"bgen", 1 | 2 << 2 | 1 << 31)
        index = []
        with open(f"{stem}.bgen", "wb") as f:
            f.write(struct.pack("<I", len(head) + len(block)) + head + block)
            for r in rows:
                start = f.tell()
                alleles = [r["ref"], r["alt"][0] if isinstance(r["alt"], list) else r["alt"]]
                d = np.array([np.nan if x is None else x for x in r["dosages"]], float)
                most = 2**bits - 1
                v = np.round(_three(d)[:, :2] * most).astype(f"<u{bits // 8}")
                v[np.isnan(d)] = 0
                raw = struct.pack("<IHBB", len(d), 2, 2, 2) + np.where(np.isnan(d), 130, 2).astype(np.uint8).tobytes() + bytes([0, bits]) + v.tobytes()
                packed = zlib.compress(raw)
                rsid = (r["id"] or f"{r['chrom']}:{r['pos']}").encode()
                chrom = r["chrom"].encode()
                f.write(struct.pack("<H", len(rsid)) + rsid + struct.pack("<H", len(rsid)) + rsid + struct.pack("<H", len(chrom)) + chrom + struct.pack("<IH", r["pos"], 2))
                f.write(b"".join(struct.pack("<I", len(a.encode())) + a.encode() for a in alleles))
                f.write(struct.pack("<II", len(packed) + 4, len(raw)) + packed)
                index.append((r["chrom"], r["pos"], rsid.decode(), 2, *alleles, start, f.tell() - start))
            f.seek(8)
            f.write(struct.pack("<I", len(index)))  # the number of variants is known at the end
        db = sqlite3.connect(f"{stem}.bgen.bgi")
        db.execute("CREATE TABLE Variant (chromosome TEXT NOT NULL, position INT NOT NULL, rsid TEXT NOT NULL, number_of_alleles INT NOT NULL, allele1 TEXT NOT NULL, allele2 TEXT NULL, file_start_position INT NOT NULL, size_in_bytes INT NOT NULL, PRIMARY KEY (chromosome, position, rsid, allele1, allele2, file_start_position)) WITHOUT ROWID")
        db.executemany("INSERT INTO Variant VALUES (?, ?, ?, ?, ?, ?, ?, ?)", index)
        db.commit()
        db.close()

    return [f"{local(folder)}/{name}.bgen" for name, _ in write_parts(variants, folder, put)]


