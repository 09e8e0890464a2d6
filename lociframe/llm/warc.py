"""WARC archives in seekable Zstandard bundles.

Records are grouped into frames of about FRAME bytes that are compressed independently; a
bundle is a run of frames with the seekable format's table behind them (each frame's compressed and plain size and
checksum), so that a reader finds any frame from the bundle's last bytes. The index maps each record identifier to
its bundle, its frame, and its place relative to the frame's beginning; reading a record inflates one frame.

Payloads of LEAST bytes or more that occur again are stored once: by the record with the smallest id; the
others are revisits that refer to it. Each task writes bundles from its own rows, a bundle is a row
of a table in the shared folder, so that a lost executor's work is done again, and export() makes files of them.

Defined results: a null payload is empty; a null address has no header line. A record without an id refers to
others, and is referred to by none unless no equal one has an id. Rows that repeat an id and a payload are each a record
(the response, if the id is the smallest). A record longer than a frame has a frame of its own. An empty table gives an
empty archive. Control and other characters that a header line cannot hold are percent-encoded in addresses. Only the
columns named are read."""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, spread_join

#: Fixed values of the seekable format: skippable frame, its footer, and the flag for checksums.
SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
FRAME, BUNDLE = 256 << 10, 4 << 20
LEAST = 100
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ENTRIES = "array<struct<record_id:string,frame:int,start:bigint,length:bigint>>"
ARCHIVE = f"bundle string, content binary, entries {ENTRIES}"


# --- records -------------------------------------------------------------------------------


def record_name(ident: str | None, digest: str) -> str:
    return f"urn:x-record:{quote(ident, safe='') if ident is not None else '!'}:{digest[:32]}"


def make_record(ident: str | None, url: bytes | None, payload: bytes, digest: str, refers: str | None, date: str = DATE) -> bytes:
    """One WARC record: a response with its payload, or, where refers is given, a revisit without."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <{record_name(ident, digest)}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(0x21, 0x7F))))}")
    if refers is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers}>"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(header fields in lower case, HTTP header, payload) of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if len(rest) != len(block) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("a record's length does not fit")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


# --- bundles ------------------------------------------------------------------------------


def seek_table(frames: list[tuple[int, int, int]]) -> bytes:
    """The skippable frame that ends a bundle, of each frame's (compressed size, plain size, checksum)."""
    body = b"".join(struct.pack("<III", *f) for f in frames) + struct.pack("<IBI", len(frames), CHECKSUMS, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(content: bytes) -> list[tuple[int, int, int, int]]:
    """(offset, compressed size, plain size, checksum) of each frame, from a bundle's end."""
    count, flags, magic = struct.unpack("<IBI", content[-9:])
    if magic != SEEKABLE or not flags & CHECKSUMS:
        raise ValueError("no seek table")
    table = content[-9 - 12 * count : -9]
    out, at = [], 0
    for small, plain, check in struct.iter_unpack("<III", table):
        out.append((at, small, plain, check))
        at += small
    if at + 8 + len(table) + 9 != len(content):
        raise ValueError("the seek table does not fit its bundle")
    return out


def read_frame(content: bytes, place: tuple[int, int, int, int]) -> bytes:
    at, small, plain, check = place
    data = zstandard.ZstdDecompressor().decompress(content[at : at + small], max_output_size=plain)
    if len(data) != plain or _check(data) != check:
        raise ValueError("a frame does not fit its checksum")
    return data


def _check(data: bytes) -> int:
    return xxhash.xxh64(data).intdigest() & 0xFFFFFFFF


def bundles(records: Iterable[tuple[str, bytes]], frame: int = FRAME, bundle: int = BUNDLE, level: int = 3) -> Iterator[tuple[bytes, list[tuple[str, int, int, int]]]]:
    """(content, entries) of bundles of records (name, bytes): a frame closes at frame plain bytes, a bundle at
    bundle compressed bytes, so what is held does not grow with the records."""
    packer = zstandard.ZstdCompressor(level=level)
    out, table, entries, own = bytearray(), [], [], bytearray()

    def close() -> None:
        small = packer.compress(bytes(own))
        table.append((len(small), len(own), _check(bytes(own))))
        out.extend(small)
        own.clear()

    for name, data in records:
        if own and len(own) + len(data) > frame:
            close()
            if len(out) >= bundle:
                yield bytes(out) + seek_table(table), entries
                out, table, entries = bytearray(), [], []
        entries.append((name, len(table), len(own), len(data)))
        own.extend(data)
    if own:
        close()
    if table:
        yield bytes(out) + seek_table(table), entries


# --- archives in Spark -----------------------------------------------------------------------


def classified(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least: int = LEAST) -> DataFrame:
    """(id, url, payload, digest, first): first is the id whose record holds the same payload, null for its own.

    Digests are counted first; only those that occur again come back to the rows."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("binary").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    again = rows.select("id", "digest", F.octet_length("payload").alias("k")).where(F.col("k") >= least)
    again = again.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    own = spread_join(rows, again, "digest")
    return own.withColumn("first", F.when(F.col("id").isNull() | (F.col("id") > F.col("first")), F.col("first")))


def write_archive(pages: DataFrame, path: str, id_col: str, url_col: str, payload_col: str, least: int = LEAST, frame: int = FRAME, bundle: int = BUNDLE, date: str = DATE) -> DataFrame:
    """The archive (bundle, content, entries) of pages, written at path and read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def records() -> Iterator[tuple[str, bytes]]:
            for batch in batches:
                for i in range(batch.num_rows):
                    ident, url, payload, digest, first = (c[i].as_py() for c in batch.columns)
                    yield record_name(ident, digest), make_record(ident, url, payload, digest, record_name(first, digest) if first is not None else None, date)

        for k, (content, entries) in enumerate(bundles(records(), frame, bundle)):
            rows = [{"record_id": n, "frame": f, "start": s, "length": z} for n, f, s, z in entries]
            kind = pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("start", pa.int64()), ("length", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{k:06d}"]), pa.array([content], pa.binary()), pa.array([rows], kind)], names=["bundle", "content", "entries"])

    rows = classified(pages, id_col, url_col, payload_col, least)
    rows = rows.select(F.col("id").cast("string").alias("id"), "url", "payload", "digest", F.col("first").cast("string").alias("first"))
    rows.mapInArrow(run, ARCHIVE).write.option("compression", "none").parquet(path)
    return pages.sparkSession.read.schema(ARCHIVE).parquet(path)


def index(archive: DataFrame) -> DataFrame:
    """(bundle, record_id, frame, start, length): where each record is; reads no content."""
    return archive.select("bundle", F.inline("entries"))


RECORDS = "record_id string, record_type string, target_uri string, refers_to string, stated_digest string, payload_bytes long, payload_digest string"


def read_records(archive: DataFrame, with_payload: bool = False) -> DataFrame:
    """One row per entry of archive: what its record says, with size and digest of the payload as read (null for revisits).
    Only frames that entries name are inflated, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(batch.num_rows):
                content, entries = batch.column(0)[b].as_py(), batch.column(1)[b].as_py()
                places, held, data, rows = read_seek_table(content), -1, b"", []
                for e in sorted(entries, key=lambda e: (e["frame"], e["start"])):
                    if e["frame"] != held:
                        held, data = e["frame"], read_frame(content, places[e["frame"]])
                    fields, _, payload = parse_record(data[e["start"] : e["start"] + e["length"]])
                    whole = fields["warc-type"] == "response"
                    row = (fields["warc-record-id"][1:-1], fields["warc-type"], fields.get("warc-target-uri"), fields["warc-refers-to"][1:-1] if "warc-refers-to" in fields else None, fields["warc-payload-digest"].removeprefix("sha256:"), len(payload) if whole else None, hashlib.sha256(payload).hexdigest() if whole else None)
                    if row[0] != e["record_id"] or whole and row[4] != row[6]:
                        raise ValueError("a record does not fit its index entry or its digest")
                    rows.append((*row, payload if whole else None) if with_payload else row)
                kinds = [pa.string()] * 5 + [pa.int64(), pa.string()] + [pa.binary()] * with_payload
                names = [x.split()[0] for x in schema.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    schema = RECORDS + (", payload binary" if with_payload else "")
    return archive.select("content", "entries").mapInArrow(run, schema)


def fetch(archive: DataFrame, names: DataFrame, name_col: str = "record_id") -> DataFrame:
    """The records of these names, with payloads: the index tells their bundles and frames, and nothing else is inflated."""
    wanted = index(archive).join(names.select(F.col(name_col).alias("record_id")).distinct(), "record_id", "left_semi")
    places = wanted.groupBy("bundle").agg(F.collect_list(F.struct("record_id", "frame", "start", "length")).alias("entries"))  # a bundle's at most
    return read_records(archive.select("bundle", "content").join(places, "bundle").select("bundle", "content", "entries"), True)


def resolved(records: DataFrame) -> DataFrame:
    """records with payload_bytes and payload_digest of the full payload: a revisit's from the record it refers to,
    read back; of one that is referred to by very many the rows are split."""
    r = materialize(records, "records")
    ask = r.where("record_type = 'revisit'").groupBy(F.col("refers_to").alias("record_id")).agg(F.count("*").alias("asked"))
    found = r.where("record_type = 'response'").join(ask, "record_id", "left_semi").groupBy("record_id").agg(F.min("payload_bytes").alias("full_bytes"), F.min("payload_digest").alias("full_digest"))
    rows = spread_join(r.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest"), found.withColumnRenamed("record_id", "refers_to"), "refers_to")
    rows = rows.withColumnsRenamed({"full_bytes": "payload_bytes", "full_digest": "payload_digest"})
    return r.where("record_type = 'response'").unionByName(rows)


def export(archive: DataFrame, folder: str) -> None:
    """Each bundle as folder/<bundle>.warc.zst. The folder must be mounted on all executors."""

    def run(rows: Iterator) -> None:
        for r in rows:
            part = os.path.join(folder, f".{r.bundle}.{os.getpid()}")
            with open(part, "wb") as f:
                f.write(r.content)
            os.replace(part, os.path.join(folder, f"{r.bundle}.warc.zst"))  # a retry replaces

    archive.select("bundle", "content").foreachPartition(run)


def archived_pages(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page, as read back from the archive
    that is written at path."""
    kind = dict(pages.dtypes)[id_col]
    r = resolved(read_records(write_archive(pages, path, id_col, url_col, payload_col)))
    ident = lambda c: F.expr(f"url_decode(nullif(split({c}, ':')[2], '!'))").cast(kind)
    return r.select(ident("record_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", ident("refers_to").alias("refers_to"), "record_id")
