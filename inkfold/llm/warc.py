"""WARC records in ZIP-packaged web archives: written, and read back by ranges, without extraction.

An archive is a ZIP file whose members are stored, not deflated: ``archive/data.warc.gz`` (a gzip member per record),
``indexes/index.cdxj`` (a line per record with its offset and length) and ``datapackage.json``. The reader finds the end record
(and the ZIP64 one), parses the central directory, reads the index member and then only the ranges of the records asked for.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, flat, open_fs, partition_id, rows_out, written

DATA, INDEX, PACKAGE = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
LOCAL, CENTRAL, END = struct.Struct("<4s5H3I2H"), struct.Struct("<4s6H3I5H2I"), struct.Struct("<4s4H2IH")
END64, LOCATOR = struct.Struct("<4sQ2H2I4Q"), struct.Struct("<4sIQI")
FULL32, FULL16 = 0xFFFFFFFF, 0xFFFF
DATE = "1970-01-01T00:00:00Z"


class ZipWriter:
    """Stored members in one pass; ZIP64 fields where a number needs them, or everywhere with ``zip64``."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.zip64, self.at, self.entries = out, zip64, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, parts: list[bytes]) -> None:
        size, crc = sum(map(len, parts)), 0
        for p in parts:
            crc = zlib.crc32(p, crc)
        wide, raw, at = self.zip64 or size >= FULL32, name.encode(), self.at
        extra = struct.pack("<HHQQ", 1, 16, size, size) if wide else b""
        short = FULL32 if wide else size
        self._put(LOCAL.pack(b"PK\x03\x04", 45 if wide else 20, 0x800, 0, 0, 33, crc, short, short, len(raw), len(extra)) + raw + extra)
        for p in parts:
            self._put(p)
        self.entries.append((raw, crc, size, at))

    def close(self) -> None:
        start = self.at
        for raw, crc, size, at in self.entries:
            wide = self.zip64 or size >= FULL32 or at >= FULL32
            extra = struct.pack("<HHQQQ", 1, 24, size, size, at) if wide else b""
            s, a = (FULL32, FULL32) if wide else (size, at)
            self._put(CENTRAL.pack(b"PK\x01\x02", 45, 45 if wide else 20, 0x800, 0, 0, 33, crc, s, s, len(raw), len(extra), 0, 0, 0, 0, a) + raw + extra)
        n, length = len(self.entries), self.at - start
        wide = self.zip64 or n >= FULL16 or start >= FULL32 or length >= FULL32
        if wide:
            at64 = self.at
            self._put(END64.pack(b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, length, start) + LOCATOR.pack(b"PK\x06\x07", 0, at64, 1))
        self._put(END.pack(b"PK\x05\x06", 0, 0, FULL16 if wide else n, FULL16 if wide else n, FULL32 if wide else length, FULL32 if wide else start, 0))


@dataclass
class Member:
    name: str
    method: int
    size: int
    crc: int
    header_at: int


class ZipReader:
    """Members of a ZIP file by range reads."""

    def __init__(self, path: str):
        filesystem, place = open_fs(path)
        self.path, self.file = path, filesystem.open_input_file(place)
        self.size = self.file.size()
        self.members = {m.name: m for m in self._directory()}

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()

    def read(self, at: int, n: int) -> bytes:
        data = self.file.read_at(n, at)
        if len(data) != n:
            raise ValueError(f"{self.path}: {n} bytes at {at} are not there")
        return data

    def _directory(self) -> Iterator[Member]:
        tail_at = max(0, self.size - END.size - FULL16 - LOCATOR.size)
        tail = self.read(tail_at, self.size - tail_at)
        at = tail.rfind(b"PK\x05\x06")
        while at >= 0 and (len(tail) - at < END.size or END.unpack_from(tail, at)[7] != len(tail) - at - END.size):
            at = tail.rfind(b"PK\x05\x06", 0, at)
        if at < 0:
            raise ValueError(f"{self.path}: no end of a central directory")
        _, _, _, _, n, length, start, _ = END.unpack_from(tail, at)
        if at >= LOCATOR.size and tail[at - LOCATOR.size : at].startswith(b"PK\x06\x07"):
            _, _, at64, _ = LOCATOR.unpack_from(tail, at - LOCATOR.size)
            sign, _, _, _, _, _, _, n, length, start = END64.unpack(self.read(at64, END64.size))
            if sign != b"PK\x06\x06":
                raise ValueError(f"{self.path}: no ZIP64 end record where the locator points")
        data, at = self.read(start, length), 0
        for _ in range(n):
            sign, _, _, _, method, _, _, crc, packed, size, n_name, n_extra, n_note, _, _, _, header_at = CENTRAL.unpack_from(data, at)
            if sign != b"PK\x01\x02":
                raise ValueError(f"{self.path}: a central directory entry is damaged")
            at += CENTRAL.size
            name, extra = data[at : at + n_name].decode(), data[at + n_name : at + n_name + n_extra]
            at += n_name + n_extra + n_note
            while len(extra) >= 4:
                kind, width = struct.unpack_from("<HH", extra)
                if kind == 1:
                    wide = iter(struct.unpack_from(f"<{width // 8}Q", extra, 4))
                    size = next(wide) if size == FULL32 else size
                    packed = next(wide) if packed == FULL32 else packed
                    header_at = next(wide) if header_at == FULL32 else header_at
                extra = extra[4 + width :]
            yield Member(name, method, size, crc, header_at)

    def data_at(self, name: str) -> tuple[int, int]:
        """Where a stored member's bytes are: offset and length."""
        m = self.members[name]
        if m.method != 0:
            raise ValueError(f"{self.path}: {name} is not stored")
        sign, *_, n_name, n_extra = LOCAL.unpack(self.read(m.header_at, LOCAL.size))
        if sign != b"PK\x03\x04":
            raise ValueError(f"{self.path}: {name} has no local header")
        return m.header_at + LOCAL.size + n_name + n_extra, m.size

    def member(self, name: str) -> bytes:
        data = self.read(*self.data_at(name))
        if zlib.crc32(data) != self.members[name].crc:
            raise ValueError(f"{self.path}: {name} is damaged")
        return data


def record(kind: str, record_id: str, url: str | None, digest: str, payload: bytes, n: int, refers_to: str | None) -> bytes:
    """One WARC/1.1 record, gzipped. A revisit holds the HTTP header alone, whose Content-Length is that of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    data = "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def parse_record(data: bytes) -> dict:
    """Fields of a gzipped WARC record; the payload's digest is checked where the payload is there."""
    raw = zlib.decompressobj(31).decompress(data)
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, digest, n = fields["warc-type"], fields.get("warc-payload-digest", ""), len(payload)
    if kind == "revisit":
        n = next((int(v) for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if k.lower() == b"content-length"), 0)
    else:
        found = "sha256:" + hashlib.sha256(payload).hexdigest()
        if digest.startswith("sha256:") and digest != found:
            raise ValueError(f"the payload of {fields.get('warc-record-id')} differs from its digest")
        digest = found
    return {
        "record_id": fields["warc-record-id"].strip("<>"),
        "record_type": kind,
        "target_uri": fields.get("warc-target-uri"),
        "refers_to": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None,
        "payload_bytes": n,
        "payload_digest": digest.removeprefix("sha256:"),
        "payload": None if kind == "revisit" else payload,
    }


def write_archives(records: DataFrame, folder: str, archive_bytes: int = 64 << 20, zip64: bool = False) -> DataFrame:
    """Write ``record_id, record_type, target_uri, refers_to, payload_digest, payload_bytes, payload`` rows; gives ``path, n_records`` per archive.

    A task begins another archive when one has reached ``archive_bytes``, which bounds its memory.
    """
    schema = pa.schema([("path", pa.string()), ("n_records", pa.int64())])

    def run(batches):
        number, parts, lines, size = 0, [], [], 0

        def archive() -> pa.RecordBatch:
            path = f"{folder}/{partition_id():06d}-{number:04d}.wacz"
            with written(path) as out:
                z = ZipWriter(out, zip64)
                z.add(DATA, parts)
                z.add(INDEX, ["".join(sorted(lines)).encode()])
                z.add(PACKAGE, [json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": [{"path": DATA, "bytes": size}, {"path": INDEX}]}).encode()])
                z.close()
            return rows_out(schema, {"path": [path], "n_records": [len(lines)]})

        for batch in batches:
            for r in batch.to_pylist():
                data = record(r["record_type"], r["record_id"], r["target_uri"], r["payload_digest"], r["payload"] or b"", r["payload_bytes"], r["refers_to"])
                entry = {"url": r["target_uri"], "digest": f"sha256:{r['payload_digest']}", "offset": size, "length": len(data), "filename": "data.warc.gz"}
                lines.append(f"{r['record_id']} 19700101000000 {json.dumps(entry)}\n")
                parts.append(data)
                size += len(data)
                if size >= archive_bytes:
                    yield archive()
                    number, parts, lines, size = number + 1, [], [], 0
        if lines:
            yield archive()

    names = [f.strip() for f in "record_id, record_type, target_uri, refers_to, payload_digest, payload_bytes, payload".split(",")]
    return flat(records, *names).mapInArrow(run, "path string, n_records long")


READ_SCHEMA = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def read_archives(manifest: DataFrame, records_per_task: int = 2_000, with_payload: bool = True) -> DataFrame:
    """Records of the archives in ``path, n_records``; a task reads some records of an archive, in runs of neighbouring ranges."""
    schema = READ_SCHEMA if with_payload else READ_SCHEMA.remove(READ_SCHEMA.get_field_index("payload"))
    tasks = manifest.where("n_records > 0").select("path", F.explode(F.sequence(F.lit(0), F.expr(f"(n_records - 1) div {records_per_task}"))).alias("slice"))

    def run(batches):
        for batch in batches:
            for path, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with ZipReader(path) as z:
                    base, _ = z.data_at(DATA)
                    places = sorted((e["offset"], e["length"]) for e in (json.loads(x.split(" ", 2)[2]) for x in z.member(INDEX).decode().splitlines()))
                    places = places[part * records_per_task : (part + 1) * records_per_task]
                    k = 0
                    while k < len(places):
                        end, start = k, places[k][0]
                        while end < len(places) and places[end][0] + places[end][1] - start <= 4 << 20:
                            end += 1
                        end = max(end, k + 1)
                        data = z.read(base + start, places[end - 1][0] + places[end - 1][1] - start)
                        found = [parse_record(data[at - start : at - start + n]) for at, n in places[k:end]]
                        yield rows_out(schema, {f.name: [x[f.name] for x in found] for f in schema})
                        k = end

    fields = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'binary' if f.type == pa.binary() else 'string'}" for f in schema)
    return tasks.repartition(max(2, tasks.count())).mapInArrow(run, fields)


PAGE = "urn:inkfold:page:"


def page_records(pages: DataFrame, least: int = 100) -> DataFrame:
    """WARC records of ``page_id, url, html``: of equal payloads of at least ``least`` bytes that of the smallest page_id is the response.

    Null html is an empty payload. Rows that tie for the smallest page_id are all responses; a null page_id is larger than any other.
    """
    p = flat(pages, "page_id", "url", "html").select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("target_uri"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")
    )
    p = p.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    groups = (
        p.where(F.col("payload_bytes") >= least)
        .groupBy(F.col("payload_digest").alias("digest"))
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )
    j = p.join(groups, F.col("payload_digest") == F.col("digest"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit(PAGE), F.coalesce(F.col(c).cast("string"), F.lit("null")))
    return j.select(
        name("page_id").alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.when(revisit, name("first")).alias("refers_to"),
        "payload_digest",
        "payload_bytes",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write pages as WARC records into archives, read them back: ``page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri``.

    Null payloads are empty; repeated rows are records of their own; payloads of any length are written and read whole. An empty table gives no rows, other
    columns are ignored.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    manifest = scratch.save(write_archives(page_records(pages), scratch.sub("archives")), "manifest")
    page = lambda c: F.expr(f"try_cast(substring({c}, {len(PAGE) + 1}) as bigint)")
    return read_archives(manifest, with_payload=False).select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"), "target_uri"
    )


SQL = """
WITH p AS (SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, min(page_id) AS f, count(*) AS c FROM p WHERE n >= 100 GROUP BY h),
j AS (SELECT p.*, g.f, coalesce(g.c, 0) > 1 AND p.page_id IS DISTINCT FROM g.f AS again FROM p LEFT JOIN g ON p.h = g.h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN f END AS refers_to, url AS target_uri
FROM j
"""
