"""Legacy ARC archives and their conversion to WARC.

An archive is one row of bytes and one file: Spark's text writer puts its bytes into a
folder as they are, the ``binaryFile`` reader brings them back, and a small parser walks
its declared lengths. Each record is a gzip member of its own. Payloads are any bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.names import lookup
from cohortlens.llm.vectext import small_arrow
from cohortlens.workspace import Workspace


@dataclass(frozen=True)
class Archives:
    """``archive_bytes``: an archive is closed once it has so many bytes of records.
    Payloads below ``least_bytes`` are never turned into revisits. Up to ``small_groups``
    copied payloads are broadcast, more are joined by a shuffle."""

    archive_bytes: int = 8 << 20
    least_bytes: int = 0
    small_groups: int = 50_000
    version: int = 1


class ArcRecord(NamedTuple):
    """``payload``: the block after its HTTP head, if it has one. ``damage``: null, or what
    is wrong: ``cut`` (the archive ends before the declared length) or ``header`` (bytes up
    to the next header line, which are the payload)."""

    url: str
    ip: str
    date: str
    kind: str
    head: bytes
    payload: bytes
    damage: str | None = None


#: Fields of a record's header line by the version that the archive's first block names.
FIELDS = {
    1: ("url", "ip", "date", "kind", "length"),
    2: ("url", "ip", "date", "kind", "result", "checksum", "location", "offset", "filename", "length"),
}
_END = b"\r\n\r\n"


def _word(x: str | None) -> str:
    """A header field: without white space, never empty."""
    return re.sub(r"[^\x21-\x7e]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "surrogateescape")), x or "") or "-"


def arc_line(version: int, url: str | None, ip: str, date: str, kind: str, length: int, digest: str, offset: int, name: str) -> bytes:
    known = {"url": _word(url), "ip": ip, "date": date, "kind": kind, "result": "200", "checksum": digest, "location": "-", "offset": str(offset), "filename": name, "length": str(length)}
    return " ".join(known[f] for f in FIELDS[version]).encode() + b"\n"


def arc_head(version: int, name: str, date: str) -> bytes:
    """The block that begins an archive: which version it is and what its lines hold."""
    titles = {1: b"URL IP-address Archive-date Content-type Archive-length\n", 2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"}
    body = f"{version} 0 cohort\n".encode() + titles[version]
    return arc_line(version, f"filedesc://{name}", "0.0.0.0", date, "text/plain", len(body), "-", 0, name) + body + b"\n"


class _Source:
    """Bytes of an archive from the front, inflated as they are asked for."""

    def __init__(self, data: bytes):
        self.data, self.next, self.buffer, self.at = data, 0, bytearray(), 0
        self.inflater = zlib.decompressobj(31) if data[:2] == b"\x1f\x8b" else None

    def _more(self) -> bool:
        """Add to the buffer; False at the end, or where the compression is damaged."""
        if self.at > 1 << 20:
            del self.buffer[: self.at]
            self.at = 0
        chunk = self.data[self.next : self.next + (1 << 14)]
        self.next += len(chunk)
        if self.inflater is None:
            self.buffer += chunk
            return bool(chunk)
        if self.inflater.eof:
            # members may be padded with zeros
            self.next -= len(chunk.lstrip(b"\0"))
            if len(chunk.lstrip(b"\0")) < len(chunk):
                return self._more()
            self.inflater = zlib.decompressobj(31)
            self.next += len(chunk)
        try:
            self.buffer += self.inflater.decompress(chunk)
        except zlib.error:
            self.next = len(self.data)
            return False
        self.next -= len(self.inflater.unused_data)
        return bool(chunk)

    def take(self, n: int) -> bytes:
        """The next ``n`` bytes, fewer at the end."""
        while len(self.buffer) - self.at < n and self._more():
            pass
        out = bytes(self.buffer[self.at : self.at + n])
        self.at += len(out)
        return out

    def until(self, mark: bytes) -> bytes:
        """Everything up to and with ``mark``; all there is if it never comes."""
        seen = 0
        while (k := self.buffer.find(mark, self.at + seen)) < 0:
            seen = max(0, len(self.buffer) - self.at - len(mark) + 1)
            if not self._more():
                return self.take(len(self.buffer) - self.at)
        return self.take(k + len(mark) - self.at)


#: The fields are found from the right, since urls of old archives may hold blanks.
_LINES = {
    1: re.compile(r"(\S.*) (\S+) (\d{4,17}) (\S.*?) (\d+)"),
    2: re.compile(r"(\S.*) (\S+) (\d{4,17}) (\S+) (\S+) (\S+) (\S+) (\S+) (\S+) (\d+)"),
}


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of an archive, gzipped (in one member or many) or not, of version 1 or 2.
    Blank lines between records are skipped. Nothing is lost to damage: see ``ArcRecord``."""
    source, version, lost = _Source(data), 1, b""
    while line := source.until(b"\n"):
        if not line.strip(b"\r\n") and not lost:
            continue
        found = _LINES[version].fullmatch(line.rstrip(b"\r\n").decode("utf-8", "surrogateescape"))
        if not found:
            lost += line
            continue
        if lost:
            yield ArcRecord("-", "-", "", "application/octet-stream", b"", lost, "header")
            lost = b""
        f = dict(zip(FIELDS[version], found.groups(), strict=True))
        block = source.take(int(f["length"]))
        if f["url"].startswith("filedesc:"):
            told = block.split(b" ", 1)[0]
            version = int(told) if told in (b"1", b"2") else version
            continue
        head, sep, payload = block.partition(_END) if block.startswith(b"HTTP/") else (b"", b"", block)
        yield ArcRecord(f["url"], f["ip"], f["date"], f["kind"], head + sep, payload, "cut" if len(block) < int(f["length"]) else None)
    if lost:
        yield ArcRecord("-", "-", "", "application/octet-stream", b"", lost, "header")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _http_field(head: bytes, name: bytes) -> str | None:
    m = re.search(rb"(?im)^" + name + rb":[ \t]*([^\r\n]*)", head)
    return m[1].decode("utf-8", "replace") if m else None


def _key(head: bytes) -> int | None:
    found = _http_field(head, b"X-Record-Key")
    return int(found) if found else None


def _member(data: bytes) -> bytes:
    """A gzip member."""
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _whole(parts: list[bytes]) -> pa.RecordBatch:
    """Gzip members as one row for ``_put``, which adds a zero byte: an empty member at the
    end gives it one that belongs there."""
    return pa.RecordBatch.from_pydict({"value": pa.array([b"".join([*parts, _member(b"")])[:-1]], pa.binary())})


def _pack(batches: Iterator[pa.RecordBatch], p: Archives) -> Iterator[pa.RecordBatch]:
    """Rows ``key, url, payload`` to rows of a whole archive of about ``archive_bytes``."""
    date = "20240101000000"
    first = _member(arc_head(p.version, "cohort.arc", date))
    parts, size = [first], 0
    for batch in batches:
        for key, url, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            payload = payload or b""
            head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (b"X-Record-Key: %d\r\n" % key if key is not None else b"") + b"Content-Length: %d\r\n\r\n" % len(payload)
            digest = sha1_base32(payload) if p.version == 2 else "-"
            row = arc_line(p.version, url, "192.0.2.1", date, "text/html", len(head) + len(payload), digest, size, "cohort.arc")
            parts.append(_member(b"".join((row, head, payload, b"\n"))))
            size += len(row) + len(head) + len(payload) + 1
            if size >= p.archive_bytes:
                yield _whole(parts)
                parts, size = [first], 0
    if size:
        yield _whole(parts)


def _put(archives: DataFrame, path: str) -> None:
    """A file a row of ``value``, byte by byte: a cast to text changes no byte."""
    archives.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1).option("lineSep", "\0").option("compression", "none").mode("overwrite").text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    small_arrow(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content")


def write_arc(pages: DataFrame, path: str, p: Archives = Archives()) -> None:
    """ARC archives of rows ``key, url, payload`` (text or bytes; null is empty) in a folder.
    A payload over ``archive_bytes`` has an archive of its own; 2 GB is the most."""
    small_arrow(pages.sparkSession)
    rows = pages.select(F.col("key").cast("long"), F.col("url").cast("string"), F.col("payload").cast("binary"))
    _put(rows.mapInArrow(partial(_pack, p=p), "value binary"), path)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows = [(n, _key(r.head), len(r.payload), sha1_base32(r.payload), r.damage) for n, r in enumerate(read_arc(content))]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["path", "ord", "key", "bytes", "digest", "damage"])


def arc_records(spark: SparkSession, path: str) -> DataFrame:
    """``path, ord, key, bytes, digest, damage`` of the records of all ARC archives in a folder."""
    return _files(spark, path).mapInArrow(_digests, "path string, ord long, key long, bytes long, digest string, damage string")


def decide(records: DataFrame, p: Archives, ws: Workspace) -> DataFrame:
    """``path, ord, refers, at`` of the records that revisit another: of those with one
    payload, all but that with the largest key (then path and place); damaged ones revisit
    nothing. Only digests are shuffled; the answers are broadcast up to ``small_groups``."""
    big = records.where((F.col("bytes") >= p.least_bytes) & F.col("damage").isNull()).withColumn("payload", F.concat_ws(":", "digest", "bytes"))
    last = F.max(F.struct("key", "path", "ord")).alias("top")
    groups = ws.table(big.groupBy(F.col("payload").alias("copied")).agg(last, F.count("*").alias("n")).where("n > 1").select("copied", "top"), "copied")
    both = lookup(big, "payload", groups, "copied", groups.count() <= p.small_groups, "inner")
    return both.where("NOT (path = top.path AND ord = top.ord)").select("path", "ord", F.col("top.key").alias("refers"), F.struct("top.path", "top.ord").alias("at"))


def record_id(path: str, ord_: int) -> str:
    """The same identifier whenever a record is converted: of its archive's name and place."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, path.rsplit('/', 1)[-1] + '#' + str(ord_))}>"


def warc_date(arc_date: str) -> str:
    """14 digits (or fewer: filled up) of an ARC date as a WARC timestamp in UTC."""
    d = re.sub(r"\D", "", arc_date)[:14]
    d += "00000101000000"[len(d) :] if len(d) >= 4 else ""
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z" if len(d) == 14 else "1970-01-01T00:00:00Z"


def _record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode("utf-8", "surrogateescape") + b"\r\n" + block + _END


def to_warc(path: str, content: bytes, revisits: dict[int, tuple[int | None, str]]) -> list[bytes]:
    """The records of the WARC twin of an ARC archive. ``revisits``: key and identifier of
    what the record in that place repeats; it then keeps its HTTP head alone. Damage is
    told in ``WARC-Truncated`` (a cut record) and ``X-Damage``."""
    name = re.sub(r"\.(txt|arc)?(\.gz)?$", "", path.rsplit("/", 1)[-1])
    out = [_record("warcinfo", [("WARC-Record-ID", record_id(path, -1)), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Filename", name + ".warc.gz"), ("Content-Type", "application/warc-fields")], b"software: cohortlens\r\nformat: WARC File Format 1.1\r\n")]
    for n, r in enumerate(read_arc(content)):
        digest = "sha1:" + sha1_base32(r.payload)
        fields = [("WARC-Record-ID", record_id(path, n)), ("WARC-Date", warc_date(r.date)), ("WARC-Target-URI", _word(r.url)), ("WARC-IP-Address", r.ip), ("WARC-Payload-Digest", digest), ("X-Payload-Length", str(len(r.payload)))]
        fields += [("X-Damage", r.damage)] * (r.damage is not None) + [("WARC-Truncated", "unspecified")] * (r.damage == "cut")
        if n in revisits:
            key, twin = revisits[n]
            fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", twin)]
            fields += [("X-Refers-To-Key", str(key))] if key is not None else []
            out.append(_record("revisit", [*fields, ("Content-Type", "application/http; msgtype=response")], r.head))
        elif r.head:
            block = r.head + r.payload
            out.append(_record("response", [*fields, ("WARC-Block-Digest", "sha1:" + sha1_base32(block)), ("Content-Type", "application/http; msgtype=response")], block))
        else:
            out.append(_record("resource", [*fields, ("WARC-Block-Digest", digest), ("Content-Type", r.kind)], r.payload))
    return out


def _convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content, found in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            revisits = {x["ord"]: (x["refers"], record_id(x["at"]["path"], x["at"]["ord"])) for x in found or ()}
            yield _whole([_member(r) for r in to_warc(path, content, revisits)])


def convert_arc(spark: SparkSession, arc_path: str, warc_path: str, p: Archives = Archives()) -> None:
    """A WARC archive for every ARC archive of a folder (gzipped or not), with duplicates
    across all of them as revisits. What a record is to become is gathered an archive,
    whose records are bounded by its size; archives move once, as they are."""
    ws = Workspace(spark, "arc")
    records = ws.table(arc_records(spark, arc_path), "records")
    chosen = decide(records, p, ws).groupBy("path").agg(F.collect_list(F.struct("ord", "refers", "at")).alias("found"))
    _put(_files(spark, arc_path).join(chosen, "path", "left").select("path", "content", "found").mapInArrow(_convert, "value binary"), warc_path)


class WarcRecord(NamedTuple):
    fields: dict[str, str]
    block: bytes


def parse_warc(data: bytes) -> Iterator[WarcRecord]:
    """Records of an archive, gzipped or not, by their declared lengths; what is no record
    or shorter than it says is an error."""
    source = _Source(data)
    while head := source.until(_END):
        if not head.startswith(b"WARC/") or not head.endswith(_END):
            raise ValueError("no WARC record where one should begin")
        lines = head[: -len(_END)].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        block = source.take(int(fields["content-length"]))
        if source.take(4) != _END:
            raise ValueError(f"{fields.get('warc-record-id')}: another length than declared")
        yield WarcRecord(fields, block)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "warc_date", "url")
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
    for batch in batches:
        for content in batch.column(0).to_pylist():
            rows = []
            for f, block in parse_warc(content):
                if f["warc-type"] not in ("response", "revisit"):
                    continue
                head, sep, payload = block.partition(_END)
                digest, size = f["warc-payload-digest"].removeprefix("sha1:"), int(f["x-payload-length"])
                if f["warc-type"] == "response" and (len(payload), sha1_base32(payload)) != (size, digest):
                    raise ValueError(f"{f['warc-record-id']}: the payload isn't what its digest says")
                refers = f.get("x-refers-to-key")
                rows.append((_key(head + sep), size, digest, f["warc-type"], int(refers) if refers else None, f["warc-record-id"].strip("<>"), f["warc-date"], f["warc-target-uri"]))
            cols = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=list(names))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Response and revisit records of the WARC archives in a folder; digests are verified."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, warc_date string, url string"
    return _files(spark, path).select("content").mapInArrow(_read, schema)


def op1_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as ARC archives, converted to WARC, read back.

    A null html is an empty payload, a null url is ``-``. Pages of equal html revisit that
    with the largest page_id; rows that repeat a page_id revisit one of them. A null
    page_id is written without a key and read as null. No pages give no records. Other
    columns are not looked at; a payload may have any length up to 2 GB.
    """
    ws = Workspace(spark, "archives")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    write_arc(pages.select(F.col("page_id").alias("key"), "url", F.col("html").alias("payload")), f"{ws.path}/arc")
    convert_arc(spark, f"{ws.path}/arc", f"{ws.path}/warc")
    return read_warc(spark, f"{ws.path}/warc")


QUERIES = {"op1_arc_to_warc": op1_arc_to_warc}
ORACLES: dict = {}
