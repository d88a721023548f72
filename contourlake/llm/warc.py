"""WARC archives: written with revisit records, read back by a reader that salvages damaged files.

Writing. A payload gets a response record; of rows with equal payloads of at
least ``least`` bytes, those with the largest id do, and each of the others is
a revisit record (identical payload digest) that names the response and holds
the HTTP headers only. Each record is a gzip member of its own, an archive is a
row of at most about ``archive_bytes`` bytes that begins with a warcinfo record,
and Spark's text writer commits it as a file: the archive's bytes go through it
unchanged, and its line separator is set to an empty gzip member. So any store
that Spark writes will do, and a lost task leaves nothing behind. Members are
compressed before the shuffle; a payload that many rows share is dealt over
many tasks.

Reading. A file is walked record by record: gzip members or plain records. A
record must have a version line, a content length, a block of that length, two
line breaks after it and, where they are given, the digests that it states; a
member must be whole and have the right checksum. Where a check fails the
reader searches on for the next gzip header or version line at which a whole
record begins, goes on there, and returns the bytes between as a gap with the
reason. Whatever is intact after a damaged place is therefore found. A file is
read as a row (2 GB at most) and a member is unpacked as a whole.

A null payload is empty and never a revisit; a null id is the lowest and stays
null; a null URL has no target header, and white space and controls in a URL
are percent-encoded. Rows with equal ids and payloads get equal records. An
empty table gives no records. Extra columns are left behind.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, Tables, dealt_join, restored

#: Fixed values of the WARC 1.1 and gzip formats.
VERSION = b"WARC/1.1"
IDENTICAL = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
#: Where a record may begin: a gzip header without reserved flags, or a version line.
BEGIN = re.compile(rb"\x1f\x8b\x08[\x00-\x1f]|WARC/[01]\.[0-9]+\r\n")
NAME = "urn:page:"
CHUNK = 1 << 16


def gzipped(data: bytes, level: int = 6) -> bytes:
    """A gzip member; equal data give equal bytes."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def sha1(data: bytes) -> bytes:
    return b"sha1:" + base64.b32encode(hashlib.sha1(data).digest())


def record(fields: list[tuple[bytes, bytes]], block: bytes) -> bytes:
    head = [VERSION, *(k + b": " + v for k, v in fields), b"WARC-Block-Digest: " + sha1(block), b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + END + block + END


def _name(i: int | None) -> bytes:
    return f"<{NAME}{'' if i is None or i == NULL_ID else i}>".encode()


def _uri(url: str | None) -> list[tuple[bytes, bytes]]:
    if url is None:
        return []
    return [(b"WARC-Target-URI", re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], url.encode()))]


def _http(n: int) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % n + END


def response(i: int | None, url: str | None, payload: bytes, date: bytes) -> bytes:
    fields = [(b"WARC-Type", b"response"), (b"WARC-Record-ID", _name(i)), (b"WARC-Date", date), *_uri(url), (b"WARC-Payload-Digest", sha1(payload)), (b"Content-Type", b"application/http;msgtype=response")]
    return record(fields, _http(len(payload)) + payload)


def revisit(i: int | None, url: str | None, digest: str, size: int, refers_to: int, date: bytes) -> bytes:
    stated = b"sha1:" + base64.b32encode(bytes.fromhex(digest))
    fields = [(b"WARC-Type", b"revisit"), (b"WARC-Record-ID", _name(i)), (b"WARC-Date", date), *_uri(url), (b"WARC-Profile", IDENTICAL), (b"WARC-Refers-To", _name(refers_to)), (b"WARC-Payload-Digest", stated), (b"Content-Type", b"application/http;msgtype=response")]
    return record(fields, _http(size))


def warcinfo(date: bytes) -> bytes:
    return record([(b"WARC-Type", b"warcinfo"), (b"WARC-Date", date), (b"Content-Type", b"application/warc-fields")], b"format: WARC File Format 1.1\r\n")


class Found(NamedTuple):
    """A record, or a gap of quarantined bytes, from offset on; inside a member, the member's bytes."""

    offset: int
    length: int
    reason: str | None
    fields: dict[bytes, bytes] | None = None
    block: bytes = b""


class Damaged(Exception):
    pass


def _member(data: bytes, at: int) -> tuple[bytes, int]:
    """The unpacked member at a place, and where it ends."""
    unpacker, out, k = zlib.decompressobj(31), [], at
    try:
        while not unpacker.eof and k < len(data):
            out.append(unpacker.decompress(data[k : k + CHUNK]))
            k += CHUNK
    except zlib.error as e:
        raise Damaged("checksum" if "check" in str(e) else "member") from None
    if not unpacker.eof:
        raise Damaged("truncated")
    return b"".join(out), min(k, len(data)) - len(unpacker.unused_data)


def _stated(fields: dict[bytes, bytes], name: bytes, data: bytes) -> bool:
    """Whether a digest is of data; one that is not given, or by another method, counts as right."""
    kind, _, value = fields.get(name, b"").strip().partition(b":")
    if kind.lower() != b"sha1":
        return True
    own = hashlib.sha1(data)
    return value.upper() == base64.b32encode(own.digest()) or value.lower() == own.hexdigest().encode()


def _plain(data: bytes, at: int) -> tuple[dict[bytes, bytes], bytes, int]:
    """Fields, block and end of the plain record at a place."""
    line = data.find(b"\r\n", at, at + 16)
    if line < 0 or not BEGIN.match(data, at):
        raise Damaged("version line")
    stop = data.find(END, line)
    if stop < 0:
        raise Damaged("truncated")
    fields: dict[bytes, bytes] = {}
    for row in data[line + 2 : stop].replace(b"\r\n ", b" ").replace(b"\r\n\t", b" ").split(b"\r\n"):
        name, colon, value = row.partition(b":")
        if not colon:
            raise Damaged("header line")
        fields[name.strip().lower()] = value.strip()
    size = fields.get(b"content-length", b"")
    if not size.isdigit():
        raise Damaged("content length")
    lo, hi = stop + len(END), stop + len(END) + int(size)
    if hi + len(END) > len(data):
        raise Damaged("truncated")
    if data[hi : hi + len(END)] != END:
        raise Damaged("record end")
    block = data[lo:hi]
    if not _stated(fields, b"warc-block-digest", block):
        raise Damaged("block digest")
    if fields.get(b"warc-type") == b"response" and not _stated(fields, b"warc-payload-digest", block.partition(END)[2]):
        raise Damaged("payload digest")
    return fields, block, hi + len(END)


def _records(data: bytes, at: int) -> tuple[list[Found], int]:
    """What begins at a place: a plain record, or the records of a member; and where it ends. A member without any record but with bytes is damaged."""
    if data[at : at + 2] != b"\x1f\x8b":
        fields, block, end = _plain(data, at)
        return [Found(at, end - at, None, fields, block)], end
    inside, end = _member(data, at)
    whole = [Found(at, end - at, x.reason, x.fields, x.block) for x in walk(inside, packed=False)]
    if whole and all(x.fields is None for x in whole):
        raise Damaged(whole[0].reason or "member")
    return whole, end


def walk(data: bytes, packed: bool = True) -> Iterator[Found]:
    """All whole records of an archive's bytes and the gaps between them."""
    at = 0
    while at < len(data):
        try:
            if not packed and data[at : at + 2] == b"\x1f\x8b":
                raise Damaged("version line")
            found, end = _records(data, at)
        except Damaged as e:
            start, end, found = len(data), len(data), []
            for m in BEGIN.finditer(data, at + 1):
                try:
                    if packed or m[0][:1] == b"W":
                        found, end = _records(data, m.start())
                        start = m.start()
                        break
                except Damaged:
                    continue
            yield Found(at, start - at, str(e))
        yield from found
        at = end


def members(pages: DataFrame, id_col: str, url_col: str, html_col: str, date: str) -> DataFrame:
    """id, url, digest (hex), size and response (a gzip member) of each row."""
    rows = pages.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.select("id", "url", "payload", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("size"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                made = [gzipped(response(i, u, p, date.encode())) for i, u, p in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), part.column(4), pa.array(made, pa.binary())], ["id", "url", "digest", "size", "response"])

    return rows.mapInArrow(run, "id long, url string, digest string, size long, response binary")


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000, archive_bytes: int = 32 << 20, date: str = "2000-01-01T00:00:00Z") -> None:
    """Writes the rows of pages to archives in folder."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    ids = pages.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size"))
    copies = ids.where(F.col("size") >= least).groupBy("digest").agg(F.max("id").alias("keeper"), F.count("*").alias("n")).where("n > 1")
    tables = Tables(pages.sparkSession, "warc")
    copies = tables.put("copies", copies)
    typed = dealt_join(members(pages, id_col, url_col, html_col, date), copies, "digest", "n", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = gzipped(warcinfo(date.encode()))
        held, n = [first], 0

        def archive():
            return pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["archive"])

        for b in batches:
            for i, url, digest, size, member, keeper in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if keeper is not None and i != keeper:
                    member = gzipped(revisit(i, url, digest, size, keeper, date.encode()))
                if n and n + len(member) > archive_bytes:
                    yield archive()
                    held, n = [first], 0
                held.append(member)
                n += len(member)
        if n:
            yield archive()

    archives = typed.select("id", "url", "digest", "size", "response", "keeper").mapInArrow(run, "archive binary")
    # The writer takes strings' bytes as they are; a separator is one Latin-1 character a byte.
    writer = archives.select(F.col("archive").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", gzipped(b"").decode("latin-1"))
    writer.option("maxRecordsPerFile", 1).text(folder)
    tables.drop("copies")


FOUND = "path string, offset long, length long, gap string, type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def _hex(digest: bytes) -> str | None:
    kind, _, value = digest.partition(b":")
    if kind.lower() != b"sha1":
        return None
    return (base64.b32decode(value.upper()).hex() if len(value) == 32 else value.decode().lower()) or None


def _row(path: str, x: Found, with_payload: bool) -> tuple:
    if x.fields is None:
        return (path, x.offset, x.length, x.reason, *([None] * 7))
    text = lambda k: x.fields[k].decode("utf-8", "replace") if k in x.fields else None
    kind = text(b"warc-type")
    http = x.fields.get(b"content-type", b"").startswith(b"application/http")
    head, _, payload = x.block.partition(END) if http else (b"", b"", x.block)
    size, digest = len(payload), _hex(x.fields.get(b"warc-payload-digest", b""))
    if kind == "revisit":
        stated = re.search(rb"(?im)^content-length:[ \t]*([0-9]+)", head)
        size, payload = int(stated[1]) if stated else None, None
    elif digest is None:
        digest = hashlib.sha1(payload).hexdigest()
    bare = lambda k: (v.strip("<>") if (v := text(k)) is not None else None)
    return (path, x.offset, x.length, None, kind, bare(b"warc-record-id"), text(b"warc-target-uri"), bare(b"warc-refers-to"), digest, size, payload if with_payload else None)


def read(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """A row for each whole record in the archives of folder, and one for each gap; ``gap`` is null for records and says what failed for gaps."""
    kinds = [pa.string(), pa.int64(), pa.int64()] + [pa.string()] * 6 + [pa.int64(), pa.binary()]
    names = [f.split()[0] for f in FOUND.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0), b.column(1), strict=True):
                rows, n = [], 0
                for x in walk(content.as_py()):
                    rows.append(_row(path.as_py(), x, with_payload))
                    n += len(x.block) + 200
                    if n > 4 << 20:
                        yield batch(rows)
                        rows, n = [], 0
                if rows:
                    yield batch(rows)

    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInArrow(run, FOUND)


def gaps(found: DataFrame) -> DataFrame:
    """The log of quarantined bytes."""
    return found.where("gap is not null").select("path", "offset", "length", "gap")


def _number(name: str):
    """The id in a record's name; null without one."""
    return F.nullif(F.replace(F.col(name), F.lit(NAME), F.lit("")), F.lit("")).cast("long")


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000, archive_bytes: int = 32 << 20) -> DataFrame:
    """Writes pages to archives in the shared folder and reads them back: id_col, payload_bytes, payload_digest, record_type and refers_to of each row."""
    spark = pages.sparkSession
    folder = f"{Tables(spark, 'archives').root}/warc"
    write(pages, folder, id_col, url_col, html_col, least, archive_bytes)
    found = read(spark, folder, with_payload=False).where("gap is not null or type in ('response', 'revisit')")
    lost = F.raise_error(F.concat(F.lit("damaged archive "), "path", F.lit(" at byte "), F.col("offset").cast("string")))
    # What was just written has no gaps; if the store damaged it, the job fails loudly.
    whole = found.select(*(F.when(F.col("gap").isNull(), F.col(c)).otherwise(lost).alias(c) if c == "record_id" else F.col(c) for c in found.columns))
    return whole.select(_number("record_id").alias(id_col), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), _number("refers_to").alias("refers_to"))
