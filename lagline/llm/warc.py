"""WARC archives of pages: a writer, and a reader that goes on behind damage.

The writer puts one record per gzip member into archives of about ``ARCHIVE_BYTES`` below a folder
all executors share. Records with equal payloads (SHA-256 and length) of ``SMALL`` bytes or more are
one response and revisits of it; which one is found by an aggregate of digests, and only digests
that occur twice are joined to the pages. An archive's name holds a fresh identifier, and the
table of archives names those of successful tasks only, so what a lost task wrote is never read.

The reader streams an archive by record. A record has to pass all its checks: a version line, a
header with a length, the whole block, the closing line ends, the block's and the payload's digest
where given, and in a compressed archive the member's own checksum (nothing but that guards the
words of a header). Where one fails, the bytes
from there on are put in quarantine and searched for the next member or version line that begins
a valid record; reading goes on with it, and the gap is logged with place, length and reason. A
record whose frame holds but whose digest doesn't is left out alone. A page that itself contains
an archive is safe while its record is whole; out of a damaged one its inner records may surface.

Memory: a record at a time. One task reads an archive from its beginning, because only there is a
record's start certain; archives are of bounded size for that.

A null ``html`` is an empty payload, a null ``url`` is named by the page, a null ``page_id`` is
below all others and never referred to; of rows that repeat the largest ``page_id`` of a payload all
are responses; where all rows of a payload have none, too. Further columns are ignored. An empty
table gives no archive and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from lagline.session import run_folder
from lagline.sources.work import materialize

SMALL = 1000  # payloads under so many bytes are never revisits
ARCHIVE_BYTES = 128 << 20
WINDOW = 1 << 16
DATE = "2026-01-01T00:00:00Z"
PAGE = "urn:page:"

# ---- Fixed values: the format's names ------------------------------------------------------
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MEMBER = b"\x1f\x8b\x08"

ARCHIVES = pa.schema([("archive", pa.string()), ("n_bytes", pa.int64()), ("n_records", pa.int64())])
ARCHIVES_DDL = "archive string, n_bytes long, n_records long"
FOUND = pa.schema(
    [("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("damage", pa.string())]
    + [(c, pa.string()) for c in ("record_type", "record_id", "target_uri", "refers_to", "payload_digest")]
    + [("payload_bytes", pa.int64()), ("payload", pa.binary())]
)
FOUND_DDL = (
    "archive string, offset long, length long, damage string, record_type string, record_id string, "
    "target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
)


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder or file named by a path or URI, on whatever machine this runs."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


# ---- writing -------------------------------------------------------------------------------


def _digest(content: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(content).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """One record: an HTTP response with the payload, or the head alone where another record has it."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    name = f"{PAGE}{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid4()}"
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{name}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else name),
        ("WARC-Payload-Digest", _digest(payload)),
        ("WARC-Block-Digest", _digest(block)),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if revisit:
        fields[4:4] = [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{PAGE}{refers_to}>")]
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def member(content: bytes) -> bytes:
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(content) + squeeze.flush()


def _writer(folder: str, limit: int):
    def run(batches):
        files, out, path, size, n = None, None, "", 0, 0
        for batch in batches:
            for page_id, url, payload, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns)):
                if files is None:
                    files, base = opened(folder)
                    files.create_dir(base, recursive=True)
                if out is None:
                    name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, path = files.open_output_stream(f"{base}/{name}", compression=None), f"{folder}/{name}"
                written = member(record(page_id, url, payload, refers_to, revisit))
                out.write(written)
                size, n = size + len(written), n + 1
                if size >= limit:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (path, size, n)], schema=ARCHIVES)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (path, size, n)], schema=ARCHIVES)

    return run


def write(pages: DataFrame, folder: str | None = None, small: int = SMALL, limit: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive, n_bytes, n_records) of the archives that now hold a record per row of (page_id, url, html)."""
    folder = folder or f"{run_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    # Small payloads are named by nothing, so they neither meet nor crowd one key.
    large = F.length("payload") >= small
    name = F.when(large, F.concat_ws(":", F.length("payload"), F.sha2("payload", 256)))
    owners = rows.where(large).select(name.alias("same"), "page_id").groupBy("same").agg(
        F.max("page_id").alias("owner"), F.count(F.lit(1)).alias("copies")
    )
    owners = materialize(owners.where("copies > 1 AND owner IS NOT NULL"), "warc-owners")
    rows = rows.withColumn("same", name).join(owners, "same", "left")
    revisit = F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    rows = rows.select("page_id", "url", "payload", F.col("owner").alias("refers_to"), revisit.alias("revisit"))
    return materialize(rows.mapInArrow(_writer(folder, limit), ARCHIVES_DDL), "warc-archives")


# ---- reading -------------------------------------------------------------------------------


class Source:
    """Bytes by place, out of a file read in windows or out of memory."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.held = file, size, 0, b""

    @classmethod
    def of(cls, content: bytes) -> Source:
        source = cls(None, len(content))
        source.held = content
        return source

    def read(self, at: int, n: int) -> bytes:
        n = max(0, min(n, self.size - at))
        if at < self.at or at + n > self.at + len(self.held):
            self.file.seek(at)
            self.at, self.held = at, self.file.read(max(n, WINDOW))
        return self.held[at - self.at : at - self.at + n]


@dataclass
class Found:
    """A record between two places, or a gap with the reason in ``damage``."""

    start: int
    stop: int
    damage: str | None = None
    fields: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""
    size: int = 0
    digest: str | None = None


class Broken(Exception):
    """A failed check; ``stop`` is the end of a record whose frame holds all the same."""

    def __init__(self, reason: str, stop: int | None = None):
        super().__init__(reason)
        self.stop = stop


LINE = re.compile(rb"WARC/\d+\.\d+\r?\n")
BEGINS = re.compile(rb"\x1f\x8b\x08|WARC/\d+\.\d+\r?\n")
HEAD = re.compile(rb"\r?\n\r?\n")


def _matches(content: bytes, wanted: str) -> bool:
    """Whether the content has the digest ``wanted`` (algorithm:value in base 32 or hex); unknown algorithms pass."""
    kind, _, value = wanted.partition(":")
    kind = kind.strip().lower().replace("-", "")
    if kind not in ("md5", "sha1", "sha256", "sha512"):
        return True
    made, value = hashlib.new(kind, content), value.strip()
    return value.lower() == made.hexdigest() or value.upper().rstrip("=") == base64.b32encode(made.digest()).decode().rstrip("=")


def _hex(wanted: str) -> str:
    """A digest of a header as bare lower-case hex."""
    value = wanted.partition(":")[2].strip() or wanted.strip()
    if re.fullmatch(r"[0-9a-fA-F]{40}", value):
        return value.lower()
    try:
        return base64.b32decode(value.upper() + "=" * (-len(value) % 8)).hex()
    except ValueError:
        return value


def _header(source: Source, at: int, what: str) -> tuple[bytes, int]:
    """The bytes up to the first empty line and the place behind it."""
    n = 2048
    while True:
        content = source.read(at, n)
        end = HEAD.search(content)
        if end:
            return content[: end.start()], at + end.end()
        if at + n >= source.size:
            raise Broken(f"{what} without an end")
        n *= 4


def _fields(lines: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    name = None
    for line in lines.decode("utf-8", "replace").splitlines():
        if line[:1] in " \t" and name:
            out[name] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon:
            raise Broken("header line without a colon")
        name = name.strip().lower()
        out[name] = value.strip()
    return out


def one_record(source: Source, at: int) -> Found:
    """The record at ``at``, or ``Broken``."""
    if not LINE.match(source.read(at, 16)):
        raise Broken("no version line")
    head, begin = _header(source, at, "header")
    fields = _fields(head.split(b"\n", 1)[1] if b"\n" in head else b"")
    missing = [k for k in ("warc-type", "warc-record-id", "content-length") if not fields.get(k)]
    if missing:
        raise Broken(f"header without {', '.join(missing)}")
    length = fields["content-length"]
    if not re.fullmatch(r"[0-9]{1,18}", length):
        raise Broken("no length")
    end = begin + int(length)
    if end > source.size:
        raise Broken("block cut short")
    closing = source.read(end, 4)
    if closing == b"\r\n\r\n":
        stop = end + 4
    elif closing[:2] == b"\n\n":
        stop = end + 2
    else:
        raise Broken("block without its end")
    block = source.read(begin, end - begin)
    if "warc-block-digest" in fields and not _matches(block, fields["warc-block-digest"]):
        raise Broken("block digest differs", stop)
    payload, size = block, len(block)
    if fields.get("content-type", "").lower().replace(" ", "").startswith("application/http"):
        split = HEAD.search(block)
        if not split:
            raise Broken("HTTP head without an end", stop)
        payload = block[split.end() :]
        said = re.search(rb"(?im)^content-length:[ \t]*(\d+)", block[: split.start()])
        size = int(said[1]) if said and fields.get("warc-type") == "revisit" else len(payload)
    if fields.get("warc-type") == "revisit":
        digest = _hex(fields["warc-payload-digest"]) if "warc-payload-digest" in fields else None
    else:
        if "warc-payload-digest" in fields and not _matches(payload, fields["warc-payload-digest"]):
            raise Broken("payload digest differs", stop)
        digest = hashlib.sha1(payload).hexdigest()
    return Found(at, stop, None, fields, payload, size, digest)


def one_member(source: Source, at: int) -> tuple[bytes, int]:
    """The content of the gzip member at ``at`` and the place behind it, or ``Broken``."""
    inflate, parts, place = zlib.decompressobj(31), [], at
    try:
        while not inflate.eof:
            content = source.read(place, WINDOW)
            if not content:
                raise Broken("member cut short")
            parts.append(inflate.decompress(content))
            place += len(content)
    except zlib.error as error:
        raise Broken(f"member fails: {str(error).split(':')[-1].strip()}") from None
    return b"".join(parts), place - len(inflate.unused_data)


def _next(source: Source, at: int) -> int:
    """The first place from ``at`` on where a member or a version line begins; the end if none."""
    while at < source.size:
        content = source.read(at, WINDOW)
        begins = BEGINS.search(content)
        if begins:
            return at + begins.start()
        if at + len(content) >= source.size:
            break
        at += len(content) - 32
    return source.size


def salvage(source: Source) -> Iterator[Found]:
    """Every valid record of an archive in order, and the gaps between them."""
    at, lost, reason = 0, None, ""
    while at < source.size:
        try:
            if source.read(at, 3) == MEMBER:
                content, stop = one_member(source, at)
                inner = list(salvage(Source.of(content)))
                if all(f.damage for f in inner):
                    raise Broken(f"in the member: {inner[0].damage}" if inner else "empty member", stop)
                found = [Found(at, stop, f"bytes {f.start}-{f.stop} in the member: {f.damage}") if f.damage else f for f in inner]
                for f in found:
                    f.start, f.stop = at, stop
            else:
                found = [one_record(source, at)]
                stop = found[0].stop
        except Broken as broken:
            if lost is None:
                lost, reason = at, str(broken)
            at = broken.stop or _next(source, at + 1)
            continue
        if lost is not None:
            yield Found(lost, at, reason)
            lost = None
        yield from found
        at = stop
    if lost is not None:
        yield Found(lost, source.size, reason)


def _reader(payloads: bool):
    def batch(archive, found):
        columns = [
            [archive] * len(found),
            [f.start for f in found],
            [f.stop - f.start for f in found],
            [f.damage for f in found],
            *([f.fields.get(k) for f in found] for k in ("warc-type", "warc-record-id", "warc-target-uri", "warc-refers-to")),
            [f.digest for f in found],
            [None if f.damage else f.size for f in found],
            [f.payload if payloads and not f.damage else None for f in found],
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FOUND)], schema=FOUND)

    def run(batches):
        for names in batches:
            for archive in names.column(0).to_pylist():
                files, path = opened(archive)
                with files.open_input_file(path) as file:
                    held, size = [], 0
                    for found in salvage(Source(file, file.size())):
                        if not payloads:
                            found.payload = b""
                        held.append(found)
                        size += len(found.payload) + 1024
                        if size > 1 << 22:
                            yield batch(archive, held)
                            held, size = [], 0
                    if held:
                        yield batch(archive, held)

    return run


def read(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Records and gaps of the archives named in the column ``archive``; a gap has its reason in ``damage``."""
    n = archives.count()
    names = archives.select("archive").repartition(max(1, n))
    return names.mapInArrow(_reader(payloads), FOUND_DDL)


def in_folder(spark: SparkSession, folder: str, pattern: str = "*.warc*") -> DataFrame:
    """(archive, n_bytes) of the archives below a folder, listed by Spark."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return files.select(F.col("path").alias("archive"), F.col("length").alias("n_bytes"))


def records(found: DataFrame) -> DataFrame:
    return found.where("damage IS NULL").drop("damage")


def gaps(found: DataFrame) -> DataFrame:
    """(archive, offset, length, damage): the bytes in quarantine."""
    return found.where("damage IS NOT NULL").select("archive", "offset", "length", "damage")


def round_trip(pages: DataFrame, **settings) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page, from its archive."""
    def page(column):
        return F.regexp_extract(column, f"{PAGE}(-?[0-9]+)", 1).try_cast("long")

    found = records(read(write(pages, **settings), payloads=False))
    return found.select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to")
    )


SQL = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, coalesce(html, '') AS payload FROM pages
), owned AS (
  SELECT *, CASE WHEN n >= {SMALL} THEN max(page_id) OVER (PARTITION BY payload) END AS owner FROM p
)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(payload) AS payload_digest,
       CASE WHEN owner IS NOT NULL AND page_id IS DISTINCT FROM owner THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN owner IS NOT NULL AND page_id IS DISTINCT FROM owner THEN owner END AS refers_to
FROM owned
"""
