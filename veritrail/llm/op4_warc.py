"""WARC archives with a reader that salvages.

Writing: every page becomes a WARC/1.1 record in a gzip member of its own. Executors write members to files of the shared
folder, of about ``FILE_BYTES`` each, under names that no other attempt has, and return them as a manifest: files that a
lost task left are in no manifest and are never read. Pages with equal payloads of at least ``REVISIT_BYTES`` are stored
once: the smallest page_id holds the payload, the others are revisit records that name it.

Reading takes archives of any writer: WARC 0.17 to 1.1, plain, gzipped by record or as a whole, with records of all types,
and responses with their HTTP head. A record counts if its version line, its header, its length and whatever digests it
states (SHA-1, SHA-256 or MD5, in base 32 or hexadecimal) hold, and if its gzip member is whole. Where something fails, the
reader searches on for the next member that starts validly or the next version line, takes up there, and logs the bytes
between as a quarantined gap. So damage costs the records it touches and none after them; of a member with several
records, those before the damage are kept if their digests prove them. The search is linear: each mark is found once, and
inflating stops at the first fault.

The smallest page_id of a payload is found by sums over digests, not by gathering equal pages; digests that occur twice
or more are joined back, dealt over salts where one payload fills a large share of all rows.

Null html is an empty payload. Pages with a null page_id are written and read back as responses and are never named by
a revisit. Rows that repeat the smallest page_id of a payload are all responses. Null urls are left out of the record.
Very long pages make a file of their own. No rows give no records. Other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, claim, shared_folder, staged, table

REVISIT_BYTES = 100
FILE_BYTES = 8 << 20
#: Files that one task reads, one after the other.
TASK_FILES = 16
#: Bytes of a member that may pass before anything comes out: a file name in its head is shorter.
SILENT = 1 << 17
#: Pages of one payload from which they are dealt over salts.
HOT = 100_000
VERSION = b"WARC/1.1\r\n"
MAGIC = b"\x1f\x8b\x08"
_LINE = re.compile(rb"WARC/(?:0\.1[78]|1\.[01])\r\n")
_NAMES = uuid.UUID("6f1b0c1e-6a57-4d3c-9a39-2d2f1c6f6a01")
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, headers map<string,string>"
GAP = "start long, length long, reason string"
#: Digest names with their sizes; other names are not checked.
_DIGESTS = {"sha1": 20, "sha256": 32, "md5": 16}


def record(page_id, url, kind: str, refers_to, size: int, digest: str, payload: bytes) -> bytes:
    """One WARC record; a revisit has the full payload's size and digest in its header and no payload."""
    head = [
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(_NAMES, f'{page_id} {digest}')}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {size}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(payload)}",
    ]
    head += [f"X-Page-ID: {page_id}"] * (page_id is not None)
    head += [f"X-Refers-To-Page-ID: {refers_to}"] * (refers_to is not None)
    if url:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url))
    if refers_to is not None:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(_NAMES, f'{refers_to} {digest}')}>")
    return VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _holds(said: str | None, data) -> bool | None:
    """Whether a stated digest is that of the data; None where there is none that can be checked."""
    name, found, value = (said or "").partition(":")
    name, value = name.strip().lower().replace("-", ""), value.strip()
    if not found or name not in _DIGESTS:
        return None
    own = hashlib.new(name, data).digest()
    if len(value) == 2 * len(own):
        return value.lower() == own.hex()
    return value.upper().rstrip("=") == base64.b32encode(own).decode().rstrip("=")


def _payload(kind: str, headers: dict, block: memoryview) -> tuple[memoryview, bool]:
    """What a record's payload is, and whether a payload digest can be held against it: not if it is chunked or cut."""
    if not headers.get("content-type", "").lower().replace(" ", "").startswith("application/http"):
        return block, kind != "revisit" and "warc-truncated" not in headers
    head = bytes(block[: 1 << 20])
    end = head.find(b"\r\n\r\n")
    if end < 0:
        return block[len(block) :], False
    coded = re.search(rb"\r\ntransfer-encoding:[^\r]*chunked", head[:end], re.I)
    return block[end + 4 :], kind != "revisit" and not coded and "warc-truncated" not in headers


class _Marks:
    """The next place of a mark from wherever one looks, each place being found once as long as one looks forward."""

    def __init__(self, find):
        self.find, self.asked, self.found = find, -1, -1

    def after(self, at: int) -> int:
        if not self.asked <= at <= self.found:
            self.asked, self.found = at, self.find(at)
        return self.found


class _Reader:
    """Records of plain WARC bytes."""

    def __init__(self, data: bytes):
        self.data, self.view, size = data, memoryview(data), len(data)
        place = lambda x: x if x >= 0 else size
        self.lines = _Marks(lambda at: m.start() if (m := _LINE.search(data, at)) else size)
        self.magics = _Marks(lambda at: place(data.find(MAGIC, at)))
        self.ends = _Marks(lambda at: place(data.find(b"\r\n\r\n", at)))

    def parse(self, at: int) -> tuple[dict, int, bool] | str:
        """The record at a place, where it ends and whether a digest proves it; or why there is none."""
        data = self.data
        line = _LINE.match(data, at)
        if not line:
            return "no version line"
        end = self.ends.after(line.end() - 2)
        if end == len(data) or self.lines.after(at + 1) < end:
            return "unended header"
        headers: dict[str, str] = {}
        name = ""
        for part in data[line.end() : end].decode("utf-8", "replace").split("\r\n"):
            if part[:1] in (" ", "\t") and name:  # a folded line
                headers[name] += " " + part.strip()
                continue
            name, found, value = part.partition(":")
            name = name.strip().lower()
            if found:
                headers.setdefault(name, value.strip())
        kind = headers.get("warc-type", "").lower()
        if not kind or not re.fullmatch("[0-9]{1,15}", headers.get("content-length", "")):
            return "unreadable header"
        start = end + 4
        stop = start + int(headers["content-length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            return "wrong length"
        block = self.view[start:stop]
        payload, whole = _payload(kind, headers, block)
        checks = [_holds(headers.get("warc-block-digest"), block), _holds(headers.get("warc-payload-digest"), payload) if whole else None]
        if False in checks:
            return "wrong digest"
        number = lambda k: int(headers[k]) if re.fullmatch("-?[0-9]{1,18}", headers.get(k, "")) else None
        said = headers.get("warc-payload-digest", "").strip()
        out = {"page_id": number("x-page-id"), "url": headers.get("warc-target-uri"), "record_type": kind, "refers_to": number("x-refers-to-page-id")}
        out["payload_bytes"] = n if (n := number("x-payload-length")) is not None and kind == "revisit" else len(payload)
        out["payload_digest"] = said.removeprefix("sha256:") if said else hashlib.sha256(payload).hexdigest()
        return out | {"payload": payload, "headers": headers}, stop + 4, True in checks


def _inflated(view: memoryview, at: int) -> tuple[bytes, int | None]:
    """What the gzip member at a place holds, and where it ends; None for the end if it is cut short or damaged."""
    reader, parts, step, seen = zlib.decompressobj(31), [], 1 << 12, 0
    while at < len(view):
        piece = view[at : at + step]
        try:
            parts.append(reader.decompress(piece))
        except zlib.error:
            return b"".join(parts), None
        at += len(piece)
        seen += len(piece)
        if seen > SILENT and not any(parts):
            return b"", None
        if reader.eof:
            return b"".join(parts), at - len(reader.unused_data)
        step = min(2 * step, 1 << 20)
    return b"".join(parts), None


def _of_member(data: bytes, whole: bool) -> tuple[list[dict], str]:
    """The records of an inflated member, and what is wrong with it; of a damaged one, those that digests prove."""
    reader, at, found, wrong = _Reader(data), 0, [], "" if whole else "damaged member"
    while at < len(data):
        got = reader.parse(at)
        if isinstance(got, str):
            wrong = wrong or ("bytes after the record" if found and got == "no version line" else got)
            at = reader.lines.after(at + 1)
        else:
            at = got[1]
            if whole or got[2]:
                found.append(got[0])
    return found, wrong


def salvage(data: bytes) -> Iterator[tuple[str, object]]:
    """("record", fields) and ("gap", (start, length, reason)) over an archive of gzip members or of plain records."""
    reader, at, lost, reason = _Reader(data), 0, None, ""
    while at < len(data):
        found, end, wrong = [], None, ""
        if data.startswith(MAGIC, at):
            inflated, end = _inflated(reader.view, at)
            found, wrong = _of_member(inflated, end is not None)
            wrong = wrong or ("" if found else "empty member")
        else:
            got = reader.parse(at)
            if isinstance(got, str):
                wrong = got
            else:
                found, end = [got[0]], got[1]
        if not wrong and lost is not None:
            yield "gap", (lost, at - lost, reason)
            lost = None
        for x in found:
            yield "record", x
        if wrong and lost is None:
            lost, reason = at, wrong
        # After a fault, whatever looks like a member or a version line is tried in turn; a whole member is passed over.
        at = end if end is not None else min(reader.lines.after(at + 1), reader.magics.after(at + 1))
    if lost is not None:
        yield "gap", (lost, len(data) - lost, reason)


def _filesystem(folder: str):
    """A file system that executors reach without Spark, and the folder's path there."""
    from pyarrow import fs

    if re.match("file:/", folder):
        folder = re.sub("^file:/*", "/", folder)
    return (fs.LocalFileSystem(), folder) if folder.startswith("/") else fs.FileSystem.from_uri(folder)


def archived(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """The manifest of the archive files of pages: source (path), bytes and records of each; written when it is staged."""
    folder = folder or f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    known = pages.select("page_id", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    known = known.filter((F.length("payload") >= REVISIT_BYTES) & F.col("page_id").isNotNull()).select("page_id", F.sha2("payload", 256).alias("digest"))
    repeated = known.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    repeated = staged(repeated)
    hot, rest = repeated.filter(F.col("n") > HOT), repeated.filter(F.col("n") <= HOT).select(F.col("digest").alias("twice"), "first_id")
    if hot.head(1):
        rows = beside(rows, staged(hot.select("digest", F.col("first_id").alias("hot_id"))), "digest", "page_id")
    else:
        rows = rows.withColumn("hot_id", F.lit(None).cast("long"))
    meets = F.when(F.col("hot_id").isNull() & F.col("page_id").isNotNull(), F.col("digest")) == F.col("twice")
    joined = rows.join(rest, meets, "left")
    first = F.when(F.col("page_id").isNotNull(), F.coalesce("hot_id", "first_id"))
    joined = joined.select("page_id", "url", "payload", "digest", F.when(first != F.col("page_id"), first).alias("refers_to"))

    def write(batches):
        claim("warc")
        system, path = _filesystem(folder)
        parts, size = [], 0

        def saved():
            system.create_dir(path, recursive=True)
            name = f"{path}/{uuid.uuid4().hex}.warc.gz"
            with system.open_output_stream(name, compression=None) as out:
                for p in parts:
                    out.write(p)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64()), pa.array([len(parts)], pa.int64())], ["source", "bytes", "records"])

        for batch in batches:
            for k in range(len(batch)):
                page, url, payload, digest, refers = (batch.column(c)[k].as_py() for c in ("page_id", "url", "payload", "digest", "refers_to"))
                kind, body = ("response", payload) if refers is None else ("revisit", b"")
                parts.append(member(record(page, url, kind, refers, len(payload), digest, body)))
                size += len(parts[-1])
                if size >= FILE_BYTES:
                    yield saved()
                    parts, size = [], 0
        if parts:
            yield saved()

    return staged(joined.mapInArrow(write, "source string, bytes long, records long"))


def _opened(batch) -> Iterator[tuple[str, bytes]]:
    """(source, bytes) of a batch of archives: held in a column of bytes, or files to be opened."""
    if "data" in batch.schema.names:
        yield from zip(batch.column("source").to_pylist(), (x.as_py() or b"" for x in batch.column("data")))
    else:
        for source in batch.column("source").to_pylist():
            system, path = _filesystem(source)
            with system.open_input_stream(path, compression=None) as f:
                yield source, f.read()


def _wanted(archives: DataFrame) -> DataFrame:
    if "data" in archives.columns:
        return archives.select("source", "data")
    n, cores = archives.count(), archives.sparkSession.sparkContext.defaultParallelism
    return archives.select("source").repartition(max(1, min(n, max(cores, n // TASK_FILES))))


def records(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that can be salvaged from archives (a manifest, or ``data`` of bytes); without payloads if not wanted."""
    schema = RECORD if payloads else RECORD[: RECORD.index(", payload binary")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "map<string,string>": pa.map_(pa.string(), pa.string())}
    fields = [(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")]
    plain = {"payload": lambda x: x.tobytes(), "headers": lambda x: list(x.items())}
    names = [n for n, _ in fields]

    def read(batches):
        claim("warc")
        for batch in batches:
            for _, data in _opened(batch):
                found, size = [], 0
                for kind, x in salvage(data):
                    if kind == "record":
                        found.append(x)
                        size += len(x["payload"]) if payloads else 0
                    if found and (size > FILE_BYTES or len(found) == 10_000):
                        yield pa.RecordBatch.from_arrays([pa.array([plain.get(n, lambda v: v)(r[n]) for r in found], t) for n, t in fields], names)
                        found, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([plain.get(n, lambda v: v)(r[n]) for r in found], t) for n, t in fields], names)

    return _wanted(archives).mapInArrow(read, schema)


def gaps(archives: DataFrame) -> DataFrame:
    """The log of quarantined bytes: ``source`` of the archive, where each gap starts, its length and the first reason."""

    def read(batches):
        claim("warc")
        for batch in batches:
            for source, data in _opened(batch):
                found = [x for kind, x in salvage(data) if kind == "gap"]
                columns = [pa.array([source] * len(found), pa.string())]
                columns += [pa.array([g[k] for g in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, ["source", "start", "length", "reason"])

    return _wanted(archives).mapInArrow(read, f"source string, {GAP}")


def read_files(spark, path: str) -> DataFrame:
    """Archive files of up to 2 GB each, as ``source`` and ``data`` for :func:`records` and :func:`gaps`."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("source"), F.col("content").alias("data"))


def op4_warc(spark, sf_dir: str) -> DataFrame:
    stored = archived(table(spark, sf_dir, "pages"))
    return records(stored, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (
  SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN first_id END AS refers_to
FROM f
"""
