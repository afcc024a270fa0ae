"""Content-defined chunking of media payloads.

A payload is stored as a mono WAV file of 8-bit samples. The file is cut where a rolling gear hash of the last 32 bytes
hits a mask, so that equal passages give equal chunks wherever they stand. Chunks are known by their SHA-256, and a file
is its ordered list of chunks. Bytes are stored once: chunks that one file has stay with its list, chunks that several
files have are rows of their own. Reading joins lists to shared chunks by digest, puts each file together in order, and
checks every chunk and the payload against the digests; features are computed from what was read back.

* A first pass only lists digests. Which are shared is found by sums over digests and sent to the second pass as a bit
  map of fixed size; so most bytes are written where they were read, without a shuffle, and read back in place.
* Equal payloads are one file. A file or chunk that fills a third of the table is written once by a task, then once in
  all, and the joins that spread it again are ones that Spark may split.

The gear hash of all positions is computed in five shifted additions over whole arrays, not byte by byte.

Null text is an empty payload; padding makes it 576 bytes of 255. Very long texts are many chunks. Repeated rows and ids
come back each for itself. No rows give no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_map, claim, mixed, runs, staged, table, utf8

UNIT = 576
PAD = 255
RATE = 8_000
#: Bits that tell which files and chunks may be shared; a fixed size, whatever the corpus.
MARKS = 1 << 26
#: Chunks: at least and at most so many bytes; a cut is due once in MASK + 1 positions beyond the least.
LEAST, MOST, MASK = 1_024, 16_384, np.uint32((1 << 11) - 1)
LEVEL = 3
_GEAR = (mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
HEADER = 44


def padded(text: bytes) -> bytes:
    """A positive multiple of 576 bytes."""
    return text + bytes([PAD]) * (max(1, -(-len(text) // UNIT)) * UNIT - len(text))


def wav(samples: bytes) -> bytes:
    """A WAV file of unsigned 8-bit mono samples (the payload's length is even, so there is no pad byte)."""
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8)
    return b"RIFF" + struct.pack("<I", 4 + len(form) + 8 + len(samples)) + b"WAVE" + form + b"data" + struct.pack("<I", len(samples)) + samples


def samples(file: bytes) -> bytes:
    if file[:4] != b"RIFF" or file[8:16] != b"WAVEfmt " or struct.unpack("<HHIIHH", file[20:36]) != (1, 1, RATE, RATE, 1, 8):
        raise ValueError("not a mono file of 8-bit samples")
    return file[HEADER : HEADER + struct.unpack("<I", file[40:HEADER])[0]]


def cuts(data: bytes) -> list[int]:
    """Where the chunks of ``data`` end."""
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for k in range(5):
        by = 1 << k
        if len(h) > by:
            h[by:] = h[by:] + (h[:-by] << np.uint32(by))
    due = np.flatnonzero((h & (MASK << np.uint32(21))) == 0) + 1
    out, at = [], 0
    while len(data) - at > MOST or len(data) - at > LEAST:
        k = int(np.searchsorted(due, at + LEAST))
        at = min(int(due[k]) if k < len(due) else len(data), at + MOST, len(data))
        out.append(at)
    if at < len(data):
        out.append(len(data))
    return out


def feature(payload: bytes, chunks: int) -> str:
    """Chunks, mean and deviation of the samples, and the share of each quarter of the sample range."""
    x = np.frombuffer(payload, np.uint8)
    quarters = np.bincount(x >> 6, minlength=4) / len(x)
    return f"chunks={chunks};mean={x.mean():.4f};std={x.std():.4f};quarters=" + "/".join(f"{q:.4f}" for q in quarters)


STORE = "tag int, key binary, digests array<binary>, sizes array<int>, outside array<int>, data binary"
_STORE = (
    ("tag", pa.int32()), ("key", pa.binary()), ("digests", pa.list_(pa.binary())),
    ("sizes", pa.list_(pa.int32())), ("outside", pa.list_(pa.int32())), ("data", pa.binary()),
)
READ = "file binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_READ = tuple(zip([x.split()[0] for x in READ.split(", ")], [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]))
#: Kinds of stored rows: a file, a file that other rows may share, a chunk that other files may share.
FILE, COPIED, CHUNK = 0, 1, 2


def _batch(rows: list[tuple], fields) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


def _split(text: bytes) -> tuple[bytes, list[bytes], list[bytes]]:
    """The name of a text's file (half its payload's SHA-256), its chunks and their digests."""
    payload = padded(text)
    file = wav(payload)
    ends = cuts(file)
    parts = [file[x:y] for x, y in zip([0, *ends], ends)]
    return hashlib.sha256(payload).digest()[:16], parts, [hashlib.sha256(x).digest() for x in parts]


def listed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, file and the digests of its chunks in order."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def each(batches):
        claim("media")
        for batch in batches:
            data, bounds = utf8(batch.column("text"))
            for start, end in runs(bounds, 1 << 22):
                got = [_split(data[bounds[k] : bounds[k + 1]].tobytes()) for k in range(start, end)]
                columns = [batch.column("doc_id").slice(start, end - start), pa.array(np.diff(bounds[start : end + 1]), pa.int64())]
                columns += [pa.array([g[0] for g in got], pa.binary()), pa.array([g[2] for g in got], pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "file", "digests"])

    return docs.select("doc_id", "text").mapInArrow(each, f"doc_id {kind}, n_bytes long, file binary, digests array<binary>")


def _place(digest: bytes) -> int:
    return int.from_bytes(digest[:4], "big") & (MARKS - 1)


def shared(lists: DataFrame) -> np.ndarray:
    """A bit for the hash of every file that several rows have and every chunk that several files have.

    The bits are set by executors; the driver gets MARKS / 8 bytes at most, whatever the corpus. Where other digests
    fall on a set bit, a row is only taken for shared and deduplicated for nothing.
    """
    copies = lists.groupBy("file").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("file").alias("digest"))
    pairs = lists.select("file", F.explode("digests").alias("digest")).distinct()
    chunks = pairs.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest")
    place = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long").bitwiseAND(F.lit(MARKS - 1))
    marks = copies.unionByName(chunks).select(place.alias("p"))
    return bit_map(marks, MARKS)


def stored(docs: DataFrame, marks: np.ndarray) -> DataFrame:
    """Files as ordered chunk lists with the bytes of the chunks that are theirs alone, and shared chunks by themselves.

    What is marked as shared is written once by each task, for :func:`restored` to deduplicate.
    """
    sent = docs.sparkSession.sparkContext.broadcast(marks)

    def write(batches):
        claim("media")
        bits, pack = sent.value, zstandard.ZstdCompressor(level=LEVEL)
        marked = lambda d: bits[_place(d) >> 3] >> (_place(d) & 7) & 1
        seen: set[bytes] = set()
        for batch in batches:
            data, bounds = utf8(batch.column("text"))
            rows, size = [], 0
            for k in range(len(batch)):
                file, parts, digests = _split(data[bounds[k] : bounds[k + 1]].tobytes())
                copied = marked(file)
                if copied:
                    if file in seen:
                        continue
                    seen.add(file)
                outside = [i for i, d in enumerate(digests) if marked(d)]
                for i in outside:
                    if digests[i] not in seen:
                        seen.add(digests[i])
                        rows.append((CHUNK, digests[i], None, None, None, pack.compress(parts[i])))
                        size += len(rows[-1][-1])
                away = set(outside)
                own = pack.compress(b"".join(p for i, p in enumerate(parts) if i not in away))
                rows.append((COPIED if copied else FILE, file, digests, [len(p) for p in parts], outside, own))
                size += len(own)
                if size > 1 << 22:
                    yield _batch(rows, _STORE)
                    rows, size = [], 0
            yield _batch(rows, _STORE)

    return docs.select("text").mapInArrow(write, STORE)


def _read_back(file: bytes, digests: list[bytes], sizes: list[int], outside: dict[int, bytes], own: bytes, unpack) -> tuple:
    """A file put together from its list, every chunk and the payload checked, with what is computed from it."""
    rest, at, parts = unpack.decompress(own), 0, []
    for i, (digest, size) in enumerate(zip(digests, sizes)):
        if i in outside:
            part = unpack.decompress(outside[i])
        else:
            part, at = rest[at : at + size], at + size
        if len(part) != size or hashlib.sha256(part).digest() != digest:
            raise ValueError(f"file {file.hex()}: chunk {i} is damaged")
        parts.append(part)
    whole = b"".join(parts)
    payload = samples(whole)
    named = hashlib.sha256(payload)
    if named.digest()[:16] != file:
        raise ValueError(f"file {file.hex()}: another payload was read back")
    media_digest = hashlib.sha256(whole).hexdigest()
    return file, len(payload), named.hexdigest(), zlib.crc32(payload[-32:]), len(whole), media_digest, feature(payload, len(parts))


def restored(store: DataFrame) -> DataFrame:
    """Each distinct file of a store, read back: see READ."""
    files = store.filter(F.col("tag") == FILE).unionByName(store.filter(F.col("tag") == COPIED).dropDuplicates(["key"]))
    files = files.select(F.col("key").alias("file"), "digests", "sizes", "outside", "data")
    chunks = store.filter(F.col("tag") == CHUNK).dropDuplicates(["key"]).select(F.col("key").alias("digest"), F.col("data").alias("chunk"))

    def alone(batches):
        claim("media")
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = [_read_back(r["file"], r["digests"], r["sizes"], {}, r["data"], unpack) for r in (x for k in range(0, len(batch), 64) for x in batch.slice(k, 64).to_pylist())]
            yield _batch(rows, _READ)

    def together(batches):
        claim("media")
        unpack, head, outside = zstandard.ZstdDecompressor(), None, {}
        close = lambda: [_read_back(head["file"], head["digests"], head["sizes"], outside, head["data"], unpack)] if head else []
        for batch in batches:
            rows = []
            for r in (x for k in range(0, len(batch), 64) for x in batch.slice(k, 64).to_pylist()):
                if r["seq"] < 0:
                    rows += close()
                    head, outside = r, {}
                elif not head or r["file"] != head["file"]:
                    raise ValueError(f"file {r['file'].hex()}: its list is missing")
                else:
                    outside[r["seq"]] = r["data"]
            yield _batch(rows, _READ)
        yield _batch(close(), _READ)

    whole = files.filter(F.size("outside") == 0).mapInArrow(alone, READ)
    parted = files.filter(F.size("outside") > 0)
    wanted = parted.select("file", F.explode(F.transform("outside", lambda i: F.struct(i.alias("seq"), F.element_at("digests", i + 1).alias("digest")))).alias("x"))
    empty = {"digests": "array<binary>", "sizes": "array<int>"}
    fetched = wanted.select("file", "x.*").join(chunks, "digest").select("file", "seq", *[F.lit(None).cast(t).alias(c) for c, t in empty.items()], F.col("chunk").alias("data"))
    lists = parted.select("file", F.lit(-1).alias("seq"), "digests", "sizes", "data")
    joined = lists.unionByName(fetched).repartition("file").sortWithinPartitions("file", "seq").mapInArrow(together, READ)
    return whole.unionByName(joined)


def media(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_bytes and what was read back of its file."""
    lists = staged(listed(docs))
    store = staged(stored(docs, shared(lists)))
    return lists.select("doc_id", "n_bytes", "file").join(restored(store), "file").drop("file")


def op7_media(spark, sf_dir: str) -> DataFrame:
    return media(table(spark, sf_dir, "documents"))
