"""Media columns: content-addressed payloads in tar shards.

A text's payload is its UTF-8 bytes, filled with bytes 255 up to a positive multiple of 576, and
is stored as the samples of a lossless 8-bit grey image (PNG, 576 samples a row). Tasks append
members named by the payload's SHA-256 to tar shards in the shared folder; rows carry digest, shard,
offset and length. A task stores a payload once, and the index keeps one address per digest, so a
group of copies costs one member a task at most. Later columns come from range reads: the image's
header alone gives width, height and depth, the whole member gives the samples back.

Shards are written under names of their own for every task attempt and the index is written as a
table before anything reads it: an attempt that is lost leaves an unreferenced file, nothing else.

Defined cases: a null text is an empty one (one row of samples); equal texts have equal values
throughout; null ids and repeated rows are kept as rows; an empty table writes no shard and gives an
empty result; other columns are ignored. Memory is bounded by one record batch and one member.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docattr.session import cut, scratch_path

ROW = 576
SHARD_BYTES = 64 << 20
#: Signature, then a chunk of 13 bytes: width, height, bit depth, colour type (0 is grey), three zeros.
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33


def payload_of(text: str | None) -> tuple[bytes, int]:
    """(payload, length before filling)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (max(ROW, -(-len(raw) // ROW) * ROW) - len(raw)), len(raw)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_image(payload: bytes) -> bytes:
    """The payload as samples, row by row, each row without a prediction filter."""
    height = len(payload) // ROW
    rows = np.zeros((height, ROW + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, ROW)
    return b"".join([
        PNG_SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, height, 8, 0, 0, 0, 0)),
        _chunk(b"IDAT", zlib.compress(rows.tobytes(), 3)), _chunk(b"IEND", b"")])


def read_header(head: bytes) -> tuple[int, int, int]:
    """(width, height, bits a sample) from the first ``HEADER_BYTES`` bytes."""
    if head[:8] != PNG_SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not an image of this kind")
    width, height, depth = struct.unpack(">IIB", head[16:25])
    return width, height, depth


def to_payload(media: bytes) -> bytes:
    """The samples of a stored image."""
    width, height, _ = read_header(media)
    at, packed = 8, []
    while at < len(media):
        (size,), kind = struct.unpack(">I", media[at:at + 4]), media[at + 4:at + 8]
        if kind == b"IDAT":
            packed.append(media[at + 8:at + 8 + size])
        at += size + 12
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    return rows[:, 1:].tobytes()


def _filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class _Shards:
    """Tar shards of one task attempt."""

    def __init__(self, folder: str, limit: int):
        self.files, self.base = _filesystem(folder)
        self.limit, self.out, self.known = limit, None, {}

    def add(self, payload: bytes) -> tuple[str, str, int, int]:
        """(digest, shard, offset, length) of a payload, stored unless this shard holds it."""
        digest = hashlib.sha256(payload).hexdigest()
        if digest in self.known:
            return digest, *self.known[digest]
        media = to_image(payload)
        if self.out is None:
            self.name, self.at, self.known = f"{uuid.uuid4().hex}.tar", 0, {}
            self.out = self.files.open_output_stream(f"{self.base}/{self.name}")
        info = tarfile.TarInfo(f"{digest}.png")
        info.size = len(media)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self.out.write(head + media + b"\0" * (-len(media) % 512))
        place = (self.name, self.at + len(head), len(media))
        self.at += len(head) + len(media) + -len(media) % 512
        self.known[digest] = place
        if self.at >= self.limit:
            self.close()
        return digest, *place

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * 1024)
            self.out.close()
            self.out, self.known = None, {}


_STORED = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("digest", pa.string()), ("shard", pa.string()),
    ("offset", pa.int64()), ("length", pa.int64())])


def store(docs: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """Write the payloads: rows (doc_id, n_bytes, digest) and addresses (digest, shard, offset, length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = _Shards(folder, shard_bytes)
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                payload, n = payload_of(text.as_py())
                rows.append((key.as_py(), n, *shards.add(payload)))
            columns = zip(*rows, strict=True) if rows else [[]] * len(_STORED)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), f.type) for c, f in zip(columns, _STORED, strict=True)], schema=_STORED)
        shards.close()

    _filesystem(folder)[0].create_dir(_filesystem(folder)[1], recursive=True)
    rows = cut(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_bytes long, digest string, shard string, offset long, length long"))
    place = F.min(F.struct("shard", "offset", "length")).alias("place")
    addresses = rows.groupBy("digest").agg(place).select("digest", "place.*")
    return rows.select("doc_id", "n_bytes", "digest"), cut(addresses)


def _ranges(addresses: DataFrame, folder: str, limit: int | None, fill, schema: str) -> DataFrame:
    """One row per address: ``fill(bytes)`` of its first ``limit`` bytes (None: all), in shard order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _filesystem(folder)
        name, source = None, None
        for batch in batches:
            rows = []
            for digest, shard, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != name:
                    name, source = shard, files.open_input_file(f"{base}/{shard}")
                rows.append((digest, *fill(source.read_at(length if limit is None else min(limit, length), offset))))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c)) for c in zip(*rows, strict=True)], names=[c.split()[0] for c in schema.split(", ")])

    spread = int(addresses.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    members = addresses.select("digest", "shard", "offset", "length")
    return members.repartition(spread, "digest").sortWithinPartitions("shard", "offset").mapInArrow(run, schema)


def metadata(addresses: DataFrame, folder: str) -> DataFrame:
    """(digest, width, height, depth) from the headers alone."""
    return _ranges(addresses, folder, HEADER_BYTES, read_header, "digest string, width long, height long, depth long")


def _features(media: bytes) -> tuple:
    payload = to_payload(media)
    samples = np.frombuffer(payload, np.uint8)
    sums = np.bincount(samples >> 4, minlength=16)
    steps = int(np.abs(np.diff(samples.astype(np.int16))).sum())
    feature = f"mean={int(samples.sum(dtype=np.int64)) * 1000 // len(samples)};steps={steps};levels=" + ".".join(map(str, sums))
    return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media),
            hashlib.sha256(media).hexdigest(), feature)


def features(addresses: DataFrame, folder: str) -> DataFrame:
    """Read the members back: sizes, digests, and statistics of the samples."""
    return _ranges(addresses, folder, None, _features,
                   "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
                   "media_sha256 string, feature string")


def media_columns(docs: DataFrame, folder: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Store, then fill: address, header columns and features of every row."""
    folder = folder or scratch_path(docs.sparkSession, "media")
    rows, addresses = store(docs, folder, shard_bytes)
    size = F.concat(F.lit("png="), F.concat_ws("x", "width", "height", "depth"))
    members = metadata(addresses, folder).join(features(addresses, folder), "digest").withColumn(
        "feature", F.concat_ws(";", size, "feature"))
    # everything about a payload meets first, so that the rows of a frequent one are joined once and can be split
    return rows.join(addresses.join(members, "digest"), "digest")
