"""Media columns: content-addressed payloads in tar shards.

A text's bytes, padded with zero bytes to a multiple of 64, are the pixels of an 8-bit grey PNG, 64 to a row: lossless, and
compressed.  Each task streams its images into tar shards in the shared folder, each under the digest of its bytes and once
in a shard.  Rows carry shard, digest, offset and length only.  A second pass reads headers by range for the metadata
columns, and the images for what is computed from samples.

A shard has a new name in each attempt of a task, and rows name the shards of the attempt that was kept, so a lost executor
costs the attempt alone; shards that no row names can be deleted.

Edge cases: null or empty text is 64 zero bytes.  Equal texts have equal values in every column but doc_id, and rows that
repeat a doc_id are stored each.  A null doc_id stays null.  Extra columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import common

#: Pixels of a row, and bytes of a shard after which the next is begun.
WIDTH, SHARD_BYTES = 64, 256 << 20
#: Payload bytes that one task reads back.
TASK_BYTES = 64 << 20
#: The bytes that open a PNG, and what ends it.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Bytes of a PNG up to the end of its header.
HEADER = 8 + 25

INDEX = "doc_id long, n_bytes long, shard string, digest string, offset long, length long"


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # a filter byte of 0 before each row
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def header(data: bytes) -> tuple[int, int, int]:
    """Width, height and bits of a sample from the first HEADER bytes."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    width, height, bits = struct.unpack(">IIB", data[16:25])
    return width, height, bits


def decode(data: bytes) -> bytes:
    width, height, _ = header(data)
    at, packed = 8, []
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IDAT":
            packed.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    return lines[:, 1:].tobytes()


class Shards:
    """Tar files in a folder that any of Arrow's file systems can reach."""

    def __init__(self, folder: str):
        self.folder = folder
        self.files, self.base = fs.FileSystem.from_uri(folder)
        self.stream = None

    def _open(self) -> None:
        self.name = f"{uuid.uuid4().hex}.tar"
        self.files.create_dir(self.base, recursive=True)
        self.stream = self.files.open_output_stream(f"{self.base}/{self.name}", compression=None)
        self.at, self.held = 0, {}

    def put(self, digest: str, data: bytes) -> tuple[str, int]:
        """The shard and the offset of the data in it."""
        if self.stream is None or self.at > SHARD_BYTES:
            self.close()
            self._open()
        if digest not in self.held:
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(data)
            head = info.tobuf(tarfile.USTAR_FORMAT)
            self.stream.write(head + data + bytes(-len(data) % 512))
            self.held[digest] = self.at + len(head)
            self.at += len(head) + len(data) + -len(data) % 512
        return self.name, self.held[digest]

    def close(self) -> None:
        if self.stream is not None:
            self.stream.write(bytes(1024))
            self.stream.close()
            self.stream = None


def _uri(folder: str) -> str:
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"


def store(docs: DataFrame, folder: str) -> DataFrame:
    """Writes the payloads to shards in the folder.  doc_id, n_bytes, shard, digest, offset, length for each row of docs."""
    at = _uri(folder)

    def run(batches):
        shards = Shards(at)
        try:
            for block in common.blocks(batches, "text"):
                data, ends = common.arrow_bytes(block.column("text"))
                rows = []
                for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    image = encode(padded(data[a:b].tobytes()))
                    digest = hashlib.sha256(image).hexdigest()
                    rows.append((b - a, *(place := shards.put(digest, image))[:1], digest, place[1], len(image)))
                types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), *columns], ["doc_id", "n_bytes", "shard", "digest", "offset", "length"])
        finally:
            shards.close()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, INDEX)


def _ranges(index: DataFrame, folder: str, most: int | None, each, schema: str) -> DataFrame:
    """A row from each index row and the first `most` bytes of its payload (all, if None)."""
    at = _uri(folder)
    names = index.columns

    def run(batches):
        files, base = fs.FileSystem.from_uri(at)
        name, handle = None, None
        for batch in batches:
            rows = []
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                row = dict(zip(names, row, strict=True))
                if row["shard"] != name:
                    name, handle = row["shard"], files.open_input_file(f"{base}/{row['shard']}")
                rows.append(each(row, handle.read_at(min(row["length"], most or row["length"]), row["offset"])))
            if rows:
                yield pa.RecordBatch.from_pylist(rows)

    return index.mapInArrow(run, schema)


def metadata(index: DataFrame, folder: str) -> DataFrame:
    """The index with width, height and bits, from range reads of the headers alone."""

    def each(row, data):
        width, height, bits = header(data)
        return row | {"width": width, "height": height, "bits": bits}

    return _ranges(index, folder, HEADER, each, f"{INDEX}, width long, height long, bits long")


def feature(payload: bytes, width: int, height: int) -> str:
    """Size, mean, spread and a 64-bit picture hash: which of 64 bands of samples are brighter than the mean."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    total, squares = int(x.sum()), int((x * x).sum())
    bands = np.add.reduceat(x, np.arange(64) * len(x) // 64) * 64
    bits = int.from_bytes(np.packbits(bands > total).tobytes(), "big")
    return f"{width}x{height};sum={total};squares={squares};hash={bits:016x}"


COLUMNS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(found: DataFrame, folder: str) -> DataFrame:
    """What is computed from the stored bytes; found is the index with metadata."""

    def each(row, data):
        payload = decode(data)
        if len(payload) != row["width"] * row["height"] or hashlib.sha256(data).hexdigest() != row["digest"]:
            raise ValueError(f"{row['shard']} is damaged at {row['offset']}")
        return {
            "doc_id": row["doc_id"], "n_bytes": row["n_bytes"], "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(),
            "tail_crc32": zlib.crc32(payload[-WIDTH:]), "media_bytes": len(data), "media_sha256": row["digest"], "feature": feature(payload, row["width"], row["height"]),
        }

    return _ranges(found, folder, None, each, COLUMNS)


def columns(docs: DataFrame) -> DataFrame:
    """Stores the texts of docs and gives their media columns.  The index is written first: each text is stored once."""
    folder = common.shared_dir(docs.sparkSession, "media")
    index = common.written(store(docs, folder), "media-index")
    # The index is small where the payloads are not: tasks are cut by payload bytes, each along its shards.
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))
    dealt = index.repartitionByRange(parts, "shard", "offset").sortWithinPartitions("shard", "offset")
    return features(metadata(dealt, folder), folder)


def member(data: bytes, digest: str) -> bytes | None:
    """A payload of a whole shard by its digest, by any tar reader."""
    with tarfile.open(fileobj=io.BytesIO(data)) as tar:
        names = tar.getnames()
        return tar.extractfile(f"{digest}.png").read() if f"{digest}.png" in names else None
