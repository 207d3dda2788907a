"""Byte-level helpers that the Arrow operators share, and where shared files go."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy block may hold; a longer single document is a block of its own.
BLOCK_BYTES = 2 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Words of letters, digits and everything outside ASCII; over lower-cased bytes.
WORD = np.zeros(256, dtype=bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True

#: Words between white space.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))


def lower_ascii(text) -> F.Column:
    """A-Z to a-z and nothing else; the built-in lower() serves texts that are all ASCII."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate tables, in the folder that the cluster shares."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, set on the context so that checkpoint() works.

    Only a local session, as in tests, gets a folder of its own where that is unset; a cluster must name a shared one.
    """
    context = spark.sparkContext
    at = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not context.getCheckpointDir():
        if not at and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        at = at or tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(at)
    return (at or context.getCheckpointDir()).rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a table in the shared folder: lineage ends there."""
    return Shelf(df.sparkSession).put(df, name)


class Shelf:
    """Intermediate tables of one call in the shared folder, by name; those that nothing reads any more are dropped."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, str] = {}

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df as the table `name` and reads it back; a table of that name before it is dropped after that."""
        path = shared_dir(self.spark, name)
        df.write.parquet(path)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def place(self, name: str) -> str:
        """A new folder for a table that the caller writes."""
        self.paths[name] = shared_dir(self.spark, name)
        return self.paths[name]

    def drop(self, *names: str) -> None:
        for name in names:
            if path := self.paths.pop(name, None):
                at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def arrow_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without copying; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, ends - ends[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with at most `limit` bytes of text each, so that numpy's temporaries stay small."""
    for batch in batches:
        _, ends = arrow_bytes(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def gathered(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Blocks of about `limit` bytes, joined from smaller batches too: shards of a suffix array."""
    held, size = [], 0
    for block in blocks(batches, column, limit):
        n = int(arrow_bytes(block.column(column))[1][-1])
        if held and size + n > limit:
            yield _joined(held)
            held, size = [], 0
        held.append(block)
        size += n
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE**i (or its inverse) modulo 2**64 for i < n."""
    key = "inverse" if inverse else "base"
    have = _powers.get(key)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), _INVERSE if inverse else _BASE, dtype=np.uint64)
        out[0] = 1
        have = np.multiply.accumulate(out)
        if n <= 4 * BLOCK_BYTES:
            _powers[key] = have
    return have[:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums: span_hashes reads the hash of any span from them."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * powers(len(data)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of bytes[start:end]; equal for equal bytes, wherever they stand."""
    h = prefix[ends] - prefix[starts]
    h *= powers(len(prefix), inverse=True)[starts]
    h += (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93)
    return mix(h)


def words(data: np.ndarray, ends: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, word starts, word ends, number of words of each document).

    kind: the table of bytes that words are made of.  Words never cross documents.
    """
    low = _LOWER[data]
    inside = kind[low]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cut = ends[1:-1]
    cut = cut[cut < len(data)]
    begins[cut] = inside[cut]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    last = cut[cut > 0] - 1
    stops[last] = inside[last]
    starts = np.flatnonzero(begins)
    return low, starts, np.flatnonzero(stops) + 1, np.diff(np.searchsorted(starts, ends))


def word_hashes(low: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    return span_hashes(prefix_hashes(low), starts, stops)


def ragged(counts: np.ndarray) -> np.ndarray:
    """0..n-1 for each count n, one after the other."""
    first = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) - np.repeat(first, counts)
