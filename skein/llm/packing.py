"""Best-fit packing of token pieces into sequences, by Martello-Toth reduction on the histogram of lengths.

A sequence holds CAPACITY tokens, so there are at most CAPACITY lengths, and the whole instance is a histogram: a few
thousand counts, however many documents there are.  The driver reduces and solves the histogram.  Pieces take their places
by rank among the pieces of their length; ranks are counted in salted groups of about RANKED pieces, so that a length which
very many pieces share is no single task's.

Reduction: each length x is examined in turn, from the longest.  A piece x is fixed for good alone, with the longest y that
fits beside it, or with a pair that fills the sequence, if that set dominates every other set with x: if y fills the rest, or
three pieces never fit beside x and no pair outweighs y, or no single piece or pair can't be exchanged for parts of the pair.
Fixed pieces shrink the instance, and lengths are examined again until a pass fixes nothing.  What is left is packed best-fit, the
longest first.  Fixing costs no optimum but may leave best fit a worse rest, so plain best fit is tried too and the better kept.

Edge cases: null or empty text is the end id alone.  Rows that repeat a doc_id are packed each; ranks also order by the text's hash.
Null doc_id stays null.  Extra columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm import common

CAPACITY = 4096
#: The id after the last token of each document.
END = 1
#: Pieces of one length that are ranked in one group.
RANKED = 4_000
#: Tokenised pieces of text of one generation; a worker remembers two.
MEMORY = 700_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Ids of a text.  No token crosses white space, so texts are encoded by pieces between it, and each piece once."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.stops = {c: self._whole([c])[0] for c in (".", ",", "")}
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        split = [t.replace("\n", " ").split(" ") for t in texts]
        here = set().union(*split)
        new = here.difference(self.known)
        if len(self.known) + len(new) > MEMORY:  # two generations: what is still used moves to the new one
            self.old, self.known, new = self.known, {}, here
        if self.old:
            again = new.intersection(self.old)
            self.known.update(zip(again, map(self.old.__getitem__, again), strict=True))
            new = new.difference(again)
        self._learn(new)
        look = self.known.__getitem__
        return [b"".join(map(look, ws)) for ws in split]

    def _whole(self, some: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(some, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _learn(self, new: set[str]) -> None:
        """Letters of Latin-1, perhaps with a full stop or comma behind, go straight to the tokenizer's merges.

        For these all that comes before the merges is known: they are normal already, lower case changes them one by one,
        and they are a single run.
        """
        merge, known, other = self.tokenizer.model.tokenize, self.known, []
        for w in new:
            stop = w[-1:] if w[-1:] in (".", ",") else ""
            core = w[:-1] if stop else w
            if _LATIN(core):
                core = core.lower()
                ids = [t.id for t in merge(core if core.isascii() else core.translate(_LETTERS))]
                known[w] = struct.pack(f"<{len(ids)}I", *ids) + self.stops[stop]
            else:
                other.append(w)
        for at in range(0, len(other), 10_000):
            known.update(zip(other[at : at + 10_000], self._whole(other[at : at + 10_000]), strict=True))


#: Letters of Latin-1, and how byte-level vocabularies write the bytes of those outside ASCII: bytes that print as
#: themselves stand for themselves, the others take the code points from 256 on in their order.
_LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_HIDDEN = [b for b in range(256) if b not in _SHOWN]
_BYTES = {b: chr(b) for b in _SHOWN} | {b: chr(256 + k) for k, b in enumerate(_HIDDEN)}
_LETTERS = {c: "".join(_BYTES[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}

_encoders: dict[str, Encoder] = {}


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for each piece of each document (doc_id, text)."""
    end = np.array([END], "<u4").tobytes()

    def run(batches):
        if tokenizer not in _encoders:
            _encoders[tokenizer] = Encoder(tokenizer)
        encoder = _encoders[tokenizer]
        for block in common.blocks(batches, "text", 4 << 20):
            rows = []
            for doc, text, ids in zip(block.column("doc_id").to_pylist(), texts := [t or "" for t in block.column("text").to_pylist()], encoder.ids(texts), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


Places = list[tuple[int, int, int, int, int, int]]


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[Places, int]:
    """Places for the pieces of each length, and the number of sequences.

    A place is (length, first rank, ranks, first sequence, pieces in each sequence, offset of the first piece there):
    the pieces with these ranks go to sequences first, first + 1, ..., so many in each, one after the other.
    """
    return min((_solve(histogram, capacity, reduced) for reduced in (True, False)), key=lambda found: found[1])


def _dominating(x: int, lengths: list[int], left: dict[int, int], capacity: int) -> tuple[int, ...] | None:
    """The pieces to fix beside one of length x, none of them longer than the rest; None if no set dominates."""
    room = capacity - x

    def many(n: int) -> int:
        return left[n] - (n == x)

    fits = [n for n in lengths[: bisect.bisect_right(lengths, room)] if many(n)]
    if not fits:
        return ()
    y = fits[-1]
    least = [n for n in fits[:3] for _ in range(min(3, many(n)))][:3]
    if y == room or sum(least[:2]) > room or len(least) < 2:
        return (y,)
    if len(least) == 3 and sum(least) <= room:
        return None
    # Two pieces fit, three don't: the heaviest pair (a, b).
    sizes = np.array(fits)
    other = np.searchsorted(sizes, room - sizes, "right") - 1
    ok = (other >= 0) & (sizes >= sizes[np.maximum(other, 0)])
    ok &= (sizes != sizes[np.maximum(other, 0)]) | np.array([many(n) > 1 for n in fits])
    # Of a length that stands once, the next shorter one is the partner.
    lone = (other >= 0) & (sizes == sizes[np.maximum(other, 0)]) & ~ok
    other = np.where(lone, other - 1, other)
    ok |= lone & (other >= 0)
    if not ok.any():
        return (y,)
    pair = np.where(ok, sizes + sizes[np.maximum(other, 0)], 0)
    best = int(pair.max())
    if y >= best:
        return (y,)
    if best == room:
        for a, b in ((fits[i], fits[other[i]]) for i in np.flatnonzero(pair == best)):
            # A pair between them would be heavier than b in its lighter piece: then neither set can stand for the other.
            between = [n for n in fits if b < n < a]
            if a == y and (not between or 2 * between[0] > room):
                return (a, b)
    return None


def _solve(histogram: dict[int, int], capacity: int, reduced: bool) -> tuple[Places, int]:
    left = {n: c for n, c in histogram.items() if c}
    lengths = sorted(left)
    used: dict[int, int] = dict.fromkeys(left, 0)
    places: Places = []
    sequences = 0

    def take(length: int, count: int) -> int:
        first = used[length]
        used[length] += count
        left[length] -= count
        if not left[length]:
            lengths.remove(length)
        return first

    fixed = reduced
    while fixed:
        fixed = False
        for x in sorted(lengths, reverse=True):
            while left[x] and (beside := _dominating(x, lengths, left, capacity)) is not None:
                whole = (x, *beside)
                n = min(left[v] // whole.count(v) for v in whole)
                if not beside and 2 * x <= capacity:
                    n = 1
                at = 0
                for v in dict.fromkeys(whole):
                    per = whole.count(v)
                    places.append((v, take(v, n * per), n * per, sequences, per, at))
                    at += per * v
                sequences += n
                fixed = True

    # Best fit for the rest: open sequences with equal room stand together as (first sequence, number).
    open_: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []

    def put_back(room: int, first: int, count: int) -> None:
        if room and count:
            if room not in open_:
                bisect.insort(rooms, room)
                open_[room] = []
            open_[room].append((first, count))

    while lengths:
        x = lengths[-1]
        k = bisect.bisect_left(rooms, x)
        if k == len(rooms):
            per = capacity // x
            n = max(1, left[x] // per)
            per = min(per, left[x])
            first_room = capacity
            first_sequence, sequences = sequences, sequences + n
        else:
            first_room = rooms[k]
            first_sequence, n = open_[first_room].pop()
            if not open_[first_room]:
                del open_[first_room]
                rooms.pop(k)
            per = first_room // x
            if left[x] < per:
                per = left[x]
            fit = min(n, left[x] // per)
            put_back(first_room, first_sequence + fit, n - fit)
            n = fit
        places.append((x, take(x, n * per), n * per, first_sequence, per, capacity - first_room))
        put_back(first_room - per * x, first_sequence, n)
    return places, sequences


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """found: a written table of pieces.  Adds sequence_id and offset."""
    spark = found.sparkSession
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # CAPACITY rows at most
    places, _ = solve(histogram, capacity)
    groups = F.broadcast(spark.createDataFrame([(n, -(-c // RANKED)) for n, c in histogram.items()], "length long, groups long"))
    salted = found.join(groups, "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.col("groups"))).drop("groups")
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("before", before).drop("n")
    schema = "of long, first long, ranks long, sequence long, per long, room long"
    table = F.broadcast(spark.createDataFrame(places, schema))  # a few places for each length
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(starts, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    inside = (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("ranks"))
    placed = ranked.join(table, (F.col("length") == F.col("of")) & inside)
    at = F.col("rank") - F.col("first")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.floor(at / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("room") + F.pmod(at, F.col("per")) * F.col("length")).cast("long").alias("offset"),
    )


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of docs with its place.  The pieces are written first: the text is tokenised once."""
    return pack(common.written(pieces(docs, tokenizer, capacity), "pieces"), capacity)
