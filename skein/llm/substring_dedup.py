"""Exact-substring dedup: removes every byte that lies in a LENGTH-byte string which also starts earlier.

Suffix arrays of whole shards would have to meet pairwise, which grows with the square of the corpus.  So the text is first
narrowed, without loss, to what can repeat: of the grams in each LENGTH-byte window the one with the smallest hash is the
window's anchor, by content alone, so equal windows have equal anchors, and an anchor that stands once in the corpus has no
repeated window.  The surroundings of repeated anchors are dealt by anchor to content shards; all occurrences of a window
meet in one shard.

A shard's suffixes are sorted by Larsson-Sadakane refinement (8 bytes, then doubled ranks, tied groups only), Kasai's scan
gives the common prefixes of neighbours, and each run with a common prefix of LENGTH or more is one repeated string: all its
places but the first are removed.  An anchor with more surroundings than a shard holds gets several shards, which are merged
by binary search of one's strings in another's suffix array.  An anchor with more than SHARDS of them is worked off in parts,
so that a task holds one part; the first place of each distinct string of a part goes on, by the string's hash, to one
aggregation that finds the strings which several parts have.

Equal surroundings are sent once per task: a place with an earlier equal one in its own task is settled there.

Edge cases: null text counts as empty; texts shorter than LENGTH lose nothing.  A null doc_id is less than any other.  Rows
that repeat a doc_id count as the same place of the corpus, so equal rows are not copies of each other; a span is cut from a
row only if the row has the span's bytes there, so rows that share a doc_id but not a text keep what is their own.  Extra
columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm import common

LENGTH = 100
#: Bytes of an anchor's gram; a window has SPAN grams.
GRAM = 24
SPAN = LENGTH - GRAM + 1
#: Bytes of surroundings in a suffix array.
SHARD_BYTES = 1 << 20
#: Shards that a task holds at once.
SHARDS = 6

_U = np.uint64
_NULL = -(1 << 63)


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(positions, hashes, first, last): the grams that are the smallest of some window inside a document.

    The windows of an anchor start from `first` to `last`: the smallest gram only moves on as the window does.
    """
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    prefix = common.prefix_hashes(data)
    at = np.arange(n - GRAM + 1)
    hashes = common.span_hashes(prefix, at, at + GRAM)
    bits = max(22, n.bit_length())
    value = hashes >> _U(bits) << _U(bits)
    value |= at.astype(np.uint64)  # of equal hashes the leftmost
    m, size = value, 1
    while 2 * size <= SPAN:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    last = len(value) - SPAN + 1
    m = np.minimum(m[:last], m[SPAN - size : SPAN - size + last])
    inside = np.zeros(len(m) + 1, np.int64)
    full = np.diff(ends) >= LENGTH
    np.add.at(inside, ends[:-1][full], 1)
    np.add.at(inside, ends[1:][full] - LENGTH + 1, -1)
    start = np.flatnonzero(np.cumsum(inside)[:-1] > 0)
    of = (m[start] & _U((1 << bits) - 1)).astype(np.int64)
    opens = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
    closes = np.append(opens[1:], len(of)) - 1
    return of[opens], hashes[of[opens]], start[opens], start[closes] if len(of) else opens


def _doc(column: pa.Array) -> np.ndarray:
    return column.fill_null(_NULL).to_numpy(zero_copy_only=False)


def anchor_rows(docs: DataFrame) -> DataFrame:
    """deal, doc_id, at: every anchor of every document.

    An anchor that stands twice in one block is known to repeat: its `at` is written as -1 - at, and its rows but the first
    are dealt by hashes of their own instead of their key, so an anchor of very many documents is not one task's.
    """

    def run(batches):
        for block in common.blocks(batches, "text"):
            data, ends = common.arrow_bytes(block.column("text"))
            at, hashes, _, _ = anchors(data, ends)
            doc = np.searchsorted(ends, at, "right") - 1
            ids, at = _doc(block.column("doc_id"))[doc], at - ends[doc]
            _, first, of, counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
            known = counts[of] > 1
            deal = np.where(known, common.mix(ids.view(np.uint64) * _U(0x9E3779B97F4A7C15) + at.astype(np.uint64)), hashes)
            deal[first] = hashes[first]
            at = np.where(known, -1 - at, at).astype(np.int32)
            columns = [pa.array(deal.view(np.int64)), pa.array(ids), pa.array(at)]
            yield pa.RecordBatch.from_arrays(columns, ["deal", "doc_id", "at"])

    return docs.mapInArrow(run, "deal long, doc_id long, at int")


#: stop is 0 where the bytes around the anchor are given: their length tells it.  Else these are the 8 of the span's hash.
PLACES = "key long, around binary, doc_id long, start int, stop int"


def _row_batch(key, around, doc, start, stop) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(around, pa.binary()), pa.array(doc, pa.int64()), pa.array(start, pa.int32()), pa.array(stop, pa.int32())], ["key", "around", "doc_id", "start", "stop"])


def surroundings(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text, places (of repeated anchors).  The bytes around each, or no bytes where the span is settled."""

    def run(batches):
        seen: dict[tuple[int, int], tuple[int, int]] = {}
        for block in common.blocks(batches, "text"):
            data, ends = common.arrow_bytes(block.column("text"))
            places = block.column("places")
            counts = np.diff(places.offsets.to_numpy())
            at = places.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.repeat(np.arange(block.num_rows), counts)
            at = at + ends[:-1][doc]
            order = np.argsort(at, kind="stable")
            at, doc = at[order], doc[order]
            # Only the windows whose anchor it is: other windows around it belong to other anchors.
            own, _, first, last = anchors(data, ends)
            k = np.minimum(np.searchsorted(own, at), len(own) - 1) if len(own) else np.zeros(0, np.int64)
            ok = own[k] == at if len(own) else np.zeros(len(at), bool)
            at, doc, k = at[ok], doc[ok], k[ok] if len(own) else k
            low, high = first[k], last[k] + LENGTH
            prefix = common.prefix_hashes(data)
            left, right, key = (common.span_hashes(prefix, a, b) for a, b in ((low, at), (at, high), (at, at + GRAM)))
            ids = _doc(block.column("doc_id"))[doc]
            start, stop = low - ends[:-1][doc], high - ends[:-1][doc]
            raw, offset = data.tobytes(), ends[:-1][doc].tolist()
            out: tuple[list, ...] = ([], [], [], [], [])
            gone: tuple[list, ...] = ([], [], [], [])
            for k, (l, r, i, s, e, a, b) in enumerate(zip(left.tolist(), right.tolist(), ids.tolist(), start.tolist(), stop.tolist(), low.tolist(), high.tolist(), strict=True)):
                first = seen.get((l, r))
                if first is not None and first < (i, s):
                    if gone[0] and gone[0][-1] == i and gone[3][-1] == offset[k] and gone[2][-1] >= s:
                        gone[2][-1] = e
                    else:
                        for part, v in zip(gone, (i, s, e, offset[k]), strict=True):
                            part.append(v)
                    continue
                seen[l, r] = (i, s)
                for part, v in zip(out, (key[k].view(np.int64), raw[a:b], i, s, 0), strict=True):
                    part.append(v)
            yield _row_batch(*out)
            # Settled spans take part in the next exchange under keys of their own.
            ids_gone, s, e, o = (np.array(x, np.int64) for x in gone)
            check = [x.tobytes() for x in common.span_hashes(prefix, o + s, o + e)]
            yield _row_batch(common.mix(ids_gone.view(np.uint64) + _U(1)).view(np.int64), check, ids_gone, s, e)

    return docs.mapInArrow(run, PLACES)


def _words8(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as one number, in the order of bytes."""
    padded = np.concatenate([data, np.zeros(LENGTH + 16, np.uint8)])
    out = np.zeros(len(data) + LENGTH, np.uint64)
    for k in range(8):
        out <<= _U(8)
        out |= padded[k : k + len(out)]
    return out


def suffix_order(words: np.ndarray, base: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Starts of all LENGTH-byte strings of the pieces (base, size), sorted by these bytes.

    Larsson-Sadakane: a rank is the place of its group's first member; doubling the depth moves members of tied groups
    only.  Deep ranks are made for those positions alone from which a string that is wanted still needs them.
    """

    def positions(depth: int) -> np.ndarray:
        # A string's last rank of this depth is read at LENGTH - depth behind its start.
        n = np.maximum(size - depth + 1, 0)
        return np.repeat(base, n) + common.ragged(n)

    at = positions(8)
    order = at[np.argsort(words[at], kind="stable")]
    new = np.ones(len(order), bool)
    new[1:] = words[order[1:]] != words[order[:-1]]
    first = np.flatnonzero(new)
    rank = np.zeros(len(words), np.int64)
    rank[order] = np.repeat(first, np.diff(np.append(first, len(order))))
    depth = 8
    while depth < LENGTH:
        step = min(depth, LENGTH - depth)
        at = positions(depth + step)
        own = rank[at]
        tied = at[np.bincount(own, minlength=len(order) + 1)[own] > 1]
        own = rank[tied].astype(np.uint64) << _U(32) | rank[tied + step].astype(np.uint64)
        by = np.argsort(own, kind="stable")
        tied, own = tied[by], own[by]
        group = own >> _U(32)
        place = np.arange(len(tied))
        opens = np.ones(len(tied), bool)
        opens[1:] = group[1:] != group[:-1]
        splits = np.ones(len(tied), bool)
        splits[1:] = own[1:] != own[:-1]
        begin = np.maximum.accumulate(np.where(opens, place, 0))
        sub = np.maximum.accumulate(np.where(splits, place, 0))
        rank[tied] = group.astype(np.int64) + sub - begin
        depth += step
    at = positions(LENGTH)
    return at[np.argsort(rank[at], kind="stable")]


def kasai(words: np.ndarray, order: np.ndarray, base: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Common prefix of each string with the one before it in the order, up to LENGTH.

    Kasai's scan goes along the text and loses at most one byte of the common prefix a step; here all pieces are scanned in
    step, a vector at a time.
    """
    before = np.full(len(words) + 1, -1, np.int64)
    before[order[1:]] = order[:-1]
    place = np.full(len(words) + 1, -1, np.int64)
    place[order] = np.arange(len(order))
    out = np.zeros(len(words), np.int64)
    have, last = np.zeros(len(base), np.int64), np.full(len(base), -1, np.int64)
    strings = np.maximum(size - LENGTH + 1, 0)
    for s in range(int(strings.max(initial=0))):
        live = np.flatnonzero(strings > s)
        p = base[live] + s
        q = before[p]
        # The bound holds if the string behind the last neighbour is sorted too, and before this one: strings that are
        # equal over LENGTH bytes stand in any order, and those behind them may stand the other way round.
        behind = place[last[live] + 1]
        h = np.where((q >= 0) & (last[live] >= 0) & (behind >= 0) & (behind < place[p]), np.maximum(have[live] - 1, 0), 0)
        open_ = np.flatnonzero(q >= 0)
        while len(open_):
            x = words[p[open_] + h[open_]] ^ words[q[open_] + h[open_]]
            same = np.full(len(open_), 8)
            for k in range(8):
                same -= x >= _U(1 << 8 * k)
            h[open_] += same
            open_ = open_[(same == 8) & (h[open_] < LENGTH)]
        h = np.minimum(h, LENGTH)
        out[p] = h
        have[live], last[live] = h, q
    return out[order]


class Shard:
    """Pieces of text with their places, in suffix order."""

    def __init__(self, pieces: list[bytes], doc: np.ndarray, start: np.ndarray):
        size = np.array([len(p) for p in pieces], np.int64)
        self.base = np.cumsum(size) - size
        self.size, self.doc, self.start = size, doc, start
        self.data = np.frombuffer(b"".join(pieces), np.uint8)
        self.words = _words8(self.data)
        self.order = suffix_order(self.words, self.base, size)
        run = np.cumsum(kasai(self.words, self.order, self.base, size) < LENGTH)
        piece = np.searchsorted(self.base, self.order, "right") - 1
        at = start[piece] + self.order - self.base[piece]
        by = np.lexsort((at, doc[piece], run))
        opens = np.ones(len(by), bool)
        opens[1:] = run[by][1:] != run[by][:-1]
        first = by[np.flatnonzero(opens)[np.cumsum(opens) - 1]] if len(by) else by
        repeated = np.zeros(len(self.order), bool)
        repeated[by] = (doc[piece][by] != doc[piece][first]) | (at[by] != at[first])
        self.gone = np.zeros(len(self.data), bool)
        self.gone[self.order[repeated]] = True
        # One place for each distinct string, sorted: what other shards are searched for.
        heads = by[opens] if len(by) else by
        self.heads, self.head_doc, self.head_at = self.order[heads], doc[piece][heads], at[heads]

    def spans(self):
        """(doc, start, stop, hash of its bytes) of what is removed."""
        at = np.flatnonzero(self.gone)
        if not len(at):
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
        piece = np.searchsorted(self.base, at, "right") - 1
        opens = np.ones(len(at), bool)
        opens[1:] = (np.diff(at) > 1) | (piece[1:] != piece[:-1])
        first = np.flatnonzero(opens)
        last = np.append(first[1:], len(at)) - 1
        of = piece[first]
        check = common.span_hashes(common.prefix_hashes(self.data), at[first], at[last] + LENGTH)
        return self.doc[of], self.start[of] + at[first] - self.base[of], self.start[of] + at[last] - self.base[of] + LENGTH, check

    def firsts(self):
        """(doc, start, stop, hash, another hash) of the distinct strings that no shard has at an earlier place so far."""
        stay = ~self.gone[self.heads]
        at, doc, start = self.heads[stay], self.head_doc[stay], self.head_at[stay]
        other = np.zeros(len(at), np.uint64)
        for k in range(self._PARTS):
            other = common.mix(other ^ self.words[at + min(8 * k, LENGTH - 8)]) + _U(k)
        return doc, start, start + LENGTH, common.span_hashes(common.prefix_hashes(self.data), at, at + LENGTH), other

    _PARTS = -(-LENGTH // 8)

    def _string(self, at: np.ndarray) -> np.ndarray:
        """A row of numbers for each string, in the order of bytes."""
        steps = np.minimum(np.arange(self._PARTS) * 8, LENGTH - 8)
        return self.words[at[:, None] + steps[None, :]]

    def merge(self, other: Shard) -> None:
        """Binary-searches the other's distinct strings here; of two equal ones, the later place is removed."""
        n = len(other.heads)
        low, high = np.zeros(n, np.int64), np.full(n, len(self.heads), np.int64)
        want = other._string(other.heads)
        while len(open_ := np.flatnonzero(low < high)):
            middle = (low[open_] + high[open_]) // 2
            have = self._string(self.heads[middle])
            differs = have != want[open_]
            k = differs.argmax(axis=1)
            rows = np.arange(len(open_))
            less = differs[rows, k] & (have[rows, k] < want[open_][rows, k])
            low[open_[less]] = middle[less] + 1
            high[open_[~less]] = middle[~less]
        inside = np.flatnonzero(low < len(self.heads))
        equal = inside[(self._string(self.heads[low[inside]]) == want[inside]).all(axis=1)]
        mine = low[equal]
        a, b = (self.head_doc[mine], self.head_at[mine]), (other.head_doc[equal], other.head_at[equal])
        later = (a[0] > b[0]) | ((a[0] == b[0]) & (a[1] > b[1]))
        earlier = (a[0] < b[0]) | ((a[0] == b[0]) & (a[1] < b[1]))
        self.gone[self.heads[mine[later]]] = True
        other.gone[other.heads[equal[earlier]]] = True


def _settle(rows: list[tuple[bytes, int, int]], limit: int) -> list[Shard]:
    """Shards of distinct surroundings (bytes, doc, start) of one or more anchors, merged with each other."""
    number = (np.cumsum([len(r[0]) for r in rows]) - 1) // limit
    shards = []
    for k in np.unique(number).tolist():
        own = rows[np.searchsorted(number, k) : np.searchsorted(number, k, "right")]
        shards.append(Shard([r[0] for r in own], np.array([r[1] for r in own], np.int64), np.array([r[2] for r in own], np.int64)))
        for other in shards[:-1]:
            other.merge(shards[-1])
    return shards


#: A span to remove; where `other` is set, the first place of a string in one part of an anchor instead.
SPANS = "doc_id long, start long, stop long, check long, other long"


def _span_batch(doc, start, stop, check, other=None) -> pa.RecordBatch:
    columns = [pa.array(x, pa.int64()) for x in (doc, start, stop)] + [pa.array(np.asarray(check, np.uint64).view(np.int64))]
    columns.append(pa.nulls(len(columns[0]), pa.int64()) if other is None else pa.array(other.view(np.int64)))
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "stop", "check", "other"])


def removed(places: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """SPANS from the places dealt by anchor."""

    def run(batches):
        held: list[tuple[bytes, int, int]] = []  # of whole anchors with several distinct surroundings
        own: list[tuple[bytes, int, int]] = []  # of the anchor that is being read
        held_size = own_size = 0
        key = around = first = None
        parts = False  # whether part of this anchor is done

        def flush(rows, part=False):
            for shard in _settle(rows, limit) if rows else ():
                yield _span_batch(*shard.spans())
                if part:
                    yield _span_batch(*shard.firsts())

        def close():
            """The end of an anchor: it waits for others, unless it has several parts."""
            nonlocal held, own, held_size, own_size
            if parts:
                yield from flush(own, True)
            elif len(own) > 1:
                if held_size + own_size > limit:
                    yield from flush(held)
                    held, held_size = [], 0
                held, held_size = held + own, held_size + own_size
            own, own_size = [], 0

        for batch in batches:
            gone: tuple[list, ...] = ([], [], [], [])
            data, ends = common.arrow_bytes(batch.column(1))
            checks = common.span_hashes(common.prefix_hashes(data), ends[:-1], ends[1:])
            for k, a, d, s, e, check in zip(*[c.to_pylist() for c in batch.columns], checks.tolist(), strict=True):
                if e or (k == key and a == around):
                    if e or first != (d, s):
                        for part, v in zip(gone, (d, s, e or s + len(a), int.from_bytes(a, "little") if e else check), strict=True):
                            part.append(v)
                    continue
                if k != key:
                    yield from close()
                    parts = False
                elif own_size > SHARDS * limit:
                    yield from flush(own, True)
                    own, own_size, parts = [], 0, True
                key, around, first = k, a, (d, s)
                own.append((a, d, s))
                own_size += len(a)
            yield _span_batch(*gone[:3], np.array(gone[3], np.uint64))
        yield from close()
        yield from flush(held)

    return places.mapInArrow(run, SPANS)


def _across(found: DataFrame) -> DataFrame:
    """The spans to remove: of strings that several parts of an anchor have, all but the first place.

    A string has one row for each part, so such groups are small; spans are dealt by their places and pass.
    """
    deal = F.when(F.col("other").isNull(), F.xxhash64("doc_id", "start")).otherwise(F.xxhash64("check", "other"))
    place = F.struct("doc_id", "start")
    first = F.min(place).over(Window.partitionBy("deal", "check", "other"))
    dealt = found.withColumn("deal", deal).repartition("deal").withColumn("first", first)
    return dealt.where(F.col("other").isNull() | (place > F.col("first"))).select("doc_id", "start", "stop", "check")


REPORT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _valid(spans: pa.ListArray, data: np.ndarray, ends: np.ndarray) -> list[list[tuple[int, int]]]:
    """The spans (start, stop) of each text, in order, whose bytes stand there."""
    counts = np.array([len(x) if x.is_valid else 0 for x in spans], np.int64)
    flat = spans.flatten()
    start, stop, check = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
    doc = np.repeat(np.arange(len(counts)), counts)
    low, high = start + ends[:-1][doc], stop + ends[:-1][doc]
    inside = np.flatnonzero(high <= ends[1:][doc])
    right = inside[common.span_hashes(common.prefix_hashes(data), low[inside], high[inside]).view(np.int64) == check[inside]]
    right = right[np.lexsort((stop[right], start[right], doc[right]))]
    cuts = np.searchsorted(doc[right], np.arange(len(counts) + 1)).tolist()
    pairs = list(zip(start[right].tolist(), stop[right].tolist(), strict=True))
    return [pairs[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _cut(source: DataFrame, text: bool) -> DataFrame:
    """source: doc_id, text, spans.  The report, or doc_id and the bytes that are left."""

    def run(batches):
        for block in common.blocks(batches, "text"):
            data, ends = common.arrow_bytes(block.column("text"))
            rows = []
            for spans, a, b in zip(_valid(block.column("spans"), data, ends), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                own, runs, at, kept = data[a:b].tobytes(), 0, 0, []
                last = -1
                for s, e in spans:
                    if s > last:
                        runs += 1
                        kept.append(own[at:s])
                    at = last = max(last, e)
                kept.append(own[at:])
                rest = b"".join(kept)
                rows.append((b - a, b - a - len(rest), runs, rest if text else hashlib.sha256(rest).hexdigest()))
            kind = pa.binary() if text else pa.string()
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), kind), strict=True)]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept" if text else "kept_sha256"])

    return source.mapInArrow(run, REPORT.replace("kept_sha256 string", "kept binary") if text else REPORT)


def dedup(docs: DataFrame, text: bool = True) -> DataFrame:
    """One row for each row of docs (doc_id, text): n_bytes, n_removed, n_spans and the kept bytes (or their digest)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    key = F.coalesce("doc_id", F.lit(_NULL).cast("long"))
    rows = anchor_rows(docs)
    # Anchors that stand twice in a block are dealt by their places, so a group has one row a block at most.
    at = rows.withColumn("n", F.count("*").over(Window.partitionBy("deal"))).where("at < 0 or n > 1")
    at = at.withColumn("at", F.when(F.col("at") < 0, -1 - F.col("at")).otherwise(F.col("at"))).groupBy(F.col("doc_id").alias("of")).agg(F.collect_list("at").alias("places"))
    places = surroundings(docs.join(at, key == F.col("of")).select("doc_id", "text", "places"))
    dealt = places.repartition("key").sortWithinPartitions("key", "around", "doc_id", "start")
    spans = _across(removed(dealt)).groupBy(F.col("doc_id").alias("of")).agg(F.collect_list(F.struct("start", "stop", "check")).alias("spans"))
    return _cut(docs.join(spans, key == F.col("of"), "left").select("doc_id", "text", "spans"), text)


def report(docs: DataFrame) -> DataFrame:
    return dedup(docs, text=False)
