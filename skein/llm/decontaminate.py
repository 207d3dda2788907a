"""Benchmark decontamination by suffix arrays of the training text.

Each task turns its documents into shards of a few MB of words, sorts the shard's word suffixes by Larsson-Sadakane
refinement, and binary-searches every suffix of every benchmark item in it, by its first WINDOW words.  Hits that go on along
an item and a document together are one verbatim match; `matches` gives the longest of each document and item with its
places.  A shard holds whole documents, so all that is known of a document is known in one task: nothing is shuffled.

A benchmark of more than BLOCK_WORDS words is dealt to blocks by item; each block is searched in a scan of its own, and only
what it hits is merged by document.

Edge cases: a null or empty text has no words and is never contaminated.  An item without words has no window; null items
are skipped.  Items with equal texts all count; an item of very many words is a block of its own.  Repeated documents are
judged row by row.  Other columns of the input are ignored by `report` and `matches`, and kept by `clean`.  Empty tables give
empty results.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import common

#: Words of a window.
WINDOW = 13
#: A document is contaminated if 1 / SHARE of its words are hit, or more.
SHARE = 20
#: Bytes of training text in a suffix array.
SHARD_BYTES = 4 << 20
#: Words of benchmark text that are sent to the executors at once, at some 60 bytes each.
BLOCK_WORDS = 1 << 20

REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long"
MATCHES = "doc_id long, item_id long, doc_word long, item_word long, n_words long"


def suffix_order(tokens: np.ndarray, at: np.ndarray, depth: int, width: int) -> np.ndarray:
    """Positions `at` sorted by the `depth` tokens that follow each.

    The first keys hold as many tokens as fit in 64 bits; then each round doubles the sorted depth by the ranks of the
    suffixes that stand as many tokens further, and only groups that are still tied are sorted again.  Positions outside
    `at` rank by their own first tokens, which is enough: `at` holds every suffix that can matter.
    """
    per = 64 // width
    padded = np.concatenate([tokens, np.zeros(2 * depth + per, np.uint64)])
    key = np.zeros(len(tokens) + depth, np.uint64)
    for i in range(per):
        key <<= np.uint64(width)
        key |= padded[i : i + len(key)]
    order = at[np.argsort(key[at], kind="stable")]
    rank = np.zeros(len(key), np.int64)
    keys = key[order]
    group = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(order) else np.zeros(0, bool)
    done = per
    while done < depth and len(order):
        number = np.cumsum(group)
        tied = np.flatnonzero(np.bincount(number)[number] > 1)
        if not len(tied):
            break
        rank[order] = 2 * number
        further = order[tied] + done
        second = rank[further]
        # A suffix outside `at` soon has a 0, so it ties with none inside; it stands between those by its first tokens.
        if len(out := np.flatnonzero(second == 0)):
            before = np.searchsorted(keys, key[further[out]], "left")
            second[out] = 2 * np.where(before > 0, number[before - 1], 0) + 1
        again = np.lexsort((second, number[tied]))
        order[tied] = order[tied[again]]
        second, of = second[again], number[tied]
        split = np.zeros(len(tied), bool)
        split[1:] = (second[1:] != second[:-1]) & (of[1:] == of[:-1])
        group[tied] |= split
        done *= 2
    return order


class Benchmark:
    """The items as one array of word numbers, 0 behind each; its windows, and where each distinct one stands."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW):
        data = pa.array([t or "" for _, t in items], pa.string())
        low, starts, stops, counts = common.words(*common.arrow_bytes(data), common.WORD)
        self.vocabulary, numbers = np.unique(common.word_hashes(low, starts, stops), return_inverse=True)
        item = np.repeat(np.arange(len(items)), counts)
        self.text = np.zeros(len(numbers) + len(items) + window, np.uint64)
        self.text[np.arange(len(numbers)) + item] = numbers + 1
        size = np.minimum(counts, window)
        many = np.where(counts > 0, counts - size + 1, 0)
        begin = np.cumsum(counts + 1) - counts - 1
        at = np.repeat(begin, many) + common.ragged(many)
        length = np.repeat(size, many)
        # Equal windows are searched once.
        spans = common.span_hashes(common.prefix_hashes(self.text), at, at + length)
        _, first, kind = np.unique(spans, return_index=True, return_inverse=True)
        self.at, self.lengths = at[first], length[first]
        by = np.argsort(kind, kind="stable")
        self.ids = np.array([i for i, _ in items], np.int64)
        self.owner = np.repeat(np.arange(len(items)), many)[by]
        self.owner_at = common.ragged(many)[by]
        self.owner_ends = np.searchsorted(kind[by], np.arange(len(first) + 1))
        self.window = window
        self.width = 16 if len(self.vocabulary) < (1 << 16) - 1 else 32

    def tokens(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.uint64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0).astype(np.uint64)

    def find(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, position) of every occurrence, by binary search in the shard's suffix array."""
        none = np.zeros(0, np.int64)
        if not len(self.at) or not len(tokens):
            return none, none
        least = int(min(64 // self.width, self.lengths.min()))
        padded = np.concatenate([tokens, np.zeros(self.window, np.uint64)])
        may = np.ones(len(tokens), bool)
        for i in range(least):  # a suffix that soon has a word that no item has matches no window
            may &= padded[i : i + len(tokens)] > 0
        order = suffix_order(tokens, np.flatnonzero(may), self.window, self.width)
        if not len(order):
            return none, none
        which, where = [none], [none]
        for a in range(0, len(self.at), 1 << 16):
            some = slice(a, a + (1 << 16))
            low, high = (self._bound(padded, order, some, after) for after in (False, True))
            found = np.flatnonzero(high > low)
            counts = (high - low)[found]
            which.append(np.repeat(found + a, counts))
            where.append(order[np.repeat(low[found], counts) + common.ragged(counts)])
        return np.concatenate(which), np.concatenate(where)

    def _bound(self, padded: np.ndarray, order: np.ndarray, some: slice, after: bool) -> np.ndarray:
        """For some windows the first suffix that is not less than it, or that is greater than all it is a prefix of."""
        at, lengths = self.at[some], self.lengths[some]
        n = len(at)
        low, high = np.zeros(n, np.int64), np.full(n, len(order), np.int64)
        span = np.arange(self.window)
        inside = span[None, :] < lengths[:, None]
        windows = self.text[at[:, None] + span[None, :]]
        while len(open_ := np.flatnonzero(low < high)):
            middle = (low[open_] + high[open_]) // 2
            suffix = padded[order[middle][:, None] + span[None, :]]
            query = windows[open_]
            differs = (suffix != query) & inside[open_]
            at = differs.argmax(axis=1)
            rows = np.arange(len(open_))
            equal = ~differs[rows, at]
            less = np.where(equal, after, suffix[rows, at] < query[rows, at])
            low[open_[less]] = middle[less] + 1
            high[open_[~less]] = middle[~less]
        return low


    def along(self, which: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, ...]:
        """(position, item, place in the item, words) of verbatim matches that can't be made longer.

        `where` rises.  Windows that follow each other in text and item alike are one match: a match goes on while its next
        window is found at the next position.
        """
        ended: list[tuple[np.ndarray, ...]] = []
        before, runs, last = np.zeros(0, np.int64), np.zeros(0, np.int64), -2

        def end(stay: np.ndarray) -> None:
            code, run = before[~stay], runs[~stay]
            ended.append((last - run + 1, code >> 32, (code & 0xFFFFFFFF) - run + 1, run + self.window - 1))

        full = self.lengths[which] == self.window
        for w, p in zip(which[full].tolist(), where[full].tolist(), strict=True):
            own = slice(self.owner_ends[w], self.owner_ends[w + 1])
            now = self.owner[own] << 32 | self.owner_at[own]
            if p == last + 1:
                place = np.minimum(np.searchsorted(now, before + 1), len(now) - 1)
                stay = now[place] == before + 1
                grown = np.ones(len(now), np.int64)
                grown[place[stay]] += runs[stay]
            else:
                stay, grown = np.zeros(len(before), bool), np.ones(len(now), np.int64)
            end(stay)
            before, runs, last = now, grown, p
        end(np.zeros(len(before), bool))
        for w, p in zip(which[~full].tolist(), where[~full].tolist(), strict=True):  # whole short items
            own = slice(self.owner_ends[w], self.owner_ends[w + 1])
            n = self.owner_ends[w + 1] - self.owner_ends[w]
            ended.append((np.full(n, p), self.owner[own], np.zeros(n, np.int64), np.full(n, self.lengths[w])))
        return tuple(np.concatenate(x) for x in zip(*ended, strict=True))


class Hits:
    """What the items hit in the documents of one shard."""

    def __init__(self, block: pa.RecordBatch, bench: Benchmark):
        low, starts, stops, self.counts = common.words(*common.arrow_bytes(block.column("text")), common.WORD)
        numbers = bench.tokens(common.word_hashes(low, starts, stops))
        doc = np.repeat(np.arange(len(self.counts)), self.counts)
        slots = np.arange(len(numbers)) + doc  # one empty slot after each document: no match crosses it
        tokens = np.zeros(len(numbers) + len(self.counts), np.uint64)
        tokens[slots] = numbers
        which, where = bench.find(tokens)
        by = np.argsort(where, kind="stable")
        self.which, self.where, self.bench = which[by], where[by], bench
        cover = np.zeros(len(tokens) + 1, np.int64)
        np.add.at(cover, where, 1)
        np.add.at(cover, where + bench.lengths[which], -1)
        self.hit = np.cumsum(cover)[:-1][slots] > 0
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.n_hit = np.diff(np.concatenate([[0], np.cumsum(self.hit)])[self.first])

    def matches(self) -> np.ndarray:
        """Rows (document, item, word of the document, word of the item, words): the longest match of each two, the first of equals."""
        at, item, place, size = self.bench.along(self.which, self.where)
        begin = self.first[:-1] + np.arange(len(self.counts))
        doc = np.searchsorted(begin, at, "right") - 1
        by = np.lexsort((place, at, -size, item, doc))
        doc, item = doc[by], item[by]
        new = np.ones(len(by), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
        return np.stack([doc, self.bench.ids[item], (at[by] - begin[doc]), place[by], size[by]], axis=1)[new] if len(by) else np.zeros((0, 5), np.int64)

    def runs(self, doc: int) -> list[tuple[int, int]]:
        """Runs of hit words of one document."""
        own = self.hit[self.first[doc] : self.first[doc + 1]].astype(np.int8)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], own, [0]]))).tolist()
        return list(zip(edges[::2], edges[1::2], strict=True))


def _blocks(benchmark: DataFrame, limit: int) -> list[DataFrame]:
    """Blocks of items; the benchmark's words are counted before any of it is collected."""
    items = benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("long"), "text")
    size = items.agg(F.coalesce(F.sum(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")) + 1), F.lit(0))).first()[0]
    parts = -(-size // (limit // 2)) if size > limit else 1
    return [items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k) for k in range(parts)]


def _sent(part: DataFrame, window: int):
    return part.sparkSession.sparkContext.broadcast(Benchmark([tuple(r) for r in part.collect()], window))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_hash"), "text")


def _digest(items) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = BLOCK_WORDS) -> DataFrame:
    """One row for each row of docs (doc_id, text): words, words inside windows of items, items, verdict, longest match."""
    parts = _blocks(benchmark, limit)
    if len(parts) > 1:
        return _merged(docs, parts, window).drop("row_hash")
    shared = _sent(parts[0], window)

    def run(batches):
        for block in common.gathered(batches, "text", SHARD_BYTES):
            hits = Hits(block, shared.value)
            found = hits.matches()
            ends = np.searchsorted(found[:, 0], np.arange(block.num_rows + 1))
            n_items = np.diff(ends)
            longest = np.zeros(block.num_rows, np.int64)
            np.maximum.at(longest, found[:, 0], found[:, 4])
            none = _digest(())
            digests = [_digest(found[a:b, 1].tolist()) if b > a else none for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            dirty = (hits.n_hit > 0) & (SHARE * hits.n_hit >= hits.counts)
            columns = [block.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in (hits.counts, hits.n_hit, n_items)), pa.array(digests), pa.array(dirty), pa.array(longest)]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in REPORT.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, REPORT)


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = BLOCK_WORDS) -> DataFrame:
    """MATCHES: the longest verbatim match of each document and item that share a window, and where it stands in both."""

    def run(shared):
        def of(batches):
            for block in common.gathered(batches, "text", SHARD_BYTES):
                found = Hits(block, shared.value).matches()
                columns = [block.column("doc_id").take(pa.array(found[:, 0])), *(pa.array(found[:, k]) for k in range(1, 5))]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in MATCHES.split(", ")])

        return of

    each = [_rows(docs).select("doc_id", "text").mapInArrow(run(_sent(part, window)), MATCHES) for part in _blocks(benchmark, limit)]
    return reduce(DataFrame.unionByName, each)


FOUND = "doc_id long, row_hash long, n_words long, runs array<struct<start:int,stop:int>>, items array<long>, longest long"


def _found(shared, every: bool):
    """Rows of documents that a block hits; the first block gives every document."""

    def run(batches):
        for block in common.gathered(batches, "text", SHARD_BYTES):
            hits = Hits(block, shared.value)
            found = hits.matches()
            ends = np.searchsorted(found[:, 0], np.arange(block.num_rows + 1))
            rows = np.arange(block.num_rows) if every else np.flatnonzero(hits.n_hit)
            some = block.take(pa.array(rows))
            runs = [[{"start": a, "stop": b} for a, b in hits.runs(i)] for i in rows.tolist()]
            own = [found[ends[i] : ends[i + 1]] for i in rows.tolist()]
            columns = [some.column("doc_id"), some.column("row_hash"), pa.array(hits.counts[rows].astype(np.int64))]
            columns += [pa.array(runs, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), pa.array([x[:, 1].tolist() for x in own], pa.list_(pa.int64()))]
            columns.append(pa.array([int(x[:, 4].max(initial=0)) for x in own], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row_hash", "n_words", "runs", "items", "longest"])

    return run


def _merged(docs: DataFrame, parts: list[DataFrame], window: int) -> DataFrame:
    """The report and row_hash over several blocks: one scan for each, whose hits meet by document."""
    each = [_rows(docs).mapInArrow(_found(_sent(part, window), not k), FOUND).withColumn("copies", F.lit(int(not k))) for k, part in enumerate(parts)]
    rows = reduce(DataFrame.unionByName, each).groupBy("doc_id", "row_hash").agg(
        F.sum("copies").alias("copies"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("runs")).alias("runs"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.max("longest").alias("longest_match"),
    )
    # Words up to `stop` are counted; a run adds what lies beyond.
    step = lambda at, x: F.struct(
        F.greatest(at["stop"], x["stop"]).alias("stop"), (at["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(at["stop"], x["start"]))).alias("n")
    )
    n_hit = F.aggregate(F.array_sort("runs"), F.struct(F.lit(0).alias("stop"), F.lit(0).alias("n")), step, lambda at: at["n"]).cast("long")
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    rows = rows.withColumn("n_hit", n_hit).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "longest_match", "row_hash",
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns; one pass without a join, if there is one block.

    Only the share of hit words counts, and blocks can hit different words of a document, so with several blocks the
    verdicts come from the merged report and drop documents by a join.
    """
    parts = _blocks(benchmark, limit)
    if len(parts) > 1:
        gone = _merged(docs, parts, window).where("contaminated").select(F.col("doc_id").alias("gone"), F.col("row_hash").alias("gone_hash")).distinct()
        return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone"]) & (F.xxhash64(docs["text"]) == gone["gone_hash"]), "left_anti")
    shared = _sent(parts[0], window)

    def run(batches):
        for block in common.gathered(batches, "text", SHARD_BYTES):
            hits = Hits(block, shared.value)
            yield block.filter(pa.array((hits.n_hit == 0) | (SHARE * hits.n_hit < hits.counts)))

    return docs.mapInArrow(run, docs.schema)
