"""Quality rules: counts of a text's own repeats and symbols, and bands of n-gram perplexity for each language.

The model is a modified Kneser-Ney model of characters, of order ORDER, for each language.  A text is read as its words with
one space between, before and after them.  Spark counts the longest n-grams over all documents; every shorter n-gram's count
is the number of different characters before it, so it comes from the longer ones by an aggregation.  Three discounts for
each order (by counts of counts), the weight that they leave to the shorter n-grams, and interpolated probabilities are
joins of these tables.  What a task needs is a sorted array of 64-bit hashes with log probabilities beside it, by language,
with an index over the leading bits.

Documents are dealt to two halves by their id, and each is scored by the model of the other half: by a model that had read
it, a text that resembles no other would be the least surprising of all.

A document's score is its surprise in nats for each character, in whole thousandths.  Quartiles of all scores of a language,
exact by counts of each value, give its bands: BAND times the distance of the quartiles beyond them, and for short texts
SHORT / sqrt(characters) more, as their scores scatter.  Outside the bands a document is rejected.

A model of at most MODEL_ROWS entries is sent to the tasks.  A larger one is sent in parts of as many entries, by languages and
halves, each of which scores its own documents in a scan of its own.  Where one language's model alone is larger, the model stays
a table that the n-grams of documents are joined with, order by order, which shuffles them.  Log probabilities are whole numbers of 1 / SCALE: sums don't depend on their order.

Edge cases: null or empty text, and text without words, has counts of 0, no score and fails the base rules.  A text of
fewer than ORDER characters has no score and is judged by the base rules alone.  Rows that repeat a doc_id are judged each
by their own text, and all count.  A null doc_id belongs to the first half; a null language, or none in the table, is a
language of its own.  Where one half has no text of a language, all texts of the other half score the same.  Other columns
are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm import common

#: Characters of the longest n-gram.
ORDER = 4
#: Bytes of text that are worked off at once.
BLOCK = 1 << 20
#: Steps of a log probability in one unit.
SCALE = 1 << 16
#: Entries of a model that is sent to tasks at most.
MODEL_ROWS = 8_000_000
#: Languages, with their halves, whose sizes and bands are gathered at most.
LANGUAGES = 10_000
#: Distance of the bands from the quartiles, in distances of the quartiles; nats more for a text of one character.
BAND = 3.0
SHORT = 6.0

#: Base rules: words that a document has at least, and the share of words in repeated windows, in percent, at most.
LEAST_WORDS = 10
REPEATED = 20
WINDOW = 5
SYMBOLS = b"#*$%&|<>"

_U = np.uint64
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True

KEYS = ["lang", "half"]


def rows_of(docs: DataFrame) -> DataFrame:
    """doc_id, text, lang, half: what the rules read."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    digit = F.coalesce(F.left(F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit(1)), F.lit("0"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", lang.alias("lang"), (digit >= "8").cast("int").alias("half"))


# What tasks do with a block of texts.


@dataclass
class Texts:
    """A block's words, and the stream of their characters: bytes, where characters begin, windows of ORDER characters."""

    data: np.ndarray
    ends: np.ndarray
    starts: np.ndarray = field(init=False)
    stops: np.ndarray = field(init=False)
    last: np.ndarray = field(init=False)

    def __post_init__(self):
        _, self.starts, self.stops, counts = common.words(self.data, self.ends, common.NOT_SPACE)
        self.last = np.concatenate([[0], np.cumsum(counts)])

    def each(self, values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Sums of values between cuts."""
        return np.diff(np.concatenate([[0], np.cumsum(values)])[cuts])

    def stream(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, byte where each character begins and the end, first character of each window, windows of each text)."""
        size = self.stops - self.starts + 1
        at = np.repeat(self.starts, size) + common.ragged(size)
        joined = np.append(self.data, np.uint8(32))[np.minimum(at, len(self.data))]
        joined[np.cumsum(size) - 1] = 32
        ends = np.concatenate([[0], np.cumsum(size)])[self.last]
        some = np.diff(ends) > 0
        joined = np.insert(joined, ends[:-1][some], 32)
        ends = ends + np.concatenate([[0], np.cumsum(some)])
        chars = np.append(np.flatnonzero((joined & 0xC0) != 0x80), len(joined))
        first = np.searchsorted(chars, ends)
        many = np.maximum(np.diff(first) - ORDER + 1, 0)
        return joined, chars, np.repeat(first[:-1], many) + common.ragged(many), many

    def base(self) -> dict[str, np.ndarray]:
        """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
        chars = np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80)])
        return {
            "n_words": np.diff(self.last),
            "word_chars": self.each(chars[self.stops] - chars[self.starts], self.last),
            "n_symbols": self.each(_SYMBOL[self.data], self.ends),
            "n_dup_lines": self.dup_lines(),
            "n_repeat_words": self.repeat_words(),
        }

    def dup_lines(self) -> np.ndarray:
        n = len(self.ends) - 1
        breaks = np.flatnonzero(self.data == 10)
        starts = np.concatenate([self.ends[:-1], breaks + 1])
        of = np.concatenate([np.arange(n), np.searchsorted(self.ends, breaks, "right") - 1])
        stops = np.minimum(np.append(breaks, len(self.data))[np.searchsorted(breaks, starts)], self.ends[of + 1])
        full = np.searchsorted(self.starts, stops) > np.searchsorted(self.starts, starts)
        hashes = common.span_hashes(common.prefix_hashes(self.data), starts[full], stops[full])
        _, first = np.unique(common.mix(hashes ^ common.mix(of[full].astype(np.uint64))), return_index=True)
        return np.bincount(of[full], minlength=n) - np.bincount(of[full][first], minlength=n)

    def repeat_words(self) -> np.ndarray:
        hashes = common.word_hashes(self.data, self.starts, self.stops)
        many = np.maximum(np.diff(self.last) - WINDOW + 1, 0)
        at = np.repeat(self.last[:-1], many) + common.ragged(many)
        window = common.mix(np.repeat(np.arange(len(many)), many).astype(np.uint64))
        for k in range(WINDOW):
            window = common.mix(window ^ hashes[at + k])
        _, which, times = np.unique(window, return_inverse=True, return_counts=True)
        again = at[times[which] > 1]
        depth = np.bincount(again, minlength=len(hashes) + 1) - np.bincount(again + WINDOW, minlength=len(hashes) + 1)[: len(hashes) + 1]
        return self.each(np.cumsum(depth)[:-1] > 0, self.last)


def _strings(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> pa.Array:
    size = stops - starts
    out = data[np.repeat(starts, size) + common.ragged(size)]
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(out.tobytes()))


def _groups(block: pa.RecordBatch) -> tuple[list[tuple[str, int]], np.ndarray]:
    """(languages and halves of a block, which of them each row has)."""
    keys = list(zip(block.column("lang").to_pylist(), block.column("half").to_pylist(), strict=True))
    found = sorted(set(keys))
    place = {k: i for i, k in enumerate(found)}
    return found, np.array([place[k] for k in keys], np.int64)


def _grams(joined: np.ndarray, chars: np.ndarray, first: np.ndarray, begin: int, stop: int, prefix: np.ndarray) -> np.ndarray:
    """Hashes of characters begin to stop of windows."""
    return common.span_hashes(prefix, chars[first + begin], chars[first + stop])


def counted(rows: DataFrame, by_row: bool = False) -> DataFrame:
    """lang, half, gram, n: n-grams of ORDER characters, summed within blocks of texts (or by row: doc_id, row_hash too)."""
    ids = ["doc_id", "row_hash"] if by_row else []

    def run(batches):
        for block in common.blocks(batches, "text", BLOCK):
            texts = Texts(*common.arrow_bytes(block.column("text")))
            joined, chars, first, many = texts.stream()
            found, group = _groups(block)
            group = np.arange(block.num_rows) if by_row else group
            of = np.repeat(group, many)
            hashes = common.mix(_grams(joined, chars, first, 0, ORDER, common.prefix_hashes(joined)) ^ common.mix(of.astype(np.uint64)))
            _, at, n = np.unique(hashes, return_index=True, return_counts=True)
            grams = _strings(joined, chars[first[at]], chars[first[at] + ORDER])
            if by_row:
                own = [block.column(c).take(pa.array(of[at])) for c in (*ids, *KEYS)]
            else:
                own = [pa.array([found[g][0] for g in of[at]], pa.string()), pa.array([found[g][1] for g in of[at]], pa.int32())]
            yield pa.RecordBatch.from_arrays([*own, grams, pa.array(n.astype(np.int64))], [*ids, *KEYS, "gram", "n"])

    schema = "lang string, half int, gram string, n long"
    rows = rows.withColumn("row_hash", F.xxhash64("text")) if by_row else rows
    return rows.select(*ids, "text", *KEYS).mapInArrow(run, "doc_id long, row_hash long, " * by_row + schema)


# The model, as tables.


def discounts(grams: DataFrame) -> DataFrame:
    """lang, half, d1, d2, d3: what is taken off counts of 1, 2 and more, by counts of counts; 0.5, 1, 1.5 where these don't tell."""
    n = {k: F.count_if(F.col("n") == k).cast("double") for k in range(1, 5)}
    found = grams.groupBy(*KEYS).agg(*[n[k].alias(f"n{k}") for k in n])
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
    rule = lambda k: F.lit(float(k)) - (k + 1) * y * F.try_divide(F.nullif(F.col(f"n{k + 1}"), F.lit(0.0)), F.col(f"n{k}"))
    sound = lambda k: F.when(rule(k).between(0.01, k), rule(k)).otherwise(F.lit(k / 2))
    return found.select(*KEYS, *[sound(k).alias(f"d{k}") for k in (1, 2, 3)])


def _log(p) -> F.Column:
    return F.rint(F.log(p) * SCALE).cast("int")


def entries(longest: DataFrame, shelf: common.Shelf) -> DataFrame:
    """lang, half, kind, key, value: log probabilities of n-grams (kind: their length), and what contexts of n-grams leave to
    shorter ones (kind: minus the length of the n-grams).  longest: lang, half, gram, n."""
    table = {ORDER: shelf.put(longest.groupBy(*KEYS, "gram").agg(F.sum("n").alias("n")), "grams")}
    for m in range(ORDER - 1, 0, -1):
        shorter = table[m + 1].select(*KEYS, F.substring("gram", 2, m).alias("gram"))
        table[m] = shelf.put(shorter.groupBy(*KEYS, "gram").agg(F.count("*").alias("n")), f"grams-{m}")
    # Every character that is unknown shares the place of one.
    below = table[1].groupBy(*KEYS).agg((1.0 / (F.count("*") + 1)).alias("p_below"))
    parts = []
    for m in range(1, ORDER + 1):
        context = F.substring("gram", 1, m - 1).alias("context")
        rows = table[m].select(*KEYS, "gram", "n", context).join(discounts(table[m]), KEYS)
        off = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = rows.withColumn("off", off)
        left = rows.groupBy(*KEYS, "context").agg(F.sum("n").alias("total"), (F.sum("off") / F.sum("n")).alias("left"))
        rows = rows.join(left, [*KEYS, "context"])
        if m == 1:
            rows = rows.join(below, KEYS)
            parts.append(left.join(below, KEYS).select(*KEYS, F.lit(0).alias("kind"), F.lit("").alias("key"), _log(F.col("left") * F.col("p_below")).alias("value")))
        else:
            rows = rows.withColumn("suffix", F.substring("gram", 2, m - 1)).join(below, [*KEYS, "suffix"])
            parts.append(left.select(*KEYS, F.lit(-m).alias("kind"), F.col("context").alias("key"), _log(F.col("left")).alias("value")))
        p = (F.col("n") - F.col("off")) / F.col("total") + F.col("left") * F.col("p_below")
        found = shelf.put(rows.select(*KEYS, "gram", p.alias("p")), f"probabilities-{m}")
        parts.append(found.select(*KEYS, F.lit(m).alias("kind"), F.col("gram").alias("key"), _log(F.col("p")).alias("value")))
        below = found.select(*KEYS, F.col("gram").alias("suffix"), F.col("p").alias("p_below"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    out = shelf.put(out, "model")
    shelf.drop("grams", *(f"grams-{m}" for m in range(1, ORDER)), *(f"probabilities-{m}" for m in range(1, ORDER + 1)))
    return out


# The model, as sorted arrays of hashes.


def _kind(hashes: np.ndarray, kind: int) -> np.ndarray:
    return common.mix(hashes ^ _U(kind * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


@dataclass
class Arrays:
    """Hashes of n-grams and contexts, sorted, their values, and where hashes with the same leading bits begin."""

    hashes: np.ndarray
    values: np.ndarray
    unknown: int
    shift: int = field(init=False)
    index: np.ndarray = field(init=False)

    def __post_init__(self):
        order = np.argsort(self.hashes)
        self.hashes, self.values = self.hashes[order], self.values[order]
        bits = max(1, len(order).bit_length())
        self.shift = 64 - bits
        self.index = np.searchsorted(self.hashes >> _U(self.shift), np.arange((1 << bits) + 1, dtype=np.uint64))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(is it there, its value or 0)."""
        bucket = (hashes >> _U(self.shift)).astype(np.int64)
        at, stop = self.index[bucket], self.index[bucket + 1]
        there, values = np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        left = np.flatnonzero(at < stop)
        while len(left):
            same = self.hashes[at[left]] == hashes[left]
            hit = left[same]
            there[hit], values[hit] = True, self.values[at[hit]]
            left = left[~same]
            at[left] += 1
            left = left[at[left] < stop[left]]
        return there, values


#: A model without entries: every character is as likely as any other.
NOTHING = Arrays(np.zeros(0, np.uint64), np.zeros(0, np.int32), -SCALE)


def arrays(model: DataFrame) -> dict[tuple[str, int], Arrays]:
    """The model's arrays by language and half.  model: at most MODEL_ROWS entries."""

    def run(batches):
        for batch in batches:
            data, ends = common.arrow_bytes(batch.column("key"))
            hashes = common.span_hashes(common.prefix_hashes(data), ends[:-1], ends[1:])
            kinds = batch.column("kind").to_numpy()
            for kind in np.unique(kinds):
                hashes[kinds == kind] = _kind(hashes[kinds == kind], int(kind))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*KEYS, "kind")), pa.array(hashes.view(np.int64)), batch.column("value")], [*KEYS, "kind", "hash", "value"])

    found = model.mapInArrow(run, "lang string, half int, kind int, hash long, value int").toArrow()
    if not found.num_rows:
        return {}
    lang = found.column("lang").combine_chunks().dictionary_encode()
    half, kind, hashes, values = (found.column(c).to_numpy() for c in ("half", "kind", "hash", "value"))
    group = lang.indices.to_numpy() * 2 + half
    out = {}
    for g in np.unique(group):
        mine = group == g
        gram = mine & (kind != 0)
        out[lang.dictionary[int(g // 2)].as_py(), int(g % 2)] = Arrays(hashes[gram].view(np.uint64), values[gram], int(values[mine & (kind == 0)][0]))
    return out


def _surprise(model: Arrays, joined: np.ndarray, chars: np.ndarray, first: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """Log probability of each window's last character after those before it."""
    out, left = np.zeros(len(first), np.int64), np.arange(len(first))
    for m in range(ORDER, 0, -1):
        there, value = model.find(_kind(_grams(joined, chars, first[left], ORDER - m, ORDER, prefix), m))
        out[left] += value
        left = left[~there]
        if m > 1:
            out[left] += model.find(_kind(_grams(joined, chars, first[left], ORDER - m, ORDER - 1, prefix), -m))[1]
    out[left] += model.unknown
    return out


# Scores and verdicts.

MEASURED = "doc_id long, row_hash long, lang string, half int, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_grams long"


def measured(rows: DataFrame, model: dict[tuple[str, int], Arrays] | None) -> DataFrame:
    """Counts of each row, and the sum of its log probabilities, by the other half's model (null without a model)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for block in common.blocks(batches, "text", BLOCK):
            texts = Texts(*common.arrow_bytes(block.column("text")))
            counts = texts.base()
            joined, chars, first, many = texts.stream()
            total = None
            if shared.value is not None:
                found, group = _groups(block)
                of, logs, prefix = np.repeat(group, many), np.zeros(len(first), np.int64), common.prefix_hashes(joined)
                for g, (lang, half) in enumerate(found):
                    mine = np.flatnonzero(of == g)
                    logs[mine] = _surprise(shared.value.get((lang, 1 - half), NOTHING), joined, chars, first[mine], prefix)
                total = texts.each(logs, np.concatenate([[0], np.cumsum(many)]))
            own = [block.column(c) for c in ("doc_id", "row_hash", *KEYS)]
            total = pa.nulls(block.num_rows, pa.int64()) if total is None else pa.array(total)
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(c.astype(np.int64)) for c in counts.values()), pa.array(many.astype(np.int64)), total], ["doc_id", "row_hash", *KEYS, *counts, "n_grams", "total"])

    return rows.select("doc_id", F.xxhash64("text").alias("row_hash"), "text", *KEYS).mapInArrow(run, MEASURED + ", total long")


def _totals_by_joins(rows: DataFrame, model: DataFrame, shelf: common.Shelf) -> DataFrame:
    """d, r, total of each different row: its n-grams meet the model in joins, the longest first, those not found then shorter."""
    ids = ["doc_id", "row_hash", *KEYS]
    at = rows.withColumn("row_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "row_hash", "lang"])
    open_ = counted(at, by_row=True).withColumn("half", 1 - F.col("half")).withColumn("value", F.lit(0).cast("long"))
    part = lambda kind, name: model.where(F.col("kind") == kind).select(*KEYS, F.col("key").alias("part"), F.col("value").alias(name))
    done = None
    for m in range(ORDER, 0, -1):
        open_ = shelf.put(open_, "open-grams")
        tried = open_.withColumn("part", F.substring("gram", ORDER - m + 1, m)).join(part(m, "own"), [*KEYS, "part"], "left")
        closed = shelf.put(tried.where("own is not null").groupBy(*ids).agg(F.sum(F.col("n") * (F.col("value") + F.col("own"))).alias("total")), f"closed-grams-{m}")
        done = closed if done is None else done.unionByName(closed)
        open_ = tried.where("own is null").drop("own", "part")
        if m > 1:
            open_ = open_.withColumn("part", F.substring("gram", ORDER - m + 1, m - 1)).join(part(-m, "left"), [*KEYS, "part"], "left")
            open_ = open_.withColumn("value", F.col("value") + F.coalesce("left", F.lit(0))).drop("left", "part")
    unknown = model.where("kind = 0").select(*KEYS, F.col("value").alias("own"))
    open_ = open_.join(unknown, KEYS, "left").groupBy(*ids).agg(F.sum(F.col("n") * (F.col("value") + F.coalesce("own", F.lit(NOTHING.unknown)))).alias("total"))
    summed = done.unionByName(open_).groupBy("doc_id", "row_hash", "lang").agg(F.sum("total").alias("total"))
    return summed.select(F.col("doc_id").alias("d"), F.col("row_hash").alias("r"), F.col("lang").alias("l"), "total")


def parted(sizes: dict[tuple[str, int], int], most: int) -> list[list[tuple[str, int]]]:
    """Languages and halves in parts of at most `most` entries, the largest first into the first part with room."""
    parts: list[list[tuple[str, int]]] = []
    room: list[int] = []
    for key, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        k = next((k for k, left in enumerate(room) if left >= n), len(parts))
        if k == len(parts):
            parts.append([])
            room.append(most)
        parts[k].append(key)
        room[k] -= n
    return parts


def _by_parts(rows: DataFrame, model: DataFrame, parts: list[list[tuple[str, int]]]) -> DataFrame:
    """Counts and sums of all rows: a scan for each part of the model; rows without a model are scored in the first."""
    out, spoken = None, F.concat_ws(":", (1 - F.col("half")).cast("string"), "lang")
    names = [[f"{half}:{lang}" for lang, half in part] for part in parts] or [[]]
    others = [name for part in names[1:] for name in part]
    for k, (part, own) in enumerate(zip(parts or [[]], names, strict=True)):
        mine = rows.where(spoken.isin(own) if k else ~spoken.isin(others)) if len(names) > 1 else rows
        held = F.concat_ws(":", F.col("half").cast("string"), "lang").isin(own)
        found = measured(mine, arrays(model.where(held) if len(names) > 1 else model))
        out = found if out is None else out.unionByName(found)
    return out


def scored(docs: DataFrame, shelf: common.Shelf, model_rows: int | None = None) -> DataFrame:
    """Counts and surprise (thousandths of a nat for each character; null without n-grams) of each row of docs."""
    rows, most = rows_of(docs), MODEL_ROWS if model_rows is None else model_rows
    model = entries(counted(rows), shelf)
    largest = model.groupBy(*KEYS).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *KEYS).limit(LANGUAGES + 1).collect()
    if len(largest) <= LANGUAGES and all(r["n"] <= most for r in largest):
        found = _by_parts(rows, model, parted({(r["lang"], r["half"]): r["n"] for r in largest}, most))
    else:
        totals = _totals_by_joins(rows, model, shelf)
        found = measured(rows, None).drop("total")
        same = found["doc_id"].eqNullSafe(totals["d"]) & found["row_hash"].eqNullSafe(totals["r"]) & (found["lang"] == totals["l"])
        found = found.join(totals, same, "left").drop("d", "r", "l")
    return found.withColumn("surprise", F.expr(f"case when n_grams > 0 then (-1000 * total) div ({SCALE} * n_grams) end")).drop("total")


def bands(surprise: DataFrame) -> DataFrame:
    """lang, lower, upper, from lang and surprise of all documents.  A language has a row for each value: a few thousand."""
    counts = surprise.where("surprise is not null").groupBy("lang", "surprise").agg(F.count("*").alias("n"))
    rising = Window.partitionBy("lang").orderBy("surprise")
    counts = counts.select("lang", "surprise", F.sum("n").over(rising).alias("upto"), F.sum("n").over(Window.partitionBy("lang")).alias("all"))
    quartile = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("all"), F.col("surprise")))
    found = counts.groupBy("lang").agg(quartile(1).alias("q1"), quartile(3).alias("q3"))
    wide = F.lit(BAND) * (F.col("q3") - F.col("q1"))
    return found.select("lang", (F.col("q1") - wide).alias("lower"), (F.col("q3") + wide).alias("upper"))


def judged(docs: DataFrame, model_rows: int | None = None) -> DataFrame:
    """doc_id, lang, counts, surprise, base_failed, kept of each row of docs (doc_id, text, lang if there is one)."""
    shelf = common.Shelf(docs.sparkSession)
    found = shelf.put(scored(docs, shelf, model_rows), "surprise")
    shelf.drop("model", "open-grams", *(f"closed-grams-{m}" for m in range(1, ORDER + 1)))
    edges = bands(found)
    if edges.count() <= LANGUAGES:
        edges = F.broadcast(edges)
    more = F.lit(1000.0 * SHORT) / F.sqrt(F.greatest("n_grams", F.lit(1)).cast("double"))
    inside = F.coalesce(F.col("surprise").between(F.col("lower") - more, F.col("upper") + more), F.lit(True))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))
    return found.join(edges, "lang", "left").withColumn("base_failed", failed).withColumn("kept", ~failed & inside).drop("lower", "upper", "half", "row_hash")


def perplexity(surprise) -> F.Column:
    return F.exp(surprise / 1000.0)


def report(docs: DataFrame) -> DataFrame:
    found = judged(docs)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "surprise")
