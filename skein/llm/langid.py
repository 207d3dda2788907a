"""Language identification: words first, then shorter and shorter character n-grams.

A word that training saw is scored by its log frequency in each language.  An unseen word falls back to its character
n-grams (with marks for its ends) of length 5; if none of these is known, of length 4, and so on down to single characters.
A document's score is the sum over all its words.

Words are runs of letters (Unicode's letter categories), lower-cased letter by letter.  Words and n-grams are known by 64-bit hashes; a
block of texts is one array of code points, and each distinct word of a block is looked up once.  Log frequencies are whole
numbers of 1 / SCALE, so sums don't depend on their order.

The fit uses at most SAMPLE labelled rows, those with the smallest hash of doc_id, and keeps every word and n-gram
of theirs; prediction reads every text whole.

Edge cases: null text, and text without a letter, is "und" with score 0; so is every text if no row is labelled.  A null
doc_id is not held out.  Ties go to the first language by name.  Repeated rows are predicted alike; extra columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import common

#: Labelled rows that the fit uses at most.
SAMPLE = 20_000
#: The longest n-gram.
LONGEST = 5
#: Steps of a log frequency in one unit.
SCALE = 1 << 16

#: Kind of a whole word; n-grams are of the kind of their length.
_WORD = 0
_U = np.uint64
_OPEN, _CLOSE = 0x3C, 0x3E


@cache
def _code_points() -> tuple[np.ndarray, np.ndarray]:
    """(is it a letter, its lower case) by code point; a letter whose lower case is several code points stays itself."""
    letter = np.zeros(sys.maxunicode + 1, bool)
    lower = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    for c in range(sys.maxunicode + 1):
        if (s := chr(c)).isalpha():
            letter[c] = True
            if len(small := s.lower()) == 1:
                lower[c] = ord(small)
    return letter, lower


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased code points, word starts, word ends, number of words of each text)."""
    letter, lower = _code_points()
    codes = np.frombuffer("\n".join(t or "" for t in texts).encode("utf-32-le"), np.uint32)
    inside = np.zeros(len(codes) + 2, np.int8)
    inside[1:-1] = letter[codes]
    edges = np.flatnonzero(np.diff(inside))
    ends = np.cumsum([0, *(len(t or "") + 1 for t in texts)])
    return lower[codes], edges[::2], edges[1::2], np.diff(np.searchsorted(edges[::2], ends))


def _hashes(codes: np.ndarray, starts: np.ndarray, stops: np.ndarray, kind: int) -> np.ndarray:
    h = common.span_hashes(common.prefix_hashes(codes), starts, stops)
    return common.mix(h ^ _U(kind * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


def _marked(codes: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, starts, sizes) of the words between marks."""
    size = stops - starts
    begin = np.cumsum(size + 2) - size - 2
    out = np.full(int((size + 2).sum()), _CLOSE, np.uint32)
    out[begin] = _OPEN
    out[np.repeat(begin + 1, size) + common.ragged(size)] = codes[np.repeat(starts, size) + common.ragged(size)]
    return out, begin, size + 2


def _grams(marked: np.ndarray, begin: np.ndarray, size: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of its word) of each n-gram; single characters are taken without the marks."""
    bare = int(n == 1)
    many = np.maximum(size - 2 * bare - n + 1, 0)
    at = np.repeat(begin + bare, many) + common.ragged(many)
    return _hashes(marked, at, at + n, n), np.repeat(np.arange(len(begin)), many)


def held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


@dataclass
class Model:
    """hashes: of all words and n-grams, sorted; rows: their log frequencies, a column for each language."""

    languages: list[str] = field(default_factory=list)
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    rows: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.int32))

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return at, self.hashes[at] == hashes

    def word_rows(self, codes: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """A row for each of these distinct words; zeros where not even a character is known."""
        at, known = self._find(_hashes(codes, starts, stops, _WORD))
        out = np.zeros((len(starts), len(self.languages)), np.int64)
        out[known] = self.rows[at[known]]
        left = np.flatnonzero(~known)
        marked, begin, size = _marked(codes, starts[left], stops[left])
        for n in range(LONGEST, 0, -1):
            hashes, of = _grams(marked, begin, size, n)
            at, known = self._find(hashes)
            at, of = at[known], of[known]
            many = np.bincount(of, minlength=len(left))
            got = many > 0
            for k in range(len(self.languages)):
                out[left[got], k] = np.rint(np.bincount(of, self.rows[at, k], len(left))[got] / many[got])
            left, begin, size = left[~got], begin[~got], size[~got]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Languages and scores."""
        codes, starts, stops, counts = words(texts)
        if not self.languages or not len(starts):
            return ["und"] * len(texts), np.zeros(len(texts))
        _, first, of = np.unique(_hashes(codes, starts, stops, _WORD), return_index=True, return_inverse=True)
        rows = self.word_rows(codes, starts[first], stops[first])
        ends = np.concatenate([[0], np.cumsum(counts)])
        total = np.stack([np.diff(np.concatenate([[0], np.cumsum(rows[of, k])])[ends]) for k in range(len(self.languages))], axis=1)
        best = total.argmax(axis=1)
        odds = np.exp((total - total.max(axis=1, keepdims=True)) / SCALE)
        return [self.languages[b] if c else "und" for b, c in zip(best, counts, strict=True)], np.where(counts > 0, 1 / odds.sum(axis=1), 0.0)


COUNTS = "kind int, hash long, lang string, n long"


def _counted(texts: list[str], lang: str) -> pa.RecordBatch:
    """How often each word and each n-gram stands in texts of one language."""
    codes, starts, stops, _ = words(texts)
    found, first, many = np.unique(_hashes(codes, starts, stops, _WORD), return_index=True, return_counts=True)
    kinds, hashes, ns = [np.full(len(found), _WORD)], [found], [many]
    marked, begin, size = _marked(codes, starts[first], stops[first])
    for n in range(1, LONGEST + 1):
        grams, of = _grams(marked, begin, size, n)
        some, place = np.unique(grams, return_inverse=True)
        kinds.append(np.full(len(some), n))
        hashes.append(some)
        ns.append(np.bincount(place, many[of], len(some)))
    every = np.concatenate(hashes)
    columns = [pa.array(np.concatenate(kinds), pa.int32()), pa.array(every.view(np.int64)), pa.array([lang] * len(every), pa.string()), pa.array(np.concatenate(ns).astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, ["kind", "hash", "lang", "n"])


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    spark = docs.sparkSession
    known = docs.where("lang is not null and text is not null and doc_id is not null").where(~held_out())
    # TakeOrdered: `sample` ids at most reach the driver.
    chosen = known.select(F.col("doc_id").cast("long").alias("id")).orderBy(F.xxhash64("doc_id")).limit(sample).toPandas()
    rows = known.select("doc_id", "text", "lang").join(F.broadcast(spark.createDataFrame(chosen, "id long").distinct()), F.col("doc_id") == F.col("id")).select("text", "lang")

    def count(batches):
        for block in common.blocks(batches, "text"):
            texts, langs = block.column("text").to_pylist(), block.column("lang").to_pylist()
            for lang in sorted(set(langs)):
                yield _counted([t for t, x in zip(texts, langs, strict=True) if x == lang], lang)

    counts = rows.mapInArrow(count, COUNTS).groupBy("kind", "hash", "lang").agg(F.sum("n").alias("n"))
    return _model(counts.toArrow())  # the sample bounds its words and n-grams


def _model(found: pa.Table) -> Model:
    if not found.num_rows:
        return Model()
    kind, n = found.column("kind").to_numpy(), found.column("n").to_numpy()
    lang = found.column("lang").combine_chunks().dictionary_encode()
    languages = sorted(lang.dictionary.to_pylist())
    column = np.array([languages.index(x) for x in lang.dictionary.to_pylist()])[lang.indices.to_numpy()]
    hashes, first, row = np.unique(found.column("hash").to_numpy().view(np.uint64), return_index=True, return_inverse=True)
    counts = np.zeros((len(hashes), len(languages)))
    counts[row, column] = n
    rows = np.zeros(counts.shape, np.int32)
    for k in range(LONGEST + 1):
        own = kind[first] == k
        total = counts[own].sum(axis=0) + 0.5 * (own.sum() + 1)
        rows[own] = np.rint(SCALE * np.log((counts[own] + 0.5) / total))
    return Model(languages, hashes, rows)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for block in common.blocks(batches, "text"):
            found, scores = shared.value.predict(block.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("held_out"), pa.array(found, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
