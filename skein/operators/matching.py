"""Which of many words stand in which texts: one automaton for all words, so that texts are read once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ty

#: Characters of words that one automaton holds at most; more words are dealt to several, each with a reading of its own.
AUTOMATON_CHARS = 8_000_000


def _automaton(words: list[str]):
    """All words in one trie with failure links (Aho-Corasick); None without words."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for word in words:
        found.add_word(word, word)
    if not len(found):
        return None
    found.make_automaton()
    return found


class _Least:
    """The least keys of each word so far; tells which rows of a batch can be among the `most` first."""

    def __init__(self, most: int):
        self.most, self.held = most, {}

    def kept(self, words: list[str], keys: list) -> list[int]:
        own: dict[str, list] = {}
        for n, (word, key) in enumerate(zip(words, keys, strict=True)):
            held = self.held.get(word, ())
            if len(held) < self.most or key < held[-1]:
                own.setdefault(word, []).append((key, n))
        for word, found in own.items():
            own[word] = sorted(found)[: self.most]
            self.held[word] = sorted([*self.held.get(word, ()), *(key for key, _ in own[word])])[: self.most]
        return sorted(n for found in own.values() for _, n in found)


def _matches(batches: Iterator[pa.RecordBatch], words: list[str], names: list[str], first: tuple[str, int] | None = None) -> Iterator[pa.RecordBatch]:
    automaton = _automaton(words)
    least = _Least(first[1]) if first else None
    for batch in batches if automaton else ():
        rows, found, exact = [], [], []
        for k, texts in enumerate(batch.column("texts").to_pylist()):
            inside = {word for t in texts or () if t for _, word in automaton.iter(t)}
            whole = set(texts or ())
            rows += [k] * len(inside)
            found += sorted(inside)
            exact += [w in whole for w in sorted(inside)]
        if least:
            # Nulls come first, as Spark sorts them.
            keys = [(key is not None, key) for key in batch.column(first[0]).to_pylist()]
            kept = least.kept(found, [keys[k] for k in rows])
            rows, found, exact = ([x[n] for n in kept] for x in (rows, found, exact))
        taken = [batch.column(c).take(pa.array(rows, pa.int64())) for c in names]
        yield pa.RecordBatch.from_arrays([*taken, pa.array(found, pa.string()), pa.array(exact, pa.bool_())], [*names, "word", "exact"])


def contained(rows: DataFrame, words: DataFrame, most: int | None = None, first: tuple[str, int] | None = None) -> DataFrame:
    """The columns of rows but `texts`, with word, exact: words that a text of the row contains, and whether one is equal to it.

    rows: texts (array of strings; null and empty ones hold nothing) beside any columns; words: word.  Words are compared as
    they are; null and empty words stand nowhere, and a word counts once however often it is listed or stands there.  Words
    go to the tasks as one list, after a check of its size; where they are more than `most` characters, in lists by hash.

    first (column, n): only the n first rows of a word by that column are wanted; a task passes on those that can be among
    them, and maybe others.
    """
    most = most or AUTOMATON_CHARS
    words = words.where("word <> ''").select("word").distinct()
    size = words.agg(F.coalesce(F.sum(F.length("word") + 1), F.lit(0))).first()[0]
    parts = max(1, -(-size // most))
    names = [c for c in rows.columns if c != "texts"]
    schema = ty.StructType([*(rows.schema[c] for c in names), ty.StructField("word", ty.StringType()), ty.StructField("exact", ty.BooleanType())])
    out = None
    for k in range(parts):
        listed = words.where(F.pmod(F.xxhash64("word"), F.lit(parts)) == k) if parts > 1 else words
        shared = rows.sparkSession.sparkContext.broadcast([r["word"] for r in listed.orderBy("word").collect()])
        found = rows.mapInArrow(lambda batches, shared=shared: _matches(batches, shared.value, names, first), schema)
        out = found if out is None else out.unionByName(found)
    return out
