"""Periodic runs: stretches of words that repeat with a period, found by counting matches at each lag.

A run with period q is a longest stretch of words in which words q apart are identical, q its smallest period, and which
holds REPEATS periods and LEAST words at least.  At lag q it shows as an island of matches (words equal to the one q later),
so the matches at every lag up to n / REPEATS are counted first: for a document's frequent words (HEAVY occurrences and more)
by the autocorrelation of their places, exact after rounding, for the others by differences of pairs.  Only lags with
enough matches for one run are scanned, and of these only where three words that stand q apart in a row match: an island
that is long enough holds such a triple at multiples of q.  Places inside a run whose period divides q are passed over, as
a run that meets it in q words is that same run.

Words are runs of bytes other than white space, known by 64-bit hashes.  Documents are worked off in blocks of whole texts.

Edge cases: null or empty text, and text without words, has no runs and an empty collapsed text.  Rows that repeat a doc_id
are judged each by their own text.  A null doc_id is kept as null.  Among runs of equal length / period the first start is
strongest, then the smallest period.  Own columns with the names of new ones are replaced; all others stay.  An empty
table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skein.llm import common

#: Words and periods that a run holds at least.
LEAST = 6
REPEATS = 4
#: Pairs of places that are counted at once.
PAIRS = 1 << 20

RUN = "struct<start:long,length:long,period:long>"
Rewrite = Callable[[int | None, int], np.ndarray | None]


def heavy(n: np.ndarray) -> np.ndarray:
    """Occurrences from which a word of a document of n words is frequent: pairs then cost more than a transform."""
    return np.maximum(64, np.sqrt(n * np.log2(np.maximum(n, 2)))).astype(np.int64)


def needed(lags: np.ndarray) -> np.ndarray:
    """Matches in a row that a run with this period has at least."""
    return np.maximum(LEAST, REPEATS * lags) - lags


def lag_counts(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(matches at lag d of document k at base[k] + d, base) for lags up to n / REPEATS.  ends: where documents end in ids."""
    n = np.diff(ends)
    top = n // REPEATS
    base = np.concatenate([[0], np.cumsum(top + 1)])
    found = np.zeros(int(base[-1]), np.int64)
    of = np.repeat(np.arange(len(n)), n)
    key = of * (int(ids.max(initial=0)) + 1) + ids
    order = np.argsort(key, kind="stable")
    opens = np.flatnonzero(np.diff(key[order], prepend=-1))
    stops = np.append(opens, len(order))[1:]
    owner = of[order[opens]]
    frequent = stops - opens >= heavy(n)[owner]
    _pairs(order, np.repeat(np.arange(len(opens)), stops - opens), frequent, of, top, base, found)
    often = np.flatnonzero(frequent)
    for k, first in zip(*np.unique(owner[often], return_index=True), strict=True):
        mine = often[first : np.searchsorted(owner[often], k, "right")]
        found[base[k] : base[k + 1]] += _transformed([order[opens[g] : stops[g]] - ends[k] for g in mine], int(n[k]), int(top[k]))
    return found, base


def _pairs(order, group, frequent, of, top, base, found) -> None:
    """Adds the pairs of places of rare words, k-th neighbours at a time; a place drops out once its neighbour is too far."""
    at = np.flatnonzero(~frequent[group])
    held, size, k = [], 0, 0
    while len(at):
        k += 1
        at = at[at + k < len(order)]
        at = at[group[at + k] == group[at]]
        lag = order[at + k] - order[at]
        near = lag <= top[of[order[at]]]
        at, lag = at[near], lag[near]
        held.append(base[of[order[at]]] + lag)
        size += len(at)
        if size > PAIRS or not len(at):
            found += np.bincount(np.concatenate(held), minlength=len(found))
            held, size = [], 0


def _transformed(places: list[np.ndarray], n: int, top: int) -> np.ndarray:
    """Matches at lags 0 to top of words that stand at these places: one transform for each word and one back.

    Counts are at most n, the error of a transform of doubles is below n * 1e-14: rounding gives them exactly.
    """
    size = 1 << (n + top).bit_length()
    power = np.zeros(size // 2 + 1)
    for p in places:
        mark = np.zeros(size)
        mark[p] = 1
        power += np.abs(np.fft.rfft(mark)) ** 2
    return np.rint(np.fft.irfft(power, size)[: top + 1]).astype(np.int64)


def _within(starts: np.ndarray, stops: np.ndarray, of: list[np.ndarray]) -> np.ndarray:
    """Which stretches lie inside one of these runs, of one period and in order."""
    held = np.searchsorted(of[0], starts, "right") - 1
    return (held >= 0) & (of[1][np.maximum(held, 0)] >= stops)


def scanned(w: np.ndarray, lags: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a document with words w, in order; lags: those that may have one, rising."""
    known: dict[int, list[np.ndarray]] = {}
    for q in lags.tolist():
        inner = [known[p] for p in known if q % p == 0]
        t = np.arange(0, len(w) - q, q)
        hit = w[t] == w[t + q]
        for runs in inner:
            hit &= ~_within(t, t + q, runs)
        if not (hit[:-2] & hit[1:-1] & hit[2:]).any():
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[False], w[:-q] == w[q:], [False]]).astype(np.int8)))
        starts, stops = edges[::2], edges[1::2] + q
        long = stops - starts >= max(LEAST, REPEATS * q)
        for runs in inner:
            long &= ~_within(starts, stops, runs)
        if long.any():
            known[q] = [starts[long], stops[long]]
    return sorted((s, e - s, q) for q, (a, b) in known.items() for s, e in zip(a.tolist(), b.tolist(), strict=True))


def stays(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words no run holds after its first period."""
    depth = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return np.cumsum(depth[:-1]) == 0


def _block(block: pa.RecordBatch, rewrite: Rewrite | None) -> dict[str, pa.Array]:
    data, text_ends = common.arrow_bytes(block.column("text"))
    _, starts, stops, counts = common.words(data, text_ends, common.NOT_SPACE)
    _, ids = np.unique(common.word_hashes(data, starts, stops), return_inverse=True)
    ends = np.concatenate([[0], np.cumsum(counts)])
    if rewrite:
        order = np.arange(len(ids))
        for k, doc_id in enumerate(block.column("doc_id").to_pylist()):
            if counts[k] and (new := rewrite(doc_id, int(counts[k]))) is not None:
                order[ends[k] : ends[k + 1]] = ends[k] + new
        ids, starts, stops = ids[order], starts[order], stops[order]
    matches, base = lag_counts(ids, ends)
    lag = np.arange(len(matches)) - np.repeat(base[:-1], np.diff(base))
    may = np.flatnonzero((lag > 0) & (matches >= needed(lag)))
    cut = np.searchsorted(may, base)
    every, keep = [], np.ones(len(ids), bool)
    for k in range(block.num_rows):
        runs = scanned(ids[ends[k] : ends[k + 1]], lag[may[cut[k] : cut[k + 1]]]) if cut[k] < cut[k + 1] else []
        every.append(runs)
        if runs:
            keep[ends[k] : ends[k + 1]] = stays(int(counts[k]), runs)
    best = [max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else None for runs in every]
    named = lambda r: None if r is None else {"start": r[0], "length": r[1], "period": r[2]}
    kind = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
    return {
        "n_words": pa.array(counts, pa.int64()),
        "runs": pa.array([[named(r) for r in runs] for runs in every], pa.list_(kind)),
        "strongest": pa.array([named(r) for r in best], kind),
        "collapsed": _joined(data, starts[keep], stops[keep], np.diff(np.concatenate([[0], np.cumsum(keep)])[ends])),
    }


def _joined(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, counts: np.ndarray) -> pa.Array:
    """One text for each document: its words with one space between them."""
    size = stops - starts + 1
    at = np.repeat(starts, size) + common.ragged(size)
    out = np.append(data, np.uint8(32))[np.minimum(at, len(data))]
    word_ends = np.concatenate([[0], np.cumsum(size)])
    out[word_ends[1:] - 1] = 32
    last = np.concatenate([[0], np.cumsum(counts)])
    ends = word_ends[last]
    # The space after each document's last word goes.
    full = np.cumsum(counts > 0)
    out = np.delete(out, ends[1:][counts > 0] - 1)
    offsets = np.concatenate([[0], ends[1:] - full]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(counts), pa.py_buffer(offsets), pa.py_buffer(out.tobytes())).cast(pa.string())


def detected(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """docs with n_words, runs (in order of start, then period), strongest and collapsed: the words that no run repeats.

    rewrite: gives, for a doc_id and its number of words, the original word at each place, or None to leave them.
    """
    new = {"n_words": "long", "runs": f"array<{RUN}>", "strongest": RUN, "collapsed": "string"}
    docs = docs.drop(*new)

    def run(batches):
        for block in common.blocks(batches, "text"):
            found = _block(block, rewrite)
            yield pa.RecordBatch.from_arrays([*block.columns, *found.values()], [*block.schema.names, *found])

    added = StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind in new.items()))
    return docs.mapInArrow(run, StructType([*docs.schema, *added]))


def repeating(doc_id: int | None, n: int) -> np.ndarray | None:
    """The query's rule: in about one document of ten, words from place a on are those of one period, again and again."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def report(docs: DataFrame) -> DataFrame:
    found = detected(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), repeating)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    best = F.col("strongest")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[best[c].alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        "n_words",
    )
