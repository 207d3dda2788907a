"""Quality classifier: a generalised additive model with pairwise interactions.

Features are cut into bins.  Shallow trees are boosted one feature at a time, in turns (cyclic), each on the residual of
the sum so far; a tree over one binned feature adds to that feature's lookup table, so the model ends as one table for each
feature.  Then the pairs of features whose joint bins explain most of what is left are boosted in turns by shallow trees that
cut along either feature, into a two-way table each.  A score is a sum of table entries through the logistic function:
vectorised lookups and additions.

The fit uses at most SAMPLE labelled rows, those with the smallest hash of doc_id; scoring reads every text whole.  How many
rounds of each kind are boosted is chosen on every WATCH-th of these rows, then the model is fitted on all of them.

Edge cases: null text counts as empty, and empty text has a score.  Labelled rows with a null label, and labels without a
document, are not learned from; a document labelled twice is learned from twice.  With no labels at all every score is 0.5.
Repeated rows are scored alike; a null doc_id is not held out.  Extra columns are ignored by `score` and kept by `keep`.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import common

#: Labelled rows that the fit uses at most.
SAMPLE = 20_000
#: Score from which a document passes.
THRESHOLD = 0.3
#: Bins of a feature, of each side of a pair; rounds at most of boosting; step; pairs; leaves of a tree; rows a leaf has at least.
BINS, PAIR_BINS, ROUNDS, PAIR_ROUNDS, STEP, PAIRS, LEAVES, LEAF_ROWS = 32, 8, 120, 40, 0.15, 6, 3, 5
#: Of this many of the fit's rows one is held back while rounds are chosen.
WATCH = 5

FEATURES = (
    "bytes", "words", "mean_word", "upper", "digits", "symbols", "spaces", "wide", "pipes", "bangs", "line_bytes", "short_lines",
    "repeat_next", "distinct_words", "symbol_ends", "distinct_lines",
)

_KIND = np.zeros((256, 8), np.float32)
_KIND[0x41:0x5B, 0] = 1  # upper-case letters
_KIND[0x30:0x3A, 1] = 1  # digits
_KIND[list(b"#$%&*+<=>@^_`{}~\\"), 2] = 1  # symbols
_KIND[[0x20, *range(0x09, 0x0E)], 3] = 1
_KIND[0x80:, 4] = 1
_KIND[ord("|"), 5] = 1
_KIND[ord("!"), 6] = 1
_KIND[ord("\n"), 7] = 1


def _per_doc(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[ends[1:]] - total[ends[:-1]]


def features(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text; bytes are all that is looked at."""
    n = np.diff(ends).astype(np.float64)
    kinds = [_per_doc(_KIND[:, k][data], ends) for k in range(8)]
    upper, digits, symbols, spaces, wide, pipes, bangs, breaks = kinds
    low, starts, stops, counts = common.words(data, ends, common.NOT_SPACE)
    hashes = common.word_hashes(low, starts, stops)
    word_ends = np.concatenate([[0], np.cumsum(counts)])
    doc = np.repeat(np.arange(len(counts)), counts)
    same = np.zeros(len(hashes))
    same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    odd = _KIND[low[stops - 1], 2] if len(stops) else np.zeros(0)
    size = np.maximum(n, 1)
    words = np.maximum(counts, 1)

    def distinct(values, docs, many):
        order = np.lexsort((values, docs))
        new = np.ones(len(values), bool)
        new[1:] = (values[order][1:] != values[order][:-1]) | (docs[order][1:] != docs[order][:-1])
        return np.bincount(docs[order][new], minlength=many)

    # Lines: bytes between line feeds; documents end lines too.
    cuts = np.union1d(np.flatnonzero(data == 10) + 1, ends) if len(data) else ends[:1]
    line_starts, line_stops = cuts[:-1], cuts[1:]
    line_doc = np.searchsorted(ends, line_starts, "right") - 1
    lines = np.maximum(np.bincount(line_doc, minlength=len(n)), 1) if len(line_starts) else np.ones(len(n))
    short = np.bincount(line_doc, weights=(line_stops - line_starts) < 20, minlength=len(n)) if len(line_starts) else np.zeros(len(n))
    prefix = common.prefix_hashes(data)
    line_hashes = common.span_hashes(prefix, line_starts, line_stops)
    return np.stack(
        [
            np.log1p(n), np.log1p(counts), (n - spaces) / words, upper / size, digits / size, symbols / size, spaces / size, wide / size,
            pipes / words, bangs / words, np.log1p(n / lines), short / lines, _per_doc(same, word_ends) / words,
            distinct(hashes, doc, len(n)) / words, _per_doc(odd, word_ends) / words, distinct(line_hashes, line_doc, len(n)) / lines,
        ],
        axis=1,
    )


@dataclass
class Model:
    edges: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    tables: np.ndarray = field(default_factory=lambda: np.zeros((0, BINS)))
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1) if self.edges else np.zeros((len(x), 0), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.base)
        for j in range(b.shape[1]):
            total += self.tables[j][b[:, j]]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            total += t[_coarse(b[:, i]), _coarse(b[:, j])]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _coarse(b: np.ndarray) -> np.ndarray:
    return b * PAIR_BINS // BINS


def _tree(gradient: np.ndarray, hessian: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Leaf values by bin of a tree with LEAVES leaves over one feature's ordered bins: the best cut, then the next best."""
    parts = [(0, len(gradient))]
    g, h, n = (np.concatenate([[0], np.cumsum(v)]) for v in (gradient, hessian, rows))

    def worth(a: int, b: int) -> float:
        return (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1.0)

    for _ in range(LEAVES - 1):
        best = (1e-6, None, None)
        for p, (a, b) in enumerate(parts):
            for c in range(a + 1, b):
                if n[c] - n[a] >= LEAF_ROWS and n[b] - n[c] >= LEAF_ROWS:
                    best = max(best, (worth(a, c) + worth(c, b) - worth(a, b), p, c), key=lambda x: x[0])
        if best[1] is None:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(gradient))
    for a, b in parts:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1.0)
    return out


def _pair_tree(gradient: np.ndarray, hessian: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Leaf values by cell of a tree with LEAVES leaves over two features: each cut is along one of them, inside one leaf."""

    def sums(v):
        out = np.zeros((PAIR_BINS + 1, PAIR_BINS + 1))
        out[1:, 1:] = v.reshape(PAIR_BINS, PAIR_BINS).cumsum(axis=0).cumsum(axis=1)
        return out

    g, h, n = sums(gradient), sums(hessian), sums(rows)

    def of(v, box):
        a, b, c, d = box
        return v[b, d] - v[a, d] - v[b, c] + v[a, c]

    def worth(box):
        return of(g, box) ** 2 / (of(h, box) + 1.0)

    leaves = [(0, PAIR_BINS, 0, PAIR_BINS)]
    for _ in range(LEAVES - 1):
        best = (1e-6, None, None)
        for box in leaves:
            a, b, c, d = box
            cuts = [((a, k, c, d), (k, b, c, d)) for k in range(a + 1, b)] + [((a, b, c, k), (a, b, k, d)) for k in range(c + 1, d)]
            for two in cuts:
                if min(of(n, two[0]), of(n, two[1])) >= LEAF_ROWS:
                    best = max(best, (worth(two[0]) + worth(two[1]) - worth(box), box, two), key=lambda x: x[0])
        if best[1] is None:
            break
        leaves.remove(best[1])
        leaves += best[2]
    out = np.zeros((PAIR_BINS, PAIR_BINS))
    for box in leaves:
        a, b, c, d = box
        out[a:b, c:d] = of(g, box) / (of(h, box) + 1.0)
    return out


def _loss(total: np.ndarray, y: np.ndarray) -> float:
    return float((np.logaddexp(0, total) - y * total).mean())


def _boost(x: np.ndarray, y: np.ndarray, rounds: int, pair_rounds: int, watch: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[Model, int, int]:
    """A model of so many rounds; with rows to watch, also the numbers of rounds after which their loss was least."""
    model = Model()
    for j in range(x.shape[1]):
        model.edges.append(np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])))
    rate = np.clip(y.mean(), 0.01, 0.99)
    model.base = float(np.log(rate / (1 - rate)))
    model.tables = np.zeros((x.shape[1], BINS))
    b, total = model.bins(x), np.full(len(y), model.base)
    watched, seen = (model.bins(watch[0]), np.full(len(watch[1]), model.base)) if watch else (b[:0], total[:0])
    sizes = [np.bincount(b[:, j], minlength=BINS) for j in range(x.shape[1])]
    losses = [_loss(seen, watch[1])] if watch else []
    for _ in range(rounds):
        for j in range(x.shape[1]):
            p = 1 / (1 + np.exp(-total))
            step = STEP * _tree(np.bincount(b[:, j], y - p, BINS), np.bincount(b[:, j], p * (1 - p), BINS), sizes[j])
            model.tables[j] += step
            total += step[b[:, j]]
            seen += step[watched[:, j]]
        if watch:
            losses.append(_loss(seen, watch[1]))
    best = int(np.argmin(losses)) if watch else rounds
    p = 1 / (1 + np.exp(-total))
    coarse, watched = _coarse(b), _coarse(watched)

    def cell(i: int, j: int) -> np.ndarray:
        return coarse[:, i] * PAIR_BINS + coarse[:, j]

    def gain(i: int, j: int) -> float:
        c = cell(i, j)
        return float((np.bincount(c, y - p, PAIR_BINS**2) ** 2 / (np.bincount(c, p * (1 - p), PAIR_BINS**2) + 1.0)).sum())

    ranked = sorted(((gain(i, j), i, j) for i in range(x.shape[1]) for j in range(i)), reverse=True)
    model.pairs = [(i, j) for _, i, j in ranked[:PAIRS]]
    model.pair_tables = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in model.pairs]
    losses = [_loss(seen, watch[1])] if watch else []
    for _ in range(pair_rounds):
        for k, (i, j) in enumerate(model.pairs):
            p = 1 / (1 + np.exp(-total))
            c = cell(i, j)
            step = STEP * _pair_tree(np.bincount(c, y - p, PAIR_BINS**2), np.bincount(c, p * (1 - p), PAIR_BINS**2), np.bincount(c, minlength=PAIR_BINS**2))
            model.pair_tables[k] += step
            total += step[coarse[:, i], coarse[:, j]]
            seen += step[watched[:, i], watched[:, j]]
        if watch:
            losses.append(_loss(seen, watch[1]))
    return model, best, int(np.argmin(losses)) if watch else pair_rounds


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    if not len(y):
        return Model()
    rounds, pair_rounds = ROUNDS, PAIR_ROUNDS
    held = np.arange(len(y)) % WATCH == 0
    if len(np.unique(y[held])) == len(np.unique(y[~held])) == 2:
        watch = (x[held], y[held])
        _, rounds, _ = _boost(x[~held], y[~held], ROUNDS, 0, watch)
        _, _, pair_rounds = _boost(x[~held], y[~held], rounds, PAIR_ROUNDS, watch)
    return _boost(x, y, rounds, pair_rounds)[0]


def held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def feature_rows(docs: DataFrame, keep: str) -> DataFrame:
    """The column `keep` and x: the features of each text."""

    def run(batches):
        for block in common.blocks(batches, "text"):
            x = features(*common.arrow_bytes(block.column("text")))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([block.column(keep), flat], [keep, "x"])

    return docs.select(keep, "text").mapInArrow(run, f"{keep} int, x array<double>")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most `sample` labelled rows that aren't held out."""
    known = labels.where("quality is not null and doc_id is not null").where(~held_out())
    # TakeOrdered: `sample` ids at most reach the driver, and are broadcast as a table of that bound.
    chosen = known.select("doc_id", F.col("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "quality").limit(sample)
    chosen = docs.sparkSession.createDataFrame(chosen.toPandas(), "doc_id long, quality int").withColumnRenamed("doc_id", "id")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    found = feature_rows(rows, "quality").toPandas()
    if not len(found):
        return Model()
    # Rows come in any order; the fit's sums must not depend on it.
    x, y = np.array(found["x"].tolist()), found["quality"].to_numpy(float)
    order = np.lexsort((y, *x.T))
    return fit(x[order], y[order])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for block in common.blocks(batches, "text"):
            s = shared.value.score(features(*common.arrow_bytes(block.column("text"))))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that pass, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for block in common.blocks(batches, "text"):
            yield block.filter(pa.array(shared.value.score(features(*common.arrow_bytes(block.column("text")))) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
