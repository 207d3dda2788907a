"""Periodic runs against brute force, and edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from skein.llm import periodic

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def rewritten(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def runs_of(w):
    """Every maximal stretch, at every period, whose smallest period that is."""
    found = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            length = i + q - s
            piece = w[s : s + length]
            smallest = next(p for p in range(1, length + 1) if piece[p:] == piece[: length - p])
            if length >= max(6, 4 * q) and smallest == q:
                found.append((s, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def expected(doc_id, text, rule=rewritten):
    w = rule(doc_id, SPLIT.findall(text or ""))
    runs = runs_of(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else (None,) * 3
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return {
        "n_runs": len(runs), "start": best[0], "length": best[1], "period": best[2], "exponent_milli": runs and 1000 * best[1] // best[2] or None,
        "runs_sha256": hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(), "collapsed_sha256": hashlib.sha256(kept.encode()).hexdigest(),
    }


def made(seed, n):
    """Words of a tiny vocabulary with planted repeats of repeats, so that runs nest and overlap."""
    r = random.Random(seed)
    w = []
    while len(w) < n:
        unit = [r.choice("abcdef") for _ in range(r.randint(1, 7))]
        if r.random() < 0.3:
            unit = unit * r.randint(2, 6) + [r.choice("abc")]
        w += unit * r.choice([1, 1, 2, 4, 5, 9])
    return " ".join(w[:n])


def check(df, rows):
    found = df.collect()
    assert len(found) == len(rows)
    want = sorted(((i is None, i, tuple(expected(i, t).items())) for i, t in rows), key=str)
    got = sorted(((r["doc_id"] is None, r["doc_id"], tuple((c, r[c]) for c in expected(1, ""))) for r in found), key=str)
    assert got == want


def test_runs(spark, docs, corpus):
    check(periodic.report(docs), corpus)


def test_runs_nested(spark):
    rows = [(i, made(i, n)) for i, n in enumerate([1, 2, 3, 5, 6, 7, 8, 9, 23, *range(30, 400, 9)])]
    rows += [(900, "a " * 3000), (901, "a\tb\n" * 500), (902, " "), (903, "a b a b a b a b"), (904, "x x x x x"), (905, "x x x x x x")]
    check(periodic.report(spark.createDataFrame(rows, "doc_id long, text string")), rows)


@pytest.mark.parametrize("least", [1, 5, 10**6])
def test_lag_counts_heavy_and_light(monkeypatch, least):
    """Whatever share of the words is counted by transforms, the counts are the same."""
    monkeypatch.setattr(periodic, "heavy", lambda n: np.full(len(n), least))
    monkeypatch.setattr(periodic, "PAIRS", 50)
    r = np.random.default_rng(least)
    sizes = [0, 1, 5, 300, 77, 0, 900]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    ids = np.minimum(r.geometric(0.2, ends[-1]), 12)
    found, base = periodic.lag_counts(ids, ends)
    for k, n in enumerate(sizes):
        w = ids[ends[k] : ends[k + 1]]
        for d in range(1, n // 4 + 1):
            assert found[base[k] + d] == (w[d:] == w[:-d]).sum()


def test_runs_in_an_operator(spark):
    rows = [(1, "so it is is is is is is said", 5), (None, "one two one two one two one two", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int").withColumnRenamed("runs", "other")
    found = {r["doc_id"]: r for r in periodic.detected(docs).collect()}
    assert found[1]["collapsed"] == "so it is said" and found[1]["other"] == 5 and found[1]["n_words"] == 9
    assert [tuple(x) for x in found[None]["runs"]] == [(0, 8, 2)] and found[None]["collapsed"] == "one two"


def test_very_long_text(spark):
    """A word that fills a text is one run, found without a scan for each lag; so is a long period."""
    rows = [(4, "la " * 200_000), (8, " ".join(f"w{i % 20_000}" for i in range(100_000)))]
    found = {r["doc_id"]: r for r in periodic.detected(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(x) for x in found[4]["runs"]] == [(0, 200_000, 1)] and found[4]["collapsed"] == "la"
    assert [tuple(x) for x in found[8]["runs"]] == [(0, 100_000, 20_000)]


def test_empty(spark, empty):
    assert periodic.report(empty).count() == 0 and periodic.detected(empty).columns == [*empty.columns, "n_words", "runs", "strongest", "collapsed"]
