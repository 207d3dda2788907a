"""Importance resampling against brute force, and edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from skein.llm import common, resample

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), Counter(zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1))


def expected(rows, target, percent=5):
    """(doc_id, n_features, weight, score, rank) of each row."""
    docs = [(i, *features(t)) for i, t in rows]
    s, t = Counter(), Counter()
    for _, _, f in docs:
        s += f
    for x in target:
        t += features(x)[1]
    s_all, t_all = sum(s.values()), sum(t.values())
    out = []
    for i, n, f in docs:
        weight = sum(c * math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000)))) for b, c in f.items())
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, sum(f.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    may = sorted((x for x in out if x[4] >= 20), key=lambda x: (-x[3], x[0] is None, x[0]))
    rank = {id(x): k + 1 for k, x in enumerate(may[: percent * len(may) // 100])}
    return [(*x[:4], rank.get(id(x))) for x in out]


def found(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in df.collect()), key=str)


@pytest.fixture
def target():
    r = random.Random(2)
    return [" ".join(r.choice("the of and thion lerin vion stre".split()) for _ in range(30)) for _ in range(20)] + [None, "", "Été ÉTÉ one"]


def test_resampling(spark, docs, corpus, target):
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    assert found(resample.report(docs, bench)) == sorted(expected(corpus, target), key=str)


def test_many_are_drawn_over_ranges(spark, corpus, target):
    r = random.Random(3)
    rows = [(i if i % 50 else None, " ".join(r.choice("the of and is stre x1 x2 x3".split()) for _ in range(r.randint(15, 40)))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(3)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.weights(docs, bench, percent=40)
    assert found(got) == sorted(expected(rows, target, 40), key=str)
    assert sorted(x["rank"] for x in got.where("rank is not null").collect()) == [*range(1, got.where("rank is not null").count() + 1)]


@pytest.mark.parametrize("limit", [1, 40, 1000])
def test_long_texts_in_pieces(spark, corpus, limit):
    """n-grams over the cuts are counted once."""
    counted = resample.spilled(spark.createDataFrame(corpus, "doc_id long, text string").where("doc_id in (1, 7, 203, 204, 208)"), limit).collect()
    assert len(counted) == 5
    for row in counted:
        n, want = features(dict(corpus)[row["doc_id"]])
        assert (row["n_words"], row["n_features"], Counter(np.frombuffer(row["features"], "<u2").tolist())) == (n, sum(want.values()), want)


def test_sample_keeps_columns(spark, docs, target):
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    drawn = resample.sample(docs, bench, percent=50)
    assert drawn.columns == docs.columns and 0 < drawn.count() < docs.count()


def test_empty(spark, empty, docs):
    assert resample.report(empty, empty).count() == 0
    assert resample.report(docs, empty).count() == docs.count()


def test_noise_is_a_function_of_the_id(spark):
    df = spark.range(3).select(resample.noise(resample.F.col("id"), 42).alias("a"), resample.noise(resample.F.col("id"), 43).alias("b"))
    rows = df.collect()
    assert len({r["a"] for r in rows} | {r["b"] for r in rows}) == 6 and rows == df.collect()


def test_intermediate_tables_go(spark, docs, target):
    import pathlib

    resample.weights(docs, spark.createDataFrame([(t,) for t in target], "text string")).count()
    shared = pathlib.Path(common.checkpoint_dir(spark).removeprefix("file:"))
    assert not [*shared.glob("resample-buckets-*")]
