"""Quality rules against brute force: base counts, the Kneser-Ney model, bands, and edge cases."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from skein.llm import perplexity

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base(text):
    text = text or ""
    w = SPLIT.findall(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    times = Counter(windows)
    again = {i + k for i, x in enumerate(windows) if times[x] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if SPLIT.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again)


def stream(text):
    w = SPLIT.findall(text or "")
    return f" {' '.join(w)} " if w else ""


def half(doc_id):
    return int(doc_id is not None and hashlib.md5(str(doc_id).encode()).hexdigest()[0] >= "8")


class KneserNey:
    """Interpolated, with three discounts for each order, from the definition."""

    def __init__(self, texts, order=perplexity.ORDER):
        self.counts = {order: Counter(s[i : i + order] for s in map(stream, texts) for i in range(len(s) - order + 1))}
        for m in range(order - 1, 0, -1):
            self.counts[m] = Counter(g[1:] for g in self.counts[m + 1])
        self.by_context = {m: defaultdict(list) for m in self.counts}
        self.d = {}
        for m, c in self.counts.items():
            for g, n in c.items():
                self.by_context[m][g[:-1]].append(n)
            n = Counter(c.values())
            d = [0.5, 1.0, 1.5]
            for k in (1, 2, 3):
                if n[k] and n[k + 1]:
                    v = k - (k + 1) * (n[1] / (n[1] + 2 * n[2])) * n[k + 1] / n[k]
                    d[k - 1] = v if 0.01 <= v <= k else k / 2
            self.d[m] = d

    def p(self, g):
        m = len(g)
        if not m:
            return 1 / (len(self.counts[1]) + 1)
        own = self.by_context[m].get(g[:-1])
        if not own:
            return self.p(g[1:])
        off = lambda n: self.d[m][min(n, 3) - 1]
        c = self.counts[m][g]
        return ((c - off(c)) / sum(own) if c else 0) + sum(map(off, own)) / sum(own) * self.p(g[1:])

    def surprise(self, text):
        s = stream(text)
        logs = [math.log(self.p(s[i : i + perplexity.ORDER])) if self.counts[1] else -1.0 for i in range(len(s) - perplexity.ORDER + 1)]
        return -1000 * sum(logs) / len(logs) if logs else None


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    vocabulary = {"en": "the of and thion lerin bast".split(), "de": "der ungen über straße und keit".split(), None: "abc bcd".split()}
    out = []
    for i in range(150):
        lang = r.choice(["en", "en", "de", None])
        words = [r.choice(vocabulary[lang]) + r.choice(["", "", "s", "ing", "#", str(r.randint(0, 9))]) for _ in range(r.randint(0, 60))]
        out.append((i, "".join(x + r.choice([" ", " ", "\n", "\t "]) for x in words), lang))
    odd = ["", None, "a", "ab", "abc", "\n\n", "same line of words here\n" * 6, "one two three four five " * 8, "Ωß→ 漢字 漢字 #*$%&|<>", "x\n\nx\n", "nul\x00 byte"]
    return [*out, *((500 + k, t, "en") for k, t in enumerate(odd)), out[7], (None, out[9][1], "en"), (900, "qzj xkv " * 30, "xx")]


@pytest.fixture(scope="module")
def table(spark, rows):
    schema = "doc_id long, text string, lang string, kept string, surprise int, n_words int, total int, lower int"
    return spark.createDataFrame([(*row, "x", 1, 2, 3, 4) for row in rows], schema).repartition(3)


def key(row):
    return str((row["doc_id"], row["lang"], *(row[c] for c in BASE)))


@pytest.fixture(scope="module")
def found(table):
    return sorted(perplexity.judged(table).collect(), key=key)


def test_rules_and_model(found, rows):
    models = {(g, h): KneserNey([t for i, t, lang in rows if (lang or "") == g and half(i) == h]) for g in ("en", "de", "", "xx") for h in (0, 1)}
    want = Counter()
    for i, t, lang in rows:
        s = models[lang or "", 1 - half(i)].surprise(t)
        want[(i, *base(t), None if s is None else round(s))] += 1
    got = Counter()
    for r in found:
        near = [x for x in want if x[0] == r["doc_id"] and x[1:6] == tuple(r[c] for c in BASE) and (x[6] is None if r["surprise"] is None else abs(x[6] - r["surprise"]) <= 1)]
        assert len(near) == 1, r
        got[near[0]] += 1
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    assert got == want


def test_verdicts_by_bands(found):
    """Bands from plain lists of all scores of a language."""
    scores = defaultdict(list)
    for r in found:
        if r["surprise"] is not None:
            scores[r["lang"]].append(r["surprise"])
    for r in found:
        if r["surprise"] is None:
            assert r["kept"] == (not r["base_failed"])
            continue
        all_ = sorted(scores[r["lang"]])
        q1, q3 = (all_[math.ceil(k * len(all_) / 4) - 1] for k in (1, 3))
        wide = 3 * (q3 - q1) + 6000 / math.sqrt(max(1, r["n_grams"]))
        assert r["kept"] == (not r["base_failed"] and q1 - wide <= r["surprise"] <= q3 + wide)


@pytest.mark.parametrize("most", [0, "parts"])
def test_large_models(spark, table, found, most):
    """A model that is too large for tasks gives the same rows in parts, and by joins."""
    from skein.llm import common

    if most == "parts":
        shelf = common.Shelf(spark)
        model = perplexity.entries(perplexity.counted(perplexity.rows_of(table)), shelf)
        sizes = {(r["lang"], r["half"]): r["count"] for r in model.groupBy(*perplexity.KEYS).count().collect()}
        shelf.drop("model")
        most = max(sizes.values())
        assert len(perplexity.parted(sizes, most)) > 1 and sum(len(p) for p in perplexity.parted(sizes, most)) == len(sizes)
    assert sorted(perplexity.judged(table, model_rows=most).collect(), key=key) == found


def test_noise_is_rejected(spark):
    r = random.Random(1)
    words = "the of and to thion lerin bast mund vion stre".split()
    rows = [(i, " ".join(r.choice(words) for _ in range(150)), "en") for i in range(80)]
    rows += [(1000, " ".join("".join(r.choice("qwxzj79_=") for _ in range(9)) for _ in range(100)), "en")]
    kept = {x["doc_id"]: x["kept"] for x in perplexity.report(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not kept.pop(1000) and all(kept.values())


def test_without_language_and_empty(spark, empty):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "doc_id int, text string")
    assert [(x["kept"], x["n_words"]) for x in perplexity.report(docs).collect()] == [(True, 10)]
    assert perplexity.report(empty).count() == 0


def test_intermediate_tables_go(spark, found):
    import pathlib

    from skein.llm import common

    shared = pathlib.Path(common.checkpoint_dir(spark).removeprefix("file:"))
    assert not [p for name in ("grams", "model", "open-grams", "closed-grams", "probabilities") for p in shared.glob(f"{name}-*")]
