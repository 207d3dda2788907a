import random

import pytest

WORDS = "the of and thion ering anded the heing ofthe and whated erble tion stre noun vion lerin bast mund".split()


def sentence(r, n):
    return " ".join(r.choice(WORDS) + str(r.randint(0, 30)) * (r.random() < 0.5) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows (doc_id, text): passages that repeat, near and exact copies, empty, null, tiny and very long texts, equal rows."""
    r = random.Random(5)
    passages = [sentence(r, 60) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [sentence(r, r.randint(3, 90)) for _ in range(r.randint(1, 3))]
        if i % 3 == 0:
            parts.insert(r.randint(0, len(parts)), r.choice(passages))
        rows.append((i, "\n".join(parts)))
    base = rows[7][1].split(" ")
    for k in range(8):  # near copies
        words = list(base)
        words[k * 5 % len(words)] = f"new{k}"
        rows.append((100 + k, " ".join(words)))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, ""), (203, None), (204, "Éé Ü\tone two"), (205, "\n \n"), (206, "x" * 350), (207, "ab " * 3000), (208, "a b c")]
    rows += [rows[5]]  # a row that stands twice
    return rows


@pytest.fixture
def docs(spark, corpus):
    """With columns that clash with names the operators use."""
    clashing = ("source", "n", "key", "node", "gone", "dropped", "kept_text", "row_hash", "a", "b", "last", "label", "pos", "word", "length", "salt", "rank", "places", "set_key", "held_out")
    schema = "doc_id long, text string, " + ", ".join(f"{c} string" for c in clashing)
    return spark.createDataFrame([(i, t, *clashing) for i, t in corpus], schema)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, lang string")
