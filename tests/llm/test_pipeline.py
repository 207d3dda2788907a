"""The pipeline's stages, each against brute force on its own input."""

import corpus_pipeline
import pyspark.sql.functions as F
from skein.llm import common
from test_llm_operators import contaminated, roots, words


def test_pipeline(spark, corpus, tmp_path):
    bad = [(400 + i, " | ".join(f"Cell{k}" for k in range(20 + i))) for i in range(30)]
    dirty = {i for i, _ in bad}
    line = "A line that stands in many documents of this corpus"
    rows = [(i, f"{t}\n{line}", "en", "src", len(t)) for i, t in [*dict(corpus).items(), *bad] if t]
    rows += [(700, " ".join(words(rows[2][1])[:14]), "en", "src", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, " ".join(words(rows[4][1])[:20]))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = [(i, int(i not in dirty), 0) for i, *_ in rows]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    at = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        at[name] = now = common.written(stage(spark, now, str(tmp_path)), "stage")
        if name != "best-fit packing":
            assert now.schema.simpleString() == docs.schema.simpleString()
    texts = lambda name: {r["doc_id"]: r["text"] for r in at[name].select("doc_id", "text").collect()}
    first = texts("quality classifier")
    assert not dirty & set(first)
    lines = texts("line dedup")
    assert {i for i, t in lines.items() if line in t} == {max(i for i, t in first.items() if line in t)}
    want, _ = roots(lines)
    near = texts("MinHash near-dedup")
    assert set(near) == {i for i in want if want[i] == i}
    verdicts = contaminated(near, items)
    assert set(texts("benchmark decontamination")) == {i for i, v in verdicts.items() if not v[4]}
    packed = at["best-fit packing"]
    assert {r["doc_id"] for r in packed.collect()} == set(texts("benchmark decontamination"))
    again = corpus_pipeline.run(spark, str(tmp_path)).drop("sequence_id", "offset")
    assert again.exceptAll(packed.select(again.columns)).count() == 0 and again.agg(F.count("*")).first()[0] == packed.count()
