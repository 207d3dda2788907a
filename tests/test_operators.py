"""Operators over small tables: invariants, worked cases and seams."""

import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F
from skein.operators import catalog as sources
from skein.operators import chunking, cleaning, evaluation, graph, matching, quality, ranks, resolution, retrieval, runs, search
from skein.plans import catalog, views
from skein.sources import edge, tables
from skein.streaming import ingest


@pytest.mark.parametrize(("line", "level"), [("第一章 引言", 1), ("2.1 Methods", 2), ("IV. Results", 1), ("ABSTRACT", 1), ("x" * 91, 0), ("plain words here", 0)])
def test_headings(line, level):
    assert chunking.heading(line) == level


def seg(n, page=1):
    return chunking.Segment(page, " ".join(["word"] * round(n / 0.6)), ())


def test_packing_of_segments():
    sizes = chunking.Sizes(target=520, overlap=90, least=180, most=760)
    found = chunking.packed([seg(100), seg(200), seg(300), seg(400), seg(90)], sizes)
    assert [c["idx"] for c in found] == list(range(len(found)))
    assert all(c["tokens"] <= sizes.most + sizes.target for c in found)
    # The last segment of a chunk opens the next one.
    assert found[0]["segments"] >= 2 and found[1]["text"].startswith("word")
    assert chunking.packed([], sizes) == []
    assert len(chunking.packed([seg(10)], sizes)) == 1


def test_chunks_of_documents(spark):
    text = "1 Introduction:\n" + "\n".join(f"This is sentence number {i} of the text." for i in range(400)) + "\f2 Methods:\nA short page with enough words to be kept."
    found = chunking.chunked(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")).orderBy("idx").collect()
    assert {r["doc_id"] for r in found} == {1}
    assert [r["chunk_id"] for r in found] == [f"1_c{i:04d}" for i in range(len(found))]
    assert found[0]["heading_path"] == ["1 Introduction:"] and found[-1]["page_end"] == 2
    assert all(r["tokens"] == chunking.tokens(r["text"]) for r in found)


def test_neighbours_are_inverse(spark):
    rows = spark.createDataFrame([(o, t) for o in range(3) for t in range(4)], "owner long, turn long")
    found = chunking.linked(rows, "owner", "turn").collect()
    by = {r["chunk_id"]: r for r in found}
    assert all(by[r["next_id"]]["prev_id"] == r["chunk_id"] for r in found if r["next_id"])
    assert sum(r["prev_id"] is None for r in found) == 3


@pytest.mark.parametrize(("first", "second", "want"), [("ok", "error", 1), ("error", "ok", 2), ("ok", "ok", 2), ("error", "error", 2)])
def test_run_merge(spark, first, second, want):
    rows = spark.createDataFrame([(7, 1, first), (7, 2, second)], "k long, seq long, status string")
    assert runs.merged(rows, "k", "seq", F.col("status") == "ok").first()["seq"] == want


def test_next_index(spark):
    for seen, want in (([], 0), ([0, 1, 2, 4], 3), ([1, 2], 0), ([0, 1], 2)):
        assert runs.next_index(spark.createDataFrame([(i,) for i in seen], "i long"), "i").first()[0] == want


ENTITIES = [
    ("a", "autism", "Condition", []), ("t", "ADOS", "AssessmentTool", ["观察表"]), ("s", "children", "AgeStage", ["preschool"]), ("m", "fMRI", "AssessmentTool", None), ("y", "anxiety", "Symptom", []),
    ("v", "ABA training", "Intervention", []), ("l", "deep learning", "AssessmentTool", []), ("g", "imaging method", "AssessmentTool", []), ("k", "stroop task", "Claim", []), ("n", "thing", "Nonsense", []),
    ("q", "MRI deep learning scale", "AssessmentTool", []),
]


def test_entity_types_that_names_tell(spark):
    rows = spark.createDataFrame([("c", *e, "x") for e in ENTITIES], "chunk_id string, entity_id string, name string, type string, synonyms array<string>, kind string")
    found = {r["entity_id"]: (r["type"], r["reject_reason"]) for r in runs.typed(rows).collect()}
    assert found["l"] == ("Mechanism", None) and found["k"] == ("Task", None) and found["a"] == ("Condition", None)
    assert found["g"] == ("AssessmentTool", "generic_assessment_tool") and found["n"] == ("Nonsense", "invalid_entity_type") and found["m"] == ("AssessmentTool", None)


def test_first_reject_reason_wins(spark):
    entities = spark.createDataFrame([("c", *e) for e in ENTITIES], "chunk_id string, entity_id string, name string, type string, synonyms array<string>")
    good = "The study found that autism was assessed with ADOS in children."
    rows = [
        ("a", "MEASURED_BY", "t", good, "1.7", None), ("a", "LIKES", "gone", "", "x", "invalid_relation_type"), ("a", None, "t", good, "x", "invalid_relation_type"), ("a", "MEASURED_BY", "gone", "", "1", "orphan_relation"),
        ("a", "MEASURED_BY", "g", good, "1", "orphan_relation"), ("a", "MEASURED_BY", "s", good, "1", "illegal_relation_pair"), ("a", "MEASURED_BY", "t", "short.", "1", "weak_evidence_text"), ("a", "MEASURED_BY", "t", None, None, "weak_evidence_text"),
        ("a", "MEASURED_BY", "t", "autism screening and the ADOS", "1", None), ("a", "MEASURED_BY", "m", "autism screening and the fMRI", "1", "weak_evidence_text"), ("a", "MEASURED_BY", "m", "autism screening, fMRI accuracy", "1", None),
        ("a", "MEASURED_BY", "t", "An overview of ADOS, and of autism.", "1", "summary_style_measurement"), ("a", "MEASURED_BY", "t", "Autism was assessed with a scale, in a study.", "1", "tool_not_mentioned"),
        ("a", "MEASURED_BY", "t", "自闭症儿童采用观察表进行评估，结果如下文所示一二三。", "1", None), ("y", "MEASURED_BY", "t", "It was measured with ADOS, they said.", "1", "source_not_mentioned"),
        ("a", "MEASURED_BY", "t", "ADOS was given to all of them, twice.", "1", "condition_measure_without_trigger"), ("a", "MEASURED_BY", "m", "Autism is seen by fMRI, so they say.", "1", "research_modality_without_clinical_signal"),
        ("y", "MEASURED_BY", "t", "ADOS for anxiety, in short and in all.", "1", "measurement_without_study_trigger"), ("y", "MEASURED_BY", "t", "ADOS was used for anxiety, in short.", "1", None),
        ("v", "SUITABLE_AGE", "s", "ABA is suited to every age, it says.", "1", "age_not_mentioned"), ("a", "SUITABLE_AGE", "s", "Autism is seen in children, it says.", "1", "weak_age_evidence"), ("v", "SUITABLE_AGE", "s", "ABA suits preschool groups, it says.", "-1", None),
        ("v", "SUITABLE_SETTING", "s", good, "1", "illegal_relation_pair"), ("a", "COMORBID_WITH", "a", good, "nan", None), ("y", "MEASURED_BY", "l", good, "1", "illegal_relation_pair"),
    ]
    table = spark.createDataFrame([("c", *r) for r in rows], "chunk_id string, src_id string, relation_type string, dst_id string, evidence_text string, confidence string, want string")
    found = runs.checked(table, entities).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r["reject_reason"] == r["want"] and 0 <= r["confidence"] <= 1, r
    # A name of the tool that tells an algorithm is told as a mechanism, so only synonyms of the check's own reach this reason.
    assert "algorithmic_tool_not_assessment" not in {r["reject_reason"] for r in found}


def test_revalidated_runs(spark):
    entities = spark.createDataFrame([(k, *e) for k in "cd" for e in ENTITIES[:3] + ENTITIES[7:8]], "chunk_id string, entity_id string, name string, type string, synonyms array<string>")
    good = "The study found that autism was assessed with ADOS in children."
    rows = [("c", "a", "MEASURED_BY", "t", good, 1.0), ("c", "a", "MEASURED_BY", "s", good, 1.0), ("c", "a", "LIKES", "s", good, 1.0)]
    relations = spark.createDataFrame(rows, "chunk_id string, src_id string, relation_type string, dst_id string, evidence_text string, confidence double")
    records = spark.createDataFrame([("c", "ok"), ("d", "error"), ("e", "ok")], "chunk string, status string")
    found = {r["chunk"]: (r["n_entities"], r["n_relations"], r["warnings"]) for r in runs.revalidated(records, "chunk", relations, entities).collect()}
    assert found == {"c": (3, 1, "generic_assessment_tool:1|illegal_relation_pair:1|invalid_relation_type:1"), "d": (0, 0, ""), "e": (0, 0, "")}


def test_chunk_of_a_short_document_stands_once():
    found = chunking.packed([chunking.Segment(1, "one two three", ()), chunking.Segment(2, "four", ("H",))])
    assert [(c["text"], c["segments"], c["page_end"], c["heading_path"]) for c in found] == [("one two three\n\nfour", 2, 2, ["H"])]


def test_resolution_of_a_very_long_chain(spark):
    """A thousand entities that share aliases two by two are one."""
    rows = [(f"e{i:04d}", f"n{i}", "T", [f"n{i + 1}"]) for i in range(1000)]
    tables.shared(spark)
    found = graph.resolved(spark.createDataFrame(rows, "entity_id string, name string, type string, synonyms array<string>"))
    assert {r["canonical_id"] for r in found.select("canonical_id").distinct().collect()} == {"e0000"}


def entities(spark):
    rows = [("e1", "ADOS", "AssessmentTool", ["scale"], 3, 1), ("e2", "Autism", "Condition", [], 1, 1), ("e3", "ados", "AssessmentTool", [], 5, 2), ("e4", "autism", "Risk", [], 2, 1)]
    return spark.createDataFrame(rows, "entity_id string, name string, type string, synonyms array<string>, source_chunk_count long, source_doc_count long")


def relations(spark):
    rows = [("r1", "e2", "MEASURED_BY", "e1", 2, 0.9), ("r2", "e2", "MEASURED_BY", "e3", 4, 0.5), ("r3", "e1", "RELATES", "e1", 1, 0.2), ("r4", "e4", "HAS_RISK", "e2", 3, 0.8)]
    return spark.createDataFrame(rows, "relation_id string, src_id string, relation_type string, dst_id string, support_count long, confidence double")


def test_degrees_sum_to_twice_the_edges(spark):
    found = {r["entity_id"]: r["degree"] for r in graph.degrees(entities(spark), relations(spark)).collect()}
    assert sum(found.values()) == 8 and found["e1"] == 3  # a loop counts twice


def test_flags_and_usage(spark):
    flags = {r["entity_id"]: r["flags"] for r in graph.entity_flags(entities(spark), relations(spark)).collect()}
    assert flags["e1"] == ["same_name_duplicate"] and "alias_type_conflict" in flags["e2"] and "single_chunk_entity" in flags["e2"]
    usage = {r["relation_id"]: r["qa_usage"] for r in graph.relation_flags(relations(spark), entities(spark)).collect()}
    assert usage == {"r1": "standard", "r2": "standard", "r3": "use_with_caution", "r4": "guardrailed_clinical_context"}


def test_merge_and_remap(spark):
    merged = graph.merged(entities(spark), ("AssessmentTool",))
    assert {(r["primary_id"], r["members"]) for r in merged.collect()} == {("e3", 2), ("e2", 1), ("e4", 1)}
    supports = spark.createDataFrame([("r1", "v1"), ("r2", "v1"), ("r2", "v2")], "relation_id string, evidence_id string")
    found = {(r["src_id"], r["dst_id"]): r for r in graph.remapped(relations(spark), merged, supports).collect()}
    assert set(found) == {("e2", "e3"), ("e4", "e2")}  # the loop is gone
    assert found["e2", "e3"]["support_count"] == 2 and found["e2", "e3"]["confidence"] == pytest.approx(0.7)


def test_resolution_is_transitive(spark):
    rows = [("a", "x", "T", ["p"]), ("b", "y", "T", ["q"]), ("c", "z", "T", ["p", "q"]), ("d", "x", "U", [])]
    table = spark.createDataFrame(rows, "entity_id string, name string, type string, synonyms array<string>")
    tables.shared(spark)
    assert {r["entity_id"]: r["canonical_id"] for r in graph.resolved(table).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d"}


@pytest.mark.parametrize("step", [1, 37])
def test_resolution_of_a_long_chain(spark, step):
    """Entities in a row, each sharing an alias with the next only, by rising ids and by scattered ones."""
    ids = [f"e{k * step % 101:03}" for k in range(101)]
    rows = [(e, f"name {e}", "T", [f"p{k}", f"p{k + 1}"]) for k, e in enumerate(ids)] + [("z", "p3", "U", []), ("z", "p3", "U", [])]
    table = spark.createDataFrame(rows, "entity_id string, name string, type string, synonyms array<string>")
    tables.shared(spark)
    assert sorted(tuple(r) for r in graph.resolved(table).collect()) == [*((e, "e000") for e in sorted(ids)), ("z", "z"), ("z", "z")]


def folded(rows):
    """The ordered reading, one entity after the other: entity_id -> (group, canonical_id)."""
    groups, of = [], {}
    for entity, kind, names in sorted(rows):
        names = {n for n in names if n}
        if not names:
            continue
        group = next((g for g in groups if g[1] == kind and g[2] & names), None)
        if group is None:
            groups.append(group := [entity, kind, set()])
        group[2] |= names
        of[entity] = group
    first = {}
    for g in groups:
        first.setdefault((g[1], min(g[2])), g[0])
    return {e: (g[0], min(g[2]), first[g[1], min(g[2])]) for e, g in of.items()}


def test_resolution_in_order_bridges_nothing(spark):
    rows = [("e1", "a", "T", []), ("e2", "b", "T", []), ("e3", "a", "T", ["b"]), ("e4", "b", "T", [])]
    found = {r["entity_id"]: r["group_id"] for r in resolution.groups_in_order(spark.createDataFrame(rows, "entity_id string, name string, type string, synonyms array<string>")).collect()}
    # The bridge joins the first group and brings it the other's alias; what comes later follows.
    assert found == {"e1": "e1", "e2": "e2", "e3": "e1", "e4": "e1"}


def test_resolution_in_order_as_the_fold(spark):
    """A thousand random inputs at once, each of a type of its own."""
    import random

    r = random.Random(4)
    rows = []
    for k in range(1000):
        size = r.choice([1, 2, 5, 9, 14])
        rows += [(f"{k:04d}_{i:02d}", f"t{k}", [r.choice(["", *"abcdefghij"[: r.choice([2, 5, 10])]]) for _ in range(r.randint(1, 4))]) for i in range(size)]
    # A chain, and an alias that most entities of a type share.
    rows += [(f"c{i:04d}", "chain", [f"n{i}", f"n{i + 1}"]) for i in range(200)] + [(f"h{i:04d}", "hot", ["hot" if i % 3 else f"x{i}", f"y{i % 7}"]) for i in range(300)]
    table = spark.createDataFrame([(e, n[0], t, n[1:]) for e, t, n in rows], "entity_id string, name string, type string, synonyms array<string>").repartition(4)
    found = resolution.canonical(table)
    got = {x["entity_id"]: (x["group_id"], x["canonical_name"], x["canonical_id"]) for x in found.collect()}
    assert got == folded(rows)


def test_relations_of_canonical_entities(spark):
    groups = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c")], "entity_id string, canonical_id string")
    rows = [(2, "b", "R", "c", "0.5", " late ", "v2", "k2", "d1"), (1, "a", "R", "c", "x", "  ", "v1", "k1", "d1"), (3, "a", "R", "c", None, "later", "v2", "k2", "d2"), (4, "a", "R", "gone", "1", "t", "v", "k", "d"), (5, "a", None, "c", "1", "t", "v", "k", "d"), (6, "a", "R", "b", "1", None, None, None, None)]
    mentions = spark.createDataFrame(rows, "seq int, src_id string, relation_type string, dst_id string, confidence string, evidence_text string, evidence_id string, chunk_id string, doc_id string")
    found = {(r["src_id"], r["dst_id"]): r for r in resolution.rekeyed(mentions, groups).collect()}
    one = found["a", "c"]
    assert (one["confidence"], one["support_count"], one["evidence_example"], one["support_evidence_ids"], one["support_doc_ids"]) == (0.1667, 2, "late", ["v1", "v2"], ["d1", "d2"])
    assert len(found) == 2 and (found["a", "a"]["support_count"], found["a", "a"]["evidence_example"], found["a", "a"]["support_chunk_ids"]) == (0, "", [])


def test_pilot_drops_what_the_sql_calls_noisy(spark):
    rows = [(1, "a", "found " * 9 + "ÉCOLE " * 41), (2, "a", "found " * 3), (3, "a", "found using " + "ÉCOLE " * 40)]
    found = sources.pilot(spark.createDataFrame(rows, "doc_id long, source_group string, text string"), "doc_id", "source_group", least=0)
    assert [(r["doc_id"], r["score"]) for r in found.collect()] == [(2, 6), (3, 4)]


def test_alias_in_two_groups(spark):
    groups = spark.createDataFrame([("T", 1, ["ADOS", "ados"]), ("T", 2, ["ados "]), ("U", 3, ["ados"])], "type string, group_id int, aliases array<string>")
    with pytest.raises(ValueError, match="T ados"):
        tables.alias_groups(groups)
    assert tables.alias_groups(groups.where("group_id <> 2")).count() == 2


def test_fallback_names_the_evidence(spark):
    rows = spark.createDataFrame([(1, 1), (0, 0)], "c int, g int").select(retrieval.fallback(F.col("c"), F.col("g")))
    assert [r[0] for r in rows.collect()] == ["See [C1] and relations [G1]", "No evidence was found."]


def test_both_percentiles(spark):
    found = quality.metric_summary(spark.range(1, 21), "id").first()
    assert (found["p95_index"], found["p95_rank"], found["median"], found["upper_median"]) == (20, 19, 10.5, 11)


@pytest.mark.parametrize("n", [0, 1, 2, 19, 20, 21, 500])
def test_exact_ranks(spark, n):
    import random

    r = random.Random(n)
    rows = [(r.choice("abbbbbb"), r.choice([None, 1.5, r.randint(0, 40) / 2])) for _ in range(n)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(3)
    got = {x["k"]: x for x in ranks.at_ranks(df, "x", {"p95": ranks.nearest95, "index": ranks.index95, "low": ranks.lower_median, "none": lambda m: m + 1}, ("k",)).collect()}
    for k in {k for k, x in rows if x is not None}:
        v = sorted(x for a, x in rows if a == k and x is not None)
        m = len(v)
        assert tuple(got[k]) == (k, m, v[max(1, -(-m * 95 // 100)) - 1], v[min(m, m * 95 // 100 + 1) - 1], v[(m + 1) // 2 - 1], None)
    assert set(got) == {k for k, x in rows if x is not None}
    one = quality.metric_summary(df, "x").first()
    v = sorted(x for _, x in rows if x is not None)
    assert one["n"] == len(v) and (one["least"], one["most"]) == ((v[0], v[-1]) if v else (None, None))


def test_ranks_need_no_single_task(spark):
    plan = quality.metric_summary(spark.range(1000), "id")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan or "SinglePartition" not in plan.split("Window")[-1]


def test_gates_in_full(spark):
    docs = [(i, "A", 0.0, 0.0) for i in range(95)] + [(100, "F", 0.5, 0.3), (101, "F", 0.5, 0.3), (102, "C", 0.0, 0.1), (103, "B", 0.05, 0.0), (104, "B", 0.0, 0.0)]
    graded = spark.createDataFrame(docs, "doc_id long, grade string, cjk_spaces double, noisy_lines double")
    found = quality.gate(graded).first()
    assert (found["n"], found["n_good"], found["n_spaced"], found["n_failed"], found["p95_cjk_spaces"], found["p95_noisy_lines"], found["passed"]) == (100, 97, 2, 2, 0.0, 0.0, True)
    assert not quality.gate(graded.where("doc_id >= 93")).first()["passed"] and not quality.gate(graded.limit(0)).first()["passed"]
    chunks = spark.createDataFrame([(i, f"text {i}", 300, []) for i in range(100)], "doc_id long, text string, tokens int, risk_flags array<string>")
    assert quality.chunk_gate(chunks, spark.range(100).withColumnRenamed("id", "doc_id")).first()["passed"]
    lacking = quality.chunk_gate(chunks, spark.range(150).withColumnRenamed("id", "doc_id")).first()
    assert (lacking["expected"], lacking["covered"], lacking["passed"]) == (150, 100, False)


def test_repeated_lines(spark):
    line = "a header of this book"
    docs = spark.createDataFrame([(k, "\n".join([line] * k), 10) for k in (5, 6)], "doc_id long, text string, pages int")
    assert [r["doc_id"] for r in quality.repeated_lines(docs).collect()] == [6]


def test_sample_can_be_drawn_again(spark):
    rows = spark.range(500).select("id", F.element_at(F.array(*map(F.lit, "ABCDF")), (F.col("id") % 5 + 1).cast("int")).alias("grade"))
    one, two = ({r["id"] for r in quality.stratified(rows, "id", 60).collect()} for _ in range(2))
    assert one == two and len(one) == 60


def test_vectors_in_blocks(spark, monkeypatch):
    vectors = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(50)], "vec_id long, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0])], "query_id long, embedding array<float>")
    want = {tuple(r) for r in retrieval.vector_topk(vectors, queries, 5).collect()}
    monkeypatch.setattr(retrieval, "QUERY_BYTES", 30)
    assert {tuple(r) for r in retrieval.vector_topk(vectors, queries, 5).collect()} == want and len(want) == 10


@pytest.mark.parametrize("most", [None, 12])
def test_words_that_texts_contain(spark, most):
    """Overlapping words, words within words, marks of patterns, null and empty ones; in one list and in several."""
    words = ["a", "ab", "abc", "b.*", "量表", "", None, "ab", "zzz"]
    rows = [(1, ["xabcx", "ab"], "q"), (2, ["b.*量表"], "q"), (3, [None, ""], "q"), (4, None, "q"), (5, [], "q"), (6, ["aaa", "a"], "q")]
    found = matching.contained(spark.createDataFrame(rows, "id int, texts array<string>, other string"), spark.createDataFrame([(w,) for w in words], "word string"), most)
    want = {(i, "q", w, w in texts) for i, texts, _ in rows if texts for w in words if w and any(t and w in t for t in texts)}
    got = [tuple(r) for r in found.collect()]
    assert found.columns == ["id", "other", "word", "exact"] and len(got) == len(want) and set(got) == want


def test_many_keywords_at_once(spark):
    entities = spark.range(2000).select(F.concat(F.lit("e"), "id").alias("entity_id"), F.concat(F.lit("name "), "id", F.lit(" end")).alias("name"), F.array().cast("array<string>").alias("synonyms"))
    words = spark.range(100_000).select((F.col("id") % 7).alias("query_id"), F.concat("id", F.lit(" end")).alias("keyword"))
    found = retrieval.entity_matches(entities, words)
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    # Keyword k stands in names that end in it: k, 1k, 11k, ..., of which 80 are kept.
    assert found.count() == sum(min(80, sum(str(i).endswith(str(k)) for i in range(k, 2000, 10 ** len(str(k))))) for k in range(2000))


def test_window_shows_the_words():
    text = "x" * 900 + " autism and ados " + "y" * 900
    part = retrieval.window(text, ["ados", "autism", " Ados ", "", None], 300)
    assert "autism and ados" in part and part.startswith("...") and part.endswith("...") and len(part) == 306
    assert retrieval.window(" short\n text ", ["a"], 300) == "short text" and retrieval.window(None, ["a"]) == "" and retrieval.window("a" * 9, ["a"], 0) == ""
    assert retrieval.window("b" * 700, ["a"], 600) == "b" * 600 + "..." and retrieval.window("b" * 700, [], 600) == "b" * 600 + "..."


def test_window_by_trying_every_start():
    import random

    r = random.Random(3)
    for _ in range(400):
        n, size = r.randint(1, 120), r.randint(3, 40)
        text = "".join(r.choice("aab c") for _ in range(n))
        text = " ".join(text.split())
        words = [w for w in {"".join(r.choice("abc") for _ in range(r.randint(1, 5))) for _ in range(r.randint(0, 4))}]
        spans = []
        for w in words:
            at = text.find(w)
            while at >= 0:
                spans.append((at, at + len(w), w))
                at = text.find(w, at + len(w))
        last = len(text) - size
        if last <= 0:
            continue
        starts = {0, last} | {max(0, min(s - size // 3, last)) for s, _, _ in spans} | {max(0, min(e - size * 2 // 3, last)) for _, e, _ in spans}
        worth = {}
        for at in starts:
            hits = [x for x in spans if x[0] < at + size and x[1] > at]
            if hits:
                worth[at] = (len({w for _, _, w in hits}), len(hits), sum(min(e, at + size) - max(s, at) for s, e, _ in hits), -min(s for s, _, _ in hits), -at)
        want = max(worth, key=worth.get) if worth else 0
        assert retrieval.best_start(len(text), size, retrieval._spans(text, words)) == want, (text, words, size)


def test_prompt_has_every_context(spark):
    questions = spark.createDataFrame([(1, "who")], "query_id long, query string")
    contexts = spark.range(1, 1203).select(F.lit(1).cast("long").alias("query_id"), F.col("id").cast("int").alias("rank"), F.concat(F.lit("t"), "id").alias("text"))
    named = contexts.select("query_id", "rank", F.lit("a").alias("src_name"), F.lit("SAYS").alias("relation_type"), F.lit("b").alias("dst_name"))
    prompt = retrieval.prompts(questions, contexts, named).first()["prompt"]
    texts, relations_ = prompt.removeprefix("Question: who\n\nTexts:\n").split("\n\nRelations:\n")
    assert texts.split("\n") == [f"[C{i}] t{i}" for i in range(1, 1203)]
    assert relations_.split("\n") == [f"[G{i}] a says b" for i in range(1, 21)]


def test_routes_and_policy(spark):
    rows = spark.createDataFrame([("是不是自闭症，能停药吗",), ("ADOS",), (" ",), ("what",)], "query string")
    assert [r["route"] for r in evaluation.routed(rows).collect()] == ["safety_boundary", "assessment_info", "unknown", "knowledge_qa"]
    flags = spark.createDataFrame([("diagnostic_boundary", False, False), ("knowledge_qa", False, True), ("knowledge_qa", False, False)], "route string, has_low boolean, has_research boolean")
    found = evaluation.policy(flags).collect()
    assert [r["answer_mode"] for r in found] == ["guardrailed_answer", "evidence_answer_with_research_boundary", "evidence_answer"]
    assert found[0]["forbidden"] == ["clinical_certainty", "diagnosis_from_single_symptom", "questionnaire_as_diagnosis"] and found[2]["forbidden"] == []


def test_agent_gate(spark):
    rows = spark.createDataFrame([("m", "p", "standard", 5, 5, 10.0), ("m", "p", "agent", 5, 5, 11.5), ("m", "q", "standard", 5, 5, 10.0), ("m", "q", "agent", 5, 5, 12.5)], "model string, profile string, pipeline string, successes long, passes long, p50 double")
    found = {r["profile"]: r for r in evaluation.agent_gate(rows).collect()}
    assert found["p"]["passed"] and found["p"]["overhead"] == pytest.approx(0.15) and not found["q"]["passed"]


def test_empty_answer_fails(spark):
    rows = spark.createDataFrame([("", "autism", ["autism"], False, False, False, 1, 1)], "answer string, context string, expect_terms array<string>, needs_guardrail boolean, needs_research boolean, dry_run boolean, n_contexts int, n_graph int")
    assert not evaluation.answer_checks(rows, ("see",), ("research",), ("is certain",), ("not ",)).first()["ok"]


def test_overstatement_needs_no_negation_near(spark):
    rows = spark.createDataFrame([("可以治愈",), ("目前不能治愈",), ("没有",)], "t string")
    found = [r[0] for r in rows.select(evaluation.overstated(F.col("t"), ("治愈",), ("不能",))).collect()]
    assert found == [True, False, False]


def test_policies_for_bad_rows(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n{"a": \n{"a": 2}\n')
    assert tables.read_jsonl(spark, str(tmp_path), "a int", "skip").count() in (2, 3)
    assert sorted(r["a"] for r in tables.read_jsonl(spark, str(tmp_path), "a int", "skip").collect()) == [1, 2]
    with pytest.raises(Exception, match="(?i)malformed"):
        tables.read_jsonl(spark, str(tmp_path), "a int", "raise").collect()


def test_pages_of_a_text(spark):
    docs = spark.createDataFrame([(1, "[PAGE 1]\na\n[PAGE 2]\nb"), (2, "no mark"), (3, None)], "doc_id long, text string")
    assert {(r["doc_id"], r["page_id"], r["text"]) for r in tables.pages(docs).collect()} == {(1, 1, "a"), (1, 2, "b"), (2, 1, "no mark")}


def test_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("1", ["a", "b"]), ("2", [])], "id string, xs array<string>")
    tables.write_csv(rows, str(tmp_path / "out"), "id")
    found = tables.read_csv(spark, str(tmp_path / "out"), ("id", "xs")).collect()
    assert {(r["id"], r["xs"]) for r in found} == {("1", "a|b"), ("2", None)}
    with pytest.raises(ValueError, match="ALIAS"):
        tables.check_header(["x"], "ALIAS")


def test_parsers_and_embedder(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        z.writestr("word/document.xml", f'<w:d xmlns:w="{w}"><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:p/></w:d>')
        z.writestr("word/media/a.png", b"x")
    (tmp_path / "a.DOCX").write_bytes(data.getvalue())
    (tmp_path / "b.pdf").write_bytes(b"%PDF")
    (tmp_path / "c.txt").write_bytes(b"no")
    found = {r["file_type"]: r for r in edge.parsed(tables.read_files(spark, str(tmp_path))).collect()}
    assert set(found) == {".docx", ".pdf"}
    assert (found[".docx"]["text"], found[".docx"]["n_images"]) == ("Hello", 1) and found[".pdf"]["status"] == "error"
    vectors = edge.embedded(spark.createDataFrame([("a b",), ("a b",), (None,)], "text string"), edge.HashEmbedder).collect()
    assert vectors[0]["embedding"] == vectors[1]["embedding"] and len(vectors[2]["embedding"]) == 64


def test_extractor_keeps_errors_as_rows(spark):
    def call(text):
        if "bad" in text:
            raise ValueError("refused")
        return json.dumps({"n": len(text)})

    chunks = spark.createDataFrame([("1", "d", "good"), ("2", "d", "bad")], "chunk_id string, doc_id string, text string")
    found = {r["chunk_id"]: r for r in edge.extracted(chunks, call, tries=2, wait=0.0).collect()}
    assert found["1"]["status"] == "ok" and found["2"]["error"] == "ValueError: refused"


def test_stream_takes_each_chunk_once(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()

    def put(name, ids):
        (source / name).write_text("".join(json.dumps({"chunk_id": i, "doc_id": "d", "text": i, "arrived": "2026-01-01T00:00:00Z"}) + "\n" for i in ids))

    def extract(batch):
        return batch.select("chunk_id", F.when(F.col("chunk_id") == "c", "error").otherwise("ok").alias("status"))

    for name, ids in (("1.json", ["a", "b"]), ("2.json", ["b", "c"])):
        put(name, ids)
        ingest.extract_stream(ingest.arriving(spark, str(source)), extract, out, str(tmp_path / "state")).awaitTermination(120)
    found = {r["chunk_id"]: (r["status"], r["n_records"]) for r in ingest.current(spark, out).collect()}
    assert found == {"a": ("ok", 1), "b": ("ok", 1), "c": ("error", 1)}


def test_windows_of_events(spark):
    rows = spark.createDataFrame([("2026-01-01 00:10:00", "x"), ("2026-01-01 00:50:00", "x"), ("2026-01-01 01:10:00", "x")], "ts string, event_type string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r["n"] for r in ingest.windowed_counts(rows).collect()) == [1, 2]


def test_query_variants(spark):
    rows = [(1, "who  has ASD", ["asd", "autism"]), (2, "screen", ["screen", "ASD"]), (3, None, None), (4, "q", ["w" * 300, "", "x"])]
    found = {r["i"]: r["variants"] for r in retrieval.query_variants(spark.createDataFrame(rows, "i int, query string, keywords array<string>")).collect()}
    assert found[1] == ["who  has ASD"] and found[2] == ["screen", "screen screen"] and found[3] == []
    assert [len(x) for x in found[4]] == [1, 220, 220] and found[4][2].startswith("q www")


def test_normalised_entities(spark):
    rows = [("T", " ADOS", ["a"], "long text", 1, 1), ("T", "ados", None, "text", 1, 2), ("T", "ados", ["b", ""], None, 2, 2), ("U", "ADOS", [], " ", None, None), ("T", None, ["x"], "y", 3, 3), ("T", "!", [], "z", 3, 3)]
    table = spark.createDataFrame(rows, "type string, name string, synonyms array<string>, description string, chunk_id int, doc_id int")
    found = {r["type"]: r for r in graph.normalised(table).collect()}
    assert set(found) == {"T", "U"}
    t = found["T"]
    assert (t["name"], t["n_mentions"], t["n_names"], t["description"], t["source_chunk_count"], t["source_doc_count"], t["synonyms"]) == ("ados", 3, 2, "text", 2, 2, ["ADOS", "a", "ados", "b"])
    assert found["U"]["description"] is None and found["U"]["source_chunk_count"] == 0


def test_lists_samples_and_coverage(spark):
    docs = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(9)], "doc_id long, kind string")
    none, some = docs.where("doc_id < 0"), docs.where("doc_id in (2, 5)").select("doc_id")
    assert sources.allowed(docs, none).count() == 9 and sources.allowed(docs, some).count() == 2
    assert tuple(sources.coverage(some, docs, "doc_id").first()) == (9, 2, 2 / 9) and tuple(sources.coverage(some, none, "doc_id").first()) == (0, 0, 1.0)
    assert [tuple(r) for r in sources.most_common(docs.unionByName(docs.where("kind = 'b'")), "kind", "doc_id", 2).collect()] == [("b", 6), ("a", 3)]
    drawn = [r["doc_id"] for r in sources.shuffled_head(docs, "doc_id", 7, 4).collect()]
    assert drawn == [r["doc_id"] for r in sources.shuffled_head(docs.repartition(3), "doc_id", 7, 4).collect()] and len(set(drawn)) == 4
    joined = sources.with_catalog(docs, spark.createDataFrame([(1, "x", "y"), (1, "x", "y")], "doc_id long, kind string, title string"))
    assert joined.count() == 9 and joined.where("title = 'y'").count() == 1
    questions = docs.withColumnRenamed("doc_id", "id")
    assert [r["id"] for r in sources.selected(questions, some.withColumnRenamed("doc_id", "id"), "id", 1).collect()] == [2] and sources.selected(questions, None, "id").count() == 9


def test_alias_candidates(spark):
    old = spark.createDataFrame([("ADOS", "s1", ["x"])], "entity_name string, student_id string, aliases array<string>")
    rows = spark.createDataFrame([(1, "ADOS", "a"), (2, "ABA", "x; ;ABA"), (3, "ABA", "later"), (4, "CARS", None), (5, None, "n")], "row int, entity_name string, aliases string")
    found = {(r["entity_name"], r["student_id"]): r["aliases"] for r in tables.alias_candidates(old, rows, "s1").collect()}
    assert found == {("ADOS", "s1"): ["x"], ("ABA", "s1"): ["x", "ABA"], ("CARS", "s1"): ["CARS"], ("", "s1"): ["n"]}
    assert tables.alias_candidates(old, rows, "s2").count() == 5


def test_evidence_by_rank_and_trace(spark):
    r = relations(spark)
    supports = spark.createDataFrame([("r1", "v1"), ("r2", "v2"), ("r2", "v3"), ("r4", "v1")], "relation_id string, evidence_id string")
    evidence = spark.createDataFrame([("v1", "c1"), ("v2", "c2"), ("v3", None)], "evidence_id string, chunk_id string")
    ranked = spark.createDataFrame([("e4", 1), ("e2", 2)], "entity_id string, rank int")
    found = [tuple(x) for x in graph.ranked_entity_evidence(ranked, r, supports, evidence, 3).collect()]
    assert found == [(1, "e4", "v1", "c1"), (2, "e2", "v1", "c1"), (2, "e2", "v2", "c2")]
    assert {tuple(x) for x in graph.evidence_trace(r, supports, evidence).collect()} == {("r2", "v2", "c2"), ("r2", "v3", None)}


def cleaned(spark, *texts, **rules):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, pages string")
    return [r.asDict() for r in cleaning.cleaned(docs, **rules).orderBy("doc_id").collect()]


def test_cleaning_of_pages(spark):
    pages = [f"Journal of Things\nwrapped line {i}\ngoes on here {i}.\n{i}\n• a bullet" for i in range(1, 8)]
    text = "cover\n" + "\n".join(f"[PAGE {i}]\r\n{p}" for i, p in enumerate(pages, 1))
    (got,) = cleaned(spark, text)
    # The header and the bullet stand on seven pages and go; page numbers are noise; the text before the first mark is left out.
    assert got["page_texts"] == [f"wrapped line {i} goes on here {i}." for i in range(1, 8)]
    assert got["repeated_lines"] == 2 and got["pages"] == 7 and got["status"] == "ok"
    assert got["text"] == "\n\n".join(f"[PAGE {i}]\n{t}" for i, t in enumerate(got["page_texts"], 1))
    assert got["flags"] == ["too_short"]


def test_cleaning_of_references_and_noise(spark):
    body = "\n".join(f"Sentence number {i} ends." for i in range(20))
    got = cleaned(spark, f"{body}\nN e u r o n s.\na ^ b | c ` d e f g h i j k l m\nReferences\nOne, A. (2000).", None, " \n\t", "")
    assert got[0]["references_trimmed"] and "2000" not in got[0]["text"] and got[0]["text"].endswith("Neurons.")
    assert got[0]["noisy_lines"] == 1 and got[0]["word_joins"] == 6 and "references_trimmed" in got[0]["flags"]
    for empty in got[1:]:
        assert (empty["status"], empty["error"], empty["flags"], empty["text"], empty["pages"]) == ("error", "no_pages", ["no_pages"], "", 0)
    tail = cleaned(spark, "[PAGE 1]\nwords.\n[PAGE 2]\nReferences\nmore", least_chars=1)[0]
    assert tail["flags"] == ["empty_tail_page", "references_trimmed"]


def test_cleaning_of_long_and_repeated_lines(spark):
    line = "y" * 61
    few, many = cleaned(spark, "\n".join(["short."] * 5), "\n".join(["short."] * 6 + [line] * 9))
    assert few["page_texts"] == ["\n".join(["short."] * 5)] and few["repeated_lines"] == 0
    # A paragraph takes further lines until it has 280 characters; long lines are never headers.
    assert many["repeated_lines"] == 1 and [len(p) for p in many["page_texts"][0].split("\n")] == [309, 247]
    assert cleaned(spark) == []


def test_cleaning_summary(spark):
    docs = spark.createDataFrame([(1, "words here."), (2, None)], "doc_id long, text string")
    got = {r["measure"]: r["value"] for r in cleaning.summary(cleaning.cleaned(docs)).collect()}
    assert got == {"status:ok": 1, "status:error": 1, "language:en": 1, "language:unknown": 1, "flag:too_short": 1, "flag:no_pages": 1, "raw_chars": 11, "clean_chars": 20}


def test_overstatement_looks_around_every_place(spark):
    texts = ["治愈", "不能" + "x" * 22 + "治愈", "不能" + "x" * 23 + "治愈", "治愈" + "x" * 10 + "不能", "治愈" + "x" * 11 + "不能", "不能治愈" + "x" * 40 + "治愈", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    found = [r[0] for r in rows.orderBy("i").select(evaluation.overstated(F.col("t"), ("治愈", "包好"), ("不能", "not (yet)"))).collect()]
    assert found == [True, False, True, False, True, True, False, None]
    assert rows.where("i = 1").select(evaluation.overstated(F.col("t"), ("治愈",), ())).first()[0]


def test_metrics_without_values(spark):
    rows = spark.createDataFrame([(True, None, 3), (False, None, None)], "a boolean, b boolean, n long")
    got = {r["metric"]: r.asDict() for r in evaluation.metrics_summary(rows, ["a", "b"], ["n"]).collect()}
    assert set(got) == {"a", "n"} and (got["a"]["passed"], got["a"]["total"], got["a"]["rate"]) == (1, 2, 0.5)
    assert (got["n"]["least"], got["n"]["most"], got["n"]["mean"], got["n"]["total"]) == (3, 3, 3.0, 1)
    assert evaluation.metrics_summary(rows.where("false"), ["a"], ["n"]).count() == 0


def test_compare_of_nothing_and_of_ties(spark):
    rows = spark.createDataFrame([("tie", None, None, True, 2, 0.5), ("agent_win", "c", "r", False, 5, 1.0)], "delta string, category string, route string, follow_up boolean, relation_delta long, seconds_delta double")
    one = evaluation.compare_summary(rows).first()
    assert (one["total"], one["improved"], one["regressed"], one["tied"], one["follow_up_rate"], one["relation_delta_avg"], one["seconds_delta_max"]) == (2, 1, 0, 1, 0.5, 3.5, 1.0)
    assert evaluation.compare_summary(rows.where("false")).first()["follow_up_rate"] == 0.0
    assert {(r["kind"], r["name"], r["delta"], r["n"]) for r in evaluation.compare_counts(rows).collect()} == {("category", "uncategorized", "tie", 1), ("category", "c", "agent_win", 1), ("route", "unknown", None, 1), ("route", "r", None, 1)}


def test_pages_have_the_total(spark):
    rows = spark.range(45)
    got = retrieval.page(rows, ["id"], 3, 20).collect()
    assert [r["id"] for r in got] == list(range(40, 45)) and {r["total"] for r in got} == {45}
    assert retrieval.page(rows.where("false"), ["id"]).count() == 0


def test_curated_merge(spark):
    rows = [
        ("e1", "ADOS", "Tool", ["a. d. o. s."], 5, 1), ("e2", "Autism  Schedule", "Tool", [], 9, 1), ("e3", "CARS!", "Tool", None, 1, 1), ("e4", "cars", "Tool", [], 1, 1),
        ("e5", "ados", "Age", [], 0, 0), ("e6", "ados", "Age", [], 0, 0), ("e7", None, "Tool", [], 2, 2), ("e8", "x", None, [], 1, 1), ("e9", "x", None, [], 1, 1),
    ]
    e = spark.createDataFrame(rows, "entity_id string, name string, type string, synonyms array<string>, source_chunk_count long, source_doc_count long")
    keyed = graph.merge_keys(e, spark.createDataFrame([("Tool", "ados", "autism schedule")], "type string, group_id string, alias string"), ("Tool",))
    got = {r["entity_id"]: r for r in graph.curated(keyed).collect()}
    assert set(got) == {"e2", "e4", "e5", "e6", "e7", "e8", "e9"}
    assert (got["e2"]["name"], got["e2"]["synonyms"], got["e2"]["flag"]) == ("Autism  Schedule", ["ADOS", "a. d. o. s."], "merged_by:curated_alias_map")
    assert (got["e4"]["name"], got["e4"]["synonyms"], got["e4"]["members"]) == ("cars", ["CARS!"], 2) and got["e5"]["flag"] is None
    log = {r["merge_key"]: r for r in graph.merge_log(keyed).collect()}
    assert set(log) == {"curated:ados", "cars"} and log["cars"]["names"] == ["CARS!", "cars"] and log["curated:ados"]["source_chunk_count"] == 14
    assert graph.curated(keyed.where("false")).count() == 0


@pytest.mark.parametrize(
    ("query", "want", "without"),
    [
        ("如果量表正常，是否就不需要专业评估了？", {"评估", "专业评估", "ASD"}, set()), ("两三岁孩子社交反应少，家长想先做个筛查", {"筛查", "M-CHAT"}, set()), ("孩子语言少、不太看人，是不是就能判断为自闭症？", {"ASD", "诊断"}, set()),
        ("家庭训练和学校融合支持能否套用同一套孤独症干预方案？", {"家庭", "学校", "干预"}, set()), ("孤独症孩子睡不好还特别好动", {"睡眠", "注意力", "ADHD"}, set()), ("饮食干预是否可以治愈 ASD？", {"饮食干预", "治愈"}, {"干预"}),
        ("回答 ASD 知识问题时为什么需要说明文献证据来源？", {"证据"}, {"回答"}), ("blue Steel-7 blue", {"blue", "Steel-7"}, {"ASD"}), ("?", {"?"}, set()), (None, {""}, set()),
    ],
)
def test_keywords_of_a_query(spark, query, want, without):
    found = spark.createDataFrame([(query,)], "q string").select(retrieval.keywords(F.col("q"))).first()[0]
    assert want <= set(found) and not without & set(found) and len(found) == len(set(found))
    assert "ASD" not in found or found[0] == "ASD"


def test_relation_ends_with_ideographic_space_and_repeated_ids(spark):
    text = "The study found that autism was assessed with ADOS scale in children."
    entities = spark.createDataFrame([("c", "a", "autism", "Condition", []), ("c", "t", "ADOS\u3000 scale", "AssessmentTool", []), ("c", "t", "ADOS\u3000 scale", "AssessmentTool", ["x"])], "chunk_id string, entity_id string, name string, type string, synonyms array<string>")
    rows = spark.createDataFrame([("c", "a", "MEASURED_BY", "t", text, 1.0)], "chunk_id string, src_id string, relation_type string, dst_id string, evidence_text string, confidence double")
    assert [r["reject_reason"] for r in runs.checked(rows, entities).collect()] == [None]


def test_entities_without_a_chunk_are_known_where_they_are_named(spark):
    text = "The study found that autism was assessed with ADOS scale in children."
    rows = [("c1", "a", "MEASURED_BY", "t", text, 1.0), ("c1", "a", "MEASURED_BY", "gone", text, 1.0), ("c2", "t", "MEASURED_BY", "a", text, 1.0), (None, "a", "MEASURED_BY", "t", text, 1.0), ("c3", None, "MEASURED_BY", "bad", text, 1.0)]
    relations = spark.createDataFrame(rows, "chunk_id string, src_id string, relation_type string, dst_id string, evidence_text string, confidence double")
    entities = spark.createDataFrame([("a", "autism", "Condition", []), ("t", "ADOS scale", "AssessmentTool", []), ("t", "ADOS scale", "AssessmentTool", ["x"]), ("bad", "plain", "Nonsense", []), ("unnamed", "autism", "Condition", [])], "entity_id string, name string, type string, synonyms array<string>")
    records = spark.createDataFrame([("c1", "ok"), ("c2", "ok"), ("c3", "ok"), ("c4", "ok"), (None, "ok")], "chunk string, status string")
    ends = relations.select("chunk_id", F.explode(F.array("src_id", "dst_id")).alias("entity_id")).distinct()
    got = lambda e: sorted(map(tuple, runs.revalidated(records, "chunk", relations, e).collect()), key=str)
    assert got(entities) == got(entities.join(ends, "entity_id"))
    assert ("c1", "ok", 3, 1, "orphan_relation:1") in got(entities) and ("c3", "ok", 0, 0, "invalid_entity_type:1|orphan_relation:1") in got(entities)
    assert [r["reject_reason"] for r in runs.checked(relations.where("chunk_id is null"), entities).collect()] == ["orphan_relation"]


@pytest.fixture(scope="module")
def small_graph(spark):
    entities = spark.createDataFrame([(f"e{i}", n, [], 5, 2, False) for i, n in enumerate(["blue bolt", "blue gear", "red nut", "green cog", "far wheel", "alone"])], "entity_id string, name string, synonyms array<string>, source_chunk_count long, source_doc_count long, is_isolated boolean")
    edges = [("r0", "e0", "e2"), ("r1", "e2", "e3"), ("r2", "e3", "e4"), ("r3", "e1", "e0"), ("r4", "e0", "e0"), ("r5", "e2", None)]
    relations = spark.createDataFrame([(r, a, "R", b) for r, a, b in edges], "relation_id string, src_id string, relation_type string, dst_id string")
    supports = spark.createDataFrame([(r, f"v{r}") for r in ("r0", "r1", "r2", "r3")], "relation_id string, evidence_id string")
    evidence = spark.createDataFrame([(f"vr{k}", c) for k, c in enumerate(["k0", "k1", "k2", None])], "evidence_id string, chunk_id string")
    return search.indexed(entities, relations, supports, evidence)


def test_frontier_by_distance(spark, small_graph):
    seeds = spark.createDataFrame([(1, "e0"), (1, "e1"), (2, "e4"), (2, "e4"), (3, "e5")], "query_id long, entity_id string")
    found = {(r["query_id"], r["entity_id"]): (r["distance"], r["via"]) for r in search.expanded(seeds, small_graph.ways, 2).collect()}
    assert found == {(1, "e0"): (0, None), (1, "e1"): (0, None), (1, "e2"): (1, "e0"), (1, "e3"): (2, "e2"), (2, "e4"): (0, None), (2, "e3"): (1, "e4"), (2, "e2"): (2, "e3"), (3, "e5"): (0, None)}


def test_graph_search_and_its_trace(spark, small_graph):
    queries = spark.createDataFrame([(1, "blue"), (2, "alone"), (3, "nothing like it")], "query_id long, keyword string")
    found = search.searched(queries, small_graph)
    assert {(r["query_id"], r["chunk_id"], r["way"]) for r in found.chunks.collect()} == {(1, "k0", 0), (1, "k1", 0)}
    assert [(r["place"], r["relation_id"], r["other_id"]) for r in found.relations.where("query_id = 1").orderBy("place").collect()] == [(1, "r0", "e2"), (2, "r3", "e1"), (3, "r4", "e0"), (4, "r4", "e0"), (5, "r3", "e0")]
    rows = {(r["query_id"], r["stage"]): r["n"] for r in search.trace(queries, found).collect()}
    assert len(rows) == 15 and rows[1, "matched"] == 2 and rows[1, "frontier"] == 1 and rows[2, "ranked"] == 1 and rows[2, "chunks"] == 0 and rows[3, "matched"] == 0


def test_second_pass_for_those_that_need_it(spark, small_graph):
    rows = [(1, "blue 治愈", ["blue"]), (2, "alone 能诊断", ["alone"]), (3, "no hit", ["zzz"]), (4, "高压氧 zzz", ["zzz", "far"])]
    queries = evaluation.routed(spark.createDataFrame(rows, "query_id long, query string, keywords array<string>"))
    first = search.searched(queries.select("query_id", F.explode("keywords").alias("keyword")), small_graph)
    counted = search.flags(queries, first).withColumns({"n_low": F.lit(0), "n_research": F.lit(0)})
    plans = {r["query_id"]: r for r in search.planned(evaluation.follows_up(evaluation.inspected(counted))).collect()}
    assert set(plans) == {2, 3} and plans[2]["follow_keywords"][0] == "ASD" and plans[3]["follow_query"] == "no hit ASD 图谱证据 评估 干预" and plans[3]["follow_keywords"][:2] == ["zzz", "ASD"]
    second = search.searched(spark.createDataFrame([(3, "green"), (1, "blue")], "query_id long, keyword string"), small_graph)
    both = search.merged(first, second)
    n = {(r["query_id"], r["stage"]): r["n"] for r in search.trace(queries, both).collect()}
    assert n[3, "ranked"] == 1 and n[3, "chunks"] == 2 and n[1, "relations"] == 4 and n[1, "chunks"] == 2
    assert both.relations.groupBy("query_id", "place").count().where("count > 1").count() == 0


def test_stages_that_nobody_reads_are_not_written(spark, small_graph):
    files = lambda: sum(len(f) for _, _, f in os.walk(tables.shared(spark).removeprefix("file:")))
    queries = spark.createDataFrame([(q, w) for q in range(40) for w in ("blue", "blue", "alone")], "query_id long, keyword string")
    found = search.searched(queries, small_graph)
    before = files()
    found.entities.collect()
    assert files() == before
    # A keyword that a query lists twice counts once.
    assert found.matches.where("keyword = 'blue'").count() == 40 * 2


def test_chunks_behind_nodes_are_those_of_the_joined_tables(spark, tmp_path, monkeypatch):
    rows = {
        "lineitem": ([(k % 7, k % 5, k % 3, 1, 0.05, 0.0) for k in range(40)] + [(9, 1, 1, 1, 0.0, 0.0)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_discount double, l_tax double"),
        # Order 3 stands twice, under two customers; one order has no customer, and order 9 isn't there.
        "orders": ([(k, k % 4, "1-URGENT") for k in range(6)] + [(3, 1, "2-HIGH"), (6, None, "2-HIGH")], "o_orderkey long, o_custkey long, o_orderpriority string"),
        "supplier": ([(k, 2) for k in range(3)], "s_suppkey long, s_nationkey int"),
    }
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    # Short ids of one digit, so that relations of all kinds share them.
    short = views.T.short_id
    monkeypatch.setattr(views.T, "short_id", lambda prefix, *parts: short(prefix, *parts, size=1))
    d = str(tmp_path)
    whole = search.indexed(spark.createDataFrame([], "entity_id string"), views.relations(spark, d), views.supports(spark, d), views.evidence(spark, d))
    for nodes in (["cust_0", "cust_3", "supp_1", "part_2", "no such"], ["cust_1"], ["part_1"]):
        asked = spark.createDataFrame([(n,) for n in nodes], "entity_id string").checkpoint()
        want, found = (sorted(map(tuple, rows.collect())) for rows in (whole.begun(asked), views.begun(spark, d, asked)))
        assert found == want and (not want) == (nodes == ["part_1"])


def test_queries_with_the_same_entities_are_searched_once(spark, small_graph):
    # 1, 4 and 5 have the same ranked entities; 6 has the same ones in another order of words.
    rows = [(1, "blue"), (2, "red"), (4, "blue"), (5, "blue"), (6, "bolt"), (6, "blue gear"), (7, "no hit")]
    words = spark.createDataFrame(rows, "query_id long, keyword string")
    found = search.searched(words, small_graph)
    assert {tuple(r) for r in found.members.collect()} == {(1, 1), (4, 1), (5, 1), (2, 2), (6, 6)}
    assert {r["query_id"] for stage in search.LED for r in found.led(stage).collect()} == {1, 2, 6}
    of = lambda stage, q: sorted((tuple(r)[1:] for r in getattr(stage[0], stage[1]).where(F.col("query_id") == q).collect()), key=str)
    alone = {q: search.searched(words.where(F.col("query_id") == q), small_graph) for q in (1, 2, 5, 6)}
    for q, own in alone.items():
        for stage in ("entities", *search.LED):
            assert of((found, stage), q) == of((own, stage), q) != [], (q, stage)
    # Both passes: 4 alone has another second pass.
    both = search.merged(found, search.searched(spark.createDataFrame([(4, "far"), (7, "far")], "query_id long, keyword string"), small_graph))
    assert {tuple(r) for r in both.members.collect()} == {(1, 1), (5, 1), (4, 4), (2, 2), (6, 6), (7, 7)}
    assert {r["entity_id"] for r in both.frontier.where("query_id = 4").collect()} == {"e0", "e1", "e2", "e3", "e4"} and both.frontier.where("query_id = 7").count() == 2


def test_passes_are_merged_once_for_queries_that_share_both(spark, small_graph):
    words = lambda rows: spark.createDataFrame(rows, "query_id long, keyword string")
    both = search.merged(search.searched(words([(q, "blue") for q in range(1, 9)]), small_graph), search.searched(words([(q, "far") for q in (3, 5, 7)]), small_graph))
    assert {q: {r["query_id"] for r in both.led(stage).collect()} for q, stage in enumerate(search.LED)} == dict.fromkeys(range(3), {1, 3})
    queries = spark.range(1, 10).select(F.col("id").alias("query_id"))
    told = {(r["query_id"], r["stage"]): (r["n"], r["first"]) for r in search.trace(queries, both).collect()}
    assert len(told) == 45 and all(told[q, s] == told[3 if q in (5, 7) else 1, s] for q in (2, 4, 5, 6, 7, 8) for s in ("ranked", *search.LED))
    assert (told[1, "frontier"], told[3, "frontier"], told[3, "relations"][0], told[9, "chunks"]) == ((1, "e2"), (2, "e2"), told[1, "relations"][0] + 1, (0, None))


@pytest.mark.parametrize("sent", [0, 1000])
def test_relations_of_nodes_are_those_of_all_relations(spark, tmp_path, monkeypatch, sent):
    rows = {
        "lineitem": ([(k % 7, k % 5, k % 3, 1, 0.05, 0.0) for k in range(40)] + [(9, 1, 1, 1, 0.0, 0.0), (2, None, 1, 1, 0.0, 0.0), (2, 1, None, 1, 0.0, 0.0)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_discount double, l_tax double"),
        "orders": ([(k, k % 4, "1-URGENT") for k in range(6)] + [(3, 1, "2-HIGH"), (6, None, "2-HIGH")], "o_orderkey long, o_custkey long, o_orderpriority string"),
        "supplier": ([(k, 2) for k in range(3)], "s_suppkey long, s_nationkey int"),
    }
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    monkeypatch.setattr(views, "SENT_KEYS", sent)
    d = str(tmp_path)
    whole = search.told(spark.createDataFrame([], "entity_id string"), views.relations(spark, d), None)
    near = search.told(whole.entities, views.relations(spark, d), None, lambda nodes: views.related(spark, d, nodes))
    for nodes in (["cust_0", "cust_3", "supp_1", "part_2", "no such"], ["cust_1"], ["part_1"], ["nat_2"], ["supp_0"]):
        asked = spark.createDataFrame([(n,) for n in nodes], "entity_id string").checkpoint()
        want, found = (sorted(map(tuple, g.ways_of(asked).collect())) for g in (whole, near))
        assert found == want != []


@pytest.mark.parametrize("size", [12, 1])
def test_relations_between_merged_ends_are_those_of_the_joined_tables(spark, tmp_path, monkeypatch, size):
    rows = {
        "lineitem": ([(k % 7, k % 5, k % 3, 1, 0.05 + k / 1000, 0.0) for k in range(40)] + [(9, 1, 1, 1, 0.0, 0.0), (2, 1, None, 1, None, 0.0), (3, 4, 2, 1, None, 0.0)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_discount double, l_tax double"),
        # Order 3 stands twice, under two customers; one order has no customer, and order 9 isn't there.
        "orders": ([(k, k % 4, "1-URGENT") for k in range(6)] + [(3, 1, "2-HIGH"), (6, None, "2-HIGH")], "o_orderkey long, o_custkey long, o_orderpriority string"),
        "supplier": ([(k, f"firm {min(k, 1)}", 2) for k in range(3)], "s_suppkey long, s_name string, s_nationkey int"),
        # Part 4 isn't there.
        "part": ([(k, f"bolt {k % 2}", "a b") for k in range(4)], "p_partkey long, p_name string, p_type string"),
        "customer": ([(k, "same", "x", 2) for k in range(4)], "c_custkey long, c_name string, c_mktsegment string, c_nationkey int"),
        "nation": ([(2, "there")], "n_nationkey int, n_name string"),
    }
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    # Short ids of one digit, so that relations of all kinds share them.
    short = views.T.short_id
    monkeypatch.setattr(views.T, "short_id", lambda prefix, *parts: short(prefix, *parts, size=size))
    d, types = str(tmp_path), ("AssessmentTool", "Intervention")
    merged = graph.merged(views.entities(spark, d), types)
    want = sorted(map(tuple, graph.remapped(views.relations(spark, d), merged, views.supports(spark, d)).collect()))
    assert max(r[5] for r in want) > 1
    if size == 1:
        monkeypatch.setattr(views, "SENT_KEYS", 1)
    found = catalog.queries()["relation_remerge"](spark, d)
    assert sorted(map(tuple, found.collect())) == want
    # Neither relations nor supports are made: what is dealt has no short ids.
    assert "sha1" not in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("size", [12, 1])
def test_exported_edges_are_those_of_the_joined_tables(spark, tmp_path, monkeypatch, size):
    rows = {
        "lineitem": ([(k % 7, k % 5, k % 3, 1, 0.05 + k / 1000, 0.0) for k in range(40)] + [(9, 1, 1, 1, 0.0, 0.0), (2, 1, None, 1, None, 0.0), (3, 4, 2, 1, None, 0.0), (None, 1, 2, 1, 0.1, 0.0), (1, None, 2, 1, 0.1, 0.0)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_discount double, l_tax double"),
        # Order 3 stands twice, under two customers; one order has no customer, and order 9 isn't there.
        "orders": ([(k, k % 4, "1-URGENT") for k in range(6)] + [(3, 1, "2-HIGH"), (6, None, "2-HIGH")], "o_orderkey long, o_custkey long, o_orderpriority string"),
        # Part 4, customer 3, supplier 2 and nation 3 aren't there.
        "supplier": ([(0, "firm", 2), (1, "other", 3)], "s_suppkey long, s_name string, s_nationkey int"),
        "part": ([(k, f"bolt {k % 2}", "a b") for k in range(4)], "p_partkey long, p_name string, p_type string"),
        "customer": ([(k, "same", "x", 2) for k in range(3)], "c_custkey long, c_name string, c_mktsegment string, c_nationkey int"),
        "nation": ([(2, "there")], "n_nationkey int, n_name string"),
    }
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    # Short ids of one digit, so that relations of all kinds share them, those with an end that is no entity too.
    short = views.T.short_id
    monkeypatch.setattr(views.T, "short_id", lambda prefix, *parts: short(prefix, *parts, size=size))
    monkeypatch.setattr(views, "ID_DIGITS", size)
    monkeypatch.setattr(views, "SENT_KEYS", size)
    d, want = str(tmp_path), set()
    # An order without a customer is behind no relation, as in the SQL; it has an id here where its customer is left out.
    made = graph.exported(views.entities(spark, d), views.relations(spark, d), views.supports(spark, d).where("evidence_id <> 'ev_6'"), views.evidence(spark, d))
    for r in made["relation"].collect():
        want.add(("relation", r["start_id"], r["end_id"], r["type"], r["relation_id"], r["support_count"], round(r["confidence"], 9)))
    want |= {("supported_by", r["start_id"], r["end_id"], None, r["relation_id"], None, None) for r in made["supported_by"].collect()}
    edges = views.edges(spark, d)
    found = [(*r[:6], r[6] and round(r[6], 9)) for r in edges.collect()]
    assert len(found) == len(set(found)) and set(found) == want
    # Each table of lines is dealt by orders and by ids only: no joins of relations by their texts.
    assert edges._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1 + 5


def test_nodes_without_chunks_meet_no_query(spark, small_graph):
    # A seed around another seed isn't around the query; of a node's ways no more are followed than of all.
    seeds = spark.createDataFrame([(1, "blue"), (2, "bolt"), (3, "red"), (3, "far")], "query_id long, keyword string")
    found = search.searched(seeds, small_graph)
    assert {tuple(r) for r in found.chunks.collect()} == {(1, "k0", 0), (1, "k1", 0), (2, "k0", 0), (2, "k1", 0), (3, "k0", 0), (3, "k1", 0), (3, "k2", 0)}
    asked = []
    counted = search.Graph(small_graph.entities, small_graph.ways, lambda nodes: asked.append(sorted(r[0] for r in nodes.collect())) or small_graph.begun(nodes))
    assert search.searched(seeds.where("query_id = 2"), counted).chunks.count() == 2 and asked == [["e0", "e1", "e2"]]


def test_frontier_in_place_is_that_of_one_step(spark, small_graph):
    seeds = spark.createDataFrame([(1, "e0"), (1, "e1"), (2, "e2"), (3, "no such")], "query_id long, entity_id string")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(search._near(seeds, small_graph.ways)) == rows(search.expanded(seeds, small_graph.ways, 1))


def test_only_rows_that_can_be_first_leave_a_task(spark):
    rows = spark.createDataFrame([(f"e{i:03d}", ["red bolt", "ring"]) for i in range(300)], "entity_id string, texts array<string>").coalesce(1)
    words = spark.createDataFrame([("red",), ("ring",)], "word string")
    found = matching.contained(rows, words, first=("entity_id", 7))
    assert found.count() < 100
    first = found.where("word = 'red'").orderBy("entity_id").limit(7).collect()
    assert [r["entity_id"] for r in first] == [f"e{i:03d}" for i in range(7)]


def test_relations_that_share_a_short_id_are_both_kept(spark):
    entities = spark.createDataFrame([(e, e, "Condition", [], 1) for e in ("a", "b", "c")], "entity_id string, name string, type string, synonyms array<string>, source_chunk_count long")
    relations = spark.createDataFrame([("r", "a", "X", "b", 1, 0.5), ("r", "a", "X", "c", 2, 0.7), ("s", "b", "X", "b", 1, 0.1)], "relation_id string, src_id string, relation_type string, dst_id string, support_count long, confidence double")
    supports = spark.createDataFrame([("r", "v")], "relation_id string, evidence_id string")
    evidence = spark.createDataFrame([("v", "k", "A")], "evidence_id string, chunk_id string, evidence_level string")
    found = graph.exported(entities, relations, supports, evidence)
    assert found["relation"].count() == 3 and found["supported_by"].count() == 1
    assert graph.touching(relations, entities.where("entity_id in ('a', 'b')")).count() == 3


def test_vector_search_holds_blocks_of_scores():
    import numpy as np

    rng = np.random.default_rng(3)
    n, score, vec = np.zeros(9, np.int64), np.empty((9, 5)), np.empty((9, 5), np.int64)
    every, ids = rng.integers(-3, 4, (9, 60)).astype(float), rng.permutation(60)
    every[2, 4] = np.nan
    every[3] = np.nan
    for lo, hi in ((0, 3), (3, 40), (40, 60)):
        n = retrieval._kept_best(every[:, lo:hi], ids[lo:hi], n, score, vec)
    for q in range(9):
        want = np.lexsort((ids, -every[q]))[:5]
        assert n[q] == 5 and list(vec[q]) == list(ids[want]) and np.array_equal(score[q], every[q][want], equal_nan=True)
    assert retrieval.BLOCK_SCORES * 8 <= 64 << 20


def test_wrapped_lines_are_joined_from_codes_alone(spark):
    import random
    import re

    bullet = re.compile(r"[\-•·\d]+[\).、．\.]?\s+")

    def brute(lines):
        paragraphs, room = [], 0
        for line in lines:
            if room > 0 and not bullet.match(line):
                paragraphs[-1].append(line)
                room -= len(line) + 1
            else:
                paragraphs.append([line])
                room = 280 - len(line)
            if line[-1] in cleaning.PARAGRAPH_ENDS:
                room = 0
        return "\n".join(map(" ".join, paragraphs))

    rng = random.Random(5)
    words = ("word", "end.", "- item", "12) two", "•\u3000x", "٣ y", "3\x1cz", "日本。", "\U0001f600", "x" * 150, "y" * 300, '"', "7", "1.\u00a0a")
    pages = [[[rng.choice(words) for _ in range(rng.randrange(9))] for _ in range(rng.randrange(3))] for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(pages)), "id int, kept array<array<string>>")
    rows = rows.withColumn("opened", cleaning._opened_pages(F.transform("kept", lambda page: F.transform(page, cleaning.line_code))))
    found = {r["id"]: r["b"] for r in rows.select("id", F.zip_with("kept", "opened", cleaning.unwrapped).alias("b")).collect()}
    assert all(found[i] == [brute(lines) for lines in page] for i, page in enumerate(pages))


def test_gate_measures_texts_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def rate(k):
        seen.add(1)
        return k / 100

    rows = spark.range(0, 100, 1, 4).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3, "F").otherwise("A").alias("grade"), rate("id").alias("cjk_spaces"), F.lit(0.0).alias("noisy_lines"))
    found = quality.gate(rows).first()
    assert (found["n"], found["n_good"], found["n_spaced"], found["n_failed"], found["p95_cjk_spaces"], found["p95_noisy_lines"]) == (100, 97, 79, 3, 0.95, 0.0)
    assert seen.value == 100


def test_ranks_of_counted_values(spark):
    rows = [(k % 3, k % 7) for k in range(60)]
    once = spark.createDataFrame(rows, "g int, v int")
    counted = once.groupBy("g", "v").agg(F.count("*").alias("times"))
    wanted = {"low": ranks.lower_median, "top": ranks.index95}
    assert sorted(ranks.at_ranks(counted, "v", wanted, ("g",), "times").collect()) == sorted(ranks.at_ranks(once, "v", wanted, ("g",)).collect())


def test_flags_are_made_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def flags(k):
        seen.add(1)
        return ["even"] * (k % 2 == 0) + ["third"] * (k % 3 == 0)

    rows = spark.range(0, 60, 1, 4).select(flags("id").alias("flags"))
    assert sorted(map(tuple, quality.flag_distribution(rows).collect())) == [("even", 30), ("third", 20)] and seen.value == 60


def _small_graph(spark):
    kinds = ("AssessmentTool", "Condition", "Intervention", None)
    names = ("blue gear", "Steel ASD", "steel bolt", None, "plain", "deep blue steel", "MRI scanner")
    e = spark.createDataFrame([(f"e{k}", names[k % 7], kinds[k % 4], [f"s{k % 3}"]) for k in range(28)], "entity_id string, name string, type string, synonyms array<string>")
    r = [(f"r{k}", f"e{k * 5 % 30}", ("MEASURED_BY", "HAS_RISK", "BLUE_TO", None)[k // 7 % 4], f"e{k * 3 % 28}", (None, 1, 2, 5)[k % 4], (None, 0.2, 0.5, 0.9, float("nan"))[k % 5]) for k in range(300)]
    return e, spark.createDataFrame(r, "relation_id string, src_id string, relation_type string, dst_id string, support_count long, confidence double")


@pytest.mark.parametrize("words", [["blue", "steel", "asd"], ["deep blue", "bolt condition"], ["Tool", "zzz"], []])
def test_relations_are_ranked_by_what_their_ends_name(spark, words):
    e, r = _small_graph(spark)
    found = retrieval.relation_rank_of(r, e, words, 40)
    assert found.collect() == retrieval.relation_rank(graph.ended(r, e, "name", "type"), words, 40).collect()


def test_usage_is_counted_before_entities_are_met(spark):
    e, r = _small_graph(spark)
    whole = graph.relation_flags(r, e).groupBy("relation_type", "qa_usage", "flags").agg(F.count("*").alias("n"))
    assert sorted(map(repr, graph.usage_counts(r, e).collect())) == sorted(map(repr, whole.collect()))


@pytest.mark.parametrize(("name", "joins"), [("relation_rank", 2), ("relation_flags_usage", 1)])
def test_relations_meet_entities_once_for_an_end(spark, name, joins):
    """Beside the joins that relations and entities are made with: lines with orders, and three tables with their counts for each end."""
    import __spark_entry__ as entry

    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    own = sum(any(f"{end}_id" in line.split("Join", 1)[1] for end in ("src", "dst")) for line in plan.splitlines() if "Join " in line)
    assert own == joins
