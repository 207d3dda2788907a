"""Keyed tables: merging, reruns, conflicts, failures, compaction."""

import pytest
from pyspark.sql import functions as F
from skein.operators import graph
from skein.sources import keyed


@pytest.fixture
def table(spark, tmp_path):
    return keyed.KeyedTable(spark, str(tmp_path / "t"), "id long, v string", ["id"], buckets=4)


def rows(spark, *found):
    return spark.createDataFrame(found, "id long, v string")


def held(table):
    got = table.read().collect()
    assert len({r["id"] for r in got}) == len(got)
    return {r["id"]: r["v"] for r in got}


def test_newer_batches_win_and_repeats_do_nothing(spark, table):
    assert held(table) == {}
    assert table.merge(rows(spark, (1, "a"), (2, "b"), (2, "b")), "one")
    assert table.merge(rows(spark, (2, "new"), (3, None)), "two")
    assert held(table) == {1: "a", 2: "new", 3: None}
    assert not table.merge(rows(spark, (1, "again")), "one")
    assert held(table) == {1: "a", 2: "new", 3: None}


@pytest.mark.parametrize("bad", [[(1, "x"), (1, "y")], [(None, "x")]])
def test_a_conflict_refuses_the_whole_batch(spark, table, bad):
    table.merge(rows(spark, (1, "a")), "one")
    with pytest.raises(keyed.Conflict):
        table.merge(rows(spark, (5, "fine"), *bad), "two")
    assert held(table) == {1: "a"} and table.manifest().batches == ["one"]


def test_rerun_after_a_failure(spark, table, monkeypatch):
    """The data is written, the manifest isn't: nothing is seen, and the same batch can be merged again."""
    table.merge(rows(spark, (1, "a")), "one")

    def fail(*a):
        raise OSError("lost")

    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(table, "_commit", fail)
        table.merge(rows(spark, (1, "b")), "two")
    assert held(table) == {1: "a"}
    assert table.merge(rows(spark, (1, "b")), "two") and held(table) == {1: "b"}
    assert table.vacuum() == 1 and held(table) == {1: "b"}


def test_two_writers(spark, table, monkeypatch):
    """Of two that start from one manifest the second loses, and can merge after that."""
    other = keyed.KeyedTable(spark, table.path, "id long, v string", ["id"], buckets=4)
    stale = other._number()
    table.merge(rows(spark, (1, "a")), "one")
    with monkeypatch.context() as m, pytest.raises(keyed.Lost):
        m.setattr(other, "_number", lambda: stale)
        other.merge(rows(spark, (2, "b")), "two")
    assert other.merge(rows(spark, (2, "b")), "two") and held(table) == {1: "a", 2: "b"}


def test_compaction_rewrites_touched_buckets_only(spark, table):
    table.merge(rows(spark, *[(i, "old") for i in range(50)]), "one")
    assert table.compact() == ["0", "1", "2", "3"] and table.compact() == []
    before = table.manifest()
    table.merge(rows(spark, (7, "new")), "two")
    touched = table.compact()
    now = table.manifest()
    assert len(touched) == 1 and now.deltas == [] and [b for b in before.base if before.base[b] != now.base[b]] == touched
    assert held(table) == {i: "new" if i == 7 else "old" for i in range(50)}
    assert not table.merge(rows(spark, (7, "x")), "one")


def test_graph_import(spark, tmp_path):
    """Exported nodes and edges are merged by their keys; a second export of the same changes nothing."""
    entities = spark.createDataFrame([("e1", "a", "T", ["x", "y"], 1), ("e2", "b", "T", None, 0)], "entity_id string, name string, type string, synonyms array<string>, source_chunk_count long")
    relations = spark.createDataFrame([("r1", "e1", "R", "e2", 2, 0.5), ("r2", "e1", "R", "gone", 1, 0.5)], "relation_id string, src_id string, relation_type string, dst_id string, support_count long, confidence double")
    supports = spark.createDataFrame([("r1", "v1"), ("r1", "v1"), ("r2", "v1"), ("r1", "lost")], "relation_id string, evidence_id string")
    evidence = spark.createDataFrame([("v1", "c1", "A"), ("v2", None, "B")], "evidence_id string, chunk_id string, evidence_level string")
    found = graph.exported(entities, relations, supports, evidence)
    assert {n: df.count() for n, df in found.items()} == {"entity": 2, "chunk": 1, "evidence": 2, "relation": 1, "supported_by": 1, "from_chunk": 1}
    for batch in ("one", "two"):
        for name, df in found.items():
            schema, key = graph.EXPORT[name]
            keyed.KeyedTable(spark, str(tmp_path / name), schema, key, buckets=2).merge(df, batch)
    back = keyed.KeyedTable(spark, str(tmp_path / "entity"), *graph.EXPORT["entity"], buckets=2).read()
    assert {(r["entity_id"], r["synonyms"]) for r in back.collect()} == {("e1", "x|y"), ("e2", None)}
    assert back.where(F.col("name") == "a").count() == 1
