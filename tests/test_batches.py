"""The batch loop: killed runs, items that fail, leases."""

import pytest
from pyspark.sql import functions as F
from skein.sources import keyed
from skein.streaming import batches


class Clock:
    now = 1000.0

    def __call__(self):
        return self.now


@pytest.fixture
def clock():
    return Clock()


@pytest.fixture
def setting(spark, tmp_path, clock):
    table = keyed.KeyedTable(spark, str(tmp_path / "t"), "idx long, status string, by string", ["idx"], buckets=2)
    lease = lambda: batches.Lease(spark, str(tmp_path / "lease"), 60, clock)
    return table, spark.range(10).withColumnRenamed("id", "idx"), lease


def good(by):
    return lambda window: window.select("idx", F.lit("ok").alias("status"), F.lit(by).alias("by"))


def test_all_windows(setting):
    table, items, lease = setting
    assert batches.worked_off(items, table, good("a"), 4, lease()) == batches.Report(3, 10, False)
    assert batches.worked_off(items, table, good("b"), 4, lease()) == batches.Report(0, 10, False)


def test_a_killed_run_goes_on(setting, clock):
    """The driver is lost in its second window: the lease runs out, and another does the rest and nothing twice."""
    table, items, lease = setting
    calls = []

    def dies(window):
        calls.append(window.count())
        if len(calls) == 2:
            raise KeyboardInterrupt
        return good("first")(window)

    lost = lease()
    lost.free = lambda: None  # a lost driver frees nothing
    with pytest.raises(KeyboardInterrupt):
        batches.worked_off(items, table, dies, 4, lost)
    with pytest.raises(batches.Held):
        batches.worked_off(items, table, good("second"), 4, lease())
    clock.now += 61
    assert batches.worked_off(items, table, good("second"), 4, lease()) == batches.Report(2, 10, False)
    assert {r["by"]: r["count"] for r in table.read().groupBy("by").count().collect()} == {"first": 4, "second": 6}


def test_three_windows_without_progress_end_it(setting):
    table, items, lease = setting
    given = []

    def fails(window):
        given.append(sorted(r["idx"] for r in window.collect()))
        return window.select("idx", F.when(F.col("idx") == 5, "error").otherwise("ok").alias("status"), F.lit("x").alias("by"))

    report = batches.worked_off(items, table, fails, 4, lease())
    assert report.stalled and report.done == 8 and given == [[0, 1, 2, 3], [4, 5, 6, 7], [5, 8], [5], [5]]
    # Mended, it goes on.
    assert batches.worked_off(items, table, good("y"), 4, lease()) == batches.Report(2, 10, False)


def test_leases(spark, tmp_path, clock):
    one, two = (batches.Lease(spark, str(tmp_path / "l"), 60, clock) for _ in range(2))
    one.hold()
    one.hold()
    with pytest.raises(batches.Held):
        two.hold()
    one.free()
    two.hold()
    with pytest.raises(batches.Held):
        one.hold()
