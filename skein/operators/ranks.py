"""Exact order statistics of large groups: ranges of values are counted, and only those that hold a wanted rank are looked into."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.sources import tables


def at_ranks(df: DataFrame, column: str, ranks: dict[str, Callable[[Column], Column]], keys: tuple[str, ...] = (), times: str | None = None) -> DataFrame:
    """One row for each group of keys: total, and the value at each of the ranks; null values have no rank.

    ranks: name -> the rank (from 1) as a function of the group's number of values; ranks outside 1..total give null.  times: a
    column that says how many times a row counts; once without it.

    Equal values are counted first.  The counts are dealt to ranges of (keys, value); each range's sum by group says which
    ranges hold which ranks, and sums run inside those alone.  So no group meets in one task, however large it is.  What is
    summed over all ranges has a row for each range and group in it.
    """
    spark = df.sparkSession
    tables.shared(spark)
    keys = list(keys)
    # Without keys all rows are one group.
    own = keys or ["everything"]
    df = df if keys else df.withColumn("everything", F.lit(0))
    counts = df.where(F.col(column).isNotNull()).groupBy(*own, F.col(column).alias("v")).agg((F.sum(times) if times else F.count("*")).alias("n"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The ranges are read twice, so they are kept: another sample of the values could set other bounds.
    placed = counts.repartitionByRange(parts, *own, "v").withColumn("part", F.spark_partition_id()).checkpoint()
    sums = placed.groupBy(*own, "part").agg(F.sum("n").alias("n"))
    rising = Window.partitionBy(*own).orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.select(*own, "part", (F.sum("n").over(rising) - F.col("n")).alias("before"), "n", F.sum("n").over(Window.partitionBy(*own)).alias("total"))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), rank(F.col("total")).cast("long").alias("rank")) for name, rank in ranks.items()])
    held = sums.select("*", F.explode(wanted).alias("w")).where((F.col("w.rank") > F.col("before")) & (F.col("w.rank") <= F.col("before") + F.col("n")))
    held = held.select(*own, "part", "before", F.col("w.name").alias("name"), F.col("w.rank").alias("rank"))
    inside = placed.join(held, [*own, "part"])
    upto = F.col("before") + F.sum("n").over(Window.partitionBy(*own, "part", "name").orderBy("v"))
    picked = inside.withColumn("upto", upto).where(F.col("upto") >= F.col("rank"))
    picked = picked.groupBy(*own).agg(*[F.min(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in ranks])
    whole = sums.groupBy(*own).agg(F.max("total").alias("total"))
    return whole.join(picked, own, "left").select(*keys, "total", *ranks)


def index95(n: Column) -> Column:
    """The value at index floor(0.95 n), from 0."""
    return F.least(n, F.floor(n * 0.95) + 1)


def nearest95(n: Column) -> Column:
    """The nearest rank of 95 %."""
    return F.greatest(F.ceil(n * 0.95), F.lit(1))


def lower_median(n: Column) -> Column:
    return F.floor((n + 1) / 2)


def upper_median(n: Column) -> Column:
    return F.floor(n / 2) + 1
