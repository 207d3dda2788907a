"""CSV with line numbers: records of large files are numbered across splits, cells may hold line feeds.

A file's lines are counted for each split, and sums of these counts give each split its first line number.  Quotes are counted
the same way: a line begins a record if the quotes before it, from the file's start, are even.  Lines of a record meet by
the number of its first line and are parsed as one.  Neither a file nor a split is read by one task for the sake of numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.sources import tables

#: Columns that may be blank in any returned table.
OPTIONAL = ("notes",)


def records(spark: SparkSession, path: str) -> DataFrame:
    """file, line, record, text: each record's first line in its file and its place among the file's records, from 1.

    Line ends within quotes become line feeds; empty lines are no records but count as lines.
    """
    tables.shared(spark)
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    # Read once: numbers of rows hold within one reading.
    lines = read.withColumn("quotes", quotes).checkpoint()
    of_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.sum("quotes").alias("q"))
    sums = sums.select("file", "block", F.coalesce(F.sum("n").over(of_file), F.lit(0)).alias("lines_before"), F.coalesce(F.sum("q").over(of_file), F.lit(0)).alias("quotes_before"))
    inside = Window.partitionBy("file", "block").orderBy("id")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = lines.join(sums, ["file", "block"])
    line = (F.col("lines_before") + F.row_number().over(inside)).alias("line")
    before = F.col("quotes_before") + F.sum("quotes").over(upto) - F.col("quotes")
    opens = placed.select("file", "block", "id", "value", line, (before % 2 == 0).alias("opens"))
    opens = opens.withColumn("own", F.max(F.when(F.col("opens"), F.col("line"))).over(upto))
    # A record that an earlier split began.
    last = opens.groupBy("file", "block").agg(F.max("own").alias("last")).withColumn("carried", F.max("last").over(of_file)).select("file", "block", "carried")
    whole = opens.join(last, ["file", "block"]).groupBy("file", F.coalesce("own", "carried").alias("line"))
    found = whole.agg(F.array_sort(F.collect_list(F.struct("block", "id", "value"))).alias("parts"))
    found = found.select("file", "line", F.array_join(F.transform("parts", lambda x: x["value"]), "\n").alias("text")).where(F.trim("text") != "")
    return _counted(found)


def _counted(found: DataFrame) -> DataFrame:
    """found (file, line, text) with record: the number of its record in the file, by counts for ranges of lines."""
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = found.repartitionByRange(parts, "file", "line").sortWithinPartitions("file", "line").withColumn("part", F.spark_partition_id()).checkpoint()
    before = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("file", "part").agg(F.count("*").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0))).select("file", "part", "ahead")
    number = F.row_number().over(Window.partitionBy("file", "part").orderBy("line"))
    return placed.join(sums, ["file", "part"]).select("file", "line", (F.col("ahead") + number).alias("record"), "text")


def returned(spark: SparkSession, path: str, task: str) -> DataFrame:
    """file, line, record and the columns of a task's returned files, trimmed; raises ValueError for a file that isn't one.

    The first record is the header, in any order and case, a byte-order mark before it is skipped; columns that the task doesn't
    have are left out.  A file without a header or without a row is refused.
    """
    if task not in tables.RETURNS:
        raise ValueError(f"unknown task: {task}")
    every = records(spark, path).checkpoint()
    headers = every.where("record = 1").orderBy("file").select("file", F.regexp_replace("text", "^﻿", "").alias("text"))
    # Few: one for each file; their columns decide how the file is parsed.
    files = [r["file"] for r in every.groupBy("file").agg(F.count("*").alias("n")).where("n < 2").limit(3).collect()]
    if files or not headers.take(1):
        raise ValueError(f"{task}: no data rows in {', '.join(files) or path}")
    options = {"escape": '"', "multiLine": "true"}
    out = None
    for text in sorted(r["text"] for r in headers.select("text").distinct().limit(1000).collect()):
        cells = spark.createDataFrame([(text,)], "text string").select(F.from_csv("text", F.lit(", ".join(f"c{k} string" for k in range(text.count(",") + 1))), options).alias("c")).first()["c"]
        names = [(c or "").strip().lower() for c in cells if c is not None]
        missing = [c for c in tables.RETURNS[task] if c not in names]
        if missing:
            raise ValueError(f"{task}: missing headers: {', '.join(missing)}")
        schema = ", ".join(f"c{k} string" for k in range(len(names)))
        own = every.where("record > 1").join(F.broadcast(headers.where(F.col("text") == text).select("file")), "file", "left_semi")
        parsed = own.select("file", "line", "record", F.from_csv("text", F.lit(schema), options).alias("c"))
        place = {n: k for k, n in reversed([*enumerate(names)])}
        mine = parsed.select("file", "line", "record", *[F.trim(F.coalesce(F.col(f"c.c{place[c]}"), F.lit(""))).alias(c) for c in tables.RETURNS[task]])
        out = mine if out is None else out.unionByName(mine)
    return out


def violations(rows: DataFrame, optional=OPTIONAL) -> DataFrame:
    """file, line, record, column of blank cells of rows (as `returned` gives them) that must not be blank."""
    columns = [c for c in rows.columns if c not in ("file", "line", "record", *optional)]
    blank = F.array_compact(F.array(*[F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) == "", F.lit(c)) for c in columns]))
    return rows.select("file", "line", "record", F.explode(blank).alias("column"))


def cast(rows: DataFrame, types: dict[str, str]) -> DataFrame:
    """rows with columns as other types, null where a cell is none of that type."""
    return rows.withColumns({c: F.col(c).try_cast(kind) for c, kind in types.items()})


def last_rows(rows: DataFrame, key: str) -> DataFrame:
    """The last row of each key, by file and line."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("file", "line")).alias("r")).select(key, "r.*").select(*rows.columns)
