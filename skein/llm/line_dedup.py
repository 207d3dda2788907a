"""Line dedup: levelled sorted runs of line hashes.  DataFrame functions only.

Documents arrive in batches.  A batch's line keys are hashed, counted by document and written as a sorted run: hash, number
of documents, largest doc_id.  Before a batch is added, its hashes merge-anti-join the runs: only hashes that no run holds
are new, the others add to counts.  When FAN runs stand on a level, they are merged into one run of the next level, so a
hash is rewritten once per level and a lookup meets few runs.

Edge cases: null or empty text is one empty line.  Each row is a document, so rows that repeat a doc_id hold lines
separately; all rows with the largest doc_id keep the line.  A null doc_id is less than any other; its row still counts as a
document, and a line that stands in rows without an id alone stays in all of them.  A row keeps its number of lines; extra
columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm import common

#: Code points that a line's key has at least to be judged.
MIN_CHARS = 20
#: Documents that hold a line's key at least for it to be dropped.
MIN_DOCS = 3
#: Runs of one level that are merged into one of the next.
FAN = 4
#: Batches that one call adds.
BATCHES = 4

SPACE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return common.lower_ascii(F.trim(line, F.lit(SPACE)))


def _hash(key: Column) -> Column:
    """128 bits: at 10**12 lines 64 would collide."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(7), key).alias("b"))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keys_of(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """a, b, doc_id: one row for each document and distinct key that is long enough."""
    keys = F.filter(F.transform(lines_of(F.col("text")), line_key), lambda k: F.char_length(k) >= min_chars)
    hashes = F.array_distinct(F.transform(keys, _hash))
    return docs.select("doc_id", F.explode(hashes).alias("h")).select("h.a", "h.b", "doc_id")


class LineRuns:
    """Sorted runs by level, the newest last: bucketed tables in the shared folder, so that a batch meets them without
    another shuffle or sort.

    Batches come in falling order of doc_id.  A hash that no run holds is new, and its batch has the document that keeps
    the line; for the others only the count is added.
    """

    SCHEMA = "a long, b long, n long, last long"

    def __init__(self, spark, fan: int = FAN, buckets: int | None = None):
        self.spark, self.fan, self.shelf = spark, fan, common.Shelf(spark)
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def add(self, keys: DataFrame) -> None:
        """keys: a, b, doc_id of a batch, distinct in each document."""
        counted = keys.groupBy("a", "b").agg(F.count("*").alias("n"), F.max(F.col("doc_id").cast("long")).alias("last"))
        fresh, again = counted, []
        for held in self.runs():
            held = held.select("a", "b").hint("merge")
            again.append(fresh.join(held, ["a", "b"], "left_semi").withColumn("last", F.lit(None).cast("long")))
            fresh = fresh.join(held, ["a", "b"], "left_anti")
        self._put(reduce(DataFrame.unionByName, again, fresh), 0)

    def _put(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        name = f"line_run_{level}_{uuid.uuid4().hex}"
        dealt = run.repartition(self.buckets, "a", "b").write.bucketBy(self.buckets, "a", "b").sortBy("a", "b")
        dealt.option("path", self.shelf.place(name)).saveAsTable(name)
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fan:
            names, merged = self.levels[level], self._merged(self.levels[level])
            self.levels[level] = []
            self._put(merged, level + 1)
            self._drop(names)

    def _merged(self, names: list[str]) -> DataFrame:
        """One row for each hash.  The runs are read as plain files: Spark takes a union of bucketed tables to be dealt by
        hash already, reads them without their buckets and would count each file for itself."""
        files = self.spark.read.schema(self.SCHEMA).parquet(*[self.shelf.paths[name] for name in names])
        return files.groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("last").alias("last"))

    def counts(self) -> DataFrame:
        """a, b, n (documents), last (largest doc_id) over all runs."""
        return self._merged([name for level in self.levels for name in level])

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.shelf.drop(*names)

    def drop(self) -> None:
        self._drop([name for level in self.levels for name in level])
        self.levels = []


def repeated(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fan: int = FAN) -> DataFrame:
    """a, b, last: hashes of keys in at least min_docs documents and the doc_id that keeps them, by way of the runs."""
    spark = docs.sparkSession
    runs = LineRuns(spark, fan)
    cuts = docs.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)])).first()[0] or []
    bounds = sorted(set(cuts), reverse=True)
    by = F.col("doc_id")
    try:
        for k in range(len(bounds) + 1):
            below = by <= bounds[k - 1] if k else F.lit(True)
            above = by > bounds[k] if k < len(bounds) else F.lit(True)
            batch = below & above
            runs.add(keys_of(docs.where(batch | by.isNull() if k == len(bounds) else batch), min_chars))
        return common.written(runs.counts().where(F.col("n") >= min_docs).select("a", "b", "last"), "repeated-lines")
    finally:
        runs.drop()


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """docs with kept_text, n_lines, n_dropped beside their own columns; own columns of these names are replaced."""
    source = docs.select("doc_id", "text")
    heavy = repeated(source, min_chars, min_docs, batches)
    row = F.xxhash64("text").alias("row_hash")
    lines = source.select("doc_id", row, F.posexplode(lines_of(F.col("text"))).alias("at", "line"))
    hashed = lines.select("doc_id", "row_hash", "at", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    hashed = hashed.select("doc_id", "row_hash", "at", _hash(F.col("key")).alias("h"))
    hits = hashed.select("doc_id", "row_hash", "at", "h.a", "h.b").join(heavy, ["a", "b"])
    hits = hits.where((F.col("doc_id") < F.col("last")) | (F.col("doc_id").isNull() & F.col("last").isNotNull()))
    dropped = hits.groupBy(F.col("doc_id").alias("d"), F.col("row_hash").alias("r")).agg(F.collect_set("at").alias("dropped"))
    docs = docs.drop("kept_text", "n_lines", "n_dropped")
    mine = docs["doc_id"].eqNullSafe(dropped["d"]) & (F.xxhash64(docs["text"]) == dropped["r"])
    both = docs.join(dropped, mine, "left")
    all_lines, gone = lines_of(docs["text"]), dropped["dropped"]
    n = F.size(all_lines)
    stay = F.array_except(F.sequence(F.lit(0), n - 1), gone)
    kept = F.array_join(F.transform(stay, lambda i: F.get(all_lines, i)), "\n")
    return both.select(
        *[docs[c] for c in docs.columns],
        F.when(gone.isNull(), F.coalesce(docs["text"], F.lit(""))).otherwise(kept).alias("kept_text"),
        n.cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_dropped"),
    )


def report(docs: DataFrame) -> DataFrame:
    found = dedup(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
