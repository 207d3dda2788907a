"""Importance resampling towards a target: documents whose hashed n-grams are like the target's are drawn more often.

A text's features are its runs of 1 to LONGEST words, each in one of BUCKETS buckets by its CRC-32.  In each task DuckDB takes
the words of a block of texts apart (unnest), joins neighbours by a window and hashes them with a registered function of
zlib's CRC; its counts by document and bucket are spilled to a Parquet table in the shared folder.  Spark merges them: sums by
bucket over all documents and over the target give each bucket's gain, the log ratio of its smoothed shares.  A document's
weight is the sum of its features' gains.  With Gumbel noise from its id as the score, the highest scores are a sample without
replacement in proportion to the exponential of the weight.

Ranks are places in an order over ranges of scores: each range counts its rows, sums of these counts are the ranges' offsets.

Long texts are cut into pieces of PIECE bytes, which share LONGEST - 1 words so that no n-gram is lost or counted twice.

Edge cases: null or empty text has no features, weight 0, and is never drawn (it has too few words).  Rows that repeat a
doc_id have scores of their own, by the same noise; a null doc_id has the noise of an empty id and comes last among ties.
Equal rows are ranked one after the other.  Other columns are ignored.  With an empty table the result is empty; an empty
target has equal shares in all buckets.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import common

#: Words of the longest feature.
LONGEST = 3
BUCKETS = 10_000
#: Words that a document has at least to be drawn, and the share of such documents that is drawn.
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
#: Bytes of text that DuckDB gets at once.
PIECE = 1 << 19

#: Features of the pieces in `piece` (row, text, own: words that begin a feature here), counted by row and bucket.
COUNT = f"""
WITH split AS (
    SELECT row, own, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w,
        row_number() OVER () AS piece FROM piece),
words AS (SELECT row, own, piece, unnest(w) AS word, unnest(range(len(w))) AS pos FROM split),
joined AS (
    SELECT row, own, pos, {", ".join(" || ' ' || ".join(["word", *(f"lead(word, {k}) OVER near" for k in range(1, n))]) + f" AS f{n}" for n in range(1, LONGEST + 1))}
    FROM words WINDOW near AS (PARTITION BY piece ORDER BY pos)),
features AS (SELECT row, unnest([{", ".join(f"f{n}" for n in range(1, LONGEST + 1))}]) AS f FROM joined WHERE pos < own)
SELECT row, (crc(encode(f)) % {BUCKETS})::INTEGER AS bucket, count(*)::INTEGER AS n FROM features WHERE f IS NOT NULL GROUP BY ALL ORDER BY ALL
"""

#: features: the bucket of each feature, in order, as unsigned 16-bit numbers: a bucket stands as often as it counts.
SPILLED = "doc_id long, n_words long, n_features long, features binary"


def engine():
    """A DuckDB session of one thread that keeps to memory and knows crc()."""
    import duckdb

    session = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
    session.create_function("crc", lambda text: zlib.crc32(text), ["BLOB"], "UINTEGER")
    return session


def pieces(block: pa.RecordBatch, limit: int) -> tuple[pa.Table, np.ndarray]:
    """(row, text, own) of a block's texts, long ones in pieces; and the number of words of each text."""
    data, ends = common.arrow_bytes(block.column("text"))
    _, starts, stops, counts = common.words(data, ends, common.WORD)
    last = np.concatenate([[0], np.cumsum(counts)])
    rows, begins, closes, own = [], [], [], []
    for k in np.flatnonzero(counts):
        s, e = starts[last[k] : last[k + 1]], stops[last[k] : last[k + 1]]
        at = 0
        while at < len(s):
            to = max(at + 1, int(np.searchsorted(e, s[at] + limit, "right")))
            rows.append(k)
            begins.append(s[at])
            closes.append(e[min(to + LONGEST - 1, len(s)) - 1])
            own.append(to - at)
            at = to
    raw = data.tobytes()
    texts = pa.array([raw[a:b] for a, b in zip(begins, closes, strict=True)], pa.binary()).cast(pa.string())
    return pa.table({"row": pa.array(rows, pa.int64()), "text": texts, "own": pa.array(own, pa.int64())}), counts


def spilled(docs: DataFrame, limit: int = PIECE) -> DataFrame:
    """doc_id, n_words, n_features and the counted buckets of each row of docs (doc_id, text)."""

    def run(batches):
        session = engine()
        for block in common.blocks(batches, "text", limit):
            table, words = pieces(block, limit)
            session.register("piece", table)
            found = session.sql(COUNT).to_arrow_table().combine_chunks()
            row, bucket, n = (found.column(c).to_numpy() for c in ("row", "bucket", "n"))
            sums = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(row, np.arange(block.num_rows + 1))]
            packed = np.repeat(bucket.astype("<u2"), n)
            packed = pa.BinaryArray.from_buffers(pa.binary(), block.num_rows, [None, pa.py_buffer((2 * sums).astype(np.int32)), pa.py_buffer(packed.tobytes())])
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(words), pa.array(np.diff(sums)), packed], ["doc_id", "n_words", "n_features", "features"])
        session.close()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SPILLED)


def _unpacked(batches) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, buckets of their features, where each row's end) of blocks of bounded size."""
    for block in common.blocks(batches, "features"):
        data, ends = common.arrow_bytes(block.column("features"))
        yield block, np.frombuffer(data.tobytes(), "<u2"), ends // 2


def totals(counted: DataFrame) -> np.ndarray:
    """Features in each bucket over all rows: BUCKETS numbers, whatever the table's size."""

    def run(batches):
        out = np.zeros(BUCKETS, np.int64)
        for _, buckets, _ in _unpacked(batches):
            out += np.bincount(buckets, minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(out)], ["bucket", "n"])

    merged = counted.select("features").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for row in merged.collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(share in the target / share in the corpus)) of each bucket, both with one more feature in each bucket."""
    s_all, t_all = float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(counted: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight."""

    def run(batches):
        for block, buckets, ends in _unpacked(batches):
            sums = np.concatenate([[0], np.cumsum(gain[buckets])])
            yield pa.RecordBatch.from_arrays([*(block.column(c) for c in ("doc_id", "n_words", "n_features")), pa.array(np.diff(sums[ends]))], ["doc_id", "n_words", "n_features", "weight"])

    return counted.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id, seed: int) -> F.Column:
    """Gumbel noise in thousandths, from the id and the seed alone."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.left(F.sha2(key.cast("binary"), 256), F.lit(8)), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(scored: DataFrame, shelf: common.Shelf, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """scored (doc_id, n_words, score, ...) with rank: 1, 2, 3, ... by falling score, null where not drawn."""
    spark = scored.sparkSession
    may = F.col("n_words") >= least_words
    order = [may.desc(), F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("weight"), F.desc("n_features")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = scored.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = placed.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at"))
    placed = shelf.put(placed, "resample-placed")
    # One row for each range: as many as there are partitions.
    counts = placed.groupBy("part").agg(F.count("*").alias("n"), F.count_if(may).alias("n_may")).orderBy("part").collect()
    ahead = np.concatenate([[0], np.cumsum([r["n"] for r in counts])]).tolist()
    drawn = percent * sum(r["n_may"] for r in counts) // 100
    offsets = spark.createDataFrame([(r["part"], n) for r, n in zip(counts, ahead[:-1], strict=True)], "part int, ahead long")
    rank = F.col("ahead") + F.col("at") + 1
    return placed.join(F.broadcast(offsets), "part").withColumn("rank", F.when(may & (rank <= drawn), rank)).drop("part", "at", "ahead")


def weights(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of each row of docs (doc_id, text); target has texts too."""
    shelf = common.Shelf(docs.sparkSession)
    counted = shelf.put(spilled(docs), "resample-buckets")
    gain = gains(totals(counted), totals(spilled(target.select(F.lit(None).cast("long").alias("doc_id"), "text"))))
    scored = weighed(counted, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    found = ranked(scored, shelf, percent, least_words)
    shelf.drop("resample-buckets")
    return found


def sample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """The rows of docs whose doc_id is drawn."""
    drawn = weights(docs, target, percent, seed).where("rank is not null").select(F.col("doc_id").alias("drawn_id")).distinct()
    return docs.join(drawn, docs["doc_id"].eqNullSafe(F.col("drawn_id")), "left_semi")


def report(docs: DataFrame, target: DataFrame) -> DataFrame:
    return weights(docs, target).select("doc_id", "n_features", "weight", "score", "rank", "n_words")
