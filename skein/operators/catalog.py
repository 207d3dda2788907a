"""Source catalog, selection of chunks for extraction, and the pilot set."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as T

# Words that speak for a chunk.
TOOLS = ("EEG", "ERP", "fMRI", "MEG", "MRI", "PET", "SPECT", "ADOS", "ADI-R", "M-CHAT", "量表", "筛查", "评估")
TRIGGERS = ("研究表明", "研究发现", "结果显示", "显示", "发现", "通过", "使用", "采用", "showed", "found", "using", "assessed", "measured")


def source_catalog(docs: DataFrame) -> DataFrame:
    """doc_id, title, year, source_type, evidence_level, license of docs (doc_id, source_group, relative_path, text)."""
    named = docs.withColumn("title", T.title(F.col("relative_path")))
    group, title = F.col("source_group"), F.col("title")
    named = named.withColumn("source_type", T.source_type(group, title))
    return named.select(
        "doc_id", "title", T.year(F.col("relative_path"), title, F.left(F.coalesce("text", F.lit("")), F.lit(4000))).alias("year"),
        "source_type", T.evidence_level(F.col("source_type"), group, title).alias("evidence_level"), T.licence(group, title).alias("license"),
    )


def selection(chunks: DataFrame, levels=("A", "B"), without=("book",), drop_noisy: bool = True) -> DataFrame:
    """chunks with reason: the first rule that skips a chunk, or selected."""
    reason = F.when(~F.coalesce(F.col("evidence_level").isin(*levels), F.lit(False)), "skip_evidence")
    reason = reason.when(F.col("source_type").isin(*without), "skip_source_type")
    if drop_noisy:
        reason = reason.when(T.noisy_chunk(F.coalesce("text", F.lit(""))), "skip_noisy")
    return chunks.withColumn("reason", reason.otherwise("selected"))


def pilot(chunks: DataFrame, key: str, owner: str, limit: int = 12, per_owner: int = 3, least: int = 4) -> DataFrame:
    """The best chunks by words that speak for them, so many of an owner at most."""
    text = F.col("text")
    scored = chunks.select(
        key, owner, T.tokens(text).alias("tokens"), (T.keyword_score(text, TOOLS) + T.keyword_score(text, TRIGGERS, 2)).alias("score"), text
    )
    scored = scored.where((F.col("score") >= least) & ~T.noisy_chunk(text)).drop("text")
    best = [F.desc("score"), F.desc("tokens"), F.desc(key)]
    scored = scored.withColumn("tokens", -F.col("tokens"))
    capped = scored.withColumn("place", F.row_number().over(Window.partitionBy(owner).orderBy(*best))).where(F.col("place") <= per_owner)
    return capped.orderBy(*best).limit(limit).select(key, owner, "score", (-F.col("tokens")).alias("tokens"))


def with_catalog(docs: DataFrame, catalog: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs with the columns of their catalog row; documents without one stay, with nulls."""
    own = catalog.dropDuplicates([key])
    return docs.join(own.select(key, *[c for c in own.columns if c not in docs.columns]), key, "left")


def allowed(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs whose key is listed; an empty list is no filter."""
    return docs.join(ids.select(key).distinct(), key, "left_semi") if ids.take(1) else docs


def coverage(found: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """One row: n_expected, n_found of these, coverage (1 if nothing is expected)."""
    want = expected.select(key).distinct()
    seen = want.join(found.select(key).distinct().withColumn("seen", F.lit(1)), key, "left")
    n = seen.agg(F.count("*").alias("n_expected"), F.count("seen").alias("n_found"))
    return n.select("n_expected", "n_found", F.when(F.col("n_expected") > 0, F.col("n_found") / F.col("n_expected")).otherwise(1.0).alias("coverage"))


def most_common(rows: DataFrame, value: str, seq: str, n: int) -> DataFrame:
    """value, n: the n most frequent values; of equally frequent ones those that came first by seq."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"), F.min(seq).alias("first"))
    return counted.orderBy(F.desc("n"), "first").limit(n).select(value, "n")


def shuffled_head(rows: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """n rows in the order of a hash of seed and key: the same draw on every run."""
    return rows.orderBy(F.sha1(F.concat_ws(":", F.lit(seed), F.col(key)).cast("binary")), key).limit(n)


def selected(questions: DataFrame, ids: DataFrame | None, seq: str, limit: int | None = None) -> DataFrame:
    """Questions in file order (seq): those listed by id, if a list is given, and the first `limit` of these."""
    chosen = questions if ids is None else questions.join(F.broadcast(ids.select("id").distinct()), "id", "left_semi")
    return chosen.orderBy(seq, "id").limit(limit) if limit else chosen
