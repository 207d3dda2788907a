"""Quality of documents and chunks: measures, risk flags, grades, gates, metric summaries and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import ranks
from skein.sources import tables


def measured(docs: DataFrame) -> DataFrame:
    """docs (text, pages) with the measures that grades are made of."""
    t = F.col("text")
    docs = docs.withColumn("text", F.coalesce(t, F.lit(""))).withColumn("lines", T.lines(t))
    n = F.size("lines")
    return docs.select(
        "*",
        F.length(t).cast("long").alias("chars"),
        T.ratio(F.length(t), F.col("pages")).alias("chars_per_page"),
        T.ratio(F.size(F.array_distinct("lines")), n).alias("unique_lines"),
        n.cast("long").alias("n_lines"),
        T.ratio(T.count(t, T.WEIRD), F.length(t)).alias("weird"),
        T.count(t, T.CJK).cast("long").alias("cjk"),
        T.count(t, r"\[PAGE\s+\d+\]").cast("long").alias("page_marks"),
        T.ratio(T.count(t, rf"(?U)(?<={T.CJK})\s+(?={T.CJK})"), T.count(t, T.CJK)).alias("cjk_spaces"),
        T.ratio(T.count(t, r"(?U)\s+[，。！？；：、]"), T.count(t, T.CJK)).alias("punct_spaces"),
        T.ratio(T.count(t, rf"(?U)(?<={T.CJK})\s+[,.;:!?]|[,.;:!?]\s+(?={T.CJK})"), T.count(t, T.CJK)).alias("ascii_gaps"),
        T.ratio(F.size(F.filter("lines", T.noisy_ocr_line)), n).alias("noisy_lines"),
    )


def _flags(*named: tuple[str, Column]) -> Column:
    return F.array_sort(F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in named])))


def graded(docs: DataFrame, clean_limit: int = 800) -> DataFrame:
    """Clean documents with risk_flags and grade.

    The cleaner's own limit for short texts takes part, so a text under it is F though the grade's limit is 500.
    """
    m = measured(docs)
    cjk = F.col("cjk") > 300
    spaces, noisy = F.col("cjk_spaces"), F.col("noisy_lines")
    flags = _flags(
        ("ascii_punct_spacing_high", cjk & (F.col("ascii_gaps") > 0.01)),
        ("cjk_spacing_mild", cjk & (spaces > 0.04) & (spaces <= 0.12)),
        ("cjk_spacing_severe", cjk & (spaces > 0.12)),
        ("dup_lines_high", (F.col("unique_lines") < 0.22) & (F.col("n_lines") > 120)),
        ("low_cpp", F.col("chars_per_page") < 80),
        ("metadata_left", F.contains(F.lower("text"), F.lit(T.ANNA))),
        ("no_page_marker", F.col("page_marks") == 0),
        ("noisy_lines_mild", (noisy > 0.10) & (noisy <= 0.20)),
        ("noisy_lines_severe", noisy > 0.20),
        ("punct_spacing_high", cjk & (F.col("punct_spaces") > 0.01)),
        ("too_short", (F.col("chars") < 500) | (F.col("chars") < clean_limit)),
        ("weird_chars_high", F.col("weird") > 0.01),
    )
    m = m.withColumn("risk_flags", flags)
    has = lambda *names: F.arrays_overlap("risk_flags", F.array(*map(F.lit, names)))
    grade = (
        F.when(has("metadata_left", "too_short"), "F")
        .when(has("weird_chars_high", "low_cpp", "cjk_spacing_severe", "noisy_lines_severe"), "D")
        .when(has("dup_lines_high", "cjk_spacing_mild", "punct_spacing_high", "ascii_punct_spacing_high", "noisy_lines_mild"), "C")
        .when((F.col("chars_per_page") >= 300) & (F.col("unique_lines") >= 0.45), "A")
        .otherwise("B")
    )
    return m.withColumn("grade", grade)


def extraction_graded(docs: DataFrame) -> DataFrame:
    """Extracted documents with boiler_hits, flags and grade."""
    m = measured(docs)
    low = F.lower("text")
    # Marks of boilerplate.
    marks = (r"document generated by anna['’]s archive", "copyright", "all rights reserved", r"(?U)目\s*录", "contents")
    hits = sum(low.rlike(p).cast("int") for p in marks)
    chars, rate = F.col("chars"), F.col("chars_per_page")
    m = m.withColumn("boiler_hits", hits)
    flags = _flags(
        ("anna_archive_marker", F.contains(low, F.lit(T.ANNA))),
        ("boilerplate_dominant", (F.col("boiler_hits") >= 2) & (chars < 3000)),
        ("high_line_duplication", (F.col("unique_lines") < 0.25) & (F.col("n_lines") > 80)),
        ("low_chars_per_page", rate < 40),
        ("too_short", chars < 200),
    )
    grade = (
        F.when(F.contains(low, F.lit(T.ANNA)) | (chars < 120), "F")
        .when((rate < 40) | (chars < 1000), "D")
        .when(chars < 4000, "C")
        .when((rate >= 120) | (chars >= 12000), F.when(F.col("unique_lines") >= 0.5, "A").otherwise("B"))
        .otherwise("B")
    )
    return m.withColumn("flags", flags).withColumn("grade", grade)


def chunk_graded(chunks: DataFrame, least: int = 180, most: int = 760) -> DataFrame:
    """Chunks (text, tokens) with risk_flags and grade."""
    t, n = F.col("text"), F.col("tokens")
    weird = T.ratio(T.count(t, T.WEIRD), F.length(t))
    readable = T.ratio(T.count(t, "[A-Za-z0-9Ａ-Ｚａ-ｚ０-９\\x{4e00}-\\x{9fff}]"), F.length(t))
    noisy = (weird > 0.02) | (readable < 0.45)
    flags = _flags(
        ("noisy_high", noisy),
        ("noisy_mild", ~noisy & (weird > 0.01)),
        ("too_long", (n > most) & (n <= most + 250)),
        ("too_long_severe", n > most + 250),
        ("too_short", (n >= 60) & (n < least)),
        ("too_short_severe", n < 60),
    )
    grade = F.when((n < 60) | noisy | (n > most + 250), "D").when((n < least) | (n > most) | (weird > 0.01), "C").otherwise("A")
    return chunks.withColumn("risk_flags", flags).withColumn("grade", grade)


def distribution(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def flag_distribution(df: DataFrame, column: str = "flags") -> DataFrame:
    """flag, n: how many rows have each flag.

    Sets of flags are counted and written first: a filter on what is exploded would measure the texts again.
    """
    tables.shared(df.sparkSession)
    sets = df.groupBy(column).agg(F.count("*").alias("times")).checkpoint()
    return sets.select(F.explode(column).alias("flag"), "times").groupBy("flag").agg(F.sum("times").alias("n"))


# The gates' thresholds, shares of documents or chunks but for the 95th percentiles.
DOC_GATE = {"least_good": 0.90, "most_p95_cjk_spaces": 0.08, "most_spaced": 0.05, "most_p95_noisy_lines": 0.12, "most_failed": 0.03}
CHUNK_GATE = {"least_covered": 0.99, "least_in_range": 0.95, "most_noisy": 0.03, "most_short": 0.03, "most_duplicate": 0.08}
SPACED, SHORT_TOKENS = 0.20, 120


def gate(graded_docs: DataFrame) -> DataFrame:
    """One row: documents graded B or better, with many spaces between CJK characters, and failed; 95th percentiles (by index)
    of these spaces and of noisy lines, to four places; and whether all five thresholds hold.  No document passes nothing."""
    tables.shared(graded_docs.sparkSession)
    # Texts are measured once: all that is asked for is told by how often a grade stands with both rates.
    rates = [F.round(name, 4).alias(name) for name in ("cjk_spaces", "noisy_lines")]
    counted = graded_docs.groupBy("grade", *rates).agg(F.count("*").alias("times")).checkpoint()
    many = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("times"))), F.lit(0))
    out = counted.agg(many(F.lit(True)).alias("n"), many(F.col("grade").isin("A", "B")).alias("n_good"), many(F.col("cjk_spaces") > SPACED).alias("n_spaced"), many(F.col("grade") == "F").alias("n_failed"))
    for name in ("cjk_spaces", "noisy_lines"):
        top = ranks.at_ranks(counted.select(name, "times"), name, {f"p95_{name}": ranks.index95}, times="times")
        # One row each.
        out = out.crossJoin(F.broadcast(top.agg(F.max(f"p95_{name}").alias(f"p95_{name}"))))
    n, most = F.col("n"), DOC_GATE
    ok = (F.col("n_good") >= most["least_good"] * n) & (F.col("n_spaced") <= most["most_spaced"] * n) & (F.col("n_failed") <= most["most_failed"] * n)
    ok &= (F.col("p95_cjk_spaces") <= most["most_p95_cjk_spaces"]) & (F.col("p95_noisy_lines") <= most["most_p95_noisy_lines"])
    return out.withColumn("passed", F.coalesce(ok & (n > 0), F.lit(False)))


def chunk_gate(graded_chunks: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: chunks in range, noisy, short, duplicate, expected documents (doc_id) and those with a chunk, and whether all
    thresholds hold.  Where no document is expected, all are covered."""
    has = lambda name: F.array_contains("risk_flags", F.lit(name))
    out = graded_chunks.agg(
        F.count("*").alias("n"),
        F.count_if((F.col("tokens") >= 180) & (F.col("tokens") <= 760)).alias("in_range"),
        F.count_if(has("noisy_high") | has("noisy_mild")).alias("noisy"),
        F.count_if(F.col("tokens") < SHORT_TOKENS).alias("short"),
        (F.count("*") - F.count_distinct(T.signature(F.col("text")))).alias("duplicate"),
    )
    wanted = expected.select("doc_id").distinct()
    held = wanted.join(graded_chunks.select("doc_id").distinct().withColumn("held", F.lit(True)), "doc_id", "left")
    # One row each.
    out = out.crossJoin(F.broadcast(held.agg(F.count("*").alias("expected"), F.count("held").alias("covered"))))
    n, most = F.greatest("n", F.lit(1)), CHUNK_GATE
    ok = (F.col("in_range") >= most["least_in_range"] * n) & (F.col("noisy") <= most["most_noisy"] * n) & (F.col("short") <= most["most_short"] * n) & (F.col("duplicate") <= most["most_duplicate"] * n)
    return out.withColumn("passed", ok & (F.col("covered") >= most["least_covered"] * F.col("expected")))


def metric_summary(df: DataFrame, column: str) -> DataFrame:
    """One row: n, min, both medians, max and both 95th percentiles of a column; without a value n is 0, the rest null."""
    wanted = {"least": lambda n: F.lit(1), "most": lambda n: n, "upper_median": ranks.upper_median, "lower": ranks.lower_median, "p95_index": ranks.index95, "p95_rank": ranks.nearest95}
    found = ranks.at_ranks(df, column, wanted)
    n = F.coalesce(F.max("total"), F.lit(0)).alias("n")
    one = lambda c: F.max(c).alias(c)
    # At most one row: the aggregate is for the case of none.
    return found.agg(n, one("least"), one("most"), one("upper_median"), F.max((F.col("lower") + F.col("upper_median")) / 2.0).alias("median"), one("p95_index"), one("p95_rank"))


def repeated_lines(docs: DataFrame, most_chars: int = 60, share: float = 0.35, least: int = 6) -> DataFrame:
    """doc_id, line, n: short lines that stand on many pages of their document (doc_id, text, pages)."""
    each = docs.select("doc_id", "pages", F.explode(T.lines(F.col("text"))).alias("line")).where(F.length("line").between(1, most_chars))
    counted = each.groupBy("doc_id", "line", "pages").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= F.greatest(F.lit(least), F.floor(F.col("pages") * share))).select("doc_id", "line", "n")


def duplicate_groups(chunks: DataFrame, key: str) -> DataFrame:
    """signature, n, first: texts that are equal but for case and white space."""
    grouped = chunks.groupBy(T.signature(F.col("text")).alias("signature"))
    return grouped.agg(F.count("*").alias("n"), F.min(key).alias("first")).where("n > 1")


def stratified(graded_rows: DataFrame, key: str, n: int, seed: int = 42, low=("D", "F"), shares: tuple[int, int] = (10, 20)) -> DataFrame:
    """n rows: a quota of each grade first, then any: of n, one in shares[0] for each low grade and one in shares[1] for others.

    Rows are drawn in the order of a hash with the seed, so a sample can be drawn again.  Documents have low grades D and F
    and shares of 10 and 20, chunks C and D, 8 and 16.
    """
    draw = F.xxhash64(F.col(key), F.lit(seed))
    quota = F.when(F.col("grade").isin(*low), max(1, n // shares[0])).otherwise(max(1, n // shares[1]))
    order = Window.partitionBy("grade").orderBy(draw, key)
    # The first n of a grade are enough for any outcome.
    few = graded_rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
    drawn = few.withColumn("draw", draw).orderBy((F.col("place") > quota).cast("int"), "draw", key).limit(n)
    return drawn.drop("place", "draw")
