"""Cleaning of extracted documents: pages, lines, repeated headers, wrapped lines, spacing and references in one projection.

A document is one row from the scan to the end, so nothing is shuffled. Repeated headers and footers are found by sorting a
document's short lines: a line stands n times where it equals the line n - 1 places further on.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType

from skein.functions import text as T

# Ends of paragraphs, bullets, marks of pages.
PARAGRAPH_ENDS = "。！？.!?:：;；)]）】\"'”’"
BULLET = rf"(?U)^[\-•·\d]+[\).、．\.]?{T.SPACE}+"
PAGE = r"\[PAGE\s+\d+\]"
#: A wrapped line goes on until it has this many characters.
JOIN_CHARS = 280


def opened(codes) -> list[bool]:
    """Which lines open a paragraph, from their codes: a line goes on unless it is long, ends a sentence, or a bullet follows."""
    out, room = [], 0
    for code in codes:
        length, ends, bullet = code >> 2, code & 2, code & 1
        goes_on = room > 0 and not bullet
        out.append(not goes_on)
        room = 0 if ends else (room - length - 1 if goes_on else JOIN_CHARS - length)
    return out


@F.pandas_udf(ArrayType(ArrayType(BooleanType())))
def _opened_pages(pages: pd.Series) -> pd.Series:
    return pages.map(lambda each: [opened(codes.tolist()) for codes in each])


def line_code(line: Column) -> Column:
    """A line's length with two marks in its last bits: ends a sentence, is a bullet.  Only these go to Python, not the texts."""
    return F.length(line) * 4 + F.when(F.substring(line, -1, 1).isin(*PARAGRAPH_ENDS), 2).otherwise(0) + F.when(line.rlike(BULLET), 1).otherwise(0)


def unwrapped(lines: Column, begins: Column) -> Column:
    """Lines joined to paragraphs."""
    return F.substring(F.array_join(F.zip_with(lines, begins, lambda line, new: F.concat(F.when(new, "\n").otherwise(" "), line)), ""), 2, 2**31 - 1)


def pages(text: Column) -> Column:
    """Texts and numbers of pages by [PAGE n] marks, without what stands before the first; without a mark one page."""
    cut = F.split(text, PAGE, -1)
    marked = F.arrays_zip(
        F.transform(F.regexp_extract_all(text, F.lit(r"\[PAGE\s+(\d+)\]"), F.lit(1)), lambda n: n.try_cast("int")).alias("page_id"),
        F.slice(cut, 2, F.greatest(F.size(cut) - 1, F.lit(0))).alias("text"),
    )
    whole = F.array(F.struct(F.lit(1).alias("page_id"), text.alias("text")))
    return F.when(~text.rlike(r"(?U)[^\s\x1c-\x1f]"), F.slice(whole, 2, 1)).when(text.rlike(PAGE), marked).otherwise(whole)


def _long(name: str, value: Column) -> Column:
    return value.cast("long").alias(name)


def cleaned(docs: DataFrame, least_chars: int = 800, share: float = 0.35, least: int = 6) -> DataFrame:
    """doc_id, status, error, text, language, flags and counts of documents (doc_id, text); other columns are left out.

    Short lines (60 characters at most) that stand `least` times or on `share` of the pages, whichever is more, go. A text
    that is null or blank is an error 'no_pages' with an empty text. Repeated rows are cleaned each by itself; an empty table
    gives an empty one. Letters are joined to words where three or more stand alone; whole words beside them stay. A page
    number that occurs twice stands for two pages. `page_texts` are the pages before spacing and references are mended, as
    chunks are cut from them; `word_joins` counts the spaces taken out of words.
    """
    filtered = lambda part, keep: F.transform(part, lambda lines: F.filter(lines, keep))
    raw = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.length(raw).alias("raw_chars"), pages(raw).alias("pages"))
    tidy = lambda line: T.trimmed_prefix(T.normalised_line(line))
    split = F.transform("pages", lambda p: F.transform(F.split(p["text"], r"\r\n|\r|\n", -1), tidy))
    rows = rows.withColumn("read", filtered(split, lambda x: (x != "") & ~T.noise_line(x)))
    rows = rows.withColumn("lines", filtered(F.col("read"), lambda x: ~T.noisy_ocr_line(x)))
    rows = rows.withColumn("short", F.array_sort(F.filter(F.flatten("lines"), lambda x: F.length(x) <= 60)))
    often = F.greatest(F.lit(least), F.floor(F.size("pages") * share).cast("int"))
    rows = rows.withColumn("repeated", F.array_distinct(F.filter("short", lambda x, i: F.get("short", i + often - 1) == x)))
    rows = rows.withColumn("kept", filtered(F.col("lines"), lambda x: ~F.array_contains("repeated", x)))
    rows = rows.withColumn("opened", _opened_pages(F.transform("kept", lambda page: F.transform(page, line_code))))
    rows = rows.withColumn("bodies", F.zip_with("kept", "opened", unwrapped))
    parts = F.transform("bodies", lambda body, i: F.when(body != "", F.concat(F.lit("[PAGE "), F.get("pages", i)["page_id"], F.lit("]\n"), body)))
    rows = rows.withColumn("joined", F.array_join(parts, "\n\n"))
    rows = rows.withColumn("tight", T.fixed_punctuation(F.col("joined"))).withColumn("words", T.joined_letters(F.col("tight")))
    rows = rows.withColumn("full", T.compact_lines(F.col("words")))
    rows = rows.withColumn("cut", T.reference_line(F.col("full")))
    kept = F.when(F.col("cut").isNull(), F.col("full")).otherwise(F.array_join(F.slice(F.split("full", "\n", -1), F.lit(1), F.coalesce("cut", F.lit(0))), "\n"))
    rows = rows.withColumn("clean", T.normal_ends(F.regexp_replace(kept, r"\n{3,}", "\n\n")))
    ok = F.size("pages") > 0
    flags = F.array_compact(
        F.array(
            F.when(~ok, "no_pages"),
            F.when(ok & F.contains(F.lower("clean"), F.lit(T.ANNA)), "metadata_left"),
            F.when(ok & (F.length("clean") < least_chars), "too_short"),
            F.when(ok & F.col("clean").rlike(PAGE + r"\s*$"), "empty_tail_page"),
            F.when(ok & F.col("cut").isNotNull(), "references_trimmed"),
        )
    )
    return rows.select(
        "doc_id", F.when(ok, "ok").otherwise("error").alias("status"), F.when(~ok, "no_pages").alias("error"), F.col("clean").alias("text"), T.language(F.col("clean")).alias("language"),
        flags.alias("flags"), _long("raw_chars", F.col("raw_chars")), _long("clean_chars", F.length("clean")), _long("pages", F.size("pages")), _long("repeated_lines", F.size("repeated")),
        _long("noisy_lines", F.size(F.flatten("read")) - F.size(F.flatten("lines"))), F.col("cut").isNotNull().alias("references_trimmed"),
        F.col("bodies").alias("page_texts"), _long("word_joins", F.length("tight") - F.length("words")),
    )


def summary(rows: DataFrame) -> DataFrame:
    """measure, value: documents by status, by language and by flag, and sums of their characters, in one aggregation."""
    pair = lambda name, key, n: F.struct(F.concat(F.lit(name), key).alias("measure"), n.cast("long").alias("n"))
    one, none = F.lit(1), F.lit("")
    fixed = F.array(pair("status:", F.col("status"), one), pair("language:", F.col("language"), one), pair("raw_chars", none, F.col("raw_chars")), pair("clean_chars", none, F.col("clean_chars")))
    each = rows.select(F.explode(F.concat(fixed, F.transform("flags", lambda f: pair("flag:", f, one)))).alias("p"))
    return each.groupBy("p.measure").agg(F.sum("p.n").alias("value"))
