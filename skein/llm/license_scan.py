"""Licence scan by a positional index of rare tokens.  DataFrame functions only.

Each template is a sequence of words with mandatory key phrases.  The index holds its telling words: word -> (template,
position).  A file's licence words are weighed by their rarity in the corpus (IDF over all documents); all of them are looked
up, as the vocabulary bounds them, and postings are intersected by relative position: a template that stands at place p of
the file has each of its words at p + position.  A template is found if the words that agree on one p carry enough of its
weight and all its key phrases stand in the file.  The three base phrases are templates whose every place is counted.

Edge cases: null or empty text has no words, no labels and score 0.  Rows that repeat a doc_id are judged each by their own
text, and a row that stands twice as if it stood once.  A null doc_id is kept as null.  Extra columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm import common

#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Words of public licence notices by label, and key phrases that must all stand in the file.
TEMPLATES = {
    "apache-2.0": ("licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    "mit": ("released under the mit license", ("mit license",)),
    "mit-text": ("permission is hereby granted free of charge to any person obtaining a copy", ("hereby granted free of charge",)),
    "gpl-3.0": ("licensed under the gnu general public license version 3", ("general public license version 3",)),
    "gpl-2.0": ("licensed under the gnu general public license version 2", ("general public license version 2",)),
    "lgpl": ("licensed under the gnu lesser general public license", ("lesser general public license",)),
    "mpl-2.0": ("subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted", ("source and binary forms",)),
    "cc-by-4.0": ("licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    "cc-by-sa": ("licensed under a creative commons attribution sharealike license", ("attribution sharealike",)),
    "copyright": ("copyright c all rights reserved", ("copyright", "all rights reserved")),
    "cc-by": ("cc by", ("cc by",)),
    "gpl": ("general public license", ("general public license",)),
    "reserved": ("all rights reserved", ("all rights reserved",)),
}
#: Words of templates that are too common to be indexed.
COMMON = frozenset("the of a an and or to in is are any use with without under all by c v free terms subject version 0 2 3 4 copy person".split())
#: Share of a template's weight that must agree on one place.
SHARE = 0.6

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normalised(text: Column) -> Column:
    """The words of a text, lower-cased, each between single spaces; one space if there are none."""
    spaced = F.trim(F.regexp_replace(common.lower_ascii(F.coalesce(text, F.lit(""))), NOT_WORD, " "))
    return F.concat(F.lit(" "), spaced, F.lit(" "))


def _count(text: Column, piece: str) -> Column:
    return ((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(piece), F.lit("")))) / len(piece)).cast("long")


def _spaces(text: Column) -> Column:
    return _count(text, " ")


def _postings() -> list[tuple[str, str, int]]:
    return [(w, label, i) for label, (text, _) in TEMPLATES.items() for i, w in enumerate(text.split()) if w not in COMMON]


def base_places(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_words, n_base, first_word, last_word, base_labels."""
    w = F.col("w")
    read = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), normalised(F.col("text")).alias("w"))
    read = read.withColumn("n_words", F.when(w == "  ", F.lit(0)).otherwise(_spaces(w) - 1).cast("long"))
    places, firsts, lasts, labels = [], [], [], []
    for phrase, label in BASE.items():
        has = F.contains(w, F.lit(f" {phrase} "))
        # Neighbours share a space; doubled spaces keep them apart.
        apart = F.replace(w, F.lit(" "), F.lit("  "))
        places.append(F.when(has, _count(apart, f" {phrase.replace(' ', '  ')} ")).otherwise(F.lit(0)))
        firsts.append(F.when(has, _spaces(F.substring_index(w, f" {phrase} ", 1))))
        after = _spaces(F.substring_index(w, f" {phrase} ", -1))
        lasts.append(F.when(has, F.col("n_words") - after - len(phrase.split())))
        labels.append(F.when(has, F.lit(label)))
    return read.select(
        "doc_id", "text_hash", "n_words", reduce(add, places).cast("long").alias("n_base"),
        F.least(*firsts).cast("long").alias("first_word"), F.greatest(*lasts).cast("long").alias("last_word"),
        F.array_compact(F.array(*labels)).alias("base_found"),
    )


def template_hits(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, found: array of (label, share of the template's weight), for files with any indexed word."""
    spark = docs.sparkSession
    postings = _postings()
    vocabulary = sorted({w for w, _, _ in postings})
    # Lossless: a file without any indexed word has no posting.
    may = F.col("text").rlike(rf"(?i)(?:{'|'.join(vocabulary)})")
    files = docs.where(may).select("doc_id", F.xxhash64("text").alias("text_hash"), normalised(F.col("text")).alias("w"))
    verified = [F.when(reduce(lambda x, y: x & y, [F.contains("w", F.lit(f" {k} ")) for k in keys]), F.lit(label)) for label, (_, keys) in TEMPLATES.items()]
    files = files.withColumn("verified", F.array_compact(F.array(*verified)))
    tokens = files.select("doc_id", "text_hash", "verified", F.posexplode(F.split(F.trim("w"), " ")).alias("pos", "word"))
    # Distinct: a row that stands twice must not have twice the weight.
    tokens = common.written(tokens.where(F.col("word").isin(vocabulary)).distinct(), "licence-words")
    frequency = dict(tokens.select("doc_id", "text_hash", "word").distinct().groupBy("word").count().collect())
    total = max(1, docs.count())
    # Whole thousandths, so that sums do not depend on their order.
    log = spark.range(1).select(*[F.round(1000 * (1 + F.log(F.lit(total / n)))).cast("long").alias(w) for w, n in frequency.items()]).first()
    weight = log.asDict() if frequency else {}
    rows = [(w, label, i, weight.get(w, 0)) for w, label, i in postings if w in weight]
    weights = {label: sum(weight.get(w, 1000 * 20) for w, name, _ in postings if name == label) for label in TEMPLATES}
    index = F.broadcast(spark.createDataFrame([(*r, weights[r[1]]) for r in rows], "word string, label string, at int, weight long, total long"))
    chosen = tokens.join(index, "word").where(F.array_contains("verified", F.col("label")))
    agreed = chosen.groupBy("doc_id", "text_hash", "label", (F.col("pos") - F.col("at")).alias("place"), "total").agg(F.sum("weight").alias("weight"))
    shares = agreed.groupBy("doc_id", "text_hash", "label").agg(F.max(F.col("weight") / F.col("total")).alias("share")).where(F.col("share") >= SHARE)
    return shares.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("label", "share")).alias("found"))


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    base, hits = base_places(docs), template_hits(docs)
    joined = base.join(hits, base["doc_id"].eqNullSafe(hits["doc_id"]) & base["text_hash"].eqNullSafe(hits["text_hash"]), "left")
    found = F.coalesce("found", F.array().cast("array<struct<label:string,share:double>>"))
    labels = F.array_union("base_found", F.transform(found, lambda x: x["label"]))
    share = F.coalesce(F.array_max(F.transform(found, lambda x: x["share"])), F.lit(0.0))
    return joined.select(
        base["doc_id"], "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base_found"), ",").alias("base_labels"), F.array_join(F.array_sort(labels), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(share).alias("score"),
    )
