"""Entity resolution as an ordered reading gives it, in parallel rounds; the second merge by names; relations re-keyed.

Read in order, an entity joins the first group that has one of its aliases, and its other aliases become that group's too;
without such a group it opens one.  So the group of an alias is that of the last entity read that has it, and an entity's
group is the smallest among those of the entities just before it in the orders of its aliases: the smallest entity from
which steps along these orders lead to it.  Each round therefore lowers an entity's label to the smallest label of all earlier
entities that share an alias, and to the label of the entity that is its label, which doubles the reach of long chains.
Rounds go on until no label changes.

An alias that many entities share is dealt to ranges of entities: the smallest label of the ranges before goes along with
each range, so no alias meets in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators import graph
from skein.sources import tables


def _placed(entities: DataFrame) -> DataFrame:
    """key (type and alias), entity_id, part: aliases in order of entities, in ranges."""
    edges = graph.aliases(entities).select(F.concat_ws("|", "type", "alias").alias("key"), "entity_id").distinct()
    parts = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return edges.repartitionByRange(parts, "key", "entity_id").withColumn("part", F.spark_partition_id()).checkpoint()


def groups_in_order(entities: DataFrame) -> DataFrame:
    """entity_id, group_id: the entity that opened the group; entities without an alias are in none.

    entities: entity_id, type, name, synonyms; the order is that of entity_id, and types don't meet.  Rows that repeat an
    entity_id give it the aliases of all of them.
    """
    tables.shared(entities.sparkSession)
    edges = _placed(entities)
    labels = edges.select("entity_id").distinct().withColumn("label", F.col("entity_id"))
    earlier = Window.partitionBy("key", "part").orderBy("entity_id").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # A hot alias has one row for each range here.
    while True:
        told = edges.join(labels, "entity_id")
        carried = told.groupBy("key", "part").agg(F.min("label").alias("least")).withColumn("ahead", F.min("least").over(before)).select("key", "part", "ahead")
        near = told.withColumn("near", F.min("label").over(earlier)).join(carried.where("ahead is not null"), ["key", "part"], "left")
        near = near.groupBy("entity_id").agg(F.min(F.least("near", "ahead")).alias("near"))
        further = labels.select(F.col("entity_id").alias("label"), F.col("label").alias("further"))
        now = labels.join(near, "entity_id", "left").join(further, "label").select("entity_id", "label", F.least("label", "near", "further").alias("new")).checkpoint()
        if not now.where("new <> label").take(1):
            return now.select("entity_id", F.col("label").alias("group_id"))
        labels = now.select("entity_id", F.col("new").alias("label"))


def canonical(entities: DataFrame) -> DataFrame:
    """entity_id, group_id, canonical_name, canonical_id: groups in order, then merged where their first alias by letters is one.

    canonical_name is that alias; canonical_id is the first of the groups that share type and name.
    """
    grouped = groups_in_order(entities)
    named = graph.aliases(entities).join(grouped, "entity_id").groupBy("type", "group_id").agg(F.min("alias").alias("canonical_name"))
    first = named.groupBy("type", "canonical_name").agg(F.min("group_id").alias("canonical_id"))
    merged = named.join(first, ["type", "canonical_name"]).select("group_id", "canonical_name", "canonical_id")
    return grouped.join(merged, "group_id").select("entity_id", "group_id", "canonical_name", "canonical_id")


def rekeyed(mentions: DataFrame, groups: DataFrame) -> DataFrame:
    """One row for each (src_id, relation_type, dst_id) of canonical entities, from the relations of single chunks.

    mentions: seq, src_id, relation_type, dst_id, confidence, evidence_text, evidence_id, chunk_id, doc_id; groups: entity_id,
    canonical_id.  Mentions with an end in no group or without a type go.  confidence is the mean (what is no number counts
    0), in ten-thousandths; evidence_example the first text that isn't blank, by seq; support counts distinct evidence, and
    ids are listed once each, sorted.
    """
    ends = groups.select("entity_id", "canonical_id").distinct()
    for side in ("src", "dst"):
        own = ends.select(F.col("entity_id").alias("e"), F.col("canonical_id").alias(f"{side}_c"))
        mentions = mentions.join(own, F.col(f"{side}_id") == F.col("e")).drop("e")
    mentions = mentions.where("relation_type <> ''")
    text = F.trim(F.coalesce("evidence_text", F.lit("")))
    number = F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0))
    # Sums of whole millionths don't depend on their order.
    part = F.rint(number * 1_000_000).cast("long")
    listed = lambda c: F.array_sort(F.collect_set(c)).alias(f"support_{c}s")
    found = mentions.groupBy(F.col("src_c").alias("src_id"), "relation_type", F.col("dst_c").alias("dst_id")).agg(
        F.count("*").alias("n"), F.sum(part).alias("s"), F.coalesce(F.min_by(F.when(text != "", text), F.when(text != "", F.struct("seq", text))), F.lit("")).alias("evidence_example"),
        F.count_distinct("evidence_id").alias("support_count"), listed("evidence_id"), listed("chunk_id"), listed("doc_id"),
    )
    mean = (F.expr("(s + 50 * n) div (100 * n)") / 10_000).alias("confidence")
    return found.select("src_id", "relation_type", "dst_id", mean, "support_count", "evidence_example", "support_evidence_ids", "support_chunk_ids", "support_doc_ids")
