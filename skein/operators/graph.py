"""The property graph: degrees, quality flags, resolution and merging of entities, export, paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as T

# Marks of tool classes, the first class that fits wins.
TOOL_CLASSES = {
    "digital_algorithm": (
        "machine learning", "deep learning", "artificial intelligence", "computer vision", "neural network", "random forest", "support vector", "svm",
        "人工智能", "机器学习", "深度学习", "计算机视觉", "算法", "分类器",
    ),
    "clinical_assessment": (
        "ados", "adi-r", "adi", "m-chat", "chat", "cars", "abc", "atec", "srs", "scq", "aq", "cast", "stat", "dsm", "量表", "问卷", "访谈", "观察表",
        "评定量表", "筛查表", "诊断标准",
    ),
    "research_modality": ("eeg", "erp", "fmri", "smri", "mri", "fnirs", "meg", "pet", "eye-tracking", "眼动", "脑电", "磁共振", "近红外", "功能连接"),
    "generic_method": ("technology", "technique", "method", "approach", "工具", "技术", "方法"),
}
# Tool classes whose measurements are for research only; relations that need a guardrail.
RESTRICTED = ("research_modality", "digital_algorithm", "generic_method")
GUARDED = ("INDICATED_FOR", "NOT_INDICATED_FOR", "HAS_RISK")


def tool_class(text: Column) -> Column:
    low = F.lower(text)
    out = F.when(F.lit(False), "")
    for label, words in TOOL_CLASSES.items():
        out = out.when(T.contains_any(low, words), label)
    return out.otherwise("unspecified_assessment")


def both_ways(relations: DataFrame) -> DataFrame:
    """entity_id, other_id, relation_id, relation_type: each relation from either end; relations are read once."""
    end = lambda own, other: F.struct(F.col(own).alias("entity_id"), F.col(other).alias("other_id"))
    ends = F.explode(F.array(end("src_id", "dst_id"), end("dst_id", "src_id"))).alias("end")
    return relations.select("relation_id", "relation_type", ends).select("end.entity_id", "end.other_id", "relation_id", "relation_type")


def degrees(entities: DataFrame, relations: DataFrame, evidence_edges: DataFrame | None = None) -> DataFrame:
    """entity_id, degree: relation ends at the entity (a loop counts twice), and evidence edges if given."""
    ends = both_ways(relations).select("entity_id")
    if evidence_edges is not None:
        ends = ends.unionByName(evidence_edges.select("entity_id"))
    counted = ends.groupBy("entity_id").agg(F.count("*").alias("degree"))
    return entities.select("entity_id").join(counted, "entity_id", "left").select("entity_id", F.coalesce("degree", F.lit(0)).alias("degree"))


def aliases(entities: DataFrame) -> DataFrame:
    """entity_id, type, alias: distinct keys of name and synonyms."""
    names = F.concat(F.array("name"), F.coalesce("synonyms", F.array().cast("array<string>")))
    keys = F.array_distinct(F.filter(F.transform(names, T.name_key), lambda k: k != ""))
    return entities.select("entity_id", "type", F.explode(keys).alias("alias"))


def alias_conflicts(entities: DataFrame) -> DataFrame:
    """alias, n_types, n_entities: keys that entities of several types have."""
    found = aliases(entities).groupBy("alias").agg(F.count_distinct("type").alias("n_types"), F.count_distinct("entity_id").alias("n_entities"))
    return found.where("n_types > 1")


def same_names(entities: DataFrame) -> DataFrame:
    """name_key, size, types: groups of entities with one name key, of more than one member."""
    grouped = entities.groupBy(T.name_key(F.col("name")).alias("name_key"))
    found = grouped.agg(F.count("*").alias("size"), F.array_sort(F.collect_set("type")).alias("types"))
    return found.where((F.col("size") > 1) & (F.col("name_key") != ""))


def entity_flags(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """entity_id, degree, conflict_aliases, group_size, tool_category, flags."""
    conflicts = aliases(entities).join(alias_conflicts(entities).select("alias"), "alias")
    own = conflicts.groupBy("entity_id").agg(F.array_sort(F.collect_set("alias")).alias("conflict_aliases"))
    named = entities.withColumn("name_key", T.name_key(F.col("name"))).join(same_names(entities).select("name_key", "size"), "name_key", "left")
    joined = named.join(degrees(entities, relations), "entity_id").join(own, "entity_id", "left")
    words = F.concat_ws(" ", "name", "synonyms")
    joined = joined.withColumn("tool_category", F.when(F.col("type") == "AssessmentTool", tool_class(words)).otherwise(""))
    flags = F.array(
        F.when(F.col("tool_category").isin(*RESTRICTED), F.concat(F.lit("assessment_tool_category:"), F.col("tool_category"))),
        F.when(F.col("conflict_aliases").isNotNull(), "alias_type_conflict"),
        F.when(F.col("degree") == 0, "isolated_entity"),
        F.when(F.col("size") > 1, "same_name_duplicate"),
        F.when(F.col("source_chunk_count") <= 1, "single_chunk_entity"),
    )
    return joined.select(
        "entity_id", "degree", F.coalesce("conflict_aliases", F.array().cast("array<string>")).alias("conflict_aliases"),
        F.coalesce("size", F.lit(1)).alias("group_size"), "tool_category", F.array_sort(F.array_compact(flags)).alias("flags"),
    )


def relation_flags(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """relations with src_type, dst_type, flags and qa_usage; the strictest usage wins."""
    src = entities.select(F.col("entity_id").alias("src_id"), F.col("type").alias("src_type"))
    joined = relations.join(src, "src_id", "left").join(_tools(entities, "type"), "dst_id", "left")
    return _flagged(joined)


def _tools(entities: DataFrame, *more: str) -> DataFrame:
    """dst_id, tool (class of a tool, else null), and more columns of entities as dst_..."""
    words = F.concat_ws(" ", "name", "synonyms")
    return entities.select(F.col("entity_id").alias("dst_id"), *(F.col(c).alias(f"dst_{c}") for c in more), F.when(F.col("type") == "AssessmentTool", tool_class(words)).alias("tool"))


def _flagged(joined: DataFrame) -> DataFrame:
    tool = (F.col("relation_type") == "MEASURED_BY") & F.col("tool").isin(*RESTRICTED)
    single, low = F.coalesce("support_count", F.lit(0)) <= 1, F.coalesce("confidence", F.lit(0.0)) < 0.5
    guarded = F.col("relation_type").isin(*GUARDED)
    flags = F.array(
        F.when(guarded, "clinical_answer_requires_evidence_guardrail"),
        F.when(low, "low_confidence"),
        F.when(tool, F.concat(F.lit("measurement_tool_category:"), F.col("tool"))),
        F.when(F.col("src_id") == F.col("dst_id"), "self_relation"),
        F.when(single, "single_evidence_relation"),
    )
    usage = F.when(guarded, "guardrailed_clinical_context").when(tool, "research_context_only").when(low | single, "use_with_caution").otherwise("standard")
    return joined.withColumns({"flags": F.array_sort(F.array_compact(flags)), "qa_usage": usage}).drop("tool")


def usage_counts(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """relation_type, qa_usage, flags, n: how many relations `relation_flags` gives which flags.

    Flags don't depend on where a relation begins, so relations are counted by what tells them apart before they meet the
    entities: as many rows as entities that relations lead to, a few for each.
    """
    support, sure = F.least(F.coalesce("support_count", F.lit(0)), F.lit(2)), F.when(F.coalesce("confidence", F.lit(0.0)) < 0.5, 0.0).otherwise(1.0)
    own = F.when(F.col("src_id") == F.col("dst_id"), F.col("dst_id"))
    kinds = relations.select("relation_type", "dst_id", support.alias("support_count"), sure.alias("confidence"), own.alias("src_id"))
    counted = kinds.groupBy(*kinds.columns).agg(F.count("*").alias("times"))
    return _flagged(counted.join(_tools(entities), "dst_id", "left")).groupBy("relation_type", "qa_usage", "flags").agg(F.sum("times").alias("n"))


def ended(relations: DataFrame, entities: DataFrame, *columns) -> DataFrame:
    """relations between entities, with columns of both (src_..., dst_...): one join for each end."""
    for side in ("src", "dst"):
        held = entities.select(F.col("entity_id").alias(f"{side}_id"), *columns)
        relations = relations.join(held.select(f"{side}_id", *(F.col(c).alias(f"{side}_{c}") for c in held.columns[1:])), f"{side}_id")
    return relations


def level_summary(supports: DataFrame, evidence: DataFrame) -> DataFrame:
    """relation_id, summary such as A:2|B:1 of supports (relation_id, evidence_id)."""
    levels = supports.join(evidence.select("evidence_id", "evidence_level"), "evidence_id", "left").withColumn("level", F.coalesce("evidence_level", F.lit("unknown")))
    counted = levels.groupBy("relation_id", "level").agg(F.count("*").alias("n"))
    parts = F.array_sort(F.collect_list(F.concat_ws(":", "level", "n")))
    return counted.groupBy("relation_id").agg(F.array_join(parts, "|").alias("summary"))


def merged(entities: DataFrame, merge_types) -> DataFrame:
    """One row for each group of same-named entities of a mergeable type; others stay alone.

    The primary is the member of most chunks, then documents, then the shortest name, then the smallest id.
    """
    key = F.when(F.col("type").isin(*merge_types), T.name_key(F.col("name"))).otherwise(F.col("entity_id"))
    order = F.struct(-F.col("source_chunk_count"), -F.col("source_doc_count"), F.length("name"), F.col("entity_id"))
    grouped = entities.groupBy("type", key.alias("key")).agg(
        F.min_by("entity_id", order).alias("primary_id"), F.min_by("name", order).alias("name"), F.count("*").alias("members"),
        F.sum("source_chunk_count").alias("source_chunk_count"), F.array_sort(F.collect_list("entity_id")).alias("member_ids"),
    )
    return grouped.drop("key")


def remapped(relations: DataFrame, merged_entities: DataFrame, supports: DataFrame) -> DataFrame:
    """Relations between merged entities: loops go, equal triples become one.

    support_count: distinct evidence of supports (relation_id, evidence_id); confidence: the mean, to 4 places.
    """
    of = merged_entities.select("primary_id", F.explode("member_ids").alias("member"))
    out = relations
    for side in ("src_id", "dst_id"):
        names = of.select(F.col("member").alias(side), F.col("primary_id").alias("to"))
        out = out.join(names, side, "left").withColumn(side, F.coalesce("to", side)).drop("to")
    triple = ["src_id", "relation_type", "dst_id"]
    out = out.where("src_id <> dst_id")
    backed = out.select("relation_id", *triple).join(supports, "relation_id").groupBy(*triple).agg(F.count_distinct("evidence_id").alias("support_count"))
    return averaged(out, triple).join(backed, triple, "left").select(*triple, F.coalesce("support_count", F.lit(0)).alias("support_count"), "confidence", "n_merged")


def averaged(relations: DataFrame, triple, *more: Column) -> DataFrame:
    """The columns of triple, confidence (the mean, to 4 places), n_merged (relations) and more sums of relations."""
    # Whole millionths: their sum is the same in any order, and so is its rounding.
    grouped = relations.groupBy(*triple).agg(F.sum(F.round(F.col("confidence") * 1_000_000).cast("long")).alias("s"), F.count("confidence").alias("c"), F.count("*").alias("n_merged"), *more)
    mean = F.expr("(2 * s + 100 * c) div (200 * c)") / 10_000
    return grouped.withColumn("confidence", F.when(F.col("c") > 0, mean)).drop("s", "c")


def best_name(mentions: DataFrame, key: str) -> DataFrame:
    """key, best: the most frequent name, then the shortest, then the first by letters."""
    counted = mentions.groupBy(key, "name").agg(F.count("*").alias("n"))
    return counted.groupBy(key).agg(F.min_by("name", F.struct(-F.col("n"), F.length("name"), F.col("name"))).alias("best"))


def neighbours(matched: DataFrame, relations: DataFrame) -> DataFrame:
    """entity_id, relation_type, other_id: one hop either way from the matched entities."""
    return both_ways(relations).join(matched.select("entity_id").distinct(), "entity_id", "left_semi").select("entity_id", "relation_type", "other_id")


def touching(relations: DataFrame, ids: DataFrame) -> DataFrame:
    """Relations with either end in ids (entity_id): one equi-join over both ends, each relation once."""
    rows = relations.withColumn("end", F.explode(F.array_distinct(F.array("src_id", "dst_id"))))
    near = rows.join(ids.select(F.col("entity_id").alias("end")).distinct(), "end", "left_semi")
    # Two relations may share a short id, so their ends and type count too.
    return near.drop("end").dropDuplicates(["relation_id", "src_id", "relation_type", "dst_id"])


def induced(relations: DataFrame, ids: DataFrame) -> DataFrame:
    """Relations with both ends in ids (entity_id)."""
    ids = ids.select("entity_id").distinct()
    src = relations.join(ids.withColumnRenamed("entity_id", "src_id"), "src_id", "left_semi")
    return src.join(ids.withColumnRenamed("entity_id", "dst_id"), "dst_id", "left_semi")


def evidence_chunks(ids: DataFrame, relations: DataFrame, supports: DataFrame, evidence: DataFrame) -> DataFrame:
    """chunk_id: chunks behind the evidence of relations that start at ids, or at a neighbour of theirs."""
    near = ids.select("entity_id").unionByName(neighbours(ids, relations).select(F.col("other_id").alias("entity_id"))).distinct()
    own = relations.join(near.withColumnRenamed("entity_id", "src_id"), "src_id", "left_semi").select("relation_id")
    return supports.join(own, "relation_id", "left_semi").join(evidence.select("evidence_id", "chunk_id"), "evidence_id").select("chunk_id").distinct()


def ranked_evidence(ranked: DataFrame, supports: DataFrame, evidence: DataFrame) -> DataFrame:
    """rank, relation_id, evidence_id, chunk_id: evidence in the order of ranked (relation_id, rank)."""
    return ranked.join(supports, "relation_id").join(evidence.select("evidence_id", "chunk_id"), "evidence_id").select("rank", "relation_id", "evidence_id", "chunk_id")


def resolved(entities: DataFrame) -> DataFrame:
    """entity_id, canonical_id: entities of a type that share aliases, however far apart, have one canonical id.

    Labels run over the bipartite graph of entities and aliases: each round takes the smallest label of an alias's
    entities, then of an entity's aliases.  The entity that was the label learns of a smaller one too, and labels are
    followed to their own labels, so that long chains settle in few rounds.  Rounds go on until no label changes; labels only
    fall, so they end.  The lineage ends at a checkpoint in each round.
    """
    edges = aliases(entities).select("entity_id", F.concat_ws("|", "type", "alias").alias("alias")).distinct()
    labels = entities.select("entity_id", F.col("entity_id").alias("label"))
    while True:
        least = edges.join(labels, "entity_id").groupBy("alias").agg(F.min("label").alias("label"))
        near = edges.join(least, "alias").groupBy("entity_id").agg(F.min("label").alias("near"))
        seen = labels.join(near, "entity_id", "left").select("entity_id", "label", F.least("label", "near").alias("near"))
        told = seen.select("entity_id", "near").unionByName(seen.select(F.col("label").alias("entity_id"), "near"))
        told = told.groupBy("entity_id").agg(F.min("near").alias("told"))
        further = told.select(F.col("entity_id").alias("told"), F.col("told").alias("further"))
        now = labels.join(told, "entity_id", "left").join(further, "told", "left").select("entity_id", "label", F.coalesce("further", "label").alias("new")).checkpoint()
        if not now.where("new <> label").take(1):
            return now.select("entity_id", F.col("label").alias("canonical_id"))
        labels = now.select("entity_id", F.col("new").alias("label"))


def ranks(df: DataFrame, *order: Column) -> DataFrame:
    """df with rank from 1 by a total order; for few rows only, such as a top-k result."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


#: Columns of the exported tables and the keys that an import merges them by.
EXPORT = {
    "entity": ("entity_id string, name string, type string, synonyms string, source_chunk_count long", ["entity_id"]),
    "chunk": ("chunk_id string", ["chunk_id"]),
    "evidence": ("evidence_id string, evidence_level string", ["evidence_id"]),
    "relation": ("start_id string, end_id string, type string, relation_id string, support_count long, confidence double", ["relation_id"]),
    "supported_by": ("start_id string, end_id string, relation_id string", ["start_id", "end_id", "relation_id"]),
    "from_chunk": ("start_id string, end_id string", ["start_id", "end_id"]),
}


def exported(entities: DataFrame, relations: DataFrame, supports: DataFrame, evidence: DataFrame) -> dict[str, DataFrame]:
    """Three tables of nodes and three of edges for a graph import, each row once; edges lead to nodes that are exported.

    A relation's support leads from the entity it begins at to the evidence.  Relation ids are short hashes, so among tens of
    millions of relations two may share one: both are exported, told apart by their ends and type.
    """
    nodes = entities.select("entity_id", "name", "type", F.array_join("synonyms", "|").alias("synonyms"), "source_chunk_count").dropDuplicates(["entity_id"])
    proof = evidence.select("evidence_id", "evidence_level").dropDuplicates(["evidence_id"])
    typed = relations.select(F.col("src_id").alias("start_id"), F.col("dst_id").alias("end_id"), F.col("relation_type").alias("type"), "relation_id", "support_count", "confidence")
    for end in ("start_id", "end_id"):
        typed = typed.join(nodes.select(F.col("entity_id").alias(end)), end, "left_semi")
    backed = supports.join(typed.select("relation_id", "start_id"), "relation_id").join(proof.select("evidence_id"), "evidence_id", "left_semi")
    held = evidence.where("chunk_id is not null").select(F.col("evidence_id").alias("start_id"), F.col("chunk_id").alias("end_id")).distinct()
    tables = {
        "entity": nodes, "chunk": held.select(F.col("end_id").alias("chunk_id")).distinct(), "evidence": proof, "relation": typed.dropDuplicates(["start_id", "end_id", "type", "relation_id"]),
        "supported_by": backed.select("start_id", F.col("evidence_id").alias("end_id"), "relation_id").distinct(), "from_chunk": held,
    }
    return {name: df.select(*[c.split()[0] for c in EXPORT[name][0].split(", ")]) for name, df in tables.items()}


def top_pairs(relations: DataFrame, entities: DataFrame, relation_type: str, n: int = 25) -> DataFrame:
    """src_name, dst_name, support_count of the n best supported relations of a type."""
    top = relations.where(F.col("relation_type") == relation_type).orderBy(F.desc("support_count"), F.desc("confidence"), "relation_id").limit(n)
    named = entities.select("entity_id", "name")
    src, dst = (named.select(F.col("entity_id").alias(f"{s}_id"), F.col("name").alias(f"{s}_name")) for s in ("src", "dst"))
    return top.join(src, "src_id").join(dst, "dst_id").select("relation_id", "src_name", "dst_name", "support_count")


def ranked_entity_evidence(ranked: DataFrame, relations: DataFrame, supports: DataFrame, evidence: DataFrame, keep: int) -> DataFrame:
    """rank, entity_id, evidence_id, chunk_id: evidence of the relations that start at ranked (entity_id, rank), `keep` rows by rank."""
    own = relations.join(ranked.withColumnRenamed("entity_id", "src_id"), "src_id").select("rank", F.col("src_id").alias("entity_id"), "relation_id")
    found = own.join(supports, "relation_id").join(evidence.select("evidence_id", "chunk_id"), "evidence_id").select("rank", "entity_id", "evidence_id", "chunk_id")
    return found.distinct().orderBy("rank", "entity_id", "evidence_id").limit(keep)


def evidence_trace(relations: DataFrame, supports: DataFrame, evidence: DataFrame) -> DataFrame:
    """relation_id, evidence_id, chunk_id behind the one relation of most support."""
    top = relations.orderBy(F.desc("support_count"), F.desc("confidence"), "relation_id").limit(1).select("relation_id")
    return supports.join(F.broadcast(top), "relation_id").join(evidence.select("evidence_id", "chunk_id"), "evidence_id").select("relation_id", "evidence_id", "chunk_id")


def normalised(mentions: DataFrame) -> DataFrame:
    """One row for each type and name key of mentions (type, name, synonyms, description, chunk_id, doc_id).

    The name is the most frequent, then the shortest, then the first; descriptions likewise; synonyms, chunks and documents
    are distinct.  Mentions without a name are left out.
    """
    named = mentions.withColumns({"key": T.name_key(F.col("name")), "name": F.trim("name")}).where("key <> ''")
    counted = named.groupBy("type", "key", "name").agg(F.count("*").alias("n"))
    names = counted.groupBy("type", "key").agg(F.min_by("name", F.struct(-F.col("n"), F.length("name"), F.col("name"))).alias("name"), F.sum("n").alias("n_mentions"), F.count("*").alias("n_names"))
    told = named.where("trim(description) <> ''").groupBy("type", "key", "description").agg(F.count("*").alias("n"))
    told = told.groupBy("type", "key").agg(F.min_by("description", F.struct(-F.col("n"), F.length("description"), F.col("description"))).alias("description"))
    sets = named.groupBy("type", "key").agg(F.count_distinct("chunk_id").alias("source_chunk_count"), F.count_distinct("doc_id").alias("source_doc_count"))
    words = named.select("type", "key", F.explode(F.concat(F.array("name"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("word")).where("trim(word) <> ''")
    words = words.groupBy("type", "key").agg(F.array_sort(F.collect_set("word")).alias("synonyms"))
    return names.join(told, ["type", "key"], "left").join(sets, ["type", "key"]).join(words, ["type", "key"])


def marked_relations(relations: DataFrame, entities: DataFrame, kind: str, markers, limit: int) -> DataFrame:
    """relation_id, source, source_type, target, support_count: relations whose target's name has a marker in any case, best supported first."""
    target = entities.where(T.contains_any(F.lower("name"), [m.lower() for m in markers])).select(F.col("entity_id").alias("dst_id"), F.col("name").alias("target"))
    source = entities.select(F.col("entity_id").alias("src_id"), F.col("name").alias("source"), F.col("type").alias("source_type"))
    top = relations.where(F.col("relation_type") == kind).join(target, "dst_id").orderBy(F.desc("support_count"), "relation_id").limit(limit)
    return top.join(source, "src_id").select("relation_id", "source", "source_type", "target", "support_count")


def merge_keys(entities: DataFrame, alias_groups: DataFrame, merge_types) -> DataFrame:
    """entities with merge_key and reason: a curated group by the first alias that alias_groups (type, group_id, alias) lists, else the name.

    Entities of other types stay alone under their own id, with the reason null.
    """
    mergeable = F.coalesce(F.col("type").isin(*merge_types), F.lit(False))
    said = entities.where(mergeable).select("entity_id", "type", F.explode(F.array_append(F.coalesce("synonyms", F.array().cast("array<string>")), F.col("name"))).alias("alias"))
    listed = alias_groups.select("type", "group_id", F.explode(F.array("alias", "group_id")).alias("alias")).withColumn("alias", T.space_key(F.col("alias"))).distinct()
    found = said.withColumn("alias", T.space_key(F.col("alias"))).join(listed, ["type", "alias"])
    first = found.groupBy("entity_id").agg(F.min_by("group_id", F.struct("alias", "group_id")).alias("curated"))
    key = F.when(~mergeable, F.col("entity_id")).when(F.col("curated").isNotNull(), F.concat(F.lit("curated:"), "curated")).otherwise(T.name_key(F.col("name")))
    reason = F.when(mergeable, F.when(F.col("curated").isNotNull(), "curated_alias_map").otherwise("same_type_same_name"))
    return entities.join(first, "entity_id", "left").withColumns({"merge_key": key, "reason": reason}).drop("curated")


def merge_log(keyed: DataFrame) -> DataFrame:
    """type, merge_key, reason, primary_id, entity_count, source_chunk_count, names: one row for each group of two entities or more.

    The members are those rows of merge_keys that share type and merge_key, so a group of any size needs no list of ids.
    """
    order = F.struct(-F.col("source_chunk_count"), -F.col("source_doc_count"), F.length("name"), F.col("entity_id"))
    grouped = keyed.where("reason is not null").groupBy("type", "merge_key", "reason").agg(
        F.min_by("entity_id", order).alias("primary_id"), F.count("*").alias("entity_count"), F.sum("source_chunk_count").alias("source_chunk_count"), F.array_sort(F.collect_set("name")).alias("names")
    )
    return grouped.where("entity_count > 1")


def curated(keyed: DataFrame) -> DataFrame:
    """One row for each group of merge_keys: its primary's id, its commonest name by chunks, all synonyms, and how it was merged.

    A name counts as many times as its entity has chunks, one at least; of equal ones the shortest, then the first by letters.
    Entities without a type stay alone; without a name and an alias, those of a type share the empty name.
    """
    keyed = keyed.withColumn("kind", F.coalesce("type", F.lit("")))
    by = ["kind", "merge_key"]
    order = F.struct(-F.col("source_chunk_count"), -F.col("source_doc_count"), F.length("name"), F.col("entity_id"))
    groups = keyed.groupBy(*by).agg(
        F.min_by(F.struct("entity_id", "name", "type"), order).alias("primary"), F.count("*").alias("members"), F.sum("source_chunk_count").alias("source_chunk_count"), F.max("reason").alias("reason")
    )
    weighed = keyed.groupBy(*by, "name").agg(F.sum(F.greatest("source_chunk_count", F.lit(1))).alias("n"))
    names = weighed.groupBy(*by).agg(F.min_by("name", F.struct(-F.col("n"), F.length("name"), F.col("name"))).alias("name"))
    terms = keyed.select(*by, F.explode(F.array_append(F.coalesce("synonyms", F.array().cast("array<string>")), F.col("name"))).alias("term")).distinct()
    synonyms = terms.groupBy(*by).agg(F.array_sort(F.collect_list("term")).alias("synonyms"))
    out = groups.join(names, by).join(synonyms, by, "left")
    merged_by = F.when(F.col("members") > 1, F.concat(F.lit("merged_by:"), "reason"))
    return out.select(
        "primary.type", "primary.entity_id", "name", F.array_remove(F.coalesce("synonyms", F.array().cast("array<string>")), F.col("primary.name")).alias("synonyms"),
        "members", "source_chunk_count", F.when(F.col("reason").isNotNull(), merged_by).alias("flag"),
    )
