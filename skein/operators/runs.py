"""Extraction runs: merging, retry sets, resuming, and the check of extracted relations."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import text as T

# Types of entities.
TYPES = ("Condition", "Symptom", "AssessmentTool", "Intervention", "Mechanism", "Comorbidity", "AgeStage", "Setting", "Risk", "Evidence", "Claim", "Task")
# Entity types that each relation may join.
ALLOWED = {
    "MEASURED_BY": (("Condition", "Symptom", "Task", "Mechanism", "Comorbidity", "Claim"), ("AssessmentTool",)),
    "INDICATED_FOR": (("Intervention",), ("Condition", "Symptom", "Comorbidity")),
    "NOT_INDICATED_FOR": (("Intervention",), ("Condition", "Symptom", "Comorbidity")),
    "SUITABLE_AGE": (("Intervention", "Condition"), ("AgeStage",)),
    "SUITABLE_SETTING": (("Intervention",), ("Setting",)),
    "HAS_RISK": (("Intervention",), ("Risk",)),
    "COMORBID_WITH": (("Condition", "Comorbidity"), ("Condition", "Comorbidity")),
    "SUPPORTED_BY": (("Claim",), ("Evidence",)),
}
# Parts of lower-cased names and evidence texts that the rules look for.
MARKS = {
    "algorithm": ("machine learning", "artificial intelligence", "support vector", "random forest", "deep learning", "neural network", "svm", "svr", "机器学习", "人工智能", "支持向量", "算法", "分类器", "模型"),
    "tool": (
        "量表", "问卷", "访谈", "观察表", "记录表", "筛查工具", "诊断工具", "诊断标准", "评估工具", "评估表", "检查表",
        "scale", "questionnaire", "inventory", "checklist", "interview", "schedule", "assessment", "screen",
    ),
    "task": ("任务", "范式", "paradigm", "task"),
    "test": ("任务", "paradigm", "task", "test"),
    "condition": ("asd", "autism", "autistic", "自闭症", "孤独症", "谱系障碍"),
    "generic": ("技术", "方法", "工具", "technique", "technology", "method", "approach"),
    "specific": ("eeg", "erp", "fmri", "meg", "mri", "pet", "spect", "ados", "adi", "m-chat", "vb-mapp", "abc", "cars"),
    "modality": ("mri", "dti", "eeg", "erp", "meg", "eye-tracking", "earlipoint", "touchscreen", "弥散张量成像", "脑电", "眼动", "磁共振", "脑磁图", "事件相关电位"),
    "screening": ("ados", "adi", "chat", "cars", "abc", "量表", "问卷", "访谈", "观察表", "筛查工具", "诊断工具"),
    "performance": (
        "sensitivity", "specificity", "accuracy", "precision", "auc", "approved", "fda", "diagnostic tool", "screening tool",
        "敏感性", "特异性", "准确率", "正确率", "精确率", "批准", "获批",
    ),
    "summary": ("梳理了", "综述", "参考价值", "能够反映", "可反映", "研究成果", "provide reference", "reviewed", "overview"),
    "measure": ("diagnos", "screen", "assess", "measure", "evaluate", "identify", "诊断", "筛查", "评估", "测量", "识别", "检出"),
    "context": (
        "asd", "autism", "自闭症", "孤独症", "谱系障碍", "诊断", "筛查", "量表", "标准", "访谈", "观察",
        "diagnostic", "diagnosis", "screening", "assessment", "scale", "interview", "observation",
    ),
    "study": ("研究表明", "研究发现", "显示", "提示", "发现", "通过", "使用", "采用", "measured by", "measured with", "assessed by", "assessed with", "using", "used", "found", "showed", "demonstrated"),
    "age": ("岁", "year", "years", "month", "儿童", "青少年", "幼儿", "adolescent", "preschool", "school-age", "adult"),
}
# A text of so few characters, or without any of these marks, is a title and no evidence.
TITLE_CHARS, SENTENCE_MARKS = 18, "[。！？!?；;:：,.，]"
#: Characters that a text which names a condition's tool has at least to count as evidence all the same.
SNIPPET_CHARS = 20
# Parts of error messages that are worth another try.
TRANSIENT = ("timeout", "timed out", "429", "502", "503", "504", "connection reset")


def merged(records: DataFrame, key: str, seq: str, ok: Column) -> DataFrame:
    """One row for each key: the last of the good records, or the last of all if none is good."""
    picked = records.groupBy(key).agg(
        F.max_by(F.struct(*records.columns), F.struct(ok.cast("int"), F.col(seq))).alias("row"), F.min(seq).alias("first_seq"), F.count("*").alias("n_records")
    )
    return picked.select("row.*", "first_seq", "n_records")


def retry_set(chunks: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    return chunks.join(failed.select(key).distinct(), key, "left_semi")


def unseen(chunks: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return chunks.join(seen.select(key).distinct(), key, "left_anti")


def next_index(seen: DataFrame, key: str) -> DataFrame:
    """One row: the smallest index from 0 that wasn't seen.

    A gap starts behind a seen index whose successor wasn't seen, or at 0: an anti join, not a scan of the whole range.
    """
    own = seen.select(F.col(key).alias("i")).where(F.col("i") >= 0).distinct()
    starts = own.select((F.col("i") + 1).alias("i")).unionByName(own.sparkSession.range(1).select(F.col("id").alias("i")))
    return starts.join(own, "i", "left_anti").agg(F.min("i").alias("next_index"))


def retryable(message: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    return F.exists(F.array(*map(F.lit, TRANSIENT)), lambda x: F.contains(low, x))


def allowed_pairs(spark) -> DataFrame:
    rows = [(r, s, d) for r, (sources, targets) in ALLOWED.items() for s in sources for d in targets]
    return spark.createDataFrame(rows, "relation_type string, src_type string, dst_type string")


def _plain(text: Column) -> Column:
    """Lower-cased, with single spaces."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"(?U){T.SPACE}+", " ")))


def _has(text: Column, marks: str) -> Column:
    return text.rlike("|".join(map(re.escape, MARKS[marks])))


def typed(entities: DataFrame) -> DataFrame:
    """entities (chunk_id, entity_id, name, type, synonyms) with the type that their name tells, and reject_reason (null: kept)."""
    name, kind = _plain(F.col("name")), F.coalesce("type", F.lit(""))
    algorithm = _has(name, "algorithm")
    tool = _has(name, "tool") & ~algorithm
    told = (
        F.when((kind == "AssessmentTool") & algorithm, "Mechanism")
        .when(_has(name, "task") & ~tool & (kind != "Intervention"), "Task")
        .when((kind == "AssessmentTool") | tool, "AssessmentTool")
        .when(_has(name, "condition"), "Condition")
        .when(_has(name, "test") & (kind != "Intervention"), "Task")
        .otherwise(F.col("type"))
    )
    generic = (F.col("type") == "AssessmentTool") & _has(name, "generic") & ~_has(name, "specific")
    reason = F.when(~F.coalesce(F.col("type").isin(*TYPES), F.lit(False)), "invalid_entity_type").when(generic, "generic_assessment_tool")
    return entities.withColumn("type", told).withColumn("reject_reason", reason)


def checked(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """relations with src_type, dst_type, confidence within 0 and 1, and reject_reason of the first rule that fails (null: kept).

    relations: chunk_id, src_id, relation_type, dst_id, evidence_text, confidence; entities: chunk_id, entity_id, name, type,
    synonyms.  Ends are looked for among the entities of the relation's chunk that pass `typed`; of an id that stands twice in
    a chunk the last counts, by `place` if entities have one, else by its fields.  Entities without a chunk_id are known to every
    chunk that a relation names them in, so they are judged once and met by their id.
    """
    by = [c for c in ("chunk_id", "entity_id") if c in entities.columns]
    names = F.concat(F.array("name"), F.coalesce("synonyms", F.array().cast("array<string>")))
    last = F.struct(*[F.col(c) for c in ("place", "type", "name", "synonyms") if c in entities.columns]).alias("last")
    kept = typed(entities).where("reject_reason is null").select(*by, "name", "type", F.filter(F.transform(names, _plain), lambda a: a != "").alias("names"), last)
    kept = kept.groupBy(*by).agg(F.max_by(F.struct("type", "name", "names"), "last").alias("k")).select(*by, "k.*")
    ends = relations.drop("src_type", "dst_type")
    for side in ("src", "dst"):
        own = kept.select(*(F.col(c).alias(f"of_{c}") for c in by), *(F.col(c).alias(f"{side}_{c}") for c in ("type", "name", "names")))
        there = F.col("chunk_id") == F.col("of_chunk_id") if "chunk_id" in by else F.col("chunk_id").isNotNull()
        ends = ends.join(own, there & (F.col(f"{side}_id") == F.col("of_entity_id")), "left").drop(*(f"of_{c}" for c in by))
    pairs = F.broadcast(allowed_pairs(relations.sparkSession).withColumn("legal", F.lit(True)))
    ends = ends.join(pairs, ["relation_type", "src_type", "dst_type"], "left").withColumns({"low": _plain(F.col("evidence_text")), "tool": _plain(F.col("dst_name"))})
    low, tool = F.col("low"), F.col("tool")
    named = lambda side: F.exists(f"{side}_names", lambda a: F.contains(low, a))
    measured, aged, condition = F.col("relation_type") == "MEASURED_BY", F.col("relation_type") == "SUITABLE_AGE", F.col("src_type") == "Condition"
    modality = _has(tool, "modality") & ~_has(tool, "screening")
    title = (F.length(low) <= TITLE_CHARS) | ~low.rlike(SENTENCE_MARKS)
    snippet = measured & condition & (F.length(low) >= SNIPPET_CHARS) & named("dst") & _has(low, "context")
    reason = (
        F.when(~F.coalesce(F.col("relation_type").isin(*ALLOWED), F.lit(False)), "invalid_relation_type")
        .when(F.col("src_type").isNull() | F.col("dst_type").isNull(), "orphan_relation")
        .when(F.col("legal").isNull(), "illegal_relation_pair")
        .when(title & ~(snippet & (~modality | _has(low, "performance"))), "weak_evidence_text")
        .when(measured & _has(low, "summary"), "summary_style_measurement")
        .when(measured & _has(tool, "algorithm"), "algorithmic_tool_not_assessment")
        .when(measured & ~named("dst"), "tool_not_mentioned")
        .when(measured & ~condition & ~named("src"), "source_not_mentioned")
        .when(measured & condition & ~_has(low, "measure") & ~_has(low, "context"), "condition_measure_without_trigger")
        .when(measured & condition & modality & ~_has(low, "performance"), "research_modality_without_clinical_signal")
        .when(measured & ~condition & ~_has(low, "study"), "measurement_without_study_trigger")
        .when(aged & ~named("dst"), "age_not_mentioned")
        .when(aged & ~_has(low, "age"), "weak_age_evidence")
    )
    number = F.col("confidence").try_cast("double")
    clamped = F.when(number.isNull() | F.isnan(number), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))
    own = [c for c in relations.columns if c not in ("confidence", "src_type", "dst_type", "reject_reason")]
    return ends.select(*own, "src_type", "dst_type", clamped.alias("confidence"), reason.alias("reject_reason"))


def revalidated(records: DataFrame, key: str, relations: DataFrame, entities: DataFrame) -> DataFrame:
    """records (key, status) with the entities and relations that pass today's rules, and warnings; error rows pass as they are.

    n_entities and n_relations count what passes, warnings how much was rejected for each reason, such as reason:2, sorted;
    0 and none for error rows.  Entities without a chunk_id count in each chunk that a relation names them in.
    """
    bad = lambda df: df.select(F.col("chunk_id").alias("k"), "reject_reason")
    judged = typed(entities)
    if "chunk_id" not in entities.columns:
        ends = relations.select("chunk_id", F.explode(F.array("src_id", "dst_id")).alias("entity_id")).distinct()
        judged = ends.join(judged.select("entity_id", "reject_reason"), "entity_id")
    both = bad(judged).withColumn("entity", F.lit(True)).unionByName(bad(checked(relations, entities)).withColumn("entity", F.lit(False)))
    counted = both.groupBy("k", "reject_reason", "entity").agg(F.count("*").alias("n"))
    kept = F.col("reject_reason").isNull()
    line = F.when(~kept, F.concat_ws(":", "reject_reason", "n"))
    summed = counted.groupBy("k").agg(
        F.sum(F.when(kept & F.col("entity"), F.col("n"))).alias("e"), F.sum(F.when(kept & ~F.col("entity"), F.col("n"))).alias("r"), F.array_sort(F.collect_list(line)).alias("w")
    )
    ok = F.col("status") == "ok"
    joined = records.join(summed, records[key] == F.col("k"), "left").withColumn("w", F.coalesce("w", F.array().cast("array<string>")))
    return joined.select(
        *[records[c] for c in records.columns], F.when(ok, F.coalesce("e", F.lit(0))).otherwise(0).alias("n_entities"), F.when(ok, F.coalesce("r", F.lit(0))).otherwise(0).alias("n_relations"),
        F.when(ok, F.array_join("w", "|")).otherwise("").alias("warnings"),
    )
