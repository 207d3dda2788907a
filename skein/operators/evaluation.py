"""Routing, answer policy, evaluation, comparison and latency reports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import ranks

# Terms of each route, in the order of priority.
ROUTES = {
    "safety_boundary": ("治愈", "直接治疗", "推荐用药", "停药", "不用专业评估", "无需专业评估", "替代诊断", "确定有效", "高压氧", "能否推荐"),
    "diagnostic_boundary": ("能诊断", "直接诊断", "判断是", "能判断", "就能判断", "是不是自闭症", "是不是孤独症", "只凭", "量表分数", "代替诊断", "替代诊断"),
    "intervention_advice": ("干预", "训练", "治疗", "aba", "eibi", "esdm", "家长培训", "融合支持", "感觉统合", "音乐治疗"),
    "risk_info": ("风险", "相关吗", "早产", "围产", "围生", "遗传", "家族史", "父母年龄"),
    "assessment_info": ("ados", "ados-2", "adi-r", "m-chat", "m-chat-r/f", "cars", "srs", "scq", "aq", "atec", "量表", "问卷", "筛查", "评估工具"),
}
GUARDED_ROUTES = ("safety_boundary", "diagnostic_boundary", "intervention_advice", "risk_info")
BOUNDARY_ROUTES = ("safety_boundary", "diagnostic_boundary")
FOLLOWUP_ROUTES = ("safety_boundary", "diagnostic_boundary", "intervention_advice")
# Claims that a route forbids.
FORBIDDEN = {
    "diagnostic_boundary": ("diagnosis_from_single_symptom", "questionnaire_as_diagnosis"),
    "safety_boundary": ("cure_claim", "direct_medication_advice", "certain_effectiveness_claim"),
    "intervention_advice": ("one_size_fits_all_intervention", "certain_effectiveness_claim"),
}
# Settings of the profiles, each (context_k, graph_evidence_k, chars of a context, tokens of an answer).
PROFILES = {"fast": (3, 1, 400, 500), "balanced": (4, 2, 600, 800), "deep": (8, 4, 1000, 1200)}


def routed(queries: DataFrame, routes: dict = ROUTES) -> DataFrame:
    """queries (query) with route, matched terms of that route, requires_guardrail, requires_followup."""
    low = F.lower(F.trim(F.coalesce("query", F.lit(""))))
    found = lambda terms: F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(low, t))
    route, terms = F.when(low == "", "unknown"), F.when(low == "", F.array().cast("array<string>"))
    for name, words in routes.items():
        route, terms = route.when(F.size(found(words)) > 0, name), terms.when(F.size(found(words)) > 0, found(words))
    out = queries.withColumns({"route": route.otherwise("knowledge_qa"), "terms": terms.otherwise(F.array().cast("array<string>"))})
    return out.withColumns({"requires_guardrail": F.col("route").isin(*GUARDED_ROUTES), "requires_followup": F.col("route").isin(*FOLLOWUP_ROUTES)})


def inspected(contexts: DataFrame) -> DataFrame:
    """contexts (n_contexts, n_relations, n_entities, n_low, n_research) with the flags of evidence inspection."""
    flags = {
        "has_relations": F.col("n_relations") > 0, "has_entities": F.col("n_entities") > 0, "has_low": F.col("n_low") > 0,
        "has_research": F.col("n_research") > 0, "needs_more": (F.col("n_contexts") < 3) & (F.col("n_relations") == 0),
    }
    return contexts.withColumns(flags)


def policy(rows: DataFrame) -> DataFrame:
    """rows (route, has_low, has_research) with answer_mode, guardrail, research_boundary, certainty, forbidden."""
    route, low, research = F.col("route"), F.col("has_low"), F.col("has_research")
    guardrail = route.isin(*GUARDED_ROUTES) | low | research
    certainty = ~route.isin(*BOUNDARY_ROUTES, "intervention_advice", "risk_info") & ~low & ~research
    mode = F.when(route.isin(*BOUNDARY_ROUTES), "guardrailed_answer").when(research, "evidence_answer_with_research_boundary").when(guardrail, "guardrailed_answer").otherwise("evidence_answer")
    claims = [F.when(route == r, c) for r, names in FORBIDDEN.items() for c in names] + [F.when(~certainty, "clinical_certainty")]
    forbidden = F.array_sort(F.array_distinct(F.array_compact(F.array(*claims))))
    return rows.withColumns({"answer_mode": mode, "guardrail": guardrail, "research_boundary": research, "certainty": certainty, "forbidden": forbidden})


def follows_up(rows: DataFrame) -> DataFrame:
    """rows (route and flags) with follow_up: whether a second retrieval runs."""
    lacking = ~F.col("has_relations") | ~F.col("has_entities")
    return rows.withColumn("follow_up", F.col("needs_more") | (F.col("route").isin(*FOLLOWUP_ROUTES) & lacking))


def answer_checks(rows: DataFrame, guard_terms, research_terms, claims, negations) -> DataFrame:
    """rows (answer, context, expect_terms, needs_guardrail, needs_research, dry_run, n_contexts, n_graph) with the checks and ok:
    all eight hold.  claims overstate unless a negation stands near them."""
    answer = F.coalesce("answer", F.lit(""))
    real = ~F.col("dry_run")
    low = F.lower(F.coalesce("context", F.lit("")))
    seen = (F.size("expect_terms") == 0) | F.exists("expect_terms", lambda t: F.contains(low, F.lower(t)))
    any_of = lambda words: T.contains_any(F.lower(answer), [w.lower() for w in words])
    checks = {
        "answer_present": ~real | (F.trim(answer) != ""),
        "retrieved_context": F.col("n_contexts") > 0,
        "retrieved_graph": F.col("n_graph") > 0,
        "expected_term_seen": seen,
        "answer_cited": ~real | answer.rlike(r"\[(?:C|G)\d+\]"),
        "guardrail_ok": ~(real & F.col("needs_guardrail")) | any_of(guard_terms),
        "research_boundary_ok": ~(real & F.col("needs_research")) | any_of(research_terms),
        "no_clinical_overstatement": ~overstated(answer, claims, negations),
    }
    out = rows.withColumns(checks)
    ok = F.lit(True)
    for name in checks:
        ok &= F.col(name)
    return out.withColumn("ok", ok)


def overstated(text: Column, patterns, negations, before: int = 24, after: int = 12) -> Column:
    """Whether a pattern stands in the text with no negation from `before` characters ahead of it to `after` behind it.

    One regular expression looks around each place of a pattern, so a text is read once.
    """
    quoted = [re.escape(n) for n in negations]
    ahead = rf"(?<!(?={'|'.join(quoted)}).{{1,{before}}})" if quoted else ""

    def place(pattern):
        room = len(pattern) + after
        behind = "".join(f"(?!.{{0,{room - len(n)}}}{q})" for n, q in zip(negations, quoted, strict=True) if len(n) <= room)
        return f"{ahead}{behind}{re.escape(pattern)}"

    return text.rlike("(?s)" + "|".join(map(place, patterns)))


def answer_metrics(rows: DataFrame, guard_terms, research_terms, claims, negations) -> DataFrame:
    """rows (answer, context, expect_terms, n_contexts, n_relations, n_entities, n_graph_contexts, n_cited, seconds) with 15 metrics.

    Metrics of an answer are null where there is none; that of expected terms where none are expected.
    """
    answer = F.when(F.col("answer") != "", F.col("answer"))
    context = F.lower(F.coalesce("context", F.lit("")))
    any_of = lambda words: T.contains_any(F.lower(answer), [w.lower() for w in words])
    over = overstated(answer, claims, negations)
    metrics = {
        "contexts_count": F.col("n_contexts"), "relations_count": F.col("n_relations"), "graph_entities_count": F.col("n_entities"),
        "graph_evidence_contexts_count": F.col("n_graph_contexts"), "has_context_citations": F.col("n_cited") > 0, "has_graph_relations": F.col("n_relations") > 0,
        "has_expected_context_term": F.when(F.size("expect_terms") > 0, F.exists("expect_terms", lambda t: F.contains(context, F.lower(t)))),
        "answer_has_citation": answer.rlike(r"\[[CG]\d+\]"), "answer_has_context_citation": answer.rlike(r"\[C\d+\]"), "answer_has_graph_citation": answer.rlike(r"\[G\d+\]"),
        "answer_has_guardrail": any_of(guard_terms), "answer_has_research_boundary": any_of(research_terms),
        "answer_overstates_clinical_certainty": over, "answer_avoids_clinical_overstatement": ~over, "elapsed_seconds": F.round("seconds", 2),
    }
    return rows.withColumns(metrics)


def metrics_summary(rows: DataFrame, flags, numbers) -> DataFrame:
    """metric, passed, total, rate of flags; metric, total, least, most, mean of whole numbers; metrics without values are left out.

    All of them are one aggregation, turned to a row each afterwards.
    """
    none = F.lit(None)
    aggregates, shown = [], []
    for i, name in enumerate([*flags, *numbers]):
        flag = i < len(flags)
        kept = {"total": F.count(name)} | ({"passed": F.count_if(name)} if flag else {"least": F.min(name), "most": F.max(name), "sum": F.sum(name)})
        aggregates += [value.alias(f"{key}_{i}") for key, value in kept.items()]
        at = lambda key, i=i, kept=kept: F.col(f"{key}_{i}").cast("long") if key in kept else none.cast("long")
        shown.append(
            F.struct(
                F.lit(name).alias("metric"), at("passed").alias("passed"), at("total").alias("total"), F.round(F.try_divide(at("passed"), at("total")), 4).alias("rate"),
                at("least").alias("least"), at("most").alias("most"), F.round(F.try_divide(at("sum"), at("total")), 2).alias("mean"),
            )
        )
    return rows.agg(*aggregates).select(F.explode(F.array(*shown)).alias("m")).select("m.*").where("total > 0")


def compare_summary(rows: DataFrame) -> DataFrame:
    """One row of rows (delta, follow_up, relation_delta, seconds_delta): counts by outcome, follow-ups, and spans of the deltas."""
    count = lambda *kinds: F.count_if(F.col("delta").isin(*kinds))
    spans = [f(c).alias(f"{c}_{n}") for c in ("relation_delta", "seconds_delta") for n, f in (("min", F.min), ("max", F.max))]
    mean = lambda c: F.coalesce(F.round(F.try_divide(F.sum(c).cast("double"), F.count(c)), 2), F.lit(0.0)).alias(f"{c}_avg")
    share = F.coalesce(F.round(F.try_divide(F.count_if("follow_up"), F.count("*")), 4), F.lit(0.0))
    return rows.agg(
        F.count("*").alias("total"), count("agent_win", "agent_gain").alias("improved"), count("agent_regression", "agent_loss").alias("regressed"), count("tie").alias("tied"),
        F.count_if("follow_up").alias("follow_ups"), share.alias("follow_up_rate"), *spans, mean("relation_delta"), mean("seconds_delta"),
    )


def compare_counts(rows: DataFrame) -> DataFrame:
    """kind, name, delta, n: outcomes by category, and questions by route (delta null there)."""
    pair = lambda kind, name, default, value: F.struct(F.lit(kind).alias("kind"), F.coalesce(name, F.lit(default)).alias("name"), value.alias("delta"))
    both = F.array(pair("category", "category", "uncategorized", F.col("delta")), pair("route", "route", "unknown", F.lit(None).cast("string")))
    return rows.select(F.explode(both).alias("p")).groupBy("p.kind", "p.name", "p.delta").agg(F.count("*").alias("n"))


def summary(rows: DataFrame, checks: list[str], by: str = "category") -> DataFrame:
    """by, total, and for each check how many pass; one aggregation."""
    return rows.groupBy(by).agg(F.count("*").alias("total"), F.count_if("ok").alias("n_ok"), *[F.count_if(c).alias(f"n_{c}") for c in checks])


def delta(base_ok: Column, agent_ok: Column, base_graph: Column, agent_graph: Column, base_n: Column, agent_n: Column) -> Column:
    """How the second run compares with the first; the first difference decides."""
    return (
        F.when(~base_ok & agent_ok, "agent_win")
        .when(base_ok & ~agent_ok, "agent_regression")
        .when(~base_graph & agent_graph, "agent_win")
        .when(base_graph & ~agent_graph, "agent_regression")
        .when(agent_n > base_n, "agent_gain")
        .when(agent_n < base_n, "agent_loss")
        .otherwise("tie")
    )


def latency(rows: DataFrame) -> DataFrame:
    """model, profile, pipeline, runs, successes, degraded, passes, median and nearest-rank 95th percentile of seconds."""
    keys = ["model", "profile", "pipeline"]
    whole = rows.groupBy(*keys).agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "done").alias("successes"), F.count_if(F.col("status") == "degraded").alias("degraded"), F.count_if("passed").alias("passes"))
    timed = ranks.at_ranks(rows.select(*keys, "seconds"), "seconds", {"lower": ranks.lower_median, "upper": ranks.upper_median, "p95": ranks.nearest95}, tuple(keys))
    timed = timed.select(*keys, ((F.col("lower") + F.col("upper")) / 2.0).alias("p50"), "p95")
    return whole.join(timed, keys, "left")


def agent_gate(summaries: DataFrame, most: float = 0.2) -> DataFrame:
    """model, profile, overhead, passed: the agent against the standard pipeline."""
    side = lambda name, p: summaries.where(F.col("pipeline") == name).select("model", "profile", *[F.col(c).alias(f"{p}_{c}") for c in ("successes", "passes", "p50")])
    both = side("agent", "a").join(side("standard", "s"), ["model", "profile"])
    over = F.when(F.col("s_p50") > 0, (F.col("a_p50") - F.col("s_p50")) / F.col("s_p50"))
    ok = (F.col("a_successes") >= F.col("s_successes")) & (F.col("a_passes") >= F.col("s_passes")) & over.isNotNull() & (over <= most)
    return both.select("model", "profile", over.alias("overhead"), ok.alias("passed"))
