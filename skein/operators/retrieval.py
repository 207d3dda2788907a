"""Batch retrieval: keywords, aliases, entity match, vector search, fusion, context assembly, text windows."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import graph, matching

# Keywords that say nothing specific; weights of evidence levels in fusion and in ranking.
GENERIC = ("asd", "autism", "孤独症", "自闭症", "孤独症谱系障碍", "自闭症谱系障碍")
FUSION = {"S": 0.1, "A": 0.05, "B": 0.0, "C": -0.02, "D": -0.05}
RANKING = {"S": 5.0, "A": 3.0, "B": 1.0, "C": 0.0, "D": -1.0}
IN_GRAPH = 0.15
#: Bytes of query vectors that are sent to every task at most.
QUERY_BYTES = 32 << 20
#: Scores that a task holds at once.
BLOCK_SCORES = 2_000_000


def weight(level: Column, weights: dict[str, float]) -> Column:
    out = F.when(F.lit(False), 0.0)
    for name, w in weights.items():
        out = out.when(level == name, w)
    return out.otherwise(0.0)


def generic(keyword: Column) -> Column:
    return T.space_key(keyword).isin(*GENERIC)


# Hint rules (keyword, triggers) in order; the anchor that any hint brings along; keywords that make a wider one
# superfluous; words that are no keywords; parts of words and of runs of characters that are conversation.
HINT_RULES = (
    ("ASD", ("asd", "autism", "孤独症", "自闭症", "谱系")), ("评估", ("评估", "量表", "问卷", "筛查", "诊断", "判断")), ("筛查", ("筛查",)), ("诊断", ("诊断", "判断", "是不是", "只凭")),
    ("干预", ("干预", "训练", "治疗", "支持策略", "干预方案")), ("专业评估", ("专业评估",)), ("研究背景", ("研究背景", "研究情境")), ("证据", ("证据", "文献", "图谱关系", "来源")),
    ("年龄", ("年龄", "两三岁", "幼儿", "婴幼儿", "成年人")), ("家庭", ("家庭", "家长")), ("学校", ("学校", "融合支持")), ("睡眠", ("睡眠", "睡不好")), ("注意力", ("注意力", "好动")), ("ADHD", ("adhd", "好动")),
    ("M-CHAT", ("两三岁", "幼儿筛查", "婴幼儿筛查")), ("饮食干预", ("饮食",)), ("高压氧", ("高压氧",)), ("治愈", ("治愈",)), ("用药", ("用药", "药物")), ("情绪", ("情绪",)), ("社交技能", ("社交技能",)),
    ("家长培训", ("家长培训", "家长介入")), ("辅助技术", ("辅助技术",)), ("沟通", ("沟通",)), ("游戏", ("游戏化", "游戏干预")), ("胃肠", ("胃肠", "肠道")), ("抑郁", ("抑郁",)), ("早产", ("早产",)), ("围产期", ("围产", "围生")),
)
ANCHOR, WIDE, NARROW = "ASD", "干预", ("家长培训", "辅助技术")
STOPWORDS = ("是什么", "什么", "它在", "有什么作用", "作用", "评估中有什么作用")
ASKING = ("什么", "作用")
CONVERSATION = ("什么", "哪些", "如何", "是否", "为什么", "能不能", "可以", "资料", "回答", "问题", "通常", "怎样", "怎么")
LONGEST_RUN = 8


def keywords(query: Column, rules=HINT_RULES) -> Column:
    """Keywords of a query: hints whose trigger it contains, in order of the rules, then its own words, each once.

    A hint brings ANCHOR to the front; WIDE goes if a hint ends in it or is one of NARROW.  Words are Latin words and runs of
    Chinese characters; runs that are long or hold a part of conversation go.  A query without any keyword is its own; null
    counts as empty.
    """
    query = F.coalesce(query, F.lit(""))
    once = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))  # noqa: E731  a value that is used several times is computed once
    listed = lambda key: F.array_compact(F.array(*[F.when(T.contains_any(key, triggers), F.lit(word)) for word, triggers in rules]))
    narrow = lambda hints: F.exists(hints, lambda h: (h != WIDE) & (F.endswith(h, F.lit(WIDE)) | h.isin(*NARROW)))
    narrowed = lambda hints: F.when(narrow(hints), F.array_remove(hints, WIDE)).otherwise(hints)
    anchored = lambda hints: F.when((F.size(hints) > 0) & ~F.array_contains(hints, ANCHOR), F.concat(F.array(F.lit(ANCHOR)), hints)).otherwise(hints)
    words = F.regexp_extract_all(query, F.lit(r"[a-zA-Z][a-zA-Z0-9_-]*|[\u4e00-\u9fff]{2,}"), F.lit(0))
    chinese = lambda w: w.rlike(r"^[\u4e00-\u9fff]")
    talk = lambda w: chinese(w) & (w.isin(*STOPWORDS) | T.contains_any(w, ASKING) | (F.length(w) > LONGEST_RUN) | T.contains_any(w, CONVERSATION))
    hints = once(once(once(T.space_key(query), listed), narrowed), anchored)
    every = F.array_distinct(F.concat(hints, F.filter(words, lambda w: ~talk(w))))
    return once(every, lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(query)))


def expanded(keyword_rows: DataFrame, alias_groups: DataFrame) -> DataFrame:
    """query_id, keyword, place: keywords (place from 0) and behind each its alias group, the first spelling of a key kept.

    alias_groups: group_id, alias.
    """
    keyed = alias_groups.select("group_id", "alias", T.space_key(F.col("alias")).alias("alias_key"))
    pairs = keyed.alias("x").join(keyed.alias("y"), "group_id").select(F.col("x.alias_key").alias("of"), F.col("y.alias").alias("also")).distinct()
    joined = keyword_rows.join(pairs, T.space_key(F.col("keyword")) == F.col("of"), "left")
    own = keyword_rows.select("query_id", "place", F.lit("").alias("second"), F.lit(0).alias("rank"), "keyword")
    more = joined.where("also is not null").select("query_id", "place", F.col("also").alias("second"), F.lit(1).alias("rank"), F.col("also").alias("keyword"))
    every = own.unionByName(more).withColumn("key", T.space_key(F.col("keyword")))
    first = every.groupBy("query_id", "key").agg(F.min(F.struct("place", "rank", "second", "keyword")).alias("f"))
    order = Window.partitionBy("query_id").orderBy("f.place", "f.rank", "f.second", "key")
    return first.select("query_id", F.col("f.keyword").alias("keyword"), (F.row_number().over(order) - 1).alias("place"))


def keyword_words(keyword_rows: DataFrame) -> DataFrame:
    """query_id, keyword, word: each keyword of a query once, with the form that names are compared in."""
    return keyword_rows.select("query_id", "keyword", T.space_key(F.col("keyword")).alias("word")).where("word <> ''").distinct()


def word_matches(entities: DataFrame, words: DataFrame, per_word: int = 80) -> DataFrame:
    """The columns of entities with word, exact: entities whose name or synonym contains the word, the first by id.

    Names are read once, by an automaton of all words, and a task passes on its own first entities of each word.
    """
    names = F.transform(F.concat(F.array("name"), F.coalesce("synonyms", F.array().cast("array<string>"))), T.space_key)
    found = matching.contained(entities.withColumn("texts", names), words, first=("entity_id", per_word))
    return found.withColumn("place", F.row_number().over(Window.partitionBy("word").orderBy("entity_id"))).where(F.col("place") <= per_word).drop("place")


def entity_matches(entities: DataFrame, keyword_rows: DataFrame, per_keyword: int = 80) -> DataFrame:
    """query_id, keyword, entity_id, exact: entities whose name or synonym contains the keyword, the first by id.

    What the words' automaton finds meets the queries by the word; a keyword that a query lists twice counts once.
    """
    words = keyword_words(keyword_rows)
    best = word_matches(entities.select("entity_id", "name", "synonyms"), words, per_keyword)
    return words.join(best, "word").select("query_id", "keyword", "entity_id", "exact")


def entity_rank(matches: DataFrame, entities: DataFrame | None, keep: int = 60) -> DataFrame:
    """query_id, rank, entity_id: matched entities by specificity, exactness, support, quality, short names, id.

    Without entities, the matches have their columns.
    """
    told = ["name", "source_chunk_count", "source_doc_count", "is_isolated"] if entities is None else []
    per = matches.groupBy("query_id", "entity_id", *told).agg(F.max("exact").alias("exact"), F.max(~generic(F.col("keyword"))).alias("specific"))
    any_specific = F.max("specific").over(Window.partitionBy("query_id"))
    per = per.withColumn("any", any_specific).where(F.col("specific") | ~F.col("any"))
    joined = per if entities is None else per.join(entities, "entity_id")
    penalty = F.when(F.col("source_chunk_count") <= 1, 10).otherwise(0) + F.when(F.col("is_isolated"), 20).otherwise(0)
    order = [F.desc("specific"), F.desc("exact"), F.desc(F.least("source_doc_count", F.lit(20))), F.desc(F.least("source_chunk_count", F.lit(100))), penalty, F.length("name"), F.col("entity_id")]
    ranked = joined.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= keep).select("query_id", "rank", "entity_id", "specific", "exact")


def relation_rank(relations: DataFrame, words: list[str], keep: int) -> DataFrame:
    """relation_id, rank by keyword hits, kind, support, confidence, id."""
    text = F.lower(F.concat_ws(" ", "src_name", "src_type", "relation_type", "dst_name", "dst_type"))
    hits = {w: F.contains(text, F.lit(w.lower())) for w in words}
    return _ranked(relations, hits, (F.col("src_type") == "AssessmentTool") | (F.col("dst_type") == "AssessmentTool"), keep)


def relation_rank_of(relations: DataFrame, entities: DataFrame, words: list[str], keep: int) -> DataFrame:
    """What `relation_rank` gives of relations between entities (entity_id, name, type).

    Each entity is looked through once, and what relations carry is which words it names; a word with a space may begin in one
    name and end in the next, so such words are looked for in the names of both ends together.
    """
    if any(" " in w for w in words):
        return relation_rank(graph.ended(relations, entities, "name", "type"), words, keep)
    text = F.lower(F.concat_ws(" ", "name", "type"))
    named = sum((F.when(F.contains(text, F.lit(w.lower())), 1 << k).otherwise(0) for k, w in enumerate(words)), F.lit(0).cast("long"))
    both = graph.ended(relations.select("relation_id", "src_id", "relation_type", "dst_id", "support_count", "confidence"), entities, named.alias("named"), F.coalesce(F.col("type") == "AssessmentTool", F.lit(False)).alias("tool"))
    kind = F.lower(F.coalesce("relation_type", F.lit("")))
    hits = {w: ((F.col("src_named").bitwiseOR(F.col("dst_named"))).bitwiseAND(F.lit(1 << k).cast("long")) != 0) | F.contains(kind, F.lit(w.lower())) for k, w in enumerate(words)}
    return _ranked(both, hits, F.col("src_tool") | F.col("dst_tool"), keep)


def _ranked(relations: DataFrame, hits: dict[str, Column], tool: Column, keep: int) -> DataFrame:
    score = sum((F.when(hit, 10.0 if w.lower() in GENERIC else 100.0).otherwise(0.0) for w, hit in hits.items()), F.lit(0.0))
    score += F.when(F.col("relation_type") == "MEASURED_BY", 15.0).otherwise(0.0)
    score += F.when(tool, 10.0).otherwise(0.0)
    top = relations.withColumn("score", score).orderBy(F.desc("score"), F.desc("support_count"), F.desc("confidence"), "relation_id").limit(keep)
    order = [F.desc("score"), F.desc("support_count"), F.desc("confidence"), F.col("relation_id")]
    return top.select("relation_id", "score", F.row_number().over(Window.orderBy(*order)).alias("rank"))


def _kept_best(found: np.ndarray, ids: np.ndarray, n: np.ndarray, score: np.ndarray, vec: np.ndarray) -> np.ndarray:
    """Puts the scores of a batch (queries x ids) among the best of each query (score, vec; n of them) and returns the new n.

    Best first, ties by id; what is no number is last.
    """
    k = score.shape[1]
    value = np.where(np.isnan(found), -np.inf, found)
    # What is below a batch's own k-th score, or that of the best so far, can't come in.
    least = np.partition(value, -k, axis=1)[:, -k] if value.shape[1] > k else np.full(len(value), -np.inf)
    full = n == k
    least[full] = np.maximum(least[full], np.where(np.isnan(score[full, -1]), -np.inf, score[full, -1]))
    new, col = np.nonzero(value >= least[:, None])
    old, place = np.nonzero(np.arange(k) < n[:, None])
    row, s, v = np.concatenate([old, new]), np.concatenate([score[old, place], found[new, col]]), np.concatenate([vec[old, place], ids[col]])
    order = np.lexsort((v, -s, row))
    row, s, v = row[order], s[order], v[order]
    many = np.bincount(row, minlength=len(n))
    rank = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    kept = rank < k
    score[row[kept], rank[kept]], vec[row[kept], rank[kept]] = s[kept], v[kept]
    return np.minimum(many, k)


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int, precision: int = 6) -> DataFrame:
    """query_id, vec_id, score: the k nearest of each query by cosine, ties by id.

    Query vectors go to every task after a check of their size; each batch is multiplied with blocks of them, so a task holds
    the queries, their k best and BLOCK_SCORES scores, however many vectors there are.  A task passes on its own k best of
    each query, so the shuffle carries tasks x queries x k rows, not the vectors.
    """
    spark = vectors.sparkSession
    size = queries.agg(F.coalesce(F.sum(F.size("embedding") * 8), F.lit(0))).first()[0]
    if size > QUERY_BYTES:
        parts = int(-(-size // QUERY_BYTES))
        split = [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i) for i in range(parts)]
        out = vector_topk(vectors, split[0], k, precision)
        for part in split[1:]:
            out = out.unionByName(vector_topk(vectors, part, k, precision))
        return out
    rows = queries.where("embedding is not null").select("query_id", F.col("embedding").cast("array<double>").alias("embedding")).orderBy("query_id").toArrow()
    ids = rows.column("query_id").to_numpy()
    want = rows.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1) if len(ids) else np.zeros((0, 0))
    shared = spark.sparkContext.broadcast((ids, want / np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-300)))

    def run(batches):
        ids, unit = shared.value
        if not len(ids):
            return
        # The best so far: row k holds n[k] places of query k, best first.
        n, score, vec = np.zeros(len(ids), np.int64), np.empty((len(ids), k)), np.empty((len(ids), k), np.int64)
        for batch in batches:
            if not len(batch):
                continue
            own = batch["vec_id"].to_numpy()
            x = np.stack(batch["embedding"].to_numpy()).astype(np.float64)
            x = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)).T
            step = max(1, BLOCK_SCORES // len(own))
            for lo in range(0, len(ids), step):
                at = slice(lo, lo + step)
                n[at] = _kept_best((unit[at] @ x).round(precision), own, n[at], score[at], vec[at])
        for lo in range(0, len(ids), 10_000):
            full = np.arange(k) < n[lo : lo + 10_000, None]
            yield pd.DataFrame({"query_id": np.repeat(ids[lo : lo + 10_000], n[lo : lo + 10_000]), "vec_id": vec[lo : lo + 10_000][full], "score": score[lo : lo + 10_000][full]})

    near = vectors.where("embedding is not null").select("vec_id", "embedding").mapInPandas(run, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", place).where(F.col("rank") <= k)


def best_of_queries(hits: DataFrame, k: int) -> DataFrame:
    """vec_id, score, query_id: the best score of each vector over all query variants, k rows."""
    best = hits.groupBy("vec_id").agg(F.max("score").alias("score"), F.max_by("query_id", F.struct("score", -F.col("query_id"))).alias("query_id"))
    return best.orderBy(F.desc("score"), "vec_id").limit(k)


def fused(hits: DataFrame, graph_ids: DataFrame, precision: int = 6) -> DataFrame:
    """hits (vec_id, score, evidence_level) with in_graph and merged_score: a bonus for being in the graph, a weight for evidence."""
    inside = graph_ids.select("vec_id").distinct().withColumn("in_graph", F.lit(True))
    joined = hits.join(inside, "vec_id", "left").withColumn("in_graph", F.coalesce("in_graph", F.lit(False)))
    bonus = F.when(F.col("in_graph"), IN_GRAPH).otherwise(0.0)
    return joined.withColumn("merged_score", F.round(F.col("score") + bonus + weight(F.col("evidence_level"), FUSION), precision))


def assembled(evidence: DataFrame, hits: DataFrame, graph_only: DataFrame, k: int) -> DataFrame:
    """citation, chunk_id, retrieval: evidence first, then hits, then the rest of the graph, each chunk once, k rows.

    Each input has chunk_id, pos; hits have in_graph too.
    """
    parts = [
        evidence.select("chunk_id", F.lit(0).alias("branch"), "pos", F.lit("graph-evidence").alias("retrieval")),
        hits.select("chunk_id", F.lit(1).alias("branch"), "pos", F.when(F.col("in_graph"), "graph+vector").otherwise("vector").alias("retrieval")),
        graph_only.select("chunk_id", F.lit(2).alias("branch"), "pos", F.lit("graph").alias("retrieval")),
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    first = every.groupBy("chunk_id").agg(F.min(F.struct("branch", "pos", "retrieval")).alias("f"))
    top = first.orderBy("f.branch", "f.pos", "chunk_id").limit(k)
    place = F.row_number().over(Window.orderBy("f.branch", "f.pos", "chunk_id"))
    return top.select(F.concat(F.lit("C"), place.cast("string")).alias("citation"), "chunk_id", F.col("f.retrieval").alias("retrieval"))


def chunk_score(text: Column, words: Column, level: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    hit = lambda w: F.when(~F.contains(low, F.lower(w)), 0.0).when(F.lower(w).isin(*GENERIC), 3.0).otherwise(30.0)
    return F.aggregate(words, F.lit(0.0), lambda acc, w: acc + hit(w)) + weight(level, RANKING)


def _spans(low: str, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, number of the word) of each place of each word, in order of start and end; places of one word don't overlap."""
    found = [(m.start(), m.end(), k) for k, w in enumerate(words) for m in re.finditer(re.escape(w), low)]
    start, end, word = (np.array([x[j] for x in sorted(found)], np.int64) for j in range(3))
    return start, end, word


def best_start(length: int, size: int, spans: tuple[np.ndarray, np.ndarray, np.ndarray]) -> int:
    """Where the window begins that touches most different words, then most places, then most of their characters, then begins
    with the earliest place; the first such window.

    Windows may begin where a place is a third of the size behind their start, or two thirds before their end, and at both ends
    of the text.  Windows are passed over in order of start: places that a window touches are those up to the last that
    starts in it, less those that end before it, so two pointers and running sums serve all windows.
    """
    start, end, word = spans
    if length <= size or not len(start):
        return 0
    last = length - size
    at = np.unique(np.clip(np.concatenate([[0, last], start - size // 3, end - size * 2 // 3]), 0, last))
    rising = np.sort(end)
    begun, over = np.searchsorted(start, at + size), np.searchsorted(rising, at, "right")
    many = begun - over
    # Characters inside: whole places that touch the window, less what stands out at either side.
    behind, before = np.concatenate([[0], np.cumsum(end - start)]), np.concatenate([[0], np.cumsum((end - start)[np.argsort(end, kind="stable")])])
    inside = behind[begun] - before[over]
    longest = int((end - start).max())
    # Only places that begin shortly before an edge stand out over it.
    for edge, side in ((at, -1), (at + size, 1)):
        lo, hi = np.searchsorted(start, edge - longest), np.searchsorted(start, edge)
        n = hi - lo
        k = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        of = np.repeat(np.arange(len(at)), n)
        out = np.where(side < 0, edge[of] - start[k], end[k] - edge[of]) * (end[k] > edge[of])
        inside = inside - np.bincount(of, out, len(at)).astype(np.int64)
    distinct, counts = np.zeros(len(at), np.int64), np.zeros(int(word.max()) + 1, np.int64)
    by_end = np.argsort(end, kind="stable")
    lo = hi = kinds = 0
    for k in range(len(at)):
        while hi < begun[k]:
            kinds += counts[word[hi]] == 0
            counts[word[hi]] += 1
            hi += 1
        while lo < over[k]:
            counts[word[by_end[lo]]] -= 1
            kinds -= counts[word[by_end[lo]]] == 0
            lo += 1
        distinct[k] = kinds
    # The earliest place that a window touches is the first that ends behind its start.
    ahead = np.minimum.accumulate(start[by_end][::-1])[::-1]
    first = np.append(ahead, length)[over]
    best = np.lexsort((at, first, -inside, -many, -distinct))
    best = best[many[best] > 0]
    return int(at[best[0]]) if len(best) else 0


def window(text: str, words: list[str], size: int = 600) -> str:
    """The part of a text, its white space collapsed, that shows most of the words, with dots where it is cut."""
    text = " ".join((text or "").split())
    if size <= 0 or len(text) <= size:
        return text if size > 0 else ""
    low = text.lower()
    listed = list(dict.fromkeys(w for x in words if (w := (x or "").strip().lower())))
    at = best_start(len(text), size, _spans(low, listed)) if listed else 0
    return ("..." if at else "") + text[at : at + size] + ("..." if at + size < len(text) else "")


def windows(rows: DataFrame, size: int = 600) -> DataFrame:
    """rows (id, text, words) with the best window of each text; null without a text is an empty one."""

    @F.pandas_udf("string")
    def best(texts: pd.Series, words: pd.Series) -> pd.Series:
        return pd.Series([window(t, [] if w is None else list(w), size) for t, w in zip(texts, words, strict=True)])

    return rows.withColumn("window", best("text", "words"))


def prompts(questions: DataFrame, contexts: DataFrame, relations: DataFrame, most: int = 20) -> DataFrame:
    """query_id, prompt: a question with all its numbered contexts (C1, C2, ...) and its best relations (G1, G2, ...)."""

    def block(rows: DataFrame, letter: str, line: Column) -> DataFrame:
        cited = rows.select("query_id", F.struct("rank", F.concat(F.lit(f"[{letter}"), "rank", F.lit("] "), line).alias("line")).alias("x"))
        lines = F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"])
        return cited.groupBy("query_id").agg(F.array_join(lines, "\n").alias(f"block_{letter}"))

    text = F.coalesce("text", F.lit(""))
    relation = F.concat_ws(" ", "src_name", F.lower("relation_type"), "dst_name")
    joined = questions.join(block(contexts, "C", text), "query_id", "left").join(block(relations.where(F.col("rank") <= most), "G", relation), "query_id", "left")
    parts = F.concat_ws("\n\n", F.concat(F.lit("Question: "), "query"), F.concat(F.lit("Texts:\n"), "block_C"), F.concat(F.lit("Relations:\n"), "block_G"))
    return joined.select("query_id", parts.alias("prompt"))


def fallback(n_contexts: Column, n_relations: Column) -> Column:
    """What is said when no model answers: where the evidence stands."""
    texts = F.when(n_contexts > 0, F.concat(F.lit("See "), F.array_join(F.transform(F.sequence(F.lit(1), n_contexts), lambda i: F.concat(F.lit("[C"), i, F.lit("]"))), ", ")))
    graph = F.when(n_relations > 0, F.concat(F.lit("and relations "), F.array_join(F.transform(F.sequence(F.lit(1), n_relations), lambda i: F.concat(F.lit("[G"), i, F.lit("]"))), ", ")))
    return F.coalesce(F.nullif(F.concat_ws(" ", texts, graph), F.lit("")), F.lit("No evidence was found."))


# Characters of a joined variant, keywords beside a query, variants.
VARIANT_CHARS, VARIANT_WORDS, VARIANTS = 220, 8, 3


def query_variants(rows: DataFrame) -> DataFrame:
    """rows (query, keywords) with variants: the query, its specific keywords, and both; equal ones once, blank ones not at all."""
    squeeze = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    specific = F.filter(F.coalesce("keywords", F.array().cast("array<string>")), lambda w: (w != "") & ~F.lower(w).isin(*GENERIC))
    joined = lambda parts: F.left(squeeze(F.array_join(parts, " ")), F.lit(VARIANT_CHARS))
    query = F.coalesce("query", F.lit(""))
    more = F.array(joined("specific"), joined(F.concat(F.array(query), F.slice("specific", 1, VARIANT_WORDS))))
    rows = rows.withColumn("specific", specific).withColumn("all", F.concat(F.array(query), F.when(F.size("specific") > 0, more).otherwise(F.array().cast("array<string>"))))
    keys = F.transform("all", lambda x: F.lower(squeeze(x)))
    rows = rows.withColumn("keys", keys)
    first = F.filter("all", lambda x, i: (F.get("keys", i) != "") & (F.array_position("keys", F.get("keys", i)) == i + 1))
    return rows.withColumn("variants", F.slice(first, 1, VARIANTS)).drop("specific", "all", "keys")


def governance_candidates(matches: DataFrame, keep: int = 100) -> DataFrame:
    """entity_id, query_count, query_ids of matches (query_id, entity_id): the entities that most queries ran into, `keep` of them."""
    found = matches.groupBy("entity_id").agg(F.array_sort(F.collect_set("query_id")).alias("query_ids"))
    return found.select("entity_id", F.size("query_ids").cast("long").alias("query_count"), "query_ids").orderBy(F.desc("query_count"), "entity_id").limit(keep)


def page(rows: DataFrame, order: list, number: int = 1, size: int = 20) -> DataFrame:
    """rows of one page in a total order, each with the total number of rows."""
    total = rows.agg(F.count("*")).scalar()
    return rows.orderBy(*order).offset((number - 1) * size).limit(size).withColumn("total", total)
