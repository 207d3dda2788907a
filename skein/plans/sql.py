"""DuckDB SQL for the queries of the catalog, by the same names and columns."""

from __future__ import annotations

from skein.operators.evaluation import ROUTES
from skein.operators.retrieval import ANCHOR, ASKING, CONVERSATION, GENERIC, HINT_RULES, LONGEST_RUN, NARROW, STOPWORDS, WIDE
from skein.operators.runs import ALLOWED, MARKS, TYPES
from skein.operators.search import PLANS
from skein.plans.views import GROUPS, QUESTIONS, SEARCH_WORDS

_CJK = r"[\x{4e00}-\x{9fff}]"


def _n(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


_TOKENS = rf"greatest(1, floor({_n('t', _CJK)} * 1.0::DOUBLE + {_n('t', '[A-Za-z0-9]+')} * 0.6::DOUBLE + {_n('t', '[^\\p{L}\\p{N}\\p{M}_\\s]')} * 0.2::DOUBLE)::BIGINT)"
_DOC = "doc AS (SELECT doc_id, coalesce(text, '') AS t, source, text AS raw FROM documents)"
_LINES = r"""lined AS (SELECT *, list_filter(list_transform(string_split_regex(t, '\r\n|\r|\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS lines FROM doc)"""
_OCR = r"""(length(x) >= 24 AND len(list_filter(string_split_regex(x, '\s+'), lambda y: y <> '')) >= 6 AND (
    len(regexp_extract_all(x, '[`~^_|\\¤§¥£©®™′]')) >= 3 OR (
        len(list_filter(string_split_regex(x, '\s+'), lambda y: y <> '' AND length(y) <= 2))::DOUBLE / len(list_filter(string_split_regex(x, '\s+'), lambda y: y <> '')) > 0.65
        AND len(regexp_extract_all(x, '[`~^_|\\¤§¥£©®™′]')) >= 1 AND len(regexp_extract_all(x, '[\x{4e00}-\x{9fff}]')) < 160)))"""
_NOISE = r"""(lower(x) LIKE '%document generated by anna%' OR lower(x) LIKE '%annas-blog.org%' OR regexp_full_match(x, '[^\p{L}\p{N}\p{M}]+')
    OR regexp_full_match(x, '\d{1,4}') OR regexp_full_match(x, '第\s*\d+\s*页') OR (length(x) <= 1 AND x NOT IN ('。', '.')))"""

# The supplied documents have no CJK characters, so the CJK measures are zero here; tests cover them.
_MEASURED = rf"""{_DOC}, {_LINES},
m AS (SELECT *, length(t)::BIGINT AS chars, len(lines)::BIGINT AS n_lines, len(list_distinct(lines))::DOUBLE / greatest(len(lines), 1) AS uniq,
    {_n('t', '[�□■◆▲▼※¤§]')}::DOUBLE / greatest(length(t), 1) AS weird, {_n('t', r'\[PAGE\s+\d+\]')} AS marks,
    len(list_filter(lines, lambda x: {_OCR}))::DOUBLE / greatest(len(lines), 1) AS noisy FROM lined)"""
_GRADED = f"""{_MEASURED},
f AS (SELECT *, list_sort(list_filter([
    CASE WHEN uniq < 0.22 AND n_lines > 120 THEN 'dup_lines_high' END, CASE WHEN chars < 80 THEN 'low_cpp' END,
    CASE WHEN lower(t) LIKE '%document generated by anna%' THEN 'metadata_left' END, CASE WHEN marks = 0 THEN 'no_page_marker' END,
    CASE WHEN noisy > 0.10 AND noisy <= 0.20 THEN 'noisy_lines_mild' END, CASE WHEN noisy > 0.20 THEN 'noisy_lines_severe' END,
    CASE WHEN chars < 800 THEN 'too_short' END, CASE WHEN weird > 0.01 THEN 'weird_chars_high' END], lambda x: x IS NOT NULL)) AS risk FROM m),
g AS (SELECT *, CASE WHEN list_has_any(risk, ['metadata_left', 'too_short']) THEN 'F' WHEN list_has_any(risk, ['weird_chars_high', 'low_cpp', 'noisy_lines_severe']) THEN 'D'
    WHEN list_has_any(risk, ['dup_lines_high', 'noisy_lines_mild']) THEN 'C' WHEN chars >= 300 AND uniq >= 0.45 THEN 'A' ELSE 'B' END AS grade FROM f)"""
_SIGNATURE = r"sha1(regexp_replace(lower(t), '\s|　', '', 'g'))"
_KEY = r"trim(regexp_replace(regexp_replace(lower({}), '\s+', ' ', 'g'), '[^\p{{L}}\p{{N}}\p{{M}}_\s()/\-]', '', 'g'))"

_ENTITIES = """entities AS (
    SELECT 'part_' || p_partkey AS entity_id, p_name AS name, 'AssessmentTool' AS type, string_split(lower(p_type), ' ') AS synonyms, coalesce(n, 0)::BIGINT AS source_chunk_count
    FROM part LEFT JOIN (SELECT l_partkey AS k, count(*) AS n FROM lineitem GROUP BY 1) ON k = p_partkey
    UNION ALL SELECT 'supp_' || s_suppkey, s_name, 'Intervention', []::VARCHAR[], coalesce(n, 0) FROM supplier LEFT JOIN (SELECT l_suppkey AS k, count(*) AS n FROM lineitem GROUP BY 1) ON k = s_suppkey
    UNION ALL SELECT 'cust_' || c_custkey, c_name, 'Condition', [lower(c_mktsegment)], coalesce(n, 0) FROM customer LEFT JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) ON k = c_custkey
    UNION ALL SELECT 'nat_' || n_nationkey, n_name, 'AgeStage', []::VARCHAR[], coalesce(n, 0) FROM nation LEFT JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) ON k = n_nationkey)"""
_RELATIONS = """raw_relations AS (
    SELECT 'cust_' || o_custkey AS src_id, 'MEASURED_BY' AS relation_type, 'part_' || l_partkey AS dst_id, count(DISTINCT l_orderkey)::BIGINT AS support_count,
        sum((1 - l_discount)::DECIMAL(10, 4))::DOUBLE / count(*) AS confidence FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3
    UNION ALL SELECT 'supp_' || l_suppkey, 'INDICATED_FOR', 'part_' || l_partkey, count(DISTINCT l_orderkey), sum((1 - l_discount)::DECIMAL(10, 4))::DOUBLE / count(*) FROM lineitem GROUP BY 1, 2, 3
    UNION ALL SELECT 'supp_' || s_suppkey, 'SUITABLE_AGE', 'nat_' || s_nationkey, 1, 0.4::DOUBLE FROM supplier),
relations AS (SELECT *, 'rel_' || substr(sha1(src_id || '|' || relation_type || '|' || dst_id), 1, 12) AS relation_id FROM raw_relations)"""
_EVIDENCE = """evidence AS (SELECT 'ev_' || o_orderkey AS evidence_id, 'c_' || o_custkey AS chunk_id,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'S' WHEN o_orderpriority = '2-HIGH' THEN 'A' WHEN o_orderpriority = '3-MEDIUM' THEN 'B' WHEN o_orderpriority LIKE '4%' THEN 'C' ELSE 'D' END AS evidence_level FROM orders)"""
_SUPPORTS = """supports AS (SELECT DISTINCT 'rel_' || substr(sha1('cust_' || o_custkey || '|MEASURED_BY|part_' || l_partkey), 1, 12) AS relation_id, 'ev_' || l_orderkey AS evidence_id
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_ENDS = "ends AS (SELECT src_id AS entity_id, dst_id AS other_id, relation_id FROM relations UNION ALL SELECT dst_id, src_id, relation_id FROM relations)"
_GRAPH = f"{_ENTITIES}, {_RELATIONS}, {_ENDS}"
_DEGREES = "degrees AS (SELECT e.entity_id, count(x.entity_id)::BIGINT AS degree FROM entities e LEFT JOIN ends x ON e.entity_id = x.entity_id GROUP BY 1)"
_HAS = "({})".format
_DIGITAL = "machine learning|deep learning|artificial intelligence|computer vision|neural network|random forest|support vector|svm"
_CLINICAL = "ados|adi|chat|cars|abc|atec|srs|scq|aq|cast|stat|dsm"
_RESEARCH = "eeg|erp|mri|fnirs|meg|pet|eye-tracking"
_TOOL = f"""CASE WHEN regexp_matches(w, '{_DIGITAL}') THEN 'digital_algorithm' WHEN regexp_matches(w, '{_CLINICAL}') THEN 'clinical_assessment'
    WHEN regexp_matches(w, '{_RESEARCH}') THEN 'research_modality' WHEN regexp_matches(w, 'technology|technique|method|approach') THEN 'generic_method' ELSE 'unspecified_assessment' END"""
_TOOLED = f"tooled AS (SELECT *, {_TOOL} AS tool FROM (SELECT *, lower(concat_ws(' ', name, nullif(array_to_string(synonyms, ' '), ''))) AS w FROM entities))"
_ALIASES = rf"""aliases AS (SELECT DISTINCT entity_id, type, alias FROM (SELECT entity_id, type, {_KEY.format('a')} AS alias FROM (
    SELECT entity_id, type, unnest(list_concat([name], synonyms)) AS a FROM entities)) WHERE alias <> '')"""
_FLAGGED = f"""flagged AS (SELECT r.*, s.type AS src_type, d.type AS dst_type, r.relation_type IN ('INDICATED_FOR', 'NOT_INDICATED_FOR', 'HAS_RISK') AS guarded,
    coalesce(r.relation_type = 'MEASURED_BY' AND d.type = 'AssessmentTool' AND d.tool IN ('research_modality', 'digital_algorithm', 'generic_method'), false) AS limited, d.tool AS tool
    FROM relations r LEFT JOIN tooled s ON r.src_id = s.entity_id LEFT JOIN tooled d ON r.dst_id = d.entity_id),
used AS (SELECT *, CASE WHEN guarded THEN 'guardrailed_clinical_context' WHEN limited THEN 'research_context_only' WHEN confidence < 0.5 OR support_count <= 1 THEN 'use_with_caution' ELSE 'standard' END AS qa_usage,
    array_to_string(list_sort(list_filter([CASE WHEN guarded THEN 'clinical_answer_requires_evidence_guardrail' END, CASE WHEN confidence < 0.5 THEN 'low_confidence' END,
        CASE WHEN limited THEN 'measurement_tool_category:' || tool END, CASE WHEN src_id = dst_id THEN 'self_relation' END, CASE WHEN support_count <= 1 THEN 'single_evidence_relation' END], lambda x: x IS NOT NULL)), '|') AS flags FROM flagged)"""


def _marked(column: str, marks: str) -> str:
    """Whether a column has any of the marks; the supplied texts have none of the CJK ones."""
    return "(" + " OR ".join(f"contains({column}, '{m}')" for m in MARKS[marks] if m.isascii()) + ")"


_PICK = "list_extract({}, ({} % len({}) + 1)::INT)"
_TOLD = ["autism", "ADOS scale", "fMRI", "imaging method", "deep learning", "stroop task", "preschool children", "ABA training", "plain words", "anxiety"]
_KINDS = ["Condition", "Symptom", "AssessmentTool", "Intervention", "Mechanism", "AgeStage", "Nonsense", "Task", "Claim"]
_SAID = [
    "We found that autism was screened with the ADOS scale in preschool children.", "short", "An overview of fMRI and deep learning in autism, stroop task.", "The accuracy of fMRI for autism, measured by AUC.",
    "anxiety and plain words were measured with the ADOS scale, stroop task.", "The ADOS scale exists; no more", "ABA training helps preschool children, anxiety and autism.", "long text without any mark of a sentence", "ABA training, preschool children",
]
_RELATED_BY = ["MEASURED_BY", "INDICATED_FOR", "SUITABLE_AGE", "COMORBID_WITH", "RELATES_TO"]
_IS_TOOL = f"({_marked('name', 'tool')} AND NOT {_marked('name', 'algorithm')})"
_EXTRACTED = f"""said AS (SELECT p_partkey AS entity_id, lower({_PICK.format(_TOLD, 'p_partkey', _TOLD)}) AS synonym, lower({_PICK.format(_TOLD, 'p_partkey', _TOLD)} || CASE WHEN p_partkey % 3 = 0 THEN ' ' || p_name ELSE '' END) AS name,
        {_PICK.format(_KINDS, '(p_partkey + p_partkey // 9)', _KINDS)} AS kind FROM part),
    told AS (SELECT *, CASE WHEN kind = 'AssessmentTool' AND {_marked('name', 'algorithm')} THEN 'Mechanism' WHEN {_marked('name', 'task')} AND NOT {_IS_TOOL} AND kind <> 'Intervention' THEN 'Task'
        WHEN kind = 'AssessmentTool' OR {_IS_TOOL} THEN 'AssessmentTool' WHEN {_marked('name', 'condition')} THEN 'Condition' WHEN {_marked('name', 'test')} AND kind <> 'Intervention' THEN 'Task' ELSE kind END AS type FROM said),
    typed AS (SELECT *, CASE WHEN type NOT IN {TYPES} THEN 'invalid_entity_type' WHEN type = 'AssessmentTool' AND {_marked('name', 'generic')} AND NOT {_marked('name', 'specific')} THEN 'generic_assessment_tool' END AS reject_reason FROM told)"""
_LEGAL = " OR ".join(f"(relation_type = '{r}' AND st IN ({str(list(a))[1:-1]}) AND dt IN ({str(list(b))[1:-1]}))" for r, (a, b) in ALLOWED.items())
_MODAL = f"({_marked('dn', 'modality')} AND NOT {_marked('dn', 'screening')})"
_RELATED = f"""relations AS (SELECT l_partkey AS src_id, {_PICK.format(_RELATED_BY, '(l_orderkey // 3 + l_linenumber)', _RELATED_BY)} AS relation_type, l_suppkey * 7 + l_linenumber AS dst_id, lower({_PICK.format(_SAID, 'l_orderkey', _SAID)}) AS low FROM lineitem),
    joined AS (SELECT r.*, s.type AS st, d.type AS dt, d.name AS dn, contains(low, s.name) OR contains(low, s.synonym) AS has_src, contains(low, d.name) OR contains(low, d.synonym) AS has_dst
        FROM relations r LEFT JOIN typed s ON r.src_id = s.entity_id AND s.reject_reason IS NULL LEFT JOIN typed d ON r.dst_id = d.entity_id AND d.reject_reason IS NULL),
    judged AS (SELECT src_id, relation_type, CASE WHEN relation_type NOT IN {tuple(ALLOWED)} THEN 'invalid_relation_type' WHEN st IS NULL OR dt IS NULL THEN 'orphan_relation' WHEN NOT ({_LEGAL}) THEN 'illegal_relation_pair'
        WHEN (length(low) <= 18 OR NOT regexp_matches(low, '[!?;:,.]')) AND NOT (relation_type = 'MEASURED_BY' AND st = 'Condition' AND length(low) >= 20 AND has_dst AND {_marked('low', 'context')} AND (NOT {_MODAL} OR {_marked('low', 'performance')})) THEN 'weak_evidence_text'
        WHEN relation_type = 'MEASURED_BY' THEN CASE WHEN {_marked('low', 'summary')} THEN 'summary_style_measurement' WHEN {_marked('dn', 'algorithm')} THEN 'algorithmic_tool_not_assessment' WHEN NOT has_dst THEN 'tool_not_mentioned'
            WHEN st <> 'Condition' AND NOT has_src THEN 'source_not_mentioned' WHEN st = 'Condition' AND NOT {_marked('low', 'measure')} AND NOT {_marked('low', 'context')} THEN 'condition_measure_without_trigger'
            WHEN st = 'Condition' AND {_MODAL} AND NOT {_marked('low', 'performance')} THEN 'research_modality_without_clinical_signal' WHEN st <> 'Condition' AND NOT {_marked('low', 'study')} THEN 'measurement_without_study_trigger' END
        WHEN relation_type = 'SUITABLE_AGE' THEN CASE WHEN NOT has_dst THEN 'age_not_mentioned' WHEN NOT {_marked('low', 'age')} THEN 'weak_age_evidence' END END AS reject_reason FROM joined)"""
_RUNS = "runs AS (SELECT user_id AS chunk, event_id AS seq, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status, event_type FROM events)"
_MERGED = f"""{_RUNS}, picked AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY (status = 'ok')::INT DESC, seq DESC) AS place, min(seq) OVER (PARTITION BY chunk) AS first_seq,
    count(*) OVER (PARTITION BY chunk) AS n_records FROM runs)"""
_MERGE = rf"""keyed AS (SELECT *, ceil(source_chunk_count / 4.0) AS docs, CASE WHEN type IN ('AssessmentTool', 'Intervention') THEN {_KEY.format('name')} ELSE entity_id END AS key FROM entities),
placed AS (SELECT *, row_number() OVER (PARTITION BY type, key ORDER BY source_chunk_count DESC, docs DESC, length(name), entity_id) AS place FROM keyed),
heads AS (SELECT type, key, entity_id AS primary_id, name FROM placed WHERE place = 1)"""
_WORDS = "words(query_id, keyword) AS (VALUES (1, 'blue'), (1, 'green'), (1, 'steel'), (1, 'customer#0000001'), (2, 'ASD'), (2, 'red'))"
_NAMES = r"named AS (SELECT *, list_transform(list_concat([name], synonyms), lambda x: lower(trim(regexp_replace(x, '\s+', ' ', 'g')))) AS names FROM entities)"
_MATCHED = f"""{_ENTITIES}, {_WORDS}, {_NAMES},
matched AS (SELECT * FROM (SELECT query_id, keyword, entity_id, list_contains(names, lower(keyword)) AS exact, row_number() OVER (PARTITION BY query_id, keyword ORDER BY entity_id) AS place
    FROM named JOIN words ON len(list_filter(names, lambda x: contains(x, lower(keyword)))) > 0) WHERE place <= 80)"""
_SCORES = """scores AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[])
        / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]))), 6) AS score, e.label
    FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 AND e.embedding IS NOT NULL),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores)"""


def _best(per: int, keep: int) -> str:
    return f"""best AS (SELECT vec_id, score, query_id, label FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, query_id) AS p FROM near WHERE rank <= {per})
    WHERE p = 1 ORDER BY score DESC, vec_id LIMIT {keep})"""


_FUSED = f"""{_SCORES}, {_best(40, 40)}, fused AS (SELECT vec_id, score, vec_id % 3 = 0 AS in_graph, evidence_level, round(score + CASE WHEN vec_id % 3 = 0 THEN 0.15 ELSE 0 END
    + CASE evidence_level WHEN 'S' THEN 0.1 WHEN 'A' THEN 0.05 WHEN 'B' THEN 0 WHEN 'C' THEN -0.02 ELSE -0.05 END, 6) AS merged_score
    FROM (SELECT *, substr('SABCD', label % 5 + 1, 1) AS evidence_level FROM best))"""
_OPEN = " OR ".join(
    f"len(list_filter(range(1, length(answer) + 1), lambda i: substr(answer, i, {len(p)}) = '{p}' AND NOT contains(substr(answer, greatest(i - 24, 1), least(i - 1, 24) + {len(p) + 12}), 'in') AND NOT contains(substr(answer, greatest(i - 24, 1), least(i - 1, 24) + {len(p) + 12}), 'de '))) > 0"
    for p in ("the", "un")
)
_CHECKED = r"""c AS (SELECT conv_id, turn, role AS category, CASE WHEN turn % 3 = 0 THEN text || ' [C1]' ELSE text END AS answer, text AS context, turn % 2 = 0 AS needs_guardrail,
    conv_id % 4 = 0 AS dry_run, turn + conv_id % 2 AS n_contexts, conv_id % 3 AS n_graph FROM conversations),
checked AS (SELECT *, dry_run OR trim(coalesce(answer, '')) <> '' AS answer_present, n_contexts > 0 AS retrieved_context, n_graph > 0 AS retrieved_graph,
    contains(lower(coalesce(context, '')), 'the') OR contains(lower(coalesce(context, '')), 'und') AS expected_term_seen, dry_run OR regexp_matches(coalesce(answer, ''), '\[(C|G)\d+\]') AS answer_cited,
    NOT (NOT dry_run AND needs_guardrail) OR contains(lower(coalesce(answer, '')), 'of') OR contains(lower(coalesce(answer, '')), 'le') AS guardrail_ok, coalesce(NOT ({open}), true) AS no_clinical_overstatement FROM c),
judged AS (SELECT *, answer_present AND retrieved_context AND retrieved_graph AND expected_term_seen AND answer_cited AND guardrail_ok AND no_clinical_overstatement AS ok FROM checked)""".replace("{open}", _OPEN)
_TIMED = """timed AS (SELECT l_linestatus AS model, l_returnflag AS profile, CASE WHEN l_linenumber % 2 = 0 THEN 'agent' ELSE 'standard' END AS pipeline,
    CASE WHEN l_discount > 0.09 THEN 'degraded' ELSE 'done' END AS status, l_tax < 0.07 AS passed, l_quantity AS seconds FROM lineitem),
latencies AS (SELECT model, profile, pipeline, count(*)::BIGINT AS runs, count(*) FILTER (WHERE status = 'done') AS successes, count(*) FILTER (WHERE status = 'degraded') AS degraded,
    count(*) FILTER (WHERE passed) AS passes, median(seconds) AS p50, list_sort(list(seconds))[greatest(ceil(count(seconds) * 0.95)::BIGINT, 1)] AS p95 FROM timed GROUP BY ALL)"""
_INSPECTED = """routed AS (SELECT doc_id, ['safety_boundary', 'diagnostic_boundary', 'intervention_advice', 'risk_info', 'assessment_info', 'knowledge_qa', 'unknown'][doc_id % 7 + 1] AS route,
    n_chars % 5 AS n_contexts, n_chars % 3 AS n_relations, n_chars % 2 AS n_entities, doc_id % 4 > 0 AS has_low, doc_id % 3 > 0 AS has_research FROM documents)"""
_CATALOG = r"""titled AS (SELECT doc_id, t, source, source || '/' || substr(regexp_replace(t, '[\n/.]', ' ', 'g'), 1, 60) || '.pdf' AS path,
    regexp_replace(regexp_replace(substr(regexp_replace(t, '[\n/.]', ' ', 'g'), 1, 60), '\s+', ' ', 'g'), '^[ _-]+|[ _-]+$', '', 'g') AS title FROM doc),
typed AS (SELECT *, lower(source || ' ' || title) AS w FROM titled),
kinds AS (SELECT *, CASE WHEN regexp_matches(w, 'guideline|practice parameter|recommendation|statement') THEN 'guideline_or_consensus' WHEN regexp_matches(w, 'meta-analysis|meta analysis|systematic review') THEN 'systematic_review_or_meta'
    WHEN contains(w, 'review') THEN 'narrative_review' WHEN regexp_matches(w, 'randomized|trial|rct') THEN 'trial' WHEN contains(w, 'protocol') THEN 'protocol' WHEN contains(w, 'case report') THEN 'case_report' ELSE 'article' END AS source_type FROM typed)"""
_NOISY_CHUNK = r"""(contains(t, 'classification accuracy') OR len(regexp_extract_all(t, '[;；]')) > 12 OR len(regexp_extract_all(t, '\b[A-Z]{2,}[A-Z0-9\-]*\b')) > 40
    OR (len(regexp_extract_all(t, '\n')) > 35 AND len(regexp_extract_all(t, '[。.]')) < 8))"""
_SCORED = " + ".join(f"(length(t) - length(replace(t, '{w}', ''))) // {len(w)}" for w in ("EEG", "ERP", "fMRI", "MEG", "MRI", "PET", "SPECT", "ADOS", "ADI-R", "M-CHAT")) + " + " + " + ".join(
    f"2 * ((length(t) - length(replace(t, '{w}', ''))) // {len(w)})" for w in ("showed", "found", "using", "assessed", "measured")
)

# Cleaning: the supplied documents are one page each and have no CJK characters; tests cover those branches. Lines are joined by
# a fold over the text so far, of which the last paragraph counts.
_CLEAN = rf"""{_DOC},
read AS (SELECT doc_id, raw, t, list_filter(list_transform(string_split_regex(t, '\r\n|\r|\n'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '' AND NOT {_NOISE}) AS seen FROM doc),
kept AS (SELECT *, list_filter(seen, lambda x: NOT {_OCR}) AS lines FROM read),
often AS (SELECT doc_id, list(line) AS repeated FROM (SELECT doc_id, line FROM (SELECT doc_id, unnest(lines) AS line FROM kept) WHERE length(line) <= 60 GROUP BY 1, 2 HAVING count(*) >= 6) GROUP BY 1),
bare AS (SELECT k.*, coalesce(repeated, []) AS repeated, list_filter(lines, lambda x: NOT list_contains(coalesce(repeated, []), x)) AS body FROM kept k LEFT JOIN often USING (doc_id)),
page AS (SELECT *, CASE WHEN len(body) > 0 THEN '[PAGE 1]' || chr(10) || list_reduce(body, lambda done, x: done || CASE WHEN NOT contains('。！？.!?:：;；)]）】"”’' || chr(39), right(done, 1))
    AND length(split_part(done, chr(10), -1)) < 280 AND NOT regexp_matches(x, '^[\-•·\d]+[\).、．]?\s+') THEN ' ' ELSE chr(10) END || x) ELSE '' END AS joined FROM bare),
spaced AS (SELECT *, regexp_replace(joined, '\s+([,.;:!?])', '\1', 'g') AS tight FROM page),
runs AS (SELECT *, list_sort(list_distinct(list_transform(regexp_extract_all(tight, '(?:^|[^A-Za-z])[A-Za-z](?:\s+[A-Za-z]){{2,}}(?:[^A-Za-z]|$)'), lambda r: {{'n': -length(r), 'run': r}}))) AS runs FROM spaced),
tidy AS (SELECT *, list_reduce(list_prepend(tight, list_transform(runs, lambda r: r.run)), lambda done, r: replace(done, r, regexp_replace(left(r, -1), '([A-Za-z])\s+', '\1', 'g') || right(r, 1))) AS clean FROM runs),
done AS (SELECT doc_id, CASE WHEN trim(t) = '' THEN 'error' ELSE 'ok' END AS status, CASE WHEN trim(t) = '' THEN 'no_pages' END AS error, clean AS text,
    CASE WHEN regexp_matches(clean, '[A-Za-z]') THEN 'en' ELSE 'unknown' END AS language, CASE WHEN trim(t) = '' THEN 'no_pages' WHEN length(clean) < 800 THEN 'too_short' ELSE '' END AS flags,
    length(t)::BIGINT AS raw_chars, length(clean)::BIGINT AS clean_chars, CASE WHEN trim(t) = '' THEN 0 ELSE 1 END::BIGINT AS pages, len(repeated)::BIGINT AS repeated_lines,
    (len(seen) - len(lines))::BIGINT AS noisy_lines, false AS references_trimmed, CASE WHEN trim(t) = '' THEN [] ELSE [substr(joined, 10)] END AS page_texts, (length(tight) - length(clean))::BIGINT AS word_joins FROM tidy)"""

_COMPARED = f"""{_CHECKED}, half AS (SELECT conv_id, turn, turn // 2 AS pair, category, ok, retrieved_graph AS g, length(answer) AS n FROM judged),
pairs AS (SELECT a.conv_id, a.category, CASE WHEN NOT b.ok AND a.ok THEN 'agent_win' WHEN b.ok AND NOT a.ok THEN 'agent_regression' WHEN NOT b.g AND a.g THEN 'agent_win' WHEN b.g AND NOT a.g THEN 'agent_regression'
    WHEN a.n > b.n THEN 'agent_gain' WHEN a.n < b.n THEN 'agent_loss' ELSE 'tie' END AS delta, a.n - b.n AS gain, a.n % 3 = 0 AS follow_up,
    ['safety_boundary', 'diagnostic_boundary', 'intervention_advice', 'risk_info', 'assessment_info', 'knowledge_qa'][a.conv_id % 7 + 1] AS route
    FROM half b JOIN half a ON b.conv_id = a.conv_id AND b.pair = a.pair AND b.turn % 2 = 0 AND a.turn % 2 = 1)"""
_FLAGS = {
    "has_context_citations": "turn % 2 > 0", "has_graph_relations": "conv_id % 3 > 0", "has_expected_context_term": "expected_term_seen", "answer_has_citation": r"regexp_matches(answer, '\[[CG]\d+\]')",
    "answer_has_context_citation": r"regexp_matches(answer, '\[C\d+\]')", "answer_has_graph_citation": r"regexp_matches(answer, '\[G\d+\]')",
    "answer_has_guardrail": "contains(lower(answer), 'of') OR contains(lower(answer), 'le')", "answer_has_research_boundary": "contains(lower(answer), 'research')",
}
_NUMBERS = {"contexts_count": "turn + conv_id % 2", "relations_count": "conv_id % 3", "graph_entities_count": "turn % 2", "graph_evidence_contexts_count": "turn % 4"}
_METRICS = " UNION ALL ".join(
    [f"SELECT '{k}' AS metric, (count(*) FILTER (WHERE x))::BIGINT AS passed, count(x)::BIGINT AS total, round((count(*) FILTER (WHERE x))::DOUBLE / count(x), 4) AS rate, NULL::BIGINT AS least, NULL::BIGINT AS most, NULL::DOUBLE AS mean FROM (SELECT {v} AS x FROM said)" for k, v in _FLAGS.items()]
    + [f"SELECT '{k}', NULL, count(x)::BIGINT, NULL, min(x)::BIGINT, max(x)::BIGINT, round(sum(x)::DOUBLE / count(x), 2) FROM (SELECT {v} AS x FROM said)" for k, v in _NUMBERS.items()]
)
_NAMED = f"{_ENTITIES}, {_RELATIONS}, named AS (SELECT relation_id, s.name AS source, s.type AS source_type, relation_type, t.name AS target, t.type AS target_type, support_count FROM relations JOIN entities s ON s.entity_id = src_id JOIN entities t ON t.entity_id = dst_id)"

_SPACED = r"lower(trim(regexp_replace({}, '\s+', ' ', 'g')))"
_KEYED = rf"""{_ENTITIES}, listed(type, grp, alias) AS (VALUES ('AssessmentTool', 'bolts', 'blue bolt'), ('AssessmentTool', 'bolts', 'red bolt'), ('AssessmentTool', 'bolts', 'bolts'), ('AssessmentTool', 'gears', 'hot gear'),
    ('AssessmentTool', 'gears', 'gears'), ('Intervention', 'firm', 'supplier#000000001'), ('Intervention', 'firm', 'firm')),
said AS (SELECT entity_id, type, unnest(list_append(synonyms, name)) AS term FROM entities WHERE type IN ('AssessmentTool', 'Intervention', 'Condition')),
hit AS (SELECT entity_id, arg_min(grp, alias) AS grp FROM said JOIN listed ON said.type = listed.type AND {_SPACED.format("term")} = alias GROUP BY 1),
keyed AS (SELECT e.*, CASE WHEN type = 'AgeStage' THEN e.entity_id WHEN grp IS NOT NULL THEN 'curated:' || grp ELSE {_KEY.format("name")} END AS merge_key,
    CASE WHEN type <> 'AgeStage' THEN CASE WHEN grp IS NOT NULL THEN 'curated_alias_map' ELSE 'same_type_same_name' END END AS reason, (-source_chunk_count, -ceil(source_chunk_count / 4), length(name), e.entity_id) AS place
    FROM entities e LEFT JOIN hit ON hit.entity_id = e.entity_id)"""

_SPACED = r"lower(trim(regexp_replace({}, '\s+', ' ', 'g')))"
_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_ANY = lambda text, words: "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"

_ASKED = f"asked AS (SELECT conv_id * 1000 + turn AS query_id, turn, trim(concat_ws(' ', ({_LIST(QUESTIONS)})[(conv_id + turn) % {len(QUESTIONS)} + 1], text)) AS query FROM conversations)"
_ROUTED = f"""routes(place, route, words) AS (VALUES {', '.join(f"({k}, '{r}', {_LIST(w)})" for k, (r, w) in enumerate(ROUTES.items()))}),
hit AS (SELECT query_id, arg_min(route, place) AS route, arg_min(terms, place) AS terms FROM (SELECT query_id, place, route, list_filter(words, lambda w: contains(lower(query), w)) AS terms FROM asked, routes) WHERE len(terms) > 0 GROUP BY 1),
routed AS (SELECT a.query_id, coalesce(h.route, CASE WHEN query = '' THEN 'unknown' ELSE 'knowledge_qa' END) AS route, coalesce(h.terms, []) AS terms FROM asked a LEFT JOIN hit h ON a.query_id = h.query_id)"""
_HAN = r"[\x{4e00}-\x{9fff}]"
_KEYWORDS = f"""keyed AS (SELECT *, {_SPACED.format('query')} AS k FROM asked),
hinted AS (SELECT *, list_filter([{', '.join(f"CASE WHEN {_ANY('k', t)} THEN '{w}' END" for w, t in HINT_RULES)}], lambda x: x IS NOT NULL) AS h FROM keyed),
narrowed AS (SELECT *, CASE WHEN len(list_filter(h, lambda x: x <> '{WIDE}' AND (ends_with(x, '{WIDE}') OR x IN {NARROW}))) > 0 THEN list_filter(h, lambda x: x <> '{WIDE}') ELSE h END AS h1 FROM hinted),
spoken AS (SELECT *, CASE WHEN len(h1) > 0 AND NOT list_contains(h1, '{ANCHOR}') THEN ['{ANCHOR}'] || h1 ELSE h1 END || list_filter(regexp_extract_all(query, '[a-zA-Z][a-zA-Z0-9_-]*|{_HAN}{{2,}}'),
    lambda w: NOT (lower(w) IN {STOPWORDS} OR {_ANY('w', ASKING)} OR (regexp_full_match(w, '{_HAN}+') AND (length(w) > {LONGEST_RUN} OR {_ANY('w', CONVERSATION)})))) AS l FROM narrowed),
worded AS (SELECT query_id, turn, query, CASE WHEN len(l) = 0 THEN [query] ELSE list_filter(l, lambda x, i: list_position(l, x) = i) END AS keywords FROM spoken)"""


def _asked_again(template: str) -> str:
    return f"query || '{template.removeprefix('{}')}'" if template.startswith("{}") else f"'{template}'"


def _searched(p: str) -> str:
    """The stages of a search for {p}_words (query_id, keyword, key), under names that begin with p."""
    score = """specific DESC, exact DESC, least(ceil(source_chunk_count / 4.0), 20) DESC, least(source_chunk_count, 100) DESC,
            CASE WHEN source_chunk_count <= 1 THEN 10 ELSE 0 END + CASE WHEN source_chunk_count = 0 THEN 20 ELSE 0 END, length(name), entity_id"""
    generic = ", ".join(f"'{w}'" for w in GENERIC)
    return f"""
{p}_hit AS MATERIALIZED (SELECT key, entity_id, list_contains(names, key) AS exact FROM named JOIN (SELECT DISTINCT key FROM {p}_words WHERE key <> '') ON len(list_filter(names, lambda x: contains(x, key))) > 0 QUALIFY row_number() OVER (PARTITION BY key ORDER BY entity_id) <= 80),
{p}_matched AS (SELECT query_id, keyword, entity_id, exact FROM {p}_words JOIN {p}_hit USING (key)),
{p}_per AS (SELECT query_id, entity_id, bool_or(exact) AS exact, bool_or({_SPACED.format('keyword')} NOT IN ({generic})) AS specific FROM {p}_matched GROUP BY 1, 2),
{p}_kept AS (SELECT * FROM (SELECT *, bool_or(specific) OVER (PARTITION BY query_id) AS any_specific FROM {p}_per) WHERE specific OR NOT any_specific),
{p}_ranked AS MATERIALIZED (SELECT query_id, entity_id, row_number() OVER (PARTITION BY query_id ORDER BY {score}) AS rank FROM {p}_kept JOIN entities USING (entity_id) QUALIFY rank <= 60),
{p}_followed AS MATERIALIZED (SELECT query_id, relation_id, e.entity_id, relation_type, other_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, relation_id, other_id) AS place FROM {p}_ranked e JOIN ends x ON e.entity_id = x.entity_id JOIN relations USING (relation_id) QUALIFY place <= 100),
{p}_frontier AS (SELECT query_id, entity_id, min(distance) AS distance FROM (SELECT query_id, entity_id, 0 AS distance FROM {p}_ranked UNION ALL SELECT query_id, other_id, 1 FROM {p}_ranked JOIN ends USING (entity_id)) GROUP BY 1, 2),
{p}_far AS (SELECT query_id, entity_id FROM {p}_frontier WHERE distance > 0),
{p}_own AS (SELECT query_id, entity_id FROM {p}_ranked UNION SELECT query_id, other_id FROM {p}_followed),
{p}_chunks AS MATERIALIZED (SELECT query_id, chunk_id, min(way)::INTEGER AS way FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, way ORDER BY chunk_id) AS place FROM (SELECT DISTINCT query_id, chunk_id, 0 AS way FROM {p}_own JOIN begins USING (entity_id) UNION ALL SELECT DISTINCT query_id, chunk_id, 1 FROM {p}_far JOIN begins USING (entity_id)))
    WHERE place <= CASE way WHEN 0 THEN 200 ELSE 300 END GROUP BY 1, 2),
{p}_shown AS (SELECT query_id, relation_id FROM {p}_followed WHERE place <= 50)"""


def _traced(p: str) -> str:
    parts = {"matched": f"(SELECT DISTINCT query_id, entity_id FROM {p}_matched)", "ranked": f"{p}_ranked", "frontier": f"{p}_far", "relations": f"{p}_shown", "chunks": f"{p}_chunks"}
    column = {"relations": "relation_id", "chunks": "chunk_id"}
    counts = " UNION ALL ".join(f"SELECT query_id, {k} AS step, count(*) AS n, min({column.get(s, 'entity_id')}) AS first FROM {t} GROUP BY query_id" for k, (s, t) in enumerate(parts.items()))
    return f"counts AS ({counts}), stages(step, stage) AS (VALUES {', '.join(f'({k}, {chr(39)}{s}{chr(39)})' for k, s in enumerate(parts))}), traced AS (SELECT o.query_id, s.step::INTEGER AS step, stage, coalesce(n, 0)::BIGINT AS n, first FROM openings o CROSS JOIN stages s LEFT JOIN counts c ON o.query_id = c.query_id AND s.step = c.step)"


_FIRST_PASS = f"""{_GRAPH.replace('entities AS (', 'entities AS MATERIALIZED (', 1).replace('relations AS (SELECT *,', 'relations AS MATERIALIZED (SELECT *,', 1)}, {_SUPPORTS}, {_EVIDENCE}, {_ASKED}, {_KEYWORDS}, {_NAMES},
begins AS MATERIALIZED (SELECT DISTINCT src_id AS entity_id, chunk_id FROM relations JOIN supports USING (relation_id) JOIN evidence USING (evidence_id)),
openings AS (SELECT query_id, query, keywords[:{SEARCH_WORDS}] AS keywords FROM worded WHERE turn = 0),
a_words AS (SELECT query_id, keyword, {_SPACED.format('keyword')} AS key FROM (SELECT query_id, unnest(keywords) AS keyword FROM openings)), {_searched('a')}"""
_PLANNED = f"""{_ROUTED}, counted AS (SELECT o.*, route, (SELECT count(*) FROM a_chunks c WHERE c.query_id = o.query_id) AS n_contexts, (SELECT count(*) FROM a_shown c WHERE c.query_id = o.query_id) AS n_relations, (SELECT count(*) FROM a_ranked c WHERE c.query_id = o.query_id) AS n_entities
    FROM openings o JOIN routed r ON o.query_id = r.query_id),
falling AS (SELECT * FROM counted WHERE (n_contexts < 3 AND n_relations = 0) OR (route IN ('safety_boundary', 'diagnostic_boundary', 'intervention_advice') AND (n_relations = 0 OR n_entities = 0))),
planned AS (SELECT query_id, route, CASE route {' '.join(f"WHEN '{r}' THEN '{why}'" for r, (why, *_) in PLANS.items() if r)} ELSE '{PLANS[''][0]}' END AS reason,
    CASE route {' '.join(f"WHEN '{r}' THEN {_asked_again(t)}" for r, (_, t, *_) in PLANS.items() if r)} ELSE {_asked_again(PLANS[''][1])} END AS follow_query,
    CASE route {' '.join(f"WHEN '{r}' THEN keywords[:{n}] || {_LIST(w)}" for r, (_, _, w, n) in PLANS.items() if r)} ELSE keywords[:{PLANS[''][3]}] || {_LIST(PLANS[''][2])} END AS follow_keywords FROM falling)"""
_CANONICAL = f"""{_ENTITIES}, {_ALIASES.replace('aliases AS (', 'aliases AS MATERIALIZED (', 1)}, steps AS MATERIALIZED (SELECT entity_id, lag(entity_id) OVER (PARTITION BY type, alias ORDER BY entity_id) AS prev FROM aliases),
reach(root, entity_id) AS (SELECT entity_id, entity_id FROM steps GROUP BY entity_id HAVING count(prev) = 0 UNION SELECT root, s.entity_id FROM reach r JOIN steps s ON s.prev = r.entity_id),
grouped AS (SELECT entity_id, min(root) AS group_id FROM reach GROUP BY 1), named_groups AS (SELECT type, group_id, min(alias) AS canonical_name FROM aliases JOIN grouped USING (entity_id) GROUP BY 1, 2),
merged_groups AS (SELECT *, min(group_id) OVER (PARTITION BY type, canonical_name) AS canonical_id FROM named_groups), canonical AS (SELECT entity_id, group_id, canonical_name, canonical_id FROM grouped JOIN merged_groups USING (group_id))"""

ORACLES = {
    "merge_log": f"""WITH {_KEYED} SELECT type, merge_key, reason, arg_min(entity_id, place) AS primary_id, count(*)::BIGINT AS entity_count, sum(source_chunk_count)::BIGINT AS source_chunk_count, array_to_string(list_sort(list(DISTINCT name)), '|') AS names
        FROM keyed WHERE reason IS NOT NULL GROUP BY ALL HAVING count(*) > 1""",
    "curated_merge": f"""WITH {_KEYED}, g AS (SELECT type, merge_key, arg_min(entity_id, place) AS entity_id, arg_min(name, place) AS first_name, count(*)::BIGINT AS members, sum(source_chunk_count)::BIGINT AS source_chunk_count, max(reason) AS reason FROM keyed GROUP BY 1, 2),
        w AS (SELECT type, merge_key, name, sum(greatest(source_chunk_count, 1)) AS n FROM keyed GROUP BY ALL), b AS (SELECT type, merge_key, arg_min(name, (-n, length(name), name)) AS name FROM w GROUP BY 1, 2),
        t AS (SELECT DISTINCT type, merge_key, unnest(list_append(synonyms, name)) AS term FROM keyed),
        s AS (SELECT type, merge_key, coalesce(string_agg(term, '|' ORDER BY term) FILTER (WHERE term <> first_name), '') AS synonyms FROM t JOIN g USING (type, merge_key) GROUP BY 1, 2)
        SELECT type, entity_id, name, members, source_chunk_count, synonyms, CASE WHEN members > 1 AND reason IS NOT NULL THEN 'merged_by:' || reason ELSE '' END AS flag FROM g JOIN b USING (type, merge_key) JOIN s USING (type, merge_key)""",
    "relation_page": f"WITH {_NAMED}, found AS (SELECT * FROM named WHERE contains(source, 'ring') OR contains(target, 'ring')) SELECT *, (SELECT count(*) FROM found)::BIGINT AS total FROM found ORDER BY support_count DESC, relation_id LIMIT 20 OFFSET 40",
    "chunk_page": f"WITH {_DOC}, found AS (SELECT doc_id, source AS source_group, t FROM doc WHERE contains(t, 'the')) SELECT doc_id, source_group, CASE WHEN length(t) > 300 THEN left(t, 300) || '...' ELSE t END AS text, length(t)::BIGINT AS text_length, (SELECT count(*) FROM found)::BIGINT AS total FROM found ORDER BY source_group, doc_id LIMIT 20 OFFSET 20",
    "relation_type_counts": f"WITH {_ENTITIES}, {_RELATIONS} SELECT relation_type, count(*)::BIGINT AS n FROM relations GROUP BY 1",
    "modality_relations": f"WITH {_NAMED} SELECT relation_id, source, source_type, target, support_count FROM named WHERE relation_type = 'MEASURED_BY' AND (contains(lower(target), 'gear') OR contains(lower(target), 'bolt')) ORDER BY support_count DESC, relation_id LIMIT 50",
    "compare_summary": f"""WITH {_COMPARED} SELECT count(*)::BIGINT AS total, (count(*) FILTER (WHERE delta IN ('agent_win', 'agent_gain')))::BIGINT AS improved, (count(*) FILTER (WHERE delta IN ('agent_regression', 'agent_loss')))::BIGINT AS regressed,
        (count(*) FILTER (WHERE delta = 'tie'))::BIGINT AS tied, (count(*) FILTER (WHERE follow_up))::BIGINT AS follow_ups, round((count(*) FILTER (WHERE follow_up))::DOUBLE / count(*), 4) AS follow_up_rate,
        min(gain)::BIGINT AS relation_delta_min, max(gain)::BIGINT AS relation_delta_max, round(sum(gain)::DOUBLE / count(*), 2) AS relation_delta_avg,
        min(gain)::DOUBLE / 4 AS seconds_delta_min, max(gain)::DOUBLE / 4 AS seconds_delta_max, round(sum(gain)::DOUBLE / 4 / count(*), 2) AS seconds_delta_avg FROM pairs""",
    "compare_counts": f"WITH {_COMPARED} SELECT 'category' AS kind, coalesce(category, 'uncategorized') AS name, delta, count(*)::BIGINT AS n FROM pairs GROUP BY ALL UNION ALL SELECT 'route', coalesce(route, 'unknown'), '', count(*)::BIGINT FROM pairs GROUP BY ALL",
    "answer_overstatement": f"WITH {_CHECKED} SELECT conv_id, turn, {_OPEN} AS overstates FROM c",
    "metrics_summary": f"WITH {_CHECKED}, said AS (SELECT * REPLACE (CASE WHEN answer <> '' THEN answer END AS answer) FROM judged) SELECT * FROM ({_METRICS}) WHERE total > 0",
    "clean_documents": f"WITH {_CLEAN} SELECT * EXCLUDE (page_texts) REPLACE (sha1(text) AS text), sha1(array_to_string(page_texts, '|')) AS page_texts FROM done",
    "clean_summary": f"""WITH {_CLEAN}, m AS (SELECT 'status:' || status AS measure, 1 AS n FROM done UNION ALL SELECT 'language:' || language, 1 FROM done UNION ALL SELECT 'raw_chars', raw_chars FROM done
        UNION ALL SELECT 'clean_chars', clean_chars FROM done UNION ALL SELECT 'flag:' || flags, 1 FROM done WHERE flags <> '') SELECT measure, sum(n)::BIGINT AS value FROM m GROUP BY 1""",
    "doc_lang_detect": rf"WITH {_DOC}, n AS (SELECT doc_id, {_n('t', _CJK)}::BIGINT AS zh, {_n('t', '[A-Za-z]')}::BIGINT AS en FROM doc) SELECT *, CASE WHEN zh = 0 AND en = 0 THEN 'unknown' WHEN zh >= en THEN 'zh' ELSE 'en' END AS language FROM n",
    "doc_token_estimate": f"WITH {_DOC} SELECT doc_id, {_TOKENS} AS tokens FROM doc",
    "doc_line_noise": f"WITH {_DOC}, {_LINES} SELECT doc_id, len(lines)::BIGINT AS n_lines, len(list_filter(lines, lambda x: {_NOISE}))::BIGINT AS n_noise, len(list_filter(lines, lambda x: {_OCR}))::BIGINT AS n_ocr_noise FROM lined",
    "doc_quality_grade": f"WITH {_GRADED} SELECT doc_id, chars, n_lines, grade, array_to_string(risk, '|') AS risk_flags FROM g",
    "doc_grade_dist": f"WITH {_GRADED} SELECT grade, count(*)::BIGINT AS n FROM g GROUP BY 1",
    "doc_flag_dist": f"WITH {_GRADED} SELECT flag, count(*)::BIGINT AS n FROM (SELECT unnest(risk) AS flag FROM g) GROUP BY 1",
    "doc_gate": f"""WITH {_GRADED}, s AS (SELECT count(*)::BIGINT AS n, (count(*) FILTER (WHERE grade IN ('A', 'B')))::BIGINT AS n_good, 0::BIGINT AS n_spaced, (count(*) FILTER (WHERE grade = 'F'))::BIGINT AS n_failed, 0::DOUBLE AS p95_cjk_spaces,
        list_sort(list(round(noisy, 4)))[least(count(*), floor(count(*) * 0.95)::BIGINT + 1)] AS p95_noisy_lines FROM g) SELECT *, n_good >= 0.90 * n AND n_failed <= 0.03 * n AND p95_noisy_lines <= 0.12 AS passed FROM s""",
    "extraction_grade": rf"""WITH {_MEASURED}, b AS (SELECT *, (regexp_matches(lower(t), 'document generated by anna[''’]s archive')::INT + contains(lower(t), 'copyright')::INT + contains(lower(t), 'all rights reserved')::INT
        + regexp_matches(t, '目\s*录')::INT + contains(lower(t), 'contents')::INT) AS boiler_hits, contains(lower(t), 'document generated by anna') AS anna FROM m)
        SELECT doc_id, boiler_hits::INTEGER AS boiler_hits, CASE WHEN anna OR chars < 120 THEN 'F' WHEN chars < 40 OR chars < 1000 THEN 'D' WHEN chars < 4000 THEN 'C' WHEN uniq >= 0.5 THEN 'A' ELSE 'B' END AS grade,
        array_to_string(list_sort(list_filter([CASE WHEN anna THEN 'anna_archive_marker' END, CASE WHEN boiler_hits >= 2 AND chars < 3000 THEN 'boilerplate_dominant' END, CASE WHEN uniq < 0.25 AND n_lines > 80 THEN 'high_line_duplication' END,
        CASE WHEN chars < 40 THEN 'low_chars_per_page' END, CASE WHEN chars < 200 THEN 'too_short' END], lambda x: x IS NOT NULL)), '|') AS flags FROM b""",
    "doc_metric_p95": f"WITH {_DOC}, l AS (SELECT list_sort(list(length(t)::BIGINT)) AS v, count(*) AS n FROM doc) SELECT n::BIGINT AS n, v[1] AS least, v[-1] AS most, v[n // 2 + 1] AS upper_median, (v[(n + 1) // 2] + v[n // 2 + 1]) / 2.0 AS median, v[least(n, floor(n * 0.95)::BIGINT + 1)] AS p95_index, v[greatest(ceil(n * 0.95)::BIGINT, 1)] AS p95_rank FROM l",
    "unique_line_ratio": f"WITH {_DOC}, {_LINES} SELECT doc_id, len(lines)::BIGINT AS n_lines, len(list_distinct(lines))::BIGINT AS n_distinct FROM lined",
    "repeated_lines": f"WITH {_DOC}, {_LINES} SELECT doc_id, line, count(*)::BIGINT AS n FROM (SELECT doc_id, unnest(lines) AS line FROM lined) WHERE length(line) BETWEEN 1 AND 60 GROUP BY 1, 2 HAVING count(*) >= 2",
    "duplicate_ratio": f"WITH {_DOC} SELECT count(*)::BIGINT AS n, (count(*) - count(DISTINCT {_SIGNATURE}))::BIGINT AS n_duplicate FROM doc",
    "duplicate_groups": f"WITH {_DOC} SELECT {_SIGNATURE} AS signature, count(*)::BIGINT AS n, min(doc_id) AS first FROM doc GROUP BY 1 HAVING count(*) > 1",
    "source_catalog": rf"""WITH {_DOC}, {_CATALOG} SELECT doc_id, title, list_max(list_transform(regexp_extract_all(path || ' ' || title || ' ' || substr(t, 1, 4000), '\b(19[5-9]\d|20[0-3]\d)\b'), lambda y: y::INTEGER)) AS year,
        source_type, CASE source_type WHEN 'guideline_or_consensus' THEN 'S' WHEN 'systematic_review_or_meta' THEN 'A' WHEN 'trial' THEN 'A' WHEN 'case_report' THEN 'C' WHEN 'protocol' THEN 'C' ELSE 'B' END AS evidence_level,
        CASE WHEN contains(w, 'pmc') THEN 'public_web_open_access' ELSE 'unknown' END AS license FROM kinds""",
    "noisy_selection_reasons": f"WITH {_DOC} SELECT CASE WHEN doc_id % 5 = 0 THEN 'skip_evidence' WHEN source = 'src1' THEN 'skip_source_type' WHEN {_NOISY_CHUNK} THEN 'skip_noisy' ELSE 'selected' END AS reason, count(*)::BIGINT AS n FROM doc GROUP BY 1",
    "pilot_top_per_doc": f"""WITH {_DOC}, s AS (SELECT doc_id, source AS source_group, ({_SCORED})::BIGINT AS score, {_TOKENS}::INTEGER AS tokens FROM doc WHERE raw IS NOT NULL AND NOT {_NOISY_CHUNK}),
        p AS (SELECT *, row_number() OVER (PARTITION BY source_group ORDER BY score DESC, -tokens DESC, doc_id DESC) AS place FROM s) SELECT doc_id, source_group, score, tokens FROM p WHERE place <= 3 ORDER BY score DESC, -tokens DESC, doc_id DESC LIMIT 12""",
    "lowest_review_list": f"WITH {_GRADED} SELECT doc_id, grade, chars FROM g ORDER BY grade, chars, doc_id LIMIT 100",
    "chunk_quality": rf"""WITH {_DOC}, n AS (SELECT doc_id, {_TOKENS} AS n, {_n('t', '[�□■◆▲▼※¤§]')}::DOUBLE / greatest(length(t), 1) AS weird, {_n('t', '[A-Za-z0-9Ａ-Ｚａ-ｚ０-９\\x{4e00}-\\x{9fff}]')}::DOUBLE / greatest(length(t), 1) AS readable FROM doc),
        r AS (SELECT *, weird > 0.02 OR readable < 0.45 AS noisy FROM n)
        SELECT doc_id, CASE WHEN n < 60 OR noisy OR n > 1010 THEN 'D' WHEN n < 180 OR n > 760 OR weird > 0.01 THEN 'C' ELSE 'A' END AS grade,
        array_to_string(list_sort(list_filter([CASE WHEN noisy THEN 'noisy_high' END, CASE WHEN NOT noisy AND weird > 0.01 THEN 'noisy_mild' END, CASE WHEN n > 760 AND n <= 1010 THEN 'too_long' END, CASE WHEN n > 1010 THEN 'too_long_severe' END,
        CASE WHEN n >= 60 AND n < 180 THEN 'too_short' END, CASE WHEN n < 60 THEN 'too_short_severe' END], lambda x: x IS NOT NULL)), '|') AS risk_flags FROM r""",
    "chunk_gate": rf"""WITH {_DOC}, n AS (SELECT {_TOKENS} AS k, {_n('t', '[�□■◆▲▼※¤§]')}::DOUBLE / greatest(length(t), 1) > 0.02 OR {_n('t', '[A-Za-z0-9Ａ-Ｚａ-ｚ０-９\\x{4e00}-\\x{9fff}]')}::DOUBLE / greatest(length(t), 1) < 0.45 OR {_n('t', '[�□■◆▲▼※¤§]')}::DOUBLE / greatest(length(t), 1) > 0.01 AS bad, {_SIGNATURE} AS s FROM doc),
        a AS (SELECT count(*)::BIGINT AS n, (count(*) FILTER (WHERE k >= 180 AND k <= 760))::BIGINT AS in_range, (count(*) FILTER (WHERE bad))::BIGINT AS noisy, (count(*) FILTER (WHERE k < 120))::BIGINT AS short, (count(*) - count(DISTINCT s))::BIGINT AS duplicate FROM n),
        e AS (SELECT count(*)::BIGINT AS expected, (count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM documents)))::BIGINT AS covered FROM (SELECT DISTINCT doc_id FROM labels WHERE quality = 1))
        SELECT *, in_range >= 0.95 * greatest(n, 1) AND noisy <= 0.03 * greatest(n, 1) AND short <= 0.03 * greatest(n, 1) AND duplicate <= 0.08 * greatest(n, 1) AND covered >= 0.99 * expected AS passed FROM a, e""",
    "chunk_prev_next": "WITH i AS (SELECT conv_id, turn, conv_id || '_c' || lpad((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::VARCHAR, 4, '0') AS chunk_id FROM conversations) SELECT *, lag(chunk_id) OVER (PARTITION BY conv_id ORDER BY turn) AS prev_id, lead(chunk_id) OVER (PARTITION BY conv_id ORDER BY turn) AS next_id FROM i",
    "doc_chunk_map": "WITH i AS (SELECT conv_id, conv_id || '_c' || lpad((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::VARCHAR, 4, '0') AS chunk_id FROM conversations) SELECT d.doc_id AS conv_id, count(i.chunk_id)::BIGINT AS n_chunks, coalesce(string_agg(i.chunk_id, '|' ORDER BY i.chunk_id), '') AS chunk_ids FROM documents d LEFT JOIN i ON d.doc_id = i.conv_id GROUP BY 1",
    "run_merge": f"WITH {_MERGED} SELECT chunk, seq, status, event_type, first_seq, n_records::BIGINT AS n_records FROM picked WHERE place = 1",
    "retry_set": f"WITH {_MERGED} SELECT r.* FROM runs r WHERE chunk IN (SELECT chunk FROM picked WHERE place = 1 AND status = 'error')",
    "resume_unseen": f"WITH {_RUNS} SELECT doc_id AS chunk FROM documents WHERE doc_id NOT IN (SELECT chunk FROM runs WHERE status = 'ok')",
    "next_index": f"WITH {_RUNS} SELECT min(i)::BIGINT AS next_index FROM (SELECT 0::BIGINT AS i UNION SELECT chunk + 1 FROM runs WHERE chunk >= 0) WHERE i NOT IN (SELECT chunk FROM runs)",
    "error_filter": f"WITH {_RUNS} SELECT event_type, (count(*) FILTER (WHERE seq % 5 IN (2, 3, 4)))::BIGINT AS n_retryable, count(*)::BIGINT AS n FROM runs GROUP BY 1",
    "allowed_pair_check": f"""WITH {_GRAPH}, {_TOOLED}, {_FLAGGED} SELECT relation_type, src_type, dst_type, count(*)::BIGINT AS n, (count(*) FILTER (WHERE (relation_type = 'MEASURED_BY' AND src_type = 'Condition' AND dst_type = 'AssessmentTool')
        OR (relation_type = 'SUITABLE_AGE' AND src_type IN ('Intervention', 'Condition') AND dst_type = 'AgeStage')))::BIGINT AS n_legal FROM used GROUP BY 1, 2, 3""",
    "entity_reject_reason": f"WITH {_EXTRACTED} SELECT type, reject_reason, count(*)::BIGINT AS n FROM typed GROUP BY 1, 2",
    "relation_reject_reason": f"WITH {_EXTRACTED}, {_RELATED} SELECT relation_type, reject_reason, count(*)::BIGINT AS n FROM judged GROUP BY 1, 2",
    "revalidated_runs": f"""WITH {_EXTRACTED}, {_RELATED}, ends AS (SELECT DISTINCT src_id AS k, unnest([src_id, dst_id]) AS entity_id FROM relations),
        found AS (SELECT k, true AS entity, reject_reason FROM typed JOIN ends USING (entity_id) UNION ALL SELECT src_id, false, reject_reason FROM judged),
        n AS (SELECT k, entity, reject_reason, count(*)::BIGINT AS n FROM found GROUP BY ALL),
        s AS (SELECT k, sum(n) FILTER (WHERE entity AND reject_reason IS NULL) AS e, sum(n) FILTER (WHERE NOT entity AND reject_reason IS NULL) AS r, string_agg(reject_reason || ':' || n, '|' ORDER BY reject_reason || ':' || n) AS w FROM n GROUP BY k),
        records AS (SELECT user_id AS chunk, arg_max(CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END, event_id) AS status FROM events GROUP BY 1)
        SELECT chunk, status, CASE WHEN status = 'ok' THEN coalesce(e, 0)::BIGINT ELSE 0 END AS n_entities, CASE WHEN status = 'ok' THEN coalesce(r, 0)::BIGINT ELSE 0 END AS n_relations, CASE WHEN status = 'ok' THEN coalesce(w, '') ELSE '' END AS warnings
        FROM records LEFT JOIN s ON chunk = k""",
    "graph_entities": f"WITH {_ENTITIES} SELECT entity_id, name, type, array_to_string(synonyms, '|') AS synonyms, source_chunk_count, ceil(source_chunk_count / 4.0)::BIGINT AS source_doc_count FROM entities",
    "graph_relations": f"WITH {_RELATIONS} SELECT * FROM relations",
    "degree_entity_only": f"WITH {_GRAPH}, {_DEGREES} SELECT * FROM degrees",
    "degree_all": f"WITH {_GRAPH}, {_SUPPORTS}, every AS (SELECT entity_id FROM ends UNION ALL SELECT src_id FROM supports JOIN relations USING (relation_id)) SELECT e.entity_id, count(x.entity_id)::BIGINT AS degree FROM entities e LEFT JOIN every x ON e.entity_id = x.entity_id GROUP BY 1",
    "isolated_entities": f"WITH {_GRAPH}, {_DEGREES} SELECT type, count(*)::BIGINT AS n FROM degrees JOIN entities USING (entity_id) WHERE degree = 0 GROUP BY 1",
    "alias_conflicts": f"WITH {_ENTITIES.replace('entities AS (', 'base AS (', 1)}, entities AS (SELECT * FROM base UNION ALL SELECT 'x_' || entity_id, name, 'Condition', synonyms, source_chunk_count FROM base WHERE type = 'AgeStage'), {_ALIASES} SELECT alias, count(DISTINCT type)::BIGINT AS n_types, count(DISTINCT entity_id)::BIGINT AS n_entities FROM aliases GROUP BY 1 HAVING count(DISTINCT type) > 1",
    "entity_flags": rf"""WITH {_GRAPH}, {_DEGREES}, {_TOOLED}, {_ALIASES}, conflicts AS (SELECT alias FROM aliases GROUP BY 1 HAVING count(DISTINCT type) > 1),
        own AS (SELECT entity_id, string_agg(DISTINCT alias, '|' ORDER BY alias) AS names FROM aliases JOIN conflicts USING (alias) GROUP BY 1), sizes AS (SELECT {_KEY.format('name')} AS k, count(*) AS size FROM entities GROUP BY 1),
        j AS (SELECT t.*, degree, names, CASE WHEN size > 1 AND k <> '' THEN size ELSE 1 END AS group_size, CASE WHEN type = 'AssessmentTool' THEN tool ELSE '' END AS tool_category FROM tooled t JOIN degrees USING (entity_id) LEFT JOIN own USING (entity_id) LEFT JOIN sizes ON k = {_KEY.format('name')})
        SELECT entity_id, degree, group_size::BIGINT AS group_size, tool_category, coalesce(names, '') AS conflict_aliases, array_to_string(list_sort(list_filter([CASE WHEN tool_category IN ('research_modality', 'digital_algorithm', 'generic_method') THEN 'assessment_tool_category:' || tool_category END,
        CASE WHEN names IS NOT NULL THEN 'alias_type_conflict' END, CASE WHEN degree = 0 THEN 'isolated_entity' END, CASE WHEN group_size > 1 THEN 'same_name_duplicate' END, CASE WHEN source_chunk_count <= 1 THEN 'single_chunk_entity' END], lambda x: x IS NOT NULL)), '|') AS flags FROM j""",
    "tool_class_ladder": f"WITH {_ENTITIES}, {_TOOLED} SELECT tool AS tool_class, count(*)::BIGINT AS n FROM tooled GROUP BY 1",
    "relation_flags_usage": f"WITH {_GRAPH}, {_TOOLED}, {_FLAGGED} SELECT relation_type, qa_usage, flags, count(*)::BIGINT AS n FROM used GROUP BY 1, 2, 3",
    "evidence_level_summary": f"WITH {_SUPPORTS}, {_EVIDENCE}, n AS (SELECT relation_id, coalesce(evidence_level, 'unknown') AS level, count(*) AS n FROM supports LEFT JOIN evidence USING (evidence_id) GROUP BY 1, 2) SELECT relation_id, string_agg(level || ':' || n, '|' ORDER BY level || ':' || n) AS summary FROM n GROUP BY 1",
    "same_name_groups": f"WITH {_ENTITIES} SELECT {_KEY.format('name')} AS name_key, count(*)::BIGINT AS size, string_agg(DISTINCT type, '|' ORDER BY type) AS types FROM entities GROUP BY 1 HAVING count(*) > 1 AND name_key <> ''",
    "same_name_merge": f"WITH {_ENTITIES}, {_MERGE} SELECT h.type, h.primary_id, h.name, count(*)::BIGINT AS members, sum(source_chunk_count)::BIGINT AS source_chunk_count FROM keyed k JOIN heads h ON k.type = h.type AND k.key = h.key GROUP BY 1, 2, 3",
    "relation_remerge": f"""WITH {_GRAPH}, {_SUPPORTS}, {_MERGE}, named AS (SELECT k.entity_id, primary_id FROM keyed k JOIN heads h ON k.type = h.type AND k.key = h.key),
        moved AS (SELECT relation_id, s.primary_id AS src_id, relation_type, d.primary_id AS dst_id, round(confidence * 1000000)::BIGINT AS c FROM relations r JOIN named s ON r.src_id = s.entity_id JOIN named d ON r.dst_id = d.entity_id WHERE s.primary_id <> d.primary_id),
        backed AS (SELECT src_id, relation_type, dst_id, count(DISTINCT evidence_id)::BIGINT AS support_count FROM moved JOIN supports USING (relation_id) GROUP BY ALL),
        g AS (SELECT src_id, relation_type, dst_id, ((2 * sum(c) + 100 * count(*)) // (200 * count(*)))::DOUBLE / 10000 AS confidence, count(*)::BIGINT AS n_merged FROM moved GROUP BY ALL)
        SELECT src_id, relation_type, dst_id, coalesce(support_count, 0)::BIGINT AS support_count, confidence, n_merged FROM g LEFT JOIN backed USING (src_id, relation_type, dst_id)""",
    "best_name": "SELECT brand, name AS best FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY n DESC, length(name), name) AS p FROM (SELECT p_brand AS brand, p_name AS name, count(*) AS n FROM part GROUP BY 1, 2)) WHERE p = 1",
    "graph_one_hop": f"WITH {_GRAPH} SELECT x.entity_id, relation_type, other_id FROM ends x JOIN entities e USING (entity_id) JOIN relations USING (relation_id) WHERE e.type = 'AgeStage' OR e.entity_id IN ('supp_1', 'part_7')",
    "relation_context": f"WITH {_RELATIONS} SELECT relation_id, src_id, relation_type, dst_id, support_count FROM relations WHERE src_id IN ('cust_1', 'part_3', 'supp_2') OR dst_id IN ('cust_1', 'part_3', 'supp_2')",
    "induced_subgraph": f"WITH {_GRAPH.replace('entities AS (', 'entities AS MATERIALIZED (', 1).replace('relations AS (SELECT *,', 'relations AS MATERIALIZED (SELECT *,', 1)}, {_DEGREES}, top AS MATERIALIZED (SELECT entity_id FROM degrees ORDER BY degree DESC, entity_id LIMIT 200) SELECT r.relation_id, r.src_id, r.dst_id, r.support_count FROM relations r JOIN top s ON r.src_id = s.entity_id JOIN top t ON r.dst_id = t.entity_id",
    "evidence_path_chunks": f"WITH {_GRAPH}, {_SUPPORTS}, {_EVIDENCE}, ids AS (SELECT unnest(['cust_1', 'part_3']) AS entity_id), around AS (SELECT entity_id FROM ids UNION SELECT other_id FROM ends WHERE entity_id IN (SELECT entity_id FROM ids)) SELECT DISTINCT chunk_id FROM around JOIN relations ON src_id = entity_id JOIN supports USING (relation_id) JOIN evidence USING (evidence_id)",
    "rank_join_evidence": f"WITH {_GRAPH}, {_SUPPORTS}, {_EVIDENCE}, top AS (SELECT relation_id, row_number() OVER (ORDER BY support_count DESC, confidence DESC, relation_id) AS rank FROM relations WHERE relation_type = 'MEASURED_BY' QUALIFY rank <= 20) SELECT rank, relation_id, evidence_id, chunk_id FROM top JOIN supports USING (relation_id) JOIN evidence USING (evidence_id)",
    "validation_top_pairs": f"WITH {_GRAPH}, top AS (SELECT * FROM relations WHERE relation_type = 'MEASURED_BY' ORDER BY support_count DESC, confidence DESC, relation_id LIMIT 25) SELECT relation_id, s.name AS src_name, d.name AS dst_name, support_count FROM top JOIN entities s ON src_id = s.entity_id JOIN entities d ON dst_id = d.entity_id",
    "prompt_assembly": """SELECT q.conv_id AS query_id, concat_ws(chr(10) || chr(10), 'Question: ' || q.text, 'Texts:' || chr(10) || (SELECT string_agg('[C' || turn || '] ' || text, chr(10) ORDER BY turn) FROM conversations c WHERE c.conv_id = q.conv_id AND turn > 0),
        'Relations:' || chr(10) || (SELECT '[G1] ' || any_value(role) || ' says ' || any_value(text) FROM conversations c WHERE c.conv_id = q.conv_id AND turn = 1)) AS prompt FROM conversations q WHERE turn = 0""",
    "graph_export": f"""WITH {_GRAPH}, {_SUPPORTS}, {_EVIDENCE}
        SELECT 'entity' AS kind, entity_id AS key, concat_ws(',', entity_id, name, type, array_to_string(synonyms, '|'), source_chunk_count) AS fields FROM entities UNION ALL SELECT DISTINCT 'chunk', chunk_id, chunk_id FROM evidence
        UNION ALL SELECT 'evidence', evidence_id, concat_ws(',', evidence_id, evidence_level) FROM evidence UNION ALL SELECT 'relation', relation_id, concat_ws(',', src_id, dst_id, relation_type, relation_id, support_count, round(confidence, 4)::DECIMAL(6, 4)) FROM relations
        UNION ALL SELECT DISTINCT 'supported_by', concat_ws(',', src_id, evidence_id, relation_id), concat_ws(',', src_id, evidence_id, relation_id) FROM supports JOIN relations USING (relation_id)
        UNION ALL SELECT DISTINCT 'from_chunk', concat_ws(',', evidence_id, chunk_id), concat_ws(',', evidence_id, chunk_id) FROM evidence""",
    "dashboard_stats": f"WITH {_GRAPH}, {_TOOLED}, {_FLAGGED}, {_EVIDENCE} SELECT kind, value, count(*)::BIGINT AS n FROM (SELECT 'entity_type' AS kind, type AS value FROM entities UNION ALL SELECT 'qa_usage', qa_usage FROM used UNION ALL SELECT 'evidence_level', evidence_level FROM evidence) GROUP BY 1, 2",
    "entity_page": f"WITH {_ENTITIES} SELECT entity_id, name, source_chunk_count FROM entities WHERE contains(name, 'a') AND type = 'AssessmentTool' ORDER BY source_chunk_count DESC, entity_id LIMIT 20 OFFSET 20",
    "entity_keyword_match": f"WITH {_MATCHED} SELECT query_id::BIGINT AS query_id, keyword, entity_id, exact FROM matched",
    "entity_rank_top60": f"""WITH {_MATCHED}, per AS (SELECT query_id, entity_id, bool_or(exact) AS exact, bool_or(lower(keyword) NOT IN ('asd', 'autism')) AS specific FROM matched GROUP BY 1, 2),
        kept AS (SELECT * FROM (SELECT *, bool_or(specific) OVER (PARTITION BY query_id) AS any_specific FROM per) WHERE specific OR NOT any_specific),
        ranked AS (SELECT k.*, row_number() OVER (PARTITION BY query_id ORDER BY specific DESC, exact DESC, least(ceil(source_chunk_count / 4.0), 20) DESC, least(source_chunk_count, 100) DESC,
            CASE WHEN source_chunk_count <= 1 THEN 10 ELSE 0 END + CASE WHEN source_chunk_count = 0 THEN 20 ELSE 0 END, length(name), entity_id) AS rank FROM kept k JOIN entities USING (entity_id))
        SELECT query_id::BIGINT AS query_id, rank, entity_id, specific, exact FROM ranked WHERE rank <= 60""",
    "relation_rank": f"""WITH {_GRAPH}, {_TOOLED}, {_FLAGGED}, n AS (SELECT u.*, lower(concat_ws(' ', s.name, src_type, relation_type, d.name, dst_type)) AS w FROM used u JOIN entities s ON src_id = s.entity_id JOIN entities d ON dst_id = d.entity_id),
        sc AS (SELECT *, (CASE WHEN contains(w, 'blue') THEN 100 ELSE 0 END + CASE WHEN contains(w, 'steel') THEN 100 ELSE 0 END + CASE WHEN contains(w, 'asd') THEN 10 ELSE 0 END + CASE WHEN relation_type = 'MEASURED_BY' THEN 15 ELSE 0 END
            + CASE WHEN src_type = 'AssessmentTool' OR dst_type = 'AssessmentTool' THEN 10 ELSE 0 END)::DOUBLE AS score FROM n) SELECT relation_id, score, row_number() OVER (ORDER BY score DESC, support_count DESC, confidence DESC, relation_id) AS rank FROM sc QUALIFY rank <= 50""",
    "vector_topk": f"WITH {_SCORES} SELECT query_id, vec_id, score, rank FROM near WHERE rank <= 10",
    "multi_query_topk": f"WITH {_SCORES}, {_best(20, 10)} SELECT vec_id, score, query_id FROM best",
    "hybrid_fusion": f"WITH {_FUSED} SELECT vec_id, score, in_graph, evidence_level, merged_score FROM fused",
    "context_assembly": f"""WITH {_FUSED}, hits AS (SELECT vec_id, in_graph, row_number() OVER (ORDER BY merged_score DESC, vec_id) - 1 AS pos FROM fused QUALIFY pos < 6),
        every AS (SELECT vec_id AS chunk_id, 0 AS branch, vec_id AS pos, 'graph-evidence' AS retrieval FROM embeddings WHERE vec_id IN (3, 5) UNION ALL SELECT vec_id, 1, pos, CASE WHEN in_graph THEN 'graph+vector' ELSE 'vector' END FROM hits
            UNION ALL SELECT vec_id, 2, vec_id, 'graph' FROM embeddings WHERE vec_id % 3 = 0),
        first AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY branch, pos) = 1) SELECT 'C' || row_number() OVER (ORDER BY branch, pos, chunk_id) AS citation, chunk_id, retrieval FROM first ORDER BY branch, pos, chunk_id LIMIT 12""",
    "chunk_rank": f"WITH {_DOC} SELECT doc_id, (CASE WHEN contains(lower(t), 'the') THEN 30 ELSE 0 END + CASE WHEN contains(lower(t), 'license') THEN 30 ELSE 0 END + CASE WHEN contains(lower(t), 'autism') THEN 3 ELSE 0 END + [5, 3, 1, 0, -1][doc_id % 5 + 1])::DOUBLE AS score FROM doc ORDER BY score DESC, doc_id LIMIT 50",
    "query_router": f"""WITH {_ASKED}, {_ROUTED} SELECT query_id, route, array_to_string(terms, '|') AS terms, route IN ('safety_boundary', 'diagnostic_boundary', 'intervention_advice', 'risk_info') AS requires_guardrail,
        route IN ('safety_boundary', 'diagnostic_boundary', 'intervention_advice') AS requires_followup FROM routed""",
    "keyword_hint_rules": f"WITH {_ASKED}, {_KEYWORDS} SELECT query_id, array_to_string(keywords, '|') AS keywords FROM worded",
    "alias_expand": f"""WITH {_ASKED}, {_KEYWORDS}, groups(g, alias) AS (VALUES {', '.join(f"({g}, '{a}')" for g, a in GROUPS)}), rows AS (SELECT query_id, unnest(keywords) AS keyword, unnest(range(len(keywords))) AS place FROM worded),
        every AS (SELECT query_id, place, 0 AS rank, '' AS second, keyword FROM rows UNION ALL SELECT DISTINCT query_id, place, 1, y.alias, y.alias FROM rows JOIN groups x ON {_SPACED.format('keyword')} = {_SPACED.format('x.alias')} JOIN groups y ON x.g = y.g),
        once AS (SELECT * FROM (SELECT *, {_SPACED.format('keyword')} AS key FROM every) QUALIFY row_number() OVER (PARTITION BY query_id, key ORDER BY place, rank, second, keyword) = 1)
        SELECT query_id, keyword, row_number() OVER (PARTITION BY query_id ORDER BY place, rank, second, key) - 1 AS place FROM once""",
    "graph_search": f"WITH {_FIRST_PASS} SELECT query_id, chunk_id, way FROM a_chunks",
    "graph_search_relations": f"WITH {_FIRST_PASS} SELECT query_id, place, relation_id, entity_id, relation_type, other_id FROM a_followed WHERE place <= 50",
    "retrieval_trace": f"WITH {_FIRST_PASS}, {_traced('a')} SELECT query_id, step, stage, n, first FROM traced",
    "followup_plan": f"WITH {_FIRST_PASS}, {_PLANNED} SELECT query_id, route, reason, follow_query, array_to_string(follow_keywords, '|') AS follow_keywords FROM planned",
    "agent_trace": f"""WITH {_FIRST_PASS}, {_PLANNED}, b_words AS (SELECT query_id, keyword, {_SPACED.format('keyword')} AS key FROM (SELECT DISTINCT query_id, unnest(follow_keywords) AS keyword FROM planned)), {_searched('b')},
        c_matched AS (SELECT query_id, entity_id FROM a_matched UNION ALL SELECT query_id, entity_id FROM b_matched), c_ranked AS (SELECT query_id, entity_id FROM a_ranked UNION SELECT query_id, entity_id FROM b_ranked),
        c_frontier AS (SELECT query_id, entity_id, min(distance) FILTER (pass = 0) AS d0, min(distance) AS d1 FROM (SELECT 0 AS pass, * FROM a_frontier UNION ALL SELECT 1, * FROM b_frontier) GROUP BY 1, 2),
        c_far AS (SELECT query_id, entity_id FROM c_frontier WHERE coalesce(d0, d1) > 0), c_shown AS (SELECT query_id, min(relation_id) AS relation_id FROM (SELECT 0 AS pass, * FROM a_followed WHERE place <= 50 UNION ALL SELECT 1, * FROM b_followed WHERE place <= 50) GROUP BY query_id, entity_id, relation_type, other_id),
        c_chunks AS (SELECT query_id, chunk_id FROM a_chunks UNION SELECT query_id, chunk_id FROM b_chunks), {_traced('c')} SELECT query_id, step, stage, n, first FROM traced""",
    "entity_resolution_in_order": f"WITH RECURSIVE {_CANONICAL} SELECT entity_id, group_id, canonical_name, canonical_id FROM canonical",
    "relation_rekey": f"""WITH RECURSIVE {_CANONICAL}, mentions AS (SELECT l_orderkey * 10 + l_linenumber AS seq, s.canonical_id AS src_id, d.canonical_id AS dst_id, l_discount, CASE WHEN l_linenumber > 1 THEN o_orderpriority || ' ' || l_linestatus END AS text, l_orderkey, o_custkey, o_orderstatus
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN canonical s ON s.entity_id = 'cust_' || o_custkey JOIN canonical d ON d.entity_id = 'part_' || l_partkey)
        SELECT src_id, 'MEASURED_BY' AS relation_type, dst_id, ((sum(round(l_discount * 1000000)::BIGINT) + 50 * count(*)) // (100 * count(*))) / 10000 AS confidence, count(DISTINCT l_orderkey) AS support_count, coalesce(arg_min(text, seq) FILTER (text IS NOT NULL), '') AS evidence_example,
            array_to_string(list_sort(list(DISTINCT 'ev_' || l_orderkey)), '|') AS support_evidence_ids, array_to_string(list_sort(list(DISTINCT 'c_' || o_custkey)), '|') AS support_chunk_ids, array_to_string(list_sort(list(DISTINCT o_orderstatus)), '|') AS support_doc_ids
        FROM mentions GROUP BY src_id, dst_id""",
    "answer_policy": f"""WITH {_INSPECTED}, p AS (SELECT *, route IN ('safety_boundary', 'diagnostic_boundary', 'intervention_advice', 'risk_info') OR has_low OR has_research AS guardrail, route IN ('safety_boundary', 'diagnostic_boundary') AS boundary,
            route NOT IN ('safety_boundary', 'diagnostic_boundary', 'intervention_advice', 'risk_info') AND NOT has_low AND NOT has_research AS certainty FROM routed)
        SELECT doc_id, route, CASE WHEN boundary THEN 'guardrailed_answer' WHEN has_research THEN 'evidence_answer_with_research_boundary' WHEN guardrail THEN 'guardrailed_answer' ELSE 'evidence_answer' END AS answer_mode, guardrail, has_research AS research_boundary, certainty,
        array_to_string(list_sort(list_concat(CASE route WHEN 'diagnostic_boundary' THEN ['diagnosis_from_single_symptom', 'questionnaire_as_diagnosis'] WHEN 'safety_boundary' THEN ['cure_claim', 'direct_medication_advice', 'certain_effectiveness_claim']
            WHEN 'intervention_advice' THEN ['one_size_fits_all_intervention', 'certain_effectiveness_claim'] ELSE []::VARCHAR[] END, CASE WHEN certainty THEN []::VARCHAR[] ELSE ['clinical_certainty'] END)), '|') AS forbidden FROM p""",
    "followup_decision": f"WITH {_INSPECTED}, n AS (SELECT *, n_contexts < 3 AND n_relations = 0 AS needs_more FROM routed) SELECT doc_id, route, needs_more, needs_more OR (route IN ('safety_boundary', 'diagnostic_boundary', 'intervention_advice') AND (n_relations = 0 OR n_entities = 0)) AS follow_up FROM n",
    "term_presence_checks": f"WITH {_CHECKED} SELECT conv_id, turn, answer_present, retrieved_context, retrieved_graph, expected_term_seen, answer_cited, guardrail_ok, no_clinical_overstatement, ok FROM judged",
    "eval_summary": f"WITH {_CHECKED} SELECT category, count(*)::BIGINT AS total, (count(*) FILTER (WHERE ok))::BIGINT AS n_ok, (count(*) FILTER (WHERE answer_cited))::BIGINT AS n_answer_cited, (count(*) FILTER (WHERE expected_term_seen))::BIGINT AS n_expected_term_seen, (count(*) FILTER (WHERE retrieved_graph))::BIGINT AS n_retrieved_graph FROM judged GROUP BY 1",
    "compare_delta": f"""WITH {_CHECKED}, b AS (SELECT conv_id, turn // 2 AS pair, ok, retrieved_graph AS g, length(answer) AS n FROM judged WHERE turn % 2 = 0), a AS (SELECT conv_id, turn // 2 AS pair, ok, retrieved_graph AS g, length(answer) AS n FROM judged WHERE turn % 2 = 1)
        SELECT CASE WHEN NOT b.ok AND a.ok THEN 'agent_win' WHEN b.ok AND NOT a.ok THEN 'agent_regression' WHEN NOT b.g AND a.g THEN 'agent_win' WHEN b.g AND NOT a.g THEN 'agent_regression' WHEN a.n > b.n THEN 'agent_gain' WHEN a.n < b.n THEN 'agent_loss' ELSE 'tie' END AS delta, count(*)::BIGINT AS n
        FROM b JOIN a ON b.conv_id = a.conv_id AND b.pair = a.pair GROUP BY 1""",
    "latency_summary": f"WITH {_TIMED} SELECT * FROM latencies",
    "agent_gate": f"WITH {_TIMED} SELECT a.model, a.profile, CASE WHEN s.p50 > 0 THEN (a.p50 - s.p50) / s.p50 END AS overhead, a.successes >= s.successes AND a.passes >= s.passes AND s.p50 > 0 AND (a.p50 - s.p50) / s.p50 <= 0.2 AS passed FROM latencies a JOIN latencies s ON a.model = s.model AND a.profile = s.profile AND a.pipeline = 'agent' AND s.pipeline = 'standard'",
    "benchmark_grid": f"WITH {_TIMED} SELECT * FROM (SELECT DISTINCT model FROM timed), (SELECT DISTINCT profile FROM timed), (SELECT DISTINCT pipeline FROM timed), (SELECT unnest(range(3)) AS repeat)",
    "csv_validate": "SELECT * FROM (SELECT 'category' AS column, count(*)::BIGINT AS n FROM conversations WHERE turn % 5 = 0 OR trim(coalesce(role, '')) = '' UNION ALL SELECT 'query', count(*) FROM conversations WHERE trim(coalesce(text, '')) = '') WHERE n > 0",
    "return_merge": "WITH o AS (SELECT conv_id AS id, text FROM conversations WHERE turn = 0), n AS (SELECT conv_id + turn * 7 AS id, min(text) AS text FROM conversations WHERE turn <= 1 GROUP BY 1) SELECT id, length(text)::BIGINT AS n FROM (SELECT * FROM o UNION ALL SELECT * FROM n WHERE id NOT IN (SELECT id FROM o))",
    "doc_with_catalog": "SELECT doc_id, n_chars, coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic FROM documents LEFT JOIN labels USING (doc_id)",
    "allow_list_filter": "SELECT 'listed' AS kind, count(*)::BIGINT AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) UNION ALL SELECT 'no list', count(*)::BIGINT FROM documents",
    "doc_coverage": "SELECT count(*)::BIGINT AS n_expected, (count(*) FILTER (WHERE hit))::BIGINT AS n_found, (count(*) FILTER (WHERE hit))::DOUBLE / count(*) AS coverage FROM (SELECT DISTINCT doc_id, doc_id IN (SELECT conv_id FROM conversations) AS hit FROM documents)",
    "most_common_names": "SELECT p_brand, n FROM (SELECT p_brand, count(*)::BIGINT AS n, min(p_partkey) AS f FROM part GROUP BY 1) ORDER BY n DESC, f LIMIT 10",
    "shuffled_head": "SELECT doc_id, source FROM documents ORDER BY sha1('42:' || doc_id), doc_id LIMIT 25",
    "question_selection": "SELECT conv_id AS id, length(text)::BIGINT AS n FROM conversations WHERE turn = 0 AND conv_id % 3 = 0 AND conv_id < 200 ORDER BY conv_id LIMIT 20",
    "query_variants": r"""WITH k AS (SELECT conv_id, turn, text, list_filter(string_split(text, ' ')[2:13], lambda w: w <> '' AND lower(w) NOT IN ('asd', 'autism')) AS s FROM conversations),
        v AS (SELECT conv_id, turn, CASE WHEN len(s) > 0 THEN [text, left(trim(regexp_replace(array_to_string(s, ' '), '\s+', ' ', 'g')), 220), left(trim(regexp_replace(array_to_string(list_concat([text], s[1:8]), ' '), '\s+', ' ', 'g')), 220)] ELSE [text] END AS v FROM k),
        e AS (SELECT conv_id, turn, unnest(v) AS x, unnest(range(len(v))) AS i FROM v),
        f AS (SELECT *, lower(trim(regexp_replace(x, '\s+', ' ', 'g'))) AS key, row_number() OVER (PARTITION BY conv_id, turn, lower(trim(regexp_replace(x, '\s+', ' ', 'g'))) ORDER BY i) AS p FROM e)
        SELECT conv_id, turn, coalesce(string_agg(x, '|' ORDER BY i) FILTER (WHERE p = 1 AND key <> ''), '') AS variants FROM f GROUP BY conv_id, turn""",
    "governance_candidates": f"WITH {_MATCHED} SELECT entity_id, count(DISTINCT query_id)::BIGINT AS query_count, array_to_string(list_sort(list(DISTINCT query_id)), '|') AS query_ids FROM matched GROUP BY entity_id ORDER BY query_count DESC, entity_id LIMIT 100",
    "entity_evidence_rank": f"""WITH {_GRAPH}, {_SUPPORTS}, {_EVIDENCE}, top AS MATERIALIZED (SELECT entity_id, row_number() OVER (ORDER BY source_chunk_count DESC, entity_id) AS rank FROM entities WHERE type = 'Condition' ORDER BY source_chunk_count DESC, entity_id LIMIT 20)
        SELECT DISTINCT rank, entity_id, evidence_id, chunk_id FROM top JOIN relations ON src_id = entity_id JOIN supports USING (relation_id) JOIN evidence USING (evidence_id) ORDER BY rank, entity_id, evidence_id LIMIT 50""",
    "relation_evidence_trace": f"WITH {_GRAPH}, {_SUPPORTS}, {_EVIDENCE}, top AS MATERIALIZED (SELECT relation_id FROM relations WHERE relation_type = 'MEASURED_BY' ORDER BY support_count DESC, confidence DESC, relation_id LIMIT 1) SELECT relation_id, evidence_id, chunk_id FROM top JOIN supports USING (relation_id) JOIN evidence USING (evidence_id)",
    "normalized_entities": rf"""WITH m AS (SELECT p_brand AS type, split_part(p_name, ' ', 1) AS name, {_KEY.format("split_part(p_name, ' ', 1)")} AS key, string_split(lower(p_type), ' ') AS syn, p_type AS d, p_size AS c FROM part),
        n AS (SELECT type, key, name, count(*) AS n FROM m GROUP BY ALL), b AS (SELECT type, key, arg_min(name, (-n, length(name), name)) AS name, sum(n)::BIGINT AS n_mentions, count(*)::BIGINT AS n_names FROM n GROUP BY ALL),
        t AS (SELECT type, key, arg_min(d, (-n, length(d), d)) AS description FROM (SELECT type, key, d, count(*) AS n FROM m GROUP BY ALL) GROUP BY ALL),
        s AS (SELECT type, key, count(DISTINCT c)::BIGINT AS source_chunk_count, count(DISTINCT c % 7)::BIGINT AS source_doc_count FROM m GROUP BY ALL),
        w AS (SELECT type, key, array_to_string(list_sort(list(DISTINCT x)), '|') AS synonyms FROM (SELECT type, key, unnest(list_concat([name], syn)) AS x FROM m) GROUP BY ALL)
        SELECT * FROM b JOIN t USING (type, key) JOIN s USING (type, key) JOIN w USING (type, key)""",
    "alias_candidate_merge": """WITH o AS (SELECT p_brand AS entity_name, 's1' AS student_id, min(p_type) AS aliases FROM part WHERE p_partkey % 5 = 0 AND p_brand < 'Brand#3' GROUP BY 1)
        SELECT * FROM o UNION ALL SELECT p_brand, 's1', p_brand || ';' || replace(arg_min(p_type, p_partkey), ' ', ';') FROM part WHERE p_brand NOT IN (SELECT entity_name FROM o) GROUP BY 1""",
}
