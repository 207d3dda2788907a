"""DuckDB SQL for the queries that SQL can express; the same rows as the operators give."""

_LINE_KEY = r"""translate(regexp_replace(line, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"""

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

LINES = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM split),
keyed AS (SELECT doc_id, line, pos, {_LINE_KEY} AS key FROM lines),
heavy AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
    SELECT keyed.doc_id, line, pos, heavy.last IS NOT NULL AND keyed.doc_id < heavy.last AS dropped
    FROM keyed LEFT JOIN heavy ON keyed.key = heavy.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE dropped))::BIGINT AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

DECONTAMINATION = f"""
WITH item_words AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (
    SELECT item_id, i AS place, w[i : i + least(len(w), 13) - 1] AS win
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(win) AS size FROM windows),
doc_words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
places AS (
    SELECT doc_id, i, size, w[i : i + size - 1] AS win
    FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc_words, sizes WHERE len(w) >= size)),
found AS (SELECT doc_id, item_id, i, place, size FROM places JOIN windows USING (win)),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS pos FROM found) GROUP BY doc_id),
runs AS (
    SELECT doc_id, item_id, size, i - place AS way, i - row_number() OVER (PARTITION BY doc_id, item_id, i - place ORDER BY i) AS run FROM found),
long AS (SELECT doc_id, max(n) AS longest FROM (SELECT doc_id, max(size) + count(*) - 1 AS n FROM runs GROUP BY doc_id, item_id, way, run) GROUP BY doc_id),
items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names
    FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated,
    coalesce(longest, 0)::BIGINT AS longest_match
FROM doc_words LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN long USING (doc_id)
"""

URLS = r"""
WITH rest AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS r FROM pages),
parts AS (
    SELECT page_id, translate(regexp_extract(coalesce(r, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(r, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
rules(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fits AS (
    SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
    FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT parts.page_id, host, path, rule, coalesce(fits.verdict,
    CASE WHEN list_has_any(string_split(host, '.'), ['spam-farm', 'cheap-pills', 'casino', 'adult', 'malware']) THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN fits USING (page_id)
"""

SUBSTRINGS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(length(h) // 2 - 99)) AS i FROM d WHERE length(h) >= 200)),
again AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
marked AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 100, true) AS opens FROM again),
numbered AS (SELECT doc_id, i, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
runs AS (SELECT doc_id, min(i) AS start, max(i) + 100 AS stop FROM numbered GROUP BY doc_id, run),
ends AS (SELECT doc_id, start, stop FROM runs UNION ALL SELECT doc_id, length(h) // 2, NULL FROM d),
pieces AS (SELECT doc_id, start, stop, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY start, stop NULLS LAST), 0) AS begin FROM ends),
kept AS (
    SELECT p.doc_id, sum(coalesce(stop - start, 0)) AS n_removed, count(stop) AS n_spans, string_agg(substr(h, 2 * begin + 1, 2 * (start - begin)), '' ORDER BY start, stop NULLS LAST) AS k
    FROM pieces p JOIN d ON p.doc_id = d.doc_id GROUP BY p.doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, n_removed::BIGINT AS n_removed, n_spans::BIGINT AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept ON d.doc_id = kept.doc_id
"""

NEAR = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, hash(w[i : i + 4]) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * pairs.n >= 75 * (x.n + y.n - pairs.n)),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM ways UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a),
least AS (SELECT a AS doc_id, min(b) AS other FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(other, w.doc_id)) AS component_id, w.doc_id <= coalesce(other, w.doc_id) AS kept
FROM w LEFT JOIN sizes ON w.doc_id = sizes.doc_id LEFT JOIN least ON w.doc_id = least.doc_id
"""

#: CRC-32 of a list of bytes, by its table of 256 remainders.
_CRC_TABLE = """crc_table AS (SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)))"""


def _bytes(text: str) -> str:
    return f"list_transform(range(octet_length(encode({text}))), lambda k: ('0x' || substr(hex(encode({text})), 2 * k + 1, 2))::BIGINT)"


def _crc(bytes_: str) -> str:
    return f"xor(list_reduce([4294967295] || {bytes_}, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)"


_PLAIN = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

PERIODIC = f"""
WITH {_CRC_TABLE},
hashed AS (SELECT doc_id, w, len(w) AS n, {_crc('b')} AS h FROM (SELECT doc_id, {_PLAIN} AS w, {_bytes('doc_id::VARCHAR')} AS b FROM documents), crc_table),
placed AS (SELECT *, h // 10 % n AS a, 1 + (n - h // 10 % n) // (3 + h // 10 % 8) AS p FROM hashed WHERE n > 0),
seq AS (
    SELECT doc_id, i, n, w[1 + CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % p ELSE i END] AS word
    FROM (SELECT *, unnest(range(n)) AS i FROM placed)),
matches AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM seq x JOIN seq y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND y.i - x.i <= x.n // 4),
numbered AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM matches),
islands AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM numbered GROUP BY doc_id, q, island HAVING count(*) >= greatest(6, 4 * q) - q),
runs AS (
    SELECT * FROM islands x WHERE NOT EXISTS (
        FROM islands y WHERE x.doc_id = y.doc_id AND y.q < x.q AND x.q % y.q = 0 AND y.start <= x.start AND y.start + y.length >= x.start + x.length)),
listed AS (
    SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines FROM runs GROUP BY doc_id),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length / q DESC, start, q) = 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM seq ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT h.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, q::BIGINT AS period, (1000 * length // q)::BIGINT AS exponent_milli,
    sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256, n::BIGINT AS n_words
FROM hashed h LEFT JOIN listed ON h.doc_id = listed.doc_id LEFT JOIN best ON h.doc_id = best.doc_id LEFT JOIN kept ON h.doc_id = kept.doc_id
"""

RESAMPLING = f"""
WITH {_CRC_TABLE},
texts AS (
    SELECT 'd' AS side, row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents UNION ALL SELECT 'b', 0, NULL, {_WORDS} FROM benchmark),
features AS (
    SELECT side, r, array_to_string(w[i : i + n - 1], ' ') AS f, count(*) AS c
    FROM (SELECT side, r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM texts, (VALUES (1), (2), (3)) sizes(n) WHERE len(w) >= n) GROUP BY ALL),
every AS (SELECT f, {_bytes('f')} AS b FROM (SELECT DISTINCT f FROM features)),
hashed AS (SELECT f, {_crc('b')} % 10000 AS bucket FROM every, crc_table),
dealt AS (SELECT side, r, bucket, sum(c) AS c FROM features JOIN hashed USING (f) GROUP BY ALL),
sums AS (SELECT coalesce(sum(c) FILTER (side = 'd'), 0) AS s_all, coalesce(sum(c) FILTER (side = 'b'), 0) AS t_all FROM dealt),
buckets AS (SELECT bucket, coalesce(sum(c) FILTER (side = 'd'), 0) AS s, coalesce(sum(c) FILTER (side = 'b'), 0) AS t FROM dealt GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS gain FROM buckets, sums),
weights AS (SELECT r, sum(c) AS n_features, sum(c * gain) AS weight FROM dealt JOIN gains USING (bucket) WHERE side = 'd' GROUP BY r),
scored AS (
    SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
    FROM texts LEFT JOIN weights USING (r) WHERE side = 'd'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS k, count(*) FILTER (n_words >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score,
    CASE WHEN n_words >= 20 AND k <= 5 * n // 100 THEN k END::BIGINT AS rank, n_words::BIGINT AS n_words FROM ranked
"""


def _perplexity(order: int = 4, scale: int = 65536) -> str:
    """The Kneser-Ney model order by order, and scores by the other half's model, shorter n-grams where longer ones are unknown."""
    k = "lang, half"
    model = [f"t{order} AS MATERIALIZED (SELECT {k}, g, sum(c) AS n FROM grams GROUP BY ALL)"]
    model += [f"t{m} AS MATERIALIZED (SELECT {k}, substr(g, 2) AS g, count(*) AS n FROM t{m + 1} GROUP BY ALL)" for m in range(order - 1, 0, -1)]
    model += [f"p0 AS (SELECT {k}, '' AS g, 1.0::DOUBLE / (count(*) + 1) AS p FROM t1 GROUP BY ALL)"]
    for m in range(1, order + 1):
        rule = lambda i: f"(CASE WHEN n{i} > 0 AND n{i + 1} > 0 THEN {i} - {i + 1} * (n1::DOUBLE / (n1 + 2 * n2)) * n{i + 1} / n{i} END)"
        discount = lambda i: f"(CASE WHEN {rule(i)} BETWEEN 0.01 AND {i} THEN {rule(i)} ELSE {i / 2} END)::DOUBLE AS d{i}"
        model += [
            f"n{m} AS (SELECT {k}, {', '.join(f'count(*) FILTER (n = {i}) AS n{i}' for i in range(1, 5))} FROM t{m} GROUP BY ALL)",
            f"d{m} AS (SELECT {k}, {', '.join(map(discount, (1, 2, 3)))} FROM n{m})",
            f"o{m} AS MATERIALIZED (SELECT t.lang, t.half, g, left(g, {m - 1}) AS h, n, CASE n WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END AS off FROM t{m} t JOIN d{m} d ON t.lang = d.lang AND t.half = d.half)",
            f"c{m} AS MATERIALIZED (SELECT {k}, h, sum(n) AS total, sum(off) / sum(n) AS rest, round(ln(sum(off) / sum(n)) * {scale})::BIGINT AS v FROM o{m} GROUP BY ALL)",
            f"p{m} AS MATERIALIZED (SELECT o.lang, o.half, o.g, (o.n - off) / total + rest * q.p AS p FROM o{m} o JOIN c{m} c ON o.lang = c.lang AND o.half = c.half AND o.h = c.h "
            f"JOIN p{m - 1} q ON o.lang = q.lang AND o.half = q.half AND substr(o.g, 2) = q.g)",
            f"l{m} AS (SELECT {k}, g, round(ln(p) * {scale})::BIGINT AS v FROM p{m})",
        ]
    model += [f"unknown AS (SELECT c1.lang, c1.half, round(ln(rest * p) * {scale})::BIGINT AS v FROM c1 JOIN p0 ON c1.lang = p0.lang AND c1.half = p0.half)"]
    value, joins = f"coalesce(unknown.v, {-scale})", []
    for m in range(1, order + 1):
        other = lambda name: f"{name}.lang = x.lang AND {name}.half = 1 - x.half"
        part = f"substr(x.g, {order - m + 1})"
        value = f"coalesce(l{m}.v, {f'coalesce(c{m}.v, 0) + ' * (m > 1)}{value})"
        joins += [f"LEFT JOIN l{m} ON {other(f'l{m}')} AND l{m}.g = {part}"] + [f"LEFT JOIN c{m} ON {other(f'c{m}')} AND c{m}.h = left({part}, {m - 1})"] * (m > 1)
    joins += [f"LEFT JOIN unknown ON {other('unknown')}"]
    return f"""
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, (left(md5(doc_id::VARCHAR), 1) >= '8')::INT AS half, {_PLAIN} AS w FROM documents),
streams AS (SELECT r, lang, half, ' ' || array_to_string(w, ' ') || ' ' AS s FROM rows WHERE len(w) > 0),
letters AS (SELECT r, lang, half, unnest(string_split(s, '')) AS x, unnest(range(length(s))) AS i FROM streams),
near AS (SELECT r, lang, half, {" || ".join(["x", *(f"lead(x, {j}) OVER next" for j in range(1, order))])} AS g FROM letters WINDOW next AS (PARTITION BY r ORDER BY i)),
grams AS MATERIALIZED (SELECT r, lang, half, g, count(*) AS c FROM near WHERE g IS NOT NULL GROUP BY ALL),
{', '.join(model)},
known AS (SELECT x.lang, x.half, x.g, {value} AS v FROM (SELECT DISTINCT lang, half, g FROM grams) x {' '.join(joins)}),
scores AS (SELECT r, sum(c) AS n_grams, (-1000 * sum(c * v)) // ({scale} * sum(c)) AS surprise FROM grams JOIN known USING (lang, half, g) GROUP BY r),
counted AS (SELECT lang, surprise, count(*) AS n FROM scores JOIN rows USING (r) GROUP BY ALL),
upto AS (SELECT lang, surprise, sum(n) OVER (PARTITION BY lang ORDER BY surprise) AS upto, sum(n) OVER (PARTITION BY lang) AS every FROM counted),
bands AS (SELECT lang, min(surprise) FILTER (4 * upto >= every) AS q1, min(surprise) FILTER (4 * upto >= 3 * every) AS q3 FROM upto GROUP BY lang),
terms AS (SELECT r, unnest(w) AS x, unnest(range(len(w))) AS i FROM rows),
fives AS (SELECT r, i, {" || ' ' || ".join(["x", *(f"lead(x, {j}) OVER next" for j in range(1, 5))])} AS f FROM terms WINDOW next AS (PARTITION BY r ORDER BY i)),
again AS (SELECT r, i FROM fives WHERE f IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, f) > 1),
repeats AS (SELECT r, count(DISTINCT place) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 5)) AS place FROM again) GROUP BY r),
lines AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM rows) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
based AS (
    SELECT rows.*, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, surprise::BIGINT AS surprise, n_grams
    FROM rows LEFT JOIN lines USING (r) LEFT JOIN repeats USING (r) LEFT JOIN scores USING (r)),
judged AS (
    SELECT b.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
        coalesce(surprise BETWEEN q1 - 3 * (q3 - q1) - 6000 / sqrt(n_grams) AND q3 + 3 * (q3 - q1) + 6000 / sqrt(n_grams), true) AS inside
    FROM based b LEFT JOIN bands ON b.lang = bands.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND inside AS kept, surprise FROM judged
"""


ORACLES = {
    "op1_substring_dedup": SUBSTRINGS, "op4_near_dedup": NEAR, "op5_decontamination": DECONTAMINATION, "op7_line_dedup": LINES, "op10_url_filter": URLS,
    "op11_periodic_runs": PERIODIC, "op12_resampling": RESAMPLING, "op13_quality_rules": _perplexity(),
}
