"""DuckDB SQL for the queries that SQL can express, written from their definitions."""

from __future__ import annotations

from hazlake.llm import lines, quality

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _quality() -> str:
    rules = ", ".join(f"('{r}', {i}, CAST({c} AS DOUBLE))" for r, cs in quality.RULES.items() for i, c in enumerate(cs))
    scores = "CASE {rule} WHEN 'symbols' THEN symbols WHEN 'shouting' THEN shouting WHEN 'repetition' THEN repetition ELSE repeated_lines END"
    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
g AS (SELECT doc_id, i, w[i:i+2] AS gram FROM d, unnest(range(1, len(w) - 1)) AS r(i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, unnest([0, 1, 2]) AS s(k) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
b AS (
  SELECT d.doc_id, lang, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, length(regexp_replace(t, '[^!]', '', 'g')) AS shouts, len(l) AS n_lines
  FROM d JOIN l USING (doc_id) LEFT JOIN rep USING (doc_id)),
s AS (
  SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT} * n_words AS base_failed,
    coalesce(n_symbols / nullif(n_words, 0), 0.0) AS symbols, coalesce(shouts / nullif(n_words, 0), 0.0) AS shouting,
    coalesce(n_repeat_words / nullif(n_words, 0), 0.0) AS repetition, coalesce(n_dup_lines / nullif(n_lines, 0), 0.0) AS repeated_lines FROM b),
rules(rule, step, cut) AS (VALUES {rules}),
held AS (SELECT s.* FROM s JOIN labels ON s.doc_id = labels.doc_id WHERE quality = 1 AND NOT base_failed),
tried AS (
  SELECT lang, rule, step, cut, count(*) AS n, count(*) FILTER (WHERE {scores.format(rule='rule')} > cut) AS k
  FROM held, rules GROUP BY ALL),
strata AS (SELECT count(DISTINCT coalesce(lang, chr(0))) AS m FROM held),
tail AS (
  SELECT lang, rule, step, cut, CASE WHEN k > 0 AND k >= n * {quality.RISK} THEN 1.0 ELSE (
    SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({quality.RISK}) + (n - j) * ln(1 - {quality.RISK})))
    FROM unnest(range(0, k + 1)) AS r(j)) END AS p FROM tried),
failed AS (
  SELECT lang, rule, coalesce(min(step) FILTER (WHERE p > {quality.DELTA} / (m * {len(quality.RULES)})), 99) AS first
  FROM tail, strata GROUP BY ALL),
cuts AS (SELECT tail.lang, rule, min(cut) AS cut FROM tail JOIN failed f USING (rule) WHERE tail.lang IS NOT DISTINCT FROM f.lang AND step < first GROUP BY ALL),
bad AS (
  SELECT DISTINCT doc_id FROM s JOIN cuts ON s.lang IS NOT DISTINCT FROM cuts.lang WHERE {scores.format(rule='cuts.rule')} > cut)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM s"""


def _decontamination() -> str:
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {words} AS w FROM benchmark),
win AS (SELECT DISTINCT item, len(w[p:p + 12]) AS n, array_to_string(w[p:p + 12], ' ') AS win FROM i, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS r(p) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS win FROM d, lens, unnest(range(1, len(w) - n + 2)) AS r(p)),
hit AS (SELECT doc_id, p, n, item FROM dw JOIN win USING (n, win)),
cover AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT doc_id, p, n FROM hit), unnest(range(p, p + n)) AS r(q) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN ids USING (doc_id)"""


MINHASH = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS s FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS r(p) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id != b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, e.y FROM reach JOIN e ON e.x = reach.y)
SELECT documents.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, component_id = documents.doc_id AS kept
FROM documents JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) ON x = doc_id LEFT JOIN n ON n.doc_id = documents.doc_id"""


SUBSTRING = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
g AS MATERIALIZED (SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS h FROM d, unnest(range(1, len(w) - 48)) AS r(p)),
low AS (SELECT h, min(doc_id) AS m FROM g GROUP BY h),
gone AS (SELECT DISTINCT g.doc_id, q FROM g JOIN low ON g.h = low.h AND low.m < g.doc_id, unnest(range(p, p + 50)) AS r(q)),
w AS (SELECT doc_id, i, w[i] AS word FROM d, unnest(range(1, len(w) + 1)) AS r(i)),
kept AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM w ANTI JOIN gone ON w.doc_id = gone.doc_id AND i = q GROUP BY w.doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""


LINES = rf"""
WITH l AS (SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line FROM documents,
    unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS r(i)),
m AS MATERIALIZED (SELECT *, list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '{lines.MASK}' ELSE w END) AS t FROM l),
shape AS MATERIALIZED (SELECT len(t) AS size, t[1:{lines.DEPTH}] AS lead, t, count(DISTINCT doc_id) AS n FROM m WHERE len(t) > 0 GROUP BY ALL),
tok AS (SELECT *, t[p] AS token FROM shape, unnest(range(1, size + 1)) AS r(p)),
common AS (SELECT size, lead, p, token FROM tok GROUP BY ALL HAVING sum(n) >= {lines.MIN_DOCS} AND token != '{lines.MASK}'),
tmpl AS (SELECT size, lead, t, any_value(n) AS n, list((p, token) ORDER BY p) AS fixed FROM tok JOIN common USING (size, lead, p, token) GROUP BY size, lead, t),
drops AS (SELECT size, lead, t FROM (SELECT *, sum(n) OVER (PARTITION BY size, lead, fixed) AS docs FROM tmpl WHERE len(fixed) >= {lines.MIN_CONSTANT} * size) WHERE docs >= {lines.MIN_DOCS}),
k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS kept, count(*) FILTER (WHERE len(m.t) > 0) AS n FROM m ANTI JOIN drops ON m.t = drops.t GROUP BY doc_id),
a AS (SELECT doc_id, count(*) FILTER (WHERE len(t) > 0) AS n_lines FROM m GROUP BY doc_id)
SELECT documents.doc_id, n_lines, n_lines - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents JOIN a USING (doc_id) LEFT JOIN k USING (doc_id)"""


CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (
  SELECT *, length(role) + length(text) + 24 + length(regexp_replace(role || chr(10) || text, '[^\\]', '', 'g'))
    + (SELECT sum(len(string_split(role || chr(10) || text, c)) - 1) FROM (VALUES ('<|'), ('[INST]'), ('[/INST]'), ('<s>'), ('</s>'), ('<<SYS>>'), ('<</SYS>>'), ('<start_of_turn>'), ('<end_of_turn>'), ('<bos>'), ('<eos>')) AS v(c)) AS chars FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM n GROUP BY conv_id"""


WARC = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to FROM f"""


#: A document's checksum, bit by bit: the remainder of the reflected polynomial 0xEDB88320.
CRC32 = """xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({}, ''), lambda ch: ascii(ch)::BIGINT)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384::BIGINT))))"""


def _repair() -> str:
    """Per state the least (cost, edits) so far, written as one string, row after row; then the edits read back."""
    add = lambda s, cost, letter: f"printf('%08d', left({s}, 8)::BIGINT + {cost}) || substr({s}, 9) || '{letter}'"
    put = lambda s, cost, letter: f"CASE WHEN {s} IS NOT NULL THEN {add(s, cost, letter)} END"
    said = lambda role, s, letter, cost: f"CASE WHEN fault NOT IN ('blank', 'duplicate'){role} THEN {put(s, cost, letter)} END"
    keep = lambda ini, s: said(f" AND ini = '{ini}'", s, "K", "late")
    turn = lambda s: said("", s, "R", "3 + late")
    delete = lambda s: put(s, 4, "D")
    return rf"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
c AS MATERIALIZED (SELECT *, {CRC32.format('name')} % 20 AS f FROM k),
d AS (
  SELECT conv_id, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM c, unnest(range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copies(t)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
r AS MATERIALIZED (
  SELECT *, left(role, 1) AS ini, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 'truncated' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM o),
walk AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, '00000000' AS s0, NULL::VARCHAR AS s1, NULL::VARCHAR AS s2, NULL::VARCHAR AS s3 FROM conversations
  UNION ALL
  SELECT conv_id, i, {delete('s0')}, least({delete('s1')}, {keep('s', 's0')}),
    least({delete('s2')}, {keep('u', 's0')}, {keep('u', 's1')}, {keep('u', 's3')}, {turn('s0')}, {turn('s1')}, {turn('s3')}),
    least({delete('s3')}, {keep('a', 's2')}, {turn('s2')})
  FROM (
    SELECT w.conv_id, r.i, r.ini, r.fault, CASE r.fault WHEN 'truncated' THEN 3 ELSE 0 END AS late, s0, s1, s2, least(s3, {put('s2', 3, 'I')}) AS s3
    FROM (SELECT * REPLACE (least(s2, {put('s0', 3, 'I')}, {put('s1', 3, 'I')}, {put('s3', 3, 'I')}) AS s2) FROM walk) w
    JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1)),
last AS (SELECT conv_id, max_by(struct_pack(s0, s1, s2, s3), i) AS s FROM walk GROUP BY conv_id),
e AS (SELECT conv_id, s.s0 AS s0, least(s.s3, {put('least(s.s2, ' + put('s.s0', 3, 'I') + ', ' + put('s.s1', 3, 'I') + ')', 3, 'I')}) AS s3 FROM last),
done AS (SELECT conv_id, left(least(s0, s3), 8)::BIGINT AS cost, substr(least(s0, s3), 9) AS audit FROM e),
l AS (SELECT conv_id, p, substr(audit, p, 1) AS letter, p - len(replace(left(audit, p), 'I', '')) AS inserted, len(replace(left(audit, p), 'D', '')) AS said,
  len(replace(audit, 'D', '')) % 2 AS odd FROM done, unnest(range(1, len(audit) + 1)) AS place(p)),
lines AS (
  SELECT l.conv_id, string_agg(CASE WHEN letter = 'K' THEN r.role WHEN (said - odd) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' ||
    CASE WHEN letter = 'I' THEN '' ELSE r.text END, chr(10) ORDER BY p) AS repaired
  FROM l LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.i = p - inserted AND letter <> 'I' WHERE letter <> 'D' GROUP BY l.conv_id),
n AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT done.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, cost, audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM done LEFT JOIN lines ON lines.conv_id IS NOT DISTINCT FROM done.conv_id LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM done.conv_id"""


NEIGHBOURS = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT q.r, q.vec_id AS query_id, o.vec_id, list_distance(q.e, o.e) AS score FROM v AS q JOIN v AS o ON q.r <> o.r AND len(q.e) = len(o.e) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score, vec_id) AS rank FROM d) WHERE rank <= 10"""


ORACLES = {
    "op11_conversation_repair": _repair(),
    "op13_neighbours": NEIGHBOURS,
    "op7_warc": WARC,
    "op8_chat_formatting": CHAT,
    "op4_line_dedup": LINES,
    "op5_substring_dedup": SUBSTRING,
    "op1_decontamination": _decontamination(),
    "op10_minhash": MINHASH,
    "op6_quality_rules": _quality(),
}
