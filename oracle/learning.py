"""Oracle SQL of retrieval, evaluation and splits."""

from __future__ import annotations

from hazlake.functions.lookups import CLASS_NAMES, LEVELS
from hazlake.operators.similar import METHOD
from hazlake.plans.derived import VIEWS
from oracle.assessment import ACTIONS, analysed
from oracle.parts import NORMAL, RAW, case_map, clean, q, round_even, strip, terms_list, values
from oracle.workflow import REPORT, cid


def vocab_ctes(size: int) -> str:
    """CTEs ``dw(doc_id, term, w)`` with unit-length document weights, and ``idf``."""
    return f"""docs AS (SELECT doc_id, lang, source, {clean('text')} AS body FROM documents),
ww AS MATERIALIZED (SELECT doc_id, {terms_list('body')} AS w FROM docs),
tt AS (SELECT doc_id, unnest(w) AS term FROM ww UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM ww),
tc AS MATERIALIZED (SELECT doc_id, term, count(*) AS c FROM tt GROUP BY doc_id, term),
vocab AS MATERIALIZED (SELECT term, count(*) AS df FROM tc GROUP BY term ORDER BY sum(c) DESC, term LIMIT {size}),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM documents))::DOUBLE / (1 + df)::DOUBLE) + 1 AS idf FROM vocab),
rw AS (SELECT doc_id, term, (1 + ln(c)) * idf AS w FROM tc JOIN idf USING (term)),
dw AS MATERIALIZED (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM rw)"""


PAIRS = f"pairs AS ({VIEWS['eval_pairs']})"
GRID = values([(lv, i) for i, lv in enumerate(LEVELS)])
CLASSES = f"""{PAIRS}, g(label, pos) AS (SELECT * FROM {GRID}),
k AS (SELECT label, count(*) FILTER (WHERE y_true = label AND y_pred = label) AS tp, count(*) FILTER (WHERE y_true <> label AND y_pred = label) AS fp,
  count(*) FILTER (WHERE y_true = label AND y_pred <> label) AS fn, count(*) FILTER (WHERE y_true <> label AND y_pred <> label) AS tn FROM g CROSS JOIN pairs GROUP BY label),
pr AS (SELECT *, tp + fn AS support, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp)::DOUBLE ELSE 0.0::DOUBLE END AS p,
  CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn)::DOUBLE ELSE 0.0::DOUBLE END AS r FROM k),
ro AS (SELECT *, {round_even('p', 4)} AS p4, {round_even('r', 4)} AS r4 FROM pr),
sc AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0::DOUBLE END AS f, CASE WHEN p4 + r4 > 0 THEN 2 * p4 * r4 / (p4 + r4) ELSE 0.0::DOUBLE END AS f4 FROM ro)"""


def per_class(f: str) -> str:
    return f"""WITH {CLASSES} SELECT label, {case_map(CLASS_NAMES, 'label', 'NULL')} AS name, tp AS true_positives, fp AS false_positives, fn AS false_negatives,
  tn AS true_negatives, p4 AS precision, r4 AS recall, {round_even(f, 4)} AS f1_score, support, label IN ('IV', 'V') AS is_safety_critical FROM sc"""


UNIQUE = f"""{NORMAL}, uniq AS (SELECT * FROM reports QUALIFY row_number() OVER (PARTITION BY cleaned_text ORDER BY severity_rank DESC, source_dataset, row_index) = 1),
rk AS (SELECT row_index, severity_level, row_number() OVER (PARTITION BY severity_level ORDER BY sha256('42|' || cleaned_text)) AS r FROM uniq)"""


def quota(name: str, counts: str, draws: str) -> str:
    """CTE ``name(severity_level, k)``: share of the draws per class, rest by largest remainder."""
    return f"""{name}_x AS (SELECT severity_level, n::DOUBLE * {draws} / (SELECT sum(n) FROM {counts}) AS e FROM {counts}),
{name}_r AS (SELECT severity_level, floor(e) AS f, row_number() OVER (ORDER BY floor(e) - e, severity_level) AS o, {draws} - sum(floor(e)) OVER () AS rest FROM {name}_x),
{name} AS (SELECT severity_level, CAST(f + CASE WHEN o <= rest THEN 1 ELSE 0 END AS BIGINT) AS k FROM {name}_r)"""


BY_ROW = f"""{NORMAL}, rk AS (SELECT cleaned_text, severity_level, row_number() OVER (PARTITION BY severity_level ORDER BY sha256('42|' || row_index || '|' || cleaned_text)) AS r FROM reports),
n AS (SELECT severity_level, count(*) AS n FROM rk GROUP BY 1),
{quota('t', 'n', '(SELECT ceil(0.15::DOUBLE * sum(n)) FROM n)')},
n2 AS (SELECT severity_level, n - k AS n FROM n JOIN t USING (severity_level)),
{quota('v', 'n2', '(SELECT ceil(0.15::DOUBLE / (1 - 0.15::DOUBLE) * sum(n)) FROM n2)')},
sides AS (SELECT cleaned_text, CASE WHEN r <= t.k THEN 'test' WHEN r <= t.k + v.k THEN 'val' ELSE 'train' END AS split
  FROM rk JOIN t USING (severity_level) JOIN v USING (severity_level))"""
SPLIT = f"""{UNIQUE}, n AS (SELECT severity_level, count(*) AS n FROM rk GROUP BY 1),
{quota('t', 'n', '(SELECT ceil(0.15::DOUBLE * sum(n)) FROM n)')},
n2 AS (SELECT severity_level, n - k AS n FROM n JOIN t USING (severity_level)),
{quota('v', 'n2', '(SELECT ceil(0.15::DOUBLE / (1 - 0.15::DOUBLE) * sum(n)) FROM n2)')},
halves AS (SELECT row_index, severity_level, CASE WHEN r <= t.k THEN 'test' WHEN r <= t.k + v.k THEN 'val' ELSE 'train' END AS split
  FROM rk JOIN t USING (severity_level) JOIN v USING (severity_level)),
told AS (SELECT row_index, severity_level, split, 'Description: ' || cleaned_text || ' Industry Sector: ' || industry_sector || ' Worker Type: ' || worker_type ||
  ' Gender: ' || gender AS txt FROM halves JOIN uniq USING (row_index, severity_level))"""


def bayes_ctes(models: str, labels: tuple = LEVELS) -> str:
    """CTE ``proba(m, row_index, part, label, p)`` from ``rows(row_index, severity_level, part, txt)``; model m never sees part m."""
    return f"""m(m) AS (VALUES {models}), lv(label) AS (SELECT label FROM {GRID} AS g(label, pos)),
ww AS MATERIALIZED (SELECT row_index, part, severity_level AS label, {terms_list('txt')} AS w FROM rows),
tt AS (SELECT row_index, part, label, unnest(w) AS term FROM ww UNION ALL
  SELECT row_index, part, label, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM ww),
tc AS MATERIALIZED (SELECT row_index, part, label, term, count(*) AS c FROM tt GROUP BY ALL),
sz AS (SELECT m, count(*) AS n FROM m JOIN rows ON part <> m GROUP BY m),
df AS MATERIALIZED (SELECT m, term, count(*) AS df FROM m JOIN tc ON part <> m GROUP BY ALL),
xx AS (SELECT m, row_index, part, label, term, c * (ln((1 + n)::DOUBLE / (1 + df)::DOUBLE) + 1) AS x FROM tc JOIN df USING (term) JOIN sz USING (m)),
xw AS MATERIALIZED (SELECT *, x / sqrt(sum(x * x) OVER (PARTITION BY m, row_index)) AS w FROM xx),
cs AS MATERIALIZED (SELECT m, label, term, sum(w) AS s FROM xw WHERE part <> m GROUP BY ALL),
vs AS (SELECT m, count(*) AS v FROM df GROUP BY m),
tot AS (SELECT m, label, sum(s) + 0.1::DOUBLE * any_value(v) AS b FROM cs JOIN vs USING (m) GROUP BY m, label),
pri AS (SELECT m, severity_level AS label, ln(count(*)::DOUBLE / any_value(n)::DOUBLE) AS pr FROM m JOIN rows ON part <> m JOIN sz USING (m) GROUP BY m, severity_level),
ll AS (SELECT xw.m, row_index, tot.label, sum(w * (ln(coalesce(s, 0.0::DOUBLE) + 0.1::DOUBLE) - ln(b))) AS l
  FROM xw JOIN tot ON tot.m = xw.m LEFT JOIN cs ON cs.m = xw.m AND cs.label = tot.label AND cs.term = xw.term GROUP BY ALL),
jl AS (SELECT pri.m, rows.row_index, part, severity_level, pri.label, pr + coalesce(l, 0.0::DOUBLE) AS j
  FROM rows CROSS JOIN pri LEFT JOIN ll ON ll.m = pri.m AND ll.row_index = rows.row_index AND ll.label = pri.label),
ex AS (SELECT *, exp(j - max(j) OVER (PARTITION BY m, row_index)) AS e FROM jl),
proba AS (SELECT m, row_index, part, severity_level, label, e / sum(e) OVER (PARTITION BY m, row_index) AS p FROM ex),
told_level AS (SELECT m, row_index, part, severity_level, max(p) AS p, first(label ORDER BY p DESC, label) AS raw_level FROM proba GROUP BY ALL)"""


CV_METRICS = f"""cells AS (SELECT m, a.label, count(*) FILTER (WHERE severity_level = a.label AND raw_level = a.label)::DOUBLE AS tp,
  count(*) FILTER (WHERE severity_level <> a.label AND raw_level = a.label)::DOUBLE AS fp, count(*) FILTER (WHERE severity_level = a.label AND raw_level <> a.label)::DOUBLE AS fn
  FROM pred CROSS JOIN lv a GROUP BY m, a.label),
sc AS (SELECT *, tp + fn AS sup, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM cells WHERE tp + fn + fp > 0),
f1 AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM sc),
fold AS (SELECT m, sum(tp) / sum(sup) AS accuracy, avg(f) AS macro_f1_score, sum(f * sup) / sum(sup) AS weighted_f1_score, avg(p) AS macro_precision, avg(r) AS macro_recall FROM f1 GROUP BY m),
mean AS (SELECT {', '.join(f'avg({c}) AS {c}' for c in ('accuracy', 'macro_f1_score', 'weighted_f1_score', 'macro_precision', 'macro_recall'))} FROM fold)"""

ASKED = f"""{SPLIT.removeprefix(RAW + ',')}, rows AS (
  SELECT -1 - row_index AS row_index, severity_level, 1 AS part, txt FROM told WHERE split <> 'test'
  UNION ALL SELECT row_number, NULL, 0, 'Description: ' || report_text || ' Industry Sector: ' || sector || ' Worker Type: ' || coalesce({strip('worker_type')}, 'Employee') ||
    ' Gender: ' || coalesce({strip('"Gender"')}, 'Male') FROM accepted JOIN raw ON raw.row_index + 1 = row_number),
{bayes_ctes('(0)')},
asked AS MATERIALIZED (SELECT row_index AS row_number, raw_level, {round_even('p', 3)} AS raw_confidence FROM told_level WHERE part = 0)"""
BATCH = analysed("(SELECT raw_level FROM asked WHERE asked.row_number = a.row_number)", "(SELECT raw_confidence FROM asked WHERE asked.row_number = a.row_number)", ASKED)

ORACLES = {
    "batch_analysis": f"""{BATCH}, {ACTIONS}, acted AS (SELECT row_number, count(*) AS actions, min(control) FILTER (WHERE position = 1) AS control FROM numbered GROUP BY row_number)
SELECT s.row_number, {REPORT.replace('row_number', 's.row_number')} AS report_id, raw_level, raw_confidence, predicted_level, confidence, CAST(score AS BIGINT) AS score, tier,
  CAST(severity_part AS BIGINT) AS severity_part, labels AS precursors, coalesce(actions, 0) AS actions,
  CASE WHEN tier IN ('HIGH', 'CRITICAL') THEN {cid('ALT-', REPORT.replace('row_number', 's.row_number'), 'report_text', "'alert'")} END AS alert_id,
  CASE WHEN tier IN ('HIGH', 'CRITICAL') THEN control END AS immediate_action
FROM scored s JOIN asked USING (row_number) LEFT JOIN acted USING (row_number)""",
    "severity_predictions": f"""WITH {SPLIT}, rows AS (SELECT *, CASE WHEN split = 'test' THEN 0 ELSE 1 END AS part FROM told), {bayes_ctes('(0)')}
SELECT t.row_index, split, t.severity_level, raw_level, {round_even('t.p', 3)} AS raw_confidence,
  {', '.join(f"(SELECT {round_even('p', 3)} FROM proba WHERE proba.row_index = t.row_index AND label = '{lv}') AS p_{lv.lower()}" for lv in LEVELS)}
FROM told_level t JOIN told USING (row_index)""",
    "bayes_cross_validation": f"""WITH {SPLIT}, rows AS (
  SELECT row_index, severity_level, txt, CAST(row_number() OVER (PARTITION BY severity_level ORDER BY sha256('42|' || txt)) % 5 AS INT) AS part FROM told WHERE split <> 'test'),
{bayes_ctes('(0), (1), (2), (3), (4)')}, pred AS (SELECT * FROM told_level WHERE part = m), {CV_METRICS}
SELECT 'Naive Bayes' AS model, {', '.join(f"{round_even(c, 4)} AS dev_cv_{c}" for c in ('accuracy', 'macro_f1_score', 'weighted_f1_score', 'macro_precision', 'macro_recall'))} FROM mean""",
    "tfidf_weights": f"WITH {vocab_ctes(20_000)} SELECT doc_id, term, {round_even('w', 6)} AS weight FROM dw",
    "similar_incidents": f"""WITH {vocab_ctes(20000)},
qs AS (SELECT item_id, {clean('text')} AS body FROM benchmark), qw AS MATERIALIZED (SELECT item_id, {terms_list('body')} AS w FROM qs),
qt AS (SELECT item_id, unnest(w) AS term FROM qw UNION ALL SELECT item_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM qw),
qc AS (SELECT item_id, term, count(*) AS c FROM qt GROUP BY ALL), qr AS (SELECT item_id, term, (1 + ln(c)) * idf AS w FROM qc JOIN idf USING (term)),
qn AS (SELECT item_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS w FROM qr),
dots AS (SELECT item_id, doc_id, least(1.0::DOUBLE, sum(qn.w * dw.w)) AS s FROM qn JOIN dw USING (term) GROUP BY ALL),
ranked AS (SELECT *, s * 100.0::DOUBLE AS pc, row_number() OVER (PARTITION BY item_id ORDER BY {round_even('s', 6)} DESC, doc_id) AS rk FROM dots WHERE s >= 0.10)
SELECT item_id AS query_id, rk AS rank, r.doc_id, printf('INC-%04d', r.doc_id) AS source_id, {round_even('s', 4)} AS similarity_score, {round_even('pc', 2)} AS similarity_percentage,
  lang, source, {q(METHOD)} AS retrieval_method FROM ranked r JOIN docs USING (doc_id) WHERE rk <= 3""",
    "confusion_matrix": f"""WITH {PAIRS}, g(label, pos) AS (SELECT * FROM {GRID})
SELECT a.label AS y_true, b.label AS y_pred, count(pairs.doc_id) AS n FROM g a CROSS JOIN g b LEFT JOIN pairs ON y_true = a.label AND y_pred = b.label GROUP BY ALL""",
    "confusion_wide": f"WITH {PAIRS} SELECT y_true, " + ", ".join(f"count(*) FILTER (WHERE y_pred = '{lv}') AS \"{lv}\"" for lv in LEVELS) + " FROM pairs GROUP BY y_true",
    "per_class_metrics": per_class("f"),
    "per_class_report": per_class("f4"),
    "overall_metrics": f"""WITH {CLASSES}, o AS (SELECT CAST(sum(support) AS BIGINT) AS samples, sum(tp)::DOUBLE / sum(support)::DOUBLE AS a, avg(p) AS mp, avg(r) AS mr, avg(f) AS mf,
  sum(p * support) / sum(support) AS wp, sum(r * support) / sum(support) AS wr, sum(f * support) / sum(support) AS wf FROM sc WHERE support + fp > 0)
SELECT samples, {round_even('a', 6)} AS accuracy, {round_even('mp', 6)} AS macro_precision, {round_even('mr', 6)} AS macro_recall, {round_even('mf', 6)} AS macro_f1_score,
  {round_even('wp', 6)} AS weighted_precision, {round_even('wr', 6)} AS weighted_recall, {round_even('wf', 6)} AS weighted_f1_score FROM o""",
    "stratified_split": f"""WITH {UNIQUE}, n AS (SELECT severity_level, count(*) AS n FROM rk GROUP BY 1),
{quota('t', 'n', '(SELECT ceil(0.15::DOUBLE * sum(n)) FROM n)')},
n2 AS (SELECT severity_level, n - k AS n FROM n JOIN t USING (severity_level)),
{quota('v', 'n2', '(SELECT ceil(0.15::DOUBLE / (1 - 0.15::DOUBLE) * sum(n)) FROM n2)')}
SELECT row_index, severity_level, CASE WHEN r <= t.k THEN 'test' WHEN r <= t.k + v.k THEN 'val' ELSE 'train' END AS split
FROM rk JOIN t USING (severity_level) JOIN v USING (severity_level)""",
    "stratified_folds": f"WITH {UNIQUE} SELECT row_index, severity_level, CAST(r % 5 AS INT) AS fold FROM rk",
    "split_leakage": f"""WITH {SPLIT} SELECT count(*) AS leaked_texts FROM (SELECT cleaned_text FROM halves JOIN uniq USING (row_index, severity_level)
  GROUP BY cleaned_text HAVING count(DISTINCT split) > 1)""",
    "row_split_leakage": f"WITH {BY_ROW} SELECT sha256(cleaned_text) AS digest, count(DISTINCT split) AS splits FROM sides GROUP BY cleaned_text HAVING count(DISTINCT split) > 1",
    "train_test_overlap": f"WITH {BY_ROW} SELECT sha256(cleaned_text) AS digest FROM sides WHERE split = 'train' INTERSECT SELECT sha256(cleaned_text) FROM sides WHERE split = 'test'",
}
