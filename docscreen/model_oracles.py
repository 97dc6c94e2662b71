"""SQL of the queries with fitted models.

Naive Bayes is written out: vocabulary, weights, class totals and posterior. For the other models
the SQL lists the rows that must come and the checks that must hold.
"""

from __future__ import annotations

import json

from docscreen import constants as C
from docscreen import model_queries as M
from docscreen.oracles import (_ANY, _AUDITED, _FOUND, _PCT, _REQUIRED, _SPLIT_CORPUS, clean, is_blank_sql, oracle,
                               terms_cte, values, vocab_cte, words)
from docscreen.plans.train import METRICS

PARTS = [*_AUDITED, *_SPLIT_CORPUS]
CLASSES = ("nc AS (SELECT label, count(*) AS n FROM tr GROUP BY 1), "
           "pi AS (SELECT label, ln(n + 1.0) - ln((SELECT sum(n) FROM nc) + (SELECT count(*) FROM nc)) AS p FROM nc)")


def _unit(name: str, terms: str) -> str:
    return (f"{name} AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM "
            f"(SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM {terms} JOIN v USING (term)))")


def naive_bayes(rows: str) -> list[str]:
    """CTEs up to ``post``: the posterior of every class for the rows (doc_id, c) of ``asked``."""
    return [
        *PARTS, f"tr AS (SELECT doc_id, label, {clean('text')} AS c FROM parts WHERE split = 'train')",
        terms_cte("t", "c", "tr", True), vocab_cte("v", "t", "tr", M.FEATURES), _unit("wt", "t"), CLASSES,
        "sums AS (SELECT label, term, sum(w) AS x FROM wt JOIN tr USING (doc_id) GROUP BY 1, 2)",
        "totals AS (SELECT label, sum(x) AS total FROM sums GROUP BY 1)",
        "theta AS (SELECT c.label, v.term, ln(coalesce(x, 0) + 1.0) - ln(coalesce(total, 0) + (SELECT count(*) FROM v)) "
        "AS h FROM nc c CROSS JOIN v LEFT JOIN sums s ON s.label = c.label AND s.term = v.term "
        "LEFT JOIN totals z ON z.label = c.label)",
        f"asked AS ({rows})", terms_cte("ta", "c", "asked", True), _unit("wa", "ta"),
        "raw_score AS (SELECT a.doc_id, p.label, p.p + coalesce(m.x, 0) AS r FROM asked a CROSS JOIN pi p LEFT JOIN "
        "(SELECT doc_id, label, sum(w * h) AS x FROM wa JOIN theta USING (term) GROUP BY 1, 2) m "
        "ON m.doc_id = a.doc_id AND m.label = p.label)",
        "post AS (SELECT doc_id, label, e / sum(e) OVER (PARTITION BY doc_id) AS q FROM "
        "(SELECT *, exp(r - max(r) OVER (PARTITION BY doc_id)) AS e FROM raw_score))",
        "best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY q DESC, label) AS k FROM post)"]


oracle("nb_fit", "SELECT b.doc_id, p.label, b.label AS prediction, round(q, 6) AS confidence FROM best b "
       "JOIN parts p USING (doc_id) WHERE k = 1",
       *naive_bayes(f"SELECT doc_id, {clean('text')} AS c FROM parts WHERE split = 'test'"))

ALL_DOCS = f"SELECT doc_id, text, {clean('text')} AS c FROM documents"


def status(min_tokens: int) -> str:
    return (f"CASE WHEN {is_blank_sql('text')} THEN 'insufficient text' WHEN c = '' THEN 'no usable text' "
            f"WHEN len({words('c')}) < {min_tokens} THEN 'too short' ELSE 'ok' END")


oracle("score_docs", f"""
SELECT doc_id, status, CASE WHEN status = 'ok' THEN prediction END AS prediction,
 CASE WHEN status = 'ok' THEN confidence END AS confidence, CASE WHEN status = 'ok' THEN top ELSE NULL END AS top
FROM (SELECT a.doc_id, {status(C.MIN_TOKENS)} AS status, b.label AS prediction, round(b.q, 6) AS confidence,
 (SELECT string_agg(label, '|' ORDER BY k) FROM best x WHERE x.doc_id = a.doc_id AND k <= 3) AS top
 FROM asked a JOIN best b ON b.doc_id = a.doc_id AND b.k = 1)""", *naive_bayes(ALL_DOCS))

oracle("analyze", f"""
SELECT doc_id, status, CASE WHEN status = 'ok' THEN label END AS predicted_role,
 CASE WHEN status = 'ok' THEN array_to_string(skills, '|') END AS skills, CASE WHEN status = 'ok' THEN
 {_PCT.format('c_role * 0.4e0 + c_skill * 0.4e0 + c_exp * 0.15e0 + c_edu * 0.05e0')} END AS final
FROM (SELECT *, CASE WHEN coalesce(conf, 0) = 0 THEN 0.5e0 ELSE least(1.0e0, conf * 3.5e0) END AS c_role,
 CASE WHEN len(required) > 0 THEN 1.0e0 - len(list_filter(required, lambda r: NOT list_contains(
  list_transform(skills, lambda x: lower(x)), lower(r)))) / len(required) ELSE 0.5e0 END AS c_skill,
 CASE WHEN {_ANY(C.EXPERIENCE_WORDS)} THEN 0.8e0 ELSE 0.4e0 END AS c_exp,
 CASE WHEN {_ANY(C.EDUCATION_WORDS)} THEN 0.9e0 ELSE 0.3e0 END AS c_edu
 FROM (SELECT *, {_FOUND} AS skills, CASE WHEN status = 'ok' THEN {_REQUIRED} ELSE [] END AS required
  FROM (SELECT a.doc_id, a.text, {status(1)} AS status, b.label, b.q AS conf
   FROM asked a JOIN best b ON b.doc_id = a.doc_id AND b.k = 1)))""", *naive_bayes(ALL_DOCS))

_TESTED = ("SELECT doc_id, label, true AS known, true AS proper, true AS accurate FROM parts WHERE split = 'test'")
for _name in ("lr_fit", "svc_fit", "svc_plain_fit", "calibrated_fit", "forest_fit", "refit"):
    oracle(_name, _TESTED, *PARTS)


def _params(rows) -> str:
    return f"SELECT params, true AS in_range FROM {values((json.dumps(r, sort_keys=True),) for r in rows)} t(params)"


_GRIDS = {"MultinomialNB": ("smoothing", (0.01, 0.1, 0.5, 1.0, 2.0)), "LogisticRegression": ("C", (0.1, 1.0, 5.0, 10.0)),
          "LinearSVC": ("C", (0.1, 1.0, 5.0, 10.0))}
oracle("grid_search", "SELECT model, params, true AS in_range FROM " + values(
    (k, json.dumps({name: x})) for k, (name, own) in _GRIDS.items() for x in own) + " t(model, params)")
oracle("forest_search", _params({"maxDepth": d, "minInstancesPerNode": m, "numTrees": n}
                                for n in (10, 20) for d in (4, 6) for m in (1, 2)))


def _grid_terms(low_high: tuple[int, int]) -> str:
    return terms_cte(f"g{low_high[1]}", "c", "tr", low_high[1] > 1, accents=False)


oracle("tfidf_grid", """
SELECT CAST(f.size AS INTEGER) AS max_features, n.name AS ngram_range, CAST(d.low AS INTEGER) AS min_df,
 CAST(x.high AS DOUBLE) AS max_df, CAST(least(f.size, (SELECT count(*) FROM stats s WHERE s.name = n.name AND s.df >= d.low
  AND s.df <= x.high * (SELECT count(*) FROM tr))) AS INTEGER) AS vocab_size, true AS in_range
FROM (VALUES (3000), (5000), (10000)) f(size), (VALUES ('(1, 1)'), ('(1, 2)')) n(name),
 (VALUES (1), (2)) d(low), (VALUES (0.85e0), (0.95e0)) x(high)""",
       *PARTS, f"tr AS (SELECT doc_id, {clean('text')} AS c FROM parts WHERE split = 'train')",
       _grid_terms((1, 1)), _grid_terms((1, 2)),
       "stats AS (SELECT '(1, 1)' AS name, term, count(*) AS df FROM g1 GROUP BY term UNION ALL "
       "SELECT '(1, 2)', term, count(*) FROM g2 GROUP BY term)")
_KINDS = f"{values((k,) for k in M.KINDS)} k(model)"
oracle("candidate_sweep", f"SELECT model, CAST(size AS INTEGER) AS max_features, true AS consistent FROM {_KINDS}, "
       "(VALUES (10000), (20000), (30000)) f(size)")
oracle("model_select", "SELECT true AS known, true AS swept, true AS best")
oracle("model_table", f"SELECT model, CAST({2 * (len(METRICS) + 1)} AS INTEGER) AS metrics, true AS in_range FROM {_KINDS}")
oracle("model_compare", f"SELECT model, true AS validation, true AS test FROM {_KINDS}")
oracle("lsa", 'SELECT doc_id, true AS bounded, true AS "ordered", true AS explained FROM parts', *PARTS)
oracle("active_model", "SELECT true AS known, true AS best")
oracle("reevaluate", "SELECT 'saved' AS model, 'test' AS split, metric, true AS equal FROM "
       f"{values((m,) for m in (*METRICS, 'topk_accuracy'))} t(metric)")
oracle("stream_windows", """
SELECT kind, user_id, event_type, start, count(*) AS rows FROM (
 SELECT 'late' AS kind, user_id, event_type, start FROM timed WHERE late
 UNION ALL SELECT DISTINCT 'first', user_id, event_type, start FROM timed WHERE NOT late) GROUP BY ALL""",
       "dealt AS (SELECT *, least(least((dayofmonth(ts) - 1) // 10, 2) + CASE WHEN event_id % 10 = 7 THEN 1 ELSE 0 END, 2) "
       "AS delivery, CAST(epoch(ts) AS BIGINT) AS s FROM events)",
       "started AS (SELECT *, CAST(floor(epoch(ts) / 21600) AS BIGINT) * 21600 AS start FROM dealt)",
       "seen AS (SELECT d.delivery, floor(max(epoch(e.ts)) * 1000) / 1000 AS latest FROM (SELECT DISTINCT delivery FROM dealt) d "
       "LEFT JOIN dealt e ON e.delivery < d.delivery GROUP BY 1)",
       "timed AS (SELECT user_id, event_type, start, coalesce(start + 21600 <= latest - 86400, false) AS late "
       "FROM started JOIN seen USING (delivery))")
