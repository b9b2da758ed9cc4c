"""Registered retrieval / graph / audit queries (K).

Binding: the corpus is ``documents`` (tags = language, source); the
questions are ``benchmark`` items; even items carry the filter ['en'].
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from evtrail.operators import retrieval as K
from evtrail.operators import rules as R
from evtrail.plans import bindings as B
from evtrail.plans.registry import query
from evtrail.sources import io as A


def _queries(spark, sf):
    b = B.table(spark, sf, "benchmark")
    return b.select("item_id", "text", F.when(F.col("item_id") % 2 == 0, F.array(F.lit("en")))
                    .otherwise(F.array().cast("array<string>")).alias("filters"))


def search(spark, sf, k=4):
    d = B.table(spark, sf, "documents")
    return K.lexical_search(_queries(spark, sf), d, "item_id", F.col("text"), F.col("filters"),
                            "doc_id", F.col("text"), F.array("lang", "source"), k=k)


_K2_SQL = """WITH q AS (SELECT item_id, text || CASE WHEN item_id % 2 = 0 THEN ' en' ELSE ' ' END AS qt,
                         item_id % 2 = 0 AS has_filter FROM benchmark),
qt AS (SELECT item_id, t AS term, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower(qt), '[a-z0-9_]+'))
       AS t FROM q) GROUP BY ALL),
dt AS (SELECT doc_id, t AS term, count(*) AS dtf FROM (SELECT doc_id, unnest(regexp_extract_all(
       lower(concat_ws(' ', text, lang, source)), '[a-z0-9_]+')) AS t FROM documents) GROUP BY ALL),
lex AS (SELECT qt.item_id, dt.doc_id, sum(least(qtf, dtf)) AS lexical FROM qt JOIN dt USING (term) GROUP BY ALL),
bon AS (SELECT q.item_id, d.doc_id, 3.0 AS bonus FROM q JOIN documents d ON q.has_filter
        AND (lower(d.lang) = 'en' OR lower(d.source) = 'en')),
sc AS (SELECT COALESCE(l.item_id, b.item_id) AS item_id, COALESCE(l.doc_id, b.doc_id) AS doc_id,
        CAST(COALESCE(l.lexical, 0) AS DOUBLE) + COALESCE(b.bonus, 0.0) AS score
       FROM lex l FULL JOIN bon b ON l.item_id = b.item_id AND l.doc_id = b.doc_id),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
        FROM sc WHERE score > 0) WHERE rank <= 4)
"""


@query("k02_lexical_retrieval", _K2_SQL + "SELECT item_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM top")
def k02(spark, sf):
    return search(spark, sf).select("item_id", "doc_id", "score", "rank")


@query("k04_audit_log", _K2_SQL + """SELECT item_id, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rank) AS source_ids,
  count(*) AS n_sources FROM top GROUP BY item_id""")
def k04(spark, sf):
    return K.audit_rows(search(spark, sf), "item_id", "doc_id")


_AUDIT_T0 = "2024-01-01 00:00:00"


@query("k04b_audit_append", _K2_SQL + f"""
SELECT q.item_id, strftime(TIMESTAMP '{_AUDIT_T0}' + to_hours(CAST(q.item_id % 96 AS INTEGER)), '%Y-%m-%d') AS day,
  CAST(q.item_id % 7 AS BIGINT) AS user_id, CASE WHEN a.item_id IS NULL THEN 'fallback' ELSE 'grounded' END AS mode,
  COALESCE(a.source_ids, '') AS source_ids
FROM q LEFT JOIN (SELECT item_id, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rank) AS source_ids FROM top GROUP BY item_id)
  a ON a.item_id = q.item_id""")
def k04b(spark, sf):
    """Two batches of answers appended, the first of them a second time."""
    asked = B.table(spark, sf, "benchmark").select("item_id", "text")
    answers = asked.join(K.audit_rows(search(spark, sf), "item_id", "doc_id"), "item_id", "left")
    at = F.expr(f"TIMESTAMP '{_AUDIT_T0}' + make_interval(0, 0, 0, 0, CAST(item_id % 96 AS INT))")
    rows = K.audit_events(answers, "item_id", (F.col("item_id") % 7).cast("long"), F.col("text"), at)
    path = A.scratch_path(spark, "k04b")
    rows = spark.read.parquet(A.write_parquet(rows, A.scratch_path(spark, "k04b-rows")))
    for batch in (F.col("item_id") % 2 == 0, F.col("item_id") % 2 == 1, F.col("item_id") % 2 == 0):
        K.append_audit(rows.where(batch), path)
    return spark.read.parquet(path).select("item_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "user_id", "mode",
                                           "source_ids")


def _graph_sql():
    from evtrail.plans.q_ranking import _CASES_SQL, _TOP5_SQL
    from evtrail.plans.q_rules import _DECISION_SQL, _NAV_SQL
    # the navigation CTEs reuse the name "nd"; rename it inside this chain
    nav_part = _NAV_SQL()[len(_DECISION_SQL()):].replace("\nnd AS (", "\nnvd AS (").replace(
        "AS cands FROM nd)", "AS cands FROM nvd)")
    return _CASES_SQL() + ", " + _TOP5_SQL + nav_part + """,
drv_n AS (SELECT CAST(sum(least(greatest(len(drv), 1), 3)) AS BIGINT) AS n FROM nc),
prov_n AS (SELECT count(*) AS n FROM cs JOIN top5 USING (need_key) WHERE rank <= 3),
base_n AS (SELECT count(*) AS n FROM dp)
"""


def _filled_sql(template, values):
    parts = re.split(r"\{(\w+)\}", template)
    return "(" + " || ".join(values[x] if i % 2 else "'" + x.replace("'", "''") + "'" for i, x in enumerate(parts)) + ")"


def _explanation_sql():
    values = {"band": "dp.band", "score": "CAST(round(least(dp.risk0 * 5, 0.99), 3) AS VARCHAR)",
              "drivers": "CASE WHEN len(nc.drv) = 0 THEN 'INSUFFICIENT_EVIDENCE' ELSE array_to_string(nc.drv, ', ') END",
              "report": "COALESCE(ls.reason, 'Normal vitals')", "pathway": "dp.pathway",
              "pathway_name": "CASE dp.pathway " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in R.PATHWAYS.items()) + " END",
              "provider": "'Provider ' || CAST(t.provider_id AS VARCHAR)"}
    fill = lambda x: _filled_sql(x, values)
    s, p = R.EXPLANATION_SAFETY, R.EXPLANATION_PROVIDER
    return _graph_sql() + f"""
SELECT dp.entity_id, dp.index_id, concat_ws(chr(10) || chr(10), {_filled_sql(R.EXPLANATION_HEAD[0], {})} || chr(10) ||
  {_filled_sql(R.EXPLANATION_HEAD[1], {})}, {fill(R.EXPLANATION_RISK)},
  CASE dp.safety_status WHEN 'GREEN' THEN {fill(s['GREEN'])} WHEN 'YELLOW' THEN {fill(s['YELLOW'])} ELSE {fill(s['other'])} END,
  {fill(R.EXPLANATION_PATHWAY)},
  CASE WHEN dp.safety_status = 'GREEN' AND t.provider_id IS NOT NULL THEN {fill(p[True])} ELSE {fill(p[False])} END) AS explanation
FROM dp JOIN nc ON nc.entity_id = dp.entity_id LEFT JOIN ls ON ls.user_id = dp.entity_id
LEFT JOIN cs ON cs.entity_id = dp.entity_id LEFT JOIN top5 t ON t.need_key = cs.need_key AND t.rank = 1"""


@query("i22b_explanation", lambda: _explanation_sql())
def i22b(spark, sf):
    """The explanation of each case from risk, safety, pathway and match."""
    from evtrail.plans.q_ranking import cases, top5
    from evtrail.plans.q_rules import decision_table, last_assessed, navigation
    last = last_assessed(spark, sf).select("entity_id", "reason")
    best = cases(spark, sf).select("entity_id", "need_key").join(
        top5(spark, sf).where("rank = 1").select("need_key", "provider_id"), "need_key").drop("need_key")
    nav = navigation(spark, sf).select("entity_id", "drivers")
    d = (decision_table(spark, sf).join(nav, "entity_id").join(last, "entity_id", "left").join(best, "entity_id", "left"))
    matched = F.when(F.col("safety_status") == "GREEN", F.concat(F.lit("Provider "), F.col("provider_id").cast("string")))
    return d.select("entity_id", "index_id", R.explanation_text({
        "band": F.col("band"), "score": R.display_score(F.col("risk")), "drivers": F.replace(
            F.col("drivers"), F.lit(","), F.lit(", ")), "status": F.col("safety_status"), "report": F.col("reason"),
        "pathway": F.col("pathway"), "pathway_name": F.col("pathway_name"), "provider": matched}).alias("explanation"))


@query("k03_case_graph_nodes", lambda: _graph_sql() + """
SELECT t.type, base_n.n AS n FROM base_n, (VALUES ('Patient'), ('Encounter'), ('RiskAssessment'), ('SafetyAssessment'),
  ('CarePathway')) t(type)
UNION ALL SELECT 'RiskDriver', n FROM drv_n UNION ALL SELECT 'Provider', n FROM prov_n""")
def k03(spark, sf):
    from evtrail.plans.q_ranking import cases, top5
    from evtrail.plans.q_rules import decision_table, navigation
    d = decision_table(spark, sf)
    nav = navigation(spark, sf).select("entity_id", F.split("drivers", ",").alias("drivers"))
    cs = cases(spark, sf).select("entity_id", "need_key")
    prov = cs.join(top5(spark, sf), "need_key").select("entity_id", "rank", "provider_id")
    nodes, _ = K.case_graph(d, nav, prov)
    return nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("k03b_case_graph_edges", lambda: _graph_sql() + """
SELECT t.type, base_n.n AS n FROM base_n, (VALUES ('HAS_ENCOUNTER'), ('HAS_RISK_ASSESSMENT'), ('HAS_SAFETY_ASSESSMENT'),
  ('INFORMS'), ('GOVERNS')) t(type)
UNION ALL SELECT 'SUPPORTED_BY', n FROM drv_n UNION ALL SELECT 'MATCHED_TO', n FROM prov_n""")
def k03b(spark, sf):
    from evtrail.plans.q_ranking import cases, top5
    from evtrail.plans.q_rules import decision_table, navigation
    d = decision_table(spark, sf)
    nav = navigation(spark, sf).select("entity_id", F.split("drivers", ",").alias("drivers"))
    cs = cases(spark, sf).select("entity_id", "need_key")
    prov = cs.join(top5(spark, sf), "need_key").select("entity_id", "rank", "provider_id")
    _, edges = K.case_graph(d, nav, prov)
    return edges.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
