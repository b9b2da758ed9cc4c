"""Registered rule queries (I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evtrail.operators import rules as R
from evtrail.operators.pointintime import day_number, sweep_count
from evtrail.plans import bindings as B
from evtrail.plans.q_pointintime import E24_SQL, model_table_out
from evtrail.plans.registry import query
from evtrail.plans.sql_rules import assessment_sql, context_sql
from evtrail.session import memo_checkpoint

_SA_COLS = ["user_id", "day", "fired_rules", "status", "triggered_rule", "reason", "supporting_data",
            "recommended_action"]


def assessed(spark, sf):
    return R.safety_assessment(B.clinical_context(spark, sf), symptoms="symptoms")


# I1 --------------------------------------------------------------------------
# Deterministic rule-based risk score over the model table (our binding).
def risk_expr():
    return F.least(F.lit(0.99), F.lit(0.02) + 0.05 * F.col("n_emergency_90d") + 0.02 * F.col("n_inpatient_90d")
                   + 0.01 * F.least(F.col("hist_visits"), F.lit(20)))


# DOUBLE literals so both engines do the same IEEE operations in the same order
RISK_SQL = ("least(0.99::DOUBLE, 0.02::DOUBLE + 0.05::DOUBLE * n_emergency_90d + 0.02::DOUBLE * n_inpatient_90d"
            " + 0.01::DOUBLE * least(hist_visits, 20))")


@query("i01_risk_band", lambda: f"""
SELECT entity_id, index_id, round({RISK_SQL}, 6) AS risk,
  CASE WHEN {RISK_SQL} > 0.15 THEN 'HIGH' WHEN {RISK_SQL} > 0.05 THEN 'MEDIUM' ELSE 'LOW' END AS band_serving,
  CASE WHEN {RISK_SQL} > 0.6 THEN 'HIGH' WHEN {RISK_SQL} > 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS band_batch,
  round(least({RISK_SQL} * 5, 0.99), 3) AS display_score
FROM ({E24_SQL}) mt""")
def i01(spark, sf):
    mt = model_table_out(spark, sf).withColumn("_r", risk_expr())
    return mt.select("entity_id", "index_id", F.round("_r", 6).alias("risk"),
                     R.risk_band(F.col("_r")).alias("band_serving"),
                     R.risk_band(F.col("_r"), 0.6, 0.3).alias("band_batch"),
                     R.display_score(F.col("_r")).alias("display_score"))


# I3 / I4 / I5 / I6 ----------------------------------------------------------
@query("i03_vital_triggers", lambda: f"WITH {context_sql()},\n{assessment_sql()}\n"
       "SELECT user_id, day, fired_rules FROM sa")
def i03(spark, sf):
    return assessed(spark, sf).select("user_id", "day", "fired_rules")


@query("i05_safety_status", lambda: f"WITH {context_sql()},\n{assessment_sql()}\nSELECT * FROM sa")
def i05(spark, sf):
    return assessed(spark, sf).select(*_SA_COLS)


@query("i06_completeness_gate", lambda: f"""WITH {context_sql()},\n{assessment_sql()}
SELECT supporting_data AS missing, count(*) AS n FROM sa WHERE status = 'PENDING' GROUP BY supporting_data""")
def i06(spark, sf):
    a = assessed(spark, sf).where(F.col("status") == "PENDING")
    return a.groupBy(F.col("supporting_data").alias("missing")).agg(F.count(F.lit(1)).alias("n"))


@query("i07_status_distribution", lambda: f"""WITH {context_sql()},\n{assessment_sql()}
SELECT status, count(*) AS n,
  COALESCE(array_to_string(list_sort(list_distinct(flatten(list(string_split(fired_rules, ',')) FILTER (
     WHERE fired_rules <> '')))), ','), '') AS rules
FROM sa GROUP BY status""")
def i07(spark, sf):
    return R.status_distribution(assessed(spark, sf))


# I9 ---------------------------------------------------------------------------
_I9_SQL = """iv AS (
  SELECT o.o_custkey AS entity_id, CAST(l.l_partkey AS VARCHAR) AS code,
         CASE l.l_returnflag WHEN 'R' THEN 'condition' WHEN 'A' THEN 'medication' WHEN 'N' THEN 'allergy' END AS kind,
         l.l_shipdate AS start_ts,
         CASE WHEN l.l_linestatus = 'O' THEN NULL ELSE l.l_shipdate + to_days(CAST(l.l_quantity AS INTEGER)) END AS stop_ts
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
hr AS (SELECT CAST(p_partkey AS VARCHAR) AS code FROM part WHERE p_type = 'PROMO'),
q AS (SELECT o_custkey AS entity_id, o_orderkey AS event_id, o_orderdate AS ts,
             o_orderpriority = '1-URGENT' AS acute FROM orders)"""


@query("i09_compound_rules", lambda: "WITH " + _I9_SQL + """
SELECT q.entity_id, q.event_id,
  CAST(acute AND EXISTS (SELECT 1 FROM iv WHERE iv.entity_id = q.entity_id AND iv.kind = 'condition'
       AND iv.code IN (SELECT code FROM hr) AND iv.start_ts <= q.ts AND (iv.stop_ts IS NULL OR iv.stop_ts > q.ts))
       AS INTEGER) AS R12,
  CAST(EXISTS (SELECT 1 FROM iv a JOIN iv m ON a.entity_id = m.entity_id AND a.code = m.code
       WHERE a.entity_id = q.entity_id AND a.kind = 'allergy' AND m.kind = 'medication'
       AND a.start_ts <= q.ts AND (a.stop_ts IS NULL OR a.stop_ts > q.ts)
       AND m.start_ts <= q.ts AND (m.stop_ts IS NULL OR m.stop_ts > q.ts)) AS INTEGER) AS R13
FROM q""")
def i09(spark, sf):
    o = B.table(spark, sf, "orders").select(F.col("o_custkey").alias("entity_id"), F.col("o_orderkey").alias("event_id"),
                                            F.col("o_orderdate").alias("ts"),
                                            (F.col("o_orderpriority") == "1-URGENT").alias("acute"))
    iv = B.intervals(spark, sf)
    hr = B.table(spark, sf, "part").where(F.col("p_type") == "PROMO").select(F.col("p_partkey").cast("string").alias("code"))
    out = R.compound_flags(o, iv, "entity_id", "ts", "kind", "code", "start_ts", "stop_ts", hr, F.col("acute"))
    return out.select("entity_id", "event_id", "R12", "R13")


# I10 / I23 --------------------------------------------------------------------
@memo_checkpoint
def risk_rows(spark, sf):
    """What the rules read of the model table's index rows, and the risk: made
    once for decisions and navigation."""
    mt = model_table_out(spark, sf).withColumn("risk", risk_expr())
    return mt.select("entity_id", "index_id", "index_date", "risk", "n_emergency_90d", "n_outpatient_90d",
                     "n_inpatient_90d", "days_since_prev_emergency")


@memo_checkpoint
def last_assessed(spark, sf):
    """Status and reason of each user's last assessed day; (user, day) is
    unique, so no two rows compete."""
    from evtrail.operators.cleaning import keep_first
    sa = assessed(spark, sf).withColumn("_nd", -F.unix_date(F.to_date("day")))
    return keep_first(sa.select("user_id", "_nd", "status", "reason"), ["user_id"], ["_nd"]).select(
        F.col("user_id").alias("entity_id"), "status", "reason")


@memo_checkpoint
def decision_table(spark, sf):
    """Latest index row per customer (model table) -> risk band; latest
    clinical context of the same id (PENDING when none) -> safety; pathway."""
    from evtrail.operators.cleaning import keep_first
    latest = keep_first(risk_rows(spark, sf).select("entity_id", "index_id", "risk", "n_emergency_90d", "n_outpatient_90d",
                                  "n_inpatient_90d", "days_since_prev_emergency",
                                  (-F.unix_date(F.to_date("index_date"))).alias("_nd"),
                                  (-F.col("index_id")).alias("_ni")),
                        ["entity_id"], ["_nd", "_ni"]).drop("_nd", "_ni")
    j = latest.join(last_assessed(spark, sf).select("entity_id", "status"), "entity_id", "left")
    band = R.risk_band(F.col("risk"))
    status = F.coalesce(F.col("status"), F.lit("PENDING"))
    pid = R.care_pathway(band, status)
    out = j.select("entity_id", "index_id", "risk", band.alias("band"),
                   status.alias("safety_status"), pid.alias("pathway"), R.pathway_name(pid).alias("pathway_name"),
                   "n_emergency_90d", "n_outpatient_90d", "n_inpatient_90d", "days_since_prev_emergency")
    # one row per entity, reused by many downstream plans: materialised once
    # as a reliable checkpoint in the shared checkpoint folder
    return out


_DECISION_SQL = lambda: f"""WITH {context_sql()},\n{assessment_sql()},
mt AS (SELECT * FROM ({E24_SQL}) x),
lt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY index_date DESC, index_id DESC) AS rn
       FROM mt) WHERE rn = 1),
ls AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS rn FROM sa) WHERE rn = 1),
dt AS (SELECT lt.entity_id, lt.index_id, {RISK_SQL} AS risk0,
   CASE WHEN {RISK_SQL} > 0.15 THEN 'HIGH' WHEN {RISK_SQL} > 0.05 THEN 'MEDIUM' ELSE 'LOW' END AS band,
   COALESCE(ls.status, 'PENDING') AS safety_status, n_emergency_90d, n_outpatient_90d, n_inpatient_90d,
   days_since_prev_emergency
   FROM lt LEFT JOIN ls ON ls.user_id = lt.entity_id),
dp AS (SELECT *, round(risk0, 6) AS risk, CASE WHEN safety_status = 'RED' THEN 'P1' WHEN safety_status = 'YELLOW' THEN 'P2'
   WHEN safety_status = 'GREEN' AND band = 'HIGH' THEN 'P3' WHEN safety_status = 'GREEN' AND band = 'MEDIUM' THEN 'P4'
   WHEN safety_status = 'GREEN' THEN 'P5' WHEN safety_status = 'PENDING' THEN 'Assessment Required' ELSE 'UNKNOWN' END
   AS pathway FROM dt)
"""


@query("i10_pathway_matrix", lambda: _DECISION_SQL() + """
SELECT safety_status, band, pathway, count(*) AS n FROM dp GROUP BY ALL""")
def i10(spark, sf):
    d = decision_table(spark, sf)
    return d.groupBy("safety_status", "band", "pathway").agg(F.count(F.lit(1)).alias("n"))


# Expected pathway of each safety status and risk band, D01..D09.
PATHWAY_CHECKS = [
    ("D01", "GREEN", "LOW", "P5"), ("D02", "GREEN", "MEDIUM", "P4"), ("D03", "GREEN", "HIGH", "P3"),
    ("D04", "YELLOW", "LOW", "P2"), ("D05", "YELLOW", "MEDIUM", "P2"), ("D06", "YELLOW", "HIGH", "P2"),
    ("D07", "RED", "LOW", "P1"), ("D08", "RED", "MEDIUM", "P1"), ("D09", "RED", "HIGH", "P1"),
]
_CHECK_ROWS = ", ".join(f"('{i}', '{s}', '{b}', '{p}')" for i, s, b, p in PATHWAY_CHECKS)


@query("i10b_pathway_check", lambda: _DECISION_SQL() + f"""
SELECT c.id, c.expected, count(dp.pathway) AS n, count(*) FILTER (WHERE dp.pathway <> c.expected) AS n_wrong
FROM (VALUES {_CHECK_ROWS}) c(id, st, bd, expected) LEFT JOIN dp ON dp.safety_status = c.st AND dp.band = c.bd
GROUP BY c.id, c.expected""")
def i10b(spark, sf):
    """Every decision held against the nine-field check table."""
    checks = spark.createDataFrame(PATHWAY_CHECKS, "id string, safety_status string, band string, expected string")
    d = decision_table(spark, sf).groupBy("safety_status", "band", "pathway").agg(F.count(F.lit(1)).alias("n"))
    j = checks.join(d, ["safety_status", "band"], "left")
    return j.groupBy("id", "expected").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(F.col("pathway") != F.col("expected"), F.col("n"))), F.lit(0)).alias("n_wrong"))


_PNAME = " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in R.PATHWAYS.items())


@query("i23_decision_table", lambda: _DECISION_SQL() + f"""
SELECT entity_id, index_id, risk, band, safety_status, pathway, CASE pathway {_PNAME} END AS pathway_name FROM dp""")
def i23(spark, sf):
    return decision_table(spark, sf).select("entity_id", "index_id", F.round("risk", 6).alias("risk"), "band",
                                            "safety_status", "pathway", "pathway_name")


# I12 / I13 / I14 -----------------------------------------------------------------
def navigation(spark, sf):
    d = decision_table(spark, sf)
    burden = F.col("active_conditions")
    from evtrail.operators.pointintime import active_at
    iv = B.intervals(spark, sf).where(F.col("kind") == "condition")
    # the index rows of decisions only: the others meet nothing below
    mt = (risk_rows(spark, sf).select("entity_id", "index_id", F.to_timestamp("index_date").alias("index_ts"))
          .join(d.select("entity_id", "index_id"), ["entity_id", "index_id"], "left_semi"))
    mt = active_at(iv, mt, "entity_id", "start_ts", "stop_ts", "index_ts", "active_conditions", mode="v1")
    d = d.join(mt.select("entity_id", "index_id", F.coalesce("active_conditions", F.lit(0)).alias("active_conditions")),
               ["entity_id", "index_id"], "left")
    score = R.opportunity_score(F.col("risk"), F.col("n_emergency_90d"), F.col("n_outpatient_90d"),
                                F.col("n_inpatient_90d"))
    level = R.opportunity_level(score)
    drv = R.drivers(F.col("n_emergency_90d"), F.col("n_outpatient_90d"), F.col("n_inpatient_90d"),
                    F.col("days_since_prev_emergency").cast("long"), burden)
    cands = R.pathway_candidates(drv, level, (F.col("entity_id") % 2) == 0)
    return d.select("entity_id", "index_id", F.round(score, 6).alias("opportunity_score"), level.alias("level"),
                    F.array_join(F.transform(drv, lambda x: x["driver_id"]), ",").alias("drivers"),
                    R.recommended(cands).alias("recommended_pathway"),
                    F.array_join(R.alternatives(cands), ",").alias("alternative_pathways"))


_NAV_SQL = lambda: _DECISION_SQL() + f""",
{_I9_SQL.split(",\nhr AS")[0]},
burden AS (SELECT mt.entity_id, mt.index_id, count(iv.entity_id) AS active_conditions FROM mt LEFT JOIN iv
   ON iv.entity_id = mt.entity_id AND iv.kind = 'condition' AND iv.start_ts < CAST(mt.index_date AS TIMESTAMP)
   AND (iv.stop_ts IS NULL OR iv.stop_ts >= CAST(mt.index_date AS TIMESTAMP)) GROUP BY ALL),
nv AS (SELECT dp.*, b.active_conditions AS burden,
   least(greatest(40.0 * COALESCE(risk0, 0) + CASE WHEN n_emergency_90d >= 3 THEN 30 WHEN n_emergency_90d = 2 THEN 20 ELSE 0 END
     + CASE WHEN COALESCE(n_outpatient_90d, 0) = 0 THEN 30 ELSE 0 END
     - CASE WHEN COALESCE(n_inpatient_90d, 0) >= 2 THEN 20 ELSE 0 END, 0.0), 100.0) AS score
   FROM dp LEFT JOIN burden b USING (entity_id, index_id)),
nd AS (SELECT *, CASE WHEN score >= 70 THEN 'HIGH' WHEN score >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS level,
   list_filter([CASE WHEN n_emergency_90d >= 3 THEN 'HIGH_ED_FREQUENCY' END,
     CASE WHEN n_emergency_90d = 2 THEN 'REPEATED_ED_UTILIZATION' END,
     CASE WHEN days_since_prev_emergency <= 14 THEN 'RECENT_ED_UTILIZATION' END,
     CASE WHEN n_outpatient_90d = 0 THEN 'LOW_OUTPATIENT_ENGAGEMENT' END,
     CASE WHEN n_inpatient_90d >= 2 THEN 'HIGH_INPATIENT_ACUITY_CONTEXT' END,
     CASE WHEN burden >= 3 AND n_outpatient_90d = 0 THEN 'CARE_COORDINATION_GAP' END], lambda x: x IS NOT NULL) AS drv
   FROM nv),
nc AS (SELECT *, list_filter([
     CASE WHEN level IN ('HIGH', 'MEDIUM') AND list_contains(drv, 'CARE_COORDINATION_GAP') THEN 'CARE_MANAGEMENT' END,
     CASE WHEN level IN ('HIGH', 'MEDIUM') AND list_contains(drv, 'LOW_OUTPATIENT_ENGAGEMENT')
          AND NOT list_contains(drv, 'HIGH_INPATIENT_ACUITY_CONTEXT') THEN 'PRIMARY_CARE' END,
     CASE WHEN entity_id % 2 = 0 AND level IN ('HIGH', 'MEDIUM') AND (list_contains(drv, 'CARE_COORDINATION_GAP')
          OR (NOT list_contains(drv, 'HIGH_INPATIENT_ACUITY_CONTEXT') AND (list_contains(drv, 'LOW_OUTPATIENT_ENGAGEMENT')
          OR list_contains(drv, 'RECENT_ED_UTILIZATION')))) THEN 'TELEHEALTH' END,
     CASE WHEN level IN ('HIGH', 'MEDIUM') AND list_contains(drv, 'RECENT_ED_UTILIZATION')
          AND NOT list_contains(drv, 'HIGH_INPATIENT_ACUITY_CONTEXT') THEN 'URGENT_CARE' END], lambda x: x IS NOT NULL)
     AS cands FROM nd)
"""


@query("i12_opportunity_score", lambda: _NAV_SQL() + """
SELECT entity_id, index_id, round(score, 6) AS opportunity_score, level FROM nc""")
def i12(spark, sf):
    return navigation(spark, sf).select("entity_id", "index_id", "opportunity_score", "level")


@query("i13_drivers", lambda: _NAV_SQL() + """
SELECT entity_id, index_id, CASE WHEN len(drv) = 0 THEN 'INSUFFICIENT_EVIDENCE' ELSE array_to_string(drv, ',') END
  AS drivers FROM nc""")
def i13(spark, sf):
    return navigation(spark, sf).select("entity_id", "index_id", "drivers")


@query("i14_pathway_candidates", lambda: _NAV_SQL() + """
SELECT entity_id, index_id, COALESCE(cands[1], 'NO_PATHWAY_RECOMMENDATION') AS recommended_pathway,
  CASE WHEN len(cands) > 1 THEN array_to_string(cands[2:], ',') ELSE '' END AS alternative_pathways FROM nc""")
def i14(spark, sf):
    return navigation(spark, sf).select("entity_id", "index_id", "recommended_pathway", "alternative_pathways")


# I15 ---------------------------------------------------------------------------
def _sessions(spark, sf):
    """Stage session tables derived from the decision table: some links
    broken on purpose (missing parent, foreign case, emergency safety)."""
    d = decision_table(spark, sf)
    i = F.col("index_id")
    sid = lambda p: F.concat(F.lit(p), i.cast("string"))
    safety = d.select(sid("S").alias("session_id"), F.col("entity_id").alias("case_id"),
                      F.when(F.col("safety_status").isin("RED", "YELLOW"), "EMERGENCY_INDICATOR")
                      .otherwise("NO_EMERGENCY_INDICATOR").alias("status"))
    opp = d.where(i % 13 != 0).select(sid("O").alias("session_id"), sid("S").alias("parent_id"),
                                      F.col("entity_id").alias("case_id"))
    drv = d.select(sid("D").alias("session_id"), sid("O").alias("parent_id"),
                   F.when(i % 17 == 0, F.col("entity_id") + 1).otherwise(F.col("entity_id")).alias("case_id"))
    pw = d.select(sid("W").alias("session_id"), sid("D").alias("parent_id"), F.col("entity_id").alias("case_id"))
    prov = d.select(sid("V").alias("session_id"), sid("W").alias("parent_id"), F.col("entity_id").alias("case_id"))
    return prov, pw, drv, opp, safety


@query("i15_lineage_gate", lambda: _DECISION_SQL() + """
SELECT 'V' || CAST(index_id AS VARCHAR) AS provider_session, entity_id AS case_id,
  CASE WHEN index_id % 13 = 0 THEN 'MISSING_PARENT' WHEN index_id % 17 = 0 THEN 'CASE_MISMATCH'
       WHEN safety_status IN ('RED', 'YELLOW') THEN 'BLOCKED_BY_SAFETY' ELSE 'VALID' END AS lineage_status FROM dp""")
def i15(spark, sf):
    return R.lineage_gate(*_sessions(spark, sf))


# I16 ---------------------------------------------------------------------------
def _i16_sql():
    ctx_ce = context_sql(None).split(",\nctx AS (")[0]          # the per-event CTE "ce"
    lv = ",\n".join(f"  last_value(CASE WHEN vn = '{v}' THEN v END IGNORE NULLS) OVER w AS {v}" for v in B.VITALS)
    return f"""WITH {ctx_ce},
m AS (SELECT user_id, day, ts, event_id,
{lv},
  last_value(avpu IGNORE NULLS) OVER w AS avpu, last_value(pain IGNORE NULLS) OVER w AS pain,
  list(CASE WHEN sym IS NOT NULL AND symv THEN lower(trim(sym)) END) OVER w AS symlist,
  row_number() OVER (PARTITION BY user_id, day ORDER BY ts, event_id) AS attempt
  FROM ce WINDOW w AS (PARTITION BY user_id, day ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ctx2 AS (SELECT *, list_distinct(list_filter(symlist, lambda x: x IS NOT NULL)) AS syms FROM m),
{assessment_sql('ctx2', 'user_id, day, ts, attempt')}
SELECT CASE WHEN status = 'PENDING' AND attempt >= 2 THEN 'HUMAN_CLINICAL_REVIEW' ELSE status END AS outcome,
  count(*) AS n FROM sa GROUP BY 1"""


@query("i16_reassessment", lambda: _i16_sql())
def i16(spark, sf):
    """Each measurement event of a user-day is one assessment attempt of the
    session (user, day): fields merge over the attempts (last non-null
    wins, symptom flags accumulate) and are re-assessed each time."""
    ev = B.context_events(spark, sf).withColumn("session", F.concat_ws(":", "user_id", "day"))
    ev = ev.withColumn("symptoms", F.array_compact(F.array("symptom")))
    r = R.reassessment(ev, "session", ["ts", "event_id"], [*B.VITALS, "avpu", "pain"], sets=["symptoms"])
    return r.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


# I17 / I18 -------------------------------------------------------------------------
def _reviews(spark, sf):
    d = decision_table(spark, sf)
    k = F.col("index_id") % 5
    dec = (F.when(k == 0, "APPROVE").when(k == 1, "modify").when(k == 2, "REJECT").when(k == 3, "ESCALATE")
           .otherwise("BOGUS"))
    return d.select(F.concat(F.lit("R"), F.col("index_id").cast("string")).alias("review_id"), "entity_id",
                    dec.alias("decision"), F.col("pathway").alias("original_pathway"),
                    F.when(k == 1, F.lit("P4")).alias("modified_pathway"), "index_id")


_REVIEW_SQL = lambda: _DECISION_SQL() + """,
rv AS (SELECT 'R' || CAST(index_id AS VARCHAR) AS review_id, entity_id, index_id,
  CASE index_id % 5 WHEN 0 THEN 'APPROVE' WHEN 1 THEN 'modify' WHEN 2 THEN 'REJECT' WHEN 3 THEN 'ESCALATE' ELSE 'BOGUS' END
    AS decision, pathway AS original_pathway, CASE WHEN index_id % 5 = 1 THEN 'P4' END AS modified_pathway FROM dp),
rg AS (SELECT *, CASE WHEN upper(trim(decision)) IN ('APPROVE', 'MODIFY') THEN 'INTERVENTION_CREATED'
   WHEN upper(trim(decision)) IN ('REJECT', 'ESCALATE') THEN 'BLOCKED' ELSE 'INVALID_DECISION' END AS review_status,
   CASE WHEN upper(trim(decision)) IN ('APPROVE', 'MODIFY') THEN COALESCE(modified_pathway, original_pathway) END
   AS final_pathway FROM rv)
"""


@query("i17_review_gate", lambda: _REVIEW_SQL() + "SELECT review_id, review_status, final_pathway FROM rg")
def i17(spark, sf):
    return R.review_gate(_reviews(spark, sf)).select("review_id", "review_status", "final_pathway")


@query("i18_idempotent_create", lambda: _REVIEW_SQL() + """,
new AS (SELECT review_id, final_pathway, 0 AS attempt FROM rg WHERE review_status = 'INTERVENTION_CREATED'
        UNION ALL SELECT review_id, final_pathway, 1 FROM rg WHERE review_status = 'INTERVENTION_CREATED'),
existing AS (SELECT review_id FROM rg WHERE review_status = 'INTERVENTION_CREATED' AND index_id % 2 = 0)
SELECT review_id, final_pathway, sha256(review_id) AS intervention_id FROM (
  SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY attempt) AS rn FROM new) WHERE rn = 1
  AND review_id NOT IN (SELECT review_id FROM existing)""")
def i18(spark, sf):
    g = R.review_gate(_reviews(spark, sf)).where(F.col("review_status") == "INTERVENTION_CREATED")
    new = (g.select("review_id", "final_pathway", F.lit(0).alias("attempt"))
           .unionByName(g.select("review_id", "final_pathway", F.lit(1).alias("attempt"))))   # same review twice
    existing = g.where(F.col("index_id") % 2 == 0).select("review_id")
    out = R.idempotent_create(new, existing, ["review_id"], ["attempt"])
    return out.select("review_id", "final_pathway", R.stable_id(F.col("review_id")).alias("intervention_id"))


# I19 / I20 --------------------------------------------------------------------------
@query("i19_outcome_windows", lambda: f"""WITH {E24_SQL.split("WITH ", 1)[1].split(",\nf AS (")[0]},
an AS (SELECT entity_id, index_id, 'INDEX' AS anchor_type, day AS anchor_day FROM idx
       UNION ALL SELECT entity_id, index_id, 'POST_INTERVENTION', day + 7 FROM idx)
SELECT an.entity_id, an.index_id, an.anchor_type,
  count(ev.event_id) FILTER (WHERE ev.cls = 'emergency') AS emergency_90d,
  count(ev.event_id) FILTER (WHERE ev.cls = 'outpatient') AS outpatient_90d,
  count(ev.event_id) FILTER (WHERE ev.cls = 'inpatient') AS inpatient_90d
FROM an LEFT JOIN ev ON ev.entity_id = an.entity_id AND ev.day > an.anchor_day AND ev.day <= an.anchor_day + 90
GROUP BY ALL""")
def i19(spark, sf):
    from evtrail.operators.pointintime import index_cohort
    enc = B.encounters(spark, sf).withColumn("day", day_number("ts"))
    idx = index_cohort(B.encounters(spark, sf), "entity_id", "ts", "event_id", F.col("cls") == "emergency")
    an = (idx.select("entity_id", "index_id", F.lit("INDEX").alias("anchor_type"), F.col("day").alias("anchor_day"))
          .unionByName(idx.select("entity_id", "index_id", F.lit("POST_INTERVENTION").alias("anchor_type"),
                                  (F.col("day") + 7).alias("anchor_day"))))
    out = R.outcome_windows(an, enc, "entity_id", "anchor_day", "day", "cls", ["emergency", "outpatient", "inpatient"])
    return out.select("entity_id", "index_id", "anchor_type", "emergency_90d", "outpatient_90d", "inpatient_90d")


@query("i20_history_feedback", lambda: _REVIEW_SQL() + """,
hist AS (SELECT entity_id AS member_id, CAST(substr(review_id, 2) AS BIGINT) AS k,
   date_diff('day', DATE '1970-01-01', CAST(o.o_orderdate AS DATE)) + 3 AS event_day FROM rg
   JOIN orders o ON o.o_orderkey = rg.index_id WHERE review_status = 'INTERVENTION_CREATED'
   UNION ALL SELECT o_custkey, o_orderkey, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) FROM orders
   WHERE o_orderpriority = '1-URGENT'),
q AS (SELECT o_custkey AS member_id, o_orderkey, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS d
      FROM orders)
SELECT q.member_id, q.o_orderkey, (SELECT count(*) FROM hist h WHERE h.member_id = q.member_id AND h.event_day <= q.d)
  AS history_events FROM q""")
def i20(spark, sf):
    """History log = interventions (3 days after the index visit) unioned
    with emergency visits; a prediction at day d may only use entries
    with event_date <= d (sweep count, no pairs)."""
    g = R.review_gate(_reviews(spark, sf)).where(F.col("review_status") == "INTERVENTION_CREATED")
    o = B.table(spark, sf, "orders")
    iv = g.join(o.select(F.col("o_orderkey").alias("index_id"), "o_orderdate"), "index_id").select(
        F.col("entity_id").alias("member_id"), (day_number("o_orderdate") + 3).alias("event_day"),
        F.lit("INTERVENTION").alias("event_type"))
    ed = o.where(F.col("o_orderpriority") == "1-URGENT").select(
        F.col("o_custkey").alias("member_id"), day_number("o_orderdate").alias("event_day"),
        F.lit("ED_VISIT").alias("event_type"))
    hist = iv.unionByName(ed)   # append-only history log
    q = o.select(F.col("o_custkey").alias("member_id"), "o_orderkey", day_number("o_orderdate").alias("d"))
    # event counts at q iff event_day <= d  <=>  q > event_day - 1
    h = hist.select("member_id", (F.col("event_day") - 1).alias("_open"))
    out = sweep_count(h, q, "member_id", "_open", None, "d", "history_events")
    return out.select("member_id", "o_orderkey", F.coalesce("history_events", F.lit(0)).alias("history_events"))


# I21 / I22 / I24 --------------------------------------------------------------------
@query("i21_keyword_extraction", """
SELECT conv_id, turn, contains(lower(text), 'chest pain') OR contains(lower(text), 'chest hurts') AS chest_pain,
  CASE WHEN contains(lower(text), 'short of breath') OR contains(lower(text), 'shortness of breath')
       OR contains(lower(text), 'breathing') THEN 24.0::DOUBLE END AS respiratory_rate,
  CASE WHEN contains(lower(text), 'fever') THEN 38.5::DOUBLE END AS temperature,
  contains(lower(text), 'bleed') AS bleeding
FROM conversations WHERE role = 'user'""")
def i21(spark, sf):
    c = B.table(spark, sf, "conversations").where(F.col("role") == "user")
    return c.select("conv_id", "turn", R.extract_symptoms(F.col("text")).alias("x")).select("conv_id", "turn", "x.*")


_GUARD = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.GUARDRAILS.items())


@query("i22_text_templates", lambda: _DECISION_SQL() + f"""
SELECT entity_id, index_id, COALESCE(CASE safety_status {_GUARD} END, '{R.GUARDRAILS['GREEN']}') AS guardrail,
  printf('Historical utilization risk: %s (score %s). Safety status: %s. Current pathway: %s — %s.', band,
         CAST(round(least(risk0 * 5, 0.99), 3) AS VARCHAR), safety_status, pathway, CASE pathway {_PNAME} END) AS summary
FROM dp""")
def i22(spark, sf):
    d = decision_table(spark, sf).withColumn("_disp", R.display_score(F.col("risk")))
    return d.select("entity_id", "index_id", R.guardrail_text(F.col("safety_status")).alias("guardrail"),
                    R.summary_text(F.col("band"), F.col("_disp"), F.col("safety_status"), F.col("pathway"),
                                   F.col("pathway_name")).alias("summary"))


_SEV_SQL = "[" + ", ".join(f"'{s.lower()}'" for s in R.SEVERE_SYMPTOMS) + "]"
_SEV_PICK = ["Symptoms are mild or stable", "Chest pain or severe breathing difficulty", "Needs same-day assessment",
             "Significant bleeding", "Routine or follow-up concern"]


@query("i24_call_review_override", f"""
WITH r AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day,
   list(CASE CAST(props->>'k' AS INTEGER) % 5 {" ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_SEV_PICK))} END)
     AS reported FROM events GROUP BY ALL)
SELECT user_id, day, CASE WHEN list_has_any(list_transform(reported, lambda x: lower(trim(x))), {_SEV_SQL})
  THEN 'emergency' ELSE CASE user_id % 4 WHEN 0 THEN 'same-day' WHEN 1 THEN 'routine' WHEN 2 THEN 'unsure'
  ELSE 'routine' END END AS effective_decision FROM r""")
def i24(spark, sf):
    e = B.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int") % 5
    pick = F.lit(None).cast("string")
    for i, s in enumerate(_SEV_PICK):
        pick = F.when(k == i, F.lit(s)).otherwise(pick)
    r = e.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.collect_set(pick).alias("reported"))   # bounded by the 5-item symptom menu
    u = F.col("user_id") % 4
    dec = F.when(u == 0, "same-day").when(u == 1, "routine").when(u == 2, "unsure").otherwise("routine")
    return r.select("user_id", "day", R.call_review_override(F.col("reported"), dec).alias("effective_decision"))


def _matrix_sql():
    t = "CASE WHEN temperature > 45 THEN (temperature - 32) * 5.0 / 9.0 ELSE temperature END"
    conds = ["spo2 < 92", "heart_rate < 60 OR heart_rate > 130", "respiratory_rate < 10 OR respiratory_rate > 30",
             "systolic_bp < 90", f"({t}) < 36.0 OR ({t}) > 39.0",
             "upper(trim(avpu)) IN ('V', 'VOICE', 'P', 'PAIN', 'U', 'UNRESPONSIVE')", "pain > 7",
             "list_contains(syms, 'chest pain')", "list_contains(syms, 'bleeding')", "list_contains(syms, 'convulsions')",
             "list_contains(syms, 'allergic reaction')", "list_contains(syms, 'active high-risk condition')",
             "list_contains(syms, 'safety conflict')"]
    ids = [r for r, _, _ in R.MATRIX_RULES]
    fired = "concat_ws(',', " + ", ".join(f"CASE WHEN COALESCE({c}, FALSE) THEN '{r}' END" for c, r in zip(conds, ids)) + ")"
    red = [r for r, s, _ in R.MATRIX_RULES if s == "RED"]
    return f"""m AS (SELECT user_id, day, {fired} AS matrix_rules FROM ctx),
m2 AS (SELECT *, string_split(matrix_rules, ',') AS lst FROM m)
SELECT user_id, day, matrix_rules,
  CASE WHEN matrix_rules = '' THEN 'GREEN' WHEN list_has_any(lst, [{", ".join(repr(r) for r in red)}]) THEN 'RED'
       ELSE 'YELLOW' END AS matrix_status,
  CASE WHEN matrix_rules = '' THEN 'None' ELSE COALESCE(list_filter(lst, lambda x: x IN ({", ".join(repr(r) for r in red)}))[1],
       lst[1]) END AS matrix_rule FROM m2"""


@query("i05b_rule_matrix", lambda: f"WITH {context_sql()},\n{_matrix_sql()}")
def i05b(spark, sf):
    m = R.matrix_assessment(B.clinical_context(spark, sf), symptoms="symptoms")
    return m.select("user_id", "day", "matrix_rules", "matrix_status", "matrix_rule")
