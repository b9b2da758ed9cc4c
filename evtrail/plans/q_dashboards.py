"""Registered service / dashboard queries (L).

Binding: appointments = orders (status from the order status, every 11th
cancelled); status events = an initial 'Scheduled' by the patient plus a
change one day later, made by someone else for every 7th appointment.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from evtrail.operators import dashboards as L
from evtrail.plans import bindings as B
from evtrail.plans.q_pointintime import E24_SQL, model_table_out
from evtrail.plans.registry import query
from evtrail.plans.sql_rules import assessment_sql, context_sql
from evtrail.plans.sqlsnips import CLASS_CASE

APPT_STATUS_SQL = """CASE WHEN o_orderkey % 11 = 0 THEN 'Cancelled' WHEN o_orderstatus = 'O' THEN 'Scheduled'
  WHEN o_orderstatus = 'P' THEN 'Rescheduled' ELSE 'Completed' END"""
APPTS_SQL = f"""ap AS (SELECT o_orderkey AS appointment_id, o_custkey AS patient_id, o_orderdate AS appointment_date,
  {APPT_STATUS_SQL} AS status FROM orders)"""


def appointments(spark, sf):
    o = B.table(spark, sf, "orders")
    st = (F.when(F.col("o_orderkey") % 11 == 0, "Cancelled").when(F.col("o_orderstatus") == "O", "Scheduled")
          .when(F.col("o_orderstatus") == "P", "Rescheduled").otherwise("Completed"))
    return o.select(F.col("o_orderkey").alias("appointment_id"), F.col("o_custkey").alias("patient_id"),
                    F.col("o_orderdate").alias("appointment_date"), st.alias("status"))


MT = lambda: f"mt AS (SELECT * FROM ({E24_SQL}) x)"


@query("l01_point_lookup", lambda: f"""WITH {MT()},
rq AS (SELECT entity_id, CASE WHEN entity_id % 3 = 0 THEN -1 ELSE min(index_id) END AS req_event FROM mt GROUP BY entity_id),
j AS (SELECT rq.entity_id, rq.req_event, mt.index_id, mt.index_date, CAST(mt.index_id = rq.req_event AS INTEGER) AS x
      FROM rq JOIN mt USING (entity_id))
SELECT entity_id, req_event, x AS exact_match, index_id, index_date FROM (
  SELECT *, row_number() OVER (PARTITION BY entity_id, req_event ORDER BY x DESC, index_date DESC, index_id DESC) AS rn
  FROM j) WHERE rn = 1""")
def l01(spark, sf):
    mt = model_table_out(spark, sf).select("entity_id", "index_id", "index_date")
    rq = mt.groupBy("entity_id").agg(F.when(F.col("entity_id") % 3 == 0, F.lit(-1)).otherwise(F.min("index_id"))
                                     .alias("req_event"))
    return L.lookup_or_latest(mt, rq, "entity_id", "index_id", "index_date").select(
        "entity_id", "req_event", "exact_match", "index_id", "index_date")


@query("l02_id_search", """
SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%00001%' ORDER BY c_custkey LIMIT 50""")
def l02(spark, sf):
    return L.id_search(B.table(spark, sf, "customer").select("c_custkey", "c_name"), "c_name", "00001", "c_custkey", 50)


@query("l03_flagged_top3", lambda: f"""WITH {MT()}
SELECT entity_id, index_id, n_emergency_365d FROM mt WHERE label = 1
ORDER BY n_emergency_365d DESC, index_id LIMIT 3""")
def l03(spark, sf):
    mt = model_table_out(spark, sf)
    return L.top_n(mt, F.col("label") == 1, [F.col("n_emergency_365d").desc(), F.col("index_id")], 3).select(
        "entity_id", "index_id", "n_emergency_365d")


@query("l04_dashboard_counts", lambda: f"""WITH {MT()}, {APPTS_SQL}
SELECT (SELECT count(*) FROM mt) AS rows,
  (SELECT count(DISTINCT entity_id) FROM mt WHERE n_emergency_90d >= 2) AS frequent_ed_patients,
  (SELECT count(*) FROM ap WHERE status = 'Scheduled') AS scheduled""")
def l04(spark, sf):
    return L.dashboard_counts(model_table_out(spark, sf), "entity_id", "n_emergency_90d", appointments(spark, sf),
                              "status")


@query("l05_newest_first", f"""WITH {APPTS_SQL}
SELECT patient_id, appointment_id, status, strftime(appointment_date, '%Y-%m-%d') AS appointment_date,
  row_number() OVER (PARTITION BY patient_id ORDER BY appointment_date DESC, appointment_id DESC) AS recency_rank
FROM ap""")
def l05(spark, sf):
    r = L.newest_first(appointments(spark, sf), "patient_id", "appointment_date", "appointment_id")
    return r.select("patient_id", "appointment_id", "status",
                    F.date_format("appointment_date", "yyyy-MM-dd").alias("appointment_date"), "recency_rank")


@query("l06_status_counts_with_all", f"""WITH {APPTS_SQL}
SELECT status, count(*) AS n FROM ap GROUP BY status UNION ALL SELECT 'All', count(*) FROM ap""")
def l06(spark, sf):
    return L.status_counts_with_all(appointments(spark, sf), "status")


@query("l06b_status_cube", f"""WITH {APPTS_SQL},
m AS (SELECT status, strftime(appointment_date, '%Y-%m') AS month FROM ap)
SELECT status, month, count(*) AS n FROM m GROUP BY status, month UNION ALL
SELECT status, 'All', count(*) FROM m GROUP BY status UNION ALL
SELECT 'All', month, count(*) FROM m GROUP BY month UNION ALL SELECT 'All', 'All', count(*) FROM m""")
def l06b(spark, sf):
    ap = appointments(spark, sf).withColumn("month", F.date_format("appointment_date", "yyyy-MM"))
    return L.status_cube(ap, ["status", "month"])


@query("l09b_patient_rows", f"""WITH {APPTS_SQL}
SELECT appointment_id, status, 'patient:17' AS viewer_id FROM ap WHERE patient_id = 17""")
def l09b(spark, sf):
    """The rows one patient may see."""
    return L.row_access(appointments(spark, sf), "patient:17", "patient", "patient_id", 17).select(
        "appointment_id", "status", "viewer_id")


def _status_events(spark, sf):
    ap = appointments(spark, sf)
    first = ap.select("appointment_id", F.lit("Scheduled").alias("status"), F.col("appointment_date").alias("ts"),
                      F.col("patient_id").alias("actor"), F.lit(0).alias("seq"))
    change = ap.where(F.col("status") != "Scheduled").select(
        "appointment_id", "status", (F.col("appointment_date") + F.expr("INTERVAL 1 DAY")).alias("ts"),
        F.when(F.col("appointment_id") % 7 == 0, F.col("patient_id") + 1).otherwise(F.col("patient_id")).alias("actor"),
        F.lit(1).alias("seq"))
    return first.unionByName(change), ap.select("appointment_id", F.col("patient_id").alias("owner"))


_EV_SQL = f"""{APPTS_SQL},
ev AS (SELECT appointment_id, 'Scheduled' AS status, appointment_date AS ts, patient_id AS actor, 0 AS seq FROM ap
  UNION ALL SELECT appointment_id, status, appointment_date + INTERVAL 1 DAY,
    CASE WHEN appointment_id % 7 = 0 THEN patient_id + 1 ELSE patient_id END, 1 FROM ap WHERE status <> 'Scheduled'),
j AS (SELECT ev.*, ap.patient_id AS owner FROM ev LEFT JOIN ap USING (appointment_id))"""


@query("l07_status_lifecycle", f"""WITH {_EV_SQL}
SELECT appointment_id, arg_max(status, seq) AS current_status, count(*) AS n_events FROM j WHERE actor = owner
GROUP BY appointment_id""")
def l07(spark, sf):
    ev, owners = _status_events(spark, sf)
    latest, _ = L.lifecycle(ev, owners, "appointment_id", "status", "ts", "actor", "owner", "seq")
    return latest


@query("l07b_status_rejects", f"""WITH {_EV_SQL}
SELECT appointment_id, status, actor FROM j WHERE actor <> owner OR owner IS NULL""")
def l07b(spark, sf):
    ev, owners = _status_events(spark, sf)
    _, rej = L.lifecycle(ev, owners, "appointment_id", "status", "ts", "actor", "owner", "seq")
    return rej.select("appointment_id", "status", "actor")


@query("l08_validated_append", f"""WITH {APPTS_SQL},
dec AS (SELECT appointment_id, status, CASE appointment_id % 5 WHEN 0 THEN 'APPROVE' WHEN 1 THEN 'MODIFY' WHEN 2 THEN 'REJECT'
  WHEN 3 THEN 'ESCALATE' ELSE 'BOGUS' END AS decision FROM ap)
SELECT 'appended' AS target, appointment_id, 'APPROVE' AS decision FROM dec WHERE status = 'Cancelled'
UNION ALL SELECT 'appended', appointment_id, decision FROM dec WHERE status <> 'Cancelled' AND decision <> 'BOGUS'
UNION ALL SELECT 'rejected', appointment_id, decision FROM dec WHERE status <> 'Cancelled' AND decision = 'BOGUS'""")
def l08(spark, sf):
    """The log already holds the cancelled appointments' decisions."""
    ap = appointments(spark, sf)
    k = F.col("appointment_id") % 5
    dec = ap.where(F.col("status") != "Cancelled").select(
        "appointment_id", F.when(k == 0, "APPROVE").when(k == 1, "MODIFY").when(k == 2, "REJECT")
        .when(k == 3, "ESCALATE").otherwise("BOGUS").alias("decision"))
    log = ap.where(F.col("status") == "Cancelled").select("appointment_id", F.lit("APPROVE").alias("decision"))
    appended, rejected = L.validated_append(log, dec, F.col("decision").isin("APPROVE", "MODIFY", "REJECT", "ESCALATE"))
    return (appended.select(F.lit("appended").alias("target"), "appointment_id", "decision")
            .unionByName(rejected.select(F.lit("rejected").alias("target"), "appointment_id", "decision")))


@query("l09_row_access", f"""WITH {APPTS_SQL},
v AS (SELECT 'patient:' || CAST(c_custkey AS VARCHAR) AS viewer_id, 'patient' AS role, c_custkey AS patient_id
      FROM customer UNION ALL SELECT 'manager:1', 'manager', NULL)
SELECT v.viewer_id, count(*) AS visible_rows FROM v JOIN ap ON v.role = 'manager' OR ap.patient_id = v.patient_id
GROUP BY v.viewer_id""")
def l09(spark, sf):
    c = B.table(spark, sf, "customer")
    pv = c.select(F.concat(F.lit("patient:"), F.col("c_custkey").cast("string")).alias("viewer_id"),
                  F.lit("patient").alias("role"), F.col("c_custkey").alias("patient_id"))
    mv = spark.createDataFrame([("manager:1", "manager", None)], "viewer_id string, role string, patient_id long")
    return L.visible_rows(appointments(spark, sf), pv.unionByName(mv), "patient_id")


@query("l10_monthly_trend", """
SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m') AS month, count(*) AS total,
  count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS flagged FROM orders GROUP BY 1""")
def l10(spark, sf):
    o = B.table(spark, sf, "orders")
    return L.monthly_trend(o, "o_orderdate", F.col("o_orderpriority") == "1-URGENT")


@query("l11_share_of_total", f"""
SELECT cls, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM (SELECT {CLASS_CASE} AS cls FROM orders) GROUP BY cls""")
def l11(spark, sf):
    s = L.share_of_total(B.encounters(spark, sf), "cls")
    return s.withColumn("share", F.round("share", 6))


@query("l12_trend_ranking", f"""
WITH c AS (SELECT cls, year(o_orderdate) AS period, count(*) AS n FROM (SELECT {CLASS_CASE} AS cls, o_orderdate
  FROM orders) GROUP BY ALL)
SELECT cls, CAST(period AS INTEGER) AS period, n, round(CASE WHEN lag(n) OVER (PARTITION BY cls ORDER BY period) > 0
  THEN (n - lag(n) OVER (PARTITION BY cls ORDER BY period)) * 100.0 / lag(n) OVER (PARTITION BY cls ORDER BY period)
  END, 6) AS trend_pct, rank FROM c JOIN (SELECT cls, CAST(row_number() OVER (ORDER BY arg_max(n, period) DESC, cls) AS INTEGER)
  AS rank FROM c GROUP BY cls) USING (cls)""")
def l12(spark, sf):
    t = L.trend_ranking(B.encounters(spark, sf), "cls", F.year("ts"))
    return t.withColumn("trend_pct", F.round("trend_pct", 6))


@query("l13_outreach_funnel", f"""WITH {APPTS_SQL}
SELECT strftime(date_trunc('month', appointment_date), '%Y-%m') AS month,
  count(*) FILTER (WHERE status = 'Scheduled') AS Scheduled, count(*) FILTER (WHERE status = 'Rescheduled') AS Rescheduled,
  count(*) FILTER (WHERE status = 'Completed') AS Completed, count(*) FILTER (WHERE status = 'Cancelled') AS Cancelled
FROM ap GROUP BY 1""")
def l13(spark, sf):
    return L.funnel(appointments(spark, sf), "appointment_date", "status",
                    ["Scheduled", "Rescheduled", "Completed", "Cancelled"])


@query("l14_cost_avoidance", """
SELECT count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS flagged, count(*) AS total,
  CAST(count(*) FILTER (WHERE o_orderpriority = '1-URGENT') * 1200.0 AS DOUBLE) AS cost_avoidance,
  round(count(*) FILTER (WHERE o_orderpriority = '1-URGENT') / count(*), 6) AS flag_rate FROM orders""")
def l14(spark, sf):
    c = L.cost_avoidance(B.table(spark, sf, "orders"), F.col("o_orderpriority") == "1-URGENT", 1200.0)
    return c.withColumn("flag_rate", F.round("flag_rate", 6))


@query("l15_vitals_persist", lambda: f"""WITH {context_sql()},\n{assessment_sql()}
SELECT user_id, day, CAST(CAST(ctx.temperature AS DECIMAL(5,2)) AS VARCHAR) AS temperature,
  CAST(CAST(ctx.spo2 AS DECIMAL(5,2)) AS VARCHAR) AS spo2, CAST(CAST(ctx.heart_rate AS DECIMAL(5,2)) AS VARCHAR) AS heart_rate,
  CAST(json_object('status', status, 'triggered_rule', triggered_rule, 'reason', reason) AS VARCHAR) AS payload
FROM sa JOIN ctx USING (user_id, day)""")
def l15(spark, sf):
    from evtrail.operators.rules import safety_assessment
    a = safety_assessment(B.clinical_context(spark, sf), symptoms="symptoms")
    # typed NUMERIC(5,2) as persisted; rendered as text so every result format agrees
    dec = {c: F.col(c).try_cast("decimal(5,2)").cast("string").alias(c) for c in ("temperature", "spo2", "heart_rate")}
    return a.select("user_id", "day", *dec.values(),
                    F.to_json(F.struct("status", "triggered_rule", "reason")).alias("payload"))


@query("l16_profile_view", """
WITH f AS (SELECT o_custkey, min(o_orderdate) AS first_ts FROM orders GROUP BY o_custkey),
m AS (SELECT max(o_orderdate) AS mx FROM orders)
SELECT c_custkey, c_name, CAST(floor(date_diff('day', CAST(first_ts AS DATE), CAST(mx AS DATE)) / 365.25) AS INTEGER) AS age,
  COALESCE(c_mktsegment, 'Unknown') AS gender FROM customer LEFT JOIN f ON f.o_custkey = c_custkey, m""")
def l16(spark, sf):
    o = B.table(spark, sf, "orders")
    f = o.groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_ts"))
    m = o.agg(F.max("o_orderdate").alias("mx"))
    c = B.table(spark, sf, "customer").join(f, F.col("c_custkey") == F.col("o_custkey"), "left").crossJoin(F.broadcast(m))
    return c.select("c_custkey", "c_name",
                    F.floor(F.datediff(F.to_date("mx"), F.to_date("first_ts")) / 365.25).cast("int").alias("age"),
                    F.coalesce("c_mktsegment", F.lit("Unknown")).alias("gender"))


@query("l17_latest_feature_row", lambda: f"""WITH {MT()}
SELECT entity_id, index_id, n_emergency_90d FROM (SELECT *, row_number() OVER (PARTITION BY entity_id
  ORDER BY index_date DESC, index_id DESC) AS rn FROM mt) WHERE rn = 1""")
def l17(spark, sf):
    from evtrail.operators.models import latest_per_entity
    mt = model_table_out(spark, sf).select("entity_id", "index_id", "index_date", "n_emergency_90d")
    return latest_per_entity(mt, "entity_id", "index_date", "index_id").select("entity_id", "index_id",
                                                                                "n_emergency_90d")


@query("l18_upcoming_past", f"""WITH {APPTS_SQL}
SELECT CASE WHEN status IN ('Scheduled', 'Rescheduled') THEN 'upcoming' ELSE 'past' END AS bucket, count(*) AS n
FROM ap GROUP BY 1""")
def l18(spark, sf):
    return L.upcoming_past(appointments(spark, sf), "status")
