"""Registered streaming queries (S1-S7): each drains a file stream over the
given tables into a checkpointed sink; the SQL twin is the batch result the
stream must reproduce."""

from __future__ import annotations

from pyspark.sql import functions as F

from evtrail.plans import bindings as B
from evtrail.plans.registry import query
from evtrail.plans.sql_rules import assessment_sql
from evtrail.streaming import jobs as S

_K = "CAST(props->>'k' AS INTEGER)"


def _event_ctx_sql() -> str:
    vit = ",\n".join(f"  CASE WHEN event_type = '{et}' THEN round(value * {sc} + {off}, 1) END AS {vn}"
                     for et, (vn, sc, off) in B.VITAL_OF_EVENT.items())
    sym = "CASE " + " ".join(f"WHEN {_K} % 20 = {r} AND {str(v).upper()} THEN '{t.strip().lower()}'"
                             for r, (t, v) in B.SYMPTOM_OF_K.items()) + " END"
    avpu = "CASE " + " ".join(f"WHEN {_K} % 25 = {r} THEN '{t}'" for r, t in B.AVPU_OF_K.items()) + " END"
    return f"""ctx AS (SELECT event_id, user_id, ts,
{vit},
  {avpu} AS avpu, CASE WHEN event_type = 'error' THEN CAST({_K} % 11 AS DOUBLE) END AS pain,
  CASE WHEN {sym} IS NULL THEN []::VARCHAR[] ELSE [{sym}] END AS syms FROM events)"""


S1_SQL = lambda: f"WITH {_event_ctx_sql()},\n{assessment_sql('ctx', 'event_id, user_id, ts')}\n"


@query("s01_stream_safety", lambda: S1_SQL() + "SELECT event_id, status, triggered_rule FROM sa")
def s01(spark, sf):
    out = S.run_available(S.s1_safety(S.stream_table(spark, sf, "events")), "s01")
    return out.select("event_id", "status", "triggered_rule")


# append mode: a window is written once, when the watermark (an hour behind
# the latest event) has passed its end
_CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


def _windows(out):
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n",
                      F.round("value_sum", 6).alias("value_sum"))


@query("s02_stream_windows", f"""
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n,
  round(sum(value), 6) AS value_sum FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= {_CLOSED} GROUP BY ALL""")
def s02(spark, sf):
    return _windows(S.run_available(S.s2_windowed_counts(S.stream_table(spark, sf, "events")), "s02"))


@query("s02b_stream_sliding", f"""
WITH e AS (SELECT *, time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 12 HOUR * i AS w
  FROM events, range(0, 2) r(i))
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n,
  round(sum(value), 6) AS value_sum FROM e WHERE w + INTERVAL 1 DAY <= {_CLOSED} GROUP BY ALL""")
def s02b(spark, sf):
    return _windows(S.run_available(S.s2_windowed_counts(S.stream_table(spark, sf, "events"), slide="12 hours"), "s02b"))


@query("s03_stream_sessions", f"""
WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL
  OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM e)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS session_start,
  strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S.%f') AS session_end, count(*) AS n_events
FROM s GROUP BY user_id, sid HAVING max(ts) + INTERVAL 30 MINUTE <= {_CLOSED}""")
def s03(spark, sf):
    out = S.run_available(S.s3_sessions(S.stream_table(spark, sf, "events")), "s03")
    return out.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("session_start"),
                      F.date_format("session_end", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("session_end"), "n_events")


def _s4_sql():
    from evtrail.plans.q_rules import _i16_sql
    return _i16_sql()


@query("s04_stream_reassessment", lambda: _s4_sql())
def s04(spark, sf):
    out = S.run_available(S.s4_sessions(S.stream_table(spark, sf, "events")), "s04", S.s4_reassess_batch(2))
    return out.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("s05_stream_dedup", """
SELECT DISTINCT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day FROM events""")
def s05(spark, sf):
    out = S.run_available(S.s5_dedup(S.stream_table(spark, sf, "events")), "s05")
    return out.select("user_id", "event_type", "day")


@query("s06_stream_interval_join", """
SELECT a.user_id, a.event_id AS anchor_id, o.event_id AS outcome_id FROM events a JOIN events o ON a.user_id = o.user_id
  AND a.event_type = 'error' AND o.event_type = 'purchase' AND o.ts > a.ts AND o.ts <= a.ts + INTERVAL 1 DAY""")
def s06(spark, sf):
    ev_a = S.stream_table(spark, sf, "events").where(F.col("event_type") == "error")
    ev_o = S.stream_table(spark, sf, "events").where(F.col("event_type") == "purchase")
    out = S.run_available(S.s6_interval_join(ev_a, ev_o, "1 day"), "s06")
    return out.select("user_id", "anchor_id", "outcome_id")


@query("s07_stream_upsert", """
SELECT o_custkey, o_orderstatus AS status FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
  ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def s07(spark, sf):
    o = S.stream_table(spark, sf, "orders").select("o_custkey", F.col("o_orderstatus").alias("status"),
                                                  F.struct("o_orderdate", "o_orderkey").alias("ord"))
    sink = S.run_available(o, "s07", batch_fn=S.s7_upsert_batch("o_custkey", "status", "ord"))
    return S.s7_read_state(sink, "o_custkey", "status")
