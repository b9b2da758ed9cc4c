"""Registered point-in-time queries (E) bound to the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evtrail.operators import pointintime as pit
from evtrail.operators.claims import collapse_claims, los_days
from evtrail.plans import bindings as B
from evtrail.plans.model_table import build_model_table
from evtrail.plans.registry import query
from evtrail.plans.sqlsnips import CLAIM_LINES, DAYNUM, ENC, IDX, INTERVALS, MAXDAY, with_


def _date(c):
    return F.date_format(c, "yyyy-MM-dd")


def _enc_daily(spark, sf):
    enc = B.encounters(spark, sf)
    return enc, pit.daily_rollup(enc, "entity_id", "ts",
                                 counts={"n_emergency": F.col("cls") == "emergency"},
                                 mins={"_first": F.when(F.col("cls") == "emergency",
                                                        F.struct(F.col("ts").alias("t"), F.col("event_id").alias("i"))),
                                       "_first_ts": F.when(F.col("cls") == "emergency", F.col("ts"))})


# ---------------------------------------------------------------- E1 ------
@query("e01_index_cohort", with_(ENC, IDX) + """
SELECT entity_id, index_id, strftime(index_ts, '%Y-%m-%d') AS index_date FROM idx""")
def e01(spark, sf):
    enc = B.encounters(spark, sf)
    idx = pit.index_cohort(enc, "entity_id", "ts", "event_id", F.col("cls") == "emergency")
    return idx.select("entity_id", "index_id", _date("index_ts").alias("index_date"))


# ---------------------------------------------------------------- E2 ------
@query("e02_followup_censoring", with_(ENC, IDX, MAXDAY) + """
SELECT entity_id, index_id FROM idx, mx WHERE day + 90 <= max_day""")
def e02(spark, sf):
    enc = B.encounters(spark, sf)
    idx = pit.index_cohort(enc, "entity_id", "ts", "event_id", F.col("cls") == "emergency")
    return pit.censor_followup(idx, pit.max_event_day(enc, "ts"), 90).select("entity_id", "index_id")


# ---------------------------------------------------------------- E3 ------
@query("e03_label_lookahead", with_(ENC, IDX) + """
SELECT i.entity_id, i.index_id,
       CAST(EXISTS (SELECT 1 FROM ev f WHERE f.entity_id = i.entity_id AND f.cls = 'emergency'
                    AND f.day > i.day AND f.day <= i.day + 90) AS INTEGER) AS label
FROM idx i""")
def e03(spark, sf):
    _, daily = _enc_daily(spark, sf)
    d = pit.lookahead_any(daily, "entity_id", "n_emergency", 90, "label")
    return d.where(F.col("_first").isNotNull()).select("entity_id", F.col("_first.i").alias("index_id"), "label")


# ---------------------------------------------------------------- E4 ------
@query("e04_label_hybrid", with_(ENC, IDX) + """
SELECT i.entity_id, i.index_id,
       CAST(EXISTS (SELECT 1 FROM ev f WHERE f.entity_id = i.entity_id AND f.cls = 'emergency'
                    AND f.day > i.day AND f.ts <= i.index_ts + INTERVAL 90 DAY) AS INTEGER) AS label
FROM idx i""")
def e04(spark, sf):
    _, daily = _enc_daily(spark, sf)
    d = pit.next_event_ts_after_day(daily, "entity_id", "_first_ts", "next_ts")
    d = d.where(F.col("_first").isNotNull())
    return d.select("entity_id", F.col("_first.i").alias("index_id"),
                    pit.label_hybrid(F.col("_first.t"), F.col("next_ts"), 90).alias("label"))


# ---------------------------------------------------------------- E5 ------
@query("e05_gap_label", with_(ENC) + """
SELECT entity_id, event_id, gap_days, CAST(gap_days > 0 AND gap_days <= 90 AS INTEGER) AS label_gap FROM (
  SELECT entity_id, event_id,
         COALESCE(lead(day) OVER (PARTITION BY entity_id ORDER BY ts, event_id) - day, 0) AS gap_days
  FROM ev WHERE cls = 'emergency')""")
def e05(spark, sf):
    enc = B.encounters(spark, sf).where(F.col("cls") == "emergency")
    g = pit.gap_to_next_label(enc, "entity_id", "ts", "event_id", 90)
    return g.select("entity_id", "event_id", F.coalesce("gap_days", F.lit(0)).alias("gap_days"), "label_gap")


# ---------------------------------------------------------------- E6 ------
# Competing event ("death") bound as: last order date of customers with a
# negative account balance.
_DEATH_SQL = """death AS (SELECT o_custkey AS entity_id, max(o_orderdate) AS death_ts
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0 GROUP BY o_custkey)"""


def _death(spark, sf):
    o = B.table(spark, sf, "orders")
    c = B.table(spark, sf, "customer").where(F.col("c_acctbal") < 0).select("c_custkey")
    return (o.join(c, o.o_custkey == c.c_custkey, "left_semi").groupBy(F.col("o_custkey").alias("entity_id"))
            .agg(F.max("o_orderdate").alias("death_ts")))


@query("e06_competing_exclusion", with_(ENC, IDX, _DEATH_SQL) + """,
lab AS (SELECT i.*, CAST(EXISTS (SELECT 1 FROM ev f WHERE f.entity_id = i.entity_id AND f.cls = 'emergency'
                    AND f.day > i.day AND f.day <= i.day + 90) AS INTEGER) AS label FROM idx i),
pol AS (SELECT 'always' AS policy UNION ALL SELECT 'label0' UNION ALL SELECT 'strict')
SELECT policy, COALESCE(reason, 'kept') AS reason, count(*) AS n FROM (
  SELECT p.policy, CASE WHEN d.death_ts IS NOT NULL AND (
        (p.policy = 'always' AND d.death_ts <= l.index_ts + INTERVAL 90 DAY) OR
        (p.policy = 'label0' AND d.death_ts <= l.index_ts + INTERVAL 90 DAY AND l.label = 0) OR
        (p.policy = 'strict' AND d.death_ts > l.index_ts AND d.death_ts <= l.index_ts + INTERVAL 90 DAY))
      THEN 'competing_event' END AS reason
  FROM lab l LEFT JOIN death d ON l.entity_id = d.entity_id CROSS JOIN pol p)
GROUP BY ALL""")
def e06(spark, sf):
    _, daily = _enc_daily(spark, sf)
    d = pit.lookahead_any(daily, "entity_id", "n_emergency", 90, "label").where(F.col("_first").isNotNull())
    d = d.select("entity_id", F.col("_first.t").alias("index_ts"), "label").join(_death(spark, sf), "entity_id", "left")
    outs = []
    for pol in ("always", "label0", "strict"):
        outs.append(pit.exclude_competing(d, "death_ts", "index_ts", "label", pol)
                    .select(F.lit(pol).alias("policy"), "exclusion_reason"))
    u = outs[0].unionByName(outs[1]).unionByName(outs[2])
    return (u.groupBy("policy", F.coalesce("exclusion_reason", F.lit("kept")).alias("reason"))
            .agg(F.count(F.lit(1)).alias("n")))


# ------------------------------------------------------------ E7 E8 E9 E10 -
_WIN_SQL = "\n".join(
    f"       count(*) FILTER (WHERE h.cls = '{c}' AND h.day >= i.day - {w} AND h.day < i.day) AS n_{c}_{w}d,"
    for c in ("emergency", "inpatient", "outpatient") for w in (30, 90, 365))
_SUM_SQL = "\n".join(
    f"       round(COALESCE(sum(h.cost) FILTER (WHERE h.day >= i.day - {w} AND h.day < i.day), 0), 2) AS cost_{w}d,"
    for w in (30, 90, 365))

E24_SQL = with_(ENC, IDX, MAXDAY) + f""",
f AS (
  SELECT i.entity_id, i.index_id, i.day, i.index_ts,
{_WIN_SQL}
{_SUM_SQL}
       COALESCE(sum(h.cost) FILTER (WHERE h.day >= i.day - 30 AND h.day < i.day), 0) AS c30,
       COALESCE(sum(h.cost) FILTER (WHERE h.day >= i.day - 90 AND h.day < i.day), 0) AS c90,
       count(h.event_id) AS hist_visits,
       count(*) FILTER (WHERE h.cls = 'emergency') AS hist_emergency,
       i.day - max(h.day) AS days_since_prev_visit,
       i.day - max(h.day) FILTER (WHERE h.cls = 'emergency') AS days_since_prev_emergency
  FROM idx i LEFT JOIN ev h ON h.entity_id = i.entity_id AND h.day < i.day
  GROUP BY i.entity_id, i.index_id, i.day, i.index_ts)
SELECT f.entity_id, f.index_id, strftime(f.index_ts, '%Y-%m-%d') AS index_date,
       {", ".join(f"n_{c}_{w}d" for c in ("emergency", "inpatient", "outpatient") for w in (30, 90, 365))},
       cost_30d, cost_90d, cost_365d, hist_visits, hist_emergency,
       CAST(days_since_prev_visit AS DOUBLE) AS days_since_prev_visit,
       CAST(days_since_prev_emergency AS DOUBLE) AS days_since_prev_emergency,
       round(c30 / (c90 + 1), 6) AS cost_velocity,
       round(n_emergency_365d / (n_outpatient_365d + 1), 6) AS ed_out_ratio,
       CAST(n_emergency_30d * 3 > n_emergency_90d AS INTEGER) AS accelerating,
       CAST(EXISTS (SELECT 1 FROM ev g WHERE g.entity_id = f.entity_id AND g.cls = 'emergency'
                    AND g.day > f.day AND g.day <= f.day + 90) AS INTEGER) AS label,
       c.c_mktsegment AS segment, n.n_name AS nation
FROM f CROSS JOIN mx
LEFT JOIN customer c ON c.c_custkey = f.entity_id
LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
WHERE f.day + 90 <= mx.max_day"""


def model_table_out(spark, sf):
    enc = B.encounters(spark, sf)
    mt = build_model_table(enc)
    cust = B.table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    nat = B.table(spark, sf, "nation").select("n_nationkey", "n_name")
    demo = cust.join(nat, cust.c_nationkey == nat.n_nationkey, "left")  # E18 demographic attach
    mt = mt.join(demo, mt.entity_id == demo.c_custkey, "left")
    cols = [f"n_{c}_{w}d" for c in ("emergency", "inpatient", "outpatient") for w in (30, 90, 365)]
    return mt.select(
        "entity_id", "index_id", _date("index_ts").alias("index_date"), *cols,
        *[F.round(f"cost_{w}d", 2).alias(f"cost_{w}d") for w in (30, 90, 365)],
        "hist_visits", "hist_emergency",
        # nullable integers leave as DOUBLE so every result format agrees
        F.col("days_since_prev_visit").cast("double").alias("days_since_prev_visit"),
        F.col("days_since_prev_emergency").cast("double").alias("days_since_prev_emergency"),
        F.round("cost_velocity", 6).alias("cost_velocity"), F.round("ed_out_ratio", 6).alias("ed_out_ratio"),
        "accelerating", "label", F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"))


@query("e24_model_table", E24_SQL)
def e24(spark, sf):
    return model_table_out(spark, sf)


@query("e07_lookback_counts", with_(ENC, IDX) + f"""
SELECT i.entity_id, i.index_id,
{_WIN_SQL.rstrip(',')}
FROM idx i LEFT JOIN ev h ON h.entity_id = i.entity_id AND h.day < i.day
GROUP BY i.entity_id, i.index_id""")
def e07(spark, sf):
    enc = B.encounters(spark, sf)
    classes = ("emergency", "inpatient", "outpatient")
    daily = pit.daily_rollup(enc, "entity_id", "ts", counts={f"n_{c}": F.col("cls") == c for c in classes},
                             mins={"_first": F.when(F.col("cls") == "emergency",
                                                    F.struct(F.col("ts").alias("t"), F.col("event_id").alias("i")))})
    f = pit.lookback(daily, "entity_id", (30, 90, 365), count_cols=[f"n_{c}" for c in classes])
    return f.where(F.col("_first").isNotNull()).select(
        "entity_id", F.col("_first.i").alias("index_id"),
        *[f"n_{c}_{w}d" for c in classes for w in (30, 90, 365)])


@query("e08_lookback_sums", with_(ENC, IDX) + f"""
SELECT i.entity_id, i.index_id,
{_SUM_SQL.rstrip(',')}
FROM idx i LEFT JOIN ev h ON h.entity_id = i.entity_id AND h.day < i.day
GROUP BY i.entity_id, i.index_id""")
def e08(spark, sf):
    enc = B.encounters(spark, sf)
    daily = pit.daily_rollup(enc, "entity_id", "ts", sums={"cost": F.col("cost")},
                             mins={"_first": F.when(F.col("cls") == "emergency",
                                                    F.struct(F.col("ts").alias("t"), F.col("event_id").alias("i")))})
    f = pit.lookback(daily, "entity_id", (30, 90, 365), sum_cols=["cost"])
    return f.where(F.col("_first").isNotNull()).select(
        "entity_id", F.col("_first.i").alias("index_id"),
        *[F.round(f"cost_{w}d", 2).alias(f"cost_{w}d") for w in (30, 90, 365)])


@query("e09_recency", with_(ENC, IDX) + """
SELECT i.entity_id, i.index_id,
       COALESCE(CAST(i.day - max(h.day) AS BIGINT), 9999) AS days_since_prev_visit,
       CAST(i.day - max(h.day) FILTER (WHERE h.cls = 'emergency') AS DOUBLE) AS days_since_prev_emergency
FROM idx i LEFT JOIN ev h ON h.entity_id = i.entity_id AND h.day < i.day
GROUP BY i.entity_id, i.index_id, i.day""")
def e09(spark, sf):
    _, daily = _enc_daily(spark, sf)
    a = pit.recency(daily, "entity_id", {"days_since_prev_visit": None}, missing=9999)   # v1 sentinel
    a = pit.recency(a, "entity_id", {"days_since_prev_emergency": "n_emergency"})          # v2 null
    return a.where(F.col("_first").isNotNull()).select(
        "entity_id", F.col("_first.i").alias("index_id"), "days_since_prev_visit",
        F.col("days_since_prev_emergency").cast("double").alias("days_since_prev_emergency"))


@query("e10_history_counts", with_(ENC, IDX, INTERVALS) + """,
first_code AS (SELECT entity_id, code, min(date_diff('day', DATE '1970-01-01', CAST(start_ts AS DATE))) AS d0
               FROM iv WHERE code IS NOT NULL AND start_ts IS NOT NULL GROUP BY ALL)
SELECT i.entity_id, i.index_id,
       (SELECT count(*) FROM ev h WHERE h.entity_id = i.entity_id AND h.day < i.day) AS hist_visits,
       (SELECT count(*) FROM first_code f WHERE f.entity_id = i.entity_id AND f.d0 < i.day) AS hist_distinct_codes
FROM idx i""")
def e10(spark, sf):
    enc, daily = _enc_daily(spark, sf)
    h = pit.history_before(daily, "entity_id", ["n_events"]).where(F.col("_first").isNotNull())
    h = h.select("entity_id", F.col("_first.i").alias("index_id"), "day", F.col("hist_n_events").alias("hist_visits"))
    iv = B.intervals(spark, sf).withColumn("d", pit.day_number("start_ts"))
    h = pit.distinct_in_window(iv, h, "entity_id", "d", "code", None, "hist_distinct_codes", query_day="day")
    return h.select("entity_id", "index_id", "hist_visits",
                    F.coalesce("hist_distinct_codes", F.lit(0)).alias("hist_distinct_codes"))


def _idx_with_ts(spark, sf):
    enc = B.encounters(spark, sf)
    return pit.index_cohort(enc, "entity_id", "ts", "event_id", F.col("cls") == "emergency")


@query("e11_active_intervals", with_(ENC, IDX, INTERVALS) + """
SELECT i.entity_id, i.index_id,
  (SELECT count(*) FROM iv WHERE iv.entity_id = i.entity_id AND iv.kind = 'condition' AND iv.start_ts < i.index_ts
     AND (iv.stop_ts IS NULL OR iv.stop_ts >= i.index_ts)) AS active_conditions,
  (SELECT count(*) FROM iv WHERE iv.entity_id = i.entity_id AND iv.kind = 'medication' AND iv.start_ts < i.index_ts
     AND (iv.stop_ts IS NULL OR iv.stop_ts >= i.index_ts)) AS active_medications
FROM idx i""")
def e11(spark, sf):
    idx = _idx_with_ts(spark, sf)
    iv = B.intervals(spark, sf)
    out = pit.active_by_kind(iv, idx, "entity_id", "start_ts", "stop_ts", "index_ts", "kind",
                             ["condition", "medication"], mode="v1")
    return out.select("entity_id", "index_id", F.col("active_condition").alias("active_conditions"),
                      F.col("active_medication").alias("active_medications"))


@query("e12_long_standing_active", with_(ENC, IDX, INTERVALS) + """
SELECT i.entity_id, i.index_id,
  (SELECT count(*) FROM iv WHERE iv.entity_id = i.entity_id AND iv.kind = 'condition'
     AND iv.start_ts <= i.index_ts - INTERVAL 365 DAY
     AND (iv.stop_ts IS NULL OR iv.stop_ts >= i.index_ts)) AS long_standing_conditions
FROM idx i""")
def e12(spark, sf):
    idx = _idx_with_ts(spark, sf)
    iv = B.intervals(spark, sf).where(F.col("kind") == "condition")
    out = pit.active_at(iv, idx, "entity_id", "start_ts", "stop_ts", "index_ts", "long_standing_conditions",
                        mode="v1", min_age_days=365)
    return out.select("entity_id", "index_id",
                      F.coalesce("long_standing_conditions", F.lit(0)).alias("long_standing_conditions"))


E13_SQL = with_(ENC, IDX, CLAIM_LINES) + """,
cd AS (SELECT DISTINCT member_id, provider_id, date_diff('day', DATE '1970-01-01', CAST(from_ts AS DATE)) AS d
       FROM cl WHERE provider_id IS NOT NULL)
SELECT i.entity_id, i.index_id,
  (SELECT count(DISTINCT provider_id) FROM cd WHERE cd.member_id = i.entity_id
     AND cd.d >= i.day - 365 AND cd.d < i.day) AS distinct_providers_365d
FROM idx i"""


@query("e13_distinct_providers_365d", E13_SQL)
def e13(spark, sf):
    idx = _idx_with_ts(spark, sf)
    cl = B.claim_lines(spark, sf).withColumn("d", pit.day_number("from_ts"))
    cl = cl.withColumnRenamed("member_id", "entity_id")
    out = pit.distinct_in_window(cl, idx, "entity_id", "d", "provider_id", 365, "distinct_providers_365d",
                                 rows=B.n_lines(spark, sf))
    return out.select("entity_id", "index_id",
                      F.coalesce("distinct_providers_365d", F.lit(0)).alias("distinct_providers_365d"))


# Last completed inpatient stay (claims) strictly before the index day.
E16_SQL = with_(ENC, IDX, CLAIM_LINES) + """,
stays AS (SELECT claim_id, member_id, min(from_ts) AS adm, max(thru_ts) AS dis FROM cl
          WHERE cls = 'inpatient' GROUP BY claim_id, member_id),
s2 AS (SELECT member_id, claim_id, date_diff('day', CAST(adm AS DATE), CAST(dis AS DATE)) AS los, dis,
              date_diff('day', DATE '1970-01-01', CAST(dis AS DATE)) AS dday FROM stays)
SELECT i.entity_id, i.index_id, COALESCE((
   SELECT los FROM s2 WHERE s2.member_id = i.entity_id AND s2.dday < i.day
   ORDER BY dday DESC, dis DESC, claim_id DESC LIMIT 1), 0) AS last_los
FROM idx i"""


@query("e16_last_stay_los", E16_SQL)
def e16(spark, sf):
    idx = _idx_with_ts(spark, sf)
    cl = B.claim_lines(spark, sf).where(F.col("cls") == "inpatient")
    stays = collapse_claims(cl, "claim_id", "segment", code_prefix=None, first_cols=["member_id"],
                            min_ts=["from_ts"], max_ts=["thru_ts"])
    stays = stays.select(F.col("member_id").alias("entity_id"), "claim_id",
                         los_days("from_ts", "thru_ts").alias("los"), pit.day_number("thru_ts").alias("dday"),
                         F.struct("thru_ts", "claim_id").alias("_ord"))
    out = pit.asof_last_before(idx, stays.withColumnRenamed("dday", "day"), "entity_id", "day", "los", "_ord",
                               "last_los", strict=True)
    return out.select("entity_id", "index_id", F.coalesce("last_los", F.lit(0)).cast("long").alias("last_los"))


# ---------------------------------------------------------------- E17 -----
# Birth-date binding: a customer's first order date (tenure in years).
@query("e17_age_at_index", with_(ENC, IDX) + """,
b AS (SELECT entity_id, min(ts) AS born FROM ev GROUP BY entity_id)
SELECT i.entity_id, i.index_id,
  round(least(greatest(date_diff('day', CAST(b.born AS DATE), CAST(i.index_ts AS DATE)) / 365.25, 0.0), 120.0), 6) AS age
FROM idx i JOIN b USING (entity_id)""")
def e17(spark, sf):
    enc = B.encounters(spark, sf)
    born = enc.groupBy("entity_id").agg(F.min("ts").alias("born"))
    idx = _idx_with_ts(spark, sf).join(born, "entity_id")
    return idx.select("entity_id", "index_id", F.round(pit.age_years("index_ts", "born", (0.0, 120.0)), 6).alias("age"))


# ---------------------------------------------------------------- E19 -----
@query("e19_entity_year_attach", with_(ENC, IDX) + """,
ey AS (SELECT entity_id, year(ts) AS year, count(DISTINCT month(ts)) AS coverage_months,
   max(CAST(cls = 'emergency' AS INTEGER)) + max(CAST(cls = 'inpatient' AS INTEGER)) AS burden FROM ev GROUP BY ALL)
SELECT i.entity_id, i.index_id, CAST(ey.coverage_months AS DOUBLE) AS prior_year_coverage_months,
  CAST(ey.burden AS DOUBLE) AS prior_year_burden
FROM idx i LEFT JOIN ey ON ey.entity_id = i.entity_id AND ey.year = year(i.index_ts) - 1""")
def e19(spark, sf):
    from evtrail.operators.claims import entity_year
    enc = B.encounters(spark, sf)
    ey = entity_year(enc, "entity_id", "ts", {"f_e": F.col("cls") == "emergency", "f_i": F.col("cls") == "inpatient"})
    idx = _idx_with_ts(spark, sf).withColumn("year", F.year("index_ts") - 1)      # prior year: no leakage
    j = idx.join(ey, ["entity_id", "year"], "left")
    # nullable integers leave as DOUBLE so every result format agrees
    return j.select("entity_id", "index_id", F.col("coverage_months").cast("double").alias("prior_year_coverage_months"),
                    F.col("burden").cast("double").alias("prior_year_burden"))


# ---------------------------------------------------------------- E20 -----
_CODED_SQL = """,
cc AS (SELECT claim_id, min(member_id) AS member_id, min(from_ts) AS from_ts,
   count(*) FILTER (WHERE CAST(code_1 AS BIGINT) % 4 <> 0) AS n_coded_lines FROM cl GROUP BY claim_id),
cd AS (SELECT member_id, date_diff('day', DATE '1970-01-01', CAST(from_ts AS DATE)) AS d, n_coded_lines FROM cc)"""


def _coded_claims(spark, sf):
    cl = B.claim_lines(spark, sf)
    c = cl.groupBy("claim_id").agg(F.min("member_id").alias("entity_id"), F.min("from_ts").alias("from_ts"),
                                   F.count(F.when(F.col("code_1").cast("long") % 4 != 0, 1)).alias("n_coded_lines"))
    return c.withColumn("d", pit.day_number("from_ts"))


@query("e20_coded_visit_counts", with_(ENC, IDX, CLAIM_LINES) + _CODED_SQL + """
SELECT i.entity_id, i.index_id, (SELECT count(*) FROM cd WHERE cd.member_id = i.entity_id AND n_coded_lines > 0
  AND cd.d >= i.day - 90 AND cd.d < i.day) AS coded_visits_90d FROM idx i""")
def e20(spark, sf):
    c = _coded_claims(spark, sf).where(F.col("n_coded_lines") > 0)
    idx = _idx_with_ts(spark, sf)
    out = pit.sum_in_day_window(idx, c, "entity_id", "day", "d", F.lit(1), -90, -1, "coded_visits_90d")
    return out.select("entity_id", "index_id", F.col("coded_visits_90d").cast("long").alias("coded_visits_90d"))


# ---------------------------------------------------------------- E27 -----
@query("e27_procedure_intensity", with_(ENC, IDX, CLAIM_LINES) + _CODED_SQL + """
SELECT i.entity_id, i.index_id, COALESCE((SELECT sum(n_coded_lines) FROM cd WHERE cd.member_id = i.entity_id
  AND cd.d >= i.day - 90 AND cd.d < i.day), 0)::BIGINT AS procedure_intensity_90d FROM idx i""")
def e27(spark, sf):
    c = _coded_claims(spark, sf)
    idx = _idx_with_ts(spark, sf)
    out = pit.sum_in_day_window(idx, c, "entity_id", "day", "d", F.col("n_coded_lines"), -90, -1,
                                "procedure_intensity_90d")
    return out.select("entity_id", "index_id", F.col("procedure_intensity_90d").cast("long")
                      .alias("procedure_intensity_90d"))


# ---------------------------------------------------------------- E25 -----
@query("e25_code_pattern_flag", with_(ENC, IDX, CLAIM_LINES) + """,
fl AS (SELECT member_id, date_diff('day', DATE '1970-01-01', CAST(from_ts AS DATE)) AS d FROM cl
       WHERE regexp_matches(code_1, '^13'))
SELECT i.entity_id, i.index_id, CAST(EXISTS (SELECT 1 FROM fl WHERE fl.member_id = i.entity_id AND fl.d >= i.day - 90
  AND fl.d < i.day) AS INTEGER) AS code_pattern_90d FROM idx i""")
def e25(spark, sf):
    cl = B.claim_lines(spark, sf).where(F.col("code_1").rlike("^13")).withColumn("d", pit.day_number("from_ts"))
    idx = _idx_with_ts(spark, sf)
    out = pit.sum_in_day_window(idx, cl.withColumnRenamed("member_id", "entity_id"), "entity_id", "day", "d",
                                F.lit(1), -90, -1, "_n")
    return out.select("entity_id", "index_id", (F.col("_n") > 0).cast("int").alias("code_pattern_90d"))


# ---------------------------------------------------------------- E26 / E28
@query("e26_code_category_diversity", with_(ENC, IDX, CLAIM_LINES) + """,
cc AS (SELECT DISTINCT member_id, left(code_1, 3) AS cat, date_diff('day', DATE '1970-01-01', CAST(from_ts AS DATE)) AS d
       FROM cl)
SELECT i.entity_id, i.index_id, (SELECT count(DISTINCT cat) FROM cc WHERE cc.member_id = i.entity_id
  AND cc.d >= i.day - 365 AND cc.d < i.day) AS code_categories_365d FROM idx i""")
def e26(spark, sf):
    cl = (B.claim_lines(spark, sf).withColumn("d", pit.day_number("from_ts"))
          .withColumn("cat", F.substring("code_1", 1, 3)).withColumnRenamed("member_id", "entity_id"))
    idx = _idx_with_ts(spark, sf)
    out = pit.distinct_in_window(cl, idx, "entity_id", "d", "cat", 365, "code_categories_365d",
                                 rows=B.n_lines(spark, sf))
    return out.select("entity_id", "index_id", F.coalesce("code_categories_365d", F.lit(0))
                      .alias("code_categories_365d"))


@query("e28_distinct_facilities_365d", with_(ENC, IDX, CLAIM_LINES) + """,
cf AS (SELECT DISTINCT cl.member_id, s.s_nationkey AS fac, date_diff('day', DATE '1970-01-01', CAST(cl.from_ts AS DATE)) AS d
       FROM cl JOIN supplier s ON s.s_suppkey = cl.provider_id)
SELECT i.entity_id, i.index_id, (SELECT count(DISTINCT fac) FROM cf WHERE cf.member_id = i.entity_id
  AND cf.d >= i.day - 365 AND cf.d < i.day) AS distinct_facilities_365d FROM idx i""")
def e28(spark, sf):
    s = B.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("provider_id"), F.col("s_nationkey").alias("fac"))
    cl = (B.claim_lines(spark, sf).join(s, "provider_id").withColumn("d", pit.day_number("from_ts"))
          .withColumnRenamed("member_id", "entity_id"))
    idx = _idx_with_ts(spark, sf)
    out = pit.distinct_in_window(cl, idx, "entity_id", "d", "fac", 365, "distinct_facilities_365d",
                                 rows=B.n_lines(spark, sf))
    return out.select("entity_id", "index_id", F.coalesce("distinct_facilities_365d", F.lit(0))
                      .alias("distinct_facilities_365d"))


# ---------------------------------------------------------------- E22 -----
@query("e22_current_context", with_(ENC, IDX, INTERVALS) + """
SELECT i.entity_id, i.index_id,
""" + ",\n".join(f"""  (SELECT count(*) FROM iv WHERE iv.entity_id = i.entity_id AND iv.kind = '{k}' AND iv.start_ts <= i.index_ts
     AND (iv.stop_ts IS NULL OR iv.stop_ts > i.index_ts)) AS active_{k}""" for k in ("condition", "medication", "allergy"))
       + "\nFROM idx i")
def e22(spark, sf):
    kinds = ["condition", "medication", "allergy"]
    out = pit.active_by_kind(B.intervals(spark, sf), _idx_with_ts(spark, sf), "entity_id", "start_ts", "stop_ts",
                             "index_ts", "kind", kinds, mode="context")
    return out.select("entity_id", "index_id", *[f"active_{k}" for k in kinds])


# ---------------------------------------------------------------- E21 / E23
def _ctx_sql(before_hour=B.DECISION_HOUR):
    from evtrail.plans.sql_rules import context_sql
    return context_sql(before_hour)


@query("e21_vitals_pivot", lambda: f"WITH {_ctx_sql()}\nSELECT user_id, day, " +
       ", ".join(B.VITALS) + ", avpu, pain FROM ctx")
def e21(spark, sf):
    return B.clinical_context(spark, sf).select("user_id", "day", *B.VITALS, "avpu", "pain")


# Units of the context fields.
CONTEXT_UNITS = {"temperature": "degC|degF", "heart_rate": "bpm", "spo2": "%", "systolic_bp": "mmHg",
                 "respiratory_rate": "breaths/min", "avpu": "", "pain": "0-10"}


@query("e23_context_catalogue", lambda: f"WITH {_ctx_sql(None)}\n" + " UNION ALL ".join(
    f"SELECT '{c}' AS field, count({c}) AS available, round((count(*) - count({c})) * 100.0 / count(*), 4) AS pct_missing, "
    f"'{u}' AS units FROM ctx" for c, u in CONTEXT_UNITS.items()))
def e23(spark, sf):
    ctx = B.clinical_context(spark, sf, before_hour=None)
    agg = ctx.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in CONTEXT_UNITS])
    long = agg.unpivot(["_n"], list(CONTEXT_UNITS), "field", "available")
    units = F.create_map(*[x for k, v in CONTEXT_UNITS.items() for x in (F.lit(k), F.lit(v))])
    return long.select("field", "available",
                       F.round((F.col("_n") - F.col("available")) * 100.0 / F.col("_n"), 4).alias("pct_missing"),
                       F.try_element_at(units, F.col("field")).alias("units"))


# ---------------------------------------------------------------- E18 -----
@query("e18_demographic_attach", with_(ENC, IDX) + """
SELECT i.entity_id, i.index_id, c.c_mktsegment AS segment, n.n_name AS nation
FROM idx i LEFT JOIN customer c ON c.c_custkey = i.entity_id LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey""")
def e18(spark, sf):
    """Left joins validated many-to-one (each right key unique, else the job fails)."""
    from evtrail.operators.joins import join_many_to_one
    idx = _idx_with_ts(spark, sf)
    cust = B.table(spark, sf, "customer").select(F.col("c_custkey").alias("entity_id"), "c_mktsegment", "c_nationkey")
    nat = B.table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    j = join_many_to_one(idx, cust, ["entity_id"], name="customer")
    j = join_many_to_one(j, nat, ["c_nationkey"], name="nation")
    return j.select("entity_id", "index_id", F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"))
