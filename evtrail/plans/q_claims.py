"""Registered claims reshaping queries (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evtrail.operators import claims as D
from evtrail.operators.pointintime import day_number
from evtrail.plans import bindings as B
from evtrail.plans.registry import query
from evtrail.plans.sqlsnips import CLAIM_LINES, ENC, with_

# Fixed values (our binding): the "ED visit" code set, analogue of the five
# emergency evaluation codes; part keys ending in these digits.
ED_CODES = ("281", "282", "283", "284", "285")
_ED_SQL = "('281', '282', '283', '284', '285')"


def _collapsed(spark, sf):
    cl = B.claim_lines(spark, sf)
    return D.collapse_claims(cl, "claim_id", "segment", code_prefix="code_", first_cols=["member_id", "provider_id", "cls"],
                             min_ts=["from_ts"], max_ts=["thru_ts"], sum_cols=["paid"])


_COLLAPSE_SQL = with_(CLAIM_LINES) + """,
codes AS (SELECT claim_id, string_agg(DISTINCT code, '|' ORDER BY code) AS codes FROM (
   SELECT claim_id, trim(code_1) AS code FROM cl UNION ALL SELECT claim_id, trim(code_2) FROM cl
   UNION ALL SELECT claim_id, trim(code_3) FROM cl) WHERE code IS NOT NULL AND code <> '' GROUP BY claim_id),
hdr AS (SELECT claim_id, (array_agg(member_id ORDER BY member_id IS NULL, segment, member_id))[1] AS member_id,
               (array_agg(provider_id ORDER BY provider_id IS NULL, segment, provider_id))[1] AS provider_id,
               (array_agg(cls ORDER BY cls IS NULL, segment, cls))[1] AS cls, min(from_ts) AS from_ts, max(thru_ts) AS thru_ts, sum(paid) AS paid,
               count(*) AS n_segments FROM cl GROUP BY claim_id),
cc AS (SELECT hdr.*, codes.codes FROM hdr LEFT JOIN codes USING (claim_id))
"""


@query("d01_unpivot_codes", with_(CLAIM_LINES) + """
SELECT claim_id, slot, code FROM (
  SELECT claim_id, 'code_1' AS slot, code_1 AS code FROM cl UNION ALL SELECT claim_id, 'code_2', code_2 FROM cl
  UNION ALL SELECT claim_id, 'code_3', code_3 FROM cl) WHERE code IS NOT NULL AND trim(code) <> ''""")
def d01(spark, sf):
    cl = B.claim_lines(spark, sf)
    return D.unpivot_codes(cl, ["claim_id"], "code_")


@query("d02_code_lists", _COLLAPSE_SQL + "SELECT claim_id, codes FROM codes")
def d02(spark, sf):
    long = D.unpivot_codes(B.claim_lines(spark, sf), ["claim_id"], "code_")
    return long.groupBy("claim_id").agg(D.code_list(F.trim("code")).alias("codes"))


@query("d03_collapse_claims", _COLLAPSE_SQL + """
SELECT claim_id, member_id, provider_id, cls, strftime(from_ts, '%Y-%m-%d') AS from_date,
       strftime(thru_ts, '%Y-%m-%d') AS thru_date, round(paid, 2) AS paid, n_segments, codes FROM cc""")
def d03(spark, sf):
    c = _collapsed(spark, sf)
    return c.select("claim_id", "member_id", "provider_id", "cls", F.date_format("from_ts", "yyyy-MM-dd").alias("from_date"),
                    F.date_format("thru_ts", "yyyy-MM-dd").alias("thru_date"), F.round("paid", 2).alias("paid"),
                    "n_segments", "codes")


@query("d05_union_aligned", _COLLAPSE_SQL + """, u AS (
  SELECT 'inpatient_claims' AS source, claim_id AS record_id, member_id, paid, NULL::DOUBLE AS cost FROM cc
    WHERE cls = 'inpatient'
  UNION ALL SELECT 'outpatient_visits', o_orderkey, o_custkey, NULL::DOUBLE, o_totalprice FROM orders
    WHERE o_orderpriority = '3-MEDIUM')
SELECT source, count(*) AS n, count(paid) AS n_paid, count(cost) AS n_cost FROM u GROUP BY source""")
def d05(spark, sf):
    inp = _collapsed(spark, sf).where(F.col("cls") == "inpatient").select(
        F.lit("inpatient_claims").alias("source"), F.col("claim_id").alias("record_id"), "member_id", "paid")
    out = B.table(spark, sf, "orders").where(F.col("o_orderpriority") == "3-MEDIUM").select(
        F.lit("outpatient_visits").alias("source"), F.col("o_orderkey").alias("record_id"),
        F.col("o_custkey").alias("member_id"), F.col("o_totalprice").alias("cost"))
    u = D.union_aligned(inp, out)
    return u.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("paid").alias("n_paid"),
                                   F.count("cost").alias("n_cost"))


def _ed_codes(spark, sf):
    """Claim code lists where the part key's last three digits form the code."""
    cl = B.claim_lines(spark, sf).withColumn(
        "code_1", F.when(F.col("code_1").cast("long") % 4 == 0, F.lit("")).otherwise(
            F.lpad((F.col("code_1").cast("long") % 1000).cast("string"), 3, "0")))
    long = D.unpivot_codes(cl.select("claim_id", "code_1"), ["claim_id"], "code_")
    claims = cl.select("claim_id").distinct()
    lists = long.groupBy("claim_id").agg(D.code_list(F.col("code")).alias("codes"))
    return claims.join(lists, "claim_id", "left")


_ED_CODES_SQL = with_(CLAIM_LINES) + """,
c1 AS (SELECT claim_id, CASE WHEN CAST(code_1 AS BIGINT) % 4 = 0 THEN ''
                         ELSE lpad(CAST(CAST(code_1 AS BIGINT) % 1000 AS VARCHAR), 3, '0') END AS code FROM cl),
lists AS (SELECT claim_id, string_agg(DISTINCT code, '|' ORDER BY code) FILTER (WHERE code <> '') AS codes
          FROM c1 GROUP BY claim_id)
"""


@query("d06_code_set_flag", _ED_CODES_SQL + f"""
SELECT claim_id, CAST(list_has_any(string_split(COALESCE(codes, ''), '|'), {_ED_SQL.replace('(', '[').replace(')', ']')})
       AS INTEGER) AS ed_flag FROM lists""")
def d06(spark, sf):
    c = _ed_codes(spark, sf)
    return c.select("claim_id", D.code_set_flag(F.col("codes"), ED_CODES).alias("ed_flag"))


@query("d07_tri_state", _ED_CODES_SQL + f"""
SELECT CASE WHEN list_has_any(string_split(COALESCE(codes, ''), '|'), {_ED_SQL.replace('(', '[').replace(')', ']')})
            THEN 'CONFIRMED' WHEN codes IS NULL OR trim(codes) = '' THEN 'UNKNOWN' ELSE 'NON' END AS ed_class,
       count(*) AS n FROM lists GROUP BY ed_class""")
def d07(spark, sf):
    c = _ed_codes(spark, sf)
    t = D.tri_state(F.col("codes"), D.code_set_flag(F.col("codes"), ED_CODES))
    return c.groupBy(t.alias("ed_class")).agg(F.count(F.lit(1)).alias("n"))


@query("d08_rule_comparison", _ED_CODES_SQL + f""",
j AS (SELECT l.claim_id, CAST(list_has_any(string_split(COALESCE(codes, ''), '|'),
        {_ED_SQL.replace('(', '[').replace(')', ']')}) AS INTEGER) AS a,
        CAST(o.o_orderpriority = '1-URGENT' AS INTEGER) AS b FROM lists l JOIN orders o ON o.o_orderkey = l.claim_id)
SELECT 'code_rule' AS rule, CAST(sum(a) AS BIGINT) AS matches,
       round(CAST(sum(a) AS DOUBLE) * 100.0 / count(*), 4) AS pct_of_base FROM j
UNION ALL SELECT 'class_rule', CAST(sum(b) AS BIGINT), round(CAST(sum(b) AS DOUBLE) * 100.0 / count(*), 4) FROM j
UNION ALL SELECT 'both', CAST(sum(a * b) AS BIGINT), round(CAST(sum(a * b) AS DOUBLE) * 100.0 / count(*), 4) FROM j""")
def d08(spark, sf):
    c = _ed_codes(spark, sf)
    o = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("claim_id"), "o_orderpriority")
    j = c.join(o, "claim_id").select(D.code_set_flag(F.col("codes"), ED_CODES).alias("a"),
                                     (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("b"))
    rows = []
    for name, e in (("code_rule", F.col("a")), ("class_rule", F.col("b")), ("both", F.col("a") * F.col("b"))):
        rows.append(j.agg(F.sum(e).cast("long").alias("matches"),
                          F.round(F.sum(e) * 100.0 / F.count(F.lit(1)), 4).alias("pct_of_base"))
                    .select(F.lit(name).alias("rule"), "*"))
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("d09_entity_summary", with_(ENC) + """,
m AS (SELECT max(CAST(ts AS DATE)) AS mx FROM ev)
SELECT entity_id, count(*) AS total_events,
  count(*) FILTER (WHERE date_diff('day', CAST(ts AS DATE), mx) <= 30) AS events_30d,
  count(*) FILTER (WHERE date_diff('day', CAST(ts AS DATE), mx) <= 90) AS events_90d,
  count(*) FILTER (WHERE date_diff('day', CAST(ts AS DATE), mx) <= 180) AS events_180d,
  count(*) FILTER (WHERE date_diff('day', CAST(ts AS DATE), mx) <= 365) AS events_365d,
  strftime(min(ts), '%Y-%m-%d') AS first_date, strftime(max(ts), '%Y-%m-%d') AS latest_date,
  CAST(min(date_diff('day', CAST(ts AS DATE), mx)) AS INTEGER) AS days_since_latest
FROM ev, m GROUP BY entity_id""")
def d09(spark, sf):
    s = D.entity_summary(B.encounters(spark, sf), "entity_id", "ts")
    return s.withColumn("first_date", F.date_format("first_date", "yyyy-MM-dd")) \
        .withColumn("latest_date", F.date_format("latest_date", "yyyy-MM-dd"))


@query("d10_follow_on_events", with_(ENC) + """
SELECT count(*) AS index_visits, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM ev f WHERE f.entity_id = i.entity_id
         AND f.cls = 'inpatient' AND f.day BETWEEN i.day AND i.day + 2)) AS with_follow_on
FROM ev i WHERE i.cls = 'emergency'""")
def d10(spark, sf):
    enc = B.encounters(spark, sf).withColumn("day", day_number("ts"))
    idx = enc.where(F.col("cls") == "emergency")
    inp = enc.where(F.col("cls") == "inpatient")
    r = D.exists_in_day_window(idx, inp, "entity_id", "day", "day", 0, 2, "found")
    return r.agg(F.count(F.lit(1)).alias("index_visits"), F.count(F.when(F.col("found"), 1)).alias("with_follow_on"))


@query("d11_length_of_stay", _COLLAPSE_SQL + """
SELECT claim_id, COALESCE(date_diff('day', CAST(from_ts AS DATE), CAST(thru_ts AS DATE)), 0) AS los FROM cc""")
def d11(spark, sf):
    c = _collapsed(spark, sf)
    return c.select("claim_id", D.los_days("from_ts", "thru_ts").cast("long").alias("los"))


@query("d12_entity_year", with_(ENC) + """
SELECT entity_id, CAST(year(ts) AS INTEGER) AS year,
  max(CAST(cls = 'emergency' AS INTEGER)) AS sp_emergency, max(CAST(cls = 'inpatient' AS INTEGER)) AS sp_inpatient,
  max(CAST(cls = 'wellness' AS INTEGER)) AS sp_wellness, count(DISTINCT month(ts)) AS coverage_months,
  max(CAST(cls = 'emergency' AS INTEGER)) + max(CAST(cls = 'inpatient' AS INTEGER)) + max(CAST(cls = 'wellness' AS INTEGER))
    AS burden
FROM ev GROUP BY entity_id, year(ts)""")
def d12(spark, sf):
    enc = B.encounters(spark, sf)
    return D.entity_year(enc, "entity_id", "ts", {"sp_emergency": F.col("cls") == "emergency",
                                                  "sp_inpatient": F.col("cls") == "inpatient",
                                                  "sp_wellness": F.col("cls") == "wellness"})


@query("d13_group_having", """
SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events
GROUP BY user_id, strftime(ts, '%Y-%m-%d') HAVING count(*) >= 2""")
def d13(spark, sf):
    e = B.table(spark, sf, "events").select(
        "user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return D.groups_having(e, ["user_id", "day"], 2)
