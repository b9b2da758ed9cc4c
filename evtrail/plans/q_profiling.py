"""Registered profiling / data-quality queries (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evtrail.operators import profiling as P
from evtrail.plans import bindings as B
from evtrail.plans.q_pointintime import E24_SQL  # noqa: F401 (used in lazy SQL)
from evtrail.plans.registry import query


def _t(spark, sf, name):
    return B.table(spark, sf, name)


@query("c01_table_inventory", """
SELECT 'orders' AS table_name, count(*) AS n_rows, 6 AS n_cols,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders)) AS duplicate_rows,
       strftime(min(o_orderdate), '%Y-%m-%d') AS o_orderdate_min, strftime(max(o_orderdate), '%Y-%m-%d') AS o_orderdate_max
FROM orders""")
def c01(spark, sf):
    return P.table_inventory(_t(spark, sf, "orders"), "orders", ["o_orderdate"])


_C03_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, '{t}' AS dtype, count(*) AS n_rows, count(*) - count({c}) AS n_missing,
       count(DISTINCT CAST({c} AS VARCHAR)) AS n_distinct,
       count(*) FILTER (WHERE trim(CAST({c} AS VARCHAR)) = '') AS n_blank,
       round((count(*) - count({c})) * 100.0 / count(*), 4) AS pct_missing FROM customer"""
    for c, t in [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
                 ("c_acctbal", "double"), ("c_mktsegment", "string")])


# Fixed values (our binding): the tables of the inventory, their columns and date column.
_INVENTORY = [("region", 2, None), ("nation", 3, None), ("customer", 5, None), ("supplier", 4, None), ("part", 6, None),
              ("orders", 6, "o_orderdate"), ("events", 6, "ts"), ("labels", 3, None)]


@query("c01c_inventory_of_tables", lambda: " UNION ALL ".join(f"""
SELECT '{t}' AS table_name, count(*) AS n_rows, {n} AS n_cols,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {t})) AS duplicate_rows,
  {f"strftime(min({d}), '%Y-%m-%d')" if d else 'CAST(NULL AS VARCHAR)'} AS first_day,
  {f"strftime(max({d}), '%Y-%m-%d')" if d else 'CAST(NULL AS VARCHAR)'} AS last_day FROM {t}""" for t, n, d in _INVENTORY))
def c01c(spark, sf):
    return P.inventory({t: (_t(spark, sf, t), d) for t, _, d in _INVENTORY})


# Columns and types of the catalogued tables.
_CATALOGUE = [
    ("nation", "n_nationkey int, n_name string, n_regionkey int"),
    ("customer", "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
    ("supplier", "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double"),
    ("part", "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
    ("labels", "doc_id bigint, quality int, toxic int"),
]


@query("c03c_schema_catalogue", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, {i} AS position, '{c.split()[0]}' AS column_name, '{c.split()[1]}' AS dtype, "
    f"count(*) AS n_rows FROM {t}" for t, cols in _CATALOGUE for i, c in enumerate(cols.split(", "), 1)))
def c03c(spark, sf):
    """Columns, types and rows of several tables, without reading a column."""
    return P.schema_catalogue({t: _t(spark, sf, t) for t, _ in _CATALOGUE}).drop("n_files")


# The role each column of events has by its name.
_EVENT_ROLES = [("event_id", "id"), ("ts", "date"), ("user_id", "id"), ("event_type", "other"), ("value", "other"),
                ("props", "other")]
_ROLES_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{r}' AS role, count({c}) AS n_present, count(DISTINCT CAST({c} AS VARCHAR)) AS n_distinct "
    "FROM events" for c, r in _EVENT_ROLES)


@query("c01b_column_roles", _ROLES_SQL)
def c01b(spark, sf):
    """Each column's role by name keyword, with what it holds."""
    e = _t(spark, sf, "events")
    roles = P.column_roles(e.columns)
    one = e.agg(*[x for c, _ in roles for x in (F.count(c).alias(f"p_{c}"),
                                                F.count_distinct(F.col(c).cast("string")).alias(f"d_{c}"))])
    return one.select(F.explode(F.array(*[F.struct(
        F.lit(c).alias("column_name"), F.lit(r).alias("role"), F.col(f"p_{c}").alias("n_present"),
        F.col(f"d_{c}").alias("n_distinct")) for c, r in roles])).alias("x")).select("x.*")


@query("c03_column_profile", _C03_SQL)
def c03(spark, sf):
    return P.column_profile(_t(spark, sf, "customer"))


@query("c03b_schema_drift", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{st}' AS status, {f'count({c})' if st != 'missing' else 'CAST(count(*) * 0 AS BIGINT)'} AS n_present "
    "FROM orders" for c, st in [
        ("o_orderkey", "present"), ("o_custkey", "present"), ("o_orderstatus", "additional"), ("o_totalprice", "present"),
        ("o_orderdate", "present"), ("o_orderpriority", "additional"), ("o_shippriority", "missing")]))
def c03b(spark, sf):
    """Expected against present columns, with the values each holds."""
    o = _t(spark, sf, "orders")
    drift = P.schema_drift(o, ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_shippriority"])
    held = o.agg(*[F.count(c).alias(c) for c in o.columns]).unpivot([], o.columns, "column_name", "n")
    return drift.join(held, "column_name", "left").select(
        "column_name", "status", F.coalesce("n", F.lit(0)).cast("long").alias("n_present"))


@query("c04_blank_counts", """
SELECT 'segment' AS column_name, count(*) FILTER (WHERE trim(segment) = '') AS n_blank FROM (
  SELECT CASE c_custkey % 10 WHEN 0 THEN '' WHEN 1 THEN 'nan' WHEN 2 THEN '   ' ELSE c_mktsegment END AS segment
  FROM customer)""")
def c04(spark, sf):
    c = _t(spark, sf, "customer")
    k = F.col("c_custkey") % 10
    seg = F.when(k == 0, "").when(k == 1, "nan").when(k == 2, "   ").otherwise(F.col("c_mktsegment"))
    prof = P.column_profile(c.select(seg.alias("segment")))
    return prof.select("column_name", "n_blank")


@query("c05_sample_values", """
SELECT column_name, string_agg(value, ' | ' ORDER BY value) AS examples FROM (
  SELECT column_name, value, row_number() OVER (PARTITION BY column_name ORDER BY value) AS rn FROM (
    SELECT DISTINCT 'c_mktsegment' AS column_name, c_mktsegment AS value FROM customer
    UNION SELECT DISTINCT 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer
    UNION SELECT DISTINCT 'c_name', c_name FROM customer)) WHERE rn <= 5 GROUP BY column_name""")
def c05(spark, sf):
    return P.sample_values(_t(spark, sf, "customer"), ["c_mktsegment", "c_nationkey", "c_name"], 5)


@query("c06_stage_log", """
SELECT 0 AS step, 'raw' AS stage, count(*) AS n_rows FROM orders
UNION ALL SELECT 1, 'dedup', count(*) FROM (SELECT DISTINCT * FROM orders)
UNION ALL SELECT 2, 'keys_not_null', count(*) FROM orders WHERE o_custkey IS NOT NULL AND o_orderdate IS NOT NULL
UNION ALL SELECT 3, 'emergency_only', count(*) FROM orders WHERE o_custkey IS NOT NULL AND o_orderdate IS NOT NULL
  AND o_orderpriority = '1-URGENT'""")
def c06(spark, sf):
    o = _t(spark, sf, "orders")
    s1 = o.dropDuplicates()
    s2 = o.dropna(subset=["o_custkey", "o_orderdate"])
    s3 = s2.where(F.col("o_orderpriority") == "1-URGENT")
    return P.stage_log([("raw", o), ("dedup", s1), ("keys_not_null", s2), ("emergency_only", s3)])


_REL = [("orders_customer", "orders", "o_custkey", "customer", "c_custkey", "TRUE"),
        ("lineitem_active_part", "lineitem", "l_partkey", "part", "p_partkey", "p_size >= 10"),
        ("lineitem_solvent_supplier", "lineitem", "l_suppkey", "supplier", "s_suppkey", "s_acctbal > 0")]


def _rel_frames(spark, sf):
    for name, ct, ck, pt, pk, cond in _REL:
        yield name, _t(spark, sf, ct), ck, _t(spark, sf, pt).where(F.expr(cond)), pk


@query("c07_orphans", " UNION ALL ".join(
    f"""SELECT '{n}' AS relation, (SELECT count(*) FROM (SELECT DISTINCT {ck} FROM {ct} WHERE {ck} IS NOT NULL
          AND {ck} NOT IN (SELECT {pk} FROM {pt} WHERE {cond}))) AS orphan_keys,
       COALESCE((SELECT string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) FROM (
          SELECT DISTINCT {ck} AS k FROM {ct} WHERE {ck} IS NOT NULL AND {ck} NOT IN (SELECT {pk} FROM {pt} WHERE {cond})
          ORDER BY k LIMIT 5)), '') AS samples"""
    for n, ct, ck, pt, pk, cond in _REL))
def c07(spark, sf):
    out = None
    for name, child, ck, parent, pk in _rel_frames(spark, sf):
        q = P.orphans(child, ck, parent, pk, name, 5)
        out = q if out is None else out.unionByName(q)
    return out


@query("c08_fk_match_rate", " UNION ALL ".join(
    f"""SELECT '{n}' AS relation, count(*) AS child_rows,
       count(*) FILTER (WHERE {ck} IN (SELECT {pk} FROM {pt} WHERE {cond})) AS matched,
       round(count(*) FILTER (WHERE {ck} IN (SELECT {pk} FROM {pt} WHERE {cond})) * 100.0 / count(*), 4) AS match_pct
       FROM {ct}""" for n, ct, ck, pt, pk, cond in _REL))
def c08(spark, sf):
    out = None
    for name, child, ck, parent, pk in _rel_frames(spark, sf):
        q = P.fk_match_rate(child, ck, parent, pk, name)
        out = q if out is None else out.unionByName(q)
    return out


@query("c09_id_overlap", """
SELECT 'documents_labels' AS pair, (SELECT count(DISTINCT doc_id) FROM documents) AS n_a,
       (SELECT count(DISTINCT doc_id) FROM labels) AS n_b,
       (SELECT count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)) AS n_both,
       round((SELECT count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)) * 100.0
             / (SELECT count(DISTINCT doc_id) FROM documents), 4) AS pct_of_a""")
def c09(spark, sf):
    return P.id_overlap(_t(spark, sf, "documents"), "doc_id", _t(spark, sf, "labels"), "doc_id", "documents_labels")


@query("c10_key_uniqueness", """
SELECT 'orders' AS table_name, count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_keys,
       count(*) - count(DISTINCT o_orderkey) AS duplicate_rows FROM orders
UNION ALL SELECT 'orders_by_customer', count(*), count(DISTINCT o_custkey), count(*) - count(DISTINCT o_custkey) FROM orders
UNION ALL SELECT 'lineitem', count(*), (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)),
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) FROM lineitem""")
def c10(spark, sf):
    o, li = _t(spark, sf, "orders"), _t(spark, sf, "lineitem")
    return (P.key_uniqueness(o, ["o_orderkey"], "orders")
            .unionByName(P.key_uniqueness(o, ["o_custkey"], "orders_by_customer"))
            .unionByName(P.key_uniqueness(li, ["l_orderkey", "l_linenumber"], "lineitem")))


@query("c11_global_distinct", """
SELECT count(*) AS distinct_keys FROM (SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer
  UNION SELECT user_id FROM events) WHERE k IS NOT NULL""")
def c11(spark, sf):
    return P.global_distinct([(_t(spark, sf, "orders"), "o_custkey"), (_t(spark, sf, "customer"), "c_custkey"),
                              (_t(spark, sf, "events"), "user_id")])


@query("c12_rows_per_key", """
SELECT count(*) AS n_keys, min(n) AS min_rows, max(n) AS max_rows, round(avg(n), 6) AS mean_rows,
       CAST(median(n) AS DOUBLE) AS median_rows
FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)""")
def c12(spark, sf):
    return P.rows_per_key(_t(spark, sf, "lineitem"), "l_orderkey")


@query("c13_varying_within_key", """
WITH long AS (
  SELECT l_orderkey AS claim_id, 'code_2' AS field, COALESCE(l_returnflag, '<null>') AS value FROM lineitem
  UNION ALL SELECT l_orderkey, 'code_3', COALESCE(l_linestatus, '<null>') FROM lineitem
  UNION ALL SELECT l_orderkey, 'provider_id', COALESCE(CAST(l_suppkey AS VARCHAR), '<null>') FROM lineitem),
d AS (SELECT DISTINCT claim_id, field, value FROM long)
SELECT claim_id, field, count(*) AS num_values, string_agg(value, '|' ORDER BY value) AS values_found
FROM d GROUP BY claim_id, field HAVING count(*) > 1""")
def c13(spark, sf):
    li = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("claim_id"), F.col("l_returnflag").alias("code_2"),
                                          F.col("l_linestatus").alias("code_3"), F.col("l_suppkey").alias("provider_id"))
    return P.varying_within_key(li, "claim_id", ["code_2", "code_3", "provider_id"])


_GEO = "(s_acctbal % 200) - 100"


@query("c14_domain_check", f"""
SELECT 'lat_in_range' AS check_name, count(*) FILTER (WHERE NOT ({_GEO} BETWEEN -90 AND 90)) AS violations FROM supplier
UNION ALL SELECT 'lon_in_range', count(*) FILTER (WHERE NOT (((s_acctbal % 400) - 200) BETWEEN -180 AND 180)) FROM supplier""")
def c14(spark, sf):
    s = _t(spark, sf, "supplier").select((F.col("s_acctbal") % 200 - 100).alias("lat"),
                                         (F.col("s_acctbal") % 400 - 200).alias("lon"))
    return P.domain_violations(s, {"lat_in_range": F.col("lat").between(-90, 90),
                                   "lon_in_range": F.col("lon").between(-180, 180)})


_C15_BASE = """SELECT CASE WHEN l_discount >= 0.1 THEN -l_extendedprice ELSE l_extendedprice END AS paid,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE l_shipdate END AS start_ts FROM lineitem"""


@query("c15_severity_checks", f"""
WITH b AS ({_C15_BASE}), a AS (SELECT count(*) AS n, count(*) FILTER (WHERE paid < 0) AS neg,
  count(*) FILTER (WHERE start_ts IS NULL) AS miss FROM b),
l AS (SELECT 'negative_payment' AS check_name, neg AS n_flagged, n FROM a
      UNION ALL SELECT 'missing_start', miss, n FROM a)
SELECT check_name, n_flagged, round(n_flagged * 100.0 / n, 4) AS pct,
  CASE WHEN round(n_flagged * 100.0 / n, 4) > 1.0 THEN 'HIGH' WHEN n_flagged > 0 THEN 'LOW' ELSE 'NONE' END AS severity,
  CASE WHEN round(n_flagged * 100.0 / n, 4) > 1.0 THEN 'investigate source' WHEN n_flagged > 0 THEN 'clip or null'
       ELSE 'none' END AS action FROM l""")
def c15(spark, sf):
    li = _t(spark, sf, "lineitem")
    b = li.select(F.when(F.col("l_discount") >= 0.1, -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice"))
                  .alias("paid"),
                  F.when(F.col("l_linenumber") == 7, F.lit(None)).otherwise(F.col("l_shipdate")).alias("start_ts"))
    return P.severity_checks(b, {"negative_payment": F.col("paid") < 0, "missing_start": F.col("start_ts").isNull()})


@query("c16_leakage_audit", lambda: f"""
SELECT t.feature, t.id_like, COALESCE(x.neg, 0) AS negative_values
FROM (VALUES ('n_emergency_90d', 0), ('days_since_prev_visit', 0), ('entity_id', 1), ('cost_30d', 0)) t(feature, id_like)
LEFT JOIN (SELECT 'days_since_prev_visit' AS feature, count(*) FILTER (WHERE days_since_prev_visit < 0) AS neg
           FROM ({E24_SQL}) mt) x ON x.feature = t.feature""")
def c16(spark, sf):
    from evtrail.plans.q_pointintime import model_table_out
    mt = model_table_out(spark, sf)
    return P.leakage_audit(mt, ["n_emergency_90d", "days_since_prev_visit", "entity_id", "cost_30d"],
                           ["days_since_prev_visit"])


@query("c17_quality_flags", """
WITH d AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS mostly_null, 'AMERICA' AS region, c_name
           FROM customer),
p AS (SELECT 'mostly_null' AS column_name, round((count(*) - count(mostly_null)) * 100.0 / count(*), 4) AS pm,
             count(DISTINCT mostly_null) AS nd FROM d
      UNION ALL SELECT 'region', round((count(*) - count(region)) * 100.0 / count(*), 4), count(DISTINCT region) FROM d
      UNION ALL SELECT 'c_name', round((count(*) - count(c_name)) * 100.0 / count(*), 4), count(DISTINCT c_name) FROM d)
SELECT column_name, CAST(pm > 50 AS INTEGER) AS high_missing, CAST(nd <= 1 AS INTEGER) AS constant
FROM p WHERE pm > 50 OR nd <= 1""")
def c17(spark, sf):
    c = _t(spark, sf, "customer")
    d = c.select(F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).alias("mostly_null"),
                 F.lit("AMERICA").alias("region"), "c_name")
    return P.quality_flags(P.column_profile(d))


@query("c18_leakage_gate", """
SELECT feature, 'ok' AS gate FROM (VALUES ('n_emergency_90d'), ('days_since_prev_visit'), ('cost_30d')) t(feature)""")
def c18(spark, sf):
    from evtrail.plans.q_pointintime import model_table_out
    mt = model_table_out(spark, sf)
    audit = P.leakage_audit(mt, ["n_emergency_90d", "days_since_prev_visit", "cost_30d"], ["days_since_prev_visit"])
    return P.leakage_gate(audit)


@query("c20_feature_availability", """
SELECT r.column_name, CAST(p.column_name IS NOT NULL AS INTEGER) AS exists,
       COALESCE(p.pct_missing, CAST(100 AS DOUBLE)) AS pct_missing, COALESCE(p.n_distinct, 0) AS n_distinct
FROM (VALUES ('o_totalprice'), ('o_orderpriority'), ('o_shippriority')) r(column_name)
LEFT JOIN (SELECT 'o_totalprice' AS column_name, CAST(0 AS DOUBLE) AS pct_missing, count(DISTINCT CAST(o_totalprice AS VARCHAR)) AS n_distinct FROM orders
           UNION ALL SELECT 'o_orderpriority', CAST(0 AS DOUBLE), count(DISTINCT o_orderpriority) FROM orders) p
  ON p.column_name = r.column_name""")
def c20(spark, sf):
    o = _t(spark, sf, "orders").select("o_totalprice", "o_orderpriority")
    return P.feature_availability(P.column_profile(o), ["o_totalprice", "o_orderpriority", "o_shippriority"])


@query("c21_cohort_summary", lambda: f"""
SELECT 'emergency_index' AS cohort, count(DISTINCT entity_id) AS entities, count(*) AS rows,
       round(avg(label), 6) AS prevalence, min(index_date) AS first_date, max(index_date) AS last_date,
       27 AS n_features FROM ({E24_SQL}) mt""")
def c21(spark, sf):
    from evtrail.plans.q_pointintime import model_table_out
    mt = model_table_out(spark, sf)
    return P.cohort_summary(mt, "emergency_index", "entity_id", "label", "index_date", 27)


@query("c22_value_counts", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def c22(spark, sf):
    return P.value_counts(_t(spark, sf, "labels"), ["quality", "toxic"])


@query("c23_provider_completeness", """
SELECT count(*) AS providers,
  count(*) FILTER (WHERE n_name IS NULL OR s_nationkey % 7 = 0) AS missing_specialty,
  count(*) FILTER (WHERE s_acctbal < 0) AS missing_location,
  count(*) FILTER (WHERE s_suppkey % 3 = 0) AS telehealth_y,
  count(*) FILTER (WHERE s_suppkey % 3 = 1) AS telehealth_n,
  count(*) FILTER (WHERE s_suppkey % 3 = 2) AS telehealth_null
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey""")
def c23(spark, sf):
    from evtrail.operators.ranking import provider_catalog
    cat = provider_catalog(spark, sf)
    return cat.agg(F.count(F.lit(1)).alias("providers"),
                   F.count(F.when(F.col("specialty").isNull(), 1)).alias("missing_specialty"),
                   F.count(F.when(F.col("lat").isNull(), 1)).alias("missing_location"),
                   F.count(F.when(F.col("telehealth") == "Y", 1)).alias("telehealth_y"),
                   F.count(F.when(F.col("telehealth") == "N", 1)).alias("telehealth_n"),
                   F.count(F.when(F.col("telehealth").isNull(), 1)).alias("telehealth_null"))


@query("c24_numeric_summary", " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, count(*) - count({c}) AS n_missing, count(DISTINCT {c}) AS n_distinct,
        round(var_samp({c}), 4) AS variance FROM lineitem""" for c in ("l_quantity", "l_discount", "l_tax")))
def c24(spark, sf):
    return P.numeric_summary(_t(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"])


@query("c26_scores_agree", """
SELECT count(*) AS n, count(*) AS n_agree, CAST(0 AS BIGINT) AS n_unaligned FROM labels""")
def c26(spark, sf):
    from evtrail.plans.q_evaluation import scored
    s = scored(spark, sf)
    a = s.select("doc_id", "p")
    b = s.select("doc_id", (F.col("p") * 2 / 2).alias("p"))   # re-derived scoring
    return P.scores_agree(a, b, "doc_id", "p")
