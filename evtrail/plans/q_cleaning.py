"""Registered cleaning queries (B).

The supplied tables are clean, so each query first derives the kind of
messy landed text the operator exists for (padding, null tokens, mixed date
formats, junk numbers) deterministically from real columns, then cleans it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from evtrail.operators import cleaning as C
from evtrail.plans import bindings as B
from evtrail.plans.registry import query


def _raw_segment(spark, sf):
    c = B.table(spark, sf, "customer")
    k = F.col("c_custkey") % 10
    raw = (F.when(k == 0, F.lit("")).when(k == 1, F.lit("nan")).when(k == 2, F.lit(" None "))
           .otherwise(F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit(" "))))
    return c.select("c_custkey", raw.alias("segment"), F.col("c_name"))


_RAW_SEG_SQL = """raw AS (SELECT c_custkey, CASE c_custkey % 10 WHEN 0 THEN '' WHEN 1 THEN 'nan' WHEN 2 THEN ' None '
  ELSE '  ' || c_mktsegment || ' ' END AS segment, c_name FROM customer)"""


@query("b01_text_null_tokens", "WITH " + _RAW_SEG_SQL + """
SELECT c_custkey, CASE WHEN trim(segment) IN ('', 'nan', 'None', 'NaN', 'null', 'NULL') THEN NULL
                       ELSE trim(segment) END AS segment, c_name FROM raw""")
def b01(spark, sf):
    return C.clean_strings(_raw_segment(spark, sf), ["segment"])


def _raw_dates(spark, sf):
    o = B.table(spark, sf, "orders")
    k = F.col("o_orderkey") % 4
    raw = (F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
           .when(k == 1, F.date_format("o_orderdate", "MM/dd/yyyy"))
           .when(k == 2, F.date_format("o_orderdate", "yyyyMMdd"))
           .when(F.col("o_orderkey") % 13 == 3, F.lit("not a date"))
           .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")))
    return o.select("o_orderkey", raw.alias("raw_date"))


_BAD_DATE = "o_orderkey % 4 = 3 AND o_orderkey % 13 = 3"


@query("b02_date_parse_multi", f"""
SELECT o_orderkey, CASE WHEN {_BAD_DATE} THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS parsed_date
FROM orders""")
def b02(spark, sf):
    d = C.parse_dates(_raw_dates(spark, sf), ["raw_date"])
    return d.select("o_orderkey", F.date_format("raw_date", "yyyy-MM-dd").alias("parsed_date"))


@query("b03_parse_yyyymmdd", """
SELECT l_orderkey, l_linenumber,
       CASE WHEN l_linenumber = 7 THEN NULL ELSE strftime(l_shipdate, '%Y-%m-%d') END AS ship_date
FROM lineitem""")
def b03(spark, sf):
    li = B.table(spark, sf, "lineitem")
    raw = F.when(F.col("l_linenumber") == 7, F.concat(F.year("l_shipdate").cast("string"), F.lit("XX01"))) \
        .otherwise(F.date_format("l_shipdate", "yyyyMMdd"))
    d = C.parse_compact_dates(li.select("l_orderkey", "l_linenumber", raw.alias("ship_date")), ["ship_date"])
    return d.select("l_orderkey", "l_linenumber", F.date_format("ship_date", "yyyy-MM-dd").alias("ship_date"))


@query("b04_standardise_dates", f"""
SELECT o_orderkey,
  CASE WHEN {_BAD_DATE} THEN 'not a date' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS raw_date,
  CAST({_BAD_DATE} AS INTEGER) AS raw_date_invalid
FROM orders""")
def b04(spark, sf):
    return C.standardise_dates(_raw_dates(spark, sf), ["raw_date"])


@query("b05_numeric_coercion", """
SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice END AS price,
       CASE WHEN o_orderkey % 17 = 0 THEN 0.0 ELSE o_totalprice END AS price_or_zero
FROM orders""")
def b05(spark, sf):
    o = B.table(spark, sf, "orders")
    raw = F.when(F.col("o_orderkey") % 17 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string"))
    d = o.select("o_orderkey", raw.alias("price"), raw.alias("price_or_zero"))
    d = C.coerce_numeric(d, ["price"])
    return C.coerce_numeric(d, ["price_or_zero"], fill=0.0)


@query("b06_clip", """
SELECT c_custkey, least(greatest(c_acctbal, 0.0), 5000.0) AS acctbal_clipped FROM customer""")
def b06(spark, sf):
    c = B.table(spark, sf, "customer")
    return c.select("c_custkey", C.clip("c_acctbal", 0.0, 5000.0).alias("acctbal_clipped"))


@query("b07_drop_null_keys", """
SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey % 9 <> 0""")
def b07(spark, sf):
    c = B.table(spark, sf, "customer")
    d = c.select("c_custkey", F.when(F.col("c_custkey") % 9 == 0, F.lit(None)).otherwise(F.col("c_nationkey"))
                 .alias("c_nationkey"))
    return C.drop_null_keys(d, ["c_nationkey"])


@query("b08_drop_all_null_rows", """
SELECT a, b FROM (SELECT CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END AS a,
                         CASE WHEN c_custkey % 5 = 0 OR c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS b
                  FROM customer) WHERE a IS NOT NULL OR b IS NOT NULL""")
def b08(spark, sf):
    c = B.table(spark, sf, "customer")
    d = c.select(F.when(F.col("c_custkey") % 5 == 0, F.lit(None)).otherwise(F.col("c_name")).alias("a"),
                 F.when((F.col("c_custkey") % 5 == 0) | (F.col("c_custkey") % 7 == 0), F.lit(None))
                 .otherwise(F.col("c_mktsegment")).alias("b"))
    return C.drop_all_null_rows(d)


@query("b09_null_column_audit", """
SELECT column_name, non_null FROM (
  SELECT count(c_custkey) AS c_custkey, count(c_name) AS c_name, count(NULL::VARCHAR) AS c_comment FROM customer)
UNPIVOT (non_null FOR column_name IN (c_custkey, c_name, c_comment))""")
def b09(spark, sf):
    c = B.table(spark, sf, "customer").select("c_custkey", "c_name", F.lit(None).cast("string").alias("c_comment"))
    return C.non_null_counts(c)


@query("b09b_drop_null_columns", "SELECT c_custkey, c_name FROM customer")
def b09b(spark, sf):
    c = B.table(spark, sf, "customer").select("c_custkey", F.lit(None).cast("string").alias("c_comment"), "c_name")
    return C.drop_all_null_columns(c)


@query("b10_dedup_exact", """
SELECT count(*) AS rows_before, (SELECT count(*) FROM (SELECT DISTINCT l_partkey, l_returnflag FROM lineitem)) AS rows_after,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_partkey, l_returnflag FROM lineitem)) AS duplicates
FROM lineitem""")
def b10(spark, sf):
    li = B.table(spark, sf, "lineitem").select("l_partkey", "l_returnflag")
    before = li.agg(F.count(F.lit(1)).alias("rows_before"))
    after = C.dedup_exact(li).agg(F.count(F.lit(1)).alias("rows_after"))
    return before.crossJoin(after).withColumn("duplicates", F.col("rows_before") - F.col("rows_after"))


@query("b11_keep_first", """
SELECT o_custkey, o_orderkey, o_orderpriority FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def b11(spark, sf):
    o = B.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderdate")
    return C.keep_first(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("b12_same_day_collapse", """
SELECT user_id, day, event_id FROM (
  SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_id,
         row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1""")
def b12(spark, sf):
    e = B.table(spark, sf, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "ts", "event_id")
    return C.keep_first(e, ["user_id", "day"], ["ts", "event_id"]).drop("ts")


@query("b13_case_fold", "SELECT c_custkey, lower(c_mktsegment) AS c_mktsegment FROM customer")
def b13(spark, sf):
    return C.lower_cols(B.table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"])


@query("b14_sentinel_fill", """
SELECT c.c_custkey, COALESCE(u.n, 0) AS urgent_orders, COALESCE(u.seg, 'Unknown') AS first_priority
FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n, min(o_orderpriority) AS seg FROM orders
  WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey) u ON u.o_custkey = c.c_custkey""")
def b14(spark, sf):
    o = B.table(spark, sf, "orders").where(F.col("o_orderpriority") == "1-URGENT")
    u = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("urgent_orders"), F.min("o_orderpriority").alias("first_priority"))
    c = B.table(spark, sf, "customer").select("c_custkey")
    j = c.join(u, c.c_custkey == u.o_custkey, "left").drop("o_custkey")
    return C.fill_sentinels(j, {"urgent_orders": 0, "first_priority": "Unknown"})


@query("b15_conform_columns", """
SELECT c_custkey, c_name, CAST(NULL AS VARCHAR) AS c_phone, CAST(c_acctbal AS DOUBLE) AS c_acctbal,
       CAST(NULL AS BIGINT) AS c_parent FROM customer""")
def b15(spark, sf):
    c = B.table(spark, sf, "customer")
    return C.conform(c, [("c_custkey", "bigint"), ("c_name", "string"), ("c_phone", "string"),
                         ("c_acctbal", "double"), ("c_parent", "bigint")])


@query("b16_unit_conversion", """
SELECT event_id, round(CASE WHEN value * 1.5 + 20 > 45 THEN (value * 1.5 + 20 - 32) * 5.0 / 9.0
                            ELSE value * 1.5 + 20 END, 4) AS temperature_c
FROM events""")
def b16(spark, sf):
    e = B.table(spark, sf, "events")
    raw = (F.col("value") * 1.5 + 20).cast("string")   # landed as text
    return e.select("event_id", F.round(C.fahrenheit_to_celsius(raw), 4).alias("temperature_c"))


@query("b17_flag_mapping", """
SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 1 ELSE 0 END AS flag
FROM lineitem""")
def b17(spark, sf):
    li = B.table(spark, sf, "lineitem")
    raw = F.when(F.col("l_returnflag") == "R", F.lit("y")).when(F.col("l_returnflag") == "A", F.lit(" 1")) \
        .otherwise(F.lit("0"))
    return li.select("l_orderkey", "l_linenumber", C.flag_to_int(raw).alias("flag"))


@query("b18_rename_select_drop", """
SELECT o_orderkey AS encounter_id, o_custkey AS patient_id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS start_date FROM orders""")
def b18(spark, sf):
    o = B.table(spark, sf, "orders")
    r = C.rename_select(o, {"o_orderkey": "encounter_id", "o_custkey": "patient_id", "o_orderdate": "start_date"},
                        drop=["o_orderstatus", "o_totalprice", "o_orderpriority"])
    return r.withColumn("start_date", F.date_format("start_date", "yyyy-MM-dd HH:mm:ss"))


_B19_SQL = """
SELECT 'eq' AS predicate, count(*) AS n FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 'range', count(*) FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 200000
UNION ALL SELECT 'in', count(*) FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')
UNION ALL SELECT 'ilike', count(*) FROM customer WHERE c_mktsegment ILIKE '%mach%'
UNION ALL SELECT 'contains', count(*) FROM part WHERE contains(p_name, 'widget')
UNION ALL SELECT 'is_null', count(*) FROM orders WHERE o_clerk_missing IS NULL"""


@query("b19_predicate_filters", _B19_SQL.replace("o_clerk_missing", "o_custkey"))
def b19(spark, sf):
    o, c, p = (B.table(spark, sf, t) for t in ("orders", "customer", "part"))
    parts = [("eq", o, C.predicate("o_orderstatus", "eq", "F")),
             ("range", o, C.predicate("o_totalprice", "ge", 100000) & C.predicate("o_totalprice", "lt", 200000)),
             ("in", o, C.predicate("o_orderpriority", "in", ["1-URGENT", "2-HIGH"])),
             ("ilike", c, C.predicate("c_mktsegment", "ilike", "%mach%")),
             ("contains", p, C.predicate("p_name", "contains", "widget")),
             ("is_null", o, C.predicate("o_custkey", "is_null"))]
    out = None
    for name, df, cond in parts:
        q = df.where(cond).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("predicate"), "n")
        out = q if out is None else out.unionByName(q)
    return out
