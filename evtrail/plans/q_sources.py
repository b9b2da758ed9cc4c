"""Registered source / sink queries (A).  Each writes the given tables to a
fresh folder under ``spark.checkpoint.dir`` and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from evtrail.plans import bindings as B
from evtrail.plans.registry import query
from evtrail.sources import io as A


@query("a01_read_raw_csv", """
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderpriority, CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders""")
def a01(spark, sf):
    p = A.write_csv(B.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_custkey"),
                    A.scratch_path(spark, "a01"))
    return A.read_raw_csv(spark, p)


@query("a02_read_typed_csv", """
SELECT o_orderkey, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM orders""")
def a02(spark, sf):
    o = B.table(spark, sf, "orders").select("o_orderkey", "o_totalprice",
                                           F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"))
    p = A.write_csv(o, A.scratch_path(spark, "a02"))
    schema = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_totalprice", T.DoubleType()),
                           T.StructField("o_orderdate", T.DateType())])
    d = A.read_typed_csv(spark, p, schema)
    return d.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


@query("a03_pruned_scan", """
SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_returnflag = 'R'""")
def a03(spark, sf):
    df = A.pruned_scan(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_extendedprice", "l_returnflag"],
                       F.col("l_returnflag") == "R")
    return df.drop("l_returnflag")


@query("a04_malformed_lines", """
SELECT 'good' AS kind, count(*) AS n FROM orders WHERE o_orderkey % 13 <> 0
UNION ALL SELECT 'malformed', count(*) FROM orders WHERE o_orderkey % 13 = 0""")
def a04(spark, sf):
    o = B.table(spark, sf, "orders")
    price = F.when(F.col("o_orderkey") % 13 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string"))
    p = A.write_csv(o.select("o_orderkey", price.alias("o_totalprice")), A.scratch_path(spark, "a04"))
    schema = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_totalprice", T.DoubleType())])
    good, bad = A.read_csv_checked(spark, p, schema)
    return (good.agg(F.count(F.lit(1)).alias("n")).select(F.lit("good").alias("kind"), "n")
            .unionByName(bad.agg(F.count(F.lit(1)).alias("n")).select(F.lit("malformed").alias("kind"), "n")))


@query("a04b_wrong_field_count", """
SELECT 'rows' AS kind, count(*) AS n FROM orders WHERE o_orderkey % 13 <> 0
UNION ALL SELECT 'null_price', count(*) FROM orders WHERE o_orderkey % 13 <> 0 AND o_orderkey % 17 = 0
UNION ALL SELECT 'skipped', count(*) FROM orders WHERE o_orderkey % 13 = 0""")
def a04b(spark, sf):
    """Lines with a field too many (13th keys) are skipped; a bad number is null."""
    o = B.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    price = F.when(k % 17 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string"))
    path = A.scratch_path(spark, "a04b")
    o.select(F.concat_ws(",", k.cast("string"), price, F.when(k % 13 == 0, "extra")).alias("value")).write.text(path)
    schema = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_totalprice", T.DoubleType())])
    good, skipped = A.read_lines_checked(spark, path, schema)
    one = lambda df, kind: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return (one(good, "rows").unionByName(one(good.where(F.col("o_totalprice").isNull()), "null_price"))
            .unionByName(one(skipped, "skipped")))


@query("a05_parquet_roundtrip", "SELECT * FROM customer")
def a05(spark, sf):
    p = A.write_parquet(B.table(spark, sf, "customer"), A.scratch_path(spark, "a05"))
    return spark.read.parquet(p)


@query("a06_csv_sink", "SELECT r_regionkey, r_name FROM region")
def a06(spark, sf):
    p = A.write_csv(B.table(spark, sf, "region"), A.scratch_path(spark, "a06"))
    return A.read_typed_csv(spark, p, T.StructType([T.StructField("r_regionkey", T.IntegerType()),
                                                    T.StructField("r_name", T.StringType())]))


@query("a07_json_report", """
SELECT n_nationkey, n_name, n_regionkey FROM nation""")
def a07(spark, sf):
    p = A.write_json_report(B.table(spark, sf, "nation"), A.scratch_path(spark, "a07"))
    schema = T.StructType([T.StructField("n_nationkey", T.IntegerType()), T.StructField("n_name", T.StringType()),
                           T.StructField("n_regionkey", T.IntegerType())])
    return A.read_json(spark, p, schema)


@query("a08_partitioned_write", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'""")
def a08(spark, sf):
    p = A.write_parquet(B.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"),
                        A.scratch_path(spark, "a08"), partition_by=["o_orderpriority"])
    return spark.read.parquet(p).where(F.col("o_orderpriority") == "1-URGENT").drop("o_orderpriority")


@query("a08b_bucketed_lookup", """
SELECT c.c_custkey, count(o.o_orderkey) AS n_orders FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey
GROUP BY c.c_custkey""")
def a08b(spark, sf):
    """Orders as a table bucketed on the customer: the lookup join shuffles
    the customers only."""
    path = A.scratch_path(spark, "a08b")
    t = A.save_bucketed_table(B.table(spark, sf, "orders").select("o_custkey", "o_orderkey"),
                              "evtrail_lookup_" + path[-12:], path, 8, ["o_custkey"], ["o_custkey"])
    c = B.table(spark, sf, "customer").select("c_custkey")
    return c.join(t, c.c_custkey == t.o_custkey).groupBy("c_custkey").agg(F.count("o_orderkey").alias("n_orders"))


@query("a09_sql_with_params", """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000 AND o_orderstatus = 'F'""")
def a09(spark, sf):
    return A.sql_scan(spark, "SELECT o_orderkey, o_totalprice FROM {o} WHERE o_totalprice > :minp AND o_orderstatus = :st",
                      {"minp": 400000, "st": "F"}, o=B.table(spark, sf, "orders"))


@query("a10_batched_copy", """
SELECT count(*) AS source_rows, count(*) AS target_rows, 4 AS batches, TRUE AS reconciled FROM lineitem""")
def a10(spark, sf):
    li = B.table(spark, sf, "lineitem")
    return A.batched_copy(li, A.scratch_path(spark, "a10"), "l_orderkey", 4)


@query("a11_multi_file_key", """
SELECT event_type AS file_key, count(*) AS n FROM events GROUP BY event_type""")
def a11(spark, sf):
    base = A.scratch_path(spark, "a11")
    A.write_parquet(B.table(spark, sf, "events"), base, partition_by=["event_type"])
    d = A.read_with_file_key(spark, f"{base}/event_type=*/*.parquet", "parquet", r"event_type=([^/]+)/")
    return d.groupBy("file_key").agg(F.count(F.lit(1)).alias("n"))


@query("a12_header_normalisation", """
SELECT o_orderkey AS patient_id, o_orderdate IS NOT NULL AS start_date_present, o_orderpriority AS encounter_class
FROM orders""")
def a12(spark, sf):
    o = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias(" Patient ID "),
                                            F.col("o_orderdate").isNotNull().alias("Start-Date  Present"),
                                            F.col("o_orderpriority").alias("ENCOUNTER__Class"))
    return A.normalise_headers(o)


# Provider column aliases (target -> accepted spellings).
PROVIDER_ALIASES = {"npi": ["NPI", "Provider NPI", "provider_npi"], "name": ["Provider Name", "NAME"],
                    "quality_score": ["Quality Score", "MIPS Score", "Final MIPS Score"]}


@query("a13_alias_rename", "SELECT s_suppkey AS npi, s_name AS name, s_acctbal AS quality_score FROM supplier")
def a13(spark, sf):
    s = B.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("Provider  NPI"),
                                              F.col("s_name").alias("provider name"),
                                              F.col("s_acctbal").alias("Final_MIPS_Score"))
    return A.apply_aliases(s, PROVIDER_ALIASES)
