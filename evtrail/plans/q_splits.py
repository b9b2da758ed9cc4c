"""Registered split / fold queries (F) over the point-in-time model table."""

from __future__ import annotations

from pyspark.sql import functions as F

from evtrail.operators import splits as S
from evtrail.plans.q_pointintime import E24_SQL, model_table_out
from evtrail.plans.registry import query


def cohort(spark, sf):
    mt = model_table_out(spark, sf)
    return mt.select("entity_id", "index_id", F.to_timestamp("index_date").alias("index_ts"), "index_date", "label",
                     "n_emergency_90d")


MT = lambda: f"mt AS (SELECT * FROM ({E24_SQL}) x)"


@query("f01_temporal_split", lambda: f"""WITH {MT()},
y AS (SELECT max(year(CAST(index_date AS DATE))) AS ymax FROM mt)
SELECT index_id, CASE WHEN year(CAST(index_date AS DATE)) = ymax THEN 'test'
  WHEN year(CAST(index_date AS DATE)) = ymax - 1 THEN 'validation' ELSE 'train' END AS split FROM mt, y""")
def f01(spark, sf):
    return S.temporal_split(cohort(spark, sf), "index_ts").select("index_id", "split")


_YMAP = {1995: "train", 1996: "train", 1997: "train", 1998: "train", 1999: "validation", 2000: "test"}


@query("f02_year_map_split", lambda: f"""WITH {MT()}
SELECT index_id, CASE year(CAST(index_date AS DATE)) {" ".join(f"WHEN {k} THEN '{v}'" for k, v in _YMAP.items())}
  ELSE 'exclude' END AS split FROM mt""")
def f02(spark, sf):
    return S.year_map_split(cohort(spark, sf), "index_ts", _YMAP).select("index_id", "split")


@query("f03_grouped_holdout", lambda: f"""WITH {MT()},
last AS (SELECT entity_id, max(CAST(index_date AS DATE)) AS ld FROM mt GROUP BY entity_id),
r AS (SELECT entity_id, row_number() OVER (ORDER BY ld, entity_id) AS rn, count(*) OVER () AS n FROM last)
SELECT entity_id, CASE WHEN rn <= floor(n * 0.6) THEN 'train' WHEN rn <= floor(n * 0.8) THEN 'validation'
  ELSE 'test' END AS split FROM r""")
def f03(spark, sf):
    return S.grouped_holdout(cohort(spark, sf), "entity_id", "index_ts").select("entity_id", "split").distinct()


@query("f04_group_kfold", lambda: f"""WITH {MT()}
SELECT index_id, CAST(CAST('0x' || substr(md5('0:' || CAST(entity_id AS VARCHAR)), 1, 8) AS BIGINT) % 5 AS INTEGER) AS fold
FROM mt""")
def f04(spark, sf):
    return S.group_kfold(cohort(spark, sf), "entity_id", 5).select("index_id", "fold")


@query("f05_expanding_folds", lambda: f"""WITH {MT()},
r AS (SELECT index_id, row_number() OVER (ORDER BY index_date, index_id) - 1 AS pos, count(*) OVER () AS n FROM mt),
f AS (SELECT r.*, fold, floor(n / 4) AS ts FROM r, range(0, 3) t(fold))
SELECT CAST(fold AS INTEGER) AS fold, CASE WHEN pos < (fold + 1) * ts THEN 'train' ELSE 'test' END AS role,
  count(*) AS n, CAST(sum(index_id) AS BIGINT) AS id_sum FROM f WHERE pos < (fold + 2) * ts GROUP BY ALL""")
def f05(spark, sf):
    e = S.expanding_folds(cohort(spark, sf), "index_ts", "index_id", 3)
    return e.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.sum("index_id").alias("id_sum"))


@query("f06_rolling_origin", lambda: f"""WITH {MT()},
per AS (SELECT year(CAST(index_date AS DATE)) AS y, count(*) AS n, sum(label) AS pos FROM mt GROUP BY 1),
t AS (SELECT CAST(e.y AS INTEGER) AS eval_year, CASE WHEN p.y < e.y - 1 THEN 'fit' WHEN p.y = e.y - 1 THEN 'tune' ELSE 'hold' END AS role,
   CAST(sum(p.n) AS BIGINT) AS n, CAST(sum(p.pos) AS BIGINT) AS positives FROM per e, per p WHERE p.y <= e.y GROUP BY ALL)
SELECT * FROM t WHERE eval_year IN (SELECT eval_year FROM t WHERE role = 'hold' AND positives > 0)
  AND eval_year IN (SELECT eval_year FROM t WHERE role = 'fit')""")
def f06(spark, sf):
    r = S.rolling_origin(cohort(spark, sf), "index_ts", "label")
    return r.select("eval_year", "role", F.col("n").cast("long").alias("n"),
                    F.col("positives").cast("long").alias("positives"))


@query("f07_stratified_kfold", lambda: f"""WITH {MT()},
c AS (SELECT label, count(*) AS nc FROM mt GROUP BY label)
SELECT label, CAST(fold AS INTEGER) AS fold, CAST(nc // 5 + CASE WHEN fold < nc % 5 THEN 1 ELSE 0 END AS BIGINT) AS n
FROM c, range(0, 5) t(fold) WHERE nc // 5 + CASE WHEN fold < nc % 5 THEN 1 ELSE 0 END > 0""")
def f07(spark, sf):
    k = S.stratified_kfold(cohort(spark, sf), "label", "index_id", 5)
    return k.groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n"))


@query("f08_split_audit", lambda: f"""WITH {MT()},
y AS (SELECT max(year(CAST(index_date AS DATE))) AS ymax FROM mt),
s AS (SELECT mt.*, CASE WHEN year(CAST(index_date AS DATE)) = ymax THEN 'test'
  WHEN year(CAST(index_date AS DATE)) = ymax - 1 THEN 'validation' ELSE 'train' END AS split FROM mt, y)
SELECT split, count(*) AS rows, count(DISTINCT entity_id) AS entities, min(index_date) AS first_date,
  max(index_date) AS last_date, round(avg(label), 6) AS positive_rate FROM s GROUP BY split""")
def f08(spark, sf):
    s = S.temporal_split(cohort(spark, sf), "index_ts")
    a = S.split_audit(s, "split", "entity_id", "index_ts", "label")
    return a.withColumn("positive_rate", F.round("positive_rate", 6))


@query("f08b_split_overlap", lambda: f"""WITH {MT()},
y AS (SELECT max(year(CAST(index_date AS DATE))) AS ymax FROM mt),
s AS (SELECT DISTINCT entity_id, CASE WHEN year(CAST(index_date AS DATE)) = ymax THEN 'test'
  WHEN year(CAST(index_date AS DATE)) = ymax - 1 THEN 'validation' ELSE 'train' END AS split FROM mt, y)
SELECT a.split AS split_a, b.split AS split_b, count(*) AS shared_entities FROM s a JOIN s b
  ON a.entity_id = b.entity_id AND a.split < b.split GROUP BY ALL""")
def f08b(spark, sf):
    s = S.temporal_split(cohort(spark, sf), "index_ts")
    return S.split_overlap(s, "split", "entity_id")


@query("f09_temporal_thirds", lambda: f"""WITH {MT()},
r AS (SELECT index_id, row_number() OVER (ORDER BY index_date, index_id) AS rn, count(*) OVER () AS n FROM mt)
SELECT CAST(CASE WHEN n // 3 = 0 THEN 3 ELSE least((rn - 1) // (n // 3) + 1, 3) END AS INTEGER) AS third,
  count(*) AS n, CAST(sum(index_id) AS BIGINT) AS id_sum FROM r GROUP BY 1""")
def f09(spark, sf):
    t = S.temporal_thirds(cohort(spark, sf), "index_ts", "index_id")
    return t.groupBy("third").agg(F.count(F.lit(1)).alias("n"), F.sum("index_id").alias("id_sum"))


@query("f11_class_weight", lambda: f"""WITH {MT()}
SELECT count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, round(sum(label) / count(*), 6) AS prevalence,
  round(CASE WHEN sum(label) > 0 THEN (count(*) - sum(label)) / sum(label) END, 6) AS pos_weight FROM mt""")
def f11(spark, sf):
    w = S.class_weight(cohort(spark, sf), "label")
    return w.select("n", "positives", F.round("prevalence", 6).alias("prevalence"),
                    F.round("pos_weight", 6).alias("pos_weight"))


@query("f12_oof_assembly", lambda: f"""WITH {MT()},
r AS (SELECT *, row_number() OVER (ORDER BY index_date, index_id) - 1 AS pos, count(*) OVER () AS n FROM mt),
f AS (SELECT r.*, fold, floor(n / 4) AS ts FROM r, range(0, 3) t(fold)),
tr AS (SELECT fold, least(n_emergency_90d, 3) AS b, avg(label) AS rate FROM f WHERE pos < (fold + 1) * ts GROUP BY ALL),
te AS (SELECT * FROM f WHERE pos >= (fold + 1) * ts AND pos < (fold + 2) * ts)
SELECT CAST(te.fold AS INTEGER) AS fold, te.index_id, te.label, round(COALESCE(tr.rate, 0.0), 6) AS oof_p FROM te
LEFT JOIN tr ON tr.fold = te.fold AND tr.b = least(te.n_emergency_90d, 3)""")
def f12(spark, sf):
    """Per expanding fold, fit the simplest model -- positive rate by
    (capped) recent-ED bucket on the training rows -- and score the fold's
    test rows; the fold outputs are concatenated."""
    e = S.expanding_folds(cohort(spark, sf), "index_ts", "index_id", 3).withColumn(
        "b", F.least(F.col("n_emergency_90d"), F.lit(3)))
    outs = []
    for k in range(3):
        fk = e.where(F.col("fold") == k)
        model = fk.where(F.col("role") == "train").groupBy("b").agg(F.avg("label").alias("rate"))
        test = fk.where(F.col("role") == "test")
        outs.append(test.join(F.broadcast(model), "b", "left").select(   # <= 4 buckets
            "fold", "index_id", "label", F.round(F.coalesce("rate", F.lit(0.0)), 6).alias("oof_p")))
    return S.assemble_oof(outs)
