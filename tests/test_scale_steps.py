"""Steps shared by several queries: made once, and dealt by rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from evtrail import session
from evtrail.functions import prefix
from evtrail.operators import pointintime as pit
from evtrail.operators import postings as P
from evtrail.operators import ranking as J
from evtrail.plans import bindings as B
from evtrail.plans import q_models, q_retrieval, q_rules
from evtrail.sources.io import scratch_path


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def folder(spark):
    rng = random.Random(3)
    day = lambda n: dt.datetime(2020, 1, 1) + dt.timedelta(days=n)
    tables = {
        "region": ([(0, "ASIA"), (1, "EUROPE")], "r_regionkey long, r_name string"),
        "nation": ([(1, "ONE", 0), (2, "TWO", 1)], "n_nationkey long, n_name string, n_regionkey long"),
        "customer": ([(i, f"c{i}", 1 + i % 2, 1.0, "S") for i in range(8)],
                     "c_custkey long, c_name string, c_nationkey long, c_acctbal double, c_mktsegment string"),
        "supplier": ([(i, f"s{i}", 1 + i % 2, 10.0 * i) for i in range(6)],
                     "s_suppkey long, s_name string, s_nationkey long, s_acctbal double"),
        "part": ([(i, f"p{i}", f"B{i % 3}", ("MEDIUM", "PROMO")[i % 2]) for i in range(9)],
                 "p_partkey long, p_name string, p_brand string, p_type string"),
        "orders": ([(i, i % 8, 5.0, day(rng.randrange(300)), ("1-URGENT", "3-MEDIUM")[i % 2 if i > 15 else 0]) for i in range(60)],
                   "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"),
        "lineitem": ([(i % 60, rng.randrange(9), rng.randrange(6), i // 60, 3.0, 9.0, "RAN"[i % 3], "OF"[i % 2], day(rng.randrange(300)))
                      for i in range(180)],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber long, l_quantity double, "
                     "l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"),
        "events": ([(i, day(i % 9), i % 8, ("view", "click", "purchase", "error", "signup")[i % 5], 20.0, '{"k": %d}' % i)
                    for i in range(80)],
                   "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"),
    }
    at = scratch_path(spark, "t-tables")
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema.replace("timestamp_ntz", "timestamp")).coalesce(1).write.parquet(f"{at}/{name}.parquet")
    return at


def test_model_table_and_assessment_are_made_once(spark, folder, monkeypatch):
    monkeypatch.setattr(session, "_MEMO", {})
    made = []
    for name in ("model_table_out", "assessed"):
        def counted(spark, sf, name=name, plain=getattr(q_rules, name)):
            made.append(name)
            return plain(spark, sf)
        monkeypatch.setattr(q_rules, name, counted)
    told = q_retrieval.i22b(spark, folder).collect()
    assert sorted(made) == ["assessed", "model_table_out"]
    assert {r["entity_id"] for r in told} == {r["entity_id"] for r in q_rules.decision_table(spark, folder).collect()}
    assert told and all(r["explanation"] for r in told)


def test_similarity_is_planned_once(spark):
    needs = spark.createDataFrame([("n1", "large asia"), ("n2", "small")], "need string, text string")
    cands = spark.createDataFrame([("n1", 1, "large asia"), ("n1", 2, "large europe"), ("n1", 3, None), ("n2", 4, "promo")],
                                  "need string, id long, text string")
    out = J.tfidf_similarity(needs, cands, "need", "id", "text")
    assert out._jdf.queryExecution().analyzed().toString().count("Join") == 1
    got = {r["id"]: r["semantic_score"] for r in out.collect()}
    assert got[1] == 100.0 and 0 < got[2] < 100 and got[3] == 0 and got[4] == 0


def test_lines_of_other_providers_are_dropped_before_a_shuffle(spark, folder):
    ranked = spark.createDataFrame([("n", 1, 2), ("n", 2, 99)], "need_key string, rank int, provider_id long")
    out = J.provider_enrichment(spark, folder, ranked)
    assert "strategy=broadcast" in _plan(out)
    li, part = (B.table(spark, folder, t) for t in ("lineitem", "part"))
    own = li.where("l_suppkey = 2").join(part, F.col("l_partkey") == F.col("p_partkey")).collect()
    got = {r["provider_id"]: r for r in out.collect()}
    types = sorted({r["p_type"] for r in own})
    assert got[2]["procedure_volumes"] == "; ".join(f"{t}: {sum(r['p_type'] == t for r in own)}" for t in types)
    assert got[2]["facilities"] == ", ".join(sorted({r["p_brand"] for r in own}))
    assert got[99]["facilities"].startswith("No facility")


def test_catalogue_counts_types_and_brands(spark, folder):
    lp = B.table(spark, folder, "lineitem").join(B.table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey")).collect()
    for r in J.provider_catalog(spark, folder).collect():
        own = [x for x in lp if x["l_suppkey"] == r["provider_id"]]
        assert (r["utilization"], r["n_facilities"]) == (len(own), len({x["p_brand"] for x in own}))


def test_lines_and_sweeps_are_dealt_by_rows(spark, folder, monkeypatch):
    plain = sorted(B.claim_lines(spark, folder).collect())
    ev = B.claim_lines(spark, folder).select(F.col("member_id").alias("e"), "provider_id", pit.day_number("from_ts").alias("d"))
    qs = ev.select("e", F.col("d").alias("day")).distinct()
    want = sorted(map(tuple, pit.distinct_in_window(ev, qs, "e", "d", "provider_id", 60, "n").collect()))
    monkeypatch.setattr(prefix, "ROWS_PER_TASK", 5)
    dealt = B.claim_lines(spark, folder)
    assert sorted(dealt.collect()) == plain and _plan(dealt).count("RepartitionByExpression") == 2
    out = pit.distinct_in_window(ev, qs, "e", "d", "provider_id", 60, "n", rows=B.n_lines(spark, folder))
    assert _plan(out).count("RepartitionByExpression") >= 3
    assert sorted(map(tuple, out.collect())) == want


def test_postings_are_dealt_by_documents(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a b{i} c{i % 5} d", ["en"]) for i in range(300)], "d long, text string, tags array<string>")
    build = lambda: P.build_index(docs, "d", F.col("text"), F.col("tags"))
    plain = sorted(map(tuple, build().postings.collect()))
    monkeypatch.setattr(P, "DOCS_PER_TASK", 10)
    index = build()
    assert len(index.postings.inputFiles()) > 20
    assert sorted(map(tuple, index.postings.collect())) == plain and index.rows == len(plain)


def test_fits_read_few_parts(spark, monkeypatch):
    monkeypatch.setattr(q_models, "_modelling_rows", lambda spark, sf: spark.range(1000).repartition(100))
    cores = spark.sparkContext.defaultParallelism
    d = q_models.modelling_table(spark, "")
    assert d.rdd.getNumPartitions() == cores and d.count() == 1000
    monkeypatch.setattr(q_models, "ROWS_PER_FIT_TASK", 20)
    assert q_models.modelling_table(spark, "").rdd.getNumPartitions() == max(cores, 50)
