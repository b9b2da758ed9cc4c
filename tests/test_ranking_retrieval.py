"""Ranking without a cap, and lexical scores by the rule."""

from pyspark.sql import functions as F

from evtrail.operators import dashboards as L
from evtrail.operators import ranking as J
from evtrail.operators import retrieval as K
from evtrail.operators import rules as R


def test_best_provider_with_the_highest_id_wins(spark):
    prov = spark.range(1, 1201).select(
        F.col("id").alias("provider_id"), F.lit("large brass asia").alias("specialty"),
        F.when(F.col("id") == 1200, 99.0).otherwise(10.0).alias("quality"))
    needs = spark.createDataFrame([("n", "large")], "need_key string, need_specialty string")
    cand = J.candidate_fetch(needs, prov, "need_key", "need_specialty")
    assert cand.count() == 1200
    scored = J.topsis(cand.withColumn("semantic_score", F.lit(1.0)), "need_key", ["semantic_score", "norm_quality"], [0.5, 0.5])
    assert J.rank_topk(scored, "need_key", "topsis_score", "provider_id", 1).first()["provider_id"] == 1200


def _search(spark, queries, docs, k=4):
    q = spark.createDataFrame(queries, "q long, text string, f array<string>")
    d = spark.createDataFrame(docs, "d long, text string, tags array<string>")
    out = K.lexical_search(q, d, "q", F.col("text"), F.col("f"), "d", F.col("text"), F.col("tags"), k=k)
    return {(r["q"], r["rank"]): (r["d"], r["score"]) for r in out.collect()}


def test_tags_are_document_text_and_give_the_bonus(spark):
    # 'hello' 1 + tag token 'en' 1 + filter equals tag 3
    got = _search(spark, [(1, "hello", ["en"])], [(1, "hello world", ["en", "web"])])
    assert got == {(1, 1): (1, 5.0)}


def test_lexical_search_against_brute_force(spark):
    import random
    import re
    from collections import Counter
    rng = random.Random(3)
    words = ["alpha", "beta", "en", "web", "x1", "y_2"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 6))), rng.sample(["en", "Web", "日本", "q-r"], rng.randint(0, 2)))
            for i in range(60)]
    qs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 4))), rng.sample(["EN", "日本", "q-r", "zz"], rng.randint(0, 2)))
          for i in range(12)]
    tok = lambda t: Counter(re.findall("[a-z0-9_]+", t.lower()))
    want = {}
    for q, text, f in qs:
        a, ranked = tok(" ".join([text, *f])), []
        for d, body, tags in docs:
            b = tok(" ".join([body, *tags]))
            s = sum(min(a[w], b[w]) for w in a)
            s += 3 if {x.lower() for x in f} & {x.lower() for x in tags} else 0
            if s:
                ranked.append((-s, d))
        for r, (s, d) in enumerate(sorted(ranked)[:4], 1):
            want[q, r] = (d, float(-s))
    assert _search(spark, qs, docs) == want


def test_search_scores_few_of_the_sharing_pairs(spark):
    import random

    from evtrail.operators import postings as P
    rng = random.Random(8)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(400)]
    docs = [(i, " ".join(rng.choices(common, k=30) + rng.sample(rare, 6)), ["en"] if i % 3 else ["fr"]) for i in range(600)]
    qs = [(i, " ".join(docs[i * 7][1].split()[20:]), ["en"] if i % 2 else []) for i in range(40)]
    d = spark.createDataFrame(docs, "d long, text string, tags array<string>")
    q = spark.createDataFrame(qs, "_q long, text string, _qf array<string>")
    terms = K.term_counts(q, "_q", F.concat_ws(" ", "text", F.array_join("_qf", " "))).withColumnRenamed("tf", "qtf")
    index = P.build_index(d, "d", F.col("text"), F.col("tags"))
    pairs, _, _ = P.candidates(index, terms, q.select("_q", "_qf").where(F.size("_qf") > 0), 4, 3.0)
    sharing = index.postings.join(terms, "term").select("_q", "_d").distinct().count()
    assert pairs.count() < sharing / 3
    got = _search(spark, qs, docs)
    from collections import Counter
    tok = lambda t: Counter(t.split())
    for i, text, f in qs:
        a = tok(" ".join([text, *f]))
        ranked = sorted((-(sum((a & tok(" ".join([b, *t]))).values()) + (3 if set(f) & set(t) else 0)), j) for j, b, t in docs)
        assert [got[i, r] for r in range(1, 5)] == [(j, float(-s)) for s, j in ranked[:4]]


def test_case_graph_content(spark):
    cases = spark.createDataFrame([(1, 10, "HIGH", "RED", "Path"), (2, 20, None, None, None)],
                                  "entity_id long, index_id long, band string, safety_status string, pathway_name string")
    drivers = spark.createDataFrame([(1, ["a", "b", "c", "d"])], "entity_id long, drivers array<string>")
    providers = spark.createDataFrame([(1, 2, 7), (1, 1, 9), (1, 4, 5)], "entity_id long, rank int, provider_id long")
    nodes, edges = K.case_graph(cases, drivers, providers)
    assert {tuple(r) for r in nodes.collect()} == {
        (1, "patient:1", "Patient", "Patient 1"), (1, "encounter:10", "Encounter", "Encounter 10"),
        (1, "risk", "RiskAssessment", "Historical risk: HIGH"), (1, "safety", "SafetyAssessment", "Safety: RED"),
        (1, "pathway", "CarePathway", "Path"), (1, "driver:0", "RiskDriver", "a"), (1, "driver:1", "RiskDriver", "b"),
        (1, "driver:2", "RiskDriver", "c"), (1, "provider:0", "Provider", "9"), (1, "provider:1", "Provider", "7"),
        (2, "patient:2", "Patient", "Patient 2"), (2, "encounter:20", "Encounter", "Encounter 20"),
        (2, "risk", "RiskAssessment", "Historical risk: UNKNOWN"), (2, "safety", "SafetyAssessment", "Safety: PENDING"),
        (2, "pathway", "CarePathway", "Assessment required")}
    assert {tuple(r) for r in edges.where("entity_id = 1").collect()} == {
        (1, "patient:1", "encounter:10", "HAS_ENCOUNTER"), (1, "encounter:10", "risk", "HAS_RISK_ASSESSMENT"),
        (1, "encounter:10", "safety", "HAS_SAFETY_ASSESSMENT"), (1, "risk", "pathway", "INFORMS"),
        (1, "safety", "pathway", "GOVERNS"), (1, "risk", "driver:0", "SUPPORTED_BY"), (1, "risk", "driver:1", "SUPPORTED_BY"),
        (1, "risk", "driver:2", "SUPPORTED_BY"), (1, "pathway", "provider:0", "MATCHED_TO"),
        (1, "pathway", "provider:1", "MATCHED_TO")}


def test_lookup_falls_back_to_the_latest_row(spark):
    rows = spark.createDataFrame([(1, 10, 5, "a"), (1, 11, 6, "b"), (2, 20, 1, "c")], "e long, ev long, ts long, v string")
    req = spark.createDataFrame([(1, 10), (1, 99), (2, 20)], "e long, req_event long")
    got = {(r["e"], r["req_event"]): (r["exact_match"], r["ev"], r["v"])
           for r in L.lookup_or_latest(rows, req, "e", "ev", "ts").collect()}
    assert got == {(1, 10): (1, 10, "a"), (1, 99): (0, 11, "b"), (2, 20): (1, 20, "c")}


def test_compound_conflict_needs_both_active(spark):
    iv = spark.createDataFrame(
        [(1, "c1", "allergy", 0, 10), (1, "c1", "medication", 12, 20), (1, "c2", "allergy", 5, None),
         (1, "c2", "medication", 7, 9), (1, "c2", "medication", 8, 11)], "e long, code string, kind string, s long, p long")
    iv = iv.select("e", "code", "kind", *[F.timestamp_seconds(F.col(c) * 86400).alias(c) for c in ("s", "p")])
    q = spark.createDataFrame([(1, d) for d in range(14)], "e long, d long").withColumn("t", F.timestamp_seconds(F.col("d") * 86400))
    none = spark.createDataFrame([], "code string")
    out = R.compound_flags(q, iv, "e", "t", "kind", "code", "s", "p", none, F.lit(True))
    assert {r["d"] for r in out.where("R13 = 1").collect()} == {7, 8, 9, 10}
