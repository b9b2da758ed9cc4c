"""Golden cases for the safety gate, pathway matrix and navigation rules
(expected outputs as documented in the reference's test tables)."""

from pyspark.sql import functions as F

from evtrail.operators import rules as R

CTX_SCHEMA = ("case string, temperature double, spo2 double, heart_rate double, systolic_bp double, "
              "respiratory_rate double, avpu string, pain double, flags map<string,boolean>")

# (case, temp F, spo2, hr, sbp, rr, avpu, pain, flags) -> expected status
SAFETY_CASES = [
    ("empty", None, None, None, None, None, None, None, {}, "PENDING"),
    ("normal_no_symptoms", 98.6, None, None, None, None, None, None, {"No current symptoms": True}, "GREEN"),
    ("normal_cough", 98.6, None, None, None, None, None, None, {"cough": True}, "GREEN"),
    ("fever_cough", 100.4, None, None, None, None, None, None, {"cough": True}, "YELLOW"),
    ("high_fever", 104.0, None, None, None, None, None, None, {"cough": True}, "RED"),
    ("cough_only", None, None, None, None, None, None, None, {"cough": True}, "PENDING"),
    ("sob_only", None, None, None, None, None, None, None, {"Shortness of Breath": True}, "YELLOW"),
    ("chest_pain_case", None, None, None, None, None, None, None, {" CHEST PAIN ": True}, "RED"),
    ("chest_pain_false", None, None, None, None, None, None, None, {"chest pain": False}, "PENDING"),
    ("spo2_90", 98.6, 90.0, None, None, None, None, None, {"cough": True}, "RED"),
    ("hr_125", 98.6, None, 125.0, None, None, None, None, {"cough": True}, "YELLOW"),
    ("hr_140", 98.6, None, 140.0, None, None, None, None, {"cough": True}, "RED"),
    ("sbp_85", 98.6, None, None, 85.0, None, None, None, {"cough": True}, "RED"),
    ("rr_32", 98.6, None, None, None, 32.0, None, None, {"cough": True}, "RED"),
    ("avpu_voice", 98.6, None, None, None, None, "Voice", None, {"cough": True}, "YELLOW"),
    ("avpu_unresp", 98.6, None, None, None, None, "Unresponsive", None, {"cough": True}, "RED"),
]

# threshold edges (already Celsius-range values pass unconverted)
EDGE_CASES = [
    ("t_32_22", 32.22, "T01"), ("t_32_21", 32.21, "T02"), ("t_35", 35.0, "None"), ("t_38", 38.0, "T04"),
    ("t_39", 39.0, "T05"), ("t_40", 40.0, "T06"), ("t_37_99", 37.99, "None"),
]


def test_safety_golden(spark):
    rows = [c[:-1] for c in SAFETY_CASES]
    df = spark.createDataFrame(rows, CTX_SCHEMA)
    out = {r["case"]: r["status"] for r in R.safety_assessment(df).collect()}
    for c in SAFETY_CASES:
        assert out[c[0]] == c[-1], c[0]


def test_temperature_edges(spark):
    rows = [(n, t, None, None, None, None, None, None, {"cough": True}) for n, t, _ in EDGE_CASES]
    out = {r["case"]: r["triggered_rule"] for r in R.safety_assessment(spark.createDataFrame(rows, CTX_SCHEMA)).collect()}
    for n, _, rule in EDGE_CASES:
        assert out[n] == rule, n


def test_first_trigger_wins_ties(spark):
    # two YELLOW triggers: temperature (order 1) beats heart rate (order 3)
    df = spark.createDataFrame([("t", 38.5, None, 125.0, None, None, None, None, {"x": True})], CTX_SCHEMA)
    r = R.safety_assessment(df).first()
    assert r["status"] == "YELLOW" and r["triggered_rule"] == "T04"


def test_pathway_matrix_all_combinations(spark):
    bands = ["HIGH", "MEDIUM", "LOW"]
    statuses = ["RED", "YELLOW", "GREEN"]
    rows = [(b, s) for s in statuses for b in bands] + [("HIGH", "PENDING"), ("MODERATE", "GREEN"), ("LOW", "BOGUS")]
    df = spark.createDataFrame(rows, "band string, status string")
    got = {(r["band"], r["status"]): r["p"] for r in df.select("band", "status",
                                                               R.care_pathway(F.col("band"), F.col("status")).alias("p")).collect()}
    for b in bands:
        assert got[(b, "RED")] == "P1"
        assert got[(b, "YELLOW")] == "P2"
    assert got[("HIGH", "GREEN")] == "P3" and got[("MEDIUM", "GREEN")] == "P4" and got[("LOW", "GREEN")] == "P5"
    assert got[("HIGH", "PENDING")] == "Assessment Required"
    assert got[("MODERATE", "GREEN")] == "P4"
    assert got[("LOW", "BOGUS")] == "UNKNOWN"


NAV_SCHEMA = "case string, risk double, ed int, out int, inp int, days int, burden int, tele boolean"
NAV = [
    ("high", 0.9, 4, 0, 0, None, None, False),
    ("high_inp", 0.9, 4, 0, 3, None, None, False),
    ("low", 0.2, 0, 1, 0, None, None, False),
    ("not_high", 0.1, 1, 2, None, None, None, False),
    ("trace_60", None, 4, 0, 1, None, None, False),
    ("primary", None, 4, 0, None, None, None, False),
    ("care_mgmt", None, 4, 0, None, None, 4, False),
    ("urgent", 0.8, 2, 2, None, 3, None, False),
    ("single_ed", None, 1, None, None, None, None, False),
    ("ed4_only", None, 4, None, None, None, None, False),
    ("primary_tele", None, 4, 0, None, None, None, True),
]


def test_navigation_cases(spark):
    df = spark.createDataFrame(NAV, NAV_SCHEMA)
    score = R.opportunity_score(F.col("risk"), F.col("ed"), F.col("out"), F.col("inp"))
    level = R.opportunity_level(score)
    drv = R.drivers(F.col("ed"), F.col("out"), F.col("inp"), F.col("days"), F.col("burden"))
    cands = R.pathway_candidates(drv, level, F.col("tele"))
    out = {r["case"]: r for r in df.select("case", score.alias("score"), level.alias("level"),
                                           F.transform(drv, lambda x: x["driver_id"]).alias("drivers"),
                                           R.recommended(cands).alias("rec"), R.alternatives(cands).alias("alt")).collect()}
    assert out["high"]["level"] == "HIGH"
    assert "HIGH_INPATIENT_ACUITY_CONTEXT" in out["high_inp"]["drivers"]
    assert out["low"]["level"] == "LOW"
    assert out["not_high"]["level"] != "HIGH"
    assert out["trace_60"]["score"] == 60 and out["trace_60"]["level"] == "MEDIUM"
    assert out["primary"]["rec"] == "PRIMARY_CARE"
    assert out["care_mgmt"]["rec"] == "CARE_MANAGEMENT" and "PRIMARY_CARE" in out["care_mgmt"]["alt"]
    assert out["urgent"]["rec"] == "URGENT_CARE"
    assert out["single_ed"]["rec"] == "NO_PATHWAY_RECOMMENDATION"
    assert out["high_inp"]["rec"] == "NO_PATHWAY_RECOMMENDATION"
    assert out["ed4_only"]["level"] in ("MEDIUM", "HIGH")      # navigable
    assert out["single_ed"]["level"] == "LOW"                    # not navigable
    assert out["single_ed"]["drivers"] == ["INSUFFICIENT_EVIDENCE"]
    assert "LOW_OUTPATIENT_ENGAGEMENT" not in out["ed4_only"]["drivers"]   # null outpatient never fires it
    assert out["primary_tele"]["alt"] == ["TELEHEALTH"]


def test_review_gate_and_idempotency(spark):
    rv = spark.createDataFrame([("r1", "APPROVE", "P4", None), ("r2", "modify", "P4", "P3"), ("r3", "REJECT", "P4", None),
                                ("r4", "ESCALATE", "P4", None), ("r5", "BOGUS", "P4", None)],
                               "review_id string, decision string, original_pathway string, modified_pathway string")
    g = {r["review_id"]: (r["review_status"], r["final_pathway"]) for r in R.review_gate(rv).collect()}
    assert g["r1"] == ("INTERVENTION_CREATED", "P4") and g["r2"] == ("INTERVENTION_CREATED", "P3")
    assert g["r3"][0] == "BLOCKED" and g["r4"][0] == "BLOCKED" and g["r5"][0] == "INVALID_DECISION"
    new = spark.createDataFrame([("r1", 0), ("r1", 1), ("r2", 0)], "review_id string, attempt int")
    existing = spark.createDataFrame([("r2",)], "review_id string")
    out = R.idempotent_create(new, existing, ["review_id"], ["attempt"]).collect()
    assert [(r["review_id"], r["attempt"]) for r in out] == [("r1", 0)]


def test_call_review_override(spark):
    df = spark.createDataFrame([(["Significant bleeding"], "routine"), (["Symptoms are mild or stable"], "routine")],
                               "reported array<string>, decision string")
    got = [r[0] for r in df.select(R.call_review_override(F.col("reported"), F.col("decision"))).collect()]
    assert got == ["emergency", "routine"]
