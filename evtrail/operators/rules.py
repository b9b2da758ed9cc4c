"""Deterministic decision rules (I) as column expressions.

Every rule is a ``when`` chain or a lookup in a small literal map, so a
whole cohort is evaluated in one projection inside whole-stage codegen; the
rule tables are constants (a few dozen rows) and never grow with the data.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evtrail.functions.prefix import running_state
from evtrail.operators.cleaning import fahrenheit_to_celsius
from evtrail.operators.pointintime import sweep_count

# ------------------------------------------------------------------------
# Safety rule table (rule id -> severity, action, reason).
SAFETY_RULES = {
    "T02": ("RED", "Emergency Evaluation", "Severe hypothermia"),
    "T01": ("YELLOW", "Urgent Medical Review", "Hypothermia concern"),
    "T04": ("YELLOW", "Urgent Medical Review", "Fever"),
    "T05": ("YELLOW", "Urgent Medical Review", "Significant fever"),
    "T06": ("RED", "Emergency Evaluation", "Severe hyperthermia"),
    "S03": ("RED", "Emergency Evaluation", "Severe hypoxia"),
    "S02": ("YELLOW", "Urgent Medical Review", "Low oxygen saturation"),
    "HR07": ("RED", "Emergency Evaluation", "Severe bradycardia"),
    "HR06": ("YELLOW", "Urgent Medical Review", "Significant bradycardia"),
    "HR02": ("YELLOW", "Urgent Medical Review", "Elevated heart rate"),
    "HR03": ("YELLOW", "Urgent Medical Review", "Significant tachycardia"),
    "HR04": ("RED", "Emergency Evaluation", "Severe tachycardia"),
    "BP03": ("RED", "Emergency Evaluation", "Severe hypotension"),
    "BP02": ("YELLOW", "Urgent Medical Review", "Low blood pressure"),
    "BP04": ("YELLOW", "Urgent Medical Review", "Markedly elevated BP"),
    "BP05": ("RED", "Emergency Evaluation", "Severe hypertension"),
    "RR05": ("RED", "Emergency Evaluation", "Severe respiratory depression"),
    "RR04": ("YELLOW", "Urgent Medical Review", "Low respiratory rate"),
    "RR02": ("YELLOW", "Urgent Medical Review", "Elevated respiratory rate"),
    "RR03": ("RED", "Emergency Evaluation", "Severe respiratory distress"),
    "AV03": ("RED", "Emergency Evaluation", "Altered mental status (Pain)"),
    "AV04": ("RED", "Emergency Evaluation", "Altered mental status (Unresponsive)"),
    "AV02": ("YELLOW", "Urgent Medical Review", "Altered mental status (Voice)"),
    "SYM01": ("RED", "Emergency Evaluation", "Potential Acute Coronary Syndrome"),
    "SYM02": ("YELLOW", "Urgent Medical Review", "Reported shortness of breath"),
    "SYM03": ("RED", "Emergency Evaluation", "Severe hemorrhage"),
    "SYM04": ("RED", "Emergency Evaluation", "Active seizure"),
    "SYM05": ("RED", "Emergency Evaluation", "Anaphylaxis risk"),
    "SYM06": ("RED", "Emergency Evaluation", "Acute presentation of critical condition"),
    "SYM07": ("RED", "Emergency Evaluation", "Medication/Allergy Contraindication"),
    "PAIN01": ("YELLOW", "Urgent Medical Review", "Moderate pain"),
    "PAIN02": ("YELLOW", "Urgent Medical Review", "Severe acute pain"),
}

# Normalised symptom flag -> rule id and evidence text.
SYMPTOM_RULES = [
    ("chest pain", "SYM01", "UI Flag: Chest pain"),
    ("shortness of breath", "SYM02", "UI Flag: Shortness of breath"),
    ("bleeding", "SYM03", "UI Flag: Bleeding"),
    ("convulsions", "SYM04", "UI Flag: Convulsions"),
    ("allergic reaction", "SYM05", "UI Flag: Allergic Reaction"),
    ("active high-risk condition", "SYM06", "UI Flag: Active high-risk condition"),
    ("safety conflict", "SYM07", "Conflict: Contraindication detected"),
]

SEVERITY_RANK = {"GREEN": 0, "YELLOW": 1, "RED": 2}

# Safety status -> care pathway (risk band matters on GREEN).
PATHWAYS = {
    "P1": ("Emergency / Immediate Clinical Evaluation", "RED safety status overrides all risk."),
    "P2": ("Urgent Clinician Review", "YELLOW safety status requires immediate human clinician evaluation."),
    "P3": ("Priority Outpatient Follow-up", "GREEN safety but HIGH historical repeat-ED risk."),
    "P4": ("Routine Outpatient Follow-up", "GREEN safety and MEDIUM risk."),
    "P5": ("Preventive / Routine Care Management", "GREEN safety and LOW risk."),
    "Assessment Required": ("Assessment Required", "Current clinical information is required before proceeding."),
    "UNKNOWN": ("Unknown", "Unmapped logic state"),
}

PATHWAY_PRIORITY = ["CARE_MANAGEMENT", "PRIMARY_CARE", "TELEHEALTH", "URGENT_CARE"]


def _lit_map(d: dict) -> Column:
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])


# ------------------------------------------------------------- I1 band ----

def risk_band(p: Column, high: float = 0.15, medium: float = 0.05) -> Column:
    """Serving bands (>0.15 / >0.05); batch uses high=.6, medium=.3."""
    return F.when(p > high, "HIGH").when(p > medium, "MEDIUM").otherwise("LOW")


def display_score(p: Column) -> Column:
    """Display score min(5p, .99) rounded to 3."""
    return F.round(F.least(p * 5, F.lit(0.99)), 3)


# ------------------------------------------------------- I3 / I4 vitals ----

def _fmt(c: Column, fmt: str) -> Column:
    return F.format_string(fmt, c)


#: Per vital, in evaluation order, the evidence around its value
#: and the values ``x`` at which each rule fires.
VITAL_BANDS = (
    ("temperature", "Temp = ", "°C", {"T02": "x < 32.22", "T01": "x >= 32.22 AND x < 35", "T04": "x >= 38 AND x < 39",
                                      "T05": "x >= 39 AND x < 40", "T06": "x >= 40"}),
    ("spo2", "SpO2 = ", "%", {"S03": "x < 92", "S02": "x >= 92 AND x <= 93"}),
    ("heart_rate", "HR = ", " bpm", {"HR07": "x < 40", "HR06": "x >= 40 AND x < 50", "HR02": "x >= 101 AND x < 121",
                                     "HR03": "x >= 121 AND x <= 130", "HR04": "x > 130"}),
    ("systolic_bp", "Systolic BP = ", " mmHg", {"BP03": "x < 90", "BP02": "x >= 90 AND x <= 99",
                                                "BP04": "x >= 181 AND x < 200", "BP05": "x >= 200"}),
    ("respiratory_rate", "RR = ", " bpm", {"RR05": "x <= 8", "RR04": "x > 8 AND x <= 11", "RR02": "x >= 21 AND x < 30",
                                           "RR03": "x >= 30"}),
    ("avpu", "AVPU = ", "", {"AV02": "x IN ('V', 'VOICE')", "AV03": "x IN ('P', 'PAIN')",
                             "AV04": "x IN ('U', 'UNRESPONSIVE')"}),
    ("pain", "Pain = ", "/10", {"PAIN01": "x >= 4 AND x < 7", "PAIN02": "x >= 7"}),
)


def vital_triggers(values: dict[str, str]) -> list[tuple[Column, Column]]:
    """Per vital of the table, in its order, (rule id or null, evidence).
    ``values``: the column that holds each vital."""
    slots = []
    for vital, before, after, bands in VITAL_BANDS:
        col = values[vital]
        fired = F.expr("CASE " + " ".join(f"WHEN {re.sub(r'\bx\b', f'`{col}`', cond)} THEN '{rule}'"
                                          for rule, cond in bands.items()) + " END")
        shown = _fmt(F.col(col), "%.2f") if vital == "temperature" else F.col(col).cast("string")
        slots.append((fired, F.concat(F.lit(before), shown, F.lit(after))))
    return slots


def true_symptoms(flags: Column) -> Column:
    """I4: keys whose value is boolean TRUE, trimmed and lower-cased.  (A
    higher-order function: call it once at ingestion, then pass the array.)"""
    kept = F.map_filter(flags, lambda k, v: v)
    return F.array_distinct(F.transform(F.map_keys(kept), lambda k: F.lower(F.trim(k))))


def symptom_triggers(syms: Column) -> list[tuple[Column, Column]]:
    return [(F.when(F.array_contains(syms, key), F.lit(rule)), F.lit(ev)) for key, rule, ev in SYMPTOM_RULES]


def resolve_first_max(rules: list[Column], red: Sequence[str]) -> Column:
    """Highest severity wins, first trigger in evaluation order wins ties --
    plain coalesce over the fixed trigger slots (stays in generated code)."""
    reds = [F.when(r.isin(*red), r) for r in rules]
    return F.coalesce(*reds, *rules)


# ------------------------------------------------ I5 / I6 resolution ------

def safety_assessment(df: DataFrame, temp: str = "temperature", spo2: str = "spo2", hr: str = "heart_rate",
                      sbp: str = "systolic_bp", rr: str = "respiratory_rate", avpu: str = "avpu", pain: str = "pain",
                      flags: str = "flags", symptoms: str | None = None, convert_fahrenheit: bool = True) -> DataFrame:
    """Triggers, max severity (first trigger wins ties), reason /
    action from the rule table, completeness gate (PENDING when nothing
    fired and temperature or symptom information is missing; a trigger
    outranks missing data).  ``symptoms``: a column with the normalised
    TRUE symptom names (preferred); otherwise they are derived from the
    ``flags`` map.  ``fired_rules`` is the comma-joined trigger list."""
    t = fahrenheit_to_celsius(F.col(temp)) if convert_fahrenheit else F.col(temp).cast("double")
    syms = (F.coalesce(F.col(symptoms), F.array().cast("array<string>")) if symptoms
            else true_symptoms(F.coalesce(F.col(flags), F.create_map().cast("map<string,boolean>"))))
    named = {"temperature": t, "avpu": F.upper(F.trim(F.col(avpu).cast("string")))}
    named |= {v: F.col(c).cast("double") for v, c in (("spo2", spo2), ("heart_rate", hr), ("systolic_bp", sbp),
                                                      ("respiratory_rate", rr), ("pain", pain))}
    slots = vital_triggers({v: f"_v_{v}" for v in named}) + symptom_triggers(syms)
    d = df.withColumns({"_t": t, "_syms": syms} | {f"_v_{v}": c for v, c in named.items()})
    d = d.withColumns({f"_r{i}": r for i, (r, _) in enumerate(slots)} | {f"_e{i}": e for i, (_, e) in enumerate(slots)})
    rules = [F.col(f"_r{i}") for i in range(len(slots))]
    red = [k for k, v in SAFETY_RULES.items() if v[0] == "RED"]
    d = d.withColumns({"_top": resolve_first_max(rules, red), "_fired": F.concat_ws(",", *rules)})
    # rule ids are unique across slots, so the top rule identifies its evidence
    d = d.withColumn("_ev", F.coalesce(*[F.when(F.col(f"_r{i}") == F.col("_top"), F.col(f"_e{i}"))
                                         for i in range(len(slots))]))
    missing = F.concat_ws(", ", F.when(F.col("_t").isNull(), F.lit("Temperature")),
                          F.when(F.size("_syms") == 0, F.lit("Current Symptoms")))
    reason_map = _lit_map({k: v[2] for k, v in SAFETY_RULES.items()})
    action_map = _lit_map({k: v[1] for k, v in SAFETY_RULES.items()})
    none = F.col("_top").isNull()
    pending = none & (missing != "")
    status = (F.when(pending, "PENDING").when(none, "GREEN")
              .when(F.col("_top").isin(*red), "RED").otherwise("YELLOW"))
    return d.select(
        *[c for c in df.columns],
        F.col("_fired").alias("fired_rules"),
        status.alias("status"),
        F.coalesce(F.col("_top"), F.lit("None")).alias("triggered_rule"),
        F.when(pending, "Current clinical assessment incomplete").when(none, "No detected safety red flag")
        .otherwise(F.try_element_at(reason_map, F.col("_top"))).alias("reason"),
        F.when(pending, F.concat(F.lit("Missing required fields: "), missing))
        .when(none, "Required parameters within normal limits").otherwise(F.col("_ev")).alias("supporting_data"),
        F.when(pending, "Complete Care Assessment").when(none, "Proceed with automated care pathway")
        .otherwise(F.try_element_at(action_map, F.col("_top"))).alias("recommended_action"),
        F.when(pending, "System requires clinical data")
        .when(none, "System proceeds autonomously")
        .otherwise("Human clinician/care manager now proceed").alias("final_decision"))


def status_distribution(assessed: DataFrame) -> DataFrame:
    """Status counts (PENDING included) and the set of fired rules
    (bounded by the 33-rule table)."""
    rules = F.array_remove(F.split("fired_rules", ","), "")
    return assessed.groupBy("status").agg(
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_set(rules)))), ",").alias("rules"))


# ---------------------------------------------------------- I9 compound ----

def compound_flags(queries: DataFrame, intervals: DataFrame, entity: str, query_ts: str, kind: str, code: str,
                   start: str, stop: str, high_risk: DataFrame, acute: Column) -> DataFrame:
    """R12 = an active high-risk condition AND an acute flag; R13 =
    an allergy active at t whose code equals a medication active at t.

    Active = START <= t AND (STOP IS NULL OR STOP > t).  Both use the sweep
    (no query x interval pairs); R13 first runs two counts per (entity, code),
    of active allergies and of active medications, and keeps the spans where
    both are above zero -- no allergy x medication pairs."""
    iv = intervals.where(F.col(start).isNotNull())
    us = F.unix_micros
    # the high-risk code list is data-derived: the planner broadcasts it only
    # when its measured size is under the broadcast threshold
    cond = iv.where(F.col(kind) == "condition").join(high_risk, code, "left_semi")
    ts = lambda c: F.col(c).cast("timestamp")  # noqa: E731  (NTZ -> session-UTC instant)
    c_iv = cond.select(entity, (us(ts(start)) - 1).alias("_o"), (us(ts(stop)) - 1).alias("_c"))
    q = queries.withColumn("_qk", us(ts(query_ts)))
    day_us = 86_400_000_000
    out = sweep_count(c_iv, q, entity, "_o", "_c", "_qk", "_n_hr", bucket_width=day_us)
    two = iv.where(F.col(kind).isin("allergy", "medication") & (F.col(stop).isNull() | (F.col(stop) > F.col(start))))
    two = two.select(entity, code, (F.col(kind) == "allergy").cast("long").alias("_al"),
                     F.explode(F.array(F.struct(us(ts(start)).alias("t"), F.lit(1).alias("d")),
                                       F.struct(us(ts(stop)).alias("t"), F.lit(-1).alias("d")))).alias("_x"))
    two = two.where(F.col("_x.t").isNotNull()).groupBy(entity, code, F.col("_x.t").alias("_t")).agg(
        F.sum(F.col("_al") * F.col("_x.d")).alias("_da"), F.sum((1 - F.col("_al")) * F.col("_x.d")).alias("_dm"))
    w = Window.partitionBy(entity, code).orderBy("_t")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = two.select(entity, F.col("_t").alias("_s"), F.lead("_t").over(w).alias("_e"),
                       F.sum("_da").over(run).alias("_a"), F.sum("_dm").over(run).alias("_m"))
    o_iv = spans.where((F.col("_a") > 0) & (F.col("_m") > 0)).select(
        entity, (F.col("_s") - 1).alias("_o"), (F.col("_e") - 1).alias("_c"))
    out = sweep_count(o_iv, out, entity, "_o", "_c", "_qk", "_n_conflict", bucket_width=day_us)
    return out.drop("_qk").withColumns({
        "R12": ((F.coalesce("_n_hr", F.lit(0)) > 0) & acute).cast("int"),
        "R13": (F.coalesce("_n_conflict", F.lit(0)) > 0).cast("int")}).drop("_n_hr", "_n_conflict")


# ------------------------------------------------------------- I10 ---------

def care_pathway(band: Column, status: Column) -> Column:
    """Returns pathway id; MODERATE is an alias of MEDIUM."""
    b = F.when(F.upper(band) == "MODERATE", "MEDIUM").otherwise(F.upper(band))
    return (F.when(status == "RED", "P1").when(status == "YELLOW", "P2")
            .when((status == "GREEN") & (b == "HIGH"), "P3").when((status == "GREEN") & (b == "MEDIUM"), "P4")
            .when(status == "GREEN", "P5").when(status == "PENDING", "Assessment Required").otherwise("UNKNOWN"))


def pathway_name(pid: Column) -> Column:
    return F.try_element_at(_lit_map({k: v[0] for k, v in PATHWAYS.items()}), pid)


# ------------------------------------------------------- I12-I14 -----------

def opportunity_score(risk: Column, ed: Column, outpatient: Column, inpatient: Column) -> Column:
    """I12 [our choice of weights, fits every documented case]."""
    e = F.coalesce(ed, F.lit(0))
    s = (F.lit(40.0) * F.coalesce(risk, F.lit(0.0))
         + F.when(e >= 3, 30).when(e == 2, 20).otherwise(0)
         + F.when(F.coalesce(outpatient, F.lit(0)) == 0, 30).otherwise(0)
         - F.when(F.coalesce(inpatient, F.lit(0)) >= 2, 20).otherwise(0))
    return F.least(F.greatest(s, F.lit(0.0)), F.lit(100.0))


def opportunity_level(score: Column) -> Column:
    return F.when(score >= 70, "HIGH").when(score >= 40, "MEDIUM").otherwise("LOW")


def drivers(ed: Column, outpatient: Column, inpatient: Column, days_since_ed: Column, burden: Column) -> Column:
    """array<struct(driver_id, evidence, strength)>; empty -> one
    INSUFFICIENT_EVIDENCE entry.  A null outpatient count never fires the
    low-engagement driver."""
    def d(cond, did, ev, strength):
        return F.when(cond, F.struct(F.lit(did).alias("driver_id"), ev.alias("evidence"), strength.alias("strength")))
    e = F.coalesce(ed, F.lit(0))
    arr = F.array_compact(F.array(
        d(e >= 3, "HIGH_ED_FREQUENCY", F.format_string("ed_visits_90d=%d", e),
          F.when(e >= 5, F.lit("HIGH")).otherwise(F.lit("MEDIUM"))),
        d(e == 2, "REPEATED_ED_UTILIZATION", F.lit("ed_visits_90d=2"), F.lit("MEDIUM")),
        d(days_since_ed <= 14, "RECENT_ED_UTILIZATION", F.format_string("days_since_latest_ed=%d", days_since_ed),
          F.when(days_since_ed <= 7, F.lit("HIGH")).otherwise(F.lit("MEDIUM"))),
        d(outpatient == 0, "LOW_OUTPATIENT_ENGAGEMENT", F.lit("outpatient_visits_90d=0"), F.lit("MEDIUM")),
        d(inpatient >= 2, "HIGH_INPATIENT_ACUITY_CONTEXT", F.format_string("inpatient_visits_90d=%d", inpatient),
          F.lit("HIGH")),
        d((burden >= 3) & (outpatient == 0), "CARE_COORDINATION_GAP",
          F.format_string("chronic_condition_burden=%d", burden), F.lit("MEDIUM"))))
    none = F.array(F.struct(F.lit("INSUFFICIENT_EVIDENCE").alias("driver_id"), F.lit("").alias("evidence"),
                            F.lit("LOW").alias("strength")))
    return F.when(F.size(arr) == 0, none).otherwise(arr)


def pathway_candidates(driver_arr: Column, level: Column, telehealth_preferred: Column) -> Column:
    """Ordered candidate list (priority CARE_MANAGEMENT > PRIMARY >
    TELEHEALTH > URGENT)."""
    ids = F.transform(driver_arr, lambda x: x["driver_id"])
    has = lambda k: F.array_contains(ids, k)
    ok = level.isin("HIGH", "MEDIUM")
    inp = has("HIGH_INPATIENT_ACUITY_CONTEXT")
    cm = ok & has("CARE_COORDINATION_GAP")
    pc = ok & has("LOW_OUTPATIENT_ENGAGEMENT") & ~inp
    uc = ok & has("RECENT_ED_UTILIZATION") & ~inp
    th = (cm | pc | uc) & F.coalesce(telehealth_preferred, F.lit(False))
    flags = {"CARE_MANAGEMENT": cm, "PRIMARY_CARE": pc, "TELEHEALTH": th, "URGENT_CARE": uc}
    return F.array_compact(F.array(*[F.when(flags[k], F.lit(k)) for k in PATHWAY_PRIORITY]))


def recommended(cands: Column) -> Column:
    return F.coalesce(F.try_element_at(cands, F.lit(1)), F.lit("NO_PATHWAY_RECOMMENDATION"))


def alternatives(cands: Column) -> Column:
    """All candidates after the recommended one."""
    return F.when(F.size(cands) > 1, F.slice(cands, F.lit(2), F.size(cands) - 1)).otherwise(
        F.array().cast("array<string>"))


# ----------------------------------------------------------- I15 -----------

def lineage_gate(provider: DataFrame, pathway: DataFrame, driver: DataFrame, opportunity: DataFrame,
                 safety: DataFrame) -> DataFrame:
    """Each stage row names its parent session id; the chain must
    resolve, share the case id, and the safety stage must be
    NO_EMERGENCY_INDICATOR.  Four left joins + status expression.
    Inputs: (session_id, parent_id, case_id[, status])."""
    p = provider.select(F.col("session_id").alias("provider_session"), F.col("parent_id").alias("_pw"),
                        F.col("case_id").alias("case_id"))
    pw = pathway.select(F.col("session_id").alias("_pw"), F.col("parent_id").alias("_dr"),
                        F.col("case_id").alias("_c_pw"))
    dr = driver.select(F.col("session_id").alias("_dr"), F.col("parent_id").alias("_op"),
                       F.col("case_id").alias("_c_dr"))
    op = opportunity.select(F.col("session_id").alias("_op"), F.col("parent_id").alias("_sf"),
                            F.col("case_id").alias("_c_op"))
    sf = safety.select(F.col("session_id").alias("_sf"), F.col("case_id").alias("_c_sf"),
                       F.col("status").alias("_st"))
    j = (p.join(pw, "_pw", "left").join(dr, "_dr", "left").join(op, "_op", "left").join(sf, "_sf", "left"))
    missing = F.col("_c_pw").isNull() | F.col("_c_dr").isNull() | F.col("_c_op").isNull() | F.col("_c_sf").isNull()
    mism = ((F.col("_c_pw") != F.col("case_id")) | (F.col("_c_dr") != F.col("case_id")) |
            (F.col("_c_op") != F.col("case_id")) | (F.col("_c_sf") != F.col("case_id")))
    return j.select("provider_session", "case_id",
                    F.when(missing, "MISSING_PARENT").when(mism, "CASE_MISMATCH")
                    .when(F.col("_st") != "NO_EMERGENCY_INDICATOR", "BLOCKED_BY_SAFETY").otherwise("VALID")
                    .alias("lineage_status"))


# ----------------------------------------------------------- I16 -----------

def reassessment(context_events: DataFrame, session: str, order: Sequence[str], fields: Sequence[str], attempt_limit: int = 2,
                 sets: Sequence[str] = (), assess=None) -> DataFrame:
    """I16: per session, merge context fields over time (last non-null wins,
    ``sets`` columns add up), count attempts, re-assess; still PENDING after
    ``attempt_limit`` attempts -> HUMAN_CLINICAL_REVIEW.  ``order`` (time,
    then id) is a total order, so equal times give one result.  The state runs
    over ranges of a session, so a long one is split."""
    rows = context_events.select(session, *order, *fields, *sets, F.lit(1).cast("long").alias("attempt"))
    merged = running_state(rows, [session], list(order), list(fields), ["attempt"], list(sets))
    a = (assess or (lambda d: safety_assessment(d, symptoms="symptoms" if "symptoms" in sets else None)))(merged)
    return a.withColumn("outcome", F.when((F.col("status") == "PENDING") & (F.col("attempt") >= attempt_limit),
                                          "HUMAN_CLINICAL_REVIEW").otherwise(F.col("status")))


# ----------------------------------------------------------- I17 / I18 -----

REVIEW_DECISIONS = ("APPROVE", "MODIFY", "REJECT", "ESCALATE")


def review_gate(reviews: DataFrame, decision: str = "decision", original: str = "original_pathway",
                modified: str = "modified_pathway") -> DataFrame:
    """APPROVE/MODIFY create an intervention with final = modified ??
    original; REJECT/ESCALATE are blocked; anything else is invalid."""
    d = F.upper(F.trim(F.col(decision)))
    return reviews.withColumns({
        "review_status": F.when(d.isin("APPROVE", "MODIFY"), "INTERVENTION_CREATED")
        .when(d.isin("REJECT", "ESCALATE"), "BLOCKED").otherwise("INVALID_DECISION"),
        "final_pathway": F.when(d.isin("APPROVE", "MODIFY"), F.coalesce(F.col(modified), F.col(original)))})


def idempotent_create(new: DataFrame, existing: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the first new row per key (explicit order) and drop keys that
    already exist (anti-join)."""
    from evtrail.operators.cleaning import keep_first
    first = keep_first(new, keys, order)
    return first.join(existing.select(*keys).distinct(), list(keys), "left_anti")


def stable_id(*cols: Column) -> Column:
    """Deterministic id (sha2 of the key) instead of a random uuid, so
    re-runs are idempotent."""
    return F.sha2(F.concat_ws("|", *[c.cast("string") for c in cols]), 256)


# ----------------------------------------------------------- I19 / I20 -----

def outcome_windows(anchors: DataFrame, events: DataFrame, entity: str, anchor_day: str, event_day: str,
                    cls: str, classes: Sequence[str], window_days: int = 90) -> DataFrame:
    """For each anchor, count events of each class in (anchor,
    anchor+W] -- daily counts + RANGE frame over merged anchor days."""
    ev = events.groupBy(F.col(entity).alias("_e"), F.col(event_day).alias("_k")).agg(
        *[F.count(F.when(F.col(cls) == c, 1)).alias(f"_n_{c}") for c in classes])
    qk = anchors.select(F.col(entity).alias("_e"), F.col(anchor_day).alias("_k")).distinct()
    pts = ev.join(qk, ["_e", "_k"], "full")
    frame = Window.partitionBy("_e").orderBy("_k").rangeBetween(1, window_days)
    vals = pts.select("_e", "_k", *[F.coalesce(F.sum(f"_n_{c}").over(frame), F.lit(0)).cast("long").alias(f"{c}_{window_days}d")
                                    for c in classes])
    return anchors.join(vals, (anchors[entity] == vals["_e"]) & (anchors[anchor_day] == vals["_k"]), "left") \
        .drop("_e", "_k")


# ----------------------------------------------------------- I21 / I22 / I24

def extract_symptoms(text: Column) -> Column:
    """Keyword extraction -> struct(chest_pain bool, respiratory_rate,
    temperature, bleeding bool).  Booleans (not the string "Yes"), so the
    safety gate sees them."""
    t = F.lower(text)
    return F.struct(
        (t.contains("chest pain") | t.contains("chest hurts")).alias("chest_pain"),
        F.when(t.contains("short of breath") | t.contains("shortness of breath") | t.contains("breathing"),
               F.lit(24.0)).alias("respiratory_rate"),
        F.when(t.contains("fever"), F.lit(38.5)).alias("temperature"),
        t.contains("bleed").alias("bleeding"))


#: The sentence shown with each safety status.
GUARDRAILS = {
    "RED": "Safety status is RED. Do not suggest routine scheduling or alternatives to emergency evaluation.",
    "YELLOW": "Safety status is YELLOW. State that urgent human clinical review is required before routine navigation.",
    "PENDING": "Safety assessment is incomplete. State that current clinical information is required; "
               "do not infer missing findings.",
    "GREEN": "Safety status is GREEN. This permits navigation discussion only; final decisions remain with the "
             "human care manager.",
}


def guardrail_text(status: Column) -> Column:
    """Guardrail sentence per status (unknown -> GREEN text)."""
    return F.coalesce(F.try_element_at(_lit_map(GUARDRAILS), status), F.lit(GUARDRAILS["GREEN"]))


def summary_text(band: Column, score: Column, status: Column, pathway: Column, pathway_nm: Column) -> Column:
    """Structured summary line built with ``format_string``."""
    return F.format_string("Historical utilization risk: %s (score %s). Safety status: %s. Current pathway: %s — %s.",
                           band, score.cast("string"), status, pathway, pathway_nm)


#: The explanation of a case, section by section.  ``{name}``
#: stands for a value; the safety section goes by the status, the provider
#: section by whether a provider was matched.
EXPLANATION_HEAD = (
    "### AI Explanation Layer — Rule-based Explanation Engine",
    "*Disclaimer: This engine explains the deterministic outputs. It does not make clinical decisions, calculate risk, "
    "or override safety protocols.*",
)
EXPLANATION_RISK = (
    "**Historical Risk**: The patient was deterministically classified as {band} risk (Score: {score}) based on "
    "historical EHR patterns. The model identified the following key drivers: {drivers}.")
EXPLANATION_SAFETY = {
    "GREEN": "**Safety Gate**: Based on the provided clinical context, the safety gate evaluated to GREEN, meaning no "
             "immediate red flags were detected. Routine care is permitted.",
    "YELLOW": "**Safety Gate**: The safety gate triggered a YELLOW warning ({report}). This overrides standard risk and "
              "mandates an urgent clinician review before routine matching proceeds.",
    "other": "**Safety Gate**: A CRITICAL RED safety flag was triggered ({report}). This forces an immediate Emergency "
             "override, bypassing all routine provider matching to prioritize patient safety.",
}
EXPLANATION_PATHWAY = (
    "**Care Pathway**: Consequently, the system rigidly mapped the patient to {pathway} ({pathway_name}).")
EXPLANATION_PROVIDER = {
    True: "**Provider Matching**: Since the pathway permits routine care, the provider matching engine evaluated "
          "available specialists based on quality scores and patient compatibility. {provider} ranked #1 as the best fit.",
    False: "**Provider Matching**: Provider matching was deliberately BLOCKED by the safety engine to prevent "
           "inappropriate routine scheduling during an emergent/conditional clinical state.",
}
EXPLANATION_DEFAULTS = {"band": "UNKNOWN", "score": "0", "drivers": "", "report": "Normal vitals", "pathway": "UNKNOWN",
                        "pathway_name": "None", "status": "GREEN"}


def explanation_text(values: dict[str, Column]) -> Column:
    """The explanation of one case in five sections.  ``values``: band,
    score, drivers, status, report, pathway, pathway_name, provider; a null
    takes its default, and a null provider means none was matched."""
    known = {k: F.coalesce(c.cast("string"), F.lit(EXPLANATION_DEFAULTS[k])) if k in EXPLANATION_DEFAULTS
             else c.cast("string") for k, c in values.items()}

    def fill(template: str) -> Column:
        return F.concat(*[known[x] if i % 2 else F.lit(x) for i, x in enumerate(re.split(r"\{(\w+)\}", template))])

    safety = F.when(known["status"] == "GREEN", fill(EXPLANATION_SAFETY["GREEN"])).when(
        known["status"] == "YELLOW", fill(EXPLANATION_SAFETY["YELLOW"])).otherwise(fill(EXPLANATION_SAFETY["other"]))
    provider = F.when(known["provider"].isNotNull(), fill(EXPLANATION_PROVIDER[True])).otherwise(
        F.lit(EXPLANATION_PROVIDER[False]))
    sections = [fill(EXPLANATION_RISK), safety, fill(EXPLANATION_PATHWAY), provider]
    return F.concat_ws("\n\n", F.lit("\n".join(EXPLANATION_HEAD)), *sections)


# Reported symptoms that force an emergency decision.
SEVERE_SYMPTOMS = (
    "Severe or rapidly worsening symptoms",
    "Chest pain or severe breathing difficulty",
    "Fainting or new severe confusion",
    "Significant bleeding",
    "Other concerning/high-risk symptom",
)


def call_review_override(reported: Column, reviewer_decision: Column) -> Column:
    """Any severe reported symptom forces 'emergency'."""
    sev = F.array(*[F.lit(s.lower()) for s in SEVERE_SYMPTOMS])
    low = F.transform(reported, lambda x: F.lower(F.trim(x)))
    return F.when(F.arrays_overlap(low, sev), F.lit("emergency")).otherwise(reviewer_decision)


# ------------------------------------------------- I5 alternative matrix ---
# The 13-rule clinical matrix (rule id, severity, action).
# Thresholds differ from the banded engine above (e.g. heart rate < 60 or
# > 130).  R12 / R13 come from the compound interval rules (I9) or flags.
MATRIX_RULES = [
    ("R01", "RED", "Emergency Escalation"),
    ("R02", "YELLOW", "Urgent Medical Review"),
    ("R03", "RED", "Emergency Escalation"),
    ("R04", "RED", "Emergency Escalation"),
    ("R05", "YELLOW", "Urgent Medical Review"),
    ("R06", "RED", "Emergency Escalation"),
    ("R07", "YELLOW", "Urgent Medical Review"),
    ("R08", "RED", "Emergency Escalation"),
    ("R09", "RED", "Emergency Escalation"),
    ("R10", "RED", "Emergency Escalation"),
    ("R11", "RED", "Emergency Escalation"),
    ("R12", "RED", "Emergency Escalation"),
    ("R13", "RED", "Emergency Escalation"),
]


def matrix_rule_hits(temp_c: Column, spo2: Column, hr: Column, sbp: Column, rr: Column, avpu: Column, pain: Column,
                     syms: Column, r12: Column | None = None, r13: Column | None = None) -> list[Column]:
    """Per matrix rule, in table order: the rule id when it fires, else null."""
    av = F.upper(F.trim(avpu.cast("string")))
    has = lambda s: F.array_contains(syms, s)
    conds = [spo2 < 92, (hr < 60) | (hr > 130), (rr < 10) | (rr > 30), sbp < 90, (temp_c < 36.0) | (temp_c > 39.0),
             av.isin("V", "VOICE", "P", "PAIN", "U", "UNRESPONSIVE"), pain > 7, has("chest pain"), has("bleeding"),
             has("convulsions"), has("allergic reaction"),
             has("active high-risk condition") if r12 is None else (r12 == 1),
             has("safety conflict") if r13 is None else (r13 == 1)]
    return [F.when(F.coalesce(c, F.lit(False)), F.lit(rid)) for c, (rid, _, _) in zip(conds, MATRIX_RULES)]


def matrix_assessment(df: DataFrame, temp: str = "temperature", convert_fahrenheit: bool = True,
                      symptoms: str | None = None) -> DataFrame:
    """I5 (alternative): max severity over the matrix hits, first hit wins
    ties; GREEN when nothing fires.  Rule table is a literal map."""
    t = fahrenheit_to_celsius(F.col(temp)) if convert_fahrenheit else F.col(temp).cast("double")
    syms = (F.coalesce(F.col(symptoms), F.array().cast("array<string>")) if symptoms
            else true_symptoms(F.coalesce(F.col("flags"), F.create_map().cast("map<string,boolean>"))))
    hits = matrix_rule_hits(t, F.col("spo2").cast("double"), F.col("heart_rate").cast("double"),
                            F.col("systolic_bp").cast("double"), F.col("respiratory_rate").cast("double"),
                            F.col("avpu"), F.col("pain").cast("double"), syms)
    red = [r for r, s_, _ in MATRIX_RULES if s_ == "RED"]
    top = resolve_first_max(hits, red)
    act = _lit_map({r: a for r, _, a in MATRIX_RULES})
    return df.select("*", F.concat_ws(",", *hits).alias("matrix_rules"),
                     F.when(top.isNull(), "GREEN").when(top.isin(*red), "RED").otherwise("YELLOW").alias("matrix_status"),
                     F.coalesce(top, F.lit("None")).alias("matrix_rule"),
                     F.try_element_at(act, top).alias("matrix_action"))
