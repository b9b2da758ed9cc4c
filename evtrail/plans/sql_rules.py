"""DuckDB SQL generators for the rule oracles (context, safety gate)."""

from __future__ import annotations

from evtrail.operators.rules import SAFETY_RULES, SYMPTOM_RULES
from evtrail.plans.bindings import AVPU_OF_K, DECISION_HOUR, SYMPTOM_OF_K, VITAL_OF_EVENT


def _case(mapping_expr: str, pairs) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + " END"


def context_sql(before_hour: int | None = DECISION_HOUR) -> str:
    k = "CAST(props->>'k' AS INTEGER)"
    name = _case("", [(f"event_type = '{et}'", f"'{vn}'") for et, (vn, _, _) in VITAL_OF_EVENT.items()])
    val = _case("", [(f"event_type = '{et}'", f"round(value * {sc} + {off}, 1)")
                     for et, (_, sc, off) in VITAL_OF_EVENT.items()])
    sym = _case("", [(f"{k} % 20 = {r}", f"'{t}'") for r, (t, _) in SYMPTOM_OF_K.items()])
    symv = _case("", [(f"{k} % 20 = {r}", "TRUE" if v else "FALSE") for r, (_, v) in SYMPTOM_OF_K.items()])
    avpu = _case("", [(f"{k} % 25 = {r}", f"'{t}'") for r, t in AVPU_OF_K.items()])
    lat = ",\n".join(f"  arg_max(v, ts) FILTER (WHERE vn = '{vn}') AS {vn}" for _, (vn, _, _) in VITAL_OF_EVENT.items())
    return f"""ce AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, ts, event_id, {name} AS vn, {val} AS v,
   {sym} AS sym, {symv} AS symv, {avpu} AS avpu,
   CASE WHEN event_type = 'error' THEN CAST({k} % 11 AS DOUBLE) END AS pain
   FROM events{f" WHERE hour(ts) < {before_hour}" if before_hour is not None else ""}),
ctx AS (SELECT user_id, day,
{lat},
  arg_max(avpu, ts) FILTER (WHERE avpu IS NOT NULL) AS avpu,
  arg_max(pain, ts) FILTER (WHERE pain IS NOT NULL) AS pain,
  COALESCE(list_distinct(list(lower(trim(sym))) FILTER (WHERE sym IS NOT NULL AND symv)), []) AS syms
  FROM ce GROUP BY user_id, day)"""


def _rule_cols(src: str = "ctx") -> str:
    t = "CASE WHEN temperature > 45 THEN (temperature - 32) * 5.0 / 9.0 ELSE temperature END"
    return f"""r0 AS (SELECT *, {t} AS tc, upper(trim(avpu)) AS av FROM {src}),
r1 AS (SELECT *,
  CASE WHEN tc < 32.22 THEN 'T02' WHEN tc < 35.0 THEN 'T01' WHEN tc >= 40.0 THEN 'T06' WHEN tc >= 39.0 THEN 'T05'
       WHEN tc >= 38.0 THEN 'T04' END AS r_t, printf('Temp = %.2f°C', tc) AS e_t,
  CASE WHEN spo2 < 92 THEN 'S03' WHEN spo2 <= 93 THEN 'S02' END AS r_s, 'SpO2 = ' || CAST(spo2 AS VARCHAR) || '%' AS e_s,
  CASE WHEN heart_rate < 40 THEN 'HR07' WHEN heart_rate < 50 THEN 'HR06' WHEN heart_rate > 130 THEN 'HR04'
       WHEN heart_rate >= 121 THEN 'HR03' WHEN heart_rate >= 101 THEN 'HR02' END AS r_h,
  'HR = ' || CAST(heart_rate AS VARCHAR) || ' bpm' AS e_h,
  CASE WHEN systolic_bp < 90 THEN 'BP03' WHEN systolic_bp <= 99 THEN 'BP02' WHEN systolic_bp >= 200 THEN 'BP05'
       WHEN systolic_bp >= 181 THEN 'BP04' END AS r_b, 'Systolic BP = ' || CAST(systolic_bp AS VARCHAR) || ' mmHg' AS e_b,
  CASE WHEN respiratory_rate <= 8 THEN 'RR05' WHEN respiratory_rate <= 11 THEN 'RR04' WHEN respiratory_rate >= 30
       THEN 'RR03' WHEN respiratory_rate >= 21 THEN 'RR02' END AS r_r,
  'RR = ' || CAST(respiratory_rate AS VARCHAR) || ' bpm' AS e_r,
  CASE WHEN av IN ('V', 'VOICE') THEN 'AV02' WHEN av IN ('P', 'PAIN') THEN 'AV03'
       WHEN av IN ('U', 'UNRESPONSIVE') THEN 'AV04' END AS r_a, 'AVPU = ' || av AS e_a,
  CASE WHEN pain >= 7 THEN 'PAIN02' WHEN pain >= 4 THEN 'PAIN01' END AS r_p,
  'Pain = ' || CAST(pain AS VARCHAR) || '/10' AS e_p,
{",".join(f"  CASE WHEN list_contains(syms, '{key}') THEN '{rule}' END AS r_y{i}, '{ev}' AS e_y{i}" for i, (key, rule, ev) in enumerate(SYMPTOM_RULES))}
  FROM r0)"""


def assessment_sql(src: str = "ctx", keys: str = "user_id, day") -> str:
    """CTE chain ending in ``sa`` with keys, fired_rules, status,
    triggered_rule, reason, supporting_data, recommended_action."""
    order = ["t", "s", "h", "b", "r", "a", "p"] + [f"y{i}" for i in range(len(SYMPTOM_RULES))]
    red = [k for k, v in SAFETY_RULES.items() if v[0] == "RED"]
    red_in = "(" + ", ".join(f"'{r}'" for r in red) + ")"
    top = ("COALESCE(" + ", ".join(f"CASE WHEN r_{o} IN {red_in} THEN r_{o} END" for o in order) + ", " +
           ", ".join(f"r_{o}" for o in order) + ")")
    ev = "CASE " + " ".join(f"WHEN top = r_{o} THEN e_{o}" for o in order) + " END"
    fired = "concat_ws(',', " + ", ".join(f"r_{o}" for o in order) + ")"
    reason = "CASE top " + " ".join(f"WHEN '{k}' THEN '{v[2]}'" for k, v in SAFETY_RULES.items()) + " END"
    action = "CASE top " + " ".join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in SAFETY_RULES.items()) + " END"
    sev = "CASE WHEN top IN " + red_in + " THEN 'RED' ELSE 'YELLOW' END"
    return f"""{_rule_cols(src)},
r2 AS (SELECT *, {top} AS top, {fired} AS fired,
   list_filter([CASE WHEN tc IS NULL THEN 'Temperature' END,
                CASE WHEN len(syms) = 0 THEN 'Current Symptoms' END], lambda x: x IS NOT NULL) AS missing FROM r1),
sa AS (SELECT {keys}, fired AS fired_rules,
   CASE WHEN top IS NULL AND len(missing) > 0 THEN 'PENDING' WHEN top IS NULL THEN 'GREEN' ELSE {sev} END AS status,
   COALESCE(top, 'None') AS triggered_rule,
   CASE WHEN top IS NULL AND len(missing) > 0 THEN 'Current clinical assessment incomplete'
        WHEN top IS NULL THEN 'No detected safety red flag' ELSE {reason} END AS reason,
   CASE WHEN top IS NULL AND len(missing) > 0 THEN 'Missing required fields: ' || array_to_string(missing, ', ')
        WHEN top IS NULL THEN 'Required parameters within normal limits' ELSE {ev} END AS supporting_data,
   CASE WHEN top IS NULL AND len(missing) > 0 THEN 'Complete Care Assessment'
        WHEN top IS NULL THEN 'Proceed with automated care pathway' ELSE {action} END AS recommended_action
   FROM r2)"""
