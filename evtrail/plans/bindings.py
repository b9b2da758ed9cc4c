"""Binding of the library's roles to the supplied parquet tables.

The operators take column names; this module says which columns of the
driver tables play which role (entity, encounter, claim line, interval,
provider, vitals, text).  Every role table is a lazy projection of the
given tables, so its size grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evtrail.functions.prefix import dealt_by_rows

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# Fixed values (our binding): order priority -> encounter class.
ENCOUNTER_CLASS = {
    "1-URGENT": "emergency",
    "2-HIGH": "inpatient",
    "3-MEDIUM": "outpatient",
    "4-NOT SPECIFIED": "ambulatory",
    "5-LOW": "wellness",
}

# Fixed values (our binding): line return flag -> clinical interval kind.
INTERVAL_KIND = {"R": "condition", "A": "medication", "N": "allergy"}

# Fixed values (our binding): event type -> vital sign, scale, offset
# (vital = value * scale + offset, rounded to 0.1).  Chosen so every band of
# the safety rules is reachable; large temperatures exercise the °F path.
VITAL_OF_EVENT = {
    "view": ("temperature", 0.08, 33.0),
    "click": ("heart_rate", 1.2, 40.0),
    "purchase": ("spo2", -0.1, 100.0),
    "error": ("systolic_bp", 0.8, 85.0),
    "signup": ("respiratory_rate", 0.2, 8.0),
}
VITALS = [v[0] for v in VITAL_OF_EVENT.values()]

# Fixed values (our binding): props.k % 20 -> (symptom flag text, value).
SYMPTOM_OF_K = {0: ("Chest Pain", True), 1: (" shortness of breath", True), 2: ("bleeding", True),
                3: ("cough", True), 4: ("No current symptoms", True), 5: ("convulsions", False)}
# props.k % 25 -> AVPU token; pain = props.k % 11 on 'error' events.
AVPU_OF_K = {0: "V", 1: "p", 2: "Unresponsive", 3: "A"}
DECISION_HOUR = 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def class_of_priority(c: Column) -> Column:
    expr = F.lit("other")
    for k, v in reversed(list(ENCOUNTER_CLASS.items())):
        expr = F.when(c == k, F.lit(v)).otherwise(expr)
    return expr


def encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, event_id, ts, cls, cost (orders as visits)."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("entity_id"), F.col("o_orderkey").alias("event_id"),
                    F.col("o_orderdate").alias("ts"), class_of_priority(F.col("o_orderpriority")).alias("cls"),
                    F.col("o_totalprice").alias("cost"))


def n_lines(spark: SparkSession, sf_dir: str) -> int:
    """Rows of ``lineitem``, read from the footers of its files."""
    return table(spark, sf_dir, "lineitem").count()


def _lines_and_orders(spark: SparkSession, sf_dir: str, *order_cols: str) -> DataFrame:
    """Lines with columns of their order; both dealt by order into parts that
    follow the number of lines."""
    rows = n_lines(spark, sf_dir)
    li = dealt_by_rows(table(spark, sf_dir, "lineitem"), rows, "l_orderkey")
    o = dealt_by_rows(table(spark, sf_dir, "orders").select("o_orderkey", *order_cols), rows, "o_orderkey")
    return li.join(o, li.l_orderkey == o.o_orderkey)


def claim_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claim lines: claim = order, segment = line number, paid = price,
    provider = supplier, codes = part / flags; member from the order."""
    return _lines_and_orders(spark, sf_dir, "o_custkey", "o_orderpriority").select(
        F.col("o_custkey").alias("member_id"), F.col("l_orderkey").alias("claim_id"),
        F.col("l_linenumber").alias("segment"), F.col("l_shipdate").alias("from_ts"),
        (F.col("l_shipdate") + F.make_dt_interval(F.col("l_quantity").cast("int") % 7)).alias("thru_ts"),
        F.col("l_extendedprice").alias("paid"), F.col("l_suppkey").alias("provider_id"),
        F.col("l_partkey").cast("string").alias("code_1"), F.col("l_returnflag").alias("code_2"),
        F.col("l_linestatus").alias("code_3"), class_of_priority(F.col("o_orderpriority")).alias("cls"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Condition/medication/allergy intervals from lines: START = ship date,
    STOP null while the line is open ('O'), else START + quantity days."""
    kind = F.lit(None).cast("string")
    for k, v in INTERVAL_KIND.items():
        kind = F.when(F.col("l_returnflag") == k, F.lit(v)).otherwise(kind)
    return _lines_and_orders(spark, sf_dir, "o_custkey").select(
        F.col("o_custkey").alias("entity_id"), F.col("l_orderkey").alias("encounter_id"),
        F.col("l_partkey").cast("string").alias("code"), kind.alias("kind"),
        F.col("l_shipdate").alias("start_ts"),
        F.when(F.col("l_linestatus") == "O", F.lit(None).cast("timestamp"))
        .otherwise(F.col("l_shipdate") + F.make_dt_interval(F.col("l_quantity").cast("int"))).alias("stop_ts"))


def decode_context(events: DataFrame) -> DataFrame:
    """One row per measurement event: the vital it measures (others null),
    AVPU token, pain score and the TRUE symptom (lower/trim, else null)."""
    k = F.get_json_object("props", "$.k").cast("int")
    sym = F.lit(None).cast("string")
    symv = F.lit(None).cast("boolean")
    for r, (txt, v) in SYMPTOM_OF_K.items():
        sym = F.when(k % 20 == r, F.lit(txt)).otherwise(sym)
        symv = F.when(k % 20 == r, F.lit(v)).otherwise(symv)
    avpu = F.lit(None).cast("string")
    for r, t in AVPU_OF_K.items():
        avpu = F.when(k % 25 == r, F.lit(t)).otherwise(avpu)
    vit = {vn: F.when(F.col("event_type") == et, F.round(F.col("value") * sc + off, 1))
           for et, (vn, sc, off) in VITAL_OF_EVENT.items()}
    return events.select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "ts", "event_id",
                    *[c.alias(n) for n, c in vit.items()], avpu.alias("avpu"),
                    F.when(F.col("event_type") == "error", (k % 11).cast("double")).alias("pain"),
                    # normalised once here: the TRUE symptom name (lower/trim), else null
                    F.when(sym.isNotNull() & symv, F.lower(F.trim(sym))).alias("symptom"))


def context_events(spark: SparkSession, sf_dir: str, before_hour: int | None = None) -> DataFrame:
    """Decoded measurement events, all of them or those before an hour."""
    e = table(spark, sf_dir, "events")
    return decode_context(e if before_hour is None else e.where(F.hour("ts") < before_hour))


def clinical_context(spark: SparkSession, sf_dir: str, before_hour: int | None = DECISION_HOUR) -> DataFrame:
    """Per (user, day) the latest value of each vital measured before
    the decision time (18:00 unless given), AVPU, pain and the TRUE symptom names.  One
    ``groupBy`` (latest = max of struct(ts, id, value): a partial aggregate;
    the symptom set is bounded by the symptom vocabulary)."""
    e = context_events(spark, sf_dir, before_hour)

    def latest(c):
        return F.max(F.when(F.col(c).isNotNull(), F.struct("ts", "event_id", F.col(c).alias("v"))))["v"].alias(c)
    return e.groupBy("user_id", "day").agg(
        *[latest(c) for c in [*VITALS, "avpu", "pain"]],
        F.sort_array(F.collect_set("symptom")).alias("symptoms"))
