"""Shared DuckDB SQL fragments for the oracle side of the binding."""

CLASS_CASE = """CASE o_orderpriority WHEN '1-URGENT' THEN 'emergency' WHEN '2-HIGH' THEN 'inpatient'
      WHEN '3-MEDIUM' THEN 'outpatient' WHEN '4-NOT SPECIFIED' THEN 'ambulatory'
      WHEN '5-LOW' THEN 'wellness' ELSE 'other' END"""

DAYNUM = "date_diff('day', DATE '1970-01-01', CAST({x} AS DATE))"

ENC = f"""ev AS (
  SELECT o_custkey AS entity_id, o_orderkey AS event_id, o_orderdate AS ts, {CLASS_CASE} AS cls,
         o_totalprice AS cost, {DAYNUM.format(x='o_orderdate')} AS day
  FROM orders WHERE o_orderdate IS NOT NULL)"""

IDX = """idx AS (
  SELECT entity_id, day, ts AS index_ts, event_id AS index_id FROM (
    SELECT *, row_number() OVER (PARTITION BY entity_id, day ORDER BY ts, event_id) AS rn
    FROM ev WHERE cls = 'emergency') WHERE rn = 1)"""

MAXDAY = "mx AS (SELECT max(day) AS max_day FROM ev)"

CLAIM_LINES = f"""cl AS (
  SELECT o.o_custkey AS member_id, l.l_orderkey AS claim_id, l.l_linenumber AS segment,
         l.l_shipdate AS from_ts,
         l.l_shipdate + to_days(CAST(l.l_quantity AS INTEGER) % 7) AS thru_ts,
         l.l_extendedprice AS paid, l.l_suppkey AS provider_id,
         CAST(l.l_partkey AS VARCHAR) AS code_1, l.l_returnflag AS code_2, l.l_linestatus AS code_3,
         {CLASS_CASE} AS cls
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"""

INTERVALS = """iv AS (
  SELECT o.o_custkey AS entity_id, l.l_orderkey AS encounter_id, CAST(l.l_partkey AS VARCHAR) AS code,
         CASE l.l_returnflag WHEN 'R' THEN 'condition' WHEN 'A' THEN 'medication'
              WHEN 'N' THEN 'allergy' END AS kind,
         l.l_shipdate AS start_ts,
         CASE WHEN l.l_linestatus = 'O' THEN NULL
              ELSE l.l_shipdate + to_days(CAST(l.l_quantity AS INTEGER)) END AS stop_ts
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
