"""Registered ranking / matching queries (J).

Cases are the decision-table rows (I23).  Each case's need = required
specialty (from its pathway) + its region + pathway name; ranking runs per
distinct need key and is attached to cases by that key.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from evtrail.operators import ranking as J
from evtrail.plans import bindings as B
from evtrail.plans.q_rules import _DECISION_SQL, decision_table
from evtrail.plans.registry import query
from evtrail.session import cut_lineage, memo_checkpoint

# Fixed values (our binding): pathway -> required provider specialty word.
PATHWAY_SPECIALTY = {"P1": "large", "P2": "promo", "P3": "standard", "P4": "standard", "P5": "economy",
                     "Assessment Required": "medium", "UNKNOWN": "unknown"}
# Fixed values (our binding): pathway -> catalogue specialty set.
PATHWAY_SPECIALTY_SET = {"P1": ["large"], "P2": ["promo", "large"], "P3": ["standard", "medium"], "P4": ["standard"],
                         "P5": ["economy", "small"], "Assessment Required": ["medium"], "UNKNOWN": []}
# Weights of quality, distance, experience, facility.
WEIGHT_CONFIGS = {"base": (0.35, 0.35, 0.20, 0.10), "quality_heavy": (0.40, 0.30, 0.20, 0.10),
                  "distance_heavy": (0.30, 0.40, 0.20, 0.10)}
CRITERIA = ("norm_quality", "norm_distance", "norm_experience", "norm_facility")


def _spec(col):
    e = F.lit(None).cast("string")
    for k, v in PATHWAY_SPECIALTY.items():
        e = F.when(col == k, F.lit(v)).otherwise(e)
    return e


@memo_checkpoint
def cases(spark, sf):
    d = decision_table(spark, sf)
    c = B.table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = B.table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = B.table(spark, sf, "region").select("r_regionkey", "r_name")
    geo = c.join(n, c.c_nationkey == n.n_nationkey).join(r, F.col("n_regionkey") == r.r_regionkey)
    d = d.join(geo.select(F.col("c_custkey").alias("entity_id"), F.lower("r_name").alias("region"),
                          F.col("n_name").alias("state")), "entity_id", "left")
    spec = _spec(F.col("pathway"))
    return d.select("entity_id", "safety_status", "pathway", "pathway_name", "region", "state",
                    spec.alias("need_specialty"),
                    F.concat_ws("|", spec, F.col("region"), F.col("pathway")).alias("need_key"),
                    F.concat_ws(" ", spec, F.col("region"), F.col("pathway_name")).alias("need_text"))


@memo_checkpoint
def provider_catalog_cp(spark, sf):
    return J.provider_catalog(spark, sf)


@memo_checkpoint
def scored_candidates(spark, sf):
    """Per need key: eligible providers with semantic, quality, TOPSIS."""
    cs = cases(spark, sf)
    prov = provider_catalog_cp(spark, sf)
    needs = cs.select("need_key", "need_specialty", "need_text").distinct()
    cand = cut_lineage(J.candidate_fetch(needs, prov, "need_key", "need_specialty")
                       .select("need_key", "provider_id", "norm_quality", "specialty"))
    sem = J.tfidf_similarity(needs.select("need_key", F.col("need_text").alias("text")),
                             cand.select("need_key", "provider_id", F.col("specialty").alias("text")),
                             "need_key", "provider_id", "text")
    sc = cand.select("need_key", "provider_id", "norm_quality").join(sem, ["need_key", "provider_id"])
    # bounded (#needs x eligible providers) and reused by several rankings
    return J.topsis(cut_lineage(sc), "need_key", ["semantic_score", "norm_quality"], [0.5, 0.5])


@memo_checkpoint
def candidate_criteria(spark, sf):
    """Per (need key, eligible provider): the four J4 criteria; the need's
    point is the mean of its region's nation points."""
    prov = provider_catalog_cp(spark, sf)
    cs = cases(spark, sf).select("need_key", "need_specialty", F.col("region").alias("need_region")).distinct()
    n = B.table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    r = B.table(spark, sf, "region").select("r_regionkey", F.lower("r_name").alias("need_region"))
    pts = n.join(r, n.n_regionkey == r.r_regionkey).groupBy("need_region").agg(
        F.avg((F.col("n_nationkey") * 7) % 180 - 90).alias("plat"), F.avg((F.col("n_nationkey") * 53) % 360 - 180).alias("plon"))
    cand = J.candidate_fetch(cs, prov, "need_key", "need_specialty").join(
        cs.join(pts, "need_region", "left").select("need_key", "plat", "plon"), "need_key")
    return J.criteria(cand, prov, "plat", "plon").select("need_key", "provider_id", *CRITERIA)


_PSPEC = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PATHWAY_SPECIALTY.items())

PROV_SQL = """lp AS (SELECT l.l_suppkey, p.p_type, p.p_brand FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
ut AS (SELECT l_suppkey, p_type, count(*) AS n FROM lp GROUP BY ALL),
tt AS (SELECT l_suppkey, p_type AS main_type FROM (
        SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, p_type) AS rn FROM ut) WHERE rn = 1),
tot AS (SELECT l_suppkey, CAST(sum(n) AS BIGINT) AS utilization FROM ut GROUP BY l_suppkey),
fac AS (SELECT l_suppkey, count(DISTINCT p_brand) AS n_facilities FROM lp GROUP BY l_suppkey),
prov AS (SELECT s_suppkey AS provider_id, s_name AS name,
   CASE WHEN s_nationkey % 7 = 0 THEN NULL ELSE lower(concat_ws(' ', main_type, r_name)) END AS specialty,
   CASE WHEN s_acctbal > 0 THEN s_acctbal / 100 END AS quality,
   CASE WHEN s_acctbal >= 0 THEN s_acctbal % 180 - 90 END AS lat,
   CAST((s_suppkey * 37) % 360 - 180 AS DOUBLE) AS lon,
   CASE s_suppkey % 3 WHEN 0 THEN 'Y' WHEN 1 THEN 'N' END AS telehealth, n_name AS state, lower(r_name) AS region,
   COALESCE(utilization, 0) AS utilization, COALESCE(n_facilities, 0) AS n_facilities
   FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
   LEFT JOIN tt ON tt.l_suppkey = s_suppkey LEFT JOIN tot ON tot.l_suppkey = s_suppkey
   LEFT JOIN fac ON fac.l_suppkey = s_suppkey)"""

_PNAME = " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in __import__("evtrail.operators.rules", fromlist=["x"])
                  .PATHWAYS.items())

_CASES_SQL = lambda: _DECISION_SQL() + f""",
{PROV_SQL},
cs AS (SELECT dp.entity_id, dp.safety_status, dp.pathway, lower(r.r_name) AS region, n.n_name AS state,
  CASE dp.pathway {_PSPEC} END AS need_specialty,
  concat_ws('|', CASE dp.pathway {_PSPEC} END, lower(r.r_name), dp.pathway) AS need_key,
  concat_ws(' ', CASE dp.pathway {_PSPEC} END, lower(r.r_name), CASE dp.pathway {_PNAME} END) AS need_text
  FROM dp LEFT JOIN customer c ON c.c_custkey = dp.entity_id LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
  LEFT JOIN region r ON r.r_regionkey = n.n_regionkey),
nd AS (SELECT DISTINCT need_key, need_specialty, need_text FROM cs),
cand AS (SELECT nd.need_key, prov.*, COALESCE(prov.quality, 50.0) AS norm_quality
   FROM nd JOIN prov ON contains(lower(prov.specialty), lower(nd.need_specialty))),
docs AS (SELECT need_key, '__need__' AS d, need_text AS text FROM nd
         UNION ALL SELECT need_key, CAST(provider_id AS VARCHAR), specialty FROM cand),
tk AS (SELECT need_key, d, t FROM (SELECT need_key, d, unnest(regexp_extract_all(lower(COALESCE(text, '')),
   '\\b\\w\\w+\\b')) AS t FROM docs) WHERE t NOT IN ({", ".join(f"'{w}'" for w in J.STOP_WORDS)})),
tf AS (SELECT need_key, d, t, count(*) AS tf FROM tk GROUP BY ALL),
dfq AS (SELECT need_key, t, count(*) AS df FROM tf GROUP BY ALL),
nn AS (SELECT need_key, count(*) + 1 AS n FROM cand GROUP BY need_key),
wt AS (SELECT tf.need_key, tf.d, tf.t, tf.tf * (ln((1 + nn.n) / (1 + dfq.df)) + 1) AS w FROM tf
   JOIN dfq USING (need_key, t) JOIN nn USING (need_key)),
nm AS (SELECT need_key, d, sqrt(sum(w * w)) AS norm FROM wt GROUP BY ALL),
u AS (SELECT wt.need_key, wt.d, wt.t, wt.w / nm.norm AS u FROM wt JOIN nm USING (need_key, d)),
dot AS (SELECT c.need_key, c.d, sum(c.u * q.u) AS cos FROM u c JOIN u q ON q.need_key = c.need_key AND q.t = c.t
   AND q.d = '__need__' WHERE c.d <> '__need__' GROUP BY ALL),
sem0 AS (SELECT cand.need_key, cand.provider_id, cand.norm_quality, COALESCE(dot.cos, 0.0) AS cos FROM cand
   LEFT JOIN dot ON dot.need_key = cand.need_key AND dot.d = CAST(cand.provider_id AS VARCHAR)),
sem AS (SELECT *, CASE WHEN max(cos) OVER (PARTITION BY need_key) > 0
   THEN cos / max(cos) OVER (PARTITION BY need_key) * 100.0 ELSE 0.0 END AS semantic_score FROM sem0),
tn AS (SELECT *, sqrt(sum(semantic_score * semantic_score) OVER (PARTITION BY need_key)) AS n1,
   sqrt(sum(norm_quality * norm_quality) OVER (PARTITION BY need_key)) AS n2 FROM sem),
tv AS (SELECT *, semantic_score / CASE WHEN n1 = 0 THEN 1.0 ELSE n1 END * 0.5 AS v1,
   norm_quality / CASE WHEN n2 = 0 THEN 1.0 ELSE n2 END * 0.5 AS v2 FROM tn),
te AS (SELECT *, sqrt(pow(v1 - max(v1) OVER w, 2) + pow(v2 - max(v2) OVER w, 2)) AS dp_,
   sqrt(pow(v1 - min(v1) OVER w, 2) + pow(v2 - min(v2) OVER w, 2)) AS dn_ FROM tv WINDOW w AS (PARTITION BY need_key)),
tp AS (SELECT need_key, provider_id, norm_quality, semantic_score,
   dn_ / CASE WHEN dp_ + dn_ = 0 THEN 1.0 ELSE dp_ + dn_ END * 100.0 AS topsis_score FROM te)
"""


def _r6(df, cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("j01_candidate_fetch", lambda: _CASES_SQL() + """
SELECT need_key, provider_id, norm_quality FROM cand""")
def j01(spark, sf):
    cs = cases(spark, sf)
    needs = cs.select("need_key", "need_specialty").distinct()
    c = J.candidate_fetch(needs, J.provider_catalog(spark, sf), "need_key", "need_specialty")
    return c.select("need_key", "provider_id", "norm_quality")


_ELIG = """el AS (SELECT cs.entity_id, cs.safety_status, (SELECT count(*) FROM cand WHERE cand.need_key = cs.need_key) AS n_el
  FROM cs)"""


@query("j02_hard_eligibility", lambda: _CASES_SQL() + f""", {_ELIG}
SELECT entity_id, CASE WHEN safety_status = 'RED' THEN 'BLOCKED' WHEN n_el = 0 THEN 'NO_MATCH' ELSE 'ELIGIBLE' END
  AS match_status FROM el""")
def j02(spark, sf):
    cs = cases(spark, sf)
    cand = J.candidate_fetch(cs.select("need_key", "need_specialty").distinct(), J.provider_catalog(spark, sf),
                             "need_key", "need_specialty")
    n = cand.groupBy("need_key").agg(F.count(F.lit(1)).alias("n_el"))
    j = cs.join(n, "need_key", "left")
    return j.select("entity_id", J.eligibility_status(F.col("safety_status"), F.col("n_el")).alias("match_status"))


@query("j03_yellow_policy", lambda: _CASES_SQL() + f""", {_ELIG}
SELECT entity_id,
  CASE WHEN safety_status = 'RED' THEN 'BLOCKED' WHEN n_el = 0 THEN 'NO_MATCH' ELSE 'ELIGIBLE' END AS status_proceed,
  CASE WHEN safety_status = 'RED' THEN 'BLOCKED' WHEN safety_status = 'YELLOW' THEN 'CONDITIONAL'
       WHEN n_el = 0 THEN 'NO_MATCH' ELSE 'ELIGIBLE' END AS status_conditional FROM el""")
def j03(spark, sf):
    cs = cases(spark, sf)
    cand = J.candidate_fetch(cs.select("need_key", "need_specialty").distinct(), J.provider_catalog(spark, sf),
                             "need_key", "need_specialty")
    n = cand.groupBy("need_key").agg(F.count(F.lit(1)).alias("n_el"))
    j = cs.join(n, "need_key", "left")
    return j.select("entity_id",
                    J.eligibility_status(F.col("safety_status"), F.col("n_el"), "proceed").alias("status_proceed"),
                    J.eligibility_status(F.col("safety_status"), F.col("n_el"), "conditional")
                    .alias("status_conditional"))


_CRIT_SQL = """,
np AS (SELECT lower(r_name) AS need_region, avg((n_nationkey * 7) % 180 - 90) AS plat, avg((n_nationkey * 53) % 360 - 180) AS plon
       FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1),
nr AS (SELECT DISTINCT need_key, region AS need_region FROM cs),
ca AS (SELECT cand.need_key, cand.provider_id, cand.norm_quality, cand.utilization, cand.n_facilities,
         pow(sin(radians(lat - plat) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lon - plon) / 2), 2) AS a
       FROM cand JOIN nr USING (need_key) LEFT JOIN np USING (need_region)),
best AS (SELECT max(utilization) AS mu, max(n_facilities) AS mf FROM prov),
cr AS (SELECT need_key, provider_id, norm_quality,
         COALESCE(100 - 2 * 6371.0 * atan2(sqrt(a), sqrt(1 - a)) / 20015.0 * 100, 0.0) AS norm_distance,
         100.0 * utilization / greatest(mu, 1) AS norm_experience, 100.0 * n_facilities / greatest(mf, 1) AS norm_facility
       FROM ca, best)"""


def _weights(config):
    return dict(zip(CRITERIA, WEIGHT_CONFIGS[config]))


@query("j04_weighted_score", lambda: _CASES_SQL() + _CRIT_SQL + """
SELECT need_key, provider_id, round(0.35 * norm_quality + 0.35 * norm_distance + 0.2 * norm_experience
  + 0.1 * norm_facility, 6) AS weighted_score FROM cr""")
def j04(spark, sf):
    s = candidate_criteria(spark, sf)
    return _r6(s.select("need_key", "provider_id", J.weighted_sum(_weights("base")).alias("weighted_score")),
               ["weighted_score"])


@query("j05_weight_sensitivity", lambda: _CASES_SQL() + _CRIT_SQL + """,
cf AS (SELECT * FROM (VALUES ('base', 0.35, 0.35, 0.2, 0.1), ('quality_heavy', 0.4, 0.3, 0.2, 0.1),
       ('distance_heavy', 0.3, 0.4, 0.2, 0.1)) c(config, wq, wd, we, wf)),
ws AS (SELECT cr.need_key, cr.provider_id, cf.config,
         round(norm_quality * wq + norm_distance * wd + norm_experience * we + norm_facility * wf, 6) AS s FROM cr, cf)
SELECT need_key, config, provider_id, s AS weighted_score, CAST(rn AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY need_key, config ORDER BY s DESC, provider_id) AS rn FROM ws) WHERE rn <= 5""")
def j05(spark, sf):
    out = J.weight_sensitivity(candidate_criteria(spark, sf), "need_key", "provider_id",
                               {c: _weights(c) for c in WEIGHT_CONFIGS}, k=5)
    return out.select("need_key", "config", "provider_id", "weighted_score", "rank")


@query("j06_tfidf_semantic", lambda: _CASES_SQL() + """
SELECT need_key, provider_id, round(semantic_score, 6) AS semantic_score FROM tp""")
def j06(spark, sf):
    return _r6(scored_candidates(spark, sf).select("need_key", "provider_id", "semantic_score"), ["semantic_score"])


@query("j07_topsis", lambda: _CASES_SQL() + """
SELECT need_key, provider_id, round(topsis_score, 6) AS topsis_score FROM tp""")
def j07(spark, sf):
    return _r6(scored_candidates(spark, sf).select("need_key", "provider_id", "topsis_score"), ["topsis_score"])


@memo_checkpoint
def top5(spark, sf):
    return J.rank_topk(scored_candidates(spark, sf), "need_key", "topsis_score", "provider_id", 5)


_TOP5_SQL = """top5 AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY need_key ORDER BY topsis_score DESC,
   provider_id) AS INTEGER) AS rank FROM tp) WHERE rank <= 5)"""


@query("j08_topk_per_case", lambda: _CASES_SQL() + f""", {_TOP5_SQL}
SELECT cs.entity_id, top5.rank, top5.provider_id, round(top5.topsis_score, 6) AS topsis_score
FROM cs JOIN top5 ON top5.need_key = cs.need_key WHERE cs.safety_status <> 'RED'""")
def j08(spark, sf):
    cs = cases(spark, sf).where(F.col("safety_status") != "RED")
    t = top5(spark, sf)
    j = cs.select("entity_id", "need_key").join(t, "need_key")   # top-k per need attached to every case
    return _r6(j.select("entity_id", "rank", "provider_id", "topsis_score"), ["topsis_score"])


@query("j09_enrichment", lambda: _CASES_SQL() + f""", {_TOP5_SQL},
ids AS (SELECT DISTINCT provider_id FROM top5),
lpp AS (SELECT l.l_suppkey, p.p_type, p.p_brand FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
        WHERE l.l_suppkey IN (SELECT provider_id FROM ids)),
uu AS (SELECT l_suppkey, string_agg(p_type || ': ' || CAST(n AS VARCHAR), '; ' ORDER BY p_type || ': ' || CAST(n AS VARCHAR))
       AS procedure_volumes FROM (SELECT l_suppkey, p_type, count(*) AS n FROM lpp GROUP BY ALL) GROUP BY l_suppkey),
ff AS (SELECT l_suppkey, string_agg(DISTINCT p_brand, ', ' ORDER BY p_brand) AS facilities FROM lpp GROUP BY l_suppkey)
SELECT top5.need_key, top5.rank, top5.provider_id,
  COALESCE(uu.procedure_volumes, 'No procedure volume data available') AS procedure_volumes,
  COALESCE(ff.facilities, 'No facility affiliation data available') AS facilities
FROM top5 LEFT JOIN uu ON uu.l_suppkey = top5.provider_id LEFT JOIN ff ON ff.l_suppkey = top5.provider_id""")
def j09(spark, sf):
    e = J.provider_enrichment(spark, sf, top5(spark, sf))
    return e.select("need_key", "rank", "provider_id", "procedure_volumes", "facilities")


_CENTROIDS = """pts AS (SELECT n_nationkey AS point_id, CAST((n_nationkey * 7) % 180 - 90 AS DOUBLE) AS plat,
   CAST((n_nationkey * 53) % 360 - 180 AS DOUBLE) AS plon FROM nation)"""


@query("j10_nearest_providers", lambda: "WITH " + PROV_SQL + ",\n" + _CENTROIDS + """,
d AS (SELECT point_id, provider_id, utilization, 2 * 6371.0 * atan2(sqrt(a), sqrt(1 - a)) AS distance_km FROM (
     SELECT pts.point_id, prov.provider_id, prov.utilization,
            pow(sin(radians(lat - plat) / 2), 2) + cos(radians(plat)) * cos(radians(lat))
               * pow(sin(radians(lon - plon) / 2), 2) AS a FROM pts, prov WHERE lat IS NOT NULL))
SELECT point_id, provider_id, round(distance_km, 6) AS distance_km, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY point_id ORDER BY distance_km, utilization DESC, provider_id) AS INTEGER)
    AS rank FROM d)
WHERE rank <= 3""")
def j10(spark, sf):
    n = B.table(spark, sf, "nation")
    pts = n.select(F.col("n_nationkey").alias("point_id"),
                   ((F.col("n_nationkey") * 7) % 180 - 90).cast("double").alias("plat"),
                   ((F.col("n_nationkey") * 53) % 360 - 180).cast("double").alias("plon"))
    near = J.nearest(pts, J.provider_catalog(spark, sf), "point_id", "plat", "plon", 3)
    return _r6(near.select("point_id", "provider_id", "distance_km", "rank"), ["distance_km"])


_PSET = " ".join(f"WHEN '{k}' THEN [{', '.join(repr(x) for x in v)}]::VARCHAR[]" for k, v in PATHWAY_SPECIALTY_SET.items())


@query("j11_catalog_search", lambda: _CASES_SQL() + f""",
rq AS (SELECT DISTINCT pathway || '|' || COALESCE(state, '') || '|' || CAST(entity_id % 2 = 0 AS VARCHAR) AS req_key,
   CASE pathway {_PSET} END AS specialties, state AS req_state, entity_id % 2 = 0 AS telehealth_only FROM cs),
m AS (SELECT rq.req_key, prov.provider_id, prov.quality, prov.n_facilities FROM rq JOIN prov
   ON prov.state = rq.req_state AND list_bool_or(list_transform(rq.specialties, lambda s: contains(prov.specialty, s)))
   AND (NOT rq.telehealth_only OR prov.telehealth = 'Y')),
pg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY req_key ORDER BY quality DESC NULLS LAST,
   n_facilities DESC, provider_id) AS page_rank FROM m) WHERE page_rank <= 10)
SELECT req_key, CAST(page_rank AS DOUBLE) AS page_rank, CAST(provider_id AS DOUBLE) AS provider_id, 'FOUND' AS result
FROM pg UNION ALL SELECT req_key, NULL, NULL, 'NO_PROVIDER_FOUND' FROM rq WHERE req_key NOT IN (SELECT req_key FROM pg)""")
def j11(spark, sf):
    cs = cases(spark, sf)
    pset = F.lit(None).cast("array<string>")
    for k, v in PATHWAY_SPECIALTY_SET.items():
        pset = F.when(F.col("pathway") == k, F.array(*[F.lit(x) for x in v]).cast("array<string>")).otherwise(pset)
    tele = (F.col("entity_id") % 2 == 0)
    rq = cs.select(F.concat_ws("|", "pathway", F.coalesce("state", F.lit("")),
                               F.when(tele, "true").otherwise("false")).alias("req_key"),
                   pset.alias("specialties"), F.col("state").alias("req_state"), tele.alias("telehealth_only")).distinct()
    out = J.catalog_search(rq, J.provider_catalog(spark, sf), "req_key", 10)
    # nullable integers leave as DOUBLE so every result format agrees
    return out.select("req_key", F.col("page_rank").cast("double").alias("page_rank"),
                      F.col("provider_id").cast("double").alias("provider_id"), "result")
