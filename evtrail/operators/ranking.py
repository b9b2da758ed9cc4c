"""Ranking and matching (J).

Scale design: ranking is computed once per distinct *need group* (for
example required specialty x region x pathway -- a product of small
categorical domains), over the providers eligible for that group, and the
ranked top-k is then attached to every case with an equi-join on the need
key.  Cases are never paired with providers, and no group is collected
into one task: TF-IDF uses exploded terms joined on (group, term), TOPSIS
uses two group-level aggregate passes, top-k is the salted two-level top-k.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evtrail.functions.geo import haversine_km
from evtrail.functions.topk import topk_per_group
from evtrail.operators import lookup
from evtrail.operators.lookup import contains_pairs
from evtrail.plans import bindings as B
from evtrail.session import cut_lineage

# English function words dropped before TF-IDF (a compact
# list; pass ``stop_words`` to use another).
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "in", "is", "it", "its", "of",
              "on", "or", "that", "the", "to", "was", "were", "will", "with")

TOKEN_PATTERN = r"(?U)\b\w\w+\b"      # Unicode words


# ------------------------------------------------------------- catalogue ---

def _lines_by_type_and_brand(lines: DataFrame) -> DataFrame:
    return lines.groupBy("l_suppkey", "p_type", "p_brand").agg(F.count(F.lit(1)).alias("n"))


def provider_catalog(spark, sf) -> DataFrame:
    """Binding: suppliers as providers.  specialty = most supplied part type +
    region (null when the nation key is a multiple of 7), quality = account
    balance / 100 when positive, location from the balance (null when
    negative), telehealth Y/N/unknown, utilisation and facilities from the
    lines they supplied."""
    s = B.table(spark, sf, "supplier")
    n = B.table(spark, sf, "nation")
    r = B.table(spark, sf, "region")
    li = B.table(spark, sf, "lineitem").select("l_suppkey", "l_partkey")
    p = B.table(spark, sf, "part").select("p_partkey", "p_type", "p_brand")
    # lines meet parts once: types and brands are both read off these counts
    lines = _lines_by_type_and_brand(li.join(p, li.l_partkey == p.p_partkey))
    util = lines.groupBy("l_suppkey", "p_type").agg(F.sum("n").alias("n_lines"))
    top_type = util.groupBy("l_suppkey").agg(
        F.min(F.struct((-F.col("n_lines")).alias("nl"), F.col("p_type").alias("t")))["t"].alias("main_type"),
        F.sum("n_lines").alias("utilization"))
    fac = lines.groupBy("l_suppkey").agg(F.count_distinct("p_brand").alias("n_facilities"))
    geo = s.join(n, s.s_nationkey == n.n_nationkey, "left").join(r, F.col("n_regionkey") == r.r_regionkey, "left")
    cat = geo.join(top_type, geo.s_suppkey == top_type.l_suppkey, "left").drop("l_suppkey") \
        .join(fac, geo.s_suppkey == fac.l_suppkey, "left")
    spec = F.when(F.col("s_nationkey") % 7 == 0, F.lit(None).cast("string")).otherwise(
        F.lower(F.concat_ws(" ", F.col("main_type"), F.col("r_name"))))
    return cat.select(
        F.col("s_suppkey").alias("provider_id"), F.col("s_name").alias("name"), spec.alias("specialty"),
        F.when(F.col("s_acctbal") > 0, F.col("s_acctbal") / 100).alias("quality"),
        F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal") % 180 - 90).alias("lat"),
        ((F.col("s_suppkey") * 37) % 360 - 180).cast("double").alias("lon"),
        F.when(F.col("s_suppkey") % 3 == 0, "Y").when(F.col("s_suppkey") % 3 == 1, "N").alias("telehealth"),
        F.col("n_name").alias("state"), F.lower(F.col("r_name")).alias("region"),
        F.coalesce("utilization", F.lit(0)).alias("utilization"),
        F.coalesce("n_facilities", F.lit(0)).alias("n_facilities"))


# --------------------------------------------------------- J1 / J2 / J3 ---

def candidate_fetch(needs: DataFrame, providers: DataFrame, need_key: str, need_specialty: str) -> DataFrame:
    """All providers whose specialty contains the need (case-insensitive),
    quality defaulting to 50.  Every eligible provider is ranked later; there
    is no limit before scoring.  Needs are distinct keys of a fixed
    vocabulary (specialty x region x pathway, a few dozen)."""
    nd = needs.select(need_key, F.lower(F.col(need_specialty)).alias("needle"), need_specialty).distinct()
    own = providers.withColumn("text", F.lower(F.col("specialty")))
    found = contains_pairs(nd, own)
    j = own.join(found.join(nd, "needle"), "text").drop("text", "needle")
    return j.withColumn("norm_quality", F.coalesce(F.col("quality"), F.lit(50.0)))


HALF_CIRCLE_KM = 20015.0


def criteria(cand: DataFrame, providers: DataFrame, lat: str, lon: str) -> DataFrame:
    """J4 inputs, each 0..100: quality as it is, closeness (100 at the need's
    point ``lat``/``lon``, 0 at the far side of the earth or without a known
    location), experience and facilities relative to the best provider."""
    best = providers.agg(F.max("utilization").alias("_mu"), F.max("n_facilities").alias("_mf"))     # one row
    km = haversine_km(lat, lon, "lat", "lon")
    return cand.crossJoin(F.broadcast(best)).withColumns({
        "norm_distance": F.coalesce(100 - km / HALF_CIRCLE_KM * 100, F.lit(0.0)),
        "norm_experience": 100.0 * F.col("utilization") / F.greatest("_mu", F.lit(1)),
        "norm_facility": 100.0 * F.col("n_facilities") / F.greatest("_mf", F.lit(1))}).drop("_mu", "_mf")


def eligibility_status(safety: Column, n_eligible: Column, yellow_policy: str = "proceed") -> Column:
    """RED -> BLOCKED; YELLOW -> CONDITIONAL under the 'conditional'
    policy; no eligible provider -> NO_MATCH; else ELIGIBLE."""
    st = F.when(safety == "RED", "BLOCKED")
    if yellow_policy == "conditional":
        st = st.when(safety == "YELLOW", "CONDITIONAL")
    return st.when(F.coalesce(n_eligible, F.lit(0)) == 0, "NO_MATCH").otherwise("ELIGIBLE")


# ------------------------------------------------------------- J6 TF-IDF ---

def tfidf_similarity(need_docs: DataFrame, cand_docs: DataFrame, group: str, doc_id: str, text: str,
                     stop_words: Sequence[str] = STOP_WORDS, name: str = "semantic_score") -> DataFrame:
    """Per group, corpus = the group's need text + every candidate's
    text; raw term counts, smooth idf ln((1+n)/(1+df))+1, L2-normalised,
    cosine(need, candidate) scaled so the group's max is 100 (0 when all
    zero).  ``need_docs``: (group, text); ``cand_docs``: (group, doc_id, text).
    Candidates, term counts and weights are each read several times and
    written before, so that none is made, or planned, once for every use."""
    cand_docs = cut_lineage(cand_docs)
    stop = F.array(*[F.lit(w) for w in stop_words])

    def terms(df, is_need):
        toks = F.filter(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(f"({TOKEN_PATTERN})"), 1),
                        lambda t: ~F.array_contains(stop, t))
        key = F.lit("__need__") if is_need else F.col(doc_id).cast("string")
        base = df.select(group, key.alias("_d"), F.explode(toks).alias("_t"))
        return base.groupBy(group, "_d", "_t").agg(F.count(F.lit(1)).alias("_tf"))
    nt, ct = terms(need_docs, True), terms(cand_docs, False)
    n_docs = cand_docs.groupBy(group).agg((F.count(F.lit(1)) + 1).alias("_n"))   # + the need document
    allt = cut_lineage(nt.unionByName(ct))
    df_ = allt.groupBy(group, "_t").agg(F.count(F.lit(1)).alias("_df"))
    w = (allt.join(df_, [group, "_t"]).join(n_docs, group)
         .withColumn("_w", F.col("_tf") * (F.log((1 + F.col("_n")) / (1 + F.col("_df"))) + 1)))
    w = cut_lineage(w.select(group, "_d", "_t", "_w"))
    norms = w.groupBy(group, "_d").agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"))
    w = w.join(norms, [group, "_d"]).withColumn("_u", F.col("_w") / F.col("_norm"))
    qv = w.where(F.col("_d") == "__need__").select(group, "_t", F.col("_u").alias("_q"))
    cv = w.where(F.col("_d") != "__need__").select(group, "_d", "_t", "_u")
    # the need vectors are bounded (distinct needs x their few terms): broadcast
    # them so a term shared by every candidate of a group is never a hot key
    dot = cv.join(F.broadcast(qv), [group, "_t"]).groupBy(group, "_d").agg(
        F.sum(F.col("_u") * F.col("_q")).alias("_cos"))
    allc = cut_lineage(cand_docs.select(group, doc_id, F.col(doc_id).cast("string").alias("_d"))
                       .join(dot, [group, "_d"], "left").fillna({"_cos": 0.0}).drop("_d"))
    mx = allc.groupBy(group).agg(F.max("_cos").alias("_mx"))
    return (allc.join(mx, group)
            .select(group, doc_id, F.when(F.col("_mx") > 0, F.col("_cos") / F.col("_mx") * 100.0)
                    .otherwise(F.lit(0.0)).alias(name)))


# -------------------------------------------------------------- J7 TOPSIS --

def topsis(df: DataFrame, group: str, criteria: Sequence[str], weights: Sequence[float],
           name: str = "topsis_score") -> DataFrame:
    """Vector-normalise each (benefit) criterion per group (zero norm ->
    1), weight, distance to the group's ideal / anti-ideal, closeness x 100
    (zero denominator -> 1)."""
    norms = df.groupBy(group).agg(*[F.sqrt(F.sum(F.col(c) * F.col(c))).alias(f"_n_{c}") for c in criteria])
    v = df.join(norms, group)
    for c, wt in zip(criteria, weights):
        nc = F.when(F.col(f"_n_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"_n_{c}"))
        v = v.withColumn(f"_v_{c}", F.col(c) / nc * wt)
    ext = v.groupBy(group).agg(*[x for c in criteria for x in (F.max(f"_v_{c}").alias(f"_hi_{c}"),
                                                               F.min(f"_v_{c}").alias(f"_lo_{c}"))])
    v = v.join(ext, group)
    d_pos = F.sqrt(sum((F.pow(F.col(f"_v_{c}") - F.col(f"_hi_{c}"), 2) for c in criteria), F.lit(0.0)))
    d_neg = F.sqrt(sum((F.pow(F.col(f"_v_{c}") - F.col(f"_lo_{c}"), 2) for c in criteria), F.lit(0.0)))
    den = d_pos + d_neg
    score = d_neg / F.when(den == 0, F.lit(1.0)).otherwise(den) * 100.0
    return v.select(*df.columns, score.alias(name))


def weighted_sum(cols_weights: dict[str, float]) -> Column:
    """J4."""
    return sum((F.col(c) * w for c, w in cols_weights.items()), F.lit(0.0))


def weight_sensitivity(scored: DataFrame, group: str, id_col: str, configs: dict[str, dict[str, float]],
                       k: int = 1) -> DataFrame:
    """Rank under several weight configurations (configs x candidates --
    the config list is a handful of literals)."""
    out = None
    for cname, cw in configs.items():
        # six digits: scores that differ by rounding only are ties, broken by id
        s = scored.withColumn("_ws", F.round(weighted_sum(cw), 6)).withColumn("config", F.lit(cname))
        top = topk_per_group(s, [group, "config"], [F.col("_ws").desc(), F.col(id_col)], k)
        top = top.withColumnRenamed("_ws", "weighted_score")
        out = top if out is None else out.unionByName(top)
    return out


def rank_topk(df: DataFrame, group: str, score: str, id_col: str, k: int = 5) -> DataFrame:
    """Top-k per group by score desc, id tie-break, numbered 1..k."""
    return topk_per_group(df, [group], [F.col(score).desc(), F.col(id_col)], k)


# ----------------------------------------------------------- J9 / J10 ------

def provider_enrichment(spark, sf, providers: DataFrame, id_col: str = "provider_id") -> DataFrame:
    """Distinct facilities (brands supplied) and 'category: count'
    utilisation list per provider, with default texts when empty.  Lists
    are bounded by the brand / type vocabularies.  ``providers`` are the few
    ranked ones (k for each need of a fixed vocabulary): their ids go to every
    task, so that lines of other providers are dropped before any shuffle."""
    providers = cut_lineage(providers)
    li = B.table(spark, sf, "lineitem").select("l_suppkey", "l_partkey")
    p = B.table(spark, sf, "part").select("p_partkey", "p_type", "p_brand")
    ids = providers.select(F.col(id_col).alias("_pid")).distinct()
    own = li.join(F.broadcast(ids), li.l_suppkey == ids._pid, "left_semi")
    lines = _lines_by_type_and_brand(own.join(p, own.l_partkey == p.p_partkey))
    util = lines.groupBy("l_suppkey", "p_type").agg(F.sum("n").alias("n"))
    util = util.groupBy("l_suppkey").agg(F.array_join(F.sort_array(F.collect_list(
        F.concat(F.col("p_type"), F.lit(": "), F.col("n").cast("string")))), "; ").alias("procedure_volumes"))
    fac = lines.groupBy("l_suppkey").agg(F.array_join(F.sort_array(F.collect_set("p_brand")), ", ").alias("facilities"))
    out = providers.join(util, providers[id_col] == util.l_suppkey, "left").drop("l_suppkey") \
        .join(fac, providers[id_col] == fac.l_suppkey, "left").drop("l_suppkey")
    return out.withColumns({
        "procedure_volumes": F.coalesce("procedure_volumes", F.lit("No procedure volume data available")),
        "facilities": F.coalesce("facilities", F.lit("No facility affiliation data available"))})


def nearest(points: DataFrame, providers: DataFrame, point_key: str, plat: str, plon: str,
            k: int = 3, on: Sequence[str] = ()) -> DataFrame:
    """K nearest providers per query point by great-circle distance,
    ties broken by utilisation (desc) then id; found by ring search over grid
    cells."""
    return lookup.nearest(points, providers, point_key, plat, plon,
                          [F.col("utilization").desc(), F.col("provider_id")], k, on)


def catalog_search(requests: DataFrame, providers: DataFrame, req_key: str, page_size: int = 10) -> DataFrame:
    """requests(req_key, specialties array, state, telehealth_only);
    providers matching any specialty word, the state and (if asked)
    telehealth='Y'; order: non-null quality first, quality desc, facility
    count desc, id; requests with no match return one NO_PROVIDER_FOUND row."""
    asked = requests.withColumn("needle", F.explode("specialties"))
    found = contains_pairs(asked, providers.select(F.col("specialty").alias("text")))
    fits = (asked.join(found, "needle").select(req_key, F.col("req_state").alias("state"), "telehealth_only",
                                               F.col("text").alias("specialty")).distinct())
    j = (providers.join(fits, ["state", "specialty"])
         .where(~F.col("telehealth_only") | (F.col("telehealth") == "Y")))
    top = topk_per_group(j, [req_key], [F.col("quality").desc_nulls_last(), F.col("n_facilities").desc(),
                                        F.col("provider_id")], page_size, rank_col="page_rank")
    found = top.select(req_key, "page_rank", "provider_id", F.lit("FOUND").alias("result"))
    miss = requests.select(req_key).join(top.select(req_key).distinct(), req_key, "left_anti").select(
        req_key, F.lit(None).cast("int").alias("page_rank"), F.lit(None).cast("long").alias("provider_id"),
        F.lit("NO_PROVIDER_FOUND").alias("result"))
    return found.unionByName(miss)
