"""URL filter by empirical-Bayes host reputation.

Labelled page outcomes (a page is bad when its label has quality 0 or toxic
1) are counted per host and shrunk through beta-binomial priors: a suffix
towards all pages, a registered domain towards its suffix, a host towards its
domain.  Each level's prior strength is estimated by moments from the spread
of its groups within their parents.  A host is blocked when the lower bound
of its posterior bad rate (mean less ``Z`` standard deviations of the beta
posterior) exceeds ``MAX_BAD_RATE``, so little evidence blocks nothing.
Listed rules come first.

Plan.  Only page_id and url are scanned.  Outcomes meet pages by page id
(unique); the counts are map-side combined, so a host with a third of all
pages is one row a task; levels work on one row a host, domain or suffix.
The verdict joins the reputation (one row a host, written first) back to the
pages: adaptive execution broadcasts it if its size allows, and otherwise
splits the partition of a hot host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evtrail.llm.common import materialize, read_table
from evtrail.llm.registry import query

# Fixed values: (verdict, host, path) of the listed rules.
RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]
MAX_BAD_RATE = 0.5
Z = 1.645
STRENGTH = (2.0, 1000.0)      # bounds of a prior's strength; the middle of none: UNKNOWN_STRENGTH
UNKNOWN_STRENGTH = 20.0
# Second-level labels that form a public suffix with a country code.
_SECOND = "co|com|org|net|ac|gov|edu"
_SUFFIX = rf"(?:^|\.)((?:{_SECOND})\.[a-z][a-z]|[^.]+)$"
_DOMAIN = rf"(?:^|\.)([^.]+\.(?:(?:{_SECOND})\.[a-z][a-z]|[^.]+))$"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.locate("://", u)
    rest = F.when(at > 0, F.expr(f"substr(coalesce(`{url}`, ''), locate('://', coalesce(`{url}`, '')) + 3)")).otherwise("")
    authority = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(authority, _UPPER, _LOWER), path


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, its verdict) of the longest rule that fits, else nulls."""
    text = verdict = None
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text = F.when(fits, F.lit(h + p)).otherwise(F.lit(None).cast("string") if text is None else text)
        verdict = F.when(fits, F.lit(v)).otherwise(F.lit(None).cast("string") if verdict is None else verdict)
    return text, verdict


def _strength(groups: DataFrame, parent: str) -> DataFrame:
    """One row, ``m``: the prior strength by moments (analysis of variance of
    the group rates within their parents).  ``groups``: parent, n, bad."""
    g = groups.where("n > 0")
    per = g.groupBy(parent).agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("bad").alias("bad"),
        F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("bb"),
        F.sum(F.col("n") * F.col("n")).alias("nn"))
    s = per.agg(F.sum("k").alias("k"), F.count(F.lit(1)).alias("p"), F.sum("n").alias("n"),
                F.sum("bad").alias("bad"), F.sum("bb").alias("bb"),
                F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("pp"),
                F.sum(F.col("nn") / F.col("n")).alias("nn"))
    between = (F.col("bb") - F.col("pp")) / (F.col("k") - F.col("p"))
    within = (F.col("bad") - F.col("bb")) / (F.col("n") - F.col("k"))
    size = (F.col("n") - F.col("nn")) / (F.col("k") - F.col("p"))
    rho = (between - within) / (between + (size - 1) * within)
    usable = (F.col("k") > F.col("p")) & (F.col("n") > F.col("k")) & (F.col("bad") > F.col("bb"))
    m = F.when(~F.coalesce(usable, F.lit(False)), F.lit(UNKNOWN_STRENGTH)).when(
        rho <= 1.0 / (1.0 + STRENGTH[1]), F.lit(STRENGTH[1])).otherwise(
        F.greatest(F.lit(STRENGTH[0]), (1 - rho) / rho))
    return s.select(m.alias("m"))


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """``outcomes``: host, n (labelled pages), bad.  One row per host: host,
    n, bad, mean, lower."""
    domain = F.regexp_extract("name", _DOMAIN, 1)
    hosts = outcomes.withColumn("name", F.regexp_replace(F.regexp_replace("host", "^.*@", ""), r"\.?(:[0-9]*)?$", ""))
    hosts = hosts.select("host", "n", "bad", F.when(domain == "", F.col("name")).otherwise(domain).alias("domain"))
    hosts = materialize(hosts.withColumn("suffix", F.regexp_extract("domain", _SUFFIX, 1)), "url-hosts")
    domains = materialize(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")),
                          "url-domains")
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn(
        "all", F.lit(1))
    total = suffixes.agg(((F.sum("bad") + 1) / (F.sum("n") + 2)).alias("up"))

    def shrink(level: DataFrame, parent: str, priors: DataFrame | None) -> DataFrame:
        m = _strength(level, parent)                         # one row
        level = (level.crossJoin(F.broadcast(total)) if priors is None      # one row
                 else level.join(priors, parent))
        level = level.crossJoin(F.broadcast(m))
        mean = (F.col("m") * F.col("up") + F.col("bad")) / (F.col("m") + F.col("n"))
        return level.withColumn("mean", mean).withColumn("weight", F.col("m") + F.col("n"))

    s = materialize(shrink(suffixes, "all", None).select("suffix", F.col("mean").alias("up")), "url-suffix")
    d = materialize(shrink(domains, "suffix", s).select("domain", F.col("mean").alias("up")), "url-domain")
    h = shrink(hosts, "domain", d)
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("weight") + 1))
    return h.select("host", "n", "bad", "mean", (F.col("mean") - Z * sd).alias("lower"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules=RULES, max_bad_rate: float = MAX_BAD_RATE) -> DataFrame:
    """One row per page: ``page_id``, ``host``, ``path``, ``rule``,
    ``verdict``, ``n_labelled`` (of the host), ``lower_bound`` (six digits).

    Defined cases: a null url, or one without ``://``, has an empty host and
    path, and such pages share the reputation of the empty host; a null
    page_id or a page without a label counts in no outcome; a label that
    repeats a doc_id is counted once, bad if any row is; pages that repeat
    are judged each; without labels every prior is its default and nothing
    is blocked; other columns are not read.
    """
    host, path = host_and_path("url")
    own = pages.select("page_id", host.alias("host"), path.alias("path"))
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")
    known = (labels.where("doc_id is not null and (quality is not null or toxic is not null)")
             .groupBy(F.col("doc_id").alias("page_id")).agg(F.max(F.coalesce(bad, F.lit(0))).alias("bad")))
    outcomes = own.select("page_id", "host").join(known, "page_id", "left").groupBy("host").agg(
        F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("bad"))
    rep = materialize(host_reputation(outcomes), "url-reputation")
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    by_method = F.when(F.col("lower") > max_bad_rate, "block").otherwise("allow")
    return own.join(rep, "host", "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_method).alias("verdict"),
        F.col("n").cast("long").alias("n_labelled"), F.round("lower", 6).alias("lower_bound"))


def _oracle() -> str:
    fits = "(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    order = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    cases = lambda i: "CASE " + " ".join(
        f"WHEN {fits.format(h=h, p=p)} THEN '{(h + p, v)[i]}'" for v, h, p in order) + " END"
    level = """
{n}_s AS (SELECT sum(k) AS k, count(*) AS p, sum(n) AS n, sum(bad) AS bad, sum(bb) AS bb,
          sum(bad * bad / n) AS pp, sum(nn / n) AS nn
   FROM (SELECT {parent}, count(*) AS k, sum(n) AS n, sum(bad) AS bad, sum(bad * bad / n) AS bb, sum(n * n) AS nn
         FROM {n} WHERE n > 0 GROUP BY {parent})),
{n}_v AS (SELECT *, (bb - pp) / nullif(k - p, 0) AS ms, (bad - bb) / nullif(n - k, 0) AS mw,
                 (n - nn) / nullif(k - p, 0) AS n0 FROM {n}_s),
{n}_r AS (SELECT *, (ms - mw) / (ms + (n0 - 1) * mw) AS rho FROM {n}_v),
{n}_m AS (SELECT CASE WHEN NOT coalesce(k > p AND n > k AND bad > bb, false) THEN {unknown}
                      WHEN rho <= 1.0 / (1.0 + {top}) THEN {top}
                      ELSE greatest({low}, (1 - rho) / rho) END::DOUBLE AS m FROM {n}_r)"""
    lv = lambda n, parent: level.format(n=n, parent=parent, unknown=UNKNOWN_STRENGTH,
                                        top=STRENGTH[1], low=STRENGTH[0])
    return rf"""
WITH p0 AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0
                   THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p0),
known AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels
          WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY doc_id),
o AS (SELECT host, count(known.bad)::DOUBLE AS n, coalesce(sum(known.bad), 0)::DOUBLE AS bad
      FROM p LEFT JOIN known ON known.doc_id = p.page_id GROUP BY host),
o1 AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), '\.?(:[0-9]*)?$', '') AS name FROM o),
o2 AS (SELECT host, n, bad, CASE WHEN regexp_extract(name, '{_DOMAIN}', 1) = '' THEN name
              ELSE regexp_extract(name, '{_DOMAIN}', 1) END AS domain FROM o1),
hosts AS (SELECT *, regexp_extract(domain, '{_SUFFIX}', 1) AS suffix FROM o2),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, 1 AS everything, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY suffix),
total AS (SELECT (sum(bad) + 1) / (sum(n) + 2) AS up FROM suffixes),
{lv("suffixes", "everything")}, {lv("domains", "suffix")}, {lv("hosts", "domain")},
s AS (SELECT suffix, (m * up + bad) / (m + n) AS up FROM suffixes, total, suffixes_m),
d AS (SELECT domain, (m * up + bad) / (m + n) AS up FROM domains JOIN s USING (suffix), domains_m),
h0 AS (SELECT host, n, (m * up + bad) / (m + n) AS mean, m + n AS weight FROM hosts JOIN d USING (domain), hosts_m),
h AS (SELECT host, n, mean - {Z} * sqrt(mean * (1 - mean) / (weight + 1)) AS lower FROM h0)
SELECT page_id, host, path, {cases(0)} AS rule,
       coalesce({cases(1)}, CASE WHEN lower > {MAX_BAD_RATE} THEN 'block' ELSE 'allow' END) AS verdict,
       n::BIGINT AS n_labelled, round(lower, 6) AS lower_bound
FROM p JOIN h USING (host)
"""


@query("op5_url_reputation", sql=_oracle())
def op5_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "labels"))
