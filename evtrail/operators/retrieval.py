"""Lexical retrieval, case graph, audit rows (K).

Scoring is a sparse product of query and document term counts over an
inverted index (:mod:`evtrail.operators.postings`), which leaves out the
documents that cannot reach a query's top ``k``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evtrail.functions.text import word_tokens
from evtrail.functions.topk import topk_per_group
from evtrail.operators.postings import _written, build_index, search_index


def term_counts(df: DataFrame, id_col: str, text: Column, pattern: str = "[a-z0-9_]+") -> DataFrame:
    """(id, term, tf) from lower-cased regex tokens."""
    return (df.select(F.col(id_col), F.explode(word_tokens(text, pattern)).alias("term"))
            .groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf")))


def lexical_search(queries: DataFrame, docs: DataFrame, q_id: str, q_text: Column, q_filters: Column | None,
                   d_id: str, d_text: Column, d_tags: Column | None, k: int = 4, tag_bonus: float = 3.0) -> DataFrame:
    """K2: score = Σ_term min(tf_query, tf_doc) (+ ``tag_bonus`` when a
    filter equals a document tag, case-insensitive); score > 0; top ``k``
    per query by score desc then doc id.  Filters are also query text, and
    tags are also document text."""
    none = F.array().cast("array<string>")
    lower = lambda c: F.array_distinct(F.transform(F.coalesce(c, none), lambda t: F.lower(t)))
    q = queries.select(F.col(q_id).alias("_q"),
                       (q_text if q_filters is None else F.concat_ws(" ", q_text, F.array_join(q_filters, " "))).alias("_qt"),
                       lower(q_filters if q_filters is not None else none).alias("_qf"))
    qtc = _written(term_counts(q, "_q", F.col("_qt")).withColumnRenamed("tf", "qtf"), "query-terms")
    index = build_index(docs, d_id, d_text, d_tags, vocabulary=qtc)
    order = [F.col("score").desc(), F.col("_d")]
    top = search_index(index, qtc, q.select("_q", "_qf").where(F.size("_qf") > 0), k, tag_bonus).drop("rank")
    if q_filters is not None and d_tags is not None:
        # a tag without a single token scores by the bonus alone: its first k
        # documents are enough, as any of them with a lexical hit ranks higher
        tags = index.tags.select("_d", F.explode("_tags").alias("_t")).join(
            q.select(F.explode("_qf").alias("_t")).distinct(), "_t", "left_semi")
        first = topk_per_group(tags, ["_t"], [F.col("_d")], k).drop("rank")
        only = (q.select("_q", F.explode("_qf").alias("_t")).join(first, "_t")
                .select("_q", "_d", F.lit(tag_bonus).alias("score")))
        top = top.unionByName(only).groupBy("_q", "_d").agg(F.max("score").alias("score"))
        top = topk_per_group(top, ["_q"], order, k)
    else:
        top = topk_per_group(top, ["_q"], order, k)
    return top.withColumnRenamed("_q", q_id).withColumnRenamed("_d", d_id)


def audit_rows(results: DataFrame, q_id: str, d_id: str, rank: str = "rank") -> DataFrame:
    """K4: one audit row per answer with the ordered source ids (bounded by k)."""
    return results.groupBy(q_id).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(rank, d_id))), lambda s: s[d_id].cast("string")),
                     ",").alias("source_ids"),
        F.count(F.lit(1)).alias("n_sources"))


def audit_events(answers: DataFrame, q_id: str, user: Column, question: Column, created_at: Column,
                 source_ids: str = "source_ids") -> DataFrame:
    """K4: audit rows to append, one per answer: id (a hash of user, question
    and time, so that a replay has the same), day, mode (grounded with
    sources, else fallback) and the source ids."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    grounded = F.coalesce(F.col(source_ids), F.lit("")) != ""
    return answers.select(
        F.sha2(F.concat_ws("\x1f", text(user), text(F.col(q_id)), text(question), text(created_at)), 256).alias("audit_id"),
        created_at.alias("created_at"), F.to_date(created_at).alias("day"), user.alias("user_id"), F.col(q_id),
        question.alias("question"), F.when(grounded, "grounded").otherwise("fallback").alias("mode"),
        F.coalesce(F.col(source_ids), F.lit("")).alias(source_ids))


def append_audit(rows: DataFrame, path: str) -> None:
    """K4: append to the audit table at ``path``, a folder per day.  Ids that a
    day's folder holds already are left out (only the days in ``rows`` are
    read), so a replayed batch appends nothing."""
    spark = rows.sparkSession
    rows = rows.dropDuplicates(["audit_id"])
    known = spark.read.schema(rows.schema).option("basePath", path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        old = known.parquet(path).select("day", "audit_id")
        days = F.broadcast(rows.select("day").distinct())                     # one row a day
        rows = rows.join(old.join(days, "day", "left_semi"), ["day", "audit_id"], "left_anti")
    rows.write.mode("append").partitionBy("day").parquet(path)


#: Nodes (id, type, label) and edges (source, target, type) of a
#: case, and the lists that hang on it (list, place, node type, edge source,
#: edge type).  ``{column}`` stands for a column of the case.
CASE_NODES = (
    ("patient:{case}", "Patient", "Patient {case}"),
    ("encounter:{index_id}", "Encounter", "Encounter {index_id}"),
    ("risk", "RiskAssessment", "Historical risk: {band}"),
    ("safety", "SafetyAssessment", "Safety: {safety_status}"),
    ("pathway", "CarePathway", "{pathway_name}"),
)
CASE_EDGES = (
    ("patient:{case}", "encounter:{index_id}", "HAS_ENCOUNTER"),
    ("encounter:{index_id}", "risk", "HAS_RISK_ASSESSMENT"),
    ("encounter:{index_id}", "safety", "HAS_SAFETY_ASSESSMENT"),
    ("risk", "pathway", "INFORMS"),
    ("safety", "pathway", "GOVERNS"),
)
CASE_LISTS = (("drivers", "driver", "RiskDriver", "risk", "SUPPORTED_BY"),
              ("providers", "provider", "Provider", "pathway", "MATCHED_TO"))
CASE_DEFAULTS = {"band": "UNKNOWN", "safety_status": "PENDING", "pathway_name": "Assessment required"}


def _fill(template: str, case_id: str) -> Column:
    """A text with ``{column}`` places as an expression."""
    parts = [F.lit(text) if i % 2 == 0 else
             F.coalesce(F.col(case_id if text == "case" else text).cast("string"), F.lit(CASE_DEFAULTS.get(text)))
             for i, text in enumerate(re.split(r"[{}]", template)) if text]
    return F.concat(*parts)


def case_graph(cases: DataFrame, drivers: DataFrame, providers: DataFrame, case_id: str = "entity_id",
               max_drivers: int = 3, max_providers: int = 3) -> tuple[DataFrame, DataFrame]:
    """K3: nodes(case, node_id, type, label) and edges(case, src, dst, type).
    ``drivers``: (case, drivers array<string>), one row a case; ``providers``:
    (case, rank, provider_id).  Every case becomes one row with its two bounded
    lists, and one explode each makes nodes and edges of it: each table is
    read once."""
    first = F.sort_array(F.collect_list(F.struct("rank", F.col("provider_id").cast("string").alias("label"))))
    best = (providers.where(F.col("rank") <= max_providers).groupBy(case_id).agg(first.alias("_p"))
            .select(case_id, F.col("_p.label").alias("_providers")))
    whole = (cases.join(drivers.select(case_id, F.slice("drivers", 1, max_drivers).alias("_drivers")), case_id, "left")
             .join(best, case_id, "left"))

    def listed(make) -> list[Column]:
        none = F.array().cast("array<string>")
        return [F.transform(F.coalesce(F.col(f"_{name}"), none), make(place, *rest))
                for name, place, *rest in CASE_LISTS]

    def at(place: str, i: Column) -> Column:
        return F.concat(F.lit(f"{place}:"), i.cast("string"))

    nodes = F.concat(
        F.array(*[F.struct(_fill(i, case_id).alias("node_id"), F.lit(t).alias("type"), _fill(x, case_id).alias("label"))
                  for i, t, x in CASE_NODES]),
        *listed(lambda place, kind, *_: lambda label, i: F.struct(
            at(place, i).alias("node_id"), F.lit(kind).alias("type"), label.alias("label"))))
    edges = F.concat(
        F.array(*[F.struct(_fill(a, case_id).alias("src"), _fill(b, case_id).alias("dst"), F.lit(t).alias("type"))
                  for a, b, t in CASE_EDGES]),
        *listed(lambda place, kind, source, link: lambda label, i: F.struct(
            F.lit(source).alias("src"), at(place, i).alias("dst"), F.lit(link).alias("type"))))
    return tuple(whole.select(case_id, F.explode(x).alias("_x")).select(case_id, "_x.*") for x in (nodes, edges))
