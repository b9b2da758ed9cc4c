"""A training corpus from ``documents``, stage by stage.

Every stage works on all rows its predecessor kept; each but the last returns
the columns of ``documents``, and each is written as Parquet and read again
before the next.  The order: quality rules (rejected documents go), exact
de-duplication (one of each group of equal texts stays), SimHash
near-de-duplication (one of each component stays), secret scans (reported
spans are masked, no document goes), packing (one row per piece).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evtrail.llm.common import materialize, read_table
from evtrail.llm.exact_dedup import one_of_each_text
from evtrail.llm.packing import harmonic_pack, word_vocabulary
from evtrail.llm.quality_rules import keep_good, train_line_field
from evtrail.llm.secrets import redact_secrets
from evtrail.llm.simhash import one_of_each_component


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, train_line_field(docs, read_table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each_text(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each_component(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact_secrets(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return harmonic_pack(docs, word_vocabulary())


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("simhash_dedup", simhash_dedup),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: Tokenising, the line field and SimHash have no SQL form; tests hold the
#: stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
