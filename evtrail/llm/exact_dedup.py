"""Exact de-duplication by progressive refinement.

Rows are grouped by normalised length, the groups that still hold two rows
by a hash of the first characters, and only rows of groups that survive both
get their full content hashed.

Plan.  Two passes over the text.  The first leaves 32 bytes a row (id, code
points, length, prefix hash); the group counts are map-side combined, so a
length or a text that a third of all rows share is one row a task.  What
survives is broadcast as a set of at most ``2**SURVIVOR_BITS`` bucket numbers
(the bound holds for any input: two groups in one bucket only cost a hash
that was not needed).  The second pass hashes the survivors.  Texts are never
shuffled.  The final join goes to a table with one row a group of copies;
adaptive execution splits the large side where one group holds many rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evtrail.llm.common import ASCII_SPACE, materialize, read_table, text_or_empty, with_row_key
from evtrail.llm.registry import query

PREFIX_CHARS = 256
SURVIVOR_BITS = 20


def normalised(col: str = "text"):
    """The text without any character of [\\x20\\x09-\\x0D] (null: empty)."""
    return F.translate(text_or_empty(col), ASCII_SPACE, "")


def _bucket():
    return F.pmod(F.xxhash64("len", "pre"), F.lit(1 << SURVIVOR_BITS)).cast("int").alias("bucket")


def progressive_exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                            prefix_chars: int = PREFIX_CHARS, digest_all: bool = False) -> DataFrame:
    """One row per input row: ``<id>``, ``keep_id``, ``group_size``, ``kept``,
    ``text_sha256``.

    Texts are equal when identical after normalisation; of equal texts the
    row with the most code points in the original text stays, then the
    smallest id.  ``text_sha256`` is the hash of the normalised text for rows
    that reached the last refinement and null for rows told apart earlier,
    unless ``digest_all`` asks for it on every row.

    Defined cases: a null text counts as empty, and all empty or white texts
    are one group; ids may be numbers or texts (texts compare by their UTF-8
    bytes); a null id loses to any other id; a row that occurs twice
    (same id, same text) is counted twice and kept once; an empty table gives
    an empty result; other columns of ``docs``, whatever their names, are
    not read.
    """
    return _verdicts(docs, id_col, text_col, F.monotonically_increasing_id(), prefix_chars, digest_all).drop("rid")


def _verdicts(docs: DataFrame, id_col: str, text_col: str, row: Column, prefix_chars: int = PREFIX_CHARS,
              digest_all: bool = False) -> DataFrame:
    """The columns of ``progressive_exact_dedup`` and ``rid``, the row's number."""
    own = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("t"), row.alias("rid"))
    own = own.withColumn("norm", normalised("t"))
    own = own.select("id", "rid", F.char_length("t").cast("long").alias("code"), "norm",
                     F.octet_length("norm").cast("long").alias("len"),
                     F.xxhash64(F.substring("norm", 1, prefix_chars)).alias("pre"))

    # 1 by length, 2 by prefix hash among lengths that occur twice
    slim = materialize(own.groupBy("len", "pre").agg(F.count(F.lit(1)).alias("n")), "exact-prefix")
    twice = slim.groupBy("len").agg(F.sum("n").alias("same_len")).where("same_len > 1")
    alive = slim.join(twice, "len", "left_semi").where("n > 1")
    alive = materialize(alive.select(_bucket()).distinct(), "exact-alive")   # <= 2**SURVIVOR_BITS integers

    # 3 full content of survivors
    flagged = own.withColumn("bucket", _bucket()).join(
        F.broadcast(alive.withColumn("alive", F.lit(True))), "bucket", "left")
    sha = F.sha2("norm", 256)
    cand = flagged.select("id", "code", F.coalesce("alive", F.lit(False)).alias("alive"),
                          (sha if digest_all else F.when(F.col("alive"), sha)).alias("sha"), "rid")
    cand = materialize(cand, "exact-cand")
    groups = (cand.where("alive").groupBy("sha")
              .agg(F.count(F.lit(1)).alias("n"),
                   F.min(F.struct((-F.col("code")).alias("shorter"), F.col("id").isNull().alias("none"),
                                  F.col("id").alias("keep"), F.col("rid").alias("top_rid"))).alias("top"))
              .where("n > 1").select("sha", "n", "top.keep", "top.top_rid"))
    groups = materialize(groups, "exact-groups")
    out = cand.join(groups, "sha", "left")
    single = F.col("n").isNull()
    return out.select(F.col("id").alias(id_col),
                      F.when(single, F.col("id")).otherwise(F.col("keep")).alias("keep_id"),
                      F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
                      (single | (F.col("rid") == F.col("top_rid"))).alias("kept"),
                      F.col("sha").alias("text_sha256"), "rid")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose id stands for no kept row.  Rows
    without an id stay, and so do rows that repeat the id of a kept one."""
    verdict = progressive_exact_dedup(docs, id_col, text_col).select(F.col(id_col).alias("gone"), "kept")
    gone = (verdict.where("gone is not null").groupBy("gone").agg(F.max("kept").alias("kept"))
            .where("not kept").select("gone"))
    gone = materialize(gone, "exact-gone")
    return docs.join(gone, docs[id_col] == gone["gone"], "left_anti")


def one_of_each_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with exactly one row of each group of equal texts, the kept
    one of ``progressive_exact_dedup``, whatever its id: rows go by their own
    number, so null and repeated ids are no exception."""
    keyed, key = with_row_key(docs, "exact-rows")
    verdict = _verdicts(keyed, id_col, text_col, F.col(key))
    gone = materialize(verdict.where("not kept").select(F.col("rid").alias("gone")), "exact-gone")
    return keyed.join(gone, keyed[key] == gone["gone"], "left_anti").select(*docs.columns)


_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(length(text), 0) AS code,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
           FROM documents),
w AS (SELECT doc_id, text_sha256,
             first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY code DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w
"""


@query("op9_exact_dedup", sql=_SQL)
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progressive_exact_dedup(read_table(spark, sf_dir, "documents"), digest_all=True)
