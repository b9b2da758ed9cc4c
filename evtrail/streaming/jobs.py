"""Structured Streaming jobs (S1-S7), each with a batch twin.

Sources read the given parquet tables as a file stream.  Sinks are
``foreachBatch`` writers in the job's folder, with the query checkpoint next
to them.  A job with a name of its own keeps its folder, so a restarted job
resumes from its offsets; every batch overwrites the folder of its batch id,
so a batch that is replayed after a failure leaves no duplicates.
``run_available`` drains what is available (``availableNow``) and hands back
the sink as a batch DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evtrail.functions.prefix import running_state
from evtrail.operators import rules as R
from evtrail.plans import bindings as B
from evtrail.session import cut_lineage, ensure_checkpoint_dir
from evtrail.sources.io import scratch_path
from evtrail.streaming.state import BUCKETS, BucketedState


def stream_table(spark: SparkSession, sf_dir: str, name: str, max_files: int = 1) -> DataFrame:
    """File-stream source over one of the parquet tables."""
    schema = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").schema
    df = (spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
          .option("maxFilesPerTrigger", max_files).parquet(sf_dir))
    # event time must be an instant: naive UTC timestamps -> TIMESTAMP (session TZ is UTC)
    ntz = [f.name for f in schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df


def run_available(df: DataFrame, name: str, batch_fn: Callable[[DataFrame, int, str], None] | None = None,
                  job: str | None = None) -> DataFrame:
    """Run a streaming query over everything available and return its sink.

    ``job``: a stable folder under the shared checkpoint folder, kept across
    restarts; without it each call is a job of its own.  Default sink: each
    micro-batch overwrites its own ``_batch=<id>`` folder."""
    spark = df.sparkSession
    out = f"{ensure_checkpoint_dir(spark).rstrip('/')}/evtrail-stream/{job}" if job else scratch_path(spark, name)
    data = f"{out}/data"

    def write(batch: DataFrame, batch_id: int) -> None:
        if batch_fn is not None:
            batch_fn(batch, batch_id, data)
        else:
            batch.write.mode("overwrite").parquet(f"{data}/_batch={batch_id}")

    q = (df.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", f"{out}/_checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(data)


# ------------------------------------------------------------------ S1 ----

def event_context(events: DataFrame) -> DataFrame:
    """Per measurement event (stateless): the vital it carries, AVPU, pain
    and its TRUE symptom as an array -- the decoding of the batch binding."""
    none = F.array().cast("array<string>")
    return B.decode_context(events).withColumn(
        "symptoms", F.when(F.col("symptom").isNotNull(), F.array("symptom")).otherwise(none)).drop("symptom")


def s1_safety(events: DataFrame) -> DataFrame:
    """Stateless vitals -> safety status per event."""
    a = R.safety_assessment(event_context(events), symptoms="symptoms")
    return a.select("event_id", "user_id", "ts", "status", "triggered_rule")


# ------------------------------------------------------------------ S2 ----

def s2_windowed_counts(events: DataFrame, window: str = "1 day", slide: str | None = None,
                       watermark: str = "1 hour") -> DataFrame:
    """Tumbling (or sliding) event-time counts per type; rows later than
    the watermark are dropped by the engine."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return (events.withWatermark("ts", watermark).groupBy(w.alias("w"), "event_type")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value_sum"))
            .select(F.col("w.start").alias("window_start"), "event_type", "n", "value_sum"))


# ------------------------------------------------------------------ S3 ----

def s3_sessions(events: DataFrame, gap: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    """S3: per-user session windows (gap-based)."""
    s = F.session_window("ts", gap)
    return (events.withWatermark("ts", watermark).groupBy(s.alias("s"), "user_id")
            .agg(F.count(F.lit(1)).alias("n_events"))
            .select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"),
                    "n_events"))


# ------------------------------------------------------------------ S4 ----

S4_FIELDS = [*B.VITALS, "avpu", "pain"]
_S4_ROW = ["session", "ts", "event_id", "attempt", *S4_FIELDS, "symptoms"]


def _s4_outcome(merged: DataFrame, attempt_limit: int) -> DataFrame:
    a = R.safety_assessment(merged, symptoms="symptoms")
    return a.select("session", "event_id", "attempt", "status",
                    F.when((F.col("status") == "PENDING") & (F.col("attempt") >= attempt_limit), "HUMAN_CLINICAL_REVIEW")
                    .otherwise(F.col("status")).alias("outcome"))


def s4_sessions(events: DataFrame) -> DataFrame:
    """Stateless part of S4: one row per event, an attempt of its session
    (user, day), with the fields it measures."""
    c = event_context(events)
    return c.select(F.concat_ws(":", "user_id", "day").alias("session"), "ts", "event_id",
                    F.lit(1).cast("long").alias("attempt"), *S4_FIELDS, "symptoms")


def _s4_merged(rows: DataFrame) -> DataFrame:
    return running_state(rows, ["session"], ["ts", "event_id"], S4_FIELDS, ["attempt"], ["symptoms"])


def s4_reassess_batch(attempt_limit: int = 2, keep: str = "2 days", buckets: int = BUCKETS):
    """S4 as a batch function over :func:`s4_sessions`: the context of a
    session merges over its attempts (last known value of a field, symptoms
    add up) and is assessed as a whole; a session still PENDING at the attempt
    limit goes to HUMAN_CLINICAL_REVIEW.

    A session's state (attempts so far, last values, symptoms) is one row of a
    :class:`BucketedState`; it enters the batch as a row before the session's
    events, and native windows over ranges carry it on, so a session that
    holds a third of all rows is split and no Python runs per session.  Within
    a micro-batch events are taken in time order; a late event is an attempt
    of the batch it comes in.  A session's state goes ``keep`` of event time
    after its last event, when its bucket is next written."""
    def fn(batch: DataFrame, batch_id: int, path: str) -> None:
        spark = batch.sparkSession
        store = BucketedState(spark, f"{path.rsplit('/', 1)[0]}/state", "session", buckets)
        rows = cut_lineage(batch.select(*_S4_ROW))
        if rows.isEmpty():
            return
        newest = rows.agg(F.max("ts")).first()[0]

        def step(before: DataFrame) -> DataFrame:
            # the state's row comes first whatever its time: null sorts first
            seeds = before.select(F.col("session"), F.lit(None).cast("timestamp").alias("ts"), "event_id", "attempt",
                                  *S4_FIELDS, "symptoms", F.col("ts").alias("last_ts"), F.lit(True).alias("seed"))
            own = rows.select("*", F.col("ts").alias("last_ts"), F.lit(False).alias("seed"))
            merged = cut_lineage(_s4_merged(own.unionByName(seeds)))
            _s4_outcome(merged.where(~F.col("seed")), attempt_limit).write.mode("overwrite").parquet(
                f"{path}/_batch={batch_id}")
            last = merged.groupBy("session").agg(
                F.max("last_ts").alias("ts"),
                F.max_by(F.struct("event_id", "attempt", *S4_FIELDS, "symptoms"), "attempt").alias("s"))
            state = last.select("session", "ts", "s.*").select(*_S4_ROW)
            return state.where(F.col("ts") >= F.lit(newest) - F.expr(f"INTERVAL {keep}")) if newest else state

        store.merge(rows, batch_id, rows.schema, step)
    return fn


def s4_batch(events: DataFrame, attempt_limit: int = 2) -> DataFrame:
    """S4 batch twin: the same merge over all events."""
    return _s4_outcome(_s4_merged(s4_sessions(events)), attempt_limit)


# ------------------------------------------------------------------ S5 ----

def s5_dedup(events: DataFrame, keys=("user_id", "event_type", "day"), watermark: str = "1 day") -> DataFrame:
    """Idempotent creation -- one row per key within the watermark."""
    e = events.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return e.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(list(keys))


# ------------------------------------------------------------------ S6 ----

def s6_interval_join(anchors: DataFrame, outcomes: DataFrame, within: str = "1 day",
                     watermark: str = "2 days") -> DataFrame:
    """Stream-stream inner join of anchors to later outcomes of the same
    user within ``within`` (both sides watermarked so state is bounded)."""
    a = anchors.select(F.col("user_id").alias("a_user"), F.col("event_id").alias("anchor_id"),
                       F.col("ts").alias("a_ts")).withWatermark("a_ts", watermark)
    o = outcomes.select(F.col("user_id").alias("o_user"), F.col("event_id").alias("outcome_id"),
                        F.col("ts").alias("o_ts")).withWatermark("o_ts", watermark)
    cond = ((F.col("a_user") == F.col("o_user")) & (F.col("o_ts") > F.col("a_ts")) &
            (F.col("o_ts") <= F.col("a_ts") + F.expr(f"INTERVAL {within}")))
    return a.join(o, cond).select(F.col("a_user").alias("user_id"), "anchor_id", "outcome_id")


# ------------------------------------------------------------------ S7 ----

def s7_upsert_batch(key: str, status: str, order: str, buckets: int = BUCKETS):
    """foreachBatch upsert of the latest state per key.  The buckets the
    batch's keys fall into are read, reduced with the batch by ``order``
    (event time, then id) and written as a new version, so an older event in a
    later batch never wins; equal orders go to the later batch."""
    def fn(batch: DataFrame, batch_id: int, path: str) -> None:
        rows = cut_lineage(batch.select(key, status, order).withColumn("_batch", F.lit(batch_id).cast("long")))
        if rows.isEmpty():
            return

        def step(before: DataFrame) -> DataFrame:
            last = F.max(F.struct(F.col(order), F.col("_batch"), F.col(status))).alias("_m")
            return rows.unionByName(before).groupBy(key).agg(last).select(
                key, F.col(f"_m.{status}").alias(status), F.col(f"_m.{order}").alias(order),
                F.col("_m._batch").alias("_batch"))

        BucketedState(batch.sparkSession, path, key, buckets).merge(rows, batch_id, rows.schema, step)
    return fn


def s7_read_state(sink: DataFrame, key: str, status: str) -> DataFrame:
    """The newest version of every bucket (one row a bucket: broadcast)."""
    newest = sink.groupBy(F.col("_bucket").alias("_b")).agg(F.max("_version").alias("_v"))
    return sink.join(F.broadcast(newest), (F.col("_bucket") == F.col("_b")) & (F.col("_version") == F.col("_v"))).select(
        key, status)
