"""Streaming jobs reproduce their batch twins, over several files with late
and out-of-order rows, and across a restart."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from evtrail.plans import bindings as B
from evtrail.sources.io import scratch_path
from evtrail.streaming import jobs as S

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def _folder(spark, parts):
    """A stream source of several files, read in this order."""
    from evtrail.session import ensure_checkpoint_dir
    path = f"{ensure_checkpoint_dir(spark)}/t-{uuid.uuid4().hex}"
    for i, p in enumerate(parts):
        p.coalesce(1).write.parquet(f"{path}/part={i}")
    return path


def _events(spark):
    return B.table(spark, SF, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _stream(spark, path, schema):
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
            .parquet(path))


def test_windows_are_written_once_and_late_rows_dropped(spark):
    ev = _events(spark).where("ts is not null")
    days = [r[0] for r in ev.select(F.to_date("ts").alias("d")).distinct().orderBy("d").collect()]
    cut = days[len(days) // 2]
    early, late = ev.where(F.to_date("ts") < cut), ev.where(F.to_date("ts") >= cut)
    stale = early.orderBy("ts").limit(5).withColumn("event_id", F.col("event_id") + 10**9)
    path = _folder(spark, [early, late, stale])
    for slide in (None, "12 hours"):
        out = S.run_available(S.s2_windowed_counts(_stream(spark, path, ev.schema), slide=slide), "t_s2")
        closed = ev.agg((F.max("ts") - F.expr("INTERVAL 1 HOUR")).alias("c")).first()["c"]
        batch = S.s2_windowed_counts(ev, slide=slide).where(F.col("window_start") + F.expr("INTERVAL 1 DAY") <= F.lit(closed))
        cols = ["window_start", "event_type", "n"]
        assert _rows(out.select(*cols)) == _rows(batch.select(*cols))


def test_reassessment_equals_batch_twin_over_several_files(spark):
    ev = _events(spark)
    third = F.pmod(F.hour("ts"), F.lit(24))
    path = _folder(spark, [ev.where(third < 8), ev.where((third >= 8) & (third < 16)), ev.where(third >= 16)])
    cols = ["session", "event_id", "attempt", "status", "outcome"]
    want = _rows(S.s4_batch(ev, 2).select(*cols))
    got = S.run_available(S.s4_sessions(_stream(spark, path, ev.schema)), "t_s4", S.s4_reassess_batch(2, "100000 days"))
    assert _rows(got.select(*cols)) == want


def test_restarted_job_resumes_without_duplicates(spark):
    ev = _events(spark).select("event_id", "user_id", "ts", "event_type")
    job = f"t-{uuid.uuid4().hex}"
    path = _folder(spark, [ev.where("event_id % 3 = 0"), ev.where("event_id % 3 = 1")])
    first = S.run_available(_stream(spark, path, ev.schema), "t", job=job)
    n = first.count()
    assert n == ev.where("event_id % 3 < 2").count()
    assert S.run_available(_stream(spark, path, ev.schema), "t", job=job).count() == n      # nothing new
    ev.where("event_id % 3 = 2").coalesce(1).write.parquet(f"{path}/part=9")
    again = S.run_available(_stream(spark, path, ev.schema), "t", job=job)
    assert again.count() == ev.count() == again.select("event_id").distinct().count()


def test_older_status_in_a_later_batch_does_not_win(spark):
    rows = [[(1, "new", 5), (2, "a", 1)], [(1, "old", 3), (2, "b", 2)], [(3, "x", 1), (2, "tie", 2)]]
    parts = [spark.createDataFrame(r, "k long, status string, t long") for r in rows]
    path = _folder(spark, parts)
    sink = S.run_available(_stream(spark, path, parts[0].schema).select("k", "status", F.struct("t").alias("ord")),
                           "t_s7", batch_fn=S.s7_upsert_batch("k", "status", "ord"))
    assert {r["k"]: r["status"] for r in S.s7_read_state(sink, "k", "status").collect()} == {1: "new", 2: "tie", 3: "x"}
    per_bucket = sink.groupBy("_bucket").agg(F.countDistinct("_version").alias("n"))
    assert per_bucket.agg(F.max("n")).first()[0] <= 2               # old versions go


def test_upsert_writes_only_the_buckets_it_touches_and_survives_a_replay(spark):
    path = scratch_path(spark, "t-state")
    fn = S.s7_upsert_batch("k", "status", "ord", buckets=16)
    frame = lambda rows: spark.createDataFrame(rows, "k long, status string, t long").select("k", "status", F.struct("t").alias("ord"))
    fn(frame([(k, "first", 1) for k in range(500)]), 0, path)
    fn(frame([(7, "second", 2)]), 1, path)
    written = lambda v: spark.read.parquet(path).where(F.col("_version") == v)
    assert written(0).select("_bucket").distinct().count() == 16
    assert written(1).select("_bucket").distinct().count() == 1 and written(1).count() < 100
    want = {k: "second" if k == 7 else "first" for k in range(500)}
    got = lambda: {r["k"]: r["status"] for r in S.s7_read_state(spark.read.parquet(path), "k", "status").collect()}
    assert got() == want
    fn(frame([(7, "second", 2)]), 1, path)                           # replayed
    assert got() == want
    fn(frame([(7, "third", 3), (8, "late", 0)]), 2, path)
    assert got() == want | {7: "third"}


def plain_attempts(rows):
    """(session, event_id) -> (attempt, temperature, symptoms) in time order."""
    out, state = {}, {}
    for session, ts, event, temp, syms in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        n, last, held = state.get(session, (0, None, frozenset()))
        state[session] = n, last, held = n + 1, last if temp is None else temp, held | set(syms)
        out[session, event] = (n, last, sorted(held))
    return out


def test_running_state_splits_a_hot_group(spark, monkeypatch):
    import random

    from evtrail.functions import prefix
    monkeypatch.setattr(prefix, "ROWS_PER_RANGE", 50)
    rng = random.Random(4)
    rows = [(rng.choice(["hot"] * 5 + ["a", "b", None]), rng.randint(0, 200), i,
             rng.choice([None, None, 36.5, 39.0]), rng.sample(["x", "y", "z"], rng.choice([0, 0, 1, 2]))) for i in range(900)]
    df = spark.createDataFrame(rows, "s string, ts long, event_id long, temp double, syms array<string>").withColumn("n", F.lit(1))
    out = prefix.running_state(df, ["s"], ["ts", "event_id"], ["temp"], ["n"], ["syms"])
    want = plain_attempts([(r[0] or "~", *r[1:]) for r in rows])
    assert {(r["s"] or "~", r["event_id"]): (r["n"], r["temp"], r["syms"]) for r in out.collect()} == want


def test_sessions_carry_over_batches_and_replays(spark):
    fn = S.s4_reassess_batch(2, buckets=8)
    path = f"{scratch_path(spark, 't-s4')}/data"
    ev = _events(spark).orderBy("ts").limit(400)
    rows = S.s4_sessions(ev)
    cut = rows.agg(F.percentile_approx("ts", 0.5)).first()[0]
    parts = [rows.where(F.col("ts") <= F.lit(cut)), rows.where(F.col("ts") > F.lit(cut))]
    fn(parts[0], 0, path)
    fn(parts[1], 1, path)
    fn(parts[1], 1, path)                                            # replayed
    cols = ["session", "event_id", "attempt", "status", "outcome"]
    got = _rows(spark.read.parquet(path).select(*cols))
    assert got == _rows(S.s4_batch(ev, 2).select(*cols))
