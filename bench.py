"""Benchmark the headline queries.

Runs each headline query at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1)
on ``local[$BENCH_CPUS]``: one untimed warm-up, then ``$BENCH_REPS`` timed
runs (default 3) executed to a no-op sink (full computation, nothing
collected); reports the median.  Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "e24_model_table",            # flagship: point-in-time features + labels
    "e13_distinct_providers_365d",
    "e11_active_intervals",
    "d03_collapse_claims",
    "c03_column_profile",
    "b11_keep_first",
    "h03_roc_auc",
    "h07_threshold_sweep",
    "i05_safety_status",
    "k02_lexical_retrieval",
    "l07_status_lifecycle",
    "j08_topk_per_case",
    "g08_logistic_regression",
    "s04_stream_reassessment",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "3"))
    from evtrail.plans.registry import load_all
    from evtrail.session import build_session

    extra = {"spark.eventLog.enabled": "false"}
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2, extra=extra)
    reg = load_all()
    times, details = {}, {}
    for name in HEADLINE:
        build = reg[name].build
        df = build(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()          # warm-up
        runs = []
        for _ in range(reps):
            t0 = time.perf_counter()
            build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        plan = df._jdf.queryExecution().executedPlan().toString()
        times[name] = round(statistics.median(runs), 3)
        shuffles = len(re.findall(r"(?<!Broadcast)(?<!Reused)Exchange\b", plan))
        details[name] = {"rows_out": df.count(), "shuffles": shuffles, "broadcasts": plan.count("BroadcastExchange"),
                         "runs": [round(r, 3) for r in runs]}
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_median_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": int(cpus), "details": details}))
    spark.stop()


if __name__ == "__main__":
    main()
