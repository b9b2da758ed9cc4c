"""The assembled point-in-time model table.

One daily rollup (exchange #1 on (entity, day), map-side combined), one
window pass over the bounded daily series (exchange #2 on entity), then a
filter to index days.  Demographics are a dimension join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evtrail.operators import pointintime as pit


def build_model_table(enc: DataFrame, entity: str = "entity_id", ts: str = "ts", event_id: str = "event_id",
                      cls: str = "cls", cost: str = "cost", index_class: str = "emergency",
                      classes: Sequence[str] = ("emergency", "inpatient", "outpatient"),
                      windows: Sequence[int] = (30, 90, 365), horizon: int = 90,
                      recency_missing: int | None = None, censor: bool = True) -> DataFrame:
    counts = {f"n_{c}": F.col(cls) == c for c in classes}
    first_idx = F.when(F.col(cls) == index_class, F.struct(F.col(ts).alias("t"), F.col(event_id).alias("i")))
    daily = pit.daily_rollup(enc, entity, ts, counts=counts, sums={"cost": F.col(cost)},
                             mins={"_first": first_idx})
    idx_cnt = f"n_{index_class}"
    f = pit.lookback(daily, entity, windows, count_cols=list(counts), sum_cols=["cost"])
    f = pit.history_before(f, entity, ["n_events", idx_cnt])
    f = pit.recency(f, entity, {"days_since_prev_visit": None, f"days_since_prev_{index_class}": idx_cnt},
                    missing=recency_missing)
    f = pit.lookahead_any(f, entity, idx_cnt, horizon, "label")
    f = f.where(F.col("_first").isNotNull())
    if censor:
        # end of observation = max day over ALL events, read off the daily
        # rollup (already aggregated) instead of scanning the events again
        f = pit.censor_followup(f, daily.agg(F.max("day").alias("max_day")), horizon)
    w_short, w_mid, w_long = windows[0], windows[1], windows[-1]
    ic = f"n_{index_class}"
    return f.select(
        F.col(entity), F.col("_first.i").alias("index_id"), F.col("_first.t").alias("index_ts"), "day",
        *[F.col(f"{c}_{w}d") for c in counts for w in windows],
        *[F.col(f"cost_{w}d") for w in windows],
        F.col("hist_n_events").alias("hist_visits"), F.col(f"hist_{ic}").alias(f"hist_{index_class}"),
        "days_since_prev_visit", f"days_since_prev_{index_class}",
        # E14 / E15 / E29 derived ratios
        (F.col(f"cost_{w_short}d") / (F.col(f"cost_{w_mid}d") + 1)).alias("cost_velocity"),
        (F.col(f"{ic}_{w_long}d") / (F.col(f"n_outpatient_{w_long}d") + 1)).alias("ed_out_ratio")
        if "outpatient" in classes else F.lit(None).cast("double").alias("ed_out_ratio"),
        ((F.col(f"{ic}_{w_short}d") * 3) > F.col(f"{ic}_{w_mid}d")).cast("int").alias("accelerating"),
        "label")
