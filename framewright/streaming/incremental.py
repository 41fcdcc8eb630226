"""Checks over unbounded frames with bounded state: an extension; batch results are the contract."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_moments(events: DataFrame, time: str, value: str, group: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """count, mean and population variance of each group and window; a window is final when the watermark has passed it."""
    return (
        events.withWatermark(time, late)
        .groupBy(F.window(time, width), group)
        .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("var"))
        .select(F.col("window.start").alias("start"), group, "n", "mean", "var")
    )


def without_repeats(events: DataFrame, time: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """The first row of each key within the watermark's delay."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def non_monotonic(events: DataFrame, group: str, order: str, time: str) -> DataFrame:
    """Rows whose time is not above the last time of their group seen so far; one number per group is kept as state."""

    def check(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(order)
        previous = rows["at"].shift(1)
        if last is not None and len(rows):
            previous.iloc[0] = last
        bad = rows[rows["at"] <= previous]
        state.update((int(rows["at"].iloc[-1]),))
        yield pd.DataFrame({"group_key": [key[0]] * len(bad), "row_order": bad[order].astype("int64").to_numpy(), "at": bad["at"].to_numpy()})

    rows = events.select(F.col(group).alias("group_key"), F.col(order).cast("long").alias(order), F.col(time).cast("long").alias("at")).where("at IS NOT NULL AND group_key IS NOT NULL")
    return rows.groupBy("group_key").applyInPandasWithState(check, "group_key long, row_order long, at long", "last long", "append", "NoTimeout")
