"""Daily averages, their day-over-day changes and the five-day vector."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetpulse import schemas as S
from fleetpulse.functions.scalars import row_mean
from fleetpulse.operators.windows import history_pivot, window_changes, window_levels
from fleetpulse.plans.devices import device_vector, one_day_vector
from fleetpulse.plans.interface import downstream_vector, upstream_vector
from fleetpulse.sources.sinks import with_sequence


def daily_vectors(
    health: DataFrame, nodes: DataFrame, history: DataFrame,
    up_hours: DataFrame, down_hours: DataFrame, groups: DataFrame, day: date | None = None,
) -> DataFrame:
    """One-day vectors of one day, or of every day present."""
    return one_day_vector(
        device_vector(health, nodes, history, day),
        upstream_vector(up_hours, groups, day),
        downstream_vector(down_hours, groups, day),
    )


def _feature_columns(past: str = "{m}_{k}d") -> list[Column]:
    """The 280 features from 6-hour columns, day means ``<m>`` and the history columns."""
    out: list[Column] = []
    for m in S.DAILY_MEASURES:
        out += window_levels(m) if m in S.LEVEL_MEASURES else window_changes(m)
        out += [F.col(m)] + [F.expr(f"{past.format(m=m, k=k)} AS {m}_{k}d") for k in S.HISTORY_DAYS]
    return out


def five_day_vector(vectors: DataFrame, daily: DataFrame, diffs: DataFrame, day_0: date) -> DataFrame:
    """Five-day vector of one day from the one-day vectors and the two rolling buffers."""
    today = F.col("day_0") == F.lit(day_0)
    means = daily.where(today).select("mac", "day_0", *S.DAILY_MEASURES)
    joined = vectors.where(today).join(means, ["mac", "day_0"]).join(history_pivot(diffs, day_0), "mac")
    return joined.select(*S.IDENTITY, *_feature_columns())


def five_day_history(vectors: DataFrame) -> DataFrame:
    """Five-day vectors of every day at once, straight from the one-day vectors.

    Equal to running the daily step day by day (one row per device and day). No join: day
    means are columns of the same row, and both the change since yesterday and the four
    older days are windows over one shuffle and one sort by device and day.
    """
    number = F.datediff("day_0", F.lit(date(1970, 1, 1)))
    rows = vectors.withColumns({m: row_mean(S.windowed(m)) for m in S.DAILY_MEASURES}).withColumn("_n", number)
    w = W.partitionBy("mac").orderBy("_n")
    adjacent = F.lag("_n").over(w) == F.col("_n") - 1
    # yesterday's measures as one struct: a single window expression instead of twenty
    rows = rows.withColumn("_y", F.when(adjacent, F.lag(F.struct(*S.DIFF_MEASURES)).over(w)))
    changes = [F.expr(f"{m} - _y.{m} AS {m}") for m in S.DIFF_MEASURES]
    rows = rows.withColumn("_d1", F.struct(*S.LEVEL_MEASURES, *changes))
    rows = rows.withColumns({f"_d{k}": F.max("_d1").over(w.rangeBetween(1 - k, 1 - k)) for k in S.HISTORY_DAYS[1:]})
    return rows.select(*S.IDENTITY, *_feature_columns("_d{k}.{m}"))


def numbered(vectors: DataFrame, start_after: int = 0) -> DataFrame:
    """Five-day vectors with their surrogate id."""
    return with_sequence(vectors, "seq_id", start_after)
