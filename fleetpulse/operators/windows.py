"""Six-hour aggregation, missing and offline shares, pivots, day means and day differences."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetpulse import schemas as S
from fleetpulse.functions.scalars import row_mean, six_hour_window

HOURS_PER_WINDOW = 6


def window_means(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Mean of each measure per key and 6-hour window (column ``hour_window``)."""
    return df.groupBy(*keys, "hour_window").agg(*[F.avg(m).alias(m) for m in measures])


def missing_pct(measure: str) -> Column:
    """Share of the six hours without a value; an absent row counts as missing."""
    return 100.0 * (HOURS_PER_WINDOW - F.count(measure)) / HOURS_PER_WINDOW


def offline_pct(flag: str = "offline_flg") -> Column:
    """Share of the six hours flagged offline."""
    return 100.0 * F.sum(flag) / HOURS_PER_WINDOW


def device_window_stats(df: DataFrame, keys: Sequence[str], measures: Sequence[str], flag: str = "offline_flg") -> DataFrame:
    """Per device and window: means, missing percentages and the offline percentage, in one pass."""
    return df.groupBy(*keys, "hour_window").agg(
        *[F.avg(m).alias(m) for m in measures],
        *[missing_pct(m).alias(f"miss_{m}") for m in measures],
        offline_pct(flag).alias("offline_pct"),
    )


def spread(
    df: DataFrame,
    keys: Sequence[str],
    marker: str,
    values: Sequence[int],
    measures: Mapping[str, str],
) -> DataFrame:
    """Pivot: one row per key with columns ``<value>_<new name>`` for each marker value.

    Written as conditional maxima so that it is a single partial + final aggregation.
    """
    cols = [
        F.expr(f"max(CASE WHEN `{marker}` = {v} THEN `{m}` END) AS `{v}_{name}`")
        for m, name in measures.items()
        for v in values
    ]
    return df.groupBy(*keys).agg(*cols)


def day_means(vectors: DataFrame, measures: Sequence[str] = S.DAILY_MEASURES) -> DataFrame:
    """Mean of the known windows of each measure, per device and day."""
    return vectors.select("mac", "day_0", *[row_mean(S.windowed(m)).alias(m) for m in measures])


def day_differences(
    daily: DataFrame,
    diff: Sequence[str] = S.DIFF_MEASURES,
    level: Sequence[str] = S.LEVEL_MEASURES,
) -> DataFrame:
    """Change of each ``diff`` measure since the calendar day before; ``level`` is passed on.

    A window per device: it holds one row per day, whatever the raw volume was.
    """
    w = W.partitionBy("mac").orderBy("day_0")
    adjacent = F.lag("day_0").over(w) == F.date_sub("day_0", 1)
    return daily.select(
        "mac", "day_0", *level, *[F.when(adjacent, F.col(m) - F.lag(m).over(w)).alias(m) for m in diff]
    )


def day_differences_by_pivot(
    daily: DataFrame,
    day_0: date,
    diff: Sequence[str] = S.DIFF_MEASURES,
    level: Sequence[str] = S.LEVEL_MEASURES,
) -> DataFrame:
    """The same for one day, from the two days of the rolling buffer."""
    marked = daily.withColumn("_off", F.datediff(F.lit(day_0), "day_0")).where(F.col("_off").between(0, 1))
    wide = marked.groupBy("mac").agg(
        F.max(F.when(F.col("_off") == 0, 1)).alias("_today"),
        *[F.expr(f"max(CASE WHEN _off = {v} THEN `{m}` END) AS `{v}_{m}`") for m in [*diff, *level] for v in (0, 1)],
    )
    # a device seen only yesterday has no row today
    return wide.where("_today = 1").select(
        "mac",
        F.lit(day_0).alias("day_0"),
        *[F.col(f"0_{m}").alias(m) for m in level],
        *[(F.col(f"0_{m}") - F.col(f"1_{m}")).alias(m) for m in diff],
    )


def with_hour_window(df: DataFrame, ts: str) -> DataFrame:
    """Adds ``day_0`` and ``hour_window``."""
    return df.withColumns({"day_0": F.to_date(ts), "hour_window": six_hour_window(ts)})


def window_changes(measure: str) -> list[Column]:
    """Window k minus window k+1, as ``_6h``, ``_12h`` and ``_18h``; NULL if either is NULL."""
    return [
        F.expr(f"`{k}_{measure}` - `{k + 1}_{measure}` AS `{measure}_{h}`")
        for k, h in enumerate(["6h", "12h", "18h"])
    ]


def window_levels(measure: str) -> list[Column]:
    """The four windows as ``_6h`` to ``_24h``."""
    return [F.expr(f"`{k}_{measure}` AS `{measure}_{h}`") for k, h in enumerate(["6h", "12h", "18h", "24h"])]


def history_by_day(diffs: DataFrame, measures: Sequence[str] = S.DAILY_MEASURES) -> DataFrame:
    """For every (mac, day_0): each measure at day offsets 0..4 as ``_1d`` .. ``_5d``.

    All days at once: a range frame of exactly one day over the day number picks the
    calendar day wanted, so gaps give NULL.
    """
    packed = diffs.select(
        "mac", "day_0", F.datediff("day_0", F.lit(date(1970, 1, 1))).alias("_n"), F.struct(*measures).alias("_m")
    )
    w = W.partitionBy("mac").orderBy("_n")
    lagged = packed.withColumns(
        {f"_{k}": F.max("_m").over(w.rangeBetween(1 - k, 1 - k)) for k in S.HISTORY_DAYS}
    )
    return lagged.select(
        "mac", "day_0", *[F.expr(f"_{k}.{m} AS {m}_{k}d") for m in measures for k in S.HISTORY_DAYS]
    )


def history_pivot(diffs: DataFrame, day_0: date, measures: Sequence[str] = S.DAILY_MEASURES) -> DataFrame:
    """The same for one day, as a pivot of the five-day buffer by day offset."""
    marked = diffs.withColumn("_off", F.datediff(F.lit(day_0), "day_0")).where(F.col("_off").between(0, 4))
    return marked.groupBy("mac").agg(
        *[
            F.expr(f"max(CASE WHEN _off = {k - 1} THEN `{m}` END) AS `{m}_{k}d`")
            for m in measures
            for k in S.HISTORY_DAYS
        ]
    )
