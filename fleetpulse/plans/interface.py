"""Interface vectors: hourly interface statistics to one row per headend, group and day."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse import schemas as S
from fleetpulse.functions.scalars import downstream_interface, upstream_interface
from fleetpulse.operators.windows import spread, window_means, with_hour_window
from fleetpulse.sources.tables import downstream_hours, interface_groups, upstream_hours

KEYS = ["cmts_name", "ifc_descr", "day_0"]


def extracted(hours: DataFrame, interface: Column, measures: Mapping[str, str]) -> DataFrame:
    """Hourly rows with interface text, day and 6-hour window."""
    marked = with_hour_window(hours, "hour")
    return marked.select("cmts_name", interface.alias("ifc_descr"), "day_0", "hour_window", *measures)


def with_group(vectors: DataFrame, groups: DataFrame) -> DataFrame:
    """Inner join with the interface map. An interface in several groups is repeated.

    The aggregated side joins, not the hourly one; no hint, since the map's size is known
    to the optimizer from its files.
    """
    return interface_groups(groups).join(vectors, ["cmts_name", "ifc_descr"])


def group_means(vectors: DataFrame, measures: Mapping[str, str]) -> DataFrame:
    """Unweighted mean of the interfaces' windows per headend, group and day."""
    cols = [c for name in measures.values() for c in S.windowed(name)]
    return vectors.groupBy("cmts_name", "service_group", "day_0").agg(*[F.avg(c).alias(c) for c in cols])


def _vector(rows: DataFrame, groups: DataFrame, measures: Mapping[str, str]) -> DataFrame:
    means = window_means(rows, KEYS, list(measures))
    wide = spread(means, KEYS, "hour_window", S.WINDOWS, measures)
    return group_means(with_group(wide, groups), measures)


def downstream_vector(hours: DataFrame, groups: DataFrame, day: date | None = None) -> DataFrame:
    """Downstream vector of one day, or of every day present."""
    scan = downstream_hours(hours, day)
    rows = extracted(scan, downstream_interface("downstream_name"), S.DOWNSTREAM_MEASURES)
    return _vector(rows, groups, S.DOWNSTREAM_MEASURES)


def upstream_vector(hours: DataFrame, groups: DataFrame, day: date | None = None) -> DataFrame:
    """Upstream vector of one day, or of every day present."""
    scan = upstream_hours(hours, day)
    rows = extracted(scan, upstream_interface("upstream_name"), S.UPSTREAM_MEASURES)
    return _vector(rows, groups, S.UPSTREAM_MEASURES)
