"""Device vectors: offline outliers, and hourly health to one standardised row per device and day."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame

from fleetpulse import schemas as S
from fleetpulse.operators.groups import (
    device_static,
    enrich_hours,
    model_cuts,
    offline_outliers,
    standardise_to_group,
    unavailability,
    unavailability_wide,
)
from fleetpulse.operators.windows import device_window_stats, spread, with_hour_window
from fleetpulse.session import staged
from fleetpulse.sources.tables import health_hours

DEVICE_KEYS = [
    "cmts", "service_group", "mac", "saa_account_number",
    "hardware_model", "cly_account_number", "n_cpe_building", "day_0",
]
STATS = {m: name for m, name in S.DEVICE_MEASURES.items()} | {"offline_pct": "offline_pct"} | {
    f"miss_{m}": f"miss_{name}" for m, name in S.DEVICE_MEASURES.items()
}


def outlier_devices(
    health: DataFrame, static: DataFrame, as_of: date | None = None, percentile: float = 0.99, strict: bool = False
) -> DataFrame:
    """Devices whose hourly offline share is extreme for their model.

    Only devices offline at least once are in the population.
    """
    wide = unavailability_wide(unavailability(health, as_of))
    population = wide.join(static.select("mac", "hardware_model"), "mac")
    return offline_outliers(population, model_cuts(population, percentile), strict)


def window_rows(standardised: DataFrame) -> DataFrame:
    """Per device, day and window: means, missing and offline percentages."""
    return device_window_stats(with_hour_window(standardised, "hour_stamp"), DEVICE_KEYS, list(S.DEVICE_MEASURES))


def device_vector(
    health: DataFrame,
    nodes: DataFrame,
    history: DataFrame,
    day: date | None = None,
    as_of: date | None = None,
) -> DataFrame:
    """Device vector of one day, or of every day present, standardised to the peer group.

    ``as_of`` bounds the offline history; by default it is the processed day (or all of the
    history when every day is processed).

    The device table and the outliers are written once: the hourly rows are read both for
    the group statistics and for the join back, and from files the optimizer knows the two
    tables' sizes when it decides on a broadcast.
    """
    static = staged(device_static(nodes, history), "device-static")
    outliers = staged(outlier_devices(health, static, as_of or day), "outliers")
    enriched = enrich_hours(health_hours(health, day), static, outliers)
    rows = window_rows(standardise_to_group(enriched))
    return spread(rows, DEVICE_KEYS, "hour_window", S.WINDOWS, STATS)


def one_day_vector(device: DataFrame, up: DataFrame, down: DataFrame) -> DataFrame:
    """Device vector with the vectors of its group's interfaces."""
    keys = ["cmts", "service_group", "day_0"]
    u = up.withColumnRenamed("cmts_name", "cmts")
    d = down.withColumnRenamed("cmts_name", "cmts")
    return device.join(u, keys).join(d, keys)

