"""Device context: static information, peer-group standardisation, offline outliers."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse import schemas as S
from fleetpulse.functions.scalars import guarded_ratio, normal_mac

HOURS = range(24)


def node_details(nodes: DataFrame, node_type: int = S.DEVICE_NODE_TYPE) -> DataFrame:
    """Topology nodes of one type, renamed."""
    return nodes.where(F.col("topo_node_type_id") == node_type).select(
        normal_mac("node_key").alias("mac"),
        F.col("src_node_model").alias("hardware_model"),
        F.col("src_node_building_id").alias("building_id"),
        F.col("cly_acct_number").alias("cly_account_number"),
    )


def devices_per_building(details: DataFrame) -> DataFrame:
    """Distinct devices in each building; distinct first, so a huge building is counted in parallel."""
    return (
        details.select("building_id", "mac").distinct()
        .groupBy("building_id").agg(F.count("mac").alias("n_cpe_building"))
    )


def merged_validity(history: DataFrame) -> DataFrame:
    """One validity span per (headend, group, device)."""
    return (
        history.groupBy("cmts", "service_group", normal_mac("mac").alias("mac"))
        .agg(F.min("modemloss_valid_from").alias("v_from"), F.max("modemloss_valid_to").alias("v_to"))
    )


def valid_on(spans: DataFrame, day: date) -> DataFrame:
    """Spans that contain a day."""
    return spans.where((F.to_date("v_from") <= F.lit(day)) & (F.to_date("v_to") >= F.lit(day)))


def device_static(nodes: DataFrame, history: DataFrame, models: Sequence[str] = tuple(S.MODEL_IDS)) -> DataFrame:
    """Model, account, building size, group and validity span of each supported device.

    A device without a building drops out.
    """
    details = node_details(nodes)
    supported = details.where(F.col("hardware_model").isin(*models))
    return (
        supported.join(devices_per_building(details), "building_id")
        .join(merged_validity(history), "mac")
        .select("mac", "hardware_model", "cly_account_number", "n_cpe_building", "service_group", "cmts", "v_from", "v_to")
    )


def offline_hours(health: DataFrame, as_of: date | None = None) -> DataFrame:
    """(mac, hour_stamp) of every hour with a known status other than online, up to ``as_of``."""
    past = health if as_of is None else health.where(F.col("hour_stamp") < F.date_add(F.lit(as_of), 1))
    return past.where(F.col("cm_status") != S.ONLINE_STATUS).select("mac", "hour_stamp")


def history_days(health: DataFrame, as_of: date | None = None) -> DataFrame:
    """One row: calendar days from the first to the last hour kept."""
    past = health if as_of is None else health.where(F.col("hour_stamp") < F.date_add(F.lit(as_of), 1))
    span = F.datediff(F.to_date(F.max("hour_stamp")), F.to_date(F.min("hour_stamp"))) + 1
    return past.agg(span.alias("n_days"))


def unavailability(health: DataFrame, as_of: date | None = None) -> DataFrame:
    """(mac, h, unavailable): percent of the history's days a device was offline at hour h."""
    n_days = history_days(health, as_of).scalar()
    return (
        offline_hours(health, as_of)
        .groupBy("mac", F.hour("hour_stamp").alias("h"))
        .agg(F.count("*").alias("n"))
        .select("mac", "h", (100.0 * F.col("n") / n_days).alias("unavailable"))
    )


def unavailability_wide(rates: DataFrame) -> DataFrame:
    """One row per ever-offline device with 24 hourly percentages; missing hours are 0."""
    return rates.groupBy("mac").agg(
        *[
            F.expr(f"coalesce(max(CASE WHEN h = {h} THEN unavailable END), 0D) AS `{h}_unavailable`")
            for h in HOURS
        ]
    )


def model_cuts(wide: DataFrame, percentile: float = 0.99) -> DataFrame:
    """Discrete percentile of each hour's percentages per device model.

    ``wide`` carries ``hardware_model``. The aggregate's state is value -> count and a
    percentage takes at most (history days + 1) values, so it stays small for any fleet.
    """
    return wide.groupBy("hardware_model").agg(
        *[
            F.expr(f"percentile_disc({percentile}) WITHIN GROUP (ORDER BY `{h}_unavailable`)").alias(f"{h}_cut")
            for h in HOURS
        ]
    )


def offline_outliers(wide: DataFrame, cuts: DataFrame, strict: bool = False) -> DataFrame:
    """Devices at or above (``strict``: above) their model's cut in at least one hour."""
    compare = ">" if strict else ">="
    beyond = " OR ".join(f"`{h}_unavailable` {compare} `{h}_cut`" for h in HOURS)
    # the cuts hold one row per supported model (a fixed list), so they are safe to broadcast
    joined = wide.join(F.broadcast(cuts), "hardware_model")
    return joined.where(beyond).select("mac").distinct()


def flag_offline(health: DataFrame, offline: DataFrame) -> DataFrame:
    """Left join of offline hours by full timestamp; hours without a hit are 0."""
    marks = offline.select("mac", "hour_stamp").distinct().withColumn("_hit", F.lit(1))
    return health.join(marks, ["mac", "hour_stamp"], "left").withColumn(
        "offline_flg", F.coalesce("_hit", F.lit(0))
    ).drop("_hit")


def enrich_hours(health: DataFrame, static: DataFrame, outliers: DataFrame | None = None) -> DataFrame:
    """Hourly health with static information valid that day, without outlier devices.

    The offline flag is a column of the same row (hours are unique per device), so no join
    against the offline hours is needed here.
    """
    base = health if outliers is None else health.join(outliers, "mac", "left_anti")
    day = F.to_date("hour_stamp")
    joined = base.join(static, "mac").where((F.to_date("v_from") <= day) & (day <= F.to_date("v_to")))
    flag = F.coalesce(F.col("cm_status") != S.ONLINE_STATUS, F.lit(False)).cast("int")
    return joined.select(
        "mac", "hardware_model", "cly_account_number", "n_cpe_building", "service_group", "cmts",
        flag.alias("offline_flg"), F.col("account_number").alias("saa_account_number"), "hour_stamp",
        *S.DEVICE_MEASURES,
    )


def group_ranges(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Mean and range (max - min) of each measure per group."""
    return df.groupBy(*keys).agg(
        *[F.avg(m).alias(f"avg_{m}") for m in measures],
        *[(F.max(m) - F.min(m)).alias(f"range_{m}") for m in measures],
    )


def standardise_to_group(
    df: DataFrame,
    keys: Sequence[str] = ("cmts", "service_group", "hour_stamp"),
    measures: Sequence[str] = tuple(S.DEVICE_MEASURES),
) -> DataFrame:
    """(x - group mean) / group range; 0 when the range is 0, NULL for an all-NULL group.

    Aggregate and join back rather than a window: the aggregate combines before its
    shuffle, and a hot group's rows can be split over tasks by the adaptive skew join,
    while a window would put the whole group in one task.
    """
    stats = group_ranges(df, keys, measures)
    others = [c for c in df.columns if c not in measures]
    return df.join(stats, list(keys)).select(
        *others,
        *[guarded_ratio(F.col(m) - F.col(f"avg_{m}"), F.col(f"range_{m}")).alias(m) for m in measures],
    )
