"""Scans and imports."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetpulse import schemas as S
from fleetpulse.functions.scalars import mapped, on_day


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet table at a path of any catalog or store; with an explicit schema nothing is inferred."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """Table of another database. Pass partitionColumn, bounds and numPartitions for a parallel read."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def day_scan(df: DataFrame, ts: str, columns: list[str], day: date | None = None) -> DataFrame:
    """Projection with an optional one-day half-open range, both of which reach the file scan."""
    return (df if day is None else df.where(on_day(ts, day))).select(*columns)


def downstream_hours(df: DataFrame, day: date | None = None) -> DataFrame:
    """Hourly downstream interface statistics."""
    return day_scan(df, "hour", ["cmts_name", "downstream_name", "hour", *S.DOWNSTREAM_MEASURES], day)


def upstream_hours(df: DataFrame, day: date | None = None) -> DataFrame:
    """Hourly upstream interface statistics."""
    return day_scan(df, "hour", ["cmts_name", "upstream_name", "hour", *S.UPSTREAM_MEASURES], day)


def health_hours(df: DataFrame, day: date | None = None) -> DataFrame:
    """Hourly device health."""
    cols = ["mac", "account_number", "hour_stamp", "cm_status", *S.DEVICE_MEASURES]
    return day_scan(df, "hour_stamp", cols, day)


def interface_groups(df: DataFrame) -> DataFrame:
    """Interface to service group."""
    return df.select("cmts_name", F.col("service_group_name").alias("service_group"), "ifc_descr")


def interactions_of_day(df: DataFrame, day: date | None = None) -> DataFrame:
    """Support interactions with their resolution flags."""
    cols = ["interaction_id", "account_number", "create_date", "emp_id", "flg_ftr_0d_flg", "flg_ftr_7d_flg"]
    return day_scan(df, "create_date", cols, day)


def normalise_sample(
    df: DataFrame,
    model_ids: Mapping[str, int] = S.MODEL_IDS,
    drop_healthy_days: bool = True,
    date_format: str = "dd/MM/yyyy",
) -> DataFrame:
    """Labelled sample with lower-case names, day-first dates, weekday first and model ids.

    With ``drop_healthy_days`` only days with at least one labelled row stay.
    """
    low = df.toDF(*[c.lower() for c in df.columns])
    if isinstance(low.schema["day_0"].dataType, T.StringType):
        low = low.withColumn("day_0", F.to_date("day_0", date_format))
    out = low.select(
        F.weekday("day_0").alias("weekday"),
        *[mapped(c, model_ids).alias(c) if c == "hardware_model" else F.col(c) for c in low.columns],
    )
    return keep_labelled_days(out) if drop_healthy_days else out


def read_sample(spark: SparkSession, path: str, schema: T.StructType, **kwargs) -> DataFrame:
    """``normalise_sample`` of a CSV export with a header and a given schema."""
    return normalise_sample(spark.read.schema(schema).option("header", True).csv(path), **kwargs)


def keep_labelled_days(df: DataFrame, day: str = "day_0", label: str = "milestone_name") -> DataFrame:
    """Rows of the days that have at least one non-null label (semi join on the few such days)."""
    days = df.where(F.col(label).isNotNull()).select(day).distinct()
    return df.join(days, day, "left_semi")
