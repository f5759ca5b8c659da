"""Data-quality and run-control checks. Each returns a small table with an ``ok`` column."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_LABEL_AGE_DAYS = 9


class CheckFailed(Exception):
    """A run-control check did not hold."""


def row_counts(steps: Mapping[str, tuple[DataFrame, bool]]) -> DataFrame:
    """(step, n_rows, ok): a step marked must-not-be-empty fails with no rows."""
    tables = [
        df.agg(F.count("*").alias("n_rows")).select(
            F.lit(name).alias("step"), "n_rows", ((F.col("n_rows") > 0) | F.lit(not needed)).alias("ok")
        )
        for name, (df, needed) in steps.items()
    ]
    return reduce(DataFrame.unionByName, tables)


def written_rows(spark: SparkSession, steps: Mapping[str, tuple[int, bool]]) -> DataFrame:
    """``row_counts`` of finished writes, from the counts that ``sinks.counted`` gives, without another scan."""
    data = [(name, n, n > 0 or not needed) for name, (n, needed) in steps.items()]
    return spark.createDataFrame(data, "step string, n_rows long, ok boolean")


def buffer_state(buffers: Mapping[str, DataFrame], expected: date) -> DataFrame:
    """(buffer, max_day, ok): each buffer's newest day must be the expected one."""
    tables = [
        df.agg(F.max("day_0").alias("max_day")).select(
            F.lit(name).alias("buffer"), "max_day",
            F.coalesce(F.col("max_day") == F.lit(expected), F.lit(False)).alias("ok"),
        )
        for name, df in buffers.items()
    ]
    return reduce(DataFrame.unionByName, tables)


def day_absent(df: DataFrame, day_0: date) -> DataFrame:
    """(n_rows, ok): the day must not be in the table yet."""
    return df.where(F.col("day_0") == F.lit(day_0)).agg(F.count("*").alias("n_rows")).select(
        "n_rows", (F.col("n_rows") == 0).alias("ok")
    )


def days_valid(history: DataFrame, ts: str, day_0: date, label_day: date, today: date) -> DataFrame:
    """(check, ok): the day lies in the retained history and the label day is old enough."""
    span = history.agg(F.to_date(F.min(ts)).alias("lo"), F.to_date(F.max(ts)).alias("hi"))
    aged = label_day <= today - timedelta(days=MIN_LABEL_AGE_DAYS)
    return span.select(
        F.explode(
            F.array(
                F.struct(F.lit("day_in_history").alias("check"), F.lit(day_0).between(F.col("lo"), F.col("hi")).alias("ok")),
                F.struct(F.lit("label_day_aged").alias("check"), F.lit(aged).alias("ok")),
            )
        ).alias("c")
    ).select("c.check", F.coalesce("c.ok", F.lit(False)).alias("ok"))


def grew(before: DataFrame, after: DataFrame, must_grow: bool = True) -> DataFrame:
    """(inserted, ok): rows added between two states of a table."""
    was = before.agg(F.count("*").alias("n")).scalar()
    return after.agg((F.count("*") - was).alias("inserted")).select(
        "inserted", ((F.col("inserted") > 0) | F.lit(not must_grow)).alias("ok")
    )


def inserted(spark: SparkSession, n_rows: int, must_grow: bool = True) -> DataFrame:
    """``grew`` for a write that was counted while it ran."""
    return spark.createDataFrame([(n_rows, n_rows > 0 or not must_grow)], "inserted long, ok boolean")


def log_clean(log: DataFrame, day: date | None = None) -> DataFrame:
    """(errors, ok): no error lines in the run log, optionally of one day."""
    lines = log if day is None else log.where(F.to_date("log_date") == F.lit(day))
    return lines.agg(F.coalesce(F.sum("is_error"), F.lit(0)).cast("long").alias("errors")).select(
        "errors", (F.col("errors") == 0).alias("ok")
    )


def last_run_done(log: DataFrame) -> DataFrame:
    """(last_done, ok): the newest log line must close a run."""
    newest = log.agg(F.max_by("is_done", "log_date").alias("last_done"))
    return newest.select("last_done", (F.coalesce(F.col("last_done"), F.lit(1)) == 1).alias("ok"))


def columns_identical(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n_different, ok): rows where two columns differ; a NULL differs from everything."""
    same = F.coalesce(F.col(a) == F.col(b), F.lit(False))
    return df.agg(F.count_if(~same).alias("n_different")).select("n_different", (F.col("n_different") == 0).alias("ok"))


def tables_absent(spark: SparkSession, names: list[str]) -> DataFrame:
    """(table, ok): target tables must not exist before the first initialisation."""
    return spark.createDataFrame(
        [(n, not spark.catalog.tableExists(n)) for n in names], "table string, ok boolean"
    )


def targets_absent(source: DataFrame, existing: DataFrame, day: str = "day_0") -> DataFrame:
    """(day_0, ok): per day of the source, no target of that day may exist before the first initialisation."""
    there = existing.select(day).distinct().withColumn("_there", F.lit(True))
    return source.select(day).distinct().join(there, day, "left").select(day, F.col("_there").isNull().alias("ok"))


def require(check: DataFrame, message: str) -> None:
    """Raise when a check table has a failed row, with the number of failed rows."""
    failed = check.where("NOT ok").count()
    if failed:
        raise CheckFailed(f"{message}: {failed} failed check{'s' if failed > 1 else ''}")
