"""Writes: appends, overwrites, rolling buffers, drains, run log, stored results."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetpulse import schemas as S
from fleetpulse.operators.ranking import dense_index


def append(df: DataFrame, path: str, partition: Sequence[str] = ("day_0",)) -> None:
    """Append a result to a table partitioned by day."""
    df.write.mode("append").partitionBy(*partition).parquet(path)


def overwrite(df: DataFrame, path: str) -> None:
    """Replace a table's whole content."""
    df.write.mode("overwrite").parquet(path)


def overwrite_days(df: DataFrame, path: str, day: str = "day_0") -> None:
    """Replace only the days present in ``df``: safe to run twice, untouched days stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def counted(write: Callable[..., None], df: DataFrame, *args: object, **metrics: Column) -> dict[str, object]:
    """Run ``write(df, *args)``; ``n_rows`` and the named aggregates of the rows it wrote.

    The writing tasks gather them, so nothing is scanned again. They are observed at the write itself, after
    every shuffle: of a task that runs twice only the attempt that is kept counts. Without rows ``n_rows`` is 0.
    """
    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("n_rows"), *[m.alias(name) for name, m in metrics.items()]), *args)
    return {"n_rows": 0} | dict.fromkeys(metrics) | seen.get


def drop_days_before(spark: SparkSession, path: str, day: date, name: str = "day_0") -> None:
    """Delete the partitions of earlier days on disk; safe to repeat, and without a table there is nothing to do."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for entry in fs.listStatus(root) if fs.exists(root) else []:
        key, _, value = entry.getPath().getName().partition("=")
        if key == name and value < day.isoformat():
            fs.delete(entry.getPath(), True)


def roll(buffer: DataFrame, new: DataFrame, day_0: date, keep: int, day: str = "day_0") -> DataFrame:
    """The rolling buffer after adding day ``day_0``: only the last ``keep`` days remain."""
    floor = day_0 - timedelta(days=keep)
    kept = buffer.where((F.col(day) > F.lit(floor)) & (F.col(day) != F.lit(day_0)))
    return kept.unionByName(new)


def partition_days(spark: SparkSession, path: str, day: str = "day_0") -> DataFrame:
    """Days present in a day-partitioned table, read from partition values only."""
    return spark.read.parquet(path).select(day).distinct()


def drain(spark: SparkSession, source: str, target: str, schema: T.StructType = S.RUN_LOG) -> None:
    """Move the lines that are at ``source`` now to ``target`` (partitioned by ``batch``).

    The files are listed first, and exactly those are copied and deleted, so lines that arrive
    meanwhile stay for the next drain. The batch is named after its files: a drain that failed half
    way and runs again replaces its own batch instead of appending twice.
    """
    files = sorted(spark.read.schema(schema).parquet(source).inputFiles())
    if not files:
        return
    batch = hashlib.sha256("\n".join(files).encode()).hexdigest()[:16]
    rows = spark.read.schema(schema).parquet(*files).withColumn("batch", F.lit(batch))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(target)
    for file in files:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False)


def log_lines(lines: DataFrame, path: str) -> None:
    """Append (log_text, is_error, is_done) rows to the run log, stamped now; the text is kept whole."""
    lines.select(
        F.current_timestamp().alias("log_date"),
        F.col("is_error").cast("int").alias("is_error"),
        "log_text",
        F.col("is_done").cast("int").alias("is_done"),
    ).write.mode("append").parquet(path)


def empty_like(df: DataFrame) -> DataFrame:
    """No rows, the schema of a query."""
    return df.sparkSession.createDataFrame([], df.schema)


def with_sequence(df: DataFrame, name: str = "seq_id", start_after: int = 0) -> DataFrame:
    """Gap-free ids in (day, stable hash of the device) order, after the highest id so far.

    Days are few, so their offsets come from a small table; inside a day the numbering is
    spread over hash prefixes.
    """
    counts = df.groupBy("day_0").agg(F.count("*").alias("_n"))
    before = W.orderBy("day_0").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("day_0", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_day_off"))
    numbered = dense_index(df, ["mac"], "_i", by=["day_0"])
    return (
        numbered.join(offsets, "day_0")
        .withColumn(name, F.col("_day_off") + F.col("_i") + F.lit(start_after))
        .drop("_day_off", "_i")
    )
