"""Integer series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def series(start: Column, stop: Column, step: Column) -> Column:
    """Array of whole numbers from start to stop.

    A NULL or zero step counts as 1, a NULL start as 1; a step away from ``stop`` gives an
    empty array.
    """
    by = F.when(step.isNull() | (step == 0), F.lit(1).cast("long")).otherwise(step.cast("long"))
    first, last = F.coalesce(start.cast("long"), F.lit(1).cast("long")), stop.cast("long")
    away = ((first > last) & (by > 0)) | ((first < last) & (by < 0))
    return F.when(away, F.array().cast("array<long>")).otherwise(
        # where it points away the bounds are replaced, since both branches may be evaluated
        F.sequence(first, F.when(away, first).otherwise(last), by)
    )


def series_table(spark: SparkSession, start: int, stop: int, step: int = 1, name: str = "n") -> DataFrame:
    """The same as a table of one column, generated in parallel."""
    by = step or 1
    if (start > stop and by > 0) or (start < stop and by < 0):
        return spark.range(0).toDF(name)
    return spark.range(start, stop + (1 if by > 0 else -1), by).toDF(name)
