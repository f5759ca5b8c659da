"""Tables written between the steps of one operator, and prefix sums that no key can overload."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.session import new_table_path

MARKS = 23

__all__ = ["Staged", "likely", "prefix_sums", "stage"]


class Staged:
    """A frame written to the shared folder: lineage ends here, and ``discard`` frees the disk."""

    def __init__(self, df: DataFrame, name: str) -> None:
        self._spark, self.path = df.sparkSession, new_table_path(df.sparkSession, name)
        df.write.parquet(self.path)
        self.df = self._spark.read.schema(df.schema).parquet(self.path)

    @classmethod
    def of(cls, other: Staged, df: DataFrame) -> Staged:
        """The same files seen through another frame."""
        new = cls.__new__(cls)
        new._spark, new.path, new.df = other._spark, other.path, df
        return new

    def discard(self) -> None:
        """Delete the files once no plan reads them any more."""
        path = self._spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write and read back. A later join sees the true size, so a small table is broadcast only
    when it is below ``spark.sql.autoBroadcastJoinThreshold`` and is shuffled otherwise."""
    return Staged(df, name).df


def prefix_sums(
    df: DataFrame, group: Sequence[str], bucket: Sequence[str], order: Sequence[Column], value: str, out: str, total: str
) -> DataFrame:
    """Add ``out``, the sum of ``value`` over all earlier rows of the same group, and ``total``, the group's sum.

    Rows are ordered by the ``bucket`` columns and then by ``order``. Each bucket is sorted on its
    own, and buckets are offset by a running total over the small table of bucket sums, so a group
    with most of the rows is spread over its buckets. No column may hold nulls in ``group`` or
    ``bucket``. Both sides of the join are partitioned by the bucket already.
    """
    keys = [*group, *bucket]
    before = Window.partitionBy(*group).orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*keys).agg(F.sum(value).alias("__bucket_sum"))
        .select(*keys, F.coalesce(F.sum("__bucket_sum").over(before), F.lit(0)).alias("__bucket_offset"),
                F.sum("__bucket_sum").over(Window.partitionBy(*group)).alias(total))
    )
    inner = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    running = df.withColumn("__in_bucket", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return running.join(offsets, keys).withColumn(out, F.col("__bucket_offset") + F.col("__in_bucket")).drop("__bucket_offset", "__in_bucket")


def likely(df: DataFrame, value: Column, members: DataFrame, member: Column, name: str = "likely") -> DataFrame:
    """Add ``name``: false for rows whose long ``value`` is certainly none of the ``member`` values.

    Hashes mark ``2 ** MARKS`` bits, kept in at most ``2 ** (MARKS - 6)`` rows of two longs whatever the data,
    which is small enough to broadcast. With very many members most bits are set and the flag spares
    nothing; it never loses a row, and an exact join follows it.
    """
    spot = lambda v: F.xxhash64(v).bitwiseAND(2**MARKS - 1)
    marks = members.select(spot(member).alias("__h")).select(
        F.expr("shiftright(__h, 6)").alias("__word"), F.expr("shiftleft(1L, cast(__h & 63 as int))").alias("__bit"))
    marks = marks.groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    df = df.withColumn("__h", spot(value)).withColumn("__word", F.expr("shiftright(__h, 6)"))
    joined = df.join(F.broadcast(marks), "__word", "left")
    seen = F.expr("coalesce(shiftrightunsigned(__bits, cast(__h & 63 as int)) & 1, 0) = 1")
    return joined.withColumn(name, seen).drop("__h", "__word", "__bits")
