"""Session defaults and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_root: str | None = None


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "16g") -> SparkSession:
    """A session for tests and benches on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("fleetpulse")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # the JVM never compiles methods above 8000 bytes; plans with hundreds of columns run faster
        # as split projections than inside one such method
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_folder(spark: SparkSession) -> str:
    """Folder for written tables: the cluster's ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a temporary folder; on a
    cluster a machine-local folder would not be visible to the other executors.
    """
    global _local_root
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="fleetpulse-")
    return _local_root


def new_table_path(spark: SparkSession, name: str) -> str:
    """A path inside the working folder that no earlier run has used."""
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str = "staged") -> DataFrame:
    """Write a frame to the working folder and read it back.

    Used where several fits or repeats read the same rows: the lineage is cut at a table
    every executor can read, so a lost executor does not bring back the whole plan.
    """
    path = new_table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
