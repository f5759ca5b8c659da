"""The day-by-day incremental run: rolling buffers on shared storage, with their checks.

One call per day reads only that day's hours (plus the bounded buffers), so its cost does
not depend on how much history exists. Buffers are day-partitioned Parquet tables; a day is
replaced by dynamic partition overwrite, so a run repeated after a lost executor or driver
leaves the same state. ``daily_run`` is the whole run of a day: guards, log, vector and label
branches, and retention.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.operators import checks
from fleetpulse.operators.windows import day_differences_by_pivot, day_means
from fleetpulse.plans.failures import failing_devices
from fleetpulse.plans.vectors import daily_vectors, five_day_vector, numbered
from fleetpulse.sources.sinks import counted, drop_days_before, log_lines, overwrite_days

# --- fixed values: days kept in each rolling buffer ------------------------------------------
KEEP_DAYS = {"vector": 1, "daily": 2, "diffs": 5}
LABEL_LAG_DAYS = 8  # labels of a day are complete once its sessions had a week to come back
# ---------------------------------------------------------------------------------------------
Inputs = Mapping[str, DataFrame]


def _read_if_present(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):  # no folder, or no rows in it yet
            raise
        return None


def read_buffer(spark: SparkSession, root: str, name: str, day_0: date) -> DataFrame:
    """The kept days of a buffer as of ``day_0``; older partitions are never read."""
    floor = day_0 - timedelta(days=KEEP_DAYS[name])
    return spark.read.parquet(f"{root}/{name}").where(
        (F.col("day_0") > F.lit(floor)) & (F.col("day_0") <= F.lit(day_0))
    )


def daily_step(spark: SparkSession, root: str, inputs: Inputs, day_0: date) -> dict[str, int]:
    """Vector, daily means and day differences of one day, written to the buffers; the rows of each.

    Rows are counted by the writing tasks. A day without a vector, or without means or differences of its
    vectors, is refused.
    """
    vector = daily_vectors(
        inputs["health_hour"], inputs["topo_nodes"], inputs["group_history"],
        inputs["ifc_up_hour"], inputs["ifc_down_hour"], inputs["ifc_to_group"], day_0,
    )
    rows = {"vector": counted(overwrite_days, vector, f"{root}/vector")["n_rows"]}
    checks.require(checks.written_rows(spark, {"vector": (rows["vector"], True)}), f"no vector of {day_0}")
    today = read_buffer(spark, root, "vector", day_0)
    rows["daily"] = counted(overwrite_days, day_means(today), f"{root}/daily")["n_rows"]
    daily = read_buffer(spark, root, "daily", day_0)
    rows["diffs"] = counted(overwrite_days, day_differences_by_pivot(daily, day_0), f"{root}/diffs")["n_rows"]
    checks.require(checks.written_rows(spark, {n: (k, True) for n, k in rows.items()}), f"a table of {day_0} has no rows")
    return rows


def assemble_step(spark: SparkSession, root: str, day_0: date) -> int:
    """Five-day vector of one day, appended with ids after the highest so far; the number of rows."""
    buffers = {n: read_buffer(spark, root, n, day_0) for n in KEEP_DAYS}
    checks.require(checks.buffer_state(buffers, day_0), "buffers are not at the processed day")
    target = f"{root}/five_day"
    start = 0
    done = _read_if_present(spark, target)
    if done is not None:
        checks.require(checks.day_absent(done, day_0), "the day was already assembled")
        # ids grow with the days, so the newest partition has the highest
        newest = done.agg(F.max("day_0")).first()[0]
        start = done.where(F.col("day_0") == F.lit(newest)).agg(F.max("seq_id")).first()[0] or 0
    # numbering reads its input twice, so the assembled rows are written first
    staged = f"{root}/five_day_staged"
    overwrite_days(five_day_vector(buffers["vector"], buffers["daily"], buffers["diffs"], day_0), staged)
    rows = spark.read.parquet(staged).where(F.col("day_0") == F.lit(day_0))
    n = counted(overwrite_days, numbered(rows, start), target)["n_rows"]
    checks.require(checks.inserted(spark, n), f"no five-day vector of {day_0}")
    drop_days_before(spark, staged, day_0 + timedelta(days=1))
    return n


def label_step(spark: SparkSession, root: str, inputs: Inputs, day_0: date) -> int:
    """Label the stored vectors of ``day_0 - LABEL_LAG_DAYS``; the number of labelled vectors.

    Writes the failing devices of that day and their labelled vectors. Without vectors of that day
    there is nothing to label. A day that was labelled before is replaced, not added to.
    """
    day = day_0 - timedelta(days=LABEL_LAG_DAYS)
    vectors = _read_if_present(spark, f"{root}/five_day")
    if vectors is None or vectors.where(F.col("day_0") == F.lit(day)).isEmpty():
        return 0
    failing = failing_devices(
        inputs["milestones"], inputs["sessions"], inputs["cases"], inputs["interactions"], inputs["topo_nodes"],
        day + timedelta(days=1),
    )
    overwrite_days(failing.where(F.col("day_0") == F.lit(day)), f"{root}/failing")
    stored = _read_if_present(spark, f"{root}/failing")
    if stored is None:
        return 0
    labels = stored.where(F.col("day_0") == F.lit(day)).select("day_0", "mac", "milestone_name").distinct()
    n = counted(overwrite_days, vectors.join(labels, ["day_0", "mac"]), f"{root}/labelled")["n_rows"]
    if n == 0 and not labels.join(vectors, ["day_0", "mac"], "left_semi").isEmpty():
        raise checks.CheckFailed(f"no vector of {day} was labelled")
    return n


def retain(spark: SparkSession, root: str, day_0: date) -> None:
    """Delete the buffers' partitions that no later run reads."""
    for name, keep in KEEP_DAYS.items():
        drop_days_before(spark, f"{root}/{name}", day_0 - timedelta(days=keep - 1))


def daily_run(spark: SparkSession, root: str, inputs: Inputs, day_0: date, assemble: bool = True) -> None:
    """The whole run of one day.

    Refuses to start while the newest log line is not that of a finished run, except that the same day
    may be repeated after a failure. Then: vector, means and differences of the day; with ``assemble``
    the five-day vector (not while a back-fill still fills the buffers) and the labels of the day whose
    labels are due; retention on disk; and a closing log line. A failure is logged as an error and raised.
    """
    log_path = f"{root}/run_log"
    log = _read_if_present(spark, log_path)
    if log is not None:
        last = log.orderBy(F.col("log_date").desc(), F.col("is_done").desc()).first()
        if last is not None and last["is_done"] != 1 and not last["log_text"].startswith(f"{day_0}:"):
            raise checks.CheckFailed(f"the last run did not finish: {last['log_text']}")

    def say(text: str, is_error: int = 0, is_done: int = 0) -> None:
        line = spark.createDataFrame([(f"{day_0}: {text}", is_error, is_done)], "log_text string, is_error int, is_done int")
        log_lines(line, log_path)

    say("run started")
    try:
        written = daily_step(spark, root, inputs, day_0)
        say("vector, means and differences written: " + ", ".join(f"{n} {k}" for n, k in written.items()))
        if assemble:
            stored = _read_if_present(spark, f"{root}/five_day")
            if stored is not None and not stored.where(F.col("day_0") == F.lit(day_0)).isEmpty():
                say("five-day vectors were there already")
            else:
                say(f"{assemble_step(spark, root, day_0)} five-day vectors written")
            say(f"{label_step(spark, root, inputs, day_0)} vectors labelled")
        retain(spark, root, day_0)
    except Exception as e:
        say(f"failed: {e}", is_error=1)
        raise
    say("run finished", is_done=1)


def backfill(spark: SparkSession, root: str, inputs: Inputs, days: list[date]) -> DataFrame:
    """Run consecutive days; the five-day vectors are assembled from the last one on."""
    for day_0 in days:
        daily_step(spark, root, inputs, day_0)
    assemble_step(spark, root, days[-1])
    return spark.read.parquet(f"{root}/five_day")
