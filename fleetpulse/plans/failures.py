"""Failure labels of every day, and the labelled training sample."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.functions.scalars import hash_unit, stable_hash
from fleetpulse.operators.labels import (
    confirmed_devices,
    device_labels,
    devices_of_accounts,
    flow_milestones,
    match_interactions,
    session_details,
    session_success,
    starting_milestones,
)


def failing_sessions(
    milestones: DataFrame, sessions: DataFrame, cases: DataFrame, interactions: DataFrame, day: date | None = None,
) -> DataFrame:
    """Session details that were resolved the first time (within 7 days), with their flags.

    ``day`` restricts to the milestones of one day; their label day is the day before.
    """
    starts = starting_milestones(flow_milestones(milestones, day=day))
    details = session_details(starts, sessions, cases)
    success = session_success(match_interactions(details, interactions)).where("flg_ftr_7d_flg = 1")
    return confirmed_devices(details, success)


def failing_devices(
    milestones: DataFrame, sessions: DataFrame, cases: DataFrame,
    interactions: DataFrame, nodes: DataFrame, day: date | None = None,
) -> DataFrame:
    """Devices of the accounts of ``failing_sessions``; sessions are confirmed before devices multiply them."""
    return devices_of_accounts(failing_sessions(milestones, sessions, cases, interactions, day), nodes)


def labelled_vectors(vectors: DataFrame, failing: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each vector once per failing session of its device's account on its day, with ``milestone_name``.

    The labels travel counted; equal ones are spread out behind the join.
    """
    found = vectors.join(device_labels(failing, nodes), ["mac", "day_0"])
    return found.withColumn("_i", F.explode(F.sequence(F.lit(1), "n"))).select(*vectors.columns, "milestone_name")


def random_ids(draws: DataFrame, upper: Column, seed: int = 0, draw: str = "i") -> DataFrame:
    """Distinct ids in 0..upper, one uniform draw per row of ``draws``; collisions merge."""
    u = hash_unit(stable_hash(draw, seed=seed))
    return draws.select(F.floor(u * upper + 0.5).alias("seq_id")).distinct()


def labelled_sample(
    vectors: DataFrame, failing: DataFrame, draws: DataFrame, seed: int = 0, exclude_positives: bool = False
) -> DataFrame:
    """Random healthy vectors plus every failing one, with ``milestone_name`` (NULL if healthy).

    As the source does, a failing vector that is also drawn appears twice, once unlabelled;
    ``exclude_positives`` leaves the unlabelled copy out.
    """
    top = vectors.agg(F.max("seq_id").alias("m")).scalar()
    drawn = vectors.join(random_ids(draws, top, seed), "seq_id", "left_semi")
    labels = failing.select("day_0", "mac", "milestone_name")
    if exclude_positives:
        drawn = drawn.join(labels, ["day_0", "mac"], "left_anti")
    healthy = drawn.withColumn("milestone_name", F.lit(None).cast("string"))
    sick = vectors.join(labels, ["day_0", "mac"]).select(*healthy.columns)
    # ids are unique, so distinct (id, label) pairs are distinct rows
    return healthy.unionByName(sick.dropDuplicates(["seq_id", "milestone_name"]))
