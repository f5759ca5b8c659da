"""A corpus pipeline of five stages; each is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fleetpulse.llm import decontamination, jaccard, mixing, quality, sharding
from fleetpulse.llm.store import stage

# Fitted keys, near-duplicate search and the Hilbert curve have no counterpart in SQL.
ORACLE_SQL = None

# The base rule ends at 300 permille of repeated words; with 50 the fence of a group without repeats is at 150.
RULES = quality.Rules(least_spread=(("repeat_permille", 50),))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and their group's thresholds."""
    return quality.quality_verdicts(docs, RULES).where("kept").select("row.*")


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates."""
    return jaccard.one_of_each(docs, jaccard.jaccard_links(docs))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not hold benchmark passages."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.contamination(docs, items).where("NOT contaminated").select("row.*")


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it."""
    return mixing.copies(mixing.mixed(docs))


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix with the shard and slot of each document."""
    return sharding.sharded(docs).select("row.*", "shard", "slot")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", good_quality),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", decontaminated),
    ("mixing", mixed_sources),
    ("sharding", sharded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
