"""ML-ready matrix from a labelled sample."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse import schemas as S
from fleetpulse.functions.scalars import binary_label
from fleetpulse.operators.prep import MODEL_AND_WEEKDAY, drop_redundant, feature_part, one_hot
from fleetpulse.sources.tables import normalise_sample

CARRIED = ["mac", "day_0", "seq_id"]


def training_columns(
    sample: DataFrame, model_ids: Mapping[str, int] = S.MODEL_IDS, drop_healthy_days: bool = True
) -> DataFrame:
    """Row keys, ``label`` and every model input: one-hot categories, redundant features dropped."""
    clean = normalise_sample(sample, model_ids, drop_healthy_days)
    kept = [c for c in CARRIED if c in clean.columns]
    labelled = clean.withColumn("label", binary_label("milestone_name"))
    features = feature_part(labelled).columns
    return drop_redundant(one_hot(labelled.select(*kept, *features), MODEL_AND_WEEKDAY))


def as_vectors(columns: DataFrame) -> DataFrame:
    """Adds ``features``, a vector of every input (NULL becomes NaN)."""
    inputs = [c for c in columns.columns if c not in [*CARRIED, "label"]]
    kept = [c for c in columns.columns if c in [*CARRIED, "label"]]
    wide = columns.select(*kept, *[F.col(c).cast("double").alias(c) for c in inputs])
    return VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep").transform(wide).select(*kept, "features")
