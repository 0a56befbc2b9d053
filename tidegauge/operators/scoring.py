"""Scoring with Spark ML pipelines or other models, and the probe model."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions.missing import quoted
from tidegauge.session import working_folder
from tidegauge.settings import SEED

CHECKPOINT_TREES = 20


def score(df: DataFrame, model: PipelineModel, into: str = "pred") -> DataFrame:
    """Add the positive class's probability from a fitted pipeline."""
    scored = model.transform(df).withColumn(into, vector_to_array("probability").getItem(1))
    return scored.select(*df.columns, into)


def score_external(
    df: DataFrame, features: Sequence[str], load: Callable[[], Callable[[pd.DataFrame], pd.Series]], into: str = "pred"
) -> DataFrame:
    """Add probabilities from a model Spark does not know.

    ``load`` runs once per task and returns a function from a frame of
    ``features`` to probabilities; rows reach it in Arrow batches.
    """
    features = list(features)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = load()
        for batch in batches:
            yield batch.assign(**{into: predict(batch[features])})

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField(into, T.DoubleType())]))


def fit_probe(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    trees: int = 400,
    depth: int = 6,
    seed: int = SEED,
    columns_share: float = 0.7,
) -> PipelineModel:
    """Gradient-boosted trees on ``df``; missing values are passed on as NaN.

    Each split looks at a random ``columns_share`` of the columns. Every few trees the
    lineage of the boosting is cut by a checkpoint in the shared folder, so a lost executor
    does not send hundreds of trees back to the start. The training reads its rows several
    times, so what it uses of them is cached, in memory or on disk, until it ends.
    """
    working_folder(df.sparkSession)
    # Fixed values of the probe model's training.
    booster = GBTClassifier(
        featuresCol="_features",
        labelCol=label,
        maxIter=trees,
        stepSize=0.05,
        maxDepth=depth,
        subsamplingRate=0.8,
        minInstancesPerNode=50,
        featureSubsetStrategy=str(float(columns_share)),
        checkpointInterval=CHECKPOINT_TREES,
        seed=seed,
    )
    assembler = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="keep")
    rows = df.select(*[F.col(quoted(f)) for f in features], F.col(quoted(label)).cast("double").alias(label)).persist()
    try:
        return Pipeline(stages=[assembler, booster]).fit(rows)
    finally:
        rows.unpersist()


def importance(model: PipelineModel, features: Sequence[str], df: DataFrame) -> DataFrame:
    """One row per model column: feature, gain, position. ``df`` only lends its session."""
    gains = model.stages[-1].featureImportances.toArray()
    rows = [(f, float(g), i) for i, (f, g) in enumerate(zip(features, gains, strict=True))]
    return df.sparkSession.createDataFrame(rows, "feature string, gain double, position int")
