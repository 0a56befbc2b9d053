"""Model bundles: a Spark ML pipeline plus one metadata row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

METADATA = "model_version string, columns array<string>, defaults map<string,double>, val_auc double, n_train bigint, can_score boolean"


@dataclass(frozen=True)
class ModelBundle:
    """A scorer, its input columns in order, defaults per column and its metrics."""

    model: PipelineModel | None
    model_version: str
    columns: tuple[str, ...]
    defaults: Mapping[str, float]
    val_auc: float | None = None
    n_train: int | None = None

    def metadata(self, spark: SparkSession) -> DataFrame:
        """The bundle's row for gates and the registry."""
        row = (
            self.model_version,
            list(self.columns),
            dict(self.defaults),
            self.val_auc,
            self.n_train,
            hasattr(self.model, "transform"),
        )
        return spark.createDataFrame([row], METADATA)


def save_bundle(bundle: ModelBundle, spark: SparkSession, path: str) -> None:
    """Write the pipeline and the metadata row."""
    bundle.model.write().overwrite().save(f"{path}/pipeline")
    bundle.metadata(spark).write.mode("overwrite").parquet(f"{path}/metadata")


def load_bundle(spark: SparkSession, path: str) -> ModelBundle:
    """A stored bundle."""
    row = spark.read.parquet(f"{path}/metadata").head()
    model = PipelineModel.load(f"{path}/pipeline")
    return ModelBundle(model, row.model_version, tuple(row.columns), dict(row.defaults), row.val_auc, row.n_train)


def numeric_defaults(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Approximate medians of the training columns, the defaults of requests."""
    medians = df.approxQuantile(list(columns), [0.5], 0.001)
    return {c: m[0] for c, m in zip(columns, medians, strict=True) if m}
