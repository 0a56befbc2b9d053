"""Promotion gate over model metadata rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.settings import GateSettings

CHECKS = ("val_auc_ok", "n_features_ok", "train_rows_ok", "model_loads")


def evaluate_gates(models: DataFrame, settings: GateSettings = GateSettings()) -> DataFrame:
    """Add the four checks and ``deployable`` to models (``columns``, val_auc, n_train, can_score).

    A missing metric counts as 0.
    """
    return models.withColumns(
        {
            "val_auc_ok": F.coalesce("val_auc", F.lit(0.0)) >= settings.min_val_auc,
            "n_features_ok": F.size("columns") <= settings.max_n_features,
            "train_rows_ok": F.coalesce("n_train", F.lit(0)) >= settings.min_train_rows,
            "model_loads": F.coalesce("can_score", F.lit(False)),
        }
    ).withColumn("deployable", F.col(CHECKS[0]) & F.col(CHECKS[1]) & F.col(CHECKS[2]) & F.col(CHECKS[3]))
