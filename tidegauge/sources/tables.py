"""Reading and writing the tables around a monitor, as Parquet, CSV or JSON lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from tidegauge.operators.features import attach_identity
from tidegauge.operators.profile import Profile, profile_from_samples
from tidegauge.settings import MODEL_VERSION, GateSettings


def read_transactions(
    spark: SparkSession,
    transactions: str,
    identity: str,
    transaction_schema: T.StructType | str,
    identity_schema: T.StructType | str,
    key: str = "TransactionID",
    rows: int | None = None,
    order: Sequence[str] = (),
) -> DataFrame:
    """Transactions joined with their identity rows, both from CSV with a header.

    Schemas are explicit, so the files are read once. ``rows`` keeps the first
    rows in ``order``; the identity file is always read whole.
    """
    tx = spark.read.schema(transaction_schema).csv(transactions, header=True)
    if rows is not None:
        tx = tx.orderBy(*(order or (key,))).limit(rows)
    return attach_identity(tx, spark.read.schema(identity_schema).csv(identity, header=True), key)


def save_profile(profile: Profile, path: str, model_version: str = MODEL_VERSION) -> None:
    """Store a profile; only this model version's partition is replaced.

    Samples and what they were drawn with (cap and bins) lie in one row per feature, so
    a reader never sees the parts of two profiles.
    """
    values = profile.samples.groupBy("slot").agg(F.collect_list("value").alias("values"))
    rows = profile.table.select("slot", "feature", "n_rows", "null_rate", "mean").join(values, "slot", "left")
    stored = {"cap": F.lit(profile.cap), "bins": F.lit(profile.bins), "model_version": F.lit(model_version)}
    _replace_partition(rows.withColumns(stored), f"{path}/profile")


def load_profile(
    spark: SparkSession, path: str, model_version: str = MODEL_VERSION, cap: int | None = None, bins: int | None = None
) -> Profile:
    """A stored profile, with the cap and bins it was made with.

    Raises FileNotFoundError if the version has none, and ValueError if ``cap`` or
    ``bins`` are given and differ from what is stored, or if the stored samples do not
    fit the stored cap.
    """
    found = read_if_present(spark, f"{path}/profile")
    if found is None:
        raise FileNotFoundError(f"no profile under {path}")
    rows = found.where(F.col("model_version") == model_version)
    # A profile monitors a few dozen features.
    known = rows.orderBy("slot").select("feature", "cap", "bins", F.coalesce(F.size("values"), F.lit(0)).alias("n")).collect()
    if not known:
        raise FileNotFoundError(f"no profile of {model_version} under {path}")
    made_with = {(r["cap"], r["bins"]) for r in known}
    if len(made_with) > 1 or max(r["n"] for r in known) > known[0]["cap"]:
        raise ValueError(f"the profile of {model_version} under {path} does not fit its own cap and bins")
    ((stored_cap, stored_bins),) = made_with
    if (cap or stored_cap, bins or stored_bins) != (stored_cap, stored_bins):
        raise ValueError(f"the profile was made with cap {stored_cap} and {stored_bins} bins, not {cap} and {bins}")
    features = rows.select("slot", "feature", "n_rows", "null_rate", "mean")
    samples = rows.select("slot", F.explode("values").alias("value"))
    names = [r["feature"] for r in known]
    return profile_from_samples(names[:-1], features, samples, cap=stored_cap, bins=stored_bins)


def _replace_partition(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model_version").parquet(path)


def log_columns(df: DataFrame, monitored: Sequence[str]) -> DataFrame:
    """Prediction-log records: ts, pred, model_version and the monitored columns present."""
    present = set(df.columns)
    return df.select("ts", "pred", "model_version", *[F.col(c).cast("double").alias(c) for c in monitored if c in present])


def append_log(df: DataFrame, profile: Profile | None, path: str) -> None:
    """Append scored rows to the prediction log; without a profile nothing is logged."""
    if profile is not None:
        log_columns(df, profile.monitored).write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, monitored: Sequence[str]) -> DataFrame:
    """The prediction log, with ``ts`` (epoch seconds) as a timestamp."""
    fields = ["ts double", "pred double", "model_version string", *[f"`{c}` double" for c in monitored]]
    raw = spark.read.schema(", ".join(fields)).json(path)
    return raw.withColumn("ts", F.timestamp_seconds("ts"))


def service_counters(log: DataFrame, columns: Sequence[str], profile: Profile | None) -> DataFrame:
    """Per model version: requests served, model columns and monitored features (0 without a profile)."""
    return log.groupBy("model_version").agg(
        F.count(F.lit(1)).alias("requests_served"),
        F.lit(len(columns)).alias("n_features"),
        F.lit(len(profile.monitored) if profile else 0).alias("monitored_features"),
    )


def write_report(df: DataFrame, path: str, format_: str = "csv") -> None:
    """Replace a report. Arrays become text in CSV, which has no arrays."""
    flat = df
    if format_ == "csv":
        arrays = [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType)]
        flat = df.withColumns({c: F.array_join(F.col(c), "; ") for c in arrays}) if arrays else df
    flat.write.mode("overwrite").format(format_).option("header", "true").save(path)


def read_report(spark: SparkSession, path: str, schema: T.StructType | str | None = None, format_: str = "csv") -> DataFrame | None:
    """A report, or None if it has not been written."""
    return read_if_present(spark, path, format_, schema)


def read_if_present(
    spark: SparkSession, path: str, format_: str = "parquet", schema: T.StructType | str | None = None
) -> DataFrame | None:
    """The table at ``path``, or None if there is none."""
    reader = spark.read.format(format_).option("header", "true")
    try:
        return (reader.schema(schema) if schema is not None else reader).load(path)
    except AnalysisException as missing:
        if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def append_gate_decisions(gated: DataFrame, path: str) -> None:
    """Append one decision per model: deployable, the checks by name, model_version."""
    checks = ["val_auc_ok", "n_features_ok", "train_rows_ok", "model_loads"]
    gated.select("deployable", F.struct(*checks).alias("checks"), "model_version").write.mode("append").parquet(path)


def append_model_records(gated: DataFrame, path: str, settings: GateSettings = GateSettings()) -> None:
    """Append each gated model's parameters, metrics and tags as maps."""
    model_record(gated, settings).write.mode("append").parquet(path)


def model_record(gated: DataFrame, settings: GateSettings = GateSettings()) -> DataFrame:
    """Registry rows of gated models: model_version, params, metrics, tags."""

    def entries(pairs: dict[str, Column]) -> Column:
        flat = [x for name, value in pairs.items() for x in (F.lit(name), value)]
        return F.create_map(*flat)

    checks = ["val_auc_ok", "n_features_ok", "train_rows_ok", "model_loads"]
    params = {
        "model_version": F.col("model_version"),
        "n_features": F.size("columns").cast("string"),
        "n_train_rows": F.col("n_train").cast("string"),
        "min_val_auc": F.lit(str(settings.min_val_auc)),
        "max_n_features": F.lit(str(settings.max_n_features)),
        "min_train_rows": F.lit(str(settings.min_train_rows)),
    }
    metrics = {"val_auc": F.coalesce("val_auc", F.lit(0.0))} | {f"gate_{c}": F.col(c).cast("double") for c in checks}
    tags = {"deployable": F.col("deployable").cast("string")}
    return gated.select(
        "model_version", entries(params).alias("params"), entries(metrics).alias("metrics"), entries(tags).alias("tags")
    )
