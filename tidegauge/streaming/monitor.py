"""Scoring, logging and drift monitoring of streams.

Every sink is written per micro-batch under its batch number and replaces what
that number wrote before, so a batch that runs twice counts once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tidegauge.operators.compare import cell_counts, compare, feature_rows, missing_columns, verdict
from tidegauge.operators.contract import accepted, rejected, with_contract, with_decision
from tidegauge.operators.profile import Profile
from tidegauge.session import scratch_path
from tidegauge.settings import MODEL_VERSION, REQUEST_CONTRACT, DriftSettings, FieldRule
from tidegauge.sources.tables import log_columns

BATCH = "batch_id"


def write_batch(df: DataFrame, batch_id: int, path: str) -> None:
    """Write a micro-batch's rows, replacing an earlier attempt at the same batch."""
    df.withColumn(BATCH, F.lit(batch_id)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(BATCH).parquet(path)


def score_stream(
    requests: DataFrame,
    scorer: Callable[[DataFrame], DataFrame],
    log_path: str,
    rejects_path: str,
    checkpoint: str,
    profile: Profile | None,
    keep: Sequence[str] = (),
    rules: Sequence[FieldRule] = REQUEST_CONTRACT,
    model_version: str = MODEL_VERSION,
) -> DataStreamWriter:
    """Check, score and log requests; broken ones go to ``rejects_path`` with their violations.

    ``scorer`` adds ``pred``; ``keep`` names request columns the log keeps beside
    the monitored ones. Without a profile only rejects are written.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        checked = with_contract(batch, rules).persist()
        try:
            if profile is not None:
                scored = with_decision(scorer(accepted(checked)), "pred", model_version=model_version)
                logged = log_columns(scored, profile.monitored)
                extra = [c for c in (*keep, "decision") if c not in logged.columns]
                wide = scored.select(*[F.col(c) if c not in profile.monitored else F.col(c).cast("double").alias(c) for c in logged.columns], *extra)
                write_batch(wide, batch_id, log_path)
            write_batch(rejected(checked), batch_id, rejects_path)
        finally:
            checked.unpersist()

    return requests.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def drift_stream(
    log: DataFrame,
    profile: Profile,
    report_path: str,
    checkpoint: str,
    prediction: str = "pred",
    settings: DriftSettings = DriftSettings(),
    time: str | None = None,
) -> DataStreamWriter:
    """A drift verdict per micro-batch of the prediction log.

    With ``time``, a column of the log, a verdict also names the first and last time of
    its rows, so that reports can be told apart by their data and not by batch numbers
    alone, which start anew with a new checkpoint.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        rows = compare(batch, profile, prediction, settings=settings)
        report = verdict(rows, settings=settings, missing=missing_columns(batch, profile))
        if time is not None:
            ends = {"first_time": F.min(time), "last_time": F.max(time)}
            report = report.withColumns({name: batch.agg(end).scalar() for name, end in ends.items()})
        write_batch(report, batch_id, report_path)

    return log.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def windowed_cells(
    log: DataFrame, profile: Profile, time: str, every: str, late: str, prediction: str | None = None
) -> DataFrame:
    """Cell counts per event-time window, as a streaming aggregation.

    Cut points are frozen with the profile, so the counts of a window add up over
    micro-batches and :func:`windowed_verdicts` gives the same KS and PSI as a
    batch comparison of the whole window. State is bounded by the profile.
    """
    timed = log.withWatermark(time, late).withColumn("window", F.window(time, every))
    return cell_counts(timed, profile, prediction, ["window"]).select(
        F.col("window.start").alias("window_start"), "slot", "cell", "n", "total"
    )


def windowed_verdicts(
    cells: DataFrame, profile: Profile, settings: DriftSettings = DriftSettings(), missing: Sequence[str] = ()
) -> DataFrame:
    """Verdicts from stored cell counts: one row per window_start.

    ``missing`` lists the monitored features the log lacks (:func:`missing_columns`);
    the counts cannot tell.
    """
    by = ["window_start"]
    return verdict(feature_rows(cells, profile, by, settings), by, settings, missing)


def windowed_metrics(log: DataFrame, time: str, every: str, late: str, value: Column, missing: Column) -> DataFrame:
    """Count, mean and missing rate per event-time window."""
    return (
        log.withWatermark(time, late)
        .groupBy(F.window(time, every))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(value).alias("mean_value"),
            F.avg(missing.cast("int")).alias("null_rate"),
        )
        .select(F.col("window.start").alias("window_start"), "n", "mean_value", "null_rate")
    )


def updating_sink(df: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Keep every micro-batch's changed rows of an aggregation; read with :func:`latest`."""
    return (
        df.writeStream.outputMode("update")
        .foreachBatch(lambda batch, batch_id: write_batch(batch, batch_id, path))
        .option("checkpointLocation", checkpoint)
    )


def closed_sink(df: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Keep the rows of windows that the watermark has closed, each written once.

    The sink holds closed windows times cells and nothing else; a window that is still
    open lies in the state store, for which :func:`rocksdb_state` is meant.
    """
    return (
        df.writeStream.outputMode("append")
        .foreachBatch(lambda batch, batch_id: write_batch(batch, batch_id, path))
        .option("checkpointLocation", checkpoint)
    )


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, on disk and not on the heap.

    A stream goes on with the kind of store that its checkpoint began with.
    """
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(STATE_STORE, before)


def late_rows(query: StreamingQuery) -> int:
    """How many rows the watermark has dropped since the query was started, counted after partial aggregation."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def compact(spark: SparkSession, path: str, keys: Sequence[str], through: int) -> None:
    """Merge what micro-batches up to ``through`` wrote into one partition, the newest version of each row.

    ``through`` must be a batch that will not run again: one below the newest. The
    partition of ``through`` is replaced first and the older ones are deleted after it, so
    a reader that takes the :func:`latest` rows sees the same at any time, and an
    interrupted run is completed by the next one.
    """
    stored = spark.read.parquet(path)
    old = stored.where(F.col(BATCH) <= through)
    staged = scratch_path(spark, "compacted")
    latest(old, keys).select(*[c for c in stored.columns if c != BATCH]).write.parquet(staged)
    write_batch(spark.read.parquet(staged), through, path)
    # One row per micro-batch that is gone.
    for row in old.select(BATCH).distinct().where(F.col(BATCH) < through).collect():
        _delete(spark, f"{path}/{BATCH}={row[BATCH]}")


def _delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def latest(stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The newest version of each row an updating sink holds."""
    others = [c for c in stored.columns if c not in keys and c != BATCH]
    newest = F.max_by(F.struct(*others), BATCH).alias("_row")
    return stored.groupBy(*keys).agg(newest).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in others])
