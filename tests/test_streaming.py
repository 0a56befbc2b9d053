import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.operators.compare import compare, verdict
from tidegauge.operators.profile import build_profile
from tidegauge.operators.sampling import row_hash
from tidegauge.streaming import monitor


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    """A log in six files, so that a stream reads it in several micro-batches."""
    rng = np.random.default_rng(0)
    n = 3000
    data = pd.DataFrame(
        {
            "id": range(n),
            "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 4 * 86400, n), unit="s"),
            "TransactionAmt": rng.normal(500, 200, n),
            "k": rng.normal(size=n) + np.arange(n) / 3000,
            "pred": rng.random(n),
        }
    )
    path = str(tmp_path_factory.mktemp("log") / "rows")
    spark.createDataFrame(data).repartition(6).write.parquet(path)
    return path


@pytest.fixture(scope="module")
def profile(spark, log):
    rows = spark.read.parquet(log).withColumn("h", row_hash(1, "id"))
    return build_profile(rows.where("id < 1500"), ["k"], "pred", "h").checkpoint()


def stream(spark, log):
    schema = spark.read.parquet(log).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(log)


def finish(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def test_windowed_cells_give_the_batch_result(spark, log, profile, tmp_path):
    cells = monitor.windowed_cells(stream(spark, log), profile, "ts", "1 day", "5 days", "pred")
    finish(monitor.updating_sink(cells, str(tmp_path / "rows"), str(tmp_path / "state")))
    stored = spark.read.parquet(str(tmp_path / "rows"))
    assert stored.select("batch_id").distinct().count() > 1
    found = monitor.windowed_verdicts(monitor.latest(stored, ["window_start", "slot", "cell"]), profile)
    batch = spark.read.parquet(log).withColumn("window_start", F.date_trunc("day", "ts"))
    expected = verdict(compare(batch, profile, "pred", ["window_start"]), ["window_start"])
    columns = ["window_start", "n_rows", "n_flagged", "top_psi", "pred_psi", "drifted"]
    as_rows = lambda df: sorted(tuple(r) for r in df.select(columns).collect())
    assert as_rows(found) == as_rows(expected) and found.count() == 4


def test_windowed_metrics(spark, log, tmp_path):
    metrics = monitor.windowed_metrics(stream(spark, log), "ts", "1 day", "5 days", F.col("pred"), F.col("k") > 1)
    finish(monitor.updating_sink(metrics, str(tmp_path / "rows"), str(tmp_path / "state")))
    found = monitor.latest(spark.read.parquet(str(tmp_path / "rows")), ["window_start"]).toPandas().set_index("window_start")
    data = spark.read.parquet(log).toPandas()
    by_day = data.groupby(data.ts.dt.floor("D"))
    assert (found.n.sort_index() == by_day.size()).all()
    assert np.allclose(found.mean_value.sort_index(), by_day.pred.mean())
    assert np.allclose(found.null_rate.sort_index(), by_day.k.apply(lambda k: (k > 1).mean()))


def test_drift_per_micro_batch(spark, log, profile, tmp_path):
    finish(monitor.drift_stream(stream(spark, log), profile, str(tmp_path / "rows"), str(tmp_path / "state")))
    reports = spark.read.parquet(str(tmp_path / "rows"))
    assert reports.count() == 3 and reports.agg(F.sum("n_rows")).first()[0] == 3000


def test_scoring_splits_and_resumes(spark, log, profile, tmp_path):
    def start():
        scorer = lambda df: df.withColumn("pred", F.col("TransactionAmt") / 1000)
        requests = stream(spark, log).drop("pred").withColumn("ts", F.unix_micros("ts") / 1e6)
        paths = [str(tmp_path / n) for n in ("log", "rejects", "state")]
        finish(monitor.score_stream(requests, scorer, *paths, profile, keep=["id"]))

    start()
    data = spark.read.parquet(log).toPandas()
    logged = spark.read.parquet(str(tmp_path / "log"))
    broken = spark.read.parquet(str(tmp_path / "rejects"))
    assert sorted(r.id for r in logged.collect()) == sorted(data.id[data.TransactionAmt >= 0])
    assert sorted(r.id for r in broken.collect()) == sorted(data.id[data.TransactionAmt < 0])
    assert {"ts", "pred", "model_version", "k", "decision"} <= set(logged.columns)
    before = logged.count()
    start()
    assert spark.read.parquet(str(tmp_path / "log")).count() == before


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "sink")
    monitor.write_batch(spark.range(3), 0, path)
    monitor.write_batch(spark.range(5), 1, path)
    monitor.write_batch(spark.range(4), 0, path)
    counts = spark.read.parquet(path).groupBy("batch_id").count().collect()
    assert {r.batch_id: r["count"] for r in counts} == {0: 4, 1: 5}


def test_a_stopped_stream_goes_on_where_it_was(spark, log, profile, tmp_path):
    """Three micro-batches; the last one loses its commit and runs again after a restart, and counts once."""
    paths = str(tmp_path / "rows"), str(tmp_path / "state")

    def start():
        return finish(monitor.drift_stream(stream(spark, log), profile, *paths, time="ts"))

    assert len(start().recentProgress) >= 3
    first = {r.batch_id: r for r in spark.read.parquet(paths[0]).collect()}
    assert sorted(first) == [0, 1, 2] and all(r.first_time <= r.last_time for r in first.values())
    commit = tmp_path / "state" / "commits" / "2"
    for left in (commit, commit.with_name(".2.crc")):
        left.unlink(missing_ok=True)
    assert [p["batchId"] for p in start().recentProgress][:1] == [2]
    again = {r.batch_id: r for r in spark.read.parquet(paths[0]).collect()}
    assert {k: (r.n_rows, r.pred_psi, r.first_time) for k, r in again.items()} == {k: (r.n_rows, r.pred_psi, r.first_time) for k, r in first.items()}
    start()
    assert spark.read.parquet(paths[0]).count() == 3


@pytest.fixture()
def ordered_log(spark, tmp_path):
    """Four files in order of time, the last with some rows of the first day that come too late."""
    rng = np.random.default_rng(4)
    path = str(tmp_path / "ordered")
    for day in range(4):
        n = 200
        ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(day * 86400 + np.sort(rng.integers(0, 86400, n)), unit="s")
        data = pd.DataFrame({"ts": ts, "k": rng.normal(size=n), "pred": rng.random(n)})
        if day == 3:
            late = pd.DataFrame({"ts": pd.to_datetime(["2024-01-01 05:00:00"] * 7), "k": 0.0, "pred": 0.5})
            data = pd.concat([data, late])
        spark.createDataFrame(data).coalesce(1).write.mode("append").parquet(path)
    return path


def test_closed_windows_are_written_once(spark, ordered_log, profile, tmp_path):
    schema = spark.read.parquet(ordered_log).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(ordered_log)
    cells = monitor.windowed_cells(rows, profile, "ts", "1 day", "1 hour", "pred")
    sink = str(tmp_path / "rows")
    with monitor.rocksdb_state(spark):
        query = finish(monitor.closed_sink(cells, sink, str(tmp_path / "state")))
    assert spark.conf.get(monitor.STATE_STORE) != monitor.ROCKSDB
    stored = spark.read.parquet(sink)
    keys = ["window_start", "slot", "cell"]
    assert stored.count() == stored.select(keys).distinct().count()
    # Days one to three are closed; the late rows of day one are counted apart and change nothing.
    per_day = {r.window_start.day: r.n for r in stored.where("slot = 1").groupBy("window_start").agg(F.sum("n").alias("n")).collect()}
    assert per_day == {1: 200, 2: 200, 3: 200} and monitor.late_rows(query) > 0
    found = monitor.windowed_verdicts(stored.drop(monitor.BATCH), profile)
    batch = spark.read.parquet(ordered_log).withColumn("window_start", F.date_trunc("day", "ts"))
    batch = batch.where("window_start < '2024-01-04' AND NOT (k = 0 AND pred = 0.5)")
    expected = verdict(compare(batch, profile, "pred", ["window_start"]), ["window_start"])
    columns = ["window_start", "n_rows", "n_flagged", "top_psi", "pred_psi", "drifted"]
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(map(tuple, expected.select(columns).collect()))


def test_compaction_keeps_the_newest_rows(spark, tmp_path):
    path = str(tmp_path / "sink")
    for batch, rows in enumerate([[("a", 1), ("b", 1)], [("a", 2)], [("b", 3), ("c", 3)], [("a", 4)]]):
        monitor.write_batch(spark.createDataFrame(rows, "key string, n int"), batch, path)
    read = lambda: spark.read.parquet(path)
    before = sorted(map(tuple, monitor.latest(read(), ["key"]).collect()))
    for _ in range(2):  # once more changes nothing
        monitor.compact(spark, path, ["key"], through=2)
        assert sorted(map(tuple, monitor.latest(read(), ["key"]).collect())) == before == [("a", 4), ("b", 3), ("c", 3)]
        assert {r.batch_id: r["count"] for r in read().groupBy("batch_id").count().collect()} == {2: 3, 3: 1}
