import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.operators.compare import compare
from tidegauge.operators.gate import evaluate_gates
from tidegauge.operators.profile import build_profile
from tidegauge.operators.sampling import row_hash
from tidegauge.operators.scoring import fit_probe, importance, score, score_external
from tidegauge.sources import tables
from tidegauge.sources.models import METADATA, ModelBundle, load_bundle, numeric_defaults, save_bundle


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    data = pd.DataFrame({"id": range(2000), "x": rng.normal(size=2000), "y": rng.normal(size=2000), "pred": rng.random(2000)})
    data["label"] = (data.x + 0.3 * rng.normal(size=2000) > 0).astype(int)
    return spark.createDataFrame(data).withColumn("h", row_hash(1, "id"))


def test_profile_survives_storage(spark, rows, tmp_path):
    profile = build_profile(rows, ["x", "y"], "pred", "h", cap=700)
    path = str(tmp_path / "profiles")
    tables.save_profile(profile, path, "v1")
    tables.save_profile(build_profile(rows, ["y"], "pred", "h"), path, "v2")
    tables.save_profile(profile, path, "v1")
    loaded = tables.load_profile(spark, path, "v1", cap=700)
    assert loaded.monitored == ("x", "y")
    batch = rows.withColumn("x", F.col("x") + 0.2)
    expected = compare(batch, profile, "pred").orderBy("slot").toPandas()
    pd.testing.assert_frame_equal(compare(batch, loaded, "pred").orderBy("slot").toPandas(), expected)
    assert tables.load_profile(spark, path, "v2").monitored == ("y",)
    with pytest.raises(FileNotFoundError):
        tables.load_profile(spark, path, "v3")
    with pytest.raises(FileNotFoundError):
        tables.load_profile(spark, str(tmp_path / "none"))


def test_a_large_profile_is_compared_as_it_was_stored(spark, tmp_path):
    """More values than the default cap: nothing but the path is needed to read them all."""
    rng = np.random.default_rng(3)
    values = pd.DataFrame({"id": range(120_000), "x": rng.normal(size=120_000)})
    base = spark.createDataFrame(values).withColumn("h", row_hash(1, "id")).withColumn("pred", F.lit(0.5))
    path = str(tmp_path / "profiles")
    tables.save_profile(build_profile(base, ["x"], "pred", "h", cap=120_000, bins=20), path)
    loaded = tables.load_profile(spark, path)
    assert (loaded.cap, loaded.bins) == (120_000, 20)
    live = rng.normal(size=5000)
    row = compare(spark.createDataFrame(pd.DataFrame({"x": live})), loaded).where("feature = 'x'").first()
    both = np.sort(np.concatenate([values.x, live]))
    steps = [np.searchsorted(np.sort(v), both, side="right") / len(v) for v in (values.x, live)]
    assert row.n_ref == 120_000
    assert row.ks_stat == pytest.approx(np.abs(steps[0] - steps[1]).max(), abs=1e-9)
    with pytest.raises(ValueError, match="made with cap 120000 and 20 bins"):
        tables.load_profile(spark, path, cap=20_000)


def test_log_appends_and_reads_back(spark, rows, tmp_path):
    profile = build_profile(rows, ["x", "not_there"][:1], "pred", "h")
    path = str(tmp_path / "log")
    scored = rows.withColumns({"ts": F.lit(1_700_000_000.25), "model_version": F.lit("v1")})
    tables.append_log(scored, None, path)
    assert tables.read_if_present(spark, path, "json") is None
    tables.append_log(scored.limit(3), profile, path)
    tables.append_log(scored.limit(2), profile, path)
    log = tables.read_log(spark, path, profile.monitored)
    assert log.count() == 5 and log.columns == ["ts", "pred", "model_version", "x"]
    assert log.first().ts.timestamp() == 1_700_000_000.25


def test_reports(spark, tmp_path):
    path = str(tmp_path / "report")
    assert tables.read_report(spark, path) is None
    report = spark.createDataFrame([("a", 0.5, ["r1", "r2"])], "scenario string, share double, reasons array<string>")
    tables.write_report(report, path)
    tables.write_report(report, path)
    assert [tuple(r) for r in tables.read_report(spark, path, "scenario string, share double, reasons string").collect()] == [("a", 0.5, "r1; r2")]


def test_first_rows_of_a_csv(spark, tmp_path):
    tx = spark.createDataFrame([(i, float(i)) for i in (5, 3, 1, 4, 2)], "TransactionID int, TransactionAmt double")
    people = spark.createDataFrame([(1, 9.0)], "TransactionID int, `id-01` double")
    paths = [str(tmp_path / n) for n in ("tx", "people")]
    for df, path in zip((tx, people), paths):
        df.write.option("header", "true").csv(path)
    read = tables.read_transactions(spark, *paths, tx.schema, people.schema, rows=2)
    assert sorted((r.TransactionID, r.id_01, r.has_identity) for r in read.collect()) == [(1, 9.0, 1), (2, None, 0)]


def bundle_row(spark, **changed):
    row = {"model_version": "v1", "columns": ["a"] * 432, "defaults": {}, "val_auc": 0.9, "n_train": 590_540, "can_score": True}
    row |= changed
    return evaluate_gates(spark.createDataFrame([tuple(row.values())], METADATA))


@pytest.mark.parametrize(
    "changed,failing",
    [
        ({}, None),
        ({"val_auc": 0.60}, "val_auc_ok"),
        ({"val_auc": None}, "val_auc_ok"),
        ({"n_train": 1000}, "train_rows_ok"),
        ({"n_train": None}, "train_rows_ok"),
        ({"columns": ["a"] * 864}, "n_features_ok"),
        ({"can_score": False}, "model_loads"),
    ],
)
def test_gate_rejects(spark, changed, failing):
    row = bundle_row(spark, **changed).first()
    assert row.deployable is (failing is None)
    for check in ("val_auc_ok", "n_features_ok", "train_rows_ok", "model_loads"):
        assert row[check] is (check != failing)


def test_gate_records(spark, tmp_path):
    gated = bundle_row(spark, val_auc=0.6)
    tables.append_gate_decisions(gated, str(tmp_path / "d"))
    tables.append_gate_decisions(gated, str(tmp_path / "d"))
    tables.append_model_records(gated, str(tmp_path / "r"))
    decision = spark.read.parquet(str(tmp_path / "d"))
    assert decision.count() == 2 and decision.first().checks.val_auc_ok is False
    record = spark.read.parquet(str(tmp_path / "r")).first()
    assert record.params["n_features"] == "432" and record.tags == {"deployable": "false"}
    assert record.metrics["gate_val_auc_ok"] == 0.0 and record.metrics["val_auc"] == 0.6


def test_probe_bundle_and_external_scores(spark, rows, tmp_path):
    model = fit_probe(rows, ["x", "y"], "label", trees=3, depth=2)
    gains = {r.feature: r.gain for r in importance(model, ["x", "y"], rows).collect()}
    assert gains["x"] > gains["y"]
    defaults = numeric_defaults(rows, ["x", "y"])
    save_bundle(ModelBundle(model, "v1", ("x", "y"), defaults, 0.9, 2000), spark, str(tmp_path / "b"))
    loaded = load_bundle(spark, str(tmp_path / "b"))
    assert loaded.columns == ("x", "y") and loaded.metadata(spark).first().can_score
    unscored = rows.drop("pred")
    first = score(unscored, model).orderBy("id").toPandas()
    second = score(unscored, loaded.model).orderBy("id").toPandas()
    assert first.pred.tolist() == second.pred.tolist() and first.pred.between(0, 1).all()
    assert first.columns.tolist() == [*unscored.columns, "pred"]
    external = score_external(unscored, ["x"], lambda: lambda frame: 1 / (1 + np.exp(-frame["x"])))
    assert np.allclose(external.toPandas().sort_values("id").pred, 1 / (1 + np.exp(-first.x)))
