"""The checks of the monitor, on small fixtures."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests import brute
from tidegauge.operators import compare as comparing
from tidegauge.operators.compare import compare
from tidegauge.operators.ordering import RowOrder, id_levels
from tidegauge.operators.profile import build_profile
from tidegauge.operators.sampling import random_halves, row_hash
from tidegauge.operators.whatif import default_scenarios
from tidegauge.plans import validation


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    n = 3000
    data = pd.DataFrame({"id": range(n), "TransactionAmt": rng.gamma(2, 60, n), "C1": rng.integers(1, 9, n) * 1.0})
    data["C13"], data["D1"], data["has_identity"] = rng.random(n) * 50, rng.random(n) * 99, rng.integers(0, 2, n)
    data["card1_freq"] = rng.integers(1, 400, n) * 1.0
    data["amt_log"] = np.log1p(data.TransactionAmt)
    data["id_01"] = np.where(data.has_identity == 1, rng.normal(size=n), np.nan)
    df = spark.createDataFrame(data).withColumn("h", row_hash(1, "id"))
    return score(df.withColumn("id_01", F.nanvl("id_01", F.lit(None).cast("double")))).checkpoint()


FEATURES = ["TransactionAmt", "amt_log", "C1", "C13", "has_identity", "card1_freq", "id_01"]


def score(df):
    return df.withColumn("pred", F.col("TransactionAmt") / (F.col("TransactionAmt") + 100))


def test_null_experiment_is_quiet_and_repeatable(spark, rows, monkeypatch):
    runs = validation.null_experiment(rows, FEATURES, "pred", ["id"], trials=3, cap=1000)
    first = sorted(tuple(r) for r in runs.collect())
    assert len(first) == 9
    assert all(r.n_flagged == 0 and not r.batch_drifted and r.n_monitored == 7 for r in runs.collect())
    # One trial per block gives the same rows.
    monkeypatch.setattr(validation, "BROADCAST_AT_MOST", 1)
    assert sorted(tuple(r) for r in validation.null_experiment(rows, FEATURES, "pred", ["id"], trials=3, cap=1000).collect()) == first
    summary = {r.correction: r for r in validation.null_summary(runs).collect()}
    assert set(summary) == {"none", "bonferroni", "bh"}
    assert summary["bonferroni"].mean_sig_corrected <= summary["none"].mean_ks_only


def test_null_experiment_statistics(spark, rows):
    halves = random_halves(rows.select("id", "C13", "pred"), ["id"], 2, 42)
    profile = build_profile(halves.where("first_half"), ["C13"], "pred", "row_hash", by=["trial"], cap=5000).checkpoint()
    found = compare(halves.where("NOT first_half"), profile, "pred", ["trial"]).where("slot = 0").collect()
    data = halves.toPandas()
    for r in found:
        part = data[data.trial == r.trial]
        a, b = part[part.first_half].C13.to_numpy(), part[~part.first_half].C13.to_numpy()
        assert r.ks_stat == pytest.approx(brute.ks(a, b)) and r.psi == pytest.approx(brute.psi(a, b))


def test_scenarios_catch_faults_and_not_controls(spark, rows):
    profile = build_profile(rows.where("id < 1500"), FEATURES, "pred", "h").checkpoint()
    live = rows.where("id >= 1500").drop("pred")
    report = {r.scenario: r for r in validation.scenario_backtest(live, profile, default_scenarios("h"), score).collect()}
    assert {s: r.caught for s, r in report.items()} == {
        "healthy (control)": False,
        "currency units bug": True,
        "new customer segment": True,
        "identity feed outage": True,
        "label shift only": False,
    }
    assert report["identity feed outage"].worst_null_feature == "id_01"
    assert report["currency units bug"].top_feature == "TransactionAmt"


def test_windows_degradation_and_correlation(spark, rows):
    labelled = rows.withColumn("label", (F.col("C1") + F.col("id") / 1000 > 5).cast("int"))
    order = RowOrder(id_levels("id"))
    base, later = validation.split_windows(labelled, order, 0.4, 4)
    assert base.count() == 1200
    assert {r.window: r["count"] for r in later.groupBy("window").count().collect()} == {i: 450 for i in range(1, 5)}
    profile = build_profile(base, FEATURES, "pred", "h").checkpoint()
    verdicts = validation.window_verdicts(later, profile, "pred").checkpoint()
    calibrated = validation.calibration(verdicts)
    summary = validation.calibration_summary(calibrated).first()
    assert summary.n_windows == 4 and summary.n_alarms == calibrated.where("would_alert").count()
    lost = validation.degradation(later, verdicts, base, "pred", "label")
    assert lost.count() == 4
    still = lost.withColumn("share_flagged", F.lit(0.0)).withColumn("pred_psi", F.col("auc_drop") * 2)
    made = validation.drift_correlations(still).first()
    assert made.corr_share_auc_drop is None and made.corr_pred_psi_auc_drop == pytest.approx(1.0)


def test_more_features_than_one_block(spark, rows, monkeypatch):
    profile = build_profile(rows, FEATURES, "pred", "h", cap=800).checkpoint()
    shifted = rows.withColumn("C13", F.col("C13") * 1.2)
    whole = compare(shifted, profile, "pred").orderBy("slot").select("slot", "ks_stat", "psi", "n_cur").collect()
    monkeypatch.setattr(comparing, "BROADCAST_AT_MOST", 3 * 8 * profile.capacity)
    assert compare(shifted, profile, "pred").orderBy("slot").select("slot", "ks_stat", "psi", "n_cur").collect() == whole


def test_exact_null_experiment_statistics(spark, rows):
    """Sums over values and edges give what comparing the halves of each trial gives."""
    from tidegauge.operators.exact import exact_compare

    trials, key = 3, ["id"]
    found = {(r.trial, r.correction): r for r in validation.exact_null_experiment(rows, FEATURES, "pred", key, trials=trials).collect()}
    assert len(found) == 9
    bits = rows.withColumn("_first", validation.half_bits(row_hash(42, *key), trials))
    for t in range(trials):
        first, second = (bits.where(F.col("_first")[t] == side) for side in (1, 0))
        assert abs(first.count() - 1500) < 150
        judged = exact_compare(first, second, FEATURES, "pred")
        features = judged.where("feature <> '__pred__'")
        for c in ("none", "bonferroni", "bh"):
            r = found[t, c]
            assert r.n_monitored == 7 and r.ks_only_flagged == features.where("sig_none").count()
            assert r.sig_corrected == features.where(f"sig_{c}").count()
            assert r.n_flagged == features.where(f"(sig_{c} AND psi >= 0.1) OR null_shift").count()


def test_exact_null_experiment_sees_unequal_halves(spark):
    """A feature that is the half itself is flagged in its trial: KS 1 and a large PSI, with many ties."""
    rows = spark.range(400).select("id", F.lit(0.5).alias("pred"), (F.col("id") % 5).cast("double").alias("tied"))
    bit = validation.half_bits(row_hash(42, "id"), 2)
    rows = rows.withColumn("leak", bit[1] * 100 + F.col("id") / 400)
    found = {(r.trial, r.correction): r for r in validation.exact_null_experiment(rows, ["tied", "leak"], "pred", ["id"], trials=2).collect()}
    assert found[1, "bh"].n_flagged == 1 and found[1, "bh"].batch_drifted and found[0, "bh"].n_flagged == 0


def test_scenarios_read_the_rows_once(spark, rows):
    stacked = validation.rewritten(rows.drop("pred"), ["TransactionAmt", "id_01", "C1"], default_scenarios("h"), score)
    plan = stacked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and "Union" not in plan
    together = {r.scenario: r for r in stacked.groupBy("scenario").agg(F.count(F.lit(1)).alias("n"), F.avg("TransactionAmt").alias("a"), F.count("id_01").alias("k"), F.avg("C1").alias("c")).collect()}
    for name, rewrite in default_scenarios("h").items():
        apart = score(rewrite(rows.drop("pred"))).agg(F.count(F.lit(1)), F.avg("TransactionAmt"), F.count("id_01"), F.avg("C1")).first()
        assert tuple(together[name])[1:] == pytest.approx(tuple(apart))


def test_reports_of_two_models(spark):
    schema = "window int, share_flagged double, pred_psi double, would_alert boolean, model_version string"
    one = spark.createDataFrame([(1, 0.0, 0.1, False, "a"), (2, 0.5, 0.3, True, "a")], schema)
    other = spark.createDataFrame([(2, 0.1, 0.2, False, "b"), (3, 0.0, 0.0, False, "b")], schema)
    made = {r.window: r for r in validation.cross_reference(one, other).collect()}
    assert (made[2].model_version, made[2].model_version_other, made[2].agreed) == ("a", "b", False)
    assert made[1].model_version_other is None and made[3].model_version is None and not made[3].agreed


def test_null_experiment_compares_halves_with_samples(spark, rows):
    """Counts of values give what comparing each trial's halves through a profile gives, with missing values."""
    from tidegauge.settings import DriftSettings

    names = ["C1", "C13", "id_01", "has_identity"]
    settings = DriftSettings(alpha=0.6, psi_moderate=0.005)
    halves = random_halves(rows.select("id", *names, "pred"), ["id"], 3, 42)
    profile = build_profile(halves.where("first_half"), names, "pred", "row_hash", by=["trial"], cap=900).checkpoint()
    apart = compare(halves.where("NOT first_half"), profile, "pred", ["trial"], settings)
    runs = validation.null_experiment(rows, names, "pred", ["id"], trials=3, cap=900, settings=settings)
    expected = sorted(tuple(r) for r in validation._outcomes(apart, settings).collect())
    assert sorted(tuple(r) for r in runs.collect()) == expected
    assert any(r[2] for r in expected) and len({r[2:5] for r in expected}) > 1


def test_null_experiment_broadcasts_no_profile(spark, rows):
    """Cut points of all trials, which grow with trials, features and the cap, are neither broadcast nor sent to the driver."""
    runs = validation.null_experiment(rows, FEATURES, "pred", ["id"], trials=3, cap=1000)
    assert "cuts" not in runs._jdf.queryExecution().executedPlan().toString()


def test_last_sampled_ends_the_sample(spark, rows):
    from tidegauge.operators.sampling import last_sampled

    found = {r.slot: r["last"] for r in last_sampled(rows, ["C1", "id_01"], "h", 700).collect()}
    kept = {0: rows.where(f"h <= '{found[0]}'").count(), 1: rows.where(f"h <= '{found[1]}' AND id_01 IS NOT NULL").count()}
    assert kept == {0: 700, 1: 700} and not last_sampled(rows, ["C1"], "h", 3001).count()
