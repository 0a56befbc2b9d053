"""The detector's failure modes, its arithmetic and its invariants."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests import brute
from tidegauge.functions.kolmogorov import exact_two_sample, with_ks_pvalue
from tidegauge.operators import compare as comparing
from tidegauge.operators.compare import compare, features_only, missing_columns, top_drifted, verdict, with_significance
from tidegauge.operators.profile import PREDICTION, build_profile, monitored_features, profile_from_samples
from tidegauge.operators.sampling import row_hash
from tidegauge.settings import DriftSettings


def stored(spark, samples, predictions, null_rate=None, cap=20_000):
    """A profile from arrays, as one loaded from a store."""
    names = [*samples, PREDICTION]
    values = [*samples.values(), predictions]
    rates = [None if null_rate is None else null_rate.get(n, 0.0) for n in names]
    features = spark.createDataFrame(
        [(i, n, len(v), r, None) for i, (n, v, r) in enumerate(zip(names, values, rates))],
        "slot int, feature string, n_rows bigint, null_rate double, mean double",
    )
    tall = pd.concat([pd.DataFrame({"slot": i, "value": np.asarray(v, float)}) for i, v in enumerate(values)])
    frame = spark.createDataFrame(tall, "slot int, value double")
    return profile_from_samples(list(samples), features, frame, cap=cap)


def outcome(batch, profile, by=(), settings=DriftSettings()):
    rows = compare(batch, profile, "pred", by, settings)
    return verdict(rows, by, settings, missing_columns(batch, profile)).collect()


def batch_of(spark, columns, predictions):
    return spark.createDataFrame(pd.DataFrame({**columns, "pred": predictions}))


@pytest.fixture(scope="module")
def two_normals(spark):
    rng = np.random.default_rng(0)
    samples = {"a": rng.normal(0, 1, 5000), "b": rng.normal(5, 2, 5000)}
    return stored(spark, samples, rng.beta(1, 30, 5000), {"a": 0.0, "b": 0.0}).checkpoint()


def two_normals_batch(spark, shift=0.0, **replaced):
    rng = np.random.default_rng(1)
    columns = {"a": rng.normal(shift, 1, 5000), "b": rng.normal(5, 2, 5000)} | replaced
    return batch_of(spark, columns, np.random.default_rng(2).beta(1, 30, 5000))


def test_same_distribution_is_silent(spark, two_normals):
    (report,) = outcome(two_normals_batch(spark), two_normals)
    assert not report.drifted and report.reasons == []
    assert report.n_rows == 5000 and report.n_features == 2


def test_large_shift_is_caught(spark, two_normals):
    (report,) = outcome(two_normals_batch(spark, shift=3.0), two_normals)
    assert report.drifted and report.n_flagged == 1 and report.top_feature == "a"


def test_a_column_that_goes_missing_is_caught(spark, two_normals):
    (report,) = outcome(two_normals_batch(spark, a=np.full(5000, np.nan)), two_normals)
    assert report.drifted
    assert report.reasons[0] == "1 feature(s) changed missing rate, worst a by 100.0%"
    row = compare(two_normals_batch(spark, a=np.full(5000, np.inf)), two_normals, "pred").where("feature = 'a'").first()
    assert (row.ks_stat, row.p_raw, row.psi, row.null_rate) == (0.0, 1.0, 0.0, 1.0)


def test_column_the_batch_lacks_is_reported(spark, two_normals):
    (report,) = outcome(two_normals_batch(spark).drop("b"), two_normals)
    assert report.missing_columns == ["b"] and report.n_features == 1


def test_no_common_column(spark, two_normals):
    batch = spark.createDataFrame([(1.0,)] * 30, "other double")
    assert compare(batch, two_normals).collect() == []


def test_without_predictions_only_features_count(spark, two_normals):
    rows = compare(two_normals_batch(spark).drop("pred"), two_normals)
    (report,) = verdict(rows).collect()
    assert report.n_features == 2 and report.pred_psi == 0.0 and report.pred_mean_batch is None and not report.drifted


def test_prediction_drift_alone_alarms(spark, two_normals):
    batch = two_normals_batch(spark).withColumn("pred", F.col("pred") + 0.5)
    (report,) = outcome(batch, two_normals)
    assert report.drifted and report.n_flagged == 0
    assert report.reasons[0].startswith("prediction distribution PSI")


@pytest.mark.parametrize("shift,drifted", [(0, False), (5, True)])
def test_eight_features_without_stored_missing_rates(spark, shift, drifted):
    rng = np.random.default_rng(0)
    names = [f"f{i}" for i in range(8)]
    profile = stored(spark, {n: rng.normal(size=3000) for n in names}, rng.random(3000) * 0.1)
    batch = {n: rng.normal(size=3000) + shift for n in names}
    (report,) = outcome(batch_of(spark, batch, rng.random(3000) * 0.1 + shift / 10), profile)
    assert report.drifted is drifted


def test_psi_and_ks_match_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=1000)
    cases = {
        "same": (base, base),
        "nudged": (base, base + 0.2),
        "moved": (base, base + 2.0),
        "wide": (rng.normal(size=5000), rng.normal(1, 1, 1000)),
        "constant": (base, np.full(1000, 99.0)),
        "ties": (rng.integers(0, 5, 2000).astype(float), rng.integers(1, 7, 1000).astype(float)),
        "binary": ((rng.random(1000) < 0.3).astype(float), (rng.random(1000) < 0.6).astype(float)),
        "one value": (np.full(500, 7.0), np.full(1000, 7.0)),
        "hot value": (np.where(rng.random(1000) < 0.4, 0.0, base), np.where(rng.random(1000) < 0.7, 0.0, base)),
        "neighbours": (np.array([1.0, np.nextafter(1, 2)] * 50), np.array([1.0, np.nextafter(1, 0)] * 500)),
        "signed zero": (np.array([0.0, -0.0, 1.0] * 20), np.array([-0.0, 1.0] * 500)),
    }
    profile = stored(spark, {n: ref for n, (ref, _) in cases.items()}, base)
    batch = batch_of(spark, {n: cur for n, (_, cur) in cases.items()}, base).repartition(7)
    rows = {r.feature: r for r in features_only(compare(batch, profile, "pred")).collect()}
    for name, (ref, cur) in cases.items():
        assert rows[name].ks_stat == pytest.approx(brute.ks(ref, cur), abs=1e-12), name
        assert rows[name].psi == pytest.approx(brute.psi(ref, cur), abs=1e-9), name
    assert rows["same"].psi == 0 and rows["same"].ks_stat == 0
    assert rows["moved"].psi > rows["nudged"].psi > 0
    assert rows["wide"].psi > 0.10
    assert 0 < rows["constant"].psi < np.inf


def test_missing_values_are_left_out_of_the_tests(spark):
    rng = np.random.default_rng(4)
    ref, cur = rng.normal(size=500), rng.normal(0.3, 1, 600)
    cur[::7], cur[1::7], cur[2::7] = np.nan, np.inf, -np.inf
    profile = stored(spark, {"x": ref}, ref, {"x": 0.0})
    row = compare(batch_of(spark, {"x": cur}, rng.random(600)), profile, "pred").where("feature = 'x'").first()
    kept = cur[np.isfinite(cur)]
    assert row.n_cur == len(kept) and row.null_delta == pytest.approx(1 - len(kept) / 600)
    assert row.ks_stat == pytest.approx(brute.ks(ref, kept), abs=1e-12)


def test_text_that_is_no_number_is_missing(spark):
    profile = stored(spark, {"x": np.arange(100.0)}, np.arange(100.0), {"x": 0.0})
    batch = spark.createDataFrame([(v, 0.5) for v in ["1", "2.5", "n/a", None] * 10], "x string, pred double")
    row = compare(batch, profile, "pred").where("feature = 'x'").first()
    assert (row.n_cur, row.null_rate, row.null_shift) == (20, 0.5, True)


def test_too_few_values_are_not_tested(spark):
    profile = stored(spark, {"x": np.arange(19.0)}, np.arange(100.0))
    row = compare(batch_of(spark, {"x": np.full(50, 99.0)}, np.arange(50.0)), profile, "pred").where("slot = 0").first()
    assert (row.ks_stat, row.p_raw, row.psi, row.flagged) == (0.0, 1.0, 0.0, False)


def test_many_batches_at_once_equal_one_by_one(spark, two_normals):
    rng = np.random.default_rng(5)
    frames = []
    for key, n in (("a hot one", 4000), ("small", 500), ("smaller", 30)):
        frames.append(pd.DataFrame({"key": key, "a": rng.normal(0.4, 1, n), "b": rng.normal(5, 3, n), "pred": rng.random(n)}))
    together = compare(spark.createDataFrame(pd.concat(frames)), two_normals, "pred", ["key"])
    found = {(r.key, r.feature): (r.ks_stat, r.psi, r.p_raw, r.flagged) for r in together.collect()}
    for frame in frames:
        for r in compare(spark.createDataFrame(frame.drop(columns="key")), two_normals, "pred").collect():
            assert found[frame.key[0], r.feature] == pytest.approx((r.ks_stat, r.psi, r.p_raw, r.flagged))


def test_result_does_not_depend_on_partitioning_or_blocks(spark, two_normals, monkeypatch):
    batch = two_normals_batch(spark, shift=0.1)
    first = compare(batch.repartition(1), two_normals, "pred").orderBy("slot").collect()
    monkeypatch.setattr(comparing, "BROADCAST_AT_MOST", 1)
    blocks = compare(batch.repartition(13), two_normals, "pred").orderBy("slot").collect()
    drop = lambda rows: [tuple(v for k, v in r.asDict().items() if k not in ("mean", "sample_mean")) for r in rows]
    assert drop(first) == drop(blocks)


def test_corrections_nest(spark):
    p = np.linspace(0.001, 0.9, 50)
    df = spark.createDataFrame([("g", float(x)) for x in p], "g string, p double")
    rows = with_significance(df, "p", ["g"], 0.05).collect()
    raw, bonferroni, bh = (sum(r[c] for r in rows) for c in ("sig_none", "sig_bonferroni", "sig_bh"))
    ranks = np.arange(1, 51)
    passing = np.nonzero(p <= 0.05 * ranks / 50)[0]
    assert bh == (passing.max() + 1 if len(passing) else 0)
    assert raw == (p <= 0.05).sum() and bonferroni == (p <= 0.001).sum()
    assert bonferroni <= bh <= raw


def test_bh_accepts_earlier_ranks_that_fail_alone(spark):
    df = spark.createDataFrame([(1, 0.02), (1, 0.03), (1, 0.035), (1, 0.04)], "g int, p double")
    assert [r.sig_bh for r in with_significance(df, "p", ["g"], 0.05).collect()] == [True] * 4


@pytest.mark.parametrize("n,d", [(30, 0.2), (100, 0.05), (100, 0.136), (200, 0.1), (400, 0.07)])
def test_p_value_is_close_to_the_exact_distribution(spark, n, d):
    # Two samples of 2n values refer to the one-sample distribution with n.
    df = spark.createDataFrame([(d, 2 * n, 2 * n)], "d double, m bigint, n bigint")
    found = with_ks_pvalue(df, "d", "m", "n", "p").first().p
    assert found == pytest.approx(brute.ks_one_sample_survival(n, d), rel=2e-3, abs=1e-6)


def test_p_value_limits_and_monotony(spark):
    ds = [0.0, 0.001, 0.01, 0.02, 0.03, 0.05, 0.1, 0.3, 1.0]
    df = spark.createDataFrame([(d, 20000, 40000) for d in ds], "d double, m bigint, n bigint")
    found = [r.p for r in with_ks_pvalue(df, "d", "m", "n", "p").orderBy("d").collect()]
    assert found[0] == 1.0 and found[-1] < 1e-300
    assert found == sorted(found, reverse=True)


def test_calendar_features_are_not_monitored(spark):
    rows = [("day_index", 9.0, 0), ("a", 1.0, 1), ("D1", 8.0, 2), ("b", 2.0, 3), ("c", 1.0, 4)]
    importance = spark.createDataFrame(rows, "feature string, gain double, position int")
    assert [r.feature for r in monitored_features(importance, 2).orderBy("rank").collect()] == ["b", "a"]


def test_top_drifted_orders_by_psi(spark, two_normals):
    rows = compare(two_normals_batch(spark, shift=1.0), two_normals, "pred")
    assert [r.feature for r in top_drifted(rows, 1).collect()] == ["a"]


def test_profile_of_a_frame_samples_and_counts(spark):
    rng = np.random.default_rng(6)
    frame = pd.DataFrame({"id": range(3000), "x": rng.normal(size=3000), "pred": rng.random(3000)})
    frame.loc[::3, "x"] = np.nan
    df = spark.createDataFrame(frame).withColumn("h", row_hash(1, "id"))
    profile = build_profile(df, ["x"], "pred", "h", cap=500)
    row = profile.table.where("slot = 0").first()
    assert (row.n_rows, row.n_ref) == (3000, 500) and row.null_rate == pytest.approx(1 / 3)
    assert profile.table.where("slot = 1").first()["mean"] == pytest.approx(frame.pred.mean())
    digests = df.toPandas().dropna().sort_values("h").x.head(500)
    taken = [r.value for r in profile.samples.where("slot = 0").collect()]
    assert sorted(taken) == sorted(digests)


def test_unknown_correction_is_refused():
    with pytest.raises(ValueError):
        DriftSettings(correction="holm")


def test_batches_without_a_common_column_have_a_verdict(spark):
    base = spark.range(100).selectExpr("id", "CAST(id AS DOUBLE) AS a", "0.5D AS pred", "md5(CAST(id AS STRING)) AS h")
    profile = build_profile(base, ["a"], "pred", "h")
    batch = spark.createDataFrame([("x", 1.0), ("x", 2.0), (None, 3.0)], "day string, other double")
    rows = compare(batch, profile, by=["day"])
    found = {r.day: r for r in verdict(rows, ["day"], missing=missing_columns(batch, profile), batch=batch).collect()}
    assert {d: r.n_rows for d, r in found.items()} == {"x": 2, None: 1}
    assert all(r.n_features == 0 and not r.drifted and r.missing_columns == ["a"] for r in found.values())
    (whole,) = verdict(compare(batch, profile), missing=["a"], batch=batch).collect()
    assert whole.n_rows == 3 and whole.n_features == 0 and whole.reasons == []


@pytest.mark.parametrize(
    "n,m,d,p", [(20, 20, 0.40, 0.0811), (30, 30, 1 / 3, 0.0709), (30, 30, 11 / 30, 0.0346), (200, 300, 41 / 300, 0.0211)]
)
def test_exact_two_sample_p_values(n, m, d, p):
    assert exact_two_sample(d, n, m) == pytest.approx(p, abs=6e-5 if n < 100 else 5e-4)


def test_exact_p_value_against_all_merges():
    from itertools import combinations

    n, m = 5, 7
    for reach in (9, 14, 21, 35):
        hits = total = 0
        for own in combinations(range(n + m), n):
            i = j = 0
            far = 0
            for place in range(n + m):
                i, j = (i + 1, j) if place in own else (i, j + 1)
                far = max(far, abs(i * m - j * n))
            hits, total = hits + (far >= reach), total + 1
        assert exact_two_sample(reach / (n * m), n, m) == pytest.approx(hits / total, abs=1e-12)
