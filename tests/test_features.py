"""Feature preparation against pandas, and the request path against the batch path."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import features as feat
from tidegauge.operators.contract import accepted, overlay_defaults, rejected, with_contract, with_decision
from tidegauge.operators.whatif import null_out, overwrite_cohort, rescale_amount, share_of_rows, unchanged
from tidegauge.operators.sampling import row_hash


def test_identity_join_flags_and_renames(spark):
    tx = spark.createDataFrame([(1,), (2,), (3,)], "TransactionID int")
    people = spark.createDataFrame([(1, 5.0), (3, None)], "TransactionID int, `id-01` double")
    rows = feat.attach_identity(tx, people).orderBy("TransactionID").collect()
    assert [(r.id_01, r.has_identity) for r in rows] == [(5.0, 1), (None, 0), (None, 1)]


def test_calendar_and_amount_features(spark):
    values = [(0, 10.0), (-5400, 0.125), (90000, 1.375), (3600 * 25 + 1800, None)]
    rows = feat.calendar_amount(spark.createDataFrame(values, "TransactionDT bigint, TransactionAmt double")).collect()
    for (t, amount), r in zip(values, rows):
        assert r.hour == pytest.approx((t / 3600) % 24) and r.dayofweek == pytest.approx((t / 86400) % 7)
        assert r.day_index == pytest.approx(t / 86400)
        if amount is not None:
            assert r.amt_log == pytest.approx(math.log1p(amount))
    # 12.5 and 37.5 cents round to even.
    assert [r.amt_cents for r in rows] == [0.0, 12.0, 38.0, None]
    assert [r.amt_is_round for r in rows] == [1, 0, 0, 0]


def test_codes_match_pandas_categories(spark):
    rng = np.random.default_rng(0)
    words = np.array(["", "a", "ab", "abc", "B", "b", "zeta", "Ωmega", "émile", "10", "9"])
    data = pd.DataFrame({"n": range(300), "w": rng.choice(words, 300), "flag": rng.random(300) < 0.5})
    data.loc[::5, "w"] = None
    coded = feat.encode(spark.createDataFrame(data).repartition(3)).orderBy("n").toPandas()
    assert coded.w.tolist() == data.w.astype("category").cat.codes.tolist()
    assert coded.flag.tolist() == data.flag.tolist()


def test_fitted_codes_keep_their_meaning(spark):
    first = spark.createDataFrame([("a",), ("c",)], "w string")
    codes = feat.fit_codes(first, ["w"])
    second = spark.createDataFrame([("c",), ("b",), (None,)], "w string")
    assert [r.w for r in feat.apply_codes(second, codes, ["w"]).collect()] == [1, -1, -1]


def test_frequencies(spark):
    df = spark.createDataFrame([(1, "x"), (1, None), (2, "x"), (None, "y")], "card int, mail string")
    rows = feat.with_frequency(df, ["card", "mail", "absent"]).collect()
    got = {(r.card, r.mail): (r.card_freq, r.mail_freq) for r in rows}
    assert got == {(1, "x"): (2, 2), (1, None): (2, 0), (2, "x"): (1, 2), (None, "y"): (0, 1)}
    # Coded first, a missing text value is one more value.
    assert {r.mail_freq for r in feat.with_frequency(feat.encode(df), ["mail"]).where("mail = -1").collect()} == {1}


def test_entity_key_is_missing_if_a_part_is(spark):
    df = spark.createDataFrame(
        [(5, 300, 10.5, 8.0), (5, 300, 10.4, 10.7), (5, None, 1.0, 0.0)],
        "card1 int, addr1 int, day_index double, D1 double",
    )
    assert [r._uid for r in feat.with_entity_key(df).collect()] == ["5_300_2.0", "5_300_-0.0", None]


def test_conform_orders_adds_and_drops(spark):
    df = spark.createDataFrame([("1.5", 2, "no")], "a string, b int, c string")
    out = feat.conform(df, ["b", "missing", "a", "c"])
    assert out.dtypes == [("b", "float"), ("missing", "float"), ("a", "float"), ("c", "float")]
    assert tuple(out.first()) == (2.0, None, 1.5, None)


def test_contract_defaults_and_ranges(spark):
    amounts = [120.0, -5.0, 1e9, None, float("nan"), 0.0, 100000.0]
    checked = with_contract(spark.createDataFrame([(a,) for a in amounts], "TransactionAmt double"))
    assert sorted(r.TransactionAmt for r in accepted(checked).collect()) == [0.0, 120.0, 100000.0]
    row = accepted(checked).first()
    assert (row.ProductCD, row.card1, row.addr1, row.hour, row.has_identity) == (4, 7919, 299.0, 14.0, 0)
    assert {tuple(r.violations) for r in rejected(checked).collect()} == {("TransactionAmt out of range",)}


def test_contract_types(spark):
    df = spark.createDataFrame([(1.0, "2.5", 24.0), (1.0, "x", 23.9), (1.0, "3", -0.1)], "TransactionAmt double, card4 string, hour double")
    found = [r.violations for r in with_contract(df).collect()]
    assert found == [["card4 out of range", "hour out of range"], ["card4 out of range"], ["hour out of range"]]


def test_decision_uses_the_unrounded_probability(spark):
    rows = with_decision(spark.createDataFrame([(0.49999999,), (0.5,)], "p double"), "p").collect()
    assert [(r.fraud_probability, r.decision) for r in rows] == [(0.5, "approve"), (0.5, "review")]
    assert rows[1].lift_over_base == pytest.approx(round(0.5 / 0.03499, 3))


def test_requests_and_batches_get_the_same_amount_features(spark):
    """Training and serving skew: the same rows through both paths must agree."""
    columns = ["TransactionAmt", "amt_log", "amt_cents", "amt_is_round", "C1"]
    df = spark.createDataFrame(
        [(i, 86400 * i, a, 1.0) for i, a in enumerate([10.0, 59.95, 0.125, 4999.99, 300.5])],
        "id int, TransactionDT bigint, TransactionAmt double, C1 double",
    )
    batch = feat.conform(feat.calendar_amount(df), ["id", *columns]).orderBy("id").collect()
    served = overlay_defaults(with_contract(df), columns, {"C1": 7.0}).select("id", *columns).orderBy("id").collect()
    assert [tuple(r)[1:] for r in batch] == [tuple(r)[1:] for r in served]


def test_overlay_falls_back_to_defaults(spark):
    df = spark.createDataFrame([(10.0, None)], "TransactionAmt double, C1 double")
    row = overlay_defaults(df, ["C1", "card1_freq", "unknown", "TransactionAmt"], {"C1": 2.0, "card1_freq": 9.0}).first()
    assert (row.C1, row.card1_freq, row.unknown, row.TransactionAmt) == (2.0, 9.0, None, 10.0)


@pytest.fixture(scope="module")
def live(spark):
    rows = [(i, 10.0 + i, math.log1p(10.0 + i), 5.0, 3.0, 2.0, 1, 7.0, 1.0) for i in range(2000)]
    return spark.createDataFrame(
        rows, "n int, TransactionAmt double, amt_log double, C1 double, C13 double, D1 double, has_identity int, card1_freq double, id_01 double"
    ).withColumn("h", row_hash(42, "n"))


def test_rescale_moves_amount_and_log_only(live):
    row = rescale_amount(live).where("n = 3").first()
    assert row.TransactionAmt == 1300.0 and row.amt_log == pytest.approx(math.log1p(1300.0)) and row.C1 == 5.0


def test_cohort_overwrites_about_the_share_with_one_mask(live):
    changed = overwrite_cohort(live, share_of_rows(F.col("h"), 0.35)).toPandas()
    young = changed[changed.C1 == 1.0]
    assert 0.31 < len(young) / 2000 < 0.39
    assert (young[["C13", "D1", "has_identity", "card1_freq"]] == [1.0, 0.0, 0, 1.0]).all().all()
    assert (changed[changed.C1 != 1.0].card1_freq == 7.0).all()
    assert overwrite_cohort(live.drop("card1_freq"), share_of_rows(F.col("h"), 0.35)).columns == live.drop("card1_freq").columns


def test_outage_and_control(live):
    out = null_out(live)
    assert out.where("id_01 IS NULL AND has_identity = 0").count() == 2000 and out.dtypes == live.dtypes
    assert unchanged(live) is live
