import numpy as np
import pandas as pd
import pytest

from tidegauge.operators.ordering import RowOrder, id_levels
from tidegauge.operators.ranking import roc_auc, rolling_mean


def auc(score, label):
    pos, neg = score[label == 1], score[label == 0]
    if not len(pos) or not len(neg):
        return None
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return wins / (len(pos) * len(neg))


def test_auc_matches_pair_counting(spark):
    rng = np.random.default_rng(0)
    frames = {
        "plain": (rng.random(800), rng.random(800) < 0.3),
        "ties": (rng.integers(0, 4, 500) / 4, rng.random(500) < 0.5),
        "hot score": (np.where(rng.random(500) < 0.6, 0.01, rng.random(500)), rng.random(500) < 0.2),
        "one score": (np.full(50, 0.5), np.arange(50) % 2 == 0),
        "one class": (rng.random(40), np.zeros(40, bool)),
    }
    data = pd.concat([pd.DataFrame({"g": g, "s": s, "y": y.astype(int)}) for g, (s, y) in frames.items()])
    rows = {r.g: r for r in roc_auc(spark.createDataFrame(data).repartition(5), "s", "y", ["g"]).collect()}
    for g, (s, y) in frames.items():
        expected = auc(s, y.astype(int))
        assert rows[g].auc == (pytest.approx(expected, abs=1e-12) if expected is not None else None), g
        assert rows[g].n == len(s) and rows[g].label_rate == pytest.approx(y.mean())


def test_auc_without_groups(spark):
    data = pd.DataFrame({"s": [0.1, 0.4, 0.35, 0.8], "y": [0, 0, 1, 1]})
    assert roc_auc(spark.createDataFrame(data), "s", "y").first().auc == 0.75


@pytest.mark.parametrize("n", [1, 30, 50, 99, 100, 101, 400, 1000])
def test_rolling_mean_matches_pandas(spark, n):
    rng = np.random.default_rng(n)
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 50, n)), unit="s")
    data = pd.DataFrame({"id": range(n), "ts": ts, "pred": rng.random(n)})
    order = RowOrder.by_time("ts", id_levels("id"))
    rolled = rolling_mean(spark.createDataFrame(data).repartition(4), order, "pred").toPandas().sort_values("id")
    expected = data.pred.rolling(50, min_periods=1).mean()
    assert len(rolled) == n
    assert np.allclose(rolled.rolling_mean.to_numpy(), expected.to_numpy())
