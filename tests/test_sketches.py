"""Sketches of parts merge into one whose quantiles keep their rank error."""

import numpy as np
import pandas as pd
import pytest

from tidegauge.operators.sketches import merged, quantile_sketches, rank_error, sketch_edges


def test_merged_sketches_keep_their_error(spark):
    rng = np.random.default_rng(0)
    n = 40_000
    data = pd.DataFrame({"day": rng.integers(0, 30, n), "a": rng.gamma(2, 3, n), "b": rng.integers(0, 5, n).astype(float)})
    data["c"] = np.where(rng.random(n) < 0.2, np.nan, rng.normal(size=n))
    parts = quantile_sketches(spark.createDataFrame(data).repartition(7), ["a", "b", "c"], ["day"])
    assert parts.count() == 90
    found = sketch_edges(merged(parts), 10).toPandas()
    assert len(found) == 33
    for feature, rows in found.groupby("feature"):
        values = np.sort(data[feature].dropna())
        for r in rows.itertuples():
            low, high = (np.searchsorted(values, r.edge, side) / len(values) for side in ("left", "right"))
            assert low - 3 * r.rank_error <= r.i / 10 <= high + 3 * r.rank_error
    sizes = {r.feature: r.n for r in merged(parts).select("feature", "n").collect()}
    assert sizes == {"a": n, "b": n, "c": int(data.c.notna().sum())}


def test_small_inputs_are_exact_and_missing_ones_left_out(spark):
    df = spark.createDataFrame([(float(i), None) for i in range(11)], "a double, b double")
    rows = sketch_edges(quantile_sketches(df, ["a", "b"]), 10).collect()
    assert {r.feature for r in rows} == {"a"} and [r.edge for r in rows][0] == 0.0 and [r.edge for r in rows][-1] == 10.0
    assert rank_error(800) == pytest.approx(0.0055, abs=5e-4) and rank_error(800) < rank_error(200)
