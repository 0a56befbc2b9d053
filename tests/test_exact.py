"""Comparison with all values, categories and running sums, against numpy and pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.operators.exact import categorical_psi, exact_compare
from tidegauge.operators.features import fit_codes
from tidegauge.operators.running import with_running
from tidegauge.settings import DriftSettings


def ks(ref, cur):
    points = np.concatenate([ref, cur])
    below = lambda x: np.searchsorted(np.sort(x), points, side="right") / len(x)
    return np.abs(below(ref) - below(cur)).max()


def psi(ref, cur, bins=10):
    edges = np.unique(np.quantile(ref, np.arange(bins + 1) / bins))
    if len(edges) < 3:
        return 0.0
    share = lambda x: np.maximum(np.bincount(np.searchsorted(edges[1:-1], x, side="right"), minlength=len(edges) - 1) / len(x), 1e-6)
    e, a = share(ref), share(cur)
    return float(((a - e) * np.log(a / e)).sum())


def frame(spark, columns):
    data = pd.DataFrame(columns)
    return spark.createDataFrame(data.astype(object).where(data.notna(), None), ", ".join(f"{c} double" for c in data)).repartition(5)


def columns(rng, n, shift=0.0):
    skewed = np.where(rng.random(n) < 0.4, 0.0, rng.normal(shift, 1, n))  # one value on two fifths of the rows
    missing = np.where(rng.random(n) < 0.3, np.nan, rng.gamma(2, 1 + shift, n))
    return {"a": rng.normal(shift, 1, n), "b": skewed, "c": missing, "d": rng.integers(0, 3, n).astype(float), "e": np.full(n, np.nan), "pred": rng.random(n) ** (1 + shift)}


def test_against_numpy(spark):
    rng = np.random.default_rng(0)
    base, sides = columns(rng, 3000), {1: columns(rng, 700), 2: columns(rng, 900, 0.5)}
    sides[2]["e"] = rng.normal(size=900)
    batch = pd.concat([pd.DataFrame(v).assign(g=g) for g, v in sides.items()])
    made = spark.createDataFrame(batch.astype(object).where(batch.notna(), None), ", ".join(f"{c} double" for c in base) + ", g int")
    rows = {(r.g, r.feature): r for r in exact_compare(frame(spark, base), made.repartition(3), list("abcde"), "pred", ["g"]).collect()}
    assert len(rows) == 12
    for g, cur in sides.items():
        for name in [*"abcd", "pred"]:
            ref, now = (x[name][~np.isnan(x[name])] for x in (base, cur))
            r = rows[g, "__pred__" if name == "pred" else name]
            assert (r.n_ref, r.n_cur, r.n_rows) == (len(ref), len(now), len(cur[name]))
            assert r.ks_stat == pytest.approx(ks(ref, now), abs=1e-12) and r.psi == pytest.approx(psi(ref, now), abs=1e-9)
            assert r.null_rate == pytest.approx(np.isnan(cur[name]).mean())
        assert rows[g, "e"].n_ref == 0 and rows[g, "e"].psi == 0 and rows[g, "e"].p_raw == 1
    assert rows[2, "a"].flagged and not rows[1, "a"].flagged


def test_more_values_than_a_stored_sample_holds(spark):
    """A shift that few of many values show is seen: nothing is sampled."""
    n = 60_000
    base = spark.range(n).select(F.col("id").cast("double").alias("a"), F.lit(0.5).alias("pred"))
    batch = base.withColumn("a", F.when(F.col("a") >= n - 30, n + F.col("a")).otherwise(F.col("a")))
    row = exact_compare(base, batch, ["a"], "pred").where("feature = 'a'").first()
    assert row.n_ref == n and row.ks_stat == pytest.approx(30 / n)


def test_columns_that_are_missing_and_empty_tables(spark):
    base = spark.createDataFrame([(float(i), i / 30, 0.1) for i in range(30)], "a double, b double, pred double")
    rows = {r.feature: r for r in exact_compare(base, base.drop("b"), ["a", "b"], "pred").collect()}
    assert set(rows) == {"a", "__pred__"} and rows["a"].ks_stat == 0 and rows["a"].psi == 0
    assert exact_compare(base, base.where("false"), ["a"], "pred").collect() == []
    none = {r.feature: r for r in exact_compare(base.where("false"), base, ["a"], "pred").collect()}
    assert not any(r.flagged for r in none.values())


def test_categorical_psi(spark):
    base = pd.DataFrame({"two": [0] * 600 + [1] * 400, "many": ["x", "y", None, "z"] * 250})
    batch = pd.DataFrame({"g": [1] * 500 + [2] * 500, "two": [0] * 500 + [0, 1] * 250, "many": ["x", "y"] * 250 + ["new", "x"] * 250})
    rows = {(r.g, r.feature): r for r in categorical_psi(spark.createDataFrame(base), spark.createDataFrame(batch), ["two", "many"], ["g"]).collect()}
    for (g, feature), r in rows.items():
        ref, cur = base[feature].dropna(), batch[batch.g == g][feature].dropna()
        known = sorted({*ref, *cur}, key=str)
        share = lambda x: np.maximum([(x == v).mean() for v in known], 1e-6)
        e, a = share(ref), share(cur)
        assert r.psi == pytest.approx(float(((a - e) * np.log(a / e)).sum()), abs=1e-9)
        assert (r.n_ref, r.n_cur, r.n_values) == (len(ref), len(cur), len(known))
    assert rows[1, "two"].psi > DriftSettings().psi_major and len(rows) == 4


@pytest.mark.parametrize("partitions", ["1", "4", "37"])
def test_running_sums(spark, partitions):
    rng = np.random.default_rng(2)
    data = pd.DataFrame({"g": rng.choice(["hot"] * 8 + ["x", "y"], 900), "v": rng.permutation(900), "n": rng.integers(0, 9, 900)})
    data.loc[data.g == "y", "g"] = None
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        made = with_running(spark.createDataFrame(data).repartition(3), ["g"], ["v"], {"b": "n"}, {"t": "n"}).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    wanted = data.sort_values("v").assign(g=data.g.fillna("-"))
    wanted["b"] = wanted.groupby("g").n.cumsum() - wanted.n
    wanted["t"] = wanted.groupby("g").n.transform("sum")
    found = made.assign(g=made.g.fillna("-")).sort_values("v")[wanted.columns]
    assert found.values.tolist() == wanted.values.tolist()


def test_codes_of_one_shared_prefix(spark):
    """Values that begin alike still spread over ranges: no task holds the column."""
    values = spark.range(4000).select(F.format_string("https://www.example.com/%06d", F.col("id") * 7919 % 4000).alias("w"))
    codes = fit_codes(values, ["w"])
    assert [r.code for r in codes.orderBy("value").collect()] == list(range(4000))
    # The ranges that the ranks were counted in are left in the plan as a table.
    sizes = spark.read.parquet(codes.inputFiles()[0].rsplit("/", 1)[0]).groupBy("_range").count().collect()
    assert len(sizes) > 1 and max(r["count"] for r in sizes) < 4000 / len(sizes) * 2


def test_counting_frequencies_reads_the_rows_twice(spark):
    from tidegauge.operators.features import with_frequency

    df = spark.createDataFrame([(i % 5, str(i % 7), i % 3) for i in range(100)], "a int, b string, c int")
    made = with_frequency(df, ["a", "b", "c"])
    made.collect()
    plan = made._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") - final.count("ReusedExchange") <= 3
    assert {(r.a, r.a_freq, r.b_freq) for r in made.collect() if r.a == 0 and r.b == "0"} == {(0, 20.0, 15.0)}
