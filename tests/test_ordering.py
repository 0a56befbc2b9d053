"""Positions, samples and random halves against plain sorting."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from catalogue import inputs
from tidegauge.operators import ordering
from tidegauge.operators.ordering import RowOrder, Splits, baseline_batch, baseline_cut, baseline_windows, find_splits, hash_levels, id_levels
from tidegauge.operators.sampling import counts_by_prefix, random_halves, row_hash, sample_values


def frame(n=1000, hot=0.4, seed=0):
    """Rows whose timestamps tie, one of them on ``hot`` of all rows."""
    rng = np.random.default_rng(seed)
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 5 * 86400, n), unit="s")
    ts = pd.Series(ts)
    ts[rng.random(n) < hot] = pd.Timestamp("2024-01-02 03:04:05")
    return pd.DataFrame({"id": rng.permutation(n) * 1_000_003, "ts": ts})


@pytest.mark.parametrize("rank_at_most", [0, 10**9])
@pytest.mark.parametrize("hot", [0.0, 0.4, 1.0])
def test_windows_match_a_sort(spark, monkeypatch, hot, rank_at_most):
    monkeypatch.setattr(ordering, "RANK_AT_MOST", rank_at_most)
    data = frame(hot=hot)
    df = spark.createDataFrame(data).repartition(5)
    splits = Splits.find(df, RowOrder.by_time("ts", id_levels("id")), baseline_windows(0.4, 8))
    found = splits.with_part(df).toPandas().sort_values(["ts", "id"]).part.tolist()
    bounds = [400 + i * 600 // 8 for i in range(8)]
    assert found == [sum(b <= i for b in bounds) for i in range(1000)]
    assert df.where(splits.before(0)).count() == 400
    assert df.where(splits.from_(3) & splits.before(5)).count() == bounds[5] - bounds[3]


def test_digest_ties(spark):
    df = spark.range(500).select("id", F.lit("2024-01-01").cast("date").alias("day")).withColumn("h", row_hash(7, "id"))
    splits = Splits.find(df, RowOrder.by_date("day", hash_levels("h")), baseline_batch(0.4, 50))
    ordered = df.toPandas().sort_values("h").id.tolist()
    live = df.where(splits.from_(0) & splits.before(1)).toPandas().id
    assert sorted(live) == sorted(ordered[200:250])


def test_positions_past_the_end_have_no_key(spark):
    df = spark.range(10).withColumn("h", row_hash(7, "id"))
    splits = Splits.find(df, RowOrder.by_hash(F.col("h")), baseline_batch(0.4, 1000))
    assert splits.key(1) is None
    assert df.where(splits.from_(0) & splits.before(1)).count() == 6
    assert df.where(splits.from_(1)).count() == 0


def test_an_empty_table_is_all_part_0(spark):
    df = spark.range(0).withColumn("h", row_hash(7, "id"))
    splits = Splits.find(df, RowOrder.by_hash(F.col("h")), baseline_windows(0.4, 8))
    assert splits.with_part(df).columns == ["id", "h", "part"] and splits.with_part(df).count() == 0


def test_groups_have_their_own_positions(spark):
    df = spark.range(300).select("id", (F.col("id") % 3).alias("g"))
    found = find_splits(df, RowOrder(id_levels("id")), lambda n: F.array((n / 2).cast("bigint")), ["g"])
    assert {(r.g, r._level1) for r in found.frame().collect()} == {(0, 150), (1, 151), (2, 152)}


def test_sample_is_the_lowest_digests_per_feature(spark):
    rng = np.random.default_rng(1)
    data = pd.DataFrame({"id": range(4000), "x": rng.normal(size=4000), "y": rng.normal(size=4000)})
    data.loc[data.index % 4 > 0, "y"] = None
    df = spark.createDataFrame(data).withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in "xy"})
    df = df.withColumn("h", row_hash(42, "id")).repartition(6)
    taken = sample_values(df, ["x", "y"], "h", 300, counts_by_prefix(df, ["x", "y"], "h")).toPandas()
    ordered = df.toPandas().sort_values("h")
    for slot, name in enumerate("xy"):
        assert sorted(taken[taken.slot == slot].value) == sorted(ordered[name].dropna().head(300))


def test_random_halves_are_disjoint_and_equal(spark):
    halves = random_halves(spark.range(101), ["id"], 4, 42).toPandas()
    assert len(halves) == 404
    assert (halves.groupby("trial").first_half.sum() == 50).all()
    picks = {t: frozenset(g[g.first_half].id) for t, g in halves.groupby("trial")}
    assert len(set(picks.values())) == 4
    again = random_halves(spark.range(101).repartition(7), ["id"], 4, 42).toPandas()
    assert picks == {t: frozenset(g[g.first_half].id) for t, g in again.groupby("trial")}


@pytest.mark.parametrize("fraction", [0.05, 0.4])
def test_null_keys_come_first_and_no_row_is_lost(spark, fraction):
    """A cut inside the nulls and one behind them: both parts add up to all rows."""
    rows = [(i, None if i % 10 == 0 else float(i * 7919 % 1000)) for i in range(1000)]
    df = spark.createDataFrame(rows, "id bigint, key double")
    order = RowOrder((F.col("key"), F.col("id")))
    splits = Splits.find(df, order, baseline_cut(fraction))
    first = {r.id for r in df.where(splits.before(0)).collect()}
    rest = {r.id for r in df.where(splits.from_(0)).collect()}
    ranked = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0.0, r[0]))
    assert first == {i for i, _ in ranked[: int(1000 * fraction)]}
    assert first | rest == set(range(1000)) and not first & rest
    parts = {r.id for r in splits.with_part(df).where("part = 0").collect()}
    assert parts == first


def test_windows_by_deciding_levels_alone(spark):
    """Comparing with the split keys, days first and digests only on their days, places rows as ranks do."""
    df = spark.range(2000).select("id", F.when(F.col("id") % 7 > 0, F.expr("date_add(date'2020-01-01', cast(id % 5 as int))")).alias("day"), F.md5(F.col("id").cast("string")).alias("h"))
    order = RowOrder.by_date("day", hash_levels("h"), deciding=(0, 2))
    placed = Splits.find(df, order, lambda n: F.array(*[(n * i / 8).cast("bigint") for i in range(8)])).with_part(df)
    ranked = placed.withColumn("_r", F.row_number().over(Window.orderBy("day", "h")) - 1)
    assert ranked.where(F.col("part") != F.floor(F.col("_r") / 250) + 1).count() == 0
    # The digest is only computed where a key has the row's day.
    lines = inputs.lines(spark, "/root/testdata/sf0.001")
    placed = Splits.find(lines, inputs.line_order(), baseline_windows(0.4, 8)).with_part(lines, "window").select("l_tax", "window")
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "THEN md5(" in plan and plan.count("md5(") == 1
