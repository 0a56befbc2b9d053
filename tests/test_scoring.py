"""The probe model, its importance, and bundles."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from catalogue import queries
from tidegauge.operators import scoring
from tidegauge.operators.profile import monitored_features
from tidegauge.operators.ranking import roc_auc
from tidegauge.operators.scoring import fit_probe, importance, score
from tidegauge.sources.models import ModelBundle, load_bundle, numeric_defaults, save_bundle


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(6)
    n = 3000
    data = pd.DataFrame({"strong": rng.normal(size=n), "weak": rng.normal(size=n), "noise": rng.normal(size=n), "D1": rng.normal(size=n)})
    chance = 1 / (1 + np.exp(-(3 * data.strong + data.weak + 2 * data.D1)))
    return spark.createDataFrame(data.assign(y=(rng.random(n) < chance).astype(int)))


COLUMNS = ["noise", "weak", "strong", "D1"]
SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model(rows):
    return fit_probe(rows, COLUMNS, "y", trees=8, depth=3)


def test_probe_looks_at_a_share_of_the_columns(rows, model):
    booster = model.stages[-1]
    assert booster.getOrDefault("featureSubsetStrategy") == "0.7" and booster.getOrDefault("subsamplingRate") == 0.8
    assert booster.getNumTrees == 8
    scored = score(rows, model)
    assert scored.columns == [*rows.columns, "pred"] and roc_auc(scored, "pred", "y").first().auc > 0.8
    one = fit_probe(rows, COLUMNS, "y", trees=3, depth=2, columns_share=1.0)
    assert one.stages[-1].toDebugString != model.stages[-1].toDebugString


def test_importance_ranks_and_leaves_calendar_columns_out(rows, model):
    gains = importance(model, COLUMNS, rows)
    found = {r.feature: r for r in gains.collect()}
    assert [found[c].position for c in COLUMNS] == [0, 1, 2, 3] and sum(r.gain for r in found.values()) == pytest.approx(1)
    top = monitored_features(gains, n=2).orderBy("rank").collect()
    assert [(r.feature, r["rank"]) for r in top] == [("strong", 1), ("weak", 2)]


def test_bundle_keeps_scores_and_metadata(spark, rows, model, tmp_path):
    defaults = numeric_defaults(rows, COLUMNS)
    save_bundle(ModelBundle(model, "v9", tuple(COLUMNS), defaults, 0.9, 3000), spark, str(tmp_path / "b"))
    loaded = load_bundle(spark, str(tmp_path / "b"))
    assert (loaded.model_version, loaded.columns, dict(loaded.defaults)) == ("v9", tuple(COLUMNS), defaults)
    one, two = (score(rows, m).agg(F.sum("pred")).first()[0] for m in (model, loaded.model))
    assert one == pytest.approx(two)


def test_probe_reads_its_rows_once(spark, rows):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def watched(value):
        seen.add(1)
        return value

    fit_probe(rows.withColumn("weak", watched("weak")), COLUMNS, "y", trees=2, depth=2)
    assert seen.value == rows.count()


def test_probe_degradation_scores_each_line_once(spark, monkeypatch):
    given = {}
    monkeypatch.setattr(
        queries.validation, "degradation", lambda later, verdicts, reference, *names: given.update(later=later, reference=reference)
    )
    queries.probe_degradation(spark, SF_DIR)
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in given.values()]
    assert not [p for p in plans if "UDF" in p]
    lines = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").count()
    assert given["later"].count() == lines - int(lines * 0.4)
    assert 0 < given["reference"].count() < lines * 0.4 and given["reference"].where("h IS NULL").isEmpty()


@pytest.fixture(scope="module")
def line_folder(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("lines"))
    n = F.col("id")
    spark.range(500).select(
        n.alias("l_orderkey"),
        F.lit(1).alias("l_linenumber"),
        (n % 50).alias("l_partkey"),
        (n % 7).alias("l_suppkey"),
        F.date_add(F.lit("1995-01-01").cast("date"), (n * 3).cast("int")).alias("l_shipdate"),
        F.when(n % 3 == 0, "R").otherwise("A").alias("l_returnflag"),
        F.lit("O").alias("l_linestatus"),
        (n % 40 + 1.0).alias("l_quantity"),
        ((n % 40 + 1) * (1000.0 + n * 7919 % 1000)).alias("l_extendedprice"),
        (n % 11 / 100).alias("l_discount"),
        (n % 9 / 100).alias("l_tax"),
    ).write.parquet(f"{folder}/lineitem.parquet")
    return folder


@pytest.mark.parametrize("name", ["probe_degradation", "probe_fit_importance"])
def test_probe_queries_fit_all_trees(spark, line_folder, monkeypatch, name):
    class Reached(Exception):
        pass

    class Watched:
        def __init__(self, stages):
            self.booster = stages[-1]

        def fit(self, rows):
            raise Reached(self.booster.getMaxIter(), self.booster.getMaxDepth(), self.booster.getStepSize())

    monkeypatch.setattr(scoring, "Pipeline", Watched)
    with pytest.raises(Reached) as found:
        getattr(queries, name)(spark, line_folder)
    assert found.value.args == (400, 6, 0.05)
