"""The physical plans behind the README's claims."""

import pytest
from pyspark.sql import functions as F

from catalogue import inputs
from catalogue.queries import LINE_FEATURES, line_profile, prepared
from tidegauge.operators.compare import cell_counts, compare
from tidegauge.operators.profile import build_profile
from tidegauge.operators.ranking import roc_auc

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


@pytest.fixture(scope="module")
def batches(spark):
    return inputs.line_batches(spark, SF_DIR)


def test_a_part_of_the_time_order_is_a_pushed_filter(batches):
    """Null keys come first, so they belong to the earlier part and the pushed filter says so."""
    base, live = (plan(rows.select("l_tax")) for rows in batches)
    assert "PushedFilters: [Or(IsNull(l_shipdate),LessThan" in base and "PushedFilters: [IsNotNull(l_shipdate)" in live
    assert "Exchange" not in base + live


def test_comparing_reads_needed_columns_and_shuffles_counts_only(spark, batches):
    base, live = batches
    profile = line_profile(base)
    text = plan(cell_counts(live, profile, "pred"))
    assert text.count("Scan parquet") == 2 and "l_returnflag" not in text.split("ReadSchema:")[1].split("\n")[0]
    # One shuffle, after map-side counting; the search itself needs none.
    assert text.count("Exchange hashpartitioning") <= 1 and "partial_count(1)" in text
    whole = plan(compare(live, profile, "pred"))
    for unwanted in ("Cartesian", "NestedLoop", "SinglePartition", "Python"):
        assert unwanted not in whole


def test_profiles_features_and_auc_stay_in_the_jvm_without_pairing_rows(spark, batches):
    base, live = batches
    frames = [
        build_profile(base, LINE_FEATURES, "pred", "h").table,
        prepared(spark, SF_DIR),
        roc_auc(live.withColumn("y", (F.col("l_tax") > 0.03).cast("int")), "pred", "y", ["l_returnflag"]),
    ]
    for df in frames:
        text = plan(df)
        for unwanted in ("Cartesian", "NestedLoop", "Python"):
            assert unwanted not in text
