"""Mergeable quantile sketches: approximate quantile edges with a known rank error.

For profiles of tables too large or too many to count value by value: a sketch has a size
that does not depend on the rows, sketches of parts merge into one of the whole, and they are
plain binary columns to be stored with a profile.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.missing import finite_sql

SKETCH_K = 800


def rank_error(k: int = SKETCH_K) -> float:
    """How far the rank of one returned quantile may be off, as a share of the rows, in 99 of 100 cases.

    The fit that is published for KLL sketches: 2.296 / k ** 0.9021.
    """
    return 2.296 / k**0.9021


def quantile_sketches(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), k: int = SKETCH_K) -> DataFrame:
    """by..., feature, n (finite values), sketch: one pass, combined map-side; missing values are left out."""
    pairs = [f"struct('{c}' AS feature, {finite_sql(c)} AS value)" for c in columns]
    tall = df.select(*by, F.expr(f"inline(array({', '.join(pairs)}))")).where("value IS NOT NULL")
    return tall.groupBy(*by, "feature").agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("value", F.lit(k)).alias("sketch")
    )


def merged(sketches: DataFrame, by: Sequence[str] = (), k: int = SKETCH_K) -> DataFrame:
    """Sketches of parts (days, files, batches) put together: by..., feature, n, sketch."""
    return sketches.groupBy(*by, "feature").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))


def sketch_edges(sketches: DataFrame, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """by..., feature, i, edge, rank_error: approximate quantile edges 0..``bins`` of each sketch."""
    places = F.array(*[F.lit(i / bins) for i in range(bins + 1)])
    edges = F.kll_sketch_get_quantile_double("sketch", places)
    return sketches.select(*by, "feature", F.posexplode(edges).alias("i", "edge")).withColumn("rank_error", F.lit(rank_error()))
