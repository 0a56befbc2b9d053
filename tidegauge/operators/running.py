"""Running sums over a total order of any size, and with them ranks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.session import stored


def with_running(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    before: Mapping[str, str],
    totals: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add sums over the rows before a row, and over all rows, of its group.

    ``before`` and ``totals`` map new columns to the columns they sum. A group is one value of
    ``by`` (a null is a value), its rows are unique in ``order`` and go by it, nulls first.

    Rows are dealt to ranges whose bounds Spark samples from the rows themselves, and
    written with the number of their range. Sums inside a range and the offset of a range
    in its group make the result, so no task holds more than a range, however large a
    group is or however alike its values are.
    """
    by, totals = list(by), totals or {}
    n_ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n_ranges, *by, *order).withColumn("_range", F.spark_partition_id())
    placed = stored(ranged, "ranges")
    summed = sorted({*before.values(), *totals.values()})
    # One row for each range, and one more for each group that begins inside a range.
    sizes = placed.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_sum_{c}") for c in summed])
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(c).alias(f"_by_{i}") for i, c in enumerate(by)],
        F.col("_range").alias("_at"),
        *[F.coalesce(F.sum(f"_sum_{c}").over(earlier), F.lit(0)).alias(f"_start_{name}") for name, c in before.items()],
        *[F.sum(f"_sum_{c}").over(Window.partitionBy(*by)).alias(name) for name, c in totals.items()],
    )
    within = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumns({f"_own_{name}": F.coalesce(F.sum(c).over(within), F.lit(0)) for name, c in before.items()})
    same = [F.col(c).eqNullSafe(F.col(f"_by_{i}")) for i, c in enumerate(by)]
    return local.join(offsets, [*same, F.col("_range") == F.col("_at")]).select(
        *df.columns, *[(F.col(f"_start_{n}") + F.col(f"_own_{n}")).alias(n) for n in before], *totals
    )
