"""Baseline profiles: what incoming batches are compared with.

A profile holds, per monitored feature and for the prediction, a bounded uniform
sample, the missing rate, and *cut points*: the sample's distinct values plus the
inner PSI bin edges, with the sample's running count and the PSI bin at each cut.
A batch then only has to be counted per cell between cut points. Those counts
give the KS statistic and PSI exactly, add up over partitions and micro-batches,
and stay as small as the profile however large the batch is.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.missing import finite_sql, quoted
from tidegauge.operators.sampling import counts_by_prefix, sample_values
from tidegauge.session import working_folder
from tidegauge.settings import CALENDAR_FEATURES, N_MONITORED, SAMPLE_CAP, DriftSettings

PREDICTION = "__pred__"


@dataclass(frozen=True)
class Profile:
    """A baseline profile.

    ``monitored`` lists the features by rank; a feature's ``slot`` is its place
    in that list and the prediction's slot is ``len(monitored)``. ``by`` names
    key columns when the frames hold several profiles side by side.

    - ``table``: by..., slot, feature, n_rows, null_rate, mean (of the prediction,
      over all rows), n_ref, sample_mean,
      ref_bins (sample count per PSI bin), and the arrays cuts, running and bins,
      the last two starting with the 0 below the first cut
    - ``samples``: by..., slot, value
    """

    monitored: tuple[str, ...]
    table: DataFrame
    samples: DataFrame
    by: tuple[str, ...] = ()
    cap: int = SAMPLE_CAP
    bins: int = DriftSettings.psi_bins

    @property
    def capacity(self) -> int:
        """The most cut points a feature can have."""
        return self.cap + self.bins

    def checkpoint(self) -> Profile:
        """The same profile with its table written to the shared checkpoint folder."""
        working_folder(self.table.sparkSession)
        return replace(self, table=self.table.checkpoint())


def monitored_features(importance: DataFrame, n: int = N_MONITORED) -> DataFrame:
    """The ``n`` most important features, calendar features left out: feature, gain, rank.

    ``importance`` has one row per model column: ``feature``, ``gain`` and its
    ``position`` in the model, which settles ties.
    """
    top = (
        importance.where(~F.col("feature").isin(*CALENDAR_FEATURES))
        .orderBy(F.desc("gain"), "position")
        .limit(n)
    )
    # At most n rows.
    order = Window.orderBy(F.desc("gain"), "position")
    return top.select("feature", "gain", F.row_number().over(order).alias("rank"))


def build_profile(
    df: DataFrame,
    monitored: Sequence[str],
    prediction: str,
    row_hash: str,
    by: Sequence[str] = (),
    cap: int = SAMPLE_CAP,
    bins: int = DriftSettings.psi_bins,
) -> Profile:
    """Profile ``df``: features ``monitored`` and the ``prediction`` column.

    ``row_hash`` names a column of uniformly distributed hex digests, unique per
    row (within ``by``), that decides which values are sampled.
    """
    by, names = list(by), [*monitored, PREDICTION]
    sources = [*monitored, prediction]
    values = df.selectExpr(
        *[quoted(k) for k in by],
        f"{quoted(row_hash)} AS _hash",
        *[f"{finite_sql(source)} AS {quoted(name)}" for source, name in zip(sources, names, strict=True)],
    )
    counts = counts_by_prefix(values, names, "_hash", by)
    samples = sample_values(values, names, "_hash", cap, counts, by)
    return profile_from_samples(monitored, _feature_rows(counts, names, by), samples, by=by, cap=cap, bins=bins)


def profile_from_samples(
    monitored: Sequence[str],
    features: DataFrame,
    samples: DataFrame,
    by: Sequence[str] = (),
    cap: int = SAMPLE_CAP,
    bins: int = DriftSettings.psi_bins,
) -> Profile:
    """A profile from stored samples: ``samples`` (by..., slot, value) and
    ``features`` (by..., slot, feature, n_rows, null_rate, mean)."""
    group = [*by, "slot"]
    points = _cut_points(samples, group, bins)
    listed = F.sort_array(F.collect_list(F.struct("value", "running", "bin")))
    n = F.sum("n")
    summary = points.groupBy(*group).agg(
        n.alias("n_ref"),
        (F.sum(F.col("value") * F.col("n")) / n).alias("sample_mean"),
        F.array(*[F.sum(F.when(F.col("bin") == b, F.col("n")).otherwise(0)) for b in range(bins)]).alias("ref_bins"),
        listed.alias("_points"),
    )
    zero = F.array(F.lit(0).cast("bigint"))
    table = features.join(summary, group, "left").select(
        *group,
        "feature",
        "n_rows",
        "null_rate",
        "mean",
        "sample_mean",
        F.coalesce("n_ref", F.lit(0)).alias("n_ref"),
        F.coalesce("ref_bins", F.array_repeat(F.lit(0).cast("bigint"), bins)).alias("ref_bins"),
        F.col("_points.value").alias("cuts"),
        F.concat(zero, F.col("_points.running")).alias("running"),
        F.concat(zero, F.col("_points.bin")).alias("bins"),
    )
    return Profile(tuple(monitored), table, samples, tuple(by), cap, bins)


def decile_edges(samples: DataFrame, by: Sequence[str], bins: int) -> DataFrame:
    """Distinct quantile edges of each sample, linearly interpolated: by..., edges.

    Exact percentiles hold a group's distinct values in memory, so this is for
    bounded samples only.
    """
    return samples.groupBy(*by).agg(_edges(bins).alias("edges"))


def _cut_points(samples: DataFrame, group: list[str], bins: int) -> DataFrame:
    """One row per cut: group..., value, n, running, bin.

    The samples arrive partitioned by ``group`` from their ranking, so this adds
    no shuffle; a group holds at most a sample's worth of values.
    """
    values = samples.groupBy(*group).agg(_edges(bins).alias("edges"), F.collect_list("value").alias("values"))
    # Fewer than three distinct edges leave no inner one: a single bin, PSI 0.
    inner = F.when(F.size("edges") > 2, F.slice("edges", F.lit(2), F.size("edges") - 2)).otherwise(
        F.array().cast("array<double>")
    )
    marked = values.select(*group, "values", inner.alias("inner")).select(
        *group,
        F.posexplode(F.concat("values", "inner")).alias("_at", "value"),
        F.size("values").alias("_size"),
    )
    counted = marked.groupBy(*group, "value").agg(
        F.count_if(F.col("_at") < F.col("_size")).alias("n"),
        F.max((F.col("_at") >= F.col("_size")).cast("int")).alias("_edge"),
    )
    running = Window.partitionBy(*group).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return counted.select(
        *group, "value", "n", F.sum("n").over(running).alias("running"), F.sum("_edge").over(running).alias("bin")
    )


def _edges(bins: int) -> Column:
    at = [F.lit(float(i) / bins) for i in range(bins + 1)]
    return F.array_distinct(F.percentile("value", F.array(*at)))


def missing_rates(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Share of missing values per column over all rows: by..., feature, n_rows, null_rate."""
    columns, by = list(columns), list(by)
    counts = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.expr(f"array({', '.join(f'count({finite_sql(c)})' for c in columns)})").alias("counts"),
    )
    return _feature_rows(counts, columns, by).select(*by, "feature", "n_rows", "null_rate")


def _feature_rows(counts: DataFrame, names: list[str], by: list[str]) -> DataFrame:
    """Per-feature totals of partial counts: by..., slot, feature, n_rows, null_rate, mean.

    ``mean`` is that of the last name, from the column ``total``; NULL elsewhere.
    """
    n_rows, n = F.sum("n_rows"), F.sum("_n")
    total = F.sum("total") if "total" in counts.columns else F.lit(None).cast("double")
    return (
        counts.select(*by, *[c for c in ("n_rows", "total") if c in counts.columns], F.posexplode("counts").alias("slot", "_n"))
        .groupBy(*by, "slot")
        .agg(
            n_rows.alias("n_rows"),
            F.try_divide(n_rows - n, n_rows).alias("null_rate"),
            F.when(F.col("slot") == len(names) - 1, F.try_divide(total, n)).alias("mean"),
        )
        .withColumn("feature", F.element_at(F.lit(names), F.col("slot") + 1))
    )
