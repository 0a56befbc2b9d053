"""Comparison with all values of a baseline, without a sample, a cap or a stored profile.

Both sides are counted per feature and value. Ranges of values spread the running counts
over tasks, and one ordered pass over the values of either side gives KS, the exact
quantile edges and PSI. What is shuffled are different values, never rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.missing import finite_sql, quoted
from tidegauge.operators.compare import flag_rows, with_statistics
from tidegauge.operators.profile import PREDICTION
from tidegauge.operators.running import with_running
from tidegauge.session import stored
from tidegauge.settings import DriftSettings


def value_counts(df: DataFrame, columns: Sequence[str | None], by: Sequence[str] = ()) -> DataFrame:
    """by..., slot (place in ``columns``), value, n; a null value stands for all missing ones.

    A column that is None is left out.
    """
    given = [(i, c) for i, c in enumerate(columns) if c is not None]
    pairs = [f"struct({i} AS slot, {finite_sql(c)} AS value)" for i, c in given]
    keys = ", ".join(quoted(k) for k in by)
    tall = df.select(*[F.expr(quoted(k)) for k in by], F.expr(f"inline(array({', '.join(pairs)}))")) if keys else df.select(
        F.expr(f"inline(array({', '.join(pairs)}))")
    )
    return tall.groupBy(*by, "slot", "value").agg(F.count(F.lit(1)).alias("n"))


def exact_compare(
    baseline: DataFrame,
    batch: DataFrame,
    monitored: Sequence[str],
    prediction: str,
    by: Sequence[str] = (),
    settings: DriftSettings = DriftSettings(),
) -> DataFrame:
    """Compare every batch in ``batch`` (one per value of ``by``) with all of ``baseline``.

    The columns are those of :func:`~tidegauge.operators.compare.feature_rows`; ``n_ref``
    counts all finite values of the baseline. Monitored features the batch lacks are skipped.
    """
    by, bins = list(by), settings.psi_bins
    names = [*monitored, PREDICTION]
    sources = [*monitored, prediction]
    reference = stored(value_counts(baseline, sources), "baseline_counts")
    present = [c if c in batch.columns else None for c in sources]
    counted = stored(value_counts(batch, present, by), "batch_counts")

    # Every value of either side, with the reference's running count at it.
    points = (
        reference.where("value IS NOT NULL")
        .select("slot", "value", F.col("n").alias("r"))
        .unionAll(counted.where("value IS NOT NULL").select("slot", "value", F.lit(0).cast("bigint")))
        .groupBy("slot", "value")
        .agg(F.sum("r").alias("r"))
    )
    ranked = stored(with_running(points, ["slot"], ["value"], {"before": "r"}, {"n_ref": "r"}), "reference_ranks")
    # One row of bins - 1 numbers per feature.
    edges = stored(inner_edges(ranked, bins), "edges")
    described = _described(reference, ranked, edges, names, bins)

    values = counted.where("value IS NOT NULL").join(
        ranked.select("slot", "value", "r", "before", "n_ref"), ["slot", "value"]
    )
    stepped = with_running(values, [*by, "slot"], ["value"], {"seen": "n"}, {"n_cur": "n"})
    gap = F.greatest(
        F.abs(F.try_divide(F.col("before") + F.col("r"), F.col("n_ref")) - (F.col("seen") + F.col("n")) / F.col("n_cur")),
        F.abs(F.try_divide(F.col("before"), F.col("n_ref")) - F.col("seen") / F.col("n_cur")),
    )
    placed = _binned(stepped, edges, bins).select(
        *by, "slot", "n", F.col("n").alias("_n"), gap.alias("_gap"), "_bin", (F.col("value") * F.col("n")).alias("_total")
    )
    missing = counted.where("value IS NULL").select(
        *by, "slot", "n", F.lit(0).cast("bigint"), F.lit(None).cast("double"), F.lit(None).cast("int"), F.lit(None).cast("double")
    )
    stats = (
        placed.unionAll(missing)
        .groupBy(*by, "slot")
        .agg(
            F.sum("n").alias("n_rows"),
            F.sum("_n").alias("n_cur"),
            F.max("_gap").alias("_gap"),
            F.try_divide(F.sum("_total"), F.sum("_n")).alias("mean"),
            *[F.sum(F.when(F.col("_bin") == b, F.col("_n")).otherwise(0)).alias(f"_bin{b}") for b in range(bins)],
        )
    )
    return flag_rows(with_statistics(stats.join(F.broadcast(described), "slot"), bins, settings), by, settings)


def inner_edges(ranked: DataFrame, bins: int, by: Sequence[str] = ("slot",)) -> DataFrame:
    """by..., edges: the distinct quantile edges of each group without the outer two, linearly interpolated.

    ``ranked`` holds value, r (rows with it), before (rows below it) and n_ref (all rows).
    The rows at the two positions around a quantile are found by their running counts; a
    group has none of fewer than three distinct edges.
    """
    last = (F.col("n_ref") - 1).cast("double")
    places = [last * F.lit(i / bins) for i in range(bins + 1)]

    def holds(position: Column) -> Column:
        return (F.col("r") > 0) & (position >= F.col("before")) & (position < F.col("before") + F.col("r"))

    found = [
        F.when(
            holds(F.floor(p)) | holds(F.ceil(p)),
            F.struct(
                F.lit(i).alias("i"),
                (p - F.floor(p)).alias("share"),
                F.when(holds(F.floor(p)), F.col("value")).alias("low"),
                F.when(holds(F.ceil(p)), F.col("value")).alias("high"),
            ),
        )
        for i, p in enumerate(places)
    ]
    # Most rows lie at no quantile: a look at the first and last one they could reach tells.
    reach = [F.try_divide((F.col("before") + c) * F.lit(float(bins)), last) for c in (F.lit(-1), F.col("r"))]
    can = F.coalesce(F.ceil(reach[0] - 1e-6) <= F.floor(reach[1] + 1e-6), F.lit(True))
    met = ranked.where(F.col("r") > 0).where(can).select(*by, F.explode(F.array_compact(F.array(*found))).alias("e"))
    ends = met.groupBy(*by, "e.i").agg(F.max("e.low").alias("low"), F.max("e.high").alias("high"), F.max("e.share").alias("share"))
    edge = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(
        F.col("low") + (F.col("high") - F.col("low")) * F.col("share")
    )
    # At most bins + 1 numbers per group.
    listed = ends.groupBy(*by).agg(F.array_sort(F.collect_set(edge)).alias("edges"))
    inner = F.when(F.size("edges") > 2, F.slice("edges", F.lit(2), F.size("edges") - 2))
    return listed.select(*by, F.coalesce(inner, F.array().cast("array<double>")).alias("edges"))


def _binned(df: DataFrame, edges: DataFrame, bins: int) -> DataFrame:
    """``df`` with ``_bin``: how many inner edges of its slot lie at or below the value."""
    passed = [F.coalesce((F.get("edges", F.lit(i)) <= F.col("value")).cast("int"), F.lit(0)) for i in range(bins - 1)]
    return df.join(F.broadcast(edges), "slot", "left").withColumn("_bin", sum(passed[1:], passed[0])).drop("edges")


def _described(reference: DataFrame, ranked: DataFrame, edges: DataFrame, names: Sequence[str], bins: int) -> DataFrame:
    """One row per feature: slot, feature, n_ref, ref_bins, the missing rate and the mean of all values."""
    finite = F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)
    whole = reference.groupBy("slot").agg(
        F.sum(finite).alias("n_ref"),
        (1 - F.sum(finite) / F.sum("n")).alias("_base_null"),
        F.try_divide(F.sum(F.col("value") * F.col("n")), F.sum(finite)).alias("sample_mean"),
    )
    counts = _binned(ranked.where("r > 0"), edges, bins).groupBy("slot").agg(
        F.array(*[F.sum(F.when(F.col("_bin") == b, F.col("r")).otherwise(0)) for b in range(bins)]).alias("ref_bins")
    )
    none = F.array_repeat(F.lit(0).cast("bigint"), bins)
    return whole.join(counts, "slot", "left").select(
        "slot",
        F.element_at(F.lit(list(names)), F.col("slot") + 1).alias("feature"),
        "n_ref",
        F.coalesce("ref_bins", none).alias("ref_bins"),
        "_base_null",
        "sample_mean",
    )


def categorical_psi(
    baseline: DataFrame,
    batch: DataFrame,
    columns: Sequence[str],
    by: Sequence[str] = (),
    settings: DriftSettings = DriftSettings(),
) -> DataFrame:
    """PSI by exact value: by..., feature, n_ref, n_cur, n_values, psi.

    Each value of a listed column, as text, is a bin of its own, so two values or a few are
    enough. Shares are those among values that are not null; a value of one side only takes
    the floor of shares on the other. PSI is null for a column without values in the baseline;
    one without values in a batch has no row there.
    """
    by = list(by)

    def shares(df: DataFrame, keys: Sequence[str], into: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns])
        return df.select(*keys, F.inline(pairs)).where("value IS NOT NULL").groupBy(*keys, "feature", "value").agg(F.count(F.lit(1)).alias(into))

    floor = F.lit(settings.share_floor)

    def term(e: Column, a: Column) -> Column:
        return (a - e) * F.log(a / e)

    reference = shares(baseline, [], "r")
    whole = reference.groupBy("feature").agg(F.sum("r").alias("n_ref"))
    expected = F.greatest(F.col("r") / F.col("n_ref"), floor)
    reference = stored(reference.join(whole, "feature").withColumn("e", expected), "baseline_categories")
    # What PSI would be if a batch had no value at all; each value it has replaces its own part.
    none = reference.groupBy("feature").agg(
        F.max("n_ref").alias("n_ref"), F.count(F.lit(1)).alias("n_known"), F.sum(term(F.col("e"), floor)).alias("absent")
    )
    current = stored(shares(batch, by, "c"), "batch_categories")
    sizes = current.groupBy(*by, "feature").agg(F.sum("c").alias("n_cur"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*by, "feature"]]
    named = sizes.select(*[F.col(k).alias(f"_{k}") for k in [*by, "feature"]], "n_cur")
    actual = F.greatest(F.col("c") / F.col("n_cur"), floor)
    moved = current.join(named, same).select(*by, "feature", "value", "n_cur", actual.alias("a"))
    moved = moved.join(reference.select("feature", "value", "e"), ["feature", "value"], "left")
    change = F.coalesce(term(F.col("e"), F.col("a")) - term(F.col("e"), floor), term(floor, F.col("a")))
    summed = moved.groupBy(*by, "feature", "n_cur").agg(F.sum(change).alias("change"), F.count_if(F.col("e").isNull()).alias("n_new"))
    return summed.join(none, "feature", "left").select(
        *by,
        "feature",
        F.coalesce("n_ref", F.lit(0)).alias("n_ref"),
        "n_cur",
        (F.coalesce("n_known", F.lit(0)) + F.col("n_new")).alias("n_values"),
        (F.col("absent") + F.col("change")).alias("psi"),
    )
