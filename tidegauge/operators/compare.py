"""Comparison of batches with a baseline profile.

The batch is read once: unpivoted, located between the profile's cut points and
counted per cell. Everything after that works on the counts, whose number is
bounded by the profile, so a hot value or a batch of any size changes nothing.

Cell numbers of a feature with cut points c1 < ... < cn: 2i-1 is "equals ci",
2i is "between ci and ci+1", 0 is "below c1" and -1 is "missing".
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.kolmogorov import exact_ks_pvalue, with_ks_pvalue
from tidegauge.functions.missing import finite, quoted
from tidegauge.functions.search import count_at_most
from tidegauge.operators.profile import PREDICTION, Profile
from tidegauge.settings import DriftSettings

MISSING_CELL = -1
CUT_BYTES = 8
BROADCAST_AT_MOST = 256 * 1024 * 1024


def cell_counts(batch: DataFrame, profile: Profile, prediction: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Rows per feature and cell: by..., slot, cell, n, total.

    Monitored features the batch lacks are skipped (see :func:`missing_columns`).
    ``by`` must include the profile's own key columns. ``total`` is the sum of
    the cell's values. Works on streams too: it is one aggregation.
    """
    return located(batch, profile, prediction, by).groupBy(*by, "slot", "cell").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")
    )


def located(batch: DataFrame, profile: Profile, prediction: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """One row per batch row and feature: by..., slot, value, cell.

    The profile's cut points are broadcast. If they could exceed the bound, the
    features go in blocks that keep within it; each block reads its own columns.
    """
    slots = len(profile.monitored) + 1
    block = max(1, BROADCAST_AT_MOST // (profile.capacity * CUT_BYTES))
    blocks = [range(first, min(first + block, slots)) for first in range(0, slots, block)]
    return reduce(DataFrame.unionAll, [_located(batch, profile, prediction, by, b) for b in blocks])


def _located(batch: DataFrame, profile: Profile, prediction: str | None, by: Sequence[str], slots: range) -> DataFrame:
    cuts = profile.table.select(*profile.by, "slot", "cuts").where(F.col("slot").between(slots.start, slots.stop - 1))
    tall = _unpivot(batch, profile, prediction, by, slots).join(F.broadcast(cuts), [*profile.by, "slot"])
    found = count_at_most(tall, "cuts", "value", profile.capacity, "_at_most")
    cell = F.expr(
        f"CASE WHEN value IS NULL THEN {MISSING_CELL}"
        " WHEN get(cuts, _at_most - 1) = value THEN 2 * _at_most - 1 ELSE 2 * _at_most END"
    )
    return found.select(*by, "slot", "value", cell.alias("cell"))


def missing_columns(batch: DataFrame, profile: Profile) -> list[str]:
    """Monitored features the batch does not have."""
    return [f for f in profile.monitored if f not in batch.columns]


def feature_rows(
    cells: DataFrame, profile: Profile, by: Sequence[str] = (), settings: DriftSettings = DriftSettings()
) -> DataFrame:
    """Statistics and flags per batch and feature, the prediction included.

    Columns: by..., slot, feature, n_rows, n_ref, n_cur, ks_stat, p_raw, psi,
    null_rate, null_delta, sig_none, sig_bonferroni, sig_bh, null_shift, flagged,
    mean, sample_mean. The correction covers a batch's monitored features.
    """
    by = list(by)
    group = [*by, "slot"]
    running = Window.partitionBy(*group).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*group)
    present = F.when(F.col("cell") != MISSING_CELL, F.col("n")).otherwise(F.lit(0))
    stepped = (
        cells.withColumn("_n", present)
        .withColumn("_running", F.sum("_n").over(running))
        .withColumn("_all", F.sum("_n").over(whole))
    )
    ref = profile.table.select(*profile.by, "slot", "running", "bins", F.col("n_ref").alias("_n_ref"))
    # Joined on counts, not on rows, so any join will do where the profile is too big to broadcast.
    fits = (len(profile.monitored) + 1) * profile.capacity * 2 * CUT_BYTES <= BROADCAST_AT_MOST
    placed = stepped.join(F.broadcast(ref) if fits else ref, [*profile.by, "slot"])
    # Between two cells with rows only the reference steps, so the largest gap lies
    # at a cell or right before one.
    gap = F.expr(
        "CASE WHEN _n > 0 THEN greatest("
        "abs(get(running, shiftright(cell + 1, 1)) / _n_ref - _running / _all),"
        "abs(get(running, shiftright(cell, 1)) / _n_ref - (_running - _n) / _all)) END"
    )
    bin_ = F.expr("CASE WHEN _n > 0 THEN get(bins, shiftright(cell + 1, 1)) END")
    stats = (
        placed.select(*group, "n", "_n", "total", gap.alias("_gap"), bin_.alias("_bin"))
        .groupBy(*group)
        .agg(
            F.sum("n").alias("n_rows"),
            F.sum("_n").alias("n_cur"),
            F.max("_gap").alias("_gap"),
            F.try_divide(F.sum("total"), F.sum("_n")).alias("mean"),
            *[F.sum(F.when(F.col("_bin") == b, F.col("_n")).otherwise(0)).alias(f"_bin{b}") for b in range(profile.bins)],
        )
    )
    described = profile.table.select(
        *profile.by, "slot", "feature", "n_ref", "ref_bins", F.col("null_rate").alias("_base_null"), "sample_mean"
    )
    joined = stats.join(F.broadcast(described), [*profile.by, "slot"])
    return flag_rows(with_statistics(joined, profile.bins, settings), by, settings)


def compare(
    batch: DataFrame,
    profile: Profile,
    prediction: str | None = None,
    by: Sequence[str] = (),
    settings: DriftSettings = DriftSettings(),
) -> DataFrame:
    """Compare every batch in ``batch`` (one per value of ``by``) with its profile."""
    return feature_rows(cell_counts(batch, profile, prediction, by), profile, by, settings)


def features_only(rows: DataFrame) -> DataFrame:
    """The monitored features' rows, without the prediction's."""
    return rows.where(F.col("feature") != PREDICTION)


def verdict(
    rows: DataFrame,
    by: Sequence[str] = (),
    settings: DriftSettings = DriftSettings(),
    missing: Sequence[str] = (),
    batch: DataFrame | None = None,
) -> DataFrame:
    """One row per batch: counts, shares, prediction drift, ``drifted`` and ``reasons``.

    ``missing`` lists monitored features the batches lack, for the report. With
    ``batch``, the rows that were compared, every batch in it has a verdict and its
    row count, even one that shares no column with the profile.
    """
    is_feature = F.col("feature") != PREDICTION
    is_prediction = ~is_feature
    first = F.struct("psi", -F.col("slot"), "feature")
    worst = F.struct("null_delta", -F.col("slot"), "feature")
    summed = rows.groupBy(*by).agg(
        F.max("n_rows").alias("n_rows"),
        F.count_if(is_feature).alias("n_features"),
        F.count_if(is_feature & F.col("flagged")).alias("n_flagged"),
        F.count_if(is_feature & F.col("null_shift")).alias("n_null_shift"),
        F.coalesce(F.max(F.when(is_feature, F.col("null_delta"))), F.lit(0.0)).alias("max_null_delta"),
        F.max(F.when(is_feature, worst))["feature"].alias("worst_null_feature"),
        F.max(F.when(is_feature, first))["feature"].alias("top_feature"),
        F.coalesce(F.max(F.when(is_feature, F.col("psi"))), F.lit(0.0)).alias("top_psi"),
        F.coalesce(F.max(F.when(is_prediction, F.col("psi"))), F.lit(0.0)).alias("pred_psi"),
        F.max(F.when(is_prediction, F.col("sample_mean"))).alias("pred_mean_baseline"),
        F.max(F.when(is_prediction, F.col("mean"))).alias("pred_mean_batch"),
    )
    if batch is not None:
        summed = _every_batch(summed, batch, by)
    shared = summed.withColumn(
        "share_flagged", F.col("n_flagged") / F.greatest(F.col("n_features"), F.lit(1))
    )
    return (
        shared.withColumn("reasons", _reasons(settings))
        .withColumn("drifted", F.size("reasons") > 0)
        .withColumn("missing_columns", F.array(*[F.lit(c) for c in missing]).cast("array<string>"))
    )


def _every_batch(summed: DataFrame, batch: DataFrame, by: Sequence[str]) -> DataFrame:
    """``summed`` with a row for each batch, counts and shares 0 where nothing was compared."""
    sizes = batch.groupBy(*by).agg(F.count(F.lit(1)).alias("_n_rows"))
    own = summed.toDF(*[f"_{c}" if c in by else c for c in summed.columns])
    on = [sizes[c].eqNullSafe(own[f"_{c}"]) for c in by]
    joined = sizes.join(own, on, "left") if by else sizes.join(own, how="left")
    zero = {"n_features", "n_flagged", "n_null_shift", "max_null_delta", "top_psi", "pred_psi"}
    filled = {c: F.coalesce(F.col(c), F.lit(0).cast(summed.schema[c].dataType)) for c in zero}
    return joined.withColumns(filled | {"n_rows": F.col("_n_rows")}).select(*summed.columns)


def top_drifted(rows: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` features with the largest PSI; rank in the profile settles ties."""
    return features_only(rows).orderBy(F.desc("psi"), "slot").limit(k)


def worst_missing(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per batch the feature whose missing rate moved most: by..., feature, null_delta."""
    best = F.max(F.struct("null_delta", -F.col("slot"), "feature"))
    return (
        features_only(rows)
        .groupBy(*by)
        .agg(best.alias("_best"))
        .select(*by, F.col("_best.feature").alias("feature"), F.col("_best.null_delta").alias("null_delta"))
    )


def psi_terms(expected: Sequence[Column], actual: Sequence[Column], floor: float) -> Column:
    """PSI from shares per bin; shares are floored, not scaled back to 1.

    A bin that is empty on both sides adds 0, so absent bins need no rows.
    """
    total = F.lit(0.0)
    for e, a in zip(expected, actual, strict=True):
        e, a = F.greatest(e, F.lit(floor)), F.greatest(a, F.lit(floor))
        total = total + (a - e) * F.log(a / e)
    return total


def with_significance(df: DataFrame, p: str, by: Sequence[str], alpha: float) -> DataFrame:
    """Add ``sig_none``, ``sig_bonferroni`` and ``sig_bh`` for the tests of each group.

    Groups hold one row per monitored feature, a few dozen. Benjamini-Hochberg
    passes the ranks up to the largest rank k with p(k) <= alpha k / n.
    """
    group = Window.partitionBy(*by)
    tests = F.count(F.lit(1)).over(group)
    kept = df.columns
    ranked = df.withColumn("_rank", F.row_number().over(group.orderBy(p))).withColumn("_tests", tests)
    within = F.max(F.when(F.col(p) <= alpha * F.col("_rank") / F.col("_tests"), F.col("_rank"))).over(group)
    return ranked.withColumn("_last", F.coalesce(within, F.lit(0))).select(
        *kept,
        (F.col(p) <= alpha).alias("sig_none"),
        (F.col(p) <= alpha / F.col("_tests")).alias("sig_bonferroni"),
        (F.col("_rank") <= F.col("_last")).alias("sig_bh"),
    )


def _unpivot(
    batch: DataFrame, profile: Profile, prediction: str | None, by: Sequence[str], slots: range
) -> DataFrame:
    present = set(batch.columns)
    columns = [f if f in present else None for f in profile.monitored] + [prediction]
    absent = [slot for slot in slots if columns[slot] is None]
    values = ["CAST(NULL AS DOUBLE)" if c is None else f"try_cast({quoted(c)} AS DOUBLE)" for c in columns]
    chosen = F.expr(f"array({', '.join(values[slots.start : slots.stop])})")
    tall = batch.select(*by, F.posexplode(chosen).alias("slot", "value"))
    if slots.start:
        tall = tall.withColumn("slot", F.col("slot") + slots.start)
    wanted = tall.where(~F.col("slot").isin(absent)) if absent else tall
    return wanted.select(*by, "slot", finite(F.col("value")).alias("value"))


def with_statistics(df: DataFrame, bins: int, settings: DriftSettings) -> DataFrame:
    """KS, PSI and missing-rate columns from counts: feature, n_rows, n_ref, n_cur, ref_bins, _bin<b>, _gap, _base_null."""
    fewest = F.least("n_ref", "n_cur")
    is_feature = F.col("feature") != PREDICTION
    # Features need enough values for a test; the prediction has PSI only.
    enough = F.when(is_feature, fewest >= settings.min_finite).otherwise(fewest >= 2)
    psi = psi_terms(
        [F.try_divide(F.get("ref_bins", F.lit(b)), F.col("n_ref")) for b in range(bins)],
        [F.try_divide(F.col(f"_bin{b}"), F.col("n_cur")) for b in range(bins)],
        settings.share_floor,
    )
    tested = (
        df.withColumn("_enough", enough)
        .withColumn("ks_stat", F.when(F.col("_enough"), F.col("_gap")).otherwise(F.lit(0.0)))
        .withColumn("psi", F.when(F.col("_enough"), psi).otherwise(F.lit(0.0)))
        .withColumn("null_rate", (F.col("n_rows") - F.col("n_cur")) / F.col("n_rows"))
    )
    valued = with_ks_pvalue(tested, "ks_stat", "n_ref", "n_cur", "_p")
    if settings.ks_exact_at_most:
        exact = exact_ks_pvalue("ks_stat", "n_ref", "n_cur", settings.ks_exact_at_most)
        valued = valued.withColumn("_p", F.coalesce(exact, F.col("_p")))
    return valued.withColumn(
        "p_raw", F.when(F.col("_enough"), F.col("_p")).otherwise(F.lit(1.0))
    ).withColumn("null_delta", F.coalesce(F.abs(F.col("null_rate") - F.col("_base_null")), F.lit(0.0)))


def flag_rows(df: DataFrame, by: list[str], settings: DriftSettings) -> DataFrame:
    """The rows of :func:`with_statistics` with significance and flags."""
    roles = df.withColumn("_prediction", F.col("feature") == PREDICTION)
    tested = with_significance(roles, "p_raw", [*by, "_prediction"], settings.alpha)
    shifted = tested.withColumn("null_shift", F.col("null_delta") >= settings.null_jump)
    return shifted.withColumn("flagged", flagged_under(settings.correction, settings)).select(
        *by,
        "slot",
        "feature",
        "n_rows",
        "n_ref",
        "n_cur",
        "ks_stat",
        "p_raw",
        "psi",
        "null_rate",
        "null_delta",
        "sig_none",
        "sig_bonferroni",
        "sig_bh",
        "null_shift",
        "flagged",
        "mean",
        "sample_mean",
    )


def flagged_under(correction: str, settings: DriftSettings = DriftSettings()) -> Column:
    """Significant after ``correction`` and large enough, or a missing-rate shift."""
    return (F.col(f"sig_{correction}") & (F.col("psi") >= settings.psi_moderate)) | F.col("null_shift")


def _reasons(settings: DriftSettings) -> Column:
    # Percentages round half to even, so scale and round before formatting.
    def percent(value: Column) -> Column:
        return F.format_string("%.1f%%", F.rint(value * 1000) / 10)

    limit = f"{settings.batch_share:.0%}"
    return F.array_compact(
        F.array(
            F.when(
                F.col("n_null_shift") > 0,
                F.concat(
                    F.col("n_null_shift").cast("string"),
                    F.lit(" feature(s) changed missing rate, worst "),
                    F.col("worst_null_feature"),
                    F.lit(" by "),
                    percent(F.col("max_null_delta")),
                ),
            ),
            F.when(
                F.col("share_flagged") >= settings.batch_share,
                F.concat(
                    F.col("n_flagged").cast("string"),
                    F.lit("/"),
                    F.col("n_features").cast("string"),
                    F.lit(" monitored features drifted ("),
                    percent(F.col("share_flagged")),
                    F.lit(f" >= {limit})"),
                ),
            ),
            F.when(
                F.col("pred_psi") >= settings.psi_major,
                F.concat(
                    F.lit("prediction distribution PSI "),
                    F.format_string("%.3f", F.col("pred_psi")),
                    F.lit(f" >= {settings.psi_major}"),
                ),
            ),
        )
    )
