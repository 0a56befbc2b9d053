"""Checks of the monitor itself: null experiment, later windows, what-if backtest."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.missing import finite_sql
from tidegauge.operators.compare import (
    BROADCAST_AT_MOST,
    compare,
    flag_rows,
    flagged_under,
    missing_columns,
    verdict,
    with_statistics,
)
from tidegauge.operators.exact import inner_edges
from tidegauge.operators.ordering import RowOrder, Splits, baseline_windows
from tidegauge.operators.profile import PREDICTION, Profile
from tidegauge.operators.ranking import roc_auc
from tidegauge.operators.running import with_running
from tidegauge.operators.sampling import half_marks, last_sampled, row_hash, trial_hash
from tidegauge.operators.whatif import Scenario
from tidegauge.session import stored
from tidegauge.settings import (
    BASELINE_FRACTION,
    CORRECTIONS,
    N_TRIALS,
    N_WINDOWS,
    SAMPLE_CAP,
    SEED,
    DriftSettings,
)

TRIALS_AT_ONCE = 20  # each takes columns of its own
DIGEST_BYTES = 64


def null_experiment(
    df: DataFrame,
    monitored: Sequence[str],
    prediction: str,
    row_key: Sequence[str | Column],
    trials: int = N_TRIALS,
    seed: int = SEED,
    cap: int = SAMPLE_CAP,
    settings: DriftSettings = DriftSettings(),
) -> DataFrame:
    """How much the monitor flags between random halves of the same rows.

    One row per trial and correction: trial, correction, n_flagged,
    ks_only_flagged (significant before any correction), sig_corrected,
    n_monitored, batch_drifted. The first half of a trial gives up to ``cap`` values a
    feature, those of the lowest digests; all values of the second are compared with them.
    Each value is counted once, with its rows in every trial's first half and sample, and
    one ordered pass serves all trials. Only a digest for each trial and feature is
    broadcast; trials go side by side as long as those fit the broadcast bound, else in as
    few blocks as needed.
    """
    rows = df.select(*_key_columns(df, row_key), *monitored, prediction)
    middles = half_marks(rows, row_key, trials, seed)
    block = min(TRIALS_AT_ONCE, max(1, BROADCAST_AT_MOST // ((len(monitored) + 1) * DIGEST_BYTES)))
    blocks = [
        _null_block(rows, monitored, prediction, row_key, range(first, min(first + block, trials)), middles, seed, cap, settings)
        for first in range(0, trials, block)
    ]
    return reduce(DataFrame.unionByName, blocks)


def _key_columns(df: DataFrame, row_key: Sequence[str | Column]) -> list[str]:
    return [k for k in row_key if isinstance(k, str)]


def _null_block(
    rows: DataFrame,
    monitored: Sequence[str],
    prediction: str,
    row_key: Sequence[str | Column],
    trials: range,
    middles: Mapping[int, str],
    seed: int,
    cap: int,
    settings: DriftSettings,
) -> DataFrame:
    sources = [*monitored, prediction]
    values = [F.expr(finite_sql(c)).alias(f"v{i}") for i, c in enumerate(sources)]
    firsts = [F.coalesce(trial_hash(seed, t, *row_key) < F.lit(middles.get(t)).cast("string"), F.lit(False)) for t in trials]
    hashes = [F.struct(F.lit(t).alias("trial"), F.when(first, trial_hash(seed, t, *row_key)).alias("hash")) for t, first in zip(trials, firsts)]
    # The digest of a row where it is in the first half, else NULL.
    hashed = rows.select(*values, F.array(*hashes).alias("_hashes"))
    names = [f"v{i}" for i in range(len(sources))]
    halves = hashed.select(*names, F.inline("_hashes")).where("hash IS NOT NULL")
    last = last_sampled(halves, names, "hash", cap, ["trial"])
    # At most one digest per trial and feature; none means that all values are in the sample.
    reach = stored(
        last.groupBy("slot").agg(F.array(*[F.max(F.when(F.col("trial") == t, F.col("last"))) for t in trials]).alias("_reach")),
        "trial_reach",
    )
    pairs = [f"struct({i} AS slot, {v} AS value)" for i, v in enumerate(names)]
    tall = hashed.select(F.col("_hashes.hash").alias("_at"), F.expr(f"inline(array({', '.join(pairs)}))"))
    tall = tall.join(F.broadcast(reach), "slot", "left")

    def counts(i: int, t: int) -> list[Column]:
        hash_, reached = F.get("_at", F.lit(i)), F.get("_reach", F.lit(i))
        return [
            F.count(hash_).alias(f"f{t}"),
            F.count_if(hash_.isNotNull() & F.coalesce(hash_ <= reached, F.lit(True))).alias(f"s{t}"),
        ]

    counted = stored(
        tall.groupBy("slot", "value").agg(F.count(F.lit(1)).alias("n"), *[c for i, t in enumerate(trials) for c in counts(i, t)]),
        "trial_counts",
    )
    return _outcomes(_trial_rows(counted, trials, [*monitored, PREDICTION], "s", settings), settings)


def _outcomes(rows: DataFrame, settings: DriftSettings) -> DataFrame:
    """One row per trial and correction from the feature rows of all trials."""
    outcomes = [
        F.struct(
            F.lit(c).alias("correction"),
            F.col(f"sig_{c}").alias("sig_corrected"),
            flagged_under(c, settings).alias("outcome"),
        )
        for c in CORRECTIONS
    ]
    tall = rows.withColumn("_o", F.explode(F.array(*outcomes)))
    feature = F.col("feature") != PREDICTION
    n_flagged = F.count_if(feature & F.col("_o.outcome"))
    counted = tall.groupBy("trial", F.col("_o.correction").alias("correction")).agg(
        n_flagged.alias("n_flagged"),
        F.count_if(feature & F.col("sig_none")).alias("ks_only_flagged"),
        F.count_if(feature & F.col("_o.sig_corrected")).alias("sig_corrected"),
        F.count_if(feature).alias("n_monitored"),
        F.max(feature & F.col("null_shift")).alias("_null"),
        F.max(F.when(~feature, F.col("psi"))).alias("_psi"),
    )
    drifted = (
        F.col("_null")
        | (F.col("n_flagged") / F.greatest(F.col("n_monitored"), F.lit(1)) >= settings.batch_share)
        | (F.coalesce("_psi", F.lit(0.0)) >= settings.psi_major)
    )
    return counted.withColumn("batch_drifted", drifted).drop("_null", "_psi")


def exact_null_experiment(
    df: DataFrame,
    monitored: Sequence[str],
    prediction: str,
    row_key: Sequence[str | Column],
    trials: int = N_TRIALS,
    seed: int = SEED,
    settings: DriftSettings = DriftSettings(),
) -> DataFrame:
    """The null experiment on all values, without a copy of the rows for each trial.

    A bit of the row's digest says which half of a trial it is in, so halves are random and
    of about equal size. Every value is counted once, with a count for each trial, and
    one ordered pass over the values serves all trials. The columns are those of
    :func:`null_experiment`.
    """
    if trials > DIGEST_BITS:
        raise ValueError(f"a digest has bits for {DIGEST_BITS} trials")
    names, bins = [*monitored, PREDICTION], settings.psi_bins
    halves = df.withColumn("_first", half_bits(row_hash(seed, *row_key), trials))
    pairs = [f"struct({i} AS slot, {finite_sql(c)} AS value)" for i, c in enumerate([*monitored, prediction])]
    tall = halves.select("_first", F.expr(f"inline(array({', '.join(pairs)}))"))
    counted = stored(
        tall.groupBy("slot", "value").agg(
            F.count(F.lit(1)).alias("n"), *[F.sum(F.get("_first", F.lit(t))).alias(f"f{t}") for t in range(trials)]
        ),
        "trial_counts",
    )
    return _outcomes(_trial_rows(counted, range(trials), names, "f", settings), settings)


def _trial_rows(
    counted: DataFrame, trials: Sequence[int], names: Sequence[str], reference: str, settings: DriftSettings
) -> DataFrame:
    """Feature rows of all trials: each trial's second half against its reference.

    ``counted`` has one row per slot and value (NULL: missing): n (rows) and for each trial
    f<t> (rows of its first half) and <reference><t> (those of them it compares with).
    """
    bins = settings.psi_bins
    refs = [f"{reference}{t}" for t in trials]
    counts = ["n", *dict.fromkeys([*[f"f{t}" for t in trials], *refs])]
    values = counted.where("value IS NOT NULL")
    sampled = values.where(" + ".join(refs) + " > 0").select("slot", "value", *refs)
    ranked = with_running(sampled, ["slot"], ["value"], {f"b_{c}": c for c in refs}, {f"t_{c}": c for c in refs})
    one = [
        F.struct(
            F.lit(t).alias("trial"), F.col(c).alias("r"), F.col(f"b_{c}").alias("before"), F.col(f"t_{c}").alias("n_ref")
        )
        for t, c in zip(trials, refs)
    ]
    edges = inner_edges(ranked.select("slot", "value", F.inline(F.array(*one))).where("r > 0"), bins, ["slot", "trial"])
    edges = stored(edges.select("slot", "trial", F.explode_outer("edges").alias("value")), "trial_edges")
    # The edges go among the values, each before the rows that equal it: what lies below each of them.
    marks = edges.where("value IS NOT NULL").select("slot", "value").distinct()
    zeros = [F.lit(0).cast("bigint").alias(c) for c in counts]
    points = values.select("slot", "value", F.lit(1).alias("_kind"), *counts).unionByName(
        marks.select("slot", "value", F.lit(0).alias("_kind"), *zeros)
    )
    sums = {f"b_{c}": c for c in counts}
    stepped = with_running(points, ["slot"], ["value", "_kind"], sums, {f"t_{c}": c for c in counts})
    at_edge = F.when(
        F.col("_kind") == 0,
        F.struct(
            "value",
            F.array(*[F.col(f"b_{c}") for c in refs]).alias("ref"),
            F.array(*[F.col("b_n") - F.col(f"b_f{t}") for t in trials]).alias("cur"),
        ),
    )
    # At most bins - 1 edges for each feature and trial.
    passed = stored(
        stepped.groupBy("slot").agg(F.collect_list(at_edge).alias("edges"), *[_gap(t, c) for t, c in zip(trials, refs)]),
        "trial_gaps",
    )
    below = passed.select("slot", F.inline("edges"))
    number = F.col("trial") - trials[0]
    cumulated = (
        edges.join(below, ["slot", "value"], "left")
        .groupBy("slot", "trial")
        .agg(F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("value", F.get("ref", number).alias("ref"), F.get("cur", number).alias("cur"))))).alias("at"))
    )
    rows = _trial_statistics(counted, passed.drop("edges"), trials, refs).join(cumulated, ["slot", "trial"], "left")
    rows = rows.withColumn("feature", F.element_at(F.lit(names), F.col("slot") + 1))
    ref, cur = (_bin_counts(F.coalesce(F.col(f"at.{side}"), F.array().cast("array<bigint>")), total, bins) for side, total in (("ref", F.col("n_ref")), ("cur", F.col("n_cur"))))
    rows = rows.withColumns({"ref_bins": F.array(*ref)} | {f"_bin{b}": c for b, c in enumerate(cur)})
    return flag_rows(with_statistics(rows, bins, settings), ["trial"], settings)


DIGEST_BITS = 128


def half_bits(hash_: Column, trials: int) -> Column:
    """An array with a bit of the hex digest for each trial: 1 for its first half."""
    digits = [F.instr(F.lit("0123456789abcdef"), F.substring(hash_, t // 4 + 1, 1)) - 1 for t in range(trials)]
    return F.array(*[F.shiftright(d, t % 4).bitwiseAND(F.lit(1)).cast("bigint") for t, d in enumerate(digits)])


def _gap(t: int, ref: str) -> Column:
    """The largest gap of a trial between its reference and its second half, over all values."""
    first, second = F.col(f"b_{ref}") + F.col(ref), F.col("b_n") + F.col("n") - F.col(f"b_f{t}") - F.col(f"f{t}")
    total = F.col("t_n") - F.col(f"t_f{t}")
    return F.max(F.abs(F.try_divide(first, F.col(f"t_{ref}")) - F.try_divide(second, total))).alias(f"gap{t}")


def _trial_statistics(counted: DataFrame, gaps: DataFrame, trials: Sequence[int], refs: Sequence[str]) -> DataFrame:
    """slot, trial, n_rows, n_ref, n_cur, _gap, _base_null, mean, sample_mean: one row each, from sums over values.

    A trial without rows in its first half has none.
    """
    finite = F.col("value").isNotNull()

    def of(t: int, ref: str) -> list[Column]:
        f, second = F.col(f"f{t}"), F.col("n") - F.col(f"f{t}")
        return [
            F.sum(F.when(finite, F.col(ref)).otherwise(0)).alias(f"ref{t}"),
            F.sum(F.when(finite, second).otherwise(0)).alias(f"cur{t}"),
            F.sum(f).alias(f"all{t}"),
            F.sum(F.when(finite, 0).otherwise(f)).alias(f"none{t}"),
            F.sum(second).alias(f"rows{t}"),
            F.sum(F.col("value") * F.col(ref)).alias(f"x{t}"),
            F.sum(F.col("value") * second).alias(f"y{t}"),
        ]

    sums = counted.groupBy("slot").agg(*[c for t, ref in zip(trials, refs) for c in of(t, ref)])
    one = [
        F.struct(
            F.lit(t).alias("trial"),
            F.col(f"rows{t}").alias("n_rows"),
            F.col(f"ref{t}").alias("n_ref"),
            F.col(f"cur{t}").alias("n_cur"),
            F.col(f"gap{t}").alias("_gap"),
            F.try_divide(F.col(f"none{t}"), F.col(f"all{t}")).alias("_base_null"),
            F.try_divide(F.col(f"y{t}"), F.col(f"cur{t}")).alias("mean"),
            F.try_divide(F.col(f"x{t}"), F.col(f"ref{t}")).alias("sample_mean"),
        )
        for t in trials
    ]
    return sums.join(gaps, "slot", "left").select("slot", F.inline(F.array(*one))).where("_base_null IS NOT NULL")


def _bin_counts(below: Column, total: Column, bins: int) -> list[Column]:
    """Rows per bin from the rows below each inner edge, ascending; bins past the last edge are empty."""
    at = [F.lit(0), *[F.coalesce(F.get(below, F.lit(i)), total) for i in range(bins - 1)], total]
    return [at[b + 1] - at[b] for b in range(bins)]


def null_summary(experiment: DataFrame) -> DataFrame:
    """Per correction: mean and largest number flagged, significant before and after
    correction, and the share of trials whose batch alarms."""
    return experiment.groupBy("correction").agg(
        F.round(F.avg("n_flagged"), 3).alias("mean_flagged"),
        F.max("n_flagged").alias("max_flagged"),
        F.round(F.avg("ks_only_flagged"), 3).alias("mean_ks_only"),
        F.round(F.avg("sig_corrected"), 3).alias("mean_sig_corrected"),
        F.round(F.avg(F.col("batch_drifted").cast("int")), 3).alias("batch_false_alarm_rate"),
    )


def split_windows(
    df: DataFrame, order: RowOrder, fraction: float = BASELINE_FRACTION, windows: int = N_WINDOWS
) -> tuple[DataFrame, DataFrame]:
    """The baseline (first ``fraction`` of the rows) and the rest with ``window`` 1..``windows``."""
    splits = Splits.find(df, order, baseline_windows(fraction, windows))
    later = splits.with_part(df.where(splits.from_(0)), "window")
    return df.where(splits.before(0)), later


def window_verdicts(
    later: DataFrame, profile: Profile, prediction: str, settings: DriftSettings = DriftSettings()
) -> DataFrame:
    """One verdict per ``window``, all windows in one job."""
    rows = compare(later, profile, prediction, ["window"], settings)
    return verdict(rows, ["window"], settings, missing_columns(later, profile))


def calibration(verdicts: DataFrame) -> DataFrame:
    """What the alarm rules do on windows nothing was injected into."""
    return verdicts.select(
        "window",
        F.round("share_flagged", 3).alias("share_flagged"),
        "n_null_shift",
        F.round("max_null_delta", 3).alias("max_null_delta"),
        F.round("pred_psi", 3).alias("pred_psi"),
        F.col("drifted").alias("would_alert"),
    )


def calibration_summary(calibrated: DataFrame, settings: DriftSettings = DriftSettings()) -> DataFrame:
    """Largest values seen over the windows, next to the thresholds, and the alarm count."""
    return calibrated.agg(
        F.max("share_flagged").alias("max_share_flagged"),
        F.lit(settings.batch_share).alias("share_threshold"),
        F.max("max_null_delta").alias("max_null_delta"),
        F.lit(settings.null_jump).alias("null_threshold"),
        F.max("pred_psi").alias("max_pred_psi"),
        F.lit(settings.psi_major).alias("pred_psi_threshold"),
        F.count_if("would_alert").alias("n_alarms"),
        F.count(F.lit(1)).alias("n_windows"),
    )


def cross_reference(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two models' :func:`calibration` reports with their ``model_version``, joined by window.

    One row per window that either report has: both models' names and measures (the
    second's with ``_other``), and whether they agree on an alarm.
    """
    named = second.toDF(*[c if c == "window" else f"{c}_other" for c in second.columns])
    joined = first.join(named, "window", "full")
    agreed = F.col("would_alert").eqNullSafe(F.col("would_alert_other"))
    measures = ["model_version", "share_flagged", "pred_psi", "would_alert"]
    return joined.select("window", *measures, *[f"{c}_other" for c in measures], agreed.alias("agreed"))


def degradation(
    later: DataFrame,
    verdicts: DataFrame,
    reference: DataFrame,
    score: str,
    label: str,
) -> DataFrame:
    """Drift next to lost AUC, per window.

    ``reference`` holds scored, labelled rows whose AUC the windows' are compared
    with. Held-out rows make the drop honest; the rows a model was fitted on
    inflate it.
    """
    base_auc = roc_auc(reference, score, label).select("auc").scalar()
    measured = roc_auc(later, score, label, ["window"]).withColumn("auc_drop", base_auc - F.col("auc"))
    return verdicts.join(measured, "window").select(
        "window",
        "n",
        F.round("share_flagged", 3).alias("share_flagged"),
        F.round("pred_psi", 3).alias("pred_psi"),
        "drifted",
        F.round("auc", 4).alias("auc"),
        F.round("auc_drop", 4).alias("auc_drop"),
        F.round("label_rate", 4).alias("label_rate"),
    )


def drift_correlations(report: DataFrame) -> DataFrame:
    """Correlation of drift measures with lost AUC; NULL where a measure never moves."""

    def correlation(measure: str) -> Column:
        spread = F.stddev_pop(measure) * F.stddev_pop("auc_drop")
        return F.try_divide(F.covar_pop(measure, "auc_drop"), spread)

    return report.agg(
        correlation("share_flagged").alias("corr_share_auc_drop"),
        correlation("pred_psi").alias("corr_pred_psi_auc_drop"),
    )


def rewritten(
    rows: DataFrame, wanted: Sequence[str], scenarios: Mapping[str, Scenario], scorer: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """scenario, the ``wanted`` columns and pred: every row once per scenario, from one read of ``rows``."""
    given, packs = F.struct(*rows.columns), []
    out = rows.select(given.alias("_given"))
    for i, rewrite in enumerate(scenarios.values()):
        # Each scenario starts from the row as it was given.
        fresh = out.select(*[F.col(f"_given.{c}").alias(c) for c in rows.columns], "_given", *packs)
        made = scorer(rewrite(fresh))
        picked = [F.col(c).cast(rows.schema[c].dataType).alias(c) for c in wanted]
        out = made.select("_given", *packs, F.struct(*picked, F.col("pred").cast("double").alias("pred")).alias(f"_rewrite{i}"))
        packs.append(f"_rewrite{i}")
    each = [F.struct(F.lit(name).alias("scenario"), F.col(p).alias("row")) for name, p in zip(scenarios, packs)]
    return out.select(F.inline(F.array(*each))).select("scenario", "row.*")


def scenario_backtest(
    live: DataFrame,
    profile: Profile,
    scenarios: Mapping[str, Scenario],
    scorer: Callable[[DataFrame], DataFrame],
    settings: DriftSettings = DriftSettings(),
) -> DataFrame:
    """One row per what-if rewrite of ``live``: was it caught, and by what.

    ``scorer`` adds the column ``pred``; like the rewrites it works on each row by itself.
    ``live`` is written once and read once: every row becomes an array with its rewrites,
    which are compared side by side in one job.
    """
    wanted = [c for c in profile.monitored if c in live.columns]
    stacked = rewritten(stored(live, "live_rows"), wanted, scenarios, scorer)
    rows = compare(stacked, profile, "pred", ["scenario"], settings)
    report = verdict(rows, ["scenario"], settings, missing_columns(live, profile))
    return report.select(
        "scenario",
        F.col("drifted").alias("caught"),
        F.concat(F.col("n_flagged").cast("string"), F.lit("/"), F.col("n_features").cast("string")).alias(
            "features_flagged"
        ),
        F.round("share_flagged", 3).alias("share"),
        F.round("pred_psi", 3).alias("pred_psi"),
        F.round("pred_mean_batch", 4).alias("pred_mean"),
        "top_feature",
        F.round("top_psi", 3).alias("top_psi"),
        "worst_null_feature",
    )
