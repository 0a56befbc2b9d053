"""One function per query: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogue import inputs
from catalogue.inputs import EMBEDDING_FEATURES, LINE_FEATURES, TRANSACTION_FEATURES, line_order, transaction_order
from tidegauge.operators import features as feat
from tidegauge.operators.compare import compare, features_only, missing_columns, top_drifted, verdict, worst_missing
from tidegauge.operators.contract import accepted, overlay_defaults, rejected, with_contract, with_decision
from tidegauge.operators.exact import categorical_psi, exact_compare, value_counts
from tidegauge.operators.gate import evaluate_gates
from tidegauge.operators.ordering import RowOrder, Splits, baseline_batch, baseline_cut, baseline_windows, id_levels
from tidegauge.operators.profile import PREDICTION, Profile, build_profile, decile_edges, missing_rates, monitored_features
from tidegauge.operators.ranking import roc_auc, rolling_mean
from tidegauge.operators.sampling import row_hash
from tidegauge.operators.scoring import fit_probe, importance, score
from tidegauge.operators.sketches import merged, quantile_sketches, sketch_edges
from tidegauge.operators.whatif import default_scenarios, null_out, overwrite_cohort, rescale_amount, share_of_rows
from tidegauge.plans import validation
from tidegauge.session import scratch_path, stored
from tidegauge.settings import BASELINE_FRACTION, COHORT_SHARE, MODEL_VERSION, N_WINDOWS, SEED, DriftSettings, GateSettings
from tidegauge.sources import tables
from tidegauge.sources.models import ModelBundle, load_bundle, numeric_defaults, save_bundle
from tidegauge.streaming import monitor

Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


# --- features -------------------------------------------------------------


def join_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and their labels, which only some of them have."""
    documents = inputs.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("TransactionID"), "n_chars")
    labels = inputs.table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("TransactionID"), F.col("quality").cast("double").alias("id-01"), F.col("toxic").cast("double").alias("id-02")
    )
    return feat.attach_identity(documents, labels, "TransactionID")


def calendar_amount_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = feat.calendar_amount(inputs.transactions(spark, sf_dir))
    return rounded(made, amt_log=6).select(
        "TransactionID", "hour", "dayofweek", "day_index", "amt_log", "amt_cents", "amt_is_round"
    )


def category_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = inputs.transactions(spark, sf_dir).select("TransactionID", "ProductCD", "P_emaildomain", "C1")
    return feat.encode(tx)


def entity_key_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = inputs.transactions(spark, sf_dir)
    keyed = feat.with_entity_key(feat.calendar_amount(feat.encode(tx)))
    columns = ["card1", "card2", "addr1", "P_emaildomain", "_uid"]
    return feat.with_frequency(keyed, columns).select("TransactionID", "_uid", *[f"{c}_freq" for c in columns])


def frequency_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = inputs.transactions(spark, sf_dir)
    columns = ["card1", "addr1", "P_emaildomain"]
    fitted = {c: feat.fit_frequency(tx, c) for c in columns}
    made = feat.with_frequency(tx, columns, fitted, normalised=True)
    return made.select("TransactionID", *[F.round(F.col(f"{c}_freq").cast("double"), 7).alias(f"{c}_freq") for c in columns])


def conform_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = inputs.transactions(spark, sf_dir).withColumn("mixed", F.when(F.col("ProductCD") == "F", "n/a").otherwise(F.col("C1").cast("string")))
    return feat.conform(tx, ["TransactionID", "addr1", "mixed", "not_there", "C13"])


def prepare_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark, sf_dir).select(
        "TransactionID", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in TRANSACTION_FEATURES]
    )


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with identity through the whole feature preparation."""
    tx = feat.attach_identity(inputs.transactions(spark, sf_dir), inputs.identity(spark, sf_dir), "card1")
    return feat.prepare(tx, TRANSACTION_FEATURES, keep=["TransactionID", "TransactionDT", "isFraud"])


# --- requests -------------------------------------------------------------

DEFAULTS = {"TransactionAmt": 68.5, "ProductCD": 4.0, "card1": 7919.0, "card1_freq": 12.0, "C5": 0.25}


def contract_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accepted(with_contract(inputs.requests(spark, sf_dir)))


def contract_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = rejected(with_contract(inputs.requests(spark, sf_dir)))
    return broken.select("TransactionID", F.array_join("violations", "; ").alias("violations"))


def defaults_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["TransactionAmt", "amt_log", "amt_cents", "amt_is_round", "ProductCD", "card1", "card1_freq", "C5"]
    rows = overlay_defaults(inputs.requests(spark, sf_dir), columns, DEFAULTS)
    return rows.select("TransactionID", *columns).withColumn("amt_log", F.round(F.col("amt_log").cast("double"), 4))


def stand_in_score(amount: str = "TransactionAmt") -> Column:
    """A deterministic stand-in for a model's probability."""
    value = F.col(amount).cast("double")
    return value / (value + 100000.0)


def decision_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = inputs.transactions(spark, sf_dir).select("TransactionID", stand_in_score().alias("p"))
    return with_decision(scored, "p").drop("p")


# --- drift ----------------------------------------------------------------


def line_profile(base: DataFrame) -> Profile:
    return build_profile(base, LINE_FEATURES, "pred", "h").checkpoint()


def line_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, live = inputs.line_batches(spark, sf_dir)
    return compare(live, line_profile(base), "pred")


def missing_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, live = inputs.line_batches(spark, sf_dir)
    return rounded(missing_rates(live, LINE_FEATURES), null_rate=6)


def decile_edges_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, _ = inputs.line_batches(spark, sf_dir)
    profile = build_profile(base, LINE_FEATURES, "pred", "h")
    named = profile.samples.join(F.broadcast(profile.table.select("slot", "feature")), "slot")
    edges = decile_edges(named, ["feature"], profile.bins)
    return rounded(edges.select("feature", F.posexplode("edges").alias("i", "edge")), edge=6)


def approximate_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from sketches of each return flag's lines, merged, next to the ranks that all values give them."""
    base, _ = inputs.line_batches(spark, sf_dir)
    parts = quantile_sketches(base, LINE_FEATURES, ["l_returnflag"])
    path = scratch_path(spark, "sketches")
    parts.write.parquet(path)
    edges = sketch_edges(merged(spark.read.parquet(path)), DriftSettings.psi_bins)
    counts = value_counts(base, LINE_FEATURES).where("value IS NOT NULL")
    named = counts.withColumn("feature", F.element_at(F.lit(LINE_FEATURES), F.col("slot") + 1))
    # The ranks that an edge may have: from the share of values below it to that of values up to it.
    ranks = named.join(F.broadcast(edges), "feature").groupBy("feature", "i", "rank_error").agg(
        (F.sum(F.when(F.col("value") < F.col("edge"), F.col("n")).otherwise(0)) / F.sum("n")).alias("low"),
        (F.sum(F.when(F.col("value") <= F.col("edge"), F.col("n")).otherwise(0)) / F.sum("n")).alias("high"),
        F.sum("n").alias("n"),
    )
    # Three times the error that 99 of 100 quantiles keep.
    near = (F.col("low") <= F.col("i") / 10 + 3 * F.col("rank_error")) & (F.col("high") >= F.col("i") / 10 - 3 * F.col("rank_error"))
    return ranks.select("feature", "i", "n", near.alias("within_error"))


def psi_by_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(line_comparison(spark, sf_dir).select("feature", "n_ref", "n_cur", "psi"), psi=6)


def ks_by_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features_only(line_comparison(spark, sf_dir))
    return rounded(rows.select("feature", "n_ref", "n_cur", "ks_stat", "p_raw"), ks_stat=6, p_raw=6)


def flags(correction: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = features_only(embedding_comparison(spark, sf_dir))
        return rounded(rows.select("feature", "p_raw", F.col(f"sig_{correction}").alias("significant")), p_raw=6)

    return query


def embedding_comparison(spark: SparkSession, sf_dir: str, settings: DriftSettings = DriftSettings()) -> DataFrame:
    """Many features: the first 40% of the vectors against the rest, some of it shifted."""
    rows = inputs.vectors(spark, sf_dir).withColumn("h", row_hash(SEED, "vec_id"))
    order = RowOrder(id_levels("vec_id"))
    splits = Splits.find(rows, order, lambda n: F.array(F.floor(n * F.lit(BASELINE_FRACTION)).cast("bigint")))
    live = rows.where(splits.from_(0)).withColumns({f"e{i}": F.col(f"e{i}") + 0.005 * i for i in range(0, 64, 4)})
    profile = build_profile(rows.where(splits.before(0)), EMBEDDING_FEATURES, "pred", "h").checkpoint()
    return compare(live, profile, "pred", settings=settings)


def ks_exact_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact p-values of many features, wherever both sides have at most 10,000 values."""
    rows = features_only(embedding_comparison(spark, sf_dir, DriftSettings(ks_exact_at_most=10_000)))
    return rounded(rows.select("feature", "n_ref", "n_cur", "ks_stat", "p_raw", "sig_none"), ks_stat=6, p_raw=6)


def missing_rate_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features_only(line_comparison(spark, sf_dir)).select("feature", "null_rate", "null_delta", "null_shift")
    return rounded(rows, null_rate=6, null_delta=6)


REPORT_COLUMNS = [
    "feature", "n_ref", "n_cur", "ks_stat", "p_raw", "psi", "null_rate", "null_delta",
    "sig_none", "sig_bonferroni", "sig_bh", "null_shift", "flagged",
]


def report(rows: DataFrame, *keys: str) -> DataFrame:
    named = features_only(rows).select(*keys, *REPORT_COLUMNS)
    return rounded(named, ks_stat=6, p_raw=6, psi=6, null_rate=6, null_delta=6)


def drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(line_comparison(spark, sf_dir))


def exact_drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report against all values of the baseline."""
    base, live = inputs.line_batches(spark, sf_dir)
    return report(exact_compare(base, live, LINE_FEATURES, "pred"))


def psi_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes with few values, one of which turns all 0 after the baseline."""
    base, live = (rows.withColumn("fits", (F.col("l_quantity") > 25).cast("int")) for rows in inputs.line_batches(spark, sf_dir))
    found = categorical_psi(base, live.withColumn("fits", F.lit(0)), ["fits", "l_returnflag", "l_linestatus", "l_linenumber"])
    return rounded(found, psi=6)


VERDICT_DIGITS = {
    "max_null_delta": 6, "top_psi": 6, "pred_psi": 6, "pred_mean_baseline": 6, "pred_mean_batch": 6, "share_flagged": 6,
}


def batch_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, live = inputs.line_batches(spark, sf_dir)
    # One monitored feature does not arrive, which the verdict must say.
    arrived = live.drop("l_tax")
    profile = line_profile(base)
    judged = verdict(compare(arrived, profile, "pred"), missing=["l_tax"])
    flat = judged.withColumns({c: F.array_join(c, "; ") for c in ("reasons", "missing_columns")})
    return rounded(flat, **VERDICT_DIGITS)


def top_drifted_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = top_drifted(embedding_comparison(spark, sf_dir), 10)
    return rounded(top.select("feature", "psi", "ks_stat", "p_raw", "flagged"), psi=6, ks_stat=6, p_raw=6)


def worst_missing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(worst_missing(line_comparison(spark, sf_dir)), null_delta=6)


def profile_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, _ = inputs.line_batches(spark, sf_dir)
    profile = build_profile(base, LINE_FEATURES, "pred", "h")
    named = profile.samples.join(F.broadcast(profile.table.select("slot", "feature")), "slot")
    return named.select("feature", F.round("value", 6).alias("value"))


def profile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, _ = inputs.line_batches(spark, sf_dir)
    table = build_profile(base, LINE_FEATURES, "pred", "h").table
    picked = table.select("slot", "feature", "n_rows", "null_rate", "mean", "n_ref", "sample_mean")
    return rounded(picked, null_rate=6, mean=4, sample_mean=4)


def stored_profile_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, live = inputs.line_batches(spark, sf_dir)
    path = scratch_path(spark, "profile")
    tables.save_profile(build_profile(base, LINE_FEATURES, "pred", "h"), path)
    return report(compare(live, tables.load_profile(spark, path).checkpoint(), "pred"))


def ks_small_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact p-values: customers of each nation and segment against all suppliers, by balance."""
    suppliers = inputs.table(spark, sf_dir, "supplier").select(
        F.col("s_acctbal").alias("balance"), F.lit(0.5).alias("pred"), row_hash(SEED, "s_suppkey").alias("h")
    )
    customers = inputs.table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance")
    )
    profile = build_profile(suppliers, ["balance"], "pred", "h").checkpoint()
    rows = compare(customers, profile, by=["nation", "segment"], settings=DriftSettings(ks_exact_at_most=10_000))
    return rounded(rows, ks_stat=6, p_raw=6).select("nation", "segment", "n_ref", "n_cur", "ks_stat", "p_raw")


# --- validation -----------------------------------------------------------


def null_experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = validation.null_experiment(inputs.vectors(spark, sf_dir), EMBEDDING_FEATURES, "pred", ["vec_id"])
    return validation.null_summary(runs)


def exact_null_experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All values, halves by the bits of one digest a row."""
    runs = validation.exact_null_experiment(inputs.vectors(spark, sf_dir), EMBEDDING_FEATURES, "pred", ["vec_id"])
    return validation.null_summary(runs)


def windows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, Profile]:
    rows = inputs.drifting_lines(spark, sf_dir)
    base, later = validation.split_windows(rows, line_order())
    return base, later, line_profile(base)


def window_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, later, profile = windows(spark, sf_dir)
    return report(compare(later, profile, "pred", ["window"]), "window")


def exact_window_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, later = validation.split_windows(inputs.drifting_lines(spark, sf_dir), line_order())
    return report(exact_compare(base, later, LINE_FEATURES, "pred", ["window"]), "window")


def calibration_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, later, profile = windows(spark, sf_dir)
    return validation.calibration(validation.window_verdicts(later, profile, "pred"))


def calibration_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.calibration_summary(calibration_windows(spark, sf_dir))


def roc_auc_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.drifting_lines(spark, sf_dir)
    _, later = validation.split_windows(rows, line_order())
    return rounded(roc_auc(later, "pred", "label", ["window"]), auc=6, label_rate=6)


def degradation_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, later, profile = windows(spark, sf_dir)
    verdicts = validation.window_verdicts(later, profile, "pred").checkpoint()
    lost = validation.degradation(later, verdicts, base, "pred", "label")
    # Side by side with the calibration of the same windows.
    return lost.join(validation.calibration(verdicts).select("window", "n_null_shift", "max_null_delta", "would_alert"), "window")


def drift_vs_degradation_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = validation.drift_correlations(degradation_windows(spark, sf_dir))
    return rounded(made, corr_share_auc_drop=4, corr_pred_psi_auc_drop=4)


def whatif_rows(df: DataFrame) -> DataFrame:
    columns = ["TransactionAmt", "amt_log", "amt_cents", "C1", "C13", "has_identity", "id_01", "id_02"]
    return df.select("TransactionID", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in columns])


def whatif_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whatif_rows(rescale_amount(prepared(spark, sf_dir)))


def whatif_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = share_of_rows(row_hash(SEED, "TransactionID"), COHORT_SHARE)
    return whatif_rows(overwrite_cohort(prepared(spark, sf_dir), chosen))


def whatif_feed_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whatif_rows(null_out(prepared(spark, sf_dir)))


def with_stand_in(df: DataFrame) -> DataFrame:
    base = F.col("TransactionAmt").cast("double")
    known = F.coalesce(F.col("has_identity").cast("double"), F.lit(0.0))
    return df.withColumn("pred", base / (base + 200000.0 + 50000.0 * known))


def live_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch of a given size right after the baseline; the size is what is asked for."""
    tx = inputs.transactions(spark, sf_dir)
    splits = Splits.find(tx, transaction_order(), baseline_batch(BASELINE_FRACTION, 4_000))
    return tx.where(splits.from_(0) & splits.before(1)).select("TransactionID", "TransactionDT")


def scenario_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prepared(spark, sf_dir).withColumn("h", row_hash(SEED, "TransactionID"))
    order = transaction_order()
    splits = Splits.find(inputs.transactions(spark, sf_dir), order, baseline_cut(BASELINE_FRACTION))
    base, live = rows.where(splits.before(0)), rows.where(splits.from_(0))
    profile = build_profile(with_stand_in(base), TRANSACTION_FEATURES, "pred", "h").checkpoint()
    return validation.scenario_backtest(live, profile, default_scenarios("h"), with_stand_in)


def scenario_backtest_by_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The backtest with features of the baseline and of the live rows made apart: no count looks ahead."""
    tx = inputs.transactions(spark, sf_dir)
    splits = Splits.find(tx, transaction_order(), baseline_cut(BASELINE_FRACTION))
    people = inputs.identity(spark, sf_dir)

    def made(rows: DataFrame) -> DataFrame:
        found = feat.prepare(feat.attach_identity(rows, people, "card1"), TRANSACTION_FEATURES, keep=["TransactionID"])
        return found.withColumn("h", row_hash(SEED, "TransactionID"))

    base, live = made(tx.where(splits.before(0))), made(tx.where(splits.from_(0)))
    profile = build_profile(with_stand_in(base), TRANSACTION_FEATURES, "pred", "h").checkpoint()
    return validation.scenario_backtest(live, profile, default_scenarios("h"), with_stand_in)


# --- logs, reports, models ------------------------------------------------


def rolling_prediction_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = RowOrder.by_time("ts", id_levels("event_id"))
    rolled = rolling_mean(inputs.log(spark, sf_dir), order, "pred")
    return rounded(rolled.select("event_id", "pred", "rolling_mean"), rolling_mean=6)


def log_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = inputs.log(spark, sf_dir).withColumn("model_version", F.concat(F.lit("scorer-"), "event_type"))
    return tables.service_counters(log, ["k", "value"], log_profile(spark, sf_dir))


def prediction_log_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "log")
    scored = inputs.log(spark, sf_dir).select(
        F.unix_micros("ts").cast("double").alias("us"), "pred", F.lit(MODEL_VERSION).alias("model_version"), "k"
    )
    records, monitored = scored.withColumn("ts", F.col("us") / 1e6), Profile(("k", "not_logged"), scored, scored)
    tables.append_log(records, None, path)
    tables.append_log(records, monitored, path)
    read = tables.read_log(spark, path, ["k"])
    return read.groupBy(F.to_date("ts").alias("day"), "model_version").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("pred"), 6).alias("mean_pred"), F.round(F.avg("k"), 6).alias("mean_k")
    )


def report_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "report")
    written = calibration_windows(spark, sf_dir)
    tables.write_report(written, path)
    return tables.read_report(spark, path, written.schema)


def csv_transactions(spark: SparkSession, sf_dir: str, rows: int | None = None) -> DataFrame:
    tx_path, id_path = scratch_path(spark, "tx"), scratch_path(spark, "identity")
    tx = inputs.transactions(spark, sf_dir).select("TransactionID", "TransactionAmt", "card1", "P_emaildomain")
    people = inputs.identity(spark, sf_dir)
    tx.write.option("header", "true").csv(tx_path)
    people.write.option("header", "true").csv(id_path)
    order = ["TransactionID"] if rows is not None else []
    return tables.read_transactions(spark, tx_path, id_path, tx.schema, people.schema, key="card1", rows=rows, order=order)


def csv_first_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of a file; how many is what is asked for."""
    return csv_transactions(spark, sf_dir, rows=500)


def model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One candidate model per line status and return flag, with metrics measured on its lines."""
    rows = inputs.drifting_lines(spark, sf_dir).withColumn(
        "outcome", (F.col("l_quantity") > 25).cast("int")
    )
    measured = roc_auc(rows, "pred", "outcome", ["l_linestatus", "l_returnflag"])
    return measured.select(
        F.concat_ws("-", "l_linestatus", "l_returnflag").alias("model_version"),
        F.array(*[F.lit(c) for c in LINE_FEATURES]).alias("columns"),
        F.when(F.col("l_returnflag") != "N", 1 - F.col("auc")).alias("val_auc"),
        F.col("n").alias("n_train"),
        (F.col("l_linestatus") == "F").alias("can_score"),
    )


CANDIDATE_GATES = GateSettings(min_val_auc=0.5, max_n_features=500, min_train_rows=100)


def promotion_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    gated = evaluate_gates(model_rows(spark, sf_dir), CANDIDATE_GATES)
    return rounded(gated.drop("columns", "can_score"), val_auc=6)


def registry_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    decisions, registry = scratch_path(spark, "gate_decisions"), scratch_path(spark, "model_registry")
    gated = evaluate_gates(model_rows(spark, sf_dir), CANDIDATE_GATES)
    tables.append_gate_decisions(gated, decisions)
    tables.append_model_records(gated, registry, CANDIDATE_GATES)
    decided = spark.read.parquet(decisions).select("model_version", "deployable", "checks.train_rows_ok")
    stored = spark.read.parquet(registry).select(
        "model_version",
        F.col("params")["n_train_rows"].alias("n_train_rows"),
        F.round(F.col("metrics")["val_auc"], 6).alias("val_auc"),
        F.col("metrics")["gate_model_loads"].alias("gate_model_loads"),
        F.col("tags")["deployable"].alias("deployable_tag"),
    )
    return decided.join(stored, "model_version")


def promotion_gate_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of which every check turns some down: few rows, many columns, a low AUC or one missing, not loading."""
    rows = inputs.drifting_lines(spark, sf_dir).withColumns(
        {"outcome": (F.col("l_discount") > 0.05).cast("int"), "kind": F.floor(F.col("l_quantity") / 8).cast("int")}
    )
    measured = roc_auc(rows, "pred", "outcome", ["kind", "l_returnflag"])
    models = measured.select(
        F.concat_ws("-", "kind", "l_returnflag").alias("model_version"),
        F.array_repeat(F.lit("c"), F.col("kind") * 100).alias("columns"),
        F.when(F.col("kind") != 3, F.when(F.col("l_returnflag") == "A", F.col("auc")).otherwise(1 - F.col("auc"))).alias("val_auc"),
        F.when(F.col("l_returnflag") == "R", F.lit(90).cast("bigint")).otherwise(F.col("n")).alias("n_train"),
        (F.col("kind") != 2).alias("can_score"),
    )
    return rounded(evaluate_gates(models, CANDIDATE_GATES).drop("columns", "can_score"), val_auc=6)


def score_stored_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders scored with a pipeline that was stored as a bundle and loaded again."""
    path = scratch_path(spark, "scorer")
    share = SQLTransformer(statement="SELECT *, C1 / (C1 + C13 + 1) AS _p FROM __THIS__")
    pair = SQLTransformer(statement="SELECT *, 1 - _p AS _q FROM __THIS__")
    vector = VectorAssembler(inputCols=["_q", "_p"], outputCol="probability")
    bundle = ModelBundle(PipelineModel([share, pair, vector]), "shares-v1", ("C1", "C13"), {"C1": 3.0, "C13": 0.0}, 0.9, 1000)
    save_bundle(bundle, spark, path)
    loaded = load_bundle(spark, path)
    rows = inputs.transactions(spark, sf_dir).withColumn("C13", F.when(F.col("C13") < 8, F.col("C13")))
    filled = rows.na.fill(dict(loaded.defaults), list(loaded.columns))
    scored = score(filled.select("TransactionID", *loaded.columns), loaded.model)
    return with_decision(scored, "pred", model_version=loaded.model_version).select(
        "TransactionID", F.round("pred", 6).alias("pred"), "decision", "model_version"
    )


def monitored_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features with most spread in the prepared rows, calendar features left out."""
    rows = inputs.transactions(spark, sf_dir)
    dated = feat.calendar_amount(rows)
    names = ["TransactionDT", "TransactionAmt", "day_index", "hour", "amt_cents", "C1", "C13", "D1", "card1", "addr1"]
    spread = dated.agg(*[F.round(F.stddev_pop(F.col(c).cast("double")) / F.greatest(F.avg(c), F.lit(1.0)), 6).alias(c) for c in names])
    gains = [F.struct(F.lit(c).alias("feature"), F.col(c).alias("gain"), F.lit(i).alias("position")) for i, c in enumerate(names)]
    return monitored_features(spread.select(F.inline(F.array(*gains))), n=5)


def report_cross_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models' verdicts on the same windows, side by side under their names."""
    rows = inputs.drifting_lines(spark, sf_dir)
    second = (F.col("l_tax") * 5 + F.col("l_discount")).alias("pred")
    models = {"ratio-v1": rows, "rates-v2": rows.select(*[c for c in rows.columns if c != "pred"], F.coalesce(second, F.lit(0.5)).alias("pred"))}
    reports = []
    for name, scored in models.items():
        base, later = validation.split_windows(scored, line_order())
        verdicts = validation.window_verdicts(later, line_profile(base), "pred")
        path = scratch_path(spark, "model_report")
        tables.write_report(validation.calibration(verdicts).withColumn("model_version", F.lit(name)), path, "parquet")
        reports.append(tables.read_report(spark, path, format_="parquet"))
    return validation.cross_reference(*reports)


def probe_fit_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.drifting_lines(spark, sf_dir)
    base, _ = validation.split_windows(rows, line_order())
    model = fit_probe(base.na.fill(-1.0, LINE_FEATURES), LINE_FEATURES, "label")
    return monitored_features(importance(model, LINE_FEATURES, rows), n=3)


def probe_degradation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift against lost AUC with a fitted probe, stored and loaded as a bundle."""
    rows = inputs.drifting_lines(spark, sf_dir).drop("pred").withColumn(
        "label", (F.col("l_extendedprice") > 1500 * F.col("l_quantity")).cast("int")
    )
    splits = Splits.find(rows, line_order(), baseline_windows(BASELINE_FRACTION, N_WINDOWS))
    base = rows.where(splits.before(0))
    # Every fifth of the digests is kept out of the fit, for an honest reference AUC.
    held_out = F.col("h") < "33333333"
    inputs_used = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    fitted = fit_probe(base.where(~held_out).na.fill(-1.0, inputs_used), inputs_used, "label")
    path = scratch_path(spark, "bundle")
    defaults = numeric_defaults(base, inputs_used)
    save_bundle(ModelBundle(fitted, MODEL_VERSION, tuple(inputs_used), defaults), spark, path)
    bundle = load_bundle(spark, path)

    # Every line is placed, digested and scored once; window 0 is the baseline, the only part whose digests are used.
    placed = splits.with_part(rows, "window").na.fill(-1.0, list(bundle.columns))
    digest = F.when(F.col("window") == 0, F.col("h")).alias("h")
    scored = stored(score(placed.select("window", digest, *LINE_FEATURES, "label"), bundle.model), "scored_lines")
    base, later = scored.where("window = 0"), scored.where("window > 0")
    profile = build_profile(base, LINE_FEATURES, "pred", "h").checkpoint()
    verdicts = validation.window_verdicts(later, profile, "pred").checkpoint()
    return validation.degradation(later, verdicts, base.where(held_out), "pred", "label")


# --- streams --------------------------------------------------------------


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = inputs.table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return inputs.log_fields(raw)


def finish(writer) -> None:
    writer.trigger(availableNow=True).start().awaitTermination()


def stream_daily_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "daily")
    metrics = monitor.windowed_metrics(
        event_stream(spark, sf_dir), "ts", "1 day", "1 hour", F.col("pred"), F.col("event_type") == "error"
    )
    finish(monitor.updating_sink(metrics, f"{path}/rows", f"{path}/state"))
    newest = monitor.latest(spark.read.parquet(f"{path}/rows"), ["window_start"])
    return newest.select(
        F.to_date("window_start").alias("day"),
        "n",
        F.round("mean_value", 6).alias("mean_value"),
        F.round("null_rate", 6).alias("error_rate"),
    )


def log_profile(spark: SparkSession, sf_dir: str) -> Profile:
    log = inputs.log(spark, sf_dir).withColumn("h", row_hash(SEED, "event_id"))
    splits = Splits.find(
        log,
        RowOrder.by_time("ts", id_levels("event_id")),
        lambda n: F.array(F.floor(n * F.lit(BASELINE_FRACTION)).cast("bigint")),
    )
    return build_profile(log.where(splits.before(0)), ["k"], "pred", "h").checkpoint()


def stream_window_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "cells")
    profile = log_profile(spark, sf_dir)
    cells = monitor.windowed_cells(event_stream(spark, sf_dir), profile, "ts", "1 day", "1 hour", "pred")
    finish(monitor.updating_sink(cells, f"{path}/rows", f"{path}/state"))
    stored = monitor.latest(spark.read.parquet(f"{path}/rows"), ["window_start", "slot", "cell"])
    missing = missing_columns(event_stream(spark, sf_dir), profile)
    judged = monitor.windowed_verdicts(stored, profile, missing=missing)
    return rounded(
        judged.select(F.to_date("window_start").alias("day"), "n_rows", "n_flagged", "top_psi", "pred_psi", "drifted"),
        top_psi=6,
        pred_psi=6,
    )


def stream_batch_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "batch_drift")
    finish(monitor.drift_stream(event_stream(spark, sf_dir), log_profile(spark, sf_dir), f"{path}/rows", f"{path}/state"))
    stored = spark.read.parquet(f"{path}/rows")
    return rounded(stored.select("batch_id", "n_rows", "n_flagged", "top_feature", "top_psi", "pred_psi", "drifted"), top_psi=6, pred_psi=6)


def stream_replay_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log that grows by a file a week, read in micro-batches of one file, with a stop in between."""
    path = scratch_path(spark, "replay")
    log = inputs.log(spark, sf_dir).withColumn("week", F.to_date(F.date_trunc("week", "ts")))
    profile = log_profile(spark, sf_dir)
    weeks = [r.week for r in log.select("week").distinct().orderBy("week").collect()]

    def run() -> None:
        stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/log")
        finish(monitor.drift_stream(stream, profile, f"{path}/rows", f"{path}/state", time="ts"))

    for part in (weeks[:2], weeks[2:]):
        arrived = log.where(F.col("week").isin(part))
        arrived.repartition("week").write.mode("append").partitionBy("week").parquet(f"{path}/log")
        run()
    stored = spark.read.parquet(f"{path}/rows")
    named = stored.select(F.to_date(F.date_trunc("week", "first_time")).alias("week"), "n_rows", "n_flagged", "top_psi", "pred_psi", "drifted")
    return rounded(named, top_psi=6, pred_psi=6)


def stream_closed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily verdicts of the days that the watermark has closed."""
    path = scratch_path(spark, "closed")
    profile = log_profile(spark, sf_dir)
    cells = monitor.windowed_cells(event_stream(spark, sf_dir), profile, "ts", "1 day", "1 hour", "pred")
    with monitor.rocksdb_state(spark):
        finish(monitor.closed_sink(cells, f"{path}/rows", f"{path}/state"))
    judged = monitor.windowed_verdicts(spark.read.parquet(f"{path}/rows").drop(monitor.BATCH), profile)
    return rounded(
        judged.select(F.to_date("window_start").alias("day"), "n_rows", "n_flagged", "top_psi", "pred_psi", "drifted"),
        top_psi=6,
        pred_psi=6,
    )


def stream_score_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "score_log")
    stream = event_stream(spark, sf_dir).select(
        "event_id",
        F.unix_micros("ts").cast("double").alias("ts"),
        (F.col("value") * 250 - 1000).alias("TransactionAmt"),
        "k",
    )
    writer = monitor.score_stream(
        stream,
        lambda df: df.withColumn("pred", stand_in_score()),
        f"{path}/log",
        f"{path}/rejects",
        f"{path}/state",
        log_profile(spark, sf_dir),
        keep=["event_id"],
    )
    finish(writer)
    logged = spark.read.parquet(f"{path}/log").select(
        "event_id", "model_version", "k", F.round("pred", 6).alias("pred"), "decision", F.lit("").alias("violations")
    )
    broken = spark.read.parquet(f"{path}/rejects").select(
        "event_id",
        F.lit(None).cast("string").alias("model_version"),
        F.lit(None).cast("double").alias("k"),
        F.lit(None).cast("double").alias("pred"),
        F.lit(None).cast("string").alias("decision"),
        F.array_join("violations", "; ").alias("violations"),
    )
    return logged.unionByName(broken)


ALL: dict[str, Query] = {
    "join_identity": join_identity,
    "calendar_amount_features": calendar_amount_features,
    "category_codes": category_codes,
    "entity_key_frequency": entity_key_frequency,
    "frequency_normalised": frequency_normalised,
    "conform_schema": conform_schema,
    "prepare_features": prepare_features,
    "contract_check": contract_check,
    "contract_rejects": contract_rejects,
    "defaults_overlay": defaults_overlay,
    "decision_lift": decision_lift,
    "missing_rate": missing_rate,
    "decile_edges": decile_edges_query,
    "approximate_edges": approximate_edges,
    "psi_by_feature": psi_by_feature,
    "ks_by_feature": ks_by_feature,
    "flag_none": flags("none"),
    "ks_small_batch": ks_small_batch,
    "ks_exact_report": ks_exact_report,
    "flag_bonferroni": flags("bonferroni"),
    "flag_bh": flags("bh"),
    "missing_rate_shift": missing_rate_shift,
    "drift_report": drift_report,
    "exact_drift_report": exact_drift_report,
    "psi_categorical": psi_categorical,
    "batch_verdict": batch_verdict,
    "top_drifted": top_drifted_query,
    "worst_missing": worst_missing_query,
    "profile_sample": profile_sample,
    "profile_summary": profile_summary,
    "stored_profile_report": stored_profile_report,
    "null_experiment": null_experiment,
    "exact_null_experiment": exact_null_experiment,
    "window_drift": window_drift,
    "exact_window_drift": exact_window_drift,
    "calibration_windows": calibration_windows,
    "calibration_summary": calibration_summary,
    "roc_auc_by_window": roc_auc_by_window,
    "degradation_windows": degradation_windows,
    "drift_vs_degradation_corr": drift_vs_degradation_corr,
    "whatif_rescale": whatif_rescale,
    "whatif_cohort": whatif_cohort,
    "whatif_feed_null": whatif_feed_null,
    "live_batch": live_batch,
    "scenario_backtest": scenario_backtest,
    "scenario_backtest_by_batch": scenario_backtest_by_batch,
    "rolling_prediction_mean": rolling_prediction_mean,
    "log_counters": log_counters,
    "prediction_log_roundtrip": prediction_log_roundtrip,
    "report_roundtrip": report_roundtrip,
    "csv_transactions": csv_transactions,
    "csv_first_transactions": csv_first_transactions,
    "promotion_gate": promotion_gate,
    "registry_records": registry_records,
    "promotion_gate_failures": promotion_gate_failures,
    "score_stored_bundle": score_stored_bundle,
    "monitored_selection": monitored_selection,
    "report_cross_reference": report_cross_reference,
    "stream_daily_monitor": stream_daily_monitor,
    "stream_window_drift": stream_window_drift,
    "stream_batch_drift": stream_batch_drift,
    "stream_replay_drift": stream_replay_drift,
    "stream_closed_windows": stream_closed_windows,
    "stream_score_log": stream_score_log,
    "probe_fit_importance": probe_fit_importance,
    "probe_degradation": probe_degradation,
}
