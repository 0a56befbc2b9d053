"""The request contract on whole tables: range checks, defaults, decisions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.features import with_amount_features
from tidegauge.settings import BASE_RATE, DECISION_THRESHOLD, MODEL_VERSION, REQUEST_CONTRACT, FieldRule


def with_contract(df: DataFrame, rules: Sequence[FieldRule] = REQUEST_CONTRACT) -> DataFrame:
    """Fill defaults and add ``violations``, the messages of the rules a row breaks.

    A NULL or absent field takes its default; a required one is a violation. A
    value that does not convert to the field's type is one too.
    """
    present = set(df.columns)
    raw = {r.name: F.col(r.name) if r.name in present else F.lit(None).cast("double") for r in rules}
    checks = [F.when(_broken(raw[r.name], r), F.lit(_message(r))) for r in rules]
    checked = df.withColumn("violations", F.array_compact(F.array(*checks)))
    return checked.withColumns({r.name: F.coalesce(raw[r.name].try_cast(r.type), F.lit(r.default).cast(r.type)) for r in rules})


def accepted(df: DataFrame) -> DataFrame:
    """Rows without violations."""
    return df.where(F.size("violations") == 0).drop("violations")


def rejected(df: DataFrame) -> DataFrame:
    """Rows with violations, and the violations."""
    return df.where(F.size("violations") > 0)


def _broken(value: Column, rule: FieldRule) -> Column:
    number = value.try_cast("double")
    # NaN sorts above every number, so a lower bound alone must name it.
    fits = number.isNotNull()
    if rule.low is not None:
        fits = fits & (number >= rule.low) & ~F.isnan(number)
    if rule.high is not None:
        fits = fits & ((number < rule.high) if rule.high_open else (number <= rule.high))
    if rule.type == "int":
        fits = fits & (number == F.floor(number))
    given_but_wrong = value.isNotNull() & ~F.coalesce(fits, F.lit(False))
    return (value.isNull() | given_but_wrong) if rule.required else given_but_wrong


def _message(rule: FieldRule) -> str:
    return f"{rule.name} out of range"


def overlay_defaults(df: DataFrame, columns: Sequence[str], defaults: Mapping[str, float]) -> DataFrame:
    """The model's input rows: given fields over ``defaults``, amount features recomputed.

    Frequency columns stay at what ``df`` or the defaults hold. Adds nothing but
    ``columns``, as floats; other columns of ``df`` are kept unchanged.
    """
    amounts = with_amount_features(df)
    fresh = {"amt_log", "amt_cents", "amt_is_round"}
    others = [c for c in df.columns if c not in columns]
    out = []
    for c in columns:
        given = F.col(c) if c in df.columns or c in fresh else F.lit(None)
        out.append(F.coalesce(given.try_cast("float"), F.lit(defaults.get(c)).cast("float")).alias(c))
    return amounts.select(*others, *out)


def with_decision(
    df: DataFrame,
    probability: str,
    threshold: float = DECISION_THRESHOLD,
    base_rate: float = BASE_RATE,
    model_version: str = MODEL_VERSION,
) -> DataFrame:
    """Add the response fields; the decision and the lift use the unrounded probability."""
    p = F.col(probability)
    return df.withColumns(
        {
            "fraud_probability": F.round(p, 6),
            "decision": F.when(p >= threshold, "review").otherwise("approve"),
            "model_version": F.lit(model_version),
            "baseline_rate": F.lit(base_rate),
            "lift_over_base": F.round(p / base_rate, 3),
        }
    )
