"""Feature preparation: calendar and amount features, codes, frequencies, schema."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.operators.running import with_running
from tidegauge.session import stored
from tidegauge.settings import FREQUENCY_COLUMNS

MISSING_CODE = -1


def attach_identity(transactions: DataFrame, identity: DataFrame, key: str = "TransactionID") -> DataFrame:
    """Left join with ``identity`` and a 0/1 column ``has_identity``.

    Hyphens in identity column names become underscores. The flag rides on the
    joined side, so one join serves both.
    """
    renamed = identity.toDF(*[c.replace("-", "_") for c in identity.columns])
    flagged = renamed.withColumn("_found", F.lit(1))
    joined = transactions.join(flagged, key, "left")
    return joined.withColumn("has_identity", F.coalesce("_found", F.lit(0)).cast("byte")).drop("_found")


def calendar_amount(df: DataFrame, time: str = "TransactionDT", amount: str = "TransactionAmt") -> DataFrame:
    """Add hour, dayofweek, day_index, amt_log, amt_cents and amt_is_round.

    ``time`` is in seconds; hour and dayofweek keep their fraction. Cents round
    half to even.
    """
    days = F.col(time) / 86400
    calendar = df.withColumns(
        {"hour": F.pmod(F.col(time) / 3600, F.lit(24.0)), "dayofweek": F.pmod(days, F.lit(7.0)), "day_index": days}
    )
    return with_amount_features(calendar, amount)


def with_amount_features(df: DataFrame, amount: str = "TransactionAmt") -> DataFrame:
    """Add amt_log, amt_cents and amt_is_round."""
    value = F.col(amount)
    cents = F.rint((value - F.floor(value)) * 100).cast("float")
    return df.withColumns({"amt_log": F.log1p(value), "amt_cents": cents}).withColumn(
        "amt_is_round", F.coalesce(F.col("amt_cents") == 0, F.lit(False)).cast("byte")
    )


def category_columns(df: DataFrame) -> list[str]:
    """Columns that are neither numeric nor boolean."""
    return [f.name for f in df.schema if not isinstance(f.dataType, (T.NumericType, T.BooleanType))]


def fit_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Code dictionary: column, value, code (place among the column's sorted values, from 0).

    One pass over the rows collects the distinct values of all columns. A code is a rank
    over ranges of values, so no task holds a whole column, whatever its values begin with.
    """
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    values = df.select(F.inline(F.array(*pairs))).where("value IS NOT NULL").distinct()
    ranked = with_running(values.withColumn("_one", F.lit(1)), ["column"], ["value"], {"_place": "_one"})
    return ranked.select("column", "value", F.col("_place").cast("int").alias("code"))


def apply_codes(df: DataFrame, codes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace ``columns`` by their codes; missing values and values not in the dictionary get -1."""
    found = _looked_up(df, codes, {c: c for c in columns}, "code")
    return found.withColumns({c: F.coalesce(f"_found_{c}", F.lit(MISSING_CODE)).cast("int") for c in columns}).drop(
        *[f"_found_{c}" for c in columns]
    )


def _looked_up(df: DataFrame, table: DataFrame, columns: Mapping[str, str], measure: str) -> DataFrame:
    """``df`` with ``_found_<c>``: the ``measure`` that ``table`` (column, value) has for the value of each column.

    ``columns`` maps columns of ``df`` to their names in the table. Every look-up joins the
    same keys to the same table, so Spark shuffles or broadcasts the table once.
    """
    key = F.concat_ws(":", F.length("column").cast("string"), F.col("column"), F.col("value"))
    entries = table.select(key.alias("_key"), F.col(measure).alias("_measure"))
    out = df
    for c, name in columns.items():
        prefix = F.lit(f"{len(name)}:{name}:")
        # A missing value has no key.
        joined = out.join(entries, F.concat(prefix, out[c].cast("string")) == entries["_key"], "left")
        out = joined.withColumnRenamed("_measure", f"_found_{c}").drop("_key")
    return out


def encode(df: DataFrame) -> DataFrame:
    """Codes for every column that is not numeric, fitted on ``df`` itself."""
    columns = category_columns(df)
    return apply_codes(df, fit_codes(df, columns), columns) if columns else df


def fit_frequency(df: DataFrame, column: str) -> DataFrame:
    """How often each value occurs: ``column``, n, share (of all rows)."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return counts.select(column, "n", (F.col("n") / total).alias("share"))


def count_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How often each value of each column occurs, in one pass: column, value (as text), n, share (of all rows).

    Missing values are left out of the table but count as rows.
    """
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    counted = df.select(F.inline(F.array(*pairs))).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return counted.where("value IS NOT NULL").withColumn("share", F.col("n") / total)


def with_frequency(
    df: DataFrame,
    columns: Sequence[str],
    fitted: Mapping[str, DataFrame] | None = None,
    normalised: bool = False,
) -> DataFrame:
    """Add ``{c}_freq``: the count (or share) of the row's value, 0 if it is missing.

    Counts come from ``fitted`` tables (:func:`fit_frequency`) or from ``df``
    itself; columns ``df`` lacks are skipped. For counts of its own ``df`` is written
    once and read twice, to count all columns and to look the counts up. Values are
    counted before the join, and a hot value's rows on the large side are left to
    adaptive skew handling.
    """
    fitted = fitted or {}
    present = [c for c in columns if c in df.columns]
    own, measure = [c for c in present if c not in fitted], "share" if normalised else "n"
    out = df
    if own:
        out = stored(df, "counted_rows")
        out = _looked_up(out, count_values(out, own), {c: c for c in own}, measure)
    for c in present:
        if c in fitted:
            lookup = fitted[c].where(F.col(c).isNotNull()).select(F.col(c).alias("_value"), F.col(measure).alias(f"_found_{c}"))
            out = out.join(lookup, out[c] == lookup["_value"], "left").drop("_value")
    made = {f"{c}_freq": F.coalesce(F.col(f"_found_{c}").cast("float"), F.lit(0.0).cast("float")) for c in present}
    return out.withColumns(made).drop(*[f"_found_{c}" for c in present])


def with_entity_key(df: DataFrame) -> DataFrame:
    """Add ``_uid``: card, address and start day; missing if any part is."""
    start = F.rint(F.col("day_index") - F.col("D1"))
    parts = [F.col("card1"), F.lit("_"), F.col("addr1"), F.lit("_"), start]
    return df.withColumn("_uid", F.concat(*[p.cast("string") for p in parts]))


def conform(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exactly ``columns`` in that order, as floats; absent ones are missing, others dropped."""
    present = set(df.columns)
    return df.select(
        [(F.col(c).try_cast("float") if c in present else F.lit(None).cast("float")).alias(c) for c in columns]
    )


def prepare(
    df: DataFrame,
    columns: Sequence[str],
    keep: Sequence[str] = (),
    codes: DataFrame | None = None,
    frequencies: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """The model's feature matrix from raw transactions, plus ``keep`` columns unchanged.

    Codes and frequencies are fitted on ``df`` unless given. Codes come first, so
    a missing text value counts as one more value (-1) of its column. Only what
    ``columns`` asks for is made.
    """
    kept = df.select(*[F.col(c).alias(f"_keep_{c}") for c in keep], "*")
    dated = calendar_amount(kept)
    counted = [c for c in FREQUENCY_COLUMNS if f"{c}_freq" in columns]
    used = {*columns, *counted, *(("card1", "addr1") if "_uid" in counted else ())}
    categories = [c for c in category_columns(dated) if c in used]
    if categories:
        dated = stored(dated, "dated_rows") if codes is None else dated
        dated = apply_codes(dated, fit_codes(dated, categories) if codes is None else codes, categories)
    needed = {*columns, *used, *[f"_keep_{c}" for c in keep]}
    keyed = with_entity_key(dated) if "_uid" in counted else dated
    encoded = with_frequency(keyed.select(*[c for c in keyed.columns if c in needed]), counted, frequencies)
    present = set(encoded.columns)
    return encoded.select(
        *[F.col(f"_keep_{c}").alias(c) for c in keep],
        *[
            (F.col(c).try_cast("float") if c in present else F.lit(None).cast("float")).alias(c)
            for c in columns
            if c not in keep
        ],
    )
