"""What-if rewrites of a feature batch, to see whether the monitor notices."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.settings import COHORT_SHARE

Scenario = Callable[[DataFrame], DataFrame]

# Fixed values of the rewrites.
RESCALE_FACTOR = 100
COHORT_VALUES = {"C1": 1.0, "C13": 1.0, "D1": 0.0, "has_identity": 0, "card1_freq": 1.0}


def unchanged(df: DataFrame) -> DataFrame:
    """The control: nothing to notice in the inputs."""
    return df


def rescale_amount(df: DataFrame, amount: str = "TransactionAmt", factor: float = RESCALE_FACTOR) -> DataFrame:
    """A feed changes units: the amount and its logarithm move, cents and flag stay."""
    kinds = {f.name: f.dataType for f in df.schema}
    scaled = (F.col(amount) * F.lit(factor).cast(kinds[amount])).cast(kinds[amount])
    logged = F.log1p(amount).cast(kinds.get("amt_log", "double"))
    return df.withColumn(amount, scaled).withColumn("amt_log", logged)


def share_of_rows(hash_: Column, share: float) -> Column:
    """True for about ``share`` of the rows, decided by a uniform hex digest."""
    return F.substring(hash_, 1, 8) < F.lit(f"{round(share * 2**32):08x}")


def overwrite_cohort(
    df: DataFrame, chosen: Column, values: Mapping[str, float] = COHORT_VALUES
) -> DataFrame:
    """New customers arrive: ``chosen`` rows take fixed values in the columns ``df`` has."""
    kinds = {f.name: f.dataType for f in df.schema}
    marked = df.withColumn("_chosen", chosen)
    return marked.withColumns(
        {c: F.when(F.col("_chosen"), F.lit(v).cast(kinds[c])).otherwise(F.col(c)) for c, v in values.items() if c in kinds}
    ).drop("_chosen")


def null_out(df: DataFrame, prefix: str = "id_", flag: str = "has_identity") -> DataFrame:
    """A feed goes down: its columns arrive missing and its flag is 0."""
    kinds = {f.name: f.dataType for f in df.schema}
    changed = {c: F.lit(None).cast(kinds[c]) for c in df.columns if c.startswith(prefix)}
    if flag in kinds:
        changed[flag] = F.lit(0).cast(kinds[flag])
    return df.withColumns(changed) if changed else df


def default_scenarios(row_hash: str) -> dict[str, Scenario]:
    """Two controls and three faults; ``row_hash`` names the digest column that picks the cohort."""
    return {
        "healthy (control)": unchanged,
        "currency units bug": rescale_amount,
        "new customer segment": lambda df: overwrite_cohort(df, share_of_rows(F.col(row_hash), COHORT_SHARE)),
        "identity feed outage": null_out,
        "label shift only": unchanged,
    }
