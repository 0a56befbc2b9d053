"""One notion of a missing value: NULL, NaN and both infinities are missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def finite(value: Column) -> Column:
    """``value`` as double, NULL where it is not a finite number.

    Text that is no number also becomes NULL. Spark orders NaN above every
    number, so one comparison covers NaN and +/-Inf.
    """
    number = value.try_cast("double")
    return F.when(F.abs(number) < F.lit(INF), number)


def finite_sql(name: str) -> str:
    """:func:`finite` of a column, as SQL text; cheaper to build for many columns."""
    number = f"try_cast({quoted(name)} AS DOUBLE)"
    return f"CASE WHEN abs({number}) < double('Infinity') THEN {number} END"


def quoted(name: str) -> str:
    """A column name as SQL text."""
    return "`" + name.replace("`", "``") + "`"
