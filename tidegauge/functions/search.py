"""Position of a value in a sorted array column, inside generated code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS_PER_STEP = 2  # wider steps outgrow the method size the JVM compiles


def count_at_most(df: DataFrame, array: str, key: str, capacity: int, into: str) -> DataFrame:
    """Add ``into``: how many entries of the sorted ``array`` column are <= ``key``.

    ``capacity`` bounds the array's length. The search is one projection per two
    bits of ``capacity``, each two comparisons deep, so 20,000 entries take eight
    projections that Spark fuses into one generated stage; the array is never
    copied. A NULL key or array gives 0.
    """
    steps = -(-max(capacity, 1).bit_length() // BITS_PER_STEP)
    out = df.withColumn(into, F.lit(0))
    for i in range(steps):
        width = 2 ** (BITS_PER_STEP * (steps - 1 - i))
        out = out.withColumn(into, F.expr(_narrow(array, key, into, width, 0, 2**BITS_PER_STEP)))
    return out


def _narrow(array: str, key: str, base: str, width: int, low: int, high: int) -> str:
    if high - low == 1:
        return f"`{base}` + {low * width}"
    middle = (low + high) // 2
    return (
        f"CASE WHEN get(`{array}`, `{base}` + {middle * width - 1}) <= `{key}`"
        f" THEN {_narrow(array, key, base, width, middle, high)}"
        f" ELSE {_narrow(array, key, base, width, low, middle)} END"
    )
