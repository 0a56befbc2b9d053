"""Two-sided Kolmogorov-Smirnov p-values, in built-in expressions.

The two-sample statistic d is referred to the one-sample distribution with
n = n_ref * n_cur / (n_ref + n_cur) rows, evaluated by the asymptotic series of
Pelz and Good (1976): K0(z) + K1(z)/sqrt(n) + K2(z)/n + K3(z)/n^1.5, z = d sqrt(n).
For small samples the exact two-sample distribution is there as well.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TERMS = 16
Z_CERTAIN = 0.2  # below it 1 - p is under 1e-12
Z_TAIL = 4.0  # above it only the first tail term is taken; p is under 1e-13 there


def exact_two_sample(d: float, n: int, m: int) -> float:
    """P(D >= d) for samples of ``n`` and ``m`` values without ties.

    A random merge of the samples is a lattice path from (0, 0) to (n, m). The chance
    that it meets |i/n - j/m| >= d is added up diagonal by diagonal; it is 1 outside the
    band, so small chances keep their precision.
    """
    # Distances are whole multiples of 1/(n m).
    reach = round(d * n * m)
    if reach <= 0:
        return 1.0
    met = np.zeros(n + 1)
    i = np.arange(n + 1)
    for steps in range(1, n + m + 1):
        j = steps - i
        from_left = np.concatenate([[0.0], met[:-1]])
        met = np.where(np.abs(i * m - j * n) >= reach, 1.0, (i * from_left + j * met) / steps)
        met[(j < 0) | (j > m)] = 0.0
    return float(min(1.0, met[n]))


@F.arrow_udf(T.DoubleType())
def _exact(d: pa.Array, n: pa.Array, m: pa.Array) -> pa.Array:
    rows = zip(d.to_pylist(), n.to_pylist(), m.to_pylist())
    return pa.array([exact_two_sample(*r) if None not in r and r[1] and r[2] else None for r in rows], pa.float64())


def exact_ks_pvalue(statistic: str, n_ref: str, n_cur: str, at_most: int) -> Column:
    """The exact p-value of result rows whose samples are both ``at_most`` values long, else null.

    n + m steps over the shorter sample's length each, and one row per batch and feature.
    """
    small = F.greatest(n_ref, n_cur) <= at_most
    shorter, longer = F.least(n_ref, n_cur).cast("bigint"), F.greatest(n_ref, n_cur).cast("bigint")
    given = [F.when(small, c) for c in (F.col(statistic), shorter, longer)]
    return _exact(*given)


def with_ks_pvalue(df: DataFrame, statistic: str, n_ref: str, n_cur: str, into: str) -> DataFrame:
    """Add ``into``: P(D >= statistic) for samples of ``n_ref`` and ``n_cur`` values.

    Meant for result rows (one per batch and feature), not for data rows.
    """
    kept = df.columns
    sized = df.withColumn(
        "_ks_n", F.expr(f"rint(CAST(`{n_ref}` AS DOUBLE) * `{n_cur}` / nullif(`{n_ref}` + `{n_cur}`, 0))")
    ).withColumn("_ks_z", F.expr(f"`{statistic}` * sqrt(_ks_n)"))
    # h<p>: sums over half-integers, w<p>: over whole numbers, of x^p exp(-(pi x)^2 / 2z^2)
    sums = {f"_ks_h{p}": _series("k + 0.5D", 0, p) for p in (0, 2, 4, 6)}
    sums |= {f"_ks_w{p}": _series("CAST(k AS DOUBLE)", 1, p) for p in (2, 4)}
    summed = sized.withColumns({name: F.expr(sql) for name, sql in sums.items()})
    terms = {
        "_ks_k0": "sqrt(2 * pi()) / _ks_z * _ks_h0",
        "_ks_k1": "sqrt(pi() / 2) / (3 * pow(_ks_z, 4))"
        " * (pow(pi(), 2) * _ks_h2 - pow(_ks_z, 2) * _ks_h0)",
        "_ks_k2": "sqrt(pi() / 2) / (36 * pow(_ks_z, 7)) * ("
        "(6 * pow(_ks_z, 6) + 2 * pow(_ks_z, 4)) * _ks_h0"
        " + pow(pi(), 2) * (2 * pow(_ks_z, 4) - 5 * pow(_ks_z, 2)) * _ks_h2"
        " + pow(pi(), 4) * (1 - 2 * pow(_ks_z, 2)) * _ks_h4)"
        " - sqrt(pi() / 2) * pow(pi(), 2) / (18 * pow(_ks_z, 3)) * _ks_w2",
        "_ks_k3": "sqrt(pi() / 2) / (3240 * pow(_ks_z, 10)) * ("
        "pow(pi(), 6) * (5 - 30 * pow(_ks_z, 2)) * _ks_h6"
        " + pow(pi(), 4) * (212 * pow(_ks_z, 4) - 60 * pow(_ks_z, 2)) * _ks_h4"
        " + pow(pi(), 2) * (135 * pow(_ks_z, 4) - 96 * pow(_ks_z, 6)) * _ks_h2"
        " - (30 * pow(_ks_z, 6) + 90 * pow(_ks_z, 8)) * _ks_h0)"
        " + sqrt(pi() / 2) / (108 * pow(_ks_z, 6))"
        " * (3 * pow(pi(), 2) * pow(_ks_z, 2) * _ks_w2 - pow(pi(), 4) * _ks_w4)",
    }
    # rows with z under Z_CERTAIN would divide by nearly 0 and skip the series
    guarded = summed.withColumns(
        {name: F.expr(f"CASE WHEN _ks_z >= {Z_CERTAIN} THEN {sql} END") for name, sql in terms.items()}
    )
    return guarded.withColumn(
        into,
        F.expr(
            f"CASE WHEN _ks_z < {Z_CERTAIN} THEN 1D WHEN _ks_z >= {Z_TAIL} THEN 2 * exp(-2 * pow(_ks_z, 2))"
            " ELSE least(1D, greatest(0D, 1 - (_ks_k0 + _ks_k1 / sqrt(_ks_n) + _ks_k2 / _ks_n"
            " + _ks_k3 / pow(_ks_n, 1.5)))) END"
        ),
    ).select(*kept, into)


def _series(point: str, first: int, power: int) -> str:
    last = first + TERMS - 1
    return (
        f"CASE WHEN _ks_z >= {Z_CERTAIN} THEN aggregate(transform(sequence({first}, {last}),"
        f" k -> pow({point}, {power}) * exp(-pow(pi() * ({point}), 2) / (2 * pow(_ks_z, 2)))),"
        " 0D, (total, x) -> total + x) END"
    )
