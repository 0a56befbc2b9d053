"""Uniform samples without replacement, reproducible and independent of partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.missing import quoted
from tidegauge.operators.ordering import HASH_GROUP_CHARS, RowOrder, find_splits

REACH_GROUP_CHARS = 2  # 256 groups of digests, counted per feature


def row_hash(seed: int | Column, *row_key: str | Column) -> Column:
    """A hex digest of the seed and a unique row key; sorting by it shuffles the rows."""
    parts = [F.lit(str(seed)) if isinstance(seed, int) else seed]
    parts += [(F.col(k) if isinstance(k, str) else k).cast("string") for k in row_key]
    return F.md5(F.concat_ws("|", *parts))


def counts_by_prefix(df: DataFrame, features: Sequence[str], hash_: str, by: Sequence[str] = ()) -> DataFrame:
    """One pass over the rows: by..., prefix, n_rows, counts (non-NULL values per feature), total (of the last).

    At most 65,536 rows per group, whatever the input's size.
    """
    return df.groupBy(*by, F.substring(hash_, 1, HASH_GROUP_CHARS).alias("prefix")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.expr(f"array({', '.join(f'count({quoted(f)})' for f in features)})").alias("counts"),
        F.sum(F.col(features[-1])).alias("total"),
    )


def sample_values(
    df: DataFrame, features: Sequence[str], hash_: str, cap: int, counts: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """Up to ``cap`` non-NULL values per feature: by..., slot, value.

    A feature's sample is its non-NULL values with the lowest row digests.
    ``counts`` (:func:`counts_by_prefix`) tells how far down the sample reaches;
    only rows within that reach are unpivoted and ranked. ``slot`` is the
    feature's place in ``features``.
    """
    by = list(by)
    running = Window.partitionBy(*by, "slot").orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)
    reach = (
        counts.select(*by, "prefix", F.posexplode("counts").alias("slot", "_n"))
        .withColumn("_before", F.sum("_n").over(running) - F.col("_n"))
        .where(F.col("_before") < cap)
        .groupBy(*by, "slot")
        .agg(F.max("prefix").alias("_reach"))
    )
    # One row per feature (and group), so safe to broadcast; the widest reach of any
    # feature first drops rows before they are unpivoted.
    prefix = F.substring(hash_, 1, HASH_GROUP_CHARS)
    if by:
        widest = reach.groupBy(*by).agg(F.max("_reach").alias("_widest"))
        near = df.join(F.broadcast(widest), by).where(prefix <= F.col("_widest"))
    else:
        near = df.where(prefix <= reach.agg(F.max("_reach")).scalar())
    values = (
        near.select(*by, hash_, F.posexplode(F.array(*features)).alias("slot", "value"))
        .where("value IS NOT NULL")
        .join(F.broadcast(reach), [*by, "slot"])
        .where(prefix <= F.col("_reach"))
    )
    rank = F.row_number().over(Window.partitionBy(*by, "slot").orderBy(hash_))
    return values.withColumn("_rank", rank).where(F.col("_rank") <= cap).select(*by, "slot", "value")


def last_sampled(df: DataFrame, features: Sequence[str], hash_: str, cap: int, by: Sequence[str] = ()) -> DataFrame:
    """by..., slot, last: the digest of the row with the ``cap``-th lowest one among a feature's non-NULL values.

    A feature with fewer values has no row. A sample of :func:`sample_values` is the values
    of the rows up to ``last``; only the rows of the digest group it lies in are ranked.
    """
    by = list(by)
    prefix = F.substring(hash_, 1, REACH_GROUP_CHARS).alias("prefix")
    counts = df.groupBy(*by, prefix).agg(F.expr(f"array({', '.join(f'count({quoted(f)})' for f in features)})").alias("counts"))
    running = Window.partitionBy(*by, "slot").orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)
    reach = (
        counts.select(*by, "prefix", F.posexplode("counts").alias("slot", "_n"))
        .withColumn("_before", F.sum("_n").over(running) - F.col("_n"))
        .where((F.col("_before") < cap) & (F.col("_before") + F.col("_n") >= cap))
        .select(*by, "slot", "prefix", (cap - F.col("_before")).alias("_left"))
    )
    # One row per feature (and group), so safe to broadcast.
    near = df.withColumn("prefix", prefix).join(F.broadcast(reach.select(*by, "prefix").distinct()), [*by, "prefix"])
    known = F.array(*[F.col(quoted(f)).isNotNull() for f in features])
    inside = (
        near.select(*by, "prefix", F.col(hash_).alias("last"), F.posexplode(known).alias("slot", "_known"))
        .where("_known")
        .join(F.broadcast(reach), [*by, "slot", "prefix"])
    )
    rank = F.row_number().over(Window.partitionBy(*by, "slot").orderBy("last"))
    return inside.withColumn("_rank", rank).where(F.col("_rank") == F.col("_left")).select(*by, "slot", "last")


def trial_hash(seed: int, trial: int | Column, *row_key: str | Column) -> Column:
    """The digest by which a trial shuffles the rows."""
    number = F.lit(str(trial)) if isinstance(trial, int) else trial.cast("string")
    return row_hash(F.concat_ws(":", F.lit(str(seed)), number), *row_key)


def half_marks(df: DataFrame, row_key: Sequence[str | Column], trials: int, seed: int) -> dict[int, str]:
    """The digest each trial's second half begins with; the first half holds ``n div 2`` rows. Empty without rows."""
    numbered = df.select(F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial"), "*")
    found = find_splits(
        numbered.withColumn("row_hash", trial_hash(seed, F.col("trial"), *row_key)),
        RowOrder.by_hash(F.col("row_hash")),
        lambda total: F.array(F.floor(total / F.lit(2)).cast("bigint")),
        by=["trial"],
    )
    return {int(t): digest for t, digest in zip(found.values("trial"), found.values("_level1"))}


def random_halves(df: DataFrame, row_key: Sequence[str | Column], trials: int, seed: int) -> DataFrame:
    """Every row once per trial, with ``trial``, ``row_hash`` and ``first_half``.

    Each trial shuffles the rows by its own digest; the first half holds
    ``n div 2`` of them.
    """
    marks = half_marks(df, row_key, trials, seed)
    numbered = df.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    hashed = numbered.withColumn("row_hash", trial_hash(seed, F.col("trial"), *row_key))
    # One digest per trial.
    listed = F.array(*[F.lit(marks.get(t)).cast("string") for t in range(trials)])
    return hashed.withColumn("first_half", F.col("row_hash") < F.get(listed, F.col("trial")))
