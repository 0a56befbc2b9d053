"""What several operators share: folds, stored steps, words and free column names."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.session import scratch_path

# Words are runs of anything but blank, tab, \n, \v, \f and \r: exactly what
# ``bytes.split()`` and this pattern find.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a step to the shared folder and read it again: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(column: str) -> Column:
    """The text column as a string, a null as empty text."""
    return F.coalesce(F.col(quoted(column)).cast("string"), F.lit(""))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def fold(id_column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(quoted(id_column)).cast("string")) % folds


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        found.append(name)
    return found


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_blocks(data: bytes, size: int = 1 << 18) -> Iterator[list[bytes]]:
    """The words of a text in blocks, so that a very long text is never held as one list."""
    while True:
        words = data.split(None, size)
        if len(words) <= size:
            if words:
                yield words
            return
        data = words.pop()
        yield words


def digest_sample(rows: DataFrame, by: str, n: int, seed: int, key: str) -> DataFrame:
    """Up to ``n`` rows for each value of ``by``, those with the lowest digests of ``key``: the same on every run.

    Counts tell below which digest the sample must lie, with a margin of eight standard
    deviations, so only little more than the sample is shuffled to be ranked.
    """
    digest, share, rank = fresh(rows, "_digest", "_share", "_rank")
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias(share))
    reach = counts.withColumn(share, (n + 8 * n**0.5 + 64) / F.col(share))
    keyed = rows.withColumn(digest, F.xxhash64(F.lit(seed), key))
    # Digests are spread evenly over 64 bits.
    # One row for each value, against n rows of each in the sample itself.
    near = keyed.join(F.broadcast(reach), by).where(F.col(digest) / 2.0**64 + 0.5 < F.col(share))
    ranked = near.withColumn(rank, F.row_number().over(Window.partitionBy(by).orderBy(digest, key)))
    return ranked.where(F.col(rank) <= n).drop(digest, share, rank)
