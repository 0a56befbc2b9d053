"""Nearest neighbours by randomly rotated one-bit codes, with error bounds that choose what is reranked.

A unit vector is rotated at random and coded by the signs of its coordinates. With the
inner product of vector and code as a correction, the packed bits give an unbiased
estimate of any inner product and the spread of its error. Only vectors whose upper
bound reaches the exact score of the current k-th neighbour are compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import quoted, stored


@dataclass(frozen=True)
class AnnSettings:
    k: int = 5
    block_rows: int = 4096  # vectors compared in one task
    group_rows: int = 2048  # queries compared in one task
    query_bits: int = 6
    spread: float = 3.2  # bound of the estimate's error in standard deviations
    seed: int = 41


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, the same for everyone who knows dimension and seed."""
    raw = np.random.default_rng([seed, dim]).standard_normal((dim, dim))
    q, r = np.linalg.qr(raw)
    return q * np.sign(np.diag(r))


@dataclass(frozen=True)
class Codes:
    """Packed signs (words of 64 bits), ones per code, and the correction of each vector."""

    bits: np.ndarray
    ones: np.ndarray
    factor: np.ndarray  # inner product of the vector and its code


def encode(units: np.ndarray, turn: np.ndarray) -> Codes:
    turned = units @ turn
    signs = turned > 0
    n, dim = turned.shape
    padded = np.zeros((n, -(-dim // 64) * 64), bool)
    padded[:, :dim] = signs
    bits = np.packbits(padded, axis=1, bitorder="little").view("<u8")
    return Codes(bits, signs.sum(axis=1), np.abs(turned).sum(axis=1) / np.sqrt(dim))


def estimates(codes: Codes, query: np.ndarray, turn: np.ndarray, settings: AnnSettings) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of a unit query with all coded vectors, and their error bounds.

    The rotated query is rounded to a few bits; its planes meet the codes by AND and
    bit counts. The rounding error is bounded exactly, that of the code statistically.
    """
    dim = len(query)
    turned = query @ turn
    low, high = turned.min(), turned.max()
    step = (high - low) / ((1 << settings.query_bits) - 1) or 1.0
    levels = np.rint((turned - low) / step).astype(np.int64)
    padded = np.zeros(codes.bits.shape[1] * 64, np.int64)
    padded[:dim] = levels
    total = np.zeros(len(codes.bits), np.int64)
    for plane in range(settings.query_bits):
        mask = np.packbits((padded >> plane & 1).astype(bool), bitorder="little").view("<u8")
        total += np.bitwise_count(codes.bits & mask).sum(axis=1, dtype=np.int64) << plane
    # Signs are 2 * bit - 1, and a coordinate of the query is low + step * level.
    signed = 2 * (step * total + low * codes.ones) - (step * levels.sum() + low * dim)
    estimate = signed / np.sqrt(dim) / codes.factor
    rounding = np.abs(turned - (low + step * levels)).sum() / np.sqrt(dim) / codes.factor
    sine = np.sqrt(np.maximum(0.0, 1 - codes.factor**2))
    return estimate, settings.spread * sine / codes.factor / np.sqrt(max(1, dim - 1)) + rounding


def cosine(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosines in double precision, summed from the first component to the last, whatever the other rows are."""

    def summed(products: np.ndarray) -> np.ndarray:
        return np.cumsum(products, axis=-1)[..., -1]

    return summed(vectors * query) / (np.sqrt(summed(query * query)) * np.sqrt(summed(vectors * vectors)))


def nearest(
    queries: np.ndarray, vectors: np.ndarray, keys: np.ndarray, k: int, settings: AnnSettings
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query the places and exact scores of its ``k`` nearest vectors, ties to the smaller key."""
    turn = rotation(vectors.shape[1], settings.seed)
    codes = encode(vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True)), turn)
    first = min(len(vectors), 8 * k)
    for query in queries:
        estimate, bound = estimates(codes, query / np.sqrt((query * query).sum()), turn, settings)
        # The best estimates give the score to beat; all that may reach it are reranked.
        start = np.argpartition(-estimate, first - 1)[:first]
        beat = np.partition(cosine(vectors[start], query), first - min(k, first))[first - min(k, first)]
        places = np.flatnonzero(estimate + bound >= beat)
        places = np.union1d(places, start)
        scores = cosine(vectors[places], query)
        best = np.lexsort((keys[places], -scores))[:k]
        yield places[best], scores[best]


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, no null or non-finite component, not zero."""
    finite = lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def search(
    rows: DataFrame, queries: DataFrame, settings: AnnSettings = AnnSettings(), id_column: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the nearest rows found for each query.

    ``queries`` holds rows of ``rows``; a query's own row is no candidate. The score is
    the cosine of the vectors as given, in double precision; ties go to the smaller id.
    Null, zero and non-finite vectors and rows without an id take no part; vectors are
    compared with those of equal length only. Equal vectors are compared once: each
    different vector carries its k + 1 smallest ids, more can never be needed. Rows
    repeated with id and vector count once. Other columns are ignored. All rows are
    compared with all queries, block by block.
    """
    def clean(df: DataFrame) -> DataFrame:
        columns = F.col(quoted(id_column)).cast("bigint").alias("id"), F.col(quoted(vector)).cast("array<double>").alias("v")
        return df.select(*columns).where("id is not null").where(usable(F.col("v")))

    k = settings.k
    vectors = clean(rows)
    # Ranks are limited map-side first, so a vector that many rows share is no large group.
    rank = F.dense_rank().over(Window.partitionBy("v").orderBy("id"))
    fewest = vectors.withColumn("n", rank).where(F.col("n") <= k + 1)
    different = fewest.groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    different = stored(different.withColumn("key", F.col("ids")[0]).withColumn("dim", F.size("v")), "vectors")
    asked = clean(queries).distinct()
    asked = stored(asked.join(different.select("v", "key", "dim"), "v"), "asked")
    targets = asked.select("key", "v", "dim").distinct()

    sizes = different.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / settings.block_rows).alias("n_blocks"))
    group_sizes = targets.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / settings.group_rows).alias("n_groups"))
    plan = sizes.join(group_sizes, "dim")
    block = F.pmod(F.xxhash64("key"), F.col("n_blocks"))
    group = F.pmod(F.xxhash64(F.lit("query"), "key"), F.col("n_groups"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    held = different.select("key", "v", "dim").join(plan, "dim").withColumn("block", block).withColumn("group", every("n_groups"))
    sought = targets.join(plan, "dim").withColumn("group", group).withColumn("block", every("n_blocks"))
    at = ["dim", "block", "group"]

    def compare(own: pd.DataFrame, against: pd.DataFrame) -> pd.DataFrame:
        found: dict[str, list] = {"query": [], "key": [], "score": []}
        if len(own) and len(against):
            keys = against["key"].to_numpy()
            pairs = nearest(np.stack(own["v"]), np.stack(against["v"]), keys, k + 1, settings)
            for query, (places, scores) in zip(own["key"], pairs):
                found["query"] += [query] * len(places)
                found["key"] += keys[places].tolist()
                found["score"] += scores.tolist()
        return pd.DataFrame(found)

    near = (
        sought.select(*at, "key", "v")
        .groupBy(*at)
        .cogroup(held.select(*at, "key", "v").groupBy(*at))
        .applyInPandas(compare, "query bigint, key bigint, score double")
    )
    # k + 1 vectors per query and block; their ids make the final list.
    best = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    near = near.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    near = near.join(different.select("key", "ids"), "key")
    listed = near.groupBy("query").agg(
        F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct((-F.col("score")).alias("far"), i.alias("id"))))).alias("near")
    )
    own = F.filter("near", lambda c: c["id"] != F.col("id"))
    answers = asked.select("id", F.col("key").alias("query")).join(listed, "query")
    answers = answers.select("id", F.posexplode(F.slice(F.array_sort(own), 1, k)).alias("place", "hit"))
    return answers.select(
        F.col("id").alias("query_id"),
        (F.col("place") + 1).alias("rank"),
        F.col("hit.id").alias("vec_id"),
        (-F.col("hit.far")).alias("score"),
    )
