"""Mix sources to target weights by a multivariate-hypergeometric splitting tree.

The documents of a source lie in blocks. A source's target fixes how many blocks the
mix takes: whole passes over the source, then part of a last pass, each pass in an
order of its own. A tree over the output shards splits the block quotas of all
sources: at each node the left half draws its share of every source without
replacement, so the leaves hold exact quotas that add up. A shard's quota is a run of
positions in the permuted order of the source's blocks, so shards are disjoint; inside
a shard, documents are shuffled locally.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.common import WORD_PATTERN, quoted, stored, text_or_empty

PLAN = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("source_no", T.IntegerType()),
        T.StructField("source_size", T.LongType()),
        T.StructField("target", T.DoubleType()),
        T.StructField("n_blocks", T.LongType()),
        T.StructField("passes", T.IntegerType()),
        T.StructField("left_over", T.DoubleType()),
    ]
)


@dataclass(frozen=True)
class MixSettings:
    weights: tuple[float, ...] = (1.0, 2.0, 3.0)  # repeating over the sources, by code point, null last
    share: float = 1.0  # size of the mix as a share of all sizes
    most_repeats: int = 3
    block_documents: int = 256
    shard_blocks: int = 64
    shard_words: int = 2_000_000  # a shard has fewer blocks where these would hold more words
    most_partitions: int = 50_000  # of the shuffle that gathers shards
    seed: int = 23


def targets(sizes: Sequence[int], weights: Sequence[float], total: float, most_repeats: float) -> list[float]:
    """Shares of ``total`` by weight, none above ``most_repeats`` times its size.

    The excess is shared again by weight until nothing is above. Sources reach their
    limit in the order of limit per weight, so one walk in that order settles all.
    """
    found = [0.0] * len(sizes)
    limits = [most_repeats * size for size in sizes]
    left, weight_left = float(total), float(sum(weights))
    order = sorted(range(len(sizes)), key=lambda i: (limits[i] / weights[i], i))
    for place, i in enumerate(order):
        if limits[i] * weight_left > left * weights[i]:
            for j in order[place:]:
                found[j] = left * weights[j] / weight_left
            break
        found[i] = float(limits[i])
        left -= limits[i]
        weight_left -= weights[i]
    return found


def _place(block: Column, n_blocks: Column, source_no: Column, turn: Column) -> Column:
    """The place of a block in a pass: multiplication by a number prime to the count, plus a shift.

    Blocks are filled by hash, so any order of them is a random one; this one needs no sort.
    """
    shift = F.pmod(F.xxhash64(F.lit("pass"), source_no, turn), n_blocks)
    return F.pmod(block * _multiplier(n_blocks, source_no, turn) + shift, n_blocks)


PRIMES = (1_000_003, 1_000_033, 1_000_037, 1_000_039, 1_000_081)


def _multiplier(n_blocks: Column, source_no: Column, turn: Column) -> Column:
    """The first prime, from a start that differs by pass, that does not divide the count.

    The product of the five primes is above 10 ** 30, so one of them always serves.
    """
    primes = F.array(*[F.lit(p).cast("bigint") for p in PRIMES])
    start = F.pmod(source_no + turn, F.lit(len(PRIMES))).cast("int")
    turned = F.concat(F.slice(primes, start + 1, len(PRIMES)), primes)
    return F.element_at(F.filter(turned, lambda p: n_blocks % p != 0), 1)


def sized(docs: DataFrame, id_column: str, text: str, source: str) -> DataFrame:
    """doc_id, source, size (words of the whole text; 0 for null) and a digest of id and text."""
    return docs.select(
        F.col(quoted(id_column)).alias("doc_id"),
        F.col(quoted(source)).cast("string").alias("source"),
        F.regexp_count(text_or_empty(text), F.lit(WORD_PATTERN)).cast("bigint").alias("size"),
        _digest(quoted(id_column), quoted(text)).alias("digest"),
    )


def _digest(id_column: str, text: str) -> Column:
    return F.xxhash64(F.lit("document"), F.col(id_column), F.col(text))


def source_plan(rows: DataFrame, settings: MixSettings) -> DataFrame:
    """One row per source with its target; the sources' totals are all that reaches the driver."""
    totals = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    # Order by code point; a null source comes last.
    totals.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8")))
    weights = [settings.weights[i % len(settings.weights)] for i in range(len(totals))]
    sizes = [r["size"] for r in totals]
    plan = []
    for i, (r, target) in enumerate(zip(totals, targets(sizes, weights, settings.share * sum(sizes), settings.most_repeats))):
        size = r["size"]
        passes = min(settings.most_repeats, math.floor(target / size)) if size else 0
        left_over = max(0.0, target - passes * size) if passes < settings.most_repeats else 0.0
        n_blocks = math.ceil(r["n"] / settings.block_documents)
        plan.append((r["source"], i, size, target, n_blocks, passes, left_over))
    return rows.sparkSession.createDataFrame(plan, PLAN)


def with_blocks(rows: DataFrame, plan: DataFrame, source: str = "source", digest: str = "digest") -> DataFrame:
    """Rows with their source's plan and their block."""
    known = plan.withColumnRenamed("source", "_plan_source")
    joined = rows.join(known, F.col(quoted(source)).eqNullSafe(F.col("_plan_source"))).drop("_plan_source")
    return joined.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), F.col(digest)), F.col("n_blocks")))


RUN_BLOCKS = 4096


def last_pass(rows: DataFrame) -> DataFrame:
    """source_no, whole_blocks, place, chosen: what the unfinished pass of a source takes.

    Whole blocks in the order of the pass while they fit, and of the block after them
    the documents (digests) that still fit, in digest order. The room that is left goes
    on through the blocks behind it, where only documents that are no larger than the
    room count, and so on until no such document is left: a very long document is passed
    over and what is missing is less than the smallest document that was. ``chosen``
    holds the digests that the block at ``place`` gives; blocks from ``whole_blocks`` on
    that are not listed give nothing. Places are found by running sums over runs of
    blocks, then over the blocks of one run, so no step handles all documents of a source.
    """
    place = _place(F.col("block"), F.col("n_blocks"), F.col("source_no"), F.col("passes"))
    unfinished = rows.where("left_over > 0").select("source_no", "left_over", "digest", "size", place.alias("place"))
    unfinished = stored(unfinished, "mix_unfinished")
    nowhere = unfinished.select("source_no", F.col("left_over").alias("room")).distinct()
    # One row per source, as in source_plan: sent to the documents, so that a large source is no key.
    at = _crossings(unfinished.join(F.broadcast(nowhere), "source_no"))
    first = at.select("source_no", F.col("place").alias("whole_blocks"))
    reached = at.select("source_no", F.col("place").alias("from"), "room", "place")
    parts = []
    while True:
        parts.append(stored(_fitting(unfinished, reached), "mix_parts"))
        taken = parts[-1].groupBy("source_no").agg(F.sum("taken").alias("taken"))
        left = reached.join(taken, "source_no", "left").select(
            "source_no", F.col("place").alias("from"), (F.col("room") - F.coalesce("taken", F.lit(0))).alias("room")
        )
        left = stored(left, "mix_room")
        # Each round ends with less room than the smallest document it passed over, so there are few.
        behind = unfinished.join(F.broadcast(left), "source_no").where("place > from and size > 0 and size <= room")
        crossed = _crossings(behind)
        if crossed.isEmpty():
            break
        # The room at the start of the round; the block that ends it is the last one looked at.
        ends = crossed.select("source_no", "place")
        reached = stored(left.join(ends, "source_no").select("source_no", (F.col("from") + 1).alias("from"), "room", "place"), "mix_reached")
    listed = parts[0]
    for more in parts[1:]:
        listed = listed.unionByName(more)
    return listed.join(first, "source_no", "right").select("source_no", "whole_blocks", "place", "chosen")


def _crossings(rows: DataFrame) -> DataFrame:
    """Per source the last place that begins within ``room`` (place), and the room left there.

    ``rows`` holds source_no, place, size and room.
    """
    blocks = rows.groupBy("source_no", "room", "place").agg(F.sum("size").alias("words"))
    blocks = stored(blocks.withColumn("run", F.floor(F.col("place") / RUN_BLOCKS)), "mix_blocks")

    def crossed(sums: DataFrame, by: str, room: str) -> DataFrame:
        before = Window.partitionBy("source_no").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        begun = sums.withColumn("_room", F.col(room) - F.coalesce(F.sum("words").over(before), F.lit(0)))
        last = F.max(F.struct(by, "_room"))
        return begun.where("_room >= 0").groupBy("source_no").agg(last.alias("_last")).select(
            "source_no", F.col(f"_last.{by}").alias(by), F.col("_last._room").alias("room")
        )

    runs = blocks.groupBy("source_no", "room", "run").agg(F.sum("words").alias("words"))
    at_run = crossed(runs, "run", "room").withColumnRenamed("room", "run_room")
    return stored(crossed(blocks.join(at_run, ["source_no", "run"]), "place", "run_room"), "mix_crossings")


def _fitting(rows: DataFrame, reached: DataFrame) -> DataFrame:
    """source_no, place, chosen, taken: of the blocks ``from`` to ``place`` the documents that fit into ``room``.

    The documents of the blocks before the last one all fit, except where equal digests
    (repeated rows, taken together or not at all) are larger than the room.
    """
    here = rows.join(F.broadcast(reached.withColumnRenamed("place", "last")), "source_no").where("place >= from and place <= last and size <= room")
    units = here.groupBy("source_no", "place", "last", "room", "digest").agg(F.sum("size").cast("double").alias("size"))
    blocks = units.where("size <= room").groupBy("source_no", "place", "last", "room").agg(
        F.array_sort(F.collect_list(F.struct("digest", "size"))).alias("units"), F.sum("size").alias("words")
    )
    blocks = stored(blocks, "mix_units")
    before = blocks.where("place < last").groupBy("source_no").agg(F.sum("words").alias("before"))
    start = F.struct(F.col("open").alias("room"), F.array().cast("array<bigint>").alias("chosen"))

    def take(state: Column, unit: Column) -> Column:
        fits = unit["size"] <= state["room"]
        return F.struct(
            F.when(fits, state["room"] - unit["size"]).otherwise(state["room"]).alias("room"),
            F.when(fits, F.concat(state["chosen"], F.array(unit["digest"]))).otherwise(state["chosen"]).alias("chosen"),
        )

    left = F.col("room") - F.coalesce("before", F.lit(0.0))
    opened = blocks.join(F.broadcast(before), "source_no", "left").withColumn("open", F.when(F.col("place") < F.col("last"), F.col("words")).otherwise(left).cast("double"))
    made = opened.withColumn("end", F.aggregate("units", start, take))
    return made.select("source_no", "place", "end.chosen", (F.col("open") - F.col("end.room")).alias("taken")).where("size(chosen) > 0")


def shard_ranges(
    spark: SparkSession, quotas: list[tuple[int, int]], settings: MixSettings
) -> tuple[DataFrame, int]:
    """(source_no, shard, first, stop): the draws of each source that a shard takes; and the number of shards.

    ``quotas`` has the exact number of blocks of each source. Each task walks the tree
    from the root to its own shards; the draw at a node depends on the seed and the
    node alone, so all tasks see the same tree.
    """
    total = sum(q for _, q in quotas)
    n_shards = max(1, math.ceil(total / settings.shard_blocks))
    numbers, counts = [n for n, _ in quotas], np.array([q for _, q in quotas], np.int64)
    seed = settings.seed

    def leaf(shard: int) -> tuple[np.ndarray, np.ndarray]:
        """The shard's quotas, and the draws of each source that earlier shards take."""
        low, high, have, earlier = 0, n_shards, counts, np.zeros_like(counts)
        while high - low > 1:
            middle = (low + high) // 2
            left_size = middle * total // n_shards - low * total // n_shards
            random = np.random.default_rng([seed, low, high])
            left = _draw(random, have, left_size)
            if shard < middle:
                have, high = left, middle
            else:
                have, earlier, low = have - left, earlier + left, middle
        return have, earlier

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                have, earlier = leaf(shard)
                hit = np.flatnonzero(have)
                yield pa.RecordBatch.from_pydict(
                    {
                        "source_no": pa.array([numbers[i] for i in hit], pa.int32()),
                        "shard": pa.array([shard] * len(hit), pa.int64()),
                        "first": pa.array(earlier[hit], pa.int64()),
                        "stop": pa.array((earlier + have)[hit], pa.int64()),
                    }
                )

    ranges = spark.range(n_shards).mapInArrow(leaves, "source_no int, shard bigint, first bigint, stop bigint")
    return ranges, n_shards


def _draw(random: np.random.Generator, have: np.ndarray, n: int) -> np.ndarray:
    """A multivariate hypergeometric draw of ``n`` blocks as a chain of univariate ones."""
    drawn, left = np.zeros_like(have), int(have.sum())
    for i, own in enumerate(have):
        left -= int(own)
        if n and own:
            drawn[i] = random.hypergeometric(int(own), left, n) if left else n
            n -= int(drawn[i])
    return drawn


def block_draws(spark: SparkSession, rows: DataFrame, plan: DataFrame, settings: MixSettings) -> tuple[DataFrame, int]:
    """(source_no, block, draws): for each block the passes and shards that take it; and the number of shards.

    A draw names the ``chosen`` digests if it takes only part of the block, else null.
    """
    last = stored(last_pass(rows), "mix_last_pass")
    # One row per source, as in source_plan.
    parts = F.coalesce(F.max("place") + 1, F.max("whole_blocks"))
    ends = last.groupBy("source_no").agg(F.max("whole_blocks").alias("whole_blocks"), parts.alias("parts"))
    quotas = plan.join(ends, "source_no", "left")
    counted = quotas.select(
        "source_no", "target", (F.col("passes") * F.col("n_blocks") + F.coalesce("parts", F.lit(0))).alias("quota")
    ).collect()
    blocks, words = sum(r["quota"] for r in counted), sum(r["target"] for r in counted)
    by_words = max(1, math.floor(settings.shard_words * blocks / words)) if words else settings.shard_blocks
    sized_shards = replace(settings, shard_blocks=min(settings.shard_blocks, by_words))
    ranges, n_shards = shard_ranges(spark, sorted((r["source_no"], r["quota"]) for r in counted), sized_shards)

    draws = ranges.withColumn("draw", F.explode(F.sequence("first", F.col("stop") - 1))).join(
        quotas.select("source_no", "n_blocks", "passes", "whole_blocks"), "source_no"
    )
    draws = draws.withColumns({"turn": F.floor(F.col("draw") / F.col("n_blocks")).cast("int"), "place": F.col("draw") % F.col("n_blocks")})
    # Blocks are found from places by listing the places of all blocks of a pass.
    turns = plan.select("source_no", "n_blocks", F.explode(F.sequence(F.lit(0), F.col("passes"))).alias("turn"))
    blocks = turns.where("n_blocks > 0").select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_blocks") - 1)).alias("block"))
    blocks = blocks.select(
        "source_no", "turn", "block", _place(F.col("block"), F.col("n_blocks"), F.col("source_no"), F.col("turn")).alias("place")
    )
    part = last.where("place is not null").select("source_no", "place", F.col("chosen").alias("_chosen")).join(
        plan.select("source_no", F.col("passes").alias("turn")), "source_no"
    )
    named = draws.join(blocks, ["source_no", "turn", "place"]).join(part, ["source_no", "turn", "place"], "left")
    in_part = (F.col("turn") == F.col("passes")) & (F.col("place") >= F.col("whole_blocks"))
    chosen = F.when(in_part, F.coalesce("_chosen", F.array().cast("array<bigint>")))
    named = named.withColumn("chosen", chosen)
    return named.groupBy("source_no", "block").agg(F.collect_list(F.struct("turn", "shard", "chosen")).alias("draws")), n_shards


def _own_draws(digest: str) -> Column:
    """A document's draws among its block's."""
    mine = F.filter("draws", lambda d: d["chosen"].isNull() | F.array_contains(d["chosen"], F.col(digest)))
    return F.coalesce(mine, F.array().cast("array<struct<turn:int,shard:bigint,chosen:array<bigint>>>"))


def mix_amounts(
    docs: DataFrame,
    settings: MixSettings = MixSettings(),
    id_column: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken, shards.

    Sizes are words. ``copies`` is how often the mix takes the document, ``taken`` its
    words in the mix, ``shards`` the output shard of each copy. Null and blank texts
    have size 0 and may be copied; a null source is a source of its own. Repeated rows
    are separate documents with equal fates. Other columns are ignored. A source misses
    its target by less than the smallest document that the last pass passed over.
    """
    rows = stored(sized(docs, id_column, text, source), "mix_sizes")
    plan = source_plan(rows, settings)
    placed = with_blocks(rows, plan)
    draws = stored(block_draws(docs.sparkSession, placed, plan, settings)[0], "mix_draws")
    joined = placed.join(draws, ["source_no", "block"], "left").withColumn("own", _own_draws("digest"))
    copies = F.size("own").cast("bigint")
    return joined.select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"),
        (F.col("size") * copies).alias("taken"), F.transform("own", lambda d: d["shard"]).alias("shards"),
    )


def mix(
    docs: DataFrame,
    settings: MixSettings = MixSettings(),
    id_column: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """The mix itself: all columns of ``docs``, a row for each copy, shuffled.

    Rows of a shard lie together, in an order given by digests: writing the result
    gives files that can be read front to back in random order.
    """
    rows = stored(sized(docs, id_column, text, source), "mix_sizes")
    plan = source_plan(rows, settings)
    draws, n_shards = block_draws(docs.sparkSession, with_blocks(rows, plan), plan, settings)
    draws = stored(draws, "mix_draws")
    # Packed, so that no column of the documents can clash with those of the plan.
    carried = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("doc"))
    carried = carried.select(
        "doc",
        F.col(f"doc.{quoted(source)}").cast("string").alias("source"),
        _digest(f"doc.{quoted(id_column)}", f"doc.{quoted(text)}").alias("digest"),
    )
    placed = with_blocks(carried, plan)
    taken = placed.join(draws, ["source_no", "block"]).select("doc", "digest", F.explode(_own_draws("digest")).alias("d"))
    keyed = taken.select("doc", F.col("d.shard").alias("shard"), F.xxhash64(F.lit(settings.seed), "digest", "d.turn").alias("order"))
    # Every shard, or run of neighbouring shards, is a partition.
    n_partitions = min(n_shards, settings.most_partitions)
    at = F.floor(F.col("shard") * n_partitions / n_shards).cast("int")
    return keyed.repartitionById(n_partitions, at).sortWithinPartitions("shard", "order").select("doc.*")

