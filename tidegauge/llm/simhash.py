"""Near-duplicate documents: SimHash fingerprints linked through a pigeonring filter.

A fingerprint is a ring of four segments of 16 bits. If two fingerprints differ in
at most 3 bits, some segment starts a chain of segments whose differences add up to
at most 0, 1, 2 and 3 (l * 3/4, rounded down). So links are sought only between
fingerprints that agree in a starting segment, and the chain prunes them before the
full comparison.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.common import fresh, quoted, stored, word_blocks
from tidegauge.llm.components import connected_components

SHINGLE_WORDS = 3
HASH_SEED = 42
SEGMENTS, SEGMENT_BITS = 4, 16
# Fingerprints that share one segment are compared as one group up to this number;
# beyond it the group is split by chains of three segments, without loss.
GROUP_AT_MOST = 1024

LINKS = T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))


def _shingle_hashes(data: bytes) -> Iterator[np.ndarray]:
    """Hashes of all word shingles, block by block."""
    digest, carry, first = xxhash.xxh64_intdigest, [], True
    for block in word_blocks(data.lower()):
        words = carry + block
        if len(words) >= SHINGLE_WORDS:
            runs = zip(*(words[i:] for i in range(SHINGLE_WORDS)))
            yield np.fromiter((digest(b" ".join(run), HASH_SEED) for run in runs), np.uint64)
            first = False
        carry = words[-(SHINGLE_WORDS - 1) :]
    if first and carry:
        yield np.array([digest(b" ".join(carry), HASH_SEED)], np.uint64)


def fingerprint_of(data: bytes) -> int:
    """The SimHash of a text as an unsigned number; 0 if it has no word."""
    total, ones = 0, np.zeros(64, np.int64)
    for hashes in _shingle_hashes(data):
        total += len(hashes)
        padded = np.zeros(-(-len(hashes) // 255) * 255, "<u8")
        padded[: len(hashes)] = hashes
        bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        # Sums of 255 ones fit in a byte, which keeps the inner sum fast.
        ones += bits.reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


@F.arrow_udf(T.LongType())
def _fingerprints(texts: pa.Array) -> pa.Array:
    found = (fingerprint_of(t.as_py() or b"") for t in texts)
    return pa.array(np.fromiter(found, np.uint64, len(texts)).view(np.int64))


def fingerprint(text: str) -> Column:
    """The fingerprint of a text column as a signed long; null and blank texts give 0."""
    return _fingerprints(F.coalesce(F.col(quoted(text)).cast("string"), F.lit("")).cast("binary"))


def _rotated(fps: np.ndarray, start: int) -> np.ndarray:
    shift = np.uint64(start * SEGMENT_BITS)
    return fps << shift | fps >> (np.uint64(64) - shift) if start else fps


def linked_pairs(start: int, members: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among fingerprints that share the starting segment.

    A chain of l segments may differ in l * 3/4 bits; what is left meets the full check.
    """
    ring = _rotated(members, start)
    rest, found = np.arange(len(members)), []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            node = queue.pop()
            apart = ring[rest] ^ ring[node]
            near = np.flatnonzero(np.bitwise_count(apart >> np.uint64(32)) <= 1)
            if len(near):
                near = near[np.bitwise_count(apart[near] >> np.uint64(16)) <= 2]
                near = near[np.bitwise_count(apart[near]) <= 3]
            if len(near):
                joined = rest[near]
                found += [(int(members[node]), int(members[i])) for i in joined]
                queue += list(joined)
                rest = np.delete(rest, near)
    return found


@F.arrow_udf(LINKS)
def _group_links(starts: pa.Array, groups: pa.Array) -> pa.Array:
    rows = []
    for start, group in zip(starts.to_pylist(), groups):
        members = group.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        pairs = np.array(linked_pairs(start, members), np.uint64).reshape(-1, 2).view(np.int64)
        rows.append([{"a": a, "b": b} for a, b in pairs.tolist()])
    return pa.array(rows, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))


def fingerprint_links(fingerprints: DataFrame) -> DataFrame:
    """Links (a, b) that connect all fingerprints (column ``fp``, distinct) differing in at most 3 bits.

    Every group emits a spanning forest, never all its pairs. A group that shares one
    segment is taken whole up to ``GROUP_AT_MOST`` members. In a larger one the chain
    of three segments is used as the key: the two segments after the shared one differ
    in at most 2 bits, so each member goes to the 33 keys that flip at most one of
    those 32 bits, and linked members meet in one of them. Such a key fixes 48 bits,
    so its group has a bound that does not depend on the input.
    """
    def rotated(start: int) -> Column:
        shift = start * SEGMENT_BITS
        return F.shiftleft("fp", shift).bitwiseOR(F.shiftrightunsigned("fp", 64 - shift)) if shift else F.col("fp")

    ring = fingerprints.select("fp", F.posexplode(F.array(*map(rotated, range(SEGMENTS)))).alias("start", "ring"))
    ring = ring.withColumn("segment", F.shiftrightunsigned("ring", 48))
    # At most 4 * 65,536 rows whatever the input, hence the broadcast.
    large = stored(ring.groupBy("start", "segment").count().where(F.col("count") > GROUP_AT_MOST), "large")
    large = F.broadcast(large.select("start", "segment"))
    small_groups = ring.join(large, ["start", "segment"], "left_anti").groupBy(
        "start", F.col("segment").alias("key")
    ).agg(F.collect_list("fp").alias("members"))
    chain = F.shiftrightunsigned("ring", 16)
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit(1 << k).cast("bigint") for k in range(2 * SEGMENT_BITS)])
    chained_groups = (
        ring.join(large, ["start", "segment"], "left_semi")
        .select("start", "fp", F.explode(F.transform(flips, lambda flip: chain.bitwiseXOR(flip))).alias("key"))
        .groupBy("start", "key")
        .agg(F.collect_list("fp").alias("members"))
    )
    groups = small_groups.unionByName(chained_groups).where(F.size("members") > 1)
    return groups.select(F.explode(_group_links("start", "members")).alias("link")).select("link.*").distinct()


def fingerprint_components(fingerprints: DataFrame) -> DataFrame:
    """(fp, component): the component of every fingerprint that has a link; others are left out."""
    return connected_components(fingerprint_links(fingerprints)).select(
        F.col("node").alias("fp"), F.col("root").alias("component")
    )


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, text_hash, fp (signed long), component (an fp), component_id.

    ``component_id`` is the smallest non-null id among all documents reachable through
    fingerprints that differ in at most 3 bits, the document itself included; it is
    null if all those ids are null. Texts are compared whole; null and blank texts have
    fingerprint 0 and are linked like any other. Repeated rows stay repeated. Other
    columns are ignored, an empty table gives an empty result.
    """
    rows = stored(
        docs.select(
            F.col(quoted(id_column)).alias("doc_id"),
            F.xxhash64(F.col(quoted(text))).alias("text_hash"),
            fingerprint(text).alias("fp"),
        ),
        "fingerprints",
    )
    # One row per different fingerprint, so thousands of copies count once from here on.
    alone = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    linked = fingerprint_components(rows.select("fp").distinct())
    named = alone.join(linked, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = stored(named, "named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    names = named.join(least, "component").select("fp", "component", "component_id")
    return rows.join(names, "fp").select("doc_id", "text_hash", "fp", "component", "component_id")


def keep_one(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with one row of each component: that of its smallest id.

    All columns are kept. If rows of the winning id are equal in id and text, one of
    them stays; if the ids of a component are all null, one of its rows stays.
    """
    found = near_duplicates(docs, id_column, text)
    # Of rows that share the winning id the one with the lowest text digest stays.
    per_row = found.groupBy("doc_id", "text_hash", "component").agg(F.count(F.lit(1)).alias("n_rows"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    winners = per_row.groupBy("component").agg(F.min(order).alias("first")).select(
        F.col("component").alias("of"), F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("first_hash")
    )
    # Joined by the whole winner, so the rows of a large component are not one key.
    same = [
        F.col("component") == F.col("of"),
        F.col("doc_id").eqNullSafe(F.col("first_id")),
        F.col("text_hash").eqNullSafe(F.col("first_hash")),
    ]
    verdicts = per_row.join(winners, same, "left").select("doc_id", "text_hash", F.col("of").isNotNull().alias("wins"), "n_rows")
    # Only documents that go or that have equal rows: plain winners need no entry, so
    # Spark sees the true size of this table and picks the join by it.
    id_, hash_, wins, n_rows, own = fresh(docs, "_id", "_text_hash", "_wins", "_n_rows", "_own_hash")
    notes = stored(verdicts.where("not wins or n_rows > 1").toDF(id_, hash_, wins, n_rows), "verdicts")
    joined = docs.withColumn(own, F.xxhash64(F.col(quoted(text)))).join(
        notes, [F.col(quoted(id_column)).eqNullSafe(F.col(id_)), F.col(own) == F.col(hash_)], "left"
    )
    once = joined.where(F.col(wins).isNull())
    repeated = joined.where(F.col(wins)).dropDuplicates([id_, hash_])
    return once.unionByName(repeated).select(*[F.col(quoted(c)) for c in docs.columns])
