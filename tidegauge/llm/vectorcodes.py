"""Compressed vectors: four one-byte codes each, from codebooks learned on integers.

Components become integers. A block of vectors keeps, per dimension, the different integers
it holds (a dictionary) and for each vector the places of its components in it. In every
round the squared differences of each dictionary value to all codebook entries are tabulated
once per block and dimension; the distance of a part to every entry is then a gather and an
add per dimension.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import quoted, stored


@dataclass(frozen=True)
class CodeSettings:
    parts: int = 4
    entries: int = 256  # at most 256: a code is one byte
    rounds: int = 4
    scale: int = 1024
    block_rows: int = 4096  # vectors that share their dictionaries; at most 65,536


def whole(vector: Column) -> Column:
    """Whether a vector takes part: not null, and no null or non-finite component."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)), F.lit(False))


def limit(dim: int, settings: CodeSettings) -> int:
    """Integers up to here, in absolute value, keep the distance of two vectors inside 63 bits."""
    return int(np.sqrt(2.0**61 / max(1, filled(dim, settings.parts)))) // 2


def filled(dim: int, parts: int) -> int:
    """The length of vectors of ``dim`` components once zeros have filled up the last part."""
    return -(-dim // parts) * parts


def integers(rows: DataFrame, settings: CodeSettings, id_column: str, vector: str, label: str) -> DataFrame:
    """vec_id, label, dim, x of the rows that take part: integers, after dim of them zeros up to a multiple of the parts."""
    given = F.col(quoted(vector)).cast("array<double>")
    kept = rows.select(
        F.col(quoted(id_column)).cast("bigint").alias("vec_id"), F.col(quoted(label)).alias("label"), given.alias("v")
    ).where(whole(F.col("v")))
    short = F.pmod(-F.size("v"), F.lit(settings.parts))
    scaled = F.transform("v", lambda x: F.floor(settings.scale * x))
    padded = F.concat(scaled, F.array_repeat(F.lit(0).cast("bigint"), short))
    return kept.select("vec_id", "label", padded.alias("x"), F.size("v").alias("dim"))


BLOCK = "dim int, rows int, ids array<bigint>, labels array<{}>, sizes binary, values binary, codes binary"


def blocks(rows: DataFrame, settings: CodeSettings) -> DataFrame:
    """Vectors in blocks of one length: ids, labels, and per dimension a dictionary and the codes of all vectors.

    ``sizes`` holds the number of different integers of each dimension, ``values`` these
    integers in ascending order, and ``codes`` two bytes per component, dimension by dimension.
    """
    label = rows.schema["label"].dataType
    schema = BLOCK.format(label.simpleString())

    def packed(dim: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        part = pa.Table.from_batches(held).combine_chunks()
        n = len(part)
        x = part.column("x").combine_chunks().flatten().to_numpy().reshape(n, filled(dim, settings.parts))
        if dim and max(int(x.max()), -int(x.min())) > limit(dim, settings):
            raise ValueError(f"components beyond {limit(dim, settings) / settings.scale:.0f} have no exact distances in 64 bits")
        found = [np.unique(x[:, d], return_inverse=True) for d in range(x.shape[1])]
        columns = [
            pa.array([dim], pa.int32()),
            pa.array([n], pa.int32()),
            *[pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), part.column(c).combine_chunks()) for c in ("vec_id", "label")],
            pa.array([np.array([len(v) for v, _ in found], "<i4").tobytes()], pa.binary()),
            pa.array([b"".join(v.astype("<i8").tobytes() for v, _ in found)], pa.binary()),
            pa.array([b"".join(c.astype("<u2").tobytes() for _, c in found)], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in schema.split(", ")])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                own = batch.filter(pa.array(dims == dim))
                for start in range(0, len(own), settings.block_rows):
                    part = own.slice(start, settings.block_rows)
                    waiting = held.setdefault(dim, [])
                    if sum(map(len, waiting)) + len(part) > settings.block_rows:
                        yield packed(dim, held.pop(dim))
                        waiting = held.setdefault(dim, [])
                    waiting.append(part)
        for dim, waiting in held.items():
            yield packed(dim, waiting)

    return stored(rows.select("vec_id", "label", "x", "dim").mapInArrow(pack, schema), "vector_blocks")


@dataclass(frozen=True)
class Block:
    """The dictionaries and codes of some vectors."""

    values: list[np.ndarray]
    codes: np.ndarray  # dimensions x vectors

    @classmethod
    def of(cls, row: dict) -> Block:
        ends = np.cumsum(np.frombuffer(row["sizes"], "<i4"))
        values = np.split(np.frombuffer(row["values"], "<i8"), ends[:-1]) if len(ends) else []
        return cls(values, np.frombuffer(row["codes"], "<u2").reshape(len(ends), row["rows"]))

    def nearest(self, part: int, codebook: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry (ties to the lower index) and its squared distance for a part of each vector."""
        n, width = self.codes.shape[1], codebook.shape[1]
        entry, distance = np.empty(n, np.int64), np.empty(n, np.int64)
        dims = range(part * width, (part + 1) * width)
        tables = [(self.values[d][:, None] - codebook[:, d - part * width]) ** 2 for d in dims]
        for start in range(0, n, rows):
            here = slice(start, min(n, start + rows))
            total = np.zeros((here.stop - start, len(codebook)), np.int64)
            for d, table in zip(dims, tables):
                total += table[self.codes[d, here]]
            entry[here] = total.argmin(axis=1)
            distance[here] = total[np.arange(len(total)), entry[here]]
        return entry, distance

    def sums(self, part: int, width: int, entry: np.ndarray, n_entries: int) -> np.ndarray:
        """Componentwise sums of the parts of each entry, by entry and position."""
        made = np.zeros((n_entries, width), np.int64)
        for i in range(width):
            np.add.at(made[:, i], entry, self.values[part * width + i][self.codes[part * width + i]])
        return made


Codebooks = dict[int, np.ndarray]  # by length of the vectors: parts x entries x positions
GATHER_ROWS = 512


def first_codebooks(rows: DataFrame, settings: CodeSettings) -> Codebooks:
    """The parts of the vectors of smallest ids, ascending (nulls last, equal ids by vector), for each length."""
    found = {}
    # One row per length of vectors.
    for (dim,) in sorted(rows.select("dim").distinct().collect()):
        own = rows.where(F.col("dim") == dim)
        lowest = own.select("vec_id").orderBy(F.asc_nulls_last("vec_id")).limit(settings.entries)
        if lowest.where("vec_id is null").isEmpty():
            own = own.where(F.col("vec_id") <= lowest.agg(F.max("vec_id")).first()[0])
        least = own.select("vec_id", "x").orderBy(F.asc_nulls_last("vec_id"), "x").limit(settings.entries).collect()
        x = np.array([r["x"] for r in least], np.int64).reshape(len(least), settings.parts, filled(dim, settings.parts) // settings.parts)
        found[dim] = x.transpose(1, 0, 2)
    return found


def improved(packed: DataFrame, books: Codebooks, settings: CodeSettings) -> Codebooks:
    """Codebooks after one round: each used entry becomes the mean, rounded down, of the parts nearest to it."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {dim: np.zeros_like(book) for dim, book in books.items()}
        counts = {dim: np.zeros(book.shape[:2], np.int64) for dim, book in books.items()}
        for batch in batches:
            for row in batch.select(["dim", "rows", "sizes", "values", "codes"]).to_pylist():
                block, book = Block.of(row), books[row["dim"]]
                for part, codebook in enumerate(book):
                    entry, _ = block.nearest(part, codebook, GATHER_ROWS)
                    sums[row["dim"]][part] += block.sums(part, codebook.shape[1], entry, len(codebook))
                    counts[row["dim"]][part] += np.bincount(entry, minlength=len(codebook))
        for dim, n in counts.items():
            part, entry = np.nonzero(n)
            total = sums[dim][part, entry]
            columns = [
                pa.array(np.full(len(part), dim), pa.int32()),
                pa.array(part, pa.int32()),
                pa.array(entry, pa.int32()),
                pa.array(n[part, entry], pa.int64()),
                pa.array(list(total), pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["dim", "part", "entry", "n", "total"])

    rows = packed.select("dim", "rows", "sizes", "values", "codes")
    # Each task sends one row per entry at most.
    found = rows.mapInArrow(assign, "dim int, part int, entry int, n bigint, total array<bigint>")
    width = max(book.shape[2] for book in books.values())
    sums = [F.sum(F.get("total", F.lit(i))).alias(f"s{i}") for i in range(width)]
    made = {dim: book.copy() for dim, book in books.items()}
    for row in found.groupBy("dim", "part", "entry").agg(F.sum("n").alias("n"), *sums).collect():
        book = made[row["dim"]]
        book[row["part"], row["entry"]] = [row[f"s{i}"] // row["n"] for i in range(book.shape[2])]
    return made


def digest(book: np.ndarray) -> str:
    """SHA-256 of all components of all entries as decimal numbers, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def coded(packed: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code, error, codebooks_sha256 of every vector."""
    digests = {dim: digest(book) for dim, book in books.items()}
    label = packed.schema["labels"].dataType.elementType

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, row in enumerate(batch.select(["dim", "rows", "sizes", "values", "codes"]).to_pylist()):
                block, n = Block.of(row), row["rows"]
                error, codes = np.zeros(n, np.int64), np.empty((n, len(books[row["dim"]])), np.uint8)
                for part, codebook in enumerate(books[row["dim"]]):
                    codes[:, part], distance = block.nearest(part, codebook, GATHER_ROWS)
                    error += distance
                columns = [
                    batch.column("ids")[at].values,
                    batch.column("labels")[at].values,
                    pa.array([c.tobytes().hex() for c in codes], pa.string()),
                    pa.array(error, pa.int64()),
                    pa.array([digests[row["dim"]]] * n, pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error", "codebooks_sha256"])

    schema = f"vec_id bigint, label {label.simpleString()}, code string, error bigint, codebooks_sha256 string"
    return packed.mapInArrow(assign, schema)


def learn(packed: DataFrame, first: Codebooks, settings: CodeSettings = CodeSettings()) -> Codebooks:
    books = first
    for _ in range(settings.rounds):
        books = improved(packed, books, settings)
    return books


def compress(
    rows: DataFrame,
    settings: CodeSettings = CodeSettings(),
    id_column: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """vec_id, label, code (two hex digits per part), error, label_error, codebooks_sha256 of each vector that takes part.

    Null vectors and those with a null or non-finite component have no row. Every other
    row counts, also repeated rows and rows without an id or label (null labels are one
    label). Vectors of different lengths share nothing: each length has its own
    codebooks. A length that is no multiple of the parts is filled up with zeros, which
    change no distance. With fewer vectors than entries the codebook is as short as that.
    An empty table gives an empty result. Other columns are ignored. Integers too large
    for exact distances in 64 bits (see ``limit``) are an error.
    """
    held = stored(integers(rows, settings, id_column, vector, label), "integers")
    packed = blocks(held, settings)
    books = learn(packed, first_codebooks(held, settings), settings) if not held.isEmpty() else {}
    made = stored(coded(packed, books), "codes")
    errors = made.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    joined = made.join(errors, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256")


def decoded(codes: DataFrame, books: Codebooks, settings: CodeSettings = CodeSettings()) -> DataFrame:
    """``codes`` (with columns code and dim) with the integers that the code stands for, as ``x``, filled up with zeros."""

    @F.arrow_udf("array<bigint>")
    def entries(code: pa.Array, dim: pa.Array) -> pa.Array:
        found = []
        for text, n in zip(code.to_pylist(), dim.to_pylist()):
            picks = bytes.fromhex(text)
            found.append(books[n][np.arange(settings.parts), np.frombuffer(picks, np.uint8)].ravel())
        return pa.array(found, pa.list_(pa.int64()))

    return codes.withColumn("x", entries("code", "dim"))
