"""Exact positions in a total order, without sorting or numbering the rows.

"The first 40% of the rows in time order" needs one row's key, not a number on
every row. :func:`find_splits` finds the keys at given positions by counting: it
counts rows per value of the order's first level, sees which values hold a sought
position, and goes on inside those alone. Every pass is an aggregation with
map-side combine over the key columns, and all but the first read only the
groups that hold a position. The keys found, a handful of scalars, become
literals, so placing the rows is a projection that moves no data and reading one
part is a filter the file scan can use.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions.search import count_at_most

ID_GROUP_BITS = 20
HASH_GROUP_CHARS = 4
COMPARE_AT_MOST = 16  # splits up to this number are compared with in turn
RANK_AT_MOST = 1_000_000  # groups up to this size are ranked directly


@dataclass(frozen=True)
class RowOrder:
    """A total order as levels from coarse to fine.

    Sorting by all levels in turn, nulls first, is the order, and the last one
    makes rows unique. A level should take a bounded
    number of values within one value of the level above (see the constructors),
    since those are counted side by side. ``deciding`` are places of levels that make the
    same order without the others, whose values they imply; none given means all of them.
    """

    levels: tuple[Column, ...]
    deciding: tuple[int, ...] = ()

    @staticmethod
    def by_date(date: str, tie: tuple[Column, ...], deciding: tuple[int, ...] = ()) -> RowOrder:
        """A column that changes once a day, then ``tie`` levels."""
        return RowOrder((F.col(date), *tie), deciding)

    @staticmethod
    def by_time(time: str, tie: tuple[Column, ...]) -> RowOrder:
        """A fine-grained timestamp: day, second, exact time, then ``tie`` levels."""
        t = F.col(time)
        return RowOrder((F.to_date(t), F.date_trunc("second", t), t, *tie))

    @staticmethod
    def by_hash(hash_: Column) -> RowOrder:
        """Hex digests only: a random order."""
        return RowOrder(hash_levels(hash_))

    @property
    def names(self) -> list[str]:
        return [f"_level{i}" for i in range(len(self.levels))]

    def columns(self) -> list[Column]:
        return [level.alias(name) for level, name in zip(self.levels, self.names, strict=True)]


def id_levels(id_: str) -> tuple[Column, ...]:
    """A numeric unique id: groups of about a million ids, then the id."""
    return (F.shiftright(F.col(id_).cast("bigint"), ID_GROUP_BITS), F.col(id_))


def hash_levels(hash_: str | Column) -> tuple[Column, ...]:
    """A hex digest: its first characters spread any tie evenly over 65,536 groups."""
    return (F.substring(hash_, 1, HASH_GROUP_CHARS), F.col(hash_) if isinstance(hash_, str) else hash_)


def find_splits(
    df: DataFrame,
    order: RowOrder,
    positions: Callable[[Column], Column],
    by: Sequence[str] = (),
) -> _Handful:
    """Keys of the rows at given 0-based positions: by..., slot, one column per level.

    ``positions`` maps the row count to an ascending array of positions; entries
    at or past the end have no row and are left out. With ``by`` every group has
    its own order. The result holds one row per group and slot.
    """
    by, names = list(by), order.names
    keyed = df.select(*by, *order.columns())
    # The first level's counts are few (days, digest prefixes), so one task can add them up.
    counts = keyed.groupBy(*by, names[0]).agg(F.count(F.lit(1)).alias("_rows"))
    stepped = counts.withColumn("_before", _running_rows([*by], names[0])).withColumn(
        "_total", F.sum("_rows").over(Window.partitionBy(*by))
    )
    found = _Handful.of(
        stepped.select(
            *by, names[0], "_before", "_rows", F.posexplode(positions(F.col("_total"))).alias("slot", "_position")
        )
        .where("_before <= _position AND _position < _before + _rows")
        .select(*by, "slot", names[0], F.expr("_position - _before").alias("_left"), "_rows")
    )
    for depth in range(1, len(names)):
        prefix = [*by, *names[:depth]]
        first = F.col(names[0])
        sought = first.isin(found.literals(names[0]))
        near = keyed.where(sought | first.isNull() if None in found.values(names[0]) else sought)
        at = found.frame().drop("_rows").withColumnsRenamed({c: f"_at_{c}" for c in prefix})
        same = [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in prefix]
        inside = near.join(F.broadcast(at), same).drop(*[f"_at_{c}" for c in prefix])
        if max((int(n) for n in found.values("_rows")), default=0) <= RANK_AT_MOST:
            rank = F.row_number().over(Window.partitionBy(*by, "slot").orderBy(*names[depth:]))
            found = _Handful.of(
                inside.withColumn("_rank", rank).where("_rank = _left + 1").select(*by, "slot", *names)
            )
            break
        counts = inside.groupBy(*by, "slot", "_left", *names[: depth + 1]).agg(F.count(F.lit(1)).alias("_rows"))
        found = _Handful.of(
            counts.withColumn("_before", _running_rows([*by, "slot"], names[depth]))
            .where("_before <= _left AND _left < _before + _rows")
            .select(*by, "slot", *names[: depth + 1], F.expr("_left - _before").alias("_left"), "_rows")
        )
    return found


def _running_rows(group: list[str], level: str) -> Column:
    window = Window.partitionBy(*group).orderBy(level).rowsBetween(Window.unboundedPreceding, 0)
    return F.sum("_rows").over(window) - F.col("_rows")


@dataclass(frozen=True)
class _Handful:
    """The few rows of a search step, held as literals.

    Values travel as text, which keeps every key type exact in the session's
    own time zone.
    """

    spark: SparkSession
    schema: T.StructType
    rows: tuple[tuple[str | None, ...], ...]

    @staticmethod
    def of(df: DataFrame) -> _Handful:
        text = df.select([F.col(c).cast("string").alias(c) for c in df.columns])
        return _Handful(df.sparkSession, df.schema, tuple(tuple(r) for r in text.collect()))

    def frame(self) -> DataFrame:
        text = self.spark.createDataFrame(list(self.rows), ", ".join(f"`{n}` string" for n in self.schema.names))
        return text.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema])

    def values(self, column: str) -> list[str | None]:
        at = self.schema.names.index(column)
        return [r[at] for r in self.rows]

    def literals(self, column: str) -> list[Column]:
        kind = self.schema[column].dataType
        return [F.lit(v).cast(kind) for v in dict.fromkeys(self.values(column))]


@dataclass(frozen=True)
class Splits:
    """Split keys of one order, in ascending order of their position."""

    order: RowOrder
    found: _Handful

    @staticmethod
    def find(df: DataFrame, order: RowOrder, positions: Callable[[Column], Column]) -> Splits:
        found = find_splits(df, order, positions)
        at = found.schema.names.index("slot")
        return Splits(order, replace(found, rows=tuple(sorted(found.rows, key=lambda r: int(r[at])))))

    def key(self, slot: int) -> list[Column] | None:
        """The slot's split key as literals, None if the slot has no row."""
        if slot >= len(self.found.rows):
            return None
        return [F.lit(self.found.values(n)[slot]).cast(self.found.schema[n].dataType) for n in self.order.names]

    def before(self, slot: int) -> Column:
        """Is the row before the split key? True for all rows if the slot has none. Nulls come first."""
        key = self.key(slot)
        if key is None:
            return F.lit(True)
        # The first comparison alone can reach the file scan.
        first = self.order.levels[0]
        return (first.isNull() | (first <= key[0])) & _less(self.order.levels, key)

    def from_(self, slot: int) -> Column:
        """Is the row at or after the split key?"""
        key = self.key(slot)
        if key is None:
            return F.lit(False)
        first = self.order.levels[0]
        return (key[0].isNull() | (first >= key[0])) & ~_less(self.order.levels, key)

    def with_part(self, df: DataFrame, into: str = "part") -> DataFrame:
        """Add ``into``: how many split keys lie at or before the row."""
        if not self.found.rows:
            return df.withColumn(into, F.lit(0))
        kept, names = df.columns, self.order.names
        if len(self.found.rows) <= COMPARE_AT_MOST and self.order.deciding[:1] == (0,):
            # Finer levels, like a digest, are only computed for rows that share the first level of a key.
            first = self.order.levels[0]
            tied = first.isin(self.found.literals(names[0])) | first.isNull()
            places = self.order.deciding[1:]
            finer = df.withColumns({f"_tie{i}": F.when(tied, self.order.levels[i]) for i in places})
            levels = [first, *[F.col(f"_tie{i}") for i in places]]
            reached = [self._reached(slot, levels) for slot in range(len(self.found.rows))]
            return finer.select(*kept, reduce(lambda a, b: a + b, reached).alias(into))
        packed = self.found.frame().agg(
            F.transform(
                F.sort_array(F.collect_list(F.struct("slot", *names))),
                lambda s: F.struct(*[s[n].alias(n) for n in names]),
            )
        )
        keyed = df.withColumns({"_splits": packed.scalar(), "_key": F.struct(*self.order.columns())})
        return count_at_most(keyed, "_splits", "_key", len(self.found.rows), into).select(*kept, into)

    def _reached(self, slot: int, levels: Sequence[Column]) -> Column:
        """1 if the split key lies at or before the row with these deciding levels, else 0."""
        key, out = self.key(slot), F.lit(1)
        for level, place in reversed(list(zip(levels, self.order.deciding, strict=True))):
            bound = key[place]
            after = F.coalesce(level > bound, level.isNotNull() & bound.isNull())
            out = F.when(after, F.lit(1)).when(level.eqNullSafe(bound), out).otherwise(F.lit(0))
        return out


def _less(levels: Sequence[Column], key: Sequence[Column]) -> Column:
    """Lexicographic ``levels < key``, null before all else; never null itself."""

    def below(level: Column, bound: Column) -> Column:
        return F.coalesce(level < bound, level.isNull() & bound.isNotNull())

    pairs = list(zip(levels, key, strict=True))
    return reduce(
        lambda inner, p: below(*p) | (p[0].eqNullSafe(p[1]) & inner), reversed(pairs[:-1]), below(*pairs[-1])
    )


def baseline_cut(fraction: float) -> Callable[[Column], Column]:
    """The position that cuts off the first ``fraction`` of the rows."""
    return lambda total: F.array(_cut(total, fraction))


def baseline_windows(fraction: float, windows: int) -> Callable[[Column], Column]:
    """Positions that cut off the first ``fraction`` and split the rest evenly.

    Part 0 is the baseline, parts 1..``windows`` the later windows.
    """

    def positions(total: Column) -> Column:
        cut = _cut(total, fraction)
        return F.array(*[cut + _whole_part(F.lit(i) * (total - cut), windows) for i in range(windows)])

    return positions


def baseline_batch(fraction: float, rows: int) -> Callable[[Column], Column]:
    """Positions of the baseline's end and of the end of a batch of ``rows`` after it."""

    def positions(total: Column) -> Column:
        cut = _cut(total, fraction)
        return F.array(cut, cut + F.lit(rows).cast("bigint"))

    return positions


def _cut(total: Column, fraction: float) -> Column:
    return F.floor(total * F.lit(fraction)).cast("bigint")


def _whole_part(value: Column, by: int) -> Column:
    """Integer division, exact for any bigint."""
    return ((value - F.pmod(value, F.lit(by))) / F.lit(by)).cast("bigint")
