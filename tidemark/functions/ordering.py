"""Sort orders that mix numbers and text, and dense positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import Timeline
from ..storage import cut

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _mixed(c: Column) -> list[Column]:
    number = F.when(F.trim(c).rlike(_NUMBER), F.trim(c).try_cast("double"))
    return [c == "", number.isNull(), number, F.lower(c)]


def mixed_key(c: Column, descending: bool = False) -> list[Column]:
    """Sort expressions of a cell: numbers by value, then other text ignoring case, empty cells last; descending turns all of it."""
    return [p.desc() if descending else p.asc() for p in _mixed(c)]


def sort_parts(t: Timeline, keys: list[tuple[str, bool]]) -> list[tuple[Column, bool]]:
    """What rows are ordered by, with whether it descends."""
    out: list[tuple[Column, bool]] = []
    for name, descending in keys:
        column = t.resolve(name)
        parts = [F.col(c) for c in t.row_order] if column == "row" else _mixed(t.text(column))
        out += [(p, descending) for p in parts]
    return [*out, *[(F.col(c), False) for c in t.row_order]]


def order_by(t: Timeline, keys: list[tuple[str, bool]]) -> list[Column]:
    """Sort expressions of several (field, descending) keys; ties keep the order of rows."""
    return [c.desc() if descending else c.asc() for c, descending in sort_parts(t, keys)]


def sort_key(t: Timeline, keys: list[tuple[str, bool]]) -> Column:
    """One value for each row that ascends in the order of ``keys``: what descends is turned around, text by the complement of its bytes."""
    parts = sort_parts(t, keys)
    types = t.df.select(*[c.alias(f"k{i}") for i, (c, _) in enumerate(parts)]).dtypes
    out: list[Column] = []
    for (c, descending), (_, kind) in zip(parts, types, strict=True):
        if descending:
            # Nulls come last when descending; a text that goes on comes before its beginning.
            turned = ~c if kind == "boolean" else F.concat(F.translate(F.hex(c), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G")) if kind == "string" else -c
            out += [c.isNull(), turned]
        else:
            out.append(c)
    return F.struct(*[c.alias(f"k{i}") for i, c in enumerate(out)])


def behind(t: Timeline, keys: list[tuple[str, bool]], row: tuple) -> Column:
    """Whether a row comes after the one with the key ``row`` in the order of ``keys``.

    That row's own sort key is read, and rows are compared with it: nothing is sorted or numbered.
    """
    parts = sort_parts(t, keys)
    own = t.df
    for c, v in zip(t.key, row, strict=True):
        own = own.where(F.col(c) == v)
    at = own.select(*[c.alias(f"k{i}") for i, (c, _) in enumerate(parts)]).first()
    if at is None:
        raise ValueError(f"no row {row}")
    schema = dict(own.select(*[c.alias(f"k{i}") for i, (c, _) in enumerate(parts)]).dtypes)
    out = F.lit(False)
    for i in range(len(parts) - 1, -1, -1):
        c, descending = parts[i]
        here = F.lit(at[i]).cast(schema[f"k{i}"])
        # Nulls come first when ascending and last when descending, as in the sort.
        low, high = (c, here) if descending else (here, c)
        out = F.coalesce(low < high, low.isNull() & high.isNotNull()) | (c.eqNullSafe(here) & out)
    return out


def sort(t: Timeline, keys: list[tuple[str, bool]]) -> Timeline:
    return t.with_df(t.df.orderBy(*order_by(t, keys)))


def page(t: Timeline, keys: list[tuple[str, bool]], low: int, high: int) -> DataFrame:
    """Positions low to high (exclusive) of the sorted rows; only that many rows are kept by each task."""
    return t.df.orderBy(*order_by(t, keys)).offset(low).limit(high - low)


def positions(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """``df`` sorted, with dense 0-based positions.

    The sort deals the rows by range; the rows before each partition are counted in a
    table of one row for each partition, which meets the rows by a broadcast, so
    no single task sees all rows. The sorted rows are cut first, as the two passes have to
    see the same ranges.
    """
    ordered = cut(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    return _dense(ordered, name)


def _dense(df: DataFrame, name: str) -> DataFrame:
    part = F.shiftright("_id", 33)
    counts = df.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", before.alias("_before"))
    placed = df.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    position = F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1)
    return placed.withColumn(name, position.cast("long")).drop("_id", "_part", "_before")
