"""Row predicates as Columns, and the filter spec that combines them.

Every predicate is true or false, never null, so that negation keeps the rows
it should. Nothing here runs a job: specs become one Column that Catalyst
prunes and orders.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import Timeline

#: White space at the ends of cells.
SPACES = " \t\n\x0b\f\r"
#: Constructs that the linear-time dialect of indicator lists does not have.
_UNSUPPORTED = re.compile(r"\(\?(?:[=!]|<[=!])|\\[1-9]|\\k<")


def text(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def stripped(c: Column | str) -> Column:
    """Without white space at the ends, in time that grows with the length only."""
    return F.btrim(text(c), F.lit(SPACES))


def contains(c: Column | str, needle: str, cased: bool = False) -> Column:
    """Substring; the empty needle is in everything."""
    if not needle:
        return F.lit(True)
    return F.contains(text(c), F.lit(needle)) if cased else F.contains(F.lower(text(c)), F.lit(needle.lower()))


def check_regex(pattern: str) -> str:
    """The pattern as it will run, or an error before anything runs.

    It is compiled by the very class that Spark matches with; named groups may
    be written ``(?P<name>...)``.
    """
    from pyspark import SparkContext
    from pyspark.errors import IllegalArgumentException

    if _UNSUPPORTED.search(re.sub(r"\\\\", "", pattern)):
        raise ValueError(f"look-around and back-references are not supported: {pattern}")
    pattern = pattern.replace("(?P<", "(?<")
    try:
        SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException as e:
        raise ValueError(f"invalid regular expression {pattern!r}: {e}") from None
    return pattern


def matches(c: Column | str, pattern: str, cased: bool = False) -> Column:
    """Unanchored regular expression search."""
    pattern = check_regex(pattern)
    return text(c).rlike(pattern if cased else f"(?iu){pattern}")


def one_of(c: Column | str, values: Iterable[str], cased: bool = False) -> Column:
    """Whole-cell equality with any value; no values is no constraint."""
    values = list(values)
    if not values:
        return F.lit(True)
    return text(c).isin(values) if cased else F.lower(text(c)).isin([v.lower() for v in values])


def filled(c: Column | str) -> Column:
    """Has a character that is not white space."""
    return text(c).rlike(r"\S")


def blank(c: Column | str) -> Column:
    return ~filled(c)


def any_of(parts: Iterable[Column]) -> Column:
    parts = list(parts)
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


def all_of(parts: Iterable[Column]) -> Column:
    parts = list(parts)
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def on(t: Timeline, target: str, test) -> Column:
    """``test`` on a field: one column, a virtual field, ``any`` (data, tags, comment) or ``data``."""
    if target == "data":
        return t.held(any_of(test(t.text(c)) for c in t.data_columns))
    if target == "any":
        return t.held(any_of(test(t.text(c)) for c in t.columns)) | test(t.text("tags")) | test(t.text("comment"))
    return t.held(test(t.text(target))) if target in t.columns else test(t.text(target))


def quick(t: Timeline, target: str, typed: str, cased: bool = False) -> Column:
    """What is typed above a column: a lone ``*`` means not empty, else substring."""
    return on(t, target, filled) if typed.strip() == "*" else on(t, target, lambda c: contains(c, typed, cased))


def has_tag(tag: str) -> Column:
    """Exactly this tag, in this case."""
    return F.array_contains("tags", tag)


def has_any_tag(tags: Iterable[str]) -> Column:
    tags = list(tags)
    return F.arrays_overlap("tags", F.array(*[F.lit(x) for x in tags])) if tags else F.lit(True)


def tagged() -> Column:
    return F.size("tags") > 0


@dataclass(frozen=True)
class Condition:
    """Values on one field: any (or all) of them as substrings or regular expressions, perhaps excluded."""

    target: str
    values: list[str]
    every: bool = False
    regex: bool = False
    exclude: bool = False

    def to_column(self, t: Timeline, cased: bool = False) -> Column | None:
        values = [v for v in self.values if v.strip()]
        if not values:
            return None
        target = self.target if self.target == "data" else t.resolve(self.target)
        test = (lambda v: lambda c: matches(c, v, cased)) if self.regex else (lambda v: lambda c: contains(c, v, cased))
        found = (all_of if self.every else any_of)(on(t, target, test(v)) for v in values)
        return ~found if self.exclude else found

    def terms(self, negated: bool = False) -> list[Term]:
        """What the condition looks for; nothing if it is excluded."""
        return [] if self.exclude != negated else [(self.target, v, self.regex) for v in self.values if v.strip()]


@dataclass(frozen=True)
class When:
    """A column's time ``before`` or ``after`` a literal, or ``between`` two."""

    target: str
    op: str
    low: str
    high: str = ""

    def to_column(self, t: Timeline, cased: bool = False) -> Column:
        from .times import after, before, between, time_of

        time = time_of(t, t.resolve(self.target))
        if self.op not in ("before", "after", "between"):
            raise ValueError(f"unknown comparison of times {self.op!r}")
        test = between(time, self.low, self.high) if self.op == "between" else (before if self.op == "before" else after)(time, self.low)
        return t.held(test)

    def terms(self, negated: bool = False) -> list[Term]:
        return []


#: What a filter looks for: field, value, whether it is a regular expression.
Term = tuple[str, str, bool]


@dataclass(frozen=True)
class Tree:
    """Conditions joined by ``and`` or ``or``, or one of them under ``not``."""

    op: str
    parts: tuple[Tree | Condition | When, ...]

    def to_column(self, t: Timeline, cased: bool = False) -> Column | None:
        tests = [c for c in (x.to_column(t, cased) for x in self.parts) if c is not None]
        if not tests:
            return None
        return ~tests[0] if self.op == "not" else (all_of if self.op == "and" else any_of)(tests)

    def terms(self, negated: bool = False) -> list[Term]:
        """The terms under an even number of negations."""
        negated ^= self.op == "not"
        return [x for p in self.parts for x in p.terms(negated)]


@dataclass(frozen=True)
class FilterSpec:
    """Everything that can be set at once; a row is kept if each part that is set passes."""

    tagged_only: bool = False
    tag: str | None = None
    any_tags: list[str] = field(default_factory=list)
    query: str = ""
    query_on: str | None = "any"
    query_regex: bool = False
    conditions: list[Condition] = field(default_factory=list)
    match_all: bool = True
    quick: dict[str, str] = field(default_factory=dict)
    pick: dict[str, list[str]] = field(default_factory=dict)
    where: Column | Tree | Condition | When | None = None
    cased: bool = False

    def to_column(self, t: Timeline) -> Column:
        parts = []
        if self.tagged_only:
            parts.append(tagged())
        if self.tag is not None:
            parts.append(has_tag(self.tag))
        if self.any_tags:
            parts.append(has_any_tag(self.any_tags))
        if self.query and self.query_on is not None:
            target = self.query_on if self.query_on == "data" else t.resolve(self.query_on)
            test = (lambda c: matches(c, self.query, self.cased)) if self.query_regex else (lambda c: contains(c, self.query, self.cased))
            parts.append(on(t, target, test))
        tests = [c for c in (x.to_column(t, self.cased) for x in self.conditions) if c is not None]
        if tests:
            parts.append((all_of if self.match_all else any_of)(tests))
        node = None if isinstance(self.where, Column) else self.where
        where = self.where if node is None else node.to_column(t, self.cased)
        if where is not None:
            where = F.coalesce(where, F.lit(False))
            parts.append(t.held(where) if node is None else where)
        parts += [quick(t, t.resolve(k), v, self.cased) for k, v in self.quick.items() if v.strip()]
        parts += [on(t, t.resolve(k), lambda c, v=v: one_of(c, v, self.cased)) for k, v in self.pick.items() if v]
        return all_of(parts)

    def terms(self) -> list[Term]:
        """The positive terms of all parts; a condition that is given as a Column has none."""
        out = [] if self.where is None or isinstance(self.where, Column) else self.where.terms()
        if self.query and self.query_on is not None:
            out.append((self.query_on, self.query, self.query_regex))
        out += [x for c in self.conditions for x in c.terms()]
        return out + [(k, v, False) for k, v in self.quick.items() if v.strip() not in ("", "*")]

    def apply(self, t: Timeline) -> Timeline:
        return t.with_df(t.df.where(self.to_column(t)))


def field_equals(t: Timeline, name: str, value: str, cased: bool = False) -> Column:
    target = t.resolve(name)
    return on(t, target, lambda c: contains(c, value, cased))


def field_differs(t: Timeline, name: str, value: str, cased: bool = False) -> Column:
    return ~field_equals(t, name, value, cased)


def find_next(t: Timeline, needle: str, after: int | tuple, keys: list[tuple[str, bool]] | None = None) -> Timeline:
    """The first row behind the one with the key ``after``, in the order of ``keys`` (of rows, if there are none), whose tags (one space apart), comment or any cell holds the needle.

    Rows are compared with the current one by their sort keys, and each task keeps one row.
    """
    from .ordering import behind, order_by

    parts = [contains(F.array_join("tags", " "), needle), contains(t.text("comment"), needle), *[contains(t.text(c), needle) for c in t.columns]]
    row = after if isinstance(after, tuple) else (after,)
    later = behind(t, keys or [], row) if keys or t.row_order != ["row_id"] else F.col("row_id") > row[0]
    return t.with_df(t.df.where(any_of(parts) & later).orderBy(*order_by(t, keys or [])).limit(1))


def sql_functions(spark) -> None:
    """Temporary SQL functions for users who write conditions as text in ``df.where``."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION has_ci(c STRING, v STRING) RETURNS BOOLEAN RETURN contains(lower(coalesce(c, '')), lower(v))")
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION is_filled(c STRING) RETURNS BOOLEAN RETURN coalesce(c, '') rlike '\\S'")
