"""Filters that look at both a timeline's cells and its overlay, each on its own side of the join.

Tests of data columns are evaluated where the rows are read and leave a bit
each; what meets the overlay is the row's key and its bits, and the whole
condition is evaluated there. So no cell is shuffled for a filter, however large the overlay
is. An overlay table that the condition does not look at is not joined. The cells of the rows that pass are
fetched by a semi-join at the end, if they are wanted at all.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, fields, replace
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.logger import PySparkLogger
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Timeline, timeline
from .overlay import attach_comments, attach_tags

#: Tests whose results share a column.
BITS = 62


@contextmanager
def quiet() -> Iterator[None]:
    """Errors of analysis are raised, but not logged."""
    logs = [PySparkLogger.getLogger(f"{kind}QueryContextLogger") for kind in ("DataFrame", "SQL")]
    levels = [log.level for log in logs]
    for log in logs:
        log.setLevel(logging.CRITICAL + 1)
    try:
        yield
    finally:
        for log, level in zip(logs, levels, strict=True):
            log.setLevel(level)


def resolves(df: DataFrame, test: Column) -> bool:
    """Whether ``df`` has all columns that ``test`` looks at; nothing runs, and nothing is logged."""
    with quiet():
        try:
            df.select(test)
        except AnalysisException:
            return False
    return True


@dataclass(frozen=True)
class Sided(Timeline):
    """A timeline whose tests of data columns are set aside, in ``atoms``, and stand as bits in the condition."""

    atoms: list[Column] = field(default_factory=list)

    def held(self, test: Column) -> Column:
        if not resolves(self.df.select(*[c for c in self.df.columns if c not in ("tags", "comment")]), test):
            return test  # it looks at the overlay
        self.atoms.append(test)
        word, bit = divmod(len(self.atoms) - 1, BITS)
        return F.col(f"_bits{word}").bitwiseAND(F.lit(1 << bit).cast("long")) != 0

    def bits(self) -> list[Column]:
        words = [self.atoms[k : k + BITS] for k in range(0, len(self.atoms), BITS)]
        return [reduce(lambda a, b: a.bitwiseOR(b), [F.when(c, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, c in enumerate(w)]).alias(f"_bits{k}") for k, w in enumerate(words)]


def passing(t: Timeline, test: Callable[[Timeline], Column], tags: DataFrame, comments: DataFrame) -> DataFrame:
    """Keys of the rows of ``t`` (without its overlay) that pass ``test``, a function from a timeline to a condition.

    A condition with a test of cells that was not built by way of the timeline (a Column over its
    columns that also looks at tags or comments) is evaluated behind the join, as nothing can be told apart in it.
    """
    if resolves(t.df.select(*[c for c in t.df.columns if c not in ("tags", "comment")]), test(t)):
        return t.df.where(test(t)).select(*t.key)
    sided = Sided(**{f.name: getattr(t, f.name) for f in fields(Timeline)})
    condition = test(sided)
    counted = [] if t.number is None or t.number in t.key else [t.number]
    # The random column, which is never negative, keeps the condition from being moved below the bits, with all of them written out for each.
    narrow = replace(t, df=t.df.select(*t.key, *counted, *sided.bits(), F.rand().alias("_fence")))
    for needs in (("tags",), ("comment",), ("tags", "comment")):
        joined = narrow
        for name, attach, table in (("tags", attach_tags, tags), ("comment", attach_comments, comments)):
            joined = attach(joined, table) if name in needs else joined
        if resolves(joined.df, condition):
            # A projection, as a filter would also find columns that were left out below.
            return joined.df.select(*t.key, (condition & (F.col("_fence") >= 0)).alias("_kept")).where("_kept").select(*t.key)
    whole = attach_comments(attach_tags(t, tags), comments)
    return whole.df.where(test(whole)).select(*t.key)


def apply_filter(t: Timeline, test: Callable[[Timeline], Column], tags: DataFrame, comments: DataFrame) -> Timeline:
    """The rows of ``t`` that pass, with their overlay: cells are read for those rows only."""
    kept = t.df.drop("tags", "comment").join(passing(t, test, tags, comments), list(t.key), "left_semi")
    return attach_comments(attach_tags(timeline(kept, t.columns, **{f.name: getattr(t, f.name) for f in fields(Timeline) if f.name not in ("df", "columns")}), tags), comments)
