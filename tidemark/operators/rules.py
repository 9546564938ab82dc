"""Rules of indicator lists as data: tests in clauses, as rows of a table, or conditions as SQL text.

The distinct tests of all rules are evaluated once for a row and leave a bit
each; a clause is two masks over the bits, those that must be set and those that must not.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.predicates import any_of, blank, contains, filled, has_tag, matches, on, one_of, tagged
from ..functions.times import after, before, between, time_of
from ..model import INDICATORS, Timeline
from .indicators import bounded_lines, compiled, regex_errors, scan, scan_many
from .sides import BITS, quiet

#: A test; a clause holds if all its tests hold, a rule if any of its clauses does.
CLAUSES = "list string, line int, clause int, field string, op string, value string, negated boolean"
#: What a test does with the cells of its field.
CELL_TESTS = {
    "contains": lambda v: lambda c: contains(c, v),
    "regex": lambda v: lambda c: matches(c, v),
    "exact": lambda v: lambda c: one_of(c, [v]),
    "filled": lambda _: filled,
    "empty": lambda _: blank,
}
ERRORS = "list string, line int, value string, error string"


def test_of(t: Timeline, field: str, op: str, value: str) -> Column:
    """One test: ``contains``, ``regex``, ``exact``, ``filled`` and ``empty`` of a field, ``before``, ``after`` and
    ``between`` (``low and high``) of its time, ``tagged`` and ``has_tag`` of the row."""
    if op in CELL_TESTS:
        return on(t, t.resolve(field), CELL_TESTS[op](value))
    if op == "tagged":
        return tagged()
    if op == "has_tag":
        return has_tag(value)
    if op in ("before", "after"):
        return (before if op == "before" else after)(time_of(t, t.resolve(field)), value)
    if op == "between":
        bounds = re.split(r"(?i)\s+and\s+", value.strip())
        if len(bounds) != 2:
            raise ValueError(f"between takes two times: {value!r}")
        return between(time_of(t, t.resolve(field)), *bounds)
    raise ValueError(f"unknown test {op!r}")


def clauses_to_column(t: Timeline, clauses: list[tuple[int, str, str, str, bool]]) -> Column:
    """One rule from its tests (clause, field, op, value, negated), without bits."""
    parts: dict[int, list[Column]] = {}
    for clause, field, op, value, negated in clauses:
        test = test_of(t, field, op, value)
        parts.setdefault(clause, []).append(~test if negated else test)
    return any_of(reduce(lambda a, b: a & b, tests) for tests in parts.values())


def titled(t: Timeline) -> DataFrame:
    """The rows with their cells under the titles too, for conditions as text; of titles that differ in case only, the first."""
    taken, more = {c.lower() for c in t.df.columns}, {}
    for c in t.columns:
        title = t.title(c)
        if title.strip() and title.lower() not in taken:
            taken.add(title.lower())
            more[title] = t.text(c)
    return t.df.withColumns(more) if more else t.df


def sql_test(named: DataFrame, condition: str) -> Column:
    """A condition as Spark SQL text, analysed against the rows before anything runs."""
    if not condition.strip():
        raise ValueError("empty filter")
    with quiet():
        test = F.expr(condition)
        named.select("*", F.when(test, F.lit(1)))
    return test


class _Tests:
    """The distinct tests of all rules, in the order of their bits."""

    def __init__(self) -> None:
        self.places: dict[tuple[str, ...], int] = {}
        self.columns: list[Column] = []

    def place(self, key: tuple[str, ...], test: Column) -> int:
        if key not in self.places:
            self.places[key] = len(self.columns)
            self.columns.append(test)
        return self.places[key]

    def words(self) -> dict[str, Column]:
        none = F.lit(0).cast("long")
        blocks = [self.columns[k : k + BITS] for k in range(0, len(self.columns), BITS)]
        return {f"_rule{k}": reduce(lambda a, b: a.bitwiseOR(b), [F.when(c, F.lit(1 << i).cast("long")).otherwise(none) for i, c in enumerate(block)]) for k, block in enumerate(blocks)}


def _masked(clause: list[tuple[int, bool]]) -> Column:
    """Whether the bits of a clause, as (place, negated), are as it wants them."""
    masks: dict[int, list[int]] = {}
    for place, negated in clause:
        word, bit = divmod(place, BITS)
        both = masks.setdefault(word, [0, 0])
        both[0] |= 1 << bit
        both[1] |= 0 if negated else 1 << bit
    tests = []
    for word, (looked_at, wanted) in masks.items():
        tests.append(F.col(f"_rule{word}").bitwiseAND(F.lit(looked_at).cast("long")) == F.lit(wanted).cast("long"))
    # A test that is wanted both ways never holds.
    return F.lit(False) if {(p, True) for p, n in clause if not n} & set(clause) else reduce(lambda a, b: a & b, tests)


def with_rules(t: Timeline, indicators: DataFrame, clauses: DataFrame | None = None) -> tuple[Timeline, dict[tuple[str, int], Column], DataFrame]:
    """The timeline with the bits of all tests, a Column over them for each rule by (list, line), and the rules that cannot be used (list, line, value, error).

    A line of kind ``rule`` is the table's clauses for it, if there are any, else
    SQL text over columns and titles (a condition that fails on a row, such as a cast, ends the job as it does in
    ``where``; the ``try_`` functions do not). A line of which anything is wrong is left out as a whole and reported; so are clauses without a line.
    """
    given: dict[tuple[str, int], list[Row]] = {}
    for r in [] if clauses is None else bounded_lines(clauses):
        given.setdefault((r["list"], r["line"]), []).append(r)
    named, tests = titled(t), _Tests()
    rules: dict[tuple[str, int], list[list[tuple[int, bool]]]] = {}
    bad = []
    for r in bounded_lines(indicators.where("kind = 'rule'")):
        key = (r["list"], r["line"])
        own = given.pop(key, None)
        try:
            if own is None:
                rules[key] = [[(tests.place(("sql", r["value"]), sql_test(named, r["value"])), False)]]
                continue
            # All are built before any gets a bit, so that a rule that fails leaves nothing.
            built = [(c, (t.resolve(c["field"]) if c["op"] not in ("tagged", "has_tag") else "", c["op"], c["value"] or ""), test_of(t, c["field"], c["op"], c["value"] or "")) for c in own]
            parts: dict[int, list[tuple[int, bool]]] = {}
            for c, name, test in built:
                parts.setdefault(c["clause"], []).append((tests.place(name, test), bool(c["negated"])))
            rules[key] = list(parts.values())
        except (ValueError, AnalysisException) as e:
            bad.append((*key, r["value"], str(e).strip().split("\n")[0]))
    bad += [(name, line, None, "clauses without a rule line") for name, line in given]
    words = tests.words()
    df = named.withColumns(words).select(*t.df.columns, *words) if words else t.df
    return t.with_df(df), {k: any_of(_masked(c) for c in v) for k, v in rules.items()}, t.df.sparkSession.createDataFrame(bad, ERRORS)


def scan_lists(t: Timeline, indicators: DataFrame, clauses: DataFrame | None = None, long: bool = False) -> tuple[DataFrame, DataFrame]:
    """Hits of lists with lines of every kind, and every line that cannot be used (list, line, value, error); the rest of its list runs."""
    with_bits, rules, bad = with_rules(t, indicators, clauses)
    hits = scan_many(with_bits, indicators, rules) if long else scan(with_bits, compiled(indicators, rules))
    return hits, regex_errors(indicators).unionByName(bad)


def rule_lines(spark, lines: list[tuple[str, int, str, str]]) -> DataFrame:
    """Indicators of kind ``rule`` from (list, line, SQL text, label)."""
    return spark.createDataFrame([(name, line, "rule", condition, label) for name, line, condition, label in lines], INDICATORS)
