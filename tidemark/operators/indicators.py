"""Indicator lists: parsing, scanning, tagging and comment merging."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.predicates import any_of, check_regex, contains, matches, stripped, text
from ..model import INDICATORS, Timeline
from .overlay import attach_comments, attach_tags

#: Lines of one generated expression, so that its code stays within what the JVM compiles.
CHUNK = 50
#: Lines of lists that are turned into expressions.
MOST_LINES = 10_000
#: Bytes of literals that are broadcast for one pass over the text, and about those of one automaton (some fifty times as many in memory).
BROADCAST_BYTES, AUTOMATON_BYTES = 64_000_000, 4_000_000
PREFIX = "ioc:"


def classify(lines: DataFrame) -> DataFrame:
    """list, line (1-based), kind and value of raw lines (list, line, text).

    ``## text`` is a label, ``# text`` a note, ``/.../`` a regular expression, a
    line in backquotes a rule, anything else plain; values are trimmed.
    """
    t = stripped("text")
    kind = (
        F.when(t == "", "blank")
        .when(t.startswith("##"), "label")
        .when(t.startswith("#"), "note")
        .when(t.rlike(r"(?s)^/.+/$"), "regex")
        .when(t.startswith("`"), "rule")
        .otherwise("plain")
    )
    value = (
        F.when(kind == "label", F.regexp_replace(t, r"^##\s*", ""))
        .when(kind == "note", F.regexp_replace(t, r"^#\s*", ""))
        .when(kind == "regex", F.expr("substring(_t, 2, length(_t) - 2)"))
        .when(kind == "rule", F.regexp_replace(t, r"^`\s*|\s*`?$", ""))
        .otherwise(t)
    )
    return lines.withColumn("_t", t).select("list", "line", kind.alias("kind"), value.alias("value"))


def label_blocks(classified: DataFrame) -> DataFrame:
    """Indicators with the label of their block: from ``## text`` to a blank line or the next label."""
    by_line = W.partitionBy("list").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    starts = F.sum(F.col("kind").isin("label", "blank").cast("int")).over(by_line)
    block = W.partitionBy("list", "_block").orderBy("line").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    label = F.first(F.when(F.col("kind") == "label", F.col("value"))).over(block)
    out = classified.withColumn("_block", starts).withColumn("label", F.coalesce(label, F.lit("")))
    return out.where(F.col("kind").isin("plain", "regex", "rule")).select("list", "line", "kind", "value", "label")


def bounded_lines(indicators: DataFrame) -> list[Row]:
    """Lines that become expressions, on the driver; more than ``MOST_LINES`` are an error, as no row can be tested against so many."""
    rows = indicators.orderBy("list", "line").limit(MOST_LINES + 1).collect()
    if len(rows) > MOST_LINES:
        raise ValueError(f"more than {MOST_LINES} lines; use scan_many, with no more regular expressions and rules than that")
    return rows


def regex_errors(indicators: DataFrame) -> DataFrame:
    """Lines whose regular expression cannot be used, as (list, line, value, error); the rest still run."""
    bad = []
    for r in bounded_lines(indicators.where("kind = 'regex'")):
        try:
            check_regex(r["value"])
        except ValueError as e:
            bad.append((r["list"], r["line"], r["value"], str(e)))
    return indicators.sparkSession.createDataFrame(bad, "list string, line int, value string, error string")


@dataclass(frozen=True)
class Indicator:
    list: str
    line: int
    kind: str
    value: str
    label: str = ""
    rule: Column | None = None


def compiled(indicators: DataFrame, rules: dict[tuple[str, int], Column] | None = None) -> list[Indicator]:
    """The usable lines of small lists, in order; rules are given as Columns by (list, line), as :func:`.rules.with_rules` makes and reports them."""
    out = []
    for r in bounded_lines(indicators):
        rule = (rules or {}).get((r["list"], r["line"]))
        if r["kind"] == "regex":
            try:
                check_regex(r["value"])
            except ValueError:
                continue
        if r["kind"] == "rule" and rule is None:
            continue
        out.append(Indicator(r["list"], r["line"], r["kind"], r["value"], r["label"], rule))
    return out


def _test(t: Timeline, i: Indicator) -> Column:
    if i.rule is not None:
        return F.coalesce(i.rule, F.lit(False))
    test = matches if i.kind == "regex" else contains
    return any_of(test(t.text(c), i.value) for c in t.data_columns)


def first_hit(t: Timeline, indicators: list[Indicator]) -> Column:
    """Place (from 0) of the first indicator that hits, in line order; null if none does. No shuffle."""
    parts = []
    for at in range(0, len(indicators), CHUNK):
        c = F.when(_test(t, indicators[at]), at)
        for k in range(at + 1, min(at + CHUNK, len(indicators))):
            c = c.when(_test(t, indicators[k]), k)
        parts.append(c)
    if not parts:
        return F.lit(None).cast("int")
    return F.least(*parts) if len(parts) > 1 else parts[0]


def scan(t: Timeline, indicators: list[Indicator]) -> DataFrame:
    """Rows hit, with list, line and label of the first indicator of each list that hit: the row's key, list, line, label."""
    lists = sorted({i.list for i in indicators})
    hits = []
    for name in lists:
        own = [i for i in indicators if i.list == name]
        table = F.array(*[F.struct(F.lit(i.line).alias("line"), F.lit(i.label).alias("label")) for i in own])
        k = first_hit(t, own)
        hits.append(F.struct(F.lit(name).alias("list"), F.get(table, k).alias("hit")))
    if not hits:
        return t.df.select(*t.key, F.lit("").alias("list"), F.lit(0).alias("line"), F.lit("").alias("label")).limit(0)
    found = t.df.select(*t.key, F.explode(F.filter(F.array(*hits), lambda h: h["hit"].isNotNull())).alias("h"))
    return found.select(*t.key, "h.list", "h.hit.line", "h.hit.label")


def _blocks(needles: DataFrame) -> Iterator[list[list[tuple[str, str, int]]]]:
    """The needles (needle, list, line) in parts of at most ``BROADCAST_BYTES``, each as blocks of about ``AUTOMATON_BYTES``, one part at a time."""
    size = needles.agg(F.coalesce(F.sum(F.octet_length("needle") + F.octet_length("list") + 16), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-size // BROADCAST_BYTES))
    part = F.pmod(F.xxhash64("needle"), F.lit(parts))
    for k in range(parts):
        blocks: list[list[tuple[str, str, int]]] = [[]]
        held = 0
        for r in needles.where(part == k).collect():
            if held >= AUTOMATON_BYTES:
                blocks, held = [*blocks, []], 0
            blocks[-1].append((r["needle"], r["list"], r["line"]))
            held += len(r["needle"].encode())
        yield [b for b in blocks if b]


def _literal_hits(cells: DataFrame, key: list[str], blocks: list[list[tuple[str, str, int]]]) -> DataFrame:
    """The row's key, list and line of the first needle of each list in any cell of (key, cells); one narrow pass.

    A task reads its rows once and takes the blocks one by one, so it holds one
    automaton, and its rows only if there are several blocks.
    """
    sent = cells.sparkSession.sparkContext.broadcast(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        held = batches if len(sent.value) == 1 else list(batches)
        for block in sent.value:
            automaton, places = ahocorasick.Automaton(), {}
            for needle, name, line in block:
                places.setdefault(needle, []).append((name, line))
            for needle, at in places.items():
                automaton.add_word(needle, at)
            automaton.make_automaton()
            for batch in held:
                rows: list[int] = []
                out: list[tuple[str, int]] = []
                for row, texts in enumerate(batch.column("cells").to_pylist()):
                    first: dict[str, int] = {}
                    seen = {id(at): at for text_ in texts for _, at in automaton.iter(text_)}
                    for at in seen.values():
                        for name, line in at:
                            first[name] = min(line, first.get(name, line))
                    rows += [row] * len(first)
                    out += first.items()
                keys = [batch.column(k).take(pa.array(rows, pa.int64())) for k in key]
                found = [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([*keys, *found], [*key, "list", "line"])

    types = dict(cells.dtypes)
    return cells.mapInArrow(run, ", ".join(f"{k} {types[k]}" for k in key) + ", list string, line int")


def scan_many(t: Timeline, indicators: DataFrame, rules: dict[tuple[str, int], Column] | None = None) -> DataFrame:
    """As :func:`scan`, for lists that no expression holds.

    Literals are sought in all data columns by automata over blocks of checked
    size: nothing but hits is shuffled, no row meets a literal that it does not
    hold, and the text is read once for each ``BROADCAST_BYTES`` of literals.
    Regular expressions and rules, which have no such index, run as :func:`scan`
    runs them.
    """
    needles = indicators.where("kind = 'plain' AND value <> ''").select(F.lower("value").alias("needle"), "list", "line").distinct()
    cells = t.df.select(*t.key, F.array(*[F.lower(t.text(c)) for c in t.data_columns]).alias("cells"))
    found = scan(t, compiled(indicators.where("kind IN ('regex', 'rule')"), rules)).select(*t.key, "list", "line")
    for blocks in _blocks(needles):
        if blocks:
            found = found.unionByName(_literal_hits(cells, list(t.key), blocks))
    first = found.groupBy(*t.key, "list").agg(F.min("line").alias("line"))
    labels = indicators.groupBy("list", "line").agg(F.first("label").alias("label"))
    return first.join(labels, ["list", "line"]).select(*t.key, "list", "line", "label")


def hit_tags(hits: DataFrame, timeline_id: int = 0) -> DataFrame:
    """The tag ``ioc:<list>`` for every row that a list hits."""
    own = F.col("timeline_id") if "timeline_id" in hits.columns else F.lit(timeline_id).cast("long")
    return hits.select(own.alias("timeline_id"), "row_id", F.concat(F.lit(PREFIX), "list").alias("tag")).distinct()


def merge_label(comment: Column, label: Column) -> Column:
    """A label put in front of a comment that does not hold it yet."""
    return F.when(label == "", comment).when(~comment.rlike(r"\S"), label).when(F.contains(comment, label), comment).otherwise(F.concat(label, F.lit("; "), comment))


def run_all(t: Timeline, hits: DataFrame, tags: DataFrame | None = None, comments: DataFrame | None = None) -> DataFrame:
    """The row's key, tags and comment of the rows hit, after all lists in order: later labels end up in front.

    Every list has scanned the annotations as they were at the start. If ``tags``
    and ``comments`` are given, they are joined to the hits, and ``t`` is not read.
    """
    folded = hits.groupBy(*t.key).agg(F.array_sort(F.collect_list(F.struct("list", "label"))).alias("found"))
    if tags is not None and comments is not None:
        both = attach_comments(attach_tags(t.with_df(folded), tags), comments).df
    else:
        both = t.df.select(*t.key, "tags", "comment").join(folded, list(t.key))
    comment = F.aggregate("found", F.col("comment"), lambda c, h: merge_label(c, h["label"]))
    both_tags = F.array_sort(F.array_union("tags", F.transform("found", lambda h: F.concat(F.lit(PREFIX), h["list"]))))
    return both.select(*t.key, both_tags.alias("tags"), comment.alias("comment"))


def list_names(lists: DataFrame) -> DataFrame:
    """Trimmed names, one for those that differ in case only (the first by name), with their number of lines."""
    named = lists.withColumn("name", stripped("list")).where("name <> ''")
    return named.groupBy(F.lower("name").alias("key")).agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("lines")).select("name", "lines")


def parse_text(name: str, content: str) -> list[tuple[str, int, str]]:
    """Raw lines (list, line, text) of a list that is typed in."""
    return [(name, k + 1, line) for k, line in enumerate(re.split(r"\r?\n", content))]
