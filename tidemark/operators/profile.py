"""Summaries of a view: counts, distinct values, tag counts, match spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.ordering import sort_key
from ..functions.predicates import FilterSpec, Term, check_regex, contains, text
from ..model import Timeline
from ..storage import cut

DISTINCT_LIMIT = 2000
#: Rows of a view, for each value wanted, that are looked at before all are.
HEAD = 4
#: Spans that leave a task at once.
SPANS = 1 << 16


def tag_counts(tags: DataFrame, tag_defs: DataFrame) -> DataFrame:
    """Rows of each tag over the whole data set; palette tags without rows count 0."""
    counts = tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    both = counts.join(tag_defs.select(F.col("name").alias("tag")), "tag", "full")
    return both.select("tag", F.coalesce("n", F.lit(0)).alias("n"))


def distinct_values(t: Timeline, column: str, limit: int = DISTINCT_LIMIT, keys: list[tuple[str, bool]] | None = None) -> DataFrame:
    """value and truncated, sorted: the values found first in the order of ``keys``, at most ``limit``; the flag tells whether there are more.

    The first ``HEAD * limit`` rows of the view are looked at, of which each task keeps no
    more. Only if they hold too few values are those of all rows counted, once in each task before the shuffle.
    """
    rows = t.df.select(t.text(t.resolve(column)).alias("value"), sort_key(t, keys or []).alias("first"))
    head = cut(rows.orderBy("first").limit(HEAD * limit))
    if head.select("value").distinct().limit(limit + 1).count() > limit:
        rows = head
    some = rows.groupBy("value").agg(F.min("first").alias("first")).orderBy("first").limit(limit + 1)
    numbered = some.withColumn("n", F.row_number().over(W.orderBy("first"))).withColumn("total", F.count(F.lit(1)).over(W.partitionBy()))
    return numbered.where(F.col("n") <= limit).select("value", (F.col("total") > limit).alias("truncated")).orderBy("value")


def search_values(values: DataFrame, needle: str) -> DataFrame:
    """Values that contain the needle, blank ones shown as ``(blank)``."""
    shown = F.when(~F.col("value").rlike(r"\S"), "(blank)").otherwise(F.col("value"))
    return values.select(shown.alias("value")).where(contains("value", needle))


def hits_per_list(hits: DataFrame) -> DataFrame:
    """Rows that each list hits, of all timelines that the hits are of."""
    key = [c for c in ("timeline_id", "row_id") if c in hits.columns]
    return hits.select("list", *key).distinct().groupBy("list").agg(F.count(F.lit(1)).alias("n_rows"))


#: Characters that mark matches; where a cell has them itself they are read as another control character.
_START, _END, _OTHER = "\u0001", "\u0002", "\u0003"


def _marked(c: Column, pattern: str) -> Column:
    """A cell cut before each match; every part but the first is a match, a mark and what follows."""
    plain = F.translate(text(c), _START + _END, _OTHER + _OTHER)
    return F.split(F.regexp_replace(plain, pattern, f"{_START}$0{_END}"), _START, -1)


def _quoted(needle: str) -> str:
    return "\\Q" + needle.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def _places(parts: Column) -> Column:
    """The characters of each part of a cell without its mark, and of the match that it begins with."""
    return F.transform(parts, lambda p, i: F.struct((F.length(p) - F.when(i > 0, 1).otherwise(0)).alias("width"), F.length(F.substring_index(p, _END, 1)).alias("match")))


def spans(t: Timeline, terms: list[Term] | list[tuple[str, str]], cased: bool = False, joined: bool = False) -> DataFrame:
    """The row's key, column, start, end of every non-empty match of each (field, value) or (field, value, is regex) term, in characters, ignoring case unless ``cased``.

    ``any`` looks into every data column; ``joined`` joins overlapping and touching spans of a cell. The
    matches of a cell are placed by running lengths, and joined, in batches of the rows as they are
    read, so the work grows with the matches, and nothing is shuffled or sorted beyond a batch.
    """
    found: dict[str, list[Column]] = {}
    for name, value, *regex in terms:
        target = t.resolve(name) if name != "data" else "any"
        pattern = ("" if cased else "(?iu)") + (check_regex(value) if regex and regex[0] else _quoted(value))
        for c in t.data_columns if target == "any" else [target]:
            found.setdefault(c, []).append(_marked(t.text(c), pattern))
    if not found:
        return t.df.select(*t.key, F.lit("").alias("column"), F.lit(0).alias("start"), F.lit(0).alias("end")).limit(0)
    hits = [F.struct(F.lit(c).alias("column"), F.transform(F.filter(F.array(*parts), lambda p: F.size(p) > 1), _places).alias("terms")) for c, parts in found.items()]
    cells = t.df.select(*t.key, F.explode(F.filter(F.array(*hits), lambda x: F.size(x["terms"]) > 0)).alias("x")).select(*t.key, "x.column", "x.terms")
    schema = StructType([*(StructField(f.name, f.dataType) for f in cells.schema.fields[:-1]), StructField("start", IntegerType()), StructField("end", IntegerType())])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            of_cell = batch.column("terms").flatten()
            parts = of_cell.flatten()
            n = of_cell.value_lengths().to_numpy()
            row = np.repeat(np.repeat(np.arange(batch.num_rows), batch.column("terms").value_lengths().to_numpy()), n)
            width, match = (parts.field(f).to_numpy().astype(np.int64) for f in ("width", "match"))
            first = np.cumsum(n) - n
            start = np.cumsum(width) - width
            start -= np.repeat(start[first], n)
            kept = match > 0
            kept[first] = False  # what stands before the first match
            row, start, end = row[kept], start[kept], (start + match)[kept]
            if joined and len(row):
                order = np.lexsort((end, start, row))
                row, start, end = row[order], start[order], end[order]
                apart = row * (int(end.max()) + 1)  # cells one after the other
                new = np.flatnonzero(np.concatenate([[True], (apart + start)[1:] > np.maximum.accumulate(apart + end)[:-1]]))
                row, start, end = row[new], start[new], np.maximum.reduceat(end, new)
            for k in range(0, len(row), SPANS):
                some = slice(k, k + SPANS)
                named = [c.take(pa.array(row[some])) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*named, pa.array(start[some], pa.int32()), pa.array(end[some], pa.int32())], schema.names)

    return cells.mapInArrow(placed, schema)


def regex_spans(df: DataFrame, key: str, column: str, pattern: str) -> DataFrame:
    """key, start, end of every non-empty match in one column of any frame."""
    found = spans(Timeline(df.select(F.col(key).cast("long").alias("row_id"), column), [column]), [(column, pattern, True)])
    return found.select(F.col("row_id").alias(key), "start", "end")


def highlights(t: Timeline, spec: FilterSpec) -> DataFrame:
    """The row's key, column, start, end of what a filter spec looks for, overlapping and touching spans joined; what is excluded is not shown."""
    return spans(t, spec.terms(), spec.cased, joined=True)


def merge_spans(found: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping or touching spans of a cell joined, wherever they come from; those of one timeline's terms are joined by :func:`spans`."""
    by = W.partitionBy(*keys).orderBy("start", "end")
    far = F.max("end").over(by.rowsBetween(W.unboundedPreceding, -1))
    new = found.withColumn("new", F.when(far.isNull() | (F.col("start") > far), 1).otherwise(0))
    island = new.withColumn("island", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return island.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")
