"""The two export layouts and the CSV dialect they are written in."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import order_by, sort_parts
from ..functions.predicates import filled
from ..model import TAG_SEPARATOR, Timeline

PRELUDE = "Timeline comments:"
#: The default output columns with the header words that feed them, best first; two come from the overlay.
DEFAULT_LAYOUT: list[tuple[str, list[str]]] = [
    ("Timestamp", ["datetime", "timestamp", "time", "date"]),
    ("Type/Field", ["type", "desc", "category", "field", "artifact"]),
    ("Event", ["message", "event", "detail", "descrip", "activity", "summary"]),
]
Layout = list[tuple[str, list[str]]]


def hide(t: Timeline, *columns: str) -> Timeline:
    return replace(t, columns=[c for c in t.columns if c not in columns])


def rename(t: Timeline, titles: dict[str, str]) -> Timeline:
    """Display names; a blank one falls back to the header."""
    merged = {c: (titles.get(c, "").strip() or t.title(c)) for c in t.columns}
    return replace(t, titles=merged)


def view(t: Timeline, keys: list[tuple[str, bool]] | None = None) -> DataFrame:
    """The view as it is exported: data columns under their titles, then Tags and Comment, in order."""
    cells = [t.text(c).alias(t.title(c)) for c in t.data_columns]
    ordered = t.df.orderBy(*order_by(t, keys or []))
    return ordered.select(*cells, F.array_join("tags", TAG_SEPARATOR).alias("Tags"), F.col("comment").alias("Comment"))


def with_prelude(t: Timeline, comment: str) -> DataFrame:
    """The view with its header as a row, and the timeline's comment as a row before it: no, cell0, cell1, ..."""
    cells = [*[t.text(c) for c in t.data_columns], F.array_join("tags", TAG_SEPARATOR), F.col("comment")]
    body = t.df.select((F.col("row_id") + 1).alias("no"), *[c.alias(f"cell{i}") for i, c in enumerate(cells)])
    header = [*[t.title(c) for c in t.data_columns], "Tags", "Comment"]
    head = [(0, *header)]
    if comment.strip():
        head.insert(0, (-1, PRELUDE, comment, *[""] * (len(header) - 2)))
    first = t.df.sparkSession.createDataFrame(head, body.schema)
    return first.unionByName(body).orderBy("no")


def csv_line(cells: list[Column]) -> Column:
    """A record of the dialect: commas, quotes only where a cell holds a comma, a quote or a line break, quotes inside doubled."""
    quoted = [F.when(c.rlike('[",\\n\\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c) for c in cells]
    return F.concat_ws(",", *quoted)


def lines(t: Timeline, keys: list[tuple[str, bool]] | None = None, comment: str = "", layout: Layout | None = None, annotated_only: bool = False) -> DataFrame:
    """The file of a view as ordered rows of one column, value: the comment of the timeline, if there is one, the header, and a record for each row.

    Rows are rendered where they are read, and one range sort carries their sort keys and
    records; the records of the comment and the header sort before all others. Titles may repeat.
    """
    if layout is None:
        header = [*[t.title(c) for c in t.data_columns], "Tags", "Comment"]
        cells = [t.text(c) for c in [*t.data_columns, "tags", "comment"]]
    else:
        header, cells = [n for n, _ in layout], [layout_column(t, s) for _, s in layout]
    df = t.df.where((F.size("tags") > 0) | filled("comment")) if annotated_only else t.df
    parts = sort_parts(t, keys or [])
    body = df.select(F.lit(2).alias("head"), csv_line(cells).alias("value"), *[c.alias(f"k{i}") for i, (c, _) in enumerate(parts)])
    heads = [(0, [PRELUDE, comment])] if comment.strip() else []
    top = t.df.sparkSession.createDataFrame([*heads, (1, header)], "head int, cells array<string>")
    record = F.array_join(F.transform("cells", lambda c: csv_line([c])), ",")
    rows = body.unionByName(top.select("head", record.alias("value")), allowMissingColumns=True)
    order = [F.col(f"k{i}").desc() if descending else F.col(f"k{i}").asc() for i, (_, descending) in enumerate(parts)]
    return rows.orderBy("head", *order).select("value")


def write_view(t: Timeline, path: str, keys: list[tuple[str, bool]] | None = None, comment: str = "", layout: Layout | None = None, annotated_only: bool = False) -> None:
    """:func:`lines` as a folder of text files that, one after the other by name, are the file of the view."""
    lines(t, keys, comment, layout, annotated_only).write.mode("overwrite").text(path, lineSep="\n")


def layout_column(t: Timeline, sources: list[str]) -> Column:
    """No source: empty; one: its value; several: ``name: value; `` for each."""
    value = lambda s: F.col("comment") if s == "comment" else t.text(s)
    if not sources:
        return F.lit("")
    if len(sources) == 1:
        return value(sources[0])
    return F.concat(*[x for s in sources for x in (F.lit(f"{t.title(s)}: "), value(s), F.lit("; "))])


def to_timeline(t: Timeline, layout: Layout, annotated_only: bool = False) -> DataFrame:
    """The rows in a layout of output columns; ``annotated_only`` keeps rows with a tag or a comment, and is tested first."""
    df = t.df.where((F.size("tags") > 0) | filled("comment")) if annotated_only else t.df
    return df.select(*t.key, *[layout_column(t, s).alias(n) for n, s in layout])


def default_layout(t: Timeline) -> Layout:
    """Sources chosen by header: the first column that holds the best word; a source is used once."""
    used: set[str] = set()
    out: Layout = []
    for name, words in DEFAULT_LAYOUT:
        hit = next((c for w in words for c in t.data_columns if c not in used and w in t.title(c).lower()), None)
        used |= {hit} if hit else set()
        out.append((name, [hit] if hit else []))
    return [*out, ("Comments", ["comment"]), ("Tag", ["tags"])]


def reapply(t: Timeline, stored: Layout) -> Layout:
    """A stored layout (sources by title) on another timeline: names ignore case, missing sources are skipped."""
    by_name = {**{t.title(c).lower(): c for c in reversed(t.data_columns)}, "tags": "tags", "comment": "comment"}
    return [(n, [by_name[s.lower()] for s in sources if s.lower() in by_name]) for n, sources in stored]


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    """Comma, minimal quoting, doubled quotes; the order of ``df`` stays, one file for each partition."""
    df.write.mode("overwrite").options(header=header, sep=",", quote='"', escape='"', emptyValue="", lineSep="\n", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
