"""The data model: a timeline is a DataFrame of text columns with row ids and an annotation overlay.

The frame of a :class:`Timeline` holds ``row_id`` (0-based, in file order), the
data columns, ``tags`` (sorted array of distinct strings) and ``comment``. Null
plays no part: readers and builders turn it into the empty string.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The seeded palette, first is most important, and the colours of unknown tags and of list hits.
PALETTE = [("Bad", "#E53935"), ("Suspicious", "#FDD835"), ("Good", "#43A047")]
DEFAULT_COLOR, HIT_COLOR, NO_COLOR = "#78909C", "#8E24AA", "none"

TAGS = "timeline_id bigint, row_id bigint, tag string"
COMMENTS = "timeline_id bigint, row_id bigint, comment string"
EDITS = "timeline_id bigint, row_id bigint, col int, value string"
TAG_DEFS = "name string, color string, priority int"
INDICATORS = "list string, line int, kind string, value string, label string"

#: Names of fields that stand for annotations and for every column.
VIRTUAL = {"tag": "tags", "tags": "tags", "comment": "comment", "comments": "comment", "row": "row", "#": "row", "line": "row", "any": "any", "*": "any"}
TAG_SEPARATOR = ", "


@dataclass(frozen=True)
class Timeline:
    df: DataFrame
    columns: list[str]
    titles: dict[str, str] = field(default_factory=dict)
    time_column: str | None = None
    adopted: list[str] = field(default_factory=list)
    timeline_id: int = 0
    name: str = ""
    #: What names a row in every join, window and group; rows of several timelines have the timeline's id in it.
    key: tuple[str, ...] = ("row_id",)
    #: Columns that give the order of rows (the key if there are none), and the one that counts rows from 0.
    order: tuple[str, ...] = ()
    number: str | None = "row_id"

    def with_df(self, df: DataFrame) -> Timeline:
        return replace(self, df=df)

    @property
    def data_columns(self) -> list[str]:
        """Columns that count as data: adopted annotation columns do not."""
        return [c for c in self.columns if c not in self.adopted]

    @property
    def row_order(self) -> list[str]:
        return list(self.order or self.key)

    def own(self, table: DataFrame) -> DataFrame:
        """The rows of a side table that belong to this timeline, with the columns of its key."""
        return table if "timeline_id" in self.key else table.where(F.col("timeline_id") == self.timeline_id).drop("timeline_id")

    def held(self, test: Column) -> Column:
        """A test over data columns; see :class:`tidemark.operators.sides.Sided`."""
        return test

    def title(self, column: str) -> str:
        return self.titles.get(column) or column

    def resolve(self, name: str) -> str:
        """A field name to ``tags``, ``comment``, ``row``, ``any`` or a data column; the first match ignoring case wins."""
        low = name.strip().lower()
        if low in VIRTUAL:
            return VIRTUAL[low]
        for c in self.columns:
            if self.title(c).lower() == low or c.lower() == low:
                return c
        raise ValueError(f"unknown field {name!r}")

    def text(self, column: str) -> Column:
        """What a predicate on a column or virtual field sees."""
        if column == "tags":
            return F.array_join("tags", TAG_SEPARATOR)
        if column == "row":
            if self.number is None:
                raise ValueError("rows of this timeline are not numbered")
            return (F.col(self.number) + 1).cast("string")
        return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def timeline(df: DataFrame, columns: list[str], **more) -> Timeline:
    """A timeline over ``df``, with an empty overlay where it has none."""
    if "tags" not in df.columns:
        df = df.withColumn("tags", F.array().cast("array<string>"))
    if "comment" not in df.columns:
        df = df.withColumn("comment", F.lit(""))
    return Timeline(df, columns, **more)
