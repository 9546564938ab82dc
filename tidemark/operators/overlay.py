"""The annotation overlay: tags, comments and cell edits kept in side tables and joined by row.

Side tables are keyed by (timeline_id, row_id); see ``model``. Joins are plain
left joins, so Spark broadcasts a small overlay and shuffles a large one.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.predicates import filled, stripped
from ..model import DEFAULT_COLOR, NO_COLOR, Timeline

KEY = ["timeline_id", "row_id"]
#: Headers of columns that hold annotations already.
TAG_HEADERS, COMMENT_HEADERS = ["tag", "tags"], ["comment", "comments", "note", "notes"]


def tag_lists(tags: DataFrame, *keys: str) -> DataFrame:
    """Sorted distinct tags of each row."""
    return tags.groupBy(*(keys or KEY)).agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def attach_tags(t: Timeline, tags: DataFrame) -> Timeline:
    lists = tag_lists(t.own(tags), *t.key)
    df = t.df.drop("tags").join(lists, list(t.key), "left")
    return t.with_df(df.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>"))))


def attach_comments(t: Timeline, comments: DataFrame) -> Timeline:
    df = t.df.drop("comment").join(t.own(comments).select(*t.key, "comment"), list(t.key), "left")
    return t.with_df(df.withColumn("comment", F.coalesce("comment", F.lit(""))))


def apply_edits(t: Timeline, edits: DataFrame) -> Timeline:
    """Cell overrides by the position of their column; filters and sorts after this see the new values.

    Of several edits of one cell the last one counts: the greatest ``seq``, if the table has
    that column, then the greatest value, so that the result does not depend on the order of rows.
    """
    own = t.own(edits)
    last = F.struct(*[c for c in ("seq",) if c in own.columns], "value")
    cells = own.groupBy(*t.key, "col").agg(F.max(last)["value"].alias("value"))
    per_row = cells.groupBy(*t.key).agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("_edits"))
    df = t.df.join(per_row, list(t.key), "left")
    edited = {c: F.coalesce(F.element_at("_edits", F.lit(i)), F.col(f"`{c}`").cast("string")) for i, c in enumerate(t.columns)}
    return t.with_df(df.withColumns(edited).drop("_edits"))


def edit_cells(cells: Column, edits: Column) -> Column:
    """A snapshot's cells with a map of edits by position; a short record is padded up to the last edited cell."""
    last = F.coalesce(F.array_max(F.map_keys(edits)), F.lit(-1))
    padded = F.concat(cells, F.array_repeat(F.lit(""), F.greatest(last + 1 - F.size(cells), F.lit(0))))
    return F.transform(padded, lambda v, i: F.coalesce(F.element_at(edits, i), v))


def highlights(tags: DataFrame, tag_defs: DataFrame) -> DataFrame:
    """Colour of the most important known tag of each row; null if that tag has none."""
    known = tags.join(tag_defs, tags["tag"] == tag_defs["name"])
    return known.groupBy(*KEY).agg(F.nullif(F.min_by("color", "priority"), F.lit(NO_COLOR)).alias("color"))


def delete_tag(tags: DataFrame, tag: str) -> DataFrame:
    return tags.where(F.col("tag") != tag)


def still_tagged(snapshot: DataFrame, tags: DataFrame) -> DataFrame:
    """Snapshot rows that have a tag left."""
    return snapshot.join(tags, KEY, "left_semi")


def remove_timeline(table: DataFrame, removed: DataFrame) -> DataFrame:
    """Any table of the case without the timelines in ``removed``."""
    return table.join(removed.select("timeline_id"), "timeline_id", "left_anti")


def rename_tag(tags: DataFrame, tag_defs: DataFrame, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """Tags and palette with a tag renamed; colour and priority stay."""
    new = new.strip()
    names = {r["name"] for r in tag_defs.where(F.col("name").isin(old, new)).select("name").collect()}
    if not new or old not in names or new in names:
        raise ValueError(f"cannot rename {old!r} to {new!r}")
    renamed = lambda c: F.when(F.col(c) == old, new).otherwise(F.col(c)).alias(c)
    return (
        tags.select(*[renamed(c) if c == "tag" else c for c in tags.columns]),
        tag_defs.select(*[renamed(c) if c == "name" else c for c in tag_defs.columns]),
    )


def add_tag(tags: DataFrame, rows: DataFrame, tag: str) -> DataFrame:
    """Tags with ``tag`` on every row of ``rows``; having it already changes nothing."""
    return tags.unionByName(rows.select(*KEY, F.lit(tag).alias("tag"))).dropDuplicates([*KEY, "tag"])


def remove_tag(tags: DataFrame, rows: DataFrame, tag: str) -> DataFrame:
    return tags.join(rows.select(*KEY, F.lit(tag).alias("tag")), [*KEY, "tag"], "left_anti")


def extend_palette(tag_defs: DataFrame, tags: DataFrame, color: str = DEFAULT_COLOR) -> DataFrame:
    """The palette with unknown tags at its end, by name. Numbering sees only the distinct new names."""
    new = tags.select(F.col("tag").alias("name")).distinct().join(tag_defs, "name", "left_anti")
    last = tag_defs.agg(F.coalesce(F.max("priority"), F.lit(-1)).alias("last")).first()["last"]
    number = F.row_number().over(W.orderBy("name"))
    return tag_defs.unionByName(new.select("name", F.lit(color).alias("color"), (number + last).alias("priority")))


def set_values(table: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Comments or edits with new values by key; an empty comment or null value clears.

    Of several new values of a key the last one counts (greatest ``seq``, where ``new`` has
    it, then greatest value; null is least).
    """
    last = F.max(F.struct(*[c for c in ("seq",) if c in new.columns], value))[value].alias(value)
    new = new.groupBy(*keys).agg(last)
    kept = table.join(new.select(*keys), keys, "left_anti")
    return kept.unionByName(new.where(F.col(value).isNotNull() & ((F.lit(value != "comment")) | filled(value))).select(*table.columns))


def adoptable(headers: list[str]) -> tuple[int | None, int | None]:
    """Positions of the first tag column and the first comment column."""
    low = [h.strip().lower() for h in headers]
    first = lambda names: next((i for i, h in enumerate(low) if h in names), None)
    return first(TAG_HEADERS), first(COMMENT_HEADERS)


def split_tags(c: Column) -> Column:
    """Tags of a cell: split at commas and semicolons, trimmed, without blanks and ``-``, sorted and distinct."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), "[,;]"), stripped)
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: (x != "") & (x != "-"))))


def adopt(t: Timeline) -> Timeline:
    """Annotations seeded from the timeline's own columns, which then no longer count as data."""
    tag, comment = adoptable([t.title(c) for c in t.columns])
    df, adopted = t.df, []
    if tag is not None:
        df = df.withColumn("tags", split_tags(F.col(f"`{t.columns[tag]}`")))
        adopted.append(t.columns[tag])
    if comment is not None:
        df = df.withColumn("comment", stripped(F.col(f"`{t.columns[comment]}`")))
        adopted.append(t.columns[comment])
    return replace(t, df=df, adopted=adopted)


def merge_palettes(old: DataFrame, new: DataFrame) -> DataFrame:
    """New definitions give colours, new names go to the end in their order."""
    a = old.select("name", F.col("color").alias("old_color"), F.col("priority").alias("old_priority"))
    b = new.select("name", F.col("color").alias("new_color"), F.col("priority").alias("new_priority"))
    both = a.join(b, "name", "full")
    order = W.orderBy(F.col("old_priority").asc_nulls_last(), "new_priority", "name")
    return both.select("name", F.coalesce("new_color", "old_color").alias("color"), (F.row_number().over(order) - 1).alias("priority"))
