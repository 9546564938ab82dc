"""Tagged snapshots and the master timeline over differently shaped sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import positions
from ..functions.predicates import stripped
from ..functions.times import time_of
from ..model import TAG_SEPARATOR, Timeline
from .overlay import COMMENT_HEADERS, TAG_HEADERS

SUMMARY_LENGTH = 400


def summary(cells: Column) -> Column:
    """Trimmed non-empty cells joined by bars, cut after 400 characters."""
    trimmed = F.filter(F.transform(cells, lambda x: stripped(x)), lambda x: x != "")
    joined = F.array_join(trimmed, " | ")
    return F.when(F.length(joined) > SUMMARY_LENGTH, F.concat(F.left(joined, F.lit(SUMMARY_LENGTH)), F.lit("…"))).otherwise(joined)


def snapshot(t: Timeline, tags: DataFrame) -> DataFrame:
    """Tagged rows of a timeline (edits applied before): timeline_id, row_id, time_raw, time, summary, cells."""
    own = tags.where(F.col("timeline_id") == t.timeline_id).select("row_id")
    rows = t.df.join(own, "row_id", "left_semi")
    cells = F.array(*[t.text(c) for c in t.data_columns])
    raw = t.text(t.time_column) if t.time_column else F.lit("")
    time = time_of(t, t.time_column) if t.time_column else F.lit(None)
    return rows.select(F.lit(t.timeline_id).cast("long").alias("timeline_id"), "row_id", raw.alias("time_raw"), time.cast("timestamp").alias("time"), summary(cells).alias("summary"), cells.alias("cells"))


def master(snapshots: DataFrame, timelines: DataFrame, tags: DataFrame, comments: DataFrame) -> DataFrame:
    """Snapshot rows with their timeline's name, tags and comment. Sort by :func:`master_order`."""
    lists = tags.groupBy("timeline_id", "row_id").agg(F.array_join(F.array_sort(F.collect_set("tag")), TAG_SEPARATOR).alias("tags"))
    out = snapshots.join(timelines.select("timeline_id", F.col("name").alias("timeline")), "timeline_id", "left")
    out = out.join(lists, ["timeline_id", "row_id"], "left").join(comments.select("timeline_id", "row_id", "comment"), ["timeline_id", "row_id"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in ("timeline", "tags", "comment")})


def master_order() -> list[Column]:
    """Timed rows by time, then the others by timeline; ids break ties."""
    return [F.col("time").isNull(), F.col("time"), F.when(F.col("time").isNull(), F.col("timeline")), F.col("timeline_id"), F.col("row_id")]


def shown_time(time: Column, raw: Column) -> Column:
    return F.coalesce(F.date_format(time.cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSS"), raw)


def aligned_headers(display: list[list[str]]) -> list[str]:
    """Ordered union of display headers, letter by letter, without blanks and annotation headers."""
    out: dict[str, None] = {}
    for headers in display:
        out.update(dict.fromkeys(h for h in headers if h and h.strip().lower() not in [*TAG_HEADERS, *COMMENT_HEADERS]))
    return list(out)


def _survey(rows: DataFrame) -> tuple[list[int], bool]:
    """The timelines that have entries, in the order of their first ones, and whether some entry lacks cells. One small aggregate."""
    first = F.min(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(master_order())]))
    found = rows.groupBy("timeline_id").agg(first.alias("first"), F.max(F.size("cells") == 0).alias("old")).orderBy("first").select("timeline_id", "old").collect()
    return [r["timeline_id"] for r in found], any(r["old"] for r in found)


#: What the grid adds to the aligned columns: internal names and their titles.
FIXED = {"time": "Time", "timeline": "Timeline"}
ORDER = ["_untimed", "_at", "_timeline", "timeline_id", "row_id"]


def aligned(parts: list[tuple[Timeline, DataFrame]], tags: DataFrame, comments: DataFrame, timelines: DataFrame, numbered: bool = False) -> Timeline:
    """The entries of several timelines as one: Time, Timeline, and a column for each display header, in the order of the entries.

    Columns have internal names, the headers are titles, so headers that differ
    in case only, or are called as the fixed ones are, stand beside each other. On a
    header that a timeline has twice the last column wins; what a timeline lacks is empty. If some
    entry has no cells, as those of old snapshots, there is a Summary column with the summary of every entry.

    Rows are named by (timeline_id, row_id), as two timelines may use the same
    row ids; ``numbered`` adds their places in the master timeline, which the
    field ``row`` then shows (a sort of all entries).
    """
    own = {t.timeline_id: t for t, _ in parts}
    rows = master(reduce(DataFrame.unionByName, [snap for _, snap in parts]), timelines, tags, comments)
    found, old = _survey(rows)
    headers = aligned_headers([[own[i].title(c) for c in own[i].data_columns] for i in found])
    cells = {}
    for k, h in enumerate(headers):
        # The place of the header in each timeline that has it.
        at = [(i, max(n for n, c in enumerate(own[i].data_columns) if own[i].title(c) == h)) for i in found if h in map(own[i].title, own[i].data_columns)]
        place = F.try_element_at(F.create_map(*[F.lit(x) for pair in at for x in (int(pair[0]), pair[1])]), F.col("timeline_id").cast("int"))
        cells[f"c{k}"] = F.coalesce(F.get("cells", place), F.lit(""))
    titles = {**FIXED, **{f"c{k}": h for k, h in enumerate(headers)}, **({"summary": "Summary"} if old else {})}
    untimed, at_, name, *_ = master_order()
    grid = rows.select(
        "timeline_id",
        "row_id",
        untimed.alias("_untimed"),
        at_.alias("_at"),
        name.alias("_timeline"),
        shown_time(F.col("time"), F.col("time_raw")).alias("time"),
        "timeline",
        *[c.alias(n) for n, c in cells.items()],
        *(["summary"] if old else []),
        F.filter(F.split("tags", TAG_SEPARATOR), lambda x: x != "").alias("tags"),
        "comment",
    )
    if numbered:
        grid = positions(grid, [F.col(c) for c in ORDER])
    return Timeline(grid, list(titles), titles, time_column="time", name="(master)", key=("timeline_id", "row_id"), order=("position",) if numbered else tuple(ORDER), number="position" if numbered else None)


def back_to_source(rows: DataFrame, t: Timeline) -> DataFrame:
    """The source rows of the master rows of one timeline."""
    own = rows.where(F.col("timeline_id") == t.timeline_id).select("row_id")
    return t.df.join(own, "row_id", "left_semi")


def titled(t: Timeline) -> dict[str, str]:
    """Internal names of the columns by title; the first of equal titles."""
    return {t.title(c): c for c in reversed(t.columns)}


def master_tags(t: Timeline) -> DataFrame:
    """The tags of a master's rows as a table, for its counts and palette."""
    return t.df.select("timeline_id", "row_id", F.explode("tags").alias("tag"))
