"""Reading delimited timelines with stable, dense row ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.times import detect_time_columns
from ..model import Timeline, timeline
from ..storage import cut
from .records import blocks, cells, first_record, read_records

#: Delimiters in the order of ties.
DELIMITERS = [",", "\t", ";", "|"]
_EXTRA = "_extra"
#: A quoted part. Possessive, as Java else goes one call deeper for each character of a long cell.
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'


def sniff(spark: SparkSession, path: str) -> str:
    """The delimiter that is most frequent outside quotes in the first line."""
    lines = spark.read.text(path).limit(1).select(F.regexp_replace("value", _QUOTED + '?', "").alias("line"))
    counts = lines.select(*[(F.length("line") - F.length(F.replace("line", F.lit(d), F.lit("")))).alias(f"n{i}") for i, d in enumerate(DELIMITERS)]).first()
    if counts is None:
        raise ValueError(f"{path} is empty")
    return DELIMITERS[max(range(len(DELIMITERS)), key=lambda i: (counts[i], -i))]


def _header(spark: SparkSession, file: str, delimiter: str) -> list[str]:
    """The cells of the first record of a file."""
    n, held = 1, -1
    while True:
        lines = [r["value"] for r in spark.read.text(file, lineSep="\n").limit(n).collect()]
        if (record := first_record(lines, delimiter)) is not None or len(lines) == held:
            break
        n, held = 8 * n, len(lines)
    value = "\n".join(lines) if record is None else record
    return list(spark.createDataFrame([(value,)], "value string").select(cells(F.col("value"), delimiter).alias("c")).first()["c"])


def read_timeline(spark: SparkSession, path: str, delimiter: str | None = None, **more_) -> Timeline:
    """A timeline from delimited files, each with the headers in its first record.

    Columns get unique internal names (c0, c1, ...), the headers stay as titles.
    Every other record is a row, in the order of (file, place): a blank line is a row of
    one empty cell. Short records are filled with empty cells; cells beyond the header are kept
    in ``_extra``. All files are split among tasks and read under one rule, see
    :mod:`.records`: a first pass leaves a row for each block, with the state that it begins in
    and the records before it, and the second one reads the records and numbers them.
    """
    delimiter = delimiter or sniff(spark, path)
    starts = cut(blocks(spark, path, delimiter))
    first = starts.orderBy("_file", "_block").first()
    if first is None:
        raise ValueError(f"{path} is empty")
    titles = _header(spark, first["_file"], delimiter)
    columns = [f"c{i}" for i in range(len(titles))]
    # Headers are left out: the first record of each file, so there are as many before a record as files up to its own.
    heads = starts.groupBy("_file").agg(F.min("before").alias("_head"))
    heads = heads.withColumn("_heads", F.row_number().over(W.orderBy("_file")))
    rows = read_records(spark, path, delimiter, starts).join(F.broadcast(heads), "_file").where(F.col("number") > F.col("_head"))
    rows = rows.select((F.col("number") - F.col("_heads")).cast("long").alias("row_id"), cells(F.col("value"), delimiter).alias("_cells"))
    extra = F.slice("_cells", len(columns) + 1, F.greatest(F.size("_cells") - len(columns), F.lit(0)))
    rows = rows.select("row_id", *[F.coalesce(F.get("_cells", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(columns)], extra.alias(_EXTRA))
    return timeline(rows, columns, titles=dict(zip(columns, titles, strict=True)), **more_)


def rows_between(t: Timeline, low: int, high: int) -> DataFrame:
    return t.df.where((F.col("row_id") >= low) & (F.col("row_id") < high))


def row_number(t: Timeline, shown: int) -> DataFrame:
    """The row with a displayed (1-based) number."""
    return t.df.where(F.col("row_id") == shown - 1)


def in_memory(spark: SparkSession, headers: list[str], rows: list[list[str]], **more) -> Timeline:
    """A small timeline from Python lists; short records are filled."""
    columns = [f"c{i}" for i in range(len(headers))]
    data = [(i, *[*r[: len(headers)], *[""] * (len(headers) - len(r))]) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, "row_id bigint, " + ", ".join(f"{c} string" for c in columns))
    return timeline(df, columns, titles=dict(zip(columns, headers, strict=True)), **more)


def register(timelines: list[tuple[int, str, str, DataFrame, list[str], int | None]], spark: SparkSession) -> DataFrame:
    """The table of timelines: id, name, source, headers, display_headers (equal at first), time_col."""
    rows = [(i, name, source, headers, headers, time) for i, name, source, _, headers, time in timelines]
    return spark.createDataFrame(rows, "timeline_id bigint, name string, source string, headers array<string>, display_headers array<string>, time_col int")


def register_detected(timelines: list[Timeline], spark: SparkSession) -> DataFrame:
    """:func:`register` of timelines whose time columns are found by what is in them, one job for all."""
    table = register([(t.timeline_id, t.name, f"{t.name}.csv", t.df, [t.title(c) for c in t.columns], None) for t in timelines], spark)
    return table.drop("time_col").join(detect_time_columns(timelines), "timeline_id")


def long_form(timelines: list[tuple[int, DataFrame, list[str]]]) -> DataFrame:
    """Rows of many timelines as (timeline_id, row_id, cells)."""
    out = None
    for i, df, columns in timelines:
        cells = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
        one = df.select(F.lit(i).cast("long").alias("timeline_id"), "row_id", cells.alias("cells"))
        out = one if out is None else out.unionByName(one)
    return out
