"""Timelines over the given tables, and the SQL that stands for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import PALETTE, Timeline
from ..operators.overlay import attach_comments, attach_tags
from ..operators.sides import passing

DOC_COLUMNS = ["text", "lang", "source", "n_chars"]
EVENT_COLUMNS = ["ts", "event_type", "user_id", "props"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def palette(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, c, i) for i, (n, c) in enumerate(PALETTE)], "name string, color string, priority int")


def doc_tags(spark: SparkSession, sf_dir: str, timeline_id: int = 0) -> DataFrame:
    """Tags that stand in for annotations: the labels of the documents."""
    labels = table(spark, sf_dir, "labels")
    tag = F.array_compact(F.array(F.when(F.col("toxic") == 1, "Bad"), F.when(F.col("quality") == 1, "Good"), F.when(F.col("quality") == 0, "Suspicious")))
    return labels.select(F.lit(timeline_id).cast("long").alias("timeline_id"), F.col("doc_id").alias("row_id"), F.explode(tag).alias("tag"))


def doc_comments(spark: SparkSession, sf_dir: str, timeline_id: int = 0) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("lang = 'de'")
    return docs.select(F.lit(timeline_id).cast("long").alias("timeline_id"), F.col("doc_id").alias("row_id"), F.concat(F.lit("check "), "source").alias("comment"))


def bare_docs(spark: SparkSession, sf_dir: str) -> Timeline:
    df = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text", "lang", "source", F.col("n_chars").cast("string").alias("n_chars"))
    return Timeline(df.withColumns({"tags": F.array().cast("array<string>"), "comment": F.lit("")}), DOC_COLUMNS, {"text": "Summary"}, name="documents")


def docs(spark: SparkSession, sf_dir: str) -> Timeline:
    """The documents with their overlay."""
    return attach_comments(attach_tags(bare_docs(spark, sf_dir), doc_tags(spark, sf_dir)), doc_comments(spark, sf_dir))


def events(spark: SparkSession, sf_dir: str) -> Timeline:
    """The events with their typed time."""
    df = table(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"), "ts", "event_type", F.col("user_id").cast("string").alias("user_id"), "props")
    return Timeline(df.withColumns({"tags": F.array().cast("array<string>"), "comment": F.lit("")}), EVENT_COLUMNS, time_column="ts", timeline_id=1, name="events")


#: Spellings of a time, as Spark and as strftime patterns; the last is no time.
SPELLINGS: list[tuple[str, str]] = [
    ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"),
    ("yyyy-MM-dd'T'HH:mm:ss'Z'", "%Y-%m-%dT%H:%M:%SZ"),
    ("MM/dd/yyyy HH:mm:ss", "%m/%d/%Y %H:%M:%S"),
    ("MM/dd/yyyy hh:mm:ss a", "%m/%d/%Y %I:%M:%S %p"),
    ("dd-MMM-yyyy HH:mm:ss", "%d-%b-%Y %H:%M:%S"),
    ("yyyy/MM/dd HH:mm:ss", "%Y/%m/%d %H:%M:%S"),
    ("yyyy-MM-dd HH:mm", "%Y-%m-%d %H:%M"),
    ("MMM dd, yyyy HH:mm:ss", "%b %d, %Y %H:%M:%S"),
    ("yyyy-MM-dd", "%Y-%m-%d"),
    ("yyyy", "%Y"),
]


def spelled(spark: SparkSession, sf_dir: str) -> Timeline:
    """The events with their time as text in many spellings."""
    df = table(spark, sf_dir, "events")
    which = F.col("event_id") % len(SPELLINGS)
    when = F.lit("not a time")
    for i, (pattern, _) in enumerate(SPELLINGS):
        when = F.when(which == i, F.date_format(F.col("ts").cast("timestamp"), pattern)).otherwise(when)
    df = df.select(F.col("event_id").alias("row_id"), when.alias("when_seen"), "event_type", F.col("user_id").cast("string").alias("user_id"), "ts")
    return Timeline(df.withColumns({"tags": F.array().cast("array<string>"), "comment": F.lit("")}), ["when_seen", "event_type", "user_id"], time_column="when_seen")


TAGS_SQL = """tag_rows AS (
  SELECT doc_id AS row_id, 'Bad' AS tag FROM labels WHERE toxic = 1
  UNION ALL SELECT doc_id, 'Good' FROM labels WHERE quality = 1
  UNION ALL SELECT doc_id, 'Suspicious' FROM labels WHERE quality = 0
)"""
DOCS_SQL = f"""WITH {TAGS_SQL}, tag_lists AS (
  SELECT row_id, list_sort(list_distinct(list(tag))) AS tags FROM tag_rows GROUP BY row_id
), docs AS (
  SELECT doc_id AS row_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source, CAST(n_chars AS VARCHAR) AS n_chars,
         coalesce(tags, []) AS tags, array_to_string(coalesce(tags, []), ', ') AS tag_text, CASE WHEN lang = 'de' THEN 'check ' || source ELSE '' END AS comment
  FROM documents LEFT JOIN tag_lists ON row_id = doc_id
)"""
_WHEN_SQL = " ".join(f"WHEN {i} THEN strftime(ts, '{f}')" for i, (_, f) in enumerate(SPELLINGS))
SPELLED_SQL = f"""WITH spelled AS (
  SELECT event_id AS row_id, CASE event_id % {len(SPELLINGS)} {_WHEN_SQL} END AS when_seen, event_type, CAST(user_id AS VARCHAR) AS user_id, ts FROM events
)"""
#: The layouts of a cell that DuckDB is to try, in the same order (a bare year is not among them).
PARSE_SQL = "try_strptime(when_seen, ['%Y-%m-%dT%H:%M:%SZ', '%Y-%m-%d %H:%M:%S', '%Y-%m-%d %H:%M', '%Y-%m-%d', '%m/%d/%Y %H:%M:%S', '%m/%d/%Y %I:%M:%S %p', '%d-%b-%Y %H:%M:%S', '%b %d, %Y %H:%M:%S', '%Y/%m/%d %H:%M:%S'])"


class Registry:
    """Queries and their SQL under one name each."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, query, sql: str | None = None) -> None:
        self.queries[name] = query
        if sql is not None:
            self.oracles[name] = sql

    def docs_filter(self, name: str, predicate, sql: str) -> None:
        """A predicate over the documents; ``predicate`` takes the timeline."""

        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return passing(bare_docs(spark, sf_dir), predicate, doc_tags(spark, sf_dir), doc_comments(spark, sf_dir))

        self.add(name, query, f"{DOCS_SQL} SELECT row_id FROM docs WHERE {sql}")

    def events_filter(self, name: str, predicate, sql: str) -> None:
        """A predicate over the typed time of the events; ``predicate`` takes its column."""

        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return table(spark, sf_dir, "events").where(predicate(F.col("ts"))).select(F.col("event_id").alias("row_id"))

        self.add(name, query, f"SELECT event_id AS row_id FROM events WHERE {sql}")
