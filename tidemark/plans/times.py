"""Queries T1 to T11 and X1 to X5: time and order."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import ordering as S
from ..functions import predicates as P
from ..functions import times as T
from ..sources import delimited as D
from . import base
from .base import DOCS_SQL, PARSE_SQL, SPELLED_SQL, Registry

R = Registry()
NOW = datetime(2024, 1, 15, 12)


def t1_parse_times(spark, sf_dir):
    t = base.spelled(spark, sf_dir)
    return t.df.select("row_id", T.parse_time("when_seen").cast("timestamp_ntz").alias("time"))


R.add("t1_parse_times", t1_parse_times, f"{SPELLED_SQL} SELECT row_id, {PARSE_SQL} AS time FROM spelled")


def t2_period_bounds(spark, sf_dir):
    """Start and end of what literals name: years, months, days, minutes and seconds of the events, in several spellings."""
    e = base.table(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"), F.col("ts").cast("timestamp").alias("ts"))
    cells = F.array(*[F.struct(F.lit(u).alias("unit"), F.date_format("ts", p).alias("cell")) for u, p in _LITERALS])
    rows = e.select("row_id", F.explode(cells).alias("u")).select("row_id", "u.unit", T.period_bounds("u.cell").alias("p"))
    return rows.select("row_id", "unit", F.col("p.start").cast("timestamp_ntz").alias("start"), F.col("p.end").cast("timestamp_ntz").alias("end"))


#: Units and the spellings of a literal that names one.
_LITERALS = [("YEAR", "yyyy"), ("MONTH", "yyyy-MM"), ("DAY", "yyyy/MM/dd"), ("MINUTE", "yyyy-MM-dd HH:mm"), ("SECOND", "dd-MMM-yyyy HH:mm:ss")]
R.add(
    "t2_period_bounds",
    t2_period_bounds,
    " UNION ALL ".join(f"SELECT event_id AS row_id, '{u}' AS unit, CAST(date_trunc('{u}', ts) AS TIMESTAMP) AS start, CAST(date_trunc('{u}', ts) + INTERVAL 1 {u} AS TIMESTAMP) AS \"end\" FROM events" for u, _ in _LITERALS),
)


def t11_s7_register_files(spark, sf_dir):
    """Several timelines registered in one job, their time columns found by their cells and titles."""
    spelled = base.spelled(spark, sf_dir)
    rare = F.when(F.col("row_id") % 5 == 0, F.col("when_seen")).otherwise("odd")
    orders = base.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("c0"), F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd").alias("c1"), F.lit("").alias("c2"))
    docs = base.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), F.col("text").alias("c0"), F.col("lang").alias("c1"))
    few = spelled.df.withColumn("c0", rare)
    timelines = [
        base.Timeline(few, ["c0", "event_type"], {"c0": "Created on"}, timeline_id=1, name="named"),
        base.Timeline(few, ["c0", "event_type"], {"c0": "Remark"}, timeline_id=2, name="not named"),
        base.Timeline(orders, ["c0", "c1", "c2"], {"c0": "Urgency", "c1": "Day", "c2": "Time"}, timeline_id=3, name="orders"),
        base.Timeline(docs, ["c0", "c1"], {"c0": "When", "c1": "Lang"}, timeline_id=4, name="documents"),
    ]
    found = D.register_detected(timelines, spark)
    rows = D.long_form([(t.timeline_id, t.df, t.columns) for t in timelines]).groupBy("timeline_id").agg(F.count(F.lit(1)).alias("n_rows"))
    return found.join(rows, "timeline_id").select("timeline_id", "name", F.array_join("headers", ",").alias("headers"), F.coalesce("time_col", F.lit(-1)).alias("time_col"), "n_rows")


R.add(
    "t11_s7_register_files",
    t11_s7_register_files,
    f"""{SPELLED_SQL}, f AS (SELECT {PARSE_SQL} AS t, row_id FROM spelled ORDER BY row_id LIMIT 200), rate AS (SELECT count(t) FILTER (WHERE row_id % 5 = 0) / count(*) AS r FROM f)
SELECT CAST(1 AS BIGINT) AS timeline_id, 'named' AS name, 'Created on,event_type' AS headers, CASE WHEN r + 0.15 >= 0.3 THEN 0 ELSE -1 END AS time_col, (SELECT count(*) FROM events) AS n_rows FROM rate
UNION ALL SELECT 2, 'not named', 'Remark,event_type', CASE WHEN r >= 0.6 THEN 0 ELSE -1 END, (SELECT count(*) FROM events) FROM rate
UNION ALL SELECT 3, 'orders', 'Urgency,Day,Time', 1, count(*) FROM orders UNION ALL SELECT 4, 'documents', 'When,Lang', -1, count(*) FROM documents""",
)
R.events_filter("t3_before", lambda c: T.before(c, "2024-01-05", ntz=True), "ts < TIMESTAMP '2024-01-05'")
R.events_filter("t4_after", lambda c: T.after(c, "2024-01-20", ntz=True), "ts >= TIMESTAMP '2024-01-21'")
R.events_filter("t5_between", lambda c: T.between(c, "2024-01-05", "2024-01-06 12:30", ntz=True), "ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06 12:31:00'")
R.events_filter("t7_relative_operands", lambda c: T.between(c, "now - 7d", "2024-01-10 + 1d12h", now=NOW, ntz=True), "ts >= TIMESTAMP '2024-01-08 12:00:00' AND ts < TIMESTAMP '2024-01-11 12:00:01'")
R.events_filter("t9_around_instant", lambda c: T.around(c, datetime(2024, 1, 15, 12), ntz=True), "ts >= TIMESTAMP '2024-01-15 11:55:00' AND ts < TIMESTAMP '2024-01-15 12:05:01'")


def t6_unparseable_never_matches(spark, sf_dir):
    t = base.spelled(spark, sf_dir)
    time = T.time_of(t, "when_seen")
    return t.df.select("row_id", T.after(time, "2024-01-10").alias("hit"), (~T.after(time, "2024-01-10")).alias("not_hit"))


R.add("t6_unparseable_never_matches", t6_unparseable_never_matches, f"{SPELLED_SQL} SELECT row_id, coalesce({PARSE_SQL} >= TIMESTAMP '2024-01-11', false) AS hit, NOT coalesce({PARSE_SQL} >= TIMESTAMP '2024-01-11', false) AS not_hit FROM spelled")


def t8_durations(spark, sf_dir):
    e = base.table(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 4 == 0, F.concat(F.col("user_id").cast("string"), F.lit("s"))).when(F.col("event_id") % 4 == 1, F.concat(F.lit("1d"), (F.col("event_id") % 24).cast("string"), F.lit("h"))).when(F.col("event_id") % 4 == 2, F.concat(F.lit("2w"), F.col("user_id").cast("string"), F.lit("m"))).otherwise(F.col("user_id").cast("string"))
    return e.select(F.col("event_id").alias("row_id"), F.coalesce(T.duration_seconds(text), F.lit(-1)).cast("long").alias("seconds"))


R.add("t8_durations", t8_durations, "SELECT event_id AS row_id, CASE event_id % 4 WHEN 0 THEN user_id WHEN 1 THEN 86400 + 3600 * (event_id % 24) WHEN 2 THEN 1209600 + 60 * user_id ELSE -1 END AS seconds FROM events")


def t9_interval_join(spark, sf_dir):
    """Every event within five minutes of a sign-up: an interval join without a nested loop."""
    e = base.table(spark, sf_dir, "events")
    anchors = e.where("event_type = 'signup'").select(F.col("event_id").alias("anchor_id"), F.col("ts").alias("anchor_ts"))
    return T.around_anchors(e.select("event_id", "ts"), "ts", anchors, "anchor_ts").select("event_id", "anchor_id")


_AROUND = "date_trunc('second', e.ts) BETWEEN date_trunc('second', a.ts) - INTERVAL 5 MINUTE AND date_trunc('second', a.ts) + INTERVAL 5 MINUTE"
R.add("t9_interval_join", t9_interval_join, f"SELECT e.event_id, a.event_id AS anchor_id FROM events e JOIN events a ON a.event_type = 'signup' AND {_AROUND}")


def t10_pivot_from_notes(spark, sf_dir):
    """Time notes as anchors on the detected time column: here the first event of each user is a note."""
    t = base.spelled(spark, sf_dir)
    column = T.detect_time_column(t).first()["time_column"]
    notes = t.df.groupBy("user_id").agg(F.min("ts").alias("note"))
    rows = t.df.select("row_id", T.time_of(t, column).cast("timestamp_ntz").alias("time")).where("time IS NOT NULL")
    return T.around_anchors(rows, "time", notes.withColumnRenamed("user_id", "note_of"), "note").groupBy("row_id").agg(F.count(F.lit(1)).alias("n_notes"))


R.add(
    "t10_pivot_from_notes",
    t10_pivot_from_notes,
    f"""{SPELLED_SQL}, n AS (SELECT user_id, min(ts) AS note FROM spelled GROUP BY user_id), e AS (SELECT row_id, {PARSE_SQL} AS ts FROM spelled)
SELECT row_id, count(*) AS n_notes FROM e JOIN n ON e.ts BETWEEN date_trunc('second', note) - INTERVAL 5 MINUTE AND date_trunc('second', note) + INTERVAL 5 MINUTE GROUP BY row_id""",
)


def t11_detect_time_column(spark, sf_dir):
    t = base.spelled(spark, sf_dir)
    return T.detect_time_column(t)


R.add(
    "t11_detect_time_column",
    t11_detect_time_column,
    f"{SPELLED_SQL}, f AS (SELECT * FROM spelled ORDER BY row_id LIMIT 200) SELECT CASE WHEN count({PARSE_SQL}) / count(*) + 0.15 >= 0.3 THEN 'when_seen' END AS time_column FROM f",
)

_NUM = r"CASE WHEN regexp_matches(trim(v), '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$') THEN TRY_CAST(trim(v) AS DOUBLE) END"
_MIXED_SQL = f"""WITH m AS (
  SELECT event_id AS row_id, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN CAST(user_id AS VARCHAR) WHEN 2 THEN event_type WHEN 3 THEN upper(event_type) || user_id ELSE user_id || '.5' END AS v FROM events
), k AS (SELECT row_id, v, v = '' AS e, {_NUM} AS n FROM m)"""


def _mixed(spark, sf_dir):
    e = base.table(spark, sf_dir, "events")
    user, kind = F.col("user_id").cast("string"), F.col("event_id") % 5
    v = F.when(kind == 0, "").when(kind == 1, user).when(kind == 2, F.col("event_type")).when(kind == 3, F.concat(F.upper("event_type"), user)).otherwise(F.concat(user, F.lit(".5")))
    df = e.select(F.col("event_id").alias("row_id"), v.alias("v"))
    return base.Timeline(df.withColumns({"tags": F.array().cast("array<string>"), "comment": F.lit("")}), ["v"])


def x1_mixed_order(spark, sf_dir):
    t = _mixed(spark, sf_dir)
    return S.positions(t.df.select("row_id", "v", "tags", "comment"), S.order_by(t, [("v", False)])).select("row_id", "position")


R.add("x1_mixed_order", x1_mixed_order, f"{_MIXED_SQL} SELECT row_id, row_number() OVER (ORDER BY e, n IS NULL, n, lower(v), row_id) - 1 AS position FROM k")


def x2_multi_key_sort(spark, sf_dir):
    t = base.docs(spark, sf_dir)
    return S.positions(t.df.drop("text"), S.order_by(t, [("lang", True), ("n_chars", False)])).select("row_id", "position")


R.add("x2_multi_key_sort", x2_multi_key_sort, f"{DOCS_SQL} SELECT row_id, row_number() OVER (ORDER BY lower(lang) DESC, CAST(n_chars AS DOUBLE), row_id) - 1 AS position FROM docs")


def x3_sort_by_annotations(spark, sf_dir):
    t = base.docs(spark, sf_dir)
    return S.positions(t.df.drop("text"), S.order_by(t, [("tags", True), ("comment", False), ("row", True)])).select("row_id", "position")


R.add("x3_sort_by_annotations", x3_sort_by_annotations, f"{DOCS_SQL} SELECT row_id, row_number() OVER (ORDER BY tag_text = '' DESC, lower(tag_text) DESC, comment = '', lower(comment), row_id DESC) - 1 AS position FROM docs")


def x4_sort_filtered(spark, sf_dir):
    t = base.docs(spark, sf_dir)
    kept = t.with_df(t.df.where(P.has_tag("Good")))
    return S.positions(kept.df.drop("text"), S.order_by(kept, [("source", False)])).select("row_id", "position")


R.add("x4_sort_filtered", x4_sort_filtered, f"{DOCS_SQL} SELECT row_id, row_number() OVER (ORDER BY lower(source), row_id) - 1 AS position FROM docs WHERE list_contains(tags, 'Good')")


def x5_page(spark, sf_dir):
    t = base.docs(spark, sf_dir)
    return S.page(t, [("n_chars", True)], 20, 70).select("row_id", "n_chars")


R.add("x5_page", x5_page, f"{DOCS_SQL} SELECT row_id, n_chars FROM docs ORDER BY CAST(n_chars AS DOUBLE) DESC, row_id LIMIT 50 OFFSET 20")
