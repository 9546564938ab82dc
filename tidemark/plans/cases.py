"""Queries M1 to M8, E1 to E11 and S1 to S9: master timeline, exports, sources."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..functions.ordering import order_by, positions
from ..functions.predicates import Condition, FilterSpec, has_tag
from ..model import Timeline
from ..operators import indicators as I
from ..operators import master as M
from ..operators.overlay import apply_edits, extend_palette
from ..operators.profile import highlights, tag_counts
from ..sources import annotations as N
from ..sources import delimited as D
from ..sources import exports as E
from . import base
from .annotations import _EDITED_SQL, _edits
from .base import DOCS_SQL, TAGS_SQL, Registry

R = Registry()


def _folder(spark) -> str:
    """A new folder that all executors share; one on this machine only where the session names none, in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(shared or tempfile.mkdtemp(prefix='tidemark-')).rstrip('/')}/{uuid.uuid4().hex}"


def _orders(spark, sf_dir) -> Timeline:
    o = base.table(spark, sf_dir, "orders")
    df = o.select(F.col("o_orderkey").alias("row_id"), "o_orderdate", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("message"))
    return Timeline(df.withColumns({"tags": F.array().cast("array<string>"), "comment": F.lit("")}), ["o_orderdate", "status", "message"], {"status": "Kind", "message": "Event"}, "o_orderdate", [], 2, "orders")


def _events(spark, sf_dir) -> Timeline:
    t = base.events(spark, sf_dir)
    return Timeline(t.df, ["ts", "event_type", "user_id"], {"event_type": "Event", "user_id": "User"}, "ts", [], 1, "events")


def _spelled(spark, sf_dir) -> Timeline:
    t = base.spelled(spark, sf_dir)
    return Timeline(t.df, ["when_seen", "event_type"], {"event_type": "Event"}, "when_seen", [], 3, "spelled")


def _case_tags(spark, sf_dir):
    """Errors, urgent orders and sign-ups are tagged."""
    e, o = base.table(spark, sf_dir, "events"), base.table(spark, sf_dir, "orders")
    row = lambda i, k, tag: (F.lit(i).cast("long").alias("timeline_id"), F.col(k).alias("row_id"), F.lit(tag).alias("tag"))
    tags = e.where("event_type = 'error'").select(*row(1, "event_id", "Bad"))
    tags = tags.unionByName(e.where("event_type = 'signup'").select(*row(1, "event_id", "New")))
    tags = tags.unionByName(o.where("o_orderpriority = '1-URGENT'").select(*row(2, "o_orderkey", "Bad")))
    return tags.unionByName(e.where("event_type = 'error'").select(*row(3, "event_id", "Late")))


def _case_comments(spark, sf_dir):
    e = base.table(spark, sf_dir, "events").where("event_type = 'error'")
    return e.select(F.lit(1).cast("long").alias("timeline_id"), F.col("event_id").alias("row_id"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("comment"))


def _timelines(spark, *parts: Timeline):
    return D.register([(t.timeline_id, t.name, f"{t.name}.csv", t.df, [t.title(c) for c in t.columns], 0) for t in parts], spark)


_CASE_SQL = """WITH tags AS (
  SELECT 1 AS timeline_id, event_id AS row_id, CASE event_type WHEN 'error' THEN 'Bad' ELSE 'New' END AS tag FROM events WHERE event_type IN ('error', 'signup')
  UNION ALL SELECT 2, o_orderkey, 'Bad' FROM orders WHERE o_orderpriority = '1-URGENT'
)"""
_SHOWN = "strftime({t}, '%Y-%m-%d %H:%M:%S.%g')"


def m1_tagged_snapshot(spark, sf_dir):
    """Tagged documents with edits applied."""
    t = apply_edits(base.bare_docs(spark, sf_dir), _edits(spark, sf_dir))
    snap = M.snapshot(Timeline(t.df, ["lang", "source", "n_chars"]), base.doc_tags(spark, sf_dir))
    return snap.select("row_id", "time_raw", "summary", F.array_join("cells", ",").alias("cells"))


R.add(
    "m1_tagged_snapshot",
    m1_tagged_snapshot,
    f"""WITH e AS (SELECT d.doc_id AS row_id, {_EDITED_SQL.replace('doc_id', 'd.doc_id')}, n_chars FROM documents d JOIN labels l ON l.doc_id = d.doc_id)
SELECT row_id, '' AS time_raw, lang || ' | ' || source || ' | ' || n_chars AS summary, lang || ',' || source || ',' || n_chars AS cells FROM e""",
)


def m2_summary(spark, sf_dir):
    d = base.table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("row_id"), F.md5(M.summary(F.array(F.lit("  "), "lang", F.concat(F.lit(" "), "source"), "text"))).alias("summary_md5"))


R.add(
    "m2_summary",
    m2_summary,
    r"""WITH s AS (SELECT doc_id, lang || ' | ' || source || CASE WHEN regexp_replace(text, '^\s+|\s+$', '', 'g') <> '' THEN ' | ' || regexp_replace(text, '^\s+|\s+$', '', 'g') ELSE '' END AS s FROM documents)
SELECT doc_id AS row_id, md5(CASE WHEN length(s) > 400 THEN left(s, 400) || '…' ELSE s END) AS summary_md5 FROM s""",
)


def _snapshots(spark, sf_dir, *parts):
    tags = _case_tags(spark, sf_dir)
    return [(t, M.snapshot(t, tags)) for t in parts]


def _master(spark, sf_dir, parts, **more) -> Timeline:
    return M.aligned(parts, _case_tags(spark, sf_dir), _case_comments(spark, sf_dir), _timelines(spark, *[t for t, _ in parts]), **more)


def m3_master(spark, sf_dir):
    """The master timeline of events and orders with its positions."""
    parts = _snapshots(spark, sf_dir, _events(spark, sf_dir), _orders(spark, sf_dir))
    rows = M.master(parts[0][1].unionByName(parts[1][1]), _timelines(spark, *[t for t, _ in parts]), _case_tags(spark, sf_dir), _case_comments(spark, sf_dir))
    return positions(rows.drop("cells", "summary"), M.master_order()).select("timeline_id", "row_id", "timeline", "tags", "comment", "position")


R.add(
    "m3_master",
    m3_master,
    f"""{_CASE_SQL}, m AS (
  SELECT CAST(1 AS BIGINT) AS timeline_id, e.event_id AS row_id, 'events' AS timeline, tag AS tags, CASE WHEN event_type = 'error' THEN 'user ' || user_id ELSE '' END AS comment, ts FROM events e JOIN tags ON timeline_id = 1 AND row_id = e.event_id
  UNION ALL SELECT 2, o_orderkey, 'orders', tag, '', o_orderdate FROM orders JOIN tags ON timeline_id = 2 AND row_id = o_orderkey
) SELECT timeline_id, row_id, timeline, tags, comment, row_number() OVER (ORDER BY ts, timeline_id, row_id) - 1 AS position FROM m""",
)


def m4_aligned_union(spark, sf_dir):
    """Three timelines under shared headers; of the third, times that cannot be read are shown raw."""
    parts = _snapshots(spark, sf_dir, _events(spark, sf_dir), _orders(spark, sf_dir), _spelled(spark, sf_dir))
    t = _master(spark, sf_dir, parts)
    at = M.titled(t)
    return t.df.select("time", "timeline", F.array_join("tags", ", ").alias("tags"), "comment", F.lit("").alias("summary"), "timeline_id", "row_id", *[F.col(at[h]).alias(n) for h, n in (("Event", "Event"), ("User", "User"), ("Kind", "Kind"), ("when_seen", "seen"))])


_GRID_SQL = f"""{_CASE_SQL}, spelled AS (
  SELECT event_id AS row_id, CASE event_id % {len(base.SPELLINGS)} {base._WHEN_SQL} END AS when_seen, event_type FROM events WHERE event_type = 'error'
), grid AS (
  SELECT {_SHOWN.format(t='ts')} AS time, 'events' AS timeline, tag AS tags, CASE WHEN event_type = 'error' THEN 'user ' || user_id ELSE '' END AS comment, '' AS summary, CAST(1 AS BIGINT) AS timeline_id, event_id AS row_id, event_type AS "Event", CAST(user_id AS VARCHAR) AS "User", '' AS "Kind", '' AS seen FROM events JOIN tags ON timeline_id = 1 AND row_id = event_id
  UNION ALL SELECT {_SHOWN.format(t='o_orderdate')}, 'orders', tag, '', '', 2, o_orderkey, o_orderpriority, '', o_orderstatus, '' FROM orders JOIN tags ON timeline_id = 2 AND row_id = o_orderkey
  UNION ALL SELECT coalesce({_SHOWN.format(t=base.PARSE_SQL)}, when_seen), 'spelled', 'Late', '', '', 3, row_id, event_type, '', '', when_seen FROM spelled
)"""
R.add("m4_aligned_union", m4_aligned_union, f"{_GRID_SQL} SELECT * FROM grid")


def m5_m6_time_and_summary(spark, sf_dir):
    """Old snapshots without cells: every entry shows its summary; the time is shown in one form."""
    parts = _snapshots(spark, sf_dir, _events(spark, sf_dir))
    t, snap = parts[0]
    old = snap.withColumn("cells", F.when(F.col("row_id") % 2 == 0, F.col("cells")).otherwise(F.array().cast("array<string>")))
    t = _master(spark, sf_dir, [(t, old)])
    return t.df.select("row_id", "time", F.regexp_replace("summary", "^[^|]*[|] ", "").alias("summary"), F.col(M.titled(t)["Event"]).alias("Event"))


R.add("m5_m6_time_and_summary", m5_m6_time_and_summary, f"SELECT event_id AS row_id, {_SHOWN.format(t='ts')} AS time, event_type || ' | ' || user_id AS summary, CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END AS \"Event\" FROM events WHERE event_type IN ('error', 'signup')")


def m7_master_as_timeline(spark, sf_dir):
    """Filters, sorts, tag counts and the palette work on the master as on any timeline."""
    t = _master(spark, sf_dir, _snapshots(spark, sf_dir, _events(spark, sf_dir), _orders(spark, sf_dir)))
    palette = extend_palette(base.palette(spark), _case_tags(spark, sf_dir))
    known = tag_counts(M.master_tags(t), palette).join(palette, F.col("tag") == F.col("name")).select("tag", "n", "color")
    rows = positions(t.df.where(has_tag("Bad")), order_by(t, [("Event", False), ("time", True), ("timeline", False)]))
    shown = rows.withColumn("tag", F.element_at("tags", 1)).join(known, "tag", "left")
    return shown.select("timeline", "row_id", F.col(M.titled(t)["Event"]).alias("Event"), "position", F.col("n").alias("n_tagged"), "color")


R.add(
    "m7_master_as_timeline",
    m7_master_as_timeline,
    f"""{_GRID_SQL} SELECT timeline, row_id, "Event", row_number() OVER (ORDER BY "Event" = '', TRY_CAST(trim("Event") AS DOUBLE) IS NULL, lower("Event"), lower(time) DESC, lower(timeline), timeline_id, row_id) - 1 AS position,
  count(*) OVER () AS n_tagged, '#E53935' AS color FROM grid WHERE tags = 'Bad' AND timeline_id < 3""",
)


def _shared(spark, sf_dir) -> list[Timeline]:
    """Two timelines whose rows have the same ids: documents and conversations by number, the second with headers that clash with those of the master and with each other."""
    docs = base.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), F.col("text").alias("body"), "lang", "source", F.col("n_chars").cast("string").alias("size"))
    turns = base.table(spark, sf_dir, "conversations").select(positions_of(F.col("conv_id"), F.col("turn")).alias("row_id"), "role", "text", F.lower("role").alias("small"), F.upper("role").alias("big"))
    bare = {"tags": F.array().cast("array<string>"), "comment": F.lit("")}
    return [
        Timeline(docs.withColumns(bare), ["body", "lang", "source", "size"], {"body": "Host", "lang": "host", "source": "Time", "size": "Size"}, None, [], 1, "documents"),
        Timeline(turns.withColumns(bare), ["role", "text", "small", "big"], {"role": "Summary", "text": "Host", "small": "host", "big": "Size"}, None, [], 2, "turns"),
    ]


def positions_of(conv, turn):
    """Row ids of conversation turns: 100 for each conversation."""
    return conv * 100 + turn


def _shared_tags(spark, sf_dir):
    docs = base.table(spark, sf_dir, "documents").where("doc_id % 3 = 0").select(F.lit(1).cast("long").alias("timeline_id"), F.col("doc_id").alias("row_id"), F.concat(F.lit("doc "), "lang").alias("tag"))
    turns = base.table(spark, sf_dir, "conversations").select(F.lit(2).cast("long").alias("timeline_id"), positions_of(F.col("conv_id"), F.col("turn")).alias("row_id"), F.concat(F.lit("turn "), "role").alias("tag"))
    return docs.unionByName(turns)


def _shared_master(spark, sf_dir, **more) -> Timeline:
    tags = _shared_tags(spark, sf_dir)
    parts = _shared(spark, sf_dir)
    return M.aligned([(t, M.snapshot(t, tags)) for t in parts], tags, base.doc_comments(spark, sf_dir, 1), _timelines(spark, *parts), **more)


_SHARED_SQL = """WITH docs AS (SELECT 1 AS timeline_id, 'documents' AS timeline, doc_id AS row_id, coalesce(text, '') AS "a", coalesce(lang, '') AS b, coalesce(source, '') AS c, CAST(n_chars AS VARCHAR) AS d, '' AS e,
  'doc ' || lang AS tags, CASE WHEN lang = 'de' THEN 'check ' || source ELSE '' END AS comment FROM documents WHERE doc_id % 3 = 0),
turns AS (SELECT 2 AS timeline_id, 'turns' AS timeline, conv_id * 100 + turn AS row_id, text AS a, lower(role) AS b, '' AS c, upper(role) AS d, role AS e, 'turn ' || role AS tags, '' AS comment FROM conversations),
grid AS (SELECT * FROM docs UNION ALL SELECT * FROM turns)"""


def m4_clashing_headers(spark, sf_dir):
    """Headers that differ in case only, and headers called Time and Summary, are columns of their own, before and behind the fixed ones."""
    t = _shared_master(spark, sf_dir)
    titles = [t.title(c) for c in t.columns]
    cells = {n: F.col(c) for n, c in zip("abcde", t.columns[2:], strict=True)}
    return t.df.select(F.lit(",".join(titles)).alias("titles"), "timeline_id", "row_id", F.md5(cells["a"]).alias("a"), *[cells[n].alias(n) for n in "bcde"], F.array_join("tags", ", ").alias("tags"), "comment")


R.add("m4_clashing_headers", m4_clashing_headers, f"{_SHARED_SQL} SELECT 'Time,Timeline,Host,host,Time,Size,Summary' AS titles, timeline_id, row_id, md5(a) AS a, b, c, d, e, tags, comment FROM grid")


def m7_h1_master_spans(spark, sf_dir):
    """Spans, hits and tags of master rows whose ids are those of other rows too: matches of a filter, joined where they touch, in the cells of two timelines."""
    t = _shared_master(spark, sf_dir)
    spec = FilterSpec(conditions=[Condition("Host", ["en", "n "]), Condition("Summary", ["ser"])], match_all=False)
    spans = highlights(t, spec).groupBy("timeline_id", "row_id", "column").agg(F.count(F.lit(1)).alias("n_spans"), F.sum("start").alias("starts"), F.sum("end").alias("ends"))
    return spans.select("timeline_id", "row_id", F.element_at(F.create_map(*[F.lit(x) for c in t.columns for x in (c, t.title(c))]), F.col("column")).alias("title"), "n_spans", "starts", "ends")


_ISLANDS_SQL = """, cells AS (SELECT timeline_id, row_id, 'Host' AS title, lower(a) AS cell, unnest(['en', 'n ']) AS v FROM grid UNION ALL SELECT timeline_id, row_id, 'Summary', lower(e), 'ser' FROM grid),
parts AS (SELECT *, string_split(cell, v) AS g FROM cells), pieces AS (SELECT timeline_id, row_id, title, v, unnest(g) AS p, generate_subscripts(g, 1) AS i, len(g) AS k FROM parts WHERE len(g) > 1),
found AS (SELECT timeline_id, row_id, title, i, k, sum(length(p) + length(v)) OVER (PARTITION BY timeline_id, row_id, title, v ORDER BY i) - length(v) AS s, length(v) AS w FROM pieces),
spans AS (SELECT *, s + w AS e FROM found WHERE i < k),
marked AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY timeline_id, row_id, title ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM spans),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY timeline_id, row_id, title ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM marked),
merged AS (SELECT timeline_id, row_id, title, min(s) AS s, max(e) AS e FROM islands GROUP BY timeline_id, row_id, title, island)"""
R.add(
    "m7_h1_master_spans",
    m7_h1_master_spans,
    f"{_SHARED_SQL}{_ISLANDS_SQL} SELECT timeline_id, row_id, title, count(*) AS n_spans, CAST(sum(s) AS BIGINT) AS starts, CAST(sum(e) AS BIGINT) AS ends FROM merged GROUP BY timeline_id, row_id, title",
)


def m7_i10_master_lists(spark, sf_dir):
    """Lists scan the master, and their tags and labels land on the rows that were hit, with their numbers in the master timeline."""
    t = _shared_master(spark, sf_dir, numbered=True)
    hits = I.scan(t, [I.Indicator("a", 1, "plain", "assistant", "helper"), I.Indicator("b", 1, "regex", "^src1[0-5]$", "teens")])
    rows = I.run_all(t, hits).join(t.df.select("timeline_id", "row_id", "position", "time"), ["timeline_id", "row_id"])
    return rows.select("timeline_id", "row_id", "position", "time", F.array_join("tags", ",").alias("tags"), "comment")


R.add(
    "m7_i10_master_lists",
    m7_i10_master_lists,
    f"""{_SHARED_SQL}, numbered AS (SELECT *, row_number() OVER (ORDER BY timeline, timeline_id, row_id) - 1 AS position FROM grid),
hits AS (SELECT *, contains(lower(concat_ws(chr(0), timeline, a, b, c, d, e)), 'assistant') AS one, regexp_matches(c, '^src1[0-5]$') AS two FROM numbered)
SELECT timeline_id, row_id, position, '' AS time, array_to_string(list_sort(list_filter([tags, CASE WHEN one THEN 'ioc:a' END, CASE WHEN two THEN 'ioc:b' END], lambda x: x IS NOT NULL)), ',') AS tags,
  CASE WHEN two THEN CASE WHEN one AND comment <> '' THEN 'teens; helper; ' || comment WHEN one THEN 'teens; helper' WHEN comment <> '' THEN 'teens; ' || comment ELSE 'teens' END
    WHEN comment <> '' THEN 'helper; ' || comment ELSE 'helper' END AS comment FROM hits WHERE one OR two""",
)


def m8_back_to_source(spark, sf_dir):
    events = _events(spark, sf_dir)
    parts = _snapshots(spark, sf_dir, events, _orders(spark, sf_dir))
    rows = parts[0][1].unionByName(parts[1][1]).where("contains(summary, 'error')")
    return M.back_to_source(rows, events).select("row_id", "event_type")


R.add("m8_back_to_source", m8_back_to_source, "SELECT event_id AS row_id, event_type FROM events WHERE event_type = 'error'")


def e1_e2_hide_and_rename(spark, sf_dir):
    t = E.rename(E.hide(base.docs(spark, sf_dir), "text", "lang"), {"source": "Origin", "n_chars": "  "})
    return E.view(t).select("Origin", "n_chars", "Tags")


R.add("e1_e2_hide_and_rename", e1_e2_hide_and_rename, f"{DOCS_SQL} SELECT source AS \"Origin\", n_chars, tag_text AS \"Tags\" FROM docs")


def e3_export_view(spark, sf_dir):
    """The view as CSV, written and read again: text with quotes, commas and line breaks survives."""
    t = base.docs(spark, sf_dir)
    folder = _folder(spark)
    E.write_csv(E.view(t, [("lang", False)]), folder)
    back = spark.read.options(header=True, multiLine=True, escape='"', emptyValue="").csv(folder).na.fill("")
    return back.select(F.md5("Summary").alias("text_md5"), "lang", "source", "n_chars", "Tags", "Comment")


R.add("e3_export_view", e3_export_view, f"{DOCS_SQL} SELECT md5(text) AS text_md5, lang, source, n_chars, tag_text AS \"Tags\", comment AS \"Comment\" FROM docs")


def e4_prelude(spark, sf_dir):
    t = E.hide(base.docs(spark, sf_dir), "text")
    return E.with_prelude(t, "saw it at 03:14")


R.add(
    "e4_prelude",
    e4_prelude,
    f"""{DOCS_SQL} SELECT row_id + 1 AS no, lang AS cell0, source AS cell1, n_chars AS cell2, tag_text AS cell3, comment AS cell4 FROM docs
UNION ALL SELECT 0, 'lang', 'source', 'n_chars', 'Tags', 'Comment' UNION ALL SELECT -1, 'Timeline comments:', 'saw it at 03:14', '', '', ''""",
)


def _read_lines(spark, folder):
    """The lines of a folder of text files in their order, numbered from 0."""
    lines = spark.read.text(folder).select("value", "_metadata.file_name", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at"))
    return positions(lines, [F.col(c) for c in ("file_name", "file_block_start", "at")]).select("position", "value")


def e3_e4_ordered_file(spark, sf_dir):
    """The file of a sorted view, line by line: the comment, one header with a title that repeats, the rows in order."""
    t = E.hide(base.docs(spark, sf_dir), "text")
    folder = _folder(spark)
    E.write_view(E.rename(t, {"source": "lang"}), folder, [("lang", True), ("n_chars", False)], 'seen at 03:14, "twice", there')
    return _read_lines(spark, folder)


R.add(
    "e3_e4_ordered_file",
    e3_e4_ordered_file,
    f"""{DOCS_SQL} SELECT 1 + row_number() OVER (ORDER BY lang = '' DESC, lower(lang) DESC, CAST(n_chars AS DOUBLE), row_id) AS position,
  lang || ',' || source || ',' || n_chars || ',' || CASE WHEN contains(tag_text, ',') THEN '"' || tag_text || '"' ELSE tag_text END || ',' || comment AS value FROM docs
UNION ALL SELECT 0, 'Timeline comments:,"seen at 03:14, ""twice"", there"' UNION ALL SELECT 1, 'lang,lang,n_chars,Tags,Comment'""",
)


def e7_annotated_file(spark, sf_dir):
    """A layout of the annotated rows as a file, sorted by length, longest first."""
    folder = _folder(spark)
    layout = [("When", ["n_chars"]), ("What", ["lang", "source"]), ("Comments", ["comment"]), ("Tag", ["tags"]), ("Notes", [])]
    E.write_view(base.docs(spark, sf_dir), folder, [("n_chars", True)], layout=layout, annotated_only=True)
    return _read_lines(spark, folder)


R.add(
    "e7_annotated_file",
    e7_annotated_file,
    f"""{DOCS_SQL} SELECT row_number() OVER (ORDER BY CAST(n_chars AS DOUBLE) DESC, row_id) AS position, n_chars || ',lang: ' || lang || '; source: ' || source || '; ,' || comment || ',' || CASE WHEN contains(tag_text, ',') THEN '"' || tag_text || '"' ELSE tag_text END || ',' AS value FROM docs WHERE len(tags) > 0 OR regexp_matches(comment, '\\S')
UNION ALL SELECT 0, 'When,What,Comments,Tag,Notes'""",
)


def e5_csv_dialect(spark, sf_dir):
    """The bytes of the export: commas, quotes only where a cell needs them, doubled inside, one line for each row."""
    t = base.bare_docs(spark, sf_dir)
    quoted = F.when(F.col("row_id") % 3 == 0, F.concat(F.lit('he said "'), "source", F.lit('", twice'))).when(F.col("row_id") % 3 == 1, F.concat("lang", F.lit(",x"))).otherwise(F.col("source"))
    folder = _folder(spark)
    E.write_csv(E.view(Timeline(t.df.withColumn("cell", quoted), ["n_chars", "cell", "lang"], {"cell": "A cell"})), folder)
    return spark.read.text(folder).groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("value <> 'n_chars,A cell,lang,Tags,Comment'")


R.add(
    "e5_csv_dialect",
    e5_csv_dialect,
    """SELECT n_chars || ',' || CASE doc_id % 3 WHEN 0 THEN '"he said ""' || source || '"", twice"' WHEN 1 THEN '"' || lang || ',x"' ELSE source END || ',' || lang || ',,' AS value, count(*) AS n FROM documents GROUP BY 1""",
)


def e6_to_timeline(spark, sf_dir):
    t = base.docs(spark, sf_dir)
    return E.to_timeline(t, [("When", ["n_chars"]), ("What", ["lang", "source"]), ("Comments", ["comment"]), ("Tag", ["tags"]), ("Notes", [])])


_LAYOUT_SQL = "row_id, n_chars AS \"When\", 'lang: ' || lang || '; source: ' || source || '; ' AS \"What\", comment AS \"Comments\", tag_text AS \"Tag\", '' AS \"Notes\""
R.add("e6_to_timeline", e6_to_timeline, f"{DOCS_SQL} SELECT {_LAYOUT_SQL} FROM docs")


def e7_annotated_only(spark, sf_dir):
    t = base.docs(spark, sf_dir)
    return E.to_timeline(t, [("When", ["n_chars"]), ("What", ["lang", "source"]), ("Comments", ["comment"]), ("Tag", ["tags"]), ("Notes", [])], annotated_only=True)


R.add("e7_annotated_only", e7_annotated_only, f"{DOCS_SQL} SELECT {_LAYOUT_SQL} FROM docs WHERE len(tags) > 0 OR comment <> ''")


def e8_default_layout(spark, sf_dir):
    t = base.spelled(spark, sf_dir)
    t = Timeline(t.df, ["user_id", "when_seen", "event_type"], {"when_seen": "Seen Date", "event_type": "Type", "user_id": "Message from"})
    return E.to_timeline(t, E.default_layout(t))


R.add("e8_default_layout", e8_default_layout, f"{base.SPELLED_SQL} SELECT row_id, when_seen AS \"Timestamp\", event_type AS \"Type/Field\", user_id AS \"Event\", '' AS \"Comments\", '' AS \"Tag\" FROM spelled")


def e9_reapply_layout(spark, sf_dir):
    t = _orders(spark, sf_dir)
    return E.to_timeline(t, E.reapply(t, [("What", ["EVENT", "Gone"]), ("Both", ["kind", "event"]), ("None", ["Host"])]))


R.add("e9_reapply_layout", e9_reapply_layout, "SELECT o_orderkey AS row_id, o_orderpriority AS \"What\", 'Kind: ' || o_orderstatus || '; Event: ' || o_orderpriority || '; ' AS \"Both\", '' AS \"None\" FROM orders")


def e10_s9_write_and_read_case(spark, sf_dir):
    """Annotations of three timelines are written, those of one replaced and those of another cleared, and all three read."""
    folder = _folder(spark)
    tags = _case_tags(spark, sf_dir)
    empty = spark.createDataFrame([], "timeline_id bigint, row_id bigint, col int, value string")
    N.write_case(folder, tags=tags, comments=_case_comments(spark, sf_dir), edits=empty, tag_defs=base.palette(spark))
    N.write_case(folder, tags=tags.where("timeline_id = 2").withColumn("tag", F.lit("Again")))
    N.write_case(folder, timelines=[3], tags=tags.limit(0))
    read = [N.read_case(spark, folder, i)["tags"].withColumn("timeline_id", F.lit(i)) for i in (1, 2, 3)]
    return read[0].unionByName(read[1]).unionByName(read[2]).select("timeline_id", "row_id", F.array_join("tags", ",").alias("tags"))


R.add("e10_s9_write_and_read_case", e10_s9_write_and_read_case, f"{_CASE_SQL} SELECT timeline_id, row_id, CASE timeline_id WHEN 2 THEN 'Again' ELSE tag END AS tags FROM tags")


def e11_s8_sidecar(spark, sf_dir):
    """Annotations of the documents as a JSON sidecar, written and read again."""
    folder = _folder(spark)
    N.write_sidecar(folder, tags=base.doc_tags(spark, sf_dir), comments=base.doc_comments(spark, sf_dir), edits=_edits(spark, sf_dir), tag_defs=base.palette(spark))
    read = N.read_sidecar(spark, folder)
    parts = [
        read["tags"].select("row_id", F.lit("tag").alias("kind"), F.col("tag").alias("value")),
        read["comments"].select("row_id", F.lit("comment").alias("kind"), F.col("comment").alias("value")),
        read["edits"].select("row_id", F.concat(F.lit("edit"), F.col("col").cast("string")).alias("kind"), "value"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


R.add(
    "e11_s8_sidecar",
    e11_s8_sidecar,
    f"""WITH {TAGS_SQL} SELECT row_id, 'tag' AS kind, tag AS value FROM tag_rows UNION ALL SELECT doc_id, 'comment', 'check ' || source FROM documents WHERE lang = 'de'
UNION ALL SELECT doc_id, 'edit1', 'xx' FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 'edit2', 'moved ' || doc_id FROM labels WHERE quality = 0""",
)


def s1_s3_read_delimited(spark, sf_dir):
    """Documents as semicolon-separated text in many files, written by Spark in the order of ids and read as a timeline: sniffed, headers left out, row ids dense, in file order."""
    folder = _folder(spark)
    docs = base.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    docs.repartitionByRange(8, "doc_id").sortWithinPartitions("doc_id").write.options(sep=";", header=True, quote='"', escape='"', emptyValue="").csv(folder)
    t = D.read_timeline(spark, folder)
    return t.df.select("row_id", F.col("c0").cast("long").alias("doc_id"), F.col("c1").alias("lang"), F.md5("c3").alias("text_md5"))


R.add("s1_s3_read_delimited", s1_s3_read_delimited, "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_id, doc_id, lang, md5(coalesce(text, '')) AS text_md5 FROM documents")


def s1_s3_messy_lines(spark, sf_dir):
    """One rule for all lines, whatever else a file holds: blank lines are rows, text behind a closing quote and stray quotes stay, records span lines; in many files that begin with their header."""
    folder = _folder(spark)
    docs = base.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("s"), F.replace(F.replace("text", F.lit("\r"), F.lit("")), F.lit('"'), F.lit("")).alias("text"))
    line = (
        F.when(F.col("doc_id") % 5 == 0, F.lit(""))
        .when(F.col("doc_id") % 5 == 1, F.format_string('%d,"%s"tail,x', "doc_id", "s"))
        .when(F.col("doc_id") % 5 == 2, F.format_string('%d,"%s",x', "doc_id", "text"))
        .when(F.col("doc_id") % 5 == 3, F.format_string('%d,%s"stray"",x', "doc_id", "s"))
        .otherwise(F.format_string('%d,"say ""%s"" or "" "" that"end""s,x', "doc_id", "s"))
    )
    ordered = docs.repartitionByRange(8, "doc_id").sortWithinPartitions("doc_id")
    head = F.when(F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0, "id,cell,last\n").otherwise("")
    ordered.select(F.concat(head, line).alias("value")).write.text(folder)
    t = D.read_timeline(spark, folder, ",")
    return t.df.select("row_id", F.col("c0").alias("id"), F.md5("c1").alias("cell_md5"), F.col("c2").alias("last"))


R.add(
    "s1_s3_messy_lines",
    s1_s3_messy_lines,
    """WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_id, coalesce(source, '') AS s, replace(replace(text, chr(13), ''), '"', '') AS text FROM documents)
SELECT row_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE CAST(doc_id AS VARCHAR) END AS id,
  md5(CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN s || 'tail' WHEN 2 THEN text WHEN 3 THEN s || '"stray""' ELSE 'say "' || s || '" or " " thatend""s' END) AS cell_md5, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'x' END AS last FROM d""",
)


def s2_sniff(spark, sf_dir):
    """Each delimiter found again in what Spark wrote with it: all events, in as many files as it likes, then read by it and counted."""
    events = base.table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "props")
    out = None
    for d in D.DELIMITERS:
        folder = _folder(spark)
        events.write.options(sep=d, header=True, quote='"', escape='"').csv(folder)
        rows = D.read_timeline(spark, folder).df.select(F.lit(d).alias("written"), F.lit(D.sniff(spark, folder)).alias("found"), F.col("c1").alias("event_type"))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("written", "found", "event_type").agg(F.count(F.lit(1)).alias("n"))


R.add("s2_sniff", s2_sniff, "SELECT written, written AS found, event_type, count(*) AS n FROM events, (VALUES (','), (chr(9)), (';'), ('|')) v(written) GROUP BY ALL")


def s3_dense_row_ids(spark, sf_dir):
    """Dense positions in the order of a key."""
    return positions(base.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")], "row_id").groupBy((F.col("row_id") % 100).alias("k")).agg(F.sum(F.col("l_partkey") * (F.col("row_id") % 1009)).alias("s"))


R.add("s3_dense_row_ids", s3_dense_row_ids, "WITH r AS (SELECT l_partkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS row_id FROM lineitem) SELECT row_id % 100 AS k, CAST(sum(l_partkey * (row_id % 1009)) AS BIGINT) AS s FROM r GROUP BY 1")


def s4_in_memory(spark, sf_dir):
    """A small table from Python lists, joined with all events."""
    t = D.in_memory(spark, ["Name", "Note"], [["error", "a"], ["signup"], ["click", "e", "overflow"]])
    return base.table(spark, sf_dir, "events").join(t.df, F.col("c0") == F.col("event_type")).select("event_id", "row_id", F.col("c1").alias("note"))


R.add("s4_in_memory", s4_in_memory, "SELECT event_id, i AS row_id, note FROM events JOIN (VALUES (CAST(0 AS BIGINT), 'error', 'a'), (1, 'signup', ''), (2, 'click', 'e')) v(i, n, note) ON n = event_type")


def s5_s6_ranges_and_rows(spark, sf_dir):
    t = base.docs(spark, sf_dir)
    return D.rows_between(t, 100, 200).unionByName(D.row_number(t, 8)).select("row_id", "lang")


R.add("s5_s6_ranges_and_rows", s5_s6_ranges_and_rows, "SELECT doc_id AS row_id, lang FROM documents WHERE doc_id BETWEEN 100 AND 199 OR doc_id = 7")


def s7_register_timelines(spark, sf_dir):
    """Events and orders as one data set: rows and cells of each registered timeline."""
    parts = [_events(spark, sf_dir), _orders(spark, sf_dir)]
    rows = D.long_form([(t.timeline_id, t.df, t.columns) for t in parts])
    counts = rows.groupBy("timeline_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.size("cells")).alias("n_cells"))
    return counts.join(_timelines(spark, *parts), "timeline_id").select("name", "source", F.array_join("display_headers", ",").alias("headers"), "time_col", "n_rows", "n_cells")


R.add("s7_register_timelines", s7_register_timelines, "SELECT 'events' AS name, 'events.csv' AS source, 'ts,Event,User' AS headers, CAST(0 AS INTEGER) AS time_col, count(*) AS n_rows, 3 * count(*) AS n_cells FROM events UNION ALL SELECT 'orders', 'orders.csv', 'o_orderdate,Kind,Event', 0, count(*), 3 * count(*) FROM orders")
