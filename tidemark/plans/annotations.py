"""Queries O1 to O13, A1 to A5 and H1, H2: overlay, summaries, match spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates as P
from ..model import DEFAULT_COLOR, PALETTE
from ..operators import overlay as O
from ..operators import profile as A
from . import base
from .base import DOCS_SQL, TAGS_SQL, Registry

R = Registry()
_T = f"WITH {TAGS_SQL}"
_PALETTE_SQL = "palette(name, color, priority) AS (VALUES " + ", ".join(f"('{n}', '{c}', {i})" for i, (n, c) in enumerate(PALETTE)) + ")"


def o1_attach_tags(spark, sf_dir):
    t = O.attach_tags(base.bare_docs(spark, sf_dir), base.doc_tags(spark, sf_dir))
    return t.df.select("row_id", F.array_join("tags", ", ").alias("tags"))


R.add("o1_attach_tags", o1_attach_tags, f"{DOCS_SQL} SELECT row_id, tag_text AS tags FROM docs")


def o2_attach_comments(spark, sf_dir):
    return O.attach_comments(base.bare_docs(spark, sf_dir), base.doc_comments(spark, sf_dir)).df.select("row_id", "comment")


R.add("o2_attach_comments", o2_attach_comments, f"{DOCS_SQL} SELECT row_id, comment FROM docs")


def _edits(spark, sf_dir):
    """Edits of two columns, from the labels."""
    labels = base.table(spark, sf_dir, "labels")
    one = labels.where("toxic = 1").select("doc_id", F.lit(1).alias("col"), F.lit("xx").alias("value"))
    two = labels.where("quality = 0").select("doc_id", F.lit(2).alias("col"), F.concat(F.lit("moved "), F.col("doc_id").cast("string")).alias("value"))
    return one.unionByName(two).select(F.lit(0).cast("long").alias("timeline_id"), F.col("doc_id").alias("row_id"), "col", "value")


_EDITED_SQL = "CASE WHEN toxic = 1 THEN 'xx' ELSE lang END AS lang, CASE WHEN quality = 0 THEN 'moved ' || doc_id ELSE source END AS source"


def o3_apply_edits(spark, sf_dir):
    return O.apply_edits(base.bare_docs(spark, sf_dir), _edits(spark, sf_dir)).df.select("row_id", "lang", "source")


R.add("o3_apply_edits", o3_apply_edits, f"SELECT documents.doc_id AS row_id, {_EDITED_SQL.replace('doc_id', 'documents.doc_id')} FROM documents LEFT JOIN labels ON labels.doc_id = documents.doc_id")


def o4_edit_snapshot_cells(spark, sf_dir):
    """A snapshot of two cells with an edit of the third or the fifth: padded up to it."""
    docs = base.table(spark, sf_dir, "documents").select("doc_id", F.array("lang", "source").alias("cells"))
    column = F.when(F.col("doc_id") % 2 == 0, 2).otherwise(4)
    edited = O.edit_cells(F.col("cells"), F.create_map(column, F.lit("new")))
    return docs.select(F.col("doc_id").alias("row_id"), F.array_join(edited, "|").alias("cells"))


R.add("o4_edit_snapshot_cells", o4_edit_snapshot_cells, "SELECT doc_id AS row_id, lang || '|' || source || CASE WHEN doc_id % 2 = 0 THEN '|new' ELSE '|||new' END AS cells FROM documents")


def o5_highlights(spark, sf_dir):
    """Good has no colour of its own here."""
    colors = base.palette(spark).withColumn("color", F.when(F.col("name") == "Good", "none").otherwise(F.col("color")))
    return O.highlights(base.doc_tags(spark, sf_dir), colors).select("row_id", "color")


R.add("o5_highlights", o5_highlights, f"{_T}, {_PALETTE_SQL} SELECT row_id, nullif(CASE min(priority) WHEN 0 THEN '#E53935' WHEN 1 THEN '#FDD835' ELSE 'none' END, 'none') AS color FROM tag_rows JOIN palette ON tag = name GROUP BY row_id")


def o6_delete_tag(spark, sf_dir):
    tags = O.delete_tag(base.doc_tags(spark, sf_dir), "Good")
    snapshot = base.doc_tags(spark, sf_dir).select("timeline_id", "row_id").distinct()
    return O.still_tagged(snapshot, tags).select("row_id")


R.add("o6_delete_tag", o6_delete_tag, f"{_T} SELECT DISTINCT row_id FROM tag_rows WHERE tag <> 'Good'")


def o7_remove_timeline(spark, sf_dir):
    """Three timelines' worth of tags without the second."""
    tags = base.doc_tags(spark, sf_dir).unionByName(base.doc_tags(spark, sf_dir, 1)).unionByName(base.doc_tags(spark, sf_dir, 2))
    gone = base.table(spark, sf_dir, "region").where("r_regionkey = 1").select(F.col("r_regionkey").cast("long").alias("timeline_id"))
    return O.remove_timeline(tags, gone).groupBy("timeline_id").agg(F.count(F.lit(1)).alias("n"))


R.add("o7_remove_timeline", o7_remove_timeline, f"{_T} SELECT CAST(i AS BIGINT) AS timeline_id, count(*) AS n FROM tag_rows, (VALUES (0), (2)) v(i) GROUP BY i")


def o8_rename_tag(spark, sf_dir):
    tags, defs = O.rename_tag(base.doc_tags(spark, sf_dir), base.palette(spark), "Good", "Benign")
    return tags.join(defs, F.col("tag") == F.col("name"), "left").select("row_id", "tag", "color", "priority")


R.add("o8_rename_tag", o8_rename_tag, f"{_T}, {_PALETTE_SQL} SELECT row_id, CASE tag WHEN 'Good' THEN 'Benign' ELSE tag END AS tag, color, priority FROM tag_rows LEFT JOIN palette ON tag = name")


def o9_bulk_tags(spark, sf_dir):
    """Every German document gets ``Seen`` (twice), toxic ones lose ``Bad``; the palette learns the new tag."""
    tags, rows = base.doc_tags(spark, sf_dir), base.doc_comments(spark, sf_dir)
    toxic = base.table(spark, sf_dir, "labels").where("toxic = 1").select(F.lit(0).cast("long").alias("timeline_id"), F.col("doc_id").alias("row_id"))
    tags = O.remove_tag(O.add_tag(O.add_tag(tags, rows, "Seen"), rows, "Seen"), toxic, "Bad")
    defs = O.extend_palette(base.palette(spark), tags)
    return tags.join(defs, F.col("tag") == F.col("name"), "left").select("row_id", "tag", "color", "priority")


R.add(
    "o9_bulk_tags",
    o9_bulk_tags,
    f"""{_T}, {_PALETTE_SQL}, p AS (SELECT * FROM palette UNION ALL SELECT 'Seen', '{DEFAULT_COLOR}', 3), u AS (
  SELECT row_id, tag FROM tag_rows WHERE tag <> 'Bad' UNION SELECT doc_id, 'Seen' FROM documents WHERE lang = 'de'
) SELECT row_id, tag, color, priority FROM u JOIN p ON tag = name""",
)


def o10_set_values(spark, sf_dir):
    """Comments of toxic documents are set, those of documents from src3 cleared."""
    comments = base.doc_comments(spark, sf_dir)
    new = base.table(spark, sf_dir, "labels").where("toxic = 1").select(F.lit(0).cast("long").alias("timeline_id"), F.col("doc_id").alias("row_id"), F.lit("toxic").alias("comment"))
    clear = base.table(spark, sf_dir, "documents").where("source = 'src3'").select(F.lit(0).cast("long").alias("timeline_id"), F.col("doc_id").alias("row_id"), F.lit("").alias("comment"))
    return O.set_values(O.set_values(comments, new, O.KEY, "comment"), clear, O.KEY, "comment").select("row_id", "comment")


R.add(
    "o10_set_values",
    o10_set_values,
    "SELECT d.doc_id AS row_id, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'check ' || source END AS comment FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE source <> 'src3' AND (toxic = 1 OR lang = 'de')",
)


def _annotated(spark, sf_dir):
    t = base.bare_docs(spark, sf_dir)
    df = t.df.drop("tags", "comment").withColumn("Tags", F.concat(F.lit(" b; "), "lang", F.lit(", -,, a ;"), "lang")).withColumn("Note", F.concat(F.lit("  from "), "source", F.lit(" ")))
    return O.adopt(type(t)(df, [*t.columns, "Tags", "Note"], {"text": "Summary"}))


def o11_adopt_columns(spark, sf_dir):
    return _annotated(spark, sf_dir).df.select("row_id", F.array_join("tags", ",").alias("tags"), "comment")


R.add("o11_adopt_columns", o11_adopt_columns, "SELECT doc_id AS row_id, 'a,b,' || lang AS tags, 'from ' || source AS comment FROM documents")


def o12_adopted_leave_data(spark, sf_dir):
    from ..sources.exports import view

    shown = view(_annotated(spark, sf_dir)).drop("Summary")
    return shown.select("lang", "source", "n_chars", "Tags", "Comment")


R.add("o12_adopted_leave_data", o12_adopted_leave_data, "SELECT lang, source, CAST(n_chars AS VARCHAR) AS n_chars, 'a, b, ' || lang AS \"Tags\", 'from ' || source AS \"Comment\" FROM documents")


def o13_merge_palettes(spark, sf_dir):
    """The palette with one that has a colour for Good and for every market segment."""
    segments = base.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name")).union(spark.createDataFrame([("Good",)], "name string")).distinct()
    new = segments.select("name", F.concat(F.lit("#"), F.substring(F.md5("name"), 1, 6)).alias("color"), F.dense_rank().over(O.W.orderBy("name")).alias("priority"))
    return O.merge_palettes(base.palette(spark), new)


R.add(
    "o13_merge_palettes",
    o13_merge_palettes,
    f"""WITH {_PALETTE_SQL}, n AS (SELECT DISTINCT c_mktsegment AS name FROM customer UNION SELECT 'Good'), b AS (SELECT name, '#' || substr(md5(name), 1, 6) AS color FROM n)
SELECT coalesce(p.name, b.name) AS name, coalesce(b.color, p.color) AS color, CAST(row_number() OVER (ORDER BY p.priority NULLS LAST, b.name) - 1 AS INTEGER) AS priority FROM palette p FULL JOIN b ON b.name = p.name""",
)


def a1_row_counts(spark, sf_dir):
    t = base.docs(spark, sf_dir)
    return t.df.agg(F.count(F.lit(1)).alias("n_file"), F.count_if(P.tagged()).alias("n_view"))


R.add("a1_row_counts", a1_row_counts, f"{DOCS_SQL} SELECT count(*) AS n_file, count(*) FILTER (len(tags) > 0) AS n_view FROM docs")


def a2_tag_counts(spark, sf_dir):
    more = spark.createDataFrame([("Unused", "#000000", 3)], "name string, color string, priority int")
    return A.tag_counts(base.doc_tags(spark, sf_dir), base.palette(spark).unionByName(more))


R.add("a2_tag_counts", a2_tag_counts, f"{_T} SELECT tag, count(*) AS n FROM tag_rows GROUP BY tag UNION ALL SELECT 'Unused', 0")


def a3_distinct_values(spark, sf_dir):
    """Sizes of documents: more different ones than the limit at larger scales."""
    return A.distinct_values(base.docs(spark, sf_dir), "n_chars")


R.add(
    "a3_distinct_values",
    a3_distinct_values,
    f"""{DOCS_SQL}, f AS (SELECT n_chars AS value, min(row_id) AS first FROM docs GROUP BY 1), n AS (SELECT *, row_number() OVER (ORDER BY first) AS k, count(*) OVER () AS total FROM f)
SELECT value, total > {A.DISTINCT_LIMIT} AS truncated FROM n WHERE k <= {A.DISTINCT_LIMIT}""",
)


def a3_first_values_of_view(spark, sf_dir):
    """The first 40 sizes in a filtered view by language, backwards, then size: the order decides which they are."""
    t = P.FilterSpec(pick={"source": ["src1", "src2", "src3", "src4"]}).apply(base.docs(spark, sf_dir))
    return A.distinct_values(t, "n_chars", 40, [("lang", True), ("n_chars", False)])


R.add(
    "a3_first_values_of_view",
    a3_first_values_of_view,
    f"""{DOCS_SQL}, v AS (SELECT n_chars AS value, row_number() OVER (ORDER BY lang = '' DESC, lower(lang) DESC, CAST(n_chars AS DOUBLE), row_id) AS pos FROM docs WHERE lower(source) IN ('src1', 'src2', 'src3', 'src4')),
f AS (SELECT value, min(pos) AS pos FROM v GROUP BY value), n AS (SELECT value, row_number() OVER (ORDER BY pos) AS k, count(*) OVER () AS total FROM f) SELECT value, total > 40 AS truncated FROM n WHERE k <= 40""",
)


def a3_few_values_of_view(spark, sf_dir):
    """Fewer values than the limit, though far apart in the view: all rows are counted."""
    return A.distinct_values(base.docs(spark, sf_dir), "lang", 50, [("lang", True)]).unionByName(A.distinct_values(base.docs(spark, sf_dir), "lang", 2, [("lang", True)]))


R.add(
    "a3_few_values_of_view",
    a3_few_values_of_view,
    f"""{DOCS_SQL}, f AS (SELECT lang AS value, row_number() OVER (ORDER BY lang = '' DESC, lower(lang) DESC) AS k, count(*) OVER () AS total FROM (SELECT DISTINCT lang FROM docs))
SELECT value, total > 50 AS truncated FROM f WHERE k <= 50 UNION ALL SELECT value, total > 2 FROM f WHERE k <= 2""",
)


def a4_search_values(spark, sf_dir):
    return A.search_values(A.distinct_values(base.docs(spark, sf_dir), "comment"), "K S").unionByName(A.search_values(A.distinct_values(base.docs(spark, sf_dir), "comment"), "blank"))


R.add("a4_search_values", a4_search_values, f"{DOCS_SQL}, v AS (SELECT DISTINCT CASE WHEN regexp_matches(comment, '\\S') THEN comment ELSE '(blank)' END AS value FROM docs) SELECT value FROM v WHERE contains(lower(value), 'k s') OR contains(value, 'blank')")


def h1_match_spans(spark, sf_dir):
    return A.spans(base.bare_docs(spark, sf_dir), [("Summary", "Token"), ("lang", "e"), ("any", "src1")])


_SPANS_SQL = """SELECT row_id, '{c}' AS "column", CAST(s AS INTEGER) AS start, CAST(s + {n} AS INTEGER) AS "end" FROM (
  SELECT row_id, sum(length(p) + {n}) OVER (PARTITION BY row_id ORDER BY i) - {n} AS s, i, k FROM (
    SELECT row_id, unnest(g) AS p, unnest(generate_series(1, len(g))) AS i, len(g) AS k FROM (SELECT row_id, string_split(lower({c}), '{v}') AS g FROM docs))) WHERE i < k"""
R.add(
    "h1_match_spans",
    h1_match_spans,
    f"{DOCS_SQL} " + " UNION ALL ".join(_SPANS_SQL.format(c=c, v=v, n=len(v)) for c, v in [("text", "token"), ("lang", "e"), ("text", "src1"), ("lang", "src1"), ("source", "src1"), ("n_chars", "src1")]),
)


def h1_regex_spans(spark, sf_dir):
    return A.regex_spans(base.bare_docs(spark, sf_dir).df, "row_id", "text", r"[0-9a-f]{40}")


R.add(
    "h1_regex_spans",
    h1_regex_spans,
    r"""WITH m AS (
  SELECT doc_id AS row_id, unnest(regexp_split_to_array(text, '(?i)[0-9a-f]{40}')) AS p, unnest(generate_series(1, len(regexp_split_to_array(text, '(?i)[0-9a-f]{40}')))) AS i,
         len(regexp_split_to_array(text, '(?i)[0-9a-f]{40}')) AS k FROM documents
) SELECT row_id, CAST(s AS INTEGER) AS start, CAST(s + 40 AS INTEGER) AS "end" FROM (SELECT row_id, i, k, sum(length(p) + 40) OVER (PARTITION BY row_id ORDER BY i) - 40 AS s FROM m) WHERE i < k""",
)


def h1_filter_spans(spark, sf_dir):
    """What a filter looks for, and nothing of what it excludes: an odd number of negations hides a term, an even one does not."""
    t = base.docs(spark, sf_dir)
    hidden = P.Tree("not", (P.Condition("Summary", ["und"]), P.Condition("lang", ["e"], exclude=True)))
    spec = P.FilterSpec(where=P.Tree("and", (P.Condition("Summary", ["Token"]), hidden)), conditions=[P.Condition("any", ["the"], exclude=True)], quick={"source": "src1", "comment": "*"})
    return A.highlights(t, spec)


_H1 = " UNION ALL ".join(_SPANS_SQL.format(c=c, v=v, n=len(v)) for c, v in [("text", "token"), ("lang", "e"), ("source", "src1")])
R.add("h1_filter_spans", h1_filter_spans, f"{DOCS_SQL} {_H1}")


def h2_merge_spans(spark, sf_dir):
    """Spans of overlapping needles in a column, joined; the overlay is not looked at, so no text is shuffled to meet it."""
    found = A.spans(base.bare_docs(spark, sf_dir), [("Summary", "the"), ("Summary", "he"), ("Summary", "er")], joined=True)
    return found.groupBy("row_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("width"))


_H2 = " UNION ALL ".join(_SPANS_SQL.format(c="text", v=v, n=len(v)) for v in ("the", "he", "er"))
R.add(
    "h2_merge_spans",
    h2_merge_spans,
    f"""{DOCS_SQL}, f AS ({_H2}), n AS (
  SELECT row_id, start, "end", CASE WHEN start <= max("end") OVER (PARTITION BY row_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM f
), i AS (SELECT *, sum(new) OVER (PARTITION BY row_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM n), g AS (SELECT row_id, island, max("end") - min(start) AS w FROM i GROUP BY ALL)
SELECT row_id, count(*) AS n, CAST(sum(w) AS BIGINT) AS width FROM g GROUP BY row_id""",
)
