"""Queries F1 to F26: predicates and filter specs over the documents."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.ordering import order_by, page
from ..functions.views import SavedView
from ..operators.overlay import adopt, apply_edits
from . import base
from .base import DOCS_SQL, Registry

R = Registry()
_C = P.Condition

R.docs_filter("f1_substring", lambda t: P.on(t, "text", lambda c: P.contains(c, "The")), "contains(lower(text), 'the')")
R.docs_filter("f2_substring_cased", lambda t: P.on(t, "text", lambda c: P.contains(c, "The", cased=True)), "contains(text, 'The')")
R.docs_filter("f3_regex", lambda t: P.on(t, "text", lambda c: P.matches(c, r"[a-z]+\.[0-9]+@MAIL[0-9]")), r"regexp_matches(text, '(?i)[a-z]+\.[0-9]+@MAIL[0-9]')")
R.docs_filter("f4_pick_values", lambda t: P.on(t, "lang", lambda c: P.one_of(c, ["EN", "de"])) & P.on(t, "source", lambda c: P.one_of(c, ["src1", "src2", "src3"], cased=True)), "lower(lang) IN ('en', 'de') AND source IN ('src1', 'src2', 'src3')")
R.docs_filter("f5_star_not_empty", lambda t: P.quick(t, "comment", "*"), r"regexp_matches(comment, '\S')")
R.docs_filter("f6_empty", lambda t: P.on(t, "comment", P.blank) & P.on(t, "text", P.filled), r"NOT regexp_matches(comment, '\S') AND regexp_matches(text, '\S')")
R.docs_filter("f7_any_column", lambda t: P.on(t, "any", lambda c: P.contains(c, "src1")), "contains(lower(text), 'src1') OR contains(lower(lang), 'src1') OR contains(lower(source), 'src1') OR contains(n_chars, 'src1') OR contains(lower(tag_text), 'src1') OR contains(lower(comment), 'src1')")
R.docs_filter("f8_any_data_column", lambda t: P.on(t, "data", lambda c: P.contains(c, "check")) | P.on(t, "data", lambda c: P.contains(c, "Src1")), "contains(lower(text), 'check') OR contains(lower(lang), 'check') OR contains(lower(source), 'check') OR contains(n_chars, 'check') OR contains(lower(text), 'src1') OR contains(lower(source), 'src1')")
R.docs_filter("f9_field_equals_differs", lambda t: P.field_equals(t, "Summary", "token") & P.field_differs(t, "LANG", "fr"), "contains(lower(text), 'token') AND NOT contains(lower(lang), 'fr')")
R.docs_filter("f10_virtual_fields", lambda t: P.field_equals(t, "tag", "suspic") | P.field_equals(t, "comments", "src7") | P.field_equals(t, "row", "99"), "contains(lower(tag_text), 'suspic') OR contains(lower(comment), 'src7') OR contains(CAST(row_id + 1 AS VARCHAR), '99')")
R.docs_filter("f11_and_or_not", lambda t: P.field_equals(t, "lang", "en") & (P.field_equals(t, "tag", "bad") | P.field_equals(t, "tag", "good")) & P.field_differs(t, "Summary", "token"), "contains(lower(lang), 'en') AND (contains(lower(tag_text), 'bad') OR contains(lower(tag_text), 'good')) AND NOT contains(lower(text), 'token')")
R.docs_filter("f12_any_of_values", lambda t: _C("Summary", ["password", " ", "token"]).to_column(t), "contains(lower(text), 'password') OR contains(lower(text), 'token')")
R.docs_filter("f13_all_of_values", lambda t: _C("Summary", ["the", "[0-9]{3}"], every=True, regex=True).to_column(t), "contains(lower(text), 'the') AND regexp_matches(text, '[0-9]{3}')")
R.docs_filter("f14_excluded", lambda t: _C("Summary", ["the", "und"], exclude=True).to_column(t), "NOT (contains(lower(text), 'the') OR contains(lower(text), 'und'))")
R.docs_filter("f15_conditions_any", lambda t: P.FilterSpec(conditions=[_C("lang", ["fr"]), _C("any", ["license"]), _C("source", ["  "])], match_all=False).to_column(t), "contains(lower(lang), 'fr') OR contains(lower(text), 'license') OR contains(lower(lang), 'license') OR contains(lower(source), 'license') OR contains(lower(comment), 'license') OR contains(lower(tag_text), 'license')")
R.docs_filter("f16_quick_filters", lambda t: P.FilterSpec(quick={"lang": "d", "comment": "*", "tags": "o"}).to_column(t), r"contains(lower(lang), 'd') AND regexp_matches(comment, '\S') AND contains(lower(tag_text), 'o')")
R.docs_filter("f17_query_on_column", lambda t: P.FilterSpec(query="^src1[0-9]$", query_on="source", query_regex=True).to_column(t), "regexp_matches(source, '(?i)^src1[0-9]$')")
R.docs_filter("f18_tagged_only", lambda t: P.tagged(), "len(tags) > 0")
R.docs_filter("f19_has_exact_tag", lambda t: P.has_tag("Bad"), "list_contains(tags, 'Bad')")
R.docs_filter("f20_has_any_tag", lambda t: P.has_any_tag(["Bad", "Suspicious"]), "list_has_any(tags, ['Bad', 'Suspicious'])")
_SPEC = P.FilterSpec(any_tags=["Bad", "Good"], query="the", conditions=[_C("Summary", ["of", "and"]), _C("lang", ["es"], exclude=True)], quick={"source": "src1"}, pick={"lang": ["en", "de"]})
_SPEC_SQL = "list_has_any(tags, ['Bad', 'Good']) AND (contains(lower(text), 'the') OR contains(lower(lang), 'the') OR contains(lower(source), 'the') OR contains(lower(tag_text), 'the') OR contains(lower(comment), 'the')) AND (contains(lower(text), 'of') OR contains(lower(text), 'and')) AND NOT contains(lower(lang), 'es') AND contains(lower(source), 'src1') AND lower(lang) IN ('en', 'de')"
R.docs_filter("f21_filter_spec", lambda t: _SPEC.to_column(t), _SPEC_SQL)
R.docs_filter("f22_field_resolution", lambda t: P.field_equals(t, "sUmMaRy", "token") | P.field_equals(t, "Line", "123") | P.field_equals(t, "*", "src19"), "contains(lower(text), 'token') OR contains(CAST(row_id + 1 AS VARCHAR), '123') OR contains(lower(text), 'src19') OR contains(lower(source), 'src19') OR contains(lower(comment), 'src19')")
R.docs_filter("f26_filter_to_note", lambda t: P.on(t, "any", lambda c: P.contains(c, "Apache License, Version 2.0")), "contains(lower(text), 'apache license, version 2.0')")


def f23_filters_see_edits(spark, sf_dir):
    """Languages of toxic documents are edited to ``xx``; the filter looks for that."""
    labels = base.table(spark, sf_dir, "labels").where("toxic = 1")
    edits = labels.select(F.lit(0).cast("long").alias("timeline_id"), F.col("doc_id").alias("row_id"), F.lit(1).alias("col"), F.lit("xx").alias("value"))
    t = apply_edits(base.docs(spark, sf_dir), edits)
    return t.df.where(P.contains("lang", "XX")).select("row_id", "lang")


R.add("f23_filters_see_edits", f23_filters_see_edits, "SELECT doc_id AS row_id, 'xx' AS lang FROM labels JOIN documents USING (doc_id) WHERE toxic = 1")


def f24_find_next(spark, sf_dir):
    t = base.docs(spark, sf_dir)
    return P.find_next(t, "good", 100).df.select("row_id")


R.add("f24_find_next", f24_find_next, f"{DOCS_SQL} SELECT row_id FROM docs WHERE row_id > 100 AND (contains(lower(array_to_string(tags, ' ')), 'good') OR contains(lower(text), 'good') OR contains(lower(comment), 'good')) ORDER BY row_id LIMIT 1")


def f24_find_next_sorted(spark, sf_dir):
    """The row that follows in a filtered view sorted by length, longest first, then by source."""
    t = P.FilterSpec(pick={"lang": ["en", "de"]}).apply(base.docs(spark, sf_dir))
    at = t.df.where("source = 'src3'").agg(F.min("row_id")).first()[0]
    return P.find_next(t, "good", at, [("n_chars", True), ("source", False)]).df.select("row_id")


R.add(
    "f24_find_next_sorted",
    f24_find_next_sorted,
    f"""{DOCS_SQL}, v AS (SELECT *, row_number() OVER (ORDER BY CAST(n_chars AS DOUBLE) DESC, lower(source), row_id) AS pos FROM docs WHERE lang IN ('en', 'de')), cur AS (SELECT pos AS p FROM v WHERE row_id = (SELECT min(row_id) FROM v WHERE source = 'src3'))
SELECT row_id FROM v, cur WHERE pos > p AND (contains(lower(array_to_string(tags, ' ')), 'good') OR contains(lower(text), 'good') OR contains(lower(comment), 'good')) ORDER BY pos LIMIT 1""",
)

_SAVED = json.dumps({"conditions": [{"target": "lang", "values": ["en"]}, {"target": "Host", "values": ["x"]}], "quick": {"Summary": "token", "Gone": "y"}, "pick": {"source": ["src1", "SRC2", "src3", "src11"]}})


def f25_saved_view(spark, sf_dir):
    t = base.docs(spark, sf_dir)
    kept = SavedView.from_json(_SAVED, t).spec.apply(t)
    return kept.df.orderBy(*order_by(kept, [("n_chars", True)])).select("row_id")


R.add("f25_saved_view", f25_saved_view, f"{DOCS_SQL} SELECT row_id FROM docs WHERE contains(lower(lang), 'en') AND contains(lower(text), 'token') AND lower(source) IN ('src1', 'src2', 'src3', 'src11')")


#: A view as it is saved for an application: a filter, filters by title, tags and a sort.
_REFERENCE_VIEW = json.dumps({"name": "long ones", "query": "the", "cased": False, "tagged_only": True, "sort_column": "n_chars", "sort_desc": True, "col_filters": {"lang": "e", "Gone": "x"}, "tags": ["Good", "Suspicious"]})


def f25_saved_sort(spark, sf_dir):
    """Positions 5 to 25 of a saved view: its sort decides which rows they are."""
    t = base.docs(spark, sf_dir)
    saved = SavedView.from_json(_REFERENCE_VIEW, t)
    return page(saved.spec.apply(t), list(saved.sort), 5, 25).select("row_id")


R.add(
    "f25_saved_sort",
    f25_saved_sort,
    f"{DOCS_SQL} SELECT row_id FROM docs WHERE len(tags) > 0 AND list_has_any(tags, ['Good', 'Suspicious']) AND contains(lower(lang), 'e') AND (contains(lower(text), 'the') OR contains(lower(lang), 'the') OR contains(lower(source), 'the') OR contains(lower(tag_text), 'the') OR contains(lower(comment), 'the')) ORDER BY CAST(n_chars AS DOUBLE) DESC, row_id LIMIT 20 OFFSET 5",
)


def f25_saved_tree(spark, sf_dir):
    """A view with a tree, times and two sort keys, saved for the events and read again for them; what another timeline lacks is dropped."""
    t = base.events(spark, sf_dir)
    tree = P.Tree("and", (P.When("ts", "between", "2024-01-03", "2024-01-20"), P.Tree("not", (P.Tree("or", (_C("event_type", ["error"]), _C("user_id", ["^1"], regex=True))),))))
    view = SavedView("tree", P.FilterSpec(where=tree, quick={"props": "k"}), (("event_type", False), ("user_id", True)))
    again = SavedView.from_json(view.to_json(t), t)
    return page(again.spec.apply(t), list(again.sort), 0, 50).select("row_id")


R.add(
    "f25_saved_tree",
    f25_saved_tree,
    "SELECT event_id AS row_id FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-21' AND NOT (contains(lower(event_type), 'error') OR regexp_matches(CAST(user_id AS VARCHAR), '^1')) AND contains(lower(props), 'k') ORDER BY lower(event_type), CAST(user_id AS DOUBLE) DESC, event_id LIMIT 50",
)


def f8_adopted_left_out(spark, sf_dir):
    """Adopted annotation columns do not count as data."""
    t = base.bare_docs(spark, sf_dir)
    df = t.df.drop("tags", "comment").withColumn("Tags", F.concat_ws(";", "lang", "source")).withColumn("Note", F.concat(F.lit(" via "), "source"))
    adopted = adopt(type(t)(df, [*t.columns, "Tags", "Note"]))
    return adopted.df.where(~P.on(adopted, "data", lambda c: P.contains(c, "via")) & P.has_tag("src5")).select("row_id", "comment")


R.add("f8_adopted_left_out", f8_adopted_left_out, "SELECT doc_id AS row_id, 'via ' || source AS comment FROM documents WHERE source = 'src5' AND NOT contains(lower(text), 'via')")


def f11_sql_text(spark, sf_dir):
    """The same vocabulary for conditions written as SQL text."""
    P.sql_functions(spark)
    return base.docs(spark, sf_dir).df.where("has_ci(text, 'Token') AND NOT (has_ci(lang, 'en') OR is_filled(comment))").select("row_id")


R.add("f11_sql_text", f11_sql_text, f"{DOCS_SQL} SELECT row_id FROM docs WHERE contains(lower(text), 'token') AND NOT (contains(lower(lang), 'en') OR comment <> '')")
