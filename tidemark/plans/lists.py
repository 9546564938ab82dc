"""Queries I1 to I11, C1 to C6 and A5: indicator lists and extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators import extract as C
from ..operators import indicators as I
from ..operators import profile as A
from ..operators import rules as L
from . import base
from .base import DOCS_SQL, Registry

R = Registry()
#: Two lists as they are typed in.
LISTS = {
    "tokens": "## credentials\ntoken =\n# seen before\npassword\n\n/[0-9a-f]{40}/\n## licences\nApache License\n/GNU|MIT/\n##\ncc by-nc\n",
    "words": "## common\nthe and\n`lang=de AND Summary=und\n/[/\nqueque\n",
}
_LINES = [line for name, content in sorted(LISTS.items()) for line in I.parse_text(name, content)]


def _lines(spark):
    return spark.createDataFrame(_LINES, "list string, line int, text string")


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_LINES_SQL = "lines(list, line, text) AS (VALUES " + ", ".join(f"('{n}', {i}, {_sql_text(t)})" for n, i, t in _LINES) + ")"
_CLASSIFIED_SQL = f"""{_LINES_SQL}, t AS (SELECT list, line, trim(text) AS t FROM lines), classified AS (
  SELECT list, line, CASE WHEN t = '' THEN 'blank' WHEN t LIKE '##%' THEN 'label' WHEN t LIKE '#%' THEN 'note' WHEN regexp_matches(t, '^/.+/$') THEN 'regex' WHEN t LIKE '`%' THEN 'rule' ELSE 'plain' END AS kind,
    CASE WHEN t LIKE '##%' THEN regexp_replace(t, '^##\\s*', '') WHEN t LIKE '#%' THEN regexp_replace(t, '^#\\s*', '') WHEN regexp_matches(t, '^/.+/$') THEN substr(t, 2, length(t) - 2) WHEN t LIKE '`%' THEN regexp_replace(t, '^`\\s*', '') ELSE t END AS value FROM t
)"""
_LABEL_SQL = f"""{_CLASSIFIED_SQL}, b AS (SELECT *, sum(CASE WHEN kind IN ('label', 'blank') THEN 1 ELSE 0 END) OVER (PARTITION BY list ORDER BY line) AS block FROM classified), indicators AS (
  SELECT list, line, kind, value, coalesce(label, '') AS label FROM (SELECT *, max(CASE WHEN kind = 'label' THEN value END) OVER (PARTITION BY list, block) AS label FROM b) WHERE kind IN ('plain', 'regex', 'rule')
)"""


def _indicators(spark):
    return I.label_blocks(I.classify(_lines(spark)))


def _hits(t, indicators, lists):
    return I.scan(t, [i for i in I.compiled(indicators, {("words", 3): P.contains("lang", "de") & P.contains("text", "und")}) if i.list in lists])


def i1_i2_labelled_hits(spark, sf_dir):
    """Every indicator with its label and the documents it hits: lists are classified and labelled as tables."""
    t = base.bare_docs(spark, sf_dir)
    found = []
    for i in I.compiled(_indicators(spark)):
        hit = I.first_hit(t, [i]).isNotNull()
        found.append(F.struct(F.lit(i.list).alias("list"), F.lit(i.line).alias("line"), F.lit(i.kind).alias("kind"), F.lit(i.value).alias("value"), F.lit(i.label).alias("label"), hit.alias("hit")))
    rows = t.df.select(F.explode(F.array(*found)).alias("x"))
    return rows.groupBy("x.list", "x.line", "x.kind", "x.value", "x.label").agg(F.count_if("x.hit").alias("n_rows"))


_ANY_DATA = "(contains(lower(text), lower(value)) OR contains(lower(lang), lower(value)) OR contains(lower(source), lower(value)) OR contains(n_chars, lower(value)))"
_ANY_REGEX = "(regexp_matches(text, '(?i)' || value) OR regexp_matches(lang, '(?i)' || value) OR regexp_matches(source, '(?i)' || value) OR regexp_matches(n_chars, '(?i)' || value))"
_USABLE = "usable AS (SELECT * FROM indicators WHERE kind = 'plain' OR (kind = 'regex' AND value <> '['))"
_PAIRS_SQL = f"""{DOCS_SQL}, {_LABEL_SQL}, {_USABLE}, plain_hits AS (SELECT row_id, usable.* FROM docs JOIN usable ON kind = 'plain' AND {_ANY_DATA}),
regex_hits AS (SELECT row_id, usable.* FROM docs, usable WHERE kind = 'regex' AND CASE WHEN kind = 'regex' THEN {_ANY_REGEX} END),
rule_hits AS (SELECT row_id, i.* FROM docs, indicators i WHERE kind = 'rule' AND contains(lower(lang), 'de') AND contains(lower(text), 'und'))"""
_HITS_SQL = _PAIRS_SQL + ", pairs AS (SELECT * FROM plain_hits UNION ALL SELECT * FROM regex_hits UNION ALL SELECT * FROM rule_hits), hits AS (SELECT row_id, list, min(line) AS line, arg_min(label, line) AS label FROM pairs GROUP BY row_id, list)"
R.add(
    "i1_i2_labelled_hits",
    i1_i2_labelled_hits,
    f"{_PAIRS_SQL}, pairs AS (SELECT * FROM plain_hits UNION ALL SELECT * FROM regex_hits) SELECT u.list, u.line, u.kind, u.value, u.label, count(row_id) AS n_rows FROM usable u LEFT JOIN pairs p ON p.list = u.list AND p.line = u.line GROUP BY ALL",
)


def i3_plain(spark, sf_dir):
    return I.scan(base.bare_docs(spark, sf_dir), [I.Indicator("one", 1, "plain", "Token =")]).select("row_id")


R.add("i3_plain", i3_plain, f"{DOCS_SQL}, v AS (SELECT 'token =' AS value) SELECT row_id FROM docs, v WHERE {_ANY_DATA}")


def i4_regex(spark, sf_dir):
    return I.scan(base.bare_docs(spark, sf_dir), [I.Indicator("one", 1, "regex", "^src1[0-5]$")]).select("row_id")


R.add("i4_regex", i4_regex, f"{DOCS_SQL} SELECT row_id FROM docs WHERE regexp_matches(source, '^src1[0-5]$')")


def i5_rule_rows(spark, sf_dir):
    """A rule as rows of a table: (Summary has token AND NOT lang has fr) OR tag is bad."""
    t = base.docs(spark, sf_dir)
    rule = L.clauses_to_column(t, [(1, "Summary", "contains", "token", False), (1, "lang", "contains", "fr", True), (2, "tag", "regex", "^bad", False)])
    return I.scan(t, [I.Indicator("one", 1, "rule", "", rule=rule)]).select("row_id")


R.add("i5_rule_rows", i5_rule_rows, f"{DOCS_SQL} SELECT row_id FROM docs WHERE (contains(lower(text), 'token') AND NOT contains(lower(lang), 'fr')) OR regexp_matches(lower(tag_text), '^bad')")


#: Rules as rows: each line is any of its clauses, a clause all of its tests.
_RULES = [
    ("cells", 1, 1, "Summary", "contains", "token", False),
    ("cells", 1, 1, "lang", "exact", "EN", True),
    ("cells", 1, 2, "source", "regex", "^src1[0-3]$", False),
    ("cells", 1, 2, "lang", "exact", "EN", True),
    ("cells", 2, 1, "comment", "filled", "", False),
    ("cells", 2, 1, "", "has_tag", "Bad", False),
    ("cells", 3, 1, "row", "contains", "77", False),
    ("overlay", 1, 1, "comment", "empty", "", False),
    ("overlay", 1, 1, "", "tagged", "", True),
    ("overlay", 2, 1, "tag", "contains", "good", False),
    ("overlay", 2, 1, "Summary", "contains", "token", True),
]
_WHEN_RULES = [
    ("times", 1, 1, "ts", "between", "2024-01-03 and 2024-01-05 12:00", False),
    ("times", 1, 1, "event_type", "exact", "click", False),
    ("times", 2, 1, "ts", "before", "2024-01-02", False),
    ("times", 2, 2, "ts", "after", "2024-01-29", False),
    ("times", 2, 2, "event_type", "exact", "error", True),
]


def _rule_hits(spark, t, rows):
    lines = L.rule_lines(spark, sorted({(name, line, "", f"{name} {line}") for name, line, *_ in rows}))
    return L.scan_lists(t, lines, spark.createDataFrame(rows, L.CLAUSES))[0]


def i5_rules_as_data(spark, sf_dir):
    """Rules as rows of a table over cells and annotations; their distinct tests are evaluated once."""
    return _rule_hits(spark, base.docs(spark, sf_dir), _RULES)


_NOT_EN = "lower(lang) <> 'en'"
R.add(
    "i5_rules_as_data",
    i5_rules_as_data,
    f"""{DOCS_SQL}, hits AS (
  SELECT row_id, 'cells' AS list, CASE WHEN (contains(lower(text), 'token') AND {_NOT_EN}) OR (regexp_matches(source, '(?i)^src1[0-3]$') AND {_NOT_EN}) THEN 1 WHEN regexp_matches(comment, '\\S') AND list_contains(tags, 'Bad') THEN 2 WHEN contains(CAST(row_id + 1 AS VARCHAR), '77') THEN 3 END AS line FROM docs
  UNION ALL SELECT row_id, 'overlay', CASE WHEN NOT regexp_matches(comment, '\\S') AND len(tags) = 0 THEN 1 WHEN contains(lower(tag_text), 'good') AND NOT contains(lower(text), 'token') THEN 2 END FROM docs
) SELECT row_id, list, line, list || ' ' || line AS label FROM hits WHERE line IS NOT NULL""",
)


def i5_rules_over_times(spark, sf_dir):
    """Rules that compare times, before, after and between."""
    return _rule_hits(spark, base.events(spark, sf_dir), _WHEN_RULES)


R.add(
    "i5_rules_over_times",
    i5_rules_over_times,
    """WITH hits AS (SELECT event_id AS row_id, CASE WHEN ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-05 12:01:00' AND event_type = 'click' THEN 1 WHEN ts < TIMESTAMP '2024-01-02' OR (ts >= TIMESTAMP '2024-01-30' AND event_type <> 'error') THEN 2 END AS line FROM events)
SELECT row_id, 'times' AS list, line, 'times ' || line AS label FROM hits WHERE line IS NOT NULL""",
)
_SQL_RULES = [
    ("sql", 1, "lang = 'de' AND contains(lower(Summary), 'und')", "german"),
    ("sql", 2, "lang = = 'de'", "no condition"),
    ("sql", 3, "Host = 'dc1'", "no such column"),
    ("sql", 4, "n_chars", "no truth"),
    ("sql", 5, "  ", "empty"),
    ("sql", 6, "array_contains(tags, 'Bad') OR (try_cast(n_chars AS int) > 2000 AND source LIKE 'src1%')", "bad or long"),
    ("sql", 7, "count(*) > 1", "not of a row"),
]


def i6_sql_rules(spark, sf_dir):
    """Rules as SQL text: every line that cannot be used is reported, the others hit their rows."""
    lines = L.rule_lines(spark, _SQL_RULES)
    hits, errors = L.scan_lists(base.docs(spark, sf_dir), lines)
    counts = hits.groupBy("list", "line").agg(F.count(F.lit(1)).alias("n_rows"))
    reported = errors.select("list", "line", (F.length("error") > 0).alias("reported"))
    both = lines.join(counts, ["list", "line"], "left").join(reported, ["list", "line"], "left")
    return both.select("list", "line", F.coalesce("reported", F.lit(False)).alias("reported"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


R.add(
    "i6_sql_rules",
    i6_sql_rules,
    f"""{DOCS_SQL}, hits AS (SELECT CASE WHEN lang = 'de' AND contains(lower(text), 'und') THEN 1 WHEN list_contains(tags, 'Bad') OR (CAST(n_chars AS INTEGER) > 2000 AND source LIKE 'src1%') THEN 6 END AS line FROM docs)
SELECT 'sql' AS list, CAST(l.line AS INTEGER) AS line, l.line NOT IN (1, 6) AS reported, count(hits.line) AS n_rows FROM range(1, 8) l(line) LEFT JOIN hits ON hits.line = l.line GROUP BY l.line""",
)


def i6_bad_lines(spark, sf_dir):
    """Bad lines are reported beside the number of rows that the rest of their list hits."""
    clauses = [("words", 3, 1, "lang", "contains", "de", False), ("words", 3, 1, "Summary", "contains", "und", False)]
    hits, errors = L.scan_lists(base.bare_docs(spark, sf_dir), _indicators(spark), spark.createDataFrame(clauses, L.CLAUSES))
    return errors.select("list", "line", "value").join(A.hits_per_list(hits), "list")


R.add("i6_bad_lines", i6_bad_lines, f"{_HITS_SQL} SELECT i.list, i.line, i.value, (SELECT count(DISTINCT row_id) FROM hits h WHERE h.list = i.list) AS n_rows FROM indicators i WHERE kind = 'regex' AND value = '['")


def i7_scan(spark, sf_dir):
    return _hits(base.bare_docs(spark, sf_dir), _indicators(spark), {"tokens", "words"})


R.add("i7_scan", i7_scan, f"{_HITS_SQL} SELECT row_id, list, line, label FROM hits")


def _long_lists(spark, sf_dir):
    """A list of all benchmark items, one of all sources with a regular expression in front, and one with a rule."""
    items = base.table(spark, sf_dir, "benchmark").select(F.lit("bench").alias("list"), F.col("item_id").cast("int").alias("line"), F.lit("plain").alias("kind"), F.col("text").alias("value"), F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("label"))
    sources = base.table(spark, sf_dir, "documents").select("source").distinct().select(F.lit("sources"), F.regexp_extract("source", "[0-9]+$", 0).cast("int") + 2, F.lit("plain"), F.upper("source"), F.lit("source"))
    more = spark.createDataFrame([("sources", 1, "regex", "^src1[0-5]$", "teens"), ("rules", 1, "rule", "lang=de AND Summary=und", "german"), ("rules", 2, "regex", "(", "bad")], I.INDICATORS)
    return items.union(sources).union(more)


def i7_scan_many(spark, sf_dir):
    """Long lists over all data columns: literals, regular expressions and a rule."""
    return I.scan_many(base.bare_docs(spark, sf_dir), _long_lists(spark, sf_dir), {("rules", 1): P.contains("lang", "de") & P.contains("text", "und")})


R.add(
    "i7_scan_many",
    i7_scan_many,
    f"""{DOCS_SQL}, items AS (
  SELECT row_id, 'bench' AS list, CAST(min(item_id) AS INTEGER) AS line, 'item ' || min(item_id) AS label FROM docs JOIN benchmark b ON contains(lower(docs.text), lower(b.text)) GROUP BY row_id
), names AS (SELECT DISTINCT source AS value, CAST(regexp_extract(source, '[0-9]+$') AS INTEGER) + 2 AS line FROM documents), sources AS (
  SELECT row_id, 1 AS line, 'teens' AS label FROM docs WHERE regexp_matches(source, '^src1[0-5]$') UNION ALL SELECT row_id, line, 'source' FROM docs JOIN names ON {_ANY_DATA}
)
SELECT * FROM items UNION ALL SELECT row_id, 'sources', CAST(min(line) AS INTEGER), arg_min(label, line) FROM sources GROUP BY row_id
UNION ALL SELECT row_id, 'rules', 1, 'german' FROM docs WHERE contains(lower(lang), 'de') AND contains(lower(text), 'und')""",
)


def i8_tag_hits(spark, sf_dir):
    hits = _hits(base.bare_docs(spark, sf_dir), _indicators(spark), {"tokens", "words"})
    return I.hit_tags(hits).select("row_id", "tag")


R.add("i8_tag_hits", i8_tag_hits, f"{_HITS_SQL} SELECT row_id, 'ioc:' || list AS tag FROM hits")

_MERGE = "CASE WHEN label = '' THEN comment WHEN NOT regexp_matches(comment, '\\S') THEN label WHEN contains(comment, label) THEN comment ELSE label || '; ' || comment END"


def i9_merge_labels(spark, sf_dir):
    t = base.docs(spark, sf_dir)
    hits = _hits(t, _indicators(spark), {"tokens"})
    return t.df.select("row_id", "comment").join(hits, "row_id").select("row_id", I.merge_label(F.col("comment"), F.col("label")).alias("comment"))


R.add("i9_merge_labels", i9_merge_labels, f"{_HITS_SQL} SELECT row_id, {_MERGE} AS comment FROM hits JOIN docs USING (row_id) WHERE list = 'tokens'")


def flagship(spark, sf_dir):
    """All lists over all documents in one pass: tags and merged comments of the rows hit."""
    t = base.bare_docs(spark, sf_dir)
    hits = _hits(t, _indicators(spark), {"tokens", "words"})
    return I.run_all(t, hits, base.doc_tags(spark, sf_dir), base.doc_comments(spark, sf_dir)).select("row_id", F.array_join("tags", ", ").alias("tags"), "comment")


_RUN_SQL = f"""{_HITS_SQL}, one AS (SELECT d.row_id, d.tags, coalesce({_MERGE.replace('label', 'a.label')}, comment) AS comment, a.list AS a_list FROM docs d LEFT JOIN hits a ON a.row_id = d.row_id AND a.list = 'tokens'),
two AS (SELECT one.row_id, tags, coalesce({_MERGE.replace('label', 'b.label')}, comment) AS comment, a_list, b.list AS b_list FROM one LEFT JOIN hits b ON b.row_id = one.row_id AND b.list = 'words' WHERE a_list IS NOT NULL OR b.list IS NOT NULL)
SELECT row_id, array_to_string(list_sort(list_concat(tags, list_filter([CASE WHEN a_list IS NOT NULL THEN 'ioc:tokens' END, CASE WHEN b_list IS NOT NULL THEN 'ioc:words' END], lambda x: x IS NOT NULL))), ', ') AS tags, comment FROM two"""
R.add("flagship", flagship, _RUN_SQL)


def i10_run_all_lists(spark, sf_dir):
    """The same lists as long ones: literals by automata, the rest as expressions."""
    t = base.bare_docs(spark, sf_dir)
    hits = I.scan_many(t, _indicators(spark), {("words", 3): P.contains("lang", "de") & P.contains("text", "und")})
    return I.run_all(t, hits, base.doc_tags(spark, sf_dir), base.doc_comments(spark, sf_dir)).select("row_id", F.array_join("tags", ", ").alias("tags"), "comment")


R.add("i10_run_all_lists", i10_run_all_lists, _RUN_SQL)


def i11_list_names(spark, sf_dir):
    """Sources as list names in several spellings: one name for those that differ in case or edges only."""
    docs = base.table(spark, sf_dir, "documents")
    name = F.when(F.col("doc_id") % 3 == 0, F.upper("source")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit(" "), "source", F.lit("  "))).otherwise(F.col("source"))
    return I.list_names(docs.select(name.alias("list")))


R.add("i11_list_names", i11_list_names, "SELECT min(CASE WHEN doc_id % 3 = 0 THEN upper(source) ELSE source END) AS name, count(*) AS lines FROM documents GROUP BY lower(source)")


def a5_hits_per_list(spark, sf_dir):
    return A.hits_per_list(_hits(base.bare_docs(spark, sf_dir), _indicators(spark), {"tokens", "words"}))


R.add("a5_hits_per_list", a5_hits_per_list, f"{_HITS_SQL} SELECT list, count(DISTINCT row_id) AS n_rows FROM hits GROUP BY list")


def _sql_found(column: str, fallback: bool) -> str:
    parts = [f"list_transform(regexp_extract_all({column}, {_sql_text(p)}), lambda x: {{'kind': '{k}', 'text': regexp_replace(x, '^[\\s,;|\"'']+|[\\s,;|\"'']+$', '', 'g')}})" for k, p in C.DETECTORS]
    if fallback:
        trim = "regexp_replace(x, '^[\\s,;|\"'']+|[\\s,;|\"'']+$', '', 'g')"
        whole = f"regexp_replace({column}, '^\\s+|\\s+$', '', 'g')"
        parts.append(f"list_transform(CASE WHEN len(regexp_split_to_array({whole}, '\\s+')) > 1 THEN regexp_split_to_array({whole}, '\\s+') ELSE [] END, lambda x: {{'kind': 'token', 'text': {trim}}})")
        parts.append(f"[{{'kind': 'cell', 'text': {trim.replace('(x,', f'({whole},')}}}]")
    return "list_concat(" + ", ".join(parts) + ")"


def _found_rows_sql(table: str, key: str, column: str, fallback: bool) -> str:
    return f"""x AS (SELECT {key} AS row_id, unnest({_sql_found(column, fallback)}) AS f, generate_subscripts({_sql_found(column, fallback)}, 1) AS i FROM {table}),
y AS (SELECT row_id, f.text AS text, arg_min(f.kind, i) AS kind FROM x WHERE f.text <> '' GROUP BY row_id, f.text)"""


def c1_extract(spark, sf_dir):
    t = base.table(spark, sf_dir, "documents")
    return t.select(F.col("doc_id").alias("row_id"), F.explode(C.found("text", fallback=False)).alias("x")).select("row_id", "x.kind", "x.text")


R.add("c1_extract", c1_extract, f"WITH {_found_rows_sql('documents', 'doc_id', 'text', False)} SELECT row_id, kind, text FROM y")


def c2_c5_extract_with_fallback(spark, sf_dir):
    """Detectors, then tokens and the whole cell, of page addresses and event properties."""
    pages = base.table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit(' "'), F.col("url"), F.lit('", seen by '), F.col("page_id").cast("string"), F.lit(" ; ")).alias("cell"))
    return pages.select(F.col("page_id").alias("row_id"), F.explode(C.found("cell")).alias("x")).select("row_id", "x.kind", "x.text")


R.add("c2_c5_extract_with_fallback", c2_c5_extract_with_fallback, f"""WITH cells AS (SELECT page_id, ' "' || url || '", seen by ' || page_id || ' ; ' AS cell FROM pages), {_found_rows_sql('cells', 'page_id', 'cell', True)} SELECT row_id, kind, text FROM y""")


def c6_census(spark, sf_dir):
    """Indicators of all documents with the rows that hold them."""
    return C.census(base.docs(spark, sf_dir)).select("kind", "text", "n_rows")


R.add("c6_census", c6_census, f"WITH {_found_rows_sql('documents', 'doc_id', 'text', False)} SELECT kind, text, count(*) AS n_rows FROM y GROUP BY kind, text")


def c6_census_times(spark, sf_dir):
    """Indicators of event properties with first and last time."""
    t = base.events(spark, sf_dir)
    df = t.df.withColumn("origin", F.concat(F.lit("10.0."), (F.col("row_id") % 7).cast("string"), F.lit("."), F.col("user_id").cast("int") % 200, F.lit(" by user"), "user_id", F.lit("@mail.example.com")))
    return C.census(type(t)(df, ["ts", "origin"], time_column="ts", adopted=["ts"]))


R.add(
    "c6_census_times",
    c6_census_times,
    f"""WITH cells AS (SELECT event_id, ts, '10.0.' || (event_id % 7) || '.' || (user_id % 200) || ' by user' || user_id || '@mail.example.com' AS cell FROM events), {_found_rows_sql('cells', 'event_id', 'cell', False)}
SELECT kind, text, count(*) AS n_rows, min(ts) AS first_time, max(ts) AS last_time FROM y JOIN events ON event_id = row_id GROUP BY kind, text""",
)
