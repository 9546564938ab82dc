"""Secret scans: corpus-wide ownership frequency of candidate credentials [native].

Base findings come from three fixed patterns. Candidate values (those, and
bare high-entropy tokens) are hashed and counted over the whole corpus by
distinct repositories (documents) and owners (``source``). A value that many
owners hold is a widely copied example; one that few owners hold and that
looks live is owner-specific. Bare tokens of the second sort are added to the
base spans under the kind ``live``.

Positions are code points, end exclusive. They are taken by cutting a text at
the matches of a pattern: pieces and matches alternate, so the running sum of
their lengths gives each start. Texts are read once, and the pieces of those
with a match are written; from there on a match is a row, running sums are
windows within a text, and the work grows with the matches and not with their
square.

Edge cases: a null text is an empty one and has no findings; a null owner
counts as one owner of its own; a text that is one secret is redacted whole; repeated rows are one repository but keep a
row each; an empty table gives an empty result; only ``doc_id``, ``text`` and
``source`` are read, so other columns cannot clash. Two kinds that start at
one place are ordered as listed in ``KINDS``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved, table, text_of


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
#: Kinds in the order of ties, with pattern, group whose length counts, and least length.
KINDS: dict[str, tuple[str, int, int]] = {
    "assign": (rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": ("AKIA[A-Z0-9]+", 0, 20),
    "hex": ("[0-9a-f]+", 0, 24),
}
#: Same findings as hex above: a run of 24 or more is found whole, shorter ones are dropped.
_FAST = {"hex": "[0-9a-f]{24,}"}
#: Bare candidates: a run with letters and digits that no base span touches. A run with slashes counts
#: whole, if one of its parts would by itself, or if it has 40 characters with letters of both cases and digits.
BARE, PART, KEY_LENGTH = "[A-Za-z0-9_+/-]{20,}", "[A-Za-z0-9_+-]{20,}", 40
#: Values of more owners than this are examples that people copy, however many documents an owner holds them in,
#: unless one owner holds this share (in percent) of the repositories that have it.
MAX_OWNERS, MAIN_SHARE = 2, 90
#: Distinct characters that a value needs to look live.
MIN_DISTINCT = 8

_MATCH = "array<struct<gap:int,length:int,value:string>>"
_RANK = {k: i for i, k in enumerate([*KINDS, "live"])}


def _matches(text: Column, pattern: str, group: int) -> Column:
    """Matches of a pattern in order: the length of what lies between it and the one before, its own length, and its value."""
    matched = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matched
    gaps = F.slice(F.transform(F.split(text, pattern, -1), F.length), 1, F.size(matched))
    both = F.zip_with(F.zip_with(gaps, F.transform(matched, F.length), lambda g, m: F.struct(g.alias("gap"), m.alias("length"))), values, lambda x, v: F.struct(x["gap"].alias("gap"), x["length"].alias("length"), v.alias("value")))
    return F.when(text.rlike(pattern), both).otherwise(F.array().cast(_MATCH))


def survey(docs: DataFrame, *more: Column) -> DataFrame:
    """One saved row for each document: rid, doc_id, owner, text_hash, an array of matches for each kind, and ``more``."""
    text = text_of()
    kinds = {k: _matches(text, _FAST.get(k, p), g) for k, (p, g, _) in KINDS.items()} | {"live": _matches(text, BARE, 0)}
    one = docs.select("doc_id", F.col("source").alias("owner"), F.xxhash64(text).alias("text_hash"), *[c.alias(f"m_{k}") for k, c in kinds.items()], *more)
    return saved(one.withColumn("rid", F.monotonically_increasing_id()))


def spans(found: DataFrame) -> DataFrame:
    """Base spans and bare candidates of a survey, a row each: rid, doc_id, owner, text_hash, kind, rank, start, end, value."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(r).alias("rank"), F.lit(KINDS[k][2] if k in KINDS else 20).alias("least"), F.col(f"m_{k}").alias("m")) for k, r in _RANK.items()])
    some = F.filter(kinds, lambda x: F.size(x["m"]) > 0)
    by_kind = found.select("rid", "doc_id", "owner", "text_hash", F.explode(some).alias("x"))
    rows = by_kind.select("rid", "doc_id", "owner", "text_hash", "x.kind", "x.rank", "x.least", F.posexplode("x.m").alias("i", "m"))
    running = W.partitionBy("rid", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    placed = rows.withColumn("end", F.sum(F.col("m.gap") + F.col("m.length")).over(running).cast("int")).withColumn("start", F.col("end") - F.col("m.length"))
    value, bare = F.col("m.value"), F.col("kind") == "live"
    part = value.rlike(PART) | ((F.length(value) == KEY_LENGTH) & value.rlike("[A-Z]") & value.rlike("[a-z]"))
    usable = (F.length(value) >= F.col("least")) & (~bare | (value.rlike("[0-9]") & value.rlike("[A-Za-z]") & part))
    kept = placed.where(usable).select("rid", "doc_id", "owner", "text_hash", "kind", "rank", "start", "end", value.alias("value"))
    # A bare run counts where no base span before it reaches into it and none behind it starts in it.
    before = W.partitionBy("rid").orderBy("start", "rank").rowsBetween(W.unboundedPreceding, -1)
    behind = W.partitionBy("rid").orderBy(F.col("start").desc(), F.col("rank").desc()).rowsBetween(W.unboundedPreceding, -1)
    marked = kept.withColumn("reach", F.max(F.when(~bare, F.col("end"))).over(before)).withColumn("next", F.min(F.when(~bare, F.col("start"))).over(behind))
    touched = (F.coalesce("reach", F.lit(0)) > F.col("start")) | F.coalesce(F.col("next") < F.col("end"), F.lit(False))
    return marked.where(~bare | ~touched).drop("reach", "next")


def ownership(found: DataFrame) -> DataFrame:
    """Distinct repositories and owners of the hash of each value of ``found`` (:func:`spans`), and its class.

    A repository is a document with its text, an owner its source. A value that looks live is
    owner-specific if it has few owners, or if nearly all of its repositories are one owner's, so that a leak that
    others have quoted stays one; both measures are shares or counts of owners and do not change with
    the size of the corpus.

    Both levels of grouping combine before the shuffle, so a value that a third
    of all documents hold arrives as one row for each task and owner.
    """
    live = (F.size(F.array_distinct(F.split("value", ""))) >= MIN_DISTINCT) & F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")
    candidates = found.select("doc_id", "owner", "text_hash", F.sha2("value", 256).alias("value_hash"), live.alias("live"))
    repositories = candidates.groupBy("value_hash", "owner", "doc_id", "text_hash").agg(F.first("live").alias("live"))
    owners = repositories.groupBy("value_hash", "owner").agg(F.count(F.lit(1)).alias("n"), F.first("live").alias("live"))
    per = owners.groupBy("value_hash").agg(F.sum("n").alias("n_repositories"), F.count(F.lit(1)).alias("n_owners"), F.max("n").alias("most"), F.first("live").alias("live"))
    few = (F.col("n_owners") <= MAX_OWNERS) | (100 * F.col("most") >= MAIN_SHARE * F.col("n_repositories"))
    return per.withColumn("verdict", F.when(~F.col("live"), "placeholder").when(few, "live").otherwise("example")).drop("live", "most")


def judged(survey_: DataFrame) -> DataFrame:
    """The spans of a survey with the verdict on their value; bare ones only if it is live.

    The side of the spans can be split by Spark where one value is hot.
    """
    found = saved(spans(survey_))
    both = found.withColumn("value_hash", F.sha2("value", 256)).join(ownership(found), "value_hash")
    return both.where((F.col("kind") != "live") | (F.col("verdict") == "live")).drop("value_hash")


def _joined(spans_: Column) -> Column:
    """``kind:start:end`` of (start, rank, kind, end) by start, then rank."""
    return F.array_join(F.transform(F.array_sort(spans_), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """One row for each document: base and all spans, how many are live, example or placeholder, and for each span the repositories and owners of its value."""
    found = survey(docs)
    span, base = F.struct("start", "rank", "kind", "end"), F.col("kind") != "live"
    per = judged(found).groupBy("rid").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS],
        F.sha2(_joined(F.collect_list(F.when(base, span))), 256).alias("base_sha256"),
        _joined(F.collect_list(span)).alias("spans"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "rank", "n_repositories", "n_owners"))), lambda x: F.concat_ws("/", x["n_repositories"].cast("string"), x["n_owners"].cast("string"))), ",").alias("ownership"),
        F.count_if(F.col("verdict") == "live").alias("n_live"),
        F.count_if(base & (F.col("verdict") == "example")).alias("n_example"),
        F.count_if(~base).alias("n_added"),
    )
    out = found.select("rid", "doc_id").join(per, "rid", "left")
    texts = {"base_sha256": F.sha2(F.lit(""), 256), "spans": F.lit(""), "ownership": F.lit("")}
    names = [*[f"n_{k}" for k in KINDS], "base_sha256", "spans", "ownership", "n_live", "n_example", "n_added"]
    return out.select("doc_id", *[F.coalesce(n, texts.get(n, F.lit(0).cast("long"))).alias(n) for n in names])


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with the value of every found span replaced; all columns stay.

    Overlapping spans are merged first. Documents without a match never leave
    their task; the others meet their spans by row.
    """
    found = survey(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    by_start = W.partitionBy("rid").orderBy("start", "rank")
    far = F.max("end").over(by_start.rowsBetween(W.unboundedPreceding, -1))
    new = judged(found).withColumn("new", F.when(F.col("start") < far, 0).otherwise(1))
    islands = new.withColumn("island", F.sum("new").over(by_start.rowsBetween(W.unboundedPreceding, 0))).groupBy("rid", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    hits = islands.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("hits"))
    matched = F.greatest(*[F.size(f"m_{k}") for k in _RANK]) > 0
    text = F.col("row")["text"]

    def piece(x: Column, i: Column) -> Column:
        at = F.when(i > 0, F.get("hits", i - 1)["end"]).otherwise(0)
        return F.concat(F.substring(text, at + 1, x["start"] - at), F.lit(mask))

    last = F.get("hits", F.size("hits") - 1)["end"]
    cut = F.concat(F.array_join(F.transform("hits", piece), ""), F.substring(text, last + 1, F.length(text)))
    held = found.where(matched).select("rid", "row").join(hits, "rid", "left")
    columns = [F.when(F.col("hits").isNull(), text).otherwise(cut).alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]
    return found.where(~matched).select("row.*").unionAll(held.select(*columns))


def op1_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql_spans(kind: str, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""{kind}_m AS (
  SELECT k, text, regexp_extract_all(text, '{p}', 0) AS m, regexp_extract_all(text, '{p}', {group}) AS v, regexp_split_to_array(text, '{p}') AS g
  FROM d WHERE regexp_matches(text, '{p}')
), {kind}_u AS (
  SELECT k, unnest(m) AS m, unnest(v) AS v, unnest(g[1:len(m)]) AS g, unnest(generate_series(1, len(m))) AS i FROM {kind}_m
), {kind}_s AS (
  SELECT k, '{kind}' AS kind, v AS value, sum(length(g) + length(m)) OVER w - length(m) AS s, sum(length(g) + length(m)) OVER w AS e
  FROM {kind}_u WINDOW w AS (PARTITION BY k ORDER BY i)
), {kind} AS (
  SELECT k, kind, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e, value FROM {kind}_s WHERE length(value) >= {least}
)"""


_LIVE_LOOK = f"len(list_distinct(string_split(value, ''))) >= {MIN_DISTINCT} AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')"

QUERIES = {"op1_secret_ownership": op1_secret_ownership}
ORACLES = {
    "op1_secret_ownership": f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS text FROM documents),
{", ".join(_sql_spans(k, *v) for k, v in KINDS.items())},
{_sql_spans("live", BARE, 0, 20)},
base AS (
  SELECT *, 1 AS r FROM assign UNION ALL SELECT *, 2 FROM access UNION ALL SELECT *, 3 FROM hex
), bare AS (
  SELECT *, 4 AS r FROM live l WHERE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
    AND (regexp_matches(value, '{PART}') OR (length(value) = {KEY_LENGTH} AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]')))
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.k = l.k AND b.s < l.e AND l.s < b.e)
), cand AS (
  SELECT * FROM base UNION ALL SELECT * FROM bare
), repositories AS (
  SELECT DISTINCT value, source, doc_id, text FROM cand JOIN d USING (k)
), by_owner AS (
  SELECT value, coalesce('=' || source, '') AS owner, count(*) AS n FROM repositories GROUP BY ALL
), owned AS (
  SELECT value, sum(n) AS n_repositories, count(*) AS owners, max(n) AS most FROM by_owner GROUP BY value
), verdict AS (
  SELECT value, n_repositories, owners, CASE WHEN NOT ({_LIVE_LOOK}) THEN 'placeholder' WHEN owners <= {MAX_OWNERS} OR 100 * most >= {MAIN_SHARE} * n_repositories THEN 'live' ELSE 'example' END AS verdict FROM owned
), judged AS (
  SELECT cand.*, verdict, n_repositories, owners FROM cand JOIN verdict USING (value)
), per AS (
  SELECT k, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, r) FILTER (r < 4) AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, r) FILTER (r < 4 OR verdict = 'live') AS spans,
    string_agg(n_repositories || '/' || owners, ',' ORDER BY s, r) FILTER (r < 4 OR verdict = 'live') AS ownership,
    count(*) FILTER (verdict = 'live') AS n_live, count(*) FILTER (r < 4 AND verdict = 'example') AS n_example, count(*) FILTER (r = 4 AND verdict = 'live') AS n_added
  FROM judged GROUP BY k
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(ownership, '') AS ownership,
  coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example, coalesce(n_added, 0) AS n_added
FROM d LEFT JOIN per USING (k)"""
}
