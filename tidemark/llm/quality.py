"""Quality rules: a bitmask ledger [native].

Every rule is evaluated once for each document and leaves one bit in
``fail_bits`` beside the measurements it used. A policy is a version name and
a mask over those bits: a document is kept under a policy if no bit of the
mask is set. Policies can be changed, compared and ablated from the ledger
alone, with bitwise aggregates and without reading a text again.

Edge cases: a null text is an empty one (no words, so it fails ``few_words``);
a text of white space only has no words; repeated rows are judged each on its
own; an empty table gives an empty ledger; extra columns are kept by
:func:`apply_policy` and ignored by :func:`ledger`. Column names that clash
with the ledger's do no harm, as only ``doc_id`` and ``text`` are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_RUN, SPACES, fenced, table, text_of

#: Words in a window whose repeats count, and the share of repeated words that fails.
WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30

#: Rules in the order of their bits, each a condition under which a document fails.
RULES: dict[str, str] = {
    "few_words": f"n_words < {MIN_WORDS}",
    "repeated_words": f"100 * n_repeat_words > {REPEAT_PERCENT} * n_words",
    "symbols": "100 * n_symbols > 40 * n_words",
    "duplicate_lines": "n_lines >= 4 AND 100 * n_dup_lines > 60 * n_lines",
    "shouting": "100 * n_shouts > 40 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 25 * n_words",
    "many_words": "n_words > 1000000",
    "few_lines": "n_lines = 1 AND n_words > 100000",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_words"]
#: Versioned policies over the same ledger.
POLICIES: dict[str, int] = {
    "base": BASE,
    "v1": BASE | BIT["symbols"] | BIT["duplicate_lines"] | BIT["shouting"] | BIT["short_words"] | BIT["long_words"],
    "v2": sum(BIT.values()),
}
POLICY = "v1"


def _repeats() -> list[tuple[str, Column]]:
    """Steps, each over the columns before, that end in ``n_repeat_words``.

    Windows are compared by their 64-bit hashes, which are made by doubling, so that
    ``WINDOW``, a power of two, costs its logarithm a word and not itself. Only texts in which some hash
    occurs twice are sorted; in those, each window that has an equal neighbour
    in the sorted order covers the words up to the next such window.
    """
    def doubled(of: str, half: int) -> Column:
        return F.transform(of, lambda x, i: F.xxhash64(x, F.get(of, i + half)))

    runs, size = [], 1  # hashes of the 2, 4, ... words from each word on
    while size < WINDOW:
        runs.append((f"runs{2 * size}", doubled(f"runs{size}" if runs else "words", size)))
        size *= 2
    windows = F.slice(runs[-1][0], F.lit(1), F.greatest(F.col("n_words") - WINDOW + 1, F.lit(0)))
    ordered = F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"),
        F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    twice = F.array_sort(
        F.transform(
            F.filter("ordered", lambda x, k: (F.get("ordered", k - 1)["h"] == x["h"]) | (F.get("ordered", k + 1)["h"] == x["h"])),
            lambda x: x["i"],
        )
    )
    covered = F.when(
        F.size("twice") > 0,
        F.lit(WINDOW)
        + F.aggregate(
            F.transform("twice", lambda p, k: F.when(k > 0, F.least(p - F.get("twice", k - 1), F.lit(WINDOW))).otherwise(0)),
            F.lit(0),
            lambda total, x: total + x,
        ),
    ).otherwise(0)
    return [*runs, ("windows", windows), ("ordered", ordered), ("twice", twice), ("n_repeat_words", covered.cast("long"))]


def ledger(docs: DataFrame) -> DataFrame:
    """One row for each document: ``doc_id``, the measurements and ``fail_bits``."""
    out = docs.select("doc_id", text_of().alias("text"))
    body = F.btrim("text", F.lit(SPACES))
    out = out.withColumn("words", F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, SPACE_RUN, -1)))
    out = out.withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != ""))
    out = out.select(
        "doc_id",
        "words",
        F.size("words").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.length(F.regexp_replace("text", "[^!]+", ""))).cast("long").alias("n_bangs"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    for name, value in _repeats():
        out = out.withColumn(name, value)
    out = out.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "n_lines",
        F.floor(F.col("n_bangs") / 2).cast("long").alias("n_shouts"),
    )
    bits = [F.when(F.expr(rule), BIT[name]).otherwise(0) for name, rule in RULES.items()]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return out.withColumn("fail_bits", total.cast("long"))


def decide(book: DataFrame, policy: str = POLICY) -> DataFrame:
    """The ledger with ``base_failed`` and the policy's ``kept``."""
    base = F.col("fail_bits").bitwiseAND(F.lit(BASE)) != 0
    return book.withColumn("base_failed", base).withColumn("kept", ~base & (F.col("fail_bits").bitwiseAND(F.lit(POLICIES[policy])) == 0))


def ablations(book: DataFrame, policy: str = POLICY) -> DataFrame:
    """What each rule of a policy does: documents that fail it, and that fail it alone.

    One row a rule. The ledger is first reduced to a count for each bitmask, so
    the work after that does not depend on the number of documents.
    """
    mask = POLICIES[policy]
    masks = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for n, b in BIT.items() if b & mask])
    one = masks.select("bits", "n", F.explode(rules).alias("r"))
    return one.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
    )


def apply_policy(docs: DataFrame, policy: str = POLICY) -> DataFrame:
    """The documents that the policy keeps, with all their columns.

    The verdict is computed on each row itself, so repeated and null ids need no join.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    packed = docs.select(row.alias("doc_id"), F.col("text"))
    return fenced(decide(ledger(packed), policy), F.col("kept")).select("doc_id.*")


def op10_quality_bitmask_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(ledger(table(spark, sf_dir, "documents"))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_shouts", "fail_bits"
    )


def llm_quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ablations(ledger(table(spark, sf_dir, "documents")))


_RULE_BITS = " + ".join(f"(CASE WHEN {rule} THEN {BIT[name]} ELSE 0 END)" for name, rule in RULES.items())
_LEDGER = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT k, doc_id, text,
         regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), u AS (
  SELECT k, unnest(words) AS word, unnest(generate_series(1, len(words))) AS i FROM w
), p AS (
  SELECT k, i, string_agg(word, ' ') OVER ahead AS part, count(*) OVER ahead AS size FROM u
  WINDOW ahead AS (PARTITION BY k ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)
), h AS (
  SELECT k, i, count(*) OVER (PARTITION BY k, part) AS n FROM p WHERE size = {WINDOW}
), t AS (
  SELECT k, i, lead(i) OVER (PARTITION BY k ORDER BY i) AS j FROM h WHERE n > 1
), r AS (
  SELECT k, sum(least(coalesce(j - i, {WINDOW}), {WINDOW})) AS n FROM t GROUP BY k
), m AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(floor(length(regexp_replace(text, '[^!]+', '', 'g')) / 2) AS BIGINT) AS n_shouts
  FROM w LEFT JOIN r USING (k)
), l AS (
  SELECT *, CAST({_RULE_BITS} AS BIGINT) AS fail_bits FROM m
)"""

QUERIES = {"op10_quality_bitmask_ledger": op10_quality_bitmask_ledger, "llm_quality_ablations": llm_quality_ablations}
ORACLES = {
    "op10_quality_bitmask_ledger": f"""{_LEDGER}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & {BASE}) <> 0 AS base_failed, (fail_bits & {BASE | POLICIES[POLICY]}) = 0 AS kept, n_lines, n_shouts, fail_bits
FROM l""",
    "llm_quality_ablations": f"""{_LEDGER}
SELECT rule, CAST(sum(CASE WHEN (fail_bits & bit) <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_failed,
       CAST(sum(CASE WHEN (fail_bits & {POLICIES[POLICY]}) = bit THEN 1 ELSE 0 END) AS BIGINT) AS n_failed_alone
FROM l, (VALUES {", ".join(f"('{n}', {b})" for n, b in BIT.items() if b & POLICIES[POLICY])}) AS rules(rule, bit)
GROUP BY rule""",
}
