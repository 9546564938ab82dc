"""WARC: records, and a Merkle fixity audit of replicas.

Pages are laid out as WARC records in files by a hash of their identity (page_id
and url; what has no page_id is known by its content as well). Within a file
records are in the order of that hash, each with its ordinal, offset, length and
SHA-256. The tree of a file branches by the next digits of the same hash: a node
stands for an ordered range of offsets and hashes, in order, the lengths and
digests of its (at most 16) children. Lengths and not absolute offsets go into
the hash, so a lost, added or shortened record changes the nodes above it and no
other, however far it moves what follows. Two replicas, each laid out on its
own, are compared at their roots; only the children of nodes that differ are
compared on the next level, down to the records.

Records of a branch that differs are matched by identity and digest; what is
left over on both sides under one identity is ``changed``, in the order of the
digests, the rest is ``lost`` or ``added``.

Edge cases: null url or html count as empty; a record without page_id that
changes is lost and added, as nothing else tells which one it was; repeated rows
are records of their own, and one copy fewer is one lost; an empty replica
differs in every record; two empty replicas give an empty result; only page_id,
url and html are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved, table

#: Records that a file holds on average, at most; the number of files is a power of 16.
RECORDS_PER_FILE = 1000
#: Hexadecimal digits of a branch below its file, and so the height of the tree: about 4 records are left under one.
BRANCH = 2


def record(html: Column) -> Column:
    """The bytes of a response record as text."""
    html = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce("url", F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(html).cast("string"),
        F.lit("\r\n\r\n"),
        html,
        F.lit("\r\n\r\n"),
    )


def digits(n: int, records_per_file: int = RECORDS_PER_FILE) -> int:
    """Hexadecimal digits in the name of a file of a layout of n records."""
    d = 0
    while 16**d * records_per_file < n:
        d += 1
    return d


def layout(pages: DataFrame, n_digits: int) -> DataFrame:
    """file, branch, name, seq, offset, length, digest and page_id of every record of a replica."""
    digest = F.sha2(record(F.col("html")), 256)
    known = F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")))
    name = F.md5(F.when(F.col("page_id").isNull(), F.concat_ws("|", known, digest)).otherwise(known))
    one = pages.select(
        F.concat(F.lit("w"), F.left(name, F.lit(n_digits))).alias("file"),
        F.substring(name, n_digits + 1, BRANCH).alias("branch"),
        name.alias("name"),
        "page_id",
        F.octet_length(record(F.col("html"))).cast("long").alias("length"),
        digest.alias("digest"),
    )
    order = W.partitionBy("file").orderBy("name", "digest")
    return one.withColumn("seq", F.row_number().over(order).cast("long") - 1).withColumn("offset", F.sum("length").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("length"))


def parents(nodes: DataFrame, digits_: int) -> DataFrame:
    """One level up: nodes (file, branch, length, digest), with that many digits left of their branch; equal children are counted before the shuffle."""
    up = nodes.withColumn("child", F.col("branch") if digits_ < BRANCH else F.col("name")).withColumn("branch", F.left("branch", F.lit(digits_)))
    children = up.groupBy("file", "branch", "child", "length", "digest").agg(F.count(F.lit(1)).alias("n"))
    listed = F.array_sort(F.collect_list(F.struct("child", "digest", "length", "n")))
    text = F.array_join(F.transform(listed, lambda c: F.concat_ws(":", c["child"], c["length"].cast("string"), c["n"].cast("string"), c["digest"])), ",")
    return children.groupBy("file", "branch").agg(F.sum(F.col("length") * F.col("n")).alias("length"), F.sha2(text, 256).alias("digest"))


def tree(records: DataFrame) -> list[DataFrame]:
    """The saved levels above the records, from the lowest to the roots."""
    levels = [saved(parents(records, BRANCH))]
    for n in range(BRANCH - 1, -1, -1):
        levels.append(saved(parents(levels[-1], n)))
    return levels


def _within(nodes: DataFrame, bad: DataFrame | None, n: int) -> DataFrame:
    """Nodes or records whose branch begins with one of ``bad`` (n digits)."""
    if bad is None:
        return nodes
    up = bad.select("file", F.col("branch").alias("up"))
    return nodes.withColumn("up", F.left("branch", F.lit(n))).join(up, ["file", "up"], "left_semi").drop("up")


def _unmatched(records: DataFrame, others: DataFrame) -> DataFrame:
    """Records without a partner of the same identity and digest, numbered within their identity."""
    copy = F.row_number().over(W.partitionBy("file", "name", "digest").orderBy("seq"))
    alone = records.withColumn("copy", copy).join(others.withColumn("copy", copy).select("file", "name", "digest", "copy"), ["file", "name", "digest", "copy"], "left_anti")
    return alone.withColumn("nth", F.row_number().over(W.partitionBy("file", "name").orderBy("digest", "copy")))


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """Records in which two replicas (:func:`layout` with equally many digits, saved) differ, with their places in both."""
    bad, n = None, 0
    for n, (a, b) in enumerate(zip(reversed(tree(left)), reversed(tree(right)), strict=True)):
        a, b = _within(a, bad, n - 1), _within(b, bad, n - 1)
        both = a.join(b.withColumnRenamed("digest", "other").drop("length"), ["file", "branch"], "full")
        bad = both.where(~F.col("digest").eqNullSafe(F.col("other"))).select("file", "branch")
    bad = saved(bad)
    left, right = _within(left, bad, n), _within(right, bad, n)
    place = ["seq", "offset", "length"]
    a = _unmatched(left, right).select("file", "name", "nth", "page_id", *place, F.col("digest").alias("expected"))
    b = _unmatched(right, left).select("file", "name", "nth", F.col("page_id").alias("_id"), *[F.col(c).alias(f"other_{c}") for c in place], F.col("digest").alias("found"))
    status = F.when(F.col("found").isNull(), "lost").when(F.col("expected").isNull(), "added").otherwise("changed")
    return a.join(b, ["file", "name", "nth"], "full").select(
        "file",
        F.coalesce("page_id", "_id").alias("page_id"),
        status.alias("status"),
        *place,
        *[f"other_{c}" for c in place],
        F.coalesce("expected", F.lit("")).alias("expected"),
        F.coalesce("found", F.lit("")).alias("found"),
    )


#: The replicas of the query: by a hash of their url some pages are cut short by a character in the second, some are only in the first, some only in the second.
CUT, LOST, ADDED = "5", "77", "9a"


def op4_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of two replicas of the pages that Spark derives, with damage to about 1 record in 16 and 1 in 128, each laid out on its own."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    mark = F.md5(F.coalesce("url", F.lit("")))
    cut = F.when(mark.startswith(CUT), F.expr("left(html, length(html) - 1)")).otherwise(F.col("html"))
    n = digits(pages.count())
    left = saved(layout(pages.where(~mark.startswith(ADDED)), n))
    right = saved(layout(pages.where(~mark.startswith(LOST)).withColumn("html", cut), n))
    return audit(left, right)


_SQL_RECORD = """'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '')
  || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
  || 'Content-Length: ' || strlen({html}) || chr(13) || chr(10) || chr(13) || chr(10) || {html} || chr(13) || chr(10) || chr(13) || chr(10)"""

QUERIES = {"op4_merkle_audit": op4_merkle_audit}
ORACLES = {
    "op4_merkle_audit": f"""
WITH n AS (
  SELECT CAST(ceil(greatest(0, log(count(*) / {RECORDS_PER_FILE}) / log(16) - 1e-12)) AS INTEGER) AS digits FROM pages
), c AS (
  SELECT page_id, url, coalesce(html, '') AS html, digits, md5(coalesce(url, '')) AS mark FROM pages, n
), s AS (
  SELECT 1 AS side, *, {_SQL_RECORD.format(html="html")} AS record FROM c WHERE mark NOT LIKE '{ADDED}%'
  UNION ALL SELECT 2, *, {_SQL_RECORD.format(html="left(html, length(html) - CASE WHEN mark LIKE '" + CUT + "%' THEN 1 ELSE 0 END)")} FROM c WHERE mark NOT LIKE '{LOST}%'
), d AS (
  SELECT *, sha256(record) AS digest, CAST(strlen(record) AS BIGINT) AS length, coalesce(CAST(page_id AS VARCHAR), '') || '|' || coalesce(url, '') AS known FROM s
), k AS (
  SELECT *, md5(CASE WHEN page_id IS NULL THEN known || '|' || digest ELSE known END) AS name FROM d
), o AS (
  SELECT *, 'w' || left(name, digits) AS file, row_number() OVER w - 1 AS seq, CAST(sum(length) OVER w - length AS BIGINT) AS "offset",
    row_number() OVER (PARTITION BY side, name, digest ORDER BY length) AS copy FROM k WINDOW w AS (PARTITION BY side, left(name, digits) ORDER BY name, digest ROWS UNBOUNDED PRECEDING)
), u AS (
  SELECT *, row_number() OVER (PARTITION BY side, name ORDER BY digest, copy) AS nth FROM o a
  WHERE NOT EXISTS (SELECT 1 FROM o b WHERE b.side <> a.side AND b.name = a.name AND b.digest = a.digest AND b.copy = a.copy)
), l AS (SELECT * FROM u WHERE side = 1), r AS (SELECT * FROM u WHERE side = 2)
SELECT coalesce(l.file, r.file) AS file, coalesce(l.page_id, r.page_id) AS page_id, CASE WHEN r.name IS NULL THEN 'lost' WHEN l.name IS NULL THEN 'added' ELSE 'changed' END AS status,
  l.seq, l."offset", l.length, r.seq AS other_seq, r."offset" AS other_offset, r.length AS other_length, coalesce(l.digest, '') AS expected, coalesce(r.digest, '') AS found
FROM l FULL JOIN r ON l.name = r.name AND l.nth = r.nth"""
}
