"""Merkle manifest of a dataset, with a proof for every document by pointer jumping.

A document is a leaf: the SHA-256 of its fields, each with its length before it.
Leaves of a language, by doc_id, are the lowest level of its tree; every two
consecutive nodes become their parent, the last alone if it has no partner.
The roots of the languages are the leaves of one more tree of the same kind.

Leaves are placed by ranges, and a tree grows by ``STEP`` levels at once from aligned
blocks of 2**STEP nodes, so no task holds more than a block. What is kept of a
node is the segment of its path to its parent: the sibling's digest and side.
Proofs come from pointer jumping: in round r a node whose ancestor is 2**r levels
above takes over that ancestor's segment and its ancestor, by a self-join, so distances double
until every leaf is at its root. Only nodes that a later round can ask for stay: those whose
level is a multiple of the next distance. An ancestor of up to 16 levels up is
shared by at most 65,536 leaves; beyond that nodes are few and Spark broadcasts
them by their size.

Edge cases: fields that are null count as ``-`` (an empty text is ``0:``); rows
without lang are a tree of their own, ordered first; rows without doc_id come
first in their tree and are never tampered with; rows that share a doc_id are
ordered by their leaf, and equal rows have equal leaves in places of their own;
an empty table gives an empty result; only the five named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import placed, saved, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels that are built at once.
STEP = 8
#: Documents whose checksum this number divides are tampered with in the query.
TAMPERED = 7
#: How a segment names its entries: sibling on the left, on the right, none.
LEFT, RIGHT, ALONE = b"L", b"R", b"-"

_LINK = {
    "tree": pa.string(),
    "level": pa.int32(),
    "idx": pa.int64(),
    "depth": pa.int32(),
    "top": pa.int32(),
    "segment": pa.binary(),
    "digest": pa.binary(),
    "doc_id": pa.int64(),
    "tampered": pa.binary(),
}
_SQL = "tree string, level int, idx bigint, depth int, top int, segment binary, digest binary, doc_id bigint, tampered binary"


def field(value: Column) -> Column:
    """A field of a leaf, with its length in bytes before it."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(n_chars: Column | None = None) -> Column:
    """The digest of a document, as bytes."""
    values = [F.col(c) if c != "n_chars" or n_chars is None else n_chars for c in FIELDS]
    return F.unhex(F.sha2(F.concat(*map(field, values)), 256))


def parent(left: str, right: str = "") -> str:
    return hashlib.sha256((left + right).encode()).hexdigest()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in _LINK]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _LINK.values(), strict=True)], list(_LINK))


def _grown(nodes: list[dict], base: int, step: int) -> Iterator[tuple]:
    """A block of consecutive nodes of level ``base``: its links on the levels to come, then (with top -1) the node on top of them."""
    tree, depth, at, level = nodes[0]["tree"], nodes[0]["depth"], nodes[0]["idx"], base
    digests = [n["digest"].hex() for n in nodes]
    carried = [(n["digest"], n["doc_id"], n["tampered"]) for n in nodes] if base == 0 else None
    if depth == 0:
        yield (tree, 0, at, 0, 0, b"", *carried[0])
    while level < min(base + step, depth):
        for i, _ in enumerate(digests):
            other = bytes.fromhex(digests[i ^ 1]) if i ^ 1 < len(digests) else b""
            segment = (LEFT if i & 1 else RIGHT) + other if other else ALONE
            yield (tree, level, at + i, depth, level + 1, segment, *(carried[i] if carried else (None, None, None)))
        digests, at, level, carried = [parent(*digests[i : i + 2]) for i in range(0, len(digests), 2)], at >> 1, level + 1, None
    yield (tree, level, at, depth, -1, None, bytes.fromhex(digests[0]), None, None)


def _blocks(base: int, step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[dict] = []
        rows: list[tuple] = []
        for batch in batches:
            for node in batch.to_pylist():
                if block and (block[0]["tree"] != node["tree"] or block[0]["idx"] >> step != node["idx"] >> step):
                    rows.extend(_grown(block, base, step))
                    block = []
                    if len(rows) >= 10_000:
                        yield _batch(rows)
                        rows = []
                block.append(node)
        if block:
            rows.extend(_grown(block, base, step))
        yield _batch(rows)

    return run


def grow(leaves: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Links (of all nodes but the roots) and roots (tree, digest) of ``leaves`` (tree, idx, digest, doc_id, tampered), and the greatest depth."""
    sizes = saved(leaves.groupBy("tree").agg(F.count(F.lit(1)).alias("n")))
    # The least depth with 2**depth places for all: the digits of n - 1.
    sizes = sizes.select(F.col("tree").alias("_tree"), F.when(F.col("n") == 1, 0).otherwise(F.length(F.bin(F.col("n") - 1))).cast("int").alias("depth"))
    depth = sizes.agg(F.max("depth")).first()[0] or 0
    nodes = leaves.join(sizes, F.col("tree").eqNullSafe(F.col("_tree"))).select("tree", "idx", "depth", "digest", "doc_id", "tampered")
    links, roots, base = None, None, 0
    while True:
        dealt = nodes.repartition("tree", F.shiftright("idx", STEP)).sortWithinPartitions("tree", "idx")
        out = saved(dealt.mapInArrow(_blocks(base, STEP), _SQL))
        links = out.where("top >= 0") if links is None else links.unionByName(out.where("top >= 0"))
        ended = out.where("top = -1 AND level = depth").select("tree", "digest")
        roots = ended if roots is None else roots.unionByName(ended)
        base += STEP
        if base >= depth:
            return links, roots, depth
        nodes = out.where("top = -1 AND level < depth").select("tree", "idx", "depth", "digest", "doc_id", "tampered")


def jump(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """``nodes`` with the segments and ancestors of their ancestors (``targets``) behind their own."""
    done = nodes.where("top >= depth")
    going = nodes.where("top < depth").withColumn("_up", F.expr("shiftright(idx, top - level)"))
    above = targets.select(F.col("tree").alias("_tree"), F.col("level").alias("_level"), F.col("idx").alias("_idx"), F.col("top").alias("_top"), F.col("segment").alias("_more"))
    met = going.join(above, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("top") == F.col("_level")) & (F.col("_up") == F.col("_idx")))
    met = met.withColumns({"segment": F.concat("segment", "_more"), "top": F.col("_top")})
    return done.unionByName(met.select(done.columns))


def proofs(links: DataFrame, depth: int) -> DataFrame:
    """The links of the leaves, with the segments of their whole paths."""
    nodes, targets, distance = links.where("level % 2 = 0"), links.where("level % 2 = 1"), 1
    while distance < depth:
        distance *= 2
        further = saved(jump(nodes.where(F.col("level") % (2 * distance) == distance), targets)) if distance < depth else None
        nodes, targets = saved(jump(nodes.where(F.col("level") % (2 * distance) == 0), targets)), further
    return nodes.where("level = 0")


def fold(digest: str, segment: bytes) -> tuple[str, str]:
    """The root that a leaf and its path give, and the digest of the siblings on the path."""
    seen, at = [], 0
    while at < len(segment):
        side = segment[at : at + 1]
        if side == ALONE:
            digest, at = parent(digest), at + 1
            continue
        other = segment[at + 1 : at + 33].hex()
        seen.append(other)
        digest, at = parent(other, digest) if side == LEFT else parent(digest, other), at + 33
    return digest, hashlib.sha256("".join(seen).encode()).hexdigest()


_RESULT = "doc_id bigint, lang string, leaf string, subroot string, root string, levels int, proof_sha256 string, folded_root string, verified boolean"


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "lang", "leaf", "subroot", "root", "levels", "proof_sha256", "folded_root", "verified"]
    kinds = [pa.int64(), *[pa.string()] * 4, pa.int32(), pa.string(), pa.string(), pa.bool_()]
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            folded, proof = fold((r["tampered"] or r["digest"]).hex(), r["segment"] + r["beyond"])
            root = r["root"].hex()
            rows.append((r["doc_id"], r["tree"], r["digest"].hex(), r["subroot"].hex(), root, r["levels"], proof, folded, folded == root))
        columns = zip(*rows, strict=True) if rows else [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """The leaf, root and proof of every document, and whether the proof holds for ``tampered`` (bytes of a leaf; null: the document's own)."""
    changed = F.lit(None).cast("binary") if tampered is None else tampered
    leaves = docs.select(F.col("lang").cast("string").alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf().alias("digest"), changed.alias("tampered"))
    leaves = placed(leaves, "tree", [F.col("doc_id"), F.col("digest")]).withColumnRenamed("place", "idx")
    links, roots, depth = grow(leaves)
    roots = saved(roots)
    tops = placed(roots.select(F.lit("").alias("all"), "tree", "digest"), "all", [F.col("tree")])
    upper = tops.select(F.lit("").alias("tree"), F.col("place").alias("idx"), "digest", F.lit(None).cast("long").alias("doc_id"), F.encode(F.col("tree"), "utf-8").alias("tampered"))
    high, root, height = grow(upper)
    # The name of a tree travels with its leaf in the upper one, in the place of what is tampered with.
    beyond = proofs(high, height).select("tree", F.decode("tampered", "utf-8").alias("_tree"), F.col("digest").alias("subroot"), F.col("segment").alias("beyond"), F.col("depth").alias("height"))
    # The upper tree has one root.
    beyond = saved(beyond.join(F.broadcast(root.select("tree", F.col("digest").alias("root"))), "tree").drop("tree"))
    out = proofs(links, depth).join(beyond, F.col("tree").eqNullSafe(F.col("_tree")))
    out = out.select("doc_id", "tree", "digest", "tampered", "segment", "beyond", "subroot", "root", (F.col("depth") + F.col("height")).cast("int").alias("levels"))
    return out.mapInArrow(_verified, _RESULT)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of the documents; where ``TAMPERED`` divides the checksum of doc_id the proof is tried on a document with one more in n_chars."""
    docs = table(spark, sf_dir, "documents")
    hit = F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0
    return manifest(docs, F.when(hit, leaf(F.try_add(F.col("n_chars"), F.lit(1)))))


_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in FIELDS) + ")"
_CHANGED = "sha256(" + " || ".join(_FIELD.format("(n_chars + 1)" if c == "n_chars" else c) for c in FIELDS) + ")"
#: CRC-32 by its definition: a byte after the other, eight shifts each.
_CRC = """4294967295 - list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), list_transform(range(8), lambda k: CAST(0 AS BIGINT))), lambda v, k: xor(v // 2, (v % 2) * 3988292384)))"""

QUERIES = {"op11_merkle_manifest": op11_merkle_manifest}
ORACLES = {
    "op11_merkle_manifest": f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, {_LEAF} AS leaf, CASE WHEN ({_CRC}) % {TAMPERED} = 0 THEN {_CHANGED} ELSE {_LEAF} END AS tried FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n, coalesce('=' || lang, '') AS tree FROM d
), low(tree, level, idx, n, digest) AS (
  SELECT tree, 0, idx, n, leaf FROM placed
  UNION ALL SELECT tree, level + 1, idx // 2, (max(n) + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx)) FROM low WHERE n > 1 GROUP BY tree, level, idx // 2
), subroots AS (
  SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM low WHERE n = 1
), high(level, idx, n, digest) AS (
  SELECT 0, idx, n, digest FROM subroots
  UNION ALL SELECT level + 1, idx // 2, (max(n) + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx)) FROM high WHERE n > 1 GROUP BY level, idx // 2
), climb(leaf_tree, leaf_idx, level, idx, proof, folded) AS (
  SELECT tree, idx, 0, idx, '', tried FROM placed
  UNION ALL SELECT c.leaf_tree, c.leaf_idx, c.level + 1, c.idx // 2, c.proof || coalesce(s.digest, ''),
    sha256(CASE WHEN c.idx % 2 = 1 THEN s.digest || c.folded ELSE c.folded || coalesce(s.digest, '') END)
  FROM climb c JOIN low o ON o.tree = c.leaf_tree AND o.level = c.level AND o.idx = c.idx AND o.n > 1
    LEFT JOIN low s ON s.tree = c.leaf_tree AND s.level = c.level AND s.idx = xor(c.idx, 1)
), over_(leaf_tree, leaf_idx, level, idx, proof, folded, depth) AS (
  SELECT c.leaf_tree, c.leaf_idx, 0, r.idx, c.proof, c.folded, c.level FROM climb c JOIN subroots r ON r.tree = c.leaf_tree JOIN low o ON o.tree = c.leaf_tree AND o.level = c.level AND o.n = 1
  UNION ALL SELECT c.leaf_tree, c.leaf_idx, c.level + 1, c.idx // 2, c.proof || coalesce(s.digest, ''),
    sha256(CASE WHEN c.idx % 2 = 1 THEN s.digest || c.folded ELSE c.folded || coalesce(s.digest, '') END), c.depth
  FROM over_ c JOIN high o ON o.level = c.level AND o.idx = c.idx AND o.n > 1 LEFT JOIN high s ON s.level = c.level AND s.idx = xor(c.idx, 1)
), root AS (SELECT level, digest FROM high WHERE n = 1)
SELECT p.doc_id, p.lang, p.leaf, r.digest AS subroot, root.digest AS root, CAST(o.depth + o.level AS INTEGER) AS levels, sha256(o.proof) AS proof_sha256, o.folded AS folded_root, o.folded = root.digest AS verified
FROM placed p JOIN subroots r USING (tree) JOIN root ON true JOIN over_ o ON o.leaf_tree = p.tree AND o.leaf_idx = p.idx AND o.level = root.level"""
}
