"""N-gram Jaccard join: a prefix-tree join over globally ordered shingle sets.

Texts become sets of word shingles; equal sets are one set from then on. All
sets are ordered alike: rare shingles by their hash, then the frequent ones
(a bounded list, counted over all documents) from rare to frequent. Two sets
that are similar enough share a shingle among the first few of each, so sets
meet only where those prefixes do; sizes and positions prune pairs at once.
What is left is joined through prefix trees: the ordered sets that meet in one
place are stored as a trie (sorted, with the lengths of common prefixes), the
probing set walks down it, rows with a common prefix share the overlap counted
so far, and a subtree is left as soon as the remaining lengths cannot reach the
overlap that is needed. No link is lost or estimated; connected components over
the links give the classes.

Groups of sets under one shingle that hold more than ``FEW`` members are not
paired off. The sets that such groups tie together, directly or through others,
form a crowd, found as connected components; each set goes to its crowd once
and meets the others there, in blocks of about ``BLOCK`` sets that are ordered by
size, so that blocks whose sizes are too far apart do not meet. Frequent shingles
are dealt by (shingle, set), so none of them is one task's work before that.

Shingles are compared as 56-bit hashes, equal sets as a 64-bit sum of hashes,
and not verified on the words: a link is wrong if two shingles of its two texts
share a hash and the pair is that close to the limit (for two texts of 1,000
shingles a chance of one in 10**10, before the second condition), a class if two
different sets share a name (one in 10**5 that any two of 20 million sets do).

Edge cases: null, empty and blank texts have an empty set, link with nothing
and are a class of their own; a text with fewer words than a shingle is one
shingle; repeated rows and rows that share a doc_id or have none are documents
of their own (their class is named by the smallest doc_id, null if all are
null); an empty table gives an empty result; only ``doc_id`` and ``text`` are
read, and :func:`dedup` returns all columns whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import keyed, saved, table, text_of, whole_groups
from .rolling import U, Rolling, mix, ragged, utf8

#: Words of a shingle and least similarity in percent: of the query by its contract, and of the pipeline.
QUERY_WORDS, QUERY_PERCENT = 4, 85
WORDS, PERCENT = 5, 80
#: Different sets of a batch that hold a shingle which counts as frequent; the most frequent shingles kept.
OFTEN, MOST_FREQUENT = 3, 200_000
FEW, BLOCK = 128, 512
#: Nodes whose edges a task holds at once, and the edges of a round for which it has a task at least; by how much a round has fewer tasks than the one before.
FOREST, EIGHTH = 200_000, 8
#: Tokens of a trie walked in one step; documents hashed at once (at most 256, as 8 bits name them).
STEP, DOCS = 64, 256
_SALT = U(0x2545F4914F6CDD1D)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


class Shingles:
    """Sets of shingle hashes of the documents in a buffer."""

    def __init__(self, words: int, frequent: np.ndarray) -> None:
        self.words, self.roll = words, Rolling(5)
        order = np.argsort(frequent)
        self.frequent, self.rank = frequent[order], order + 1

    def sets(self, data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """For runs of documents: document and hash of each distinct shingle, sorted, and the first document of the run."""
        lo = 0
        while lo < len(at) - 1:
            hi = min(lo + DOCS, len(at) - 1)
            doc, token = self._sets(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
            yield doc + lo, token, lo
            lo = hi

    def _sets(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data = _LOWER[data]
        word = ~_SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[at] = True
        before, after = np.concatenate([[False], word])[:-1], np.concatenate([word, [False]])[1:]
        start = np.flatnonzero(word & (~before | edge[:-1]))
        end = np.flatnonzero(word & (~after | edge[1:])) + 1
        doc = np.searchsorted(at, start, "right") - 1
        count = np.bincount(doc, minlength=len(at) - 1)
        first, k = np.cumsum(count) - count, np.arange(len(start))
        single = self.roll.span(self.roll.prefix(data), start, end)
        padded = np.concatenate([single, np.zeros(self.words, U)])
        size = np.minimum(count[doc], self.words)
        token = np.zeros(len(start), U)
        for j in range(self.words):
            token = np.where(j < size, mix(token * _SALT + padded[j : j + len(start)] + U(j + 1)), token)
        whole = (k + size <= (first + count)[doc]) & ((count[doc] >= self.words) | (k == first[doc]))
        key = np.sort((doc[whole].astype(U) << U(56)) | (token[whole] >> U(8)))
        key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
        return (key >> U(56)).astype(np.int64), key & U((1 << 56) - 1)

    def ordered(self, doc: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens in the global order within their documents, and their ranks (0: rare)."""
        rank = np.zeros(len(token), np.int64)
        if len(self.frequent):
            place = np.minimum(np.searchsorted(self.frequent, token), len(self.frequent) - 1)
            hit = self.frequent[place] == token
            rank[hit] = self.rank[place[hit]]
        if rank.any():
            order = np.lexsort((token, rank, doc))
            token, rank = token[order], rank[order]
        return token, rank


def _names(doc: np.ndarray, token: np.ndarray, lo: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and name of each set; the name is a sum of mixed hashes."""
    size, name = np.bincount(doc - lo, minlength=n), np.zeros(n, U)
    some = np.flatnonzero(size)
    if len(some):
        name[some] = np.add.reduceat(mix(token ^ _SALT), (np.cumsum(size) - size)[some])
    return size, mix(name + size.astype(U)).view(np.int64)


def _prefix(size: np.ndarray, percent: int) -> np.ndarray:
    return size - (percent * size + 99) // 100 + 1


def _rows(columns: list, schema: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.values(), strict=True)], list(schema))


_BASE = {"rid": pa.int64(), "name": pa.int64(), "size": pa.int64(), "token": pa.int64(), "n": pa.int64()}
_PLACE = {"token": pa.int64(), "name": pa.int64(), "size": pa.int32(), "rank": pa.int32(), "last": pa.int64()}
_MEET = {"token": pa.int64(), "a": pa.int64(), "b": pa.int64(), "lack": pa.int32()}
_EDGE = {"a": pa.int64(), "b": pa.int64()}
_SQL = {pa.int64(): "bigint", pa.int32(): "int"}


def _sql(schema: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{k} {_SQL[t]}" for k, t in schema.items())


def _survey(docs: DataFrame, words: int) -> DataFrame:
    """A row (rid, name, size) for each document, and (token, n) for shingles that are frequent in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words, np.zeros(0, U))
        for batch in batches:
            data, at = utf8(batch.column("text"))
            rid, kept, sizes, names = batch.column("rid").to_numpy(), [], [], []
            seen: set[int] = set()
            for doc, token, lo in shingles.sets(data, at):
                size, name = _names(doc, token, lo, min(DOCS, len(rid) - lo))
                new = np.zeros(len(name), bool)
                for k, x in enumerate(name.tolist()):
                    new[k] = x not in seen
                    seen.add(x)
                kept.append(token[new[doc - lo]])
                sizes.append(size)
                names.append(name)
            if not len(rid):
                continue
            token = np.sort(np.concatenate(kept))
            first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
            n = np.diff(np.concatenate([first, [len(token)]]))
            token, n = token[first][n >= OFTEN].view(np.int64), n[n >= OFTEN]
            none, more = [None] * len(token), [None] * len(rid)
            yield _rows([[*rid.tolist(), *none], [*np.concatenate(names).tolist(), *none], [*np.concatenate(sizes).tolist(), *none], [*more, *token.tolist()], [*more, *n.tolist()]], _BASE)

    return docs.mapInArrow(run, _sql(_BASE))


def _places(docs: DataFrame, words: int, percent: int, frequent) -> DataFrame:
    """A row for each shingle of each prefix; equal sets of a batch give theirs once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words, frequent.value)
        for batch in batches:
            data, at = utf8(batch.column("text"))
            seen: set[int] = set()
            for doc, token, lo in shingles.sets(data, at):
                size, name = _names(doc, token, lo, min(DOCS, len(at) - 1 - lo))
                new = size > 0
                for k, x in enumerate(name.tolist()):
                    new[k] &= x not in seen
                    seen.add(x)
                token, rank = shingles.ordered(doc, token)
                place = np.arange(len(doc)) - (np.cumsum(size) - size)[doc - lo]
                use = new[doc - lo] & (place < _prefix(size, percent)[doc - lo])
                d, token, rank = (doc - lo)[use], token[use], rank[use]
                # The place of the prefix's last shingle in the global order.
                order = np.where(rank > 0, (1 << 57) + rank, token.view(np.int64))
                last = order[np.cumsum(np.bincount(d, minlength=len(size)))[d] - 1]
                yield _rows([token.view(np.int64), name[d], size[d], rank, last], _PLACE)

    return docs.mapInArrow(run, _sql(_PLACE))


def _meetings(percent: int):
    """Sorted prefix rows to pairs (a, b), a the smaller, or to members (a) of a group that meets whole.

    ``lack``: common prefix shingles that the pair needs. Once both prefixes are
    through, only the rest of the set whose prefix ends first can add to them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, "token", 50_000):
            token, name, size, rank, last = (rows.column(c).to_numpy().astype(np.int64) for c in _PLACE)
            again = np.concatenate([[False], (token[1:] == token[:-1]) & (name[1:] == name[:-1])])
            token, name, size, rank, last = (x[~again] for x in (token, name, size, rank, last))
            first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            group = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [len(token)]])))
            members = np.bincount(group)[group]
            whole = (rank > 0) | (members > FEW)
            # Partners of a row are the rows after it in its group, which are no smaller.
            later = np.where(whole, 0, first[group] + members - 1 - np.arange(len(token)))
            a = np.repeat(np.arange(len(token)), later)
            b = ragged(np.arange(len(token)) + 1, later)
            near = 100 * size[a] >= percent * size[b]
            a, b = a[near], b[near]
            need = -(-percent * (size[a] + size[b]) // (100 + percent))
            ends = np.where(last[a] <= last[b], size[a], size[b])
            lack = np.maximum(need - (ends - _prefix(ends, percent)), 1)
            w = np.flatnonzero(whole)
            b_name = pa.concat_arrays([pa.array(name[b]), pa.nulls(len(w), pa.int64())])
            yield _rows([np.concatenate([token[a], token[w]]), np.concatenate([name[a], name[w]]), b_name, np.concatenate([lack, np.zeros(len(w), np.int64)])], _MEET)

    return run


class PrefixTree:
    """Ordered sets as a trie: rows sorted by their tokens, with the length of the prefix each shares with the row before."""

    def __init__(self, rows: list[np.ndarray]) -> None:
        self.size = np.array([len(r) for r in rows], np.int64)
        order = sorted(range(len(rows)), key=lambda i: rows[i][:STEP].tobytes())
        self.order = np.array(order, np.int64)
        self.size = self.size[self.order]
        self.at = np.cumsum(self.size) - self.size
        self.flat = np.concatenate([rows[i] for i in order]) if rows else np.zeros(0, U)
        self.shared = np.zeros(len(rows), np.int64)
        for k in range(1, len(rows)):
            n = int(min(self.size[k - 1], self.size[k]))
            differ = self.flat[self.at[k - 1] : self.at[k - 1] + n] != self.flat[self.at[k] : self.at[k] + n]
            self.shared[k] = int(np.argmax(differ)) if differ.any() else n

    def walk(self, probe: np.ndarray, live: np.ndarray, percent: int) -> np.ndarray:
        """Rows (as given to the constructor) that are similar to ``probe`` (sorted by hash); ``live`` says which to consider."""
        need = -(-percent * (len(probe) + self.size) // (100 + percent))
        on = np.flatnonzero(live[self.order] & (np.minimum(self.size, len(probe)) >= need))
        overlap, depth = np.zeros(len(self.size), np.int64), 0
        done: list[int] = []
        while len(on):
            # A row whose whole step is shared with the live row just before takes over its count.
            follows = np.concatenate([[False], (on[1:] == on[:-1] + 1) & (self.shared[on[1:]] >= depth + STEP)])
            lead = on[~follows]
            length = np.clip(self.size[lead] - depth, 0, STEP)
            which = np.repeat(np.arange(len(lead)), length)
            tokens = self.flat[ragged(self.at[lead] + depth, length)]
            hit = probe[np.minimum(np.searchsorted(probe, tokens), len(probe) - 1)] == tokens
            step = np.bincount(which, weights=hit, minlength=len(lead)).astype(np.int64)
            by = np.cumsum(~follows) - 1
            overlap[on] += step[by]
            depth += STEP
            rest = np.minimum(np.maximum(self.size[on] - depth, 0), len(probe) - overlap[on])
            on = on[overlap[on] + rest >= need[on]]
            ended = self.size[on] <= depth
            done.extend(on[ended].tolist())
            on = on[~ended]
        return self.order[np.array(done, np.int64)]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, as they are shuffled twice."""
    pack = zstandard.ZstdCompressor(3).compress
    for batch in batches:
        data, at = utf8(batch.column("text"))
        view = memoryview(np.ascontiguousarray(data))
        texts = pa.array([pack(view[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("rid"), texts], ["rid", "text"])


def _joined(words: int, percent: int, frequent):
    """Rows (meet, block, probe, rid, text) sorted by meet to links that join classes within a meeting."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, unpack = Shingles(words, frequent.value), zstandard.ZstdDecompressor().decompress
        for rows in whole_groups(batches, "meet", 2_000):
            texts = [unpack(x) for x in rows.column("text").to_pylist()]
            data, at = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(x) for x in texts])
            sets: list[np.ndarray] = []
            for doc, token, lo in shingles.sets(data, at):
                size = np.bincount(doc - lo, minlength=min(DOCS, len(at) - 1 - lo))
                # The other way round, as what many sets of a meeting share is what is frequent: so they share paths of the trie.
                sets.extend(x[::-1] for x in np.split(shingles.ordered(doc, token)[0], np.cumsum(size)[:-1]))
            meet, rid, probe, block = (rows.column(c).to_numpy() for c in ("meet", "rid", "probe", "block"))
            first = np.flatnonzero(np.concatenate([[True], meet[1:] != meet[:-1]]))
            a, b = [], []
            for lo, hi in zip(first, np.concatenate([first[1:], [len(meet)]]), strict=True):
                for i, j in _links(sets[lo:hi], probe[lo:hi], block[lo:hi], percent):
                    a.append(rid[lo + i])
                    b.append(rid[lo + j])
            yield _rows([np.minimum(a, b) if a else [], np.maximum(a, b) if a else []], _EDGE)

    return run


def _links(sets: list[np.ndarray], probe: np.ndarray, block: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Links between probes and other rows that join two classes of the meeting.

    Rows of two blocks are compared across the blocks only, as each block has a meeting of its own.
    """
    tree = PrefixTree(sets)
    label = np.arange(len(sets))
    cross = block.min() != block.max()
    for i in np.flatnonzero(probe):
        live = label != label[i]
        if probe.all():
            live[: i + 1] = False
        if cross:
            live &= block != block[i]
        if not live.any():
            continue
        for j in tree.walk(np.sort(sets[i]), live, percent):
            if label[i] != label[j]:
                label[label == label[j]] = label[i]
                yield int(i), int(j)


def _forest(most: int):
    """The edges of a task as stars: each node with the least node that the task's edges reach from it; at most ``most`` nodes are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = parent[up]
                x = up
            return x

        for batch in batches:
            for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                x, y = root(x), root(y)
                parent[max(x, y)] = min(x, y)
                if len(parent) >= most:
                    yield _rows([[root(x) for x in parent], list(parent)], _EDGE)
                    parent.clear()
        yield _rows([[root(x) for x in parent], list(parent)], _EDGE)

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of ``edges`` (a, b): the smallest node that is reachable.

    By contraction, the same way at every size. The edges are spread over as
    many tasks as a shuffle has, each of which turns its own into stars. A node then
    has one root from each task at most; the least is its label, and the others are joined to that
    one by the edges of the next round, in which only roots are left. Every round
    has an ``EIGHTH`` of the tasks of the one before, but one for ``FOREST`` edges at least, and leaves at
    most two thirds of the nodes of a path with random names, and far less of stars.
    At the end the labels of each round are looked up in those of the next.
    """
    tasks, levels = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), []
    while True:
        stars = edges.repartition(tasks, "a", "b").mapInArrow(_forest(FOREST), _sql(_EDGE))
        marked = saved(stars.withColumn("low", F.min("a").over(W.partitionBy("b"))))
        levels.append(marked.groupBy(F.col("b").alias("node")).agg(F.min("low").alias("label")))
        edges = saved(marked.where("a <> low").select(F.col("low").alias("a"), F.col("a").alias("b")).distinct())
        left = edges.count()
        if not left:
            break
        tasks = max(1, tasks // EIGHTH, -(-left // FOREST))
    out = levels.pop()
    while levels:
        higher = out.select(F.col("node").alias("up"), F.col("label").alias("higher"))
        out = levels.pop().join(higher, F.col("label") == F.col("up"), "left").select("node", F.coalesce("higher", "label").alias("label"))
    return saved(out)


def _dealt(crowds: DataFrame, percent: int) -> DataFrame:
    """Sets (name, rid, size, crowd) to their meetings (meet, block, probe, rid).

    The sets of a crowd are put into blocks by size, and a block meets itself and
    those behind it whose sizes are near enough. Sets of one size are spread by
    hash over the blocks that their number fills, so what is ordered is a row for
    each size of a crowd and not its sets.
    """
    crowds = saved(crowds)
    sizes = crowds.groupBy("crowd", "size").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("crowd").orderBy("size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    spread = crowds.join(sizes.withColumn("before", before), ["crowd", "size"])
    place = F.col("before") + F.pmod(F.xxhash64("name"), F.col("n"))
    dealt = saved(spread.select("crowd", F.floor(place / BLOCK).cast("int").alias("block"), "rid", "size"))
    blocks = dealt.groupBy("crowd", "block").agg(F.min("size").alias("low"), F.max("size").alias("high"))
    later = blocks.select("crowd", F.col("block").alias("other"), F.col("low").alias("least"))
    near = (F.col("block") <= F.col("other")) & (100 * F.col("high") >= percent * F.col("least"))
    met = blocks.join(later, "crowd").where(near)
    meet = F.xxhash64(F.lit("crowd"), "crowd", "block", "other")
    met = met.select("crowd", meet.alias("meet"), F.explode(F.array_distinct(F.array("block", "other"))).alias("block"))
    return dealt.join(met, ["crowd", "block"]).select("meet", "block", F.lit(True).alias("probe"), "rid")


def classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(rid, size, class) of ``docs`` (rid, text): number of shingles, and the smallest rid of the class."""
    spark = docs.sparkSession
    docs = docs.select("rid", "text")
    survey = saved(_survey(docs, words))
    base = survey.where("rid IS NOT NULL").select("rid", "name", "size")
    often = survey.where("token IS NOT NULL").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "token").limit(MOST_FREQUENT).collect()
    frequent = spark.sparkContext.broadcast(np.array([r["token"] for r in reversed(often)], np.int64).view(U))
    leaders = base.where("size > 0").groupBy("name").agg(F.min("rid").alias("leader"), F.first("size").alias("size"))

    places = _places(docs, words, percent, frequent)
    places = places.repartition(F.when(F.col("rank") > 0, F.xxhash64("token", "name")).otherwise(F.xxhash64("token"))).sortWithinPartitions("token", "size", "name")
    met = saved(places.mapInArrow(_meetings(percent), _sql(_MEET)))
    # Shingles of a prefix that are under groups that meet whole are not counted by pairs, but may be common.
    held = met.where("b IS NULL").groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    pairs = met.where("b IS NOT NULL").groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"), F.max("lack").alias("lack"))
    for c in ("a", "b"):
        pairs = pairs.join(held.select(F.col("a").alias(c), F.col("n").alias(f"{c}_held")), c, "left")
    pairs = pairs.where(F.col("common") + F.least(F.coalesce("a_held", F.lit(0)), F.coalesce("b_held", F.lit(0))) >= F.col("lack")).select("a", "b")
    pairs = pairs.select(F.col("a").alias("meet"), F.explode(F.array(F.struct(F.lit(True).alias("probe"), F.col("a").alias("name")), F.struct(F.lit(False).alias("probe"), F.col("b").alias("name")))).alias("x"))
    pairs = pairs.select("meet", F.lit(0).alias("block"), "x.probe", "x.name").distinct()
    # Sets that meet whole under any shingle are one crowd: each goes there once, and all of its pairs are compared there.
    members = met.where("b IS NULL").select("token", "a").distinct()
    shared = members.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ties = members.join(shared.select("token"), "token").select("a", F.xxhash64(F.lit("shingle"), "token").alias("b"))
    crowds = members.select("a").distinct().join(components(ties), F.col("a") == F.col("node")).join(leaders, F.col("a") == F.col("name"))
    visits = pairs.join(leaders, "name").select("meet", "block", "probe", F.col("leader").alias("rid")).unionByName(_dealt(crowds.select("name", F.col("leader").alias("rid"), "size", F.col("label").alias("crowd")), percent))
    fetched = docs.mapInArrow(_packed, "rid bigint, text binary").join(visits, "rid").select("meet", "block", "probe", "rid", "text")
    edges = (fetched.repartition("meet").sortWithinPartitions("meet", "rid").mapInArrow(_joined(words, percent, frequent), _sql(_EDGE)))
    labels = components(edges)
    # Saved, so that both sides of the last join are plain exchanges and Spark can split a set that very many documents have.
    named = saved(leaders.join(labels, leaders["leader"] == labels["node"], "left").select("name", F.coalesce("label", "leader").alias("class")))
    out = base.join(named, "name", "left").select("rid", "size", F.coalesce("class", "rid").alias("class"))
    return out


def components_of(docs: DataFrame, words: int = QUERY_WORDS, percent: int = QUERY_PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of each document."""
    rows = keyed(docs.select("doc_id", text_of().alias("text")))
    found = classes(rows, words, percent)
    ids = rows.select("rid", "doc_id")
    # Where the ids were numbered anew the smallest doc_id of a class is looked up; else rid is doc_id.
    if rows.where(~F.col("rid").eqNullSafe(F.col("doc_id"))).limit(1).count():
        found = found.join(ids, "rid")
        least = found.groupBy("class").agg(F.min("doc_id").alias("component_id"))
        found = found.join(least, "class")
    else:
        found = found.select(F.col("rid").alias("doc_id"), "size", F.col("class").alias("component_id"))
    return found.select("doc_id", F.col("size").alias("n_shingles"), "component_id")


def dedup(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each class, the first by doc_id; texts without words all stay."""
    names = [f"`{c}`" for c in docs.columns]
    packed = docs.select(F.struct(*names).alias("row"), "doc_id", F.col("text").alias("_text"))
    rows = keyed(packed.withColumnRenamed("_text", "text"))
    first = classes(rows.select("rid", text_of().alias("text")), words, percent).where(F.col("rid") == F.col("class"))
    return rows.join(first.select("rid"), "rid", "left_semi").select("row.*")


def op5_prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components_of(table(spark, sf_dir, "documents"))


QUERIES = {"op5_prefix_tree_join": op5_prefix_tree_join}
ORACLES: dict[str, str] = {}
