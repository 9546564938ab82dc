"""Suffix-array dedup: hash-compared suffix sort.

Every byte covered by a string of ``WINDOW`` bytes that also starts earlier (in
a smaller document, or further left in the same one) is removed.

1. Each window is owned by the leftmost of its least-hashed ``GRAM``-byte
   substrings, its anchor. Equal windows have equal anchors at equal offsets, so
   only the windows of equal anchors need to meet. An occurrence of an anchor
   stands for all windows it owns (about 3 rows for 100 bytes of text). Within a
   batch, occurrences with equal contexts are reduced to the first before they
   are shuffled.
2. Occurrences are shuffled by anchor. Those with the hash of an earlier whole
   context are removed outright; anchors whose contexts differ go on.
3. For these the contexts are fetched from the documents, and per anchor the
   suffixes that start at it are sorted by a mergesort whose comparisons find
   the common extension of two suffixes by binary search over prefix polynomial
   hashes. The common extensions of neighbours split the sorted suffixes into
   classes for every length; a class and the hash of the bytes left of the
   anchor name a window, and all but its first occurrence are removed. Every
   equality that is used is verified on the bytes; a batch with a collision is
   done again by comparing the bytes themselves. The whole-context equality of
   step 2 is not verified: it rests on a 64-bit hash of the whole context beside
   another one of its 24-byte anchor.
4. The removed ranges go back to their documents.

Anchors with many contexts (an edge of a very common passage) are found first,
by counts over all documents of what has two contexts or more in some batch;
they are not gathered by anchor, but each of their windows is dealt on its own
hash. That list only chooses how rows are dealt, never what is compared, and
holds at most ``MOST_HOT`` anchors, the most frequent ones; the others are
gathered by anchor.

Edge cases: a null text is an empty one; texts under ``WINDOW`` bytes keep all
bytes; repeated rows and rows that share a doc_id count as documents one after
the other in the order of (doc_id with nulls first, text), so a later copy is
removed; an empty table gives an empty result; only ``doc_id`` and ``text`` are
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed, saved, table, text_of, whole_groups
from .rolling import U, Rolling, mix, ragged, utf8

WINDOW, GRAM = 100, 24
REACH = WINDOW - GRAM + 1
#: Contexts of one anchor, over all batches, from which it counts as hot, and the most hot anchors (8 bytes each, sent to all tasks).
HOT, MOST_HOT = 256, 200_000
#: Windows handled at once while anchors are sought; contexts sorted at once.
BLOCK, CONTEXTS = 1_000_000, 20_000
_LOW = U((1 << 24) - 1)

_ROWS = "kind int, k1 bigint, k2 bigint, rid bigint, start int, shape int"
_NAMES = ["kind", "k1", "k2", "rid", "start", "shape"]
#: Kinds of rows: an occurrence of an anchor, a removed range (shape: its length), a window of a hot anchor.
ANCHOR, REMOVED, LOOSE = 0, 1, 2


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


class Anchors:
    """Owned runs of windows in a buffer of documents."""

    def __init__(self) -> None:
        self.one, self.two = Rolling(1), Rolling(2, 0xC2B2AE3D27D4EB4F)

    def runs(self, data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """For blocks of the buffer: document, first window, its distance to the anchor, number of windows, anchor hash, context hash, and the prefix hashes with the block's place."""
        for lo in range(0, len(data) - WINDOW + 1, BLOCK):
            part = data[lo : lo + BLOCK + WINDOW - 1]
            one, two = self.one.prefix(part), self.two.prefix(part)
            n = len(part) - WINDOW + 1
            gram = mix((one[GRAM:] - one[:-GRAM]) * self.one.down[: len(part) - GRAM + 1])
            owner = (_least((gram & ~_LOW) | np.arange(len(gram), dtype=U), REACH)[:n] & _LOW).astype(np.int64)
            first = np.arange(lo, lo + n)
            doc = np.searchsorted(at, first, "right") - 1
            good = first + WINDOW <= at[doc + 1]
            new = good.copy()
            new[1:] &= (owner[1:] != owner[:-1]) | (doc[1:] != doc[:-1]) | ~good[:-1]
            p = np.flatnonzero(new)
            if not len(p):
                continue
            ends = np.flatnonzero(good & ~np.concatenate([good[1:] & ~new[1:], [False]]))
            count, offset = ends - p + 1, owner[p] - p
            context = mix(self.two.span(two, p, ends + WINDOW) + (offset * 128 + count).astype(U) * U(0x9E3779B97F4A7C15))
            yield doc[p], p + lo, offset, count, gram[owner[p]], context, one, two, lo


def _merged(rid: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of each document with overlapping and touching ones joined."""
    if not len(rid):
        return rid, start, end
    order = np.lexsort((start, rid))
    rid, start, end = rid[order], start[order], end[order]
    group = np.cumsum(np.concatenate([[True], rid[1:] != rid[:-1]])) - 1
    span = int(end.max()) + 1
    far = np.maximum.accumulate(end + group * span) - group * span
    new = np.concatenate([[True], (rid[1:] != rid[:-1]) | (start[1:] > far[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(rid)]]) - 1
    return rid[first], start[first], far[last]


def _batch(columns: list, names: list[str] = _NAMES) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)


def _occurrences(anchors: Anchors, batch: pa.RecordBatch, hot: np.ndarray) -> tuple[dict[str, np.ndarray], list[np.ndarray]]:
    """Rows of one batch, with equal (k1, k2) reduced to the first, and the ranges removed by that."""
    data, at = utf8(batch.column("text"))
    rid = batch.column("rid").to_numpy()
    parts = []
    for doc, p, offset, count, k1, k2, one, two, lo in anchors.runs(data, at):
        start = p - at[doc]
        loose = np.isin(k1, hot) if len(hot) else np.zeros(len(k1), bool)
        parts.append((np.full((~loose).sum(), ANCHOR), k1[~loose], k2[~loose], rid[doc[~loose]], start[~loose], (offset * 128 + count)[~loose]))
        if loose.any():
            n = count[loose]
            w = ragged(p[loose] - lo, n)
            h = anchors.one.span(one, w, w + WINDOW)
            again = np.repeat(k1[loose], n)
            parts.append((np.full(len(w), LOOSE), mix(again ^ h), anchors.two.span(two, w, w + WINDOW), np.repeat(rid[doc[loose]], n), ragged(start[loose], n), np.ones(len(w), np.int64)))
    kind, k1, k2, r, start, shape = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 6
    order = np.lexsort((start, r, k2, k1))
    kind, k1, k2, r, start, shape = (x[order] for x in (kind, k1, k2, r, start, shape))
    first = np.ones(len(k1), bool)
    first[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
    gone = _merged(r[~first], start[~first], start[~first] + shape[~first] % 128 + WINDOW - 1)
    rows = {"kind": kind[first], "k1": k1[first].astype(U).view(np.int64), "k2": k2[first].astype(U).view(np.int64), "rid": r[first], "start": start[first], "shape": shape[first]}
    return rows, list(gone)


def hot_anchors(docs: DataFrame) -> np.ndarray:
    """Anchors that have many different contexts, the most frequent ones, counted over all documents; one context in a batch is not counted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors()
        for batch in batches:
            rows, _ = _occurrences(anchors, batch, np.zeros(0, U))
            key, n = np.unique(rows["k1"], return_counts=True)
            yield _batch([key[n > 1], n[n > 1]], ["k1", "n"])

    found = docs.mapInArrow(count, "k1 bigint, n bigint").groupBy("k1").agg(F.sum("n").alias("n"))
    rows = found.where(F.col("n") >= HOT).orderBy(F.col("n").desc(), "k1").limit(MOST_HOT).select("k1").toArrow()
    return np.sort(rows.column("k1").to_numpy().astype(np.int64).view(U))


def _first_pass(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors()
        for batch in batches:
            rows, (rid, start, end) = _occurrences(anchors, batch, sent.value)
            spread = mix(np.arange(len(rid), dtype=U) * U(31) + rid.astype(U)).view(np.int64)
            none = np.zeros(len(rid), np.int64)
            gone = [none + REMOVED, spread, none, rid, start, end - start]
            types = (np.int32, np.int64, np.int64, np.int64, np.int32, np.int32)
            yield _batch([np.concatenate([rows[n], g]).astype(t) for n, g, t in zip(_NAMES, gone, types, strict=True)])

    return docs.mapInArrow(run, _ROWS)


def _by_anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (k1, k2, rid, start): removed ranges, and the first occurrence of each context that has rivals."""
    for rows in whole_groups(batches, "k1", 100_000):
        kind, k1, k2, rid, start, shape = (rows.column(n).to_numpy() for n in _NAMES)
        given = kind == REMOVED
        first = np.ones(len(k1), bool)
        first[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
        group = np.cumsum(np.concatenate([[True], k1[1:] != k1[:-1]])) - 1
        rivals = np.bincount(group, weights=first & (kind == ANCHOR))[group] > 1
        gone = given | ~first
        length = np.where(given, shape, shape % 128 + WINDOW - 1)
        needs = first & rivals & (kind == ANCHOR)
        keep = gone | needs
        yield _batch([np.where(gone, REMOVED, ANCHOR)[keep].astype(np.int32), k1[keep], rid[keep], start[keep], np.where(gone, length, shape)[keep].astype(np.int32)], ["kind", "k1", "rid", "start", "shape"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the contexts that each document was asked for."""
    for batch in batches:
        data, at = utf8(batch.column("text"))
        wanted = batch.column("wanted")
        n = np.diff(wanted.offsets.to_numpy())
        flat = wanted.flatten()
        start, k1, shape = (flat.field(i).to_numpy() for i in range(3))
        doc = np.repeat(np.arange(len(n)), n)
        for lo in range(0, len(doc), 50_000):
            d, s, k, x = (v[lo : lo + 50_000] for v in (doc, start, k1, shape))
            length = (x % 128 + WINDOW - 1).astype(np.int64)
            flat_bytes = data[ragged(at[d] + s, length)]
            offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
            context = pa.Array.from_buffers(pa.binary(), len(d), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat_bytes))])
            yield _batch([k, batch.column("rid").to_numpy()[d], s, x, context], ["k1", "rid", "start", "shape", "context"])


class Sorter:
    """Suffixes at the anchors of one batch of contexts, sorted within their groups."""

    def __init__(self, data: np.ndarray, suffix: np.ndarray, length: np.ndarray, group: np.ndarray, roll: Rolling) -> None:
        self.data, self.suffix, self.length, self.group, self.roll = data, suffix, length, group, roll
        self.prefix = roll.prefix(data)

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common extension of suffixes i and j, by binary search over prefix hashes."""
        lo, hi = np.zeros(len(i), np.int64), np.minimum(self.length[i], self.length[j])
        si, sj = self.suffix[i], self.suffix[j]
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            same = self.roll.span(self.prefix, si, si + mid) == self.roll.span(self.prefix, sj, sj + mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def less(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether suffix i is below suffix j, by the byte behind their common extension."""
        n = self.extension(i, j)
        a = np.where(n < self.length[i], self.data[self.suffix[i] + n].astype(np.int64), -1)
        b = np.where(n < self.length[j], self.data[self.suffix[j] + n].astype(np.int64), -1)
        return a < b

    def sort(self) -> np.ndarray:
        """Bottom-up mergesort of all groups at once; blocks are merged by ranking each element in the other block."""
        n = len(self.suffix)
        order = np.arange(n)
        first = np.searchsorted(self.group, self.group)
        size = np.searchsorted(self.group, self.group, "right") - first
        place = np.arange(n) - first
        width = 1
        while width < size.max(initial=0):
            block = place // width
            other = (block ^ 1) * width
            x = np.flatnonzero(other < size)
            left = block[x] % 2 == 0
            base, mine = first[x], order[x]
            start = base + other[x]
            lo, hi = start.copy(), base + np.minimum(other[x] + width, size[x])
            while (live := np.flatnonzero(lo < hi)).size:
                mid = (lo[live] + hi[live]) // 2
                them, me = order[mid], mine[live]
                # Left elements pass those below them, right elements pass those not above them.
                l = left[live]
                before = self.less(np.where(l, them, me), np.where(l, me, them))
                passed = np.where(l, before, ~before)
                lo[live], hi[live] = np.where(passed, mid + 1, lo[live]), np.where(passed, hi[live], mid)
            new = base + (block[x] & ~1) * width + (place[x] - block[x] * width) + (lo - start)
            merged = order.copy()
            merged[new] = mine
            order = merged
            width *= 2
        return order


def _repeats(data: np.ndarray, start: np.ndarray, offset: np.ndarray, count: np.ndarray, group: np.ndarray, rank: np.ndarray, roll: Rolling) -> np.ndarray:
    """For each context and each of its windows whether an earlier context of its group has the same one.

    Contexts are sorted by group; ``rank`` is their order in the corpus. Every
    window of a context holds its anchor, so ``count`` is at most ``offset + 1``.
    """
    n = len(start)
    assert (count <= offset + 1).all()
    suffix = start + offset
    length = count - 1 + WINDOW - offset
    view = np.lib.stride_tricks.sliding_window_view(data, WINDOW)
    sorter = Sorter(data, suffix, length, group, roll)
    order = sorter.sort()
    near = np.full(n, -1, np.int64)
    same = np.flatnonzero(group[order[1:]] == group[order[:-1]]) + 1
    a, b = order[same - 1], order[same]
    near[same] = sorter.extension(a, b)
    # Neighbours must share what the hashes say, and be in order behind it; then all equal suffixes stand together.
    sound = bool(((view[suffix[a]] == view[suffix[b]]) | (np.arange(WINDOW) >= near[same][:, None])).all())
    behind = [np.where(near[same] < length[x], data[suffix[x] + np.minimum(near[same], length[x])].astype(np.int64), -1) for x in (a, b)]
    sound &= bool((behind[0] <= behind[1]).all())
    out = np.zeros((n, REACH + 1), bool)
    for o in range(REACH):
        x = order_o = np.flatnonzero((offset[order] >= o) & (offset[order] - count[order] < o))
        if len(order_o) < 2:
            continue
        cluster = np.cumsum(near < WINDOW - o)[x]
        i = order[x]
        left = roll.span(sorter.prefix, suffix[i] - o, suffix[i])
        by = np.lexsort((rank[i], left, cluster))
        i, cluster, left = i[by], cluster[by], left[by]
        first = np.concatenate([[True], (cluster[1:] != cluster[:-1]) | (left[1:] != left[:-1])])
        source = i[np.flatnonzero(first)[np.cumsum(first) - 1]]
        again = i[~first]
        sound &= bool((view[suffix[again] - o] == view[suffix[source[~first]] - o]).all())
        out[again, offset[again] - o] = True
    if not sound:  # two different strings share a hash: compare the bytes themselves
        seen: set[tuple[int, int, bytes]] = set()
        out[:] = False
        for i in np.lexsort((rank, group)):
            for j in range(count[i]):
                key = (int(group[i]), int(offset[i] - j), data[start[i] + j : start[i] + j + WINDOW].tobytes())
                out[i, j] = key in seen
                seen.add(key)
    return out


def _by_suffix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by anchor to the ranges that an earlier context repeats."""
    roll = Rolling(3)
    for rows in whole_groups(batches, "k1", CONTEXTS):
        data, at = utf8(rows.column("context").combine_chunks() if isinstance(rows.column("context"), pa.ChunkedArray) else rows.column("context"))
        data = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
        k1, rid, start, shape = (rows.column(n).to_numpy() for n in ("k1", "rid", "start", "shape"))
        group = np.cumsum(np.concatenate([[True], k1[1:] != k1[:-1]])) - 1
        rank = np.empty(len(rid), np.int64)
        rank[np.lexsort((start, rid))] = np.arange(len(rid))
        again = _repeats(data, at[:-1], (shape // 128).astype(np.int64), (shape % 128).astype(np.int64), group, rank, roll)
        edge = np.diff(np.pad(again, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, first = np.nonzero(edge == 1)
        _, last = np.nonzero(edge == -1)
        yield _batch([rid[row], (start[row] + first).astype(np.int32), (last - first + WINDOW - 1).astype(np.int32)], ["rid", "start", "shape"])


def removed_ranges(docs: DataFrame) -> DataFrame:
    """rid, start and shape (length) of removed ranges of ``docs`` (rid, text); ranges of a document may overlap."""
    dealt = _first_pass(docs, hot_anchors(docs)).repartition("k1").sortWithinPartitions("k1", "k2", "rid", "start")
    rows = saved(dealt.mapInArrow(_by_anchor, "kind int, k1 bigint, rid bigint, start int, shape int"))
    wanted = rows.where(F.col("kind") == ANCHOR).groupBy("rid").agg(F.collect_list(F.struct("start", "k1", "shape")).alias("wanted"))
    asked = docs.repartition("rid").join(wanted, "rid").select("rid", "text", "wanted")
    contexts = asked.mapInArrow(_contexts, "k1 bigint, rid bigint, start int, shape int, context binary")
    sorted_ = contexts.repartition("k1").sortWithinPartitions("k1")
    more = sorted_.mapInArrow(_by_suffix, "rid bigint, start int, shape int")
    return rows.where(F.col("kind") == REMOVED).select("rid", "start", "shape").unionByName(more)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """For each row: the bytes, the mask of those kept, and the number of removed runs."""
    for batch in batches:
        data, at = utf8(batch.column("text"))
        ranges = batch.column("ranges").fill_null([]) if batch.column("ranges").null_count else batch.column("ranges")
        for k, found in enumerate(ranges.to_pylist()):
            text = data[at[k] : at[k + 1]]
            depth = np.zeros(len(text) + 1, np.int64)
            for r in found:
                depth[r["start"]] += 1
                depth[r["start"] + r["shape"]] -= 1
            keep = np.cumsum(depth[:-1]) == 0
            runs = int((~keep[:1]).sum() + (keep[:-1] & ~keep[1:]).sum())
            yield batch, k, text, keep, runs


def _ranged(docs: DataFrame) -> DataFrame:
    ranges = removed_ranges(docs.select("rid", "text")).groupBy("rid").agg(F.collect_list(F.struct("start", "shape")).alias("ranges"))
    empty = F.array().cast("array<struct<start:int,shape:int>>")
    return docs.select("rid", "text").repartition("rid").join(ranges, "rid", "left").withColumn("ranges", F.coalesce("ranges", empty))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each document."""
    rows = keyed(docs.select("doc_id", text_of().alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(len(t), int((~keep).sum()), runs, hashlib.sha256(t[keep].tobytes()).hexdigest()) for _, _, t, keep, runs in _kept(iter([batch]))]
            columns = list(zip(*found, strict=True)) if found else [(), (), (), ()]
            yield _batch([batch.column("rid"), *[pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]], ["rid", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    out = _ranged(rows).mapInArrow(run, "rid bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    if rows.schema["doc_id"].dataType == rows.schema["rid"].dataType and not _renumbered(rows):
        return out.withColumnRenamed("rid", "doc_id")
    return rows.select("rid", "doc_id").join(out, "rid").drop("rid")


def _renumbered(rows: DataFrame) -> bool:
    """Whether :func:`keyed` had to number the rows anew."""
    return rows.where(~F.col("rid").eqNullSafe(F.col("doc_id"))).limit(1).count() > 0


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated bytes taken out of the text (what is left of a character that is cut goes too); all columns stay, whatever their names."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = keyed(docs.select(row.alias("_row"), "doc_id", text_of().alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [t[keep].tobytes().decode("utf-8", "ignore") for _, _, t, keep, _ in _kept(iter([batch]))]
            yield _batch([batch.column("rid"), pa.array(kept, pa.string())], ["rid", "_kept"])

    out = _ranged(rows).mapInArrow(run, "rid bigint, _kept string")
    return rows.join(out, "rid").select(*[F.col("_kept" if c == "text" else f"_row.`{c}`").alias(c) for c in docs.columns])


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


QUERIES = {"op3_suffix_dedup": op3_suffix_dedup}
ORACLES: dict[str, str] = {}
