"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Both the benchmark items and the documents are normalised to lower-case words
one space apart. They are embedded by the same random walks: at each step the
current symbol is written, and the walk moves on if a random bit of (step,
symbol) says so; edit distance becomes Hamming distance. Some of the steps of a
walk, taken at random, are a sample, and what the walk wrote there a bucket key.

A walk that has lost its place rarely finds it again, so it says little about
what is far behind an edit. So the walks start anew at each word (and at each
character of three bytes or more, as some scripts have no spaces): an item is
known by the samples of all its walks, and so is a document. An item-sized
window is laid over a document, anywhere, where samples of enough different
walks (``n / SHARE`` of the item's n, at least 1 and at most ``VOTES``) share
buckets with the item and agree, within its edits and ``SLACK`` bytes, on where
it starts. Every such window is verified by the exact edit distance between the
item and the best substring of the window with its surroundings.

``FAMILIES`` says how many steps, walks and samples the items of a length have:
enough for a recall of 0.9 at every edit distance up to ``EDITS``. The table does
not depend on the data, nothing is capped, and there are no exact seeds.

The benchmark is sent to the tasks in blocks of at most ``BLOCK_BYTES``, one
pass of narrow work for each, with the result so far written in between, so
that one block is alive at a time. No shuffle is needed. Documents are read
whole, in chunks of bounded size.

Edge cases: null and empty texts and items match nothing; an item with a null
id counts like any other and is reported as null; equal items are all reported;
items of five bytes or less must begin with the right byte, and those under
five match exactly; repeated rows are judged each on its own; an empty table of
either kind gives no match; columns of other names pass through :func:`clean`
unchanged, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table
from .rolling import U, mix, ragged

#: Largest edit distance of a match, as a share of the item's length.
EDITS = 0.2
#: Items by their least length in bytes: steps of a walk, positions of a sample, walks, samples of each walk.
FAMILIES = [(64, 32, 10, 2, 6), (24, 20, 7, 2, 12), (12, 12, 5, 4, 8), (6, 6, 3, 4, 4), (1, 1, 1, 1, 1)]
#: A window needs agreement of one walk in this many, but of no more than so many walks.
SHARE, VOTES = 9, 3
#: Bytes by which walks may differ beyond the item's edits in where they say that it starts.
SLACK = 16
#: Bytes of benchmark text in a block; bytes of document text handled at once.
BLOCK_BYTES, CHUNK_BYTES = 4_000_000, 8_000_000
#: Walks advanced at once; shared buckets handled at once; 64-bit words of the patterns verified at once, and of one such pattern.
STARTS, SEEDS, WORDS, LONGEST = 20_000, 8_000_000, 16_384, 8

_LOWER = np.full(256, 32, np.uint8)
for _c in range(256):
    if _c >= 128 or chr(_c).isalnum():
        _LOWER[_c] = ord(chr(_c).lower()) if _c < 128 else _c
_SEPARATOR = 1


def normalise(text: bytes) -> np.ndarray:
    """Lower-case words one space apart, as bytes."""
    data = _LOWER[np.frombuffer(text, np.uint8)]
    gap = data == 32
    keep = ~gap
    keep[1:] |= gap[1:] & ~gap[:-1]
    data = data[keep]
    return data[(data[:1] == 32).sum() : len(data) - (data[-1:] == 32).sum()]


def edits_within(item: bytes, text: bytes) -> int:
    """Least edit distance between ``item`` and any substring of ``text`` (bit-parallel)."""
    m = len(item)
    masks: dict[int, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, m
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        plus = down | ~(xh | up) & full
        minus = up & xh
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus = plus << 1 & full
        minus = minus << 1 & full
        up = minus | ~(xv | plus) & full
        down = plus & xv
        best = min(best, score)
    return best


def edits_of(items: list[bytes], which: np.ndarray, data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """:func:`edits_within` of ``items[which]`` and ``data[lo:hi]``, for many pairs at once."""
    words, out = np.array([-(-len(items[k]) // 64) for k in which], np.int64), np.zeros(len(which), np.int64)
    for k in np.flatnonzero(words > LONGEST):
        out[k] = edits_within(items[which[k]], data[lo[k] : hi[k]].tobytes())
    order = np.argsort(words, kind="stable")[: int((words <= LONGEST).sum())]
    for at in range(0, len(order), WORDS // LONGEST):
        part = order[at : at + WORDS // LONGEST]
        out[part] = _batched(items, which[part], int(words[part].max()), data, lo[part], hi[part])
    return out


def _batched(items: list[bytes], which: np.ndarray, n: int, data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The bit-parallel table of :func:`edits_within` in ``n`` words, a column of numpy for each pair.

    Items end at the last bit; the rows before them match everything and cost nothing, like a start anywhere.
    """
    distinct, place = np.unique(which, return_inverse=True)
    masks, rows, one, row = np.empty((n, len(distinct), 256), U), np.empty((n, len(distinct)), U), U(1), place * 256
    for i, k in enumerate(distinct):
        codes = np.frombuffer(items[k], np.uint8)
        free = 64 * n - len(codes)
        bits = np.zeros((257, 64 * n), bool)
        bits[codes, np.arange(free, 64 * n)] = True
        bits[:256, :free] = bits[256, free:] = True
        packed = np.packbits(bits, axis=1, bitorder="little").view("<u8").T
        masks[:, i], rows[:, i] = packed[:, :256], packed[:, 256]
    masks = masks.reshape(n, -1)
    up, down = [rows[w][place] for w in range(n)], [np.zeros(len(which), U) for _ in range(n)]
    score, length = np.array([len(items[k]) for k in which], np.int64), hi - lo
    best = score.copy()
    for j in range(int(length.max(initial=0))):
        symbol = row + data[np.minimum(lo + j, len(data) - 1)]
        more = less = np.zeros(len(which), U)
        for w in range(n):
            eq = masks[w][symbol]
            xv = eq | down[w]
            eq |= less
            xh = (((eq & up[w]) + up[w]) ^ up[w]) | eq
            plus, minus = down[w] | ~(xh | up[w]), up[w] & xh
            shifted, fallen = (plus << one) | more, (minus << one) | less
            more, less = plus >> U(63), minus >> U(63)
            up[w], down[w] = fallen | ~(xv | shifted), shifted & xv
        score += more.view(np.int64) - less.view(np.int64)
        np.minimum(best, score, out=best, where=j < length)
    return best


class Family:
    """Items of like length: their walks, and the buckets of the walks' samples."""

    def __init__(self, items: list[np.ndarray], mine: np.ndarray, shape: tuple[int, int, int, int], edits: float, seed: int) -> None:
        self.steps, positions, walks, samples = shape
        rng = np.random.default_rng(seed)
        self.bits = rng.integers(0, 2, (walks, self.steps, 256))
        # One step of each equal part of the walk, so that every sample sees all of it.
        picks = ((np.arange(positions) + rng.random((walks, samples, positions))) * self.steps / positions).astype(np.int64)
        #: For each walk and step the samples that use it.
        self.uses = [[np.flatnonzero((walk == j).any(axis=1)).tolist() for j in range(self.steps)] for walk in picks]
        self.salt = rng.integers(0, 2**63, (walks, samples), dtype=U)
        #: The walks of the items: their item, and where they start in it.
        starts = [word_starts(items[k]) for k in mine]
        self.item, self.offset = np.repeat(mine, [len(s) for s in starts]), np.concatenate(starts)
        length = np.array([len(x) for x in items], np.int64)
        self.most = (edits * length).astype(np.int64)
        self.votes = np.zeros(len(items), np.int64)
        self.votes[mine] = np.clip(np.array([len(s) for s in starts]) // SHARE, 1, VOTES)
        ends = np.cumsum(length[mine] + self.steps + 1)
        data = np.zeros(int(ends[-1]), np.uint8)
        first = ends - length[mine] - self.steps - 1
        for a, k in zip(first, mine, strict=True):
            data[a : a + length[k]] = items[k]
        size = [len(s) for s in starts]
        end = np.repeat(first + length[mine], size)
        self.tables = []
        for key, last in self.samples(data, self.offset + np.repeat(first, size)):
            # Where a walk leaves its item, what follows in a document is not known.
            inside = np.flatnonzero(last < end)
            inside = inside[np.argsort(key[inside], kind="stable")]
            distinct, at = np.unique(key[inside], return_index=True)
            maybe = np.zeros(1 << 16, bool)
            maybe[(distinct >> U(48)).astype(np.int64)] = True
            self.tables.append((distinct, np.append(at, len(inside)), inside, maybe))

    def samples(self, data: np.ndarray, start: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each sample the bucket keys of the walks from ``start``, and the last place that each walk has read for it."""
        base = int(start.min(initial=0))
        # Numbers as wide as an index, so that no step converts them.
        symbols = data[base : int(start.max(initial=0)) + self.steps + 1].astype(np.int64)
        for bits, uses, salts in zip(self.bits, self.uses, self.salt, strict=True):
            at = start - base
            keys, last = [np.full(len(at), s, U) for s in salts], [at] * len(salts)
            for step, used in zip(bits, uses, strict=True):
                symbol = symbols[at]
                for k in used:
                    keys[k] *= U(0x100000001B3)
                    keys[k] ^= symbol.view(U)
                    last[k] = at
                at = at + step[symbol]
            yield from ((mix(k), x + base) for k, x in zip(keys, last, strict=True))

    def seeds(self, data: np.ndarray, start: np.ndarray, most: int | None) -> np.ndarray | None:
        """Distinct (walk of the documents, walk of an item) that share a bucket, as place * walks + walk; none if there are more than ``most``."""
        found, total = [np.zeros(0, np.int64)], 0
        for lo in range(0, len(start), STARTS):
            part = start[lo : lo + STARTS]
            for (key, _), (distinct, first, walk, maybe) in zip(self.samples(data, part), self.tables, strict=True):
                some = np.flatnonzero(maybe[(key >> U(48)).astype(np.int64)]) if len(distinct) else np.zeros(0, np.int64)
                which = np.minimum(np.searchsorted(distinct, key[some]), len(distinct) - 1)
                hit = distinct[which] == key[some] if len(some) else np.zeros(0, bool)
                some, which = some[hit], which[hit]
                n = first[which + 1] - first[which]
                total += int(n.sum())
                if most is not None and total > most:
                    return None
                found.append(np.repeat(part[some] * len(self.item), n) + walk[ragged(first[which], n)])
        return np.unique(np.concatenate(found))


def word_starts(data: np.ndarray) -> np.ndarray:
    """Where words and characters of three bytes or more start."""
    new = (data != 32) & (data != _SEPARATOR)
    new[1:] &= (data[:-1] == 32) | (data[:-1] == _SEPARATOR) | (data[1:] >= 0xE0)
    return np.flatnonzero(new)


class Matcher:
    """A block of the benchmark, prepared once in each task."""

    def __init__(self, items: list[tuple[int | None, str]], edits: float = EDITS, seed: int = 7) -> None:
        texts = [(i, normalise(t.encode())) for i, t in items if t]
        self.ids = [i for i, t in texts if len(t)]
        arrays = [t for _, t in texts if len(t)]
        self.items = [t.tobytes() for t in arrays]
        self.length = np.array([len(t) for t in arrays], np.int64)
        self.most = (edits * self.length).astype(np.int64)
        self.families = []
        left = np.ones(len(arrays), bool)
        for least, *shape in FAMILIES:
            mine = np.flatnonzero(left & (self.length >= least))
            left[mine] = False
            if len(mine):
                self.families.append(Family(arrays, mine, tuple(shape), edits, seed + least))

    def _windows(self, family: Family, data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, start) of the windows over ``data``; a window stands for all starts up to its item's band behind it.

        Places where very many items share a bucket are handled in parts that overlap by twice the longest item, down to parts of a few items' length.
        """
        longest, band = int(self.length.max(initial=0)), self.most + SLACK
        long = len(start) > 1 and start[-1] - start[0] > 8 * longest
        seeds = family.seeds(data, start, SEEDS if long else None)
        if seeds is None:
            middle = start[0] + (start[-1] - start[0]) // 2
            parts = [self._windows(family, data, x) for x in (start[start < middle + 2 * longest], start[start >= middle - 2 * longest])]
            item, at = np.unique(np.concatenate([np.stack(x) for x in parts], axis=1), axis=1)
            return item, at
        place, walk = np.divmod(seeds, len(family.item))
        span = len(data) + longest + 1
        key = np.sort(family.item[walk] * span + place - family.offset[walk] + longest)
        item = key // span
        end = np.arange(len(key)) + family.votes[item] - 1
        first = np.flatnonzero((end < len(key)) & (key[np.minimum(end, len(key) - 1)] - key <= band[item]))
        # The windows of an item are laid one band apart.
        item = item[first]
        item, at = np.unique(np.stack([item, (key[first] - item * span) // band[item]]), axis=1)
        return item, at * band[item] - longest

    def match(self, texts: list[bytes]) -> list[list[tuple[int | None, int]]]:
        """For each text the (item id, edit distance) of the items it holds, by item id, null first."""
        out: list[list[tuple[int | None, int]]] = [[] for _ in texts]
        if not self.items:
            return out
        parts = [normalise(t) for t in texts]
        bounds = np.cumsum([0] + [len(p) + 1 for p in parts])
        data = np.full(bounds[-1] + max(f.steps for f in self.families) + 1, _SEPARATOR, np.uint8)
        for b, p in zip(bounds, parts, strict=False):
            data[b : b + len(p)] = p
        start = word_starts(data)
        best: dict[tuple[int, int], int] = {}
        for family in self.families:
            item, at = self._windows(family, data, start)
            # The seeds' starts lie in [at, at + 2 * band]; a copy's own start is off by its edits at most.
            band, most = self.most[item] + SLACK, self.most[item]
            lo, hi = np.maximum(at - most, 0), at + 2 * band + self.length[item] + 2 * most
            # A window at the edge of two documents is one for each.
            doc, last = (np.clip(np.searchsorted(bounds, x, "right") - 1, 0, len(texts) - 1) for x in (lo, np.maximum(hi - 1, 0)))
            n = last - doc + 1
            doc, item, lo, hi = ragged(doc, n), np.repeat(item, n), np.repeat(lo, n), np.repeat(hi, n)
            lo, hi = np.maximum(lo, bounds[doc]), np.minimum(hi, bounds[doc + 1] - 1)
            room = hi - lo >= self.length[item] - self.most[item]
            doc, item, lo, hi = doc[room], item[room], lo[room], hi[room]
            edits = edits_of(self.items, item, data, lo, hi)
            good = edits <= self.most[item]
            for d, i, e in zip(doc[good].tolist(), item[good].tolist(), edits[good].tolist(), strict=True):
                best[d, i] = min(e, best.get((d, i), e))
        for (d, i), e in best.items():
            out[d].append((self.ids[i], e))
        return [sorted(x, key=lambda h: (h[0] is not None, h)) for x in out]


def _chunks(texts: list[str | None]) -> Iterator[list[bytes]]:
    chunk, size = [], 0
    for t in texts:
        data = (t or "").encode()
        if chunk and size + len(data) > CHUNK_BYTES:
            yield chunk
            chunk, size = [], 0
        chunk.append(data)
        size += len(data)
    if chunk:
        yield chunk


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """The benchmark in blocks of bounded size, one at a time."""
    rows = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.col("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-size // BLOCK_BYTES))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for b in range(n):
        yield [tuple(r) for r in rows.where(part == b).collect()]


def hits(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """``docs`` as ``row`` (all its columns) and ``hits``, an array of (item_id, edits)."""
    spark = docs.sparkSession
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"), F.array().cast("array<struct<item_id:bigint,edits:bigint>>").alias("hits"))
    blocks = _blocks(benchmark)
    block = next(blocks, [])
    while block is not None:
        sent = spark.sparkContext.broadcast(block)

        def add(batches: Iterator[pa.RecordBatch], sent=sent, edits=edits) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value, edits)
            for batch in batches:
                column, before = batch.schema.get_field_index("hits"), batch.column("hits").to_pylist()
                found = [x for chunk in _chunks(batch.column("text").to_pylist()) for x in matcher.match(chunk)]
                both = [b + [{"item_id": i, "edits": e} for i, e in x] for b, x in zip(before, found, strict=True)]
                yield batch.set_column(column, batch.schema.field(column), pa.array(both, batch.schema.field(column).type))

        out, block = out.mapInArrow(add, out.schema), next(blocks, None)
        if block is not None:
            out = saved(out)
            sent.unpersist()
    return out.drop("text")


def clean(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    return hits(docs, benchmark, edits).where(F.size("hits") == 0).select("row.*")


def op9_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    narrow = hits(docs, table(spark, sf_dir, "benchmark")).select(F.col("row.doc_id").alias("doc_id"), F.array_sort("hits").alias("hits"))
    return narrow.select(
        "doc_id",
        (F.size("hits") > 0).alias("contaminated"),
        F.size("hits").cast("long").alias("n_items"),
        F.transform("hits", lambda x: x["item_id"]).alias("item_ids"),
        F.transform("hits", lambda x: x["edits"]).alias("edits"),
    )


QUERIES = {"op9_cgk_decontamination": op9_cgk_decontamination}
ORACLES: dict[str, str] = {}
