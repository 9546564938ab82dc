"""Byte-level BPE encoding and decoding: merges replayed over all distinct words of a batch at once.

Texts are cut into words by the pattern of the public rank files, from a table of
character classes: runs of letters, of digits, of others (each with one space
before it), of white space, and the English contractions. The distinct words of a batch
of documents lie one after the other as bytes, and an inverted index leads from each token that
a pair of neighbours can become to the places of such pairs. Merges are applied
in the order of their ranks, each at all of its places together, from left to
right; only the neighbours of what was merged are looked up anew and enter the
index. Words that recur are segmented once for each Python worker (at most
``KEPT`` of them are kept).

A pair may become a token of a lower rank than the merge that made it. The
replay would then be out of order within that word, so such words are recognised
(the pairs that a merge makes, and those that it makes for a moment, are
compared with its own rank) and merged one by one in the plain order. Words are
told apart by 64-bit hashes within a batch, and each occurrence is compared with its word byte
by byte; what differs is looked up by its bytes.

Edge cases: null and empty texts have no ids and decode to no bytes; strings of
special tokens are ordinary text; a word of any length is one word (time and memory grow
with its length, not its square); repeated rows give equal ids; an empty table
gives an empty result; :func:`encode` returns all columns as they are
(a column called ``ids`` is replaced).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .rolling import Rolling, ragged

#: The rank file, and the pattern that its words come from.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: UTF-8 bytes that are worked on together (or one document); words that a worker keeps from batch to batch.
BATCH_BYTES, KEPT = 4_000_000, 400_000
#: Pairs that are looked up in a dictionary instead of the sorted keys.
SMALL = 6
#: Character classes.
OTHER, LETTER, DIGIT, BLANK = 0, 1, 2, 3
_NONE = np.int32(2**31 - 1)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line.strip())}


def character_classes() -> np.ndarray:
    """The class of every code point, as the library's own engine has it (its Unicode version is not that of other libraries)."""
    import tiktoken

    single = {bytes([b]): b for b in range(256)}
    points = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (DIGIT, r"\p{N}"), (BLANK, r"\s")):
        matched = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(points)
        out[np.frombuffer(bytes(matched).decode().encode("utf-32-le"), np.uint32)] = kind
    return out


def boundaries(codes: np.ndarray, kind: np.ndarray, text_start: np.ndarray) -> np.ndarray:
    """Where words start (as a mask) in code points of several texts; ``text_start`` marks the first one of each text."""
    n = len(codes)
    start = np.zeros(n, bool)
    if not n:
        return start
    start[0] = True
    start[1:] = kind[1:] != kind[:-1]
    start |= text_start
    runs = np.flatnonzero(start)
    last = np.concatenate([runs[1:], [n]]) - 1
    blank = kind[runs] == BLANK
    # The last blank before something else in the same text is a word of its own, or goes with what follows if it is a space.
    inner = np.zeros(len(runs), bool)
    inner[:-1] = blank[:-1] & ~text_start[runs[1:]]
    start[last[inner]] = True
    spaced = last[inner & (codes[last] == 32)] + 1
    start[spaced] = False
    # A single apostrophe that starts a word, and small letters behind it.
    free = np.ones(len(runs), bool)
    free[np.searchsorted(runs, spaced)] = False
    quote = runs[(codes[runs] == 39) & (last == runs) & free & (runs + 1 < n)]
    quote = quote[(kind[quote + 1] == LETTER) & ~text_start[quote + 1]]
    if len(quote):
        one = codes[quote + 1]
        two = np.where(quote + 2 < n, codes[np.minimum(quote + 2, n - 1)], 0)
        two = np.where(start[np.minimum(quote + 2, n - 1)], 0, two)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.zeros(len(quote), bool)
        for a, b in ("re", "ve", "ll"):
            long |= (one == ord(a)) & (two == ord(b))
        start[quote[short | long] + 1] = False
        ends = np.concatenate([quote[short] + 2, quote[long] + 3])
        start[ends[ends < n]] = True
    return start


class Merges:
    """The ranks, ready to be replayed."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        if sorted(ranks.values()) != list(range(len(ranks))):
            raise ValueError("ranks must be 0 to n - 1")
        self.ranks = ranks
        self.tokens = [b""] * len(ranks)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = pairs
        keys, values = np.fromiter(pairs.keys(), np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs))
        order = np.argsort(keys)
        self.keys, self.values = np.append(keys[order], np.int64(2**62)), np.append(values[order], _NONE)
        self.size = np.array([len(t) for t in self.tokens], np.int64)
        self.data = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.at = np.cumsum(self.size) - self.size

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of what the pairs become, ``_NONE`` where they become nothing."""
        key = left.astype(np.int64) << 32 | right
        if len(key) <= SMALL:
            return np.array([self.pairs.get(k, _NONE) for k in key.tolist()], np.int32)
        place = np.searchsorted(self.keys, key)
        return np.where(self.keys[place] == key, self.values[place], _NONE)

    def plain(self, word: bytes) -> list[int]:
        """One word in the plain order: the lowest rank first, then the leftmost; a word that is a token is that token."""
        if word in self.ranks:
            return [self.ranks[word]]
        n = len(word)
        token = [int(self.byte[b]) for b in word]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(a: int) -> None:
            if a >= 0 and after[a] < n and (rank := self.pairs.get(token[a] << 32 | token[after[a]])) is not None:
                heapq.heappush(heap, (rank, a, token[a], token[after[a]]))

        for a in range(n - 1):
            offer(a)
        while heap:
            rank, a, left, right = heapq.heappop(heap)
            b = after[a]
            if token[a] != left or b >= n or token[b] != right:
                continue
            token[a], token[b], after[a] = rank, -1, after[b]
            if after[a] < n:
                before[after[a]] = a
            offer(before[a])
            offer(a)
        return [t for t in token if t >= 0]

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and the number of ids of each."""
        data = np.frombuffer(b"".join(words), np.uint8)
        n = len(data)
        sizes = np.array([len(w) for w in words], np.int64)
        if not n:
            return np.zeros(0, np.int64), sizes
        first = np.zeros(n + 1, bool)
        first[np.cumsum(sizes) - sizes] = True
        first[n] = True
        token = np.append(self.byte[data], np.int32(-1))
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        # becomes[p]: the rank that the pair at p has; _NONE at ends of words and where the place was merged away.
        becomes = np.full(n + 1, _NONE, np.int32)
        inner = np.flatnonzero(~first[1:n])
        becomes[inner] = self.lookup(token[inner], token[inner + 1])
        end = np.append(first[1:], True)  # the token at p is the last of its word
        index, queue = {}, []
        some = np.flatnonzero(becomes != _NONE)
        some = some[np.argsort(becomes[some], kind="stable")]
        heads = np.flatnonzero(np.diff(becomes[some], prepend=-1))
        for lo, hi in zip(heads, np.append(heads[1:], len(some)), strict=True):
            rank = int(becomes[some[lo]])
            index[rank] = [some[lo:hi]]
            queue.append(rank)
        heapq.heapify(queue)
        odd: list[np.ndarray] = []
        while queue:
            rank = heapq.heappop(queue)
            listed = index.pop(rank)
            at = listed[0] if len(listed) == 1 else np.unique(np.concatenate(listed))
            at = at[becomes[at] == rank]
            if not len(at):
                continue
            right = after[at]
            if len(at) > 1 and (touch := right[:-1] == at[1:]).any():
                # Pairs that overlap: every second one of a chain.
                chain = np.flatnonzero(np.concatenate([[True], ~touch]))
                step = np.arange(len(at)) - np.repeat(chain, np.diff(np.append(chain, len(at))))
                at, right = at[step % 2 == 0], right[step % 2 == 0]
            behind = after[right]
            closing = end[right]
            if len(at) > 1 and (near := (behind[:-1] == at[1:]) & ~closing[:-1]).any():
                # For a moment the merged token stands before the first half of the next pair.
                k = np.flatnonzero(near)
                early = self.lookup(np.full(len(k), rank, np.int32), token[at[k + 1]]) < rank
                if early.any():
                    odd.append(at[k[early]])
            token[at], token[right] = rank, -1
            end[at] = closing
            becomes[right] = _NONE
            after[at] = behind
            before[behind] = at
            becomes[at] = _NONE
            open_, ahead = at[~closing], at[~first[at]]
            ahead = before[ahead]
            places = np.concatenate([open_, ahead])
            if not len(places):
                continue
            new = self.lookup(token[places], token[after[places]])
            becomes[places] = new
            low = new < rank
            if low.any():
                odd.append(places[low])
            places, new = places[new > rank], new[new > rank]
            places, new = places[new != _NONE], new[new != _NONE]
            if not len(new):
                continue
            order = np.argsort(new, kind="stable")
            places, new = places[order], new[order]
            heads = np.flatnonzero(np.diff(new, prepend=-1)).tolist()
            for lo, hi in zip(heads, [*heads[1:], len(new)], strict=True):
                r = int(new[lo])
                if r in index:
                    index[r].append(places[lo:hi])
                else:
                    index[r] = [places[lo:hi]]
                    heapq.heappush(queue, r)
        word = np.repeat(np.arange(len(words)), sizes)
        left = token[:n] >= 0
        ids, count = token[:n][left].astype(np.int64), np.bincount(word[left], minlength=len(words))
        # A word that is a token is that token, whatever its merges give.
        whole = [k for k in np.flatnonzero(count > 1).tolist() if words[k] in self.ranks]
        which = np.unique(np.concatenate([word[x] for x in odd] + [np.array(whole, np.int64)]))
        if len(which):
            ids, count = self._mended(words, which, ids, count)
        return ids, count

    def _mended(self, words: list[bytes], which: np.ndarray, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``which`` words done in the plain order."""
        parts = np.split(ids, np.cumsum(count)[:-1])
        for k in which.tolist():
            parts[k] = np.array(self.plain(words[k]), np.int64)
            count[k] = len(parts[k])
        return np.concatenate(parts), count

    def decode(self, ids: np.ndarray) -> bytes:
        return self.data[ragged(self.at[ids], self.size[ids])].tobytes()


class Encoder:
    """Encodes texts; distinct words are kept from batch to batch."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.merges, self.kinds, self.roll = Merges(ranks), character_classes(), Rolling(7)
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number (in ``known``) of each word of the texts, and how many words each text has; new words are segmented."""
        lengths = np.array([len(t) for t in texts], np.int64)
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        data = np.frombuffer(joined.encode(), np.uint8)
        if not len(codes):
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        head = np.zeros(len(codes), bool)
        at = np.cumsum(lengths) - lengths
        head[at[lengths > 0]] = True
        start = np.flatnonzero(boundaries(codes, self.kinds[codes], head))
        counts = np.diff(np.searchsorted(start, np.append(at, len(codes))))
        lo = start if len(data) == len(codes) else np.flatnonzero((data & 0xC0) != 0x80)[start]
        size = np.diff(np.append(lo, len(data)))
        prefix = self.roll.prefix(data)
        _, first, which = np.unique(self.roll.span(prefix, lo, lo + size), return_index=True, return_inverse=True)
        view = data.tobytes()
        put, fresh = self.known.setdefault, []

        def number(word: bytes) -> int:
            i = put(word, len(self.known))
            if i == len(self.count) + len(fresh):
                fresh.append(word)
            return i

        known = np.array([number(view[a:b]) for a, b in zip(lo[first].tolist(), (lo + size)[first].tolist(), strict=True)], np.int64)
        place = known[which]
        # Every occurrence against the first one with its hash, byte by byte.
        same = size == size[first][which]
        for k in np.array_split(np.flatnonzero(same), max(1, int(size.sum() // 2_000_000))):
            if len(k):
                each = size[k]
                differ = data[ragged(lo[k], each)] != data[ragged(lo[first[which[k]]], each)]
                if differ.any():
                    same[k[np.unique(np.repeat(np.arange(len(k)), each)[differ])]] = False
        for k in np.flatnonzero(~same).tolist():
            place[k] = number(view[lo[k] : lo[k] + size[k]])
        if fresh:
            ids, count = self.merges.replay(fresh)
            self.ids, self.count = np.concatenate([self.ids, ids]), np.concatenate([self.count, count])
        return place, counts

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > KEPT:
            self.clear()
        place, counts = self.words(texts)
        each = self.count[place]
        flat = self.ids[ragged((np.cumsum(self.count) - self.count)[place], each)]
        ends = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(counts)])]
        return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


_ENCODERS: dict[str, Encoder] = {}


def _encoder(data: bytes) -> Encoder:
    """The encoder of a rank file, one for each Python worker."""
    name = hashlib.sha256(data).hexdigest()
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = Encoder(read_ranks(data))
    return _ENCODERS[name]


def _chunks(texts: list[str | None]) -> Iterator[list[str]]:
    chunk: list[str] = []
    size = 0
    for t in texts:
        t = t or ""
        if chunk and size + len(t) > BATCH_BYTES:
            yield chunk
            chunk, size = [], 0
        chunk.append(t)
        size += len(t)
    if chunk:
        yield chunk


def _sent(spark: SparkSession, path: str | None):
    with open(path or vocabulary_path(), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with ``ids``, the ids of its text; columns as they are. One narrow pass."""
    sent = _sent(docs.sparkSession, path)
    names = [c for c in docs.columns if c != "ids"]
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    out = docs.select(row.alias("row"), "text", F.array().cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(sent.value)
        for batch in batches:
            ids = [x for chunk in _chunks(batch.column("text").to_pylist()) for x in encoder.encode(chunk)]
            flat = pa.array(np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32))
            ends = np.cumsum([0] + [len(x) for x in ids]).astype(np.int32)
            at, field = batch.schema.get_field_index("ids"), batch.schema.field("ids")
            yield batch.set_column(at, field, pa.ListArray.from_arrays(pa.array(ends), flat).cast(field.type))

    return out.mapInArrow(run, out.schema).select("row.*", "ids")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``decoded``, the bytes of ``ids`` (no ids: no bytes), beside ``doc_id``."""
    sent = _sent(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = _encoder(sent.value).merges
        for batch in batches:
            out = [merges.decode(np.array(x or [], np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, decoded binary")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """For each document the number and digest of its ids, the digest of the bytes that they decode to, and whether those are its text."""
    sent = _sent(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(sent.value)
        decimal = [b"%d" % k for k in range(len(encoder.merges.tokens))]
        for batch in batches:
            columns: list[list] = [[], [], [], []]
            for chunk in _chunks(batch.column("text").to_pylist()):
                for text, ids in zip(chunk, encoder.encode(chunk), strict=True):
                    decoded = encoder.merges.decode(ids)
                    columns[0].append(len(ids))
                    columns[1].append(hashlib.sha256(b",".join([decimal[k] for k in ids.tolist()])).hexdigest())
                    columns[2].append(hashlib.sha256(decoded).hexdigest())
                    columns[3].append(decoded == text.encode())
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"])

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, round_trip boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op13_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op13_merge_replay": op13_merge_replay}
ORACLES: dict[str, str] = {}
