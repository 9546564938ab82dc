"""SentencePiece encoding and decoding in batched numpy.

The distinct words of a chunk of documents are grouped by length, and words of
equal length advance together: the hashes of their substrings, taken from
prefix sums, probe the sorted keys of the pieces. Two segmentations share that
probe:

* Viterbi: for each end position the best sum of piece scores over all last
  pieces; vectorised maxima store backpointers. This is what a unigram model
  means.
* merges: the best-scored adjacent pair of each word is merged, again and
  again, leftmost first. This is what a BPE model means.

``ids`` follow the kind of the model that is loaded, so they are the ids that
the model stands for; for the BPE model at ``MODEL`` Viterbi gives other
segmentations (they decode to the same text), so both are offered. Characters
that are no piece become their UTF-8 bytes.

A chunk holds at most ``CHUNK_CHARS`` characters (or one document); words over
``LONG`` characters are segmented one by one with a heap or a plain loop, in
time that grows with their length and not with its square.

Edge cases: null and empty texts have no ids and decode to the empty text; the
meta symbol in a text is read as a space, as SentencePiece itself does;
repeated rows give equal ids; an empty table gives an empty result; columns of
any name pass through :func:`encode` (a column called ``ids`` is replaced).
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .rolling import U, mix, ragged

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
META = "▁"
CHUNK_CHARS, KEPT_WORDS, LONG = 4_000_000, 500_000, 64
_BASE = 0x9E3779B97F4A7C15
_NONE = -np.inf


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


class Pieces:
    """The vocabulary of a model, ready to be probed by hashes of substrings."""

    def __init__(self, proto: bytes) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = model.get_piece_size()
        self.texts = [model.id_to_piece(i) for i in range(n)]
        special = np.array([model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)])
        self.scores = np.array([model.get_score(i) for i in range(n)])
        self.byte = np.full(256, model.unk_id(), np.int64)
        for i in range(n):
            if model.is_byte(i):
                self.byte[int(self.texts[i][3:5], 16)] = i
        self.normal = {t: i for i, t in enumerate(self.texts) if not special[i]}
        self.longest = max(map(len, self.normal))
        self.index: dict[str, int] = {}
        self.seen: dict[bool, tuple[np.ndarray, np.ndarray]] = {}
        self.bpe = self._is_bpe(model)
        self.up, self.down = _powers(_BASE, LONG + 1), _powers(pow(_BASE, -1, 2**64), LONG + 1)
        ids = np.array(sorted(self.normal.values()), np.int64)
        keys = np.array([self._key(self.texts[i]) for i in ids], U)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], ids[order]
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces share a hash; choose another base")
        #: Most substrings are no piece; a bit for the leading part of each key says so without a search.
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.keys >> U(44)).astype(np.int64)] = True
        #: Below any sum of scores of real pieces of one character, as in a unigram model.
        self.unknown = float(self.scores[ids].min()) - 10.0
        data = [bytes([int(t[3:5], 16)]) if model.is_byte(i) else b"" if special[i] else t.replace(META, " ").encode() for i, t in enumerate(self.texts)]
        self.data = np.frombuffer(b"".join(data), np.uint8)
        self.size = np.array([len(x) for x in data], np.int64)
        self.at = np.cumsum(self.size) - self.size

    @staticmethod
    def _is_bpe(model) -> bool:
        """Scores of a BPE model are ranks: whole numbers going down by one."""
        scores = [model.get_score(i) for i in range(model.get_piece_size() - 20, model.get_piece_size())]
        return all(float(s).is_integer() for s in scores)

    def _key(self, text: str) -> int:
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(U)
        return int(mix((mix(codes + U(1)) * _powers(_BASE, len(codes))).sum(dtype=U)[None])[0])

    def _probe(self, prefix: np.ndarray, rows: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (or -1) and scores of the substrings [start, end) of the rows."""
        key = mix((prefix[rows, end] - prefix[rows, start]) * self.down[start])
        ids, scores = np.full(len(key), -1, np.int64), np.full(len(key), _NONE)
        some = np.flatnonzero(self.maybe[(key >> U(44)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.keys, key[some]), len(self.keys) - 1)
        hit = self.keys[place] == key[some]
        ids[some[hit]] = self.ids[place[hit]]
        scores[some[hit]] = self.scores[ids[some[hit]]]
        return ids, scores

    def _prefix(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((codes.shape[0], codes.shape[1] + 1), U)
        np.cumsum(mix(codes.astype(U) + U(1)) * self.up[: codes.shape[1]], axis=1, out=out[:, 1:])
        return out

    def viterbi(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best-scoring segmentation of equal-length words: (piece id or -1, start) for each end that is used, else (-2, .)."""
        n, length = codes.shape
        prefix, rows = self._prefix(codes), np.arange(n)
        best = np.full((n, length + 1), _NONE)
        best[:, 0] = 0
        back, piece = np.zeros((n, length + 1), np.int64), np.full((n, length + 1), -2, np.int64)
        for end in range(1, length + 1):
            for start in range(max(0, end - self.longest), end):
                ids, scores = self._probe(prefix, rows, np.full(n, start), np.full(n, end))
                if end - start == 1:
                    scores = np.where(ids < 0, self.unknown, scores)
                total = best[:, start] + scores
                better = total > best[:, end]
                best[better, end], back[better, end], piece[better, end] = total[better], start, ids[better]
        used = np.full((n, length), -2, np.int64)
        at = np.full(n, length)
        while (live := np.flatnonzero(at > 0)).size:
            used[live, at[live] - 1] = piece[live, at[live]]
            at[live] = back[live, at[live]]
        return used, back[:, 1:]

    def merges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`viterbi`, by merging the best adjacent pair until none is left."""
        n, length = codes.shape
        prefix = self._prefix(codes)
        edge = np.tile(np.arange(length + 1), (n, 1))
        edge = np.concatenate([edge, np.full((n, 2), length)], axis=1)
        count = np.full(n, length)
        pair = np.full((n, length + 1), _NONE)
        for k in range(length - 1):
            pair[:, k] = self._probe(prefix, np.arange(n), np.full(n, k), np.full(n, k + 2))[1]
        live = np.arange(n)
        while live.size:
            k = np.argmax(pair[live], axis=1)
            going = pair[live, k] > _NONE
            live, k = live[going], k[going]
            if not live.size:
                break
            shift = np.arange(length + 2)[None] + (np.arange(length + 2)[None] > k[:, None])
            edge[live] = np.concatenate([np.take_along_axis(edge[live], shift, 1), np.full((len(live), 1), length)], axis=1)
            shift = np.arange(length)[None] + (np.arange(length)[None] > k[:, None])
            pair[live, :length] = np.take_along_axis(pair[live], shift, 1)
            pair[live, length] = _NONE
            count[live] -= 1
            for side in (0, -1):
                spot = k + side
                ok = (spot >= 0) & (spot + 1 < count[live])
                r, s = live[ok], spot[ok]
                pair[r, s] = self._probe(prefix, r, edge[r, s], edge[r, s + 2])[1]
                r, s = live[~ok & (spot >= 0)], spot[~ok & (spot >= 0)]
                pair[r, s] = _NONE
        used, back = np.full((n, length), -2, np.int64), np.zeros((n, length), np.int64)
        for j in range(length):
            r = np.flatnonzero(count > j)
            start, end = edge[r, j], edge[r, j + 1]
            used[r, end - 1] = self._probe(prefix, r, start, end)[0]
            back[r, end - 1] = start
        return used, back

    def _long(self, word: str, bpe: bool) -> list[int]:
        """One long word, without the batch."""
        spans: list[tuple[int, int]]
        n = len(word)
        if bpe:
            left, right, ends = list(range(-1, n - 1)), list(range(1, n + 1)), list(range(1, n + 1))
            heap: list[tuple[float, int, int, int]] = []

            def offer(a: int) -> None:
                b = right[a] if 0 <= a < n else n
                if 0 <= a and b < n and (i := self.normal.get(word[a : ends[b]])) is not None:
                    heapq.heappush(heap, (-self.scores[i], a, ends[a], ends[b]))

            for a in range(n - 1):
                offer(a)
            gone = bytearray(n)
            while heap:
                _, a, middle, end = heapq.heappop(heap)
                if gone[a] or ends[a] != middle or middle >= n or gone[middle] or ends[middle] != end:
                    continue
                gone[middle], ends[a], right[a] = 1, end, right[middle]
                if right[a] < n:
                    left[right[a]] = a
                offer(left[a])
                offer(a)
            spans, a = [], 0
            while a < n:
                spans.append((a, ends[a]))
                a = ends[a]
        else:
            best, back = [0.0] + [_NONE] * n, [0] * (n + 1)
            for end in range(1, n + 1):
                for start in range(max(0, end - self.longest), end):
                    i = self.normal.get(word[start:end])
                    score = self.scores[i] if i is not None else self.unknown if end - start == 1 else _NONE
                    if best[start] + score > best[end]:
                        best[end], back[end] = best[start] + score, start
            spans, end = [], n
            while end:
                spans.append((back[end], end))
                end = back[end]
            spans.reverse()
        out: list[int] = []
        for a, b in spans:
            i = self.normal.get(word[a:b])
            out.extend([i] if i is not None else [int(self.byte[x]) for x in word[a:b].encode()])
        return out

    def segment(self, words: list[str], bpe: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and the number of ids of each word."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        count = np.zeros(len(words), np.int64)
        lengths = np.array([len(w) for w in words])
        for length in np.unique(lengths):
            which = np.flatnonzero(lengths == length)
            if length > LONG:
                for k in which:
                    ids = np.array(self._long(words[k], bpe), np.int64)
                    count[k] = len(ids)
                    found.append((np.array([k]), ids))
                continue
            for part in np.array_split(which, -(-len(which) * int(length) // 2_000_000)):
                codes = np.frombuffer("".join([words[k] for k in part]).encode("utf-32-le"), np.uint32).reshape(len(part), length)
                used, _ = self.merges(codes) if bpe else self.viterbi(codes)
                row, end = np.nonzero(used != -2)
                ids = used[row, end]
                sizes = np.bincount(row, minlength=len(part))
                if (ids < 0).any():
                    ids, sizes = self._bytes(ids, row, codes[row, end], len(part))
                count[part] = sizes
                found.append((part, ids))
        flat, starts = np.zeros(int(count.sum()), np.int64), np.cumsum(count) - count
        for part, ids in found:
            flat[ragged(starts[part], count[part])] = ids
        return flat, count

    def _bytes(self, ids: np.ndarray, row: np.ndarray, code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Unknown characters replaced by the ids of their bytes."""
        unknown = ids < 0
        codes, which = np.unique(code[unknown], return_inverse=True)
        spelt = [self.byte[np.frombuffer(chr(c).encode("utf-8", "surrogatepass"), np.uint8)] for c in codes]
        width = np.array([len(x) for x in spelt])
        sizes = np.ones(len(ids), np.int64)
        sizes[unknown] = width[which]
        starts = np.cumsum(sizes) - sizes
        out = np.empty(int(sizes.sum()), np.int64)
        out[starts[~unknown]] = ids[~unknown]
        out[ragged(starts[unknown], width[which])] = np.concatenate(spelt)[ragged((np.cumsum(width) - width)[which], width[which])]
        return out, np.bincount(row, weights=sizes, minlength=n).astype(np.int64)

    def encode(self, texts: list[str], *kinds: bool) -> list[list[np.ndarray]]:
        """The ids of each text, a list for each kind: True for merges, False for Viterbi.

        Words are kept from call to call until there are ``KEPT_WORDS`` of them.
        """
        if len(self.index) > KEPT_WORDS:
            self.index, self.seen = {}, {}
        put, n = self.index.setdefault, len
        place: list[int] = []
        counts = [0]
        for text in texts:
            text = text.replace(META, " ")
            if not text:
                words: list[str] = []
            elif "  " in text or text[0] == " " or text[-1] == " ":
                words = [w.replace(" ", META) for w in re.findall(" +[^ ]*", " " + text)]
            else:
                words = (META + text.replace(" ", " " + META)).split(" ")
            place += [put(w, n(self.index)) for w in words]
            counts.append(len(words))
        at, bounds = np.array(place, np.int64), np.cumsum(counts)
        out = []
        for bpe in kinds:
            flat, sizes = self.seen.get(bpe, (np.zeros(0, np.int32), np.zeros(0, np.int64)))
            more, more_sizes = self.segment(list(islice(self.index, len(sizes), None)), bpe)
            flat, sizes = np.concatenate([flat, more.astype(np.int32)]), np.concatenate([sizes, more_sizes])
            self.seen[bpe] = flat, sizes
            each = sizes[at]
            ids = flat[ragged((np.cumsum(sizes) - sizes)[at], each)]
            ends = np.concatenate([[0], np.cumsum(each)])[bounds]
            out.append([ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)])
        return out

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        out = []
        for x in ids:
            data = self.data[ragged(self.at[x], self.size[x])].tobytes() if len(x) else b""
            out.append(data.decode("utf-8", "replace").removeprefix(" "))
        return out


def _chunks(texts: list[str | None]) -> Iterator[list[str]]:
    chunk: list[str] = []
    size = 0
    for t in texts:
        t = t or ""
        if chunk and size + len(t) > CHUNK_CHARS:
            yield chunk
            chunk, size = [], 0
        chunk.append(t)
        size += len(t)
    if chunk:
        yield chunk


def _sent(spark: SparkSession, model: str):
    with open(model, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``docs`` with ``ids``, the ids of its text; columns as they are. One narrow pass."""
    sent = _sent(docs.sparkSession, model)
    names = [c for c in docs.columns if c != "ids"]
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    out = docs.select(row.alias("row"), "text", F.array().cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(sent.value)
        for batch in batches:
            ids = [x for chunk in _chunks(batch.column("text").to_pylist()) for x in pieces.encode(chunk, pieces.bpe)[0]]
            flat = pa.array(np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32))
            ends = np.cumsum([0] + [len(x) for x in ids]).astype(np.int32)
            at, field = batch.schema.get_field_index("ids"), batch.schema.field("ids")
            yield batch.set_column(at, field, pa.ListArray.from_arrays(pa.array(ends), flat).cast(field.type))

    return out.mapInArrow(run, out.schema).select("row.*", "ids")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """``decoded``, the text of ``ids``, beside ``doc_id``."""
    sent = _sent(encoded.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(sent.value)
        for batch in batches:
            ids = [np.array(x or [], np.int64) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pieces.decode(ids), pa.string())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, decoded string")


def digests(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """For each document: number and digest of its ids by merges and by Viterbi, and whether both decode to its text."""
    sent = _sent(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(sent.value)
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for chunk in _chunks(batch.column("text").to_pylist()):
                wanted = [t.replace(META, " ") for t in chunk]
                good = np.ones(len(chunk), bool)
                for k, ids in enumerate(pieces.encode(chunk, pieces.bpe, False)):
                    good &= np.array([a == b for a, b in zip(pieces.decode(ids), wanted, strict=True)], bool)
                    columns[2 * k] += [len(x) for x in ids]
                    columns[2 * k + 1] += [hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids]
                columns[4] += good.tolist()
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_())
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", "n_ids", "ids_sha256", "n_viterbi", "viterbi_sha256", "round_trip"])

    schema = "doc_id bigint, n_ids bigint, ids_sha256 string, n_viterbi bigint, viterbi_sha256 string, round_trip boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op6_sentencepiece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op6_sentencepiece_viterbi": op6_sentencepiece_viterbi}
ORACLES: dict[str, str] = {}
