import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from tidemark.llm import bpe

PIECES = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'", "''", "'S", " ", "  ", "\n", "\n\n", "\t", "\r\n", "　", "\x1c", "a", "b", "the", "an", "is", "re", "1", "23", "½", "٣", "!", "?!", "é", "ß", "日本", "語", "🙂", "́", "x" * 5, "====", "<|endoftext|>", "\0"]


@pytest.fixture(scope="module")
def ranks():
    with open(bpe.vocabulary_path(), "rb") as f:
        return bpe.read_ranks(f.read())


@pytest.fixture(scope="module")
def encoder(ranks):
    return bpe.Encoder(ranks)


def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(n, seed=1):
    rng = random.Random(seed)
    yield from ("", " ", "\n", "'s", "'", "a" * 5000, "ab" * 3000, "= " * 50 + "=" * 999, " " * 999, "日" * 2000, "".join(rng.choice("abc") for _ in range(50_000)))
    for _ in range(n):
        yield "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 30)))
    for _ in range(n):
        yield "".join(chr(rng.choice([rng.randint(32, 0x2FF), rng.randint(32, 126), rng.randint(0x370, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(40))


def test_ids_are_those_of_the_library(encoder, ranks):
    given = list(texts(2000))
    assert [x.tolist() for x in encoder.encode(given)] == library(ranks).encode_ordinary_batch(given)


def test_words_that_recur_and_batches(ranks, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 300)
    encoder, given = bpe.Encoder(ranks), list(texts(150, 2))
    want = library(ranks).encode_ordinary_batch(given)
    for k in range(0, len(given), 20):
        assert [x.tolist() for x in encoder.encode(given[k : k + 20])] == want[k : k + 20]


def test_words_that_share_a_hash_are_told_apart(ranks, monkeypatch):
    encoder, given = bpe.Encoder(ranks), list(texts(100, 3))
    monkeypatch.setattr(encoder.roll, "span", lambda prefix, lo, hi: (hi - lo).astype("uint64"))
    assert [x.tolist() for x in encoder.encode(given)] == library(ranks).encode_ordinary_batch(given)


@pytest.mark.parametrize("seed", range(8))
def test_ranks_out_of_order(seed):
    """Vocabularies in which a pair becomes a token of a lower rank than that of the merge that made it."""
    rng = random.Random(seed)
    tokens = {bytes([b]) for b in range(256)}
    while len(tokens) < 256 + 60:
        tokens.add(bytes(rng.choice(b"ab") for _ in range(rng.randint(2, 5))))
    longer = sorted(t for t in tokens if len(t) > 1)
    rng.shuffle(longer)
    ranks = {t: i for i, t in enumerate([*(bytes([b]) for b in range(256)), *longer])}
    encoder = bpe.Encoder(ranks)
    given = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 40))) for _ in range(500)]
    assert [x.tolist() for x in encoder.encode(given)] == library(ranks).encode_ordinary_batch(given)
    assert any(encoder.merges.plain(x.encode()) != [] for x in given)


def test_query(spark, tmp_path, documents, ranks):
    rows = [(i, t) for i, t in enumerate(texts(40, 4))] + [(100, None), (100, None), (None, "again"), (101, "z" * 200_000 + " end")]
    documents(rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted(tuple(r) for r in bpe.op13_merge_replay(spark, str(tmp_path)).select("n_tokens", "ids_sha256", "decoded_sha256", "round_trip").collect())
    want = []
    for _, text in rows:
        ids = library(ranks).encode_ordinary(text or "")
        want.append((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest(), True))
    assert found == sorted(want)


def test_encode_keeps_columns_and_decode_undoes_it(spark, documents):
    rows = [(1, "It's a dog's life.\n\n  Yes"), (2, None), (3, ""), (None, "日本語 🙂")]
    docs = documents(rows).withColumnRenamed("kept", "ids")
    encoded = bpe.encode(docs)
    assert sorted(encoded.columns) == sorted(docs.columns)
    back = {r["doc_id"]: bytes(r["decoded"]).decode() for r in bpe.decode(encoded).collect()}
    assert back == {i: t or "" for i, t in rows}
    assert bpe.op13_merge_replay.__name__ in bpe.QUERIES
    assert bpe.digests(docs.where("false")).count() == 0
