import random

import pytest


@pytest.fixture(scope="session")
def words():
    rng = random.Random(11)
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randint(2, 8))) for _ in range(400)]


@pytest.fixture(scope="session")
def prose(words):
    """Random prose; equal seeds give equal texts."""

    def make(seed, n=120):
        rng = random.Random(seed)
        return " ".join(rng.choice(words) + ("." if rng.random() < 0.05 else "") + ("\n" if rng.random() < 0.03 else "") for _ in range(n))

    return make


@pytest.fixture(scope="session")
def documents(spark):
    """A documents table from (doc_id, text) pairs, with columns whose names clash with those used inside."""

    def make(rows):
        data = [(i, t, "en", f"s{(i or 0) % 5}", None if t is None else len(t), 0, "x", 1.5) for i, t in rows]
        return spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint, rid bigint, row string, kept double")

    return make
