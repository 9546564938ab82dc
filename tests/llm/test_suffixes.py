"""Suffix dedup against brute force over every window."""

import hashlib

import numpy as np
import pytest

from tidemark.llm import suffixes as S
from tidemark.llm.rolling import Rolling


def brute(rows):
    """rows in order; (n_bytes, n_removed, n_spans, sha) of each."""
    seen, out = set(), []
    for text in rows:
        b = (text or "").encode()
        keep = bytearray(b"\1" * len(b))
        for k in range(len(b) - S.WINDOW + 1):
            w = b[k : k + S.WINDOW]
            if w in seen:
                keep[k : k + S.WINDOW] = bytes(S.WINDOW)
            seen.add(w)
        runs = sum(1 for k in range(len(b)) if not keep[k] and (k == 0 or keep[k - 1]))
        out.append((len(b), len(b) - sum(keep), runs, hashlib.sha256(bytes(c for c, k in zip(b, keep) if k)).hexdigest()))
    return out


def corpus(prose):
    a, b = prose(1, 200), prose(2, 100)
    passage = prose(3, 60)
    texts = [a, a, b + a[50:400] + b, "", None, "short", "x" * 350, "x" * 99, ("from " * 100), a[:150] + "Z" + a[151:600]]
    texts += [prose(100 + i, 20) + passage + prose(200 + i, 20) for i in range(30)]
    texts += [a.replace("e", "é", 3), prose(5, 4000), prose(5, 4000)[100:], passage[:99], passage[:100], passage[3:]]
    return texts


@pytest.mark.parametrize("hot", [256, 4])
def test_equals_brute_force(spark, documents, prose, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT", hot)
    texts = corpus(prose)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in S.report(documents(list(enumerate(texts))).repartition(5)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_repeated_null_and_missing_rows(spark, documents, prose):
    a = prose(9, 60)
    rows = [(1, a), (1, a), (None, a), (2, prose(8, 60)), (2, a), (None, None)]
    got = [tuple(r)[1:4] for r in S.report(documents(rows)).collect()]
    ordered = brute([t for _, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))])
    assert sorted(got) == sorted(x[:3] for x in ordered)
    assert S.report(documents([])).count() == 0


def test_dedup_keeps_columns_and_cuts_text(spark, documents, prose):
    a = prose(4, 100)
    out = S.dedup(documents([(1, a), (2, a + " tail"), (3, None)])).collect()
    assert {r["doc_id"]: r["text"] for r in out}[2] == " tail" and set(out[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars", "rid", "row", "kept"}


def test_mergesort_sorts_suffixes_and_survives_collisions():
    rng = np.random.default_rng(0)
    data = np.concatenate([rng.integers(97, 99, 3000).astype(np.uint8), np.zeros(S.WINDOW, np.uint8)])
    start = np.sort(rng.integers(0, 2900, 300))
    length = np.minimum(rng.integers(1, 80, 300), 3000 - start)
    group = np.sort(rng.integers(0, 7, 300))
    order = S.Sorter(data, start, length, group, Rolling(3)).sort()
    texts = [data[start[i] : start[i] + length[i]].tobytes() for i in order]
    assert list(group[order]) == sorted(group) and all(texts[k] <= texts[k + 1] for k in range(299) if group[order[k]] == group[order[k + 1]])

    class Weak(Rolling):
        def span(self, prefix, a, b):
            return super().span(prefix, a, b) & np.uint64(3)

    n = 60
    start = np.arange(n) * 110
    data = np.tile(rng.integers(97, 123, 110 * 10).astype(np.uint8), 7)
    data[5000] ^= 1
    args = (start, np.full(n, 4), np.full(n, 5), np.repeat([0, 1], n // 2), np.arange(n))
    assert (S._repeats(data, *args, Weak(3)) == S._repeats(data, *args, Rolling(3))).all()
