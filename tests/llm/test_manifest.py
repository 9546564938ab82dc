import hashlib
import random
import zlib

from tidemark.llm import manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def levels(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def path(tree, i):
    """(sibling or None, is it on the left) from a leaf to the root."""
    for level in tree[:-1]:
        yield (level[i ^ 1] if i ^ 1 < len(level) else None), bool(i & 1)
        i >>= 1


def plain(rows):
    """The query's rows by its definition."""
    trees = {}
    for doc_id, text, lang, source, n_chars in rows:
        changed = doc_id is not None and n_chars is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        one = leaf(doc_id, source, lang, n_chars, text)
        trees.setdefault(lang, []).append((doc_id is not None, doc_id or 0, one, leaf(doc_id, source, lang, n_chars + 1, text) if changed else one, doc_id))
    for leaves in trees.values():
        leaves.sort(key=lambda x: x[:3])
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    low = {name: levels([x[2] for x in trees[name]]) for name in names}
    high = levels([low[name][-1][0] for name in names])
    root, out = high[-1][0], []
    for k, name in enumerate(names):
        for i, (_, _, one, tried, doc_id) in enumerate(trees[name]):
            siblings = []
            for other, left in [*path(low[name], i), *path(high, k)]:
                siblings += [other] if other else []
                tried = sha(other, tried) if left else sha(tried, other or "")
            out.append((str(doc_id), one, low[name][-1][0], root, sha(*siblings), tried, tried == root))
    return sorted(out)


def result(spark, tmp_path, rows):
    data = [(*r, 1, 2, "t", b"x", 5) for r in rows]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, idx bigint, place bigint, tree string, digest binary, depth int"
    spark.createDataFrame(data, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = manifest.op11_merkle_manifest(spark, str(tmp_path)).collect()
    return sorted((str(r["doc_id"]), r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in found)


def test_query_against_its_definition(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "", None, "déjà\n"]) and f"text {i}", rng.choice(["en", "en", "de", "é", None]), rng.choice(["s1", None]), rng.choice([i, None])) for i in range(1500)]
    rows += [(1, "again", "en", "s", 1), (None, "no id", "en", "s", 2), (None, None, None, None, None), (9, "y" * 300_000, "xx", "s", 3)] + [(3, "same", "de", "s", 4)] * 3 + [(4, "", "", "", 0)]
    found = result(spark, tmp_path, rows)
    assert found == plain(rows)
    assert len({r[-1] for r in found}) == 2


def test_one_document_and_none(spark, tmp_path):
    assert result(spark, tmp_path / "one", [(1, "x", "en", "s", 1)]) == plain([(1, "x", "en", "s", 1)])
    assert result(spark, tmp_path / "none", []) == []


def test_a_tree_of_several_steps(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(manifest, "STEP", 2)
    rows = [(i, str(i), "en" if i % 9 else "fr", "s", i) for i in range(700)]
    assert result(spark, tmp_path, rows) == plain(rows)
