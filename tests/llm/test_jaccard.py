"""The prefix-tree join against all pairs."""

import random
import re

import numpy as np
import pytest

from tidemark.llm import jaccard as J


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n, percent):
    """(doc_id, size, component) by comparing every pair."""
    sets = [shingles(t, n) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]) and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [a if x == b else x for x in label]
    least = {}
    for k, (i, _) in enumerate(rows):
        known = least.get(label[k])
        least[label[k]] = i if known is None else known if i is None else min(known, i)
    return sorted(((i, len(sets[k]), least[label[k]]) for k, (i, _) in enumerate(rows)), key=str)


def edited(text, seed, n):
    rng, w = random.Random(seed), text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(["new", "words", "here", "Zed"])
    return " ".join(w)


def corpus(prose):
    base, passage = prose(1, 150), prose(2, 60)
    texts = [base, base.upper(), base + "\n", "", None, " \t ", "one two", "one  TWO", "one two three", "a b c d", "a b c d"]
    texts += [edited(base, k, k % 9) for k in range(40)]
    texts += [prose(50 + k, 60) + " " + passage for k in range(20)]
    texts += [edited(prose(300, 400), k, 3 * k) for k in range(12)] + [prose(400, 9000), edited(prose(400, 9000), 1, 150)]
    return list(enumerate(texts))


@pytest.mark.parametrize(("few", "block", "often", "forest"), [(128, 1024, 3, 500_000), (2, 4, 2, 3)])
@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_equals_all_pairs(spark, documents, prose, monkeypatch, few, block, often, forest, n, percent):
    for name, value in (("FEW", few), ("BLOCK", block), ("OFTEN", often), ("FOREST", forest)):
        monkeypatch.setattr(J, name, value)
    rows = corpus(prose)
    got = J.components_of(documents(rows).repartition(3), n, percent).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, n, percent)


def test_repeated_and_null_ids(spark, documents, prose):
    a, b = prose(1, 50), prose(2, 50)
    rows = [(None, a), (7, a), (7, a), (3, b), (None, None), (7, b)]
    got = sorted((tuple(r) for r in J.components_of(documents(rows)).collect()), key=str)
    assert got == brute(rows, 4, 85)
    assert J.components_of(documents([])).count() == 0


def test_dedup_keeps_the_first_of_each_class(spark, documents, prose):
    a = prose(1, 80)
    docs = documents([(4, a), (2, edited(a, 1, 1)), (9, prose(5, 80)), (1, None), (0, ""), (4, a)])
    out = J.dedup(docs)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [0, 1, 2, 9]


def test_tree_walk_equals_intersections():
    rng = np.random.default_rng(3)
    pool = np.unique(rng.integers(0, 2**56, 700).astype(np.uint64))
    base = np.sort(rng.choice(pool, 300, replace=False))
    rows = [np.sort(np.concatenate([base[rng.random(300) > 0.1], rng.choice(pool, 10)])) for _ in range(40)] + [base[:5], base]
    rows = [np.unique(r) for r in rows]
    tree = J.PrefixTree(rows)
    for percent in (70, 85, 100):
        want = {i for i, r in enumerate(rows) if 100 * len(np.intersect1d(r, base)) >= percent * len(np.union1d(r, base))}
        assert set(tree.walk(base, np.ones(len(rows), bool), percent).tolist()) == want


@pytest.mark.parametrize("least", [1, 3, 100])
def test_whole_groups_never_cut_a_key(least):
    import pyarrow as pa

    keys = np.sort(np.random.default_rng(1).integers(0, 9, 60))
    batches = [pa.RecordBatch.from_arrays([pa.array(x), pa.array(x)], ["k", "v"]) for x in np.split(keys, [0, 1, 7, 8, 20, 20, 41])]
    tables = list(J.whole_groups(iter(batches), "k", least))
    assert np.concatenate([t.column("k").to_numpy() for t in tables]).tolist() == keys.tolist()
    assert all(a.column("k")[-1] != b.column("k")[0] for a, b in zip(tables, tables[1:])) and all(len(t) >= least for t in tables[:-1])
    assert list(J.whole_groups(iter(batches[:1]), "k", least)) == []


@pytest.mark.parametrize(("tasks", "forest"), [("4", 200_000), ("31", 200_000), ("31", 3), ("1", 5)])
def test_components_of_paths_and_stars(spark, monkeypatch, tasks, forest):
    rng = random.Random(4)
    monkeypatch.setattr(J, "FOREST", forest)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    edges = [(i, i + 1) for i in range(100, 160)] + [(1000, 1000 + k) for k in range(1, 40)] + [(2000 + k, 2000 + rng.randrange(50)) for k in range(50)]
    rng.shuffle(edges)
    try:
        got = {r["node"]: r["label"] for r in J.components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(7)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == label


def test_templates_of_many_sizes(spark, documents, prose, monkeypatch):
    """Different texts that are mostly one boilerplate, short and long: a crowd of several blocks, not all of which meet."""
    monkeypatch.setattr(J, "FEW", 3)
    monkeypatch.setattr(J, "BLOCK", 6)
    plate = prose(1, 120)
    rows = [(k, " ".join([plate, prose(500 + k, 3 + k % 7 * (1 + k % 5 * 4))])) for k in range(60)] + [(100 + k, plate[: 200 + 9 * k]) for k in range(20)] + [(200 + k, plate + " " + plate[: 30 * k]) for k in range(10)]
    got = J.components_of(documents(rows).repartition(3), 4, 85).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, 4, 85)
