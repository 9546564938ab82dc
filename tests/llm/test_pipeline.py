"""The pipeline's rows against each stage's own brute force."""

import corpus_pipeline
from tidemark.llm import decontaminate, pieces, quality
from tidemark.llm.common import saved

from .test_jaccard import brute


def test_pipeline_end_to_end(spark, documents, prose, tmp_path):
    item = prose(77, 30)
    texts = [prose(1), prose(1) + " x", "too short", prose(2), prose(3) + " " + item + " " + prose(4), prose(5) + ' token = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"', None, "### $$$ " * 40]
    docs = documents(list(enumerate(texts))).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    good = {r["doc_id"] for r in quality.decide(quality.ledger(docs)).where("kept").collect()}
    rows = [(i, t) for i, t in enumerate(texts) if i in good]
    first = {i for i, _, c in brute(rows, 5, 80) if i == c}
    matcher = decontaminate.Matcher([(1, item)])
    left = {i for i in first if not matcher.match([texts[i].encode()])[0]}
    assert set(out) == left == {0, 3, 5}
    with open(pieces.MODEL, "rb") as f:
        model = pieces.Pieces(f.read())
    assert model.decode([__import__("numpy").array(out[0])]) == [texts[0]]
    assert "f33e61083db5dbdf4bd2369d2f80176e57f7fda2" not in model.decode([__import__("numpy").array(out[5])])[0]


def test_stages_keep_columns(spark, documents, prose, tmp_path):
    docs = documents([(i, prose(i)) for i in range(5)]).select("doc_id", "text", "lang", "source", "n_chars")
    spark.createDataFrame([(1, prose(50, 20))], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = saved(stage(spark, docs, str(tmp_path)))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert docs.count() == 5


def test_empty_tables_and_repeated_ids(spark, documents, prose, tmp_path):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    item = prose(77, 30)
    rows = [(1, prose(1)), (1, prose(2)), (1, prose(2)), (None, prose(3)), (None, prose(3) + " end"), (None, None), (2, item + " " + prose(4))]
    for name, data, items in (("none", [], [(1, item)]), ("odd", rows, [(1, item)]), ("free", rows, [])):
        folder = tmp_path / name
        documents(data).select(*columns).write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(folder / "benchmark.parquet"))
        got = sorted((-1 if r["doc_id"] is None else r["doc_id"]) for r in corpus_pipeline.run(spark, str(folder)).collect())
        assert got == {"none": [], "odd": [-1, 1, 1], "free": [-1, 1, 1, 2]}[name]
