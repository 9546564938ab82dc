"""Filters and list scans give the same rows on a stream as on a table."""

from tidemark.functions.predicates import Condition, FilterSpec
from tidemark.operators.indicators import Indicator
from tidemark.streaming import live


def run(spark, frame, name):
    query = frame.writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.table(name)


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"event {i % 7}", "psexec" if i % 5 == 0 else "calm") for i in range(100)], "row_id bigint, kind string, msg string")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    spec = FilterSpec(conditions=[Condition("msg", ["PSEXEC"])], quick={"kind": "event"})
    kept = run(spark, live.filtered(stream, ["kind", "msg"], spec).select("row_id"), "kept")
    assert {r["row_id"] for r in kept.collect()} == set(range(0, 100, 5))
    found = run(spark, live.hits(stream, ["kind", "msg"], [Indicator("l", 1, "plain", "psexec", "bad"), Indicator("l", 2, "regex", "event 3")]), "found")
    got = {(r["row_id"], r["line"]) for r in found.collect()}
    assert got == {(i, 1) for i in range(0, 100, 5)} | {(i, 2) for i in range(100) if i % 7 == 3 and i % 5}
