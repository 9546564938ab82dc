"""Times, periods, durations and windows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import times as T
from tidemark.sources.delimited import in_memory

ROWS = [["2019-06-01 10:00:00", "old"], ["2020-06-01 10:00:00", "mid"], ["2021-06-01 10:00:00", "new"], ["notatime", "bad"]]


def ids(t, predicate):
    return sorted(r["row_id"] for r in t.df.where(predicate).select("row_id").collect())


def test_period_aware_comparisons(spark):
    t = in_memory(spark, ["Timestamp", "Summary"], ROWS)
    c = T.time_of(t, "timestamp")
    assert ids(t, T.before(c, "2020")) == [0]
    assert ids(t, T.after(c, "2020")) == [2]
    assert ids(t, T.between(c, "2020", "2020")) == [1]
    assert ids(t, T.between(c, "2019", "2021")) == [0, 1, 2]
    assert ids(t, T.before(c, "2020-06-01 10:00:00 + 1d")) == [0, 1]
    assert ids(t, ~T.before(c, "2020")) == [1, 2, 3]
    for bad in ("notaday", "2020 + bogus"):
        with pytest.raises(ValueError):
            T.before(c, bad)
    with pytest.raises(ValueError):
        T.time_of(t, "tag")


@pytest.mark.parametrize(
    ("cell", "wanted"),
    [
        ("2015-03-10 14:47:33Z", "2015-03-10 14:47:33"),
        ("2015-03-10T14:47:33.5+02:00", "2015-03-10 12:47:33.500000"),
        (" 2015-3-1 4:07 ", "2015-03-01 04:07:00"),
        ("2015-03-10", "2015-03-10 00:00:00"),
        ("03/10/2015 14:47:33", "2015-03-10 14:47:33"),
        ("13/10/2015 14:47:33", "2015-10-13 14:47:33"),
        ("3/10/2015 2:47:33 PM", "2015-03-10 14:47:33"),
        ("10-Mar-2015 14:47:33", "2015-03-10 14:47:33"),
        ("Mar 10, 2015 14:47:33", "2015-03-10 14:47:33"),
        ("Tue Mar 10 14:47:33 2015", "2015-03-10 14:47:33"),
        ("Tue Mar 10 14:47:33 UTC 2015", "2015-03-10 14:47:33"),
        ("2015-03-10 14:47:33 +0200 CEST", "2015-03-10 12:47:33"),
        ("2015/03/10 14:47:33", "2015-03-10 14:47:33"),
        ("2015", None),
        ("2015-03", None),
        ("nonsense", None),
        ("", None),
    ],
)
def test_spellings(spark, cell, wanted):
    got = spark.createDataFrame([(cell,)], "c string").select(T.parse_time("c").alias("t")).first()["t"]
    assert (str(got) if got else None) == wanted


def test_durations_and_operands():
    assert [T.duration(x).total_seconds() for x in ("90s", "5m", "2h", "7d", "1w", "1d12h")] == [90, 300, 7200, 604800, 604800, 129600]
    for bad in ("", "5", "5x", "d"):
        with pytest.raises(ValueError):
            T.duration(bad)
    now = datetime(2024, 1, 15, 12)
    assert T.operand("now", now)[0] == now
    assert T.operand("time - 7d", now)[0] == datetime(2024, 1, 8, 12)
    assert T.operand("2020-01-01 + 1w", now)[0] == datetime(2020, 1, 8)
    assert T.operand("2020-06-15 12:00:00 - 90m", now) == (datetime(2020, 6, 15, 10, 30), datetime(2020, 6, 15, 10, 30, 1))


def test_periods():
    assert T.period("2020") == (datetime(2020, 1, 1), datetime(2021, 1, 1))
    assert T.period("2020-06") == (datetime(2020, 6, 1), datetime(2020, 7, 1))
    assert T.period("2020-12") == (datetime(2020, 12, 1), datetime(2021, 1, 1))
    assert T.period("2020-06-15") == (datetime(2020, 6, 15), datetime(2020, 6, 16))
    assert T.period("2020-06-15 13:45") == (datetime(2020, 6, 15, 13, 45), datetime(2020, 6, 15, 13, 46))


def test_interval_join_equals_brute_force_without_a_nested_loop(spark):
    base = datetime(2024, 1, 1)
    events = [(i, base + timedelta(seconds=137 * i)) for i in range(300)]
    anchors = [(i, base + timedelta(seconds=4001 * i, milliseconds=500)) for i in range(10)]
    e = spark.createDataFrame(events, "event long, ts timestamp")
    a = spark.createDataFrame(anchors, "anchor long, at timestamp")
    joined = T.around_anchors(e, "ts", a, "at")
    assert "NestedLoop" not in joined._jdf.queryExecution().executedPlan().toString()
    got = {(r["event"], r["anchor"]) for r in joined.collect()}
    assert got == {(i, j) for i, t in events for j, s in anchors if abs((t - s.replace(microsecond=0)).total_seconds()) <= 300}


def test_interval_join_deals_the_pairs_of_one_bucket_and_keeps_copies(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 8, raising=False)
    start = datetime(2024, 1, 1)
    events = [(i, "x", start + timedelta(milliseconds=370 * (i % 700))) for i in range(1000)] + [(7, "x", start)] * 20 + [(8, None, None)]
    anchors = [(i, start + timedelta(seconds=i)) for i in range(-330, 0, 3)] + [(0, start + timedelta(milliseconds=999))] * 15 + [(1, None)]
    e = spark.createDataFrame(events, "`event id` long, note string, at timestamp")
    a = spark.createDataFrame(anchors, "anchor long, seen timestamp")
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        joined = T.around_anchors(e, "at", a, "seen")
        assert joined.columns == ["event id", "note", "at", "anchor", "seen"]
        rows = joined.withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    wanted = sorted((i, j) for i, _, t in events if t for j, s in anchors if s and abs((t.replace(microsecond=0) - s.replace(microsecond=0)).total_seconds()) <= 300)
    assert sorted((r["event id"], r["anchor"]) for r in rows) == wanted
    most = max(sum(r["task"] == k for r in rows) for k in range(4))
    assert most < 0.5 * len(rows), "one bucket is one task's work"


def test_detects_the_time_column(spark):
    t = in_memory(spark, ["Host", "Seen"], [["a", "2024-01-01 00:00:00"], ["b", "x"], ["c", ""]])
    assert T.detect_time_column(t.with_df(t.df.where("c0 <> 'a'"))).first()["time_column"] is None
    from dataclasses import replace

    unnamed = [[str(i), "2024-01-01" if i < 2 else "x", "2024-01-01" if i < 5 else "y"] for i in range(10)]
    first = replace(in_memory(spark, ["Id", "Created", "Other"], unnamed), timeline_id=4)
    second = replace(in_memory(spark, ["Id", "Seen", "Other"], unnamed), timeline_id=5)
    third = replace(in_memory(spark, ["Id", "date", "Date"], [["1", "2024-01-01", "2024-01-01"]]), timeline_id=6)
    found = {r["timeline_id"]: r["time_col"] for r in T.detect_time_columns([first, second, third]).collect()}
    assert found == {4: 1, 5: None, 6: 1}
    named = in_memory(spark, ["Host", "Seen time"], [["a", "2024-01-01 00:00:00"], ["b", "x"], ["c", ""]])
    assert T.detect_time_column(named).first()["time_column"] == "c1"


def test_now_is_the_clock_unless_it_is_given(spark):
    t = in_memory(spark, ["When"], [["2001-01-01"], ["2999-01-01"]])
    assert ids(t, T.before(T.parse_time("c0"), "now")) == [0] and ids(t, T.after(T.parse_time("c0"), "now + 1d")) == [1]
    assert ids(t, T.after(T.parse_time("c0"), "now", now=datetime(2000, 1, 1))) == [0, 1]


def test_literals_in_all_spellings(spark):
    literals = ["2020", "2020-06", "2020-6-5", "2020/06/15", "2020-06-15 10:30", "2020-06-15T10:30", "2020/06/15 10:30", "2020-06-15 10:30:05", "Mon Jun 15 10:30:05 2020", "Mon Jun  5 10:30:05 UTC 2020", "2020-06-15 10:30:05.25 +0200 CEST", "2020-06-15 10:30:05-0130", "2020-06-15T10:30:05Z"]
    rows = in_memory(spark, ["v"], [[v] for v in [*literals, "no time", ""]]).df.select("c0", T.period_bounds("c0").alias("p")).collect()
    got = {r["c0"]: r["p"] and tuple(r["p"]) for r in rows}
    assert got["no time"] is None and got[""] is None
    for v in literals:
        start, end = got[v]
        assert (start, end) == T.period(v), v
    assert T.period("2020-06-15 10:30:05.25 +0200 CEST")[0] == datetime(2020, 6, 15, 8, 30, 5, 250000)


def test_periods_with_slashes():
    assert T.period("2020/06/15") == (datetime(2020, 6, 15), datetime(2020, 6, 16))
    assert T.period("2020/06/15 10:30") == (datetime(2020, 6, 15, 10, 30), datetime(2020, 6, 15, 10, 31))
    for bad in ("2020/06-15", "2020/06/15T10:30"):
        with pytest.raises(ValueError):
            T.period(bad)
