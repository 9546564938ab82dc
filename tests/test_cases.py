"""Readers, overlay, lists, extraction, master and exports on the small fixtures."""

import csv
import io

import pytest
from pyspark.sql import functions as F

from tidemark.functions import ordering
from tidemark.functions import predicates as P
from tidemark.model import COMMENTS, EDITS, INDICATORS, TAG_DEFS, TAGS, timeline
from tidemark.operators import extract, indicators, master, overlay, profile, rules
from tidemark.sources import annotations, delimited, exports


@pytest.mark.parametrize(
    ("content", "rows"),
    [
        ("a,b,c\n1,2,3\n4,5,6\n", [["1", "2", "3"], ["4", "5", "6"]]),
        ("a,b\n1,2\n3,4", [["1", "2"], ["3", "4"]]),
        ('id,msg\n1,"line one\nline two"\n2,ok\n', [["1", "line one\nline two"], ["2", "ok"]]),
        ('id,msg\n1,"he said ""hi"" today"\n', [["1", 'he said "hi" today']]),
        ("\ufeffa,b\r\n1,2\r\n3,4\r\n", [["1", "2"], ["3", "4"]]),
        ("a\tb\tc\n1\t2\t3\n", [["1", "2", "3"]]),
        ('id,msg\n1,ab"cd\n2,ok\n3,more\n', [["1", 'ab"cd'], ["2", "ok"], ["3", "more"]]),
        ("a,b,c\n1\n2,3,4,5,6\n", [["1", "", ""], ["2", "3", "4"]]),
        ("a,b\n", []),
    ],
)
def test_reader(spark, tmp_path, content, rows):
    path = tmp_path / "t.csv"
    path.write_bytes(content.encode())
    t = delimited.read_timeline(spark, str(path))
    got = t.df.orderBy("row_id").collect()
    assert [[r[c] for c in t.columns] for r in got] == rows
    assert [r["row_id"] for r in got] == list(range(len(rows)))
    assert t.title("c0") in ("a", "id")
    if "5,6" in content and rows[-1][-1] == "4":
        assert got[-1]["_extra"] == ["5", "6"]


def test_row_ids_follow_files_over_many_splits(spark, tmp_path):
    spark.range(5000).selectExpr("id", "repeat('x', 50) AS pad").coalesce(1).write.csv(str(tmp_path / "d"), header=True)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        t = delimited.read_timeline(spark, str(tmp_path / "d"), ",")
        assert t.df.rdd.getNumPartitions() >= 1
        assert t.df.where("row_id <> CAST(c0 AS BIGINT)").count() == 0 and t.df.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_sidecar_and_case_round_trip(spark, tmp_path):
    tags = spark.createDataFrame([(0, 1, "b"), (0, 1, "a"), (0, 3, "c")], TAGS)
    comments = spark.createDataFrame([(0, 1, "hello")], COMMENTS)
    edits = spark.createDataFrame([(0, 2, 1, "new")], EDITS)
    defs = spark.createDataFrame([("a", "#1", 0), ("b", "#2", 1)], TAG_DEFS)
    annotations.write_sidecar(str(tmp_path / "s"), tags=tags, comments=comments, edits=edits, tag_defs=defs)
    back = annotations.read_sidecar(spark, str(tmp_path / "s"))
    assert {tuple(r) for r in back["tags"].collect()} == {(0, 1, "a"), (0, 1, "b"), (0, 3, "c")}
    assert [tuple(r) for r in back["edits"].collect()] == [(0, 2, 1, "new")]
    annotations.write_case(str(tmp_path / "c"), tags=tags.unionByName(tags.withColumn("timeline_id", F.lit(1).cast("long"))), comments=comments, edits=edits, tag_defs=defs)
    annotations.write_case(str(tmp_path / "c"), tags=spark.createDataFrame([(0, 9, "z")], TAGS))
    assert [r["tags"] for r in annotations.read_case(spark, str(tmp_path / "c"), 0)["tags"].collect()] == [["z"]]
    assert annotations.read_case(spark, str(tmp_path / "c"), 1)["tags"].count() == 2


def test_sidecar_ignores_odd_keys(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"tags": {"0": ["-", "bad"], "x": ["y"], "2": []}, "comments": {"q": "?"}}')
    back = annotations.read_sidecar(spark, str(tmp_path / "x.json"))
    assert [tuple(r) for r in back["tags"].collect()] == [(0, 0, "bad")] and back["comments"].count() == 0


def test_adoption(spark):
    assert overlay.adoptable(["Time", "Tags", "Comment"]) == (1, 2)
    assert overlay.adoptable(["tag", "note", "Summary"]) == (0, 1)
    assert overlay.adoptable(["Time", "Notes"]) == (None, 1)
    assert overlay.adoptable(["Tag", "Tags", "Comment", "Note"]) == (0, 2)
    cells = spark.createDataFrame([("bad, lateral-movement",), ("a; b ;c",), (" , ,, ",), ("-",), ("bad, -",)], "c string")
    got = [r["t"] for r in cells.select(overlay.split_tags(F.col("c")).alias("t")).collect()]
    assert got == [["bad", "lateral-movement"], ["a", "b", "c"], [], [], ["bad"]]


def test_palette_highlight_rename_and_delete(spark):
    defs = spark.createDataFrame([("Bad", "#E53935", 0), ("Good", "#43A047", 1), ("none", "none", 2), ("beacon", "#1", 3)], TAG_DEFS)
    tags = spark.createDataFrame([(0, 0, "Good"), (0, 0, "Bad"), (0, 1, "none"), (0, 2, "beacon"), (0, 2, "Bad")], TAGS)
    assert {r["row_id"]: r["color"] for r in overlay.highlights(tags, defs).collect()} == {0: "#E53935", 1: None, 2: "#E53935"}
    renamed, palette = overlay.rename_tag(tags, defs, "beacon", "c2")
    assert renamed.where("tag = 'c2'").count() == 1 and palette.where("name = 'c2' AND priority = 3").count() == 1
    for old, new in (("beacon", "Bad"), ("gone", "x"), ("beacon", " ")):
        with pytest.raises(ValueError):
            overlay.rename_tag(tags, defs, old, new)
    assert overlay.delete_tag(tags, "beacon").count() == 4


LIST_ROWS = [["2024-01-01 00:00:00", "psexec service install", "dc1"], ["2024-01-02 00:00:00", "user logon", "ws2"], ["2024-01-03 00:00:00", "EVIL.exe dropped", "ws3"], ["2024-01-04 00:00:00", "T1059 detected", "dc1"]]


def scanned(spark, content, rules=None):
    t = delimited.in_memory(spark, ["Timestamp", "Summary", "Host"], LIST_ROWS)
    lines = spark.createDataFrame(indicators.parse_text("l", content), "list string, line int, text string")
    found = indicators.label_blocks(indicators.classify(lines))
    compiled = indicators.compiled(found, {k: v(t) for k, v in (rules or {}).items()})
    return compiled, sorted((r["row_id"], r["label"]) for r in indicators.scan(t, compiled).collect()), found


def test_lists(spark):
    rule = {("l", 3): lambda t: P.field_equals(t, "Summary", "psexec") & P.field_equals(t, "Host", "dc1")}
    compiled, hits, _ = scanned(spark, "evil.exe\n/T[0-9]{4}/\n`Summary=psexec AND Host=dc1`\n# note\n\nTimestamp before 2024-01-02", rule)
    assert len(compiled) == 4 and [h[0] for h in hits] == [0, 2, 3]
    compiled, _, found = scanned(spark, "/[/\ngood")
    assert len(compiled) == 1 and [r["line"] for r in indicators.regex_errors(found).collect()] == [1]
    assert scanned(spark, "# only a comment")[1] == []
    assert scanned(spark, "## lateral movement\npsexec\n/T[0-9]{4}/")[1] == [(0, "lateral movement"), (3, "lateral movement")]
    assert scanned(spark, "## Test\npsexec\n\n/T[0-9]{4}/")[1] == [(0, "Test"), (3, "")]
    assert scanned(spark, "## Test\n# note\npsexec")[1] == [(0, "Test")]


def test_many_literals_equal_the_generated_scan(spark):
    t = delimited.in_memory(spark, ["Summary"], [["alpha beta gamma delta"], ["beta gamma"], ["xbeta gamma deltax"], [""]])
    lines = [("l", i + 1, "plain", v, "") for i, v in enumerate(["a beta gamma d", "gamma", "Alpha", "a b c d", "beta gamma delta"])]
    many = indicators.scan_many(t, spark.createDataFrame(lines, "list string, line int, kind string, value string, label string"))
    few = indicators.scan(t, [indicators.Indicator(*x) for x in lines])
    assert sorted((r["row_id"], r["line"]) for r in many.collect()) == sorted((r["row_id"], r["line"]) for r in few.collect())


def test_comment_merge(spark):
    rows = spark.createDataFrame([("", "L"), ("x L y", "L"), ("c", "L"), ("c", "")], "c string, l string")
    assert [r[0] for r in rows.select(indicators.merge_label(F.col("c"), F.col("l"))).collect()] == ["L", "x L y", "L; c", "c"]


def test_extraction(spark):
    def kinds(cell):
        got = spark.createDataFrame([(cell,)], "c string").select(extract.found("c").alias("f")).first()["f"]
        return [(x["kind"], x["text"]) for x in got]

    assert kinds("") == kinds("   ") == []
    assert len(kinds("evil.exe")) == 1
    assert kinds("connection from 192.168.1.44 established")[0] == ("ipv4", "192.168.1.44")
    for kind, n in (("md5", 32), ("sha1", 40), ("sha256", 64)):
        assert kinds("x " + "a1" * (n // 2))[0] == (kind, "a1" * (n // 2))
    assert ("windows_path", "C:\\Users\\bob\\evil.exe") in kinds("ran C:\\Users\\bob\\evil.exe now")
    assert ("email", "bob@evil.com") in kinds("mail from bob@evil.com via relay")
    assert [t for _, t in kinds("evil.com evil.com")].count("evil.com") == 1


def test_spans(spark):
    t = delimited.in_memory(spark, ["Summary"], [["ran /tmp/evil and /tmp/other"], ["aaaa"]])
    regex = profile.regex_spans(t.df, "row_id", "c0", "/tmp/").collect()
    assert [(r["start"], r["end"]) for r in regex] == [(4, 9), (18, 23)]
    got = {(r["row_id"], r["start"], r["end"]) for r in profile.spans(t, [("Summary", "EVIL"), ("Summary", "aa")]).collect()}
    assert got == {(0, 9, 13), (1, 0, 2), (1, 2, 4)}
    merged = profile.merge_spans(spark.createDataFrame([(1, 0, 2), (1, 2, 4), (1, 0, 3), (1, 6, 7)], "k int, start int, end int"), ["k"])
    assert sorted((r["start"], r["end"]) for r in merged.collect()) == [(0, 4), (6, 7)]


def test_spans_are_joined_where_cells_are_read(spark):
    from tidemark.functions.predicates import Condition, FilterSpec

    cells = [["", ""], ["the here", "aaa"], ["otherer \U0001f600 erthe", "x"], ["none", "er"], ["the" * 70_000, "heer the\u0001her"]]
    t = delimited.in_memory(spark, ["Summary", "Note"], cells)
    words = ["the", "he", "er"]
    spec = FilterSpec(conditions=[Condition("any", [w]) for w in words], match_all=False)
    found = profile.highlights(t, spec)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan, "matches are shuffled and sorted"
    wanted = []
    for row, line in enumerate(cells):
        for c, cell in enumerate(line):
            covered = []
            for start, end in sorted((k, k + len(w)) for w in words for k in range(len(cell)) if cell.startswith(w, k)):
                if covered and start <= covered[-1][1]:
                    covered[-1][1] = max(end, covered[-1][1])
                else:
                    covered.append([start, end])
            wanted += [(row, f"c{c}", *x) for x in covered]
    assert sorted(tuple(r) for r in found.collect()) == wanted
    apart = profile.spans(t, [("any", w) for w in words])
    assert sorted(tuple(r) for r in profile.merge_spans(apart, ["row_id", "column"]).select("row_id", "column", "start", "end").collect()) == wanted


def test_master_over_two_shapes(spark):
    from dataclasses import replace

    a = replace(delimited.in_memory(spark, ["Timestamp", "Computer", "Message"], [["2024-01-01 09:02:10", "ws1", "ticket forged"], ["2024-01-01 08:12:03", "ws1", "initial access"]]), time_column="c0", timeline_id=1, name="A")
    b = replace(delimited.in_memory(spark, ["When", "Computer", "Message"], [["2024-01-01 08:14:55", "dc1", "outbound c2"], ["not-a-time", "dc1", "odd"]]), time_column="c0", timeline_id=2, name="B")
    tags = spark.createDataFrame([(1, 0, "x"), (1, 1, "x"), (2, 0, "x"), (2, 1, "y")], TAGS)
    comments = spark.createDataFrame([], COMMENTS)
    lines = delimited.register([(t.timeline_id, t.name, "", t.df, [t.title(c) for c in t.columns], 0) for t in (a, b)], spark)
    snaps = [(t, master.snapshot(t, tags)) for t in (a, b)]
    rows = master.master(snaps[0][1].unionByName(snaps[1][1]), lines, tags, comments).orderBy(*master.master_order()).collect()
    assert [r["cells"][2] for r in rows] == ["initial access", "outbound c2", "ticket forged", "odd"]
    grid = master.aligned(snaps, tags, comments, lines)
    host = grid.resolve("Computer")
    assert grid.df.where(F.col(host) == "ws1").count() == 2 and grid.df.where((F.col(host) == "dc1") & (F.col("time") == "not-a-time")).count() == 1
    assert overlay.still_tagged(snaps[1][1], overlay.delete_tag(tags, "y")).count() == 1


def test_master_rows_that_share_ids_and_headers(spark):
    """Equal row ids in two timelines, headers called as the fixed ones are, or alike but for case, or twice in one timeline."""
    from dataclasses import replace

    make = lambda i, name, headers, rows: replace(delimited.in_memory(spark, headers, rows), time_column="c0", timeline_id=i, name=name)
    a = make(1, "A", ["Time", "Host", "host", "Note"], [["2024-01-02", "alpha one", "x", "n"], ["2024-01-01", "beta", "y alpha", "n"]])
    b = make(2, "B", ["When", "host", "Summary", "host"], [["2024-01-03", "first", "alpha", "last alpha"], ["", "", "", "alphaalpha"]])
    tags = spark.createDataFrame([(1, 0, "x"), (1, 1, "x"), (2, 0, "x"), (2, 1, "y")], TAGS)
    comments = spark.createDataFrame([(2, 0, "seen")], COMMENTS)
    lines = delimited.register([(t.timeline_id, t.name, "", t.df, [t.title(c) for c in t.columns], 0) for t in (a, b)], spark)
    t = master.aligned([(x, master.snapshot(x, tags)) for x in (a, b)], tags, comments, lines, numbered=True)
    assert [t.title(c) for c in t.columns] == ["Time", "Timeline", "Time", "Host", "host", "When", "Summary"]
    got = t.df.orderBy("position").collect()
    assert [(r["timeline_id"], r["row_id"], r["position"]) for r in got] == [(1, 1, 0), (1, 0, 1), (2, 0, 2), (2, 1, 3)]
    assert [r["c2"] for r in got] == ["y alpha", "x", "last alpha", "alphaalpha"] and got[2]["comment"] == "seen"
    spans = profile.highlights(t, P.FilterSpec(query="alpha"))
    assert sorted((r["timeline_id"], r["row_id"], t.title(r["column"]), r["start"], r["end"]) for r in spans.collect()) == [(1, 0, "Host", 0, 5), (1, 1, "host", 2, 7), (2, 0, "Summary", 0, 5), (2, 0, "host", 5, 10), (2, 1, "host", 0, 10)]
    hits = indicators.scan(t, [indicators.Indicator("l", 1, "plain", "last", "tail")])
    assert [tuple(r) for r in hits.collect()] == [(2, 0, "l", 1, "tail")]
    assert [tuple(r) for r in indicators.run_all(t, hits).collect()] == [(2, 0, ["ioc:l", "x"], "tail; seen")]
    assert {tuple(r) for r in indicators.hit_tags(hits).collect()} == {(2, 0, "ioc:l")}
    assert [r["row_id"] for r in t.df.where(P.field_equals(t, "row", "3")).collect()] == [0]
    assert [(r["timeline_id"], r["row_id"]) for r in ordering.sort(t, [("Timeline", True)]).df.collect()] == [(2, 0), (2, 1), (1, 1), (1, 0)]
    with pytest.raises(ValueError):
        replace(t, number=None).text("row")
    more = overlay.attach_comments(overlay.attach_tags(t, tags.withColumn("tag", F.lit("z"))), comments)
    assert {(r["timeline_id"], r["row_id"], r["comment"], *r["tags"]) for r in more.df.collect()} == {(1, 0, "", "z"), (1, 1, "", "z"), (2, 0, "seen", "z"), (2, 1, "", "z")}


def test_summaries_show_for_all_entries_if_one_lacks_cells(spark):
    from dataclasses import replace

    t = replace(delimited.in_memory(spark, ["When", "Host"], [["2024-01-01", "a"], ["2024-01-02", "b"]]), time_column="c0", timeline_id=1, name="A")
    tags = spark.createDataFrame([(1, 0, "x"), (1, 1, "x")], TAGS)
    lines = delimited.register([(1, "A", "", t.df, ["When", "Host"], 0)], spark)
    snap = master.snapshot(t, tags)
    none = spark.createDataFrame([], COMMENTS)
    assert [master.aligned([(t, snap)], tags, none, lines).title(c) for c in ("c0", "c1")] == ["When", "Host"]
    old = snap.withColumn("cells", F.when(F.col("row_id") == 0, F.array().cast("array<string>")).otherwise(F.col("cells")))
    grid = master.aligned([(t, old)], tags, none, lines)
    assert [(r["c1"], r["summary"]) for r in grid.df.orderBy("row_id").collect()] == [("", "2024-01-01 | a"), ("b", "2024-01-02 | b")]
    assert master.aligned([(t, snap.limit(0))], tags, none, lines).df.count() == 0


def test_the_last_of_several_edits_counts(spark):
    t = delimited.in_memory(spark, ["v", "w"], [["a", "b"], ["c", "d"]])
    edits = spark.createDataFrame([(0, 0, 0, "new", 2), (0, 0, 0, "older", 1), (0, 1, 1, "x", 1), (0, 1, 1, "y", 1)], EDITS + ", seq int")
    assert [(r["c0"], r["c1"]) for r in overlay.apply_edits(t, edits).df.orderBy("row_id").collect()] == [("new", "b"), ("c", "y")]
    assert [(r["c0"], r["c1"]) for r in overlay.apply_edits(t, edits.drop("seq")).df.orderBy("row_id").collect()] == [("older", "b"), ("c", "y")]
    comments = spark.createDataFrame([(0, 0, "old"), (0, 1, "kept")], COMMENTS)
    new = spark.createDataFrame([(0, 0, "first", 1), (0, 0, "second", 2), (0, 2, "x", 1), (0, 2, "", 2)], COMMENTS + ", seq int")
    assert {tuple(r) for r in overlay.set_values(comments, new, overlay.KEY, "comment").collect()} == {(0, 0, "second"), (0, 1, "kept")}


def test_cased_filters_highlight_their_case_only(spark):
    t = delimited.in_memory(spark, ["v"], [["Evil evil EVIL"]])
    got = lambda **spec: sorted((r["start"], r["end"]) for r in profile.highlights(t, P.FilterSpec(**spec)).collect())
    assert got(query="evil") == [(0, 4), (5, 9), (10, 14)] and got(query="evil", cased=True) == [(5, 9)]
    assert got(query="E[Vv]", query_regex=True, cased=True) == [(0, 2), (10, 12)]


def test_exports(spark, tmp_path):
    t = delimited.in_memory(spark, ["host", "event"], [["alpha", "login"], ["bravo", "logout"]])
    tags = spark.createDataFrame([(0, 0, "flag")], TAGS)
    comments = spark.createDataFrame([(0, 0, "look here")], COMMENTS)
    edits = spark.createDataFrame([(0, 1, 1, "LOGOUT")], EDITS)
    t = overlay.apply_edits(overlay.attach_comments(overlay.attach_tags(t, tags), comments), edits)
    assert [tuple(r) for r in exports.view(t).collect()] == [("alpha", "login", "flag", "look here"), ("bravo", "LOGOUT", "", "")]
    lead = exports.with_prelude(t, "saw psexec at 03:14").collect()
    assert tuple(lead[0])[1:3] == ("Timeline comments:", "saw psexec at 03:14") and len(lead) == 4
    assert len(exports.with_prelude(t, " ").collect()) == 3
    exports.write_csv(exports.view(t), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("*.csv")))
    assert "alpha,login,flag,look here\n" in text and "bravo,LOGOUT,,\n" in text
    row = exports.to_timeline(t, [("E", ["c1", "c0"]), ("N", [])], annotated_only=True).collect()
    assert [tuple(r) for r in row] == [(0, "event: login; host: alpha; ", "")]


def test_edited_snapshot_is_padded(spark):
    row = spark.createDataFrame([(["a"],)], "cells array<string>").select(overlay.edit_cells(F.col("cells"), F.create_map(F.lit(2), F.lit("x"))).alias("c"))
    assert row.first()["c"] == ["a", "", "x"]


def test_file_of_a_view_in_its_order(spark, tmp_path):
    """The comment and the header come once and first, however many parts there are; cells with line breaks, quotes and commas stay whole."""
    rows = [[f"h{i % 7}", f"{i}", 'a "b", c' if i % 5 else "x\ny"] for i in range(300)]
    t = delimited.in_memory(spark, ["Host", "n", "Host"], rows)
    t = overlay.attach_tags(t, spark.createDataFrame([(0, i, g) for i in range(0, 300, 10) for g in ("p", "q")], TAGS))
    t = overlay.attach_comments(t, spark.createDataFrame([(0, 5, "c")], COMMENTS))

    def written(name, **more):
        exports.write_view(t, str(tmp_path / name), [("Host", True), ("n", True)], **more)
        return "".join(p.read_text() for p in sorted((tmp_path / name).glob("part-*")))

    order = sorted(range(300), key=lambda i: (-(i % 7), -i))
    want = io.StringIO()
    out = csv.writer(want, lineterminator="\n")
    out.writerow(["Timeline comments:", "one, two"])
    out.writerow(["Host", "n", "Host", "Tags", "Comment"])
    out.writerows([[*rows[i], "" if i % 10 else "p, q", "c" if i == 5 else ""] for i in order])
    assert written("view", comment="one, two") == want.getvalue()
    lines = written("layout", layout=[("A,B", ["c1"]), ("None", []), ("Tag", ["tags"])], annotated_only=True).splitlines()
    assert lines[0] == '"A,B",None,Tag' and lines[1:] == [f'{i},,{"" if i % 10 else chr(34) + "p, q" + chr(34)}' for i in order if i % 10 == 0 or i == 5]
    empty = t.with_df(t.df.where("false"))
    exports.write_view(empty, str(tmp_path / "none"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "none").glob("part-*"))) == "Host,n,Host,Tags,Comment\n"


def test_first_values_follow_the_view(spark, monkeypatch):
    """The view's order decides which values they are, whether the head of the view is enough or not; the result is sorted."""
    rows = [["b", "1"], ["a", "2"], ["", "3"], ["b", "9"], ["c", "8"], ["d", "7"]]
    t = delimited.in_memory(spark, ["v", "n"], rows)
    for head in (4, 1):
        monkeypatch.setattr(profile, "HEAD", head)
        got = lambda limit, keys: [(r["value"], r["truncated"]) for r in profile.distinct_values(t, "v", limit, keys).collect()]
        assert got(2, [("n", True)]) == [("b", True), ("c", True)]
        assert got(3, [("n", False)]) == [("", True), ("a", True), ("b", True)]
        assert got(5, [("v", True)]) == [("", False), ("a", False), ("b", False), ("c", False), ("d", False)]
        assert got(2, [("v", True)]) == [("", True), ("d", True)]
    assert profile.distinct_values(t.with_df(t.df.where("false")), "v").collect() == []


def test_rules_as_rows_and_as_text(spark, monkeypatch):
    """Every kind of test, bits in several words; each rule that cannot be used is reported, and the rest run."""
    t = delimited.in_memory(spark, ["Summary", "When"], [["psexec on dc1", "2024-01-02 10:00"], ["PSEXEC", ""], ["", "2024-03-01"], ["nothing", "2024-01-31"]])
    t = overlay.attach_tags(t, spark.createDataFrame([(0, 1, "Bad"), (0, 3, "bad")], TAGS))
    tests = [
        (1, "Summary", "exact", "psexec", False), (2, "Summary", "contains", "psexec", False), (3, "Summary", "empty", "", False), (4, "when", "between", "2024-01-02 and 2024-01", False),
        (5, "When", "before", "2024-01-31", False), (6, "When", "after", "2024-01-31", False), (7, "", "has_tag", "Bad", False), (8, "", "tagged", "", True), (9, "Summary", "regex", "^n", False), (10, "any", "filled", "", True),
    ]
    want = {1: [1], 2: [0, 1], 3: [2], 4: [0, 3], 5: [0], 6: [2], 7: [1], 8: [0, 2], 9: [3], 10: []}
    texts = {20: ("Summary = 'PSEXEC' OR get(tags, 0) = 'bad'", [1, 3]), 21: ("summary LIKE '%dc1'", [0]), 22: ("CAST(null AS boolean)", [])}
    wrong = {30: "Gone = 1", 31: "= =", 32: " ", 33: "length(Summary)", 34: "count(*) > 0"}
    bad_rows = [(40, "Gone", "contains", "x", False), (41, "Summary", "like", "x", False), (42, "Summary", "regex", "(", False), (43, "When", "before", "soon", False), (44, "When", "between", "2024", False), (45, "Summary", "contains", "psexec", False), (45, "Gone", "filled", "", False)]
    both = [(50, "Summary", "contains", "dc1", False), (50, "Summary", "contains", "dc1", True)]
    clauses = [(f"l{n}", n, 1, *rest) for n, *rest in [*tests, *bad_rows, *both]] + [("l51", 51, 1, "Summary", "contains", "dc1", False), ("l51", 51, 2, "Summary", "empty", "", False), ("gone", 1, 1, "Summary", "empty", "", False)]
    texts_of = {**{n: x for n, (x, _) in texts.items()}, **wrong}
    lines = [(f"l{n}", n, texts_of.get(n, ""), "") for n in sorted({c[1] for c in clauses if c[0] != "gone"} | set(texts_of))]
    lists = rules.rule_lines(spark, lines).unionByName(spark.createDataFrame([("r", 1, "regex", "[", "")], INDICATORS))
    for bits in (62, 3):
        monkeypatch.setattr(rules, "BITS", bits)
        hits, errors = rules.scan_lists(t, lists, spark.createDataFrame(clauses, rules.CLAUSES))
        got = {}
        for r in hits.collect():
            got.setdefault(r["line"], []).append(r["row_id"])
        assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in {**want, **{n: w for n, (_, w) in texts.items()}, 51: [0, 2]}.items() if v}
        reported = {(r["list"], r["line"]) for r in errors.where("error <> ''").collect()}
        assert reported == {("r", 1), ("gone", 1), *((f"l{n}", n) for n in [*wrong, 40, 41, 42, 43, 44, 45])}
    assert rules.scan_lists(t, lists.limit(0))[1].count() == 0


def test_long_lists_keep_the_key_of_rows(spark):
    """Rows of two timelines with one number are two rows."""
    df = spark.createDataFrame([(1, 0, "alpha"), (2, 0, "beta"), (2, 1, "alpha beta")], "timeline_id bigint, row_id bigint, c string")
    t = timeline(df, ["c"], key=("timeline_id", "row_id"), number=None)
    lists = spark.createDataFrame([("l", 1, "plain", "alpha", ""), ("l", 2, "plain", "BETA", ""), ("l", 3, "regex", "^b", "")], INDICATORS)
    got = sorted((r["timeline_id"], r["row_id"], r["line"]) for r in indicators.scan_many(t, lists).collect())
    assert got == [(1, 0, 1), (2, 0, 2), (2, 1, 1)]


def test_distinct_values_are_cut_in_row_order(spark):
    t = delimited.in_memory(spark, ["v"], [["b"], ["a"], ["b"], ["c"]])
    got = profile.distinct_values(t, "v", 2).collect()
    assert sorted(r["value"] for r in got) == ["a", "b"] and all(r["truncated"] for r in got)


LONG = 100_000


@pytest.mark.parametrize("unit", ["a.", "/a", "a-", "a@", "\\\\a", "1.1.", "ab:", "a b ", " ", "a.b@"])
def test_extraction_survives_long_cells(spark, unit):
    """A run of any sort is read in time that grows with its length, and no call stack grows with it."""
    cell = "see 10.0.0.1 " + unit * (LONG // len(unit)) + " and bob@evil.com x"
    got = spark.createDataFrame([(cell,)], "c string").select(extract.found("c", fallback=False).alias("f")).first()["f"]
    assert ("ipv4", "10.0.0.1") in [tuple(x) for x in got]
    assert unit == "a b " or unit == " " or ("email", "bob@evil.com") in [tuple(x) for x in got]


@pytest.mark.parametrize(
    ("cell", "kind", "wanted"),
    [
        ("via 2001:db8:1:2 now", "ipv6", ["2001:db8:1:2"]),
        ("999.300.1.2:80", "ipv4", ["999.300.1.2:80"]),
        ("ls /home/~bob/a%20b+c/é end", "unix_path", ["/home/~bob/a%20b+c/é"]),
        ("C:\\a\\b,c:\\d;x", "windows_path", ["C:\\a\\b", "c:\\d"]),
        ("x" * 64 + ".com " + "y" * 63 + ".org", "domain", ["y" * 63 + ".org"]),
        ("foo.com.1x -a..b.net", "domain", ["foo.com", "b.net"]),
        ("..a.b@c.com.x@y.org a@b@c.de", "email", ["a.b@c.com", ".x@y.org", "b@c.de"]),
        ("{0a1b2c3d-0000-1111-2222-0123456789ab}", "guid", ["0a1b2c3d-0000-1111-2222-0123456789ab"]),
    ],
)
def test_extraction_of_each_kind(spark, cell, kind, wanted):
    got = spark.createDataFrame([(cell,)], "c string").select(extract.found("c", fallback=False).alias("f")).first()["f"]
    assert [x["text"] for x in got if x["kind"] == kind] == wanted


def test_extraction_equals_the_plain_patterns(spark):
    """The patterns that are written otherwise for Java find what the plain ones find."""
    import random
    import re

    rng = random.Random(2)
    cells = ["".join(rng.choice(["a", "b1", ".", "..", "-", "@", "_", "%", " ", "com", "x.org", "é"]) for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    rows = spark.createDataFrame([(c,) for c in cells], "c string").select("c", extract.found("c", fallback=False).alias("f")).collect()
    plain = dict(extract.DETECTORS)
    for r in rows:
        seen = set()
        for kind, _ in extract.DETECTORS:
            wanted = [t for t in dict.fromkeys(m.strip(extract._EDGES) for m in (x[0] for x in re.finditer(plain[kind], r["c"]))) if t and t not in seen]
            assert [x["text"] for x in r["f"] if x["kind"] == kind] == wanted, (r["c"], kind)
            seen |= set(wanted)


def test_reader_survives_long_records(spark, tmp_path):
    long = "x" * LONG
    (tmp_path / "wide.csv").write_text(f'a,b\n1,2,"{long}"\n3,4,{long},"q ""x"" r",\n5\n')
    got = delimited.read_timeline(spark, str(tmp_path / "wide.csv")).df.orderBy("row_id").collect()
    assert [len(x) for x in got[0]["_extra"]] == [LONG] and got[1]["_extra"] == [long, 'q "x" r', ""] and got[2]["_extra"] == []
    (tmp_path / "head.csv").write_text('"' + 'ab""c' * (LONG // 5) + '";b\n1;2\n')
    t = delimited.read_timeline(spark, str(tmp_path / "head.csv"))
    assert len(t.title("c0")) == LONG // 5 * 4 and t.df.count() == 1 and delimited.sniff(spark, str(tmp_path / "head.csv")) == ";"


@pytest.mark.parametrize(("split", "delimiter", "end"), [(64, ",", "\n"), (700, ";", "\r\n"), (10_000_000, "\t", "\n")])
def test_quoted_line_breaks_over_many_splits(spark, tmp_path, split, delimiter, end):
    """Records of many lines, stray quotes, blank lines and cells of nothing but quotes and breaks, cut anywhere, against the csv module."""
    import csv
    import io
    import random

    rng = random.Random(split)
    bits = ["x", "word", "\n", "\n\n", '"', '""', delimiter, " ", "é", end]
    want = []
    for k in range(3):
        rows = [["a", "b", "c"]] + [["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(3)] for _ in range(80)]
        rows[5][1] = "line\n" * 200
        out = io.StringIO()
        csv.writer(out, delimiter=delimiter, lineterminator=end).writerows(rows)
        out.write(f'stray"quote{delimiter}{delimiter}1{end}{end}last{delimiter}{delimiter}2')
        (tmp_path / f"f{k}.csv").write_bytes(out.getvalue().encode())
        want += [*rows[1:], ['stray"quote', "", "1"], ["", "", ""], ["last", "", "2"]]
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = [spark.conf.get(n) for n in names]
    for n in names:
        spark.conf.set(n, str(split))
    try:
        got = delimited.read_timeline(spark, str(tmp_path), delimiter).df.orderBy("row_id").collect()
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)
    assert [r["row_id"] for r in got] == list(range(len(want)))
    assert [[r["c0"], r["c1"], r["c2"]] for r in got] == want


def _plain(content, delimiter):
    """Records and cells by the rule, character by character."""
    records, cells, cell, state = [], [], "", "start"
    for c in content.removesuffix("\n") + "\n":
        if state == "quoted":
            state, cell = ("closing", cell) if c == '"' else ("quoted", cell + c)
            continue
        if state == "closing" and c == '"':
            state, cell = "quoted", cell + c
        elif c == delimiter:
            cells, cell, state = [*cells, cell], "", "start"
        elif c == "\n":
            records.append([*cells, cell])
            cells, cell, state = [], "", "start"
        elif c == '"' and state == "start":
            state = "quoted"
        else:
            state, cell = "open", cell + c
    return records


@pytest.mark.parametrize("split", [48, 10_000_000])
def test_one_rule_for_all_lines(spark, tmp_path, split):
    """Blank lines, stray and closing quotes with text behind them, alone and beside quoted line breaks, against the rule itself."""
    import random

    rng = random.Random(split)
    bits = ["x", '"', '""', ",", ",", "\n", "\n\n", "é", ' "', ',"a', '",']
    contents = ["h1,h2,h3\n" + "".join(rng.choice(bits) for _ in range(400)) + '"\n' for _ in range(6)]
    contents = [c if _closed(c) else c + '",\n' for c in contents]
    contents += ['h1,h2\n"abc"def,1\n\n"a""b"c""d"e,"2\n3"x\n', 'h1,h2\n"abc"def,1\n\n"a""b"c""d"e,"2 3"x\n\n\n']
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = [spark.conf.get(n) for n in names]
    for n in names:
        spark.conf.set(n, str(split))
    try:
        for k, content in enumerate(contents):
            (tmp_path / f"{k}.csv").write_bytes(content.encode())
            t = delimited.read_timeline(spark, str(tmp_path / f"{k}.csv"), ",")
            got = [[r[c] for c in t.columns] + r["_extra"] for r in t.df.orderBy("row_id").collect()]
            want = [r + [""] * (len(t.columns) - len(r)) for r in _plain(content, ",")[1:]]
            assert got == want, content
        t = delimited.read_timeline(spark, str(tmp_path), ",")
        assert [r["row_id"] for r in t.df.select("row_id").orderBy("row_id").collect()] == list(range(sum(len(_plain(c, ",")) - 1 for c in contents)))
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)


def _closed(content):
    from tidemark.sources.records import first_record

    lines = content.removesuffix("\n").split("\n")
    while lines:
        record = first_record(lines, ",")
        if record is None:
            return False
        lines = lines[record.count("\n") + 1 :]
    return True


def test_a_quote_that_is_never_closed_is_reported(spark, tmp_path, monkeypatch):
    from tidemark.sources import records

    (tmp_path / "bad.csv").write_text('a,b\n1,2\n3,"open\n' + "4,5\n" * 300)
    t = delimited.read_timeline(spark, str(tmp_path / "bad.csv"), ",")
    assert [r["row_id"] for r in t.df.orderBy("row_id").collect()] == [0, 1]
    monkeypatch.setattr(records, "MOST_CHARS", 500)
    with pytest.raises(Exception, match="bad.csv: a record of more than 500 characters"):
        delimited.read_timeline(spark, str(tmp_path / "bad.csv"), ",").df.collect()


def test_reader_of_several_files_with_headers(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"part-{k}.csv").write_text("a,b\n" + "".join(f"{10 * k + i},x\n" for i in range(k + 1)))
    got = delimited.read_timeline(spark, str(tmp_path)).df.orderBy("row_id").collect()
    assert [(r["row_id"], r["c0"]) for r in got] == list(enumerate(["0", "10", "11", "20", "21", "22"]))


def test_written_case_can_be_cleared(spark, tmp_path):
    tags = spark.createDataFrame([(0, 1, "a"), (1, 1, "b")], TAGS)
    annotations.write_case(str(tmp_path / "c"), tags=tags)
    annotations.write_case(str(tmp_path / "c"), timelines=[0], tags=tags.limit(0))
    assert {r["timeline_id"] for r in spark.read.schema(TAGS).parquet(str(tmp_path / "c" / "tags")).collect()} == {1}


def test_regular_expressions_are_checked_by_what_runs_them(spark):
    t = delimited.in_memory(spark, ["v"], [["abc"], ["É1"], ["xx"]])
    assert [r["row_id"] for r in t.df.where(P.matches("c0", r"(?P<n>a)b")).collect()] == [0]
    assert [r["row_id"] for r in t.df.where(P.matches("c0", r"^\p{L}\d$")).collect()] == [1]
    for bad in ("(", "[", r"(?<=a)b", r"(a)\1", r"(?<n>a)\k<n>", "a{2,1}", "*"):
        with pytest.raises(ValueError):
            P.check_regex(bad)
    assert P.check_regex(r"a\\1") and P.check_regex("(?<n>a)")


def test_spans_of_a_filter(spark):
    t = delimited.in_memory(spark, ["Host", "Summary"], [["ws1", "ran /tmp/evil and /tmp/other"], ["tmpish host", "aaaa"]])
    got = lambda **spec: sorted((r["row_id"], r["column"], r["start"], r["end"]) for r in profile.highlights(t, P.FilterSpec(**spec)).collect())
    assert got(conditions=[P.Condition("Summary", ["/tmp/"], regex=True)]) == [(0, "c1", 4, 9), (0, "c1", 18, 23)]
    assert got(query="EVIL") == [(0, "c1", 9, 13)]
    assert got(where=P.Tree("not", (P.Condition("any", ["tmp"]),))) == []
    assert got(where=P.Tree("not", (P.Tree("not", (P.Condition("Summary", ["evil"]),)),))) == [(0, "c1", 9, 13)]
    assert got(where=P.Tree("not", (P.Condition("Summary", ["evil"], exclude=True),))) == [(0, "c1", 9, 13)]
    assert got(quick={"Summary": "other", "Host": "*"}) == [(0, "c1", 23, 28)]
    assert got(conditions=[P.Condition("any", ["aa", "aaa"])]) == [(1, "c1", 0, 4)]
    assert got(conditions=[P.Condition("any", ["evil|x*"], regex=True)]) == [(0, "c1", 9, 13)]
    tree = P.Tree("or", (P.Condition("Host", ["ws1"]), P.Tree("not", (P.Condition("Summary", ["aa"]),))))
    assert [r["row_id"] for r in P.FilterSpec(where=tree).apply(t).df.collect()] == [0]


def test_long_lists_with_every_kind_of_line(spark, monkeypatch):
    """Literals in any data column, in several blocks and passes; bad expressions are left out."""
    t = delimited.in_memory(spark, ["Summary", "Host"], [["alpha beta", "DC1"], ["x\ty", "ws2"], ["gamma alpha", ""], ["", "nothing"]])
    rows = [("l", 1, "plain", "dc1", "host"), ("l", 2, "plain", "Alpha", "a"), ("m", 1, "plain", "alpha", "b"), ("m", 2, "regex", "^ws[0-9]$", "r"), ("m", 3, "regex", "(", ""), ("n", 1, "rule", "", "rule"), ("l", 9, "plain", "alpha", "late"), ("l", 8, "plain", "x\ty", "tab")]
    lists = spark.createDataFrame(rows, "list string, line int, kind string, value string, label string")
    rules = {("n", 1): P.filled("c1")}
    want = {(0, "l", 1, "host"), (0, "m", 1, "b"), (0, "n", 1, "rule"), (1, "l", 8, "tab"), (1, "m", 2, "r"), (1, "n", 1, "rule"), (2, "l", 2, "a"), (2, "m", 1, "b"), (3, "n", 1, "rule")}
    assert {tuple(r) for r in indicators.scan_many(t, lists, rules).collect()} == want
    monkeypatch.setattr(indicators, "BROADCAST_BYTES", 40)
    monkeypatch.setattr(indicators, "AUTOMATON_BYTES", 20)
    assert {tuple(r) for r in indicators.scan_many(t, lists, rules).collect()} == want
    assert indicators.scan_many(t, lists.limit(0)).count() == 0
