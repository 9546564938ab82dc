"""Time: flexible parsing, period literals, durations, window pivots, detection of the time column."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import Timeline
from .predicates import stripped, text

#: Layouts in the order in which they are tried, as (shape of the cell, Spark pattern).
_DATE, _TIME, _FRACTION = r"\d{4}-\d{1,2}-\d{1,2}", r"\d{1,2}:\d{1,2}:\d{1,2}", r"(\.\d{1,9})?"
_DAY = r"(?i:mon|tue|wed|thu|fri|sat|sun)[a-z]*\s+"
LAYOUTS: list[tuple[str, str]] = [
    (rf"\d{{4}}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d{_FRACTION}([Zz]|[+-]\d\d:\d\d)", "yyyy-MM-dd HH:mm:ss[.SSSSSSSSS]XXX"),
    (rf"{_DATE}T{_TIME}", "yyyy-M-d H:m:s"),
    (rf"{_DATE} {_TIME}{_FRACTION} [+-]\d{{4}} \S+", "yyyy-M-d H:m:s[.SSSSSSSSS] xx"),
    (rf"{_DATE} {_TIME}{_FRACTION}[+-]\d{{4}}", "yyyy-M-d H:m:s[.SSSSSSSSS]xx"),
    (rf"{_DATE} {_TIME}{_FRACTION}", "yyyy-M-d H:m:s[.SSSSSSSSS]"),
    (rf"{_DATE} \d{{1,2}}:\d{{1,2}}", "yyyy-M-d H:m"),
    (_DATE, "yyyy-M-d"),
    (rf"\d{{1,2}}/\d{{1,2}}/\d{{4}} {_TIME}", "M/d/yyyy H:m:s"),
    (rf"\d{{1,2}}/\d{{1,2}}/\d{{4}} {_TIME} (?i:[ap]m)", "M/d/yyyy h:m:s a"),
    (rf"\d{{1,2}}/\d{{1,2}}/\d{{4}} {_TIME}", "d/M/yyyy H:m:s"),
    (r"\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}", "M/d/yyyy H:m"),
    (rf"\d{{1,2}}-[A-Za-z]{{3}}-\d{{4}} {_TIME}", "d-MMM-yyyy H:m:s"),
    (rf"[A-Za-z]{{3}} \d{{1,2}}, \d{{4}} {_TIME}", "MMM d, yyyy H:m:s"),
    (rf"[A-Za-z]{{3}}\s+\d{{1,2}} {_TIME} \d{{4}}", "MMM d H:m:s yyyy"),
    (rf"\d{{4}}/\d{{1,2}}/\d{{1,2}} {_TIME}", "yyyy/M/d H:m:s"),
]
#: Words in a header that speak for a time column.
TIME_WORDS = ["time", "date", "timestamp", "created", "modified", "accessed", "when"]
#: Rows of a block in an interval join; two blocks make at most the square of this many pairs at once.
BLOCK = 128
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}
SAMPLE, RATE, NAMED_RATE, BONUS = 200, 0.6, 0.3, 0.15


def parse_time(c: Column | str) -> Column:
    """The instant of a cell in any known spelling, in UTC where it names no offset; null if there is none."""
    cell = stripped(c)
    # Names of weekdays and of zones after the clock are left out.
    plain = F.regexp_replace(cell, "^" + _DAY, "")
    plain = F.regexp_replace(plain, r"(:\d{1,2}) [A-Z]{3,4} (\d{4})$", "$1 $2")
    plain = F.regexp_replace(F.regexp_replace(plain, r"^([A-Za-z]{3})\s+(\d)", "$1 $2"), r"^(\d{4}-\d{1,2}-\d{1,2})[Tt]", "$1 ")
    plain = F.regexp_replace(F.regexp_replace(plain, "z$", "Z"), r"(:\d{1,2}(?:\.\d+)? [+-]\d{4}) \S+$", "$1")

    def tried(s: Column) -> Column:
        # The first three shapes have parts that are left out of the plain form.
        seen = [s["cell"] if i < 3 else s["plain"] for i in range(len(LAYOUTS))]
        return F.coalesce(*[F.when(x.rlike(f"^{shape}$"), F.try_to_timestamp(s["plain"], F.lit(pattern))) for x, (shape, pattern) in zip(seen, LAYOUTS, strict=True)])

    # A one-element array: the two forms are computed once and not written out for every layout.
    return F.transform(F.array(F.struct(cell.alias("cell"), plain.alias("plain"))), tried)[0]


_PERIODS = [
    (re.compile(r"(\d{4})$"), "year"),
    (re.compile(r"(\d{4})-(\d{1,2})$"), "month"),
    (re.compile(r"(\d{4})([-/])(\d{1,2})\2(\d{1,2})$"), "day"),
    (re.compile(r"(\d{4})-(\d{1,2})-(\d{1,2})[ T](\d{1,2}):(\d{1,2})$"), "minute"),
    (re.compile(r"(\d{4})/(\d{1,2})/(\d{1,2}) (\d{1,2}):(\d{1,2})$"), "minute"),
]
_FULL = ["%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%d %H:%M:%S", "%m/%d/%Y %H:%M:%S", "%m/%d/%Y %I:%M:%S %p", "%d/%m/%Y %H:%M:%S", "%m/%d/%Y %H:%M", "%d-%b-%Y %H:%M:%S", "%b %d, %Y %H:%M:%S", "%Y/%m/%d %H:%M:%S", "%b %d %H:%M:%S %Y", "%Y-%m-%d %H:%M:%S %z", "%Y-%m-%d %H:%M:%S.%f %z", "%Y-%m-%d %H:%M:%S%z", "%Y-%m-%d %H:%M:%S.%f%z"]


def period(literal: str) -> tuple[datetime, datetime]:
    """[start, end) of a literal: a year, month, day or minute is covered whole, anything fuller is one second wide."""
    literal = literal.strip()
    for pattern, unit in _PERIODS:
        if m := pattern.match(literal):
            n = [int(x) for x in m.groups() if x not in "-/"]
            start = datetime(n[0], *(n[1:] or [1]), *([1] if len(n) == 2 else []), *([] if len(n) > 1 else [1]))
            if unit == "year":
                return start, datetime(n[0] + 1, 1, 1)
            if unit == "month":
                return start, datetime(n[0] + n[1] // 12, n[1] % 12 + 1, 1)
            return start, start + (timedelta(days=1) if unit == "day" else timedelta(minutes=1))
    try:
        t = datetime.fromisoformat(literal.replace("Z", "+00:00"))
        t = t.astimezone(timezone.utc).replace(tzinfo=None) if t.tzinfo else t
        return t, t + timedelta(seconds=1)
    except ValueError:
        pass
    # Names of weekdays and zones say nothing that counts; an offset does.
    plain = re.sub(r"^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\s+", "", literal, flags=re.I)
    plain = re.sub(r"(:\d{1,2}) [A-Z]{3,4} (\d{4})$", r"\1 \2", re.sub(r"\s+", " ", plain))
    plain = re.sub(r"(:\d{1,2}(?:\.\d+)? [+-]\d{4}) \S+$", r"\1", plain)
    for layout in _FULL:
        try:
            t = datetime.strptime(plain, layout)
        except ValueError:
            continue
        t = t.astimezone(timezone.utc).replace(tzinfo=None) if t.tzinfo else t
        return t, t + timedelta(seconds=1)
    raise ValueError(f"not a time: {literal!r}")


#: Shapes of cells that name a whole period, their pattern and length.
_PERIOD_CELLS = [
    (r"\d{4}", "yyyy", "make_interval(1)"),
    (r"\d{4}-\d{1,2}", "yyyy-M", "make_interval(0, 1)"),
    (r"\d{4}-\d{1,2}-\d{1,2}", "yyyy-M-d", "make_interval(0, 0, 0, 1)"),
    (r"\d{4}/\d{1,2}/\d{1,2}", "yyyy/M/d", "make_interval(0, 0, 0, 1)"),
    (r"\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}", "yyyy-M-d H:m", "make_interval(0, 0, 0, 0, 0, 1)"),
    (r"\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}", "yyyy-M-d'T'H:m", "make_interval(0, 0, 0, 0, 0, 1)"),
    (r"\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{1,2}", "yyyy/M/d H:m", "make_interval(0, 0, 0, 0, 0, 1)"),
]


def period_bounds(c: Column | str) -> Column:
    """:func:`period` of a column of literals, as a struct of start and end; null if a cell names no time."""
    cell = stripped(c)
    one = F.expr("make_interval(0, 0, 0, 0, 0, 0, 1)")
    parts = []
    for shape, pattern, length in _PERIOD_CELLS:
        start = F.try_to_timestamp(cell, F.lit(pattern))
        parts.append(F.when(cell.rlike(f"^{shape}$") & start.isNotNull(), F.struct(start.alias("start"), (start + F.expr(length)).alias("end"))))
    whole = parse_time(c)
    return F.coalesce(*parts, F.when(whole.isNotNull(), F.struct(whole.alias("start"), (whole + one).alias("end"))))


def duration(literal: str) -> timedelta:
    """``90s``, ``5m``, ``2h``, ``7d``, ``1w``, ``1d12h``: digits with their unit, one or more times."""
    if not re.fullmatch(r"(\d+[smhdw])+", literal.strip()):
        raise ValueError(f"not a duration: {literal!r}")
    return timedelta(seconds=sum(int(n) * UNITS[u] for n, u in re.findall(r"(\d+)([smhdw])", literal)))


def duration_seconds(c: Column | str) -> Column:
    """Seconds of a duration cell; null if it is none."""
    cell = F.trim(text(c))
    units = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    parts = F.regexp_extract_all(cell, F.lit(r"(\d+)([smhdw])"), F.lit(0))
    seconds = F.aggregate(parts, F.lit(0).cast("long"), lambda total, p: total + F.left(p, F.length(p) - 1).cast("long") * units[F.right(p, F.lit(1))])
    return F.when(cell.rlike(r"^(\d+[smhdw])+$"), seconds)


def operand(literal: str, now: datetime | None = None) -> tuple[datetime, datetime]:
    """A literal, ``now`` or ``time`` (the clock's, if none is given), perhaps with ``+`` or ``-`` and a duration (spaces around the sign)."""
    now = now or clock()
    m = re.fullmatch(r"(.+?) ([+-]) (\S+)", literal.strip())
    base = m[1].strip() if m else literal.strip()
    start, end = (now, now + timedelta(seconds=1)) if base.lower() in ("now", "time") else period(base)
    if not m:
        return start, end
    shift = duration(m[3]) * (1 if m[2] == "+" else -1)
    return start + shift, start + shift + timedelta(seconds=1)


def _at(t: datetime, ntz: bool) -> Column:
    return F.expr(f"timestamp{'_ntz' if ntz else ''}'{t.isoformat(sep=' ')}'")


def clock() -> datetime:
    """The time, in UTC; what ``now`` means unless a caller says otherwise."""
    return datetime.now(timezone.utc).replace(tzinfo=None)


def before(c: Column, literal: str, now: datetime | None = None, ntz: bool = False) -> Column:
    return F.coalesce(c < _at(operand(literal, now)[0], ntz), F.lit(False))


def after(c: Column, literal: str, now: datetime | None = None, ntz: bool = False) -> Column:
    """From the end of the literal's period on."""
    return F.coalesce(c >= _at(operand(literal, now)[1], ntz), F.lit(False))


def between(c: Column, low: str, high: str, now: datetime | None = None, ntz: bool = False) -> Column:
    """From the start of ``low`` to the end of ``high``."""
    now = now or clock()
    return F.coalesce((c >= _at(operand(low, now)[0], ntz)) & (c < _at(operand(high, now)[1], ntz)), F.lit(False))


def time_of(t: Timeline, name: str) -> Column:
    """The instant in a data column; annotations and row numbers have none."""
    column = t.resolve(name)
    if column not in t.columns:
        raise ValueError(f"{name!r} is not a data column")
    kind = dict(t.df.dtypes)[column]
    return F.col(f"`{column}`") if kind.startswith("timestamp") else parse_time(t.text(column))


def around(c: Column, instant: datetime, minutes: int = 5, ntz: bool = False) -> Column:
    """Within so many minutes of an instant, at whole seconds: [t - m, t + m + 1 s)."""
    t = instant.replace(microsecond=0)
    return F.coalesce((c >= _at(t - timedelta(minutes=minutes), ntz)) & (c < _at(t + timedelta(minutes=minutes, seconds=1), ntz)), F.lit(False))


def _blocks(df: DataFrame, time: str, width: int, name: str) -> DataFrame:
    """Rows that follow each other within a bucket of time, in blocks of at most ``BLOCK``: an array ``name`` of the rows and their seconds, and the seconds it covers.

    Rows are numbered in an order of all columns, so that a task that runs again makes the same blocks.
    """
    rows = df.select(F.unix_seconds(F.col(time).cast("timestamp")).alias("at"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)]).where("at IS NOT NULL")
    ties = [c for c, kind in rows.dtypes if "map<" not in kind and kind != "variant"]
    number = F.row_number().over(W.partitionBy("bucket").orderBy(*ties)) - 1
    numbered = rows.withColumn("bucket", F.floor(F.col("at") / width)).withColumn("piece", F.floor(number / BLOCK))
    found = numbered.groupBy("bucket", "piece").agg(F.collect_list(F.struct(*rows.columns)).alias(name), F.min("at").alias("low"), F.max("at").alias("high"))
    return found.select(name, *[F.col(c).alias(f"{name}_{c}") for c in ("bucket", "piece", "low", "high")])


def around_anchors(events: DataFrame, time: str, anchors: DataFrame, anchor_time: str, minutes: int = 5) -> DataFrame:
    """Pairs of events and anchors within so many minutes, as an interval join.

    Both sides are put into buckets as wide as the window and there into blocks
    of rows; a block of anchors looks into the buckets that it reaches, so the
    join is an equi-join of blocks on the bucket, and never a nested loop. Pairs
    of blocks are dealt among the tasks, whatever bucket they are of, and only
    then become pairs of rows: the work is that of the pairs that there are.
    """
    width = minutes * 60
    left, right = _blocks(events, time, width, "e"), _blocks(anchors, anchor_time, width, "a")
    reached = F.sequence(F.floor((F.col("a_low") - width) / width), F.floor((F.col("a_high") + width) / width))
    right = right.withColumn("e_bucket", F.explode(reached))
    meet = (F.col("e_low") <= F.col("a_high") + width) & (F.col("e_high") >= F.col("a_low") - width)
    dealt = left.join(right, "e_bucket").where(meet).select("e", "a", "e_bucket", "e_piece", "a_bucket", "a_piece").repartition("e_bucket", "e_piece", "a_bucket", "a_piece")
    pairs = dealt.select(F.explode("e").alias("e"), "a").select("e", F.explode("a").alias("a"))
    cells = [F.col(side)[f"c{i}"].alias(c) for side, df in (("e", events), ("a", anchors)) for i, c in enumerate(df.columns)]
    return pairs.where((F.col("a.at") >= F.col("e.at") - width) & (F.col("a.at") <= F.col("e.at") + width)).select(*cells)


def _best_column(counted: DataFrame) -> DataFrame:
    """timeline_id and the column of the best score, of rows (timeline_id, at, title, seen, hits)."""
    named = F.lit(False)
    for word in TIME_WORDS:
        named = named | F.contains(F.lower("title"), F.lit(word))
    score = F.col("hits") / F.col("seen") + F.when(named, BONUS).otherwise(0.0)
    good = counted.where("seen > 0").withColumn("score", score).where(F.col("score") >= F.when(named, NAMED_RATE).otherwise(RATE))
    return good.groupBy("timeline_id").agg(F.max_by("at", F.struct("score", -F.col("at"))).alias("time_col"))


def detect_time_columns(timelines: list[Timeline], sample: int = SAMPLE) -> DataFrame:
    """timeline_id and time_col (the place of the column, null if none) of each timeline, in one job.

    A column's score is its share of parseable cells among those that are not
    blank, in the first rows by row id, with a bonus if its title has a telling
    word; the best score wins, the first column on ties.
    """
    parts = []
    for t in timelines:
        cells = F.posexplode(F.array(*[t.text(c) for c in t.columns])).alias("at", "cell")
        titles = F.array(*[F.lit(t.title(c)) for c in t.columns])
        first = t.df.orderBy(*t.row_order).limit(sample).select(F.lit(t.timeline_id).cast("long").alias("timeline_id"), cells)
        parts.append(first.withColumn("title", F.get(titles, F.col("at"))))
    if not parts:
        raise ValueError("no timelines")
    rows = reduce(DataFrame.unionByName, parts)
    counted = rows.groupBy("timeline_id", "at", "title").agg(F.count_if(F.col("cell").rlike(r"\S")).alias("seen"), F.count_if(parse_time("cell").isNotNull()).alias("hits"))
    known = timelines[0].df.sparkSession.createDataFrame([(t.timeline_id,) for t in timelines], "timeline_id bigint")
    return known.join(_best_column(counted), "timeline_id", "left")


def detect_time_column(t: Timeline, sample: int = SAMPLE) -> DataFrame:
    """One row with the internal name of the time column (null if none)."""
    names = F.array(*[F.lit(c) for c in t.columns])
    return detect_time_columns([t], sample).select(F.get(names, F.col("time_col")).alias("time_column"))
