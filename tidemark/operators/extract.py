"""Indicator extraction from text: addresses, hashes, names and paths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import SPACES, stripped, text
from ..functions.times import time_of
from ..model import Timeline

#: Detectors in their order, with the pattern of each.
DETECTORS: list[tuple[str, str]] = [
    ("ipv4", r"\b(?:\d{1,3}\.){3}\d{1,3}(?::\d{1,5})?\b"),
    ("ipv6", r"\b(?:[0-9A-Fa-f]{1,4}:){2,7}[0-9A-Fa-f]{0,4}\b"),
    ("sha256", r"\b[0-9A-Fa-f]{64}\b"),
    ("sha1", r"\b[0-9A-Fa-f]{40}\b"),
    ("md5", r"\b[0-9A-Fa-f]{32}\b"),
    ("guid", r"\b[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}\b"),
    ("email", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"),
    ("windows_path", r"(?:[A-Za-z]:\\|\\\\)[^\s,;|]+"),
    ("unix_path", r"/[^\s,;|/]+(?:/[^\s,;|]+)+"),
    ("domain", r"\b(?:[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,}\b"),
]
#: Two of them as Java can run them, with the group that is the match. An address starts at the first word boundary of
#: a run (or behind the match before), or a run of 100,000 characters would be read anew from each of its places. A name
#: has at most 127 labels, the limit of the DNS, as Java goes one call deeper for each.
_LOCAL = r"A-Za-z0-9._%+\-"
JAVA: dict[str, tuple[str, int]] = {
    "email": (rf"(?:\G|(?<![{_LOCAL}]))(?:(?!\b)[{_LOCAL}])*+\b([{_LOCAL}]++@[A-Za-z0-9.\-]+\.[A-Za-z]{{2,}}\b)", 1),
    "domain": (r"\b(?:[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?\.){1,127}[A-Za-z]{2,}\b", 0),
}
#: What every match of a kind holds (hashes: a run of hexadecimal digits); cells without it are not searched.
_NEEDS = {"ipv4": ".", "ipv6": ":", "guid": "-", "email": "@", "windows_path": "\\", "unix_path": "/", "domain": "."}
_EDGES = SPACES + ",;|\"'"


def trim_edges(c: Column) -> Column:
    return F.btrim(c, F.lit(_EDGES))


def found(c: Column | str, fallback: bool = True) -> Column:
    """Array of (kind, text) of a cell: detectors in order, then its tokens (if several) and the whole cell; the first kind of a text wins."""
    cell, none = text(c), F.array().cast("array<string>")
    hashed = cell.rlike("[0-9A-Fa-f]{32}")
    parts = {}
    for kind, pattern in DETECTORS:
        java, group = JAVA.get(kind, (pattern, 0))
        own = F.regexp_extract_all(cell, F.lit(java), F.lit(group))
        parts[kind] = F.when(F.contains(cell, F.lit(_NEEDS[kind])) if kind in _NEEDS else hashed, own).otherwise(none)
    if fallback:
        whole = stripped(cell)
        tokens = F.split(whole, r"\s+")
        parts |= {"token": F.when(F.size(tokens) > 1, tokens).otherwise(none), "cell": F.array(whole)}
    texts = F.struct(*[F.array_distinct(F.filter(F.transform(p, trim_edges), lambda x: x != "")).alias(k) for k, p in parts.items()])

    def item(kind: str) -> Callable[[Column], Column]:
        return lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("text"))

    def first(s: Column) -> Column:
        # Set operations are linear in the texts of a cell, however many there are.
        out = []
        for i, kind in enumerate(parts):
            new = F.array_except(s[kind], F.concat(*[s[k] for k in list(parts)[:i]])) if i else s[kind]
            out.append(F.transform(new, item(kind)))
        return F.concat(*out)

    # A one-element array, so that the texts are computed once.
    return F.transform(F.array(texts), first)[0]


def census(t: Timeline, fallback: bool = False) -> DataFrame:
    """Every indicator of every cell: kind, text, rows that hold it, first and last time.

    A cell's own repeats go before the explode and a row's before the shuffle;
    counting combines in each task first.
    """
    cells = F.flatten(F.array(*[found(t.text(c), fallback) for c in t.data_columns]))
    time = time_of(t, t.time_column) if t.time_column else F.lit(None).cast("timestamp")
    rows = t.df.select(time.alias("time"), F.explode(F.array_distinct(cells)).alias("x"))
    return rows.groupBy("x.kind", "x.text").agg(F.count(F.lit(1)).alias("n_rows"), F.min("time").alias("first_time"), F.max("time").alias("last_time"))
