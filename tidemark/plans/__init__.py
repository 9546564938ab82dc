"""The library's queries over the given tables, and their SQL."""

from __future__ import annotations

from . import annotations, cases, filters, lists, times

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _part in (filters, times, annotations, lists, cases):
    QUERIES |= _part.R.queries
    ORACLES |= _part.R.oracles
