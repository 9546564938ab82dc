"""The queries of this subpackage and their SQL, gathered from its modules."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("secrets", "licenses", "suffixes", "warc", "jaccard", "pieces", "sharding", "chat", "decontaminate", "quality", "manifest", "repair", "bpe")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in _MODULES:
    _module = import_module(f".{_name}", __package__)
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
