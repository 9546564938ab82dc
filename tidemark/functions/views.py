"""Saved views: a filter spec and a sort under a name, as JSON that fits other timelines too."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, replace

from pyspark.sql import Column

from ..model import VIRTUAL, Timeline
from .ordering import order_by
from .predicates import Condition, FilterSpec, Tree, When

_NAMES = {*VIRTUAL.values(), "data"}


def _shown(t: Timeline, target: str) -> str:
    """A field as it is saved: a title, or the name of a virtual field."""
    found = target if target == "data" else t.resolve(target)
    return found if found in _NAMES else t.title(found)


def _known(t: Timeline, name: str) -> str | None:
    """The field that a saved name means: the first column with exactly this title, or a virtual field."""
    return next((c for c in t.columns if t.title(c) == name), name if name in _NAMES else None)


def _encode(t: Timeline, node: Tree | Condition | When) -> dict:
    if isinstance(node, Tree):
        return {"op": node.op, "parts": [_encode(t, x) for x in node.parts]}
    kind = "when" if isinstance(node, When) else "condition"
    return {kind: asdict(node) | {"target": _shown(t, node.target)}}


def _decode(t: Timeline, raw: dict) -> Tree | Condition | When | None:
    """A node without the fields that ``t`` lacks; nothing if nothing is left."""
    if "op" in raw:
        parts = tuple(x for x in (_decode(t, p) for p in raw["parts"]) if x is not None)
        return Tree(raw["op"], parts) if parts else None
    made, one = (When, raw["when"]) if "when" in raw else (Condition, raw["condition"])
    target = _known(t, one["target"])
    return None if target is None else made(**one | {"target": target})


@dataclass(frozen=True)
class SavedView:
    """What is set on a timeline: filters, and (field, descending) sort keys.

    The JSON names columns by title. On another timeline they are found by their exact
    title, and filters and sort keys whose column it lacks are dropped, also below ``and``, ``or`` and ``not``.
    """

    name: str = ""
    spec: FilterSpec = field(default_factory=FilterSpec)
    sort: tuple[tuple[str, bool], ...] = ()

    def to_json(self, t: Timeline) -> str:
        s = self.spec
        if isinstance(s.where, Column):
            raise ValueError("a condition that is a Column cannot be saved; use Tree, Condition and When")
        sort = [[_shown(t, c), descending] for c, descending in self.sort]
        first = sort[0] if sort else ["", False]
        plain = {f.name: getattr(s, f.name) for f in fields(s) if f.name not in ("any_tags", "quick", "pick", "conditions", "where", "query_on")}
        return json.dumps(
            plain
            | {"name": self.name, "sort_column": first[0], "sort_desc": first[1], "sort": sort, "tags": s.any_tags}
            | {"query_on": None if s.query_on is None else _shown(t, s.query_on)}
            | {"col_filters": {_shown(t, k): v for k, v in s.quick.items()}, "pick": {_shown(t, k): v for k, v in s.pick.items()}}
            | {"conditions": [_encode(t, c)["condition"] for c in s.conditions], "where": None if s.where is None else _encode(t, s.where)}
        )

    @classmethod
    def from_json(cls, saved: str, t: Timeline) -> SavedView:
        """A saved view on ``t``; fields that the JSON does not have keep their defaults."""
        raw = json.loads(saved)
        plain = {k: raw[k] for k in ("tagged_only", "tag", "query", "query_regex", "match_all", "cased") if k in raw}
        on = raw.get("query_on", "any")
        if on is not None and (on := _known(t, on)) is None:
            plain |= {"query": ""}
            on = "any"
        found = {
            k: {c: v for name, v in names.items() if (c := _known(t, name)) is not None}
            for k, names in (("quick", raw.get("col_filters", raw.get("quick", {}))), ("pick", raw.get("pick", {})))
        }
        conditions = [c for c in (_decode(t, {"condition": c}) for c in raw.get("conditions", [])) if c is not None]
        where = _decode(t, raw["where"]) if raw.get("where") else None
        spec = FilterSpec(any_tags=raw.get("tags", raw.get("any_tags", [])), query_on=on, conditions=conditions, where=where, **found, **plain)
        keys = raw.get("sort") or ([[raw["sort_column"], raw.get("sort_desc", False)]] if raw.get("sort_column") else [])
        return cls(raw.get("name", ""), spec, tuple((c, bool(d)) for name, d in keys if (c := _known(t, name)) is not None))

    def apply(self, t: Timeline) -> Timeline:
        """The rows that pass, in the order of the view."""
        kept = self.spec.apply(t)
        return replace(kept, df=kept.df.orderBy(*order_by(kept, list(self.sort))))
