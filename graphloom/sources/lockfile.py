"""Lockfiles: a canonical JSON snapshot of a model with its revision."""

from __future__ import annotations

import json
from dataclasses import fields, is_dataclass
from typing import Any

from ..functions.types import ValueType, parse_type
from ..plans.model import Bound, Constraint, Diagnostic, EdgeType, Enum, Mixin, Model, NodeType, Property

#: What doesn't belong to a model's meaning.
LEFT_OUT = {"file", "derived_ids", "imports"}


def canonical(value: Any) -> Any:
    """Plain data: keys in code-unit order, identified elements in order of id, types as text, nothing of LEFT_OUT."""
    if isinstance(value, ValueType):
        return str(value)
    if isinstance(value, Bound):
        return str(value)
    if is_dataclass(value):
        return {f.name: canonical(getattr(value, f.name)) for f in sorted(fields(value), key=lambda f: f.name) if f.name not in LEFT_OUT and getattr(value, f.name) not in (None, "", (), {}, False)}
    if isinstance(value, (list, tuple)):
        items = [canonical(x) for x in value]
        return sorted(items, key=lambda x: x["id"]) if items and all(isinstance(x, dict) and "id" in x for x in items) else items
    return {k: canonical(v) for k, v in sorted(value.items())} if isinstance(value, dict) else value


def write_lockfile(model: Model, revision: int = 1) -> str:
    return json.dumps({"model": canonical(model), "revision": revision}, ensure_ascii=False, indent=2, sort_keys=True) + "\n"


def _bound(text: str | None) -> Bound:
    from ..plans.model import parse_bound

    return parse_bound(text or "*") or Bound()


def read_lockfile(text: str) -> tuple[Model | None, int, list[Diagnostic]]:
    """(model, revision, diagnostics); the model is None if the text is no lockfile."""
    try:
        raw = json.loads(text)
        body, revision = raw["model"], int(raw["revision"])
        prop = lambda p: Property(**{**p, "type": parse_type(p["type"])})
        rule = lambda c: Constraint(**{**c, "props": tuple(c.get("props", ())), "bound": _bound(c.get("bound"))})
        node = lambda n: NodeType(**{**n, **{k: tuple(n.get(k, ())) for k in ("mixins", "key", "ancestors")}, "props": tuple(map(prop, n.get("props", ()))), "constraints": tuple(map(rule, n.get("constraints", ())))})
        edge = lambda e: EdgeType(**{**e, "sources": _bound(e.get("sources")), "targets": _bound(e.get("targets")), "props": tuple(map(prop, e.get("props", ())))})
        lists = {k: tuple(map(make, body.get(k, ()))) for k, make in (("nodes", node), ("edges", edge), ("mixins", lambda m: Mixin(**{**m, "props": tuple(map(prop, m.get("props", ())))})), ("enums", lambda x: Enum(**{**x, "values": tuple(x["values"])})))}
        return Model(**{**{k: v for k, v in body.items() if k not in lists}, **lists}), revision, []
    except (ValueError, KeyError, TypeError) as error:
        return None, 0, [Diagnostic("error", "malformed-lockfile", f"This is no lockfile: {error}")]


def same(a: Model, b: Model) -> bool:
    return canonical(a) == canonical(b)


def ids_not_written(model: Model) -> list[Diagnostic]:
    """Declared elements whose ids follow from their names: a rename would look like a removal and an addition."""
    from ..plans.ids import declared_ids

    return [Diagnostic("error", "ids-not-written", f"The id of {what} is not written in its file.", what) for i, what in declared_ids(model) if i in model.derived_ids]


__all__ = ["canonical", "ids_not_written", "read_lockfile", "same", "write_lockfile"]
