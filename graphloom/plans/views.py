"""Views: named subsets of a model's types."""

from __future__ import annotations

from dataclasses import dataclass, replace

import yaml

from .model import Diagnostic, Model


@dataclass(frozen=True)
class View:
    name: str
    include: tuple[str, ...] = ()
    expand: int = 0


def parse_views(text: str) -> list[View]:
    """Views of a YAML text: `views: {name: {include: [...] or '*', expand: n}}`."""
    raw = (yaml.safe_load(text) or {}).get("views") or {}
    return [View(n, tuple(b["include"]) if isinstance(b.get("include"), list) else ("*",) if b.get("include") == "*" else (), int(b.get("expand") or 0)) for n, b in raw.items() if isinstance(b, dict)]


def project_view(model: Model, view: View) -> Model:
    """The view's types, `expand` hops of edges around them, their ancestors, and the edges with both ends in it."""
    names = {n.name for n in model.nodes} if "*" in view.include else {x for x in view.include if model.node(x)}
    for _ in range(view.expand):
        names |= {far for e in model.edges for near, far in ((e.source, e.target), (e.target, e.source)) if near in names and model.node(far)}
    names |= {a for n in model.nodes if n.name in names for a in n.ancestors}
    return replace(model, nodes=tuple(n for n in model.nodes if n.name in names), edges=tuple(e for e in model.edges if e.source in names and e.target in names))


def types_in_no_view(model: Model, views: list[View]) -> list[Diagnostic]:
    shown = {n.name for v in views for n in project_view(model, v).nodes}
    return [Diagnostic("info", "type-in-no-view", f"'{n.name}' is in no view.", n.name) for n in model.nodes if views and n.name not in shown]


def describe(model: Model, name: str) -> list[dict]:
    """Rows about a node or edge type: properties, and for nodes the edges at it with the type that declares them."""
    if node := model.node(name):
        rows = [{"kind": "property", "name": p.name, "type": str(p.type), "required": p.required, "declared_on": p.inherited_from or name} for p in node.props]
        for e in model.edges:
            for at, way in ((e.source, "out"), (e.target, "in")):
                if at in (name, *node.ancestors):
                    rows.append({"kind": f"edge {way}", "name": e.name, "type": e.target if way == "out" else e.source, "required": (e.targets if way == "out" else e.sources).least > 0, "declared_on": at})
        return rows
    if edge := model.edge(name):
        return [{"kind": "ends", "name": name, "type": f"{edge.source} -> {edge.target}", "required": False, "declared_on": name}] + [{"kind": "property", "name": p.name, "type": str(p.type), "required": p.required, "declared_on": name} for p in edge.props]
    return []


def list_types(model: Model) -> list[dict]:
    return [{"kind": "node", "name": n.name, "abstract": n.abstract} for n in model.nodes] + [{"kind": "edge", "name": e.name, "abstract": False} for e in model.edges]
