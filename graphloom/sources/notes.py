"""Schema notes: Markdown with front matter, one note for each type, read as a model."""

from __future__ import annotations

import re

import yaml

from ..functions.types import ValueType, parse_type
from ..plans.model import MANY, Bound, Diagnostic, EdgeType, Enum, Model, NodeType, Property
from ..plans.resolve import flatten


def front_matters(text: str) -> list[dict]:
    return [x for m in re.finditer(r"(?ms)^---\n(.*?)^---\s*$", text) if isinstance(x := yaml.safe_load(m[1]), dict) and x.get("type")]


def import_notes(text: str, prefix: str = "notes", iri: str = "https://example.org/notes#") -> tuple[Model, list[Diagnostic]]:
    """Links become edges; those of one name from several types are one edge from their common parent, or apart if they have none."""
    said: list[Diagnostic] = []
    nodes, enums, links, parents = [], {}, {}, {}
    for note in front_matters(text):
        name, props = str(note["type"]), []
        parents[name] = (note.get("lpg") or {}).get("extends")
        for p in note.get("properties") or []:
            field, kind = str(p.get("name")), str(p.get("type", "string"))
            if kind == "link":
                bound = Bound(int(bool(p.get("required"))), 1 if p.get("many") is False else None)
                links.setdefault(field, []).append((name, [str(t) for t in p.get("to") or []], bound))
                continue
            enum = None
            if kind == "enum":
                enum = f"{name}{field[:1].upper()}{field[1:]}"
                enums[enum] = Enum(enum, tuple(map(str, p.get("values") or [])))
            t = ValueType("scalar", "string") if enum else parse_type(kind)
            if t is None:
                said.append(Diagnostic("info", "import-unknown-type", f"{name}.{field} has the type '{kind}', read as string.", f"{name}.{field}"))
                t = ValueType("scalar", "string")
            props.append(Property(field, t, enum=enum, required=bool(p.get("required"))))
        nodes.append(NodeType(name, key=tuple(map(str, note.get("key") or [])), props=tuple(props), extends=parents[name]))
    nodes += [NodeType(x, abstract=True) for x in sorted({p for p in parents.values() if p and p not in parents})]
    edges = []
    for name, found in links.items():
        common = lambda types: types[0] if len(types) == 1 else next(iter({parents.get(t) for t in types})) if len({parents.get(t) for t in types}) == 1 else None
        source, target = common([s for s, _, _ in found]), common(sorted({t for _, ts, _ in found for t in ts}) or [""])
        if source and target:
            edges.append(EdgeType(name, source, target, sources=MANY, targets=found[0][2]))
        else:
            said.append(Diagnostic("warning", "import-ambiguous-link", f"{name} joins types without a common parent; it is read once for each pair.", name))
            edges += [EdgeType(f"{name}_{s}_{t}", s, t, targets=b) for s, ts, b in found for t in ts]
    return flatten(Model(prefix, iri, nodes=tuple(nodes), edges=tuple(edges), enums=tuple(enums.values())), said), said
