"""Scripts of node and relationship tables, read as a model."""

from __future__ import annotations

import re

from ..functions.types import ValueType, parse_type
from ..plans.model import MANY, NAMED, Diagnostic, EdgeType, Model, NodeType, Property
from ..plans.resolve import flatten

#: In these scripts FLOAT has 32 bits (fixed value).
NARROW = {"FLOAT": "FLOAT32"}


def _split(text: str) -> list[str]:
    """Parts between commas that are in no bracket."""
    out, depth = [""], 0
    for c in text:
        depth += (c in "([{<") - (c in ")]}>")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out if x.strip()]


def _column(text: str, key: list[str], said: list[Diagnostic], table: str) -> Property:
    name, _, written = text.partition(" ")
    written = re.sub(r"(?i)\s+(default\s.*|primary\s+key|not\s+null)", "", written).strip()
    kind = parse_type(re.sub(r"\bFLOAT\b", lambda m: NARROW[m[0]], written))
    if kind is None:
        said.append(Diagnostic("info", "import-unknown-type", f"{table}.{name} has the type '{written}', read as string.", f"{table}.{name}"))
        kind = ValueType("scalar", "string")
    return Property(name.strip("`"), kind, required=name.strip("`") in key)


def import_ladybug(text: str, prefix: str = "db", iri: str = "https://example.org/db#") -> tuple[Model, list[Diagnostic]]:
    """An edge between several pairs of tables joins an abstract type over each end."""
    said: list[Diagnostic] = []
    nodes, edges, unions = [], [], {}
    plain = re.sub(r"//[^\n]*|/\*.*?\*/", "", text, flags=re.S)
    for m in re.finditer(r"(?is)create\s+(node|rel)\s+table\s+(?:group\s+)?(?:if\s+not\s+exists\s+)?`?(\w+)`?\s*\((.*?)\)\s*;", plain):
        kind, name, parts = m[1].lower(), m[2], _split(re.sub(r"(?is)\n(\s*)(primary\s+key)", r",\n\1\2", m[3]))
        if kind == "node":
            keys = [x for p in parts if (k := re.fullmatch(r"(?is)primary\s+key\s*\((.*)\)", p)) for x in _split(k[1])] or [p.split()[0] for p in parts if re.search(r"(?i)primary\s+key", p)]
            nodes.append(NodeType(name, key=tuple(keys), props=tuple(_column(p, keys, said, name) for p in parts if not re.match(r"(?i)primary\s+key", p))))
            continue
        pairs = [(p[1], p[2]) for x in parts if (p := re.fullmatch(r"(?i)from\s+`?(\w+)`?\s+to\s+`?(\w+)`?", x))]
        many = next((NAMED[x.lower().replace("_", "-")] for x in parts if x.lower().replace("_", "-") in NAMED), (MANY, MANY))
        props = tuple(_column(p, [], said, name) for p in parts if not re.match(r"(?i)from\s", p) and p.lower().replace("_", "-") not in NAMED)
        ends = []
        for side in (0, 1):
            types = sorted({p[side] for p in pairs})
            if len(types) == 1:
                ends.append(types[0])
            else:
                ends.append(unions.setdefault(tuple(types), "Or".join(types)))
                said.append(Diagnostic("info", "import-union", f"{name} joins {', '.join(types)}, which become one abstract type.", name))
        edges.append(EdgeType(name, *ends, sources=many[0], targets=many[1], props=props))
    parent: dict[str, str] = {}
    for types, name in unions.items():
        for t in types:
            parent.setdefault(t, name)
    nodes = [NodeType(n.name, key=n.key, props=n.props, extends=parent.get(n.name)) for n in nodes] + [NodeType(x, abstract=True) for x in unions.values()]
    return flatten(Model(prefix, iri, nodes=tuple(nodes), edges=tuple(edges)), said), said
