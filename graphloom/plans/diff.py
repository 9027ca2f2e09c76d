"""Differences of two model revisions, matched by element id, and how much each matters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from ..functions.types import ValueType
from .model import NAMED, Bound, EdgeType, Enum, Model, NodeType, Property

CLASSES = ("additive", "breaking", "destructive")
#: Kinds whose class is the same in both directions (fixed values).
ALWAYS = {"renamed": "breaking", "rekeyed": "breaking", "endpoints-changed": "breaking", "namespace-changed": "breaking", "moved": "additive"}
DIRECTIONS = ("loosens", "tightens", "unknown", "loses-data")
ORDER = ("model", "node", "property", "edge", "mixin", "enum", "constraint")


@dataclass(frozen=True)
class Change:
    kind: str
    element: str
    id: str
    label: str
    detail: str
    change_class: str


def classify(kind: str, direction: str) -> str:
    """Lost data is destructive; some kinds have one class; else loosening is additive and all the rest breaking."""
    if direction == "loses-data":
        return "destructive"
    return ALWAYS.get(kind) or ("additive" if direction == "loosens" else "breaking")


def strongest(directions: list[str]) -> str:
    return max(directions, key=DIRECTIONS.index, default="loosens")


def at_least(change_class: str, threshold: str) -> bool:
    return CLASSES.index(change_class) >= CLASSES.index(threshold)


def cardinality_name(e: EdgeType) -> str:
    return next((n for n, ends in NAMED.items() if ends == (e.sources, e.targets)), f"from {e.sources} to {e.targets}")


def _wider(a: Bound, b: Bound) -> bool:
    """Whether b admits all that a does."""
    return b.least <= a.least and (b.most is None or (a.most is not None and a.most <= b.most))


#: Widening steps between scalars: each admits the values of those before it in its line.
WIDER = (("int8", "int16", "int32", "int", "int128"), ("uint8", "uint16", "uint32", "uint64"), ("float32", "float"))


def _widens(a: ValueType, b: ValueType) -> bool:
    if a.kind == b.kind == "scalar":
        if a.name == b.name == "decimal" and a.precision and b.precision:
            return b.scale >= a.scale and b.precision - b.scale >= a.precision - a.scale
        return any(a.name in line and b.name in line and line.index(a.name) <= line.index(b.name) for line in WIDER)
    return a.kind == b.kind and len(a.parts) == len(b.parts) and a.size == b.size and all(x == y or _widens(x[1], y[1]) for x, y in zip(a.parts, b.parts, strict=True))


class _Differ:
    def __init__(self, before: Model, after: Model) -> None:
        self.before, self.after, self.out = before, after, []

    def say(self, kind: str, element: str, id_: str, label: str, detail: str, direction: str) -> None:
        self.out.append(Change(kind, element, id_, f"{element} {label}", detail, classify(kind, direction)))

    def matched(self, a: list, b: list, element: str, added: Callable, removed: Callable, both: Callable) -> None:
        old, new = {x.id: x for x in a}, {x.id: x for x in b}
        for i in sorted(old.keys() | new.keys()):
            if i not in new:
                removed(old[i])
            elif i not in old:
                added(new[i])
            else:
                if old[i].name != new[i].name:
                    self.say("renamed", element, i, new[i].name, f"renamed from '{old[i].name}'", "unknown")
                both(old[i], new[i])

    def changed(self, kind: str, element: str, id_: str, label: str, what: str, a, b, direction: str) -> None:
        if a != b:
            self.say(kind, element, id_, label, f"{what} changed from {a} to {b}", direction)

    def toggled(self, kind: str, element: str, id_: str, label: str, was: bool, is_: bool, on: str, off: str, on_way: str, off_way: str) -> None:
        if was != is_:
            self.say(kind, element, id_, label, on if is_ else off, on_way if is_ else off_way)

    def node(self, a: NodeType, b: NodeType) -> None:
        say = lambda kind, what, x, y, way: self.changed(kind, "node", b.id, b.name, what, x, y, way)
        own = lambda n: f"({', '.join(n.key)})" if not n.key_inherited_from else None
        renamed = {p.id: p.name for p in b.props}
        old_key = tuple(renamed.get(a.prop(k).id, k) if a.prop(k) else k for k in a.key)  # a renamed key property is no new key
        if own(a) is not None or own(b) is not None:
            if old_key != b.key:
                say("rekeyed", "key", f"({', '.join(a.key)})", f"({', '.join(b.key)})", "unknown")
        new_name = {n.name: (self.after_by_id.get(n.id) or n).name for n in self.before.nodes}
        parent = new_name.get(a.extends, a.extends)
        say("hierarchy-changed", "parent", parent or "none", b.extends or "none", "tightens")
        lost = {p.name for p in a.props} - {p.name for p in b.props}
        gained = [p for p in b.props if p.name not in {x.name for x in a.props}]
        way = "loses-data" if lost and a.mixins != b.mixins and any(p.mixin in set(a.mixins) - set(b.mixins) for p in a.props if p.name in lost) else "tightens" if any(p.required and p.mixin in set(b.mixins) - set(a.mixins) for p in gained) else "loosens"
        say("mixins-changed", "mixins", f"[{', '.join(a.mixins)}]", f"[{', '.join(b.mixins)}]", way)
        self.toggled("abstract-changed", "node", b.id, b.name, a.abstract, b.abstract, "became abstract", "no longer abstract", "loses-data", "loosens")
        self.toggled("openness-changed", "node", b.id, b.name, a.open, b.open, "became open", "became closed", "loosens", "tightens")
        say("iri-changed", "IRI", a.iri or "none", b.iri or "none", "unknown")

    def edge(self, a: EdgeType, b: EdgeType) -> None:
        new_name = lambda x: (self.after_by_id.get(getattr(self.before.node(x), "id", None)) or self.before.node(x) or a).name if self.before.node(x) else x
        was, is_ = f"({new_name(a.source)})->({new_name(a.target)})", f"({b.source})->({b.target})"
        self.changed("endpoints-changed", "edge", b.id, b.name, "endpoints", was, is_, "unknown")
        way = "loosens" if _wider(a.sources, b.sources) and _wider(a.targets, b.targets) else "tightens"
        self.changed("cardinality-changed", "edge", b.id, b.name, "cardinality", cardinality_name(a), cardinality_name(b), way)
        self.changed("iri-changed", "edge", b.id, b.name, "IRI", a.iri or "none", b.iri or "none", "unknown")

    def enum(self, a: Enum, b: Enum) -> None:
        new, gone = [v for v in b.values if v not in a.values], [v for v in a.values if v not in b.values]
        if new:
            self.say("enum-values-changed", "enum", b.id, b.name, f"values added: {', '.join(new)}", "loosens")
        if gone:
            self.say("enum-values-changed", "enum", b.id, b.name, f"values removed: {', '.join(gone)}", "loses-data")
        if not new and not gone and a.values != b.values:
            self.say("enum-values-changed", "enum", b.id, b.name, "values put in another order", "loosens")

    def property(self, where: str, a: Property, b: Property) -> None:
        say = lambda kind, detail, way: self.say(kind, "property", b.id, where, detail, way)
        if a.type != b.type:
            say("retyped", f"type changed from {a.type} to {b.type}", "loosens" if _widens(a.type, b.type) else "tightens")
        self.toggled("required-changed", "property", b.id, where, a.required, b.required, "became required", "no longer required", "tightens", "loosens")
        self.toggled("unique-changed", "property", b.id, where, a.unique, b.unique, "became unique", "no longer unique", "tightens", "loosens")
        lower, upper = lambda x, y: y < x, lambda x, y: y > x
        for what, x, y, looser in (("enum", a.enum, b.enum, None), ("min", a.min, b.min, lower), ("max", a.max, b.max, upper), ("minLength", a.min_length, b.min_length, lower), ("maxLength", a.max_length, b.max_length, upper), ("pattern", a.pattern, b.pattern, None)):
            if x == y:
                continue
            if x is None:
                say("value-constraint-changed", f"{what} added: {y}", "tightens")
            elif y is None:
                say("value-constraint-changed", f"{what} removed: {x}", "loosens")
            else:
                say("value-constraint-changed", f"{what} changed from {x} to {y}", "unknown" if looser is None else "loosens" if looser(x, y) else "tightens")

    def run(self) -> list[Change]:
        before, after = self.before, self.after
        self.after_by_id = {n.id: n for n in after.nodes}
        for what in ("prefix", "iri"):
            self.changed("namespace-changed", "model", "", after.prefix, f"namespace {what}", getattr(before, what), getattr(after, what), "unknown")
        plain = lambda element: (lambda x: self.say("added", element, x.id, x.name, "added", "loosens"), lambda x: self.say("removed", element, x.id, x.name, "removed", "loses-data"))
        self.matched(before.nodes, after.nodes, "node", *plain("node"), self.node)
        self.matched(before.edges, after.edges, "edge", *plain("edge"), self.edge)
        self.matched(before.mixins, after.mixins, "mixin", *plain("mixin"), lambda a, b: None)
        self.matched(before.enums, after.enums, "enum", lambda x: self.say("added", "enum", x.id, x.name, f"added with values {', '.join(x.values)}", "loosens"), lambda x: self.say("removed", "enum", x.id, x.name, "removed", "tightens"), self.enum)
        # a property is told once, where it is declared
        declared = lambda m: {p.id: (o, p) for o in (*m.nodes, *m.edges, *m.mixins) for p in o.props if not p.inherited_from and not p.mixin}
        old, new = declared(before), declared(after)
        old_owners = {o.id for o in (*before.nodes, *before.edges, *before.mixins)}
        for i in sorted(old.keys() | new.keys()):
            if i not in new:
                o, p = old[i]
                self.say("removed", "property", i, f"{o.name}.{p.name}", "removed", "loses-data")
            elif i not in old:
                o, p = new[i]
                extra = "".join(f", {x}" for x, on in (("required", p.required), ("unique", p.unique)) if on)
                self.say("added", "property", i, f"{o.name}.{p.name}", f"added as {p.type}{extra}", "tightens" if (p.required or p.unique) and o.id in old_owners else "loosens")
            else:
                (a_owner, a), (b_owner, b) = old[i], new[i]
                where = f"{b_owner.name}.{b.name}"
                if a.name != b.name:
                    self.say("renamed", "property", i, where, f"renamed from '{a.name}'", "unknown")
                if a_owner.id != b_owner.id:
                    self.say("moved", "property", i, where, f"moved from {a_owner.name}", "loosens")
                self.property(where, a, b)
        rules = lambda m: {c.id: (n, c) for n in m.nodes for c in n.constraints}
        old_rules, new_rules = rules(before), rules(after)
        for i in sorted(old_rules.keys() | new_rules.keys()):
            n, c = (new_rules.get(i) or old_rules[i])
            said = "removed" if i not in new_rules else "added" if i not in old_rules else None
            if said:
                self.say(said, "constraint", i, f"{n.name}.{c.name}", said, "loosens" if said == "removed" or n.id not in old_owners else "tightens")
            elif (was := old_rules[i][1]) != c:
                if was.name != c.name:
                    self.say("renamed", "constraint", i, f"{n.name}.{c.name}", f"renamed from '{was.name}'", "unknown")
                meaning = lambda x: (x.kind, x.props, x.edge, x.of, x.bound)
                if meaning(was) != meaning(c):
                    self.say("constraint-changed", "constraint", i, f"{n.name}.{c.name}", "asserts something else", "unknown")
                elif (was.message, was.severity) != (c.message, c.severity):
                    self.say("other-changed", "constraint", i, f"{n.name}.{c.name}", "message or severity changed", "loosens")
        return sorted(self.out, key=lambda c: (ORDER.index(c.element), c.label, c.kind != "removed", c.kind, c.detail))


def diff_models(before: Model, after: Model) -> list[Change]:
    """Changes in a fixed order: by kind of element, then by label."""
    return _Differ(before, after).run()
