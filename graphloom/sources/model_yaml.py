"""Model files: YAML to a raw Model with diagnostics, and back."""

from __future__ import annotations

from dataclasses import replace

import yaml

from ..functions.types import ValueType, parse_type
from ..plans.model import MANY, NAMED, Bound, Constraint, Diagnostic, EdgeType, Enum, Mixin, Model, NodeType, Property, parse_bound

COMPARISONS = ("lessThan", "lessThanOrEquals", "equals", "disjoint")
PRESENCE = ("atLeastOne", "exactlyOne")
ASSERTIONS = (*COMPARISONS, *PRESENCE, "count")
SEVERITIES = ("violation", "warning", "info")


class _Text(yaml.SafeLoader):
    """Dates stay text, as do on and off."""


_Text.yaml_implicit_resolvers = {k: [(t, r) for t, r in v if t not in ("tag:yaml.org,2002:timestamp", "tag:yaml.org,2002:bool")] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
_Text.add_implicit_resolver("tag:yaml.org,2002:bool", __import__("re").compile("^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))


class Reader:
    def __init__(self, file: str) -> None:
        self.file, self.said = file, []

    def error(self, code: str, message: str, target: str = "") -> None:
        self.said.append(Diagnostic("error", code, message, target))

    def mapping(self, raw, code: str, what: str) -> dict:
        """A mapping; anything else but nothing is an error."""
        if raw is None:
            return {}
        if not isinstance(raw, dict):
            self.error(code, f"{what} must be a mapping.", what)
            return {}
        return {str(k): v for k, v in raw.items()}

    def names(self, raw) -> tuple[str, ...]:
        return tuple(str(x) for x in raw if isinstance(x, str)) if isinstance(raw, list) else (raw,) if isinstance(raw, str) else ()

    def text(self, raw) -> str | None:
        return raw if isinstance(raw, str) else None

    def number(self, raw):
        return raw if isinstance(raw, (int, float)) and not isinstance(raw, bool) else None

    def props(self, raw, owner: str) -> tuple[Property, ...]:
        out = []
        for name, body in self.mapping(raw, "malformed-property", f"props of {owner}").items():
            where = f"{owner}.{name}"
            if not isinstance(body, dict):
                self.error("malformed-property", f"Property '{where}' must be a mapping.", where)
                continue
            written = self.text(body.get("type"))
            if not written:
                self.error("missing-type", f"Property '{where}' has no type.", where)
                continue
            kind = parse_type(written)
            if kind is None:
                self.error("unknown-type", f"Property '{where}' has the unknown type '{written}'.", where)
                continue
            if body.get("list") is True and kind.kind not in ("list", "array"):
                kind = ValueType("list", parts=(("", kind),))
            out.append(Property(name, kind, self.text(body.get("id")) or "", self.text(body.get("enum")), self.number(body.get("min")), self.number(body.get("max")), self.number(body.get("minLength")), self.number(body.get("maxLength")), self.text(body.get("pattern")), body.get("required") is True, body.get("unique") is True))
        return tuple(out)

    def cardinality(self, raw, edge: str) -> tuple[Bound, Bound]:
        if raw is None:
            return MANY, MANY
        if isinstance(raw, str):
            if named := NAMED.get(raw.strip().replace("_", "-").lower()):
                return named
            self.error("unknown-cardinality", f"Edge '{edge}' has the unknown cardinality '{raw}'.", edge)
            return MANY, MANY
        if not isinstance(raw, dict):
            self.error("malformed-cardinality", f"The cardinality of edge '{edge}' must be a name or a mapping of bounds.", edge)
            return MANY, MANY
        ends = {}
        for end in ("from", "to"):
            written = raw.get(end)
            if written is None:
                continue
            bound = parse_bound(str(written))
            if bound is None:
                self.error("unknown-cardinality", f"Edge '{edge}' has the unknown bound '{written}' at its {end} end.", edge)
            elif bound.most is not None and bound.least > bound.most:
                self.error("impossible-cardinality", f"Nothing can satisfy the bound '{written}' at the {end} end of edge '{edge}'.", edge)
            else:
                ends[end] = bound
        return ends.get("from", MANY), ends.get("to", MANY)

    def constraint(self, raw, owner: str) -> Constraint | None:
        body = raw if isinstance(raw, dict) else {}
        name = self.text(body.get("name")) or ""
        where = f"{owner}.{name}"
        asserted = body.get("assert")
        if not name or not isinstance(asserted, dict) or len(asserted) != 1:
            self.error("malformed-constraint", f"Constraint '{where}' needs a name and exactly one assertion.", where)
            return None
        (kind, value), severity = next(iter(asserted.items())), body.get("severity", "violation")
        if kind not in ASSERTIONS:
            self.error("unknown-assertion", f"Constraint '{where}' asserts the unknown '{kind}'.", where)
            return None
        if severity not in SEVERITIES:
            self.error("unknown-severity", f"Constraint '{where}' has the unknown severity '{severity}'.", where)
            severity = "violation"
        common = {"message": self.text(body.get("message")) or "", "severity": severity, "id": self.text(body.get("id")) or ""}
        if kind == "count":
            if not isinstance(value, dict) or not self.text(value.get("edge")):
                self.error("malformed-constraint", f"Constraint '{where}' must name the edge that it counts.", where)
                return None
            return Constraint(name, kind, edge=value["edge"], of=_local(self.text(value.get("of"))), bound=Bound(int(value.get("min") or 0), value.get("max")), **common)
        props = self.names(value)
        if len(props) != 2 if kind in COMPARISONS else len(props) < 2:
            self.error("malformed-constraint", f"Constraint '{where}' names {len(props)} properties.", where)
            return None
        return Constraint(name, kind, props, **common)


def _local(name: str | None) -> str | None:
    """Names are global, so an alias in front is dropped."""
    return name.rpartition(":")[2] if name else name


def parse_model(file: str, text: str) -> tuple[Model, list[Diagnostic]]:
    """The declarations of one file, unresolved."""
    r = Reader(file)
    try:
        raw = yaml.load(text, Loader=_Text)
    except yaml.YAMLError as error:
        return Model(), [Diagnostic("error", "yaml-syntax", str(error).replace("\n", " "), file)]
    if not isinstance(raw, dict):
        return Model(), [Diagnostic("error", "malformed-model", f"{file} must hold a mapping.", file)]
    space = raw.get("namespace")
    if space is not None and not (isinstance(space, dict) and isinstance(space.get("prefix"), str) and isinstance(space.get("iri"), str)):
        r.error("malformed-namespace", "A namespace needs a prefix and an iri.", file)
        space = None
    prefixes = {}
    for k, v in r.mapping(raw.get("prefixes"), "malformed-prefix", "prefixes").items():
        if isinstance(v, str):
            prefixes[k] = v
        else:
            r.error("malformed-prefix", f"Prefix '{k}' must be an IRI.", k)
    imports = []
    for item in raw.get("imports") or []:
        if isinstance(item, str):
            imports.append((item, ""))
        elif isinstance(item, dict) and isinstance(item.get("path", item.get("file")), str):
            imports.append((item.get("path", item.get("file")), str(item.get("as", ""))))
        else:
            r.error("malformed-import", f"An import of {file} names no path.", file)
    mixins = tuple(Mixin(n, r.props((b or {}).get("props"), n), (b or {}).get("id") or "", file) for n, b in r.mapping(raw.get("mixins"), "malformed-model", "mixins").items())
    enums = []
    for n, b in r.mapping(raw.get("enums"), "malformed-enum", "enums").items():
        values = b.get("values") if isinstance(b, dict) else b
        if not isinstance(values, list):
            r.error("malformed-enum", f"Enum '{n}' needs a list of values.", n)
        elif not values:
            r.error("empty-enum", f"Enum '{n}' has no values.", n)
        else:
            enums.append(Enum(n, tuple(map(str, values)), (b.get("id") if isinstance(b, dict) else "") or "", file))
    nodes = []
    for n, b in r.mapping(raw.get("nodes"), "malformed-node", "nodes").items():
        if b is not None and not isinstance(b, dict):
            r.error("malformed-node", f"Node type '{n}' must be a mapping.", n)
            continue
        b = b or {}
        found = [c for x in b.get("constraints") or [] if (c := r.constraint(x, n))]
        nodes.append(NodeType(n, r.text(b.get("id")) or "", r.text(b.get("iri")), b.get("abstract") is True, b.get("open") is True, _local(r.text(b.get("extends"))), tuple(map(_local, r.names(b.get("mixins")))), r.names(b.get("key")), r.props(b.get("props"), n), tuple(found), r.text(b.get("shacl")), file=file))
    edges = []
    for n, b in r.mapping(raw.get("edges"), "malformed-edge", "edges").items():
        if not isinstance(b, dict):
            r.error("malformed-edge", f"Edge type '{n}' must be a mapping.", n)
            continue
        sources, targets = r.cardinality(b.get("cardinality"), n)
        edges.append(EdgeType(n, _local(r.text(b.get("from"))) or "", _local(r.text(b.get("to"))) or "", r.text(b.get("id")) or "", r.text(b.get("iri")), sources, targets, r.props(b.get("props"), n), file))
    space = space or {}
    return Model(space.get("prefix", ""), space.get("iri", ""), str(raw.get("lpg", "1.0")), prefixes, tuple(imports), tuple(nodes), tuple(edges), mixins, tuple(enums)), r.said


def _facets(p: Property) -> dict:
    kind, many = (p.type.item, True) if p.type.kind == "list" else (p.type, False)
    out: dict = {"id": p.id} if p.id else {}
    out["type"] = str(kind)
    for key, value in (("list", many), ("enum", p.enum), ("min", p.min), ("max", p.max), ("minLength", p.min_length), ("maxLength", p.max_length), ("pattern", p.pattern), ("required", p.required), ("unique", p.unique)):
        if value is not None and value is not False:
            out[key] = value
    return out


def serialize_model(model: Model) -> str:
    """YAML of a model's own declarations, which parse_model reads back."""
    own = lambda props: {p.name: _facets(p) for p in props if not p.inherited_from and not p.mixin}
    clean = lambda d: {k: v for k, v in d.items() if v not in (None, False, {}, [], "")}

    def assertion(c: Constraint) -> dict:
        if c.kind != "count":
            return {c.kind: list(c.props)}
        return {"count": clean({"edge": c.edge, "of": c.of, "min": c.bound.least, "max": c.bound.most})}

    doc = {"lpg": model.version, "namespace": {"prefix": model.prefix, "iri": model.iri}}
    doc |= clean({
        "prefixes": dict(model.prefixes),
        "mixins": {m.name: clean({"id": m.id, "props": own(m.props)}) for m in model.mixins},
        "enums": {x.name: clean({"id": x.id, "values": list(x.values)}) for x in model.enums},
        "nodes": {n.name: clean({"id": n.id, "iri": n.iri, "abstract": n.abstract, "open": n.open, "extends": n.extends, "mixins": list(n.mixins), "key": [] if n.key_inherited_from else list(n.key), "props": own(n.props), "constraints": [clean({"id": c.id, "name": c.name, "assert": assertion(c), "message": c.message, "severity": None if c.severity == "violation" else c.severity}) for c in n.constraints], "shacl": n.raw_shacl}) for n in model.nodes},
        "edges": {e.name: clean({"id": e.id, "iri": e.iri, "from": e.source, "to": e.target, "cardinality": clean({"from": "" if e.sources == MANY else str(e.sources), "to": "" if e.targets == MANY else str(e.targets)}), "props": own(e.props)}) for e in model.edges},
    })
    return yaml.safe_dump(doc, sort_keys=False, allow_unicode=True)


def with_ids(model: Model) -> Model:
    """Derived ids count as written from here on."""
    return replace(model, derived_ids=frozenset())
