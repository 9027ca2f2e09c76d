"""Turtle: a reader of triples, and SHACL shapes and OWL classes read together as a model."""

from __future__ import annotations

import re
from collections import defaultdict

from ..functions.types import ValueType
from ..plans.model import Bound, Constraint, Diagnostic, EdgeType, Enum, Model, NodeType, Property
from ..plans.resolve import flatten

_TOKEN = re.compile(r'\s+|#[^\n]*|<([^>]*)>|"""(.*?)"""|"((?:[^"\\]|\\.)*)"|(\^\^|[\[\](){};,.@])|([^\s\[\](){};,"<>]+?)(?=[\s\[\](){};,"<>]|\.(?:\s|$)|$)', re.S)
RDF, RDFS, SH, OWL, XSD = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/ns/shacl#", "http://www.w3.org/2002/07/owl#", "http://www.w3.org/2001/XMLSchema#"
#: Scalars by XSD name (fixed values).
SCALARS = {"string": "string", "byte": "int8", "short": "int16", "int": "int32", "long": "int", "integer": "int", "unsignedByte": "uint8", "unsignedShort": "uint16", "unsignedInt": "uint32", "unsignedLong": "uint64", "float": "float32", "double": "float", "decimal": "decimal", "boolean": "boolean", "date": "date", "dateTime": "datetime", "dateTimeStamp": "zoneddatetime", "duration": "duration", "base64Binary": "blob"}


class Literal(str):
    """A literal, apart from IRIs and blank nodes."""


def read_triples(text: str) -> tuple[list[tuple[str, str, str]], dict[str, str]]:
    """(triples, prefixes). Collections become rdf:first and rdf:rest; blank nodes are named _:n."""
    tokens = []
    for m in _TOKEN.finditer(text):
        if m[1] is not None:
            tokens.append(("iri", m[1]))
        elif m[2] is not None or m[3] is not None:
            tokens.append(("literal", m[2] if m[2] is not None else re.sub(r"\\(.)", lambda x: {"n": "\n", "t": "\t"}.get(x[1], x[1]), m[3])))
        elif m[4] or m[5]:
            tokens.append(("mark" if m[4] else "word", m[4] or m[5]))
    triples: list[tuple[str, str, str]] = []
    prefixes: dict[str, str] = {}
    at = blanks = 0

    def take() -> tuple[str, str]:
        nonlocal at
        at += 1
        return tokens[at - 1] if at <= len(tokens) else ("end", "")

    def peek(mark: str) -> bool:
        return at < len(tokens) and tokens[at] == ("mark", mark)

    def blank() -> str:
        nonlocal blanks
        blanks += 1
        return f"_:{blanks}"

    def term() -> str:
        kind, value = take()
        if kind == "iri":
            return value
        if kind == "literal":
            if peek("^^"):
                take()
                term()
            elif peek("@"):
                take(), take()
            return Literal(value)
        if (kind, value) == ("mark", "["):
            node = blank()
            predicates(node)
            if not peek("]"):
                raise ValueError("an unclosed [")
            take()
            return node
        if (kind, value) == ("mark", "("):
            items = []
            while not peek(")"):
                if at >= len(tokens):
                    raise ValueError("an unclosed (")
                items.append(term())
            take()
            head = RDF + "nil"
            for x in reversed(items):
                node = blank()
                triples.extend([(node, RDF + "first", x), (node, RDF + "rest", head)])
                head = node
            return head
        if value == "a":
            return RDF + "type"
        if ":" in value:
            prefix, _, local = value.partition(":")
            return value if prefix == "_" else prefixes.get(prefix, prefix + ":") + local
        return Literal(value)

    def predicates(subject: str) -> None:
        while at < len(tokens) and not (peek("]") or peek(".")):
            p = term()
            while True:
                triples.append((subject, p, term()))
                if not peek(","):
                    break
                take()
            if not peek(";"):
                break
            while peek(";"):
                take()

    while at < len(tokens):
        kind, value = tokens[at]
        if (kind, value) == ("mark", "@") or value.lower() in ("prefix", "base"):
            if value == "@":
                take()
            name = take()[1].lower()
            if name == "prefix":
                prefix = take()[1].rstrip(":")
                prefixes[prefix] = take()[1]
            else:
                take()
            if peek("."):
                take()
            continue
        predicates(term())
        if not peek("."):
            raise ValueError("a statement without its dot")
        take()
    return triples, prefixes


def local(iri: str) -> str:
    return re.split(r"[#/]", iri)[-1]


def upper(name: str) -> str:
    return re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name).upper()


def import_turtle(text: str) -> tuple[Model, list[Diagnostic]]:
    """Shapes give properties and bounds, classes the hierarchy and keys. Of several shapes for a path the tighter bound wins."""
    try:
        triples, prefixes = read_triples(text)
    except ValueError as error:
        return Model(), [Diagnostic("error", "turtle-syntax", str(error))]
    said: list[Diagnostic] = []
    facts: dict[str, dict[str, list[str]]] = defaultdict(lambda: defaultdict(list))
    for s, p, o in triples:
        facts[s][p].append(o)
    one = lambda s, p: (facts[s][p] or [None])[0]

    def items(head: str | None) -> list[str]:
        out = []
        while head and head != RDF + "nil":
            out.append(one(head, RDF + "first"))
            head = one(head, RDF + "rest")
        return out

    number = lambda x: None if x is None else float(x) if re.search("[.eE]", x) else int(x)
    shapes = [s for s in list(facts) if SH + "NodeShape" in facts[s][RDF + "type"] or facts[s][SH + "targetClass"]]
    classes = {s for s in list(facts) if OWL + "Class" in facts[s][RDF + "type"]} | {c for s in shapes for c in facts[s][SH + "targetClass"]}
    parents = {local(s): local(facts[s][RDFS + "subClassOf"][0]) for s in list(facts) if facts[s][RDFS + "subClassOf"] and not facts[s][RDFS + "subClassOf"][0].startswith("_:")}
    enums: dict[str, Enum] = {}
    reified = {local(c) for s in shapes for c in facts[s][SH + "targetClass"] for p in facts[s][SH + "property"] if local(str(one(p, SH + "path"))).endswith("Subject")}
    props: dict[str, dict[str, Property]] = defaultdict(dict)
    edges: dict[str, EdgeType] = {}
    constraints: dict[str, list[Constraint]] = defaultdict(list)
    closed: set[str] = set()

    def property_of(p: str, name: str, owner: str) -> Property:
        values = items(one(p, SH + "in"))
        enum = None
        if values:
            enum = next((e.name for e in enums.values() if e.values == tuple(values)), None) or f"{owner}{name[:1].upper()}{name[1:]}"
            enums[enum] = Enum(enum, tuple(values))
        datatype = local(one(p, SH + "datatype") or XSD + "string")
        if datatype not in SCALARS:
            said.append(Diagnostic("info", "import-unknown-type", f"{owner}.{name} has the type '{datatype}', read as string.", f"{owner}.{name}"))
        kind = ValueType("scalar", SCALARS.get(datatype, "string"))
        if (number(one(p, SH + "maxCount")) or 2) > 1:
            kind = ValueType("list", parts=(("", kind),))
        old = props[owner].get(name)
        tight = lambda a, b, pick: b if a is None else a if b is None else pick(a, b)
        bound = {k: number(one(p, SH + f)) for k, f in (("min", "minInclusive"), ("max", "maxInclusive"), ("min_length", "minLength"), ("max_length", "maxLength"))}
        if old:
            bound = {k: tight(getattr(old, k), v, max if k.startswith("min") else min) for k, v in bound.items()}
        return Property(name, kind, enum=enum, pattern=one(p, SH + "pattern"), required=(number(one(p, SH + "minCount")) or 0) > 0 or bool(old and old.required), **bound)

    def told(shape: str) -> dict[str, str]:
        """The message and severity of what a shape reports."""
        severity = local(one(shape, SH + "severity") or "Violation").lower()
        return {"message": one(shape, SH + "message") or "", "severity": severity if severity in ("violation", "warning", "info") else "violation"}

    for s in shapes:
        for target in facts[s][SH + "targetClass"]:
            owner = local(target)
            own = re.fullmatch(rf"{re.escape(owner)}_(\w+)Shape", local(s))
            title = lambda other, own=own: own[1] if own else other
            if one(s, SH + "closed") == "true":
                closed.add(owner)
            for p in facts[s][SH + "property"]:
                path, to = one(p, SH + "path"), one(p, SH + "class")
                inverse = one(path, SH + "inversePath") if path and path.startswith("_:") else None
                name = local(inverse or path or "")
                compared = next((k for k in ("lessThan", "lessThanOrEquals", "equals", "disjoint") if facts[p][SH + k]), None)
                least, most = number(one(p, SH + "minCount")) or 0, number(one(p, SH + "maxCount"))
                if compared:
                    constraints[owner].append(Constraint(title(f"{name}_{compared}"), compared, (name, local(one(p, SH + compared))), **told(p)))
                elif facts[p][SH + "qualifiedValueShape"]:
                    of = one(one(p, SH + "qualifiedValueShape"), SH + "class")
                    constraints[owner].append(Constraint(title(f"{name}_count"), "count", edge=upper(name), of=of and local(of), bound=Bound(number(one(p, SH + "qualifiedMinCount")) or 0, number(one(p, SH + "qualifiedMaxCount"))), **told(p)))
                elif owner in reified and name.endswith(("Subject", "Object")):
                    edge = edges.get(owner) or EdgeType(owner)
                    side = {"source": local(to or "")} if name.endswith("Subject") else {"target": local(to or "")}
                    edges[owner] = EdgeType(**{**edge.__dict__, **side})
                elif to:
                    edge = edges.get(upper(name)) or EdgeType(upper(name))
                    change = {"source": local(to), "target": owner, "sources": Bound(least, most)} if inverse else {"source": owner, "target": local(to), "targets": Bound(least, most)}
                    edges[upper(name)] = EdgeType(**{**edge.__dict__, **change})
                else:
                    props[owner][name] = property_of(p, name, owner)
            for kind, predicate in (("atLeastOne", "or"), ("exactlyOne", "xone")):
                for head in facts[s][SH + predicate]:
                    names = tuple(local(one(x, SH + "path") or one(one(x, SH + "property"), SH + "path")) for x in items(head))
                    constraints[owner].append(Constraint(title("_".join(names)), kind, names, **told(s)))
    nodes = []
    for c in sorted(classes):
        name = local(c)
        if name in reified:
            edges[name] = EdgeType(**{**(edges.get(name) or EdgeType(name)).__dict__, "props": tuple(props[name].values())})
            continue
        key = tuple(local(k) for k in items(one(c, OWL + "hasKey")))
        has_children = name in parents.values()
        nodes.append(NodeType(name, extends=parents.get(name), abstract=has_children and name not in closed, open=name not in closed and not has_children and bool(shapes), key=key, props=tuple(props[name].values()), constraints=tuple(constraints[name])))
    if not classes:
        said.append(Diagnostic("warning", "import-empty", "No class and no shape was found."))
    prefix, iri = next(((k, v) for k, v in prefixes.items() if v not in (RDF, RDFS, SH, OWL, XSD)), ("rdf", "https://example.org/rdf#"))
    model = Model(prefix, iri, nodes=tuple(nodes), edges=tuple(edges.values()), enums=tuple(enums.values()))
    return flatten(model, said), said
