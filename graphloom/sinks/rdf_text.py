"""Turtle: SHACL shapes and OWL classes."""

from __future__ import annotations

import json

from ..plans.model import Constraint, EdgeType, Model, Property

#: Datatypes by scalar (fixed values).
XSD = {
    "string": "string", "int8": "byte", "int16": "short", "int32": "int", "int": "long", "int128": "integer", "uint8": "unsignedByte", "uint16": "unsignedShort", "uint32": "unsignedInt", "uint64": "unsignedLong",
    "float32": "float", "float": "double", "decimal": "decimal", "boolean": "boolean", "date": "date", "datetime": "dateTime", "zoneddatetime": "dateTimeStamp", "duration": "duration", "uuid": "string", "blob": "base64Binary", "json": "string",
}
#: Terms of severities (fixed values).
SEVERITIES = {"violation": "Violation", "warning": "Warning", "info": "Info"}


def _prefixes(model: Model, *more: str) -> str:
    known = {"sh": "http://www.w3.org/ns/shacl#", "owl": "http://www.w3.org/2002/07/owl#", "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "xsd": "http://www.w3.org/2001/XMLSchema#", "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#"}
    own = {model.prefix: model.iri} | model.prefixes
    return "\n".join(f"@prefix {k}: <{v}> ." for k, v in (own | {k: known[k] for k in more}).items())


def _text(x: str) -> str:
    return json.dumps(x, ensure_ascii=False)


def camel(name: str) -> str:
    head, *rest = name.lower().split("_")
    return head + "".join(w.capitalize() for w in rest)


def _shape(model: Model, p: Property, key: tuple[str, ...]) -> str:
    facts = [f"sh:path {model.prefix}:{p.name}"]
    facts.append(f"sh:datatype xsd:{XSD[p.scalar]}")
    if enum := model.enum(p.enum):
        facts.append(f"sh:in ({' '.join(map(_text, enum.values))})")
    if not p.is_list:
        facts.append("sh:maxCount 1")
    if p.required or p.name in key:
        facts.append("sh:minCount 1")
    facts += [f"{name} {value:g}" for name, value in (("sh:minInclusive", p.min), ("sh:maxInclusive", p.max)) if value is not None]
    facts += [f"{name} {value}" for name, value in (("sh:minLength", p.min_length), ("sh:maxLength", p.max_length)) if value is not None]
    if p.pattern is not None:
        facts.append(f"sh:pattern {_text(p.pattern)}")
    return "sh:property [ " + " ; ".join(facts) + " ]"


def _assertion(model: Model, c: Constraint) -> str:
    """What a shape of its own says for a constraint; message and severity stand where the results come from: with the path, or on the shape for choices."""
    path = lambda p: f"{model.prefix}:{p}"
    also = (f" ; sh:message {_text(c.message)}" if c.message else "") + (f" ; sh:severity sh:{SEVERITIES[c.severity]}" if c.severity != "violation" else "")
    one = lambda p: f"[ sh:property [ sh:path {path(p)} ; sh:minCount 1 ] ]"
    match c.kind:
        case "lessThan" | "lessThanOrEquals" | "equals" | "disjoint":
            return f"sh:property [ sh:path {path(c.props[0])} ; sh:{c.kind} {path(c.props[1])}{also} ]"
        case "atLeastOne":
            return f"sh:or ( {' '.join(map(one, c.props))} ){also}"
        case "exactlyOne":
            return f"sh:xone ( {' '.join(map(one, c.props))} ){also}"
    bounds = (f" ; sh:qualifiedMinCount {c.bound.least}" if c.bound.least else "") + (f" ; sh:qualifiedMaxCount {c.bound.most}" if c.bound.most is not None else "")
    of = f"[ sh:class {path(c.of)} ]" if c.of else "[ ]"
    return f"sh:property [ sh:path {path(camel(c.edge))} ; sh:qualifiedValueShape {of}{bounds}{also} ]"


def _ends(model: Model, e: EdgeType, node: str) -> list[str]:
    """Bounds at an edge's ends: forwards at its source, along the inverse path at its target."""
    path, out = f"{model.prefix}:{camel(e.name)}", []
    for at, way, other, b in ((e.source, path, e.target, e.targets), (e.target, f"[ sh:inversePath {path} ]", e.source, e.sources)):
        if at == node and (b.least or b.most is not None or at == e.source):
            counts = (f" ; sh:minCount {b.least}" if b.least else "") + (f" ; sh:maxCount {b.most}" if b.most is not None else "")
            out.append(f"sh:property [ sh:path {way} ; sh:class {model.prefix}:{other}{counts} ]")
    return out


def shacl(model: Model) -> str:
    out = [_prefixes(model, "sh", "xsd", "rdfs")]
    for n in model.nodes:
        facts = [f"sh:targetClass {model.prefix}:{n.name}"]
        if n.extends:
            facts.append(f"sh:node {model.prefix}:{n.extends}Shape")
        facts += [_shape(model, p, n.key) for p in n.props if not p.inherited_from]
        facts += [x for e in model.edges for x in _ends(model, e, n.name)]
        if not n.open and not n.abstract:
            facts.append("sh:closed true ; sh:ignoredProperties ( rdf:type )")
        out.append(f"{model.prefix}:{n.name}Shape a sh:NodeShape ;\n  " + " ;\n  ".join(facts) + " ." + (f"\n{n.raw_shacl}" if n.raw_shacl else ""))
        # a shape for each constraint, so that a message tells of it alone
        out += [f"{model.prefix}:{n.name}_{c.name}Shape a sh:NodeShape ;\n  sh:targetClass {model.prefix}:{n.name} ;\n  {_assertion(model, c)} ." for c in n.constraints]
        if n.extends:
            out.append(f"{model.prefix}:{n.name} rdfs:subClassOf {model.prefix}:{n.extends} .")
    for e in model.edges:
        if e.props:
            facts = [f"sh:targetClass {model.prefix}:{e.name}", *(f"sh:property [ sh:path {model.prefix}:{camel(e.name)}{end} ; sh:class {model.prefix}:{at} ; sh:minCount 1 ; sh:maxCount 1 ]" for end, at in (("Subject", e.source), ("Object", e.target))), *(_shape(model, p, ()) for p in e.props)]
            out.append(f"{model.prefix}:{e.name}Shape a sh:NodeShape ;\n  " + " ;\n  ".join(facts) + " .")
    text = "\n\n".join(out) + "\n"
    return text.replace("@prefix sh:", "@prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> .\n@prefix sh:", 1) if "rdf:type" in text else text


def owl(model: Model) -> str:
    """Classes with keys, enums as datatypes, datatype properties with a range and no domain, edges plain or as classes."""
    x, out = model.prefix, [_prefixes(model, "owl", "rdfs", "xsd")]
    for n in model.nodes:
        facts = ["a owl:Class"] + ([f"rdfs:subClassOf {x}:{n.extends}"] if n.extends else []) + ([f"owl:hasKey ( {' '.join(f'{x}:{k}' for k in n.key)} )"] if n.key and not n.key_inherited_from else []) + ([f"owl:equivalentClass <{n.iri}>"] if n.iri else [])
        out.append(f"{x}:{n.name} " + " ; ".join(facts) + " .")
    out += [f"{x}:{e.name} a rdfs:Datatype ; owl:oneOf ( {' '.join(map(_text, e.values))} ) ." for e in model.enums]
    seen: set[str] = set()
    for p in (p for o in (*model.nodes, *model.edges) for p in o.props):
        if p.name not in seen:
            seen.add(p.name)
            out.append(f"{x}:{p.name} a owl:DatatypeProperty ; rdfs:range {f'{x}:{p.enum}' if p.enum else f'xsd:{XSD[p.scalar]}'} .")
    for e in model.edges:
        name = camel(e.name)
        if e.props:
            out.append(f"{x}:{e.name} a owl:Class .\n{x}:{name}Subject a owl:ObjectProperty ; rdfs:domain {x}:{e.name} ; rdfs:range {x}:{e.source} .\n{x}:{name}Object a owl:ObjectProperty ; rdfs:domain {x}:{e.name} ; rdfs:range {x}:{e.target} .")
        out.append(f"{x}:{name} a owl:ObjectProperty ; rdfs:domain {x}:{e.source} ; rdfs:range {x}:{e.target} .")
    return "\n\n".join(out) + "\n"
