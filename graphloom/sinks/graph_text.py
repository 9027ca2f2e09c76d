"""Schema languages and documents: GQL, PG-Schema, LinkML, TypeScript, a schema card, HTML and notes."""

from __future__ import annotations

import html
import json

import yaml

from ..plans.diff import cardinality_name
from ..plans.model import Model, NodeType, Property

GQL = {
    "string": "STRING", "int8": "INT8", "int16": "INT16", "int32": "INT32", "int": "INTEGER", "int128": "INT128", "uint8": "UINT8", "uint16": "UINT16", "uint32": "UINT32", "uint64": "UINT64",
    "float32": "FLOAT32", "float": "FLOAT", "decimal": "DECIMAL", "boolean": "BOOLEAN", "date": "DATE", "datetime": "LOCAL DATETIME", "zoneddatetime": "ZONED DATETIME", "duration": "DURATION", "blob": "BYTES", "uuid": "STRING", "json": "STRING",
}
NUMBERS = {"int8", "int16", "int32", "int", "uint8", "uint16", "uint32", "float32", "float"}


def gql_type(p: Property) -> str:
    return f"LIST<{GQL[p.scalar]}>" if p.is_list else GQL[p.scalar]


def own(o) -> list[Property]:
    return [p for p in o.props if not p.inherited_from and not getattr(p, "mixin", None)]


def gql(model: Model) -> str:
    """Element types of the concrete nodes with their ancestors as implied labels, and of the edges between them."""
    alias = {n.name: n.name[0].lower() + n.name[1:] for n in model.concrete()}
    parts = []
    for n in model.concrete():
        props = ", ".join(f"{p.name} {gql_type(p)}{' NOT NULL' if p.required or p.name in n.key else ''}" for p in n.props)
        parts.append(f"  ({alias[n.name]} :{' & '.join((n.name, *n.ancestors))} {{{props}}})")
    for e in model.edges:
        props = ", ".join(f"{p.name} {gql_type(p)}{' NOT NULL' if p.required else ''}" for p in e.props)
        parts += [f"  ({alias[s.name]})-[:{e.name}{f' {{{props}}}' if props else ''}]->({alias[t.name]})" for s in model.leaves(e.source) for t in model.leaves(e.target)]
    for n in model.concrete():
        if len(n.key) == 1:
            parts.append(f"  CONSTRAINT FOR ({alias[n.name]}) REQUIRE {alias[n.name]}.{n.key[0]} IS NODE KEY")
        parts += [f"  CONSTRAINT FOR ({alias[n.name]}) REQUIRE {alias[n.name]}.{p.name} IS NODE UNIQUE" for p in n.props if p.unique and (p.name,) != n.key]
    return f"CREATE GRAPH TYPE {model.prefix}Type {{\n" + ",\n".join(parts) + "\n}\n"


def pgschema(model: Model) -> str:
    """Nothing is flattened: parents and mixins stay types of their own, parents first."""
    name = lambda x: x[0].lower() + x[1:] + "Type"
    edge_type = lambda x: name("".join(w.capitalize() for w in x.lower().split("_")))
    body = lambda props, key=(): ", ".join(f"{'' if p.required or p.name in key else 'OPTIONAL '}{p.name} {gql_type(p)}" for p in props)
    parts = [f"ABSTRACT ({name(m.name)} {{{body(m.props)}}})" for m in model.mixins]
    for n in sorted(model.nodes, key=lambda n: (len(n.ancestors), n.name)):
        line = " & ".join([*([name(n.extends)] if n.extends else []), *map(name, n.mixins), n.name])
        inner = body(own(n), n.key)
        parts.append(f"{'ABSTRACT ' if n.abstract else ''}({name(n.name)}: {line}{' OPEN' if n.open else ''}{f' {{{inner}}}' if inner else ''})")
    for e in model.edges:
        inner = body(e.props)
        parts.append(f"(:{name(e.source)})-[{edge_type(e.name)}: {e.name}{f' {{{inner}}}' if inner else ''}]->(:{name(e.target)})")
    for n in model.nodes:
        if n.key and not n.key_inherited_from:
            parts.append(f"FOR (x: {name(n.name)}) EXCLUSIVE MANDATORY SINGLETON {', '.join(f'x.{k}' for k in n.key)}")
        parts += [f"FOR (x: {name(n.name)}) EXCLUSIVE SINGLETON x.{p.name}" for p in own(n) if p.unique]
    return f"CREATE GRAPH TYPE {model.prefix}Type STRICT {{\n  " + ",\n  ".join(parts) + "\n}\n"


def linkml(model: Model) -> str:
    ranges = {"string": "string", "float": "double", "float32": "float", "decimal": "decimal", "boolean": "boolean", "date": "date", "datetime": "datetime", "zoneddatetime": "datetime"}
    number = lambda v: int(v) if v == int(v) else v

    def slot(p: Property, key: tuple[str, ...]) -> dict:
        out: dict = {"range": p.enum or ranges.get(p.scalar) or ("integer" if "int" in p.scalar else "string")}
        for k, v in (("required", p.required or p.name in key or None), ("multivalued", p.is_list or None), ("identifier", (p.name,) == key or None), ("minimum_value", None if p.min is None else number(p.min)), ("maximum_value", None if p.max is None else number(p.max)), ("pattern", p.pattern)):
            if v is not None:
                out[k] = v
        return out

    classes: dict = {m.name: {"mixin": True, "attributes": {p.name: slot(p, ()) for p in m.props}} for m in model.mixins}
    for n in model.nodes:
        c: dict = {k: v for k, v in (("abstract", n.abstract or None), ("is_a", n.extends), ("mixins", list(n.mixins) or None)) if v}
        c["attributes"] = {p.name: slot(p, () if n.key_inherited_from else n.key) for p in own(n)}
        unique = {p.name: {"unique_key_slots": [p.name]} for p in own(n) if p.unique}
        if len(n.key) > 1 and not n.key_inherited_from:
            unique["key"] = {"unique_key_slots": list(n.key)}
        if unique:
            c["unique_keys"] = unique
        classes[n.name] = c
    for e in model.edges:
        if e.props:
            classes[e.name] = {"attributes": {"subject": {"range": e.source, "required": True}, "object": {"range": e.target, "required": True}} | {p.name: slot(p, ()) for p in e.props}}
        elif e.source in classes:
            link = {"range": e.target} | ({"multivalued": True} if e.targets.most != 1 else {}) | ({"required": True} if e.targets.least else {})
            classes[e.source]["attributes"][e.name.lower()] = link
    doc = {"id": model.iri, "name": model.prefix, "prefixes": {model.prefix: model.iri, "linkml": "https://w3id.org/linkml/"} | model.prefixes, "imports": ["linkml:types"], "default_prefix": model.prefix, "enums": {x.name: {"permissible_values": {v: {} for v in x.values}} for x in model.enums}, "classes": classes}
    return yaml.safe_dump({k: v for k, v in doc.items() if v}, sort_keys=False, allow_unicode=True)


def typescript(model: Model) -> str:
    def kind(p: Property) -> str:
        one = p.enum or ("number" if p.scalar in NUMBERS else "boolean" if p.scalar == "boolean" else "bigint" if p.scalar in ("int128", "uint64") else "Uint8Array" if p.scalar == "blob" else "unknown" if p.scalar == "json" else "string")
        return f"{one}[]" if p.is_list else one

    member = lambda p, key=(): f"  {p.name}{'' if p.required or p.name in key else '?'}: {kind(p)};"
    out = [f"export type {x.name} = {' | '.join(json.dumps(v, ensure_ascii=False) for v in x.values)};" for x in model.enums]
    out += [f"export interface {m.name} {{\n" + "\n".join(map(member, m.props)) + "\n}" for m in model.mixins]
    for n in model.nodes:
        parents = [*([n.extends] if n.extends else []), *n.mixins]
        lines = [member(p, n.key) for p in own(n)] + (["  [key: string]: unknown;"] if n.open else [])
        out.append(f"export interface {n.name}{f' extends {", ".join(parents)}' if parents else ''} {{\n" + "\n".join(lines) + "\n}")
    out += [f"export interface {''.join(w.capitalize() for w in e.name.lower().split('_'))}Edge {{\n" + "\n".join(map(member, e.props)) + "\n}" for e in model.edges if e.props]
    schema = {"nodes": {n.name: {"labels": [n.name, *n.ancestors], "key": list(n.key)} for n in model.concrete()}, "edges": {e.name: {"from": e.source, "to": e.target, "cardinality": cardinality_name(e)} for e in model.edges}}
    out.append(f"export const SCHEMA = {json.dumps(schema, indent=2, ensure_ascii=False)} as const;")
    return "\n\n".join(out) + "\n"


def _card(p: Property) -> str:
    bounds = f" [{'' if p.min is None else f'{p.min:g}'}..{'' if p.max is None else f'{p.max:g}'}]" if p.min is not None or p.max is not None else ""
    return f"{p.name}{'!' if p.required else ''}{'^' if p.unique else ''}: {p.type}{f'={p.enum}' if p.enum else ''}{bounds}"


def _node_line(n: NodeType) -> str:
    head = f"- **{n.name}**" + (" (abstract)" if n.abstract else "") + (" (open)" if n.open else "") + (f" < {n.extends}" if n.extends else "") + "".join(f" +{m}" for m in n.mixins)
    key = f" key: {', '.join(n.key)}" + (f" (from {n.key_inherited_from})" if n.key_inherited_from else "") if n.key else ""
    return head + key + (f" — {', '.join(map(_card, own(n)))}" if own(n) else "")


def context(model: Model) -> str:
    """A card of one line for each type: ! required, ^ unique, < parent, + mixin, = enum, [a..b] bounds."""
    out = [f"# Schema {model.prefix} <{model.iri}>", "", "Marks: `!` required, `^` unique, `<` parent, `+` mixin, `=` enum, `[a..b]` bounds.", "", "## Node types", *map(_node_line, model.nodes)]
    if model.edges:
        out += ["", "## Edge types", *(f"- **{e.name}**: {e.source} → {e.target}" + ("" if cardinality_name(e) == "many-to-many" else f" ({cardinality_name(e)})") + (f" — {', '.join(map(_card, e.props))}" if e.props else "") for e in model.edges)]
    if model.mixins:
        out += ["", "## Mixins", *(f"- **{m.name}** — {', '.join(map(_card, m.props))}" for m in model.mixins)]
    if model.enums:
        out += ["", "## Enums", *(f"- **{x.name}**: {', '.join(x.values)}" for x in model.enums)]
    return "\n".join(out) + "\n"


def docs(model: Model) -> str:
    """One HTML page: types with their properties, and what each target does with the features in use."""
    from . import FEATURES, TARGETS, used_features

    cell = lambda *x: "<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in x) + "</tr>"
    table = lambda head, rows: "<table><tr>" + "".join(f"<th>{html.escape(h)}</th>" for h in head) + "</tr>" + "".join(rows) + "</table>"
    props = lambda o: table(("property", "type", "required", "unique", "from"), [cell(p.name, p.type, p.required, p.unique, p.inherited_from or "") for p in o.props])
    parts = [f"<h1>{html.escape(model.prefix)}</h1><p>{html.escape(model.iri)}</p>"]
    parts += [f'<section id="{html.escape(n.name)}"><h2>{html.escape(n.name)}</h2><p>{"abstract" if n.abstract else "concrete"}{html.escape(f", extends {n.extends}") if n.extends else ""}, key {html.escape(", ".join(n.key))}</p>{props(n)}</section>' for n in model.nodes]
    parts += [f'<section id="{html.escape(e.name)}"><h2>{html.escape(e.name)}</h2><p>{html.escape(f"{e.source} to {e.target}, {cardinality_name(e)}")}</p>{props(e)}</section>' for e in model.edges]
    used = [f for f in FEATURES if f in used_features(model)]
    parts.append("<h2>Targets</h2>" + table(("feature", *TARGETS), [cell(f, *(t.capabilities[f] for t in TARGETS.values())) for f in used]))
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(model.prefix)}</title></head><body>{''.join(parts)}</body></html>\n"


def tgs(model: Model) -> str:
    """Notes with front matter, one for each concrete type; an edge is a property of its source's notes."""
    notes = []
    for n in model.concrete():
        fields: list[dict] = [{"name": p.name, "type": model.enum(p.enum) and "enum" or str(p.type)} | ({"required": True} if p.required or p.name in n.key else {}) | ({"values": list(model.enum(p.enum).values)} if model.enum(p.enum) else {}) for p in n.props]
        for e in model.edges:
            if n in model.leaves(e.source):
                fields.append({"name": e.name, "type": "link", "to": [t.name for t in model.leaves(e.target)]} | ({"many": False} if e.targets.most == 1 else {}) | ({"required": True} if e.targets.least else {}))
        front = {"type": n.name, "key": list(n.key), "properties": fields} | ({"lpg": {"extends": n.extends}} if n.extends else {})
        notes.append("---\n" + yaml.safe_dump(front, sort_keys=False, allow_unicode=True) + f"---\n\n# {n.name}\n")
    return "\n".join(notes)
