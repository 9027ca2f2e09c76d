"""Schemas of property-graph databases."""

from __future__ import annotations

import re

from ..functions.types import ValueType
from ..plans.model import Model, NodeType

#: Type spellings of two databases (fixed values).
LADYBUG = {
    "string": "STRING", "int8": "INT8", "int16": "INT16", "int32": "INT32", "int": "INT64", "int128": "INT128", "uint8": "UINT8", "uint16": "UINT16", "uint32": "UINT32", "uint64": "UINT64",
    "float32": "FLOAT", "float": "DOUBLE", "decimal": "DECIMAL", "boolean": "BOOL", "date": "DATE", "datetime": "TIMESTAMP", "zoneddatetime": "TIMESTAMP_TZ", "duration": "INTERVAL", "uuid": "UUID", "blob": "BLOB", "json": "JSON",
}
MEMGRAPH = {"string": "STRING", "boolean": "BOOLEAN", "date": "DATE", "datetime": "LOCALDATETIME", "zoneddatetime": "ZONEDDATETIME", "duration": "DURATION", "float": "FLOAT", "float32": "FLOAT"} | dict.fromkeys(("int8", "int16", "int32", "int", "uint8", "uint16", "uint32", "uint64"), "INTEGER")


def snake(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name).lower()).strip("_")


def ladybug_type(t: ValueType) -> str:
    match t.kind:
        case "list":
            return f"{ladybug_type(t.item)}[]"
        case "array":
            return f"{ladybug_type(t.item)}[{t.size}]"
        case "map":
            return f"MAP({ladybug_type(t.parts[0][1])}, {ladybug_type(t.parts[1][1])})"
        case "struct" | "union":
            return f"{t.kind.upper()}({', '.join(f'{n} {ladybug_type(x)}' for n, x in t.parts)})"
    return LADYBUG[t.name] + (f"({t.precision}, {t.scale})" if t.precision is not None else "")


def _head(model: Model, mark: str) -> str:
    return f"{mark} Model {model.prefix} <{model.iri}>"


def ladybug(model: Model) -> str:
    """A table for each concrete type; a composite key is a column of its own made of the parts."""
    out = [_head(model, "//")]
    for n in model.nodes:
        if n.abstract:
            out.append(f"// {n.name} is abstract and has no table.")
            continue
        key = n.key[0] if len(n.key) == 1 else f"{snake(n.name)}_key"
        notes = {p.name: [w for w, on in (("required", p.required), ("unique", p.unique), ("one of an enum", p.enum), ("bounded", p.min is not None or p.max is not None or p.pattern is not None)) if on and p.name not in n.key] for p in n.props}
        lines = [f"  {p.name} {ladybug_type(p.type)}," + (f" // UNENFORCED: {', '.join(notes[p.name])}" if notes[p.name] else "") for p in n.props]
        if len(n.key) != 1:
            lines.append(f"  {key} STRING, // made of {', '.join(n.key)}")
        out.append(f"CREATE NODE TABLE IF NOT EXISTS {n.name} (\n" + "\n".join(lines) + f"\n  PRIMARY KEY({key})\n);")
    for e in model.edges:
        pairs = [f"  FROM {s.name} TO {t.name}" for s in model.leaves(e.source) for t in model.leaves(e.target)]
        if not pairs:
            out.append(f"// {e.name} has an end without a concrete type.")
            continue
        many = {(True, True): "ONE_ONE", (True, False): "ONE_MANY", (False, True): "MANY_ONE"}.get((e.sources.most == 1, e.targets.most == 1))
        out.append(f"CREATE REL TABLE IF NOT EXISTS {e.name} (\n" + ",\n".join([*pairs, *(f"  {p.name} {ladybug_type(p.type)}" for p in e.props), *([f"  {many}"] if many else [])]) + "\n);")
    return "\n\n".join(out) + "\n"


def _labels(n: NodeType) -> str:
    return "".join(f":{x}" for x in (n.name, *n.ancestors))


def neo4j(model: Model, enterprise: bool = False) -> str:
    """Constraints on labels; a node carries its type's label and its ancestors'."""
    out = [_head(model, "//")]
    for n in model.concrete():
        part, base = [f"// {_labels(n)}"], snake(n.name)
        if n.key:
            kind, suffix = ("NODE KEY", "key") if enterprise else ("UNIQUE", "key_unique")
            part.append(f"CREATE CONSTRAINT {base}_{suffix} IF NOT EXISTS FOR (n:{n.name}) REQUIRE ({', '.join(f'n.{k}' for k in n.key)}) IS {kind};")
        for p in n.props:
            if p.name in n.key:
                continue
            if p.unique:
                part.append(f"CREATE CONSTRAINT {base}_{snake(p.name)}_unique IF NOT EXISTS FOR (n:{n.name}) REQUIRE n.{p.name} IS UNIQUE;")
            if p.required:
                part.append(f"CREATE CONSTRAINT {base}_{snake(p.name)}_exists IF NOT EXISTS FOR (n:{n.name}) REQUIRE n.{p.name} IS NOT NULL;" if enterprise else f"// UNENFORCED: {p.name} is required.")
        out.append("\n".join(part))
    out += [f"// (:{e.source})-[:{e.name}]->(:{e.target})" for e in model.edges]
    return "\n\n".join(out) + "\n"


def memgraph(model: Model) -> str:
    out = [_head(model, "//")] + [f"CREATE ENUM {x.name} VALUES {{ {', '.join(x.values)} }};" for x in model.enums]
    for n in model.concrete():
        part = [f"// {_labels(n)}"]
        if n.key:
            part.append(f"CREATE CONSTRAINT ON (n:{n.name}) ASSERT {', '.join(f'n.{k}' for k in n.key)} IS UNIQUE;")
            part += [f"CREATE CONSTRAINT ON (n:{n.name}) ASSERT EXISTS (n.{k});" for k in n.key]
            part.append(f"CREATE INDEX ON :{n.name}({', '.join(n.key)});")
        for p in n.props:
            if p.unique and p.name not in n.key:
                part.append(f"CREATE CONSTRAINT ON (n:{n.name}) ASSERT n.{p.name} IS UNIQUE;")
            if p.required and p.name not in n.key:
                part.append(f"CREATE CONSTRAINT ON (n:{n.name}) ASSERT EXISTS (n.{p.name});")
            kind = "LIST" if p.is_list else "ENUM" if p.enum else MEMGRAPH.get(p.scalar)
            if kind:
                part.append(f"CREATE CONSTRAINT ON (n:{n.name}) ASSERT n.{p.name} IS TYPED {kind};")
        out.append("\n".join(part))
    out += [f"// (:{e.source})-[:{e.name}]->(:{e.target})" for e in model.edges]
    return "\n\n".join(out) + "\n"


def falkordb(model: Model) -> str:
    """A shell script: indexes are queries, constraints are commands."""
    out = ["#!/bin/sh\n" + _head(model, "#"), f'REDIS_CLI="${{REDIS_CLI:-redis-cli}}"\nGRAPH_KEY="${{GRAPH_KEY:-{model.prefix}}}"']
    command = lambda rule, n, props: f'$REDIS_CLI GRAPH.CONSTRAINT CREATE "$GRAPH_KEY" {rule} NODE {n.name} PROPERTIES {len(props)} {" ".join(props)}'
    for n in model.concrete():
        part, uniques = [f"# {_labels(n)}"], [list(n.key)] if n.key else []
        uniques += [[p.name] for p in n.props if p.unique and (p.name,) != n.key]
        for props in uniques:
            part.append(f'$REDIS_CLI GRAPH.QUERY "$GRAPH_KEY" "CREATE INDEX FOR (n:{n.name}) ON ({", ".join(f"n.{k}" for k in props)})"')
            part.append(command("UNIQUE", n, props))
        part += [command("MANDATORY", n, [x]) for x in dict.fromkeys([*n.key, *(p.name for p in n.props if p.required)])]
        out.append("\n".join(part))
    out += [f"# (:{e.source})-[:{e.name}]->(:{e.target})" for e in model.edges]
    return "\n\n".join(out) + "\n"
