"""Tables: Spark DDL, and SQL with a property graph over it."""

from __future__ import annotations

from ..functions.types import ValueType, spark_type
from ..operators.graph import edge_tables, endpoint_columns
from ..plans.model import Constraint, Model, Property

DUCKDB = {
    "string": "VARCHAR", "int8": "TINYINT", "int16": "SMALLINT", "int32": "INTEGER", "int": "BIGINT", "int128": "HUGEINT", "uint8": "UTINYINT", "uint16": "USMALLINT", "uint32": "UINTEGER", "uint64": "UBIGINT",
    "float32": "FLOAT", "float": "DOUBLE", "decimal": "DECIMAL", "boolean": "BOOLEAN", "date": "DATE", "datetime": "TIMESTAMP", "zoneddatetime": "TIMESTAMPTZ", "duration": "INTERVAL", "uuid": "UUID", "blob": "BLOB", "json": "JSON",
}
TEMPORAL = {"date", "datetime", "zoneddatetime", "duration"}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def spark(model: Model) -> str:
    """CREATE TABLE statements; constraints are comments, for Spark's tables enforce none."""
    out = [f"-- Model {model.prefix} <{model.iri}>"]
    for n in model.concrete():
        columns = [f"  `{p.name}` {spark_type(p.type).simpleString()}{' NOT NULL' if p.required or p.name in n.key else ''}" for p in n.props]
        out.append(f"CREATE TABLE `{n.name}` (\n" + ",\n".join(columns) + f"\n) USING parquet COMMENT {quoted('key: ' + ', '.join(n.key))};")
    for e, s, t, name in edge_tables(model):
        edge, ends = model.edge(e), endpoint_columns(model, model.edge(e), s, t)
        columns = [f"  `{c}` {spark_type(model.node(x).prop(k).type).simpleString()} NOT NULL" for x, cs in zip((s, t), ends, strict=True) for k, c in zip(model.node(x).key, cs, strict=True)]
        columns += [f"  `{p.name}` {spark_type(p.type).simpleString()}{' NOT NULL' if p.required else ''}" for p in edge.props]
        out.append(f"CREATE TABLE `{name}` (\n" + ",\n".join(columns) + f"\n) USING parquet COMMENT {quoted(f'{s} to {t}')};")
    return "\n\n".join(out) + "\n"


def duckdb_type(t: ValueType) -> str:
    match t.kind:
        case "list":
            return f"{duckdb_type(t.item)}[]"
        case "array":
            return f"{duckdb_type(t.item)}[{t.size}]"
        case "map":
            return f"MAP({duckdb_type(t.parts[0][1])}, {duckdb_type(t.parts[1][1])})"
        case "struct" | "union":
            return f"{t.kind.upper()}({', '.join(f'{n} {duckdb_type(x)}' for n, x in t.parts)})"
    return DUCKDB[t.name] + (f"({t.precision},{t.scale})" if t.precision is not None else "")


def _check(model: Model, p: Property) -> list[str]:
    if p.is_list:
        return []
    out = []
    if p.scalar not in TEMPORAL:
        out += [f"{p.name} {op} {v:g}" for op, v in ((">=", p.min), ("<=", p.max)) if v is not None]
    out += [f"length({p.name}) {op} {v}" for op, v in ((">=", p.min_length), ("<=", p.max_length)) if v is not None]
    if p.pattern is not None:
        out.append(f"regexp_matches({p.name}, {quoted(p.pattern)})")
    return out


def _assertion(c: Constraint) -> str | None:
    a = c.props
    match c.kind:
        case "lessThan" | "lessThanOrEquals":
            return f"{a[0]} {'<' if c.kind == 'lessThan' else '<='} {a[1]}"
        case "equals":
            return f"{a[0]} IS NOT DISTINCT FROM {a[1]}"
        case "disjoint":
            return f"{a[0]} <> {a[1]}"
        case "atLeastOne":
            return " OR ".join(f"{p} IS NOT NULL" for p in a)
        case "exactlyOne":
            return " + ".join(f"({p} IS NOT NULL)::INTEGER" for p in a) + " = 1"
    return None


def _column(model: Model, p: Property, key: tuple[str, ...]) -> str:
    kind = duckdb_type(p.type).replace("VARCHAR", p.enum, 1) if p.enum else duckdb_type(p.type)
    rules = (" NOT NULL" if p.required or p.name in key else "") + (" UNIQUE" if p.unique and (p.name,) != key else "")
    return f"  {p.name} {kind}{rules}" + "".join(f" CHECK ({c})" for c in _check(model, p))


def sqlpgq(model: Model) -> str:
    """DuckDB tables with their constraints, and the property graph that maps them."""
    out = [f"-- Model {model.prefix} <{model.iri}>"]
    out += [f"CREATE TYPE {x.name} AS ENUM ({', '.join(map(quoted, x.values))});" for x in model.enums]
    for n in model.concrete():
        lines = [_column(model, p, n.key) for p in n.props]
        if n.key:
            lines.append(f"  PRIMARY KEY ({', '.join(n.key)})")
        lines += [f"  CONSTRAINT {c.name} CHECK ({rule})" for c in n.constraints if (rule := _assertion(c))]
        out.append(f"CREATE TABLE IF NOT EXISTS {n.name} (\n" + ",\n".join(lines) + "\n);")
    maps = []
    for e, s, t, name in edge_tables(model):
        edge, (src, dst) = model.edge(e), endpoint_columns(model, model.edge(e), s, t)
        lines = [f"  {c} {duckdb_type(model.node(x).prop(k).type)} NOT NULL" for x, cs in ((s, src), (t, dst)) for k, c in zip(model.node(x).key, cs, strict=True)]
        lines += [_column(model, p, ()) for p in edge.props]
        lines += [f"  FOREIGN KEY ({', '.join(cs)}) REFERENCES {x} ({', '.join(model.node(x).key)})" for x, cs in ((s, src), (t, dst))]
        lines += [f"  UNIQUE ({', '.join(cs)})" for bound, cs in ((edge.targets, src), (edge.sources, dst)) if bound.most == 1]
        out.append(f"CREATE TABLE IF NOT EXISTS {name} (\n" + ",\n".join(lines) + "\n);")
        ends = [f"{word} KEY ({', '.join(cs)}) REFERENCES {x} ({', '.join(model.node(x).key)})" for word, x, cs in (("SOURCE", s, src), ("DESTINATION", t, dst))]
        maps.append(f"    {name} {' '.join(ends)} LABEL {name}")
    vertices = ",\n".join(f"    {n.name} LABEL {n.name}" for n in model.concrete())
    out.append(f"CREATE PROPERTY GRAPH {model.prefix or 'graph'}\n  VERTEX TABLES (\n{vertices}\n  )" + (f"\n  EDGE TABLES (\n{',\n'.join(maps)}\n  )" if maps else "") + ";")
    return "\n\n".join(out) + "\n"
