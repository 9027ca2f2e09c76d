"""SQL dumps: CREATE TABLE, ALTER TABLE, CREATE TYPE ... AS ENUM and unique indexes, read as a graph model.

Tables become node types. A foreign key becomes an edge; a table whose primary key is just its two foreign keys becomes
an edge itself, its other columns that edge's properties."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..functions.types import ValueType
from ..plans.model import MANY, Bound, Diagnostic, EdgeType, Enum, Model, NodeType, Property
from ..plans.resolve import flatten

#: SQL types by the scalar they mean (fixed values).
SQL_TYPES = {
    "int16": ("smallint", "int2", "smallserial", "serial2"),
    "int32": ("integer", "int", "int4", "serial", "serial4"),
    "int": ("bigint", "int8", "bigserial", "serial8"),
    "float32": ("real", "float4"),
    "float": ("double precision", "float8"),
    "decimal": ("numeric", "decimal"),
    "boolean": ("boolean", "bool"),
    "string": ("text", "character varying", "varchar", "character", "char", "bpchar", "citext"),
    "uuid": ("uuid",),
    "blob": ("bytea",),
    "json": ("json", "jsonb"),
    "date": ("date",),
    "datetime": ("timestamp", "timestamp without time zone"),
    "zoneddatetime": ("timestamptz", "timestamp with time zone"),
    "duration": ("interval",),
}
BY_SQL = {s: name for name, all_ in SQL_TYPES.items() for s in all_}
LENGTHS = {"character varying", "varchar", "character", "char", "bpchar"}
_TOKEN = re.compile(r"""\s+|--[^\n]*|/\*.*?\*/|(\$\w*\$).*?\1|'(?:[^']|'')*'|"(?:[^"]|"")*"|\w+|.""", re.S)


def statements(text: str) -> list[list[str]]:
    """Token lists of the statements, without comments; rows of COPY blocks are passed over."""
    text = re.sub(r"(?ims)^copy\s[^;]*from\s+stdin;.*?^\\\.\s*$", "", text)
    out: list[list[str]] = [[]]
    for m in _TOKEN.finditer(text):
        t = m[0]
        if t.isspace() or t.startswith(("--", "/*")):
            continue
        if t == ";":
            out.append([])
        else:
            out[-1].append(t)
    return [s for s in out if s]


@dataclass
class ForeignKey:
    columns: list[str]
    table: str
    targets: list[str]
    name: str | None = None


@dataclass
class Table:
    name: str
    columns: dict[str, dict] = field(default_factory=dict)
    key: list[str] = field(default_factory=list)
    unique: list[list[str]] = field(default_factory=list)
    foreign: list[ForeignKey] = field(default_factory=list)


class _Cursor:
    def __init__(self, tokens: list[str]) -> None:
        self.tokens, self.at = tokens, 0

    def peek(self, *words: str) -> bool:
        return [t.lower() for t in self.tokens[self.at : self.at + len(words)]] == list(words)

    def take(self, *words: str) -> bool:
        if self.peek(*words):
            self.at += len(words)
            return True
        return False

    def next(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1] if self.at <= len(self.tokens) else ""

    def name(self) -> str:
        """A name, its schema in front dropped."""
        found = self.next()
        while self.take("."):
            found = self.next()
        return found[1:-1].replace('""', '"') if found.startswith('"') else found.lower()

    def group(self) -> list[str]:
        """The tokens inside the bracket that starts here."""
        if not self.take("("):
            return []
        depth, start = 1, self.at
        while depth and self.at < len(self.tokens):
            t = self.next()
            depth += (t == "(") - (t == ")")
        return self.tokens[start : self.at - 1]

    def names(self) -> list[str]:
        inner, out = _Cursor(self.group()), []
        while inner.at < len(inner.tokens):
            if not inner.take(","):
                out.append(inner.name())
        return out


def _parts(tokens: list[str]) -> list[list[str]]:
    out, depth = [[]], 0
    for t in tokens:
        depth += (t == "(") - (t == ")")
        if t == "," and not depth:
            out.append([])
        else:
            out[-1].append(t)
    return [p for p in out if p]


def _table_rule(c: _Cursor, table: Table) -> bool:
    """A table constraint, or False."""
    name = c.name() if c.take("constraint") else None
    if c.take("primary", "key"):
        table.key = c.names()
    elif c.take("unique"):
        table.unique.append(c.names())
    elif c.take("foreign", "key"):
        columns = c.names()
        c.take("references")
        table.foreign.append(ForeignKey(columns, c.name(), c.names(), name))
    elif name is None and not c.peek("check") and not c.peek("exclude"):
        return False
    return True


def _column(tokens: list[str], table: Table) -> None:
    c = _Cursor(tokens)
    if _table_rule(c, table):
        return
    name, kind = c.name(), []
    stops = {"not", "null", "primary", "unique", "references", "default", "check", "constraint", "generated", "collate"}
    while c.at < len(c.tokens) and c.tokens[c.at].lower() not in stops:
        kind.append(c.next())
    column = table.columns[name] = {"type": kind, "required": False}
    while c.at < len(c.tokens):
        rule = c.name() if c.take("constraint") else None
        if c.take("not", "null"):
            column["required"] = True
        elif c.take("primary", "key"):
            table.key, column["required"] = [name], True
        elif c.take("unique"):
            table.unique.append([name])
        elif c.take("references"):
            table.foreign.append(ForeignKey([name], c.name(), c.names() if c.peek("(") else [], rule))
        else:
            c.next()


def read_catalog(text: str) -> tuple[dict[str, Table], dict[str, list[str]], dict[str, int]]:
    """(tables, enums, how many statements of each other kind were passed over)."""
    tables: dict[str, Table] = {}
    enums: dict[str, list[str]] = {}
    skipped: dict[str, int] = {}
    for tokens in statements(text):
        c = _Cursor(tokens)
        if c.take("create", "table") or c.take("create", "unlogged", "table"):
            c.take("if", "not", "exists")
            table = Table(c.name())
            for part in _parts(c.group()):
                _column(part, table)
            tables[table.name] = table
        elif c.take("create", "type"):
            name = c.name()
            if c.take("as", "enum"):
                enums[name] = [t[1:-1].replace("''", "'") for t in c.group() if t.startswith("'")]
        elif c.take("alter", "table"):
            c.take("only")
            c.take("if", "exists")
            c.take("only")
            table = tables.get(c.name())
            for part in _parts(tokens[c.at :]) if table else []:
                p = _Cursor(part)
                if p.take("add"):
                    p.take("column")
                    _column(p.tokens[p.at :], table)
                elif p.take("alter") and (p.take("column") or True):
                    column = table.columns.get(p.name())
                    if column and p.take("set", "not", "null"):
                        column["required"] = True
        elif c.take("create", "unique", "index"):
            while c.at < len(tokens) and not c.take("on"):
                c.next()
            c.take("only")
            table = tables.get(c.name())
            if c.take("using"):
                c.next()
            columns = c.names()
            if table and not c.peek("where") and all(x in table.columns for x in columns):
                table.unique.append(columns)
        else:
            kind = " ".join(tokens[:2]).upper()
            skipped[kind] = skipped.get(kind, 0) + 1
    return tables, enums, skipped


def pascal(name: str) -> str:
    return "".join(w[:1].upper() + w[1:] for w in re.split(r"[^A-Za-z0-9]+", name) if w) or name


def upper_snake(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9]+", "_", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)).upper()


def _edge_name(fk: ForeignKey, taken: set[str]) -> str:
    base = upper_snake(fk.name) if fk.name else upper_snake(re.sub(r"_(id|fk)$", "", fk.columns[0], flags=re.I))
    name, n = base, 2
    while name in taken:
        name, n = f"{base}_{n}", n + 1
    taken.add(name)
    return name


def column_property(name: str, tokens: list[str], enums: dict[str, list[str]], required: bool, unique: bool, said: list[Diagnostic], where: str) -> Property:
    written = " ".join(t.lower() for t in tokens)
    many = "[" in written
    m = re.fullmatch(r"(.*?)(?:\s*\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\)\s*(.*?))?", re.sub(r"\s*\[.*", "", written))
    base, first, second = " ".join(f"{m[1]} {m[4] or ''}".split()), m[2], m[3]
    base = base.rpartition(". ")[2]
    enum = base.strip('"') if base.strip('"') in enums else None
    scalar = "string" if enum else BY_SQL.get(base)
    if scalar is None:
        said.append(Diagnostic("info", "import-unknown-type", f"{where}.{name} has the type '{written}', read as string.", f"{where}.{name}"))
        scalar = "string"
    if "serial" in base:
        said.append(Diagnostic("info", "import-sequence", f"{where}.{name} takes its values from a sequence, which a model can't say.", f"{where}.{name}"))
    kind = ValueType("scalar", scalar, int(first), int(second or 0)) if scalar == "decimal" and first else ValueType("scalar", scalar)
    if many:
        kind = ValueType("list", parts=(("", kind),))
    return Property(name, kind, enum=pascal(enum) if enum else None, max_length=int(first) if base in LENGTHS and first else None, required=required, unique=unique)


def import_sql(text: str, prefix: str = "sql", iri: str = "https://example.org/sql#") -> tuple[Model, list[Diagnostic]]:
    tables, enums, skipped = read_catalog(text)
    said = [Diagnostic("info", "import-skipped", f"{n} statements of kind {k} were passed over.", k) for k, n in sorted(skipped.items())]
    nodes, edges, taken = [], [], set()
    joins = {t.name for t in tables.values() if len(t.foreign) == 2 == len(t.key) and all(len(f.columns) == 1 for f in t.foreign) and {f.columns[0] for f in t.foreign} == set(t.key)}
    for t in tables.values():
        single = {f.columns[0] for f in t.foreign if len(f.columns) == 1}
        uniques = {u[0] for u in t.unique if len(u) == 1}
        prop = lambda c, t=t, uniques=uniques: column_property(c, t.columns[c]["type"], enums, t.columns[c]["required"] or c in t.key, c in uniques and [c] != t.key, said, t.name)
        if t.name in joins:
            a, b = t.foreign
            taken.add(upper_snake(t.name))
            edges.append(EdgeType(upper_snake(t.name), pascal(a.table), pascal(b.table), props=tuple(prop(c) for c in t.columns if c not in single)))
            continue
        kept = [c for c in t.columns if c not in single or c in t.key]
        nodes.append(NodeType(pascal(t.name), key=tuple(t.key), props=tuple(map(prop, kept))))
        for u in t.unique:
            if len(u) > 1:
                said.append(Diagnostic("info", "import-composite-unique", f"{t.name} ({', '.join(u)}) is unique together, which a model can't say.", t.name))
        for f in t.foreign:
            if f.table not in tables:
                said.append(Diagnostic("warning", "import-unknown-table", f"{t.name} refers to the unknown table {f.table}.", t.name))
                continue
            required = all(t.columns[c]["required"] or c in t.key for c in f.columns)
            unique = f.columns in t.unique or f.columns == t.key
            edges.append(EdgeType(_edge_name(f, taken), pascal(t.name), pascal(f.table), sources=Bound(0, 1) if unique else MANY, targets=Bound(int(required), 1)))
    model = Model(prefix, iri, nodes=tuple(nodes), edges=tuple(edges), enums=tuple(Enum(pascal(n), tuple(v)) for n, v in enums.items()))
    return flatten(model, said), said


def detect_format(name: str, text: str) -> str | None:
    """The format of an import: by extension, then by content."""
    by_extension = {".sql": "sql", ".ttl": "turtle", ".cypher": "ladybug", ".yaml": "model", ".yml": "model", ".lock": "lockfile", ".json": "lockfile", ".md": "notes"}
    for extension, found in by_extension.items():
        if name.lower().endswith(extension):
            return found
    if re.search(r"(?im)^\s*create\s+node\s+table", text):
        return "ladybug"
    if re.search(r"(?im)^\s*create\s+(unlogged\s+)?table", text):
        return "sql"
    if re.search(r"(?im)^\s*(@prefix|prefix\s+\S*:)", text):
        return "turtle"
    return "model" if re.search(r"(?m)^(nodes|namespace):", text) else None


