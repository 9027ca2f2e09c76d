"""Migrations: the data of one model revision rewritten as the next one has it, never in place."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.types import spark_type
from ..plans.diff import Change, at_least, diff_models
from ..plans.model import Diagnostic, EdgeType, Model, NodeType, Property
from .audit import degrees, outside, plan_audit, value_checks
from .graph import PropertyGraph, endpoint_columns


@dataclass(frozen=True)
class Step:
    """One rewrite: kind, the label or edge type that it touches, and names by kind."""

    kind: str
    on: str
    old: str = ""
    new: str = ""
    keep: tuple[str, ...] = ()


def data_steps(before: Model, after: Model) -> list[Step]:
    """Rewrites in their fixed order: deletions, new labels, ancestors' labels, properties, edges' properties, edge types."""
    now, then = {n.id: n for n in after.nodes}, {n.id: n for n in before.nodes}
    edges_now, edges_then = {e.id: e for e in after.edges}, {e.id: e for e in before.edges}
    lives = lambda n: n.id in now and not now[n.id].abstract
    steps = [Step("delete-edges", e.name) for e in before.edges if e.id not in edges_now]
    steps += [Step("delete-nodes", n.name, keep=tuple(d.name for d in before.descendants(n.name) if lives(d))) for n in before.concrete() if not lives(n)]
    steps += [Step("relabel", n.name, n.name, now[n.id].name) for n in before.nodes if n.id in now and now[n.id].name != n.name]
    line = lambda m, n: [x.id for a in n.ancestors if (x := m.node(a))]
    for n in after.concrete():
        if n.id in then:
            had, has = line(before, then[n.id]), line(after, n)
            steps += [Step("add-label", n.name, new=now[i].name) for i in has if i not in had]
            steps += [Step("remove-label", n.name, old=(now.get(i) or then[i]).name) for i in had if i not in has]

    def declared(m: Model) -> dict[str, tuple[str, list[str]]]:
        own = {p.id: (p.name, [n.name]) for n in m.nodes for p in n.props if not p.inherited_from and not p.mixin}
        return own | {p.id: (p.name, [n.name for n in m.nodes if x.name in n.mixins]) for x in m.mixins for p in x.props}

    old_props = declared(before)
    for i, (name, labels) in declared(after).items():
        if i in old_props and old_props[i][0] != name:
            steps += [Step("rename-node-property", label, old_props[i][0], name) for label in labels]
    for e in after.edges:
        if e.id in edges_then:
            old = {p.id: p.name for p in edges_then[e.id].props}
            steps += [Step("rename-edge-property", edges_then[e.id].name, old[p.id], p.name) for p in e.props if p.id in old and old[p.id] != p.name]
    steps += [Step("retype-edges", edges_then[e.id].name, edges_then[e.id].name, e.name) for e in after.edges if e.id in edges_then and edges_then[e.id].name != e.name]
    return steps


def _renamed(old: str, new: str):
    return F.transform("labels", lambda x: F.when(x == old, new).otherwise(x))


def apply_steps(vertices: DataFrame, edges: DataFrame, steps: list[Step]) -> tuple[DataFrame, DataFrame]:
    """The steps on labelled elements: vertices (id, labels, props map) and edges (src, dst, type, props map)."""
    has = lambda label: F.array_contains("labels", label)

    def moved(old: str, new: str):
        kept = F.map_filter("props", lambda k, _: k != old)
        return F.when(F.element_at("props", F.lit(old)).isNotNull(), F.map_concat(F.map_filter(kept, lambda k, _: k != new), F.create_map(F.lit(new), F.element_at("props", F.lit(old))))).otherwise(F.col("props"))

    for s in steps:
        match s.kind:
            case "delete-edges":
                edges = edges.where(F.col("type") != s.on)
            case "delete-nodes":
                gone = vertices.where(reduce(lambda a, b: a & ~has(b), s.keep, has(s.on)))
                vertices = vertices.join(gone.select("id"), "id", "left_anti").select(vertices.columns)
                for end in ("src", "dst"):
                    edges = edges.join(gone.select(F.col("id").alias(end)), end, "left_anti").select(edges.columns)
            case "relabel":
                vertices = vertices.withColumn("labels", _renamed(s.old, s.new))
            case "add-label":
                vertices = vertices.withColumn("labels", F.when(has(s.on), F.array_union("labels", F.array(F.lit(s.new)))).otherwise(F.col("labels")))
            case "remove-label":
                vertices = vertices.withColumn("labels", F.when(has(s.on), F.array_remove("labels", s.old)).otherwise(F.col("labels")))
            case "rename-node-property":
                vertices = vertices.withColumn("props", F.when(has(s.on), moved(s.old, s.new)).otherwise(F.col("props")))
            case "rename-edge-property":
                edges = edges.withColumn("props", F.when(F.col("type") == s.on, moved(s.old, s.new)).otherwise(F.col("props")))
            case "retype-edges":
                edges = edges.withColumn("type", F.when(F.col("type") == s.old, s.new).otherwise(F.col("type")))
    return vertices, edges


def _identity(p: Property) -> str:
    return p.source_id or p.id


def _columns(df: DataFrame, old: tuple[Property, ...], new: tuple[Property, ...]) -> list:
    """The new revision's columns from the old table: by property identity, cast where the type changed, null where it is new."""
    had = {_identity(p): p for p in old}
    out = []
    for p in new:
        was, kind = had.get(_identity(p)), spark_type(p.type)
        if was is None or was.name not in df.columns:
            out.append(F.lit(None).cast(kind).alias(p.name))
        else:
            out.append((F.col(f"`{was.name}`") if was.type == p.type else F.col(f"`{was.name}`").try_cast(kind)).alias(p.name))
    return out


def _key_ids(n: NodeType) -> list[str]:
    """The identities of a key's properties: a renamed key property is no other key."""
    return [_identity(n.prop(k)) for k in n.key]


def key_translation(graph: PropertyGraph, old: NodeType, new: NodeType, had: list[str], has: list[str]) -> DataFrame | None:
    """The distinct pairs of old and new key values of a type's rows, under the given column names; rows without a whole new key are left out.

    None if the type has no table to read them from."""
    if old.name not in graph.vertices:
        return None
    df = graph.vertices[old.name]
    values = _columns(df, old.props, tuple(new.prop(k) for k in new.key))
    named = [v.alias(n) for v, n in zip(values, has, strict=True)]
    return df.select(*(F.col(f"`{k}`").alias(c) for k, c in zip(old.key, had, strict=True)), *named).dropna(subset=has).distinct()


@dataclass(frozen=True)
class _End:
    """One end of an edge table: its type in both revisions, its key columns now and then."""

    old: NodeType
    new: NodeType
    had: list[str]
    has: list[str]

    @property
    def direct(self) -> bool:
        """Whether the new key can be read off the old one."""
        return set(_key_ids(self.new)) <= set(_key_ids(self.old))

    def columns(self) -> list:
        """The new key's columns from the edge table's own, cast where the type changed."""
        own = dict(zip(_key_ids(self.old), zip(self.old.key, self.had, strict=True), strict=True))
        out = []
        for k, i, name in zip(self.new.key, _key_ids(self.new), self.has, strict=True):
            was, column = own[i]
            kind, same = spark_type(self.new.prop(k).type), self.old.prop(was).type == self.new.prop(k).type
            out.append((F.col(f"`{column}`") if same else F.col(f"`{column}`").try_cast(kind)).alias(name))
        return out


def _rehung(graph: PropertyGraph, old: EdgeType, along: dict[str, str]) -> dict[tuple[str, str, str], DataFrame]:
    """The tables of an edge with its ends moved along other edges: `source` and `target` name the edge that leads from the old end to the new one, in either direction.

    Rows that become alike are one edge."""
    model, tables = graph.model, {k: graph.edges[k] for k in graph.tables_of(old.name)}
    for end, name in along.items():
        moved: dict[tuple[str, str, str], list[DataFrame]] = {}
        for key, df in tables.items():
            at, sides = (1 if end == "source" else 2), endpoint_columns(model, old, key[1], key[2])
            for link in graph.tables_of(name):
                for near, far in ((1, 2), (2, 1)):
                    if link[near] != key[at]:
                        continue
                    ends = endpoint_columns(model, model.edge(name), link[1], link[2])
                    to = (key[0], link[far], key[2]) if at == 1 else (key[0], key[1], link[far])
                    now = endpoint_columns(model, old, to[1], to[2])
                    step = graph.edges[link].select(*(F.col(f"`{c}`").alias(f"__o_{i}") for i, c in enumerate(ends[near - 1])), *(F.col(f"`{c}`").alias(f"__n_{i}") for i, c in enumerate(ends[far - 1]))).distinct()
                    kept = [F.col(f"`{c}`").alias(n) for c, n in zip(sides[2 - at], now[2 - at], strict=True)]
                    own = df.withColumnsRenamed({c: f"__o_{i}" for i, c in enumerate(sides[at - 1])})
                    joined = own.join(step, [f"__o_{i}" for i in range(len(sides[at - 1]))])
                    props = [c for c in df.columns if c not in (*sides[0], *sides[1])]
                    moved.setdefault(to, []).append(joined.select(*(F.col(f"__n_{i}").alias(n) for i, n in enumerate(now[at - 1])), *kept, *(f"`{p}`" for p in props)))
        tables = {k: reduce(DataFrame.unionByName, v).distinct() for k, v in moved.items()}
    return tables


@dataclass(frozen=True)
class _Carried:
    """An edge table of the older revision and what becomes of it; `to` is None where the new revision has no place for it."""

    label: str
    df: DataFrame
    old: EdgeType
    new: EdgeType | None = None
    to: tuple[str, str, str] | None = None
    ends: tuple[_End, ...] = ()


def _edge_plan(graph: PropertyGraph, after: Model, along: dict[str, dict[str, str]]) -> list[_Carried]:
    """Every edge table whose edge the new revision still has. along: for an edge's new name, the edges along which its ends move."""
    before, now = graph.model, {n.id: n for n in after.nodes}
    out = []
    for e in after.edges:
        old = next((x for x in before.edges if x.id == e.id), None)
        if old is None:
            continue
        tables = _rehung(graph, old, along[e.name]) if e.name in along else {k: graph.edges[k] for k in graph.tables_of(old.name)}
        pairs = {(s.id, t.id): (s, t) for s in after.leaves(e.source) for t in after.leaves(e.target)}
        for (_, s0, t0), df in tables.items():
            a, b = before.node(s0), before.node(t0)
            label = f"{old.name} {s0}->{t0}"
            if (a.id, b.id) not in pairs:
                # an end that the new revision deletes takes its edges along: that change is told by the diff
                if all(x.id in now and not now[x.id].abstract for x in (a, b)):
                    out.append(_Carried(label, df, old))
                continue
            s, t = pairs[a.id, b.id]
            had, has = endpoint_columns(before, old, s0, t0), endpoint_columns(after, e, s.name, t.name)
            out.append(_Carried(label, df, old, e, (e.name, s.name, t.name), (_End(a, s, had[0], has[0]), _End(b, t, had[1], has[1]))))
    return out


def _carry(graph: PropertyGraph, c: _Carried) -> DataFrame | None:
    """The edge table under the new keys. An edge of a key that stood for several rows leads to each of them, as it did in a match."""
    df, properties = c.df, _columns(c.df, c.old.props, c.new.props)
    marks = {f"__p_{i}": p for i, p in enumerate(properties)}
    df = df.select("*", *(p.alias(m) for m, p in marks.items()))
    columns: list = []
    for side, end in enumerate(c.ends):
        if end.direct:
            columns += end.columns()
            continue
        had, has = [f"__o{side}_{k}" for k in end.old.key], [f"__n{side}_{k}" for k in end.new.key]
        table = key_translation(graph, end.old, end.new, had, has)
        if table is None:
            return None
        df = df.withColumnsRenamed(dict(zip(end.had, had, strict=True))).join(table, had)
        columns += [F.col(f"`{n}`").alias(c) for n, c in zip(has, end.has, strict=True)]
    out = df.select(*columns, *(F.col(m).alias(p.name) for m, p in zip(marks, c.new.props, strict=True)))
    return out.dropna(subset=[n for end in c.ends for n in end.has])


def migrate_graph(graph: PropertyGraph, after: Model, along: dict[str, dict[str, str]] | None = None) -> PropertyGraph:
    """The graph's tables as the new revision lays them out: types and properties are followed by id, all else is dropped.

    Where a type's key changed, both ends of its edges are translated by a join with the rows' old and new keys, unless the new key can be
    read off the old one. along moves ends that the new revision hangs elsewhere: {"SUPPLIED_BY": {"source": "OF_PART"}} takes each source
    to what OF_PART connects it with. What can't be carried is told by `uncarried`, which `plan_migration` refuses."""
    before = graph.model
    was: dict[str, NodeType] = {n.id: n for n in before.nodes}
    vertices = {n.name: graph.vertices[was[n.id].name].select(*_columns(graph.vertices[was[n.id].name], was[n.id].props, n.props)) for n in after.concrete() if n.id in was and was[n.id].name in graph.vertices}
    edges = {c.to: df for c in _edge_plan(graph, after, along or {}) if c.to and (df := _carry(graph, c)) is not None}
    return PropertyGraph(after, vertices, edges)


def uncarried(graph: PropertyGraph, after: Model, along: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """(object, reason, rows) of what a migration to the new revision can't carry as it is; rows may be 0.

    key-null and key-repeated: rows of a type whose new key is not whole, or that share it with another row. no-vertex: edges whose end
    finds no row with a new key. key-ambiguous: edges whose old key stands for rows with different new keys. key-cast: edges whose key is lost by a change of type.
    endpoints: edges between types that the new revision doesn't connect."""
    was, parts = {n.id: n for n in graph.model.nodes}, []
    spark = next(iter((graph.vertices | graph.edges).values())).sparkSession

    def say(counted: DataFrame, label: str, *reasons: str) -> None:
        parts.append(counted.select(F.inline(F.array(*(F.struct(F.lit(label).alias("object"), F.lit(r).alias("reason"), F.coalesce(F.col(f"r{i}"), F.lit(0)).cast("long").alias("rows")) for i, r in enumerate(reasons))))))

    for n in after.concrete():
        old = was.get(n.id)
        if old is None or old.name not in graph.vertices or not n.key or (_key_ids(old) == _key_ids(n) and all(old.prop(a).type == n.prop(b).type for a, b in zip(old.key, n.key, strict=True))):
            continue
        df = graph.vertices[old.name]
        keys = df.select(*(c.alias(f"k{i}") for i, c in enumerate(_columns(df, old.props, tuple(n.prop(k) for k in n.key)))))
        whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in keys.columns])
        say(keys.agg(F.count_if(~whole).alias("r0")), f"node {n.name}", "key-null")
        say(keys.where(whole).groupBy(*keys.columns).agg(F.count("*").alias("n")).where("n > 1").agg(F.sum("n").alias("r0")), f"node {n.name}", "key-repeated")
    for c in _edge_plan(graph, after, along or {}):
        label = f"edge {c.label}"
        if c.to is None:
            say(c.df.agg(F.count("*").alias("r0")), label, "endpoints")
            continue
        for end in c.ends:
            if end.direct:
                if any(end.old.prop(a).type != end.new.prop(b).type for a, i in zip(end.old.key, _key_ids(end.old), strict=True) for b, j in zip(end.new.key, _key_ids(end.new), strict=True) if i == j):
                    lost = reduce(lambda a, b: a | b, [F.col(f"`{n}`").isNull() for n in end.has])
                    say(c.df.select(*end.columns()).agg(F.count_if(lost).alias("r0")), f"{label} at {end.old.name}", "key-cast")
                continue
            table = key_translation(graph, end.old, end.new, end.had, [f"__n_{k}" for k in end.new.key])
            if table is None:
                say(c.df.agg(F.count("*").alias("r0")), f"{label} at {end.old.name}", "no-vertex")
                continue
            meant = table.groupBy(*end.had).agg(F.count("*").alias("__n"))
            joined = c.df.select(*end.had).join(meant, end.had, "left")
            say(joined.agg(F.count_if(F.col("__n").isNull()).alias("r0"), F.count_if(F.col("__n") > 1).alias("r1")), f"{label} at {end.old.name}", "no-vertex", "key-ambiguous")
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "object string, reason string, rows long")


def lost_values(graph: PropertyGraph, after: Model) -> DataFrame:
    """(table, column, lost): how many values that are there now a retyped column could not keep. One scan for each table."""
    out, spark = [], next(iter(graph.vertices.values())).sparkSession
    was = {n.id: n for n in graph.model.nodes}
    for n in after.concrete():
        old = was.get(n.id)
        if old is None or old.name not in graph.vertices:
            continue
        had = {_identity(p): p for p in old.props}
        changed = [(had[_identity(p)].name, p) for p in n.props if _identity(p) in had and had[_identity(p)].type != p.type]
        if changed:
            counted = graph.vertices[old.name].agg(*(F.count_if(F.col(f"`{o}`").isNotNull() & F.col(f"`{o}`").try_cast(spark_type(p.type)).isNull()).alias(f"l{i}") for i, (o, p) in enumerate(changed)))
            out.append(counted.select(F.inline(F.array(*(F.struct(F.lit(n.name).alias("table"), F.lit(p.name).alias("column"), F.col(f"l{i}").cast("long").alias("lost")) for i, (_, p) in enumerate(changed))))))
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], "table string, column string, lost long")


def populations(graph: PropertyGraph, wanted: set[tuple[str, str]]) -> DataFrame:
    """(element, name, n) of the wanted (element, name): rows of node and edge types, set values of properties named owner.property. Descendants count too; a table is scanned once, for the columns asked for."""
    model, parts = graph.model, []

    def counted(df: DataFrame, asked: list[tuple[str, str, str | None]]) -> None:
        if asked:
            row = df.agg(*((F.count(F.lit(1)) if c is None else F.count(F.col(f"`{c}`"))).alias(f"n{i}") for i, (_, _, c) in enumerate(asked)))
            parts.append(row.select(F.inline(F.array(*(F.struct(F.lit(e).alias("element"), F.lit(name).alias("name"), F.col(f"n{i}").alias("n")) for i, (e, name, _) in enumerate(asked))))))

    for name, df in graph.vertices.items():
        node = model.node(name)
        owners = (name, *node.ancestors)
        counted(df, [("node", o, None) for o in owners if ("node", o) in wanted] + [("property", f"{o}.{p.name}", p.name) for o in owners for p in node.props if ("property", f"{o}.{p.name}") in wanted and p.name in df.columns])
    for key, df in graph.edges.items():
        counted(df, [("edge", key[0], None)] * (("edge", key[0]) in wanted) + [("property", f"{key[0]}.{p.name}", p.name) for p in model.edge(key[0]).props if ("property", f"{key[0]}.{p.name}") in wanted and p.name in df.columns])
    spark = next(iter((graph.vertices | graph.edges).values())).sparkSession
    return reduce(DataFrame.unionByName, parts).groupBy("element", "name").agg(F.sum("n").alias("n")) if parts else spark.createDataFrame([], "element string, name string, n long")


def concerned(before: Model, change: Change) -> list[tuple[str, str]]:
    """The (element, name) of the older revision whose rows or values a change concerns."""
    if change.element in ("node", "edge"):
        return [(change.element, x.name) for x in (*before.nodes, *before.edges) if x.id == change.id]
    owned = [(o.name, p) for o in (*before.nodes, *before.edges) for p in o.props]
    if change.element == "enum":
        name = next((x.name for x in before.enums if x.id == change.id), None)
        return [("property", f"{o}.{p.name}") for o, p in owned if name and p.enum == name and not p.inherited_from]
    if change.element == "constraint":
        return [("node", x.name) for x in before.nodes if any(c.id == change.id for c in x.constraints)]
    if change.element == "mixin":
        name = next((x.name for x in before.mixins if x.id == change.id), None)
        return [("node", x.name) for x in before.nodes if name in x.mixins]
    if change.element == "property" and change.kind == "added":  # the rows that have no value yet
        owner = change.label.removeprefix("property ").rpartition(".")[0]
        return [("node" if before.node(owner) else "edge", owner)] if before.node(owner) or before.edge(owner) else []
    return [("property", f"{o}.{p.name}") for o, p in owned if p.id == change.id and not p.inherited_from]


#: The facet of a property that a change of its values' constraint names first in its detail.
FACETS = {"enum": "enum", "min": "min", "max": "max", "minLength": "min_length", "maxLength": "max_length", "pattern": "pattern"}


def _refused(model: Model, p: Property, facet: str, value) -> Column:
    """Whether one facet of a property, with a given value, refuses a row."""
    bare = replace(p, required=False, unique=False, **dict.fromkeys(FACETS.values()))
    found = [c.predicate() for c in value_checks(model, "", ("",), replace(bare, **{facet: value}), [], elements=True) if c.code in ("enum", "range", "length", "pattern")]
    # the range and size that a type has of itself are there without the facet too
    own = [c.predicate() for c in value_checks(model, "", ("",), bare, [], elements=True) if c.code in ("range", "length")]
    return F.coalesce(found[-1] if len(found) > len(own) else F.lit(False), F.lit(False))


def broken(graph: PropertyGraph, after: Model, changes: list[Change]) -> DataFrame:
    """(i, n): how many rows each change breaks, by its place in the list; changes that break none may be left out.

    Rows are looked at as the new revision lays them out. Broken are: rows without a value that became required, that share a value which became unique,
    that a new or tighter facet refuses and the old one did not, that have an enum value which is gone, whose value a new type can't hold; rows whose new key is
    not whole or shared; edges between types no longer connected; nodes whose number of edges the new bounds forbid and the old ones did not; rows that a new assertion finds.
    Removed elements break nothing here: all that they had is lost."""
    before, moved = graph.model, migrate_graph(graph, after)
    then = {p.id: p for o in (*before.nodes, *before.edges, *before.mixins) for p in o.props if not p.inherited_from and not p.mixin}
    tables: list[tuple[tuple[str, ...], DataFrame, tuple[Property, ...]]] = [((k,), df, after.node(k).props) for k, df in moved.vertices.items()] + [(k, df, after.edge(k[0]).props) for k, df in moved.edges.items()]
    tests: dict[tuple[str, ...], list[tuple[int, Column]]] = {}
    parts: list[DataFrame] = []

    def each(identity: str):
        return ((table, df, p) for table, df, props in tables for p in props if _identity(p) == identity)

    def total(df: DataFrame, i: int) -> None:
        parts.append(df.select(F.lit(i).alias("i"), F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n")))

    checks = {c.label: c for c in plan_audit(after).checks}
    for i, c in enumerate(changes):
        match c.element, c.kind:
            case "property", "added" | "required-changed":
                for table, _, p in each(c.id):
                    if p.required:
                        tests.setdefault(table, []).append((i, F.col(f"`{p.name}`").isNull()))
            case "property", "unique-changed":
                for _, df, p in each(c.id):
                    if p.unique:
                        total(df.where(F.col(f"`{p.name}`").isNotNull()).groupBy(f"`{p.name}`").agg(F.count("*").alias("k")).where("k > 1").agg(F.sum("k").alias("n")), i)
            case "property", "value-constraint-changed":
                facet = FACETS[c.detail.split(" ", 1)[0]]
                for table, _, p in each(c.id):
                    same = replace(then[c.id], name=p.name, type=p.type)
                    tests.setdefault(table, []).append((i, _refused(after, p, facet, getattr(p, facet)) & ~_refused(before, same, facet, getattr(same, facet))))
            case "enum", "enum-values-changed" if c.detail.startswith("values removed"):
                name = next(e.name for e in after.enums if e.id == c.id)
                gone = set(next(e.values for e in before.enums if e.id == c.id)) - set(after.enum(name).values)
                for table, _, props in tables:
                    for p in props:
                        if p.enum == name:
                            one = lambda v: v.isin(*sorted(gone))
                            tests.setdefault(table, []).append((i, F.exists(f"`{p.name}`", one) if p.is_list else one(F.col(f"`{p.name}`"))))
            case "constraint", "added" | "constraint-changed":
                node, rule = next((n, x) for n in after.nodes for x in n.constraints if x.id == c.id)
                check = checks.get(f"{node.name}.{rule.name}")
                if check and node.name in moved.vertices:
                    if check.predicate:
                        tests.setdefault((node.name,), []).append((i, check.predicate()))
                    else:
                        total(check.count(moved).select(F.col("violations").alias("n")), i)
            case "node", "openness-changed":
                name = next(n.name for n in after.nodes if n.id == c.id)
                if f"{name} closed" in checks and name in moved.vertices:
                    total(checks[f"{name} closed"].count(moved).select(F.col("violations").alias("n")), i)
            case "edge", "cardinality-changed":
                now, was = next(e for e in after.edges if e.id == c.id), next(e for e in before.edges if e.id == c.id)
                for new, old, nodes, outgoing in ((now.targets, was.targets, now.source, True), (now.sources, was.sources, now.target, False)):
                    forbids = lambda b: outside(F.col("n"), b.least, b.most)
                    for node in after.leaves(nodes):
                        if node.name in moved.vertices and new != old:
                            total(degrees(moved, now, node.name, outgoing).where(forbids(new) & ~forbids(old)).agg(F.count("*").alias("n")), i)
    for table, df, _ in tables:
        if table in tests:
            row = df.agg(*(F.count_if(test).alias(f"n{k}") for k, (_, test) in enumerate(tests[table])))
            parts.append(row.select(F.inline(F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"n{k}").cast("long").alias("n")) for k, (i, _) in enumerate(tests[table]))))))
    places = {f"node {after_name(after, c)}": i for i, c in enumerate(changes) if c.kind == "rekeyed"}
    ends = {next(e.name for e in before.edges if e.id == c.id): i for i, c in enumerate(changes) if c.kind == "endpoints-changed"}
    retyped = {(n.name, p.name): i for i, c in enumerate(changes) if c.kind == "retyped" for n in after.concrete() for p in n.props if _identity(p) == c.id}
    spark = next(iter((graph.vertices | graph.edges).values())).sparkSession
    number = lambda of, key: F.element_at(F.create_map(*(F.lit(x) for pair in of.items() for x in pair)), key)
    if places or ends:
        lost = uncarried(graph, after)
        if places:
            parts.append(lost.where(F.col("reason").isin("key-null", "key-repeated")).select(number(places, F.col("object")).alias("i"), F.col("rows").alias("n")).where("i IS NOT NULL"))
        if ends:
            parts.append(lost.where("reason = 'endpoints'").select(number(ends, F.split("object", " ")[1]).alias("i"), F.col("rows").alias("n")).where("i IS NOT NULL"))
    if retyped:
        parts.append(lost_values(graph, after).select(number({f"{a}.{b}": i for (a, b), i in retyped.items()}, F.concat_ws(".", "table", "column")).alias("i"), F.col("lost").alias("n")).where("i IS NOT NULL"))
    return reduce(DataFrame.unionByName, parts).groupBy("i").agg(F.sum("n").alias("n")) if parts else spark.createDataFrame([], "i int, n long")


def after_name(after: Model, c: Change) -> str:
    """The name in the new revision of the node that a change is about."""
    return next(n.name for n in after.nodes if n.id == c.id)


def change_impact(graph: PropertyGraph, after: Model) -> DataFrame:
    """(class, label, detail, affected, broken) of the changes to a next revision: how many rows, or set values of a property, each concerns now, and how many of them break or are lost."""
    changes = diff_models(graph.model, after)
    reach = [(i, *x) for i, c in enumerate(changes) for x in concerned(graph.model, c)]
    spark = next(iter((graph.vertices | graph.edges).values())).sparkSession
    gone = lambda c: c.kind == "removed" and c.element in ("node", "edge", "property") or c.detail == "became abstract"
    said = spark.createDataFrame([(i, c.change_class, c.label, c.detail, gone(c)) for i, c in enumerate(changes)], "i int, class string, label string, detail string, gone boolean")
    own = spark.createDataFrame(reach, "i int, element string, name string").join(populations(graph, {x[1:] for x in reach}), ["element", "name"]).groupBy("i").agg(F.sum("n").alias("n"))
    wrong = broken(graph, after, changes).withColumnRenamed("n", "b")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return said.join(own, "i", "left").join(wrong, "i", "left").select("class", "label", "detail", number(F.col("n")).alias("affected"), number(F.when(F.col("gone"), F.col("n")).otherwise(F.col("b"))).alias("broken"))


def step_impact(graph: PropertyGraph, after: Model) -> DataFrame:
    """(place, kind, on_, old, new, affected) of the data steps to a next revision: the rows, or the set values of a renamed property, that each rewrites."""
    steps = data_steps(graph.model, after)
    element = lambda s: ("property", f"{s.on}.{s.old}") if s.kind.startswith("rename-") else ("edge" if s.kind.endswith("edges") else "node", s.on)
    rows = [(i, s.kind, s.on, s.old, s.new, *element(s)) for i, s in enumerate(steps)]
    spark = next(iter((graph.vertices | graph.edges).values())).sparkSession
    said = spark.createDataFrame(rows, "place int, kind string, on_ string, old string, new string, element string, name string")
    return said.join(populations(graph, {r[5:] for r in rows}), ["element", "name"], "left").select("place", "kind", "on_", "old", "new", F.coalesce("n", F.lit(0)).cast("long").alias("affected"))


@dataclass
class MigrationPlan:
    changes: list[Change]
    steps: list[Step]
    diagnostics: list[Diagnostic] = field(default_factory=list)
    refused: bool = False
    lockfile: str | None = None


#: What each reason of `uncarried` means for its rows.
UNCARRIED = {
    "key-null": "rows have no whole key in the new revision", "key-repeated": "rows share their new key with others", "no-vertex": "edges lead to no row with a new key", "key-ambiguous": "edges have an old key that stands for several new ones",
    "key-cast": "edges lose their key to a change of type", "endpoints": "edges connect types that the new revision does not",
}


def _unchecked(before: Model, after: Model, changes: list[Change]) -> list[Diagnostic]:
    """Without data: keys that change, for their rows and edges can't be looked at, and edges none of whose pairs of types is left."""
    now, said = {n.id: n for n in after.nodes}, []
    for c in changes:
        if c.kind == "rekeyed":
            said.append(Diagnostic("error", "destructive-change", f"{c.label}: {c.detail}; whether its rows and edges can be carried must be counted on the graph", c.label))
        if c.kind == "endpoints-changed":
            old, new = next(e for e in before.edges if e.id == c.id), next(e for e in after.edges if e.id == c.id)
            pairs = {(s.id, t.id) for s in before.leaves(old.source) for t in before.leaves(old.target) if s.id in now and t.id in now}
            if pairs - {(s.id, t.id) for s in after.leaves(new.source) for t in after.leaves(new.target)}:
                said.append(Diagnostic("error", "destructive-change", f"{c.label}: {c.detail}, which leaves its edges between other types behind", c.label))
    return said


def plan_migration(before: Model, after: Model, revision: int, allow_destructive: bool = False, graph: PropertyGraph | None = None, along: dict[str, dict[str, str]] | None = None) -> MigrationPlan:
    """Changes and steps of a migration. It is refused if ids are not written, and, unless allowed, if a change would discard data.

    With a graph, casts, keys and endpoints are judged by the rows that they can't carry; without one every changed key and lost pair of endpoints is refused."""
    from ..sources.lockfile import ids_not_written, write_lockfile

    if wrong := ids_not_written(after):
        return MigrationPlan([], [], wrong, refused=True)
    changes = diff_models(before, after)
    if not changes:
        return MigrationPlan([], [], [Diagnostic("info", "no-changes", "The two revisions are the same.")])
    said = [Diagnostic("error", "destructive-change", f"{c.label}: {c.detail}", c.label) for c in changes if at_least(c.change_class, "destructive")]
    if graph is None:
        said += _unchecked(before, after, changes)
    else:
        said += [Diagnostic("error", "lossy-cast", f"{r.table}.{r.column}: {r.lost} values can't be kept", f"{r.table}.{r.column}") for r in lost_values(graph, after).where("lost > 0").collect()]  # a row for each retyped column
        said += [Diagnostic("error", "destructive-change", f"{r.object}: {r.rows} {UNCARRIED[r.reason]}", r.object) for r in uncarried(graph, after, along).where("rows > 0").collect()]  # a few rows for each changed type and edge
    if said and not allow_destructive:
        return MigrationPlan(changes, [], said, refused=True)
    return MigrationPlan(changes, data_steps(before, after), said, lockfile=write_lockfile(after, revision + 1))
