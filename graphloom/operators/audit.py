"""Audits: how many violations the data has of each declared constraint.

All checks that look at one row are fused into one aggregate for each table: one scan of the columns they need, whatever
their number. Uniqueness groups by the value and counts groups. Bounds of edges are counted by the edge's key first, so
that one shuffle of narrow partial counts meets the nodes' keys.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.types import UNSIGNED_MAX
from ..plans.model import Bound, Constraint, Diagnostic, EdgeType, Model, NodeType, Property
from .graph import PropertyGraph, Workspace, endpoint_columns

SCHEMA = "code string, label string, violations long"


@dataclass(frozen=True)
class Keyed:
    """A check that is decided key by key, from how many node rows and how many edges' ends have the key.

    repeats: keys with several rows; bound: keys of rows with too few or too many edges; dangling: edges at keys without a row.
    sides gives the (table, key columns, whether rows of nodes, whether null keys count) that a graph has for it."""

    kind: str
    sides: Callable[[PropertyGraph], list[tuple[tuple[str, ...], list[str], bool, bool]]]
    least: int | None = None
    most: int | None = None

    def violations(self, nodes, edges):
        """The violations of one key from its numbers, which may be columns or arrays; booleans are taken as 0 and 1."""
        if self.kind == "repeats":
            return nodes > 1
        if self.kind == "dangling":
            return (nodes == 0) * edges
        wrong = [x for x in (None if self.least is None else edges < self.least, None if self.most is None else edges > self.most) if x is not None]
        return (nodes > 0) & reduce(lambda a, b: a | b, wrong)


@dataclass(frozen=True)
class Check:
    """One question to the data. Row checks have a predicate on a row of `table`; others build their own count, and say how it goes by key if it does."""

    code: str
    label: str
    table: tuple[str, ...]
    severity: str = "violation"
    predicate: Callable[[], Column] | None = None
    count: Callable[[PropertyGraph], DataFrame] | None = None
    keyed: Keyed | None = None


@dataclass
class AuditPlan:
    model: Model
    checks: list[Check]
    diagnostics: list[Diagnostic] = field(default_factory=list)

    def only(self, *labels: str, code: str | None = None) -> AuditPlan:
        return AuditPlan(self.model, [c for c in self.checks if (not labels or c.label in labels) and (code is None or c.code == code)], self.diagnostics)

    def run(self, graph: PropertyGraph) -> DataFrame:
        """A row (code, label, violations) for each check whose tables are bound."""
        fused: dict[tuple[str, ...], list[Check]] = {}
        parts: list[DataFrame] = []
        for c in self.checks:
            if not bound(graph, c.table):
                continue
            if c.predicate is not None:
                fused.setdefault(c.table, []).append(c)
            else:
                parts.append(c.count(graph).select(F.lit(c.code).alias("code"), F.lit(c.label).alias("label"), F.col("violations").cast("long").alias("violations")))
        for table, checks in fused.items():
            counted = frame(graph, table).agg(*(F.count_if(c.predicate()).alias(f"v{i}") for i, c in enumerate(checks)))
            rows = F.array(*(F.struct(F.lit(c.code).alias("code"), F.lit(c.label).alias("label"), F.col(f"v{i}").cast("long").alias("violations")) for i, c in enumerate(checks)))
            parts.append(counted.select(F.inline(rows)))
        if not parts:
            any_table = next(iter((graph.vertices | graph.edges).values()))
            return any_table.sparkSession.createDataFrame([], SCHEMA)
        return reduce(DataFrame.unionByName, parts)

    def violating_rows(self, graph: PropertyGraph, label: str) -> DataFrame:
        """The rows that break a row check."""
        check = next(c for c in self.checks if c.label == label and c.predicate is not None)
        return frame(graph, check.table).where(check.predicate())

    def split(self, graph: PropertyGraph, node: str) -> tuple[DataFrame, DataFrame]:
        """(good, quarantined) rows of a node table by its row checks, and by its key: of rows with one whole key the first by all columns is good.

        The rows of repeated keys are written under the checkpoint folder until the Python process ends; the least of a key is found by one aggregate.
        Quarantined rows carry `_failed`, the labels of what they break. A null predicate counts as kept."""
        df, checks = graph.vertices[node], [c for c in self.checks if c.table == (node,) and c.predicate is not None and c.severity == "violation"]
        failed = F.array_compact(F.array(F.lit(None).cast("string"), *(F.when(F.coalesce(c.predicate(), F.lit(False)), c.label) for c in checks)))
        marked = df.withColumn("_failed", failed)
        key = self.model.node(node).key
        if key:
            # a row without a whole key repeats nothing and is not gathered with others
            whole = reduce(lambda a, b: a & b, [F.col(f"`{k}`").isNotNull() for k in key])
            label = F.lit(f"{node} key ({', '.join(key)})")
            own = [c for c in df.columns if c in self.model.schema(node).names and c not in key]
            keyed = marked.where(whole)
            counted = keyed.join(keyed.groupBy(*key).agg(F.count("*").alias("_n")), list(key))
            # rows of repeated keys are written once, so that the numbers that tell alike rows apart stay as they are
            row = F.struct(*(F.col(f"`{c}`") for c in own), F.monotonically_increasing_id())
            repeated = Workspace(df.sparkSession).put(counted.where("_n > 1").select(*marked.columns, row.alias("_row")), keep=True)
            least = repeated.groupBy(*key).agg(F.min("_row").alias("_least"))
            later = repeated.join(least, list(key)).withColumn("_failed", F.when(F.col("_row") > F.col("_least"), F.array_append("_failed", label)).otherwise(F.col("_failed")))
            marked = reduce(DataFrame.unionByName, [counted.where("_n = 1").select(marked.columns), later.select(marked.columns), marked.where(~whole)])
        return marked.where(F.size("_failed") == 0).drop("_failed"), marked.where(F.size("_failed") > 0)


def bound(graph: PropertyGraph, table: tuple[str, ...]) -> bool:
    return (table[0] in graph.vertices) if len(table) == 1 else (table in graph.edges)


def frame(graph: PropertyGraph, table: tuple[str, ...]) -> DataFrame:
    return graph.vertices[table[0]] if len(table) == 1 else graph.edges[table]


def _one(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("violations"))


def _duplicates(columns: list[str], table: tuple[str, ...]) -> Callable[[PropertyGraph], DataFrame]:
    """The number of values, not of rows, that occur more than once."""

    def count(graph: PropertyGraph) -> DataFrame:
        present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
        return _one(frame(graph, table).where(present).groupBy(*columns).agg(F.count("*").alias("_n")).where("_n > 1"))

    return count


def _repeats(columns: list[str], table: tuple[str, ...]) -> Keyed:
    return Keyed("repeats", lambda graph: [(table, columns, True, False)])


def outside(column: Column, least, most) -> Column:
    conditions = ([column < least] if least is not None else []) + ([column > most] if most is not None else [])
    return reduce(lambda a, b: a | b, conditions)


def span(least, most) -> str:
    return f"{'' if least is None else least}..{'' if most is None else most}"


#: Further checks by users: code -> function of (model, property's owner, property) to a Column or None.
EXTRA_CHECKS: dict[str, Callable[[Model, str, Property], Column | None]] = {}


def register_check(code: str, compile_: Callable[[Model, str, Property], Column | None]) -> None:
    """A check of values that stays in Catalyst: compile_ gives a predicate that is true for a violation, or None."""
    if code in EXTRA_CHECKS:
        raise ValueError(f"'{code}' is taken")
    EXTRA_CHECKS[code] = compile_


def value_checks(model: Model, owner: str, table: tuple[str, ...], p: Property, said: list[Diagnostic], elements: bool) -> list[Check]:
    out, name = [], f"{owner}.{p.name}"
    row = lambda code, label, make: out.append(Check(code, label, table, predicate=make))
    col = lambda: F.col(f"`{p.name}`")
    if p.required:
        row("required", f"{name} required", lambda: col().isNull())
    if p.unique:
        out.append(Check("unique", f"{name} unique", table, count=_duplicates([p.name], table), keyed=_repeats([p.name], table)))
    tests: list[tuple[str, str, Callable[[Column], Column]]] = []
    if p.enum and (values := model.enum(p.enum)):
        tests.append(("enum", f"{name} in enum {p.enum}", lambda c: ~c.isin(*values.values)))
    least, most = p.min, p.max
    if p.scalar in UNSIGNED_MAX and not p.is_list:  # Spark's wider signed type needs the range
        tests.append(("range", f"{name} as {p.scalar}", lambda c: outside(c, 0, UNSIGNED_MAX[p.scalar])))
    if least is not None or most is not None:
        if p.scalar in ("date", "datetime", "zoneddatetime", "duration"):
            said.append(Diagnostic("info", "audit-unsupported", f"Not checked: {name} has numeric bounds on {p.scalar}.", name))
        else:
            tests.append(("range", f"{name} in {span(least, most)}", lambda c: outside(c, least, most)))
    if p.min_length is not None or p.max_length is not None:
        tests.append(("length", f"{name} length {span(p.min_length, p.max_length)}", lambda c: outside(F.length(c), p.min_length, p.max_length)))
    if p.pattern is not None:  # found anywhere, as in SHACL
        tests.append(("pattern", f"{name} pattern", lambda c: ~c.rlike(p.pattern)))
    if p.type.kind == "array":
        row("length", f"{name} size {p.type.size}", lambda: F.size(col()) != p.type.size)
    for code, label, test in tests:
        if not p.is_list:
            row(code, label, lambda test=test: test(col()))
        elif elements:
            row(code, f"{label} (elements)", lambda test=test: F.exists(col(), test))
        else:
            said.append(Diagnostic("info", "audit-unsupported", f"Not checked: {label}, for {name} is a list.", name))
    for code, compile_ in EXTRA_CHECKS.items():
        if (made := compile_(model, owner, p)) is not None:
            row(code, f"{name} {code}", lambda made=made: made)
    return out


def _assertion(c: Constraint) -> Column:
    a = [F.col(f"`{p}`") for p in c.props]
    match c.kind:
        case "lessThan":
            return a[0].isNotNull() & a[1].isNotNull() & ~(a[0] < a[1])
        case "lessThanOrEquals":
            return a[0].isNotNull() & a[1].isNotNull() & ~(a[0] <= a[1])
        case "equals":
            return ~a[0].eqNullSafe(a[1])
        case "disjoint":
            return a[0] == a[1]
        case "atLeastOne":
            return reduce(lambda x, y: x & y, [x.isNull() for x in a])
        case "exactlyOne":
            return reduce(lambda x, y: x + y, [x.isNotNull().cast("int") for x in a]) != 1
    raise ValueError(c.kind)


def _edge_ends(graph: PropertyGraph, edge: EdgeType, node: str, outgoing: bool, of: str | None = None) -> list[tuple[tuple[str, str, str], list[str]]]:
    """(edge table, key columns) of each table of an edge whose source (or target) is the node; `of` keeps edges to (or from) that type."""
    out = []
    for e, s, t in graph.tables_of(edge.name):
        other = graph.model.node(t if outgoing else s)
        if (s if outgoing else t) == node and (not of or of == other.name or of in other.ancestors):
            out.append(((e, s, t), endpoint_columns(graph.model, edge, s, t)[0 if outgoing else 1]))
    return out


def degrees(graph: PropertyGraph, edge: EdgeType, node: str, outgoing: bool, of: str | None = None) -> DataFrame:
    """For each distinct key of a concrete node type the number `n` of its edges, 0 included; `of` keeps edges to (or from) that type.

    Nodes and edges' ends meet in one aggregate by key, which needs no join. Ends without a key belong to no node."""
    key = list(graph.model.node(node).key)
    rows = [graph.vertices[node].select(*key, F.lit(0).alias("n"), F.lit(True).alias("_node"))]
    for table, own in _edge_ends(graph, edge, node, outgoing, of):
        rows.append(graph.edges[table].where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in own])).select(*(F.col(c).alias(k) for c, k in zip(own, key, strict=True)), F.lit(1).alias("n"), F.lit(False).alias("_node")))
    return reduce(DataFrame.unionByName, rows).groupBy(*key).agg(F.sum("n").alias("n"), F.bool_or("_node").alias("_node")).where("_node").drop("_node")


def _bounded(edge: EdgeType, node: str, outgoing: bool, limit: Bound, of: str | None = None) -> Callable[[PropertyGraph], DataFrame]:
    least = limit.least if limit.least > 0 else None
    return lambda graph: _one(degrees(graph, edge, node, outgoing, of).where(outside(F.col("n"), least, limit.most)))


def _bounds(edge: EdgeType, node: str, outgoing: bool, limit: Bound, of: str | None = None) -> Keyed:
    sides = lambda graph: [((node,), list(graph.model.node(node).key), True, True), *((t, c, False, False) for t, c in _edge_ends(graph, edge, node, outgoing, of))]
    return Keyed("bound", sides, limit.least if limit.least > 0 else None, limit.most)


def _hanging(edge: EdgeType, source: str, target: str, outgoing: bool) -> Keyed:
    node = source if outgoing else target
    own = lambda graph: endpoint_columns(graph.model, edge, source, target)[0 if outgoing else 1]
    return Keyed("dangling", lambda graph: [((node,), list(graph.model.node(node).key), True, False), ((edge.name, source, target), own(graph), False, True)])


def _dangling(edge: EdgeType, source: str, target: str, outgoing: bool) -> Callable[[PropertyGraph], DataFrame]:
    def count(graph: PropertyGraph) -> DataFrame:
        sides = endpoint_columns(graph.model, edge, source, target)
        own, node = (sides[0], source) if outgoing else (sides[1], target)
        keys = list(graph.model.node(node).key)
        nodes = graph.vertices[node].select(*(F.col(k).alias(c) for k, c in zip(keys, own, strict=True)))
        return _one(graph.edges[edge.name, source, target].select(*own).join(nodes, own, "left_anti"))

    return count


def _closed(node: NodeType, bag: str | None) -> Callable[[PropertyGraph], DataFrame]:
    """Nodes with a key that the type doesn't declare: in a map of further properties, or, for a table, all rows if a column is undeclared."""
    declared = [p.name for p in node.props]

    def count(graph: PropertyGraph) -> DataFrame:
        df = graph.vertices[node.name]
        if bag is None or bag not in df.columns:
            extra = set(df.columns) - set(declared)
            return _one(df) if extra else df.limit(1).agg(F.lit(0).cast("long").alias("violations"))
        stray = F.exists(F.map_keys(bag), lambda k: ~k.isin(*declared))
        return df.where(stray).agg(F.count_distinct(*node.key).alias("violations"))

    return count


def plan_audit(model: Model, layout: str = "leaf", elements: bool = False, bag: str | None = "_more") -> AuditPlan:
    """Every check of the model, for Spark's tables enforce none.

    layout: "leaf" checks a type on its own table; "labels" repeats a concrete supertype's checks on its descendants' tables.
    elements: check each element of lists, else report lists as unchecked. bag: the column of undeclared properties."""
    checks: list[Check] = []
    said: list[Diagnostic] = []
    for n in model.nodes:
        if n.abstract:
            for c in n.constraints:
                said.append(Diagnostic("info", "audit-abstract-constraint", f"Not checked: {n.name}.{c.name}, for constraints of abstract types hold for no table.", n.name))
    for n in model.concrete():
        owners = [n.name] if layout == "leaf" else [x.name for x in model.carriers(n.name)]
        for owner in owners:
            table, tag = (owner,), "" if len(owners) == 1 else f" [{owner}]"
            for k in n.key:
                checks.append(Check("key-present", f"{n.name} key part {k}{tag}", table, predicate=lambda k=k: F.col(f"`{k}`").isNull()))
            if n.key:
                checks.append(Check("key-unique", f"{n.name} key ({', '.join(n.key)}){tag}", table, count=_duplicates(list(n.key), table), keyed=_repeats(list(n.key), table)))
            for p in n.props:
                if p.name not in n.key:  # key parts have their own two checks and no others
                    checks += value_checks(model, f"{n.name}{tag}", table, p, said, elements)
            if not n.open and owner == n.name:
                checks.append(Check("closed", f"{n.name} closed{tag}", table, count=_closed(n, bag)))
            for c in n.constraints:
                if c.kind != "count":
                    checks.append(Check("constraint", f"{n.name}.{c.name}{tag}", table, c.severity, predicate=lambda c=c: _assertion(c)))
                elif (e := model.edge(c.edge)) and (c.bound.least > 0 or c.bound.most is not None):
                    checks.append(Check("constraint", f"{n.name}.{c.name}{tag}", table, c.severity, count=_bounded(e, owner, True, c.bound, c.of), keyed=_bounds(e, owner, True, c.bound, c.of)))
    for e in model.edges:
        sources, targets = [x.name for x in model.leaves(e.source)], [x.name for x in model.leaves(e.target)]
        if not sources or not targets:
            said.append(Diagnostic("warning", "no-concrete-endpoint", f"Not checked: edge {e.name} has an end without a concrete type.", e.name))
            continue
        for s in sources:
            for t in targets:
                table = (e.name, s, t)
                for p in e.props:
                    checks += value_checks(model, e.name if len(sources) * len(targets) == 1 else f"{e.name} [{s} to {t}]", table, p, said, elements)
                for outgoing, node in ((True, s), (False, t)):
                    checks.append(Check("foreign-key", f"{e.name} {'from' if outgoing else 'to'} {node}" + ("" if len(sources) * len(targets) == 1 else f" [{s} to {t}]"), table, count=_dangling(e, s, t, outgoing), keyed=_hanging(e, s, t, outgoing)))
        for end, limit, nodes, outgoing in (("to", e.targets, e.source, True), ("from", e.sources, e.target, False)):
            if limit.least > 0 or limit.most is not None:
                for node in [x.name for x in (model.leaves(nodes) if layout == "leaf" else model.carriers(nodes))]:
                    checks.append(Check("cardinality", f"{e.name} {end}-cardinality at {node}", (node,), count=_bounded(e, node, outgoing, limit), keyed=_bounds(e, node, outgoing, limit)))
    return AuditPlan(model, checks, said)


def audit(graph: PropertyGraph, **options) -> DataFrame:
    return plan_audit(graph.model, **options).run(graph)


def enforce(plan: AuditPlan, graph: PropertyGraph, node: str) -> DataFrame:
    """The node's table, with an error raised at the first row that breaks a row check."""
    df = graph.vertices[node]
    for c in plan.checks:
        if c.table == (node,) and c.predicate is not None and c.severity == "violation":
            df = df.where(F.when(F.coalesce(c.predicate(), F.lit(False)), F.raise_error(F.lit(f"{c.code}: {c.label}")).cast("boolean")).otherwise(F.lit(True)))
    return df
