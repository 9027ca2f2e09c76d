"""Pattern matching by joins.

A pattern is one or more chains of nodes and relationships, parted by commas; places with the same variable are one
place, so that chains may meet and close rings. A pattern is expanded into branches in which each place has one concrete
type and each step one edge table; branches that no edge table fits are pruned before any plan is built. A branch is a
sequence of equi-joins on typed key columns, left to Catalyst, and the branches' results are united. A relationship whose
ends are both known already is joined on both keys at once. Each row is one match; an edge may serve in several places.

A plain chain is joined from left to right. Any other pattern is joined in the order that makes the fewest rows in between, as estimated from counted
rows and edges: a place with few rows and many edges, such as a nation between its customers and its suppliers, comes late. Chains that share
no variable would be a cross join and are refused.

A relationship without an upper bound stands for each pair of ends that some walk of its length joins, once and with the fewest hops. Its
walks start at the rows that the joins before it have left: each round takes the newest ends over the edge tables and
drops those that the same start has reached before. The states are dealt out by start and end together, so a start that reaches much
lies in no one task; rounds are written tables, which the next ones read.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.patterns import NodePattern, RelPattern, parse_patterns
from .graph import PropertyGraph, Workspace, endpoint_columns

Hop = tuple[tuple[str, str, str], bool, str]
"""(edge table, forwards, type reached)."""


def _types(graph: PropertyGraph, labels: tuple[str, ...]) -> list[str]:
    """Bound concrete types that carry all labels of a place."""
    found = [n.name for n in graph.model.concrete() if n.name in graph.vertices]
    for label in labels:
        carriers = {n.name for n in graph.model.carriers(label)}
        found = [n for n in found if n in carriers]
    return found


def _literal(token) -> Column:
    if token is None:
        raise ValueError("only literals can be matched")
    return F.lit(token.text.lower() == "true") if token.kind == "word" else F.lit(token.value)


def _steps(graph: PropertyGraph, rel: RelPattern, at: str) -> list[Hop]:
    """Each single hop from a type."""
    out = []
    for key in graph.edges:
        if rel.types and key[0] not in rel.types:
            continue
        if rel.direction in ("out", "any") and key[1] == at:
            out.append((key, True, key[2]))
        if rel.direction in ("in", "any") and key[2] == at:
            out.append((key, False, key[1]))
    return out


def _paths(graph: PropertyGraph, rel: RelPattern, at: str) -> list[list[Hop]]:
    """Hop sequences of a bounded relationship."""
    level, out = [[]], [[]] if rel.least == 0 else []
    for n in range(1, rel.most + 1):
        level = [p + [s] for p in level for s in _steps(graph, rel, p[-1][2] if p else at)]
        if n >= rel.least:
            out += level
    return out


def _far_types(graph: PropertyGraph, rel: RelPattern, at: str) -> list[str]:
    """Types that an unbounded relationship can reach from a type."""
    level, hops = frozenset([at]), 0
    found = set(level) if rel.least == 0 else set()
    walked: set[tuple[frozenset, int]] = set()
    while level and (level, min(hops, rel.least)) not in walked:
        walked.add((level, min(hops, rel.least)))
        level = frozenset(t for x in level for _, _, t in _steps(graph, rel, x))
        hops += 1
        if hops >= rel.least:
            found |= level
    return sorted(found)


def _edges(graph: PropertyGraph, key: tuple[str, str, str], rel: RelPattern) -> DataFrame:
    """The rows of an edge table that have the properties of a relationship."""
    table = graph.edges[key]
    for p, token in rel.props.items():
        table = table.where(F.col(f"`{p}`") == _literal(token))
    return table


def _edge_step(graph: PropertyGraph, hop: Hop, rel: RelPattern, here: list[str], there: list[str], shown: bool = False) -> DataFrame:
    """An edge table with the near end's key as `here`, the far end's as `there`, and its properties if shown."""
    key, forwards, _ = hop
    src, dst = endpoint_columns(graph.model, graph.model.edge(key[0]), key[1], key[2])
    near, far = (src, dst) if forwards else (dst, src)
    table = _edges(graph, key, rel)
    own = [F.col(f"`{c}`").alias(f"{rel.variable}_{c}") for c in table.columns if c not in (*src, *dst)] + ([F.lit(key[0]).alias(f"{rel.variable}_type")] if len(rel.types) != 1 else []) if shown else []
    if here == there:  # an edge from a row to itself
        table = table.where(reduce(lambda a, b: a & b, [F.col(f"`{n}`") == F.col(f"`{f}`") for n, f in zip(near, far, strict=True)]))
        far, there = [], []
    return table.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(near, here, strict=True)), *(F.col(f"`{c}`").alias(n) for c, n in zip(far, there, strict=True)), *own)


def walks(graph: PropertyGraph, rel: RelPattern, at: str, seeds: DataFrame, work: Workspace) -> dict[str, DataFrame]:
    """For each type reached: start key (seeds' columns), end key (k0, k1, ...) and the fewest hops, at least `rel.least`, of walks from the seeds, which are of type `at`.

    Null keys start nothing. Each round is work in proportion to the newest ends and one pass over the edges of their types."""
    start = seeds.columns
    ends = lambda kind: [f"k{i}" for i in range(len(graph.model.node(kind).key))]
    first = seeds.dropna().distinct().select(*start, *(F.col(s).alias(k) for s, k in zip(start, ends(at), strict=True)))
    new = {at: work.put(first)}
    reached: dict[str, list[DataFrame]] = {at: [new[at].withColumn("hops", F.lit(0))]} if rel.least == 0 else {}
    hops = 0
    while new and (rel.most is None or hops < rel.most):
        hops += 1
        found: dict[str, list[DataFrame]] = {}
        for kind, frontier in new.items():
            for hop in _steps(graph, rel, kind):
                far = [f"n{i}" for i in range(len(ends(hop[2])))]
                step = frontier.join(_edge_step(graph, hop, rel, ends(kind), far), ends(kind))
                found.setdefault(hop[2], []).append(step.select(*start, *(F.col(n).alias(k) for n, k in zip(far, ends(hop[2]), strict=True))))
        new = {}
        for kind, parts in found.items():
            level = reduce(DataFrame.unionByName, parts).distinct()
            if hops > rel.least and kind in reached:
                known = reduce(DataFrame.unionByName, reached[kind]).select(*start, *ends(kind))
                level = level.join(known, [*start, *ends(kind)], "left_anti")
            level = work.put(level)
            if not level.isEmpty():
                new[kind] = level
                if hops >= rel.least:
                    reached.setdefault(kind, []).append(level.withColumn("hops", F.lit(hops)))
    return {kind: reduce(DataFrame.unionByName, parts) for kind, parts in reached.items()}


@dataclass
class _Places:
    """The places of a pattern and the relationships between them, by number of place."""

    nodes: list[NodePattern]
    filters: list[list[tuple[str, object]]]
    rels: list[tuple[RelPattern, int, int]]
    plain: bool


def _places(pattern: str) -> _Places:
    chains = parse_patterns(pattern)
    number: dict[str, int] = {}
    out = _Places([], [], [], len(chains) == 1)
    for chain in chains:
        at = []
        for node in chain[::2]:
            if node.variable is not None and node.variable in number:
                i = number[node.variable]
                out.nodes[i] = replace(out.nodes[i], labels=tuple(dict.fromkeys((*out.nodes[i].labels, *node.labels))))
                out.plain = False
            else:
                i = len(out.nodes)
                out.nodes.append(node)
                out.filters.append([])
                if node.variable is not None:
                    number[node.variable] = i
            out.filters[i] += node.props.items()
            at.append(i)
        out.rels += [(rel, a, b) for rel, a, b in zip(chain[1::2], at, at[1:], strict=False)]
    taken = [r.variable for r, _, _ in out.rels if r.variable is not None]
    if len(set(taken)) < len(taken) or set(taken) & set(number):
        raise ValueError("a relationship's variable can stand for one relationship of a pattern")
    out.plain = out.plain and all(r.most is not None for r, _, _ in out.rels)
    return out


def _fitting(graph: PropertyGraph, places: _Places, allowed: list[list[str]]) -> list[list[str]]:
    """Of each place's types those that each of its relationships can join to one of the other end's."""
    allowed = list(allowed)
    while True:
        was = [len(kinds) for kinds in allowed]
        for rel, a, b in places.rels:
            reach = {t: set(_far_types(graph, rel, t) if rel.most is None else (p[-1][2] if p else t for p in _paths(graph, rel, t))) for t in allowed[a]}
            if a == b:
                allowed[a] = [t for t in allowed[a] if t in reach[t]]
            else:
                allowed[a] = [t for t in allowed[a] if reach[t] & set(allowed[b])]
                allowed[b] = [t for t in allowed[b] if any(t in reach[x] for x in allowed[a])]
        if was == [len(kinds) for kinds in allowed]:
            return allowed


def _counted(graph: PropertyGraph, places: _Places, allowed: list[list[str]]) -> tuple[list[int], list[int], list[float]]:
    """How many rows each place has before and after its filters, and about how many pairs of rows each relationship joins before any filter. One job; the numbers come to the driver."""
    ways = [[path for t in allowed[a] for path in _paths(graph, rel, t) if (path[-1][2] if path else t) in allowed[b]] if rel.most is not None else [] for rel, a, b in places.rels]
    kinds = sorted({k for own in allowed for k in own} | {hop[2] for paths in ways for path in paths for hop in path[:-1]})
    parts = [graph.vertices[k].agg(F.count("*").alias("n")).select(F.lit("all").alias("what"), F.lit(j).alias("at"), F.lit(0).alias("of"), "n") for j, k in enumerate(kinds) if k in graph.vertices]
    for i, own in enumerate(allowed):
        parts += [_filtered(graph.vertices[k], places.filters[i]).agg(F.count("*").alias("n")).select(F.lit("fit"), F.lit(i), F.lit(0), "n") for k in own if places.filters[i]]
    tables = list(graph.edges)
    for i, paths in enumerate(ways):
        for key in {hop[0]: None for path in paths for hop in path}:
            parts.append(_edges(graph, key, places.rels[i][0]).agg(F.count("*").alias("n")).select(F.lit("edges"), F.lit(i), F.lit(tables.index(key)), "n"))
    found: dict[tuple[str, int, int], int] = {}
    for r in reduce(DataFrame.union, parts).collect():  # a row for each table and place
        found[r.what, r["at"], r.of] = found.get((r.what, r["at"], r.of), 0) + r.n
    each = {k: found.get(("all", j, 0), 0) for j, k in enumerate(kinds)}
    whole = [sum(each[k] for k in own) for own in allowed]
    rows = [found.get(("fit", i, 0), 0) if places.filters[i] else whole[i] for i in range(len(allowed))]
    pairs: list[float] = []
    for i, (rel, a, b) in enumerate(places.rels):
        n = float(whole[a] * whole[b]) if rel.most is None else 0.0  # a walk of any length may reach all rows
        for path in ways[i]:
            n += prod(found["edges", i, tables.index(hop[0])] for hop in path) / prod(max(1, each[hop[2]]) for hop in path[:-1]) if path else sum(each[k] for k in allowed[a])
        pairs.append(n)
    return whole, rows, pairs


#: How many sets of relationships of one size are followed up.
SETS = 512


def _order(places: _Places, whole: list[int], rows: list[int], pairs: list[float]) -> tuple[int, list[tuple[int, bool]]]:
    """The first place, and the relationships in the order of their joins with whether each is walked backwards.

    It is the order whose joins make the fewest rows in all, with the filters and the relationships taken as independent: set by set of relationships, from those of one to all of them."""
    fit = [n / max(1, whole[a] * whole[b]) for n, (_, a, b) in zip(pairs, places.rels, strict=True)]
    # relationships taken -> rows made so far, the first place, their order, places known, rows that are left
    best = {(frozenset(), i): (float(rows[i]), i, (), frozenset([i]), float(rows[i])) for i in range(len(places.nodes))}
    for _ in places.rels:
        grown: dict = {}
        for (taken, _), (cost, first, order, known, size) in sorted(best.items(), key=lambda x: x[1][:3])[:SETS]:
            for r, (rel, a, b) in enumerate(places.rels):
                if r in taken or not known & {a, b}:
                    continue
                here, there = (a, b) if a in known else (b, a)
                # ends are joined before the far place's filter; a walk takes each start to all that it reaches, whatever is known of the far end
                made = min(size, whole[here]) * whole[there] if rel.most is None else size if there in known else size * fit[r] * whole[there]
                left = min(1e99, size * fit[r] * (1 if there in known else rows[there]))
                state = (cost + min(1e99, made) + left, first, (*order, (r, a not in known)), known | {there}, left)
                at = (taken | {r}, None)
                if at not in grown or state[:3] < grown[at][:3]:
                    grown[at] = state
        best = grown
    _, first, order, _, _ = min(best.values(), key=lambda x: x[:3])
    return first, list(order)


def _connected(places: _Places) -> bool:
    known = {0}
    for _ in places.rels:
        known |= {x for _, a, b in places.rels if known & {a, b} for x in (a, b)}
    return len(known) == len(places.nodes)


def _filtered(df: DataFrame, filters: list[tuple[str, object]]) -> DataFrame:
    for p, token in filters:
        df = df.where(F.col(f"`{p}`") == _literal(token)) if p in df.columns else df.where(F.lit(False))
    return df


_TURNED = {"out": "in", "in": "out", "any": "any"}


def match(graph: PropertyGraph, pattern: str) -> DataFrame:
    """A row for each match. Columns are <variable>_<property>, and <variable>_type for variables without exactly one type.

    The variable of an unbounded relationship has <variable>_hops, the fewest hops between the two ends. Rows then lie in tables under the checkpoint folder
    until the Python process ends."""
    places = _places(pattern)
    if not _connected(places):
        raise ValueError("the chains of a pattern must share variables: a cross join is no match")
    allowed = [_types(graph, n.labels) for n in places.nodes]
    if places.plain:
        first, order = 0, [(i, False) for i in range(len(places.rels))]
    elif all(fitting := _fitting(graph, places, allowed)):
        first, order = _order(places, *_counted(graph, places, fitting))
    else:
        raise ValueError(f"no bound tables fit the pattern {pattern}")
    rels = []
    for i, backwards in order:
        rel, a, b = places.rels[i]
        rels.append((replace(rel, direction=_TURNED[rel.direction]), b, a) if backwards else (rel, a, b))

    branches: list[tuple[dict[int, str], list]] = [({first: t}, []) for t in allowed[first]]
    for rel, a, b in rels:
        grown = []
        for types, taken in branches:
            ways = [(t, None) for t in _far_types(graph, rel, types[a])] if rel.most is None else [(p[-1][2] if p else types[a], p) for p in _paths(graph, rel, types[a])]
            grown += [(types | {b: t}, [*taken, path]) for t, path in ways if t in allowed[b] and types.get(b, t) == t]
        branches = grown
    if not branches:
        raise ValueError(f"no bound tables fit the pattern {pattern}")
    names = [n.variable for n in places.nodes]
    keys = lambda i, kind: [f"__{i}_{k}" for k in graph.model.node(kind).key]

    def vertex(i: int, kind: str) -> DataFrame:
        df, key = _filtered(graph.vertices[kind], places.filters[i]), graph.model.node(kind).key
        shown = [F.col(f"`{c}`").alias(f"{names[i]}_{c}") for c in df.columns] if names[i] else []
        return df.select(*shown, *(F.col(f"`{k}`").alias(c) for k, c in zip(key, keys(i, kind), strict=True)), *([F.lit(kind).alias(f"{names[i]}_type")] if names[i] and len(allowed[i]) > 1 else []))

    walked: dict[tuple, dict[str, DataFrame]] = {}

    def branch(types: dict[int, str], paths: list, work: Workspace | None) -> DataFrame:
        df, known = vertex(first, types[first]), [first]
        for r, ((rel, a, b), path) in enumerate(zip(rels, paths, strict=True)):
            here, there, closing = keys(a, types[a]), keys(b, types[b]), b in known
            if path is None:
                at = (r, *(types[k] for k in known))
                if at not in walked:  # shared by the branches that differ only in what comes after
                    walked[at] = walks(graph, rel, types[a], df.select(*(F.col(c).alias(f"s{i}") for i, c in enumerate(here))), work)
                far = walked[at].get(types[b])
                if far is None:
                    named = lambda of, columns, to: [T.StructField(f"{to}{i}", of.schema[c].dataType) for i, c in enumerate(columns)]
                    far = df.sparkSession.createDataFrame([], T.StructType([*named(df, here, "s"), *named(vertex(b, types[b]), there, "k"), T.StructField("hops", T.IntegerType())]))
                far = far.withColumnsRenamed({f"s{i}": f"__s{i}" for i in range(len(here))} | {f"k{i}": f"__k{i}" for i in range(len(there))})
                if here == there:
                    far = far.where(reduce(lambda x, y: x & y, [F.col(f"__s{i}") == F.col(f"__k{i}") for i in range(len(here))])).drop(*(f"__k{i}" for i in range(len(here))))
                else:
                    far = far.withColumnsRenamed({f"__k{i}": c for i, c in enumerate(there)})
                far = far.withColumnsRenamed({f"__s{i}": c for i, c in enumerate(here)})
                far = far.withColumnRenamed("hops", f"{rel.variable}_hops") if rel.variable else far.drop("hops")
                df = df.join(far, [*here, *(there if closing and here != there else [])])
            for h, hop in enumerate(path or []):
                last = h == len(path) - 1
                end = there if last else [f"__r{r}_{h}_{k}" for k in graph.model.node(hop[2]).key]
                step = _edge_step(graph, hop, rel, here, end, shown=bool(rel.variable) and rel.most == 1)
                df = df.join(step, [*here, *(end if last and closing and end != here else [])])
                here = end
            if path == [] and a != b:
                same = [F.col(f"`{x}`").alias(y) for x, y in zip(here, there, strict=True)]
                df = df.where(reduce(lambda x, y: x & y, [F.col(f"`{x}`") == F.col(f"`{y}`") for x, y in zip(here, there, strict=True)])) if closing else df.select("*", *same)
            if not closing:
                df = df.join(vertex(b, types[b]), there)
                known.append(b)
        return df.select(*(c for c in df.columns if not c.startswith("__")))

    united = lambda work: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [branch(*b, work) for b in branches])
    if all(rel.most is not None for rel, _, _ in rels):
        return united(None)
    with Workspace(next(iter(graph.vertices.values())).sparkSession) as work:
        return work.put(united(work), keep=True)


def reachable(graph: PropertyGraph, edge: str, most: int | None = None, seeds: DataFrame | None = None) -> DataFrame:
    """(src..., dst..., hops): all pairs that one or more hops of an edge between rows of one type connect, with the fewest hops.

    seeds: the keys to start at, by the names of the edge's source columns; without them all sources of edges, so that the result has all pairs."""
    (key,) = graph.tables_of(edge)
    if key[1] != key[2]:
        raise ValueError("the edge must lead back to its own type")
    src, dst = endpoint_columns(graph.model, graph.model.edge(edge), key[1], key[2])
    starts = (graph.edges[key] if seeds is None else seeds).select(*(F.col(c).alias(f"s{i}") for i, c in enumerate(src)))
    with Workspace(starts.sparkSession) as work:
        found = walks(graph, RelPattern(types=(edge,), direction="out", least=1, most=most), key[1], starts, work)
        shown = [F.col(f"s{i}").alias(c) for i, c in enumerate(src)] + [F.col(f"k{i}").alias(c) for i, c in enumerate(dst)]
        pairs = found[key[1]].select(*shown, "hops") if key[1] in found else starts.limit(0).select(*(F.col(f"s{i}").alias(c) for i, c in enumerate(src)), *(F.col(f"s{i}").alias(c) for i, c in enumerate(dst)), F.lit(1).alias("hops"))
        return work.put(pairs, keep=True)
