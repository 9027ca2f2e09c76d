"""Rows of tables as what they add to checks that are decided by key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .audit import AuditPlan, Check, bound, frame
from .graph import PropertyGraph


def keyed_checks(plan: AuditPlan, graph: PropertyGraph) -> list[Check]:
    """The plan's checks that are decided by key, and whose tables the graph has: the node's and, for edges' ends, the edge's."""
    return [c for c in plan.checks if c.keyed and bound(graph, c.table) and all(bound(graph, t) for t, *_ in c.keyed.sides(graph))]


def key_text(columns: list[str]) -> Column:
    """A key as text of a fixed length; columns go by their place, since both sides of a check name them differently."""
    return F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(columns)))), 256)


def key_rows(graph: PropertyGraph, checks: list[Check], partial: bool = False) -> DataFrame | None:
    """(check, key, nodes, edges): what each row of each table adds to each check, by the check's place in the list. A table is read once for all its checks.

    partial: tables that the graph lacks are left out; None if it has none of them."""
    asked: dict[tuple[str, ...], list[Column]] = {}
    for i, c in enumerate(checks):
        for table, columns, is_node, nulls in c.keyed.sides(graph):
            if partial and not bound(graph, table):
                continue
            entry = F.struct(F.lit(i).alias("check"), key_text(columns).alias("key"), F.lit(int(is_node)).cast("long").alias("nodes"), F.lit(int(not is_node)).cast("long").alias("edges"))
            whole = F.lit(True) if nulls else reduce(lambda a, b: a & b, [F.col(f"`{x}`").isNotNull() for x in columns])
            asked.setdefault(table, []).append(F.when(whole, entry))
    parts = [frame(graph, table).select(F.inline(F.array_compact(F.array(*entries)))) for table, entries in asked.items()]
    return reduce(DataFrame.unionByName, parts) if parts else None
