"""Graphs as bucketed tables, so that audits and matches join without a shuffle of what lies on disk.

A vertex table is bucketed and sorted by its key, an edge table by its source key, and where asked for kept a second time by its
target key. All tables have the same number of buckets, so that a join of a vertex table with an edge's bucketed end, or of two
edge tables at the same end, needs no exchange of either; Spark still broadcasts what is small. Tables belong to a database of the catalog, whose
folder all executors share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.model import Model
from .graph import PropertyGraph, endpoint_columns

BUCKETS = 64


def _table(key: tuple[str, ...], end: str = "source") -> str:
    return "__".join(key).lower() + ("__by_target" if end == "target" else "")


def _save(df: DataFrame, name: str, columns: list[str], buckets: int) -> None:
    # rows are dealt out as the buckets are, so that each bucket is one file
    df.repartition(buckets, *columns).write.bucketBy(buckets, *columns).sortBy(*columns).mode("overwrite").format("parquet").saveAsTable(name)


def save_graph(graph: PropertyGraph, database: str, buckets: int = BUCKETS, by_target: tuple[str, ...] = ()) -> None:
    """Write a graph as tables of a database, which is made if it is not there. by_target: edges that are also kept by their target key.

    About one bucket for each few hundred MB of the largest table is right; a key that holds a large share of the rows makes a large bucket."""
    spark = next(iter((graph.vertices | graph.edges).values())).sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, df in graph.vertices.items():
        _save(df, f"{database}.{_table((name,))}", list(graph.model.node(name).key), buckets)
    for key, df in graph.edges.items():
        src, dst = endpoint_columns(graph.model, graph.model.edge(key[0]), key[1], key[2])
        _save(df, f"{database}.{_table(key)}", src, buckets)
        if key[0] in by_target:
            _save(df, f"{database}.{_table(key, 'target')}", dst, buckets)


def open_tables(spark: SparkSession, database: str, model: Model, by_target: tuple[str, ...] = ()) -> PropertyGraph:
    """The graph of a database's tables; the edges named in by_target come from the copy that is bucketed by target."""
    have = {t.name for t in spark.catalog.listTables(database)}
    read = lambda name: spark.table(f"{database}.{name}")
    vertices = {n.name: read(_table((n.name,))) for n in model.concrete() if _table((n.name,)) in have}
    edges = {}
    for e in model.edges:
        for s in model.leaves(e.source):
            for t in model.leaves(e.target):
                name = _table((e.name, s.name, t.name), "target" if e.name in by_target else "source")
                if name in have:
                    edges[e.name, s.name, t.name] = read(name)
    return PropertyGraph(model, vertices, edges)
