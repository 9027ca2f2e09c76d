"""Checks on streams that need state: uniqueness, keys, counts of edges and dangling ends.

Each of them is decided key by key from two numbers, how many node rows and how many edges' ends have the key. The streams of
all tables become rows (check, key, nodes, edges), which are added up within each Arrow batch before they are shuffled, so
that a key with many rows sends a few. The keys are dealt out to buckets by their hash, and the state store holds the two numbers of
each (check, key) of a bucket as one table, for a call for each key takes much longer than its sum; a batch reads and writes the
buckets of its keys. What a batch adds changes a key's violations from one whole number to another, and the change is put out. Changes are written by number of
batch, so that a batch that is run again after a restart replaces its own, and add up to the violations.

Sums don't depend on the order of files: an edge that comes before its node is dangling until the node comes. A file
that is delivered again under the same path is read once; with `names_only` also one of the same name that a later batch brings in another folder. State grows with the
number of distinct keys, and a key of any length is kept as its SHA-256.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..operators.audit import AuditPlan, Check, Keyed, frame
from ..operators.graph import PropertyGraph
from ..operators.keyrows import key_rows, keyed_checks

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROWS = "`check` int, key binary, nodes long, edges long"
#: Parts that the keys are dealt out to; a folder stays with the number that it was begun with.
BUCKETS = 2048


def _added_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        summed = pa.Table.from_batches([batch]).group_by(["check", "key"]).aggregate([("nodes", "sum"), ("edges", "sum")])
        yield from summed.select(["check", "key", "nodes_sum", "edges_sum"]).rename_columns(["check", "key", "nodes", "edges"]).to_batches()


class KeyState(StatefulProcessor):
    """The numbers of the (check, key) of one bucket, and what their changes do to the checks' violations."""

    def __init__(self, violations: dict[int, object]) -> None:
        self.violations = violations

    def init(self, handle) -> None:
        self.numbers = handle.getValueState("numbers", "own binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        kept = pa.schema([("check", pa.int32()), ("key", pa.binary(32)), ("nodes", pa.int64()), ("edges", pa.int64())])
        was = self.numbers.get()
        old = pa.ipc.open_stream(bytes(was[0])).read_all() if was else kept.empty_table()
        new = pa.concat_tables([kept.empty_table(), *(pa.Table.from_pandas(part[kept.names], kept, preserve_index=False) for part in rows)])
        # rows of a key: what was, and what comes
        sides = [t.append_column("more_nodes", y.column("nodes")).append_column("more_edges", y.column("edges")) for t, y in ((old, _nothing(old)), (_nothing(new), new))]
        both = pa.concat_tables(sides).group_by(["check", "key"]).aggregate([(c, "sum") for c in ("nodes", "edges", "more_nodes", "more_edges")])
        check, nodes, edges, more_nodes, more_edges = (both.column(c).to_numpy() for c in ("check", "nodes_sum", "edges_sum", "more_nodes_sum", "more_edges_sum"))
        sums = pa.table([both.column("check"), both.column("key"), pa.array(nodes + more_nodes), pa.array(edges + more_edges)], schema=kept)
        with pa.ipc.new_stream(sink := pa.BufferOutputStream(), kept) as out:
            out.write_table(sums)
        self.numbers.update((sink.getvalue().to_pybytes(),))
        changes = {}
        for i in np.unique(check):
            own, keyed = check == i, self.violations[int(i)]
            changes[int(i)] = int(keyed((nodes + more_nodes)[own], (edges + more_edges)[own]).sum() - keyed(nodes[own], edges[own]).sum())
        if any(changes.values()):
            yield pd.DataFrame([(i, n) for i, n in changes.items() if n], columns=["check", "change"]).astype({"check": "int32", "change": "int64"})

    def close(self) -> None:
        pass


def _nothing(numbers: pa.Table) -> pa.Table:
    """The same keys with zeros."""
    zeros = pa.array(np.zeros(numbers.num_rows, "int64"))
    return numbers.set_column(2, "nodes", zeros).set_column(3, "edges", zeros)


class _Violations:
    """The rule of a check without the functions that name its tables, which stay on the driver."""

    def __init__(self, check: Check) -> None:
        self.kind, self.least, self.most = check.keyed.kind, check.keyed.least, check.keyed.most

    def __call__(self, nodes: np.ndarray, edges: np.ndarray) -> np.ndarray:
        return Keyed(self.kind, None, self.least, self.most).violations(nodes, edges).astype("int64")


def read_tables(spark: SparkSession, graph: PropertyGraph, folders: dict[tuple[str, ...], str], names_only: bool = False, files: int | None = None) -> PropertyGraph:
    """The graph's tables as streams of Parquet files: folders by (node,) or (edge, source, target), each with the columns of the graph's table.

    files: how many files of a table a batch takes at most."""

    def stream(table: tuple[str, ...]) -> DataFrame:
        reader = spark.readStream.schema(frame(graph, table).schema).option("fileNameOnly", str(names_only).lower())
        return (reader if files is None else reader.option("maxFilesPerTrigger", files)).parquet(folders[table])

    return PropertyGraph(graph.model, {t[0]: stream(t) for t in folders if len(t) == 1}, {t: stream(t) for t in folders if len(t) == 3})


def audit_keys(streams: PropertyGraph, plan: AuditPlan, folder: str, **trigger) -> StreamingQuery:
    """Start the plan's keyed checks on a graph of streams; state and changes are kept under the folder, which a restart goes on from.

    trigger: that of the query, as availableNow=True."""
    checks = keyed_checks(plan, streams)
    if not checks:
        raise ValueError("no check of the plan is decided by key on these tables")
    spark = next(iter((streams.vertices | streams.edges).values())).sparkSession
    spark.conf.set(PROVIDER, ROCKS)  # the state of Python's operators needs it
    rows = key_rows(streams, checks).withColumn("key", F.unhex("key")).mapInArrow(_added_up, ROWS).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int"))
    processor = KeyState({i: _Violations(c) for i, c in enumerate(checks)})
    changes = rows.groupBy("bucket").transformWithStateInPandas(processor, "`check` int, change long", "update", "none")

    spark.createDataFrame([], "`check` int, change long").write.mode("overwrite").parquet(f"{folder}/changes/batch=-1")  # so that there is something to read from the start

    def keep(batch: DataFrame, n: int) -> None:
        batch.groupBy("check").agg(F.sum("change").alias("change")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/changes/batch={n}")

    return changes.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(**(trigger or {"availableNow": True})).start()


def violations(streams: PropertyGraph, plan: AuditPlan, folder: str) -> DataFrame:
    """(code, label, violations) of the keyed checks as of the batches that have ended; a check that nothing has broken has 0."""
    spark = next(iter((streams.vertices | streams.edges).values())).sparkSession
    names = spark.createDataFrame([(i, c.code, c.label) for i, c in enumerate(keyed_checks(plan, streams))], "`check` int, code string, label string")
    changes = spark.read.schema("`check` int, change long, batch long").parquet(f"{folder}/changes").groupBy("check").agg(F.sum("change").alias("n"))  # a few rows for each batch
    return names.join(changes, "check", "left").select("code", "label", F.coalesce("n", F.lit(0)).cast("long").alias("violations"))
