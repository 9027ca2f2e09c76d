"""Row checks on a stream: they need no state, so each batch is counted on its own and the counts are added up."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.audit import AuditPlan
from ..operators.graph import PropertyGraph, checkpoint_folder, remove_path, to_model


def row_checks(plan: AuditPlan, node: str) -> AuditPlan:
    """The checks of a node's table that look at one row. Uniqueness and bounds of edges would need state."""
    return AuditPlan(plan.model, [c for c in plan.checks if c.table == (node,) and c.predicate is not None], plan.diagnostics)


def audit_stream(stream: DataFrame, plan: AuditPlan, node: str, sink: Callable[[DataFrame, int], None]):
    """A writer that hands each batch's (code, label, violations) to sink with the batch's number; start() runs it."""
    checks = row_checks(plan, node)
    return stream.writeStream.foreachBatch(lambda batch, n: sink(checks.run(PropertyGraph(plan.model, {node: to_model(batch, plan.model, node)})), n))


def audit_files(spark: SparkSession, plan: AuditPlan, node: str, path: str) -> DataFrame:
    """All files of a path as a stream until none is left, the batches' counts added up. Counts are written under the checkpoint folder by batch number, so that a batch that is run again replaces its own; they go when the Python process ends."""
    out = f"{checkpoint_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    atexit.register(remove_path, spark, out)
    seen: set[int] = set()

    def sink(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/counts/batch={n}")
        seen.add(n)

    stream = spark.readStream.schema(spark.read.parquet(path).schema).format("parquet").load(path if not path.endswith(".parquet") else path + "*")
    query = audit_stream(stream, plan, node, sink).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    parts = [spark.read.parquet(f"{out}/counts/batch={n}") for n in sorted(seen)]
    return reduce(DataFrame.unionByName, parts).groupBy("code", "label").agg(F.sum("violations").alias("violations"))
