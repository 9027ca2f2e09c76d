"""Audits that go on from an earlier one: what rows added and removed do to the violations, without the rest of the data.

A store holds the violations of each check and, for checks that are decided by key, the numbers of each (check, key): how many node
rows and how many edges' ends have it. A change is two graphs, of rows that came and rows that went. Its row checks are counted on those
rows alone. Its keys are added up, the numbers of just these keys are looked up, and the difference of the keys' violations before
and after is added to the totals. Numbers lie in BUCKETS folders by a hash of the key, and each folder's files are sorted by key: a change reads the
folders that its keys fall in, and of their files the parts whose range of keys can hold them. New numbers
are put beside the old ones as another file of the folder; sums of a key's files are its numbers, and `compact` makes them one again.

A store is changed by one rename of its manifest, so a run that breaks leaves the store as it was and is run again. Numbers never say whether a removed row was
there: removing what was not added makes the counts wrong, as it does in any difference of counts. Checks that need the tables as a whole in another way
(closed tables, checks by users) are counted on the rows of the change as row checks are, where they look at one row, and left out else.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.model import Model
from .audit import AuditPlan, Check, Keyed, bound, frame
from .graph import PropertyGraph
from .keyrows import key_rows, keyed_checks
from .versions import _Files

BUCKETS, MANIFEST = 256, "STORE"


def key_violations(keyed: Keyed, nodes: Column, edges: Column) -> Column:
    """A check's violations of one key, from its numbers."""
    if keyed.kind == "dangling":
        return F.when(nodes <= 0, edges).otherwise(0)
    return keyed.violations(nodes, edges).cast("long")


def row_checks(plan: AuditPlan, graph: PropertyGraph) -> list[Check]:
    return [c for c in plan.checks if c.predicate is not None and bound(graph, c.table)]


class AuditStore:
    """The violations of a graph's checks under a folder, kept up by changes.

    `graph` says which tables there are and what columns they have; its rows are read by `build` alone."""

    def __init__(self, spark: SparkSession, folder: str, plan: AuditPlan, graph: PropertyGraph, buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.plan, self.buckets, self.files = spark, folder.rstrip("/"), plan, buckets, _Files(spark, folder)
        self.keyed, self.rows = keyed_checks(plan, graph), row_checks(plan, graph)
        self.names = [(c.code, c.label) for c in (*self.keyed, *self.rows)]

    @property
    def model(self) -> Model:
        return self.plan.model

    def _row_counts(self, graph: PropertyGraph, sign: int) -> list[DataFrame]:
        """(check, n) of the row checks on the graph's rows; one aggregate for each table."""
        by_table: dict[tuple[str, ...], list[tuple[int, Check]]] = {}
        for i, c in enumerate(self.rows, len(self.keyed)):
            if bound(graph, c.table):
                by_table.setdefault(c.table, []).append((i, c))
        out = []
        for table, own in by_table.items():
            counted = frame(graph, table).agg(*(F.count_if(c.predicate()).alias(f"v{i}") for i, c in own))
            out.append(counted.select(F.inline(F.array(*(F.struct(F.lit(i).alias("check"), (F.col(f"v{i}") * sign).cast("long").alias("n")) for i, _ in own)))))
        return out

    def _key_counts(self, graph: PropertyGraph, sign: int) -> DataFrame | None:
        rows = key_rows(graph, self.keyed, partial=True)
        return rows and rows.select("check", "key", *((F.col(c) * sign).alias(c) for c in ("nodes", "edges")))

    def _changes(self, numbers: DataFrame) -> DataFrame:
        """(check, n): by how much each check's violations change, from rows with the numbers before and what is added to them."""
        parts = []
        for i, c in enumerate(self.keyed):
            after = key_violations(c.keyed, F.col("nodes") + F.col("more_nodes"), F.col("edges") + F.col("more_edges"))
            parts.append(F.when(F.col("check") == i, after - key_violations(c.keyed, F.col("nodes"), F.col("edges"))))
        return numbers.groupBy("check").agg(F.sum(F.coalesce(*parts)).alias("n"))

    def _write(self, counts: DataFrame) -> str:
        """Add numbers to the store's folders; each folder gets a file sorted by key."""
        name = f"part-{uuid.uuid4().hex}"
        placed = counts.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int"))
        placed.repartition("bucket").sortWithinPartitions("bucket", "key").write.partitionBy("bucket").parquet(f"{self.folder}/{name}")
        return name

    def _add(self, totals: dict[int, int], counted: list[DataFrame]) -> dict[int, int]:
        if counted:
            for r in reduce(DataFrame.unionByName, counted).groupBy("check").agg(F.sum("n").alias("n")).collect():  # a row for each check
                totals[r["check"]] = totals.get(r["check"], 0) + r.n
        return totals

    def build(self, graph: PropertyGraph) -> None:
        """Start the store with the whole graph."""
        zero = [F.lit(0).cast("long").alias(c) for c in ("nodes", "edges")]
        counts = self._key_counts(graph, 1)
        parts, changes = [], []
        if counts is not None:
            parts = [self._write(counts.groupBy("check", "key").agg(F.sum("nodes").alias("nodes"), F.sum("edges").alias("edges")))]
            changes = [self._changes(self._read(parts).select("check", "key", *zero, F.col("nodes").alias("more_nodes"), F.col("edges").alias("more_edges")))]
        totals = self._add({}, [*changes, *self._row_counts(graph, 1)])
        self.files.write(MANIFEST, {"parts": parts, "totals": {str(k): v for k, v in totals.items()}})

    def _read(self, parts: list[str]) -> DataFrame:
        schema = "`check` int, key string, nodes long, edges long, bucket int"
        return reduce(DataFrame.unionByName, [self.spark.read.schema(schema).parquet(f"{self.folder}/{p}") for p in parts])

    def change(self, added: PropertyGraph | None = None, removed: PropertyGraph | None = None) -> None:
        """Take in rows that came and rows that went; either may hold some of the tables."""
        said = self.files.read(MANIFEST)
        rows = [x for g, sign in ((added, 1), (removed, -1)) if g is not None for x in self._row_counts(g, sign)]
        counts = [x for g, sign in ((added, 1), (removed, -1)) if g is not None and (x := self._key_counts(g, sign)) is not None]
        parts, changes = list(said["parts"]), []
        if counts:
            more = reduce(DataFrame.unionByName, counts).groupBy("check", "key").agg(F.sum("nodes").alias("nodes"), F.sum("edges").alias("edges")).where("nodes <> 0 OR edges <> 0")
            name = self._write(more)
            new = self._read([name])
            if parts:
                touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most `buckets` numbers
                held = self._read(parts).where(F.col("bucket").isin(touched)).join(new.select("check", "key"), ["check", "key"], "left_semi").groupBy("check", "key").agg(F.sum("nodes").alias("nodes"), F.sum("edges").alias("edges"))
            else:
                held = new.limit(0).select("check", "key", "nodes", "edges")
            both = new.select("check", "key", F.col("nodes").alias("more_nodes"), F.col("edges").alias("more_edges")).join(held, ["check", "key"], "left").fillna(0, ["nodes", "edges"])
            changes, parts = [self._changes(both)], [*parts, name]
        totals = self._add({int(k): v for k, v in said["totals"].items()}, [*changes, *rows])
        self.files.write(MANIFEST, {"parts": parts, "totals": {str(k): v for k, v in totals.items()}})

    def compact(self) -> None:
        """Make the numbers of each key one row again; keys that nothing has any more go."""
        said = self.files.read(MANIFEST)
        if len(said["parts"]) > 1:
            summed = self._read(said["parts"]).groupBy("check", "key").agg(F.sum("nodes").alias("nodes"), F.sum("edges").alias("edges")).where("nodes <> 0 OR edges <> 0")
            self.files.write(MANIFEST, said | {"parts": [self._write(summed)]})

    def violations(self) -> DataFrame:
        """(code, label, violations) of all checks."""
        totals = self.files.read(MANIFEST)["totals"]
        return self.spark.createDataFrame([(code, label, totals.get(str(i), 0)) for i, (code, label) in enumerate(self.names)], "code string, label string, violations long")
