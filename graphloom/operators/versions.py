"""A graph's tables on disk, by version: migrations that can be resumed, and readers that see one version whole.

A folder holds a subfolder for each version, `v<revision>`, with a Parquet table for each vertex and edge table, and the file
CURRENT, which names the version that readers open and the tables that belong to it. A migration writes the next version
beside the current one, table by table; a table is finished once its writer has put its _SUCCESS mark there. CURRENT is
replaced by one rename after the last table, so that a reader has either all old tables or all new ones, and one that has opened the old version
goes on with its files. When a run breaks, the next run of the same migration leaves finished tables alone and writes the rest; a run of another
migration to the same revision is refused. Old versions stay until they are dropped by name.

All files are written by Hadoop's file system, so the folder may be on any that Spark reads; the rename must be atomic there, as on
HDFS and local disks.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..plans.model import Model
from .graph import PropertyGraph, remove_path
from .migrate import migrate_graph

CURRENT, PLAN = "CURRENT", "PLAN"


class _Files:
    """Small files of a folder by Hadoop's file system."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.jvm, self.folder = spark.sparkContext._jvm, folder.rstrip("/")
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path().getFileSystem(self.conf)

    def path(self, name: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def there(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def read(self, name: str) -> dict | None:
        if not self.there(name):
            return None
        stream = self.fs.open(self.path(name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def write(self, name: str, value: dict) -> None:
        """Write beside the name and rename over it."""
        beside = self.path(f"{name}.new")
        stream = self.fs.create(beside, True)
        stream.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path().toUri(), self.conf)
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self.jvm.java.lang.reflect.Array.newInstance(rename.getClass(), 1)
        options[0] = rename
        context.rename(beside, self.path(name), options)


@dataclass(frozen=True)
class Version:
    """What CURRENT says: a revision, its folder, and the names of its tables by (node,) or (edge, source, target)."""

    revision: int
    folder: str
    tables: dict[tuple[str, ...], str]


def table_name(key: tuple[str, ...]) -> str:
    """A folder name that no two tables share: names of types are words, which hold no dash."""
    return "-".join(key)


def current(spark: SparkSession, folder: str) -> Version | None:
    """The version that readers open, or None before the first one."""
    said = _Files(spark, folder).read(CURRENT)
    return said and Version(said["revision"], said["folder"], {tuple(k.split("-")): v for k, v in said["tables"].items()})


def open_graph(spark: SparkSession, folder: str, model: Model) -> PropertyGraph:
    """The current version's tables, bound to the model of its revision."""
    version = current(spark, folder)
    if version is None:
        raise FileNotFoundError(f"{folder} holds no version of a graph")
    tables = {k: spark.read.parquet(f"{folder.rstrip('/')}/{version.folder}/{name}") for k, name in version.tables.items()}
    return PropertyGraph(model, {k[0]: df for k, df in tables.items() if len(k) == 1}, {k: df for k, df in tables.items() if len(k) == 3})


def _fingerprint(model: Model, source: int | None, along) -> str:
    """What a migration does, as far as a rerun must agree with it: where it starts, the model it leads to, and how ends move."""
    return hashlib.sha256(repr((source, model.nodes, model.edges, model.enums, sorted((along or {}).items(), key=str))).encode()).hexdigest()


def write_graph(graph: PropertyGraph, folder: str, revision: int, fingerprint: str | None = None) -> list[str]:
    """Write a graph as a version and make it the current one; the names of the tables that this run has written.

    Tables that an earlier run of the same migration has finished are left alone."""
    spark = next(iter((graph.vertices | graph.edges).values())).sparkSession
    files, at = _Files(spark, folder), f"v{revision}"
    fingerprint = fingerprint or _fingerprint(graph.model, None, None)
    now = current(spark, folder)
    if now and now.revision >= revision:
        if now.revision == revision and (files.read(f"{at}/{PLAN}") or {}).get("fingerprint") == fingerprint:
            return []
        raise ValueError(f"version {now.revision} is current: {revision} can't follow it")
    begun = files.read(f"{at}/{PLAN}")
    if begun and begun["fingerprint"] != fingerprint:
        raise ValueError(f"another migration to version {revision} has begun: drop it first")
    if not begun:
        files.write(f"{at}/{PLAN}", {"fingerprint": fingerprint})
    tables: dict[tuple[str, ...], DataFrame] = {(k,): df for k, df in graph.vertices.items()} | graph.edges
    written = []
    for key, df in sorted(tables.items()):
        name = table_name(key)
        if not files.there(f"{at}/{name}/_SUCCESS"):
            df.write.mode("overwrite").parquet(f"{files.folder}/{at}/{name}")  # what a broken run has left goes
            written.append(name)
    files.write(CURRENT, {"revision": revision, "folder": at, "tables": {table_name(k): table_name(k) for k in tables}})
    return written


def migrate_folder(spark: SparkSession, folder: str, before: Model, after: Model, along: dict[str, dict[str, str]] | None = None) -> list[str]:
    """Migrate the current version to the next one; the names of the tables that this run has written. `plan_migration` is asked first by the caller.

    A run after the last rename finds the migration done and writes nothing."""
    now = current(spark, folder)
    if now is None:
        raise FileNotFoundError(f"{folder} holds no version of a graph")
    files = _Files(spark, folder)
    done = (files.read(f"{now.folder}/{PLAN}") or {}).get("fingerprint")
    if done == _fingerprint(after, now.revision - 1, along):
        return []
    moved = migrate_graph(open_graph(spark, folder, before), after, along)
    return write_graph(moved, folder, now.revision + 1, _fingerprint(after, now.revision, along))


def drop_version(spark: SparkSession, folder: str, revision: int) -> None:
    """Remove a version that is not the current one: an old one, or a migration that was begun and given up."""
    now = current(spark, folder)
    if now and now.revision == revision:
        raise ValueError(f"version {revision} is current")
    remove_path(spark, f"{folder.rstrip('/')}/v{revision}")
