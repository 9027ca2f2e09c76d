"""A property graph: DataFrames bound to the concrete types of a model."""

from __future__ import annotations

import atexit
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.model import EdgeType, Model


def endpoint_columns(model: Model, edge: EdgeType, source: str, target: str) -> tuple[list[str], list[str]]:
    """Names of an edge table's key columns, src_<key> and dst_<key>, with `_` added while a property has the name."""
    taken = {p.name for p in edge.props}

    def names(side: str, node: str) -> list[str]:
        out = []
        for k in model.node(node).key:
            name = f"{side}_{k}"
            while name in taken:
                name += "_"
            taken.add(name)
            out.append(name)
        return out

    return names("src", source), names("dst", target)


def edge_tables(model: Model) -> list[tuple[str, str, str, str]]:
    """(edge, source type, target type, table name) of every concrete pair.

    An edge between concrete types keeps its name; others get EDGE_Source_Target. `_edge` tells a table from an equal name, case aside."""
    taken = {n.name.lower() for n in model.concrete()}
    out = []
    for e in model.edges:
        pairs = [(s.name, t.name) for s in model.leaves(e.source) for t in model.leaves(e.target)]
        plain = len(pairs) == 1 and pairs[0] == (e.source, e.target)
        for s, t in pairs:
            name = e.name if plain else f"{e.name}_{s}_{t}"
            while name.lower() in taken:
                name += "_edge"
            taken.add(name.lower())
            out.append((e.name, s, t, name))
    return out


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for checkpoints; on a local master without spark.checkpoint.dir a temporary one."""
    found = spark.sparkContext.getCheckpointDir()
    if not found:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            import tempfile

            found = tempfile.mkdtemp(prefix="graphloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found


class Workspace:
    """Tables that a run of an operator writes under the checkpoint folder; all but the kept ones go when the block ends, those when the Python process ends.

    A lost executor repeats its tasks from them, and plans that grow with rounds begin anew at each."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.root, self.paths = spark, f"{checkpoint_folder(spark).rstrip('/')}/work-{uuid.uuid4().hex}", []

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            remove_path(self.spark, path)

    def put(self, df: DataFrame, keep: bool = False) -> DataFrame:
        path = f"{self.root}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        if keep:
            atexit.register(remove_path, self.spark, path)
        else:
            self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of Spark's file system, if it is there."""
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
    except Exception:  # the JVM is gone: the folder's owner clears it
        pass


class PropertyGraph:
    """vertices: a DataFrame for each concrete node type; edges: one for each (edge, source type, target type)."""

    def __init__(self, model: Model, vertices: dict[str, DataFrame], edges: dict[tuple[str, str, str], DataFrame] | None = None) -> None:
        self.model, self.vertices, self.edges = model, dict(vertices), dict(edges or {})
        for name in self.vertices:
            if (node := model.node(name)) is None or node.abstract:
                raise ValueError(f"'{name}' is no concrete node type")
        for (e, s, t), df in self.edges.items():
            if (edge := model.edge(e)) is None:
                raise ValueError(f"'{e}' is no edge type")
            missing = {c for side in endpoint_columns(model, edge, s, t) for c in side} - set(df.columns)
            if missing:
                raise ValueError(f"{e} from {s} to {t} lacks {', '.join(sorted(missing))}")

    def bind_edge(self, edge: str, source: str, target: str, df: DataFrame, src: list[str], dst: list[str], **props: str) -> PropertyGraph:
        """An edge table as a projection of df: its source and target keys from the named columns, properties from others."""
        s, t = endpoint_columns(self.model, self.model.edge(edge), source, target)
        columns = [F.col(c).alias(n) for c, n in zip([*src, *dst], [*s, *t], strict=True)] + [F.col(c).alias(n) for n, c in props.items()]
        present = [F.col(c).isNotNull() for c in [*src, *dst]]
        return PropertyGraph(self.model, self.vertices, self.edges | {(edge, source, target): df.where(reduce(lambda a, b: a & b, present)).select(*columns)})

    def of_type(self, name: str) -> DataFrame:
        """All rows of a type, its descendants' too, with their `_type`; columns that a table lacks are null."""
        own = [self.vertices[n.name].withColumn("_type", F.lit(n.name)) for n in self.model.carriers(name) if n.name in self.vertices]
        if not own:
            raise KeyError(name)
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), own)

    def tables_of(self, edge: str) -> list[tuple[str, str, str]]:
        return [k for k in self.edges if k[0] == edge]

    def any_edge(self, *names: str) -> DataFrame:
        """The edge tables of one or more edges together, with `_edge`."""
        own = [self.edges[k].withColumn("_edge", F.lit(k[0])) for n in names for k in self.tables_of(n)]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), own)


def to_model(df: DataFrame, model: Model, name: str) -> DataFrame:
    """df's columns as the model types them; what can't be read as its type becomes null."""
    schema = model.schema(name)
    return df.select(*(F.col(f.name).try_cast(f.dataType).alias(f.name, metadata=f.metadata) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))
