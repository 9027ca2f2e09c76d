"""What data says about itself: label sets, keys and types, endpoints, counts and frequencies.

Elements are DataFrames with `id`, `labels` (array) and `props` (a map or a JSON text); edges also have `type`, `src` and `dst`."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import Workspace

SAMPLE = 1000


def counts(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(element, n) of nodes and edges."""
    one = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("element"), "n")
    return one("nodes", vertices).unionByName(one("edges", edges))


def sample(df: DataFrame, limit: int | None = SAMPLE, key: str = "id") -> DataFrame:
    """The first rows by key; the limit is the operator's feature, None reads all."""
    return df if limit is None else df.orderBy(key).limit(limit)


def label_sets(vertices: DataFrame, limit: int | None = None) -> DataFrame:
    """The distinct label sets, each sorted."""
    return sample(vertices, limit).select(F.array_sort("labels").alias("labels")).distinct()


def pairs(df: DataFrame, props: str = "props") -> DataFrame:
    """df with a row for each property: key and value_type. JSON texts are told apart by their values' types, maps by the map's."""
    kind = df.schema[props].dataType
    if isinstance(kind, T.MapType):
        each = df.select("*", F.explode(F.map_entries(props)).alias("_p")).where("_p.value IS NOT NULL")
        return each.select("*", F.col("_p.key").alias("key"), F.typeof("_p.value").alias("value_type")).drop("_p")
    each = df.select("*", F.explode(F.json_object_keys(props)).alias("key")).withColumn("_v", F.variant_get(F.parse_json(props), F.lit("$"), "map<string,variant>"))
    return each.withColumn("value_type", F.lower(F.schema_of_variant(F.element_at("_v", F.col("key"))))).drop("_v")


def keys_types(vertices: DataFrame, limit: int | None = None, props: str = "props", by: str | None = None) -> DataFrame:
    """The distinct (key, value_type), for each `by` if given."""
    return pairs(sample(vertices, limit), props).select(*([by] if by else []), "key", "value_type").distinct()


def endpoints(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """The distinct (type, src_labels, dst_labels)."""
    end = lambda side: vertices.select(F.col("id").alias(side), F.array_sort("labels").alias(f"{side}_labels"))
    return edges.join(end("src"), "src").join(end("dst"), "dst").select("type", "src_labels", "dst_labels").distinct()


def census(vertices: DataFrame, props: str = "props") -> DataFrame:
    """For each label set its rows and its sorted set of (key, type)."""
    return pairs(vertices, props).groupBy(F.array_sort("labels").alias("labels")).agg(F.array_sort(F.collect_set(F.struct("key", "value_type"))).alias("properties"), F.count_distinct("id").alias("n"))


def _numbered(df: DataFrame, *order) -> DataFrame:
    """df with `rank`, its place in an order: rows are dealt out by ranges of the order, numbered within each, and moved on by the rows of the ranges before it, so no task has all of them."""
    spark = df.sparkSession
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = Workspace(spark).put(dealt.withColumns({"_part": F.spark_partition_id(), "_in": F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33) + 1}), keep=True)
    sizes = sorted((r["_part"], r["n"]) for r in ordered.groupBy("_part").agg(F.count("*").alias("n")).collect())  # a number for each range
    before = list(accumulate([0, *(n for _, n in sizes)]))
    moved = spark.createDataFrame([(p, b) for (p, _), b in zip(sizes, before, strict=False)], "_part int, _before long")
    return ordered.join(F.broadcast(moved), "_part").withColumn("rank", F.col("_before") + F.col("_in")).drop("_part", "_in", "_before")


def type_ranking(df: DataFrame, *by: str, of: str, ties: bool = False) -> DataFrame:
    """(by..., of, n, rank): values of `of` by frequency, then by value; `ambiguous` marks a first place that is shared.

    Without `by` all values are ranked together, over ranges of the order; they lie in a table under the checkpoint folder until the Python process ends."""
    n = df.groupBy(*by, of).agg(F.count("*").alias("n"))
    if not by:
        ranked = _numbered(n, F.desc("n"), F.col(of))
        if ties:
            most = ranked.orderBy("rank").limit(2).collect()
            ranked = ranked.withColumn("ambiguous", F.lit(len(most) == 2 and most[0]["n"] == most[1]["n"]))
        return ranked
    w = Window.partitionBy(*by)
    ranked = n.withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), F.col(of))))
    if ties:
        top = F.max("n").over(w)
        ranked = ranked.withColumn("ambiguous", F.sum((F.col("n") == top).cast("int")).over(w) > 1)
    return ranked


def truncated(df: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """(total, sampled, truncated) of a sample of that size."""
    return df.agg(F.count("*").alias("total")).select("total", F.least("total", F.lit(limit)).cast("long").alias("sampled"), (F.col("total") > limit).alias("truncated"))


def census_edges(edges: DataFrame, props: str = "props") -> DataFrame:
    """The distinct (type, key, value_type) of edges."""
    return pairs(edges, props).select("type", "key", "value_type").distinct()
