"""Drift: the catalog that a model declares against one that is found, as full outer joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import spark_type
from ..plans.model import Model
from .graph import PropertyGraph, edge_tables, endpoint_columns

COLUMNS = "table string, column string, type string, required boolean, key int"
CONSTRAINTS = "owner string, kind string, props array<string>, detail string"
ENDPOINTS = "edge string, source string, target string, multiplicity string"


def expected_columns(spark: SparkSession, model: Model) -> DataFrame:
    """A row for each column of each table that the model's leaf layout has; key is the place in the primary key, from 1."""
    rows = []
    for n in model.concrete():
        rows += [(n.name, p.name, spark_type(p.type).simpleString(), p.required or p.name in n.key, n.key.index(p.name) + 1 if p.name in n.key else None) for p in n.props]
    for e, s, t, name in edge_tables(model):
        edge = model.edge(e)
        for node, columns in zip((s, t), endpoint_columns(model, edge, s, t), strict=True):
            rows += [(name, c, spark_type(model.node(node).prop(k).type).simpleString(), True, None) for k, c in zip(model.node(node).key, columns, strict=True)]
        rows += [(name, p.name, spark_type(p.type).simpleString(), p.required, None) for p in edge.props]
    return spark.createDataFrame(rows, COLUMNS)


def found_columns(spark: SparkSession, tables: dict[str, DataFrame | T.StructType]) -> DataFrame:
    """The same of DataFrames or schemas; they declare no keys."""
    rows = []
    for name, found in tables.items():
        for f in found if isinstance(found, T.StructType) else found.schema:
            rows.append((name, f.name, f.dataType.simpleString(), not f.nullable, None))
    return spark.createDataFrame(rows, COLUMNS)


def catalog_columns(spark: SparkSession, database: str | None = None) -> DataFrame:
    """The same of the session catalog's tables."""
    return found_columns(spark, {t.name: spark.table(t.name if t.isTemporary else f"`{t.namespace[-1]}`.`{t.name}`").schema for t in spark.catalog.listTables(database)})


def _plain(column: str):
    return F.upper(F.regexp_replace(column, r"\s+", ""))


def column_drift(expected: DataFrame, found: DataFrame, compare_required: bool = False, compare_keys: bool = False) -> DataFrame:
    """(kind, object, detail): missing and unexpected tables and columns, and columns that differ. Types are compared without case and blanks."""
    tables = lambda df: df.select("table").distinct()
    lost = tables(expected).join(tables(found), "table", "left_anti").select(F.lit("missing").alias("kind"), F.concat(F.lit("table "), "table").alias("object"), F.lit("declared but not found").alias("detail"), "table")
    new = tables(found).join(tables(expected), "table", "left_anti").select(F.lit("unexpected").alias("kind"), F.concat(F.lit("table "), "table").alias("object"), F.lit("found but not declared").alias("detail"), "table")
    both = tables(expected).join(tables(found), "table", "left_semi")
    side = lambda df, tag: df.join(both, "table", "left_semi").select("table", "column", *(F.col(c).alias(f"{tag}_{c}") for c in ("type", "required", "key")), F.lit(True).alias(f"in_{tag}"))
    pairs = side(expected, "e").join(side(found, "f"), ["table", "column"], "full_outer")
    name = F.concat_ws(".", "table", "column")
    differs = _plain("e_type") != _plain("f_type")
    detail = F.concat(F.lit("declared "), "e_type", F.lit(", found "), "f_type")
    if compare_required:
        detail = F.when(differs, detail).otherwise(F.concat(F.lit("required: declared "), F.col("e_required").cast("string"), F.lit(", found "), F.col("f_required").cast("string")))
        differs = differs | (F.col("e_required") != F.col("f_required"))
    kind = F.when(F.col("in_f").isNull(), "missing").when(F.col("in_e").isNull(), "unexpected").when(differs, "different")
    why = F.when(F.col("in_f").isNull(), F.concat(F.lit("declared "), "e_type")).when(F.col("in_e").isNull(), F.concat(F.lit("found "), "f_type")).otherwise(detail)
    columns = pairs.select(kind.alias("kind"), F.concat(F.lit("column "), name).alias("object"), why.alias("detail")).where("kind IS NOT NULL")
    out = lost.drop("table").unionByName(new.drop("table")).unionByName(columns)
    if compare_keys:
        key = lambda df, tag: df.where("key IS NOT NULL").groupBy("table").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "column"))), lambda x: x["column"]), ", ").alias(tag))
        keys = both.join(key(expected, "e"), "table", "left").join(key(found, "f"), "table", "left").where(~F.col("e").eqNullSafe(F.col("f")))
        out = out.unionByName(keys.select(F.lit("different").alias("kind"), F.concat(F.lit("key of "), "table").alias("object"), F.concat(F.lit("declared ("), F.coalesce("e", F.lit("")), F.lit("), found ("), F.coalesce("f", F.lit("")), F.lit(")")).alias("detail")))
    return out


def expected_constraints(spark: SparkSession, model: Model) -> DataFrame:
    """Keys, unique and required properties and enums, each told by its structure, never by a name."""
    rows = []
    for n in model.concrete():
        if n.key:
            rows.append((n.name, "key", sorted(n.key), ""))
        rows += [(n.name, "unique", [p.name], "") for p in n.props if p.unique] + [(n.name, "required", [p.name], "") for p in n.props if p.required]
    rows += [("", "enum", [x.name], "|".join(x.values)) for x in model.enums]
    return spark.createDataFrame(rows, CONSTRAINTS)


def constraint_drift(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(kind, object, detail) of constraints; enums' values are compared in order."""
    keyed = lambda df, tag: df.select("owner", "kind", F.array_join(F.array_sort("props"), ",").alias("props"), F.col("detail").alias(tag), F.lit(True).alias(f"in_{tag}")).distinct()
    pairs = keyed(expected, "e").join(keyed(found, "f"), ["owner", "kind", "props"], "full_outer")
    verdict = F.when(F.col("in_f").isNull(), "missing").when(F.col("in_e").isNull(), "unexpected").when(F.col("e") != F.col("f"), "different")
    name = F.concat(F.col("kind"), F.lit(" "), "owner", F.lit("("), "props", F.lit(")"))
    return pairs.select(verdict.alias("verdict"), name.alias("object"), F.concat_ws(" -> ", "e", "f").alias("detail")).where("verdict IS NOT NULL").withColumnRenamed("verdict", "kind")


def flatten_indexes(indexes: DataFrame) -> DataFrame:
    """(owner, prop) of indexes (owner, props): one row for each indexed property."""
    return indexes.select("owner", F.explode("props").alias("prop")).distinct()


def expected_endpoints(spark: SparkSession, model: Model) -> DataFrame:
    """A row for each edge type and pair of concrete types that it joins; multiplicity (one-to-many and so on) as the bounds of its ends allow."""
    end = lambda bound: "one" if bound.most == 1 else "many"
    return spark.createDataFrame([(e, s, t, f"{end(model.edge(e).sources)}-to-{end(model.edge(e).targets)}") for e, s, t, _ in edge_tables(model)], ENDPOINTS)


def found_endpoints(graph: PropertyGraph) -> DataFrame:
    """The same of a graph's edge tables: pairs that have rows, and the multiplicity that the rows of all of an edge's tables show.

    Rows without a key at one end join nothing and don't count; parallel edges count one by one. The ends at a type are counted by the type's own key columns."""
    model, there, ends = graph.model, [], {}
    for (e, s, t), df in graph.edges.items():
        sides = endpoint_columns(model, model.edge(e), s, t)
        whole = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in sides[0] + sides[1]]))
        there.append(whole.agg(F.count("*").alias("n")).where("n > 0").select(F.lit(e).alias("edge"), F.lit(s).alias("source"), F.lit(t).alias("target")))
        for node, columns, end in zip((s, t), sides, ("targets", "sources"), strict=True):
            ends.setdefault((e, node, end), []).append(whole.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(columns))))
    most = [reduce(DataFrame.unionByName, own).groupBy(*own[0].columns).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).select(F.lit(e).alias("edge"), F.lit(end).alias("end"), "n") for (e, _, end), own in ends.items()]
    many = lambda end: F.when(F.max(F.when(F.col("end") == end, F.col("n"))) > 1, "many").otherwise("one")
    shown = reduce(DataFrame.unionByName, most).groupBy("edge").agg(F.concat_ws("-to-", many("sources"), many("targets")).alias("multiplicity"))
    return reduce(DataFrame.unionByName, there).join(shown, "edge", "left").select("edge", "source", "target", "multiplicity")


def endpoint_drift(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(kind, object, detail): pairs of types that an edge is declared to join or joins, but not both, and edges of another multiplicity. A null multiplicity is unknown and differs from none."""
    ends = ["edge", "source", "target"]
    side = lambda df, tag: df.select(*ends, F.lit(True).alias(tag)).distinct()
    lost = F.col("f").isNull()
    pairs = side(expected, "e").join(side(found, "f"), ends, "full_outer").where("e IS NULL OR f IS NULL")
    out = pairs.select(F.when(lost, "missing").otherwise("unexpected").alias("kind"), F.concat(F.lit("endpoints "), "edge", F.lit(" "), "source", F.lit("->"), "target").alias("object"), F.when(lost, "declared but not found").otherwise("found but not declared").alias("detail"))
    shown = lambda df, tag: df.where("multiplicity IS NOT NULL").select("edge", F.col("multiplicity").alias(tag)).distinct()
    other = shown(expected, "e").join(shown(found, "f"), "edge").where("e <> f")
    return out.unionByName(other.select(F.lit("different").alias("kind"), F.concat(F.lit("multiplicity of "), "edge").alias("object"), F.concat(F.lit("declared "), "e", F.lit(", found "), "f").alias("detail")))


def drift(spark: SparkSession, model: Model, tables: dict[str, DataFrame | T.StructType]) -> DataFrame:
    return column_drift(expected_columns(spark, model), found_columns(spark, tables))
