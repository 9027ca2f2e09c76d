"""Schemas inferred from labels, keys and foreign keys, as joins and windows over catalog DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ancestor_pairs(sets: DataFrame) -> DataFrame:
    """(label, ancestor) from `labels` arrays: every set with the label has the ancestor, and some set has the ancestor alone."""
    distinct = sets.select(F.array_sort(F.array_distinct("labels")).alias("labels")).distinct()
    n = distinct.select(F.explode("labels").alias("x")).groupBy("x").agg(F.count("*").alias("n"))
    # pairs within a label set: a set holds a handful of labels
    both = distinct.select(F.explode("labels").alias("y"), "labels").select("y", F.explode("labels").alias("x")).where("x <> y").groupBy("x", "y").agg(F.count("*").alias("both"))
    whole = both.join(n.withColumnsRenamed({"x": "y", "n": "n_y"}), "y").join(n.withColumnRenamed("n", "n_x"), "x")
    return whole.where("both = n_y AND n_x > both").select(F.col("y").alias("label"), F.col("x").alias("ancestor"))


def infer_hierarchy(sets: DataFrame) -> DataFrame:
    """(label, parent, abstract): the parent is the ancestor with most ancestors, then the first by name; abstract labels never stand alone."""
    up = ancestor_pairs(sets)
    depth = up.groupBy("label").agg(F.count("*").alias("depth"))
    deep = up.join(depth.withColumnRenamed("label", "ancestor"), "ancestor", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    parent = deep.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("depth"), "ancestor"))).where("r = 1").select("label", F.col("ancestor").alias("parent"))
    distinct = sets.select(F.array_sort(F.array_distinct("labels")).alias("labels")).distinct()
    labels = distinct.select(F.explode("labels").alias("label")).distinct()
    own = labels.join(up, "label", "left").groupBy("label").agg(F.collect_set("ancestor").alias("up")).select("label", F.array_sort(F.array_union(F.array("label"), "up")).alias("labels"))
    alone = own.join(distinct, "labels", "left_semi").select("label", F.lit(False).alias("abstract"))
    return labels.join(parent, "label", "left").join(alone, "label", "left").select("label", "parent", F.coalesce("abstract", F.lit(True)).alias("abstract"))


def specific(sets: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(set_id, label): the labels of a set (set_id, labels) that are no other's ancestor in it."""
    each = sets.select("set_id", F.explode("labels").alias("label"))
    above = each.join(ancestors, "label").select("set_id", F.col("ancestor").alias("label"))
    return each.join(above, ["set_id", "label"], "left_anti")


def nearest_common(names: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(group, common) of (group, label): the deepest type that all labels of a group are or descend from; null if there is none."""
    self_ = names.select(F.col("label").alias("label"), F.col("label").alias("ancestor")).distinct()
    lines = ancestors.unionByName(self_).distinct()
    depth = ancestors.groupBy("label").agg(F.count("*").alias("depth")).withColumnRenamed("label", "ancestor")
    distinct = names.distinct()
    size = distinct.groupBy("group").agg(F.count("*").alias("n"))
    shared = distinct.join(lines, "label").groupBy("group", "ancestor").agg(F.count("*").alias("k")).join(size, "group").where("k = n").join(depth, "ancestor", "left")
    best = shared.withColumn("r", F.row_number().over(Window.partitionBy("group").orderBy(F.desc(F.coalesce("depth", F.lit(0))), "ancestor"))).where("r = 1")
    return size.select("group").join(best.select("group", F.col("ancestor").alias("common")), "group", "left")


def collapse_edges(observed: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(type, src, dst): the one declaration of each edge type that was observed between several labels."""
    side = lambda c: nearest_common(observed.select(F.col("type").alias("group"), F.col(c).alias("label")), ancestors).select(F.col("group").alias("type"), F.col("common").alias(c))
    return side("src").join(side("dst"), "type")


def rank_keys(candidates: DataFrame, style: str = "indexed") -> DataFrame:
    """Candidates (owner, name, columns, complete, and indexed / declared / generated / position by style), with their rank; 1 is the key.

    indexed: complete candidates, indexed first, then fewest columns, then columns by name.
    declared: declared keys first, then 4 for complete plus 2 for a generated name.
    earliest: complete candidates by position of their index."""
    order = {
        "indexed": [F.desc("indexed"), F.size("columns"), F.array_join("columns", ",")],
        "declared": [F.desc("declared"), F.desc(F.col("complete").cast("int") * 4 + F.col("generated").cast("int") * 2), "name"] if style == "declared" else [],
        "earliest": ["position", "name"],
    }[style]
    able = candidates if style == "declared" else candidates.where("complete")
    return able.withColumn("rank", F.row_number().over(Window.partitionBy("owner").orderBy(*order)))


def live_constraints(constraints: DataFrame) -> DataFrame:
    """Without those whose building failed or has not ended."""
    return constraints.where("status = 'OPERATIONAL'")


def hoist(props: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """(parent, name, signature): properties (label, name, signature, is_key) that all children of a parent share alike, if it has two or more; keys of all children always move."""
    child = hierarchy.where("parent IS NOT NULL").select("label", "parent")
    size = child.groupBy("parent").agg(F.count("*").alias("n"))
    shared = props.join(child, "label").groupBy("parent", "name", "signature").agg(F.count_distinct("label").alias("k"), F.min(F.col("is_key").cast("int")).alias("key"))
    return shared.join(size, "parent").where("k = n AND (n >= 2 OR key = 1)").select("parent", "name", "signature")


def merge_shapes(shapes: DataFrame) -> DataFrame:
    """Bounds (path, min, max, min_count, max_count) of several shapes of a path: the tighter wins. A path with no max_count of 1 is a list."""
    merged = shapes.groupBy("path").agg(F.max("min").alias("min"), F.min("max").alias("max"), F.max("min_count").alias("min_count"), F.min("max_count").alias("max_count"))
    return merged.withColumn("is_list", F.col("max_count").isNull() | (F.col("max_count") > 1))


def foreign_key_edges(table: DataFrame, key: list[str], reference: list[str]) -> DataFrame:
    """Edges src_<key> -> dst_<column> of a child table's foreign key; rows that refer to nothing have no edge."""
    present = [F.col(c).isNotNull() for c in reference]
    df = table
    for p in present:
        df = df.where(p)
    return df.select(*(F.col(c).alias(f"src_{c}") for c in key), *(F.col(c).alias(f"dst_{c}") for c in reference))


def join_table_edges(table: DataFrame, source: list[str], target: list[str]) -> DataFrame:
    """Edges of a join table; the columns that are in neither key become properties."""
    rest = [c for c in table.columns if c not in (*source, *target)]
    return table.select(*(F.col(c).alias(f"src_{c}") for c in source), *(F.col(c).alias(f"dst_{c}") for c in target), *rest)
