"""A model from data alone: sketches of labelled elements, and what types, keys, parents and edges they show.

Elements are DataFrames as in `profile`: vertices (id, labels, props map of texts) and edges (src, dst, type, props). One pass over the
vertices gives, for each set of labels and property, how many elements there are and have it, how many of its values read as
each scalar type, the bounds of those that are numbers, and an HLL sketch of its distinct values. Such sketches merge, so
catalogs of parts of the data, of days for instance, add up without the data. Properties that look unique by their sketch are
confirmed by one exact aggregate. Edges are counted by end and type for the pairs of labels and the multiplicity.

Sketches and catalogs have a row for each set of labels and property, as a schema does; a model is built from them on the
driver. Null or empty property maps count as elements without properties, null values as absent. Elements without labels are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.types import parse_type
from ..plans.model import MANY, ONE, EdgeType, Model, NodeType, Property
from . import infer

#: How texts of scalar types look (fixed patterns), narrowest first; a property has the first type that all its values read as.
LOOKS = {
    "int": r"^[+-]?[0-9]{1,18}$",
    "float": r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$",
    "boolean": "^(true|false)$",
    "date": "^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
    "datetime": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?$",
}
#: How far below the number of elements the estimate of a unique property may lie: five standard errors of a sketch of 2^12 slots.
SLACK, SLOTS = 0.08, 12


def _sorted_labels() -> Column:
    return F.array_sort(F.array_distinct(F.coalesce("labels", F.array().cast("array<string>"))))


def sketch(elements: DataFrame, by: Column | None = None) -> DataFrame:
    """(owner, key, n, <type>..., low, high, distinct): for each owner (the sorted labels, or `by`) its number of elements under a null key, and the sketch of each property. Partial aggregates of one pass."""
    owner = (_sorted_labels() if by is None else by).alias("owner")
    entries = F.concat(F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value"))), F.coalesce(F.map_entries("props"), F.expr("CAST(array() AS array<struct<key:string,value:string>>)")))
    each = elements.select(owner, F.inline(entries)).where("key IS NULL OR value IS NOT NULL")
    each = each if by is not None else each.where(F.size("owner") > 0)
    number = F.when(F.col("value").rlike(LOOKS["float"]), F.col("value").try_cast("double"))
    return each.groupBy("owner", "key").agg(
        F.count("*").alias("n"), *(F.count_if(F.col("value").rlike(look)).alias(kind) for kind, look in LOOKS.items()), F.min(number).alias("low"), F.max(number).alias("high"), F.hll_sketch_agg(F.coalesce("value", F.lit("")), F.lit(SLOTS)).alias("distinct")
    )


def merge(*sketches: DataFrame) -> DataFrame:
    """The sketch of all elements from the sketches of their parts."""
    every = reduce(DataFrame.unionByName, sketches)
    return every.groupBy("owner", "key").agg(*(F.sum(c).alias(c) for c in ("n", *LOOKS)), F.min("low").alias("low"), F.max("high").alias("high"), F.hll_union_agg("distinct").alias("distinct"))


def properties(sketches: DataFrame) -> DataFrame:
    """(owner, key, type, required, low, high, n, about): the type, whether all elements have it, bounds of numbers, values, and about how many different ones."""
    total = sketches.where("key IS NULL").select("owner", F.col("n").alias("total"))
    kind = reduce(lambda rest, k: F.when(F.col(k) == F.col("n"), k).otherwise(rest), reversed(LOOKS), F.lit("string"))
    numeric = lambda c: F.when(F.col("type").isin("int", "float"), F.col(c)).alias(c)
    typed = sketches.where("key IS NOT NULL").join(F.broadcast(total), "owner")  # a row for each set of labels
    return typed.select("owner", "key", kind.alias("type"), (F.col("n") == F.col("total")).alias("required"), "low", "high", "n", F.hll_sketch_estimate("distinct").alias("about")).select("owner", "key", "type", "required", numeric("low"), numeric("high"), "n", "about")


def unique_properties(vertices: DataFrame, found: DataFrame) -> DataFrame:
    """(owner, key) of the required properties of `found` that no two elements share: those that look so by their sketch, confirmed by counting their values."""
    likely = found.where(F.col("required") & (F.col("about") >= F.col("n") * (1 - SLACK))).select("owner", "key")
    each = vertices.select(_sorted_labels().alias("owner"), F.explode("props").alias("key", "value")).where("value IS NOT NULL")
    repeated = each.join(F.broadcast(likely), ["owner", "key"]).groupBy("owner", "key", "value").agg(F.count("*").alias("n")).where("n > 1").select("owner", "key").distinct()
    return likely.join(repeated, ["owner", "key"], "left_anti")


def keys(found: DataFrame, unique: DataFrame) -> DataFrame:
    """(owner, key): of the unique properties of each set of labels the one to be its key: whole numbers first, then by name."""
    order = Window.partitionBy("owner").orderBy(F.desc(F.col("type") == "int"), "key")
    return found.join(unique, ["owner", "key"]).withColumn("rank", F.row_number().over(order)).where("rank = 1").select("owner", "key")


def own_labels(sets: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(owner, label): the label of each set that is no other's ancestor; of several the first by name."""
    each = sets.select("owner", F.explode("owner").alias("label"))
    above = each.join(ancestors, "label").select("owner", F.col("ancestor").alias("label")).distinct()
    return each.join(above, ["owner", "label"], "left_anti").groupBy("owner").agg(F.min("label").alias("label"))


def edge_ends(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(type, src_owner, dst_owner, n): the sets of labels that each edge type connects; edges without an element at one end are left out."""
    end = lambda side: vertices.select(F.col("id").alias(side), _sorted_labels().alias(f"{side}_owner"))
    return edges.select("src", "dst", "type").join(end("src"), "src").join(end("dst"), "dst").groupBy("type", "src_owner", "dst_owner").agg(F.count("*").alias("n"))


def multiplicities(edges: DataFrame) -> DataFrame:
    """(type, out, into): the most edges of a type that leave one element, and that enter one."""
    most = lambda side, name: edges.groupBy("type", side).agg(F.count("*").alias("n")).groupBy("type").agg(F.max("n").alias(name))
    return most("src", "out").join(most("dst", "into"), "type")


class Catalog:
    """What labelled elements show: DataFrames with a few rows for each type, worked out from the sketches."""

    def __init__(self, vertices: DataFrame, edges: DataFrame, sketches: DataFrame | None = None) -> None:
        self.vertices, self.edges = vertices, edges
        self.sketches = sketch(vertices) if sketches is None else sketches
        self.sets = self.sketches.where("key IS NULL").select("owner", "n")
        self.properties = properties(self.sketches)
        labels = self.sets.select(F.col("owner").alias("labels"))
        self.ancestors = infer.ancestor_pairs(labels)
        self.labels = own_labels(self.sets, self.ancestors)
        self.hierarchy = infer.infer_hierarchy(labels)

    def types(self) -> DataFrame:
        """(label, parent, abstract, key) of every label; key is null where no property is unique."""
        key = keys(self.properties, unique_properties(self.vertices, self.properties)).join(self.labels, "owner").select("label", "key")
        return self.hierarchy.join(key, "label", "left").select("label", "parent", "abstract", "key")

    def declared(self) -> DataFrame:
        """(label, key, type, required, low, high) of the properties of each label that elements have as their own; a label of several sets has the union."""
        own = self.properties.join(self.labels, "owner")
        sizes = self.labels.groupBy("label").agg(F.count("*").alias("sets"))
        one = own.groupBy("label", "key").agg(F.collect_set("type").alias("types"), F.min("required").alias("required"), F.min("low").alias("low"), F.max("high").alias("high"), F.count("*").alias("k"))
        kind = F.when(F.size("types") == 1, F.element_at("types", 1)).when(F.size(F.array_except("types", F.array(F.lit("int"), F.lit("float")))) == 0, "float").otherwise("string")
        typed = one.join(sizes, "label").select("label", "key", kind.alias("type"), (F.col("required") & (F.col("k") == F.col("sets"))).alias("required"), "low", "high")
        numeric = lambda c: F.when(F.col("type").isin("int", "float"), F.col(c)).alias(c)
        return typed.select("label", "key", "type", "required", numeric("low"), numeric("high"))

    def relations(self) -> DataFrame:
        """(type, src, dst, cardinality) of the edge types: ends are the nearest types that all observed ones are or descend from, null without one."""
        ends = edge_ends(self.vertices, self.edges)
        named = ends.join(self.labels.selectExpr("owner AS src_owner", "label AS src"), "src_owner").join(self.labels.selectExpr("owner AS dst_owner", "label AS dst"), "dst_owner").select("type", "src", "dst").distinct()
        many = lambda c: F.when(F.col(c) > 1, "many").otherwise("one")
        return infer.collapse_edges(named, self.ancestors).join(multiplicities(self.edges).select("type", F.concat(many("into"), F.lit("-to-"), many("out")).alias("cardinality")), "type")

    def model(self, prefix: str = "found", iri: str = "https://example.org/found#", bounds: bool = False) -> Model:
        """The model that the rows above spell out. bounds: whether numbers get the range that was seen."""
        types, declared, relations = ([r.asDict() for r in df.collect()] for df in (self.types(), self.declared(), self.relations()))  # as many rows as a schema has entries
        up = {t["label"]: t["parent"] for t in types}

        def line(label: str) -> tuple[str, ...]:
            return (up[label], *line(up[label])) if up.get(label) else ()

        nodes = []
        for t in sorted(types, key=lambda t: t["label"]):
            own = tuple(
                Property(p["key"], parse_type(p["type"]), id=f"p_{t['label']}_{p['key']}", required=p["required"], unique=False, min=p["low"] if bounds else None, max=p["high"] if bounds else None) for p in sorted(declared, key=lambda p: p["key"]) if p["label"] == t["label"]
            )
            nodes.append(NodeType(t["label"], id=f"n_{t['label']}", abstract=t["abstract"], extends=t["parent"], ancestors=line(t["label"]), key=(t["key"],) if t["key"] else (), props=own))
        ends = {"one": ONE, "many": MANY}
        edges = [EdgeType(r["type"], r["src"], r["dst"], id=f"e_{r['type']}", sources=ends[r["cardinality"].split("-to-")[0]], targets=ends[r["cardinality"].split("-to-")[1]]) for r in sorted(relations, key=lambda r: r["type"]) if r["src"] and r["dst"]]
        return Model(prefix=prefix, iri=iri, nodes=tuple(nodes), edges=tuple(edges))
