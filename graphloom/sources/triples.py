"""Graphs as triples: statements (s, p, o) in a DataFrame become vertex and edge tables of a model, and tables become statements.

Subjects and predicates are IRIs; an object is an IRI in angle brackets or a literal's text, as `read_ntriples` gives them.
A node type's IRI is its own or the model's namespace with its name, a property's or edge's the namespace with its name. A subject is
of a type if a statement says so of the type or of a class below it: subclass statements are closed by joins of the newest pairs, in
written tables. All properties of all subjects are gathered by one aggregate by subject; a type's table is a filter
of it. Edges are the statements of the edge's predicate whose two ends are subjects of fitting types, joined with their keys.

A literal that can't be read as its property's type becomes null, which audits tell. Of several values of a property that is no
list the least counts; statements repeated are one. Subjects of several concrete types are in each of their tables. Statements with other predicates are left
out; a null subject, predicate or object is no statement.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.types import spark_type
from ..operators.graph import PropertyGraph, endpoint_columns
from ..operators.match import reachable
from ..plans.model import Model
from ..plans.resolve import model_of

#: Terms of the vocabularies (fixed values).
TYPE, SUBCLASS = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "http://www.w3.org/2000/01/rdf-schema#subClassOf"
SCHEMA = "s string, p string, o string"
_LINE = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*")'
_CLASSES = """
namespace: { prefix: c, iri: "https://example.org/classes#" }
nodes: { Class: { key: [iri], props: { iri: { type: string, required: true } } } }
edges: { BELOW: { from: Class, to: Class } }
"""


def type_iri(model: Model, name: str) -> str:
    return model.node(name).iri or model.iri + name


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """The statements of N-Triples files, line by line; datatypes and languages of literals are dropped, comments and broken lines too."""
    part = lambda i: F.regexp_extract("value", _LINE, i)
    bare = lambda c: F.regexp_replace(c, "^<(.*)>$", "$1")
    text = reduce(lambda c, x: F.regexp_replace(c, x[0], x[1]), [(r"(?<!\\)((?:\\\\)*)\\n", "$1\n"), (r"(?<!\\)((?:\\\\)*)\\t", "$1\t"), (r"(?<!\\)((?:\\\\)*)\\r", "$1\r")], part(3))
    literal = F.regexp_replace(F.regexp_extract(text, r'^"((?:[^"\\]|\\.|\n)*)"$', 1), r"\\(.)", "$1")
    rows = spark.read.text(path).where(F.col("value").rlike(_LINE))
    return rows.select(bare(part(1)).alias("s"), part(2).alias("p"), F.when(part(3).startswith('"'), literal).otherwise(part(3)).alias("o"))


def subclasses(triples: DataFrame) -> DataFrame:
    """(sub, super) of the subclass statements, closed, without a class and itself."""
    m, said = model_of(_CLASSES), triples.where(F.col("p") == SUBCLASS).select(F.col("s").alias("src_iri"), _iri("o").alias("dst_iri")).dropna().distinct()
    g = PropertyGraph(m, {"Class": said.select(F.col("src_iri").alias("iri")).union(said.select("dst_iri")).distinct()}, {("BELOW", "Class", "Class"): said})
    return reachable(g, "BELOW").where("src_iri <> dst_iri").select(F.col("src_iri").alias("sub"), F.col("dst_iri").alias("super"))


def _iri(column: str) -> Column:
    """An object that is an IRI without its brackets, null for literals; blank nodes stay as they are."""
    c = F.col(column)
    return F.when(c.startswith("<"), F.regexp_replace(c, "^<(.*)>$", "$1")).when(c.startswith("_:"), c)


def types_of(triples: DataFrame) -> DataFrame:
    """(s, class): the classes that each subject is of, those above the stated ones too."""
    said = triples.where(F.col("p") == TYPE).select("s", _iri("o").alias("class")).dropna().distinct()
    above = said.join(subclasses(triples), said["class"] == F.col("sub")).select("s", F.col("super").alias("class"))
    return said.unionByName(above).distinct()


def _reader(kind):
    return lambda x: x.try_cast(kind)


def from_triples(triples: DataFrame, model: Model) -> PropertyGraph:
    """The statements as the model's tables; types and edges that no statement is of have empty ones."""
    statements = triples.dropna(subset=["s", "p", "o"])
    classes = types_of(statements).select("s", "class")
    owned: dict[str, list] = {}
    for n in model.concrete():
        for p in n.props:
            owned.setdefault(p.name, []).append(p)
    iris = {model.iri + name: name for name in owned}
    values = statements.where(F.col("p").isin(*iris))
    picked = [F.sort_array(F.collect_set(F.when(F.col("p") == iri, F.col("o")))).alias(name) for iri, name in iris.items()]
    stated = statements.where(F.col("p") == TYPE).select("s").distinct()
    wide = stated.join(values.groupBy("s").agg(*picked), "s", "left")
    keyed, vertices = {}, {}
    for n in model.concrete():
        own = classes.where(F.col("class") == type_iri(model, n.name)).select("s")
        below = [d for d in model.descendants(n.name) if not d.abstract]
        if below:  # a row lies in the table of its most special type
            own = own.join(classes.where(F.col("class").isin(*(type_iri(model, d.name) for d in below))).select("s").distinct(), "s", "left_anti")
        rows = wide.join(own, "s", "left_semi")
        columns = []
        for p in n.props:
            kind, texts = spark_type(p.type), F.col(f"`{p.name}`")
            if p.type.kind in ("list", "array"):
                columns.append(F.when(F.size(texts) > 0, F.transform(texts, _reader(spark_type(p.type.item)))).alias(p.name))
            else:
                columns.append(F.try_element_at(texts, F.lit(1)).try_cast(kind).alias(p.name))
        keyed[n.name] = rows.select("s", *columns)
        vertices[n.name] = keyed[n.name].drop("s")
    edges = {}
    for e in model.edges:
        links = statements.where(F.col("p") == model.iri + e.name).select("s", _iri("o").alias("o")).dropna().distinct()
        for s in model.leaves(e.source):
            for t in model.leaves(e.target):
                src, dst = endpoint_columns(model, e, s.name, t.name)
                end = lambda node, at, names: keyed[node.name].select(F.col("s").alias(at), *(F.col(f"`{k}`").alias(c) for k, c in zip(node.key, names, strict=True)))
                found = links.join(end(s, "s", src), "s").join(end(t, "o", dst), "o")
                edges[e.name, s.name, t.name] = found.select(*src, *dst, *(F.lit(None).cast(spark_type(p.type)).alias(p.name) for p in e.props))
    return PropertyGraph(model, vertices, edges)


def subject(model: Model, node: str, columns: list[str]) -> Column:
    """The IRI of a row: its type's and its key, null if a part is."""
    parts = [x for c in columns for x in (F.lit("/"), F.url_encode(F.col(f"`{c}`").cast("string")))]
    return F.concat(F.lit(type_iri(model, node)), *parts)


def to_triples(graph: PropertyGraph) -> DataFrame:
    """The graph's rows and edges as statements, with the classes' order; rows without a whole key and properties of edges are left out."""
    model, spark = graph.model, next(iter((graph.vertices | graph.edges).values())).sparkSession
    up = [(type_iri(model, n.name), SUBCLASS, f"<{type_iri(model, n.extends)}>") for n in model.nodes if n.extends]
    parts = [spark.createDataFrame(up, SCHEMA)]
    for name, df in graph.vertices.items():
        node = model.node(name)
        said = [F.struct(F.lit(TYPE).alias("p"), F.array(F.lit(f"<{type_iri(model, name)}>")).alias("o"))]
        for p in node.props:
            c = F.col(f"`{p.name}`")
            texts = F.transform(c, lambda x: x.cast("string")) if p.type.kind in ("list", "array") else F.array(c.cast("string"))
            said.append(F.struct(F.lit(model.iri + p.name).alias("p"), texts.alias("o")))
        rows = df.select(subject(model, name, list(node.key)).alias("s"), F.inline(F.array(*said))).where("s IS NOT NULL")
        parts.append(rows.select("s", "p", F.explode("o").alias("o")).where("o IS NOT NULL"))
    for (name, s, t), df in graph.edges.items():
        src, dst = endpoint_columns(model, model.edge(name), s, t)
        parts.append(df.select(subject(model, s, src).alias("s"), F.lit(model.iri + name).alias("p"), F.concat(F.lit("<"), subject(model, t, dst), F.lit(">")).alias("o")).dropna())
    return reduce(DataFrame.unionByName, parts)
