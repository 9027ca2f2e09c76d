"""The driver's tables as a property graph."""

from __future__ import annotations

from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import PropertyGraph, to_model
from ..plans.model import Model
from ..plans.resolve import model_of


@lru_cache(maxsize=1)
def model() -> Model:
    return model_of(Path(__file__).with_name("warehouse.yaml").read_text(encoding="utf-8"))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def graph(spark: SparkSession, sf_dir: str, of: Model | None = None) -> PropertyGraph:
    """Vertex and edge tables as projections, bound to the model or to one that adds to it; nothing is read before a query runs."""
    t = {n: read(spark, sf_dir, n) for n in "region nation customer supplier part orders lineitem documents labels events embeddings conversations".split()}
    m = of or model()
    documents = t["documents"].join(t["labels"].select("doc_id", "quality", "toxic"), "doc_id", "left")
    documents = documents.withColumns({"text_length": F.length("text").cast("long"), "english": F.when(F.col("lang") == "en", True)})
    events = t["events"].withColumn("_more", F.from_json("props", "map<string,string>"))
    own = {
        "Region": t["region"], "Nation": t["nation"], "Customer": t["customer"], "Supplier": t["supplier"], "Part": t["part"], "Order": t["orders"], "LineItem": t["lineitem"], "Document": documents, "Label": t["labels"],
        "Vector": t["embeddings"], "Conversation": t["conversations"].select("conv_id").distinct(), "UserTurn": t["conversations"].where("role = 'user'"), "OtherTurn": t["conversations"].where("role <> 'user' OR role IS NULL"),
    }
    vertices = {name: to_model(df, m, name) for name, df in own.items()}
    vertices["Event"] = events.select(*m.schema("Event").names, "_more")
    g = PropertyGraph(m, vertices)
    g = g.bind_edge("IN_REGION", "Nation", "Region", t["nation"], ["n_nationkey"], ["n_regionkey"])
    g = g.bind_edge("BASED_IN", "Customer", "Nation", t["customer"], ["c_custkey"], ["c_nationkey"])
    g = g.bind_edge("BASED_IN", "Supplier", "Nation", t["supplier"], ["s_suppkey"], ["s_nationkey"])
    g = g.bind_edge("PLACED_BY", "Order", "Customer", t["orders"], ["o_orderkey"], ["o_custkey"])
    line = ["l_orderkey", "l_linenumber"]
    g = g.bind_edge("HAS_LINE", "Order", "LineItem", t["lineitem"], ["l_orderkey"], line)
    g = g.bind_edge("OF_PART", "LineItem", "Part", t["lineitem"], line, ["l_partkey"])
    g = g.bind_edge("SUPPLIED_BY", "LineItem", "Supplier", t["lineitem"], line, ["l_suppkey"])
    g = g.bind_edge("LABELLED", "Document", "Label", t["documents"].select("doc_id"), ["doc_id"], ["doc_id"])
    for kind, role in (("UserTurn", "role = 'user'"), ("OtherTurn", "role <> 'user' OR role IS NULL")):
        g = g.bind_edge("HAS_TURN", "Conversation", kind, t["conversations"].where(role), ["conv_id"], ["conv_id", "turn"])
    return g
