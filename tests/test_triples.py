"""Statements as tables and tables as statements."""

import pytest

from graphloom.operators.audit import plan_audit
from graphloom.operators.graph import PropertyGraph
from graphloom.plans.resolve import model_of
from graphloom.sources.triples import SCHEMA, SUBCLASS, TYPE, from_triples, read_ntriples, subclasses, to_triples, types_of

N = "https://example.org/harbour#"
MODEL = """
namespace: { prefix: hb, iri: "https://example.org/harbour#" }
nodes:
  Craft: { abstract: true, key: [code], props: { code: { type: string, required: true }, tags: { type: "string[]" } } }
  Ship: { extends: Craft, props: { draught: { type: float, max: 20 }, built: { type: date } } }
  Tug: { extends: Ship, props: { pull: { type: int } } }
  Port: { iri: "https://example.org/places#Port", key: [name, country], props: { name: { type: string }, country: { type: string } } }
edges:
  CALLS_AT: { from: Craft, to: Port }
  TOWS: { from: Tug, to: Ship }
"""


@pytest.fixture(scope="module")
def model():
    return model_of(MODEL)


def graph(spark, model):
    ship = "code string, tags array<string>, draught double, built string"
    ships = spark.createDataFrame([("a/1", ["x", "y"], 3.5, "2001-02-03"), ('b "2"', None, None, None), (None, None, 1.0, None)], ship).selectExpr("code", "tags", "draught", "CAST(built AS DATE) AS built")
    tugs = spark.createDataFrame([("t", [], 30.0, None, 9)], ship + ", pull long").selectExpr("code", "tags", "draught", "CAST(built AS DATE) AS built", "pull")
    ports = spark.createDataFrame([("Oslo", "no"), ("Porto", "pt")], "name string, country string")
    calls = lambda *rows: spark.createDataFrame(list(rows), "src_code string, dst_name string, dst_country string")
    return PropertyGraph(model, {"Ship": ships, "Tug": tugs, "Port": ports}, {
        ("CALLS_AT", "Ship", "Port"): calls(("a/1", "Oslo", "no"), ('b "2"', "Gone", "xx")), ("CALLS_AT", "Tug", "Port"): calls(("t", "Porto", "pt")), ("TOWS", "Tug", "Ship"): spark.createDataFrame([("t", "a/1")], "src_code string, dst_code string"),
    })


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_there_and_back(spark, model):
    g = graph(spark, model)
    said = to_triples(g)
    back = from_triples(said.unionByName(said), model)
    for name in ("Ship", "Tug", "Port"):
        want = rows(g.vertices[name].select(back.vertices[name].columns).dropna(subset=list(model.node(name).key)))
        assert rows(back.vertices[name]) == [tuple(None if x == [] else x for x in r) for r in want], "an empty list says nothing"
        assert [(f.name, f.dataType.simpleString()) for f in back.vertices[name].schema] == [(f.name, f.dataType.simpleString()) for f in model.schema(name)]
    assert rows(back.edges["CALLS_AT", "Ship", "Port"]) == [("a/1", "Oslo", "no")], "an edge needs its two ends"
    assert rows(back.edges["CALLS_AT", "Tug", "Port"]) == [("t", "Porto", "pt")] and rows(back.edges["TOWS", "Tug", "Ship"]) == [("t", "a/1")]
    counts = {r.label: r.violations for r in plan_audit(model).run(back).collect() if r.violations}
    assert counts == {"Tug.draught in ..20": 1}


def test_classes_above(spark, model):
    said = [("A", SUBCLASS, "<B>"), ("B", SUBCLASS, "<C>"), ("C", SUBCLASS, "<A>"), ("D", SUBCLASS, "<C>"), ("x", TYPE, "<D>"), ("x", TYPE, "<D>"), ("y", TYPE, "<A>"), ("z", TYPE, "literal"), (None, TYPE, "<A>")]
    t = spark.createDataFrame(said, SCHEMA)
    assert {tuple(r) for r in subclasses(t).collect()} == {("A", "B"), ("A", "C"), ("B", "A"), ("B", "C"), ("C", "A"), ("C", "B"), ("D", "A"), ("D", "B"), ("D", "C")}
    assert {tuple(r) for r in types_of(t.dropna()).collect()} == {("x", "D"), ("x", "C"), ("x", "A"), ("x", "B"), ("y", "A"), ("y", "B"), ("y", "C")}


def test_odd_statements(spark, model):
    said = [("s1", TYPE, f"<{N}Ship>"), ("s1", N + "code", "k"), ("s1", N + "code", "j"), ("s1", N + "draught", "deep"), ("s1", N + "other", "1"), ("s2", N + "code", "no type"), ("p", TYPE, "<https://example.org/places#Port>"), ("s1", N + "CALLS_AT", "<p>"), ("s1", N + "CALLS_AT", "p"), ("s1", None, "x")]
    g = from_triples(spark.createDataFrame(said, SCHEMA), model)
    assert rows(g.vertices["Ship"].select("code", "draught", "tags")) == [("j", None, None)] and rows(g.vertices["Port"]) == [(None, None)]
    assert rows(g.edges["CALLS_AT", "Ship", "Port"]) == [("j", None, None)]
    empty = from_triples(spark.createDataFrame([], SCHEMA), model)
    assert all(df.count() == 0 for df in (*empty.vertices.values(), *empty.edges.values()))


def test_lines(spark, tmp_path):
    (tmp_path / "a.nt").write_text("\n".join([
        "<http://a> <http://p> <http://b> .", '<http://a> <http://p> "two \\"words\\"\\nand a line" .', '<http://a> <http://q> "7"^^<http://www.w3.org/2001/XMLSchema#integer> .', '_:b1 <http://q> "x"@en .', "# a comment", "", "broken <http://p> .", "<http://a> <http://p> _:b1 .",
    ]))
    assert rows(read_ntriples(spark, str(tmp_path))) == sorted([("http://a", "http://p", "<http://b>"), ("http://a", "http://p", 'two "words"\nand a line'), ("http://a", "http://q", "7"), ("_:b1", "http://q", "x"), ("http://a", "http://p", "_:b1")], key=repr)
