"""Audits, matches, inference, drift and migrations on small tables."""

from dataclasses import replace
from datetime import datetime

import pytest
from harbour import HARBOUR
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.models import revisions, warehouse
from graphloom.operators import drift as drifts
from graphloom.operators.audit import EXTRA_CHECKS, audit, degrees, enforce, plan_audit, register_check
from graphloom.operators.graph import PropertyGraph, edge_tables, endpoint_columns, to_model
from graphloom.operators.match import match, reachable
from graphloom.operators.migrate import Step, apply_steps, change_impact, data_steps, lost_values, migrate_graph, plan_migration, step_impact, uncarried
from graphloom.plans.resolve import model_of

#: A row of each type of the warehouse model that breaks no check of rows.
GOOD = {
    "Region": {"r_regionkey": 1, "r_name": "north"},
    "Customer": {"c_custkey": 1, "c_name": "c", "c_nationkey": 3, "c_acctbal": 10.0, "c_mktsegment": "BUILDING"},
    "Part": {"p_partkey": 1, "p_name": "almond", "p_brand": "b", "p_type": "t", "p_size": 50, "p_retailprice": 1.0},
    "Order": {"o_orderkey": 1, "o_custkey": 1, "o_orderstatus": "F", "o_totalprice": 2.0, "o_orderpriority": "1-URGENT", "o_orderdate": datetime(2020, 1, 1)},
    "LineItem": {"l_orderkey": 1, "l_linenumber": 1, "l_quantity": 50.0, "l_discount": 0.1, "l_tax": 0.2},
    "Document": {"doc_id": 1, "text": "a text of twenty characters or more", "n_chars": 35, "text_length": 35, "quality": 1, "toxic": None, "english": None},
    "Label": {"doc_id": 1, "quality": 1, "toxic": 0},
    "Conversation": {"conv_id": 1},
    "UserTurn": {"conv_id": 1, "turn": 1, "text": "hello"},
}


@pytest.fixture(scope="module")
def model():
    return warehouse.model()


def build(spark, model, edges=None, **rows):
    """A graph of the warehouse model: for each type the rows that differ from the good one as named; edges as (edge, source, target) -> key tuples."""
    vertices = {}
    for name, changes in rows.items():
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in model.schema(name)])
        vertices[name] = spark.createDataFrame([tuple((GOOD[name] | c).get(f.name) for f in schema) for c in changes], schema)
    tables = {}
    for (e, s, t), pairs in (edges or {}).items():
        columns = [c for side in endpoint_columns(model, model.edge(e), s, t) for c in side]
        tables[e, s, t] = spark.createDataFrame(pairs, ", ".join(f"{c} long" for c in columns))
    return PropertyGraph(model, vertices, tables)


def found(graph, **options):
    return {(r.code, r.label): r.violations for r in audit(graph, **options).collect() if r.violations}


def test_audit_of_good_data(spark, model):
    rows = {name: [{}] for name in GOOD} | {"UserTurn": [{}, {"turn": 2}]}
    edges = {("PLACED_BY", "Order", "Customer"): [(1, 1)], ("HAS_LINE", "Order", "LineItem"): [(1, 1, 1)], ("HAS_TURN", "Conversation", "UserTurn"): [(1, 1, 1), (1, 1, 2)], ("OF_PART", "LineItem", "Part"): [(1, 1, 1)]}
    assert not {k: v for k, v in found(build(spark, model, edges, **rows)).items() if k[0] != "cardinality" and not k[1].startswith("Document.qualityOrEnglish")}


PLANTED = [
    ("Customer", {"c_name": None}, "required", "Customer.c_name required"),
    ("Customer", {"c_acctbal": 9000.5}, "range", "Customer.c_acctbal in 0..9000"),
    ("Customer", {"c_mktsegment": "TOYS"}, "enum", "Customer.c_mktsegment in enum Segment"),
    ("Part", {"p_name": "zinc"}, "pattern", "Part.p_name pattern"),
    ("Part", {"p_size": 0}, "range", "Part.p_size in 1..50"),
    ("Document", {"text": "short"}, "length", "Document.text length 20..5000"),
    ("Document", {"n_chars": None}, "constraint", "Document.lengthAsTold"),
    ("Document", {"quality": None}, "constraint", "Document.labelled"),
    ("Document", {"english": True}, "constraint", "Document.qualityOrEnglish"),
    ("LineItem", {"l_tax": 0.1}, "constraint", "LineItem.discountBelowTax"),
    ("LineItem", {"l_tax": 0.05}, "constraint", "LineItem.discountAtMostTax"),
    ("Order", {"o_orderstatus": "1-URGENT"}, "constraint", "Order.statusIsNotPriority"),
    ("Order", {"o_orderkey": None}, "key-present", "Order key part o_orderkey"),
]


@pytest.mark.parametrize(("name", "change", "code", "label"), PLANTED)
def test_one_planted_row(spark, model, name, change, code, label):
    g = build(spark, model, **{name: [change, {}]})
    assert plan_audit(model).only(label).run(g).collect() == [(code, label, 1)]
    assert plan_audit(model).violating_rows(g, label).count() == 1


def test_counts_of_groups_and_edges(spark, model):
    turns, edges = [(1, 1, 1), (1, 1, 2), (2, 2, 1)], {}
    edges["HAS_TURN", "Conversation", "UserTurn"] = turns
    edges["PLACED_BY", "Order", "Customer"] = [(i, 1) for i in range(16)] + [(3, 2), (4, 99)]
    parts = [{}, {"p_name": "azure"}, {"p_partkey": 2, "p_name": "azure"}, {"p_partkey": None}, {"p_partkey": None, "p_name": None}]
    g = build(spark, model, edges, Part=parts, Conversation=[{}, {"conv_id": 2}, {"conv_id": 2}, {"conv_id": 3}], UserTurn=[{}], Order=[{"o_orderkey": i} for i in range(17)], Customer=[{}, {"c_custkey": 2}, {"c_custkey": 3}])
    f = found(g)
    assert f["key-unique", "Part key (p_partkey)"] == 1 and f["unique", "Part.p_name unique"] == 2, "groups are counted, not rows; nulls are in no group"
    assert f["key-present", "Part key part p_partkey"] == 2
    assert f["constraint", "Conversation.answersTwice"] == 2, "2 has one turn, 3 has none; a key counts once"
    assert f["foreign-key", "PLACED_BY to Customer"] == 1
    assert f["cardinality", "PLACED_BY from-cardinality at Customer"] == 1, "one customer has sixteen orders"
    assert f["cardinality", "PLACED_BY to-cardinality at Order"] == 3, "two orders have two customers, one has none"


def test_lists_layouts_and_reports(spark):
    m = model_of(SIGNALS)
    rows = spark.createDataFrame([(1, ["on", "loud"], 300, None), (2, ["off"], None, -1.0)], "at long, states array<string>, level int, gain double")
    g = PropertyGraph(m, {"Meter": rows.where("at = 1"), "Probe": rows.where("at = 2")})
    plan = plan_audit(m)
    assert {"audit-unsupported", "audit-abstract-constraint"} == {d.code for d in plan.diagnostics} and not any("states" in c.label for c in plan.checks)
    assert found(g)["range", "Meter.level as uint8"] == 1 and found(g)["range", "Probe.gain in 0.."] == 1
    assert found(g, elements=True)["enum", "Meter.states in enum State (elements)"] == 1
    assert found(g, layout="labels")["range", "Meter [Probe].gain in 0.."] == 1


#: Lists, an unsigned type, a concrete type below a concrete one, and a constraint of an abstract type.
SIGNALS = """
namespace: { prefix: sg, iri: "https://example.org/signals#" }
enums: { State: { values: [on, off] } }
nodes:
  Device: { abstract: true, key: [at], props: { at: { type: int, required: true } }, constraints: [{ name: still, assert: { equals: [at, at] } }] }
  Meter: { extends: Device, props: { states: { type: "string[]", enum: State }, level: { type: uint8 }, gain: { type: float, min: 0 } } }
  Probe: { extends: Meter }
edges:
  FEEDS: { from: Probe, to: Device, props: { loss: { type: float, max: 1 } } }
"""


def test_closed_tables_and_bags(spark):
    m = model_of('namespace: { prefix: a, iri: "https://a#" }\nnodes: { A: { key: [k], props: { k: { type: int } } }, B: { open: true, key: [k], props: { k: { type: int } } } }')
    bag = spark.createDataFrame([(1, {"x": "1", "y": "2"}), (2, {"k": "1"}), (3, None), (3, {"z": ""}), (3, {"z": ""})], "k int, _more map<string,string>")
    g = PropertyGraph(m, {"A": bag, "B": bag})
    assert found(g) == {("closed", "A closed"): 2, ("key-unique", "A key (k)"): 1, ("key-unique", "B key (k)"): 1}
    assert found(PropertyGraph(m, {"A": spark.createDataFrame([(1, 2)], "k int, extra int")})) == {("closed", "A closed"): 1}


def test_split_and_enforce(spark, model):
    g = build(spark, model, Customer=[{}, {}, {"c_custkey": 2, "c_name": None, "c_acctbal": -1.0}, {"c_custkey": None}, {"c_custkey": None, "c_name": "other"}], Document=[{}, {"doc_id": 2, "quality": None}])
    good, bad = plan_audit(model).split(g, "Customer")
    assert [r.c_custkey for r in good.collect()] == [1]
    assert sorted((str(r.c_custkey), r._failed) for r in bad.collect()) == [("1", ["Customer key (c_custkey)"]), ("2", ["Customer.c_name required", "Customer.c_acctbal in 0..9000"]), ("None", ["Customer key part c_custkey"]), ("None", ["Customer key part c_custkey"])], "null keys lack a part, but repeat nothing"
    assert sorted(r.doc_id for r in plan_audit(model).split(g, "Document")[0].collect()) == [1, 2], "a warning doesn't keep a row out"
    with pytest.raises(Exception, match="Customer.c_name required|Customer key part c_custkey"):  # the first task to fail ends the job, and tasks race
        enforce(plan_audit(model), g, "Customer").collect()
    with pytest.raises(Exception, match="Customer.c_name required"):
        enforce(plan_audit(model), build(spark, model, Customer=[{}, {"c_custkey": 2, "c_name": None}]), "Customer").collect()


def test_registered_checks(spark, model):
    register_check("lower", lambda m, owner, p: F.col("c_name") != F.lower("c_name") if p.name == "c_name" else None)
    try:
        assert found(build(spark, model, Customer=[{"c_name": "Upper"}]))["lower", "Customer.c_name lower"] == 1
        with pytest.raises(ValueError):
            register_check("lower", lambda *a: None)
    finally:
        EXTRA_CHECKS.clear()


def test_fused_plan_scans_a_table_once(spark, small):
    g = warehouse.graph(spark, small)
    plan = plan_audit(g.model)
    rows = plan.__class__(plan.model, [c for c in plan.checks if c.table == ("Part",) and c.predicate is not None])
    text = rows.run(g)._jdf.queryExecution().executedPlan().toString()
    assert len(rows.checks) >= 3 and text.count("Scan parquet") == 1 and "p_retailprice" not in text


def test_edge_names(model):
    names = [x[3] for x in edge_tables(model)]
    assert "IN_REGION" in names and {"BASED_IN_Customer_Nation", "BASED_IN_Supplier_Nation"} <= set(names) and len(set(names)) == len(names)
    m = model_of('namespace: { prefix: a, iri: "https://a#" }\nnodes: { Crane: { key: [k], props: { k: { type: int } } } }\nedges: { CRANE: { from: Crane, to: Crane, props: { src_k: { type: int } } } }')
    assert edge_tables(m)[0][3] == "CRANE_edge" and endpoint_columns(m, m.edge("CRANE"), "Crane", "Crane") == (["src_k_"], ["dst_k"])


@pytest.fixture(scope="module")
def port(spark):
    """Three ships that tow each other in a ring; the first calls at a berth, the second at a yard."""
    m = model_of(HARBOUR)
    ships = spark.createDataFrame([(i, f"s{i}", "oslo", 3.0) for i in (1, 2, 3)], "imo long, callSign string, flag string, draught double")
    return PropertyGraph(m, {"Ship": ships, "Berth": spark.createDataFrame([("b", 90, None)], "code string, metres long, surveyedOn date"), "Yard": spark.createDataFrame([("y", "o")], "code string, owner string")}, {
        ("TOWS", "Ship", "Ship"): spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "src_imo long, dst_imo long"),
        ("CALLS_AT", "Ship", "Berth"): spark.createDataFrame([(1, "b", None)], "src_imo long, dst_code string, eta date"),
        ("CALLS_AT", "Ship", "Yard"): spark.createDataFrame([(2, "y", None)], "src_imo long, dst_code string, eta date"),
    })


def test_match(port):
    rows = lambda p, *c: sorted(tuple(r[x] for x in c) for r in match(port, p).collect())
    assert rows("(a:Ship {imo: 1})-[r:TOWS]->(b)", "a_imo", "b_imo") == [(1, 2)]
    assert rows("(a:Ship {imo: 1})<-[:TOWS]-(b:Ship)", "b_imo") == [(3,)]
    assert rows("(a:Ship {imo: 1})-[:TOWS]-(b:Ship)", "b_imo") == [(2,), (3,)]
    assert rows("(a:Ship {imo: 1})-[:TOWS*1..2]->(b:Ship)", "b_imo") == [(2,), (3,)]
    assert rows("(a:Ship)-[c:CALLS_AT]->(p:Place)", "a_imo", "p_code", "p_type", "c_eta") == [(1, "b", "Berth", None), (2, "y", "Yard", None)]
    assert rows("(a:Ship)-[:CALLS_AT]->(p:Place:Yard)", "a_imo") == [(2,)]
    assert rows("(a)-[:TOWS]->()-[:CALLS_AT]->(p:Berth)", "a_imo", "p_code") == [(3, "b")]
    with pytest.raises(ValueError):
        match(port, "(a:Berth)-[:TOWS]->(b)")
    assert sorted((r.src_imo, r.dst_imo, r.hops) for r in reachable(port, "TOWS").collect() if r.src_imo == 1) == [(1, 1, 3), (1, 2, 1), (1, 3, 2)]
    assert reachable(port, "TOWS", 1).count() == 3


def test_binding_errors(spark, port):
    with pytest.raises(ValueError):
        PropertyGraph(port.model, {"Place": spark.range(1)})
    with pytest.raises(ValueError):
        PropertyGraph(port.model, {}, {("TOWS", "Ship", "Ship"): spark.range(1)})
    assert sorted((r.code, r._type) for r in port.of_type("Place").collect()) == [("b", "Berth"), ("y", "Yard")]
    loose = to_model(spark.createDataFrame([("7", "x")], "imo string, draught string"), port.model, "Ship").first()
    assert (loose.imo, loose.draught, loose.callSign) == (7, None, None)


def test_migrations(spark, model):
    before, after = revisions.revisions("retype_property")
    g = build(spark, before, Part=[{}, {"p_partkey": 2, "p_size": None}])
    moved = migrate_graph(g, after).vertices["Part"]
    assert [f.dataType for f in moved.schema] == [f.dataType for f in after.schema("Part")]
    assert sorted((r.p_partkey, r.p_size) for r in moved.collect()) == [(1, "50"), (2, None)] and lost_values(g, after).collect() == [("Part", "p_size", 0)]
    back = PropertyGraph(after, {"Part": moved.withColumn("p_size", F.lit("large"))})
    assert lost_values(back, before).collect() == [("Part", "p_size", 2)]
    assert plan_migration(after, before, 1, graph=back).refused and not plan_migration(after, before, 1, graph=back, allow_destructive=True).refused
    assert plan_migration(*revisions.revisions("remove_property"), 1).diagnostics[0].code == "destructive-change"
    assert plan_migration(before, before, 1).diagnostics[0].code == "no-changes"
    plan = plan_migration(*revisions.revisions("rename_property"), 3)
    assert '"revision": 4' in plan.lockfile and [s.kind for s in plan.steps] == ["rename-node-property"]


@pytest.mark.parametrize("name", revisions.EDITS)
def test_migrated_schema_is_the_new_one(spark, name):
    before, after = revisions.revisions(name)
    g = PropertyGraph(before, {n.name: spark.createDataFrame([], before.schema(n.name)) for n in before.concrete()})
    for n, df in migrate_graph(g, after).vertices.items():
        assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in after.schema(n)]


def test_impact_of_changes(spark):
    before, after = revisions.revisions("remove_node_type")
    g = build(spark, before, {("OF_PART", "LineItem", "Part"): [(1, 1, 1), (1, 1, 2)]}, Part=[{}, {"p_partkey": 2, "p_type": None}])
    reach = {r.label: r.affected for r in change_impact(g, after).collect()}
    assert reach["node Part"] == 2 and reach["property Part.p_type"] == 1 and reach["edge OF_PART"] == 2
    assert [(r.kind, r.on_, r.affected) for r in step_impact(g, after).orderBy("place").collect()] == [("delete-edges", "OF_PART", 2), ("delete-nodes", "Part", 2)]


BREAKS = [
    ("make_required", "property Label.toxic", {"Label": [{"toxic": None}, {"toxic": 1}, {"toxic": None}]}, 2),
    ("add_unique", "property Customer.c_name", {"Customer": [{"c_name": "x"}, {"c_name": "x"}, {"c_name": "y"}, {"c_name": None}, {"c_name": None}]}, 2),
    ("remove_enum_value", "enum OrderStatus", {"Order": [{"o_orderstatus": "P"}, {"o_orderstatus": "F"}, {"o_orderstatus": "X"}, {"o_orderstatus": None}]}, 1),
    ("change_key", "node Part", {"Part": [{}, {}, {"p_brand": "z"}, {"p_brand": None}]}, 3),
    ("add_required_property", "property Part.p_origin", {"Part": [{}, {}]}, 2),
    ("add_optional_property", "property Party.remark", {"Customer": [{}]}, 0),
    ("retype_lossy", "property Part.p_brand", {"Part": [{"p_brand": "7"}, {"p_brand": "x"}, {"p_brand": None}]}, 1),
    ("tighten_range", "property Customer.c_acctbal", {"Customer": [{"c_acctbal": 5000.0}, {"c_acctbal": 5000.5}, {"c_acctbal": 9999.0}, {"c_acctbal": None}]}, 1),
    ("value_pattern", "property Supplier.s_name", {"Supplier": [{"s_name": "Supplier 1"}, {"s_name": "other"}, {"s_name": None}]}, 1),
    ("tighten_length", "property Document.text", {"Document": [{"text": "x" * 199}, {"text": "x" * 200}, {"text": "x"}]}, 1),
    ("add_assertion", "constraint LineItem.taxBelowDiscount", {"LineItem": [{}, {"l_tax": 0.05}]}, 1),
    ("remove_property", "property Event.value", {"Event": [{"value": 1.0}, {"value": None}]}, 1),
    ("rename_property", "property Event.kind", {"Event": [{"event_type": "a"}]}, 0),
]


@pytest.mark.parametrize(("name", "label", "rows", "want"), BREAKS)
def test_rows_that_a_change_breaks(spark, name, label, rows, want):
    before, after = revisions.revisions(name)
    plain = {"Supplier": {"s_suppkey": 1, "s_name": "s"}, "Event": {"event_id": 1, "event_type": "a", "ts": datetime(2020, 1, 1)}}
    GOOD.update({k: v for k, v in plain.items() if k not in GOOD})
    got = [r.broken for r in change_impact(build(spark, before, **rows), after).collect() if r.label == label and not r.detail.startswith("min removed")]
    assert got[0] == want


def test_edges_that_a_change_breaks(spark):
    before, after = revisions.revisions("tighten_cardinality")
    edges = {("OF_PART", "LineItem", "Part"): [(i, 1, 1) for i in range(26)] + [(i, 2, 2) for i in range(25)] + [(i, 3, 3) for i in range(41)]}
    g = build(spark, before, edges, Part=[{}, {"p_partkey": 2}, {"p_partkey": 3}, {"p_partkey": 4}])
    assert [(r.affected, r.broken) for r in change_impact(g, after).collect()] == [(92, 1)], "the part with 41 lines was wrong before"
    before, after = revisions.revisions("change_endpoints")
    g = build(spark, before, {("SUPPLIED_BY", "LineItem", "Supplier"): [(1, 1, 1), (1, 2, 1)]}, LineItem=[{}])
    assert [(r.affected, r.broken) for r in change_impact(g, after).collect()] == [(2, 2)]


def test_steps_on_labelled_elements(spark):
    v = spark.createDataFrame([(1, ["Event"], {"event_type": "a"}), (2, ["Vector", "Stored"], {}), (3, ["Part"], {"event_type": "c"}), (4, ["Region", "Stored"], {})], "id int, labels array<string>, props map<string,string>")
    e = spark.createDataFrame([(1, 3, "NEAR", {"since": "x"}), (1, 2, "LABELLED", {})], "src int, dst int, type string, props map<string,string>")
    nodes = lambda steps: {r.id: (sorted(r.labels), r.props) for r in apply_steps(v, e, steps)[0].collect()}
    assert set(nodes([Step("delete-nodes", "Stored", keep=("Region",))])) == {1, 3, 4}
    assert apply_steps(v, e, [Step("delete-nodes", "Part")])[1].count() == 1, "edges of deleted nodes go"
    assert nodes(data_steps(*revisions.revisions("rename_node_type")))[1][0] == ["Click"]
    renamed = nodes(data_steps(*revisions.revisions("rename_property")))
    assert renamed[1][1] == {"kind": "a"} and renamed[3][1] == {"event_type": "c"}
    out = apply_steps(v, e, [Step("rename-edge-property", "NEAR", "since", "from"), *data_steps(*revisions.revisions("rename_edge"))])[1].collect()
    assert {(r.type, tuple(r.props.items())) for r in out} == {("NEAR", (("from", "x"),)), ("JUDGED", ())}


def test_drift(spark):
    m = model_of(HARBOUR)
    tables = {n.name: spark.createDataFrame([], m.schema(n.name)).schema for n in m.concrete()}
    expected = drifts.expected_columns(spark, m).where("table IN ('Ship', 'Berth', 'Yard')")
    assert drifts.column_drift(expected, drifts.found_columns(spark, tables)).count() == 0
    keyed = expected.withColumn("key", F.when(F.col("column") == "imo", F.lit(None)).otherwise(F.col("key")))
    assert drifts.column_drift(expected, keyed, compare_keys=True).collect() == [("different", "key of Ship", "declared (imo), found ()")]
    assert drifts.column_drift(expected, drifts.found_columns(spark, {}), True).count() == 3


def test_degrees_need_one_shuffle_and_leave_out_null_keys(spark):
    m = model_of(HARBOUR)
    ships = spark.createDataFrame([(1,), (1,), (2,), (None,)], "imo int")
    tows = spark.createDataFrame([(1, 2), (1, 3), (None, 1), (9, 1)], "src_imo long, dst_imo long")
    n = degrees(PropertyGraph(m, {"Ship": ships}, {("TOWS", "Ship", "Ship"): tows}), m.edge("TOWS"), "Ship", True)
    assert sorted(map(tuple, n.collect()), key=str) == [(1, 2), (2, 0), (None, 0)], "a key counts once, an end without a node not at all"
    plan = n._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") <= 2  # the adaptive plan may be printed twice


def test_endpoint_drift(spark):
    m = model_of(HARBOUR)
    rows = lambda schema, *r: spark.createDataFrame(list(r), schema)
    calls = "src_imo long, dst_code string, eta date"
    tables = {("CALLS_AT", "Ship", "Berth"): rows(calls, (1, "a", None), (2, "a", None), (3, None, None)), ("CALLS_AT", "Ship", "Yard"): rows(calls, (3, "y", None)), ("TOWS", "Ship", "Ship"): rows("src_imo long, dst_imo long", (1, 2))}
    found = lambda t: drifts.endpoint_drift(drifts.expected_endpoints(spark, m), drifts.found_endpoints(PropertyGraph(m, {}, t)))
    assert found(tables).collect() == [("different", "multiplicity of TOWS", "declared many-to-many, found one-to-one")]
    tables["CALLS_AT", "Ship", "Yard"] = rows(calls, (1, "y", None))
    assert ("different", "multiplicity of CALLS_AT", "declared many-to-one, found many-to-many") in found(tables).collect(), "a ship's calls at berths and yards count together"
    tables["CALLS_AT", "Ship", "Yard"] = rows(calls)
    tables["TOWS", "Ship", "Ship"] = rows("src_imo long, dst_imo long", (1, 2), (1, 3), (2, 3))
    assert found(tables).collect() == [("missing", "endpoints CALLS_AT Ship->Yard", "declared but not found")]
    unknown = drifts.expected_endpoints(spark, m).withColumn("multiplicity", F.lit(None).cast("string")).unionByName(rows(drifts.ENDPOINTS, ("TOWS", "Yard", "Ship", None)))
    assert drifts.endpoint_drift(drifts.expected_endpoints(spark, m), unknown).collect() == [("unexpected", "endpoints TOWS Yard->Ship", "found but not declared")]


def test_all_conversations_are_reached(spark, small):
    from graphloom.queries import QUERIES

    turns, want = {}, set()
    for r in spark.read.parquet(f"{small}/conversations.parquet").collect():
        if r.conv_id is not None and r.turn is not None:
            turns.setdefault(r.conv_id, set()).add(r.turn)
    for c, own in turns.items():
        order = sorted(own)
        want |= {(f"{c}/{order[i]}", f"{c}/{order[j]}", j - i) for i in range(len(order)) for j in range(i + 1, len(order))}
    assert len(turns) > 10 and {tuple(r) for r in QUERIES["match_reachable"](spark, small).collect()} == want


def test_all_edges_are_retyped(spark, small):
    from graphloom.queries import QUERIES

    got = QUERIES["migrate_retype_edges"](spark, small)
    assert got.columns == ["src_o_orderkey", "dst_l_orderkey", "dst_l_linenumber"]
    lines = spark.read.parquet(f"{small}/lineitem.parquet").select("l_orderkey", "l_orderkey", "l_linenumber")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, lines.collect()))


def refusals(graph, after, **options):
    return {(r.object, r.reason): r.rows for r in uncarried(graph, after, **options).collect() if r.rows}


def test_edges_follow_a_key_to_another_column(spark, model):
    edges = {("PLACED_BY", "Order", "Customer"): [(1, 1), (2, 2), (3, 2)]}
    g = build(spark, model, edges, Order=[{"o_orderkey": i} for i in (1, 2, 3)], Customer=[{"c_name": "x"}, {"c_custkey": 2, "c_name": "y"}])
    after = model.edit_node("Customer", key=("c_name",))
    moved = migrate_graph(g, after)
    assert sorted(map(tuple, moved.edges["PLACED_BY", "Order", "Customer"].collect())) == [(1, "x"), (2, "y"), (3, "y")]
    assert moved.edges["PLACED_BY", "Order", "Customer"].columns == ["src_o_orderkey", "dst_c_name"]
    assert not {k for k in found(moved) if k[0] in ("foreign-key", "key-unique", "key-present")}
    assert not refusals(g, after) and not plan_migration(model, after, 1, graph=g).refused
    blind = plan_migration(model, after, 1)
    assert blind.refused and blind.diagnostics[0].code == "destructive-change" and blind.diagnostics[0].target == "node Customer", "without the graph nobody has looked at the rows"
    back = migrate_graph(moved, model)
    assert sorted(map(tuple, back.edges["PLACED_BY", "Order", "Customer"].collect())) == [(1, 1), (2, 2), (3, 2)], "there and back again"


def test_edges_follow_a_key_of_another_size(spark, model):
    edges = {("HAS_LINE", "Order", "LineItem"): [(1, 1, 1), (1, 1, 2), (2, 2, 1)], ("OF_PART", "LineItem", "Part"): [(1, 1, 7), (1, 2, 8)]}
    g = build(spark, model, edges, Order=[{}, {"o_orderkey": 2, "o_custkey": 5}], LineItem=[{}, {"l_linenumber": 2}, {"l_orderkey": 2}], Part=[{"p_partkey": 7}, {"p_partkey": 8, "p_name": "b"}])
    wider = model.edit_node("Order", key=("o_custkey", "o_orderkey"))
    moved = migrate_graph(g, wider)
    assert moved.edges["HAS_LINE", "Order", "LineItem"].columns == ["src_o_custkey", "src_o_orderkey", "dst_l_orderkey", "dst_l_linenumber"]
    assert sorted(map(tuple, moved.edges["HAS_LINE", "Order", "LineItem"].collect())) == [(1, 1, 1, 1), (1, 1, 1, 2), (5, 2, 2, 1)]
    assert not {k for k in found(moved) if k[0] == "foreign-key"} and not plan_migration(model, wider, 1, graph=g).refused
    turned = model.edit_node("LineItem", key=("l_linenumber", "l_orderkey"))
    assert sorted(map(tuple, migrate_graph(g, turned).edges["OF_PART", "LineItem", "Part"].collect())) == [(1, 1, 7), (2, 1, 8)], "columns follow their property, not their place"
    narrow = model.edit_node("LineItem", key=("l_orderkey",))
    assert sorted(map(tuple, migrate_graph(g, narrow).edges["OF_PART", "LineItem", "Part"].collect())) == [(1, 7), (1, 8)]
    assert refusals(g, narrow) == {("node LineItem", "key-repeated"): 2} and plan_migration(model, narrow, 1, graph=g).refused
    assert not plan_migration(model, narrow, 1, graph=g, allow_destructive=True).refused


def test_what_a_changed_key_loses_is_counted(spark, model):
    edges = {("PLACED_BY", "Order", "Customer"): [(1, 1), (2, 2), (3, 3), (4, 99), (5, 1)]}
    people = [{"c_name": "a"}, {"c_name": "b"}, {"c_custkey": 2, "c_name": None}, {"c_custkey": 3, "c_name": "c"}, {"c_custkey": 4, "c_name": "c"}]
    g = build(spark, model, edges, Order=[{"o_orderkey": i} for i in range(1, 6)], Customer=people)
    after = model.edit_node("Customer", key=("c_name",))
    place = "edge PLACED_BY Order->Customer at Customer"
    assert refusals(g, after) == {("node Customer", "key-null"): 1, ("node Customer", "key-repeated"): 2, (place, "no-vertex"): 2, (place, "key-ambiguous"): 2}
    plan = plan_migration(model, after, 1, graph=g)
    assert plan.refused and any("2 edges lead to no row" in d.message for d in plan.diagnostics)
    got = sorted(map(tuple, migrate_graph(g, after).edges["PLACED_BY", "Order", "Customer"].collect()))
    assert got == [(1, "a"), (1, "b"), (3, "c"), (5, "a"), (5, "b")], "an edge of a repeated key leads to each of its rows"
    retyped = model.edit_property("Customer", "c_name", type=model.node("Customer").prop("c_custkey").type).edit_node("Customer", key=("c_name",))
    assert refusals(g, retyped)["node Customer", "key-null"] == 5, "names are no numbers"
    bare = PropertyGraph(model, {}, g.edges)
    assert refusals(bare, after) == {(place, "no-vertex"): 5} and not migrate_graph(bare, after).edges
    fresh = model.edit_node("Customer", key=("code",), props=(*model.node("Customer").props, replace(model.node("Part").prop("p_brand"), name="code", id="p_code")))
    assert refusals(g, fresh) == {("node Customer", "key-null"): 5, (place, "no-vertex"): 5} and migrate_graph(g, fresh).edges["PLACED_BY", "Order", "Customer"].count() == 0


def test_retyped_keys_retype_the_ends(spark, model):
    from graphloom.functions.types import parse_type

    g = build(spark, model, {("PLACED_BY", "Order", "Customer"): [(1, 1)]}, Order=[{}], Customer=[{}])
    after = model.edit_property("Customer", "c_custkey", type=parse_type("string"))
    moved = migrate_graph(g, after).edges["PLACED_BY", "Order", "Customer"]
    assert moved.collect() == [(1, "1")] and moved.schema["dst_c_custkey"].dataType == T.StringType()
    back = migrate_graph(PropertyGraph(after, migrate_graph(g, after).vertices, {("PLACED_BY", "Order", "Customer"): moved.unionByName(spark.createDataFrame([(2, "x")], moved.schema))}), model)
    assert back.edges["PLACED_BY", "Order", "Customer"].collect() == [(1, 1)]
    wrong = PropertyGraph(after, {}, {("PLACED_BY", "Order", "Customer"): spark.createDataFrame([(2, "x")], moved.schema)})
    assert refusals(wrong, model) == {("edge PLACED_BY Order->Customer at Customer", "key-cast"): 1}


def test_changed_endpoints_are_refused_or_moved_along_an_edge(spark, model):
    edges = {("SUPPLIED_BY", "LineItem", "Supplier"): [(1, 1, 50), (1, 2, 50), (2, 1, 51)], ("OF_PART", "LineItem", "Part"): [(1, 1, 7), (1, 2, 7)]}
    g = build(spark, model, edges, LineItem=[{}], Part=[{"p_partkey": 7}])
    after = model.edit_edge("SUPPLIED_BY", source="Part")
    assert refusals(g, after) == {("edge SUPPLIED_BY LineItem->Supplier", "endpoints"): 3}
    plan = plan_migration(model, after, 1, graph=g)
    assert plan.refused and "3 edges connect types" in plan.diagnostics[0].message and plan_migration(model, after, 1).refused
    assert ("SUPPLIED_BY", "Part", "Supplier") not in migrate_graph(g, after).edges
    along = {"SUPPLIED_BY": {"source": "OF_PART"}}
    assert migrate_graph(g, after, along=along).edges["SUPPLIED_BY", "Part", "Supplier"].collect() == [(7, 50)], "two lines of a part are one edge, a line without a part is none"
    assert not plan_migration(model, after, 1, graph=g, along=along).refused
    both = after.edit_node("Part", key=("p_partkey", "p_brand"))
    assert migrate_graph(g, both, along=along).edges["SUPPLIED_BY", "Part", "Supplier"].collect() == [(7, "b", 50)], "moved and translated"
    up = model.edit_edge("PLACED_BY", target="Party")
    h = build(spark, model, {("PLACED_BY", "Order", "Customer"): [(1, 1)]}, Order=[{}], Customer=[{}])
    assert not refusals(h, up) and migrate_graph(h, up).edges["PLACED_BY", "Order", "Customer"].collect() == [(1, 1)], "an end that moves up to its ancestor keeps its edges"


def test_rings_and_several_chains(port):
    rows = lambda p, *c: sorted(tuple(r[x] for x in c) for r in match(port, p).collect())
    ring = "(a:Ship)-[:TOWS]->(b:Ship)-[:TOWS]->(c)-[:TOWS]->(a)"
    assert rows(ring, "a_imo", "b_imo", "c_imo") == [(1, 2, 3), (2, 3, 1), (3, 1, 2)]
    plan = match(port, ring)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert rows("(a:Ship)-[:TOWS]->(b), (b)-[:CALLS_AT]->(p:Yard)", "a_imo", "b_imo", "p_code") == [(1, 2, "y")]
    assert rows("(a:Ship)-[:CALLS_AT]->(p:Berth), (a)-[:TOWS]->(b), (b)-[:CALLS_AT]->(q)", "a_imo", "p_code", "b_imo", "q_code") == [(1, "b", 2, "y")]
    assert rows("(a:Ship)-[:TOWS*1..2]->(b)-[:TOWS]->(a)", "a_imo", "b_imo") == [(1, 3), (2, 1), (3, 2)]
    assert rows("(a:Ship {imo: 1})-[:TOWS*0..1]->(b)", "b_imo") == [(1,), (2,)]
    assert rows("(a:Ship {imo: 1}), (a {flag: 'oslo'})-[:TOWS]->(b)", "b_imo") == [(2,)], "a place has the filters of all its mentions"
    assert rows("(a:Ship {imo: 1}), (a {flag: 'malta'})-[:TOWS]->(b)", "b_imo") == []
    with pytest.raises(ValueError, match="cross join"):
        match(port, "(a:Ship), (p:Berth)")
    with pytest.raises(ValueError, match="one relationship"):
        match(port, "(a:Ship)-[r:TOWS]->(b)-[r:TOWS]->(c)")
    with pytest.raises(ValueError, match="no pattern"):
        match(port, "(a:Ship)-[:TOWS]->(b),")
    with pytest.raises(ValueError, match="no bound tables"):
        match(port, "(a:Ship)-[:TOWS]->(b), (b:Berth)-[:CALLS_AT]-(c)")


def made_by_joins(df):
    """How many rows each join of a collected DataFrame made."""
    out, left = [], [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        if "Join" in node.nodeName():
            out.append(node.metrics().get("numOutputRows").get().value())
        own = node.executedPlan() if node.nodeName() == "AdaptiveSparkPlan" else node.plan() if node.nodeName().endswith("QueryStage") else None
        left += [own] if own is not None else [node.children().apply(i) for i in range(node.children().size())]
    return out


def test_a_ring_over_a_place_of_many_edges_is_no_product(spark, model):
    keys = lambda n, name: spark.range(n).selectExpr(f"id AS {name}")
    vertices = {"Nation": keys(2, "n_nationkey"), "Customer": keys(100, "c_custkey"), "Supplier": keys(100, "s_suppkey"), "Order": keys(300, "o_orderkey"), "LineItem": spark.range(300).selectExpr("id AS l_orderkey", "1 AS l_linenumber")}
    g = PropertyGraph(model, vertices)
    g = g.bind_edge("BASED_IN", "Customer", "Nation", spark.range(100).selectExpr("id", "id % 2 AS n"), ["id"], ["n"]).bind_edge("BASED_IN", "Supplier", "Nation", spark.range(100).selectExpr("id", "id DIV 50 AS n"), ["id"], ["n"])
    g = g.bind_edge("PLACED_BY", "Order", "Customer", spark.range(300).selectExpr("id", "id % 100 AS c"), ["id"], ["c"]).bind_edge("HAS_LINE", "Order", "LineItem", spark.range(300).selectExpr("id", "1 AS n"), ["id"], ["id", "n"])
    g = g.bind_edge("SUPPLIED_BY", "LineItem", "Supplier", spark.range(300).selectExpr("id", "1 AS n", "id * 7 % 100 AS s"), ["id", "n"], ["s"])
    found = match(g, "(o:Order)-[:PLACED_BY]->(c:Customer)-[:BASED_IN]->(n:Nation), (o)-[:HAS_LINE]->(l:LineItem)-[:SUPPLIED_BY]->(s:Supplier)-[:BASED_IN]->(n)")
    assert sorted(r.o_o_orderkey for r in found.collect()) == [o for o in range(300) if o % 2 == o * 7 % 100 // 50]
    assert len(made := made_by_joins(found)) == 9 and max(made) <= 300, "customers of a nation never meet its suppliers without an order between them"


def test_a_filter_at_one_end_of_several_chains_comes_first(spark, port):
    ships = spark.range(200).selectExpr("id AS imo", "CASE WHEN id = 7 THEN 'oslo' ELSE 'malta' END AS flag")
    g = PropertyGraph(port.model, {"Ship": ships}, {("TOWS", "Ship", "Ship"): spark.range(2000).selectExpr("id DIV 10 AS src_imo", "id * 13 % 200 AS dst_imo")})
    found = match(g, "(a:Ship)-[:TOWS]->(b:Ship), (b)-[:TOWS]->(c:Ship {flag: 'oslo'})")
    ways = [(i // 10, i * 13 % 200) for i in range(2000)]
    assert sorted((r.a_imo, r.b_imo) for r in found.collect()) == sorted((a, b) for a, b in ways for x, y in ways if b == x and y == 7)
    assert max(made_by_joins(found)) <= 200


def test_edges_to_their_own_row(spark, port):
    loops = PropertyGraph(port.model, port.vertices, {("TOWS", "Ship", "Ship"): spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 3)], "src_imo long, dst_imo long")})
    assert [r.a_imo for r in match(loops, "(a:Ship)-[:TOWS]->(a)").collect()] == [1, 1], "each edge is a match"
    assert [r.a_imo for r in match(loops, "(a:Ship)-[:TOWS*2..]->(a)").collect()] == [1]
    assert sorted((r.a_imo, r.b_imo) for r in match(loops, "(a:Ship)-[:TOWS*0..]->(b), (a)-[:TOWS]->(b)").collect()) == [(1, 1), (1, 1), (1, 2), (2, 3)]


def test_walks_of_any_length(spark, port):
    rows = lambda p, *c: sorted(tuple(r[x] for x in c) for r in match(port, p).collect())
    assert rows("(a:Ship {imo: 1})-[w:TOWS*]->(b)", "b_imo", "w_hops") == [(1, 3), (2, 1), (3, 2)]
    assert rows("(a:Ship {imo: 1})-[w:TOWS*2..]->(b)", "b_imo", "w_hops") == [(1, 3), (2, 4), (3, 2)]
    assert rows("(a:Ship {imo: 1})-[w:TOWS*0..]->(b)", "b_imo", "w_hops") == [(1, 0), (2, 1), (3, 2)]
    assert rows("(b)<-[w:TOWS*]-(a:Ship {imo: 1})", "b_imo", "w_hops") == [(1, 3), (2, 1), (3, 2)], "the walk starts at the place with fewer rows"
    assert rows("(a:Ship {imo: 3})-[w:TOWS|CALLS_AT*]->(x)", "x_type", "x_imo", "x_code", "w_hops") == [("Berth", None, "b", 2), ("Ship", 1, None, 1), ("Ship", 2, None, 2), ("Ship", 3, None, 3), ("Yard", None, "y", 3)]
    assert rows("(a:Ship {imo: 3})-[:TOWS|CALLS_AT*]->(x:Place)", "x_type", "x_code") == [("Berth", "b"), ("Yard", "y")]
    assert rows("(a:Ship {imo: 3})-[:TOWS*]->(b)-[:CALLS_AT]->(p:Berth)", "b_imo", "p_code") == [(1, "b")]
    assert rows("(a:Ship {imo: 9})-[w:TOWS*]->(b)", "b_imo") == []
    assert match(port, "(a:Ship {imo: 9})-[w:TOWS*]->(b)").columns == match(port, "(a:Ship {imo: 1})-[w:TOWS*]->(b)").columns
    seeds = spark.createDataFrame([(2,), (2,), (None,)], "src_imo long")
    assert sorted(map(tuple, reachable(port, "TOWS", seeds=seeds).collect())) == [(2, 1, 2), (2, 2, 3), (2, 3, 1)]
    assert reachable(port, "TOWS", seeds=seeds.where("src_imo = 7")).collect() == []


@pytest.mark.parametrize(("arrow", "least"), [("->", 1), ("->", 3), ("-", 2)])
def test_walks_against_brute_force(spark, port, arrow, least):
    import random

    rng = random.Random(least)
    edges = [(rng.randrange(12), rng.randrange(12)) for _ in range(14)]
    ships = spark.createDataFrame([(i,) for i in range(12)], "imo long")
    g = PropertyGraph(port.model, {"Ship": ships}, {("TOWS", "Ship", "Ship"): spark.createDataFrame(edges, "src_imo long, dst_imo long")})
    ways, want = {*edges} | ({(b, a) for a, b in edges} if arrow == "-" else set()), {}
    for start in range(3, 12):
        level = {start}
        for hops in range(1, 60):
            level = {b for a, b in ways if a in level}
            if hops >= least:
                for node in level:
                    want.setdefault((start, node), hops)
    got = match(g, f"(a:Ship)-[w:TOWS*{least}..]{arrow}(b:Ship)").where("a_imo >= 3")
    assert {(r.a_imo, r.b_imo): r.w_hops for r in got.collect()} == want and got.count() == len(want)


def test_walks_leave_only_their_result(spark, port):
    from pathlib import Path

    from graphloom.operators.graph import checkpoint_folder

    root = Path(checkpoint_folder(spark).removeprefix("file:"))
    before = set(root.glob("work-*"))
    assert match(port, "(a:Ship {imo: 1})-[:TOWS*]->(b)").count() == 3
    assert len(set(root.glob("work-*")) - before) == 1


@pytest.fixture
def arriving(spark, model, tmp_path):
    """Customers, orders and their edges in files, with repeats, dangling ends, null keys and a customer of many orders; and the batch audit of them."""
    from graphloom.streaming import stateful

    orders = [{"o_orderkey": i} for i in [*range(30), 3, 3, None]]
    customers = [{"c_custkey": i, "c_name": f"c{i}"} for i in [*range(6), 4, None]]
    placed = [(i, i % 4 if i < 12 else 5) for i in range(30)] + [(2, 77), (3, 78), (3, 78), (40, 1)]
    g = build(spark, model, {("PLACED_BY", "Order", "Customer"): placed}, Order=orders, Customer=customers)
    plan = plan_audit(model)
    folders = {t: str(tmp_path / "-".join(t)) for t in (("Order",), ("Customer",), ("PLACED_BY", "Order", "Customer"))}
    files = []
    for t, df in ((("Order",), g.vertices["Order"]), (("Customer",), g.vertices["Customer"]), (("PLACED_BY", "Order", "Customer"), g.edges["PLACED_BY", "Order", "Customer"])):
        rows = df.collect()
        (tmp_path / "-".join(t)).mkdir()
        for i in range(0, len(rows), 9):
            spark.createDataFrame(rows[i : i + 9], df.schema).coalesce(1).write.parquet(str(tmp_path / "made" / f"{'-'.join(t)}-{i}"))
            files.append((next((tmp_path / "made" / f"{'-'.join(t)}-{i}").glob("part-*")), folders[t]))
    checks = stateful.keyed_checks(plan, g)
    want = {(r.code, r.label): r.violations for r in plan.only(*(c.label for c in checks)).run(g).collect()}
    return g, plan, folders, files, {k: v for k, v in want.items() if any((c.code, c.label) == k for c in checks)}


@pytest.mark.parametrize("seed", [1, 2])
def test_streams_count_like_batches_in_any_order_and_after_a_restart(spark, arriving, tmp_path, seed):
    import random
    import shutil

    from graphloom.streaming import stateful

    g, plan, folders, files, want = arriving
    assert {c for c, _ in want} == {"key-unique", "cardinality", "foreign-key"} and sum(map(bool, want.values())) >= 5
    random.Random(seed).shuffle(files)
    folder = str(tmp_path / "run")
    counts = lambda: {(r.code, r.label): r.violations for r in stateful.violations(g, plan, folder).collect()}
    run = lambda **o: stateful.audit_keys(stateful.read_tables(spark, g, folders, files=2, **o), plan, folder).awaitTermination()
    for part in (files[: len(files) // 2], files[len(files) // 2 :]):
        for file, to in part:
            shutil.copy(file, f"{to}/{file.parent.name}.parquet")
        run()
    assert counts() == want
    run()
    assert counts() == want, "nothing new, nothing changed"


def test_a_stream_of_many_keys_has_few_states(spark, model, tmp_path, monkeypatch):
    from graphloom.streaming import stateful

    monkeypatch.setattr(stateful, "BUCKETS", 16, raising=False)
    plan, folder, at = plan_audit(model).only("Customer key (c_custkey)", "PLACED_BY to Customer"), str(tmp_path / "run"), tmp_path / "in"
    g = build(spark, model, {("PLACED_BY", "Order", "Customer"): [(1, 1)]}, Customer=[{}], Order=[{}])
    folders = {t: str(at / "-".join(t)) for t in (("Customer",), ("Order",), ("PLACED_BY", "Order", "Customer"))}
    customer, order = g.vertices["Customer"], g.vertices["Order"]
    for low in (0, 1500):  # each customer of the second batch is there already, or new
        customers = spark.range(low // 2, low // 2 + 1500).select(*(F.col("id").alias(c) if c == "c_custkey" else F.lit(None).cast(customer.schema[c].dataType).alias(c) for c in customer.columns))
        customers.write.mode("append").parquet(folders["Customer",])
        spark.range(low, low + 1500).selectExpr("id AS src_o_orderkey", "id * 2 AS dst_c_custkey").write.mode("append").parquet(folders["PLACED_BY", "Order", "Customer"])
        order.write.mode("append").parquet(folders["Order",])
        run = stateful.audit_keys(stateful.read_tables(spark, g, folders), plan, folder)
        run.awaitTermination()
        keys = low // 2 + 1500
        want = {"Customer key (c_custkey)": max(0, 1500 - 750) if low else 0, "PLACED_BY to Customer": low + 1500 - len([x for x in range(low + 1500) if x * 2 < keys])}
        assert {r.label: r.violations for r in stateful.violations(g, plan, folder).collect()} == want
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress) <= 16


def test_a_batch_that_breaks_is_run_again(spark, arriving, tmp_path, monkeypatch):
    import shutil

    from graphloom.streaming import stateful

    g, plan, folders, files, want = arriving
    for file, to in files:
        shutil.copy(file, f"{to}/{file.parent.name}.parquet")
    folder, real, broken = str(tmp_path / "run"), stateful.F.sum, []

    def failing(column):
        if len(broken) < 1:
            broken.append(1)
            raise RuntimeError("lost")
        return real(column)

    monkeypatch.setattr(stateful.F, "sum", failing)
    with pytest.raises(Exception, match="lost"):
        stateful.audit_keys(stateful.read_tables(spark, g, folders), plan, folder).awaitTermination()
    monkeypatch.setattr(stateful.F, "sum", real)
    stateful.audit_keys(stateful.read_tables(spark, g, folders), plan, folder).awaitTermination()
    assert {(r.code, r.label): r.violations for r in stateful.violations(g, plan, folder).collect()} == want


def test_files_of_one_name_count_once(spark, model, tmp_path):
    import shutil

    from graphloom.streaming import stateful

    g = build(spark, model, Customer=[{}, {"c_custkey": 2}])
    g.vertices["Customer"].coalesce(1).write.parquet(str(tmp_path / "made"))
    plan, label = plan_audit(model).only("Customer key (c_custkey)"), "Customer key (c_custkey)"
    for names_only, n in ((True, 0), (False, 2)):
        folder, at = str(tmp_path / f"run-{names_only}"), tmp_path / f"in-{names_only}"
        for day in (1, 2):  # the second day brings the first one's files again
            (at / f"day={day}").mkdir(parents=True)
            for file in (tmp_path / "made").glob("part-*"):
                shutil.copy(file, at / f"day={day}" / file.name)
            streams = stateful.read_tables(spark, g, {("Customer",): str(at / "*")}, names_only=names_only)
            stateful.audit_keys(streams, plan, folder).awaitTermination()
        assert [tuple(r) for r in stateful.violations(streams, plan, folder).collect()] == [("key-unique", label, n)]
    with pytest.raises(ValueError):
        stateful.audit_keys(streams, plan_audit(model).only("Customer.c_name required"), folder)
