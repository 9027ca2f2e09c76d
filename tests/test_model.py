"""Types, model files, resolution, validation, lockfiles, diffs and targets."""

import duckdb
import pytest
from harbour import HARBOUR
from hypothesis import given
from hypothesis import strategies as st

from graphloom.functions.types import ALIASES, parse_type, spark_type
from graphloom.models import warehouse
from graphloom.plans.diff import at_least, classify, diff_models, strongest
from graphloom.plans.ids import derive_id, fnv1a
from graphloom.plans.lint import lint_query
from graphloom.plans.model import Bound, parse_bound
from graphloom.plans.patterns import parse_pattern
from graphloom.plans.resolve import model_of, resolve_model
from graphloom.plans.views import View, parse_views, project_view, types_in_no_view
from graphloom.sinks import FEATURES, TARGETS, Target, emit, register_target
from graphloom.sources.lockfile import ids_not_written, read_lockfile, same, write_lockfile
from graphloom.sources.model_yaml import serialize_model
from graphloom.sources.sql_ddl import detect_format, import_sql

SPACE = 'namespace: { prefix: x, iri: "https://x#" }\n'


@pytest.mark.parametrize(("text", "spark"), [("STRING", "string"), ("LIST<DECIMAL(10,2)>", "array<decimal(10,2)>"), ("FLOAT[128]", "array<double>"), ("INT64[][]", "array<array<bigint>>"), ("STRUCT(at TIMESTAMP, v DOUBLE[])[]", "array<struct<at:timestamp_ntz,v:array<double>>>"), ("MAP(STRING, UINT8)", "map<string,smallint>"), ("UNION(n DOUBLE, t STRING)", "struct<tag:string,n:double,t:string>"), ("zoned_datetime", "timestamp"), ("Timestamp TZ", "timestamp"), ("int", "bigint"), ("int32", "int"), ("decimal", "decimal(18,3)"), ("int128", "decimal(38,0)"), ("uint64", "decimal(20,0)"), ("json", "string"), ("LIST<STRING NOT NULL>", "array<string>")])
def test_types(text, spark):
    assert spark_type(parse_type(text)).simpleString() == spark


@pytest.mark.parametrize("text", ["", "foo", "STRUCT(a)", "LIST<", "MAP(STRING)", "INT[x]", "STRING STRING"])
def test_no_types(text):
    assert parse_type(text) is None


@given(st.sampled_from(sorted(ALIASES)), st.integers(0, 3))
def test_type_text_round_trip(spelling, lists):
    t = parse_type(spelling.lower() + "[]" * lists)
    assert parse_type(str(t)) == t


@pytest.mark.parametrize(("text", "bound"), [("*", Bound()), ("2", Bound(2, 2)), ("1..2", Bound(1, 2)), ("1..*", Bound(1)), ("x", None), ("1..", None)])
def test_bounds(text, bound):
    assert parse_bound(text) == bound
    assert bound is None or parse_bound(str(bound)) == bound


def test_ids():
    assert fnv1a("") == 0x811C9DC5 and fnv1a("a") == 0xE40C292C
    assert derive_id("node", "A") == derive_id("node", "A") != derive_id("node", "A", taken={derive_id("node", "A")})


def codes(body, space=SPACE):
    return [d.code for d in resolve_model("m", lambda p: space + body if p == "m" else None)[1]]


@pytest.mark.parametrize(
    ("body", "code"),
    [
        ("nodes: { A: { key: [k], props: { k: { type: wat } } } }", "unknown-type"),
        ("nodes: { A: { key: [k], props: { k: {} } } }", "missing-type"),
        ("nodes: { A: { key: [k], props: { k: 3 } } }", "malformed-property"),
        ("nodes: { A: 3 }", "malformed-node"),
        ("nodes: { A: {} }", "missing-key"),
        ("nodes: { A: { key: [z] } }", "key-unknown-property"),
        ("nodes: { A: { key: [k], props: { k: { type: 'string[]' } } } }", "list-key"),
        ("nodes: { A: { key: [k], props: { k: { type: 'STRUCT(a INT)' } } } }", "composite-key-property"),
        ("nodes: { A: { abstract: true, extends: B }, B: { abstract: true, extends: A } }", "cyclic-inheritance"),
        ("nodes: { A: { abstract: true, extends: Z } }", "unresolved-parent"),
        ("nodes: { A: { abstract: true, mixins: [Z] } }", "unresolved-mixin"),
        ("nodes: { A: { abstract: true, props: { p: { type: int, enum: Z } } } }", "unresolved-enum"),
        ("enums: { E: { values: [a] } }\nnodes: { A: { abstract: true, props: { p: { type: int, enum: E } } } }", "enum-type-mismatch"),
        ("enums: { E: { values: [a, a] } }", "duplicate-enum-value"),
        ("enums: { E: { values: [] } }", "empty-enum"),
        ("enums: { E: 3 }", "malformed-enum"),
        ("nodes: { A: { abstract: true, props: { p: { type: string, min: 1 } } } }", "constraint-type-mismatch"),
        ("nodes: { A: { abstract: true, props: { p: { type: int, min: 2, max: 1 } } } }", "impossible-constraint"),
        ("nodes: { A: { abstract: true, props: { p: { type: string, pattern: '(' } } } }", "malformed-pattern"),
        ("nodes: { A: { abstract: true, props: { p: { type: 'FLOAT[0]' } } } }", "empty-array-type"),
        ("nodes: { A: { abstract: true, props: { p: { type: 'MAP(INT[], INT)' } } } }", "composite-map-key"),
        ("nodes: { A: { abstract: true, props: { p: { type: 'STRUCT(a INT, a INT)' } } } }", "duplicate-type-field"),
        ("edges: { E: { from: A, to: A } }", "unresolved-endpoint"),
        ("nodes: { A: { abstract: true } }\nedges: { E: { from: A } }", "missing-endpoint"),
        ("nodes: { A: { abstract: true } }\nedges: { E: { from: A, to: A, cardinality: some } }", "unknown-cardinality"),
        ("nodes: { A: { abstract: true } }\nedges: { E: { from: A, to: A, cardinality: 3 } }", "malformed-cardinality"),
        ("nodes: { A: { abstract: true } }\nedges: { E: { from: A, to: A, cardinality: { to: 3..1 } } }", "impossible-cardinality"),
        ("edges: { E: 3 }", "malformed-edge"),
        ("nodes: { A: { abstract: true, constraints: [{ name: c, assert: { foo: [a, b] } }] } }", "unknown-assertion"),
        ("nodes: { A: { abstract: true, constraints: [{ name: c }] } }", "malformed-constraint"),
        ("nodes: { A: { abstract: true, constraints: [{ name: c, assert: { equals: [a, b] } }] } }", "unresolved-operand"),
        ("nodes: { A: { abstract: true, props: { a: { type: int }, b: { type: int } }, constraints: [{ name: c, severity: huge, assert: { equals: [a, b] } }] } }", "unknown-severity"),
        ("nodes: { A: { abstract: true }, B: { abstract: true, constraints: [{ name: c, assert: { count: { edge: E, min: 1 } } }] } }\nedges: { E: { from: A, to: A } }", "unreachable-edge"),
        ("nodes: { A: { abstract: true, constraints: [{ name: c, assert: { count: { edge: E, of: B, min: 1 } } }] }, B: { abstract: true } }\nedges: { E: { from: A, to: A } }", "incompatible-qualifier"),
        ("nodes: { A: { abstract: true, id: i }, B: { abstract: true, id: i } }", "duplicate-id"),
        ("mixins: { M: { props: {} } }", "unused-mixin"),
        ("mixins: { M: { props: { p: { type: int } } } }\nnodes: { A: { abstract: true, mixins: [M], props: { p: { type: int } } } }", "shadowed-mixin-property"),
        ("prefixes: { a: 3 }", "malformed-prefix"),
        ("imports: [3]", "malformed-import"),
        ("imports: [gone.yaml]", "missing-import"),
        ("lpg: 'x'", "unknown-format-version"),
        ("lpg: '7.0'", "unsupported-format-version"),
    ],
)
def test_diagnostics(body, code):
    assert code in codes(body)


def test_file_diagnostics():
    assert codes("a: [", "") == ["yaml-syntax"] and codes("3", "") == ["malformed-model"]
    assert "missing-namespace" in codes("nodes: {}", "") and "malformed-namespace" in codes("namespace: 3", "")


def test_imports_and_inheritance():
    files = {
        "d/app.yaml": 'namespace: { prefix: a, iri: "https://a#" }\nprefixes: { z: "https://mine#" }\nimports: [{ path: ../c/base.yaml, as: c }, ../v/copy.yaml]\nnodes: { Worker: { extends: "c:Party", mixins: [M], props: { badge: { type: string } } } }\nmixins: { M: { props: { id: { type: int }, at: { type: date } } } }',
        "c/base.yaml": 'namespace: { prefix: c, iri: "https://c#" }\nprefixes: { z: "https://theirs#", y: "https://y#" }\nnodes: { Party: { abstract: true, key: [id], props: { id: { type: string } } } }',
        "v/copy.yaml": 'namespace: { prefix: c2, iri: "https://c#" }\nnodes: { Other: { abstract: true } }',
    }
    m, said = resolve_model("d/app.yaml", files.get)
    assert [d.severity for d in said] == [] and [n.name for n in m.nodes] == ["Party", "Worker"]
    w = m.node("Worker")
    assert w.ancestors == ("Party",) and w.key == ("id",) and w.key_inherited_from == "Party"
    assert [(p.name, p.scalar) for p in w.props] == [("badge", "string"), ("id", "int"), ("at", "date")], "a mixin's property goes before an ancestor's"
    assert m.prefixes["z"] == "https://mine#" and m.prefixes["y"] == "https://y#"
    files["d/app.yaml"] += "\nedges: {}"
    files["c/base.yaml"] = files["c/base.yaml"].replace("Party:", "Worker: { abstract: true }, Party:")
    assert "sealed-import" in [d.code for d in resolve_model("d/app.yaml", files.get)[1]]


@pytest.mark.parametrize("m", [warehouse.model(), model_of(HARBOUR)])
def test_round_trips(m):
    assert same(model_of(serialize_model(m)), m)
    back, revision, said = read_lockfile(write_lockfile(m, 4))
    assert same(back, m) and revision == 4 and not said


def test_lockfile_errors():
    assert read_lockfile("{}")[2][0].code == "malformed-lockfile"
    assert {d.code for d in ids_not_written(model_of(SPACE + "nodes: { A: { abstract: true } }"))} == {"ids-not-written"}
    assert not ids_not_written(model_of(HARBOUR))


def test_classes():
    assert classify("added", "loosens") == "additive" and classify("retyped", "unknown") == "breaking" and classify("moved", "tightens") == "additive" and classify("renamed", "loses-data") == "destructive"
    assert strongest(["loosens", "unknown", "tightens"]) == "unknown" and at_least("breaking", "additive") and not at_least("additive", "breaking")
    a = model_of(HARBOUR)
    assert diff_models(a, a) == []
    kinds = {c.kind: c.change_class for c in diff_models(a, a.edit_node("Ship", open=True).edit_node("Berth", abstract=True).edit_node("Yard", extends=None, iri="https://q"))}
    assert kinds == {"openness-changed": "additive", "abstract-changed": "destructive", "hierarchy-changed": "breaking", "iri-changed": "breaking"}


@pytest.mark.parametrize("target", TARGETS)
def test_targets(target):
    for m in (warehouse.model(), model_of(HARBOUR)):
        made = emit(m, target)
        assert made.content and set(TARGETS[target].capabilities) == set(FEATURES)


def test_sqlpgq_enforces():
    m = model_of(SPACE + 'enums: { E: { values: [a] } }\nnodes: { A: { key: [k], props: { k: { type: int }, n: { type: int, min: 1, max: 3 }, s: { type: string, pattern: "^x", minLength: 2 }, u: { type: string, unique: true }, e: { type: string, enum: E }, b: { type: int }, c: { type: int } }, constraints: [{ name: bc, assert: { equals: [b, c] } }, { name: one, assert: { atLeastOne: [n, s] } }] } }\nedges: { R: { from: A, to: A, cardinality: many-to-one } }')
    db = duckdb.connect()
    for s in emit(m, "sqlpgq").content.split(";\n\n")[:-1]:
        db.execute(s)
    db.execute("INSERT INTO A VALUES (1, 2, 'xy', 'u', 'a', NULL, NULL), (2, NULL, 'xyz', 'v', NULL, 1, 1)")
    db.execute("INSERT INTO R VALUES (1, 2)")
    for bad in ("A VALUES (1, 2, NULL, NULL, NULL, NULL, NULL)", "A VALUES (3, 4, NULL, NULL, NULL, NULL, NULL)", "A VALUES (3, 1, 'yx', NULL, NULL, NULL, NULL)", "A VALUES (3, 1, NULL, 'u', NULL, NULL, NULL)", "A VALUES (3, 1, NULL, NULL, 'b', NULL, NULL)", "A VALUES (3, 1, NULL, NULL, NULL, 1, NULL)", "A VALUES (3, NULL, NULL, NULL, NULL, 1, 1)", "R VALUES (1, 1)", "R VALUES (9, 1)"):
        with pytest.raises(duckdb.Error):
            db.execute("INSERT INTO " + bad)


def test_plugins():
    with pytest.raises(ValueError):
        register_target(TARGETS["owl"])
    with pytest.raises(ValueError):
        register_target(Target("mine", "txt", lambda m: "", {}))
    register_target(Target("mine", "txt", lambda m: m.prefix, dict.fromkeys(FEATURES, "enforced")))
    assert emit(warehouse.model(), "mine").content == "wh"
    del TARGETS["mine"]


def lint(q):
    return [d.code for d in lint_query(model_of(HARBOUR), q)]


@pytest.mark.parametrize(
    ("query", "found"),
    [
        ("MATCH (s:Shp) RETURN s", ["lint-unknown-label"]),
        ("MATCH (s:Ship)-[:TOWED]->(t) RETURN s", ["lint-unknown-edge"]),
        ("MATCH (b:Berth)-[:CALLS_AT]->(s:Ship) RETURN b", ["lint-edge-direction"]),
        ("MATCH (y:Yard)-[:TOWS]->(s:Ship) RETURN y", ["lint-edge-endpoint"]),
        ("MATCH (s:Ship) WHERE s.sign = 'x' RETURN s", ["lint-unknown-property"]),
        ("MATCH (s:Ship {sign: 'x'}) RETURN s", ["lint-unknown-property"]),
        ("MATCH (b:Berth) WHERE b.metres = 'long' RETURN b", ["lint-type-mismatch"]),
        ("MATCH (b:Berth) WHERE 'long' = b.metres RETURN b", ["lint-type-mismatch"]),
        ("MATCH (s:Ship {flag: 'genoa'}) RETURN s", ["lint-enum-value"]),
        ("MATCH (s:Ship) RETURN 'open", ["lint-unreadable"]),
        ("MATCH (s:Shp) RETURN s; MATCH (t:Gone RETURN 'x", ["lint-unreadable", "lint-unknown-label"]),
        # and what must stay quiet
        ("MATCH (s:Ship)-[c:CALLS_AT {eta: date()}]->(p:Place) WHERE s.callSign = $sign AND c.eta > 3 RETURN p.code AS v", []),
        ("MATCH (p:Place) RETURN p.metres", []),
        ("MATCH (b:Berth:Place) WHERE b.code IN ['a'] RETURN count(b)", []),
        ("MATCH (n) WHERE n.whatever = 3 RETURN n", []),
        ("MATCH (y:Yard)<-[:CALLS_AT]-(s:Ship) RETURN y.owner", []),
        ("MATCH (s:Ship)-[:TOWS*1..3]->(t) RETURN t", []),
        ("MATCH (p:Berth|Yard) RETURN p.zzz", []),
        ("MATCH (s:Ship) WITH s.callSign AS s RETURN s.zzz", []),
        ("MATCH (b:Berth) WHERE b.metres = -4 // b:Nope.x\nRETURN b", []),
        ("MATCH (s:Ship) WHERE s.callSign = 'a:b (s:Nope)' RETURN s", []),
    ],
)
def test_lint(query, found):
    assert lint(query) == found


def test_patterns():
    a, r, b = parse_pattern("(a:X:Y {k: 'v', n: 3})<-[e:R|S*2..4]-(b)")
    assert (a.labels, a.props["k"].value, a.props["n"].value, r.types, r.direction, r.least, r.most, b.variable) == (("X", "Y"), "v", 3, ("R", "S"), "in", 2, 4, "b")
    assert parse_pattern("(a)--(b)")[1].direction == "any" and parse_pattern("(a)-[*]->(b)")[1].most is None
    with pytest.raises(ValueError):
        parse_pattern("(a)-[:R]->")


def test_views():
    m = model_of(HARBOUR)
    v = parse_views("views: { all: { include: '*' }, ships: { include: [Ship], expand: 1 }, odd: 3 }")
    assert v == [View("all", ("*",)), View("ships", ("Ship",), 1)]
    assert {n.name for n in project_view(m, v[1]).nodes} == {"Ship", "Craft", "Place"} and {e.name for e in project_view(m, v[1]).edges} == {"CALLS_AT", "TOWS"}
    assert {d.target for d in types_in_no_view(m, v[1:])} == {"Berth", "Yard"} and not types_in_no_view(m, v)


def test_sql_import():
    m, said = import_sql("""
-- a dump
CREATE TYPE public.mood AS ENUM ('sad', 'it''s');
CREATE TABLE "Per son" (id bigserial PRIMARY KEY, name varchar(20) NOT NULL, m mood, tags text[], x box, at timestamp(3) with time zone);
CREATE TABLE pet (id int, owner_id bigint NOT NULL, vet_id bigint REFERENCES "Per son", PRIMARY KEY (id));
ALTER TABLE ONLY public.pet ADD CONSTRAINT pet_owner FOREIGN KEY (owner_id) REFERENCES "Per son"(id), ADD CONSTRAINT u UNIQUE (owner_id);
CREATE TABLE likes (a bigint REFERENCES "Per son"(id), b int REFERENCES pet(id), since date, PRIMARY KEY (a, b));
CREATE UNIQUE INDEX i ON "Per son" (name); GRANT ALL ON pet TO x;
""")
    person = m.node("PerSon")
    assert [(p.name, str(p.type), p.required, p.unique) for p in person.props] == [("id", "int", True, False), ("name", "string", True, True), ("m", "string", False, False), ("tags", "string[]", False, False), ("x", "string", False, False), ("at", "zoneddatetime", False, False)]
    assert person.prop("name").max_length == 20 and person.prop("m").enum == "Mood" and m.enum("Mood").values == ("sad", "it's")
    assert {(e.name, e.source, e.target, str(e.sources), str(e.targets)) for e in m.edges} == {("PET_OWNER", "Pet", "PerSon", "0..1", "1"), ("VET", "Pet", "PerSon", "*", "0..1"), ("LIKES", "PerSon", "Pet", "*", "*")}
    assert [p.name for p in m.edge("LIKES").props] == ["since"] and [p.name for p in m.node("Pet").props] == ["id"]
    assert {d.code for d in said} == {"import-skipped", "import-unknown-type", "import-sequence"}
    assert detect_format("a.sql", "") == "sql" and detect_format("a", "create node table X()") == "ladybug" and detect_format("a", "?") is None


def test_command_line(tmp_path, capsys):
    from graphloom.__main__ import main

    model, lock, query = tmp_path / "m.yaml", tmp_path / "m.lock", tmp_path / "q.cypher"
    model.write_text(HARBOUR)
    assert main(["check", str(model)]) == 0 and main(["ids", str(model)]) == 0 and main(["lock", str(model), "--lockfile", str(lock)]) == 0
    model.write_text(HARBOUR.replace("TOWS", "PULLS"))
    assert main(["diff", str(model), "--lockfile", str(lock)]) == 0 and "renamed from 'TOWS'" in capsys.readouterr().out
    assert main(["diff", str(model), "--lockfile", str(lock), "--fail-on", "breaking"]) == 1
    assert main(["migrate", str(model), "--lockfile", str(lock)]) == 0 and "retype-edges TOWS" in capsys.readouterr().out
    query.write_text("MATCH (s:Nobody) RETURN s")
    assert main(["lint-queries", str(model), str(query)]) == 1 and main(["emit", str(model), "--target", "gql"]) == 0 and main(["targets"]) == 0 and main(["describe", str(model), "Ship"]) == 0
    model.write_text("nodes: 3")
    assert main(["check", str(model)]) == 1


def test_importers_read_what_the_targets_write():
    from graphloom.sources.importers import import_texts, register_importer

    m = model_of(HARBOUR)
    tables, said = import_texts({"a.cypher": emit(m, "ladybug").content})
    assert {n.name for n in tables.concrete()} == {"Ship", "Berth", "Yard"} and tables.node("Ship").key == ("imo",) and tables.edge("TOWS").source == "Ship"
    assert tables.node(tables.edge("CALLS_AT").target).abstract and {d.code for d in said} == {"import-union"}
    shapes, _ = import_texts({"a.ttl": emit(m, "shacl").content + emit(m, "owl").content})
    assert {n.name: n.extends for n in shapes.nodes} == {"Craft": None, "Ship": "Craft", "Berth": "Place", "Yard": "Place", "Place": None}
    assert shapes.node("Berth").key == ("code",) and shapes.edge("TOWS").target == "Ship" and shapes.edge("CALLS_AT").target == "Place" and [p.name for p in shapes.edge("CALLS_AT").props] == ["eta"]
    assert shapes.enum(shapes.node("Ship").prop("flag").enum).values == ("malta", "oslo", "panama") and str(shapes.node("Berth").prop("metres").type) == "int"
    both, _ = import_texts({"a.ttl": emit(m, "shacl").content, "b.cypher": emit(m, "ladybug").content})
    assert both.node("Ship").key == ("imo",)
    notes, _ = import_texts({"a.md": emit(m, "tgs").content})
    assert {n.name for n in notes.concrete()} == {"Ship", "Berth", "Yard"} and notes.edge("CALLS_AT").target == "Place"
    assert import_texts({"a.sql": "CREATE TABLE a (b int);", "b.md": ""})[1][0].code == "import-mixed" and import_texts({"x": "?"})[1][0].code == "import-format"
    register_importer("mine", lambda t: (m, []), (".mine",))
    assert import_texts({"x.mine": ""})[0] is m
    with pytest.raises(ValueError):
        register_importer("sql", import_sql)


def test_turtle_syntax():
    from graphloom.sources.turtle import import_turtle, read_triples

    triples, prefixes = read_triples('@prefix x: <http://x#> . x:a a x:B ; x:p "q\\"r"@en, 3.5 ; x:l ( x:c "d" ) . # end\nPREFIX y: <http://y#>\ny:z x:p [ x:q true ] .')
    assert prefixes == {"x": "http://x#", "y": "http://y#"} and len(triples) == 10 and ("http://x#a", "http://x#p", 'q"r') in triples
    assert import_turtle("<a> <b> [")[1][0].code == "turtle-syntax"


def test_shapes_keep_messages_and_severities():
    from graphloom.sources.importers import import_texts

    m = model_of("""
namespace: { prefix: hb, iri: "https://example.org/harbour#" }
enums: { Flag: { values: [malta, oslo] } }
nodes:
  Ship:
    key: [imo]
    props: { imo: { type: int }, low: { type: float }, high: { type: float }, call: { type: string }, mail: { type: string }, flag: { type: string, enum: Flag } }
    constraints:
      - { name: order, assert: { lessThan: [low, high] }, severity: warning, message: "low is below high" }
      - { name: reached, assert: { atLeastOne: [call, mail] }, severity: warning, message: "no way to reach it" }
      - { name: oneWay, assert: { exactlyOne: [call, mail] }, severity: info }
      - { name: towed, assert: { count: { edge: TOWS, of: Ship, max: 2 } }, message: "two at most" }
edges: { TOWS: { from: Ship, to: Ship } }
""")
    text = emit(m, "shacl").content
    assert "sh:datatype xsd:string ; sh:in" in text and text.count("a sh:NodeShape") == 5
    back, _ = import_texts({"a.ttl": text})
    kept = lambda model: [(c.name, c.kind, c.props, c.edge, c.of, c.bound, c.message, c.severity) for c in model.node("Ship").constraints]
    assert kept(back) == kept(m)
