"""Catalogs, keys and foreign keys found in small data."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators.catalog import Catalog, merge, properties, sketch
from graphloom.operators import discover
from graphloom.operators.discover import foreign_keys, inclusions, keys_of, least_keys

VERTICES = [
    ("a1", ["Ship", "Craft"], {"imo": "1", "name": "anna", "built": "2001-02-03", "draught": "3.5", "tug": "true"}),
    ("a2", ["Craft", "Ship"], {"imo": "2", "name": "anna", "built": "2001-02-04", "draught": "7", "seen": "2024-01-01 10:00:00"}),
    ("b1", ["Craft", "Buoy"], {"name": "b", "code": "x7"}),
    ("p1", ["Port"], {"code": "1"}),
    ("p2", ["Port"], {"code": "x", "size": None}),
    ("p3", ["Port"], None),
    ("n1", [], {"lost": "1"}),
    ("n2", None, {"lost": "1"}),
]
EDGES = [("a1", "p1", "AT"), ("a2", "p1", "AT"), ("b1", "p2", "AT"), ("a1", "a2", "TOWS"), ("a1", "gone", "AT")]


@pytest.fixture
def elements(spark):
    return spark.createDataFrame(VERTICES, "id string, labels array<string>, props map<string,string>"), spark.createDataFrame(EDGES, "src string, dst string, type string")


def test_types_and_properties(elements):
    c = Catalog(*elements)
    got = {(r.label, r.key): (r.type, r.required, r.low, r.high) for r in c.declared().collect()}
    assert got == {
        ("Ship", "imo"): ("int", True, 1.0, 2.0), ("Ship", "name"): ("string", True, None, None), ("Ship", "built"): ("date", True, None, None), ("Ship", "draught"): ("float", True, 3.5, 7.0), ("Ship", "tug"): ("boolean", False, None, None), ("Ship", "seen"): ("datetime", False, None, None),
        ("Buoy", "name"): ("string", True, None, None), ("Buoy", "code"): ("string", True, None, None), ("Port", "code"): ("string", False, None, None),
    }
    assert {tuple(r) for r in c.types().collect()} == {("Craft", None, True, None), ("Ship", "Craft", False, "imo"), ("Buoy", "Craft", False, "code"), ("Port", None, False, None)}
    assert {tuple(r) for r in c.relations().collect()} == {("AT", "Craft", "Port", "many-to-many"), ("TOWS", "Ship", "Ship", "one-to-one")}


def test_the_model(elements):
    m = Catalog(*elements).model(bounds=True)
    assert [(n.name, n.abstract, n.extends, n.key) for n in m.nodes] == [("Buoy", False, "Craft", ("code",)), ("Craft", True, None, ()), ("Port", False, None, ()), ("Ship", False, "Craft", ("imo",))]
    ship = m.node("Ship")
    assert ship.ancestors == ("Craft",) and (ship.prop("imo").min, ship.prop("imo").max, ship.prop("imo").required, str(ship.prop("built").type)) == (1.0, 2.0, True, "date")
    assert [(e.name, e.source, e.target, str(e.sources), str(e.targets)) for e in m.edges] == [("AT", "Craft", "Port", "*", "*"), ("TOWS", "Ship", "Ship", "0..1", "0..1")]


def test_sketches_merge(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice(["A", "B"])], {"k": str(i), "v": rng.choice(["1", "2.5", "x"]), **({"w": str(i % 7)} if i % 3 else {})}) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, labels array<string>, props map<string,string>")
    whole, parts = sketch(df), merge(*(sketch(df.where(F.col("id") % 3 == k)) for k in range(3)))
    got = lambda s: sorted(map(tuple, properties(s).drop("about").collect()))
    assert got(whole) == got(parts)
    about = {(tuple(r.owner), r.key): r.about for r in properties(parts).collect()}
    assert abs(about[("A",), "w"] - 7) <= 1 and abs(about[("A",), "k"] / sum("A" in r[1] for r in rows) - 1) < 0.08


def test_a_property_that_only_looks_unique_is_no_key(spark):
    rows = [(i, ["T"], {"a": str(i), "b": str(max(i, 1))}) for i in range(3000)]
    assert Catalog(spark.createDataFrame(rows, "id long, labels array<string>, props map<string,string>"), spark.createDataFrame([], "src long, dst long, type string")).types().collect() == [("T", None, False, "a")]


def test_nothing_shows_nothing(spark):
    c = Catalog(spark.createDataFrame([], "id string, labels array<string>, props map<string,string>"), spark.createDataFrame([], "src string, dst string, type string"))
    assert c.types().collect() == c.declared().collect() == c.relations().collect() == [] and c.model().nodes == ()


@pytest.mark.parametrize("seed", range(4))
def test_inclusions_against_brute_force(spark, seed):
    rng = random.Random(seed)
    tables, data = {}, {}
    for t in "pqr":
        n = rng.randint(1, 12)
        columns = {f"{t}_k": rng.sample(range(15), n), f"{t}_a": [rng.choice([None, 1, 2, 3, 4]) for _ in range(n)], f"{t}_s": [rng.choice([None, "1", "x", "y"]) for _ in range(n)]}
        data |= {(t, c): (v, "text" if c.endswith("s") else "whole") for c, v in columns.items()}
        tables[t] = spark.createDataFrame(list(zip(*columns.values(), strict=True)), f"{t}_k long, {t}_a int, {t}_s string")
    for unique_only in (True, False):
        want = set()
        for (t, c), (v, kind) in data.items():
            for (u, d), (w, other) in data.items():
                a, b = [x for x in v if x is not None], [x for x in w if x is not None]
                if (t, c) != (u, d) and kind == other and a and set(a) <= set(b) and (not unique_only or len(b) == len(set(b))):
                    want.add((t, c, u, d, len(set(a)), len(set(b))))
        assert {tuple(r) for r in inclusions(tables, unique_only).collect()} == want


def test_foreign_keys_follow_names(spark):
    ports = spark.createDataFrame([(i, f"p{i}") for i in range(5)], "p_portkey long, p_name string")
    ships = spark.createDataFrame([(i, i % 3, i % 2 if i else None) for i in range(9)], "s_shipkey long, s_portkey int, s_crew int")
    assert foreign_keys({"ports": ports, "ships": ships}).collect() == [("ships", "s_portkey", "ports", "p_portkey")], "s_crew lies in both keys by chance"


@pytest.mark.parametrize("seed", range(4))
def test_least_keys_against_brute_force(spark, seed):
    rng = random.Random(seed)
    n, names = 40, "abcde"
    rows = [tuple(rng.choice([None, 0]) if c == "e" and seed % 2 else rng.randrange(2 + 3 * i) for i, c in enumerate(names)) for _ in range(n)]
    if seed == 3:
        rows = [(*r[:2], i, *r[3:]) for i, r in enumerate(rows)]
    want: list[tuple] = []
    for size in (1, 2, 3):
        for s in itertools.combinations(range(5), size):
            values = [tuple(r[i] for i in s) for r in rows]
            if not any(set(k) <= set(s) for k in want) and len(set(values)) == n and all(x is not None for v in values for x in v):
                want.append(s)
    df = spark.createDataFrame(rows, ", ".join(f"{c} int" for c in names))
    assert least_keys(df) == [tuple(names[i] for i in s) for s in want]
    assert least_keys(df.limit(0)) == [] and keys_of({"t": df}).count() == len(want)


def keys_by_force(rows, names, most=3):
    found: list[tuple] = []
    for size in range(1, most + 1):
        found += [s for s in itertools.combinations(range(len(names)), size) if not any(set(k) <= set(s) for k in found) and len({tuple(r[i] for i in s) for r in rows}) == len(rows)]
    return [tuple(names[i] for i in s) for s in found]


@pytest.mark.parametrize("first", [(), (2_000,), (600, 3_000), (100,)])
@pytest.mark.parametrize("same", [False, True])
def test_least_keys_of_a_table_that_the_driver_sees_little_of(spark, monkeypatch, first, same):
    rng, names = random.Random(5), "abcde"
    rows = [(i // 3, rng.randrange(40), rng.randrange(30), rng.randrange(300), i) for i in range(900)]
    rows = [(*r[:4], r[4] if i else 7) for i, r in enumerate(rows)]  # one repeat among 900
    monkeypatch.setattr(discover, "SEEN", 20)
    monkeypatch.setattr(discover, "FIRST", first)
    monkeypatch.setattr(discover, "HASHES", 2_500)
    if same:  # hashes that differ in a few bits alone: values that differ share them
        whole = discover._hash
        monkeypatch.setattr(discover, "_hash", lambda s, kinds, i: whole(s, kinds, i).bitwiseAND(0xFFF))
    assert least_keys(spark.createDataFrame(rows, ", ".join(f"{c} int" for c in names)).repartition(3)) == keys_by_force(rows, names)


def test_keys_tell_microseconds_and_signs_of_zero(spark, monkeypatch):
    at = "timestamp_micros(1000 * (id DIV 2) + id % 2) AS at"
    df = spark.range(400).selectExpr(at, "CASE WHEN id = 0 THEN -0.0D WHEN id = 1 THEN 0.0D ELSE double(id) END AS zero", "'a' || id AS text")
    assert least_keys(df) == [("at",), ("text",)], "0.0 and -0.0 are one value"
    monkeypatch.setattr(discover, "SEEN", 3)
    assert least_keys(df) == [("at",), ("text",)]


def test_the_search_for_keys_counts_few_sets_over_all_rows(spark, monkeypatch):
    """Many sets are nearly unique; before, each of them was counted over all rows by value."""
    df = spark.range(4_000).selectExpr("id DIV 2 AS a", *(f"CAST(pmod(hash(id, {i}), 2000) AS INT) AS c{i}" for i in range(5)))
    seen = []
    monkeypatch.setattr(discover, "SEEN", 1_000)
    whole = discover._repeated
    monkeypatch.setattr(discover, "_repeated", lambda df, sets, kinds, rows, share, work: seen.extend([s for s in sets if share == 1]) or whole(df, sets, kinds, rows, share, work))
    rows = [tuple(r) for r in df.collect()]
    assert least_keys(df) == keys_by_force(rows, df.columns)
    assert len([s for s in seen if len(s) == 1]) == 0, "some rows show that no column is unique"
