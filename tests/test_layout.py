"""Bucketed tables: the same results, without exchanges of what is bucketed; and ranks over ranges."""

import uuid

import pytest

from graphloom.models import warehouse
from graphloom.operators.audit import plan_audit
from graphloom.operators.graph import PropertyGraph
from graphloom.operators.layout import open_tables, save_graph
from graphloom.operators.match import match
from graphloom.operators.profile import type_ranking

PATTERN = "(o:Order {o_orderpriority: '1-URGENT'})-[:HAS_LINE]->(l:LineItem)-[:OF_PART]->(p:Part)"
BROADCAST = "spark.sql.autoBroadcastJoinThreshold"


@pytest.fixture(scope="module")
def laid_out(spark, small):
    g = warehouse.graph(spark, small)
    some = PropertyGraph(g.model, {k: g.vertices[k] for k in ("Order", "LineItem", "Part", "Customer")}, {k: df for k, df in g.edges.items() if k[0] in ("HAS_LINE", "OF_PART", "PLACED_BY")})
    database, old = f"layout_{uuid.uuid4().hex[:8]}", spark.conf.get(BROADCAST)
    save_graph(some, database, buckets=4, by_target=("OF_PART",))
    spark.conf.set(BROADCAST, "-1")
    yield some, database
    spark.conf.set(BROADCAST, old)
    spark.sql(f"DROP DATABASE {database} CASCADE")


def exchanges(df):
    """Exchanges by hash in the first plan."""
    text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    return text.count("Exchange hashpartitioning")


def test_foreign_keys_need_no_exchange(spark, laid_out):
    some, database = laid_out
    for labels, by_target in ((["HAS_LINE from Order", "OF_PART from LineItem", "PLACED_BY from Order"], ()), (["OF_PART to Part"], ("OF_PART",))):
        g = open_tables(spark, database, some.model, by_target)
        for label in labels:
            plan = plan_audit(some.model).only(label)
            assert plan.run(g).collect() == plan.run(some).collect()
            assert exchanges(plan.run(g)) == 0 < exchanges(plan.run(some)), label


def test_matches_exchange_only_what_the_joins_made(spark, laid_out):
    some, database = laid_out
    found, plain = match(open_tables(spark, database, some.model), PATTERN), match(some, PATTERN)
    assert found.count() == plain.count() > 0
    # orders meet their edges where they lie, and lines theirs; what the joins have made moves to the lines' and the parts' keys
    assert exchanges(found) == 2 and exchanges(plain) >= 5


def test_ranking_over_ranges(spark):
    rows = spark.createDataFrame([(x,) for i, x in enumerate("abcdefgh") for _ in range(i % 4 + 1)], "x string")
    got = [(r.x, r.n, r["rank"]) for r in type_ranking(rows, of="x").orderBy("rank").collect()]
    assert got == [("d", 4, 1), ("h", 4, 2), ("c", 3, 3), ("g", 3, 4), ("b", 2, 5), ("f", 2, 6), ("a", 1, 7), ("e", 1, 8)]
    assert {r.ambiguous for r in type_ranking(rows, of="x", ties=True).collect()} == {True} and type_ranking(rows.limit(0), of="x").count() == 0
    assert {r.ambiguous for r in type_ranking(rows.where("x < 'h'"), of="x", ties=True).collect()} == {False}
