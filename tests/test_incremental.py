"""Audits of changes against audits of all rows."""

import random

import pytest
from harbour import HARBOUR
from pyspark.sql import functions as F

from graphloom.operators.audit import plan_audit
from graphloom.operators.graph import PropertyGraph
from graphloom.operators.incremental import AuditStore
from graphloom.plans.resolve import model_of

SCHEMAS = {("Ship",): "imo long, callSign string, flag string, draught double", ("Berth",): "code string, metres long, surveyedOn date", ("CALLS_AT", "Ship", "Berth"): "src_imo long, dst_code string, eta date"}


@pytest.fixture(scope="module")
def model():
    return model_of(HARBOUR)


def graph(spark, model, rows):
    tables = {t: spark.createDataFrame(own, SCHEMAS[t]) for t, own in rows.items()}
    return PropertyGraph(model, {t[0]: df for t, df in tables.items() if len(t) == 1}, {t: df for t, df in tables.items() if len(t) == 3})


def some(rng, n):
    ship = lambda: (rng.choice([None, *range(8)]), rng.choice([None, "a", "b", "c"]), rng.choice(["malta", "mars"]), rng.choice([None, 3.0, 99.0]))
    berth = lambda: (rng.choice(["x", "y", "z", None]), rng.choice([None, 5]), None)
    call = lambda: (rng.choice([None, *range(9)]), rng.choice(["x", "y", "q", None]), None)
    return {("Ship",): [ship() for _ in range(n)], ("Berth",): [berth() for _ in range(n // 3)], ("CALLS_AT", "Ship", "Berth"): [call() for _ in range(n)]}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_changes_count_like_the_whole(spark, model, tmp_path, seed):
    rng, plan = random.Random(seed), plan_audit(model)
    held = some(rng, 12)
    store = AuditStore(spark, str(tmp_path / "store"), plan, graph(spark, model, held), buckets=4)
    store.build(graph(spark, model, held))
    for step in range(3):
        more = some(rng, 4)
        gone = {t: [own.pop(rng.randrange(len(own))) for _ in range(2)] for t, own in held.items()}
        if step == 1:  # a change of one table alone
            for t in (("Ship",), ("Berth",)):
                held[t] += gone.pop(t)
                del more[t]
        for t, own in more.items():
            held[t] += own
        store.change(graph(spark, model, more), graph(spark, model, gone))
        if step == 1:
            store.compact()
        whole = graph(spark, model, held)
        want = {(r.code, r.label): r.violations for r in plan.run(whole).collect()}
        got = {(r.code, r.label): r.violations for r in store.violations().collect()}
        assert got == {k: want[k] for k in got} and sum(map(bool, got.values())) > 6
        assert {k for k in want if k not in got} == {(c, x) for c, x in want if c == "closed"}


def test_a_change_reads_its_own_folders(spark, model, tmp_path):
    ships = [(i, f"s{i}", "malta", 1.0) for i in range(3000)]
    store = AuditStore(spark, str(tmp_path / "store"), plan_audit(model).only("Ship key (imo)"), graph(spark, model, {("Ship",): ships}))
    store.build(graph(spark, model, {("Ship",): ships}))
    read = spark.read.parquet(str(tmp_path / "store" / store.files.read("STORE")["parts"][0]))
    assert read.select("bucket").distinct().count() > 100
    store.change(added=graph(spark, model, {("Ship",): [(7, "again", "malta", 1.0)]}))
    assert [r.violations for r in store.violations().collect()] == [1]
    store.change(removed=graph(spark, model, {("Ship",): [(7, "again", "malta", 1.0)]}))
    assert [r.violations for r in store.violations().collect()] == [0]
    plan = read.where(F.col("bucket").isin(3))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_a_change_that_breaks_leaves_the_store(spark, model, tmp_path, monkeypatch):
    base = {("Ship",): [(1, "a", "malta", 1.0)]}
    store = AuditStore(spark, str(tmp_path / "store"), plan_audit(model).only("Ship key (imo)"), graph(spark, model, base))
    store.build(graph(spark, model, base))
    again = graph(spark, model, base)
    monkeypatch.setattr(AuditStore, "_add", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        store.change(added=again)
    monkeypatch.undo()
    assert [r.violations for r in store.violations().collect()] == [0]
    store.change(added=again)
    assert [r.violations for r in store.violations().collect()] == [1]
