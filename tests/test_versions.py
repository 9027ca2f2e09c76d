"""Versions of a graph on disk: migrations that break and resume, and what readers see meanwhile."""

import pytest
from harbour import HARBOUR
from pyspark.sql import DataFrameWriter

from graphloom.operators.graph import PropertyGraph
from graphloom.operators.versions import current, drop_version, migrate_folder, open_graph, write_graph
from graphloom.plans.resolve import model_of


@pytest.fixture
def kept(spark, tmp_path):
    m = model_of(HARBOUR)
    ships = spark.createDataFrame([(i, f"s{i}", "oslo", 3.0) for i in (1, 2, 3)], "imo long, callSign string, flag string, draught double")
    calls = spark.createDataFrame([(1, "b", None), (3, "b", None)], "src_imo long, dst_code string, eta date")
    g = PropertyGraph(m, {"Ship": ships, "Berth": spark.createDataFrame([("b", 90, None)], "code string, metres long, surveyedOn date")}, {("TOWS", "Ship", "Ship"): spark.createDataFrame([(1, 2), (2, 3)], "src_imo long, dst_imo long"), ("CALLS_AT", "Ship", "Berth"): calls})
    folder = str(tmp_path / "graph")
    assert write_graph(g, folder, 1) == ["Berth", "CALLS_AT-Ship-Berth", "Ship", "TOWS-Ship-Ship"]
    return m, m.edit_node("Ship", key=("callSign",)), folder


def rows(graph, *table):
    return sorted(map(tuple, (graph.vertices[table[0]] if len(table) == 1 else graph.edges[table]).collect()))


def test_a_migration_that_breaks_is_resumed(spark, kept, monkeypatch):
    before, after, folder = kept
    reader = open_graph(spark, folder, before)
    write, done = DataFrameWriter.parquet, []

    def breaking(self, path, *a, **k):
        if len(done) == 2:
            raise OSError("lost")
        done.append(path)
        return write(self, path, *a, **k)

    monkeypatch.setattr(DataFrameWriter, "parquet", breaking)
    with pytest.raises(OSError, match="lost"):
        migrate_folder(spark, folder, before, after)
    monkeypatch.setattr(DataFrameWriter, "parquet", write)
    assert len(done) == 2 and current(spark, folder).revision == 1
    assert rows(open_graph(spark, folder, before), "TOWS", "Ship", "Ship") == [(1, 2), (2, 3)], "readers see the old version whole"
    assert migrate_folder(spark, folder, before, after) == ["Ship", "TOWS-Ship-Ship"], "finished tables are left alone"
    moved = open_graph(spark, folder, after)
    assert current(spark, folder).revision == 2 and rows(moved, "TOWS", "Ship", "Ship") == [("s1", "s2"), ("s2", "s3")]
    assert rows(moved, "CALLS_AT", "Ship", "Berth") == [("s1", "b", None), ("s3", "b", None)] and moved.vertices["Ship"].count() == 3
    assert rows(reader, "TOWS", "Ship", "Ship") == [(1, 2), (2, 3)], "a reader of the old version goes on with it"
    assert migrate_folder(spark, folder, before, after) == [], "done is done"


def test_a_table_left_half_written_is_written_anew(spark, kept, tmp_path):
    before, after, folder = kept
    half = tmp_path / "graph" / "v2" / "TOWS-Ship-Ship"
    half.mkdir(parents=True)
    (half / "part-0.parquet").write_bytes(b"half")
    assert "TOWS-Ship-Ship" in migrate_folder(spark, folder, before, after)
    assert rows(open_graph(spark, folder, after), "TOWS", "Ship", "Ship") == [("s1", "s2"), ("s2", "s3")]


def test_other_migrations_don_t_mix(spark, kept, monkeypatch):
    before, after, folder = kept
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        migrate_folder(spark, folder, before, after)
    monkeypatch.undo()
    other = before.edit_node("Ship", key=("imo", "callSign"))
    with pytest.raises(ValueError, match="another migration"):
        migrate_folder(spark, folder, before, other)
    drop_version(spark, folder, 2)
    assert len(migrate_folder(spark, folder, before, other)) == 4
    with pytest.raises(ValueError, match="is current"):
        drop_version(spark, folder, 2)
    with pytest.raises(ValueError, match="can't follow"):
        write_graph(open_graph(spark, folder, other), folder, 1)
    drop_version(spark, folder, 1)
    assert rows(open_graph(spark, folder, other), "TOWS", "Ship", "Ship") == [(1, "s1", 2, "s2"), (2, "s2", 3, "s3")]


def test_nothing_to_open(spark, kept, tmp_path):
    before, after, _ = kept
    for what in (lambda: open_graph(spark, str(tmp_path / "none"), before), lambda: migrate_folder(spark, str(tmp_path / "none"), before, after)):
        with pytest.raises(FileNotFoundError):
            what()
