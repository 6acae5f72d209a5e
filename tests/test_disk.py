"""What queries leave on disk: how many rows they shuffle, and in which form tables are written."""

from __future__ import annotations

import time
from pathlib import Path

import pytest

from weftline.fixtures import TABLES, VIEWS, view
from weftline.operators import traverse as V
from weftline.service.export import export

EDGES = "type string, src string, dst string, source_file string, start_line long, confidence double"


def shuffled(spark, do):
    """How many rows all shuffles of ``do`` write."""
    sc = spark.sparkContext._jsc.sc()

    def stages():
        sc.listenerBus().waitUntilEmpty()
        none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
        found = sc.statusStore().stageList(None, False, False, none, None)
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = max(stages(), default=-1)
    do()
    return sum(n for i, n in stages().items() if i > before)


@pytest.fixture(scope="module")
def chain(spark, tmp_path_factory):
    """3,000 edges in a row, some of them twice."""
    rows = [("CALLS", f"n{i:04}", f"n{i + 1:04}", "f", 1, None) for i in range(3000) for _ in range(1 + (i % 3 == 0))]
    path = str(tmp_path_factory.mktemp("chain") / "edges")
    spark.createDataFrame(rows, EDGES).write.parquet(path)
    return spark.read.parquet(path)


def test_views_are_compressed_tables(spark):
    found = view(spark, "/root/testdata/sf0.001", "g_nodes")
    assert not found.storageLevel.useMemory and all(".zstd." in f for f in found.inputFiles()) and found.inputFiles()
    assert view(spark, "/root/testdata/sf0.001", "g_nodes").inputFiles() == found.inputFiles()


def test_edges_are_written_in_parts(spark):
    """The parts make up the view, row for row, and nothing that was shuffled for them is left."""

    def left():
        return {f.getName() for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}

    before, folder = left(), "/root/testdata/./sf0.001"  # another name, so the view is made here
    found = view(spark, folder, "g_edges")
    end = time.time() + 20
    while left() - before and time.time() < end:
        time.sleep(0.5)
    assert not left() - before
    for t in TABLES:
        spark.read.parquet(f"{folder}/{t}.parquet").createOrReplaceTempView(t)
    want = spark.sql(f"WITH {VIEWS} SELECT * FROM g_edges")
    assert found.columns == want.columns and found.exceptAll(want).isEmpty() and want.exceptAll(found).isEmpty()


@pytest.mark.parametrize(("direction", "many"), [("forward", 2), ("both", 4)])
def test_trails_shuffle_only_edges_of_the_front(spark, chain, direction, many):
    start, got = spark.createDataFrame([("n0900",)], "id string"), []
    assert shuffled(spark, lambda: got.extend(V.trails(chain, start, 2, direction).collect())) < 60
    assert len(got) == len({(r.start, *r.edges) for r in got}) == many


def test_trails_of_repeated_starts_and_loops(spark):
    """A start that is there twice has its trails twice; a loop is one move, an edge that is there twice one edge."""
    edges = spark.createDataFrame([("CALLS", "a", "a", "f", 1, None), ("CALLS", "a", "b", "f", 1, None), ("CALLS", "a", "b", "f", 1, None)], EDGES)
    start = spark.createDataFrame([("a",), ("a",)], "id string")
    got = sorted(r.nodes for r in V.trails(edges, start, 2, "forward").collect())
    assert got == sorted(2 * [["a", "a"], ["a", "b"], ["a", "a", "b"]])


def test_relations_shuffle_only_edges_of_the_front(spark, chain):
    start, got = spark.createDataFrame([("n0900",)], "id string"), []
    assert shuffled(spark, lambda: got.extend(V.relations(chain, start, depth=3, limit=50, direction="out").collect())) < 60
    assert [r.nodes[-1] for r in got] == ["n0901", "n0902", "n0903"]


def test_shortest_path_shuffles_only_edges_of_the_levels(spark, chain):
    got = []
    assert shuffled(spark, lambda: got.extend(V.shortest_path(spark, chain, "n0900", "n0904", 4).collect())) < 120
    assert [r.nodes for r in got] == [["n0900", "n0901", "n0902", "n0903", "n0904"]]


def test_export_is_compressed(spark, chain, tmp_path):
    nodes = chain.selectExpr("'Symbol' AS label", "src AS id").distinct()
    export(nodes, chain, str(tmp_path / "e"))
    files = [f for f in Path(tmp_path / "e/edges").iterdir() if f.name.startswith("part-")]
    assert files and all(f.name.endswith(".json.gz") for f in files)
    back = [(r.src, r.dst) for f in sorted(files) for r in spark.read.json(str(f)).collect()]
    assert back == sorted((r.src, r.dst) for r in chain.collect())
