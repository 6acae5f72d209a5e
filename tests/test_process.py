"""An extractor that is a program, over tables and streams."""

from __future__ import annotations

import sys

import pytest

from weftline.extract import process
from weftline.sources import events as E
from weftline.sources.store import GraphStore

PROGRAM = """
import json, os, sys
protocol = sys.argv[sys.argv.index("--protocol") + 1]
for line in sys.stdin:
    f = json.loads(line)
    if f["content"] == "stop":
        sys.stderr.write("cannot read " + f["path"]); sys.exit(3)
    if f["content"] == "hang":
        import time; time.sleep(60)
    if f["content"] == "bad":
        print("nonsense"); continue
    print(json.dumps({"protocol": protocol, "type": "node", "label": "File", "id": "file:" + f["path"], "source": os.environ.get("NAME", "p"), "props": {"path": f["path"], "code": f["content"]}}))
    for word in f["content"].split():
        print(); print(json.dumps({"protocol": protocol, "type": "edge", "rel": "IMPORTS_FILE", "from": "file:" + f["path"], "to": "file:" + word, "source": "p"}))
"""


@pytest.fixture
def command(tmp_path):
    path = tmp_path / "extractor.py"
    path.write_text(PROGRAM)
    return [sys.executable, str(path)]


def tree(spark, rows, parts=3):
    return spark.createDataFrame(rows, "path string, content string").repartition(parts)


def test_events_of_a_program(spark, command, tmp_path):
    rows = [(f"f{i}", f"f{(i + 1) % 40} gone é") for i in range(40)] + [("empty", None), (None, "lost"), ("long", "x " * 50_000)]
    found = process.extract(tree(spark, rows), command, env={"NAME": "mine"})
    store = GraphStore(spark, f"{tmp_path}/store")
    done = store.load(found, "n")
    assert (done["nodes"], done["edges"]) == (42, 40)
    assert {r.source for r in store.nodes("n").collect()} == {"mine"} and store.nodes("n").filter("path = 'long'").first().code == "x " * 50_000
    assert E.discarded(found.filter("type = 'node'")) == {"node": 42}
    assert process.extract(tree(spark, rows).limit(0), command).count() == 0


@pytest.mark.parametrize(("content", "want", "more"), [("bad", "bad event", {}), ("stop", "status 3", {}), ("hang", "time limit", {"timeout": 2.0})])
def test_failures_abort(spark, command, content, want, more):
    with pytest.raises(Exception, match=want):
        process.extract(tree(spark, [("a", "b"), ("c", content)]), command, **more).collect()


def test_missing_program(spark):
    with pytest.raises(Exception, match="No such file"):
        process.extract(tree(spark, [("a", "b")]), ["/no/such/program"]).collect()


def test_stream_of_files(spark, command, tmp_path):
    """The same over a stream: each batch's files go through the program."""
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("a", "b"), ("b", "a")], "path string, content string").coalesce(1).write.json(f"{tmp_path}/in/1")
    files = spark.readStream.schema("path string, content string").json(f"{tmp_path}/in/*")
    out = process.extract(files, command).writeStream.format("memory").queryName("made").trigger(availableNow=True).start()
    out.awaitTermination()
    assert spark.table("made").groupBy("type").count().orderBy("type").collect() == [("edge", 2), ("node", 2)]
