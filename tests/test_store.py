"""Versions, leases and removal of the store; runs, late edges and replays of the stream."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from weftline.sources import events as E
from weftline.sources.store import GraphStore
from weftline.streaming import ingest


def event(kind, **more):
    return json.dumps({"protocol": E.PROTOCOL, "type": kind, "source": "t"} | {k.rstrip("_"): v for k, v in more.items()})


def rows(spark, *lines):
    return E.parse(spark.createDataFrame([(x,) for x in lines], "value string")).withColumn("seq", F.monotonically_increasing_id())


@pytest.fixture
def store(spark, tmp_path):
    return GraphStore(spark, f"{tmp_path}/store")


def test_removal(spark, store):
    """Nothing goes within the grace; after it what is neither named nor leased; after a reset of all, everything."""
    one = rows(spark, event("node", label="File", id="a"), event("node", label="File", id="b"), event("edge", rel="X", from_="a", to="b"), event("edge", rel="X", from_="a", to="z"))
    assert store.load(one, "one") == {"nodes": 2, "edges": 1, "dropped_edges": 1}
    store.load(one, "one")
    store.load(one, "two")
    assert store.vacuum(3600) == {"versions": 0, "snapshots": 0}
    with store.reading("one") as (nodes, edges):
        store.load(rows(spark, event("node", label="File", id="c")), "one")
        store.reset("two")
        assert store.vacuum(0)["versions"] == 4  # the first version of one, and two
        assert nodes.count() == 2 and edges.count() == 1 and store.nodes("one").count() == 1
    assert store.vacuum(0)["versions"] == 2 and store.nodes("two") is None and store.edges("one").count() == 0
    assert [e["name"] for e in store.entries()] == ["one"] and len(store.folders.names("registry")) == 1
    store.reset_all()
    assert store.folders.size() > 0 and store.status() == {"nodes": 0, "edges": 0}
    store.vacuum(0)
    assert store.folders.size() == 0 and store.entries() == [] and store.namespaces().count() == 0
    store.load(one, "again")
    assert store.status("again") == {"nodes": 2, "edges": 1}


def test_waiting_edge_is_attached_by_a_merge(spark, store):
    store.load(rows(spark, event("node", label="File", id="a"), event("edge", rel="X", from_="a", to="late")), "n")
    assert store.edges("n").count() == 0 and store.waiting("n").count() == 1
    assert store.load(rows(spark, event("node", label="File", id="late")), "n", merge=True) == {"nodes": 2, "edges": 1, "dropped_edges": 0}
    assert store.waiting("n").count() == 0 and store.edges("n").first().source_to == "late"


def test_registry_is_shared(spark, store):
    """Two that register at once both do; a snapshot that is half written doesn't count; an ended lease protects nothing."""
    other, calls = GraphStore(spark, store.root), []

    def slow(entries):
        if not calls:
            calls.append(1)
            other._register("b", "", "", "fast", "v2")
        return [*entries, {"name": "a", "repo": "", "language": "", "analysis_mode": "full", "created_at": "2024-01-01T00:00:00", "updated_at": "2024-01-01T00:00:00", "version": "v1"}]

    store._commit(slow)
    assert [e["name"] for e in store.entries()] == ["a", "b"] and [r.name for r in store.namespaces().collect()] == ["a", "b"]
    store.folders.create("registry/99999999999999999999.snapshot", "[{")
    assert [e["name"] for e in store.entries()] == ["a", "b"]
    store.reset("a")
    assert [e["name"] for e in store.entries()] == ["b"]
    store.folders.create("leases/v9-1-x", "")
    store.vacuum(0)
    assert store.folders.names("leases") == []


def brute(batches):
    """Nodes by id, and edges whose ends are there, after all batches."""
    nodes, edges = {}, {}
    for batch in batches:
        for kind, e in batch:
            if kind == "node":
                nodes.setdefault(e[0], {}).update({k: v for k, v in e[1].items() if v is not None})
            else:
                edges.setdefault(e[:2], {}).update({k: v for k, v in e[2].items() if v is not None})
    return nodes, {k: v for k, v in edges.items() if k[0] in nodes and k[1] in nodes}


def test_runs_equal_one_table(spark, tmp_path):
    """Twelve batches in any order of ends: runs stay few, what is served is that of all events; a replay changes nothing."""
    rng, batches = random.Random(4), []
    for b in range(12):
        batch = []
        for _ in range(15):
            if rng.random() < 0.5:
                batch.append(("node", (f"n{rng.randrange(25)}", {"name": rng.choice([None, f"v{b}"]), "kind": rng.choice([None, f"k{b}"])})))
            else:
                batch.append(("edge", (f"n{rng.randrange(25)}", f"n{rng.randrange(25)}", {"language": rng.choice([None, f"l{b}"])})))
        batches.append(batch)
    runs, counts = ingest.Runs(spark, f"{tmp_path}/out"), []
    for b, batch in enumerate(batches):
        lines = [event("node", label="S", id=e[0], props=e[1]) if kind == "node" else event("edge", rel="X", from_=e[0], to=e[1], props=e[2]) for kind, e in batch]
        got = E.parse(spark.createDataFrame(list(enumerate(lines)), "i long, value string").coalesce(1)).withColumn("seq", F.struct(F.lit(b).cast("long").alias("batch"), F.col("i").alias("place"))).drop("i")
        runs.add(E.nodes_of(got, "ns"), E.edges_of(got, "ns"), b, fan=2, expiry=100)
        counts.append(runs.runs())
    want_nodes, want_edges = brute(batches)
    nodes, edges = runs.current()
    assert {r.source_id: {k: r[k] for k in ("name", "kind") if r[k]} for r in nodes.collect()} == want_nodes
    assert {(r.source_from, r.source_to): {k: r[k] for k in ("language",) if r[k]} for r in edges.collect()} == want_edges
    assert max(counts) <= 5 and runs.expired().count() == 0
    runs.add(nodes.limit(0), edges.limit(0), 3, fan=2)  # replayed
    assert runs.runs() == counts[-1]
    before = len(runs.folders.names("data"))
    assert runs.vacuum(3600) == 0 and runs.vacuum(0) > 0 and len(runs.folders.names("data")) < before
    assert {r.source_id for r in runs.current()[0].collect()} == set(want_nodes)


def test_waiting_edges_expire(spark, tmp_path):
    """An edge waits for its end; after too many batches it is given up and kept apart."""
    runs = ingest.Runs(spark, f"{tmp_path}/out")
    with pytest.raises(ValueError, match="no batch"):
        runs.current()

    def add(b, *lines):
        got = E.parse(spark.createDataFrame([(x,) for x in lines], "value string")).withColumn("seq", F.struct(F.lit(b).cast("long").alias("batch"), F.lit(0).alias("place")))
        runs.add(E.nodes_of(got, "ns"), E.edges_of(got, "ns"), b, fan=2, expiry=2)

    add(0, event("edge", rel="X", from_="a", to="b"), event("edge", rel="X", from_="a", to="never"))
    add(1, event("node", label="S", id="a"))
    assert runs.waiting().count() == 2 and runs.current()[1].count() == 0
    add(2, event("node", label="S", id="b"))
    assert runs.waiting().count() == 1 and runs.current()[1].count() == 1
    for b in range(3, 8):
        add(b, *(event("node", label="S", id=f"x{b}{i}") for i in range(3 * b)))
    assert runs.waiting().count() == 0 and [r.source_to for r in runs.expired().collect()] == ["never"]
    assert runs.current()[1].count() == 1
    runs.vacuum(0)
    assert runs.expired().count() == 1 and runs.current()[1].count() == 1
