"""Streaming ingest: a folder of NDJSON event files into runs that are merged like a log.

Every batch writes one run (its nodes and its edges) and then a new version of the list of runs, which is what readers follow:
a batch that fails leaves nothing that is read, and one that is replayed after it was listed is skipped. ``fan`` runs of one
level are merged into one of the next, and once the runs have as many rows as the base, all are merged into a new base;
so the number of runs that a reader meets grows with the logarithm of the batches since the base, and each row is rewritten a
logarithmic number of times. Base rows that no run touches are read as they are.

Nodes and edges arrive in any order. An edge is served once both its ends are there; until then it waits. At a new base, edges
that have waited for more than ``expiry`` batches move to a table of their own, so what waits is bounded. Later batches win,
property by property; within a batch the order is by file name and line.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.sources import events as E
from weftline.sources.folders import Folders

NODE_KEYS, EDGE_KEYS = ["namespace", "id"], ["namespace", "src", "type", "dst", "identity"]
FAN, EXPIRY, GRACE = 4, 1000, 3600.0
EMPTY: dict[str, Any] = {"batch": -1, "base": None, "runs": []}


def _listed(folders: Folders) -> tuple[int, dict[str, Any]]:
    """Number and content of the newest list that is whole."""
    for name in reversed(folders.names("versions")):
        try:
            return int(name.partition(".")[0]), json.loads(folders.text(f"versions/{name}"))
        except ValueError:
            continue
    return 0, dict(EMPTY)


def _list(folders: Folders, number: int, state: dict[str, Any]) -> int:
    if not folders.create(f"versions/{number + 1:020d}.snapshot", json.dumps(state)):
        raise RuntimeError("another stream writes to this folder")
    return number + 1


def _merged(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key; each property as the last row that has it set it."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    return rows.groupBy(*keys).agg(*(last(c) for c in rows.columns if c not in keys)).select(*rows.columns)


class Runs:
    """The tables below one root."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.folders = Folders(spark, self.root)

    def _read(self, name: str, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/data/{name}/{table}")

    def _write(self, nodes: DataFrame, edges: DataFrame, name: str) -> int:
        nodes.write.parquet(f"{self.root}/data/{name}/nodes")
        edges.write.parquet(f"{self.root}/data/{name}/edges")
        return self._read(name, "nodes").count() + self._read(name, "edges").count()

    def _all(self, names: list[str], table: str) -> DataFrame:
        return reduce(DataFrame.unionByName, (self._read(n, table) for n in names))

    def add(self, nodes: DataFrame, edges: DataFrame, batch: int, fan: int = FAN, expiry: int = EXPIRY) -> None:
        """Write a batch's run, list it, and merge what is due."""
        number, state = _listed(self.folders)
        if batch <= state["batch"]:
            return  # replayed
        name = f"run-{batch}-{uuid.uuid4().hex}"
        rows = self._write(nodes, edges, name)
        state = state | {"batch": batch, "runs": [*state["runs"], {"name": name, "level": 0, "rows": rows}]}
        number = _list(self.folders, number, state)
        while len(state["runs"]) >= fan and len({r["level"] for r in state["runs"][-fan:]}) == 1:
            part = [r["name"] for r in state["runs"][-fan:]]
            name = f"run-{batch}-{uuid.uuid4().hex}"
            rows = self._write(_merged(self._all(part, "nodes"), NODE_KEYS), _merged(self._all(part, "edges"), EDGE_KEYS), name)
            state = state | {"runs": [*state["runs"][:-fan], {"name": name, "level": state["runs"][-1]["level"] + 1, "rows": rows}]}
            number = _list(self.folders, number, state)
            if sum(r["rows"] for r in state["runs"]) >= (state["base"] or {"rows": 0})["rows"]:
                state = self._rebased(state, expiry)
                number = _list(self.folders, number, state)

    def _rebased(self, state: dict[str, Any], expiry: int) -> dict[str, Any]:
        """All runs in the base; edges that wait are kept apart, and those that have waited too long further off."""
        name = f"base-{state['batch']}-{uuid.uuid4().hex}"
        place = f"{self.root}/data/{name}"
        self._nodes(state).write.parquet(f"{place}/nodes")
        nodes = self._read(name, "nodes")
        edges = self._edges(state, nodes).withColumn("state", F.when(F.col("attached"), "attached").when(F.col("seq.batch") < state["batch"] - expiry, "expired").otherwise("waiting"))
        edges = self._staged(edges.drop("attached"), f"{place}/staged")
        edges.filter("state <> 'expired'").write.parquet(f"{place}/edges")
        edges.filter("state = 'expired'").drop("state").write.parquet(f"{place}/expired")
        self.folders.delete(f"data/{name}/staged")
        rows = nodes.count() + self._read(name, "edges").count()
        return state | {"base": {"name": name, "rows": rows}, "runs": [], "expired": [*state.get("expired", []), name]}

    def _staged(self, df: DataFrame, path: str) -> DataFrame:
        """Computed once: it is split in two."""
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _nodes(self, state: dict[str, Any]) -> DataFrame:
        names = [r["name"] for r in state["runs"]]
        if state["base"] is None:
            return _merged(self._all(names, "nodes"), NODE_KEYS)
        base = self._read(state["base"]["name"], "nodes")
        return base if not names else _over(base, self._all(names, "nodes"), NODE_KEYS)

    def _base_edges(self, state: dict[str, Any], kind: str) -> DataFrame:
        return self._read(state["base"]["name"], "edges").filter(F.col("state") == kind).drop("state")

    def _edges(self, state: dict[str, Any], nodes: DataFrame) -> DataFrame:
        """All edges but the expired ones, with ``attached``. Attached ones of the base need no look at their ends."""
        names = [r["name"] for r in state["runs"]]
        if state["base"] is None:
            return E.marked(_merged(self._all(names, "edges"), EDGE_KEYS), nodes)
        known, waiting = self._base_edges(state, "attached"), self._base_edges(state, "waiting")
        if names:
            new = self._all(names, "edges")
            waiting = _over(waiting, new.join(_keys(known, EDGE_KEYS), EDGE_KEYS, "left_anti").select(*new.columns), EDGE_KEYS)
            known = _over(known, new.join(_keys(known, EDGE_KEYS), EDGE_KEYS, "left_semi").select(*new.columns), EDGE_KEYS)
        return known.withColumn("attached", F.lit(True)).unionByName(E.marked(waiting, nodes))

    def current(self) -> tuple[DataFrame, DataFrame]:
        """Nodes and attached edges of all batches so far."""
        state = self._state()
        nodes = self._nodes(state)
        return nodes, self._edges(state, nodes).filter("attached").drop("attached")

    def waiting(self) -> DataFrame:
        """Edges that lack an end."""
        state = self._state()
        return self._edges(state, self._nodes(state)).filter("NOT attached").drop("attached")

    def expired(self) -> DataFrame:
        """Edges that were given up."""
        state = self._state()
        found = [self._read(n, "expired") for n in state.get("expired", [])]
        return reduce(DataFrame.unionByName, found) if found else self._edges(state, self._nodes(state)).limit(0).drop("attached")

    def runs(self) -> int:
        """How many folders a reader meets."""
        state = self._state()
        return len(state["runs"]) + (state["base"] is not None)

    def _state(self) -> dict[str, Any]:
        state = _listed(self.folders)[1]
        if state["base"] is None and not state["runs"]:
            raise ValueError(f"no batch has been written below {self.root}")
        return state

    def vacuum(self, grace: float = GRACE) -> int:
        """Remove folders that no list names any more and old lists, both after ``grace`` seconds. Of a former base its
        expired edges stay."""
        number, state = _listed(self.folders)
        used, gone = {r["name"] for r in [*state["runs"], *([state["base"]] if state["base"] else [])]}, 0
        for name in self.folders.names("data"):
            if name in used or self.folders.age(f"data/{name}") < grace:
                continue
            parts = [f"data/{name}"]
            if name in state.get("expired", []):
                parts = [f"data/{name}/nodes", f"data/{name}/edges"]
            for part in parts:
                if self.folders.exists(part):
                    self.folders.delete(part)
                    gone += 1
        for name in self.folders.names("versions"):
            if int(name.partition(".")[0]) < number and self.folders.age(f"versions/{name}") >= grace:
                self.folders.delete(f"versions/{name}")
        return gone


def _keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.select(*keys)


def _over(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` with ``new`` rows merged in; base rows that no new row touches aren't grouped."""
    touched = _keys(new, keys).distinct()
    rest = base.join(touched, keys, "left_anti").select(*base.columns)
    return rest.unionByName(_merged(base.join(touched, keys, "left_semi").select(*base.columns).unionByName(new), keys))


def _order(number: int) -> Column:
    return F.struct(F.lit(number).cast("long").alias("batch"), E.place().alias("place"))


def _write(batch: DataFrame, number: int, root: str, namespace: str, fan: int, expiry: int) -> None:
    good, bad = E.split_valid(batch)
    good = good.withColumn("seq", _order(number)).drop("at")
    bad.select("raw", "error").write.mode("overwrite").parquet(f"{root}/rejected/batch={number}")
    Runs(batch.sparkSession, root).add(E.nodes_of(good, namespace), E.edges_of(good, namespace), number, fan, expiry)


def start(spark: SparkSession, source: str, root: str, namespace: str, checkpoint: str, available_now: bool = True, fan: int = FAN, expiry: int = EXPIRY, files_per_batch: int | None = None) -> StreamingQuery:
    """Start the stream; with ``available_now`` it ends when all files are read."""
    reader = spark.readStream if files_per_batch is None else spark.readStream.option("maxFilesPerTrigger", files_per_batch)
    events = E.parse(E.placed_lines(reader.text(source)))
    writer = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: _write(df, n, root, namespace, fan, expiry))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (last value of each property) and attached edges of all batches so far."""
    return Runs(spark, root).current()
