"""Command line: doctor, reset, vacuum, discover, index, update, status, namespaces, export, stdio, serve, extract, validate."""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.extract import events as X
from weftline.extract import ignore as IG
from weftline.extract import incremental as I
from weftline.operators import text as T
from weftline.service import args as A
from weftline.service import export, rpc
from weftline.service.tools import Tools
from weftline.sources import corpus
from weftline.sources import events as E
from weftline.sources.shared import Kept
from weftline.sources.store import FACTS, FILES, GRACE, GraphStore


def session(master: str | None = None) -> SparkSession:
    """The session of a command."""
    b = SparkSession.builder.appName("weftline").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    return (b.master(master) if master else b).getOrCreate()


def tree(spark: SparkSession, repo: str) -> DataFrame:
    """(path, content) of a working copy."""
    return corpus.read_files(spark, str(Path(repo).resolve()), hidden=True)


def ignore_rules(spark: SparkSession, repo: str) -> DataFrame:
    """The rules of a working copy's ignore files."""
    return IG.rules(IG.ignore_files(corpus.ignore_texts(spark, str(Path(repo).resolve()))))


def index(spark: SparkSession, store: GraphStore, repo: str, namespace: str, mode: str = "fast", merge: bool = False) -> dict:
    """Extract a working copy and store it. With ``merge`` only files that have changed since are scanned; what is stored is
    the same as without."""
    began, root = time.time(), str(Path(repo).resolve())

    def read(paths: DataFrame, n: int) -> DataFrame:
        if n > I.NAMED:
            return corpus.read_files(spark, root, hidden=True).join(paths, "path", "left_semi")
        return corpus.read_files(spark, root, hidden=True, names=[r["path"] for r in paths.collect()])  # at most NAMED

    with Kept() as keep:
        listing = keep(IG.kept(corpus.list_files(spark, root, hidden=True), keep(ignore_rules(spark, repo))))
        relations = True if mode == "full" else X.small(listing)
        old = {t: store.table(t, namespace) if merge else None for t in (FILES, FACTS)}
        now = I.refresh(listing, read, old[FILES], old[FACTS], relations, mode == "full", keep)
        facts, changes = keep(now.facts), {r["change"]: r["count"] for r in now.changes.groupBy("change").count().collect()}
        found = keep(X.link(listing, facts, relations, keep))
        counts = store.load(X.with_summary(found, began), namespace, repo, "typescript", mode, more={FACTS: facts, FILES: now.files})
    return counts | {"scannedFiles": changes.get("scanned", 0), "goneFiles": changes.get("gone", 0), "durationMs": int(1000 * (time.time() - began))}


def graph_tables(store: GraphStore, namespace: str) -> tuple[DataFrame | None, DataFrame | None]:
    """Nodes and edges in the form the operators take, ids without their namespace."""
    nodes, edges = store.nodes(namespace), store.edges(namespace)
    if nodes is None or edges is None:
        return None, None
    n = nodes.select(F.col("source_id").alias("id"), "label", "name", F.coalesce("path", "filePath").alias("path"), "kind", F.col("packageId").alias("package_id"), F.col("startLine").alias("start_line"), F.col("endLine").alias("end_line"), "exported")
    e = edges.select("type", F.col("source_from").alias("src"), F.col("source_to").alias("dst"), F.col("sourceFile").alias("source_file"), F.col("startLine").alias("start_line"), "confidence")
    return n, e


def tools(spark: SparkSession, store: GraphStore, repo: str, namespace: str) -> Tools:
    """The tools over a stored namespace and the working copy. A rebuild scans what has changed, and the tools then serve
    the new graph and the new text."""

    def tables() -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
        return T.scan_lines(tree(spark, repo)).persist(), *graph_tables(store, namespace)

    def rebuild(limit: int, mode: str = "") -> dict:
        entry = store.namespace(namespace)
        return index(spark, store, repo, namespace, mode or (entry["analysis_mode"] if entry else "fast"), merge=True)

    return Tools(spark, *tables(), repo, rebuild, lambda: store.namespace(namespace), tables)


def main(argv: list[str] | None = None) -> int:
    """Run a command."""
    p = argparse.ArgumentParser(prog="weftline", description=__doc__)
    p.add_argument("command", choices=["doctor", "reset", "discover", "index", "update", "status", "namespaces", "export", "stdio", "serve", "extract", "validate", "vacuum"])
    p.add_argument("--repo", default=".")
    p.add_argument("--store", default=None)
    p.add_argument("--namespace", default="default")
    p.add_argument("--mode", choices=["fast", "full"], default="fast")
    p.add_argument("--out", default="graph.html")
    p.add_argument("--port", type=int, default=8765)
    p.add_argument("--all", action="store_true")
    p.add_argument("--master", default=None)
    p.add_argument("--grace", type=float, default=GRACE)
    a = p.parse_args(argv)
    conf = A.settings(a.repo)
    spark = session(a.master or conf.get("master"))
    store = GraphStore(spark, a.store or conf.get("store") or str(Path(a.repo, ".weftline").resolve()))
    say = lambda x: print(A.dumps(x))
    if a.command == "doctor":
        say({"spark": spark.version, "python": sys.version.split()[0], "store": store.root, "namespaces": store.namespaces().count()})
    elif a.command == "reset":
        store.reset_all() if a.all else store.reset(a.namespace)
        store.vacuum(a.grace)
    elif a.command == "vacuum":
        say(store.vacuum(a.grace))
    elif a.command == "discover":
        say(corpus.discover(tree(spark, a.repo)).first().asDict(True))
    elif a.command in ("index", "update"):
        say(index(spark, store, a.repo, a.namespace, a.mode, merge=a.command == "update"))
    elif a.command == "status":
        say(store.status(None if a.all else a.namespace))
    elif a.command == "namespaces":
        say([r.asDict() for r in store.namespaces().collect()])
    elif a.command == "extract":
        began = time.time()
        ignore = IG.ignore_files(corpus.ignore_texts(spark, str(Path(a.repo).resolve())))
        with Kept() as keep:
            X.write_ndjson(X.with_summary(keep(X.extract(tree(spark, a.repo), ignore, keep=keep)), began), a.out)
    elif a.command == "validate":  # all events are made and checked, none is stored
        with Kept() as keep:
            say(E.discarded(keep(X.extract(tree(spark, a.repo), IG.ignore_files(corpus.ignore_texts(spark, str(Path(a.repo).resolve()))), keep=keep))))
    elif a.command == "export":
        nodes, edges = graph_tables(store, a.namespace)
        if nodes is None:
            print("nothing is stored under this name", file=sys.stderr)
            return 1
        Path(a.out).write_text(export.page(nodes, edges, a.namespace), encoding="utf-8")
    elif a.command == "stdio":
        rpc.serve_stdio(tools(spark, store, a.repo, a.namespace))
    else:
        rpc.http_server(tools(spark, store, a.repo, a.namespace), port=a.port).serve_forever()
    return 0


if __name__ == "__main__":
    sys.exit(main())
