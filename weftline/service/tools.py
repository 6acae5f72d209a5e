"""The tools: each takes arguments and gives a small document made of bounded DataFrames."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import predicates as P
from weftline.operators import graph as G
from weftline.operators import text as T
from weftline.operators import traverse as V
from weftline.plans import hybrid as H
from weftline.service import args as A
from weftline.sources import corpus

EMPTY_NODES = "id string, label string, name string, path string, kind string, package_id string, start_line long, exported boolean"
EMPTY_EDGES = "type string, src string, dst string, source_file string, start_line long, confidence double"
FILE_RELATIONS = 8

HELP = """Find a symbol with resolve_symbol, then ask analyze_function_impact who uses it. For a set of files use
analyze_path_set_impact; before a change of several things use prepare_change_plan, before a rename prepare_rename_plan.
Text tools (count_literal_files, find_env_usages, search_literal) need no graph. get_index_freshness says whether the
graph can be relied on; reindex rebuilds it. Every list has a limit and says whether there was more."""


#: Names under which clients send the same argument, the first one advertised.
QUERY, SYMBOL = ("query", "q", "text", "term"), ("symbol", "name", "query", "q", "text", "term")
NODE, FILE = ("targetId", "sourceId", "id", "nodeId", "query"), ("path", "file", "filePath", "query", "q")
FEATURE, CALLEE, REQUIRED = ("query", "q", "feature", "symbol", "name", "path"), ("callee", "function", "symbol", "query", "q"), ("requiredBeforeCall", "required", "precheck", "check", "requiredCall")
ENV, OLD, NAMED = ("envName", "name", "query", "q", "text", "term"), ("oldName", "name", "query", "q", "text", "term"), ("name", "symbol", "query", "q")
FROM, TO, BODY = ("fromId", "from", "sourceId", "startId", "source"), ("toId", "to", "targetId", "endId", "target"), ("symbolId", "id", "targetId", "sourceId")
#: Types of the arguments that are no text.
KINDS = {
    **dict.fromkeys(("limit", "depth", "maxItems", "startLine", "endLine", "contextLines", "matchesPerFile", "timeoutSec"), "integer"), "minConfidence": "number", **dict.fromkeys(("symbols", "paths"), "array"),
    **dict.fromkeys(("useDirty", "includeImpact", "transitive", "includeTests", "includeDocs", "includeConfig", "includeScripts", "includeHidden", "includeTmp", "includeCiJobNames", "includeDockerImageNames", "includeShortNameLiteral"), "boolean"),
}
SCOPE, SWITCHES, SHAPE = ("package", "pathPrefix"), ("includeTests", "includeDocs", "includeConfig", "includeScripts"), ("detail", "limit")


def schema(names: tuple[str, ...], required: tuple[str, ...]) -> dict[str, Any]:
    """The JSON schema of a tool's arguments."""
    kinds = {n: KINDS.get(n, "string") for n in names}
    props = {n: {"type": k} | ({"items": {"type": "string"}} if k == "array" else {}) for n, k in kinds.items()}
    return {"type": "object", "properties": props, "required": list(required), "additionalProperties": True}


class Tools:
    """The tools over one graph and one corpus. Without a graph the text side still answers."""

    def __init__(self, spark: SparkSession, lines: DataFrame, nodes: DataFrame | None = None, edges: DataFrame | None = None, repo: str = ".", rebuild: Callable[..., dict] | None = None, info: Callable[[], dict | None] | None = None, reload: Callable[[], tuple[DataFrame, DataFrame | None, DataFrame | None]] | None = None) -> None:
        self.spark, self.repo, self.rebuild, self.info, self.reload = spark, repo, rebuild, info, reload
        self._serve(lines, nodes, edges)
        back = lambda a: self.relations(a | {"direction": "reverse"})
        trail = ("targetId", "depth", "limit", "minConfidence")
        #: function, description, arguments, required ones, whether advertised
        self.table: dict[str, tuple[Callable[[dict], dict], str, tuple[str, ...], tuple[str, ...], bool]] = {
            "help": (self.help, "How the tools fit together", (), (), True),
            "get_index_freshness": (self.freshness, "Counts and whether the graph is reliable", (), (), True),
            "prepare_feature_context": (self.feature_context, "Files to read for a feature", ("query", "symbol", *SCOPE, *SHAPE), ("query",), True),
            "prepare_change_plan": (self.change_plan, "Files to edit and to verify", ("symbols", "paths", "query", "useDirty", *SCOPE, "detail", "maxItems"), (), True),
            "resolve_symbol": (self.resolve, "Ranked candidates for a name", ("name", "package", "packageId", "pathPrefix", "symbolId", "limit"), ("name",), True),
            "analyze_function_impact": (self.function_impact, "Who defines, imports and calls a symbol", ("symbol", "symbolId", *SCOPE, *SWITCHES, "transitive", "depth", *SHAPE), ("symbol",), True),
            "analyze_path_set_impact": (self.path_set, "What a change of files touches", ("paths", "useDirty", *SHAPE), (), True),
            "prepare_rename_plan": (self.rename_plan, "Mentions under all names of a thing", ("path", "packageName", "shortName", "includeCiJobNames", "includeDockerImageNames", "includeShortNameLiteral", "detail", "limit", "maxItems"), (), True),
            "analyze_rename_impact": (self.rename_impact, "Files that mention an old name", ("oldName", "kind", *SHAPE), ("oldName",), True),
            "analyze_callsite_contract": (self.callsites, "Whether a required call comes before each call", ("callee", "requiredBeforeCall", "includeTests", "includeScripts", *SHAPE), ("callee", "requiredBeforeCall"), True),
            "find_env_usages": (self.env_usages, "Run-time reads of a variable", ("envName", "includeTests", *SHAPE), ("envName",), True),
            "count_literal_files": (self.count_files, "Files with a text", ("query", *SHAPE), ("query",), True),
            "reindex": (self.reindex, "Rebuild the graph", ("analysisMode", "paths", "useDirty", "timeoutSec", "includeImpact"), (), True),
            "search_code": (self.search_code, "Nodes by text", ("query", "limit"), ("query",), True),
            "find_symbol": (self.find_symbol, "Symbols by name", ("name", "limit"), (), True),
            "find_file": (self.find_file, "Files by path", ("path", "limit"), (), True),
            "get_relations": (self.relations, "Trails from a node", (*trail, "direction"), (), True),
            "open_symbol_body": (self.symbol_body, "The lines of a symbol", ("symbolId", "contextLines"), (), True),
            "open_file_excerpt": (self.excerpt, "Lines of a file", ("path", "startLine", "endLine"), (), True),
            "search_literal": (self.search_literal, "Lines with a text", ("query", "matchesPerFile", "includeHidden", "includeTmp", *SHAPE), ("query",), False),
            "get_dependencies": (lambda a: self.relations(a | {"direction": "forward"}), "Trails onward", trail, (), False),
            **{n: (back, "Trails back", trail, (), False) for n in ("get_dependents", "get_impact", "get_route_impact", "get_related_tests")},
            "find_paths": (self.paths, "A shortest path", ("fromId", "toId", "depth"), (), False),
            "list_node_types": (self.types, "Counts by label and type", (), (), False),
            "get_namespace_info": (self.metadata, "The namespace's registry entry and counts", (), (), False),
        }

    def _serve(self, lines: DataFrame, nodes: DataFrame | None, edges: DataFrame | None) -> None:
        """Answer from these tables from now on."""
        self.lines, self.has_graph = lines, nodes is not None and edges is not None
        self.nodes = nodes if self.has_graph else self.spark.createDataFrame([], EMPTY_NODES)
        self.edges = edges if self.has_graph else self.spark.createDataFrame([], EMPTY_EDGES)

    def listing(self) -> list[dict[str, Any]]:
        """Names, descriptions and argument schemas of the advertised tools."""
        return [{"name": n, "description": d, "inputSchema": schema(names, required)} for n, (_, d, names, required, shown) in self.table.items() if shown]

    def call(self, name: str, args: dict) -> dict[str, Any]:
        """A tool's document; KeyError if there is no such tool."""
        return self.table[name][0](args or {})

    def _rows(self, df: DataFrame, limit: int) -> tuple[list[dict], bool]:
        rows = [r.asDict(True) for r in df.limit(limit + 1).collect()]  # bounded by the limit
        return rows[:limit], len(rows) > limit

    def _found(self, key: str, df: DataFrame, limit: int, **more: Any) -> dict[str, Any]:
        rows, cut = self._rows(df, limit)
        return more | {key: rows, "returned": len(rows), "truncated": cut}

    def help(self, a: dict) -> dict:
        return {"help": HELP}

    def freshness(self, a: dict) -> dict:
        """Counts, modes, times and the working copy, and whether the graph is to be relied on."""
        counts = G.status(self.nodes, self.edges).first().asDict()
        calls = G.count_relationships(self.edges, G.CALLS).first()["n"]
        imports = G.count_relationships(self.edges, ("IMPORTS_SYMBOL",)).first()["n"]
        entry = self.info() if self.info else None
        return H.freshness(counts, calls, imports, corpus.git_state(self.repo), entry, self.has_graph) | {"graphAvailable": self.has_graph}

    def metadata(self, a: dict) -> dict:
        """The registry's entry, with the analysis mode (full if none is stored), and counts."""
        counts = G.status(self.nodes, self.edges).first().asDict()
        entry = (self.info() if self.info else None) or {}
        keys = {"name": "namespace", "repo": "repo", "language": "language", "created_at": "createdAt", "updated_at": "updatedAt"}
        return {"nodes": counts["nodes"], "relationships": counts["edges"], "analysisMode": entry.get("analysis_mode") or "full"} | {v: str(entry[k]) for k, v in keys.items() if entry.get(k) is not None}

    def types(self, a: dict) -> dict:
        rows, _ = self._rows(G.type_counts(self.nodes, self.edges).orderBy(F.desc("n"), "name"), 500)
        return {"labels": [r for r in rows if r["family"] == "node"], "relationships": [r for r in rows if r["family"] == "edge"]}

    def search_code(self, a: dict) -> dict:
        n = A.number(a, "limit", 20, 1, 200)
        return self._found("nodes", G.node_lean(G.search_code(self.nodes, A.text(a, *QUERY, "name", "path"), n)), n)

    def find_symbol(self, a: dict) -> dict:
        n = A.number(a, "limit", 20, 1, 200)
        return self._found("symbols", G.find_symbol(self.nodes, A.text(a, "name", "query", "q", "symbol"), n), n)

    def find_file(self, a: dict) -> dict:
        n = A.number(a, "limit", 20, 1, 200)
        return self._found("files", G.find_file(self.nodes, A.text(a, "path", "query", "q", "file"), n), n)

    def resolve(self, a: dict) -> dict:
        name, n = A.text(a, *NAMED), A.number(a, "limit", 20, 1, 100)
        filters = {k: v for k, v in (("package_exact", A.text(a, "packageId")), ("package", A.text(a, "package")), ("prefix", A.text(a, "pathPrefix"))) if v}
        wanted = A.text(a, "symbolId")
        c = (G.node(self.nodes, wanted).withColumn("match", F.lit("exact")).withColumn("n_exact", F.lit(1)).withColumn("n_all", F.lit(1)) if wanted else G.symbol_candidates(self.nodes, name, n, **filters)).persist()
        state = G.resolve_state(c).first()
        rows, _ = self._rows(c.drop("n_exact", "n_all"), n)
        return {"name": name, "exactCount": state.n_exact, "ambiguous": state.ambiguous, "selected": state.selected, "candidates": rows, "returned": len(rows), "truncated": state.n_all > n, "graphAvailable": self.has_graph}

    def _dirty(self) -> list[str]:
        return corpus.git_state(self.repo)["dirty"]

    def function_impact(self, a: dict) -> dict:
        symbol, n = A.text(a, *SYMBOL), A.number(a, "limit", 40, 1, 200)
        package, prefix = A.text(a, "package"), A.text(a, "pathPrefix")
        state = self.resolve({"name": symbol} | {k: a[k] for k in ("package", "packageId", "pathPrefix", "symbolId") if a.get(k)})
        switches = {"tests": A.flag(a, "includeTests", True), "docs": A.flag(a, "includeDocs"), "config": A.flag(a, "includeConfig"), "scripts": A.flag(a, "includeScripts", True)}
        merged = H.function_impact(self.nodes, self.edges, self.lines, symbol, **switches)
        if package or prefix:
            merged = merged.filter(P.path_in_scope(F.col("path"), prefix, package))
        merged = merged.orderBy("path", "bucket").persist()
        totals = merged.groupBy("method").agg(F.countDistinct("path").alias("files"))
        by = {r["method"]: r["files"] for r in totals.collect()}  # at most three rows
        how = "hybrid" if "hybrid" in by or len(by) > 1 else next(iter(by), "text")
        calls, stale = self.has_graph and G.has_call_graph(self.edges), bool(self._dirty())
        out = self._found("files", merged, n, symbol=symbol, resolutionMethod=how, ambiguous=state["ambiguous"], needsDisambiguation=bool(state["ambiguous"]), hasCallGraph=calls, stale=stale)
        level = self.spark.range(1).select(H.impact_confidence(F.lit(how), F.lit(calls), F.lit(bool(state["ambiguous"])), F.lit(stale), F.lit(sum(by.values()))).alias("c")).first()["c"]
        shown = list(dict.fromkeys(r["path"] for r in out["files"]))
        if shown and self.has_graph:
            seeds = self.spark.createDataFrame([(p,) for p in shown[:FILE_RELATIONS]], "path string")
            out["fileRelations"], _ = self._rows(G.file_relations(self.nodes, self.edges, seeds).orderBy("path"), FILE_RELATIONS)
        if A.flag(a, "transitive"):
            out["transitive"], _ = self._rows(T.transitive_impact(self.lines, symbol, A.number(a, "depth", 2, 1, 5)).orderBy("depth", "symbol"), n)
        first = {"definition": 0, "call": 1, "import": 2}
        ranked = sorted(out["files"], key=lambda r: (first.get(r["bucket"], 3), -r["text_hits"], r["path"]))
        merged.unpersist()
        return out | {"confidence": level, "openNext": list(dict.fromkeys(r["path"] for r in ranked))[:5]}

    def callsites(self, a: dict) -> dict:
        n = A.number(a, "limit", 80, 1, 500)
        rows = T.callsites(self.lines, A.text(a, *CALLEE), A.text(a, *REQUIRED), tests=A.flag(a, "includeTests", True), scripts=A.flag(a, "includeScripts", True)).persist()
        sums = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("has_required").cast("int")).alias("ok")).first()
        out = self._found("callSites", rows.orderBy("path", "line", "at"), n, total=sums.n, satisfied=sums.ok or 0, missing=sums.n - (sums.ok or 0))
        rows.unpersist()
        return out

    def _seeds(self, a: dict) -> DataFrame:
        """The given paths and, if wanted, those of changes that aren't committed."""
        paths = A.strings(a, "paths", "path") + (self._dirty() if A.flag(a, "useDirty") else [])
        clean = [p for p in dict.fromkeys(x.replace("\\", "/").removeprefix("./") for x in paths) if p not in ("", ".")]
        if len(clean) > H.MAX_SEEDS:
            raise ValueError(f"at most {H.MAX_SEEDS} paths")
        return self.spark.createDataFrame([(p,) for p in clean], "path string")

    def path_set(self, a: dict) -> dict:
        seeds, n = self._seeds(a), A.number(a, "limit", 40, 1, 200)
        rows = H.path_set_impact(self.nodes, self.edges, self.lines, seeds).persist()
        count = seeds.count()
        both = {r["method"] for r in rows.filter("role <> 'seed'").select("method").distinct().collect()}  # at most four rows
        how = "hybrid" if "hybrid" in both or {"graph", "text"} <= both else "graph" if "graph" in both else "text"
        stale = bool(set(self._dirty()) - {r["path"] for r in seeds.collect()})  # at most 80 rows
        out = self._found("files", rows.orderBy("role", "path"), n, seedCount=count, method=how, stale=stale, confidence=H.path_set_confidence(how, self.has_graph, stale, count))
        verify, _ = self._rows(rows.filter("role IN ('dependent', 'importer', 'test')").orderBy((F.col("role") == "test").cast("int"), "path"), n)
        rows.unpersist()
        must = [r["path"] for r in verify]
        return out | {"mustVerify": must, "order": [r["path"] for r in out["files"] if r["role"] == "seed"] + must, "openNext": must[:5]}

    def change_plan(self, a: dict) -> dict:
        symbols, n = A.strings(a, "symbols", "symbol"), A.number(a, "maxItems", A.number(a, "limit", 100, 1, 400), 1, 400)
        asked = A.text(a, "query")
        if asked and self.spark.range(1).select(P.is_identifier(F.lit(asked)).alias("x")).first()["x"]:
            symbols = list(dict.fromkeys([*symbols, asked]))
        rows = H.change_plan(self.nodes, self.edges, self.lines, symbols, self._seeds(a))
        package, prefix = A.text(a, "package"), A.text(a, "pathPrefix")
        if package or prefix:
            rows = rows.filter(P.path_in_scope(F.col("path"), prefix, package))
        out = self._found("order", rows.orderBy("place", "path"), n, planKind="change", symbolCount=len(symbols))
        doubtful = [s for s in symbols if self.resolve({"name": s})["ambiguous"]] if self.has_graph else []
        return out | {
            "mustEdit": [r["path"] for r in out["order"] if r["action"] == "edit"], "mustVerify": [r["path"] for r in out["order"] if r["action"] == "verify"], "mustNotTouch": [],
            "openNext": [r["path"] for r in out["order"][:5]], "needsDisambiguation": bool(doubtful), "ambiguousSymbols": doubtful,
        }

    def rename_plan(self, a: dict) -> dict:
        old, package, short = A.text(a, "path", "oldPath"), A.text(a, "packageName", "oldPackage", "package"), A.text(a, "shortName")
        bare = A.flag(a, "includeShortNameLiteral") or A.flag(a, "includeShortName")
        who = H.rename_identities(old, package, bare, short=short, ci=A.flag(a, "includeCiJobNames", True), docker=A.flag(a, "includeDockerImageNames", True))
        if not who:
            raise ValueError("a path or a packageName is needed")
        n, files = A.number(a, "limit", 500, 1, 2000), self.lines.select("path").distinct()
        keep, _ = self._rows(H.must_not_touch(files, short or H.short_name(old, package), old), 50)
        return self._found("mentions", H.rename_plan(self.lines, who).orderBy("path", "layer"), n, planKind="rename") | {
            "identities": [{"layer": x, "text": t} for x, t in who], "mustNotTouch": [r["path"] for r in keep],
            "decisions": ["Keep a forwarding export at the old path, or change all importers at once.", "Rename build and deploy jobs together with the folder, or leave their names."], "success": ["No file mentions the old path.", "The type check and all tests pass."],
        }

    def rename_impact(self, a: dict) -> dict:
        kind = A.text(a, "kind", default="literal")
        n = A.number(a, "limit", 500 if kind in ("path", "package") else 200, 1, 2000)
        return self._found("files", T.rename_impact(self.lines, A.text(a, *OLD), kind).orderBy("bucket", "path"), n)

    def env_usages(self, a: dict) -> dict:
        n = A.number(a, "limit", 40, 1, 200)
        return self._found("files", T.find_env_usages(self.lines, A.text(a, *ENV), n + 1, A.flag(a, "includeTests")), n)

    def count_files(self, a: dict) -> dict:
        n = A.number(a, "limit", 40, 1, 500)
        return self._found("files", T.count_literal_files(self.lines, A.text(a, *QUERY), n + 1), n)

    def search_literal(self, a: dict) -> dict:
        n = A.number(a, "limit", 40, 1, 500)
        return self._found("files", T.search_literal(self.lines, A.text(a, *QUERY), limit=n, per_file=A.number(a, "matchesPerFile", 3, 1, 50), hidden=A.flag(a, "includeHidden"), tmp=A.flag(a, "includeTmp")), n)

    def feature_context(self, a: dict) -> dict:
        rows, _ = self._rows(H.feature_context(self.nodes, self.lines, A.text(a, *FEATURE)), 25)
        return {"files": rows, "tests": [r["path"] for r in rows if r["is_test"]][:8], "readFirst": [r["path"] for r in rows if not r["is_test"]][:4]}

    def relations(self, a: dict) -> dict:
        o = V.options(A.number(a, "depth", 1), A.number(a, "limit", 20), A.fraction(a, "minConfidence", 0.0), A.text(a, "direction", default="both"))
        start = self.spark.createDataFrame([(A.text(a, *NODE),)], "id string")
        return self._found("trails", V.relations(self.edges, start, **o), o["limit"], direction=o["direction"], depth=o["depth"])

    def paths(self, a: dict) -> dict:
        return self._found("paths", V.shortest_path(self.spark, self.edges, A.text(a, *FROM), A.text(a, *TO), A.number(a, "depth", 4, 1, 8)), 1)

    def excerpt(self, a: dict) -> dict:
        path = A.text(a, *FILE[:3])
        if not corpus.inside(self.repo, path):
            raise ValueError("the path leaves the repository")
        start = A.number(a, "startLine", 1, 1)
        return T.open_excerpt(self.lines, path.removeprefix("./"), start, A.number(a, "endLine", max(40, start), 1)).first().asDict()

    def symbol_body(self, a: dict) -> dict:
        row = G.node(self.nodes, A.text(a, *BODY)).first()
        if row is None:
            raise ValueError("no such symbol")
        around, start = A.number(a, "contextLines", 2, 0, 40), row["start_line"] or 1
        end = (row.asDict().get("end_line") or start + 40) + around
        return T.open_excerpt(self.lines, row["path"], start - around, end).first().asDict() | {"id": row["id"]}

    def reindex(self, a: dict) -> dict:
        """Rebuild within a time limit: beyond it the jobs are cancelled and the old graph stays."""
        limit = A.clamp_timeout(A.number(a, "timeoutSec", A.number(a, "timeoutSeconds", 300)))
        if self.rebuild is None:
            return {"ok": False, "error": "no rebuild is configured", "timeoutSec": limit}
        mode = A.text(a, "analysisMode", "mode")
        out = self._within(limit, *([mode] if mode else [])) | {"timeoutSec": limit}
        if out["ok"] and self.reload is not None:
            old = self.lines
            self._serve(*self.reload())
            old.unpersist()
        out["freshness"] = H.slim_index(self.freshness({}))
        paths = A.strings(a, "paths") + (self._dirty() if A.flag(a, "useDirty") else [])
        if out["ok"] and paths and A.flag(a, "includeImpact", True):
            out["impact"] = self.path_set({"paths": paths[: H.MAX_SEEDS]})
        return out

    def _within(self, limit: float, *mode: str) -> dict[str, Any]:
        """The rebuild's answer, or an error when it fails or takes longer than ``limit`` seconds."""
        sc, group, answer, done = self.spark.sparkContext, f"rebuild-{uuid.uuid4().hex}", {}, threading.Event()

        def run() -> None:
            sc.setJobGroup(group, "rebuild", interruptOnCancel=True)
            try:
                answer.update({"ok": True} | self.rebuild(limit, *mode))
            except Exception as e:  # a failed rebuild is an answer, not a crash
                answer.update({"ok": False, "error": str(e)[:500]})
            finally:
                done.set()

        InheritableThread(target=run, daemon=True).start()
        if done.wait(limit):
            return dict(answer)
        sc.cancelJobGroup(group)
        return {"ok": False, "timedOut": True, "error": f"the rebuild took more than {limit} seconds and was cancelled"}
