"""Regression vectors of the text, graph and event operators on small synthetic trees."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from weftline.functions import predicates as P
from weftline.operators import graph as G
from weftline.operators import text as T
from weftline.operators import traverse as V
from weftline.plans import hybrid as H
from weftline.sources import corpus, store
from weftline.sources import events as E
from weftline.streaming import ingest


def tree(spark, files):
    return T.scan_lines(spark.createDataFrame(list(files.items()), "path string, content string"))


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("package", "path", "wanted", "ok"), [
    ("", "tools/kiln/bake.ts", "", True), ("", "tools/kiln/bake.ts", "  ", True), ("package:@pots/kiln", "", "@POTS/Kiln", True), ("package:@pots/glaze", "", "package:kiln", False),
    ("", "Tools/Kiln/bake.ts", "@pots/kiln", True), ("", "kiln/bake.ts", "package:@pots/kiln", True), ("", "tools/kilns/bake.ts", "@pots/kiln", False), (None, None, "kiln", False), (None, "a/b.kiln.ts", "kiln", True),
])
def test_package_scope(spark, package, path, wanted, ok):
    assert value(spark, P.package_scope(F.lit(package), F.lit(path), wanted)) is ok


def test_literal_search(spark):
    files = {
        "src/runtime.ts": "const a = process.env.API_KEY;\nfoo('API_KEY')\n", "src/runtime.test.ts": "// API_KEY", "scripts/x.ts": "API_KEY", "README.md": "API_KEY",
        ".env": "API_KEY=secret\n", "node_modules/a.ts": "API_KEY", "tmp/scratch.ts": "API_KEY",
    }
    got = {r.path: r for r in T.search_literal(tree(spark, files), "API_KEY", hidden=True).collect()}
    assert set(got) == {"src/runtime.ts", "src/runtime.test.ts", "scripts/x.ts", "README.md", ".env"}
    assert sum(r.match_count for r in got.values()) == 6 and got[".env"].matches[0].snippet == "API_KEY=<redacted>" and got["src/runtime.ts"].env_reads == 1
    plain = T.search_literal(tree(spark, files), "API_KEY", tests=False, docs=False, config=False, scripts=False)
    assert [r.path for r in plain.collect()] == ["src/runtime.ts"]
    assert T.search_literal(tree(spark, {"a.ts": "x" * 70_000 + "END"}), "END").count() == 1
    assert [r.path for r in T.find_env_usages(tree(spark, files), "API_KEY").collect()] == ["src/runtime.ts"]


@pytest.mark.parametrize("n", [3, 4])
def test_truncation_at_the_limit(spark, n):
    rows = T.search_literal(tree(spark, {f"f{i}.ts": "hit" for i in range(n)}), "hit", limit=3).collect()
    assert len(rows) == 3 and all(r.truncated for r in rows)


def test_function_impact(spark):
    files = {
        "src/metric.ts": "export function fire(a) {\n  trackCall(a);\n}\nexport function trackCall(a) {\n  return a;\n}\n",
        "src/server.ts": "import { trackCall } from './metric';\nexport const start = () => {\n  trackCall(1);\n};\n", "src/server.test.ts": "import { trackCall } from './metric';\ntest('x', () => { trackCall(2); });\n",
        "README.md": "Use trackCall wisely",
    }
    got = {(r.path, r.bucket): r for r in T.function_impact(tree(spark, files), "trackCall").collect()}
    assert got[("src/metric.ts", "definition")].hit_count == 1 and got[("src/server.ts", "call")].owners == ["start"]
    assert got[("src/metric.ts", "call")].owners == ["fire"] and ("README.md", "reference") in got and ("src/server.test.ts", "import") in got
    assert {(r.symbol, r.depth) for r in T.transitive_impact(tree(spark, files), "trackCall", 2).collect()} >= {("fire", 1), ("start", 1)}


def fold_owner(lines):
    """The line-by-line form of owner attribution."""
    owner, depth, out = "", 0, []
    for path, no, text, own, comment in lines:
        if comment:
            continue
        delta = text.count("{") - text.count("}")
        if own:
            owner, depth = own, delta
        elif owner:
            depth += delta
        out.append((path, no, owner))
        if owner and depth <= 0 and "}" in text:
            owner = ""
    return out


def test_owner_windows_equal_the_fold(spark):
    text = "function a() {\n  x();\n  function b() {\n    y();\n  }\n  z();\n}\nexport const c = 1;\nd();\nif (e) { f(); }\n// function q() {\nasync g(h) { i(); }\nj();\nconst k = (l) => {\n  while (m) {\n  }\n}\n"
    lines = tree(spark, {"a.ts": text})
    rows = lines.select("path", "line_no", "text", P.owner_name(F.col("text")), P.is_comment(F.col("text"))).orderBy("line_no").collect()
    assert sorted((r.path, r.line_no, r.owner) for r in T.with_owner(lines).collect()) == fold_owner(map(tuple, rows))


def test_callsites(spark):
    files = {"src/a.ts": "function one() {\n  assertOk();\n  destroy();\n}\nfunction two() {\n  update(); destroy();\n}\nfunction three() { assertOk(); destroy(); }\n// destroy()\n", "src/a.test.ts": "function t() {\n  destroy();\n}\n"}
    rows = T.callsites(tree(spark, files), "destroy", "assertOk").collect()
    assert len(rows) == 4 and sum(r.has_required for r in rows) == 2
    assert {r.owner: r.required_line for r in rows if r.path == "src/a.ts"} == {"one": 2, "two": None, "three": 8}
    assert T.callsites(tree(spark, files), "destroy", "assertOk", tests=False).count() == 3


@pytest.mark.parametrize(("pattern", "text", "ok"), [
    (r"\bgetSession", "égetSession", True), (r"\bgetSession\b", "agetSession", False), (r"a\sb", "a\x0bb", False), (r"\$x\b", "a$x ", True), (r"a.b", "a\rb", True), (r"a.b", "a\nb", False),
])
def test_regex_translation(spark, pattern, text, ok):
    assert value(spark, P.matches(F.lit(text), pattern)) is ok


def test_scan_lines(spark):
    assert [r.text for r in tree(spark, {"a.ts": "a\r\n\tb\n\nc\n"}).orderBy("line_no").collect()] == ["a", "\tb", "", "c"]
    assert value(spark, P.strip(F.lit("\t  x y 　"))) == "x y"


def test_rename(spark):
    assert value(spark, P.rename_bucket(F.lit("script"), F.lit(True))) == "runtimeReads" and value(spark, P.rename_bucket(F.lit("test"), F.lit(True))) == "tests"
    assert T.rename_impact(tree(spark, {f"src/f{i}.ts": "import 'packages/old'" for i in range(55)}), "packages/old").count() == 55
    assert H.rename_identities("apps/kiln.v2/", "@pots/kiln", True) == [
        ("path", "apps/kiln.v2/"), ("package", "@pots/kiln"), ("ci", "build-kiln.v2"), ("ci", "deploy-kiln.v2"), ("ci", "kiln.v2-buildcache"), ("docker", "APP_DIR=kiln.v2"), ("name", "kiln.v2")]
    assert H.rename_identities("", "@pots/kiln", ci=False) == [("package", "@pots/kiln"), ("docker", "APP_DIR=kiln")] and H.rename_identities("kiln", "kiln", True, ci=False, docker=False) == [("path", "kiln")]
    assert [H.short_name(*x) for x in (("a/b.c.ts",), ("", "@x/y"), ("", "y"), ("a\\b/",), ("",))] == ["b.c.ts", "y", "y", "b", ""]
    files = spark.createDataFrame([("packages/clay/utils/kiln.ts",), ("packages/kiln/utils/kiln.ts",), ("packages/clay/src/kiln.ts",), ("packages/clay/__tests__/kiln.test.ts",)], "path string")
    assert [r.path for r in H.must_not_touch(files, "kiln", "packages/kiln").collect()] == ["packages/clay/utils/kiln.ts", "packages/clay/__tests__/kiln.test.ts"]
    many = {f"{d}/f{i:02}.ts": "const v = process.env.OLD" if d == "src" else "OLD" for d in ("src", "scripts") for i in range(30)}
    got = T.rename_impact(tree(spark, many), "OLD", per_bucket=4).collect()
    assert sorted((r.bucket, r.path, r["rank"]) for r in got if r.shown) == sorted((b, f"{d}/f{i:02}.ts", i + 1) for b, d in (("runtimeReads", "src"), ("scripts", "scripts")) for i in range(4)) and len(got) == 60


@pytest.mark.parametrize(("how", "calls", "ambiguous", "stale", "n", "want"), [("hybrid", True, False, False, 1, "high"), ("text", False, False, False, 2, "medium"), ("hybrid", True, True, False, 1, "low"), ("graph", True, False, True, 1, "low"), ("text", False, False, False, 0, "low")])
def test_confidence(spark, how, calls, ambiguous, stale, n, want):
    assert value(spark, H.impact_confidence(F.lit(how), F.lit(calls), F.lit(ambiguous), F.lit(stale), F.lit(n))) == want


EDGES = "type string, src string, dst string, source_file string, start_line long, confidence double"


def test_trails_are_not_node_simple(spark):
    edges = spark.createDataFrame([("CALLS", "a", "b", "f", 1, None), ("CALLS", "a", "b", "f", 2, None), ("CALLS", "b", "c", "f", 3, 0.9), ("CALLS", "c", "a", "f", 4, 0.5)], EDGES)
    start = spark.createDataFrame([("a",)], "id string")
    got = V.trails(edges, start, 2, "both").collect()
    assert len([r for r in got if r.depth == 1]) == 2 and ["a", "b", "a"] in [r.nodes for r in got] and len(got) == 6
    path = V.shortest_path(spark, edges, "a", "c", 3).collect()
    assert [r.nodes for r in path] == [["a", "b", "c"]] and V.shortest_path(spark, edges, "a", "a").count() == 0
    assert V.options(99, 0, 0, "upstream") == {"depth": 8, "limit": 20, "min_confidence": 0.6, "direction": "reverse"}


def event(kind, **x):
    return json.dumps({"protocol": E.PROTOCOL, "type": kind, **{k.rstrip("_"): v for k, v in x.items()}})


def event_rows(spark, lines):
    rows = E.parse(spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1))
    return rows.withColumn("seq", F.monotonically_increasing_id())


def test_events(spark):
    lines = [
        event("edge", rel="CALLS", from_="s:a", to="s:b", props={"startLine": "6"}), event("edge", rel="CALLS", from_="s:a", to="s:b", props={"startLine": "7"}), event("summary", message="m"), event("warning", message="w"),
        event("node", label="Symbol", id="s:a", props={"name": "one", "kind": "function"}), event("node", label="Symbol", id="s:b"), event("node", label="Symbol", id="s:a", props={"name": "two"}), event("edge", rel="CALLS", from_="s:a", to="s:gone"),
    ]
    rows = event_rows(spark, lines)
    assert [r.type for r in E.ordered(rows).collect()] == ["node", "node", "edge", "edge", "edge", "summary", "warning"][:5] + ["warning", "summary"]
    nodes = {r.source_id: r for r in E.nodes_of(rows, "ns").collect()}
    assert nodes["s:a"].name == "two" and nodes["s:a"].kind == "function" and nodes["s:a"].id == "ns:s:a"
    edges = E.edges_of(rows, "ns")
    assert edges.count() == 3 and E.attached(edges, E.nodes_of(rows, "ns")).count() == 2 and E.meta_of(rows, "ns").count() == 2
    bad = event_rows(spark, [event("edge", rel="CALLS", from_="a"), "nonsense", event("node", label="A__B", id="x"), event("node", label="File", id="f")])
    good, rejected = E.split_valid(bad)
    assert good.count() == 1 and rejected.count() == 3
    with pytest.raises(Exception, match="bad event"):
        E.require_valid(bad).collect()
    with pytest.raises(Exception, match="two labels"):
        E.nodes_of(event_rows(spark, [event("node", label="File", id="x"), event("node", label="Symbol", id="x")]), "ns").collect()


def test_store(spark, tmp_path):
    s = store.GraphStore(spark, f"file://{tmp_path}/store")
    first = event_rows(spark, [event("node", label="File", id="file:a", props={"path": "a"}), event("node", label="File", id="file:b"), event("edge", rel="IMPORTS_FILE", from_="file:a", to="file:b"), event("edge", rel="IMPORTS_FILE", from_="file:a", to="file:z")])
    assert s.load(first, "one") == {"nodes": 2, "edges": 1, "dropped_edges": 1}
    s.load(first, "two", mode="fast")
    s.load(event_rows(spark, [event("node", label="File", id="file:a", props={"language": "ts"})]), "one", merge=True)
    row = s.nodes("one").filter("source_id = 'file:a'").first()
    assert (row.path, row.language) == ("a", "ts") and s.status("one") == {"nodes": 2, "edges": 1} and s.status()["nodes"] == 4
    assert [r.name for r in s.namespaces().collect()] == ["one", "two"] and s.namespace("two")["analysis_mode"] == "fast"
    s.reset("one")
    assert s.nodes("one") is None and [r.name for r in s.namespaces().collect()] == ["two"]
    assert [store.stored_mode(m) for m in ("", "full", "fast", "partial")] == ["full", "full", "fast", "full"]


def test_streaming(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.ndjson").write_text("\n".join([event("edge", rel="IMPORTS_FILE", from_="file:a", to="file:b"), event("node", label="File", id="file:a")]) + "\nnonsense\n")
    ingest.start(spark, str(source), f"{tmp_path}/out", "ns", f"{tmp_path}/check").awaitTermination()
    assert ingest.current(spark, f"{tmp_path}/out")[1].count() == 0
    (source / "2.ndjson").write_text(event("node", label="File", id="file:b") + "\n")
    ingest.start(spark, str(source), f"{tmp_path}/out", "ns", f"{tmp_path}/check").awaitTermination()
    nodes, edges = ingest.current(spark, f"{tmp_path}/out")
    assert nodes.count() == 2 and edges.count() == 1 and spark.read.parquet(f"{tmp_path}/out/rejected").count() == 1


def test_event_order_over_files(spark, tmp_path):
    """Files are ordered by name, whatever their sizes; within a file by line."""
    files = {"a": ["first", "old"], "b": [f"v{i}" for i in range(2000)] + ["middle"], "c": ["last"]}
    for name, values in files.items():
        (tmp_path / f"{name}.ndjson").write_text("".join(event("node", label="Symbol", id="s:a", props={"name": v}) + "\n" for v in values) + (event("node", label="Symbol", id=f"s:{name}", props={"name": "own"}) + "\n") * (name != "a"))
    rows = E.read(spark, str(tmp_path))
    assert [r.props["name"] for r in rows.filter("id = 's:a'").orderBy("seq").collect()] == [v for f in files.values() for v in f]
    assert {r.source_id: r.name for r in E.nodes_of(rows, "ns").collect()} == {"s:a": "last", "s:b": "own", "s:c": "own"}
    source = tmp_path / "in"
    source.mkdir()
    for name in ("b", "c"):
        (source / f"{name}.ndjson").write_text((tmp_path / f"{name}.ndjson").read_text())
    ingest.start(spark, str(source), f"{tmp_path}/out", "ns", f"{tmp_path}/check").awaitTermination()
    (source / "a.ndjson").write_text((tmp_path / "a.ndjson").read_text())
    ingest.start(spark, str(source), f"{tmp_path}/out", "ns", f"{tmp_path}/check").awaitTermination()
    assert {r.source_id: r.name for r in ingest.current(spark, f"{tmp_path}/out")[0].collect()}["s:a"] == "old"


def test_relations_stop_at_the_limit(spark):
    """A hub has more trails of one step than the limit, so no second level is made; results are those of all trails."""
    rows = [("CALLS", "hub", f"n{i:03}", "f", i, None) for i in range(40)] + [("CALLS", f"n{i:03}", f"m{i:03}", "f", i, None) for i in range(40)]
    edges, start = spark.createDataFrame(rows, EDGES), spark.createDataFrame([("hub",), ("n001",)], "id string")
    for limit in (5, 41, 60, 200):
        want = V.trails(edges, start, 3, "forward").orderBy("depth", "edges", "start").limit(limit + 1).collect()
        got = V.relations(edges, start, depth=3, limit=limit, direction="out").collect()
        assert [tuple(r) for r in got] == [(r.start, r.depth, r.nodes, r.edges) for r in want]


def test_corpus(spark, tmp_path):
    for p, t in {"package.json": '{"dependencies": {"next": "1"}}', "yarn.lock": "", "tsconfig.json": "{}", "src/a.ts": "x\ny", "node_modules/b.ts": "x", "img.png": "x"}.items():
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text(t)
    files = corpus.read_files(spark, str(tmp_path))
    assert {r.path for r in files.collect()} == {"package.json", "tsconfig.json", "src/a.ts"}
    assert [r.path for r in corpus.candidate_files(files, "x").collect()] == ["package.json", "src/a.ts"]
    found = corpus.discover(spark.createDataFrame([("yarn.lock", ""), ("package.json", '{"dependencies": {"next": "1"}}'), ("a/tsconfig.json", "{}")], "path string, content string")).first()
    assert (found.package_manager, found.nextjs, found.tsconfigs, found.workspaces) == ("yarn", True, ["a/tsconfig.json"], ["apps/*", "packages/*"])
    assert corpus.inside("/repo", "a/b") and not corpus.inside("/repo", "../repo2/x") and corpus.dirty_paths("R  a -> b\n M c\n") == ["b", "c"]
    assert T.open_excerpt(T.scan_lines(files), "src/a.ts", 5, 9).first().truncated


def test_related(spark):
    files = spark.createDataFrame([("src/session.ts",), ("src/session.test.ts",), ("src/__tests__/session.spec.tsx",)], "path string")
    assert {r.path for r in T.related_tests(files, files.limit(1)).collect()} == {"src/session.test.ts", "src/__tests__/session.spec.tsx"}
    assert value(spark, P.resolve_dots(F.lit("a/b/../../c/./d"))) == "c/d" and value(spark, P.normalize_path(F.lit(" ./a\\b "))) == "a/b"
    assert [value(spark, P.is_identifier(F.lit(x))) for x in ("a_$1", "1a", "a-b")] == [True, False, False]


def test_resolve(spark):
    nodes = spark.createDataFrame([("1", "Symbol", "Foo", "a.ts", "function", "p", 1, True), ("2", "Symbol", "foo::var", "a.ts", "local", "p", 2, None), ("3", "File", "foo", "foo.ts", None, None, None, None)], "id string, label string, name string, path string, kind string, package_id string, start_line long, exported boolean")
    c = G.symbol_candidates(nodes, "foo")
    assert [r.id for r in c.collect()] == ["1", "2"] and G.resolve_state(c).first().selected == "1"
    state = G.resolve_state(G.symbol_candidates(nodes, "nothing")).first()
    assert not state.ambiguous and state.selected is None
    assert G.search_code(nodes, "FOO", 1).count() == 2
