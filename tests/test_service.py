"""Arguments, formatting, the protocol and the command line."""

from __future__ import annotations

import io
import json
import threading
import urllib.request

import pytest

from weftline.service import args as A
from weftline.service import cli, export, format, rpc
from weftline.sources.store import GraphStore


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    for p, t in {"package.json": '{"name": "r"}', "src/a.ts": "export function one() {\n  return two();\n}\n", "src/b.ts": "export function two() {\n  return process.env.KEY;\n}\n", "src/b.test.ts": "import { two } from './b';\ntwo();\n"}.items():
        (root / p).parent.mkdir(exist_ok=True)
        (root / p).write_text(t)
    return root


@pytest.fixture(scope="module")
def tools(spark, repo, tmp_path_factory):
    store = GraphStore(spark, str(tmp_path_factory.mktemp("store")))
    done = cli.index(spark, store, str(repo), "n")
    assert done["nodes"] > 5 and done["edges"] > 3
    return cli.tools(spark, store, str(repo), "n")


def ask(tools, method, **params):
    return rpc.handle(tools, json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": params}))


@pytest.mark.parametrize(("name", "args", "want"), [
    ("help", {}, "resolve_symbol"), ("get_index_freshness", {}, "graphReliable"), ("resolve_symbol", {"name": "two"}, "symbol:src/b.ts#two"), ("analyze_function_impact", {"symbol": "two", "transitive": True}, "hybrid"),
    ("analyze_path_set_impact", {"paths": ["src/b.ts"]}, "src/b.test.ts"), ("prepare_change_plan", {"symbols": ["two"], "paths": "src/b.ts"}, "mustEdit"), ("prepare_rename_plan", {"oldPath": "./b"}, "identities"),
    ("analyze_rename_impact", {"oldName": "two"}, "src/a.ts"), ("analyze_callsite_contract", {"callee": "two", "required": "check"}, "missing"), ("find_env_usages", {"name": "KEY"}, "src/b.ts"),
    ("count_literal_files", {"query": "two"}, "files (3)"), ("search_code", {"query": "two"}, "src/b.ts"), ("find_symbol", {"name": "two"}, "two"), ("find_file", {"path": "b.ts"}, "src/b.ts"),
    ("get_relations", {"id": "symbol:src/a.ts#one", "direction": "out"}, "src/b.ts#two"), ("get_dependents", {"id": "symbol:src/b.ts#two"}, "src/a.ts#one"), ("find_paths", {"from": "file:src/a.ts", "to": "file:src/b.ts", "depth": 4}, "paths (1)"),
    ("list_node_types", {}, "Symbol"), ("open_file_excerpt", {"path": "src/a.ts", "endLine": 2}, "return two()"), ("open_symbol_body", {"id": "symbol:src/b.ts#two"}, "process.env"), ("prepare_feature_context", {"query": "two"}, "readFirst"),
    ("search_literal", {"term": "KEY", "format": "json"}, "runtime_env_read"), ("reindex", {"timeoutSec": 900, "paths": ["src/b.ts"]}, "durationMs"), ("get_namespace_info", {}, "analysisMode"),
    ("analyze_callsite_contract", {"callee": "two", "requiredBeforeCall": "one", "format": "json"}, '"total": 2'), ("find_env_usages", {"envName": "KEY"}, "src/b.ts"), ("find_paths", {"fromId": "file:src/a.ts", "toId": "file:src/b.ts", "depth": 4}, "paths (1)"),
    ("prepare_change_plan", {"query": "two", "useDirty": True}, "mustEdit"), ("prepare_rename_plan", {"packageName": "@x/kiln", "includeCiJobNames": False, "format": "json"}, "APP_DIR=kiln"), ("analyze_function_impact", {"symbol": "two", "pathPrefix": "src"}, "openNext"),
    ("get_relations", {"targetId": "symbol:src/a.ts#one", "direction": "outbound"}, "trails"), ("open_symbol_body", {"symbolId": "symbol:src/b.ts#two", "contextLines": 0}, "process.env"), ("analyze_path_set_impact", {"paths": ["src/b.ts"]}, "mustVerify"),
])
def test_tools(tools, name, args, want):
    answer = ask(tools, "tools/call", name=name, arguments=args)
    assert "error" not in answer and want in answer["result"]["content"][0]["text"], answer


def test_protocol(tools):
    assert rpc.handle(tools, "{")["error"]["code"] == -32700 and ask(tools, "nope")["error"]["code"] == -32603
    assert rpc.handle(tools, '{"method": "x"}') is None and ask(tools, "tools/call", name="no")["error"]["code"] == -32603
    assert ask(tools, "tools/call", name="open_file_excerpt", arguments={"path": "../x"})["error"]["code"] == -32603
    listing = ask(tools, "tools/list")["result"]
    assert len(listing["tools"]) == 19 and len(json.dumps(listing)) < 22_000 and len(tools.help({})["help"]) < 4_500
    out = io.StringIO()
    rpc.serve_stdio(tools, io.StringIO('{"id": 1, "method": "ping"}\n\n{"method": "note"}\n'), out)
    assert json.loads(out.getvalue()) == {"jsonrpc": "2.0", "id": 1, "result": {}}


def test_http(tools):
    server = rpc.http_server(tools)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/"
    post = lambda body: urllib.request.urlopen(urllib.request.Request(url, body.encode(), method="POST"))
    assert json.load(urllib.request.urlopen(url))["name"] == "weftline" and json.load(post('{"id": 1, "method": "ping"}'))["result"] == {}
    assert post('{"method": "note"}').status == 202
    for path, body, method, code in (("x", b"{}", "POST", 404), ("", b"{}", "PUT", 405), ("", None, "POST", 400)):
        with pytest.raises(urllib.error.HTTPError) as e:
            urllib.request.urlopen(urllib.request.Request(url + path, body, method=method))
        assert e.value.code == code
    server.shutdown()


def test_without_graph(spark, tools):
    bare = cli.Tools(spark, tools.lines)
    assert bare.call("resolve_symbol", {"name": "x"})["graphAvailable"] is False and bare.call("analyze_function_impact", {"symbol": "two"})["resolutionMethod"] == "text"
    assert bare.call("reindex", {})["ok"] is False


def test_scope_and_limits(spark, tools):
    """Filters leave files out, dirty paths are seeds, a rebuild that takes too long is cancelled, schemas have types."""
    import time

    scoped = tools.call("analyze_function_impact", {"symbol": "two", "pathPrefix": "lib"})
    assert scoped["files"] == [] and tools.call("analyze_function_impact", {"symbol": "two"})["fileRelations"]
    slow = cli.Tools(spark, tools.lines, rebuild=lambda _: {"n": time.sleep(5) or 1})
    assert slow._within(0.2)["timedOut"] is True and slow._within(30) == {"ok": True, "n": 1}
    assert cli.Tools(spark, tools.lines, rebuild=lambda _: 1 / 0)._within(5)["ok"] is False
    dirty = cli.Tools(spark, tools.lines, tools.nodes, tools.edges)
    dirty._dirty = lambda: ["src/b.ts"]
    found = dirty.call("analyze_path_set_impact", {"useDirty": True})
    assert found["seedCount"] == 1 and found["stale"] is False and "src/b.test.ts" in found["mustVerify"]
    assert dirty.call("analyze_function_impact", {"symbol": "two"})["confidence"] == "low" and dirty.call("prepare_change_plan", {"useDirty": True})["mustEdit"] == ["src/b.ts"]
    kinds = {t["name"]: t["inputSchema"] for t in tools.listing()}
    assert kinds["reindex"]["properties"]["timeoutSec"] == {"type": "integer"} and kinds["prepare_change_plan"]["properties"]["symbols"] == {"type": "array", "items": {"type": "string"}}
    assert kinds["analyze_callsite_contract"]["required"] == ["callee", "requiredBeforeCall"] and kinds["prepare_change_plan"]["required"] == []


def test_reindex_serves_the_new_graph(spark, tmp_path):
    """After a rebuild the tools answer from the new graph and the new text; only the changed files were scanned."""
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.ts").write_text("export function one() {\n  return 1;\n}\n")
    (tmp_path / "src/b.ts").write_text("export function two() {\n  return 2;\n}\n")
    store = GraphStore(spark, str(tmp_path / "store"))
    cli.index(spark, store, str(tmp_path), "n", "full")
    t = cli.tools(spark, store, str(tmp_path), "n")
    (tmp_path / "src/b.ts").write_text("export function three() {\n  return 3;\n}\n")
    done = t.call("reindex", {"analysisMode": "full"})
    assert done["ok"] and (done["scannedFiles"], done["goneFiles"]) == (1, 0)
    names = lambda q: [r["name"] for r in t.call("find_symbol", {"name": q})["symbols"]]
    assert names("three") == ["three"] and names("two") == [] and names("one") == ["one"]
    assert t.call("count_literal_files", {"query": "three"})["returned"] == 1 and t.call("count_literal_files", {"query": "two"})["returned"] == 0
    assert store.namespace("n")["analysis_mode"] == "full"


def test_format():
    assert format.options({"raw": True, "detail": "summary"}) == {"detail": "summary", "json": True, "items": 20} and format.options({"format": "json"})["detail"] == "summary" and format.options({"detail": "files", "raw": True})["detail"] == "files"
    text = format.render("t", {"files": [{"path": f"f{i}"} for i in range(50)]}, {"maxItems": 5})
    assert "files (50)" in text and "+45 more" in text and text.count("- f") == 5


def test_args(tmp_path):
    assert A.number({"n": "7.9"}, "n", 1) == 7 and A.number({"n": "x"}, "n", 3) == 3 and A.strings({"a": "x, y,"}, "a") == ["x", "y"] and A.flag({"a": "true"}, "a")
    (tmp_path / ".env").write_text("WEFTLINE_STORE='/a'\nWEFTLINE_MASTER=m\n#no\n")
    assert A.settings(str(tmp_path), {"WEFTLINE_MASTER": "local"}) == {"store": "/a", "master": "local"}
    assert [A.clamp_timeout(x) for x in (None, 1, 9999)] == [300, 30, 1800]


def test_cli(spark, repo, tmp_path, capsys):
    run = lambda *a: cli.main([*a, "--repo", str(repo), "--store", str(tmp_path / "s"), "--namespace", "c", "--out", str(tmp_path / "g.html")])
    assert run("export") == 1
    for c in ("doctor", "discover", "index", "status", "namespaces", "update", "export", "reset"):
        assert run(c) == 0
    assert '"package_manager": "unknown"' in capsys.readouterr().out and "symbol:src/b.ts#two" in (tmp_path / "g.html").read_text()


def test_export(tools, tmp_path):
    export.export(tools.nodes, tools.edges, str(tmp_path / "e"))
    assert tools.spark.read.json(str(tmp_path / "e/nodes")).count() == tools.nodes.count()
