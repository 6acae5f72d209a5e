"""The extractor on a small workspace written for the tests."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from weftline.extract import events as X
from weftline.extract import incremental as I
from weftline.extract.scan import File, facts, mask
from weftline.service import cli
from weftline.sources import events as E
from weftline.sources.shared import written
from weftline.sources.store import GraphStore

FILES = {
    "package.json": '{"name": "root", "workspaces": ["apps/*"], "dependencies": {"@w/auth": "*", "next": "15"}}',
    "apps/web/package.json": '{"name": "@w/web", "dependencies": {"@w/auth": "*"}, "devDependencies": {"vitest": "1"}}',
    "packages/auth/package.json": '{"name": "@w/auth"}',
    "packages/auth/src/login.ts": "export type Account = {\n  id: string;\n};\n\nexport const MAX_AGE = 60; // login()\n\nexport const cleanUp = (account: Account): Account => ({\n  id: account.id.trim(),\n});\n\nexport async function login(): Promise<Account> {\n  if (!process.env.LOGIN_KEY) {\n    throw new Error(\"no login()\");\n  }\n  return cleanUp({ id: '1' });\n}\nexport class Vault {\n  open(code: number) {\n    return login();\n  }\n}\n",
    "packages/auth/src/login.test.ts": 'import { test } from "vitest";\nimport { login } from "./login";\ntest("logs in", async () => {\n  await login();\n});\n',
    "apps/web/src/app/home/page.tsx": 'import { login as enter, MAX_AGE } from "../../../../../packages/auth/src/login";\nimport Panel from "./panel";\nimport { x } from "@w/auth";\n\nexport default async function HomePage() {\n  const one = await enter();\n  const two = await enter();\n  return <Panel age={MAX_AGE}>{one.id || two.id}</Panel>;\n}\n',
    "apps/web/src/app/home/panel.tsx": "export default function Panel(props: { age: number }) {\n  return <p>{props.age}</p>;\n}\n",
    "apps/web/src/app/api/login/route.ts": "export async function GET() {\n  return 1;\n}\n",
    "apps/web/src/app/layout.tsx": "export default function Layout({ children }) {\n  return children;\n}\n",
    "apps/web/src/app/page.tsx": "export default function Root() {\n  return null;\n}\n",
    "apps/web/src/pages/blog/[slug].tsx": "export const lazy = () => import('../../x');\n",
    "out/gone.ts": "export const gone = 1;\n",
}


@pytest.fixture(scope="module")
def found(spark):
    rows = X.extract(spark.createDataFrame(list(FILES.items()), "path string, content string"), {".gitignore": "out/\n# no\n"}, identifiers=True)
    rows = written(rows)
    return rows.collect(), rows


def test_nodes(found):
    nodes = {r.id: r for r in found[0] if r.type == "node"}
    auth, home = "symbol:packages/auth/src/login.ts#", "symbol:apps/web/src/app/home/page.tsx#HomePage"
    assert {"package:@w/web", "project:apps/web", "file:packages/auth/src/login.ts", auth + "login", "external:npm:vitest", "config:LOGIN_KEY", "test:packages/auth/src/login.test.ts#logs in"} <= set(nodes)
    assert nodes[auth + "MAX_AGE"].props["kind"] == "global_variable" and "MAX_AGE" in nodes[auth + "MAX_AGE"].props["code"]
    assert nodes[auth + "cleanUp"].props["kind"] == "function_variable" and nodes[auth + "Vault"].props["kind"] == "class" and nodes[auth + "open"].props["kind"] == "method"
    assert nodes[auth + "cleanUp::param:account:7"].props["ownerId"] == auth + "cleanUp"
    assert nodes[home].props["kind"] == "component" and nodes[home + "::var:one:6"].props["kind"] == "local_variable" and home + "::var:two:7" in nodes
    assert {"route:apps/web:PAGE:/home", "route:apps/web:ANY:/api/login", "route:apps/web:PAGE:/", "route:apps/web:PAGE:/blog/:slug"} <= set(nodes)
    assert "file:out/gone.ts" not in nodes and nodes["file:apps/web/src/app/home/page.tsx"].props["packageId"] == "package:@w/web"


def test_edges(found):
    edges = {(r.rel, r["from"], r.to, r.props["startLine"]) for r in found[0] if r.type == "edge"}
    plain = {e[:3] for e in edges}
    auth, page = "symbol:packages/auth/src/login.ts#", "apps/web/src/app/home/page.tsx"
    home = f"symbol:{page}#HomePage"
    assert {e[3] for e in edges if e[:3] == ("CALLS", home, auth + "login")} == {"6", "7"}
    assert ("REFERENCES", home, auth + "MAX_AGE", "8") in edges and ("RENDERS", home, "symbol:apps/web/src/app/home/panel.tsx#Panel", "8") in edges
    assert {
        ("IMPORTS_FILE", f"file:{page}", "file:packages/auth/src/login.ts"), ("IMPORTS_SYMBOL", f"file:{page}", auth + "login"), ("CALLS", auth + "login", auth + "cleanUp"), ("CALLS", auth + "open", auth + "login"),
        ("HAS_PARAMETER", auth + "cleanUp", auth + "cleanUp::param:account:7"), ("DECLARES_VARIABLE", home, home + "::var:one:6"), ("IMPORTS_EXTERNAL_PACKAGE", "file:packages/auth/src/login.test.ts", "external:npm:vitest"),
        ("USES_CONFIG_KEY", "file:packages/auth/src/login.ts", "config:LOGIN_KEY"), ("USES_TYPE", auth + "cleanUp", auth + "Account"), ("USES_LAYOUT", "route:apps/web:PAGE:/home", "file:apps/web/src/app/layout.tsx"),
        ("HANDLES_ROUTE", "symbol:apps/web/src/app/api/login/route.ts#GET", "route:apps/web:ANY:/api/login"), ("DEPENDS_ON_PACKAGE", "package:@w/web", "package:@w/auth"), ("DEFINES", "file:packages/auth/src/login.ts", auth + "Vault"),
    } <= plain


def test_events_load(found):
    good, bad = E.split_valid(found[1])
    assert bad.count() == 0 and E.attached(E.edges_of(good, "n"), E.nodes_of(good, "n")).count() > 30 and X.summary(good)["warning"] == 1
    whole = X.with_summary(found[1], 0.0)
    last = whole.orderBy("seq").collect()[-1]
    assert last.type == "summary" and int(last.props["events"]) == found[1].count() and E.split_valid(whole)[1].count() == 0 and E.meta_of(whole, "n").filter("name = 'extraction finished'").count() == 1


def test_scan():
    text = "const a = 'b(c)'; // d()\n/* e() */ f(`g()`);\n"
    assert len(mask(text)) == len(text) and "b(c)" not in mask(text) and "f(" in mask(text)
    assert File("a(b[c{d}])").pairs == {1: 9, 3: 8, 5: 7}
    assert facts("a.ts", "") == [] and facts("a.ts", "}}}((( 'unclosed") == []


def _stored(store, name):
    """What a namespace holds, without what tells time: nodes and edges as sets of rows."""
    nodes = {tuple(r) for r in store.nodes(name).filter("label <> 'Meta'").drop("namespace", "id").collect()}
    edges = {tuple(r) for r in store.edges(name).drop("namespace", "src", "dst").collect()}
    return nodes, edges


def test_update_equals_rebuild(spark, tmp_path):
    """After an edit, a deletion, a move and a touched file the store equals a full rebuild, and only changes are scanned."""
    repo, store = tmp_path / "repo", GraphStore(spark, f"{tmp_path}/store")
    for p, t in FILES.items():
        (repo / p).parent.mkdir(parents=True, exist_ok=True)
        (repo / p).write_text(t)
    (repo / ".gitignore").write_text("out/\n")
    first = cli.index(spark, store, str(repo), "n", "full", merge=True)
    assert first["scannedFiles"] == len(FILES) - 1 and first["goneFiles"] == 0
    login = repo / "packages/auth/src/login.ts"
    login.write_text(login.read_text().replace("cleanUp", "tidyUp"))
    (repo / "apps/web/src/app/page.tsx").unlink()
    (repo / "apps/web/src/app/home/panel.tsx").rename(repo / "apps/web/src/app/home/board.tsx")
    touched = repo / "packages/auth/src/login.test.ts"
    os.utime(touched, (1, 1))
    done = cli.index(spark, store, str(repo), "n", "full", merge=True)
    assert (done["scannedFiles"], done["goneFiles"]) == (2, 2)
    cli.index(spark, store, str(repo), "whole", "full")
    assert _stored(store, "n") == _stored(store, "whole")
    ids = {r.source_id for r in store.nodes("n").collect()}
    assert "symbol:packages/auth/src/login.ts#tidyUp" in ids and not any("page.tsx#Root" in x or "panel.tsx" in x or "cleanUp" in x for x in ids)
    (repo / ".gitignore").write_text("packages/\n")
    assert cli.index(spark, store, str(repo), "n", "full", merge=True)["goneFiles"] == 3


def test_scan_reads_changes_only(spark):
    """The plan's input to the scanner has the changed files alone; an empty tree and a first run work."""
    files = spark.createDataFrame([(f"src/f{i}.ts", f"export const a{i} = {i};\n", i) for i in range(50)], "path string, content string, size long").withColumn("modified", F.current_timestamp().cast("date").cast("timestamp"))
    read = lambda paths, n: files.select("path", "content").join(paths, "path", "left_semi")
    keep = written
    one = I.refresh(files, read, None, None, True, False, keep)
    facts, listed = keep(one.facts), keep(one.files)
    assert one.changes.count() == 50 and facts.count() == 50
    newer = files.withColumn("size", F.when(F.col("path") == "src/f7.ts", 99).otherwise(F.col("size"))).withColumn("content", F.when(F.col("path") == "src/f7.ts", "export const b = 1;").otherwise(F.col("content")))
    seen = []

    def reading(paths, n):
        seen.append(n)
        return newer.select("path", "content").join(paths, "path", "left_semi")

    two = I.refresh(newer, reading, listed, facts, True, False, keep)
    assert seen == [1] and [tuple(r) for r in two.changes.collect()] == [("src/f7.ts", "scanned")]
    assert {r.name for r in two.facts.collect()} == {f"a{i}" for i in range(50) if i != 7} | {"b"}
    assert I.refresh(newer, reading, listed, facts, True, True, keep).changes.count() == 50  # other options
    none = I.refresh(newer.limit(0), reading, listed, facts, True, False, keep)
    assert none.facts.count() == 0 and none.files.count() == 0 and none.changes.filter("change = 'gone'").count() == 50


def test_order_does_not_depend_on_partitions(spark):
    """Of two specifiers of one package the same is stored, however the files are dealt."""
    rows = [(f"src/f{i}.ts", f'import x from "lib/part{i}";\n') for i in range(20)]
    frame = spark.createDataFrame(rows, "path string, content string")
    kept = [E.nodes_of(X.extract(f), "n").filter("source_id = 'external:npm:lib'").first() for f in (frame.repartition(1), frame.repartition(7), frame.orderBy(F.desc("path")))]
    assert len({(r.name, str(r.seq)) for r in kept}) == 1
