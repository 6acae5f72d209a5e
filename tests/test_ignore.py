"""The table of ignore rules against a walk over every rule for every prefix."""

from __future__ import annotations

import random
import re

import pytest

from weftline.extract import ignore as IG


def fits(line, folder, prefix, is_folder):
    """Whether one line fits one prefix, by an expression made of the whole line."""
    text = line.strip()
    negated, text = text.startswith("!"), text.removeprefix("!")
    if folder:
        text = f"{folder}/{text.removeprefix('/')}"
    only, text = text.endswith("/"), text.rstrip("/")
    whole = text.removeprefix("/") if "/" in text else f"**/{text}"
    return negated, (is_folder or not only) and bool(re.match("(?i)" + IG.glob_regex(whole), prefix))


def brute(paths, files):
    lines = [(x, "") for x in IG.BUILT_IN]
    for f in sorted(files):
        lines += [(x, f.rpartition("/")[0]) for x in files[f].split("\n") if x.strip() and not x.startswith("#")]
    out = []
    for path in paths:
        parts = path.split("/")
        keep = True
        for i in range(1, len(parts) + 1):
            decision = False
            for line, folder in lines:
                negated, hit = fits(line, folder, "/".join(parts[:i]), i < len(parts))
                decision = not negated if hit else decision
            keep = keep and not decision
        if keep:
            out.append(path)
    return sorted(out)


def found(spark, paths, files):
    df = spark.createDataFrame([(p, 1) for p in paths], "path string, size int")
    rules = IG.rules(spark.createDataFrame(list(files.items()), "path string, content string"))
    return sorted(r.path for r in IG.kept(df, rules).collect())


def test_against_every_rule(spark):
    rng = random.Random(6)
    names = ["a", "b", "Lib", "x.ts", "y.d.ts", "z.log", "out", "keep.txt", "node_modules", "c[1]", "dist"]
    paths = sorted({"/".join(rng.choices(names, k=rng.randint(1, 5))) for _ in range(500)})
    lines = ["a/", "!a/keep.txt", "*.log", "!z.log", "/out", "b/**", "!b/x.ts", "**/lib/*.ts", "x?ts", "a/**/b", "c\\[1\\]", "**/out/x.ts", "#no", "", "k[a-f]ep.txt", "!k[!z]ep.txt", "*", "!*/", "LIB", "out/*"]
    for _ in range(4):
        files = {p: "\n".join(rng.sample([x for x in lines if x != "*"], rng.randint(2, 8))) for p in (".gitignore", "a/.gitignore", "Lib/b/.gitignore")}
        assert found(spark, paths, files) == brute(paths, files), files
    assert found(spark, paths, {".gitignore": "*\n!*/\n!x.ts"}) == brute(paths, {".gitignore": "*\n!*/\n!x.ts"})


def test_ten_thousand_rules(spark):
    """As many rules as a large tree has, looked up by key: the plan has no line of its own for any of them."""
    files = {".gitignore": "\n".join(f"gen{i}/" if i % 3 else f"*.g{i}" for i in range(10_000)) + "\n!gen7/", "a/.gitignore": "gen7/\nx.*"}
    paths = ["gen1/a.ts", "gen7/a.ts", "a/gen7/a.ts", "b/gen7/a.ts", "b.g3", "b.g4", "a/x.ts", "b/x.ts", "gen3/a.ts", "a/b/x.ts"]
    assert found(spark, paths, files) == brute(paths, files) == ["a/b/x.ts", "b.g4", "b/gen7/a.ts", "b/x.ts", "gen3/a.ts", "gen7/a.ts"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    plan = IG.kept(df, IG.rules(spark.createDataFrame(list(files.items()), "path string, content string")))._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 40_000 and "Cartesian" not in plan


@pytest.mark.parametrize(("line", "folder", "want"), [
    ("dist/", "", IG.Rule(False, True, "name", "dist", "")), ("!*.Log", "", IG.Rule(True, False, "ending", ".log", "")), ("/a/b", "x", IG.Rule(False, False, "path", "x/a/b", "")), ("**/n/**", "", IG.Rule(False, False, "in name", "n", "")),
    ("a/**", "", IG.Rule(False, False, "in path", "a", "")), ("a/b*/c", "", IG.Rule(False, False, "below", "a", "(?i)^a/b[^/]*/c$")), ("# no", "", None), ("  ", "", None), ("/", "", None),
])
def test_rule_of(line, folder, want):
    assert IG.rule_of(line, folder) == want


def test_edges(spark):
    df = spark.createDataFrame([("a.ts", 1), ("a.ts", 2), (None, 3), ("node_modules/x/a.ts", 4)], "path string, size int")
    rules = IG.rules(spark.createDataFrame([(None, "a.ts"), ("b/.gitignore", None)], "path string, content string"))
    assert sorted(r["size"] for r in IG.kept(df, rules).collect()) == [1, 2] and IG.kept(df.limit(0), rules).count() == 0
    files = spark.createDataFrame([(".gitignore", "x"), ("node_modules/.gitignore", "y"), ("a/b.ts", "z")], "path string, content string")
    assert [r.path for r in IG.ignore_files(files).collect()] == [".gitignore"]
