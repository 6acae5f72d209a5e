"""Facts to graph events: everything between files is a join, so only the scan of a file is Python."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.extract import ignore as IG
from weftline.extract.scan import Fact, facts
from weftline.functions import predicates as P
from weftline.sources.events import PROTOCOL, union
from weftline.sources.shared import written

SCHEMA = "path string, fact string, name string, kind string, owner string, specifier string, names array<string>, line long, end_line long, exported boolean, scope string, signature string, code string"
SOURCE = r"\.(?:ts|tsx|js|jsx)$"
#: Limits of the modes: relations are skipped above it unless forced.
RELATION_FILES = 750

def scan(files: DataFrame, relations: bool = True, identifiers: bool = False) -> DataFrame:
    """Facts of every source file; a file's content meets Python once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = list(Fact._fields)
        kinds = {"names": pa.list_(pa.string()), "line": pa.int64(), "end_line": pa.int64(), "exported": pa.bool_()}
        for batch in batches:
            for path, text in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = facts(path, text or "", relations, identifiers)
                if rows:
                    cols = dict(zip(fields, zip(*rows, strict=True), strict=True))
                    names = ["fact", "name", "kind", "owner", "specifier", "names", "line", "end_line", "exported", "scope", "signature", "code"]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), *(pa.array(list(cols[n]), kinds.get(n, pa.string())) for n in names)], names=["path", *names])

    return files.filter(F.col("path").rlike(SOURCE)).select("path", "content").mapInArrow(run, SCHEMA)


def _props(**cols: Column) -> Column:
    pairs = [x for k, c in cols.items() for x in (F.lit(k), c.cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def _event(df: DataFrame, kind: str, **cols: Column) -> DataFrame:
    text = lambda name: cols.get(name, F.lit(None)).cast("string").alias(name)
    return df.select(F.lit(PROTOCOL).alias("protocol"), F.lit(kind).alias("type"), *(text(n) for n in ("label", "id", "rel", "from", "to")), F.coalesce(cols.get("source", F.lit("typescript")), F.lit("typescript")).alias("source"), text("message"), cols["props"].alias("props"))


def node(df: DataFrame, label: str, node_id: Column, **props: Column) -> DataFrame:
    """Node events."""
    return _event(df, "node", label=F.lit(label), id=node_id, props=_props(**props))


def edge(df: DataFrame, rel: Column | str, a: Column, b: Column, reason: str, confidence: Column | float, path: Column | None = None, line: Column | None = None, end: Column | None = None, source: str = "typescript") -> DataFrame:
    """Edge events with their provenance."""
    path = F.col("path") if path is None else path
    line = F.lit(1) if line is None else line
    conf = confidence if isinstance(confidence, Column) else F.lit(confidence)
    props = _props(sourceFile=path, startLine=line, endLine=line if end is None else end, confidence=conf, reason=F.lit(reason), extractor=F.lit("typescript"), language=F.lit("typescript"))
    return _event(df, "edge", rel=P.lit(rel), **{"from": a, "to": b}, source=F.lit(source), props=props)


def file_facts(files: DataFrame, relations: bool = True, identifiers: bool = False) -> DataFrame:
    """All that the events need to know of (path, content): facts of source files, and manifests as they are."""
    manifests = files.filter(P.base_name(F.col("path")) == "package.json")
    other = [F.lit(None).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(SCHEMA).fields[2:-1]]
    return scan(files, relations, identifiers).unionByName(manifests.select("path", F.lit("manifest").alias("fact"), *other, F.col("content").alias("code")))


def packages(found: DataFrame) -> DataFrame:
    """name, root, kind, manifest path and dependencies of every package.json, from the facts."""
    rows = found.filter("fact = 'manifest'")
    parsed = rows.select("path", F.from_json("code", "name string, dependencies map<string,string>, devDependencies map<string,string>").alias("m"))
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    root = F.when(folder == "", ".").otherwise(folder)
    none = F.create_map().cast("map<string,string>")
    deps, dev = F.coalesce("m.dependencies", none), F.coalesce("m.devDependencies", none)
    both = F.map_concat(F.map_filter(deps, lambda k, _: ~F.array_contains(F.map_keys(dev), k)), dev)
    kind = F.when((root == ".") | root.startswith("apps/"), "app").when(root.startswith("packages/"), "package").otherwise("unknown")
    return parsed.select(F.coalesce("m.name", root).alias("name"), root.alias("root"), kind.alias("kind"), F.col("path").alias("manifest"), both.alias("deps"))


def package_of(files: DataFrame, pkgs: DataFrame) -> DataFrame:
    """Each file with its package: the longest root that leads its path. Ancestors are exploded, so it is an equi-join."""
    parts = F.split("path", "/")
    roots = F.concat(F.array(F.lit(".")), F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/")))
    rows = files.select("path", F.explode(roots).alias("root")).join(pkgs.select("root", F.col("name").alias("package")), "root")
    best = rows.groupBy("path").agg(F.max_by(F.struct("package", "root"), F.when(F.col("root") == ".", 0).otherwise(F.length("root"))).alias("p"))
    return files.select("path").join(best, "path", "left").select("path", F.concat(F.lit("package:"), F.col("p.package")).alias("package_id"), F.col("p.root").alias("root"))


def resolved_imports(found: DataFrame, sources: DataFrame) -> DataFrame:
    """Relative imports with ``target``: the first existing of the bare path, four suffixes and four index files."""
    rows = found.filter("fact = 'import' AND specifier LIKE '.%'")
    folder = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
    base = P.resolve_dots(F.concat(folder, "specifier"))
    ends = ["", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]
    cands = rows.withColumn("base", base).select("*", F.posexplode(F.array(*(F.concat("base", F.lit(e)) for e in ends))).alias("pos", "target"))
    hit = cands.join(sources.select(F.col("path").alias("target")), "target", "left_semi")
    return hit.groupBy("path", "kind", "specifier", "names", "line").agg(F.min_by("target", "pos").alias("target"))


def bindings(rel: DataFrame) -> DataFrame:
    """path, line, target, name and alias of each name that a relative import binds; ``name`` is * for a whole module."""
    pair = F.split("n", ":")
    rows = rel.filter("kind = 'import'").select("path", "target", "line", F.explode("names").alias("n"))
    return rows.select("path", "line", "target", pair[0].alias("name"), pair[1].alias("alias"))


def exported_names(rel: DataFrame, local: DataFrame, found: DataFrame, named: DataFrame) -> dict[str, DataFrame]:
    """What files export, in three tables.

    ``own``: path, name, q (a declared symbol; a file's own top-level names count whether exported or not). ``alias``:
    path, name, to_path, to_name. ``star``: path, to_path. A name that a file exports explicitly hides its own of that name.
    """
    pair = F.split("n", ":")
    again = rel.filter("kind = 're_export'").select("path", F.col("target").alias("to_path"), F.explode("names").alias("n")).select("path", "to_path", pair[0].alias("to_name"), pair[1].alias("name"))
    star = again.filter("to_name = '*' AND name = '*'").select("path", "to_path").distinct()
    again = again.filter("to_name <> '*'").select("path", "name", "to_path", "to_name")
    lists = found.filter("fact = 'export'").select("path", "name", F.col("specifier").alias("local")).distinct()
    inner = lists.join(named.select("path", F.col("name").alias("local"), "q"), ["path", "local"])
    outer = lists.join(local.filter("name <> '*'").select("path", F.col("alias").alias("local"), F.col("target").alias("to_path"), F.col("name").alias("to_name")), ["path", "local"])
    alias = again.unionByName(outer.join(inner.select("path", "name"), ["path", "name"], "left_anti").select("path", "name", "to_path", "to_name")).distinct()
    listed = inner.select("path", "name", "q").distinct()
    explicit = alias.select("path", "name").unionByName(listed.select("path", "name")).distinct()
    own = listed.unionByName(named.join(explicit, ["path", "name"], "left_anti").select("path", "name", "q"))
    return {"own": own, "alias": alias, "star": star}


def star_aliases(names: dict[str, DataFrame], keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Aliases that ``export *`` makes: every name of the other file but default, where the file has none of its own.

    Names spread from file to file; each round starts from those that are new, so files that star each other end.
    """
    star, explicit = keep(names["star"]), names["own"].select("path", "name").unionByName(names["alias"].select("path", "name")).distinct()
    if star.isEmpty():
        return names["alias"].limit(0)
    known = new = explicit = keep(explicit)
    while True:
        step = star.join(new.filter("name <> 'default'").select(F.col("path").alias("to_path"), "name"), "to_path").select("path", "name").distinct()
        new = keep(step.join(known, ["path", "name"], "left_anti"))
        if new.isEmpty():
            break
        known = keep(known.unionByName(new))
    made = star.join(known.filter("name <> 'default'").select(F.col("path").alias("to_path"), "name"), "to_path")
    return made.join(explicit, ["path", "name"], "left_anti").select("path", "name", "to_path", F.col("name").alias("to_name"))


def resolved_names(names: dict[str, DataFrame], keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """path, name, to_path and q: the symbols that each exported name stands for in the end.

    Pointer jumping: each round follows every alias twice as far, so a chain of n files takes log n rounds. Aliases that run
    in a circle never come to a symbol; after as many rounds as any chain can need they are dropped. A name that several
    files bring by ``export *`` keeps all its symbols.
    """
    names = names | {"own": keep(names["own"]), "alias": keep(names["alias"])}
    done = names["own"].select("path", "name", F.col("path").alias("to_path"), "q").distinct()
    ahead = keep(names["alias"].unionByName(star_aliases(names, keep)).distinct())
    n = ahead.count()
    for _ in range(n.bit_length() + 1 if n else 0):
        there = done.select(F.col("path").alias("p"), F.col("name").alias("n"), F.col("to_path").alias("found"), "q")
        at = (F.col("to_path") == F.col("p")) & (F.col("to_name") == F.col("n"))
        done = keep(done.unionByName(ahead.join(there, at).select("path", "name", F.col("found").alias("to_path"), "q")).distinct())
        on = ahead.select(F.col("path").alias("p"), F.col("name").alias("n"), F.col("to_path").alias("next_path"), F.col("to_name").alias("next_name"))
        ahead = keep(ahead.join(on, at).select("path", "name", F.col("next_path").alias("to_path"), F.col("next_name").alias("to_name")).distinct())
        if ahead.isEmpty():
            break
    return done


def bound_symbols(local: DataFrame, names: dict[str, DataFrame], keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """path, line, alias, to_path and q of each imported name that is found."""
    there = resolved_names(names, keep).select(F.col("path").alias("target"), "name", "to_path", "q")
    return local.join(there, ["target", "name"]).select("path", "line", "alias", "to_path", "q").distinct()


def routes(sources: DataFrame, owners: DataFrame) -> DataFrame:
    """path, route_path, method, router and root of files that are routes."""
    path = F.col("path")
    app = path.rlike(r"/app/(?:.*/)?(?:page|route)\.(?:ts|tsx)$")
    inner = F.regexp_replace(F.regexp_extract(path, r"/app/(.*)$", 1), r"(?:^|/)(?:page|route)\.(?:ts|tsx)$", "")
    parts = F.filter(F.split(inner, "/"), lambda s: (s != "") & ~s.startswith("(") & ~s.startswith("@"))
    rest = F.regexp_replace(F.regexp_extract(path, r"/pages/(.*)$", 1), SOURCE, "")
    api = rest.startswith("api/")
    page_path = F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(rest, r"(^|/)index$", ""), r"\[(.+?)\]", ":$1"))
    clean = lambda c: F.when(F.regexp_replace(c, "/$", "") == "", "/").otherwise(F.regexp_replace(c, "/$", ""))
    rows = sources.join(owners.select("path", "root"), "path", "left").filter(app | path.contains("/pages/"))
    handler = path.rlike(r"/route\.tsx?$")
    return rows.select(
        "path", F.when(app, clean(F.concat(F.lit("/"), F.array_join(parts, "/")))).otherwise(clean(page_path)).alias("route_path"),
        F.when(app, F.when(handler, "ANY").otherwise("PAGE")).otherwise(F.when(api, "ANY").otherwise("PAGE")).alias("method"),
        F.when(app, "app").otherwise(F.when(api, "api").otherwise("pages")).alias("router"), F.coalesce("root", F.lit(".")).alias("root"),
    )


def layouts(sources: DataFrame, found: DataFrame) -> DataFrame:
    """path and layout: the layouts of a route's folders up to its app folder."""
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    inside = F.filter(folders, lambda d: F.concat(F.lit("/"), d, F.lit("/")).contains("/app/"))
    rows = found.filter("router = 'app'").select("path", F.explode(inside).alias("d")).select("path", F.explode(F.array(F.concat("d", F.lit("/layout.tsx")), F.concat("d", F.lit("/layout.ts")))).alias("layout"))
    return rows.join(sources.select(F.col("path").alias("layout")), "layout", "left_semi")


def extract(files: DataFrame, ignore: DataFrame | dict[str, str] | None = None, relations: bool | None = None, identifiers: bool = False, keep: Callable[[DataFrame], DataFrame] = written) -> DataFrame:
    """Graph events of a tree of (path, content). ``ignore`` has its ignore files (path, content); ``relations`` None: only
    where the tree is small enough."""
    if not isinstance(ignore, DataFrame):
        ignore = files.sparkSession.createDataFrame(list((ignore or {}).items()), "path string, content string")
    files = IG.kept(files, keep(IG.rules(ignore)))
    paths = keep(files.select("path"))
    if relations is None:
        relations = small(paths)
    return link(paths, keep(file_facts(files, relations, identifiers)), relations, keep)


def small(paths: DataFrame) -> bool:
    """Whether a tree has few enough source files for the relations of its symbols."""
    return paths.filter(F.col("path").rlike(SOURCE)).limit(RELATION_FILES + 1).count() <= RELATION_FILES


def link(paths: DataFrame, found: DataFrame, relations: bool = True, keep: Callable[[DataFrame], DataFrame] = written) -> DataFrame:
    """Graph events of the files' paths and of their facts: joins alone, no file is read. Both are read several times.

    ``keep`` makes a DataFrame that is computed once; the caller lets go of it when the events are written.
    """
    sources = paths.filter(F.col("path").rlike(SOURCE)).select("path")
    pkgs = keep(packages(found))
    owners = keep(package_of(sources, pkgs))
    cat = lambda *x: F.concat(*(P.lit(c) if isinstance(c, Column) else F.lit(c) for c in x))
    file_id, pkg_id, project_id = cat("file:", F.col("path")), cat("package:", F.col("name")), cat("project:", F.col("root"))
    manifest = F.col("manifest")
    out = [
        node(pkgs, "Package", pkg_id, name=F.col("name"), root=F.col("root"), kind=F.col("kind"), packageJsonPath=manifest, language=F.lit("typescript")),
        node(pkgs, "Project", project_id, root=F.col("root"), language=F.lit("typescript"), packageId=pkg_id),
        edge(pkgs, "CONTAINS_PACKAGE", project_id, pkg_id, "workspace_package", 1.0, manifest),
    ]
    dep = pkgs.select("name", "manifest", F.explode("deps").alias("dep", "version")).join(pkgs.select(F.col("name").alias("dep"), F.lit(True).alias("own")), "dep", "left")
    own, ext = dep.filter("own"), dep.filter("own IS NULL")
    ext_id = cat("external:npm:", F.col("dep"))
    out += [
        edge(own, "DEPENDS_ON_PACKAGE", pkg_id, cat("package:", F.col("dep")), "manifest_dependency", 1.0, manifest),
        node(ext, "ExternalPackage", ext_id, name=F.col("dep"), version=F.col("version"), ecosystem=F.lit("npm")), edge(ext, "USES_EXTERNAL_PACKAGE", pkg_id, ext_id, "manifest_dependency", 1.0, manifest),
    ]
    placed = sources.join(owners, "path")
    out += [
        node(placed, "File", file_id, path=F.col("path"), language=F.substr(P.extension(F.col("path")), F.lit(2)), kind=P.file_kind(F.col("path")), packageId=F.col("package_id")),
        edge(placed.filter("package_id IS NOT NULL"), "CONTAINS_FILE", F.col("package_id"), file_id, "package_file", 1.0), edge(placed.filter("root IS NOT NULL"), "CONTAINS_FILE", project_id, file_id, "project_file", 1.0),
    ]
    # imports
    rel = keep(resolved_imports(found, sources))
    kinds = F.when(F.col("kind") == "re_export", "RE_EXPORTS_FILE").when(F.col("kind") == "dynamic", "DYNAMIC_IMPORTS_FILE").otherwise("IMPORTS_FILE")
    out.append(edge(rel, kinds, file_id, cat("file:", F.col("target")), "relative_import", 0.85, line=F.col("line")))
    bare = found.filter("fact = 'import' AND specifier NOT LIKE '.%' AND specifier NOT LIKE '/%'").withColumn("pkg", F.regexp_extract("specifier", r"^(@[^/]+/[^/]+|[^/]+)", 1))
    bare = bare.join(pkgs.select(F.col("name").alias("pkg"), F.lit(True).alias("own")), "pkg", "left").join(owners.select("path", "package_id"), "path", "left")
    inner, outer = bare.filter("own"), bare.filter("own IS NULL")
    out += [
        edge(inner, "DEPENDS_ON_PACKAGE", F.coalesce("package_id", file_id), cat("package:", F.col("pkg")), "package_import", 0.6, line=F.col("line")),
        node(outer, "ExternalPackage", cat("external:npm:", F.col("pkg")), name=F.col("pkg"), ecosystem=F.lit("npm"), specifier=F.col("specifier")),
        edge(outer, "IMPORTS_EXTERNAL_PACKAGE", file_id, cat("external:npm:", F.col("pkg")), "package_import", 0.9, line=F.col("line")),
    ]
    # symbols
    syms = found.filter("fact IN ('symbol', 'param', 'var')").join(owners.select("path", "package_id"), "path", "left")
    qualified = F.col("specifier")
    sid = lambda name: cat("symbol:", F.col("path"), "#", name)
    child = F.col("fact") != "symbol"
    out.append(node(syms, "Symbol", sid(qualified), name=F.col("name"), kind=F.col("kind"), language=F.lit("typescript"), filePath=F.col("path"), path=F.col("path"), packageId=F.col("package_id"), startLine=F.col("line"), endLine=F.col("end_line"), exported=F.col("exported"), scope=F.col("scope"), ownerId=F.when(child, sid(F.col("owner"))), signature=F.col("signature"), code=F.when(F.col("code") != "", F.col("code")), confidence=F.lit(1)))
    tops = syms.filter(~child)
    line, end = F.col("line"), F.col("end_line")
    out += [
        edge(tops, "DEFINES", file_id, sid(qualified), "symbol_declaration", 1.0, line=line, end=end), edge(tops.filter("exported"), "EXPORTS_SYMBOL", file_id, sid(qualified), "exported_symbol", 1.0, line=line, end=end),
        edge(syms.filter("fact = 'param'"), "HAS_PARAMETER", sid(F.col("owner")), sid(qualified), "function_parameter", 1.0, line=line, end=end), edge(syms.filter("fact = 'var'"), "DECLARES_VARIABLE", sid(F.col("owner")), sid(qualified), "function_variable", 1.0, line=line, end=end),
    ]
    named = keep(tops.groupBy("path", "name").agg(F.min_by("specifier", F.struct("line", "specifier")).alias("q")))
    local = bindings(rel)
    bound = keep(bound_symbols(local, exported_names(rel, local, found, named), keep))
    target = cat("symbol:", F.col("to_path"), "#", F.col("q"))
    out.append(edge(bound.select("path", "line", "to_path", "q").distinct(), "IMPORTS_SYMBOL", file_id, target, "import_resolved", 1.0, line=line))
    # references: the file's own symbols, then its imports, then a name that is unique in the tree
    if relations:
        refs = found.filter("fact = 'ref'")
        here = named.select("path", "name", cat("symbol:", F.col("path"), "#", F.col("q")).alias("t1"))
        via = bound.select("path", F.col("alias").alias("name"), target.alias("t2")).distinct()  # an ambiguous name has several
        sole = named.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min(cat("symbol:", F.col("path"), "#", F.col("q"))).alias("t3")).filter("n = 1").drop("n")
        refs = refs.join(here, ["path", "name"], "left").join(via, ["path", "name"], "left").join(sole, "name", "left").withColumn("t", F.coalesce("t1", "t2", "t3"))
        refs = refs.withColumn("o", sid(F.col("owner"))).filter("t IS NOT NULL AND t <> o").dropDuplicates(["kind", "o", "t", "path", "line", "end_line"])
        out.append(edge(refs, F.col("kind"), F.col("o"), F.col("t"), "name_resolved", F.when(F.col("kind") == "REFERENCES", 1.0).otherwise(0.75), line=line, end=end))
        env = found.filter("fact = 'env'")
        out += [node(env, "ConfigKey", cat("config:", F.col("name")), key=F.col("name"), source=F.lit("process.env")), edge(env, "USES_CONFIG_KEY", file_id, cat("config:", F.col("name")), "static_env_key", 0.9, line=line, end=end)]
    tests = found.filter("fact = 'test'")
    tid = cat("test:", F.col("path"), "#", F.col("name"))
    out += [node(tests, "Test", tid, filePath=F.col("path"), testName=F.col("name"), startLine=line, endLine=end, framework=F.lit("vitest")), edge(tests, "TESTS_FILE", tid, file_id, "test_block", 0.8, line=line, end=end)]
    route = routes(sources, owners)
    rid = cat("route:", F.col("root"), ":", F.col("method"), ":", F.col("route_path"))
    out += [
        node(route, "Route", rid, routePath=F.col("route_path"), filePath=F.col("path"), routerKind=F.col("router"), httpMethod=F.col("method"), projectRoot=F.col("root")),
        edge(route, "ROUTE_FILE", rid, file_id, "route_file", 1.0, source="nextjs"), edge(route.filter(F.col("path").rlike(r"/page\.tsx?$")), "USES_PAGE", rid, file_id, "page_file", 1.0, source="nextjs"),
        edge(layouts(sources, route).join(route, "path"), "USES_LAYOUT", rid, cat("file:", F.col("layout")), "layout_chain", 0.9, source="nextjs"),
    ]
    verbs = ["GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS"]
    handlers = route.filter(F.col("path").rlike(r"/route\.tsx?$")).join(tops.filter(F.col("name").isin(*verbs) & F.col("kind").isin("function", "component")).select("path", "specifier", "line"), "path")
    out.append(edge(handlers, "HANDLES_ROUTE", sid(F.col("specifier")), rid, "route_handler", 1.0, line=line, source="nextjs"))
    unavailable = paths.sparkSession.createDataFrame([("dependency validation is not available",)], "message string")
    out.append(_event(unavailable, "warning", message=F.col("message"), source=F.lit("validation"), props=F.create_map().cast("map<string,string>")))
    events = union(out)
    return events.withColumn("raw", F.to_json(F.struct(*[F.col(f"`{c}`") for c in events.columns]))).dropDuplicates(["raw"]).withColumn("seq", F.col("raw"))  # the order is that of the events themselves


def with_summary(events: DataFrame, began: float) -> DataFrame:
    """The events (persisted, as they are counted first) and a last one that tells how many there are and what time it took."""
    row = events.sparkSession.createDataFrame([(str(events.count()), str(int(1000 * (time.time() - began))))], "n string, ms string")
    last = _event(row, "summary", message=F.lit("extraction finished"), props=F.create_map(F.lit("events"), F.col("n"), F.lit("durationMs"), F.col("ms")))
    last = last.withColumn("raw", F.to_json(F.struct(*[F.col(f"`{c}`") for c in last.columns]))).withColumn("seq", F.lit("~"))  # after all that begin with a brace
    return events.unionByName(last)


def summary(events: DataFrame) -> dict[str, int]:
    """How many events of each type."""
    return {r["type"]: r["count"] for r in events.groupBy("type").count().collect()}  # at most four rows


def write_ndjson(events: DataFrame, path: str) -> None:
    """The events as NDJSON files."""
    events.select(F.col("raw").alias("value")).write.text(path)


def parse_json(text: str) -> dict:
    """A JSON object, or an empty one."""
    try:
        out = json.loads(text)
    except ValueError:
        return {}
    return out if isinstance(out, dict) else {}
