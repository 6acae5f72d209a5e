"""Plans that fuse graph and text evidence. Every result is flat, one row a file; nesting is left to the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions import predicates as P
from weftline.operators import graph as G
from weftline.operators import text as T

MAX_SEEDS, MAX_SYMBOLS, MAX_PATHS, MAX_IDENTITIES = 80, 8, 60, 7

#: Changed files that freshness names, and its fields that other answers repeat.
DIRTY = 10
SLIM = ("namespace", "repo", "language", "analysisMode", "nodes", "relationships", "localHead", "localBranch", "updatedAt", "dirtyFileCount", "graphReliable", "stale", "symbolRelationCount", "callRelationCount", "recommendedAction")


def method(in_graph: Column, in_text: Column) -> Column:
    """hybrid, graph, text or none."""
    return F.when(in_graph & in_text, "hybrid").when(in_graph, "graph").when(in_text, "text").otherwise("none")


def impact_confidence(how: Column, call_graph: Column, ambiguous: Column, stale: Column, files: Column) -> Column:
    """high, medium or low."""
    return (
        F.when(ambiguous | stale, "low")
        .when(how.isin("hybrid", "graph"), F.when(call_graph, "high").otherwise("medium"))
        .otherwise(F.when(files > 0, "medium").otherwise("low"))
    )


def rollup_confidence(rows: DataFrame, c: str = "confidence") -> DataFrame:
    """Any low gives low; else any high gives high; else medium."""
    low, high = F.max((F.col(c) == "low").cast("int")), F.max((F.col(c) == "high").cast("int"))
    return rows.agg(F.when(low == 1, "low").when(high == 1, "high").otherwise("medium").alias("confidence"))


def rollup_method(rows: DataFrame, c: str = "method") -> DataFrame:
    """Hybrid if any is, or if both graph and text are there."""
    any_of = lambda v: F.max((F.col(c) == v).cast("int")) == 1
    return rows.agg(F.when(any_of("hybrid") | (any_of("graph") & any_of("text")), "hybrid").when(any_of("graph"), "graph").otherwise("text").alias("method"))


def merge_impact(text: DataFrame, calls: DataFrame, imports: DataFrame, definitions: DataFrame) -> DataFrame:
    """Text buckets and graph rows by file and bucket: hits of each side and how the file was found.

    ``text`` has path, bucket, hit_count; the graph sides have path.
    """
    side = lambda df, bucket: df.select("path", F.lit(bucket).alias("bucket"))
    graph = side(calls, "call").unionByName(side(imports, "import")).unionByName(side(definitions, "definition")).filter("path IS NOT NULL")
    both = text.select("path", "bucket", F.col("hit_count").alias("t"), F.lit(0).cast("long").alias("g")).unionByName(graph.select("path", "bucket", F.lit(0).cast("long").alias("t"), F.lit(1).cast("long").alias("g")))
    out = both.groupBy("path", "bucket").agg(F.sum("t").alias("text_hits"), F.sum("g").alias("graph_hits"))
    return out.withColumn("method", method(F.col("graph_hits") > 0, F.col("text_hits") > 0))


def function_impact(nodes: DataFrame, edges: DataFrame, lines: DataFrame, symbol: str, **switches: bool) -> DataFrame:
    """Graph and text impact of every symbol with a name, merged."""
    ids = nodes.filter((F.col("label") == "Symbol") & (F.col("name") == symbol)).select("id")
    text = T.function_impact(lines, symbol, **switches)
    return merge_impact(text, G.callers(nodes, edges, ids), G.importers(nodes, edges, ids), G.symbol_definitions(nodes, ids))


def path_set_impact(nodes: DataFrame, edges: DataFrame, lines: DataFrame, seeds: DataFrame) -> DataFrame:
    """Files that a change of the seeds (``path``, at most 80) touches: path, role, method.

    Roles by priority: seed, dependent, importer, test, dependency; a file has the first that fits.
    """
    seeds = seeds.select("path").distinct()
    files = nodes.filter("label = 'File'").select("path")
    text = T.path_set_importers(lines, seeds)
    tag = lambda df, rank, role, how: df.select("path", F.lit(rank).alias("rank"), F.lit(role).alias("role"), F.lit(how).alias("how"))
    rows = (
        tag(seeds, 0, "seed", "given")
        .unionByName(tag(G.path_neighbours(nodes, edges, seeds, True), 1, "dependent", "graph"))
        .unionByName(tag(text.filter("NOT is_test"), 2, "importer", "text"))
        .unionByName(tag(text.filter("is_test"), 3, "test", "text"))
        .unionByName(tag(T.related_tests(files, seeds), 3, "test", "text"))
        .unionByName(tag(G.path_neighbours(nodes, edges, seeds, False), 4, "dependency", "graph"))
    )
    first = F.min(F.struct("rank", "role")).alias("x")
    out = rows.groupBy("path").agg(first, F.max((F.col("how") == "graph").cast("int")).alias("g"), F.max((F.col("how") == "text").cast("int")).alias("t"))
    return out.select("path", "x.role", method(F.col("g") == 1, F.col("t") == 1).alias("method"), P.package_hint(F.col("path")).alias("package"))


def path_set_confidence(how: str, reliable: bool, stale: bool, seeds: int) -> str:
    """The confidence of a path-set impact."""
    if seeds > 40 or stale:
        return "low"
    return "high" if how == "hybrid" and reliable else "medium"


def change_plan(nodes: DataFrame, edges: DataFrame, lines: DataFrame, symbols: list[str], seeds: DataFrame) -> DataFrame:
    """path, action (edit or verify), is_test and ``place`` (edits, then other files, then tests).

    All symbols are classified in one scan of the lines, and their ids are looked up in one pass over the graph.
    """
    if len(symbols) > MAX_SYMBOLS:
        raise ValueError(f"at most {MAX_SYMBOLS} symbols")
    rows = seeds.select("path", F.lit(0).alias("rank"))
    impact = path_set_impact(nodes, edges, lines, seeds).filter("role NOT IN ('seed', 'dependency')")
    rows = rows.unionByName(impact.select("path", F.lit(1).alias("rank")))
    if symbols:
        ids = nodes.filter((F.col("label") == "Symbol") & F.col("name").isin(*symbols)).select("id")
        # a filter on the bucket would be pushed into the scan and repeat its expressions there; a null rank is dropped below
        rank = F.when(F.col("bucket") == "definition", 0).when(F.col("bucket") != "reference", 1)
        rows = rows.unionByName(T.symbol_buckets(lines, symbols).select("path", rank.alias("rank")))
        for found, r in ((G.callers(nodes, edges, ids), 1), (G.importers(nodes, edges, ids), 1), (G.symbol_definitions(nodes, ids), 0)):
            rows = rows.unionByName(found.filter("path IS NOT NULL").select("path", F.lit(r).alias("rank")))
    out = rows.groupBy("path").agg(F.min("rank").alias("rank")).filter("rank IS NOT NULL")
    test = P.classify_path(F.col("path")) == "test"
    return out.select("path", F.when(F.col("rank") == 0, "edit").otherwise("verify").alias("action"), test.alias("is_test"), F.when(F.col("rank") == 0, 0).when(~test, 1).otherwise(2).alias("place"))


def short_name(path: str, package: str = "") -> str:
    """The last segment of a path, else the leaf of a package name; suffixes stay."""
    return path.replace("\\", "/").strip("/").rpartition("/")[2] or package.removeprefix("@").rpartition("/")[2]


#: Texts under which build jobs and images mention a short name. Fixed values.
CI_STEMS, DOCKER_STEM = ("build-{}", "deploy-{}", "{}-buildcache"), "APP_DIR={}"


def rename_identities(path: str, package: str = "", bare: bool = False, *, short: str = "", ci: bool = True, docker: bool = True) -> list[tuple[str, str]]:
    """(layer, text) under which a thing may be mentioned, at most seven; of equal texts the first layer stays."""
    name = short or short_name(path, package)
    found = [("path", path), ("package", package)]
    if name:
        found += [("ci", stem.format(name)) for stem in CI_STEMS if ci] + [("docker", DOCKER_STEM.format(name))] * docker + [("name", name)] * bare
    first: dict[str, str] = {}
    for layer, text in found:
        if text:
            first.setdefault(text, layer)
    return [(layer, text) for text, layer in first.items()][:MAX_IDENTITIES]


def rename_plan(lines: DataFrame, identities: list[tuple[str, str]]) -> DataFrame:
    """Mentions by file and layer, all identities found in one scan of the lines."""
    pairs = F.array(*(F.struct(F.lit(a).alias("layer"), F.lit(b).alias("text")) for a, b in identities))
    either = F.lit(False)
    for _, t in identities:
        either = either | F.contains("text", F.lit(t))
    rows = lines.filter(either & P.is_searchable(F.col("path")) & ~P.skip_path(F.col("path"), hidden=True))
    rows = rows.select("path", F.explode(F.filter(F.transform(pairs, lambda p: F.when(F.contains(F.col("text"), p["text"]), p["layer"])), lambda x: x.isNotNull())).alias("layer"))
    out = rows.groupBy("path", "layer").agg(F.count(F.lit(1)).alias("mentions"))
    return out.withColumn("bucket", P.classify_path(F.col("path")))


def must_not_touch(files: DataFrame, name: str, moved: str) -> DataFrame:
    """Files of other packages that only share the name: helpers and tests called like it."""
    path = F.col("path")
    like = path.rlike(rf"^packages/[^/]+/(?:utils|__tests__)/\Q{name}\E\.")
    return files.filter(like & ~path.startswith(moved.rstrip("/") + "/")).select("path")


def feature_context(nodes: DataFrame, lines: DataFrame, query: str, limit: int = 25) -> DataFrame:
    """Files to read for a feature, ranked: text hits outside docs and config, then graph nodes by name."""
    category = P.classify_path(F.col("path"))
    text = lines.filter(P.is_searchable(F.col("path")) & ~P.skip_path(F.col("path")) & F.contains("text", F.lit(query)) & P.include_category(category, docs=False, config=False))
    text = text.groupBy("path").agg(F.count(F.lit(1)).alias("match_count")).orderBy(F.desc("match_count"), "path").limit(limit).select("path", F.lit(0).alias("grp"), "match_count")
    hits = G.search_code(nodes, query, limit).filter("path IS NOT NULL").select("path", F.lit(1).alias("grp"), F.lit(0).cast("long").alias("match_count"))
    both = text.unionByName(hits)
    first = F.row_number().over(Window.partitionBy("path").orderBy("grp"))
    rows = both.withColumn("r", first).filter("r = 1").drop("r").withColumn("is_test", P.classify_path(F.col("path")) == "test")
    return rows.orderBy("grp", F.desc("match_count"), "path").limit(limit)


def freshness(counts: dict[str, int], call_edges: int, import_edges: int, git: dict, entry: dict | None, has_graph: bool) -> dict:
    """Whether the graph can be relied on, and why not. At most ``DIRTY`` changed files are named."""
    dirty, entry = git["dirty"], entry or {}
    mode = (entry.get("analysis_mode") or "unknown").lower()
    reliable = has_graph and call_edges > 0 and not dirty
    notes = (
        ["no graph is stored; impact comes from the text alone"] * (not has_graph) + ["working copy has changes that are not indexed"] * bool(dirty) + ["no call edges are stored"] * (call_edges == 0)
        + ["no symbol imports are stored; who imports comes from the text"] * (has_graph and import_edges == 0) + ["a fast analysis leaves out the relations of symbols in a large tree"] * (mode == "fast" and call_edges == 0)
    )
    out = {"nodes": counts["nodes"], "relationships": counts["edges"], "analysisMode": mode, "localHead": git["head"], "localBranch": git["branch"], "dirtyFileCount": len(dirty), "dirtySample": dirty[:DIRTY]}
    out |= {"callRelationCount": call_edges, "importSymbolRelationCount": import_edges, "symbolRelationCount": call_edges + import_edges, "graphReliable": reliable, "stale": bool(dirty), "freshnessNotes": notes}
    out |= {k: str(entry[c]) for k, c in (("namespace", "name"), ("repo", "repo"), ("language", "language"), ("createdAt", "created_at"), ("updatedAt", "updated_at")) if entry.get(c) is not None}
    return out if reliable else out | {"recommendedAction": "Trust what the text shows over the graph, and rebuild with reindex after large edits."}


def slim_index(index: dict) -> dict:
    """The part of ``freshness`` that other answers carry."""
    return {k: index[k] for k in SLIM if index.get(k) is not None}
