"""Graph lookups, filters, counts and impact queries over ``nodes`` and ``edges``.

``nodes``: id, label, name, path, kind, package_id, start_line, exported. ``edges``: type, src, dst, source_file,
start_line, confidence (null counts as 1.0). Results with a limit carry one more row than asked for, so that the caller
can tell whether there were more; every order is total.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions.predicates import matches_filters

CALLS = ("CALLS", "RENDERS", "INSTANTIATES")
DEPENDENT_TYPES = ("IMPORTS_FILE", "RE_EXPORTS_FILE", "DYNAMIC_IMPORTS_FILE", "TESTS_FILE")
DEPENDENCY_TYPES = ("IMPORTS_FILE", "RE_EXPORTS_FILE", "DYNAMIC_IMPORTS_FILE")
MIN_CONFIDENCE, PATH_CONFIDENCE = 0.6, 0.5


def confidence() -> Column:
    """An edge's confidence; a missing one is certain."""
    return F.coalesce("confidence", F.lit(1.0))


def _has(c: str, text: str) -> Column:
    return F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(text.lower()))


def _up(*cols: Column) -> list[Column]:
    return [c.asc_nulls_last() for c in cols]


def search_code(nodes: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Nodes with the query, in any case, in one of their text fields."""
    hit = reduce(or_, (_has(c, query) for c in ("id", "name", "path", "kind", "package_id", "label")))
    return nodes.filter(hit).orderBy(*_up(F.col("label"), F.coalesce("path", "name", "id"), F.col("id"))).limit(limit + 1)


def find_symbol(nodes: DataFrame, name: str, limit: int = 20) -> DataFrame:
    """Symbols with the text in their name."""
    return nodes.filter((F.col("label") == "Symbol") & _has("name", name)).orderBy(*_up(F.col("name"), F.col("id"))).limit(limit + 1)


def find_file(nodes: DataFrame, path: str, limit: int = 20) -> DataFrame:
    """Files with the text in their path."""
    where = F.lower(F.coalesce("path", "id")).contains(path.lower())
    return nodes.filter((F.col("label") == "File") & where).orderBy(*_up(F.coalesce("path", "id"), F.col("id"))).limit(limit + 1)


def node(nodes: DataFrame, node_id: str) -> DataFrame:
    """The node with an id."""
    return nodes.filter(F.col("id") == node_id).limit(1)


def symbol_candidates(nodes: DataFrame, name: str, limit: int = 20, **filters: str) -> DataFrame:
    """Ranked candidates for a symbol name. Filters apply before the limit, so a rare match is never cut off.

    ``match`` is exact or contains; ``n_exact`` and ``n_all`` count over all candidates.
    """
    low = name.lower()
    rows = nodes.filter((F.col("label") == "Symbol") & (_has("name", low) | _has("id", low)))
    rows = rows.filter(matches_filters(F.col("package_id"), F.col("path"), **filters)) if filters else rows
    exact = F.lower(F.coalesce("name", F.lit(""))) == low
    rows = rows.withColumn("match", F.when(exact, "exact").otherwise("contains"))
    counts = rows.agg(F.sum(exact.cast("long")).alias("n_exact"), F.count(F.lit(1)).alias("n_all"))
    nested = F.contains(F.coalesce("name", F.lit("")), F.lit("::")).cast("int")
    order = [(~exact).cast("int"), nested, (~F.coalesce("exported", F.lit(False))).cast("int"), *_up(F.coalesce("path", "id"), F.col("name"), F.col("id"))]
    return rows.orderBy(*order).limit(limit).join(F.broadcast(counts), how="left")  # one row


def resolve_state(candidates: DataFrame) -> DataFrame:
    """ambiguous and selected (an id or null): one exact match wins, else a sole candidate."""
    one = F.max(F.when(F.col("match") == "exact", F.col("id")))
    state = candidates.agg(F.coalesce(F.max("n_exact"), F.lit(0)).alias("n_exact"), F.coalesce(F.max("n_all"), F.lit(0)).alias("n_all"), one.alias("exact_id"), F.max("id").alias("any_id"))
    selected = F.when(F.col("n_exact") == 1, F.col("exact_id")).when((F.col("n_exact") == 0) & (F.col("n_all") == 1), F.col("any_id"))
    return state.select("n_exact", "n_all", ((F.col("n_exact") > 1) | (F.col("n_exact") == 0) & (F.col("n_all") > 1)).alias("ambiguous"), selected.alias("selected"))


def node_lean(nodes: DataFrame) -> DataFrame:
    """The short form of nodes."""
    return nodes.select("id", "label", "name", F.coalesce("path", F.when(F.col("id").startswith("file:"), F.expr("substr(id, 6)"))).alias("path"), "kind", "package_id")


def edge_lean(edges: DataFrame) -> DataFrame:
    """The short form of edges."""
    return edges.select("type", F.col("src").alias("source_from"), F.col("dst").alias("source_to"), "source_file", "start_line", confidence().alias("confidence"))


def symbol_definitions(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """The wanted symbols. ``ids`` has ``id``."""
    return nodes.filter(F.col("label") == "Symbol").join(ids, "id", "left_semi")


def callers(nodes: DataFrame, edges: DataFrame, ids: DataFrame, min_confidence: float = MIN_CONFIDENCE, limit: int | None = None) -> DataFrame:
    """Who calls, renders or instantiates the wanted symbols: path, kind, owner, line, confidence and target.

    The wanted ids reduce the edges before the callers' nodes are joined.
    """
    sure = edges.filter(F.col("type").isin(*CALLS) & (confidence() >= min_confidence)).join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    own = nodes.select(F.col("id").alias("src"), F.col("name").alias("owner"), F.col("path").alias("_path"))
    out = sure.join(own, "src").select(F.coalesce("source_file", "_path").alias("path"), F.col("type").alias("kind"), "owner", F.col("start_line").alias("line"), confidence().alias("confidence"), F.col("dst").alias("target"), "src")
    return out if limit is None else out.orderBy(*_up(F.col("path"), F.coalesce("line", F.lit(0)), F.col("src"), F.col("target"), F.col("kind"), F.col("confidence"))).limit(limit + 1)


def importers(nodes: DataFrame, edges: DataFrame, ids: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Files that import the wanted symbols."""
    sure = edges.filter((F.col("type") == "IMPORTS_SYMBOL") & (confidence() >= min_confidence)).join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    own = nodes.select(F.col("id").alias("src"), F.col("path").alias("_path"))
    return sure.join(own, "src").select(F.coalesce("source_file", "_path").alias("path"), F.col("start_line").alias("line"), F.col("dst").alias("target"))


def has_call_graph(edges: DataFrame) -> bool:
    """Whether any call edge is stored; reads no more than it takes to find one."""
    return not edges.filter(F.col("type").isin(*CALLS)).limit(1).isEmpty()


def seed_files(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """File nodes of ``paths`` (column ``path``)."""
    return nodes.filter(F.col("label") == "File").join(paths.select("path").distinct(), "path", "left_semi")


def path_neighbours(nodes: DataFrame, edges: DataFrame, paths: DataFrame, incoming: bool) -> DataFrame:
    """Distinct files that depend on the seeds (``incoming``), or that the seeds depend on: path, rel, package_id, label."""
    near, far = ("dst", "src") if incoming else ("src", "dst")
    seeds = seed_files(nodes, paths).select(F.col("id").alias(near))
    types = DEPENDENT_TYPES if incoming else DEPENDENCY_TYPES
    sure = edges.filter(F.col("type").isin(*types) & (confidence() >= PATH_CONFIDENCE)).join(seeds, near, "left_semi")
    other = nodes.select(F.col("id").alias(far), F.coalesce("path", "id").alias("path"), F.coalesce("package_id", F.lit("")).alias("package_id"), F.coalesce("label", F.lit("")).alias("label"))
    return sure.join(other, far).select("path", F.col("type").alias("rel"), "package_id", "label").distinct()


def file_relations(nodes: DataFrame, edges: DataFrame, paths: DataFrame, k: int = 5) -> DataFrame:
    """Per seed file how many nodes point to it and from it, with the first ``k`` names in order.

    Distinct neighbours are counted; of their names only the first ``k`` are gathered.
    """
    seeds = seed_files(nodes, paths).select("id", "path")
    names = nodes.select(F.col("id").alias("n_id"), F.coalesce("path", "name", "id").alias("shown"))

    def side(near: str, far: str, name: str) -> DataFrame:
        pairs = edges.select(F.col(near).alias("s"), F.col(far).alias("n_id")).join(seeds.select(F.col("id").alias("s")), "s", "left_semi").distinct().join(names, "n_id")
        # Spark keeps the first names of each part of a file's neighbours before it shuffles them, so no task gathers them all
        first = pairs.select("s", "shown").distinct().withColumn("r", F.row_number().over(Window.partitionBy("s").orderBy("shown"))).filter(F.col("r") <= k)
        first = first.groupBy("s").agg(F.array_sort(F.collect_list("shown")).alias(f"{name}_examples"))
        return pairs.groupBy("s").agg(F.count(F.lit(1)).alias(f"{name}_count")).join(first, "s").withColumnRenamed("s", "id")

    out = seeds.join(side("dst", "src", "inbound"), "id", "left").join(side("src", "dst", "outbound"), "id", "left")
    none, zero = F.array().cast("array<string>"), F.lit(0).cast("long")
    return out.select("path", F.coalesce("inbound_count", zero).alias("inbound_count"), F.coalesce("inbound_examples", none).alias("inbound_examples"), F.coalesce("outbound_count", zero).alias("outbound_count"), F.coalesce("outbound_examples", none).alias("outbound_examples"))


def type_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts by label and by relationship type: family, name, n."""
    a = nodes.groupBy(F.coalesce("label", F.lit("Unknown")).alias("name")).agg(F.count(F.lit(1)).alias("n")).withColumn("family", F.lit("node"))
    b = edges.groupBy(F.col("type").alias("name")).agg(F.count(F.lit(1)).alias("n")).withColumn("family", F.lit("edge"))
    return a.unionByName(b).select("family", "name", "n")


def count_relationships(edges: DataFrame, types: tuple[str, ...] = ()) -> DataFrame:
    """How many edges are of the types; none given means CALLS."""
    return edges.filter(F.col("type").isin(*(types or ("CALLS",)))).agg(F.count(F.lit(1)).alias("n"))


def status(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """How many nodes and edges there are."""
    return nodes.agg(F.count(F.lit(1)).alias("nodes")).join(F.broadcast(edges.agg(F.count(F.lit(1)).alias("edges"))), how="inner")  # one row each
