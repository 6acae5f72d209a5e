"""Graph events: newline-delimited JSON to validated rows to node and edge tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The tag that every event carries.
PROTOCOL = "weftline/1"
EVENT = "protocol string, type string, label string, id string, rel string, `from` string, `to` string, source string, message string, props map<string,string>"
NODE_PROPS = {"name": "string", "kind": "string", "path": "string", "filePath": "string", "packageId": "string", "language": "string", "startLine": "bigint", "endLine": "bigint", "exported": "boolean", "scope": "string", "ownerId": "string", "signature": "string", "code": "string"}
EDGE_PROPS = {"sourceFile": "string", "startLine": "bigint", "endLine": "bigint", "confidence": "double", "reason": "string", "extractor": "string", "language": "string"}
NAME = r"^(?!.*__)[A-Za-z_]+$"


def parse(lines: DataFrame) -> DataFrame:
    """Rows of ``value`` to events with ``seq``-free columns; text that is no JSON object becomes a row of nulls."""
    more = [c for c in lines.columns if c != "value"]
    return lines.select(F.from_json("value", EVENT, {"mode": "PERMISSIVE"}).alias("e"), "value", *more).select("e.*", F.col("value").alias("raw"), *more)


def placed_lines(raw: DataFrame) -> DataFrame:
    """value and ``at``: the file and the block of the file. ``raw`` is what ``read.text`` or ``readStream.text`` gives."""
    return raw.select("value", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")).alias("at"))


def place() -> Column:
    """The order of placed lines: by file name, block, and a number that rises within the block.

    Spark reads files in an order of its own, larger ones first, so a row number alone is no order.
    """
    return F.struct("at.file", "at.block", F.monotonically_increasing_id().alias("row"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Events of a file or folder; ``seq`` is their order: by file name, then by line."""
    return parse(placed_lines(spark.read.text(path))).withColumn("seq", place()).drop("at")


def error(protocol: str = PROTOCOL) -> Column:
    """What is wrong with an event, or null."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    bad_name = lambda c: ~F.col(c).rlike(NAME)
    kind = F.col("type")
    return (
        F.when(F.coalesce("protocol", F.lit("")) != protocol, "unsupported protocol")
        .when((kind == "node") & (blank("label") | blank("id")), "node without label or id")
        .when((kind == "edge") & (blank("rel") | blank("from") | blank("to")), "edge without rel, from or to")
        .when((kind == "warning") & blank("message"), "warning without message")
        .when(~kind.isin("node", "edge", "warning", "summary") | kind.isNull(), "unknown type")
        .when((kind == "node") & bad_name("label"), "invalid label")
        .when((kind == "edge") & bad_name("rel"), "invalid relationship")
    )


def split_valid(events: DataFrame, protocol: str = PROTOCOL) -> tuple[DataFrame, DataFrame]:
    """Valid events, and the others with ``error``."""
    marked = events.withColumn("error", error(protocol))
    return marked.filter("error IS NULL").drop("error"), marked.filter("error IS NOT NULL")


def require_valid(events: DataFrame, protocol: str = PROTOCOL) -> DataFrame:
    """The events; a bad one fails the job when it is read."""
    e = error(protocol)
    return events.filter(F.when(e.isNotNull(), F.raise_error(F.concat(F.lit("bad event: "), e)).cast("boolean")).otherwise(True))


def discarded(events: DataFrame, protocol: str = PROTOCOL) -> dict[str, int]:
    """A sink that stores nothing: checks every event, fails on a bad one, and tells how many there are of each type."""
    return {r["type"]: r["count"] for r in require_valid(events, protocol).groupBy("type").count().collect()}  # at most four rows


def ordered(events: DataFrame) -> DataFrame:
    """The first of equal events, nodes before edges before warnings before summaries; ``rank`` and ``raw`` give the order."""
    key = F.when(F.col("type") == "node", F.concat_ws("|", F.lit("n"), "id")).when(F.col("type") == "edge", F.concat_ws("|", F.lit("e"), identity())).otherwise(F.col("raw"))
    once = events.withColumn("_k", key).withColumn("_r", F.row_number().over(Window.partitionBy("_k").orderBy("seq"))).filter("_r = 1").drop("_k", "_r")
    rank = F.when(F.col("type") == "node", 0).when(F.col("type") == "edge", 1).when(F.col("type") == "warning", 2).otherwise(3)
    return once.withColumn("rank", rank).orderBy("rank", "raw")


def identity() -> Column:
    """What tells parallel edges apart: ends, type and place."""
    prop = lambda k: F.coalesce(F.col("props")[k], F.lit(""))
    return F.concat_ws("\u0000", "rel", "from", "to", prop("sourceFile"), prop("startLine"), prop("endLine"), prop("reason"))


def scoped(namespace: Column, c: Column) -> Column:
    """An id inside its namespace; one that is already there stays."""
    prefix = F.concat(namespace, F.lit(":"))
    return F.when(c.startswith(prefix), c).otherwise(F.concat(prefix, c))


def unscoped(namespace: Column, c: Column) -> Column:
    """An id without its namespace."""
    prefix = F.concat(namespace, F.lit(":"))
    return F.when(c.startswith(prefix), F.substr(c, F.length(prefix) + 1)).otherwise(c)


def prefixed(kind: str, c: Column) -> Column:
    """``kind:id`` unless it has that form already."""
    return F.when(c.startswith(kind + ":") & (F.length(c) > len(kind) + 1), c).otherwise(F.concat(F.lit(kind + ":"), c))


def _last(kinds: dict[str, str]) -> list[Column]:
    """For each property the value of the last event that has it."""
    return [F.max_by(F.col("props")[k], F.when(F.col("props")[k].isNotNull(), F.col("seq"))).cast(t).alias(k) for k, t in kinds.items()]


def nodes_of(events: DataFrame, namespace: str) -> DataFrame:
    """One row a node id; each property as its last event set it. Two labels for one id fail the job."""
    ns = F.lit(namespace)
    rows = events.filter("type = 'node'").withColumn("gid", scoped(ns, F.col("id")))
    out = rows.groupBy("gid").agg(F.min("label").alias("label"), F.max("label").alias("_l"), F.max_by("id", "seq").alias("source_id"), F.max_by("source", "seq").alias("source"), *_last(NODE_PROPS), F.max("seq").alias("seq"))
    same = F.when(F.col("label") != F.col("_l"), F.raise_error(F.concat(F.lit("two labels for "), F.col("gid"))).cast("boolean")).otherwise(True)
    return out.filter(same).select(ns.alias("namespace"), F.col("gid").alias("id"), "source_id", "label", F.col("label").alias("primary_label"), "source", *NODE_PROPS, "seq")


def meta_of(events: DataFrame, namespace: str) -> DataFrame:
    """Warnings and summaries as nodes without a primary label; the id has the message, so none overwrites another."""
    ns = F.lit(namespace)
    rows = events.filter("type IN ('warning', 'summary')")
    gid = F.concat_ws(":", ns, F.lit("meta"), F.coalesce("source", F.lit("")), "type", F.md5(F.concat_ws("|", F.coalesce("message", F.lit("")), F.to_json("props"))))
    none = [F.lit(None).cast(t).alias(k) for k, t in NODE_PROPS.items() if k != "name"]
    return rows.select(ns.alias("namespace"), gid.alias("id"), gid.alias("source_id"), F.lit("Meta").alias("label"), F.lit(None).cast("string").alias("primary_label"), "source", F.col("message").alias("name"), *none, "seq").dropDuplicates(["id"]).select("namespace", "id", "source_id", "label", "primary_label", "source", *NODE_PROPS, "seq")


def edges_of(events: DataFrame, namespace: str) -> DataFrame:
    """One row for ends, type and identity; ends may still be missing (see ``attached``)."""
    ns = F.lit(namespace)
    rows = events.filter("type = 'edge'").withColumn("identity", identity()).withColumn("src", scoped(ns, F.col("from"))).withColumn("dst", scoped(ns, F.col("to")))
    rows = rows.groupBy("src", F.col("rel").alias("type"), "dst", "identity").agg(F.max_by("from", "seq").alias("source_from"), F.max_by("to", "seq").alias("source_to"), F.max_by("source", "seq").alias("source"), *_last(EDGE_PROPS), F.max("seq").alias("seq"))
    return rows.select(ns.alias("namespace"), "type", "src", "dst", "identity", "source_from", "source_to", "source", *EDGE_PROPS, "seq")


def attached(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends stored."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def marked(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """All edges, with ``attached``: whether both ends are stored."""
    ids = lambda name: nodes.select(F.col("id").alias(name), F.lit(True).alias(f"_{name}"))
    both = edges.join(ids("src"), "src", "left").join(ids("dst"), "dst", "left")
    return both.select(*edges.columns, (F.col("_src").isNotNull() & F.col("_dst").isNotNull()).alias("attached"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` over ``old``, property by property: a null leaves what was there."""
    cols = [c for c in old.columns if c not in keys]
    fresh = new.select(*(F.col(k) for k in keys), *(F.col(c).alias("_n_" + c) for c in cols))
    return old.join(fresh, keys, "full_outer").select(*keys, *(F.coalesce("_n_" + c, c).alias(c) for c in cols)).select(*old.columns)


def duplicates(nodes: DataFrame) -> DataFrame:
    """Ids that occur more than once: none in a sound store."""
    return nodes.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def union(frames: list[DataFrame]) -> DataFrame:
    """All frames by name."""
    return reduce(lambda a, b: a.unionByName(b), frames)
