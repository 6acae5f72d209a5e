"""Bounded traversal: trails, and one shortest path.

Trails are unrolled equi-joins (the depth is at most 8 and known when planned), and filters on confidence and direction are
in every level. A level is written before the next is made: Spark knows the size of a written table and sends a small one to
the edges, so edges are neither shuffled nor told apart but for those that leave the level. A large one is a plain shuffle.
No edge occurs twice in a trail; nodes may.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.graph import MIN_CONFIDENCE, confidence
from weftline.sources.shared import Kept, written

MAX_DEPTH, MAX_LIMIT = 8, 200
#: Synonyms of the directions.
DIRECTIONS = {"out": "forward", "outbound": "forward", "inbound": "reverse", "outgoing": "forward", "downstream": "forward", "forward": "forward", "in": "reverse", "incoming": "reverse", "upstream": "reverse", "reverse": "reverse", "both": "both", "": "both"}


def options(depth: int = 1, limit: int = 20, min_confidence: float = 0.0, direction: str = "both") -> dict:
    """Options within their bounds: depth 1 to 8, limit 1 to 200, confidence 0.6 where none is given."""
    return {"depth": min(max(depth, 1), MAX_DEPTH), "limit": min(limit, MAX_LIMIT) if limit > 0 else 20, "min_confidence": min_confidence if min_confidence > 0 else MIN_CONFIDENCE, "direction": DIRECTIONS.get(direction.lower(), "both")}


def edge_id() -> Column:
    """What identifies an edge among parallel ones."""
    return F.concat_ws("|", "type", "src", "dst", F.coalesce("source_file", F.lit("")), F.coalesce(F.col("start_line").cast("string"), F.lit("")))


def steps(edges: DataFrame, direction: str, min_confidence: float) -> DataFrame:
    """at, to, e: every allowed move along an edge, as often as the edge is there."""
    sure = edges.filter(confidence() >= min_confidence).withColumn("e", edge_id()).select("src", "dst", "e")
    forward = sure.select(F.col("src").alias("at"), F.col("dst").alias("to"), "e")
    reverse = sure.select(F.col("dst").alias("at"), F.col("src").alias("to"), "e")
    return forward if direction == "forward" else reverse if direction == "reverse" else forward.unionByName(reverse.filter("at <> to"))


def _begun(starts: DataFrame) -> DataFrame:
    """The trails without an edge."""
    return starts.select(F.col("id").alias("start"), F.col("id").alias("here"), F.array("id").alias("nodes"), F.array().cast("array<string>").alias("edges"))


def _leaving(moves: DataFrame, level: DataFrame) -> DataFrame:
    """The moves from where a written level is."""
    return moves.join(level.select(F.col("here").alias("at")), "at", "left_semi")


def _onward(level: DataFrame, moves: DataFrame) -> DataFrame:
    """The trails of a written level with one edge more; an edge that is there twice counts once."""
    wide = level.join(_leaving(moves, level).distinct(), F.col("here") == F.col("at")).filter(~F.array_contains("edges", F.col("e")))
    return wide.select("start", F.col("to").alias("here"), F.concat("nodes", F.array("to")).alias("nodes"), F.concat("edges", F.array("e")).alias("edges"))


def trails(edges: DataFrame, starts: DataFrame, depth: int = 1, direction: str = "both", min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """start, depth, nodes, edges: every trail of 1 to ``depth`` edges from the ids in ``starts``."""
    moves = steps(edges, direction, min_confidence)
    level, out = written(_begun(starts)), None
    for d in range(1, depth + 1):
        level = _onward(level, moves)
        if d < depth:
            level = written(level)
        found = level.select("start", F.lit(d).alias("depth"), "nodes", "edges")
        out = found if out is None else out.unionByName(found)
    return out


def relations(edges: DataFrame, starts: DataFrame, **opts: object) -> DataFrame:
    """The first trails in the order of depth and edges, one more than the limit.

    Depth leads the order, so a level is only made while all levels before it are under the limit. A level that is under
    the limit is whole and small; it is the next level's front, so no level is made from more than ``limit`` trails.
    """
    o, spark, out = options(**opts), edges.sparkSession, []
    schema = "start string, here string, nodes array<string>, edges array<string>"
    moves = steps(edges, o["direction"], o["min_confidence"])
    with Kept() as keep:
        front = _begun(starts)
        for d in range(1, o["depth"] + 1):
            room = o["limit"] + 1 - len(out)
            rows = _onward(keep(front), moves).orderBy("edges", "start").limit(room).collect()  # at most the limit and one
            out += [(r["start"], d, r["nodes"], r["edges"]) for r in rows]
            if not rows or len(rows) == room:
                break
            front = spark.createDataFrame(rows, schema)
    return spark.createDataFrame(out, "start string, depth int, nodes array<string>, edges array<string>")


class Meeting:
    """The levels of a search from both ends: sets of nodes by their distance from the source and from the target."""

    def __init__(self, moves: DataFrame, source: str, target: str, keep: Kept) -> None:
        spark = moves.sparkSession
        one = lambda x: keep(spark.createDataFrame([(x,)], "here string"))
        self.moves, self.sides, self.sizes, self.expanded, self.keep = moves, ([one(source)], [one(target)]), [1, 1], 0, keep

    def grow(self) -> bool:
        """One more level on the side whose last level is smaller; false if there is none."""
        k = 0 if self.sizes[0] <= self.sizes[1] else 1
        levels = self.sides[k]
        # a neighbour of a level is in the level before it, in it, or new
        near = levels[-1] if len(levels) < 2 else levels[-1].unionByName(levels[-2])
        wide = _leaving(self.moves, levels[-1]).select(F.col("to").alias("here")).distinct()
        levels.append(self.keep(wide.join(near, "here", "left_anti")))
        self.sizes[k] = levels[-1].count()
        self.expanded += self.sizes[k]
        return self.sizes[k] > 0

    def met(self) -> DataFrame:
        """Nodes in the last levels of both sides: as far from one end as was searched, and from the other."""
        return self.sides[0][-1].join(self.sides[1][-1], "here", "left_semi")

    def layers(self) -> list[DataFrame]:
        """For each distance from the source the nodes that lie on a shortest path."""
        middle, (there, back) = self.keep(self.met()), self.sides
        beside = lambda level, layer: self.keep(level.join(_leaving(self.moves, layer).select(F.col("to").alias("here")), "here", "left_semi"))
        out = [middle]
        for level in reversed(there[:-1]):
            out.insert(0, beside(level, out[0]))
        for level in reversed(back[:-1]):
            out.append(beside(level, out[-1]))
        return out


def shortest_path(spark: SparkSession, edges: DataFrame, source: str, target: str, depth: int = 4, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """nodes and edges of one undirected shortest path of at most ``depth`` edges, that with the smallest edges in their
    order; no row if there is none. Equal ends give no path."""
    return search_path(spark, edges, source, target, depth, min_confidence)[0]


def search_path(spark: SparkSession, edges: DataFrame, source: str, target: str, depth: int = 4, min_confidence: float = MIN_CONFIDENCE) -> tuple[DataFrame, int]:
    """``shortest_path``, and how many nodes were reached on the way.

    Breadth first from both ends, by levels of nodes alone; the side with the smaller level grows, until the levels meet or
    their distances add up to ``depth``. The path is then put together along the nodes of shortest paths only.
    """
    schema, found, expanded = "nodes array<string>, edges array<string>", [], 0
    with Kept() as keep:
        if source != target:
            moves = steps(edges, "both", min_confidence)
            m = Meeting(moves, source, target, keep)
            for _ in range(min(max(depth, 1), MAX_DEPTH)):
                if not m.grow():
                    break
                if m.met().isEmpty():
                    continue
                paths = spark.createDataFrame([(source, [source], [])], "here string, nodes array<string>, edges array<string>")
                for layer in m.layers()[1:]:
                    paths = keep(paths)  # a row for each node of a layer
                    wide = paths.join(_leaving(moves, paths).join(layer.select(F.col("here").alias("to")), "to", "left_semi"), F.col("here") == F.col("at"))
                    best = F.min(F.struct(F.concat("edges", F.array("e")).alias("edges"), F.concat("nodes", F.array("to")).alias("nodes"))).alias("b")
                    paths = wide.groupBy("to").agg(best).select(F.col("to").alias("here"), "b.nodes", "b.edges")
                found = paths.select("nodes", "edges").collect()  # the target's row
                break
            expanded = m.expanded
    return spark.createDataFrame(found, schema), expanded
