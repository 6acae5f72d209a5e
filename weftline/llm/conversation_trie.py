"""Prefix trie of conversations: mergeable partial tries, then a bottom-up rollup.

A node stands for the first d turns of its members. Its key is the exclusive or of 128-bit hashes of (position, role, text),
so the key of the parent, and the keys along a conversation of any length, follow from running values. Conversations are
dealt by ranges; each range makes its own trie (a table of nodes with members, smallest member and those that end there,
and the lists of the latter as runs), and hash-keyed merges of ``FAN`` tries at a time sum them up until one is left.

Rollup: nodes with the same smallest member make one path downwards, so the trie is a tree of paths, each hanging on a node
of another. Totals go up that tree by doubling (as many rounds as the logarithm of its depth) and then along each path as
running sums. Nothing depends on the depth of the trie, and no conversation, node or list of ends has to fit a task: lists
are runs of one range each, and their digest reads the runs one after the other.

Defined results: a null conversation id is no conversation, its rows are left out. A null role or text is empty. Turns that
share a number are ordered by role, then by the first 64 characters of the text, then by digest; repeated rows are turns of
their own. An empty table has no nodes. Nodes are told apart by 128 bits. Only the four columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.scan import ranged, running
from weftline.llm.scratch import dealt_anew, keep

WORD = r"[^\x20\x09-\x0D]+"
FAN = 32
ROOT = 0
#: Conversations of one family share the turns of its first id.
FAMILY, MOST_SHARED = 20, 3


def ordered(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, pos (from 1), the hashes h1 and h2 of role and text, and words, of every turn; texts go no further."""
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = turns.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("_turn"), F.substring(role, 1, 64).alias("_role"), F.substring(text, 1, 64).alias("_text"), F.md5(F.concat_ws("\u0000", role, text)).alias("_md5"),
        F.xxhash64(F.lit(1), F.length(role), role, text).alias("h1"), F.xxhash64(F.lit(2), F.length(role), role, text).alias("h2"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    ).withColumn("_any", F.monotonically_increasing_id())
    by = [F.col("_turn").asc_nulls_first(), F.col("_role"), F.col("_text"), F.col("_md5"), F.col("_any")]
    out = running(slim, "conv", by, {"pos": ("sum", F.lit(1).cast("long"))})
    return keep(turns.sparkSession, out.select("conv", "pos", "h1", "h2", "words"), "turns")


def whole(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paths and lengths of conversations as they are: (conv, depth, h1, h2, words, last) and (conv, length)."""
    lengths = keep(turns.sparkSession, turns.groupBy("conv").agg(F.max("pos").alias("length")), "lengths")
    paths = turns.join(dealt_anew(lengths, "conv").withColumnRenamed("conv", "_c"), F.col("conv") == F.col("_c"))
    return paths.select("conv", F.col("pos").alias("depth"), "h1", "h2", "words", (F.col("pos") == F.col("length")).alias("last")), lengths


def shared(conv: Column) -> Column:
    """How many turns a conversation takes from the first of its family: the CRC of its decimal id, modulo 4."""
    return F.crc32(conv.cast("string")) % (MOST_SHARED + 1)


def branched(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``whole``, of rebuilt conversations: the first ``shared`` turns are those of the first id of the family (all if it
    has fewer, none if it isn't there), then come the conversation's own turns after as many."""
    own = turns.groupBy("conv").agg(F.max("pos").alias("n")).withColumn("h", shared(F.col("conv"))).withColumn("host", F.col("conv") - F.col("conv") % FAMILY)
    own = keep(turns.sparkSession, own, "conversations")
    sizes = own.select(F.col("conv").alias("_host"), F.least(F.col("n"), F.lit(MOST_SHARED)).alias("there"))
    convs = own.join(sizes, F.col("host") == F.col("_host"), "left").withColumn("m", F.least(F.col("h"), F.coalesce("there", F.lit(0))))
    convs = keep(turns.sparkSession, convs.select("conv", "host", "n", "h", "m"), "rebuilt")
    side = convs.select(F.col("conv").alias("_c"), "n", "h", "m")
    kept = turns.join(side, F.col("conv") == F.col("_c")).filter("pos > h")
    kept = kept.select("conv", (F.col("pos") - F.col("h") + F.col("m")).alias("depth"), "h1", "h2", "words", (F.col("pos") == F.col("n")).alias("last"))
    heads = turns.filter(F.col("pos") <= MOST_SHARED).withColumnRenamed("conv", "_c")
    taken = heads.join(convs, F.col("_c") == F.col("host")).filter("pos <= h")  # at most FAMILY conversations a host
    taken = taken.select("conv", F.col("pos").alias("depth"), "h1", "h2", "words", ((F.col("n") <= F.col("h")) & (F.col("pos") == F.col("m"))).alias("last"))
    return kept.unionByName(taken), convs.select("conv", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))


def _merged(nodes: DataFrame, group: Column) -> DataFrame:
    """One node of each key within each group of partial tries."""
    same = ("depth", "words", "q1", "q2")
    return nodes.groupBy("p1", "p2", group.cast("int").alias("part")).agg(F.sum("n").alias("n"), F.min("conv").alias("conv"), F.sum("ends").alias("ends"), *(F.any_value(c).alias(c) for c in same))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each key's runs, which come in order; what is open at the end of a batch goes on in the next."""
    open_key, digest = None, hashlib.sha256()
    for batch in batches:
        done: list[tuple[int, int, str]] = []
        for key, run in zip(zip(batch.column("p1").to_pylist(), batch.column("p2").to_pylist(), strict=True), batch.column("run").to_pylist(), strict=True):
            if key == open_key:
                digest.update(b",")
            else:
                if open_key is not None:
                    done.append((*open_key, digest.hexdigest()))
                open_key, digest = key, hashlib.sha256()
            digest.update(run.encode())
        yield _rows(done)
    if open_key is not None:
        yield _rows([(*open_key, digest.hexdigest())])


def _rows(done: list[tuple[int, int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.string())], names=["p1", "p2", "ends_sha256"])


def _run(rows: DataFrame, *key: str) -> DataFrame:
    """The ascending ids of each key within each range, as text: at most a range's conversations."""
    return rows.groupBy(*key, "_part").agg(F.array_join(F.array_sort(F.collect_list("conv")).cast("array<string>"), ",").alias("run"))


def partial_tries(paths: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of the merged trie (p1, p2, q1 and q2 of the parent, depth, n, conv, ends, words), and p1, p2, ends_sha256 of
    those at which conversations end."""
    spark = paths.sparkSession
    k = {"p1": ("xor", F.xxhash64(F.lit(1), "depth", "h1", "h2")), "p2": ("xor", F.xxhash64(F.lit(2), "depth", "h1", "h2"))}
    rows = running(paths, "conv", [F.col("depth")], k)
    rows = rows.withColumn("q1", F.col("p1").bitwiseXOR(k["p1"][1])).withColumn("q2", F.col("p2").bitwiseXOR(k["p2"][1]))
    rows = keep(spark, rows.select("_part", "conv", "depth", "words", "p1", "p2", "q1", "q2", "last"), "keys")
    nodes = rows.select("_part", "conv", "depth", "words", "p1", "p2", "q1", "q2", F.lit(1).cast("long").alias("n"), F.col("last").cast("long").alias("ends"))
    parts = (rows.agg(F.max("_part")).first()[0] or 0) // FAN
    nodes = _merged(nodes, F.floor(F.col("_part") / FAN))
    while parts:
        nodes = _merged(keep(spark, nodes, "tries"), F.floor(F.col("part") / FAN))
        parts //= FAN
    empty = lengths.filter("length = 0").select("conv")
    top = lengths.agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("conv"), F.coalesce(F.sum((F.col("length") == 0).cast("long")), F.lit(0)).alias("ends")).filter("n > 0")
    zero = F.lit(ROOT).cast("long")
    top = top.select(zero.alias("p1"), zero.alias("p2"), zero.alias("depth"), "n", "conv", "ends", zero.alias("words"), F.lit(None).cast("long").alias("q1"), F.lit(None).cast("long").alias("q2"))
    nodes = keep(spark, nodes.drop("part").unionByName(top), "trie")
    runs = _run(rows.filter("last"), "p1", "p2").unionByName(_run(ranged(empty, F.col("conv")).select(zero.alias("p1"), zero.alias("p2"), "conv", "_part"), "p1", "p2"))
    runs = runs.repartition("p1", "p2").sortWithinPartitions("p1", "p2", "_part")
    return nodes, runs.select("p1", "p2", "run").mapInArrow(_digests, "p1 long, p2 long, ends_sha256 string")


def _totals(segments: DataFrame) -> DataFrame:
    """conv, saved and leaves of each path with all that hangs on it: sums over descendants of the tree given by ``anc``,
    those up to twice as far in each round."""
    spark = segments.sparkSession
    state = keep(spark, segments.select("conv", "anc", "saved", "leaves"), "totals")
    while not state.filter("anc IS NOT NULL").isEmpty():
        far = state.filter("anc IS NOT NULL")
        add = far.groupBy(F.col("anc").alias("_a")).agg(F.sum("saved").alias("_s"), F.sum("leaves").alias("_l"))
        up = far.select(F.col("conv").alias("_u"), F.col("anc").alias("_up"))
        new = state.join(dealt_anew(add, "_a"), F.col("conv") == F.col("_a"), "left").join(up, F.col("anc") == F.col("_u"), "left")
        state = keep(spark, new.select("conv", F.col("_up").alias("anc"), (F.col("saved") + F.coalesce("_s", F.lit(0))).alias("saved"), (F.col("leaves") + F.coalesce("_l", F.lit(0))).alias("leaves")), "totals")
    return state.select("conv", F.col("saved").alias("all_saved"), F.col("leaves").alias("all_leaves"))


def trie(paths: DataFrame, lengths: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node."""
    spark = paths.sparkSession
    nodes, digests = partial_tries(paths, lengths)
    gain = (F.col("n") - 1) * F.col("words")
    segments = nodes.groupBy("conv").agg(F.min("depth").alias("first"), F.max("depth").alias("last"), F.sum(gain).alias("saved"), F.min_by(F.struct("q1", "q2"), "depth").alias("q"))
    # a path hangs on a node that has other members too
    on = nodes.filter("n > 1").select("p1", "p2", F.col("conv").alias("anc"))
    segments = segments.join(on, (F.col("q.q1") == F.col("p1")) & (F.col("q.q2") == F.col("p2")), "left").select("conv", "first", "last", "saved", "anc")
    segments = keep(spark, segments, "paths")
    hung = segments.filter("anc IS NOT NULL").groupBy("anc", (F.col("first") - 1).alias("at")).agg(F.count(F.lit(1)).alias("kids"))
    at_end = segments.join(hung.select(F.col("anc").alias("_a"), "at"), (F.col("conv") == F.col("_a")) & (F.col("last") == F.col("at")), "left")
    segments = keep(spark, at_end.withColumn("leaves", F.col("at").isNull().cast("long")).drop("_a", "at"), "paths")
    totals = _totals(segments)
    tops = segments.filter("anc IS NOT NULL").join(totals.withColumnRenamed("conv", "_c"), F.col("conv") == F.col("_c"))
    hung = tops.groupBy(F.col("anc").alias("_a"), (F.col("first") - 1).alias("at")).agg(F.count(F.lit(1)).alias("kids"), F.sum("all_saved").alias("under"), F.sum("all_leaves").alias("tips"))
    none = F.lit(0).cast("long")
    many = nodes.filter("n > 1").join(dealt_anew(hung, "_a"), (F.col("conv") == F.col("_a")) & (F.col("depth") == F.col("at")), "left").drop("_a", "at").fillna(0, ["kids", "under", "tips"])
    many = running(many, "conv", [F.desc("depth")], {"saved_tokens": ("sum", gain + F.col("under")), "below": ("sum", F.col("tips"))}).drop("_part", "under", "tips")
    one = nodes.filter("n = 1").select("*", none.alias("kids"), none.alias("saved_tokens"), none.alias("below"))
    side = segments.select(F.col("conv").alias("_c"), "first", F.col("last"), "anc", "leaves")
    found = many.unionByName(one).join(side, F.col("conv") == F.col("_c"))
    ends = digests.select(F.col("p1").alias("_p1"), F.col("p2").alias("_p2"), "ends_sha256")
    found = found.join(ends, (F.col("p1") == F.col("_p1")) & (F.col("p2") == F.col("_p2")), "left")
    return found.select(
        F.col("conv").alias("conv_id"), "depth", F.when(F.col("depth") > F.col("first"), F.col("conv")).otherwise(F.col("anc")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        (F.col("kids") + (F.col("depth") < F.col("last")).cast("long")).alias("n_children"), (F.col("below") + F.col("leaves")).alias("n_leaves"), "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
