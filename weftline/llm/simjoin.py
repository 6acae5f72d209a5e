"""From signatures to components of similar sets, with exact verification and without all pairs of a group.

Sets that share a signature key form a group. Each member is verified against the group's pivot (its smallest set key);
links are joined to components. Only members that are in another component than their pivot ("strays") can still lose a
link, so these are compared with all members of the pivot's groups, in blocks of bounded size that multiply incidence
matrices inside one task. Every pair that shares a key thus ends in one component, was compared, or is linked through
others; nothing is capped.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.components import components
from weftline.llm.scratch import dealt_anew, discard, holding, keep

BLOCK_ROWS, BLOCK_ITEMS, BLOCK_COLUMNS = 1024, 400_000, 4096
MEMBER, STRAY, BOTH = 0, 1, 2


def similar(a: Column, b: Column, percent: int) -> Column:
    """100 * intersection >= percent * union, for arrays of distinct items."""
    both = F.size(F.array_intersect(a, b))
    return 100 * both >= percent * (F.size(a) + F.size(b) - both)


def compare_block(block: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links between the strays and the members of one block, one for each pair of components. A row can be both."""
    out: dict[tuple[int, int], tuple[int, int]] = {}
    block = block.drop_duplicates(["cls", "role"])
    role = block["role"].to_numpy()
    ia, ib = np.flatnonzero(role != MEMBER), np.flatnonzero(role != STRAY)
    if len(ia) and len(ib):
        sets = [np.asarray(x, np.int64) for x in block["items"]]
        sizes = np.array([len(x) for x in sets])
        row = np.repeat(np.arange(len(sets)), sizes)
        _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = count[col] > 1  # an item of one set alone is in no intersection
        new = np.cumsum(count > 1) - 1
        row, col = row[shared], new[col[shared]]
        width = int(new[-1]) + 1 if len(new) else 0
        both = np.zeros((len(ia), len(ib)), np.float32)
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        for at in range(0, width, BLOCK_COLUMNS):
            lo, hi = np.searchsorted(col, (at, at + BLOCK_COLUMNS))
            dense = np.zeros((len(sets), min(BLOCK_COLUMNS, width - at)), np.float32)
            dense[row[lo:hi], col[lo:hi] - at] = 1
            both += dense[ia] @ dense[ib].T
        exact = np.int32 if sizes.max() < 1 << 23 else np.int64
        both, sizes = both.astype(exact), sizes.astype(exact)
        linked = 100 * both >= percent * (sizes[ia][:, None] + sizes[ib][None, :] - both)
        comp, cls = block["comp"].to_numpy(), block["cls"].to_numpy()
        linked &= comp[ia][:, None] != comp[ib][None, :]
        for i, j in zip(*np.nonzero(linked), strict=True):
            out.setdefault((comp[ia[i]], comp[ib[j]]), (cls[ia[i]], cls[ib[j]]))
    return pd.DataFrame(list(out.values()), columns=["a", "b"], dtype="int64")


def candidates(spark: SparkSession, keyed: DataFrame) -> DataFrame:
    """``cls``, ``n``, ``pivot`` and ``pn`` (the pivot's n): each set of a group of two sets or more, with its pivot.

    Keys are first counted, which Spark does in part before it shuffles; nearly all occur once and go no further. The rows
    of the others are fetched by a join that can be split where a key is hot.
    """
    each = keyed.filter("keys IS NOT NULL").select(F.explode("keys").alias("key"), "cls", "n")
    shared = keep(spark, each.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key"), "shared")
    rows = keep(spark, holding(each, shared, "key"), "shared-rows")
    pivots = rows.groupBy("key").agg(F.min(F.struct("cls", "n")).alias("p"), F.max("cls").alias("last")).filter("p.cls <> last")
    pivots = dealt_anew(pivots.select(F.col("key").alias("k"), F.col("p.cls").alias("pivot"), F.col("p.n").alias("pn")), "k")
    found = keep(spark, rows.join(pivots, F.col("key") == F.col("k")).select("cls", "n", "pivot", "pn").distinct(), "candidates")
    discard(shared, rows)
    return found


def _agree(n: Column, m: Column, percent: int) -> Column:
    """The most items in which linked sets of n and m items can differ."""
    return F.floor((n + m) * (100 - percent) / (100 + percent))


def _apart(a: Column, b: Column) -> Column:
    """In how many bits two sketches differ: at most in as many as the sets have items apart."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)


def possible_block(block: pd.DataFrame, percent: int) -> pd.DataFrame:
    """The strays and members of one block that by their sketches may link with one of another component."""
    role, n, comp = (block[c].to_numpy() for c in ("role", "n", "comp"))
    bits = np.unpackbits(np.stack([np.asarray(x, np.int64) for x in block["sketch"]]).view(np.uint8), axis=1).astype(np.float32) * 2 - 1
    ia, ib = np.flatnonzero(role != MEMBER), np.flatnonzero(role != STRAY)
    differ = (bits.shape[1] - bits[ia] @ bits[ib].T) / 2
    may = (differ <= (n[ia][:, None] + n[ib][None, :]) * (100 - percent) // (100 + percent)) & (comp[ia][:, None] != comp[ib][None, :])
    out = np.zeros((len(block), 2), bool)
    out[ia, 0], out[ib, 1] = may.any(axis=1), may.any(axis=0)
    some = out.any(axis=1)
    return pd.DataFrame({"pivot": block["pivot"].to_numpy()[some], "cls": block["cls"].to_numpy()[some], "as_stray": out[some, 0], "as_member": out[some, 1]})


def _dealt(spark: SparkSession, rows: DataFrame, weigh: bool) -> DataFrame:
    """``rows`` (pivot, cls, n, comp, role, ...) in blocks of bounded size with i and j; groups without a stray go."""
    stray, member = (F.col("role") != MEMBER).cast("long"), (F.col("role") != STRAY).cast("long")
    groups = rows.groupBy(F.col("pivot").alias("g")).agg(F.sum(member).alias("k"), F.sum(member * F.col("n")).alias("w"), F.sum(stray).alias("ks"), F.sum(stray * F.col("n")).alias("ws")).filter("ks > 0 AND k > 0")
    blocks = lambda k, w: F.greatest(F.ceil(F.col(k) / BLOCK_ROWS), F.ceil(F.col(w) / BLOCK_ITEMS) if weigh else F.lit(1).cast("long")).cast("int")
    groups = keep(spark, groups.select("g", blocks("k", "w").alias("nm"), blocks("ks", "ws").alias("ns")), "open")
    todo = rows.join(groups, F.col("pivot") == F.col("g")).drop("g").withColumn("h", F.abs(F.hash("cls").cast("long")))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    whole = (F.col("nm") == 1) & (F.col("ns") == 1)  # a group that is one block has each set once
    i, j = (F.col("h") % F.col("ns")).cast("int"), (F.col("h") % F.col("nm")).cast("int")
    parts = [
        todo.filter(whole).withColumn("i", F.lit(0)).withColumn("j", F.lit(0)),
        todo.filter(~whole & (F.col("role") != MEMBER)).withColumn("role", F.lit(STRAY)).withColumn("i", i).withColumn("j", upto("nm")),
        todo.filter(~whole & (F.col("role") != STRAY)).withColumn("role", F.lit(MEMBER)).withColumn("i", upto("ns")).withColumn("j", j),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).drop("h", "nm", "ns")


def similar_components(spark: SparkSession, keyed: DataFrame, fetch: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """``node`` and ``component`` of the sets that link with a smaller one.

    ``keyed`` is a written table of ``cls`` (the set's key), ``n`` (its size) and ``keys`` (an array; null where the same
    set has its keys in another row); ``fetch`` gives ``cls`` and ``items`` of the wanted ``cls``. A column ``sketch`` (the
    parities of the items' numbers in so many buckets, as longs) spares the items of sets that differ too much: no two
    linked sets differ in more bits than items.
    """
    cand, sketched = candidates(spark, keyed), "sketch" in keyed.columns
    near = 100 * F.least("n", "pn") >= percent * F.greatest("n", "pn")  # sizes alone tell that the others can't link
    if sketched:
        sketch = keyed.filter("keys IS NOT NULL").select("cls", "sketch").dropDuplicates(["cls"])
        own, other = sketch.select(F.col("cls").alias("c"), "sketch"), sketch.select(F.col("cls").alias("p"), F.col("sketch").alias("pivots"))
        both = cand.join(own, F.col("cls") == F.col("c")).join(other, F.col("pivot") == F.col("p"))
        old, cand = cand, keep(spark, both.select("cls", "n", "pivot", "pn", "sketch", (near & (_apart(F.col("sketch"), F.col("pivots")) <= _agree(F.col("n"), F.col("pn"), percent))).alias("near")), "sketched")
        discard(old)
        near = F.col("near")
    pairs = cand.filter((F.col("cls") != F.col("pivot")) & near).select("cls", "pivot")
    named = lambda sets: (sets.select("cls", F.col("items").alias("x")), sets.select(F.col("cls").alias("pivot"), F.col("items").alias("y")))
    sets = keep(spark, fetch(pairs.select("cls").unionByName(pairs.select(F.col("pivot").alias("cls"))).distinct()).select("cls", "items"), "sets")
    a, b = named(sets)
    links = keep(spark, pairs.join(a, "cls").join(b, "pivot").filter(similar(F.col("x"), F.col("y"), percent)).select(F.col("cls").alias("a"), F.col("pivot").alias("b")), "links")
    comps = components(spark, links)
    of = lambda c, name: comps.select(F.col("node").alias(c), F.col("component").alias(name))
    rows = cand.join(of("cls", "_c"), "cls", "left").join(of("pivot", "_p"), "pivot", "left")
    stray = F.coalesce("_c", "cls") != F.coalesce("_p", "pivot")
    more = ["sketch"] if sketched else []
    members = keep(spark, rows.select("pivot", "cls", "n", F.coalesce("_c", "cls").alias("comp"), F.when(stray, BOTH).otherwise(MEMBER).alias("role"), *more), "members")
    # pairs of a pivot and one other are verified already
    open_ = members.groupBy(F.col("pivot").alias("o")).agg(F.count(F.lit(1)).alias("k"), F.max("role").alias("most")).filter(f"k > 2 AND most = {BOTH}").select("o")
    rows = members.join(open_, F.col("pivot") == F.col("o"), "left_semi")
    if sketched:
        open_rows = keep(spark, rows, "open-members")  # read several times, so the join is not repeated
        discard(members)
        block = _dealt(spark, open_rows, False).groupBy("pivot", "i", "j")
        may = block.applyInPandas(lambda pdf: possible_block(pdf, percent), "pivot long, cls long, as_stray boolean, as_member boolean")
        may = may.groupBy("pivot", "cls").agg(F.max("as_stray").alias("as_stray"), F.max("as_member").alias("as_member"))
        role = F.when(F.col("as_stray") & F.col("as_member"), BOTH).when(F.col("as_stray"), STRAY).otherwise(MEMBER)
        rows = open_rows.drop("role", "sketch").join(may.withColumn("role", role).drop("as_stray", "as_member"), ["pivot", "cls"])
    rows = keep(spark, rows, "may-link")
    discard(open_rows if sketched else members)
    if rows.isEmpty():
        discard(cand, sets, links, rows)
        return comps
    items = keep(spark, fetch(rows.select("cls").distinct()).select("cls", "items"), "more-sets")
    block = _dealt(spark, rows, True).join(items, "cls").groupBy("pivot", "i", "j")
    found = keep(spark, block.applyInPandas(lambda pdf: compare_block(pdf, percent), "a long, b long"), "more-links")
    out = components(spark, links.unionByName(found))
    discard(cand, sets, items, links, rows, found)
    return out
