"""Mixing sources to target weights by entropy balancing.

Document rates minimise the entropy relative to one pass over every document, weighted by ``gauge`` = the square root of
its size (half way between counting documents and counting words), under one token constraint a source and an upper bound
on the rate. The solution tilts documents exponentially: rate = min(bound, exp(lambda of the source * gauge)). Newton steps
on the convex dual find lambda for all sources at once: each step is one aggregate over documents, which gives every source
the sum of size * rate and its derivative, and one table of the new lambdas. A bracket is kept beside each lambda and halved
where a step would leave it. Documents of a source that have the same size have the same rate, so steps run over counts by
source and size.

Rates are rounded into whole copies: floor(rate) for every document, and one more for those whose hash, divided by the
fraction that is left, is under a threshold of their source, which three histograms of 4096 bins a source find. A document
that would overshoot the target is left out; what is then missing is filled in ``FILLS`` rounds with the next documents in
that order that fit, ``NEXT`` a round, and at last with those whose size is nearest to it.

Defined results: a null or empty text has size 0 and is never taken. A null source is a source of its own, last in order.
Repeated rows
(same id, source and text) are numbered and have hashes of their own, so each is dealt copies like any other row; which of
them gets more makes no difference. An empty table gives an empty
result. Only the id, text and source columns are read, and those to carry. Reruns agree, as nothing depends on partitions
or time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from weftline.llm.scan import running
from weftline.llm.scratch import apart, discard, keep

WORD = r"[^\x20\x09-\x0D]+"
BITS, LEVELS = 12, 3
#: Scores are held in BITS * LEVELS bits; a score of 1 is this number, greater ones reach up to 4.
ONE = 1 << (BITS * LEVELS - 2)
STEPS, FILLS, NEXT, TOLERANCE = 60, 4, 64, 1e-6


def ranked_sources(spark: SparkSession, totals: DataFrame) -> DataFrame:
    """Adds ``rank`` from 0 in code-point order, null last; a range sort, so no task gets all sources."""
    ordered = totals.orderBy(F.col("source").asc_nulls_last())
    schema = T.StructType([*totals.schema.fields, T.StructField("rank", T.LongType())])
    return spark.createDataFrame(ordered.rdd.zipWithIndex().map(lambda x: (*x[0], x[1])), schema)


def capped_targets(sources: DataFrame, total: int, most: float) -> DataFrame:
    """Adds ``target``: the total shared by weight, held at ``most`` times a source's size, the excess shared again.

    Each round is one aggregate over the table of sources; a source once held stays held, so it ends.
    """
    level = None
    while True:
        held = F.lit(False) if level is None else F.col("weight") * F.lit(level) >= most * F.col("source_size")
        row = sources.agg(F.sum(F.when(held, most * F.col("source_size")).otherwise(0.0)), F.sum(F.when(held, 0.0).otherwise(F.col("weight").cast("double")))).first()
        fixed, free = row[0] or 0.0, row[1] or 0.0
        new = level if free <= 0 else (total - fixed) / free
        if new is None or (level is not None and new <= level):
            break
        level = new
    share = F.col("weight") * F.lit(float(level or 0.0))
    return sources.withColumn("target", F.least(share, most * F.col("source_size").cast("double")))


def gauge(size: Column) -> Column:
    """The weight of a document's entropy, and so the exponent's factor."""
    return F.sqrt(size.cast("double"))


def newton_rates(spark: SparkSession, sources: DataFrame, counts: DataFrame, most: float) -> DataFrame:
    """Adds ``lam`` to the sources. ``counts`` has source, size and docs (how many); sources without a solution below the
    bound, whose target is the bound itself, get the greatest lambda."""
    top = 60.0  # exp of it is beyond any bound
    state = sources.withColumn("lam", F.lit(0.0)).withColumn("lo", F.lit(-top)).withColumn("hi", F.lit(top)).withColumn("open", F.col("target") < most * F.col("source_size"))
    state = keep(spark, state.withColumn("lam", F.when(F.col("open"), 0.0).otherwise(top)), "lambda0")
    for step in range(1, STEPS + 1):
        now = state.filter("open").select(F.col("source").alias("s"), "lam")
        tilt = F.exp(F.least(F.col("lam") * gauge(F.col("size")), F.lit(top)))
        each = counts.join(now, F.col("source").eqNullSafe(F.col("s"))).withColumn("tilt", tilt)
        sums = each.groupBy("s").agg(
            F.sum(F.col("docs") * F.col("size") * F.least(F.lit(float(most)), F.col("tilt"))).alias("tokens"),
            F.sum(F.when(F.col("tilt") < most, F.col("docs") * F.col("size") * gauge(F.col("size")) * F.col("tilt")).otherwise(0.0)).alias("slope"),
        )
        new = state.join(sums, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        gap = F.col("tokens") - F.col("target")
        new = new.withColumn("lo", F.when(gap < 0, F.col("lam")).otherwise(F.col("lo"))).withColumn("hi", F.when(gap > 0, F.col("lam")).otherwise(F.col("hi")))
        newton = F.when(F.col("slope") > 0, F.col("lam") - gap / F.col("slope"))
        inside = (newton > F.col("lo")) & (newton < F.col("hi"))
        still = F.coalesce(F.abs(gap) > F.greatest(F.lit(0.5), TOLERANCE * F.col("target")), F.lit(False))
        moved = F.when(F.col("open") & still, F.when(inside, newton).otherwise((F.col("lo") + F.col("hi")) / 2)).otherwise(F.col("lam"))
        old, state = state, keep(spark, new.withColumn("lam", moved).withColumn("open", F.col("open") & still).drop("tokens", "slope"), f"lambda{step}")
        discard(old)
        if state.filter("open").isEmpty():
            break
    return state.drop("lo", "hi", "open")


def rate_of(size: Column, lam: Column, most: float) -> Column:
    """A document's rate, rounded so that equal rates are equal numbers."""
    return F.when(size > 0, F.round(F.least(F.lit(float(most)), F.exp(F.least(lam * gauge(size), F.lit(60.0)))), 9)).otherwise(0.0)


def numbered(sized: DataFrame) -> DataFrame:
    """``sized`` (a written table) with hashes ``h`` that no two rows share: those of rows that repeat one are made anew from
    it and the row's number among them. Other rows aren't shuffled; one row may be repeated any number of times."""
    spark = sized.sparkSession
    again = keep(spark, sized.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("h"), "repeated")
    if again.isEmpty():
        return sized
    rest, some = apart(sized, again, "h")
    some = running(some.withColumn("_any", F.monotonically_increasing_id()), "h", [F.col("_any")], {"_number": ("sum", F.lit(1).cast("long"))})
    some = some.withColumn("h", F.when(F.col("_number") > 1, F.xxhash64("h", "_number")).otherwise(F.col("h")))
    return keep(spark, rest.unionByName(some.select(*sized.columns)), "numbered")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, carry: tuple[str, ...] = ()) -> DataFrame:
    """Id, source, size, source_size, target, rate, copies and taken of every row, and the columns to carry."""
    spark = docs.sparkSession
    source = F.col(source_col).cast("string")
    sized = numbered(keep(spark, docs.select(
        F.col(id_col).alias("id"), source.alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.col(id_col), source, F.xxhash64(F.col(text_col))).alias("h"), *(F.col(c) for c in carry),
    ), "sizes"))
    counts = keep(spark, sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("docs")), "size-counts")
    totals = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"))
    sources = ranked_sources(spark, totals)
    picks = F.array(*(F.lit(w) for w in weights))
    sources = keep(spark, sources.withColumn("weight", F.element_at(picks, (F.col("rank") % len(weights) + 1).cast("int"))), "sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    sources = newton_rates(spark, capped_targets(sources, total, most), counts, most)
    of = lambda df, *cols: df.select(F.col("source").alias("s"), *cols)
    lam = of(sources, "lam")
    rated = counts.join(lam, F.col("source").eqNullSafe(F.col("s"))).groupBy("s").agg(F.sum(F.floor(rate_of(F.col("size"), F.col("lam"), most)) * F.col("size") * F.col("docs")).alias("sure"))
    found = sources.join(rated, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    found = keep(spark, found.withColumn("need", F.greatest(F.lit(0.0), F.col("target") - F.coalesce("sure", F.lit(0)))).withColumn("prefix", F.lit(0).cast("long")), "rates")

    def scored(side: DataFrame) -> DataFrame:
        """Documents with ``whole`` and ``score``: the order in which those of a source get one more copy."""
        rows = sized.drop(*carry).join(side, F.col("source").eqNullSafe(F.col("s"))).withColumn("rate", rate_of(F.col("size"), F.col("lam"), most))
        rows = rows.withColumn("whole", F.floor("rate")).withColumn("part", F.round(F.col("rate") - F.col("whole"), 9))
        return rows.withColumn("score", _score(F.col("h"), F.col("part")))

    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        inside = scored(of(found, "lam", "prefix", "need")).filter((F.col("part") > 0) & (F.shiftright("score", shift + BITS) == F.col("prefix")))
        bins = inside.groupBy("s", "need", F.shiftright("score", shift).alias("bin")).agg(F.sum("size").alias("tokens"))
        before = F.sum("tokens").over(Window.partitionBy("s").orderBy("bin")) - F.col("tokens")  # at most 4096 rows a source
        bins = bins.withColumn("before", before)
        # the bin in which the wanted number of tokens is reached: the last that starts at or under it
        crossing = bins.filter(F.col("before") <= F.col("need")).groupBy("s").agg(F.max(F.struct("bin", "before", "tokens")).alias("x"))
        j = found.drop("x").join(crossing, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        j = j.withColumn("prefix", F.coalesce("x.bin", F.lit(-1)).cast("long")).withColumn("need", F.coalesce(F.col("need") - F.col("x.before"), F.col("need")))
        if level == LEVELS:  # scores under the prefix are taken; its own only if it fits
            fits = F.coalesce(F.col("x.tokens") <= F.col("need"), F.lit(False))
            j = j.withColumn("need", F.when(fits, F.col("need") - F.col("x.tokens")).otherwise(F.col("need"))).withColumn("prefix", F.when(fits, F.col("prefix") + 1).otherwise(F.col("prefix")))
        old, found = found, keep(spark, j.drop("x"), f"bins{level}")
        discard(old)
    # what is missing is less than the document left out: first the next documents that fit, then the nearest in size
    found = keep(spark, found.withColumn("fill", F.array().cast("array<bigint>")), "fill")
    for k in range(FILLS):
        todo = found.filter((F.col("need") >= 1) & (F.col("need") > 0.0005 * F.col("target")))
        if todo.isEmpty():
            break
        nearest, gap = k >= FILLS - 2, F.abs(F.col("need") - F.col("size"))
        rest = scored(of(todo, "lam", "prefix", "need", "fill")).filter((F.col("size") > 0) & (F.col("whole") < int(most)))
        rest = rest.filter(((F.col("score") >= F.col("prefix")) | (F.col("part") == 0)) & ~F.array_contains("fill", F.col("h")))
        rest = rest.filter(gap < F.col("need") if nearest else F.col("size") <= F.col("need"))
        # Spark keeps the first ones of each part of a source before it shuffles
        order = Window.partitionBy("s").orderBy(gap if nearest else F.col("score"), "h")
        rest = rest.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= (1 if nearest else NEXT))
        best = keep(spark, rest.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("r", "size", "h"))).alias("x")), "best")
        j = found.join(best, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        start = F.struct(F.col("need").cast("double").alias("need"), F.col("fill").alias("fill"))
        fits = lambda acc, x, any_=nearest: F.lit(any_) | (x["size"] <= acc["need"])
        take = lambda acc, x: F.when(fits(acc, x), F.struct((acc["need"] - x["size"]).alias("need"), F.concat(acc["fill"], F.array(x["h"])).alias("fill"))).otherwise(acc)
        none = F.array().cast(best.schema["x"].dataType)
        j = j.withColumn("y", F.aggregate(F.coalesce("x", none), start, take)).drop("x", "need", "fill").select("*", "y.need", "y.fill").drop("y")
        old, found = found, keep(spark, j, "fill")
        discard(old, best)
    side = of(found, "source_size", "target", "lam", F.col("prefix").alias("under"), "fill")
    out = sized.join(side, F.col("source").eqNullSafe(F.col("s"))).withColumn("rate", rate_of(F.col("size"), F.col("lam"), most))
    part = F.round(F.col("rate") - F.floor("rate"), 9)
    more = ((part > 0) & (_score(F.col("h"), part) < F.col("under"))) | F.array_contains("fill", F.col("h"))
    copies = F.least(F.lit(int(most)), F.floor("rate") + F.when(more, 1).otherwise(0)).cast("long")
    out = out.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(F.lit(0).cast("long")))
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"), *carry)


def _score(h: Column, part: Column) -> Column:
    """The hash over the fraction: under ``ONE`` for a share of the documents that is the fraction."""
    share = F.shiftrightunsigned(h, 64 - BITS * LEVELS + 2).cast("double")
    return F.when(part > 0, F.least(F.floor(share / part), F.lit((1 << (BITS * LEVELS)) - 1))).otherwise(F.lit((1 << (BITS * LEVELS)) - 1)).cast("long")
