"""Line dedup by a log-template tree of fixed depth.

The tree's first level is a line's token count, the next ``depth`` levels are its leading tokens; words with a digit count
as the variable field ``<*>`` from the start. Below a leaf a position keeps its token where at least ``min_docs``
documents of that leaf have it there, and is generalised to ``<*>`` where not. A template that keeps at least
``min_constant`` of its tokens and occurs in ``min_docs`` documents or more is boilerplate: its lines are dropped.

The tree is built from counts, not line by line, so it doesn't depend on any order and has no unbounded leaf: equal lines
are one row with a count, and leaves that too few documents share are left out before any tokens are compared.
Documents are counted by distinct text, so exact copies of one document do not make its lines boilerplate.

Defined results: null and empty texts stay as they are; lines without words are never dropped; a text whose lines are all
dropped becomes empty. Rows with the same text lose the same lines. Other columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.scratch import keep, temporaries

VARIABLE = r"(?<!\S)[^\s0-9]*+[0-9]\S*+"
DEPTH, MIN_DOCS, MIN_CONSTANT_PERCENT = 3, 20, 60


def normal(text: Column) -> Column:
    """A text with tokens that have a digit generalised and single spaces between the tokens of a line.

    Whole texts are rewritten, and only those that need it: most have no digit or no odd white space.
    """
    masked = F.when(text.rlike("[0-9]"), F.regexp_replace(text, VARIABLE, "<*>")).otherwise(text)
    spaced = F.regexp_replace(F.regexp_replace(masked, r"[ \t\x0B\f\r]+", " "), r"(?:(?<=\n)|\A) | (?=\n|\z)", "")
    odd = text.startswith(" ") | text.endswith(" ") | text.rlike(r"[\t\x0B\f\r]")
    for mark in ("  ", " \n", "\n "):  # plain searches: one expression with all these alternatives is slow
        odd = odd | F.contains(text, F.lit(mark))
    return F.when(odd, spaced).otherwise(masked)


def _leaf(line: Column, depth: int) -> Column:
    return F.xxhash64(F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))), F.substring_index(line, " ", depth))


def line_keys(text: Column, depth: int = DEPTH) -> Column:
    """For each line of a normal text its hash (null without tokens) and its leaf."""
    return F.transform(F.split(text, "\n"), lambda x: F.struct(F.when(x != "", F.xxhash64(x)).alias("line"), _leaf(x, depth).alias("leaf")))


def _pairs(once: DataFrame) -> DataFrame:
    """h, leaf, line and many (whether the text has other lines in the leaf) of each text and distinct line."""
    lines = F.sort_array(F.transform(F.filter("lines", lambda x: x["line"].isNotNull()), lambda x: F.struct(x["leaf"].alias("leaf"), x["line"].alias("line"))))

    def marked(own: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(own, i)["leaf"] == x["leaf"], F.lit(False))
        return F.transform(own, lambda x, i: F.struct(x["leaf"].alias("leaf"), x["line"].alias("line"), (same(x, i - 1) | same(x, i + 1)).alias("many")))

    # sorted, equal lines are neighbours, so that the first of each is what stays
    first = lambda own: F.filter(own, lambda x, i: (i == 0) | (F.get(own, i - 1) != x))
    once_each = F.get(F.transform(F.array(lines), first), F.lit(0))
    return once.select("h", F.explode(F.get(F.transform(F.array(once_each), marked), F.lit(0))).alias("x")).select("h", "x.leaf", "x.line", "x.many")


def _in_texts(once: DataFrame, rows: DataFrame, by: list[str], min_docs: int) -> DataFrame:
    """The values of ``by`` that ``min_docs`` distinct texts or more have. ``rows`` has leaf, line, docs and many.

    Lines that are alone in their leaf count by number. Several lines of one text can share a value; where that can matter,
    between the most and the fewest texts that the numbers allow, texts are counted one by one.
    """
    spark = rows.sparkSession
    alone = F.sum(F.col("docs") - F.col("many"))
    bounds = rows.groupBy(*by).agg(alone.alias("alone"), F.sum("docs").alias("most"), F.max("many").alias("least")).filter(F.col("most") >= min_docs)
    bounds = keep(spark, bounds, "bounds")
    sure = F.col("alone") + F.col("least") >= min_docs
    open_ = bounds.filter(~sure).select(*by, "alone")
    if open_.isEmpty():
        return bounds.select(*by)
    wanted = keep(spark, rows.filter("many > 0").join(open_.select(*by), by).select("line", *by), "open")
    pairs = _pairs(once).filter("many").select("h", "leaf", "line").join(wanted.select("leaf", "line").distinct(), ["leaf", "line"], "left_semi")
    texts = pairs.join(wanted, ["leaf", "line"]).select("h", *by).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("texts"))
    counted = open_.join(texts, by, "left").filter(F.col("alone") + F.coalesce("texts", F.lit(0)) >= min_docs)
    return bounds.filter(sure).select(*by).unionByName(counted.select(*by))


def boilerplate(texts: DataFrame, once: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS, min_constant: int = MIN_CONSTANT_PERCENT) -> DataFrame:
    """``line`` and ``template`` of the lines to drop. ``once`` has ``lines`` (see ``line_keys``) of each distinct text."""
    spark = texts.sparkSession
    seen = keep(spark, _pairs(once).groupBy("leaf", "line").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.col("many").cast("long")).alias("many")), "line-counts")
    lines = texts.select(F.explode(F.split(normal(F.col("text")), "\n")).alias("tokens")).filter("tokens <> ''")
    lines = lines.select("tokens", _leaf(F.col("tokens"), depth).alias("leaf"), F.xxhash64("tokens").alias("line"))
    leaves = keep(spark, seen.groupBy("leaf").agg(F.sum("docs").alias("d")).filter(F.col("d") >= min_docs).select("leaf"), "leaves")
    full = lines.join(leaves, "leaf", "left_semi").select("leaf", "line", "tokens").dropDuplicates(["leaf", "line"])
    full = keep(spark, full.join(seen, ["leaf", "line"]), "leaf-lines")
    at = full.select("leaf", "line", "docs", "many", F.posexplode(F.split("tokens", " ")).alias("pos", "token"))
    common = _in_texts(once, at, ["leaf", "pos", "token"], min_docs).withColumn("constant", F.lit(True))
    common = keep(spark, common, "constants")
    # leaves that share tokens only up to their leading ones have templates that keep too little; they go here
    placed = at.join(common, ["leaf", "pos", "token"], "left")
    whole = placed.groupBy("leaf", "line", "docs", "many").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.when(F.col("constant"), F.col("token")).otherwise("<*>").alias("x")))), lambda s: s["x"]), " ").alias("template"),
        F.sum(F.when(F.col("constant") & (F.col("token") != "<*>"), 1).otherwise(0)).alias("kept"), F.count(F.lit(1)).alias("n"),
    )
    whole = keep(spark, whole.filter(F.col("kept") * 100 >= F.col("n") * min_constant), "templates")
    recurring = _in_texts(once, whole, ["leaf", "template"], min_docs)
    return whole.join(recurring, ["leaf", "template"], "left_semi").select("line", "template")


def drop_lines(docs: DataFrame, text_col: str = "text", **parameters: int) -> DataFrame:
    """``docs`` with the lines of recurring templates removed, and ``_lines``, ``_dropped`` (how many of each)."""
    spark = docs.sparkSession
    key = F.md5(F.col(text_col))
    texts = docs.select(F.col(text_col).cast("string").alias("text")).filter("text <> ''")
    depth = parameters.get("depth", DEPTH)
    once = texts.select(F.md5("text").alias("h"), line_keys(normal(F.col("text")), depth).alias("lines")).groupBy("h").agg(F.first("lines").alias("lines"))
    with temporaries() as made:
        once = keep(spark, once, "line-keys")
        drop = keep(spark, boilerplate(texts, once, **parameters).select("line").distinct(), "boilerplate")
        hit = once.select("h", F.posexplode("lines.line").alias("pos", "line")).join(drop, "line", "left_semi")
        hit = hit.groupBy("h").agg(F.array_sort(F.collect_list("pos")).alias("_gone")).withColumnRenamed("h", "_h")
        hit = keep(spark, hit, "gone")  # a table of its own, so that a join with a hot text can be split
        made.remove(hit)
    out = docs.join(hit, key == F.col("_h"), "left").drop("_h")
    lines = F.split(F.col(text_col), "\n")
    # by a set of numbers, so that the time is in proportion to the lines
    rest = lambda own: F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.col("_gone"))
    kept = F.get(F.transform(F.array(lines), lambda own: F.array_join(F.transform(rest(own), lambda i: F.get(own, i)), "\n")), F.lit(0))
    out = out.withColumn("_lines", F.when(F.col(text_col) != "", F.size(lines)).otherwise(0).cast("long"))
    out = out.withColumn("_dropped", F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long"))
    return out.withColumn(text_col, F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(kept)).drop("_gone")
