"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Seeds are what four expressions find (e-mail, IP, card, phone). The words around seeds induce lexical patterns. Spark
scores the graph of patterns and instances in rounds: a pattern's confidence is the weight of the known instances of its
kind over that and what contradicts it (known instances of other kinds, strings that can't be of the kind); unknown
strings of fitting shape are neutral. An instance's weight is the noisy-or of its patterns. Confident patterns then give a kind to
identifier-like strings, and to digits in groups, that no expression finds. Base spans are places as a whole: the words
around a number in groups are those around all its groups.

The expressions never go back over what they read: run starts are anchored by a look-behind and repeats are possessive, so
a very long text takes linear time and no deep stack. Positions come from the lengths of the pieces between matches.

Defined results: a null or empty text has no spans. Rows with the same text have the same spans; the graph counts distinct
instances, so copies add no weight. Spans are in code points, end exclusive. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.scratch import keep

KINDS = ("email", "ip", "card", "phone")
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}+"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IDENTIFIER = r"(?:(?<![A-Za-z0-9@._%+-])|\G)(?=[A-Za-z._%+-]*+[0-9@])[A-Za-z0-9@._%+-]++"
GROUPED = r"(?<![A-Za-z0-9@._%+-])\+?+\(?+[0-9]++(?:\)?+[\x20.-]?+\(?+[0-9]++)++(?![A-Za-z@_%+])"
ROUNDS, MIN_SUPPORT, MIN_CONFIDENCE, MIN_INSTANCE = 3, 5, 0.8, 0.8
CONTEXT, BLOCK = 80, 256
NO_SPANS = "array<struct<kind:int,start:bigint,end:bigint,found:string>>"
NO_CANDIDATES = "array<struct<start:bigint,end:bigint,found:string>>"


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body's lambdas read it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def matches(text: Column, regex: str) -> Column:
    """start, end and found of each match.

    The k-th match lies between the k-th piece and the next, so lengths add up to positions. They are added up in blocks of
    ``BLOCK``, as an array that grows by an element is copied each time.
    """
    zipped = F.arrays_zip(F.split(text, regex, -1).alias("piece"), F.regexp_extract_all(text, F.lit(regex), F.lit(0)).alias("found"))
    zero = F.lit(0).cast("long")
    width = lambda x: F.length(x["piece"]) + F.coalesce(F.length(x["found"]), F.lit(0))

    def step(acc: Column, x: Column) -> Column:
        at = acc["pos"] + F.length(x["piece"])
        end = at + F.coalesce(F.length(x["found"]), F.lit(0))
        new = F.struct(at.alias("start"), end.alias("end"), x["found"].alias("found"))
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(new)).alias("out"))

    def located(blocks: Column) -> Column:
        widths = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda acc, x: acc + width(x)))
        start = F.struct(zero.alias("pos"), F.array().cast("array<bigint>").alias("out"))
        before = F.aggregate(widths, start, lambda acc, w: F.struct((acc["pos"] + w).alias("pos"), F.concat(acc["out"], F.array(acc["pos"])).alias("out")), lambda acc: acc["out"])
        own = lambda b: F.struct(b["at"].alias("pos"), F.array().cast(NO_CANDIDATES).alias("out"))
        return F.flatten(F.transform(F.arrays_zip(blocks.alias("block"), before.alias("at")), lambda b: F.aggregate(b["block"], own(b), step, lambda acc: acc["out"])))

    cut = lambda z: F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / BLOCK).cast("int")), lambda k: F.slice(z, k * BLOCK + 1, F.lit(BLOCK)))
    every = _bound(zipped, lambda z: _bound(cut(z), located))
    # the piece after the last match is an element without a match
    return F.filter(every, lambda x: x["found"].isNotNull())


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    d = lambda i: F.ascii(F.substring(F.reverse(digits), i, F.lit(1))) - 48
    value = lambda i: F.when(i % 2 == 1, d(i)).when(d(i) > 4, 2 * d(i) - 9).otherwise(2 * d(i))
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def _passes(kind: str, found: Column) -> Column:
    if kind == "ip":
        part = r"0*+(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])?"
        return found.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        digits = _digits(found)
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(found)).between(9, 15)
    return F.lit(True)


def _spans(text: Column, kind: str, regex: str) -> Column:
    good = F.filter(matches(text, regex), lambda x: _passes(kind, x["found"]))
    return F.transform(good, lambda x: F.struct(F.lit(KINDS.index(kind)).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["found"].alias("found")))


def base_spans(text: Column) -> Column:
    """The spans of the four expressions, by kind and start; texts without the marks they need are not searched."""
    none = F.array().cast(NO_SPANS)
    digit = text.rlike("[0-9]")
    return F.concat(
        F.when(F.contains(text, F.lit("@")), _spans(text, "email", EMAIL)).otherwise(none),
        F.when(digit, _spans(text, "ip", IP)).otherwise(none),
        F.when(digit, _spans(text, "card", CARD)).otherwise(none),
        F.when(F.contains(text, F.lit("+")), _spans(text, "phone", PHONE)).otherwise(none),
    )


def _spots(text: Column) -> Column:
    """base (the spans) and spots: every base span and every candidate, with up to ``CONTEXT`` characters before and after
    it. Blocks of the text give these, so a place costs the same wherever it lies."""
    none = F.array().cast(NO_CANDIDATES)
    grouped = F.when(text.rlike(r"[0-9][\x20().-]{1,3}[0-9]"), matches(text, GROUPED)).otherwise(none)
    grouped = F.filter(grouped, lambda c: c["found"].rlike(r"[\x20()]"))  # the others are tokens
    tokens = F.when(text.rlike("[0-9@]"), matches(text, IDENTIFIER)).otherwise(none)
    tokens = F.transform(tokens, lambda c: _bound(F.regexp_replace(c["found"], "[._%+-]+$", ""), lambda f: F.struct(c["start"].alias("start"), (c["start"] + F.length(f)).alias("end"), f.alias("found"))))
    cands = F.filter(F.concat(tokens, grouped), lambda c: F.length(c["found"]) >= 5)

    def spots(base: Column, cands: Column) -> Column:
        place = lambda x, kind: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["found"].alias("found"), kind.alias("kind"))
        every = F.concat(F.transform(base, lambda b: place(b, b["kind"])), F.transform(cands, lambda c: place(c, F.lit(None).cast("int"))))
        blocks = F.when(F.size(every) > 0, F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{CONTEXT}}}"), F.lit(0)))

        def block(all_: Column, i: Column) -> Column:
            return F.coalesce(F.get(all_, i.cast("int")), F.lit(""))

        def around(x: Column, all_: Column) -> Column:
            i, j = F.floor(x["start"] / CONTEXT), F.floor(x["end"] / CONTEXT)
            before = F.right(F.concat(block(all_, i - 1), F.left(block(all_, i), (x["start"] % CONTEXT).cast("int"))), F.lit(CONTEXT))
            after = F.left(F.concat(F.substring(block(all_, j), (x["end"] % CONTEXT + 1).cast("int"), F.lit(CONTEXT)), block(all_, j + 1)), F.lit(CONTEXT))
            return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["found"].alias("found"), x["kind"].alias("kind"), before.alias("before"), after.alias("after"))

        return _bound(blocks, lambda all_: F.transform(every, lambda x: around(x, all_)))

    return _bound(base_spans(text), lambda base: F.struct(base.alias("base"), _bound(cands, lambda c: spots(base, c)).alias("spots")))


def _free(places: DataFrame) -> DataFrame:
    """Without the candidates that meet a base span; ``places`` has h and c, and one text's places are sorted once."""
    base = F.col("c.kind").isNotNull()
    text = Window.partitionBy("h").orderBy("c.start", "c.end", ~base)  # at one place the base span comes first
    reach = F.max(F.when(base, F.col("c.end"))).over(text.rowsBetween(Window.unboundedPreceding, -1))
    ahead = Window.partitionBy("h").orderBy(F.desc("c.start"), F.desc("c.end"))
    follows = F.min(F.when(base, F.col("c.start"))).over(ahead.rowsBetween(Window.unboundedPreceding, -1))
    marked = places.withColumn("reach", reach).withColumn("follows", follows)
    meets = F.coalesce(F.col("reach") > F.col("c.start"), F.lit(False)) | F.coalesce(F.col("follows") < F.col("c.end"), F.lit(False))
    return marked.filter(base | ~meets).drop("reach", "follows")


def render(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _shaped(kind: Column, found: Column) -> Column:
    """Whether a string can be of the kind at all."""
    digits = F.length(_digits(found))
    return F.when(kind == 0, F.contains(found, F.lit("@"))).when(kind == 1, F.contains(found, F.lit(".")) & (digits >= 4)).when(kind == 2, digits >= 8).otherwise(digits >= 7)


def _patterns(before: Column, after: Column) -> Column:
    """The lexical patterns of a place: the two words before it, and the words on both sides."""
    clean = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\s]+", " ")
    # a context ends at the neighbouring identifier, which is no word of it
    before = F.regexp_replace(before, r"(?s)^.*[0-9@][A-Za-z0-9@._%+-]*+", "")
    after = F.regexp_replace(after, r"(?s)[A-Za-z._%+-]*+[0-9@].*$", "")
    two = F.trim(F.regexp_extract(clean(before), r"(\p{L}+\s+\p{L}+)\s*$", 1))
    left = F.regexp_extract(clean(before), r"(\p{L}+)\s*$", 1)
    right = F.regexp_extract(clean(after), r"^\s*(\p{L}+)", 1)
    return F.array_distinct(F.filter(F.array(F.when(two != "", F.concat(F.lit("L "), two)), F.when((left != "") & (right != ""), F.concat_ws(" ", F.lit("B"), left, right))), lambda p: p.isNotNull()))


def discover(places: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """h, kind, start and end of new spans. ``places`` has h, start, end, found, kind (null if unknown) and patterns."""
    spark = places.sparkSession
    edges = places.select(F.lower("found").alias("inst"), "kind", F.explode("patterns").alias("pattern"))
    edges = keep(spark, edges.groupBy("pattern", "inst").agg(F.max("kind").alias("kind")), "graph")
    seeds = edges.filter("kind IS NOT NULL").groupBy("inst").agg(F.max("kind").alias("kind")).withColumn("weight", F.lit(1.0))
    fits = [_shaped(F.lit(k), F.col("inst")) for k in range(len(KINDS))]
    known = seeds = keep(spark, seeds, "seeds")
    trusted = None
    for _ in range(rounds):
        of = edges.select("pattern", "inst").join(known.withColumnRenamed("kind", "k"), "inst", "left")
        score = lambda k: F.struct(
            F.lit(k).alias("kind"), F.sum(F.when(F.col("k") == k, F.col("weight")).otherwise(0.0)).alias("w"), F.count(F.when(F.col("k") == k, 1)).alias("support"),
            F.sum(F.when(F.col("k") != k, F.col("weight")).when(F.col("k").isNull() & ~fits[k], 1.0).otherwise(0.0)).alias("against"),
        )
        mass = of.groupBy("pattern").agg(F.array(*(score(k) for k in range(len(KINDS)))).alias("x")).select("pattern", F.inline("x"))
        scored = mass.withColumn("conf", F.col("w") / (F.col("w") + F.col("against") + 1)).filter((F.col("conf") >= MIN_CONFIDENCE) & (F.col("support") >= MIN_SUPPORT))
        trusted = keep(spark, scored.select("pattern", "kind", "conf"), "patterns")
        # noisy-or over the patterns that extract the instance
        fresh = edges.select("pattern", "inst").join(trusted, "pattern").groupBy("inst", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("conf"))))).alias("weight"))
        fresh = fresh.filter((F.col("weight") >= MIN_INSTANCE) & _shaped(F.col("kind"), F.col("inst"))).join(seeds.select("inst"), "inst", "left_anti")
        fresh = fresh.groupBy("inst").agg(F.max(F.struct("weight", "kind")).alias("x")).select("inst", "x.kind", "x.weight")
        known = keep(spark, seeds.unionByName(fresh), "instances")
    new = known.join(seeds.select("inst"), "inst", "left_anti").select(F.col("inst").alias("i"), F.col("kind").alias("k"))
    open_places = places.filter("kind IS NULL").drop("kind").join(new, F.lower("found") == F.col("i"))
    open_places = open_places.select("h", F.col("k").alias("kind"), "start", "end", "found", F.explode("patterns").alias("pattern"))
    found = open_places.join(trusted.select("pattern", "kind"), ["pattern", "kind"], "left_semi").select("h", "kind", "start", "end").distinct()
    # a number in groups and its last group can both be found; the longer one stays
    reach = F.max("end").over(Window.partitionBy("h", "kind").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1))  # one text's finds
    return found.withColumn("reach", reach).filter("reach IS NULL OR end > reach").drop("reach")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_discovered of every row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = keep(spark, rows.select("id", F.md5("text").alias("h"), _spots(F.col("text")).alias("x")).select("id", "h", "x.base", "x.spots"), "spans")
    once = rows.filter(F.size("spots") > 0).groupBy("h").agg(F.first("spots").alias("spots"))
    places = _free(once.select("h", F.explode("spots").alias("c")))
    places = places.select("h", "c.start", "c.end", "c.found", "c.kind", _patterns(F.col("c.before"), F.col("c.after")).alias("patterns"))
    new = discover(keep(spark, places, "places"), rounds)
    new = new.groupBy(F.col("h").alias("k")).agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("new"))
    new = keep(spark, new, "discovered")  # a table of its own, so that the join with a hot text can be split
    out = rows.select("id", "h", "base").join(new, F.col("h") == F.col("k"), "left")
    slim = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    every = F.array_sort(F.concat(slim, F.coalesce("new", F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>"))))
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return out.select(F.col("id").alias(id_col), *counts, F.sha2(render(slim), 256).alias("base_sha256"), render(every).alias("spans"), F.coalesce(F.when(F.col("new").isNotNull(), F.size("new")), F.lit(0)).cast("long").alias("n_discovered"))
