"""Line-level text search and symbol impact over ``lines`` (path, line_no, text).

Every scan tests the cheap substring before any regular expression. Owner attribution is a set of window functions over
one partitioning by path, so all line-order operators share a single shuffle of the lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions import predicates as P
from weftline.operators import literals as L

CALL_KINDS = ("call", "method_call", "jsx")
RANK_PARTS = 64
#: Up to so many literals are one expression.
FEW_TERMS = 64


def scan_lines(files: DataFrame) -> DataFrame:
    """path, line_no and text of every line of ``files`` (path, content): no carriage returns, no empty last line."""
    parts = F.split(F.col("content"), "\n", -1)
    parts = F.when(F.col("content").endswith("\n") | (F.col("content") == ""), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    rows = files.select("path", F.posexplode(parts).alias("i", "text"))
    return rows.select("path", (F.col("i") + 1).cast("long").alias("line_no"), F.regexp_replace("text", r"\r\z", "").alias("text"))


def open_excerpt(lines: DataFrame, path: str, start: int, end: int, most: int = 120) -> DataFrame:
    """path, start, end, truncated and text of at most ``most`` lines; past the end the text is empty."""
    start = max(start, 1)
    end = max(end, start)
    stop = min(end, start + most - 1)
    rows = lines.filter((F.col("path") == path) & F.col("line_no").between(start, stop))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n")
    return rows.agg(text.alias("text"), F.count(F.lit(1)).alias("n")).select(F.lit(path).alias("path"), F.lit(start).alias("start_line"), F.lit(stop).alias("end_line"), ((F.col("n") < stop - start + 1) | F.lit(end > stop)).alias("truncated"), "text")


def literal_matches(lines: DataFrame, query: str) -> DataFrame:
    """path, line_no, text, category and kind of every line with the text."""
    hit = lines.filter(F.contains("text", F.lit(query)))
    return hit.withColumn("category", P.classify_path(F.col("path"))).withColumn("kind", P.classify_line(query, F.col("text")))


def search_literal(lines: DataFrame, query: str, *, limit: int | None = 100, per_file: int = 3, hidden: bool = False, tmp: bool = False, **switches: bool) -> DataFrame:
    """Per file: category, match_count (lines), kind counts, env_read and the first matches; the first ``limit`` by path,
    or all files where it is None.

    ``n_files`` counts all files that match; ``truncated`` is true where the limit was reached.
    """
    rows = lines.filter(P.is_searchable(F.col("path")) & ~P.skip_path(F.col("path"), hidden=hidden, tmp=tmp))
    rows = literal_matches(rows, query).filter(P.include_category(F.col("category"), **switches))
    first = F.row_number().over(Window.partitionBy("path").orderBy("line_no")) <= per_file
    rows = rows.withColumn("shown", F.when(first, F.struct("line_no", P.snippet(F.col("path"), F.col("text")).alias("snippet"), "kind")))
    count = lambda k: F.sum((F.col("kind") == k).cast("long"))
    files = rows.groupBy("path").agg(
        F.first("category").alias("category"), F.count(F.lit(1)).alias("match_count"), count("runtime_env_read").alias("env_reads"), count("env_assignment").alias("assignments"),
        count("literal_reference").alias("references"), F.array_sort(F.collect_list("shown")).alias("matches"),
    )
    total = files.agg(F.count(F.lit(1)).alias("n_files"))
    shown = files if limit is None else files.orderBy("path").limit(limit)
    cut = F.lit(False) if limit is None else F.col("n_files") >= limit
    return shown.join(F.broadcast(total), how="left").withColumn("truncated", cut)  # one row


def count_literal_files(lines: DataFrame, query: str, limit: int = 40, **switches: bool) -> DataFrame:
    """path, category and match_count alone."""
    return search_literal(lines, query, limit=limit, **switches).select("path", "category", "match_count")


def find_env_usages(lines: DataFrame, name: str, limit: int = 40, tests: bool = False) -> DataFrame:
    """The first ``limit`` files by path that read an environment variable at run time; only their rows are sorted."""
    rows = lines.filter(P.is_searchable(F.col("path")) & ~P.skip_path(F.col("path")))
    rows = literal_matches(rows, name).filter((F.col("kind") == "runtime_env_read") & P.include_category(F.col("category"), tests=tests, docs=False, config=False))
    return rows.groupBy("path").agg(F.first("category").alias("category"), F.count(F.lit(1)).alias("env_reads")).orderBy("path").limit(limit)


def category_counts(lines: DataFrame, query: str) -> DataFrame:
    """Files with the text, by category."""
    return literal_matches(lines, query).groupBy("category").agg(F.countDistinct("path").alias("files"), F.count(F.lit(1)).alias("lines"))


def with_owner(lines: DataFrame) -> DataFrame:
    """Non-comment lines with ``seg`` (number of the owner's start), ``after_end`` and ``owner``.

    A line that begins a function opens a segment; the segment ends at the first closing brace at which as many braces
    are closed as opened. An inner function's end does not bring the outer owner back.
    """
    t = F.col("stripped")
    rows = lines.withColumn("stripped", P.strip(F.col("text"))).filter(~P.is_comment(F.col("text"), t))
    rows = rows.withColumn("own", P.owner_name(F.col("text"), t)).withColumn("delta", P.brace_delta(F.col("text"))).drop("stripped")
    in_file = Window.partitionBy("path").orderBy("line_no")
    rows = rows.withColumn("seg", F.sum((F.col("own") != "").cast("long")).over(in_file))
    in_seg = Window.partitionBy("path", "seg")
    rows = rows.withColumn("depth", F.sum("delta").over(in_seg.orderBy("line_no")))
    ends = (F.col("seg") > 0) & (F.col("depth") <= 0) & F.contains("text", F.lit("}"))
    rows = rows.withColumn("end_line", F.min(F.when(ends, F.col("line_no"))).over(in_seg)).withColumn("opened", F.first("own").over(in_seg.orderBy("line_no")))
    after = F.coalesce(F.col("line_no") > F.col("end_line"), F.lit(False))
    owner = F.when((F.col("seg") == 0) | after, "").otherwise(F.col("opened"))
    return rows.select("path", "line_no", "text", "seg", after.alias("after_end"), owner.alias("owner"))


#: Lines of a bin of the span join.
BIN = 64


def owner_spans(lines: DataFrame) -> DataFrame:
    """path, seg, first, last and owner of every function: the stretch of lines that ``with_owner`` gives to it.

    A table to be stored with the corpus: a request then attributes the lines it has found, and reads no others. A span
    that a following function cuts off ends before that one; one that is never closed ends with the file.
    """
    rows = with_owner(lines).filter("seg > 0")
    inside = F.when(~F.col("after_end"), F.col("line_no"))
    return rows.groupBy("path", "seg").agg(F.min("line_no").alias("first"), F.max(inside).alias("last"), F.max("owner").alias("owner"))


def attributed(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """``rows`` (path, line_no, text, ...) without comment lines, with seg, after_end and owner, as ``with_owner`` has them.

    An equi-join on path and bin: a line looks for the spans of its bin, and for the last one that began in a bin before.
    """
    rows = rows.filter(~P.is_comment(F.col("text"), P.strip(F.col("text")))).withColumn("_bin", F.floor(F.col("line_no") / BIN))
    # bins from a span's first line to that of the next span: where its lines, and those after its end, can be
    following = F.lead("first").over(Window.partitionBy("path").orderBy("seg"))
    starts = spans.withColumn("_until", following)
    found = starts.select(F.col("path").alias("_p"), "seg", "first", "last", "owner", "_until")
    tops = rows.groupBy(F.col("path").alias("_q")).agg(F.max("_bin").alias("_top"))
    found = found.join(tops, F.col("_p") == F.col("_q")).withColumn("_to", F.coalesce(F.floor((F.col("_until") - 1) / BIN), F.col("_top")))
    bins = F.sequence(F.floor(F.col("first") / BIN), F.greatest(F.floor(F.col("first") / BIN), F.least("_to", "_top")))
    found = found.withColumn("_b", F.explode(bins))
    here = (F.col("path") == F.col("_p")) & (F.col("_bin") == F.col("_b")) & (F.col("line_no") >= F.col("first")) & (F.col("_until").isNull() | (F.col("line_no") < F.col("_until")))
    out = rows.join(found, here, "left")
    after = F.coalesce(F.col("line_no") > F.col("last"), F.lit(False))
    drop = ("_bin", "_p", "first", "last", "_until", "_q", "_top", "_to", "_b")
    return out.withColumn("after_end", after).withColumn("owner", F.when(F.col("seg").isNull() | after, "").otherwise(F.col("owner"))).withColumn("seg", F.coalesce("seg", F.lit(0).cast("long"))).drop(*drop)


def symbol_lines(lines: DataFrame, symbol: str, spans: DataFrame | None = None) -> DataFrame:
    """Every line that uses the symbol, with its owner, category, kind and bucket.

    With the stored ``spans`` only these lines are read and attributed. Without them the files that mention the symbol are:
    a semi-join on paths comes before the windows.
    """
    hit = F.contains("text", F.lit(symbol))
    if spans is not None:
        rows = attributed(lines.filter(hit), spans)
    else:
        rows = with_owner(lines.join(lines.filter(hit).select("path").distinct(), "path", "left_semi")).filter(hit)
    rows = rows.withColumn("stripped", P.strip(F.col("text"))).withColumn("kind", P.symbol_line_kind(symbol, F.col("text"), F.col("stripped"))).filter("kind IS NOT NULL").drop("stripped")
    return rows.withColumn("category", P.classify_path(F.col("path"))).withColumn("bucket", P.kind_bucket(F.col("kind")))


def symbol_buckets(lines: DataFrame, symbols: list[str]) -> DataFrame:
    """path and bucket of every use of any of some symbols, found in one scan of the lines."""
    either = F.lit(False)
    for s in symbols:
        either = either | F.contains("text", F.lit(s))
    rows = lines.filter(P.is_searchable(F.col("path")) & ~P.skip_path(F.col("path")) & either).withColumn("stripped", P.strip(F.col("text")))
    rows = rows.filter(~P.is_comment(F.col("text"), F.col("stripped")))
    kinds = F.array(*(P.symbol_line_kind(s, F.col("text"), F.col("stripped")) for s in symbols))
    return rows.select("path", F.explode(kinds).alias("kind")).filter("kind IS NOT NULL").select("path", P.kind_bucket(F.col("kind")).alias("bucket")).distinct()


def function_impact(lines: DataFrame, symbol: str, *, prefix: str = "", package: str = "", per_file: int = 5, spans: DataFrame | None = None, **switches: bool) -> DataFrame:
    """Per file and bucket: hit_count, owners in the order of their first use, kind counts and the first lines."""
    rows = symbol_lines(lines.filter(P.is_searchable(F.col("path")) & ~P.skip_path(F.col("path")) & P.path_in_scope(F.col("path"), prefix, package)), symbol, spans)
    rows = rows.filter(P.include_category(F.col("category"), **switches))
    part = Window.partitionBy("path", "bucket")
    rows = rows.withColumn("rank", F.row_number().over(part.orderBy("line_no"))).withColumn("first_of_owner", F.min("line_no").over(Window.partitionBy("path", "bucket", "owner")))
    owner = F.when((F.col("owner") != "") & (F.col("line_no") == F.col("first_of_owner")), F.struct("line_no", "owner"))
    count = lambda k: F.sum((F.col("kind") == k).cast("long")).alias(f"n_{k}")
    return rows.groupBy("path", "bucket").agg(
        F.first("category").alias("category"), F.count(F.lit(1)).alias("hit_count"), F.transform(F.array_sort(F.collect_list(owner)), lambda x: x["owner"]).alias("owners"),
        *(count(k) for k in ("definition", "import", "method_call", "call", "jsx", "reference")), F.array_sort(F.collect_list(F.when(F.col("rank") <= per_file, F.col("line_no")))).alias("lines"),
    )


def callsites(lines: DataFrame, callee: str, required: str, *, tests: bool = True, scripts: bool = True, limit: int | None = None, spans: DataFrame | None = None) -> DataFrame:
    """Every call of ``callee``: owner, line, and the line of the last ``required`` call before it in the same owner.

    On a line with both, the offsets decide, and such a line does not count for later calls. With the stored ``spans`` only
    lines with one of the names are read, and the order among them decides.
    """
    call, need = P.java_regex(P.call_pattern(callee)), P.java_regex(P.call_pattern(required))
    if spans is not None:
        rows = attributed(lines.filter(F.contains("text", F.lit(callee)) | F.contains("text", F.lit(required))), spans)
    else:
        mentions = lines.filter(F.contains("text", F.lit(callee))).select("path").distinct()
        rows = with_owner(lines.join(mentions, "path", "left_semi"))
    rows = rows.withColumn("category", P.classify_path(F.col("path")))
    rows = rows.filter(P.include_callsite_category(F.col("category"), tests=tests, scripts=scripts))
    calls = F.contains("text", F.lit(callee)) & F.col("text").rlike(call) & ~P.is_definition_or_import(callee, F.col("text"))
    needs = F.contains("text", F.lit(required)) & F.col("text").rlike(need) & ~P.is_definition_or_import(required, F.col("text"))
    rows = rows.withColumn("calls", calls).withColumn("needs", needs)
    before = Window.partitionBy("path", "seg", "after_end").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("req", F.last(F.when(F.col("needs") & ~F.col("calls"), F.col("line_no")), ignorenulls=True).over(before)).filter("calls")
    pieces, found = F.split("text", call, -1), F.regexp_extract_all("text", F.lit(call), F.lit(0))
    rows = rows.withColumn("pieces", pieces).withColumn("found", found).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("found"))))
    at = F.expr("aggregate(slice(pieces, 1, k), 0, (a, x) -> a + length(x)) + aggregate(slice(found, 1, k - 1), 0, (a, x) -> a + length(x))")
    rows = rows.withColumn("at", at).withColumn("need_at", F.when(F.col("needs"), F.regexp_instr("text", F.lit(need)) - 1))
    line = F.when(F.col("need_at") < F.col("at"), F.col("line_no")).otherwise(F.col("req"))
    out = rows.select("path", "category", "owner", F.col("line_no").alias("line"), "at", line.alias("required_line"), line.isNotNull().alias("has_required"))
    return out if limit is None else out.orderBy("path", "line", "at").limit(limit)


def rename_impact(lines: DataFrame, old: str, kind: str = "path", per_bucket: int = 20) -> DataFrame:
    """Files that mention an old name, in buckets; the first ``per_bucket`` of a bucket are displayed and have their rank.

    Buckets are few and may be large: paths are ranked in parts first, and only the first ones of the parts meet.
    """
    rows = lines.filter(P.is_searchable(F.col("path")) & ~P.skip_path(F.col("path"), hidden=True))
    rows = literal_matches(rows, old).groupBy("path").agg(F.first("category").alias("category"), F.count(F.lit(1)).alias("match_count"), F.max(F.col("kind") == "runtime_env_read").alias("env_read"))
    rows = rows.withColumn("bucket", P.rename_bucket(F.col("category"), F.col("env_read")))
    part = F.pmod(F.xxhash64("path"), F.lit(RANK_PARTS))
    rows = rows.withColumn("part", part).withColumn("r", F.row_number().over(Window.partitionBy("bucket", "part").orderBy("path")))
    rows = rows.withColumn("part", F.when(F.col("r") <= per_bucket, -1).otherwise(F.col("part")))
    rank = F.row_number().over(Window.partitionBy("bucket", "part").orderBy("path"))
    rows = rows.withColumn("rank", F.when(F.col("part") == -1, rank)).withColumn("rank", F.when(F.col("rank") <= per_bucket, F.col("rank"))).drop("part", "r")
    doubtful = kind != "package" and len(old) <= 12 and "/" not in old and "@" not in old
    return rows.withColumn("shown", F.col("rank").isNotNull()).withColumn("maybe_false_positive", F.lit(doubtful))


def call_edges(lines: DataFrame) -> DataFrame:
    """(callee, owner, path) of every call in an owner, for all names at once: no scan per symbol."""
    rows = with_owner(lines).filter("owner <> ''")
    name = P.java_regex(r"(" + P.NAME + r")\s*\(")
    rows = rows.select("path", "owner", F.explode(F.regexp_extract_all("text", F.lit(name), F.lit(1))).alias("callee"))
    return rows.filter((F.col("callee") != F.col("owner")) & ~F.col("callee").isin(*P.CONTROL_WORDS)).distinct()


def transitive_impact(lines: DataFrame, symbol: str, depth: int = 2) -> DataFrame:
    """Owners that reach the symbol through calls, with their smallest depth, by bounded joins on ``call_edges``."""
    edges = call_edges(lines).select("callee", "owner").distinct()
    spark = lines.sparkSession
    front = spark.createDataFrame([(symbol,)], "symbol string")
    seen, out = front, None
    for d in range(1, depth + 1):
        front = front.join(edges, F.col("symbol") == F.col("callee")).select(F.col("owner").alias("symbol")).distinct().join(seen, "symbol", "left_anti")
        level = front.withColumn("depth", F.lit(d))
        out = level if out is None else out.unionByName(level)
        seen = seen.unionByName(front)
    return out


def related_tests(files: DataFrame, seeds: DataFrame) -> DataFrame:
    """Test files that naming conventions tie to the seeds (``path``) and that exist."""
    path = F.col("path")
    parts = F.struct(F.regexp_extract(path, r"^(.*/)?[^/]*$", 1).alias("folder"), F.regexp_replace(P.base_name(path), r"\.[^./]*$", "").alias("stem"), F.regexp_extract(path, r"(\.[^./]*)$", 1).alias("ext"))
    seeds = seeds.select(path, F.explode(F.array(parts)).alias("p"))  # evaluated once, not once for each name
    names = [F.concat(F.col("p.folder"), F.lit(sub), F.col("p.stem"), F.lit(f".{kind}"), e) for sub in ("", "__tests__/") for kind in ("test", "spec") for e in (F.col("p.ext"), F.lit(".ts"), F.lit(".tsx"), F.lit(".js"), F.lit(".jsx"))]
    wanted = seeds.select(path.alias("seed"), F.explode(F.array_distinct(F.array(*names))).alias("path")).filter("seed <> path")
    return wanted.join(files.select("path").distinct(), "path").select("seed", "path")


def import_terms(seeds: DataFrame) -> DataFrame:
    """(seed, term): the last two segments and the bare name under which a file is usually imported."""
    bare = F.regexp_replace("path", r"\.[^./]*$", "")
    parts = F.split(bare, "/")
    two = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), "/")
    base = F.element_at(parts, -1)
    terms = F.array(F.when((F.size(parts) > 1) & (F.length(two) >= 4), two), F.when((F.length(base) >= 3) & ~base.isin("index", "mod"), base))
    return seeds.select(F.col("path").alias("seed"), F.explode(F.array_distinct(F.filter(terms, lambda t: t.isNotNull()))).alias("term"))


def path_set_importers(lines: DataFrame, seeds: DataFrame) -> DataFrame:
    """Files with lines that hold a term of a seed, and how many such lines: one pass for any number of terms.

    Few terms are one alternation of literals inside the scan's own stage, more of them an automaton.
    """
    rows = lines.filter(P.is_searchable(F.col("path"))).join(seeds.select("path"), "path", "left_anti")
    terms = import_terms(seeds).select("term").distinct()
    few = sorted(r["term"] for r in terms.limit(FEW_TERMS + 1).collect())
    if len(few) <= FEW_TERMS:
        hit = rows.filter(F.col("text").rlike("|".join(f"\\Q{t}\\E" for t in few)) if few else F.lit(False))
    else:
        hit = L.occurrences(rows, terms).select("path", "line_no").distinct()
    return hit.groupBy("path").agg(F.count(F.lit(1)).alias("hits")).withColumn("is_test", P.classify_path(F.col("path")) == "test")


def first_seen(rows: DataFrame, key: str, value: str, order: Column) -> DataFrame:
    """Distinct values of each key in the order of their first occurrence."""
    once = rows.groupBy(key, value).agg(F.min(order).alias("at"))
    return once.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", value))), lambda x: x[value]).alias(value + "s"))
