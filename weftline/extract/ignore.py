"""Ignore files as a table of rules, joined with the prefixes of paths.

A rule is looked up by what it names: a base name, an ending, a path, a folder that something lies in, or, where it has
wild cards elsewhere, the literal folder that it begins with. So a path meets the rules that can fit it through an
equi-join, however many rules there are. Of the rules that fit a prefix the last one decides; a path is left out if that
of any of its prefixes leaves it out, so nothing is taken back inside a folder that is left out.

Built-in rules come first, then the ignore files in the order of their paths, line by line. A rule of a file in a folder is
a path from that folder on, so ``*.log`` in ``a/.gitignore`` means ``a/*.log``. Letters' case doesn't matter. Blank lines and
those that begin with # are no rules; a backslash takes the next character as it is; blanks at the end don't count. Null paths
and contents have no rules, and a null path isn't kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import predicates as P

# What is always left out.
BUILT_IN = ("**/node_modules/**", "**/.git/**", "**/.next/**", "**/dist/**", "**/build/**", "**/coverage/**", "**/*.d.ts")
RULE = "file string, line int, negated boolean, folders boolean, kind string, key string, regex string"
WILD = re.compile(r"(?<!\\)[*?\[]")


class Rule(NamedTuple):
    """``kind`` and ``key`` tell where to look; ``regex`` is what a whole prefix must fit, empty if the key says it all."""

    negated: bool
    folders: bool
    kind: str
    key: str
    regex: str


def glob_regex(glob: str) -> str:
    """The expression of a path from the root on; no wild card but ** crosses a slash."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif c == "*" and glob[i:].startswith("**"):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            inner = glob[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out, i = out + "(?!/)[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", end + 1
        elif c == "\\" and i + 1 < len(glob):
            out, i = out + re.escape(glob[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return f"^{out}$"


def rule_of(line: str, folder: str = "") -> Rule | None:
    """The rule of one line of an ignore file in a folder; none if it has none."""
    text = line.strip() if not line.rstrip().endswith("\\") else line.strip() + " "
    if not text or text.startswith("#"):
        return None
    negated = text.startswith("!")
    text = text[1:] if negated else text
    if folder:
        text = f"{folder}/{text.removeprefix('/')}"
    only = text.endswith("/")
    text = text.rstrip("/")
    if not text:
        return None
    anchored = "/" in text
    text = text.removeprefix("/")
    plain = lambda s: not WILD.search(s)
    real = lambda s: re.sub(r"\\(.)", r"\1", s).lower()
    free = text.removeprefix("**/") if text.startswith("**/") else text if not anchored else None
    inside = text[:-3] if text.endswith("/**") else None
    if inside is not None and inside.startswith("**/") and "/" not in inside[3:] and plain(inside[3:]):
        return Rule(negated, only, "in name", real(inside[3:]), "")
    if inside is not None and plain(inside):
        return Rule(negated, only, "in path", real(inside), "")
    if free is not None and "/" not in free:
        if plain(free):
            return Rule(negated, only, "name", real(free), "")
        if free.startswith("*.") and plain(free[1:]):
            return Rule(negated, only, "ending", real(free[1:]), "")
    if anchored and plain(text):
        return Rule(negated, only, "path", real(text), "")
    lead = []
    if free is None:
        for part in text.split("/")[:-1]:
            if not plain(part):
                break
            lead.append(real(part))
    whole = text if free is None or text.startswith("**/") else f"**/{text}"
    return Rule(negated, only, "below", "/".join(lead), "(?i)" + glob_regex(whole))


def rules(files: DataFrame) -> DataFrame:
    """The rules of the ignore files (path, content) of a tree, behind the built-in ones."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                for i, line in enumerate(re.split(r"\r?\n", content or "")):
                    if path is not None and (r := rule_of(line, path.rpartition("/")[0])):
                        rows.append((path, i, *r))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.string(), pa.int32(), pa.bool_(), pa.bool_(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["file", "line", "negated", "folders", "kind", "key", "regex"])

    built_in = files.sparkSession.createDataFrame([("", i, *r) for i, x in enumerate(BUILT_IN) if (r := rule_of(x))], RULE)
    return built_in.unionByName(files.select("path", "content").mapInArrow(parse, RULE))


def ignore_files(files: DataFrame) -> DataFrame:
    """path and content of a tree's ignore files, but for those in places that are always left out."""
    found = files.filter(P.base_name(F.col("path")) == ".gitignore").select("path", "content")
    return kept(found, rules(found.limit(0)))


def _tokens() -> Column:
    """Where a prefix looks for rules: its name, its endings, itself, and the names and paths of the folders that it is in."""
    parts = F.split(F.lower("prefix"), "/")
    above = F.slice(parts, 1, F.size(parts) - 1)
    name = F.element_at(parts, -1)
    dots = F.split(name, r"\.", -1)
    endings = F.transform(F.sequence(F.lit(2), F.greatest(F.size(dots), F.lit(2))), lambda i: F.concat(F.lit("."), F.array_join(F.slice(dots, i, F.size(dots)), ".")))
    paths = F.transform(F.sequence(F.lit(1), F.greatest(F.size(above), F.lit(1))), lambda i: F.array_join(F.slice(above, 1, i), "/"))
    of = lambda kind, keys: F.transform(keys, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))
    none = F.array().cast("array<string>")
    inside = F.size(above) > 0
    return F.array_distinct(F.concat(
        of("name", F.array(name)), of("ending", F.when(F.size(dots) > 1, endings).otherwise(none)), of("path", F.array(F.lower("prefix"))),
        of("in name", above), of("in path", F.when(inside, paths).otherwise(none)), of("below", F.concat(F.array(F.lit("")), F.when(inside, paths).otherwise(none))),
    ))


def left_out(paths: DataFrame, table: DataFrame) -> DataFrame:
    """prefix: every prefix of ``paths`` (path) whose last fitting rule leaves it out."""
    parts = F.split("path", "/")
    each = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("prefix"), (i < F.size(parts)).alias("folder")))
    prefixes = paths.select(F.explode(each).alias("p")).select("p.prefix", "p.folder").distinct()
    sought = prefixes.select("prefix", "folder", F.explode(_tokens()).alias("t")).select("prefix", "folder", F.col("t.kind").alias("kind"), F.col("t.key").alias("key"))
    fits = (F.col("regex") == "") | F.rlike("prefix", "regex")
    hits = sought.join(table, ["kind", "key"]).filter((~F.col("folders") | F.col("folder")) & fits)
    last = hits.groupBy("prefix", "folder").agg(F.max_by("negated", F.struct("file", "line")).alias("negated"))
    return last.filter("NOT negated").select("prefix", "folder")


def kept(files: DataFrame, table: DataFrame) -> DataFrame:
    """``files`` (path, ...) without those that the rules leave out."""
    parts = F.split("path", "/")
    each = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("prefix"), (i < F.size(parts)).alias("folder")))
    names = files.select("path").filter("path IS NOT NULL").distinct()
    gone = names.select("path", F.explode(each).alias("p")).select("path", "p.prefix", "p.folder").join(left_out(names, table), ["prefix", "folder"], "left_semi").select("path").distinct()
    return files.filter("path IS NOT NULL").join(gone, "path", "left_anti").select(*files.columns)
