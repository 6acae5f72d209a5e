"""Extraction of what has changed: facts of unchanged files are kept, others are scanned anew, and all facts are linked.

What a file says depends on its path and content alone, so facts can be stored by file. What follows between files (imports,
names that are unique in the tree, packages, routes) is joins over all facts, which read no file; so edges into a changed
file are attached anew, those of a deleted one go, and the result is that of a full extraction.

A file counts as unchanged if the stored listing has its path with the same size, time and scan options; else its content is
read, and if the digest is the stored one its facts are kept too. A moved file is a deleted and a new one.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.extract import events as X

#: What is stored of each file.
LISTING = ["path", "size", "modified"]
#: Up to so many files are read by name; for more the whole tree is read and those not wanted are dropped.
NAMED = 5000


class Refreshed(NamedTuple):
    """Facts and files as they are now, and the paths that were scanned or are gone (path, change)."""

    facts: DataFrame
    files: DataFrame
    changes: DataFrame


def options(relations: bool, identifiers: bool) -> Column:
    """The scan's options, as stored."""
    return F.lit(f"relations={int(relations)} identifiers={int(identifiers)}")


def refresh(listing: DataFrame, read: Callable[[DataFrame, int], DataFrame], old_files: DataFrame | None, old_facts: DataFrame | None, relations: bool, identifiers: bool, keep: Callable[[DataFrame], DataFrame]) -> Refreshed:
    """``listing`` has the present files without their content, ``read`` gives (path, content) of some of them (and gets
    their number), ``keep`` makes a DataFrame that is computed once."""
    how = options(relations, identifiers)
    now = listing.select(*LISTING)
    if old_files is None or old_facts is None:
        schema = listing.sparkSession.createDataFrame([], "path string, digest string, options string")
        old_files = now.limit(0).join(schema, "path")
        old_facts = listing.sparkSession.createDataFrame([], X.SCHEMA)
    stored = old_files.filter(F.col("options") == how)
    same = now.join(stored, LISTING).select(*LISTING, "digest")
    doubtful = keep(now.join(same.select("path"), "path", "left_anti"))
    texts = read(doubtful.select("path"), doubtful.count())
    digest = F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256)
    read_now = keep(texts.withColumn("digest", digest))
    digests = doubtful.join(read_now.select("path", "digest"), "path", "left")
    touched = digests.join(stored.select("path", "digest"), ["path", "digest"], "left_semi").select("path")
    fresh = digests.join(touched, "path", "left_anti").select("path")
    facts = X.file_facts(read_now.join(fresh, "path", "left_semi").select("path", "content"), relations, identifiers)
    unchanged = same.select("path").unionByName(touched)
    files = same.unionByName(digests.select(*same.columns)).withColumn("options", how)
    gone = old_files.select("path").join(now.select("path"), "path", "left_anti").withColumn("change", F.lit("gone"))
    changes = fresh.withColumn("change", F.lit("scanned")).unionByName(gone)
    return Refreshed(old_facts.join(unchanged, "path", "left_semi").unionByName(facts), files, changes)
