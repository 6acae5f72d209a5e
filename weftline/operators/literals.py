"""Many literals at once: one automaton, one pass over each line, whatever their number.

The terms of a pass go to the executors as one broadcast, at most ``SLICE`` of them; more terms are dealt by hash into as many
passes as they need. An executor's worker builds the automaton once.

Defined results: every occurrence counts, also those that overlap. Offsets count characters from 0. Null and empty terms find
nothing, repeated terms count once, null lines have no occurrence. With ``words`` an occurrence has no letter, digit,
underscore or dollar sign on either side.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE = 100_000
_BUILT: list[tuple[list[str], ahocorasick.Automaton]] = []


def _automaton(terms: list[str]) -> ahocorasick.Automaton:
    """The automaton of a broadcast, built once a worker."""
    if not _BUILT or _BUILT[0][0] is not terms:
        made = ahocorasick.Automaton()
        for t in terms:
            made.add_word(t, t)
        made.make_automaton()
        _BUILT[:] = [(terms, made)]
    return _BUILT[0][1]


def _inside_word(c: str) -> bool:
    return c.isalnum() or c in "_$"


def occurrences(lines: DataFrame, terms: DataFrame, words: bool = False, slice_size: int | None = None) -> DataFrame:
    """path, line_no, term and at of every occurrence in ``lines`` (path, line_no, text) of a term of ``terms`` (term)."""
    spark, size = lines.sparkSession, slice_size or SLICE
    clean = terms.select(F.col("term").cast("string").alias("term")).filter("term <> ''").distinct()
    n = clean.count()
    slices = 1 if n <= size else -(-2 * n // size)  # half full, as a hash doesn't deal evenly
    out = None
    for k in range(slices):
        mine = [r["term"] for r in clean.filter(F.pmod(F.xxhash64("term"), F.lit(slices)) == k).collect()]  # about SLICE at most
        if mine or out is None:
            found = _pass(lines, spark.sparkContext.broadcast(mine), words)
            out = found if out is None else out.unionByName(found)
    return out


def _pass(lines: DataFrame, shipped, words: bool) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shipped.value
        made = _automaton(terms) if terms else None
        for batch in batches:
            paths, numbers, found, at = [], [], [], []
            for path, number, text in zip(batch.column("path").to_pylist(), batch.column("line_no").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for end, term in made.iter(text) if made and text else ():
                    start = end - len(term) + 1
                    if words and (start > 0 and _inside_word(text[start - 1]) or end + 1 < len(text) and _inside_word(text[end + 1])):
                        continue
                    paths.append(path)
                    numbers.append(number)
                    found.append(term)
                    at.append(start)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(numbers, pa.int64()), pa.array(found, pa.string()), pa.array(at, pa.int32())], names=["path", "line_no", "term", "at"])

    return lines.select("path", F.col("line_no").cast("long").alias("line_no"), "text").mapInArrow(find, "path string, line_no long, term string, at int")
