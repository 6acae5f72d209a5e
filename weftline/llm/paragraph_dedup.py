"""Substring dedup: paragraph MinHash banding.

Paragraphs are of two kinds, both read as sets of distinct 5-word shingles (A-Z lower-cased). A line with at least
``min_words`` words is one. And, so that a passage is found inside a longer line or over many short ones, every run of
``WINDOW`` words that starts at a chosen place of the whole text is one: chosen are the positions whose shingle has the
least hash of some ``SPREAD`` neighbours, so two texts that share ``WINDOW + SPREAD - 1`` = 51 words in a row have at least
one such run in common, wherever the words lie.

Bands are tuned for high recall: lines at Jaccard 0.8 collide in one of 16 bands of 5 rows with probability 0.998. Colliding
lines are verified by exact Jaccard and linked ones are joined to components. Runs are linked when their words are equal
(their Jaccard is 1): all their bands are the same, so one key stands for them and nothing is left to verify. One other
word in the middle of a run takes its Jaccard to 0.68, so bands would add next to nothing; an edited passage is found by
its runs between the edits, and as a line. A component keeps what the document of the smallest (id, text hash) has: of lines
its first one, of runs all of them; the other documents lose theirs. Spans that overlap are removed as one.

Defined results: a null or empty text has no paragraphs. Rows that repeat id and text are one document: they lose the
same spans. Null ids come last in the order, ties go by the text's hash. Spans are in code points, end exclusive,
without the line break. Class keys that two different paragraphs share, which a second key shows, remove nothing. Whole
texts are read; other columns are not.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.scratch import dealt_anew, discard, holding, keep
from weftline.llm.shingles import LOWER, STEP, Seen, Words, mix, set_key, shingles
from weftline.llm.simjoin import similar_components

BANDS, ROWS = 16, 5
WINDOW, SPREAD = 25, 27
HEAD, LINE, RUN = 0, 1, 2
_RANDOM = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * STEP)
FACTORS, TERMS = (_RANDOM[: BANDS * ROWS] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (_RANDOM[BANDS * ROWS :] >> np.uint64(32)).astype(np.uint32)
PLACES = mix(np.arange(101, 101 + BANDS, dtype=np.uint64) * STEP)
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\x0b\x0c\r")] = True


def _slide(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """The least or greatest of each ``width`` neighbours."""
    span = 1
    while 2 * span <= width:
        x, span = pick(x[:-span], x[span:]), 2 * span
    return pick(x[: span - width], x[width - span :]) if span < width else x


def chosen(hashes: np.ndarray, spread: int) -> np.ndarray:
    """Positions that have the least hash of some ``spread`` neighbours; of equal ones in a row, the first."""
    if len(hashes) < spread:
        return np.empty(0, np.int64)
    least = np.pad(_slide(hashes, spread, np.minimum), spread - 1)
    found = _slide(least, spread, np.maximum) == hashes
    found[1:] &= hashes[1:] != hashes[:-1]
    return np.flatnonzero(found)


class Paragraphs:
    """The paragraphs of one whole text: ``lines`` and ``runs`` as arrays of (start, end) in code points, and their
    shingles."""

    def __init__(self, text: str | None, size: int, min_words: int, memory: Words, with_runs: bool = True) -> None:
        raw = (text or "").encode("utf-8", "surrogatepass")
        data = np.frombuffer(raw, np.uint8)
        ids = memory.numbers(raw.translate(LOWER).split())
        self.every = shingles(ids, size) if len(ids) >= size else np.empty(0, np.uint64)
        space = _SPACE[data]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]])))
        first, last = edge[0::2], edge[1::2]  # bytes where words start and end
        places = np.arange(len(raw) + 1) if len(raw) == len(text or "") else np.cumsum(np.concatenate([[0], (data & 0xC0) != 0x80]))  # code points before a byte
        breaks = np.flatnonzero(data == 10)
        bounds = np.concatenate([[0], np.searchsorted(first, breaks), [len(first)]])
        long = np.flatnonzero(np.diff(bounds) >= max(min_words, size))
        self.words = np.stack([bounds[long], bounds[long + 1]], axis=1)
        ends = np.concatenate([breaks, [len(raw)]])
        starts = np.concatenate([[0], breaks + 1])
        self.lines = np.stack([places[starts[long]], places[ends[long]]], axis=1)
        self.size = size
        own = len(ids) - WINDOW + 1
        self.at = chosen(self.every[:own], SPREAD) if with_runs and own >= SPREAD else np.empty(0, np.int64)
        self.runs = np.stack([places[first[self.at]], places[last[self.at + WINDOW - 1]]], axis=1) if len(self.at) else np.empty((0, 2), np.int64)
        self.ids = ids

    def line_items(self) -> Iterator[np.ndarray]:
        """The shingle set of each line."""
        for lo, hi in self.words:
            yield np.unique(self.every[lo : hi - self.size + 1])

    def run_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """A number for the words of each run, and an independent second one."""
        words = self.ids[self.at[:, None] + np.arange(WINDOW)[None, :]]
        cls, second = ((words * w[None, :]).sum(axis=1, dtype=np.uint64) for w in WEIGHTS)
        return mix(cls).view(np.int64), (mix(second) >> np.uint64(33)).astype(np.int32)


#: Odd factors of the words of a run, for two independent sums.
WEIGHTS = mix(np.arange(1001, 1001 + 2 * WINDOW, dtype=np.uint64) * STEP).reshape(2, WINDOW) | np.uint64(1)


def _least(x: np.ndarray, reduce: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    return reduce(x[:, None] * FACTORS[None, :] + TERMS[None, :])


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A row of keys, one a band, for each set. The items are scrambled already, so 32 bits and a linear function each
    make the permutations; sets are taken together up to a bounded number of items."""
    out, at = [], 0
    while at < len(sets):
        to, held = at, 0
        while to < len(sets) and (to == at or held + len(sets[to]) <= 4096):
            held += len(sets[to])
            to += 1
        if held <= 4096:
            x = (np.concatenate(sets[at:to]) >> np.uint64(32)).astype(np.uint32)
            starts = np.cumsum([0, *(len(s) for s in sets[at : to - 1])])
            least = _least(x, lambda y, s=starts: np.minimum.reduceat(y, s, axis=0))
        else:  # one set of many items, in steps
            x = (sets[at] >> np.uint64(32)).astype(np.uint32)
            steps = [_least(x[i : i + 4096], lambda y: y.min(axis=0)) for i in range(0, len(x), 4096)]
            least = np.min(steps, axis=0)[None, :]
        keys = np.repeat(PLACES[None, :], len(least), axis=0)
        for r in range(ROWS):
            keys = keys * STEP + least[:, r::ROWS]
        out.append(mix(keys))
        at = to
    return np.concatenate(out)


NAMES = ["id", "th", "kind", "start", "end", "cls", "second", "n", "keys"]
PLACE_SCHEMA = "th long, kind int, start int, end int, cls long, second int, n int, keys array<long>"
CHUNK = 50_000


def _places(batches: Iterator[pa.RecordBatch], size: int, min_words: int) -> Iterator[pa.RecordBatch]:
    """One head a row with its number of lines in ``n``, and every paragraph, with its band keys unless this task has just
    given those of the same class."""
    memory, seen = Words(), Seen()

    def flush(batch: pa.RecordBatch, parts: list[tuple], fresh: list[np.ndarray]) -> pa.RecordBatch:
        row, kind, start, end, cls, second, n, given = (np.concatenate(x) for x in zip(*parts, strict=True))
        keys = band_keys(fresh).reshape(-1).view(np.int64) if fresh else np.empty(0, np.int64)
        offsets = np.concatenate([[0], np.cumsum(given * BANDS)])
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys), mask=pa.array(given == 0))
        at = pa.array(row, pa.int64())
        small = lambda x: pa.array(x.astype(np.int32), pa.int32())
        return pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("th").take(at), small(kind), small(start), small(end), pa.array(cls, pa.int64()), small(second), small(n), lists], names=NAMES)

    for batch in batches:
        parts, fresh, held = [], [], 0
        for r, t in enumerate(batch.column("text").to_pylist()):
            p = Paragraphs(t, size, min_words, memory)
            zero = np.zeros(1, np.int64)
            parts.append((zero + r, zero + HEAD, zero, zero, zero, zero, zero + len(p.lines), zero))
            if len(p.lines):
                sets = list(p.line_items())
                cls = [set_key(x) for x in sets]
                new = np.array([not seen(c) for c in cls])
                fresh += [x for x, y in zip(sets, new, strict=True) if y]
                second = np.array([set_key(x, 1) & 0x7FFFFFFF for x in sets])
                parts.append((np.full(len(sets), r), np.full(len(sets), LINE), p.lines[:, 0], p.lines[:, 1], np.array(cls, np.int64), second, np.array([len(x) for x in sets]), new.astype(np.int64)))
                held += int(new.sum()) * BANDS
            if len(p.at):
                cls, second = p.run_keys()
                many = len(cls)
                parts.append((np.full(many, r), np.full(many, RUN), p.runs[:, 0], p.runs[:, 1], cls, second, np.full(many, WINDOW - size + 1), np.zeros(many, np.int64)))
                held += many
            if held > CHUNK:
                yield flush(batch, parts, fresh)
                parts, fresh, held = [], [], 0
        if parts:
            yield flush(batch, parts, fresh)


def _items(batches: Iterator[pa.RecordBatch], size: int, min_words: int) -> Iterator[pa.RecordBatch]:
    memory, seen = Words(), Seen()
    for batch in batches:
        cls, rows = [], []
        for t in batch.column("text").to_pylist():
            p = Paragraphs(t, size, min_words, memory, False)
            for items in p.line_items():
                if not seen(c := set_key(items)):
                    cls.append(c)
                    rows.append(items.view(np.int64))
            if len(cls) > CHUNK:
                yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(rows, pa.list_(pa.int64()))], names=["cls", "items"])
                cls, rows = [], []
        if cls:
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(rows, pa.list_(pa.int64()))], names=["cls", "items"])


def repeated(spark: object, texts: DataFrame, places: DataFrame, size: int, percent: int, min_words: int) -> DataFrame:
    """Every paragraph that has its like elsewhere: id, th, start, end, others (whether in another document), lost and
    first (the document that keeps it)."""
    rows = places.filter(F.col("kind") != HEAD)

    def fetch(wanted: DataFrame) -> DataFrame:
        th = rows.filter(F.col("kind") == LINE).groupBy("cls").agg(F.min("th").alias("th")).join(wanted, "cls", "left_semi").select("th").distinct()  # copies are counted out before the join
        some = holding(texts.select("text", "th"), keep(spark, th, "wanted"), "th", once=True).select("text")
        found = some.mapInArrow(lambda it: _items(it, size, min_words), "cls long, items array<long>")
        return holding(found, keep(spark, wanted, "wanted-classes"), "cls").dropDuplicates(["cls"])

    comps = similar_components(spark, rows.filter(F.col("kind") == LINE).select("cls", "n", "keys"), fetch, percent)
    again = rows.groupBy("cls").agg(F.count(F.lit(1)).alias("c"), F.min("second").alias("s"), F.max("second").alias("t"))
    linked = comps.select(F.col("node").alias("cls")).unionByName(comps.select(F.col("component").alias("cls")))
    # a class that two different paragraphs share is left alone
    again = again.filter("c > 1 AND s = t").select("cls").unionByName(linked).distinct()
    again = keep(spark, again, "repeated")
    rows = holding(rows.select("id", "th", "kind", "start", "end", "cls"), again, "cls").join(dealt_anew(comps, "node"), F.col("cls") == F.col("node"), "left")
    rows = keep(spark, rows.select("id", "th", "kind", "start", "end", F.coalesce("component", "cls").alias("comp")).distinct(), "members")
    document = F.struct(F.col("id").isNull().alias("none"), "id", "th")
    place = F.struct(document.alias("d"), "start")
    first = rows.groupBy("comp").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last")
    first = first.select(F.col("comp").alias("k"), "first", (F.col("first.d") != F.col("last.d")).alias("others"))
    found = rows.join(dealt_anew(first, "k"), F.col("comp") == F.col("k"))
    own = document.eqNullSafe(F.col("first.d"))
    lost = F.when(F.col("kind") == RUN, ~own).otherwise(~(own & (F.col("start") == F.col("first.start"))))
    return keep(spark, found.select("id", "th", "start", "end", "others", lost.alias("lost"), F.col("first.d.id").alias("first")), "found")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, min_words: int = 20) -> DataFrame:
    """id, th (the text's hash), n_paragraphs (lines that are long enough), n_shared (paragraphs that another document has
    too, lost or not), n_removed and removed (the spans to remove, in order), chars_removed and kept_in of every row.

    ``kept_in`` has the ids of the documents that keep what this one loses.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    places = keep(spark, texts.mapInArrow(lambda it: _places(it, size, min_words), f"id {kind}, {PLACE_SCHEMA}"), "places")
    found = repeated(spark, texts, places, size, percent, min_words)
    doc = Window.partitionBy("id", "th").orderBy("start", "end")  # one document's spans
    reach = F.max("end").over(doc.rowsBetween(Window.unboundedPreceding, -1))
    lost = found.filter("lost").select("id", "th", "start", "end").distinct().withColumn("reach", reach)
    lost = lost.withColumn("part", F.sum(F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)).over(doc))
    lost = lost.groupBy("id", "th", "part").agg(F.min("start").cast("long").alias("start"), F.max("end").cast("long").alias("end"))
    lost = lost.groupBy("id", "th").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("removed"), F.sum(F.col("end") - F.col("start")).alias("chars_removed"))
    shared = found.groupBy("id", "th").agg(F.count_if(F.col("others")).alias("n_shared"), F.array_sort(F.collect_set(F.when(F.col("lost"), F.col("first")))).alias("kept_in"))
    named = lambda df: df.withColumnRenamed("id", "i").withColumnRenamed("th", "t")
    out = places.filter(F.col("kind") == HEAD).select("id", "th", F.col("n").cast("long").alias("n_paragraphs"))
    # a table of its own, so that the join with a hot text can be split
    side = keep(spark, shared.join(named(lost), F.col("id").eqNullSafe(F.col("i")) & F.col("th").eqNullSafe(F.col("t")), "left").drop("i", "t"), "sides")
    discard(found)
    out = out.join(named(side), F.col("id").eqNullSafe(F.col("i")) & F.col("th").eqNullSafe(F.col("t")), "left").drop("i", "t")
    zero = F.lit(0).cast("long")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    out = out.withColumn("removed", F.coalesce("removed", none)).withColumn("kept_in", F.coalesce("kept_in", F.array().cast(f"array<{kind}>")))
    return out.select(F.col("id").alias(id_col), "th", "n_paragraphs", F.coalesce("n_shared", zero).alias("n_shared"), F.size("removed").cast("long").alias("n_removed"), "removed", F.coalesce("chars_removed", zero).alias("chars_removed"), "kept_in")


def _cut(text: str | None, spans: list) -> str | None:
    if not text or spans is None or not len(spans):
        return text
    at, kept = 0, []
    for s in spans:
        kept.append(text[at : s["start"]])
        at = min(s["end"] + 1, len(text))
    return "".join([*kept, text[at:]])


def remove(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the removed paragraphs cut from their texts."""
    cut = F.pandas_udf(lambda t, s: t.combine(s, _cut), "string")
    side = found.select(F.col(id_col).alias("_i"), F.col("th").alias("_t"), F.col("removed").alias("_r")).dropDuplicates(["_i", "_t"])
    both = docs.join(side, F.col(id_col).eqNullSafe(F.col("_i")) & F.xxhash64(F.col(text_col)).eqNullSafe(F.col("_t")), "left")
    return both.withColumn(text_col, cut(F.col(text_col), F.col("_r"))).select(*docs.columns)
