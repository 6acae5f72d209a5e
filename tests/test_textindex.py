"""The trigram index against scans."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import text as T
from weftline.operators import textindex
from weftline.operators.textindex import TextIndex, grams_of


def made(n, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé_.(", k=rng.randint(1, 7))) for _ in range(300)]
    return [(f"src/d{i % 17}/f{i:04}.ts", "\n".join(" ".join(rng.choices(words, k=rng.randint(0, 8))) for _ in range(rng.randint(0, 12)))) for i in range(n)]


def rows_read(df):
    """Rows that the scans of a plan gave out when it ran."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().get("numOutputRows").get().value() for i in range(leaves.size()) if leaves.apply(i).metrics().contains("numOutputRows"))


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    rows = made(600)
    files = spark.createDataFrame(rows, "path string, content string").repartition(3)
    return rows, files, TextIndex.build(files, str(tmp_path_factory.mktemp("index") / "i"))


def test_same_lines(both):
    """The lines with a text are those of a scan, for texts that are there, that are not, short ones and odd ones."""
    rows, files, index = both
    rng = random.Random(2)
    texts = [c[a : a + k] for c in rng.sample([c for _, c in rows if len(c) > 30], 12) if (a := rng.randrange(len(c) - 20)) >= 0 and "\n" not in c[a : a + (k := rng.choice([3, 5, 9, 14]))]]
    for text in [*texts, "zzz", "abczzz", "a", "é_", "(", "%_"]:
        want = sorted(p for p, c in rows if any(text in line for line in c.split("\n")))
        assert [r.path for r in index.holding(text).collect()] == want
        got = index.lines(text).filter(F.contains("text", F.lit(text)))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, T.scan_lines(files).filter(F.contains("text", F.lit(text))).collect()))
    some = [t for t in texts if len(t) >= 5][:4]
    either = lambda df: sorted(map(tuple, df.filter(" OR ".join(f"contains(text, '{t}')" for t in some)).collect()))
    assert either(index.lines(*some)) == either(T.scan_lines(files))


def test_operators_over_the_index(both):
    """A search over the index gives the rows of a search over all lines."""
    rows, files, index = both
    text = next(w for _, c in rows for w in c.split() if len(w) >= 6)
    columns = ["path", "match_count", "category", "n_files", "truncated"]
    assert T.search_literal(index.lines(text), text, limit=5).select(columns).collect() == T.search_literal(T.scan_lines(files), text, limit=5).select(columns).collect()
    assert T.count_literal_files(index.lines(text), text).collect() == T.count_literal_files(T.scan_lines(files), text).collect()


def test_few_rows_are_read(spark, tmp_path):
    """A rare text reads under a tenth of the files, and of the postings."""
    files = spark.createDataFrame([*made(3000, 5), ("src/d3/needle.ts", "one\nthe Needle, here\n")], "path string, content string")
    index = TextIndex.build(files, str(tmp_path / "i"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = index.files(["the Needle"])
        assert [r.path for r in found.collect()] == ["src/d3/needle.ts"] and rows_read(found) < 300
        assert rows_read(index._postings(sorted(grams_of("the Needle")))) < index.grams.count() / 10
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_many_candidates_and_blocks(spark, tmp_path, monkeypatch):
    """More files than are read by number, and small blocks."""
    monkeypatch.setattr(textindex, "NUMBERED", 5)
    monkeypatch.setattr(textindex, "BLOCK_FILES", 7)
    rows = made(200, 9)
    index = TextIndex.build(spark.createDataFrame(rows, "path string, content string").repartition(4), str(tmp_path / "i"))
    for text in ("abc", "a", rows[7][1][:5]):
        assert [r.path for r in index.holding(text).collect()] == sorted(p for p, c in rows if text in c)


def test_edges(spark, tmp_path):
    """Null and empty contents, a path twice, a very long file, no file at all."""
    rows = [("a.ts", None), ("b.ts", ""), ("c.ts", "say hello\r\nworld"), ("c.ts", "hello"), (None, "hello"), ("long.ts", "ab " * 300_000 + "hello"), ("n.ts", "hel\nlo")]
    index = TextIndex.build(spark.createDataFrame(rows, "path string, content string").withColumn("number", F.lit(1)).withColumn("gram", F.lit("x")), str(tmp_path / "i"))
    assert [r.path for r in index.holding("hello").collect()] == ["c.ts", "long.ts"] and index.texts.count() == 6
    assert index.lines("hello").filter("text = 'say hello'").count() == 1 and [r.path for r in index.holding("hel\nlo").collect()] == ["n.ts"]
    empty = TextIndex.build(spark.createDataFrame([], "path string, content string"), str(tmp_path / "e"))
    assert empty.holding("hello").count() == 0 and empty.lines("x").count() == 0
