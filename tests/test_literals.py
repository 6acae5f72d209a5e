"""Many literals, owner spans and the search from both ends, against brute force."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from weftline.operators import literals as L
from weftline.operators import text as T
from weftline.operators import traverse as V

EDGES = "type string, src string, dst string, source_file string, start_line long, confidence double"


def all_places(lines, terms, words=False):
    inside = lambda c: c.isalnum() or c in "_$"
    out = []
    for path, number, text in lines:
        for t in {t for t in terms if t}:
            at = (text or "").find(t)
            while at >= 0:
                if not words or not (at and inside(text[at - 1]) or at + len(t) < len(text) and inside(text[at + len(t)])):
                    out.append((path, number, t, at))
                at = text.find(t, at + 1)
    return sorted(out)


def test_occurrences(spark):
    rng = random.Random(7)
    lines = [(f"f{i % 5}", i, "".join(rng.choices("ab_é$ x", k=rng.randint(0, 30)))) for i in range(150)] + [("f9", 1, None), ("f9", 2, "")]
    terms = ["a", "ab", "aba", "_", "é$", "bb", "x a", "", None, "ab", "zzz"]
    df, ts = spark.createDataFrame(lines, "path string, line_no long, text string"), spark.createDataFrame([(t,) for t in terms], "term string")
    for words in (False, True):
        assert sorted(map(tuple, L.occurrences(df, ts, words).collect())) == all_places(lines, terms, words)
    assert sorted(map(tuple, L.occurrences(df, ts, slice_size=2).collect())) == all_places(lines, terms)  # several passes
    assert L.occurrences(df, ts.limit(0)).count() == 0 and L.occurrences(df.limit(0), ts).count() == 0


def test_fifty_thousand_terms(spark):
    terms = spark.range(50_000).select(F.concat(F.lit("term_"), F.col("id").cast("string"), F.lit(";")).alias("term"))
    lines = spark.range(3000).select(F.lit("a").alias("path"), F.col("id").alias("line_no"), F.concat(F.lit("use term_"), (F.col("id") * 37).cast("string"), F.lit("; and term_7;")).alias("text"))
    found = L.occurrences(lines, terms)
    assert found.filter("term = 'term_7;'").count() == 3000 and found.filter("term <> 'term_7;'").count() == sum(i * 37 < 50_000 and i * 37 != 7 for i in range(3000))


def test_importers_by_expression_and_by_automaton(spark, monkeypatch):
    """Few terms and many give the same files and counts."""
    lines = spark.createDataFrame([(f"src/f{i}.ts", j, f"import x from 'lib/mod{(i * j) % 9}';") for i in range(20) for j in range(6)] + [("src/img.png", 1, "lib/mod1"), ("lib/mod1.ts", 1, "lib/mod2")], "path string, line_no long, text string")
    seeds = spark.createDataFrame([(f"lib/mod{i}.ts",) for i in range(4)], "path string")
    few = sorted(map(tuple, T.path_set_importers(lines, seeds).collect()))
    monkeypatch.setattr(T, "FEW_TERMS", 2)
    assert few and sorted(map(tuple, T.path_set_importers(lines, seeds).collect())) == few
    assert T.path_set_importers(lines, seeds.limit(0)).count() == 0


def test_spans_equal_the_windows(spark):
    """Every line gets the owner that the windows give, for nested, unclosed and cut-off functions and long files."""
    rng, rows = random.Random(3), []
    parts = ["function f{}() {{", "}}", "  x();", "// note }}", "const g{} = () => {{", "if (a) {{ b(); }}", "", "}} else {{", "export function h{}() {{ return 1; }}"]
    for f in range(12):
        rows += [(f"f{f}.ts", i + 1, rng.choice(parts).format(i)) for i in range(rng.choice([3, 40, 300]))]
    lines = spark.createDataFrame(rows, "path string, line_no long, text string")
    spans = T.owner_spans(lines)
    want = sorted(map(tuple, T.with_owner(lines).select("path", "line_no", "seg", "after_end", "owner").collect()))
    assert sorted(map(tuple, T.attributed(lines, spans).select("path", "line_no", "seg", "after_end", "owner").collect())) == want
    few = lines.filter("line_no % 7 = 0")
    assert sorted(map(tuple, T.attributed(few, spans).select("path", "line_no", "seg", "after_end", "owner").collect())) == [w for w in want if w[1] % 7 == 0]
    assert T.attributed(few, spans.limit(0)).filter("owner <> '' OR seg > 0").count() == 0


def smallest_path(edges, a, b, depth):
    """Breadth first from one side: of the shortest paths that with the smallest edges."""
    near = {}
    for e in edges:
        name = "|".join([e[0], e[1], e[2], e[3], str(e[4])])
        near.setdefault(e[1], set()).add((name, e[2]))
        near.setdefault(e[2], set()).add((name, e[1]))
    level, seen = {a: ([], [a])}, {a}
    for _ in range(depth):
        new = {}
        for x, (es, ns) in level.items():
            for name, y in near.get(x, ()):
                if y not in seen and (y not in new or (es + [name], ns + [y]) < new[y]):
                    new[y] = (es + [name], ns + [y])
        if b in new:
            return new[b][1], new[b][0]
        seen |= set(new)
        level = new
    return None


def test_search_from_both_ends(spark):
    rng = random.Random(8)
    edges = [("CALLS", f"n{rng.randrange(60):02}", f"n{rng.randrange(60):02}", "f", rng.randrange(3), None) for _ in range(75)] + [("CALLS", "hub", f"leaf{i}", "f", 1, None) for i in range(80)] + [("CALLS", "n05", "hub", "f", 1, None)]
    edges += [("CALLS", f"c{i}", f"c{i + 1}", "f", 1, None) for i in range(9)]
    df = spark.createDataFrame(edges, EDGES)
    for a, b, depth in [("n01", "n40", 8), ("n02", "leaf7", 8), ("c0", "c8", 8), ("c0", "c9", 8), ("n03", "n03", 4), ("n03", "gone", 4)]:
        got = [(r.nodes, r.edges) for r in V.shortest_path(spark, df, a, b, depth).collect()]
        want = smallest_path(edges, a, b, depth) if a != b else None
        assert got == ([want] if want else []), (a, b)
    # the side that is narrow grows: the hub's leaves are never reached
    star = spark.createDataFrame([("CALLS", "hub", f"leaf{i}", "f", 1, None) for i in range(500)] + [("CALLS", f"c{i}", f"c{i + 1}", "f", 1, None) for i in range(4)] + [("CALLS", "c4", "hub", "f", 1, None)], EDGES)
    rows, expanded = V.search_path(spark, star, "c0", "hub", 8)
    assert rows.first().nodes == ["c0", "c1", "c2", "c3", "c4", "hub"] and expanded < 20
