"""Ranked search, the prefix trie and the positive-unlabelled classifier, against brute force."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import conversation_trie as ct
from weftline.llm import lexical_search as ls
from weftline.llm import pu_quality as pu
from weftline.llm import queries, scan

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute_search(docs, items, k=10):
    texts = [(i, words(t)) for i, t in docs]
    full = [(i, collections.Counter(w), len(w)) for i, w in texts if w]
    count, total = len(full), sum(n for _, _, n in full)
    df = collections.Counter(t for _, c, _ in full for t in c)
    weight = {t: math.floor(1000 * math.log((2 * count + 2) / (2 * d + 1))) for t, d in df.items()}
    terms = collections.defaultdict(collections.Counter)
    for i, t in items:
        terms[i].update(words(t))
    out = []
    for item, wanted in terms.items():
        scores = []
        for i, c, n in full:
            m = 25 + (75 * n * count) // total
            s = sum(times * weight[t] * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, times in wanted.items() if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, **more):
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    terms = ls.item_terms(i)
    return sorted((tuple(r) for r in ls.search(ls.index(d, terms), terms, **more).collect()), key=str)


def test_search_random(spark, monkeypatch):
    rng = random.Random(3)
    vocab = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)]
    docs = [(i, " ".join(rng.choices(vocab, k=rng.randint(0, 60)))) for i in range(300)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(0, 12)))) for i in range(25)]
    want = brute_search(docs, items)
    assert found(spark, docs, items) == want
    monkeypatch.setattr(ls, "MOST_POSTINGS", 40)  # many batches, and below many groups of items
    assert found(spark, docs, items, group=2, k=3) == brute_search(docs, items, 3)


def test_search_edges(spark):
    docs = [(1, "A bé x9"), (1, "A bé x9"), (None, "a"), (2, None), (3, ""), (4, "-- \u0000 !"), (5, "Éa " * 5000 + "zeta"), (6, "a " * 3), (7, "bé")]
    items = [(1, "a Bé zeta"), (1, "a"), (None, "x9"), (2, None), (3, "nothing"), (4, "ÉA zeta zeta")]
    assert found(spark, docs, items) == brute_search(docs, items)
    same = [(i, "same words here") for i in range(40)]
    assert found(spark, same + [(99, "other")], [(0, "words")]) == brute_search(same + [(99, "other")], [(0, "words")])
    assert found(spark, [], items) == [] and found(spark, docs, []) == []
    odd = spark.createDataFrame(docs, "doc_id long, text string").select("*", *(F.lit(0).alias(c) for c in ("row", "term", "score", "rank")))
    terms = ls.item_terms(spark.createDataFrame(items, "item_id long, text string").withColumn("times", F.lit(1)))
    assert sorted((tuple(r) for r in ls.search(ls.index(odd, terms), terms).collect()), key=str) == brute_search(docs, items)
    whole = ls.search(ls.index(odd), terms)  # an index of all terms
    assert sorted((tuple(r) for r in whole.collect()), key=str) == brute_search(docs, items)


@pytest.fixture
def many_ranges(spark):
    """Ranges stay apart, however small they are."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def brute_trie(rows, rebuilt=True):
    own = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append((t is not None, t or 0, r[:64], x[:64], hashlib.md5(f"{r}\0{x}".encode()).hexdigest(), r, x))
    own = {c: [(v[5], v[6]) for v in sorted(vs)] for c, vs in own.items()}
    paths = {}
    for c, turns in own.items():
        h, host = zlib.crc32(str(c).encode()) % 4, c - int(math.fmod(c, 20))
        paths[c] = own.get(host, [])[:h] + turns[h:] if rebuilt else turns
    members, kids = collections.defaultdict(list), collections.defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[tuple(p[:d])].append(c)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved, out = {}, {}, []
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) if kids[k] else 1
        saved[k] = sum(saved[x] for x in kids[k]) + ((len(members[k]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0)
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(paths[c]) == len(k))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie(spark, rows, rebuilt=True):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = ct.ordered(df)
    return sorted((tuple(r) for r in ct.trie(*(ct.branched if rebuilt else ct.whole)(turns)).collect()), key=str)


def test_trie_random(spark, monkeypatch, many_ranges):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "bot"]), rng.choice(["a b", "c", "", "d e f"])) for c in rng.sample(range(-30, 200), 90) for t in range(rng.randint(0, 6)) if rng.random() < 0.9]
    monkeypatch.setattr(ct, "FAN", 2)  # several merges
    assert trie(spark, rows) == brute_trie(rows) and trie(spark, rows, False) == brute_trie(rows, False)


def test_trie_edges(spark):
    """Null ids, turns, roles and texts, ties, repeats, no conversation, turnless ones, long and nested ones."""
    rows = [(1, None, None, None), (1, 0, "u", "x y"), (1, 0, "u", "x z"), (1, 0, "u", "x z"), (None, 0, "u", "lost"), (20, 0, "u", "h1"), (20, 1, "v", "h2 h2"), (21, 5, "u", None), (22, 1, "u", "only"), (45, 0, "u", "no host")]
    rows += [(100 + i, t, "u", f"n{t}") for i in range(12) for t in range(i)]  # each hangs on the one before
    rows += [(c, t, "u", "word " * (t % 3)) for c in (300, 301) for t in range(400)] + [(302, t, "u", "x" * 100_000) for t in range(2)]
    assert trie(spark, rows) == brute_trie(rows) and trie(spark, rows, False) == brute_trie(rows, False)
    assert trie(spark, []) == []
    copies = [(c, t, "u", "hi there") for c in range(0, 4000, 20) for t in range(3)]
    assert trie(spark, copies) == brute_trie(copies)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", *(F.lit(1).alias(c) for c in ("pos", "depth", "conv", "_part", "n")))
    assert sorted((tuple(r) for r in ct.trie(*ct.branched(ct.ordered(df))).collect()), key=str) == brute_trie(rows)


def test_running_over_ranges(spark, many_ranges):
    """One group over many ranges, with ties: the running values are those of one sorted list."""
    rows = [(g, i // 3, i) for g, n in ((1, 900), (2, 5), (3, 0), (4, 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "g long, o long, v long").withColumn("z", F.monotonically_increasing_id())
    out = scan.running(df, "g", [F.col("o"), F.col("z")], {"s": ("sum", F.col("v")), "x": ("xor", F.xxhash64("v"))}).collect()
    assert len({r._part for r in out if r.g == 1}) > 1
    for g in (1, 2, 4):
        mine = sorted((r for r in out if r.g == g), key=lambda r: (r.o, r.z))
        assert [r.s for r in mine] == list(np.cumsum([r.v for r in mine])) and len({r.x for r in mine}) == len(mine)


def blob(rng, good):
    w = ["".join(rng.choices("abdeilmnorst", k=rng.randint(2, 8))) for _ in range(rng.randint(20, 80))]
    if good:
        return ". ".join(" ".join(w[i : i + 9]).capitalize() for i in range(0, len(w), 9)) + "."
    return rng.choice([" | ".join(w), " ".join(x + "$$$" for x in w), " ".join(x.upper() + "!!" for x in w), " ".join([w[0]] * 60)])


@pytest.fixture(scope="module")
def learnt(spark):
    rng = random.Random(11)
    kinds = [rng.random() < 0.75 for _ in range(1500)]
    docs = spark.createDataFrame([(i, blob(rng, good)) for i, good in enumerate(kinds)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(g)) for i, g in enumerate(kinds) if i % 3 == 0], "doc_id long, quality int")
    rows = pu.featured(docs)
    return kinds, docs, labels, rows, pu.train(rows, labels)


def test_prior_and_held_out(learnt):
    """The prior is near the share that it was made with, and rows without a label are told apart."""
    kinds, _, _, rows, model = learnt
    assert abs(model.prior - sum(kinds) / len(kinds)) < 0.06
    out = {r.doc_id: r for r in pu.score(rows, model).collect()}
    rest = [i for i in range(len(kinds)) if i % 3]
    assert sum(out[i].predicted == kinds[i] for i in rest) / len(rest) > 0.97 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out.values())


def test_negatives_are_not_used(learnt):
    """Turning the labels of 0 into no labels changes nothing."""
    _, _, labels, rows, model = learnt
    assert np.allclose(pu.train(rows, labels.filter("quality = 1")).weights, model.weights)


def test_risk_and_gradient():
    """The sums give the risk as written down, and its gradient is that of finite differences, on both sides of zero."""
    rng = np.random.default_rng(1)
    x = rng.random((60, pu.SIZE))
    trusted = np.arange(60) < 25
    x[:, 0] = 1.0
    x[trusted, 1:20] += 0.6
    soft = lambda z: np.log1p(np.exp(z))

    def direct(w, prior):
        p, u = x[trusted] @ w, x @ w
        return prior * soft(-p).mean() + max(0.0, soft(u).mean() - prior * soft(p).mean())

    signs = set()
    for prior, scale in ((0.3, 0.1), (0.9, 0.5), (0.99, -0.5), (0.99, 1.0)):
        w = np.zeros(pu.SIZE)
        w[0], w[1:20] = -15.0 * scale, scale * np.abs(rng.normal(1.0, 0.1, size=19))
        cost, negative, down, _ = pu.risk(pu.sums_at(x, trusted, w[None])[: 5 + 3 * pu.SIZE + 2 * pu.SIZE**2], prior)
        assert np.isclose(cost, direct(w, prior))
        signs.add(negative >= 0)
        part = direct if negative >= 0 else lambda v, q: q * soft(x[trusted] @ v).mean() - soft(x @ v).mean()
        for j in range(0, pu.SIZE, 7):
            e = np.zeros(pu.SIZE)
            e[j] = 1e-5
            assert np.isclose(down[j], (part(w + e, prior) - part(w - e, prior)) / 2e-5, atol=1e-5)
    assert signs == {True, False}


def test_parts_add_up(spark, learnt):
    """The pass over Spark gives the sums of one array."""
    _, _, labels, rows, model = learnt
    table = rows.join(labels.filter("quality = 1").select(F.col("doc_id").alias("id"), F.lit(True).alias("t")), "id", "left").select("x", F.coalesce("t", F.lit(False)).alias("trusted"))
    all_rows = table.toPandas()
    x = np.stack(all_rows.x.to_numpy()).astype(float)
    points = np.stack([model.weights, 0 * model.weights])
    assert np.allclose(pu._added_up(table, points).ravel(), pu.sums_at(x, all_rows.trusted.to_numpy(), points))


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "Some words here."), (3, "A b. C d."), (3, "A b. C d."), (4, "x " * 200_000)], "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("quality", F.lit(1))
    rows = pu.featured(docs)
    labels = lambda *r: spark.createDataFrame(list(r), "doc_id long, quality int")
    nothing = pu.train(rows, labels((1, None), (None, 1), (3, 1), (3, 0), (4, 0)))
    assert nothing.weights is None and [r.score for r in pu.score(rows, nothing).collect()] == [0.0] * 6
    model = pu.train(rows, labels((3, 1), (3, 1)))
    out = pu.score(rows, model).collect()
    assert len(out) == 6 and all(0 <= r.score <= 1 for r in out)
    empty = pu.featured(docs.limit(0))
    assert pu.score(empty, pu.train(empty, labels((1, 1)))).count() == 0
    assert len(pu.features("a")) == pu.SIZE and all(0 <= v <= 1 for v in pu.features("!!! é 9" * 50))


def test_queries(spark):
    """The registered queries over whole tables."""
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    pairs = lambda df, *c: [tuple(r) for r in df.select(*c).collect()]
    got = sorted((tuple(r) for r in queries.op11_lexical_search(spark, SF).select("item_id", "rank", "doc_id", "score").collect()), key=str)
    assert got == brute_search(pairs(docs, "doc_id", "text"), pairs(items, "item_id", "text"))
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    got = sorted((tuple(r) for r in queries.op12_conversation_trie(spark, SF).collect()), key=str)
    assert got == brute_trie(pairs(turns, "conv_id", "turn", "role", "text"))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries.op13_pu_quality(spark, SF).collect()
    assert len(rows) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.9 * len(held)
