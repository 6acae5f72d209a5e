"""Each operator against its brute-force version, and on odd input."""

from __future__ import annotations

import hashlib
import math
import os
import random
import zlib

import brute
import pytest
from pyspark.sql import functions as F

from weftline.llm import components, decontam, line_templates, mixing, ngram_join, paragraph_dedup, pii, quality, scratch, shingles, simjoin, toxicity, url_rules, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, h string, th long, words string, cls long, key long"
LONG = " ".join(f"w{i % 997} x" for i in range(40_000))


def documents(spark, rows):
    """A table with columns that clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", s, 0, "id", "h", 1, "words", 2, 3) for i, t, s in rows], SCHEMA).repartition(3)


def odd_rows():
    prose = "The quick brown fox jumps over the lazy dog and runs away from the very angry bear of the north woods today."
    return [
        (1, None, "a"), (2, "", "b"), (3, " \n\t ", None), (4, prose, "a"), (5, prose, "a"), (5, prose, "a"), (6, prose + " End", "b"), (7, LONG, None), (None, prose, "c"),
        (8, "mail me: A.b+c@x-y.example.com, or +1 (456) 555-2186; 4111 1111 1111 1111 at 10.0.0.255 or 10.0.0.256", "c"), (9, "a@b.c_d@e.f a@b a@b.c.@x.y", "c"), (10, "Écrivez à jean@exemple.fr 👍 1.2.3.4.5", "c"),
        (11, "9" * 5000 + "@" + "a." * 3000, "c"), (12, "z" * 200_000, "c"), (13, "one two", "c"), (14, "One TWO", "c"), (15, "\r\n\x0b\x0cword\x85next\u00a0w", "c"),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, odd_rows()).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_pii(spark, odd, empty):
    got = sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.find(odd).collect()), key=str)
    assert got == sorted(((i, *brute.personal(t)[:5]) for i, t, _ in odd_rows()), key=str)
    assert pii.find(empty).count() == 0


def test_pii_discovers_by_context(spark):
    rows = [(i, f"Hello there, write to me at user{i}@mail.example.com please.", "s") for i in range(40)] + [(99, "Hello there, write to me at user99@localhost please.", "s"), (100, "see user100@localhost", "s")]
    got = {r.doc_id: r for r in pii.find(documents(spark, rows)).collect()}
    assert got[99].n_discovered == 1 and got[99].n_email == 0 and got[99].spans.startswith("email:28:")
    assert got[100].n_discovered == 0 and got[1].spans == brute.personal(rows[1][1])[5]


def test_long_texts_take_linear_time(spark):
    """One text of many identifiers, and one of 200,000 lines: seconds, not hours."""
    text = " ".join(f"mail user{i}@mail.example.com from 10.0.{i % 256}.7 or +1 (456) 555-{1000 + i % 9000}" for i in range(20_000))
    got = pii.find(documents(spark, [(1, text, "s")])).first()
    assert (got.n_email, got.n_ip, got.n_card, got.n_phone, got.base_sha256, got.spans) == brute.personal(text)
    lines = "\n".join("All rights are reserved here" if i % 2 else f"own line {i}" for i in range(200_000))
    rows = [(1, lines, "s")] + [(i, f"text {'abcdefghijklmnopqrstuvwxyz'[i % 26]}{i}z\nAll rights are reserved here", "s") for i in range(2, 40)]
    got = {r.doc_id: r for r in line_templates.drop_lines(documents(spark, rows)).collect()}
    assert got[1]._dropped >= 100_000 and "reserved" not in got[1].text


def luhn_card(i):
    body = f"4{i:014d}"
    return body + next(d for d in "0123456789" if brute.luhn(body + d))


def test_pii_discovers_numbers_in_groups(spark):
    cards = [" ".join(c[k : k + 4] for k in range(0, 16, 4)) for c in map(luhn_card, range(40))]
    rows = [(i, f"Please ring our office on +1 ({200 + i}) 555-{1000 + i} before noon.", "s") for i in range(40)]
    rows += [(100 + i, f"The order was paid with {c} last week.", "s") for i, c in enumerate(cards)]
    filler = "of many plain words without any mark " * 5
    rows += [(200 + i, f"Now report user{i}@mail.example.com because {filler} see x{i}y17.", "s") for i in range(40)]
    texts = {1000: ("Please ring our office on 555 123 4567 before noon.", "phone", "555 123 4567"), 1001: ("Please ring our office on (555) 123-4567 before noon.", "phone", "(555) 123-4567"),
             1002: ("The order was paid with 4111 1111 1111 1112 last week.", "card", "4111 1111 1111 1112"), 1003: (f"Report! report user@localhost because {filler} see x.", "email", "user@localhost")}
    got = {r.doc_id: r for r in pii.find(documents(spark, rows + [(i, t[0], "s") for i, t in texts.items()])).collect()}
    for i, (text, kind, found) in texts.items():
        at = text.index(found)
        assert got[i].spans == f"{kind}:{at}:{at + len(found)}", (i, got[i].spans)


def test_pii_unseen_are_no_evidence_against(spark):
    rows = [(i, f"They asked to write to user{i}@mail.example.com again.", "s") for i in range(8)] + [(100 + i, f"They asked to write to new{i}@localhost again.", "s") for i in range(8)]
    rows += [(200 + i, f"Our firm will deliver parcel user{i}@mail.example.com soon.", "s") for i in range(8)] + [(300 + i, f"Our firm will deliver parcel box{i}0000 soon.", "s") for i in range(8)]
    rows += [(400, "Our firm will deliver parcel other@localhost soon.", "s")]
    got = {r.doc_id: r.n_discovered for r in pii.find(documents(spark, rows)).collect()}
    assert got == {i: int(100 <= i < 108) for i, *_ in rows}


def check_tilt(rows, most):
    """Rates solve the balancing problem: min(bound, exp(lambda * sqrt(size))) with one lambda a source, and their sum over
    words is the target. Found here by bisection, source by source."""
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    for own in by.values():
        target = own[0].target
        total = lambda lam, own=own: sum(r.size * min(most, math.exp(min(50.0, lam * math.sqrt(r.size)))) for r in own)
        lo, hi = -50.0, 50.0
        for _ in range(200):
            lo, hi = ((lo + hi) / 2, hi) if total((lo + hi) / 2) < target else (lo, (lo + hi) / 2)
        for r in own:
            want = min(most, math.exp(min(50.0, hi * math.sqrt(r.size)))) if r.size else 0.0
            assert abs(r.rate - want) < 2e-3 * max(1.0, want), (r, want)
            assert r.copies in (math.floor(r.rate), math.floor(r.rate) + 1, math.floor(r.rate + 1e-3))


def test_mixing_misses_by_a_small_document(spark):
    """Long documents among short ones: the one at the threshold doesn't decide."""
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * (5000 if i % 40 == 0 else rng.randint(1, 300))), f"s{i % 4}") for i in range(600)]
    got = mixing.mix(documents(spark, rows)).collect()
    taken = {}
    for r in got:
        taken.setdefault((r.source, r.target), []).append(r.taken)
    assert all(abs(sum(v) - t) <= 0.005 * t for (_, t), v in taken.items())


def test_mixing_of_repeated_rows(spark):
    """A row that is 40 in 100 of its source, and different texts under one id: each row is dealt copies of its own, and the
    outcome doesn't depend on partitions."""
    rng = random.Random(9)
    text = lambda n: " ".join(["w"] * n)
    rows = [(1, text(100), "a")] * 40 + [(100 + i, text(rng.randint(20, 180)), "a") for i in range(60)] + [(7, text(rng.randint(1, 90)), "b") for _ in range(80)] + [(None, text(50), "c")] * 100 + [(900 + i, text(rng.randint(30, 60)), "c") for i in range(100)]
    got = mixing.mix(documents(spark, rows).repartition(5)).collect()
    by = {}
    for r in got:
        by.setdefault((r.source, r.target), []).append(r)
        assert r.taken <= 3 * r.size
    for (_, target), own in by.items():
        assert abs(sum(r.taken for r in own) - target) <= max(0.01 * target, min(r.size for r in own) / 2)
    once = lambda rs: sorted(str((r.doc_id, r.source, r.size, r.copies)) for r in rs)
    assert len(got) == len(rows) and once(got) == once(mixing.mix(documents(spark, rows).coalesce(1)).collect())


def test_mixing(spark, odd, empty):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randint(1, 60)), f"s{i % 7 if i % 3 else 0}") for i in range(3000)] + [(5000, None, None), (5001, "a b", None)]
    got = mixing.mix(documents(spark, rows)).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(documents(spark, rows)).collect()))
    by = {}
    for r in got:
        a = by.setdefault(r.source, [0, 0, r.target, r.source_size])
        a[0] += r.size
        a[1] += r.taken
        assert r.taken <= 3 * r.size and r.taken == r.copies * r.size
    total, order = sum(a[0] for a in by.values()), sorted(by, key=lambda s: (s is None, s))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), float(total)
    while free:
        per = left / sum(weight[s] for s in free)
        over = {s for s in free if per * weight[s] > 3 * by[s][0]}
        for s in over or set(free):
            target[s] = 3 * by[s][0] if over else per * weight[s]
        left -= sum(target[s] for s in over)
        free -= over or set(free)
    for s, (size, taken, t, declared) in by.items():
        assert declared == size and abs(t - target[s]) < 1e-6 * max(1, target[s])
        assert abs(taken - t) <= max(2, 0.002 * t)
    assert mixing.mix(empty).count() == 0
    check_tilt(got, 3.0)
    sizes = sorted(((r.doc_id, r.size) for r in mixing.mix(odd).collect()), key=str)
    assert sizes == sorted(((i, len(brute.SPACED.findall(t or ""))) for i, t, _ in odd_rows()), key=str)


def test_decontamination(spark, odd, empty):
    items = [(1, "The quick brown fox jumps over the LAZY dog and runs away from it"), (2, "one two"), (3, None), (4, "..."), (None, "jumps over the lazy"), (2, "one two"), (7, "z" * 200_000)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = odd_rows()
    want = sorted((str(i), *b) for (i, _, _), b in zip(rows, brute.contaminated([t for _, t, _ in rows], items), strict=True))
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.find(odd, bench).collect()) == want
    assert decontam.find(empty, bench).count() == 0
    assert decontam.find(odd, bench.limit(0)).filter("contaminated").count() == 0


def test_decontamination_in_slices(spark, monkeypatch):
    rng = random.Random(1)
    text = lambda n: " ".join(rng.choice("abcdefghij") + rng.choice("xyz") for _ in range(n))
    rows = [(i, text(60), "s") for i in range(60)]
    items = [(i, " ".join(rows[i][1].split()[k : k + 13])) for i, k in ((1, 0), (5, 20), (9, 47), (9, 3))] + [(50 + i, text(2)) for i in range(5)]
    monkeypatch.setattr(decontam, "SLICE_ROWS", 7)
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.find(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {i: b for (i, _, _), b in zip(rows, brute.contaminated([t for _, t, _ in rows], items), strict=True)}


def test_warc_round_trip(spark):
    html = ["<p>é\r\n\r\nWARC/1.1\r\n\r\n</p>", "x", "", None, "x", "x", "y" * 300_000]
    rows = [(i, f"http://h/{i}" if i % 2 else None, t) for i, t in enumerate(html)] + [(None, "http://n/\r\nX: y", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.id: r for r in warc.archive(spark, pages).collect()}
    assert len(got) == len(rows)
    for i, _, t in rows:
        r, data = got[None if i is None else str(i)], (t or "").encode()
        assert r.intact and r.payload_bytes == len(data)
        assert r.payload_digest == warc.base64.b32encode(hashlib.sha1(data).digest()).decode()
        same = [j for j, _, u in rows if (u or "") == (t or "") and j is not None]
        assert (r.record_type, r.refers_to) == (("response", None) if i == max(same) else ("revisit", str(max(same))))
    assert warc.archive(spark, pages.limit(0), warc.new_path(spark, "none")).count() == 0
    clash = pages.select("*", *(F.lit(1).alias(c) for c in ("id", "payload", "digest", "bytes", "key", "first", "d", "b", "record_type")))
    assert sorted(map(str, warc.archive(spark, clash).collect())) == sorted(map(str, got.values()))


def test_warc_members(spark):
    """Every record is a gzip member of its own, each file begins with a warcinfo record, files are bounded by bytes, ids of
    different captures differ, and files that the manifest doesn't list are deleted."""
    rows = [(i // 2, f"http://h/{i % 3}", os.urandom(400).hex() if i % 5 else "same") for i in range(60)]
    path = warc.new_path(spark, "members")
    folder = warc._place(path)[1]
    os.makedirs(folder)
    with open(folder + "/lost.warc.gz", "wb") as f:
        f.write(b"not whole")
    manifest = warc.write_archives(warc.resolve(spark.createDataFrame(rows, "page_id long, url string, html string")), path, part_bytes=5000).collect()
    files = sorted(x for x in os.listdir(folder) if x.endswith(".warc.gz"))
    assert files == sorted(r.name for r in manifest) and sum(r.records for r in manifest) == 60 and len(files) > 3
    ids = set()
    for name in files:
        with open(f"{folder}/{name}", "rb") as f:
            data = f.read()
        assert len(data) < 5000 + 2000
        kinds = []
        while data:
            d = zlib.decompressobj(31)
            text = d.decompress(data)
            data = d.unused_data
            ((headers, _),) = warc._records(iter([text]))
            kinds.append(headers["warc-type"])
            ids.add(headers["warc-record-id"])
            if headers["warc-type"] == "revisit":
                assert headers["warc-refers-to"] and headers["warc-profile"]
        assert kinds[0] == "warcinfo" and "warcinfo" not in kinds[1:]
    assert len(ids) == len(files) + len({(i, u, t) for i, u, t in rows})


def test_warc_shuffles_no_payloads(spark):
    """Without broadcasts, the exchange of payloads stands behind the bitmap of repeated digests."""
    rows = [(i, "u", f"body {i % 90}") for i in range(100)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = warc.resolve(spark.createDataFrame(rows, "page_id long, url string, html string"))
        single = out.filter("record_type = 'response'").count()
        plan = out._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert single == 90 and plan.count("bitmap_construct_agg") >= 2 and plan.index("Join LeftOuter, ((digest") < plan.index("getbit")


def test_warc_keeps_payloads(spark):
    rows = [(i, "u", f"body {i}\r\n\r\nmore") for i in range(5)]
    path = warc.new_path(spark, "archive")
    warc.write_archives(warc.resolve(spark.createDataFrame(rows, "page_id long, url string, html string")), path, part_bytes=600)
    assert sorted((r.id, r.payload) for r in warc.read_archives(spark, path, True).collect()) == [(str(i), t) for i, _, t in rows]


@pytest.mark.parametrize("kind", ["random", "near"])
def test_ngram_join_is_exact(spark, kind):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60 if kind == "random" else 5000)]
    rows = []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 5, 8, 12, 30, 80, 300]))]
        for _ in range(rng.randint(1, 12)):
            t = list(base)
            for _ in range(rng.randint(0, 1 + len(t) // 25)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((len(rows), " ".join(t), "s"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(documents(spark, rows)).collect()}
    assert got == brute.components([(i, t) for i, t, _ in rows])


def test_ngram_join_odd(spark, odd, empty):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(odd).collect()}
    want = brute.components([(i, t) for i, t, _ in odd_rows() if i is not None])
    want[None] = want[4]
    assert got == want
    assert ngram_join.join(empty).count() == 0


def test_signatures_meet():
    """Linked sets share a key, whatever their sizes and empty segments."""
    rng, bands = random.Random(5), ngram_join.Bands(85)
    for _ in range(3000):
        n = rng.choice([3, 6, 7, 8, 13, 14, 20, 40, 150])
        a = {rng.getrandbits(64) for _ in range(n)}
        b = set(a)
        for _ in range(rng.randint(0, 1 + n // 6)):
            b.discard(next(iter(b))) if rng.random() < 0.5 and len(b) > 1 else b.add(rng.getrandbits(64))
        if brute.linked(a, b, 85):
            x, y = (set(ngram_join.signatures(ngram_join.np.array(sorted(s), dtype=ngram_join.np.uint64), bands).tolist()) for s in (a, b))
            assert x & y, (len(a), len(b), len(a & b))


def test_paragraphs(spark, odd, empty):
    rng = random.Random(11)
    text = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    passage = text(60)
    near = passage.split()
    near[30] = "other"
    rows = [(i, "\n".join([text(40), passage if i % 3 else " ".join(near), text(25), "short line"]), "s") for i in range(12)]
    got = {r.doc_id: r for r in paragraph_dedup.find(documents(spark, rows)).collect()}
    assert got[0].n_removed == 0 and all(got[i].n_removed == 1 and set(got[i].kept_in) in ({0}, {0, 1}) for i in range(1, 12))
    for i, t, _ in rows[1:]:
        s = got[i].removed[0]
        assert t[s.start : s.end] in (passage, " ".join(near))
    docs = documents(spark, rows)
    cut = {r.doc_id: r.text for r in paragraph_dedup.remove(docs, paragraph_dedup.find(docs)).collect()}
    assert cut[1] == "\n".join([rows[1][1].split("\n")[k] for k in (0, 2, 3)]) and cut[0] == rows[0][1]
    assert paragraph_dedup.find(odd).count() == len(odd_rows()) and paragraph_dedup.find(empty).count() == 0
    got = {}
    for r in paragraph_dedup.find(odd).collect():
        got.setdefault(r.doc_id, []).append((r.n_paragraphs, r.n_shared, r.n_removed))
    assert got[1] == got[2] == got[3] == [(0, 0, 0)] and got[4] == [(1, 1, 0)] and got[5] == [(1, 1, 1)] * 2 and got[None] == [(1, 1, 1)] and got[13] == [(0, 0, 0)]


def words_of(text):
    return brute.SPACED.findall((text or "").translate(brute.FOLD))


def test_passages_everywhere(spark):
    """Every text that has 51 words in a row of another text is found, wherever they lie: inside a longer line, over many
    short lines, in other case; texts without are left alone; what goes is held against all pairs."""
    rng = random.Random(21)
    word = lambda: f"é{rng.randrange(5000)}" if rng.random() < 0.2 else f"w{rng.randrange(5000)}"
    own = lambda n: [word() for _ in range(n)]
    passages = [own(n) for n in (51, 52, 60, 90)]
    rows = []
    for i in range(120):
        before, after = own(rng.randint(0, 120)), own(rng.randint(0, 120))
        if i % 2:
            p = [w.upper() if i % 5 == 0 else w for w in passages[i % 4]]
            whole = before + p + after
        else:
            whole = before + own(60) + after
        step = rng.choice([8, 12, 1000])
        rows.append((i, "\n".join(" ".join(whole[k : k + step]) for k in range(0, len(whole), step)), "s"))
    docs = documents(spark, rows)
    found = paragraph_dedup.find(docs)
    got = {r.doc_id: r for r in found.collect()}
    where = {}
    for i, t, _ in rows:
        w = words_of(t)
        for k in range(len(w) - 50):
            where.setdefault(tuple(w[k : k + 51]), set()).add(i)
    shared = {i for v in where.values() if len(v) > 1 for i in v}
    later = {i for v in where.values() if len(v) > 1 for i in v if i != min(v)}
    assert {i for i, r in got.items() if r.n_shared} == shared and {i for i, r in got.items() if r.n_removed} == later
    runs = {}
    for i, t, _ in rows:
        w = words_of(t)
        for k in range(len(w) - 24):
            runs.setdefault(tuple(w[k : k + 25]), set()).add(i)
    for i, t, _ in rows:  # what goes from a text stands in a text before it
        for s in got[i].removed:
            w = words_of(t[s.start : s.end])
            before = [min(runs[tuple(w[k : k + 25])]) < i for k in range(len(w) - 24)]
            assert len(w) >= 20 and sum(before) >= 0.8 * len(before)
    cut = {r.doc_id: r.text for r in paragraph_dedup.remove(docs, found).collect()}
    assert all(cut[i] == t for i, t, _ in rows if i not in later) and all(len(words_of(cut[i])) < len(words_of(t)) for i, t, _ in rows if i in later)


def test_lines_are_all_pairs_exact(spark):
    """Near lines, held against the Jaccard similarity of all pairs of lines and the components of these links."""
    rng = random.Random(4)
    rows = []
    for i in range(25):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([22, 40, 49]))]
        for _ in range(4):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = "other"
            rows.append((len(rows), " ".join(t) + f"\nshort line {i}", "s"))
    sets = {i: brute.shingles(t.split("\n")[0], 5) for i, t, _ in rows}
    union = brute.Sets()
    for a in sets:
        for b in sets:
            if a < b and brute.linked(sets[a], sets[b], 80):
                union.join(a, b)
    got = {r.doc_id: r for r in paragraph_dedup.find(documents(spark, rows)).collect()}
    for i, t, _ in rows:
        whole = [s for s in got[i].removed if (s.start, s.end) == (0, len(t.split("\n")[0]))]
        assert bool(whole) == (union.find(i) != i) and (not whole or union.find(i) in got[i].kept_in)


def test_chosen_places():
    """Every stretch of neighbours has a chosen place, the same in every text that has the stretch."""
    rng = paragraph_dedup.np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 500).astype(paragraph_dedup.np.uint64)
    at = set(paragraph_dedup.chosen(x, 27).tolist())
    assert all(at & set(range(k, k + 27)) for k in range(500 - 26)) and len(at) < 60
    part = {k + 100 for k in paragraph_dedup.chosen(x[100:200], 27).tolist()}
    assert part == {k for k in at if 126 <= k < 174} | {k for k in part if not 126 <= k < 174}
    assert len(paragraph_dedup.chosen(x[:26], 27)) == 0 and len(paragraph_dedup.chosen(paragraph_dedup.np.full(90, x[0]), 27)) == 1


def test_urls(spark):
    urls = [None, "", "no scheme", "http://A.COM", "http://a.com/", "http://www.example.com/en/x", "http://x.www.example.com/en/", "http://example.com/en/", "HTTP://Example.Com/EN/", "http://badexample.com/en/", "https://n.net/es/1?q#f", "https://n.net:80/es/", "http://n.net/fr/?a=/es/", "x://y://z.net/es/", "http://a.org/f.exe", "http://a.org/?x=1&sessionid=4", "http://a\n.com/\nb", "http://n.net/es/1"]
    rows = [(i, u) for i, u in enumerate(urls)] + [(17, urls[17]), (None, urls[4])]
    rules = [url_rules.HostRule("allow", "com", "/"), url_rules.HostRule("block", "example.com", "/en/"), url_rules.HostRule("allow", "www.example.com", "/en/"), url_rules.HostRule("block", "net", "/es/"), url_rules.HostRule("block", "net", "/fr/")]

    def judge(u):
        rest = (u or "").partition("://")[2] if "://" in (u or "") else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = rest[:cut].translate(brute.FOLD), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
        fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fit, key=lambda r: len(r.host + r.path), default=None)
        blocked = bool(u) and any(__import__("re").search(p.regex, u) for p in url_rules.DEFAULT_PATTERNS)
        return host, path, best and best.host + best.path, best.verdict if best else "block" if blocked else "allow"

    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = url_rules.judge_urls(pages, url_rules.rule_table(spark, rules)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, *judge(u))) for i, u in rows)
    clash = pages.select("*", *(F.lit(1).alias(c) for c in ("rule", "token", "host", "path", "n", "id", "verdict", "fits")))
    assert sorted(map(str, url_rules.judge_urls(clash, url_rules.rule_table(spark, rules)).collect())) == sorted(map(str, got))
    assert url_rules.judge_urls(pages.limit(0), url_rules.rule_table(spark, rules)).count() == 0
    stored = spark.createDataFrame([(r.verdict, r.host, r.path) for r in rules + rules[:1]], "verdict string, host string, path string")
    regexes = spark.createDataFrame([(p.verdict, p.regex, list(p.literals)) for p in url_rules.DEFAULT_PATTERNS], "verdict string, regex string, literals array<string>")
    both = url_rules.read_rules(stored).unionByName(url_rules.read_rules(regexes))
    assert sorted(map(str, url_rules.judge_urls(pages, both).collect())) == sorted(map(str, got))
    with pytest.raises(ValueError, match="literal"):
        url_rules.rule_table(spark, [], [url_rules.PatternRule("block", "a+", ())])


def test_urls_long(spark):
    """Every pattern rule fires on its own word and on no longer one, in a URL of any length."""
    tail = "/x" * 100_000
    urls = [f"http://h.org/a.{e}" for e in url_rules.ENDINGS] + [f"http://h.org/{w.upper()}/{tail}" for w in url_rules.WORDS] + [f"http://h.org{tail}/wp-login.phpx", "http://h.org/?sessionid=1"]
    urls += [f"http://h.org/a.{e}x" for e in url_rules.ENDINGS] + [f"http://h.org/x{w}/{tail}" for w in url_rules.WORDS] + ["http://h.org/sessionid=1", None, ""]
    got = {r.page_id: r.verdict for r in url_rules.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), url_rules.rule_table(spark, [])).collect()}
    assert got == {i: "block" if i < 10 else "allow" for i in range(len(urls))}


def test_line_templates(spark, odd, empty):
    rows = [(i, f"Text number {i} is w{i} alone here\nPosted on day {i} by the team in room {i}\nAll rights are reserved here", "s") for i in range(30)] + [(50, "All rights are reserved here", "s"), (51, None, "s"), (52, "", "s")]
    got = {r.doc_id: r for r in line_templates.drop_lines(documents(spark, rows)).collect()}
    assert got[3].text == "" or "Posted" not in got[3].text
    assert "reserved" not in got[3].text and got[50].text == "" and got[51].text is None and got[52].text == ""
    assert got[3]._lines == 3 and got[3]._dropped >= 2
    copies = [(i, "An exact copy of one text\nwith some lines of its own", "s") for i in range(50)]
    assert line_templates.drop_lines(documents(spark, copies)).filter("_dropped > 0").count() == 0
    same = line_templates.drop_lines(odd).select(*odd.columns)
    assert sorted(map(str, same.collect())) == sorted(map(str, odd.collect()))
    assert line_templates.drop_lines(empty).count() == 0


def test_line_templates_count_texts(spark):
    fruits = [f"fruit{'abcdefghijklmnopqrstuvwxyz'[i]}" for i in range(25)]
    rows = [(1, "\n".join(f"The price of {x} is low today" for x in fruits), "s")]
    for i, x in enumerate(fruits):  # 25 texts, two lines each; and 19 texts, two lines each
        rows.append((100 + i, f"The cost of {x} is high now\nThe cost of {x}s is high now", "s"))
        if i < 19:
            rows.append((200 + i, f"The rent of {x} is fair here\nThe rent of {x}s is fair here", "s"))
    got = {r.doc_id: r._dropped for r in line_templates.drop_lines(documents(spark, rows)).collect()}
    assert got == {i: 2 if 100 <= i < 200 else 0 for i, *_ in rows}


def test_quality(spark, odd, empty):
    got = sorted(((r.doc_id, *[r[c] for c in quality.BASE], r.base_failed) for r in quality.judge(odd, ["doc_id"]).collect()), key=str)
    want = []
    for i, t, _ in odd_rows():
        b = brute.quality(t)
        want.append((i, *b, b[0] < 50 or 100 * b[4] > 50 * b[0]))
    assert got == sorted(want, key=str)
    assert quality.judge(empty, ["doc_id"]).count() == 0


def test_quality_posteriors():
    good = quality.vote((0.0,) * len(quality.RULES))
    bad = quality.vote((1.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0))
    post = quality.fit_posteriors({good: 9000, bad: 400})
    assert post[good] > 0.95 and post[bad] < 0.05
    assert quality.fit_posteriors({}) == {} and len(list(quality.all_patterns())) == 3 ** len(quality.RULES)


def test_toxicity(spark, odd, empty):
    rng = random.Random(2)
    words = [f"plain{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1500):
        toxic = i % 5 == 0
        t = [rng.choice(words) for _ in range(40)] + (["vermin"] if toxic else []) + ([rng.choice(["muslim", "christian"])] if rng.random() < (0.8 if toxic else 0.1) else [])
        rows.append((i, " ".join(t), "s"))
        labels.append((i, int(toxic), 1))
    docs = documents(spark, rows)
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    marks = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    model = toxicity.train(docs, marks.filter(~held))
    out = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    test = [i for i in range(1500) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(out[i].predicted == labels[i][1] for i in test) > 0.97 * len(test)
    assert model.score("a muslim reads plain1 plain2", {}) < 0.5 < model.score("vermin plain1", {})
    scores = toxicity.score(odd, model).collect()
    assert len(scores) == len(odd_rows()) and all(0 <= r.score <= 1 for r in scores)
    assert toxicity.score(empty, toxicity.train(empty, marks)).count() == 0


@pytest.mark.parametrize("terms", [("muslim", "christian"), ("blorp", "quexly")])
def test_toxicity_penalty_acts(spark, terms):
    """Texts that differ in one identity term alone get nearly the same score with the penalty, and not without; for listed
    terms, and for words that only the labels show to be such. Insults are found as before."""
    rng = random.Random(5)
    a, b = terms
    words = [f"plain{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1600):
        toxic = i % 4 == 0
        t = [rng.choice(words) for _ in range(30)] + ["vermin"] * (toxic and rng.random() < 0.8)
        t += [a] * (rng.random() < (0.5 if toxic else 0.06)) + [b] * (rng.random() < (0.16 if toxic else 0.05))
        rng.shuffle(t)
        rows.append((i, " ".join(t), "s"))
        labels.append((i, int(toxic), 1))
    docs, marks = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    logit = lambda m, t: math.log((p := m.score(t, {})) / (1 - p))
    gap = {}
    for fairness in (0.0, toxicity.FAIRNESS):
        model = toxicity.train(docs, marks, fairness=fairness)
        assert model.pairs > 100 and (set(terms) <= set(model.learnt) or terms[0] == "muslim")
        gap[fairness] = abs(logit(model, f"plain1 {a} plain2") - logit(model, f"plain1 {b} plain2"))
        assert model.score("plain1 vermin plain2", {}) > 0.5 > model.score("plain1 plain2", {})
    assert gap[toxicity.FAIRNESS] < 0.3 * gap[0.0] and gap[0.0] > 0.3


def test_toxicity_odd_labels(spark, odd):
    """Null and contradicting labels, null ids and repeated ids; no labels, or only one class."""
    rows = [(i, "vermin here" if i % 2 else "plain here", "s") for i in range(400)] + [(3, "another text", "s"), (None, "vermin", "s")]
    marks = [(i, i % 2) for i in range(400)] + [(1, 0), (None, 1), (2, None), (999, 1)]
    docs = documents(spark, rows)
    model = toxicity.train(docs, spark.createDataFrame(marks, "doc_id long, toxic int"))
    again = toxicity.train(documents(spark, rows[::-1]), spark.createDataFrame(marks[::-1], "doc_id long, toxic int"))
    assert model.weights == again.weights and model.score("vermin", {}) > 0.5 > model.score("plain", {})
    for labels, want in (([], 0), ([(1, 0), (2, 0)], 0), ([(1, 1), (3, 1)], 1)):
        model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert {r.predicted for r in toxicity.score(odd, model).collect()} == {want}


def test_components(spark):
    rng = random.Random(9)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, i) for i in range(1001, 1400)] + [(i, i + 1) for i in range(2000, 2100)] + [(None, 3), (4, 4)]
    union = brute.Sets()
    for a, b in links:
        if a is not None:
            union.join(a, b)
    got = {r.node: r.component for r in components.components(spark, spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got.get(n, n) == union.find(n) for n in list(union.up))


def test_set_numbers():
    memory = shingles.Words()
    a = shingles.shingle_set(b"a b c d e".split(), 4, memory)
    assert len(a) == 2 and shingles.set_key(a) == shingles.set_key(shingles.shingle_set(b"a b c d e".split(), 4, shingles.Words()))
    assert len(shingles.shingle_set(b"a b".split(), 4, memory)) == 1 and not len(shingles.shingle_set([], 4, memory))


def test_stages_on_odd_input(spark, odd, empty):
    """Each stage takes clashing columns, nulls, repeats and empty tables, and gives back the columns it got."""
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    clash = {c: F.lit(1) for c in ("_gone", "_again", "_h", "n_words", "kept", "row", "size", "copies", "_votes", "n_hit", "component_id", "line")}
    for rows in (odd.withColumns(clash), empty.withColumns(clash)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, folder)
            assert out.columns == rows.columns or name == corpus_pipeline.STAGES[-1][0]
            assert out.count() <= rows.count()


def test_pipeline(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    docs = spark.read.parquet(folder + "/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = corpus_pipeline.near_duplicates(spark, docs, folder)
    want = {c for _, c in brute.components(list(texts.items()), corpus_pipeline.PERCENT, corpus_pipeline.SHINGLE).values()}
    assert {r.doc_id for r in kept.select("doc_id").collect()} == want and kept.columns == docs.columns
    bench = [tuple(r) for r in spark.read.parquet(folder + "/benchmark.parquet").select("item_id", "text").collect()]
    clean = {i for i, b in zip(texts, brute.contaminated(texts.values(), bench), strict=True) if not b[-1]}
    assert {r.doc_id for r in corpus_pipeline.decontamination(spark, docs, folder).select("doc_id").collect()} == clean
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 0 and set(docs.columns) < set(out.columns)


def test_pipeline_rows_stand_for_themselves(spark):
    """Rows without an id, or that share one, get their own decisions in every stage."""
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    rng = random.Random(6)
    text = lambda n: " ".join(f"w{rng.randrange(9000)}" for _ in range(n))
    leak = next(r.text for r in spark.read.parquet(folder + "/benchmark.parquet").collect() if len((r.text or "").split()) > 20)
    copy = text(80)
    rows = [(None, text(30 + 10 * i), f"s{i % 3}") for i in range(12)] + [(7, text(50), "s0"), (7, text(70), "s1"), (None, f"{text(20)} {leak}", "s0"), (7, f"{text(20)} {leak}", "s0")]
    rows += [(1, copy, "s0"), (None, copy, "s0"), (9, copy, "s1"), (1, copy, "s0"), (1, copy, "s2"), (3, None, "s0"), (3, None, "s0"), (None, "", None)]
    docs = documents(spark, rows)
    out = lambda df: sorted(((r.doc_id, r.text, r.source) for r in df.collect()), key=str)
    clean = [r for r in rows if not (r[1] and leak in r[1])]
    assert out(corpus_pipeline.decontamination(spark, docs, folder)) == sorted(clean, key=str)
    once = [r for r in rows if r[1] != copy]
    assert sorted(map(str, [(i, t) for i, t, _ in out(corpus_pipeline.near_duplicates(spark, docs, folder))])) == sorted(map(str, [(i, t) for i, t, _ in once] + [(1, copy)]))
    mixed = corpus_pipeline.mix_sources(spark, docs, folder).collect()
    want = [r for r in mixing.mix(docs, carry=("text",)).collect() if r.copies]
    assert sorted(str((r.doc_id, r.source, r.text, r.size, r.copies, r.taken)) for r in mixed) == sorted(str((r.doc_id, r.source, r.text, r.size, r.copies, r.taken)) for r in want)
    assert all(r.size == len(brute.SPACED.findall(r.text)) for r in mixed)


def test_quality_stage(spark, odd):
    """The stage keeps exactly the rows that the operator keeps, row by row."""
    import corpus_pipeline

    want = sorted(str(r.text) for r in quality.judge(odd, ["doc_id", "text"]).filter("kept").collect())
    assert sorted(str(r.text) for r in corpus_pipeline.quality_rules(spark, odd, "").collect()) == want
    got = [r for r in quality.judge(odd, ["doc_id"]).collect() if not r.base_failed]
    assert all(r.kept == (r.p_good >= 0.5) for r in got)


def test_quality_sends_texts_alone(spark, odd):
    """Only texts go to Python, and once for the verdicts though these are filtered."""
    import corpus_pipeline

    plan = corpus_pipeline.quality_rules(spark, odd, "")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("ArrowEvalPython") == 1


def test_open_groups_are_joined_once(spark, monkeypatch):
    """What is dealt into blocks is a written table, as it is read several times; near sets that don't link are dealt."""
    rng, base, dealt = random.Random(14), [f"w{i}" for i in range(200)], []
    changed = lambda: [f"x{rng.randrange(10**9)}" if i in some else w for some in [rng.sample(range(200), 3)] for i, w in enumerate(base)]
    rows = [(i, " ".join(changed())) for i in range(40)]
    rows += [(40, rows[7][1] + " end"), (41, rows[9][1])]
    real = simjoin._dealt
    monkeypatch.setattr(simjoin, "_dealt", lambda spark, rows, weigh: dealt.append((hasattr(rows, "_kept_at"), rows.count())) or real(spark, rows, weigh))
    got = {r.doc_id: r.component_id for r in ngram_join.join(documents(spark, [(*r, "s") for r in rows])).collect()}
    assert dealt and all(kept and n for kept, n in dealt)
    assert got == {i: c for i, (_, c) in brute.components(rows).items()}


def test_sketches_keep_linked_sets():
    """Linked sets differ in no more bits than the bound, so a block of sketches keeps both."""
    rng, np = random.Random(12), ngram_join.np
    for percent in (80, 85):
        for _ in range(400):
            n = rng.choice([5, 20, 60, 300, 2000])
            a = {rng.getrandbits(64) for _ in range(n)}
            b = set(a)
            for _ in range(rng.randint(0, 1 + n // 6)):
                b.discard(next(iter(b))) if rng.random() < 0.5 and len(b) > 1 else b.add(rng.getrandbits(64))
            x, y = (np.array(sorted(s), dtype=np.uint64) for s in (a, b))
            block = simjoin.pd.DataFrame({"pivot": 1, "cls": [1, 2], "n": [len(a), len(b)], "comp": [1, 2], "role": [simjoin.BOTH, simjoin.MEMBER], "sketch": [ngram_join.sketch(x), ngram_join.sketch(y)]})
            kept = simjoin.possible_block(block, percent)
            if brute.linked(a, b, percent):
                assert sorted(kept["cls"]) == [1, 2]
            block["items"] = [x.view(np.int64), y.view(np.int64)]
            assert (len(simjoin.compare_block(block, percent)) == 1) == brute.linked(a, b, percent)


def test_bitmap_joins(spark):
    """The bitmap only spares work: results are those of the plain joins, also for no wanted keys and for null ones."""
    rows = spark.range(5000).select(F.when(F.col("id") % 50 != 0, F.xxhash64(F.col("id") % 1000)).alias("k"), F.col("id").alias("v"))
    for many in (0, 1, 300):
        wanted = scratch.keep(spark, spark.range(many).select(F.xxhash64("id").alias("k")), "wanted")
        want = sorted(r.v for r in rows.join(wanted, "k", "left_semi").collect())
        assert sorted(r.v for r in scratch.holding(rows, wanted, "k").collect()) == want
        assert scratch.holding(rows, wanted, "k", once=True).count() == rows.join(wanted, "k", "left_semi").select("k").distinct().count()
        rest, some = scratch.apart(rows, wanted, "k")
        assert rest.count() + some.count() == 5000 and rest.join(wanted, "k", "left_semi").count() == 0 and some.count() < len(want) + 50
    with scratch.temporaries() as made:
        gone, stays = scratch.keep(spark, spark.range(3).toDF("a"), "gone"), scratch.keep(spark, spark.range(3).toDF("a"), "stays")
        made.remove(stays)
    assert stays.count() == 3 and not os.path.exists(gone._kept_at.removeprefix("file://")) and os.path.exists(stays._kept_at.removeprefix("file://"))
