"""The registered queries of this subpackage and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import conversation_trie, decontam, lexical_search, line_templates, mixing, ngram_join, paragraph_dedup, pii, pu_quality, quality, toxicity, url_rules, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.find(_table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the weights 1, 2, 3."""
    out = mixing.mix(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_prefix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    return decontam.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to deduplicated archives and read back."""
    out = warc.archive(spark, _table(spark, sf_dir, "pages"))
    return out.select(F.col("id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under Jaccard 0.85 of 4-word shingles."""
    return ngram_join.join(_table(spark, sf_dir, "documents"))


def op6_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of every document: how many others have too, the spans it loses and the documents that keep them."""
    out = paragraph_dedup.find(_table(spark, sf_dir, "documents"))
    removed = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select("doc_id", "n_shared", "n_removed", "chars_removed", "n_paragraphs", removed.alias("removed"), "kept_in")


URL_RULES = [
    url_rules.HostRule("allow", "com", "/"),
    url_rules.HostRule("block", "example.com", "/en/"),
    url_rules.HostRule("allow", "www.example.com", "/en/"),
    url_rules.HostRule("block", "net", "/es/"),
    url_rules.HostRule("block", "net", "/fr/"),
]


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged."""
    return url_rules.judge_urls(_table(spark, sf_dir, "pages"), url_rules.rule_table(spark, URL_RULES))


def op8_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines of recurring templates."""
    out = line_templates.drop_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"), "text")


def op9_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document judged by weak supervision."""
    return quality.judge(_table(spark, sf_dir, "documents"), ["doc_id"])


def op10_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; a fifth of the ids is held out of training."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = toxicity.train(docs, labels.filter(~held_out))
    out = toxicity.score(docs, model)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    terms = lexical_search.item_terms(_table(spark, sf_dir, "benchmark"))
    return lexical_search.search(lexical_search.index(_table(spark, sf_dir, "documents"), terms), terms)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations."""
    turns = conversation_trie.ordered(_table(spark, sf_dir, "conversations"))
    return conversation_trie.trie(*conversation_trie.branched(turns))


def op13_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; a fifth of the ids is held out of training."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    rows = pu_quality.featured(docs)
    out = pu_quality.score(rows, pu_quality.train(rows, labels.filter(~held_out)))
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name and query."""
    found = [
        op1_bootstrapped_pii, op2_mix_sources, op3_prefix_decontamination, op4_warc_revisits, op5_ngram_jaccard,
        op6_paragraph_minhash, op7_url_rules, op8_line_templates, op9_quality_votes, op10_counterfactual_toxicity,
        op11_lexical_search, op12_conversation_trie, op13_pu_quality,
    ]
    return {f.__name__: f for f in found}


ORACLES: dict[str, str] = {
    "op7_url_rules": r"""
WITH u AS (
  SELECT page_id, url, strpos(url, '://') AS p FROM pages),
a AS (
  SELECT page_id, url, CASE WHEN coalesce(p, 0) = 0 THEN '' ELSE substr(url, p + 3) END AS rest FROM u),
b AS (
  SELECT page_id, url, rest, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM a),
r(rh, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
best AS (
  SELECT page_id, url, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v
  FROM b JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id, url)
SELECT b.page_id, host, path, rule,
       CASE WHEN v IS NOT NULL THEN v
            WHEN regexp_matches(b.url, '(?i)[/._-](porn|xxx|casino)[/._-]') OR regexp_matches(b.url, '[?&]sessionid=')
              OR regexp_matches(b.url, '/wp-login\.php') OR regexp_matches(b.url, '(?i)\.(exe|zip|iso|dmg|apk)([?#]|$)') THEN 'block'
            ELSE 'allow' END AS verdict
FROM b LEFT JOIN best ON b.page_id = best.page_id AND b.url = best.url
""",
    "op3_prefix_decontamination": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bi AS (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0),
win AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[i:i + 9], ' ') AS t FROM bi),
occ AS (SELECT doc_id, n, unnest(range(1, len(ws) - n + 2)) AS i, ws FROM w, (SELECT DISTINCT n FROM win) WHERE len(ws) >= n),
hit AS (SELECT doc_id, i, o.n, item_id FROM (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS t FROM occ) o JOIN win ON o.t = win.t AND o.n = win.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN pos ON w.doc_id = pos.doc_id LEFT JOIN its ON w.doc_id = its.doc_id
""",
    "op5_ngram_jaccard": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
wi AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0),
s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(ws[i:i + 3], ' ')) AS g FROM wi),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n u ON u.doc_id = x JOIN n v ON v.doc_id = y WHERE 100 * common >= 85 * (u.n + v.n - common)),
e AS MATERIALIZED (SELECT x AS a, y AS b FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT a AS doc_id, a AS seen FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.seen = e.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce((SELECT min(seen) FROM r WHERE r.doc_id = w.doc_id), w.doc_id) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id
""",
    "op8_line_templates": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body, text FROM documents),
x AS (SELECT doc_id, body, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS i FROM d WHERE body <> ''),
k AS MATERIALIZED (SELECT *, array_to_string(list_transform(list_filter(regexp_split_to_array(line, '[ \t\x0B\f\r]+'), lambda t: t <> ''), lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END), ' ') AS norm FROM x),
o AS MATERIALIZED (SELECT DISTINCT md5(body) AS body, norm FROM k WHERE norm <> ''),
c AS (SELECT norm, count(*) AS docs, string_split(norm, ' ') AS toks FROM o GROUP BY norm),
f AS (SELECT norm, docs, toks, concat(len(toks), ':', array_to_string(toks[1:3], ' ')) AS leaf FROM c),
g AS (SELECT leaf FROM f GROUP BY leaf HAVING sum(docs) >= 20),
u AS (SELECT leaf, norm, docs, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM f WHERE leaf IN (SELECT leaf FROM g)),
y AS MATERIALIZED (SELECT leaf, pos, tok FROM u JOIN o ON o.norm = u.norm GROUP BY leaf, pos, tok HAVING count(DISTINCT body) >= 20),
q AS (SELECT u.*, y.tok IS NOT NULL AS fixed FROM u LEFT JOIN y ON y.leaf = u.leaf AND y.pos = u.pos AND y.tok = u.tok),
t AS (SELECT leaf, norm, docs, string_agg(CASE WHEN fixed THEN tok ELSE '<*>' END, ' ' ORDER BY pos) AS template, count(*) FILTER (fixed AND tok <> '<*>') AS kept, count(*) AS n FROM q GROUP BY leaf, norm, docs),
v AS (SELECT leaf, template FROM t JOIN o ON o.norm = t.norm WHERE 100 * kept >= 60 * n GROUP BY leaf, template HAVING count(DISTINCT body) >= 20),
b AS MATERIALIZED (SELECT norm FROM t SEMI JOIN v ON t.leaf = v.leaf AND t.template = v.template WHERE 100 * kept >= 60 * n),
m AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (norm IN (SELECT norm FROM b)) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (norm NOT IN (SELECT norm FROM b)), '') AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, coalesce(kept, d.text) AS text FROM d LEFT JOIN m ON m.doc_id = d.doc_id
""",
    "op11_lexical_search": r"""
WITH t AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(ws)) AS BIGINT) AS l FROM t WHERE len(ws) > 0),
i AS MATERIALIZED (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY item_id, term),
p AS MATERIALIZED (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, CAST(len(ws) AS BIGINT) AS n, unnest(ws) AS term FROM t) WHERE term IN (SELECT term FROM i) GROUP BY r, doc_id, n, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
m AS (SELECT item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // l)))) AS BIGINT) AS score FROM p JOIN i ON i.term = p.term JOIN w ON w.term = p.term, s GROUP BY item_id, r, doc_id),
k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM m WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 10
""",
    "op12_conversation_trie": r"""
WITH x AS MATERIALIZED (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, left(coalesce(role, ''), 64), left(coalesce(text, ''), 64), md5(coalesce(role, '') || chr(0) || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
o AS MATERIALIZED (
  SELECT conv_id, n, conv_id - conv_id % 20 AS host,
         list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
           lambda a, b: list_reduce(list_prepend(xor(a, b), range(0, 8)), lambda v, k: xor(v >> 1, (v & 1) * 3988292384::BIGINT))) AS crc
  FROM (SELECT conv_id, count(*) AS n FROM x GROUP BY conv_id)),
c AS MATERIALIZED (SELECT conv_id, host, n, xor(crc, 4294967295) % 4 AS h FROM o),
p AS MATERIALIZED (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS depth, role, text
  FROM (SELECT c.conv_id, 0 AS own, pos, role, text FROM c JOIN x ON x.conv_id = c.host AND pos <= h
        UNION ALL SELECT c.conv_id, 1, pos, role, text FROM c JOIN x ON x.conv_id = c.conv_id AND pos > h)),
k AS MATERIALIZED (
  SELECT conv_id, depth, text, md5(array_to_string(list(md5(md5(role) || md5(text))) OVER (PARTITION BY conv_id ORDER BY depth), ',')) AS node FROM p
  UNION ALL SELECT conv_id, 0, '', '' FROM c),
l AS (SELECT conv_id, max(depth) AS length FROM k GROUP BY conv_id),
n AS MATERIALIZED (
  SELECT node, depth, min(k.conv_id) AS conv_id, count(*) AS n_convs, any_value(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))) AS words,
         sha256(coalesce(string_agg(CAST(k.conv_id AS VARCHAR), ',' ORDER BY k.conv_id) FILTER (depth = length), '')) AS ends_sha256
  FROM k JOIN l ON l.conv_id = k.conv_id GROUP BY node, depth),
e AS MATERIALIZED (SELECT n.node, up.node AS parent, o.conv_id AS parent_conv_id FROM n LEFT JOIN k up ON up.conv_id = n.conv_id AND up.depth = n.depth - 1 LEFT JOIN n o ON o.node = up.node AND o.depth = n.depth - 1),
f AS (SELECT parent AS node, count(*) AS n_children FROM e WHERE parent IS NOT NULL GROUP BY parent),
u AS (
  SELECT k.node, sum((n.n_convs - 1) * n.words) AS saved_tokens, count(*) FILTER (f.node IS NULL) AS n_leaves
  FROM n JOIN k ON k.conv_id = n.conv_id AND k.depth <= n.depth LEFT JOIN f ON f.node = n.node GROUP BY k.node)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM n JOIN e ON e.node = n.node JOIN u ON u.node = n.node LEFT JOIN f ON f.node = n.node
""",
    "op4_warc_revisits": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hexed FROM pages),
d AS (
  SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, body,
         array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST((CAST('0x' || substr(hexed, CAST(i // 4 * 5 + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT) + 1, 1)), '') AS payload_digest
  FROM p),
w AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to FROM w
""",
}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name."""
    return dict(ORACLES)
