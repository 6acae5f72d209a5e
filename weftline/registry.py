"""The registered queries of the code-graph engine, each with an independent DuckDB formulation where SQL can say it.

The graph and the corpus are derived from the star-schema tables (``fixtures``); the queries are the operators themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.extract import events as X
from weftline.extract import incremental as I
from weftline.fixtures import VIEWS, view
from weftline.functions import predicates as P
from weftline.operators import graph as G
from weftline.operators import text as T
from weftline.operators import traverse as V
from weftline.operators.textindex import TextIndex
from weftline.plans import hybrid as H
from weftline.service import export
from weftline.sources import events as E
from weftline.sources.shared import Kept, fresh_folder
from weftline.sources.store import GraphStore
from weftline.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SYMBOL = "red_plate"


_MADE: dict[tuple[str, str, str], str] = {}


def _made_once(t: Tables, name: str, write: Callable[[str], object]) -> str:
    """The path of a table or index that is written once a session: it stands for a stored one."""
    key = (t.spark.sparkContext.applicationId, t.folder, name)
    if key not in _MADE:
        path = fresh_folder(t.spark, name)
        write(path)
        _MADE[key] = path
    return _MADE[key]


def _once(t: Tables, name: str, write: Callable[[str], object]) -> DataFrame:
    return t.spark.read.parquet(_made_once(t, name, write))


class Tables:
    """The derived tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.folder = spark, sf_dir
        self.get = lambda name: view(spark, sf_dir, name)
        self.raw = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")

    @property
    def nodes(self) -> DataFrame:
        return self.get("g_nodes")

    @property
    def edges(self) -> DataFrame:
        return self.get("g_edges")

    @property
    def lines(self) -> DataFrame:
        return self.get("c_lines")

    @property
    def calling_lines(self) -> DataFrame:
        """The lines with calls between the functions of a file, so that impact has more than one level."""
        return self.lines.withColumn("text", F.regexp_replace("text", r"assertAllowed\(\);", r"order_1(); order_2();"))

    @property
    def prose(self) -> DataFrame:
        """The documents as a line corpus: accented text and long lines."""
        docs = self.raw("documents").select(F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"), F.col("text").alias("content"))
        return T.scan_lines(docs)

    @property
    def spans(self) -> DataFrame:
        """The owner spans of the lines, stored once a session."""
        return _once(self, "spans", lambda path: T.owner_spans(self.lines).write.parquet(path))

    @property
    def text_index(self) -> TextIndex:
        """An index of the documents, as files, made once a session."""
        docs = self.raw("documents").select(F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"), F.col("text").alias("content"))
        return TextIndex(self.spark, _made_once(self, "text-index", lambda path: TextIndex.build(docs, path)))

    @property
    def odd_files(self) -> DataFrame:
        """File paths with endings that the search takes, and others that it doesn't."""
        ends = F.array(*(F.lit(x) for x in (".png", "", "/.env.local", ".MD", "/LICENSE", ".YAML")))
        return self.nodes.filter("label = 'File'").select(F.concat("path", F.get(ends, F.length("path") % 6)).alias("path"))

    @property
    def placed_files(self) -> DataFrame:
        """File paths below folders that the walk enters, and others that it doesn't."""
        tops = F.array(*(F.lit(x) for x in ("node_modules/", "", "x/.hidden/", "tmp/", "a/dist/", "x/tmp/")))
        return self.nodes.filter("label = 'File'").select(F.concat(F.get(tops, F.length("path") % 6), "path").alias("path"))

    @property
    def files_with_tests(self) -> DataFrame:
        """Paths, with tests beside some and in a folder for others."""
        f = self.get("g_files")
        beside = f.filter("k % 7 = 0").select(F.regexp_replace("path", r"\.ts$", ".test.ts").alias("path"))
        apart = f.filter("k % 3 = 0").select(F.regexp_replace("path", r"/([^/]*)\.tsx$", r"/__tests__/$1.spec.ts").alias("path"))
        return f.select("path").unionByName(beside).unionByName(apart).distinct()

    @property
    def symbol_ids(self) -> DataFrame:
        return self.nodes.filter((F.col("label") == "Symbol") & (F.col("name") == SYMBOL)).select("id")

    @property
    def seeds(self) -> DataFrame:
        return self.nodes.filter((F.col("label") == "File") & F.col("path").rlike(r"/lib/s[1-9]\.ts$")).select("path")


def query(name: str, sql: str | None = None, fixture: bool = True) -> Callable[[Callable[[Tables], DataFrame]], Callable]:
    """Register a function of the tables under a name, with its DuckDB text (which the fixture views precede)."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = (f"WITH {VIEWS}, {sql.strip()[5:]}" if sql.strip().startswith("WITH ") else f"WITH {VIEWS} {sql}") if fixture else sql
        return f

    return add


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who calls a symbol, with the confidence of each call."""
    return QUERIES["g14_callers"](spark, sf_dir)


def queries() -> dict[str, Query]:
    """Name and query."""
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """Name and DuckDB text."""
    return dict(ORACLES)


# ---- graph lookups and counts ----------------------------------------------------------------------------------

query("g1_search_code", """
SELECT * FROM g_nodes WHERE concat_ws(chr(1), lower(id), lower(name), lower(path), lower(kind), lower(package_id), lower(label)) LIKE '%nation\\_7%' ESCAPE '\\'
ORDER BY label NULLS LAST, coalesce(path, name, id) NULLS LAST, id LIMIT 21""")(lambda t: G.search_code(t.nodes, "NATION_7"))
query("g2_find_symbol", "SELECT * FROM g_nodes WHERE label = 'Symbol' AND contains(lower(name), 'ring') ORDER BY name NULLS LAST, id LIMIT 21")(lambda t: G.find_symbol(t.nodes, "Ring"))
query("g3_find_file", "SELECT * FROM g_nodes WHERE label = 'File' AND contains(lower(coalesce(path, id)), '.test.ts') ORDER BY path, id LIMIT 41")(lambda t: G.find_file(t.nodes, ".TEST.ts", 40))
query("g4_node", "SELECT * FROM g_nodes WHERE id = 'package:@acme/nation_3'")(lambda t: G.node(t.nodes, "package:@acme/nation_3"))
_CANDIDATES = """
WITH c AS (SELECT *, lower(name) = '{low}' AS ex FROM g_nodes WHERE label = 'Symbol' AND (contains(lower(name), '{low}') OR contains(lower(id), '{low}')) AND {filt})
SELECT id, label, name, path, kind, package_id, start_line, exported, CASE WHEN ex THEN 'exact' ELSE 'contains' END AS "match",
       (SELECT count(*) FROM c WHERE ex) AS n_exact, (SELECT count(*) FROM c) AS n_all
FROM c ORDER BY NOT ex, contains(name, '::'), NOT coalesce(exported, false), coalesce(path, id), name, id LIMIT 20"""
query("g5_resolve_symbol", _CANDIDATES.format(low="red_plate", filt="true"))(lambda t: G.symbol_candidates(t.nodes, "Red_Plate"))
query("g5_resolve_state", """
WITH c AS (SELECT id, lower(name) = 'order_1' AS ex FROM g_nodes WHERE label = 'Symbol' AND (contains(lower(name), 'order_1') OR contains(lower(id), 'order_1'))),
k AS (SELECT count(*) FILTER (ex) AS n_exact, count(*) AS n_all, max(id) FILTER (ex) AS one, max(id) AS sole FROM c)
SELECT n_exact, n_all, n_exact > 1 OR (n_exact = 0 AND n_all > 1) AS ambiguous, CASE WHEN n_exact = 1 THEN one WHEN n_exact = 0 AND n_all = 1 THEN sole END AS selected FROM k""")(lambda t: G.resolve_state(G.symbol_candidates(t.nodes, "order_1", 100)))
query("g6_resolve_filtered", _CANDIDATES.format(low="red_plate", filt="contains(lower(path), 'brand#1')"))(lambda t: G.symbol_candidates(t.nodes, "red_plate", package="brand#1"))
query("g7_matches_filters", "SELECT id FROM g_nodes WHERE package_id = 'package:@acme/nation_4' AND (path = 'packages/nation_4' OR path LIKE 'packages/nation\\_4/%' ESCAPE '\\')")(lambda t: t.nodes.filter(P.matches_filters(F.col("package_id"), F.col("path"), package_exact="@acme/nation_4", prefix="packages/nation_4/") & (F.col("package_id") == "package:@acme/nation_4")).select("id"))
query("g8_package_scope", "SELECT id FROM g_nodes WHERE contains(lower(coalesce(package_id, '')), '@acme/nation_5') OR contains(lower(coalesce(path, '')), '/nation_5/') OR starts_with(lower(coalesce(path, '')), 'nation_5/')")(lambda t: t.nodes.filter(P.package_scope(F.col("package_id"), F.col("path"), "package:@acme/nation_5")).select("id"))
query("g10_node_lean", "SELECT id, label, name, coalesce(path, CASE WHEN id LIKE 'file:%' THEN substr(id, 6) END) AS path, kind, package_id FROM g_nodes")(lambda t: G.node_lean(t.nodes))
query("g10_edge_lean", "SELECT type, src AS source_from, dst AS source_to, source_file, start_line, coalesce(confidence, 1.0) AS confidence FROM g_edges")(lambda t: G.edge_lean(t.edges))
query("g14_definitions", f"SELECT * FROM g_nodes WHERE label = 'Symbol' AND name = '{SYMBOL}'")(lambda t: G.symbol_definitions(t.nodes, t.symbol_ids))
query("g14_callers", f"""
SELECT coalesce(e.source_file, c.path) AS path, e.type AS kind, c.name AS owner, e.start_line AS line, coalesce(e.confidence, 1.0) AS confidence, e.dst AS target, e.src
FROM g_edges e, g_nodes c, g_nodes s WHERE e.src = c.id AND e.dst = s.id AND s.label = 'Symbol' AND s.name = '{SYMBOL}'
  AND e.type IN ('CALLS', 'RENDERS', 'INSTANTIATES') AND coalesce(e.confidence, 1.0) >= 0.6""")(lambda t: G.callers(t.nodes, t.edges, t.symbol_ids))
query("g14_callers_top", f"""
SELECT coalesce(e.source_file, c.path) AS path, e.type AS kind, c.name AS owner, e.start_line AS line, coalesce(e.confidence, 1.0) AS confidence, e.dst AS target, e.src
FROM g_edges e JOIN g_nodes c ON e.src = c.id WHERE e.dst IN (SELECT id FROM g_nodes WHERE label = 'Symbol' AND name = '{SYMBOL}')
  AND e.type IN ('CALLS', 'RENDERS', 'INSTANTIATES') AND coalesce(e.confidence, 1.0) >= 0.9
ORDER BY path, coalesce(line, 0), src, target, kind, confidence LIMIT 41""")(lambda t: G.callers(t.nodes, t.edges, t.symbol_ids, 0.9, 40))
query("g14_importers", f"""
SELECT coalesce(e.source_file, f.path) AS path, e.start_line AS line, e.dst AS target FROM g_edges e JOIN g_nodes f ON f.id = e.src
WHERE e.type = 'IMPORTS_SYMBOL' AND coalesce(e.confidence, 1.0) >= 0.6 AND EXISTS (SELECT 1 FROM g_nodes s WHERE s.id = e.dst AND s.label = 'Symbol' AND s.name = '{SYMBOL}')""")(lambda t: G.importers(t.nodes, t.edges, t.symbol_ids))
_SEEDS = "SELECT id, path FROM g_nodes WHERE label = 'File' AND regexp_matches(path, '/lib/s[1-9]\\.ts$')"
query("g15_dependents", f"""
WITH s AS ({_SEEDS}) SELECT DISTINCT coalesce(o.path, o.id) AS path, e.type AS rel, coalesce(o.package_id, '') AS package_id, coalesce(o.label, '') AS label
FROM s JOIN g_edges e ON e.dst = s.id JOIN g_nodes o ON o.id = e.src WHERE e.type IN ('IMPORTS_FILE', 'RE_EXPORTS_FILE', 'DYNAMIC_IMPORTS_FILE', 'TESTS_FILE') AND coalesce(e.confidence, 1.0) >= 0.5""")(lambda t: G.path_neighbours(t.nodes, t.edges, t.seeds, True))
query("g15_dependencies", f"""
WITH s AS ({_SEEDS.replace("/lib/s[1-9]", "/src/c[0-9]*4")}) SELECT DISTINCT coalesce(o.path, o.id) AS path, e.type AS rel, coalesce(o.package_id, '') AS package_id, coalesce(o.label, '') AS label
FROM s JOIN g_edges e ON e.src = s.id JOIN g_nodes o ON o.id = e.dst WHERE e.type IN ('IMPORTS_FILE', 'RE_EXPORTS_FILE', 'DYNAMIC_IMPORTS_FILE') AND coalesce(e.confidence, 1.0) >= 0.5""")(lambda t: G.path_neighbours(t.nodes, t.edges, t.nodes.filter("label = 'File' AND path RLIKE '/src/c[0-9]*4.ts$'").select("path"), False))
query("g16_file_relations", f"""
WITH s AS ({_SEEDS}),
i AS (SELECT DISTINCT s.path AS sp, n.id, coalesce(n.path, n.name, n.id) AS shown FROM s JOIN g_edges e ON e.dst = s.id JOIN g_nodes n ON n.id = e.src),
o AS (SELECT DISTINCT s.path AS sp, n.id, coalesce(n.path, n.name, n.id) AS shown FROM s JOIN g_edges e ON e.src = s.id JOIN g_nodes n ON n.id = e.dst)
SELECT s.path, (SELECT count(*) FROM i WHERE sp = s.path) AS inbound_count, coalesce((SELECT list_slice(list_sort(list(DISTINCT shown)), 1, 5) FROM i WHERE sp = s.path), []) AS inbound_examples,
       (SELECT count(*) FROM o WHERE sp = s.path) AS outbound_count, coalesce((SELECT list_slice(list_sort(list(DISTINCT shown)), 1, 5) FROM o WHERE sp = s.path), []) AS outbound_examples FROM s""")(lambda t: G.file_relations(t.nodes, t.edges, t.seeds))
query("a2_types", """
SELECT 'node' AS family, coalesce(label, 'Unknown') AS name, count(*) AS n FROM g_nodes GROUP BY ALL UNION ALL SELECT 'edge', type, count(*) FROM g_edges GROUP BY ALL""")(lambda t: G.type_counts(t.nodes, t.edges))
query("a3_count_relationships", "SELECT count(*) FILTER (type IN ('CALLS', 'RENDERS')) AS n FROM g_edges")(lambda t: G.count_relationships(t.edges, ("CALLS", "RENDERS")))
query("a3_count_default", "SELECT count(*) FILTER (type = 'CALLS') AS n FROM g_edges")(lambda t: G.count_relationships(t.edges))
query("a4_status", "SELECT (SELECT count(*) FROM g_nodes) AS nodes, (SELECT count(*) FROM g_edges) AS edges")(lambda t: G.status(t.nodes, t.edges))
query("a7_category_counts", """
SELECT CASE WHEN contains(path, '.test.') THEN 'test' WHEN path LIKE '%.md' THEN 'docs' WHEN path LIKE 'scripts/%' THEN 'script' WHEN path LIKE '%.json' THEN 'config' ELSE 'runtime' END AS category,
       count(DISTINCT path) AS files, count(*) AS lines FROM c_lines WHERE contains(text, 'assertAllowed') GROUP BY 1""")(lambda t: T.category_counts(t.lines, "assertAllowed"))
query("a8_first_seen", """
WITH f AS (SELECT path, text, min(line_no) AS pos FROM c_lines WHERE contains(text, 'KEY_') GROUP BY ALL) SELECT path, list(text ORDER BY pos, text) AS texts FROM f GROUP BY path""")(lambda t: T.first_seen(t.lines.filter("contains(text, 'KEY_')"), "path", "text", F.col("line_no")))

# ---- traversal -------------------------------------------------------------------------------------------------

_EDGE = "concat_ws('|', type, src, dst, coalesce(source_file, ''), coalesce(CAST(start_line AS VARCHAR), ''))"
_MOVES = f"m AS MATERIALIZED (SELECT DISTINCT src, dst, {_EDGE} AS e FROM g_edges WHERE coalesce(confidence, 1.0) >= 0.6)"


def _trail_sql(start: str, depth: int, both: bool) -> str:
    step = "SELECT src AS a, dst AS b, e FROM m" + (" UNION ALL SELECT dst, src, e FROM m WHERE src <> dst" if both else "")
    return f"""
WITH {_MOVES}, s AS MATERIALIZED ({step}), z AS MATERIALIZED ({start}),
r AS MATERIALIZED (SELECT 1 AS depth, a AS start, [a, b] AS nodes, [e] AS edges, b AS here FROM z JOIN s ON s.a = z.id),
r2 AS MATERIALIZED (SELECT 2 AS depth, r.start, list_append(r.nodes, s.b) AS nodes, list_append(r.edges, s.e) AS edges, s.b AS here FROM r JOIN s ON r.here = s.a WHERE NOT list_contains(r.edges, s.e)),
r3 AS (SELECT 3 AS depth, r.start, list_append(r.nodes, s.b) AS nodes, list_append(r.edges, s.e) AS edges, s.b AS here FROM r2 r JOIN s ON r.here = s.a WHERE NOT list_contains(r.edges, s.e))
{" UNION ALL ".join(f"SELECT start, depth, nodes, edges FROM {x}" for x in ("r", "r2", "r3")[:depth])}"""


query("g12_trails_forward", _trail_sql("SELECT id FROM g_nodes WHERE label = 'Project'", 2, False))(lambda t: V.trails(t.edges, t.nodes.filter("label = 'Project'"), 2, "forward"))
query("g12_trails_both", _trail_sql("SELECT id FROM g_nodes WHERE label = 'Symbol' AND name IN ('order_1', 'order_2')", 2, True))(lambda t: V.trails(t.edges, t.nodes.filter("label = 'Symbol' AND name IN ('order_1', 'order_2')"), 2, "both"))
query("g12_relations_top", _trail_sql("SELECT id FROM g_nodes WHERE label = 'Symbol' AND name = 'order_1'", 3, False) + " ORDER BY depth, edges, start LIMIT 51")(lambda t: V.relations(t.edges, t.nodes.filter("label = 'Symbol' AND name = 'order_1'"), depth=3, limit=50, direction="downstream"))


@query("g13_shortest_path", f"""
WITH {_MOVES}, s AS (SELECT src AS a, dst AS b, e FROM m UNION ALL SELECT dst, src, e FROM m),
p AS (SELECT 'package:@acme/nation_1' AS x, (SELECT id FROM g_nodes WHERE id LIKE 'file:%/lib/s1.ts' LIMIT 1) AS y),
q AS (SELECT [s1.a, s1.b] AS nodes, [s1.e] AS edges FROM p JOIN s s1 ON s1.a = p.x WHERE s1.b = p.y
  UNION ALL SELECT [s1.a, s1.b, s2.b], [s1.e, s2.e] FROM p JOIN s s1 ON s1.a = p.x JOIN s s2 ON s2.a = s1.b WHERE s2.b = p.y AND s1.e <> s2.e
  UNION ALL SELECT [s1.a, s1.b, s2.b, s3.b], [s1.e, s2.e, s3.e] FROM p JOIN s s1 ON s1.a = p.x JOIN s s2 ON s2.a = s1.b JOIN s s3 ON s3.a = s2.b WHERE s3.b = p.y AND s1.e <> s2.e AND s2.e <> s3.e AND s1.e <> s3.e)
SELECT nodes, edges FROM q ORDER BY len(edges), edges LIMIT 1""")
def g13(t: Tables) -> DataFrame:
    """A path between a package and a file."""
    target = t.nodes.filter("id LIKE 'file:%/lib/s1.ts'").select("id").first()["id"]
    return V.shortest_path(t.spark, t.edges, "package:@acme/nation_1", target, 3)


# ---- text ------------------------------------------------------------------------------------------------------

_CATEGORY = "CASE WHEN contains(path, '.test.') THEN 'test' WHEN path LIKE '%.md' THEN 'docs' WHEN path LIKE 'scripts/%' THEN 'script' WHEN path LIKE '%.json' THEN 'config' ELSE 'runtime' END"
query("t1_search_literal", f"""
WITH h AS (SELECT path, line_no, trim(text, chr(9) || ' ') AS s, CASE WHEN contains(text, 'process.env.KEY_7') THEN 'runtime_env_read' WHEN contains(text, 'KEY_7=') THEN 'env_assignment' ELSE 'literal_reference' END AS kind,
  row_number() OVER (PARTITION BY path ORDER BY line_no) AS r FROM c_lines WHERE contains(text, 'KEY_7')),
f AS (SELECT path, {_CATEGORY} AS category, count(*) AS match_count, count(*) FILTER (kind = 'runtime_env_read') AS env_reads, count(*) FILTER (kind = 'env_assignment') AS assignments, count(*) FILTER (kind = 'literal_reference') AS "references",
  list({{'line_no': line_no, 'snippet': s, 'kind': kind}} ORDER BY line_no) FILTER (r <= 3) AS matches FROM h GROUP BY path)
SELECT path, category, match_count, env_reads, assignments, "references", list_transform(matches, lambda x: x.line_no) AS lines, (SELECT count(*) FROM f) AS n_files, (SELECT count(*) FROM f) >= 100 AS truncated FROM f ORDER BY path LIMIT 100""")(lambda t: T.search_literal(t.lines, "KEY_7").withColumn("lines", F.transform("matches", lambda x: x["line_no"])).drop("matches"))
query("t1_search_prose", """
WITH d AS (SELECT concat(source, '/', lang, '/', doc_id, '.md') AS path, unnest(string_split(text, chr(10))) AS line FROM documents),
f AS (SELECT path, 'docs' AS category, count(*) AS match_count FROM d WHERE contains(line, 'é') GROUP BY path) SELECT * FROM f ORDER BY path LIMIT 40""", fixture=False)(lambda t: T.count_literal_files(t.prose, "é"))
_PLACE = "concat(source, '/', lang, '/', doc_id, '.md')"
query("s16_candidates", f"SELECT {_PLACE} AS path FROM documents WHERE contains(text, 'Apache License')", fixture=False)(lambda t: t.text_index.holding("Apache License"))
query("t1_indexed", f"""
WITH d AS (SELECT {_PLACE} AS path, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT path, 'docs' AS category, count(*) AS match_count FROM d WHERE contains(line, 'licensed under') GROUP BY path""", fixture=False)(lambda t: T.search_literal(t.text_index.lines("licensed under"), "licensed under", limit=None).select("path", "category", "match_count"))
query("t2_count_files", f"SELECT path, {_CATEGORY} AS category, count(*) AS match_count FROM c_lines WHERE contains(text, '<red_') GROUP BY path ORDER BY path LIMIT 40")(lambda t: T.count_literal_files(t.lines, "<red_"))
query("t3_env_usages", f"""
SELECT path, {_CATEGORY} AS category, count(*) AS env_reads FROM c_lines WHERE contains(text, 'process.env.KEY_3') AND {_CATEGORY} IN ('runtime', 'script') GROUP BY path ORDER BY path LIMIT 40""")(lambda t: T.find_env_usages(t.lines, "KEY_3"))
query("t4_classify_line", "SELECT CASE WHEN contains(text, 'process.env.KEY_1') THEN 'runtime_env_read' ELSE 'literal_reference' END AS kind, count(*) AS n FROM c_lines WHERE contains(text, 'KEY_1') GROUP BY 1")(lambda t: T.literal_matches(t.lines, "KEY_1").groupBy("kind").agg(F.count(F.lit(1)).alias("n")))
query("t5_snippet", """
WITH d AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), s AS (SELECT doc_id, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS x FROM d)
SELECT doc_id, CASE WHEN length(x) > 180 THEN left(x, 177) || '...' ELSE x END AS snippet FROM s""", fixture=False)(lambda t: t.raw("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", P.snippet(F.lit("a.md"), F.col("line")).alias("snippet")))
_RE2 = (r"\bre\b", r"\w\s+\w+\.", r"e.a", r"^[\w\s]+,", r"\bde\s(?:la|los)\b")
query("t6_regex_boundaries", f"""
WITH d AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, {", ".join(f"count(*) FILTER (regexp_matches(line, '{p}')) AS n{i}" for i, p in enumerate(_RE2))} FROM d GROUP BY doc_id""", fixture=False)(lambda t: t.raw("documents").filter("text IS NOT NULL").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).groupBy("doc_id").agg(*(F.count(F.when(P.matches(F.col("line"), p), 1)).alias(f"n{i}") for i, p in enumerate(_RE2))))
_KIND = rf"""CASE WHEN trim(text) LIKE '//%' THEN NULL
  WHEN regexp_matches(text, '\b(function|class|interface|type|const|let|var)\s+{SYMBOL}\b|\b{SYMBOL}\s*[:=]\s*(async\s*)?(\([^)]*\)\s*=>|function\b)|\b{SYMBOL}\s*\([^)]*\)\s*\{{') THEN 'definition'
  WHEN regexp_matches(text, '\bimport\b.*\b{SYMBOL}\b') THEN 'import' WHEN regexp_matches(text, '\.{SYMBOL}\s*\(') THEN 'method_call' WHEN regexp_matches(text, '\b{SYMBOL}\s*\(') THEN 'call'
  WHEN regexp_matches(text, '<{SYMBOL}(\s|/|>)') THEN 'jsx' WHEN regexp_matches(text, '\b{SYMBOL}\b') THEN 'reference' END"""
query("t7_symbol_kinds", f"SELECT {_KIND} AS kind, count(*) AS n FROM c_lines WHERE contains(text, '{SYMBOL}') AND {_KIND} IS NOT NULL GROUP BY 1")(lambda t: T.symbol_lines(t.lines, SYMBOL).groupBy("kind").agg(F.count(F.lit(1)).alias("n")))
_OWNER = r"""
o AS (SELECT *, coalesce(nullif(regexp_extract(text, '^\s*(?:export\s+)?(?:async\s+)?function\s+([A-Za-z_$][\w$]*)', 1), ''), nullif(regexp_extract(text, '^\s*export\s+(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=', 1), ''),
  nullif(regexp_extract(text, '^\s*(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*=>', 1), ''), CASE WHEN regexp_matches(text, '^\s*(if|for|while|switch|catch|function)\b') THEN NULL ELSE nullif(regexp_extract(text, '^\s*(?:async\s+)?([A-Za-z_$][\w$]*)\s*\([^)]*\)\s*\{', 1), '') END, '') AS own,
  length(text) - length(replace(text, '{', '')) - length(text) + length(replace(text, '}', '')) AS delta FROM c_lines WHERE NOT regexp_matches(text, '^\s*(//|\*|/\*)')),
o2 AS (SELECT *, sum(CASE WHEN own <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line_no) AS seg FROM o),
o3 AS (SELECT *, sum(delta) OVER (PARTITION BY path, seg ORDER BY line_no) AS cum FROM o2),
o4 AS (SELECT *, min(CASE WHEN seg > 0 AND cum <= 0 AND contains(text, '}') THEN line_no END) OVER (PARTITION BY path, seg) AS fin, first_value(own) OVER (PARTITION BY path, seg ORDER BY line_no) AS head FROM o3),
ow AS (SELECT path, line_no, text, seg, coalesce(line_no > fin, false) AS after_end, CASE WHEN seg = 0 OR coalesce(line_no > fin, false) THEN '' ELSE head END AS owner FROM o4)"""
query("w1_owner", f"WITH {_OWNER.strip()} SELECT path, line_no, CAST(seg AS BIGINT) AS seg, after_end, owner FROM ow")(lambda t: T.with_owner(t.lines).drop("text"))
query("w1_spans", f"WITH {_OWNER.strip()} SELECT path, line_no, CAST(seg AS BIGINT) AS seg, after_end, owner FROM ow")(lambda t: T.attributed(t.lines, t.spans).drop("text"))
query("w3_first_k", "SELECT path, line_no FROM (SELECT path, line_no, row_number() OVER (PARTITION BY path ORDER BY line_no) AS r FROM c_lines WHERE contains(text, 'assertAllowed')) WHERE r <= 3")(lambda t: T.search_literal(t.lines, "assertAllowed", limit=None).select("path", F.explode("matches").alias("m")).select("path", "m.line_no"))
_T8 = f"""
WITH {_OWNER.strip()}, k AS (SELECT *, {_KIND} AS kind FROM ow WHERE contains(text, '{SYMBOL}')),
b AS (SELECT *, CASE WHEN kind IN ('definition', 'import', 'reference') THEN kind ELSE 'call' END AS bucket, {_CATEGORY} AS category FROM k WHERE kind IS NOT NULL),
f AS (SELECT path, bucket, owner, min(line_no) AS pos FROM b WHERE owner <> '' GROUP BY ALL)
SELECT path, bucket, any_value(category) AS category, count(*) AS hit_count, coalesce((SELECT list(owner ORDER BY pos) FROM f WHERE f.path = b.path AND f.bucket = b.bucket), []) AS owners,
       count(*) FILTER (kind = 'definition') AS n_definition, count(*) FILTER (kind = 'import') AS n_import, count(*) FILTER (kind = 'method_call') AS n_method_call, count(*) FILTER (kind = 'call') AS n_call,
       count(*) FILTER (kind = 'jsx') AS n_jsx, count(*) FILTER (kind = 'reference') AS n_reference, list_slice(list(line_no ORDER BY line_no), 1, 5) AS lines
FROM b WHERE category NOT IN ('docs', 'config') GROUP BY path, bucket"""
query("t8_function_impact", _T8)(lambda t: T.function_impact(t.lines, SYMBOL, docs=False, config=False))
query("t8_spans", _T8)(lambda t: T.function_impact(t.lines, SYMBOL, spans=t.spans, docs=False, config=False))
_T9 = rf"""
WITH {_OWNER.strip()}, c AS (SELECT *, {_CATEGORY} AS category, regexp_matches(text, '(?:^|[^.\w$]){SYMBOL}\s*\(|\.{SYMBOL}\s*\(') AS calls, regexp_matches(text, '(?:^|[^.\w$])assertAllowed\s*\(') AS needs FROM ow),
q AS (SELECT *, max(CASE WHEN needs AND NOT calls THEN line_no END) OVER (PARTITION BY path, seg, after_end ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS req FROM c)
SELECT path, category, owner, line_no AS line, CAST(strpos(text, '{SYMBOL}') - 2 AS INT) AS at, req AS required_line, req IS NOT NULL AS has_required FROM q WHERE calls AND category NOT IN ('docs', 'config')"""
query("t9_callsites", _T9)(lambda t: T.callsites(t.lines, SYMBOL, "assertAllowed"))
query("t9_spans", _T9)(lambda t: T.callsites(t.lines, SYMBOL, "assertAllowed", spans=t.spans))
query("t13_rename_impact", f"""
WITH f AS (SELECT path, {_CATEGORY} AS category, count(*) AS match_count, bool_or(contains(text, 'process.env.KEY_9')) AS env_read FROM c_lines WHERE contains(text, 'KEY_9') GROUP BY path),
g AS (SELECT *, CASE category WHEN 'test' THEN 'tests' WHEN 'docs' THEN 'docs' WHEN 'config' THEN 'config' ELSE CASE WHEN env_read THEN 'runtimeReads' WHEN category = 'script' THEN 'scripts' ELSE 'other' END END AS bucket FROM f)
SELECT path, category, match_count, env_read, bucket, CASE WHEN r <= 20 THEN CAST(r AS INT) END AS rank, r <= 20 AS shown, true AS maybe_false_positive FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY path) AS r FROM g)""")(lambda t: T.rename_impact(t.lines, "KEY_9"))
query("t14_transitive_impact", rf"""
WITH {_OWNER.strip()}, e AS MATERIALIZED (SELECT DISTINCT callee, owner FROM (SELECT unnest(regexp_extract_all(text, '([A-Za-z_$][\w$]*)\s*\(', 1)) AS callee, owner FROM ow WHERE owner <> '') WHERE callee <> owner AND callee NOT IN ('if', 'for', 'while', 'switch', 'catch', 'function')),
d1 AS MATERIALIZED (SELECT DISTINCT owner AS symbol FROM e WHERE callee = '{SYMBOL}'),
d2 AS (SELECT DISTINCT e.owner AS symbol FROM d1 JOIN e ON e.callee = d1.symbol WHERE e.owner <> '{SYMBOL}' AND e.owner NOT IN (SELECT symbol FROM d1))
SELECT symbol, 1 AS depth FROM d1 UNION ALL SELECT symbol, 2 FROM d2""")(lambda t: T.transitive_impact(t.calling_lines, SYMBOL))
query("t15_related_tests", """
WITH f AS (SELECT DISTINCT path FROM g_files UNION SELECT regexp_replace(path, '\\.ts$', '.test.ts') FROM g_files WHERE k % 7 = 0 UNION SELECT regexp_replace(path, '/([^/]*)\\.tsx$', '/__tests__/\\1.spec.ts') FROM g_files WHERE k % 3 = 0), s AS (SELECT path, regexp_replace(path, '\\.[^./]*$', '') AS stem FROM f WHERE NOT contains(path, '.test.'))
SELECT s.path AS seed, f.path FROM s JOIN f ON f.path IN (s.stem || '.test.ts', s.stem || '.test.tsx', s.stem || '.spec.ts', regexp_replace(s.stem, '/([^/]*)$', '/__tests__/\\1.spec.ts')) WHERE NOT contains(s.path, '.spec.')""")(lambda t: T.related_tests(t.files_with_tests, t.files_with_tests.filter("NOT contains(path, '.test.') AND NOT contains(path, '.spec.')")))
query("t16_import_terms", r"""
WITH p AS (SELECT path, regexp_replace(path, '\.[^./]*$', '') AS bare FROM g_nodes WHERE label = 'File'),
u AS (SELECT path AS seed, array_to_string(list_slice(string_split(bare, '/'), -2, -1), '/') AS term FROM p UNION SELECT path, regexp_extract(bare, '[^/]*$') FROM p WHERE length(regexp_extract(bare, '[^/]*$')) >= 3)
SELECT * FROM u""")(lambda t: T.import_terms(t.nodes.filter("label = 'File'").select("path")))
query("p1_classify_path", f"SELECT path, {_CATEGORY} AS category FROM g_nodes WHERE label = 'File'")(lambda t: t.nodes.filter("label = 'File'").select("path", P.classify_path(F.col("path")).alias("category")))
query("p4_searchable", """
WITH f AS (SELECT path || CASE length(path) % 6 WHEN 0 THEN '.png' WHEN 1 THEN '' WHEN 2 THEN '/.env.local' WHEN 3 THEN '.MD' WHEN 4 THEN '/LICENSE' ELSE '.YAML' END AS path, length(path) % 6 AS m FROM g_nodes WHERE label = 'File')
SELECT path, m NOT IN (0, 4) AS ok FROM f""")(lambda t: t.odd_files.select("path", P.is_searchable(F.col("path")).alias("ok")))
query("p3_skip_path", """
WITH f AS (SELECT CASE length(path) % 6 WHEN 0 THEN 'node_modules/' WHEN 1 THEN '' WHEN 2 THEN 'x/.hidden/' WHEN 3 THEN 'tmp/' WHEN 4 THEN 'a/dist/' ELSE 'x/tmp/' END || path AS path, length(path) % 6 AS m FROM g_nodes WHERE label = 'File')
SELECT path, m IN (0, 2, 3, 4) AS skipped, m IN (0, 4) AS skipped_open FROM f""")(lambda t: t.placed_files.select("path", P.skip_path(F.col("path")).alias("skipped"), P.skip_path(F.col("path"), hidden=True, tmp=True).alias("skipped_open")))
query("k5_normalize_path", """
SELECT path, CASE WHEN length(path) % 3 = 2 THEN NULL ELSE path END AS clean FROM g_nodes WHERE label = 'File'""")(lambda t: t.nodes.filter("label = 'File'").select("path", P.normalize_path(F.when(F.length("path") % 3 == 0, F.concat(F.lit("  ./"), F.replace(F.col("path"), F.lit("/"), F.lit("\\")))).when(F.length("path") % 3 == 2, F.lit(" . ")).otherwise(F.col("path"))).alias("clean")))
query("k4_is_identifier", "SELECT name, regexp_matches(name, '^[A-Za-z_$][A-Za-z0-9_$]*$') AS ok, count(*) AS n FROM g_nodes WHERE name IS NOT NULL GROUP BY ALL")(lambda t: t.nodes.filter("name IS NOT NULL").groupBy("name", P.is_identifier(F.col("name")).alias("ok")).agg(F.count(F.lit(1)).alias("n")))
query("p5_path_in_scope", "SELECT path FROM g_nodes WHERE label = 'File' AND path LIKE 'packages/%' AND contains(path, '/nation_4/')")(lambda t: t.nodes.filter((F.col("label") == "File") & P.path_in_scope(F.col("path"), "packages/", "@acme/nation_4")).select("path"))
_BASES = {"page.tsx": "page", "layout.js": "layout", "route.ts": "route", "a.spec.ts": "test", "next.config.ts": "config", "b.jsx": "component", "pages.ts": "source", "route.tsx": "component"}
query("x5_file_kind", f"""
WITH f AS (SELECT 'app/' || k || '/' || {list(_BASES)}[k % 8 + 1] AS path, k % 8 AS m FROM g_files) SELECT path, {list(_BASES.values())}[m + 1] AS kind FROM f""")(lambda t: t.get("g_files").select(F.concat(F.lit("app/"), F.col("k").cast("string"), F.lit("/"), F.get(F.array(*(F.lit(x) for x in _BASES)), (F.col("k") % 8).cast("int"))).alias("path")).select("path", P.file_kind(F.col("path")).alias("kind")))
query("s17_open_excerpt", """
WITH p AS (SELECT path FROM c_lines GROUP BY path HAVING count(*) >= 6 ORDER BY path LIMIT 1) SELECT path, 2 AS start_line, 5 AS end_line, false AS truncated, string_agg(text, chr(10) ORDER BY line_no) AS text FROM c_lines WHERE path = (SELECT path FROM p) AND line_no BETWEEN 2 AND 5 GROUP BY path""")(lambda t: T.open_excerpt(t.lines, t.lines.groupBy("path").count().filter("count >= 6").orderBy("path").first()["path"], 2, 5))

# ---- plans -----------------------------------------------------------------------------------------------------

_TEXT_SIDE = f"tx AS (SELECT path, CASE WHEN kind IN ('definition', 'import', 'reference') THEN kind ELSE 'call' END AS bucket, count(*) AS n FROM (SELECT path, {_KIND} AS kind FROM c_lines WHERE contains(text, '{SYMBOL}')) WHERE kind IS NOT NULL GROUP BY ALL)"
_GRAPH_SIDE = f"""
si AS (SELECT id, path FROM g_nodes WHERE label = 'Symbol' AND name = '{SYMBOL}'),
gx AS (SELECT e.source_file AS path, 'call' AS bucket FROM g_edges e WHERE e.dst IN (SELECT id FROM si) AND e.type IN ('CALLS', 'RENDERS', 'INSTANTIATES') AND coalesce(e.confidence, 1.0) >= 0.6
  UNION ALL SELECT e.source_file, 'import' FROM g_edges e WHERE e.dst IN (SELECT id FROM si) AND e.type = 'IMPORTS_SYMBOL' UNION ALL SELECT path, 'definition' FROM si),
gc AS (SELECT path, bucket, count(*) AS n FROM gx GROUP BY ALL)"""
query("h1_merge_impact", f"""
WITH {_TEXT_SIDE}, {_GRAPH_SIDE.strip()}
SELECT coalesce(tx.path, gc.path) AS path, coalesce(tx.bucket, gc.bucket) AS bucket, coalesce(tx.n, 0) AS text_hits, coalesce(gc.n, 0) AS graph_hits, CASE WHEN tx.n IS NULL THEN 'graph' WHEN gc.n IS NULL THEN 'text' ELSE 'hybrid' END AS method
FROM tx FULL JOIN gc ON tx.path = gc.path AND tx.bucket = gc.bucket""")(lambda t: H.function_impact(t.nodes, t.edges, t.lines, SYMBOL))
query("h2_confidence", f"""
WITH {_TEXT_SIDE}, {_GRAPH_SIDE.strip()},
j AS (SELECT coalesce(tx.path, gc.path) AS path, coalesce(tx.bucket, gc.bucket) AS bucket, coalesce(tx.n, 0) % 2 AS files, gc.n IS NULL AS bare FROM tx FULL JOIN gc ON tx.path = gc.path AND tx.bucket = gc.bucket)
SELECT path, bucket, CASE WHEN length(path) % 7 = 0 OR length(path) % 11 = 0 THEN 'low' WHEN NOT bare THEN CASE WHEN bucket = 'import' THEN 'medium' ELSE 'high' END WHEN files > 0 THEN 'medium' ELSE 'low' END AS confidence FROM j""")(
    lambda t: H.function_impact(t.nodes, t.edges, t.lines, SYMBOL).select("path", "bucket", H.impact_confidence(F.col("method"), F.col("bucket") != "import", F.length("path") % 7 == 0, F.length("path") % 11 == 0, F.col("text_hits") % 2).alias("confidence")))
query("a9_rollup_low", "SELECT CASE WHEN bool_or(l_quantity > 49) THEN 'low' ELSE 'high' END AS confidence FROM lineitem GROUP BY l_suppkey HAVING l_suppkey = 1 UNION ALL SELECT 'medium'", fixture=False)(lambda t: H.rollup_confidence(t.raw("lineitem").filter("l_suppkey = 1").select(F.when(F.col("l_quantity") > 49, "low").otherwise("high").alias("confidence"))).unionByName(H.rollup_confidence(t.raw("lineitem").filter("l_suppkey = 1").select(F.lit("medium").alias("confidence")))))
query("a9_rollup_method", """
SELECT 'graph and text' AS case_, 'hybrid' AS method UNION ALL SELECT 'graph', 'graph' UNION ALL SELECT 'text', 'text' FROM (SELECT 1) WHERE (SELECT count(*) FROM nation) > 0""", fixture=False)(lambda t: H.rollup_method(t.raw("nation").select(F.when(F.col("n_nationkey") % 2 == 0, "graph").otherwise("text").alias("method"))).select(F.lit("graph and text").alias("case_"), "method").unionByName(H.rollup_method(t.raw("nation").select(F.lit("graph").alias("method"))).select(F.lit("graph").alias("case_"), "method")).unionByName(H.rollup_method(t.raw("nation").select(F.lit("text").alias("method"))).select(F.lit("text").alias("case_"), "method")))
query("a9_rollup", "SELECT CASE WHEN max(l_discount) > 1 THEN 'low' WHEN bool_or(l_returnflag = 'R') THEN 'high' ELSE 'medium' END AS confidence FROM lineitem", fixture=False)(lambda t: H.rollup_confidence(t.raw("lineitem").select(F.when(F.col("l_returnflag") == "R", "high").otherwise("medium").alias("confidence"))))
query("h7_package_hint", "SELECT path, regexp_extract(path, '^((packages|apps)/[^/]+)/', 1) AS hint FROM g_nodes WHERE label = 'File'")(lambda t: t.nodes.filter("label = 'File'").select("path", P.package_hint(F.col("path")).alias("hint")))
_TERMS = r"tm AS (SELECT DISTINCT unnest([regexp_extract(regexp_replace(path, '\.[^./]*$', ''), '[^/]+/[^/]+$')]) AS term FROM s)"
_PATH_SET = f"""WITH s AS ({_SEEDS}), {_TERMS},
dep AS (SELECT DISTINCT coalesce(o.path, o.id) AS path, 1 AS rank, 'dependent' AS role, 'graph' AS how FROM s JOIN g_edges e ON e.dst = s.id JOIN g_nodes o ON o.id = e.src WHERE e.type IN ('IMPORTS_FILE', 'RE_EXPORTS_FILE', 'DYNAMIC_IMPORTS_FILE', 'TESTS_FILE') AND coalesce(e.confidence, 1.0) >= 0.5),
pro AS (SELECT DISTINCT coalesce(o.path, o.id) AS path, 4 AS rank, 'dependency' AS role, 'graph' AS how FROM s JOIN g_edges e ON e.src = s.id JOIN g_nodes o ON o.id = e.dst WHERE e.type IN ('IMPORTS_FILE', 'RE_EXPORTS_FILE', 'DYNAMIC_IMPORTS_FILE') AND coalesce(e.confidence, 1.0) >= 0.5),
txt AS (SELECT DISTINCT path, CASE WHEN contains(path, '.test.') THEN 3 ELSE 2 END AS rank, CASE WHEN contains(path, '.test.') THEN 'test' ELSE 'importer' END AS role, 'text' AS how FROM c_lines, tm WHERE contains(text, term)),
u AS (SELECT path, 0 AS rank, 'seed' AS role, 'given' AS how FROM s UNION ALL SELECT * FROM dep UNION ALL SELECT * FROM pro UNION ALL SELECT * FROM txt)"""
query("h6_path_set_impact", f"""{_PATH_SET}
SELECT path, arg_min(role, rank) AS role, CASE WHEN bool_or(how = 'graph') AND bool_or(how = 'text') THEN 'hybrid' WHEN bool_or(how = 'graph') THEN 'graph' WHEN bool_or(how = 'text') THEN 'text' ELSE 'none' END AS method,
       regexp_extract(path, '^((packages|apps)/[^/]+)/', 1) AS package FROM u GROUP BY path""")(lambda t: H.path_set_impact(t.nodes, t.edges, t.lines, t.seeds))
_OTHER = lambda sql: sql.replace(SYMBOL, "hot_gear").replace("tx AS", "tx2 AS").replace("si AS", "si2 AS").replace("FROM si", "FROM si2").replace("gx AS", "gx2 AS").replace("FROM gx", "FROM gx2").replace("gc AS", "gc2 AS")
query("h8_change_plan", f"""{_PATH_SET}, {_TEXT_SIDE}, {_GRAPH_SIDE.strip()}, {_OTHER(_TEXT_SIDE)}, {_OTHER(_GRAPH_SIDE.strip())},
im AS (SELECT path, arg_min(role, rank) AS role FROM u GROUP BY path),
al AS (SELECT path, 0 AS rank FROM s UNION ALL SELECT path, 1 FROM im WHERE role NOT IN ('seed', 'dependency')
  UNION ALL SELECT path, CASE bucket WHEN 'definition' THEN 0 ELSE 1 END FROM (SELECT path, bucket FROM tx UNION ALL SELECT path, bucket FROM gc UNION ALL SELECT path, bucket FROM tx2 UNION ALL SELECT path, bucket FROM gc2) WHERE bucket <> 'reference')
SELECT path, CASE min(rank) WHEN 0 THEN 'edit' ELSE 'verify' END AS action, contains(path, '.test.') AS is_test, CASE WHEN min(rank) = 0 THEN 0 WHEN contains(path, '.test.') THEN 2 ELSE 1 END AS place FROM al GROUP BY path""")(lambda t: H.change_plan(t.nodes, t.edges, t.lines, [SYMBOL, "hot_gear"], t.seeds))
query("h9_rename_plan", f"""
WITH i(layer, ident) AS (VALUES ('path', 'apps/red_plate'), ('package', 'assertAllowed'), ('ci', 'build-red_plate'), ('ci', 'deploy-red_plate'), ('ci', 'red_plate-buildcache'), ('docker', 'APP_DIR=red_plate'), ('name', 'red_plate')),
l AS (SELECT path, replace(replace(text, 'KEY_4', 'APP_DIR=red_plate'), 'KEY_5', 'build-red_plate') AS text FROM c_lines)
SELECT path, layer, count(*) AS mentions, {_CATEGORY} AS bucket FROM l JOIN i ON contains(text, ident) GROUP BY path, layer""")(lambda t: H.rename_plan(t.lines.withColumn("text", F.replace(F.replace("text", F.lit("KEY_4"), F.lit("APP_DIR=red_plate")), F.lit("KEY_5"), F.lit("build-red_plate"))), H.rename_identities("apps/red_plate", "assertAllowed", True)))
query("h9_identities", """
SELECT * FROM (VALUES ('path', 'apps/web.v2'), ('package', '@acme/web'), ('ci', 'build-web.v2'), ('ci', 'deploy-web.v2'), ('ci', 'web.v2-buildcache'), ('docker', 'APP_DIR=web.v2'), ('name', 'web.v2')) v(layer, ident)""", fixture=False)(lambda t: t.spark.createDataFrame(H.rename_identities("apps/web.v2", "@acme/web", True), "layer string, ident string"))
query("h11_feature_context", f"""
WITH a AS (SELECT path, 0 AS grp, count(*) AS match_count FROM c_lines WHERE contains(text, 'KEY_2') AND {_CATEGORY} NOT IN ('docs', 'config') GROUP BY path)
SELECT path, grp, match_count, contains(path, '.test.') AS is_test FROM a ORDER BY grp, match_count DESC, path LIMIT 25""")(lambda t: H.feature_context(t.nodes, t.lines, "KEY_2"))

# ---- events ----------------------------------------------------------------------------------------------------


def _event_rows(t: Tables) -> DataFrame:
    """The events table as graph events: one node event an event, the type as its label's name."""
    e = t.raw("events")
    props = F.create_map(F.lit("name"), F.col("event_type"), F.lit("startLine"), F.get_json_object("props", "$.k"))
    return e.select(
        F.lit(E.PROTOCOL).alias("protocol"), F.when(F.col("event_id") % 50 == 0, "nonsense").otherwise("node").alias("type"), F.lit("Symbol").alias("label"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("id"),
        F.lit(None).cast("string").alias("rel"), F.lit(None).cast("string").alias("from"), F.lit(None).cast("string").alias("to"), F.lit("events").alias("source"), F.lit(None).cast("string").alias("message"),
        props.alias("props"), F.to_json(F.struct("event_id")).alias("raw"), F.col("event_id").alias("seq"),
    )


query("s2_validate", "SELECT coalesce(CASE WHEN event_id % 50 = 0 THEN 'unknown type' END, 'ok') AS error, count(*) AS n FROM events GROUP BY 1", fixture=False)(lambda t: _event_rows(t).select(F.coalesce(E.error(), F.lit("ok")).alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("n")))
query("s3_ordered", "SELECT user_id, min(event_id) AS seq FROM events WHERE event_id % 50 <> 0 GROUP BY user_id", fixture=False)(lambda t: E.ordered(_event_rows(t).filter("type = 'node'")).select(F.substr("id", F.lit(2)).cast("long").alias("user_id"), "seq"))
query("s4_upsert_nodes", """
SELECT 'ns:u' || user_id AS id, arg_max(event_type, event_id) AS name, arg_max(CAST(json_extract_string(props, '$.k') AS BIGINT), event_id) FILTER (json_extract_string(props, '$.k') IS NOT NULL) AS start_line FROM events WHERE event_id % 50 <> 0 GROUP BY user_id""", fixture=False)(lambda t: E.nodes_of(E.split_valid(_event_rows(t))[0], "ns").select("id", "name", F.col("startLine").alias("start_line")))
query("s5_attached_edges", """
SELECT e.type, e.src, e.dst, count(*) AS n FROM g_edges e WHERE e.src IN (SELECT id FROM g_nodes WHERE label = 'File') AND e.dst IN (SELECT id FROM g_nodes WHERE label = 'File') GROUP BY ALL""")(lambda t: E.attached(t.edges, t.nodes.filter("label = 'File'")).groupBy("type", "src", "dst").agg(F.count(F.lit(1)).alias("n")))
query("s6_edge_identity", "SELECT type, count(DISTINCT (src, dst, coalesce(source_file, ''), coalesce(CAST(start_line AS VARCHAR), ''))) AS n FROM g_edges GROUP BY type")(lambda t: _edge_rows(t).select("rel", E.identity().alias("i")).groupBy(F.col("rel").alias("type")).agg(F.countDistinct("i").alias("n")))
query("s7_scoped_id", "SELECT 'ns:' || id AS scoped, id AS back FROM g_nodes")(lambda t: t.nodes.select(E.scoped(F.lit("ns"), F.col("id")).alias("scoped")).select("scoped", E.unscoped(F.lit("ns"), F.col("scoped")).alias("back")))
query("s12_duplicates", "SELECT id, count(*) AS n FROM (SELECT id FROM g_nodes UNION ALL SELECT id FROM g_nodes WHERE label IN ('Package', 'Project')) GROUP BY id HAVING count(*) > 1")(lambda t: E.duplicates(t.nodes.unionByName(t.nodes.filter("label IN ('Package', 'Project')"))))


def _edge_rows(t: Tables) -> DataFrame:
    """The edges as edge events."""
    props = F.map_filter(F.create_map(F.lit("sourceFile"), F.col("source_file"), F.lit("startLine"), F.col("start_line").cast("string"), F.lit("confidence"), F.col("confidence").cast("string")), lambda _, v: v.isNotNull())
    none = F.lit(None).cast("string")
    cols = {"protocol": F.lit(E.PROTOCOL), "type": F.lit("edge"), "label": none, "id": none, "rel": F.col("type"), "from": F.col("src"), "to": F.col("dst"), "source": F.lit("edges"), "message": none, "props": props}
    return t.edges.select(*(c.alias(k) for k, c in cols.items())).withColumn("raw", F.to_json(F.struct("rel", "from", "to", "props"))).withColumn("seq", F.lit(0).cast("long"))


def _written(t: Tables) -> str:
    """The events as NDJSON files in their order, one line an event."""
    path = fresh_folder(t.spark, "events")
    rows = _event_rows(t).orderBy("seq")
    cols = ("protocol", "type", "label", "id", "rel", "from", "to", "source", "message", "props")
    rows.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in cols))).alias("value")).write.text(path)
    return path


_LAST = """
SELECT 'ns:u' || user_id AS id, arg_max(event_type, event_id) AS name, arg_max(CAST(json_extract_string(props, '$.k') AS BIGINT), event_id) FILTER (json_extract_string(props, '$.k') IS NOT NULL) AS start_line FROM events WHERE event_id % 50 <> 0 GROUP BY user_id"""


def _last_values(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", "name", F.col("startLine").alias("start_line"))


query("s1_read_events", _LAST, fixture=False)(lambda t: _last_values(E.nodes_of(E.split_valid(E.read(t.spark, _written(t)))[0], "ns")))


@query("streaming_ingest", _LAST, fixture=False)
def streaming(t: Tables) -> DataFrame:
    """The same through a stream that ends when all files are read."""
    root = fresh_folder(t.spark, "ingest")
    ingest.start(t.spark, _written(t), root, "ns", f"{root}/checkpoint").awaitTermination()
    return _last_values(ingest.current(t.spark, root)[0])



@query("streaming_late_edges", """
WITH e AS (SELECT *, row_number() OVER (ORDER BY event_id) AS r, count(*) OVER () AS n FROM events),
u AS (SELECT DISTINCT user_id FROM e WHERE event_id % 3 = 0)
SELECT 'TRIED' AS type, 'ns:u' || user_id AS src, 'ns:k' || event_type AS dst, count(*) AS n FROM e WHERE event_id % 3 <> 0 AND user_id IN (SELECT user_id FROM u) GROUP BY ALL""", fixture=False)
def late_edges(t: Tables) -> DataFrame:
    """Every event is an edge or a node, ends come before or after their edges, many batches are merged on the way."""
    e, none = t.raw("events"), F.lit(None).cast("string")
    node, late = F.col("event_id") % 3 == 0, F.create_map(F.lit("startLine"), F.col("event_id").cast("string"))
    user, kind = F.concat(F.lit("u"), F.col("user_id").cast("string")), F.concat(F.lit("k"), "event_type")
    cols = {"protocol": F.lit(E.PROTOCOL), "type": F.when(node, "node").otherwise("edge"), "label": F.when(node, "User"), "id": F.when(node, user), "rel": F.when(~node, "TRIED"), "from": F.when(~node, user), "to": F.when(~node, kind), "source": F.lit("events"), "message": none, "props": F.when(~node, late)}
    rows = e.select(*(c.alias(k) for k, c in cols.items()))
    kinds = e.select(kind.alias("id")).distinct().select(F.lit(E.PROTOCOL).alias("protocol"), F.lit("node").alias("type"), F.lit("Kind").alias("label"), "id", *(none.alias(c) for c in ("rel", "from", "to")), F.lit("events").alias("source"), none.alias("message"), F.lit(None).cast("map<string,string>").alias("props"))
    source, root = fresh_folder(t.spark, "events"), fresh_folder(t.spark, "ingest")
    rows.repartition(5).unionByName(kinds.coalesce(1)).select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in cols))).alias("value")).write.text(source)
    ingest.start(t.spark, source, root, "ns", f"{root}/checkpoint", fan=3, files_per_batch=1).awaitTermination()
    return ingest.current(t.spark, root)[1].groupBy("type", "src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query("s10_removed", """
WITH k AS (SELECT event_type, row_number() OVER (ORDER BY event_type) AS r FROM (SELECT DISTINCT event_type FROM events))
SELECT k.event_type AS namespace, count(DISTINCT user_id) AS stored FROM events JOIN k ON k.event_type = events.event_type WHERE r % 2 = 0 AND event_id % 50 <> 0 GROUP BY k.event_type""", fixture=False)
def removed(t: Tables) -> DataFrame:
    """A namespace for each type of event, each loaded twice, every other one reset; then what files are left."""
    store, rows = GraphStore(t.spark, fresh_folder(t.spark, "store")), _event_rows(t).filter("type = 'node'").withColumn("label", F.lit("User"))
    kinds = [r["name"] for r in rows.select(F.col("props")["name"].alias("name")).distinct().orderBy("name").collect()]  # a handful
    for i, kind in enumerate(kinds):
        for _ in range(2):
            store.load(rows.filter(F.col("props")["name"] == kind), kind)
        if i % 2 == 0:
            store.reset(kind)
    store.vacuum(0)
    left = t.spark.read.option("recursiveFileLookup", "true").parquet(f"{store.root}/nodes")
    return left.groupBy("namespace").agg(F.count(F.lit(1)).alias("stored"))


@query("s8_meta", "SELECT 'Meta' AS label, 'note ' || event_type AS name, count(*) > 0 AS some FROM events WHERE event_id % 2 = 0 GROUP BY event_type", fixture=False)
def meta(t: Tables) -> DataFrame:
    """Warnings as nodes, one a message."""
    rows = _event_rows(t).filter("seq % 2 = 0").withColumn("message", F.concat(F.lit("note "), F.col("props")["name"])).withColumn("type", F.lit("warning")).withColumn("props", F.create_map().cast("map<string,string>"))
    return E.meta_of(rows, "ns").groupBy("label", "name").agg((F.count(F.lit(1)) == 1).alias("some"))


@query("s9_store_edges", "SELECT type, src, dst, count(DISTINCT (coalesce(source_file, ''), coalesce(CAST(start_line AS VARCHAR), ''))) AS n FROM g_edges WHERE src IN (SELECT id FROM g_nodes) AND dst IN (SELECT id FROM g_nodes) AND type LIKE '%FILE' GROUP BY ALL")
def store_edges(t: Tables) -> DataFrame:
    """Node and edge events applied to a store and read back."""
    none = F.lit(None).cast("string")
    cols = {"protocol": F.lit(E.PROTOCOL), "type": F.lit("node"), "label": F.col("label"), "id": F.col("id"), "rel": none, "from": none, "to": none, "source": F.lit("nodes"), "message": none}
    nodes = t.nodes.select(*(c.alias(k) for k, c in cols.items())).withColumn("props", F.create_map().cast("map<string,string>")).withColumn("raw", F.col("id")).withColumn("seq", F.lit(0).cast("long"))
    store = GraphStore(t.spark, fresh_folder(t.spark, "store"))
    store.load(nodes.unionByName(_edge_rows(t).filter("rel LIKE '%FILE'")), "ns")
    return store.edges("ns").groupBy("type", F.col("source_from").alias("src"), F.col("source_to").alias("dst")).agg(F.count(F.lit(1)).alias("n"))


@query("s13_namespaces", "SELECT * FROM (VALUES ('b', 'repo-b', 'typescript', 'fast'), ('c', 'repo-c', 'typescript', 'full')) v(name, repo, language, analysis_mode)", fixture=False)
def namespaces(t: Tables) -> DataFrame:
    """The registry after three loads and one reset."""
    store = GraphStore(t.spark, fresh_folder(t.spark, "store"))
    rows = _event_rows(t).filter("type = 'node' AND seq < 200")
    for name, mode in (("a", "full"), ("b", "fast"), ("c", "other")):
        store.load(rows, name, f"repo-{name}", "typescript", mode)
    store.reset("a")
    return store.namespaces().select("name", "repo", "language", "analysis_mode")


@query("s11_reset_all", "SELECT 0 AS namespaces, 0 AS nodes, 0 AS edges FROM events LIMIT 1", fixture=False)
def reset_all(t: Tables) -> DataFrame:
    """Nothing is left after all namespaces are reset."""
    store = GraphStore(t.spark, fresh_folder(t.spark, "store"))
    store.load(_event_rows(t).filter("type = 'node' AND seq < 100"), "a")
    store.reset_all()
    left = store.status()
    return t.spark.createDataFrame([(store.namespaces().count(), left["nodes"], left["edges"])], "namespaces int, nodes int, edges int")


query("s9_upsert", """
SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(n.name, o.name) AS name FROM
  (SELECT user_id, arg_max(event_type, event_id) AS name FROM events WHERE event_id % 3 = 0 GROUP BY user_id) o FULL JOIN (SELECT user_id, CASE WHEN user_id % 4 = 0 THEN NULL ELSE arg_max(event_type, event_id) END AS name FROM events WHERE event_id % 5 = 0 GROUP BY user_id) n ON o.user_id = n.user_id""", fixture=False)(
    lambda t: E.upsert(t.raw("events").filter("event_id % 3 = 0").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("name")), t.raw("events").filter("event_id % 5 = 0").groupBy("user_id").agg(F.when(F.col("user_id") % 4 != 0, F.max_by("event_type", "event_id")).alias("name")), ["user_id"]))
query("k13_prefixed", "SELECT id, id AS same, CASE WHEN name IS NULL THEN NULL ELSE 'package:' || name END AS pkg FROM g_nodes WHERE label IN ('Package', 'File')")(lambda t: t.nodes.filter("label IN ('Package', 'File')").select("id", F.when(F.col("label") == "File", E.prefixed("file", F.col("id"))).otherwise(E.prefixed("package", F.col("id"))).alias("same"), E.prefixed("package", F.col("name")).alias("pkg")))


@query("s20_export", """
SELECT 'node' AS family, label AS kind, id AS a, CAST(NULL AS VARCHAR) AS b, CAST(1 AS BIGINT) AS n FROM g_nodes UNION ALL SELECT 'edge', type, src, dst, count(*) FROM g_edges GROUP BY ALL
UNION ALL SELECT 'node count', coalesce(label, 'Unknown'), NULL, NULL, count(*) FROM g_nodes GROUP BY ALL UNION ALL SELECT 'edge count', type, NULL, NULL, count(*) FROM g_edges GROUP BY ALL""")
def exported(t: Tables) -> DataFrame:
    """The whole graph written as tables and read back: all nodes, all edges, all counts."""
    path = fresh_folder(t.spark, "export")
    export.export(t.nodes, t.edges, path)
    none, one = F.lit(None).cast("string"), F.lit(1).cast("long")
    nodes = t.spark.read.json(f"{path}/nodes").select(F.lit("node").alias("family"), F.col("label").alias("kind"), F.col("id").alias("a"), none.alias("b"), one.alias("n"))
    edges = t.spark.read.json(f"{path}/edges").groupBy(F.lit("edge").alias("family"), F.col("type").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    counts = t.spark.read.json(f"{path}/counts").select(F.concat("family", F.lit(" count")).alias("family"), F.col("name").alias("kind"), none.alias("a"), none.alias("b"), "n")
    return nodes.unionByName(edges).unionByName(counts)


# ---- extractor -------------------------------------------------------------------------------------------------

_TREE = """
x_files AS (
  SELECT concat('packages/', lower(n_name), '/lib/s', CAST(s_suppkey AS STRING), '.ts') AS path, s_suppkey AS k, lower(n_name) AS nat,
         concat('import { f', CAST(s_suppkey + 1 AS STRING), ' } from "./s', CAST(s_suppkey + 1 AS STRING), '";', chr(10), 'import r from "react";', chr(10), 'export function f', CAST(s_suppkey AS STRING), '(a) {', chr(10), '  const key = process.env.KEY_', CAST(s_suppkey % 5 AS STRING), ';', chr(10), '  return key;', chr(10), '}', chr(10)) AS content
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
x_tests AS (SELECT concat('packages/', nat, '/lib/s', CAST(k AS STRING), '.test.ts') AS path, k, nat, concat('import { f', CAST(k AS STRING), ' } from "./s', CAST(k AS STRING), '";', chr(10), 'test("case ', CAST(k AS STRING), '", () => {', chr(10), '  f', CAST(k AS STRING), '(1);', chr(10), '});', chr(10)) AS content FROM x_files WHERE k % 3 = 0),
x_pages AS (SELECT concat('packages/', nat, '/app/p', CAST(k AS STRING), '/page.tsx') AS path, k, nat, concat('export default function Page', CAST(k AS STRING), '() {', chr(10), '  return null;', chr(10), '}', chr(10)) AS content FROM x_files WHERE k % 4 = 0),
x_types AS (SELECT concat('packages/', nat, '/lib/t', CAST(k AS STRING), '.d.ts') AS path, k, nat, 'declare const t: number;' AS content FROM x_files WHERE k % 5 = 0),
x_manifests AS (SELECT concat('packages/', lower(n_name), '/package.json') AS path, n_nationkey AS k, lower(n_name) AS nat, concat('{"name": "@acme/', lower(n_name), '", "dependencies": {"react": "1"', CASE WHEN n_nationkey > 0 THEN ', "@acme/nation_0": "2"' ELSE '' END, '}}') AS content FROM nation),
x_tree AS (SELECT * FROM x_files UNION ALL SELECT * FROM x_tests UNION ALL SELECT * FROM x_pages UNION ALL SELECT * FROM x_types UNION ALL SELECT * FROM x_manifests)"""


def _extract(t: Tables, sql: str, path: str) -> None:
    for name in ("supplier", "nation"):
        t.raw(name).createOrReplaceTempView(name)
    with Kept() as keep:
        X.extract(t.spark.sql(sql), relations=True, keep=keep).write.parquet(path)


def _extracted(t: Tables) -> DataFrame:
    """Events of a source tree made of the suppliers and nations, written once a session."""
    return _once(t, "extracted", lambda path: _extract(t, f"WITH {_TREE} SELECT path, content FROM x_tree", path))


def _tree_query(name: str, sql: str) -> Callable:
    return query(name, f"WITH {_TREE}{',' if sql.startswith('WITH ') else ''} {sql.removeprefix('WITH ')}", fixture=False)


def _edges_of(t: Tables, *rels: str) -> DataFrame:
    return _extracted(t).filter(F.col("type") == "edge").filter(F.col("rel").isin(*rels)).select("rel", F.col("from").alias("src"), F.col("to").alias("dst")).distinct()


_tree_query("x6_files", "SELECT 'file:' || path AS id, 'package:@acme/' || nat AS package_id, CASE WHEN path LIKE '%.test.ts' THEN 'test' WHEN path LIKE '%/page.tsx' THEN 'page' ELSE 'source' END AS kind FROM x_tree WHERE path NOT LIKE '%.json' AND path NOT LIKE '%.d.ts'")(
    lambda t: _extracted(t).filter("label = 'File'").select("id", F.col("props")["packageId"].alias("package_id"), F.col("props")["kind"].alias("kind")))
_tree_query("x2_packages", "SELECT 'package:@acme/' || nat AS id, 'packages/' || nat AS root FROM x_manifests")(lambda t: _extracted(t).filter("label = 'Package'").select("id", F.col("props")["root"].alias("root")))
_tree_query("x3_contains", "SELECT 'CONTAINS_FILE' AS rel, 'package:@acme/' || nat AS src, 'file:' || path AS dst FROM x_tree WHERE path NOT LIKE '%.json' AND path NOT LIKE '%.d.ts' UNION SELECT 'CONTAINS_FILE', 'project:packages/' || nat, 'file:' || path FROM x_tree WHERE path NOT LIKE '%.json' AND path NOT LIKE '%.d.ts'")(lambda t: _edges_of(t, "CONTAINS_FILE"))
_tree_query("x8_imports", "SELECT DISTINCT 'IMPORTS_FILE' AS rel, 'file:' || a.path AS src, 'file:' || b.path AS dst FROM x_files a JOIN x_files b ON b.nat = a.nat AND b.k = a.k + 1 UNION SELECT 'IMPORTS_FILE', 'file:' || a.path, 'file:' || b.path FROM x_tests a JOIN x_files b ON b.k = a.k")(lambda t: _edges_of(t, "IMPORTS_FILE"))
_tree_query("x9_package_imports", "SELECT 'IMPORTS_EXTERNAL_PACKAGE' AS rel, 'file:' || path AS src, 'external:npm:react' AS dst FROM x_files UNION ALL SELECT 'USES_EXTERNAL_PACKAGE', 'package:@acme/' || nat, 'external:npm:react' FROM x_manifests UNION ALL SELECT 'DEPENDS_ON_PACKAGE', 'package:@acme/' || nat, 'package:@acme/nation_0' FROM x_manifests WHERE k > 0")(lambda t: _edges_of(t, "IMPORTS_EXTERNAL_PACKAGE", "USES_EXTERNAL_PACKAGE", "DEPENDS_ON_PACKAGE"))
_tree_query("x10_symbols", "SELECT 'symbol:' || path || '#f' || k AS id, 'f' || k AS name, 3 AS line, true AS exported FROM x_files UNION ALL SELECT 'symbol:' || path || '#Page' || k, 'Page' || k, 1, true FROM x_pages")(
    lambda t: _extracted(t).filter("label = 'Symbol' AND props['ownerId'] IS NULL").select("id", F.col("props")["name"].alias("name"), F.col("props")["startLine"].cast("int").alias("line"), F.col("props")["exported"].cast("boolean").alias("exported")))
_tree_query("x11_children", "SELECT 'HAS_PARAMETER' AS rel, 'symbol:' || path || '#f' || k AS src, 'a' AS name FROM x_files UNION ALL SELECT 'DECLARES_VARIABLE', 'symbol:' || path || '#f' || k, 'key' FROM x_files")(
    lambda t: _edges_of(t, "HAS_PARAMETER", "DECLARES_VARIABLE").join(_extracted(t).filter("label = 'Symbol'").select(F.col("id").alias("dst"), F.col("props")["name"].alias("name")), "dst").select("rel", "src", "name"))
_tree_query("x12_imported_symbols", "SELECT DISTINCT 'IMPORTS_SYMBOL' AS rel, 'file:' || a.path AS src, 'symbol:' || b.path || '#f' || b.k AS dst FROM x_files a JOIN x_files b ON b.nat = a.nat AND b.k = a.k + 1 UNION SELECT 'IMPORTS_SYMBOL', 'file:' || a.path, 'symbol:' || b.path || '#f' || b.k FROM x_tests a JOIN x_files b ON b.k = a.k")(lambda t: _edges_of(t, "IMPORTS_SYMBOL"))
_tree_query("x14_config_keys", "SELECT 'USES_CONFIG_KEY' AS rel, 'file:' || path AS src, 'config:KEY_' || (k % 5) AS dst FROM x_files")(lambda t: _edges_of(t, "USES_CONFIG_KEY"))
_tree_query("x15_tests", "SELECT 'TESTS_FILE' AS rel, 'test:' || path || '#case ' || k AS src, 'file:' || path AS dst FROM x_tests")(lambda t: _edges_of(t, "TESTS_FILE"))
_tree_query("x16_routes", "SELECT path, '/p' || k AS route FROM x_pages")(lambda t: _extracted(t).filter("label = 'Route'").select(F.col("props")["filePath"].alias("path"), F.col("props")["routePath"].alias("route")))
_tree_query("x17_validation_warning", "SELECT 'warning' AS type, count(*) > 0 AS some FROM x_tree")(lambda t: _extracted(t).filter("type = 'warning'").groupBy("type").agg((F.count(F.lit(1)) > 0).alias("some")))


# ---- what symbols do with each other, and names through several files --------------------------------------------

_USES = """
u_leaf AS (
  SELECT concat('lib/', lower(n_name), '/k', CAST(s_suppkey AS STRING), '.tsx') AS path, s_suppkey AS k, lower(n_name) AS nat,
         concat('export function f', CAST(s_suppkey AS STRING), '() {', chr(10), '  return 1;', chr(10), '}', chr(10), 'export class C', CAST(s_suppkey AS STRING), ' {', chr(10), '}', chr(10), 'export type T', CAST(s_suppkey AS STRING), ' = { id: number };', chr(10),
                'export default function P', CAST(s_suppkey AS STRING), '() {', chr(10), '  return null;', chr(10), '}', chr(10)) AS content FROM supplier JOIN nation ON s_nationkey = n_nationkey),
u_chain AS (
  SELECT concat('lib/', nat, '/r', CAST(k AS STRING), '_', CAST(i AS STRING), '.ts') AS path, k, nat, i,
         CASE WHEN i = 4 THEN concat('export { f', CAST(k AS STRING), ' as g4, C', CAST(k AS STRING), ' as D, default as Q } from "./k', CAST(k AS STRING), '";', chr(10), 'export * from "./k', CAST(k AS STRING), '";', chr(10))
              WHEN i % 2 = 1 THEN concat('export { g', CAST(i + 1 AS STRING), ' as g', CAST(i AS STRING), ', D, Q } from "./r', CAST(k AS STRING), '_', CAST(i + 1 AS STRING), '";', chr(10), 'export * from "./r', CAST(k AS STRING), '_', CAST(i + 1 AS STRING), '";', chr(10))
              ELSE concat('import { g', CAST(i + 1 AS STRING), ' as h } from "./r', CAST(k AS STRING), '_', CAST(i + 1 AS STRING), '";', chr(10), 'export { h as g', CAST(i AS STRING), ' };', chr(10), 'export * from "./r', CAST(k AS STRING), '_', CAST(i + 1 AS STRING), '";', chr(10)) END AS content
  FROM u_leaf CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4)),
u_use AS (
  SELECT concat('app/', nat, '/u', CAST(k AS STRING), '.tsx') AS path, k, nat,
         concat('import { g0, D as E, Q, T', CAST(k AS STRING), ' } from "../../lib/', nat, '/r', CAST(k AS STRING), '_0";', chr(10), 'export function use', CAST(k AS STRING), '(a: T', CAST(k AS STRING), ') {', chr(10), '  g0();', chr(10), '  const e = new E();', chr(10), '  return <Q e={e} />;', chr(10), '}', chr(10)) AS content FROM u_leaf),
u_tree AS (SELECT path, content FROM u_leaf UNION ALL SELECT path, content FROM u_chain UNION ALL SELECT path, content FROM u_use)"""


def _linked(t: Tables) -> DataFrame:
    """Events of a second tree: every supplier has a file of symbols, five files that pass them on, and one that uses them."""
    return _once(t, "linked", lambda path: _extract(t, f"WITH {_USES} SELECT path, content FROM u_tree", path))


def _linked_edges(t: Tables, *rels: str) -> DataFrame:
    return _linked(t).filter(F.col("type") == "edge").filter(F.col("rel").isin(*rels)).select("rel", F.col("from").alias("src"), F.col("to").alias("dst")).distinct()


#: Alias rows of the second tree: a file's name, the file and the name behind it.
_ALIASES = """
u_alias AS (
  SELECT path, 'g' || i AS name, i AS pos, k, nat, CASE WHEN i = 4 THEN 'f' || k ELSE 'g' || (i + 1) END AS next_name FROM u_chain
  UNION ALL SELECT path, 'D', i, k, nat, CASE WHEN i = 4 THEN 'C' || k ELSE 'D' END FROM u_chain
  UNION ALL SELECT path, 'Q', i, k, nat, CASE WHEN i = 4 THEN 'P' || k ELSE 'Q' END FROM u_chain
  UNION ALL SELECT path, 'T' || k, i, k, nat, 'T' || k FROM u_chain),
u_walk AS (
  SELECT path, name, pos, k, nat, next_name, pos + 1 AS here FROM u_alias
  UNION ALL SELECT w.path, w.name, w.pos, w.k, w.nat, a.next_name, w.here + 1 FROM u_walk w JOIN u_alias a ON a.k = w.k AND a.pos = w.here AND a.name = w.next_name WHERE w.here <= 4),
u_found AS (SELECT path, name, pos, k, 'symbol:lib/' || nat || '/k' || k || '.tsx#' || next_name AS target FROM u_walk WHERE here = 5)"""

query("x12_reexports", f"WITH RECURSIVE {_USES}, {_ALIASES} SELECT 'IMPORTS_SYMBOL' AS rel, 'file:' || u.path AS src, target AS dst FROM u_use u JOIN u_found f ON f.k = u.k AND f.pos = 0 WHERE f.name IN ('g0', 'D', 'Q') OR f.name LIKE 'T%' UNION SELECT 'IMPORTS_SYMBOL', 'file:' || c.path, target FROM u_chain c JOIN u_found f ON f.k = c.k AND f.pos = c.i + 1 AND f.name = 'g' || (c.i + 1) WHERE c.i % 2 = 0", fixture=False)(
    lambda t: _linked_edges(t, "IMPORTS_SYMBOL"))
query("x12_relations", f"""
WITH RECURSIVE {_USES}, {_ALIASES}
SELECT CASE f.name WHEN 'g0' THEN 'CALLS' WHEN 'D' THEN 'INSTANTIATES' WHEN 'Q' THEN 'RENDERS' ELSE 'USES_TYPE' END AS rel, 'symbol:' || u.path || '#use' || u.k AS src, target AS dst
FROM u_use u JOIN u_found f ON f.k = u.k AND f.pos = 0""", fixture=False)(lambda t: _linked_edges(t, "CALLS", "INSTANTIATES", "RENDERS", "USES_TYPE"))
query("x7_reexports", f"WITH {_USES} SELECT 'RE_EXPORTS_FILE' AS rel, 'file:' || c.path AS src, CASE WHEN i = 4 THEN 'file:lib/' || nat || '/k' || k || '.tsx' ELSE 'file:lib/' || nat || '/r' || k || '_' || (i + 1) || '.ts' END AS dst FROM u_chain c", fixture=False)(lambda t: _linked_edges(t, "RE_EXPORTS_FILE"))


@query("r9_update", f"""
WITH {_TREE},
y AS (SELECT path, k, nat, CASE WHEN k % 7 = 0 THEN 'g' ELSE 'f' END || k AS name FROM x_files WHERE k % 11 <> 0)
SELECT 'DEFINES' AS rel, 'file:' || path AS src, 'symbol:' || path || '#' || name AS dst FROM y
UNION ALL SELECT DISTINCT 'IMPORTS_SYMBOL', 'file:' || a.path, 'symbol:' || b.path || '#' || b.name FROM y a JOIN y b ON b.nat = a.nat AND b.k = a.k + 1 WHERE b.k % 7 <> 0""", fixture=False)
def updated(t: Tables) -> DataFrame:
    """A tree is extracted; then some files change and some are deleted, and only the changed ones are scanned."""
    for name in ("supplier", "nation"):
        t.raw(name).createOrReplaceTempView(name)
    tree = t.spark.sql(f"WITH {_TREE} SELECT path, content, k FROM x_files")
    listed = lambda df: df.select("path", F.length("content").cast("long").alias("size"), F.to_timestamp(F.lit("2024-01-01")).alias("modified"))
    later = tree.filter("k % 11 <> 0").withColumn("content", F.when(F.col("k") % 7 == 0, F.regexp_replace("content", r"function f(\d+)", r"function  g$1")).otherwise(F.col("content")))
    with Kept() as keep:
        first = I.refresh(listed(tree), lambda paths, n: tree.select("path", "content").join(paths, "path", "left_semi"), None, None, False, False, keep)
        files, facts = keep(first.files), keep(first.facts)
        now = I.refresh(listed(later), lambda paths, n: later.select("path", "content").join(paths, "path", "left_semi"), files, facts, False, False, keep)
        events = X.link(later.select("path"), keep(now.facts), False, keep)
        path = fresh_folder(t.spark, "updated")
        events.filter("rel IN ('DEFINES', 'IMPORTS_SYMBOL')").select("rel", F.col("from").alias("src"), F.col("to").alias("dst")).distinct().write.parquet(path)
    return t.spark.read.parquet(path)
