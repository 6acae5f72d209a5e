"""A property graph and a code corpus derived from the star-schema tables by SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.sources.shared import fresh_folder, there

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
#: Common table expressions g_files, g_nodes, g_edges and c_lines, without the leading WITH.
VIEWS = """g_files AS (
  SELECT 'customer' AS origin, CAST(c_custkey AS BIGINT) AS k, concat('package:@acme/', lower(n_name)) AS package_id,
         concat(CASE n_nationkey % 3 WHEN 0 THEN 'apps/' WHEN 1 THEN 'packages/' ELSE 'scripts/' END, lower(n_name), '/src/c', CAST(c_custkey AS STRING),
                CASE c_custkey % 10 WHEN 0 THEN '.test.ts' WHEN 1 THEN '.md' WHEN 2 THEN '.json' WHEN 3 THEN '.tsx' ELSE '.ts' END) AS path
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL
  SELECT 'supplier', CAST(s_suppkey AS BIGINT), concat('package:@acme/', lower(n_name)),
         concat('packages/', lower(n_name), '/lib/s', CAST(s_suppkey AS STRING), '.ts')
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
g_nodes AS (
  SELECT concat('project:', lower(r_name)) AS id, 'Project' AS label, lower(r_name) AS name, CAST(NULL AS STRING) AS path, CAST(NULL AS STRING) AS kind,
         CAST(NULL AS STRING) AS package_id, CAST(NULL AS BIGINT) AS start_line, CAST(NULL AS BOOLEAN) AS exported FROM region
  UNION ALL SELECT concat('package:@acme/', lower(n_name)), 'Package', concat('@acme/', lower(n_name)), NULL, 'package', NULL, NULL, NULL FROM nation
  UNION ALL SELECT concat('file:', path), 'File', NULL, path, 'source', package_id, NULL, NULL FROM g_files
  UNION ALL SELECT concat('symbol:', path, '#order_', CAST(o_orderkey AS STRING)), 'Symbol', concat('order_', CAST(o_orderkey AS STRING)), path, 'function',
         package_id, CAST(o_orderkey % 500 AS BIGINT), o_orderstatus = 'F' FROM orders JOIN g_files ON origin = 'customer' AND k = o_custkey
  UNION ALL SELECT concat('symbol:lib/', lower(p_brand), '.ts#', replace(p_name, ' ', '_'), CASE WHEN p_size > 40 THEN '::var:' ELSE ':' END, CAST(p_partkey AS STRING)), 'Symbol',
         concat(replace(p_name, ' ', '_'), CASE WHEN p_size > 40 THEN '::var' ELSE '' END), concat('lib/', lower(p_brand), '.ts'), lower(p_type), concat('package:', lower(p_brand)),
         CAST(p_size AS BIGINT), p_size % 2 = 0 FROM part),
g_part AS (SELECT p_partkey, p_name, concat('symbol:lib/', lower(p_brand), '.ts#', replace(p_name, ' ', '_'), CASE WHEN p_size > 40 THEN '::var:' ELSE ':' END, CAST(p_partkey AS STRING)) AS pid FROM part),
g_order AS (SELECT o_orderkey, o_custkey, path, concat('file:', path) AS fid, concat('symbol:', path, '#order_', CAST(o_orderkey AS STRING)) AS oid
  FROM orders JOIN g_files ON origin = 'customer' AND k = o_custkey),
g_edges AS (
  SELECT 'CONTAINS_PACKAGE' AS type, concat('project:', lower(r_name)) AS src, concat('package:@acme/', lower(n_name)) AS dst, CAST(NULL AS STRING) AS source_file,
         CAST(1 AS BIGINT) AS start_line, CAST(1.0 AS DOUBLE) AS confidence FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'CONTAINS_FILE', package_id, concat('file:', path), path, 1, 1.0 FROM g_files
  UNION ALL SELECT 'DEFINES', fid, oid, path, CAST(o_orderkey % 500 AS BIGINT), 1.0 FROM g_order
  UNION ALL SELECT CASE l_returnflag WHEN 'R' THEN 'RENDERS' WHEN 'A' THEN 'INSTANTIATES' ELSE 'CALLS' END, oid, pid, path, CAST(l_suppkey AS BIGINT),
         CASE WHEN l_linenumber = 1 THEN NULL ELSE CAST(100 - 5 * CAST(round(l_discount * 100) AS INT) AS DOUBLE) / 100 END
         FROM lineitem JOIN g_order ON l_orderkey = o_orderkey JOIN g_part ON l_partkey = p_partkey
  UNION ALL SELECT DISTINCT 'IMPORTS_SYMBOL', concat('file:', path), pid, path, 1, 1.0 FROM lineitem JOIN g_files ON origin = 'supplier' AND k = l_suppkey JOIN g_part ON l_partkey = p_partkey WHERE l_quantity > 40
  UNION ALL SELECT DISTINCT 'IMPORTS_FILE', o.fid, concat('file:', f.path), o.path, 1, 0.85 FROM lineitem JOIN g_order o ON l_orderkey = o.o_orderkey JOIN g_files f ON f.origin = 'supplier' AND f.k = l_suppkey WHERE l_quantity > 48
  UNION ALL SELECT 'RE_EXPORTS_FILE', concat('file:', s.path), concat('file:', c.path), s.path, 2, 0.4 FROM g_files s JOIN g_files c ON s.origin = 'supplier' AND c.origin = 'customer' AND c.k % 100 = s.k AND c.k < 200),
c_raw AS (
  SELECT path, o_orderkey AS ok, 0 AS seq, CAST(0 AS BIGINT) AS k1, CAST(0 AS BIGINT) AS k2, concat(CASE WHEN o_orderkey % 4 = 0 THEN 'const ' ELSE 'export function ' END, 'order_', CAST(o_orderkey AS STRING),
         CASE WHEN o_orderkey % 4 = 0 THEN ' = () => {' ELSE '() {' END) AS text FROM g_order
  UNION ALL SELECT path, o_orderkey, 1, l_partkey, l_suppkey, CASE
         WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN concat('  const v = process.env.KEY_', CAST(l_suppkey % 20 AS STRING), ';')
         WHEN l_partkey % 11 = 0 THEN concat('  // ', replace(p_name, ' ', '_'), '()')
         WHEN l_partkey % 11 = 1 THEN concat('  <', replace(p_name, ' ', '_'), ' />')
         WHEN l_partkey % 11 = 2 THEN concat('  api.', replace(p_name, ' ', '_'), '(1)')
         WHEN l_partkey % 11 = 3 THEN concat('  if (x) { ', replace(p_name, ' ', '_'), '(); }')
         WHEN l_partkey % 11 < 6 THEN '  assertAllowed();'
         ELSE concat('  ', replace(p_name, ' ', '_'), '(', CAST(l_linenumber AS STRING), ');') END
         FROM lineitem JOIN g_order ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  UNION ALL SELECT path, o_orderkey, 2, 0, 0, '}' FROM g_order),
c_lines AS (SELECT path, row_number() OVER (PARTITION BY path ORDER BY ok, seq, k1, k2, text) AS line_no, text FROM c_raw)"""

_USES = "type IN ('CALLS', 'RENDERS', 'INSTANTIATES')"
#: Conditions that each row of a view meets one of. They are known below the joins (a type belongs to one part of the union, a
#: line to one supplier), so what is shuffled for one of them is a part of what all take, and it is deleted before the next.
PARTS = {"g_edges": [*(f"{_USES} AND coalesce(pmod(start_line, 2), 0) = {k}" for k in range(2)), "type = 'IMPORTS_SYMBOL'", "type = 'IMPORTS_FILE'", f"NOT ({_USES}) AND type NOT IN ('IMPORTS_SYMBOL', 'IMPORTS_FILE')"]}
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_STORED: dict[tuple[str, str, str], str] = {}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the derived views, written once a session: it stands for a stored table. As compressed columns it takes a
    fraction of the disk that blocks of a cache take which don't fit the memory."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED or not there(spark, _STORED[key]):
        for t in TABLES:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        path = fresh_folder(spark, name)
        before = spark.conf.get(CLEANUP, None)
        spark.conf.set(CLEANUP, "true")  # shuffle files go when a part is written, not when the driver's memory is full
        try:
            for part in PARTS.get(name, ["true"]):
                spark.sql(f"WITH {VIEWS} SELECT * FROM {name} WHERE {part}").write.mode("append").option("compression", "zstd").parquet(path)
        finally:
            spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])
