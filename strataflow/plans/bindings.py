"""Views that present the driver's tables in the shape of the source-corpus tables.

Each text runs unchanged in Spark SQL and DuckDB. ``bind`` gives a view as a DataFrame; ``with_views``
puts the same texts in front of an oracle query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Views that another view reads.
NEEDS = {"runs": ("cases",)}

VIEWS = {
    "files": r"""
SELECT doc_id AS file_id, source AS repository_id,
  concat(CASE WHEN doc_id % 11 = 0 THEN 'node_modules/' WHEN doc_id % 7 = 0 THEN 'tests/'
              WHEN doc_id % 5 = 0 THEN 'api/' WHEN doc_id % 5 = 1 THEN 'db/' ELSE 'core/' END,
         lang, '/', CASE WHEN doc_id % 13 = 0 THEN 'main' ELSE concat('f', CAST(doc_id AS STRING)) END,
         CASE doc_id % 8 WHEN 0 THEN '.java' WHEN 1 THEN '.JAVA' WHEN 2 THEN '.js' WHEN 3 THEN '.go'
                         WHEN 4 THEN '.xyz' ELSE '.py' END) AS path,
  text, n_chars FROM documents
""",
    "ent": r"""
SELECT concat('c', CAST(c_custkey AS STRING)) AS entity_id, concat('r', CAST(n_regionkey AS STRING)) AS repository_id,
  concat('nation_', CAST(c_nationkey AS STRING)) AS module, c_name AS name,
  CASE WHEN c_custkey % 4 = 0 THEN 'method' ELSE 'function' END AS type,
  1 + CAST(floor(abs(c_acctbal)) AS BIGINT) % 15 AS complexity
FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL
SELECT concat('s', CAST(s_suppkey AS STRING)), concat('r', CAST(n_regionkey AS STRING)),
  concat('nation_', CAST(s_nationkey AS STRING)), s_name,
  CASE WHEN s_suppkey % 5 = 0 THEN 'class' ELSE 'function' END,
  1 + CAST(floor(abs(s_acctbal)) AS BIGINT) % 15
FROM supplier JOIN nation ON s_nationkey = n_nationkey
""",
    "calls": r"""
SELECT concat('r', CAST(cn.n_regionkey AS STRING)) AS repository_id,
  concat('c', CAST(o_custkey AS STRING)) AS caller_id,
  CASE WHEN l_linenumber % 3 = 1 AND cn.n_regionkey = sn.n_regionkey
       THEN concat('s', CAST(l_suppkey AS STRING)) END AS callee_id,
  CASE WHEN l_linenumber % 3 = 0 THEN concat('nation_', CAST(s_nationkey AS STRING), '.', s_name)
       WHEN l_linenumber % 3 = 1 THEN s_name ELSE concat('alias.', s_name) END AS callee_name,
  l_linenumber AS call_line, l_returnflag = 'R' AS dynamic
FROM orders JOIN lineitem ON o_orderkey = l_orderkey
JOIN customer ON c_custkey = o_custkey JOIN nation cn ON cn.n_nationkey = c_nationkey
JOIN supplier ON s_suppkey = l_suppkey JOIN nation sn ON sn.n_nationkey = s_nationkey
""",
    "modedge": r"""
SELECT src, dst FROM (
  SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS rk FROM (
    SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS n
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
    JOIN supplier ON s_suppkey = l_suppkey WHERE c_nationkey <> s_nationkey GROUP BY c_nationkey, s_nationkey) g) r
WHERE rk <= 2
""",
    "cases": r"""
SELECT concat('u', CAST(user_id AS STRING)) AS repository_id,
  concat('u', CAST(user_id AS STRING), '-', CAST(CAST(ts AS DATE) AS STRING)) AS run_id,
  concat('test_', event_type, '_main_branch') AS name,
  CASE WHEN event_type = 'error' THEN 'failed' ELSE 'passed' END AS status,
  CAST(floor(value * 10) AS BIGINT) AS duration_ms, event_id, ts FROM events
""",
    "runs": r"""
SELECT repository_id, run_id, count(*) AS tests_generated,
  sum(CASE WHEN status = 'passed' THEN 1 ELSE 0 END) AS tests_passed,
  sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) AS tests_failed,
  100.0 * sum(CASE WHEN status = 'passed' THEN 1 ELSE 0 END) / count(*) AS line_coverage,
  max(ts) AS created_at FROM cases GROUP BY repository_id, run_id
""",
    "stages": r"""
SELECT user_id AS analysis_id, event_id, ts,
  CASE event_id % 6 WHEN 0 THEN 'uploaded' WHEN 1 THEN 'scanned' WHEN 2 THEN 'parsing'
                    WHEN 3 THEN 'aggregating' WHEN 4 THEN 'graph' ELSE 'index' END AS stage,
  CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'view' THEN 'running' ELSE 'done' END AS state
FROM events
""",
    "chunks": r"""
SELECT vec_id AS chunk_id, concat('r', CAST(label % 3 AS STRING)) AS repository_id,
  CASE label % 3 WHEN 0 THEN 'module' WHEN 1 THEN 'class' ELSE 'function' END AS level, embedding FROM embeddings
""",
    "prompts": r"""
SELECT u.conv_id, u.turn, coalesce(s.system, 'default') AS system, u.text AS prompt
FROM conversations u LEFT JOIN (SELECT conv_id, min(text) AS system FROM conversations WHERE role = 'system' GROUP BY conv_id) s
ON s.conv_id = u.conv_id WHERE u.role = 'user'
""",
    "claims": r"""
SELECT d.doc_id AS file_id, b.item_id, b.text AS expected, d.text AS response,
  d.doc_id % 9 - 1 AS line_start, d.doc_id % 9 + d.doc_id % 4 - 2 AS line_end
FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % 40
""",
    "links": r"""
SELECT page_id, url, html FROM pages
""",
    "versions": r"""
SELECT p_partkey AS proposal_id, concat('c', CAST(p_partkey % (SELECT count(*) FROM customer) AS STRING)) AS entity_id,
  concat('u', CAST(p_partkey % 150 AS STRING)) AS run_repository_id, p_size % 4 AS behavioral_diffs,
  CASE p_size % 3 WHEN 0 THEN 'self,amount' WHEN 1 THEN 'self,amount,rate' ELSE 'amount,rate,region' END AS old_params,
  CASE WHEN p_partkey % 4 = 0 THEN 'amount' WHEN p_partkey % 4 = 1 THEN 'self,amount,fee'
       WHEN p_size % 3 = 0 THEN 'self,amount' WHEN p_size % 3 = 1 THEN 'self,amount,rate' ELSE 'amount,rate,region' END AS new_params
FROM part
""",
    # ten parts make one file number: five repositories have a Python and a Java file of that number each
    "code": r"""
SELECT file_id, repository_id, language, concat('mod_', n, CASE language WHEN 'python' THEN '.py' ELSE '.java' END) AS path,
  CASE language WHEN 'python' THEN concat_ws(chr(10), concat(repeat(chr(34), 3), 'Module ', n, '.', repeat(chr(34), 3)), 'import os', concat('from mod_', k, ' import compute_', k, ' as helper'), 'CACHE = {}', concat('class P', n, '(P', b, '):'),
    '    def run(self, amount, rate=1):', concat('        ', repeat(chr(39), 3), 'Run it(1).', repeat(chr(39), 3)), '        if amount < 0 and rate > 0:', '            raise ValueError(amount)', '        total = amount * rate',
    '        CACHE[amount] = total', '        helper(total)', '        return total', concat('def compute_', n, '(a, b):'), '    obj[a](b)', '    return _scale(a // 2) + obj.find(b).go()', 'def _scale(x):', '    return x')
  ELSE concat_ws(chr(10), 'import java.util.List;', 'import static java.lang.Math.abs;', '/**', ' * Handles charges.', ' * @param amount the amount', ' */', concat('public class J', n, ' extends J', b, ' implements Runnable {'),
    '    private int count;', '    public int charge(int amount, int rate) {', '        if (amount < 0 || rate > 9) { throw new IllegalArgumentException(); }', '        for (int i = 0; i < rate; i++) { count += abs(i); } List<?> l = List.of(rate);',
    concat('        return scale(new J', n, '().go(amount));'), '    }', '    private int scale(int x) {', '        return x > 1 ? x : 1;', '    }', '}') END AS text
FROM (SELECT p_partkey AS file_id, concat('r', CAST(p_partkey % 5 AS STRING)) AS repository_id, CASE WHEN p_partkey % 2 = 0 THEN 'python' ELSE 'java' END AS language,
  CAST(CAST(floor(p_partkey / 10) AS BIGINT) AS STRING) AS n, CAST(CAST(floor(p_partkey / 10) AS BIGINT) % 10 AS STRING) AS b,
  CAST((CAST(floor(p_partkey / 10) AS BIGINT) * 8 + 4) % (SELECT CAST(floor(count(*) / 10) AS BIGINT) FROM part) AS STRING) AS k FROM part) f
""",
}


def _tables(text: str) -> list[str]:
    words = set(text.replace("(", " ").replace(")", " ").replace(",", " ").split())
    return [t for t in TABLES if t in words]


def with_views(names: str, body: str) -> str:
    """``body`` behind the views of the space-separated ``names`` as common table expressions."""
    order: list[str] = []
    for name in names.split():
        for n in (*NEEDS.get(name, ()), name):
            if n not in order:
                order.append(n)
    views = ", ".join(f"{n} AS ({VIEWS[n].strip()})" for n in order)
    return f"WITH {views} {body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bind(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view ``name`` over the Parquet tables of ``sf_dir``."""
    text = with_views(name, f"SELECT * FROM {name}")
    for t in _tables(text):
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(text)
