"""The code model (files, symbols, references, commits, agent events) derived from the relational test tables.

The derivations are plain SQL that Spark and other engines read alike, so a query and its SQL start from the same relations.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codequarry.shared import dealt

RELATIONS = {
    "files": """
SELECT p_partkey AS file_id,
  CASE p_partkey % 9 WHEN 0 THEN 'src/core' WHEN 1 THEN 'src/api' WHEN 2 THEN 'app/ui' WHEN 3 THEN 'crates/engine/src' WHEN 4 THEN 'lib'
    WHEN 5 THEN 'tests' WHEN 6 THEN 'web/pages' WHEN 7 THEN 'packages/web/test' ELSE 'docs' END
  || CASE WHEN p_size % 4 = 0 THEN '/sub' || CAST(p_size % 7 AS STRING) ELSE '' END || '/' || replace(p_name, ' ', '_') || CAST(p_partkey AS STRING)
  || CASE WHEN p_partkey % 11 = 0 THEN '.test' WHEN p_partkey % 13 = 0 THEN 'Test' ELSE '' END
  || CASE p_size % 6 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' WHEN 2 THEN '.js' WHEN 3 THEN '.java' WHEN 4 THEN '.c' ELSE '.cpp' END AS path,
  CASE p_size % 6 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'javascript' WHEN 3 THEN 'java' WHEN 4 THEN 'c' ELSE 'cpp' END AS lang,
  md5(p_name) AS hash, CAST(floor(p_retailprice) AS BIGINT) * 100 AS mtime, CAST(p_size AS BIGINT) * 100 AS size
FROM {part}""",
    "symbols": """
SELECT o_orderkey AS symbol_id, pk AS file_id,
  CASE o_orderkey % 4 WHEN 0 THEN 'load' || CAST(o_custkey AS STRING) WHEN 1 THEN 'only' || CAST(o_orderkey AS STRING) WHEN 2 THEN 'parseItem' || CAST(o_custkey % 50 AS STRING) ELSE 'get' END AS name,
  CASE o_orderkey % 3 WHEN 0 THEN 'function' WHEN 1 THEN 'method' ELSE 'class' END AS kind,
  CAST(1 + (o_orderkey % 37) * 10 AS INT) AS start_line, CAST(1 + (o_orderkey % 37) * 10 + (o_orderkey % 5) * 12 AS INT) AS end_line,
  (1 + (o_orderkey % 37) * 10) * 40 AS start_byte, (1 + (o_orderkey % 37) * 10 + (o_orderkey % 5) * 12) * 40 + 39 AS end_byte,
  CASE WHEN o_orderkey % 10 = 0 THEN '@app.get(1) ' WHEN o_orderkey % 10 = 5 THEN '@override ' ELSE '' END || 'def run(a, b)' AS signature
FROM {orders} JOIN (SELECT l_orderkey, min(l_partkey) AS pk FROM {lineitem} GROUP BY l_orderkey) AS l ON l_orderkey = o_orderkey""",
    "refs": """
SELECT l_orderkey AS enclosing_symbol_id, pk AS file_id,
  CASE WHEN l_partkey % 3 = 0 THEN 'only' || CAST(l_orderkey - l_orderkey % 4 + 1 AS STRING) WHEN l_partkey % 50 = 1 THEN 'get' ELSE 'load' || CAST(l_suppkey * 15 + l_linenumber AS STRING) END AS name,
  'call' AS kind, CAST(1 + (l_orderkey % 37) * 10 + l_linenumber AS INT) AS line
FROM {lineitem} AS r JOIN (SELECT l_orderkey AS k, min(l_partkey) AS pk FROM {lineitem} GROUP BY l_orderkey) AS l ON r.l_orderkey = l.k""",
    "texts": """
SELECT f.file_id, CASE WHEN f.file_id % 17 = 0 THEN NULL ELSE 'Box' || CAST(f.file_id % 4 AS STRING) || ' x' || chr(10) || coalesce(CASE f.lang WHEN 'java' THEN javas WHEN 'python' THEN 'from lib import ' || names ELSE 'import ' || names || ' from "./lib";' END, '') END AS text
FROM ({files}) AS f LEFT JOIN (SELECT file_id, string_agg('import static lib.' || name || ';', chr(10)) AS javas, string_agg(name, ', ') AS names FROM (SELECT DISTINCT file_id, name FROM ({refs}) AS r WHERE line % 4 = 0) AS d GROUP BY file_id) AS i ON i.file_id = f.file_id""",
    "copied": """
SELECT file_id, 'app' || CAST(k AS STRING) || '/' || path AS path, CASE WHEN k = 1 AND file_id % 4 = 0 OR k = 2 AND file_id % 10 <> 0 THEN hash || CAST(k AS STRING) ELSE hash END AS hash, mtime + CASE k WHEN 1 THEN 200000 WHEN 2 THEN 300000 WHEN 3 THEN 400 ELSE 0 END AS mtime, k
FROM ({files}) AS f, (SELECT 0 AS k UNION ALL SELECT 1 AS k UNION ALL SELECT 2 AS k UNION ALL SELECT 3 AS k) AS ks WHERE k <> 3 OR file_id % 3 = 0""",
    "commits": "SELECT o_orderkey AS hash, unix_seconds(CAST(o_orderdate AS TIMESTAMP)) + o_orderkey % 86400 AS ct FROM {orders}",
    "commit_files": "SELECT l_orderkey AS hash, l_partkey AS file_id FROM {lineitem}",
    "versions": """
SELECT l_partkey AS file_id, l_orderkey AS hash, unix_seconds(CAST(o_orderdate AS TIMESTAMP)) + o_orderkey % 86400 AS ct,
  CASE WHEN l_orderkey % 23 = 0 THEN NULL ELSE 'def f' || CAST(s % 4 AS STRING) || '_' || CAST(l_partkey AS STRING) || CASE WHEN n % 2 = 0 THEN '(a, b):' ELSE '(a):' END || chr(10) || '    g' || CAST(n % 3 AS STRING) || '(1)' || chr(10)
    || 'def g' || CAST((s + n) % 3 AS STRING) || '():' || chr(10) || '    return f' || CAST((s + l_orderkey) % 4 AS STRING) || '_' || CAST(l_partkey + 1 AS STRING) || '(' || CAST(n % 2 AS STRING) || ')' || chr(10) END AS text
FROM (SELECT l_orderkey, l_partkey, min(l_suppkey) AS s, min(l_linenumber) AS n FROM {lineitem} GROUP BY l_orderkey, l_partkey) AS l JOIN {orders} ON o_orderkey = l_orderkey""",
    "findings": """
SELECT CAST(hash AS BIGINT) * 10000000 + file_id AS finding_id, hash % 50 AS session, hash % 3 AS period, CASE WHEN was <> becomes THEN 'dangling' ELSE 'stale' END AS kind, was AS symbol,
  CASE WHEN was <> becomes AND hash % 3 = 0 THEN becomes END AS renamed_to, file_id AS changed_file, CASE WHEN hash % 17 = 0 THEN NULL WHEN hash % 11 = 0 THEN md5(before) ELSE md5(text) END AS after,
  file_id - 1 AS ref_file, CASE WHEN hash % 5 <> 0 THEN 'g' || CAST(hash % 3 AS STRING) END AS caller, ct - hash % 30 * 86400 AS first_edit, ct - hash % 20 * 86400 AS last_edit
FROM (SELECT *, regexp_extract(before, 'def (f[0-9_]+)', 1) AS was, regexp_extract(text, 'def (f[0-9_]+)', 1) AS becomes, regexp_extract(before, 'def f[0-9_]+([^:]*)', 1) AS old_head, regexp_extract(text, 'def f[0-9_]+([^:]*)', 1) AS new_head
  FROM (SELECT *, lag(text) OVER (PARTITION BY file_id ORDER BY ct, hash) AS before FROM ({versions}) AS v) AS b WHERE before IS NOT NULL AND text IS NOT NULL) AS c
WHERE was <> becomes OR old_head <> new_head""",
    "heads": """
SELECT id, lang, CASE WHEN lang = 'java' THEN 'method' ELSE 'function' END AS kind, side, file_id, name, CASE lang WHEN 'python' THEN 'def ' WHEN 'java' THEN 'public ' || ret || ' ' WHEN 'typescript' THEN 'export function ' ELSE 'fun ' END || name || '('
  || CASE WHEN lang = 'java' THEN kind1 || ' ' || name1 ELSE name1 || ': ' || kind1 END || CASE WHEN more % 2 <> 0 OR side = 1 AND edit = 3 THEN '' WHEN lang = 'java' THEN ', String b' WHEN more % 3 = 0 THEN ', b: String = 1' ELSE ', b: String' END
  || CASE WHEN side = 0 OR edit NOT IN (1, 2) THEN '' WHEN lang = 'java' THEN CASE WHEN edit = 1 THEN ', int... c' ELSE ', int c' END WHEN edit = 2 THEN ', c: Byte' WHEN lang = 'typescript' THEN ', c?: Byte' ELSE ', c: Byte = 2' END || ')'
  || CASE lang WHEN 'python' THEN ' -> ' || ret || ':' || chr(10) || '    return ' WHEN 'java' THEN ' ' || chr(123) || ' return ' ELSE ': ' || ret || ' ' || chr(123) || ' return ' END || CAST(id % 10 + CASE WHEN side = 1 AND id % 3 = 0 THEN 1 ELSE 0 END AS STRING) || CASE WHEN lang = 'python' THEN chr(10) ELSE '; ' || chr(125) END AS text
FROM (SELECT *, CASE WHEN side = 1 AND edit = 5 THEN 'z' ELSE 'a' END AS name1, CASE WHEN side = 1 AND edit = 6 THEN 'long' WHEN lang = 'java' AND side = 1 AND edit = 0 THEN 'Integer' ELSE 'int' END AS ret,
    CASE WHEN side = 1 AND edit = 4 THEN CASE lang WHEN 'java' THEN CASE first WHEN 0 THEN 'Integer' ELSE 'Object' END WHEN 'typescript' THEN CASE first WHEN 0 THEN 'number | null' WHEN 1 THEN 'boolean' ELSE 'null | Map<string, number>' END WHEN 'kotlin' THEN CASE first WHEN 0 THEN 'Int?' WHEN 1 THEN 'Any' ELSE 'Map<String, Int>?' END ELSE 'Any' END
      ELSE CASE lang WHEN 'java' THEN CASE first WHEN 0 THEN 'int' WHEN 1 THEN 'String' ELSE 'Map<String, int>' END WHEN 'typescript' THEN CASE first WHEN 0 THEN 'number' WHEN 1 THEN 'string' ELSE 'Map<string, number>' END ELSE CASE first WHEN 0 THEN 'Int' WHEN 1 THEN 'String' ELSE 'Map<String, Int>' END END END AS kind1
  FROM (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'java' WHEN 2 THEN 'typescript' ELSE 'kotlin' END AS lang, side, CAST(floor(o_orderkey / 40) AS BIGINT) AS file_id, CASE WHEN side = 1 AND o_orderkey % 5 = 0 THEN 'made' ELSE 'load' END || CAST(o_orderkey AS STRING) AS name,
      o_custkey % 3 AS first, o_orderkey % 7 AS edit, o_orderkey % 11 AS more FROM {orders}, (SELECT 0 AS side UNION ALL SELECT 1 AS side) AS sides) AS o) AS t""",
    "patch_texts": """
SELECT '*** Begin Patch' || chr(10) || CASE l_linenumber % 4
    WHEN 0 THEN '*** Add File: src/f' || CAST(l_partkey AS STRING) || '.py' || chr(10) || '+def a():' || chr(10) || '+    return ' || CAST(l_suppkey AS STRING) || chr(10)
    WHEN 1 THEN '*** Update File: src/f' || CAST(l_partkey AS STRING) || '.py' || chr(10) || CASE WHEN l_suppkey % 2 = 0 THEN '@@ def a' || chr(10) ELSE '' END || ' def a():' || chr(10) || '-    return 1' || chr(10) || '+    return ' || CAST(l_suppkey AS STRING) || chr(10) || '@@' || chr(10) || '+tail' || chr(10)
    WHEN 2 THEN '*** Delete File:  src/f' || CAST(l_partkey AS STRING) || '.py' || chr(10) ELSE '*** Update File: src/f' || CAST(l_partkey AS STRING) || '.py' || chr(10) || '*** Move to: lib/f' || CAST(l_suppkey AS STRING) || '.py' || chr(10) END
  || CASE WHEN l_partkey % 3 = 0 THEN '*** Delete File: old' || CAST(l_suppkey AS STRING) || chr(10) ELSE '' END || '*** End Patch' || chr(10) AS text
FROM {lineitem}""",
    "log_lines": """
SELECT 's' || CAST(user_id AS STRING) AS session, 'rollout-s' || CAST(user_id AS STRING) || '.jsonl' AS file, true AS main, event_id AS line_no, translate(CASE event_type
    WHEN 'click' THEN '<"type":"event_msg","timestamp":"2026-01-01T00:00:' || lpad(CAST(event_id % 60 AS STRING), 2, '0') || '.5Z","payload":<"type":"item_completed","item":<"type":"FileChange","id":"c' || CAST(event_id AS STRING) || '","status":"' || CASE WHEN event_id % 5 = 0 THEN 'failed' ELSE 'completed' END
      || '","changes":<"src/../f' || CAST(event_id % 40 AS STRING) || '.py":' || CASE event_id % 3 WHEN 0 THEN '<"type":"add","content":"x' || CAST(event_id AS STRING) || '">' WHEN 1 THEN '<"type":"delete">' ELSE '<"type":"update","unified_diff":"@@ -' || CAST(event_id % 9 AS STRING) || ',0 +1 @@' || chr(92) || 'n+a' || chr(92) || 'n@@ -20 +21 @@' || chr(92) || 'n-b' || chr(92) || 'n">' END || '>>>>'
    WHEN 'view' THEN '<"type":"event_msg","payload":<"type":"token_count","info":<"total_token_usage":<"input_tokens":' || CAST(event_id % 1000 * 3 AS STRING) || ',"cached_input_tokens":' || CAST(event_id % 1000 AS STRING) || ',"output_tokens":' || CAST(event_id % 777 AS STRING) || '>>>>'
    WHEN 'purchase' THEN '<"type":"response_item","payload":<"type":"function_call","name":"shell","call_id":"k' || CAST(event_id AS STRING) || '","arguments":"<' || chr(92) || '"command' || chr(92) || '":[' || chr(92) || '"' || CASE WHEN event_id % 2 = 0 THEN 'pytest' ELSE 'ls' END || chr(92) || '",' || chr(92) || '"-q' || chr(92) || '"]>">>'
    ELSE CASE WHEN event_id % 2 = 0 THEN '<"type":"turn_context","payload":<"cwd":"/work/r' || CAST(event_id % 3 AS STRING) || '","model":"m-' || CAST(event_id % 4 AS STRING) || '">>' ELSE '<"type":"brand-new">' END END, '<>', chr(123) || chr(125)) AS line
FROM {events}""",
    "agent_events": """
SELECT user_id AS session, event_id AS seq, unix_seconds(CAST(ts AS TIMESTAMP)) AS ts,
  CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'edit' WHEN 'purchase' THEN 'shell' ELSE 'search' END AS op,
  event_id % 40 AS file_id, event_id % 7 <> 0 AS ok, event_type = 'purchase' AND event_id % 2 = 0 AS test_run, CAST(floor(value * 100) AS BIGINT) AS tokens
FROM {events}""",
}
TABLES = ("part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "customer", "supplier")


RELATIONS["copied"] = RELATIONS["copied"].replace("{files}", RELATIONS["files"])
RELATIONS["texts"] = RELATIONS["texts"].replace("{files}", RELATIONS["files"]).replace("{refs}", RELATIONS["refs"])
FINDINGS = RELATIONS["findings"]
#: What refs are made from; the same rows as a window need no join of the lines with themselves.
LINES = "{lineitem} AS r JOIN (SELECT l_orderkey AS k, min(l_partkey) AS pk FROM {lineitem} GROUP BY l_orderkey) AS l ON r.l_orderkey = l.k"
RELATIONS["findings"] = FINDINGS.replace("{versions}", RELATIONS["versions"])


def duck(sql: str, *relations: str) -> str:
    """sql for DuckDB with the named relations in front of it."""
    told = []
    for r in relations or RELATIONS:
        text = RELATIONS[r].format(**{t: t for t in TABLES}).replace("unix_seconds(CAST(o_orderdate AS TIMESTAMP))", "CAST(epoch(o_orderdate) AS BIGINT)")
        told.append(f"{r} AS ({text.replace('unix_seconds(CAST(ts AS TIMESTAMP))', 'CAST(floor(epoch(ts)) AS BIGINT)')})")
    return f"WITH {', '.join(told)} {sql}"


class Model:
    """The relations as DataFrames, each built when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _relation(self, name: str) -> DataFrame:
        sql = RELATIONS[name]
        used = {t: self.table(t) for t in TABLES if f"{{{t}}}" in sql}
        return self.spark.sql(sql, **used)

    def _lines(self) -> DataFrame:
        """The lines of orders with pk, the least part of their order; they lie by order."""
        lines = self.table("lineitem").where("l_orderkey is not null")
        by_order = dealt(lines, lines.count(), "l_orderkey")
        return by_order.withColumn("pk", F.min("l_partkey").over(Window.partitionBy("l_orderkey")))

    files = cached_property(lambda self: self._relation("files"))
    symbols = cached_property(lambda self: self._relation("symbols"))
    refs = cached_property(lambda self: self.spark.sql(RELATIONS["refs"].replace(LINES, "{lines}"), lines=self._lines()))
    texts = cached_property(lambda self: self._relation("texts"))
    copied = cached_property(lambda self: self._relation("copied"))
    commits = cached_property(lambda self: self._relation("commits"))
    commit_files = cached_property(lambda self: self._relation("commit_files"))
    versions = cached_property(lambda self: self._relation("versions"))
    findings = cached_property(lambda self: self.spark.sql(FINDINGS.replace("({versions})", "{versions}"), versions=self.versions))
    heads = cached_property(lambda self: self._relation("heads"))
    patch_texts = cached_property(lambda self: self._relation("patch_texts"))
    log_lines = cached_property(lambda self: self._relation("log_lines"))
    agent_events = cached_property(lambda self: self._relation("agent_events"))
