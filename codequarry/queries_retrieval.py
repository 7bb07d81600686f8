"""Registered queries of the retrieval composites over the code model, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from codequarry.model import Model
from codequarry.operators import lookups
from codequarry.plans import retrieval
from codequarry.queries import COCHANGE, inner, query

ASKED = "asked AS (SELECT o_custkey % 20 AS query_id, CASE WHEN o_orderkey % 3 = 0 THEN 'get' ELSE 'load' || CAST(o_custkey AS VARCHAR) END AS word FROM orders)"
SEEDS = f"""{ASKED}, named AS (SELECT name AS word, symbol_id, count(*) OVER (PARTITION BY name) AS n FROM (SELECT s.*, row_number() OVER (PARTITION BY name ORDER BY path, start_line, symbol_id) AS r FROM symbols s JOIN files USING (file_id)) WHERE r <= 5),
seeds AS (SELECT query_id, symbol_id, sum(2.0::DOUBLE / n) AS score FROM asked JOIN named USING (word) GROUP BY ALL)"""


def _seeds(m: Model):
    asked = m.table("orders").select((F.col("o_custkey") % 20).alias("query_id"), F.when(F.col("o_orderkey") % 3 == 0, "get").otherwise(F.concat(F.lit("load"), F.col("o_custkey").cast("string"))).alias("word"))
    return retrieval.name_seeds(asked, m.symbols.join(m.files.select("file_id", "path"), "file_id"))


@query("r5_name_seeds", inner(SEEDS, "SELECT query_id, symbol_id, round(score, 6) AS score FROM seeds", "symbols", "files"))
def _(m: Model):
    return _seeds(m).withColumn("score", F.round("score", 6))


@query("r7_expanded", inner(SEEDS, """, best AS (SELECT * FROM (SELECT query_id, symbol_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, symbol_id) AS r FROM seeds) JOIN (SELECT symbol_id, file_id AS own FROM symbols) USING (symbol_id) WHERE r <= 8),
callees AS (SELECT DISTINCT enclosing_symbol_id AS symbol_id, name FROM refs), defs AS (SELECT name, count(*) AS n FROM symbols GROUP BY name HAVING count(*) <= 5)
SELECT query_id, s.symbol_id, round(sum(0.5 * score * CASE WHEN own = s.file_id THEN 1.5 ELSE 1.0 END / n), 6) AS score FROM best JOIN callees c ON c.symbol_id = best.symbol_id JOIN defs USING (name) JOIN symbols s USING (name) GROUP BY ALL""", "symbols", "files", "refs").replace(") , best", "), best"))
def _(m: Model):
    return retrieval.expand(_seeds(m).withColumn("score", F.round("score", 6)), m.symbols, m.refs).withColumn("score", F.round("score", 6))


@query("r8_cochange_boosts", inner(COCHANGE + """, both_ways AS (SELECT file_a, file_b, cnt FROM pairs UNION ALL SELECT file_b, file_a, cnt FROM pairs), sf AS (SELECT session AS query_id, seq AS rank, file_id + 1 AS file_id FROM agent_events),
sd AS (SELECT *, lag(file_id) OVER (PARTITION BY query_id ORDER BY rank) AS prior FROM sf), sl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS slot FROM sd WHERE file_id IS DISTINCT FROM prior),
near AS (SELECT *, cnt / max(cnt) OVER (PARTITION BY file_a) AS w FROM (SELECT *, row_number() OVER (PARTITION BY file_a ORDER BY cnt DESC, file_b) AS r FROM both_ways) WHERE r <= 10)""", "SELECT query_id, file_b AS file_id, round(0.3 * max(w), 6) AS boost FROM sl JOIN near ON file_id = file_a WHERE slot <= 5 GROUP BY ALL", "commit_files", "agent_events"))
def _(m: Model):
    files = m.agent_events.select(F.col("session").alias("query_id"), F.col("seq").alias("rank"), (F.col("file_id") + 1).alias("file_id"))
    return retrieval.cochange_boost(files, lookups.cochanged(lookups.cochange(m.commit_files))).withColumn("boost", F.round("boost", 6))


RANKED = "ranked AS (SELECT session AS query_id, file_id, seq AS item_id, row_number() OVER (PARTITION BY session ORDER BY seq) - 1 AS rank FROM agent_events), fr AS (SELECT query_id, file_id, row_number() OVER (PARTITION BY query_id ORDER BY t DESC, file_id) - 1 AS file_rank FROM (SELECT session AS query_id, file_id, sum(tokens) AS t FROM agent_events WHERE op = 'edit' GROUP BY 1, 2))"


@query("r11_semantic_fusion", inner(RANKED, "SELECT query_id, item_id, round(1.0::DOUBLE / (60 + rank) + CASE WHEN file_rank IS NOT NULL AND row_number() OVER (PARTITION BY query_id, file_id ORDER BY rank, item_id) = 1 THEN 1.0::DOUBLE / (60 + file_rank) ELSE 0 END, 9) AS score FROM ranked LEFT JOIN fr USING (query_id, file_id)", "agent_events"))
def _(m: Model):
    e = m.agent_events
    ranked = e.select(F.col("session").alias("query_id"), "file_id", F.col("seq").alias("item_id"), (F.row_number().over(Window.partitionBy("session").orderBy("seq")) - 1).alias("rank"))
    sums = e.where("op = 'edit'").groupBy(F.col("session").alias("query_id"), "file_id").agg(F.sum("tokens").alias("t"))
    files = sums.select("query_id", "file_id", (F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("t"), "file_id")) - 1).alias("file_rank"))
    return retrieval.fuse_semantic(ranked, files).select("query_id", "item_id", F.round("score", 9).alias("score"))


@query("r9_stale_copies", inner("sc AS (SELECT session AS query_id, file_id, sum(tokens)::DOUBLE AS score FROM agent_events GROUP BY ALL)", "SELECT query_id, CASE WHEN file_id % 6 = 3 THEN file_id + 1 ELSE file_id END AS file_id, round(max(CASE WHEN file_id % 6 = 0 THEN 0.3 * score ELSE score END), 6) AS score FROM sc GROUP BY ALL", "agent_events"))
def _(m: Model):
    scores = m.agent_events.groupBy(F.col("session").alias("query_id"), "file_id").agg(F.sum("tokens").cast("double").alias("score"))
    ids = m.agent_events.select("file_id").distinct().where("file_id % 3 = 0")
    twins = ids.select(F.col("file_id").alias("stale_id"), (F.col("file_id") + 1).alias("fresh_id"), (F.col("file_id") % 6 == 3).alias("same"))
    return retrieval.demote_stale(scores, twins).withColumn("score", F.round("score", 6))


@query("r22_compacted", """WITH t AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' AND length(text) > 1500 THEN 600 ELSE length(text) END AS chars, CASE WHEN role = 'assistant' AND length(text) > 1500 THEN ceil(length(text) * 600 / length(text)) ELSE length(text) END AS tokens FROM conversations WHERE text IS NOT NULL),
u AS (SELECT *, row_number() OVER w AS r, sum(tokens) OVER w AS used FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC)) SELECT conv_id, turn, chars::BIGINT AS chars FROM u WHERE r <= 2 OR used <= 400""")
def _(m: Model):
    turns = m.table("conversations").where("text is not null").select("conv_id", "turn", "text", (F.col("role") == "assistant").alias("tool"), F.length("text").alias("tokens"))
    return retrieval.compact(turns, 400, keep=2).select("conv_id", "turn", F.length("text").cast("long").alias("chars"))


@query("r24_text_hits", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents), h AS (SELECT doc_id, pos + 1 AS line, instr(line, 'the') AS col FROM l WHERE contains(line, 'the'))
SELECT doc_id, line, col FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS r FROM h) WHERE r <= 100 ORDER BY doc_id, line LIMIT 2000""")
def _(m: Model):
    return retrieval.text_hits(m.table("documents").select("doc_id", "text"), "the").select("doc_id", F.col("line").cast("long").alias("line"), F.col("col").cast("long").alias("col"))
