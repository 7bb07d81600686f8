"""Registered queries from a question to its packed context, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from codequarry.model import Model
from codequarry.operators import lookups
from codequarry.plans import retrieval
from codequarry.queries import COCHANGE, inner, query
from codequarry.queries_search import INDEX, QUESTION, _asked, _found, found_sql
from codequarry.shared import written

BUDGET = 1500
SEEDS = f"""{INDEX}, {found_sql("asked", "found")}, {found_sql("also", "wider")}, f40 AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, symbol_id) <= 40), w40 AS (SELECT * FROM wider QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, symbol_id) <= 40),
fused AS (SELECT query_id, symbol_id, round(sum(s), 6) AS score FROM (SELECT query_id, symbol_id, score / max(score) OVER (PARTITION BY query_id) AS s FROM f40 UNION ALL SELECT query_id, symbol_id, 0.5::DOUBLE * (score / max(score) OVER (PARTITION BY query_id)) FROM w40) GROUP BY ALL),
words AS (SELECT query_id, unnest(['where', 'load' || k, 'called', 'from', 'parseItem' || p, 'core']) AS word FROM q), named AS (SELECT name AS word, symbol_id, count(*) OVER (PARTITION BY name) AS n FROM (SELECT s.*, row_number() OVER (PARTITION BY name ORDER BY path, start_line, symbol_id) AS r FROM symbols s JOIN files USING (file_id)) WHERE r <= 5),
places AS (SELECT query_id, query_id % 50 + 1 AS f, CASE WHEN query_id % 200 = 0 THEN 20 END AS line FROM q),
focus AS (SELECT query_id, arg_min(symbol_id, (end_line - start_line, start_line, symbol_id)) AS symbol_id, 3.0::DOUBLE AS score FROM places JOIN symbols ON file_id = f AND line BETWEEN start_line AND end_line GROUP BY query_id
  UNION ALL SELECT query_id, symbol_id, 0.8::DOUBLE FROM (SELECT query_id, symbol_id, row_number() OVER (PARTITION BY query_id ORDER BY start_line, symbol_id) AS r FROM places JOIN symbols ON file_id = f WHERE line IS NULL) WHERE r <= 30),
seeds AS MATERIALIZED (SELECT query_id, symbol_id, round(sum(score), 6) AS score FROM (SELECT query_id, symbol_id, score FROM fused UNION ALL SELECT query_id, symbol_id, 2.0::DOUBLE / n FROM words JOIN named USING (word) UNION ALL SELECT query_id, symbol_id, score FROM focus) GROUP BY ALL)"""
AROUND = """best AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, symbol_id) AS r FROM seeds) JOIN symbols USING (symbol_id) WHERE r <= 8), cnt AS (SELECT name, count(*) AS n FROM symbols GROUP BY name), uses AS (SELECT DISTINCT enclosing_symbol_id AS by_id, name FROM refs WHERE enclosing_symbol_id IS NOT NULL),
callees AS (SELECT b.query_id, o.symbol_id, 0.5::DOUBLE * b.score * CASE WHEN o.file_id = b.file_id THEN 1.5::DOUBLE ELSE 1.0 END / cnt.n AS gain FROM best b JOIN uses u ON u.by_id = b.symbol_id AND u.name <> b.name JOIN cnt ON cnt.name = u.name AND cnt.n <= 5 JOIN symbols o ON o.name = u.name
  WHERE o.symbol_id <> b.symbol_id AND NOT (o.file_id = b.file_id AND b.start_byte <= o.start_byte AND o.end_byte <= b.end_byte)),
first_users AS (SELECT * FROM (SELECT u.name, s.symbol_id, s.file_id, s.start_byte, s.end_byte, row_number() OVER (PARTITION BY u.name ORDER BY path, start_line, s.symbol_id) AS r FROM uses u JOIN symbols s ON s.symbol_id = u.by_id JOIN files f ON f.file_id = s.file_id) WHERE r <= 12),
callers AS (SELECT b.query_id, o.symbol_id, 0.4::DOUBLE * b.score AS gain FROM best b JOIN cnt ON cnt.name = b.name AND cnt.n <= 3 JOIN first_users o ON o.name = b.name WHERE o.symbol_id <> b.symbol_id AND NOT (o.file_id = b.file_id AND o.start_byte <= b.start_byte AND b.end_byte <= o.end_byte)),
near AS MATERIALIZED (SELECT query_id, symbol_id, sum(gain) AS score FROM (SELECT * FROM callees UNION ALL SELECT * FROM callers) GROUP BY ALL)"""
PACKED = f"""both_ways AS (SELECT file_a, file_b, cnt FROM pairs UNION ALL SELECT file_b, file_a, cnt FROM pairs), sd AS (SELECT query_id, r, file_id, lag(file_id) OVER (PARTITION BY query_id ORDER BY r) AS prior FROM best), sl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r) AS slot FROM sd WHERE file_id IS DISTINCT FROM prior),
partners AS (SELECT *, cnt / max(cnt) OVER (PARTITION BY file_a) AS w FROM (SELECT *, row_number() OVER (PARTITION BY file_a ORDER BY cnt DESC, file_b) AS pr FROM both_ways) WHERE pr <= 10), boost AS (SELECT query_id, file_b AS file_id, 0.3::DOUBLE * max(w) AS boost FROM sl JOIN partners ON file_id = file_a WHERE slot <= 5 GROUP BY ALL),
summed AS (SELECT query_id, symbol_id, round(sum(score), 6) AS score FROM (SELECT * FROM seeds UNION ALL SELECT * FROM near) GROUP BY ALL), lifted AS (SELECT s.query_id, s.symbol_id, round(s.score + coalesce(boost, 0), 6) AS score FROM summed s JOIN symbols y USING (symbol_id) LEFT JOIN boost b ON b.query_id = s.query_id AND b.file_id = y.file_id),
items AS MATERIALIZED (SELECT query_id, symbol_id AS item_id, file_id AS f, start_byte AS s, end_byte AS e, (end_byte - start_byte + 1) // 4 + 1 AS tokens, length(signature) // 4 + 1 AS sig, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, symbol_id) AS rank FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM lifted) JOIN symbols USING (symbol_id) WHERE score >= 0.12::DOUBLE * top),
fold AS (SELECT query_id, 0::BIGINT AS k, {BUDGET}::BIGINT AS room, []::STRUCT(rank BIGINT, item_id BIGINT, mode VARCHAR, cost BIGINT, f BIGINT, s BIGINT, e BIGINT)[] AS taken FROM items GROUP BY query_id
  UNION ALL SELECT query_id, k, CASE WHEN fits THEN room - cost ELSE room END, CASE WHEN fits THEN list_append(taken, {{'rank': k, 'item_id': item_id, 'mode': CASE WHEN whole THEN 'full' ELSE 'signature' END, 'cost': cost, 'f': f, 's': s, 'e': e}}) ELSE taken END
  FROM (SELECT *, room >= 50 AND NOT inside AND cost <= room AS fits FROM (SELECT *, CASE WHEN whole THEN tokens ELSE sig END + 25 AS cost FROM (
    SELECT d.query_id, i.rank AS k, d.room, d.taken, i.item_id, i.tokens, i.sig, i.f, i.s, i.e, len(list_filter(d.taken, lambda t: t.mode = 'full' AND t.f = i.f AND t.s <= i.s AND i.e <= t.e)) > 0 AS inside,
      len(list_filter(d.taken, lambda t: t.f = i.f AND i.s <= t.s AND t.e <= i.e)) = 0 AND i.tokens + 25 <= d.room AND i.tokens + 25 <= {BUDGET * 35 // 100} AS whole
    FROM fold d JOIN items i ON i.query_id = d.query_id AND i.rank = d.k + 1 WHERE i.rank <= 80)))),
last AS (SELECT query_id, arg_max(taken, k) AS taken FROM fold GROUP BY query_id)"""


def _seeds(m: Model):
    asked = _asked(m)
    also = asked.select("query_id").distinct().select("query_id", F.explode(F.array(F.lit("function"), F.lit("api"))).alias("term"), F.lit(False).alias("prefix"))
    found, wider = _found(m, asked, also)
    fused = retrieval.fuse_groups(found, wider).withColumn("score", F.round("score", 6))
    questions = m.table("customer").where("c_custkey % 100 = 0").select(F.col("c_custkey").alias("query_id"), F.expr(QUESTION).alias("question"))
    words = questions.select("query_id", F.explode(F.regexp_extract_all("question", F.lit(r"[A-Za-z_]\w*"), F.lit(0))).alias("word"))
    names = retrieval.name_seeds(words, m.symbols.join(m.files.select("file_id", "path"), "file_id"))
    places = questions.select("query_id", (F.col("query_id") % 50 + 1).alias("file_id"), F.when(F.col("query_id") % 200 == 0, 20).alias("line"))
    return written(retrieval.summed(fused, names, retrieval.focused(places, m.symbols)), "seeds")


@query("r6_seeds", inner(SEEDS, "SELECT query_id, symbol_id, score FROM seeds", "symbols", "files"))
def _(m: Model):
    return _seeds(m)


@query("r7_neighbours", inner(f"{SEEDS}, {AROUND}", "SELECT query_id, symbol_id, round(score, 6) AS score FROM near", "symbols", "files", "refs"))
def _(m: Model):
    return retrieval.neighbours(_seeds(m), m.symbols, m.refs, m.files).withColumn("score", F.round("score", 6))


@query("r17_context", inner(f"{SEEDS}, {AROUND}, {COCHANGE}, {PACKED}", "SELECT query_id, t.rank::INT AS rank, t.item_id AS item_id, t.mode AS mode, t.cost AS cost FROM (SELECT query_id, unnest(taken) AS t FROM last)", "symbols", "files", "refs", "commit_files").replace("WITH ", "WITH RECURSIVE ", 1))
def _(m: Model):
    return retrieval.context(_seeds(m), m.symbols, m.refs, m.files, lookups.cochanged(lookups.cochange(m.commit_files)), BUDGET)
