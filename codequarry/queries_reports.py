"""Registered queries of reports over evaluation runs, reviews and costs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from codequarry.functions import text
from codequarry.model import Model, duck
from codequarry.operators import evaluation, lookups, ordered, sessions
from codequarry.plans import graph
from codequarry.queries import COCHANGE, EDGES, inner, query

DIR = "array_to_string(list_slice(string_split(path, '/'), 1, least(2, len(string_split(path, '/')) - 1)), '/')"
WORDS = "list_filter(regexp_split_to_array(coalesce({}, ''), '[^A-Za-z0-9_]+'), lambda w: regexp_matches(w, '^[A-Za-z_]'))"


@query("e3_cluster_bootstrap")
def _(m: Model):
    pairs = m.table("documents").select("lang", "source", (F.col("n_chars") > 2000).cast("int").alias("a"), (F.col("doc_id") % 2).cast("int").alias("b"))
    return evaluation.cluster_bootstrap(pairs, "lang", "source")


@query("e9_nets", """WITH f AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber <= 3), g AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber % 2 = 0)
SELECT l_orderkey, count(*) FILTER (x AND y) AS hits, count(*) FILTER (x AND NOT y) AS outside, count(*) FILTER (NOT x AND y) AS missed
FROM (SELECT l_orderkey, l_partkey, bool_or(x) AS x, bool_or(NOT x) AS y FROM (SELECT *, true AS x FROM f UNION ALL SELECT *, false FROM g) GROUP BY ALL) GROUP BY l_orderkey""")
def _(m: Model):
    lines = m.table("lineitem")
    return evaluation.nets(lines.where("l_linenumber <= 3"), lines.where("l_linenumber % 2 = 0"), "l_orderkey", "l_partkey")


@query("e12_subgroups", r"""WITH t AS (SELECT CAST(n_chars AS DOUBLE) AS v, coalesce(regexp_matches(text, '[A-Za-z]{2}'), false) AS latin, doc_id % 3 = 0 AS third FROM documents)
SELECT 'latin' AS subgroup, count(*) AS n, round(avg(v), 6) AS mean FROM t WHERE latin HAVING count(*) > 0 UNION ALL SELECT 'no latin', count(*), round(avg(v), 6) FROM t WHERE NOT latin HAVING count(*) > 0
UNION ALL SELECT 'before', count(*), round(avg(v), 6) FROM t WHERE third HAVING count(*) > 0 UNION ALL SELECT 'after', count(*), round(avg(v), 6) FROM t WHERE NOT third HAVING count(*) > 0""")
def _(m: Model):
    latin, third = F.coalesce(F.col("text").rlike("[A-Za-z]{2}"), F.lit(False)), F.col("doc_id") % 3 == 0
    docs = m.table("documents").withColumn("v", F.col("n_chars").cast("double"))
    told = evaluation.subgroups(docs, "v", {"latin": latin, "no latin": ~latin, "before": third, "after": ~third})
    return told.withColumn("mean", F.round("mean", 6))


@query("e13_drop_difference", """WITH r AS (SELECT user_id, event_type AS s, event_id % 2 AS f, max((value > 50)::INT) AS v FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL),
w AS (SELECT user_id, max(v) FILTER (s = 'click' AND f = 0) AS a0, max(v) FILTER (s = 'click' AND f = 1) AS a1, max(v) FILTER (s = 'view' AND f = 0) AS b0, max(v) FILTER (s = 'view' AND f = 1) AS b1 FROM r GROUP BY 1)
SELECT count(*) AS n, round(avg((a0 - a1) - (b0 - b1)), 6) AS mean FROM w WHERE a0 IS NOT NULL AND a1 IS NOT NULL AND b0 IS NOT NULL AND b1 IS NOT NULL""")
def _(m: Model):
    runs = m.table("events").select(F.col("user_id").alias("query_id"), F.col("event_type").alias("system"), (F.col("event_id") % 2).alias("form"), (F.col("value") > 50).cast("int").alias("value"))
    return evaluation.drop_difference(runs, ("click", "view"), (0, 1)).withColumn("mean", F.round("mean", 6))


@query("o3_first_references", duck("""SELECT name, path, line, enclosing_symbol_id, r FROM (SELECT name, path, line, enclosing_symbol_id, row_number() OVER (PARTITION BY name ORDER BY path, line, enclosing_symbol_id) AS r
FROM refs JOIN files USING (file_id)) WHERE r <= 20""", "refs", "files"))
def _(m: Model):
    return ordered.first_references(m.refs, m.files, 20)


@query("o11_review_order", duck("""SELECT hash, path, row_number() OVER (PARTITION BY hash ORDER BY CASE file_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END, file_id % 13 DESC, path) AS place
FROM (SELECT DISTINCT hash, file_id FROM commit_files) JOIN (SELECT file_id, path FROM files) USING (file_id)""", "commit_files", "files"))
def _(m: Model):
    level = F.when(F.col("file_id") % 3 == 0, "high").when(F.col("file_id") % 3 == 1, "medium").otherwise("low")
    changed = m.commit_files.distinct().join(m.files.select("file_id", "path"), "file_id").withColumns({"level": level, "callers": F.col("file_id") % 13})
    return ordered.review_order(changed, "hash").select("hash", "path", "place")


@query("f25_usage_costs", duck("SELECT session, round(sum((tokens + coalesce(CASE WHEN seq % 5 <> 0 THEN seq % 1000 END, 0) * 0.1::DOUBLE + (seq % 300) * 1.25::DOUBLE) * 3 / 1e6 + (seq % 700) * 15 / 1e6), 6) AS dollars FROM agent_events GROUP BY session", "agent_events"))
def _(m: Model):
    n = F.col("seq")
    spent = sessions.usage_cost(F.col("tokens"), F.when(n % 5 != 0, n % 1000), n % 300, n % 700, F.lit(3), F.lit(15))
    return m.agent_events.groupBy("session").agg(F.round(F.sum(spent), 6).alias("dollars"))


@query("p19_diff_lines", """WITH l AS (SELECT l_orderkey, l_linenumber, (['--- a/', '+++ b/', '@@ -', '-', '+', ' ', 'diff --git a/', '--', '---', '+++', '@@', ''])[l_partkey % 12 + 1] || l_suppkey AS line FROM lineitem) SELECT l_orderkey, l_linenumber, line,
CASE WHEN line LIKE '--- %' THEN 'old' WHEN line LIKE '+++ %' THEN 'new' WHEN line LIKE '@@ -%' THEN 'hunk' WHEN line[1] = '-' THEN 'deleted' WHEN line[1] = '+' THEN 'added' WHEN line[1] = ' ' THEN 'context' END AS kind FROM l""")
def _(m: Model):
    starts = F.array(*(F.lit(s) for s in ("--- a/", "+++ b/", "@@ -", "-", "+", " ", "diff --git a/", "--", "---", "+++", "@@", "")))
    line = F.concat(F.element_at(starts, (F.col("l_partkey") % 12 + 1).cast("int")), F.col("l_suppkey").cast("string"))
    return m.table("lineitem").select("l_orderkey", "l_linenumber", line.alias("line"), text.diff_line(line).alias("kind"))


@query("o4_changed_with", inner(COCHANGE, """SELECT file_a, path, cnt, r FROM (SELECT file_a, path, cnt, row_number() OVER (PARTITION BY file_a ORDER BY cnt DESC, path) AS r
FROM (SELECT file_a, file_b, cnt FROM pairs UNION ALL SELECT file_b, file_a, cnt FROM pairs) JOIN files ON file_id = file_b) WHERE r <= 8""", "commit_files", "files"))
def _(m: Model):
    return ordered.most_changed_with(lookups.cochanged(lookups.cochange(m.commit_files)), m.files, 8)


@query("o6_outside_folders", inner(f"{EDGES}, d AS (SELECT file_id, {DIR} AS dir FROM files), e AS (SELECT a.dir AS x, b.dir AS y, n FROM edges JOIN d a ON a.file_id = src JOIN d b ON b.file_id = dst WHERE a.dir <> b.dir)",
"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY n DESC, outside) AS r FROM (SELECT dir, outside, sum(n)::BIGINT AS n
FROM (SELECT x AS dir, y AS outside, n FROM e UNION ALL SELECT y, x, n FROM e) GROUP BY ALL)) WHERE r <= 12""", "refs", "symbols", "files"))
def _(m: Model):
    return ordered.outside_folders(graph.folder_edges(m.files, lookups.file_ref_edges(m.refs, m.symbols, m.files), 2), 12)


@query("e16_leaks", f"""WITH w AS (SELECT item_id, {WORDS.format("text")} AS ws FROM benchmark)
SELECT a.item_id, array_to_string(list_sort(list_distinct(list_filter(a.ws, lambda x: NOT list_contains(coalesce(b.ws, []), x) AND list_contains(coalesce(c.ws, []), x)))), ' ') AS leaked
FROM w a LEFT JOIN w b ON b.item_id = a.item_id + 1 LEFT JOIN w c ON c.item_id = a.item_id + 2""")
def _(m: Model):
    items = m.table("benchmark").select("item_id", "text")
    source, gold = (items.select((F.col("item_id") - k).alias("item_id"), F.col("text").alias(name)) for k, name in ((1, "source"), (2, "gold")))
    told = items.join(source, "item_id", "left").join(gold, "item_id", "left")
    return told.select("item_id", F.concat_ws(" ", text.leaked(F.col("text"), F.col("source"), F.col("gold"))).alias("leaked"))
