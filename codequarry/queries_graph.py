"""Registered queries of the graph composites and the remaining text functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from codequarry.functions import text
from codequarry.model import Model, duck
from codequarry.operators import lookups, sessions
from codequarry.plans import graph
from codequarry.queries import CALLS, COCHANGE, EDGES, IS_TEST, inner, query

NEAR = f"""{CALLS}, {COCHANGE}, both_ways AS (SELECT file_a, file_b, cnt FROM pairs UNION ALL SELECT file_b, file_a, cnt FROM pairs), own AS (SELECT symbol_id, file_id FROM symbols),
callees AS (SELECT DISTINCT own.symbol_id, s.symbol_id AS target FROM own JOIN refs r ON r.enclosing_symbol_id = own.symbol_id JOIN defs d ON d.name = r.name AND defs <= 2 JOIN symbols s ON s.name = r.name WHERE s.symbol_id <> own.symbol_id)"""


@query("g4_neighborhoods", inner(NEAR, """SELECT symbol_id, 'defines' AS kind, file_id AS target FROM own
UNION ALL SELECT symbol_id, 'caller', caller_id FROM (SELECT symbol_id, caller_id, row_number() OVER (PARTITION BY symbol_id ORDER BY caller_id) AS r FROM calls JOIN own USING (symbol_id)) WHERE r <= 20
UNION ALL SELECT symbol_id, 'callee', target FROM (SELECT *, row_number() OVER (PARTITION BY symbol_id ORDER BY target) AS r FROM callees) WHERE r <= 20
UNION ALL SELECT symbol_id, 'cochange', file_b FROM (SELECT symbol_id, file_b, row_number() OVER (PARTITION BY symbol_id ORDER BY cnt DESC, file_b) AS r FROM own JOIN both_ways ON file_id = file_a) WHERE r <= 5""", "symbols", "refs", "files", "commit_files"))
def _(m: Model):
    return graph.neighborhood(m.symbols, m.symbols, m.refs, lookups.callers(m.symbols, m.refs, m.files), lookups.cochange(m.commit_files))


@query("g14_edges_once", duck("SELECT enclosing_symbol_id AS src, file_id AS dst, kind, min(line) AS depth FROM refs WHERE enclosing_symbol_id <> file_id GROUP BY ALL", "refs"))
def _(m: Model):
    return graph.once(m.refs.select(F.col("enclosing_symbol_id").alias("src"), F.col("file_id").alias("dst"), "kind", F.col("line").alias("depth")))


@query("g20_node_keys", duck("SELECT symbol_id AS node_id, kind || ':' || path || ':' || name || '#' || (row_number() OVER (PARTITION BY kind, path, name ORDER BY symbol_id) - 1)::VARCHAR AS key FROM symbols JOIN files USING (file_id)", "symbols", "files"))
def _(m: Model):
    return graph.node_keys(m.symbols.join(m.files.select("file_id", "path"), "file_id").select(F.col("symbol_id").alias("node_id"), "kind", "path", F.col("name").alias("label")))


@query("g16_footprint", duck("SELECT session, file_id, CASE min(CASE op WHEN 'edit' THEN 0 WHEN 'read' THEN 1 ELSE 2 END) WHEN 0 THEN 'edited' WHEN 1 THEN 'read' ELSE 'searched' END AS mark FROM agent_events WHERE op IN ('edit', 'read', 'search') GROUP BY ALL", "agent_events"))
def _(m: Model):
    return graph.footprint(m.agent_events)


@query("g18_related_tests", inner(EDGES + ", " + COCHANGE, f"""SELECT DISTINCT file_id, test_id FROM (SELECT dst AS file_id, src AS test_id FROM edges UNION ALL SELECT file_a, file_b FROM pairs UNION ALL SELECT file_b, file_a FROM pairs UNION ALL SELECT file_id, file_id FROM files)
WHERE test_id IN (SELECT file_id FROM files WHERE {IS_TEST})""", "refs", "symbols", "files", "commit_files"))
def _(m: Model):
    return graph.related_tests(m.files, m.files, lookups.file_ref_edges(m.refs, m.symbols, m.files), lookups.cochange(m.commit_files))


@query("g11_linked_notes", inner("notes AS (SELECT event_id AS note_id, 'see load' || CAST(event_id % 1500 AS VARCHAR) || ' and get, only' || CAST(event_id AS VARCHAR) AS text FROM events), w AS (SELECT DISTINCT note_id, unnest(regexp_split_to_array(text, '[^A-Za-z0-9_]+')) AS name FROM notes)", "SELECT note_id, name FROM (SELECT note_id, name, row_number() OVER (PARTITION BY note_id ORDER BY name) AS r FROM w WHERE name IN (SELECT name FROM symbols GROUP BY name HAVING count(*) <= 3)) WHERE r <= 8", "symbols"))
def _(m: Model):
    i = F.col("event_id")
    notes = m.table("events").select(i.alias("note_id"), F.concat(F.lit("see load"), (i % 1500).cast("string"), F.lit(" and get, only"), i.cast("string")).alias("text"))
    return graph.linked_notes(notes, m.symbols)


@query("f27_compact_numbers", "SELECT event_id, CASE WHEN event_id * 977 >= 1000000 THEN printf('%.1fM', round(event_id * 977 / 1000000, 1)) WHEN event_id * 977 >= 1000 THEN printf('%.1fk', round(event_id * 977 / 1000, 1)) ELSE (event_id * 977)::VARCHAR END AS told FROM events")
def _(m: Model):
    return m.table("events").select("event_id", text.compact_number(F.col("event_id") * 977).alias("told"))


@query("f32_urls", r"SELECT page_id, regexp_replace(replace(url, '://', '://me:pass@'), '(?i)\b([a-z][a-z0-9+.-]*://)[^/\s@]+@', '\1', 'g') AS url FROM pages")
def _(m: Model):
    return m.table("pages").select("page_id", text.redact_url(F.replace("url", F.lit("://"), F.lit("://me:pass@"))).alias("url"))


@query("f35_failure_prints", r"SELECT doc_id, md5(regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[-15:], chr(10)), '[0-9]', '', 'g')) AS print FROM documents")
def _(m: Model):
    return m.table("documents").select("doc_id", F.md5(text.failure_print(F.col("text"))).alias("print"))


@query("f42_split", "SELECT doc_id, ('0x' || substr(md5(text), 1, 8))::BIGINT % 10 < 3 AS development FROM documents WHERE text IS NOT NULL")
def _(m: Model):
    return m.table("documents").where("text is not null").select("doc_id", text.in_development(F.md5("text")).alias("development"))


@query("f26_model_names", r"SELECT DISTINCT event_type, regexp_replace(split_part(event_type || '-2024010' || (event_id % 10)::VARCHAR || '[1m]', '[', 1), '-[0-9]{8}$', '') AS model FROM events")
def _(m: Model):
    name = F.concat("event_type", F.lit("-2024010"), (F.col("event_id") % 10).cast("string"), F.lit("[1m]"))
    return m.table("events").select("event_type", sessions.model_name(name).alias("model")).distinct()
