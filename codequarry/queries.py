"""The registered queries of the library's own operators, with their SQL; each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codequarry.functions import paths, text
from codequarry.model import Model, duck
from codequarry.operators import lookups, sessions
from codequarry.plans import graph, retrieval

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of the model as a query, with its SQL."""

    def add(f: Callable[[Model], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Model(spark, sf_dir))
        if sql:
            ORACLE[name] = sql
        return f

    return add


def inner(ctes: str, body: str, *relations: str) -> str:
    """SQL with further common tables behind the model's."""
    return duck("", *relations).rstrip() + f", {ctes} {body}"


# Lookups and predicates.

query("p1_symbol_by_id", duck("SELECT symbol_id, name, path FROM symbols JOIN files USING (file_id) WHERE symbol_id = 42", "symbols", "files"))(
    lambda m: lookups.with_files(m.symbols.where("symbol_id = 42"), m.files).select("symbol_id", "name", "path")
)
query("p2_symbols_by_name", duck("SELECT symbol_id, name, path, start_line FROM symbols JOIN files USING (file_id) WHERE name = 'get' ORDER BY path, start_line, symbol_id LIMIT 50", "symbols", "files"))(
    lambda m: lookups.symbols_by_name(m.symbols, m.files, "get", 50).select("symbol_id", "name", "path", "start_line")
)
query("p3_symbols_in_file", duck("SELECT symbol_id, name, start_line FROM symbols WHERE file_id = 7", "symbols"))(lambda m: m.symbols.where("file_id = 7").select("symbol_id", "name", "start_line"))
query("p4_files_under", duck("SELECT file_id, substr(path, 9) AS rest FROM files WHERE starts_with(path, 'src/api/')", "files"))(lambda m: lookups.files_under(m.files, "src/api"))
query(
    "p6_test_paths",
    duck(
        """SELECT path, regexp_matches(lower(path), '/tests?/|__tests__|^tests?/|\\.test\\.|\\.spec\\.|_test\\.|\\.tests/|(^|/)test_[^/]*$')
  OR (strlen(regexp_extract(path, '([^/]+?)(\\.[^./]*)?$', 1)) > 4 AND regexp_matches(regexp_extract(path, '([^/]+?)(\\.[^./]*)?$', 1), 'Tests?$')) AS is_test FROM files""",
        "files",
    ),
)(lambda m: m.files.select("path", paths.is_test_path(F.col("path")).alias("is_test")))
query("p10_outside_index", duck("SELECT path, len(list_filter(string_split(path, '/'), lambda s: s[1] = '.' OR s IN ('node_modules', 'target', 'dist', 'build', 'out', 'vendor', '__pycache__', 'venv', 'coverage', 'bin', 'obj'))) > 0 AS outside FROM files", "files"))(
    lambda m: m.files.select("path", paths.outside_index(F.col("path")).alias("outside"))
)
query("p13_generic_names", duck("SELECT name, count(*) AS n, bool_or(length(name) < 3 OR lower(name) IN (" + ", ".join(f"'{w}'" for w in text.GENERIC_NAMES) + ")) AS generic FROM symbols GROUP BY name", "symbols"))(
    lambda m: m.symbols.groupBy("name").agg(F.count("*").alias("n"), F.max(text.is_generic_name(F.col("name"))).alias("generic"))
)
query("p14_families", duck("SELECT CASE WHEN lang IN ('typescript', 'javascript') THEN 'js' WHEN lang IN ('c', 'cpp') THEN 'c' ELSE lang END AS family, count(*) AS n FROM files GROUP BY ALL", "files"))(
    lambda m: m.files.groupBy(paths.family(F.col("lang")).alias("family")).agg(F.count("*").alias("n"))
)
SNAPSHOTS = """a AS (SELECT path, mtime, size, hash FROM files WHERE file_id % 10 <> 3),
b AS (SELECT path, mtime + CASE WHEN file_id % 5 = 0 THEN 1 ELSE 0 END AS mtime, size, CASE WHEN file_id % 10 = 5 THEN 'new' ELSE hash END AS hash FROM files WHERE file_id % 10 <> 7)"""
DIFF = """SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'removed' WHEN a.path IS NULL THEN 'added' WHEN a.mtime = b.mtime AND a.size = b.size THEN 'unchanged'
  WHEN a.hash = b.hash THEN 'touched' ELSE 'changed' END AS action FROM a FULL OUTER JOIN b ON a.path = b.path"""
query("s4_snapshot_diff", inner(SNAPSHOTS, DIFF, "files"))(
    lambda m: lookups.snapshot_diff(
        m.files.where("file_id % 10 <> 3").select("path", "mtime", "size", "hash"),
        m.files.where("file_id % 10 <> 7").select("path", (F.col("mtime") + F.when(F.col("file_id") % 5 == 0, 1).otherwise(0)).alias("mtime"), "size", F.when(F.col("file_id") % 10 == 5, "new").otherwise(F.col("hash")).alias("hash")),
    )
)

# Joins.

query("j3_references", duck("SELECT path, line, r.kind, r.name, s.name AS enclosing FROM refs r JOIN files f ON r.file_id = f.file_id LEFT JOIN symbols s ON s.symbol_id = r.enclosing_symbol_id", "refs", "files", "symbols"))(
    lambda m: lookups.references(m.refs, m.files, m.symbols)
)
FAMILY = "CASE WHEN lang IN ('typescript', 'javascript') THEN 'js' WHEN lang IN ('c', 'cpp') THEN 'c' ELSE lang END"
CALLS = f"""fam AS (SELECT file_id, path, {FAMILY} AS family FROM files), defs AS (SELECT name, count(*) AS defs FROM symbols GROUP BY name),
calls AS (SELECT DISTINCT t.symbol_id, c.symbol_id AS caller_id FROM symbols t JOIN defs d ON d.name = t.name AND defs <= 3 JOIN refs r ON r.name = t.name JOIN symbols c ON c.symbol_id = r.enclosing_symbol_id
  JOIN fam ft ON ft.file_id = t.file_id JOIN fam fc ON fc.file_id = c.file_id
  WHERE ft.family = fc.family AND t.symbol_id <> c.symbol_id AND NOT (t.file_id = c.file_id AND t.start_byte <= c.start_byte AND c.end_byte <= t.end_byte))"""


query("g6_callers", inner(CALLS, "SELECT symbol_id, caller_id FROM calls", "symbols", "refs", "files"))(lambda m: lookups.callers(m.symbols, m.refs, m.files))
EDGES = f"""famx AS (SELECT file_id AS fid, {FAMILY} AS family FROM files), rare AS (SELECT name FROM symbols GROUP BY name HAVING count(*) <= 3),
edges AS (SELECT r.file_id AS src, s.file_id AS dst, count(*) AS n FROM refs r JOIN rare USING (name) JOIN symbols s ON s.name = r.name JOIN famx a ON a.fid = r.file_id JOIN famx b ON b.fid = s.file_id
  WHERE r.file_id <> s.file_id AND a.family = b.family GROUP BY ALL)"""
query("j5_file_ref_edges", inner(EDGES, "SELECT src, dst, n FROM edges", "refs", "symbols", "files"))(lambda m: lookups.file_ref_edges(m.refs, m.symbols, m.files))
query("j6_file_summaries", duck("SELECT path, lang, count(symbol_id) AS n_symbols FROM files LEFT JOIN symbols USING (file_id) GROUP BY path, lang", "files", "symbols"))(lambda m: lookups.file_summaries(m.files, m.symbols))
query("j7_missing_vectors", "SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id)")(
    lambda m: m.table("documents").select("doc_id").join(m.table("embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")
)
query("a5_vector_coverage", "SELECT count(DISTINCT doc_id) AS total, count(DISTINCT vec_id) AS done FROM documents LEFT JOIN embeddings ON vec_id = doc_id")(
    lambda m: m.table("documents").join(m.table("embeddings").select("vec_id"), F.col("vec_id") == F.col("doc_id"), "left").agg(F.countDistinct("doc_id").alias("total"), F.countDistinct("vec_id").alias("done"))
)
query("j11_innermost", duck("SELECT symbol_id FROM symbols s WHERE NOT EXISTS (SELECT 1 FROM symbols o WHERE o.file_id = s.file_id AND o.symbol_id <> s.symbol_id AND s.start_byte <= o.start_byte AND o.end_byte <= s.end_byte)", "symbols"))(
    lambda m: lookups.innermost(m.symbols).select("symbol_id")
)
query("j12_top_level", duck("SELECT symbol_id FROM symbols s WHERE NOT EXISTS (SELECT 1 FROM symbols o WHERE o.file_id = s.file_id AND o.start_byte <= s.start_byte AND s.end_byte <= o.end_byte AND (o.start_byte < s.start_byte OR o.end_byte > s.end_byte))", "symbols"))(
    lambda m: lookups.top_level(m.symbols).select("symbol_id")
)
query("j13_enclosing", duck("SELECT DISTINCT r.file_id, r.line, first_value(s.symbol_id) OVER (PARTITION BY r.file_id, r.line ORDER BY s.end_line - s.start_line, s.start_line, s.symbol_id) AS symbol_id FROM refs r JOIN symbols s ON s.file_id = r.file_id AND r.line BETWEEN s.start_line AND s.end_line", "refs", "symbols"))(
    lambda m: lookups.enclosing(m.refs.select("file_id", "line").distinct(), m.symbols)
)
query("j14_touched", duck("SELECT DISTINCT s.symbol_id FROM symbols s JOIN files f ON f.file_id = s.file_id WHERE s.start_line <= 20 + f.file_id % 9 AND 11 <= s.end_line", "symbols", "files"))(
    lambda m: lookups.touched(m.symbols, m.files.select("file_id", F.lit(11).alias("a"), (20 + F.col("file_id") % 9).alias("z"))).select("symbol_id")
)
COCHANGE = """sized AS (SELECT hash FROM commit_files GROUP BY hash HAVING count(*) BETWEEN 2 AND 30), ids AS (SELECT DISTINCT hash, file_id FROM commit_files JOIN sized USING (hash)),
pairs AS (SELECT a.file_id AS file_a, b.file_id AS file_b, count(*) AS cnt FROM ids a JOIN ids b ON a.hash = b.hash AND a.file_id < b.file_id GROUP BY ALL HAVING count(*) >= 2)"""
query("j15_cochange", inner(COCHANGE, "SELECT file_a, file_b, cnt FROM pairs", "commit_files"))(lambda m: lookups.cochange(m.commit_files))
query("u1_cochanged_both_ways", inner(COCHANGE, "SELECT file_a, file_b, cnt FROM pairs UNION ALL SELECT file_b, file_a, cnt FROM pairs", "commit_files"))(lambda m: lookups.cochanged(lookups.cochange(m.commit_files)))
query("j18_as_of_before", inner("e AS (SELECT seq AS key, ts - 600000000 + (seq * 7919) % 100000000 AS ts FROM agent_events)", "SELECT key, (SELECT arg_max(hash, (ct, hash)) FROM commits c WHERE c.ct <= e.ts) AS hash FROM e", "agent_events", "commits"))(
    lambda m: lookups.as_of_before(m.agent_events.select(F.col("seq").alias("key"), (F.col("ts") - 600000000 + (F.col("seq") * 7919) % 100000000).alias("ts")), m.commits)
)
query("j19_first_commit_within", inner("e AS (SELECT seq AS key, file_id, ts - 800000000 + (seq * 7919) % 100000000 AS ts FROM agent_events WHERE op = 'edit')", "SELECT key, arg_min(c.hash, (c.ct, c.hash)) AS hash FROM e JOIN (SELECT DISTINCT * FROM commit_files) f USING (file_id) JOIN commits c ON c.hash = f.hash WHERE c.ct BETWEEN e.ts AND e.ts + 1209600 GROUP BY key", "agent_events", "commits", "commit_files"))(
    lambda m: lookups.first_commit_within(m.agent_events.where("op = 'edit'").select(F.col("seq").alias("key"), "file_id", (F.col("ts") - 800000000 + (F.col("seq") * 7919) % 100000000).alias("ts")), m.commits, m.commit_files, 14 * 86400)
)
query("j27_overlaps", inner("e AS (SELECT DISTINCT session, file_id FROM agent_events WHERE op = 'edit')", "SELECT a.session, b.session AS other, count(*) AS files FROM e a JOIN e b ON a.file_id = b.file_id AND a.session < b.session GROUP BY ALL", "agent_events"))(
    lambda m: sessions.overlaps(m.agent_events)
)

# Aggregations, top-k and sets.

query("a1_definitions", duck("SELECT name, count(*) AS defs FROM symbols GROUP BY name", "symbols"))(lambda m: lookups.definitions(m.symbols))
query("a2_rare_names", duck("SELECT name FROM symbols GROUP BY name HAVING count(*) <= 3", "symbols"))(lambda m: lookups.definitions(m.symbols).where("defs <= 3").select("name"))
query("a3_callees", duck("SELECT enclosing_symbol_id AS symbol_id, name, min(line) AS line FROM refs GROUP BY ALL", "refs"))(lambda m: m.refs.groupBy(F.col("enclosing_symbol_id").alias("symbol_id"), "name").agg(F.min("line").alias("line")))
query("a4_languages", duck("SELECT lang, count(*) AS n FROM files GROUP BY lang", "files"))(lambda m: m.files.groupBy("lang").agg(F.count("*").alias("n")))
query("a6_degrees", inner(EDGES, "SELECT coalesce(i.f, o.f) AS file_id, coalesce(n_in, 0) AS n_in, coalesce(n_out, 0) AS n_out FROM (SELECT dst AS f, count(DISTINCT src) AS n_in FROM edges GROUP BY 1) i FULL JOIN (SELECT src AS f, count(DISTINCT dst) AS n_out FROM edges GROUP BY 1) o ON i.f = o.f", "refs", "symbols", "files"))(
    lambda m: (lambda e: e.select(F.col("dst").alias("file_id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(e.select(F.col("src").alias("file_id"), F.lit(0).alias("i"), F.lit(1).alias("o"))))(lookups.file_ref_edges(m.refs, m.symbols, m.files)).groupBy("file_id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))
)
query("a15_median_commit", duck("SELECT CAST(floor(median(n)) AS BIGINT) AS median, max(n) AS largest, avg(n) AS mean FROM (SELECT hash, count(*) AS n FROM commit_files GROUP BY hash)", "commit_files"))(
    lambda m: m.commit_files.groupBy("hash").agg(F.count("*").alias("n")).agg(F.floor(F.percentile("n", 0.5)).alias("median"), F.max("n").alias("largest"), F.avg("n").alias("mean"))
)
query("a18_conditional_counts", duck("SELECT session, count(*) FILTER (op = 'edit' AND ok) AS edits, count(*) FILTER (op = 'edit' AND NOT ok) AS failed, count(*) FILTER (test_run) AS tests FROM agent_events GROUP BY session", "agent_events"))(
    lambda m: m.agent_events.groupBy("session").agg(F.count_if((F.col("op") == "edit") & F.col("ok")).alias("edits"), F.count_if((F.col("op") == "edit") & ~F.col("ok")).alias("failed"), F.count_if("test_run").alias("tests"))
)
query("a23_percentiles", duck("SELECT quantile_disc(n, 0.5) AS p50, quantile_disc(n, 0.95) AS p95 FROM (SELECT hash, count(*) AS n FROM commit_files GROUP BY hash)", "commit_files"))(
    lambda m: m.commit_files.groupBy("hash").agg(F.count("*").alias("n")).agg(F.expr("percentile_disc(0.5) within group (order by n)").cast("long").alias("p50"), F.expr("percentile_disc(0.95) within group (order by n)").cast("long").alias("p95"))
)
query("a21_months", duck("SELECT strftime(make_timestamp(ct * 1000000), '%Y-%m') AS month, count(*) AS commits FROM commits GROUP BY 1", "commits"))(
    lambda m: m.commits.groupBy(F.date_format(F.timestamp_seconds("ct"), "yyyy-MM").alias("month")).agg(F.count("*").alias("commits"))
)
query("a13_usage", inner("msg AS (SELECT session, seq // 3 AS msg_id, max(tokens) AS tokens FROM agent_events GROUP BY ALL)", "SELECT session, sum(tokens)::BIGINT AS tokens, count(*) AS messages FROM msg GROUP BY session", "agent_events"))(
    lambda m: sessions.usage(m.agent_events.select("session", F.floor(F.col("seq") / 3).alias("msg_id"), "tokens"))
)
query("a14_counter_deltas", duck("SELECT session, sum(greatest(tokens - coalesce(prior, 0), 0))::BIGINT AS total FROM (SELECT session, tokens, lag(tokens) OVER (PARTITION BY session ORDER BY seq) AS prior FROM agent_events) GROUP BY session", "agent_events"))(
    lambda m: sessions.deltas(m.agent_events.select("session", "seq", F.col("tokens").alias("total"))).groupBy("session").agg(F.sum("delta").alias("total"))
)
query("o5_top_files", inner(EDGES + ", " + COCHANGE, """SELECT f.path, sum(n)::BIGINT AS score FROM (SELECT src AS file_id, n FROM edges UNION ALL SELECT dst, n FROM edges UNION ALL SELECT file_a, cnt FROM pairs UNION ALL SELECT file_b, cnt FROM pairs
  UNION ALL SELECT file_id, count(*) FROM symbols GROUP BY 1) JOIN files f USING (file_id) GROUP BY f.path ORDER BY score DESC, path LIMIT 40""", "refs", "symbols", "files", "commit_files"))(
    lambda m: graph.overview(m.files, graph.degrees(lookups.file_ref_edges(m.refs, m.symbols, m.files), lookups.cochange(m.commit_files), m.symbols.groupBy("file_id").agg(F.count("*").alias("n_symbols"))), lookups.file_ref_edges(m.refs, m.symbols, m.files), 40)[0].select("path", "score")
)
query("u5_intersect", "SELECT doc_id FROM documents INTERSECT SELECT vec_id FROM embeddings")(lambda m: m.table("documents").select("doc_id").intersect(m.table("embeddings").select("vec_id")))
query("u4_difference", duck("SELECT file_id FROM files EXCEPT SELECT file_id FROM commit_files WHERE hash % 9 = 0", "files", "commit_files"))(lambda m: m.files.select("file_id").subtract(m.commit_files.where("hash % 9 = 0").select("file_id")))

# Sessions.

PERIODS = """ed AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY session ORDER BY ts, seq) >= 10800 THEN 1 ELSE 0 END AS new FROM agent_events WHERE op = 'edit' AND ok),
nu AS (SELECT *, sum(new) OVER (PARTITION BY session ORDER BY ts, seq)::BIGINT AS period FROM ed),
pe AS (SELECT session, period, min(ts) AS first_edit, max(ts) AS last_edit, count(*) AS edits, count(DISTINCT file_id) AS files FROM nu GROUP BY ALL),
periods AS (SELECT *, lag(last_edit) OVER w AS since, lead(first_edit) OVER w AS until FROM pe WINDOW w AS (PARTITION BY session ORDER BY period))"""
query("w1_periods", inner(PERIODS, "SELECT * FROM periods", "agent_events"))(lambda m: sessions.periods(m.agent_events))
query("w3_tests_after", inner(PERIODS, "SELECT p.session, p.period, count(e.ts) AS tests FROM periods p LEFT JOIN agent_events e ON e.session = p.session AND e.test_run AND e.ts >= p.last_edit AND (p.until IS NULL OR e.ts < p.until) GROUP BY ALL", "agent_events"))(
    lambda m: sessions.tests_after(sessions.periods(m.agent_events), m.agent_events)
)
query("w4_first_edit", inner("f AS (SELECT session, min((ts, seq)) FILTER (op = 'edit' AND ok) AS first FROM agent_events GROUP BY session)", "SELECT e.session, count(*) FILTER (first IS NULL OR (ts, seq) < first) AS events_before, sum(CASE WHEN first IS NULL OR ts <= first[1] THEN tokens ELSE 0 END)::BIGINT AS tokens_until FROM agent_events e JOIN f USING (session) GROUP BY e.session", "agent_events"))(
    lambda m: sessions.first_edit_position(m.agent_events)
)
query("w5_file_edits", inner(PERIODS, "SELECT session, file_id, count(DISTINCT period) AS periods, max(period) AS last_period FROM nu GROUP BY ALL", "agent_events"))(lambda m: sessions.file_edits(m.agent_events, sessions.periods(m.agent_events)))
query("w11_line_ranges", duck("SELECT file_id, min(line) AS first, max(line) AS last FROM (SELECT file_id, line, line - row_number() OVER (PARTITION BY file_id ORDER BY line) AS island FROM (SELECT DISTINCT file_id, line FROM refs)) GROUP BY file_id, island", "refs"))(
    lambda m: m.refs.select("file_id", "line").distinct().withColumn("island", F.col("line") - F.row_number().over(Window.partitionBy("file_id").orderBy("line"))).groupBy("file_id", "island").agg(F.min("line").alias("first"), F.max("line").alias("last")).drop("island")
)
query("t1_event_sessions", "SELECT user_id, count(*) AS sessions FROM (SELECT user_id, CASE WHEN floor(epoch(ts)) - lag(floor(epoch(ts))) OVER (PARTITION BY user_id ORDER BY ts) < 10800 THEN 0 ELSE 1 END AS new FROM events) WHERE new = 1 GROUP BY user_id")(
    lambda m: m.table("events").select("user_id", F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts")).groupBy("user_id", F.session_window("ts", "10799 seconds")).agg(F.count("*").alias("n")).groupBy("user_id").agg(F.count("*").alias("sessions"))
)

# Scalar functions over whole texts.

query("f10_token_estimates", "SELECT doc_id, length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) // 4 + (length(text) - length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g'))) * 2 // 3 + 1 AS tokens FROM documents")(
    lambda m: m.table("documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))
)
query("f1_identifiers", "SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[^A-Za-z0-9_]+'), lambda w: regexp_matches(w, '^[A-Za-z_]'))) AS n FROM documents")(
    lambda m: m.table("documents").select("doc_id", F.size(text.identifiers(F.col("text"))).cast("long").alias("n"))
)
query("f12_dirs", duck("SELECT path, array_to_string(list_slice(string_split(path, '/'), 1, least(2, len(string_split(path, '/')) - 1)), '/') AS dir FROM files", "files"))(lambda m: m.files.select("path", paths.dir_at(F.col("path"), 2).alias("dir")))
GROUP = "CASE WHEN len(string_split(path, '/')) <= 1 THEN '(root)' WHEN len(string_split(path, '/')) > 2 AND split_part(path, '/', 1) IN (" + ", ".join(f"'{c}'" for c in paths.CONTAINERS) + ") THEN split_part(path, '/', 1) || '/' || split_part(path, '/', 2) ELSE split_part(path, '/', 1) END"
query("f13_groups", duck(f"SELECT {GROUP} AS module, count(*) AS n FROM files GROUP BY 1", "files"))(lambda m: m.files.groupBy(paths.group_of(F.col("path")).alias("module")).agg(F.count("*").alias("n")))
query("f29_chunks", "SELECT doc_id, no * 40 + 1 AS start_line, substr(chunk, 1, 1600) AS chunk FROM (SELECT doc_id, no, array_to_string(list_slice(lines, no * 40 + 1, no * 40 + 40), chr(10)) AS chunk FROM (SELECT doc_id, lines, unnest(range((len(lines) + 39) // 40)) AS no FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))) WHERE trim(translate(substr(chunk, 1, 1600), chr(10) || chr(9) || chr(13), '   ')) <> ''")(
    lambda m: retrieval.chunks(m.table("documents").select("doc_id", "text"))
)
query("f30_content_hashes", "SELECT doc_id, substr(sha256(text), 1, 32) AS hash FROM documents")(lambda m: m.table("documents").select("doc_id", F.substring(F.sha2("text", 256), 1, 32).alias("hash")))
PAGE = r"""regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<noscript\b[^>]*>.*?</noscript\s*>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"""
for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    PAGE = f"replace({PAGE}, '{entity}', '{char}')"
query("f43_page_text", rf"SELECT page_id, trim(regexp_replace({PAGE}, '\s+', ' ', 'g')) AS text FROM pages")(
    lambda m: m.table("pages").select("page_id", text.html_text(F.col("html")).alias("text"))
)

# Graph plans.

query("g2_folder_edges", inner(EDGES, "SELECT a.dir AS src_dir, b.dir AS dst_dir, sum(n)::BIGINT AS n FROM edges JOIN (SELECT file_id, array_to_string(list_slice(string_split(path, '/'), 1, least(2, len(string_split(path, '/')) - 1)), '/') AS dir FROM files) a ON a.file_id = src JOIN (SELECT file_id, array_to_string(list_slice(string_split(path, '/'), 1, least(2, len(string_split(path, '/')) - 1)), '/') AS dir FROM files) b ON b.file_id = dst WHERE a.dir <> b.dir GROUP BY ALL", "refs", "symbols", "files"))(
    lambda m: graph.folder_edges(m.files, lookups.file_ref_edges(m.refs, m.symbols, m.files), 2)
)
query("a10_folder_depths", duck("SELECT depth, count(DISTINCT array_to_string(list_slice(string_split(path, '/'), 1, least(depth, len(string_split(path, '/')) - 1)), '/')) AS dirs FROM files, range(1, 9) AS r(depth) GROUP BY depth", "files"))(
    lambda m: graph.folder_counts(m.files).select(F.col("depth").cast("long").alias("depth"), "dirs")
)
IS_TEST = r"(regexp_matches(lower(path), '/tests?/|__tests__|^tests?/|\.test\.|\.spec\.|_test\.|\.tests/|(^|/)test_[^/]*$') OR (strlen(regexp_extract(path, '([^/]+?)(\.[^./]*)?$', 1)) > 4 AND regexp_matches(regexp_extract(path, '([^/]+?)(\.[^./]*)?$', 1), 'Tests?$')))"
query("g8_node_stats", inner(CALLS, f"""SELECT s.symbol_id, CASE WHEN defs <= 3 THEN coalesce(c, 0) END AS callers, CASE WHEN defs <= 3 THEN coalesce(t, 0) END AS test_callers, defs > 1 AS ambiguous, defs > 3 AS common
FROM symbols s JOIN defs ON defs.name = s.name LEFT JOIN (SELECT k.symbol_id, count(*) FILTER (NOT {IS_TEST}) AS c, count(*) FILTER ({IS_TEST}) AS t FROM calls k JOIN symbols x ON x.symbol_id = k.caller_id JOIN files f ON f.file_id = x.file_id GROUP BY 1) n ON n.symbol_id = s.symbol_id""", "symbols", "refs", "files"))(
    lambda m: graph.node_stats(m.symbols, m.files, lookups.callers(m.symbols, m.refs, m.files))
)
query("g13_find", duck("SELECT tier, symbol_id, name, path FROM (SELECT CASE WHEN lower(name) = 'get' THEN 0 WHEN contains(lower(path), 'get') THEN 1 WHEN starts_with(lower(name), 'get') THEN 2 END AS tier, symbol_id, name, path, start_line FROM symbols JOIN files USING (file_id)) WHERE tier IS NOT NULL ORDER BY tier, path, start_line, symbol_id LIMIT 60", "symbols", "files"))(
    lambda m: graph.find(m.symbols, m.files, "get", 60)
)
GROUP_OF = "CASE WHEN NOT contains(path, '/') THEN '(root)' WHEN len(string_split(path, '/')) > 2 AND string_split(path, '/')[1] IN (" + ", ".join(f"'{c}'" for c in paths.CONTAINERS) + ") THEN string_split(path, '/')[1] || '/' || string_split(path, '/')[2] ELSE string_split(path, '/')[1] END"
RISK = "CASE WHEN {0}callers >= 10 OR {0}modules >= 2 OR {0}callers + {0}callers2 >= 25 THEN 'high' WHEN {0}callers >= 3 OR {0}cochanged >= 3 OR ({0}callers > 0 AND tests = 0) OR framework THEN 'medium' ELSE 'low' END"
IMPACT = f"""loc AS (SELECT file_id, path, {FAMILY} AS family, {IS_TEST} AS test, {GROUP_OF} AS module FROM files), defs AS (SELECT name, count(*) AS defs FROM symbols GROUP BY name),
sym AS (SELECT s.*, path, family, test, module, defs FROM symbols s JOIN loc USING (file_id) JOIN defs USING (name)), changes AS (SELECT file_id AS change_id, file_id, path AS own_path, module AS own_module FROM loc),
naming AS (SELECT name, caller_id, r FROM (SELECT u.name, c.symbol_id AS caller_id, row_number() OVER (PARTITION BY u.name ORDER BY c.path, c.start_line, c.name, c.symbol_id) AS r
  FROM (SELECT DISTINCT name, enclosing_symbol_id FROM refs) u JOIN defs ON defs.name = u.name AND defs <= 3 JOIN sym c ON c.symbol_id = u.enclosing_symbol_id) WHERE r <= 60),
calls AS (SELECT t.symbol_id, c.symbol_id AS caller_id, r FROM sym t JOIN naming n ON n.name = t.name AND t.defs <= 3 JOIN sym c ON c.symbol_id = n.caller_id
  WHERE t.family = c.family AND t.symbol_id <> c.symbol_id AND NOT (t.file_id = c.file_id AND t.start_byte <= c.start_byte AND c.end_byte <= t.end_byte)),
hit AS (SELECT change_id, s.* FROM sym s JOIN changes USING (file_id) WHERE start_line <= 31 AND 11 <= end_line),
touched AS (SELECT * FROM hit s WHERE NOT EXISTS (SELECT 1 FROM hit o WHERE o.change_id = s.change_id AND o.symbol_id <> s.symbol_id AND s.start_byte <= o.start_byte AND o.end_byte <= s.end_byte)),
one AS (SELECT change_id, caller_id AS symbol_id, row_number() OVER (PARTITION BY change_id ORDER BY place) AS pos FROM (SELECT change_id, caller_id, min(ROW(start_line, t.symbol_id, r)) AS place FROM touched t JOIN calls USING (symbol_id) GROUP BY ALL) f
  WHERE NOT EXISTS (SELECT 1 FROM touched t WHERE t.change_id = f.change_id AND t.symbol_id = f.caller_id)),
two AS (SELECT change_id, symbol_id FROM (SELECT *, count(*) OVER (PARTITION BY change_id ORDER BY pos RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (
  SELECT o.change_id, caller_id AS symbol_id, min(pos) AS pos FROM one o JOIN calls k ON k.symbol_id = o.symbol_id AND r <= 20
  WHERE NOT EXISTS (SELECT 1 FROM touched t WHERE t.change_id = o.change_id AND t.symbol_id = k.caller_id) AND NOT EXISTS (SELECT 1 FROM one p WHERE p.change_id = o.change_id AND p.symbol_id = k.caller_id) GROUP BY ALL)) WHERE before < 60),
reached AS (SELECT c.*, hop, s.path, s.test, s.module FROM (SELECT change_id, symbol_id, 1 AS hop FROM one UNION ALL SELECT change_id, symbol_id, 2 FROM two) JOIN sym s USING (symbol_id) JOIN changes c USING (change_id)),
told AS (SELECT change_id, count(*) FILTER (hop = 1) AS callers, count(*) FILTER (hop = 2) AS callers2, count(*) FILTER (hop = 1 AND NOT test) AS code_callers, count(*) FILTER (hop = 2 AND NOT test) AS code_callers2,
  count(DISTINCT module) FILTER (module <> own_module) AS modules, count(DISTINCT module) FILTER (module <> own_module AND NOT test) AS code_modules FROM reached GROUP BY change_id),
near AS (SELECT file_a AS change_id, path, test FROM (SELECT file_a, path, test, row_number() OVER (PARTITION BY file_a ORDER BY cnt DESC, path) AS r FROM (SELECT file_a, file_b, cnt FROM pairs UNION ALL SELECT file_b, file_a, cnt FROM pairs) JOIN loc ON file_id = file_b) WHERE r <= 8),
together AS (SELECT change_id, count(*) AS cochanged, count(*) FILTER (NOT test) AS code_cochanged FROM near GROUP BY 1),
named AS (SELECT DISTINCT name, family, path FROM (SELECT r.name, family, path, test, row_number() OVER (PARTITION BY r.name ORDER BY path, line) AS k FROM refs r JOIN loc USING (file_id)) WHERE k <= 200 AND test),
tested AS (SELECT change_id, count(DISTINCT path) AS tests FROM (SELECT change_id, path FROM reached WHERE test AND path <> own_path UNION ALL SELECT change_id, path FROM near WHERE test
  UNION ALL SELECT change_id, n.path FROM touched t JOIN named n ON n.name = t.name AND n.family = t.family WHERE t.defs <= 3) GROUP BY 1),
marks AS (SELECT change_id, count(*) AS touched, count(*) FILTER (defs > 3) AS ambiguous, max(defs) = 1 AS uniq, bool_or(starts_with(signature, '@app.')) AS framework FROM touched GROUP BY 1),
joined AS (SELECT change_id, {", ".join(f"coalesce({c}, 0) AS {c}" for c in ("touched", "ambiguous", "callers", "callers2", "code_callers", "code_callers2", "modules", "code_modules", "cochanged", "code_cochanged", "tests"))},
  coalesce(uniq, false) AS uniq, coalesce(framework, false) AS framework FROM changes LEFT JOIN marks USING (change_id) LEFT JOIN told USING (change_id) LEFT JOIN together USING (change_id) LEFT JOIN tested USING (change_id))"""


@query("g9_impact", inner(f"{COCHANGE}, {IMPACT}", f"""SELECT * EXCLUDE (uniq), uniq AS "unique", {RISK.format("")} AS risk, {RISK.format("code_")} AS code_risk,
  CASE WHEN code_callers >= 10 THEN 'callers' WHEN code_modules >= 2 THEN 'modules' WHEN code_callers + code_callers2 >= 25 THEN 'reach' WHEN code_callers >= 3 THEN 'callers' WHEN code_cochanged >= 3 THEN 'cochanged'
    WHEN code_callers > 0 AND tests = 0 THEN 'untested' WHEN framework THEN 'framework' ELSE '' END AS reason FROM joined""", "symbols", "refs", "files", "commit_files"))
def _(m: Model) -> DataFrame:
    changes = m.files.select(F.col("file_id").alias("change_id"), "file_id", F.lit(11).alias("a"), F.lit(31).alias("z"))
    return graph.impact(m.symbols, m.files, m.refs, lookups.cochange(m.commit_files), changes)


# Retrieval.

WORDS = "regexp_split_to_array(lower(text), '[^a-z0-9_]+')"
BM25 = f"""q AS (SELECT DISTINCT item_id AS query_id, unnest({WORDS}) AS term FROM benchmark), tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({WORDS}) AS term FROM documents) WHERE term <> '' GROUP BY ALL),
ln AS (SELECT doc_id, len(list_filter({WORDS}, lambda w: w <> ''))::DOUBLE AS len FROM documents), tot AS (SELECT count(*) AS n, avg(len) AS al FROM ln), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
scores AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / al))), 6) AS score FROM tf JOIN q USING (term) JOIN df USING (term) JOIN ln USING (doc_id), tot GROUP BY ALL)"""


def _bm25(m: Model) -> list:
    return retrieval.bm25(m.table("documents").select("doc_id", "text"), m.table("benchmark").select(F.col("item_id").alias("query_id"), "text"), "doc_id")


query("r12_bm25_top10", f"WITH {BM25} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scores) WHERE rank <= 10")(
    lambda m: retrieval.bm25_top(_bm25(m), "doc_id", 10).select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))
)
query("r10_above_threshold", f"WITH {BM25} SELECT query_id, count(*) AS kept FROM (SELECT query_id, score, max(score) OVER (PARTITION BY query_id) AS best FROM scores) WHERE score >= 0.12 * best GROUP BY query_id")(lambda m: retrieval.bm25_above(_bm25(m)))
DENSE = "v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), ds AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(v.e, q.e) / (sqrt(list_dot_product(v.e, v.e)) * sqrt(list_dot_product(q.e, q.e))) AS score FROM v, v q WHERE q.vec_id % 100 = 0)"


@query("r15_dense_top20", f"WITH {DENSE} SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM ds) WHERE rank <= 20")
def _(m: Model) -> DataFrame:
    vectors = m.table("embeddings").select("vec_id", "embedding")
    best = retrieval.dense_top(vectors, vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 20)
    return best.select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


query("r16_rank_fusion", f"""WITH {BM25}, a AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scores),
b AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank FROM scores) SELECT query_id, doc_id, round(sum(p), 9) AS score FROM (SELECT query_id, doc_id, 1.0 / (60 + rank) AS p FROM a WHERE rank <= 50 UNION ALL SELECT query_id, doc_id, 1.0 / (60 + rank) FROM b WHERE rank <= 50) GROUP BY ALL""")(
    lambda m: (lambda s: retrieval.reciprocal_rank_fusion("doc_id", retrieval.bm25_top(s, "doc_id", 50), retrieval.bm25_top(s, "doc_id", 50, scored=False)))(_bm25(m)).withColumn("score", F.round("score", 9))
)
query("r19_pack_files", "SELECT query_id, doc_id, used FROM (SELECT lang AS query_id, doc_id, sum((n_chars + 3) // 4) OVER (PARTITION BY lang ORDER BY doc_id)::BIGINT AS used FROM documents) WHERE used <= 8000")(
    lambda m: retrieval.pack_files(m.table("documents").select(F.col("lang").alias("query_id"), "doc_id", F.col("doc_id").alias("rank"), F.ceil(F.col("n_chars") / 4).alias("tokens")), 8000).select("query_id", "doc_id", "used")
)
#: Each file is a question about its own symbols, those first that the most references name.
PACK_BUDGET = 2000
PACK_ITEMS = f"""items AS (SELECT file_id AS query_id, symbol_id AS item_id, file_id, start_byte AS s, end_byte AS e, (end_byte - start_byte + 1) // 4 + 1 AS tokens, length(signature) // 4 + 1 AS sig,
  row_number() OVER (PARTITION BY file_id ORDER BY coalesce(u.n, 0) DESC, start_line, symbol_id) AS rank FROM symbols LEFT JOIN (SELECT name, count(*) AS n FROM refs GROUP BY name) u USING (name)),
fold AS (SELECT query_id, 0::BIGINT AS k, {PACK_BUDGET}::BIGINT AS room, []::STRUCT(rank BIGINT, item_id BIGINT, mode VARCHAR, cost BIGINT, s BIGINT, e BIGINT)[] AS taken FROM items GROUP BY query_id
  UNION ALL SELECT query_id, k, CASE WHEN fits THEN room - cost ELSE room END, CASE WHEN fits THEN list_append(taken, {{'rank': k, 'item_id': item_id, 'mode': CASE WHEN whole THEN 'full' ELSE 'signature' END, 'cost': cost, 's': s, 'e': e}}) ELSE taken END
  FROM (SELECT *, room >= 50 AND NOT inside AND cost <= room AS fits FROM (SELECT *, CASE WHEN whole THEN tokens ELSE sig END + 25 AS cost FROM (
    SELECT f.query_id, i.rank AS k, f.room, f.taken, i.item_id, i.tokens, i.sig, i.s, i.e, len(list_filter(f.taken, lambda t: t.mode = 'full' AND t.s <= i.s AND i.e <= t.e)) > 0 AS inside,
      len(list_filter(f.taken, lambda t: i.s <= t.s AND t.e <= i.e)) = 0 AND i.tokens + 25 <= f.room AND i.tokens + 25 <= {PACK_BUDGET * 35 // 100} AS whole
    FROM fold f JOIN items i ON i.query_id = f.query_id AND i.rank = f.k + 1 WHERE i.rank <= 80)))),
last AS (SELECT query_id, arg_max(taken, k) AS taken FROM fold GROUP BY query_id)"""


@query("r17_pack_budget", inner(PACK_ITEMS, "SELECT query_id, t.rank::INT AS rank, t.item_id AS item_id, t.mode AS mode, t.cost AS cost FROM (SELECT query_id, unnest(taken) AS t FROM last)", "symbols", "refs").replace("WITH ", "WITH RECURSIVE ", 1))
def _(m: Model) -> DataFrame:
    used = m.refs.groupBy("name").agg(F.count("*").alias("uses"))
    order = Window.partitionBy("query_id").orderBy(F.desc("uses"), "start_line", "item_id")
    items = m.symbols.join(used, "name", "left").select(
        F.col("file_id").alias("query_id"), F.col("symbol_id").alias("item_id"), "file_id", F.col("start_byte").cast("long").alias("start"), F.col("end_byte").cast("long").alias("end"), "start_line", F.coalesce("uses", F.lit(0)).alias("uses"),
        (F.floor((F.col("end_byte") - F.col("start_byte") + 1) / 4) + 1).alias("tokens"), text.estimate_tokens(F.col("signature")).alias("signature_tokens"),
    )
    return retrieval.pack(items.withColumn("rank", F.row_number().over(order)), PACK_BUDGET)


query("r20_grep_hits", "SELECT doc_id, (len(string_split(lower(text), 'the')) - 1)::BIGINT AS hits FROM documents WHERE contains(lower(text), 'the')")(
    lambda m: m.table("documents").where(F.lower("text").contains("the")).select("doc_id", (F.size(F.split(F.lower("text"), "the")) - 1).cast("long").alias("hits"))
)
