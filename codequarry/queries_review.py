"""Registered queries of matching, ordered operators, change check and history, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from codequarry.functions import text
from codequarry.model import Model, duck
from codequarry.operators import copies, lookups, matching, ordered
from codequarry.queries import inner, query

MENTIONS = "mentions AS (SELECT DISTINCT array_to_string(string_split(path, '/')[-2:], '/') AS mention FROM files)"


@query("j17_path_suffixes", inner(MENTIONS, "SELECT mention, min(path) AS path FROM mentions JOIN files ON path = mention OR ends_with(path, '/' || mention) GROUP BY mention", "files"))
def _(m: Model):
    parts = F.split("path", "/")
    return matching.by_suffix(m.files.select(F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), "/").alias("mention")), m.files)


@query("j21_answers", duck("SELECT c.seq AS call_id, c.session, (SELECT arg_min(r.ok, r.seq) FROM agent_events r WHERE r.seq - 1 = c.seq AND r.op = 'shell') AS ok FROM agent_events c WHERE c.op = 'edit'", "agent_events"))
def _(m: Model):
    e = m.agent_events
    return matching.answered(e.where("op = 'edit'").select(F.col("seq").alias("call_id"), "session"), e.where("op = 'shell'").select((F.col("seq") - 1).alias("call_id"), "seq", "ok"))


@query("j22_prices", "WITH p AS (SELECT * FROM (VALUES ('click', 3.0, 15.0), ('view', 1.0, 5.0)) AS t(model, price_in, price_out)) SELECT count(price_in) AS priced, count(*) - count(price_in) AS unpriced, round(sum((event_id * price_in + user_id * price_out) / 1e6), 6) AS dollars FROM events LEFT JOIN p ON model = event_type")
def _(m: Model):
    prices = m.spark.sql("SELECT * FROM VALUES ('click', 3.0D, 15.0D), ('view', 1.0D, 5.0D) AS t(model, price_in, price_out)")
    usage = m.table("events").select(F.col("event_type").alias("model"), F.col("event_id").alias("input"), F.col("user_id").alias("output"))
    return matching.priced(usage, prices).withColumn("dollars", F.round("dollars", 6))


@query("j26_changed_since", inner("a AS (SELECT path, CASE WHEN file_id % 4 = 0 THEN NULL ELSE hash END AS hash FROM files), b AS (SELECT path, CASE WHEN file_id % 6 = 0 THEN NULL ELSE hash END AS hash FROM files WHERE file_id % 5 <> 0)", "SELECT a.path FROM a LEFT JOIN b ON a.path = b.path WHERE a.hash IS DISTINCT FROM b.hash", "files"))
def _(m: Model):
    hashed = lambda k: F.when(F.col("file_id") % k != 0, F.col("hash")).alias("hash")
    return matching.changed_since(m.files.select("path", hashed(4)), m.files.where("file_id % 5 <> 0").select("path", hashed(6)))


#: Symbols before and after: some removed, some with another signature, kind or body, some renamed.
OLD = "olds AS (SELECT symbol_id, file_id, name, kind, signature, 'body of ' || CAST(symbol_id AS VARCHAR) || ' with enough characters' AS body FROM symbols)"
NEW = """news AS (SELECT symbol_id + 1000000 AS symbol_id, file_id, CASE WHEN symbol_id % 11 = 0 THEN 'renamed' || CAST(symbol_id AS VARCHAR) ELSE name END AS name, kind,
  CASE WHEN symbol_id % 7 = 0 THEN 'def run(a, b, c)' ELSE signature END AS signature, CASE WHEN symbol_id % 5 = 0 THEN 'rewritten' ELSE body END AS body FROM olds WHERE symbol_id % 13 <> 0)"""


def _old(m: Model):
    return m.symbols.select("symbol_id", "file_id", "name", "kind", "signature", F.concat(F.lit("body of "), F.col("symbol_id").cast("string"), F.lit(" with enough characters")).alias("body"))


def _new(m: Model):
    i = F.col("symbol_id")
    return _old(m).where("symbol_id % 13 <> 0").select((i + 1000000).alias("symbol_id"), "file_id", F.when(i % 11 == 0, F.concat(F.lit("renamed"), i.cast("string"))).otherwise(F.col("name")).alias("name"), "kind",
        F.when(i % 7 == 0, "def run(a, b, c)").otherwise(F.col("signature")).alias("signature"), F.when(i % 5 == 0, "rewritten").otherwise(F.col("body")).alias("body"))


def _pass(no: int, *names: str) -> str:
    keys = ", ".join(("file_id", *names))
    done = "".join(f" AND symbol_id NOT IN (SELECT {{side}}_id FROM m{k})" for k in range(1, no))
    side = lambda t, s: f"(SELECT {keys}, symbol_id AS {s}_id, row_number() OVER (PARTITION BY {keys} ORDER BY symbol_id) AS place FROM {t} WHERE true{done.format(side=s)})"
    return f"m{no} AS MATERIALIZED (SELECT old_id, new_id, {no} AS step FROM {side('olds', 'old')} a JOIN {side('news', 'new')} b USING ({keys}, place))"


VERSIONS = ", ".join((OLD, NEW, _pass(1, "name", "signature", "body"), _pass(2, "name", "signature"), _pass(3, "name", "kind"), _pass(4, "name"), "met AS (SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3 UNION ALL SELECT * FROM m4)"))


@query("j24_versions", inner(VERSIONS, "SELECT old_id, new_id, step FROM met", "symbols"))
def _(m: Model):
    return matching.versions(_old(m), _new(m))


CHANGES = VERSIONS + """, changes AS (SELECT o.symbol_id, o.name, CASE WHEN n.symbol_id IS NULL THEN 'removed' WHEN o.signature <> n.signature THEN 'signature' WHEN o.body <> n.body THEN 'body' END AS change
  FROM olds o LEFT JOIN met ON old_id = o.symbol_id LEFT JOIN news n ON n.symbol_id = new_id)"""


@query("d1_symbol_changes", inner(CHANGES, "SELECT symbol_id, change FROM changes WHERE change IS NOT NULL", "symbols"))
def _(m: Model):
    return matching.symbol_changes(_old(m), _new(m))


@query("d7_change_counts", inner(CHANGES, "SELECT change, count(*) AS n FROM changes WHERE change IS NOT NULL GROUP BY change", "symbols"))
def _(m: Model):
    return matching.symbol_changes(_old(m), _new(m)).groupBy("change").agg(F.count("*").alias("n"))


@query("d2_renames", inner(VERSIONS, "SELECT o.symbol_id AS old_id, min(n.symbol_id) AS new_id FROM olds o JOIN news n USING (file_id, kind, body) WHERE length(body) >= 24 AND o.symbol_id NOT IN (SELECT old_id FROM met) AND n.symbol_id NOT IN (SELECT new_id FROM met) GROUP BY 1", "symbols"))
def _(m: Model):
    return matching.renames(_old(m), _new(m))


@query("d6_left_behind", inner(CHANGES, """, c AS (SELECT DISTINCT name, change FROM changes WHERE change IN ('removed', 'signature')), defs AS (SELECT name, count(*) AS defs FROM news GROUP BY name)
SELECT * FROM (SELECT name, change, file_id, min(line) AS line, count(*) AS n FROM c LEFT JOIN defs USING (name) JOIN refs USING (name) WHERE coalesce(defs, 0) <= 5 AND NOT (change = 'removed' AND coalesce(defs, 0) > 0)
GROUP BY ALL) ORDER BY change = 'signature', name, file_id LIMIT 20""", "symbols", "refs").replace(") , c AS", "), c AS"))
def _(m: Model):
    names = matching.symbol_changes(_old(m), _new(m)).where("change in ('removed', 'signature')").join(_old(m).select("symbol_id", "name"), "symbol_id").select("name", "change").distinct()
    return matching.left_behind(names, m.refs, _new(m))


@query("w6_carried", inner("v AS (SELECT session, seq, CASE WHEN op = 'edit' THEN file_id END AS value FROM agent_events), c AS (SELECT *, last_value(value IGNORE NULLS) OVER w AS latest, max(CASE WHEN value IS NOT NULL THEN seq END) OVER w AS at_seq FROM v WINDOW w AS (PARTITION BY session ORDER BY seq))", "SELECT session, seq, value, latest, count(*) FILTER (value IS NULL) OVER (PARTITION BY session, at_seq ORDER BY seq) AS pending FROM c", "agent_events"))
def _(m: Model):
    return ordered.carried(m.agent_events.select("session", "seq", F.when(F.col("op") == "edit", F.col("file_id")).alias("value")), "session")


@query("w9_first_files", duck("SELECT session, file_id, row_number() OVER (PARTITION BY session ORDER BY seq, file_id) AS place FROM (SELECT session, file_id, min(seq) AS seq FROM agent_events GROUP BY ALL)", "agent_events"))
def _(m: Model):
    return ordered.first_of_each(m.agent_events.select("session", "file_id", "seq"), "session", "file_id", "seq").select("session", "file_id", F.col("place").cast("long").alias("place"))


@query("w10_snippets", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents), h AS (SELECT doc_id, pos FROM l WHERE contains(lower(line), 'license')),
k AS (SELECT DISTINCT l.doc_id, l.pos FROM l JOIN h ON h.doc_id = l.doc_id AND l.pos BETWEEN h.pos - 3 AND h.pos + 3) SELECT doc_id, min(pos) AS first, max(pos) AS last FROM (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM k) GROUP BY doc_id, island""")
def _(m: Model):
    docs = m.table("documents").where(F.lower("text").contains("license"))
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return ordered.snippets(lines, F.lower("line").contains("license"), 3).select("doc_id", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))


@query("j20_last_commit_within", inner("e AS (SELECT seq AS key, file_id, ts - 800000000 + (seq * 7919) % 100000000 AS ts FROM agent_events WHERE op = 'edit')", "SELECT key, arg_max(c.hash, (c.ct, c.hash)) AS hash FROM e JOIN (SELECT DISTINCT * FROM commit_files) f USING (file_id) JOIN commits c ON c.hash = f.hash WHERE c.ct > e.ts AND c.ct <= e.ts + 1209600 GROUP BY key", "agent_events", "commits", "commit_files"))
def _(m: Model):
    edits = m.agent_events.where("op = 'edit'").select(F.col("seq").alias("key"), "file_id", (F.col("ts") - 800000000 + (F.col("seq") * 7919) % 100000000).alias("ts"))
    return lookups.last_commit_within(edits, m.commits, m.commit_files, 14 * 86400)


@query("o12_newest", duck("SELECT session, seq FROM (SELECT session, seq, row_number() OVER (PARTITION BY session ORDER BY ts DESC, seq DESC) AS r FROM agent_events) WHERE r <= 5", "agent_events"))
def _(m: Model):
    return ordered.keep_newest(m.agent_events, "session", 5, "ts", "seq").select("session", "seq")


@query("a17_merged_findings", duck("SELECT file_id AS key, count(DISTINCT session) AS sessions, max(ok) AS later_fixed, min(session) AS first_session FROM agent_events WHERE op = 'edit' GROUP BY file_id", "agent_events"))
def _(m: Model):
    return ordered.merged_findings(m.agent_events.where("op = 'edit'").select(F.col("file_id").alias("key"), "session", F.col("ok").alias("later_fixed")))


@query("o2_limit_before_filter", inner("c AS (SELECT DISTINCT s.symbol_id, c.symbol_id AS caller_id, c.file_id, c.start_line, s.file_id AS own FROM symbols s JOIN refs r ON r.name = s.name JOIN symbols c ON c.symbol_id = r.enclosing_symbol_id)", "SELECT symbol_id, caller_id FROM (SELECT symbol_id, caller_id, own, c.file_id, row_number() OVER (PARTITION BY symbol_id ORDER BY path, start_line, caller_id) AS r FROM c JOIN files f ON f.file_id = c.file_id) WHERE r <= 3 AND own <> file_id", "symbols", "refs", "files"))
def _(m: Model):
    s = m.symbols.select("symbol_id", "name", F.col("file_id").alias("own"))
    used = m.refs.select("name", F.col("enclosing_symbol_id").alias("caller_id")).distinct()
    callers = used.join(m.symbols.select(F.col("symbol_id").alias("caller_id"), "file_id", "start_line"), "caller_id")
    return ordered.limited_by_name(s, callers, m.files, F.col("own") != F.col("file_id"), 3, m.table("lineitem").count())


@query("a16_session_bounds", duck("SELECT session, min(ts) AS first_ts, max(ts) AS last_ts FROM agent_events GROUP BY session", "agent_events"))
def _(m: Model):
    return m.agent_events.groupBy("session").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("a19_first_references", duck("SELECT name, file_id, min(line) AS line, count(*) AS n FROM refs GROUP BY ALL", "refs"))
def _(m: Model):
    return m.refs.groupBy("name", "file_id").agg(F.min("line").alias("line"), F.count("*").alias("n"))


@query("a12_folder_twins", inner("d AS (SELECT path, hash, mtime, regexp_replace(path, '/[^/]*$', '') AS dir FROM files), t AS (SELECT a.dir AS dir_a, b.dir AS dir_b, count(*) AS n FROM d a JOIN d b ON a.hash = b.hash AND a.dir < b.dir GROUP BY ALL), x AS (SELECT dir, max(mtime) AS newest FROM d GROUP BY dir)", "SELECT dir_a, dir_b, n, p.newest AS newest_a, q.newest AS newest_b FROM t JOIN x p ON p.dir = dir_a JOIN x q ON q.dir = dir_b", "files"))
def _(m: Model):
    d = m.files.select("hash", "mtime", F.regexp_replace("path", "/[^/]*$", "").alias("dir"))
    per = d.groupBy("hash", "dir").agg(F.count("*").alias("c"))
    twins = per.select("hash", F.col("dir").alias("dir_a"), F.col("c").alias("a")).join(per.select("hash", F.col("dir").alias("dir_b"), F.col("c").alias("b")), "hash").where("dir_a < dir_b").groupBy("dir_a", "dir_b").agg(F.sum(F.expr("a * b")).alias("n"))
    newest = d.groupBy("dir").agg(F.max("mtime").alias("newest"))
    named = lambda x: newest.select(F.col("dir").alias(f"dir_{x}"), F.col("newest").alias(f"newest_{x}"))
    return twins.join(named("a"), "dir_a").join(named("b"), "dir_b").select("dir_a", "dir_b", "n", "newest_a", "newest_b")


#: Every file below each of its folders, in four copies of the tree of which one has other files and one too few.
BELOW = """s AS (SELECT string_split(path, '/') AS p, hash, mtime, unnest(range(1, len(string_split(path, '/')))) AS i FROM copied), b AS (SELECT array_to_string(p[:i - 1], '/') AS parent, array_to_string(p[:i], '/') AS dir, array_to_string(p[i + 1:], '/') AS place, hash, mtime FROM s)"""
COPIES = BELOW + """, z AS (SELECT dir, count(*) AS n, max(mtime) AS newest FROM b GROUP BY dir), e AS (SELECT x.dir AS dir_a, y.dir AS dir_b, count(*) AS same FROM b x JOIN b y ON x.parent = y.parent AND x.place = y.place AND x.hash = y.hash AND x.dir < y.dir GROUP BY ALL),
copies AS (SELECT dir_a, dir_b, same, CASE WHEN x.newest + 86400 < y.newest THEN dir_a WHEN y.newest + 86400 < x.newest THEN dir_b END AS stale FROM e JOIN z x ON x.dir = dir_a JOIN z y ON y.dir = dir_b WHERE same >= 20 AND 2 * same >= least(x.n, y.n))"""


@query("j16_wildcard_pairs", inner(BELOW, "SELECT x.dir AS dir_a, y.dir AS dir_b, count(*) AS n FROM b x JOIN b y ON x.parent = y.parent AND x.place = y.place AND x.dir < y.dir GROUP BY ALL", "copied"))
def _(m: Model):
    return lookups.wildcard_pairs(m.copied)


@query("j16_folder_copies", inner(COPIES, "SELECT * FROM copies", "copied"))
def _(m: Model):
    return copies.folder_copies(m.copied)


@query("r9_demoted_copies", inner(COPIES + """, c AS (SELECT file_id % 50 AS query_id, path, CAST(file_id % 97 + k AS DOUBLE) AS score FROM copied WHERE (file_id + k) % 3 <> 0), pr AS (SELECT stale, CASE WHEN stale = dir_a THEN dir_b ELSE dir_a END AS fresh, dir_a, dir_b FROM copies WHERE stale IS NOT NULL),
o AS (SELECT c.*, pr.*, pr.fresh || substr(c.path, length(stale) + 1) AS twin FROM c JOIN pr ON starts_with(c.path, stale || '/')), enough AS (SELECT o.query_id, o.dir_a, o.dir_b FROM o JOIN c ON c.query_id = o.query_id AND c.path = o.twin GROUP BY ALL HAVING count(*) >= 2),
m AS (SELECT o.query_id, o.path, arg_min({'twin': twin, 'same': f.hash = g.hash}, (o.dir_a, o.dir_b)) AS t FROM o JOIN enough USING (query_id, dir_a, dir_b) JOIN copied f ON f.path = o.path JOIN copied g ON g.path = twin GROUP BY ALL)""",
    "SELECT query_id, CASE WHEN t.same THEN t.twin ELSE path END AS path, round(max(CASE WHEN NOT t.same THEN score * 0.3 ELSE score END), 6) AS score FROM c LEFT JOIN m USING (query_id, path) GROUP BY ALL", "copied"))
def _(m: Model):
    scores = m.copied.where("(file_id + k) % 3 <> 0").select((F.col("file_id") % 50).alias("query_id"), "path", (F.col("file_id") % 97 + F.col("k")).cast("double").alias("score"))
    return copies.demote_copies(scores, m.copied, copies.folder_copies(m.copied)).withColumn("score", F.round("score", 6))


@query("f22_risks", inner("t AS (SELECT file_id, file_id % 13 AS callers, file_id % 29 AS callers2, file_id % 3 AS modules, file_id % 5 AS cochanged, file_id % 2 = 0 AS untested, file_id % 7 = 0 AS framework FROM files)", """SELECT file_id, CASE WHEN callers >= 10 OR modules >= 2 OR callers + callers2 >= 25 THEN 'high' WHEN callers >= 3 OR cochanged >= 3 OR (callers > 0 AND untested) OR framework THEN 'medium' ELSE 'low' END AS level,
  CASE WHEN callers >= 10 THEN 'callers' WHEN modules >= 2 THEN 'modules' WHEN callers + callers2 >= 25 THEN 'reach' WHEN callers >= 3 THEN 'callers' WHEN cochanged >= 3 THEN 'cochanged' WHEN callers > 0 AND untested THEN 'untested' WHEN framework THEN 'framework' ELSE '' END AS reason FROM t""", "files"))
def _(m: Model):
    i = F.col("file_id")
    told = text.risk(i % 13, i % 29, i % 3, i % 5, i % 2 == 0, i % 7 == 0)
    return m.files.select("file_id", told["level"].alias("level"), told["reason"].alias("reason"))
