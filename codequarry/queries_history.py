"""Registered queries of findings verified over history, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.model import Model
from codequarry.operators import verification
from codequarry.queries import inner, query
from codequarry.shared import written
from codequarry.sources import ignores
from codequarry.sources.trees import NOT_CALLED

V = """v AS MATERIALIZED (SELECT file_id, hash, ct, md5(text) AS blob, lead(ct) OVER w AS next_ct, lead(hash) OVER w AS next_hash FROM versions WINDOW w AS (PARTITION BY file_id ORDER BY ct, hash))"""
FACTS = f"""contents AS (SELECT DISTINCT md5(text) AS blob, text FROM versions WHERE text IS NOT NULL), lines AS MATERIALIZED (SELECT blob, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS no FROM contents),
heads AS (SELECT blob, no, regexp_extract(line, '^def ([A-Za-z0-9_]+)', 1) AS name, replace(line, ' ', '') AS head, lead(no, 1, 1000000) OVER (PARTITION BY blob ORDER BY no) AS until FROM lines WHERE line LIKE 'def %'),
held AS (SELECT h.blob, h.name, h.no, h.head, string_agg(replace(l.line, ' ', ''), '' ORDER BY l.no) AS body FROM heads h JOIN lines l ON l.blob = h.blob AND l.no > h.no AND l.no < h.until GROUP BY ALL),
defs AS MATERIALIZED (SELECT blob, name, list(head ORDER BY head) AS heads, list(body ORDER BY body) AS bodies FROM held GROUP BY blob, name),
called AS (SELECT DISTINCT blob, no, line, unnest(regexp_extract_all(line, '([A-Za-z_][A-Za-z0-9_]*) *[(]', 1)) AS name FROM lines),
refs AS MATERIALIZED (SELECT blob, name, min(no) AS line, count(*) AS n, list(replace(line, ' ', '') ORDER BY replace(line, ' ', '')) AS lines FROM called c WHERE name NOT IN ({", ".join(f"'{w}'" for w in NOT_CALLED)})
  AND NOT EXISTS (SELECT 1 FROM heads h WHERE h.blob = c.blob AND h.no = c.no AND h.name = c.name) GROUP BY blob, name)"""
STATES = """landed AS (SELECT f.finding_id, arg_min({'ct': v.ct, 'hash': v.hash, 'blob': v.blob}, (v.ct, v.hash)) AS l FROM findings f JOIN v ON v.file_id = f.changed_file AND v.ct BETWEEN f.last_edit AND f.last_edit + 1209600 GROUP BY f.finding_id),
newest AS (SELECT file_id, arg_max({'blob': blob}, (ct, hash)).blob AS blob FROM v GROUP BY file_id),
s AS MATERIALIZED (SELECT f.*, l IS NOT NULL AS committed, CASE WHEN l IS NULL THEN 4611686018427387904 ELSE l.ct END AS ct, l.hash AS hash, CASE WHEN l IS NULL THEN newest.blob ELSE l.blob END AS changed_blob FROM findings f LEFT JOIN landed USING (finding_id) LEFT JOIN newest ON newest.file_id = f.changed_file)"""
REF_BLOBS = """rb AS (SELECT finding_id, arg_max({'blob': v.blob}, (v.ct, v.hash)).blob AS ref_blob FROM s JOIN v ON v.file_id = s.ref_file AND (v.ct < s.ct OR (v.ct = s.ct AND v.hash <= s.hash)) GROUP BY finding_id)"""
VERIFIED = f"""{V}, {FACTS}, {STATES}, {REF_BLOBS},
bb AS (SELECT finding_id, arg_max({{'blob': v.blob}}, (v.ct, v.hash)).blob AS base_blob FROM s JOIN v ON v.file_id = s.ref_file AND v.ct <= s.first_edit GROUP BY finding_id),
lb AS (SELECT finding_id, arg_max({{'blob': v.blob}}, (v.ct, v.hash)).blob AS later_blob FROM s JOIN v ON committed AND v.file_id = s.ref_file AND (v.ct > s.ct OR (v.ct = s.ct AND v.hash > s.hash)) AND v.ct <= s.ct + 1209600 GROUP BY finding_id),
named AS (SELECT blob, name, max(d) AS d FROM (SELECT blob, name, 1 AS d FROM defs UNION ALL SELECT blob, name, 0 FROM refs) GROUP BY blob, name),
standing AS (SELECT finding_id, count(*) AS files, sum(d) AS defining FROM s JOIN named ON kind = 'dangling' AND name = symbol JOIN v ON v.blob = named.blob AND (v.ct < s.ct OR (v.ct = s.ct AND v.hash <= s.hash)) AND (v.next_ct IS NULL OR v.next_ct > s.ct OR (v.next_ct = s.ct AND v.next_hash > s.hash)) GROUP BY finding_id),
t AS (SELECT s.*, rb.ref_blob, bb.base_blob, lb.later_blob, d1.heads AS heads_then, d2.heads AS renamed_heads, d3.heads AS heads_left, r1.line, r1.n, r1.lines AS lines_then, r2.n AS n_before, d4.heads AS caller_then, d4.bodies AS body_then, d5.heads AS caller_before, d5.bodies AS body_before, r3.lines AS lines_later,
    coalesce(files, 0) AS files, coalesce(defining, 0) AS defining
  FROM s LEFT JOIN rb USING (finding_id) LEFT JOIN bb USING (finding_id) LEFT JOIN lb USING (finding_id) LEFT JOIN standing USING (finding_id) LEFT JOIN defs d1 ON d1.blob = changed_blob AND d1.name = symbol LEFT JOIN defs d2 ON d2.blob = changed_blob AND d2.name = renamed_to
  LEFT JOIN defs d3 ON d3.blob = after AND d3.name = symbol LEFT JOIN refs r1 ON r1.blob = ref_blob AND r1.name = symbol LEFT JOIN refs r2 ON r2.blob = base_blob AND r2.name = symbol LEFT JOIN defs d4 ON d4.blob = ref_blob AND d4.name = caller LEFT JOIN defs d5 ON d5.blob = base_blob AND d5.name = caller
  LEFT JOIN refs r3 ON r3.blob = later_blob AND r3.name = symbol),
verified AS (SELECT finding_id, session, period, kind, CASE WHEN after IS NULL THEN 'unverified'
    WHEN kind = 'dangling' AND NOT CASE WHEN changed_blob IS NULL THEN renamed_to IS NULL ELSE heads_then IS NULL AND (renamed_to IS NULL OR renamed_heads IS NOT NULL) END THEN 'not_landed'
    WHEN kind = 'stale' AND (changed_blob IS NULL OR heads_then IS DISTINCT FROM heads_left) THEN 'not_landed' WHEN n IS NULL THEN 'already_resolved'
    WHEN kind = 'stale' AND base_blob IS NOT NULL AND CASE WHEN caller IS NOT NULL THEN caller_then IS DISTINCT FROM caller_before OR body_then IS DISTINCT FROM body_before ELSE n IS DISTINCT FROM n_before END THEN 'already_resolved'
    WHEN kind = 'dangling' AND files > 300 THEN 'unverified' WHEN kind = 'dangling' AND defining > 0 THEN 'already_resolved' ELSE 'kept' END AS outcome,
    later_blob IS NOT NULL AND lines_then IS DISTINCT FROM coalesce(lines_later, []) AS fixed, line, n, CASE WHEN committed THEN CAST(hash AS VARCHAR) ELSE 'working tree' END AS state FROM t)"""


def _history(m: Model) -> Model:
    """m with its versions as a table, and with its findings from that table: both are read several times."""
    m.versions = written(m.versions, "history")
    return m


def _contents(m: Model) -> tuple[DataFrame, DataFrame]:
    versions = m.versions.select("file_id", "hash", "ct", F.md5("text").alias("blob"))
    return versions, m.versions.where("text is not null").select(F.md5("text").alias("blob"), F.lit("python").alias("lang"), "text")


def _verified(m: Model) -> DataFrame:
    m = _history(m)
    return verification.verify(m.findings, *_contents(m))


@query("h1_verified", inner(VERIFIED, "SELECT finding_id, outcome, outcome = 'kept' AND fixed AS later_fixed, CASE WHEN outcome = 'kept' THEN line END AS line, CASE WHEN outcome = 'kept' THEN n END AS n, CASE WHEN outcome = 'kept' THEN state END AS checked_at FROM verified", "versions", "findings"))
def _(m: Model):
    return _verified(m)


@query("h2_landings", inner(f"{V}, {STATES}", "SELECT finding_id AS key, ct, hash, changed_blob AS blob, committed FROM s", "versions", "findings"))
def _(m: Model):
    m = _history(m)
    edits = m.findings.select(F.col("finding_id").alias("key"), F.col("changed_file").alias("file_id"), "last_edit")
    return verification.landings(written(edits, "edits"), _contents(m)[0])


@query("h3_periods", inner(VERIFIED, """SELECT session, period, count(*) AS raw, count(*) FILTER (WHERE outcome = 'not_landed') AS not_landed, count(*) FILTER (WHERE outcome = 'already_resolved') AS already_resolved, count(*) FILTER (WHERE outcome = 'unverified') AS unverified, count(*) FILTER (WHERE outcome = 'kept') AS kept,
count(*) FILTER (WHERE outcome = 'kept' AND kind = 'dangling') AS dangling, count(*) FILTER (WHERE outcome = 'kept' AND kind = 'dangling' AND fixed) AS dangling_later_fixed, count(*) FILTER (WHERE outcome = 'kept' AND kind = 'stale') AS stale, count(*) FILTER (WHERE outcome = 'kept' AND kind = 'stale' AND fixed) AS stale_later_fixed FROM verified GROUP BY session, period""", "versions", "findings"))  # fmt: skip
def _(m: Model):
    return verification.roll_up(_verified(m), m.findings)


@query("s10_blobs_at", inner(f"{V}, {STATES}, {REF_BLOBS}", "SELECT finding_id AS key, ref_blob AS blob FROM rb WHERE ref_blob IS NOT NULL", "versions", "findings"))
def _(m: Model):
    m = _history(m)
    versions, contents = _contents(m)
    edits = m.findings.select(F.col("finding_id").alias("key"), F.col("changed_file").alias("file_id"), "last_edit", "ref_file")
    # only when a change landed is asked for, so no blob is carried to that
    states = verification.landings(written(edits, "edits"), versions.withColumn("blob", F.lit(None).cast("string")), verification.WINDOW, "ref_file")
    wanted = written(states.select("key", F.col("ref_file").alias("file_id"), "ct", "hash"), "wanted")
    return verification.blobs_at(wanted, versions, contents, None)


IGNORE = {"": "# generated\n*.c\n!src/**/*.c\n/docs/\nsub[1-3]/\n!sub2/\n**/web/p?ges/green*\n", "src/api": "red_*\n!red_*.py\n", "lib": "/sub*\n"}
#: The same rules as expressions: folder, place, negated, folders only, expression.
RULES = r"""rules(folder, no, neg, only_dirs, re) AS (VALUES ('', 1, false, false, '^(.*/)?[^/]*[.]c$'), ('', 2, true, false, '^src/(.*/)?[^/]*[.]c$'), ('', 3, false, true, '^docs$'), ('', 4, false, true, '^(.*/)?sub[1-3]$'), ('', 5, true, true, '^(.*/)?sub2$'), ('', 6, false, false, '^(.*/)?web/p[^/]ges/green[^/]*$'),
  ('src/api', 0, false, false, '^(.*/)?red_[^/]*$'), ('src/api', 1, true, false, '^(.*/)?red_[^/]*[.]py$'), ('lib', 0, false, false, '^sub[^/]*$')),
s AS (SELECT path, string_split(path, '/') AS p, unnest(range(1, len(string_split(path, '/')) + 1)) AS i FROM files), nodes AS (SELECT path, array_to_string(p[:i], '/') AS node, i < len(p) AS dir FROM s),
d AS (SELECT DISTINCT node, dir FROM nodes), hits AS (SELECT node, dir, neg, folder, no FROM d JOIN rules ON (folder = '' OR starts_with(node, folder || '/')) AND (dir OR NOT only_dirs) AND regexp_matches(CASE WHEN folder = '' THEN node ELSE substr(node, length(folder) + 2) END, re)),
shut AS (SELECT node, dir FROM hits GROUP BY node, dir HAVING NOT arg_max(neg, (length(folder), no)))"""


@query("s1_ignored", inner(RULES, "SELECT DISTINCT path FROM nodes JOIN shut USING (node, dir)", "files"))
def _(m: Model):
    return ignores.ignored(m.files, ignores.rules(m.spark.createDataFrame(list(IGNORE.items()), "folder string, text string")))
