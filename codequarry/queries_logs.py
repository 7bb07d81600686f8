"""Registered queries of agent logs and patch texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from codequarry.functions import patches
from codequarry.model import Model
from codequarry.queries import inner, query
from codequarry.sources import rollouts

LINES = """p AS (SELECT DISTINCT md5(text) AS patch_id, text FROM patch_texts), l AS (SELECT patch_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS no FROM p),
h AS (SELECT *, count(*) FILTER (WHERE regexp_matches(line, '^[*]{3} (Add|Update|Delete) File: ')) OVER (PARTITION BY patch_id ORDER BY no) AS pos FROM l),
o AS (SELECT patch_id, pos, lower(max(regexp_extract(line, '^[*]{3} (Add|Update|Delete) File: ', 1))) AS kind, trim(max(CASE WHEN regexp_matches(line, '^[*]{3} (Add|Update|Delete) File: ') THEN regexp_replace(line, '^[*]{3} [A-Za-z]+ File: ', '') END)) AS path,
  max(CASE WHEN line LIKE '*** Move to: %' THEN trim(substr(line, 14)) END) AS moved, coalesce(string_agg(CASE WHEN line LIKE '+%' THEN substr(line, 2) || chr(10) END, '' ORDER BY no), '') AS added,
  count(*) FILTER (WHERE line LIKE '@@%') AS marks, min(CASE WHEN line LIKE '@@%' THEN no END) AS first_mark, min(CASE WHEN line NOT LIKE '*** %' AND line <> '' THEN no END) AS first_line, count(*) FILTER (WHERE line <> '' AND line NOT LIKE '*** %' AND line NOT LIKE '@@%') AS body FROM h WHERE pos > 0 GROUP BY ALL)"""


@query("f39_patches", inner(LINES, """SELECT patch_id, CAST(pos - 1 AS INT) AS pos, CASE WHEN kind = 'update' AND moved IS NOT NULL THEN 'move' ELSE kind END AS op, path, CASE WHEN kind = 'update' THEN moved END AS "to", CASE WHEN kind = 'add' THEN added END AS content,
CASE WHEN kind = 'update' AND moved IS NULL THEN CAST(marks + CASE WHEN first_line < first_mark THEN 1 ELSE 0 END AS INT) END AS hunks, CASE WHEN kind = 'update' AND moved IS NULL THEN CAST(body AS INT) END AS lines FROM o""", "patch_texts"))  # fmt: skip
def _(m: Model):
    texts = m.patch_texts.select(F.md5("text").alias("patch_id"), "text").distinct()
    told = texts.select("patch_id", F.posexplode(patches.patch_operations(F.col("text"))).alias("pos", "o"))
    lines = F.aggregate("o.hunks", F.lit(0), lambda acc, h: acc + F.size(h["lines"]))
    return told.select("patch_id", "pos", "o.op", "o.path", "o.to", "o.content", F.when(F.col("o.hunks").isNotNull(), F.size("o.hunks")).alias("hunks"), lines.alias("lines"))


AROUND = """e AS (SELECT 's' || CAST(user_id AS VARCHAR) AS session, event_id AS line_no, event_type AS kind, last_value(CASE WHEN event_type NOT IN ('click', 'view', 'purchase') AND event_id % 2 = 0 THEN '/work/r' || CAST(event_id % 3 AS VARCHAR) END IGNORE NULLS) OVER w AS cwd,
  last_value(CASE WHEN event_type NOT IN ('click', 'view', 'purchase') AND event_id % 2 = 0 THEN 'm-' || CAST(event_id % 4 AS VARCHAR) END IGNORE NULLS) OVER w AS model FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"""


@query("s13_rollout_edits", inner(AROUND, """SELECT session, line_no, CAST(epoch(TIMESTAMP '2026-01-01 00:00:00') AS BIGINT) + line_no % 60 AS ts, CASE WHEN cwd IS NULL THEN '' ELSE cwd || '/' END || 'f' || CAST(line_no % 40 AS VARCHAR) || '.py' AS path, line_no % 5 <> 0 AS ok,
CASE WHEN line_no % 5 <> 0 THEN CASE line_no % 3 WHEN 0 THEN 'x' || CAST(line_no AS VARCHAR) WHEN 1 THEN '' END END AS after, CASE WHEN line_no % 5 <> 0 AND line_no % 3 = 2 THEN [CAST(line_no % 9 + 1 AS INT), 20] END AS starts FROM e WHERE kind = 'click'""", "log_lines"))  # fmt: skip
def _(m: Model):
    told = rollouts.edits(rollouts.entries(m.log_lines))
    return told.select("session", "line_no", "ts", "path", "ok", "after", F.transform("hunks", lambda h: h["old_start"]).alias("starts"))


@query("s13_rollout_usage", inner(AROUND + """, n AS (SELECT session, line_no, model, line_no % 1000 * 2 AS i, line_no % 777 AS o, line_no % 1000 AS c, lag(line_no) OVER (PARTITION BY session ORDER BY line_no) AS earlier FROM e WHERE kind = 'view')""", """SELECT session, line_no, model,
CAST(greatest(i - coalesce(earlier % 1000 * 2, 0), 0) AS BIGINT) AS input, CAST(greatest(o - coalesce(earlier % 777, 0), 0) AS BIGINT) AS output, CAST(greatest(c - coalesce(earlier % 1000, 0), 0) AS BIGINT) AS cache_read FROM n""", "log_lines"))  # fmt: skip
def _(m: Model):
    return rollouts.usage(rollouts.entries(m.log_lines)).select("session", "line_no", "model", "input", "output", "cache_read")


@query("s13_rollout_shell", inner(AROUND, "SELECT session, line_no, CASE WHEN line_no % 2 = 0 THEN 'pytest -q' ELSE 'ls -q' END AS command, cwd AS dir, line_no % 2 = 0 AS test_run FROM e WHERE kind = 'purchase'", "log_lines"))
def _(m: Model):
    return rollouts.shell_events(rollouts.entries(m.log_lines)).select("session", "line_no", "command", "dir", "test_run")


@query("h7_format_warnings", inner(AROUND, """SELECT session, parsed, unknown, 0 AS too_long, parsed < unknown AS warn FROM (SELECT session, count(*) FILTER (WHERE kind IN ('click', 'view', 'purchase') OR line_no % 2 = 0) AS parsed, count(*) FILTER (WHERE NOT (kind IN ('click', 'view', 'purchase') OR line_no % 2 = 0)) AS unknown FROM e GROUP BY session)""", "log_lines"))
def _(m: Model):
    return rollouts.counts(m.log_lines)
