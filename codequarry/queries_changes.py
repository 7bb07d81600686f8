"""Registered queries of changed signatures and names, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.functions import signatures, text
from codequarry.model import Model
from codequarry.operators import changes, findings
from codequarry.queries import inner, query
from codequarry.shared import large, written

#: The rules on the texts themselves, which have no comments, strings or nested brackets but one level of generics.
PARAMS = r"""h AS MATERIALIZED (SELECT *, regexp_extract(text, '[(](.*)[)]', 1) AS inside, CASE WHEN lang = 'python' THEN split_part(text, ':' || chr(10), 1) ELSE split_part(text, ' {', 1) END AS head FROM heads),
listed AS (SELECT id, side, lang, unnest(regexp_extract_all(inside, '[^,<]+(?:<[^>]*>)?[^,<]*')) AS p, unnest(range(1, len(regexp_extract_all(inside, '[^,<]+(?:<[^>]*>)?[^,<]*')) + 1)) AS i FROM h),
parts AS (SELECT id, side, lang, i, nullif(trim(regexp_extract(p, '=(.*)$', 1)), '') AS def, trim(regexp_replace(p, '=.*$', '')) AS decl FROM listed),
params AS MATERIALIZED (SELECT *, CASE lang WHEN 'python' THEN trim(split_part(decl, ':', 1)) WHEN 'java' THEN trim(regexp_replace(decl, ' [a-z]$', '')) ELSE CASE WHEN decl LIKE '%?:%' THEN '?' ELSE '' END || ':' || replace(trim(regexp_replace(decl, '^[^:]*:', '')), ' ', '') END AS shape FROM parts),
worn AS (SELECT *, replace(replace(replace(shape, 'Integer', 'int'), 'Long', 'long'), ' ', '') AS plain, def IS NOT NULL OR shape LIKE '?%' OR shape LIKE '%...%' AS optional FROM params),
apart AS (SELECT o.id FROM worn o LEFT JOIN worn n ON n.id = o.id AND n.side = 1 AND n.i = o.i WHERE o.side = 0 AND (n.id IS NULL OR (o.def IS NOT NULL AND o.def IS DISTINCT FROM n.def) OR NOT CASE o.lang WHEN 'java' THEN o.plain = n.plain WHEN 'kotlin' THEN n.shape IN (o.shape, o.shape || '?')
  WHEN 'typescript' THEN n.shape = o.shape OR (replace(n.shape, '?', '') = replace(o.shape, '?', '') AND n.shape LIKE '?%') OR len(list_filter(string_split(ltrim(o.shape, '?:'), '|'), lambda m: NOT list_contains(string_split(ltrim(n.shape, '?:'), '|'), m))) = 0 AND left(n.shape, 1) = left(o.shape, 1) ELSE o.shape = n.shape END)
  UNION SELECT n.id FROM worn n WHERE n.side = 1 AND NOT n.optional AND n.i > (SELECT count(*) FROM worn o WHERE o.id = n.id AND o.side = 0)),
told AS (SELECT id, side, CASE WHEN lang = 'java' THEN replace(split_part(head, ' ', 2), 'Integer', 'int') WHEN lang = 'python' THEN trim(split_part(head, '->', 2)) ELSE trim(regexp_extract(head, '[)](.*)$', 1)) END AS ret, CASE WHEN lang = 'java' THEN split_part(head, ' ', 2) ELSE '' END AS front FROM h),
works AS (SELECT o.id, o.lang, a.ret = b.ret AND o.id NOT IN (SELECT id FROM apart) AS works FROM h o JOIN told a ON a.id = o.id AND a.side = 0 JOIN told b ON b.id = o.id AND b.side = 1 WHERE o.side = 0)"""
RENAMES = r"""z AS MATERIALIZED (SELECT h.id, h.side, file_id, kind, name, replace(trim(regexp_replace(regexp_replace(head, ' *([^A-Za-z0-9_ ]) *', '\1', 'g'), ' +', ' ', 'g')), name, '') AS header,
  front || '|' || (SELECT string_agg(shape || '=' || coalesce(def, ''), ',' ORDER BY i) FROM params p WHERE p.id = h.id AND p.side = h.side) || '|' || ret || CASE WHEN lang IN ('kotlin', 'typescript') THEN lang ELSE '' END AS call FROM h JOIN told t ON t.id = h.id AND t.side = h.side WHERE h.id % 5 = 0),
g AS (SELECT id, side, file_id, kind, gram, count(*) AS c FROM (SELECT id, side, file_id, kind, header, unnest([substr(header, CAST(i AS INT), 2) for i in range(1, length(header))]) AS gram FROM z WHERE strlen(header) >= 16) GROUP BY ALL),
sized AS (SELECT id, side, sum(c) AS n FROM g GROUP BY id, side), met AS (SELECT a.id AS old_id, b.id AS new_id, sum(least(a.c, b.c)) AS shared FROM g a JOIN g b ON a.side = 0 AND b.side = 1 AND a.file_id = b.file_id AND a.kind = b.kind AND a.gram = b.gram GROUP BY ALL),
scored AS (SELECT old_id, new_id, max(score) AS score FROM (SELECT old_id, new_id, 2.0::DOUBLE * shared / (x.n + y.n) AS score FROM met JOIN sized x ON x.id = old_id AND x.side = 0 JOIN sized y ON y.id = new_id AND y.side = 1
  UNION ALL SELECT a.id, b.id, 1.0 FROM z a JOIN z b ON a.side = 0 AND b.side = 1 AND a.file_id = b.file_id AND a.kind = b.kind AND a.call = b.call) WHERE score >= 0.85 GROUP BY ALL),
top AS (SELECT *, rank() OVER (PARTITION BY old_id ORDER BY score DESC) AS r, rank() OVER (PARTITION BY new_id ORDER BY score DESC) AS q FROM scored),
single AS (SELECT old_id, new_id, count(*) FILTER (WHERE r = 1) OVER (PARTITION BY old_id) AS ro, count(*) FILTER (WHERE q = 1) OVER (PARTITION BY new_id) AS qo, r, q FROM top), renamed AS (SELECT old_id, new_id FROM single WHERE r = 1 AND q = 1 AND ro = 1 AND qo = 1)"""


def _sides(m: Model) -> list[DataFrame]:
    told = m.heads.withColumns({"symbol_id": F.col("id"), "start_byte": F.col("id") * 1000, "end_byte": F.col("id") * 1000 + F.length("text")})
    return [told.where(F.col("side") == side) for side in (0, 1)]


@query("d3_compatible", inner(PARAMS, "SELECT id, lang, works FROM works", "heads"))
def _(m: Model):
    old, new = (signatures.with_shapes(x.repartition("id")) for x in _sides(m))
    both = large(old.select("id", "lang", F.col("call").alias("a"))).join(new.select("id", F.col("call").alias("b")), "id")
    return both.select("id", "lang", signatures.compatible(F.col("lang"), F.col("a"), F.col("b")).alias("works"))


@query("d2_renamed", inner(f"{PARAMS}, {RENAMES}", "SELECT old_id, new_id FROM renamed", "heads"))
def _(m: Model):
    shaped = lambda x, name: written(signatures.with_shapes(x.where("id % 5 = 0").repartition("file_id")), name)
    old, new = _sides(m)
    return changes.renamed(shaped(old, "gone"), shaped(new, "added"))


@query("d1_shape_changes", inner(f"{PARAMS}, {RENAMES}", """SELECT file_id, CASE WHEN h.id % 5 = 0 THEN 'removed' WHEN works THEN 'body' ELSE 'signature' END AS change, name, kind, h.id AS old_id, CASE WHEN h.id % 5 = 0 THEN new_id ELSE h.id END AS new_id, CASE WHEN h.id % 5 = 0 THEN 'made' || CAST(new_id AS VARCHAR) END AS renamed_to
FROM h JOIN works w ON w.id = h.id LEFT JOIN renamed ON old_id = h.id WHERE side = 0 AND (h.id % 5 = 0 OR NOT works OR h.id % 3 = 0)""", "heads"))  # fmt: skip
def _(m: Model):
    return changes.shape_changes(*_sides(m))


#: Files whose number ends in 0 or 5 were edited: some of their symbols are gone, some have another signature.
CHANGED = f"""c0 AS (SELECT s.symbol_id AS change_id, CASE WHEN s.symbol_id % 3 = 0 THEN 'removed' ELSE 'signature' END AS change, s.name, s.kind, CASE WHEN s.symbol_id % 9 = 1 THEN 'private ' ELSE '' END || s.signature || ' ' || s.name AS signature, s.file_id, f.path, f.lang,
  CASE WHEN f.lang IN ('typescript', 'javascript') THEN 'js' WHEN f.lang IN ('c', 'cpp') THEN 'c' ELSE f.lang END AS family FROM symbols s JOIN files f USING (file_id) WHERE s.file_id % 5 = 0 AND s.symbol_id % 2 = 1),
fam AS (SELECT file_id, path, lang, CASE WHEN lang IN ('typescript', 'javascript') THEN 'js' WHEN lang IN ('c', 'cpp') THEN 'c' ELSE lang END AS family FROM files),
c1 AS (SELECT *, row_number() OVER (PARTITION BY change, family, name ORDER BY change_id) AS nth FROM c0 WHERE length(name) >= 3 AND lower(name) NOT IN ({", ".join(f"'{w}'" for w in text.GENERIC_NAMES)}) AND NOT (lang IN ('java', 'kotlin', 'csharp', 'typescript', 'tsx') AND signature LIKE 'private %') AND signature NOT LIKE '%@app.get%'),
remaining AS (SELECT s.name, fam.family FROM symbols s JOIN fam USING (file_id) WHERE NOT (s.file_id % 5 = 0 AND s.symbol_id % 2 = 1 AND s.symbol_id % 3 = 0)),
c AS (SELECT * FROM c1 WHERE nth = 1 AND (SELECT count(*) FROM symbols s WHERE s.name = c1.name) <= 5 AND NOT (change = 'removed' AND EXISTS (SELECT 1 FROM remaining r WHERE r.name = c1.name AND r.family = c1.family))),
u AS (SELECT r.*, fam.path AS ref_path, fam.family AS ref_family FROM refs r JOIN fam USING (file_id)),
met AS (SELECT c.*, u.file_id AS ref_file, u.ref_path, u.line, u.enclosing_symbol_id AS caller FROM c JOIN u ON u.name = c.name AND u.ref_family = c.family AND u.file_id % 5 <> 0 AND NOT EXISTS (SELECT 1 FROM symbols s WHERE s.name = u.name AND s.file_id = u.file_id) AND (c.change = 'removed' OR u.file_id % 4 <> 1)),
tied AS (SELECT met.* FROM met LEFT JOIN texts t ON t.file_id = met.ref_file WHERE kind NOT IN ('function', 'method') OR lang IN ('c', 'cpp') OR t.text IS NULL OR regexp_matches(t.text, 'Box' || CAST(met.file_id % 4 AS VARCHAR) || '[^0-9]')
  OR (lang = 'java' AND regexp_matches(t.text, 'import static lib[.]' || name || ';')) OR (lang <> 'java' AND regexp_matches(t.text, '(import |, )' || name || '(,| from|$)')))"""


def _findings(m: Model) -> DataFrame:
    s, edited = m.symbols, (F.col("file_id") % 5 == 0) & (F.col("symbol_id") % 2 == 1)
    gone = edited & (F.col("symbol_id") % 3 == 0)
    private = F.when(F.col("symbol_id") % 9 == 1, "private ").otherwise("")
    told = s.where(edited).select(F.col("symbol_id").alias("change_id"), F.when(gone, "removed").otherwise("signature").alias("change"), "name", "kind", F.concat(private, "signature", F.lit(" "), "name").alias("signature"), "file_id", F.lit(None).cast("string").alias("renamed_to"))
    around = s.where(edited).select("file_id", "name", F.concat(F.lit("Box"), (F.col("file_id") % 4).cast("string")).alias("container"))
    refs = m.refs.withColumnRenamed("enclosing_symbol_id", "enclosing")
    return findings.collect(told, s, refs, m.files, m.texts, s.where((F.col("file_id") % 5 == 0) & ~gone).select("file_id", "name"), around, s.where("file_id % 5 = 0").select("file_id"), m.files.where("file_id % 4 = 1").select("file_id"))


FOUND = """SELECT CASE WHEN change = 'removed' THEN 'dangling' ELSE 'stale' END AS kind, CAST(CASE WHEN change = 'removed' THEN 0 ELSE 1 END AS INT) AS confidence, name AS symbol, path AS changed_file, ref_path AS path, min(line) AS line, arg_min(caller, (line, caller)) AS caller, count(*) AS refs_in_file,
regexp_matches(lower(ref_path), '/tests?/|__tests__|^tests?/|\\.test\\.|\\.spec\\.|_test\\.|\\.tests/|(^|/)test_[^/]*$') OR (strlen(regexp_extract(ref_path, '([^/]+?)(\\.[^./]*)?$', 1)) > 4 AND regexp_matches(regexp_extract(ref_path, '([^/]+?)(\\.[^./]*)?$', 1), 'Tests?$')) AS in_test
FROM tied GROUP BY change_id, change, name, path, ref_path"""


@query("d6_findings", inner(CHANGED, FOUND, "files", "symbols", "refs", "texts"))
def _(m: Model):
    return _findings(m).drop("renamed_to")


@query("o8_findings_in_order", inner(CHANGED, f"SELECT kind, symbol, path, line FROM ({FOUND}) ORDER BY confidence, in_test, symbol, path, line LIMIT 20", "files", "symbols", "refs", "texts"))
def _(m: Model):
    return findings.in_order(_findings(m)).select("kind", "symbol", "path", "line")
