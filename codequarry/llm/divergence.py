"""Source divergence: how the sources of a language differ in their use of its terms, by dense tiles of groups and terms.

The terms of a language are dealt out to blocks. A block's counts become an int64 matrix of groups by terms; all pairs of its rows are
broadcast against each other and summed, and each row keeps a heap of its best terms. The partial pair sums of the blocks
are added and their heaps are merged. All arithmetic is in whole numbers.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codequarry.llm.common import Scratch

#: A kept term is in this many documents of its language at least; added to each count; parts of one; terms told of a group.
DOCS, PRIOR, SCALE, BEST = 30, 5, 10**9, 50
#: Terms of a block at least (twice as many as groups where those are more), and those and the groups that one dense tile has.
BLOCK, TILE_TERMS, TILE_GROUPS = 256, 4096, 256
#: Numbers of one broadcast step, terms that a task counts before it tells, and bytes of text split in one step.
STEP, HELD, SLICE = 1 << 21, 1 << 18, 1 << 20

_TERM, _BETWEEN = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[^A-Za-z\x80-\xff]")


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms in order, in lists of about SLICE bytes of text; only A to Z are lower-cased."""
    at = 0
    while at < len(text):
        cut = _BETWEEN.search(text, min(at + SLICE, len(text)) - 1) if at + SLICE < len(text) else None
        end = cut.end() if cut else len(text)
        yield _TERM.findall(text[at:end].lower())
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of a task's documents, told whenever HELD terms are held; each group also has a row without a term."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0
    for batch in batches:
        groups = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)
        for group, text in zip(groups, batch.column("text").cast(pa.large_binary()), strict=True):
            n, docs = held.setdefault(group, (Counter({None: 0}), Counter()))
            before, seen = len(n), set()
            for terms in terms_of(text.as_py()):
                n.update(terms)
                seen.update(terms)
            docs.update(seen)
            size += len(n) - before
            if size > HELD:
                yield from _told(held)
                held, size = {}, 0
    yield from _told(held)


def _told(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    for (lang, source), (n, docs) in held.items():
        terms = pa.array(n.keys(), pa.binary()).cast(pa.string())
        columns = [pa.repeat(lang, len(n)), pa.repeat(source, len(n)), terms, pa.array(n.values(), pa.int64()), pa.array([docs.get(t, 0) for t in n], pa.int64())]
        yield pa.record_batch(columns, names=["lang", "source", "term", "n", "docs"])


def shares(counts: np.ndarray, whole: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * counts / whole) for counts up to whole, by long division in steps of 1000: exact for a whole under 9 * 10**15."""
    out, rest = np.divmod(counts, whole)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digit
    return out + 1


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sums of |x - y| over the terms, for all rows x of a and y of b."""
    out = np.empty((len(a), len(b)), np.int64)
    rows = max(1, STEP // max(b.size, 1))
    for at in range(0, len(a), rows):
        out[at : at + rows] = np.abs(a[at : at + rows, None, :] - b[None, :, :]).sum(axis=2)
    return out


def _tiles(table: pa.Table) -> pa.Table:
    """The pair sums and the best terms of one block; its rows are counts (term, n), and a row without a term for each group (n: the group's total, v: kept terms)."""
    table = table.combine_chunks()
    named = pc.is_null(table.column("term"))
    groups = table.filter(named).sort_by("source")
    sources, totals, v = groups.column("source").to_pylist(), groups.column("n").to_numpy(), groups.column("v")[0].as_py()
    lang, cells = table.column("lang")[0].as_py(), table.filter(pc.invert(named))
    terms = pc.unique(cells.column("term"))
    terms = terms.take(pc.sort_indices(terms))
    row = pc.index_in(cells.column("source"), pa.array(sources)).to_numpy().astype(np.int64)
    column = pc.index_in(cells.column("term"), terms).to_numpy().astype(np.int64)
    n = cells.column("n").to_numpy()
    order = np.lexsort((row, column))
    row, column, n = row[order], column[order], n[order]

    sums = np.zeros((len(sources), len(sources)), np.int64)
    heaps: list[list[tuple[int, int]]] = [[] for _ in sources]
    whole, of_lang = totals + PRIOR * v, int(totals.sum()) + PRIOR * v
    for first in range(0, len(terms), TILE_TERMS):
        width = min(TILE_TERMS, len(terms) - first)
        a, b = np.searchsorted(column, [first, first + width])
        lang_counts = np.zeros(width, np.int64)
        np.add.at(lang_counts, column[a:b] - first, n[a:b])
        q = shares(lang_counts + PRIOR, of_lang)
        for top in range(0, len(sources), TILE_GROUPS):
            one, held = _dense(row[a:b], column[a:b] - first, n[a:b], top, width, whole)
            for g, k in zip(*np.nonzero(held & (one > q)), strict=True):
                entry, heap = (int(one[g, k] - q[k]), -(first + int(k))), heaps[top + g]
                heapq.heappush(heap, entry) if len(heap) < BEST else heapq.heappushpop(heap, entry)
            for left in range(top, len(sources), TILE_GROUPS):
                two = one if left == top else _dense(row[a:b], column[a:b] - first, n[a:b], left, width, whole)[0]
                sums[top : top + TILE_GROUPS, left : left + TILE_GROUPS] += _apart(one, two)

    x, y = np.triu_indices(len(sources), 1)
    best = [(g, -k, f) for g, heap in enumerate(heaps) for f, k in heap]
    of = pa.array(sources, pa.string())
    told = of.take(pa.array([*x.tolist(), *(g for g, _, _ in best)], pa.int64()))
    items = pa.concat_arrays([of.take(pa.array(y)), _plain(terms).take(pa.array([k for _, k, _ in best], pa.int64()))])
    parts = pa.array(["pair"] * len(x) + ["term"] * len(best), pa.string())
    values = pa.array(np.concatenate([sums[x, y], np.array([f for _, _, f in best], np.int64)]))
    return pa.table({"lang": pa.repeat(lang, len(told)).cast(pa.string()), "source": told, "part": parts, "item": items, "value": values})


def _plain(terms: pa.ChunkedArray | pa.Array) -> pa.Array:
    out = terms.combine_chunks() if isinstance(terms, pa.ChunkedArray) else terms
    return out.cast(pa.string())


def _dense(row: np.ndarray, column: np.ndarray, n: np.ndarray, top: int, width: int, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shares of up to TILE_GROUPS groups from top on, and where they have the term at all."""
    height = min(TILE_GROUPS, len(whole) - top)
    counts = np.zeros((height, width), np.int64)
    inside = (row >= top) & (row < top + height)
    counts[row[inside] - top, column[inside]] = n[inside]
    return shares(counts + PRIOR, whole[top : top + height, None]), counts > 0


def compare_sources(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank: of each (lang, source) the other sources by distance, and the BEST terms it has most beyond its language.

    Part `pair` has the sum over the language's kept terms of |p - q|, p and q the two sources' smoothed shares; it is 0 where no
    term is kept. Part `term` has p - q, q the language's share, of the terms that occur in the group with p over q. Ties go
    by the item's bytes. Null texts, langs and sources are empty strings, which group like any other; repeated rows count
    each; a group without terms has its shares from the prior alone; an empty table has no rows; a very long text is split by
    slices; other columns aren't read. The result is a table in the shared folder, and all others are dropped by then.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counted = docs.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    cells = scratch.write("cells", counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    kept = cells.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= DOCS).select("lang", "term")
    kept = scratch.write("kept", kept)
    used = scratch.write("used", cells.select("lang", "source", "term", "n").join(kept, ["lang", "term"]))

    groups = cells.where("term is null").select("lang", "source")
    totals = groups.join(used.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"))
    shape = groups.groupBy("lang").agg(F.count("*").alias("groups")).join(kept.groupBy("lang").agg(F.count("*").alias("v")), "lang", "left").withColumn("v", F.coalesce("v", F.lit(0)))
    wide = F.greatest(F.lit(block), 2 * F.col("groups"))
    shape = scratch.write("shape", shape.select("lang", "v", F.greatest(F.ceil(F.col("v") / wide), F.lit(1)).cast("int").alias("blocks")))
    told = totals.join(shape, "lang").select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", F.lit(None).cast("string").alias("term"), "n", "v")
    dealt = used.join(shape, "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), "source", "term", "n", "v")
    tiles = dealt.unionByName(told).groupBy("lang", "block").applyInArrow(_tiles, "lang string, source string, part string, item string, value long")
    tiles = scratch.write("tiles", tiles)
    scratch.keep_only("tiles")

    sums = tiles.where("part = 'pair'").groupBy("lang", "source", "item", "part").agg(F.sum("value").alias("value"))
    both = F.inline(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = sums.select("lang", "part", "value", both)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc()))
    best = tiles.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= BEST)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    out = scratch.write("divergence", pairs.withColumn("rank", rank).select(columns).unionByName(best.select(columns)))
    scratch.keep_only("divergence")
    return out


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY lang, source, term),
cell AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
added AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS total, count(*) OVER (PARTITION BY lang, source) AS v, sum(n) OVER (PARTITION BY lang, term) AS lang_n, sum(n) OVER (PARTITION BY lang) AS lang_total FROM cell),
p AS (SELECT lang, source, term, n, 1 + (CAST(1000000000 AS HUGEINT) * (n + 5)) // (total + 5 * v) AS p, 1 + (CAST(1000000000 AS HUGEINT) * (lang_n + 5)) // (lang_total + 5 * v) AS q FROM added),
summed AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
told AS (SELECT * FROM pair UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM told)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
