"""BM25 over whole texts against a plain version."""

from __future__ import annotations

import math
import re
from collections import Counter

import pytest

import __spark_entry__ as entry
from codequarry.plans import retrieval

DOCS = [(i, f"common w{i % 7} {'rare ' * (i % 3)}x{i}") for i in range(40)] + [(50, "same text, rare"), (49, "Same text; RARE"), (51, None), (52, ""), (None, "rare w1"), (7, "again w1 w1"), (60, "rare w1"), (60, None)]
ASKED = [(1, "rare w1"), (2, "RARE, same rare"), (3, "nowhere"), (4, None), (5, "common"), (6, "again x7"), (1, "w1 w2")]


def plain_scores():
    words = lambda t: [w for w in re.split("[^a-z0-9_]+", (t or "").lower()) if w]
    docs, lengths, queries = {}, {}, {}
    for key, text in DOCS:
        docs.setdefault(key, Counter()).update(words(text))
        if text is not None:
            lengths.setdefault(key, []).append(len(words(text)))
    for q, text in ASKED:
        queries.setdefault(q, set()).update(words(text))
    all_ = [x for xs in lengths.values() for x in xs]
    n, mean, out = len(DOCS), sum(all_) / len(all_), {}
    df = Counter(t for c in docs.values() for t in c)
    for q, terms in queries.items():
        for key, c in docs.items():
            if key is not None and terms & set(c):
                idf = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) for t in terms & set(c)}
                out[q, key] = round(sum(idf[t] * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * x / mean)) for t in idf for x in lengths.get(key, [])), 6)
    return out


@pytest.mark.parametrize("block", [256, 2])
def test_matches_plain(spark, monkeypatch, block):
    monkeypatch.setattr(retrieval, "TERM_BLOCK", block)
    blocks = retrieval.bm25(spark.createDataFrame(DOCS, "doc_id int, text string").repartition(3), spark.createDataFrame(ASKED, "query_id int, text string"), "doc_id")
    want = plain_scores()
    for k in (3, 100):
        for scored in (True, False):
            told = {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in retrieval.bm25_top(blocks, "doc_id", k, scored).collect()}
            best = {}
            for q in {q for q, _ in want}:
                ranked = sorted((-s if scored else 0.0, d) for (x, d), s in want.items() if x == q)[:k]
                best |= {(q, i + 1): (d, -s) for i, (s, d) in enumerate(ranked)}
            assert told.keys() == best.keys()
            assert all(told[x][0] == best[x][0] and told[x][1] == pytest.approx(best[x][1], abs=1e-9) for x in best)
    top = {q: max(s for (x, _), s in want.items() if x == q) for q, _ in want}
    kept = Counter(q for (q, _), s in want.items() if s >= 0.5 * top[q])
    assert {r.query_id: r.kept for r in retrieval.bm25_above(blocks, 0.5).collect()} == kept


def test_no_documents_or_queries(spark):
    docs, asked = spark.createDataFrame(DOCS, "doc_id int, text string"), spark.createDataFrame(ASKED, "query_id int, text string")
    for blocks in (retrieval.bm25(docs.limit(0), asked, "doc_id"), retrieval.bm25(docs, asked.limit(0), "doc_id")):
        assert retrieval.bm25_top(blocks, "doc_id", 3).isEmpty() and retrieval.bm25_above(blocks).isEmpty()


@pytest.mark.parametrize("name", ["r12_bm25_top10", "r10_above_threshold", "r16_rank_fusion"])
def test_no_row_for_each_query_and_document(spark, sf_dir, name):
    assert "Join" not in entry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
