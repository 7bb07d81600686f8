import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from codequarry.llm import divergence
from codequarry.llm.queries import ORACLE, QUERIES

SCHEMA = "lang string, source string, text string"


def plain(rows: list[tuple], docs: int) -> list[tuple]:
    """Part by part as stated, with Python's whole numbers."""
    groups, in_docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        groups[lang or "", source or ""].update(terms)
        in_docs[lang or ""].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in in_docs[lang].items() if n >= docs]
        own = {s: {t: c[t] for t in kept} for (g, s), c in groups.items() if g == lang}
        own[None] = {t: sum(c[t] for c in own.values()) for t in kept}
        p = {s: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept} for s, c in own.items()}
        for s in own.keys() - {None}:
            pairs = [("pair", o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in own.keys() - {None, s}]
            terms = [("term", t, p[s][t] - p[None][t]) for t in kept if own[s][t] and p[s][t] > p[None][t]]
            for found in (pairs, sorted(terms, key=lambda x: (-x[2], x[1].encode()))[:50]):
                out += [(lang, s, *x, k + 1) for k, x in enumerate(sorted(found, key=lambda x: (-x[2], x[1].encode())))]
    return sorted(out)


def run(spark, rows, **how):
    return sorted(tuple(r) for r in divergence.compare_sources(spark.createDataFrame(rows, SCHEMA), **how).collect())


def corpus(seed: int, n: int, sources: int) -> list[tuple]:
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("Das", "le", "être", "ß", "word", "X") for b in ("", "e", "é", "Z", "日本")]
    return [(rng.choice(["en", "de", None]), rng.choice(["s0", None, *(f"s{k}" for k in range(sources))]), rng.choice([" ", "-1"]).join(rng.choices(words, k=rng.randrange(12))) or None) for _ in range(n)]


@pytest.mark.parametrize("tiles", [{}, {"TILE_TERMS": 3, "TILE_GROUPS": 2, "STEP": 10}])
def test_tiles_match_brute_force(monkeypatch, tiles):
    for name, value in {"DOCS": 6, "BEST": 50, **tiles}.items():
        monkeypatch.setattr(divergence, name, value)
    rows = corpus(1, 150, 5)
    assert run_local(rows) == [r for r in plain(rows, 6) if r[2] == "pair" or r[5] <= 50]


def run_local(rows):
    """The tiles of one block a language, without Spark."""
    import pyarrow as pa

    counted = pa.Table.from_batches(list(divergence._counted(iter([pa.RecordBatch.from_pylist([{"lang": a or "", "source": b or "", "text": c or ""} for a, b, c in rows])]))))
    cells = counted.to_pylist()
    out = []
    for lang in {c["lang"] for c in cells}:
        own = [c for c in cells if c["lang"] == lang]
        docs = Counter()
        for c in own:
            docs[c["term"]] += c["docs"]
        kept = {t for t, n in docs.items() if t is not None and n >= divergence.DOCS}
        total = Counter()
        for c in own:
            total[c["source"]] += c["n"] if c["term"] in kept else 0
        block = [{"lang": lang, "source": c["source"], "term": c["term"], "n": c["n"] if c["term"] else total[c["source"]], "v": len(kept)} for c in own if c["term"] is None or c["term"] in kept]
        told = divergence._tiles(pa.Table.from_pylist(block, pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("v", pa.int64())]))).to_pylist()
        told += [r | {"source": r["item"], "item": r["source"]} for r in told if r["part"] == "pair"]
        by = defaultdict(list)
        for r in told:
            by[r["source"], r["part"]].append(r)
        for found in by.values():
            out += [(*r.values(), k + 1) for k, r in enumerate(sorted(found, key=lambda r: (-r["value"], r["item"].encode())))]
    return sorted(out)


def test_blocks_add_up(spark):
    rng = random.Random(2)
    rows = corpus(2, 700, 4) + [("en", f"s{rng.randrange(4)}", " ".join(f"t{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(80))) for _ in range(30)]
    expected = plain(rows, 30)
    assert {r[2] for r in expected} == {"pair", "term"}
    assert run(spark, rows, block=1) == run(spark, rows) == expected


def test_no_kept_terms_and_odd_rows(spark):
    rows = [("en", "a", "few words"), ("en", None, None), ("en", "b", ""), (None, "a", "12 34"), (None, None, "x"), ("fr", "only", "y")]
    assert run(spark, rows) == plain(rows, 30)
    assert run(spark, []) == []
    same = [("en", "a", "A a B")] * 40 + [("en", "b", "b ä")] * 40 + [("en", "c", "-")]
    assert run(spark, same) == plain(same, 30)


def test_long_texts_are_split_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "SLICE", 16)
    text = ("Ab cde 1 " * 9 + "aBCdEFGh" * 9 + "x" * 50 + " é" * 20).encode()
    assert [t for part in divergence.terms_of(text) for t in part] == re.findall(rb"[a-z\x80-\xff]+", text.lower())


def test_shares_are_exact():
    rng = random.Random(5)
    for _ in range(300):
        whole = rng.randrange(1, 9 * 10**15)
        counts = [rng.randrange(whole + 1) for _ in range(5)] + [whole, 0]
        assert divergence.shares(np.array(counts), whole).tolist() == [1 + 10**9 * c // whole for c in counts]


def test_clashing_columns(spark):
    rows = [("en", "a", "x", 1, 2), ("en", "b", "x", 3, 4)]
    found = divergence.compare_sources(spark.createDataFrame(rows, "lang string, source string, text string, block int, n long")).collect()
    assert sorted(tuple(r) for r in found) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_whole_table_matches_its_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS FROM '{sf_dir}/documents.parquet'")
    expected = duckdb.sql(ORACLE["op12_divergence"]).fetchall()
    found = QUERIES["op12_divergence"](spark, sf_dir)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"] and found.dtypes[4][1] == "bigint" and found.dtypes[5][1] == "int"
    assert sorted(tuple(r) for r in found.collect()) == sorted(expected)
