import hashlib
import random
import re
from collections import Counter

import pytest

from codequarry.llm import common, spotsigs


def words_of(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def fingerprint(text: str) -> str:
    """Anchors are the common words; each run of them before a content word begins a chain of content words."""
    content, heads = [], []
    anchored = False
    for w in words_of(text):
        if w in set(spotsigs.ANCHORS):
            anchored = True
            continue
        content.append(w)
        heads.append(anchored)
        anchored = False
    chains = {" ".join(content[i : i + spotsigs.CHAIN]) for i, h in enumerate(heads) if h and i + spotsigs.CHAIN <= len(content)}
    sigs = sorted({hashlib.md5(c.encode()).hexdigest()[:8] for c in chains})
    return " ".join(sigs) if sigs else "=" + hashlib.md5(text.encode()).hexdigest()


def alike(a: str, b: str) -> float:
    x, y = set(a.split(" ")), set(b.split(" "))
    return len(x & y) / len(x | y)


def plain(rows: list[tuple]) -> list[tuple]:
    ordered = sorted(((d, t or "") for d, t in rows), key=lambda r: (-r[0], r[1]))
    out = []
    for i, (d, t) in enumerate(ordered):
        after = ordered[(i + 1) % len(ordered)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b, c = fingerprint(t), fingerprint(edited), fingerprint(after)
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, pytest.approx(alike(a, b)), pytest.approx(alike(a, c))))
    return out


COLUMNS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def run(spark, rows, schema="doc_id long, text string"):
    found = spotsigs.compare_edited(spark.createDataFrame(rows, schema).repartition(3)).collect()
    return sorted((tuple(r[c] for c in COLUMNS) for r in found), key=lambda r: -r[0])


def documents(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = [*spotsigs.ANCHORS, *(f"word{i}" for i in range(60)), "naïve", "漢字", "x_y", "😀", "3.14"]
    return [(d, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 20, 150])))) for d in rng.sample(range(-50, 100_000), n)]


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "BUCKET_ROWS", 7)
    rows = documents(1, 120)
    assert run(spark, rows) == plain(rows)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "the the the"), (4, "the"), (5, "the a b"), (6, "the " * 40_000 + "quick fox"), (7, "fox " * 40_000)]
    assert run(spark, rows) == plain(rows)
    assert run(spark, rows[:1]) == plain(rows[:1])
    assert run(spark, []) == []
    repeated = [(1, "the red fox"), (1, "the red fox"), (2, "a b")]
    assert len(run(spark, repeated)) == 3
    assert len(spotsigs.compare_edited(spark.createDataFrame([(None, "a"), (None, None), (1, "b")], "doc_id long, text string")).collect()) == 3


def test_extra_columns(spark):
    rows = [(1, "the red fox ran", "a", 1), (2, "the red fox sat", "b", 2)]
    assert run(spark, rows, "doc_id long, text string, fp string, bucket int") == plain([r[:2] for r in rows])


def test_near_pairs_lose_nothing(spark):
    rng = random.Random(2)
    rows = []
    for d in range(120):
        base = random.Random(d // 6)
        words = [base.choice(["the", "of", *(f"w{i}" for i in range(80))]) for _ in range(base.choice([20, 60, 150]))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(len(words))] = f"v{rng.randrange(9)}"
        rows.append((d, " ".join(words)))
    # ids that texts share, or lack
    rows += [(1, rows[60][1]), (1, rows[60][1] + " the end"), (None, rows[3][1]), (None, "the last of all these words"), (500, None), (501, "")]
    members, pairs = spotsigs.near_pairs(spark.createDataFrame(rows, "doc_id long, text string"), 0.6)
    fps = [fingerprint(t or "") for _, t in rows]
    told = members.collect()
    assert Counter(r["doc_id"] for r in told) == Counter(d for d, _ in rows)
    classes = {}
    for r in told:
        classes.setdefault(r["class_id"], set()).add(r["doc_id"])
    by_fp = {}
    for (d, _), fp in zip(rows, fps, strict=True):
        by_fp.setdefault(fp, set()).add(d)
    assert sorted(map(str, map(sorted_, classes.values()))) == sorted(map(str, map(sorted_, by_fp.values())))
    name = {fp: hashlib.md5(fp.encode()).hexdigest() for fp in by_fp}
    want = {tuple(sorted((name[a], name[b]))) for a in by_fp for b in by_fp if a != b and alike(a, b) >= 0.6}
    assert {(r["a"], r["b"]) for r in pairs.collect()} == want and want


def sorted_(ids):
    return sorted(ids, key=str)


def test_near_pairs_of_an_empty_table(spark):
    members, pairs = spotsigs.near_pairs(spark.createDataFrame([], "doc_id long, text string, fp string, class_id int"))
    assert members.count() == pairs.count() == 0


def test_one_outlying_id_and_many_null_ids_fill_no_bucket(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "BUCKET_ROWS", 20)
    rows = [(d, f"the words of number {d}") for d in range(200)] + [(10**15, "the far one")] + [(None, f"the text {k} without") for k in range(200)]
    scratch = common.Scratch(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    told = spotsigs.with_next(docs, scratch).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = {(d, t): n for (d, t), (_, n) in zip(ordered, ordered[1:] + ordered[:1], strict=True)}
    assert {(r["doc_id"], r["text"]): r["next_text"] for r in told} == want
    sizes = [r["count"] for r in spark.read.parquet(scratch.paths["dealt"]).groupBy("bucket").count().collect()]
    assert max(sizes) <= 80 and len(sizes) > 8
