import random

import numpy as np
import pytest

from codequarry.llm import decontam

WORDS = [f"w{i}" for i in range(300)]


def items(rng) -> list[tuple]:
    return [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(8, 40)))) for i in range(25)] + [(100, None), (101, ""), (102, "...")]


def test_finds_what_is_planted_and_leaves_the_rest(spark):
    rng = random.Random(4)
    bench = items(rng)
    rows, want = [], set()
    for d in range(120):
        body = [rng.choice(WORDS) + "x" for _ in range(rng.randint(0, 200))]
        if d % 4 == 0:
            i = rng.randrange(25)
            at = rng.randint(0, len(body))
            body[at:at] = [bench[i][1].upper().replace(" ", ", ")]
            want.add((d, i))
        rows.append((d, " ".join(body)))
    rows += [(200, None), (201, ""), (None, bench[0][1]), (0, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    told = decontam.find_leaks(docs, spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in told if r["doc_id"] is not None} == want
    assert [r["item_id"] for r in told if r["doc_id"] is None] == [0]
    assert sum(r["doc_id"] == 0 for r in told) == 2
    left = decontam.clean(docs.withColumn("score", docs.doc_id), spark.createDataFrame(bench, "item_id long, text string"))
    assert left.columns == ["doc_id", "text", "score"]
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(str(d) for d, _ in rows if d is not None and (d, 0) not in {(x, 0) for x, _ in want})


@pytest.mark.parametrize("at_once", [1, 400, 1 << 16])
def test_every_window_at_the_threshold_is_found(monkeypatch, at_once):
    """Block-max pruning against scoring all windows with all items, and fewer blocks scored than there are."""
    monkeypatch.setattr(decontam, "WORDS_AT_ONCE", at_once)
    scored, whole = [], decontam._scores
    monkeypatch.setattr(decontam, "_scores", lambda index, blocks, *a: scored.append(len(blocks)) or whole(index, blocks, *a))
    rng = random.Random(8)
    index = decontam.build(items(rng))
    text = [rng.choice(WORDS[:80]) for _ in range(3000)]
    for i in range(0, 2900, 250):
        text[i : i + 12] = rng.choice([t for _, t in items(random.Random(8))[:25]]).split()[:12]
    data = " ".join(text).encode()
    words, _ = decontam.words_of(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert len(words) == len(text)
    cuts = np.array([0, 500, 500, 1700, len(words)])
    got = {(d, i, round(s, 9)) for d, i, s, _, _ in decontam.search(index, words, cuts)}
    want = set()
    for d, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        for start in range(a, b, index.window):
            held = set(words[start : min(start + 2 * index.window, b)].tolist())
            score = np.zeros(len(index.item_ids))
            for k, term in enumerate(index.terms.tolist()):
                if term in held:
                    span = slice(index.term_at[k], index.term_at[k + 1])
                    np.add.at(score, index.items[span], index.impacts[span])
            want |= {(d, int(i), round(float(score[i]), 9)) for i in np.flatnonzero(score >= decontam.THRESHOLD - 1e-9)}
    assert got == want and want
    n_windows = sum(-(-(b - a) // index.window) for a, b in zip(cuts[:-1], cuts[1:], strict=True))
    assert 0 < sum(scored) < n_windows * index.n_blocks


def test_most_blocks_are_skipped():
    """Items of words of their own: a text that holds one of them is scored with one block."""
    index = decontam.build([(i, " ".join(f"i{i}w{k}" for k in range(20)) + " the end of it") for i in range(400)])
    data = ("filler text the end of it " * 200 + " ".join(f"i7w{k}" for k in range(20)) + " the end of it").encode()
    words, before = decontam.words_of(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    cells = decontam.cells_of(index, words, before)
    blocks = decontam.hopeful_blocks(index, *decontam._in_windows(cells, 0, len(cells.last)), decontam.THRESHOLD)
    assert index.n_blocks == 50 and {b % 50 for b in blocks.tolist()} == {0} and len(blocks) <= 2
    assert {i for _, i, *_ in decontam.search(index, words, before)} == {7}


def test_slices_by_size(monkeypatch):
    monkeypatch.setattr(decontam, "SLICE_CHARS", 100)
    assert decontam._slice_bounds([]) == []
    bounds = decontam._slice_bounds([(1, 40), (2, 40), (3, 40), (4, 250), (5, 10)])
    held = [(size, part) for low, high, part, parts in bounds for size in (1, 2, 3, 4, 5) if low <= size <= high]
    assert sorted(set(s for s, _ in held)) == [1, 2, 3, 4, 5]
    assert len(held) == len(set(held)) == 4 + 3


def test_long_texts_and_clashing_columns(spark):
    bench = spark.createDataFrame([(1, "what is the tallest mountain of the moon mons huygens", 0.5)], "item_id long, text string, score double")
    rows = [(1, "word " * 120_000 + "what is the tallest mountain of the moon mons huygens", 7), (2, "word " * 120_000, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id long")
    assert [(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs, bench).collect()] == [(1, 1)]
    left = decontam.clean(docs, bench)
    assert left.columns == ["doc_id", "text", "item_id"] and [r["doc_id"] for r in left.collect()] == [2]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_leaks(docs, none).count() == 0
    assert decontam.clean(docs, none).count() == 1
    assert decontam.find_leaks(docs.limit(0), spark.createDataFrame([(1, "a b c")], "item_id long, text string")).count() == 0


def test_slices_score_alike(spark, monkeypatch):
    """Scores and hits are those of one index, however many slices the benchmark takes."""
    rng = random.Random(6)
    bench = spark.createDataFrame(items(rng) + [(200 + i, f"w1 w2 {'w3 ' * i}") for i in range(9)], "item_id long, text string")
    texts = [t.split() for _, t in items(random.Random(6))[:25]]
    docs = spark.createDataFrame([(d, " ".join(w[len(w) * (d % 4) // 9 :] + ["zz"] * 5)) for d, w in enumerate(texts * 2)], "doc_id long, text string")
    # windows depend on a slice's longest item, and these documents are shorter than any
    told = lambda: sorted((r["doc_id"], r["item_id"], round(r["score"], 9)) for r in decontam.find_leaks(docs, bench).collect())
    one = told()
    monkeypatch.setattr(decontam, "SLICE_CHARS", 1200)
    assert len(list(decontam._slices(bench))) > 2
    assert told() == one and any(s < 0.99 for _, _, s in one)
