import random
import re

import numpy as np
import pytest
import xxhash

from codequarry.llm import simhash
from codequarry.llm.queries import QUERIES


def plain_fingerprint(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps: list[int]) -> list[int]:
    """The index of the first fingerprint that links of two bits or fewer reach."""
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 2:
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return [root(i) for i in range(len(fps))]


def plain(rows: list[tuple]) -> list[tuple]:
    fps = [plain_fingerprint(t) for _, t in rows]
    groups, least = components(fps), {}
    for g, (d, _) in zip(groups, rows, strict=True):
        least[g] = d if least.get(g) is None else (least[g] if d is None else min(d, least[g]))
    return sorted(((d, f"{f:016x}", least[g]) for (d, _), f, g in zip(rows, fps, groups, strict=True)), key=str)


def run(spark, rows, shard=simhash.SHARD):
    found = simhash.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shard).collect()
    return sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in found), key=str)


def crowd(rng: random.Random, n: int) -> list[int]:
    """Fingerprints at random, and chains and crowds around some of them."""
    fps = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(n):
        x = rng.choice(fps[-40:] if rng.random() < 0.7 else fps)
        for _ in range(rng.choice([1, 2, 2, 3, 4])):
            x ^= 1 << rng.randrange(64)
        fps.append(x)
    return sorted(set(fps))


@pytest.mark.parametrize("seed", [1, 2])
def test_trees_find_all_pairs_within_the_radius(spark, seed):
    fps = crowd(random.Random(seed), 700)
    nodes = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long")
    found = {r["node"] % (1 << 64): r["component"] % (1 << 64) for r in simhash.link_fingerprints(nodes, simhash.Scratch(spark), 64).collect()}
    groups = {}
    for x, g in zip(fps, components(fps), strict=True):
        groups.setdefault(g, set()).add(x)
    ours = {}
    for x in fps:
        ours.setdefault(found.get(x, x), set()).add(x)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, groups.values()))


def test_shards_part_their_fingerprints_further(monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 16)
    monkeypatch.setattr(simhash, "STEP", 100)
    rng = random.Random(4)
    ball = [sum(1 << b for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 5]))) for _ in range(400)]
    fps = sorted({*crowd(rng, 200), *ball})
    labels = simhash.shard_links(np.array(fps, np.uint64), np.ones(len(fps), bool))
    assert labels.tolist() == components(fps)


def test_most_fingerprints_are_pruned():
    rng = np.random.default_rng(0)
    fps = rng.integers(0, 1 << 63, 40_000, np.uint64)
    tree = simhash.Tree(fps[:4000], 5)
    parts = list(tree.dealt(fps))
    assert sum(len(w) for _, w, _ in parts) < 6 * len(fps)  # of 32 shards
    assert sum(int(h.sum()) for _, _, h in parts) == len(fps)
    assert max(int(h.sum()) for _, _, h in parts) < 3 * len(fps) / 32


def test_whole_table_matches_brute_force(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    found = QUERIES["op13_simhash"](spark, sf_dir)
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain(rows)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 7)
    long = " ".join(f"w{i}" for i in range(5000))
    rows = [(5, None), (3, ""), (9, " \t\n"), (None, "a b c d"), (7, "A  b\nc D"), (None, "Ä x"), (4, "ä x"), (8, long), (2, long + " more"), (2, long + " more"), (6, "one"), (1, " "), (11, "  x\x1cy")]
    assert run(spark, rows) == plain(rows)
    assert run(spark, rows, shard=1) == plain(rows)


def test_crowds_of_copies_and_edits(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(300)}" for _ in range(400)]
    rows = [(100 + i, " ".join(base)) for i in range(60)]
    for i in range(120):
        words = base[:]
        words[rng.randrange(len(words))] = f"v{i}"
        rows.append((300 + i, " ".join(words)))
    assert run(spark, rows, shard=8) == plain(rows)


def test_empty_table_and_clashing_columns(spark):
    assert run(spark, []) == []
    docs = spark.createDataFrame([(2, "a b c", 1, "x"), (1, "a b c", 2, "y")], "doc_id long, text string, fp long, component_id string")
    assert {tuple(r)[::2] for r in simhash.link(docs).collect()} == {(1, 1), (2, 1)}


def test_links_in_bulk():
    links = simhash.Links(6)
    links.add(np.array([5, 4, 1]), np.array([4, 3, 2]))
    links.add(np.array([2]), np.array([5]))
    assert links.labels.tolist() == [0, 1, 1, 1, 1, 1]
