"""Near copies by SimHash: vantage-point trees over 64-bit fingerprints, whose shards look for all pairs within a radius.

A tree parts fingerprints by their Hamming distance to a vantage point: at most the median inside, the others outside. By the triangle
inequality fingerprints within RADIUS of each other differ by at most that much in their distance, so a fingerprint that is
within RADIUS of the boundary also visits the other side, and every other branch is pruned. The top of the tree, fitted on a
bounded sample, deals all fingerprints out to shards: one home each, and the shards that it overlaps. Each shard grows the tree
further over its own fingerprints. No pair is lost whatever the sample is: it decides how even the shards are, not what meets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import Scratch
from codequarry.llm.components import connected_components

#: Words of a shingle, the seed of its hash, and the differing bits up to which fingerprints link.
N, SEED, RADIUS = 3, 42, 2
#: Fingerprints whose home one shard is, about, and those that the top of the tree is fitted on at most, about.
SHARD, SAMPLE = 8192, 1 << 19
#: Fingerprints of a leaf within a shard, and pairs that are compared in one step.
LEAF, STEP = 512, 1 << 20
#: Shingles that are hashed before they are counted.
BLOCK = 1 << 15


def fingerprint(text: str | None) -> int:
    """The bits that are set in over half of the shingles' hashes; 0 without words. Works through a text of any length by blocks."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = min(N, len(words))
    total, ones = len(words) - n + 1, np.zeros(64, np.int64)
    starts, ends, digest = starts[:total].tolist(), ends[n - 1 :].tolist(), xxhash.xxh64_intdigest
    for at in range(0, total, BLOCK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + BLOCK], ends[at : at + BLOCK], strict=True)], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((fingerprint(t.as_py()) for t in batch.column("text")), np.uint64, batch.num_rows)
        yield pa.record_batch([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])


class Tree:
    """Nodes (vantage point, median distance) in the order of a heap: node k has its inside at 2k + 1, its outside at 2k + 2."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int = 0):
        rng, nodes = np.random.default_rng(seed), (1 << depth) - 1
        self.depth, self.points, self.medians = depth, np.zeros(nodes, np.uint64), np.zeros(nodes, np.int16)
        parts = {0: sample}
        for k in range(nodes):
            part = parts.pop(k)
            if len(part):
                self.points[k], self.medians[k], inside = _vantage(part, rng)
            else:
                inside = np.zeros(0, bool)
            parts[2 * k + 1], parts[2 * k + 2] = part[inside], part[~inside]

    def dealt(self, fps: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, which of fps, whether it is their home) of each shard that fps reach."""
        stack = [(0, np.arange(len(fps)), np.ones(len(fps), bool))]
        first = len(self.points)
        while stack:
            k, which, home = stack.pop()
            if not len(which):
                continue
            if k >= first:
                yield k - first, which, home
                continue
            apart = np.bitwise_count(fps[which] ^ self.points[k]).astype(np.int16)
            for child, taken, own in _sides(k, apart, self.medians[k], home):
                stack.append((child, which[taken], own[taken]))


def _vantage(part: np.ndarray, rng: np.random.Generator) -> tuple[np.uint64, int, np.ndarray]:
    """Of some candidates the point whose boundary is overlapped least while neither side has over three quarters: the point, its distance, and what is inside."""
    best = None
    for point in rng.choice(part, min(4, len(part)), replace=False):
        apart = np.bitwise_count(part ^ point).astype(np.int16)
        counts = np.bincount(apart, minlength=66)
        upto = np.cumsum(counts)
        middle = int(np.searchsorted(upto, len(part) / 2))
        for cut in range(max(middle - 3, 0), min(middle + 3, 64) + 1):
            inside, overlap = upto[cut], counts[max(cut - RADIUS + 1, 0) : cut + RADIUS + 1].sum()
            worth = (4 * max(inside, len(part) - inside) > 3 * len(part), overlap + abs(2 * inside - len(part)) / 4)
            if best is None or worth < best[0]:
                best = worth, point, cut, apart <= cut
    return best[1:]


def _sides(k: int, apart: np.ndarray, median: int, home: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(child, who goes there, whether at home). Of a pair that the boundary parts only the outer one visits: it meets the inner one at its home.

    A visitor is as yet to meet homes on either side, so it goes wherever the triangle bound lets it.
    """
    inside = apart <= median
    return [(2 * k + 1, apart <= median + RADIUS, home & inside), (2 * k + 2, np.where(home, ~inside, apart > median - RADIUS), home)]


class Links:
    """Labels of the smallest index that links reach; pairs are taken in bulk."""

    def __init__(self, n: int):
        self.labels = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        labels = self.labels
        while len(a):
            x, y = labels[a], labels[b]
            open_ = x != y
            if not open_.any():
                break
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(further := labels[labels], labels):
                labels[:] = further


def _meet(fps: np.ndarray, homes: np.ndarray, others: np.ndarray, links: Links) -> None:
    """All pairs of homes with each other and with others, STEP at a time."""
    met = np.concatenate([homes, others])
    rows = max(1, STEP // max(len(met), 1))
    for at in range(0, len(homes), rows):
        part = homes[at : at + rows]
        i, j = np.nonzero(np.bitwise_count(fps[part][:, None] ^ fps[met][None, at:]) <= RADIUS)
        links.add(part[i], met[at:][j])


def shard_links(fps: np.ndarray, home: np.ndarray, seed: int = 0) -> np.ndarray:
    """For each of a shard's fingerprints the smallest index that links with a home reach; what is at home is parted further by vantage points."""
    rng, links = np.random.default_rng(seed), Links(len(fps))
    stack = [(np.arange(len(fps)), home)]
    while stack:
        which, own = stack.pop()
        homes = int(own.sum())
        if not homes:
            continue
        sides = []
        if homes > LEAF:
            mine = fps[which[own]]
            point, median, inside = _vantage(mine if len(mine) <= 4 * LEAF else rng.choice(mine, 4 * LEAF, replace=False), rng)
            apart = np.bitwise_count(fps[which] ^ point).astype(np.int16)
            sides = [(which[taken], at_home[taken]) for _, taken, at_home in _sides(0, apart, median, own)]
            left = max(int(at_home.sum()) for _, at_home in sides)
        if sides and left < homes:
            stack += sides
        else:
            _meet(fps, which[own], which[~own], links)
    return links.labels


def _shard(table: pa.Table) -> pa.Table:
    fps = table.column("fp").to_numpy().view(np.uint64)
    labels = shard_links(fps, table.column("home").to_numpy(zero_copy_only=False).astype(bool))
    linked = labels != np.arange(len(labels))
    return pa.table({"a": fps[linked].view(np.int64), "b": fps[labels[linked]].view(np.int64)})


def link_fingerprints(fps: DataFrame, scratch: Scratch, shard: int = SHARD) -> DataFrame:
    """(node, component) of the distinct fingerprints fps (fp) that link with any other; a component's name is its smallest fingerprint."""
    n = fps.count()
    depth = max(0, int(np.ceil(np.log2(max(n, 1) / shard))))
    depth = min(depth, int(np.log2(SAMPLE)) - 4)
    step = -(-n // SAMPLE) or 1
    sample = fps.where(F.pmod(F.xxhash64("fp"), F.lit(step)) == 0).orderBy("fp").toPandas()["fp"].to_numpy().view(np.uint64)
    tree = fps.sparkSession.sparkContext.broadcast(Tree(sample, depth))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = batch.column(0).to_numpy().view(np.uint64)
            for shard_, which, home in tree.value.dealt(told):
                yield pa.record_batch([pa.array(np.full(len(which), shard_, np.int32)), pa.array(told[which].view(np.int64)), pa.array(home)], names=["shard", "fp", "home"])

    placed = fps.mapInArrow(dealt, "shard int, fp long, home boolean")
    edges = scratch.write("pairs", placed.groupBy("shard").applyInArrow(_shard, "a long, b long"))
    out = connected_components(edges, scratch, "near")
    scratch.drop("pairs")
    tree.unpersist()
    return out


def link(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """One row a document: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id that links reach, its own included).

    A null text and one without words have the fingerprint zero, which links like any other. Repeated rows have a row each; a
    document with a null id has its row, and counts for a component's smallest id only where there is no other. Columns but
    doc_id and text aren't read, so names can't clash; an empty table has no rows; a very long text is hashed by blocks. The
    result is a table in the shared folder, and all others are dropped by then.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = scratch.write("signed", docs.mapInArrow(_fingerprints, "doc_id long, fp long"))
    nodes = scratch.write("nodes", signed.groupBy("fp").agg(F.min("doc_id").alias("least")))
    groups = link_fingerprints(nodes.select("fp"), scratch, shard)
    placed = nodes.join(groups, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = placed.join(least, "component").select("fp", "component_id")
    out = signed.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    out = scratch.write("simhash", out)
    scratch.keep_only("simhash")
    return out
