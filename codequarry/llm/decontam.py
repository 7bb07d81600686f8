"""Benchmark decontamination: every passage of the corpus queries a BM25 index of the test items by block-max WAND.

Impacts are BM25 contributions divided by the item's own score, so that an item's impacts sum to 1 and one threshold fits
all. Passages are windows of 2 * L words every L words, L at least the longest item, so each occurrence lies in one window
whole. The windows of a run of cells are searched at once: the best impacts of each block of items, summed over the window's
rarer terms, bound what the block's items can reach; blocks that none of these terms is in, or whose bound and the most that
common terms could add stay under the threshold, are skipped, and postings are read for the others alone. Hits are verified
by the share of the item's question and answer shingles that the window holds.

The index is broadcast in slices of about SLICE_CHARS of item text; a larger benchmark takes several passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codequarry.llm import common

K1, B = 1.2, 0.75
THRESHOLD, BLOCK, SHINGLE = 0.5, 8, 5
#: Terms are left to the second pass, commonest first, while they make up at most this share of any item.
COMMON_SHARE = 0.2
#: A hit holds this share of the question's shingles, and this share of the answer's.
QUESTION_SHARE, ANSWER_SHARE = 0.5, 0.5
#: The last words of an item, its answer.
ANSWER_PART = 0.25
SLICE_CHARS, LEAST_WINDOW = 4 << 20, 32
#: Words whose windows are searched at once.
WORDS_AT_ONCE = 1 << 16
_SEPS = common.separators(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")
SCHEMA = "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double"


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the words before each text."""
    lower = common.LOWER[data]
    starts, ends = common.word_bounds(lower, offsets, _SEPS)
    return common.word_hashes(lower, starts, ends), np.searchsorted(starts, offsets)


def shingles(words: np.ndarray) -> np.ndarray:
    return np.unique(common.chained(words, min(SHINGLE, max(len(words), 1))))


@dataclass
class Index:
    """Items and their postings by term (term_at to items and impacts), and by term and block.

    The postings of terms are ordered by item, so each block's are a run: entry k of the sorted block_keys (term * n_blocks +
    block) has the postings from block_from[k] to block_from[k + 1], and block_best[k] is the best impact among them.
    """

    item_ids: list
    questions: list[np.ndarray]
    answers: list[np.ndarray]
    lengths: np.ndarray
    terms: np.ndarray
    term_at: np.ndarray
    items: np.ndarray
    impacts: np.ndarray
    block_at: np.ndarray
    block_keys: np.ndarray
    block_from: np.ndarray
    block_best: np.ndarray
    rare: np.ndarray
    common_most: np.ndarray
    window: int

    @property
    def n_blocks(self) -> int:
        return len(self.common_most)


@dataclass
class Statistics:
    """Of the whole benchmark: items with at least one word, their mean length, and how many items hold each of the sorted terms."""

    n: int
    mean: float
    terms: np.ndarray
    df: np.ndarray


def build(items: list[tuple[int, str]], whole: Statistics | None = None) -> Index | None:
    """The index of items with at least one word; None without any. They are the whole benchmark unless that is given."""
    words = []
    for item_id, text in items:
        data = np.frombuffer((text or "").encode(), np.uint8)
        w, _ = words_of(data, np.array([0, len(data)]))
        if len(w):
            words.append((item_id, w))
    if not words:
        return None
    n = len(words)
    lengths = np.array([len(w) for _, w in words])
    questions, answers = [], []
    for _, w in words:
        cut = len(w) - int(np.ceil(len(w) * ANSWER_PART)) if len(w) >= 2 * SHINGLE else len(w)
        questions.append(shingles(w[:cut]))
        answers.append(shingles(w[cut:]) if cut < len(w) else questions[-1])
    every = np.concatenate([w for _, w in words])
    terms, term = np.unique(every, return_inverse=True)
    pairs, tf = np.unique(term.astype(np.int64) * n + np.repeat(np.arange(n), lengths), return_counts=True)
    t, d = pairs // n, pairs % n
    df = np.bincount(t, minlength=len(terms))
    whole = whole or Statistics(n, lengths.mean(), terms, df)
    held = whole.df[np.searchsorted(whole.terms, terms)]
    idf = np.log(1 + (whole.n - held + 0.5) / (held + 0.5))
    raw = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[d] / whole.mean))
    impacts = raw / np.bincount(d, raw, minlength=n)[d]
    n_blocks = -(-n // BLOCK)
    keys, first = np.unique(t * n_blocks + d // BLOCK, return_index=True)
    best = np.maximum.reduceat(impacts, first)
    rare, left = np.ones(len(terms), bool), np.zeros(n)
    starts = np.searchsorted(t, np.arange(len(terms) + 1))
    for k in np.argsort(-df, kind="stable"):
        more = left.copy()
        more[d[starts[k] : starts[k + 1]]] += impacts[starts[k] : starts[k + 1]]
        if more.max() > COMMON_SHARE:
            break
        left, rare[k] = more, False
    common_most = np.array([left[b * BLOCK : (b + 1) * BLOCK].max() for b in range(n_blocks)])
    return Index([i for i, _ in words], questions, answers, lengths, terms, starts, d, impacts, np.searchsorted(keys // n_blocks, np.arange(len(terms) + 1)), keys, np.append(first, len(t)), best, rare, common_most, max(LEAST_WINDOW, int(lengths.max())))


@dataclass
class Cells:
    """The cells of some texts' words and the distinct known terms of each, as sorted pairs."""

    base: np.ndarray
    counts: np.ndarray
    cell: np.ndarray
    term: np.ndarray
    last: np.ndarray


def cells_of(index: Index, words: np.ndarray, before: np.ndarray) -> Cells | None:
    size = index.window
    counts = -(-np.diff(before) // size)
    base = np.cumsum(counts) - counts
    term = np.minimum(np.searchsorted(index.terms, words), len(index.terms) - 1)
    known = np.flatnonzero(index.terms[term] == words)
    if not len(known):
        return None
    text = np.searchsorted(before, known, "right") - 1
    cell = base[text] + (known - before[text]) // size
    pairs = common.distinct(cell.astype(np.int64) * len(index.terms) + term[known])
    last = np.zeros(int(counts.sum()), bool)
    last[(base + counts - 1)[counts > 0]] = True
    return Cells(base, counts, pairs // len(index.terms), pairs % len(index.terms), last)


def _in_windows(cells: Cells, first: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, term) of the windows that begin at the cells from first to end: a window has its cell's terms and the next one's."""
    a, b, c = np.searchsorted(cells.cell, [first, end, end + 1])
    inner = cells.cell[a + np.searchsorted(cells.cell[a:c], first + 1) : c] - 1
    held = ~cells.last[inner]
    return np.concatenate([cells.cell[a:b], inner[held]]), np.concatenate([cells.term[a:b], cells.term[c - len(inner) : c][held]])


def hopeful_blocks(index: Index, window: np.ndarray, term: np.ndarray, threshold: float) -> np.ndarray:
    """The sorted window * n_blocks + block whose items can reach the threshold."""
    few = index.rare[term]
    w, t = window[few], term[few]
    n = index.block_at[t + 1] - index.block_at[t]
    entry = common.expand(index.block_at[t], n)
    at = np.repeat(w, n) * index.n_blocks + index.block_keys[entry] % index.n_blocks
    order = np.argsort(at, kind="stable")
    at, best = at[order], index.block_best[entry[order]]
    if not len(at):
        return at
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    bound = np.add.reduceat(best, first)
    return at[first][bound + index.common_most[at[first] % index.n_blocks] >= threshold - 1e-9]


def _scores(index: Index, blocks: np.ndarray, window: np.ndarray, term: np.ndarray) -> np.ndarray:
    """The scores of each hopeful block's items, one row of BLOCK a block; only these blocks' postings are read."""
    pairs = common.distinct(window * len(index.terms) + term)  # a term in both cells of a window counts once
    w, t = pairs // len(index.terms), pairs % len(index.terms)
    of = blocks // index.n_blocks
    lo, hi = np.searchsorted(w, of), np.searchsorted(w, of, "right")
    row = np.repeat(np.arange(len(blocks)), hi - lo)
    key = t[common.expand(lo, hi - lo)] * index.n_blocks + blocks[row] % index.n_blocks
    entry = np.minimum(np.searchsorted(index.block_keys, key), len(index.block_keys) - 1)
    found = index.block_keys[entry] == key
    entry, row = entry[found], row[found]
    n = index.block_from[entry + 1] - index.block_from[entry]
    post = common.expand(index.block_from[entry], n)
    return np.bincount(np.repeat(row, n) * BLOCK + index.items[post] % BLOCK, index.impacts[post], minlength=len(blocks) * BLOCK).reshape(-1, BLOCK)


def search(index: Index, words: np.ndarray, before: np.ndarray, threshold: float = THRESHOLD) -> Iterator[tuple[int, int, float, float, float]]:
    """(text, item, score, question share, answer share) of every window and item at or above the threshold."""
    if threshold <= COMMON_SHARE:
        raise ValueError(f"the threshold must be over {COMMON_SHARE}, what common terms alone may reach")
    cells = cells_of(index, words, before)
    if cells is None:
        return
    size, many = index.window, max(1, WORDS_AT_ONCE // index.window)
    for from_cell in range(0, len(cells.last), many):
        window, term = _in_windows(cells, from_cell, from_cell + many)
        blocks = hopeful_blocks(index, window, term, threshold)
        if not len(blocks):
            continue
        score = _scores(index, blocks, window, term)
        for row, k in zip(*np.nonzero(score >= threshold - 1e-9), strict=True):
            at, item = int(blocks[row] // index.n_blocks), int(blocks[row] % index.n_blocks) * BLOCK + int(k)
            doc = int(np.searchsorted(cells.base + cells.counts, at, "right"))
            start = before[doc] + (at - cells.base[doc]) * size
            held = words[start : min(start + 2 * size, before[doc + 1])]
            yield doc, item, float(score[row, k]), _share(index.questions[item], held, index.lengths[item]), _share(index.answers[item], held, index.lengths[item])


def _share(wanted: np.ndarray, held: np.ndarray, n_words: int) -> float:
    """The share of an item part's shingles among those of a passage; a part of fewer words than a shingle has one shorter shingle."""
    for n in range(min(SHINGLE, n_words), 0, -1):
        found = np.isin(wanted, common.chained(held, n)).mean()
        if found or len(wanted) > 1:
            return float(found)
    return 0.0


def _terms(items: DataFrame) -> DataFrame:
    """(term, n_words): the distinct terms of each item, as signed numbers, and once an item its words with a null term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in common.text_steps(batch):
                words, before = words_of(data, offsets)
                for a, b in zip(before[:-1], before[1:], strict=True):
                    if b > a:
                        terms = common.distinct(words[a:b]).view(np.int64)
                        yield pa.record_batch({"term": pa.array([None, *terms.tolist()], pa.int64()), "n_words": pa.array([int(b - a)] + [0] * len(terms), pa.int64())})

    return items.select("text").mapInArrow(run, "term bigint, n_words bigint")


def _slice_bounds(sizes: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """(least size, greatest size, part, parts) of the slices, from the characters of the items of each size, in order.

    Neighbouring sizes share a slice while they fit; a size with more is dealt into parts.
    """
    out, low, held = [], None, 0
    for size, chars in sizes:
        if low is not None and held + chars > SLICE_CHARS:
            out.append((low, high, 0, 1))
            low, held = None, 0
        parts = -(-chars // SLICE_CHARS)
        if parts > 1:
            out += [(size, size, k, parts) for k in range(parts)]
            continue
        low, high, held = size if low is None else low, size, held + chars
    return out + ([(low, high, 0, 1)] if low is not None else [])


def _slices(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes of all items, each of about SLICE_CHARS of text; the driver holds one slice at a time, and a number for each size of item."""
    sized = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull()).withColumn("size", F.length("text"))
    sizes = [(r["size"], r["chars"]) for r in sized.groupBy("size").agg(F.sum(F.col("size").cast("long")).alias("chars")).orderBy("size").collect()]
    bounds = _slice_bounds(sizes)
    if len(bounds) > 1:
        counts = common.written(_terms(sized).groupBy("term").agg(F.count("*").alias("df"), F.sum("n_words").alias("n_words")), "terms")
        total = counts.where("term is null").first()
    for low, high, part, parts in bounds:
        some = sized.where(F.col("size").between(low, high) & (F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part))
        items = [(r["item_id"], r["text"]) for r in some.orderBy("size", "item_id", "text").collect()]
        whole = None
        if len(bounds) > 1 and total:
            held = counts.join(_terms(some).select("term").distinct(), "term").select("term", "df").toArrow()  # a slice's terms
            terms = held.column("term").to_numpy().view(np.uint64)
            order = np.argsort(terms)
            whole = Statistics(total["df"], total["n_words"] / total["df"], terms[order], held.column("df").to_numpy()[order])
        if index := build(items, whole):
            yield index


def _leaks(index: Index, batch: pa.RecordBatch, threshold: float) -> dict[tuple[int, int], tuple[float, float, float]]:
    """(question share, answer share, score) of each verified (row, item)."""
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    for first, _, data, offsets in common.text_steps(batch):
        words, before = words_of(data, offsets)
        for doc, item, score, question, answer in search(index, words, before, threshold):
            if question >= QUESTION_SHARE and answer >= ANSWER_SHARE:
                key = (first + doc, index.item_ids[item])
                best[key] = max(best.get(key, (0.0, 0.0, 0.0)), (question, answer, score))
    return best


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document and test item that it holds; no row for clean documents.

    Null and empty texts hold nothing, null or empty items are in no document, repeated documents have a row each, and repeated
    items are told once. Of a very long text the windows of WORDS_AT_ONCE words are searched at once. Columns but doc_id, text,
    item_id and text aren't read; without documents or items there are no rows.
    """
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def find(index: Index) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                best = _leaks(shared.value, batch, threshold)
                ids = batch.column("doc_id").to_pylist() if best else []
                cols = {"doc_id": pa.array([ids[d] for d, _ in best], pa.int64()), "item_id": pa.array([i for _, i in best], pa.int64())}
                for k, name in ((2, "score"), (0, "question_overlap"), (1, "answer_overlap")):
                    cols[name] = pa.array([v[k] for v in best.values()], pa.float64())
                yield pa.record_batch(cols)

        return kept.mapInArrow(run, SCHEMA)

    out = None
    for index in _slices(benchmark):
        out = find(index) if out is None else out.unionByName(find(index))
    return out if out is not None else docs.sparkSession.createDataFrame([], SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that hold no test item, with all their columns, whatever their names; without items all rows."""

    def keep(docs: DataFrame, index: Index) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = np.ones(batch.num_rows, bool)
                good[[d for d, _ in _leaks(shared.value, batch, threshold)]] = False
                yield batch.filter(pa.array(good))

        return docs.mapInArrow(run, docs.schema)

    for index in _slices(benchmark):
        docs = keep(docs, index)
    return docs
