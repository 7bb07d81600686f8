"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

Words are lower-cased runs of bytes between white space and punctuation. A word's embedding is the sum of hashed rows for
the word and its beginnings; filters of several widths run over the embeddings, the largest response of each filter is
kept for the document, and a logistic unit reads those. Thresholds are calibrated for each language, where the language
is guessed from the text's own function words, and folded into the score so that 0.5 is the threshold everywhere.
The model is fit on at most SAMPLE labelled rows, each with its whole text, of at most SAMPLE_CHARS code points in all.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codequarry.llm import common

SAMPLE, SAMPLE_CHARS = 6000, 24_000_000
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 16, 8, (1, 2, 3), 8
EPOCHS, BATCH, RATE, SEED = 6, 64, 0.05, 7
#: Beginnings of so many bytes are hashed beside the whole word.
STEMS = (4, 5, 6)
#: Function words that tell a text's language for calibration only.
FUNCTION_WORDS = {
    "en": "the and of to in is that it for with",
    "fr": "le la les des et que dans un une pour",
    "de": "der die und das ist nicht ein eine mit den",
    "es": "el los las que y de por una con se",
}
GROUPS = (*FUNCTION_WORDS, "other")
_SEPS = common.separators(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")
SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int"


def _word_group() -> tuple[np.ndarray, np.ndarray]:
    pairs = {}
    for no, words in enumerate(FUNCTION_WORDS.values()):
        for w in words.split():
            data = np.frombuffer(w.encode(), np.uint8)
            pairs.setdefault(int(common.word_hashes(data, np.array([0]), np.array([len(data)]))[0]), no)
    keys = np.array(sorted(pairs), np.uint64)
    return keys, np.array([pairs[int(k)] for k in keys])


_KEYS, _KEY_GROUP = _word_group()


def encoded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature rows of each word, the words of each document as offsets, and each document's language group."""
    lower = common.LOWER[data]
    starts, ends = common.word_bounds(lower, offsets, _SEPS)
    whole = common.word_hashes(lower, starts, ends)
    cols = [whole]
    for n in STEMS:
        cols.append(common.mixed(common.word_hashes(lower, starts, np.minimum(ends, starts + n)) + np.uint64(n)))
    feats = np.stack([(c % np.uint64(BUCKETS)).astype(np.int32) for c in cols], 1) if len(starts) else np.zeros((0, len(cols)), np.int32)
    words = np.searchsorted(starts, offsets)
    n_docs = len(offsets) - 1
    at = np.minimum(np.searchsorted(_KEYS, whole), len(_KEYS) - 1)
    hit = _KEYS[at] == whole if len(whole) else np.zeros(0, bool)
    doc = np.repeat(np.arange(n_docs), np.diff(words))
    votes = np.bincount(doc[hit] * len(GROUPS) + _KEY_GROUP[at[hit]], minlength=n_docs * len(GROUPS)).reshape(n_docs, len(GROUPS))
    votes[:, -1] = votes.max(1) == 0
    return feats, words, votes.argmax(1)


class Net:
    def __init__(self, rng: np.random.Generator):
        self.emb = rng.normal(0, 0.02, (BUCKETS, DIM)).astype(np.float32)
        self.filters = {w: rng.normal(0, 0.3 / np.sqrt(w * DIM), (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
        for w in WIDTHS:  # the first filter of each width starts as the warm coordinate of its first word
            self.filters[w][:, 0] = 0
            self.filters[w][0, 0] = 1
        self.out = np.zeros(len(WIDTHS) * FILTERS + 1, np.float32)
        self.out[[k * FILTERS for k in range(len(WIDTHS))]] = 0.5
        self.shift = np.zeros(len(GROUPS), np.float32)

    def pooled(self, feats: np.ndarray, words: np.ndarray, argmax: bool = False):
        """The largest response of each filter in each document (0 without words), and where it stood."""
        n = len(words) - 1
        has = np.flatnonzero(np.diff(words) > 0)
        pools = np.zeros((n, len(WIDTHS) * FILTERS), np.float32)
        places = np.zeros_like(pools, np.int64) if argmax else None
        if not len(has):
            return pools, places, None
        vec = self.emb[feats[:, 0]]
        for k in range(1, feats.shape[1]):
            vec = vec + self.emb[feats[:, k]]
        pad = np.zeros((max(WIDTHS), DIM), np.float32)
        wide = np.concatenate([vec, pad])
        last = np.repeat(words[1:], np.diff(words))
        for k, w in enumerate(WIDTHS):
            total = np.zeros((len(vec), FILTERS), np.float32)
            for j in range(w):
                part = wide[j : j + len(vec)] @ self.filters[w][j * DIM : (j + 1) * DIM]
                if j:  # words beyond the document's end count as zero
                    part[np.arange(len(vec)) + j >= last] = 0
                total += part
            best = np.maximum.reduceat(total, words[:-1][has], 0)
            pools[has, k * FILTERS : (k + 1) * FILTERS] = best
            if argmax:
                for f in range(FILTERS):
                    at = np.flatnonzero(total[:, f] == np.repeat(best[:, f], np.diff(words)[has]))
                    _, first = np.unique(np.searchsorted(words, at, "right") - 1, return_index=True)
                    places[has, k * FILTERS + f] = at[first]
        return pools, places, vec

    def logits(self, feats: np.ndarray, words: np.ndarray, groups: np.ndarray) -> np.ndarray:
        return self.pooled(feats, words)[0] @ self.out[:-1] + self.out[-1] - self.shift[groups]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _warm(net: Net, feats: np.ndarray, doc: np.ndarray, y: np.ndarray) -> None:
    """The first coordinate starts as the log odds of each hashed row, in standard errors: rare rows start near 0."""
    n1, n0 = max(y.sum(), 1), max((1 - y).sum(), 1)
    counts = np.zeros((2, BUCKETS))
    for k in range(feats.shape[1]):
        pairs = np.unique(doc.astype(np.int64) * BUCKETS + feats[:, k])
        counts[1] += np.bincount(pairs[y[pairs // BUCKETS] == 1] % BUCKETS, minlength=BUCKETS)
        counts[0] += np.bincount(pairs[y[pairs // BUCKETS] == 0] % BUCKETS, minlength=BUCKETS)
    odds = np.log((counts[1] + 0.5) / (n1 + 1)) - np.log((counts[0] + 0.5) / (n0 + 1))
    error = np.sqrt(1 / (counts[1] + 0.5) + 1 / (counts[0] + 0.5))
    net.emb[:, 0] = np.where(counts.sum(0) > 1, np.clip(odds / error, -2, 6), 0) / 2


def train(texts: list[str], labels: np.ndarray) -> Net:
    """A net with calibrated shifts; without both labels, one that gives every text the score 0 or 1 of the label there is."""
    rng = np.random.default_rng(SEED)
    net = Net(rng)
    y = np.asarray(labels, np.int64)
    if not len(y) or y.min() == y.max():
        net.out[:] = 0
        net.out[-1] = 5 if len(y) and y[0] else -5
        return net
    body = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, body)])
    feats, words, groups = encoded(np.frombuffer(b"".join(body), np.uint8), offsets)
    tune = np.arange(len(y)) % 4 == 3  # a quarter calibrates the thresholds
    doc = np.repeat(np.arange(len(y)), np.diff(words))
    fit = ~tune[doc]
    remap = np.cumsum(~tune) - 1
    _warm(net, feats[fit], remap[doc[fit]], y[~tune])
    weight = np.where(y == 1, (y == 0).sum() / (y == 1).sum(), 1.0) ** 0.5
    grads = {"emb": np.full((BUCKETS, DIM), 1e-4, np.float32), "out": np.full(len(net.out), 1e-4, np.float32)} | {w: np.full(net.filters[w].shape, 1e-4, np.float32) for w in WIDTHS}
    ids = np.flatnonzero(~tune)
    for _ in range(EPOCHS):
        rng.shuffle(ids)
        for some in (ids[i : i + BATCH] for i in range(0, len(ids), BATCH)):
            rows = np.concatenate([np.arange(words[d], words[d + 1]) for d in some])
            _step(net, grads, feats[rows], np.cumsum([0, *(words[some + 1] - words[some])]), y[some], weight[some])
    _calibrate(net, feats, words, groups, y, tune)
    return net


def _step(net: Net, grads: dict, feats: np.ndarray, words: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
    """One step of AdaGrad; through the pooling, only each filter's best place in each document learns."""
    pools, places, vec = net.pooled(feats, words, argmax=True)
    if vec is None:
        return
    err = (weight * (sigmoid(pools @ net.out[:-1] + net.out[-1]) - y) / len(y)).astype(np.float32)

    def move(held: np.ndarray, key, grad: np.ndarray, rate: float = RATE) -> None:
        grads[key] += grad * grad
        held -= rate * grad / np.sqrt(grads[key])

    back = err[:, None] * net.out[:-1]
    has = np.diff(words) > 0
    dvec = np.zeros_like(vec)
    d_filters = {}
    last = words[1:]
    for k, w in enumerate(WIDTHS):
        d_filters[w] = np.zeros_like(net.filters[w])
        for f in range(FILTERS):
            at, g = places[has, k * FILTERS + f], back[has, k * FILTERS + f]
            for j in range(w):
                ok = at + j < last[has]
                d_filters[w][j * DIM : (j + 1) * DIM, f] = g[ok] @ vec[at[ok] + j]
                np.add.at(dvec, at[ok] + j, g[ok][:, None] * net.filters[w][j * DIM : (j + 1) * DIM, f])
    move(net.out, "out", np.append(err @ pools, err.sum()) + 1e-4 * net.out)
    for w in WIDTHS:
        move(net.filters[w], w, d_filters[w], RATE / 5)
    used = np.flatnonzero(np.abs(dvec).sum(1) > 0)
    rows, inverse = np.unique(feats[used], return_inverse=True)
    grad = np.zeros((len(rows), DIM), np.float32)
    np.add.at(grad, inverse.reshape(-1), np.repeat(dvec[used], feats.shape[1], 0))
    grads["emb"][rows] += grad * grad
    net.emb[rows] -= RATE * grad / np.sqrt(grads["emb"][rows])


def _calibrate(net: Net, feats: np.ndarray, words: np.ndarray, groups: np.ndarray, y: np.ndarray, tune: np.ndarray) -> None:
    """For each language the shift between the classes with the fewest errors; too few rows: that of all languages."""
    raw = np.concatenate([net.logits(feats[words[i] : words[min(i + 256, len(y))]], words[i : min(i + 256, len(y)) + 1] - words[i], groups[i : i + 256]) for i in range(0, len(y), 256)])

    def best(mask: np.ndarray) -> float | None:
        pos, neg = np.sort(raw[mask & (y == 1)]), np.sort(raw[mask & (y == 0)])
        if len(pos) < 3 or len(neg) < 3:
            return None
        cuts = np.unique(np.concatenate([pos, neg]))
        cuts = (cuts[1:] + cuts[:-1]) / 2 if len(cuts) > 1 else cuts
        errors = np.searchsorted(pos, cuts) / len(pos) + (len(neg) - np.searchsorted(neg, cuts)) / len(neg)
        good = cuts[errors == errors.min()]
        return float((good[0] + good[-1]) / 2)

    overall = best(tune)
    overall = overall if overall is not None else (best(np.ones_like(tune)) or 0.0)
    for g in range(len(GROUPS)):
        found = best(tune & (groups == g))
        net.shift[g] = overall if found is None else found


def score(docs: DataFrame, net: Net, *keep: str) -> DataFrame:
    """The columns `keep` of docs, score and predicted; null and empty texts are scored as texts without words."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    kept = docs.select(F.col("text").alias("_scored"), *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[1:]) + ", score double, predicted int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            out = [np.zeros(0)]
            for _, _, data, offsets in common.text_steps(batch, "_scored"):
                out.append(sigmoid(model.logits(*encoded(data, offsets)).astype(np.float64)))
            s = np.concatenate(out)
            cols = {k: batch.column(k) for k in keep}
            yield pa.record_batch(cols | {"score": pa.array(s), "predicted": pa.array((s >= 0.5).astype(np.int32))})

    return kept.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, learnable) -> Net:
    """Train on at most SAMPLE labelled rows, picked by a hash of the id; rows without a label or a text teach nothing.

    Of these rows the shortest are taken as long as they hold SAMPLE_CHARS code points together; each is learned whole.
    """
    known = labels.where(learnable & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(some), "doc_id").select("doc_id", "text", "toxic")
    lengths = rows.select("doc_id", F.length("text").cast("long").alias("size")).groupBy("size").count()  # SAMPLE rows, and repeats of their ids
    so_far = F.sum(F.col("size") * F.col("count")).over(Window.orderBy("size").rowsBetween(Window.unboundedPreceding, 0))
    longest = lengths.withColumn("so_far", so_far).where(F.col("so_far") <= SAMPLE_CHARS).agg(F.max("size")).first()[0]
    rows = rows.where(F.length("text") <= F.lit(longest if longest is not None else -1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["doc_id"], r["text"]))
        order = np.random.default_rng(SEED).permutation(len(found))
        net = train([found[i]["text"] for i in order], np.array([found[i]["toxic"] for i in order]))
        yield pa.record_batch({"net": pa.array([pickle.dumps(net)], pa.binary())})

    told = rows.repartition(1).mapInArrow(run, "net binary").collect()  # one task trains on the sample; only the net returns
    return pickle.loads(told[0]["net"]) if told else train([], np.zeros(0, np.int64))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labels outside fold 0 of 5 and score every document: one row each, repeated rows and null ids included.

    Texts that are null or without words have the score of a text without words; an empty table has no rows; a very long text is
    a step of its own. Columns but doc_id and text aren't read.
    """
    fold = common.crc_fold("doc_id", 5)
    net = fit(docs, labels, fold != 0)
    return score(docs.select("doc_id", "text").withColumn("held_out", fold == 0), net, "doc_id", "held_out")
