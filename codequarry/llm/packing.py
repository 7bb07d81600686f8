"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

A piece of n tokens is of class j, the largest j with j * n <= capacity, and a sequence of class j takes exactly j pieces,
so each task fills its sequences alone. The last class holds all shorter pieces, down to one token, and takes as many as fit.
Documents are cut where that saves padding: a remainder that would leave much of its slot empty gives off a piece that fills
the next class's slot. What a task can't complete goes to the next round over fewer tasks, and of the last round less than
a sequence a class remains, which is placed first-fit by falling length.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import written

CAPACITY, CLASSES, END_ID = 4096, 64, 2
#: A slot may stay empty by this share of the piece, or so many tokens.
SLACK, SLACK_TOKENS = 0.02, 8
#: Of each round's tasks, so many hand their incomplete sequences to one task of the next.
FAN_IN = 32
#: Distinct words that a worker remembers, and their characters: a run without spaces is one word, however long.
WORDS_HELD, CHARS_HELD = 400_000, 4_000_000
TOKENIZER = "word_bpe_49k.json"

_COLS = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, class int"
SCHEMA = f"{_COLS}, sequence_id bigint, offset bigint"


_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")
#: The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from 256 on.
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHER = [b for b in range(256) if b not in _SELF]
_BYTE_CHARS = {b: chr(b) for b in _SELF} | {b: chr(256 + n) for n, b in enumerate(_OTHER)}


class Runs:
    """Runs of ids, one behind the other, that are read by their numbers."""

    def __init__(self):
        self.flat, self.used, self.starts, self.lengths = np.zeros(1 << 16, np.uint32), 0, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def extend(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(ids), len(self.flat)), np.uint32)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.used += len(ids)

    def __getitem__(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the runs numbered at, and how many each has."""
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        return self.flat[np.repeat(self.starts[at] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)], lengths


class WordTokenizer:
    """Ids of whole texts, for a tokenizer that treats words between spaces and line ends alone and drops white space."""

    def __init__(self, path: str, specials: bool = True):
        """specials: whether the strings of special tokens in a text give their ids."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not specials
        self.plain = Tokenizer.from_file(path)  # for words in their normal form already
        self.plain.normalizer, self.plain.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        self.marks = {"": 0} | {m: self.tokenizer.encode(m, add_special_tokens=False).ids[0] for m in ".,"}
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.cores: dict[str, int] = {}
        self.words, self.plain_words, self.chars = Runs(), Runs(), 0

    def plain_ids(self, cores: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of lower-case Latin words, and their counts: each word's last id, and no other, is one that ends words."""
        joined = [" ".join(["".join(map(_BYTE_CHARS.__getitem__, c.encode())) for c in cores[i : i + 2000]]) for i in range(0, len(cores), 2000)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.plain.encode_batch_fast(joined, add_special_tokens=False)])
        last = np.flatnonzero(self.ends[ids])
        return ids, np.diff(last, prepend=-1)

    def learn(self, words: list[str]) -> None:
        """A run of Latin letters, perhaps with a mark behind it, goes to the model without normalisation, as its normal form
        is its lower case and the mark is a word of its own; all else takes the tokenizer's whole way."""
        rest, plain, at, marks, fresh, cores = [], [], [], [], [], self.cores
        for w in words:
            m = _PLAIN.fullmatch(w)
            if not m:
                rest.append(w)
                continue
            core, mark = m.groups()
            core = core.lower()
            k = cores.get(core)
            if k is None:
                k = cores[core] = len(cores)
                fresh.append(core)
            plain.append(w)
            at.append(k)
            marks.append(self.marks[mark])
        if fresh:
            self.plain_words.extend(*self.plain_ids(fresh))
        self.known.update(zip(plain + rest, range(len(self.known), len(self.known) + len(words)), strict=True))
        if plain:
            ids, counts = self.plain_words[np.array(at)]
            marks = np.array(marks, np.uint32)
            ends = np.cumsum(counts)[marks > 0]
            self.words.extend(np.insert(ids, ends, marks[marks > 0]), counts + (marks > 0))
        if rest:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
            counts = np.fromiter(map(len, found), np.int64, len(found))
            self.words.extend(np.fromiter(chain.from_iterable(found), np.uint32, int(counts.sum())), counts)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the ids before each text."""
        words = [t.replace("\n", " ").split(" ") for t in texts]
        every = [w for ws in words for w in ws]
        if len(self.known) > WORDS_HELD or self.chars > CHARS_HELD:
            self.forget()
        if new := set(every).difference(self.known):
            self.learn(list(new))
            self.chars += sum(map(len, new))
        ids, lengths = self.words[np.fromiter(map(self.known.__getitem__, every), np.int64, len(every))]
        before = np.concatenate([[0], np.cumsum(lengths)])
        return ids, before[np.concatenate([[0], np.cumsum([len(ws) for ws in words])]).astype(np.int64)]


@lru_cache(maxsize=2)
def tokenizer(path: str, specials: bool = True) -> WordTokenizer:
    """The worker's tokenizer, which keeps the words it knows from task to task."""
    return WordTokenizer(path, specials)


def class_of(n: int) -> int:
    return min(CLASSES, CAPACITY // n)


@lru_cache(maxsize=CAPACITY + 1)
def cut(n: int) -> tuple[tuple[int, int], ...]:
    """(length, class) of the pieces of a remainder of n tokens, at most the capacity."""
    out = []
    while n:
        j = class_of(n)
        slot = CAPACITY // j
        if j == CLASSES or slot - n <= max(SLACK_TOKENS, SLACK * n):
            out.append((n, j))
            break
        piece = CAPACITY // (j + 1)
        out.append((piece, j + 1))
        n -= piece
    return tuple(out)


class Bins:
    """The open sequences of one task, one a class; its ids tell the round, the task and a counter."""

    def __init__(self, round_no: int, task: int):
        self.base, self.count, self.open, self.tokens = (round_no << 56) + (task << 32), 0, {}, 0
        self.done: list[tuple] = []

    def close(self, pieces: list[tuple]) -> None:
        offset = 0
        for p in pieces:
            self.done.append((*p, self.base + self.count, offset))
            offset += p[2]
        self.count += 1

    def add(self, piece: tuple) -> None:
        """Fixed numbers of pieces fill the sequences; those of the last class, which has no least length, are filled by tokens."""
        j = piece[5]
        if j == CLASSES and self.tokens + piece[2] > CAPACITY:
            self.close(self.open.pop(j))
            self.tokens = 0
        held = self.open.setdefault(j, [])
        held.append(piece)
        if j == CLASSES:
            self.tokens += piece[2]
        elif len(held) == j:
            self.close(self.open.pop(j))

    def leave(self) -> None:
        """What is incomplete leaves without a sequence."""
        for pieces in self.open.values():
            self.done += [(*p, None, None) for p in pieces]
        self.open, self.tokens = {}, 0

    def finish(self) -> None:
        """What is incomplete is placed first-fit by falling length."""
        rest = sorted((p for pieces in self.open.values() for p in pieces), key=lambda p: (-p[2], p[0] is None, p[0] or 0, p[1], p[3]))
        bins: list[list[tuple]] = []
        room: list[int] = []
        for p in rest:
            k = next((k for k, r in enumerate(room) if r >= p[2]), None)
            if k is None:
                bins.append([])
                room.append(CAPACITY)
                k = len(bins) - 1
            bins[k].append(p)
            room[k] -= p[2]
        for pieces in bins:
            self.close(pieces)
        self.open, self.tokens = {}, 0

    def batch(self) -> pa.RecordBatch:
        rows, self.done = self.done, []
        cols = list(zip(*rows, strict=True)) if rows else [()] * 8
        kinds = (pa.int64(),) * 5 + (pa.int32(), pa.int64(), pa.int64())
        names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "sequence_id", "offset")
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def pieces_of(doc_id, ids: np.ndarray) -> Iterator[tuple]:
    """(doc, start, length, crc, doc tokens, class) of the pieces of one document's ids."""
    n, start, data = len(ids), 0, memoryview(ids.astype("<u4").tobytes())
    while start < n:
        for length, j in ((CAPACITY, 1),) if n - start >= CAPACITY else cut(n - start):
            yield doc_id, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), n, j
            start += length


def _steps(batch: pa.RecordBatch, rows: int = 256, chars: int = 1 << 20) -> Iterator[tuple[list, list[str]]]:
    ids, texts, held = [], [], 0
    for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
        text = t.as_py() or ""
        ids.append(d)
        texts.append(text)
        held += len(text)
        if len(ids) >= rows or held >= chars:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def pack(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most CAPACITY tokens.

    A null or empty text has its end id alone; repeated rows are packed each; a null id stays null. An empty table has no rows.
    A very long text is a step of its own and is cut to as many pieces as it takes. Columns but doc_id and text aren't read.
    """
    path = path or public_tokenizers.path(TOKENIZER)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, bins = tokenizer(path), Bins(0, TaskContext.get().partitionId())
        for batch in batches:
            for doc_ids, texts in _steps(batch):
                ids, before = coder(texts)
                for k, d in enumerate(doc_ids):
                    for piece in pieces_of(d, np.append(ids[before[k] : before[k + 1]], END_ID)):
                        bins.add(piece)
                yield bins.batch()
        bins.leave()
        yield bins.batch()

    def later(round_no: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bins = Bins(round_no, TaskContext.get().partitionId())
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    bins.add(row)
                yield bins.batch()
            bins.finish() if last else bins.leave()
            yield bins.batch()

        return run

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tasks = source.rdd.getNumPartitions()
    done = written(source.mapInArrow(first, SCHEMA), "packed")
    complete, round_no = done.where(F.col("sequence_id").isNotNull()), 0
    while True:
        round_no, tasks = round_no + 1, -(-tasks // FAN_IN)
        left = done.where(F.col("sequence_id").isNull()).drop("sequence_id", "offset")
        done = written(left.repartition(max(tasks, 1)).mapInArrow(later(round_no, tasks <= 1), SCHEMA), "packed")
        complete = complete.unionByName(done.where(F.col("sequence_id").isNotNull()))
        if tasks <= 1:
            return complete
