"""Removal of long byte strings that repeat across documents, by suffix arrays of shards.

Each window of `length` bytes is assigned to its anchor, the ANCHOR bytes in it with the least hash, so equal windows have
equal anchors wherever they stand. Runs of windows with one anchor travel as one string to the anchor's shard, once for
all equal strings of a step. An anchor with more than a shard's share is split by what stands beside it in the windows. A shard keeps strings that may share a window with another document, sorts the suffixes of
the distinct ones by induction, and reads from the permuted common prefixes which windows are equal; of those the smallest
document keeps its bytes. The ranges that the others lose meet their texts again by blocks of documents.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm import common
from codequarry.llm.suffixes import common_prefixes, suffix_array

#: ANCHOR is what anchors_of reads.
LENGTH, ANCHOR = 50, 6
#: Bytes of text a shard stands for (its strings have about three times as many), and that are cut into strings at once.
SHARD_TEXT, STEP_TEXT = 3 << 20, 4 << 20
#: Bytes of strings hashed at once in a shard, and windows of records that are looked at once.
HASHED, EXPANDED = 1 << 19, 1 << 21
#: Bytes of a longer text that are cut at once.
PIECE = 4 << 20
#: Bytes of text that tell about how often anchors stand, which decides how even shards are, not what meets; and shards' shares that an anchor may have.
TOLD_TEXT, SHARES = 16 << 20, 2
#: Documents whose ids agree but for so many low bits are blocked together for the last step.
BLOCK_BITS = 8
NO_ID, NONE = np.iinfo(np.int64).max, np.zeros(0, np.uint64)
#: Fields of a packed string.
FIELDS = np.dtype([("doc", "<i8"), ("crc", "<u2"), ("start", "<u4"), ("size", "u1"), ("anchor", "u1")])
SCHEMA = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums and inverse powers, from which the hash of any range follows."""
    n = len(data)
    powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1])])
    return sums, np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, _INVERSE)]))


def _range_hash(sums: tuple[np.ndarray, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return common.mixed((sums[0][b] - sums[0][a]) * sums[1][a] + (b - a).astype(np.uint64))


def anchors_of(data: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The place of each window's anchor, the first of equal ones; one value for each of the len(data) - length + 1 windows."""
    one = data.astype(np.uint64)
    two = one[:-1] | one[1:] << np.uint64(8)
    x = two[:-4] | two[2:-2] << np.uint64(16) | two[4:] << np.uint64(32)
    key = common.mixed(x) & ~np.uint64((1 << 24) - 1) | np.arange(len(x), dtype=np.uint64)
    span, want = 1, length - ANCHOR + 1
    while 2 * span <= want:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if span < want:
        key = np.minimum(key[: len(key) - (want - span)], key[want - span :])
    return (key & np.uint64((1 << 24) - 1)).astype(np.int64)


def strings_of(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end, anchor) of the runs of windows with one anchor; they cover all windows within texts."""
    none = (np.zeros(0, np.int64),) * 4
    if len(data) < length:
        return none
    anchor = anchors_of(data, length)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchor)]
    inside = np.arange(len(anchor)) + length <= offsets[text + 1]
    at = np.flatnonzero(inside)
    if not len(at):
        return none
    new = np.concatenate([[True], (np.diff(at) > 1) | (anchor[at[1:]] != anchor[at[:-1]]) | (text[at[1:]] != text[at[:-1]])])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return text[at[first]], at[first], at[last] + length, anchor[at[first]]


def _crcs(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """16 bits of the crc32 of each text: what tells rows with one id and different texts apart."""
    held = memoryview(np.ascontiguousarray(data))
    return np.array([zlib.crc32(held[a:b]) & 0xFFFF for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.uint16)


def _pieces(batch: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(ids, crcs, places in their documents, bytes, offsets) of texts; a text over PIECE comes in pieces that share length - 1 bytes."""
    ids = np.array([NO_ID if d is None else d for d in batch.column("doc_id").to_pylist()], np.int64)
    for row, end, data, offsets in common.text_steps(batch):
        crcs = _crcs(data, offsets)
        if end - row == 1 and len(data) > PIECE:
            for a in range(0, len(data) - length + 1, PIECE):
                part = data[a : a + PIECE + length - 1]
                yield ids[row:end], crcs, np.array([a]), part, np.array([0, len(part)])
        else:
            yield ids[row:end], crcs, np.zeros(end - row, np.int64), data, offsets


def _frequent(docs: DataFrame, total: int, shards: int, length: int) -> np.ndarray:
    """The hashes, in order, of the anchors whose strings would fill more than SHARES shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, data, offsets in _pieces(batch, length):
                _, start, end, anchor = strings_of(data, offsets, length)
                told, at = np.unique(_range_hash(_sums(data), anchor, anchor + ANCHOR), return_inverse=True)
                yield pa.record_batch({"anchor": pa.array(told.view(np.int64)), "size": pa.array(np.bincount(at, end - start, len(told)).astype(np.int64))})

    if shards <= SHARES:
        return NONE
    part, scratch = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").sample(min(1.0, TOLD_TEXT / total), seed=0), common.Scratch(docs.sparkSession)
    sizes = scratch.write("anchors", part.mapInArrow(run, "anchor bigint, size bigint").groupBy("anchor").agg(F.sum("size").alias("size")))
    share = (sizes.agg(F.sum("size")).first()[0] or 0) * SHARES / shards
    found = [r["anchor"] for r in sizes.where(F.col("size") > share).select("anchor").collect()]
    scratch.drop("anchors")
    return np.sort(np.array(found, np.int64).view(np.uint64))


def _cut(docs: DataFrame, shards: int, length: int, frequent: np.ndarray = NONE) -> DataFrame:
    """(shard, packed): the strings of each step, by shard; of equal ones in a step, all their documents but one string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, held, size = zstandard.ZstdCompressor(level=3), [], 0
        for batch in batches:
            for piece in _pieces(batch, length):
                held.append(_told(*piece, shards, length, frequent))
                size += len(piece[3])
                if size >= STEP_TEXT:
                    yield from _packed(held, coder)
                    held, size = [], 0
        yield from _packed(held, coder)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "shard int, packed binary")


def _side(length: int) -> int:
    """Bytes beside the anchor, on one side at least, that each window has."""
    return (length - ANCHOR) // 2 - (length - ANCHOR) % 2


def _told(ids: np.ndarray, crcs: np.ndarray, place: np.ndarray, data: np.ndarray, offsets: np.ndarray, shards: int, length: int, frequent: np.ndarray = NONE) -> tuple[np.ndarray, ...]:
    """The bytes, fields, shards, hashes and starts of a piece's strings.

    A frequent anchor's windows that begin a side before it or earlier go by that side too, the others by the side behind it.
    """
    text, start, end, anchor = strings_of(data, offsets, length)
    rows = np.zeros(len(text), FIELDS)
    if not len(text):
        return data, rows, text, np.zeros(0, np.uint64), start
    sums = _sums(data)
    key = _range_hash(sums, anchor, anchor + ANCHOR)
    split = np.isin(key, frequent)
    if split.any():
        side, first, last, at = _side(length), start[split], end[split] - length, anchor[split]
        left, right = np.flatnonzero(first <= at - side), np.flatnonzero(last > at - side)
        text = np.concatenate([text[~split], text[split][left], text[split][right]])
        start = np.concatenate([start[~split], first[left], np.maximum(first, at - side + 1)[right]])
        end = np.concatenate([end[~split], np.minimum(last, at - side)[left] + length, last[right] + length])
        key = np.concatenate([key[~split], _range_hash(sums, at[left] - side, at[left] + ANCHOR), _range_hash(sums, at[right], at[right] + ANCHOR + side)])
        anchor = np.concatenate([anchor[~split], at[left], at[right]])
        rows = np.zeros(len(text), FIELDS)
    rows["doc"], rows["crc"], rows["start"], rows["size"], rows["anchor"] = ids[text], crcs[text], place[text] + start - offsets[text], end - start, anchor - start
    return data, rows, (key % np.uint64(shards)).astype(np.int32), _range_hash(sums, start, end), start


def _planes(rows: np.ndarray) -> bytes:
    """The fields' bytes, all first ones before all second ones: high bytes are alike, so they compress away."""
    return b"".join(np.ascontiguousarray(rows[f]).view(np.uint8).reshape(len(rows), -1).T.tobytes() for f in FIELDS.names)


def _packed(held: list[tuple[np.ndarray, ...]], coder: zstandard.ZstdCompressor) -> Iterator[pa.RecordBatch]:
    base = np.cumsum([0, *(len(h[0]) for h in held)])
    if not sum(len(h[1]) for h in held):
        return
    data, rows, shard, told = (np.concatenate([h[k] for h in held]) for k in range(4))
    start = np.concatenate([h[4] + b for h, b in zip(held, base[:-1], strict=True)])
    order = np.lexsort((told, shard))
    rows, shard, told, start = rows[order], shard[order], told[order], start[order]
    size = rows["size"].astype(np.int64)
    fresh = np.concatenate([[True], (told[1:] != told[:-1]) | (shard[1:] != shard[:-1])])
    rows["size"][~fresh] = 0  # the string is the one before
    cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
    out = []
    for a, b in zip(cuts, np.append(cuts[1:], len(shard)), strict=True):
        k = a + np.flatnonzero(fresh[a:b])
        out.append(coder.compress(np.int64(b - a).tobytes() + _planes(rows[a:b]) + data[common.expand(start[k], size[k])].tobytes()))
    yield pa.record_batch({"shard": pa.array(shard[cuts], pa.int32()), "packed": pa.array(out, pa.binary())})


def _unpacked(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fields of all records, their strings' numbers, and the strings as bytes with offsets."""
    fields, bodies, decoder = [], [], zstandard.ZstdDecompressor()
    for blob in blobs:
        raw = decoder.decompress(blob)
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        rows, at = np.zeros(n, FIELDS), 8
        for f in FIELDS.names:
            width = FIELDS[f].itemsize
            rows[f] = np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).view(FIELDS[f]).reshape(-1)
            at += n * width
        fields.append(rows)
        bodies.append(np.frombuffer(raw, np.uint8, offset=at))
    rows = np.concatenate(fields)
    fresh = rows["size"] > 0
    return rows, np.cumsum(fresh) - 1, np.concatenate(bodies), np.concatenate([[0], np.cumsum(rows["size"][fresh].astype(np.int64))])


def _string_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, anchor: np.ndarray, side: int) -> tuple[np.ndarray, ...]:
    """Hashes of whole strings, and of their anchors with `side` bytes before and behind them, or fewer; by blocks of strings."""
    out = np.zeros((3, len(start)), np.uint64)
    block = start // HASHED
    cuts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(start) else np.zeros(0, np.int64)
    for i, j in zip(cuts, np.append(cuts[1:], len(start)), strict=True):
        base = start[i]
        sums = _sums(data[base : end[j - 1]])
        s, e, a = start[i:j] - base, end[i:j] - base, anchor[i:j] - base
        out[0, i:j] = _range_hash(sums, s, e)
        out[1, i:j] = _range_hash(sums, np.maximum(a - side, s), a + ANCHOR)
        out[2, i:j] = _range_hash(sums, a, np.minimum(a + ANCHOR + side, e))
    return tuple(out)


def _shared(rows: np.ndarray, string: np.ndarray, data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(record, start, end) of the ranges of windows that a smaller document has too, from all records of a shard."""
    start, end = offsets[:-1], offsets[1:]
    anchor = start + rows["anchor"][rows["size"] > 0]
    # a window holds half of what surrounds the anchor in it, on one side at least: only classes that share a side go on
    side = _side(length)
    told, left, right = _string_hashes(data, start, end, anchor, side)
    # equal strings are one class
    _, lead, cls = np.unique(told, return_index=True, return_inverse=True)
    doc_class = cls[string]
    low = np.full(len(lead), NO_ID)
    np.minimum.at(low, doc_class, rows["doc"])
    high = np.full(len(lead), np.iinfo(np.int64).min)
    np.maximum.at(high, doc_class, rows["doc"])
    s, e = start[lead], end[lead]
    live = np.zeros(len(lead), bool)
    for half, ok in ((left[lead], anchor[lead] - s >= side), (right[lead], e - anchor[lead] >= ANCHOR + side)):
        k = np.flatnonzero(ok)
        _, at = np.unique(half[k], return_inverse=True)
        if len(k):
            first, last = np.full(at.max() + 1, NO_ID), np.full(at.max() + 1, np.iinfo(np.int64).min)
            np.minimum.at(first, at, low[k])
            np.maximum.at(last, at, high[k])
            live[k] |= (first < last)[at]
    k = np.flatnonzero(live)
    if not len(k):
        return np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
    # the distinct strings, one behind the other with a byte between that UTF-8 doesn't have
    sizes = (e - s)[k]
    at = np.concatenate([[0], np.cumsum(sizes + 1)])
    joined = np.full(at[-1], 255, np.uint8)
    joined[common.expand(at[:-1], sizes)] = data[common.expand(s[k], sizes)]
    sa = suffix_array(joined)
    prefix = common_prefixes(joined, sa, at[:-1], 2 * length)
    windows = sizes - length + 1
    valid = np.zeros(len(joined), bool)
    valid[common.expand(at[:-1], windows)] = True
    owner = np.repeat(np.arange(len(k)), sizes + 1)
    # suffixes that agree in length bytes with the one before them belong to its group; those that begin no window stand alone
    group = np.cumsum(~(valid[sa] & (prefix[sa] >= length)))
    began = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    docs_low = np.where(valid[sa], low[k][owner[sa]], NO_ID)
    best = np.full(len(joined), NO_ID)
    best[sa] = np.repeat(np.minimum.reduceat(docs_low, began), np.diff(np.append(began, len(sa))))
    # back to the records of those classes: which of their windows have a smaller document
    place = np.full(len(lead), -1)
    place[k] = np.arange(len(k))
    rec = np.flatnonzero(place[doc_class] >= 0)
    p = place[doc_class[rec]]
    worse = rows["doc"][rec] > low[k][p]
    most = np.maximum.reduceat(best[common.expand(at[:-1], windows)] != low[k][np.repeat(np.arange(len(k)), windows)], np.cumsum(windows) - windows)
    rec, p = rec[worse | most[p]], p[worse | most[p]]
    if not len(rec):
        return np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
    told, spans = [np.zeros(0, np.int64)], [np.zeros((0, 2), np.int64)]
    block = np.cumsum(windows[p]) // EXPANDED
    cuts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    for i, j in zip(cuts, np.append(cuts[1:], len(rec)), strict=True):
        r, found = _gone(rows[rec[i:j]], at[p[i:j]], windows[p[i:j]], best, length)
        told.append(rec[i:j][r])
        spans.append(found)
    return np.concatenate(told), np.concatenate(spans)


def _gone(rows: np.ndarray, at: np.ndarray, windows: np.ndarray, best: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(record, start, end) of the runs of a record's windows, which begin at `at`, that a smaller document has by `best`."""
    flat = common.expand(at, windows)
    r = np.repeat(np.arange(len(rows)), windows)
    gone = np.flatnonzero(best[flat] < rows["doc"][r])
    if not len(gone):
        return np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
    new = np.concatenate([[True], (np.diff(gone) > 1) | (r[gone[1:]] != r[gone[:-1]])])
    a, b = gone[new], gone[np.append(np.flatnonzero(new)[1:], len(gone)) - 1]
    within = np.arange(len(flat)) - np.repeat(np.cumsum(windows) - windows, windows)
    base = rows["start"][r[a]].astype(np.int64)
    return r[a], np.stack([base + within[a], base + within[b] + length], 1)


def repeated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, crc, start, size): byte ranges that repeat in a document with a smaller id; ranges of a document may overlap."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // SHARD_TEXT))

    def run(table: pa.Table) -> pa.Table:
        rows, string, data, offsets = _unpacked(table.column("packed").to_pylist())
        rec, spans = _shared(rows, string, data, offsets, length)
        return pa.table({"doc_id": pa.array(rows["doc"][rec]), "crc": pa.array(rows["crc"][rec].astype(np.int16)), "start": pa.array(spans[:, 0]), "size": pa.array((spans[:, 1] - spans[:, 0]).astype(np.int16))})

    return _cut(docs, shards, length, _frequent(docs, total, shards, length)).groupBy("shard").applyInArrow(run, "doc_id bigint, crc smallint, start bigint, size smallint")


def _blocks(docs: DataFrame) -> DataFrame:
    """(block, packed): documents compressed by blocks of ids, those without an id by blocks of their texts' crcs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            ids = np.array([NO_ID if d is None else d for d in batch.column("doc_id").to_pylist()], np.int64)
            for row, end, data, offsets in common.text_steps(batch):
                block = np.where(ids[row:end] == NO_ID, -1 - _crcs(data, offsets).astype(np.int64), ids[row:end] >> BLOCK_BITS)
                names, out = [], []
                for b in np.unique(block):
                    k = np.flatnonzero(block == b)
                    sizes = np.diff(offsets)[k]
                    body = data[common.expand(offsets[k], sizes)] if len(k) < end - row else data
                    out.append(coder.compress(np.int64(len(k)).tobytes() + ids[row:end][k].tobytes() + sizes.astype(np.int64).tobytes() + body.tobytes()))
                    names.append(b)
                yield pa.record_batch({"block": pa.array(names, pa.int64()), "packed": pa.array(out, pa.binary())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "block bigint, packed binary")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and the kept bytes' ranges.

    A null text is empty. Rows that share an id don't count as smaller than each other; a null id is larger than all. An empty
    table has no rows. A very long text is cut into overlapping pieces for the search, so no match is lost, and is held whole only while
    what it keeps is put together. Columns but doc_id and text aren't read.
    """
    by_crc = -1 - F.col("crc").cast("int").bitwiseAND(0xFFFF).cast("long")
    spans = repeated(docs, length).withColumn("block", F.when(F.col("doc_id") == NO_ID, by_crc).otherwise(F.shiftright("doc_id", BLOCK_BITS)))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        doc = right.column("doc_id").to_numpy()
        order = np.argsort(doc, kind="stable")
        doc, crc, start, size = doc[order], *(right.column(c).to_numpy()[order] for c in ("crc", "start", "size"))
        end = start + size
        decoder, out = zstandard.ZstdDecompressor(), []
        for packed in left.column("packed").to_pylist():
            raw = decoder.decompress(packed)
            n = int(np.frombuffer(raw, np.int64, 1)[0])
            ids, sizes = np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, np.int64, n, 8 + 8 * n)
            at = 8 + 16 * n
            for d, size in zip(ids.tolist(), sizes.tolist(), strict=True):
                lo, hi = np.searchsorted(doc, d), np.searchsorted(doc, d, "right")
                text = raw[at : at + size]
                own = crc[lo:hi].astype(np.uint16) == zlib.crc32(text) & 0xFFFF if hi > lo else slice(0)
                out.append((None if d == NO_ID else d, size, *_kept(text, start[lo:hi][own], end[lo:hi][own])))
                at += size
        cols = list(zip(*out, strict=True)) if out else [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _blocks(docs).groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(run, SCHEMA)


def _kept(text: bytes, start: np.ndarray, end: np.ndarray) -> tuple[int, int, str]:
    """Bytes removed, maximal runs, and the hash of the rest."""
    if not len(start):
        return 0, 0, hashlib.sha256(text).hexdigest()
    change = np.bincount(start, minlength=len(text) + 1) - np.bincount(end, minlength=len(text) + 1)
    gone = np.cumsum(change)[:-1] > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return int(gone.sum()), runs, hashlib.sha256(np.frombuffer(text, np.uint8)[~gone].tobytes()).hexdigest()
