import hashlib
import random

import numpy as np
import pytest
import zstandard

from codequarry.llm import substrings
from codequarry.llm.suffixes import common_prefixes, suffix_array


def plain(rows: list[tuple], length: int = 50) -> list[tuple]:
    first: dict[bytes, float] = {}
    ids = [float("inf") if d is None else d for d, _ in rows]
    bodies = [(t or "").encode() for _, t in rows]
    for d, b in zip(ids, bodies, strict=True):
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            first[w] = min(first.get(w, d), d)
    out = []
    for (doc_id, _), d, b in zip(rows, ids, bodies, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((doc_id, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def documents(seed: int, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 9)))
    passages = ["".join(word() for _ in range(25)) for _ in range(5)] + ["ab" * 60, "z" * 130]
    rows = []
    for d in rng.sample(range(-20, 2000), n):
        parts = [rng.choice(passages) if rng.random() < 0.4 else "".join(word() for _ in range(rng.randint(0, 20))) for _ in range(rng.randint(0, 6))]
        text = "".join(parts)
        if rng.random() < 0.3:
            cut = rng.randint(0, 60)
            text = text[cut : len(text) - cut]
        rows.append((d, text))
    return rows + rows[:2]


def run(spark, rows, schema="doc_id long, text string"):
    found = substrings.remove_repeats(spark.createDataFrame(rows, schema)).collect()
    return sorted((tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in found), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rows = documents(seed)
    assert run(spark, rows) == plain(rows)


def test_nulls_ties_and_short_texts(spark):
    line = "a line of text that has more than fifty bytes, so it may go."
    rows = [(None, line), (None, line + "!"), (5, line), (5, "x" + line), (6, None), (7, ""), (8, line[:49]), (9, line + line), (10, "x" * 300), (11, "x" * 51)]
    assert run(spark, rows) == plain(rows)


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(substrings, "PIECE", 64)
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh") for _ in range(3000))
    data = np.frombuffer(text.encode(), np.uint8)
    import pyarrow as pa

    from codequarry.llm import common

    monkeypatch.setattr(common, "STEP_BYTES", 64)
    batch = pa.record_batch({"doc_id": pa.array([1]), "text": pa.array([text])})
    covered = np.zeros(len(data) - 49, bool)
    for _, _, place, part, offsets in substrings._pieces(batch, 50):
        _, start, end, _ = substrings.strings_of(part, offsets, 50)
        for a, b in zip(start, end, strict=True):
            covered[place[0] + a : place[0] + b - 49] = True
    assert covered.all()


def test_extra_columns_and_empty_table(spark):
    rows = [(1, "y" * 70, 1, "b"), (2, "y" * 80, 2, "c")]
    assert run(spark, rows, "doc_id long, text string, start int, block string") == plain([r[:2] for r in rows])
    assert run(spark, []) == []


def test_suffix_arrays():
    rng = random.Random(9)
    for n in [0, 1, 2, 3, 10, 100, 700]:
        for letters in ("a", "ab", "abcdefgh"):
            s = bytes(rng.choice(letters.encode()) for _ in range(n))
            data = np.frombuffer(s, np.uint8)
            sa = suffix_array(data)
            assert sa.tolist() == sorted(range(n), key=lambda i, s=s: s[i:])
            if n > 1:
                want = np.zeros(n, int)
                for a, b in zip(sa[:-1], sa[1:], strict=True):
                    k = 0
                    while a + k < n and b + k < n and s[a + k] == s[b + k]:
                        k += 1
                    want[b] = k
                most = 2000
                assert common_prefixes(data, sa, np.array([0]), most).tolist() == want.tolist()


def test_records_are_looked_at_in_blocks(monkeypatch):
    """A passage that every document shares is one string with a record a document; blocks of any size find the same ranges."""
    passage = np.random.default_rng(3).integers(97, 123, 90).astype(np.uint8).tobytes()
    texts = [b"%d " % k + passage + b" %d" % (k * k) for k in range(300)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    told = substrings._told(np.arange(300), substrings._crcs(data, offsets), np.zeros(300, np.int64), data, offsets, 1, 50)
    blobs = [b for batch in substrings._packed([told], zstandard.ZstdCompressor()) for b in batch.column("packed").to_pylist()]

    def found():
        rows, string, held, at = substrings._unpacked(blobs)
        rec, spans = substrings._shared(rows, string, held, at, 50)
        return sorted(zip(rows["doc"][rec].tolist(), *spans.T.tolist(), strict=True))

    whole = found()
    monkeypatch.setattr(substrings, "EXPANDED", 40)
    assert found() == whole
    assert {d for d, _, _ in whole} == set(range(1, 300))


def test_a_frequent_anchor_is_split(spark, monkeypatch):
    """An anchor in every document, between texts that differ, fills several shards; what is found stays the same."""
    rng = np.random.default_rng(5)
    letters = lambda n: rng.integers(97, 123, n).astype(np.uint8).tobytes().decode()
    alone = np.array([letters(6) for _ in range(2000)])
    key = substrings._range_hash
    least = min(alone, key=lambda a: int(substrings.common.mixed(np.array([int.from_bytes(a.encode(), "little")], np.uint64))[0]))
    kept = [letters(40) for _ in range(40)]
    rows = [(d, "".join(letters(40) + least + (kept[(7 * d + k) % 40] if k % 3 else letters(40)) for k in range(12))) for d in range(60)]
    monkeypatch.setattr(substrings, "SHARD_TEXT", 1 << 10)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    total = sum(len(t) for _, t in rows)
    shards = -(-total // 1024)
    frequent = substrings._frequent(docs, total, shards, 50)
    data = np.frombuffer(least.encode(), np.uint8)
    assert key(substrings._sums(data), np.array([0]), np.array([6]))[0] in frequent

    def largest(*given):
        sizes = {}
        for r in substrings._cut(docs, shards, 50, *given).collect():
            sizes[r["shard"]] = sizes.get(r["shard"], 0) + len(substrings._unpacked([bytes(r["packed"])])[2])
        return max(sizes.values())

    assert largest(frequent) * 4 < largest()
    assert run(spark, rows) == plain(rows)
    monkeypatch.setattr(substrings, "SHARES", 0)  # every anchor is split
    assert run(spark, rows) == plain(rows)
    assert run(spark, documents(3)) == plain(documents(3))
