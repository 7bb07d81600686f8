import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from codequarry.llm import packing


def ids_of(text: str | None) -> list[int]:
    if not hasattr(ids_of, "coder"):
        ids_of.coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return ids_of.coder.encode(text or "", add_special_tokens=False).ids + [2]


def check(rows: list[tuple], found: list) -> int:
    """Each id lies in exactly one piece, sequences are gapless; gives the number of sequences."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == {d for d, _ in rows}
    for d, text in rows:
        ids = np.array(ids_of(text), "<u4")
        at = 0
        for r in sorted(pieces[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for some in sequences.values():
        at = 0
        for r in sorted(some, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.CAPACITY
    return len(sequences)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    n = check(rows, packing.pack(docs.repartition(7)).collect())
    total = sum(len(ids_of(t)) for _, t in rows)
    assert n <= -(-total // packing.CAPACITY) * 1.1 + 3


def test_short_documents_fill_their_sequences(spark):
    rows = [(k, "a few short words " * (k % 3)) for k in range(3000)]
    n = check(rows, packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    total = sum(len(ids_of(t)) for _, t in rows)
    assert n <= -(-total // packing.CAPACITY) + 1


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "a" * 50_000), (4, "word " * 30_000), (None, "no id"), (5, "<|endoftext|> x <|startoftext|>"), (6, "Ünï\tcode x\r\n"), (7, "naïve. café, ß ŉ İ 漢字😀")]
    check(rows, packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    repeated = [(1, "some words here")] * 3
    found = packing.pack(spark.createDataFrame(repeated, "doc_id long, text string")).collect()
    assert sum(r["length"] for r in found) == 3 * len(ids_of("some words here"))


def test_empty_and_extra_columns(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(1, "a b", 5, 6)]
    check([(1, "a b")], packing.pack(spark.createDataFrame(rows, "doc_id long, text string, start int, class int")).collect())


def test_cuts_fill_their_slots():
    for n in range(1, packing.CAPACITY + 1):
        parts = packing.cut(n)
        assert sum(p for p, _ in parts) == n
        assert all(p <= packing.CAPACITY // j for p, j in parts)
