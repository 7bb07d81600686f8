import os

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from codequarry.llm import tokens


def test_counts_match_the_tokenizer(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    own = Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))
    own.encode_special_tokens = True
    want = {r["doc_id"]: len(own.encode(r["text"] or "", add_special_tokens=False).ids) for r in docs.collect()}
    found = tokens.count_tokens(docs).collect()
    assert len(found) == len(want) and {r["doc_id"]: r["n_tokens"] for r in found} == want
    assert all(r["closed"] for r in found)


def test_nulls_empty_texts_and_the_end_string(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "<|endoftext|> a <|endoftext|>", 0), (None, "some words", 0), (4, "x" * 100_000, 0)]
    found = tokens.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")).collect()
    counts = {r["doc_id"]: r["n_tokens"] for r in found}
    assert len(found) == 5 and counts[1] == counts[2] == 0 and counts[None] == 2 and counts[4] > 0


def test_empty_table(spark):
    assert tokens.count_tokens(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def plain(ids, end):
    out, start = [], 0
    for k, i in enumerate(ids):
        if i == end:
            out.append((len(out), start, k - start, True))
            start = k + 1
    return out + ([(len(out), start, len(ids) - start, False)] if start < len(ids) else [])


def test_scan_stitches_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokens, "RANGE_BLOCKS", 3)
    rng = np.random.default_rng(5)
    want = set()
    for no, share in enumerate([0.0, 0.01, 0.2, 0.9, 1.0]):
        ids = np.where(rng.random(1000 + no) < share, 9, rng.integers(10, 60000, 1000 + no)).astype("<u2")
        name = f"part-{no:05d}.txt"
        (tmp_path / name).write_bytes(ids.tobytes())
        want |= {(name, *row) for row in plain(ids.tolist(), 9)}
    (tmp_path / "part-00009.txt").write_bytes(b"")
    for block in (1, 7, 64, 5000):
        found = tokens.scan(spark, os.fspath(tmp_path), 9, block).collect()
        assert len(found) == len(want) and {tuple(r[c] for c in ("shard", "ordinal", "start", "n_tokens", "closed")) for r in found} == want
