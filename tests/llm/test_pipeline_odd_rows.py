"""The pipeline over nulls, empty and very long texts, ties, repeated rows and columns with other names."""

import corpus_pipeline
from codequarry.llm import common


def test_odd_rows(spark):
    long = " ".join(f"w{i} of some {i % 7}" for i in range(40_000))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "a plain text of a few words", "en", None, 1), (3, "a plain text of a few words", "en", None, 1), (None, "another text without an id", None, "s", 2), (4, long, "en", "s", len(long)), (5, "write to me@here.org now", "de", "s", 9)]
    docs = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, node string, fp int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, common.written(stage(spark, docs, "/root/testdata/sf0.001"), name[:3])
        assert docs.columns == corpus_pipeline.COLUMNS and docs.count() <= before.count()
    left = {(r["doc_id"], r["text"]) for r in docs.collect()}
    assert {(1, None), (2, ""), (4, long), (5, "write to [EMAIL] now")} <= left
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").collect()
    assert {r["doc_id"] for r in packed} == {d for d, _ in left}
    assert all(r["doc_tokens"] == 1 for r in packed if r["doc_id"] in (1, 2))
