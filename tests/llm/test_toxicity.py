import zlib

import numpy as np
import pytest

from codequarry.llm import toxicity


def table(spark, name, sf="sf0.01"):
    return spark.read.parquet(f"/root/testdata/{sf}/{name}.parquet")


def test_held_out_accuracy(spark):
    docs = table(spark, "documents", "sf0.1").select("doc_id", "text")
    labels = table(spark, "labels", "sf0.1")
    found = {r["doc_id"]: r for r in toxicity.classify(docs, labels).collect()}
    assert len(found) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in found.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found.values())
    told = [(found[r["doc_id"]]["predicted"], r["toxic"]) for r in labels.collect() if r["doc_id"] in found and found[r["doc_id"]]["held_out"]]
    assert sum(a == b for a, b in told) >= 0.96 * len(told)
    assert sum(a and b for a, b in told) >= 0.85 * sum(b for _, b in told)


def test_scores_depend_on_text_alone(spark):
    docs = table(spark, "documents")
    labels = table(spark, "labels")
    net = toxicity.fit(docs, labels, toxicity.common.crc_fold("doc_id", 5) != 0)
    texts = [r["text"] for r in docs.limit(20).collect()]
    rows = [(1000 + i, t, None) for i, t in enumerate(texts)] + [(i, t, "xx") for i, t in enumerate(texts)]
    found = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), net, "doc_id").collect()
    by = {r["doc_id"]: r["score"] for r in found}
    assert all(by[i] == pytest.approx(by[1000 + i], abs=1e-6) for i in range(20))


def plain_score(net, text):
    """A forward pass word by word: embeddings, each filter at each place, the largest response, the logistic unit."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    feats, _, groups = toxicity.encoded(data, np.array([0, len(data)]))
    vecs = [sum(net.emb[f] for f in row) for row in feats]
    pools = []
    for w in toxicity.WIDTHS:
        for f in range(toxicity.FILTERS):
            places = [sum(float(vecs[i + j] @ net.filters[w][j * toxicity.DIM : (j + 1) * toxicity.DIM, f]) for j in range(w) if i + j < len(vecs)) for i in range(len(vecs))]
            pools.append(max(places, default=0.0))
    logit = sum(p * float(o) for p, o in zip(pools, net.out[:-1], strict=True)) + float(net.out[-1]) - float(net.shift[groups[0]])
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def test_against_a_plain_forward_pass(spark):
    docs, labels = table(spark, "documents", "sf0.001"), table(spark, "labels", "sf0.001")
    net = toxicity.fit(docs, labels, toxicity.common.crc_fold("doc_id", 5) != 0)
    rows = [(i, r["text"][:700] if r["text"] else r["text"]) for i, r in enumerate(docs.limit(25).collect())] + [(900, ""), (901, None)]
    found = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), net, "doc_id").collect()}
    assert all(found[i] == pytest.approx(plain_score(net, t), abs=1e-4) for i, t in rows)


def test_the_whole_text_is_learned_and_scored(spark):
    """The word that tells stands behind 30000 others."""
    long = "plain words go on " * 8000
    rows = [(i, long + ("vile " if i % 2 else "nice ") * 3) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = toxicity.classify(docs, spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")).collect()
    assert sum(r["predicted"] == r["doc_id"] % 2 for r in found if r["held_out"]) >= 0.9 * sum(r["held_out"] for r in found)


def test_nulls_empty_tables_and_one_label(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "word " * 50_000), (None, "a b"), (3, "word")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, None), (3, 0), (4, 1)], "doc_id long, toxic int")
    for known in (labels, labels.limit(0), labels.where("toxic = 1")):
        found = toxicity.classify(docs, known).collect()
        assert len(found) == 5 and all(0 <= r["score"] <= 1 for r in found)
    assert toxicity.classify(docs.limit(0), labels).count() == 0


def test_extra_columns(spark):
    docs = spark.createDataFrame([(1, "a", 0.5, 1, True)], "doc_id long, text string, score double, predicted int, held_out boolean")
    assert toxicity.classify(docs, spark.createDataFrame([], "doc_id long, toxic int")).columns == ["doc_id", "held_out", "score", "predicted"]
