import re

import corpus_pipeline
from codequarry.llm import common, decontam, packing, pii, toxicity
from tests.llm import test_jaccard, test_packing

SF = "/root/testdata/sf0.001"


def test_each_stage_against_a_plain_version(spark):
    docs = common.table(spark, SF, "documents")
    labels, bench = common.table(spark, SF, "labels"), common.table(spark, SF, "benchmark")
    outs, before = [], docs
    for name, stage in corpus_pipeline.STAGES:
        before = common.written(stage(spark, before, SF), f"stage-{len(outs)}-{name[:3]}")
        outs.append(before)
    assert all(o.columns == docs.columns for o in outs[:-1])
    rows = [{r["doc_id"]: r for r in o.collect()} for o in outs[:-1]]
    first = {r["doc_id"]: r for r in docs.collect()}

    net = toxicity.fit(docs, labels, common.crc_fold("doc_id", 5) != 0)
    judged = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, net, "doc_id").collect()}
    assert set(rows[0]) == {d for d in first if judged[d] == 0} and len(rows[0]) < len(first)

    told = test_jaccard.plain([(d, r["text"]) for d, r in rows[0].items()], 5, 80)
    assert set(rows[1]) == {d for d, _, c in told if d == c} and len(rows[1]) < len(rows[0])

    leaks = {r["doc_id"] for r in decontam.find_leaks(outs[1], bench).collect()}
    items = [" ".join(re.findall(r"\w+", r["text"].lower())) for r in bench.collect()]
    verbatim = {d for d, r in rows[1].items() for i in items if i in " ".join(re.findall(r"\w+", (r["text"] or "").lower()))}
    assert verbatim <= leaks and set(rows[2]) == set(rows[1]) - leaks

    assert set(rows[3]) == set(rows[2])
    left = pii.digest(pii.find_pii(outs[3])).select("doc_id", "n_email", "n_ip", "n_card", "n_phone").collect()
    assert sum(sum(r[1:]) for r in left) <= 0.01 * len(left) + 1  # what closes up around a redaction
    assert all(r["n_chars"] == len(r["text"] or "") for r in rows[3].values())

    test_packing.check([(d, r["text"]) for d, r in rows[3].items()], outs[4].collect())
    assert set(packing.SCHEMA.replace(",", "").split()[::2]) == set(outs[4].columns)


def test_empty_documents(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        common.table(spark, SF, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
