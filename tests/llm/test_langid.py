import re
import zlib
from collections import Counter

import zstandard

from codequarry.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    found = langid.identify(docs).collect()
    assert len(found) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    assert {r["lang_pred"] for r in found} <= set(truth.values()) | {"und"} and all(0 <= r["score"] <= 1 for r in found)
    told = [(r["lang_pred"], truth[r["doc_id"]]) for r in found if r["held_out"]]
    right = sum(a == b for a, b in told)
    assert right >= 0.9 * len(told), (right, len(told))


def plain(texts, model):
    """The language whose dictionary leaves the fewest bytes, chunk by chunk, from a fresh compressor each time."""
    out = []
    for text in texts:
        body = re.sub(r"[\W\d_]+", " ", (text or "").lower()).strip().encode()
        sizes = []
        for _, _, content in model:
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            coder = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=held, write_content_size=False, write_checksum=False)
            sizes.append(sum(len(coder.compress(body[i : i + langid.CHUNK])) for i in range(0, len(body), langid.CHUNK)))
        out.append(model[sizes.index(min(sizes))][0] if body else "und")
    return out


def test_against_plain_compression(spark, sf_dir):
    """The sample is whole texts: what a text says at its end is learned too."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.collect()
    crc = lambda d: zlib.crc32(str(d).encode()) % 4
    model = langid.fit(docs, langid.crc_fold("doc_id", 4) != 2)
    known = [r for r in rows if crc(r["doc_id"]) != 2 and r["text"] is not None and r["lang"] is not None]
    assert {m[0]: m[1] for m in model} == dict(Counter(r["lang"] for r in known))
    for lang, _, content in model:
        whole = [langid.letters(r["text"]) for r in known if r["lang"] == lang]
        assert len(content.decode()) >= min(sum(map(len, whole)), langid.DICT_CHARS // 2)
        assert sum(t in content.decode() for t in whole) >= min(len(whole), 5)
    found = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs).collect()}
    told = plain([r["text"] for r in rows], model)
    assert sum(found[r["doc_id"]] == t for r, t in zip(rows, told, strict=True)) >= 0.99 * len(rows)


def test_undetermined(spark):
    rows = [(i, "the cat sat on the mat and the dog ran " * 5, "en") for i in range(20)] + [(100 + i, "le chat est sur la table et le chien dort " * 5, "fr") for i in range(20)]
    rows += [(200, None, "en"), (201, "", "en"), (202, "123 _ ?! 45", "fr"), (None, "le chat est sur la table", None), (203, "the dog " * 60_000, None), (1, "the cat", "en")]
    found = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(found) == len(rows)
    by = {r["doc_id"]: r for r in found}
    assert [by[d]["lang_pred"] for d in (200, 201, 202)] == ["und"] * 3
    assert by[203]["lang_pred"] == "en" and by[None]["lang_pred"] == "fr"


def test_narrow_margins_are_marked(spark):
    model = [("a", 2, b"same words in both"), ("b", 1, b"same words in both")]
    docs = spark.createDataFrame([(1, "same words")], "doc_id long, text string")
    r = langid.classify(docs, model, docs.doc_id > 5).first()
    assert r["rejected"] and r["lang_pred"] == "a"


def test_empty_and_nothing_learned(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.identify(none).count() == 0
    rows = [(1, "some text", None, 0.5)]
    found = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, margin double")).collect()
    assert [r["lang_pred"] for r in found] == ["und"]
