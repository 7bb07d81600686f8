"""Language of a text by compression: a raw-content zstandard dictionary for each language, the smallest size wins.

The model is fit on a bounded sample of rows: of each language the first DOCS_PER_LANG documents by a hash of the id, as long as
those before them hold less than DICT_CHARS code points. Each of them is learned whole. The language counts that settle ties
come from all learnable rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codequarry.llm.common import crc_fold

DOCS_PER_LANG, DICT_CHARS = 200, 256 << 10
#: Texts are compressed in chunks, so that a long text can't become its own dictionary.
LEVEL, CHUNK = 6, 8192
#: A narrower lead over the second language, as a share of its size, is rejected.
LEAST_MARGIN = 0.01
#: How sharply the lead turns into a score.
SHARPNESS = 40.0
_NOT_LETTERS = re.compile(r"[\W\d_]+")

SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double, margin double, rejected boolean"


def letters(text: str) -> str:
    return _NOT_LETTERS.sub(" ", text.lower()).strip()


def fit(docs: DataFrame, learnable) -> list[tuple[str, int, bytes]]:
    """(language, rows, dictionary) of each language, most frequent first; no rows: an empty model. Null ids teach nothing."""
    known = docs.where(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "key")
    sized = known.select("doc_id", "lang", F.length("text").cast("long").alias("size"), F.xxhash64("text").alias("key"))
    first = sized.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= DOCS_PER_LANG)
    so_far = F.sum("size").over(Window.partitionBy("lang").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    ids = first.withColumn("before", so_far - F.col("size")).where(F.col("before") < DICT_CHARS).select("doc_id", F.col("lang").alias("of"), "key", "rank")
    sample = known.withColumn("key", F.xxhash64("text")).join(F.broadcast(ids), ["doc_id", "key"]).where("lang = of").select("lang", "rank", "text").dropDuplicates(["lang", "rank"])
    texts: dict[str, list[tuple[int, str]]] = {}
    for r in sample.toLocalIterator():  # DICT_CHARS code points and one text a language
        texts.setdefault(r["lang"], []).append((r["rank"], letters(r["text"])))
    model = [(lang, counts[lang], " ".join(t for _, t in sorted(found)).encode()) for lang, found in texts.items()]
    return sorted(model, key=lambda m: (-m[1], m[0]))


class Classifier:
    def __init__(self, model: list[tuple[str, int, bytes]]):
        self.langs = [m[0] for m in model]
        self.coders = []
        for _, _, content in model:
            held = zstandard.ZstdCompressionDict(content or b"        ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            self.coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False))

    def __call__(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and margin; `und` where the text is null or has no letter, or nothing was learned."""
        body = letters(text or "").encode()
        if not body or not self.langs:
            return "und", 0.0, 0.0
        sizes = np.array([sum(len(c.compress(body[i : i + CHUNK])) for i in range(0, len(body), CHUNK)) for c in self.coders], float)
        best = int(sizes.argmin())  # of equal sizes the most frequent language
        rest = np.delete(sizes, best)
        margin = float((rest.min() - sizes[best]) / rest.min()) if len(rest) else 1.0
        weights = np.exp(-SHARPNESS * (sizes - sizes[best]) / sizes[best])
        return self.langs[best], float(1 / weights.sum()), margin


def classify(docs: DataFrame, model: list[tuple[str, int, bytes]], held_out) -> DataFrame:
    """One row a document: language, score (0 to 1), and whether its margin is too narrow to rely on."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Classifier(shared.value)
        for batch in batches:
            found = [judge(t.as_py()) for t in batch.column("text")]
            langs, scores, margins = zip(*found, strict=True) if found else ((), (), ())
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": pa.array(langs, pa.string()),
                "score": pa.array(scores, pa.float64()), "margin": pa.array(margins, pa.float64()), "rejected": pa.array([m < LEAST_MARGIN for m in margins], pa.bool_()),
            })

    return docs.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(run, SCHEMA)


def identify(docs: DataFrame) -> DataFrame:
    """Learn from documents outside fold 2 of 4, predict all: one row a document, repeated rows and null ids included.

    Texts that are null or have no letter are `und`; an empty table has no rows; a very long text is compressed in chunks. Columns
    but doc_id, text and lang aren't read.
    """
    fold = crc_fold("doc_id", 4)
    return classify(docs, fit(docs.select("doc_id", "text", "lang"), fold != 2), fold == 2)
