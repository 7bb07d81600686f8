"""Token counts from flat token files: little-endian 16-bit ids, one document behind the other, each closed by an end id.

The files hold no index. Byte ranges of them are read by tasks of their own, in blocks; a block's end ids are found by one
vectorised comparison, and a prefix scan over the blocks' summaries (tokens, end ids, last end id) gives each document's
number, start and length, wherever ranges and blocks cut it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codequarry.llm.common import shared_dir
from codequarry.llm.packing import TOKENIZER, tokenizer

#: Fixed value: the tokenizer's end-of-text id, which texts never give.
END_ID = 49407
#: Tokens in a block, and blocks in the byte range that a task reads.
BLOCK, RANGE_BLOCKS = 1 << 18, 16


def write_flat(docs: DataFrame, path: str, vocabulary: str | None = None) -> None:
    """Write docs as flat token files, one a partition; null and empty texts are documents of no tokens.

    The text writer puts each row's bytes and then the separator, which is the end id's two bytes here. A vocabulary that two
    bytes can't number is refused.
    """
    vocabulary = vocabulary or public_tokenizers.path(TOKENIZER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(vocabulary, False)
        if coder.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("the vocabulary has more than 65536 ids")
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                ids, before = coder([t or "" for t in batch.column("text").slice(i, 256).to_pylist()])
                data, at = ids.astype("<u2").tobytes(), (2 * before).tolist()
                yield pa.record_batch({"ids": pa.array([data[a:b] for a, b in zip(at, at[1:], strict=False)], pa.binary())})

    end = END_ID.to_bytes(2, "little").decode("latin-1")
    rows = docs.select("text").mapInArrow(run, "ids binary").select(F.col("ids").cast("string").alias("value"))
    rows.write.option("lineSep", end).option("encoding", "ISO-8859-1").option("compression", "none").text(path)


def scan(spark: SparkSession, path: str, end_id: int = END_ID, block: int = BLOCK) -> DataFrame:
    """(shard, ordinal, start, n_tokens, closed) of each document in the flat files of a folder that Arrow can open.

    A last document without an end id is told with closed false; an empty file has no documents. Files may have any size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, first, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, place = fs.FileSystem.from_uri(file)
                shard = file.rsplit("/", 1)[-1]
                with store.open_input_file(place) as held:
                    for no in range(first, min(first + RANGE_BLOCKS, -(-(length // 2) // block))):
                        held.seek(2 * block * no)
                        part = np.frombuffer(held.read_buffer(min(2 * block, length // 2 * 2 - 2 * block * no)), "<u2")
                        ends = np.flatnonzero(part == end_id).astype(np.int32)
                        yield pa.record_batch({"shard": pa.array([shard]), "block": pa.array([no], pa.int64()), "n": pa.array([len(part)], pa.int64()), "ends": pa.array([ends], pa.list_(pa.int32()))})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 1").select("path", "length")
    last = F.ceil(F.col("length") / (2 * block * RANGE_BLOCKS)) - 1
    ranges = files.select(F.regexp_replace("path", "^file:/+", "file:///").alias("file"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("at"), "length")
    ranges = ranges.select("file", (F.col("at") * RANGE_BLOCKS).alias("first"), "length").repartition(spark.sparkContext.defaultParallelism * 4, "file", "first")
    blocks = ranges.mapInArrow(run, "shard string, block bigint, n bigint, ends array<int>")
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("shard")
    size, last = F.size("ends"), F.element_at("ends", -1)
    blocks = blocks.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    blocks = blocks.withColumn("last_end", F.when(size > 0, F.col("base") + last))
    blocks = blocks.select(
        "shard", "base", "n", "ends", F.coalesce(F.sum(size).over(before), F.lit(0)).alias("ordinal"),
        F.coalesce(F.max("last_end").over(before), F.lit(-1)).alias("prior"),
        F.coalesce(F.max("last_end").over(whole), F.lit(-1)).alias("final"), F.max(F.col("base") + F.col("n")).over(whole).alias("total"), F.sum(size).over(whole).alias("count"),
    )
    docs = blocks.select("shard", "base", "ends", "ordinal", "prior", F.posexplode("ends").alias("k", "end"))
    start = F.when(F.col("k") == 0, F.col("prior") + 1).otherwise(F.col("base") + F.get("ends", F.col("k") - 1) + 1)
    closed = docs.select("shard", (F.col("ordinal") + F.col("k")).alias("ordinal"), start.alias("start"), (F.col("base") + F.col("end") - start).alias("n_tokens"), F.lit(True).alias("closed"))
    rest = blocks.where((F.col("base") == 0) & (F.col("total") > F.col("final") + 1))
    rest = rest.select("shard", F.col("count").alias("ordinal"), (F.col("final") + 1).alias("start"), (F.col("total") - F.col("final") - 1).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(rest)


def numbered(docs: DataFrame) -> DataFrame:
    """(shard, ordinal, doc_id): where write_flat puts each row, by its partition and its place there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.record_batch({"shard": pa.array(np.full(n, shard, np.int32)), "ordinal": pa.array(np.arange(at, at + n)), "doc_id": batch.column("doc_id")})
            at += n

    return docs.select(F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, "shard int, ordinal bigint, doc_id bigint")


def count_tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, shard, ordinal, start, n_tokens, closed): write docs as flat files in the shared folder and count their tokens.

    docs is read twice and must have its rows in the same partitions and order both times, as a table of files does. Null and
    empty texts have no tokens, repeated rows and null ids have a row each, an empty table has none. A very long text is
    encoded whole and its tokens lie across as many blocks as they take. Columns but doc_id and text aren't read.
    """
    path = f"{shared_dir(docs.sparkSession)}/flat-{uuid.uuid4().hex}"
    write_flat(docs, path)
    told = scan(docs.sparkSession, path)
    told = told.withColumn("shard", F.regexp_extract("shard", "part-([0-9]+)", 1).cast("int"))
    out = numbered(docs).join(told, ["shard", "ordinal"], "left")
    return out.select("doc_id", "shard", "ordinal", "start", "n_tokens", "closed")
