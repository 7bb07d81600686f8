"""Agent sessions: periods by gaps, positions, usage and cost."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.operators import timeline

GAP = 3 * 3600
#: Sessions of a block, and files that blocks are multiplied over at once.
SESSION_BLOCK, FILE_BLOCK = 2048, 1024
#: Rows of a block that are compressed at once.
PACKED_ROWS = 1 << 20


def periods(events: DataFrame, gap: int = GAP) -> DataFrame:
    """Periods of each session's successful edits: a gap of at least `gap` seconds begins a new one.

    `since` is the last edit of the period before, `until` the first edit of the next.
    """
    order = Window.partitionBy("session").orderBy("ts", "seq")
    edits = events.where("op = 'edit' and ok").withColumn("new", F.coalesce((F.col("ts") - F.lag("ts").over(order) >= gap).cast("int"), F.lit(0)))
    numbered = edits.withColumn("period", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    told = numbered.groupBy("session", "period").agg(F.min("ts").alias("first_edit"), F.max("ts").alias("last_edit"), F.count("*").alias("edits"), F.countDistinct("file_id").alias("files"))
    by = Window.partitionBy("session").orderBy("period")
    return told.withColumn("since", F.lag("last_edit").over(by)).withColumn("until", F.lead("first_edit").over(by))


def tests_after(periods_: DataFrame, events: DataFrame) -> DataFrame:
    """For each period, the test runs from its last edit to the next period: a run meets only the last period that ended its edits by then."""
    runs = events.where("test_run").select(F.col("seq").alias("key"), F.col("session").alias("id"), F.col("ts").alias("at"), F.lit(None).cast("long").alias("tie"))
    ends = periods_.select(F.col("session").alias("id"), F.col("last_edit").alias("at"), F.col("period").cast("long").alias("tie"), F.struct("session", "period", "until").alias("value"))
    met = timeline.last_until(runs, ends).join(runs.select("key", F.col("at").alias("ts")), "key").where(F.col("value.until").isNull() | (F.col("ts") < F.col("value.until")))
    told = met.groupBy("value.session", "value.period").agg(F.count("*").alias("n"))
    return periods_.select("session", "period").join(told, ["session", "period"], "left").select("session", "period", F.coalesce("n", F.lit(0)).alias("tests"))


def first_edit_position(events: DataFrame) -> DataFrame:
    """For each session: events before the first successful edit, and tokens up to its time; all where there is none."""
    edit = F.min(F.when((F.col("op") == "edit") & F.col("ok"), F.struct("ts", "seq")))
    first = events.groupBy("session").agg(edit.alias("first"))
    held = events.join(first, "session")
    before = F.count_if(F.col("first").isNull() | (F.struct("ts", "seq") < F.col("first")))
    tokens = F.sum(F.when(F.col("first").isNull() | (F.col("ts") <= F.col("first.ts")), F.col("tokens")).otherwise(0))
    return held.groupBy("session").agg(before.alias("events_before"), tokens.alias("tokens_until"))


def file_edits(events: DataFrame, periods_: DataFrame) -> DataFrame:
    """For each session and file, the periods that edit it and the last of them."""
    bounds = periods_.select("session", "period", "first_edit", "last_edit")
    edits = events.where("op = 'edit' and ok").join(bounds, "session").where("ts between first_edit and last_edit")
    return edits.groupBy("session", "file_id").agg(F.countDistinct("period").alias("periods"), F.max("period").alias("last_period"))


def usage(messages: DataFrame) -> DataFrame:
    """Tokens by session: messages tell growing counts, so each message counts with its largest, once for all sessions."""
    per = messages.groupBy("msg_id", "session").agg(F.max("tokens").alias("tokens"))
    return per.groupBy("session").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("messages"))


def deltas(counters: DataFrame) -> DataFrame:
    """What each event adds to a counter that only grows; a counter that starts again adds nothing."""
    order = Window.partitionBy("session").orderBy("seq")
    return counters.withColumn("delta", F.greatest(F.col("total") - F.coalesce(F.lag("total").over(order), F.lit(0)), F.lit(0)))


def model_name(model: Column) -> Column:
    """A model's name without what follows a bracket, and without a date."""
    return F.regexp_replace(F.substring_index(model, "[", 1), r"-[0-9]{8}$", "")


def usage_cost(uncached: Column, cached: Column, written: Column, output: Column, price_in: Column, price_out: Column) -> Column:
    """Of tokens at prices a million: what a cache gives costs a tenth of an input token, what it takes 1.25 of one; null counts as none."""
    none = lambda c: F.coalesce(c, F.lit(0))
    return (none(uncached) + none(cached) * 0.1 + none(written) * 1.25) * price_in / 1e6 + none(output) * price_out / 1e6


def overlaps(events: DataFrame, block: int = SESSION_BLOCK) -> DataFrame:
    """(session, other, files): files that two sessions both edited.

    Sessions are dealt into blocks of about `block`, and each two blocks meet in one task, which counts with products of 0 and 1
    over FILE_BLOCK files at a time. A block is compressed once and travels as it is to the blocks it meets, so no row a session,
    file and block is shuffled, nor one a pair and file.
    """
    one = events.where("op = 'edit' and session is not null and file_id is not null").select("session", "file_id").distinct()
    blocks = max(1, -(-one.select("session").distinct().count() // block))
    packed = one.withColumn("block", F.pmod(F.xxhash64("session"), F.lit(blocks))).groupBy("block").applyInArrow(_packed, "block long, packed binary")
    met = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")), lambda b: F.struct(F.least(b, "block").alias("a"), F.greatest(b, "block").alias("b")))
    dealt = packed.select("block", "packed", F.explode(met).alias("pair")).select("block", "packed", "pair.a", "pair.b")
    kind = dict(one.dtypes)["session"]
    tasks = max(one.sparkSession.sparkContext.defaultParallelism, blocks * (blocks + 1) // 2)
    return dealt.repartition(tasks, "a", "b").groupBy("a", "b").applyInArrow(_common_files, f"session {kind}, other {kind}, files long")


def _packed(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's sessions and files, compressed by PACKED_ROWS."""
    table = pa.Table.from_batches(batches).select(["session", "file_id"]).sort_by([("session", "ascending"), ("file_id", "ascending")])
    for at in range(0, len(table), PACKED_ROWS):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_table(table.slice(at, PACKED_ROWS))
        yield pa.record_batch({"block": pa.array([key[0].as_py()], pa.int64()), "packed": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


def _common_files(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of two blocks' sessions that share files, row by row of blocks."""
    (a, b), held = (k.as_py() for k in key), [(block.as_py(), pa.ipc.open_stream(packed.as_buffer()).read_all()) for batch in batches for block, packed in zip(batch.column("block"), batch.column("packed"), strict=True)]
    table, mine = pa.concat_tables(t for _, t in held), np.repeat([block for block, _ in held], [len(t) for _, t in held])
    session = table["session"].to_numpy()
    names, who = np.unique(session, return_inverse=True)
    files, what = np.unique(table["file_id"].to_numpy(), return_inverse=True)
    home = np.zeros(len(names), np.int64)
    home[who] = mine
    left, right = np.flatnonzero(home == a), np.flatnonzero(home == b)
    row, col = np.full(len(names), -1), np.full(len(names), -1)
    row[left], col[right] = np.arange(len(left)), np.arange(len(right))
    total = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(what, kind="stable")
    who, what = who[order], what[order]
    for at in range(0, len(files), FILE_BLOCK):
        part = slice(*np.searchsorted(what, [at, at + FILE_BLOCK]))
        w, f = who[part], what[part] - at
        x, y = np.zeros((len(left), FILE_BLOCK), np.float32), np.zeros((len(right), FILE_BLOCK), np.float32)
        for grid, place in ((x, row), (y, col)):
            held = place[w] >= 0
            grid[place[w][held], f[held]] = 1
        total += x @ y.T
    for at in range(0, len(left), 256):
        i, j = np.nonzero(total[at : at + 256])
        one, two = left[i + at], right[j]
        # within a block a pair stands twice; between blocks once, in either order
        keep = one < two if a == b else np.ones(len(one), bool)
        low, high = np.minimum(one, two)[keep], np.maximum(one, two)[keep]
        yield pa.record_batch({"session": pa.array(names[low]), "other": pa.array(names[high]), "files": pa.array(total[i + at, j][keep].astype(np.int64))})
