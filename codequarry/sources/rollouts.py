"""Agent logs of the second format: JSON lines in plain or compressed rollout files, a file a thread.

The data source reads lines without holding one that is longer than the limit, from plain files and from any number of zstd
frames one behind the other; what follows a damaged or cut frame is dropped. Its paths are those that Arrow's file systems
open. For stores that only Spark reads, `read_binary` takes the same lines from Spark's binary files.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from codequarry.functions import patches, paths, text

#: Bytes of a line, and the kinds of lines that are known.
MOST_LINE = 8 << 20
KNOWN = ("session_meta", "turn_context", "event_msg", "response_item", "compacted", "world_state", "token_usage_record")
#: Bytes that one read takes, and of files that one task reads.
CHUNK, TASK_BYTES = 1 << 20, 128 << 20
LINES = "session string, file string, main boolean, line_no long, line string"
_NAME = re.compile(r"rollout-.*\.jsonl(\.zst)?$")


def bounded_lines(stream: BinaryIO, most: int = MOST_LINE, chunk: int = CHUNK) -> Iterator[bytes | None]:
    """The lines of a stream without blank ones and byte-order marks; None for a line over `most` bytes, of which no more are held.

    An error of the stream ends it as its end does.
    """
    held, long = bytearray(), False

    def told() -> Iterator[bytes | None]:
        if long:
            yield None
        elif held.strip(b" \t\n\x0c\r"):
            yield bytes(held).removeprefix(b"\xef\xbb\xbf")

    while True:
        try:
            part = stream.read(chunk)
        except (zstandard.ZstdError, OSError):
            part = b""
        if not part:
            yield from told()
            return
        *whole, rest = part.split(b"\n")
        for piece in whole:
            if long or len(held) + len(piece) > most:
                long = True
            else:
                held += piece
            yield from told()
            held, long = bytearray(), False
        if long or len(held) + len(rest) > most:
            held, long = bytearray(), True
        else:
            held += rest


def opened(raw: BinaryIO, name: str) -> BinaryIO:
    return zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True) if name.lower().endswith(".zst") else raw


def chosen(names: list[str]) -> list[str]:
    """The rollout files among names, in order; a plain file beats its compressed copy."""
    kept = {n for n in names if _NAME.match(n.rsplit("/", 1)[-1])}
    return sorted(n for n in kept if not (n.endswith(".zst") and n.removesuffix(".zst") in kept))


def rows_of(name: str, stream: BinaryIO) -> Iterator[tuple]:
    """Rows of LINES of one file. The first line tells its session: that of a thread names its parent's; else it is the file's name."""
    stem = name.rsplit("/", 1)[-1].removesuffix(".zst").removesuffix(".jsonl")
    session = None
    for no, line in enumerate(bounded_lines(opened(stream, name)), 1):
        if session is None:
            session = _group(line) or stem
        yield session, name, session in stem, no, None if line is None else line.decode("utf-8", "replace")


def _group(line: bytes | None) -> str | None:
    try:
        first = json.loads(line or b"")
        meta = first["payload"] if first["type"] == "session_meta" else {}
        found = meta.get("session_id", meta.get("id"))
        return found if isinstance(found, str) else None
    except (ValueError, KeyError, TypeError, AttributeError):
        return None


@dataclass
class Files(InputPartition):
    names: list[str]


class RolloutReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def _opened(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), self.root)

    def partitions(self) -> list[InputPartition]:
        """Files are dealt out in order, about TASK_BYTES a task; only their names and sizes are listed here."""
        files, folder = self._opened()
        sizes = {f.path: f.size for f in files.get_file_info(fs.FileSelector(folder, recursive=True)) if f.type == fs.FileType.File}
        out, held = [], 0
        for name in chosen(list(sizes)):
            if not out or held + sizes[name] > TASK_BYTES:
                out, held = [*out, Files([])], 0
            out[-1].names.append(name)
            held += sizes[name]
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        files, _ = self._opened()
        for name in partition.names:
            with files.open_input_stream(name, compression=None) as stream:
                yield from rows_of(name, stream)


class Rollouts(DataSource):
    """spark.read.format("rollouts").load(folder): one row a line, after spark.dataSource.register(Rollouts)."""

    @classmethod
    def name(cls) -> str:
        return "rollouts"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> RolloutReader:
        return RolloutReader(self.options["path"])


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(session, file, main, line_no, line): a null line was too long; main if the file is that of the session's first thread."""
    spark.dataSource.register(Rollouts)
    return spark.read.format("rollouts").load(folder)


def read_binary(files: DataFrame) -> DataFrame:
    """As read_lines, of Spark's binary files (path, content) under one folder: a task holds one file's bytes, and its lines within the limit."""
    plain = files.select(F.col("path").alias("copy")).where("path like '%.jsonl'")
    name = F.element_at(F.split("path", "/"), -1)
    kept = files.where(name.rlike("^rollout-.*[.]jsonl([.]zst)?$")).join(plain, F.concat(F.col("copy"), F.lit(".zst")) == F.col("path"), "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows: list[tuple] = []
                for row in rows_of(path, io.BytesIO(content.as_buffer())):
                    rows.append(row)
                    if len(rows) == 1000 or len(row[4] or "") > CHUNK:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)

    return kept.select("path", "content").mapInArrow(run, LINES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"session": pa.string(), "file": pa.string(), "main": pa.bool_(), "line_no": pa.int64(), "line": pa.string()}
    return pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())], names=list(kinds))


_USAGE = "struct<input_tokens:bigint,cached_input_tokens:bigint,output_tokens:bigint,cache_write_input_tokens:bigint>"
_ITEM = "struct<type:string,id:string,status:string,content:array<struct<text:string>>,changes:map<string,struct<type:string,content:string,unified_diff:string,move_path:string>>>"
SCHEMA = (
    f"type string, timestamp string, payload struct<type:string,cwd:string,model:string,message:string,info:struct<total_token_usage:{_USAGE}>,item:{_ITEM},name:string,call_id:string,input:string,arguments:string,"
    "output:string,action:struct<command:string,working_directory:string>>"
)
#: Tools that run a shell.
SHELLS = ("shell_command", "exec_command", "shell", "container.exec", "local_shell")


def entries(lines: DataFrame) -> DataFrame:
    """(session, file, main, line_no, type, ts, payload, cwd, model) of the lines of a known kind; cwd and model are the last ones told so far in the file."""
    told = lines.where("line is not null").select("session", "file", "main", "line_no", F.from_json("line", SCHEMA).alias("e")).where(F.col("e.type").isin(*KNOWN))
    order = Window.partitionBy("session", "file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    first = F.first(F.when(F.col("e.type") == "session_meta", F.col("e.payload.cwd")), True).over(order)
    turn = lambda c: F.last(F.when(F.col("e.type") == "turn_context", F.col(f"e.payload.{c}")), True).over(order)
    return told.select("session", "file", "main", "line_no", "e.type", F.unix_seconds(F.try_to_timestamp("e.timestamp")).alias("ts"), "e.payload", F.coalesce(turn("cwd"), first).alias("cwd"), turn("model").alias("model"))


def counts(lines: DataFrame) -> DataFrame:
    """(session, parsed, unknown, too_long, warn) of a session's lines; warn if more are unknown than parsed."""
    kind = F.from_json("line", "type string")["type"]
    told = lines.groupBy("session").agg(F.count_if(kind.isin(*KNOWN)).alias("parsed"), F.count_if(F.col("line").isNotNull() & ~F.coalesce(kind.isin(*KNOWN), F.lit(False))).alias("unknown"), F.count_if(F.col("line").isNull()).alias("too_long"))
    return told.withColumn("warn", F.col("parsed") < F.col("unknown"))


def usage(entries_: DataFrame) -> DataFrame:
    """(session, file, line_no, model, input, output, cache_read, cache_write): what each count adds to the one before it in its file; less adds nothing.

    Input tokens include those read from a cache, which are told apart here.
    """
    total = "payload.info.total_token_usage"
    told = entries_.where((F.col("type") == "event_msg") & (F.col("payload.type") == "token_count") & F.col(total).isNotNull())
    n = lambda c: F.coalesce(F.col(f"{total}.{c}"), F.lit(0))
    now = {"input": F.greatest(n("input_tokens") - n("cached_input_tokens"), F.lit(0)), "output": n("output_tokens"), "cache_read": n("cached_input_tokens"), "cache_write": n("cache_write_input_tokens")}
    order = Window.partitionBy("session", "file").orderBy("line_no")
    told = told.select("session", "file", "line_no", "model", *(v.alias(k) for k, v in now.items()))
    return told.select("session", "file", "line_no", "model", *(F.greatest(F.col(k) - F.coalesce(F.lag(k).over(order), F.lit(0)), F.lit(0)).alias(k) for k in now))


def prompts(entries_: DataFrame) -> DataFrame:
    """(session, file, line_no, text) of what the user asked."""
    p = F.col("payload")
    message = F.when(p["type"] == "user_message", F.array(p["message"]))
    item = F.when((p["type"] == "item_completed") & (p["item"]["type"] == "UserMessage"), F.transform(p["item"]["content"], lambda c: c["text"]))
    return entries_.where("type = 'event_msg'").select("session", "file", "line_no", F.explode(F.coalesce(message, item)).alias("text")).where("text is not null")


def resolved(path: Column, cwd: Column) -> Column:
    """A path as it is if it is absolute or no folder is known, or else below cwd; cleaned."""
    absolute = path.rlike(r"^(?:[/\\]|[A-Za-z]:)")
    return paths.clean_path(F.when(absolute | cwd.isNull(), path).otherwise(F.concat_ws("/", cwd, path)))


_EDITS = "array<struct<path:string,ok:boolean,before:string,after:string,hunks:" + patches.HUNKS + ">>"


def _edit(path: Column, before=None, after=None, hunks=None) -> Column:
    kinds = {"before": (before, "string"), "after": (after, "string"), "hunks": (hunks, patches.HUNKS)}
    return F.struct(path.alias("path"), F.lit(True).alias("ok"), *((F.lit(None) if c is None else c).cast(kind).alias(k) for k, (c, kind) in kinds.items()))


def _edits_of(op: Column) -> Column:
    """The edits that an operation (op, path, to, content, hunks) makes; what a moved file holds isn't known."""
    gone = _edit(op["path"], after=F.lit(""))
    return (
        F.when(op["op"] == "add", F.array(_edit(op["path"], before=F.lit(""), after=F.coalesce(op["content"], F.lit(""))))).when(op["op"] == "delete", F.array(gone))
        .when(op["op"] == "move", F.array(gone, _edit(op["to"]))).otherwise(F.array(_edit(op["path"], after=op["content"], hunks=F.when(F.size(op["hunks"]) > 0, op["hunks"]))))
    ).cast(_EDITS)


def edits(entries_: DataFrame) -> DataFrame:
    """(session, file, line_no, pos, ts, path, ok, before, after, hunks) of the files that a session changed, in order.

    File changes are taken as they are told; a patch call counts where no file change has its id and its output tells success.
    Before and after are null where the log doesn't hold the whole text; hunks apply to what the file held by then.
    """
    keep = ["session", "file", "line_no", "ts", "cwd"]
    p = F.col("payload")
    item = p["item"]
    changes = entries_.where((F.col("type") == "event_msg") & (p["type"] == "item_completed") & (item["type"] == "FileChange")).select(*keep, item["id"].alias("id"), (F.coalesce(item["status"], F.lit("completed")) == "completed").alias("ok"), F.array_sort(F.map_entries(item["changes"])).alias("changes"))
    kind = lambda c: F.when(c["type"] == "add", "add").when(c["type"] == "delete", "delete").when(c["move_path"].isNotNull(), "move").otherwise("update")
    op = lambda e: F.struct(kind(e["value"]).alias("op"), resolved(e["key"], F.col("cwd")).alias("path"), resolved(e["value"]["move_path"], F.col("cwd")).alias("to"), e["value"]["content"].alias("content"), patches.unified_hunks(F.coalesce(e["value"]["unified_diff"], F.lit(""))).alias("hunks"))
    failed = lambda e: F.array(F.struct(resolved(e["key"], F.col("cwd")).alias("path"), F.lit(False).alias("ok"), *(F.lit(None).cast(k).alias(n) for n, k in (("before", "string"), ("after", "string"), ("hunks", patches.HUNKS))))).cast(_EDITS)
    told = changes.select(*keep, F.flatten(F.transform("changes", lambda e: F.when(F.col("ok"), _edits_of(op(e))).otherwise(failed(e)))).alias("edits"))

    calls = entries_.where((F.col("type") == "response_item") & p["type"].isin("custom_tool_call", "function_call") & (p["name"] == "apply_patch") & p["call_id"].isNotNull())
    given = F.coalesce(p["input"], p["arguments"], F.lit(""))
    inside = F.from_json(given, "input string, patch string")
    calls = calls.select(*keep, p["call_id"].alias("id"), F.coalesce(inside["input"], inside["patch"], given).alias("patch"))
    calls = calls.withColumn("last", F.row_number().over(Window.partitionBy("session", "file", "id").orderBy(F.desc("line_no")))).where("last = 1").drop("last")
    done = outputs(entries_).groupBy("session", "file", "id").agg(F.max_by("patched", "line_no").alias("patched")).where("patched").drop("patched")
    calls = calls.join(changes.select("session", "file", "id").distinct(), ["session", "file", "id"], "left_anti").join(done, ["session", "file", "id"])
    fixed = lambda o: F.struct(o["op"].alias("op"), resolved(o["path"], F.col("cwd")).alias("path"), resolved(o["to"], F.col("cwd")).alias("to"), o["content"].alias("content"), o["hunks"].alias("hunks"))
    patched = calls.select(*keep, F.flatten(F.transform(patches.patch_operations(F.col("patch")), lambda o: _edits_of(fixed(o)))).alias("edits"))
    return told.unionByName(patched).select("session", "file", "line_no", "ts", F.posexplode("edits").alias("pos", "e")).select("session", "file", "line_no", "pos", "ts", "e.*")


def outputs(entries_: DataFrame) -> DataFrame:
    """(session, file, line_no, id, ok, patched) of calls' outputs: ok by the exit code that they tell, null if they tell none."""
    p = F.col("payload")
    said = F.ltrim(p["output"])
    code = F.when(said.startswith("Exit code: "), F.nullif(F.regexp_extract(said, r"^Exit code: (\d+)", 1), F.lit(""))).when(said.startswith("{"), F.get_json_object(said, "$.metadata.exit_code"))
    ok = code.try_cast("bigint") == 0
    told = entries_.where((F.col("type") == "response_item") & p["type"].isin("custom_tool_call_output", "function_call_output") & p["call_id"].isNotNull() & p["output"].isNotNull())
    return told.select("session", "file", "line_no", p["call_id"].alias("id"), ok.alias("ok"), (said.startswith("Success") | F.coalesce(ok, F.lit(False))).alias("patched"))


def shell_events(entries_: DataFrame) -> DataFrame:
    """(session, file, line_no, ts, id, command, dir, test_run, ok) of the commands that a session ran."""
    p = F.col("payload")
    given = F.coalesce(p["input"], p["arguments"], F.lit(""))
    args = F.from_json(given, "command string, cmd string, workdir string, cwd string")
    words = lambda c: F.coalesce(F.array_join(F.when(c.startswith("["), F.from_json(c, "array<string>")), " "), c)
    tool = p["type"].isin("custom_tool_call", "function_call")
    run = F.when(tool & (p["name"] == "exec"), F.struct(given.alias("command"), F.lit(None).cast("string").alias("dir")))
    run = run.when(tool & p["name"].isin(*SHELLS) & (args["command"].isNotNull() | args["cmd"].isNotNull()), F.struct(words(F.coalesce(args["command"], args["cmd"])).alias("command"), F.coalesce(args["workdir"], args["cwd"]).alias("dir")))
    run = run.when(p["type"] == "local_shell_call", F.struct(words(p["action"]["command"]).alias("command"), p["action"]["working_directory"].alias("dir")))
    told = entries_.where("type = 'response_item'").withColumn("run", run).where("run is not null")
    base = F.coalesce(resolved(F.col("run.dir"), F.col("cwd")), F.col("cwd"))
    within = text.working_dir(F.col("run.command"))
    told = told.select("session", "file", "line_no", "ts", F.col("payload.call_id").alias("id"), "run.command", F.coalesce(resolved(within, base), base).alias("dir"), F.coalesce(text.is_test_command(F.col("run.command")), F.lit(False)).alias("test_run"))
    ended = outputs(entries_).groupBy("session", "file", "id").agg(F.min_by("ok", "line_no").alias("ok"))
    return told.join(ended, ["session", "file", "id"], "left").select("session", "file", "line_no", "ts", "id", "command", "dir", "test_run", "ok")
