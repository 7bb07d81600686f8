"""Agent event logs: JSON lines, read with a fixed schema, and what their messages and tool calls say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions import text

#: Fixed value: longer lines are skipped and counted.
MOST_LINE = 8 << 20
_BLOCK = "struct<type:string,id:string,tool_use_id:string,name:string,text:string,is_error:boolean,input:struct<file_path:string,command:string>>"
SCHEMA = f"type string, uuid string, timestamp string, cwd string, isMeta boolean, isSidechain boolean, message struct<id:string,model:string,role:string,usage:struct<input_tokens:bigint,output_tokens:bigint,cache_read_input_tokens:bigint,cache_creation_input_tokens:bigint>,content:array<{_BLOCK}>>"
#: The tools that edit, read, search and run.
OPS = {"edit": ("Edit", "MultiEdit", "Write", "NotebookEdit"), "read": ("Read",), "search": ("Grep", "Glob"), "shell": ("Bash",)}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(session, file, line): the log lines under a path, byte-order marks and blank lines dropped; a session is a file's name."""
    rows = spark.read.option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^﻿", "").alias("line"))
    session = F.regexp_extract("file", r"([^/]+)\.jsonl(?:\.zst|\.gz)?$", 1)
    return rows.where(F.trim("line") != "").select(session.alias("session"), "file", "line")


def parse(lines: DataFrame) -> DataFrame:
    """One row an entry: session and the entry's fields; lines that are too long or no JSON are dropped, repeats of a uuid too."""
    told = lines.where(F.length("line") <= MOST_LINE).select("session", F.from_json("line", SCHEMA).alias("e")).where("e.type is not null")
    told = told.select("session", "e.*").withColumn("ts", F.unix_seconds(F.try_to_timestamp("timestamp")))
    keyed = F.coalesce("uuid", F.sha2(F.to_json(F.struct(*told.columns)), 256))
    return told.withColumn("_key", keyed).dropDuplicates(["_key"]).drop("_key")


def skipped(lines: DataFrame) -> DataFrame:
    """(session, too_long, unknown, parsed) counts of lines."""
    ok = F.from_json("line", SCHEMA)["type"].isNotNull()
    long = F.length("line") > MOST_LINE
    return lines.groupBy("session").agg(F.count_if(long).alias("too_long"), F.count_if(~long & ~ok).alias("unknown"), F.count_if(~long & ok).alias("parsed"))


def _op(name: Column) -> Column:
    out = F.lit("other")
    for op, names in OPS.items():
        out = F.when(name.isin(*names), op).otherwise(out)
    return out


def tool_events(entries: DataFrame) -> DataFrame:
    """(session, ts, call_id, op, path, ok, test_run): tool calls with their results; without a result, ok is null."""
    blocks = entries.select("session", "ts", F.explode("message.content").alias("b"))
    calls = blocks.where("b.type = 'tool_use'").select("session", "ts", F.col("b.id").alias("call_id"), _op(F.col("b.name")).alias("op"), F.col("b.input.file_path").alias("path"), F.col("b.input.command").alias("command"))
    results = blocks.where("b.type = 'tool_result'").groupBy(F.col("session").alias("s"), F.col("b.tool_use_id").alias("id")).agg(F.min(~F.coalesce("b.is_error", F.lit(False))).alias("ok"))
    told = calls.join(results, (F.col("session") == F.col("s")) & (F.col("call_id") == F.col("id")), "left")
    return told.select("session", "ts", "call_id", "op", "path", "ok", F.coalesce(text.is_test_command(F.col("command")), F.lit(False)).alias("test_run"))


def usage(entries: DataFrame) -> DataFrame:
    """(model, input, output, cache_read, cache_write, messages): the largest counts of each message, once for all sessions."""
    kinds = {"input": "input_tokens", "output": "output_tokens", "cache_read": "cache_read_input_tokens", "cache_write": "cache_creation_input_tokens"}
    per = entries.where("message.usage is not null").groupBy(F.col("message.id").alias("id")).agg(F.max("message.model").alias("model"), *(F.max(f"message.usage.{c}").alias(k) for k, c in kinds.items()))
    return per.groupBy("model").agg(*(F.sum(F.coalesce(k, F.lit(0))).alias(k) for k in kinds), F.count("*").alias("messages"))
