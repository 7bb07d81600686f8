"""Sinks: replacing and appending tables, and results as text and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def replace_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Write df by the columns `by`; partitions that df has replace those there, all others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """old with the rows of new put in the place of those with equal keys; of rows of new with equal keys, one stays."""
    rest = [c for c in new.columns if c not in keys]
    once = new.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("r")).select(*keys, "r.*")
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(once)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def to_markdown(items: DataFrame) -> DataFrame:
    """(query_id, markdown) of items (query_id, rank, path, start_line, name, text): files in the order of their best rank, lines sorted."""
    best = F.min("rank").over(Window.partitionBy("query_id", "path"))
    line = F.concat(F.lit("- "), F.col("name"), F.lit(":"), F.col("start_line"), F.lit("\n"), F.col("text"))
    per = items.withColumn("best", best).groupBy("query_id", "path").agg(F.min("best").alias("best"), F.array_sort(F.collect_list(F.struct("start_line", line.alias("line")))).alias("lines"))
    body = F.concat(F.lit("## "), F.col("path"), F.lit("\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))
    told = per.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("best", "path", body.alias("body")))).alias("files"))
    return told.select("query_id", F.array_join(F.transform("files", lambda x: x["body"]), "\n\n").alias("markdown"))


def from_markdown(shown: DataFrame) -> DataFrame:
    """(query_id, path, name, start_line): the items that a markdown text lists."""
    files = shown.select("query_id", F.explode(F.split("markdown", r"(?m)^## ")).alias("part")).where("part <> ''")
    named = files.select("query_id", F.substring_index("part", "\n", 1).alias("path"), F.explode(F.regexp_extract_all("part", F.lit(r"(?m)^- (.*:\d+)$"), F.lit(1))).alias("item"))
    return named.select("query_id", "path", F.regexp_extract("item", r"^(.*):(\d+)$", 1).alias("name"), F.regexp_extract("item", r"^(.*):(\d+)$", 2).cast("int").alias("start_line"))
