"""Version history as text: logs, working-tree states and unified diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """commits (hash, ct, subject) and commit_files (hash, path) of `git log --name-only --format=%x1e%H%x1f%ct%x1f%s`."""
    records = spark.read.option("lineSep", "\x1e").text(path).where("value like '%\x1f%'")
    lines = F.split("value", "\n")
    head = F.split(F.element_at(lines, 1), "\x1f")
    told = records.select(head[0].alias("hash"), head[1].cast("long").alias("ct"), head[2].alias("subject"), F.filter(F.slice(lines, 2, F.size(lines)), lambda x: x != "").alias("paths"))
    return told.select("hash", "ct", "subject"), told.select("hash", F.explode("paths").alias("path"))


def read_status(lines: DataFrame) -> DataFrame:
    """(state, path) of porcelain status lines (value); a rename tells its new path."""
    state = F.trim(F.substring("value", 1, 2))
    rest = F.expr("substring(value, 4)")
    return lines.where(F.length("value") > 3).select(state.alias("state"), F.regexp_replace(F.element_at(F.split(rest, " -> "), -1), '^"|"$', "").alias("path"))


def read_diff(lines: DataFrame) -> DataFrame:
    """(diff_id, path, new_file, deleted, added, removed, ranges, old_ranges) of unified diffs told by lines (diff_id, pos, line).

    A hunk's header gives its range on either side; a file's header is carried to the lines behind it. Inside a hunk, the
    lines that its header announces are content, whatever they look like.
    """
    order = Window.partitionBy("diff_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    hunk = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
    number = lambda k: F.regexp_extract("line", hunk, k)
    count = lambda k: F.when(number(k) == "", 1).otherwise(number(k).try_cast("int"))
    t = lines.withColumn("head", F.when(F.col("line").rlike(hunk), F.struct("pos", number(1).cast("int").alias("a"), count(2).alias("an"), number(3).cast("int").alias("b"), count(4).alias("bn"))))
    t = t.withColumn("file_no", F.count(F.when(F.col("line").startswith("diff --git "), 1)).over(order)).withColumn("at", F.last("head", True).over(order))
    by_hunk = Window.partitionBy("diff_id", "at.pos").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    mark = F.substring("line", 1, 1)
    t = t.withColumn("mark", mark).withColumn("minus", F.count(F.when((F.col("pos") > F.col("at.pos")) & F.col("mark").isin("-", " "), 1)).over(by_hunk)).withColumn("plus", F.count(F.when((F.col("pos") > F.col("at.pos")) & F.col("mark").isin("+", " "), 1)).over(by_hunk))
    inside = F.col("at").isNotNull() & (F.col("pos") > F.col("at.pos"))
    minus, plus = inside & (F.col("mark") == "-") & (F.col("minus") < F.col("at.an")), inside & (F.col("mark") == "+") & (F.col("plus") < F.col("at.bn"))
    header = ~(minus | plus)
    span = lambda x: F.array_sort(F.collect_list(F.when(F.col("head").isNotNull() & (F.col(f"head.{x}n") > 0), F.struct(F.col(f"head.{x}").alias("a"), (F.col(f"head.{x}") + F.col(f"head.{x}n") - 1).alias("z")))))
    name = lambda p: F.max(F.when(header, F.nullif(F.regexp_extract("line", p, 1), F.lit(""))))
    told = t.where("file_no > 0").groupBy("diff_id", "file_no").agg(
        F.coalesce(name(r"^\+\+\+ b/(.*)$"), name(r"^--- a/(.*)$"), name(r"^diff --git a/.* b/(.*)$")).alias("path"), F.max(header & F.col("line").startswith("new file mode")).alias("new_file"),
        F.max(header & F.col("line").startswith("deleted file mode")).alias("deleted"), F.count_if(plus).alias("added"), F.count_if(minus).alias("removed"), span("b").alias("ranges"), span("a").alias("old_ranges"),
    )
    return told.drop("file_no")


def changed_files(diff: DataFrame, untracked: DataFrame) -> DataFrame:
    """Distinct paths of changed and of untracked files."""
    return diff.select("path").unionByName(untracked.select("path")).distinct()
