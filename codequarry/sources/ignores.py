"""Ignore rules of a tree: ordered patterns by folder, with negation, anchors and folders only.

A pattern is compiled once to a regular expression. Every folder and file of a path meets the rules of the folders above it by equal
folder names, the last rule that matches decides, and what lies below a shut folder stays shut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _expression(pattern: Column) -> Column:
    """A cleaned pattern as a regular expression over a path: stars stay within a segment, two of them go across."""
    p = F.regexp_replace(pattern, r"([.+^${}()|\\])", r"\\$1")
    p = F.regexp_replace(F.regexp_replace(F.regexp_replace(p, r"^(?:\*\*/)+", "\u0001"), r"/(?:\*\*/)+", "\u0002"), r"/\*\*$", "\u0003")
    p = F.regexp_replace(F.regexp_replace(F.regexp_replace(p, r"\*+", "[^/]*"), r"\?", "[^/]"), r"\[!", "[^")
    for mark, across in (("\u0001", "(?:.*/)?"), ("\u0002", "/(?:.*/)?"), ("\u0003", "/.*")):
        p = F.replace(p, F.lit(mark), F.lit(across))
    return p


def rules(files: DataFrame) -> DataFrame:
    """(folder, rules) of ignore files (folder, text): an array of (no, negated, folders_only, regex) in order; comments and blank lines are none."""
    lines = files.select("folder", F.posexplode(F.split("text", "\r?\n")).alias("no", "line")).withColumn("line", F.rtrim("line")).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    bare = F.regexp_replace(F.regexp_replace("line", "^!", ""), r"^\\(?=[#!])", "")
    told = lines.select("folder", "no", F.col("line").startswith("!").alias("negated"), bare.endswith("/").alias("folders_only"), F.regexp_replace(bare, "/+$", "").alias("p")).where("p not in ('', '/')")
    anchored = F.contains("p", F.lit("/"))
    regex = F.concat(F.lit("^"), F.when(anchored, "").otherwise("(?:.*/)?"), _expression(F.regexp_replace("p", "^/", "")), F.lit("$"))
    return told.groupBy("folder").agg(F.array_sort(F.collect_list(F.struct("no", "negated", "folders_only", regex.alias("regex")))).alias("rules"))


def ignored(paths_: DataFrame, rules_: DataFrame) -> DataFrame:
    """(path) of the paths of files that the rules shut, by themselves or by a folder above them."""
    parts = F.split("path", "/")
    upto = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("node"), (n < F.size(parts)).alias("is_folder")))
    nodes = paths_.select("path").distinct().select("path", F.inline(upto))
    split = F.split("node", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(split) - 1), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(split, F.lit(1), n), "/").alias("folder"), F.array_join(F.slice(split, n + 1, F.size(split)), "/").alias("rest")))
    met = nodes.select("node", "is_folder").distinct().select("node", "is_folder", F.inline(above)).join(rules_, "folder")
    hits = F.filter("rules", lambda r: F.rlike(F.col("rest"), r["regex"]) & (~r["folders_only"] | F.col("is_folder")))
    last = met.withColumn("hit", F.try_element_at(hits, F.lit(-1))).where("hit is not null").groupBy("node", "is_folder").agg(F.max_by("hit.negated", "depth").alias("negated"))
    return nodes.join(last.where("not negated"), ["node", "is_folder"], "left_semi").select("path").distinct()
