"""Folders that are copies of a sibling: found by the files they share, and given way to the one that was touched last.

Two folders of one parent are copies if enough of their files are equal at the same place below them. Candidates come from a prefix
filter over (place, hash), rare ones first: a file that many folders hold, like a license, pairs none of them by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codequarry.shared import Scratch, large

#: Rows that a task of folder_copies takes.
ROWS_A_TASK = 1 << 19
#: Pairs of folders that may be broadcast to count their equal files; more are joined by a shuffle.
BROADCAST_PAIRS = 100_000
#: Equal files at least, and how many seconds later the newest file of the fresh folder is; a stale file's score.
LEAST_SAME, STALE_SECONDS, DEMOTE = 20, 86400, 0.3


def below_folders(files: DataFrame) -> DataFrame:
    """(parent, dir, place, hash, mtime): each file (path, hash, mtime) once for each folder that it is below, with its place there."""
    parts = F.split("path", "/")
    at = files.withColumn("parts", parts).select("parts", "hash", "mtime", F.explode(F.filter(F.sequence(F.lit(0), F.size("parts") - 1), lambda i: i > 0)).alias("n"))
    joined = lambda a, n: F.array_join(F.slice("parts", a, n), "/")
    return at.select(joined(F.lit(1), F.col("n") - 1).alias("parent"), joined(F.lit(1), F.col("n")).alias("dir"), joined(F.col("n") + 1, F.size("parts")).alias("place"), "hash", "mtime")


def folder_copies(files: DataFrame, least_same: int = LEAST_SAME, seconds: int = STALE_SECONDS) -> DataFrame:
    """(dir_a, dir_b, same, stale): siblings that share least_same files or more and half of the smaller one's; stale is the older one, null if times don't tell.

    Partners share one of a folder's first n - least_same + 1 files, in the order of how few siblings have them; what no sibling has comes
    first and proposes nothing. A table in the shared folder.
    """
    spark = files.sparkSession
    scratch = Scratch(spark)
    tasks = lambda rows: max(spark.sparkContext.defaultParallelism, rows // ROWS_A_TASK + 1)
    # dealt by their number, as few files of a table may hold all paths, and each stands below several folders
    dealt = files.select("path", "hash", "mtime").repartition(tasks(files.count()), "path")
    below = scratch.write("below", below_folders(dealt))
    sizes = scratch.write("sizes", below.groupBy("dir").agg(F.count("*").alias("n"), F.max("mtime").alias("newest")).where(F.col("n") >= least_same))
    alike = Window.partitionBy("parent", "place", "hash")
    met = below.repartition(tasks(below.count()), "parent", "place", "hash").where("hash is not null").withColumn("times", F.count("*").over(alike)).where("times > 1")
    shared = scratch.write("shared", met.join(sizes, "dir").select("parent", "dir", "place", "hash", "times", "n"))
    scratch.drop("below")
    # a folder's files propose up to the one that least_same - 1 come behind; that one is found without all its files in one task
    at = F.struct("times", "place")
    nth = F.row_number().over(Window.partitionBy("dir").orderBy(F.desc("at")))
    ends = shared.select("dir", at.alias("at")).withColumn("nth", nth).where(F.col("nth") == least_same).select("dir", F.col("at").alias("end"))
    first = shared.join(ends, "dir").where(at <= F.col("end"))
    side = lambda x: first.select("parent", "place", "hash", F.col("dir").alias(f"dir_{x}"))
    pairs = large(side("a")).join(large(side("b")), ["parent", "place", "hash"]).where("dir_a < dir_b").select("dir_a", "dir_b").distinct()
    pairs = scratch.write("pairs", pairs)
    pairs = F.broadcast(pairs) if pairs.count() <= BROADCAST_PAIRS else large(pairs)
    held = lambda x: shared.select(F.col("dir").alias(f"dir_{x}"), "place", F.col("hash").alias(f"hash_{x}"))
    met = held("a").join(pairs, "dir_a").select("dir_a", "dir_b", "place", F.col("hash_a").alias("hash"))
    same = large(met).join(large(held("b").withColumnRenamed("hash_b", "hash")), ["dir_b", "place", "hash"]).groupBy("dir_a", "dir_b").agg(F.count("*").alias("same"))
    of = lambda x: sizes.select(F.col("dir").alias(f"dir_{x}"), F.col("n").alias(f"n_{x}"), F.col("newest").alias(f"newest_{x}"))
    told = same.join(of("a"), "dir_a").join(of("b"), "dir_b").where((F.col("same") >= least_same) & (2 * F.col("same") >= F.least("n_a", "n_b")))
    stale = F.when(F.col("newest_a") + seconds < F.col("newest_b"), F.col("dir_a")).when(F.col("newest_b") + seconds < F.col("newest_a"), F.col("dir_b"))
    out = scratch.write("copies", told.select("dir_a", "dir_b", "same", stale.alias("stale")))
    scratch.keep_only("copies")
    return out


def demote_copies(scores: DataFrame, files: DataFrame, copies: DataFrame, factor: float = DEMOTE) -> DataFrame:
    """(query_id, path, score): candidates of which those in a stale copy give way to the fresh one, if two files or more of a query are in both.

    A stale file that is equal to the fresh one gives it its score, the greater one counts; another one keeps a part of its score. A file in
    several stale folders goes by the first pair of folders.
    """
    pairs = copies.where("stale is not null").select(F.col("stale"), F.when(F.col("stale") == F.col("dir_a"), F.col("dir_b")).otherwise(F.col("dir_a")).alias("fresh"), F.struct("dir_a", "dir_b").alias("pair"))
    parts = F.split("path", "/")
    cut = lambda df, *more: df.withColumn("parts", parts).select(*more, "path", F.explode(F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: i > 0)).alias("i"), "parts").select(*more, "path", F.array_join(F.slice("parts", F.lit(1), F.col("i")), "/").alias("dir"), F.array_join(F.slice("parts", F.col("i") + 1, F.size("parts")), "/").alias("place"))
    below = cut(scores.select("query_id", "path"), "query_id")
    old = below.join(pairs, F.col("dir") == F.col("stale")).select("query_id", "path", "place", "stale", "fresh", "pair")
    new = below.select("query_id", F.col("dir").alias("fresh"), "place")
    enough = old.join(new, ["query_id", "fresh", "place"]).groupBy("query_id", "pair").agg(F.count("*").alias("n")).where("n >= 2").select("query_id", "pair")
    hashes = files.select("path", "hash")
    twin = F.concat_ws("/", "fresh", "place")
    met = old.join(enough, ["query_id", "pair"]).withColumn("twin", twin).join(hashes.select(F.col("path").alias("twin"), F.col("hash").alias("twin_hash")), "twin").join(hashes, "path")
    first = met.groupBy("query_id", "path").agg(F.min_by(F.struct("twin", (F.col("hash") == F.col("twin_hash")).alias("same")), "pair").alias("to"))
    told = scores.join(first, ["query_id", "path"], "left")
    path = F.when(F.col("to.same"), F.col("to.twin")).otherwise(F.col("path"))
    score = F.when(~F.col("to.same"), F.col("score") * factor).otherwise(F.col("score"))
    return told.select("query_id", path.alias("path"), score.alias("score")).groupBy("query_id", "path").agg(F.max("score").alias("score"))
