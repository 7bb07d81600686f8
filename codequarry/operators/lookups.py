"""Lookups and joins over the code model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.functions import paths
from codequarry.operators import copies, timeline
from codequarry.shared import ROWS_A_TASK, written

MAX_DEFS = 3


def with_files(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Symbols with their file's path and language."""
    return symbols.join(files.select("file_id", "path", "lang"), "file_id")


def symbols_by_name(symbols: DataFrame, files: DataFrame, name: str, limit: int) -> DataFrame:
    return with_files(symbols.where(F.col("name") == name), files).orderBy("path", "start_line", "symbol_id").limit(limit)


def files_under(files: DataFrame, folder: str) -> DataFrame:
    """Files below a folder, with the rest of their path."""
    return files.where(F.col("path").startswith(folder + "/")).select("file_id", F.expr(f"substring(path, {len(folder) + 2})").alias("rest"))


def references(refs: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """References with their file and the name of the symbol around them, null outside symbols."""
    around = symbols.select(F.col("symbol_id").alias("enclosing_symbol_id"), F.col("name").alias("enclosing"))
    return refs.join(files.select("file_id", "path"), "file_id").join(around, "enclosing_symbol_id", "left").select("path", "line", "kind", "name", "enclosing")


def definitions(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("name").agg(F.count("*").alias("defs"))


def file_ref_edges(refs: DataFrame, symbols: DataFrame, files: DataFrame, most: int = MAX_DEFS) -> DataFrame:
    """(src, dst, n): references between files of one language family, by names with at most `most` definitions.

    Definitions and references are summed by file before they meet, so a name that one file uses often costs one row.
    """
    fam = files.select("file_id", paths.family(F.col("lang")).alias("family"))
    rare = definitions(symbols).where(F.col("defs") <= most).select("name")
    defs = symbols.groupBy("name", "file_id").agg(F.count("*").alias("d")).join(rare, "name", "left_semi").join(fam, "file_id").select("name", F.col("file_id").alias("dst"), "d", "family")
    uses = refs.groupBy("name", "file_id").agg(F.count("*").alias("r")).join(fam, "file_id").select("name", F.col("file_id").alias("src"), "r", "family")
    return uses.join(defs, ["name", "family"]).where("src <> dst").groupBy("src", "dst").agg(F.sum(F.col("d") * F.col("r")).alias("n"))


def file_summaries(files: DataFrame, symbols: DataFrame) -> DataFrame:
    n = symbols.groupBy("file_id").agg(F.count("*").alias("n"))
    return files.select("file_id", "path", "lang").join(n, "file_id", "left").select("path", "lang", F.coalesce("n", F.lit(0)).alias("n_symbols"))


def contains(outer: str, inner: str) -> Column:
    """Whether the symbol `outer` spans `inner` in the same file, equal spans included."""
    return (F.col(f"{outer}.file_id") == F.col(f"{inner}.file_id")) & (F.col(f"{outer}.start_byte") <= F.col(f"{inner}.start_byte")) & (F.col(f"{inner}.end_byte") <= F.col(f"{outer}.end_byte"))


def innermost(hits: DataFrame) -> DataFrame:
    """The symbols that contain no other of the given ones."""
    return hits.alias("s").join(hits.alias("o"), contains("s", "o") & (F.col("s.symbol_id") != F.col("o.symbol_id")), "left_anti")


def top_level(symbols: DataFrame) -> DataFrame:
    """The symbols that no other contains; of equal spans all stay."""
    strict = (F.col("o.start_byte") < F.col("s.start_byte")) | (F.col("o.end_byte") > F.col("s.end_byte"))
    return symbols.alias("s").join(symbols.alias("o"), contains("o", "s") & strict, "left_anti")


def enclosing(points: DataFrame, symbols: DataFrame) -> DataFrame:
    """For each (file_id, line) the narrowest symbol around it, the first of equal ones; none: no row."""
    span = symbols.select("file_id", "symbol_id", "start_line", "end_line")
    held = points.join(span, "file_id").where(F.col("line").between(F.col("start_line"), F.col("end_line")))
    best = F.min_by("symbol_id", F.struct(F.col("end_line") - F.col("start_line"), F.col("start_line"), F.col("symbol_id")))
    return held.groupBy("file_id", "line").agg(best.alias("symbol_id"))


def touched(symbols: DataFrame, ranges: DataFrame) -> DataFrame:
    """Symbols that overlap a changed range (file_id, a, z) of their file."""
    overlap = (F.col("start_line") <= F.col("z")) & (F.col("a") <= F.col("end_line"))
    return symbols.join(ranges.withColumnRenamed("file_id", "changed"), (F.col("file_id") == F.col("changed")) & overlap, "left_semi")


def callers(symbols: DataFrame, refs: DataFrame, files: DataFrame, most: int = MAX_DEFS) -> DataFrame:
    """(symbol_id, caller_id): symbols around references to a symbol's name, in its language family, outside itself.

    Names with more than `most` definitions have no callers.
    """
    fam = files.select("file_id", paths.family(F.col("lang")).alias("family"))
    rare = definitions(symbols).where(F.col("defs") <= most).select("name")
    target = symbols.join(rare, "name", "left_semi").join(fam, "file_id").select("name", "symbol_id", "family", F.col("file_id").alias("t_file"), F.col("start_byte").alias("t_from"), F.col("end_byte").alias("t_to"))
    used = refs.where("enclosing_symbol_id is not null").select("name", F.col("enclosing_symbol_id").alias("caller_id")).distinct()
    span = symbols.join(fam, "file_id").select(F.col("symbol_id").alias("caller_id"), F.col("family").alias("c_family"), F.col("file_id").alias("c_file"), F.col("start_byte").alias("c_from"), F.col("end_byte").alias("c_to"))
    met = target.join(used, "name").join(span, "caller_id").where("family = c_family and symbol_id <> caller_id")
    inside = (F.col("t_file") == F.col("c_file")) & (F.col("t_from") <= F.col("c_from")) & (F.col("c_to") <= F.col("t_to"))
    return met.where(~inside).select("symbol_id", "caller_id")


def as_of_before(left: DataFrame, commits: DataFrame) -> DataFrame:
    """left with the hash of the last commit at or before its ts: both are put on one time line, cut into days.

    Within a day the last commit so far is carried on; a day without one so far takes the last commit of earlier days, found
    among one row a day.
    """
    day = F.floor(F.col("ts") / 86400)
    line = left.select("key", "ts", F.lit(None).cast("long").alias("hash"), F.lit(1).alias("kind")).unionByName(commits.select(F.lit(None).cast("long").alias("key"), F.col("ct").alias("ts"), F.col("hash").cast("long").alias("hash"), F.lit(0).alias("kind")))
    line = line.withColumn("day", day)
    last = line.where("kind = 0").groupBy("day").agg(F.max_by("hash", F.struct("ts", "hash")).alias("last"))
    days = line.select("day").distinct().join(last, "day", "left")
    earlier = days.withColumn("earlier", F.last("last", True).over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1))).select("day", "earlier")
    so_far = F.last("hash", True).over(Window.partitionBy("day").orderBy("ts", "kind", "hash").rowsBetween(Window.unboundedPreceding, 0))
    return line.withColumn("so_far", so_far).where("kind = 1").join(earlier, "day").select("key", F.coalesce("so_far", "earlier").alias("hash"))


def first_commit_within(edits: DataFrame, commits: DataFrame, commit_files: DataFrame, seconds: int) -> DataFrame:
    """For each edit (key, file_id, ts) the first commit that touches its file at ts or up to `seconds` later; none: no row."""
    return timeline.first_within(*_on_line(edits, commits, commit_files), seconds).select("key", F.col("tie").alias("hash"))


def last_commit_within(edits: DataFrame, commits: DataFrame, commit_files: DataFrame, seconds: int) -> DataFrame:
    """For each edit (key, file_id, ts) the last commit after ts, and at most `seconds` later, that touches its file; none: no row."""
    return timeline.last_within(*_on_line(edits, commits, commit_files), seconds).select("key", F.col("tie").alias("hash"))


def _on_line(edits: DataFrame, commits: DataFrame, commit_files: DataFrame) -> tuple[DataFrame, DataFrame]:
    touching = written(commit_files.distinct().join(commits, "hash").select(F.col("file_id").alias("id"), F.col("ct").alias("at"), F.col("hash").alias("tie"), F.lit(None).cast("int").alias("value")), "touching")
    points = edits.select("key", F.col("file_id").alias("id"), F.col("ts").alias("at"), F.lit(None).cast(dict(commits.dtypes)["hash"]).alias("tie"))
    return points, touching


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, action) of an index refresh: removed, added, unchanged (same time and size), touched (same hash) or changed."""
    a, b = before.alias("a"), after.alias("b")
    same = (F.col("a.mtime") == F.col("b.mtime")) & (F.col("a.size") == F.col("b.size"))
    action = F.when(F.col("b.path").isNull(), "removed").when(F.col("a.path").isNull(), "added").when(same, "unchanged").when(F.col("a.hash") == F.col("b.hash"), "touched").otherwise("changed")
    return a.join(b, F.col("a.path") == F.col("b.path"), "full_outer").select(F.coalesce("a.path", "b.path").alias("path"), action.alias("action"))


def wildcard_pairs(files: DataFrame) -> DataFrame:
    """(dir_a, dir_b, n): folders whose files have equal paths but for one segment, and how many do; such folders have one parent."""
    below = copies.below_folders(files.select("path", F.lit(None).cast("string").alias("hash"), F.lit(None).cast("long").alias("mtime"))).select("parent", "place", "dir")
    a, b = (below.select("parent", "place", F.col("dir").alias(f"dir_{x}")) for x in "ab")
    return a.join(b, ["parent", "place"]).where("dir_a < dir_b").groupBy("dir_a", "dir_b").agg(F.count("*").alias("n"))


def cochange(commit_files: DataFrame, least: int = 2, lines: tuple[int, int] = (2, 30)) -> DataFrame:
    """(file_a, file_b, cnt): how many commits hold both files; commits outside the range of lines, repeats counted, don't count.

    Rows and pairs are counted first, and dealt to as many tasks as they need, so that a task's memory doesn't grow with the history.
    """
    sizes = commit_files.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n").between(*lines))
    told = sizes.agg(F.sum("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()
    spark = commit_files.sparkSession
    tasks = lambda rows: max(spark.sparkContext.defaultParallelism, int(rows or 0) // ROWS_A_TASK + 1)
    dealt = commit_files.repartition(tasks(told[0]), "hash")
    small = dealt.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n").between(*lines)).select("hash")
    sized = dealt.join(small, "hash", "left_semi").groupBy("hash").agg(F.collect_set("file_id").alias("ids"))
    one = sized.select("ids", F.explode("ids").alias("file_a"))
    pairs = one.select("file_a", F.explode("ids").alias("file_b")).where("file_a < file_b")
    return pairs.repartition(tasks(told[1]), "file_a", "file_b").groupBy("file_a", "file_b").agg(F.count("*").alias("cnt")).where(F.col("cnt") >= least)


def cochanged(pairs: DataFrame) -> DataFrame:
    """Pairs in both directions."""
    return pairs.select("file_a", "file_b", "cnt").unionByName(pairs.select(F.col("file_b").alias("file_a"), F.col("file_a").alias("file_b"), "cnt"))


def scoped(files: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, root, rest): paths that are or lie below a root, with the longest such root and what follows it.

    A path meets the roots by equality with its own beginnings, one a folder, so neither side is compared whole with the other.
    """
    parts = F.split("path", "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    met = files.select("path").distinct().select("path", F.explode(heads).alias("root")).join(roots.select("root").distinct(), "root")
    best = met.groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
    return best.select("path", "root", F.expr("substring(path, length(root) + 2)").alias("rest"))


def file_ref_counts(refs: DataFrame, symbols: DataFrame, files: DataFrame, most: int = MAX_DEFS) -> DataFrame:
    """(file_id, incoming, outgoing): how many other files of its language family refer to a file, and how many it refers to."""
    edges = file_ref_edges(refs, symbols, files, most).select("src", "dst")
    ends = edges.select(F.inline(F.array(F.struct(F.col("dst").alias("file_id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("file_id"), F.lit(0).alias("i"), F.lit(1).alias("o")))))
    sums = ends.groupBy("file_id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    return files.select("file_id").join(sums, "file_id", "left").select("file_id", F.coalesce("i", F.lit(0)).alias("incoming"), F.coalesce("o", F.lit(0)).alias("outgoing"))


def best_of_file(scored: DataFrame) -> DataFrame:
    """(file_id, symbol_id, score): each file's row (file_id, symbol_id, start_line, score) of the highest score, the first of equal ones."""
    order = F.struct("score", -F.col("start_line"), -F.col("symbol_id"))
    return scored.groupBy("file_id").agg(F.max_by("symbol_id", order).alias("symbol_id"), F.max("score").alias("score"))
