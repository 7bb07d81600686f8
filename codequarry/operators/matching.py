"""Joins that pair rows by more than a plain key: suffixes, requests and results, versions of symbols, prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_suffix(mentions: DataFrame, files: DataFrame) -> DataFrame:
    """(mention, path): the first path that equals a mentioned one or ends with it behind a slash; none: no row.

    Every path is told by all its suffixes, so the join is on equal strings.
    """
    parts = F.split("path", "/")
    tails = files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("mention"))
    return mentions.select("mention").distinct().join(tails, "mention").groupBy("mention").agg(F.min("path").alias("path"))


def answered(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls (call_id, ...) with their result's ok; calls without a result stay, with a null ok."""
    first = results.groupBy("call_id").agg(F.min_by("ok", "seq").alias("ok"))
    return calls.join(first, "call_id", "left")


def priced(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """(priced, unpriced, dollars) of usage by model; models without a price count, but cost nothing."""
    told = usage.join(prices, "model", "left")
    dollars = F.sum((F.col("input") * F.col("price_in") + F.col("output") * F.col("price_out")) / 1e6)
    return told.agg(F.count_if(F.col("price_in").isNotNull()).alias("priced"), F.count_if(F.col("price_in").isNull()).alias("unpriced"), dollars.alias("dollars"))


def changed_since(kept: DataFrame, now: DataFrame) -> DataFrame:
    """Paths of a checkpoint (path, hash) whose hash is another one now, nulls being equal to each other."""
    return kept.join(now.select(F.col("path").alias("p"), F.col("hash").alias("h")), F.col("path") == F.col("p"), "left").where(~F.col("hash").eqNullSafe(F.col("h"))).select("path")


STEPS = (("name", "signature", "body"), ("name", "signature"), ("name", "kind"), ("name",))


def versions(old: DataFrame, new: DataFrame, steps: tuple[tuple[str, ...], ...] = STEPS) -> DataFrame:
    """(old_id, new_id, step): symbols of a file before and after, matched one to one.

    First equal name, signature and body, then equal name and signature, then equal name and kind, then equal name, or by the
    columns of other steps; equal candidates pair up in their order of ids. Only what is unmatched goes to the next step.
    """
    out = None
    for no, names in enumerate(steps, 1):
        keys = ["file_id", *names]
        place = lambda ids, keys=keys: F.row_number().over(Window.partitionBy(*keys).orderBy(ids))
        a = old.select(*keys, F.col("symbol_id").alias("old_id")).withColumn("place", place("old_id"))
        b = new.select(*keys, F.col("symbol_id").alias("new_id")).withColumn("place", place("new_id"))
        met = a.join(b, [*keys, "place"]).select("old_id", "new_id", F.lit(no).alias("step"))
        out = met if out is None else out.unionByName(met)
        old = old.join(met.select(F.col("old_id").alias("symbol_id")), "symbol_id", "left_anti")
        new = new.join(met.select(F.col("new_id").alias("symbol_id")), "symbol_id", "left_anti")
    return out


def symbol_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(symbol_id, change) of the old symbols: removed, signature (another one now) or body; unchanged ones have no row."""
    met = versions(old, new)
    a = old.select(F.col("symbol_id").alias("old_id"), F.col("signature").alias("old_sig"), F.col("body").alias("old_body"))
    b = new.select(F.col("symbol_id").alias("new_id"), "signature", "body")
    told = a.join(met, "old_id", "left").join(b, "new_id", "left")
    change = F.when(F.col("new_id").isNull(), "removed").when(F.col("old_sig") != F.col("signature"), "signature").when(F.col("old_body") != F.col("body"), "body")
    return told.select(F.col("old_id").alias("symbol_id"), change.alias("change")).where("change is not null")


def renames(old: DataFrame, new: DataFrame, least_body: int = 24) -> DataFrame:
    """(old_id, new_id): removed symbols whose body, of at least `least_body` characters, one added symbol of the kind in the file has."""
    met = versions(old, new)
    gone = old.join(met.select(F.col("old_id").alias("symbol_id")), "symbol_id", "left_anti").where(F.length("body") >= least_body)
    added = new.join(met.select(F.col("new_id").alias("symbol_id")), "symbol_id", "left_anti")
    pairs = gone.select("file_id", "kind", "body", F.col("symbol_id").alias("old_id")).join(added.select("file_id", "kind", "body", F.col("symbol_id").alias("new_id")), ["file_id", "kind", "body"])
    return pairs.groupBy("old_id").agg(F.min("new_id").alias("new_id"))


def left_behind(changes: DataFrame, refs: DataFrame, remaining: DataFrame, most_defs: int = 5, most: int = 20) -> DataFrame:
    """Findings (name, file_id, change, line, n): files that still refer to a removed or changed name.

    changes has (name, change). A removed name that is still defined elsewhere is no finding, nor is a name with more than
    most_defs definitions; each file counts once, by its first reference, and the first `most` findings stay.
    """
    defs = remaining.groupBy("name").agg(F.count("*").alias("defs"))
    told = changes.join(defs, "name", "left").where((F.coalesce("defs", F.lit(0)) <= most_defs) & ~((F.col("change") == "removed") & (F.coalesce("defs", F.lit(0)) > 0)))
    found = told.join(refs, "name").groupBy("name", "change", "file_id").agg(F.min("line").alias("line"), F.count("*").alias("n"))
    return found.orderBy(F.when(F.col("change") == "removed", 0).otherwise(1), "name", "file_id").limit(most)
