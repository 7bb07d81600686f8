"""Changes between two versions of files' symbols as callers see them: removed, renamed, another signature, another body.

Symbols have file_id, symbol_id (in the order of the file), name, kind, lang, text, start_byte and end_byte.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.functions import signatures
from codequarry.functions.patches import let
from codequarry.operators import matching
from codequarry.shared import Scratch, dealt, large

#: The shortest body and header that tell a new name, and how alike headers must be.
LEAST_BODY, LEAST_HEADER, ALIKE = 24, 16, 0.85
#: By the call, then without the body, then by name and kind, then by name alone.
STEPS = (("name", "kind", "signature", "body"), ("name", "kind", "signature"), ("name", "kind"), ("name",))


def bigrams(text: Column) -> Column:
    """Neighbouring characters of a text, each with the number of its occurrence: the multiset as a set."""
    pairs = F.when(F.length(text) > 1, F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    return let(F.array_sort(pairs), lambda found: F.transform(found, lambda g, i: F.concat(g, (i + 2 - F.array_position(found, g)).cast("string"))))


def similarity(a: Column, b: Column) -> Column:
    """The Dice coefficient of two sets of bigrams; 0 of two empty ones."""
    return F.coalesce(F.try_divide(2.0 * F.size(F.array_intersect(a, b)), F.size(a) + F.size(b)), F.lit(0.0))


def alike_headers(old: DataFrame, new: DataFrame, least: float = ALIKE, scratch: Scratch | None = None) -> DataFrame:
    """(old_id, new_id, score) of symbols of a file and kind whose headers, of LEAST_HEADER bytes or more, are alike.

    Sets of n and m bigrams that are alike share least * (n + m) / 2 of them, so each size is at least least / (2 - least) of the
    other, and a set has a partner only where they share one of its first n - ceil(n * least / (2 - least)) + 1 bigrams,
    those first that few symbols of the file and kind have. Only such pairs are compared whole.
    """
    scratch = scratch or Scratch(old.sparkSession)
    part = least / (2 - least)
    keys = ["file_id", "kind"]
    grams = lambda df, name: df.where(F.octet_length("header") >= LEAST_HEADER).select(*keys, F.col("symbol_id").alias(name), bigrams(F.col("header")).alias("grams"))
    a, b = grams(old, "old_id"), grams(new, "new_id")
    # headers are dealt by file, and their bigrams are counted and put in order where they lie
    headers = lambda df, side: df.where(F.octet_length("header") >= LEAST_HEADER).select(*keys, F.col("symbol_id").alias("id"), F.lit(side).alias("side"), "header")
    told = headers(old, 0).unionByName(headers(new, 1))
    told = dealt(told, told.agg(F.sum(F.length("header"))).first()[0] or 0, "file_id").withColumn("grams", bigrams(F.col("header")))
    rows = told.select(*keys, "id", "side", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    alike = Window.partitionBy(*keys, "gram")
    rows = rows.withColumns({"times": F.count("*").over(alike), "both": F.min("side").over(alike) < F.max("side").over(alike)})
    place = F.row_number().over(Window.partitionBy(*keys, "side", "id").orderBy("times", "gram"))
    first = scratch.write("first_grams", rows.withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * part - 1e-9) + 1).where("both").select(*keys, "id", "side", "n", "gram"))
    one, two = (first.where(F.col("side") == side).select(*keys, "gram", F.col("id").alias(name), F.col("n").alias(f"n_{name}")) for side, name in ((0, "old_id"), (1, "new_id")))
    sized = F.least("n_old_id", "n_new_id") >= part * F.greatest("n_old_id", "n_new_id") - 1e-9
    pairs = scratch.write("pairs", large(one).join(two, [*keys, "gram"]).where(sized).select("old_id", "new_id").distinct())
    told = large(large(pairs).join(a.select("old_id", F.col("grams").alias("x")), "old_id")).join(b.select("new_id", F.col("grams").alias("y")), "new_id")
    return told.select("old_id", "new_id", similarity(F.col("x"), F.col("y")).alias("score")).where(F.col("score") >= least)


def renamed(gone: DataFrame, added: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(old_id, new_id): the new names of removed symbols among the added ones of their file and kind, at most one each way.

    Equal bodies of LEAST_BODY bytes or more pair up in order. Of the rest, those with equal calls that have parameters, or with
    headers alike, are renamed where each is the other's only best partner: equally good ones tell nothing. What several steps read is written.
    """
    scratch = scratch or Scratch(gone.sparkSession)
    by = Window.partitionBy("file_id", "kind", "body").orderBy("symbol_id")
    of = lambda df, name: df.where(F.col("body_len") >= LEAST_BODY).select("file_id", "kind", "body", F.col("symbol_id").alias(name), F.row_number().over(by).alias("place"))
    same = scratch.write("same", large(of(gone, "old_id")).join(of(added, "new_id"), ["file_id", "kind", "body", "place"]).select("old_id", "new_id"))
    needed = ("symbol_id", "file_id", "kind", "call", "header")
    rest = scratch.write("rest", large(gone.select(*needed)).join(same.select(F.col("old_id").alias("symbol_id")), "symbol_id", "left_anti"))
    left = scratch.write("left", large(added.select(*needed)).join(same.select(F.col("new_id").alias("symbol_id")), "symbol_id", "left_anti"))
    called = lambda df, name: df.where("size(call.params) > 0").select("file_id", "kind", F.to_json("call").alias("shape"), F.col("symbol_id").alias(name))
    equal = large(called(rest, "old_id")).join(called(left, "new_id"), ["file_id", "kind", "shape"]).select("old_id", "new_id", F.lit(1.0).alias("score"))
    scored = scratch.write("scored", equal.unionByName(alike_headers(rest, left, scratch=scratch)).groupBy("old_id", "new_id").agg(F.max("score").alias("score")))
    scratch.drop("rest", "left", "first_grams", "pairs")

    def only_best(df: DataFrame, one: str, other: str) -> DataFrame:
        best = df.groupBy(one).agg(F.max("score").alias("best"))
        top = large(df).join(best, one).where("score = best").groupBy(one).agg(F.min(other).alias(other), F.count("*").alias("n"))
        return top.where("n = 1").select(one, other)

    found = large(only_best(scored, "old_id", "new_id")).join(only_best(scored, "new_id", "old_id"), ["old_id", "new_id"])
    return same.unionByName(found.select("old_id", "new_id"))


def shape_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file_id, change, name, kind, old_id, new_id, renamed_to) of the symbols of old, in a table of the shared folder.

    removed: no symbol of the name is left; signature: calls don't work as they are, or an overload is gone that nothing left takes;
    body: what is left, of the innermost symbols that changed. White space, comments, visibility and names that calls
    can't use change nothing. Each kind of change is a table before they meet, so that its shuffle files alone lie on disk.
    """
    scratch = Scratch(old.sparkSession)
    columns = ["file_id", "symbol_id", "name", "kind", "lang", "start_byte", "end_byte"]
    shaped = lambda df: signatures.with_shapes(df.select(*columns, "text").repartition("file_id")).select(*columns, "call", F.coalesce(F.to_json("call"), F.lit("")).alias("signature"), F.md5("body").alias("body"), "body_len", "header")
    old, new = scratch.write("old", shaped(old)), scratch.write("new", shaped(new))
    met = scratch.write("met", matching.versions(old, new, STEPS))
    a, b = (df.select(F.col("symbol_id").alias(f"{x}_id"), *(F.col(c).alias(f"{x}_{c}") for c in ("call", "body", "kind", "start_byte", "end_byte")), *more) for df, x, more in ((old, "old", ["lang"]), (new, "new", ["file_id", "name"])))
    pairs = large(large(met.select("old_id", "new_id")).join(a, "old_id")).join(b, "new_id")
    both, none = F.col("old_call").isNotNull() & F.col("new_call").isNotNull(), F.col("old_call").isNull() & F.col("new_call").isNull()
    differs = F.when(both, ~signatures.compatible(F.col("lang"), F.col("old_call"), F.col("new_call"))).when(none, False).otherwise(~F.col("new_kind").isin(*signatures.CALLABLE))
    changed = scratch.write("changed", pairs.withColumn("differs", differs).where("differs or old_body <> new_body").select("file_id", "old_id", "new_id", "name", F.col("new_kind").alias("kind"), "differs", "new_start_byte", "new_end_byte"))
    around = changed.select("file_id", F.col("new_start_byte").alias("s"), F.col("new_end_byte").alias("e"))
    inner = (F.col("file_id") == F.col("f")) & (F.col("new_start_byte") <= F.col("s")) & (F.col("e") <= F.col("new_end_byte")) & ((F.col("s") != F.col("new_start_byte")) | (F.col("e") != F.col("new_end_byte")))
    bodies = scratch.write("bodies", large(changed.where("not differs")).join(around.withColumnRenamed("file_id", "f"), inner, "left_anti"))

    unmet = scratch.write("unmet", large(old).join(met.select(F.col("old_id").alias("symbol_id")), "symbol_id", "left_anti"))
    scratch.drop("met")
    names = new.groupBy("file_id", "name").agg(F.min("symbol_id").alias("new_id"))
    once = lambda df: df.withColumn("nth", F.row_number().over(Window.partitionBy("file_id", "name", "kind").orderBy("symbol_id"))).where("nth = 1").drop("nth")
    gone = scratch.write("gone", once(large(unmet).join(names, ["file_id", "name"], "left_anti")))
    added = scratch.write("added", large(new).join(old.select("file_id", "name").distinct(), ["file_id", "name"], "left_anti"))
    scratch.drop("old")
    told = large(scratch.write("renamed", renamed(gone, added, scratch))).join(new.select(F.col("symbol_id").alias("new_id"), F.col("name").alias("renamed_to")), "new_id")
    removed = scratch.write("removed", large(gone).join(told.withColumnRenamed("old_id", "symbol_id"), "symbol_id", "left").select("file_id", F.lit("removed").alias("change"), "name", "kind", F.col("symbol_id").alias("old_id"), "new_id", "renamed_to"))
    scratch.drop("same", "scored", "renamed", "gone", "added")

    left = new.select("file_id", "name", F.col("call").alias("left_call"), F.col("kind").alias("left_kind"))
    fits = F.when(F.col("call").isNotNull() & F.col("left_call").isNotNull(), signatures.overload_fits(F.col("lang"), F.col("call"), F.col("left_call"))).when(F.col("call").isNull() & F.col("left_call").isNull(), True).otherwise(F.col("left_kind").isin(*signatures.CALLABLE))
    overloads = large(unmet).join(left, ["file_id", "name"]).groupBy("file_id", "symbol_id", "name", "kind").agg(F.max(fits).alias("fits")).where("not fits")
    overloads = scratch.write("overloads", large(once(overloads)).join(names, ["file_id", "name"]))

    plain = lambda df, change, old_id="old_id": df.select("file_id", F.lit(change).alias("change"), "name", "kind", F.col(old_id).alias("old_id"), "new_id", F.lit(None).cast("string").alias("renamed_to"))
    out = scratch.write("changes", removed.unionByName(plain(changed.where("differs"), "signature")).unionByName(plain(overloads, "signature", "symbol_id")).unionByName(plain(bodies, "body")))
    scratch.keep_only("changes")
    return out
