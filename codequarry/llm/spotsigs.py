"""SpotSigs fingerprints, with DataFrame functions only.

Where common words stand (the anchors), the CHAIN content words that follow form a signature, whatever common words stand
between them. A document's fingerprint is the sorted set of the signatures' hashes; a text without any has the hash of its
words, or of itself, in their place. Fingerprints are compared by the Jaccard coefficient, which is not worked out where the
lengths of the two sets rule out the threshold; near pairs are searched within neighbouring partitions of set length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.llm.common import Scratch

CHAIN = 2
#: Common words of four languages.
ANCHORS = (
    "the a an and of to in is it be by as at for was with on are this that from or not "
    "le la les un une des du de et en que qui dans pour est par sur au aux ce il elle avec "
    "der die das und ist von mit den dem ein eine zu im auf nicht für sich des es auch "
    "el los las una y que se del por con para su lo al como más o"
).split()
#: Documents in one bucket of the ordering, about.
BUCKET_ROWS = 4096
_ANCHORS = "|".join(sorted(set(ANCHORS)))
_BREAK = r"[^\p{L}\p{N}]+"


def signatures(text: Column) -> Column:
    """The sorted distinct signature hashes of a text, 8 hexadecimal digits each."""
    flat = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), _BREAK, " "), F.lit(" "))
    # possessive: a long run of common words must not take a stack frame each
    marked = F.regexp_replace(flat, f"(?: (?:{_ANCHORS})(?= ))++ ", " #")
    words = F.filter(F.split(marked, " "), lambda w: (w != "") & (w != "#"))

    def chain(ws: Column) -> Column:
        told = F.transform(ws, lambda w, i: F.when(w.startswith("#") & (i + CHAIN <= F.size(ws)), F.translate(F.array_join(F.slice(ws, i + 1, CHAIN), " "), "#", "")))
        return F.array_sort(F.array_distinct(F.transform(F.filter(told, lambda s: s.isNotNull()), lambda s: F.substring(F.md5(s), 1, 8))))

    # the words are bound once, as the element of an array of one
    return F.element_at(F.transform(F.array(words), chain), 1)


def fingerprint(text: Column) -> Column:
    """Signature hashes joined by spaces; equal texts have equal fingerprints."""
    joined = F.array_join(signatures(text), " ")
    return F.when(joined == "", F.concat(F.lit("="), F.md5(text))).otherwise(joined)


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard coefficient of two fingerprints; 0 where the lengths of their sets show that it is under least."""
    x, y = F.split(a, " "), F.split(b, " ")
    bound = F.least(F.size(x), F.size(y)) / F.greatest(F.size(x), F.size(y))
    both = F.size(F.array_intersect(x, y))
    return F.when(a == b, 1.0).when(bound < least, 0.0).otherwise(both / (F.size(x) + F.size(y) - both))


def with_next(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """docs (doc_id, text) with fp, and with next_text and next_fp of the document with the next lower id, after the lowest the highest.

    Rows are cut by sampled quantiles of (doc_id, text) into buckets of about BUCKET_ROWS, each sorted alone, so neither one
    outlying id nor many rows without an id fill a bucket; a bucket ends with a copy of the next bucket's first row. Documents
    that share an id are ordered by text; null ids come last.
    """
    buckets = max(1, -(-docs.count() // BUCKET_ROWS))
    dealt = docs.select("doc_id", "text").repartitionByRange(buckets, F.desc_nulls_last("doc_id"), F.asc("text"))
    dealt = scratch.write("dealt", dealt.withColumn("bucket", F.spark_partition_id()))
    first = dealt.groupBy("bucket").agg(F.min_by("text", F.struct(F.col("doc_id").isNull(), -F.col("doc_id"), "text")).alias("text"))
    held = scratch.write("firsts", first)
    # the bucket before each: one small row a bucket
    ends = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    into = held.select("bucket", F.coalesce(F.lag("bucket").over(Window.orderBy("bucket")), F.last("bucket").over(ends)).alias("into"))
    ghosts = held.join(into, "bucket").select(F.lit(None).cast("long").alias("doc_id"), "text", F.col("into").alias("bucket"), F.lit(1).alias("ghost"))
    rows = dealt.select("doc_id", "text", "bucket", F.lit(0).alias("ghost")).unionByName(ghosts).repartition("bucket")
    order = Window.partitionBy("bucket").orderBy("ghost", F.desc_nulls_last("doc_id"), "text")
    told = rows.withColumn("fp", fingerprint(F.col("text"))).withColumn("next", F.lead(F.struct("text", "fp")).over(order))
    return told.where("ghost = 0").select("doc_id", "text", "fp", F.col("next.text").alias("next_text"), F.col("next.fp").alias("next_fp"))


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprint each document and its text whose second half is replaced by the next document's beginning.

    Null texts are empty, repeated rows and null ids have a row each, an empty table has none; columns but doc_id and text aren't
    read. Very long texts are whole values of a row.
    """
    scratch = Scratch(docs.sparkSession)
    told = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = with_next(told, scratch).select("doc_id", n.cast("long").alias("n_chars"), F.col("fp").alias("fingerprint"), "next_fp", edited.alias("edited"))
    rows = rows.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fp")).alias("near_next"),
    )


def near_pairs(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Members (doc_id, class_id) of equal fingerprints, and pairs (a, b, likeness) of classes at least threshold alike.

    A class is named by the hash of its fingerprint, so rows that share an id may be in different classes, and rows without one
    are members like any other. Null and empty texts have the empty text's fingerprint; an empty table has no rows; other columns
    aren't read. A set of n signatures is in length partition floor(log n / log(1/threshold)), so that partners are in the same or a
    neighbouring one. There, partners share one of the first n - ceil(threshold * n) + 1 signatures, those first that the fewest
    classes have. Copies never meet, only different fingerprints do; all of a crowd of those that are alike are pairs.
    """
    told = docs.select("doc_id", fingerprint(F.coalesce("text", F.lit(""))).alias("fp")).withColumn("class_id", F.md5("fp"))
    members, classes = told.select("doc_id", "class_id"), told.select("fp", "class_id").dropDuplicates(["class_id"])
    sigs = classes.select("fp", "class_id", F.explode(F.split("fp", " ")).alias("sig"))
    times = sigs.groupBy("sig").agg(F.count("*").alias("times"))
    ranked = sigs.join(times, "sig").groupBy("fp", "class_id").agg(F.array_sort(F.collect_list(F.struct("times", "sig"))).alias("ranked"))
    sets = ranked.select("fp", "class_id", F.transform("ranked", lambda x: x["sig"]).alias("sigs")).withColumn("n", F.size("sigs"))
    sets = sets.withColumn("part", F.floor(F.log(F.col("n").cast("double")) / math.log(1 / threshold) + 1e-9))
    first = sets.withColumn("sig", F.explode(F.slice("sigs", F.lit(1), F.col("n") - F.ceil(F.col("n") * threshold - 1e-9).cast("int") + 1)))
    left = first.select(F.col("class_id").alias("a"), "sig", "part", F.col("n").alias("n_a"))
    right = first.select(F.col("class_id").alias("b"), "sig", F.col("n").alias("n_b"), F.explode(F.array(F.col("part") - 1, F.col("part"), F.col("part") + 1)).alias("part"))
    found = left.join(right, ["sig", "part"]).where((F.col("a") < F.col("b")) & (F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b"))).select("a", "b").distinct()
    fa, fb = sets.select(F.col("class_id").alias("a"), F.col("fp").alias("fp_a")), sets.select(F.col("class_id").alias("b"), F.col("fp").alias("fp_b"))
    pairs = found.join(fa, "a").join(fb, "b").select("a", "b", likeness(F.col("fp_a"), F.col("fp_b"), threshold).alias("likeness")).where(F.col("likeness") >= threshold)
    return members, pairs


def _oracle_fp(text: str) -> str:
    words = f"list_filter(string_split(regexp_replace(' ' || regexp_replace(lower({text}), '{_BREAK}', ' ', 'g') || ' ', '(?: (?:{_ANCHORS}))+ ', ' #', 'g'), ' '), lambda w: w <> '' AND w <> '#')"
    return words


ORACLE = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), l AS (
  SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id DESC, text), first_value(text) OVER (ORDER BY doc_id DESC, text)) AS next_text FROM d
), e AS (
  SELECT doc_id, text, next_text, substr(text, 1, length(text) - length(text) // 2) || substr(next_text, 1, length(text) // 2) AS edited FROM l
), w AS (
  SELECT *, {_oracle_fp("text")} AS w1, {_oracle_fp("edited")} AS w2, {_oracle_fp("next_text")} AS w3 FROM e
), s AS (
  SELECT doc_id, text, edited, {", ".join(f"list_sort(list_distinct(list_transform(list_filter(range(1, len(w{k})), lambda i: w{k}[i][1] = '#'), lambda i: md5(replace(w{k}[i] || ' ' || w{k}[i + 1], '#', ''))[1:8]))) AS s{k}" for k in (1, 2, 3))}, next_text FROM w
), f AS (
  SELECT doc_id, text, edited, {", ".join(f"CASE WHEN len(s{k}) = 0 THEN ['=' || md5({t})] ELSE s{k} END AS f{k}" for k, t in ((1, "text"), (2, "edited"), (3, "next_text")))} FROM s
)
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, array_to_string(f1, ' ') AS fingerprint, array_to_string(f2, ' ') AS edited_fingerprint,
  len(list_intersect(f1, f2))::DOUBLE / (len(f1) + len(f2) - len(list_intersect(f1, f2))) AS near_edited,
  len(list_intersect(f1, f3))::DOUBLE / (len(f1) + len(f3) - len(list_intersect(f1, f3))) AS near_next
FROM f
"""
