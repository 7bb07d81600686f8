"""Findings of a change check held against history: did the change land, was the reference mended then, or later?

Versions (file_id, ct, hash, blob) tell which content a file has from a commit on; a null blob is a deletion. Contents (blob, text) are read
once each, however many commits and findings ask for them: definitions and references are facts of a blob.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codequarry.operators import timeline
from codequarry.shared import Scratch, large
from codequarry.sources import trees

#: How long a commit or a later fix may take, the largest content that blobs_at gives unless told otherwise, and in how many files a name is searched.
WINDOW, MOST_BYTES, MOST_FILES = 14 * 86400, 1 << 20, 300
#: A state of the working tree is later than all commits.
WORKING_TREE = (1 << 62, "working tree")
#: Findings shown first.
TOP = 5
_BLANK = re.compile(r"\s+", re.A)


def _events(versions: DataFrame) -> DataFrame:
    return versions.select(F.col("file_id").alias("id"), F.col("ct").alias("at"), F.col("hash").alias("tie"), F.struct("blob").alias("value"))


def blobs_at(wanted: DataFrame, versions: DataFrame, contents: DataFrame, most: int | None = MOST_BYTES) -> DataFrame:
    """(key, blob) of the contents that files have at a commit, wanted (key, file_id, ct, hash); those that are missing then, deleted or too large have no row.

    A null hash asks for the last commit until ct; without `most`, a content of any size counts.
    """
    points = wanted.select("key", F.col("file_id").alias("id"), F.col("ct").alias("at"), F.col("hash").alias("tie"))
    found = timeline.last_until(points, _events(versions)).select("key", F.col("value.blob").alias("blob")).where("blob is not null")
    held = contents if most is None else contents.where(F.octet_length("text") <= most)
    return found.join(held.select("blob").distinct(), "blob", "left_semi").select("key", "blob")


def _told(lines: list[str]) -> bytes:
    """A digest of lines without white space, in order."""
    return hashlib.md5("\n".join(sorted(lines)).encode("utf-8", "replace"), usedforsecurity=False).digest()


def _facts(lang: str | None, lines: list[str]) -> Iterator[tuple]:
    """(name, heads, bodies, line, n, lines) of the names that a text defines or refers to: digests of its definitions and of the lines that refer to it."""
    bare = lambda text: _BLANK.sub("", text)
    defs, refs, own = defaultdict(lambda: ([], [])), defaultdict(list), set()
    for name, _, start, end in trees.line_definitions(lang, lines):
        own.add((start, name))
        defs[name][0].append(bare(lines[start - 1]))
        defs[name][1].append(bare("".join(lines[start : max(start, end)])))
    for line, name in trees.line_calls(lines):
        if (line, name) not in own:
            refs[name].append(line)
    for name in defs.keys() | refs.keys():
        at = refs.get(name)
        told = (at[0], len(at), _told([bare(lines[k - 1]) for k in at])) if at else (None, None, None)
        yield (name, *(map(_told, defs[name]) if name in defs else (None, None)), *told)


def blob_facts(contents: DataFrame, scratch: Scratch) -> DataFrame:
    """(blob, name, heads, bodies, line, n, lines) of each content (blob, lang, text): a name it defines, refers to (n lines, line the first), or both. A table.

    Heads, bodies and lines are digests of what is compared later: without white space, one for each definition or line, sorted.
    Each text is read once, where it lies; its lines aren't shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(blob, *told) for blob, lang, lines in trees.texts_of(batch) for told in _facts(lang, lines)]
            columns = zip(*rows, strict=True) if rows else ((),) * 7
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["blob", "name", "heads", "bodies", "line", "n", "lines"])

    kind = dict(contents.dtypes)["blob"]
    types = (pa.binary() if kind == "binary" else pa.string(), pa.string(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.binary())
    files = scratch.write("contents", contents.where("text is not null").select(F.col("blob").alias("file_id"), "lang", "text").dropDuplicates(["file_id"]))
    return scratch.write("facts", files.mapInArrow(run, f"blob {kind}, name string, heads binary, bodies binary, line int, n bigint, lines binary"))


def definitions_at(wanted: DataFrame, versions: DataFrame, facts: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, files, defining): of wanted (key, name, ct, hash), in how many files the name stands at that state, and in how many it is defined.

    A version counts from its commit until the file's next one, so a name's counts are running sums over its versions.
    They are written by commit, without those where one version's end is another's begin.
    """
    names = wanted.select("name").distinct()
    held = facts.select("blob", "name", F.col("heads").isNotNull().cast("int").alias("defining")).join(names, "name", "left_semi")
    after = F.lead(F.struct("ct", "hash")).over(Window.partitionBy("file_id").orderBy("ct", "hash"))
    told = versions.select("file_id", "ct", "hash", "blob", after.alias("next")).join(held, "blob")
    begin = F.struct(F.col("ct").alias("at"), F.col("hash").alias("tie"), F.lit(1).alias("files"), F.col("defining"))
    end = F.struct(F.col("next.ct").alias("at"), F.col("next.hash").alias("tie"), F.lit(-1).alias("files"), (-F.col("defining")).alias("defining"))
    changes = told.select(F.col("name").alias("id"), F.inline(F.filter(F.array(begin, F.when(F.col("next").isNotNull(), end)), lambda x: x.isNotNull())))
    changes = scratch.write("counts", changes.groupBy("id", "at", "tie").agg(F.sum("files").alias("files"), F.sum("defining").alias("defining")).where("files <> 0 or defining <> 0"))
    points = wanted.select("key", F.col("name").alias("id"), F.col("ct").alias("at"), F.col("hash").alias("tie"))
    return timeline.sums_until(points, changes, "files", "defining")


def landings(edits: DataFrame, versions: DataFrame, window: int = WINDOW, *carried: str) -> DataFrame:
    """(key, ct, hash, blob, committed) for each of edits (key, file_id, last_edit): the first commit within the window that touches the file, or else the working tree.

    The named columns of the edits are carried along, so that no join by key brings them back. Both sides are read several times and should be written tables.
    """
    points = edits.select("key", *carried, F.col("file_id").alias("id"), F.col("last_edit").alias("at"), F.lit(None).cast(dict(versions.dtypes)["hash"]).alias("tie"))
    named = points.where("id is not null")
    found = timeline.nearest_within(named, _events(versions), window).select("key", *carried, "id", "found")
    found = found.unionByName(points.where("id is null").select("key", *carried, "id", F.lit(None).cast(dict(found.dtypes)["found"]).alias("found")))
    newest = versions.groupBy("file_id").agg(F.max_by("blob", F.struct("ct", "hash")).alias("newest")).withColumnRenamed("file_id", "id")
    told = found.join(newest, "id", "left")
    committed = F.col("found").isNotNull()
    return told.select("key", *carried, F.when(committed, F.col("found.at")).otherwise(WORKING_TREE[0]).alias("ct"), F.when(committed, F.col("found.tie")).alias("hash"), F.when(committed, F.col("found.value.blob")).otherwise(F.col("newest")).alias("blob"), committed.alias("committed"))


def verify(findings: DataFrame, versions: DataFrame, contents: DataFrame) -> DataFrame:
    """(finding_id, outcome, later_fixed, line, n, checked_at) of findings.

    Findings have finding_id, kind (dangling: the symbol is gone; stale: its head changed), symbol, renamed_to, changed_file, after (the blob
    that the session left; null: not known), ref_file, caller (null: none around the reference), first_edit and last_edit.
    Outcomes: unverified, not_landed, already_resolved and kept. A kept finding tells its first line and number of references at
    the state it was checked at, and whether the referring lines changed in a commit within the window after that. What
    several steps read is written once; the result is a table in the shared folder, and all others are dropped by then.
    Each large join ends in a table, so that the shuffle files of one lie on disk at a time, and blobs travel as 16 bytes.
    """
    scratch = Scratch(findings.sparkSession)
    short = lambda blob: F.unhex(F.md5(blob))
    versions, f = scratch.write("versions", versions.withColumn("blob", short("blob"))), scratch.write("findings", findings.withColumnRenamed("finding_id", "key").withColumn("after", short("after")))
    facts = blob_facts(contents.withColumn("blob", short("blob")), scratch)
    contents = scratch.read("contents").select(F.col("file_id").alias("blob"), "text")
    asked = ("kind", "symbol", "renamed_to", "after", "ref_file", "caller", "first_edit")
    t = scratch.write("states", landings(f.select("key", F.col("changed_file").alias("file_id"), "last_edit", *asked), versions, WINDOW, *asked).withColumnRenamed("blob", "changed_blob"))
    hash_type = dict(versions.dtypes)["hash"]
    none = F.lit(None).cast(hash_type)
    # both states of the referring file, then and before the session, are asked for at once
    points = t.select(F.struct("key", F.lit("ref").alias("state")).alias("key"), F.col("ref_file").alias("file_id"), "ct", "hash").unionByName(t.select(F.struct("key", F.lit("base").alias("state")).alias("key"), F.col("ref_file").alias("file_id"), F.col("first_edit").alias("ct"), none.alias("hash")))
    later = timeline.last_within(t.where("committed").select("key", F.col("ref_file").alias("id"), F.col("ct").alias("at"), F.col("hash").alias("tie")), _events(versions), WINDOW)
    blobs = blobs_at(points, versions, contents, None).select("key.key", "key.state", "blob").unionByName(later.select("key", F.lit("later").alias("state"), F.col("value.blob").alias("blob")))
    blobs = blobs.groupBy("key").agg(*(F.max(F.when(F.col("state") == x, F.col("blob"))).alias(f"{x}_blob") for x in ("ref", "base", "later")))
    t = scratch.write("blobs", t.join(scratch.write("found", blobs), "key", "left").drop("ref_file", "first_edit"))
    scratch.drop("states", "found", "contents", "findings")

    # what contents say of names is asked for in one join, and brought back to the findings in another
    asks = {"then": ("changed_blob", "symbol"), "renamed": ("changed_blob", "renamed_to"), "left": ("after", "symbol"), "ref": ("ref_blob", "symbol"), "base": ("base_blob", "symbol"), "caller_ref": ("ref_blob", "caller"), "caller_base": ("base_blob", "caller"), "later": ("later_blob", "symbol")}
    pair = lambda blob, name: F.unhex(F.md5(F.concat(F.col(blob), F.col(name).cast("binary"))))
    each = t.select("key", F.inline(F.array(*(F.struct(F.lit(k).cast("byte").alias("ask"), pair(b, n).alias("pair")) for k, (b, n) in enumerate(asks.values()))))).where("pair is not null")
    number = {ask: k for k, ask in enumerate(asks)}
    met = large(each).join(large(facts.withColumn("pair", pair("blob", "name")).drop("blob", "name")), "pair").select("key", "ask", "heads", "bodies", "line", "n", "lines")
    of = lambda ask, column, name: F.max(F.when(F.col("ask") == number[ask], F.col(column))).alias(name)
    told = scratch.write("told", met.groupBy("key").agg(
        of("then", "heads", "heads_then"), of("renamed", "heads", "renamed_heads"), of("left", "heads", "heads_left"), of("ref", "line", "line"), of("ref", "n", "n"), of("ref", "lines", "lines_then"), of("base", "n", "n_before"),
        of("caller_ref", "heads", "caller_then"), of("caller_ref", "bodies", "body_then"), of("caller_base", "heads", "caller_before"), of("caller_base", "bodies", "body_before"), of("later", "lines", "lines_later"),
    ))
    standing = scratch.write("standing", definitions_at(t.where("kind = 'dangling'").select("key", F.col("symbol").alias("name"), "ct", "hash"), versions, facts, scratch))
    scratch.drop("facts", "versions", "counts")
    t = t.join(told, "key", "left").join(standing, "key", "left")

    dangling = F.col("kind") == "dangling"
    gone = F.col("changed_blob").isNull()
    landed_dangling = F.when(gone, F.col("renamed_to").isNull()).otherwise(F.col("heads_then").isNull() & (F.col("renamed_to").isNull() | F.col("renamed_heads").isNotNull()))
    landed_stale = ~gone & F.col("heads_then").eqNullSafe(F.col("heads_left"))
    both = F.col("base_blob").isNotNull() & F.col("ref_blob").isNotNull()
    in_caller = ~(F.col("caller_then").eqNullSafe(F.col("caller_before")) & F.col("body_then").eqNullSafe(F.col("body_before")))
    around_none = ~F.col("n").eqNullSafe(F.col("n_before"))
    mended = both & F.when(F.col("caller").isNotNull(), in_caller).otherwise(around_none)
    outcome = (
        F.when(F.col("after").isNull(), "unverified").when(~F.when(dangling, landed_dangling).otherwise(landed_stale), "not_landed").when(F.col("n").isNull(), "already_resolved")
        .when(~dangling & mended, "already_resolved").when(dangling & (F.col("files") > MOST_FILES), "unverified").when(dangling & (F.col("defining") > 0), "already_resolved").otherwise("kept")
    )
    kept = outcome == "kept"
    fixed = F.col("later_blob").isNotNull() & (F.col("lines_then") != F.coalesce("lines_later", F.lit(b"")))
    label = F.when(F.col("committed"), F.col("hash").cast("string")).otherwise(WORKING_TREE[1])
    out = scratch.write("verified", t.select(F.col("key").alias("finding_id"), outcome.alias("outcome"), (kept & F.coalesce(fixed, F.lit(False))).alias("later_fixed"), F.when(kept, F.col("line")).alias("line"), F.when(kept, F.col("n")).alias("n"), F.when(kept, label).alias("checked_at")))
    scratch.keep_only("verified")
    return out


def roll_up(verified: DataFrame, findings: DataFrame) -> DataFrame:
    """One row for each (session, period) of the findings: how many there were, what became of them, and how many were fixed later."""
    told = findings.select("finding_id", "session", "period", "kind").join(verified, "finding_id")
    count = lambda cond, name: F.count_if(cond).alias(name)
    kept = F.col("outcome") == "kept"
    of = lambda kind: kept & (F.col("kind") == kind)
    return told.groupBy("session", "period").agg(
        F.count("*").alias("raw"), *(count(F.col("outcome") == o, o) for o in ("not_landed", "already_resolved", "unverified", "kept")),
        count(of("dangling"), "dangling"), count(of("dangling") & F.col("later_fixed"), "dangling_later_fixed"), count(of("stale"), "stale"), count(of("stale") & F.col("later_fixed"), "stale_later_fixed"),
    )


def report_order(merged: DataFrame, most: int = TOP) -> DataFrame:
    """The first findings of a report: strong evidence first, code before tests, those fixed later first, then by symbol, path and line."""
    return merged.orderBy("confidence", "in_test", ~F.col("later_fixed"), "symbol", "path", "line").limit(most)
