"""Patch texts as arrays of structs, and their application to a text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

HUNKS = "array<struct<old_start:int,lines:array<string>>>"
#: Fixed value: a replacement doesn't make a text longer than this.
MOST_BYTES = 8 << 20


def let(value: Column, made) -> Column:
    """made(value), where value is worked out once however often made uses it, in its lambdas too."""
    return F.element_at(F.transform(F.array(value), made), 1)


def _between(lines: Column, heads: Column, made) -> Column:
    """made(head line, lines until the next head) for each of the places in heads; every line is looked at once."""
    ends = F.slice(F.concat(F.slice(heads, F.lit(2), F.size(heads)), F.array(F.size(lines) + 1)), F.lit(1), F.size(heads))
    return F.zip_with(heads, ends, lambda a, z: made(F.element_at(lines, a), F.slice(lines, a + 1, F.greatest(z - a - 1, F.lit(0)))))


def _places(lines: Column, is_head) -> Column:
    """Places of the lines that is_head holds for; none of an empty array."""
    all_ = F.when(F.size(lines) > 0, F.sequence(F.lit(1), F.size(lines))).otherwise(F.array().cast("array<int>"))
    return F.filter(all_, lambda i: is_head(F.element_at(lines, i)))


def _without_end(lines: Column) -> Column:
    """lines without the empty one that a last line break makes."""
    return F.when((F.size(lines) > 0) & (F.element_at(lines, -1) == ""), F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)


def unified_hunks(diff: Column) -> Column:
    """Hunks (old_start, lines) of a unified diff; an insertion, of no old lines, starts at the line behind it."""

    def hunk(head: Column, rest: Column) -> Column:
        told = F.substring_index(F.substring(head, 5, 1 << 20), " ", 1)
        first = F.coalesce(F.substring_index(told, ",", 1).try_cast("int"), F.lit(0))
        count = F.when(F.contains(told, F.lit(",")), F.regexp_replace(told, "^[^,]*,", "")).otherwise("1")
        return F.struct((first + (count == "0").cast("int")).alias("old_start"), rest.alias("lines"))

    cut = lambda lines: let(_places(lines, lambda x: x.startswith("@@ -")), lambda heads: _between(lines, heads, hunk))
    return let(F.split(diff, "\n"), lambda lines: let(_without_end(lines), cut))


def patch_operations(text: Column) -> Column:
    """What a patch text asks for, in order: (op: add, update, delete or move; path, to, content, hunks).

    An added file's content are its lines behind a plus; an updated one has hunks, whose place is told by their lines alone.
    """
    head = r"^\*\*\* (Add|Update|Delete) File: "

    def operation(first: Column, rest: Column) -> Column:
        kind, path = F.lower(F.regexp_extract(first, head, 1)), F.trim(F.regexp_replace(first, head, ""))
        moves = F.filter(rest, lambda x: x.startswith("*** Move to: "))
        to = F.when((kind == "update") & (F.size(moves) > 0), F.trim(F.substring(F.try_element_at(moves, F.lit(1)), 14, 1 << 20)))
        added = F.transform(F.filter(rest, lambda x: x.startswith("+")), lambda x: F.concat(F.substring(x, 2, 1 << 30), F.lit("\n")))
        op = F.when(to.isNotNull(), "move").otherwise(kind)
        return F.struct(op.alias("op"), path.alias("path"), to.alias("to"), F.when(op == "add", F.array_join(added, "")).alias("content"), F.when(op == "update", hunks(rest)).cast(HUNKS).alias("hunks"))

    def hunks(rest: Column) -> Column:
        marked = lambda told: F.when((F.size(told) > 0) & ~F.try_element_at(told, F.lit(1)).startswith("@@"), F.concat(F.array(F.lit("@@")), told)).otherwise(told)
        one = lambda _, body: F.struct(F.lit(None).cast("int").alias("old_start"), body.alias("lines"))
        cut = lambda lines: let(_places(lines, lambda x: x.startswith("@@")), lambda heads: _between(lines, heads, one))
        return let(F.filter(rest, lambda x: ~x.startswith("*** ")), lambda told: let(marked(told), cut))

    cut = lambda lines: let(_places(lines, lambda x: x.rlike(head)), lambda heads: _between(lines, heads, operation))
    return let(F.split(text, "\r?\n"), lambda lines: let(_without_end(lines), cut))


def _located(lines: list[str], old: list[str], since: int, start: int | None) -> int | None:
    """Where a hunk's old lines stand: at its line number if they do, or else where they come first; a hunk without old lines goes to the end."""
    bare = lambda x: x.rstrip("\r")
    same = lambda at: [bare(x) for x in lines[at : at + len(old)]] == [bare(x) for x in old]
    at = max((start or 0) - 1, 0)
    if start is not None and at >= since and at + len(old) <= len(lines) and same(at):
        return at
    if not old:
        return max(len(lines) - (bool(lines) and lines[-1] == ""), since)
    return next((at for at in range(since, len(lines) - len(old) + 1) if same(at)), None)


def _patched(text: str, hunks) -> str | None:
    lines, out, at = text.split("\n") if text else [], [], 0
    for start, body in hunks:
        if any(x and x[0] not in " -+\\" for x in body):
            return None  # of a form that isn't known
        old = [x[1:] for x in body if not x or x[0] in " -"]
        place = _located(lines, old, at, start)
        if place is None:
            return None
        out += lines[at:place]
        at = place
        for x in body:
            if x[:1] == "+":
                out.append(x[1:])
            elif x[:1] != "\\":
                out += [] if x[:1] == "-" else [lines[at]]
                at += 1
    return "\n".join(out + lines[at:])


@F.pandas_udf(StringType())
def apply_hunks(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """A text after its hunks; null where one doesn't fit."""
    for texts, hunks in batches:
        yield pd.Series([None if t is None or h is None else _patched(t, [(None if pd.isna(x["old_start"]) else int(x["old_start"]), list(x["lines"])) for x in h]) for t, h in zip(texts, hunks, strict=True)])


def apply_replace(text: Column, old: Column, new: Column, everywhere: Column) -> Column:
    """text with old replaced by new, once or everywhere; null where it isn't found or the result gets too long.

    An empty old makes a new file of an empty text. Where old isn't found as it is, line breaks of both are compared as one character.
    """
    lf = lambda x: F.replace(x, F.lit("\r\n"), F.lit("\n"))

    def tried(t: Column, o: Column, n: Column) -> Column:
        at = F.position(o, t)
        times = F.when(everywhere, (F.octet_length(t) - F.octet_length(F.replace(t, o, F.lit("")))) / F.octet_length(o)).otherwise((at > 0).cast("int"))
        grown = F.octet_length(t) + times * (F.octet_length(n).cast("long") - F.octet_length(o))
        once = F.concat(F.substring(t, F.lit(1), at - 1), n, F.substring(t, at + F.length(o), F.length(t)))
        return F.when((at > 0) & (grown <= MOST_BYTES), F.when(everywhere, F.replace(t, o, n)).otherwise(once))

    found = F.coalesce(tried(text, old, new), F.when(F.contains(text, F.lit("\r")), tried(lf(text), lf(old), lf(new))))
    return F.when(old == "", F.when(text == "", new)).otherwise(found)
