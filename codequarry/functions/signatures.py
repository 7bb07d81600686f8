"""What a caller sees of a definition: its head, its parameters with their defaults, and what follows them.

A definition's text is cut to tokens once, in Arrow batches, where scans over the tokens follow strings, brackets and generics
(`scans`); comments, white space, heads and the comparison of two calls are column functions.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.functions import scans
from codequarry.functions.patches import let

_DOUBLE, _BACK, _SINGLE = r'"(?:\\(?s:.)|[^"\\\n])*(?:"|(?=\n)|\z)', r"`(?:\\(?s:.)|[^`\\])*(?:`|\z)", r"'(?:\\(?s:.)|[^'\\\n])*(?:'|(?=\n)|\z)"
#: A quote begins no string in Rust, where it marks lifetimes.
STRINGS, RUST_STRINGS = "|".join((_DOUBLE, _BACK, _SINGLE)), "|".join((_DOUBLE, _BACK))
_TOKENS = r"->|=>|==|!=|<=|>=|::|\.\.\.|#\[|\w+|\s+|(?s:.)"
_PATTERNS = [re.compile(f"{strings}|{_TOKENS}".replace(r"\z", r"\Z"), re.A) for strings in (STRINGS, RUST_STRINGS)]
#: Words that don't matter to a caller.
VISIBILITY = r"\bpub\b(?:\s*\([^)]*\))?|\b(?:public|private|protected|internal|export|default|override|final|abstract|virtual|sealed|open|synchronized|inline|declare|native)\b"
#: Java's types that pass for each other.
UNBOXED = {"Integer": "int", "Long": "long", "Double": "double", "Float": "float", "Boolean": "boolean", "Short": "short", "Byte": "byte", "Character": "char"}
CALLABLE = ("function", "method")
PARAMS = "array<struct<shape:string,default:string>>"


def strip_comments(text: Column, lang: Column) -> Column:
    """text without comments; a block leaves a blank, and strings stay as they are."""
    blocks, lines = r"/\*(?s:.*?)(?:\*/|\z)", r"//[^\n]*"
    of = lambda strings: F.regexp_replace(F.regexp_replace(text, f"({strings}|{blocks})|{lines}", "$1"), f"({strings})|{blocks}", "$1 ")
    return F.when(lang == "python", F.regexp_replace(text, f"({STRINGS})|#[^\\n]*", "$1")).when(lang == "rust", of(RUST_STRINGS)).otherwise(of(STRINGS))


def squeeze(text: Column) -> Column:
    """text without white space but for one blank between two words."""
    one = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.regexp_replace(one, r"(?<!\w) | (?!\w)", "")


def tokens(text: Column, lang: Column) -> Column:
    all_ = lambda strings: F.regexp_extract_all(text, F.lit(f"{strings}|{_TOKENS}"), F.lit(0))
    return F.when(lang == "rust", all_(RUST_STRINGS)).otherwise(all_(STRINGS))


def _opens(t: Column) -> Column:
    return t.isin("(", "[", "{", "#[")


def _closes(t: Column) -> Column:
    return t.isin(")", "]", "}")


def _when(cond: Column, n: int = 1) -> Column:
    return F.when(cond, n).otherwise(0)


def placed(toks: Column) -> Column:
    """(t, d, a) of each token: how many brackets and how many angles are around it; a bracket or angle is outside itself."""
    zero = F.struct(F.array().cast("array<struct<t:string,d:int,a:int>>").alias("out"), F.lit(0).alias("d"), F.lit(0).alias("a"))

    def step(acc: Column, t: Column) -> Column:
        d = acc["d"] + _when(_opens(t)) - _when(_closes(t))
        a = acc["a"] + _when((t == "<") & (acc["d"] == 0)) - _when((t == ">") & (acc["d"] == 0) & (acc["a"] > 0))
        one = F.struct(t.alias("t"), F.least(acc["d"], d).alias("d"), F.least(acc["a"], a).alias("a"))
        return F.struct(F.array_append(acc["out"], one).alias("out"), d.alias("d"), a.alias("a"))

    return F.aggregate(toks, zero, step, lambda acc: acc["out"])


def _where(toks: Column, holds: Callable[[Column], Column]) -> Column:
    """Places of the tokens that holds for."""
    return F.filter(F.when(F.size(toks) > 0, F.sequence(F.lit(1), F.size(toks))).otherwise(F.array().cast("array<int>")), lambda i: holds(F.element_at(toks, i)))


def _text(toks: Column, first: Column, until: Column) -> Column:
    """The tokens from place first up to, without, place until, as text."""
    return F.array_join(F.transform(F.slice(toks, first, F.greatest(until - first, F.lit(0))), lambda x: x["t"]), "")


def split_top(toks: Column, sep: str) -> Column:
    """The texts of placed tokens between the separators outside all brackets; blank ones are dropped."""

    def cut(cuts: Column) -> Column:
        starts, ends = F.concat(F.array(F.lit(1)), F.transform(cuts, lambda c: c + 1)), F.concat(cuts, F.array(F.size(toks) + 1))
        return F.filter(F.zip_with(starts, ends, lambda a, z: _text(toks, a, z)), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")) != "")

    return let(_where(toks, lambda x: (x["t"] == sep) & (x["d"] == 0) & (x["a"] == 0)), cut)


def _go_params(parts: Column) -> Column:
    """Go's parameters all have names or none has; `a, b int` gives a the type behind it."""
    typed = lambda p: F.when(F.trim(p).rlike(r"\s"), squeeze(F.regexp_replace(F.trim(p), r"^\S+\s+", "")))
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("last"))

    def step(acc: Column, p: Column) -> Column:
        t = F.coalesce(typed(p), acc["last"])
        return F.struct(F.array_prepend(acc["out"], t).alias("out"), t.alias("last"))

    shapes = F.when(F.exists(parts, lambda p: typed(p).isNotNull()), F.aggregate(F.reverse(parts), zero, step, lambda acc: acc["out"])).otherwise(F.transform(parts, squeeze))
    return F.transform(shapes, lambda s: F.struct(s.alias("shape"), F.lit(None).cast("string").alias("default")))


def with_shapes(symbols: DataFrame) -> DataFrame:
    """symbols (lang, kind, name, text, ...) with call (head, params, ret; null without a parameter list), body, body_len and header.

    The body is without white space, comments and its own name, the header without its name; a Python class's bases are no parameters.
    """
    lang, name = F.col("lang"), F.col("name")
    t = symbols.withColumn("_found", _scanned(strip_comments(F.col("text"), lang), lang, F.col("kind"), name))
    found = lambda c: F.col(f"_found.{c}")
    body = F.replace(F.regexp_replace(found("rest"), r"\s+", ""), name, F.lit("\0"))
    before = F.when(lang == "go", F.regexp_replace(found("before"), r"\(\s*\w+\s+([^)]*?)\s*\)", "($1)")).otherwise(found("before"))
    head = squeeze(F.regexp_replace(F.concat(before, F.lit(" "), found("after")), VISIBILITY, " "))
    ret = squeeze(found("ret"))
    ret = F.when(lang.isin("cpp", "csharp") & ret.startswith(":"), "").otherwise(ret)
    params = F.when(lang == "go", _go_params(F.transform(found("params"), lambda p: p["shape"]))).otherwise(found("params"))
    call = F.when(found("params").isNotNull(), F.struct(head.alias("head"), params.cast(PARAMS).alias("params"), ret.alias("ret")))
    t = t.withColumns({"body": body, "header": F.replace(squeeze(found("head")), name, F.lit("")), "call": call})
    return t.withColumn("body_len", F.octet_length("body")).drop("_found")


@F.arrow_udf(scans.FOUND)
def _scanned(texts: pa.Array, langs: pa.Array, kinds: pa.Array, names: pa.Array) -> pa.Array:
    rows = zip(*(x.to_pylist() for x in (texts, langs, kinds, names)), strict=True)
    return pa.array([scans.scanned(*row, _PATTERNS[row[1] == "rust"], CALLABLE) for row in rows], scans.ARROW)


def _unboxed(word: Column) -> Column:
    names = F.create_map(*(F.lit(x) for kv in UNBOXED.items() for x in kv))
    return F.coalesce(F.try_element_at(names, word), word)


def widened(lang: Column, old: Column, new: Column) -> Column:
    """Whether what fitted the shape old fits new as it is: Java's boxes, Kotlin's and TypeScript's optional values, and wider unions."""
    mark = lambda s: F.substring_index(s, ":", 1)
    kind = lambda s: F.regexp_replace(s, "^[^:]*:", "")
    members = lambda s: let(placed(tokens(kind(s), lang)), lambda p: split_top(p, "|"))
    marked = (mark(old) == mark(new)) | (~F.contains(mark(old), F.lit("?")) & (mark(new) == F.concat(mark(old), F.lit("?"))))
    typescript = F.contains(old, F.lit(":")) & F.contains(new, F.lit(":")) & marked & (F.size(F.array_except(members(old), members(new))) == 0)
    return F.when(lang == "java", _unboxed(old) == _unboxed(new)).when(lang == "kotlin", new == F.concat(old, F.lit("?"))).when(lang.isin("typescript", "tsx"), typescript).otherwise(False)


def _fits(lang: Column, old: Column, new: Column) -> Column:
    """Whether a call that fitted the parameter old fits new."""
    return ((old["shape"] == new["shape"]) | widened(lang, old["shape"], new["shape"])) & (old["default"].isNull() | old["default"].eqNullSafe(new["default"]))


def _optional(p: Column) -> Column:
    return p["default"].isNotNull() | p["shape"].startswith("?") | p["shape"].startswith("*") | F.contains(p["shape"], F.lit("..."))


def params_fit(lang: Column, old: Column, new: Column) -> Column:
    """Whether arguments for the parameters old fit new: optional ones behind them, new defaults and wider types do no harm.

    Kotlin's defaults may also come in between, if all that follows has a default.
    """
    appended = (F.size(new) >= F.size(old)) & F.forall(F.zip_with(old, F.slice(new, F.lit(1), F.size(old)), lambda o, n: F.coalesce(_fits(lang, o, n), F.lit(False))), lambda x: x) & F.forall(F.slice(new, F.size(old) + 1, F.size(new)), _optional)
    zero = F.struct(F.lit(1).alias("i"), F.lit(False).alias("between"), F.lit(True).alias("ok"))

    def step(acc: Column, n: Column) -> Column:
        o = F.try_element_at(old, acc["i"])
        taken = o.isNotNull() & F.coalesce(_fits(lang, o, n), F.lit(False)) & (~acc["between"] | n["default"].isNotNull())
        return F.struct((acc["i"] + _when(taken)).alias("i"), (acc["between"] | (~taken & n["default"].isNotNull())).alias("between"), (acc["ok"] & (taken | n["default"].isNotNull())).alias("ok"))

    between = F.aggregate(new, zero, step, lambda acc: acc["ok"] & (acc["i"] > F.size(old)))
    return appended | ((lang == "kotlin") & between)


def compatible(lang: Column, old: Column, new: Column) -> Column:
    """Whether calls of the shape old work with new as they are."""
    words = lambda s: F.transform(F.split(s, " "), _unboxed)
    head = (old["head"] == new["head"]) | ((lang == "java") & (words(old["head"]) == words(new["head"])))
    ret = (old["ret"] == new["ret"]) | ((lang == "python") & (old["ret"] == ""))
    return head & ret & params_fit(lang, old["params"], new["params"])


def overload_fits(lang: Column, old: Column, new: Column) -> Column:
    """Whether a definition that is left takes the calls of one that is gone; only arguments count, in Go the receiver too."""
    return params_fit(lang, old["params"], new["params"]) & ((lang != "go") | (old["head"] == new["head"]))
