"""Source trees: which files are indexed, and the symbols and references on their lines."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions import paths
from codequarry.operators import lookups
from codequarry.sources import ignores

#: The largest file, the bytes searched for a NUL, and when lines are too long on average.
MOST_BYTES, HEAD, LONG_TEXT, LONG_LINES = 1 << 20, 8192, 20_000, 500

_PY = (r"^(\s*)(?:async\s+)?(def|class)\s+([A-Za-z_]\w*)",)
_JS = (r"^(\s*)(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:async\s+)?(function|class|interface|enum)\*?\s+([A-Za-z_$][\w$]*)",)
_RUST = (r"^(\s*)(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*(fn|struct|enum|trait|mod)\s+([A-Za-z_]\w*)",)
_GO = (r"^(\s*)(func)\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)", r"^(\s*)(type)\s+([A-Za-z_]\w*)")
_JVM = (r"^(\s*)(?:(?:public|private|protected|internal|static|final|abstract|sealed|data|open|partial)\s+)*(class|interface|enum|record|object|fun)\s+([A-Za-z_]\w*)",
        r"^(\s+)(?:(?:public|private|protected|internal|static|final|abstract|override|async|virtual)\s+)+()[\w<>\[\],.?]+\s+([A-Za-z_]\w*)\s*\(")
_C = (r"^(\s*)(?:typedef\s+)?(struct|class|enum|union|namespace)\s+([A-Za-z_]\w*)\s*(?:\{|:|$)", r"^()()(?:[A-Za-z_][\w:<>*&]*\s+)+\*?&?([A-Za-z_]\w*)\s*\([^;]*$")
DEFINITIONS = {"python": _PY, "typescript": _JS, "tsx": _JS, "javascript": _JS, "rust": _RUST, "go": _GO, "java": _JVM, "csharp": _JVM, "kotlin": _JVM, "c": _C, "cpp": _C}
KINDS = {"def": "function", "fn": "function", "func": "function", "fun": "function", "": "method"}
#: Words before a bracket that call nothing.
NOT_CALLED = ("if", "for", "while", "switch", "match", "return", "catch", "function", "fn", "func", "fun", "def", "class", "sizeof", "new", "and", "or", "not", "in", "elif", "with", "await", "assert")


def is_unindexable(text: Column) -> Column:
    """A NUL in the first HEAD characters, or a long text whose lines have more than LONG_LINES on average."""
    newlines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (F.instr(F.substring(text, 1, HEAD), "\0") > 0) | ((F.octet_length(text) > LONG_TEXT) & (F.floor(F.octet_length(text) / (newlines + 1)) > LONG_LINES))


def scan(spark: SparkSession, root: str, ignore_files: DataFrame | None = None) -> DataFrame:
    """(path, lang, size, mtime, hash, text) of the files under root that are indexed; hidden and skipped folders are not.

    Ignore files (folder, text), in the order of their lines, shut out what they tell. Spark's readers pass over hidden files,
    so their texts are given.
    """
    root = root.rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    relative = F.regexp_replace("path", rf"^(?:[a-z]+:/+)?/*\Q{root.lstrip('/')}\E/", "")
    kept = found.where(F.col("length") <= MOST_BYTES).select(relative.alias("path"), F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("mtime"), "content")
    told = kept.withColumn("lang", paths.language(F.col("path"))).where(F.col("lang").isNotNull() & ~paths.outside_index(F.col("path")))
    told = told.withColumn("text", F.decode("content", "UTF-8")).where(~is_unindexable(F.col("text")))
    if ignore_files is not None:
        told = told.join(ignores.ignored(told.select("path"), ignores.rules(ignore_files)), "path", "left_anti")
    return told.select("path", "lang", "size", "mtime", F.sha2("content", 256).alias("hash"), "text")


def _lines(files: DataFrame) -> DataFrame:
    return files.select("file_id", "lang", F.posexplode(F.split("text", "\r?\n")).alias("pos", "line")).withColumn("line_no", F.col("pos") + 1)


#: Java's white space, what ends a line there, and the patterns as Python reads them.
_SPACE, _END = " \t\n\x0b\f\r", r"(?=(?:\r\n|[\n\r\x85\u2028\u2029])?\Z)"
_COMPILED = {lang: [re.compile(p.replace("$", _END) if lang in ("c", "cpp") else p, re.A) for p in patterns] for lang, patterns in DEFINITIONS.items()}
_CLOSES, _CALL, _BREAK = re.compile(r"^[)\]}]+[;,]?" + _END), re.compile(r"([A-Za-z_]\w*)\s*\(", re.A), re.compile(r"\r?\n")


def line_definitions(lang: str | None, lines: list[str]) -> list[tuple[str, str, int, int]]:
    """(name, kind, start_line, end_line) of what the lines of one file define, in one pass: what is open stands on a stack by its depth."""
    found, opened, last = [], [], 0
    for no, line in enumerate(lines, 1):
        bare = line.strip(" ")
        if not bare:
            continue
        depth, last = len(line) - len(line.lstrip(_SPACE)), no
        while opened and found[opened[-1]][4] >= depth:
            held = found[opened.pop()]
            held[3] = no if held[4] == depth and _CLOSES.match(bare) else no - 1
        for p in _COMPILED.get(lang, ()):
            m = p.match(line)
            if m:
                opened.append(len(found))
                found.append([m[3], KINDS.get(m[2], m[2]), no, None, depth])
                break
    inside = 0
    for held in found:
        held[3] = last if held[3] is None else held[3]
        if held[1] == "function" and held[4] > 0 and inside >= held[2]:
            held[1] = "method"
        inside = max(inside, held[3])
    return [tuple(held[:4]) for held in found]


def line_calls(lines: list[str]) -> Iterator[tuple[int, str]]:
    """(line, name) of the names called on each line, each once a line."""
    for no, line in enumerate(lines, 1):
        for name in dict.fromkeys(_CALL.findall(line)):
            if name not in NOT_CALLED:
                yield no, name


def texts_of(batch: pa.RecordBatch) -> Iterator[tuple[object, str | None, list[str]]]:
    """(file_id, lang, lines) of each row with a text; bytes that aren't UTF-8 are replaced, as Java does."""
    for file_id, lang, text in zip(batch.column("file_id").to_pylist(), batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
        if text.is_valid:
            yield file_id, lang, _BREAK.split(text.as_py().decode("utf-8", "replace"))


def definitions(files: DataFrame) -> DataFrame:
    """(file_id, name, kind, start_line, end_line) of files (file_id, lang, text): what a line defines by its language's patterns.

    A definition lasts until the next line that isn't blank and isn't indented further, or the file's end. This reads lines,
    not grammars: definitions that span lines before their name, or share a line, are missed. Each text is read where it lies.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(file_id, *d) for file_id, lang, lines in texts_of(batch) for d in line_definitions(lang, lines)]
            ids, *told = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.record_batch([pa.array(ids, batch.schema.field("file_id").type), *(pa.array(c, t) for c, t in zip(told, (pa.string(), pa.string(), pa.int32(), pa.int32()), strict=True))], ["file_id", "name", "kind", "start_line", "end_line"])

    held = files.where("file_id is not null").select("file_id", "lang", "text")
    return held.mapInArrow(run, f"file_id {held.dtypes[0][1]}, name string, kind string, start_line int, end_line int")


def references(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file_id, line, name, enclosing): names called on the files' lines, with the innermost definition around them."""
    calls = _lines(files).select("file_id", F.col("line_no").alias("line"), F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(r"([A-Za-z_]\w*)\s*\("), F.lit(1)))).alias("name")).where(~F.col("name").isin(*NOT_CALLED))
    own = symbols.select("file_id", F.col("start_line").alias("line"), "name")
    calls = calls.join(own, ["file_id", "line", "name"], "left_anti")
    numbered = symbols.select("file_id", "start_line", "end_line", F.struct("start_line", "name").alias("symbol_id"))
    around = lookups.enclosing(calls.select("file_id", "line").distinct(), numbered)
    return calls.join(around, ["file_id", "line"], "left").select("file_id", "line", "name", F.col("symbol_id.name").alias("enclosing"))
