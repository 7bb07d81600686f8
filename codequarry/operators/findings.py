"""References that a change left behind, kept where something ties the referring file to the changed definition.

Evidence comes from an inverted index of what files say: the identifiers that any change asks for, and the names that import
statements bring in. A candidate, a change and a file that refers to its name, asks for the change's words in that file alone, so
no pattern is tried on every text, and a word that many changes ask for and many files say pairs nobody.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.functions import paths, signatures, text
from codequarry.shared import written

#: How often a name is defined at most, as else nothing tells whom it means, and findings told.
MOST_DEFS, MOST_FINDINGS = 5, 20
#: Kinds that no reference names, languages whose `private` hides a name, and those that link by headers.
UNCALLED, HIDING, BY_HEADER = ("module", "impl"), ("java", "kotlin", "csharp", "typescript", "tsx"), ("c", "cpp")
QUALIFYING = ("python", "typescript", "tsx", "javascript")
#: Last words of marks by which a framework calls a definition.
ROUTES = ("get", "post", "put", "patch", "delete", "head", "options", "route", "path", "websocket", "scheduled", "exceptionhandler", "command")
_MARK = r"(?:#\[|@|\[)([\w.:]+)"
_LOCAL = r"""['"](?:\.|@/|~/|#)"""
#: What import statements bring in, by language: the clause whose words are names.
IMPORTS = {
    "rust": (r"\buse\s([^;]*)", r"\b(?:crate|super|self)::((?:\w+::)*\w+)"), "python": (r"(?m)^[ \t]*from[ \t]+\S+[ \t]+import[ \t]+(\([^)]*|[^\n]*)",),
    "typescript": (r"\bimport\b([^;'\"]*)\bfrom\s*" + _LOCAL, r"([^;\n]*)=\s*require\(\s*" + _LOCAL), "java": (r"(?m)^[ \t]*import[ \t]+static[ \t]+[\w.]+\.(\w+)[ \t]*;",), "kotlin": (r"(?m)^[ \t]*import[ \t]+[\w]+\.([\w.]+)",),
}
IMPORTS |= {"tsx": IMPORTS["typescript"], "javascript": IMPORTS["typescript"]}


def called_by_framework(signature: Column) -> Column:
    """Whether a mark in front of a definition tells that a framework calls it, by a path or an event."""

    def calls(mark: Column) -> Column:
        last = F.lower(F.regexp_replace(mark, r"^.*[.:]", ""))
        return F.regexp_replace(last, "^http(?=.)", "").isin(*ROUTES[:7]) | last.isin(*ROUTES) | last.endswith("mapping") | last.endswith("listener")

    return F.exists(F.regexp_extract_all(signature, F.lit(_MARK), F.lit(1)), calls)


def hidden(lang: Column, name: Column, signature: Column) -> Column:
    """Whether a definition can't be seen from other files."""
    before = F.element_at(F.split(signature, F.concat(F.lit(r"\b\Q"), name, F.lit(r"\E\b")), 2), 1)
    return lang.isin(*HIDING) & F.regexp_replace(before, r"\([^)]*\)", "").rlike(r"\bprivate\b")


def imported(texts: DataFrame) -> DataFrame:
    """(file_id, word): the names that a file's import statements bring in."""
    clause = F.array().cast("array<string>")
    for lang, patterns in IMPORTS.items():
        clause = F.when(F.col("lang") == lang, F.concat(*(F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in patterns))).otherwise(clause)
    words = F.flatten(F.transform(clause, lambda c: F.regexp_extract_all(c, F.lit(r"\w+"), F.lit(0))))
    return texts.select("file_id", F.explode(F.array_distinct(words)).alias("word"))


def mentioned(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(file_id, word) of the wanted words, identifiers or two of them joined by a dot, that stand in a file's text."""
    single, double = F.regexp_extract_all("text", F.lit(r"[\w$]+"), F.lit(0)), F.regexp_extract_all("text", F.lit(r"(?<![\w$])(?=([\w$]+\.[\w$]+))"), F.lit(1))
    return texts.select("file_id", F.explode(F.array_distinct(F.concat(single, double))).alias("word")).join(wanted.select("word").distinct(), "word", "left_semi")


def package(text_: Column) -> Column:
    return F.nullif(F.regexp_extract(text_, r"(?m)^[ \t]*package[ \t]+([\w.]+)", 1), F.lit(""))


def linked(candidates: DataFrame, changes: DataFrame, containers: DataFrame, files: DataFrame, texts: DataFrame) -> DataFrame:
    """The candidates (change_id, ref_file) that something ties together.

    A type's name is evidence by itself, C's files are tied by headers, and what can't be read stays. Else the file names the changed
    file's module, a type around the definition, the definition behind one of its folders, or imports it; or both are of one package.
    """
    told = files.select("file_id", "path", "lang")
    of = changes.join(told, "file_id").select("change_id", "name", "kind", "path", "lang", "file_id")
    folders = F.filter(F.split("path", "/"), lambda s: s != "")
    words = of.select("change_id", paths.module_name(F.col("path")).alias("word")).unionByName(changes.join(containers, ["file_id", "name"]).select("change_id", F.col("container").alias("word")))
    behind = of.where(F.col("lang").isin(*QUALIFYING)).select("change_id", F.explode(F.transform(F.slice(folders, 1, F.greatest(F.size(folders) - 1, F.lit(0))), lambda d: F.concat(d, F.lit("."), F.col("name")))).alias("word"))
    packages = texts.select("file_id", package(F.col("text")).alias("package"))
    in_package = of.where("lang = 'go'").join(packages, "file_id").select("change_id", F.col("package").alias("word"))
    words = words.unionByName(behind).unionByName(in_package).where("word <> ''").distinct()

    told_texts = texts.join(files.select("file_id", "lang"), "file_id").join(candidates.select(F.col("ref_file").alias("file_id")).distinct(), "file_id", "left_semi").where("text is not null")
    by_word = lambda asked, held: candidates.join(asked, "change_id").join(held.withColumnRenamed("file_id", "ref_file"), ["ref_file", "word"], "left_semi").select("change_id", "ref_file")
    said, brought = by_word(words, mentioned(told_texts, words)), by_word(changes.select("change_id", F.col("name").alias("word")), imported(told_texts))

    t = candidates.join(of.select("change_id", "kind", "lang", "path", F.col("file_id").alias("changed")), "change_id")
    t = t.join(told.select(F.col("file_id").alias("ref_file"), F.col("path").alias("ref_path")), "ref_file")
    t = t.join(packages.select(F.col("file_id").alias("changed"), F.col("package").alias("own"), F.lit(True).alias("held")), "changed", "left").join(texts.select(F.col("file_id").alias("ref_file"), package(F.col("text")).alias("theirs"), F.col("text").isNotNull().alias("read")), "ref_file", "left")
    folder = lambda p: F.regexp_replace(p, "/?[^/]*$", "")
    same = ((F.col("lang") == "go") & (folder(F.col("path")) == folder(F.col("ref_path")))) | ((F.col("lang") == "kotlin") & F.col("held") & F.col("own").eqNullSafe(F.col("theirs")))
    free = ~F.col("kind").isin(*signatures.CALLABLE) | F.col("lang").isin(*BY_HEADER) | ~F.coalesce("read", F.lit(False)) | F.coalesce(same, F.lit(False))
    return t.where(free).select("change_id", "ref_file").unionByName(said).unionByName(brought).distinct()


def collect(changes: DataFrame, symbols: DataFrame, refs: DataFrame, files: DataFrame, texts: DataFrame, after_defs: DataFrame, containers: DataFrame, touched: DataFrame, read: DataFrame, reads_known: bool = True) -> DataFrame:
    """(kind, confidence, symbol, renamed_to, changed_file, path, line, caller, refs_in_file, in_test) of all findings, a file each change.

    Changes have change_id (in their order), change (removed or signature), name, kind, signature, file_id and renamed_to. A change is
    passed over if its name is generic, hidden from other files, called by a framework, told before, or defined more than MOST_DEFS
    times; a removed one also if a definition is left: at the end state of the touched files (after_defs), or in another file.
    All of a name's references of its language family count, outside touched files and files that define the name themselves,
    however many there are; for a changed signature only calls count, in files that weren't read, if reads are known.
    """
    family = files.select("file_id", "path", "lang", paths.family(F.col("lang")).alias("family"))
    removed = F.col("change") == "removed"
    c = changes.where(F.col("change").isin("removed", "signature") & ~(removed & F.col("kind").isin(*UNCALLED))).join(family, "file_id")
    c = c.where(~text.is_generic_name(F.col("name")) & ~hidden(F.col("lang"), F.col("name"), F.col("signature")) & ~called_by_framework(F.col("signature")))
    c = c.withColumn("nth", F.row_number().over(Window.partitionBy("change", "family", "name").orderBy("change_id"))).where("nth = 1")
    names = c.select("name").distinct()
    defs = symbols.select("name", "file_id").join(names, "name", "left_semi")
    many = defs.groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") > MOST_DEFS).select("name")
    c = c.join(many, "name", "left_anti")
    touched = touched.select("file_id").unionByName(changes.select("file_id")).distinct()
    known = after_defs.select("file_id").unionByName(changes.select("file_id")).distinct()
    ended = touched.join(known, "file_id", "left_semi")
    left = after_defs.select("file_id", "name").unionByName(defs.join(ended, "file_id", "left_anti").select("file_id", "name"))
    left = left.join(family, "file_id").select("name", "family").distinct()
    c = written(c.where(~removed).unionByName(c.where(removed).join(left, ["name", "family"], "left_anti").select(c.columns)), "kept")
    names = c.select("name").distinct()

    used = refs.join(names, "name", "left_semi").join(family.select("file_id", "path", F.col("family").alias("ref_family")), "file_id")
    used = used.select("name", F.col("file_id").alias("ref_file"), F.col("path").alias("ref_path"), "ref_family", "line", F.col("kind").alias("ref_kind"), "enclosing")
    used = used.join(touched.select(F.col("file_id").alias("ref_file")), "ref_file", "left_anti").join(defs.select("name", F.col("file_id").alias("ref_file")).distinct(), ["name", "ref_file"], "left_anti")
    if reads_known:
        used = used.join(read.select(F.col("file_id").alias("ref_file"), F.lit(True).alias("seen")).distinct(), "ref_file", "left")
    else:
        used = used.withColumn("seen", F.lit(False))
    met = c.join(used, "name").where((F.col("family") == F.col("ref_family")) & (removed | (F.col("ref_kind").isin("call", "class") & ~F.coalesce("seen", F.lit(False)))))
    met = written(met, "met")
    tied = linked(met.select("change_id", "ref_file").distinct(), c.select("change_id", "name", "kind", "file_id"), containers, files, texts)
    first = F.min(F.struct("line", "enclosing"))
    found = met.join(tied, ["change_id", "ref_file"]).groupBy("change_id", "change", "name", "renamed_to", "path", "ref_path").agg(first.alias("first"), F.count("*").alias("refs_in_file"))
    told = found.select(
        F.when(removed, "dangling").otherwise("stale").alias("kind"), F.when(removed, 0).otherwise(1).alias("confidence"), F.col("name").alias("symbol"), "renamed_to", F.col("path").alias("changed_file"),
        F.col("ref_path").alias("path"), "first.line", F.col("first.enclosing").alias("caller"), "refs_in_file", paths.is_test_path(F.col("ref_path")).alias("in_test"),
    )
    return told


def in_order(found: DataFrame, most: int = MOST_FINDINGS) -> DataFrame:
    """The first findings: strong evidence first, code before tests, then by symbol, path and line."""
    return found.orderBy("confidence", "in_test", "symbol", "path", "line").limit(most)
