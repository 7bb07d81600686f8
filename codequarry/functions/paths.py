"""Column functions over paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folders that only hold modules, extensions by language, and families of languages that call each other.
CONTAINERS = ("src", "app", "apps", "packages", "crates", "lib", "libs", "modules", "services", "internal", "pkg")
EXTENSIONS = {
    "rust": ("rs",), "python": ("py", "pyi"), "typescript": ("ts", "mts", "cts"), "tsx": ("tsx",), "javascript": ("js", "mjs", "cjs", "jsx"), "java": ("java",),
    "go": ("go",), "csharp": ("cs",), "kotlin": ("kt", "kts"), "c": ("c",), "cpp": ("h", "cpp", "cc", "cxx", "hpp", "hh", "hxx", "ipp"),
}
FAMILIES = {"js": ("typescript", "tsx", "javascript"), "c": ("c", "cpp")}
SKIPPED_DIRS = ("node_modules", "target", "dist", "build", "out", "vendor", "__pycache__", "venv", "coverage", "bin", "obj")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """What follows the last dot of a path's last part; empty without one."""
    return F.regexp_extract(path, r"\.([^./]*)$", 1)


def dir_at(path: Column, depth: int | Column) -> Column:
    """The first `depth` folders of a path; an empty string for a file at the root."""
    parts = F.split(path, "/")
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.array_join(F.slice(parts, F.lit(1), F.least(depth, F.size(parts) - 1)), "/")


def group_of(path: Column) -> Column:
    """A file's module: its first folder, two of them where the first only holds modules."""
    parts = F.split(path, "/")
    first = F.element_at(parts, 1)
    return F.when(F.size(parts) <= 1, "(root)").when((F.size(parts) > 2) & first.isin(*CONTAINERS), F.concat_ws("/", first, F.element_at(parts, 2))).otherwise(first)


def is_test_path(path: Column) -> Column:
    p = F.lower(path)
    within = p.rlike(r"/tests?/|__tests__|^tests?/|\.test\.|\.spec\.|_test\.|\.tests/|(?:^|/)test_[^/]*$")
    stem = F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)
    return within | ((F.octet_length(stem) > 4) & stem.rlike("Tests?$"))


def language(path: Column) -> Column:
    """The language by extension, whatever its case; null for others."""
    ext = F.lower(F.regexp_extract(path, r"[^/]\.([A-Za-z0-9]+)$", 1))
    out = F.lit(None).cast("string")
    for lang, exts in EXTENSIONS.items():
        out = F.when(ext.isin(*exts), lang).otherwise(out)
    return out


def family(lang: Column) -> Column:
    out = lang
    for name, langs in FAMILIES.items():
        out = F.when(lang.isin(*langs), name).otherwise(out)
    return out


def module_name(path: Column) -> Column:
    """A file's name without extension; that of its folder for index, mod and __init__."""
    stem = F.regexp_replace(F.regexp_replace(basename(path), r"\.[^.]*$", ""), r"\.d$", "")
    parts = F.split(path, "/")
    return F.when(stem.isin("index", "mod", "__init__") & (F.size(parts) > 1), F.element_at(parts, -2)).otherwise(stem)


def outside_index(path: Column) -> Column:
    """Whether any segment is hidden or a folder that is never indexed."""
    return F.exists(F.split(path, "/"), lambda s: s.startswith(".") | s.isin(*SKIPPED_DIRS))


def inside_dir(path: Column, folder: str) -> Column:
    return path.startswith(folder + "/") if folder else ~path.contains("/")


def clean_path(path: Column) -> Column:
    """Slashes for backslashes, without . and with .. folded into the folder before it."""
    parts = F.split(F.regexp_replace(path, r"\\+", "/"), "/")
    rooted = F.element_at(parts, 1) == ""

    def step(acc: Column, s: Column) -> Column:
        up = (s == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("..")) != "..")
        return F.when((s == "") | (s == "."), acc).when(up, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when((s == "..") & rooted, acc).otherwise(F.array_append(acc, s))

    kept = F.aggregate(parts, F.expr("cast(array() as array<string>)"), step)
    return F.concat(F.when(rooted, "/").otherwise(""), F.array_join(kept, "/"))
