"""Code-graph composites: overviews, neighbourhoods, impact and search by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codequarry.functions import paths, text
from codequarry.operators import lookups
from codequarry.shared import Scratch

#: Bounds of an impact's hops, and of the folder depth.
FIRST_HOP, SECOND_HOP, SECOND_TOTAL, COCHANGED, REFERENCES = 60, 20, 60, 8, 200
LEAST_DIRS, MOST_DIRS, DEPTHS = 14, 90, 8


def degrees(edges: DataFrame, pairs: DataFrame, summaries: DataFrame) -> DataFrame:
    """(file_id, score): references and shared changes at either end, and the file's symbols."""
    ends = edges.select(F.col("src").alias("file_id"), "n").unionByName(edges.select(F.col("dst").alias("file_id"), "n"))
    ends = ends.unionByName(pairs.select(F.col("file_a").alias("file_id"), F.col("cnt").alias("n"))).unionByName(pairs.select(F.col("file_b").alias("file_id"), F.col("cnt").alias("n")))
    ends = ends.unionByName(summaries.select("file_id", F.col("n_symbols").alias("n")))
    return ends.groupBy("file_id").agg(F.sum("n").alias("score"))


def overview(files: DataFrame, scores: DataFrame, edges: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The `most` files of the highest score, and the edges among them."""
    kept = scores.join(files.select("file_id", "path"), "file_id").orderBy(F.desc("score"), "path").limit(most)
    ids = kept.select("file_id")
    inner = edges.join(ids.withColumnRenamed("file_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("file_id", "dst"), "dst", "left_semi")
    return kept, inner


def folder_counts(files: DataFrame) -> DataFrame:
    """(depth, dirs): distinct folders at each depth."""
    at = files.select(F.explode(F.sequence(F.lit(1), F.lit(DEPTHS))).alias("depth"), "path").select("depth", paths.dir_at(F.col("path"), F.col("depth")).alias("dir"))
    return at.groupBy("depth").agg(F.countDistinct("dir").alias("dirs"))


def folder_edges(files: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(src_dir, dst_dir, n): edges between folders at a depth, without those inside one."""
    at = files.select("file_id", paths.dir_at(F.col("path"), depth).alias("dir"))
    a, b = at.select(F.col("file_id").alias("src"), F.col("dir").alias("src_dir")), at.select(F.col("file_id").alias("dst"), F.col("dir").alias("dst_dir"))
    return edges.join(a, "src").join(b, "dst").where("src_dir <> dst_dir").groupBy("src_dir", "dst_dir").agg(F.sum("n").alias("n"))


def node_stats(symbols: DataFrame, files: DataFrame, calls: DataFrame) -> DataFrame:
    """(symbol_id, callers, test_callers, ambiguous, common): callers by whether they stand in tests; null for common names."""
    tests = symbols.join(files.select("file_id", paths.is_test_path(F.col("path")).alias("test")), "file_id").select(F.col("symbol_id").alias("caller_id"), "test")
    told = calls.join(tests, "caller_id").groupBy("symbol_id").agg(F.count_if(~F.col("test")).alias("c"), F.count_if("test").alias("t"))
    defs = lookups.definitions(symbols)
    out = symbols.select("symbol_id", "name").join(defs, "name").join(told, "symbol_id", "left")
    known = F.col("defs") <= lookups.MAX_DEFS
    return out.select("symbol_id", F.when(known, F.coalesce("c", F.lit(0))).alias("callers"), F.when(known, F.coalesce("t", F.lit(0))).alias("test_callers"), (F.col("defs") > 1).alias("ambiguous"), (~known).alias("common"))


def impact(symbols: DataFrame, files: DataFrame, refs: DataFrame, pairs: DataFrame, changes: DataFrame) -> DataFrame:
    """One row a change (change_id, file_id, a, z): what its innermost touched symbols reach in two hops of callers.

    A symbol has the callers among the first FIRST_HOP symbols that refer to its name, by path, line and name, and none if its
    name has more than MAX_DEFS definitions. Of what the first hop holds, in the order of the touched symbols, each has its
    callers among the first SECOND_HOP, until SECOND_TOTAL are reached. Files reached, those that change together with the own
    one, and test files that refer to a touched name give the modules, the tests and the risk; `code` leaves test files out.
    """
    scratch = Scratch(symbols.sparkSession)
    at = files.select("file_id", "path", paths.family(F.col("lang")).alias("family"), paths.is_test_path(F.col("path")).alias("test"), paths.group_of(F.col("path")).alias("module"))
    known = scratch.write("symbols", symbols.join(at, "file_id").join(lookups.definitions(symbols), "name"))
    used = scratch.write("refs", refs.select("name", F.col("enclosing_symbol_id").alias("caller_id"), "line", "file_id"))
    calls = scratch.write("calls", _first_callers(known, used))

    hit = known.join(changes.withColumnRenamed("file_id", "changed"), F.col("file_id") == F.col("changed")).where("start_line <= z and a <= end_line")
    inside = lookups.contains("s", "o") & (F.col("s.change_id") == F.col("o.change_id")) & (F.col("s.symbol_id") != F.col("o.symbol_id"))
    inner = scratch.write("touched", hit.alias("s").join(hit.alias("o"), inside, "left_anti").select("change_id", "symbol_id", "name", "start_line", "signature", "defs", "family"))
    own = inner.select("change_id", "symbol_id")
    order = F.min(F.struct("start_line", "symbol_id", "r"))
    one = inner.join(calls, "symbol_id").groupBy("change_id", "caller_id").agg(order.alias("place")).withColumnRenamed("caller_id", "symbol_id").join(own, ["change_id", "symbol_id"], "left_anti")
    one = scratch.write("callers", one.select("change_id", "symbol_id", F.row_number().over(Window.partitionBy("change_id").orderBy("place")).alias("pos")))
    two = one.join(calls.where(F.col("r") <= SECOND_HOP), "symbol_id").groupBy("change_id", "caller_id").agg(F.min("pos").alias("pos")).withColumnRenamed("caller_id", "symbol_id")
    two = two.join(own.unionByName(one.drop("pos")), ["change_id", "symbol_id"], "left_anti")
    before = F.count("*").over(Window.partitionBy("change_id").orderBy("pos").rangeBetween(Window.unboundedPreceding, -1))
    two = two.withColumn("before", before).where(F.col("before") < SECOND_TOTAL)

    home = changes.join(at, "file_id").select("change_id", F.col("file_id").alias("own_file"), F.col("path").alias("own_path"), F.col("module").alias("own_module"))
    reached = one.select("change_id", "symbol_id", F.lit(1).alias("hop")).unionByName(two.select("change_id", "symbol_id", F.lit(2).alias("hop")))
    reached = scratch.write("reached", reached.join(known.select("symbol_id", "path", "test", "module"), "symbol_id").join(home, "change_id"))
    other, code = F.col("module") != F.col("own_module"), ~F.col("test")
    told = reached.groupBy("change_id").agg(
        F.count_if(F.col("hop") == 1).alias("callers"), F.count_if(F.col("hop") == 2).alias("callers2"), F.count_if((F.col("hop") == 1) & code).alias("code_callers"), F.count_if((F.col("hop") == 2) & code).alias("code_callers2"),
        F.countDistinct(F.when(other, F.col("module"))).alias("modules"), F.countDistinct(F.when(other & code, F.col("module"))).alias("code_modules"),
    )
    both = lookups.cochanged(pairs).join(at.select(F.col("file_id").alias("file_b"), "path", "test"), "file_b")
    first = Window.partitionBy("file_a").orderBy(F.desc("cnt"), "path")
    both = both.withColumn("r", F.row_number().over(first)).where(F.col("r") <= COCHANGED)
    near = scratch.write("cochanged", home.join(both, F.col("own_file") == F.col("file_a")).select("change_id", "path", "test"))
    together = near.groupBy("change_id").agg(F.count("*").alias("cochanged"), F.count_if(code).alias("code_cochanged"))

    named = used.join(inner.where(F.col("defs") <= lookups.MAX_DEFS).select("name").distinct(), "name", "left_semi").join(at, "file_id")
    named = named.withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy("path", "line"))).where((F.col("r") <= REFERENCES) & F.col("test")).select("name", "family", "path").distinct()
    tests = reached.where("test and path <> own_path").select("change_id", "path").unionByName(near.where("test").select("change_id", "path"))
    tests = tests.unionByName(inner.where(F.col("defs") <= lookups.MAX_DEFS).join(named, ["name", "family"]).select("change_id", "path"))
    tests = tests.groupBy("change_id").agg(F.countDistinct("path").alias("tests"))

    mark = F.max(F.col("signature").rlike(r"^@app\.")).alias("framework")
    marks = inner.groupBy("change_id").agg(F.count("*").alias("touched"), F.count_if(F.col("defs") > lookups.MAX_DEFS).alias("ambiguous"), (F.max("defs") == 1).alias("unique"), mark)
    out = changes.select("change_id")
    for part in (marks, told, together, tests):
        out = out.join(part, "change_id", "left")
    counts = ("touched", "ambiguous", "callers", "callers2", "code_callers", "code_callers2", "modules", "code_modules", "cochanged", "code_cochanged", "tests")
    out = out.select("change_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("unique", "framework")))
    untested = F.col("tests") == 0
    all_ = text.risk(F.col("callers"), F.col("callers2"), F.col("modules"), F.col("cochanged"), untested, F.col("framework"))
    code_ = text.risk(F.col("code_callers"), F.col("code_callers2"), F.col("code_modules"), F.col("code_cochanged"), untested, F.col("framework"))
    return out.withColumns({"risk": all_["level"], "code_risk": code_["level"], "reason": code_["reason"]})


def _first_callers(known: DataFrame, used: DataFrame) -> DataFrame:
    """(symbol_id, caller_id, r): callers of one language family, outside the symbol, with their places among all that refer to the name."""
    target = known.where(F.col("defs") <= lookups.MAX_DEFS)
    spans = known.select(F.col("symbol_id").alias("caller_id"), "path", "start_line", F.col("name").alias("caller"), *(F.col(c).alias(f"c_{c}") for c in ("family", "file_id", "start_byte", "end_byte")))
    naming = used.where("caller_id is not null").select("name", "caller_id").distinct().join(target.select("name").distinct(), "name", "left_semi").join(spans, "caller_id")
    order = Window.partitionBy("name").orderBy("path", "start_line", "caller", "caller_id")
    naming = naming.withColumn("r", F.row_number().over(order)).where(F.col("r") <= FIRST_HOP).drop("path", "start_line", "caller")
    met = target.select("name", "symbol_id", "family", "file_id", "start_byte", "end_byte").join(naming, "name").where("family = c_family and symbol_id <> caller_id")
    within = (F.col("file_id") == F.col("c_file_id")) & (F.col("start_byte") <= F.col("c_start_byte")) & (F.col("c_end_byte") <= F.col("end_byte"))
    return met.where(~within).select("symbol_id", "caller_id", "r")


def find(symbols: DataFrame, files: DataFrame, query: str, limit: int) -> DataFrame:
    """Symbols by name, then those in files whose path holds the query, in that order; each once."""
    all_ = lookups.with_files(symbols, files)
    rank = F.when(F.lower("name") == query.lower(), 0).when(F.lower("path").contains(query.lower()), 1).when(F.lower("name").startswith(query.lower()), 2)
    return all_.withColumn("tier", rank).where("tier is not null").orderBy("tier", "path", "start_line", "symbol_id").limit(limit).select("tier", "symbol_id", "name", "path")


def neighborhood(centers: DataFrame, symbols: DataFrame, refs: DataFrame, calls: DataFrame, pairs: DataFrame, most: int = 20, most_defs: int = 2, most_files: int = 5) -> DataFrame:
    """(symbol_id, kind, target): around each center its file, its callers, what it calls and the files that change with its own.

    Callers and callees are the first `most` by id, names with more than most_defs definitions call nothing; of the files that
    change together, the most_files with the highest counts.
    """
    own = centers.select("symbol_id").join(symbols.select("symbol_id", "file_id"), "symbol_id")
    by = Window.partitionBy("symbol_id")
    callers = own.select("symbol_id").join(calls.select("symbol_id", F.col("caller_id").alias("target")), "symbol_id").distinct()
    rare = lookups.definitions(symbols).where(F.col("defs") <= most_defs).select("name")
    used = refs.select(F.col("enclosing_symbol_id").alias("symbol_id"), "name").distinct().join(rare, "name")
    callees = own.select("symbol_id").join(used, "symbol_id").join(symbols.select("name", F.col("symbol_id").alias("target")), "name").where("target <> symbol_id").select("symbol_id", "target").distinct()
    first = lambda df: df.withColumn("r", F.row_number().over(by.orderBy("target"))).where(F.col("r") <= most).drop("r")
    near = own.join(lookups.cochanged(pairs), F.col("file_id") == F.col("file_a")).withColumn("r", F.row_number().over(by.orderBy(F.desc("cnt"), "file_b"))).where(F.col("r") <= most_files)
    out = own.select("symbol_id", F.lit("defines").alias("kind"), F.col("file_id").alias("target"))
    for kind, df in (("caller", first(callers)), ("callee", first(callees)), ("cochange", near.select("symbol_id", F.col("file_b").alias("target")))):
        out = out.unionByName(df.select("symbol_id", F.lit(kind).alias("kind"), "target"))
    return out


def once(edges: DataFrame) -> DataFrame:
    """(src, dst, kind, depth): edges once each with their least depth, without loops."""
    return edges.where("src <> dst").groupBy("src", "dst", "kind").agg(F.min("depth").alias("depth"))


def node_keys(nodes: DataFrame) -> DataFrame:
    """Nodes (node_id, kind, path, label) with keys that don't depend on ids; equal ones are numbered in the order of ids."""
    no = F.row_number().over(Window.partitionBy("kind", "path", "label").orderBy("node_id")) - 1
    return nodes.select("node_id", F.concat("kind", F.lit(":"), "path", F.lit(":"), "label", F.lit("#"), no.cast("string")).alias("key"))


def footprint(events: DataFrame) -> DataFrame:
    """(session, file_id, mark): edited before read before searched, whichever a session did most of consequence to a file."""
    rank = F.when(F.col("op") == "edit", 0).when(F.col("op") == "read", 1).when(F.col("op") == "search", 2)
    best = events.where(rank.isNotNull()).groupBy("session", "file_id").agg(F.min(rank).alias("r"))
    return best.select("session", "file_id", F.element_at(F.array(F.lit("edited"), F.lit("read"), F.lit("searched")), F.col("r") + 1).alias("mark"))


def related_tests(changed: DataFrame, files: DataFrame, edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(file_id, test_id): tests that refer to a changed file or change with it; a changed test is its own."""
    tests = files.where(paths.is_test_path(F.col("path"))).select(F.col("file_id").alias("test_id"))
    own = changed.select("file_id")
    referring = edges.select(F.col("dst").alias("file_id"), F.col("src").alias("test_id"))
    together = lookups.cochanged(pairs).select(F.col("file_a").alias("file_id"), F.col("file_b").alias("test_id"))
    met = own.join(referring.unionByName(together), "file_id").unionByName(own.select("file_id", F.col("file_id").alias("test_id")))
    return met.join(tests, "test_id", "left_semi").select("file_id", "test_id").distinct()


def linked_notes(notes: DataFrame, symbols: DataFrame, most: int = 8, most_defs: int = 3) -> DataFrame:
    """(note_id, name): names of notes' words that 1 to most_defs symbols have, the first `most` in the order of the alphabet."""
    rare = lookups.definitions(symbols).where(F.col("defs") <= most_defs).select("name")
    words = notes.select("note_id", F.explode(F.array_distinct(text.identifiers(F.col("text")))).alias("name"))
    met = words.join(rare, "name")
    return met.withColumn("r", F.row_number().over(Window.partitionBy("note_id").orderBy("name"))).where(F.col("r") <= most).select("note_id", "name")
