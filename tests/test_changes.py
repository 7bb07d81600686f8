"""Changes of files' symbols, renames and similar headers."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from codequarry.functions import signatures
from codequarry.operators import changes
from codequarry.shared import written

SCHEMA = "file_id int, symbol_id int, name string, kind string, lang string, text string, start_byte int, end_byte int"


def run(spark, cases):
    """cases: (lang, old symbols, new symbols), each (kind, name, text) or with its span."""
    rows = [[], []]
    for f, (lang, *both) in enumerate(cases):
        for side, symbols in enumerate(both):
            at = 0
            for k, (kind, name, text, *span) in enumerate(symbols):
                a, z = span or (at, at + len(text))
                rows[side].append((f, 1000 * f + k, name, kind, lang, text, a, z))
                at = z + 1
    found = changes.shape_changes(*(spark.createDataFrame(r, SCHEMA) for r in rows)).collect()
    out = [[] for _ in cases]
    for r in found:
        out[r["file_id"]].append((r["change"], r["name"], r["renamed_to"]))
    return [sorted(x, key=str) for x in out]


def test_changes_of_files(spark):
    body = "{ let total = a * 2 + 40; total + %s(total) }"
    cases = [
        ("rust", [("function", "dropped_one", "pub fn dropped_one(a: i32) -> i32 { a + 1 }"), ("function", "resize_it", "fn resize_it(w: u32) -> u32 { w }"), ("function", "body_only", "fn body_only(a: i32) -> i32 { a }"), ("function", "same", "fn same() {}")],
         [("function", "resize_it", "fn resize_it(w: u32, h: u32) -> u32 { w * h }"), ("function", "body_only", "fn body_only(a: i32) -> i32 { a + 2 }"), ("function", "same", "fn same() { /* x */ }")]),
        ("rust", [("function", "old_name", "fn old_name(a: i32) -> i32 " + body % "old_name"), ("function", "keep_it", "fn keep_it() -> i32 { 1 }")], [("function", "new_name", "fn new_name(a: i32, b: i32) -> i32 " + body % "new_name"), ("function", "keep_it", "fn keep_it() -> i32 { 1 }")]),
        ("java", [("method", "findUserByName", "public User findUserByName(String name, int limit) { return lookup(name); }")], [("method", "findUser", "public User findUser(String name, int limit) { return store.get(name, limit); }")]),
        ("rust", [("function", "old_name", "fn old_name(a: i32, b: i32) -> i32 { a }")], [("function", "left_one", "fn left_one(a: i32, b: i32) -> i32 { b }"), ("function", "right_one", "fn right_one(a: i32, b: i32) -> i32 { a + b }")]),
        ("rust", [("function", "old_name", "fn old_name() {}")], [("function", "other_thing", "fn other_thing() {}")]),
        ("java", [("method", "foo", "int foo(int a) { return 1; }"), ("method", "foo", "int foo(int a, int b) { return 2; }")], [("method", "foo", "int foo(int a) { return 1; }")]),
        ("java", [("method", "foo", "int foo(int a) { return 1; }"), ("method", "foo", "int foo(String b) { return 2; }")], [("method", "foo", "int foo(String b) { return 2; }"), ("method", "foo", "int foo(int a) { return 1; }")]),
        ("rust", [("function", "move_me", "fn move_me(a: i32) -> i32 { a }")], [("method", "move_me", "fn move_me(a: i32) -> i32 { a }")]),
        ("python", [("class", "Box", "class Box:\n    def fill(self):\n        return 1\n", 0, 60), ("method", "fill", "def fill(self):\n        return 1\n", 15, 59)], [("class", "Box", "class Box:\n    def fill(self):\n        return 2\n", 0, 60), ("method", "fill", "def fill(self):\n        return 2\n", 15, 59)]),
        ("python", [], [("function", "f", "def f(): pass")]),
    ]
    assert run(spark, cases) == [
        [("body", "body_only", None), ("removed", "dropped_one", None), ("signature", "resize_it", None)], [("removed", "old_name", "new_name")], [("removed", "findUserByName", "findUser")], [("removed", "old_name", None)], [("removed", "old_name", None)],
        [("signature", "foo", None)], [], [], [("body", "fill", None)], [],
    ]


def dice(a: str, b: str) -> float:
    x, y = (Counter(s[i : i + 2] for i in range(len(s) - 1)) for s in (a, b))
    total = sum(x.values()) + sum(y.values())
    return 2 * sum((x & y).values()) / total if total else 0.0


def test_similarity_and_its_join(spark):
    rng = random.Random(4)
    base = ["fn (a:i32,b:&str)->Result<u8>", "public static void(String name,int limit)", "aaaaaaaaaaaaaaaaaaaaaaaa", "äöüäöüäöüäöüäöüäöü"]

    def edited():
        s = list(rng.choice(base))
        for _ in range(rng.randrange(5)):
            s[rng.randrange(len(s))] = rng.choice("abxyz,: ")
        return "".join(s)

    old, new = ([(rng.randrange(3), k, rng.choice(["function", "method"]), edited() if k % 9 else "short") for k in range(60)] for _ in range(2))
    schema = "file_id int, symbol_id int, kind string, header string"
    found = changes.alike_headers(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)).collect()
    want = {(a[1], b[1]): dice(a[3], b[3]) for a in old for b in new if a[0] == b[0] and a[2] == b[2] and min(len(a[3].encode()), len(b[3].encode())) >= 16 and dice(a[3], b[3]) >= 0.85}
    assert {(r["old_id"], r["new_id"]): round(r["score"], 9) for r in found} == {k: round(v, 9) for k, v in want.items()} and len(want) > 20
    pairs = spark.createDataFrame([("", ""), ("a", "b"), ("aaa", "aa"), ("abab", "baba")], "a string, b string")
    assert [r[0] for r in pairs.select(changes.similarity(changes.bigrams(F.col("a")), changes.bigrams(F.col("b")))).collect()] == [dice("", ""), dice("a", "b"), dice("aaa", "aa"), dice("abab", "baba")]


def test_sides_of_a_change_are_not_broadcast(spark):
    """Small files may hold large rows: no join of removed with added symbols sends a side through the driver."""
    row = "file_id int, symbol_id int, name string, kind string, lang string, text string"
    of = lambda first, name: written(signatures.with_shapes(spark.createDataFrame([(i % 3, first + i, f"{name}{i}", "function", "python", f"def {name}{i}(a, b, c{i}):\n    return {i}\n") for i in range(30)], row)), name)
    found = changes.renamed(of(0, "load_it"), of(100, "made_it"))
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert sorted(map(tuple, found.collect())) == [(i, 100 + i) for i in range(30)]


def test_shapes_are_scanned_in_batches(spark):
    """No fold over tokens is interpreted row by row."""
    rows = spark.createDataFrame([(1, "java", "method", "f", "int f(int a) { }")], "id int, lang string, kind string, name string, text string")
    told = signatures.with_shapes(rows).select("header", "body", F.col("call.head").alias("head"))
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "aggregate(" not in plan
    assert tuple(told.first()) == ("int (int a)", "{}", "int")


def test_bigrams_count_repeats(spark):
    assert spark.createDataFrame([("ababa",), ("a",), ("",)], "t string").select(changes.bigrams(F.col("t"))).collect() == [(["ab1", "ab2", "ba1", "ba2"],), ([],), ([],)]


def test_each_kind_of_change_is_a_table_before_they_meet(spark, monkeypatch):
    """The last table joins nothing, and bigrams aren't shuffled before they are cut to the first ones."""
    plans, write = {}, changes.Scratch.write

    def keep(self, name, df):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return write(self, name, df)

    monkeypatch.setattr(changes.Scratch, "write", keep)
    rows = [[(1, n + 1, f"{name}{n}", "function", "python", f"def {name}{n}(first: int, second: str) -> int:\n    return {n}\n", n, n + 1) for n in range(5)] for name in ("load_it", "made_it")]
    schema = "file_id long, symbol_id long, name string, kind string, lang string, text string, start_byte long, end_byte long"
    changes.shape_changes(*(spark.createDataFrame(r, schema) for r in rows))
    assert "Join " not in plans["changes"] and "Join " not in plans["first_grams"]
