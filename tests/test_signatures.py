"""What a caller sees of definitions in several languages, and which changes old calls survive."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from codequarry.functions import signatures

SYMBOL = "id int, lang string, kind string, name string, text string"
#: lang, kind, name, before, after, whether old calls work
CASES = [
    ("rust", "function", "resize_it", "fn resize_it(w: u32) -> u32 { w }", "fn resize_it(w: u32, h: u32) -> u32 { w * h }", False),
    ("rust", "function", "body_only", "fn body_only(a: i32) -> i32 { a }", "fn body_only(a: i32) -> i32 { a + 2 }", True),
    ("python", "function", "resize_it", "def resize_it(w):\n    return w\n", "def resize_it(w, h):\n    return w * h\n", False),
    ("typescript", "function", "resizeIt", "function resizeIt(w: number): number { return w; }", "function resizeIt(w: number, h: number): number { return w * h; }", False),
    ("typescript", "function", "bodyOnly", "const bodyOnly = (a: number): number => { return a; };", "const bodyOnly = (a: number): number => { return a + 2; };", True),
    ("javascript", "function", "resizeIt", "function resizeIt(w) { return w; }", "function resizeIt(w, h) { return w * h; }", False),
    ("java", "method", "resizeIt", "@Override\n  public int resizeIt(int w) { return w; }", "@Override\n  public int resizeIt(int w, int h) { return w * h; }", False),
    ("go", "function", "ResizeIt", "func ResizeIt(w int) int { return w }", "func ResizeIt(w, h int) int { return w * h }", False),
    ("go", "method", "BodyOnly", "func (u *User) BodyOnly(a int) int { return a }", "func (x *User) BodyOnly(b int) int { return a + 2 }", True),
    ("go", "method", "BodyOnly", "func (u *User) BodyOnly(a int) int { return a }", "func (u *Other) BodyOnly(a int) int { return a }", False),
    ("csharp", "method", "Resize", "public int Resize(int w) { return w; }", "public int Resize(int w, int h) { return w; }", False),
    ("csharp", "method", "Resize", "[Fact] [Theory(1, \"a]\")]\npublic int Resize(int w) { return w; }", "public int Resize(int w) { return w; }", True),
    ("kotlin", "function", "resizeIt", "fun resizeIt(w: Int): Int { return w }", "fun resizeIt(w: Int, h: Int): Int { return w }", False),
    ("c", "function", "resize_it", "int resize_it(int w) { return w; }", "int resize_it(int w, int h) { return w; }", False),
    ("cpp", "function", "resize_it", "int resize_it(int w) { return w; }", "long resize_it(int w) { return w; }", False),
    ("rust", "function", "tidy_it", "fn tidy_it(a: i32) -> i32 { a }", "pub(crate) fn tidy_it(\n    a: i32, // words\n) -> i32 { a }", True),
    ("java", "method", "tidyIt", "int tidyIt(int a) { return a; }", "public final int tidyIt(int /* x */ a) { return a; }", True),
    ("typescript", "function", "tidyIt", "function tidyIt(a: number): void {}", "export function tidyIt(\n  a: number,\n): void {}", True),
    ("python", "function", "tidy_it", "def tidy_it(a, b):\n    pass\n", "def tidy_it(a,\n            b):  # words\n    pass\n", True),
    ("python", "function", "go_on", "def go_on(a):\n    pass\n", "def go_on(a, b=1):\n    pass\n", True),
    ("python", "function", "go_on", "def go_on(a):\n    pass\n", "def go_on(a=1, *rest, **more):\n    pass\n", True),
    ("python", "function", "go_on", "def go_on(a=1):\n    pass\n", "def go_on(a):\n    pass\n", False),
    ("python", "function", "go_on", "def go_on(a=(1, 'x,)')):\n    pass\n", "def go_on(a=(1,  'x,)'), b: dict[str, int] = {}) -> int:\n    pass\n", True),
    ("typescript", "function", "goOn", "function goOn(a: number) {}", "function goOn(a: number, b?: string, c = 1) {}", True),
    ("kotlin", "function", "goOn", "fun goOn(a: Int) { }", "fun goOn(a: Int, b: Int = 1) { }", True),
    ("kotlin", "function", "goOn", "fun goOn(a: Int, f: Int = 2) { }", "fun goOn(a: Int, b: Int = 1, f: Int = 2) { }", True),
    ("kotlin", "function", "goOn", "fun goOn(a: Int, f: Int) { }", "fun goOn(a: Int, b: Int = 1, f: Int) { }", False),
    ("cpp", "function", "go_on", "int go_on(int a) { return a; }", "int go_on(int a, int b = 1) { return a; }", True),
    ("rust", "function", "same_call", "fn same_call(a: i32) -> i32 { 1 }", "fn same_call(b: i32) -> i32 { 1 }", True),
    ("java", "method", "sameCall", "int sameCall(String a) { return 1; }", "int sameCall(final String b) { return 1; }", True),
    ("go", "function", "SameCall", "func SameCall(a, b int) int { return 1 }", "func SameCall(c int, d int) int { return 1 }", True),
    ("c", "function", "same_call", "int same_call(const char *a) { return 1; }", "int same_call(const char *b) { return 1; }", True),
    ("javascript", "function", "sameCall", "function sameCall(a) { return 1; }", "function sameCall(b) { return 1; }", True),
    ("python", "function", "same_call", "def same_call(a):\n    pass\n", "def same_call(b):\n    pass\n", False),
    ("rust", "function", "ret_kind", "fn ret_kind() -> i32 { 1 }", "fn ret_kind() -> i64 { 1 }", False),
    ("java", "method", "retKind", "int retKind() { return 1; }", "long retKind() { return 1; }", False),
    ("java", "method", "retKind", "int retKind(Integer a) { return 1; }", "Integer retKind(int a) { return 1; }", True),
    ("java", "method", "retKind", "void retKind(Map<String, List<Integer>> a, int b) { }", "void retKind(Map<String, List<Integer>> c, int d) { }", True),
    ("java", "method", "retKind", "void retKind(@Named(\"a,b\") String a) { }", "void retKind(String a) { }", True),
    ("typescript", "function", "wide", "function wide(a: string | number): void {}", "function wide(a: number | Map<string, A | B> | string): void {}", True),
    ("typescript", "function", "wide", "function wide(a: string | number): void {}", "function wide(a?: string): void {}", False),
    ("typescript", "function", "wide", "function wide(a: string): void {}", "function wide(a?: string): void {}", True),
    ("kotlin", "function", "wide", "fun wide(a: Map<String, Int>) {}", "fun wide(a: Map<String, Int>?) {}", True),
    ("rust", "struct", "Pair", "struct Pair(i32);", "struct Pair(i32, i32);", False),
    ("rust", "function", "life", "fn life<'a>(x: &'a str) -> &'a str { x }", "fn life<'a>(y: &'a str) -> &'a str { y }", True),
    ("cpp", "method", "Box", "Box(int a) : v(a) { }", "Box(int a) : v(a), w(1) { }", True),
]


@pytest.fixture(scope="module")
def told(spark):
    rows = [(i, lang, kind, name, text) for i, (lang, kind, name, *both, _) in enumerate(CASES) for text in both]
    half = lambda k: signatures.with_shapes(spark.createDataFrame(rows[k::2], SYMBOL))
    pairs = half(0).select("id", "lang", F.col("call").alias("a")).join(half(1).select("id", F.col("call").alias("b")), "id")
    return {r["id"]: r for r in pairs.select("id", "a", "b", signatures.compatible(F.col("lang"), F.col("a"), F.col("b")).alias("works")).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_which_changes_old_calls_survive(told, i):
    assert told[i]["works"] is CASES[i][5], (CASES[i], told[i])


def test_shapes(spark):
    rows = [
        (1, "python", "class", "Foo", "class Foo(Bar):\n    pass\n"), (2, "rust", "const", "LIMIT", "const LIMIT: u32 = f(5);"), (3, "kotlin", "class", "A", "class A : B(x) {}"), (4, "go", "method", "Get", "func (u *User) Get(a, b int, c []string) (int, error) { return 1 }"),
        (5, "typescript", "function", "f", "export async function f<T extends {a: string}>(this: T, ...rest: Array<[T, string]>): Promise<T> { }"), (6, "java", "method", "g", "@A(x = \")\") @B public static <T> T g(final T a, int... b) throws E { return \"{\"; }"), (7, "python", "function", "empty", ""), (8, "c", "function", "f", None),
    ]
    found = {r["id"]: r for r in signatures.with_shapes(spark.createDataFrame(rows, SYMBOL)).collect()}
    call = lambda i: (found[i]["call"]["head"], [tuple(p) for p in found[i]["call"]["params"]], found[i]["call"]["ret"])
    assert [found[i]["call"] for i in (1, 2, 3, 7, 8)] == [None] * 5
    assert call(4) == ("func(*User)", [("int", None), ("int", None), ("[]string", None)], "(int,error)")
    assert call(5) == ("async function<T extends{a:string}>", [(":T", None), ("...:Array<[T,string]>", None)], ":Promise<T>")
    assert call(6) == ("static<T>T", [("T", None), ("int...", None)], "throws E")
    assert found[6]["body"] == '{return"{";}' and found[6]["header"].endswith("throws E")


def test_comments_and_white_space(spark):
    df = spark.createDataFrame([("rust", "a /* b */ c // d\n'e \"// no\" f"), ("python", "a # b\n'# c' d"), ("java", "x='\\''; /* y"), ("python", "  two   words ( x , y )")], "lang string, t string")
    found = [r[0] for r in df.select(signatures.squeeze(signatures.strip_comments(F.col("t"), F.col("lang")))).collect()]
    assert found == ["a c'e\"// no\"f".replace("// no", "//no"), "a'#c'd", "x='\\'';", "two words(x,y)"]
