"""Column functions on chosen values."""

import pytest
from pyspark.sql import functions as F

from codequarry.functions import paths, text


def values(spark, f, rows):
    """f of each string, in order."""
    df = spark.createDataFrame(list(enumerate(rows)), "i int, x string")
    return [r["v"] for r in df.select("i", f(F.col("x")).alias("v")).orderBy("i").collect()]


def test_identifiers_split_at_case_acronyms_and_digits(spark):
    told = {"parseHTTPRequest": ["parse", "http", "request"], "snake_case_x": ["snake", "case"], "getUser2Name": ["get", "user", "name"], "XMLHttp": ["xml", "http"], "a": [], "": []}
    assert values(spark, text.split_identifier, list(told)) == list(told.values())


def test_terms_are_distinct_and_in_order(spark):
    assert values(spark, text.terms_of, ["loadUser loadUser user 9x"]) == [["loaduser", "load", "user"]]


def test_question_terms_drop_stop_words(spark):
    found = values(spark, text.query_terms, ["where is the loadUser function?"])[0]
    assert [(t["text"], t["prefix"]) for t in found] == [("loaduser", False), ("load", True), ("user", True)]


@pytest.mark.parametrize(("path", "is_test"), [("src/a.test.ts", True), ("tests/x.py", True), ("src/Test.java", False), ("src/ATest.java", True), ("src/contest.py", False), ("test_a.py", True), ("src/latest.js", False)])
def test_test_paths(spark, path, is_test):
    assert values(spark, paths.is_test_path, [path]) == [is_test]


def test_modules(spark):
    told = {"main.py": "(root)", "src/a.py": "src", "src/core/a.py": "src/core", "docs/x/a.md": "docs", "packages/web/a.ts": "packages/web"}
    assert values(spark, paths.group_of, list(told)) == list(told.values())


def test_paths_are_cleaned(spark):
    told = {"a/./b/../c.py": "a/c.py", "\\x\\y.py": "/x/y.py", "../a": "../a", "/../a": "/a"}
    assert values(spark, paths.clean_path, list(told)) == list(told.values())


def test_commands(spark):
    told = {"pytest -q": True, "cd a && npm run test": True, "git log | grep pytest": False, "cargo test --all": True, "echo test": False}
    assert values(spark, text.is_test_command, list(told)) == list(told.values())
    assert values(spark, text.is_vcs_only, ["git add . && git commit", "git status; make", "echo hi"]) == [True, False, False]
    assert values(spark, text.working_dir, ["cd web && npm t", "npm t"]) == ["web", None]


RUNS = (
    "cargo test -p core 2>&1 | tail -9", "cd a && cargo +stable nextest run", "RUST_BACKTRACE=1 cargo test", 'sh slow.sh "cargo fmt; cargo test"', "npm t", "npm run unit:test", "npm run lint-check", "pnpm -r test",
    "pnpm --filter api test", "pnpm -C api verify", "yarn workspace api test", "npm.cmd test", "npx jest a.spec.ts", "npx playwright test", "npx cypress run", "node --test src", "python3 -m pytest tests", "python tests/test_b.py",
    "python manage.py test shop", "python.exe manage.py check", "go.exe test ./pkg", "zig build test", "sbt test", "mvn -q verify", "mvn -pl core package", "./gradlew :api:test", "gradlew.bat :api:testReleaseUnitTest",
    '"C:\\tools\\gradlew.bat" build', "make integration-test", "./tools/run-tests.sh", "./test.sh",
)
RUNS_NOT = (
    "cargo build", "cargo add test-log", "git commit -m 'pytest passes'", "git log --grep=jest", "rg pytest src", "echo cargo test", "cat tests/test_b.py", "ls test", "npm install", "npm add t", "pnpm build", "npm run dev",
    "./gradlew assembleRelease", "mvn compile -DskipTests", "flutter analyze", "python manage.py migrate", "test -f a.txt", "",
)


def test_test_commands(spark):
    assert [c for c, v in zip(RUNS, values(spark, text.is_test_command, RUNS), strict=True) if not v] == []
    assert [c for c, v in zip(RUNS_NOT, values(spark, text.is_test_command, RUNS_NOT), strict=True) if v] == []
    assert values(spark, text.is_vcs_only, ["cd a && git pull 2>&1 | tail -2", "make x && git add .", "cd a"]) == [True, False, False]


def test_secrets_and_urls(spark):
    found = values(spark, text.redact_secrets, ["api_key = abcdef123 and sk-abcdefghijklmnopqrst", "nothing"])
    assert [(r["text"], r["count"]) for r in found] == [("[redacted] and [redacted]", 2), ("nothing", 0)]
    assert values(spark, text.redact_url, ["see https://u:p@host/x and http://host"]) == ["see https://host/x and http://host"]


def test_changed_spans(spark):
    df = spark.createDataFrame([("abcd", "abXcd"), ("same", "same"), ("", "x"), ("aaa", "aa")], "a string, b string")
    assert [tuple(r[0]) for r in df.select(text.changed_span(F.col("a"), F.col("b"))).collect()] == [(2, 2, 3), (4, 4, 4), (0, 0, 1), (2, 3, 2)]


def test_dice_counts_repeats(spark):
    df = spark.createDataFrame([("night", "nacht"), ("aaa", "aa"), ("a", "a")], "a string, b string")
    assert [round(r[0], 6) for r in df.select(text.dice(F.col("a"), F.col("b"))).collect()] == [0.25, round(2 / 3, 6), 1.0]


def test_diff_lines_and_leaks(spark):
    lines = ["--- a/x", "+++ b/x", "@@ -1,2 +1 @@", "-old", "--", "+new", "++", " same", "diff --git a b", "", None]
    assert values(spark, text.diff_line, lines) == ["old", "new", "hunk", "deleted", "deleted", "added", "added", "context", None, None, None]
    assert values(spark, lambda x: text.leaked(x, F.lit("find foo"), F.lit("bar foo baz")), ["find foo", "find bar baz bar 9", None]) == [[], ["bar", "baz"], []]
