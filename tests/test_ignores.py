"""Ignore rules against a plain walk down each path."""

import random
import re

from codequarry.sources import ignores, trees


def matches(pattern: str, rest: str, is_folder: bool) -> bool:
    """Segment by segment, with stars across segments tried at every length."""
    if pattern.endswith("/"):
        if not is_folder:
            return False
        pattern = pattern.rstrip("/")
    anchored = "/" in pattern
    want = pattern.removeprefix("/").split("/")

    def segment(p: str, s: str) -> bool:
        out = "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else c if c in "[]-" else "^" if c == "!" else re.escape(c) for c in p)
        return re.fullmatch(out, s) is not None

    def walk(ps: list, ss: list) -> bool:
        if not ps:
            return not ss
        if ps[0] == "**":
            if len(ps) == 1:
                return bool(ss)
            return any(walk(ps[1:], ss[k:]) for k in range(len(ss) + 1))
        return bool(ss) and segment(ps[0], ss[0]) and walk(ps[1:], ss[1:])

    have = rest.split("/")
    return walk(want, have) if anchored else segment(want[0], have[-1])


def shut(path: str, files: dict[str, str]) -> bool:
    parts = path.split("/")
    for n in range(1, len(parts) + 1):
        state = False
        for k in range(n):
            for line in files.get("/".join(parts[:k]), "").split("\n"):
                line = line.rstrip()
                if not line or line.startswith("#"):
                    continue
                bare = line.removeprefix("!").removeprefix("\\") if line[:2] in ("\\#", "\\!") else line.removeprefix("!")
                if matches(bare, "/".join(parts[k:n]), n < len(parts)):
                    state = not line.startswith("!")
        if state:
            return True
    return False


def test_random_trees_and_rules(spark):
    rng = random.Random(7)
    names = ["a", "b", "ab", "x.py", "y.c", "#n", "dir", "a.b"]
    patterns = ["a", "*.py", "!x.py", "/a", "dir/", "!dir/", "a/b", "**/x.py", "a/**", "a/**/x.py", "?", "[ab]", "[!a]", "a*", "!a/*", "/dir/*.c", "\\#n", "# words", "", "a.b", "*.b  ", "!**/y.c", "ab/"]
    for _ in range(3):
        paths = sorted({"/".join(rng.choices(names, k=rng.randrange(1, 5))) for _ in range(300)})
        files = {f: "\n".join(rng.choices(patterns, k=rng.randrange(1, 7))) for f in ["", "a", "dir", "a/b", "dir/a"]}
        found = ignores.ignored(spark.createDataFrame([(p,) for p in paths], "path string"), ignores.rules(spark.createDataFrame(list(files.items()), "folder string, text string")))
        assert sorted(r["path"] for r in found.collect()) == [p for p in paths if shut(p, files)]


def test_a_scan_leaves_ignored_files_out(spark, tmp_path):
    for name in ("src/keep.py", "src/gen/out.py", "src/gen/keep.py", "notes.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("def f(): pass\n")
    told = spark.createDataFrame([("", "notes.*\n"), ("src", "gen/\n!gen/keep.py\n")], "folder string, text string")
    assert {r["path"] for r in trees.scan(spark, str(tmp_path), told).collect()} == {"src/keep.py"}
    assert trees.scan(spark, str(tmp_path)).count() == 4
