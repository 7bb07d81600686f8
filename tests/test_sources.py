import json

from codequarry.sources import agent_logs, history, outputs, trees

FILES = {
    "src/login.py": "import os\n\nclass Login:\n    def run(self, user):\n        return check(user)\n\ndef check(user):\n    return bool(user)\n",
    "src/app.ts": "export function start(x) {\n  const y = load(x);\n  return y;\n}\n\nexport class Store {\n}\n",
    "lib/main.rs": "pub fn main() {\n    helper(1);\n}\n\nfn helper(x: i32) {\n}\n",
    "node_modules/skip.js": "function skipped() {}\n",
    ".hidden/a.py": "def hidden(): pass\n",
    "notes.txt": "def nothing(): pass\n",
    "big.py": "x" * ((1 << 20) + 1),
    "long.js": "x" * 30_000,
    "zero.c": "int a;\0",
}


def tree(tmp_path):
    for path, text in FILES.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    return str(tmp_path)


def test_scan_keeps_what_is_indexed(spark, tmp_path):
    found = trees.scan(spark, tree(tmp_path)).collect()
    assert {r["path"]: r["lang"] for r in found} == {"src/login.py": "python", "src/app.ts": "typescript", "lib/main.rs": "rust"}


def test_definitions_and_references(spark):
    rows = [(1, "python", FILES["src/login.py"]), (2, "typescript", FILES["src/app.ts"]), (3, "rust", FILES["lib/main.rs"])]
    files = spark.createDataFrame(rows, "file_id long, lang string, text string")
    symbols = trees.definitions(files)
    found = {(r["file_id"], r["name"]): (r["kind"], r["start_line"], r["end_line"]) for r in symbols.collect()}
    assert {name for _, name in found} == {"Login", "run", "check", "start", "Store", "main", "helper"}
    assert found[1, "Login"][:2] == ("class", 3) and found[1, "run"][:2] == ("method", 4) and found[1, "check"][:2] == ("function", 7)
    assert found[2, "start"] == ("function", 1, 4) and found[3, "main"] == ("function", 1, 3)
    refs = {tuple(r) for r in trees.references(files, symbols).select("file_id", "line", "name", "enclosing").collect()}
    assert {(1, 5, "check", "run"), (2, 2, "load", "start"), (3, 2, "helper", "main")} <= refs


def test_log(spark, tmp_path):
    (tmp_path / "log.txt").write_text("\x1eaa\x1f100\x1ffix: it\n\na.py\nb/c.py\n\x1ebb\x1f90\x1ffirst\n\na.py\n")
    commits, files = history.read_log(spark, str(tmp_path / "log.txt"))
    assert {tuple(r) for r in commits.collect()} == {("aa", 100, "fix: it"), ("bb", 90, "first")}
    assert {tuple(r) for r in files.collect()} == {("aa", "a.py"), ("aa", "b/c.py"), ("bb", "a.py")}


def test_status(spark):
    lines = spark.createDataFrame([(" M a.py",), ("?? new.py",), ("R  old.py -> b.py",), ("",)], "value string")
    assert {tuple(r) for r in history.read_status(lines).collect()} == {("M", "a.py"), ("??", "new.py"), ("R", "b.py")}


def test_diff(spark):
    text = "diff --git a/x.py b/x.py\nindex 1..2\n--- a/x.py\n+++ b/x.py\n@@ -3,2 +3,3 @@ def f\n-a\n--- b\n+c\n+++ d\n+e\n@@ -10 +11,0 @@\n-z\ndiff --git a/n.py b/n.py\nnew file mode 100644\n--- /dev/null\n+++ b/n.py\n@@ -0,0 +1,2 @@\n+p\n+q"
    rows = [(1, i, line) for i, line in enumerate(text.split("\n"))]
    found = {r["path"]: r for r in history.read_diff(spark.createDataFrame(rows, "diff_id long, pos int, line string")).collect()}
    assert set(found) == {"x.py", "n.py"}
    x, n = found["x.py"], found["n.py"]
    assert (x["added"], x["removed"], x["new_file"]) == (3, 3, False) and (n["added"], n["removed"], n["new_file"]) == (2, 0, True)
    assert [tuple(s) for s in x["ranges"]] == [(3, 5)] and [tuple(s) for s in x["old_ranges"]] == [(3, 4), (10, 10)]
    assert [tuple(s) for s in n["ranges"]] == [(1, 2)] and n["old_ranges"] == []


def test_agent_logs(spark, tmp_path):
    def entry(uuid, kind, ts, content, mid=None, usage=None):
        return json.dumps({"type": kind, "uuid": uuid, "timestamp": ts, "message": {"id": mid, "model": "m-1" if mid else None, "role": kind, "usage": usage, "content": content}})

    call = [{"type": "tool_use", "id": "c1", "name": "Edit", "input": {"file_path": "a.py"}}, {"type": "tool_use", "id": "c2", "name": "Bash", "input": {"command": "cd x && pytest -q"}}]
    lines = [
        entry("1", "assistant", "2026-01-01T00:00:00Z", call, "g1", {"input_tokens": 5, "output_tokens": 1}), entry("1", "assistant", "2026-01-01T00:00:00Z", call, "g1", {"input_tokens": 5, "output_tokens": 1}),
        entry("2", "assistant", "2026-01-01T00:00:01Z", [], "g1", {"input_tokens": 5, "output_tokens": 9}), entry("3", "user", "2026-01-01T00:00:02Z", [{"type": "tool_result", "tool_use_id": "c1", "is_error": True}]), "not json", "",
    ]
    (tmp_path / "s1.jsonl").write_text("﻿" + "\n".join(lines))
    raw = agent_logs.read_lines(spark, str(tmp_path))
    entries = agent_logs.parse(raw)
    assert entries.count() == 3
    events = {r["call_id"]: r for r in agent_logs.tool_events(entries).collect()}
    assert (events["c1"]["op"], events["c1"]["path"], events["c1"]["ok"]) == ("edit", "a.py", False)
    assert (events["c2"]["op"], events["c2"]["ok"], events["c2"]["test_run"]) == ("shell", None, True)
    assert tuple(agent_logs.usage(entries).first()) == ("m-1", 5, 9, 0, 0, 1)
    assert tuple(agent_logs.skipped(raw).first()) == ("s1", 0, 1, 4)


def test_outputs(spark, tmp_path):
    path = str(tmp_path / "t")
    outputs.replace_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "v int, p string"), path, "p")
    outputs.replace_partitions(spark.createDataFrame([(3, "b")], "v int, p string"), path, "p")
    assert {(r["v"], r["p"]) for r in spark.read.parquet(path).collect()} == {(1, "a"), (3, "b")}
    old, new = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(2, "z"), (2, "a"), (3, "w")], "k int, v string")
    assert {tuple(r) for r in outputs.upsert(old, new, "k").collect()} == {(1, "x"), (2, "z"), (3, "w")}
    log = str(tmp_path / "log")
    outputs.append_log(old, log)
    outputs.append_log(old, log)
    assert spark.read.json(log).count() == 4


def test_markdown_round_trip(spark):
    rows = [(1, 2, "b.py", 9, "g", "def g()"), (1, 3, "a.py", 5, "f", "def f():\n  # - not: an item"), (1, 4, "b.py", 2, "h", "x"), (2, 1, "c.py", 1, "k", "y")]
    items = spark.createDataFrame(rows, "query_id long, rank int, path string, start_line int, name string, text string")
    shown = outputs.to_markdown(items)
    assert shown.where("query_id = 1").first()["markdown"].startswith("## b.py\n- h:2\nx\n- g:9\n")
    assert {tuple(r) for r in outputs.from_markdown(shown).collect()} == {(q, p, n, s) for q, _, p, s, n, _ in rows}


def test_definitions_are_read_where_their_file_lies(spark):
    """No line of a file is shuffled; ends, methods, closing brackets and an odd byte are as a plain reading tells."""
    texts = [("p", "python", "class A:\r\n  def b(self):\n    pass\n\n  x = 1\ndef c():\n    return 1\n\n"), ("t", "typescript", "function f() {\n  g();\n}\nclass B\n"), ("c", "c", "struct s\r\rint run(int a)\n{\n}\n"), ("n", None, "def x():\n"), ("e", "python", ""), ("z", "python", None)]
    files = spark.createDataFrame(texts, "file_id string, lang string, text string")
    found = trees.definitions(files)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in found.select("file_id", "name", "kind", "start_line", "end_line").collect()) == [
        ("c", "run", "method", 1, 1), ("p", "A", "class", 1, 5), ("p", "b", "method", 2, 4), ("p", "c", "function", 6, 7), ("t", "B", "class", 4, 4), ("t", "f", "function", 1, 3),
    ]
