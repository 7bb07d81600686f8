"""The second log format, plain and compressed, and the patch texts in it."""

from __future__ import annotations

import io
import json
import random

import pytest
import zstandard
from pyspark.sql import functions as F

from codequarry.functions import patches
from codequarry.sources import rollouts

REPO = "/work/repo"


def at(n: int, kind: str, payload) -> dict:
    return {"timestamp": f"2026-10-01T00:00:{n:02}.000Z", "type": kind, "payload": payload}


def meta(**more) -> dict:
    return at(0, "session_meta", {"id": "c", "cwd": REPO} | more)


def change(n: int, i: str, changes: dict, status: str = "completed") -> dict:
    return at(n, "event_msg", {"type": "item_completed", "item": {"type": "FileChange", "id": i, "status": status, "changes": changes}})


def call(n: int, name: str, i: str, given: str, kind: str = "function_call") -> dict:
    return at(n, "response_item", {"type": kind, "name": name, "call_id": i, "input" if kind == "custom_tool_call" else "arguments": given})


def out(n: int, i: str, output) -> dict:
    return at(n, "response_item", {"type": "function_call_output", "call_id": i, "output": output})


def jsonl(lines) -> bytes:
    return b"".join(json.dumps(x).encode() + b"\n" for x in lines)


def entries(spark, lines):
    rows = [("c", "rollout-a.jsonl", True, n, json.dumps(x)) for n, x in enumerate(lines)]
    return rollouts.entries(spark.createDataFrame(rows, rollouts.LINES))


@pytest.mark.parametrize("seed", range(6))
def test_bounded_lines_of_any_chunks(seed):
    rng = random.Random(seed)
    lines = [rng.choice([b"", b" \t", b"x" * rng.randrange(1, 40), b"\xef\xbb\xbfabc", b"y" * 20, b"y" * 21]) for _ in range(60)]
    text = b"\n".join(lines) + rng.choice([b"", b"\n"])
    want = [None if len(x) > 20 else x.removeprefix(b"\xef\xbb\xbf") for x in lines if len(x) > 20 or x.strip()]
    assert list(rollouts.bounded_lines(io.BytesIO(text), 20, rng.randrange(1, 30))) == want


def test_long_lines_are_not_held():
    class Endless(io.RawIOBase):
        left = 64

        def read(self, n=-1):
            self.left -= 1
            return b"z" * (1 << 20) if self.left > 0 else b"\nend" if self.left == 0 else b""

    import tracemalloc

    tracemalloc.start()
    assert list(rollouts.bounded_lines(Endless())) == [None, b"end"]
    assert tracemalloc.get_traced_memory()[1] < 24 << 20
    tracemalloc.stop()


def test_files_frames_and_sessions(spark, tmp_path):
    pack = zstandard.ZstdCompressor().compress
    day = tmp_path / "2026" / "10"
    day.mkdir(parents=True)
    frames = pack(jsonl([meta(id="child", session_id="root")])) + pack(jsonl([{"type": "world_state", "n": 1}])) + pack(b"x" * (rollouts.MOST_LINE + 1) + b"\n" + b"y" * rollouts.MOST_LINE + b"\n")
    (day / "rollout-T2-child.jsonl.zst").write_bytes(frames)
    (day / "rollout-T1-root.jsonl.zst").write_bytes(pack(jsonl([meta(id="root", session_id="root")])))
    (day / "rollout-T3-solo.jsonl").write_bytes(jsonl([meta(id="solo")]))
    (day / "rollout-T3-solo.jsonl.zst").write_bytes(b"old")
    (day / "rollout-T4-none.jsonl").write_bytes(b"no json\n")
    (day / "other.jsonl").write_bytes(b"{}\n")
    whole = pack(jsonl([{"type": "world_state", "n": n, "s": str(n * 7919)} for n in range(3000)]))
    (day / "rollout-T5-cut.jsonl.zst").write_bytes(whole[: len(whole) // 2])
    (day / "rollout-T6-bad.jsonl.zst").write_bytes(b"not zstd at all")

    found = rollouts.read_lines(spark, str(tmp_path)).collect()
    by = {}
    for r in found:
        by.setdefault(r["file"].rsplit("/", 1)[-1], []).append(r)
    assert set(by) == {"rollout-T1-root.jsonl.zst", "rollout-T2-child.jsonl.zst", "rollout-T3-solo.jsonl", "rollout-T4-none.jsonl", "rollout-T5-cut.jsonl.zst"} - ({"rollout-T5-cut.jsonl.zst"} - set(by))
    child = sorted(by["rollout-T2-child.jsonl.zst"], key=lambda r: r["line_no"])
    assert [(r["session"], r["main"], r["line_no"], r["line"] is None) for r in child] == [("root", False, 1, False), ("root", False, 2, False), ("root", False, 3, True), ("root", False, 4, False)]
    assert [(r["session"], r["main"]) for name in ("rollout-T1-root.jsonl.zst", "rollout-T3-solo.jsonl", "rollout-T4-none.jsonl") for r in by[name]] == [("root", True), ("solo", True), ("rollout-T4-none", True)]
    assert len(by.get("rollout-T5-cut.jsonl.zst", [])) < 3000

    binary = rollouts.read_binary(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path)))
    bare = lambda rows: sorted((r["session"], r["file"].rsplit("/", 1)[-1], r["main"], r["line_no"], r["line"]) for r in rows if r["line"])
    assert bare(binary.collect()) == bare(found)
    counted = {r["session"]: tuple(r)[1:] for r in rollouts.counts(rollouts.read_lines(spark, str(tmp_path))).collect()}
    assert counted["root"] == (3, 1, 1, False) and counted["rollout-T4-none"] == (0, 1, 0, True)


def test_no_files(spark, tmp_path):
    assert rollouts.read_lines(spark, str(tmp_path)).collect() == []


def test_edits_by_file_changes_and_patches(spark):
    patch = "*** Begin Patch\n*** Add File: src/new.rs\n+fn new() {}\n*** Update File: /work/repo/a.rs\n@@ fn a\n fn a() {\n-  old();\n+  new();\n }\n*** Delete File: gone.rs\n*** End Patch\n"
    es = entries(spark, [
        meta(), call(1, "apply_patch", "p1", patch, "custom_tool_call"), out(2, "p1", "Exit code: 0\nOutput:\n"), call(3, "apply_patch", "p2", "*** Begin Patch\n*** Add File: bad.rs\n+x\n*** End Patch"), out(4, "p2", "apply_patch verification failed"),
        call(5, "apply_patch", "p3", "*** Add File: none.rs\n+x"), call(6, "apply_patch", "p4", json.dumps({"input": "*** Add File: twice.rs\n+x"})), change(7, "p4", {"twice.rs": {"type": "add", "content": "told"}}), out(8, "p4", "Success. Updated"),
        change(9, "f", {"b.rs": {"type": "add", "content": "x"}}, "failed"), change(10, "m", {"/work/repo/old.rs": {"type": "update", "unified_diff": "@@ -1 +1 @@\n-a\n+b\n", "move_path": "../new.rs"}}),
        change(11, "u", {"z.rs": {"type": "update", "unified_diff": "@@ -2,2 +2,2 @@\n b\n-c\n+C\n"}, "y.rs": {"type": "delete"}}),
    ])
    found = [(r["line_no"], r["path"], r["ok"], r["before"], r["after"], r["hunks"] and [(h["old_start"], h["lines"]) for h in r["hunks"]]) for r in rollouts.edits(es).orderBy("line_no", "pos").collect()]
    assert found == [
        (1, "/work/repo/src/new.rs", True, "", "fn new() {}\n", None), (1, "/work/repo/a.rs", True, None, None, [(None, [" fn a() {", "-  old();", "+  new();", " }"])]), (1, "/work/repo/gone.rs", True, None, "", None),
        (7, "/work/repo/twice.rs", True, "", "told", None), (9, "/work/repo/b.rs", False, None, None, None), (10, "/work/repo/old.rs", True, None, "", None), (10, "/work/new.rs", True, None, None, None),
        (11, "/work/repo/y.rs", True, None, "", None), (11, "/work/repo/z.rs", True, None, None, [(2, [" b", "-c", "+C"])]),
    ]


def test_shell_calls(spark):
    es = entries(spark, [
        meta(), call(1, "shell_command", "a", json.dumps({"command": "cargo test -p x", "workdir": "sub"})), out(2, "a", "Exit code: 101\nOutput"), call(3, "shell_command", "b", json.dumps({"command": "ls"})), out(4, "b", "Exit code: 0\n"),
        call(5, "exec_command", "c", json.dumps({"cmd": "cd web && pytest -q", "workdir": "/elsewhere"})), call(6, "shell", "e", json.dumps({"command": ["bash", "-lc", "go test ./..."]})), out(7, "e", '{"output":"x","metadata":{"exit_code":0}}'),
        at(8, "response_item", {"type": "local_shell_call", "call_id": "l", "action": {"command": ["npm", "test"], "working_directory": "/w"}}), call(9, "other", "o", "{}"),
    ])
    found = [(r["id"], r["dir"], r["ok"]) for r in rollouts.shell_events(es).orderBy("line_no").collect()]
    assert found == [("a", "/work/repo/sub", False), ("b", REPO, True), ("c", "/elsewhere/web", None), ("e", REPO, True), ("l", "/w", None)]


def test_usage_and_prompts(spark):
    def tokens(n, i, c, o):
        return at(n, "event_msg", {"type": "token_count", "info": {"total_token_usage": {"input_tokens": i, "cached_input_tokens": c, "output_tokens": o}}})

    said = at(3, "event_msg", {"type": "item_completed", "item": {"type": "UserMessage", "content": [{"type": "text", "text": "do it"}]}})
    es = entries(spark, [meta(), at(1, "turn_context", {"cwd": REPO, "model": "m-x"}), said, tokens(4, 100, 40, 10), at(5, "event_msg", {"type": "token_count", "info": None}), tokens(6, 150, 60, 15), at(6, "event_msg", {"type": "user_message", "message": "more"}), tokens(8, 10, 0, 0)])
    assert [tuple(r)[3:] for r in rollouts.usage(es).orderBy("line_no").collect()] == [("m-x", 60, 10, 40, 0), ("m-x", 30, 5, 20, 0), ("m-x", 0, 0, 0, 0)]
    assert [r["text"] for r in rollouts.prompts(es).orderBy("line_no").collect()] == ["do it", "more"]


def test_hunks_of_a_diff(spark):
    text = "--- a\n+++ b\n@@ -0,0 +1,2 @@\n+x\n+y\n@@ -7 +9 @@ f\n-q\n@@ -bad\n"
    found = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(patches.unified_hunks(F.col("t")).alias("h")).collect()
    assert [[(h["old_start"], h["lines"]) for h in r["h"] or []] for r in found] == [[(1, ["+x", "+y"]), (7, ["-q"]), (0, [])], [], []]


def test_applied_hunks(spark):
    text = "a\nb\nc\nd\n"
    cases = [
        (text, [(2, [" b", "-c", "+C"])], "a\nb\nC\nd\n"), (text, [(99, [" b", "-c", "+C"])], "a\nb\nC\nd\n"), (text, [(None, ["-a", "+A"]), (None, ["-d", "+D", "+E"])], "A\nb\nc\nD\nE\n"), (text, [(1, ["-nope", "+x"])], None),
        ("a\r\nb\r\n", [(1, [" a", "-b", "+B", "\\ No newline at end of file"])], "a\r\nB\n"), ("", [(None, ["+x", "+y"])], "x\ny"), ("a\n", [(None, ["+x", "+y"])], "a\nx\ny\n"), ("", [(1, ["zzz"])], None), ("a\n", [(1, ["EOF"])], None), (None, [], None), ("q", [], "q"),
    ]
    df = spark.createDataFrame([(k, t, h) for k, (t, h, _) in enumerate(cases)], f"k int, t string, h {patches.HUNKS}")
    assert [r[0] for r in df.orderBy("k").select(patches.apply_hunks("t", "h")).collect()] == [w for *_, w in cases]


def test_applied_replacements(spark):
    big = "y" * (16 * 1024)
    cases = [("a a", "a", "b", False, "b a"), ("a a", "a", "b", True, "b b"), ("zzz", "a", "b", True, None), ("x\r\ny\r\n", "x\ny", "z", False, "z\n"), ("", "", "new", False, "new"), ("t", "", "new", False, None), ("x" * 1024, "x", big, True, None), ("x" * 1024, "x", "", True, ""), ("x" * 1024, "x", big, False, big + "x" * 1023)]
    df = spark.createDataFrame([(k, *c[:4]) for k, c in enumerate(cases)], "k int, t string, o string, n string, e boolean")
    assert [r[0] for r in df.orderBy("k").select(patches.apply_replace(F.col("t"), F.col("o"), F.col("n"), F.col("e"))).collect()] == [c[4] for c in cases]
