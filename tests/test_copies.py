"""Copies of folders among siblings, and candidates in them."""

import random

from codequarry.operators import copies

DAY = 86400
FILE = "path string, hash string, mtime long"


def plain(files, least):
    under = {}
    for path, h, t in files:
        parts = path.split("/")
        for i in range(1, len(parts)):
            under.setdefault("/".join(parts[:i]), {})["/".join(parts[i:])] = (h, t)
    out = []
    for a in under:
        for b in under:
            if a < b and a.rpartition("/")[0] == b.rpartition("/")[0]:
                same = sum(under[b].get(p, (None,))[0] == h for p, (h, _) in under[a].items())
                if same >= least and 2 * same >= min(len(under[a]), len(under[b])):
                    x, y = (max(t for _, t in under[d].values()) for d in (a, b))
                    out.append((a, b, same, a if x + DAY < y else b if y + DAY < x else None))
    return sorted(out, key=str)


def run(spark, files, least):
    return sorted((tuple(r) for r in copies.folder_copies(spark.createDataFrame(files, FILE), least).collect()), key=str)


def test_random_trees(spark):
    rng = random.Random(1)
    base = [f"{rng.choice(['src', 'src/a', 'lib'])}/f{i}" for i in range(14)]
    files = {}
    for root in ["x", "y", "z", "w/x", "w/y", "w/x/deep"]:
        for p in base:
            if rng.random() < 0.8:
                files[f"{root}/{p}"] = (rng.choice(["same", "same", "same", root]) + p, rng.choice([0, DAY // 2, 3 * DAY]) if root != "y" else 9 * DAY)
        files[f"{root}/LICENSE"] = ("license", 0)
    rows = [(p, h, t) for p, (h, t) in files.items()] + [("top", "h", 1)]
    want = plain(rows, 4)
    assert run(spark, rows, 4) == want and {w[3] for w in want} >= {None, "x"}


def test_what_all_folders_hold_pairs_none_of_them(spark):
    rows = [(f"m{k}/{name}", name if name.startswith("common") else f"{name}{k}", 0) for k in range(60) for name in [*(f"common{i}" for i in range(19)), *(f"own{i}" for i in range(5))]]
    assert run(spark, rows, 20) == []
    assert run(spark, [], 20) == []


def test_stale_candidates_give_way(spark):
    files = [(f"{root}/src/c{i}.ts", f"h{i}" if i != 7 else f"h7{root}", 0 if root == "Back" else 30 * DAY) for root in ("Back", "Back2") for i in range(24)]
    df = spark.createDataFrame(files, FILE)
    found = copies.folder_copies(df)
    # below the copies the folders src are copies of nothing: their parents differ
    assert [tuple(r) for r in found.collect()] == [("Back", "Back2", 23, "Back")]
    scores = [(1, "Back/src/c3.ts", 5.0), (1, "Back2/src/c3.ts", 2.0), (1, "Back/src/c7.ts", 4.0), (1, "Back2/src/c7.ts", 1.0), (1, "Back/src/c9.ts", 3.0), (1, "x.ts", 1.0), (2, "Back/src/c3.ts", 5.0), (2, "Back2/src/c3.ts", 1.0)]
    told = copies.demote_copies(spark.createDataFrame(scores, "query_id int, path string, score double"), df, found)
    assert sorted((r["query_id"], r["path"], round(r["score"], 6)) for r in told.collect()) == [
        (1, "Back/src/c7.ts", 1.2), (1, "Back2/src/c3.ts", 5.0), (1, "Back2/src/c7.ts", 1.0), (1, "Back2/src/c9.ts", 3.0), (1, "x.ts", 1.0), (2, "Back/src/c3.ts", 5.0), (2, "Back2/src/c3.ts", 1.0)]


def test_no_window_over_a_folder_takes_all_its_files(spark, monkeypatch):
    """One folder above all files: its order is cut to the last least_same in each task first; dealt to many tasks and with repeated rows the result is the same."""
    seen, real = [], copies.Scratch.write
    monkeypatch.setattr(copies.Scratch, "write", lambda self, name, df: (seen.append(df._jdf.queryExecution().executedPlan().toString()), real(self, name, df))[1])
    rows = [(f"all/{d}/f{i}", f"h{i}", 0) for d in "abc" for i in range(30)] + [("all/a/f3", "h3", 0)] * 3
    want = run(spark, rows, 5)
    assert [w[:2] for w in want] == [("all/a", "all/b"), ("all/a", "all/c"), ("all/b", "all/c")]
    plans = "\n".join(seen)
    assert "WindowGroupLimit [dir" in plans and "windowspecdefinition(dir" not in plans.replace("row_number() windowspecdefinition(dir", "")
    monkeypatch.setattr(copies, "ROWS_A_TASK", 7)
    assert run(spark, rows, 5) == want
    assert run(spark, rows[:90], 30) == [(a, b, 30, s) for a, b, _, s in want]
