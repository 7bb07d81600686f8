"""What ties a referring file to a changed definition, and which findings a change leaves."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from codequarry.operators import findings

#: changed path, lang, kind, container, referring path, its text, whether they are tied
LINKS = [
    ("src/store.py", "python", "function", None, "app/a.py", "import store\nload_it()", True),
    ("src/store.py", "python", "function", None, "app/b.py", "storehouse.load_it()", False),
    ("src/store.py", "python", "function", None, "app/c.py", "from x import (a,\n  load_it)", True),
    ("src/store.py", "python", "function", None, "app/d.py", "from x import load_it2\nload_it()", False),
    ("src/store.py", "python", "function", None, "app/e.py", "import src\nsrc.load_it()", True),
    ("src/store.py", "python", "function", None, "app/f.py", "other.load_it()", False),
    ("src/store.py", "python", "method", "Box", "app/g.py", "b = Box()\nb.load_it()", True),
    ("src/store.py", "python", "method", "Box", "app/h.py", "b = Boxes()\nb.load_it()", False),
    ("src/store.py", "python", "class", None, "app/i.py", "load_it()", True),
    ("src/store.py", "python", "function", None, "app/j.py", None, True),
    ("web/cart/index.ts", "typescript", "function", None, "web/a.ts", "import { load_it } from './x'", True),
    ("web/cart/index.ts", "typescript", "function", None, "web/b.ts", "import { load_it } from 'lodash'", False),
    ("web/cart/index.ts", "typescript", "function", None, "web/c.ts", "const { load_it } = require('@/y')", True),
    ("web/cart/index.ts", "typescript", "function", None, "web/d.ts", "cart$.load_it()", False),
    ("web/cart/index.ts", "typescript", "function", None, "web/e.ts", "cart.load_it()", True),
    ("a/Store.java", "java", "method", None, "b/A.java", "import static x.Y.load_it;", True),
    ("a/Store.java", "java", "method", None, "b/B.java", "import x.load_it;", False),
    ("a/store.rs", "rust", "function", None, "b/a.rs", "use crate::{x, load_it};", True),
    ("a/store.rs", "rust", "function", None, "b/b.rs", "let y = super::z::load_it(1);", True),
    ("a/store.rs", "rust", "function", None, "b/c.rs", "load_it(1)", False),
    ("a/store.go", "go", "function", None, "a/b.go", "load_it()", True),
    ("a/store.go", "go", "function", None, "b/c.go", "load_it()", False),
    ("a/keep.go", "go", "function", None, "b/d.go", "pkgname.load_it()", True),
    ("a/store.c", "c", "function", None, "z/b.c", "load_it();", True),
    ("a/store.kt", "kotlin", "function", None, "z/a.kt", "load_it()", True),
    ("a/store.kt", "kotlin", "function", None, "z/b.kt", "package other\nload_it()", False),
    ("a/store.kt", "kotlin", "function", None, "z/c.kt", "package other\nimport m.n.load_it\n", True),
]
OWN = {"a/keep.go": "package pkgname\n"}


def test_links(spark):
    files, texts, changes, containers, candidates = {}, [], [], [], []
    for n, (path, lang, kind, container, ref, text, _) in enumerate(LINKS):
        for p in (path, ref):
            files.setdefault(p, (len(files), p, lang))
        changes.append((n, "load_it", kind, files[path][0]))
        candidates.append((n, files[ref][0]))
        texts.append((files[ref][0], text))
        containers += [(files[path][0], "load_it", container)] if container else []
    texts += [(files[p][0], OWN.get(p, "")) for p in {x[0] for x in LINKS}]
    # containers belong to a file's name, so only changes of the methods are held against them
    found = set()
    for held in (True, False):
        ids = [n for n, x in enumerate(LINKS) if (x[3] is not None) == held]
        pick = lambda rows, ids=ids: [r for r in rows if r[0] in ids]
        tied = findings.linked(
            spark.createDataFrame(pick(candidates), "change_id int, ref_file int"), spark.createDataFrame(pick(changes), "change_id int, name string, kind string, file_id int"),
            spark.createDataFrame(containers if held else [], "file_id int, name string, container string"), spark.createDataFrame(list(files.values()), "file_id int, path string, lang string"), spark.createDataFrame(texts, "file_id int, text string"),
        )
        found |= {r["change_id"] for r in tied.collect()}
    wrong = [x for n, x in enumerate(LINKS) if (n in found) != x[6]]
    assert not wrong


@pytest.mark.parametrize(("lang", "signature", "is_hidden", "by_framework"), [
    ("java", "private int load_it(int a)", True, False), ("java", "@Private int load_it(int a)", False, False), ("java", "public void load_it(private_t x)", False, False), ("python", "private load_it", False, False),
    ("typescript", "private async load_it()", True, False), ("java", '@GetMapping("/x") public void load_it()', False, True), ("csharp", "[HttpPost] public void load_it()", False, True), ("python", "@app.post('/x') def load_it()", False, True),
    ("rust", "#[tauri::command] fn load_it()", False, True), ("java", "@Cacheable void load_it()", False, False), ("java", "@KafkaListener(1) void load_it()", False, True),
])
def test_signatures_that_names_do_not_reach(spark, lang, signature, is_hidden, by_framework):
    row = spark.createDataFrame([(lang, "load_it", signature)], "lang string, name string, signature string").select(findings.hidden(F.col("lang"), F.col("name"), F.col("signature")), findings.called_by_framework(F.col("signature"))).first()
    assert tuple(row) == (is_hidden, by_framework)


def test_findings_of_a_change(spark):
    files = [(1, "src/lib.py", "python"), (2, "src/use.py", "python"), (3, "tests/test_use.py", "python"), (4, "src/lib.ts", "typescript"), (5, "src/own.py", "python"), (6, "src/seen.py", "python"), (7, "src/edited.py", "python")]
    symbols = [("load_it", 1), ("stays_here", 1), ("resize_it", 1), ("load_it", 5), ("twice_told", 1), ("twice_told", 2)]
    changes = [(1, "removed", "load_it", "function", "def load_it(a)", 1, "read_it"), (2, "removed", "stays_here", "function", "", 1, None), (3, "signature", "resize_it", "function", "def resize_it(a)", 1, None), (4, "body", "load_it", "function", "", 1, None), (5, "removed", "get", "function", "", 1, None), (6, "removed", "twice_told", "function", "", 1, None)]
    refs = [(n, f, line, kind, "go") for n, f, line, kind in [("load_it", 2, 9, "call"), ("load_it", 2, 4, "type"), ("load_it", 3, 1, "call"), ("load_it", 4, 1, "call"), ("load_it", 5, 1, "call"), ("load_it", 7, 1, "call"), ("resize_it", 2, 5, "type"), ("resize_it", 3, 5, "call"), ("resize_it", 6, 5, "call"), ("stays_here", 2, 1, "call"), ("get", 2, 2, "call"), ("twice_told", 3, 2, "call")]]
    texts = [(f, "import lib") for f in range(1, 8)]
    df = spark.createDataFrame
    told = lambda ended, known=True: findings.collect(
        df(changes, "change_id int, change string, name string, kind string, signature string, file_id int, renamed_to string"), df(symbols, "name string, file_id int"), df(refs, "name string, file_id int, line int, kind string, enclosing string"),
        df(files, "file_id int, path string, lang string"), df(texts, "file_id int, text string"), df(ended, "file_id int, name string"), df([], "file_id int, name string, container string"), df([(7,), (5,)], "file_id int"), df([(6,)], "file_id int"), known,
    )
    short = lambda found: [(r["kind"], r["symbol"], r["path"], r["line"], r["refs_in_file"]) for r in findings.in_order(found).collect()]
    # the other definition of load_it stands in a touched file whose end isn't known, so it counts as left
    assert short(told([(1, "stays_here")])) == [("stale", "resize_it", "tests/test_use.py", 5, 1)]
    assert short(told([(1, "stays_here"), (5, "other")])) == [("dangling", "load_it", "src/use.py", 4, 2), ("dangling", "load_it", "tests/test_use.py", 1, 1), ("stale", "resize_it", "tests/test_use.py", 5, 1)]
    assert short(told([(1, "stays_here"), (5, "other")], known=False))[2:] == [("stale", "resize_it", "src/seen.py", 5, 1), ("stale", "resize_it", "tests/test_use.py", 5, 1)]


def test_all_references_of_a_name_count(spark):
    df, n = spark.createDataFrame, 600
    files = [(1, "src/lib.py", "python"), (2, "src/a.py", "python"), (3, "src/b.py", "python")]
    told = findings.collect(
        df([(1, "removed", "load_it", "class", "", 1, None)], "change_id int, change string, name string, kind string, signature string, file_id int, renamed_to string"), df([("load_it", 1)], "name string, file_id int"),
        df([("load_it", f, line, "call", "go") for f in (2, 3) for line in range(n)], "name string, file_id int, line int, kind string, enclosing string"), df(files, "file_id int, path string, lang string"),
        df([(f, "") for f, *_ in files], "file_id int, text string"), df([(1, "other")], "file_id int, name string"), df([], "file_id int, name string, container string"), df([], "file_id int"), df([], "file_id int"),
    )
    assert [(r["path"], r["refs_in_file"]) for r in told.orderBy("path").collect()] == [("src/a.py", n), ("src/b.py", n)]


def _most_joined(plan) -> int:
    """The most rows that a join of an executed plan made."""
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return _most_joined(plan.executedPlan())
    if plan.getClass().getSimpleName().endswith("QueryStageExec"):
        return _most_joined(plan.plan())
    own = plan.metrics().get("numOutputRows").get().value() if "Join" in plan.getClass().getSimpleName() and plan.metrics().contains("numOutputRows") else 0
    below = plan.children()
    return max([own, *(_most_joined(below.apply(i)) for i in range(below.size()))])


def test_a_word_of_all_changes_and_files_pairs_nobody(spark):
    df, n = spark.createDataFrame, 300
    files = [(i, f"src/m{i}.py", "python") for i in range(2 * n)]
    tied = findings.linked(
        df([(i, n + i) for i in range(n)], "change_id int, ref_file int"), df([(i, f"load_it{i}", "method", i) for i in range(n)], "change_id int, name string, kind string, file_id int"),
        df([(i, f"load_it{i}", "Box") for i in range(n)], "file_id int, name string, container string"), df(files, "file_id int, path string, lang string"), df([(i, "Box" if i % 2 else "Bag") for i, *_ in files], "file_id int, text string"),
    )
    rows = tied.collect()
    assert sorted(r["change_id"] for r in rows) == [i for i in range(n) if (n + i) % 2]
    assert _most_joined(tied._jdf.queryExecution().executedPlan()) <= 6 * n
