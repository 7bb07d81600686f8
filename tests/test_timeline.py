"""Nearest events and sums in time against plain searches, and the states of a small history."""

import random
import re

import pytest

from codequarry.operators import lookups, timeline, verification

POINT, EVENT = "key long, id string, at long, tie long", "id string, at long, tie long, value string"
DAY = 86400


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def placed(spark):
    rng = random.Random(1)
    events = [(rng.choice("ab"), rng.randrange(60) * 5, k, f"v{k}") for k in range(80)]
    points = [(k, rng.choice("abc"), rng.randrange(70) * 5, rng.choice([None, rng.randrange(80)])) for k in range(90)]
    return points, events, spark.createDataFrame(points, POINT), spark.createDataFrame(events, EVENT)


def plain(points, events, keep, pick):
    out = []
    for key, i, at, tie in points:
        found = [(e[1], e[2], e[3]) for e in events if e[0] == i and keep(e[1], e[2], at, tie)]
        out += [(key, *pick(found))] if found else []
    return sorted(out, key=str)


@pytest.mark.parametrize("seconds", [5, 20, 1000])
def test_nearest_events(placed, seconds):
    points, events, p, e = placed
    columns = ("key", "at", "tie", "value")
    assert rows(timeline.first_within(p, e, seconds), *columns) == plain(points, events, lambda t, k, at, tie: at <= t <= at + seconds, min)
    after = lambda t, k, at, tie: (t > at or (t == at and tie is not None and k > tie)) and t <= at + seconds
    assert rows(timeline.last_within(p, e, seconds), *columns) == plain(points, events, after, max)
    until = lambda t, k, at, tie: t < at or (t == at and (tie is None or k <= tie))
    assert rows(timeline.last_until(p, e, seconds), *columns) == plain(points, events, until, max)


@pytest.mark.parametrize("crowd", [0, 70])
@pytest.mark.parametrize("seconds", [5, 20, 1000])
def test_crowded_ids_are_cut_into_stretches(placed, seconds, crowd, monkeypatch):
    monkeypatch.setattr(timeline, "CROWD", crowd)
    test_nearest_events(placed, seconds)


def test_points_keep_their_columns_and_a_null_id_meets_nothing(spark):
    points = spark.createDataFrame([(1, "a", 5, None, "x"), (2, None, 5, None, "y"), (3, "a", 8, None, "z")], POINT + ", more string")
    events = spark.createDataFrame([("a", 6, 1, "v"), (None, 6, 2, "w")], EVENT)
    assert rows(timeline.nearest_within(points, events, 9).selectExpr("key", "more", "found.value"), "key", "more", "value") == [(1, "x", "v"), (3, "z", None)]
    assert rows(timeline.last_within(points, events, 9), "key", "value") == [(1, "v")]
    assert rows(timeline.last_until(points, events), "key", "value") == [(3, "v")]


def test_landings_bring_their_columns_without_a_join_by_key(spark):
    versions = spark.createDataFrame([("a", 100, 1, "x")], "file_id string, ct long, hash long, blob string")
    edits = spark.createDataFrame([(1, "a", 50, "r"), (2, None, 50, "s")], "key long, file_id string, last_edit long, ref_file string")
    found = verification.landings(edits, versions, verification.WINDOW, "ref_file")
    assert rows(found, "key", "ref_file", "hash", "committed") == [(1, "r", 1, True), (2, "s", None, False)]
    assert not re.search(r"Join \w+, \(key#", found._jdf.queryExecution().optimizedPlan().toString())


def test_sums(placed, spark):
    points, events, p, _ = placed
    changes = [(i, at, tie, tie % 3 - 1, 1) for i, at, tie, _ in events]
    df = spark.createDataFrame(changes, "id string, at long, tie long, x long, y long")
    want = []
    for key, i, at, tie in points:
        met = [c for c in changes if c[0] == i and (c[1] < at or (c[1] == at and (tie is None or c[2] <= tie)))]
        want.append((key, sum(c[3] for c in met), sum(c[4] for c in met)))
    assert rows(timeline.sums_until(p, df, "x", "y", seconds=40), "key", "x", "y") == sorted(want, key=str)


def test_landing_and_later_commits(spark):
    """A history of three commits: what lands within the window, at its end, and behind it."""
    window = verification.WINDOW
    versions = spark.createDataFrame([("a", 100, 1, "x"), ("a", 200, 2, "y"), ("b", 200, 2, "z"), ("a", 300, 3, None)], "file_id string, ct long, hash long, blob string")
    edits = [(1, "b", 150), (2, "b", 201), (3, "b", 200 - window), (4, "b", 200 - window - 1), (5, "a", 250), (6, "none", 1)]
    found = verification.landings(spark.createDataFrame(edits, "key long, file_id string, last_edit long"), versions).orderBy("key").collect()
    assert [(r["hash"], r["blob"], r["committed"]) for r in found] == [(2, "z", True), (None, "z", False), (2, "z", True), (None, "z", False), (3, None, True), (None, None, False)]
    contents = spark.createDataFrame([("x", "1"), ("y", "y" * (verification.MOST_BYTES + 1)), ("z", "")], "blob string, text string")
    wanted = spark.createDataFrame([(1, "a", 99, None), (2, "a", 100, 0), (3, "a", 100, 1), (4, "a", 250, None), (5, "a", 300, None), (6, "b", 999, None), (7, "c", 999, None)], "key long, file_id string, ct long, hash long")
    assert rows(verification.blobs_at(wanted, versions, contents), "key", "blob") == [(3, "x"), (6, "z")]
    commits, files = spark.createDataFrame([(1, 100), (2, 100), (3, 100 + window)], "hash long, ct long"), spark.createDataFrame([(1, "a"), (2, "a"), (3, "a")], "hash long, file_id string")
    edits = spark.createDataFrame([(1, "a", 100), (2, "a", 99), (3, "a", 101)], "key long, file_id string, ts long")
    assert rows(lookups.first_commit_within(edits, commits, files, window), "key", "hash") == [(1, 1), (2, 1), (3, 3)]
    assert rows(lookups.last_commit_within(edits, commits, files, window), "key", "hash") == [(1, 3), (2, 2), (3, 3)]


def test_outcomes(spark):
    """One finding of each outcome: a rename that landed, a fix in time, one that came later, a call that waits."""
    use = lambda name: f"def go():\n    return {name}(1)\n"
    texts = {"old": "def one(a):\n    pass\n", "new": "def two(a):\n    pass\n", "wide": "def one(a, b):\n    pass\n", "uses1": use("one"), "uses2": use("two"), "late": use("one") + "# later\n", "lines": use("one").replace("(1)", "(1, 2)")}
    contents = spark.createDataFrame([(k, "python", t) for k, t in texts.items()], "blob string, lang string, text string")
    versions = [("lib", 10, 1, "old"), ("lib", 1000, 2, "new"), ("wide", 10, 1, "old"), ("wide", 1000, 2, "wide")]
    versions += [("waits", 10, 1, "uses1"), ("fixed", 10, 1, "uses1"), ("fixed", 900, 9, "uses2"), ("later", 10, 1, "uses1"), ("later", 5000, 3, "lines"), ("moved", 10, 1, "uses1"), ("moved", 5000, 3, "late")]
    findings = [
        (1, "dangling", "one", "two", "lib", "new", "waits", "go", 500, 900), (2, "dangling", "one", "two", "lib", "new", "fixed", "go", 500, 900), (3, "dangling", "one", "three", "lib", "new", "waits", "go", 500, 900),
        (4, "dangling", "one", "two", "lib", None, "waits", "go", 500, 900), (5, "stale", "one", None, "wide", "wide", "later", "go", 500, 900), (6, "stale", "one", None, "wide", "old", "later", "go", 500, 900),
        (7, "stale", "one", None, "wide", "wide", "moved", None, 500, 900), (8, "dangling", "two", None, "wide", "wide", "uses", None, 500, 900),
    ]
    found = verification.verify(
        spark.createDataFrame(findings, "finding_id long, kind string, symbol string, renamed_to string, changed_file string, after string, ref_file string, caller string, first_edit long, last_edit long"),
        spark.createDataFrame(versions, "file_id string, ct long, hash long, blob string"), contents,
    )
    assert {r["finding_id"]: (r["outcome"], r["later_fixed"]) for r in found.collect()} == {
        1: ("already_resolved", False), 2: ("already_resolved", False), 3: ("not_landed", False), 4: ("unverified", False),
        5: ("kept", True), 6: ("not_landed", False), 7: ("kept", False), 8: ("already_resolved", False),
    }


def test_contents_of_any_size_are_read(spark):
    """A long content is told like a short one: a definition behind its first megabyte, and a call in it."""
    long = "# x\n" * (verification.MOST_BYTES // 4 + 1)
    texts = {"old": "def one(a):\n    pass\n", "wide": long + "def one(a, b):\n    pass\n", "uses": long + "def go():\n    return one(1)\n"}
    contents = spark.createDataFrame([(k, "python", t) for k, t in texts.items()], "blob string, lang string, text string")
    versions = spark.createDataFrame([("lib", 10, 1, "old"), ("lib", 1000, 2, "wide"), ("caller", 10, 1, "uses")], "file_id string, ct long, hash long, blob string")
    finding = [(1, "stale", "one", None, "lib", "wide", "caller", "go", 500, 900)]
    found = verification.verify(spark.createDataFrame(finding, "finding_id long, kind string, symbol string, renamed_to string, changed_file string, after string, ref_file string, caller string, first_edit long, last_edit long"), versions, contents)
    lines = verification.MOST_BYTES // 4 + 3
    assert [(r["outcome"], r["line"], r["n"], r["checked_at"]) for r in found.collect()] == [("kept", lines, 1, "2")]


def test_each_large_join_of_the_verification_ends_in_a_table(spark, monkeypatch):
    """Blobs travel as 16 bytes, and the last table joins what was written by then."""
    plans, write = {}, verification.Scratch.write

    def keep(self, name, df):
        plans[name] = (df._jdf.queryExecution().optimizedPlan().toString(), dict(df.dtypes))
        return write(self, name, df)

    monkeypatch.setattr(verification.Scratch, "write", keep)
    findings = spark.createDataFrame([(1, "stale", "one", None, "lib", "x", "caller", "go", 500, 900)], "finding_id long, kind string, symbol string, renamed_to string, changed_file string, after string, ref_file string, caller string, first_edit long, last_edit long")
    versions = spark.createDataFrame([("lib", 10, 1, "x")], "file_id string, ct long, hash long, blob string")
    verification.verify(findings, versions, spark.createDataFrame([("x", "python", "def one(a):\n    pass\n")], "blob string, lang string, text string"))
    assert plans["versions"][1]["blob"] == plans["facts"][1]["blob"] == "binary"
    assert plans["verified"][0].count("Join ") == 2 and {"told", "counts", "standing"} < plans.keys()
