import hashlib
import random
import re
import zlib
from itertools import product

import duckdb
import pytest

from codequarry.llm import repair
from codequarry.llm.queries import ORACLE, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
PATTERN = re.compile(r"(s?(ua)+)?")


def damaged(rows: list[tuple]) -> list[tuple]:
    out = []
    for conv, turn, role, text in rows:
        fold = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fold, text)
        out += [(conv, turn, "user" if fold == 4 else role, text)] * {0: 0, 3: 2}.get(fold, 1)
    return out


def faults(rows: list[tuple]) -> list[int]:
    """0 none, 1 blank, 2 duplicate, 3 truncated."""
    out, seen = [], set()
    for _, _, role, text in rows:
        end = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append(1 if not end else 2 if (role, text) in seen else 3 * (end[-1] not in ".!?"))
        seen.add((role, text))
    return out


def options(row: tuple, fault: int) -> list[tuple[str, int, list[tuple]]]:
    """(initial, cost, turns left) of each edit of one turn."""
    found = [("D", 3, [])]
    if fault not in (1, 2):
        found += [("K", fault == 3, [row[2:]])] + [("R", 2 + (fault == 3), [(role, row[3])]) for role in ("user", "assistant")]
    return found


def tried(rows: list[tuple]) -> tuple[int, str, list[tuple]]:
    """The best of all edits of a few turns, with up to two inserts between any."""
    runs = [list(x) for n in range(3) for x in product([("user", ""), ("assistant", "")], repeat=n)]
    best = None
    for edits in product(*(options(r, f) for r, f in zip(rows, faults(rows), strict=True))):
        for gaps in product(runs, repeat=len(rows) + 1):
            left, audit = list(gaps[0]), "I" * len(gaps[0])
            for (code, _, turns), gap in zip(edits, gaps[1:], strict=True):
                left, audit = left + turns + gap, audit + code + "I" * len(gap)
            if PATTERN.fullmatch("".join(r[:1] or "-" for r, _ in left)):
                found = (sum(c for _, c, _ in edits) + 2 * sum(map(len, gaps)), audit, left)
                best = min(best or found, found)
    return best


def solved(rows: list[tuple]) -> tuple[int, str, list[tuple]]:
    """With whole strings for each state: a prefix of the roles that the pattern can still go on from."""
    further = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    states = {"": (0, "", [])}

    def spread(states):
        for _ in range(3):
            for state, (cost, audit, left) in list(states.items()):
                for role in ("user", "assistant"):
                    if to := further.get((state, role[0])):
                        found = (cost + 2, audit + "I", [*left, (role, "")])
                        states[to] = min(states.get(to, found), found)
        return states

    for row, fault in zip(rows, faults(rows), strict=True):
        after = {}
        for state, (cost, audit, left) in spread(states).items():
            for code, more, turns in options(row, fault):
                to = state if not turns else further.get((state, turns[0][0][:1]))
                if to is not None:
                    found = (cost + more, audit + code, left + turns)
                    after[to] = min(after.get(to, found), found)
        states = after
    return min(v for s, v in spread(states).items() if s in ("", "a"))


def plain(rows: list[tuple], harmed: list[tuple], solve=solved) -> list[tuple]:
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in harmed if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        turns = {r[1] for r in own} - {None}
        kinds = faults(own)
        cost, audit, left = solve(own)
        initials = [r[2][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, kinds.count(1), kinds.count(2), kinds.count(3), illegal, cost, audit, digest))
    return sorted(out, key=str)


def run(spark, rows, harm=False):
    convs = spark.createDataFrame(rows, SCHEMA)
    turns = repair.damage(convs) if harm else convs.coalesce(1)
    return sorted((tuple(r) for r in repair.digest(repair.repair(turns), convs).collect()), key=str)


def conversation(rng: random.Random, conv, n: int) -> list[tuple]:
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", "Ux", " ", "a"]
    texts = ["Yes.", "no", "No!\n", "", " \t", "x? y", "end .\x0b", "Ünï", "a\x1c"]
    return [(conv, t, rng.choice(roles), rng.choice(texts)) for t in sorted(rng.choices(range(3 * n), k=n))]


def test_all_edits_of_short_conversations():
    rng = random.Random(1)
    layers = repair.Layers()
    for _ in range(120):
        rows = conversation(rng, 1, rng.randrange(1, 4))
        best = tried(rows)
        assert solved(rows) == best
        kinds = [4 * max(0, ["", "s", "u", "a"].index(r[2][:1]) if r[2][:1] in ("", "s", "u", "a") else 0) + f for r, f in zip(rows, faults(rows), strict=True)]
        cuts = sorted(rng.choices(range(len(kinds) + 1), k=2))
        parts = [p for p in (kinds[: cuts[0]], kinds[cuts[0] : cuts[1]], kinds[cuts[1] :]) if p]
        ways = repair.chained([repair.summed(layers, p, (0, 1, 2, 3)) for p in parts])
        audit = "".join(code for p, (a, b) in zip(parts, ways, strict=True) for code, _ in repair.reconstructed(layers, p, a, b))
        assert audit + "I" * repair.TAIL[ways[-1][1]] == best[1]
    assert len({layer for layer, _ in layers.after}) < 400


@pytest.mark.parametrize("seed", [1, 2])
def test_random_conversations(spark, seed):
    rng = random.Random(seed)
    rows = [r for c in range(40) for r in conversation(rng, c, rng.choice([1, 2, 5, 9, 30]))]
    assert run(spark, rows) == plain(rows, rows)


def test_a_long_conversation_spans_tasks(spark):
    rng = random.Random(5)
    rows = [r for c in (1, 2, 3) for r in conversation(rng, c, 2000 if c == 2 else 20)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert run(spark, rows) == plain(rows, rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (1, None, "system", "S."), (1, 2, "user", None), (1, 2, "user", "Hi."), (1, 2, "user", "Hi."), (1, 9, None, "x"), (2, 1, "assistant", "y" * 200_000), (3, None, "user", "a.")]
    assert run(spark, rows) == plain(rows, [(c, t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in rows])


def test_damage(spark):
    rng = random.Random(3)
    rows = [r for c in [*range(60), None] for r in conversation(rng, c, 4)] + [(None, None, None, None)]
    found = sorted((tuple(r) for r in repair.damage(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert found == sorted(damaged(rows), key=str)
    gone = [(c, 0, "user", "Hi.") for c in range(300) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    assert run(spark, gone, harm=True) == sorted(((c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for c, *_ in gone), key=str)


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "And?"), (1, 2, "tool", "Well"), (1, 3, "tool", "")]
    edits = repair.repair(spark.createDataFrame(rows, SCHEMA).coalesce(1))
    left = repair.repaired(edits).orderBy("at", "place").select("role", "text").collect()
    assert [tuple(r) for r in left] == solved(rows)[2]
    assert PATTERN.fullmatch("".join(r["role"][:1] for r in left))


def test_empty_table_and_clashing_columns(spark):
    assert run(spark, []) == []
    convs = spark.createDataFrame([(1, 0, "user", "Hi.", 7, "x")], SCHEMA + ", at int, edit string")
    assert [r["audit"] for r in repair.digest(repair.repair(convs), convs).collect()] == ["KI"]


def test_whole_table_matches_plain_strings(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = QUERIES["op11_repair"](spark, sf_dir)
    assert [c for c, _ in found.dtypes] == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    expected = plain(rows, damaged(rows))
    assert sorted((tuple(r) for r in found.collect()), key=str) == expected
    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS FROM '{sf_dir}/conversations.parquet'")
    assert sorted(duckdb.sql(ORACLE["op11_repair"]).fetchall(), key=str) == expected
