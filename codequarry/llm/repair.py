"""Repair of a conversation's structure: the cheapest edits after which its roles are an optional system turn and then user and assistant by turns.

A dynamic programme over the turns keeps, for each state of the wanted pattern, the cheapest edits so far. The edits of a turn are one
macro: a run of inserted turns and what is done with the turn itself, `I...I` and then D, K or R. Such codes are prefix-free
and each layer has one of them a turn, so of two audit strings of a layer the smaller one is told by the ranks of their
prefixes and, where they share the prefix, by the code alone. So a layer holds costs, ranks and parent pointers and no
strings, and only finitely many layers exist: each is computed once for each kind of turn. Audits are read off the parents afterwards.

Turns are dealt out by ranges of (conversation, turn), so a conversation of any length spans tasks. Each of its segments is
summed up as costs and ranks from every state to every state, the segments are chained by those, and then each one is
reconstructed by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from codequarry.llm.common import Scratch

BLANKS = " \t\n\x0b\f\r"
#: What edits cost: an inserted turn, a new role, a deleted turn, and a truncated turn that stays.
INSERT, REROLE, DELETE, STAYS = 2, 2, 3, 1
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)

#: States of the pattern: nothing yet, after the system turn, after a user's, after an assistant's; and the state after one more turn.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
FURTHER = (USER, USER, ASSISTANT, USER)
NAMES = (None, "system", "user", "assistant")
#: Turns to insert at the end of a conversation until its pattern is whole.
TAIL = (0, 2, 1, 0)
KEPT = {"s": {EMPTY: SYSTEM}, "u": {EMPTY: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "": {}}

Layer = tuple[tuple[int, int] | None, ...]


def _macros(initial: str, fault: int) -> dict[tuple[int, int], tuple[int, str]]:
    """From each state to each state the cheapest macro of a turn, of equal ones the least code: (cost, code). More than two inserts only go round."""
    out: dict[tuple[int, int], tuple[int, str]] = {}
    for start in STATES:
        state = start
        for inserts in range(3):
            ends = [(state, DELETE, "D")]
            if fault not in (BLANK, DUPLICATE):
                stays = STAYS * (fault == TRUNCATED)
                ends += [(FURTHER[state], REROLE + stays, "R")]
                ends += [(KEPT[initial][state], stays, "K")] if state in KEPT[initial] else []
            for end, cost, code in ends:
                found = (cost + INSERT * inserts, "I" * inserts + code)
                out[start, end] = min(out.get((start, end), found), found)
            state = FURTHER[state]
    return out


#: A kind of turn is 4 * its initial's place here, plus its fault.
INITIALS = ("", "s", "u", "a")
MACROS = [_macros(initial, fault) for initial in INITIALS for fault in range(4)]


class Layers:
    """Layers reached so far and their successors by kind of turn. A layer has, for each state, (cost over the layer's least, rank of its audit) or None."""

    def __init__(self):
        self.after: dict[tuple[Layer, int], tuple[Layer, int, tuple]] = {}

    def step(self, layer: Layer, kind: int) -> tuple[Layer, int, tuple]:
        """(next layer, growth of the least cost, parent (state, code) of each state)."""
        found = self.after.get((layer, kind))
        if found is None:
            best: dict[int, tuple[int, int, str, int]] = {}
            for (start, end), (cost, code) in MACROS[kind].items():
                if layer[start] is not None:
                    entry = (layer[start][0] + cost, layer[start][1], code, start)
                    best[end] = min(best.get(end, entry), entry)
            found = self.after[layer, kind] = _ranked(best)
        return found


def _ranked(best: dict[int, tuple]) -> tuple[Layer, int, tuple]:
    """Of (cost, rank of the prefix, what follows it, start) by state: the layer, its least cost, and the parents."""
    least = min(entry[0] for entry in best.values())
    order = {end: k for k, end in enumerate(sorted(best, key=lambda end: best[end][1:3]))}
    layer = tuple((best[s][0] - least, order[s]) if s in best else None for s in STATES)
    return layer, least, tuple((best[s][3], best[s][2]) if s in best else None for s in STATES)


def alone(state: int) -> Layer:
    return tuple((0, 0) if s == state else None for s in STATES)


def summed(layers: Layers, kinds: list[int], starts: tuple[int, ...]) -> list[int | None]:
    """(cost, rank) of the cheapest edits from each state to each state, flat; None where there are none, or a start isn't asked."""
    out: list[int | None] = [None] * 32
    for start in starts:
        layer, whole = alone(start), 0
        for kind in kinds:
            layer, more, _ = layers.step(layer, kind)
            whole += more
        for end, entry in enumerate(layer):
            if entry is not None:
                out[8 * start + 2 * end : 8 * start + 2 * end + 2] = [whole + entry[0], entry[1]]
    return out


def chained(sums: list[list[int | None]]) -> list[tuple[int, int]]:
    """The (start, end) of each segment of a conversation, by the sums of its segments."""
    layer, parents = alone(EMPTY), []
    for flat in sums:
        best: dict[int, tuple] = {}
        for start, entry in enumerate(layer):
            for end in STATES if entry is not None else ():
                cost, rank = flat[8 * start + 2 * end : 8 * start + 2 * end + 2]
                if cost is not None:
                    found = (entry[0] + cost, entry[1], rank, start)
                    best[end] = min(best.get(end, found), found)
        layer, _, back = _ranked(best)
        parents.append(back)
    end = min((s for s in STATES if layer[s] is not None), key=lambda s: (layer[s][0] + INSERT * TAIL[s], layer[s][1]))
    out = []
    for back in reversed(parents):
        start = back[end][0]
        out.append((start, end))
        end = start
    return out[::-1]


def reconstructed(layers: Layers, kinds: list[int], start: int, end: int) -> list[tuple[str, int]]:
    """The code of each turn's macro, and the state before it, on the cheapest way from start to end."""
    layer, parents = alone(start), []
    for kind in kinds:
        layer, _, back = layers.step(layer, kind)
        parents.append(back)
    out = []
    for back in reversed(parents):
        end, code = back[end]
        out.append((code, end))
    return out[::-1]


def inserted(state: int, n: int) -> tuple[list[str], int]:
    """The roles of n inserted turns, and the state after them."""
    roles = []
    for _ in range(n):
        state = FURTHER[state]
        roles.append(NAMES[state])
    return roles, state


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[list[pa.RecordBatch], bool]]:
    """Runs of equal keys of sorted batches, each as a list of slices; whether it is the first run."""
    held, last, first = [], None, True
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        rows = list(zip(*columns, strict=True))
        cuts = [0, *(i + 1 for i, (a, b) in enumerate(pairwise(rows)) if a != b), len(rows)]
        for a, b in pairwise(cuts):
            if held and rows[a] != last:
                yield held, first
                held, first = [], False
            held.append(batch.slice(a, b - a))
            last = rows[a]
    if held:
        yield held, first


def _listed(run: list[pa.RecordBatch], column: str) -> list:
    return [x for part in run for x in part.column(column).to_pylist()]


def _segments(schema: pa.Schema):
    """Rows as they are, and behind each segment a row of its sums (kind -1). Only a partition's first segment may go on from an earlier one."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layers = Layers()
        for run, first in _runs(batches, ["conv_id"]):
            sums = summed(layers, _listed(run, "kind"), tuple(STATES) if first else (EMPTY,))
            one = {"conv_id": run[0].column("conv_id")[:1], "seg": run[0].column("seg")[:1], "kind": pa.array([-1], pa.int32()), "sums": pa.array([sums], schema.field("sums").type)}
            for part in run:
                yield pa.record_batch([part.column(f.name).cast(f.type) if f.name in part.schema.names else pa.nulls(part.num_rows, f.type) for f in schema], schema=schema)
            yield pa.record_batch([one[f.name].cast(f.type) if f.name in one else pa.nulls(1, f.type) for f in schema], schema=schema)

    return told


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for run, _ in _runs(batches, ["conv_id"]):
        ways = chained(_listed(run, "sums"))
        n = len(ways)
        conv = pa.concat_arrays([part.column("conv_id") for part in run])
        columns = [conv, pa.array(_listed(run, "seg"), pa.int32()), pa.array([a for a, _ in ways], pa.int32()), pa.array([b for _, b in ways], pa.int32()), pa.array([k == n - 1 for k in range(n)])]
        yield pa.record_batch(columns, names=["conv_id", "seg", "start", "end", "last"])


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    layers = Layers()
    roles = pa.list_(pa.string())
    for run, _ in _runs(batches, ["conv_id", "seg"]):
        start, end, last = (run[0].column(c)[0].as_py() for c in ("start", "end", "last"))
        way = reconstructed(layers, _listed(run, "kind"), start, end)
        before, edit, role = [], [], []
        for code, state in way:
            names, state = inserted(state, len(code) - 1)
            before.append(names)
            edit.append(code[-1])
            role.append(NAMES[FURTHER[state]] if code[-1] == "R" else None)
        after = [[]] * (len(way) - 1) + [inserted(end, TAIL[end])[0] if last else []]
        faults = [kind % 4 for kind in _listed(run, "kind")]
        columns = [pa.array(_listed(run, "at"), pa.int64()), pa.array(faults, pa.int32()), pa.array(before, roles), pa.array(edit, pa.string()), pa.array(role, pa.string()), pa.array(after, roles)]
        yield pa.record_batch(columns, names=["at", "fault", "before", "edit", "new_role", "after"])


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with planted faults, by crc32 of `conv_id:turn` modulo 20; nulls, of an id in that text too, are one space.

    0 drops the row, 1 empties its text, 2 takes its `.`, `!` and `?` out, 3 repeats it, 4 makes it the user's.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    told = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(key) % 20).alias("fold")).where("fold <> 0")
    text = F.when(F.col("fold") == 1, "").when(F.col("fold") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fold") == 4, "user").otherwise(F.col("role"))
    told = told.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("fold") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))).alias("copies"))
    return told.withColumn("copy", F.explode("copies")).select("conv_id", "turn", "role", "text")


def repair(turns: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The turns (conv_id, turn, role, text) with the cheapest edits that mend their conversation, as a table in the shared folder.

    at (a place in the order, by turn with nulls first and then as given), initial, fault (0 none, 1 blank, 2 duplicate, 3 truncated),
    before (roles of the empty turns to insert), edit (K, R or D), new_role (of R), after (roles to insert behind a
    conversation's last turn). A null role or text is one space, and a null conv_id a conversation of its own; rows that
    repeat an earlier role and text of their conversation are duplicates; other columns aren't read; an empty table has no rows.
    Texts are written once and meet their edits at the end; ranks, faults and edits move without them, so a very long text
    or conversation takes no task's memory.
    """
    scratch = scratch or Scratch(turns.sparkSession)
    given = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = scratch.write("turns", given.withColumn("at", F.monotonically_increasing_id()))

    end = F.rtrim("text", F.lit(BLANKS))
    conv = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n"))
    same = F.unhex(F.sha2(F.concat_ws(":", F.length(conv).cast("string"), F.length("role").cast("string"), conv, F.col("role"), F.col("text")), 256))
    narrow = rows.select("conv_id", "turn", "at", F.substring("role", 1, 1).alias("initial"), (F.length(end) == 0).alias("blank"), (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("cut"), same.alias("same"))
    firsts = narrow.groupBy("same").agg(F.min(F.struct("turn", "at")).alias("first"))
    fault = F.when(F.col("blank"), BLANK).when(F.col("first.at") != F.col("at"), DUPLICATE).when(F.col("cut"), TRUNCATED).otherwise(NONE)
    kind = 4 * F.greatest(F.array_position(F.array(*map(F.lit, INITIALS)), F.col("initial")) - 1, F.lit(0)) + F.col("fault")
    told = narrow.join(firsts, "same").withColumn("fault", fault).select("conv_id", "turn", "at", kind.cast("int").alias("kind"))

    placed = told.repartitionByRange(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "at").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "at")
    placed = placed.withColumn("seg", F.spark_partition_id())
    id_type, turn_type = (dict(rows.dtypes)[c] for c in ("conv_id", "turn"))
    wanted = turns.sparkSession.createDataFrame([], f"conv_id {id_type}, seg int, turn {turn_type}, at long, kind int, sums array<int>").schema
    layered = scratch.write("layers", placed.mapInArrow(_segments(to_arrow_schema(wanted)), wanted))
    sums = layered.where("kind < 0").select("conv_id", "seg", "sums")
    chains = sums.repartition("conv_id").sortWithinPartitions("conv_id", "seg").mapInArrow(_chains, f"conv_id {id_type}, seg int, start int, end int, last boolean")
    chains = chains.select(F.col("conv_id").alias("of"), F.col("seg").alias("part"), "start", "end", "last")
    known = layered.where("kind >= 0").select("conv_id", "seg", "turn", "at", "kind").join(chains, (F.col("seg") == F.col("part")) & F.col("conv_id").eqNullSafe(F.col("of")))
    known = known.repartition("conv_id", "seg").sortWithinPartitions("conv_id", "seg", F.asc_nulls_first("turn"), "at")
    edits = known.select("conv_id", "seg", "at", "kind", "start", "end", "last").mapInArrow(_edits, "at long, fault int, before array<string>, edit string, new_role string, after array<string>")
    out = scratch.write("edits", rows.join(edits, "at").select("conv_id", "turn", "at", "role", "text", "fault", "before", "edit", "new_role", "after"))
    scratch.keep_only("edits")
    return out


def repaired(edits: DataFrame) -> DataFrame:
    """The turns that edits (of repair) leave and insert: conv_id, at, place (among those of one at), role, text."""
    kind = "array<struct<role: string, text: string>>"
    empty = lambda roles: F.transform(roles, lambda r: F.struct(r.alias("role"), F.lit("").alias("text"))).cast(kind)
    own = F.when(F.col("edit") == "D", F.array().cast(kind)).otherwise(F.array(F.struct(F.coalesce("new_role", "role").alias("role"), F.col("text").alias("text"))).cast(kind))
    return edits.select("conv_id", "at", F.posexplode(F.concat(empty("before"), own, empty("after"))).alias("place", "turn")).select("conv_id", "at", "place", "turn.role", "turn.text")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation, from its rows in order; of those only the audit is held."""
    told = {"conv_id": [], **{c: [] for c in _COUNTS}, "audit": [], "repaired_sha256": []}
    kind, one = None, None
    for batch in batches:
        kind = batch.column("conv_id").type
        for row in batch.to_pylist():
            if one is None or row["conv_id"] != one["conv_id"]:
                if one is not None:
                    _close(one, told)
                one = {"conv_id": row["conv_id"], **dict.fromkeys(_COUNTS, 0), "turns": [None, None, 0], "audit": [], "sha": hashlib.sha256(), "any": False, "last": None}
            _count(one, row)
        if len(told["conv_id"]) > 1000:
            yield _batch(told, kind)
            told = {c: [] for c in told}
    if one is not None:
        _close(one, told)
        yield _batch(told, kind)


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _count(one: dict, row: dict) -> None:
    turn, fault = row["turn"], row["fault"]
    if turn is not None and turn != one["turns"][1]:
        one["turns"] = [turn if one["turns"][0] is None else one["turns"][0], turn, one["turns"][2] + 1]
    if fault:
        one[("blank", "duplicate", "truncated")[fault - 1]] += 1
    initial = row["role"][:1]
    one["illegal"] += one["last"] is not None and one["last"] + initial not in ("su", "ua", "au")
    one["last"] = initial
    edit = row["edit"]
    one["cost"] += INSERT * (len(row["before"]) + len(row["after"])) + {"K": 0, "R": REROLE, "D": DELETE}[edit] + STAYS * (edit != "D" and fault == TRUNCATED)
    one["audit"].append("I" * len(row["before"]) + edit + "I" * len(row["after"]))
    left = [(r, "") for r in row["before"]] + ([] if edit == "D" else [(row["new_role"] or row["role"], row["text"])]) + [(r, "") for r in row["after"]]
    for role, text in left:
        one["sha"].update(("\n" * one["any"] + role + ":").encode("utf-8", "surrogatepass"))
        one["sha"].update(text.encode("utf-8", "surrogatepass"))
        one["any"] = True


def _close(one: dict, told: dict[str, list]) -> None:
    first, last, n = one["turns"]
    one["gaps"] = last - first + 1 - n if n else 0
    one |= {"audit": "".join(one["audit"]), "repaired_sha256": one["sha"].hexdigest()}
    for c, values in told.items():
        values.append(one[c])


def _batch(told: dict[str, list], kind: pa.DataType) -> pa.RecordBatch:
    kinds = {"conv_id": kind, "audit": pa.string(), "repaired_sha256": pa.string()}
    return pa.record_batch([pa.array(v, kinds.get(c, pa.int64())) for c, v in told.items()], names=list(told))


def digest(edits: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row for each conv_id of conversations: its faults, the cost and audit of its edits, and a hash of what they leave.

    A hash of a whole conversation takes its texts one after the other: they stream in order through one task, which holds
    none of them. A conversation without rows in edits has zeros, an empty audit and the hash of the empty string.
    """
    id_type = dict(edits.dtypes)["conv_id"]
    rows = edits.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "at")
    schema = f"conv_id {id_type}, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string"
    found = rows.mapInArrow(_digests, schema).withColumnRenamed("conv_id", "of")
    all_ids = conversations.select("conv_id").distinct()
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _COUNTS]
    return all_ids.join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left").select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


#: The checksum bit by bit, and the programme with whole strings for each state: a recursion over a conversation's turns.
ORACLE = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS step FROM range(256) r(i)),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS bytes FROM conversations),
folded AS (SELECT keyed.*, xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], bytes), lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1]))) % 20 AS fold FROM keyed, crc),
harmed AS (SELECT conv_id, turn, copy, CASE WHEN fold = 4 THEN 'user' ELSE role END AS role, CASE fold WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM folded, (VALUES (1), (2)) c(copy) WHERE fold <> 0 AND (copy = 1 OR fold = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed FROM harmed),
turns AS (SELECT conv_id, turn, i, role, text, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS earlier,
  CASE WHEN trimmed = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM placed),
ins(s, t, cost, code, told) AS (VALUES (0, 0, 0, '', ''), (0, 2, 2, 'I', chr(10) || 'user:'), (0, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 1, 0, '', ''), (1, 2, 2, 'I', chr(10) || 'user:'), (1, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
  (2, 2, 0, '', ''), (2, 3, 2, 'I', chr(10) || 'assistant:'), (2, 2, 4, 'II', chr(10) || 'assistant:' || chr(10) || 'user:'), (3, 3, 0, '', ''), (3, 2, 2, 'I', chr(10) || 'user:'), (3, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
ops(s, t, cost, code, initial, new_role) AS (VALUES (0, 0, 3, 'D', NULL, NULL), (1, 1, 3, 'D', NULL, NULL), (2, 2, 3, 'D', NULL, NULL), (3, 3, 3, 'D', NULL, NULL), (0, 1, 0, 'K', 's', NULL), (0, 2, 0, 'K', 'u', NULL), (1, 2, 0, 'K', 'u', NULL), (3, 2, 0, 'K', 'u', NULL), (2, 3, 0, 'K', 'a', NULL),
  (0, 2, 2, 'R', NULL, 'user'), (1, 2, 2, 'R', NULL, 'user'), (3, 2, 2, 'R', NULL, 'user'), (2, 3, 2, 'R', NULL, 'assistant')),
way AS (
  SELECT DISTINCT coalesce(CAST(conv_id AS VARCHAR), '') AS conv, CAST(0 AS BIGINT) AS i, 0 AS state, {'cost': CAST(0 AS BIGINT), 'audit': '', 'told': ''} AS best FROM conversations
  UNION ALL
  SELECT conv, w.i + 1, o.t, min({'cost': CAST(best.cost + n.cost + o.cost + CASE WHEN o.code <> 'D' AND r.fault = 3 THEN 1 ELSE 0 END AS BIGINT), 'audit': best.audit || n.code || o.code,
    'told': best.told || n.told || CASE WHEN o.code = 'D' THEN '' ELSE chr(10) || coalesce(o.new_role, r.role) || ':' || r.text END})
  FROM way w JOIN turns r ON coalesce(CAST(r.conv_id AS VARCHAR), '') = w.conv AND r.i = w.i + 1 JOIN ins n ON n.s = w.state JOIN ops o ON o.s = n.t AND (o.code = 'D' OR r.fault NOT IN (1, 2)) AND (o.code <> 'K' OR o.initial = r.initial)
  GROUP BY conv, w.i, o.t),
ends AS (SELECT conv, max(i) AS i FROM way GROUP BY conv),
best AS (SELECT w.conv, min({'cost': best.cost + n.cost, 'audit': best.audit || n.code, 'told': best.told || n.told}) AS b FROM way w JOIN ends e ON e.conv = w.conv AND e.i = w.i JOIN ins n ON n.s = w.state AND n.t IN (0, 3) GROUP BY w.conv),
told AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated, count(*) FILTER (WHERE i > 1 AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(b.cost AS BIGINT) AS cost, b.audit AS audit, sha256(substr(b.told, 2)) AS repaired_sha256
FROM ids LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM ids.conv_id JOIN best ON best.conv = coalesce(CAST(ids.conv_id AS VARCHAR), '')
"""
