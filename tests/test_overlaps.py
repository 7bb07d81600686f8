"""Files that two sessions both edited, over several blocks of sessions and of files."""

from __future__ import annotations

import random
from collections import defaultdict
from itertools import combinations

import pytest

from codequarry.operators import sessions


@pytest.mark.parametrize("block", [7, 1000])
def test_overlaps_by_blocks(spark, monkeypatch, block):
    rng = random.Random(3)
    rows = [(rng.randrange(40), rng.choice([rng.randrange(5), rng.randrange(3000)]), rng.choice(["edit", "edit", "read"])) for _ in range(700)] + [(None, 1, "edit"), (1, None, "edit")]
    events = spark.createDataFrame(rows, "session long, file_id long, op string")
    by = defaultdict(set)
    for s, f, op in rows:
        if op == "edit" and s is not None and f is not None:
            by[s].add(f)
    want = {(a, b): len(by[a] & by[b]) for a, b in combinations(sorted(by), 2) if by[a] & by[b]}
    found = sessions.overlaps(events, block)
    assert {(r["session"], r["other"]): r["files"] for r in found.collect()} == want and len(want) > 100
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sessions.overlaps(events.where("false"), block).collect() == []


def _most_generated(plan) -> int:
    """The most rows that an explode of an executed plan made."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return _most_generated(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return _most_generated(plan.plan())
    own = plan.metrics().get("numOutputRows").get().value() if name == "GenerateExec" else 0
    below = plan.children()
    return max([own, *(_most_generated(below.apply(i)) for i in range(below.size()))])


def test_a_block_travels_as_one_row(spark):
    events = spark.createDataFrame([(s, f, "edit") for s in range(40) for f in range(30)], "session long, file_id long, op string")
    found = sessions.overlaps(events, 4)
    assert {(r["session"], r["other"]): r["files"] for r in found.collect()} == {pair: 30 for pair in combinations(range(40), 2)}
    assert 0 < _most_generated(found._jdf.queryExecution().executedPlan()) <= 100
