"""Files that change together, dealt to more tasks as the history grows."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from itertools import combinations

from codequarry.operators import lookups


def test_tasks_grow_with_the_pairs(spark, monkeypatch):
    monkeypatch.setattr(lookups, "ROWS_A_TASK", 50)
    rng = random.Random(2)
    rows = [(h, rng.randrange(12)) for h in range(150) for _ in range(rng.choice([1, 2, 3, 5, 31]))]
    found = lookups.cochange(spark.createDataFrame(rows, "hash long, file_id long"))
    by = defaultdict(list)
    for h, f in rows:
        by[h].append(f)
    want = Counter(p for files in by.values() if 2 <= len(files) <= 30 for p in combinations(sorted(set(files)), 2))
    assert {(r["file_a"], r["file_b"]): r["cnt"] for r in found.collect()} == {p: n for p, n in want.items() if n >= 2}
    assert found.rdd.getNumPartitions() > sum(len(f) * (len(f) - 1) // 2 for f in by.values() if 2 <= len(f) <= 30) // 50 - 1
    assert lookups.cochange(spark.createDataFrame([], "hash long, file_id long")).collect() == []
