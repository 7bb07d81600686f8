import math
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from codequarry.operators import evaluation


def test_bootstrap_counts_rows_before_they_meet(spark):
    """A comparison of many rows against the normal interval; only its distinct differences reach Python."""
    i = F.col("id")
    pairs = spark.range(40_000).select(F.when(i % 4 < 3, "many").otherwise("few").alias("k"), (i % 5 < 2).cast("int").alias("a"), (i % 7 < 2).cast("int").alias("b"))
    told = evaluation.bootstrap(pairs, "k", draws=2000)
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"FlatMapGroupsInPandas[\s\S]*Aggregate \[k", plan)
    want = {r["k"]: r for r in pairs.groupBy("k").agg(F.avg(F.col("a") - F.col("b")).alias("mean"), (F.stddev(F.col("a") - F.col("b")) / F.sqrt(F.count("*"))).alias("error")).collect()}
    rows = told.collect()
    assert {r["k"] for r in rows} == set(want) == {"many", "few"}
    for r in rows:
        mean, error = want[r["k"]]["mean"], want[r["k"]]["error"]
        assert r["mean"] == pytest.approx(mean)
        assert r["low"] == pytest.approx(mean - 1.96 * error, abs=0.2 * error)
        assert r["high"] == pytest.approx(mean + 1.96 * error, abs=0.2 * error)


def test_cluster_bootstrap_draws_whole_clusters(spark):
    """Against resampled clusters drawn one by one; a comparison of one cluster has no spread."""
    rng = np.random.default_rng(3)
    rows = [("many", c, int(rng.random() < 0.2 + 0.6 * (c % 2)), int(rng.random() < 0.4)) for c in range(40) for _ in range(5 + c % 9)]
    rows += [("one", 1, 1, 0), ("one", 1, 0, 0)]
    told = {r["k"]: r for r in evaluation.cluster_bootstrap(spark.createDataFrame(rows, "k string, c int, a int, b int"), "k", "c", draws=4000).collect()}
    assert [told["one"][x] for x in ("mean", "low", "high")] == [0.5, 0.5, 0.5]
    diffs = [[a - b for k, d, a, b in rows if k == "many" and d == c] for c in range(40)]
    drawn = sorted(np.mean(np.concatenate([diffs[c] for c in rng.integers(0, 40, 40)])) for _ in range(4000))
    assert told["many"]["mean"] == pytest.approx(np.mean(np.concatenate(diffs)))
    assert told["many"]["low"] == pytest.approx(drawn[100], abs=0.03)
    assert told["many"]["high"] == pytest.approx(drawn[3899], abs=0.03)


def test_nets_and_subgroups_of_empty_tables(spark):
    none = spark.createDataFrame([], "k long, i long, v double")
    assert evaluation.nets(none, none, "k", "i").collect() == []
    assert evaluation.subgroups(none, "v", {"all": F.lit(True)}).collect() == []
    one = spark.createDataFrame([(1, 1, 0.0), (1, 1, 0.0), (1, 2, 0.0)], none.schema)
    assert [tuple(r) for r in evaluation.nets(one, none, "k", "i").collect()] == [(1, 0, 2, 0)]


def test_fisher_of_large_tables_costs_its_terms(spark):
    """Tables of up to a million rows against logarithms of factorials from the library; the factorials aren't summed for each term."""
    tables = [(3, 1, 1, 3), (0, 0, 0, 0), (0, 5, 5, 0), (17, 15, 16, 18), (12, 4, 0, 2), (2600, 4900, 240_000, 460_000)]
    began = time.time()
    found = [r["p"] for r in spark.createDataFrame([(i, *t) for i, t in enumerate(tables)], "i int, a long, b long, c long, d long").select("i", evaluation.fisher(*map(F.col, "abcd")).alias("p")).orderBy("i").collect()]
    assert time.time() - began < 60
    choose = lambda x, y: math.lgamma(x + 1) - math.lgamma(y + 1) - math.lgamma(x - y + 1)
    for p, (a, b, c, d) in zip(found, tables, strict=True):
        want = sum(math.exp(choose(a + c, k) + choose(b + d, a + b - k) - choose(a + b + c + d, a + b)) for k in range(a, min(a + b, a + c) + 1))
        assert p == pytest.approx(want, rel=1e-6)
