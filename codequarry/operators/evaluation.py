"""Evaluation statistics over ranked results: hits, ranks, agreement and exact tests."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Counts that a bootstrap draws at once.
DRAWN = 1 << 20


def metrics(ranked: DataFrame, gold: DataFrame, cut: int = 10) -> DataFrame:
    """One row a query of gold (query_id, item_id): recall among the first `cut`, acc1, acc3, acc5 and the reciprocal rank.

    ranked has (query_id, item_id, rank); a query without any hit has zeros.
    """
    hits = gold.join(ranked, ["query_id", "item_id"], "left").withColumn("rank", F.when(F.col("rank") <= cut, F.col("rank")))
    told = hits.groupBy("query_id").agg(F.count("*").alias("gold"), F.count("rank").alias("found"), F.min("rank").alias("first"))
    at = lambda k: F.coalesce((F.col("first") <= k).cast("int"), F.lit(0)).alias(f"acc{k}")
    return told.select("query_id", (F.col("found") / F.col("gold")).alias("recall"), at(1), at(3), at(5), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"))


def macro(per_query: DataFrame, group: str, value: str) -> DataFrame:
    """The mean of the groups' means, each group counting once."""
    return per_query.groupBy(group).agg(F.avg(value).alias("mean")).agg(F.avg("mean").alias(f"macro_{value}"))


def two_sided(k: Column, n: Column) -> Column:
    """Exact two-sided probability of k or fewer, or as many on the other side, of n fair coins."""
    zero = F.struct(F.pow(F.lit(0.5), n).alias("term"), F.lit(0.0).alias("total"))
    step = lambda acc, i: F.struct((acc["term"] * (n - i) / (i + 1)).alias("term"), (acc["total"] + acc["term"]).alias("total"))
    low = F.least(k, n - k)
    total = F.aggregate(F.sequence(F.lit(0).cast("long"), low.cast("long")), zero, step)["total"]
    return F.least(F.lit(1.0), 2 * total)


def mcnemar(pairs: DataFrame, *keys: str) -> DataFrame:
    """(keys, wins, losses, p) of paired outcomes a and b, 0 or 1; ties don't count."""
    told = pairs.groupBy(*keys).agg(F.count_if(F.expr("a > b")).alias("wins"), F.count_if(F.expr("a < b")).alias("losses"))
    return told.withColumn("p", two_sided(F.least("wins", "losses"), F.col("wins") + F.col("losses")))


def holm(tests: DataFrame, family: str = "family") -> DataFrame:
    """p values corrected within each family: times the number of tests that aren't smaller, never falling."""
    order = Window.partitionBy(family).orderBy("p", "test")
    m = F.count("*").over(Window.partitionBy(family))
    raised = tests.withColumn("raised", F.least(F.lit(1.0), (m - F.row_number().over(order) + 1) * F.col("p")))
    return raised.withColumn("p_holm", F.max("raised").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("raised")


def chance(n: Column, gold: Column, drawn: Column) -> Column:
    """How likely `drawn` items without replacement of n hold one of `gold`."""
    misses = F.aggregate(F.sequence(F.lit(0), drawn.cast("int") - 1), F.lit(1.0), lambda acc, i: acc * F.greatest(n - gold - i, F.lit(0)) / (n - i))
    return F.when(drawn > 0, 1 - misses).otherwise(0.0)


def log_fact(n: Column) -> Column:
    """The logarithm of n!: Stirling's series from 16 on, a sum below, so it costs the same for every n."""
    x = n.cast("double")
    series = (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * F.pow(x, 3)) + 1 / (1260 * F.pow(x, 5)) - 1 / (1680 * F.pow(x, 7))
    known = F.array(*(F.lit(math.lgamma(k + 1)) for k in range(16)))
    return F.when(n < 16, F.element_at(known, F.least(F.greatest(n, F.lit(0)), F.lit(15)).cast("int") + 1)).otherwise(series)


def fisher(a: Column, b: Column, c: Column, d: Column) -> Column:
    """One-sided probability of a or more in a table of a, b, c, d with its margins; the work is that of its terms."""
    row, col, n = a + b, a + c, a + b + c + d
    log_choose = lambda x, y: log_fact(x) - log_fact(y) - log_fact(x - y)
    whole = log_choose(n, row)
    return F.aggregate(F.sequence(a, F.least(row, col)), F.lit(0.0), lambda s, k: s + F.exp(log_choose(col, k) + log_choose(n - col, row - k) - whole))


def kappa(pairs: DataFrame, weights: str = "none") -> DataFrame:
    """Cohen's kappa of two ratings x and y; `quadratic` weighs a disagreement by the square of its distance."""
    cells = pairs.groupBy("x", "y").agg(F.count("*").alias("n"))
    xs, ys = pairs.groupBy("x").agg(F.count("*").alias("nx")), pairs.groupBy("y").agg(F.count("*").alias("ny"))
    off = (lambda: F.pow(F.col("x") - F.col("y"), 2)) if weights == "quadratic" else (lambda: (F.col("x") != F.col("y")).cast("double"))
    seen = cells.agg(F.sum(off() * F.col("n")).alias("seen"), F.sum("n").alias("total"))
    expected = xs.crossJoin(F.broadcast(ys)).agg(F.sum(off() * F.col("nx") * F.col("ny")).alias("expected"))  # one row a rating value
    return seen.crossJoin(expected).select((1 - F.col("seen") * F.col("total") / F.col("expected")).alias("kappa"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def bootstrap(pairs: DataFrame, key: str, draws: int = 10_000, seed: int = 7) -> DataFrame:
    """(key, mean, low, high): the mean difference of a and b of each comparison, and the 95% interval of its resamples.

    Outcomes take few values, so a comparison's rows are counted by difference before they meet, and a resample draws the
    counts; memory grows with neither rows nor draws.
    """
    return _resampled(pairs.select(key, (F.col("a") - F.col("b")).cast("double").alias("diff"), F.lit(1).cast("long").alias("size")), key, draws, seed)


def cluster_bootstrap(pairs: DataFrame, key: str, cluster: str, draws: int = 10_000, seed: int = 7) -> DataFrame:
    """As bootstrap, but whole clusters are drawn, so questions of one repository stay together; equal clusters are counted."""
    whole = pairs.groupBy(key, cluster).agg(F.sum((F.col("a") - F.col("b")).cast("double")).alias("diff"), F.count("*").alias("size"))
    return _resampled(whole, key, draws, seed)


def _resampled(drawn: DataFrame, key: str, draws: int, seed: int) -> DataFrame:
    """(key, mean, low, high) of what is drawn: units (key, diff, size), of which a resample takes as many as there are."""

    def run(some: pd.DataFrame) -> pd.DataFrame:
        some = some.sort_values(["diff", "size"])
        diff, size, count = some["diff"].to_numpy(float), some["size"].to_numpy(float), some["count"].to_numpy(np.int64)
        n, block = count.sum(), max(1, DRAWN // len(diff))
        rng = np.random.default_rng(seed)
        taken = (rng.multinomial(n, count / n, min(block, draws - i)) for i in range(0, draws, block))
        means = np.sort(np.concatenate([(t @ diff) / (t @ size) for t in taken]))
        return pd.DataFrame({key: [some[key].iloc[0]], "mean": [count @ diff / (count @ size)], "low": [means[int(0.025 * draws)]], "high": [means[int(0.975 * draws) - 1]]})

    kind = dict(drawn.dtypes)[key]
    return drawn.groupBy(key, "diff", "size").count().groupBy(key).applyInPandas(run, f"{key} {kind}, mean double, low double, high double")


def regressions(results: DataFrame, before: str, after: str) -> DataFrame:
    """Questions (query_id) that form `before` hits and form `after` misses."""
    hit = results.groupBy("query_id").agg(F.max(F.when(F.col("form") == before, F.col("hit"))).alias("b"), F.max(F.when(F.col("form") == after, F.col("hit"))).alias("a"))
    return hit.where("b = 1 and a = 0").select("query_id")


def latest(results: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key that comes last by `order`."""
    rest = [c for c in results.columns if c not in (key, order)]
    best = results.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("best"))
    return best.select(key, f"best.{order}", *(f"best.{c}" for c in rest))


def wins(pairs: DataFrame, key: str) -> DataFrame:
    """(key, mean_a, mean_b, wins, losses): the means of two systems' outcomes a and b, and how often either is the larger."""
    return pairs.groupBy(key).agg(F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.count_if(F.col("a") > F.col("b")).alias("wins"), F.count_if(F.col("a") < F.col("b")).alias("losses"))


def nets(flagged: DataFrame, gold: DataFrame, key: str, item: str) -> DataFrame:
    """(key, hits, outside, missed): how many items a change flags that gold holds, that it doesn't, and gold's others."""
    one, two = (x.select(key, item).distinct().withColumn(name, F.lit(1)) for x, name in ((flagged, "f"), (gold, "g")))
    seen = lambda f, g: F.count_if((F.col("f").isNotNull() == f) & (F.col("g").isNotNull() == g))
    return one.join(two, [key, item], "full").groupBy(key).agg(seen(True, True).alias("hits"), seen(True, False).alias("outside"), seen(False, True).alias("missed"))


def subgroups(per_query: DataFrame, value: str, groups: dict[str, Column]) -> DataFrame:
    """(subgroup, n, mean) of the questions that a subgroup's condition holds for; one question may count in several, all in one pass."""
    names = F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in groups.items())))
    return per_query.select(F.explode(names).alias("subgroup"), value).groupBy("subgroup").agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def drop_difference(results: DataFrame, systems: tuple[str, str], forms: tuple[str, str]) -> DataFrame:
    """(n, mean): how much more the first system loses from the first form to the second than the second system does.

    results has (query_id, system, form, value); only questions that all four runs answered count.
    """
    runs = [F.max(F.when((F.col("system") == s) & (F.col("form") == f), F.col("value"))).alias(f"{k}{i}") for k, s in zip("ab", systems, strict=True) for i, f in enumerate(forms)]
    whole = results.groupBy("query_id").agg(*runs).dropna()
    return whole.agg(F.count("*").alias("n"), F.avg((F.col("a0") - F.col("a1")) - (F.col("b0") - F.col("b1"))).alias("mean"))
