"""Registered queries of the evaluation statistics, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from codequarry.model import Model
from codequarry.operators import evaluation
from codequarry.plans import retrieval
from codequarry.queries import BM25, _bm25, query

#: Stand-in for golden questions: the five documents whose number divided by five is the item's.
GOLD = "gold AS (SELECT item_id AS query_id, doc_id AS item_id FROM benchmark JOIN documents ON doc_id // 5 = item_id)"


def _ranked(m: Model):
    return retrieval.bm25_top(_bm25(m), "doc_id", 10).select("query_id", F.col("doc_id").alias("item_id"), "rank")


def _gold(m: Model):
    items = m.table("benchmark").select(F.col("item_id").alias("query_id"), F.col("item_id").alias("k"))
    return items.join(m.table("documents").select(F.col("doc_id").alias("item_id"), F.floor(F.col("doc_id") / 5).alias("k")), "k").drop("k")


METRICS = f"""WITH {BM25}, {GOLD}, ranked AS (SELECT query_id, doc_id AS item_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scores),
told AS (SELECT g.query_id, count(*) AS gold, count(rank) AS found, min(rank) AS first FROM gold g LEFT JOIN (SELECT * FROM ranked WHERE rank <= 10) r ON r.query_id = g.query_id AND r.item_id = g.item_id GROUP BY 1),
metrics AS (SELECT query_id, found / gold AS recall, coalesce((first <= 1)::INT, 0) AS acc1, coalesce((first <= 3)::INT, 0) AS acc3, coalesce((first <= 5)::INT, 0) AS acc5, coalesce(1.0::DOUBLE / first, 0) AS rr FROM told)"""


@query("e1_metrics", f"{METRICS} SELECT query_id, round(recall, 6) AS recall, acc1, acc3, acc5, round(rr, 6) AS rr FROM metrics")
def _(m: Model):
    return evaluation.metrics(_ranked(m), _gold(m)).withColumns({"recall": F.round("recall", 6), "rr": F.round("rr", 6)})


@query("e17_macro", "WITH d AS (SELECT source, avg(n_chars) AS mean FROM documents GROUP BY source) SELECT round(avg(mean), 6) AS macro_n_chars FROM d")
def _(m: Model):
    return evaluation.macro(m.table("documents"), "source", "n_chars").select(F.round("macro_n_chars", 6).alias("macro_n_chars"))


#: Two systems' outcomes on the same questions: whether a document is long, and whether its number is even.
PAIRS = "pairs AS (SELECT lang, source, (n_chars > 2000)::INT AS a, (doc_id % 2)::INT AS b FROM documents)"


def _pairs(m: Model):
    return m.table("documents").select("lang", "source", (F.col("n_chars") > 2000).cast("int").alias("a"), (F.col("doc_id") % 2).cast("int").alias("b"))


MCNEMAR = f"""{PAIRS}, w AS (SELECT lang, source, count(*) FILTER (a > b) AS wins, count(*) FILTER (a < b) AS losses FROM pairs GROUP BY ALL),
mc AS (SELECT lang, source, wins, losses, least(1.0, 2 * list_sum(list_transform(range(0, least(wins, losses) + 1), lambda i: exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) - (wins + losses) * ln(2))))) AS p FROM w)"""


@query("e4_mcnemar", f"WITH {MCNEMAR} SELECT lang, source, wins, losses, round(p, 6) AS p FROM mc")
def _(m: Model):
    return evaluation.mcnemar(_pairs(m), "lang", "source").withColumn("p", F.round("p", 6))


@query("e5_holm", f"""WITH {MCNEMAR}, r AS (SELECT lang, source, p, least(1.0, (count(*) OVER (PARTITION BY lang) - row_number() OVER (PARTITION BY lang ORDER BY round(p, 9), source) + 1) * p) AS raised FROM mc)
SELECT lang, source AS test, round(max(raised) OVER (PARTITION BY lang ORDER BY round(p, 9), source), 6) AS p_holm FROM r""")
def _(m: Model):
    tests = evaluation.mcnemar(_pairs(m), "lang", "source").select("lang", F.col("source").alias("test"), F.round("p", 9).alias("p"))
    return evaluation.holm(tests, "lang").select("lang", "test", F.round("p_holm", 6).alias("p_holm"))


@query("e6_fisher", """WITH t AS (SELECT source, count(*) FILTER (lang = 'en' AND n_chars > 2000) AS a, count(*) FILTER (lang = 'en' AND n_chars <= 2000) AS b, count(*) FILTER (lang <> 'en' AND n_chars > 2000) AS c, count(*) FILTER (lang <> 'en' AND n_chars <= 2000) AS d FROM documents GROUP BY source),
f AS (SELECT source, a, b, c, d, unnest(range(a, least(a + b, a + c) + 1)) AS k FROM t)
SELECT source, round(sum(exp(lgamma(a + c + 1) - lgamma(k + 1) - lgamma(a + c - k + 1) + lgamma(b + d + 1) - lgamma(a + b - k + 1) - lgamma(b + d - a - b + k + 1) - lgamma(a + b + c + d + 1) + lgamma(a + b + 1) + lgamma(c + d + 1))), 6) AS p FROM f GROUP BY source""")
def _(m: Model):
    long, en = F.col("n_chars") > 2000, F.col("lang") == "en"
    t = m.table("documents").groupBy("source").agg(F.count_if(en & long).alias("a"), F.count_if(en & ~long).alias("b"), F.count_if(~en & long).alias("c"), F.count_if(~en & ~long).alias("d"))
    return t.select("source", F.round(evaluation.fisher(*(F.col(c) for c in "abcd")), 6).alias("p"))


@query("e7_chance", """WITH t AS (SELECT source, count(*) AS n, count(*) FILTER (lang = 'fr') AS gold FROM documents GROUP BY source)
SELECT source, round(1 - CASE WHEN gold = 0 THEN 1 ELSE exp(list_sum(list_transform(range(0, 10), lambda i: ln(greatest(n - gold - i, 1e-300) / (n - i))))) END, 6) AS p FROM t WHERE n >= 10""")
def _(m: Model):
    t = m.table("documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == "fr").alias("gold")).where("n >= 10")
    return t.select("source", F.round(evaluation.chance(F.col("n"), F.col("gold"), F.lit(10)), 6).alias("p"))


@query("a26_kappa", """WITH c AS (SELECT quality AS x, toxic AS y, count(*) AS n FROM labels GROUP BY ALL), px AS (SELECT quality AS x, count(*) AS nx FROM labels GROUP BY 1), py AS (SELECT toxic AS y, count(*) AS ny FROM labels GROUP BY 1)
SELECT round(1 - (SELECT sum(n) FILTER (x <> y) FROM c)::DOUBLE * (SELECT sum(n) FROM c) / (SELECT sum(nx * ny) FILTER (x <> y) FROM px, py), 6) AS kappa""")
def _(m: Model):
    return evaluation.kappa(m.table("labels").select(F.col("quality").alias("x"), F.col("toxic").alias("y"))).select(F.round("kappa", 6).alias("kappa"))


@query("e11_sources_not_worse", "SELECT lang, count(*) FILTER (n >= 0) AS not_worse, count(*) AS sources FROM (SELECT lang, source, avg((n_chars > 2000)::INT) - avg((doc_id % 2)::INT) AS n FROM documents GROUP BY ALL) GROUP BY lang")
def _(m: Model):
    per = _pairs(m).groupBy("lang", "source").agg((F.avg("a") - F.avg("b")).alias("n"))
    return per.groupBy("lang").agg(F.count_if(F.col("n") >= 0).alias("not_worse"), F.count("*").alias("sources"))


@query("e2_bootstrap")
def _(m: Model):
    return evaluation.bootstrap(_pairs(m).select("lang", "a", "b"), "lang")


@query("e14_latest", "SELECT user_id, arg_max(event_type, (ts, event_id, event_type)) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def _(m: Model):
    return evaluation.latest(m.table("events").select("user_id", "ts", "event_id", "event_type"), "user_id", "ts").select("user_id", "event_type", "ts")


@query("e15_regressions", "SELECT user_id AS query_id FROM events GROUP BY user_id HAVING max(CASE WHEN event_type = 'click' THEN (value > 50)::INT END) = 1 AND max(CASE WHEN event_type = 'purchase' THEN (value > 90)::INT END) = 0")
def _(m: Model):
    hit = F.when(F.col("event_type") == "click", F.col("value") > 50).otherwise(F.col("value") > 90).cast("int")
    return evaluation.regressions(m.table("events").select(F.col("user_id").alias("query_id"), F.col("event_type").alias("form"), hit.alias("hit")), "click", "purchase")


@query("a27_term_jaccard", """WITH t AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda w: w <> '')) AS words FROM benchmark), p AS (SELECT a.item_id, a.words AS x, b.words AS y FROM t a JOIN t b ON b.item_id = a.item_id + 1)
SELECT item_id, round(len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))), 6) AS likeness FROM p""")
def _(m: Model):
    t = m.table("benchmark").select("item_id", F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z0-9_]+"), lambda w: w != "")).alias("words"))
    after = t.select((F.col("item_id") - 1).alias("item_id"), F.col("words").alias("after"))
    return t.join(after, "item_id").select("item_id", F.round(evaluation.jaccard(F.col("words"), F.col("after")), 6).alias("likeness"))
