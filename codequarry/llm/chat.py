"""Conversations as budgeted training windows, with DataFrame functions only.

A turn is written as BEGIN role MIDDLE text END. Control strings inside roles and texts are escaped by a backslash behind
their first character, backslashes by doubling, so that a window can be split at its markers and read back exactly.

Prefix sums of the turns' tokens cut a conversation into spans at turn boundaries: the turns that lie within one stride
form a span, a turn that crosses a stride's end is a span of its own. A span has at most a stride of tokens, unless a single
turn is longer. Each window has the leading system turn, turns of at most HISTORY tokens before its span, and its span;
only assistant texts of the span itself are under the loss mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The template's markers, and all control strings that texts may not hold unescaped.
BEGIN, MIDDLE, END = "<s>", "[INST]", "</s>"
CONTROLS = r"([<\[])(/?s>|/?INST\]|</?SYS>>)"
BUDGET, HISTORY = 2048, 512
#: A turn's tokens are estimated as one for each four code points and some for its markers.
CHARS_PER_TOKEN, TURN_TOKENS = 4, 4

SPECIAL = "</s>[INST] ok [/INST]"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROLS, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, span, formatted, n_context, loss): windows of all conversations.

    n_context leading turns of a window repeat earlier ones. loss has (start, length) in code points of formatted.
    Null roles and texts are empty; rows with a null conv_id form one conversation; turns that tie are ordered by role and
    text, and repeated rows are turns of their own. An empty table has no windows. A turn longer than the budget, however long, is a
    window with what it repeats and isn't cut. Only the columns conv_id, turn, role and text are read.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("tokens", F.ceil(F.length("text") / CHARS_PER_TOKEN) + TURN_TOKENS)
    t = t.withColumn("no", F.row_number().over(order) - 1).withColumn("lead", F.first(F.when(F.col("role") == "system", F.col("tokens")).otherwise(0)).over(so_far))
    t = t.withColumn("is_lead", (F.col("no") == 0) & (F.col("role") == "system")).withColumn("tokens", F.when(F.col("is_lead"), 0).otherwise(F.col("tokens")))
    t = t.withColumn("before", F.sum("tokens").over(so_far) - F.col("tokens")).withColumn("stride", F.greatest(F.lit(1), budget - history - F.col("lead")))
    cell = F.floor(F.col("before") / F.col("stride"))
    crosses = F.floor((F.col("before") + F.greatest("tokens", F.lit(1)) - 1) / F.col("stride")) > cell
    t = t.withColumn("span", 2 * cell + crosses.cast("long")).select("conv_id", "no", "role", "text", "before", "is_lead", "span")

    spans = t.groupBy("conv_id", "span").agg(F.min("before").alias("at")).where(F.col("span") > 0).withColumnRenamed("conv_id", "conv")
    kept = t.select("conv_id", "span", "no", F.lit(2).alias("kind"), "role", "text")
    lead = spans.join(t.where("is_lead"), F.col("conv").eqNullSafe(F.col("conv_id"))).select("conv_id", spans["span"], "no", F.lit(0).alias("kind"), "role", "text")
    parts = kept.unionByName(lead)
    if history > 0:
        top = F.floor((F.col("at") - 1) / history)
        near = spans.withColumn("cell", F.explode(F.array(top - 1, top))).withColumnRenamed("span", "into")
        told = t.where(~F.col("is_lead")).withColumn("cell_of", F.floor(F.col("before") / history))
        joined = near.join(told, F.col("conv").eqNullSafe(F.col("conv_id")) & (F.col("cell") == F.col("cell_of")) & (F.col("span") < F.col("into")) & (F.col("before") >= F.col("at") - history))
        parts = parts.unionByName(joined.select("conv_id", F.col("into").alias("span"), "no", F.lit(1).alias("kind"), "role", "text"))

    held = parts.groupBy("conv_id", "span").agg(F.array_sort(F.collect_list(F.struct("no", "kind", "role", "text"))).alias("turns"))
    shown = held.select("conv_id", "span", F.transform("turns", _turn).alias("turns"))
    fold = F.aggregate("turns", F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("loss")), _mask)
    return shown.select(
        "conv_id", "span", F.array_join(F.transform("turns", lambda x: F.concat(x["head"], x["text"], F.lit(END))), "").alias("formatted"),
        F.size(F.filter("turns", lambda x: x["kind"] < 2)).alias("n_context"), fold["loss"].alias("loss"),
    )


def _turn(x: Column) -> Column:
    head = F.concat(F.lit(BEGIN), escape(x["role"]), F.lit(MIDDLE))
    return F.struct(x["kind"].alias("kind"), head.alias("head"), escape(x["text"]).alias("text"), ((x["kind"] == 2) & (x["role"] == "assistant")).alias("target"))


def _mask(acc: Column, x: Column) -> Column:
    start = acc["at"] + F.length(x["head"])
    span = F.struct(start.alias("start"), F.length(x["text"]).alias("length"))
    loss = F.when(x["target"], F.array_append(acc["loss"], span)).otherwise(acc["loss"])
    return F.struct((start + F.length(x["text"]) + len(END)).alias("at"), loss.alias("loss"))


def read_back(shown: DataFrame) -> DataFrame:
    """(conv_id, span, turns, loss_texts, formatted_chars): what the windows say, without what they repeat, unescaped."""

    def parsed(piece: Column) -> Column:
        role = F.substring_index(piece, MIDDLE, 1)
        text = F.substring(piece, F.length(role) + len(MIDDLE) + 1, F.length(piece))
        return F.struct(unescape(F.substring(role, len(BEGIN) + 1, F.length(role))).alias("role"), unescape(text).alias("text"))

    pieces = F.split("formatted", rf"\Q{END}\E", -1)
    fresh = F.slice(pieces, F.col("n_context") + 1, F.size(pieces) - 1 - F.col("n_context"))
    loss = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return shown.select("conv_id", "span", F.transform(fresh, parsed).alias("turns"), loss.alias("loss_texts"), F.length("formatted").cast("long").alias("formatted_chars"))


def digest(shown: DataFrame) -> DataFrame:
    """One row a conversation: hashes of its turns and of its text under the loss mask, as read back from its windows."""
    nl = F.lit("\n")
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], nl, x["text"], nl)), "")
    read = read_back(shown).select("conv_id", "span", F.size("turns").alias("n"), told.alias("told"), F.array_join("loss_texts", "").alias("loss"), "formatted_chars")
    joined = lambda name: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span", name))), lambda x: x[name]), "")
    grouped = read.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), joined("told").alias("told"), joined("loss").alias("loss"), F.sum("formatted_chars").alias("formatted_chars"))
    return grouped.select(
        "conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.sha2("told", 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


def with_special(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """The conversations and number -7, whose texts are control strings."""
    more = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{SPECIAL}'), (-7L, 1L, 'assistant', '{SPECIAL}') AS t(conv_id, turn, role, text)")
    return turns.select("conv_id", "turn", "role", "text").unionByName(more)


ORACLE = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{SPECIAL}' UNION ALL SELECT -7, 1, 'assistant', '{SPECIAL}'
), a AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS no,
    (length(text) + {CHARS_PER_TOKEN - 1}) // {CHARS_PER_TOKEN} + {TURN_TOKENS} AS cost FROM t
), b AS (
  SELECT *, no = 0 AND role = 'system' AS is_lead,
    first_value(CASE WHEN role = 'system' THEN cost ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY no) AS lead_cost FROM a
), c AS (
  SELECT *, CASE WHEN is_lead THEN 0 ELSE cost END AS tokens, greatest(1, {BUDGET - HISTORY} - lead_cost) AS stride FROM b
), d AS (
  SELECT *, (sum(tokens) OVER (PARTITION BY conv_id ORDER BY no) - tokens)::BIGINT AS before FROM c
), e AS (
  SELECT *, 2 * (before // stride) + CASE WHEN (before + greatest(tokens, 1) - 1) // stride > before // stride THEN 1 ELSE 0 END AS span,
    {len(BEGIN + MIDDLE + END)}
      + length(regexp_replace(replace(role, '\', '\\'), '{CONTROLS}', '\1\\\2', 'g'))
      + length(regexp_replace(replace(text, '\', '\\'), '{CONTROLS}', '\1\\\2', 'g')) AS chars FROM d
), s AS (
  SELECT conv_id, span, min(before) AS at_token FROM e WHERE span > 0 GROUP BY ALL
), r AS (
  SELECT s.conv_id, sum(e.chars) AS chars FROM s JOIN e ON s.conv_id = e.conv_id
    AND (e.is_lead OR (e.span < s.span AND e.before >= s.at_token - {HISTORY})) GROUP BY ALL
), g AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY no)) AS turns_sha256,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY no), '') AS loss, sum(chars) AS chars FROM e GROUP BY ALL
)
SELECT g.conv_id, n_turns::BIGINT AS n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
  (g.chars + coalesce(r.chars, 0))::BIGINT AS formatted_chars
FROM g LEFT JOIN r ON g.conv_id = r.conv_id
"""
