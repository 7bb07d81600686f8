"""Nearest events in time and counts at a time: points and events of an id lie on one sorted line, cut into stretches of time if it is crowded.

Points have (key, id, at, tie) and events (id, at, tie, value); at is in seconds, ties come in the order of tie. No point is paired with
all events of its id: a window carries what it saw on. An id of few rows is one window; one of more than CROWD is cut into stretches, and
across those there is one row a stretch. A null id meets nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

YEAR_QUARTER = 90 * 86400
#: Rows of an id that one window holds; an id of more is cut into stretches.
CROWD = 1 << 16


def _stretches(seconds: int, points: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """points and events with the stretch of each row; null where the id is one window. Crowded ids are few, as each has CROWD rows."""
    points, events = points.where("id is not null"), events.where("id is not null")
    crowded = events.select("id").unionByName(points.select("id")).groupBy("id").agg(F.count("*").alias("rows")).where(F.col("rows") > CROWD).select("id", F.lit(True).alias("crowded"))
    at = F.when(F.col("crowded"), F.floor(F.col("at") / seconds))
    told = lambda df: df.join(F.broadcast(crowded), "id", "left").withColumn("stretch", at).drop("crowded")
    return told(points), told(events)


def _event() -> Column:
    """What a row of the line tells as an event; put together behind the shuffle, which carries its parts once."""
    return F.when(F.col("point") == 0, F.struct("at", "tie", "value"))


def _line(points: DataFrame, events: DataFrame, seconds: int) -> tuple[DataFrame, DataFrame]:
    """Points, with all their columns, and events on one line; and the events that lie in stretches."""
    points, events = _stretches(seconds, points, events)
    line = events.select("id", "at", "tie", "stretch", "value", F.lit(0).alias("point")).unionByName(points.withColumn("point", F.lit(1)), allowMissingColumns=True)
    return line, events.where("stretch is not null").select("id", "stretch", F.struct("at", "tie", "value").alias("event"))


def nearest_within(points: DataFrame, events: DataFrame, seconds: int) -> DataFrame:
    """All points, with their further columns, and in found (at, tie, value) the first event at a point's time or up to `seconds` later, or null."""
    line, cut = _line(points, events, seconds)
    late_to_early = Window.partitionBy("id", "stretch").orderBy(F.desc("at"), "point", F.desc("tie")).rowsBetween(Window.unboundedPreceding, 0)
    own = line.withColumn("own", F.last(_event(), True).over(late_to_early)).where("point = 1")
    firsts = cut.groupBy("id", (F.col("stretch") - 1).alias("stretch")).agg(F.min("event").alias("next"))
    found = F.coalesce("own", "next")
    return own.join(firsts, ["id", "stretch"], "left").withColumn("found", F.when(found["at"] <= F.col("at") + seconds, found)).select(*points.columns, "found")


def first_within(points: DataFrame, events: DataFrame, seconds: int) -> DataFrame:
    """(key, at, tie, value) of the first event at a point's time or up to `seconds` later; a point without one has no row."""
    return nearest_within(points, events, seconds).where("found is not null").select("key", "found.at", "found.tie", "found.value")


def last_within(points: DataFrame, events: DataFrame, seconds: int) -> DataFrame:
    """(key, at, tie, value) of the last event after a point, but up to `seconds` later; a point without one has no row.

    An event of the point's own time is after it if its tie is greater; a point with a null tie is after all of its time.
    """
    ends = points.select("key", "id", (F.col("at") + seconds).alias("at"), F.lit(None).cast(dict(points.dtypes)["tie"]).alias("tie"), F.col("at").alias("since"), F.col("tie").alias("since_tie"))
    line, cut = _line(ends, events, seconds)
    early_to_late = Window.partitionBy("id", "stretch").orderBy("at", "point", "tie").rowsBetween(Window.unboundedPreceding, 0)
    own = line.withColumn("own", F.last(_event(), True).over(early_to_late)).where("point = 1").select("key", "id", "stretch", "since", "since_tie", "own")
    lasts = cut.groupBy("id", (F.col("stretch") + 1).alias("stretch")).agg(F.max("event").alias("before"))
    met = own.join(lasts, ["id", "stretch"], "left").select("key", "since", "since_tie", F.coalesce("own", "before").alias("found"))
    after = (F.col("found.at") > F.col("since")) | ((F.col("found.at") == F.col("since")) & (F.col("found.tie") > F.col("since_tie")))
    return met.where(after).select("key", "found.at", "found.tie", "found.value")


def last_until(points: DataFrame, events: DataFrame, seconds: int = YEAR_QUARTER) -> DataFrame:
    """(key, at, tie, value) of the last event until a point, however long ago; a point without one has no row.

    An event of the point's own time counts if its tie isn't greater; for a point with a null tie all of its time count.
    """
    line, cut = _line(points, events, seconds)
    early_to_late = Window.partitionBy("id", "stretch").orderBy("at", F.asc_nulls_last("tie"), "point").rowsBetween(Window.unboundedPreceding, 0)
    own = line.withColumn("own", F.last(_event(), True).over(early_to_late)).where("point = 1").select("key", "id", "stretch", "own")
    # a stretch without events has its row too, as points may lie in it
    held = cut.select("id", "stretch", "event").unionByName(line.where("point = 1 and stretch is not null").select("id", "stretch", _event().alias("event")))
    lasts = held.groupBy("id", "stretch").agg(F.max("event").alias("last"))
    earlier = F.last("last", True).over(Window.partitionBy("id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))
    found = own.join(lasts.select("id", "stretch", earlier.alias("earlier")), ["id", "stretch"], "left").select("key", F.coalesce("own", "earlier").alias("found"))
    return found.where("found is not null").select("key", "found.at", "found.tie", "found.value")


def sums_until(points: DataFrame, changes: DataFrame, *sums: str, seconds: int = YEAR_QUARTER) -> DataFrame:
    """(key, *sums) of every point: the sums of the changes (id, at, tie, *sums) until it, those of its own time and tie included."""
    line = changes.select("id", "at", "tie", F.floor(F.col("at") / seconds).alias("stretch"), *sums, F.lit(0).alias("point")).unionByName(points.select("key", "id", "at", "tie", F.floor(F.col("at") / seconds).alias("stretch"), F.lit(1).alias("point")), allowMissingColumns=True)
    so_far = Window.partitionBy("id", "stretch").orderBy("at", F.asc_nulls_last("tie"), "point").rowsBetween(Window.unboundedPreceding, 0)
    own = line.select("key", "id", "stretch", "point", *(F.sum(c).over(so_far).alias(c) for c in sums)).where("point = 1")
    whole = line.groupBy("id", "stretch").agg(*(F.sum(c).alias(c) for c in sums))
    by = Window.partitionBy("id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    earlier = whole.select("id", "stretch", *(F.sum(c).over(by).alias(f"earlier_{c}") for c in sums))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return own.join(earlier, ["id", "stretch"]).select("key", *((zero(F.col(c)) + zero(F.col(f"earlier_{c}"))).alias(c) for c in sums))
