import datetime as dt

import pytest

from codequarry.streaming import events

START = dt.datetime(2026, 1, 1)


def stream(spark, tmp_path, batches, schema, transform, mode="append"):
    """Rows that a stream of files, one a batch, gives."""
    source = tmp_path / "in"
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else state with time limits keeps a bounded run going
    for no, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{source}/{no}")
    frame = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(source))
    name = f"out_{abs(hash(str(tmp_path)))}"
    query = transform(frame).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return [tuple(r) for r in spark.sql(f"SELECT * FROM {name}").collect()]


@pytest.mark.parametrize(("seconds", "periods"), [(10_799, 1), (10_800, 2), (10_801, 2)])
def test_a_gap_of_three_hours_splits(spark, tmp_path, seconds, periods):
    rows = [("s", START), ("s", START + dt.timedelta(seconds=seconds)), ("t", START + dt.timedelta(days=3))]
    found = stream(spark, tmp_path, [rows[:2], rows[2:], [("t", START + dt.timedelta(days=9))]], "session string, ts timestamp", events.sessions)
    assert sum(r[0] == "s" for r in found) == periods


def test_repeats_are_dropped(spark, tmp_path):
    rows = [("a", START), ("a", START), ("b", START)]
    found = stream(spark, tmp_path, [rows, rows[:1]], "uuid string, ts timestamp", lambda df: events.once(df, "uuid"))
    assert sorted(r[0] for r in found) == ["a", "b"]


def test_deltas_carry_over_batches(spark, tmp_path):
    batches = [[("s", 1, 5), ("s", 2, 9)], [("s", 3, 9), ("s", 4, 2), ("s", 5, 4), ("t", 1, 7)]]
    found = stream(spark, tmp_path, batches, "session string, seq long, total long", events.deltas)
    assert sorted(found) == [("s", 1, 5), ("s", 2, 4), ("s", 3, 0), ("s", 4, 0), ("s", 5, 2), ("t", 1, 7)]


def test_one_alert_a_session(spark, tmp_path):
    found = stream(spark, tmp_path, [[("s", "b"), ("s", "a")], [("s", "c"), ("t", "d")]], "session string, finding string", events.alerts)
    assert sorted(found) == [("s", "a"), ("t", "d")]


def test_changed_paths(spark, tmp_path):
    rows = [("a", START), ("b", START), ("a", START), ("z", START + dt.timedelta(minutes=9))]
    found = stream(spark, tmp_path, [rows, [("z", START + dt.timedelta(hours=1))]], "path string, ts timestamp", events.changed_paths)
    assert ["a", "b"] in [r[1] for r in found]
