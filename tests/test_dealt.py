"""References and callers of names in as many tasks as their rows ask for."""

from __future__ import annotations

from pyspark.sql import functions as F

import __spark_entry__ as entry
from codequarry import shared
from codequarry.model import Model
from codequarry.operators import ordered


def test_refs_are_the_relation(spark, sf_dir):
    m = Model(spark, sf_dir)
    told, want = m.refs, m._relation("refs")
    assert told.schema.names == want.schema.names and [f.dataType for f in told.schema] == [f.dataType for f in want.schema]
    assert sorted(told.collect()) == sorted(want.collect())


def test_tasks_grow_with_refs(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(shared, "ROWS_A_TASK", 500)
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    told = entry.queries()["a3_callees"](spark, sf_dir)
    assert told.rdd.getNumPartitions() == rows // 500 + 1
    assert "Join" not in told._jdf.queryExecution().executedPlan().toString()


def test_limited_by_name_is_limited_then_filtered(spark):
    symbols = spark.createDataFrame([(i, "get" if i % 3 else f"n{i}", i % 7) for i in range(90)], "symbol_id int, name string, own int")
    files = spark.createDataFrame([(i, f"p{(i * 5) % 7}") for i in range(7)], "file_id int, path string")
    callers = symbols.select(F.expr("if(symbol_id % 2 = 0, 'get', concat('n', symbol_id div 5 * 3))").alias("name"), F.col("symbol_id").alias("caller_id"), F.col("own").alias("file_id"), (F.col("symbol_id") % 4).alias("start_line"))
    keep = F.col("own") != F.col("file_id")
    told = ordered.limited_by_name(symbols, callers, files, keep, 3, 90)
    want = ordered.limited_then_filtered(symbols.join(callers, "name"), files, keep, 3)
    assert sorted(told.collect()) == sorted(want.collect()) and told.count() > 90
    assert "ShuffledHashJoin" in told._jdf.queryExecution().executedPlan().toString()
