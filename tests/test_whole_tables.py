"""Queries that once left out ids give rows for all of them."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from codequarry.functions import text
from codequarry.model import Model
from codequarry.queries_retrieval import _seeds


def ids(df, column):
    return {r[0] for r in df.select(column).distinct().collect()}


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return Model(spark, sf_dir)


def test_every_id_is_told(spark, sf_dir, model):
    told = {name: query(spark, sf_dir) for name, query in entry.queries().items() if name in ("g4_neighborhoods", "g18_related_tests", "o2_limit_before_filter", "j17_path_suffixes", "f27_compact_numbers")}
    assert ids(told["g4_neighborhoods"].where("kind = 'defines'"), "symbol_id") == ids(model.symbols, "symbol_id")
    assert {i % 10 for i in ids(told["g18_related_tests"], "file_id")} == set(range(10))
    used = model.symbols.join(model.refs.select("name"), "name", "left_semi")
    assert {i % 4 for i in ids(told["o2_limit_before_filter"], "symbol_id")} == {i % 4 for i in ids(used, "symbol_id")} > {1}
    assert told["j17_path_suffixes"].count() == len({"/".join(p.split("/")[-2:]) for p in ids(model.files, "path")})
    assert ids(told["f27_compact_numbers"], "event_id") == ids(model.table("events"), "event_id")


def test_orders_behind_the_first_are_asked(spark, sf_dir, model):
    named = {r["name"] for r in model.symbols.select("name").distinct().collect()}
    asked = {(c % 20, w) for k, c in model.table("orders").select("o_orderkey", "o_custkey").collect() for w in ["get" if k % 3 == 0 else f"load{c}"] if w in named}
    symbols = {r["symbol_id"]: r["name"] for r in model.symbols.select("symbol_id", "name").collect()}
    assert {(r["query_id"], symbols[r["symbol_id"]]) for r in _seeds(model).collect()} == asked


def test_halves_are_rounded_alike(spark):
    """Numbers halfway between two decimals, in both engines."""
    numbers = [100 * k + 50 for k in range(9, 10_000)] + [100_000 * k + 50_000 for k in range(9, 3000)]
    told = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", text.compact_number(F.col("n"))).collect()
    want = duckdb.sql(f"SELECT n, CASE WHEN n >= 1000000 THEN printf('%.1fM', round(n / 1000000, 1)) WHEN n >= 1000 THEN printf('%.1fk', round(n / 1000, 1)) ELSE n::VARCHAR END FROM (SELECT unnest({numbers}) AS n)").fetchall()
    assert sorted(map(tuple, told)) == sorted(want)
