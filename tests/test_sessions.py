from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pipeloom.functions import compat
from pipeloom.plans.engine import Engine, EngineError
from pipeloom.sources import tables


def test_engine_formats_and_errors(spark):
    with Engine(spark) as e:
        e.register(t=spark.createDataFrame([(1, "a"), (2, None)], "x int, y string"))
        assert sorted(r["line"] for r in e.query("SELECT * FROM t WHERE x >= :n", "CSV", {"n": 2}).collect()) == ["2,"]
        assert e.check("SELECT x FROM t") is None and "nope" in e.check("SELECT nope FROM t")
        assert e.pipe("t").where("x = 1").df.count() == 1
        for bad in ("", "  \n", "SELECT 1\0"):
            with pytest.raises(EngineError):
                e.frame(bad)
        with pytest.raises(EngineError, match="format"):
            e.query("SELECT 1", "Arrow")
    with pytest.raises(EngineError, match="closed"):
        e.frame("SELECT 1")


def test_tables(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, None)], "x int, y string")
    made = tables.create_table_as(df, "made_table", replace=True, bucket_by=(2, ["x"]))
    tables.insert_into(df, "made_table")
    tables.analyze(spark, "made_table")
    assert made.count() == 6 or spark.table("made_table").count() == 6
    tables.truncate(spark, "made_table")
    assert spark.table("made_table").count() == 0
    tables.drop(spark, "made_table")
    assert not spark.catalog.tableExists("made_table")
    assert sorted((r["column"], r["n"], r["nulls"], r["least"]) for r in tables.summarize(df).collect()) == [("x", 3, 0, "1"), ("y", 3, 1, "a")]
    assert tables.unmappable(spark, ["sum", "NoSuchThing", "mine"], {"MINE": F.sum}) == ["NoSuchThing"]
    parts = [tables.sample_bucket(spark.range(100).toDF("id"), b, 4, ["id"]).count() for b in (1, 2, 3, 4)]
    assert sum(parts) == 100 and min(parts) > 0
    assert tables.sample_rows(df, 2).collect() == tables.sample_rows(df.repartition(2), 2).collect()


def test_differences():
    assert compat.verdict("duckdb", ["log", "concat"]) is compat.Severity.WARNING
    assert compat.verdict("duckdb", ["abs"]) is compat.Severity.SAFE
    assert compat.verdict("mysql", ["string_comparison", "greatest"]) is compat.Severity.REFUSED
    assert [d.use for d in compat.differences("trino", ["least"])] == ["numbers.least_strict"]
    with pytest.raises(ValueError):
        compat.function("trino", "no_such_function")


def test_engine_functions(spark):
    x = spark.range(1).select(
        compat.integer_division(F.lit(-7), F.lit(2)).alias("q"),
        compat.integer_division(F.lit(1), F.lit(0)).alias("z"),
        compat.cast_rounding(F.lit(2.5)).alias("r"),
        compat.function("clickhouse", "splitByString")(".", F.lit("a.b")).alias("s"),
        compat.function("duckdb", "upper")(F.lit("a")).alias("u"),
    ).first()
    assert tuple(x) == (-3, None, 3, ["a", "b"], "A")
