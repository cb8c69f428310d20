from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pipeloom.plans.pipe import TABLE_FUNCTIONS, Pipe, PipeError, ordering, table_function


@pytest.fixture
def t(spark):
    return Pipe(spark.createDataFrame([(1, "x", 10), (2, "y", None), (2, None, 5), (4, "x", 5)], "a int, b string, c int"))


def rows(p: Pipe) -> list[tuple]:
    return [tuple(r) for r in p.df.collect()]


def test_two_wheres_are_one_conjunction(t):
    assert rows(t.where("a > 1").where("c = 5").select("a", "b")) == [(2, None), (4, "x")]


def test_set_keeps_order_and_types(t):
    out = t.set(a="a + 1")
    assert out.df.columns == ["a", "b", "c"] and out.df.schema["a"].dataType.simpleString() == "int"
    assert [r[0] for r in rows(out)] == [2, 3, 3, 5]


@pytest.mark.parametrize("stage", [lambda p: p.set(z="1"), lambda p: p.rename(z="y"), lambda p: p.drop("z"), lambda p: p.call("nothing")])
def test_unknown_names_are_errors(t, stage):
    with pytest.raises(PipeError, match="stage 1"):
        stage(t)


def test_shapes_follow_stages(t):
    out = t.drop("c").rename(b="label").extend("a * 2 AS d")
    assert [s.names for s in out.shapes] == [["a", "b", "c"], ["a", "b"], ["a", "label"], ["a", "label", "d"]]


def test_aggregate_puts_groups_first(t):
    out = t.aggregate("sum(a) AS s", group_by="b")
    assert out.df.columns == ["b", "s"] and out.df.schema["s"].dataType.simpleString() == "bigint"
    assert sorted(rows(out), key=str) == [("x", 5), ("y", 2), (None, 2)]
    assert rows(t.where("a > 100").aggregate("count(*) AS n")) == [(0,)]


def test_limit_then_where_is_sequential(t):
    assert rows(t.order_by("a", "c").limit(1).where("a > 1")) == []
    assert [r[0] for r in rows(t.select("a").order_by("a").offset(1).offset(1))] == [2, 4]


def test_window_total_is_bigint(t):
    out = t.window("sum(a) OVER () AS total")
    assert out.df.schema["total"].dataType.simpleString() == "bigint" and {r[3] for r in rows(out)} == {9}


def test_calls_nest_and_registry(t):
    @table_function("plus_one")
    def plus_one(df, column):
        return df.withColumn(column, F.col(column) + 1)

    assert [r[0] for r in rows(t.call("plus_one", "a").call("PLUS_ONE", "a"))] == [3, 4, 4, 6]
    del TABLE_FUNCTIONS["plus_one"]


def test_union_by_name_and_modes(t, spark):
    other = spark.createDataFrame([(9, 8)], "c int, z int")
    assert rows(t.union(other, by_name=True))[-1] == (None, None, 9, 8)
    assert rows(t.union(other, by_name=True, mode="inner"))[-1] == (9,)
    assert rows(t.union(other, by_name=True, mode="left"))[-1] == (None, None, 9)
    with pytest.raises(ValueError):
        t.union(other, by_name=True, mode="strict")


def test_ordering_texts(t):
    assert [r[2] for r in rows(t.order_by("c DESC NULLS FIRST", "a"))] == [None, 10, 5, 5]
    assert "DESC NULLS LAST" in str(ordering("c desc"))


def test_fork_and_tee(t):
    seen = []
    a, b = t.tee(lambda df: seen.append(df.count())).fork(lambda p: p.where("a = 1"), lambda p: p.where("a > 1"))
    assert (a.count(), b.count(), seen) == (1, 3, [4])


def test_pipe_sql_head(spark, t):
    out = Pipe.sql(spark, "FROM {t} |> WHERE a > :x |> SELECT a", {"x": 1}, t=t.df)
    assert sorted(rows(out)) == [(2,), (2,), (4,)]


def test_stages_work_on_streams(spark, tmp_path):
    spark.range(5).withColumn("g", F.col("id") % 2).write.parquet(str(tmp_path / "in"))
    stream = Pipe(spark.readStream.schema("id long, g long").parquet(str(tmp_path / "in")))
    out = stream.where("id > 0").extend("id * 2 AS d").rename(g="parity").drop("id")
    q = out.df.writeStream.format("memory").queryName("pipe_out").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.table("pipe_out").collect()) == [(0, 4), (0, 8), (1, 2), (1, 6)]
