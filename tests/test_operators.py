from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pipeloom.functions import numbers
from pipeloom.operators import aggregates, changes, joins, matching, recursion, sets, sorting, windows
from pipeloom.plans import catalog
from pipeloom.sources import files
from pipeloom.streaming import windows as event_windows


def got(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_asof_ties_nulls_and_clashes(spark):
    left = spark.createDataFrame([(1, 5, "l"), (1, 1, "m"), (None, 5, "n"), (2, None, "o")], "k int, t int, v string")
    right = spark.createDataFrame([(1, 5, "a", 1), (1, 5, "b", 2), (1, 2, "c", 3), (None, 1, "d", 4)], "k int, t int, v string, id int")
    out = joins.asof_join(left, right, ["k"], "t", "t", tie="id").select("v", "v_r", "id")
    assert got(out) == [("l", "b", 2), ("m", None, None), ("n", None, None), ("o", None, None)]
    assert got(joins.asof_join(left, right, ["k"], "t", "t", how="inner", strict=True, tie="id").select("v", "v_r")) == [("l", "c")]


def test_positional_and_numbered(spark):
    a, b = spark.range(10).toDF("x"), spark.range(3).toDF("x")
    out = joins.positional_join(a, b, ["x"], [F.col("x").desc()], parts=3)
    assert got(out.where("x_r IS NOT NULL")) == [(0, 2), (1, 1), (2, 0)] and out.count() == 10


def test_range_join_equals_theta(spark):
    points = spark.createDataFrame([(i, i * 0.7) for i in range(40)], "p int, x double")
    spans = spark.createDataFrame([(i, i * 1.5, i * 1.5 + (i % 5)) for i in range(20)] + [(99, 5.0, 1.0)], "s int, lo double, hi double")
    theta = points.join(spans, F.col("x").between(F.col("lo"), F.col("hi"))).select("p", "s")
    assert got(joins.range_join(points, spans, "x", "lo", "hi", 2.0).select("p", "s")) == got(theta)


def test_any_join_and_array_join(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    b = spark.createDataFrame([(1, 3, "c"), (1, 2, "b")], "k int, o int, v string")
    assert got(joins.any_join(a, b, ["k"], ["o"])) == [(1, 2, "b"), (2, None, None)]
    c = spark.createDataFrame([(1, [1, 2], ["a"]), (2, [], [])], "k int, x array<int>, y array<string>")
    assert got(joins.array_join(c, {"i": "x", "s": "y"}).select("k", "i", "s")) == [(1, 1, "a"), (1, 2, None)]
    assert joins.array_join(c, {"i": "x"}, outer=True).count() == 3


def test_set_modes(spark):
    a = spark.createDataFrame([(1, "p"), (1, "p"), (2, "q")], "x int, y string")
    b = spark.createDataFrame([("p", 1)], "y string, x int")
    assert got(sets.intersect_by_name(a, b)) == [(1, "p")]
    assert got(sets.except_by_name(a, b, all=True)) == [(1, "p"), (2, "q")]
    assert got(sets.on_columns(a, b, ["y"], "except")) == [(2, "q")]


def test_having_max_totals_and_each(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("a", 2, 7), ("b", 1, None), (None, 1, 2)], "g string, o int, v int")
    assert got(aggregates.having_max(df, ["g"], F.sum("v"), "o", "s")) == [("a", 13), ("b", None), (None, 2)]
    out = aggregates.with_totals(df, ["g"], "count(*) AS n")
    assert got(out.where("is_total")) == [(None, 5, True)] and out.count() == 4
    each = spark.createDataFrame([(1, [1, 2]), (1, [10])], "k int, a array<int>")
    assert got(aggregates.agg_for_each(each, ["k"], "a", "sum", "s").selectExpr("k", "to_json(s)")) == [(1, "[11,2]")]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_range_join_cuts_large_bins(spark, monkeypatch, how):
    """One value for most rows: more tasks than bins, and the same rows as a join by the condition; keys and nulls too."""
    monkeypatch.setattr(joins, "PAIRS", 50, raising=False)
    points = spark.createDataFrame([(i, i % 2, 5.0 if i % 4 else None if i % 8 else float(i)) for i in range(80)], "p int, k int, x double")
    spans = spark.createDataFrame([(i, i % 2, 4.0 - i % 3, 5.0 + i % 5) for i in range(40)], "s int, k int, lo double, hi double")
    theta = points.alias("a").join(spans.alias("b"), F.expr("a.k = b.k AND x BETWEEN lo AND hi"), how).select("p", "s")
    out = joins.range_join(points, spans, "x", "lo", "hi", 4.0, ["k"], how).select("p", "s")
    assert got(out) == got(theta)
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()


def test_exclude_frames(spark):
    df = spark.createDataFrame([(1, 1, 2), (1, 1, 3), (1, 2, None), (1, 3, 4)], "p int, o int, v int")
    assert got(windows.exclude(df, "v", "s", ["p"], ["o"], "group").select("o", "v", "s")) == [(1, 2, 4), (1, 3, 4), (2, None, 9), (3, 4, 5)]
    assert got(windows.exclude(df, "v", "s", ["p"], ["o"], "ties").select("o", "v", "s")) == [(1, 2, 6), (1, 3, 7), (2, None, 9), (3, 4, 9)]


@pytest.mark.parametrize("agg", ["sum", "count", "min", "max", "avg"])
def test_exclude_equals_sql_with_ties_and_goes_forward_only(spark, agg):
    """Open and bounded frames against DuckDB; no frame reaches from the row on to the end, which takes the square of a partition."""
    duck = pytest.importorskip("duckdb").connect()
    rng = random.Random(7)
    rows = [(i, i % 3, rng.randrange(4), None if i % 7 == 0 else rng.randrange(100)) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, p int, o int, v int")
    duck.execute("CREATE TABLE t (id int, p int, o int, v int)")
    duck.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", rows)
    bound = lambda n, side: f"UNBOUNDED {side}" if abs(n) > 99 else f"{abs(n)} {side}" if n else "CURRENT ROW"
    first, last = windows.Window.unboundedPreceding, windows.Window.unboundedFollowing
    for what, order, lo, hi in (("current row", "o, id", first, last), ("current row", "o, id", -2, last), ("current row", "o, id", first, 1), ("group", "o", first, last), ("ties", "o", first, last), ("group", "o, id", -2, last), ("ties", "o, id", first, 3)):
        out = windows.exclude(df, "v", "s", ["p"], order.split(", "), what, lo, hi, agg)
        assert "unboundedfollowing" not in out._jdf.queryExecution().optimizedPlan().toString().lower().replace("unboundedpreceding$(), unboundedfollowing", "")
        sql = duck.sql(f"SELECT id, {agg}(v) OVER (PARTITION BY p ORDER BY {order} ROWS BETWEEN {bound(lo, 'PRECEDING')} AND {bound(hi, 'FOLLOWING')} EXCLUDE {what}) AS s FROM t").fetchall()
        near = lambda rows: {i: x if x is None else round(float(x), 9) for i, x in rows}
        assert near(map(tuple, out.select("id", "s").collect())) == near(sql), (what, lo, hi)
    tied = windows.exclude(df, "v", "s", ["p"], ["o"], agg=agg)
    alone = {i: [x for j, q, _, x in rows if q == p and j != i and x is not None] for i, p, _, _ in rows}
    fold = {"sum": sum, "count": len, "min": min, "max": max, "avg": lambda x: sum(x) / len(x)}[agg]
    assert {r["id"]: r["s"] for r in tied.collect()} == {i: fold(x) for i, x in alone.items()}


def test_exclude_frames_share_one_sort(spark):
    df = spark.createDataFrame([(i % 3, i, float(i)) for i in range(30)], "p int, o int, v double")
    first, last = windows.Window.unboundedPreceding, windows.Window.unboundedFollowing
    for name, agg, what, lo, hi in (("a", "avg", "current row", -2, 1), ("b", "min", "group", first, 0), ("c", "max", "ties", -2, 2), ("d", "count", "group", -3, last)):
        df = windows.exclude(df, "v", name, ["p"], ["o"], what, lo, hi, agg)
    df.collect()
    assert df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Sort [") == 1


@pytest.mark.parametrize(("name", "table"), [("window_exclude_frames", "lineitem"), ("window_exclude_ties", "events")])
def test_exclude_takes_as_many_tasks_as_rows_ask_for(spark, monkeypatch, name, table):
    """One shuffle, in a number of tasks that follows the rows, and rows as without it."""
    whole = spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").count()
    run = lambda: catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    want = got(run())
    monkeypatch.setattr(windows, "TASK_ROWS", 50, raising=False)
    plan = run()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and f", {-(-whole // 50)}), REPARTITION_BY_NUM" in plan
    assert got(run()) == want


def test_deal_keeps_partitions_together(spark):
    df = spark.createDataFrame([(None if i % 5 == 0 else i % 7, i) for i in range(100)], "p int, i int")
    parts = windows.deal(df, ["p + 1"]).withColumn("part", F.spark_partition_id())
    assert got(parts.select("p", "i")) == got(df) and parts.select("p", "part").distinct().count() == 8
    assert windows.deal(df.limit(0), ["p"]).count() == 0 and windows.deal(df, []) is df


def test_deal_sorts_for_more_tasks_only_where_rows_are_many(spark, monkeypatch):
    monkeypatch.setattr(windows, "TASK_ROWS", 100)
    parts = lambda n: windows.deal(spark.range(n), ["id"]).rdd.getNumPartitions()
    assert [parts(n) for n in (50, 1000, 19_950, 150_000, 170_000)] == [4, 10, 200, 200, 213]


def test_ties_percent_fill(spark):
    df = spark.createDataFrame([(i, i // 2) for i in range(10)], "id int, v int")
    assert sorting.limit_with_ties(df, 3, ["v DESC"]).count() == 4
    assert sorting.limit_percent(df, 25, ["id"]).count() == 2
    filled = sorting.with_fill(spark.createDataFrame([(1, 5), (4, 7)], "k int, v int"), "k", F.lit(0), F.lit(6), F.lit(1), interpolate=["v"])
    assert got(filled) == [(0, None), (1, 5), (2, 5), (3, 5), (4, 7), (5, 7)]


def test_hierarchy_with_cycle(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2), (5, 6), (6, 5)], "id int, up int")
    out = recursion.connect_by(df, "id", "up", "up IS NULL OR id = 5")
    assert got(out.select("path", "level", "is_cycle")) == [("1", 1, False), ("1/2", 2, False), ("1/2/3", 3, False), ("5", 1, False), ("5/6", 2, False), ("5/6/5", 3, True)]
    assert got(recursion.closure(spark.createDataFrame([(1, 2), (2, 3)], "a int, b int"), "a", "b")) == [(1, 2), (1, 3), (2, 3)]
    steps = recursion.recursive(spark.range(1), lambda d: d.selectExpr("(id + 1) % 4"), distinct=True)
    assert got(steps) == [(0,), (1,), (2,), (3,)]


def test_recursion_depth_is_no_silent_cut(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(4)], "id int, up int")
    assert recursion.connect_by(chain, "id", "up", "up IS NULL", max_depth=4).count() == 4
    with pytest.raises(ValueError, match="3 levels"):
        recursion.connect_by(chain, "id", "up", "up IS NULL", max_depth=3)
    step = lambda d: d.selectExpr("id + 1").where("`(id + 1)` < 4")
    assert got(recursion.recursive(spark.range(1), step, max_depth=3)) == [(0,), (1,), (2,), (3,)]
    with pytest.raises(ValueError, match="2 steps"):
        recursion.recursive(spark.range(1), step, max_depth=2)


def test_match_positions(spark):
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate("abbxabx")], "p int, i int, c string")
    out = matching.match_recognize(df, ["p"], ["i"], {"A": "c = 'a'", "B": "c = 'b'"}, "AB+", {"lo": ("first", "i", ""), "hi": ("last", "i", ""), "bs": ("count", "", "B")})
    assert got(out) == [(1, 1, 0, 2, 2), (1, 2, 4, 5, 1)]


def test_merge_clauses(spark):
    t = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "k int, v int")
    s = spark.createDataFrame([(2, 20), (3, 30), (4, 40)], "k int, v int")
    out = changes.merge(t, s, ["k"], [changes.Matched(None, "s.v = 30"), changes.Matched({"v": "t.v + s.v"})], {"k": "s.k", "v": "s.v"})
    assert got(out) == [(1, 1), (2, 22), (4, 40)]
    assert got(changes.merge(t, s, ["k"], [], None, delete_unmatched=True)) == [(2, 2), (3, 3)]
    with pytest.raises(Exception, match="several source rows"):
        changes.merge(t, s.union(s), ["k"], [changes.Matched({"v": "s.v"})]).collect()
    assert got(changes.upsert(t, s, ["k"], do_nothing=True)) == [(1, 1), (2, 2), (3, 3), (4, 40)]
    assert got(changes.update(t, {"v": "NULL"}, "k = NULL")) == got(t)


def test_json_and_xml_tables(spark):
    df = spark.createDataFrame([(1, '{"a":[{"x":1,"y":"p"},{"x":2}]}'), (2, None)], "id int, j string")
    out = files.json_table(df, "j", "$.a", {"x": ("int", "$.x"), "y": ("string", "$.y")}, ordinality="n")
    assert got(out.select("id", "n", "x", "y")) == [(1, 1, 1, "p"), (1, 2, 2, None)]
    x = spark.createDataFrame([(1, "<r><i><a>1</a><b>u</b></i><i><a>2</a><b>v</b></i></r>")], "id int, x string")
    assert got(files.xml_table(x, "x", "/r/i", {"a": ("int", "a/text()"), "b": ("string", "b/text()")}).select("a", "b")) == [(1, "u"), (2, "v")]


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "x int, y string")
    for kind in ("csv", "json", "parquet", "orc"):
        files.copy_to(df, str(tmp_path / kind), kind)
        assert got(spark.read.schema("x int, y string").format(kind).load(str(tmp_path / kind))) == [(1, "a"), (2, None)]
    assert got(files.formatted(df, "JSONEachRow")) == [('{"x":1,"y":"a"}',), ('{"x":2,"y":null}',)]
    assert got(files.formatted(df, "JSONCompactEachRow")) == [('[1,"a"]',), ("[2,null]",)]


def test_gap_fill_and_stream_windows(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(minutes=m)) for i, m in enumerate((1, 2, 190))]
    df = spark.createDataFrame(rows, "id int, ts timestamp")
    out = event_windows.gap_filled(df.withColumn("k", F.lit(1)), "ts", "1 HOUR", ["k"], F.count("*"), "n", "locf")
    assert [r["n"] for r in out.orderBy("bin").collect()] == [2, 2, 2, 1]
    df.write.parquet(str(tmp_path / "e"))
    stream = files.stream(spark, str(tmp_path / "e"), "id int, ts timestamp")
    q = event_windows.windowed(stream, "ts", "1 hour", F.count("*").alias("n"), late="10 minutes").writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["n"] for r in spark.table("w").collect()) == [1, 2]


def test_stream_results_stand_in_shared_files(spark, tmp_path):
    event = lambda *ks: spark.createDataFrame([(k, i) for i, k in enumerate(ks)], "k int, i int").coalesce(1)
    event(1, 1, 2).write.parquet(str(tmp_path / "e"))
    event(2, 3).write.mode("append").parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("k int, i int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e"))
    counts = event_windows.run_to_table(stream.groupBy("k").agg(F.count("*").alias("n")), "stream_counts")
    keys = event_windows.run_to_table(stream.select("k").dropDuplicates(["k"]), "stream_keys", "append")
    assert got(counts) == [(1, 2), (2, 2), (3, 1)] and got(keys) == [(1,), (2,), (3,)] == got(spark.table("stream_keys"))
    shared = spark.conf.get("spark.checkpoint.dir")
    assert all(f.removeprefix("file://").startswith(shared) for x in (counts, keys) for f in x.inputFiles())
    assert counts.inputFiles() and keys.inputFiles()
    (tmp_path / "none").mkdir()
    assert event_windows.run_to_table(spark.readStream.schema("k int").parquet(str(tmp_path / "none")), "stream_none", "append").count() == 0


def test_merge_looks_at_matched_rows_only(spark):
    target = spark.createDataFrame([(1, 10), (None, 20)], "k int, v int")
    free = spark.createDataFrame([(None, 1), (None, 2), (7, 3), (7, 4), (1, 5)], "k int, v int")
    clause = [changes.Matched({"v": "t.v + s.v"})]
    out = changes.merge(target, free, ["k"], clause, {"k": "s.k", "v": "s.v"})
    assert got(out) == sorted([(1, 15), (None, 20), (None, 1), (None, 2), (7, 3), (7, 4)], key=str)
    twice = spark.createDataFrame([(1, 1), (1, 2)], "k int, v int")
    with pytest.raises(Exception, match="several source rows"):
        changes.merge(target, twice, ["k"], clause).collect()


def test_exclude_keeps_nan_and_digits_to_their_rows(spark):
    df = spark.createDataFrame([(1, 1e16), (2, 1.0), (3, float("nan")), (4, 2.0)], "o int, v double")
    seen = {r["o"]: r["s"] for r in windows.exclude(df.where("o <> 1"), "v", "s", [], ["o"]).collect()}
    assert seen[3] == 3.0 and seen[2] != seen[2]
    assert {r["o"]: r["s"] for r in windows.exclude(df.where("o <> 3"), "v", "s", [], ["o"]).collect()}[1] == 3.0


def test_deep_chains_are_errors_not_losses(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(8)], "id int, parent int")
    assert recursion.connect_by(chain, "id", "parent", "parent IS NULL", max_depth=8).count() == 8
    with pytest.raises(ValueError, match="3 levels"):
        recursion.connect_by(chain, "id", "parent", "parent IS NULL", max_depth=3)
    with pytest.raises(ValueError, match="3 steps"):
        recursion.recursive(spark.range(1), lambda d: d.selectExpr("id + 1 AS id").where("id < 8"), max_depth=3)


def test_percentiles_by_ranks(spark):
    rng = random.Random(2)
    data = [(rng.choice(["a", "b", None]), rng.choice([None, *map(float, range(9))])) for _ in range(300)] + [("one", 4.0)]
    df = spark.createDataFrame(data, "g string, v double")
    want = df.groupBy("g").agg(*[F.percentile("v", p).alias(f"p{i}") for i, p in enumerate((0.0, 0.3, 0.5, 0.99))])
    assert got(aggregates.percentiles(df, ["g"], "v", p0=0.0, p1=0.3, p2=0.5, p3=0.99)) == got(want)


def test_patterns_with_names_and_gaps(spark):
    df = spark.createDataFrame([("x", i, c) for i, c in enumerate("abbxabab")], "p string, i int, c string")
    define = {"START": "c = 'a'", "NEXT": "c = 'b'"}
    one = matching.match_recognize(df, ["p"], ["i"], define, "START NEXT+", {"lo": ("first", "i", ""), "n": ("count", "", "NEXT")})
    assert got(one.select("match_number", "lo", "n")) == [(1, 0, 2), (2, 4, 1), (3, 6, 1)]
    rows = matching.match_recognize(df, ["p"], ["i"], define, "START NEXT+", all_rows=True)
    assert [(r["i"], r["match_number"], r["classifier"]) for r in rows.orderBy("i").collect()][:3] == [(0, 1, "START"), (1, 1, "NEXT"), (2, 1, "NEXT")] and rows.count() == 7
    for bad in ({"pattern": "OTHER"}, {"pattern": "START", "after": "never"}):
        with pytest.raises(ValueError):
            matching.match_recognize(df, ["p"], ["i"], define, **bad)


def test_hash_of_repeated_rows(spark):
    one, two = spark.createDataFrame([(1,), (2,)], "x int"), spark.createDataFrame([(1,), (2,), (1,), (2,)], "x int")
    h = lambda df: df.agg(numbers.hash_agg(F.col("x"))).first()[0]
    assert h(one) != h(two) and h(two) != h(two.limit(0)) and h(one) == h(one.orderBy(F.desc("x")))


def test_spooled_tables_can_be_cleared(spark):
    from pathlib import Path

    from pipeloom.sources import spool

    kept = spool.written(spark.range(3), "short_lived")
    assert kept.count() == 3 and Path(spool.shared(spark)).exists()
    spool.clear(spark)
    assert not Path(spool.shared(spark)).exists()
