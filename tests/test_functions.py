from __future__ import annotations

import datetime as dt
import math
import random
import tracemalloc
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from pipeloom.functions import collections as C
from pipeloom.functions import misc, numbers, temporal, text
from pipeloom.plans import shape


def one(spark, *cs):
    return tuple(spark.range(1).select(*cs).first())


def L(x):
    return F.lit(x)


def test_text(spark):
    assert one(spark, text.regexp_replace_first(L("aXbXc"), "X", "-"), text.regexp_replace_first(L("abc"), "X", "-")) == ("a-bXc", "abc")
    assert one(spark, text.split_literal(L("a.b..c"), ".")) == (["a", "b", "", "c"],)
    assert one(spark, text.code_points(L("aé€😀")), text.from_code_points(F.array(*map(L, (97, 233, 8364, 128512))))) == ([97, 233, 8364, 128512], "aé€😀")
    assert one(spark, text.contains_words(L("The quick, brown fox"), "FOX quick"), text.contains_words(L("a b"), "b c", every=False), text.contains_words(L("a b"), "b c")) == (True, True, False)
    assert one(spark, text.glob(L("ab.c"), "a?.[cd]"), text.glob(L("abxc"), "a?.c"), text.similar_to(L("abab"), "(ab)+"), text.similar_to(L("a.b"), "a._")) == (True, False, True, True)
    assert one(spark, text.hamming(L("abc"), L("abd")), text.hamming(L("ab"), L("abc")), F.round(text.jaro_winkler(L("MARTHA"), L("MARHTA")), 4)) == (1, None, 0.9611)
    assert one(spark, text.normalize(L("é"), L("NFC")), text.decompress_string(text.compress(L("hello"))), text.from_base32(text.to_base32(L("hi")))) == ("é", "hello", "hi")
    assert one(spark, text.concat_skipping_nulls(L("a"), L(None), L("b")), text.initcap_delimited(L("o'neil mc-x"), " '-"), text.substring_zero(L("abc"), 0, 2)) == ("ab", "O'Neil Mc-X", "a")
    assert int(one(spark, text.md5_upper64(L("a")))[0]) == int("0cc175b9c0f1b6a8", 16)


def test_numbers(spark):
    a, b = F.array(L(1.0), L(2.0)), F.array(L(2.0), L(0.0))
    assert one(spark, numbers.dot_product(a, b), numbers.manhattan_distance(a, b), F.round(numbers.euclidean_distance(a, b), 6)) == (2.0, 3.0, 2.236068)
    assert one(spark, numbers.cosine_similarity(a, F.array(L(0.0), L(0.0))), numbers.truncate(L(-1.29), 1), numbers.truncate(L(2.9))) == (None, -1.2, 2.0)
    assert one(spark, numbers.range_bucket(L(5), [1, 5, 9]), numbers.range_n(L(25), 1, 100, 10), numbers.greatest_strict(L(1), L(None)), numbers.xor(L(True), L(False))) == (2, 3, None, True)
    assert math.isclose(one(spark, numbers.haversine_m(L(0.0), L(0.0), L(0.0), L(1.0)))[0], 111195.08, rel_tol=1e-6)
    z = spark.range(2000).select(numbers.zipf(1.0, 5, 3).alias("z")).groupBy("z").count().orderBy("z").collect()
    assert [r["z"] for r in z] == [1, 2, 3, 4, 5] and z[0]["count"] > z[4]["count"]


def test_collections(spark):
    a = F.array(*map(L, (1, 2, 3, 4)))
    assert one(spark, C.array_remove_at(a, 1), C.array_remove_at(a, -1), C.array_slice0(a, 1, 3)) == ([1, 3, 4], [1, 2, 3], [2, 3])
    assert one(spark, C.array_windows(a, 3), C.array_windows(a, 9), C.comprehension(a, lambda x: x * x, lambda x: x > 2)) == ([[1, 2, 3], [2, 3, 4]], [], [9, 16])
    assert one(spark, C.get_ignore_case(F.create_map(L("Ab"), L(1)), "aB"), C.get_ignore_case(F.create_map(L("Ab"), L(1)), "x")) == (1, None)
    same = C.minhash_similarity(C.minhash(a), C.minhash(a))
    assert one(spark, same, C.jaccard(a, F.array(L(1), L(9)))) == (1.0, 0.2)


def test_json(spark):
    j = L('{"a":{"b":[1,null]},"c":null}')
    assert one(spark, C.json_set(j, "$.a.x", 5)) == ('{"a":{"b":[1,null],"x":5},"c":null}',)
    assert one(spark, C.json_remove(j, "$.a.b[0]", "$.c"), C.json_strip_nulls(j)) == ('{"a":{"b":[null]}}', '{"a":{"b":[1,null]}}')
    assert one(spark, C.json_keys_at_depth(j, 2), C.json_contains(j, '{"a":{"b":[1]}}'), C.json_contains(j, '{"a":2}')) == (["a", "a.b", "c"], True, False)
    assert one(spark, C.json_exists(j, "$.c"), C.json_exists(j, "$.d"), C.check_json(L("{")), C.check_json(j)) == (True, False, "invalid JSON", None)
    assert one(spark, C.json_has_all_keys(j, "a", "c"), C.json_has_all_keys(j, "a", "d"), C.json_array_contains(L("[1,2]"), 2), C.json_array_append(L('{"a":[1]}'), "$.a", 2)) == (True, False, True, '{"a":[1,2]}')


def test_temporal(spark):
    d = L(dt.date(2024, 2, 28))
    assert one(spark, temporal.week_start(d), temporal.week_start(d, "SUNDAY"), temporal.previous_day(d, "MON"), temporal.last_day_of("month", d), temporal.last_day_of("quarter", d)) == (dt.date(2024, 2, 26), dt.date(2024, 2, 25), dt.date(2024, 2, 26), dt.date(2024, 2, 29), dt.date(2024, 3, 31))
    ts = L(dt.datetime(2024, 1, 1, 0, 7)).cast("timestamp_ntz")
    assert one(spark, temporal.time_slice(ts, 300), temporal.time_slice(ts, 300, end=True), temporal.to_days(L(dt.date(1970, 1, 2)))) == (dt.datetime(2024, 1, 1, 0, 5), dt.datetime(2024, 1, 1, 0, 10), 719529)
    assert one(spark, *temporal.justify_hours(L(1), L(90000)), *temporal.justify_days(L(0), L(65))) == (2, 3600, 2, 5)
    weeks = [dt.date(2023, 1, 1), dt.date(2024, 1, 1), dt.date(2024, 1, 7)]
    assert one(spark, *[temporal.week_of_year(L(x)) for x in weeks]) == tuple(int(x.strftime("%U")) for x in weeks)


def test_addresses(spark):
    assert one(spark, misc.ipv4_number(L("1.2.3.4")), misc.ipv4_number(L("1.2.3.400")), misc.ipv4_text(L(16909060)), misc.ipv4_in(L("10.1.2.3"), "10.1.0.0/16")) == (16909060, None, "1.2.3.4", True)
    u = L("https://A.b.co.uk/x?q=1")
    assert one(spark, misc.host(u), misc.registered_domain(u, ["uk", "co.uk"]), misc.url_parameter(u, "q")) == ("a.b.co.uk", "b.co.uk", "1")
    assert one(spark, misc.xml_valid(L("<a><b/></a>")), misc.xml_valid(L("<a>")), misc.xml_element("a", L("x<y"), attributes={"k": L("v")})) == (True, False, '<a k="v">x&lt;y</a>')


def test_shapes(spark):
    schema = StructType().add("a", IntegerType()).add("b", "string")
    assert shape.compare(schema, {"A": "int", "b": None}).verdict is shape.Verdict.SATISFIES
    assert shape.compare(schema, {"a": "int"}).additional == ("b",)
    assert shape.compare(schema, {"a": "bigint", "z": None}).verdict is shape.Verdict.HAS_LESS
    f = shape.Fragment("SELECT a + :n AS x FROM {src} WHERE b = :s", ("n", "s"), ("src",), {"s": "p"})
    assert f.shape(spark, {"src": schema}, n=1).simpleString() == "struct<x:int>"
    assert f.bind(spark, {"src": spark.createDataFrame([(1, "p"), (2, "q")], schema)}, n=10).collect()[0]["x"] == 11
    for bad in ({"nope": spark.range(1)}, {}):
        try:
            f.bind(spark, bad, n=1)
            raise AssertionError
        except ValueError:
            pass
    df = spark.createDataFrame([(1, None)], schema)
    assert shape.observed_nullability(df.select("a", "b", F.lit(1).alias("c"))) == {"a": None, "b": True, "c": False}


def test_dependencies(spark):
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(1, 3, 4)], "k int, z int, u int")
    found = shape.dependencies(lambda a, b: a.join(b, a["x"] == b["k"]).selectExpr("x", "y + z AS s"), {"a": a, "b": b})
    assert found["s"] == ["a.x", "a.y", "b.k", "b.z"] and "b.u" not in found["s"]


def test_vector_search_takes_more_queries_than_a_block(spark):
    base = spark.createDataFrame([(i, [float(i * i % 23), float(i)]) for i in range(40)], "id int, v array<double>")
    queries = base.where("id < 25").unionByName(spark.createDataFrame([(None, [1.0, 2.0])], base.schema))
    found = lambda n: sorted(map(tuple, misc.vector_search(base, queries, "v", "id", "id", 3, "euclidean", n).collect()), key=str)
    assert len(found(100)) == 26 * 3 and found(4) == found(100)


@pytest.mark.parametrize("distance", ["euclidean", "cosine", "dot", "manhattan"])
def test_vector_search_equals_all_pairs(spark, monkeypatch, distance):
    """Against Spark's own distances, with ties, nulls, unlike lengths, zeros, NaN and huge values; no join makes all pairs."""
    monkeypatch.setattr(misc, "BLOCK", 16)
    rng = random.Random(5)
    rows = [(i, [float(rng.randrange(4)) for _ in range(3)]) for i in range(60)] + [(60, None), (61, [1.0, None, 2.0]), (62, [1.0, 2.0]), (63, [0.0] * 3)]
    odd = [(64, [float("nan"), 1.0, 1.0]), (65, [1e200, 1.0, 1.0]), (66, [1e-170, 0.0, 0.0])]
    of = {"euclidean": numbers.euclidean_distance, "cosine": numbers.cosine_distance, "manhattan": numbers.manhattan_distance, "dot": lambda a, b: -numbers.dot_product(a, b)}[distance]
    for some in (rows, rows + odd):
        base = spark.createDataFrame(some, "id long, v array<double>")
        pairs = base.crossJoin(base.select(F.col("id").alias("query_id"), F.col("v").alias("q"))).select("query_id", F.col("id").alias("match_id"), of(F.col("v"), F.col("q")).alias("distance"))
        got = lambda df: sorted((r["query_id"], r["rank"], r["match_id"], str(r["distance"])) for r in df.collect())
        found = misc.vector_search(base, base, "v", "id", "id", 5, distance, 30)
        assert got(found) == got(misc.top_matches(pairs, 5))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_text_codecs_hold_few_rows_as_objects():
    """Python objects of 4000 texts of 20 kB, 80 MB, are never there at once; rows, nulls and lengths stay."""
    texts = [None if i % 9 == 0 else chr(97 + i % 26) * 20_000 + "e\u0301" for i in range(4000)]
    column, forms = pa.array(texts), pa.array(["NFC"] * 4000)
    for f, args, want in ((text.normalize, (column, forms), [t and unicodedata.normalize("NFC", t) for t in texts]), (text.decompress_string, (text.compress.func(column),), texts)):
        tracemalloc.start()
        found = f.func(*args)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 20e6 and found.to_pylist() == want
