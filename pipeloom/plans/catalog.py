"""Registered queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import collections as C
from ..functions import compat, misc, numbers, temporal, text
from ..operators import aggregates, changes, joins, matching, recursion, sets, sorting, windows
from ..sources import files, spool, tables
from ..streaming import windows as event_windows
from . import shape
from .engine import Engine
from .pipe import Pipe

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Tables of a folder as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in files.TABLES:
            raise AttributeError(name)
        return files.read_table(self.spark, self.sf_dir, name)

    def pipe(self, name: str) -> Pipe:
        return Pipe(getattr(self, name), head=f"FROM {name}")


def query(sql: str | None) -> Callable:
    def add(f: Callable[[Tables], DataFrame | Pipe]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(Tables(spark, sf_dir))
            return out.df if isinstance(out, Pipe) else out

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


REVENUE = "l_extendedprice * (1 - l_discount)"


# Pipe stages


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pipe_pricing_summary(t: Tables) -> Pipe:
    return t.pipe("lineitem").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00'").aggregate("round(sum(l_quantity), 2) AS sum_qty", "round(sum(l_extendedprice), 2) AS sum_base", f"round(sum({REVENUE}), 2) AS sum_disc", "round(avg(l_quantity), 6) AS avg_qty", "round(avg(l_discount), 6) AS avg_disc", "count(*) AS n", group_by=["l_returnflag", "l_linestatus"]).order_by("l_returnflag", "l_linestatus")


@query("SELECT o_orderkey, upper(o_orderpriority) AS priority FROM orders")
def pipe_select(t: Tables) -> Pipe:
    return t.pipe("orders").select("o_orderkey", "upper(o_orderpriority) AS priority")


@query("SELECT *, l_extendedprice * (1 - l_discount) AS net, l_quantity > 25 AS large FROM lineitem")
def pipe_extend(t: Tables) -> Pipe:
    return t.pipe("lineitem").extend(f"{REVENUE} AS net", "l_quantity > 25 AS large")


@query("SELECT * REPLACE (p_size + 1 AS p_size, lower(p_brand) AS p_brand) FROM part")
def pipe_set(t: Tables) -> Pipe:
    return t.pipe("part").set(p_size="p_size + 1", p_brand="lower(p_brand)")


@query("SELECT * EXCLUDE (c_acctbal, c_name) FROM customer")
def pipe_drop(t: Tables) -> Pipe:
    return t.pipe("customer").drop("c_acctbal", "c_name")


@query("SELECT r_regionkey AS id, r_name AS region FROM region")
def pipe_rename(t: Tables) -> Pipe:
    return t.pipe("region").rename(r_regionkey="id", r_name="region")


@query("SELECT n_name, n_regionkey FROM nation WHERE n_regionkey > 1 AND n_name LIKE '%A%'")
def pipe_where_twice(t: Tables) -> Pipe:
    return t.pipe("nation").as_("n").where("n.n_regionkey > 1").where("n_name LIKE '%A%'").select("n.n_name", "n.n_regionkey")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 50) WHERE o_orderstatus = 'O'")
def pipe_limit_then_where(t: Tables) -> Pipe:
    return t.pipe("orders").order_by("o_orderkey").limit(50).where("o_orderstatus = 'O'").select("o_orderkey")


@query("SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, min(o_orderdate) AS first_day FROM orders")
def pipe_aggregate_all(t: Tables) -> Pipe:
    return t.pipe("orders").aggregate("count(*) AS n", "round(sum(o_totalprice), 2) AS total", "min(o_orderdate) AS first_day")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def pipe_group_and_order(t: Tables) -> Pipe:
    return t.pipe("orders").aggregate("count(*) AS n", group_by=["o_orderstatus", "o_orderpriority"], and_order=True)


@query("SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def pipe_distinct(t: Tables) -> Pipe:
    return t.pipe("customer").select("c_mktsegment", "c_nationkey").distinct()


@query("SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC NULLS LAST, s_suppkey LIMIT 7 OFFSET 3")
def pipe_order_limit_offset(t: Tables) -> Pipe:
    return t.pipe("supplier").select("s_suppkey", "s_acctbal").order_by("s_acctbal DESC NULLS LAST", "s_suppkey").limit(7, 3)


@query("SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 5")
def pipe_offsets(t: Tables) -> Pipe:
    return t.pipe("customer").select("c_custkey").order_by("c_custkey").offset(2).offset(3).limit(10)


@query("""SELECT n_name, r_name, count(c_custkey) AS customers FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL""")
def pipe_joins(t: Tables) -> Pipe:
    return t.pipe("nation").join(t.region, "n_regionkey = r_regionkey").join(t.customer, "c_nationkey = n_nationkey", "left").aggregate("count(c_custkey) AS customers", group_by=["n_name", "r_name"])


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier UNION ALL SELECT n_nationkey FROM nation")
def pipe_union_many(t: Tables) -> Pipe:
    return t.pipe("customer").select("c_nationkey AS k").union(t.pipe("supplier").select("s_nationkey"), t.pipe("nation").select("n_nationkey"))


@query("SELECT n_nationkey AS k FROM nation INTERSECT SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def pipe_intersect_many(t: Tables) -> Pipe:
    return t.pipe("nation").select("n_nationkey AS k").intersect(t.pipe("customer").select("c_nationkey"), t.pipe("supplier").select("s_nationkey"))


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def pipe_except(t: Tables) -> Pipe:
    return t.pipe("nation").select("n_nationkey AS k").except_(t.pipe("supplier").where("s_acctbal > 5000").select("s_nationkey"))


def _above(df: DataFrame, column: str, value: float) -> DataFrame:
    return df.where(F.col(column) > value)


@query("SELECT p_partkey, p_retailprice, p_size FROM part WHERE p_retailprice > 950 AND p_size > 20")
def pipe_call(t: Tables) -> Pipe:
    return t.pipe("part").select("p_partkey", "p_retailprice", "p_size").call(_above, "p_retailprice", 950).call(_above, "p_size", 20, alias="x")


@query("SELECT o_orderkey, o_custkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS spent FROM orders")
def pipe_window(t: Tables) -> Pipe:
    return t.pipe("orders").window("round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS spent").select("o_orderkey", "o_custkey", "spent")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE ('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 15))::BIGINT % 10 = 2")
def pipe_tablesample(t: Tables) -> Pipe:
    return t.pipe("orders").select("o_orderkey", "o_custkey", "o_totalprice").tablesample(bucket=(3, 10, ["o_orderkey"]))


@query("SELECT c_custkey, c_name FROM customer ORDER BY md5('7|' || c_custkey || '|' || c_name) LIMIT 25")
def pipe_tablesample_rows(t: Tables) -> Pipe:
    return t.pipe("customer").select("c_custkey", "c_name").tablesample(rows=25, seed=7)


@query(None)
def pipe_tablesample_fraction(t: Tables) -> DataFrame:
    """How many of each order status are in a tenth, and that all of them are orders; fractions are Spark's own sampling."""
    some = t.pipe("orders").tablesample(0.1, seed=7).df.select("o_orderkey", "o_orderstatus")
    return some.join(t.orders.select("o_orderkey"), "o_orderkey", "left_semi").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("keys"))


@query("""SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O FROM orders GROUP BY ALL""")
def pipe_pivot(t: Tables) -> Pipe:
    return Pipe(t.pipe("orders").pivot(["o_orderpriority"], "o_orderstatus", ["F", "O"], "count(*)").df.fillna(0))


@query("""SELECT s_suppkey, name, value FROM (SELECT s_suppkey, CAST(s_nationkey AS DOUBLE) AS s_nationkey, s_acctbal FROM supplier) UNPIVOT (value FOR name IN (s_nationkey, s_acctbal))""")
def pipe_unpivot(t: Tables) -> Pipe:
    return t.pipe("supplier").select("s_suppkey", "double(s_nationkey) AS s_nationkey", "s_acctbal").unpivot(["s_suppkey"], ["s_nationkey", "s_acctbal"])


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY ALL")
def pipe_spark_sql_syntax(t: Tables) -> Pipe:
    return Pipe.sql(t.spark, "FROM {o} |> WHERE o_totalprice > :least |> AGGREGATE count(*) AS n GROUP BY o_orderstatus", {"least": 100000}, o=t.orders)


@query("SELECT 'big' AS kind, count(*) AS n FROM orders WHERE o_totalprice >= 150000 UNION ALL SELECT 'small', count(*) FROM orders WHERE o_totalprice < 150000")
def pipe_fork(t: Tables) -> DataFrame:
    big, small = t.pipe("orders").fork(lambda p: p.where("o_totalprice >= 150000").aggregate("'big' AS kind", "count(*) AS n"), lambda p: p.where("o_totalprice < 150000").aggregate("'small' AS kind", "count(*) AS n"))
    return big.union(small)


# Joins


@query("SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = s_nationkey AND c_acctbal > 9000)")
def join_semi(t: Tables) -> DataFrame:
    return t.supplier.join(t.customer.where("c_acctbal > 9000"), F.col("c_nationkey") == F.col("s_nationkey"), "left_semi").select("s_suppkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def join_anti(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_totalprice > 400000"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("SELECT coalesce(a.k, b.k) AS k, a.n AS customers, b.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 8000 GROUP BY ALL) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY ALL) b ON a.k = b.k")
def join_full_using(t: Tables) -> DataFrame:
    a = t.customer.where("c_acctbal > 8000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    b = t.supplier.where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    return joins.using_join(a, b, ["k"], "full")


@query("SELECT * FROM (SELECT n_nationkey AS k, n_name FROM nation) NATURAL JOIN (SELECT c_nationkey AS k, c_custkey FROM customer)")
def join_natural(t: Tables) -> DataFrame:
    return joins.natural_join(t.nation.select(F.col("n_nationkey").alias("k"), "n_name"), t.customer.select(F.col("c_nationkey").alias("k"), "c_custkey"))


@query("SELECT r_name, n_name FROM region, nation WHERE r_regionkey <> n_regionkey")
def join_theta(t: Tables) -> DataFrame:
    return t.region.join(t.nation, F.col("r_regionkey") != F.col("n_regionkey")).select("r_name", "n_name")


@query("""SELECT l.event_id, l.user_id, r.event_id AS event_id_r FROM (SELECT * FROM events WHERE event_type = 'click') l
ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY ALL) r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def join_asof(t: Tables) -> DataFrame:
    left, right = t.events.where("event_type = 'click'"), t.events.where("event_type = 'view'").select("user_id", "ts", "event_id")
    return joins.asof_join(left, right, ["user_id"], "ts", "ts", tie="event_id").select("event_id", "user_id", "event_id_r")


@query("SELECT a.r_name, b.n_name FROM (SELECT r_name, row_number() OVER (ORDER BY r_name) AS n FROM region) a FULL JOIN (SELECT n_name, row_number() OVER (ORDER BY n_name DESC) AS n FROM nation) b USING (n)")
def join_positional(t: Tables) -> DataFrame:
    return joins.positional_join(t.region.select("r_name"), t.nation.select("n_name"), [F.col("r_name")], [F.col("n_name").desc()], parts=4)


@query("""SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN (SELECT o_custkey AS k, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) = 1) ON k = c_custkey""")
def join_any(t: Tables) -> DataFrame:
    right = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return joins.any_join(t.customer.select("c_custkey"), right, ["c_custkey"], ["o_totalprice", "o_orderkey"])


@query("SELECT vec_id, CAST(i - 1 AS INTEGER) AS i, round(embedding[i], 5) AS x FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def join_array(t: Tables) -> DataFrame:
    df = t.embeddings.select("vec_id", F.col("embedding").alias("e"), F.sequence(F.lit(0), F.size("embedding") - 1).alias("ix"))
    return joins.array_join(df, {"i": "ix", "x": "e"}).select("vec_id", "i", F.round(F.col("x"), 5).alias("x"))


@query("""SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_retailprice BETWEEN s_acctbal - 20 AND s_acctbal + 20""")
def join_range(t: Tables) -> DataFrame:
    right = t.supplier.select("s_suppkey", (F.col("s_acctbal") - 20).alias("lo"), (F.col("s_acctbal") + 20).alias("hi"))
    return joins.range_join(t.part, right, "p_retailprice", "lo", "hi", 40.0).select("p_partkey", "s_suppkey")


@query("""SELECT n_name, c_custkey, c_acctbal FROM nation, LATERAL (SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 2)""")
def join_lateral_top(t: Tables) -> DataFrame:
    top = sorting.limit_by(t.customer, 2, ["c_nationkey"], ["c_acctbal DESC", "c_custkey"])
    return t.nation.join(top, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "c_custkey", "c_acctbal")


@query("""SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > ALL (SELECT c_acctbal * 20 FROM customer WHERE c_nationkey = 3) AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY ALL""")
def join_subqueries(t: Tables) -> DataFrame:
    files.register(t.spark, t.sf_dir, "orders", "customer")
    return t.spark.sql("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > (SELECT max(c_acctbal * 20) FROM customer WHERE c_nationkey = 3) AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY ALL")


# Aggregation


@query("SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS bal, c_mktsegment IS NULL AS is_total FROM customer GROUP BY GROUPING SETS ((c_mktsegment), ())")
def agg_with_totals(t: Tables) -> DataFrame:
    return aggregates.with_totals(t.customer, ["c_mktsegment"], "count(*) AS n", "round(avg(c_acctbal), 4) AS bal")


@query("SELECT n_regionkey, n_name, count(*) AS n FROM nation GROUP BY ROLLUP (n_regionkey, n_name)")
def agg_rollup(t: Tables) -> DataFrame:
    return t.nation.rollup("n_regionkey", "n_name").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, CAST(grouping_id(l_returnflag, l_linestatus) AS BIGINT) AS gid, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def agg_cube(t: Tables) -> DataFrame:
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.grouping_id().alias("gid"), F.count("*").alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), (o_orderstatus, o_orderpriority))")
def agg_grouping_sets(t: Tables) -> DataFrame:
    return aggregates.grouping_sets(t.orders, [["o_orderstatus"], ["o_orderpriority"], ["o_orderstatus", "o_orderpriority"]], "round(sum(o_totalprice), 2) AS total")


@query("SELECT o_custkey, count(*) AS n, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 2) AS f_total FROM orders GROUP BY ALL HAVING count(*) > 12")
def agg_having_filter(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(aggregates.agg_if("sum", "o_totalprice", "o_orderstatus = 'F'"), 2).alias("f_total")).where("n > 12")


@query("""SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders o WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders i WHERE i.o_orderpriority = o.o_orderpriority) GROUP BY ALL""")
def agg_having_max(t: Tables) -> DataFrame:
    both = F.struct(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return aggregates.having_max(t.orders, ["o_orderpriority"], both, "o_orderdate", "x").select("o_orderpriority", "x.n", "x.total")


@query("SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_name) AS names, count(DISTINCT n_name) AS n FROM nation GROUP BY ALL")
def agg_listagg(t: Tables) -> DataFrame:
    return t.nation.groupBy("n_regionkey").agg(aggregates.list_agg("n_name", "; ", "n_name").alias("names"), F.count_distinct("n_name").alias("n"))


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS med, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, round(quantile_cont(l_extendedprice, 0), 4) AS lo, round(quantile_cont(l_extendedprice, 1), 4) AS hi FROM lineitem GROUP BY ALL")
def agg_percentiles(t: Tables) -> DataFrame:
    return aggregates.percentiles(t.lineitem, ["l_returnflag"], "l_extendedprice", med=0.5, p90=0.9, lo=0.0, hi=1.0).select("l_returnflag", *[F.round(c, 4).alias(c) for c in ("med", "p90", "lo", "hi")])


@query("SELECT l_returnflag, min(l_linenumber) AS common FROM (SELECT *, rank() OVER (PARTITION BY l_returnflag ORDER BY n DESC) AS r FROM (SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL)) WHERE r = 1 GROUP BY ALL")
def agg_mode(t: Tables) -> DataFrame:
    return aggregates.top_frequent(t.lineitem, ["l_returnflag"], "l_linenumber", 1).select("l_returnflag", F.get("top", F.lit(0)).alias("common"))


@query("SELECT o_orderpriority, string_agg(CAST(o_custkey AS VARCHAR), ',' ORDER BY n DESC, o_custkey) AS top FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY n DESC, o_custkey) AS r FROM (SELECT o_orderpriority, o_custkey, count(*) AS n FROM orders GROUP BY ALL)) WHERE r <= 5 GROUP BY ALL")
def agg_top_frequent(t: Tables) -> DataFrame:
    return aggregates.top_frequent(t.orders, ["o_orderpriority"], "o_custkey", 5).select("o_orderpriority", F.array_join(F.transform("top", lambda x: x.cast("string")), ",").alias("top"))


@query("""SELECT o_orderstatus, round(sum(o_totalprice) FILTER (WHERE o_orderpriority = 'never'), 2) AS none_sum, coalesce(round(avg(o_totalprice) FILTER (WHERE o_orderpriority = 'never'), 2), -1) AS avg_default,
count(DISTINCT o_custkey) FILTER (WHERE o_totalprice > 200000) AS buyers, nullif(count(o_custkey) FILTER (WHERE o_totalprice > 600000), 0) AS large, round(sum(DISTINCT round(o_totalprice, -3)), 2) AS levels FROM orders GROUP BY ALL""")
def agg_combinators(t: Tables) -> DataFrame:
    c = aggregates.combined
    never = "o_orderpriority = 'never'"
    return t.orders.groupBy("o_orderstatus").agg(F.round(c("sumIf", "o_totalprice", never), 2).alias("none_sum"), F.round(c("avgIfOrDefault", "o_totalprice", never, -1.0), 2).alias("avg_default"), c("countDistinctIf", "o_custkey", "o_totalprice > 200000").alias("buyers"), c("countIfOrNull", "o_custkey", "o_totalprice > 600000").alias("large"), F.round(c("sumDistinct", "round(o_totalprice, -3)"), 2).alias("levels"))


@query("SELECT user_id, event_type, round(sum(value), 4) AS total, max(value) AS top FROM events GROUP BY ALL")
def agg_map_combinator(t: Tables) -> DataFrame:
    df = t.events.select("user_id", F.create_map("event_type", "value").alias("m"))
    sums, tops = (aggregates.agg_map(df, ["user_id"], "m", f, n) for f, n in (("sum", "s"), ("max", "x")))
    return sums.join(tops, "user_id").select("user_id", "x", F.explode("s").alias("event_type", "total")).select("user_id", "event_type", F.round("total", 4).alias("total"), F.element_at("x", F.col("event_type")).alias("top"))


@query("SELECT o_orderstatus, round(avg(o_totalprice), 4) AS mean, count(*) AS n FROM orders GROUP BY ALL")
def agg_state_merge(t: Tables) -> DataFrame:
    """Averages of groups from mergeable states of finer groups."""
    parts = t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(aggregates.avg_state("o_totalprice").alias("s"))
    merged = parts.groupBy("o_orderstatus").agg(aggregates.avg_merged("s").alias("s"))
    return merged.select("o_orderstatus", F.round(F.col("s.total") / F.col("s.n"), 4).alias("mean"), F.col("s.n").alias("n"))


@query("""SELECT event_type, round(stddev_samp(value), 6) AS sd, round(var_pop(value), 6) AS vp, round(skewness(value), 6) AS skew, round(kurtosis(value), 6) AS kurt FROM events GROUP BY ALL""")
def agg_moments(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.round(F.stddev_samp("value"), 6).alias("sd"), F.round(F.var_pop("value"), 6).alias("vp"), F.round(aggregates.sample_skewness("value"), 6).alias("skew"), F.round(aggregates.sample_kurtosis("value"), 6).alias("kurt"))


@query("""SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 8) AS r, round(covar_pop(l_quantity, l_extendedprice), 4) AS cp, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2 FROM lineitem GROUP BY ALL""")
def agg_regression(t: Tables) -> DataFrame:
    y, x = "l_extendedprice", "l_quantity"
    return t.lineitem.groupBy("l_returnflag").agg(F.round(numbers.safe_corr(x, y), 8).alias("r"), F.round(F.covar_pop(x, y), 4).alias("cp"), F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x), 4).alias("intercept"), F.round(F.regr_r2(y, x), 8).alias("r2"))


@query("SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS dearest, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS cheapest FROM orders GROUP BY ALL")
def agg_arg_max(t: Tables) -> DataFrame:
    by = F.struct("o_totalprice", "o_orderkey")
    return t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", by).alias("dearest"), F.min_by("o_orderkey", by).alias("cheapest"))


@query("SELECT bool_and(l_quantity > 0) AS every_one, bool_or(l_discount > 0.09) AS some_one, CAST(bit_xor(l_orderkey) AS BIGINT) AS bx, CAST(bit_or(l_linenumber) AS BIGINT) AS bo FROM lineitem")
def agg_bits(t: Tables) -> DataFrame:
    return t.lineitem.agg(F.bool_and(F.col("l_quantity") > 0).alias("every_one"), F.bool_or(F.col("l_discount") > 0.09).alias("some_one"), F.bit_xor("l_orderkey").alias("bx"), F.bit_or("l_linenumber").cast("long").alias("bo"))


@query("SELECT label, CAST(i - 1 AS INTEGER) AS i, round(sum(x), 4) AS total FROM (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL")
def agg_for_each(t: Tables) -> DataFrame:
    df = t.embeddings.select("label", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return aggregates.agg_for_each(df, ["label"], "e", "sum", "s").select("label", F.posexplode("s").alias("i", "x")).select("label", "i", F.round("x", 4).alias("total"))


@query("SELECT o_orderstatus, b.bin, n FROM (SELECT DISTINCT o_orderstatus FROM orders) CROSS JOIN (SELECT unnest([0, 100000, 200000, 300000]) AS bin) b LEFT JOIN (SELECT o_orderstatus AS s, CAST(floor(o_totalprice / 100000) * 100000 AS INTEGER) AS bin, count(*) AS n FROM orders WHERE o_totalprice >= 0 AND o_totalprice <= 399999 GROUP BY ALL) x ON s = o_orderstatus AND x.bin = b.bin")
def agg_resample(t: Tables) -> DataFrame:
    return aggregates.agg_resample(t.orders, ["o_orderstatus"], F.count("*"), "o_totalprice", 0, 400000, 100000, "n")


@query("SELECT count(DISTINCT o_custkey) AS exact, 0 AS off_by_twentieths, 0 AS off_whole FROM orders")
def agg_sketch_merge(t: Tables) -> DataFrame:
    """The merged sketches of parts estimate, to a twentieth, the exact number and what the sketch of the whole does."""
    parts = t.orders.groupBy("o_orderstatus").agg(aggregates.state("distinct", "o_custkey").alias("s"))
    estimate = parts.agg(F.hll_sketch_estimate(aggregates.merged("distinct", "s")).alias("approx"))
    exact = t.orders.agg(F.count_distinct("o_custkey").alias("exact"), F.hll_sketch_estimate(aggregates.state("distinct", "o_custkey")).alias("whole"))
    off = lambda c: F.floor(F.abs(F.col("approx") - F.col(c)) * 20 / F.col(c)).cast("int")
    return estimate.crossJoin(exact).select("exact", off("exact").alias("off_by_twentieths"), off("whole").alias("off_whole"))


@query("SELECT c_nationkey, round(entropy(c_mktsegment), 6) AS entropy FROM customer GROUP BY ALL")
def agg_entropy(t: Tables) -> DataFrame:
    return aggregates.entropy(t.customer, ["c_nationkey"], "c_mktsegment").select("c_nationkey", F.round("entropy", 6).alias("entropy"))


@query("SELECT c_nationkey, array_to_string(list_transform(list_slice(list(c_custkey ORDER BY c_acctbal DESC, c_custkey DESC), 1, 3), lambda x: CAST(x AS VARCHAR)), ',') AS top FROM customer GROUP BY ALL")
def agg_top_k(t: Tables) -> DataFrame:
    return aggregates.top_k(t.customer, ["c_nationkey"], "c_custkey", "c_acctbal", 3, "k").select("c_nationkey", F.array_join(F.transform("k", lambda x: x.cast("string")), ",").alias("top"))


# Windows and ordering


@query("""SELECT event_id, rank() OVER w AS r, dense_rank() OVER w AS d, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, round(percent_rank() OVER w, 8) AS p, round(cume_dist() OVER w, 8) AS c, ntile(4) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS q
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)""")
def window_ranks(t: Tables) -> DataFrame:
    w, total = Window.partitionBy("user_id").orderBy("ts"), Window.partitionBy("user_id").orderBy("ts", "event_id")
    long = lambda c: c.cast("long")
    return t.events.select("event_id", long(F.rank().over(w)).alias("r"), long(F.dense_rank().over(w)).alias("d"), long(F.row_number().over(total)).alias("n"), F.round(F.percent_rank().over(w), 8).alias("p"), F.round(F.cume_dist().over(w), 8).alias("c"), long(F.ntile(4).over(total)).alias("q"))


@query("""SELECT conv_id, turn, role, lag(role) OVER w AS before, lead(role, 1, 'end') OVER w AS after, first_value(text) OVER w = text AS is_first, nth_value(role, 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def window_offsets(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return t.conversations.select("conv_id", "turn", "role", F.lag("role").over(w).alias("before"), F.lead("role", 1, "end").over(w).alias("after"), (F.first("text").over(w) == F.col("text")).alias("is_first"), F.nth_value("role", 2).over(whole).alias("second"))


@query("SELECT l_orderkey, l_linenumber, round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_partkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 2) AS near, round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber RANGE BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS ranged FROM lineitem")
def window_frames(t: Tables) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    total = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_extendedprice", "l_partkey")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(F.sum("l_quantity").over(total.rowsBetween(-1, 1)), 2).alias("near"), F.round(F.sum("l_quantity").over(w.rangeBetween(-2, 0)), 2).alias("ranged"))


@query("SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY user_id GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM events")
def window_groups_frame(t: Tables) -> DataFrame:
    return windows.groups_frame(t.events, F.count("*"), "n", ["event_type"], ["user_id"], -1, 0).select("event_id", "n")


@query("""SELECT c_custkey, round(sum(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW), 2) AS others, count(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW) AS n FROM customer""")
def window_exclude_current(t: Tables) -> DataFrame:
    a = windows.exclude(t.customer, "c_acctbal", "others", ["c_nationkey"], ["c_custkey"])
    b = windows.exclude(a, "c_acctbal", "n", ["c_nationkey"], ["c_custkey"], agg="count")
    return b.select("c_custkey", F.round("others", 2).alias("others"), F.col("n").cast("long").alias("n"))


@query("""SELECT c_custkey, count(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE GROUP) AS no_group, count(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE TIES) AS no_ties FROM customer""")
def window_exclude_peers(t: Tables) -> DataFrame:
    a = windows.exclude(t.customer, "c_acctbal", "no_group", ["c_nationkey"], ["c_mktsegment"], "group", agg="count")
    b = windows.exclude(a, "c_acctbal", "no_ties", ["c_nationkey"], ["c_mktsegment"], "ties", agg="count")
    return b.select("c_custkey", F.col("no_group").cast("long").alias("no_group"), F.col("no_ties").cast("long").alias("no_ties"))


@query("SELECT o_orderkey, o_custkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def window_qualify(t: Tables) -> DataFrame:
    w = windows.over(["o_custkey"], ["o_totalprice DESC", "o_orderkey"])
    return windows.qualify(t.orders, F.row_number().over(w) <= 2).select("o_orderkey", "o_custkey")


@query("SELECT user_id, event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_buy FROM events")
def window_ignore_nulls(t: Tables) -> DataFrame:
    w = windows.over(["user_id"], ["ts", "event_id"])
    return t.events.select("user_id", "event_id", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w).alias("last_buy"))


@query("""SELECT event_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) <= 86400 THEN 0 ELSE 1 END AS new FROM events)""")
def window_sessions(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seconds = temporal.epoch_seconds(F.col("ts"))
    df = t.events.withColumn("new", F.when(seconds - F.lag(seconds).over(w) <= 86400, 0).otherwise(1))
    return df.select("event_id", F.sum("new").over(w).alias("session"))


@query("SELECT DISTINCT ON (c_nationkey) c_nationkey, c_custkey, c_acctbal FROM customer ORDER BY c_nationkey, c_acctbal DESC, c_custkey")
def sort_distinct_on(t: Tables) -> DataFrame:
    return sorting.distinct_on(t.customer, ["c_nationkey"], ["c_acctbal DESC", "c_custkey"]).select("c_nationkey", "c_custkey", "c_acctbal")


@query("SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) BETWEEN 2 AND 4")
def sort_limit_by(t: Tables) -> DataFrame:
    return sorting.limit_by(t.part, 3, ["p_brand"], ["p_retailprice", "p_partkey"], offset=1).select("p_brand", "p_partkey")


@query("SELECT p_partkey, p_size FROM part QUALIFY rank() OVER (ORDER BY p_size DESC) <= 5")
def sort_with_ties(t: Tables) -> DataFrame:
    df = t.part.select("p_partkey", "p_size")
    return sorting.limit_with_ties(df, 5, ["p_size DESC"])


@query("SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10%")
def sort_percent(t: Tables) -> DataFrame:
    return sorting.limit_percent(t.customer, 10, ["c_acctbal", "c_custkey"]).select("c_custkey")


@query("""SELECT s.d AS day, n FROM (SELECT unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '1995-03-31', INTERVAL 1 DAY)) AS d) s LEFT JOIN (SELECT date_trunc('day', o_orderdate) AS d, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1995-04-01' GROUP BY ALL) x ON x.d = s.d""")
def sort_with_fill(t: Tables) -> DataFrame:
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    days = t.orders.where("o_orderdate >= TIMESTAMP_NTZ '1995-01-01 00:00:00' AND o_orderdate < TIMESTAMP_NTZ '1995-04-01 00:00:00'").groupBy(F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("n"))
    return sorting.with_fill(days, "day", at("1995-01-01 00:00:00"), at("1995-04-01 00:00:00"), F.expr("INTERVAL 1 DAY"))


# Set operations


@query("SELECT n_nationkey AS k, n_name AS name, NULL AS bal FROM nation UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier")
def set_union_by_name(t: Tables) -> DataFrame:
    return sets.union_by_name(t.nation.select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name")), t.supplier.select(F.col("s_acctbal").alias("bal"), F.col("s_suppkey").alias("k")))


@query("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def set_intersect_all_by_name(t: Tables) -> DataFrame:
    return sets.intersect_by_name(t.customer.select("c_custkey", F.col("c_nationkey").alias("k")), t.supplier.select(F.col("s_nationkey").alias("k"), "s_name"), all=True)


@query("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def set_except_all_by_name(t: Tables) -> DataFrame:
    return sets.except_by_name(t.customer.select("c_custkey", F.col("c_nationkey").alias("k")), t.supplier.select(F.col("s_nationkey").alias("k")), all=True)


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 7000)")
def set_except_on(t: Tables) -> DataFrame:
    right = t.supplier.where("s_acctbal > 7000").select(F.col("s_nationkey").alias("c_nationkey"))
    return sets.on_columns(t.customer.select("c_custkey", "c_nationkey"), right, ["c_nationkey"], "except")


# Recursion, patterns, changes


@query("""WITH RECURSIVE tree AS (SELECT c_custkey AS id, CASE WHEN c_custkey > 3 THEN c_custkey // 3 END AS parent FROM customer),
h AS (SELECT id, 1 AS level, CAST(id AS VARCHAR) AS path, id AS root FROM tree WHERE parent IS NULL UNION ALL SELECT t.id, h.level + 1, h.path || '/' || t.id, h.root FROM tree t JOIN h ON t.parent = h.id) SELECT * FROM h""")
def recursive_connect_by(t: Tables) -> DataFrame:
    tree = t.customer.selectExpr("c_custkey AS id", "CASE WHEN c_custkey > 3 THEN c_custkey DIV 3 END AS parent")
    return recursion.connect_by(tree, "id", "parent", "parent IS NULL").select("id", "level", "path", "root")


@query("""WITH RECURSIVE tree AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 1 THEN p_partkey // 2 END AS parent FROM part),
h AS (SELECT id, 1 AS level, CAST(id AS VARCHAR) AS path FROM tree WHERE parent IS NULL UNION ALL SELECT t.id, h.level + 1, h.path || '/' || t.id FROM tree t JOIN h ON t.parent = h.id) SELECT * FROM h""")
def recursive_connect_by_all(t: Tables) -> DataFrame:
    """The hierarchy over all parts."""
    tree = t.part.selectExpr("p_partkey AS id", "CASE WHEN p_partkey > 1 THEN p_partkey DIV 2 END AS parent")
    return recursion.connect_by(tree, "id", "parent", "parent IS NULL").select("id", "level", "path")


@query("WITH RECURSIVE c AS (SELECT 1 AS n, 1 AS f UNION ALL SELECT n + 1, f * (n + 1) FROM c WHERE n < 10) SELECT * FROM c")
def recursive_cte(t: Tables) -> DataFrame:
    return t.spark.sql("WITH RECURSIVE c(n, f) AS (SELECT 1, 1 UNION ALL SELECT n + 1, f * (n + 1) FROM c WHERE n < 10) SELECT * FROM c")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT n_regionkey AS a, n_nationkey % 10 AS b FROM nation WHERE n_regionkey < n_nationkey % 10), c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a) SELECT * FROM c""")
def recursive_closure(t: Tables) -> DataFrame:
    edges = t.nation.selectExpr("n_regionkey AS a", "n_nationkey % 10 AS b").where("a < b").distinct()
    return recursion.closure(edges, "a", "b")


@query("""WITH s AS (SELECT user_id, row_number() OVER w AS i, value, CASE WHEN value > lag(value) OVER w THEN 'U' ELSE '.' END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, i - row_number() OVER (PARTITION BY user_id, s ORDER BY i) AS g FROM s)
SELECT user_id, count(*) AS n, min(i) AS from_row, max(value) AS peak FROM g WHERE s = 'U' GROUP BY user_id, g HAVING count(*) >= 2""")
def match_rises(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    df = t.events.withColumn("up", F.col("value") > F.lag("value").over(w)).withColumn("row", F.row_number().over(w).cast("long"))
    out = matching.match_recognize(df, ["user_id"], ["ts", "event_id"], {"U": "coalesce(up, false)"}, "U{2,}", {"n": ("count", "", ""), "from_row": ("first", "row", ""), "peak": ("max", "value", "")})
    return out.select("user_id", F.col("n").cast("long").alias("n"), "from_row", "peak")


@query("SELECT * FROM (SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_nationkey = 3 THEN s_acctbal + 100 ELSE s_acctbal END AS s_acctbal FROM supplier) WHERE NOT (s_nationkey <> 3 AND s_acctbal < 0 OR s_nationkey = 3 AND s_acctbal < 100)")
def change_update_delete(t: Tables) -> DataFrame:
    return changes.delete(changes.update(t.supplier, {"s_acctbal": "s_acctbal + 100"}, "s_nationkey = 3"), "s_nationkey <> 3 AND s_acctbal < 0 OR s_nationkey = 3 AND s_acctbal < 100")


@query("""WITH t AS (SELECT CASE WHEN c_acctbal >= 0 THEN c_custkey END AS k, c_acctbal AS v FROM customer WHERE c_mktsegment <> 'BUILDING'), s AS (SELECT CASE WHEN open = 1 THEN o_custkey END AS k, CAST(floor(sum(o_totalprice)) AS DOUBLE) AS v FROM (SELECT *, CASE WHEN o_orderstatus <> 'P' THEN 1 END AS open FROM orders) GROUP BY o_custkey, open)
SELECT coalesce(t.k, s.k) AS k, CASE WHEN t.v IS NULL THEN s.v WHEN s.v IS NULL THEN t.v ELSE round(t.v + s.v, 2) END AS v FROM t FULL JOIN s ON t.k = s.k WHERE NOT (t.v IS NOT NULL AND s.v IS NOT NULL AND s.v > 2000000)""")
def change_merge(t: Tables) -> DataFrame:
    """Rows with a null key, many in source and target, match nothing: they stay, or are inserted one by one."""
    target = t.customer.where("c_mktsegment <> 'BUILDING'").selectExpr("CASE WHEN c_acctbal >= 0 THEN c_custkey END AS k", "c_acctbal AS v")
    open_ = F.when(F.col("o_orderstatus") != "P", 1)
    source = t.orders.groupBy("o_custkey", open_.alias("open")).agg(F.floor(F.sum("o_totalprice")).cast("double").alias("v")).select(F.when(F.col("open") == 1, F.col("o_custkey")).alias("k"), "v")
    clauses = [changes.Matched(None, "s.v > 2000000"), changes.Matched({"v": "round(t.v + s.v, 2)"})]
    return changes.merge(target, source, ["k"], clauses, {"k": "s.k", "v": "s.v"})


@query("SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_name NOT LIKE '%A%' UNION ALL SELECT n_nationkey, lower(n_name) FROM nation WHERE n_name LIKE '%A%' UNION ALL SELECT 1000 + r_regionkey, r_name FROM region")
def change_upsert(t: Tables) -> DataFrame:
    new = t.nation.where("n_name LIKE '%A%'").selectExpr("n_nationkey AS k", "lower(n_name) AS name").union(t.region.selectExpr("1000 + r_regionkey AS k", "r_name AS name"))
    return changes.upsert(t.nation.selectExpr("n_nationkey AS k", "n_name AS name"), new, ["k"])


@query("""WITH s AS (SELECT o_custkey AS k, sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS v FROM orders GROUP BY ALL)
SELECT c_custkey AS k, CASE WHEN s.k IS NULL THEN CAST(c_acctbal AS DECIMAL(18, 2)) ELSE c_acctbal::DECIMAL(18, 2) + s.v END::DOUBLE AS v FROM customer LEFT JOIN s ON c_custkey = s.k WHERE s.v IS NULL OR s.v <= 2000000
UNION ALL SELECT k, v::DOUBLE FROM s WHERE k NOT IN (SELECT c_custkey FROM customer)""")
def change_merge_all(t: Tables) -> DataFrame:
    """Aggregated orders merged into the whole customer table."""
    target = t.customer.selectExpr("c_custkey AS k", "CAST(c_acctbal AS DECIMAL(18, 2)) AS v")
    source = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.expr("sum(CAST(o_totalprice AS DECIMAL(18, 2)))").alias("v"))
    clauses = [changes.Matched(None, "s.v > 2000000"), changes.Matched({"v": "t.v + s.v"})]
    return changes.merge(target, source, ["k"], clauses, {"k": "s.k", "v": "s.v"}).withColumn("v", F.col("v").cast("double"))


@query("""SELECT c_custkey AS k, c_name AS name FROM customer WHERE c_acctbal < 0
UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def change_upsert_all(t: Tables) -> DataFrame:
    """Customers in debt upserted into the whole supplier table: updates and inserts."""
    old = t.supplier.selectExpr("s_suppkey AS k", "s_name AS name")
    return changes.upsert(old, t.customer.where("c_acctbal < 0").selectExpr("c_custkey AS k", "c_name AS name"), ["k"])


# Event time


@query("SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(t: Tables) -> DataFrame:
    return event_windows.windowed(t.events, "ts", "1 hour", F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), by=["event_type"])


@query("""SELECT s AS window_start, s + INTERVAL 2 HOUR AS window_end, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY ALL""")
def events_sliding(t: Tables) -> DataFrame:
    return event_windows.windowed(t.events, "ts", "2 hours", F.count("*").alias("n"), slide="1 hour")


@query("""SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 12 HOUR AS session_end, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def events_sessions(t: Tables) -> DataFrame:
    return event_windows.session_windowed(t.events, "ts", "12 hours", F.count("*").alias("n"), by=["user_id"])


@query("""WITH b AS (SELECT event_type, date_trunc('hour', ts) AS bin, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT event_type, unnest(generate_series(min(bin), max(bin), INTERVAL 1 HOUR)) AS bin FROM b GROUP BY event_type) SELECT s.event_type, s.bin, coalesce(n, 0) AS n FROM s LEFT JOIN b ON b.event_type = s.event_type AND b.bin = s.bin""")
def events_gap_fill(t: Tables) -> DataFrame:
    return event_windows.gap_filled(t.events, "ts", "1 HOUR", ["event_type"], F.count("*"), "n", "zero")


@query("SELECT event_id, epoch_ms(CAST(floor(epoch(ts) / 900) * 900000 AS BIGINT)) AS slice, CAST(date_trunc('week', ts) AS DATE) AS monday FROM events")
def events_time_slice(t: Tables) -> DataFrame:
    return t.events.select("event_id", temporal.time_slice(F.col("ts"), 900).alias("slice"), temporal.week_start(F.col("ts")).alias("monday"))


# Functions


@query("""SELECT doc_id, md5(regexp_replace(text, '[a-z]+', '#')) AS first_gone, len(string_split(coalesce(source, ''), 'r'))::BIGINT AS parts, coalesce(lang, '') || coalesce(source, '') AS both, regexp_full_match(lang, '(e|f).') AS ef, lang GLOB '[de]?' AS g, unicode(lang)::BIGINT AS first_code, md5(source) AS m FROM documents""")
def functions_text(t: Tables) -> DataFrame:
    c = F.col
    return t.documents.select("doc_id", F.md5(text.regexp_replace_first(c("text"), "[a-z]+", "#")).alias("first_gone"), F.size(text.split_literal(F.coalesce("source", F.lit("")), "r")).cast("long").alias("parts"), text.concat_skipping_nulls(c("lang"), c("source")).alias("both"), text.similar_to(c("lang"), "(e|f)_").alias("ef"), text.glob(c("lang"), "[de]?").alias("g"), F.get(text.code_points(c("lang")), F.lit(0)).cast("long").alias("first_code"), F.md5(c("source")).alias("m"))


@query("""SELECT c_custkey, levenshtein(c_name, 'Customer#1')::BIGINT AS lev, hamming(lpad(c_mktsegment, 12, '-'), 'AUTOMOBILE--')::BIGINT AS ham, round(jaro_winkler_similarity(c_mktsegment, 'MACHINES'), 8) AS jw, reverse(c_name) AS rev, translate(c_name, '#0', '-o') AS tr, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS pad, starts_with(c_mktsegment, 'B') AS b FROM customer""")
def functions_similarity(t: Tables) -> DataFrame:
    c = F.col
    return t.customer.select("c_custkey", F.levenshtein(c("c_name"), F.lit("Customer#1")).cast("long").alias("lev"), text.hamming(F.lpad("c_mktsegment", 12, "-"), F.lit("AUTOMOBILE--")).cast("long").alias("ham"), F.round(text.jaro_winkler(c("c_mktsegment"), F.lit("MACHINES")), 8).alias("jw"), F.reverse("c_name").alias("rev"), F.translate("c_name", "#0", "-o").alias("tr"), F.lpad(c("c_custkey").cast("string"), 8, "0").alias("pad"), F.startswith("c_mktsegment", F.lit("B")).alias("b"))


@query("""SELECT p_partkey, trunc(p_retailprice) AS tr, round(log10(p_retailprice), 8) AS l10, round(log2(p_size), 8) AS l2, round(1 / cosh(p_size / 10.0), 8) AS sech, CAST(floor((p_size - 1) / 10) + 1 AS BIGINT) AS band, CASE WHEN p_size >= 10 THEN 1 ELSE 0 END + CASE WHEN p_size >= 30 THEN 1 ELSE 0 END AS bucket, greatest(p_size, 25) AS g, p_size BETWEEN 10 AND 30 AS bs FROM part""")
def functions_numbers(t: Tables) -> DataFrame:
    c = F.col
    return t.part.select("p_partkey", numbers.truncate(c("p_retailprice")).alias("tr"), F.round(numbers.log_base(10.0, c("p_retailprice")), 8).alias("l10"), F.round(F.log2("p_size"), 8).alias("l2"), F.round(numbers.sech(c("p_size") / 10.0), 8).alias("sech"), numbers.range_n(c("p_size"), 1, 1000, 10).alias("band"), numbers.range_bucket(c("p_size"), [10, 30]).alias("bucket"), numbers.greatest_strict(c("p_size"), F.lit(25)).alias("g"), numbers.between_symmetric(c("p_size"), F.lit(30), F.lit(10)).alias("bs"))


@query("""SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS dot, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cos, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS l2 FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b""")
def functions_vectors(t: Tables) -> DataFrame:
    a, b = F.col("embedding"), F.col("b")
    one = t.embeddings.where("vec_id = 0").select(F.col("embedding").alias("b"))
    return t.embeddings.crossJoin(F.broadcast(one)).select("vec_id", F.round(numbers.dot_product(a, b), 4).alias("dot"), F.round(numbers.cosine_similarity(a, b), 6).alias("cos"), F.round(numbers.euclidean_distance(a, b), 5).alias("l2"))


@query("""SELECT q.vec_id AS query_id, m.vec_id AS match_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_distance(m.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9), m.vec_id)::BIGINT AS rank FROM embeddings m, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q QUALIFY rank <= 5""")
def vector_top_k(t: Tables) -> DataFrame:
    return misc.vector_search(t.embeddings, t.embeddings.where("vec_id % 100 = 0"), "embedding", "vec_id", "vec_id", 5, "euclidean").select("query_id", "match_id", F.col("rank").cast("long").alias("rank"))


@query("""SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, isodow(o_orderdate) AS dow, week(o_orderdate) AS w, CAST(last_day(o_orderdate) AS DATE) AS ld, date_diff('month', o_orderdate, TIMESTAMP '1998-12-31') AS months, CAST((DATE '1998-12-28' - CAST(date_trunc('week', o_orderdate) AS DATE)) // 7 AS BIGINT) AS weeks, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS qs, strftime(o_orderdate, '%Y-%m') AS ym, isodow(o_orderdate) < 6 AS work FROM orders""")
def functions_temporal(t: Tables) -> DataFrame:
    d, end = F.col("o_orderdate"), F.lit("1998-12-31 00:00:00").cast("timestamp_ntz")
    long = lambda c: c.cast("long")
    return t.orders.select("o_orderkey", long(F.year(d)).alias("y"), long(F.quarter(d)).alias("q"), long(F.weekday(d) + 1).alias("dow"), long(F.weekofyear(d)).alias("w"), temporal.last_day_of("month", d).alias("ld"), long(temporal.date_diff_boundaries("month", d, end)).alias("months"), long(temporal.date_diff_boundaries("week", d, end)).alias("weeks"), F.trunc(d, "quarter").alias("qs"), F.date_format(d, "yyyy-MM").alias("ym"), temporal.is_business_day(d).alias("work"))


@query("""SELECT event_id, json_valid(props) AS ok, len(json_keys(props))::BIGINT AS n_keys, list_contains(json_keys(props), 'page') AS has_page FROM events""")
def functions_json(t: Tables) -> DataFrame:
    p = F.col("props")
    return t.events.select("event_id", C.check_json(p).isNull().alias("ok"), F.size(F.json_object_keys(p)).cast("long").alias("n_keys"), C.json_has_any_key(p, "page").alias("has_page"))


@query("""SELECT user_id, round(list_aggregate(list(value ORDER BY event_id), 'sum')::DOUBLE, 4) AS total, len(list_distinct(list(event_type)))::BIGINT AS kinds, array_to_string(list_sort(list_distinct(list(event_type))), '|') AS names, len(list_filter(list(value), lambda x: x > 50))::BIGINT AS high FROM events GROUP BY ALL""")
def functions_arrays(t: Tables) -> DataFrame:
    g = t.events.groupBy("user_id").agg(F.collect_list("value").alias("v"), F.collect_set("event_type").alias("k"))
    return g.select("user_id", F.round(C.array_sum(F.col("v")), 4).alias("total"), F.size("k").cast("long").alias("kinds"), F.array_join(F.sort_array("k"), "|").alias("names"), F.size(C.comprehension(F.col("v"), lambda x: x, lambda x: x > 50)).cast("long").alias("high"))


@query("""SELECT page_id, lower(regexp_extract(url, '://([^/?#]+)', 1)) AS host, nullif(regexp_extract(url, '[?&]utm_source=([^&]*)', 1), '') AS utm FROM pages""")
def functions_urls(t: Tables) -> DataFrame:
    u = F.col("url")
    return t.pages.select("page_id", misc.host(u).alias("host"), misc.url_parameter(u, "utm_source").alias("utm"))


@query("SELECT c_custkey, CAST(c_mktsegment AS VARCHAR) AS seg, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS band, TRY_CAST(c_mktsegment AS INTEGER) IS NULL AS not_int, coalesce(nullif(c_nationkey, 0), -1) AS nz, c_name ILIKE 'customer%1' AS il, c_nationkey IS DISTINCT FROM 3 AS dist FROM customer")
def scalar_conditionals(t: Tables) -> DataFrame:
    files.register(t.spark, t.sf_dir, "customer")
    return t.spark.sql("SELECT c_custkey, CAST(c_mktsegment AS STRING) AS seg, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS band, TRY_CAST(c_mktsegment AS INT) IS NULL AS not_int, coalesce(nullif(c_nationkey, 0), -1) AS nz, c_name ILIKE 'customer%1' AS il, NOT (c_nationkey <=> 3) AS dist FROM customer")


@query("SELECT c_custkey AS id, c_mktsegment, c_nationkey * 2 AS c_nationkey FROM customer")
def star_modifiers(t: Tables) -> DataFrame:
    return misc.star(t.customer, except_=["c_name", "c_acctbal"], replace={"c_nationkey": F.col("c_nationkey") * 2}, rename={"c_custkey": "id"}).select("id", "c_mktsegment", "c_nationkey")


@query("SELECT n_nationkey, unnest(string_split(n_name, ' ')) AS word FROM nation")
def source_unnest(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", F.explode(text.split_literal(F.col("n_name"), " ")).alias("word"))


@query("SELECT * FROM (VALUES (1, 'a'), (2, NULL), (2, 'b')) v(x, y)")
def source_values(t: Tables) -> DataFrame:
    return files.values(t.spark, [(1, "a"), (2, None), (2, "b")], "x int, y string")


@query("""WITH n AS (SELECT n_nationkey AS k, CASE WHEN n_regionkey > 1 THEN n_name END AS name FROM nation)
SELECT 'JSONEachRow' AS format, '{"k":' || k || ',"name":' || coalesce('"' || name || '"', 'null') || '}' AS line FROM n
UNION ALL SELECT 'JSONCompactEachRow', '[' || k || ',' || coalesce('"' || name || '"', 'null') || ']' FROM n
UNION ALL SELECT 'CSV', k || ',' || coalesce(name, '') FROM n UNION ALL SELECT 'TSV', k || chr(9) || coalesce(name, '') FROM n""")
def source_formats(t: Tables) -> DataFrame:
    df = t.nation.select(F.col("n_nationkey").alias("k"), F.when(F.col("n_regionkey") > 1, F.col("n_name")).alias("name"))
    lines = [files.formatted(df, kind).select(F.lit(kind).alias("format"), "line") for kind in files.FORMATS]
    return functools.reduce(DataFrame.union, lines)


# Analytics over several operators


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY ALL""")
def analytics_local_supplier(t: Tables) -> Pipe:
    p = t.pipe("customer").join(t.orders, "c_custkey = o_custkey").join(t.lineitem, "l_orderkey = o_orderkey").join(t.supplier, "l_suppkey = s_suppkey AND c_nationkey = s_nationkey")
    return p.join(t.nation, "s_nationkey = n_nationkey").join(t.region, "n_regionkey = r_regionkey").where("r_name = 'ASIA'").aggregate(f"round(sum({REVENUE}), 2) AS revenue", group_by="n_name")


@query("""SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) GROUP BY ALL""")
def analytics_priority(t: Tables) -> Pipe:
    return t.pipe("orders").join(t.lineitem.where("l_quantity > 45"), "l_orderkey = o_orderkey", "left_semi").aggregate("count(*) AS n", group_by="o_orderpriority", and_order=True)


@query("""SELECT year(o_orderdate) AS y, round(sum(CASE WHEN n_name LIKE 'A%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 8) AS share FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL""")
def analytics_market_share(t: Tables) -> Pipe:
    p = t.pipe("lineitem").join(t.orders, "l_orderkey = o_orderkey").join(t.supplier, "s_suppkey = l_suppkey").join(t.nation, "n_nationkey = s_nationkey")
    return p.aggregate(f"round(sum(CASE WHEN n_name LIKE 'A%' THEN {REVENUE} ELSE 0 END) / sum({REVENUE}), 8) AS share", group_by="bigint(year(o_orderdate)) AS y")


@query("""WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL) SELECT coalesce(n, 0) AS orders_made, count(*) AS customers FROM customer LEFT JOIN c ON c_custkey = o_custkey GROUP BY ALL""")
def analytics_order_distribution(t: Tables) -> Pipe:
    made = t.pipe("orders").aggregate("count(*) AS n", group_by="o_custkey").df
    return t.pipe("customer").join(made, "c_custkey = o_custkey", "left").aggregate("count(*) AS customers", group_by="coalesce(n, 0) AS orders_made")


# Semantics of other engines, tables and sessions


@query("""SELECT c_custkey, round(log(c_custkey), 8) AS lg, concat(c_mktsegment, NULL, '!') AS cc, regexp_replace(c_name, '[0-9]', 'x') AS first_only, dayofweek(DATE '1998-01-01' + CAST(c_custkey % 50 AS INTEGER))::BIGINT AS dow, len(string_split(c_name, '.'))::BIGINT AS parts, CAST(c_acctbal AS BIGINT) AS rounded FROM (SELECT * REPLACE (c_acctbal + CASE WHEN c_custkey % 7 = 0 THEN 0.5 - (c_acctbal - floor(c_acctbal)) ELSE 0 END AS c_acctbal) FROM customer)""")
def compat_duckdb(t: Tables) -> DataFrame:
    f, c = (lambda n: compat.function("duckdb", n)), F.col
    day = F.date_add(F.lit("1998-01-01").cast("date"), (c("c_custkey") % 50).cast("int"))
    bal = F.col("c_acctbal")
    df = t.customer.withColumn("c_acctbal", bal + F.when(F.col("c_custkey") % 7 == 0, 0.5 - (bal - F.floor(bal))).otherwise(0))  # with many halves
    return df.select("c_custkey", F.round(f("log")(c("c_custkey")), 8).alias("lg"), f("concat")(c("c_mktsegment"), F.lit(None), F.lit("!")).alias("cc"), f("regexp_replace")(c("c_name"), "[0-9]", "x").alias("first_only"), f("dayofweek")(day).cast("long").alias("dow"), F.size(f("split")(c("c_name"), ".")).cast("long").alias("parts"), compat.cast_half_even(c("c_acctbal"), "long").alias("rounded"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE greatest(n_nationkey, n_regionkey, 3) END AS g, isodow(DATE '2024-01-01' + n_nationkey) AS dow FROM nation")
def compat_trino(t: Tables) -> DataFrame:
    some = F.when(F.col("n_nationkey") % 5 != 0, F.lit(3))
    return t.nation.select("n_nationkey", compat.function("trino", "greatest")(F.col("n_nationkey"), F.col("n_regionkey"), some).alias("g"), compat.function("trino", "day_of_week")(F.date_add(F.lit("2024-01-01").cast("date"), F.col("n_nationkey"))).cast("long").alias("dow"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n, count(*) - count({c}) AS nulls, CAST(min({c}) AS VARCHAR) AS least, CAST(max({c}) AS VARCHAR) AS greatest FROM labelled" for c in ("doc_id", "source", "n_chars", "quality", "toxic")).replace("FROM labelled", "FROM (SELECT * FROM documents LEFT JOIN labels USING (doc_id))"))
def table_summary(t: Tables) -> DataFrame:
    df = t.documents.join(t.labels, "doc_id", "left").select("doc_id", "source", "n_chars", "quality", "toxic")
    return tables.summarize(df).select("column", "n", "nulls", "least", "greatest")


@query("SELECT p_partkey, p_retailprice * (1 + 0.1::DOUBLE) AS taxed FROM part WHERE p_size < 10")
def table_function_macro(t: Tables) -> DataFrame:
    tables.create_function(t.spark, "with_tax", {"x": "DOUBLE", "rate": "DOUBLE"}, "DOUBLE", "x * (1 + rate)")
    return t.spark.sql("SELECT p_partkey, with_tax(p_retailprice, 0.1) AS taxed FROM {p} WHERE p_size < 10", p=t.part)


@query("SELECT r_name, n_name FROM region JOIN nation ON r_regionkey = n_regionkey")
def join_hinted(t: Tables) -> DataFrame:
    return tables.hinted(t.region, "merge").join(t.nation, F.col("r_regionkey") == F.col("n_regionkey")).select("r_name", "n_name")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY md5('1|' || o_orderkey || '|' || o_custkey) LIMIT 100")
def sample_rows(t: Tables) -> DataFrame:
    return tables.sample_rows(t.orders.select("o_orderkey", "o_custkey"), 100)


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_totalprice > 200000")
def sort_distribute_by(t: Tables) -> DataFrame:
    return tables.distribute_by(t.orders.where("o_totalprice > 200000").select("o_custkey", "o_orderkey"), "o_custkey", sort=["o_custkey", "o_orderkey"])


@query("""SELECT doc_id, (SELECT count(*) FROM (SELECT unnest(string_split(lower(text), ' ')) AS w) WHERE w = 'the')::BIGINT AS the, len(text)::BIGINT AS chars, text LIKE '%the%' AS has, md5(text) AS digest, left(text, 10) AS head, right(text, 5) AS tail FROM documents""")
def documents_text_profile(t: Tables) -> DataFrame:
    words = F.split(F.lower("text"), " ", -1)
    return t.documents.select("doc_id", F.size(F.filter(words, lambda w: w == "the")).cast("long").alias("the"), F.length("text").cast("long").alias("chars"), F.col("text").like("%the%").alias("has"), F.md5("text").alias("digest"), F.left("text", F.lit(10)).alias("head"), F.right("text", F.lit(5)).alias("tail"))


@query("""SELECT source, count(*) AS docs, count(DISTINCT lang) AS langs, round(avg(n_chars), 4) AS chars, round(avg(quality), 6) AS quality FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL""")
def documents_by_source(t: Tables) -> Pipe:
    return t.pipe("documents").join(t.labels, ["doc_id"], "left").aggregate("count(*) AS docs", "count(DISTINCT lang) AS langs", "round(avg(n_chars), 4) AS chars", "round(avg(quality), 6) AS quality", group_by="source")


@query("""SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles, max(turn) AS last_turn, sum(len(text))::BIGINT AS chars FROM conversations GROUP BY ALL""")
def conversations_rollup(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id").agg(aggregates.list_agg("role", ">", "turn").alias("roles"), F.max("turn").alias("last_turn"), F.sum(F.length("text")).alias("chars"))


@query("""SELECT user_id, event_type, count(*) AS n, round(sum(value), 4) AS total, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY ALL HAVING count(*) > 1""")
def events_profile(t: Tables) -> Pipe:
    return t.pipe("events").aggregate("count(*) AS n", "round(sum(value), 4) AS total", "min(ts) AS first_ts", "max(ts) AS last_ts", group_by=["user_id", "event_type"]).where("n > 1")


# Spark's own functions, several a query


@query("""SELECT c_custkey, upper(c_mktsegment) AS a, lower(c_mktsegment) AS b, trim('  ' || c_name || ' ') AS c, repeat('ab', c_nationkey % 3) AS d, replace(c_name, '#', '-') AS e, position('o' IN c_name)::BIGINT AS f, substring(c_name, 3, 4) AS g, split_part(c_name, '#', 1) AS h, hex(c_mktsegment) AS i, sha256(c_name) AS j, to_base64(encode(c_mktsegment)) AS k, ascii(c_mktsegment)::BIGINT AS l, chr(65 + c_nationkey) AS m, rpad(c_mktsegment, 12, '.') AS n, ends_with(c_name, '1') AS o, contains(c_name, '10') AS p, sha1(c_name) AS q, bit_length(c_name)::BIGINT AS r, strlen(c_name)::BIGINT AS s FROM customer""")
def builtin_strings(t: Tables) -> Pipe:
    return t.pipe("customer").select("c_custkey", "upper(c_mktsegment) AS a", "lower(c_mktsegment) AS b", "trim('  ' || c_name || ' ') AS c", "repeat('ab', c_nationkey % 3) AS d", "replace(c_name, '#', '-') AS e", "bigint(position('o', c_name)) AS f", "substring(c_name, 3, 4) AS g", "split_part(c_name, '#', 1) AS h", "hex(c_mktsegment) AS i", "sha2(c_name, 256) AS j", "base64(encode(c_mktsegment, 'UTF-8')) AS k", "bigint(ascii(c_mktsegment)) AS l", "char(65 + c_nationkey) AS m", "rpad(c_mktsegment, 12, '.') AS n", "endswith(c_name, '1') AS o", "contains(c_name, '10') AS p", "sha1(c_name) AS q", "bigint(bit_length(c_name)) AS r", "bigint(octet_length(c_name)) AS s")


@query(r"""SELECT doc_id, regexp_extract(text, '([A-Za-z]+)[ .,]', 1) AS a, regexp_matches(text, 't.e') AS b, len(regexp_extract_all(text, '[aeiou]+'))::BIGINT AS c, md5(regexp_replace(text, '[^a-z]+', '_', 'g')) AS d, len(string_split_regex(text, '[ \n]+'))::BIGINT AS e, text ILIKE '%THE%' AS f FROM documents""")
def builtin_regex(t: Tables) -> DataFrame:
    c = F.col("text")
    return t.documents.select("doc_id", F.regexp_extract(c, "([A-Za-z]+)[ .,]", 1).alias("a"), F.regexp_like(c, F.lit("t.e")).alias("b"), F.regexp_count(c, F.lit("[aeiou]+")).cast("long").alias("c"), F.md5(F.regexp_replace(c, "[^a-z]+", "_")).alias("d"), F.size(F.split(c, "[ \n]+", -1)).cast("long").alias("e"), c.ilike("%THE%").alias("f"))


@query("""SELECT p_partkey, abs(p_size - 25) AS a, CAST(ceil(p_retailprice) AS BIGINT) AS b, CAST(floor(p_retailprice) AS BIGINT) AS c, round(sqrt(p_retailprice), 8) AS d, round(cbrt(p_retailprice), 8) AS e, round(exp(p_size / 50.0), 8) AS f, round(ln(p_retailprice), 8) AS g, round(pow(p_size, 1.5), 6) AS h, round(sin(p_size) + cos(p_size) + atan(p_size), 8) AS i, round(degrees(p_size / 10.0), 6) AS j, round(radians(p_size), 8) AS k, CAST(sign(p_size - 25) AS DOUBLE) AS l, p_size % 7 AS m, factorial(p_size % 10)::BIGINT AS n, p_size & 6 AS p, p_size | 8 AS q, xor(p_size, 5) AS r, p_size << 2 AS s, bit_count(p_size)::BIGINT AS t, round(atan2(p_size, 3), 8) AS u, round(tanh(p_size / 20.0), 8) AS v FROM part""")
def builtin_math(t: Tables) -> Pipe:
    return t.pipe("part").select("p_partkey", "abs(p_size - 25) AS a", "ceil(p_retailprice) AS b", "floor(p_retailprice) AS c", "round(sqrt(p_retailprice), 8) AS d", "round(cbrt(p_retailprice), 8) AS e", "round(exp(p_size / 50D), 8) AS f", "round(ln(p_retailprice), 8) AS g", "round(pow(p_size, 1.5D), 6) AS h", "round(sin(p_size) + cos(p_size) + atan(p_size), 8) AS i", "round(degrees(p_size / 10D), 6) AS j", "round(radians(p_size), 8) AS k", "sign(p_size - 25) AS l", "p_size % 7 AS m", "factorial(p_size % 10) AS n", "p_size & 6 AS p", "p_size | 8 AS q", "p_size ^ 5 AS r", "shiftleft(p_size, 2) AS s", "bigint(bit_count(p_size)) AS t", "round(atan2(p_size, 3), 8) AS u", "round(tanh(p_size / 20D), 8) AS v")


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) + 10 AS a, CAST(CAST(o_orderdate AS DATE) + INTERVAL 2 MONTH AS DATE) AS b, dayofyear(o_orderdate) AS c, day(o_orderdate) AS d, hour(o_orderdate) AS e, date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') AS f, make_date(year(o_orderdate), 6, 1) AS g, epoch(o_orderdate)::BIGINT AS h, strftime(o_orderdate, '%d/%m/%Y') AS i, date_trunc('month', o_orderdate) AS j, dayname(o_orderdate) AS k, monthname(o_orderdate) AS l, o_orderdate + INTERVAL 90 MINUTE AS m, CAST(strptime('1998-01-02 03:04:05', '%Y-%m-%d %H:%M:%S') AS TIMESTAMP) AS n FROM orders""")
def builtin_dates(t: Tables) -> Pipe:
    return t.pipe("orders").select("o_orderkey", "date_add(date(o_orderdate), 10) AS a", "add_months(date(o_orderdate), 2) AS b", "bigint(dayofyear(o_orderdate)) AS c", "bigint(day(o_orderdate)) AS d", "bigint(hour(o_orderdate)) AS e", "bigint(datediff(DATE '2000-01-01', o_orderdate)) AS f", "make_date(year(o_orderdate), 6, 1) AS g", "unix_seconds(timestamp(o_orderdate)) AS h", "date_format(o_orderdate, 'dd/MM/yyyy') AS i", "CAST(date_trunc('MONTH', o_orderdate) AS TIMESTAMP_NTZ) AS j", "date_format(o_orderdate, 'EEEE') AS k", "date_format(o_orderdate, 'MMMM') AS l", "o_orderdate + INTERVAL 90 MINUTES AS m", "to_timestamp_ntz('1998-01-02 03:04:05', 'yyyy-MM-dd HH:mm:ss') AS n")


@query("""SELECT user_id, list_contains(k, 'click') AS a, len(k)::BIGINT AS b, array_to_string(list_sort(k), ',') AS c, array_to_string(list_reverse_sort(k), ',') AS d, coalesce(list_position(list_sort(k), 'view'), 0)::BIGINT AS e, array_to_string(list_sort(list_intersect(k, ['click', 'view'])), ',') AS f, list_has_any(k, ['view', 'zzz']) AS g, array_to_string(list_sort(list_distinct(list_concat(k, ['click', 'new']))), ',') AS h, array_to_string(flatten([list_sort(k), ['x']]), ',') AS i, list_max(k) AS j, list_min(k) AS l, array_to_string(list_sort(k)[1:2], ',') AS m, array_to_string(list_transform(list_sort(k), lambda x: upper(x)), ',') AS n, len(list_filter(k, lambda x: x > 'd'))::BIGINT AS o FROM (SELECT user_id, list_distinct(list(event_type)) AS k FROM events GROUP BY ALL)""")
def builtin_arrays(t: Tables) -> Pipe:
    k = t.pipe("events").aggregate("sort_array(collect_set(event_type)) AS k", group_by="user_id")
    return k.select("user_id", "array_contains(k, 'click') AS a", "bigint(size(k)) AS b", "array_join(k, ',') AS c", "array_join(sort_array(k, false), ',') AS d", "array_position(k, 'view') AS e", "array_join(array_sort(array_intersect(k, array('click', 'view'))), ',') AS f", "arrays_overlap(k, array('view', 'zzz')) AS g", "array_join(array_sort(array_union(k, array('click', 'new'))), ',') AS h", "array_join(flatten(array(k, array('x'))), ',') AS i", "array_max(k) AS j", "array_min(k) AS l", "array_join(slice(k, 1, 2), ',') AS m", "array_join(transform(k, x -> upper(x)), ',') AS n", "bigint(size(filter(k, x -> x > 'd'))) AS o")


@query("""SELECT event_type, array_to_string(list_transform(list_sort(map_keys(m)), lambda x: CAST(x AS VARCHAR)), ',') AS keys, CAST(list_sum(map_values(m)) AS BIGINT) AS total, m[1] AS one, len(map_entries(m))::BIGINT AS n FROM (SELECT event_type, map_from_entries(list((b, n))) AS m FROM (SELECT event_type, CAST(hour(ts) % 4 AS INTEGER) AS b, count(*) AS n FROM events GROUP BY ALL) GROUP BY ALL)""")
def builtin_maps(t: Tables) -> Pipe:
    m = t.pipe("events").aggregate("count(*) AS n", group_by=["event_type", "hour(ts) % 4 AS b"]).aggregate("map_from_entries(collect_list(struct(b, n))) AS m", group_by="event_type")
    return m.select("event_type", "array_join(transform(array_sort(map_keys(m)), x -> string(x)), ',') AS keys", "aggregate(map_values(m), 0L, (a, x) -> a + x) AS total", "try_element_at(m, 1) AS one", "bigint(size(map_entries(m))) AS n")


@query("""SELECT event_id, json_extract_string(j, '$.t') AS t, CAST(json_extract_string(j, '$.v.x') AS BIGINT) AS x, json_array_length(j, '$.a')::BIGINT AS n, json_extract_string(j, '$.a[1]') AS second FROM (SELECT event_id, '{"t":"' || event_type || '","v":{"x":' || user_id || '},"a":[1,' || event_id || ']}' AS j FROM events)""")
def builtin_json(t: Tables) -> Pipe:
    j = t.pipe("events").select("event_id", """to_json(named_struct('t', event_type, 'v', named_struct('x', user_id), 'a', array(1L, event_id))) AS j""")
    return j.select("event_id", "get_json_object(j, '$.t') AS t", "bigint(get_json_object(j, '$.v.x')) AS x", "bigint(json_array_length(get_json_object(j, '$.a'))) AS n", "variant_get(parse_json(j), '$.a[1]', 'string') AS second")


@query("""SELECT c_nationkey, count(*) AS n, count(DISTINCT c_mktsegment) AS d, round(sum(c_acctbal), 2) AS s, round(avg(c_acctbal), 6) AS m, min(c_acctbal) AS lo, max(c_acctbal) AS hi, round(stddev_pop(c_acctbal), 6) AS sd, round(median(c_acctbal), 6) AS med, any_value(c_nationkey) AS av, bool_and(c_acctbal > -1000) AS ba, count_if(c_acctbal < 0)::BIGINT AS ci, round(quantile_disc(c_acctbal, 0.25), 6) AS qd FROM customer GROUP BY ALL""")
def builtin_aggregates(t: Tables) -> Pipe:
    return t.pipe("customer").aggregate("count(*) AS n", "count(DISTINCT c_mktsegment) AS d", "round(sum(c_acctbal), 2) AS s", "round(avg(c_acctbal), 6) AS m", "min(c_acctbal) AS lo", "max(c_acctbal) AS hi", "round(stddev_pop(c_acctbal), 6) AS sd", "round(median(c_acctbal), 6) AS med", "any_value(c_nationkey) AS av", "bool_and(c_acctbal > -1000) AS ba", "count_if(c_acctbal < 0) AS ci", "round(percentile_disc(0.25) WITHIN GROUP (ORDER BY c_acctbal), 6) AS qd", group_by="c_nationkey")


@query("""SELECT url, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path, len(html)::BIGINT AS size, html LIKE '%<table%' AS has_table, len(regexp_extract_all(html, '<p[ >]'))::BIGINT AS paragraphs FROM pages""")
def builtin_urls(t: Tables) -> DataFrame:
    return t.pages.select("url", F.parse_url("url", F.lit("HOST")).alias("host"), F.parse_url("url", F.lit("PATH")).alias("path"), F.length("html").cast("long").alias("size"), F.col("html").like("%<table%").alias("has_table"), F.regexp_count("html", F.lit("<p[ >]")).cast("long").alias("paragraphs"))


# SQL that Spark has itself, and streams


@query("SELECT n_nationkey, w, pos FROM (SELECT n_nationkey, unnest(string_split(n_name, ' ')) AS w, CAST(generate_subscripts(string_split(n_name, ' '), 1) - 1 AS INTEGER) AS pos FROM nation)")
def sql_lateral_view(t: Tables) -> DataFrame:
    return t.spark.sql("SELECT n_nationkey, w, pos FROM {n} LATERAL VIEW posexplode(split(n_name, ' ')) x AS pos, w", n=t.nation)


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS p FROM orders GROUP BY ALL ORDER BY ALL")
def sql_group_by_all(t: Tables) -> DataFrame:
    return t.spark.sql("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS p FROM {o} GROUP BY ALL ORDER BY ALL", o=t.orders)


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS running, count(*) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS near FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def sql_named_windows(t: Tables) -> DataFrame:
    return t.spark.sql("SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS running, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS near FROM {o} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)", o=t.orders)


@query("WITH big AS (SELECT * FROM orders WHERE o_totalprice > 250000), who AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY ALL) SELECT c_custkey, c_name, n FROM who JOIN customer ON c_custkey = o_custkey WHERE n >= 2 AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)")
def sql_ctes(t: Tables) -> DataFrame:
    return t.spark.sql("WITH big AS (SELECT * FROM {o} WHERE o_totalprice > 250000), who AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY ALL) SELECT c_custkey, c_name, n FROM who JOIN {c} ON c_custkey = o_custkey WHERE n >= 2 AND c_nationkey IN (SELECT n_nationkey FROM {n} WHERE n_regionkey < 3)", o=t.orders, c=t.customer, n=t.nation)


@query("SELECT o_custkey, (SELECT max(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey) AS top, count(*) AS n FROM orders o GROUP BY ALL")
def sql_correlated_scalar(t: Tables) -> DataFrame:
    files.register(t.spark, t.sf_dir, "orders")
    return t.spark.sql("SELECT o_custkey, any_value(top) AS top, count(*) AS n FROM (SELECT o_custkey, (SELECT max(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey) AS top FROM orders o) GROUP BY o_custkey")


@query("SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling(t: Tables) -> DataFrame:
    schema = t.events.schema
    stream = files.stream(t.spark, f"{t.sf_dir}/event*.parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))
    out = event_windows.run_to_table(event_windows.windowed(stream, "ts", "1 day", F.count("*").alias("n"), by=["event_type"], late="1 day"), "stream_tumbling_result")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@query("SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events")
def stream_deduplicated(t: Tables) -> DataFrame:
    """Each user's kinds of events by day, once: state goes as the watermark passes, a day after."""
    stream = files.stream(t.spark, f"{t.sf_dir}/event*.parquet", t.events.schema).select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), F.col("ts").cast("date").alias("day"))
    once = event_windows.deduplicated(stream, ["user_id", "event_type", "day"], "ts", "1 day").select("user_id", "event_type", "day")
    return event_windows.run_to_table(once, "stream_deduplicated_result", "append")


# Operators in depth: sides of joins, frames, ranks, formats, shapes


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(t: Tables) -> Pipe:
    return t.pipe("region").join(t.nation).select("r_name", "n_name")


@query("SELECT p_partkey, p_size BETWEEN least(40, p_partkey % 50) AND greatest(40, p_partkey % 50) AS inside FROM part")
def scalar_between_symmetric(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", numbers.between_symmetric(F.col("p_size"), F.lit(40), F.col("p_partkey") % 50).alias("inside"))


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def source_csv(t: Tables) -> DataFrame:
    """The customers, written as CSV with a header and read with their schema."""
    path = spool.folder(t.spark, "customers")
    files.copy_to(t.customer, path, "csv", header="true")
    return files.read_csv(t.spark, path, t.customer.schema)


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def source_partitioned_copy(t: Tables) -> DataFrame:
    """Events written by type, and read by a filter that prunes folders."""
    path = spool.folder(t.spark, "events")
    files.copy_to(t.events.select("user_id", "event_type"), path, "json", partition_by=["event_type"])
    read = files.read_json(t.spark, path, "user_id long, event_type string")
    return read.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name)::INTEGER AS pos, n_name AS name, n_nationkey AS id FROM nation")
def source_json_table(t: Tables) -> DataFrame:
    nations = t.nation.groupBy("n_regionkey").agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct("n_name", "n_nationkey"))).alias("list"))).alias("doc"))
    return files.json_table(nations, "doc", "$.list", {"name": ("string", "$.n_name"), "id": ("int", "$.n_nationkey")}, ordinality="pos").drop("doc")


@query("SELECT n_regionkey, n_name AS name, n_nationkey AS id FROM nation")
def source_xml_table(t: Tables) -> DataFrame:
    row = F.concat(F.lit("<n>"), misc.xml_element("name", F.col("n_name")), misc.xml_element("id", F.col("n_nationkey")), F.lit("</n>"))
    docs = t.nation.groupBy("n_regionkey").agg(F.concat(F.lit("<r>"), F.array_join(F.collect_list(row), ""), F.lit("</r>")).alias("doc"))
    return files.xml_table(docs, "doc", "/r/n", {"name": ("string", "name/text()"), "id": ("int", "id/text()")}).drop("doc")


@query("""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 450000 GROUP BY ALL),
s AS (SELECT CAST(unnest(generate_series(TIMESTAMP '1996-01-01', TIMESTAMP '1996-12-31', INTERVAL 1 DAY)) AS DATE) AS day)
SELECT s.day, last_value(n IGNORE NULLS) OVER (ORDER BY s.day) AS n FROM s LEFT JOIN d ON d.day = s.day""")
def sort_interpolate(t: Tables) -> DataFrame:
    days = t.orders.where("o_orderpriority = '1-URGENT' AND o_totalprice > 450000").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("n"))
    day = lambda s: F.lit(s).cast("date")
    return sorting.with_fill(days.where("year(day) = 1996"), "day", day("1996-01-01"), day("1997-01-01"), F.expr("INTERVAL 1 DAY"), interpolate=["n"])


@query("""SELECT o_custkey, round(sum(o_totalprice), 2) AS first_day, count(*) AS n FROM orders o WHERE o_orderdate = (SELECT min(o_orderdate) FROM orders i WHERE i.o_custkey = o.o_custkey) GROUP BY ALL""")
def window_keep(t: Tables) -> DataFrame:
    both = F.struct(F.round(F.sum("o_totalprice"), 2).alias("first_day"), F.count("*").alias("n"))
    return windows.keep(t.orders, ["o_custkey"], "o_orderdate", both, "x").select("o_custkey", "x.first_day", "x.n")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(avg(l_quantity) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING EXCLUDE CURRENT ROW), 6) AS a, min(l_quantity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP) AS lo, max(l_quantity) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE TIES) AS hi,
count(l_quantity) OVER (w ROWS BETWEEN 3 PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE GROUP) AS n, round(sum(l_quantity) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE NO OTHERS), 4) AS s
FROM (SELECT *, l_quantity > 25 AS big FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)""")
def window_exclude_frames(t: Tables) -> DataFrame:
    by, order = ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"]
    df = windows.deal(t.lineitem, by)
    first, last = Window.unboundedPreceding, Window.unboundedFollowing
    for name, agg, what, lo, hi in (("a", "avg", "current row", -2, 1), ("lo", "min", "group", first, 0), ("hi", "max", "ties", -2, 2), ("n", "count", "group", -3, last), ("s", "sum", "no others", -1, 1)):
        df = windows.exclude(df, "l_quantity", name, by, order, what, lo, hi, agg)
    return df.select("l_orderkey", "l_linenumber", "l_partkey", F.round("a", 6).alias("a"), "lo", "hi", "n", F.round("s", 4).alias("s"))


@query("""SELECT event_id, count(v) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE GROUP) AS n_group, round(sum(v) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE TIES), 4) AS no_ties FROM (SELECT event_id, user_id, event_type, CASE WHEN event_id % 5 > 0 THEN round(value, 3) END AS v FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_type)""")
def window_exclude_ties(t: Tables) -> DataFrame:
    df = windows.deal(t.events, ["user_id"]).withColumn("v", F.when(F.col("event_id") % 5 > 0, F.round("value", 3)))
    a = windows.exclude(df, "v", "n_group", ["user_id"], ["event_type"], "group", agg="count")
    return windows.exclude(a, "v", "no_ties", ["user_id"], ["event_type"], "ties").select("event_id", "n_group", F.round("no_ties", 4).alias("no_ties"))


@query("SELECT event_id, CAST(epoch_us(ts AT TIME ZONE 'America/New_York') AS BIGINT) AS instant, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Tokyo' AS tokyo, (ts AT TIME ZONE 'Europe/Berlin') AT TIME ZONE 'Australia/Sydney' AS sydney FROM events")
def temporal_at_time_zone(t: Tables) -> DataFrame:
    ts = F.col("ts")
    return t.events.select("event_id", F.unix_micros(temporal.at_time_zone(ts, "America/New_York")).alias("instant"), temporal.at_time_zone(temporal.at_time_zone(ts, "UTC"), "Asia/Tokyo", has_zone=True).alias("tokyo"), temporal.between_zones(ts, "Europe/Berlin", "Australia/Sydney").alias("sydney"))


@query("SELECT c_custkey, c_nationkey FROM customer")
def star_ilike(t: Tables) -> DataFrame:
    return misc.star(t.customer, ilike="C_%key")


@query("SELECT 'passed on' AS path, o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT 'inserted', o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT 'exported', o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT 'teed', o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000")
def pipe_tee_insert_export(t: Tables) -> DataFrame:
    """A table, files and a sink get the rows that go on."""
    name, at, side = f"teed_{spool.folder(t.spark, 'x')[-12:]}", spool.folder(t.spark, "exported"), spool.folder(t.spark, "side")
    p = t.pipe("orders").where("o_totalprice > 400000").select("o_orderkey", "o_totalprice")
    tables.create_table_as(p.df.limit(0), name)
    went = p.tee(lambda df: df.write.parquet(side)).insert(name).export(at, "json").df
    table = spool.written(t.spark.table(name))
    tables.drop(t.spark, name)
    parts = {"passed on": went, "inserted": table, "exported": files.read_json(t.spark, at, went.schema), "teed": files.read_parquet(t.spark, side)}
    return functools.reduce(DataFrame.union, [df.select(F.lit(k).alias("path"), "o_orderkey", "o_totalprice") for k, df in parts.items()])


@query("SELECT c_nationkey, n, row_number() OVER (ORDER BY n DESC, c_nationkey)::BIGINT AS place FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY ALL)")
def pipe_aggregate_ordered(t: Tables) -> DataFrame:
    """Aggregate elements with an order of their own: the place of each row in the result."""
    out = t.pipe("customer").aggregate("count(*) AS n", group_by="c_nationkey", order_by=["n DESC", "c_nationkey"])
    return joins.numbered(out.df, [F.col("n").desc(), F.col("c_nationkey")], "place", parts=4)


@query("""SELECT * FROM (VALUES (0, 'FROM orders', 'o_orderkey', 'bigint'), (1, 'SELECT', 'o_orderkey', 'bigint'), (1, 'SELECT', 'net', 'double'), (2, 'EXTEND', 'o_orderkey', 'bigint'), (2, 'EXTEND', 'net', 'double'), (2, 'EXTEND', 'large', 'boolean'), (3, 'AGGREGATE', 'large', 'boolean'), (3, 'AGGREGATE', 'n', 'bigint')) v(stage, name, col, kind)""")
def shape_stages(t: Tables) -> DataFrame:
    """Columns after each stage, from Spark's analysis alone."""
    p = Pipe(t.orders.select("o_orderkey"), head="FROM orders")
    p = Pipe(t.orders, p.stages).select("o_orderkey", "o_totalprice * 0.9D AS net").extend("net > 100000 AS large").aggregate("count(*) AS n", group_by="large")
    return files.values(t.spark, [(i, s.name, f.name, f.dataType.simpleString()) for i, s in enumerate(p.stages) for f in s.schema], "stage int, name string, col string, kind string")


@query("""SELECT * FROM (VALUES ('k', 'customer.c_custkey'), ('k', 'orders.o_custkey'), ('n', 'customer.c_custkey'), ('n', 'orders.o_custkey'), ('total', 'customer.c_custkey'), ('total', 'orders.o_custkey'), ('total', 'orders.o_totalprice')) v(output, source)""")
def shape_dependencies(t: Tables) -> DataFrame:
    def build(customer: DataFrame, orders: DataFrame) -> DataFrame:
        both = customer.join(orders, customer["c_custkey"] == orders["o_custkey"])
        aggs = [F.count("*").alias("n")] + [F.sum("o_totalprice").alias("total")] * ("o_totalprice" in orders.columns)
        return both.groupBy(F.col("c_custkey").alias("k")).agg(*aggs)

    found = shape.dependencies(build, {"customer": t.customer.select("c_custkey", "c_name"), "orders": t.orders.select("o_custkey", "o_totalprice")})
    return files.values(t.spark, [(o, s) for o, sources in found.items() for s in sources], "output string, source string")


@query("""SELECT * FROM (VALUES ('same', 'SATISFIES', '', '', ''), ('more', 'HAS_ADDITIONAL', '', 'n_regionkey', ''), ('less', 'HAS_LESS', 'n_comment', 'n_regionkey', ''), ('type', 'HAS_LESS', '', 'n_regionkey', 'n_name'), ('null', 'HAS_LESS', '', 'n_regionkey', 'n_nationkey')) v(name, verdict, missing, additional, mismatched)""")
def shape_compare(t: Tables) -> DataFrame:
    two = {"N_NATIONKEY": "int", "n_name": "string"}
    wanted = {"same": {**two, "n_regionkey": shape.ANY}, "more": two, "less": {**two, "n_comment": "string"}, "type": {"n_nationkey": "int", "n_name": "double"}, "null": {"n_nationkey": shape.field_of("n_nationkey", "int", False), "n_name": "string"}}
    found = {k: shape.compare(t.nation.schema, v) for k, v in wanted.items()}
    return files.values(t.spark, [(k, c.verdict.name, ",".join(c.missing), ",".join(c.additional), ",".join(m[0] for m in c.mismatched)) for k, c in found.items()], "name string, verdict string, missing string, additional string, mismatched string")


@query("""SELECT * FROM (VALUES ('k', false), ('v', true), ('doubled', true), ('filled', false), ('n', false), ('other', true)) v(col, may_be_null)""")
def shape_nullability(t: Tables) -> DataFrame:
    """Which columns may be null, from declared slots through a left join, expressions and windows."""
    text = "SELECT a.k, a.v, a.v * 2 AS doubled, coalesce(a.v, 0) AS filled, count(*) OVER (PARTITION BY a.k) AS n, b.k AS other FROM {a} a LEFT JOIN {b} b ON a.k = b.k"
    slot = shape.StructType([shape.field_of("k", "int", False), shape.field_of("v", "int")])
    found = shape.nullability(shape.Fragment(text, slots=("a", "b")).shape(t.spark, {"a": slot, "b": slot}))
    return files.values(t.spark, list(found.items()), "col string, may_be_null boolean")


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 300000 GROUP BY ALL")
def shape_fragment(t: Tables) -> DataFrame:
    """A query as a value, bound to a table and a parameter."""
    f = shape.Fragment("SELECT o_orderstatus, count(*) AS n FROM {rows} WHERE o_totalprice > :least GROUP BY o_orderstatus", ("least",), ("rows",), {"least": 100000})
    return f.bind(t.spark, {"rows": t.orders}, least=300000)


@query("""SELECT '{"c_mktsegment":"' || c_mktsegment || '","n":' || count(*) || '}' AS line FROM customer WHERE c_acctbal > 1000 GROUP BY c_mktsegment""")
def session_query(t: Tables) -> DataFrame:
    with Engine(t.spark) as e:
        return e.register(customer_rows=t.customer).query("SELECT c_mktsegment, count(*) AS n FROM customer_rows WHERE c_acctbal > :least GROUP BY c_mktsegment", args={"least": 1000})


@query("""WITH s AS (SELECT user_id, event_id, row_number() OVER w AS i, value > lag(value) OVER w AS up FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, i - row_number() OVER (PARTITION BY user_id, coalesce(up, false) ORDER BY i) AS g FROM s), m AS (SELECT *, count(*) OVER (PARTITION BY user_id, g) AS n, min(i) OVER (PARTITION BY user_id, g) AS lo FROM g WHERE up)
SELECT user_id, event_id, dense_rank() OVER (PARTITION BY user_id ORDER BY lo)::INTEGER AS match_number, 'RISE' AS classifier FROM m WHERE n >= 2""")
def match_all_rows(t: Tables) -> DataFrame:
    """All rows of each rise of two steps or more, with the number of the match and the symbol."""
    rise = {"RISE": lambda w: F.coalesce(F.col("value") > F.lag("value").over(w), F.lit(False))}
    return matching.match_recognize(t.events, ["user_id"], ["ts", "event_id"], rise, "RISE{2,}", all_rows=True).select("user_id", "event_id", "match_number", "classifier")


@query("""WITH s AS (SELECT user_id, event_id, event_type AS a, lead(event_type) OVER w AS b, lead(event_type, 2) OVER w AS c, lead(event_id, 2) OVER w AS last FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id AS first_event, last AS last_event FROM s WHERE a = 'view' AND b = 'click' AND c IN ('view', 'click')""")
def match_overlapping(t: Tables) -> DataFrame:
    """A view, a click and either of both; the search goes on at the next row, so matches overlap."""
    symbols = {"VIEW": "event_type = 'view'", "CLICK": "event_type = 'click'"}
    found = matching.match_recognize(t.events, ["user_id"], ["ts", "event_id"], symbols, "VIEW CLICK (VIEW|CLICK)", {"first_event": ("first", "event_id", ""), "last_event": ("last", "event_id", "")}, after="next row")
    return found.select("user_id", "first_event", "last_event")


@query("""WITH RECURSIVE tree AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 1 THEN p_partkey // 4 + 1 END AS parent FROM part WHERE p_partkey // 4 + 1 < p_partkey OR p_partkey <= 1),
h AS (SELECT id, 1 AS level, [id] AS path FROM tree WHERE parent IS NULL UNION ALL SELECT t.id, h.level + 1, list_append(h.path, t.id) FROM tree t JOIN h ON t.parent = h.id)
SELECT id, level, row_number() OVER (ORDER BY path) AS depth_first, row_number() OVER (ORDER BY level, path) AS breadth_first FROM h""")
def recursive_search(t: Tables) -> DataFrame:
    tree = t.part.selectExpr("p_partkey AS id", "CASE WHEN p_partkey > 1 THEN p_partkey DIV 4 + 1 END AS parent").where("parent < id OR parent IS NULL")
    found = recursion.connect_by(tree, "id", "parent", "parent IS NULL")
    a, b = recursion.search_order(found, "id", "depth_first"), recursion.search_order(found, "id", "breadth_first", depth_first=False)
    return a.join(b.select("id", "breadth_first"), "id").select("id", "level", "depth_first", "breadth_first")


@query("SELECT 'repeated rows count' AS what, true AS holds UNION ALL SELECT 'order does not', true UNION ALL SELECT 'values do', true")
def agg_hash(t: Tables) -> DataFrame:
    """Hashes of groups of rows: of a group and its rows twice, in two orders, and with one value changed."""
    h = lambda df: df.agg(numbers.hash_agg(F.col("c_custkey"), F.col("c_name")).alias("h"))
    one, twice, turned, other = h(t.customer), h(t.customer.union(t.customer)), h(t.customer.orderBy(F.desc("c_name"))), h(t.customer.withColumn("c_name", F.when(F.col("c_acctbal") < 9000, F.col("c_name")).otherwise("x")))
    both = one.crossJoin(twice.withColumnRenamed("h", "h2")).crossJoin(turned.withColumnRenamed("h", "h3")).crossJoin(other.withColumnRenamed("h", "h4"))
    return both.select(F.inline(F.array(*[F.struct(F.lit(n).alias("what"), c.alias("holds")) for n, c in (("repeated rows count", F.col("h") != F.col("h2")), ("order does not", F.col("h") == F.col("h3")), ("values do", F.col("h") != F.col("h4")))])))


@query("""SELECT * FROM (VALUES ('sum', true), ('bogus_function', false), ('my_own', true)) v(function, known)""")
def table_registry(t: Tables) -> DataFrame:
    names = ["sum", "bogus_function", "my_own"]
    lacking = tables.unmappable(t.spark, names, {"MY_OWN": F.sum})
    return files.values(t.spark, [(n, n not in lacking) for n in names], "function string, known boolean")


# Functions, the rest of the library's own


@query(r"""SELECT doc_id, coalesce(list_has_all(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), ['the', 'and']), false) AS every, coalesce(list_has_any(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), ['der', 'que']), false) AS some, md5(nfc_normalize(text)) AS nfc, md5(text) AS back, ('0x' || substr(md5(source), 1, 16))::UBIGINT::VARCHAR AS upper64, ('0x' || substr(md5(source), 17, 16))::UBIGINT::VARCHAR AS lower64 FROM documents""")
def functions_text_more(t: Tables) -> DataFrame:
    c, no = F.col, F.lit(False)
    return t.documents.select("doc_id", F.coalesce(text.contains_words(c("text"), "The and"), no).alias("every"), F.coalesce(text.contains_words(c("text"), "der que", every=False), no).alias("some"), F.md5(text.normalize(c("text"), F.lit("NFC"))).alias("nfc"), F.md5(text.decompress_string(text.compress(c("text")))).alias("back"), text.md5_upper64(c("source")).cast("string").alias("upper64"), text.md5_lower64(c("source")).cast("string").alias("lower64"))


@query("""SELECT c_custkey, substring(c_name, 0, 5) AS zero, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS capital, c_mktsegment AS points, c_name AS base32, round(jaccard(c_mktsegment, 'MACHINERY'), 8) AS letters, hex(c_mktsegment) AS bytes FROM customer""")
def functions_text_codes(t: Tables) -> DataFrame:
    c = F.col
    seg = c("c_mktsegment")
    return t.customer.select("c_custkey", text.substring_zero(c("c_name"), 0, 5).alias("zero"), text.initcap_delimited(seg).alias("capital"), text.from_code_points(text.code_points(seg)).alias("points"), text.from_base32(text.to_base32(c("c_name"))).alias("base32"), F.round(text.jaccard_chars(seg, F.lit("MACHINERY")), 8).alias("letters"), F.hex(text.code_points_to_bytes(text.code_points(seg))).alias("bytes"))


@query("""WITH g AS (SELECT user_id, list(event_id ORDER BY event_id) AS ids, list(round(value, 3) ORDER BY event_id) AS v, list(CASE WHEN event_id % 4 > 0 THEN event_id END ORDER BY event_id) AS gaps, list_sort(list_distinct(list(event_type))) AS k FROM events GROUP BY ALL)
SELECT user_id, array_to_string(ids[2:], ',') AS without_first, array_to_string(ids[2:3], ',') AS middle, round(list_avg(v), 6) AS mean, len(list_filter(v, lambda x: x > 90)) > 0 AS some, len(list_filter(v, lambda x: x <= 5)) = 0 AS every, greatest(len(ids) - 1, 0)::BIGINT AS pairs, len(list_filter(gaps, lambda x: x IS NULL))::BIGINT AS nulls, array_to_string(list_transform(gaps, lambda x: coalesce(CAST(x AS VARCHAR), '-')), ',') AS in_order, round(len(list_intersect(k, ['click', 'view']))::DOUBLE / len(list_distinct(list_concat(k, ['click', 'view']))), 8) AS jac, list_has_any(k, ['view']) AS any_eq, len(list_filter(k, lambda x: x < 'zzz')) = len(k) AS all_less FROM g""")
def functions_arrays_more(t: Tables) -> DataFrame:
    e = t.events.select("user_id", "event_id", "event_type", F.round("value", 3).alias("v"), F.when(F.col("event_id") % 4 > 0, F.col("event_id")).alias("gap"))
    g = e.groupBy("user_id").agg(C.array_agg_nulls("event_id", "event_id").alias("ids"), C.array_agg_nulls("v", "event_id").alias("v"), C.array_agg_nulls("gap", "event_id").alias("gaps"), F.sort_array(F.collect_set("event_type")).alias("k"))
    join = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",", "-")
    ids, v, gaps, k, two = F.col("ids"), F.col("v"), F.col("gaps"), F.col("k"), F.array(F.lit("click"), F.lit("view"))
    return g.select("user_id", join(C.array_remove_at(ids, 0)).alias("without_first"), join(C.array_slice0(ids, 1, 3)).alias("middle"), F.round(C.array_avg(v), 6).alias("mean"), C.array_any(v, lambda x: x > 90).alias("some"), C.array_all(v, lambda x: x > 5).alias("every"), F.size(C.array_windows(ids, 2)).cast("long").alias("pairs"), F.size(F.filter(gaps, lambda x: x.isNull())).cast("long").alias("nulls"), join(gaps).alias("in_order"), F.round(C.jaccard(k, two), 8).alias("jac"), joins.in_any(F.lit("view"), k).alias("any_eq"), joins.in_all(F.lit("zzz"), k, ">").alias("all_less"))


@query("""SELECT event_type, string_agg(CAST(user_id AS VARCHAR) || ',' || event_id, ',' ORDER BY event_id) AS flat FROM events GROUP BY ALL""")
def functions_array_concat(t: Tables) -> DataFrame:
    pairs = t.events.select("event_type", "event_id", F.array("user_id", "event_id").alias("a"))
    return pairs.groupBy("event_type").agg(C.array_concat_agg("a", "event_id").alias("a")).select("event_type", F.array_join(F.transform("a", lambda x: x.cast("string")), ",").alias("flat"))


@query("""SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks, array_to_string(list_sort(list_filter(list_distinct(list(event_type)), lambda x: x IN ('view', 'click'))), ',') AS picked, array_to_string(list_sort(list_filter(list_distinct(list(event_type)), lambda x: x NOT IN ('view', 'click'))), ',') AS rest FROM events GROUP BY ALL""")
def functions_maps(t: Tables) -> DataFrame:
    m = t.events.groupBy("user_id", "event_type").count().groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "count"))).alias("m"))
    keys = lambda x: F.array_join(F.sort_array(F.map_keys(x)), ",")
    return m.select("user_id", F.coalesce(C.get_ignore_case(F.col("m"), "CLICK"), F.lit(0)).alias("clicks"), keys(C.map_pick(F.col("m"), "view", "click")).alias("picked"), keys(C.map_without(F.col("m"), "view", "click")).alias("rest"))


@query("""SELECT event_id, event_id % 3 > 0 AS has_b, true AS has_none, false AS has_other, 'x' || event_type AS second, true AS holds_one, event_id % 3 > 0 AS all_keys, '{"a":{"x":' || user_id || ',"y":null},"l":[1,"x' || event_type || '",null],"n":7' || CASE WHEN event_id % 3 > 0 THEN ',"b":' || event_id || '}' ELSE '}' END AS put, '{"a":{"x":' || user_id || '},"l":[1,"x' || event_type || '"]' || CASE WHEN event_id % 3 > 0 THEN ',"b":' || event_id || '}' ELSE '}' END AS stripped, 'a,a.x,a.y' || CASE WHEN event_id % 3 > 0 THEN ',b' ELSE '' END || ',l,n' AS keys2, user_id = 3 AS three, 4 AS longer FROM events""")
def functions_json_more(t: Tables) -> DataFrame:
    j = F.concat(F.lit('{"a":{"x":'), F.col("user_id").cast("string"), F.lit(',"y":null},"l":[1,"x'), F.col("event_type"), F.lit('",null],"n":null'), F.when(F.col("event_id") % 3 > 0, F.concat(F.lit(',"b":'), F.col("event_id").cast("string"))).otherwise(""), F.lit("}"))
    df, j = t.events.select("event_id", j.alias("j")), F.col("j")
    squeeze = lambda x: F.regexp_replace(x, r"(?<=[:,]) ", "")
    return df.select("event_id", C.json_exists(j, "$.b").alias("has_b"), C.json_exists(j, "$.n").alias("has_none"), C.json_exists(j, "$.a.z").alias("has_other"), F.get(C.json_array(j, "$.l"), F.lit(1)).alias("second"), C.json_array_contains(j, 1, "$.l").alias("holds_one"), C.json_has_all_keys(j, "a", "b").alias("all_keys"), squeeze(C.json_set(j, "$.n", 7)).alias("put"), squeeze(C.json_strip_nulls(C.json_remove(j, "$.zz"), arrays=True)).alias("stripped"), F.array_join(C.json_keys_at_depth(j, 2), ",").alias("keys2"), C.json_contains(j, '{"a":{"x":3}}').alias("three"), F.size(C.json_array(C.json_array_append(j, "$.l", 5), "$.l")).alias("longer"))


@query("""SELECT p_partkey, round(1 / sinh(p_size / 10.0), 8) AS csch, round(1 / tanh(p_size / 10.0), 8) AS coth, (p_size > 25) <> (p_retailprice > 950) AS either, isinf(CASE WHEN p_size > 40 THEN 'inf'::DOUBLE ELSE 1 END) AS inf, CASE WHEN p_size % 5 > 0 THEN least(p_size, 20) END AS strict, CASE WHEN p_size % 5 > 0 THEN p_retailprice END AS valx, p_partkey // 2 AS halves FROM part""")
def functions_numbers_more(t: Tables) -> DataFrame:
    x = F.col("p_size")
    some = F.when(x % 5 > 0, F.lit(20))
    return t.part.select("p_partkey", F.round(numbers.csch(x / 10.0), 8).alias("csch"), F.round(numbers.coth(x / 10.0), 8).alias("coth"), numbers.xor(x > 25, F.col("p_retailprice") > 950).alias("either"), numbers.is_inf(F.when(x > 40, F.lit(float("inf"))).otherwise(1.0)).alias("inf"), numbers.least_strict(x, some).alias("strict"), numbers.regr_valx(some, F.col("p_retailprice")).alias("valx"), compat.integer_division(F.col("p_partkey"), F.lit(2)).alias("halves"))


@query("""SELECT vec_id, round(list_cosine_distance(embedding::DOUBLE[], b::DOUBLE[]), 6) AS cos, round(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: abs(embedding[i]::DOUBLE - b[i]::DOUBLE))), 4) AS man, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings, (SELECT embedding AS b FROM embeddings WHERE vec_id = 1)""")
def functions_distances(t: Tables) -> DataFrame:
    one = t.embeddings.where("vec_id = 1").select(F.col("embedding").alias("b"))
    a, b = F.col("embedding"), F.col("b")
    return t.embeddings.crossJoin(F.broadcast(one)).select("vec_id", F.round(numbers.cosine_distance(a, b), 6).alias("cos"), F.round(numbers.manhattan_distance(a, b), 4).alias("man"), F.round(numbers.l2_norm(a), 6).alias("norm"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 400 < 256 THEN (10 * 256 + c_nationkey) * 65536 + (c_custkey // 400 % 256) * 256 + c_custkey % 400 END AS number, CASE WHEN c_custkey % 400 < 256 THEN '10.' || c_nationkey || '.' || c_custkey // 400 % 256 || '.' || c_custkey % 400 END AS again, CASE WHEN c_custkey % 400 < 256 THEN c_nationkey < 4 END AS inside FROM customer""")
def functions_addresses(t: Tables) -> DataFrame:
    """Addresses of customers, some of them malformed."""
    ip = F.concat_ws(".", F.lit("10"), "c_nationkey", F.expr("c_custkey DIV 400 % 256"), F.col("c_custkey") % 400)
    return t.customer.select("c_custkey", misc.ipv4_number(ip).alias("number"), F.when(misc.ipv4_number(ip).isNotNull(), misc.ipv4_text(misc.ipv4_number(ip))).alias("again"), misc.ipv4_in(ip, "10.0.0.0/14").alias("inside"))


@query(r"""SELECT page_id, CASE WHEN h LIKE '%.co.uk' OR h = 'co.uk' THEN 'co.uk' ELSE regexp_extract(h, '[^.]+$') END AS suffix, CASE WHEN h LIKE '%.co.uk' THEN regexp_extract(h, '[^.]+\.co\.uk$') WHEN h LIKE '%.%' THEN regexp_extract(h, '[^.]+\.[^.]+$') END AS domain FROM (SELECT *, lower(regexp_extract(url, '://([^/?#:]+)', 1)) AS h FROM pages)""")
def functions_hosts(t: Tables) -> DataFrame:
    known = ["uk", "co.uk"]
    return t.pages.select("page_id", misc.public_suffix(F.col("url"), known).alias("suffix"), misc.registered_domain(F.col("url"), known).alias("domain"))


@query("""SELECT o_orderkey, time_bucket(INTERVAL 10 DAY, o_orderdate, TIMESTAMP '1992-01-01') AS bin, CAST(strftime(o_orderdate, '%U') AS INTEGER) AS week0, CAST(o_orderdate AS DATE) - CAST((isodow(o_orderdate) + 5) % 7 + CASE WHEN (isodow(o_orderdate) + 5) % 7 = 0 THEN 7 ELSE 0 END AS INTEGER) AS tuesday, CAST(CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS INTEGER) + 719528 AS days, CAST(datesub('month', o_orderdate, TIMESTAMP '1999-01-15') AS INTEGER) AS months, o_orderkey % 100 + (o_orderkey % 200000) // 86400 AS d, (o_orderkey % 200000) % 86400 AS rest FROM orders""")
def functions_temporal_more(t: Tables) -> DataFrame:
    d, key = F.col("o_orderdate"), F.col("o_orderkey")
    days, rest = temporal.justify_hours(key % 100, key % 200000)
    return t.orders.select("o_orderkey", temporal.date_bin(d, 864000, "1992-01-01 00:00:00").alias("bin"), temporal.week_of_year(d).alias("week0"), temporal.previous_day(d, "TUE").alias("tuesday"), temporal.to_days(d).alias("days"), temporal.months_between_whole(F.lit("1999-01-15 00:00:00").cast("timestamp_ntz"), d).alias("months"), days.alias("d"), rest.alias("rest"))


@query("""SELECT c_nationkey, coalesce(max(c_acctbal) FILTER (WHERE c_acctbal > 9990), 0) AS rich, count(DISTINCT c_mktsegment) AS segments, min(c_custkey) AS first_key, count(*) FILTER (WHERE c_acctbal > 9900) = 1 AS just_one, nullif(count(*) FILTER (WHERE c_acctbal > 9950), 0) AS few FROM customer GROUP BY ALL""")
def agg_defaults(t: Tables) -> DataFrame:
    a, top = aggregates, F.expr("max(c_acctbal) FILTER (WHERE c_acctbal > 9990)")
    many = F.count_if(F.col("c_acctbal") > 9950)
    return t.customer.groupBy("c_nationkey").agg(a.agg_or_default(top, 0.0).alias("rich"), a.agg_distinct("count", "c_mktsegment").alias("segments"), windows.keep_first("c_custkey", "c_custkey").alias("first_key"), numbers.boolxor_agg(F.col("c_acctbal") > 9900).alias("just_one"), a.agg_or_null(many, F.when(F.col("c_acctbal") > 9950, 1)).alias("few"))


@query("""SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)), 6) AS squares FROM embeddings""")
def agg_array_combinator(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.round(aggregates.agg_array("embedding", 0.0, lambda s, x: s + x.cast("double") * x.cast("double")), 6).alias("squares"))


@query("""WITH RECURSIVE r AS (SELECT CAST(p_size AS BIGINT) AS x FROM part UNION SELECT CASE WHEN x % 3 = 0 THEN x // 3 ELSE x - 1 END FROM r WHERE x > 1) SELECT x FROM r""")
def recursive_distinct(t: Tables) -> DataFrame:
    """All numbers that taking a third, or one less where there is none, reaches from the parts' sizes."""
    step = lambda level: level.where("x > 1").selectExpr("CASE WHEN x % 3 = 0 THEN x DIV 3 ELSE x - 1 END AS x")
    return recursion.recursive(t.part.selectExpr("bigint(p_size) AS x").distinct(), step, distinct=True)


@query("""SELECT user_id, s AS session, count(*) AS n, min(ts) AS began FROM (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS BIGINT) AS s FROM (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) <= 43200 THEN 0 ELSE 1 END AS new FROM events)) GROUP BY ALL""")
def window_session_numbers(t: Tables) -> DataFrame:
    return windows.sessions(t.events, ["user_id"], "ts", 43200).groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("began"))


@query("""SELECT s_suppkey AS k, s_name AS name, s_acctbal AS bal FROM supplier UNION ALL SELECT c_custkey, NULL, c_acctbal FROM customer WHERE c_acctbal < -900""")
def change_insert(t: Tables) -> DataFrame:
    rows = t.customer.where("c_acctbal < -900").selectExpr("c_acctbal AS bal", "c_custkey AS k")
    return changes.insert(t.supplier.selectExpr("s_suppkey AS k", "s_name AS name", "s_acctbal AS bal"), rows)
