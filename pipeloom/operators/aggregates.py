"""Aggregation beyond GROUP BY: grand totals, grouping sets, HAVING MAX, combinators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.pipe import Expr, column
from .joins import cumulated


def with_totals(df: DataFrame, by: Sequence[str], *aggs: Expr) -> DataFrame:
    """GROUP BY ... WITH TOTALS: the groups and one row over all, with null keys and ``is_total``."""
    cs = [column(a) for a in aggs]
    return df.groupingSets([[F.col(b) for b in by], []], *by).agg(*cs, F.grouping_id(*by).alias("_g")).withColumn("is_total", F.col("_g") > 0).drop("_g")


def grouping_sets(df: DataFrame, sets: Sequence[Sequence[str]], *aggs: Expr) -> DataFrame:
    names = list(dict.fromkeys(c for s in sets for c in s))
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(n) for n in names]).agg(*map(column, aggs))


def having_max(df: DataFrame, by: Sequence[str], value: Column, of: str, name: str, least: bool = False) -> DataFrame:
    """agg(x HAVING MAX of): an aggregate over the rows of each group whose ``of`` is the greatest (least)."""
    edge = df.groupBy(*by).agg((F.min if least else F.max)(of).alias("_edge"))
    same = F.lit(True)
    keyed = edge.toDF(*[f"_b{i}" for i in range(len(by))], "_edge")
    for i, b in enumerate(by):
        same &= df[b].eqNullSafe(keyed[f"_b{i}"])
    return df.join(keyed, same & (df[of] == F.col("_edge"))).groupBy(*[df[b] for b in by]).agg(value.alias(name))


def agg_if(agg: str, value: str, condition: str) -> Column:
    """The If combinator: agg(value) FILTER (WHERE condition)."""
    return F.expr(f"{agg}({value}) FILTER (WHERE {condition})")


def agg_or_default(agg: Column, default: object) -> Column:
    """The OrDefault combinator: a value instead of null for empty input."""
    return F.coalesce(agg, F.lit(default))


def agg_array(array: str, zero: object, merge, finish=None) -> Column:  # noqa: ANN001
    """The Array combinator over one row's elements, as a fold."""
    return F.aggregate(array, F.lit(zero), merge, finish)


def agg_for_each(df: DataFrame, by: Sequence[str], array: str, agg: str, name: str) -> DataFrame:
    """The ForEach combinator: agg at each position of an array column, as an array."""
    at = df.select(*by, F.posexplode(array).alias("_i", "_v")).groupBy(*by, "_i").agg(F.expr(f"{agg}(_v)").alias("_a"))
    return at.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_a"))), lambda x: x["_a"]).alias(name))


def agg_resample(df: DataFrame, by: Sequence[str], value: Column, key: str, start: int, stop: int, step: int, name: str) -> DataFrame:
    """The Resample combinator: an aggregate for each interval of key in [start, stop), empty ones included."""
    bins = F.sequence(F.lit(start), F.lit(stop - 1), F.lit(step))
    heads = df.select(*by).distinct().select(*by, F.explode(bins).alias("bin"))
    binned = df.where(F.col(key).between(start, stop - 1)).withColumn("bin", (F.floor((F.col(key) - start) / step) * step + start).cast("int"))
    return heads.join(binned.groupBy(*by, "bin").agg(value.alias(name)), [*by, "bin"], "left")


def state(kind: str, value: str) -> Column:
    """The State combinator: a mergeable sketch of distinct values ('distinct') or of quantiles ('quantile')."""
    return {"distinct": F.hll_sketch_agg, "quantile": F.kll_sketch_agg_double}[kind](value)


def merged(kind: str, sketch: str) -> Column:
    """The Merge combinator: one sketch of many."""
    return {"distinct": F.hll_union_agg, "quantile": F.kll_merge_agg_double}[kind](sketch)


def list_agg(value: str, delimiter: str, order: str, distinct: bool = False, descending: bool = False) -> Column:
    """STRING_AGG(value, delimiter ORDER BY order)."""
    pair = F.struct(F.col(order).alias("o"), F.col(value).alias("v"))
    pairs = F.collect_set(pair) if distinct else F.collect_list(pair)
    return F.array_join(F.transform(F.sort_array(pairs, not descending), lambda x: x["v"]), delimiter)


def top_k(df: DataFrame, by: Sequence[str], value: str, order: str, k: int, name: str = "top") -> DataFrame:
    """For each group the values of its k rows of greatest order (ties by greatest value), as an array. Tasks keep k rows
    of a group before the shuffle, and no more are gathered."""
    w = Window.partitionBy(*by).orderBy(F.col(order).desc_nulls_last(), F.col(value).desc_nulls_last())
    best = df.select(*by, F.col(value).alias("_v"), F.row_number().over(w).alias("_n")).where(F.col("_n") <= k)
    return best.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "_v"))), lambda x: x["_v"]).alias(name))


def sample_skewness(x: str) -> Column:
    """Skewness of a sample (Spark's is that of a population)."""
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(x: str) -> Column:
    n = F.count(x).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def entropy(df: DataFrame, by: Sequence[str], value: str, name: str = "entropy") -> DataFrame:
    """Shannon entropy in bits of a column's values in each group."""
    counts = df.groupBy(*by, value).count()
    n, s = F.sum("count"), F.sum(F.col("count") * F.log2("count"))
    return counts.groupBy(*by).agg((F.log2(n) - s / n).alias(name))


def percentiles(df: DataFrame, by: Sequence[str], value: str, **shares: float) -> DataFrame:
    """Exact percentiles of each group, interpolated: name=share. Values are counted, the counts summed up in range
    partitions of (by, value), and only the two neighbours of each position are picked, so no task holds a group's values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    up = cumulated(counts, [*by, value], F.col("_c"), "_up")
    ends = up.groupBy(*by).agg(F.min(F.col("_up") - F.col("_c")).alias("_lo"), F.sum("_c").alias("_n"))
    same: Column = F.lit(True)
    keyed = ends.withColumnsRenamed({b: f"_b{i}" for i, b in enumerate(by)})
    for i, b in enumerate(by):
        same &= F.col(b).eqNullSafe(F.col(f"_b{i}"))
    both = up.join(keyed, same)
    last = F.col("_up") - F.col("_lo") - 1  # places of the value in its group, from 0
    first = last - F.col("_c") + 1
    out = []
    for name, share in shares.items():
        place = share * (F.col("_n") - 1)
        under, over_ = F.floor(place), F.ceil(place)
        at = lambda p: F.max(F.when((first <= p) & (p <= last), F.col(value).cast("double")))
        low, high, part = at(under), at(over_), F.max(place - under)
        out.append((low + (high - low) * part).alias(name))
    return both.groupBy(*by).agg(*out)


def agg_or_null(agg: Column, rows: Column | None = None) -> Column:
    """The OrNull combinator: null instead of a neutral value for empty input."""
    return F.when(F.count("*" if rows is None else rows) > 0, agg)


def agg_distinct(agg: str, value: str) -> Column:
    """The Distinct combinator: agg over the distinct values."""
    return F.expr(f"{agg}(DISTINCT {value})")


def agg_map(df: DataFrame, by: Sequence[str], maps: str, agg: str, name: str) -> DataFrame:
    """The Map combinator: agg of the values of each key of a map column, as a map."""
    at = df.select(*by, F.explode(maps).alias("_k", "_v")).groupBy(*by, "_k").agg(F.expr(f"{agg}(_v)").alias("_a"))
    return at.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_k", "_a")))).alias(name))


#: Combinators that a name may end in, and what they add to an aggregate's SQL.
COMBINATORS = ("If", "Distinct", "OrNull", "OrDefault")


def combined(name: str, value: str, condition: str | None = None, default: object = 0) -> Column:
    """An aggregate whose name carries combinators, stacked as they come: sumIf, sumIfOrNull, countDistinctIf, avgIfOrDefault."""
    found, rest = [], name
    while hit := next((c for c in COMBINATORS if rest.endswith(c) and len(rest) > len(c)), None):
        found.insert(0, hit)
        rest = rest[: -len(hit)]
    if ("If" in found) != (condition is not None):
        raise ValueError("a condition goes with If, and only with it")
    where = f" FILTER (WHERE {condition})" if condition else ""
    out = F.expr(f"{rest}({'DISTINCT ' if 'Distinct' in found else ''}{value}){where}")
    if "OrNull" in found:
        out = F.when(F.expr(f"count({value}){where}") > 0, out)
    return F.when(F.expr(f"count({value}){where}") > 0, out).otherwise(F.lit(default)) if "OrDefault" in found else out


def top_frequent(df: DataFrame, by: Sequence[str], value: str, k: int, name: str = "top") -> DataFrame:
    """topK(k)(value): the k most frequent values of each group, ties by least value, as an array. Values are counted first,
    and tasks keep k of a group before the shuffle."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*by).orderBy(F.desc("_c"), value)
    best = counts.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k)
    return best.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", value))), lambda x: x[value]).alias(name))


def avg_state(value: str) -> Column:
    """The State combinator of avg: what partial averages need to be put together."""
    return F.struct(F.sum(value).alias("total"), F.count(value).alias("n"))


def avg_merged(state_col: str) -> Column:
    """The Merge combinator of avg: one state of many."""
    return F.struct(F.sum(f"{state_col}.total").alias("total"), F.sum(f"{state_col}.n").alias("n"))
