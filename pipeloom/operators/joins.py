"""Joins that Spark SQL has no syntax for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.spool import written


def _prefixed(df: DataFrame, columns: Sequence[str], suffix: str, taken: set[str]) -> dict[str, str]:
    return {c: f"{c}{suffix}" if c.lower() in taken else c for c in columns}


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str, how: str = "left", strict: bool = False, tie: str | None = None, suffix: str = "_r") -> DataFrame:
    """Each left row with the last right row of its key at or before it (strict: before it).

    Both sides are put together and a window carries the last right row forward: one shuffle by key and one sort, and
    no pairs. Among right rows of equal time the one with the greatest ``tie`` wins. Right columns that clash get a suffix.
    A null key or time matches nothing."""
    own = [c for c in right.columns if c not in by]
    names = _prefixed(right, own, suffix, {c.lower() for c in left.columns})
    whole = F.struct(*[F.col(f"`{c}`") for c in own])
    order = F.col(f"`{tie}`").cast("string") if tie else F.lit(None).cast("string")
    number = F.col(f"`{tie}`").cast("double") if tie else F.lit(None).cast("double")
    l_rows = left.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(by)], F.col(f"`{left_on}`").alias("_t"), F.lit(0 if strict else 1).alias("_side"), F.lit(None).cast("double").alias("_tie"), F.lit(None).cast("string").alias("_tie2"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_l"), F.lit(True).alias("_left"))
    r_rows = right.where(F.col(f"`{right_on}`").isNotNull()).select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(by)], F.col(f"`{right_on}`").alias("_t"), F.lit(1 if strict else 0).alias("_side"), number.alias("_tie"), order.alias("_tie2"), F.lit(False).alias("_left"), whole.alias("_r"))
    both = l_rows.unionByName(r_rows, allowMissingColumns=True)
    keys = [F.col(f"_k{i}") for i in range(len(by))]
    w = Window.partitionBy(*keys).orderBy("_t", "_side", F.col("_tie").asc_nulls_first(), F.col("_tie2").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    known = F.lit(True)
    for k in [*keys, F.col("_t")]:
        known &= k.isNotNull()
    out = both.withColumn("_m", F.last("_r", ignorenulls=True).over(w)).where("_left").withColumn("_m", F.when(known, F.col("_m")))
    if how == "inner":
        out = out.where("_m IS NOT NULL")
    return out.select("_l.*", *[F.col("_m")[c].alias(names[c]) for c in own])


def positional_join(left: DataFrame, right: DataFrame, left_order: Sequence[str], right_order: Sequence[str], suffix: str = "_r", parts: int = 64) -> DataFrame:
    """The first row with the first, the second with the second, and so on; the shorter side is filled with nulls.

    Rows have no order of their own in Spark, so each side names one. Ranks are taken in range partitions that are
    numbered by a sum over their sizes, so no task sorts a whole side."""
    names = _prefixed(right, right.columns, suffix, {c.lower() for c in left.columns})
    a = numbered(left, left_order, "_n", parts)
    b = numbered(right, right_order, "_n", parts).withColumnsRenamed(names)
    return a.join(b, "_n", "full").drop("_n")


def numbered(df: DataFrame, order: Sequence[str], name: str = "n", parts: int = 64) -> DataFrame:
    """Row numbers from 1 in a total order, without a single-partition window: rows are dealt by range, counted by part,
    and numbered in each part. The rows of equal order keys lie in one part."""
    return cumulated(df, order, F.lit(1), name, parts)


def cumulated(df: DataFrame, order: Sequence[str], weight: Column, name: str, parts: int = 64) -> DataFrame:
    """Running sums of weight in a total order, without a single-partition window: rows are dealt by range, weighed by part,
    and summed in each part."""
    at = df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    running = F.sum(weight).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    at = written(at.withColumns({"_w": weight, "_in": running}))  # ranges are sampled, so once only
    sizes = at.groupBy("_part").agg(F.sum("_w").alias("n"))  # as many rows as parts
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b._part") < F.col("a._part"), "left").groupBy(F.col("a._part").alias("_part")).agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("_before"))
    return at.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_in")).drop("_part", "_w", "_in", "_before")


def any_join(left: DataFrame, right: DataFrame, on: Sequence[str], order: Sequence[str], how: str = "left") -> DataFrame:
    """At most one right row for each left row: the first of its key in the given order."""
    own = [c for c in right.columns if c not in on]
    key = F.struct(*order, *[c for c in own if c not in order])
    first = right.groupBy(*on).agg(F.min(key).alias("_f")).select(*on, *[F.col("_f")[c].alias(c) for c in own])
    return left.join(first, list(on), how)


def array_join(df: DataFrame, arrays: dict[str, str], outer: bool = False) -> DataFrame:
    """A row for each position of the arrays (name of the element: array column); with outer also for rows without any."""
    zipped = F.arrays_zip(*[F.col(f"`{a}`").alias(n) for n, a in arrays.items()])
    f = F.explode_outer if outer else F.explode
    out = df.select("*", f(zipped).alias("_z"))
    return out.select(*df.columns, *[F.col("_z")[n].alias(n) for n in arrays])


def range_join(left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: float, keys: Sequence[str] = (), how: str = "inner") -> DataFrame:
    """Rows whose point lies in [low, high] of the right row (and whose keys agree), as an equi-join on bins of the given width.

    Each right row goes to the bins that it covers, so width should be near the typical length; no cross join. Bins of more
    than PAIRS pairs are cut into cells, a part of the left rows by a part of the right ones (by all right ones unless the
    join is inner), and there are two tasks for each cell. The bins of a stream are left whole."""
    bin_of = lambda c: F.floor(c / width).cast("long")
    p, lo, hi = (F.col(f"`{c}`").cast("double") for c in (point, low, high))
    a = left.withColumn("_bin", bin_of(p))
    b = right.where(hi >= lo).withColumn("_bin", F.explode(F.sequence(bin_of(lo), bin_of(hi))))
    b = b.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    ks = [f"_k{i}" for i in range(len(keys))]
    if not left.isStreaming and not right.isStreaming:
        a, b = _cells(a, b, keys, ks, how)
    same = (a["_bin"] == b["_bin"]) & (F.col(f"`{point}`") >= F.col(f"`{low}`")) & (F.col(f"`{point}`") <= F.col(f"`{high}`"))
    for i, k in enumerate(keys):
        same &= F.col(f"`{k}`") == F.col(f"_k{i}")
    if "_i" in a.columns:
        same &= (a["_i"] == b["_i"]) & (a["_j"] == b["_j"])
    return a.join(b, same, how).drop("_bin", "_i", "_j", *ks)


PAIRS = 1 << 23  # pairs of rows of a bin, or of a cell of a bin


def _cells(a: DataFrame, b: DataFrame, keys: Sequence[str], ks: Sequence[str], how: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with the cells _i, _j of each row, dealt by them; as they are if no bin has more than PAIRS pairs."""
    n_left = a.groupBy("_bin", *[F.col(f"`{k}`").alias(c) for k, c in zip(keys, ks, strict=True)]).agg(F.count("*").alias("_l"))
    sizes = n_left.join(b.groupBy("_bin", *ks).agg(F.count("*").alias("_r")), ["_bin", *ks])
    cells = F.ceil(F.col("_l").cast("double") * F.col("_r") / PAIRS)
    rows = F.least(F.greatest(F.ceil(F.sqrt(cells * F.col("_l") / F.col("_r"))), F.lit(1)), cells) if how == "inner" else cells
    heavy = sizes.where(cells > 1).withColumn("_rows", rows).select("_bin", *ks, "_rows", F.ceil(cells / F.col("_rows")).alias("_cols"))
    total = heavy.agg(F.sum(F.col("_rows") * F.col("_cols"))).first()[0]
    if not total:
        return a, b
    heavy = written(heavy, "cells")  # as many rows as heavy bins

    def dealt(df: DataFrame, own: Sequence[str], mine: str, other: str, names: tuple[str, str]) -> DataFrame:
        plain = [F.col(f"`{c}`") for c, t in df.dtypes if not t.startswith(("array", "map", "struct", "variant"))]
        cut = heavy.withColumnsRenamed({"_bin": "_b", **{c: f"_h{c}" for c in ks}})
        on = df["_bin"] == cut["_b"]
        for k, c in zip(own, ks, strict=True):
            on &= df[f"`{k}`"] == cut[f"_h{c}"]
        count = lambda c: F.coalesce(F.col(c), F.lit(1))
        out = df.join(F.broadcast(cut), on, "left").withColumn(names[0], F.pmod(F.xxhash64(*plain), count(mine)).cast("long"))
        out = out.withColumn(names[1], F.explode(F.sequence(F.lit(0).cast("long"), count(other).cast("long") - 1)))
        at = ["_bin", "_i", "_j", *own]
        return out.select(*[F.col(f"`{c}`") for c in df.columns], "_i", "_j").repartition(int(min(max(2 * total, 64), 1 << 15)), *[F.col(f"`{c}`") for c in at])

    return dealt(a, keys, "_rows", "_cols", ("_i", "_j")), dealt(b, ks, "_cols", "_rows", ("_j", "_i"))


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Equality on all common columns, each once in the result; without any a cross join of the two, as in SQL."""
    common = [c for c in left.columns if c.lower() in {x.lower() for x in right.columns}]
    return left.join(right, common, how) if common else left.crossJoin(right)


def using_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """USING: the key columns come first and are coalesced for outer joins."""
    return left.join(right, list(on), how)


def in_any(value: Column, array: Column, compare: str = "=") -> Column:
    """value <compare> ANY (array)."""
    return F.exists(array, lambda x: _compare(value, x, compare))


def in_all(value: Column, array: Column, compare: str = "=") -> Column:
    """value <compare> ALL (array)."""
    return F.forall(array, lambda x: _compare(value, x, compare))


def _compare(a: Column, b: Column, compare: str) -> Column:
    return {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[compare]
