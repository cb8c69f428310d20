"""Window features beyond Spark's: GROUPS frames, EXCLUDE, QUALIFY, KEEP."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.pipe import Expr, column, ordering

#: Rows of a task that ``deal`` aims at, and the number of tasks up to which Spark deals without sorting first
#: (spark.shuffle.sort.bypassMergeThreshold).
TASK_ROWS, UNSORTED = 1 << 18, 200


def over(partition_by: Sequence[Expr] = (), order_by: Sequence[Expr] = ()):
    """A window from SQL texts or Columns."""
    return Window.partitionBy(*map(column, partition_by)).orderBy(*map(ordering, order_by))


def deal(df: DataFrame, partition_by: Sequence[Expr]) -> DataFrame:
    """Rows dealt by partition_by over one task for each TASK_ROWS rows (but a task for each core), counted first. Windows
    over the same partitions need no shuffle of their own then, and what a task sorts doesn't grow with the table, as it does
    in a set number of shuffle partitions; rows of one partition stay together, however many.

    Above UNSORTED tasks those that read the table would sort their rows by task, in more memory than is spared. So there are
    not more until each has 8 * TASK_ROWS rows; from there on a reading task holds up to a split of the input, or spills."""
    if not partition_by:
        return df
    rows = df.count()
    tasks = min(max(math.ceil(rows / TASK_ROWS), df.sparkSession.sparkContext.defaultParallelism), UNSORTED)
    return df.repartition(max(tasks, math.ceil(rows / (8 * TASK_ROWS))), *map(column, partition_by))


def groups_frame(df: DataFrame, agg: Column, name: str, partition_by: Sequence[Expr], order_by: Sequence[Expr], start: int, end: int) -> DataFrame:
    """agg over a GROUPS frame from ``start`` to ``end`` peer groups away: a RANGE frame over the number of the group."""
    numbered = df.withColumn("_g", F.dense_rank().over(over(partition_by, order_by)))
    w = Window.partitionBy(*map(column, partition_by)).orderBy("_g").rangeBetween(start, end)
    return numbered.withColumn(name, agg.over(w)).drop("_g")


def exclude(df: DataFrame, value: str, name: str, partition_by: Sequence[Expr], order_by: Sequence[Expr], what: str = "current row", start: int = Window.unboundedPreceding, end: int = Window.unboundedFollowing, agg: str = "sum") -> DataFrame:
    """sum, count, min, max or avg of value over a ROWS frame without the current row, its peers and itself (group), its
    peers alone (ties), or nothing (no others).

    What lies before and after the excluded rows is aggregated apart and put together, nothing but counts is subtracted. An
    open end of the frame is a running aggregate: forward up to the current row (beside peers, up to the first of them), and
    from the last row back after it; a bounded side beside peers gathers its few rows. All but the way back, which counts
    don't need, takes one sort; the way back goes by the same numbers of rows, so rows of equal order are on one side only."""
    if start > 0 or end < 0:
        raise ValueError("the frame must hold the current row")
    base, v, first, last = over(partition_by, order_by), F.col(value), Window.unboundedPreceding, Window.unboundedFollowing
    if what == "no others":
        return df.withColumn(name, getattr(F, agg)(v).over(base.rowsBetween(start, end)))
    one, peers = what == "current row", base.rangeBetween(0, 0)
    whole = {"sum": ("sum",), "count": ("count",), "min": ("min",), "max": ("max",), "avg": ("sum", "count")}[agg]
    parts: dict[str, list[Column]] = {f: [] for f in whole}
    forward = {"_n": F.row_number().over(base), "_g": F.dense_rank().over(base)}
    at_peers, back = {}, {}

    def add(lo: int, hi: int) -> None:
        """A side of the frame: rows lo to hi from the current one, all before or all after it."""
        near = None
        if not one and lo != first and hi != last:
            near = F.collect_list(F.struct(F.col("_g").alias("g"), v.alias("v"))).over(base.rowsBetween(lo, hi))
        values = F.filter(F.transform(F.filter(near, lambda x: x["g"] != F.col("_g")), lambda x: x["v"]), lambda x: x.isNotNull()) if near is not None else None
        folds = {"sum": lambda: F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda s, x: s + x.cast("double"))), "count": lambda: F.size(values), "min": lambda: F.array_min(values), "max": lambda: F.array_max(values)}
        for f, found in parts.items():
            side, a = f"_{f}{len(found)}", getattr(F, f)(v)
            found.append(F.col(side))
            if near is not None:
                at_peers[side] = folds[f]()
            elif hi != last:
                forward[side] = a.over(base.rowsBetween(lo, hi))
                if not one:
                    at_peers[side] = F.first(side).over(peers)
            elif f == "count":
                forward[side] = a.over(base.rowsBetween(first, last)) - a.over(base.rowsBetween(first, 0) if one else base.rangeBetween(first, 0))
            else:
                w = Window.partitionBy(*map(column, partition_by)).orderBy(F.desc("_n" if one else "_g"))
                back[side] = a.over(w.rowsBetween(first, -1) if one else w.rangeBetween(first, -1))

    if start < 0:
        add(start, -1)
    if end > 0:
        add(1, end)
    df = df.withColumns(forward).withColumns(at_peers).withColumns(back)
    if what == "ties":
        for f, found in parts.items():
            found.append(F.when(v.isNotNull(), 1).otherwise(0) if f == "count" else v)

    def total(found: list[Column]) -> Column:
        some = F.coalesce(*found, F.lit(None)) if found else F.lit(None)
        out = F.lit(0)
        for x in found:
            out = out + F.coalesce(x, F.lit(0))
        return F.when(some.isNotNull(), out)

    got = {f: total(found) if f in ("sum", "count") else F.array_min(F.array(*found)) if f == "min" else F.array_max(F.array(*found)) for f, found in parts.items()}
    out = got["sum"] / F.nullif(got["count"], F.lit(0)) if agg == "avg" else F.coalesce(got["count"], F.lit(0)).cast("long") if agg == "count" else got[agg]
    return df.withColumn(name, out).drop(*forward, *at_peers, *back)


def qualify(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which a condition with window functions holds; the helper column goes."""
    return df.withColumn("_q", condition).where("_q").drop("_q")


def keep(df: DataFrame, by: Sequence[str], order: str, value: Column, name: str, last: bool = False) -> DataFrame:
    """agg KEEP (DENSE_RANK FIRST | LAST ORDER BY order): an aggregate over all rows of the first (last) rank of each group."""
    w = Window.partitionBy(*by).orderBy(F.col(order).desc_nulls_last() if last else F.col(order).asc_nulls_last())
    return df.withColumn("_r", F.rank().over(w)).where("_r = 1").groupBy(*by).agg(value.alias(name))


def keep_first(value: str, order: str) -> Column:
    """value of one row of the first rank in order, as an aggregate."""
    return F.min_by(value, order)


def keep_last(value: str, order: str) -> Column:
    return F.max_by(value, order)


def sessions(df: DataFrame, by: Sequence[str], ts: str, gap_seconds: float, name: str = "session") -> DataFrame:
    """Number of the session of each row: a new one begins after a gap of more than gap_seconds."""
    w = Window.partitionBy(*by).orderBy(ts)
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    new = F.when(seconds - F.lag(seconds).over(w) <= gap_seconds, 0).otherwise(1)
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
