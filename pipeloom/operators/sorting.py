"""DISTINCT ON, LIMIT BY, WITH TIES, percentages and filled orderings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.pipe import Expr, ordering
from .joins import numbered
from .windows import over

BROADCAST_ROWS = 100_000  # sort keys of so many rows may go to every task


def distinct_on(df: DataFrame, on: Sequence[str], order_by: Sequence[Expr]) -> DataFrame:
    """The first row of each key; the order should be total."""
    return limit_by(df, 1, on, order_by)


def limit_by(df: DataFrame, n: int, by: Sequence[str], order_by: Sequence[Expr], offset: int = 0) -> DataFrame:
    """LIMIT offset, n BY: up to n rows of each key. Spark keeps only the first rows of each task before the shuffle."""
    out = df.withColumn("_rn", F.row_number().over(over(by, order_by))).where(F.col("_rn") <= offset + n)
    return (out.where(F.col("_rn") > offset) if offset else out).drop("_rn")


def limit_with_ties(df: DataFrame, n: int, order_by: Sequence[Expr]) -> DataFrame:
    """The first n rows and all that equal the last of them in the order: the sort keys of n rows are found by a
    distributed top-n, then rows are compared with the last key. No single-task window."""
    keys = [ordering(o) for o in order_by]
    names = [o.split()[0] if isinstance(o, str) else None for o in order_by]
    if any(x is None for x in names):
        raise ValueError("order_by must be texts")
    top = df.select(*names).orderBy(*keys).limit(n)
    edge = top.groupBy(*names).count()  # n rows at most
    if n <= BROADCAST_ROWS:
        edge = F.broadcast(edge)
    same = F.lit(True)
    for x in names:
        same &= df[x].eqNullSafe(edge[x])
    return df.join(edge, same, "left_semi")


def limit_percent(df: DataFrame, percent: float, order_by: Sequence[Expr]) -> DataFrame:
    """The first percent of the rows, rounded down: rows get their number in range partitions, no task sorts or gathers them all."""
    n = int(df.count() * percent / 100)
    return numbered(df, [ordering(o) for o in order_by], "_n").where(F.col("_n") <= n).drop("_n")


def order_all(df: DataFrame, descending: bool = False) -> DataFrame:
    """ORDER BY ALL."""
    return df.orderBy(*[F.col(f"`{c}`").desc_nulls_last() if descending else F.col(f"`{c}`").asc_nulls_first() for c in df.columns])


def with_fill(df: DataFrame, key: str, start: Column, stop: Column, step: Column, by: Sequence[str] = (), interpolate: Sequence[str] = ()) -> DataFrame:
    """ORDER BY key WITH FILL FROM start TO stop (excluded) STEP step, for each ``by``: missing keys become rows; the
    columns of ``interpolate`` carry their last value into them (within each ``by``; without any, in one task), others are
    null."""
    heads = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    spine = heads.select(*by, F.explode(F.sequence(start, stop, step)).alias(key)).where(F.col(key) < stop)
    out = spine.join(df, [*by, key], "full")
    w = over(by, [key]).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in interpolate}) if interpolate else out
