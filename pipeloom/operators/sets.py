"""Set operations by column name, and over any number of operands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _lists(a: DataFrame, b: DataFrame, mode: str) -> list[str]:
    """Columns of the result: full: all of a, then the others of b; inner: the common ones; left: those of a; strict: both must have the same."""
    left, right = a.columns, b.columns
    names = {c.lower() for c in right}
    if mode == "full":
        return left + [c for c in right if c.lower() not in {x.lower() for x in left}]
    if mode == "inner":
        common = [c for c in left if c.lower() in names]
        if not common:
            raise ValueError("no common columns")
        return common
    if mode == "left":
        return left
    if mode == "strict":
        if {c.lower() for c in left} != names:
            raise ValueError(f"columns differ: {left} and {right}")
        return left
    raise ValueError(f"unknown mode {mode}")


def aligned(a: DataFrame, b: DataFrame, mode: str = "full") -> tuple[DataFrame, DataFrame]:
    """Both inputs with the columns of the result, nulls where one lacks a column."""
    columns = _lists(a, b, mode)

    def take(df: DataFrame) -> DataFrame:
        own = {c.lower() for c in df.columns}
        return df.select(*[F.col(f"`{c}`") if c.lower() in own else F.lit(None).alias(c) for c in columns])

    return take(a), take(b)


def union_by_name(a: DataFrame, b: DataFrame, mode: str = "full") -> DataFrame:
    """UNION ALL BY NAME / CORRESPONDING."""
    x, y = aligned(a, b, mode)
    return x.union(y)


def intersect_by_name(a: DataFrame, b: DataFrame, mode: str = "inner", all: bool = False) -> DataFrame:  # noqa: A002
    x, y = aligned(a, b, mode)
    return x.intersectAll(y) if all else x.intersect(y)


def except_by_name(a: DataFrame, b: DataFrame, mode: str = "inner", all: bool = False) -> DataFrame:  # noqa: A002
    x, y = aligned(a, b, mode)
    return x.exceptAll(y) if all else x.subtract(y)


def on_columns(a: DataFrame, b: DataFrame, columns: list[str], kind: str) -> DataFrame:
    """INTERSECT / EXCEPT that compare the named columns only (ON / BY (cols)); rows and columns are the left ones."""
    keys = b.select(*columns).distinct().toDF(*[f"_b{i}" for i in range(len(columns))])
    same = F.lit(True)
    for i, c in enumerate(columns):
        same &= a[c].eqNullSafe(keys[f"_b{i}"])
    return a.join(keys, same, {"intersect": "left_semi", "except": "left_anti"}[kind])
