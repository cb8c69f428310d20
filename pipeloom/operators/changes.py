"""INSERT, UPDATE, DELETE and MERGE on immutable tables: the table after the change, to be written in its place."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.pipe import Expr, column


def update(table: DataFrame, values: Mapping[str, Expr], where: Expr | None = None) -> DataFrame:
    hit = F.lit(True) if where is None else F.coalesce(column(where), F.lit(False))
    return table.select(*[F.when(hit, column(values[c])).otherwise(F.col(f"`{c}`")).cast(t).alias(c) if c in values else F.col(f"`{c}`") for c, t in table.dtypes])


def delete(table: DataFrame, where: Expr) -> DataFrame:
    return table.where(~F.coalesce(column(where), F.lit(False)))


def insert(table: DataFrame, rows: DataFrame, by_name: bool = True) -> DataFrame:
    return table.unionByName(rows, allowMissingColumns=True) if by_name else table.union(rows)


@dataclass(frozen=True)
class Matched:
    """WHEN MATCHED [AND condition] THEN UPDATE SET values | DELETE (values None). t.x and s.x name the two sides."""

    values: Mapping[str, str] | None
    condition: str | None = None


def merge(target: DataFrame, source: DataFrame, on: Sequence[str], matched: Sequence[Matched] = (), insert_missing: Mapping[str, str] | None = None, delete_unmatched: bool = False) -> DataFrame:
    """MERGE INTO target USING source: one full join on the keys. The first clause whose condition holds applies.

    Several source rows for one target row are an error in SQL; here they raise when the plan runs. Source rows that meet
    no target row (those with a null key, among others) may be as many as they like: each is inserted."""
    several = source.groupBy(*on).count().where("count > 1").select(*[F.col(k).alias(f"_m{i}") for i, k in enumerate(on)], F.lit(True).alias("_several"))
    rows = source.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(on)], F.struct(*source.columns).alias("s"))
    again: Column = F.lit(True)
    for i in range(len(on)):
        again &= F.col(f"_k{i}") == F.col(f"_m{i}")
    s = rows.join(several, again, "left").select(*[f"_k{i}" for i in range(len(on))], "s", "_several")
    t = target.select(F.struct(*target.columns).alias("t"))
    same: Column = F.lit(True)
    for i, k in enumerate(on):
        same &= F.col("t")[k] == F.col(f"_k{i}")
    both = t.join(s, same, "full")
    in_t, in_s = F.col("t").isNotNull(), F.col("s").isNotNull()
    twice = F.raise_error(F.lit("several source rows for a target row")).cast("string")
    action = F.when(in_t & F.col("_several"), twice).when(in_t & ~in_s, F.lit("delete" if delete_unmatched else "keep")).when(~in_t, F.lit("insert" if insert_missing else "skip"))
    for i, m in enumerate(matched):
        hit = F.coalesce(F.expr(m.condition), F.lit(False)) if m.condition else F.lit(True)
        action = action.when(hit, F.lit("delete" if m.values is None else f"update{i}"))
    rows = both.withColumn("_a", action.otherwise("keep")).where("_a NOT IN ('delete', 'skip')")
    out = []
    for c, kind in target.dtypes:
        v = F.col("t")[c]
        for i, m in enumerate(matched):
            if m.values and c in m.values:
                v = F.when(F.col("_a") == f"update{i}", F.expr(m.values[c])).otherwise(v)
        if insert_missing:
            v = F.when(F.col("_a") == "insert", F.expr(insert_missing[c]) if c in insert_missing else F.lit(None)).otherwise(v)
        out.append(v.cast(kind).alias(c))
    return rows.select(*out)


def upsert(target: DataFrame, source: DataFrame, on: Sequence[str], do_nothing: bool = False) -> DataFrame:
    """INSERT ... ON CONFLICT (on) DO UPDATE (all columns) or DO NOTHING."""
    new = source.join(target.select(*on), list(on), "left_anti") if do_nothing else source
    old = target if do_nothing else target.join(source.select(*on), list(on), "left_anti")
    return old.unionByName(new.select(*target.columns))
