"""Pipe stages over DataFrames.

A ``Pipe`` is a DataFrame and the stages that led to it. Every stage is one DataFrame
operation on the output of the stage before, so the order of stages is their meaning
(``limit(2).where("a > 1")`` filters two rows) and Catalyst is free to merge them.
Expressions are SQL text or Columns; ``"expr AS name"`` names a result.

    Pipe.table(spark, "orders").where("o_totalprice > 1000")
        .aggregate("count(*) AS n", group_by="o_orderstatus").order_by("n DESC").df
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.spool import written

Expr = str | Column
#: Table functions for the CALL stage, by name.
TABLE_FUNCTIONS: dict[str, Callable[..., DataFrame]] = {}


class PipeError(ValueError):
    """A stage that doesn't fit its input."""

    def __init__(self, stage: str, number: int, message: str) -> None:
        super().__init__(f"stage {number} ({stage}): {message}")
        self.stage, self.number = stage, number


def table_function(name: str) -> Callable:
    """Register a DataFrame -> DataFrame function for ``call``."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        TABLE_FUNCTIONS[name.lower()] = f
        return f

    return add


def column(e: Expr) -> Column:
    return F.expr(e) if isinstance(e, str) else e


def listed(es: Expr | Sequence[Expr] | None) -> list[Expr]:
    return [] if es is None else [es] if isinstance(es, str | Column) else list(es)


def ordering(e: Expr) -> Column:
    """``"a"``, ``"a DESC"``, ``"a DESC NULLS LAST"`` or a Column; without NULLS, nulls come first ascending and last descending."""
    if not isinstance(e, str):
        return e
    words = e.split()
    upper = [w.upper() for w in words]
    nulls = None
    if len(words) > 2 and upper[-2] == "NULLS":
        nulls, words, upper = upper[-1], words[:-2], upper[:-2]
    down = upper[-1] == "DESC"
    if upper[-1] in ("ASC", "DESC") and len(words) > 1:
        words = words[:-1]
    c = F.expr(" ".join(words))
    if nulls is None:
        return c.desc() if down else c.asc()
    return {(False, "FIRST"): c.asc_nulls_first, (False, "LAST"): c.asc_nulls_last, (True, "FIRST"): c.desc_nulls_first, (True, "LAST"): c.desc_nulls_last}[down, nulls]()


@dataclass(frozen=True)
class Stage:
    name: str
    detail: str
    schema: StructType


class Pipe:
    def __init__(self, df: DataFrame, stages: Sequence[Stage] = (), head: str = "FROM") -> None:
        self.df = df
        self.stages = list(stages) or [Stage(head, "", df.schema)]

    @classmethod
    def table(cls, spark: SparkSession, name: str) -> Pipe:
        return cls(spark.table(name), head=f"FROM {name}")

    @classmethod
    def sql(cls, spark: SparkSession, text: str, args: Mapping[str, object] | None = None, **frames: DataFrame) -> Pipe:
        """The result of a SQL text, Spark's own ``|>`` syntax included, as a head; frames bind ``{name}`` in it."""
        return cls(spark.sql(text, args=dict(args) if args else None, **frames), head="FROM (sql)")

    def _next(self, name: str, df: DataFrame, detail: object = "") -> Pipe:
        return Pipe(df, [*self.stages, Stage(name, str(detail), df.schema)])

    def _need(self, stage: str, names: Sequence[str]) -> None:
        known = {c.lower() for c in self.df.columns}
        for n in names:
            if n.lower() not in known:
                raise PipeError(stage, len(self.stages), f"no column {n} among {', '.join(self.df.columns)}")

    @property
    def shapes(self) -> list[StructType]:
        """Schema after the head and after each stage."""
        return [s.schema for s in self.stages]

    def select(self, *exprs: Expr, distinct: bool = False) -> Pipe:
        out = self.df.select(*map(column, exprs))
        return self._next("SELECT", out.distinct() if distinct else out, exprs)

    def extend(self, *exprs: Expr) -> Pipe:
        return self._next("EXTEND", self.df.select("*", *map(column, exprs)), exprs)

    def window(self, *exprs: Expr) -> Pipe:
        return self._next("WINDOW", self.df.select("*", *map(column, exprs)), exprs)

    def set(self, **values: Expr) -> Pipe:
        """New values for columns that exist, in place."""
        self._need("SET", list(values))
        new = {k.lower(): column(v) for k, v in values.items()}
        return self._next("SET", self.df.select(*[new[c.lower()].alias(c) if c.lower() in new else self.df[f"`{c}`"] for c in self.df.columns]), values)

    def drop(self, *names: str) -> Pipe:
        self._need("DROP", names)
        return self._next("DROP", self.df.drop(*names), names)

    def rename(self, **names: str) -> Pipe:
        """old=new."""
        self._need("RENAME", list(names))
        to = {k.lower(): v for k, v in names.items()}
        return self._next("RENAME", self.df.toDF(*[to.get(c.lower(), c) for c in self.df.columns]), names)

    def as_(self, alias: str) -> Pipe:
        return self._next("AS", self.df.alias(alias), alias)

    def where(self, condition: Expr) -> Pipe:
        return self._next("WHERE", self.df.where(column(condition)), condition)

    def aggregate(self, *aggs: Expr, group_by: Expr | Sequence[Expr] | None = None, and_order: bool = False, order_by: Expr | Sequence[Expr] | None = None) -> Pipe:
        """Group columns first, then aggregates; without group_by one row. and_order sorts by the group columns."""
        keys = [column(k) for k in listed(group_by)]
        values = [column(a) for a in aggs]
        out = self.df.groupBy(*keys).agg(*values) if values else self.df.select(*keys).distinct()
        if and_order:
            out = out.orderBy(*[F.col(f"`{c}`").asc() for c in out.columns[: len(keys)]])
        if order_by is not None:
            out = out.orderBy(*map(ordering, listed(order_by)))
        return self._next("AGGREGATE", out, (aggs, group_by))

    def distinct(self) -> Pipe:
        return self._next("DISTINCT", self.df.distinct())

    def order_by(self, *keys: Expr) -> Pipe:
        return self._next("ORDER BY", self.df.orderBy(*map(ordering, keys)), keys)

    def limit(self, n: int, offset: int = 0) -> Pipe:
        return self._next("LIMIT", (self.df.offset(offset) if offset else self.df).limit(n), (n, offset))

    def offset(self, n: int) -> Pipe:
        return self._next("OFFSET", self.df.offset(n), n)

    def join(self, other: Pipe | DataFrame, on: Expr | Sequence[str] | None = None, how: str = "inner") -> Pipe:
        right = other.df if isinstance(other, Pipe) else other
        if on is None:
            out = self.df.crossJoin(right)
        else:
            out = self.df.join(right, F.expr(on) if isinstance(on, str) else on if isinstance(on, Column) else list(on), how)
        return self._next("JOIN", out, (on, how))

    def _fold(self, name: str, others: Sequence[Pipe | DataFrame], f: Callable[[DataFrame, DataFrame], DataFrame]) -> Pipe:
        frames = [o.df if isinstance(o, Pipe) else o for o in others]
        return self._next(name, reduce(f, frames, self.df), len(frames))

    def union(self, *others: Pipe | DataFrame, all: bool = True, by_name: bool = False, mode: str = "full") -> Pipe:  # noqa: A002
        from ..operators.sets import union_by_name

        f = (lambda a, b: union_by_name(a, b, mode)) if by_name else DataFrame.union
        out = self._fold("UNION", others, f)
        return out if all else Pipe(out.df.distinct(), out.stages)

    def intersect(self, *others: Pipe | DataFrame, all: bool = False) -> Pipe:  # noqa: A002
        return self._fold("INTERSECT", others, DataFrame.intersectAll if all else DataFrame.intersect)

    def except_(self, *others: Pipe | DataFrame, all: bool = False) -> Pipe:  # noqa: A002
        return self._fold("EXCEPT", others, DataFrame.exceptAll if all else DataFrame.subtract)

    def call(self, function: str | Callable[..., DataFrame], *args: object, alias: str | None = None, **named: object) -> Pipe:
        """A table function of the stage's input: registered by name, or a callable."""
        if isinstance(function, str):
            if function.lower() not in TABLE_FUNCTIONS:
                raise PipeError("CALL", len(self.stages), f"unknown table function {function}")
            f = TABLE_FUNCTIONS[function.lower()]
        else:
            f = function
        out = f(self.df, *args, **named)
        return self._next("CALL", out.alias(alias) if alias else out, function)

    def tablesample(self, fraction: float | None = None, seed: int | None = None, replace: bool = False, rows: int | None = None, bucket: tuple[int, int, Sequence[str]] | None = None) -> Pipe:
        """A fraction of the rows, or a number of them (by a seeded hash of each row, so runs agree), or a bucket:
        (number from 1, of how many, columns whose hash deals rows to buckets)."""
        from ..sources.tables import sample_bucket, sample_rows

        if (fraction is not None) + (rows is not None) + (bucket is not None) != 1:
            raise PipeError("TABLESAMPLE", len(self.stages), "one of fraction, rows and bucket must be given")
        out = sample_rows(self.df, rows, seed or 0) if rows is not None else sample_bucket(self.df, *bucket) if bucket else self.df.sample(replace, fraction, seed)
        return self._next("TABLESAMPLE", out, fraction or rows or bucket)

    def pivot(self, group_by: Sequence[str], on: str, values: Sequence[object], *aggs: Expr) -> Pipe:
        return self._next("PIVOT", self.df.groupBy(*group_by).pivot(on, list(values)).agg(*map(column, aggs)), (on, values))

    def unpivot(self, ids: Sequence[str], values: Sequence[str], name: str = "name", value: str = "value", include_nulls: bool = False) -> Pipe:
        out = self.df.unpivot(list(ids), list(values), name, value)
        return self._next("UNPIVOT", out if include_nulls else out.where(F.col(value).isNotNull()), values)

    def fork(self, *branches: Callable[[Pipe], Pipe]) -> list[DataFrame]:
        """Several continuations of one input, which is computed once and stands in the shared folder for all of them."""
        kept = Pipe(written(self.df, "fork"), self.stages)
        return [b(kept).df for b in branches]

    def tee(self, sink: Callable[[DataFrame], None]) -> Pipe:
        """Hand the rows to a sink and go on with the same ones: they are computed once."""
        kept = written(self.df, "tee")
        sink(kept)
        return self._next("TEE", kept)

    def insert(self, table: str, overwrite: bool = False) -> Pipe:
        """Add the rows to a table, columns by name, and go on with them."""
        return self.tee(lambda df: df.select(*df.sparkSession.table(table).columns).write.insertInto(table, overwrite))

    def export(self, path: str, kind: str = "parquet", mode: str = "error", **options: str) -> Pipe:
        """Write the rows as files and go on with them."""
        return self.tee(lambda df: df.write.format(kind).mode(mode).options(**options).save(path))
