"""Shapes of results: comparison, contracts, nullability and fragments with slots and parameters."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType


class Verdict(Enum):
    SATISFIES = "satisfies"
    HAS_ADDITIONAL = "has additional columns"
    HAS_LESS = "has less than expected"


@dataclass(frozen=True)
class Comparison:
    verdict: Verdict
    missing: tuple[str, ...] = ()
    additional: tuple[str, ...] = ()
    mismatched: tuple[tuple[str, str, str], ...] = ()  # name, expected, actual


#: Type of an expected column that may have any type.
ANY = None


def compare(actual: StructType, expected: Mapping[str, DataType | str | StructField | None]) -> Comparison:
    """Whether a schema has all expected columns (names regardless of case) with their types; a wrong type counts as missing,
    and so does a column that may be null where a field that may not is expected."""
    have = {f.name.lower(): f for f in actual}
    missing, wrong = [], []
    for name, kind in expected.items():
        f = have.get(name.lower())
        if f is None:
            missing.append(name)
        elif kind is not ANY:
            strict = isinstance(kind, StructField) and not kind.nullable
            want = kind if isinstance(kind, str) else (kind.dataType if isinstance(kind, StructField) else kind).simpleString()
            if f.dataType.simpleString() != want:
                wrong.append((name, want, f.dataType.simpleString()))
            elif strict and f.nullable:
                wrong.append((name, f"{want} not null", want))
    known = {n.lower() for n in expected}
    more = [f.name for f in actual if f.name.lower() not in known]
    verdict = Verdict.HAS_LESS if missing or wrong else Verdict.HAS_ADDITIONAL if more else Verdict.SATISFIES
    return Comparison(verdict, tuple(missing), tuple(more), tuple(wrong))


def describe(schema: StructType) -> list[dict[str, object]]:
    return [{"name": f.name, "type": f.dataType.simpleString(), "nullable": f.nullable} for f in schema]


def nullability(schema: StructType) -> dict[str, bool]:
    """Whether each column of an analysed query may be null, by Spark's analysis of it; nothing runs. Bind slots to schemas
    that say which of their columns may (``Fragment.shape``), and it follows through expressions, joins and aggregates."""
    return {f.name: f.nullable for f in schema}


def observed_nullability(df: DataFrame) -> dict[str, bool | None]:
    """False: no null is possible; True: there are nulls; None: possible, none there. One pass over the columns that may be null."""
    may = [f.name for f in df.schema if f.nullable]
    counts = df.select(*[F.max(F.col(f"`{c}`").isNull()).alias(c) for c in may]).first() if may else {}
    return {f.name: (True if counts[f.name] else None) if f.nullable else False for f in df.schema}


@dataclass(frozen=True)
class Fragment:
    """A query as a value: SQL with named parameters (:name) and table slots ({slot}), given as DataFrames when it is bound."""

    text: str
    parameters: tuple[str, ...] = ()
    slots: tuple[str, ...] = ()
    defaults: Mapping[str, object] = field(default_factory=dict)

    def bind(self, spark: SparkSession, slots: Mapping[str, DataFrame] | None = None, **args: object) -> DataFrame:
        slots = dict(slots or {})
        for kind, given, known in (("slot", slots, self.slots), ("parameter", args, self.parameters)):
            unknown = [n for n in given if n not in known]
            if unknown:
                raise ValueError(f"unknown {kind} {unknown[0]}")
        values = {**self.defaults, **args}
        lacking = [p for p in self.parameters if p not in values] + [s for s in self.slots if s not in slots]
        if lacking:
            raise ValueError(f"{lacking[0]} is not bound")
        return spark.sql(self.text, args=values or None, **slots)

    def shape(self, spark: SparkSession, slots: Mapping[str, StructType] | None = None, **args: object) -> StructType:
        """Schema of the result, from slot schemas alone."""
        empty = {n: spark.createDataFrame([], s) for n, s in (slots or {}).items()}
        return self.bind(spark, empty, **args).schema

    def contract(self, spark: SparkSession, slots: Mapping[str, StructType] | None = None, **args: object) -> str:
        """A JSON summary: parameters, slots and columns."""
        return json.dumps({"parameters": list(self.parameters), "slots": {n: describe(s) for n, s in (slots or {}).items()}, "columns": describe(self.shape(spark, slots, **args))})


def dependencies(build: Callable[..., DataFrame], sources: Mapping[str, DataFrame]) -> dict[str, list[str]]:
    """Source columns (source.column) that each output column can't be built without.

    build makes the result from the sources by keyword; every source column is left out in turn, and an output column
    depends on it if the plan of that column alone no longer resolves. Row-level needs (filters, keys) count as well.
    Only plans are made, nothing runs."""
    from pyspark.errors import AnalysisException

    names = build(**sources).columns
    out: dict[str, list[str]] = {n: [] for n in names}
    for s, df in sources.items():
        for c in df.columns:
            try:
                left = build(**{**sources, s: df.drop(c)}).columns
            except AnalysisException:
                left = []
            for n in names:
                if n not in left:
                    out[n].append(f"{s}.{c}")
    return out


def field_of(name: str, kind: str, nullable: bool = True) -> StructField:
    return StructField(name, StructType.fromDDL(f"x {kind}")["x"].dataType, nullable)
