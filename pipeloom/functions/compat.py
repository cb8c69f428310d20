"""Functions with another engine's meaning, and where engines differ from Spark.

A query that is moved to Spark takes these where Spark's function of that name gives other results."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from enum import IntEnum

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import numbers, text


class Severity(IntEnum):
    SAFE = 0
    WARNING = 1
    REFUSED = 2


@dataclass(frozen=True)
class Difference:
    engine: str
    construct: str
    there: str
    in_spark: str
    severity: Severity
    use: str = ""  # what gives the engine's result


#: Differences in results of the same text, as measured on both sides.
DIFFERENCES: tuple[Difference, ...] = (
    Difference("duckdb", "log", "log10 of one argument", "natural logarithm", Severity.WARNING, "numbers.log_base(10, x)"),
    Difference("duckdb", "concat", "skips nulls", "null if any is", Severity.WARNING, "text.concat_skipping_nulls"),
    Difference("duckdb", "regexp_replace", "replaces the first match", "replaces all", Severity.WARNING, "text.regexp_replace_first"),
    Difference("duckdb", "dayofweek", "Sunday is 0", "Sunday is 1", Severity.WARNING, "dayofweek_from_zero"),
    Difference("duckdb", "split", "a literal separator", "a pattern", Severity.WARNING, "text.split_literal"),
    Difference("duckdb", "cast_double_to_int", "rounds", "truncates", Severity.WARNING, "cast_rounding"),
    Difference("duckdb", "skewness", "of a sample", "of a population", Severity.WARNING, "aggregates.sample_skewness"),
    Difference("duckdb", "kurtosis", "of a sample", "of a population", Severity.WARNING, "aggregates.sample_kurtosis"),
    Difference("duckdb", "divide_by_zero", "null", "an error", Severity.WARNING, "try_divide"),
    Difference("duckdb", "array_agg", "keeps nulls", "drops nulls", Severity.WARNING, "collections.array_agg_nulls"),
    Difference("duckdb", "order_by", "nulls last", "nulls first", Severity.WARNING, "explicit NULLS LAST"),
    Difference("trino", "greatest", "null if any is", "skips nulls", Severity.WARNING, "numbers.greatest_strict"),
    Difference("trino", "least", "null if any is", "skips nulls", Severity.WARNING, "numbers.least_strict"),
    Difference("trino", "split", "a literal separator", "a pattern", Severity.WARNING, "text.split_literal"),
    Difference("trino", "day_of_week", "Monday is 1", "dayofweek: Sunday is 1", Severity.WARNING, "isodow"),
    Difference("trino", "order_by", "nulls last", "nulls first", Severity.WARNING, "explicit NULLS LAST"),
    Difference("trino", "timestamp_with_time_zone", "keeps a zone with each value", "keeps instants", Severity.REFUSED),
    Difference("postgres", "order_by", "nulls last", "nulls first", Severity.WARNING, "explicit NULLS LAST"),
    Difference("postgres", "integer_division", "truncates", "gives a double", Severity.WARNING, "integer_division"),
    Difference("postgres", "concat", "skips nulls", "null if any is", Severity.WARNING, "text.concat_skipping_nulls"),
    Difference("postgres", "regexp_replace", "replaces the first match", "replaces all", Severity.WARNING, "text.regexp_replace_first"),
    Difference("mysql", "integer_division", "gives a decimal", "gives a double", Severity.WARNING),
    Difference("mysql", "greatest", "null if any is", "skips nulls", Severity.WARNING, "numbers.greatest_strict"),
    Difference("mysql", "string_comparison", "ignores case by default", "is exact", Severity.REFUSED),
    Difference("clickhouse", "divide_by_zero", "infinity or zero", "an error", Severity.WARNING, "try_divide"),
    Difference("clickhouse", "order_by", "nulls last", "nulls first", Severity.WARNING, "explicit NULLS LAST"),
    Difference("clickhouse", "unsigned_overflow", "wraps around", "an error", Severity.REFUSED),
    Difference("doris", "greatest", "null if any is", "skips nulls", Severity.WARNING, "numbers.greatest_strict"),
    Difference("bigquery", "substr", "position 0 counts as 1", "position 0 counts as 1", Severity.SAFE),
)


def differences(engine: str, constructs: Sequence[str] | None = None) -> list[Difference]:
    """Known differences of an engine, of all or of the named constructs."""
    return [d for d in DIFFERENCES if d.engine == engine and (constructs is None or d.construct in constructs)]


def verdict(engine: str, constructs: Sequence[str]) -> Severity:
    """The worst severity among the constructs that a query uses."""
    return max((d.severity for d in differences(engine, constructs)), default=Severity.SAFE)


def dayofweek_from_zero(d: Column) -> Column:
    return F.dayofweek(d) - 1


def isodow(d: Column) -> Column:
    return F.weekday(d) + 1


def cast_rounding(x: Column, kind: str = "int") -> Column:
    """To an integer type by rounding halves away from zero."""
    return F.round(x).cast(kind)


def cast_half_even(x: Column, kind: str = "int") -> Column:
    """To an integer type by rounding halves to the even neighbour."""
    return F.rint(x).cast(kind)


def integer_division(a: Column, b: Column) -> Column:
    """Toward zero; null for a divisor of zero."""
    q = F.try_divide(a.cast("double"), b.cast("double"))
    return F.when(q < 0, F.ceil(q)).otherwise(F.floor(q)).cast("long")


def log10_of_zero(x: Column) -> Column:
    """log10 with minus infinity for 0."""
    return F.when(x == 0, F.lit(float("-inf"))).otherwise(numbers.log_base(10.0, x))


#: Functions by engine and name there, for columns.
FUNCTIONS: dict[str, dict[str, Callable[..., Column]]] = {
    "duckdb": {"log": log10_of_zero, "concat": text.concat_skipping_nulls, "regexp_replace": text.regexp_replace_first, "dayofweek": dayofweek_from_zero, "split": text.split_literal, "list_dot_product": numbers.dot_product, "list_cosine_similarity": numbers.cosine_similarity, "list_distance": numbers.euclidean_distance},
    "trino": {"greatest": numbers.greatest_strict, "least": numbers.least_strict, "split": text.split_literal, "day_of_week": isodow, "hamming_distance": text.hamming, "truncate": numbers.truncate},
    "postgres": {"concat": text.concat_skipping_nulls, "regexp_replace": text.regexp_replace_first, "div": integer_division, "trunc": numbers.truncate},
    "mysql": {"greatest": numbers.greatest_strict, "least": numbers.least_strict, "truncate": numbers.truncate},
    "doris": {"greatest": numbers.greatest_strict, "least": numbers.least_strict},
    "clickhouse": {"cosineDistance": numbers.cosine_distance, "L2Distance": numbers.euclidean_distance, "L1Distance": numbers.manhattan_distance, "dotProduct": numbers.dot_product, "splitByString": lambda sep, s: text.split_literal(s, sep)},
}


def function(engine: str, name: str) -> Callable[..., Column]:
    """The function of an engine, else Spark's of that name."""
    found = FUNCTIONS.get(engine, {}).get(name)
    if found is None:
        found = getattr(F, name.lower(), None)
    if found is None:
        raise ValueError(f"{engine} function {name} is not known")
    return found
