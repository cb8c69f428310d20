"""Managed tables, views, functions and statistics."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def create_table_as(df: DataFrame, name: str, replace: bool = False, partition_by: Sequence[str] = (), bucket_by: tuple[int, Sequence[str]] | None = None) -> DataFrame:
    """CREATE [OR REPLACE] TABLE AS; bucketed tables join on their keys without a shuffle."""
    w = df.write.mode("overwrite" if replace else "error")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if bucket_by:
        w = w.bucketBy(bucket_by[0], *bucket_by[1]).sortBy(*bucket_by[1])
    w.saveAsTable(name)
    return df.sparkSession.table(name)


def create_view(df: DataFrame, name: str, replace: bool = True) -> DataFrame:
    (df.createOrReplaceTempView if replace else df.createTempView)(name)
    return df.sparkSession.table(name)


def create_function(spark: SparkSession, name: str, parameters: Mapping[str, str], returns: str, body: str) -> None:
    """CREATE [TEMPORARY] FUNCTION ... RETURN expression (a macro in other engines)."""
    args = ", ".join(f"{p} {t}" for p, t in parameters.items())
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {returns} RETURN {body}")


def insert_into(df: DataFrame, name: str, overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "append").insertInto(name, overwrite=overwrite)


def truncate(spark: SparkSession, name: str) -> None:
    spark.sql(f"TRUNCATE TABLE {name}")


def drop(spark: SparkSession, name: str, kind: str = "TABLE") -> None:
    spark.sql(f"DROP {kind} IF EXISTS {name}")


def analyze(spark: SparkSession, name: str) -> None:
    """Statistics for the optimizer."""
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR ALL COLUMNS")


def summarize(df: DataFrame) -> DataFrame:
    """A row for each column: type, rows, nulls, distinct values (estimated), least and greatest value as text. One pass."""
    parts = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.count("*").alias("n"), F.count_if(F.col(f"`{c}`").isNull()).alias("nulls"), F.approx_count_distinct(F.col(f"`{c}`").cast("string")).alias("distinct_estimate"), F.min(f"`{c}`").cast("string").alias("least"), F.max(f"`{c}`").cast("string").alias("greatest")) for c, t in df.dtypes if not t.startswith(("map", "variant"))]
    return df.agg(F.array(*parts).alias("a")).select(F.inline("a"))


def functions_of(spark: SparkSession) -> set[str]:
    """Names that Spark resolves as functions."""
    return {r["function"].lower() for r in spark.sql("SHOW FUNCTIONS").collect()}


def unmappable(spark: SparkSession, names: Sequence[str], known: Mapping[str, Callable] | None = None) -> list[str]:
    """Those of the names that neither Spark nor a registry of functions has."""
    have = functions_of(spark) | {n.lower() for n in known or {}}
    return [n for n in names if n.lower() not in have]


def sample_rows(df: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """TABLESAMPLE (n ROWS): n random rows, those of the least seeded MD5 of the row's values as text."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]).cast("binary"))).limit(n)


def sample_bucket(df: DataFrame, bucket: int, of: int, on: Sequence[str]) -> DataFrame:
    """TABLESAMPLE (BUCKET bucket OUT OF of ON on): rows are dealt by the first 60 bits of an MD5 of their values as text."""
    text = F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in on])
    return df.where(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long") % of == bucket - 1)


def hinted(df: DataFrame, hint: str, *parameters: object) -> DataFrame:
    """A join or partitioning hint, such as merge, shuffle_hash, skew-free rebalance."""
    return df.hint(hint, *parameters)


def distribute_by(df: DataFrame, *keys: str, sort: Sequence[str] = ()) -> DataFrame:
    """DISTRIBUTE BY keys SORT BY sort; with sort = keys, CLUSTER BY."""
    out = df.repartition(*keys)
    return out.sortWithinPartitions(*sort) if sort else out
