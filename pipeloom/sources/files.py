"""Reading and writing tables, and result formats."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Temporary views of the tables of a folder."""
    for n in names or TABLES:
        read_table(spark, sf_dir, n).createOrReplaceTempView(n)


def values(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """VALUES (...), (...)."""
    return spark.createDataFrame(list(rows), schema)


def read_csv(spark: SparkSession, path: str, schema: StructType | str, header: bool = True, **options: str) -> DataFrame:
    return spark.read.options(**options).csv(path, schema=schema, header=header)


def read_json(spark: SparkSession, path: str, schema: StructType | str, **options: str) -> DataFrame:
    return spark.read.options(**options).json(path, schema=schema)


def read_parquet(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def stream(spark: SparkSession, path: str, schema: StructType | str, kind: str = "parquet", **options: str) -> DataFrame:
    """Files of a folder as a stream."""
    return spark.readStream.format(kind).schema(schema).options(**options).load(path)


def json_table(df: DataFrame, column: str, rows_path: str, columns: Mapping[str, tuple[str, str]], outer: bool = False, ordinality: str | None = None) -> DataFrame:
    """JSON_TABLE: a row for each element at rows_path ('$', '$.a'); columns: name -> (type, path in the element)."""
    items = F.col(column) if rows_path == "$" else F.get_json_object(column, rows_path)
    array = F.from_json(F.when(F.ltrim(items).startswith("["), items).otherwise(F.concat(F.lit("["), items, F.lit("]"))), "array<variant>")
    f = F.posexplode_outer if outer else F.posexplode
    out = df.select("*", f(array).alias("_i", "_v"))
    got = [F.try_variant_get("_v", path, kind).alias(n) for n, (kind, path) in columns.items()]
    return out.select(*df.columns, *([(F.col("_i") + 1).alias(ordinality)] if ordinality else []), *got)


def xml_table(df: DataFrame, column: str, rows_path: str, columns: Mapping[str, tuple[str, str]]) -> DataFrame:
    """XMLTABLE: a row for each value that the columns' XPaths below rows_path give, position by position."""
    arrays = [F.xpath(F.col(column), F.lit(f"{rows_path}/{path}")).alias(n) for n, (_, path) in columns.items()]
    out = df.withColumn("_z", F.explode(F.arrays_zip(*arrays)))
    return out.select(*df.columns, *[F.col("_z").getField(str(i)).cast(kind).alias(n) if n not in out.schema["_z"].dataType.names else F.col("_z")[n].cast(kind).alias(n) for i, (n, (kind, _)) in enumerate(columns.items())])


def copy_to(df: DataFrame, path: str, kind: str = "parquet", mode: str = "error", partition_by: Sequence[str] = (), **options: str) -> None:
    """COPY INTO / INSERT OVERWRITE DIRECTORY."""
    df.write.format(kind).mode(mode).options(**options).partitionBy(*partition_by).save(path)


#: Result formats: a DataFrame of one text column.
FORMATS = ("JSONEachRow", "JSONCompactEachRow", "CSV", "TSV")


def formatted(df: DataFrame, kind: str) -> DataFrame:
    """Rows as text in a result format, computed where the rows are."""
    cells = [F.col(f"`{c}`") for c in df.columns]
    if kind == "JSONEachRow":
        return df.select(F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}).alias("line"))
    if kind == "JSONCompactEachRow":
        each = [F.regexp_replace(F.to_json(F.struct(c.alias("x")), {"ignoreNullFields": "false"}), r'^\{"x":|\}$', "") for c in cells]
        return df.select(F.concat(F.lit("["), F.concat_ws(",", *each), F.lit("]")).alias("line"))
    if kind in ("CSV", "TSV"):
        return df.select(F.to_csv(F.struct(*cells), {"sep": "," if kind == "CSV" else "\t"}).alias("line"))
    raise ValueError(f"unknown format {kind}")
