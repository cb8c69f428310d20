"""A session that registers tables and answers queries in a result format."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from ..session import configure
from ..sources.files import FORMATS, formatted
from .pipe import Pipe


class EngineError(ValueError):
    """A query that can't be asked."""


class Engine:
    def __init__(self, spark: SparkSession) -> None:
        self.spark = configure(spark)
        self.closed = False

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_: object) -> None:
        self.closed = True

    def register(self, **tables: DataFrame) -> Engine:
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
        return self

    def check(self, text: str) -> str | None:
        """None if Spark can analyse the query, else its complaint; nothing runs."""
        from pyspark.errors import PySparkException

        try:
            self.frame(text)
        except PySparkException as e:
            return str(e).split("\n")[0]
        return None

    def frame(self, text: str, args: Mapping[str, object] | None = None) -> DataFrame:
        if self.closed:
            raise EngineError("the session is closed")
        if not text.strip():
            raise EngineError("the query is blank")
        if "\0" in text:
            raise EngineError("the query holds a NUL")
        return self.spark.sql(text, args=dict(args) if args else None)

    def query(self, text: str, kind: str = "JSONEachRow", args: Mapping[str, object] | None = None) -> DataFrame:
        """The result's rows as lines of text in a format, still distributed."""
        if kind not in FORMATS:
            raise EngineError(f"unknown format {kind}")
        return formatted(self.frame(text, args), kind)

    def pipe(self, table: str) -> Pipe:
        return Pipe.table(self.spark, table)
