"""Event-time windows for tables and streams alike."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.spool import folder


def date_bin(ts: str, width: str, slide: str | None = None) -> Column:
    """The start of the tumbling (or sliding) window of a time."""
    return F.window(ts, width, slide or width)["start"]


def windowed(df: DataFrame, ts: str, width: str, *aggs: Column, by: Sequence[str] = (), slide: str | None = None, late: str | None = None) -> DataFrame:
    """Aggregates by event-time window and key; ``late`` is the watermark of a stream."""
    base = df.withWatermark(ts, late) if late else df
    out = base.groupBy(F.window(ts, width, slide) if slide else F.window(ts, width), *by).agg(*aggs)
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c for c in out.columns if c != "window"])


def session_windowed(df: DataFrame, ts: str, gap: str, *aggs: Column, by: Sequence[str] = (), late: str | None = None) -> DataFrame:
    base = df.withWatermark(ts, late) if late else df
    out = base.groupBy(F.session_window(ts, gap), *by).agg(*aggs)
    return out.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *[c for c in out.columns if c != "session_window"])


def deduplicated(df: DataFrame, keys: Sequence[str], ts: str, late: str) -> DataFrame:
    """First row of each key within the watermark."""
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def gap_filled(df: DataFrame, ts: str, width: str, by: Sequence[str], value: Column, name: str, fill: str = "null") -> DataFrame:
    """An aggregate for every window between the first and the last one of each key; missing ones are null, zero ('zero')
    or the last value ('locf')."""
    from pyspark.sql.window import Window

    bins = df.groupBy(*by, date_bin(ts, width).alias("bin")).agg(value.alias(name))
    step = F.expr(f"INTERVAL {width}")
    spine = bins.groupBy(*by).agg(F.min("bin").alias("lo"), F.max("bin").alias("hi")).select(*by, F.explode(F.sequence("lo", "hi", step)).alias("bin"))
    out = spine.join(bins, [*by, "bin"], "left")
    if fill == "zero":
        return out.fillna(0, [name])
    if fill == "locf":
        return out.withColumn(name, F.last(name, ignorenulls=True).over(Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))
    return out


def run_to_table(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there now and read its result as a table, also a view of that name.

    Each batch is written as Parquet in the cluster's shared folder, beside the checkpoint; only paths reach the driver.
    In complete mode the last batch is the result, else all are. A batch that runs again replaces its own rows."""
    spark = stream.sparkSession
    at = folder(spark, name)
    paths: dict[int, str] = {}

    def write(batch: DataFrame, i: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/batch-{i}")
        paths[i] = f"{at}/batch-{i}"

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{at}/checkpoint").queryName(name).trigger(availableNow=True).start().awaitTermination()
    found = [paths[max(paths)]] if paths and mode == "complete" else list(paths.values())
    out = spark.read.schema(stream.schema).parquet(*found) if found else spark.createDataFrame([], stream.schema)
    out.createOrReplaceTempView(name)
    return out
