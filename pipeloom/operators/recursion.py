"""Hierarchies: CONNECT BY and transitive closure, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.spool import written
from .joins import numbered


def connect_by(df: DataFrame, key: str, parent: str, start_with: str, max_depth: int = 1000, separator: str = "/") -> DataFrame:
    """START WITH ... CONNECT BY PRIOR key = parent: df's columns with level, path, root and is_cycle.

    One join a level; a row that is on its own path already is marked and not gone into (NOCYCLE).
    Rows below max_depth levels are an error."""
    k = F.col(key)
    level = df.where(start_with).withColumns({"level": F.lit(1), "path": F.array(k.cast("string")), "root": k, "is_cycle": F.lit(False)})
    out = level
    for depth in range(2, max_depth + 2):
        up = level.where("NOT is_cycle").select(F.col(key).alias("_p"), F.col("path").alias("_path"), F.col("root").alias("_root"))
        level = df.join(up, df[parent] == up["_p"]).withColumns({"level": F.lit(depth), "is_cycle": F.array_contains("_path", k.cast("string")), "path": F.concat("_path", F.array(k.cast("string"))), "root": F.col("_root")}).select(*out.columns)
        level = written(level)
        if level.isEmpty():
            break
        if depth > max_depth:
            raise ValueError(f"more than {max_depth} levels")
        out = out.unionByName(level)
    return out.withColumn("path", F.array_join("path", separator))


def search_order(found: DataFrame, key: str, name: str = "ord", depth_first: bool = True, separator: str = "/") -> DataFrame:
    """SEARCH DEPTH | BREADTH FIRST BY key SET name on the result of ``connect_by``: each row's number in that order of visit.

    Depth first, rows come in the order of their paths, key by key as numbers; breadth first, by level and then so."""
    steps = F.transform(F.split("path", separator), lambda x: x.cast(dict(found.dtypes)[key]))
    order = ["_steps"] if depth_first else ["level", "_steps"]
    return numbered(found.withColumn("_steps", steps), order, name).drop("_steps")


def closure(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """All (src, dst) pairs with a path between them, by doubling path lengths (log2 of the longest path joins).
    The result may be as large as the square of the nodes."""
    paths = written(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).distinct())
    n = paths.count()
    while True:
        more = paths.alias("x").join(paths.alias("y"), F.col("x.b") == F.col("y.a")).select("x.a", "y.b")
        paths = written(paths.union(more).distinct())
        m = paths.count()
        if m == n:
            return paths.toDF(src, dst)
        n = m


def recursive(seed: DataFrame, step, max_depth: int = 1000, distinct: bool = False) -> DataFrame:  # noqa: ANN001
    """WITH RECURSIVE: seed UNION [ALL] step(last level) until a level is empty; an error after max_depth steps that gave rows."""
    level = written(seed)
    out = level
    for i in range(max_depth + 1):
        level = step(level).toDF(*out.columns)
        level = written(level.distinct().join(out, out.columns, "left_anti") if distinct else level)
        if level.isEmpty():
            break
        if i == max_depth:
            raise ValueError(f"more than {max_depth} steps")
        out = out.union(level)
        if distinct and i % 16 == 15:
            out = written(out)  # many levels are looked at in each step
    return out
