"""Row patterns: MATCH_RECOGNIZE."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.pipe import Expr, column, ordering

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def match_recognize(df: DataFrame, partition_by: Sequence[str], order_by: Sequence[Expr], define: Mapping[str, Expr], pattern: str, measures: Mapping[str, tuple[str, str, str]] | None = None, after: str = "past last row", all_rows: bool = False) -> DataFrame:
    """Matches of a pattern over ordered rows.

    define: a condition for each symbol, SQL or a Column, or a function of the partition's window (for PREV and NEXT:
    ``lambda w: F.col("price") < F.lag("price").over(w)``); a row has the first symbol whose condition holds, else none.
    pattern: a regular expression whose words are symbols, "START DOWN+ UP{2,}"; those of one letter may stand side by side.
    measures: name -> (function of first, last, min, max, sum, count; column; symbols, '' for all rows of the match).
    after: where the search goes on, "past last row" or at the "next row" after a match's first one.
    all_rows: all columns of each row of a match, with match_number and its symbol as classifier, instead of one row a match.

    A row without a symbol is in no match, so partitions fall apart at these rows, and only a run of rows with symbols
    is gathered: as long as a run, not as a partition, must fit one task. Numbering rows is a window function's work,
    sorted and streamed."""
    letter = dict(zip(define, _LETTERS, strict=False))
    if len(define) > len(_LETTERS):
        raise ValueError(f"more than {len(_LETTERS)} symbols")
    if after not in ("past last row", "next row"):
        raise ValueError("after must be 'past last row' or 'next row'")

    def letters(m: re.Match[str]) -> str:
        found = [m[0]] if m[0] in letter else list(m[0])  # "AB" may be two symbols of one letter
        if not all(x in letter for x in found):
            raise ValueError(f"no symbol {m[0]} is defined")
        return "".join(letter[x] for x in found)

    regex = re.sub(r"\s+", "", re.sub(r"[A-Za-z_]\w*", letters, pattern))
    w = Window.partitionBy(*partition_by).orderBy(*map(ordering, order_by))
    symbol: Column = F.lit(None).cast("string")
    for name, condition in reversed(list(define.items())):
        symbol = F.when(_windowed(condition, w), letter[name]).otherwise(symbol)
    used = list(df.columns) if all_rows else sorted({c for _, c, _ in (measures or {}).values() if c})
    rows = df.withColumn("_s", symbol).withColumn("_i", F.row_number().over(w))
    rows = rows.withColumn("_run", F.count_if(F.col("_s").isNull()).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_s IS NOT NULL")
    whole = rows.groupBy(*partition_by, "_run").agg(F.sort_array(F.collect_list(F.struct("_i", "_s", F.struct(*used).alias("_x") if used else F.lit(None).alias("_x")))).alias("_r"))
    text = F.array_join(F.transform("_r", lambda x: x["_s"]), "")
    found = whole.withColumn("_at", _places(text, regex) if after == "past last row" else _starts(text, regex))
    found = found.select(*partition_by, "_r", F.explode("_at").alias("_p")).withColumn("_m", F.slice("_r", F.col("_p.at") + 1, F.col("_p.n")))
    by_match = Window.partitionBy(*partition_by).orderBy(F.col("_m")[0]["_i"])
    found = found.withColumn("match_number", F.row_number().over(by_match))
    if all_rows:
        name_of = F.create_map(*[F.lit(x) for n, c in letter.items() for x in (c, n)])
        each = found.select("match_number", F.explode("_m").alias("_row"))
        return each.select("_row._x.*", "match_number", F.element_at(name_of, F.col("_row._s")).alias("classifier"))
    return found.select(*partition_by, "match_number", *[_measure(f, c, "".join(letter[x] for x in (s.split() if " " in s or s in letter else s))).alias(n) for n, (f, c, s) in (measures or {}).items()])


def _places(text: Column, regex: str) -> Column:
    """(at, n) of the matches in a text, each search after the last match; what precedes each follows from cutting the text at the matches."""
    lengths = F.transform(F.regexp_extract_all(text, F.lit(f"({regex})"), 1), F.length)
    gaps = F.transform(F.split(text, regex, -1), F.length)
    total = lambda xs, k: F.aggregate(F.slice(xs, 1, k), F.lit(0), lambda a, x: a + x)
    places = F.transform(lengths, lambda n, k: F.struct((total(gaps, k + 1) + total(lengths, k)).alias("at"), n.alias("n")))
    return F.filter(places, lambda p: p["n"] > 0)


def _starts(text: Column, regex: str) -> Column:
    """(at, n) of the match that begins at each place of a text, where there is one."""
    places = F.transform(F.sequence(F.lit(0), F.length(text) - 1), lambda i: F.struct(i.alias("at"), F.length(F.regexp_extract(F.substring(text, i + 1, F.length(text)), f"^({regex})", 1)).alias("n")))
    return F.filter(places, lambda p: p["n"] > 0)


def _windowed(condition: Expr, w) -> Column:  # noqa: ANN001
    """Conditions in terms of the partition's window, or without it."""
    return condition(w) if callable(condition) and not isinstance(condition, Column) else column(condition)


def _measure(function: str, name: str, symbols: str) -> Column:
    rows = F.filter("_m", lambda x: F.instr(F.lit(symbols), x["_s"]) > 0) if symbols else F.col("_m")
    values = F.transform(rows, lambda x: x["_x"][name]) if name else rows
    return {
        "first": lambda: F.get(values, F.lit(0)),
        "last": lambda: F.get(values, F.size(values) - 1),
        "min": lambda: F.array_min(values),
        "max": lambda: F.array_max(values),
        "sum": lambda: F.aggregate(values, F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double"), F.lit(0.0))),
        "count": lambda: F.size(values),
    }[function]()
