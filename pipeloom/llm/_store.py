"""Tables between steps (``materialise`` writes them in the shared folder), fresh names, frequent rows, and bitmaps of fixed size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.spool import written as materialise

__all__ = ["bitmap", "fresh", "in_bitmap", "least_counts", "materialise", "may_match"]

#: Bits of a bitmap: 2**23, so 1 MB whatever the input.
BITMAP_BITS = 23
_BUCKET_BITS = 15  # bitmap_construct_agg makes bitmaps of 4096 bytes


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, each with as many underscores as make it unlike all columns of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def least_counts(df: DataFrame, kind: str, count: str, most: dict[int, int]) -> dict[int, int]:
    """For each kind the least count from which on at most so many of its rows have it; kinds without such a count are left out.

    From a histogram of counts, exact below 4096 and by steps of about 1 % above, so tasks send few rows and nothing is sorted."""
    c = F.col(count)
    step = F.when(c < 4096, c).otherwise(4096 + F.floor(F.log2(c) * 64)).cast("long")
    bins = df.groupBy(F.col(kind).alias("kind"), step.alias("step")).agg(F.min(c).alias("least"), F.count("*").alias("n")).collect()
    out: dict[int, int] = {}
    left = dict(most)
    for r in sorted(bins, key=lambda r: -r["step"]):
        k = r["kind"]
        left[k] = left.get(k, 0) - r["n"]
        if left[k] >= 0:
            out[k] = r["least"]
    return out


def bitmap(df: DataFrame, key: Column) -> np.ndarray:
    """Which values of key mod 2**23 occur, as 2**20 bytes, whatever the number of rows."""
    bit = F.pmod(key, F.lit(1 << BITMAP_BITS))
    rows = (
        df.where(key.isNotNull())
        .groupBy(F.shiftright(bit, _BUCKET_BITS).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.pmod(bit, F.lit(1 << _BUCKET_BITS))).alias("bits"))
        .collect()  # 256 rows of 4 KB at most
    )
    out = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    for r in rows:
        at = r["bucket"] << (_BUCKET_BITS - 3)
        out[at : at + 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be in the set; false only for keys that are not."""
    k = keys.view(np.uint64) & np.uint64((1 << BITMAP_BITS) - 1)
    return (bits[(k >> np.uint64(3)).astype(np.int64)] >> (k & np.uint64(7)).astype(np.uint8)) & 1 > 0


def may_match(df: DataFrame, key: str, bits: np.ndarray) -> DataFrame:
    """Rows of df whose key may be in the bitmap; spares a join the rest."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = in_bitmap(bits, b.column(key).to_numpy(zero_copy_only=False).astype(np.int64))
            yield b.filter(pa.array(at))

    return df.mapInArrow(keep, df.schema)
