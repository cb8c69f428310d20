"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

1. Sizes: words of each text, summed by source. The table of sources is a part
   of the mix's specification (a weight each); MAX_SOURCES bounds it.
2. Targets: the sources share ``budget`` times all words by weight; none may pass
   ``max_repeats`` times its own words; what is above goes to the others by weight.
3. All blocks of BLOCK words that the targets make up go to the sources by highest
   quotients (target / (2 s + 1) for the next block after s). Each source is dealt
   into shards of about SHARD_WORDS words by a seeded hash; a shard's words, in a seeded
   order of its documents, form blocks. The source's blocks go to its shards by highest
   quotients of their sizes, which gives each shard its integer quota. What rounding
   to blocks leaves to the target, or puts above it, is then added to shards in order.
4. In each shard, blocks come in a seeded permutation; the quota takes them in this
   order, and a second time from the start where it is above the shard's words.
   So no document is taken more than twice with the default max_repeats = 2.

Nothing but the table of sources reaches the driver. A shard is the largest group
that one task holds; a hot source is many shards, at most MAX_SHARDS, so that one task can
apportion them (from 2.1e9 words of a source on, its shards hold more than SHARD_WORDS).

Defined results: a null text has no words; a null source is a source of its own,
last in order; documents without words take none; rows with equal keys are
separate documents; an empty table gives an empty table. Texts of any length are taken whole:
a document is cut into as many pieces as it has blocks. Columns of the input
stay, but one that bears a result's name is replaced in ``mix``; ``realise`` gives all
columns back as they were, besides the text and its length.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_SOURCES = 100_000
MAX_SHARDS = 1 << 16  # of a source
SHARD_WORDS = 32_768
BLOCK = 512
WEIGHTS = (3, 1, 2)
WORD = r"[^\x20\x09-\x0D]+"
#: Primes above any number of blocks in a shard, so coprime to it: multipliers of the permutations.
_PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], budget: float, max_repeats: float) -> np.ndarray:
    """What each source shall give, in words."""
    size, weight = np.asarray(sizes, float), np.asarray(weights, float)
    out, free, left = np.zeros(len(size)), np.ones(len(size), bool), budget * size.sum()
    while free.any():
        share = np.where(free, weight, 0)
        out[free] = (left * share / share.sum())[free]
        above = free & (out >= max_repeats * size)
        if not above.any():
            break
        out[above] = max_repeats * size[above]
        left -= out[above].sum()
        free &= ~above
    return out


def sainte_lague(size: np.ndarray, most: np.ndarray, seats: int) -> np.ndarray:
    """Seats by highest quotients size / (2 s + 1), at most ``most`` each; ties go to the first."""
    size, most = np.asarray(size, float), np.asarray(most, np.int64)
    if most.sum() <= seats:
        return most
    at = lambda q: np.minimum(most, np.floor((size / q + 1) / 2).astype(np.int64))  # noqa: E731  seats with a quotient of q or more
    low, high = size[size > 0].min() / (2 * seats + 3) / 2, size.max() * 2
    for _ in range(200):  # quotient of the last seat
        mid = (low + high) / 2
        low, high = (mid, high) if at(mid).sum() >= seats else (low, mid)
    out = at(high)
    nxt = np.where(out < most, size / (2 * out + 1), -1)
    out[np.argsort(-nxt, kind="stable")[: seats - out.sum()]] += 1
    return out


def shard_quotas(size: np.ndarray, blocks: int, words: int, block: int, max_repeats: int) -> np.ndarray:
    """Words that each shard of a source gives: its share of the blocks, and what they lack or have above words, in order."""
    most = max_repeats * size
    out = sainte_lague(size, most // block, blocks) * block if size.sum() else np.zeros(len(size), np.int64)
    rest = words - int(out.sum())
    room = most - out if rest > 0 else out
    before = np.cumsum(room) - room
    return out + np.sign(rest) * np.clip(abs(rest) - before, 0, room)


RESULTS = ("size", "source_size", "target", "taken", "spans")


def mix(df: DataFrame, **how: object) -> DataFrame:
    """df with size, source_size, target, taken and, as ``spans``, the words [lo, hi) that each pass takes; how: as for ``spread``."""
    kept = [F.col("row").getField(c).alias(c) for c in df.columns if c.lower() not in RESULTS]
    return spread(df, **how).select(*kept, *RESULTS)


def spread(df: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = 1.5, max_repeats: int = 2, block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: int = 1, key: str = "doc_id", size: Column | None = None) -> DataFrame:
    """The rows of df, each as a struct ``row``, with the columns RESULTS."""
    sized = df.select(F.struct("*").alias("row"), F.col("source"), F.col(key).alias("key"), (n_words(F.col("text")) if size is None else size).alias("size"))
    stats = sized.groupBy("source").agg(F.sum("size").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(stats) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    stats = sorted(stats, key=lambda r: (r["source"] is None, r["source"] or ""))
    source_sizes = [r["n"] for r in stats]
    goal = targets(source_sizes, [weights[i % len(weights)] for i in range(len(stats))], budget, max_repeats)
    seats = sainte_lague(goal, np.ceil(goal / block), int(goal.sum() // block)) if goal.sum() > 0 else np.zeros(len(goal), np.int64)
    rows = [(r["source"], i, int(n), float(t), int(k), int(min(round(t), max_repeats * n)), int(min(MAX_SHARDS, max(1, -(-n // shard_words))))) for i, (r, n, t, k) in enumerate(zip(stats, source_sizes, goal, seats, strict=True))]
    sources = df.sparkSession.createDataFrame(rows, "_source string, _number int, source_size long, target double, _blocks long, _words long, _shards int")
    hashed = lambda *cols: F.xxhash64(F.lit(seed), *cols)
    dealt = (
        sized.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("_source")))  # MAX_SOURCES rows at most
        .withColumn("_order", hashed("key", "size"))
        .withColumn("_shard", F.pmod(F.xxhash64(F.lit("shard"), F.col("_order")), F.col("_shards")).cast("int"))
    )

    def quotas(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_shard")
        return pd.DataFrame({"_number": pdf["_number"], "_shard": pdf["_shard"], "_quota": shard_quotas(pdf["_n"].to_numpy(np.int64), int(pdf["_blocks"].iloc[0]), int(pdf["_words"].iloc[0]), block, max_repeats), "_n": pdf["_n"]})

    cells = dealt.groupBy("_number", "_shards", "_blocks", "_words", "_shard").agg(F.sum("size").alias("_n"))  # MAX_SHARDS rows a source at most
    quota = cells.groupBy("_number").applyInPandas(quotas, "_number int, _shard int, _quota long, _n long")
    # The window's order has equal rows only where documents agree in key and size: they are alike.
    w = Window.partitionBy("_number", "_shard").orderBy("_order", "key", "size")
    placed = dealt.withColumn("_end", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = placed.join(quota, ["_number", "_shard"])  # rows lie as the window has dealt them

    n, end, own, t = F.col("_n"), F.col("_end"), F.col("size"), F.col("_quota")
    begin = end - own
    blocks = F.floor((n + (block - 1)) / block).cast("long")
    pick = F.pmod(F.xxhash64(F.lit("prime"), F.lit(seed), "source", "_shard"), F.lit(len(_PRIMES))).cast("int")
    prime = F.element_at(F.array(*[F.lit(p).cast("long") for p in _PRIMES]), pick + 1)
    shift = F.pmod(F.xxhash64(F.lit("shift"), F.lit(seed), "source", "_shard"), blocks)
    rank = lambda b: F.pmod(prime * b + shift, blocks)
    short = blocks * block - n  # words that the last block lacks

    def span(b: Column) -> Column:
        at = rank(b) * block - F.when(rank(blocks - 1) < rank(b), short).otherwise(0)  # words of the blocks before it
        lo = F.greatest(begin, b * block)
        ends = [F.least(end, b * block + F.greatest(F.lit(0), q - at)) for q in (t, t - n)]
        return F.struct((lo - begin).alias("lo"), *[(F.greatest(lo, F.least(x, (b + 1) * block)) - begin).alias(f"hi{i}") for i, x in enumerate(ends, 1)])

    spans = F.when(own > 0, F.transform(F.sequence(F.floor(begin / block).cast("long"), F.floor((end - 1) / block).cast("long")), span))
    taken = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["hi1"] + s["hi2"] - 2 * s["lo"])
    return joined.withColumn("spans", spans).select("row", "size", "source_size", "target", F.coalesce(taken, F.lit(0)).alias("taken"), "spans")


def realise(documents: DataFrame, **how: object) -> DataFrame:
    """The rows of the mix itself: a row for each pass that takes words of a document, with the text if it is
    taken whole, else with the taken words joined by one space; n_chars follows the text, where there is that column."""
    text = F.col("row").getField("text")
    words = F.regexp_extract_all(text, F.lit(WORD), 0)

    def taken_in(end: str) -> Column:
        return F.transform("spans", lambda s: F.struct(s["lo"].alias("lo"), s[end].alias("hi")))

    passes = F.explode(F.array(taken_in("hi1"), taken_in("hi2")))
    count = F.aggregate("pass", F.lit(0).cast("long"), lambda a, s: a + s["hi"] - s["lo"])
    out = spread(documents, **how).where("taken > 0").select("row", "size", passes.alias("pass")).withColumn("n", count).where("n > 0")
    part = F.array_join(F.flatten(F.transform(F.filter("pass", lambda s: s["hi"] > s["lo"]), lambda s: F.slice(words, (s["lo"] + 1).cast("int"), (s["hi"] - s["lo"]).cast("int")))), " ")
    out = out.select("row", F.when(F.col("n") == F.col("size"), text).otherwise(part).alias("cut"))
    new = {"text": F.col("cut"), "n_chars": F.length("cut").cast("long")}
    return out.select(*[(new[c] if c in new else F.col("row").getField(c)).alias(c) for c in documents.columns])
