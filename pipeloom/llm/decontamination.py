"""Benchmark decontamination by winnowing.

Words are runs of ASCII letters and digits and of all other non-ASCII characters,
A-Z in lower case. A *window* is SPAN consecutive words of an item; an item of
fewer words, but not none, is one window. Every occurrence of a window in a
document is found:

1. Fingerprints: of every GUARANTEE = SPAN - GRAM + 1 consecutive GRAM-word hashes
   of a text the smallest is kept, in documents and items alike. Two texts that
   share SPAN words share the GUARANTEE hashes in them, so also the smallest. For
   items of L < SPAN words, all L-word hashes are kept (a sliding window of one).
2. A bitmap of the items' fingerprints (1 MB whatever the input) goes to the
   tasks; they drop fingerprints that no item has and keep the text only of
   documents with one left. The join of fingerprints on both sides decides.
3. Hits are extended: the documents' own windows that contain a hit are compared
   with the items' windows as words, not as hashes.

Equal items are one class for the joins; their ids are listed for each document.

Defined results: null or empty text has no words and is not contaminated; so is
every document without items. Rows are judged each on its own: equal rows give
equal rows. Items with a null id count, under the string 'null'. An empty table of
documents gives an empty table. Columns of the documents other than the ones
named are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import bitmap, fresh, in_bitmap, materialise
from ._words import ALNUM, U, Words, chunks, grams, split, within
from .near_dedup import text_keys

SPAN, GRAM = 10, 5


def fingerprints(w: Words, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(word, fingerprint) pairs of the winnowed texts; lengths: those below SPAN of which all grams are kept."""
    at, fp = [], []
    n = len(w.hash)
    if len(g := grams(w.hash, GRAM)):
        width = SPAN - GRAM + 1
        ok = np.flatnonzero(within(w.first, SPAN, n))
        if len(ok):
            rows = np.lib.stride_tricks.sliding_window_view(g, width)
            where = np.unique(ok + np.argmin(rows[ok], axis=1))
            at.append(where)
            fp.append(g[where] ^ U(SPAN))
    for k in lengths:
        where = np.flatnonzero(within(w.first, k, n))
        at.append(where)
        fp.append(grams(w.hash, k)[where] ^ U(k * 0x51ED27) if len(where) else np.zeros(0, U))
    return (np.concatenate(at), np.concatenate(fp)) if at else (np.zeros(0, np.int64), np.zeros(0, U))


def _items(benchmark: DataFrame) -> DataFrame:
    """Classes of equal items: cls, words (joined by one space), ids, n."""

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in chunks(batch):
                w = split(b.column("text"), ALNUM, True, hashes=False)
                texts = [b" ".join(w.word(i) for i in range(w.first[d], w.first[d + 1])).decode() for d in range(b.num_rows)]
                yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array(texts, pa.string()), pa.array(np.diff(w.first), pa.int32())], ["item_id", "words", "n"])

    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(normal, "item_id string, words string, n int").where("n > 0")
    ids = F.coalesce("item_id", F.lit("null"))
    return rows.groupBy("words", "n").agg(F.sort_array(F.collect_list(ids)).alias("ids")).withColumn("cls", F.md5(F.col("words").cast("binary")))


def _item_fingerprints(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in chunks(batch, "words"):
                w = split(b.column("words"), ALNUM, True)
                n = np.diff(w.first)
                cls, at, fp = [], [], []
                for k in range(1, SPAN + 1):  # items of one length, SPAN for all that are longer, at a time
                    own = np.flatnonzero(n == k if k < SPAN else n >= k)
                    if len(own):
                        part = split(b.column("words").take(pa.array(own)), ALNUM, True)
                        where, f = fingerprints(part, [k] if k < SPAN else [])
                        if k < SPAN:
                            keep = np.arange(len(f)) >= len(f) - len(own)
                            where, f = where[keep], f[keep]
                        cls.append(own[part.doc[where]])
                        fp.append(f)
                del at
                if cls:
                    yield pa.RecordBatch.from_arrays([b.column("cls").take(pa.array(np.concatenate(cls))), pa.array(np.concatenate(fp).view(np.int64))], ["cls", "fp"])

    return classes.select("cls", "words").mapInArrow(run, "cls string, fp long").distinct()


def _candidates(docs: DataFrame, bits: np.ndarray, lengths: list[int]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in chunks(batch):
                w = split(b.column("text"), ALNUM, True)
                at, fp = fingerprints(w, lengths)
                hit = in_bitmap(bits, fp)
                doc, fp = w.doc[at[hit]], fp[hit]
                order = np.argsort(doc, kind="stable")
                own = np.searchsorted(doc[order], np.arange(b.num_rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(own, pa.int32()), pa.array(fp[order].view(np.int64)))
                texts = b.column("text").take(pa.array(np.arange(b.num_rows), mask=np.diff(own) == 0))  # null where nothing is left
                yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("doc_id"), pa.array(np.diff(w.first), pa.int64()), lists, texts.cast(pa.string())], ["rid", "doc_id", "n_words", "fps", "text"])

    return docs.mapInArrow(run, "rid long, doc_id long, n_words long, fps array<long>, text string")


def verify(words: list[bytes], items: list[list[bytes]]) -> tuple[np.ndarray, list[bool]]:
    """Which words lie in an occurrence of some item's window; which items have one."""
    hit, has = np.zeros(len(words), bool), [False] * len(items)
    windows: dict[int, dict[tuple[bytes, ...], list[int]]] = {}
    for i, item in enumerate(items):
        k = min(SPAN, len(item))
        for j in range(len(item) - k + 1):
            windows.setdefault(k, {}).setdefault(tuple(item[j : j + k]), []).append(i)
    for k, known in windows.items():
        begin = {t[0] for t in known}
        for p in range(len(words) - k + 1):
            if words[p] in begin and (found := known.get(tuple(words[p : p + k]))):
                hit[p : p + k] = True
                for i in found:
                    has[i] = True
    return hit, has


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in chunks(batch):
            w = split(b.column("text"), ALNUM, True, hashes=False)
            rows = []
            for d, items in enumerate(b.column("items").to_pylist()):
                words = [w.word(i) for i in range(w.first[d], w.first[d + 1])]
                hit, has = verify(words, [x["words"].encode().split(b" ") for x in items])
                ids = sorted(i for x, y in zip(items, has, strict=True) if y for i in x["ids"])
                rows.append({"rid": b.column("rid")[d].as_py(), "n_hit": int(hit.sum()), "ids": ids})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("rid", pa.int64()), ("n_hit", pa.int64()), ("ids", pa.list_(pa.string()))]))


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """rid (row), doc_id, n_words, n_hit and ids of the items found, for every document; th2 (of the text) where any are."""
    spark = documents.sparkSession
    classes = materialise(_items(benchmark), "items")
    lengths = [r["n"] for r in classes.where(F.col("n") < SPAN).select("n").distinct().collect()]  # 9 at most
    prints = materialise(_item_fingerprints(classes), "prints")
    # Written once, so the row numbers stay as they are.
    docs = documents.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = materialise(_candidates(docs, bitmap(prints, F.col("fp")), sorted(lengths)), "candidates")
    pairs = found.where(F.size("fps") > 0).select("rid", F.explode(F.array_distinct("fps")).alias("fp")).join(prints, "fp").select("rid", "cls").distinct()
    items = pairs.join(classes, "cls").groupBy("rid").agg(F.collect_list(F.struct("words", "ids")).alias("items"))
    checked = found.where(F.size("fps") > 0).select("rid", "text").join(items, "rid").mapInArrow(_verified, "rid long, n_hit long, ids array<string>")
    out = found.select("rid", "doc_id", "n_words", text_keys(F.col("text"))["th2"].alias("th2")).join(checked, "rid", "left")
    return out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "ids": F.coalesce("ids", F.array().cast("array<string>"))})


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of documents that have no window of an item. All columns stay as they are."""
    keys = text_keys(F.col("text"))
    names = fresh(documents, "th1", "th2")
    # Equal texts have equal verdicts, so a text's hash finds them again.
    found = contamination(documents.select(keys["th1"].alias("doc_id"), "text"), benchmark).where("n_hit > 0")
    found = found.select(F.col("doc_id").alias(names[0]), F.col("th2").alias(names[1])).distinct()
    return documents.withColumns(dict(zip(names, keys.values(), strict=True))).join(found, names, "left_anti").drop(*names)
