"""Substring dedup by fixed-block anchors.

A window is WINDOW consecutive words of one document; a word is removed if a window over
it occurs at any other place of any document, the same one included.

1. Index: every document is cut into blocks of ANCHOR = (WINDOW + 1) / 2 words, side by
   side. Any window holds a whole block, so if two windows agree, each holds ANCHOR words
   that are a block of the other's document.
2. Probe: every run of ANCHOR words of every document looks for a block elsewhere. Blocks
   and probes meet by hash: each chunk of text sends one packed array to each bucket of
   hashes (32 bits of hash, and the place in units of CELL words), so hot passages cost a
   row a chunk, not one an occurrence; runs that recur within a chunk are hits at once and
   are sent on as one block. Places of hits come back.
3. Extend: every window that holds a hit is a candidate; candidates of distinct texts meet
   again by 96-bit hashes of whole windows. Those with a second place are the repeats; what
   they cover are the maximal exact repeats, which are removed.

Texts are told apart by 128-bit hashes. Copies of a text repeat as a whole, so they need no
second look, but stand as a place for the windows of other texts. Only texts with a hit are
shuffled, once each.

The number of buckets grows with the bytes of text, one for each BUCKET_BYTES up to MAX_BUCKETS (8 TB); beyond,
buckets grow, to 95 MB of text at 100 TB, since a chunk should send more than an entry to each. A bucket is what
a task holds at a time; a task has one of them, or from MAX_TASKS buckets on several that come sorted, one after the other.

Defined results: null, empty and blank texts have no words; documents of fewer than WINDOW
words lose none; equal rows are places of their own, so both lose all their windows; rows
without id count like any other; an empty table gives an empty table. Whole texts count, of any length:
a text is part of one chunk. Only doc_id and text are looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words
from ._store import bitmap, materialise, may_match
from ._words import SPACED, U, chunks, grams, mix, split, within
from .near_dedup import by_group, text_keys

WINDOW = 35
CELL = 16
BUCKET_BYTES = 8 << 20  # of text for each bucket
MAX_BUCKETS, MAX_TASKS = 1 << 20, 1 << 15
_DOCS = 1 << 15  # of a chunk, so that an index and a flag fit into 16 bits
_FLAG = np.uint16(1 << 15)
_PARTS = ("docs", "doc", "lo", "hi", "key", "key2", "hit_doc", "hit_lo", "hit_hi")
_BLOB = "bucket int, chunk long, " + ", ".join(f"{c} binary" for c in _PARTS)


def _few(batch: pa.RecordBatch, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Chunks of a batch: the more buckets, the larger, up to four times, so that arrays stay long."""
    for b in chunks(batch, limit=_words.CHUNK * min(4, max(1, n_buckets // 256))):
        for at in range(0, b.num_rows, _DOCS):
            yield b.slice(at, _DOCS)


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (x & 0xFFFF).astype(np.uint16), (x >> 16).astype(np.uint16)


def _packed(keys: np.ndarray, bucket: np.ndarray, n_buckets: int, doc: np.ndarray, flag: np.ndarray, place: np.ndarray, key: list[np.ndarray], hit: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    """A row for each bucket that has entries: the keys of the documents in it and the entries; hits go along with one of them.

    keys: an array of 8-byte columns for each document of the chunk."""
    order = np.argsort(bucket, kind="stable")
    bucket, doc, flag, place = bucket[order], doc[order], flag[order], place[order]
    key = [k[order] for k in key]
    chunk = int(mix(keys.view(U)).sum().view(np.int64))
    own = int(keys[0, 0].view(np.uint64) % np.uint64(n_buckets)) if len(hit[0]) else -1
    rows: dict[str, list] = {c: [] for c in ("bucket", "chunk", *_PARTS)}
    for b in np.union1d(bucket, [own] if own >= 0 else []).astype(int):
        s = slice(*np.searchsorted(bucket, [b, b + 1]))
        hd, hp = hit if b == own else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        used, at = np.unique(np.concatenate([doc[s], hd]), return_inverse=True)
        n = s.stop - s.start
        values = [keys[used], at[:n].astype(np.uint16) | (flag[s] * _FLAG), *_halves(place[s]), key[0][s], key[1][s] if len(key) > 1 else np.zeros(0, np.uint32), at[n:].astype(np.uint16), *_halves(hp)]
        rows["bucket"].append(b)
        rows["chunk"].append(chunk)
        for c, v in zip(_PARTS, values, strict=True):
            rows[c].append(np.ascontiguousarray(v).tobytes())
    return pa.RecordBatch.from_arrays([pa.array(rows["bucket"], pa.int32()), pa.array(rows["chunk"], pa.int64()), *[pa.array(rows[c], pa.binary()) for c in _PARTS]], ["bucket", "chunk", *_PARTS])


class _Unpacked:
    """Entries of all rows of a bucket."""

    def __init__(self, pdf: pd.DataFrame, columns: int, wide: bool) -> None:
        cat = lambda c, t: np.frombuffer(b"".join(pdf[c]), t)
        self.keys = cat("docs", np.int64).reshape(-1, columns)
        self.chunk = pdf["chunk"].to_numpy()
        self.base = np.cumsum([0, *[len(x) // (8 * columns) for x in pdf["docs"]]])
        base = self.base[:-1]
        place = lambda d, lo, hi: (cat(d, np.uint16), cat(lo, np.uint16).astype(np.int64) | cat(hi, np.uint16).astype(np.int64) << 16, np.repeat(base, [len(x) // 2 for x in pdf[d]]))
        doc, self.place, at = place("doc", "lo", "hi")
        self.flag, self.doc = doc >= _FLAG, (doc & ~_FLAG).astype(np.int64) + at
        doc, self.hit_place, at = place("hit_doc", "hit_lo", "hit_hi")
        self.hit_doc = doc.astype(np.int64) + at
        self.key = cat("key", np.uint64 if wide else np.uint32)
        self.key2 = cat("key2", np.uint32)

    def answer(self, hits: np.ndarray) -> pd.DataFrame:
        """A row for each chunk with hits: the keys of its documents that have any, how many, and their places."""
        doc, place = np.concatenate([self.doc[hits], self.hit_doc]), np.concatenate([self.place[hits], self.hit_place])
        both = np.unique((doc << 32) | place)
        doc, place = both >> 32, (both & 0xFFFFFFFF).astype(np.int32)
        used, first, count = np.unique(doc, return_index=True, return_counts=True)
        d, p = np.searchsorted(used, self.base), np.searchsorted(doc, self.base)
        rows = [i for i in range(len(self.chunk)) if d[i] < d[i + 1]]
        parts = {"docs": lambda i: self.keys[used[d[i] : d[i + 1]]], "counts": lambda i: count[d[i] : d[i + 1]].astype(np.int32), "places": lambda i: place[p[i] : p[i + 1]]}
        return pd.DataFrame({"chunk": self.chunk[rows], **{c: pd.Series([f(i).tobytes() for i in rows], dtype=object) for c, f in parts.items()}})


_ANSWER = "chunk long, docs binary, counts binary, places binary"
_ANSWER_TYPES = pa.schema([("chunk", pa.int64()), ("docs", pa.binary()), ("counts", pa.binary()), ("places", pa.binary())])


def _merged(columns: int):
    """The answers of all buckets to a chunk, as a row for each of its documents with hits."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = np.frombuffer(b"".join(pdf["docs"]), np.int64).reshape(-1, columns)
        doc = np.repeat(np.arange(len(keys)), np.frombuffer(b"".join(pdf["counts"]), np.int32))
        known, number = np.unique(keys, axis=0, return_inverse=True)
        both = np.unique((number.reshape(-1)[doc] << 32) | np.frombuffer(b"".join(pdf["places"]), np.int32))
        first = np.searchsorted(both >> 32, np.arange(1, len(known)))
        places = np.split((both & 0xFFFFFFFF).astype(np.int32), first)
        return pd.DataFrame({**{f"th{i + 1}": known[:, i] for i in range(columns)}, "places": pd.Series(places, dtype=object)})

    return run


def _groups(ordered: list[np.ndarray]) -> np.ndarray:
    """Number of the group of equal neighbours that each sorted entry is in."""
    new = np.zeros(len(ordered[0]), bool)
    for k in ordered:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)


def _local(order: np.ndarray, group: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries recur in the chunk, and the entry that stands for each of these groups: one with a mark if there is any."""
    count = np.bincount(group)
    many = np.zeros(len(order), bool)
    many[order] = count[group] > 1
    by_mark = np.lexsort((~mark[order], group))
    first = np.unique(group[by_mark], return_index=True)[1]
    stands = order[by_mark][first][count > 1]
    return many, stands


def _anchors(n_buckets: int, window: int):
    size = (window + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _few(batch, n_buckets):
                w = split(b.column("text"), SPACED)
                long = np.repeat(np.diff(w.first) >= window, np.diff(w.first))
                ok = within(w.first, size, len(w.hash))
                at = np.flatnonzero(ok & long[: len(ok)])
                if not len(at):
                    continue
                g = grams(w.hash, size)[at]
                doc = w.doc[at]
                place = at - w.first[doc]
                block = place % size == 0
                cell = place // CELL
                order = np.argsort(g)
                many, stands = _local(order, _groups([g[order]]), block)
                send = np.flatnonzero(~many)
                send = np.sort(np.concatenate([send, stands[block[stands]]]))
                bucket = ((g[send] >> U(32)) * U(n_buckets)) >> U(32)
                hit = np.unique((doc[many] << 32) | cell[many])
                keys = b.column("th1").to_numpy().reshape(-1, 1)
                yield _packed(keys, bucket.astype(np.int64), n_buckets, doc[send], block[send], cell[send], [g[send].astype(np.uint32)], (hit >> 32, hit & 0xFFFFFFFF))

    return run


def _probe(pdf: pd.DataFrame) -> pd.DataFrame:
    """Cells with a run that is a block elsewhere."""
    x = _Unpacked(pdf, 1, False)
    blocks, count = np.unique(x.key[x.flag], return_counts=True)
    if len(blocks):
        at = np.minimum(np.searchsorted(blocks, x.key), len(blocks) - 1)
        hits = (blocks[at] == x.key) & (count[at] - x.flag > 0)
    else:
        hits = np.zeros(len(x.key), bool)
    return x.answer(hits)


def _windows(n_buckets: int, window: int):
    size = (window + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _few(batch, n_buckets):
                w = split(b.column("text"), SPACED)
                n = len(w.hash)
                if n < window:
                    continue
                cells = b.column("cells")
                doc = np.repeat(np.arange(b.num_rows), pc.list_value_length(cells).to_numpy())
                start = w.first[doc] + cells.flatten().to_numpy().astype(np.int64) * CELL
                change = np.zeros(n + 1, np.int64)  # windows that hold a run of a hit cell
                np.add.at(change, np.maximum(start - (window - size), w.first[doc]), 1)
                np.add.at(change, np.minimum(start + CELL, w.first[doc + 1]), -1)
                ok = within(w.first, window, n)
                at = np.flatnonzero((np.cumsum(change)[: len(ok)] > 0) & ok)
                if not len(at):
                    continue
                g, g2 = grams(w.hash, window)[at], (grams(w.hash, window, 0x9FB21C651E98DF25)[at] >> U(32)).astype(np.uint32)
                doc = w.doc[at]
                place = at - w.first[doc]
                copied = b.column("copies").to_numpy()[doc] > 1
                order = np.lexsort((g2, g))
                many, stands = _local(order, _groups([g[order], g2[order]]), copied)
                send = np.flatnonzero(~many)
                flag = copied | many
                send = np.sort(np.concatenate([send, stands]))
                bucket = ((g[send] >> U(32)) * U(n_buckets)) >> U(32)
                own = many & ~copied
                keys = np.stack([b.column("th1").to_numpy(), b.column("th2").to_numpy()], 1)
                yield _packed(keys, bucket.astype(np.int64), n_buckets, doc[send], flag[send], place[send], [g[send], g2[send]], (doc[own], place[own]))

    return run


def _recurring(pdf: pd.DataFrame) -> pd.DataFrame:
    """Places of windows that have another one; those of flagged entries are known to."""
    x = _Unpacked(pdf, 2, True)
    order = np.lexsort((x.key2, x.key))
    hits = np.zeros(len(order), bool)
    if len(order):
        group = _groups([x.key[order], x.key2[order]])
        again = (np.bincount(group) > 1) | (np.bincount(group, x.flag[order]) > 0)
        hits[order] = again[group]
    return x.answer(hits & ~x.flag)


def _by_bucket(blobs: DataFrame, n_buckets: int, answer: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """answer for the rows of each bucket; buckets are dealt evenly to as many tasks, MAX_TASKS at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in by_group(batches, ("bucket",)):
            bounds = np.flatnonzero(np.diff(group, prepend=-1, append=group[-1] + 1))
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                yield pa.RecordBatch.from_pandas(answer(table.slice(lo, hi - lo).to_pandas()), _ANSWER_TYPES, preserve_index=False)

    tasks = min(n_buckets, MAX_TASKS)
    dealt = blobs.repartitionById(tasks, F.col("bucket") % tasks)
    return dealt.sortWithinPartitions("bucket").mapInArrow(run, _ANSWER)


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _info(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words = [t.encode().split() if t else [] for t in b.column("text").to_pylist()]  # bytes part at the same characters as the pattern
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th1"), b.column("th2"), pa.array(map(len, words), pa.int64()), pa.array(map(_sha, words), pa.string())], ["doc_id", "th1", "th2", "n_words", "sha"])


def covered(n: int, places: np.ndarray, window: int) -> np.ndarray:
    """Which of n words lie in windows that begin at these places."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, places, 1)
    np.add.at(change, places + window, -1)
    return np.cumsum(change)[:n] > 0


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            removed, sha, kept = [], [], []
            for text, places in zip(b.column("text").to_pylist(), b.column("places"), strict=True):
                words = text.encode().split()
                gone = covered(len(words), np.asarray(places.values, np.int64), window)
                left = [x for x, y in zip(words, gone.tolist(), strict=True) if not y]
                removed.append(int(gone.sum())), sha.append(_sha(left)), kept.append(b" ".join(left).decode())
            yield pa.RecordBatch.from_arrays([b.column("th1"), b.column("th2"), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())], ["th1", "th2", "removed", "cut_sha", "kept_text"])

    return run


def repeats(documents: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, th1, th2, n_words, sha, copies) and, for the texts with repeats, (th1, th2, places of the repeated windows, text).

    Texts with copies above 1 are repeated as a whole and not among the latter."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumns(text_keys(F.col("text")))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_buckets = int(min(MAX_BUCKETS, max(8, size // BUCKET_BYTES)))
    info = materialise(docs.mapInArrow(_info, "doc_id long, th1 long, th2 long, n_words long, sha string"), "info")
    copies = materialise(info.groupBy("th1", "th2").agg(F.count("*").alias("copies")).where("copies > 1"), "copies")
    anchors = docs.select("th1", "text").mapInArrow(_anchors(n_buckets, window), _BLOB)
    cells = _by_bucket(anchors, n_buckets, _probe).groupBy("chunk").applyInPandas(_merged(1), "th1 long, places array<int>")
    # Copies of a text have the same cells in most chunks, so most of them go before the shuffle.
    hits = cells.distinct().groupBy("th1").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("places")))).alias("cells"))
    hits = materialise(hits, "hits")
    texts = may_match(docs.select("th1", "th2", "text"), "th1", bitmap(hits, F.col("th1"))).dropDuplicates(["th1", "th2"])
    texts = texts.join(hits, "th1").join(copies, ["th1", "th2"], "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    texts = materialise(texts.select("th1", "th2", "copies", "cells", "text"), "texts")
    found = _by_bucket(texts.mapInArrow(_windows(n_buckets, window), _BLOB), n_buckets, _recurring)
    found = found.groupBy("chunk").applyInPandas(_merged(2), "th1 long, th2 long, places array<int>")  # a text is in one chunk
    cut = found.join(texts.where("copies = 1").select("th1", "th2", "text"), ["th1", "th2"])
    return info.join(copies, ["th1", "th2"], "left").withColumn("copies", F.coalesce("copies", F.lit(1))), cut


def remove(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and th1, th2 of every row."""
    rows, cut = repeats(documents, window)
    cut = cut.mapInArrow(_cut(window), "th1 long, th2 long, removed long, cut_sha string, kept_text string").drop("kept_text")
    whole = (F.col("copies") > 1) & (F.col("n_words") >= window)
    out = rows.join(cut, ["th1", "th2"], "left")
    removed = F.when(whole, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0).cast("long")))
    sha = F.when(whole, F.lit(_sha([]))).otherwise(F.coalesce("cut_sha", "sha"))
    return out.select("doc_id", "n_words", removed.alias("n_removed"), sha.alias("kept_sha256"), "th1", "th2")


def digest(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_words", "n_removed", "kept_sha256")
