"""Language identification by words first, then shorter and shorter character n-grams.

A word is a run of letters in lower case. A word of the model scores each language by
its log frequency there; an unseen word scores by its character n-grams, word edges
marked: by the mean log frequencies of its known n-grams of the longest length that has
any. A document's language has the greatest sum; its score is the posterior under equal
priors.

The classifier is fitted on a bounded sample of the labelled rows: about SAMPLE_DOCS
documents a language, dealt by a hash of the id, with whole texts. It keeps the most frequent words and n-grams of
each length, all from some count on, at most WORDS and NGRAMS, fewer of both where many languages would
put the model above CELLS numbers, so what is broadcast has a fixed size. At most MAX_LANGS languages are learned.

Texts are cut into words, words and n-grams looked up, and scores added up as arrays; words and n-grams stand by
64-bit hashes.

Defined results: a text that is null or has no letter, or all texts where nothing is
labelled, get 'und' with score 0; ties go to the language first in order; rows without
id are predicted but not learned from; rows are predicted each on its own; an empty
table gives an empty table. Whole texts count, of any length: a text is one row of one task, its
words added up in slices. Input columns stay; one that bears a result's name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ._store import fresh, least_counts, materialise
from ._words import SPACED, U, Words, chunks, grams, mix, split, within

SAMPLE_DOCS = 4000
WORDS, NGRAMS, LONGEST = 50_000, 20_000, 4
CELLS = 1 << 24  # numbers of the model
MAX_LANGS = 1000
UNDETERMINED = "und"
_SLICE = 1 << 21  # numbers in hand when a text's words are added up


def letters(texts: pa.Array) -> pa.Array:
    """Texts in lower case, with one space for whatever lies between runs of letters."""
    return pc.replace_substring_regex(pc.utf8_lower(texts.cast(pa.string()).fill_null("")), r"\PL+", " ")


def edged(w: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words at these places, with an edge before and after each, and where each begins."""
    size = w.end[at] - w.start[at] + 2
    begin = np.cumsum(size) - size
    inner = np.arange(int(size.sum())) - np.repeat(begin, size)
    data = w.data[np.minimum(np.repeat(w.start[at], size) + np.maximum(inner, 1) - 1, max(0, len(w.data) - 1))]
    data[begin] = data[begin + size - 1] = ord("_")
    codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(U)
    return codes, np.append(np.cumsum((data & 0xC0) != 0x80)[begin] - 1, len(codes))


def ngrams(codes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams within words, and the number of each one's word."""
    ok = np.flatnonzero(within(first, n, len(codes)))
    return grams(mix(codes), n)[ok], np.repeat(np.arange(len(first) - 1), np.diff(first))[ok]


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(number of the language, n, hash, count) of each chunk of text: n = 0 for words."""
    for batch in batches:
        for b in chunks(batch):
            w = split(letters(b.column("text")), SPACED)
            number = b.column("number").to_numpy()[w.doc]
            for lang in np.unique(number).tolist():
                own = np.flatnonzero(number == lang)
                h, first, count = np.unique(w.hash[own], return_index=True, return_counts=True)
                codes, begin = edged(w, own[first])
                found = [(0, h, count)]
                for n in range(1, LONGEST + 1):
                    g, word = ngrams(codes, begin, n)
                    g, at = np.unique(g, return_inverse=True)
                    found.append((n, g, np.bincount(at, count[word], len(g)).astype(np.int64)))
                for n, g, c in found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), lang, np.int32)), pa.array(np.full(len(g), n, np.int32)), pa.array(g.view(np.int64)), pa.array(c)], ["number", "n", "h", "c"])


class Model:
    """Languages, hashes of the known words (0) and n-grams in order, and their log frequencies by language."""

    def __init__(self, langs: list[str], hashes: list[np.ndarray], logs: list[np.ndarray]) -> None:
        self.langs, self.hashes, self.logs = langs, hashes, logs

    def known(self, n: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of these hashes are known, and their rows."""
        have = self.hashes[n]
        if not len(have):
            return np.zeros(len(h), bool), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(have, h), len(have) - 1)
        there = have[at] == h
        return there, at[there]

    def backoff(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """For each word the mean row of its longest known n-grams; zeros if it has none."""
        out, todo = np.zeros((len(first) - 1, len(self.langs)), np.float32), np.ones(len(first) - 1, bool)
        for n in range(LONGEST, 0, -1):
            g, word = ngrams(codes, first, n)
            there, rows = self.known(n, g)
            word = word[there]
            rows, word = rows[todo[word]], word[todo[word]]
            begin = np.flatnonzero(np.diff(word, prepend=-1))
            if len(begin):
                count = np.diff(begin, append=len(word))
                out[word[begin]] = np.add.reduceat(self.logs[n][rows], begin, axis=0) / count[:, None]
                todo[word[begin]] = False
        return out

    def scores(self, w: Words, at: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Rows of the words at these places, whose hashes are h."""
        out = np.zeros((len(h), len(self.langs)), np.float32)
        there, rows = self.known(0, h)
        out[there] = self.logs[0][rows]
        rest = np.flatnonzero(~there)
        step = max(1, _SLICE // (16 * max(1, len(self.langs))))
        for lo in range(0, len(rest), step):
            part = rest[lo : lo + step]
            out[part] = self.backoff(*edged(w, at[part]))
        return out


def fit(documents: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    labelled = documents.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = labelled.groupBy("lang").count().orderBy("lang").limit(MAX_LANGS + 1).collect()
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    langs = [r["lang"] for r in sizes]
    if not langs:
        return Model([], [], [])
    share = documents.sparkSession.createDataFrame([(r["lang"], i, min(1 << 20, -(-(sample_docs << 20) // r["count"]))) for i, r in enumerate(sizes)], "lang string, number int, share long")
    sample = labelled.select("lang", "text", "doc_id").join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 20)) < F.col("share"))
    counted = sample.select("number", "text").mapInArrow(_count, "number int, n int, h long, c long").groupBy("number", "n", "h").agg(F.sum("c").alias("c"))
    counted = materialise(counted, "grams")
    totals = counted.groupBy("n", "h").agg(F.sum("c").alias("total"))
    fits = min(1.0, CELLS / (len(langs) * (WORDS + LONGEST * NGRAMS)))
    chosen = F.lit(False)
    for n, bound in least_counts(totals, "n", "total", {n: int((NGRAMS if n else WORDS) * fits) for n in range(LONGEST + 1)}).items():
        chosen |= (F.col("n") == n) & (F.col("total") >= bound)
    found = counted.join(totals.where(chosen), ["n", "h"]).select("n", "h", "number", "c").toArrow()  # CELLS rows at most
    kind, h, number, c = (found.column(x).to_numpy() for x in ("n", "h", "number", "c"))
    hashes, logs = [], []
    for n in range(LONGEST + 1):
        own = kind == n
        have, at = np.unique(h[own].view(U), return_inverse=True)
        seen = np.zeros((len(have), len(langs)))
        seen[at, number[own]] = c[own]
        hashes.append(have)
        logs.append(np.log((seen + 0.5) / (seen.sum(0) + 0.5 * max(1, len(have)))).astype(np.float32))
    return Model(langs, hashes, logs)


def totals_of(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of words, and sums of scores by language, a row a text."""
    w = split(letters(texts), SPACED)
    h, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
    rows = model.scores(w, first, h)
    n, doc = np.diff(w.first), w.doc
    out = np.zeros((len(n), len(model.langs)))
    step = max(1, _SLICE // max(1, len(model.langs)))
    for lo in range(0, len(inverse), step):
        part = doc[lo : lo + step]
        begin = np.flatnonzero(np.diff(part, prepend=-1))
        out[part[begin]] += np.add.reduceat(rows[inverse[lo : lo + step]].astype(np.float64), begin, axis=0)
    return n, out


def predict(documents: DataFrame, model: Model, pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """documents with the predicted language and its score."""
    df = documents.drop(pred_col, score_col)
    langs = np.array([*model.langs, UNDETERMINED], object)
    shared = df.sparkSession.sparkContext.broadcast(model)  # CELLS numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in chunks(batch):
                pred, score = np.full(b.num_rows, len(langs) - 1), np.zeros(b.num_rows)
                if len(langs) > 1:
                    n, total = totals_of(b.column("text"), shared.value)
                    some = np.flatnonzero(n)
                    total = total[some]
                    pred[some] = total.argmax(1)
                    score[some] = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs[pred], pa.string()), pa.array(score)], [*b.schema.names, pred_col, score_col])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(pred_col, StringType()), StructField(score_col, DoubleType())]))


def digest(documents: DataFrame) -> DataFrame:
    model = fit(documents)
    docs = documents.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return predict(docs, model).select("doc_id", "held_out", "lang_pred", "score")


def identified(documents: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents whose language is known: not 'und', and of a score of ``least`` or more. All columns stay as they are."""
    pred, score = fresh(documents, "pred", "score")
    out = predict(documents, fit(documents), pred, score)
    return out.where((F.col(pred) != UNDETERMINED) & (F.col(score) >= least)).drop(pred, score)
