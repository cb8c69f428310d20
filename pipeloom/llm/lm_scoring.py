"""Language-model scores: a log-bilinear neural model trained by noise-contrastive estimation.

Tokens are words, A-Z in lower case, then one end of text. Units of the model: the end,
the most frequent words, and CLASSES classes of all other words by their last two
bytes. The words that are units grow with the vocabulary, one for each TYPES different words, from
LEAST_HEADS up to MOST_HEADS. The model predicts a unit from the two before it:
score(w | u1, u2) = (R[u1] C1 + R[u2] C2) . Q[w] + b[w], and a word of a class by its
share of the class, (c + 0.1) / (sum of c + 0.1 (words + 1)), the last 0.1 for any
unseen word. Scores are normalised: the products of R C1 and R C2 with Q are two tables
over pairs of units, and the product of their exponentials is that of the normalisers of all
pairs of contexts, so each token's log-probability is three look-ups.

Counts of all training tokens come from one aggregation by word hash (64 bits). Then texts are split
once more and written as units, which training and scoring read. Training
covers all training texts: each task runs stochastic NCE over its own from common
parameters, and the tasks' parameters are averaged by tokens, first over a sixteenth of
the texts, then from there over all.

For the scores, counts of the COMMON most frequent words are broadcast (a fixed size);
all other words of a document join the full table of counts.

Defined results: a null text is empty, which is one token, the end; a document without id
is scored, but neither learned from nor held out; rows are scored each on its own; with
nothing to learn from, N and V are 0, base_score is that of the formula and score that of
the untrained model; an empty table gives an empty table. Texts count whole, of any length: a text is one
array in one task. Only doc_id and text are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import least_counts, materialise
from ._words import SPACED, Words, chunks, split

LEAST_HEADS, MOST_HEADS, TYPES = 384, 1920, 200
CLASSES, DIM = 127, 32
COMMON = 1 << 18
BATCH, NOISE, RATE = 1024, 64, 0.006
END = np.int64(-1)  # stands for the end where words stand by their hash
PIECES = 64  # of the parameters, each added up over all tasks as they come


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 10


def word_class(w: Words) -> np.ndarray:
    last = w.data[w.end - 1].astype(np.int64)
    before = np.where(w.end - w.start > 1, w.data[np.maximum(w.end - 2, 0)], 0).astype(np.int64)
    return (last * 31 + before * 131 + (before >> 3)) % CLASSES


class Model:
    """Parameters, and the words that are units: 0 is the end, then come the heads, then the classes."""

    def __init__(self, heads: np.ndarray, noise: np.ndarray) -> None:
        rng = np.random.default_rng(5)
        self.order = np.argsort(heads, kind="stable")
        self.heads, self.noise = heads[self.order], noise  # noise: share of each unit among the tokens
        small = lambda *n: rng.normal(0, 0.1, n).astype(np.float32)
        eye, n = np.eye(DIM, dtype=np.float32), len(noise)
        self.p = {"R": small(n, DIM), "C": np.stack([eye, 0.5 * eye]), "Q": small(n, DIM), "b": np.log(noise).astype(np.float32)}

    def units(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Unit of each token (words, then an end, text by text), and where the words are among them."""
        h = w.hash.view(np.int64)
        own = word_class(w) + 1 + len(self.heads)
        if len(self.heads):
            at = np.minimum(np.searchsorted(self.heads, h), len(self.heads) - 1)
            own = np.where(self.heads[at] == h, self.order[at] + 1, own)
        out = np.zeros(len(h) + len(w.first) - 1, np.int64)
        where = np.arange(len(h)) + w.doc
        out[where] = own
        return out, where

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores by (u1, w) and (u2, w) and log normalisers by (u1, u2)."""
        p = self.p
        s1, s2 = (p["R"] @ p["C"][0]) @ p["Q"].T + p["b"], (p["R"] @ p["C"][1]) @ p["Q"].T
        top1, top2 = s1.max(1, keepdims=True), s2.max(1, keepdims=True)
        z = np.log(np.maximum(np.exp(s1 - top1) @ np.exp(s2 - top2).T, np.finfo(np.float32).tiny)) + top1 + top2.T
        return s1, s2, z


def contexts(units: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The unit before each token and the one before that; the end where there is none. first: where texts begin."""
    u1, u2 = np.zeros_like(units), np.zeros_like(units)
    u1[1:], u2[2:] = units[:-1], units[:-2]  # texts lie side by side, and each ends with an end
    u2[first] = 0
    return u1, u2


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Units of all texts of a column, and where each text begins."""
    n = np.asarray(pc.binary_length(column), np.int64) // 2
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).astype(np.int64), np.cumsum(n) - n


class Trainer:
    """NCE by Adam, one pass over what it is given."""

    def __init__(self, model: Model) -> None:
        self.model, self.p, self.t, self.tokens = model, {k: v.copy() for k, v in model.p.items()}, 0, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        self.rng = np.random.default_rng(11)
        self.cdf = np.cumsum(model.noise / model.noise.sum())
        self.offset = np.log(NOISE * model.noise).astype(np.float32)

    def learn(self, w: np.ndarray, u1: np.ndarray, u2: np.ndarray) -> None:
        self.tokens += len(w)
        order = self.rng.permutation(len(w))
        for i in range(0, len(w), BATCH):
            at = order[i : i + BATCH]
            self.step(w[at], u1[at], u2[at])

    def step(self, w: np.ndarray, u1: np.ndarray, u2: np.ndarray) -> None:
        p = self.p
        a1, a2 = p["R"][u1], p["R"][u2]
        r = a1 @ p["C"][0] + a2 @ p["C"][1]
        n_units = len(self.cdf)
        noise = np.minimum(np.searchsorted(self.cdf, self.rng.random(NOISE)), n_units - 1)
        sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
        qw, qn = p["Q"][w], p["Q"][noise]
        true = 1 - sigmoid(np.einsum("ij,ij->i", r, qw) + p["b"][w] - self.offset[w])
        false = -sigmoid(r @ qn.T + p["b"][noise] - self.offset[noise])
        n = np.float32(len(w))
        true, false = (true / n).astype(np.float32), (false / n).astype(np.float32)
        dr = true[:, None] * qw + false @ qn
        g = {"C": np.stack([a1.T @ dr, a2.T @ dr]), "R": _scatter(u1, dr @ p["C"][0].T, n_units) + _scatter(u2, dr @ p["C"][1].T, n_units)}
        g["Q"] = _scatter(w, true[:, None] * r, n_units) + _scatter(noise, false.T @ r, n_units)
        g["b"] = (np.bincount(w, true, n_units) + np.bincount(noise, false.sum(0), n_units)).astype(np.float32)
        self.t += 1
        for k, x in g.items():
            self.m[k] += 0.1 * (x - self.m[k])
            self.v[k] += 0.01 * (x * x - self.v[k])
            rate = RATE / (1 + self.t / 2000) ** 0.5
            p[k] += rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-6)


def _scatter(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows by their place among n."""
    order = np.argsort(at, kind="stable")
    begin = np.flatnonzero(np.diff(at[order], prepend=-1))
    out = np.zeros((n, rows.shape[1]), np.float32)
    out[at[order[begin]]] = np.add.reduceat(rows[order], begin, axis=0)
    return out


def _vocabulary(docs: DataFrame) -> DataFrame:
    """h, cls and count c of every distinct token; the end has h = END."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in chunks(batch):
                w = split(b.column("text"), SPACED, True)
                h, first, n = np.unique(w.hash.view(np.int64), return_index=True, return_counts=True)
                cls = word_class(w)[first]
                cols = [np.append(h, END), np.append(cls, -1).astype(np.int32), np.append(n, b.num_rows)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["h", "cls", "c"])

    return docs.select("text").mapInArrow(run, "h long, cls int, c long").groupBy("h", "cls").agg(F.sum("c").alias("c"))


def _common(words: DataFrame) -> pd.DataFrame:
    """The most frequent words, COMMON at most: all those with a count from some bound on, in order of count."""
    bound = least_counts(words.withColumn("all", F.lit(0)), "all", "c", {0: COMMON}).get(0)
    found = words.where(F.col("c") >= bound if bound is not None else F.lit(False)).toArrow().to_pandas()
    return found.sort_values(["c", "h"], ascending=[False, True], ignore_index=True)


def _trained(docs: DataFrame, model: Model) -> Model:
    """One round: every task learns from the units of its texts, and the results are averaged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = Trainer(shared.value)
        for b in batches:
            units, first = unpacked(b.column("units"))
            trainer.learn(units, *contexts(units, first))
        if trainer.tokens:
            parts = np.array_split(_flat(trainer.p) * trainer.tokens, PIECES)
            yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([trainer.tokens] * PIECES), pa.array([x.tobytes() for x in parts], pa.binary())], ["piece", "tokens", "params"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for b in batches:
            for piece, tokens, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = np.frombuffer(data, np.float64)
                own = sums.setdefault(piece, [0, np.zeros_like(x)])
                own[0] += tokens
                own[1] = own[1] + x
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([t for t, _ in sums.values()], pa.int64()), pa.array([x.tobytes() for _, x in sums.values()], pa.binary())], ["piece", "tokens", "params"])

    kind = "piece int, tokens long, params binary"
    rows = docs.select("units").mapInArrow(run, kind).repartition(PIECES, "piece").mapInArrow(add, kind).collect()  # PIECES rows, the parameters once
    if rows:
        rows.sort(key=lambda r: r["piece"])
        whole, at = np.concatenate([np.frombuffer(r["params"], np.float64) for r in rows]) / rows[0]["tokens"], 0
        for k in sorted(model.p):
            n = model.p[k].size
            model.p[k] = whole[at : at + n].reshape(model.p[k].shape).astype(np.float32)
            at += n
    return model


def _flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel().astype(np.float64) for k in sorted(p)])


def score(documents: DataFrame) -> DataFrame:
    docs = documents.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    train = docs.where(remainder(F.col("doc_id")) != 0)
    vocab = materialise(_vocabulary(train), "vocabulary")
    total, types = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    common = _common(vocab.where(F.col("h") != END))
    heads = common.iloc[: min(MOST_HEADS, max(LEAST_HEADS, types // TYPES))]
    ends = vocab.where(F.col("h") == END).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    by_class = {r["cls"]: (r["c"], r["n"]) for r in vocab.where(F.col("h") != END).groupBy("cls").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()}  # CLASSES rows
    counts = np.array([by_class.get(i, (0, 0)) for i in range(CLASSES)], float)
    np.subtract.at(counts, heads["cls"].to_numpy(int), np.stack([heads["c"], np.ones(len(heads))], 1))
    by_unit = np.concatenate([[ends], heads["c"], counts[:, 0]]).astype(float) + 0.1
    model = Model(heads["h"].to_numpy(np.int64), by_unit / by_unit.sum())
    n_heads = len(heads)
    in_class = np.zeros(len(by_unit))  # what a word of a class gives to the score besides log10(c + 0.1)
    in_class[1 + n_heads :] = -np.log10(counts[:, 0] + 0.1 * (counts[:, 1] + 1))
    order = np.argsort(common["h"].to_numpy(np.int64))
    known = (common["h"].to_numpy(np.int64)[order], common["c"].to_numpy(np.int64)[order])
    shared = docs.sparkSession.sparkContext.broadcast((model, in_class, known, int(ends)))  # COMMON counts at most

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, in_class, (hs, cs), ends = shared.value
        for batch in batches:
            for b in chunks(batch):
                w = split(b.column("text"), SPACED, True)
                units, where = model.units(w)
                n = np.diff(w.first) + 1
                first = np.cumsum(n) - n  # of each text's tokens, one at least
                h = w.hash.view(np.int64)
                at = np.minimum(np.searchsorted(hs, h), max(0, len(hs) - 1))
                found = hs[at] == h if len(hs) else np.zeros(len(h), bool)
                c = np.where(found, cs[at], 0) if len(hs) else np.zeros(len(h), np.int64)
                logs = np.zeros(len(units))
                logs[where] = np.where(found, np.log10(c + 0.1), 0)
                tail = in_class[units]
                tail[where] += np.where(units[where] > len(model.heads), logs[where], 0)
                is_known = np.zeros(len(units), np.int64)
                is_known[where] = found
                last = first + n - 1
                logs[last] += np.log10(ends + 0.1)
                is_known[last] = ends > 0
                rare = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(~found)])[w.first], pa.int32()), pa.array(h[~found]))
                sums = [np.add.reduceat(x, first) for x in (is_known, logs, tail)]
                data = pa.py_buffer(units.astype(np.uint16).tobytes())
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(np.append(2 * first, 2 * len(units)).tobytes()), data]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("doc_id"), pa.array(n), *map(pa.array, sums), packed, rare], ["rid", "doc_id", "n_tokens", "known", "logs", "tail", "units", "rare"])

    counted = materialise(docs.mapInArrow(count, "rid long, doc_id long, n_tokens long, known long, logs double, tail double, units binary, rare array<long>"), "units")
    if total:
        learned = counted.where(remainder(F.col("doc_id")) != 0)
        model = _trained(learned.where(F.pmod(F.xxhash64("doc_id"), F.lit(16)) == 0), model)
        model = _trained(learned, model)
    tables = docs.sparkSession.sparkContext.broadcast(model.tables())  # numbers for each pair of units

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s1, s2, z = tables.value
        for b in batches:
            units, first = unpacked(b.column("units"))
            u1, u2 = contexts(units, first)
            lm = np.add.reduceat((s1[u1, units] + s2[u2, units] - z[u1, u2]) / np.log(10.0), first) if len(first) else np.zeros(0)
            rest = b.drop_columns(["units"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(lm, pa.float64())], [*rest.schema.names, "lm"])

    fields = "rid long, doc_id long, n_tokens long, known long, logs double, tail double"
    scored = counted.drop("rare").mapInArrow(look_up, f"{fields}, lm double")
    log_c = F.log10(F.coalesce("c", F.lit(0)) + 0.1)
    words = counted.select("rid", F.explode("rare").alias("h")).groupBy("rid", "h").count()
    others = words.join(vocab.select("h", "c"), "h", "left").groupBy("rid").agg(F.sum(F.col("count") * log_c).alias("more_logs"), F.sum(F.when(F.col("c") > 0, F.col("count"))).alias("more_known"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = scored.join(others, "rid", "left")
    return out.select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        "n_tokens",
        (F.col("known") + zero("more_known")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + zero("more_logs") - F.col("n_tokens") * F.log10(F.lit(total + 0.1 * (types + 1)))).alias("base_score"),
        (F.col("lm") + F.col("tail") + zero("more_logs")).alias("score"),
    )
