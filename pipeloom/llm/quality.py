"""Quality rules with risk-controlled thresholds.

Counts of each text give five statistics. Each has a scale of integer levels: level 0 up to
what prose may show at most (LEAST), then even steps; a document's level is the highest of its five.
A stratum (band of n_words) has one cutoff, which all five rules share: a document is rejected at that
level or above. So the cutoffs of a stratum lie on one path, fixed beforehand, from the loosest (63)
to the strictest (1). (RISK and the scales were set with a look at the labelled rows of sf0.01 and sf0.1, so
on those two the bound below isn't one on fresh data.)

The cutoff is chosen on the labelled good documents of the stratum that pass the base rule: along the
path, a cutoff is accepted while the hypothesis "the rules together reject RISK of the good documents
or more" is refuted by the exact binomial test, P(Bin(n, RISK) <= rejected) <= DELTA / STRATA; that is
the upper Clopper-Pearson bound lying below RISK. Testing stops at the first cutoff that fails (fixed
sequence, so one level serves all cutoffs of a stratum), and DELTA is split over the strata
(Bonferroni). With probability 1 - DELTA no stratum loses more than RISK of its good documents to the
rules. That takes ln(DELTA / STRATA) / ln(1 - RISK) = 162 good labels in a stratum at least; one with
fewer gets no cutoff and loses none.

Counts are taken in tasks from whole texts; the labelled documents are counted by
stratum and level, at most 3 * 64 rows, which alone reach the driver.

Defined results: null, empty and blank texts have zero counts and fail the base rule;
a document with several labels is good if all of them say so, labels without quality or
id count nothing; rows are judged each on its own; without labels only the base rule
rejects; an empty table gives an empty table. Whole texts count, of any length: each is
one row of one task, its words as numbers. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import materialise
from ._words import SPACED, chunks, grams, raw, split

RISK, DELTA, LEVELS = 0.025, 0.05, 64
BANDS = (150, 600)  # strata: below, between, from
_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines")

#: Statistic of each rule in thousandths, the higher, the worse; from LEAST on it counts, at MOST it has the highest level.
RULES: dict[str, tuple[str, int, int]] = {  # statistic, LEAST, MOST
    "symbols": ("1000 * n_symbols DIV greatest(word_chars, 1)", 10, 400),
    "dup_lines": ("1000 * n_dup_lines DIV greatest(n_lines, 1)", 300, 1000),
    "repeats": ("1000 * n_repeat_words DIV greatest(n_words, 1)", 200, 500),
    "long_words": ("1000 * word_chars DIV greatest(n_words, 1)", 7000, 15000),
    "upper": ("1000 * n_upper DIV greatest(word_chars, 1)", 100, 1000),
}


def repeated(hashes: np.ndarray) -> int:
    """Words that lie in 3-word windows found twice or more."""
    if len(hashes) < 4:
        return 0
    _, inverse, count = np.unique(grams(hashes, 3), return_inverse=True, return_counts=True)
    twice = count[inverse] > 1
    if not twice.any():
        return 0
    at = np.zeros(len(hashes), bool)
    for k in range(3):
        at[k : k + len(twice)] |= twice
    return int(at.sum())


def lines(text: str) -> tuple[int, int]:
    """Lines with a word, and those of them equal to an earlier one."""
    full = [x for x in text.split("\n") if x.encode().split()]
    return len(full), len(full) - len(set(full))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in chunks(batch):
            texts = b.column("text")
            w = split(texts, SPACED)
            data, off = raw(texts)
            total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[off])  # noqa: B023, E731
            inside = SPACED[data]
            both = np.array([lines(t or "") for t in texts.to_pylist()], np.int64).reshape(-1, 2)
            repeat = [repeated(w.hash[lo:hi]) for lo, hi in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)]
            cols = [np.diff(w.first), total(inside & (data & 0xC0 != 0x80)), total(_SYMBOLS[data]), both[:, 1], repeat, total((data >= 65) & (data <= 90)), both[:, 0]]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, pa.int64()) for c in cols]], ["doc_id", *_COUNTS])


def counts(documents: DataFrame) -> DataFrame:
    """doc_id, the counts, stratum and base_failed of every row."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = docs.mapInArrow(_counts, "doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS))
    stratum = F.when(F.col("n_words") < BANDS[0], 0).when(F.col("n_words") < BANDS[1], 1).otherwise(2)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumns({"stratum": stratum, "base_failed": failed})


def levels() -> dict[str, str]:
    """SQL of each rule's level."""
    return {k: f"least({LEVELS - 1}, greatest(0, {x} - {lo}) * {LEVELS} DIV {hi - lo})" for k, (x, lo, hi) in RULES.items()}


def level() -> Column:
    return F.expr(f"greatest({', '.join(levels().values())})").cast("int")


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), summed from the term of k down until terms add nothing."""
    if k >= n:
        return 1.0
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    out, peak = term, n * p
    for i in range(k, 0, -1):
        term *= i * (1 - p) / ((n - i + 1) * p)
        out += term
        if i < peak and term < 1e-18 * out:
            break
    return min(1.0, out)


def refuted(rejected: int, n: int, risk: float, delta: float) -> bool:
    """Whether n good documents, so many of them rejected, refute that RISK of them or more are. A binomial's median is
    the next integer to its mean at most, so from there on the chance is a half or more and needs no sum."""
    return n > 0 and rejected < math.ceil(n * risk) and binomial_cdf(rejected, n, risk) <= delta < 0.5


def cutoff(found: dict[int, int], risk: float, delta: float) -> int:
    """Least level from which the rules may reject; found: good documents by level. LEVELS: they reject none."""
    n, rejected, best = sum(found.values()), 0, LEVELS
    for cut in range(LEVELS - 1, 0, -1):
        rejected += found.get(cut, 0)
        if not refuted(rejected, n, risk, delta):
            break
        best = cut
    return best


def cutoffs(counted: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> dict[int, int]:
    """Cutoff of each stratum."""
    good = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q")).where("q = 1")
    seen = counted.where("NOT base_failed").join(good, "doc_id", "left_semi")
    found: dict[int, dict[int, int]] = {s: {} for s in range(len(BANDS) + 1)}
    for r in seen.groupBy("stratum", level().alias("level")).count().collect():
        found[r["stratum"]][r["level"]] = r["count"]
    return {s: cutoff(v, risk, delta / len(found)) for s, v in found.items()}


def judge(documents: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The counts of every row with base_failed and kept."""
    counted = materialise(counts(documents), "counts")
    rejects = F.lit(False)
    for s, cut in cutoffs(counted, labels, risk, delta).items():
        if cut < LEVELS:
            rejects |= (F.col("stratum") == s) & (level() >= cut)
    return counted.withColumn("kept", ~F.col("base_failed") & ~rejects)


def digest(judged: DataFrame) -> DataFrame:
    return judged.select("doc_id", *_COUNTS[:5], "base_failed", "kept")


def _oracle() -> str:
    word = r"'[^\x20\x09-\x0D]+'"
    tail = "sum(exp(lgamma(n + 1) - CASE WHEN i > 0 THEN lgamma(i + 1) ELSE 0 END - CASE WHEN n > i THEN lgamma(n - i + 1) ELSE 0 END + i * ln({p}) + (n - i) * ln(1 - {p})))".format(p=RISK)
    steps = ", ".join(f"greatest(0, {x.replace('DIV', '//')} - {lo}) * {LEVELS} // {hi - lo}" for x, lo, hi in RULES.values())
    return rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {word}) AS ws FROM documents),
grams AS (SELECT doc_id, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(3) t(k) GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, {word}) GROUP BY doc_id),
c AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
        length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_upper, coalesce(n_lines, 0)::BIGINT AS n_lines
      FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN ln USING (doc_id)),
f AS (SELECT *, CASE WHEN n_words < {BANDS[0]} THEN 0 WHEN n_words < {BANDS[1]} THEN 1 ELSE 2 END AS stratum, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
lv AS (SELECT *, least({LEVELS - 1}, greatest({steps})) AS level FROM f),
good AS (SELECT stratum, level FROM lv JOIN (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1) USING (doc_id) WHERE NOT base_failed),
tried AS (SELECT stratum, cut, count(*) AS n, count(*) FILTER (level >= cut) AS k FROM good, range(1, {LEVELS}) t(cut) GROUP BY stratum, cut),
tested AS (SELECT stratum, cut, (SELECT {tail} FROM range(k + 1) u(i)) <= {DELTA / (len(BANDS) + 1)} AS refuted FROM tried),
cuts AS (SELECT stratum, min(cut) AS cut FROM (SELECT *, bool_and(refuted) OVER (PARTITION BY stratum ORDER BY cut DESC) AS ok FROM tested) WHERE ok GROUP BY stratum)
SELECT doc_id, {", ".join(_COUNTS[:5])}, base_failed, NOT base_failed AND coalesce(level < cut, true) AS kept FROM lv LEFT JOIN cuts USING (stratum)
"""


ORACLE = _oracle()
