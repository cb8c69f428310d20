"""Near-dedup, decontamination and substring dedup against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from pipeloom.llm import decontamination, near_dedup, substring_dedup

from .helpers import ODD, documents, lower, rows, spaced


def noisy(seed: int, n: int = 60) -> list[str]:
    """Texts with copies, drifting near copies, shared passages and repeats."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["Éa", "B1", "x-y"]
    passage = [rng.choice(vocab) for _ in range(50)]
    out, drift = [], [rng.choice(vocab) for _ in range(120)]
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.choice([0, 2, 3, 9, 34, 35, 36, 120, 300]))]
        kind = i % 6
        if kind == 1:
            words[len(words) // 2 : len(words) // 2] = passage[rng.randrange(10) :]
        elif kind == 2 and out:
            words = rng.choice(out).split(" ")
        elif kind == 3:
            drift = list(drift)
            for _ in range(3):
                drift[rng.randrange(len(drift))] = rng.choice(vocab)
            words = drift
        elif kind == 4:
            words = words[:40] * 3
        out.append(rng.choice([" ", "  ", "\n"]).join(words))
    return out + ODD


def brute_groups(texts: list[str | None], shingle: int = 4, percent: int = 80) -> list[tuple]:
    sets = []
    for t in texts:
        w = spaced(t, True)
        sets.append({tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(i, len(s), find(i), find(i) == i) for i, s in enumerate(sets)]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("blocks", [None, (4, 6, 2)])
def test_near_dedup(spark, monkeypatch, seed, blocks):
    if blocks:  # many blocks, crowded buckets and pivots on little data
        for name, value in zip(("BLOCK", "CROWD", "PIVOTS"), blocks):
            monkeypatch.setattr(near_dedup, name, value)
    texts = noisy(seed)
    out = near_dedup.digest(near_dedup.groups(documents(spark, texts)))
    assert rows(out, "doc_id", "n_shingles", "component_id", "kept") == sorted(brute_groups(texts), key=str)


def test_near_dedup_ids_and_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (3, "q"), (3, "r"), (None, ""), (None, None)], "doc_id long, text string")
    found = rows(near_dedup.digest(near_dedup.groups(df)), "doc_id", "component_id", "kept")
    assert found == sorted([(None, 7, False), (7, 7, True), (7, 7, True), (3, 3, True), (3, 3, True), (None, None, True), (None, None, True)], key=str)
    left = rows(near_dedup.deduplicated(df))
    assert left == sorted([(7, "a b c d e"), (3, "q"), (3, "r"), (None, ""), (None, None)], key=str)
    assert near_dedup.digest(near_dedup.groups(df.limit(0))).count() == 0


def test_components_of_chains_stars_and_random_edges(spark):
    rng = random.Random(1)
    for edges in ([(i, i + 1) for i in range(70)], [(99, i) for i in range(50)], [(rng.randrange(90), rng.randrange(90)) for _ in range(60)], [(1, 1)], []):
        root = {x: x for e in edges if e[0] != e[1] for x in e}

        def find(x: int) -> int:
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            if a != b:
                root[find(a)] = find(b)
        got = {r["k"]: r["comp"] for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert set(got) == set(root) and all(got[got[x]] == got[x] for x in got)
        assert {frozenset(x for x in got if got[x] == c) for c in got.values()} == {frozenset(x for x in root if find(x) == c) for c in map(find, root)}


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(3)
    errors = []
    for n in (1, 3, 40, 1000):
        for _ in range(5):
            x = rng.integers(0, 1 << 63, 2 * n, dtype=np.int64).view(np.uint64)
            a, b = np.unique(x[: n + n // 2]), np.unique(x[n // 2 :])
            s, t = near_dedup.sketch(a), near_dedup.sketch(b)
            assert (s < near_dedup._FULL).all()
            both, all_ = near_dedup.similarity(a, b)
            errors.append(abs((s == t).mean() - both / all_))
    assert max(errors) < 0.2 and np.mean(errors) < 0.06


def brute_contamination(texts: list[str | None], items: list[tuple]) -> list[tuple]:
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    windows: dict[tuple, set[int]] = {}
    for k, (_, t) in enumerate(items):
        w = words(t)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(k)
    out = []
    for d, t in enumerate(texts):
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if ks := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= ks
        ids = sorted("null" if items[k][0] is None else str(items[k][0]) for k in found)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("seed", [4, 5])
def test_decontamination(spark, seed):
    texts = noisy(seed, 40)
    rng = random.Random(seed)
    items = [(i, " ".join(re.split(r"\s+", rng.choice([t for t in texts if t]))[k : k + n])) for i, (k, n) in enumerate([(0, 12), (3, 10), (5, 30), (0, 1), (2, 4), (1, 9), (0, 300)] * 3)]
    items += [(None, items[0][1]), (50, items[0][1].upper()), (51, None), (52, "..."), (53, "new words only in this item of ten words and more")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontamination.digest(decontamination.contamination(documents(spark, texts), bench))
    assert rows(out) == sorted(brute_contamination(texts, items), key=str)
    dirty = {r[0] for r in brute_contamination(texts, items) if r[5]}
    assert sorted(r["doc_id"] for r in decontamination.clean(documents(spark, texts), bench).collect()) == [i for i in range(len(texts)) if i not in dirty]


def test_decontamination_empty_tables(spark):
    docs, bench = documents(spark, ["a b", None]), spark.createDataFrame([], "item_id long, text string")
    assert [r["contaminated"] for r in decontamination.digest(decontamination.contamination(docs, bench)).collect()] == [False, False]
    assert decontamination.contamination(docs.limit(0), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


def brute_repeats(texts: list[str | None], window: int) -> list[tuple]:
    words = [spaced(t) for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for d, w in enumerate(words):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((d, len(w), sum(gone), hashlib.sha256(" ".join(x for x, y in zip(w, gone) if not y).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("window", [35, 6, 5])
@pytest.mark.parametrize("chunk", [1 << 22, 700])
def test_substring_dedup(spark, monkeypatch, window, chunk):
    from pipeloom.llm import _words

    monkeypatch.setattr(_words, "CHUNK", chunk)
    texts = noisy(window)
    out = substring_dedup.digest(substring_dedup.remove(documents(spark, texts).repartition(3), window))
    assert rows(out) == sorted(brute_repeats(texts, window), key=str)


def test_substring_dedup_empty(spark):
    assert substring_dedup.digest(substring_dedup.remove(documents(spark, ODD).limit(0))).count() == 0


def test_pipeline_stage_takes_five_words(spark):
    """Scattered edits that leave 0.8 of the four-word shingles but not of the five-word ones keep both texts."""
    pipeline = pytest.importorskip("corpus_pipeline")
    words = [f"v{i}" for i in range(300)]
    edited = [f"new{i}" if i % 37 == 20 else w for i, w in enumerate(words)]
    texts = [" ".join(words), " ".join(edited), *noisy(5)]
    four, five = brute_groups(texts[:2]), brute_groups(texts[:2], 5)
    assert not four[1][3] and five[1][3]
    kept = [i for i, n, _, first in brute_groups(texts, 5) if first or not n]
    assert [r[0] for r in sorted(pipeline.drop_near_copies(spark, documents(spark, texts), "").select("doc_id").collect())] == kept


def test_sketches_miss_less_than_bands():
    """Of pairs at 0.8: the chance to agree in fewer coordinates than LEAST asks for, and to share no band."""
    least = math.ceil(near_dedup.LEAST * near_dedup.COORDS)
    below = sum(math.comb(near_dedup.COORDS, i) * 0.8**i * 0.2 ** (near_dedup.COORDS - i) for i in range(least))
    assert below < (1 - 0.8**near_dedup.ROWS) ** (near_dedup.COORDS // near_dedup.ROWS)
