from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pipeloom.llm import mixing, sharding

from .helpers import ODD, documents, rows, spaced


def test_table_is_balanced_and_stable():
    a, b = sharding.lookup_table(32, 4093), sharding.lookup_table(31, 4093)
    sizes = Counter(a).values()
    assert max(sizes) - min(sizes) <= 1 and len(sizes) == 32
    kept = sum(x == y for x, y in zip(a, b) if x != 31)
    assert kept > 0.8 * sum(x != 31 for x in a)
    with pytest.raises(ValueError):
        sharding.lookup_table(4, 4092)


def test_shards_by_brute_force(spark):
    df = spark.createDataFrame([(1, "a", 9), (1, "b", 8), (None, "c", 7), (-5, None, 6)], "doc_id long, text string, shard int")
    out = sharding.shard(df, n_shards=5, n_slots=101)
    table = sharding.lookup_table(5, 101)
    expected = [(d, t, table[int(hashlib.md5(("" if d is None else str(d)).encode()).hexdigest()[:15], 16) % 101]) for d, t, _ in df.collect()]
    assert rows(out, "doc_id", "text", "shard") == sorted(expected, key=str) and out.columns == ["doc_id", "text", "slot", "shard"]
    assert sharding.shard(df.limit(0)).count() == 0


def test_sainte_lague_equals_one_seat_at_a_time():
    rng = np.random.default_rng(1)
    for _ in range(60):
        size = rng.integers(0, 50, rng.integers(1, 8))
        size[0] = 7
        most = rng.integers(0, 12, len(size))
        seats = int(rng.integers(0, 40))
        want = np.zeros(len(size), int)
        for _ in range(min(seats, int(most.sum()))):
            q = np.where(want < most, size / (2 * want + 1), -1.0)
            want[int(q.argmax())] += 1
        got = mixing.sainte_lague(size, most, seats)
        assert got.sum() == want.sum() and (got <= most).all()
        if most.sum() > seats and (size > 0).all():
            assert sorted(size / (2 * got + 1)) == pytest.approx(sorted(size / (2 * want + 1)))


def test_quotas_of_shards_meet_the_words_by_whole_blocks():
    rng = np.random.default_rng(3)
    for _ in range(200):
        size, block = rng.integers(0, 40, rng.integers(1, 6)), int(rng.integers(1, 9))
        words = int(rng.integers(0, 2 * size.sum() + 1))
        for blocks in (words // block, -(-words // block)):
            got = mixing.shard_quotas(size, blocks, words, block, 2)
            assert got.sum() == words and (got >= 0).all() and (got <= 2 * size).all()


def test_targets():
    assert mixing.targets([10, 10, 10], [3, 1, 2], 1.5, 2).tolist() == pytest.approx([20.0, 8.3333333, 16.6666667])
    assert mixing.targets([0, 0], [3, 1], 1.5, 2).tolist() == [0, 0] and mixing.targets([], [], 1.5, 2).tolist() == []
    assert mixing.targets([5], [3], 1.5, 2).tolist() == [7.5]


@pytest.mark.parametrize("block,shard_words", [(1, 10), (4, 30), (512, 32768)])
def test_mix_meets_targets(spark, block, shard_words):
    rng = np.random.default_rng(2)
    texts = [" ".join(["w"] * int(n)) for n in rng.integers(0, 60, 150)] + ODD
    data = [(i % 100, t, None if i % 7 == 0 else f"s{i % 4 if i % 3 else 0}") for i, t in enumerate(texts)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(3)
    out = mixing.mix(df, block=block, shard_words=shard_words).cache()
    found = out.collect()
    assert len(found) == len(texts) and sorted(r["size"] for r in found) == sorted(len(spaced(t)) for t in texts)
    taken, target = defaultdict(int), {}
    for r in found:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    for s, n in taken.items():
        assert abs(n - target[s]) <= 0.5
    again = mixing.mix(df.repartition(5), block=block, shard_words=shard_words)
    assert rows(again, "doc_id", "size", "source", "taken") == rows(out, "doc_id", "size", "source", "taken")
    made = mixing.realise(df, block=block, shard_words=shard_words).collect()
    words = defaultdict(int)
    for r in made:
        words[r["source"]] += len(spaced(r["text"]))
    assert dict(words) == {s: n for s, n in taken.items() if n}
    assert mixing.mix(df.limit(0)).count() == 0


def test_blocks_are_equal_and_whole(spark):
    df = documents(spark, [" ".join(f"d{i}w{j}" for j in range(40)) for i in range(50)])
    made = mixing.realise(df, weights=(1,), budget=0.5, block=16, shard_words=400)
    assert sum(len(spaced(r["text"])) for r in made.collect()) == 1000 and made.columns == df.columns
