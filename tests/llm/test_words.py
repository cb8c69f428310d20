from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from pipeloom.llm import _words

from .helpers import lower

TEXTS = st.lists(st.none() | st.text(alphabet="ab Z\t\n\r\x0b\x1c.é中😀1_", max_size=30), max_size=8)


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.booleans())
def test_words_are_those_of_the_patterns(texts, down):
    for kind, pattern in ((_words.SPACED, r"[^\x20\x09-\x0D]+"), (_words.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        if kind is _words.ALNUM and not down:
            continue
        w = _words.split(pa.array(texts, pa.string()), kind, down)
        got = [[w.word(i).decode() for i in range(w.first[d], w.first[d + 1])] for d in range(len(texts))]
        assert got == [re.findall(pattern, lower(t or "") if down else t or "") for t in texts]
        known: dict[bytes, int] = {}
        for i in range(len(w.start)):
            assert known.setdefault(w.word(i), int(w.hash[i])) == w.hash[i]
        assert len(set(known.values())) == len(known)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.integers(1, 40))
def test_grams_agree_exactly_where_words_do(words, k):
    h = _words.numbers(4, 9)[np.array(words)]
    g = _words.grams(h, k)
    assert len(g) == max(0, len(words) - k + 1)
    for i in range(len(g)):
        for j in range(i):
            assert (g[i] == g[j]) == (words[i : i + k] == words[j : j + k])


def test_chunks_cover_the_batch():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * n for n in (0, 5, 100, 1, 1, 0, 200)]})
    parts = list(_words.chunks(batch, limit=10))
    assert [x for p in parts for x in p.column("text").to_pylist()] == batch.column("text").to_pylist()
    assert all(p.num_rows == 1 or sum(map(len, p.column("text").to_pylist())) <= 10 for p in parts)
    assert list(_words.chunks(batch.slice(0, 0))) == []
