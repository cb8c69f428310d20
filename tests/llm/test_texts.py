"""Operators that judge each text: language ID, HTML, quality, tokens, language model, pipeline."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from pipeloom.llm import html_text, language_id, lm_scoring, near_dedup, quality, token_counts

from .helpers import CLASHES, ODD, clashing, documents, rows, spaced

SF = Path("/root/testdata/sf0.01")


# Language ID


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_language_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = language_id.digest(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(found) > 100 and np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found)
    assert {r["doc_id"] % 1 for r in found} and all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in found)


def test_language_backs_off_to_ngrams(spark):
    df = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("the thing then", "en"), ("über straße", "de")] * 20)], "doc_id long, text string, lang string")
    model = language_id.fit(df)
    assert model.langs == ["de", "en"]
    tests = ["the", "thens", "überstraß", "", None, "123 !", "qqq", "the the über"]
    out = language_id.predict(spark.createDataFrame(list(enumerate(tests)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in out[:6]] == ["en", "en", "de", "und", "und", "und"]
    assert out[3]["score"] == 0 and out[6]["lang_pred"] in ("de", "en")


def brute_language(rows: list[tuple]) -> list[tuple]:
    """Predictions of rows (doc_id, text, lang) by counts in plain Python, with all words and n-grams known."""
    found = lambda t: [w for w in re.split(r"[^a-zà-ÿß]+", (t or "").lower()) if w]
    runs = lambda w, n: [f"_{w}_"[i : i + n] for i in range(len(w) + 3 - n)]
    train = [(t, g) for i, t, g in rows if t is not None and g is not None and zlib.crc32(str(i).encode()) % 4 != 2]
    langs = sorted({g for _, g in train})
    counts = {(n, g): Counter() for n in range(5) for g in langs}
    for t, g in train:
        for w in found(t):
            counts[0, g][w] += 1
            for n in range(1, 5):
                counts[n, g].update(runs(w, n))
    known = {n: {x for g in langs for x in counts[n, g]} for n in range(5)}
    log = lambda n, g, x: math.log((counts[n, g][x] + 0.5) / (sum(counts[n, g].values()) + 0.5 * len(known[n])))

    def word(w: str, g: str) -> float:
        if w in known[0]:
            return log(0, g, w)
        for n in range(4, 0, -1):
            if have := [x for x in runs(w, n) if x in known[n]]:
                return sum(log(n, g, x) for x in have) / len(have)
        return 0.0

    out = []
    for i, t, _ in rows:
        total = [sum(word(w, g) for w in found(t)) for g in langs]
        best = max(range(len(langs)), key=lambda k: total[k])
        out.append((i, zlib.crc32(str(i).encode()) % 4 == 2, *(("und", 0.0) if not found(t) else (langs[best], 1 / sum(math.exp(x - total[best]) for x in total)))))
    return out


def test_language_by_brute_force(spark):
    rng = random.Random(12)
    parts = {"en": ["the", "th", "ing", "ed", "wh"], "de": ["der", "sch", "ung", "ß", "ü"], "fr": ["que", "é", "ment", "eau", "ç"], None: ["the", "que", "zz"]}
    data = []
    for i in range(200):
        lang = rng.choice(list(parts))
        words = ["".join(rng.choices(parts[lang] + rng.choice(list(parts.values()))[:1], k=rng.randrange(1, 4))) for _ in range(rng.randrange(0, 12))]
        data.append((i, rng.choice([None, *[rng.choice([" ", ", ", " 1-"]).join(words)] * 9]), lang))
    got = language_id.digest(spark.createDataFrame(data, "doc_id long, text string, lang string")).orderBy("doc_id").collect()
    for g, want in zip(got, brute_language(data)):
        assert (g["doc_id"], g["held_out"], g["lang_pred"]) == want[:3] and g["score"] == pytest.approx(want[3], abs=1e-4)


def test_language_model_stays_bounded(spark, monkeypatch):
    """With few numbers allowed, fewer words and n-grams are known, and unseen words still find their language."""
    monkeypatch.setattr(language_id, "CELLS", 3000)
    df = spark.createDataFrame([(i, " ".join(f"{'th' if i % 2 else 'sch'}{chr(97 + i % 26)}{chr(97 + j)}" for j in range(20)), "en" if i % 2 else "de") for i in range(200)], "doc_id long, text string, lang string")
    model = language_id.fit(df)
    assert sum(map(len, model.hashes)) * 2 <= 3000
    assert [r["lang_pred"] for r in language_id.predict(spark.createDataFrame([(1, "thqqq"), (2, "schqqq")], "doc_id long, text string"), model).orderBy("doc_id").collect()] == ["en", "de"]


def test_language_odd_tables(spark):
    df = documents(spark, ODD)
    out = language_id.digest(df)
    assert out.count() == len(ODD)
    blank = {r["doc_id"]: r for r in out.collect()}
    assert [blank[i]["lang_pred"] for i in (0, 1, 2, 5)] == ["und"] * 4
    nothing = language_id.digest(spark.createDataFrame([(1, "a", None), (None, "b", "en")], "doc_id long, text string, lang string"))
    assert {(r["lang_pred"], r["score"]) for r in nothing.collect()} == {("und", 0.0)}
    assert language_id.digest(df.limit(0)).count() == 0
    assert language_id.identified(df).columns == df.columns


# HTML


@pytest.mark.parametrize(
    "html,text",
    [
        (None, ""),
        ("", ""),
        ("plain  text\n here", "plain text here"),
        ("<p>a<p>b<div>c</div>d", "a\n\nb\n\nc\nd"),
        ("<ul><li>x<li>y<ol start=3><li>p<li>q</ol></ul>", "- x\n- y\n  3. p\n  4. q"),
        ("<table><tr><th>name<th>n<tr><td>longer<td>1<tr><td colspan=2>all</table>", "name   | n\nlonger | 1\nall"),
        ("<table>stray<tr><td>a</table>", "stray\n\na"),
        ("<b hidden>x</b><i style='display: NONE'>y</i><script>z</script><!-- c -->v<template>t</template>", "v"),
        ("<head><title>t</title></head><body>b", "b"),
        ("<pre>a\n  b</pre>c", "a\n  b\n\nc"),
        ("a<br>b<br/>c &amp; d &lt;", "a\nb\nc & d <"),
        ("<h1>T</h1>x<hr>y<img alt=pic><input type=submit value=go>", "T\n\nx\nypicgo"),
        ("<table><tr><td rowspan=2>A<td>B<tr><td>C</table>", "A | B\n  | C"),
        ("<table><tr><td>a<td rowspan=0>b<td>c<tr><td>d<td>e<tr><td>f<td>g</table>", "a | b | c\nd |   | e\nf |   | g"),
        ("<table><tr><td rowspan=2 colspan=2>x<td>1<tr><td>2<tr><td>p<td>q<td>3</table>", "x     | 1\n  |   | 2\np | q | 3"),
        ("<table><tr><td>漢字<td>1<tr><td>abcd<td>2<tr><td>e\u0301<td>3</table>", "漢字 | 1\nabcd | 2\ne\u0301    | 3"),
        ("<ol><li value=5>a<li>b<li value=-1>c<li value=x>d</ol>", "5. a\n6. b\n-1. c\n0. d"),
        ("<div style='visibility:hidden'>a<b style='visibility: visible'>b</b>c</div>d", "b\nd"),
        ("<div style='visibility:hidden'>a<table><tr><td>t<td style='visibility:visible'>u</table></div>", " | u"),
        ("<style>.h, p#i { display:none } @media print { b {display:none} } i.k{visibility:hidden} .h.on{display:block}</style><p class='x h'>a<p id=i>b<p>c<b>d</b><i class=k>e</i><p class='h on'>f", "cd\n\nf"),
        ("<svg><title>t</title><text>in svg</text></svg> <math><mi>x</mi></math>", "in svg x"),
        ("<input value=a> <input type=password value=b> <input placeholder=c> <textarea>d</textarea>", "a c d"),
        ("<div><div><p>a</div></span></p>b", "a\n\nb"),
        ("<dl><dt>k<dd>v<dt>l<dd>w</dl>", "k\n  v\nl\n  w"),
        ("</p>x</table>", "x"),
    ],
)
def test_rendering(html, text):
    assert html_text.extract(html) == text


def test_deep_and_broken_pages(spark):
    assert html_text.extract("<div>" * 5000 + "x" + "</b>" * 5000) == "x"
    assert "deep" in html_text.extract("<table><tr><td>" * 300 + "deep")
    df = spark.createDataFrame([(1, "<p>a", "old", 3), (2, None, "b", 4)], "page_id long, html string, text string, other int")
    out = html_text.extract_text(df)
    assert rows(out, "page_id", "other", "text") == [(1, 3, "a"), (2, 4, "")] and html_text.extract_text(df.limit(0)).count() == 0


def test_all_visible_words_are_there():
    rng = random.Random(1)
    for _ in range(50):
        words, html = [], []
        for i in range(30):
            tag = rng.choice(["p", "div", "span", "li", "td", "h2", "b", "ul", "table", "blockquote"])
            html.append(f"<{tag}> w{i} " + ("" if rng.random() < 0.4 else f"</{tag}>"))
            words.append(f"w{i}")
        assert sorted(re.findall(r"w\d+", html_text.extract("".join(html)))) == sorted(words)


# Quality


def brute_counts(text: str | None) -> tuple:
    w = spaced(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if spaced(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), failed


def test_quality_counts(spark):
    texts = ODD + ["a b c a b c a", "x\nx\n x\n\n\ny # | é", "l one\nl two\nl one\nl one " * 30, "q\x0cq q\tq q"]
    labels = spark.createDataFrame([(0, 1), (None, 1), (3, None)], "doc_id long, quality int")
    out = quality.digest(quality.judge(documents(spark, texts), labels)).orderBy("doc_id").collect()
    assert [tuple(r)[1:7] for r in out] == [brute_counts(t) for t in texts]
    assert all(r["kept"] != r["base_failed"] for r in out)
    assert quality.judge(documents(spark, texts).limit(0), labels).count() == 0


def test_quality_cutoffs_are_exact():
    for k, n, p in [(0, 10, 0.1), (3, 20, 0.3), (20, 20, 0.5)]:
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert quality.binomial_cdf(k, n, p) == pytest.approx(want)
    assert quality.cutoff({0: 1000}, 0.01, 0.01) == 1
    assert quality.cutoff({0: 1000, 30: 50}, 0.01, 0.01) == 31
    assert quality.cutoff({0: 100}, 0.01, 0.01) == quality.LEVELS and quality.cutoff({}, 0.01, 0.01) == quality.LEVELS
    n = 10**7
    assert quality.binomial_cdf(n // 100, n, 0.01) == pytest.approx(0.5, abs=0.01) and not quality.refuted(n // 100, n, 0.01, 0.4)


def test_quality_bounds_hold_in_each_stratum():
    """Over many draws of labels, the accepted cutoff loses more than the risk in a share delta of them at most, though it is near the risk."""
    rng, risk, delta = np.random.default_rng(8), 0.05, 0.1
    share = np.array([0.7, *[0.3 / (quality.LEVELS - 1)] * (quality.LEVELS - 1)])  # true share of good documents by level
    beyond = np.cumsum(share[::-1])[::-1]
    for n in (150, 1500):
        lost = []
        for _ in range(2000):
            cut = quality.cutoff(dict(enumerate(rng.multinomial(n, share).tolist())), risk, delta)
            lost.append(beyond[cut] if cut < quality.LEVELS else 0.0)
        assert np.mean(np.array(lost) > risk) <= delta and max(lost) > risk / 2


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_quality_rules_reject_by_cutoffs(spark, size):
    docs, labels = (spark.read.parquet(f"{SF.parent / size}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.judge(docs, labels).join(labels.select("doc_id", "quality"), "doc_id").where("NOT base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"), F.count("*").alias("n")).collect()
    kept = {r["quality"]: r["kept"] for r in out}
    assert kept[0] < 0.6 and kept[1] > 1 - quality.RISK


def test_quality_limits_false_rejections(spark):
    rng = random.Random(3)
    good = [" ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=3) + [f"w{rng.randrange(10**6)}" for _ in range(80)]) for _ in range(4000)]
    bad = [" ".join(f"### {rng.randrange(10**6)} $$$" for _ in range(28)) for _ in range(200)]
    labels = spark.createDataFrame([(i, int(i < 4000)) for i in range(4200)], "doc_id long, quality int")
    out = quality.judge(documents(spark, good + bad), labels, risk=0.05).collect()
    kept = {r["doc_id"]: r["kept"] for r in out}
    assert np.mean([not kept[i] for i in range(4000)]) <= 0.05 and not any(kept[i] for i in range(4000, 4200))


# Tokens


def test_tokens_equal_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(5)
    alphabet = list("abcdefghijklmnopqrstuvwxyzABCΣσςİßéÉ0123²½४'’.,!?-#$%&|<> \n\t\r\x0b\x1c\x1f\x85\xa0 中文한국👍🏽éŉﬃ‍﻿") + ["'s", "'ll", "<|startoftext|>", "<|endoftext|>", " the", "ing"]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(1, 40))) for _ in range(1500)] + ODD + ["a" * 3000, "abc" * 2000]
    out = token_counts.count_tokens(documents(spark, texts)).orderBy("doc_id").collect()
    want = [len(library.encode(t, add_special_tokens=False).ids) if t else 0 for t in texts]
    assert [r["n_tokens"] for r in out] == want
    assert [r["n_bytes"] for r in out] == [len((t or "").encode()) for t in texts]
    assert [r["over_limit"] for r in out] == [n > 2048 for n in want]
    assert token_counts.count_tokens(documents(spark, texts).limit(0)).count() == 0


@pytest.mark.parametrize("piece", [1, 7, 64, 1024])
def test_chunks_cut_at_any_byte(monkeypatch, piece):
    """Counts don't depend on where chunks are cut; cut within words, maps hold several states that lead to different counts."""
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    library, counts, rng = tokenizers.Tokenizer.from_file(path), token_counts.counter(path), random.Random(3)
    monkeypatch.setattr(token_counts, "PIECE", piece)
    words = ["internationalization", "the", "antidisestablishmentarianism", "straße", "x", "中文字", "naïve", "loooooooooong" * 30, "abc" * 400]
    for n in (0, 1, 5, 60):
        text = " ".join(rng.choices(words, k=n))
        assert token_counts.n_tokens(text, counts) == len(library.encode(text, add_special_tokens=False).ids)
    found = token_counts.chunks_of(["internationalization" * 3, "the"] * 20, counts, piece)
    assert len(found) > 1 and max(len({e for e in c.known.values()}) for c in found) > 1
    last = token_counts.scan(found)[-1]
    assert last[0] == (0, sum(counts[w] for w in ["internationalization" * 3, "the"] * 20))


# Language model


def brute_base(texts: list[str | None]) -> list[tuple]:
    tokens = [[*spaced(t, True), None] for t in texts]
    part = [zlib.crc32(str(i).encode()) % 10 for i in range(len(texts))]
    counts = Counter(x for t, p in zip(tokens, part) if p for x in t)
    n, v = sum(counts.values()), len(counts)
    return [(i, p == 0, len(t), sum(counts[x] > 0 for x in t), n, round(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t), 6)) for i, (t, p) in enumerate(zip(tokens, part))]


@pytest.mark.parametrize("common", [1 << 18, 5])
def test_lm_base_scores(spark, monkeypatch, common):
    monkeypatch.setattr(lm_scoring, "COMMON", common)
    monkeypatch.setattr(lm_scoring, "LEAST_HEADS", 384 if common > 384 else 3)
    rng = random.Random(6)
    texts = [" ".join(rng.choices([f"W{i}" for i in range(400)], weights=[1 / (i + 1) for i in range(400)], k=rng.randrange(0, 80))) for _ in range(80)] + ODD
    out = lm_scoring.score(documents(spark, texts)).collect()
    got = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out]
    assert sorted(got) == brute_base(texts) and all(r["score"] < 0 for r in out)


def test_lm_is_normalised_and_learns():
    n = 300
    model = lm_scoring.Model(np.arange(n - 1 - lm_scoring.CLASSES), np.full(n, 1 / n))
    rng = np.random.default_rng(1)
    w = np.zeros(200_000, np.int64)
    w[0::2], w[1::2] = rng.integers(1, 20, 100_000), 0
    w[1::2] = w[0::2] + 100  # the second of each pair follows from the first
    u1, u2 = lm_scoring.contexts(w, np.array([0]))
    trainer = lm_scoring.Trainer(model)
    trainer.learn(w, u1, u2)
    model.p = trainer.p
    s1, s2, z = model.tables()
    for i, j in ((5, 7), (0, 0), (119, 3)):
        assert np.exp(s1[i] + s2[j] - z[i, j]).sum() == pytest.approx(1, abs=1e-4)
    at = np.arange(1001, 3001, 2)
    assert (s1[u1[at], w[at]] + s2[u2[at], w[at]] - z[u1[at], u2[at]]).mean() > np.log(1 / n) + 3


def test_lm_scores_are_the_models(spark, monkeypatch):
    """Scores, word by word in plain Python from the trained model and the counts."""
    made = []
    train = lm_scoring._trained
    monkeypatch.setattr(lm_scoring, "_trained", lambda docs, model: made.append(train(docs, model)) or made[-1])
    monkeypatch.setattr(lm_scoring, "LEAST_HEADS", 20)
    rng = random.Random(4)
    texts = [" ".join(rng.choices([f"W{i}" for i in range(90)], weights=[1 / (i + 1) for i in range(90)], k=rng.randrange(0, 50))) for _ in range(60)] + ["unseen words é only", None]
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score(documents(spark, texts)).collect()}
    tokens = [spaced(t, True) for t in texts]
    counts = Counter(x for i, t in enumerate(tokens) if zlib.crc32(str(i).encode()) % 10 for x in t)
    unit = lambda x: _words_of(x)[0]
    model = made[-1]

    def _words_of(x: str) -> tuple[int, int]:
        from pipeloom.llm._words import SPACED, split

        w = split(__import__("pyarrow").array([x]), SPACED, True)
        return int(model.units(w)[0][0]), int(lm_scoring.word_class(w)[0])

    heads = {x for x in counts if unit(x) <= len(model.heads)}
    in_class = Counter()
    for x in set(counts) - heads:
        in_class[unit(x), "c"] += counts[x]
        in_class[unit(x), "n"] += 1
    p = {k: v.astype(np.float64) for k, v in model.p.items()}
    for i, t in enumerate(tokens):
        units, total = [unit(x) for x in t] + [0], 0.0
        for k, u in enumerate(units):
            before = [units[k - 1] if k > 0 else 0, units[k - 2] if k > 1 else 0]
            s = (p["R"][before[0]] @ p["C"][0] + p["R"][before[1]] @ p["C"][1]) @ p["Q"].T + p["b"]
            total += (s[u] - np.log(np.exp(s - s.max()).sum()) - s.max()) / math.log(10)
            if u > len(model.heads):
                total += math.log10((counts[t[k]] + 0.1) / (in_class[u, "c"] + 0.1 * (in_class[u, "n"] + 1)))
        assert got[i] == pytest.approx(total, abs=1e-3 * (1 + len(t)))


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_lm_beats_unigrams_on_held_out_rows(spark):
    held = lm_scoring.score(spark.read.parquet(f"{SF}/documents.parquet")).where("held_out").collect()
    n = sum(r["n_tokens"] for r in held)
    assert sum(r["score"] for r in held) / n > sum(r["base_score"] for r in held) / n + 0.15


def test_lm_nothing_to_learn(spark):
    out = lm_scoring.score(spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")).collect()
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) for r in out) == [(1, 0, 0, False), (3, 0, 0, False)]
    assert lm_scoring.score(documents(spark, ODD).limit(0)).count() == 0


# Pipeline


def test_pipeline_stages(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(7)
    en, de = ["the", "thing", "with", "this", "that", "from"], ["der", "die", "und", "nicht", "über", "straße"]
    make = lambda words, n: " ".join(rng.choice(words) + rng.choice(["", "er", "s"]) + str(rng.randrange(3)).replace("0", "") for _ in range(n))
    texts = [make(en if i % 2 else de, 60) for i in range(40)]
    item = " ".join(f"item{i}" for i in range(15))
    texts += [texts[0], texts[1].upper(), texts[2] + " " + item, "123 456", None]
    data = [(i, t, "en" if i % 2 else "de", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at, kept = docs, []
    for name, stage in pipeline.STAGES:
        out = stage(spark, at, str(tmp_path))
        path = str(tmp_path / name)
        out.write.parquet(path)
        at = spark.read.parquet(path)
        kept.append(sorted(r["doc_id"] for r in at.collect()))
        assert at.columns[:5] == docs.columns
    assert kept[0] == list(range(43)) and kept[1] == [*range(40), 42] and kept[2] == list(range(40))
    assert at.columns[5:] == ["slot", "shard"]
    words = sum(len(t.split()) for t in texts[:40])
    assert abs(sum(len(r["text"].split()) for r in at.collect()) - 1.5 * words) <= 3
    assert rows(pipeline.run(spark, str(tmp_path)), "doc_id", "text", "shard") == rows(at, "doc_id", "text", "shard")


@pytest.mark.parametrize("number", range(5))
def test_pipeline_stages_keep_all_columns(spark, tmp_path, number):
    """Nulls, very long texts, ties and repeated rows, and columns that bear the helpers' names: each row that stays is whole."""
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([(1, "an item that no document has in it at all"), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = clashing(spark, ["the first text of all", "another text here", *ODD, "long " + "words of a long text " * 60000, "the first text of all"])
    docs = docs.union(docs.where("doc_id IN (1, 3)"))
    name, stage = pipeline.STAGES[number]
    found = stage(spark, docs, str(tmp_path))
    assert found.columns[: len(docs.columns)] == docs.columns
    out = found.collect()
    assert out and all(r[c] == f"{c}-{r['doc_id']}" for r in out for c in CLASHES)
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_pipeline_of_an_empty_table(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    documents(spark, [None]).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_text_keys_tell_texts_apart(spark):
    df = documents(spark, ODD)
    keys = df.select(*[c.alias(n) for n, c in near_dedup.text_keys(df["text"]).items()]).distinct().count()
    assert keys == len({t or "" for t in ODD})
