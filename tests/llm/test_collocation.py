"""Phrases against counting every n-gram in Python."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest

from stallwise.llm import collocation
from tests.llm.cases import awkward, empty

NAMES = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def counts(docs: list[tuple], most: int) -> tuple[Counter, Counter]:
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, most + 1) for i in range(len(words) - k + 1))
    return f, n


def brute(docs: list[tuple], most: int, threshold: int, percent: int, top: int) -> list[tuple]:
    f, n = counts(docs, most)
    candidates = {key: a for key, a in f.items() if a >= threshold and len(key[1]) > 1}
    rows = []
    for (lang, p), a in candidates.items():
        if any(x == lang and len(q) > len(p) and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (x, q), b in candidates.items()):
            continue
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        rows.append((lang, " ".join(p), a, left, right, n[lang], score))
    rows.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    ranks: Counter = Counter()
    out = []
    for r in rows:
        ranks[r[0]] += 1
        if ranks[r[0]] <= top:
            out.append((r[0], ranks[r[0]], *r[1:]))
    return out


def corpus(seed: int) -> list[tuple]:
    rng = np.random.default_rng(seed)
    words = ["the", "New", "york", "é", "\x00z", "a-b", "times", "of", "it's", "x"]
    out = []
    for _ in range(60):
        text = "".join(str(rng.choice(words)) + str(rng.choice([" ", "  ", "\t", ". ", ",", "\n", "\x0b", " "], p=[0.6, 0.1, 0.1, 0.05, 0.05, 0.04, 0.01, 0.05])) for _ in range(rng.integers(0, 60)))
        out.append((text + " new york times" * int(rng.integers(0, 4)), [None, "en", "de", "und"][rng.integers(0, 4)]))
    return [*out, (None, "en"), ("", None), ("...", "fr"), ("a a a a a a a a", "fr"), ("a a a a", "fr")]


@pytest.mark.parametrize("percent,top,threshold,counters", [(100, 2000, 3, 1 << 12), (60, 5, 3, 64), (100, 2000, 1, 8), (100, 2000, 9, 1 << 12)])
def test_equals_brute_force(spark, percent, top, threshold, counters):
    docs = corpus(threshold + percent)
    df = spark.createDataFrame(docs, "text string, lang string").repartition(5)
    got = collocation.collocations(df, threshold=threshold, percent=percent, top=top, max_counters=counters)
    assert got.columns == NAMES
    assert sorted(map(tuple, got.collect()), key=lambda r: (r[0], r[1])) == brute(docs, 5, threshold, percent, top)


def test_sketch_never_underestimates(spark):
    docs = corpus(1)
    df = spark.createDataFrame(docs, "text string, lang string").repartition(4).selectExpr("coalesce(text, '') AS text", "coalesce(lang, 'und') AS lang")
    grams = collocation.frequent_ngrams(df, threshold=4, max_counters=32)
    f, n = counts(docs, 5)
    got = {(r.lang, r.phrase): r.f for r in grams.collect() if r.k}
    assert got == {(lang, " ".join(p)): a for (lang, p), a in f.items() if a >= 4}
    wide = collocation.sketch_bits(df, range(1, 6), 4, 1 << 20)
    known = collocation._Hashes()
    passed = seen = 0
    for text, lang in docs:
        _, at, inside, hashes = collocation._grams([text], [lang or "und"], 5, known)
        for k, h in enumerate(hashes, 1):
            flat = collocation.tokens(text)
            for i in np.flatnonzero(collocation._together(inside, k)):
                a = f[lang or "und", tuple(w.decode() for w in flat[i : i + k])]
                ok = all(wide[r][int(c) >> 3] >> (int(c) & 7) & 1 for r in range(2) for c in collocation._cells(h[i : i + 1], r, 1 << 20))
                assert ok or a < 4
                seen, passed = seen + 1, passed + (ok and a < 4)
    assert passed < 0.05 * seen


def test_sparse_and_full_parts_add_up(spark, monkeypatch):
    """Many small sends of a task give what one gives."""
    docs = corpus(2) * 3
    df = spark.createDataFrame(docs, "text string, lang string").coalesce(2)
    one = sorted(collocation.frequent_ngrams(df, threshold=8).collect())
    monkeypatch.setattr(collocation, "HELD", 50)
    monkeypatch.setattr(collocation, "SLICE", 100)
    monkeypatch.setattr(collocation, "SURVIVORS", 5)
    monkeypatch.setattr(collocation, "BUCKET", 3)
    assert sorted(collocation.frequent_ngrams(df, threshold=8, max_counters=1 << 20).collect()) == one


def test_awkward_and_empty_tables(spark):
    assert collocation.collocations(empty(spark)).collect() == []
    got = {(r.lang, r.phrase): r.a for r in collocation.collocations(awkward(spark)).collect()}
    assert got["en", "words of a long text"] == 20_000 and got["en", "text word and more words"] == 19_999
    with pytest.raises(ValueError):
        collocation.collocations(awkward(spark), threshold=1000)
