"""The text, trigram and vector indexes against brute force."""

from __future__ import annotations

import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from stallwise.functions import similarity
from stallwise.operators import search, textindex, vectorindex


def brute_rank(tokens: list[str], clauses: list[list[tuple[bool, list[str]]]]) -> float | None:
    """Rank by enumerating one occurrence of every unit at a time; None without a match."""
    total, hit = 0.0, False
    for units in clauses:
        starts = lambda p: [i for i in range(len(tokens) - len(p) + 1) if tokens[i : i + len(p)] == p]
        good = [(starts(p), len(p)) for wanted, p in units if wanted]
        if any(starts(p) for wanted, p in units if not wanted) or any(not s for s, _ in good):
            continue
        hit = True
        if not good:
            continue
        spans = {(min(s for s in pick), max(s + n - 1 for s, (_, n) in zip(pick, good, strict=True))) for pick in product(*[s for s, _ in good])}
        least = [a for a in spans if not any(b != a and b[0] >= a[0] and b[1] <= a[1] for b in spans)]
        own = {p for s, n in good for i in s for p in range(i, i + n)}
        total += sum(0.1 / (1 + e - low + 1 - sum(low <= p <= e for p in own)) for low, e in least)
    return round(total, 9) if hit else None


def test_search_equals_brute_force(spark):
    rnd, words = random.Random(4), ["a", "b", "c", "d", "e"]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randrange(0, 9)))) for i in range(80)]
    queries = ["a b", '"a b"', '"a a" c', "a or b c", "a -b", "-a", '-"a b" c', "a a", '"a b a" or -c -d', "", "zz", "a b c"]
    docs = spark.createDataFrame(rows, "id int, t string")
    tokens = F.filter(F.split("t", " "), lambda w: w != "")
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id int, q string")
    got = {(r.query_id, r.id): r["rank"] for r in textindex.search(textindex.parse_queries(asked), textindex.postings(docs, tokens), docs.select("id")).collect()}
    want = {}
    for (q, text), (i, t) in product(enumerate(queries), rows):
        rank = brute_rank(t.split(), search.parse_web_query(text))
        if rank is not None:
            want[q, i] = rank
    assert got.keys() == want.keys()
    for key in want:
        assert got[key] == pytest.approx(want[key], abs=1e-8), key


def test_batches_meet_postings_by_equality_only(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b")], "id int, t string")
    index = textindex.write_index(docs, F.split("t", " "), str(tmp_path / "index"))
    assert [tuple(r) for r in index.orderBy("term").collect()] == [("a", 1, [0]), ("b", 1, [1])]
    found = textindex.search(textindex.parse_queries(spark.createDataFrame([(1, "a b")], "query_id int, q string")), index, docs.select("id"))
    plan = search.plan_text(found)
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    titles = docs.select("id", F.col("t").alias("title"))
    plan = search.plan_text(textindex.trigram_matches(titles.select(F.col("id").alias("query_id"), F.col("title").alias("q")), titles, 0.35))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("threshold", [0.35, 0.5, 0.8])
def test_trigram_join_equals_scan(spark, threshold):
    rnd = random.Random(9)
    words = ["sofa", "sofas", "soffa", "chair", "chairs", "Café", "cafe", "x", "", "table lamp", "lamp table", "ring", "rings"]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randrange(0, 4)))) for i in range(60)]
    titles = spark.createDataFrame(rows, "id int, title string")
    asked = titles.where("id % 3 = 0").select(F.col("id").alias("query_id"), F.col("title").alias("q"))
    got = {(r.query_id, r.id): r.sim for r in textindex.trigram_matches(asked, titles, threshold).collect()}
    both = asked.crossJoin(titles).select("query_id", "id", similarity.trigram_similarity(F.col("q"), F.col("title")).alias("sim"))
    assert got == {(r.query_id, r.id): r.sim for r in both.where(F.col("sim") > threshold).collect()}


def test_copies_of_a_title_are_compared_once(spark, monkeypatch):
    monkeypatch.setattr(textindex, "COPIES", 20)
    seen = []
    found = textindex._similar_texts
    monkeypatch.setattr(textindex, "_similar_texts", lambda q, t, threshold: seen.append((q.count(), t.count())) or found(q, t, threshold))
    names = ["red bolt", "red ring", "old gear", "Réd bolt", None]
    titles = spark.createDataFrame([(i, names[i % 5]) for i in range(500)], "id int, title string")
    asked = titles.where("id % 20 < 3").select(F.col("id").alias("query_id"), F.col("title").alias("q"))
    got = {(r.query_id, r.id): r.sim for r in textindex.trigram_matches(asked, titles, 0.35).collect()}
    both = asked.crossJoin(titles).select("query_id", "id", similarity.trigram_similarity(F.col("q"), F.col("title")).alias("sim"))
    assert got == {(r.query_id, r.id): r.sim for r in both.where("sim > 0.35").collect()} and len(got) == 10_000
    assert seen == [(3, 4)]


def clustered(n: int = 1500, dims: int = 16) -> list[tuple]:
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, dims))
    x = centres[rng.integers(0, 30, n)] + 0.4 * rng.normal(size=(n, dims))
    x[: n // 3] = x[0]  # a third of all rows in one cell
    return [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))] + [(n, None), (n + 1, [0.0] * dims), (n + 2, [1.0])]


def test_vector_search(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectorindex, "PART", 100)
    monkeypatch.setattr(vectorindex, "BLOCK", 40)
    rows = clustered()
    vectors = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(6)
    asked = vectors.where("id % 20 = 0 and embedding is not null").select(F.col("id").alias("query_id"), "embedding")
    exact = {}
    for r in vectorindex.nearest_many(vectors, asked, 10).collect():
        exact.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    x = np.array([v if v is not None and len(v) > 1 else [0.0] * 16 for _, v in rows])
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    for q, found in exact.items():
        cos = np.delete(unit @ unit[q], 1500)
        assert np.allclose([s for _, _, s in sorted(found)], np.sort(cos)[::-1][:10]) and len(found) == 10
    index = vectorindex.build(vectors, str(tmp_path / "cells"))
    assert index.rows.count() == 1502 and max(index.parts.values()) >= 5
    found = {}
    for r in vectorindex.search(index, asked, 10, probes=6).collect():
        found.setdefault(r.query_id, set()).add(r.score)
    recall = np.mean([np.mean([s >= min(v for _, _, v in exact[q]) - 1e-12 for s in found[q]]) for q in exact])
    assert recall >= 0.9
    whole = vectorindex.search(index, asked, 10, probes=10_000)
    assert {(r.query_id, r["rank"], r.id) for r in whole.collect()} == {(q, k, i) for q, rows_ in exact.items() for k, i, _ in rows_}


def test_filters_widen_the_search(spark, tmp_path):
    vectors = spark.createDataFrame(clustered(600), "id long, embedding array<float>")
    index = vectorindex.build(vectors, str(tmp_path / "cells"))
    passing = vectors.where("id % 97 = 5").select("id")
    asked = vectors.where("id in (0, 300, 599)").select(F.col("id").alias("query_id"), "embedding")
    got = vectorindex.search(index, asked, 7, probes=1, passing=passing).collect()
    want = vectorindex.nearest_many(vectors.join(passing, "id", "left_semi"), asked, 7).collect()
    assert {(r.query_id, r.id) for r in got} == {(r.query_id, r.id) for r in want} and len(want) == 21
    assert vectorindex.search(index, asked, 7, passing=passing.where("false")).collect() == []


def test_hybrid_keeps_filters_in_both_passes(spark, tmp_path):
    rows = [(i, "blue bolt" if i < 3 else "thing", "ዕቃ", "live" if i % 2 else "removed", "a" if i % 3 else "b", 100 * i if i % 5 else None) for i in range(60)]
    listings = spark.createDataFrame(rows, "id long, title_en string, title_am string, status string, category_slug string, price_etb int")
    rng = np.random.default_rng(1)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 8)))], "id long, embedding array<double>")
    asked = spark.createDataFrame([(0, "blue bolt"), (1, "nothing near"), (2, "thing")], "query_id int, q string")
    expansions = spark.createDataFrame([(0, "bolt"), (1, "nothing"), (2, "thing")], "query_id int, expansion string")
    meaning = vectors.where("id < 3").select(F.col("id").cast("int").alias("query_id"), "embedding")
    kept = search.passing(listings, category="a", max_price=4000)
    index = textindex.postings(kept, search.document_tokens(F.col("title_en"), F.col("title_am")))
    fits = {i for i, _, _, status, category, price in rows if status == "live" and category == "a" and price is not None and price <= 4000}
    cells = vectorindex.build(vectors, str(tmp_path / "cells"))
    got = search.hybrid(kept, index, asked, expansions, vectors, meaning, limit=8).collect()
    assert {r.id for r in got} <= fits
    labels = {r.query_id: r.method_used for r in got}
    assert labels == {0: "keyword_with_semantic_fallback", 1: "semantic_vector_fallback", 2: "keyword_hybrid"}
    for q in range(3):
        own = sorted((r["rank"], r.id) for r in got if r.query_id == q)
        assert [k for k, _ in own] == list(range(1, 9)) and len({i for _, i in own}) == 8
    assert sorted(got) == sorted(search.hybrid(kept, index, asked, expansions, vectors, meaning, limit=8, cells=cells).collect())
