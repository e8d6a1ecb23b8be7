"""Operators on texts against brute force, and on awkward tables."""

from __future__ import annotations

import hashlib
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from stallwise.llm import brown, curve_packing, jaccard_tree, licenses, media, mixing, pii, quality, queries, toxicity, warc
from tests.llm.cases import awkward, empty
from tests.oracle import connect, same


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_twin(spark, sf_dir, name):
    same(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.ORACLE_SQL[name])


# -- mixing ------------------------------------------------------------------------------------------


def test_water_fill_shares_the_excess():
    assert mixing.water_fill([10, 10, 100], [1, 2, 3], 120, 3) == [22.5, 30, 67.5]
    assert mixing.water_fill([], [], 0, 3) == []


def test_route_is_cheapest_on_small_networks():
    """Brute force over integer flows of two patterns and two sources."""
    rng = np.random.default_rng(1)
    for _ in range(40):
        caps, quotas = rng.integers(0, 4, 2).tolist(), rng.integers(0, 8, 2).tolist()
        members = [[0, 1], [1]] if rng.random() < 0.5 else [[0], [0, 1]]
        flow = mixing.route(caps, members, quotas)
        cost = lambda x, c: sum(min(max(x - r * c, 0), c) * (r + 1) for r in range(3))
        best = (-1, 0)
        arcs = [(i, j) for i in range(2) for j in members[i]]
        for f in np.ndindex(*[min(3 * caps[i], quotas[j]) + 1 for i, j in arcs]):
            used = [sum(v for v, (i, _) in zip(f, arcs, strict=True) if i == p) for p in range(2)]
            got = [sum(v for v, (_, j) in zip(f, arcs, strict=True) if j == s) for s in range(2)]
            if all(u <= 3 * c for u, c in zip(used, caps, strict=True)) and all(g <= q for g, q in zip(got, quotas, strict=True)):
                best = max(best, (sum(f), -sum(cost(u, c) for u, c in zip(used, caps, strict=True))))
        used = [sum(r.values()) for r in flow]
        assert (sum(used), -sum(cost(u, c) for u, c in zip(used, caps, strict=True))) == best


def test_clashing_columns_and_rows_of_two_sources(spark):
    own = ["_order", "_uses", "_w", "_base", "part", "row"]
    for d in (mixing.mixed_documents(awkward(spark)), quality.quality_rules(awkward(spark)), pii.find_pii(awkward(spark), pii.fit(awkward(spark)))):
        assert {tuple(r[c] for c in own) for r in d.select(*own).collect()} == {("o", 4, "w", "e", "a", 5)}
    docs = spark.createDataFrame([(1, "a b", "x", "m"), (1, "a b", "y", "n"), (1, "a b", "y", "n")], "doc_id long, text string, source string, _row string")
    mixed = mixing.mix_to_weights(docs)
    uses = {r["s"]: r["u"] for r in mixed.groupBy(F.col("sources")[0].alias("s")).agg(F.sum("uses").alias("u")).collect()}
    assert Counter((r["source"], r["_row"]) for r in mixing.mixed_documents(docs).collect()) == {("x", "m"): uses["x"], ("y", "n"): uses["y"]}


def test_toxicity_bounds_the_rows_of_repeated_ids(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(300)] + [(2, "bad words"), (3, "more")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 0), (2, 1), (3, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, max_rows=3)
    assert np.isfinite(model.bias) and toxicity.score(docs, model).count() == 302


def test_packing_agrees_between_runs_and_splits_hot_cells(spark, monkeypatch):
    monkeypatch.setattr(curve_packing, "RANGE_BYTES", 2_000)
    texts = ["the same words in each of many copies " * 8] * 40 + [f"text {i} with {i * 7} other words " * (i % 9) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = public_tokenizers.path("word_bpe_49k.json")
    runs = [sorted(tuple(r) for r in curve_packing.pack_along_curve(d, path, length=256).collect()) for d in (docs.repartition(3), docs.repartition(5, "text"))]
    assert runs[0] == runs[1]
    assert len({r[5] >> 40 for r in runs[0]}) > 6


def test_mix_comes_near_targets(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = queries.op1_mixing(spark, sf_dir).collect()
    again = queries.op1_mixing(spark, sf_dir).collect()
    assert sorted(rows) == sorted(again)
    size = {r["doc_id"]: len((r["text"] or "").encode().split()) for r in docs.collect()}
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    names = sorted(set(source.values()))
    held = Counter()
    for d, s in source.items():
        held[s] += size[d]
    target = dict(zip(names, mixing.water_fill([held[s] for s in names], [i % 3 + 1 for i in range(len(names))], sum(held.values()), 3), strict=True))
    taken, most = Counter(), Counter()
    for r in rows:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == held[source[r["doc_id"]]] and 0 <= r["taken"] <= 3 * r["size"]
        assert r["target"] == pytest.approx(float(target[source[r["doc_id"]]]))
        taken[source[r["doc_id"]]] += r["taken"]
        most[source[r["doc_id"]]] = max(most[source[r["doc_id"]]], r["size"])
    assert all(abs(taken[s] - target[s]) <= most[s] for s in names)


def test_overlapping_sources_and_awkward_rows(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 7 + 1), ["a", "b"] if i % 3 else ["a", None]) for i in range(300)], "doc_id long, text string, tags array<string>")
    rows = mixing.mix_to_weights(docs, sources=F.col("tags")).collect()
    total = sum(r["size"] for r in rows)
    assert len(rows) == 300 and abs(sum(r["taken"] for r in rows) - total) <= 21
    for d in (awkward(spark), empty(spark)):
        got = mixing.mix_to_weights(d).collect()
        assert len(got) == d.count() and all(r["taken"] == r["uses"] * r["size"] for r in got)
        assert mixing.mixed_documents(d).columns == d.columns


# -- packing -----------------------------------------------------------------------------------------


def test_hilbert_neighbours_touch():
    n = 3
    cells = np.array([[x, y, z] for x in range(1 << n) for y in range(1 << n) for z in range(1 << n)])
    keys = curve_packing.hilbert_index(cells, n)
    assert sorted(keys) == list(range(len(cells)))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def _check_pieces(rows, texts, tokenizer, length=4096):
    documents = {}
    for d, t in texts:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        documents.setdefault(d, []).append(ids)
    total, sequences = 0, {}
    for r in rows:
        fits = [ids for ids in documents[r["doc_id"]] if len(ids) == r["doc_tokens"] and zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]]
        assert fits
        total += r["length"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert total == sum(len(i) for ids in documents.values() for i in ids)
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length and at & (at - 1) == 0


def test_packing_loses_no_id(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    _check_pieces(queries.op7_curve_packing(spark, sf_dir).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()], tokenizer)
    odd = awkward(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = curve_packing.pack_along_curve(odd, path).collect()
    _check_pieces(rows, [(r["doc_id"], r["text"]) for r in odd.collect()], tokenizer)
    assert all(len(r["ids"]) == 4 * r["length"] for r in rows)
    assert curve_packing.pack_along_curve(empty(spark), path).count() == 0


def test_packing_of_special_tokens(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["a <|endoftext|> b", "x<|endoftext|>y", "<|startoftext|><|endoftext|>", " <|endoftext|>\n", "<|endoftext |> <|ENDOFTEXT|>", "a<|endoftext|>"]
    rows = curve_packing.pack_along_curve(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()
    _check_pieces(rows, list(enumerate(texts)), Tokenizer.from_file(path))
    assert {r["doc_id"]: r["doc_tokens"] for r in rows}[0] == 4


# -- media -------------------------------------------------------------------------------------------


def test_media_round_trip(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op8_media_columns(spark, sf_dir).collect():
        data = texts[r["doc_id"]].encode()
        payload = data + b"\xff" * (-len(data) % 576 or 576 * (not data))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])
        assert r["tile_sha256"] == hashlib.sha256(media.npy_tile(np.frombuffer(payload, np.uint8).reshape(-1, media.WIDTH))).hexdigest()
    for d in (awkward(spark), empty(spark)):
        rows = media.media_features(media.store_texts_as_media(d, keys=("doc_id", "size"))).collect()
        assert len(rows) == d.count() and all(np.load(__import__("io").BytesIO(r["tile"])).shape == (24, 24) for r in rows)


def test_decoders():
    rng = np.random.default_rng(2)
    grey, colour = rng.integers(0, 256, (5, 7), np.uint8), rng.integers(0, 256, (4, 3, 3), np.uint8)
    for form in (media.encode_pgm, media.encode_bmp):
        assert (media.decode(form(grey)) == grey).all()
    assert (media.decode(b"P6 # note\n3 4\n255\n" + colour.tobytes()) == colour).all()
    assert (media.decode(b"P2\n7 5\n255\n" + b" ".join(b"%d" % v for v in grey.ravel())) == grey).all()
    assert (media.decode(b"P3 3 4 255\n" + b" ".join(b"%d" % v for v in colour.ravel())) == colour).all()
    bits = rng.integers(0, 2, (3, 10), np.uint8)
    assert (media.decode(b"P4 10 3\n" + np.packbits(bits, axis=1).tobytes()) == (1 - bits) * 255).all()
    assert (media.decode(b"P1\n10 3\n" + b"".join(b"%d" % v for v in bits.ravel())) == (1 - bits) * 255).all()
    wide = rng.integers(0, 65536, (2, 3)).astype(">u2")
    assert (media.decode(b"P5 3 2 65535\n" + wide.tobytes()) == wide).all()


def test_area_resize_is_the_mean_of_areas():
    image = np.arange(24, dtype=float).reshape(4, 6)
    assert np.allclose(media.area_resize(image, 2, 3), image.reshape(2, 2, 3, 2).mean(axis=(1, 3)))
    fine = np.kron(image, np.ones((3, 3)))  # the same image in thirds
    assert np.allclose(media.area_resize(image, 3, 9), fine.reshape(3, 4, 9, 2).mean(axis=(1, 3)))


# -- Jaccard -----------------------------------------------------------------------------------------


def _brute_components(rows):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset()

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((str(d), len(sets[i]), str(least.get(find(i)) if sets[i] else d)) for i, (d, _) in enumerate(rows))


def _components(df):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in df.collect())


@pytest.mark.parametrize("limits", [{}, {"HOT": 6, "LEAF": 5, "CHUNK": 2, "SMALL_ROWS": 3, "LONG": 300, "TAGS": 2}, {"HOT": 6, "LEAF": 3}])
def test_components_with_hot_passages_and_edits(spark, monkeypatch, limits):
    """Small limits send blocks through every path: late shingles, large blocks, leaf pairs, long sets, shuffled joins."""
    for name, value in limits.items():
        monkeypatch.setattr(jaccard_tree, name, value)
    rng = np.random.default_rng(3)
    word = lambda: f"w{rng.integers(0, 5000)}"
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for _ in range(40):
        own = [word() for _ in range(int(rng.integers(5, 60)))]
        rows.append(own + passage)
    for _ in range(6):
        base = [word() for _ in range(int(rng.integers(20, 900)))]
        for _ in range(9):
            edited = list(base)
            for _ in range(int(rng.integers(0, max(2, len(base) // 40)))):
                edited[int(rng.integers(0, len(edited)))] = word()
            rows.append(edited)
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)] + [(200, "a b"), (201, "A  b"), (202, None), (203, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert _components(jaccard_tree.jaccard_components(docs)) == _brute_components(rows)


def test_components_of_awkward_rows(spark):
    d = awkward(spark)
    assert _components(jaccard_tree.jaccard_components(d)) == _brute_components([(r["doc_id"], r["text"]) for r in d.collect()])
    assert jaccard_tree.jaccard_components(empty(spark)).count() == 0


def test_forest_spans_every_graph():
    rng = np.random.default_rng(8)
    for _ in range(30):
        n = int(rng.integers(2, 12))
        i, j = rng.integers(0, n, (2, int(rng.integers(1, 14))))
        i, j = i[i != j], j[i != j]
        tree = jaccard_tree.forest(i, j, n)
        parts = lambda e, n=n: sorted(map(sorted, _parts(n, e)))
        assert parts(tree) == parts(list(zip(i.tolist(), j.tolist(), strict=True))) and len(tree) == n - len(parts(tree))


def _parts(n, edges):
    groups = [{k} for k in range(n)]
    for a, b in edges:
        x, y = next(g for g in groups if a in g), next(g for g in groups if b in g)
        if x is not y:
            x |= y
            groups.remove(y)
    return groups


def test_tree_pairs_lose_nothing():
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(30):
        base = rng.integers(-(1 << 60), 1 << 60, int(rng.integers(5, 1400)))
        for _ in range(3):
            keep = base[rng.random(len(base)) > rng.choice([0.0, 0.05, 0.1])]
            sets.append(np.unique(np.r_[keep, rng.integers(-(1 << 60), 1 << 60, int(rng.integers(0, 20)))]))
    n = np.array([len(s) for s in sets])
    i, j = jaccard_tree.tree_pairs(n, [jaccard_tree.bitmap(s) for s in sets], np.arange(len(sets)), np.full(len(sets), 2), 85)
    found = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    size = lambda a, b: len(np.intersect1d(sets[a], sets[b]))
    want = {(a, b) for b in range(len(sets)) for a in range(b) if 185 * size(a, b) >= 85 * (n[a] + n[b])}
    assert want <= found and len(found) < len(sets) * 6


# -- personal data -----------------------------------------------------------------------------------

_PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _luhn(d):
    return sum(v if i % 2 == 0 else v * 2 - 9 * (v >= 5) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0


def _base(text):
    out = []
    for kind, p in _PATTERNS.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": kind != "ip" or all(len(x.lstrip("0")) < 4 and int(x[-3:]) <= 255 for x in m.group().split(".")), "card": 16 <= len(d) <= 19 and _luhn(d), "phone": 8 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


TRICKY = [
    "a@b.c_d@e.f x@y. z@w..q a@b@c.d.e é\U0001f600a@b.co", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.0003.255 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 5500005555555559 41111111111111111111",
    "+1 (555) 123-4567 +12 +1234567 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 ++49 30 1234567", "", None, "a.b.c@", "@@@ ... +++ 1-1-1", "9" * 3000, "a" * 5000 + "@b.c", "1." * 2000,
]


def test_base_spans_on_tricky_texts(spark):
    docs = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    got = pii.find_pii(docs, pii.Model({}, {}, {})).select("doc_id", pii.joined(F.col("base_spans")).alias("s"), pii.joined(F.col("spans")).alias("all")).collect()
    assert {r["doc_id"]: r["s"] for r in got} == {i: _base(t) for i, t in enumerate(TRICKY)}
    assert all(r["s"] == r["all"] for r in got)


def test_pii_query_against_brute_force(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op4_weak_pii(spark, sf_dir).collect():
        base = _base(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x.startswith(k) for x in base.split(",")) for k in pii.KINDS]
        assert set(base.split(",")) <= set(r["spans"].split(",")) | {""}


def test_weak_labels_add_obfuscated_spans(spark):
    rows = [(i, f"please call tel 0{i % 9} 55{i % 10} 41{i % 10}{i % 7}, or mail me: joe{i}@site.com") for i in range(60)]
    rows += [(100 + i, f"contact jane{i} [at] site [dot] org now") for i in range(30)] + [(200 + i, f"version 1{i % 10}.{i % 10}1.22 of page 3{i % 10}-22") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.find_pii(docs, pii.fit(docs)).collect()
    spans = {r["doc_id"]: [r["text"][s["begin"] : s["end"]] for s in r["spans"]] for r in found}
    assert sum(f"jane{i} [at] site [dot] org" in spans[100 + i] for i in range(30)) == 30
    assert all(not spans[200 + i] for i in range(30))
    redacted = {r["doc_id"]: r["text"] for r in pii.redact(pii.find_pii(docs, pii.fit(docs))).collect()}
    assert redacted[105] == "contact <email> now" and redacted[205] == rows[95][1]


def test_wider_email_needs_no_other_form_in_its_text(spark):
    texts = ["write to jane at example.com", "JANE AT EXAMPLE.COM", "jane at example dot com", "jane(at)example.com", "jane [at] example (dot) com", "we met at noon", "a dot b"]
    docs = spark.createDataFrame([(i, f"{t}") for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: [(x["kind"], x["s"]) for x in r["_more"]] for r in pii.with_spans(docs).collect()}
    assert [x[1] for i in range(7) for x in got[i]] == ["jane at example.com", "JANE AT EXAMPLE.COM", "jane at example dot com", "jane(at)example.com", "jane [at] example (dot) com"]
    rows = [(i, f"please mail jane{'abcdefghij'[i % 10]} at example.com today") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(" <email> " in r["text"] for r in pii.redact(pii.find_pii(docs, pii.fit(docs))).collect())


def test_pii_of_awkward_rows(spark):
    for d in (awkward(spark), empty(spark)):
        found = pii.find_pii(d, pii.fit(d), base="b", spans="s")
        assert sorted((str(r["doc_id"]), r["t"]) for r in found.select("doc_id", pii.joined(F.col("b")).alias("t")).collect()) == sorted((str(r["doc_id"]), _base(r["text"])) for r in d.collect())


# -- models ------------------------------------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(truth[r["doc_id"]], r["predicted"]) for r in queries.op3_toxicity(spark, sf).collect() if r["held_out"] and r["doc_id"] in truth]
    hits = sum(t and p for t, p in held)
    assert hits >= 0.5 * sum(t for t, _ in held) and sum(p and not t for t, p in held) <= 0.05 * len(held)


def test_toxicity_of_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 1), (6, 0), (6, None), (None, 1), (3, 0)], "doc_id long, toxic int")
    for d in (awkward(spark), empty(spark)):
        for known in (labels, labels.limit(0)):
            scored = toxicity.score(d, toxicity.fit(d, known), keep=None, column="tox")
            assert scored.columns == [*d.columns, "tox"] and all(0 <= r["tox"] <= 1 for r in scored.collect()) and scored.count() == d.count()


def test_exchange_finds_planted_classes():
    rng = np.random.default_rng(5)
    planted = rng.integers(0, 3, 60)
    flow = np.array([[0.05, 0.9, 0.05], [0.05, 0.05, 0.9], [0.9, 0.05, 0.05]])
    pairs = rng.poisson(6 * flow[planted][:, planted])
    of = brown.exchange_classes(pairs, 3, sweeps=20)
    assert len({(a, b) for a, b in zip(planted.tolist(), of.tolist(), strict=True)}) == 3


def test_brown_scores(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op6_brown_lm(spark, sf).collect()
    texts = {r["doc_id"]: r["text"].encode().lower().split() + [1] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    counts = Counter(w for d, t in texts.items() if zlib.crc32(str(d).encode()) % 5 != 1 for w in t)
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        t = texts[r["doc_id"]]
        assert r["base_score"] == pytest.approx(float(np.log10([(counts[w] + 0.5) / (n + 0.5 * (v + 1)) for w in t]).sum()))
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(counts[w] > 0 for w in t), n)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_brown_is_a_distribution_and_classes_rare_words(spark):
    """After any word, all words, one unseen word of each class and the end have a probability of about 1 in all."""
    rng = np.random.default_rng(2)
    noun = lambda k: f"n{k}ooo" if k % 10 else f"n{k}iii"
    verb = lambda k: f"v{k}iii" if k % 10 else f"v{k}ooo"
    rows = [" ".join(f"the {noun(rng.integers(0, 150))}" if x else f"runs {verb(rng.integers(0, 150))}" for x in rng.integers(0, 2, 40)) for _ in range(80)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    model, words = brown.fit(docs, F.lit(True), classes=5, seeds=2, endings=8, held=50)
    table = {r["h"]: (r["n"], r["class"]) for r in words.collect()}
    seen = Counter(w for t in rows for w in t.split())
    assert {brown.word_hash(w.encode()): n for w, n in seen.items()} == {h: n for h, (n, _) in table.items() if h != brown.END_HASH}
    of = {w: table[brown.word_hash(w.encode())][1] for w in seen}
    nouns, verbs = Counter(of[w] for w in seen if w[0] == "n"), Counter(of[w] for w in seen if w[0] == "v")
    assert nouns.most_common(1)[0][0] != verbs.most_common(1)[0][0] and min(max(nouns.values()) / sum(nouns.values()), max(verbs.values()) / sum(verbs.values())) > 0.9
    size = [sum(n for n, c in table.values() if c == k) + 0.5 * (sum(c == k for _, c in table.values()) + 1) for k in range(4)]
    for h in range(5):
        p = 10.0 ** model.transition[h]
        assert p.sum() == pytest.approx(1) and all(sum(n + 0.5 for n, c in table.values() if c == k) + 0.5 == pytest.approx(size[k]) for k in range(4))
    probe = spark.createDataFrame([(0, "the n900iii"), (1, "the " + next(w for w in seen if w[0] == "n"))], "doc_id long, text string")
    for r, text in zip(sorted(brown.score(probe, model, words).collect(), key=lambda r: r["doc_id"]), [x["text"] for x in probe.collect()], strict=True):
        want, before = 0.0, 4
        for w in text.split():
            h = brown.word_hash(w.encode())
            by_ending = int(model.ends[brown.ending(w.encode(), 8)])
            n, c = table.get(h, (0, by_ending))
            want += model.transition[before, c] + np.log10(n + 0.5) - np.log10(size[c])
            before = model.seeds.get(h, by_ending)
        assert r["score"] == pytest.approx(want + model.transition[before, 4])


def test_most_frequent_words_by_histogram(spark):
    rng = np.random.default_rng(5)
    n = np.r_[rng.integers(1, 4, 3000), rng.integers(4, 5000, 200)]
    h = rng.integers(-(1 << 63), 1 << 63, len(n))
    counts = spark.createDataFrame(list(zip(h.tolist(), n.tolist(), strict=True)), "h long, n long")
    for k in (1, 50, 200, 1500, 5000):
        got = brown.most_frequent(counts, k)
        assert 0.8 * min(k, len(n)) - 1 <= len(got) <= k and got[-1]["n"] >= np.sort(n)[::-1][min(k, len(n)) - 1] * 0.98
    assert brown.most_frequent(counts.limit(0), 5) == []


def test_brown_does_not_depend_on_partitions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(150).select("doc_id", "text")
    found = []
    for k in (2, 24):
        own = docs.repartition(k)
        model, words = brown.fit(own, F.lit(True), seeds=300)
        assert words.count() == model.distinct
        found.append((model.seeds, {r["doc_id"]: r["score"] for r in brown.score(own, model, words).collect()}))
    (seeds, scores), (others, again) = found
    assert list(seeds.items()) == list(others.items()) and scores.keys() == again.keys()
    assert all(abs(scores[i] - again[i]) < 1e-6 for i in scores)


def test_brown_of_awkward_rows(spark):
    for d in (awkward(spark), empty(spark)):
        model, words = brown.fit(d, F.lit(True))
        scored = brown.score(d.withColumn("base", F.lit("b")), model, words, keep=("doc_id", "size", "score", "n", "base"))
        assert scored.columns == ["doc_id", "size", "n", "base", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        rows = scored.collect()
        assert len(rows) == d.count() and all(np.isfinite(r["score"]) and r["score"] < 0 for r in rows)


# -- rules, licences, revisits -----------------------------------------------------------------------


def test_quality_of_awkward_rows(spark):
    d = awkward(spark)
    rows = quality.quality_rules(d).collect()
    for r in rows:
        w = (r["text"] or "").encode().split()
        seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
        assert (r["n_words"], r["n_repeat_words"]) == (len(w), len(covered))
    assert len(rows) == d.count() and quality.quality_rules(empty(spark)).count() == 0


def test_licence_rules_need_order(spark):
    s = licenses.SENTENCES
    texts = [
        s["mit-grant"] + "\n\n" + s["mit-notice"], s["mit-notice"] + "\n" + s["mit-grant"], "x\n" + s["bsd-grant"] + "\n" + s["bsd-source"] + "\nother words\n" + s["bsd-binary"] + "\n" + s["bsd-names"],
        s["apache-short"].upper() + " Tail.", None, "",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["licences"] for r in licenses.licence_scan(docs).collect()}
    assert got == {0: ["MIT"], 1: [], 2: ["BSD-3-Clause"], 3: ["Apache-2.0"], 4: [], 5: []}
    assert licenses.licence_scan(awkward(spark)).count() == 14 and licenses.licence_scan(empty(spark)).count() == 0


def test_every_licence_rule_on_wrapped_and_commented_text(spark):
    def written(rule, mark, width):
        paragraphs = [textwrap.wrap(licenses.SENTENCES[x], width) for x in rule.sentences]
        return "\n".join(["some code", "", *[(mark + line).rstrip() for p in paragraphs for line in [*p, ""]], "more code"])

    def flowing(rule, mark, width):
        ended = [licenses.SENTENCES[x] if licenses.SENTENCES[x][-1] in ".;:" else licenses.SENTENCES[x] + ": the address." for x in rule.sentences]
        return "\n".join(mark + line for line in textwrap.wrap(" ".join(ended), width))

    cases = [(r, how(r, mark, width)) for r in licenses.RULES for how in (written, flowing) for mark in ("", "# ", " * ", "// ", ";; ", "dnl ") for width in (40, 72, 1000)]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.licence_scan(docs).collect()}
    for i, (rule, text) in enumerate(cases):
        assert (got[i]["licences"], got[i]["sentence_ids"]) == ([rule.licence], list(rule.sentences)), text
    apart = spark.createDataFrame([(0, licenses.SENTENCES["isc-grant"].replace("provided", "\n\nprovided")), (1, "Licensed under the Apache License. Version 2.0."), (2, "." * 200_000 + " licens " + "\n" * 200_000)], "doc_id long, text string")
    assert all(r["licences"] == [] for r in licenses.licence_scan(apart).collect())


def test_revisits(spark, monkeypatch):
    monkeypatch.setattr(warc, "SLICE_ROWS", 2)
    full = {"ETag": '"1"', "Content-Type": "t", "Server": "s"}
    rows = [
        (1, "http://www.A.com:80/x/#f", 10, 200, full, "one"), (2, "https://a.com/x?utm_source=q", 20, 304, {"etag": 'W/"1"', "Date": "d", "Server": "z"}, None),
        (3, "a.com/x", 30, 200, {"ETag": '"2"'}, "two"), (4, "http://a.com/x", 40, 304, {"ETag": '"1"'}, None), (5, "http://a.com/x", 5, 304, None, None),
        (6, "http://a.com/x", 50, 304, {}, None), (7, None, 50, 304, {}, None), (8, "http://a.com/x", None, 304, {}, None), (9, None, 1, 200, full, "z"), (10, "http://a.com/x", None, 200, full, "y"),
        (11, "http://b.com/", 60, 404, {}, None), (12, "http://a.com/x", 10, 304, {}, None),
    ]
    captures = spark.createDataFrame(rows, "record_id long, url string, ts long, status int, headers map<string,string>, payload string")
    got = {r["record_id"]: r for r in warc.resolve_revisits(captures).collect()}
    assert {k: (r["outcome"], r["base_id"], r["payload"]) for k, r in got.items()} == {
        2: ("resolved", 1, "one"), 4: ("mismatch", 3, None), 5: ("missing", None, None), 6: ("unchecked", 3, "two"), 7: ("missing", None, None), 8: ("missing", None, None), 12: ("missing", None, None),
    }
    assert got[2]["headers"] == {"etag": 'W/"1"', "date": "d", "content-type": "t", "server": "s"}
    assert warc.resolve_revisits(captures.limit(0)).count() == 0


@pytest.mark.parametrize("small", [0, 50_000])
def test_revisits_of_one_url_and_of_one_response(spark, monkeypatch, small):
    monkeypatch.setattr(warc, "SLICE_ROWS", 7)
    monkeypatch.setattr(warc, "SMALL_ROWS", small)
    often = [(i, "a.com/x", i // 3, 200 if i % 3 == 0 else 304, {"etag": str(i // 40)}, str(i)) for i in range(120)]
    once = [(1000 + i, "b.com/y", 0 if i == 0 else i, 200 if i == 0 else 304, {"last-modified": "m"} if i % 2 == 0 else None, f"y{i}") for i in range(90)]
    rows = often + once + [(2000 + i, None, i, 304, None, None) for i in range(30)]
    captures = spark.createDataFrame(rows, "record_id long, url string, ts long, status int, headers map<string,string>, payload string")
    want = {}
    for k, url, ts, status, headers, _ in rows:
        if status != 304:
            continue
        base = max(((t, b, h, p) for b, u, t, s, h, p in rows if s == 200 and u is not None and u == url and t < ts), default=None, key=lambda x: x[:2])
        same = [base[2][n] == headers[n] for n in ("etag", "last-modified") if base and n in (headers or {}) and n in base[2]]
        outcome = "missing" if base is None else "unchecked" if not same else "resolved" if same[0] else "mismatch"
        want[k] = (outcome, base and base[1], base[3] if outcome in ("resolved", "unchecked") else None)
    got = warc.resolve_revisits(captures).collect()
    assert len(got) == len(want) and {r["record_id"]: (r["outcome"], r["base_id"], r["payload"]) for r in got} == want
    assert len({w[0] for w in want.values()}) == 4
