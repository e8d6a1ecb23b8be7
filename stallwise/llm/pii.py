"""Personal data by weak supervision, with DataFrame functions only.

Exact patterns find *base* spans. Wider patterns propose further candidates. Regex, gazetteer and context labelers
vote on every span (1 yes, -1 no, 0 abstain); expectation-maximisation over the table of vote patterns estimates
how reliable each labeler is and how likely each pattern is personal data; a span classifier over shape features is
then trained on those likelihoods and decides which candidates join the base spans.

The text is scanned twice, without a shuffle of texts: once for the contingency table of (kind, votes, features),
whose size is bounded by the labelers' and features' domains, and once to decide. The model is a literal
map in the second projection.
"""

from __future__ import annotations

import math
from collections import defaultdict
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallwise.llm.common import text_or_empty, unused

KINDS = ("email", "ip", "card", "phone")

#: Base patterns. Equal to greedy ones, but possessive, and starting within a run of their first class only
#: right after the match before, so that time and stack stay linear on very long runs.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Wider patterns, for candidates that do not overlap base spans.
WIDER = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\[at\]|\(at\)| at ) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\[dot\]|\(dot\)| dot |\.) ?[A-Za-z0-9-]{1,63}+){1,6}+",
    "ip": r"(?i)(?<![0-9a-f:])[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){7}(?![0-9a-f:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[ .-][0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ ./-][0-9]{2,5}){2,4}(?![0-9])",
}

#: Gazetteers, fixed values: top-level domains, card issuers' first digits, country codes.
DOMAINS = "com org net edu gov io info biz de fr es uk eu us ca ch at example".split()
ISSUERS = ("34", "35", "36", "37", "38", "4", "50", "51", "52", "53", "54", "55", "60", "62", "65")
COUNTRY_CODES = ("1", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "81", "86", "91")
#: Words before a span that speak for its kind, and words that speak against any.
CUES = {
    "email": "mail email e-mail contact write kontakt correo courriel",
    "ip": "ip host server address adresse login from",
    "card": "card visa mastercard amex credit karte carte tarjeta",
    "phone": "phone tel call fax mobile telefon tél teléfono cell",
}
AGAINST = "version v isbn issn page seite order invoice token id sku no nr chapter section doi"


class Model(NamedTuple):
    """Log-odds: of each kind before features, and of (kind, feature number, value)."""

    prior: dict[str, float]
    weight: dict[tuple[str, int, str], float]
    reliability: dict[str, list[float]]


def _found(text: Column, pattern: str, kind: str) -> Column:
    """All matches as structs of kind, begin, end (code points) and their string."""
    between, match = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<kind:string,begin:int,end:int,s:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.char_length(x["p"])
        end = begin + F.char_length(x["m"])
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("begin"), end.alias("end"), x["m"].alias("s"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    pairs = F.zip_with(match, between, lambda m, p: F.struct(m.alias("m"), p.alias("p")))
    return F.aggregate(F.filter(pairs, lambda x: x["m"].isNotNull()), start, step, lambda acc: acc["out"])


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of decimal digits has a valid Luhn check digit."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, F.ascii(c) - 48).otherwise((F.ascii(c) - 48) * 2 - F.when(c >= "5", 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(s, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(parts, lambda p: (F.char_length(p) < 3) | ((F.char_length(p) == 3) & (p <= "255")))
    n = F.char_length(_digits(s))
    if kind == "card":
        return F.when(n.between(16, 19), luhn(_digits(s))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def _none() -> Column:
    return F.array().cast("array<struct<kind:string,begin:int,end:int,s:string>>")


def base_spans(text: Column) -> Column:
    """Valid matches of the exact patterns, by kind in order and then by begin.

    Cheap tests keep the patterns off texts that cannot match.
    """
    may = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9](?:[ -]?[0-9]){15}"), "phone": text.contains("+")}
    checked = lambda k: F.filter(_found(text, PATTERNS[k], k), lambda x: _valid(k, x["s"]))
    return F.concat(*[F.when(may[k], checked(k)).otherwise(_none()) for k in KINDS])


def candidate_spans(text: Column, base: Column) -> Column:
    """Matches of the wider patterns that overlap no base span and, of each other, none before them.

    Each test before a pattern is a part of it, so it holds for every text that can match.
    """
    may = {
        "email": text.rlike(r"(?i)(?:\[at\]|\(at\)| at ) ?[A-Za-z0-9-]{1,63}+ ?(?:\[dot\]|\(dot\)| dot |\.)"),
        "ip": text.contains(":"),
        "card": text.rlike(r"[0-9]{4}[ .-][0-9]{4}"),
        "phone": text.rlike(r"[0-9]\)?[ ./-][0-9]{2}"),
    }
    all_ = F.concat(*[F.when(may[k], _found(text, WIDER[k], k)).otherwise(_none()) for k in KINDS])
    apart = F.filter(all_, lambda c: ~F.exists(base, lambda b: (b["begin"] < c["end"]) & (c["begin"] < b["end"])))
    # Kinds in order, so a later candidate that overlaps a kept one goes.
    return F.aggregate(apart, _none(), lambda kept, c: F.when(F.exists(kept, lambda b: (b["begin"] < c["end"]) & (c["begin"] < b["end"])), kept).otherwise(F.concat(kept, F.array(c))))


def _word_in(col: Column, words: str) -> Column:
    return col.rlike(r"(?<![\p{L}0-9])(?:" + "|".join(w.replace(".", r"\.") for w in words.split()) + r")[:.#]?\s*(?:\S+\s+){0,2}$")


def _by_kind(kind: Column, cases: dict[str, Column]) -> Column:
    out = F.lit(0)
    for k, c in cases.items():
        out = F.when(kind == k, c).otherwise(out)
    return out


def _votes(text: Column, x: Column, is_base: bool) -> Column:
    """Five labelers: exact pattern and checksum (regex), gazetteer, cue words, words against, neighbours."""
    kind, s = x["kind"], x["s"]
    before = F.lower(F.substring(text, F.greatest(x["begin"] - 23, F.lit(1)), F.least(x["begin"], F.lit(24))))
    after = F.substring(text, x["end"] + 1, 1)
    digits = _digits(s)
    n = F.char_length(digits)
    yes = lambda c: F.when(c, 1).otherwise(-1)
    shape = F.lit(1) if is_base else _by_kind(kind, {"email": yes(s.rlike(r"(?i)(\[|\()at|(\[|\()dot| dot ")), "ip": F.lit(1), "card": yes(luhn(digits)), "phone": yes(n.between(9, 12))})
    top = F.lower(F.regexp_extract(s, r"([A-Za-z0-9-]+)$", 1))
    starts = lambda some: F.lit(False) if not some else digits.rlike("^0*(?:" + "|".join(some) + ")")
    listed = _by_kind(kind, {"email": yes(top.isin(DOMAINS)), "ip": F.lit(0), "card": yes(starts(ISSUERS)), "phone": F.when(s.startswith("+"), yes(starts(COUNTRY_CODES))).otherwise(0)})
    cue = _by_kind(kind, {k: F.when(_word_in(before, w), 1).otherwise(0) for k, w in CUES.items()})
    against = F.when(_word_in(before, AGAINST) | before.rlike(r"[=\"$€£%#/\\]\s*$"), -1).otherwise(0)
    alone = yes((before.rlike(r"[\s(\[<:;,]$") | (x["begin"] == 0)) & after.rlike(r"^($|[\s)\]>;,.!?:])"))
    return F.array(*[v.cast("int") for v in (shape, listed, cue, against, alone)])


N_LABELERS = 5


def _features(x: Column) -> Column:
    """Shape features, each of a small fixed domain: digits, separators, length, first character."""
    s = x["s"]
    n = F.char_length(_digits(s))
    bucket = lambda c, cuts: F.concat(*[F.when(c >= k, F.lit("1")).otherwise(F.lit("0")) for k in cuts])
    marks = F.concat(*[F.when(F.instr(s, m) > 0, F.lit(m)).otherwise(F.lit("")) for m in (" ", "-", ".", "(", "/", "[", ":")])
    first = F.when(s.rlike("^[0-9]"), "d").when(s.startswith("+"), "+").when(s.startswith("("), "(").otherwise("a")
    return F.array(bucket(n, (1, 7, 9, 10, 11, 13, 16)), marks, bucket(F.char_length(s), (8, 11, 13, 16, 20, 32)), first)


N_FEATURES = 4


def expectation_maximisation(table: list[tuple[str, tuple[int, ...], float]], anchors: dict[str, float], steps: int = 50) -> dict[str, tuple[float, list[dict[int, tuple[float, float]]]]]:
    """For each kind the share of personal data and each labeler's P(vote | no), P(vote | yes).

    Labelers are taken as independent given the truth. Smoothed, and started from a weighted majority vote.
    """
    out = {}
    for kind in sorted({k for k, _, _ in table}):
        rows = [(v, n) for k, v, n in table if k == kind]
        q = [1 / (1 + math.exp(-2.0 * sum(v))) for v, _ in rows]
        prior, rates = 0.5, []
        for _ in range(steps):
            total = sum(n for _, n in rows)
            yes = sum(n * p for (_, n), p in zip(rows, q, strict=True))
            prior = (yes + anchors.get(kind, 1.0)) / (total + 2 * anchors.get(kind, 1.0))
            rates = []
            for j in range(len(rows[0][0])):
                seen: dict[int, list[float]] = {v: [0.5, 0.5] for v in (-1, 0, 1)}
                for (v, n), p in zip(rows, q, strict=True):
                    seen[v[j]][0] += n * (1 - p)
                    seen[v[j]][1] += n * p
                both = [sum(s[c] for s in seen.values()) for c in (0, 1)]
                rates.append({v: (s[0] / both[0], s[1] / both[1]) for v, s in seen.items()})
            q = []
            for v, _ in rows:
                z = math.log(prior / (1 - prior)) + sum(math.log(rates[j][x][1] / rates[j][x][0]) for j, x in enumerate(v))
                q.append(1 / (1 + math.exp(-max(-35.0, min(35.0, z)))))
        out[kind] = (prior, rates)
    return out


def posterior(estimate: tuple[float, list[dict[int, tuple[float, float]]]], votes: tuple[int, ...]) -> float:
    prior, rates = estimate
    z = math.log(prior / (1 - prior)) + sum(math.log(rates[j][x][1] / rates[j][x][0]) for j, x in enumerate(votes))
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))


def with_spans(docs: DataFrame, text: str = "text", base: str = "_base", more: str = "_more") -> DataFrame:
    """``docs`` with ``base`` and ``more``, the base spans and the candidates of each text."""
    t = text_or_empty(F.col(text))
    return docs.withColumn(base, base_spans(t)).withColumn(more, candidate_spans(t, F.col(base)))


def fit(docs: DataFrame, text: str = "text") -> Model:
    """Labelers' reliabilities and the span classifier, from all spans of all rows.

    Without any span the model is empty and adds nothing.
    """
    t = text_or_empty(F.col(text))
    spans = with_spans(docs.select(text), text)
    described = lambda c, base: F.transform(c, lambda x: F.struct(x["kind"].alias("kind"), _votes(t, x, base).alias("votes"), _features(x).alias("features")))
    rows = spans.where((F.size("_base") > 0) | (F.size("_more") > 0)).select(F.explode(F.concat(described(F.col("_base"), True), described(F.col("_more"), False))).alias("x"))
    table = rows.groupBy("x.kind", "x.votes", "x.features").agg(F.count("*").alias("n")).collect()
    votes: dict[tuple[str, tuple[int, ...]], float] = defaultdict(float)
    for r in table:
        votes[r["kind"], tuple(r["votes"])] += r["n"]
    found = expectation_maximisation([(k, v, n) for (k, v), n in sorted(votes.items())], {})
    counts: dict[tuple[str, int, str], list[float]] = defaultdict(lambda: [1.0, 1.0])
    totals: dict[str, list[float]] = defaultdict(lambda: [1.0, 1.0])
    for r in sorted(table, key=lambda r: (r["kind"], tuple(r["votes"]), tuple(r["features"]))):
        p = posterior(found[r["kind"]], tuple(r["votes"]))
        for c, share in ((0, 1 - p), (1, p)):
            totals[r["kind"]][c] += r["n"] * share
            for j, value in enumerate(r["features"]):
                counts[r["kind"], j, value][c] += r["n"] * share
    weight = {k: math.log(c[1] / (totals[k[0]][1] + 2)) - math.log(c[0] / (totals[k[0]][0] + 2)) for k, c in counts.items()}
    reliability = {k: [rates[j].get(1, (0.5, 0.5))[1] for j in range(N_LABELERS)] for k, (_, rates) in found.items()}
    return Model({k: math.log(c[1] / c[0]) for k, c in totals.items()}, weight, reliability)


def classify(model: Model, x: Column) -> Column:
    """Probability that candidate ``x`` is personal data; unseen feature values say nothing."""
    if not model.prior:
        return F.lit(0.0)
    prior = F.create_map(*[F.lit(y) for k, p in sorted(model.prior.items()) for y in (k, p)])
    weight = F.create_map(*[F.lit(y) for (k, j, v), w in sorted(model.weight.items()) for y in (f"{k}|{j}|{v}", w)])
    z = F.coalesce(F.element_at(prior, x["kind"]), F.lit(-35.0))
    features = _features(x)
    for j in range(N_FEATURES):
        z = z + F.coalesce(F.element_at(weight, F.concat(x["kind"], F.lit(f"|{j}|"), F.get(features, j))), F.lit(0.0))
    return 1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), z))))


def find_pii(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.9, base: str = "base_spans", spans: str = "spans") -> DataFrame:
    """``docs`` with columns ``base`` and ``spans``: arrays of (kind, begin, end) in code points, end exclusive.

    Both are sorted by kind as in ``KINDS`` and then by begin; ``spans`` has the base ones and the candidates
    whose probability reaches ``threshold``. A null or empty text has none; repeated rows get equal spans.
    Columns of ``docs`` with these two names are replaced; others of any name stay.
    """
    rank = lambda x: sum((F.when(x["kind"] == k, F.lit(i)).otherwise(F.lit(0)) for i, k in enumerate(KINDS)), F.lit(0))
    slim = lambda c: F.transform(c, lambda x: F.struct(x["kind"].alias("kind"), x["begin"].alias("begin"), x["end"].alias("end")))
    keyed = lambda c: F.sort_array(F.transform(c, lambda x: F.struct(rank(x).alias("r"), x["begin"].alias("begin"), x["end"].alias("end"), x["kind"].alias("kind"))))
    _base, _more = unused([*docs.columns, base, spans], "_base", "_more")
    sure = F.filter(_more, lambda x: classify(model, x) >= threshold)
    found = with_spans(docs, text, _base, _more)
    found = found.withColumn(base, slim(F.col(_base))).withColumn(spans, slim(keyed(F.concat(_base, sure))))
    return found.drop(_base, _more)


def redact(docs: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """``docs`` whose ``text`` has ``<kind>`` in place of each span; a span within an earlier one goes with it.

    A null text stays null.
    """
    ordered = F.sort_array(F.transform(F.col(spans), lambda x: F.struct(x["begin"].alias("begin"), x["end"].alias("end"), x["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        kept = F.substring(F.col(text), acc["at"] + 1, x["begin"] - acc["at"])
        more = F.concat(acc["out"], F.array(kept, F.concat(F.lit("<"), x["kind"], F.lit(">"))))
        return F.when(x["begin"] < acc["at"], F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["out"].alias("out"))).otherwise(F.struct(x["end"].alias("at"), more.alias("out")))

    pieces = F.aggregate(ordered, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col(text), acc["at"] + 1, 2147483647)))
    return docs.withColumn(text, F.when(F.size(spans) > 0, pieces).otherwise(F.col(text)))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["begin"].cast("string"), x["end"].cast("string"))), ",")
