"""Quality rules: a threshold table compiled into one Spark projection.

Every metric is a Column expression over the text, so the whole verdict is one scan without shuffle
and without user functions.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallwise.llm.common import text_or_empty, unused, words

SYMBOLS = "#*$%&|<>"


class Rule(NamedTuple):
    """Reject where ``metric`` lies outside ``low`` and ``high`` and the text has ``min_words`` words."""

    name: str
    metric: str
    low: float | None
    high: float | None
    min_words: int = 0


#: Function words of the four languages of the corpus, fixed values.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on that the this to was what with you "
    "das der des die ein eine für ist mit nicht und von zu "
    "au avec dans de des du elle est et la le les par pas pour que qui sur un une "
    "con de del el en es la las los lo no para por que se su un una y"
).split()

#: The default table. Ratios are to words, letters, lines or characters as the metric says.
RULES = (
    Rule("too_few_words", "n_words", 50, None),
    Rule("repeated_windows", "repeat_ratio", None, 0.5),
    Rule("symbols", "symbol_ratio", None, 0.25, 20),
    Rule("exclamations", "exclamation_ratio", None, 0.5, 20),
    Rule("upper_case", "upper_ratio", None, 0.5, 20),
    Rule("repeated_lines", "dup_line_ratio", None, 0.7),
    Rule("word_length", "mean_word_length", 2.0, 30.0),
    Rule("no_stop_words", "stop_word_ratio", 0.005, None, 200),
)


def repeated_window_words(w: Column, size: int = 3) -> Column:
    """Words covered by the ``size``-word windows that occur twice or more in the word array ``w``.

    ``w`` should be a plain column: it is read inside a lambda. Windows are compared by 64-bit hash.
    """
    starts = F.when(F.size(w) >= size, F.sequence(F.lit(0), F.size(w) - size)).otherwise(F.array().cast("array<int>"))
    hashed = F.transform(starts, lambda i: F.struct(F.xxhash64(*[F.get(w, i + k) for k in range(size)]).alias("h"), i.alias("i")))
    return F.sort_array(hashed)


def _covered(s: Column, size: int = 3) -> Column:
    """From the sorted (hash, start) array, the words that repeated windows cover."""
    before = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), s)
    flagged = F.zip_with(
        F.zip_with(s, before, lambda x, y: F.struct(x["h"].alias("h"), x["i"].alias("i"), y["h"].alias("p"))),
        F.slice(s, 2, F.greatest(F.size(s), F.lit(1))),
        lambda x, y: F.when((x["h"] == x["p"]) | (x["h"] == y["h"]), x["i"]),
    )
    return F.sort_array(F.filter(flagged, lambda x: x.isNotNull()))


def _span(p: Column, size: int = 3) -> Column:
    gaps = F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda a, b: F.least(F.lit(size), F.coalesce(b - a, F.lit(size))))
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, x: acc + x)


def _without(text: Column, chars: str) -> Column:
    return F.char_length(F.translate(text, chars, ""))


def quality_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the metric columns of the threshold table beside its own.

    A null text counts as empty; ratios of nothing are 0. Columns of ``docs`` with a metric's name are
    replaced; others of any name stay.
    """
    _w, _lines, _s, _p, _stops, _bangs, _uppers = unused(docs.columns, "_w", "_lines", "_s", "_p", "_stops", "_bangs", "_uppers")
    t = text_or_empty(F.col(text))
    n = F.col("n_words")
    per_word = lambda c: F.when(n > 0, c / n).otherwise(F.lit(0.0))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    stop = F.array(*[F.lit(x) for x in dict.fromkeys(STOP_WORDS)])
    chars = F.char_length(t)
    df = docs.withColumn(_w, words(F.col(text))).withColumn(_lines, lines)
    df = df.withColumn(_s, repeated_window_words(F.col(_w)))
    df = df.withColumn(_p, _covered(F.col(_s)))
    df = df.withColumns(
        {
            "n_words": F.size(_w).cast("long"),
            "word_chars": _without(t, " \t\n\x0b\x0c\r").cast("long"),
            "n_symbols": (chars - _without(t, SYMBOLS)).cast("long"),
            "n_lines": F.size(_lines).cast("long"),
            "n_dup_lines": (F.size(_lines) - F.size(F.array_distinct(_lines))).cast("long"),
            "n_repeat_words": _span(F.col(_p)),
            _stops: F.size(F.filter(_w, lambda x: F.array_contains(stop, F.lower(x)))).cast("long"),
            _bangs: (chars - _without(t, "!")).cast("long"),
            _uppers: (chars - _without(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).cast("long"),
        }
    )
    return df.withColumns(
        {
            "repeat_ratio": per_word(F.col("n_repeat_words")),
            "symbol_ratio": per_word(F.col("n_symbols")),
            "exclamation_ratio": per_word(F.col(_bangs)),
            "stop_word_ratio": per_word(F.col(_stops)),
            "mean_word_length": per_word(F.col("word_chars")),
            "upper_ratio": F.when(F.col("word_chars") > 0, F.col(_uppers) / F.col("word_chars")).otherwise(F.lit(0.0)),
            "dup_line_ratio": F.when(F.col("n_lines") > 0, F.col("n_dup_lines") / F.col("n_lines")).otherwise(F.lit(0.0)),
        }
    ).drop(_w, _lines, _s, _p, _stops, _bangs, _uppers)


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one array column: names of the rules that a row breaks, in table order."""
    broken = []
    for r in rules:
        m = F.col(r.metric)
        outside = F.lit(False)
        if r.low is not None:
            outside = outside | (m < F.lit(r.low))
        if r.high is not None:
            outside = outside | (m > F.lit(r.high))
        broken.append(F.when(outside & (F.col("n_words") >= r.min_words), F.lit(r.name)))
    return F.filter(F.array(*broken), lambda x: x.isNotNull())


def quality_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with metrics, ``failed_rules`` (array of names) and ``kept``.

    A row with a null or empty text has no words and so fails the length rule; repeated rows get equal
    verdicts; an empty table gives an empty table. Columns of ``docs`` with the name of a result are replaced.
    """
    df = quality_metrics(docs, text).withColumn("failed_rules", compile_rules(rules))
    return df.withColumn("kept", F.size("failed_rules") == 0)
