"""Small tables with the awkward cases that every operator must take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, score double, pattern string, spans string, n int, bits string, _order string, _uses long, _w string, _base string, part string, row int"


def awkward(spark: SparkSession) -> DataFrame:
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, clashing extra columns."""
    long_text = "word and more words of a long text " * 20_000
    base = "the quick brown fox jumps over the lazy dog and then it runs far away from here to there again and again"
    rows = [
        (1, base, "en", "a"), (2, base, "en", "b"), (2, base, "en", "b"), (3, None, "en", "a"), (4, "", None, None), (5, " \n\t ", "en", None),
        (None, base + " x", None, "a"), (None, None, None, None), (6, long_text, "en", "c"), (7, "é\U0001f600 a@b.co 1.2.3.4 +1 234 567 8901", "fr", "c"),
        (8, "7" * 5000, "en", "c"), (9, "x" * 200_000, "en", "c"), (10, "one", "en", "a"), (11, "ONE", "en", "a"),
    ]
    return spark.createDataFrame([(*r, None, 1, 2.0, "p", "s", 3, "b", "o", 4, "w", "e", "a", 5) for r in rows], SCHEMA)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
