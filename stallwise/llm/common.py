"""Text conventions that the training-data operators share.

A word is a run of ``[^\\x20\\x09-\\x0D]``. In Python the same split is ``bytes.split()`` on UTF-8,
whose white space is exactly those six bytes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def words(col: Column) -> Column:
    """Words of a text in order; a null text has none."""
    return F.filter(F.split(text_or_empty(col), SPACE), lambda w: w != F.lit(""))


def word_count(col: Column) -> Column:
    return F.regexp_count(text_or_empty(col), F.lit(WORD)).cast("long")


def unused(columns: list[str], *names: str) -> list[str]:
    """``names``, each with underscores behind it until no column of the table has it (regardless of case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def id_fold(col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in fold 0."""
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % F.lit(folds), F.lit(0))
