"""Licence scans by sentence rules, with DataFrame functions only.

A text becomes words (lower case, letters and digits) with marks between them where lines, sentences and paragraphs
end. Known licence sentences are found between two marks, also where they are wrapped or stand in comments; the
identifiers found, in order, are matched against ordered rules. Both tables are literals of fixed size in one
projection, so a scan neither shuffles nor runs user functions.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallwise.llm.common import text_or_empty


class LicenceRule(NamedTuple):
    """``sentences`` that follow each other, other sentences between them aside, give ``licence``."""

    licence: str
    sentences: tuple[str, ...]


#: Known sentences by identifier, fixed values; they are normalised like texts.
SENTENCES = {
    "apache-short": "Licensed under the Apache License, Version 2.0.",
    "apache-grant": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache-comply": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-asis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "mit-short": "Released under the MIT License.",
    "mit-named": "This project is licensed under the MIT License.",
    "mit-title": "The MIT License",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "gpl3-short": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "gpl-see": "See the GNU General Public License for more details.",
    "cc-by-nc-short": "Licensed under CC BY-NC 4.0.",
    "cc-by-short": "Licensed under CC BY 4.0.",
    "cc-by-sa-short": "Licensed under CC BY-SA 4.0.",
    "cc-by-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc0-short": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "mpl2-short": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "reserved": "All rights reserved.",
}

RULES = (
    LicenceRule("Apache-2.0", ("apache-short",)),
    LicenceRule("Apache-2.0", ("apache-grant", "apache-comply")),
    LicenceRule("Apache-2.0", ("apache-copy", "apache-asis")),
    LicenceRule("MIT", ("mit-short",)),
    LicenceRule("MIT", ("mit-named",)),
    LicenceRule("MIT", ("mit-grant", "mit-notice")),
    LicenceRule("ISC", ("isc-grant",)),
    LicenceRule("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    LicenceRule("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    LicenceRule("GPL-3.0-only", ("gpl3-short",)),
    LicenceRule("GPL-3.0-or-later", ("gpl-free", "gpl-warranty")),
    LicenceRule("CC-BY-NC-4.0", ("cc-by-nc-short",)),
    LicenceRule("CC-BY-4.0", ("cc-by-short",)),
    LicenceRule("CC-BY-4.0", ("cc-by-long",)),
    LicenceRule("CC-BY-SA-4.0", ("cc-by-sa-short",)),
    LicenceRule("CC0-1.0", ("cc0-short",)),
    LicenceRule("MPL-2.0", ("mpl2-short",)),
    LicenceRule("Proprietary", ("reserved",)),
)
#: A longer rule's match hides the rules whose sentences it starts with.
HIDES = {"BSD-3-Clause": "BSD-2-Clause"}


def _plain(sentence: str) -> str:
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in sentence.lower()).split())


def marked_words(text: Column) -> Column:
    """Words with one mark between each two: a blank, ``W`` for a line end, ``S`` for a sentence's, ``P`` for a paragraph's.

    A sentence ends after ``.``, ``!``, ``?``, ``;`` or ``:`` with a blank or a line end behind; a paragraph at a line
    without letters and digits, such as an empty comment line. Comment marks are neither, and go.
    """
    t = F.concat(F.lit("0\n\n"), F.lower(text), F.lit("\n\n0"))
    gap = r"[^a-z0-9\nA-Z]"
    for pattern, mark in (
        (r"\n[^a-z0-9\n]*(?:dnl|rem)(?=[ \t\n])", "\n"),
        (r"\n[^a-z0-9]*\n", " P "),
        (rf"\n{gap}+", "\n"),
        (rf"(?<=[a-z0-9])(?={gap}*+\n){gap}*?[.!?;:]{gap}*+\n", " S "),
        (r"[.!?;:][ \t]+", " S "),
        (r"\n", " W "),
        (r"[^a-z0-9SWP]+", " "),
        (r"(?<=[a-z0-9])[SWP ]*P[SWP ]*", "P"),
        (r"(?<=[a-z0-9])[SW ]*S[SW ]*", "S"),
        (r"(?<=[a-z0-9])[W ]*W[W ]*", "W"),
    ):
        t = F.regexp_replace(t, pattern, mark)
    return t


def _pattern(sentence: str) -> str:
    """A known sentence among marked words: it may be wrapped anywhere, and cut where it has a sentence end itself."""
    parts = [_plain(x).replace(" ", "[ W]") for x in re.split(r"[.!?;:][ \t]+", sentence)]
    return "[ SW]".join(x for x in parts if x)


def licence_scan(docs: DataFrame, text: str = "text", known: dict[str, str] | None = None, rules: tuple[LicenceRule, ...] = RULES) -> DataFrame:
    """``docs`` with ``sentence_ids`` (in order) and ``licences`` (sorted, distinct).

    A rule matches where its identifiers follow each other in ``sentence_ids``, which leaves out unknown
    sentences. A null or empty text has none of either; repeated rows get equal results; columns of ``docs``
    with these names are replaced.
    """
    known = SENTENCES if known is None else known
    table = F.create_map(*[F.lit(x) for name, s in known.items() for x in (_plain(s), name)])
    t = text_or_empty(F.col(text))
    # Of sentences that start alike the longest counts.
    any_known = "|".join(sorted(map(_pattern, known.values()), key=len, reverse=True))
    runs = F.regexp_extract_all(marked_words(t), F.lit(f"(?<=[SWP])(?:{any_known})(?=[SWP])"), F.lit(0))
    found = F.filter(F.transform(runs, lambda x: F.element_at(table, F.translate(x, "SW", "  "))), lambda x: x.isNotNull())
    words = "|".join(sorted({"licens", "permission", "redistribut", "rights", "copy of", "warrant", "free software", "copyright", "compliance", "neither", "applicable law"}))
    likely = t.rlike(f"(?i){words}") if known is SENTENCES else F.lit(True)
    ids = F.when(likely, found).otherwise(F.array().cast("array<string>"))
    df = docs.withColumn("sentence_ids", ids)
    line = F.concat(F.lit("\n"), F.array_join("sentence_ids", "\n"), F.lit("\n"))
    hits = F.array(*[F.when(F.instr(line, "\n" + "\n".join(r.sentences) + "\n") > 0, F.lit(r.licence)) for r in rules])
    hits = F.array_sort(F.array_distinct(F.filter(hits, lambda x: x.isNotNull())))
    for longer, shorter in HIDES.items():
        hits = F.when(F.array_contains(hits, longer), F.array_remove(hits, shorter)).otherwise(hits)
    return df.withColumn("licences", hits)
