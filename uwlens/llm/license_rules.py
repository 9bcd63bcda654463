"""Licence scan by sentence rules, in DataFrame functions only.

A text is cut into sentences three times: with line ends as sentence ends, with line ends as blanks (for
wrapped notices), and with line ends as blanks but blank lines, also those that hold only comment marks, as
sentence ends (for wrapped notices around titles, copyright lines and addresses).  Each sentence is normalised (A-Z lowered, every run of other characters than a-z and
0-9 one blank), and sentences of known licence texts are mapped to their identifiers; all others drop
out.  What is left is a short identifier sequence.  A rule is an ordered list of identifiers and matches
a sequence that holds them in that order, other sentences may stand between; a matched rule that another
matched rule contains is left out.  There is no shuffle: rules are literals of the plan.

Defined results: null or empty text has no sentences and no licence; repeated rows are scanned alike;
the licences are sorted; input columns named like a result give way to it.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, whole_text, with_results

#: Notices by licence; each is one rule, the list of its sentences in order.
NOTICES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including without
        limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of
        the Software."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. Unless required by applicable law or agreed to in writing, software distributed under
        the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
        implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", """This program is free software: you can redistribute it and/or modify it under the terms of the
        GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at
        your option) any later version."""),
    ("GPL-2.0-or-later", """This program is free software; you can redistribute it and/or modify it under the terms of the
        GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at
        your option) any later version."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: Redistributions of source code must retain the above copyright
        notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the
        above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: Redistributions of source code must retain the above copyright
        notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the
        above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution. Neither the name of the copyright holder nor the names of its
        contributors may be used to endorse or promote products derived from this software without specific prior written
        permission."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)

#: A sentence ends at these marks when a blank or the text's end follows.
ENDS = r"[.!?;:]+(?=[\x09-\x0D\x20]|$)"
OTHER = r"[^a-z0-9\x01\n]+"
#: One or more blank lines of a marked text (marks other than sentence ends are blanks there).
BLANK_LINES = r"\n(?:[ \x01]*\n)+"


def sentences(text: str) -> list[str]:
    """Normalised sentences of a notice (line ends are blanks): the Python form, for the rules."""
    marked = re.sub(OTHER, " ", re.sub(ENDS, "\x01", " ".join(text.split()).lower()))
    return [s.strip() for s in marked.split("\x01") if s.strip()]


#: Identifier of each known sentence, in order of first appearance: S1, S2, ...
SENTENCE_IDS: dict[str, str] = {}
for _, _notice in NOTICES:
    for _sentence in sentences(_notice):
        SENTENCE_IDS.setdefault(_sentence, f"S{len(SENTENCE_IDS) + 1}")
#: (licence, ordered identifiers)
RULES: tuple[tuple[str, tuple[str, ...]], ...] = tuple((name, tuple(SENTENCE_IDS[s] for s in sentences(notice))) for name, notice in NOTICES)


def _contains(long: tuple[str, ...], short: tuple[str, ...]) -> bool:
    rest = iter(long)
    return long != short and all(s in rest for s in short)


def like_pattern(ids: tuple[str, ...]) -> str:
    """SQL LIKE pattern of sequences (each identifier between bars) that hold ``ids`` in order."""
    return "%" + "%".join(f"|{i}|" for i in ids) + "%"


def _sequence(parts: Column) -> Column:
    trimmed = F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s.isin(*SENTENCE_IDS))
    table = F.create_map(*[F.lit(x) for pair in SENTENCE_IDS.items() for x in pair])
    return F.transform(trimmed, lambda s: F.element_at(table, s))


def _barred(ids: Column) -> Column:
    return F.array_join(F.transform(ids, lambda i: F.concat(F.lit("|"), i, F.lit("|"))), "")


def licenses_of(*sequences: Column) -> Column:
    """Sorted distinct licences whose rule any of the sequences matches."""
    def matched(ids: tuple[str, ...]) -> Column:
        return reduce(lambda a, b: a | b, [s.like(like_pattern(ids)) for s in sequences])

    found = []
    for name, ids in RULES:
        larger = [matched(more) for _, more in RULES if _contains(more, ids)]
        found.append(F.when(reduce(lambda a, b: a & ~b, larger, matched(ids)), F.lit(name)))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))


def scan_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The input rows and columns plus n_sentences (of the cut by lines), sentence_ids (array, of the cut that
    knows most sentences; at a tie the one by lines, then the one by marks) and licenses (array)."""
    marked = F.regexp_replace(F.regexp_replace(ascii_lower(whole_text(F.col(f"`{text_col}`"))), ENDS, "\x01"), OTHER, " ")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), marked.alias("marked"))
    cut = packed.select("row", F.split("marked", "[\x01\n]").alias("by_line"),
                        F.split(F.regexp_replace("marked", "[ \n]+", " "), "\x01").alias("by_mark"),
                        F.split(F.regexp_replace(F.regexp_replace("marked", BLANK_LINES, "\x01"), "[ \n]+", " "), "\x01").alias("by_block"))
    known = cut.select("row", F.size(F.filter("by_line", lambda s: F.trim(s) != "")).cast("bigint").alias("n"),
                       _sequence(F.col("by_line")).alias("line_ids"), _sequence(F.col("by_mark")).alias("mark_ids"),
                         _sequence(F.col("by_block")).alias("block_ids"))
    most = F.greatest(F.size("line_ids"), F.size("mark_ids"), F.size("block_ids"))
    ids = (F.when(F.size("line_ids") == most, F.col("line_ids")).when(F.size("mark_ids") == most, F.col("mark_ids"))
           .otherwise(F.col("block_ids")))
    barred = known.select("row", "n", ids.alias("ids"), _barred(F.col("line_ids")).alias("line_seq"),
                          _barred(F.col("mark_ids")).alias("mark_seq"), _barred(F.col("block_ids")).alias("block_seq"))
    done = barred.select("row.*", F.col("n").alias("found_n"), F.col("ids").alias("found_ids"),
                         licenses_of(F.col("line_seq"), F.col("mark_seq"), F.col("block_seq")).alias("found_licenses"))
    return (with_results(done, n_sentences=F.col("found_n"), sentence_ids=F.col("found_ids"), licenses=F.col("found_licenses"))
            .drop("found_n", "found_ids", "found_licenses"))
