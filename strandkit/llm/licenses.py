"""Licences by sentence recognition and ordered rules.

A text is cut into sections at blank lines and after ``. ! ?``, and a section into
pieces at line ends and after ``; :``.  Pieces are normalised (small letters, digits,
single spaces), which takes off comment marks as well; a line with nothing left is
blank.  Any run of pieces may be a sentence, so wrapped sentences are whole: the longest
run from each piece that stands in a table of known licence sentences gives an
identifier, and the next one starts behind it.  The identifiers of a document, in text order, are matched against
ordered rules: a rule names the identifiers that must follow each other, with others
between them allowed.  Rules for a whole licence text stand before those for a
notice, and a notice is not reported beside the text of its licence.

Everything happens inside a row, in DataFrame functions: no shuffle, no join.  A null
text has no sentences and no licences; repeated rows give equal rows; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandkit.session import ship_package

# -- fixed values: licences and the names that notices use for them
NAMES = {
    "MIT": ["mit license", "mit licence", "mit"],
    "Apache-2.0": ["apache license version 2.0", "apache license 2.0", "apache 2.0 license", "apache-2.0", "apache 2.0"],
    "BSD-2-Clause": ["bsd 2-clause license", "2-clause bsd license", "simplified bsd license", "bsd-2-clause"],
    "BSD-3-Clause": ["bsd 3-clause license", "3-clause bsd license", "new bsd license", "bsd-3-clause"],
    "GPL-2.0": ["gnu general public license version 2", "gnu general public license v2", "gpl-2.0", "gplv2"],
    "GPL-3.0": ["gnu general public license version 3", "gnu general public license v3", "gpl-3.0", "gplv3"],
    "LGPL-2.1": ["gnu lesser general public license version 2.1", "lgpl-2.1", "lgplv2.1"],
    "LGPL-3.0": ["gnu lesser general public license version 3", "lgpl-3.0", "lgplv3"],
    "AGPL-3.0": ["gnu affero general public license version 3", "agpl-3.0", "agplv3"],
    "MPL-2.0": ["mozilla public license version 2.0", "mozilla public license 2.0", "mpl-2.0"],
    "ISC": ["isc license", "isc"],
    "Unlicense": ["unlicense"],
    "CC0-1.0": ["cc0 1.0", "cc0-1.0", "cc0"],
    "CC-BY-4.0": ["cc by 4.0", "cc-by-4.0", "creative commons attribution 4.0 international license"],
    "CC-BY-SA-4.0": ["cc by-sa 4.0", "cc-by-sa-4.0", "creative commons attribution-sharealike 4.0 international license"],
    "CC-BY-NC-4.0": ["cc by-nc 4.0", "cc-by-nc-4.0", "creative commons attribution-noncommercial 4.0 international license"],
    "CC-BY-ND-4.0": ["cc by-nd 4.0", "cc-by-nd-4.0"],
    "CC-BY-NC-SA-4.0": ["cc by-nc-sa 4.0", "cc-by-nc-sa-4.0"],
}
# The opening of a notice, which becomes "under" before the lookup.
NOTICE = r"^(?:(?:this [a-z]+|it) is )?(?:made )?(?:licensed|released|distributed|available|published|provided) under (?:the terms of )?(?:the |a )?"
# -- fixed values: sentences of licence texts, normalised
TEXT_SENTENCES = {
    "mit1": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit2": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "asis1": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache1": "you may not use this file except in compliance with the license",
    "apache2": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "bsd1": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd2": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd3": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd4": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "gpl1": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl3": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "isc1": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "reserved": "all rights reserved",
}
# -- fixed values: rules for licence texts, tried in this order
TEXT_RULES = [
    ("MIT", ["mit1", "mit2", "asis1"]),
    ("BSD-3-Clause", ["bsd1", "bsd2", "bsd3", "bsd4"]),
    ("BSD-2-Clause", ["bsd1", "bsd2", "bsd3"]),
    ("Apache-2.0", ["apache1", "apache2"]),
    ("GPL-3.0-or-later", ["gpl1", "gpl3"]),
    ("GPL-2.0-or-later", ["gpl2", "gpl3"]),
    ("ISC", ["isc1"]),
]
# A known sentence holds one of these; all others need no lookup.
CUES = r"(?i)licen[sc]|permi|copyright|warrant|redistribut|rights reserved|free software|in writing"


def sentence_table() -> dict[str, str]:
    """Known sentences and their identifiers."""
    table = {sentence: ident for ident, sentence in TEXT_SENTENCES.items()}
    for licence, names in NAMES.items():
        for name in names:
            table[f"under {name}"] = table[f"spdx-license-identifier {name}"] = f"notice-{licence}"
    return table


def rules() -> list[tuple[str, str, list[str]]]:
    """(licence, form, identifiers in order): whole texts first, then notices."""
    return [(l, "text", ids) for l, ids in TEXT_RULES] + [(l, "notice", [f"notice-{l}"]) for l in NAMES] + [("reserved", "notice", ["reserved"])]


def _rule_pattern(ids: list[str]) -> str:
    """The identifiers one after the other, in a string of identifiers each between spaces."""
    return "(?: [^ ]+ )*?".join(f" {i.replace('.', '[.]')} " for i in ids)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


SECTION_END = r"(?<=[.!?])[\x20\x09-\x0D]+|\n[^A-Za-z0-9]*\n"
PIECE_END = r"(?<=[;:])[\x20\x09-\x0D]+|\n"
# The cues with a line end, and a comment mark behind it, inside.
WIDE_CUES = CUES.replace(" ", "[^A-Za-z0-9]+")
# Words before "under" and up to the name in the longest opening of a notice.
NOTICE_WORDS = 12


def sections(text: Column) -> Column:
    """Sections with a licence cue, each as its normalised pieces."""
    cued = F.filter(F.split(text, SECTION_END), lambda s: s.rlike(WIDE_CUES))

    def pieces(section: Column) -> Column:
        plain = F.transform(F.split(section, PIECE_END), lambda s: F.regexp_replace(F.translate(s, _UPPER, _LOWER), r"[^a-z0-9.+-]+", " "))
        bare = F.transform(plain, lambda s: F.regexp_replace(F.regexp_replace(s, r"^[ .+-]*(?:(?:dnl|rem) )?[ .+-]*", ""), r"[ .+-]+$", ""))
        return F.filter(bare, lambda s: s != "")

    return F.transform(cued, pieces)


def _found(pieces: Column) -> Column:
    """Identifiers of the known sentences of a section, each the longest from its first piece."""
    table = sentence_table()
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    openings = {s.split()[0] for s in table} | set("this it made licensed released distributed available published provided".split())
    opens = rf"^(?:{'|'.join(sorted(openings))})(?: |$)"
    most = max(len(s.split()) for s in table) + NOTICE_WORDS  # pieces of a sentence: each has a word

    def ident(first: Column, last: Column) -> Column:
        joined = F.array_join(F.slice(pieces, first, last - first + 1), " ")
        return F.when(joined.rlike(CUES), F.element_at(known, F.regexp_replace(joined, NOTICE, "under ")))

    def longest(first: Column) -> Column:
        ends = F.transform(F.sequence(first, F.least(first + most - 1, F.size(pieces))), lambda last: F.struct(last.alias("last"), ident(first, last).alias("id")))
        return F.struct(first.alias("first"), F.array_max(F.filter(ends, lambda e: e["id"].isNotNull())).alias("end"))

    starts = F.filter(F.sequence(F.lit(1), F.size(pieces)), lambda i: F.element_at(pieces, i).rlike(opens))
    runs = F.filter(F.transform(starts, longest), lambda r: r["end"].isNotNull())
    none = F.struct(F.lit(0).alias("last"), F.array().cast("array<string>").alias("ids"))
    taken = F.aggregate(runs, none, lambda s, r: F.when(r["first"] > s["last"], F.struct(r["end"]["last"].alias("last"), F.concat(s["ids"], F.array(r["end"]["id"])).alias("ids"))).otherwise(s))
    return F.when(F.size(pieces) > 0, taken["ids"]).otherwise(F.array().cast("array<string>"))


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    return F.when(text.rlike(WIDE_CUES), F.flatten(F.transform(sections(text), _found))).otherwise(F.array().cast("array<string>"))


def licences(ids: Column) -> Column:
    """Matched licences in rule order, as licence:form, joined by commas."""
    line = F.concat(F.lit(" "), F.array_join(ids, "  "), F.lit(" "))
    texts = {l.removesuffix("-or-later") for l, _ in TEXT_RULES}
    marks = []
    for licence, form, wanted in rules():
        hit = line.rlike(_rule_pattern(wanted))
        if licence == "BSD-2-Clause" and form == "text":
            hit = hit & ~line.rlike(_rule_pattern(dict(TEXT_RULES)["BSD-3-Clause"]))
        if form == "notice" and licence in texts:
            whole = [ids_ for l, ids_ in TEXT_RULES if l.removesuffix("-or-later") == licence]
            for ids_ in whole:
                hit = hit & ~line.rlike(_rule_pattern(ids_))
        marks.append(F.when(hit, F.lit(f"{licence}:{form}")))
    return F.concat_ws(",", *marks)


def scan(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_sentences, sentence_ids, licenses) of every document."""
    ship_package(docs.sparkSession)
    found = docs.select(F.col(ident).alias("doc_id"), sentence_ids(F.coalesce(text, F.lit(""))).alias("ids"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"), licences(F.col("ids")).alias("licenses"))


def sql() -> str:
    """The same scan in SQL, from the same table and rules."""
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    table = sentence_table()
    known = "MAP {" + ", ".join(f"{quoted(s)}: {quoted(i)}" for s, i in table.items()) + "}"
    patterns = {(l, f): _rule_pattern(ids) for l, f, ids in rules()}
    cases = []
    for (licence, form), pattern in patterns.items():
        test = f"regexp_matches(line, {quoted(pattern)})"
        if licence == "BSD-2-Clause" and form == "text":
            test += f" AND NOT regexp_matches(line, {quoted(patterns['BSD-3-Clause', 'text'])})"
        if form == "notice":
            for (l, f), p in patterns.items():
                if f == "text" and l.removesuffix("-or-later") == licence:
                    test += f" AND NOT regexp_matches(line, {quoted(p)})"
        cases.append(f"CASE WHEN {test} THEN {quoted(f'{licence}:{form}')} END")
    letters = f"{quoted(_UPPER)}, {quoted(_LOWER)}"
    return rf"""
WITH k AS (SELECT {known} AS known),
d AS (SELECT doc_id, list_filter(string_split_regex(regexp_replace(coalesce(text, ''), '([.;:!?])[\x20\x09-\x0D]+', '\1' || chr(10), 'g'), '\n+'), lambda s: regexp_matches(s, {quoted(CUES)})) AS s FROM documents),
n AS (SELECT doc_id, list_transform(s, lambda x: regexp_replace(regexp_replace(regexp_replace(translate(x, {letters}), '[^a-z0-9.+-]+', ' ', 'g'), '^[ .+-]+|[ .+-]+$', '', 'g'), {quoted(NOTICE)}, 'under ')) AS s FROM d),
i AS (SELECT doc_id, list_filter(list_transform(s, lambda x: known[x]), lambda x: x IS NOT NULL) AS ids FROM n, k),
l AS (SELECT doc_id, ids, ' ' || array_to_string(ids, '  ') || ' ' AS line FROM i)
SELECT doc_id, len(ids)::BIGINT AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentence_ids, concat_ws(',', {', '.join(cases)}) AS licenses FROM l"""
