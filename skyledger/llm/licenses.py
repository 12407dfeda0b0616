"""Licence scans by sentence rules, in DataFrame functions only.

A text is cut into sentences and normalised; the known licence sentences among
them give the document's sequence of sentence identifiers. A known sentence may
run over line breaks, indented and commented lines too, but not over blank ones,
and may follow a subject ("It was …", "This file is …") or end with a pointer
("… see LICENSE").
Ordered licence rules are matched against that sequence: a rule takes the
identifiers it matches, so a later, more general rule cannot claim them again.
Its sentences must stand near each other: a long stretch of other lines parts the sequence.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SENTENCE_END = r"([.!?:;])(?:[ \t]+|\n)"
_NO_WORD = r"[^a-z0-9.\n]+"
_TAKEN, _PARTED = "<->", "|"
MAX_GAP = 12  # line breaks between two sentences of a rule; a sentence's end counts as two

_SPDX = "SPDX-License-Identifier"
_SPDX_ID = r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*"
# A tag is a sentence of its own: with "+" a later version too, of an expression the first two names.
_SPDX_STEPS = ((rf"{_SPDX}:[ \t]*\(?({_SPDX_ID})\+", rf"\n\n{_SPDX} {{1}}-or-later\n\n"),
               (rf"{_SPDX}:[ \t]*\(?({_SPDX_ID})", rf"\n\n{_SPDX} {{1}}\n\n"),
               (rf"({_SPDX} [^\n]*)\n\n (?:OR|AND) ({_SPDX_ID})", rf"{{1}}\n\n{_SPDX} {{2}}\n\n"))
_SUBJECT = "(?:(?:it|this|the) (?:[a-z0-9]+ ){0,3}(?:is|was|are) )?"
_POINTER = "(?: see(?: [a-z0-9.]+){1,8})?"

_LINE_CLOSE = r"(?<![ \t*])[ \t]*+(?:(?:\*++/?|-->)[ \t]*+)?\n"  # blanks and comment ends, as far as the line's end
_PROSE_BREAK = r"([^.!?:;\n])\n(?!https?:)([a-z(])"
_LINE_OPEN = r"\n[ \t]*+(?:/\*++|<!--|\*++(?!/)|//++|#++|--++|;++|%++|!++|>++|(?:dnl|rem|REM)(?![^ \t\n]))?[ \t]*+"
_VERSION = r"(?<![A-Za-z0-9])([Vv])\.[ \t\n]+(?=[0-9])"
_LINE_EDGES = r"(?<=\n)[ .]++|(?<![ .])[ .]++(?=\n)"

# Normalised licence sentences and their identifiers.
SENTENCES = {
    "licensed under the apache license version 2.0": "apache2-short",
    "licensed under the apache license version 2.0 the license": "apache2-head",
    "released under the apache license version 2.0": "apache2-short",
    "you may not use this file except in compliance with the license": "apache2-comply",
    "you may obtain a copy of the license at": "apache2-copy",
    "released under the mit license": "mit-short",
    "licensed under the mit license": "mit-short",
    "this project is licensed under the mit license": "mit-short",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction including without limitation the "
    "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
    "persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions "
    "of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the "
    "warranties of merchantability fitness for a particular purpose and noninfringement": "mit-as-is",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following "
    "disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
    "following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission": "bsd-endorse",
    "this program is free software": "gpl-free",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the "
    "free software foundation": "gpl-terms",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published "
    "by the free software foundation": "lgpl-terms",
    "either version 2 of the license or at your option any later version": "gpl-2-later",
    "either version 3 of the license or at your option any later version": "gpl-3-later",
    "this work is licensed under the gnu general public license version 2": "gpl2-short",
    "this work is licensed under the gnu general public license version 3": "gpl3-short",
    "licensed under the gnu general public license version 3": "gpl3-short",
    "this source code form is subject to the terms of the mozilla public license v. 2.0": "mpl2-short",
    "licensed under cc0 1.0": "cc0-short",
    "licensed under cc by 4.0": "cc-by-short",
    "licensed under cc by sa 4.0": "cc-by-sa-short",
    "licensed under cc by nc 4.0": "cc-by-nc-short",
    "licensed under cc by nc sa 4.0": "cc-by-nc-sa-short",
    "licensed under cc by nd 4.0": "cc-by-nd-short",
    "all rights reserved": "reserved",
}

# Licences by identifier sequence, tried in this order (longer sequences before their parts).
RULES = (
    ("Apache-2.0", ("apache2-head", "apache2-comply", "apache2-copy")),
    ("Apache-2.0", ("apache2-head", "apache2-comply")),
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-1-Clause", ("bsd-grant", "bsd-source")),
    ("LGPL-2.0-or-later", ("gpl-free", "lgpl-terms", "gpl-2-later")),
    ("LGPL-3.0-or-later", ("gpl-free", "lgpl-terms", "gpl-3-later")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl-terms", "gpl-2-later")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-terms", "gpl-3-later")),
    ("Apache-2.0", ("apache2-short",)),
    ("MIT", ("mit-short",)),
    ("GPL-2.0-only", ("gpl2-short",)),
    ("GPL-3.0-only", ("gpl3-short",)),
    ("MPL-2.0", ("mpl2-short",)),
    ("CC0-1.0", ("cc0-short",)),
    ("CC-BY-4.0", ("cc-by-short",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-short",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-short",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-short",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-short",)),
    ("proprietary", ("reserved",)),
)


_GNU = "you can redistribute it and or modify it under the terms of the gnu {} as published by the free software foundation"
_OR_LATER = " either version {} of the license or at your option any later version"

# The published notices that the tables above leave out.
NOTICES = {
    "this source code form is subject to the terms of the mozilla public license v.2.0": "mpl2-short",
    "this library is free software": "lgpl-free",
    "either version 2.1 of the license or at your option any later version": "gpl-2.1-later",
    _GNU.format("library general public license"): "lgpl-library-terms",
    _GNU.format("affero general public license"): "agpl-terms",
    **{_GNU.format(name) + _OR_LATER.format(version): f"{mark}-{version}-or-later"
       for mark, name in (("gpl", "general public license"), ("lgpl", "lesser general public license"),
                          ("lgpl-library", "library general public license"), ("agpl", "affero general public license"))
       for version in ("2", "2.1", "3")},
    _GNU.format("general public license version 2"): "gpl-2-terms",
    _GNU.format("general public license version 3"): "gpl-3-terms",
    _GNU.format("lesser general public license version 2.1"): "lgpl-2.1-terms",
    _GNU.format("lesser general public license version 3"): "lgpl-3-terms",
    **{f"permission to use copy modify {word} distribute this software for any purpose with or without fee is hereby "
       "granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant"
       for word in ("and", "or", "and or")},
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
    "granted": "0bsd-grant",
}

# Fixed values, as RULES and tried after them.
NOTICE_RULES = (
    ("LGPL-2.0-or-later", ("lgpl-free", "lgpl-terms", "gpl-2-later")),
    ("LGPL-2.1-or-later", ("lgpl-free", "lgpl-terms", "gpl-2.1-later")),
    ("LGPL-3.0-or-later", ("lgpl-free", "lgpl-terms", "gpl-3-later")),
    ("LGPL-2.1-or-later", ("gpl-free", "lgpl-terms", "gpl-2.1-later")),
    ("LGPL-2.0-or-later", ("lgpl-free", "lgpl-library-terms", "gpl-2-later")),
    ("AGPL-3.0-or-later", ("gpl-free", "agpl-terms", "gpl-3-later")),
    *((name, (*free, ids)) for name, ids in (
        ("GPL-2.0-or-later", "gpl-2-or-later"), ("GPL-3.0-or-later", "gpl-3-or-later"),
        ("LGPL-2.0-or-later", "lgpl-2-or-later"), ("LGPL-2.1-or-later", "lgpl-2.1-or-later"),
        ("LGPL-3.0-or-later", "lgpl-3-or-later"), ("LGPL-2.0-or-later", "lgpl-library-2-or-later"),
        ("AGPL-3.0-or-later", "agpl-3-or-later"), ("GPL-2.0-only", "gpl-2-terms"), ("GPL-3.0-only", "gpl-3-terms"),
        ("LGPL-2.1-only", "lgpl-2.1-terms"), ("LGPL-3.0-only", "lgpl-3-terms"))
      for free in (("gpl-free",), ("lgpl-free",), ())),
    # "Name is free software": the terms say it alone.
    ("GPL-2.0-or-later", ("gpl-terms", "gpl-2-later")),
    ("GPL-3.0-or-later", ("gpl-terms", "gpl-3-later")),
    ("LGPL-2.0-or-later", ("lgpl-terms", "gpl-2-later")),
    ("LGPL-2.1-or-later", ("lgpl-terms", "gpl-2.1-later")),
    ("LGPL-3.0-or-later", ("lgpl-terms", "gpl-3-later")),
    ("LGPL-2.0-or-later", ("lgpl-library-terms", "gpl-2-later")),
    ("AGPL-3.0-or-later", ("agpl-terms", "gpl-3-later")),
    ("ISC", ("isc-grant",)),
    ("0BSD", ("0bsd-grant",)),
)

# Licences known by their SPDX names, and names out of use.
SPDX_NAMES = ("MIT", "Apache-2.0", "BSD-1-Clause", "BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD", "Zlib", "Unlicense", "BSL-1.0",
              "MPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.0-only",
              "LGPL-2.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later",
              "AGPL-3.0-only", "AGPL-3.0-or-later", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0",
              "CC-BY-NC-SA-4.0", "CC-BY-ND-4.0")
OLD_SPDX_NAMES = {"GPL-2.0": "GPL-2.0-only", "GPL-3.0": "GPL-3.0-only", "LGPL-2.0": "LGPL-2.0-only",
                  "LGPL-2.1": "LGPL-2.1-only", "LGPL-3.0": "LGPL-3.0-only", "AGPL-3.0": "AGPL-3.0-only"}


def _spdx_sentence(name: str) -> str:
    return f"{_SPDX} {name}".lower().replace("-", " ")


# Further notices, tried after the others.
FURTHER = {
    "this software is provided as is without any express or implied warranty": "zlib-as-is",
    "in no event will the authors be held liable for any damages arising from the use of this software": "zlib-liable",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to "
    "alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "this is free and unencumbered software released into the public domain": "unlicense-head",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or "
    "as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense-grant",
    "distributed under the boost software license version 1.0": "boost-short",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and "
    "accompanying documentation covered by this license the software to use reproduce display distribute execute and "
    "transmit the software and to prepare derivative works of the software and to permit third parties to whom the "
    "software is furnished to do so all subject to the following": "boost-grant",
    **{_spdx_sentence(name): f"spdx-{name.lower()}" for name in SPDX_NAMES},
    **{_spdx_sentence(old): f"spdx-{name.lower()}" for old, name in OLD_SPDX_NAMES.items()},
}
FURTHER_RULES = (
    ("Zlib", ("zlib-as-is", "zlib-liable", "zlib-grant")),
    ("Zlib", ("zlib-liable", "zlib-grant")),
    ("Zlib", ("zlib-grant",)),
    ("Unlicense", ("unlicense-head", "unlicense-grant")),
    ("Unlicense", ("unlicense-head",)),
    ("BSL-1.0", ("boost-short",)),
    ("BSL-1.0", ("boost-grant",)),
    *((name, (f"spdx-{name.lower()}",)) for name in SPDX_NAMES),
)
ALL_SENTENCES = SENTENCES | NOTICES | FURTHER
ALL_RULES = (*RULES, *NOTICE_RULES, *FURTHER_RULES)


def normalised(text: Column) -> Column:
    """Lines of ASCII lower-case words and dots with single spaces, without comment marks.

    A sentence starts and ends at a line break; a single break may also lie
    within one, two never do. Wrapped lines that go on in lower case are joined.
    """
    tagged = raw = F.coalesce(text, F.lit(""))
    for pattern, by in _SPDX_STEPS:
        tagged = F.regexp_replace(tagged, pattern, by.replace(r"\n", "\n").format("", "$1", "$2"))
    raw = F.when(F.contains(raw, F.lit(f"{_SPDX}:")), tagged).otherwise(raw)
    lines = F.concat(F.lit("\n"), F.regexp_replace(raw, r"\r\n?", "\n"), F.lit("\n"))
    for pattern, by in ((_LINE_CLOSE, "\n"), (_PROSE_BREAK, "$1 $2"), (_LINE_OPEN, "\n"), (_VERSION, "$1."),
                        (_SENTENCE_END, "$1\n\n")):
        lines = F.regexp_replace(lines, pattern, by)
    plain = F.regexp_replace(F.translate(lines, _UPPER, _LOWER), _NO_WORD, " ")
    return F.regexp_replace(plain, _LINE_EDGES, "")


def _sentence(known: list[str], before: str, after: str, gap: str) -> str:
    """Pattern of a known sentence, at its longest, as group 1 of a run of whole lines."""
    words = "|".join(re.escape(s).replace(r"\ ", gap) for s in sorted(known, key=len, reverse=True))
    return f"{before}{_SUBJECT}({words}){_POINTER}{after}"


def known_sentences(lines: Column, known: list[str], breaks: bool = False) -> Column:
    """The ``known`` sentences of normalised lines in order; with ``breaks``, an empty string per line break too."""
    pattern = _sentence(known, r"(?<![^\n])", r"(?![^\n])", r"[ \n]") + (r"|\n" if breaks else "")
    return F.transform(F.regexp_extract_all(lines, F.lit(pattern), F.lit(1)), lambda s: F.translate(s, "\n", " "))


def _pattern(identifiers: tuple[str, ...]) -> str:
    return "".join(f"<{i}>" for i in identifiers)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  known: dict[str, str] | None = None,
                  rules: tuple[tuple[str, tuple[str, ...]], ...] = ALL_RULES, max_gap: int = MAX_GAP) -> DataFrame:
    """``doc_id, n_sentences, sentence_ids, licenses, n_unmatched`` of every row.

    ``n_sentences`` known sentences, their identifiers in order of the text,
    the licences of the rules that match (each once, in rule order) and the
    number of identifiers no rule took, all joined by commas where a list.
    No rule reaches over more than ``max_gap`` line breaks (blank lines count, and so do the
    two that end a sentence) between two of its sentences.
    Null text counts as empty: no sentence, empty lists. Very long texts are read
    whole. Null ids and repeated rows are kept; further columns are ignored; an
    empty table gives an empty result.
    """
    known = known or ALL_SENTENCES
    table = F.create_map(*[F.lit(v) for pair in known.items() for v in pair])
    steps = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(_pattern(ids)).alias("ids")) for name, ids in rules])

    def apply(state: Column, rule: Column) -> Column:
        here = F.contains(state["left"], rule["ids"])
        return F.struct(F.replace(state["left"], rule["ids"], F.lit(_TAKEN)).alias("left"),
                        F.when(here, F.array_union(state["licenses"], F.array(rule["license"])))
                        .otherwise(state["licenses"]).alias("licenses"))

    mark = lambda s: F.concat(F.lit("<"), table[s], F.lit(">"))
    apart = F.array_join(F.transform(known_sentences(F.col("lines"), list(known), breaks=True),
                                     lambda s: F.when(s == "", F.lit("\n")).otherwise(mark(s))), "")
    # Gaps matter, and are looked for, only where two sentences stand.
    left = (F.when(F.size("found") > 1,
                   F.translate(F.regexp_replace(apart, rf"\n{{{max_gap + 1},}}", _PARTED), "\n", ""))
            .otherwise(F.array_join(F.transform("found", mark), "")))
    start = F.struct(left.alias("left"), F.array().cast("array<string>").alias("licenses"))
    rows = (docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col).cast("string")).alias("lines"))
            .withColumn("found", known_sentences(F.col("lines"), list(known))))
    matched = rows.select("doc_id", F.transform("found", lambda s: table[s]).alias("ids"),
                          F.when(F.size("found") > 0, F.aggregate(steps, start, apply)).alias("end"))
    rest = F.replace(F.coalesce("end.left", F.lit("")), F.lit(_TAKEN), F.lit(""))
    return matched.select(
        "doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"),
        F.coalesce(F.array_join("end.licenses", ","), F.lit("")).alias("licenses"),
        (F.length(rest) - F.length(F.replace(rest, F.lit("<"), F.lit("")))).cast("long").alias("n_unmatched"))


# The cutting once more for an engine without lookaround: whole lines, marks written back where only looked at.
_SQL_STEPS = (
    (r"\r\n?", r"\n"),
    (r"(?m)^(|[^\n]*?[^ \t*\n])[ \t]*(?:(?:\*+/?|-->)[ \t]*)?$", r"\1"),
    (r"\n(https?:)", r"\n\x01\1"), (r"([^.!?:;\n])\n([a-z(])", r"\1 \2"), (r"\n\x01(https?:)", r"\n\1"),
    (r"(?m)^[ \t]*(?:(?:/\*+|<!--|//+|#+|--+|;+|%+|!+|>+|\*+[ \t]|\*+$|(?:dnl|rem|REM)(?:[ \t]|$))[ \t]*"
     r"|\*+([^*/ \t\n])|)", r"\1"),
    (r"(^|[^A-Za-z0-9])([Vv])\.[ \t\n]+([0-9])", r"\1\2.\3"),
    (_SENTENCE_END, r"\1\n\n"),
)


def oracle_sql(max_gap: int = MAX_GAP) -> str:
    """The scan of ``documents`` as DuckDB SQL, step by step and rule by rule."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    escaped = lambda s: ("E" + quote(s.replace("\\", "\\\\").replace(r"\\n", r"\n").replace(r"\\x01", r"\x01")))
    cut = "coalesce(text, '')"
    for pattern, by in (*((p, b.format("", r"\1", r"\2")) for p, b in _SPDX_STEPS), *_SQL_STEPS):
        if pattern == _SQL_STEPS[0][0]:
            cut, by = f"chr(10) || {cut} || chr(10)", r"\n"
        cut = f"regexp_replace({cut}, {escaped(pattern)}, {escaped(by)}, 'g')"
    for pattern, by in ((_NO_WORD, " "), ("(?m)^[ .]+|[ .]+$", "")):
        cut = f"regexp_replace({cut if by != ' ' else f'translate({cut}, {quote(_UPPER)}, {quote(_LOWER)})'}, " \
              f"{escaped(pattern)}, '{by}', 'g')"
    # Every line between two breaks of its own, so that neighbouring sentences share none.
    pattern = escaped(_sentence(list(ALL_SENTENCES), r"\n", r"\n", r"(?: |\n\n)") + r"|\n")
    known = ", ".join(f"({quote(s)}, {quote(i)})" for s, i in ALL_SENTENCES.items())
    hits = [(name, f"contains(s{n}, {quote(_pattern(ids))})") for n, (name, ids) in enumerate(ALL_RULES)]
    steps = [f"replace(s{n}, {quote(_pattern(ids))}, '{_TAKEN}') AS s{n + 1}" for n, (_, ids) in enumerate(ALL_RULES)]
    # Ten rules at a time, each block on the stored rows of the one before, so that no expression nests deep.
    blocks = [steps[at:at + 10] for at in range(0, len(steps), 10)]
    ruled = ",\n".join(f"ruled{n + 1} AS MATERIALIZED (SELECT *, {', '.join(block)} FROM ruled{n})"
                       for n, block in enumerate(blocks))
    names = list(dict.fromkeys(name for name, _ in hits))
    licenses = ", ".join(f"CASE WHEN {' OR '.join(h for other, h in hits if other == name)} THEN {quote(name)} END"
                         for name in names)
    first = {name: min(i for i, (other, _) in enumerate(hits) if other == name) for name in names}
    # A licence with several rules stands where its first matching rule stands.
    place = ", ".join("CASE " + " ".join(f"WHEN {h} THEN {i}" for i, (other, h) in enumerate(hits) if other == name)
                      + f" ELSE {first[name]} END" for name in names)
    return rf"""
WITH known(sentence, id) AS (VALUES {known}),
cut AS (SELECT row_number() OVER () AS row_no, doc_id, replace({cut}, chr(10), chr(10) || chr(10)) AS lines FROM documents),
parts AS (SELECT row_no, regexp_extract_all(lines, {pattern}, 1) AS parts FROM cut),
told AS (SELECT row_no, replace(unnest(parts), chr(10) || chr(10), ' ') AS part, generate_subscripts(parts, 1) AS place
         FROM parts),
marked AS (SELECT row_no, count(id) AS n, string_agg(id, ',' ORDER BY place) AS ids,
                  string_agg(coalesce('<' || id || '>', chr(10)), '' ORDER BY place) AS marks
           FROM told LEFT JOIN known ON known.sentence = part GROUP BY row_no HAVING count(id) > 0),
ruled0 AS (SELECT row_no, n, ids, replace(regexp_replace(marks, E'
{{{2 * max_gap},}}', '{_PARTED}', 'g'), chr(10), '') AS s0
          FROM marked),
{ruled},
ruled AS (SELECT * FROM ruled{len(blocks)}),
marks AS (SELECT row_no, unnest([{place}]) AS place, unnest([{licenses}]) AS license FROM ruled),
listed AS (SELECT row_no, string_agg(license, ',' ORDER BY place) AS licenses FROM marks GROUP BY row_no),
ordered AS (SELECT row_no, n, ids, s{len(ALL_RULES)} AS rest, licenses FROM ruled JOIN listed USING (row_no))
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_sentences, coalesce(ids, '') AS sentence_ids,
       coalesce(licenses, '') AS licenses,
       coalesce(length(replace(rest, '{_TAKEN}', '')) - length(replace(replace(rest, '{_TAKEN}', ''), '<', '')), 0)::BIGINT
           AS n_unmatched
FROM cut LEFT JOIN ordered USING (row_no)"""
