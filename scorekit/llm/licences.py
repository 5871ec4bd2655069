"""Licence recognition by sentences (operator 4).

Texts are cut into sentences and each is normalised (lower case, letters, digits and inner dots). A sentence that is one of
the known licence sentences becomes its identifier; the identifiers of a text, in order, are matched against ordered
rules. A rule that matches uses its identifiers up, so the full licence is found before the single reference. Texts are
read twice: line by line, for references on lines of their own, and paragraph by paragraph, for wrapped licence texts.

Everything is one projection over the documents: nothing is shuffled. Only texts that hold one of a few words, at least
one of which is in every known sentence, are cut into sentences.

Defined results. NULL or empty text: no sentences, empty strings. NULL doc_id, repeated rows, ties: each row stands for
itself. Empty table: no rows. Extra columns: ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorekit.llm.text import or_empty

#: Known sentences and their identifiers (fixed values, from the public licence texts).
SENTENCES = {
    "Released under the MIT License": "mit.reference",
    "Licensed under the MIT License": "mit.reference",
    "This project is licensed under the MIT License": "mit.reference",
    "The MIT License (MIT)": "mit.title",
    "MIT License": "mit.title",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions": "mit.grant",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
    "Software": "mit.notice",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT": "mit.warranty",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies": "isc.grant",
    "ISC License": "isc.title",
    "Licensed under the ISC License": "isc.reference",
    "Licensed under the Apache License, Version 2.0": "apache2.reference",
    "Licensed under the Apache License, Version 2.0 (the \"License\")": "apache2.header",
    "Apache License": "apache.title",
    "you may not use this file except in compliance with the License": "apache2.compliance",
    "You may obtain a copy of the License at": "apache2.copy",
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
    "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied": "apache2.warranty",
    "See the License for the specific language governing permissions and limitations under the License": "apache2.language",
    "This work is licensed under the GNU General Public License, version 2": "gpl2.reference",
    "This work is licensed under the GNU General Public License, version 3": "gpl3.reference",
    "Licensed under the GNU General Public License, version 3": "gpl3.reference",
    "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
    "Software Foundation, either version 3 of the License, or (at your option) any later version": "gpl3+.grant",
    "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
    "Software Foundation": "gpl.grant",
    "either version 2 of the License, or (at your option) any later version": "gpl2+.version",
    "either version 3 of the License, or (at your option) any later version": "gpl3+.version",
    "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the "
    "Free Software Foundation": "lgpl.grant",
    "either version 2.1 of the License, or (at your option) any later version": "lgpl2.1+.version",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY": "gpl.warranty",
    "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE": "gpl.implied",
    "See the GNU General Public License for more details": "gpl.details",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met": "bsd.grant",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer": "bsd.source",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution": "bsd.binary",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission": "bsd.endorse",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0": "mpl2.reference",
    "This is free and unencumbered software released into the public domain": "unlicense.grant",
    "Licensed under CC BY 4.0": "ccby4.reference",
    "Licensed under CC BY-SA 4.0": "ccbysa4.reference",
    "Licensed under CC BY-NC 4.0": "ccbync4.reference",
    "Licensed under CC BY-NC-SA 4.0": "ccbyncsa4.reference",
    "This work is licensed under a Creative Commons Attribution 4.0 International License": "ccby4.reference",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": "ccbync4.reference",
}

#: Ordered rules: licence, and the sequence of identifiers that shows it (fixed values).
RULES = (
    ("Apache-2.0", "<apache2.header>(<apache2.compliance>)?(<apache2.copy>)?(<apache2.warranty>)?(<apache2.language>)?"),
    ("MIT", "(<mit.title>)?(<copyright>)*<mit.grant>(<mit.notice>)?(<mit.warranty>)?"),
    ("ISC", "(<isc.title>)?(<copyright>)*<isc.grant>"),
    ("BSD-3-Clause", "(<copyright>)*<bsd.grant><bsd.source><bsd.binary><bsd.endorse>"),
    ("BSD-2-Clause", "(<copyright>)*<bsd.grant><bsd.source><bsd.binary>"),
    ("GPL-3.0-or-later", "(<gpl3\\+.grant>|<gpl.grant><gpl3\\+.version>)(<gpl.warranty>)?(<gpl.implied>)?(<gpl.details>)?"),
    ("GPL-2.0-or-later", "<gpl.grant><gpl2\\+.version>(<gpl.warranty>)?(<gpl.implied>)?(<gpl.details>)?"),
    ("LGPL-2.1-or-later", "<lgpl.grant><lgpl2.1\\+.version>(<gpl.warranty>)?(<gpl.implied>)?"),
    ("GPL-3.0-only", "<gpl3.reference>"),
    ("GPL-2.0-only", "<gpl2.reference>"),
    ("Apache-2.0", "<apache2.reference>|<apache2.compliance><apache2.copy>"),
    ("MPL-2.0", "<mpl2.reference>"),
    ("Unlicense", "<unlicense.grant>"),
    ("CC-BY-NC-SA-4.0", "<ccbyncsa4.reference>"),
    ("CC-BY-NC-4.0", "<ccbync4.reference>"),
    ("CC-BY-SA-4.0", "<ccbysa4.reference>"),
    ("CC-BY-4.0", "<ccby4.reference>"),
    ("ISC", "<isc.reference>|<isc.title>"),
    ("MIT", "<mit.reference>|<mit.title>"),
)

#: At least one of these is in every known sentence, before and after normalising.
ANCHORS = ("licen", "copy", "permission", "warrant", "redistrib", "version", "public domain")

_BREAK = "\x01"
_SPACES = r"[\x09-\x0D\x20]"
#: Where a sentence ends. Not between "v." and its number, even where a line of a comment ends between them.
_END = r"([!?;:]|\.(?!(?<=\b[vV]\.)" + _SPACES + r"+[^A-Za-z0-9.\x01]*[0-9]))" + _SPACES + "+"
_COPYRIGHT = r"^(copyright( c)?|c copyright) (19|20)[0-9][0-9]\b"


def normal(sentence: str) -> str:
    """As ``_normal``, for the known sentences."""
    lower = sentence.translate({c: c + 32 for c in range(ord("A"), ord("Z") + 1)})
    return re.sub(r"\.+( |$)", r"\1", re.sub(r"[^a-z0-9.]+", " ", lower)).strip(" ")


KNOWN = {normal(sentence): name for sentence, name in SENTENCES.items()}
assert all(any(a in s for a in ANCHORS) for s in KNOWN), "a known sentence without an anchor would never be found"


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _normal(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(_lower(sentence), r"[^a-z0-9.]+", " "), r"\.+( |$)", "$1"))


def _anchored(text: Column) -> Column:
    found = text.contains(ANCHORS[0])
    for anchor in ANCHORS[1:]:
        found = found | text.contains(anchor)
    return found


def _identifiers(text: Column, breaks: str) -> Column:
    """Identifiers of the known sentences of a text, in order, as one string ``<a><b>``."""
    cut = F.regexp_replace(F.regexp_replace(text, breaks, _BREAK), _END, "$1" + _BREAK)
    known = F.array(*[F.lit(s) for s in KNOWN])
    names = F.array(*[F.lit(f"<{name}>") for name in KNOWN.values()])

    def identify(sentence: Column) -> Column:
        at = F.array_position(known, sentence).cast("int")
        return F.when(at > 0, F.element_at(names, F.nullif(at, F.lit(0)))).when(
            sentence.rlike(_COPYRIGHT), F.lit("<copyright>")
        ).otherwise(F.lit(""))

    sentences = F.transform(F.split(cut, _BREAK), _normal)
    return F.concat_ws("", F.transform(F.filter(sentences, _anchored), identify))


def _match(identifiers: Column) -> Column:
    """Replace what the rules use up by ``{licence}``, rule by rule."""
    for licence, pattern in RULES:
        identifiers = F.regexp_replace(identifiers, pattern, "{" + licence + "}")
    return identifiers


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: doc_id, sentences (identifiers), licences (in order of the text), unmatched identifiers.

    Each is an array of strings.
    """
    body = or_empty(text)
    views = docs.select("doc_id", body.alias("__text"), _anchored(_lower(body)).alias("__may")).select(
        "doc_id",
        F.when(F.col("__may"), _identifiers(F.col("__text"), "\n")).otherwise("").alias("__lines"),
        F.when(F.col("__may"), _identifiers(F.col("__text"), r"\n[\x09-\x0D\x20]*\n")).otherwise("").alias("__wrapped"),
    )
    matched = views.select(
        "doc_id",
        "__lines",
        "__wrapped",
        *[F.when(F.col(c) != "", _match(F.col(c))).otherwise("").alias(f"{c}_found") for c in ("__lines", "__wrapped")],
    )

    def both(pattern: str, columns: tuple[str, str]) -> Column:
        return F.array_distinct(
            F.concat(*[F.regexp_extract_all(F.col(c), F.lit(pattern), F.lit(1)) for c in columns])
        )

    found = ("__lines_found", "__wrapped_found")
    return matched.select(
        "doc_id",
        both("<([^>]*)>", ("__lines", "__wrapped")).alias("sentences"),
        both("\\{([^}]*)\\}", found).alias("licences"),
        both("<([^>]*)>", found).alias("unmatched"),
    )
