"""Licence scans by canonical digests.

A text is brought to a canonical form: lower case, copyright and "all rights reserved"
lines gone, also behind comment marks, everything but letters and digits a single
blank, equivalent spellings and ways of naming a licence made one (SPDX identifiers,
"or later" and "only", names with and without "license"), a title before
the opening words of a known text gone. Its digest is then joined with the digests of the known texts,
which go through the same expressions. Whole documents and their single lines are
looked up: the first finds licence files, the second the notices in other documents.

The join's small side is the table below, of fixed size, hence broadcast. Only texts
that show one of ``HINTS`` are brought to canonical form: every known text holds one
of these words, and of them the canonical form only makes "licensed", from another
word before "under", which is therefore one too. It joins no words.

Null, empty and unknown texts give no row; a document with several notices gives a
row for each of its lines. Repeated rows are reported each. Extra columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missive.llm.common import literal_rows, text_of

_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC_END = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD_TOP = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'

#: Known texts (SPDX id, text): fixed values, the licences' published wording without copyright lines.
TEXTS = [
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. ' + _WARRANTY),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_END),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_END),
    ("BSD-2-Clause", f"{_BSD_TOP} {_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD_TOP} {_BSD_THIRD} {_BSD_END}"),
]
_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + _WARRANTY.replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS")
#: Texts that the SQL doesn't know, likewise.
MORE_TEXTS = [("Unlicense", _UNLICENSE + end) for end in ("", " For more information, please refer to <http://unlicense.org>", " For more information, please refer to <https://unlicense.org>")]
#: Names by which a one-line notice gives a licence, in canonical spelling: fixed values.
NAMES = [
    ("MIT", "mit license"), ("Apache-2.0", "apache license 2"), ("ISC", "isc license"), ("Unlicense", "unlicense"),
    ("BSD-2-Clause", "bsd 2 clause license"), ("BSD-3-Clause", "bsd 3 clause license"),
    ("GPL-2.0", "gpl 2"), ("GPL-3.0", "gpl 3"), ("LGPL-2.1", "lgpl 2 1"), ("LGPL-3.0", "lgpl 3"), ("AGPL-3.0", "agpl 3"),
    ("MPL-2.0", "mozilla public license 2"), ("EPL-2.0", "eclipse public license 2"), ("CC0-1.0", "cc0 1"),
    ("CC-BY-4.0", "cc by 4"), ("CC-BY-SA-4.0", "cc by sa 4"), ("CC-BY-NC-4.0", "cc by nc 4"), ("CC-BY-ND-4.0", "cc by nd 4"),
    ("CC-BY-NC-SA-4.0", "cc by nc sa 4"), ("CC-BY-NC-ND-4.0", "cc by nc nd 4"),
]

#: md5 of the canonical form of longer published texts, with and without the appendix after their terms: fixed values
DIGESTS = [
    ("Apache-2.0", "bdaf06b854c3973d6c657a17a4c120c7"),
    ("Apache-2.0", "22d8571f70b24b4441d0d4ba568067da"),
    ("GPL-2.0", "312d89bf07a760ffb1b53e1b5fa8855a"),
    ("GPL-2.0", "a30686d77d7cc0b30f92cf6b2c1f8e4b"),
    ("GPL-3.0", "9b0a71e2d5cef36a78c6ff4af15a7888"),
    ("GPL-3.0", "a036ba41a90401d89471538a3f2a112e"),
    ("LGPL-2.1", "50abad25439282f4d5aaa523051fcf88"),
    ("LGPL-2.1", "7d71baedb6292ad72847eec6d57d84e5"),
    ("LGPL-3.0", "bc08e2136b815b0cb01aebfc9b9c5086"),
    ("MPL-2.0", "e8d70b722ae7c406694f43351a9b8ef3"),
    ("CC0-1.0", "88ef38e5c5e56280a0e551724fa5ca39"),
    ("EPL-2.0", "f2a2823b0b0015eb7e7ec95087f9091a"),
]

#: what the SQL looks for; notices such as "Released under the GPLv3" show none of it
ANCHORS = r"(?i)licen[cs]e|permission|permitted"
#: one of these stands in every text whose canonical form is known
HINTS = ANCHORS + r"|\bunder\b"

#: the lines that don't belong to a licence's wording; a line of the wording that begins with "copyright" or item (c) stays
LINES = [
    (r"(?m)^[^\p{L}\p{N}\n]*(?:copyright\b(?![,.;\x22-]|[ \t]*\r?$|[ \t]+(?:are|if|the software|the library|notices?|holders?|owners?|ownership|statements?|laws?|licen[cs]es?|interests?|and|or|on|in|is|to|for|of|as|treaty|disclaimers?|permission|doctrines|rights?)\b)|\(c\)(?![ \t]+(?:you|under|the|any|if|to|in)\b)|©)[^\n]*$", " "),
    (r"(?m)^[^\p{L}\p{N}\n]*all rights reserved[^\p{L}\p{N}\n]*$", " "),
]
#: the SQL's form of these
SQL_LINES = [(r"(?m)^[ \t]*(?:copyright|\(c\)|©)[^\n]*$", " ")]
#: (pattern, replacement), in this order, in a dialect that Java and RE2 read alike; $1 is the first group
STEPS = [
    (r"[^\p{L}\p{N}]+", " "),
    (r"^ +| +$", ""),
    (r"\b(sub)?licenc(e|es|ed|ing)\b", "$1licens$2"),
    (r"\b([a-z]+)is(e|es|ed|ing|ation|ations)\b", "$1iz$2"),
    (r"\b(fav|behavi|col|hon|lab)our(s|ed|ing|able)?\b", "$1or$2"),
    (r"\bcopyright owner(s?)\b", "copyright holder$1"),
    (r"\bnon commercial\b", "noncommercial"),
    (r"\bmerchantibility\b", "merchantability"),
    (r"\bnon infringement\b", "noninfringement"),
    (r"\bgnu (?:lesser|library) general public licens(?:e|es)\b", "lgpl"),
    (r"\bgnu affero general public license\b", "agpl"),
    (r"\b(?:gnu general public license|gnu gpl)\b", "gpl"),
    (r"\bcreative commons attribution\b", "cc by"),
    (r"^(.*\bcc by)(?: noncommercial)\b", "$1 nc"),
    (r"^(.*\bcc by(?: nc)?)(?: (?:sharealike|share alike))\b", "$1 sa"),
    (r"^(.*\bcc by(?: nc)?)(?: (?:noderivatives|noderivs|no derivatives))\b", "$1 nd"),
    (r"\b(l|a)?gplv([0-9])", "$1gpl $2"),
    (r"\b(?:version|v) ?([0-9])", "$1"),
    (r"\b([0-9]) 0\b", "$1"),
    (r"^(?:(?:this|the|all) [a-z]+ (?:is|are) )?(?:made )?(?:licensed|releazed|released|distributed|published|available|provided) under (?:the )?(?:terms of (?:the )?)?", "licensed under "),
    (r"^spdx license identifier ", "licensed under "),
    (r"^(licensed under .*[0-9])(?: (?:only|(?:or|and) (?:any )?later(?: versions?)?))?(?: international)?(?: license)?$", "$1"),
    (r"^licensed under apache 2$", "licensed under apache license 2"),
    (r"^licensed under (?:mpl|mozilla public) 2$", "licensed under mozilla public license 2"),
    (r"^licensed under (?:epl|eclipse public) 2$", "licensed under eclipse public license 2"),
    (r"^licensed under (?:bsd (?:2|two) clause|(?:2|two) clause bsd)(?: license)?$", "licensed under bsd 2 clause license"),
    (r"^licensed under (?:bsd (?:3|three) clause|(?:3|three) clause bsd)(?: license)?$", "licensed under bsd 3 clause license"),
    (r"^licensed under (mit|isc)$", "licensed under $1 license"),
]
#: titles, only where the opening words of a text above come next
TITLE = (r"^(?:(?:the|mit|expat|isc|0bsd|bsd|freebsd|zero|free|public|clause|new|reviz?s?ed|modified|simplified|unlicense|license|[0-9]|two|three) )+(?=permission is hereby granted|permission to use copy|redistribution and use in|this is free and unencumbered)", "")


def canonical(text: Column) -> Column:
    """The canonical form of a licence text or notice."""
    out = F.lower(text)
    for pattern, to in [*LINES, *STEPS, TITLE]:
        out = F.regexp_replace(out, F.lit(pattern), F.lit(to))
    return out


def known(spark, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """(license_id, digest) of the known texts: the table above, or one's own (id, text) pairs."""
    rows = texts if texts is not None else TEXTS + MORE_TEXTS + [(i, f"Licensed under the {name}") for i, name in NAMES]
    found = literal_rows(spark, rows, "license_id string, text string").select("license_id", F.md5(canonical(F.col("text")).cast("binary")).alias("digest"))
    if texts is None:
        found = found.union(literal_rows(spark, DIGESTS, "license_id string, digest string"))
    return found.distinct()


def scan(docs: DataFrame, table: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", anchors: str = HINTS) -> DataFrame:
    """(doc_id, line, license_id, digest): line 0 is the whole text, others count from 1."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).filter(F.col("text").rlike(anchors))
    lines = F.concat(F.array("text"), F.when(F.contains("text", F.lit("\n")), F.split("text", "\n")).otherwise(F.array().cast("array<string>")))
    parts = rows.select("doc_id", F.posexplode(lines).alias("at", "part"))
    parts = parts.filter(F.col("part").rlike(anchors))
    found = parts.select("doc_id", F.col("at").cast("long").alias("line"), F.md5(canonical(F.col("part")).cast("binary")).alias("digest"))
    return found.join(F.broadcast(table if table is not None else known(docs.sparkSession)), "digest").select("doc_id", "line", "license_id", "digest")


def sql() -> str:
    """The same in DuckDB's SQL, but only for TEXTS and NAMES, texts that show one of ``ANCHORS``, and its own form of copyright lines."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    pairs = TEXTS + [(i, f"Licensed under the {name}") for i, name in NAMES]

    def form(column: str) -> str:
        out = f"lower({column})"
        for pattern, to in [*SQL_LINES, *STEPS]:
            out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(to.replace('$', chr(92)))}, 'g')"
        return out

    values = ", ".join(f"({quoted(i)}, {quoted(t)})" for i, t in pairs)
    return f"""
        WITH known AS (
            SELECT DISTINCT license_id, md5({form("t")}) AS digest FROM (VALUES {values}) AS v(license_id, t)
        ), docs AS (
            SELECT doc_id, text FROM documents WHERE regexp_matches(text, {quoted(ANCHORS)})
        ), parts AS (
            SELECT doc_id, 0 AS line, text AS part FROM docs
            UNION ALL
            SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)), unnest(string_split(text, chr(10))) FROM docs WHERE contains(text, chr(10))
        ), digests AS (
            SELECT doc_id, CAST(line AS BIGINT) AS line, md5({form("part")}) AS digest FROM parts WHERE regexp_matches(part, {quoted(ANCHORS)})
        )
        SELECT doc_id, line, license_id, digest FROM digests JOIN known USING (digest)
    """
