"""License scans by sentence rules.

A text is cut into sentences at '.', '!', '?', ';' or ':' before white space, at web addresses and at blank lines. Each is normalised (A-Z
in lower case, runs of what is no letter or digit to one space) and, if known, becomes an identifier. Lines that wrap belong to one
sentence, whatever comment marks precede them; a line end may also bound a known sentence, so that a notice or a heading on a line of its
own needs no full stop. Where a sentence names its holder, whoever that is counts as the copyright holder; an SPDX expression is a notice of each
of its licences; a BSD text with a third clause that isn't known is no licence rather than another. The identifiers in the text's order, written ";A;B;", are held against ordered rules: a rule is a sequence of
identifiers, found where they stand one after the other among the known sentences; longer rules come first and use up what they match, so
a three-clause licence isn't also reported as a two-clause one.

One projection, no shuffle: known sentences and rules are constants. A text without any of the key words, one of which every known
sentence holds, skips the work. Null or empty text has no licence. Repeated rows are judged alike; extra columns aren't read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, documents

#: How short notices begin, and the licences as they name them (fixed values).
OPENINGS = (
    "Licensed under",
    "Released under",
    "Distributed under",
    "Dedicated to the public domain under",
    "Released into the public domain under",
    "This work is licensed under",
    "This project is licensed under",
    "This software is licensed under",
    "This program is licensed under",
    "This file is licensed under",
    "SPDX-License-Identifier:",
)
NAMES = (
    ("MIT", "the MIT License", "MIT"),
    ("Apache-2.0", "the Apache License, Version 2.0", 'the Apache License, Version 2.0 (the "License")', "the Apache License 2.0", "the Apache License, Version 2.0, (the \"License\")", "the Apache 2.0 License", "the Apache License v2.0", "Apache License 2.0", "Apache-2.0"),
    ("GPL-2.0", "the GNU General Public License, version 2", "the GNU General Public License v2.0", "the GNU General Public License v2", "the GNU GPL v2", "the GPLv2", "GPL-2.0", "GPL-2.0-only"),
    ("GPL-3.0", "the GNU General Public License, version 3", "the GNU General Public License v3.0", "the GNU General Public License v3", "the GNU GPL v3", "the GPLv3", "GPL-3.0", "GPL-3.0-only"),
    ("GPL-2.0-or-later", "GPL-2.0-or-later"),
    ("GPL-3.0-or-later", "GPL-3.0-or-later"),
    ("LGPL-2.1", "the GNU Lesser General Public License, version 2.1", "the GNU Lesser General Public License v2.1", "LGPL-2.1", "LGPL-2.1-only"),
    ("LGPL-3.0", "the GNU Lesser General Public License, version 3", "the GNU Lesser General Public License v3.0", "LGPL-3.0", "LGPL-3.0-only"),
    ("AGPL-3.0", "the GNU Affero General Public License, version 3", "the GNU Affero General Public License v3.0", "AGPL-3.0", "AGPL-3.0-only"),
    ("MPL-2.0", "the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0", "the Mozilla Public License, v. 2.0", "MPL-2.0"),
    ("BSD-2-Clause", "the BSD 2-Clause License", "the 2-Clause BSD License", "the BSD-2-Clause License", "BSD-2-Clause"),
    ("BSD-3-Clause", "the BSD 3-Clause License", "the 3-Clause BSD License", "the BSD-3-Clause License", "BSD-3-Clause"),
    ("ISC", "the ISC License", "ISC"),
    ("EPL-2.0", "the Eclipse Public License, version 2.0", "the Eclipse Public License 2.0", "the Eclipse Public License v2.0", "EPL-2.0"),
    ("LGPL-2.1-or-later", "LGPL-2.1-or-later"),
    ("LGPL-3.0-or-later", "LGPL-3.0-or-later"),
    ("AGPL-3.0-or-later", "AGPL-3.0-or-later"),
    ("Zlib", "the zlib License", "Zlib"),
    ("0BSD", "0BSD"),
    ("BSL-1.0", "the Boost Software License, Version 1.0", "BSL-1.0"),
    ("Unlicense", "the Unlicense", "Unlicense"),
    ("CC-BY-4.0", "CC BY 4.0", "a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-ND-4.0", "CC BY-ND 4.0", "a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0", "a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("CC-BY-NC-ND-4.0", "CC BY-NC-ND 4.0", "a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    ("CC0-1.0", "CC0 1.0", "the CC0 license", "CC0-1.0"),
)

#: The GNU licences' names, and the versions that notices give (fixed values).
GNU = (("GPL", "General Public License", ("2", "3")), ("LGPL", "Lesser General Public License", ("2.1", "3")), ("LGPL", "Library General Public License", ("2",)), ("AGPL", "Affero General Public License", ("3",)))
TERMS = "you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation"
VERSION_TERMS = "you can redistribute it and/or modify it under the terms of the GNU {0} version {1} as published by the Free Software Foundation"
LATER = ("either version {1} of the License, or (at your option) any later version", "either version {1}, or (at your option) any later version", "either version {1} of the License, or any later version")
ONLY = ("version {1} of the License", "version {1}", "version {1} only")


def gnu_sentences() -> list[tuple[str, str]]:
    """A notice's terms, alone and followed by which versions, in one sentence or the next."""
    out = []
    for family, name, versions in GNU:
        out.append((f"{family}_TERMS", TERMS.format(name)))
        for v in versions:
            kinds = [("LATER", x) for x in LATER] + [("ONLY", x) for x in ONLY]
            number = v.replace(".", "_")
            out += [(f"{family}{number}_{k}", f"{TERMS.format(name)}, {x.format(name, v)}") for k, x in kinds]
            out.append((f"{family}{number}_ONLY", VERSION_TERMS.format(name, v)))
            out += [(f"VERSION{number}_{k}", x.format(name, v)) for k, x in kinds if x != ONLY[1]]
    return list(dict.fromkeys(out))


#: Identifier and sentence, as licence texts word it (fixed values).
SENTENCES = (
    ("APACHE_USE", "you may not use this file except in compliance with the License"),
    ("APACHE_CONTRIBUTORS", "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements"),
    ("APACHE_NOTICE", "See the NOTICE file distributed with this work for additional information regarding copyright ownership"),
    ("APACHE_GRANT", 'The ASF licenses this file to You under the Apache License, Version 2.0 (the "License")'),
    ("APACHE_BODY", '"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document'),
    ("APACHE_COPY", "You may obtain a copy of the License at"),
    ("APACHE_ASIS", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied'),
    ("APACHE_SEE", "See the License for the specific language governing permissions and limitations under the License"),
    ("MIT_GRANT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions'),
    ("MIT_KEEP", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("MIT_ASIS", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT'),
    ("MIT_LIABLE", "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"),
    ("GPL_HOPE", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"),
    ("LGPL_HOPE", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"),
    ("GPL_IMPLIED", "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
    ("GPL_SEE", "See the GNU General Public License for more details"),
    ("LGPL_SEE", "See the GNU Lesser General Public License for more details"),
    ("LGPL_SEE", "See the GNU Library General Public License for more details"),
    ("AGPL_SEE", "See the GNU Affero General Public License for more details"),
    ("MPL2_FORM", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("BSD_GRANT", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD_SOURCE", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("BSD_BINARY", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("BSD_NAME", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSD_NAME", "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSD_ADVERT", "All advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("BSD_THIRD", "BSD licence with another clause"),
    ("BSD_ASIS", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED'),
    ("ISC_GRANT", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("ISC_GRANT", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("ZERO_BSD_GRANT", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("ISC_ASIS", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS'),
    ("MIT_0_GRANT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'),
    ("ZLIB_ASIS", "This software is provided 'as-is', without any express or implied warranty"),
    ("ZLIB_GRANT", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("BOOST_GRANT", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following'),
    ("EPL2_TERMS", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("GNU_VERBATIM", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed"),
    ("GPL3_BODY", "The GNU General Public License is a free, copyleft license for software and other kinds of works"),
    ("GPL2_BODY", "By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users"),
    ("LGPL2_1_BODY", "This license, the Lesser General Public License, applies to some specially designated software packages--typically libraries--of the Free Software Foundation and other authors who decide to use it"),
    ("LGPL3_BODY", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below"),
    ("AGPL3_BODY", "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software"),
    ("MPL2_BODY", '"Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software'),
    ("MPL2_BODY", "means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software"),
    ("UNLICENSE_ANYONE", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
    ("UNLICENSE_FREE", "This is free and unencumbered software released into the public domain"),
    ("ALL_RIGHTS", "All rights reserved"),
    *gnu_sentences(),
)

def gnu_rules() -> list[tuple[str, tuple[str, ...]]]:
    """Whole texts, then notices: the terms with their versions in one sentence or two, and what follows them, the most first."""
    out = [("AGPL-3.0", ("GNU_VERBATIM", "AGPL3_BODY")), ("LGPL-3.0", ("GNU_VERBATIM", "LGPL3_BODY")), ("LGPL-2.1", ("GNU_VERBATIM", "LGPL2_1_BODY")), ("GPL-3.0", ("GNU_VERBATIM", "GPL3_BODY")), ("GPL-2.0", ("GNU_VERBATIM", "GPL2_BODY"))]
    for tail in (True, False):
        for family, _, versions in dict.fromkeys((f, "", tuple(v for g, _, vs in GNU if g == f for v in vs)) for f, _, _ in GNU):
            for v in versions:
                number, name = v.replace(".", "_"), f"{family}-{v if '.' in v else v + '.0'}"
                for kind, suffix in (("LATER", "-or-later"), ("ONLY", "")):
                    for first in ((f"{family}{number}_{kind}",), (f"{family}_TERMS", f"VERSION{number}_{kind}")):
                        if tail:
                            out += [(name + suffix, (*first, hope, "GPL_IMPLIED", f"{family}_SEE")) for hope in ("GPL_HOPE", "LGPL_HOPE")]
                        else:
                            out.append((name + suffix, first))
    return out


#: Licence and the identifiers that make it, one after the other; earlier rules come first, then a notice by itself. A rule without a licence uses up
#: what would otherwise be taken for another: BSD texts with a clause that isn't known.
TEXT_RULES = (
    ("Apache-2.0", ("APACHE_CONTRIBUTORS", "APACHE_NOTICE", "APACHE_GRANT", "APACHE_USE", "APACHE_COPY", "APACHE_ASIS", "APACHE_SEE")),
    ("Apache-2.0", ("APACHE_GRANT", "APACHE_USE", "APACHE_COPY", "APACHE_ASIS", "APACHE_SEE")),
    ("Apache-2.0", ("NOTICE_APACHE_2_0", "APACHE_USE", "APACHE_COPY", "APACHE_ASIS", "APACHE_SEE")),
    ("Apache-2.0", ("NOTICE_APACHE_2_0", "APACHE_USE", "APACHE_COPY", "APACHE_ASIS")),
    ("Apache-2.0", ("APACHE_USE", "APACHE_COPY", "APACHE_ASIS", "APACHE_SEE")),
    ("Apache-2.0", ("APACHE_COPY", "APACHE_ASIS", "APACHE_SEE")),
    ("Apache-2.0", ("APACHE_USE", "APACHE_COPY", "APACHE_ASIS")),
    ("Apache-2.0", ("APACHE_BODY",)),
    *gnu_rules(),
    ("BSD-4-Clause", ("BSD_GRANT", "BSD_SOURCE", "BSD_BINARY", "BSD_THIRD", "BSD_ADVERT", "BSD_NAME", "BSD_ASIS")),
    ("BSD-4-Clause", ("BSD_GRANT", "BSD_SOURCE", "BSD_BINARY", "BSD_THIRD", "BSD_ADVERT", "BSD_NAME")),
    ("BSD-3-Clause", ("BSD_GRANT", "BSD_SOURCE", "BSD_BINARY", "BSD_THIRD", "BSD_NAME", "BSD_ASIS")),
    ("BSD-3-Clause", ("BSD_GRANT", "BSD_SOURCE", "BSD_BINARY", "BSD_THIRD", "BSD_NAME")),
    ("BSD-2-Clause", ("BSD_GRANT", "BSD_SOURCE", "BSD_BINARY", "BSD_ASIS")),
    ("", ("BSD_GRANT", "BSD_SOURCE", "BSD_BINARY", "BSD_THIRD")),
    ("BSD-2-Clause", ("BSD_GRANT", "BSD_SOURCE", "BSD_BINARY")),
    ("MIT", ("MIT_GRANT", "MIT_KEEP", "MIT_ASIS", "MIT_LIABLE")),
    ("MIT", ("MIT_GRANT", "MIT_KEEP", "MIT_ASIS")),
    ("MIT", ("MIT_GRANT", "MIT_KEEP")),
    ("MIT-0", ("MIT_0_GRANT", "MIT_ASIS", "MIT_LIABLE")),
    ("MIT-0", ("MIT_0_GRANT", "MIT_ASIS")),
    ("ISC", ("ISC_GRANT", "ISC_ASIS")),
    ("ISC", ("ISC_GRANT",)),
    ("0BSD", ("ZERO_BSD_GRANT", "ISC_ASIS")),
    ("Zlib", ("ZLIB_ASIS", "ZLIB_GRANT")),
    ("BSL-1.0", ("BOOST_GRANT",)),
    ("EPL-2.0", ("EPL2_TERMS",)),
    ("MPL-2.0", ("MPL2_FORM",)),
    ("MPL-2.0", ("MPL2_BODY",)),
    ("Unlicense", ("UNLICENSE_FREE", "UNLICENSE_ANYONE")),
    ("Unlicense", ("UNLICENSE_FREE",)),
)

#: Every known sentence, normalised, holds one of these; none can be cut by a line end.
KEYS = ("licen", "permi", "warrant", "copyright", "reserved", "redistribut", "unencumbered", "domain", "released", "distributed", "version", "advertising", "legal", "compiled")

#: What stands for the end of a sentence and for a line end within one.
END, WRAP = "\ue100", "\ue101"
#: Up to 14 words and marks.
GAP = f"(?: (?:[a-z0-9]+|{END}|{WRAP})){{1,14}}? "


def spaced(pattern: str) -> str:
    """Words that line ends may part."""
    return pattern.replace(" ", f"(?: {WRAP} {WRAP})? ")


#: Applied in this order to the text in lower case; \\1 stands for the first group.
CUTS = (
    ("[\ue000-\ue2ff]", " "),
    ("[ \\t\\r\\n]v\\.[ \\t\\r\\n]+", " v "),
    ("spdx-license-identifier:[ \\t(]*", "spdx-license-identifier "),
    # An expression's licences, each a notice of its own; an exception belongs to none.
    *[("(spdx-license-identifier [a-z0-9.+-]+)[ \\t)]+(?:or|and)[ \\t(]+", f"\\1 {END} spdx-license-identifier ")] * 5,
    ("(spdx-license-identifier [a-z0-9.+-]+)[ \\t]+with[ \\t]+", f"\\1 {END} "),
    ("(spdx-license-identifier [a-z0-9.-]+)\\+", "\\1-or-later"),
    # What may follow a notice in the same line.
    (",?[ \\t\\r\\n]+(?:[-\u2013\u2014]+[ \\t\\r\\n]+)?see[ \\t\\r\\n]+((?:the )?(?:file )?[a-z.]*(?:license|copying|licence)\\b)", f" {END} \\1"),
    ("[ \\t]+[-\u2013\u2014]{1,2}[ \\t]+", f" {END} "),
    ("https?://[^ \\t\\r\\n]*", f" {END} "),
    ("[.!?;:]+[\"')\\]]*[ \\t\\r\\n]+", END),
    ("\\n[^a-z0-9]*\\n[^a-z0-9]*", END),
    ("\\n", WRAP),
    (f"[^a-z0-9{END}{WRAP}]+", " "),
    (f"[ {END}{WRAP}]*{END}[ {END}{WRAP}]*", f" {END} {END} "),
    (f"[ {WRAP}]*{WRAP}[ {WRAP}]*", f" {WRAP} {WRAP} "),
    # Whoever the holder is that a sentence names, in up to 14 words, dots and line ends among them.
    (f"{spaced('neither the names? of')}{GAP}{spaced('nor (?:the )?names? of (?:its|their|any|other)(?: other)? (?:contributors?|contributing organizations?) may be used')}", "neither the name of the copyright holder nor the names of its contributors may be used"),
    (f"{spaced('the names? of')}{GAP}{spaced('may not be used to endorse')}", "the name of the author may not be used to endorse"),
    (f"{spaced('this software is provided by')}{GAP}{spaced('as is and any express or implied warranties')}", "this software is provided by the copyright holders and contributors as is and any express or implied warranties"),
    (f"{END} [^{END}{WRAP}]{{1,60}} {spaced('licenses this file to you under')}", f"{END} the asf licenses this file to you under"),
    # A clause after the second, or a license without the disclaimer that ends one.
    (f"({spaced('materials provided with the distribution')})( {END} {END} (?:[0-9a-z]{{1,3}} {END} {END} |[0-9] )?)({spaced('(?:neither the|the names? of|all advertising|redistributions? |products? derived|you may|you must|if you|any |no |use of|modified|altered)')})", f"\\1 {END} {END} bsd licence with another clause {END} {END} \\3"),
)


def marked(text: str) -> str:
    """The same as the column expression, for the constants: words by single spaces, marks twice where sentences and lines end."""
    out = f"\n\n{text}\n\n".translate(str.maketrans(UPPER, LOWER))
    for pattern, put in CUTS:
        out = re.sub(pattern, put, out)
    return out


def normal(sentence: str) -> str:
    """A known sentence as it is found: one stretch without marks."""
    return marked(sentence).strip(f" {END}{WRAP}")


def notice(licence: str) -> str:
    return "NOTICE_" + re.sub("[^A-Z0-9]", "_", licence.upper())


def known() -> dict[str, str]:
    notices = {normal(f"{o} {n}"): notice(licence) for licence, *names in NAMES for n in names for o in OPENINGS}
    return notices | {normal(s): k for k, s in SENTENCES}


RULES = TEXT_RULES + tuple((licence, (notice(licence),)) for licence, *_ in NAMES) + (("All-Rights-Reserved", ("ALL_RIGHTS",)),)


def pattern() -> str:
    """A known sentence between marks, its lines wrapped anywhere; of several that begin alike the longest."""
    words = lambda s: f"(?: {WRAP} {WRAP})? ".join(s.split())
    either = lambda xs: "(?:" + "|".join(words(x) for x in sorted(set(xs), key=lambda x: (-len(x), x))) + ")"
    notices = either(normal(o) for o in OPENINGS) + f"(?: {WRAP} {WRAP})? " + either(normal(n) for _, *names in NAMES for n in names)
    return f"[{END}{WRAP}] (?:{notices}|{either(normal(s) for _, s in SENTENCES)}) [{END}{WRAP}]"


def _mark(level: int) -> str:
    return chr(0xE000 + level)


def sentence_ids(text: Column) -> Column:
    """The identifiers of the known sentences, in order (array<string>)."""
    out = low = F.concat(F.lit("\n\n"), F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit("\n\n"))
    for cut, put in CUTS:
        out = F.regexp_replace(out, cut, put.replace("\\", "$"))
    table = F.create_map(*[F.lit(x) for pair in known().items() for x in pair])
    found = F.regexp_extract_all(out, F.lit(pattern()), F.lit(0))
    ids = F.transform(found, lambda s: F.element_at(table, F.btrim(F.regexp_replace(s, "[^a-z0-9]+", " "))))
    return F.when(low.rlike("|".join(KEYS)), ids).otherwise(F.array().cast("array<string>"))


def matched(sequence: Column) -> Column:
    """sequence: ';A;B;'. Each rule's hits are replaced by a mark with its number, so later rules don't see them."""
    out = F.replace(sequence, F.lit(";"), F.lit(";;"))
    for n, (_, ids) in enumerate(RULES):
        out = F.replace(out, F.lit("".join(f";{i};" for i in ids)), F.lit(_mark(n)))
    return out


def scan_licenses(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One row per document: sentence_ids (';'-joined, in order), licenses (';'-joined, in the rules' order, each once), n_known, n_unused
    (known sentences that no rule used), has_license."""
    one = docs.select(F.col(f"`{id_column}`"), sentence_ids(F.col(f"`{text}`")).alias("__s"))
    two = one.select(f"`{id_column}`", F.array_join("__s", ";").alias("sentence_ids"), F.size("__s").cast("long").alias("n_known"))
    three = two.withColumn("__m", F.when(F.col("n_known") > 0, matched(F.concat(F.lit(";"), F.col("sentence_ids"), F.lit(";")))).otherwise(F.lit("")))
    found = F.array_distinct(F.filter(F.array(*[F.when(F.instr("__m", _mark(n)) > 0, F.lit(name)) for n, (name, _) in enumerate(RULES) if name]), lambda x: x.isNotNull()))
    unused = F.regexp_count("__m", F.lit(";[A-Z0-9_]+;")).cast("long")
    return three.select(f"`{id_column}`", "sentence_ids", F.array_join(found, ";").alias("licenses"), "n_known", unused.alias("n_unused"), (F.size(found) > 0).alias("has_license"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir).select("doc_id", "text"))


def _sql() -> str:
    text = lambda s: "'" + s.replace("'", "''") + "'"
    pairs = ", ".join(f"('{k}', '{v}')" for k, v in known().items())
    t = f"chr(10) || chr(10) || translate(coalesce(text, ''), '{UPPER}', '{LOWER}') || chr(10) || chr(10)"
    s = "t"
    for cut, put in CUTS:
        s = f"regexp_replace({s}, {text(cut)}, {text(put)}, 'g')"
    m = "CASE WHEN n_known > 0 THEN ';;' || replace(sentence_ids, ';', ';;') || ';;' ELSE '' END"
    for n, (_, ids) in enumerate(RULES):
        m = f"replace({m}, '{''.join(f';{i};' for i in ids)}', chr({0xE000 + n}))"
    found = ", ".join(f"CASE WHEN contains(m, chr({0xE000 + n})) THEN '{name}' END" for n, (name, _) in enumerate(RULES) if name)
    return f"""
WITH k(sentence, id) AS (VALUES {pairs}),
d AS (SELECT row_number() OVER () AS rid, doc_id, {t} AS t FROM documents),
s AS (SELECT rid, i, trim(regexp_replace(p[i], '[^a-z0-9]+', ' ', 'g')) AS sentence
      FROM (SELECT rid, regexp_extract_all({s}, {text(pattern())}) AS p FROM d WHERE regexp_matches(t, '{'|'.join(KEYS)}')), unnest(range(1, len(p) + 1)) AS u(i)),
h AS (SELECT rid, string_agg(k.id, ';' ORDER BY i) AS ids, count(*) AS n FROM s JOIN k USING (sentence) GROUP BY rid),
a AS (SELECT d.doc_id, coalesce(ids, '') AS sentence_ids, CAST(coalesce(n, 0) AS BIGINT) AS n_known FROM d LEFT JOIN h USING (rid)),
b AS (SELECT *, {m} AS m FROM a),
c AS (SELECT *, list_filter([{found}], lambda x: x IS NOT NULL) AS f FROM b),
e AS (SELECT *, list_filter(f, lambda x, i: list_position(f, x) = i) AS g FROM c)
SELECT doc_id, sentence_ids, array_to_string(g, ';') AS licenses, n_known, CAST(len(regexp_extract_all(m, ';[A-Z0-9_]+;')) AS BIGINT) AS n_unused, len(g) > 0 AS has_license FROM e
"""


QUERIES = {"op3_license_scan": op3_license_scan}
ORACLES = {"op3_license_scan": _sql()}
