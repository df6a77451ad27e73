"""Quality rules, line dedup, licences, sharding and mixing: SQL on the small tables, then odd cases."""

import hashlib
import re
import textwrap
from collections import Counter

import pytest
import xxhash
from compare import SF, assert_equal
from pyspark.sql import functions as F

from tessella.llm import licenses, linededup, mixing, quality, registry, sharding

SQL = registry.oracle_sql()
WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(name, spark, sf_dir, duck):
    assert_equal(registry.queries()[name](spark, sf_dir), duck, SQL[name])


def brute_repeats(words):
    w = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(w)
    return len({i + k for i, x in enumerate(w) if n[x] > 1 for k in range(8)})


def test_quality_counts(make_docs, odd_rows):
    text = " ".join(["a b c d e f g h i"] * 3 + [f"w{i}" for i in range(9)])
    rows = [*odd_rows, (20, text), (21, "# x & <y>\nsame line\nother\nsame line\n\n")]
    got = quality.quality_rules(make_docs(rows)).collect()
    assert len(got) == len(rows)
    want = {t: WORD.findall(t or "") for t in {r[1] for r in rows}}
    for i, t, *_ in rows:
        w = want[t]
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        expect = (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), brute_repeats(w))
        assert expect in {(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got if r.doc_id == i}
    assert all(not r.kept for r in got if r.base_failed)
    kept = quality.passing(make_docs(rows))
    assert kept.columns == make_docs([]).columns and kept.count() == sum(r.kept for r in got)


def test_quality_keeps_prose_and_drops_junk(make_docs):
    clean = " ".join(f"the word{i} of and thing{i * 7}" for i in range(30)) + "."
    junk = " ".join(f"WORD{i}!!" for i in range(60))
    table = " | ".join(f"cell{i}" for i in range(60))
    italian = " ".join(f"la parola{i} non è per cosa{i * 7}" for i in range(30)) + "."
    russian = " ".join(f"слово{i} и дело{i * 7}" for i in range(30)) + "."
    kept = {r.doc_id for r in quality.passing(make_docs([(1, clean), (2, junk), (3, table), (4, "too short"), (5, None), (6, italian), (7, russian)])).collect()}
    assert kept == {1, 6, 7}


def brute_lines(rows, long_words=50):
    """(id, text) in order -> remaining text."""
    seen, out = set(), []
    for _, t in rows:
        lines = (t or "").split("\n")
        held = [(i, x.strip(" \t\n\x0b\x0c\r")) for i, x in enumerate(lines) if WORD.search(x)]
        gone = set()
        for k in range(len(held)):
            for m in (1, 2, 3):
                w = held[k : k + m]
                if len(w) == m and (m == 3 or sum(len(WORD.findall(x)) for _, x in w) >= long_words):
                    key = tuple(x for _, x in w)
                    if key in seen:
                        gone |= {i for i, _ in w}
                    seen.add(key)
        out.append(t if not gone else "\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


def test_line_dedup(make_docs, odd_rows):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(10, "a\nb\n\nc\nd\ne"), (11, "x\nb \nc\n  d\ny\nz"), (12, "q\n" + long + "\nr"), (13, "s\n" + long + "\nt"), (14, "a\na\na\na\na\na"), (15, "b\nc"), (16, "a\nb\nc\nd\ne")]
    got = {r["__row"].doc_id: r.kept_text for r in linededup.dedup_lines(make_docs(rows)).collect()}
    assert [got[i] for i, _ in rows] == brute_lines(rows)
    assert got[16] == "" and got[13] == "s\nt" and got[15] == "b\nc"
    odd = linededup.dedup_lines(make_docs(odd_rows))
    assert odd.count() == len(odd_rows) and linededup.dedup_lines(make_docs([])).count() == 0
    by = {(r["__row"].doc_id, r["__row"].text): r for r in odd.collect()}
    assert by[(3, None)].kept_text is None and by[(3, None)].line_dedup.n_lines == 0
    assert by[(8, "line\n" * 500)].kept_text == "line\n"
    # both rows of document 2 with the same text are one document and keep or lose alike
    assert {r.kept_text for r in odd.collect() if r["__row"].doc_id == 2 and r["__row"].text == odd_rows[1][1]} == {""}


def test_one_very_long_document_and_a_hot_passage(make_docs):
    """A document of 20 MB, and a third of the others with the same passage: windows carry numbers, no texts."""
    passage = "\n".join(f"line {k} of what many share" for k in range(6))
    long = "\n".join(f"row {k} " + "x" * 60 for k in range(290_000))
    rows = [(0, long)] + [(i, f"head {i}\n{passage if i % 3 == 0 else f'own {i}'}\ntail {i}") for i in range(1, 600)]
    docs = make_docs(rows)
    held = linededup.windows(docs.select(F.col("doc_id").alias("__id"), F.col("text").alias("__text")))
    assert {t for _, t in held.dtypes} <= {"bigint", "array<int>"}
    got = {r.doc_id: r.n for r in linededup.dedup_lines(docs).select("__row.doc_id", F.col("line_dedup.n_removed").alias("n")).collect()}
    assert got == {i: 6 if i % 3 == 0 and i > 3 else 0 for i in range(600)}


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program.  If not, see <https://www.gnu.org/licenses/>."""
GPL2 = GPL.replace("free software:", "free software;").replace("Foundation, either version 3", "Foundation; either version 2")
LGPL = GPL2.replace("program", "library").replace("General Public", "Lesser General Public").replace("version 2", "version 2.1")
BSD3 = """Copyright (c) 2020, A. Person
All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED."""
BSD2 = "\n\n".join(p for p in BSD3.split("\n\n") if not p.startswith("3."))
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
NOTICES = {"MIT": MIT, "Apache-2.0": APACHE, "GPL-3.0-or-later": GPL, "GPL-2.0-or-later": GPL2, "LGPL-2.1-or-later": LGPL, "BSD-3-Clause": BSD3, "BSD-2-Clause": BSD2, "ISC": ISC, "MPL-2.0": MPL}


def layouts(text):
    """A notice as it stands in files: a line a paragraph, wrapped narrow and wide, in comments, after a heading without a full stop, on one line."""
    wrapped = ["\n\n".join(textwrap.fill(p, n) for p in text.split("\n\n")) for n in (200_000, 79, 30)]
    comments = ["\n".join(m + x for x in wrapped[1].split("\n")) for m in (" * ", "# ", "// ")]
    return [*wrapped, *comments, "/*\n" + comments[0] + "\n */\nint x;", "The License\n\nCopyright (c) 2020 A. Person\n" + wrapped[1] + "\nsome code", " ".join(text.split()), wrapped[1].replace("\n", "\r\n")]


def test_hot_windows_and_shuffled_documents_change_nothing(make_docs, monkeypatch):
    passage = "one line\nanother line\nthe third line"
    rows = [(i, f"start {i}\n{passage}\nend {i % 700}\n{passage if i % 2 else 'x'}\nlast {i % 50}") for i in range(1500)]
    want = brute_lines(rows)
    for most in (linededup.MOST_COVERED, 10):
        monkeypatch.setattr(linededup, "MOST_COVERED", most)
        got = {r["__row"].doc_id: r.kept_text for r in linededup.dedup_lines(make_docs(rows)).collect()}
        assert [got[i] for i, _ in rows] == want


def test_licenses(make_docs, odd_rows):
    assert all(any(k in s for k in licenses.KEYS) for s in licenses.known())
    rows = [*odd_rows, (20, "Text.\nLicensed under the Apache License, Version 2.0.\nMore. All rights reserved."), (22, MIT.split("\n\n")[1]), (23, "I got a license to drive."), (24, "It is not released under the MIT License")]
    got = licenses.scan_licenses(make_docs(rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[20].licenses == "Apache-2.0;All-Rights-Reserved" and by[20].sentence_ids == "NOTICE_APACHE_2_0;ALL_RIGHTS"
    assert by[22].licenses == "" and by[22].n_known == by[22].n_unused == 1
    assert not by[23].has_license and not by[24].has_license and by[3].sentence_ids == ""
    assert licenses.scan_licenses(make_docs([])).count() == 0


def test_every_known_sentence_is_found(make_docs):
    """Alone, wrapped at every word, and amid other sentences."""
    rows, want = [], {}
    sentences = [(k, s) for k, s in licenses.SENTENCES] + [(licenses.notice(n), f"{o} {x}") for n, *names in licenses.NAMES for x in names for o in licenses.OPENINGS]
    for k, s in sentences:
        for t in (s, s + ".", s.replace(" ", "\n"), f"It begins here. {s}. It ends.", f"first line\n{s}\nlast line"):
            want[len(rows)] = k
            rows.append((len(rows), t))
    got = {r.doc_id: r.sentence_ids for r in licenses.scan_licenses(make_docs(rows)).collect()}
    assert got == want
    used = {i for _, ids in licenses.RULES for i in ids}
    assert used <= set(licenses.known().values())


def test_standard_notices(make_docs):
    rows, want = [], {}
    for name, text in NOTICES.items():
        for t in layouts(text):
            want[len(rows)] = name
            rows.append((len(rows), t))
    got = {r.doc_id: r.licenses.removesuffix(";All-Rights-Reserved") for r in licenses.scan_licenses(make_docs(rows)).collect()}
    assert {i: (x, rows[i][1][:300]) for i, x in got.items() if x != want[i]} == {}


ASF = """Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements.  See the NOTICE file distributed with this work for additional information regarding copyright ownership.  The ASF licenses this file to You under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.  You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.  See the License for the specific language governing permissions and limitations under the License."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software."""
BOOST = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"""
GPL3_TEXT = """GNU GENERAL PUBLIC LICENSE
Version 3, 29 June 2007

Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.

Preamble

The GNU General Public License is a free, copyleft license for software and other kinds of works."""
GPL2_TEXT = """GNU GENERAL PUBLIC LICENSE
Version 2, June 1991

Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.

The licenses for most software are designed to take away your freedom to share and change it.  By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users."""
MPL_TEXT = """Mozilla Public License Version 2.0

1. Definitions

1.1. "Contributor"
    means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software."""
KERNEL = GPL2.replace("either version 2 of the License, or (at your option) any later version.", "version 2 of the License.")
BSD3_AUTHOR = BSD3.replace("Neither the name of the copyright holder nor the names of its contributors may be used", "The name of the author may not be used")
BSD4 = BSD3.replace("3. Neither", "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization.\n\n4. Neither").replace("BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "BY A. PERSON ``AS IS'' AND")
BSD_ODD = BSD3.replace("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse", "3. You must buy the author a drink and must not endorse")
held = lambda text, who: text.replace("the copyright holder nor", f"{who} nor").replace("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", f"{who.upper()} AND CONTRIBUTORS")
MORE_NOTICES = [
    ("Apache-2.0", ASF),
    ("Apache-2.0", ASF.replace("The ASF licenses", "Some Company B.V. licenses").split("ownership.  ")[1]),
    ("Apache-2.0", "you may not use this file except in compliance with the License." + APACHE.split("with the License.", 1)[1]),
    ("BSD-3-Clause", held(BSD3, "Google Inc.")),
    ("BSD-3-Clause", held(BSD3, "the University of California, Berkeley")),
    ("BSD-3-Clause", held(BSD3, "The FreeBSD Project, Inc. (and others)").replace("its contributors", "other contributors")),
    ("BSD-3-Clause", BSD3_AUTHOR),
    ("BSD-3-Clause", BSD3.replace("3. Neither", "* Neither").replace("2. Red", "* Red").replace("1. Red", "* Red")),
    ("BSD-2-Clause", held(BSD2, "Example Org.")),
    ("BSD-4-Clause", BSD4.replace("``AS IS'' AND \"AS IS\" AND", "``AS IS'' AND")),
    ("", BSD_ODD),
    ("GPL-2.0", KERNEL),
    ("GPL-2.0", KERNEL.replace("Foundation; version 2 of the License", "Foundation, version 2")),
    ("GPL-2.0-or-later", GPL2.replace("version 2 of the License, or", "version 2, or")),
    ("GPL-2.0-or-later", GPL2.replace("Foundation; either", "Foundation, either")),
    ("GPL-3.0-or-later", GPL.replace("Foundation, either", "Foundation; either")),
    ("LGPL-3.0-or-later", GPL.replace("General Public", "Lesser General Public")),
    ("AGPL-3.0-or-later", GPL.replace("General Public", "Affero General Public")),
    ("LGPL-2.1-or-later", LGPL.replace("Foundation; either", "Foundation, either")),
    ("LGPL-2.0-or-later", GPL2.replace("program", "library").replace("General Public", "Library General Public")),
    ("ISC", ISC.replace("and/or", "and")),
    ("0BSD", ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")),
    ("MIT-0", MIT.replace(", subject to the following conditions:", ".").replace(MIT.split("\n\n")[1] + "\n\n", "")),
    ("Zlib", ZLIB),
    ("BSL-1.0", BOOST),
    ("GPL-3.0", GPL3_TEXT),
    ("GPL-2.0", GPL2_TEXT),
    ("MPL-2.0", MPL_TEXT),
    ("Apache-2.0;MIT", "// SPDX-License-Identifier: MIT OR Apache-2.0\nfn main() {}"),
    ("Apache-2.0;MIT", "# SPDX-License-Identifier: (MIT OR Apache-2.0)\nx"),
    ("GPL-2.0", "/* SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note */\n#include"),
    ("GPL-2.0-or-later", "/* SPDX-License-Identifier: GPL-2.0+ */\n#include"),
    ("BSD-3-Clause;GPL-2.0-or-later;MIT", "SPDX-License-Identifier: GPL-2.0-or-later AND (MIT OR BSD-3-Clause)\n"),
    ("MIT", "This project is licensed under the MIT License - see the LICENSE file for details."),
    ("MIT", "Licensed under the MIT License, see LICENSE.md."),
    ("Apache-2.0", "Released under the Apache License 2.0 \u2014 enjoy."),
    ("", "Neither the name nor the licence is known. You may redistribute it under version 2 of the agreement."),
]


def test_more_notices(make_docs):
    rows, want = [], {}
    for names, text in MORE_NOTICES:
        wide = "SPDX" in text or "\n" not in text
        for t in [text] if wide else layouts(text):
            # On one line nothing ends a heading.
            if text in (BOOST, GPL3_TEXT, GPL2_TEXT, MPL_TEXT) and "\n" not in t:
                continue
            want[len(rows)] = set(names.split(";"))
            rows.append((len(rows), t))
    got = {r.doc_id: set(r.licenses.removesuffix("All-Rights-Reserved").rstrip(";").split(";")) for r in licenses.scan_licenses(make_docs(rows)).collect()}
    assert {i: (x, want[i], rows[i][1][:1500]) for i, x in got.items() if x != want[i]} == {}


def test_longer_rules_come_first(spark):
    seq = lambda *ids: ";" + ";".join(ids) + ";"
    m = lambda s: spark.range(1).select(licenses.matched(F.lit(s))).first()[0].strip(";")
    three = m(seq("BSD_GRANT", "BSD_SOURCE", "BSD_BINARY", "BSD_THIRD", "BSD_NAME"))
    assert len(three) == 1 and licenses.RULES[ord(three) - 0xE000][0] == "BSD-3-Clause"
    assert m(seq("NOTICE_MIT", "NOTICE_MIT")) == m(seq("NOTICE_MIT")) * 2


def test_lookup_table():
    t = sharding.lookup_table(sharding.SHARDS[:7], 1009)
    n = Counter(t)
    assert set(n) == set(range(7)) and max(n.values()) - min(n.values()) <= 1
    # brute force: shards in turn walk their own permutation
    from hashlib import sha256

    perm = []
    for s in sharding.SHARDS[:7]:
        h = sha256(s.encode()).digest()
        a, b = int.from_bytes(h[:8], "big") % 1009, int.from_bytes(h[8:16], "big") % 1008 + 1
        perm.append(iter([(a + j * b) % 1009 for j in range(1009)]))
    want = [-1] * 1009
    while -1 in want:
        for k in range(7):
            slot = next((c for c in perm[k] if want[c] < 0), None)
            if slot is not None:
                want[slot] = k
    assert t == want
    fewer = sharding.lookup_table(sharding.SHARDS[:6], 1009)
    assert sum(a != b for a, b in zip(t, fewer, strict=True)) < 1009 * 0.3
    with pytest.raises(ValueError):
        sharding.lookup_table(())


def test_placement(spark, make_docs, odd_rows, tmp_path):
    placed = sharding.place(make_docs(odd_rows), F.col("doc_id"))
    table = sharding.lookup_table()
    rows = placed.collect()
    # A slot is the id's text hashed; a null id's slot is that of the seed alone.
    slot = lambda i: xxhash.xxh64_intdigest("" if i is None else str(i), 42) if i is not None else 42
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    assert len(rows) == len(odd_rows) and all(r.slot == signed(slot(r["__row"].doc_id)) % sharding.TABLE_SIZE and table[r.slot] == r.shard for r in rows)
    assert [r["__row"].shard for r in rows] == ["h"] * len(rows)
    assert "BroadcastHashJoin" in placed._jdf.queryExecution().toString()
    sharding.write_shards(placed, f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == len(odd_rows)
    got = sharding.op5_shard_lookup(spark, SF).collect()
    assert len({r.doc_id for r in got}) == len(got) and len({r.shard for r in got}) > 40


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        level = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if level[s] > most * sizes[s]]
        if not over:
            return {s: most * sizes[s] if s in capped else level[s] for s in names}
        capped |= set(over)


def mix_rows(odd_rows):
    return [*odd_rows, *[(100 + i, " ".join(["w"] * (i % 13 + 1)), "en", f"src{i % 4}") for i in range(300)], (900, "tiny", "en", "zz"), (901, "w " * 4000, "en", "a")]


def test_targets_and_taken(make_docs, odd_rows, monkeypatch):
    monkeypatch.setattr(mixing, "LEAST_BLOCK", 64)
    rows = mix_rows(odd_rows)
    docs = make_docs(rows)
    m = mixing.mix(docs).select("key", "__row.doc_id", F.col("__row.source").alias("source"), "size", "target", "copies", "copy", "skip", "words", "shard").collect()
    sizes = Counter()
    for _, t, *rest in rows:
        sizes[(*rest, None, None)[1]] += len(WORD.findall(t or ""))
    want = brute_targets(sizes)
    taken, pieces = Counter(), {}
    for r in m:
        assert r.target == pytest.approx(want[r.source])
        taken[r.source] += r.words or 0
        assert (r.words is None) == (r.copy is None) == (r.shard is None)
        if r.copy is not None:
            pieces.setdefault((r["key"], r.copy), []).append((r.skip, r.words, r.size))
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in want)
    # A copy's pieces follow one another from its first word on.
    for ps in pieces.values():
        at = 0
        for skip, words, size in sorted(ps):
            assert skip == at and words > 0
            at += words
        assert at <= size
    assert len({r["key"] for r in m}) == len(rows)
    assert all(max([-1, *[c for k, c in pieces if k == r["key"]]]) + 1 == r.copies <= 3 for r in m)
    again = mixing.mix(make_docs(rows[::-1])).select("__row.doc_id", "copy", "skip", "words", "shard", "shuffle_key").collect()
    first = mixing.mix(docs).select("__row.doc_id", "copy", "skip", "words", "shard", "shuffle_key").collect()
    assert sorted(map(str, again)) == sorted(map(str, first))
    # Slices only divide the work.
    monkeypatch.setattr(mixing, "SLICE_DIGITS", 1)
    assert sorted(map(str, mixing.mix(docs).select("__row.doc_id", "copy", "skip", "words", "shard", "shuffle_key").collect())) == sorted(map(str, first))
    whole = mixing.mix(docs, cut="whole").collect()
    assert all(r.words is None or r.words == r.size for r in whole)
    assert mixing.mix(make_docs([])).count() == 0


def brute_tree(quotas, shards, seed="mix"):
    """{source: blocks} -> {(source, block): shard}: quotas split down the tree by an urn, then each source's permuted blocks dealt by the leaves' quotas."""
    text = lambda s: "" if s is None else s
    order = lambda *parts: hashlib.md5(":".join(str(text(p)) for p in parts).encode()).hexdigest()
    nodes = {0: dict(quotas)}
    for level in range((shards - 1).bit_length()):
        below = {}
        for shard, node in nodes.items():
            urn = sorted((order(f"{seed}/{level}", shard, s, i), s is None, text(s), i, s) for s, n in node.items() for i in range(1, n + 1))
            left = Counter(u[-1] for u in urn[: (len(urn) + (shard + level) % 2) // 2])
            below[2 * shard] = dict(left)
            below[2 * shard + 1] = {s: n - left[s] for s, n in node.items()}
        nodes = below
    out = {}
    for s, n in quotas.items():
        blocks = iter(sorted(range(n), key=lambda b: (order(f"{seed}/block", s, b), b)))
        for shard in sorted(nodes):
            for _ in range(nodes[shard].get(s, 0)):
                out[s, next(blocks)] = shard
    return out


def test_tree_splits_quotas_and_blocks_are_drawn(spark):
    quotas = {"a": 700, "b": 200, None: 123}
    q = spark.createDataFrame(list(quotas.items()), "source string, n_blocks bigint")
    tree = mixing.splitting_tree(q, 8)
    got = {(r.source, r.block): r.shard for r in mixing.draw_blocks(tree).collect()}
    assert got == brute_tree(quotas, 8)
    by = Counter(got.values())
    assert sum(by.values()) == 1023 and set(by.values()) <= {127, 128}
    # Exact quotas at every leaf, near the mixture of the whole but not equal to it.
    share = Counter((s, k) for (s, _), k in got.items())
    assert {(r.source, r.shard): r.n_blocks for r in tree.collect()} == share
    assert all(60 <= share["a", k] <= 110 for k in range(8)) and len({share["a", k] for k in range(8)}) > 2


def test_the_tree_decides_what_each_shard_gets(make_docs, odd_rows, monkeypatch):
    """The shards in the mix are those of the brute-force tree over the blocks; without the tree's quotas they aren't."""
    monkeypatch.setattr(mixing, "LEAST_BLOCK", 64)
    m = [r for r in mixing.mix(make_docs(mix_rows(odd_rows))).collect() if r.copy is not None]
    quotas = Counter()
    for s, b in {(r["__row"].source, r.block) for r in m}:
        quotas[s] = max(quotas[s], b + 1)
    tree = brute_tree(dict(quotas), mixing.SHARDS)
    assert [r.shard for r in m] == [tree[r["__row"].source, r.block] for r in m]
    assert len({r.shard for r in m}) > 10
    dealt = {k: b % mixing.SHARDS for b, k in enumerate(sorted(tree, key=str))}
    assert [r.shard for r in m] != [dealt[r["__row"].source, r.block] for r in m]


def test_pieces_are_written_shard_by_shard(spark, make_docs, tmp_path):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(i % 9 + 1)), "en", f"s{i % 3}") for i in range(200)]
    m = mixing.mix(make_docs(rows))
    mixing.write_mix(m, f"file://{tmp_path}/out")
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert back.count() == m.filter("copy IS NOT NULL").count()
    text = back.select("row.text", mixing.piece_text(F.col("row.text"), F.col("piece.skip"), F.col("piece.words")).alias("p"), "piece.skip", "piece.words").collect()
    assert all(r.p.split() == r.text.split()[r.skip : r.skip + r.words] for r in text)


@pytest.mark.parametrize("name", ["op3_license_scan", "op5_shard_lookup", "op7_line_dedup", "op9_mix_sources", "op10_quality_rules"])
def test_native_plans_hold_no_python(name, spark, sf_dir):
    text = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("ArrowEval|BatchEval|InPandas|InArrow|CartesianProduct|ExistingRDD", text)
