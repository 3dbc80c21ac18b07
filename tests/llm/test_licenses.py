import random
import re
import time

import pytest

from tidelog.llm import licenses as lic
from tidelog.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def plain(text):
    words = WORD.findall((text or "").translate(LOWER))
    places, labels = [], set()
    for phrase, label in ((["mit", "license"], "mit"), (["apache", "license"], "apache"), (["general", "public", "license"], "gpl")):
        for i in range(len(words)):
            if words[i : i + len(phrase)] == phrase:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op7_license_scan"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain(texts[r["doc_id"]])
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


def test_base_places():
    for text in ("MIT license mit-LICENSE, the mit license", "apache license general public license", "mitlicense mit license é mit license", "general public public license"):
        words = text.encode().translate(lic.ALNUM).split()
        n, first, last, labels = lic.base_places(words)
        assert (len(words), n, first, last, ",".join(sorted(labels))) == plain(text)


def labels(text):
    return [x[2] for x in lic.detect(text.lower().encode())]


def test_signatures():
    assert len(lic.signature_rules()) > 200
    assert labels("Licensed under the Apache License, Version 2.0.") == ["apache-2.0"]
    assert labels("Licensed under CC BY-NC 4.0.") == ["cc-by-nc-4.0"]
    assert labels("licensed under the GNU General Public License, version 3.") == ["gpl-3.0"]
    assert labels("GNU Lesser General Public License v2.1 or any later version") == ["lgpl-2.1-or-later"]
    assert labels("SPDX-License-Identifier: BSD-3-Clause") == ["bsd-3-clause"]
    assert labels("Released under the MIT License.") == ["mit"]
    assert labels("https://creativecommons.org/licenses/by-sa/3.0/") == ["cc-by-sa-3.0"]
    assert labels("Wir gehen mit dem Hund; no terms here") == []


def test_every_rule_sits_behind_its_gates():
    # a match holds its keyword, and its keyword or text holds a trigger
    keywords, by_keyword = lic._compiled()
    for k in keywords:
        for _, rule, _ in by_keyword[k]:
            plain = rule.regex.replace(rb"\.", b".")
            inside = any(t in k for t in lic.TRIGGERS) or k == b"cc" or any(t in plain for t in (b"licen", b"warrant", b"rights reserved", *lic.TRIGGERS))
            assert inside, rule


def plain_detections(lower):
    """All rules on the text, without gates, and suppression by all pairs."""
    found = []
    for order, rule in enumerate(lic.signature_rules()):
        found += [(rule.priority, m.start() - m.end(), order, m.start(), m.end(), rule.label) for m in re.finditer(lic.wrapped(rule.regex), lower, re.S)]
    kept = []
    for priority, _, _, a, b, label in sorted(found):
        if not any((x <= a and b <= y) or (p < priority and a <= x and y <= b) for x, y, _, p in kept):
            kept.append((a, b, label, priority))
    return sorted(kept)


def test_detections_labels_and_score_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    some = [i for i, t in texts.items() if i % 40 == 0 or any(w in t.lower() for w in ("licen", "cc by", "rights", "warrant", "gpl"))]
    out = {r["doc_id"]: r for r in QUERIES["op7_license_scan"](spark, sf).collect()}
    for i in some:
        lower = texts[i].encode().translate(lic.LOWER)
        hits = plain_detections(lower)
        base = set(filter(None, out[i]["base_labels"].split(",")))
        assert [(d["start"], d["stop"], d["label"], d["priority"]) for d in out[i]["detections"]] == hits
        assert out[i]["labels"] == ",".join(sorted(base | {h[2] for h in hits}))
        miss = (1 - lic.CONFIDENCE[-1]) if base else 1.0
        for h in hits:
            miss *= 1 - lic.CONFIDENCE[h[3]]
        assert out[i]["score"] == pytest.approx(1 - miss)
    assert sum(bool(out[i]["detections"]) for i in some) > 20


def test_suppression_against_all_pairs():
    rng = random.Random(6)
    for _ in range(400):
        found = sorted({(rng.randrange(4), -(n := rng.randint(1, 12)), k, (a := rng.randrange(30)), a + n, "x") for k in range(rng.randrange(25))})
        kept = []
        for priority, _, _, a, b, label in found:
            if not any((x <= a and b <= y) or (p < priority and a <= x and y <= b) for x, y, _, p in kept):
                kept.append((a, b, label, priority))
        assert lic.suppressed((a, b, label, p) for p, _, _, a, b, label in found) == sorted(kept)


def test_very_many_detections_take_no_longer_each():
    began = time.perf_counter()
    assert len(lic.detect(b"mit license; gpl-3.0 and apache license 2.0, all rights reserved. " * 8_000)) == 32_000
    assert time.perf_counter() - began < 20


def test_suppression_keeps_the_best():
    hits = lic.detect(b"apache license 2.0, see the license for details; mit license")
    spans = [(a, b) for a, b, _, _ in hits]
    assert not any(x != y and x[0] <= y[0] and y[1] <= x[1] for x in spans for y in spans)


def test_awkward(spark, awkward, nothing):
    out = {r["doc_id"]: r for r in lic.scan(awkward).collect()}
    assert out[1]["n_words"] == 0 and out[1]["labels"] == "" and out[1]["score"] == 0 and out[2]["first_word"] is None
    assert lic.scan(awkward).count() == 9 and lic.scan(nothing).count() == 0


MIT = """Copyright (c) 2020 A. Nobody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS.
"""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software. If you use this software
   in a product, an acknowledgment in the product documentation would be
   appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright
   notice, this list of conditions and the following disclaimer.
"""
GNU = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU {} as published by
the Free Software Foundation, either version {} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
"""


def commented(text, mark):
    return "".join(f"{mark} {line}\n" for line in text.splitlines())


def test_whole_notices_as_wrapped():
    texts = [
        (MIT, {"mit", "no-warranty"}), (ISC, {"isc"}), (ZLIB, {"zlib"}), (MPL, {"mpl-2.0"}), (APACHE, {"apache-2.0"}), (BSD, {"bsd"}),
        (ISC.replace(", provided that the above\ncopyright notice and this permission notice appear in all copies", ""), {"bsd-0-clause"}),
        ("Released into the public\ndomain.\n", {"public-domain"}), ("All rights\nreserved.", {"proprietary"}),
        ("https://opensource.org/licenses/MIT", {"mit"}), ("https://www.gnu.org/licenses/", {"gpl"}), ("CC0\n1.0 Universal", {"cc0-1.0"}), ("https://unlicense.org/", {"unlicense"}),
        ("See the file\nLICENSE for details.", {"license-reference"}), ('THE WORK IS "AS IS", WITHOUT WARRANTIES', {"no-warranty"}),
    ]
    for text, expected in texts:
        for shape in (text, text.replace("\n", "\r\n"), commented(text, " *"), commented(text, "//"), commented(text, "#")):
            assert set(labels(shape)) == expected, shape


def test_gnu_headers_as_wrapped():
    for name, version, label in (("General Public License", "2", "gpl-2.0"), ("General Public License", "3", "gpl-3.0"), ("Affero General Public License", "3", "agpl-3.0"), ("Lesser General Public License", "2.1", "lgpl-2.1"), ("Library General Public\nLicense", "2", "lgpl-2.0")):
        text = GNU.format(name, version)
        for shape in (text, commented(text, " *"), commented(text, "#")):
            assert set(labels(shape)) == {f"{label}-or-later", "no-warranty"}, shape
        only = text.replace(", or\n(at your option) any later version.", ".")
        assert set(labels(only)) == {label, "no-warranty"}
    assert labels("under the terms of version 2 of the GNU General\nPublic License") == ["gpl-2.0"]
    assert labels("under the terms of the GNU Free Documentation License, Version 1.3\nor any later version published") == ["gfdl-1.3-or-later"]
    # another sentence says nothing of this licence
    assert "gpl-2.0-or-later" not in labels("GNU General Public License, version 2.\nThe manual has version 7. Use it\nor any later one.")


def test_versions_after_the_name():
    for text, label in (
        ("Mozilla Public License Version\n1.1", "mpl-1.1"), ("Mozilla Public License, v. 2.0", "mpl-2.0"), ("licensed under the Mozilla Public License version 1.0", "mpl-1.0"), ("Mozilla Public License", "mpl-2.0"),
        ("Eclipse Public License - v 1.0", "epl-1.0"), ("Eclipse Public License - v 2.0", "epl-2.0"), ("European Union Public Licence v. 1.2", "eupl-1.2"), ("European Union Public Licence v. 1.1", "eupl-1.1"),
        ("COMMON DEVELOPMENT AND DISTRIBUTION LICENSE (CDDL) Version 1.1", "cddl-1.1"), ("Common Public License Version 1.0", "cpl-1.0"), ("The Artistic License 1.0", "artistic-1.0"), ("Artistic License 2.0", "artistic-2.0"),
        ('Academic Free License ("AFL") v. 2.1', "afl-2.1"), ("Open Software License version 3.0", "osl-3.0"), ("SIL OPEN FONT LICENSE Version 1.1", "ofl-1.1"), ("Apache License\n   Version 2.0, January 2004", "apache-2.0"), ("Apache Software License, Version 1.1", "apache-1.1"),
        ("Creative Commons Attribution-ShareAlike\n4.0 International", "cc-by-sa-4.0"), ("the Common Public\n * License, version 1.0", "cpl-1.0"),
    ):
        assert labels(text) == [label], text
    assert "mit" not in labels(MIT.replace("of this software and", "of the Font Software and").replace("a copy\n", "\na copy "))
