"""License scans: ordered signature rules behind a keyword prefilter.

A rule is a regex with a label, a priority and a keyword that every match of it contains.  A text
without any trigger runs no regex, and a triggered text only those rules whose keyword it
holds.  A space of a rule is any white space, and a line end with the comment marks that the next line begins with, so
texts match as they are wrapped.  Of overlapping detections, one that lies inside another of the same or a better
priority, or around another of a better one, is suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ALNUM, LOWER, per_worker, rows, utf8

PHRASES = ((b"mit license", "mit"), (b"apache license", "apache"), (b"general public license", "gpl"))
TRIGGERS = (b"licen", b"creative", b"cc0", b"cc by", b"cc-by", b"gpl", b"gfdl", b"public domain", b"rights reserved", b"warrant", b"redistribut", b"apache.org", b"free of charge", b"permission to use", b"altered source versions", b"mozilla.org/mpl",
            b"unencumbered", b"this product includes", b"advertising", b"endorse or promote", b"what the fuck you want", b"without fee", b"royalty", b"toolkit", b"take away your freedom", b"independent jpeg", b"verbatim copies",
            b"managed service", b"as a service", b"non-production use", b"retain this notice", b"waived all copyright", b"any medium or format", b"sell the software", b"interacting with it remotely", b"as is", b"jasper")
#: What a space of a rule stands for, and what gates read as one space.
GAP = rb"(?:[ \t\r]*\n[\s*#/;%|>]*|[ \t\r]+)"
WRAP = re.compile(rb"[ \t\r]*\n[\s*#/;%|>]*|[ \t\r]{2,}|[\t\r]")
#: Confidence of a detection by priority, best first; base phrases alone count as the last.
CONFIDENCE = (0.99, 0.95, 0.85, 0.7, 0.5)


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    keyword: bytes
    regex: bytes


#: label, regex of the name in lower case, literal that the name holds.
NAMES = (
    ("mit", rb"(?:mit|expat)(?:/x11)?", b""),
    ("mit-0", rb"mit[ -]no attribution|mit-0", b"mit"),
    ("x11", rb"x11", b"x11"),
    ("isc", rb"isc|internet systems consortium", b""),
    ("apache-1.0", rb"apache(?: software)?(?:[ -]1\.0)", b"apache"),
    ("apache-1.1", rb"apache(?: software)?(?:[ -]1\.1)", b"apache"),
    ("apache-2.0", rb"apache(?: software)?(?:[ -]?v?2(?:\.0)?)", b"apache"),
    ("bsd-1-clause", rb"(?:1|one)[- ]clause bsd|bsd[- ]1[- ]clause", b"bsd"),
    ("bsd-2-clause", rb"(?:2|two)[- ]clause bsd|bsd[- ]2[- ]clause|simplified bsd|freebsd", b"bsd"),
    ("bsd-3-clause", rb"(?:3|three)[- ]clause bsd|bsd[- ]3[- ]clause|(?:new|modified|revised) bsd", b"bsd"),
    ("bsd-4-clause", rb"(?:4|four)[- ]clause bsd|bsd[- ]4[- ]clause|original bsd", b"bsd"),
    ("bsd-0-clause", rb"(?:0|zero)[- ]clause bsd|bsd[- ]0[- ]clause|0bsd", b"bsd"),
    ("mpl-1.0", rb"mozilla public[ -]1\.0|mpl[ -]?v?1\.0", b""),
    ("mpl-1.1", rb"mozilla public[ -]1\.1|mpl[ -]?v?1\.1", b""),
    ("mpl-2.0", rb"mozilla public(?:[ -]2\.0)?|mpl[ -]?v?2(?:\.0)?", b""),
    ("epl-1.0", rb"eclipse public[ -]1\.0|epl[ -]?v?1(?:\.0)?", b""),
    ("epl-2.0", rb"eclipse public[ -]2\.0|epl[ -]?v?2(?:\.0)?", b""),
    ("eupl-1.1", rb"european union public[ -]1\.1|eupl[ -]?v?1\.1", b""),
    ("eupl-1.2", rb"european union public(?:[ -]1\.2)?|eupl[ -]?v?1\.2", b""),
    ("cddl-1.0", rb"common development and distribution|cddl(?:[ -]?v?1\.0)?", b""),
    ("cddl-1.1", rb"cddl[ -]?v?1\.1", b"cddl"),
    ("cpl-1.0", rb"common public|cpl[ -]?v?1\.0", b""),
    ("ms-pl", rb"microsoft public|ms-pl", b""),
    ("ms-rl", rb"microsoft reciprocal|ms-rl", b""),
    ("bsl-1.0", rb"boost software|bsl-1\.0", b""),
    ("zlib", rb"zlib(?:/libpng)?", b"zlib"),
    ("libpng", rb"libpng", b"libpng"),
    ("artistic-1.0", rb"artistic[ -]1\.0", b"artistic"),
    ("artistic-2.0", rb"artistic(?:[ -]2\.0)?", b"artistic"),
    ("afl-3.0", rb"academic free(?:[ -]3\.0)?|afl[ -]?v?3\.0", b""),
    ("osl-3.0", rb"open software(?:[ -]3\.0)?|osl[ -]?v?3\.0", b""),
    ("python-2.0", rb"python software foundation|psf(?:-2\.0)?", b""),
    ("postgresql", rb"postgresql", b"postgresql"),
    ("php-3.01", rb"php(?:[ -]3\.0?1?)?", b"php"),
    ("ruby", rb"ruby", b"ruby"),
    ("openssl", rb"openssl", b"openssl"),
    ("openldap", rb"openldap public|oldap-2\.8", b""),
    ("unlicense", rb"the un", b""),
    ("wtfpl", rb"wtfpl|do what the fuck you want to public", b""),
    ("ncsa", rb"ncsa|university of illinois", b""),
    ("ofl-1.1", rb"sil open font|ofl[ -]?v?1\.1", b""),
    ("odbl-1.0", rb"open database|odbl(?:-1\.0)?", b""),
    ("odc-by-1.0", rb"open data commons attribution|odc-by(?:-1\.0)?", b""),
    ("pddl-1.0", rb"public domain dedication and|pddl(?:-1\.0)?", b""),
    ("vim", rb"vim", b"vim"),
    ("curl", rb"curl", b"curl"),
    ("w3c", rb"w3c(?: software)?", b"w3c"),
    ("ecl-2.0", rb"educational community(?:[ -]2\.0)?|ecl-2\.0", b""),
    ("upl-1.0", rb"universal permissive|upl-1\.0", b""),
    ("mulan-psl-2.0", rb"mulan permissive software|mulanpsl-2\.0", b""),
    ("sspl-1.0", rb"server side public|sspl(?:-1\.0)?", b""),
    ("busl-1.1", rb"business source|busl-1\.1", b""),
    ("elastic-2.0", rb"elastic(?:[ -]2\.0)?", b"elastic"),
    ("commons-clause", rb"commons clause", b"commons clause"),
    ("openrail-m", rb"(?:creativeml )?open ?rail(?:[+-]+m)?", b"rail"),
    ("llama-community", rb"llama [0-9.]* ?community", b"llama"),
    ("gemma", rb"gemma", b"gemma"),
    ("ijg", rb"independent jpeg group|ijg", b""),
    ("icu", rb"icu|unicode", b""),
    ("blueoak-1.0.0", rb"blue oak model|blueoak-1\.0\.0", b""),
)
#: Families that write the version after the name: label stem, name, versions.
FAMILIES = (
    ("mpl", rb"mozilla public", ("1.0", "1.1", "2.0")),
    ("epl", rb"eclipse public", ("1.0", "2.0")),
    ("eupl", rb"european union public", ("1.0", "1.1", "1.2")),
    ("cddl", rb"common development and distribution", ("1.0", "1.1")),
    ("cpl", rb"common public", ("1.0",)),
    ("artistic", rb"artistic", ("1.0", "2.0")),
    ("afl", rb"academic free", ("1.1", "1.2", "2.0", "2.1", "3.0")),
    ("osl", rb"open software", ("1.0", "1.1", "2.0", "2.1", "3.0")),
    ("ofl", rb"sil open font", ("1.0", "1.1")),
    ("apache", rb"apache(?: software)?", ("1.0", "1.1", "2.0")),
)
#: Between a family's name and its version, as in 'License (CDDL) - v 1.0'.
TO_VERSION = rb"(?: \([\"']?[a-z]+[\"']?\))?,?(?: -)? ?\(?(?:v(?:ersion|\.)? ?)?"
#: GNU family: label stem, name, short name, versions.
GNU = (
    ("agpl", rb"(?:gnu )?affero general public licen[sc]e", rb"agpl", ("3",)),
    ("lgpl", rb"(?:gnu )?(?:lesser|library) general public licen[sc]e", rb"lgpl", ("2", "2.1", "3")),
    ("gpl", rb"(?:gnu )?general public licen[sc]e", rb"gpl", ("1", "2", "3")),
    ("gfdl", rb"(?:gnu )?free documentation licen[sc]e", rb"gfdl", ("1.1", "1.2", "1.3")),
)
CC_KINDS = ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd")
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
CC_WORDS = {"by": rb"attribution", "sa": rb"share ?alike", "nd": rb"no ?deriv(?:ative)?s?(?: works)?", "nc": rb"non ?commercial"}
NOTICES = (
    ("mit", 1, b"free of charge", rb"permission is hereby granted, free of charge, to any person obtaining a copy(?! of (?:the (?:unicode|font)|this software, associated))(?!.{0,120}to deal with)"),
    ("isc", 1, b"permission to use", rb"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose(?! with or without fee is hereby granted\.)"),
    ("bsd-0-clause", 1, b"permission to use", rb"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted\."),
    ("bsd", 2, b"redistribut", rb"redistributions? (?:of source code|and use in source and binary forms).{0,200}"),
    ("zlib", 1, b"altered source versions", rb"altered source versions must be plainly marked"),
    ("apache-2.0", 1, b"apache.org/licenses/license-2.0", rb"https?://(?:www\.)?apache\.org/licenses/license-2\.0(?:\.txt|\.html)?"),
    ("mit", 1, b"opensource.org/licen", rb"https?://(?:www\.)?opensource\.org/licen[sc]es/mit\b"),
    ("gpl", 2, b"gnu.org/licen", rb"https?://(?:www\.)?gnu\.org/licen[sc]es/(?:gpl)?"),
    ("mpl-2.0", 1, b"mozilla.org/mpl", rb"https?://(?:www\.)?mozilla\.org/mpl/2\.0\b/?"),
    ("mpl-1.1", 1, b"mozilla.org/mpl", rb"https?://(?:www\.)?mozilla\.org/mpl/(?:mpl-)?1\.1\b"),
    ("public-domain", 3, b"public domain", rb"(?:released |placed |dedicated |is )?(?:in(?:to)? |to )?the public domain"),
    ("cc0-1.0", 1, b"cc0", rb"\bcc0(?:[ -]1\.0)?\b(?: universal)?"),
    ("cc0-1.0", 1, b"creativecommons.org/publicdomain", rb"https?://creativecommons\.org/publicdomain/zero/1\.0/?"),
    ("apache-2.0", 1, b"royalty", rb"perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare derivative works of"),
    ("apache-1.1", 2, b"this product includes software", rb"this product includes software developed by the apache (?:software foundation|group)"),
    ("bsd-3-clause", 1, b"endorse or promote", rb"neither the names? of .{0,200}?(?:may|shall) be used to endorse or promote products derived from this software without (?:specific )?prior written permission"),
    ("bsd-4-clause", 1, b"advertising materials", rb"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("mpl-2.0", 1, b"mozilla public", rb"this source code form is subject to the terms of the mozilla public license, v\. 2\.0"),
    ("mpl-1.1", 1, b"mozilla public", rb"the contents of this file are subject to the mozilla public license version 1\.1"),
    ("mpl-1.0", 1, b"mozilla public", rb"the contents of this file are subject to the mozilla public license version 1\.0"),
    ("epl-1.0", 1, b"eclipse public", rb"this program and the accompanying materials are made available under the terms of the eclipse public license v ?1\.0"),
    ("epl-2.0", 1, b"eclipse public", rb"this program and the accompanying materials are made available under the terms of the eclipse public license (?:v\. ?)?2\.0"),
    ("cddl-1.0", 2, b"common development", rb"the contents of this file are subject to the terms of the common development and distribution license"),
    ("unlicense", 1, b"unencumbered", rb"this is free and unencumbered software released into the public domain"),
    ("wtfpl", 1, b"what the fuck", rb"you just do what the fuck you want to"),
    ("bsl-1.0", 1, b"free of charge", rb"permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("postgresql", 1, b"without fee", rb"permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted"),
    ("ncsa", 1, b"free of charge", rb"to any person obtaining a copy of this software and associated documentation files \(the .software.\), to deal with the software without restriction"),
    ("ofl-1.1", 1, b"free of charge", rb"permission is hereby granted, free of charge, to any person obtaining a copy of the font software"),
    ("icu", 1, b"free of charge", rb"permission is hereby granted, free of charge, to any person obtaining a copy of (?:the unicode data files|this software and associated documentation files .{0,40}to deal in the software without restriction, including .{0,200}provided that the above copyright notice\(s\))"),
    ("openssl", 1, b"toolkit", rb"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("python-2.0", 1, b"as is", rb"(?:psf|beopen|cnri|stichting mathematisch centrum) is making (?:python|this software)[^.]{0,60} available to licensee on an .as is. basis"),
    ("artistic-2.0", 1, b"redistribut", rb"this license establishes the terms under which a given free software package may be copied, modified, distributed, and/or redistributed"),
    ("artistic-1.0", 1, b"verbatim copies", rb"you may make and give away verbatim copies of the source form of the standard version of this package without restriction"),
    ("ruby", 1, b"verbatim copies", rb"you may make and give away verbatim copies of the source form of the software without restriction"),
    ("curl", 1, b"permission to use", rb"permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("w3c", 1, b"without fee", rb"permission to copy, modify, and distribute this (?:work|software and its documentation), with or without modification, for any purpose and without fee or royalty is hereby granted"),
    ("x11", 1, b"advertising or otherwise", rb"except as contained in this notice, the name .{0,120}?shall not be used in advertising or otherwise to promote the sale, use or other dealings"),
    ("ijg", 1, b"independent jpeg", rb"this software is based in part on the work of the independent jpeg group"),
    ("libpng", 1, b"as is", rb"the png reference library is supplied .as is."),
    ("php-3.01", 1, b"this product includes php", rb"this product includes php(?: software)?,? freely available from"),
    ("agpl-3.0", 1, b"interacting with it remotely", rb"your modified version must prominently offer all users interacting with it remotely through a computer network"),
    ("gpl-3.0", 1, b"take away your freedom", rb"the licen[sc]es for most software and other practical works are designed to take away your freedom to share and change the works"),
    ("gpl-2.0", 1, b"take away your freedom", rb"the licen[sc]es for most software are designed to take away your freedom to share and change it"),
    ("busl-1.1", 1, b"non-production use", rb"right to copy, modify, create derivative works, redistribute, and make non-production use of the licensed work"),
    ("sspl-1.0", 1, b"as a service", rb"make the functionality of the program or a modified version available to third parties as a service"),
    ("elastic-2.0", 1, b"managed service", rb"you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", 1, b"sell the software", rb"does not grant to you,? the right to sell the software"),
    ("ms-pl", 1, b"royalty", rb"each contributor grants you a non-exclusive, worldwide, royalty-free copyright license to reproduce its contribution, prepare derivative works of its contribution"),
    ("upl-1.0", 1, b"royalty", rb"perpetual, irrevocable, worldwide, non-exclusive, royalty-free license .{0,80}?larger work"),
    ("afl-3.0", 1, b"academic free", rb"licensed under the academic free license version 3\.0"),
    ("osl-3.0", 1, b"open software", rb"licensed under the open software license version 3\.0"),
    ("odbl-1.0", 1, b"open database", rb"is made available under the open database license"),
    ("cc0-1.0", 1, b"waived all copyright", rb"to the extent possible under law, .{0,120}?has waived all copyright and related or neighboring rights"),
    ("beerware", 1, b"retain this notice", rb"as long as you retain this notice you can do whatever you want with this stuff"),
    ("jasper-2.0", 1, b"jasper", rb"jasper licen[sc]e version 2\.0"),
    ("creative-commons", 4, b"any medium or format", rb"copy and redistribute the material in any medium or format"),
    ("proprietary", 4, b"all rights reserved", rb"all rights reserved"),
    ("unlicense", 1, b"unlicen", rb"\bunlicen[sc]e\b|unlicense\.org"),
    ("no-warranty", 4, b"warrant", rb"without warranty of any kind|without any warranty|as[ -]is[\"']?, without warrant(?:y|ies)"),
    ("license-reference", 4, b"licen", rb"see (?:the )?(?:file )?licen[sc]e(?:\.txt|\.md)? (?:file )?for (?:details|more|the full)"),
    ("license-reference", 4, b"licen", rb"(?:re)?licen[sc]ed under [a-z0-9][a-z0-9 .,+-]{0,60}"),
)


def _number(version: str) -> bytes:
    """This version and no longer one; '.0' may be left out."""
    return re.escape(version.removesuffix(".0").encode()) + (rb"(?:\.0)?" if version.endswith(".0") else b"") + rb"(?!\d|\.\d)"


def wrapped(regex: bytes) -> bytes:
    """The rule with GAP for its spaces."""
    parts = re.split(rb"(\[[^\]]*\])", regex.replace(b"[ -]+", rb"[\s*#/;%|>-]+").replace(b"[ -:]", rb"[\s -:]"))
    return b"".join((rb"(?:" + GAP + rb"|-)" if x in (b"[ -]", b"[- ]") else x) if i % 2 else x.replace(b" ", GAP) for i, x in enumerate(parts))


def signature_rules() -> list[Rule]:
    """All rules, in order of priority and then as listed."""
    out = []
    for label, name, literal in NAMES:
        spdx = re.escape(label.encode())
        stem, _, version = label.rpartition("-")
        # A family's name may go without a version, but not with another one's.
        after = rb"(?:,? v(?:ersion|\.)? ?[\d.]*\d)?"
        if stem in (x for x, _, _ in FAMILIES):
            after = rb"(?:" + TO_VERSION + _number(version) + rb"|(?!" + TO_VERSION + rb"\d))"
        out.append(Rule(label, 0, b"spdx-licen", rb"spdx-licen[sc]e-identifier:\s*[^\n]{0,80}?\b" + spdx + rb"(?![\w.-])"))
        out.append(Rule(label, 1, literal or b"licen", rb"(?:licen[sc]ed|released|distributed|available|published|covered) (?:under|by) (?:the )?(?:terms of (?:the )?)?\b(?:" + name + rb") ?(?:public )?licen[sc]e" + after))
        out.append(Rule(label, 2, literal or b"licen", rb"\b(?:" + name + rb")[ -]licen[sc]e" + after))
    out.append(Rule("apache-2.0", 1, b"apache", rb"(?:licen[sc]ed under (?:the )?)?apache licen[sc]e,? v(?:ersion|\.)? ?2(?:\.0)?\b"))
    out.append(Rule("apache-1.1", 1, b"apache", rb"apache (?:software )?licen[sc]e,? v(?:ersion|\.)? ?1\.1\b"))
    for stem, name, versions in FAMILIES:
        for v in versions:
            out.append(Rule(f"{stem}-{v}", 1, b"licen", rb"(?:(?:licen[sc]ed|released|distributed|available|published|covered) (?:under|by) (?:the )?(?:terms of (?:the )?)?)?\b" + name + rb" licen[sc]e" + TO_VERSION + _number(v)))
    for stem, name, short, versions in GNU:
        out.append(Rule(stem, 3, b"licen", rb"\b" + name))
        for v in versions:
            number = re.escape(v.encode()) + (rb"(?:\.0)?" if "." not in v else rb"")
            full = f"{stem}-{v}" if "." in v else f"{stem}-{v}.0"
# Within a line or within a sentence.
            out.append(Rule(f"{full}-or-later", 1, b"licen", rb"\b" + name + rb"(?:[^\n]{0,60}?|[^.]{0,100}?)(?:,| )? ?v(?:ersion|\.)? ?" + number + rb"(?![\d]|\.\d)(?:[^\n]{0,40}?|[^.]{0,60}?)or (?:\(at your option\) )?any later"))
            out.append(Rule(full, 2, b"licen", rb"\b" + name + rb",? as published by the free software foundation[,;:]? (?:either )?v(?:ersion|\.)? ?" + number + rb"(?![\d]|\.\d)"))
            out.append(Rule(f"{full}-or-later", 1, b"licen", rb"\bversion " + number + rb",? or (?:\(at your option\) )?any later(?: version)?,? of the " + name))
            out.append(Rule(full, 2, b"licen", rb"\bversion " + number + rb" of the " + name))
            out.append(Rule(full, 2, b"licen", rb"\b" + name + rb",? ?\(?(?:v(?:ersion|\.)? ?)?" + number + rb"(?![\d]|\.\d)"))
            out.append(Rule(full, 2, short, rb"\b" + short + rb"[ -]?v?" + number + rb"(?![\d]|\.\d)(?:-only|-or-later|\+)?"))
            out.append(Rule(full, 0, b"spdx-licen", rb"spdx-licen[sc]e-identifier:\s*[^\n]{0,80}?\b" + short + rb"-" + number + rb"(?:-only|-or-later|\+)?"))
    for kind in CC_KINDS:
        words = rb"[ -]+".join(CC_WORDS[x] for x in kind.split("-"))
        code = rb"[ -]".join(x.encode() for x in kind.split("-"))
        for v in CC_VERSIONS:
            number = re.escape(v.encode())
            label = f"cc-{kind}-{v}"
            out.append(Rule(label, 1, b"cc", rb"(?:licen[sc]ed under (?:an? |the )?)?\bcc[ -]" + code + rb"[ -]v?" + number))
            out.append(Rule(label, 1, b"creative", rb"creative commons[ -:]+" + words + rb"[ -]+(?:" + number + rb")[a-z ]{0,30}(?:licen[sc]e)?"))
            out.append(Rule(label, 1, b"creativecommons.org/licen", rb"https?://creativecommons\.org/licen[sc]es/" + kind.encode() + rb"/" + number + rb"/?"))
        out.append(Rule(f"cc-{kind}", 2, b"cc", rb"\bcc[ -]" + code + rb"\b(?![ -](?:sa|nd|nc)\b)"))
    out.extend(Rule(*x) for x in NOTICES)
    return sorted(out, key=lambda r: r.priority)


def _compiled() -> tuple[list[bytes], dict[bytes, list[tuple[int, Rule, re.Pattern]]]]:
    by_keyword: dict = {}
    for i, rule in enumerate(signature_rules()):
        by_keyword.setdefault(rule.keyword, []).append((i, rule, re.compile(wrapped(rule.regex), re.S)))
    return sorted(by_keyword), by_keyword


def detect(lower: bytes) -> list[tuple[int, int, str, int]]:
    """(start, end, label, priority) in bytes of a lower-cased text, without suppressed ones."""
    flat = WRAP.sub(b" ", lower)
    if not any(t in flat for t in TRIGGERS):
        return []
    keywords, by_keyword = per_worker("licenses", _compiled)
    found = []
    for k in keywords:
        if k in flat:
            for order, rule, regex in by_keyword[k]:
                found += [(rule.priority, m.start() - m.end(), order, m.start(), m.end(), rule.label) for m in regex.finditer(lower)]
    # Best priority first, longer first, earlier rule first.
    return suppressed((a, b, label, priority) for priority, _, _, a, b, label in sorted(found))


def suppressed(found: Iterable[tuple[int, int, str, int]]) -> list[tuple[int, int, str, int]]:
    """Detections without those inside a kept one or around one; they come best first.

    None of the kept lies inside another, so ordered by start they are ordered by end too, and a look to both sides tells.
    """
    starts: list[int] = []
    kept: list[tuple[int, int, str, int]] = []
    for hit in found:
        a, b = hit[:2]
        i = bisect_right(starts, a)
        if i and kept[i - 1][1] >= b:  # inside the last one that begins before
            continue
        i = bisect_left(starts, a)
        if i < len(kept) and kept[i][1] <= b:  # around the next one
            continue
        insort(starts, a)
        kept.insert(bisect_left(starts, a), hit)
    return kept


def base_places(words: list[bytes]) -> tuple[int, int | None, int | None, set[str]]:
    """Places of the base phrases, first and last word, labels."""
    text = b" " + b" ".join(words) + b" "
    places, labels = [], set()
    for phrase, label in PHRASES:
        needle = b" " + phrase + b" "
        at = text.find(needle)
        while at >= 0:
            places.append(at)
            labels.add(label)
            at = text.find(needle, at + 1)
    if not places:
        return 0, None, None, labels
    return len(places), text.count(b" ", 0, min(places)), text.count(b" ", 0, max(places)), labels


SCAN = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<start:long,stop:long,label:string,priority:int>>"


def scan(documents: DataFrame) -> DataFrame:
    """One row per document: base columns, labels, a score and the detections.

    Null and empty texts have no words, labels (an empty string) or detections and score 0;
    repeated rows get a row each; offsets are in UTF-8 bytes; only ``doc_id`` and ``text``
    are read.  A map without a shuffle.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detection = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("label", pa.string()), ("priority", pa.int32())]))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), detection]
        for batch in rows(batches):
            out: list[tuple] = []
            for text in batch.column(1).to_pylist():
                words = text.translate(ALNUM).split()
                lower = text.translate(LOWER)
                n, first, last, base = base_places(words) if b"license" in lower else (0, None, None, set())
                hits = detect(lower)
                miss = 1.0 - CONFIDENCE[-1] if base else 1.0
                for _, _, _, priority in hits:
                    miss *= 1.0 - CONFIDENCE[priority]
                out.append((len(words), n, first, last, ",".join(sorted(base)), ",".join(sorted(base | {h[2] for h in hits})), 1.0 - miss, [dict(start=a, stop=b, label=x, priority=p) for a, b, x, p in hits]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(zip(*out), kinds))], names=["doc_id", *re.findall(r"(\w+) (?:long|string|double|array)", SCAN)])

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", utf8().alias("text")).mapInArrow(apply, f"doc_id {kind}, {SCAN}")
