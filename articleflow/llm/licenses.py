"""Operator 10: license scans by patience alignment.

Words are lower-cased runs of a-z and 0-9.  A stretch of the text is aligned
with a template: words that stand exactly once on both sides are anchors, the
longest increasing subsequence of their places keeps the order, and the gaps
between anchors are aligned in the same way; a gap without such words takes
the equal words at its two ends.  The coverage is the aligned share of the
template's words; 0.8 and more is reported.  Alignment runs text by text
inside Spark's tasks; texts are read whole and never shuffled.

What tells a template from its neighbours (name, version: ``KEYS``) must stand
in the text word for word.  Such a template is aligned outwards from each
place of its first key; one without keys is aligned in the windows that hold
enough of its words.  Stretches of the template's own length are tried first,
then ones of up to ``SPREADS`` times it, so that foreign words (line numbers,
names, comments) may stand between.

A text can only reach the coverage if it holds one of any selection of more
than a fifth of the template's words, so texts with none of the selected
(longest) words are passed over without loss.

Defined results: null or empty text: no row; each found stretch gives a row,
so a text with a license twice gives two; of stretches that share aligned
words the one with the most is taken (then the best covered, the shortest, the
first), whatever the template; repeated rows repeat their results.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter, defaultdict
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from articleflow.llm.common import append_columns, field, ready

# Names and wording of public license notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
                         "except in compliance with the License. You may obtain a copy of the License at "
                         "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
                         "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
                         "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "MIT": "Released under the MIT License",
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                  "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
                  "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
                  "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                      "General Public License as published by the Free Software Foundation, either version 3 of the "
                      "License, or (at your option) any later version.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "BSD-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted "
                  "provided that the following conditions are met",
}
# What must stand word for word; the alignment starts at the first phrase.
KEYS = {
    "Apache-2.0": ["apache license version 2 0"], "MIT": ["mit license"],
    "GPL-3.0": ["gnu general public license version 3"], "GPL-3.0-notice": ["gnu general public license", "version 3"],
    "CC-BY-NC-4.0": ["cc by nc 4 0"], "CC-BY-4.0": ["creative commons attribution 4 0"],
}


def _add(name: str, text: str, *keys: str) -> None:
    TEMPLATES[name] = text
    if keys:
        KEYS[name] = list(keys)


# Names as notices state them: (id, name, what must stand word for word).
for _id, _name, _key in [
        ("Apache-1.1", "Apache License, Version 1.1", "apache license version 1 1"),
        ("Apache-1.1-name", "Apache Software License, Version 1.1", "apache software license version 1 1"),
        ("Apache-2.0-name", "Apache License 2.0", "apache license 2 0"),
        ("Apache-2.0-software", "Apache Software License, Version 2.0", "apache software license version 2 0"),
        ("MIT-0", "MIT No Attribution License", "mit no attribution"),
        ("X11", "X11 License", "x11 license"), ("BSD", "BSD License", "bsd license"),
        ("0BSD", "Zero-Clause BSD License", "zero clause bsd"),
        ("BSD-2-Clause", "BSD 2-Clause License", "bsd 2 clause"),
        ("BSD-2-Clause-name", "Simplified BSD License", "simplified bsd license"),
        ("BSD-2-Clause-FreeBSD", "FreeBSD License", "freebsd license"),
        ("BSD-3-Clause", "BSD 3-Clause License", "bsd 3 clause"),
        ("BSD-3-Clause-name", "New BSD License", "new bsd license"),
        ("BSD-3-Clause-modified", "Modified BSD License", "modified bsd license"),
        ("BSD-4-Clause", "BSD 4-Clause License", "bsd 4 clause"),
        ("ISC", "ISC License", "isc license"), ("Zlib", "zlib License", "zlib license"),
        ("BSL-1.0", "Boost Software License, Version 1.0", "boost software license version 1 0"),
        ("MPL-1.0", "Mozilla Public License, Version 1.0", "mozilla public license version 1 0"),
        ("MPL-1.1", "Mozilla Public License, Version 1.1", "mozilla public license version 1 1"),
        ("MPL-2.0", "Mozilla Public License, Version 2.0", "mozilla public license version 2 0"),
        ("MPL-2.0-name", "Mozilla Public License 2.0", "mozilla public license 2 0"),
        ("EPL-1.0", "Eclipse Public License, Version 1.0", "eclipse public license version 1 0"),
        ("EPL-2.0", "Eclipse Public License, Version 2.0", "eclipse public license version 2 0"),
        ("EPL-2.0-name", "Eclipse Public License 2.0", "eclipse public license 2 0"),
        ("CDDL-1.0", "Common Development and Distribution License, Version 1.0",
         "common development and distribution license version 1 0"),
        ("CDDL-1.1", "Common Development and Distribution License, Version 1.1",
         "common development and distribution license version 1 1"),
        ("CPL-1.0", "Common Public License, Version 1.0", "common public license version 1 0"),
        ("EUPL-1.1", "European Union Public Licence, Version 1.1", "european union public licence version 1 1"),
        ("EUPL-1.2", "European Union Public Licence, Version 1.2", "european union public licence version 1 2"),
        ("Artistic-1.0", "Artistic License 1.0", "artistic license 1 0"),
        ("Artistic-2.0", "Artistic License 2.0", "artistic license 2 0"),
        ("AFL-3.0", "Academic Free License, Version 3.0", "academic free license version 3 0"),
        ("OSL-3.0", "Open Software License, Version 3.0", "open software license version 3 0"),
        ("OFL-1.1", "SIL Open Font License, Version 1.1", "sil open font license version 1 1"),
        ("MS-PL", "Microsoft Public License", "microsoft public license"),
        ("MS-RL", "Microsoft Reciprocal License", "microsoft reciprocal license"),
        ("PSF-2.0", "Python Software Foundation License, Version 2", "python software foundation license version 2"),
        ("PostgreSQL", "PostgreSQL License", "postgresql license"), ("Unlicense", "Unlicense", "the unlicense"),
        ("ODbL-1.0", "Open Database License (ODbL), Version 1.0", "open database license odbl version 1 0"),
        ("GFDL-1.2", "GNU Free Documentation License, Version 1.2", "gnu free documentation license version 1 2"),
        ("GFDL-1.3", "GNU Free Documentation License, Version 1.3", "gnu free documentation license version 1 3"),
        ("CC0-1.0", "CC0 1.0 Universal Public Domain Dedication", "cc0 1 0 universal"),
        ("WTFPL", "Do What The Fuck You Want To Public License", "do what the fuck you want to public license")]:
    _add(_id, f"Licensed under the {_name}", _key)
_add("CC0-1.0-name", "Licensed under CC0 1.0", "cc0 1 0")
for _id, _kind, _thing, _versions in [("GPL", "General", "program", ("1", "2", "3")), ("LGPL", "Library General", "library", ("2",)),
                                      ("LGPL", "Lesser General", "library", ("2.1", "3")),
                                      ("AGPL", "Affero General", "program", ("3",))]:
    for _v in _versions:
        _full, _words = f"{_id}-{_v}" + ("" if "." in _v else ".0"), _v.replace(".", " ")
        _long = f"gnu {_kind} public license".lower()
        if _full not in TEMPLATES:
            _add(_full, f"This work is licensed under the GNU {_kind} Public License, version {_v}",
                 f"{_long} version {_words}")
            _add(f"{_full}-notice", TEMPLATES["GPL-3.0-notice"].replace("This program", f"This {_thing}")
                 .replace("GNU General", f"GNU {_kind}").replace("version 3", f"version {_v}"), _long, f"version {_words}")
        _add(f"{_full}-name", f"This work is licensed under the GNU {_kind} Public License v{_v}", f"{_long} v{_words}")
        _add(f"{_full}-short", f"Licensed under the GNU {_id} v{_v}", f"{_id} v{_words}".lower())
        _add(f"{_full}-short-version", f"Licensed under the GNU {_id} version {_v}", f"{_id} version {_words}".lower())
        _add(f"{_full}-abbreviated", f"Licensed under the {_id}v{_v}", f"{_id}v{_words}".lower())
for _v, _place in (("1.0", "Generic"), ("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International")):
    for _parts in ("BY", "BY-SA", "BY-NC", "BY-NC-SA", "BY-ND", "BY-NC-ND"):
        _full, _v2 = f"CC-{_parts}-{_v}", _v.replace(".", " ")
        _name = "-".join({"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial",
                          "ND": "NoDerivatives" if _v == "4.0" else "NoDerivs"}[x] for x in _parts.split("-"))
        _say = "This work is licensed under a Creative Commons {} {} {} License"
        if _full != "CC-BY-4.0":
            _add(f"{_full}-notice", _say.format(_name, _v, _place),
                 f"creative commons {_name.replace('-', ' ')} {_v2}".lower())
        _add(f"{_full}-name" if _full == "CC-BY-4.0" else _full, f"Licensed under CC {_parts} {_v}",
             f"cc {_parts.replace('-', ' ')} {_v2}".lower())

# Whole notices and license texts.
_BSD2 = (TEMPLATES["BSD-notice"] + ": 1. Redistributions of source code must retain the above copyright notice, this list of "
         "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
         "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
         "distribution.")
_END = ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission.")
_ADS = ("3. All advertising materials mentioning features or use of this software must display the following acknowledgement: "
        "This product includes software developed by the organization.")
_USE = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_add("BSD-2-Clause-notice", _BSD2)
_add("BSD-3-Clause-notice", f"{_BSD2} 3. {_END}", "endorse or promote products")
_add("BSD-4-Clause-notice", f"{_BSD2} {_ADS} 4. {_END}", "advertising materials mentioning")
_add("0BSD-notice", f"{_USE}.")
_add("ISC-notice", f"{_USE}, provided that the above copyright notice and this permission notice appear in all copies.")
_add("MIT-0-notice", TEMPLATES["MIT-notice"] + ". THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND",
     "to do so the software is provided")
_add("JSON", "The Software shall be used for Good, not Evil.", "used for good not evil")
_add("PostgreSQL-notice", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, "
     "without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this "
     "paragraph and the following two paragraphs appear in all copies.", "without a written agreement")
_add("Zlib-notice", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and "
     "to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be "
     "misrepresented; you must not claim that you wrote the original software.")
_add("BSL-1.0-notice", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the "
     "software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, "
     "execute, and transmit the Software, and to prepare derivative works of the Software")
_add("BSL-1.0-file", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy "
     "at http://www.boost.org/LICENSE_1_0.txt)", "boost software license version 1 0")
_add("MPL-2.0-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
     "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "mozilla public license v 2 0")
_add("MPL-1.1-notice", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may "
     "not use this file except in compliance with the License.", "mozilla public license version 1 1")
for _v in ("1.0", "2.0"):
    _add(f"EPL-{_v}-notice", "This program and the accompanying materials are made available under the terms of the Eclipse Public "
         f"License v{_v}", f"eclipse public license v{_v.replace('.', ' ')}")
_add("Unlicense-notice", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
     "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
     "purpose, commercial or non-commercial, and by any means.")
_add("CC0-1.0-notice", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
     "this work.", "waived all copyright and related")
_add("OFL-1.1-notice", "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
     "sil open font license version 1 1")
for _v in ("1.1", "1.2", "1.3"):
    _add(f"GFDL-{_v}-notice", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free "
         f"Documentation License, Version {_v} or any later version published by the Free Software Foundation",
         f"gnu free documentation license version {_v.replace('.', ' ')}")
for _id in sorted({re.sub(r"(?<!MIT)-(name|notice|short|short-version|abbreviated|file|software|modified)$", "", k) for k in TEMPLATES}
                  - {"BSD", "MIT-notice"} | {"MIT"}):
    _add(f"{_id}-spdx", f"SPDX-License-Identifier: {_id}", f"spdx license identifier {' '.join(re.findall('[a-z0-9]+', _id.lower()))}")
#: Stretches of so many times a template's length are tried, shortest first.
SPREADS = (1, 2, 4)
_WORD = re.compile(r"[a-z0-9]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of ``pairs`` (sorted by the first number) whose
    second numbers increase, by patience piles."""
    tops, last, back = [], [], [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        pile = bisect.bisect_left(tops, b)
        if pile == len(tops):
            tops.append(b)
            last.append(i)
        else:
            tops[pile], last[pile] = b, i
        back[i] = last[pile - 1] if pile else -1
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Aligned places (text, template), both increasing."""
    out, todo = [], [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        if a >= b or c >= d:
            continue
        here, there = Counter(text[a:b]), Counter(template[c:d])
        at = {w: i for i, w in enumerate(template[c:d], c) if there[w] == 1 and here.get(w) == 1}
        anchors = increasing([(i, at[w]) for i, w in enumerate(text[a:b], a) if w in at])
        if anchors:
            out += anchors
            for (i, j), (k, m) in zip([(a - 1, c - 1), *anchors], [*anchors, (b, d)]):
                todo.append((i + 1, k, j + 1, m))
            continue
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
    return sorted(out)


def places(words: list[str], phrase: list[str], at: dict[str, list[int]]) -> list[int]:
    """Where ``phrase`` stands in ``words``, whose places ``at`` lists."""
    k, rare = min(enumerate(phrase), key=lambda x: len(at.get(x[1], ())))
    return [i - k for i in at.get(rare, ()) if i >= k and words[i - k:i - k + len(phrase)] == phrase]


def _outwards(words: list[str], at: dict[str, list[int]], template: list[str], keys: list[list[str]], need: float):
    """Alignments around each place of the first key that hold all keys word
    for word; for each place the first spread that reaches ``need``."""
    m, size, index = len(template), len(keys[0]), defaultdict(list)
    for i, w in enumerate(template):
        index[w].append(i)
    spots = [(places(template, k, index)[0], len(k)) for k in keys]
    p = spots[0][0]
    for i in places(words, keys[0], at):
        for spread in SPREADS:
            pad = m // 4 + 1
            a, b = max(0, i - spread * p - pad), min(len(words), i + size + spread * (m - p - size) + pad)
            pairs = [(a + x, y) for x, y in align(words[a:i], template[:p])]
            pairs += [(i + k, p + k) for k in range(size)]
            pairs += [(i + size + x, p + size + y) for x, y in align(words[i + size:b], template[p + size:])]
            held = {y: x for x, y in pairs}
            if len(pairs) >= need and all(held.get(q + k, -1) == held.get(q, -2) + k for q, n in spots for k in range(n)):
                yield pairs
                break


def _windows(words: list[str], template: list[str], need: float):
    """Alignments in the windows that hold enough of the template's words."""
    m, bag = len(template), Counter(template)
    inside = np.fromiter((w in bag for w in words), bool, len(words))
    if inside.sum() < need:
        return
    total = np.concatenate(([0], np.cumsum(inside)))
    taken = []
    for spread in SPREADS:
        size, pad = min(len(words), spread * m), m // 4
        held = total[size:] - total[:-size]
        open_ = held >= need
        for first, last in taken:
            open_[max(0, first - size + 1):last] = False
        while open_.any():
            i = int(np.where(open_, held, -1).argmax())
            a, b = max(0, i - pad), min(len(words), i + size + pad)
            pairs = align(words[a:b], template) if (Counter(words[a:b]) & bag).total() >= need else []
            if len(pairs) >= need:
                yield [(a + x, y) for x, y in pairs]
                first, last = a + pairs[0][0], a + pairs[-1][0] + 1
                taken.append((first, last))
                open_[max(0, first - size + 1):last] = False
            open_[max(0, i - pad):i + pad + 1] = False


def find(text: str | None, templates: dict[str, list[str]], hints: re.Pattern, coverage: float,
         keys: dict[str, list[list[str]]] | None = None) -> list[dict]:
    """License stretches of one text."""
    if not text or not hints.search(low := text.lower()):
        return []
    words, at, found = _WORD.findall(low), defaultdict(list), []
    for i, w in enumerate(words):
        at[w].append(i)
    for name, template in templates.items():
        need, must = coverage * len(template) - 1e-9, (keys or {}).get(name)
        if must and not all(w in at for k in must for w in k):
            continue
        for pairs in _outwards(words, at, template, must, need) if must else _windows(words, template, need):
            share = len(pairs) / len(template)
            found.append((-len(pairs), -share, pairs[-1][0] - pairs[0][0], pairs[0][0], name, [x for x, _ in pairs]))
    out, used = [], set()
    for _, share, length, first, name, spots in sorted(found):
        if used.isdisjoint(spots):
            used.update(spots)
            out.append({"license": name, "coverage": round(-share, 6), "first_word": first, "end_word": first + length + 1})
    return sorted(out, key=lambda x: (x["first_word"], x["license"]))


def hint_words(templates: dict[str, list[str]], coverage: float) -> re.Pattern:
    """Any text that covers a template holds one of these."""
    chosen = set()
    for words in templates.values():
        size, taken = 0, sorted(Counter(words).items(), key=lambda x: (x[0] not in chosen, -len(x[0]), x[0]))
        for w, n in taken:
            if size > (1 - coverage) * len(words) + 1e-9:
                break
            chosen.add(w)
            size += n
    return re.compile("|".join(sorted(map(re.escape, chosen))))


def _make_find(templates: dict[str, str], coverage: float, keys: dict[str, list[str]]):
    cut = {k: words_of(v) for k, v in templates.items()}
    must = {k: [words_of(x) for x in v] for k, v in keys.items()}
    hints = hint_words(cut, coverage)
    return lambda texts: [[find(t, cut, hints, coverage, must) for t in texts.to_pylist()]]


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = 0.8,
                  text_col: str = "text", out: str = "licenses", keys: dict[str, list[str]] | None = None) -> DataFrame:
    """``docs`` with ``out``: array of (license, coverage, first_word, end_word).
    ``keys``: phrases of own templates that must stand word for word."""
    ready(docs.sparkSession)
    made = partial(_make_find, templates or TEMPLATES, coverage, KEYS if templates is None and keys is None else keys or {})
    return append_columns(docs, [text_col], made, [
        field(out, "array<struct<license:string,coverage:double,first_word:bigint,end_word:bigint>>")])


def license_report(docs: DataFrame) -> DataFrame:
    """(doc_id, license, coverage, first_word, end_word) of each stretch."""
    return scan_licenses(docs.select("doc_id", "text")).select("doc_id", F.inline("licenses"))
