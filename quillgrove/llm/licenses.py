"""Licence scans with a generalised suffix automaton.

The automaton holds every run of words of every licence template. A text streams through it word by
word, which gives the matching statistics: at each word, the length of the longest run ending there
that some template has. Runs that can't be lengthened and have ``min_match`` words or more are
chained, in order of text and template, into the spans of the template that the text covers.
Scanning is a map over the documents; the automaton is built from the templates in each worker.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrove.llm import common
from quillgrove.llm.license_texts import TEXTS

WORD = re.compile(r"[^\W_]+")
FOUND = "doc_id long, template string, start_char int, end_char int, template_start int, template_end int, n_covered int, coverage double"

_DISCLAIMER = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_END = "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"
_GNU = "this program is free software you can redistribute it and or modify it under the terms of the gnu {0} public license as published by the free software foundation either version {1} of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {0} public license for more details you should have received a copy of the gnu {0} public license along with this program"

_BSD_4 = "all advertising materials mentioning features or use of this software must display the following acknowledgement this product includes software developed by"
#: Names of licences in sentences, by SPDX name.
_NAMES = {
    "MIT": ["mit license", "expat license"], "ISC": ["isc license"], "Zlib": ["zlib license"], "Unlicense": ["unlicense license"], "BSL-1.0": ["boost software license"],
    "Apache-2.0": ["apache license", "apache license version 2 0", "apache license v2 0", "apache license 2 0", "apache 2 0 license", "apache software license"],
    "BSD-2-Clause": ["bsd 2 clause license", "simplified bsd license", "2 clause bsd license"], "BSD-3-Clause": ["bsd 3 clause license", "new bsd license", "modified bsd license", "3 clause bsd license"],
    "BSD-4-Clause": ["bsd 4 clause license", "original bsd license", "4 clause bsd license"], "BSD": ["bsd license"],
    **{f"{k}{v}": [f"{name}{w}" for name in names for w in ws] for k, names in {"GPL": ["gnu general public license", "gnu gpl"], "LGPL": ["gnu lesser general public license", "gnu lgpl"], "AGPL": ["gnu affero general public license", "gnu agpl"], "GFDL": ["gnu free documentation license"]}.items()
       for v, ws in {"": [""], **{f"-{v}": [f" version {v.replace('.', ' ')}", f" v{v.replace('.', ' ')}", f" version {v[0]}", f" v{v[0]}"] if v.endswith(".0") else [f" version {v.replace('.', ' ')}", f" v{v.replace('.', ' ')}"] for v in {"GPL": ["2.0", "3.0"], "LGPL": ["2.1", "3.0"], "AGPL": ["3.0"], "GFDL": ["1.2", "1.3"]}[k]}}.items()},
    **{f"{k}{'-' if v else ''}{v}": [f"{name}{f}{v.replace('.', ' ')}" for f in ([""] if not v else [" version ", " v ", " v", " "])] for k, name, vs in (("MPL", "mozilla public license", ["", "1.1", "2.0"]), ("EPL", "eclipse public license", ["", "1.0", "2.0"]), ("CDDL", "common development and distribution license", ["", "1.0", "1.1"]), ("Artistic", "artistic license", ["", "1.0", "2.0"])) for v in vs},
}
_SPDX = """
0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-1.0-Perl Artistic-2.0 BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent
BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 BUSL-1.1 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1
CECILL-2.1 CPL-1.0 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GFDL-1.2 GFDL-1.2-only GFDL-1.2-or-later GFDL-1.3 GFDL-1.3-only GFDL-1.3-or-later GPL-1.0 GPL-1.0-only GPL-1.0-or-later GPL-2.0 GPL-2.0+
GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0+ GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.0 LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1+ LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only
LGPL-3.0-or-later LPPL-1.3c MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NCSA ODbL-1.0 OFL-1.1 OSL-3.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 Ruby SSPL-1.0 UPL-1.0 Unlicense Vim W3C WTFPL X11 Zlib ZPL-2.1
""".split()
_EITHER = ["MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "ISC", "MPL-2.0", "EPL-2.0", "Unlicense", "Zlib", "CC0-1.0"]

#: Public licence notices: full headers, the one-line statements in use for them, SPDX lines, and whole texts.
TEMPLATES: dict[str, str] = {
    "MIT": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software " + _DISCLAIMER,
    "ISC": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software",
    "BSD-2-Clause": f"{_BSD} {_BSD_END}",
    "BSD-3-Clause": f"{_BSD} neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission {_BSD_END}",
    "Apache-2.0": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "GPL-2.0": _GNU.format("general", "2"),
    "GPL-3.0": _GNU.format("general", "3"),
    "LGPL-2.1": _GNU.format("lesser general", "2 1"),
    "LGPL-3.0": _GNU.format("lesser general", "3"),
    "AGPL-3.0": _GNU.format("affero general", "3"),
    "MPL-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "Unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "Zlib": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
    "BSL-1.0": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software",
    "CC0-1.0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    **{f"{name} ({i})": text for name, lines in {
        "MIT": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license"],
        "Apache-2.0": ["licensed under the apache license version 2 0", "released under the apache license 2 0"],
        "GPL-3.0": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license v3 0", "licensed under the gpl v3"],
        "GPL-2.0": ["this work is licensed under the gnu general public license version 2", "licensed under the gpl v2"],
        "LGPL-3.0": ["this work is licensed under the gnu lesser general public license version 3"],
        "AGPL-3.0": ["this work is licensed under the gnu affero general public license version 3"],
        "BSD-3-Clause": ["released under the bsd 3 clause license", "use of this source code is governed by a bsd style license"],
        "BSD-2-Clause": ["released under the bsd 2 clause license"],
        "MPL-2.0": ["licensed under the mozilla public license 2 0", "licensed under the mozilla public license version 2 0"],
        "ISC": ["released under the isc license"],
        "Unlicense": ["released into the public domain under the unlicense"],
        "CC0-1.0": ["licensed under cc0 1 0", "dedicated to the public domain under cc0 1 0"],
        **{f"CC-{k.upper().replace(' ', '-')}-4.0": [f"licensed under cc {k} 4 0", f"licensed under a creative commons {long} 4 0 international license"] for k, long in {
            "by": "attribution", "by sa": "attribution sharealike", "by nc": "attribution noncommercial", "by nd": "attribution noderivatives", "by nc sa": "attribution noncommercial sharealike", "by nc nd": "attribution noncommercial noderivatives"}.items()},
    }.items() for i, text in enumerate(lines, 1)},
    "BSD-4-Clause": f"{_BSD} {_BSD_4}",
    **{f"{name} (under {i})": f"under the {of}{phrase}" for name, phrases in _NAMES.items() for i, (of, phrase) in enumerate([(of, p) for p in phrases for of in ("", "terms of the ", "terms and conditions of the ")], 1)},
    **{f"{name} (spdx)": f"spdx license identifier {name}" for name in [*_SPDX, *[f"{a} {op} {b}" for a in _EITHER for b in _EITHER if a != b for op in ("OR", "AND")]]},
    **TEXTS,
}


class Automaton:
    """Generalised suffix automaton over the words of the templates."""

    def __init__(self, templates: Mapping[str, str], min_match: int = 3):
        self.names = list(templates)
        self.min_match = min_match
        self.vocabulary: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.sizes: list[int] = []
        ends: list[tuple[int, int, int]] = []
        for t, text in enumerate(templates.values()):
            words = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in WORD.findall(text.lower())]
            self.sizes.append(len(words))
            last = 0
            for i, w in enumerate(words):
                last = self._extend(last, w)
                ends.append((last, t, i))
        #: For each state, the places (template, last word) of its runs of min_match words or more.
        self.places: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for state, t, i in ends:
            while state > 0 and self.length[state] >= min_match:
                self.places[state].append((t, i))
                state = self.link[state]

    def _new(self, length: int, link: int, after: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(after)
        return len(self.next) - 1

    def _clone(self, p: int, w: int, q: int) -> int:
        c = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        self.link[q] = c
        return c

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, w, q)
        new = self._new(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q)
        return new

    def matches(self, ids: np.ndarray) -> list[tuple[int, int, int]]:
        """(last word, length, state) of the runs of min_match words or more that the next word doesn't lengthen."""
        known = np.flatnonzero(ids)
        if len(known) < self.min_match:
            return []
        cuts = np.flatnonzero(np.diff(known) > 1) + 1
        found = []
        for run in np.split(known, cuts):
            if len(run) < self.min_match:
                continue
            state, length, at = 0, 0, int(run[0])
            for i, w in enumerate(ids[run].tolist(), at):
                if w in self.next[state]:
                    state, length = self.next[state][w], length + 1
                    continue
                if length >= self.min_match:
                    found.append((i - 1, length, state))
                while state and w not in self.next[state]:
                    state = self.link[state]
                    length = self.length[state]
                if w in self.next[state]:
                    state, length = self.next[state][w], length + 1
            if length >= self.min_match:
                found.append((int(run[-1]), length, state))
        return found


@lru_cache(maxsize=4)
def _automaton(templates: tuple[tuple[str, str], ...] | None, min_match: int) -> Automaton:
    return Automaton(TEMPLATES if templates is None else dict(templates), min_match)


def chains(a: Automaton, found: list[tuple[int, int, int]], gap: int = 12) -> list[tuple[int, int, int, int, int, int]]:
    """Chains (template, first word, last word, template's first and last, words covered), the best over any word only.

    A match joins the chain of its template that ends before it, in text and template, by at most gap
    words; overlaps are cut off. Of chains that share words of the text, the one that covers most
    words stays, then the one that covers more of its template, then the first template.
    """
    open_: dict[int, list[list[int]]] = {}
    for last, length, state in found:
        for t, end in a.places[state]:
            first, start = last - length + 1, end - length + 1
            best = None
            for c in open_.setdefault(t, []):
                over = max(0, c[1] - first + 1, c[3] - start + 1)
                if over < length and first + over - c[1] - 1 <= gap and start + over - c[3] - 1 <= gap and c[0] <= first and c[2] <= start and (best is None or c[4] - over > best[0][4] - best[1]):
                    best = (c, over)
            if best is not None:
                c, over = best
                # the old chain stays open: another match may suit it better
                open_[t].append([c[0], last, c[2], end, c[4] + length - over])
            open_[t].append([first, last, start, end, length])
            if len(open_[t]) > 64:
                # later matches begin no earlier than this one, so what is too far behind it is too far behind them
                open_[t] = [c for c in open_[t] if first - c[1] - 1 <= gap or _enough(c[4], a.sizes[t])]
    done = sorted(((c[4], c[4] / a.sizes[t], -t, c) for t, cs in open_.items() for c in cs if _enough(c[4], a.sizes[t])), key=lambda x: (-x[0], -x[1], -x[2], x[3]))
    taken: list[tuple[int, int]] = []
    out = []
    for _, _, t, c in done:
        if all(c[1] < x or c[0] > y for x, y in taken):
            taken.append((c[0], c[1]))
            out.append((-t, *c))
    return sorted(out, key=lambda x: x[1])


def _enough(covered: int, size: int) -> bool:
    """Short statements must be nearly whole; of longer notices 20 words will do."""
    return covered >= 4 and (covered >= 20 or covered >= 0.8 * size)


def licences(docs: DataFrame, templates: Mapping[str, str] | None = None, min_match: int = 3, gap: int = 12) -> DataFrame:
    """The licence spans of each text: which template, where, which of its words (end exclusive), how many are covered.

    Positions are characters of the text. Texts of any length are scanned whole. Words are compared without case and
    punctuation. Null and empty texts and rows without doc_id have no spans; repeated rows come out
    as often as they went in. Extra columns are ignored; an empty table gives an empty result.
    """
    # the default templates are long; each worker has its own
    fixed = tuple(templates.items()) if templates else None

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = _automaton(fixed, min_match)
        known = a.vocabulary
        for batch in batches:
            rows = []
            for doc, text in zip(batch["_id"].tolist(), batch["_text"].tolist()):
                low = common.lowered(text)
                words = WORD.findall(low)
                found = a.matches(np.fromiter((known.get(w, 0) for w in words), np.int32, len(words)))
                if not found:
                    continue
                best = chains(a, found, gap)
                if best:
                    spans = [m.span() for m in WORD.finditer(low)]
                    rows += [(doc, a.names[t], spans[x][0], spans[y][1], u, v + 1, n, n / a.sizes[t]) for t, x, y, u, v, n in best]
            yield pd.DataFrame(rows, columns=["doc_id", "template", "start_char", "end_char", "template_start", "template_end", "n_covered", "coverage"])

    some = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text")).where(F.col("_id").isNotNull() & F.col("_text").isNotNull())
    return some.mapInPandas(scan, FOUND)


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence spans of all documents; odd rows as in licences."""
    return licences(common.read(spark, sf_dir, "documents"))
