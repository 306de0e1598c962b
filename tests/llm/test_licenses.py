import random

import numpy as np

from quillgrove.llm import common, licenses


def test_matching_statistics_by_brute_force():
    rng = random.Random(2)
    for _ in range(40):
        templates = {f"t{i}": " ".join(rng.choice("abcd") for _ in range(rng.randint(3, 14))) for i in range(3)}
        a = licenses.Automaton(templates, 2)
        words = [rng.choice("abcdz") for _ in range(40)]
        inside = {tuple(t.split()[i:j]) for t in templates.values() for i in range(99) for j in range(i + 1, len(t.split()) + 1)}
        longest = [max((n for n in range(i + 2) if tuple(words[i + 1 - n : i + 1]) in inside or n == 0)) for i in range(40)]
        want = [(i, longest[i]) for i in range(40) if longest[i] >= 2 and (i == 39 or longest[i + 1] <= longest[i])]
        found = a.matches(np.array([a.vocabulary.get(w, 0) for w in words]))
        assert [(i, n) for i, n, _ in found] == want
        for i, n, state in found:
            places = {(t, e) for t, text in enumerate(templates.values()) for e in range(n - 1, len(text.split())) if text.split()[e - n + 1 : e + 1] == words[i - n + 1 : i + 1]}
            assert set(a.places[state]) >= places


def chained(templates, words, least, gap):
    """(template, first and last word, words covered) by trying all chains of the maximal common runs."""
    out = []
    for name, text in templates.items():
        t = text.split()
        runs = [(i, j, n) for i in range(len(words)) for j in range(len(t)) for n in range(least, len(t) + 1)
                if words[i : i + n] == t[j : j + n] and len(words[i : i + n]) == n and (i == 0 or j == 0 or words[i - 1] != t[j - 1]) and (i + n == len(words) or j + n == len(t) or words[i + n] != t[j + n])]
        best = {}

        def grow(i, j, covered, first):
            best[first, i - 1] = max(covered, best.get((first, i - 1), 0))
            for x, y, n in runs:
                over = max(0, i - x, j - y)
                if over < n and x >= first and x + n > i and y + n > j and x + over - i <= gap and y + over - j <= gap:
                    grow(x + n, y + n, covered + n - over, first)

        for x, y, n in runs:
            grow(x + n, y + n, n, x)
        out += [(name, a, b, c) for (a, b), c in best.items() if c >= 4 and c >= 0.8 * len(t)]
    return out


def test_chains_by_brute_force():
    rng = random.Random(4)
    met = 0
    for _ in range(150):
        t = [f"w{i}" for i in range(8)]
        templates = {"t": " ".join(t)}
        words = []
        for w in t:
            if rng.random() < 0.12:
                words += ["z"] * rng.randint(1, 4)
            if rng.random() > 0.1:
                words.append(w)
        words = ["z"] * rng.randint(0, 2) + words + ["z"]
        a = licenses.Automaton(templates, 2)
        got = licenses.chains(a, a.matches(np.array([a.vocabulary.get(w, 0) for w in words])), 3)
        want = chained(templates, words, 2, 3)
        assert bool(got) == bool(want)
        if want:
            met += 1
            assert got[0][5] == max(c for *_, c in want)
    assert met > 30


def test_positions_are_those_of_the_text(spark):
    text = "İİİİ Released under the MIT License. End"
    r = licenses.licences(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert text[r["start_char"] : r["end_char"]] == "Released under the MIT License"


def test_other_licences_are_not_taken_for_known_ones(spark):
    rows = {
        "Licensed under the Eclipse Public License 2.0": {"EPL-2.0"},
        "SPDX-License-Identifier: MIT": {"MIT"},
        "Distributed under the Boost Software License, Version 1.0": {"BSL-1.0"},
        "under the terms of the GNU General Public License version 2 only": {"GPL-2.0"},
        "Licensed under the Oak Tree Public Licence 7.0": set(),
        "a licence to drive and the right to park": set(),
    }
    d = spark.createDataFrame([(i, f"alpha beta {t} gamma delta") for i, t in enumerate(rows)], "doc_id long, text string")
    got = {}
    for r in licenses.licences(d).collect():
        got.setdefault(r["doc_id"], set()).add(r["template"].split(" (")[0])
    assert [got.get(i, set()) for i in range(len(rows))] == list(rows.values())


def test_spans(spark, odd, none):
    mit = licenses.TEMPLATES["MIT"].split()
    text = "Some words first. " + " ".join(mit[:40]) + " oddly " + " ".join(mit[41:]) + " and more. Released under the MIT License. End"
    d = spark.createDataFrame([(1, text), (2, "the use of the software and the rights"), (3, "no such thing"), (None, text), (4, text), (4, text)], "doc_id long, text string")
    rows = licenses.licences(d).orderBy("doc_id", "start_char").collect()
    assert [(r["doc_id"], r["template"]) for r in rows] == [(1, "MIT"), (1, "MIT (1)"), (4, "MIT"), (4, "MIT"), (4, "MIT (1)"), (4, "MIT (1)")]
    assert rows[0]["n_covered"] == len(mit) - 1 and (rows[0]["template_start"], rows[0]["template_end"]) == (0, len(mit))
    assert text.lower()[rows[1]["start_char"] : rows[1]["end_char"]] == "released under the mit license"
    assert licenses.licences(odd).count() == licenses.licences(none).count() == 0


def test_statements_of_the_fixture(spark, data):
    texts = {r["doc_id"]: r["text"] for r in common.read(spark, data, "documents").collect()}
    want = {k for k, t in texts.items() if "icense" in t}
    assert {r["doc_id"] for r in licenses.op3_licences(spark, data).collect()} == want


def test_spdx_lines_other_wordings_and_whole_texts(spark):
    gpl = licenses.TEMPLATES["GPL-3.0 (text)"].split()
    texts = {
        "// SPDX-License-Identifier: MIT": "MIT (spdx)",
        "# SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0-or-later (spdx)",
        "SPDX-License-Identifier: MIT OR Apache-2.0": "MIT OR Apache-2.0 (spdx)",
        "It is free under the terms of the MIT license, as ever.": "MIT",
        "distributed under the Eclipse Public License 2.0 only": "EPL-2.0",
        "under the terms of the Common Development and Distribution License": "CDDL",
        "under the Artistic License": "Artistic",
        "under the terms of the GNU Free Documentation License": "GFDL",
        " ".join(gpl[1000:1400]): "GPL-3.0 (text)",
        " ".join(licenses.TEMPLATES["GPL-3.0"].split()): "GPL-3.0",
        "SPDX-License-Identifier: Nothing-9": None,
        "under the terms of the house": None,
    }
    d = spark.createDataFrame(list(enumerate(f"alpha beta {t} gamma delta" for t in texts)), "doc_id long, text string")
    rows = {(r["doc_id"], r["template"].split(" (under")[0]) for r in licenses.licences(d).collect()}
    assert rows == {(i, name) for i, name in enumerate(texts.values()) if name}
