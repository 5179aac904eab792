import re
from re import _constants as sre, _parser

import pandas as pd
import pytest

from worksrisk.llm import licenses
from worksrisk.llm.license_rules import CONFIDENCE, ROOTS, SIGNS, rules


def java(pattern):
    return re.compile(pattern.replace(r"\x5F", "_"), re.ASCII)


RULES = [(r, java(r.pattern)) for r in rules()]


def lower_ascii(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_ascii(text))
    places, base = [], set()
    for label, phrase in licenses.BASE.items():
        want = phrase.split()
        for i in range(len(words) - len(want) + 1):
            if words[i:i + len(want)] == want:
                places.append(i)
                base.add(label)
    hits = [(m.start(), m.end(), r.priority, i, r.label) for i, (r, p) in enumerate(RULES)
            for m in p.finditer(text)]
    hits = [h for h in hits if not any(
        g != h and g[0] <= h[0] and g[1] >= h[1] and
        (g[2] > h[2] or g[2] == h[2] and (g[1] - g[0] > h[1] - h[0] or
                                          (g[:2] == h[:2] and g[3] < h[3]))) for g in hits)]
    best = {label: CONFIDENCE[2] for label in base}
    for h in hits:
        best[h[4]] = max(best.get(h[4], 0), CONFIDENCE[h[2]])
    score = 1.0
    for label in best:
        score *= 1 - best[label]
    return (len(words), len(places), min(places, default=None), max(places, default=None),
            ",".join(sorted(base)), ",".join(sorted(best)), 1 - score)


TEXTS = [
    None, "", "   ", "Released under the MIT License.", "mit license MIT LICENSE mit-license",
    "Apache License, Version 2.0 and the GNU General\n * Public License, version 3 or later",
    "GNU General Public License v2 general public license", "emit license, mit licenses",
    "ümit license mit licenseé", "SPDX-License-Identifier: GPL-3.0-or-later",
    "Creative Commons Attribution-ShareAlike 4.0 International", "Licensed under CC BY-NC 4.0.",
    "Permission is hereby granted, free of charge, to any person obtaining a copy",
    "https://creativecommons.org/licenses/by-nc/4.0/ http://www.apache.org/licenses/LICENSE-2.0",
    "word " * 20_000 + "mit license " * 300, "BSD 3-Clause License; 2-Clause BSD",
    "Boost Software License 1.0 - http://www.boost.org/LICENSE_1_0.txt",
    "Copyright (c) 2019 Somebody. All rights reserved. KK", "日本語 mit license 日本語",
]


def near(got, want):
    assert got[:6] == want[:6]
    assert got[6] == pytest.approx(want[6])


def test_keywords_hold_a_root_and_stand_in_matches():
    for rule, _ in RULES:
        assert any(root in rule.keyword for root in ROOTS), rule
    for text in TEXTS:
        plain = re.sub(SIGNS + "+", " ", (text or "").lower())
        for rule, pattern in RULES:
            if pattern.search(text or ""):
                assert rule.keyword in plain, rule


def forms(tree):
    """Texts that a parsed pattern matches: the first form, then one for each other branch."""
    texts = [""]
    for op, arg in tree:
        if op is sre.LITERAL:
            one = [chr(arg)]
        elif op is sre.IN:
            kind, first = arg[0]
            one = [" " if (sre.CATEGORY, sre.CATEGORY_SPACE) in arg else
                   '"' if arg == [(sre.CATEGORY, sre.CATEGORY_NOT_WORD)] else
                   "1" if kind is sre.CATEGORY else chr(first if kind is sre.LITERAL else first[0])]
            one += [chr(a) for k, a in arg[1:] if k is sre.LITERAL and one != [" "]]
        elif op is sre.BRANCH:
            one = [t for b in arg[1] for t in forms(b)]
        elif op is sre.SUBPATTERN:
            one = forms(arg[3])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            least, most, inner = arg
            one = [t * max(1, least) for t in forms(inner)] + ([""] if not least else [])
        elif op in (sre.ASSERT, sre.ASSERT_NOT, sre.AT):
            one = [""]
        else:
            raise ValueError(op)
        texts = [t + one[0] for t in texts] + [texts[0] + o for o in one[1:]]
    return texts


def test_every_branch_passes_the_gates():
    for rule, pattern in RULES:
        tried = [t for t in forms(_parser.parse(pattern.pattern, re.ASCII)) if pattern.search(t)]
        assert tried, rule
        for text in tried:
            plain = re.sub(SIGNS + "+", " ", text.lower())
            assert rule.keyword in plain, (rule, text)
            for wrapped in (text, text.replace(" ", "\n  ")):
                assert any(root in wrapped.lower() for root in ROOTS), (rule, wrapped)


def test_links_and_spellings_behind_the_gate(spark):
    want = {"http://www.gnu.org/licenses/old-licenses/gpl-2.0.html": "gpl",
            "http://www.gnu.org/licenses/old-licenses/lgpl-2.1.html": "lgpl",
            "https://opensource.org/license/mit": "mit", "https://opensource.org/license/bsd-3-clause": "bsd",
            "https://www.eclipse.org/org/legal/epl-v10.html": "epl", "see the LICENCE file": "license-mention",
            "provided AS\nIS without warranty of any kind": "warranty-disclaimer"}
    docs = spark.createDataFrame([(t, t) for t in want], "doc_id string, text string")
    for row in licenses.scan(docs).collect():
        assert want[row.doc_id] in row.labels.split(","), row
        near(tuple(row)[1:8], brute(row.doc_id))


def test_gaps_of_any_length(spark):
    gap = "\n" + " " * 17
    want = {"Redistribution and use in" + gap + "source and binary forms": "bsd",
            "SPDX-License-Identifier:" + " " * 9 + "MIT": "mit",
            "CC" + gap + "BY-SA" + gap + "4.0": "cc-by-sa-4.0",
            "GNU General Public License" + gap + "version" + gap + "2": "gpl-2",
            "GPL v2": "gpl-2", "GPL 3": "gpl-3", "OpenRAIL v1": "rail-1", "Copyright 2019": "copyright",
            "Attribution-ShareAlike 4.0": "cc-by-sa-4.0",
            "provided" + " *\n" * 5000 + "\"AS IS\" without warranty of any kind": "warranty-disclaimer"}
    want |= {re.sub("[ -]", "  \n#" + " " * 20, t): want[t] for t in list(want) if "SPDX" not in t and "\n" not in t}
    docs = spark.createDataFrame([(t, t) for t in want], "doc_id string, text string")
    for row in licenses.scan(docs).collect():
        assert want[row.doc_id] in row.labels.split(","), row
        near(tuple(row)[1:8], brute(row.doc_id))


def test_there_are_hundreds():
    assert len(RULES) > 250 and len({r.label for r, _ in RULES}) > 80


def test_scan_matches_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] * 2,
                                 "doc_id long, text string, labels string")
    got = licenses.scan(docs).collect()
    assert len(got) == 2 * len(TEXTS)
    for row in got:
        near(tuple(row)[1:8], brute(TEXTS[row.doc_id]))
        for h in row.found:
            assert TEXTS[row.doc_id][h.start:h.upto] == h.text
    assert licenses.scan(docs.limit(0)).count() == 0


def test_labels_of_common_statements(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    labels = {r.doc_id: r.labels for r in licenses.scan(docs).collect()}
    assert labels[3] == "license-mention,mit"
    assert labels[9] == "gpl-3.0"
    assert labels[11] == "cc-by-nc-4.0"
    assert "apache-2.0" in labels[5] and "gpl-3" in labels[5]


def test_query_against_brute_force(spark, sf):
    from worksrisk.llm import queries
    docs = pd.read_parquet(f"{sf}/documents.parquet").set_index("doc_id")
    got = queries.op6_license_scan(spark, sf).collect()
    assert len(got) == len(docs)
    for row in got:
        near(tuple(row)[1:8], brute(docs.text[row.doc_id]))
