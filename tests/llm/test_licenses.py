"""Licence signatures against a plain search, place by place."""

import random
import re

import pytest

from shapelake.llm import license_scan
from shapelake.llm.license_rules import AFTER, BASE, BEFORE, Rule, rules

SCHEMA = "doc_id long, text string, plain string, words long, f int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA)


def brute(text, signatures):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    base = sorted((k, label) for phrase, label, _ in BASE for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split())
    found = []
    for k, word in enumerate(words):
        for r in signatures:
            if r.keyword != word:
                continue
            after = re.match(f"(?:{r.after}) ", " ".join(words[k : k + AFTER]) + " ")
            left = " " + " ".join(words[max(0, k - BEFORE) : k]) + (" " if k else "")
            before = re.search(f"(?:{r.before})$", left) if r.before else None
            if after and (before or not r.before):
                found.append((k - (max(0, before[0].count(" ") - 1) if before else 0), k + after[0].count(" "), r.number, r.label, r.priority))
    rank = lambda d: (d[4], d[1] - d[0], -d[2])
    kept = {a for a in found if not any(b[0] <= a[0] and b[1] >= a[1] and rank(b) > rank(a) for b in found)}
    return len(words), base, kept


PIECES = ["This work is licensed under the GNU General Public License, version 3.", "All rights reserved.", "Licensed under CC BY-NC 4.0.", "Released under the MIT License", "SPDX-License-Identifier: Apache-2.0", "licensed under the Apache License, Version 2.0", "permission is hereby granted, free of charge, to any person obtaining a copy", "GNU Lesser General Public License version 2.1 or later", "dual licensed under the Mozilla Public License 2.0", "cc by", "CC BY-SA", "Creative Commons Attribution-ShareAlike 4.0", "copyright (c) 2019", "provided as is without warranty of any kind", "https://opensource.org/licenses/BSD-3-Clause", "general public", "license", "mit", "public", "reserved", "unauthorized copying of this file via any medium is strictly prohibited", "école ünd", "w1 w2 w3"]


def test_scan_equals_a_plain_search(spark):
    rng = random.Random(5)
    rows = [(None, None), (1, ""), (2, " .,;\n"), (3, "mit"), (3, "mit"), (4, "reserved rights all"), (5, "rights reserved")]
    rows += [(10 + k, rng.choice((" ", ", ", "\n", "--")).join(rng.choice(PIECES) for _ in range(rng.randrange(1, 12)))) for k in range(120)]
    rows.append((900, " ".join(rng.choice(PIECES) for _ in range(3000))))
    signatures = rules()
    got = license_scan.scan(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    some = lambda rs: sorted(rs, key=str)
    want = some((i, *brute(t, signatures)) for i, t in rows)
    assert some((r.doc_id, r.n_words, sorted(tuple(b) for b in r.base), {tuple(d) for d in r.detections}) for r in got) == want
    assert all(len(r.detections) == len({tuple(d) for d in r.detections}) for r in got)


def test_signatures_are_many_and_can_match():
    signatures = rules()
    assert len(signatures) >= 300 and len({r.number for r in signatures}) == len(signatures)
    assert not any(c in r.before + r.after for r in signatures for c in ".'\\")
    assert all(r.before == "" or r.before.startswith(" ") for r in signatures)


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Licensed under the Apache License, Version 2.0", {"apache-2.0"}),
        ("Released under the MIT License.", {"mit"}),
        ("This work is licensed under the GNU General Public License, version 3.", {"gpl-3.0"}),
        ("SPDX-License-Identifier: MPL-2.0", {"mpl-2.0"}),
        ("Licensed under CC BY-NC 4.0.", {"cc-by-nc-4.0"}),
        ("the train mit dem Zug", set()),
    ],
)
def test_the_most_exact_signature_stays(spark, text, labels):
    got = license_scan.scan(frame(spark, [(1, text)])).first()
    assert {d.label for d in got.detections} == labels


def test_priority_and_containment(spark):
    rule = lambda n, label, after, priority: Rule(n, label, "a", "", after, priority)
    signatures = [rule(0, "short", "a", 9), rule(1, "long", "a b c", 5), rule(2, "same", "a b c", 5), rule(3, "lower", "a b", 4), Rule(4, "over", "c", "", "c d", 1)]
    got = license_scan.scan(frame(spark, [(1, "a b c d")]), signatures=signatures).first()
    assert {d.label for d in got.detections} == {"short", "long", "over"}


def test_summary_and_nothing(spark):
    got = license_scan.summary(license_scan.scan(frame(spark, [(1, "All rights reserved. x All Rights Reserved"), (2, None)]))).orderBy("doc_id").collect()
    assert tuple(got[0])[:8] == (1, 7, 2, 0, 4, "reserved", "reserved", 0.1)
    assert tuple(got[1]) == (2, 0, 0, None, None, "", "", 0.0, 0)
    assert license_scan.scan(frame(spark, [])).count() == 0
    assert license_scan.scan(frame(spark, [(1, "mit license")]), signatures=[]).first().detections == []


def test_no_python_in_the_plan(spark):
    plan = license_scan.scan(frame(spark, [(1, "x")]).where("doc_id > 0"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan.replace("ArrowEvalPython", "Python") and "Exchange" not in plan
