import random
import re

import pytest
from pyspark.sql import functions as F

from peerlight.llm import license_scan as ls
from peerlight.llm.license_rules import BASE, RULES, TAGGED

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

KNOWN = [
    ("SPDX-License-Identifier: Apache-2.0", {"apache-2.0"}),
    ("// SPDX-License-Identifier: GPL-2.0-or-later\n// more", {"gpl-2.0-or-later"}),
    ("Licensed under the Apache License, Version 2.0 (the \"License\");", {"apache-2.0", "apache"}),
    ("Released under the MIT License.", {"mit"}),
    ("see the GNU Lesser General\n * Public License, version 2.1 or later", {"lgpl-2.1-or-later"}),
    ("the GNU Lesser General Public License", {"lgpl"}),
    ("the GNU Affero General Public License v3", {"agpl-3.0-only"}),
    ("the GNU General Public License, version 3", {"gpl", "gpl-3.0-only"}),
    ("This work is licensed under the GNU General Public License, version 3.", {"gpl", "gpl-3.0-only"}),
    ("CC BY-SA 4.0", {"cc-by", "cc-by-sa-4.0"}),
    ("Creative Commons Attribution-NonCommercial 4.0 International License", {"cc-by-nc-4.0"}),
    ("https://creativecommons.org/licenses/by/4.0/", {"cc-by-4.0"}),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
     " associated documentation files", {"mit"}),
    ("under the 3-Clause BSD License", {"bsd-3-clause"}),
    ("Mozilla Public License Version 2.0", {"mpl-2.0"}),
    ("Copyright (c) 2020 Some One. All rights reserved.", {"proprietary"}),
    ("licensed under the Foo Bar License", {"unknown-license"}),
    ("she will permit licenses to be mitigated by the apaches", set()),
    ("gnu general, license: emit license cc byte", set()),
]


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text):
    """All rules without a prefilter, overlaps resolved over all pairs: the query's columns."""
    words = words_of(text)
    line = " " + " ".join(words) + " "
    base = []
    for phrase, label in BASE:
        want = phrase.split()
        base += [(i, label) for i in range(len(words)) if words[i : i + len(want)] == want]
    found = []
    for i, rule in enumerate(RULES):
        for m in re.finditer(f"(?<= )(?:{rule.regex})(?= )", line):
            start = line[: m.start()].count(" ") - 1
            found.append((start, start + m.group().count(" ") + 1, i))
    kept = []
    for s, e, i in sorted(found, key=lambda d: (-RULES[d[2]].priority, d[0] - d[1], d[0], d[2])):
        if not any((a <= s and e <= b) or (s <= a and b <= e) for a, b, _ in kept):
            kept.append((s, e, i))
    own = {x for _, x in base}
    every = own | {RULES[i].label for _, _, i in kept}
    sure = {x: ls.SURE[2] for x in own}
    for _, _, i in kept:
        r = RULES[i]
        sure[r.label] = max(sure.get(r.label, 0), ls.SURE[r.priority])
    wrong = 1.0
    for x in sorted(sure):
        wrong *= 1 - sure[x]
    starts = [s for s, _ in base]
    return (
        len(words), len(base), min(starts, default=None), max(starts, default=None),
        ",".join(sorted(own)), ",".join(sorted(every)), 1 - wrong if sure else 0.0,
    ), sorted(kept)


def query_row(text):
    n_words, base, found = ls.scan(text)
    starts = [s for s, _ in base]
    own = {x for _, x in base}
    return (
        n_words, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)),
        ",".join(sorted(own | {d.label for d in found})), ls.certainty(base, found),
    ), sorted((d.start, d.end, d.rule) for d in found)


@pytest.mark.parametrize("text,labels", KNOWN)
def test_known_notices(text, labels):
    row, _ = query_row(text)
    assert set(filter(None, row[5].split(","))) == labels
    assert (row[6] > 0) == bool(labels) and 0 <= row[6] <= 1


def test_rules_are_well_formed():
    assert len(RULES) > 300 and len(TAGGED) == len(set(TAGGED))
    hand = [(r.label, r.regex) for r in RULES[len(TAGGED) :]]
    assert len(hand) == len(set(hand)) > 200
    assert all(r.keyword == " ".join(r.keyword.split()) and r.priority in ls.SURE for r in RULES)
    for label in TAGGED:
        assert query_row(f"SPDX-License-Identifier: {label}")[0][5] in (label, "cc-by," + label)


def pieces():
    """Spellings that the rules accept, with options taken or left, and loose words."""
    rng = random.Random(3)
    for rule in RULES:
        for _ in range(3):
            text = rule.regex
            while True:
                m = re.search(r"\(\?:([^()]*)\)(\?|\{\d+,\d+\})?", text)
                if not m:
                    break
                take = rng.choice(m.group(1).split("|"))
                if m.group(2) == "?":
                    take = rng.choice(["", take])
                text = text[: m.start()] + take + text[m.end() :]
            text = text.replace("[^ ]+", "acme").replace(r"\d+", "7")
            text = text.replace("[0-9]+", "4")
            text = re.sub(r"\[([^\]]+)\]", lambda m: rng.choice(m.group(1)), text)
            yield rule, re.sub(r"(.)\?", lambda m: rng.choice(["", m.group(1)]), text)


def test_every_match_holds_its_keyword():
    for rule, text in pieces():
        line, _ = ls.word_line(text)
        assert re.search(f"(?<= )(?:{rule.regex})(?= )", line), (rule, text)
        assert f" {rule.keyword} " in line


def test_equal_to_brute_force():
    rng = random.Random(4)
    known = [t for _, t in pieces()] + [t for t, _ in KNOWN]
    loose = "the a software of Licence LICENSE gnu gpl mit cc by 2 0 3 or later apache public -- été".split()
    for _ in range(250):
        parts = [rng.choice(known) if rng.random() < 0.5 else rng.choice(loose) for _ in range(rng.randrange(12))]
        text = rng.choice([" ", "\n * ", ", "]).join(parts)
        assert query_row(text) == brute(text)


def test_many_detections_in_one_text():
    text = "mit license gnu general public license version 2 or later and " * 3_000
    row, found = query_row(text)
    assert row[:4] == (3_000 * 11, 6_000, 0, 2_999 * 11 + 2) and len(found) == 6_000
    assert row[5] == "gpl,gpl-2.0-or-later,mit"


def test_query_equals_brute_force_on_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = ls.op12_license_scan(spark, "/root/testdata/sf0.001")
    assert got.columns == [
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
    ]
    want = sorted((r.doc_id, *brute(r.text)[0]) for r in docs)
    assert sorted(map(tuple, got.collect())) == want and sum(r[2] for r in want) == 3


def test_odd_rows_and_spans(spark, odd_docs, no_docs):
    clash = odd_docs.selectExpr("*", "1 AS s", "'x' AS labels", "2 AS n_words")
    got = clash.select("doc_id", ls.license_summary(F.col("text")).alias("s")).select("doc_id", "s.*").collect()
    want = [(r.doc_id, *brute(r.text)[0]) for r in odd_docs.collect()]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert no_docs.select(ls.license_summary(F.col("text"))).count() == 0
    rows = spark.createDataFrame([("Under the  MIT-License; see GPLv3.",), (None,), ("x",)], "text string")
    spans = [r[0] for r in rows.select(ls.license_spans(F.col("text"))).collect()]
    assert [tuple(x) for x in spans[0]] == [("mit", 2, 1, 4, "the mit license"), ("gpl-3.0-only", 3, 5, 6, "gplv3")]
    assert spans[1:] == [[], []]
