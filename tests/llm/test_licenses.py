import itertools
import random
import re
import re._parser as parser
import time

import pytest

from quorvia.llm.licenses import BASE_PHRASES, SIGNATURES, SPDX_IDS, detect, lay_out, license_summary, scan_licenses, scan_text, words_of
from quorvia.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def brute(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hits = []
    for phrase, label in BASE_PHRASES.items():
        p = phrase.split()
        hits += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    at = [i for i, _ in hits]
    return len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op10_licenses"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(docs[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert any(r.n_base for r in rows)


def test_rules():
    assert len(SIGNATURES) >= 200
    found = lambda t: [(x[2], x[3]) for x in scan_text(t)[2]]
    assert found("SPDX-License-Identifier: GPL-2.0-only") == [("gpl-2.0", "tag")]
    assert found("Licensed under the Apache License, Version 2.0") == [("apache-2.0", "grant")]
    assert found("see https://creativecommons.org/licenses/by-sa/4.0/ now") == [("cc-by-sa-4.0", "address")]
    assert found("CC BY-NC-SA 4.0 and the MIT License") == [("cc-by-nc-sa-4.0", "versioned"), ("mit", "name")]
    assert found("GNU Lesser General Public License v2.1") == [("lgpl-2.1", "versioned")]
    assert found("commit license emit licenses") == []
    assert scan_text("a CC by cc BY, b")[1] == [("cc-by", 1), ("cc-by", 3)]


def test_odd_rows(spark):
    texts = [None, "", "...", "é MIT-License", "mit\nlicense mit license", "x " * 200000 + "apache license", "émit license", "mit license", "mit license", "İ cc_by"]
    df = spark.createDataFrame([(i if i else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    rows = sorted(license_summary(scan_licenses(df)).collect(), key=lambda r: r.doc_id or 0)
    assert [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows] == [brute(t) for t in texts]
    assert license_summary(scan_licenses(df.limit(0))).count() == 0


def generated(parsed):
    """Texts of every alternative of a parsed expression: each part left out, or once."""
    parts = []
    for op, value in parsed:
        name = str(op)
        if name == "LITERAL":
            parts.append([chr(value)])
        elif name == "IN":
            parts.append([chr(v) for o, v in value if str(o) == "LITERAL"])
        elif name == "ANY":
            parts.append(["x"])
        elif name == "SUBPATTERN":
            parts.append(list(generated(value[-1])))
        elif name == "BRANCH":
            parts.append([t for branch in value[1] for t in generated(branch)])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            assert value[1] >= 1
            parts.append([""] * (value[0] == 0) + list(generated(value[2])))
        else:
            assert name in ("ASSERT", "ASSERT_NOT")
    return ("".join(x) for x in itertools.product(*parts))


def test_every_match_passes_its_gate():
    n = 0
    for rule in SIGNATURES:
        for body in generated(parser.parse(rule.pattern.pattern.decode())):
            laid = f" {body} ".encode()
            assert rule.pattern.search(laid) and rule.keyword in laid, (rule, body)
            n += 1
    assert n > len(SIGNATURES)


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("the FreeBSD License", "bsd-2-clause"),
        ("Simplified License", "bsd-2-clause"),
        ("2-Clause License", "bsd-2-clause"),
        ("Simplified BSD License", "bsd-2-clause"),
        ("Creative Commons Attribution-Non-Commercial 3.0", "cc-by-nc-3.0"),
        ("Creative Commons Attribution-Share Alike 3.0", "cc-by-sa-3.0"),
        ("Creative Commons Attribution-NonCommercial-ShareAlike 3.0", "cc-by-nc-sa-3.0"),
        ("Creative Commons Attribution-Non Commercial-No Derivatives 4.0", "cc-by-nc-nd-4.0"),
    ],
)
def test_names_in_two_words(text, label):
    assert [x[2] for x in scan_text(text)[2]] == [label]


def test_a_tag_for_every_identifier():
    found = lambda t: [(x[2], x[3]) for x in scan_text(t)[2]]
    for label, own in SPDX_IDS:
        for end in ("", "-only", "-or-later", "+") if label.split("-")[0] in ("gpl", "lgpl", "agpl", "gfdl") else ("",):
            assert found(f"// SPDX-License-Identifier: {own.upper()}{end}") == [(label, "tag")], own
    real = {"MIT": "mit", "ISC": "isc", "Zlib": "zlib", "EPL-2.0": "epl-2.0", "BSL-1.0": "bsl-1.0", "Artistic-2.0": "artistic-2.0", "OFL-1.1": "ofl-1.1", "AFL-3.0": "afl-3.0", "PostgreSQL": "postgresql", "MS-PL": "ms-pl"}
    for own, label in real.items():
        assert found(f"SPDX-License-Identifier: {own}") == [(label, "tag")]
    assert found("SPDX-License-Identifier: MIT-0") == [("mit-0", "tag")] and found("SPDX-License-Identifier: commit") == []
    tags = [s for s in SIGNATURES if s.form == "tag"]
    assert len(tags) == len(SPDX_IDS) == len(set(SPDX_IDS))


def ungated(laid):
    """All rules without their gates, against all detections that stand so far."""
    standing = []
    for rule in SIGNATURES:
        for m in rule.pattern.finditer(laid):
            if not any(a <= m.start() and m.end() <= b for a, b, *_ in standing):
                standing.append((m.start(), m.end(), rule.label, rule.form))
    return sorted(standing)


def test_detections_against_all_rules_and_intervals(spark):
    rng = random.Random(3)
    words = "licensed under the terms of gnu general public license version 2 0 3 or later apache mit bsd clause cc by nc sa spdx identifier gpl lgpl mozilla v2 is in public domain lesser library affero creative commons attribution opensource org licenses".split()
    laid = [f" {' '.join(rng.choice(words) for _ in range(rng.randrange(120)))} ".encode() for _ in range(200)]
    laid += [lay_out(words_of(r.text)) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    found = [detect(x) for x in laid]
    assert found == [ungated(x) for x in laid] and sum(map(len, found)) > 200


def test_very_many_detections():
    began = time.perf_counter()
    n, base, found = scan_text("mit license " * 87_000)
    assert (n, len(base), len(found)) == (174_000, 87_000, 87_000)
    assert time.perf_counter() - began < 5
