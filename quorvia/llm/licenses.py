"""Licence detection by ordered signature rules.

A text is lower-cased (A-Z), cut into words and laid out as words with single spaces between.
Each rule is a regular expression over that layout, gated by a keyword that every match
holds. Rules are tried in order of their form: identifier tags before addresses, grants,
full names and short names. A detection that lies inside an earlier rule's is suppressed;
the standing ones are kept by start with the farthest end so far, so the search is by halving. Base phrases are counted apart and
always keep their labels.

Defined results: a null or empty text has no words, no labels and score 0; repeated rows are
scanned each; an empty table gives no rows; columns besides id and text are ignored, whatever
their names; a text of any length is scanned whole, in time about linear in its length, and
must fit into a task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorvia.llm.common import record_batches

#: A-Z become a-z; bytes that belong to no word become spaces.
LAYOUT = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))

BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: (label, keyword, name, versions): the keyword, a word or several, stands in every match of the name; versions
#: are written with spaces for dots, and only their first is meant where none is given.
FAMILIES = (
    ("gpl", "gpl", r"(?:gnu )?gpl", ("2 0", "3 0", "1 0")),
    ("gpl", "general", r"gnu (?:library or lesser )?general public licen[cs]e", ("2 0", "3 0", "1 0")),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl", ("2 1", "3 0", "2 0")),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public licen[cs]e", ("2 1", "3 0")),
    ("lgpl", "library", r"(?:gnu )?library general public licen[cs]e", ("2 0",)),
    ("agpl", "agpl", r"(?:gnu )?agpl", ("3 0", "1 0")),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[cs]e", ("3 0", "1 0")),
    ("gfdl", "documentation", r"(?:gnu )?free documentation licen[cs]e", ("1 3", "1 2", "1 1")),
    ("apache", "apache", r"apache(?: software)? licen[cs]e", ("2 0", "1 1", "1 0")),
    ("mpl", "mozilla", r"mozilla public licen[cs]e", ("2 0", "1 1", "1 0")),
    ("mpl", "mpl", r"mpl", ("2 0", "1 1")),
    ("epl", "eclipse", r"eclipse public licen[cs]e", ("2 0", "1 0")),
    ("cddl", "cddl", r"cddl", ("1 0", "1 1")),
    ("cddl", "distribution", r"common development and distribution licen[cs]e", ("1 0", "1 1")),
    ("cpl", "common", r"common public licen[cs]e", ("1 0",)),
    ("eupl", "eupl", r"eupl", ("1 2", "1 1")),
    ("eupl", "european", r"european union public licen[cs]e", ("1 2", "1 1")),
    ("bsl", "boost", r"boost(?: software)? licen[cs]e", ("1 0",)),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]e", ()),
    ("ms-rl", "reciprocal", r"microsoft reciprocal licen[cs]e", ()),
    ("artistic", "artistic", r"artistic licen[cs]e", ("2 0", "1 0")),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e", ()),
    ("wtfpl", "wtfpl", r"wtfpl", ("2 0",)),
    ("unlicense", "unlicense", r"(?:the )?unlicense", ()),
    ("isc", "isc", r"isc licen[cs]e", ()),
    ("mit", "mit", r"mit(?: x11)? licen[cs]e", ()),
    ("mit", "expat", r"expat licen[cs]e", ()),
    ("bsd-2-clause", "clause", r"(?:bsd )?2 clause (?:bsd )?licen[cs]e|bsd 2 clause", ()),
    ("bsd-2-clause", "simplified", r"simplified (?:bsd )?licen[cs]e", ()),
    ("bsd-2-clause", "freebsd", r"freebsd (?:bsd )?licen[cs]e", ()),
    ("bsd-3-clause", "bsd", r"(?:(?:new|modified|revised) bsd|(?:bsd )?3 clause bsd) licen[cs]e|bsd 3 clause", ()),
    ("bsd", "bsd", r"bsd(?: style)? licen[cs]e", ()),
    ("0bsd", "0bsd", r"0bsd", ()),
    ("psf", "python", r"python software foundation licen[cs]e", ("2 0",)),
    ("php", "php", r"php licen[cs]e", ("3 01", "3 0")),
    ("ruby", "ruby", r"ruby licen[cs]e", ()),
    ("openssl", "openssl", r"openssl licen[cs]e", ()),
    ("ofl", "font", r"sil open font licen[cs]e", ("1 1", "1 0")),
    ("osl", "open", r"open software licen[cs]e", ("3 0", "2 1")),
    ("afl", "academic", r"academic free licen[cs]e", ("3 0", "2 1")),
    ("odbl", "database", r"open (?:data commons )?(?:open )?database licen[cs]e", ("1 0",)),
    ("odc-by", "odc", r"odc by", ("1 0",)),
    ("pddl", "pddl", r"pddl", ("1 0",)),
    ("ncsa", "ncsa", r"ncsa open source licen[cs]e", ()),
    ("postgresql", "postgresql", r"postgresql licen[cs]e", ()),
    ("bsl-1.1", "business", r"business source licen[cs]e", ("1 1",)),
    ("sspl", "side", r"server side public licen[cs]e", ("1 0",)),
    ("elastic", "elastic", r"elastic licen[cs]e", ("2 0",)),
    ("cc0", "cc0", r"cc0", ("1 0",)),
    ("cc0", "creative", r"creative commons zero", ("1 0",)),
    ("cc-by-nc-nd", "cc by nc nd", r"cc by nc nd", ("4 0", "3 0", "2 0")),
    ("cc-by-nc-sa", "cc by nc sa", r"cc by nc sa", ("4 0", "3 0", "2 0")),
    ("cc-by-nc", "cc by nc", r"cc by nc", ("4 0", "3 0", "2 0")),
    ("cc-by-nd", "cc by nd", r"cc by nd", ("4 0", "3 0", "2 0")),
    ("cc-by-sa", "cc by sa", r"cc by sa", ("4 0", "3 0", "2 0")),
    ("cc-by", "cc by", r"cc by", ("4 0", "3 0", "2 0")),
    ("cc-by-nc-nd", "attribution", r"creative commons attribution non ?commercial no ?derivatives", ("4 0", "3 0")),
    ("cc-by-nc-sa", "attribution", r"creative commons attribution non ?commercial share ?alike", ("4 0", "3 0")),
    ("cc-by-nc", "attribution", r"creative commons attribution non ?commercial", ("4 0", "3 0")),
    ("cc-by-sa", "attribution", r"creative commons attribution share ?alike", ("4 0", "3 0")),
    ("cc-by", "attribution", r"creative commons attribution", ("4 0", "3 0")),
    ("public-domain", "domain", r"(?:dedicated to|released into|in) the public domain", ()),
    ("proprietary", "reserved", r"all rights reserved", ()),
)

#: Names that mean a licence only together with a version.
SHORT = (
    ("apache-2.0", "apache", r"apache (?:version |v)?2(?: 0)?"),
    ("lgpl-2.1", "lgplv2", r"lgplv2 1"),
    ("gpl-2.0", "gplv2", r"gplv2"),
    ("gpl-3.0", "gplv3", r"gplv3"),
    ("lgpl-3.0", "lgplv3", r"lgplv3"),
    ("agpl-3.0", "agplv3", r"agplv3"),
)

#: Addresses, as words.
ADDRESSES = (
    ("apache-2.0", "apache", r"apache org licen[cs]es license 2 0"),
    ("gpl", "gnu", r"gnu org (?:copyleft|licenses) gpl"),
    ("lgpl", "gnu", r"gnu org (?:copyleft|licenses) lgpl"),
    ("agpl", "gnu", r"gnu org licenses agpl"),
    ("mpl-2.0", "mozilla", r"mozilla org mpl 2 0"),
    ("mit", "opensource", r"opensource org licenses? mit(?: license)?"),
    ("bsd-3-clause", "opensource", r"opensource org licenses? bsd 3 clause"),
    ("bsd-2-clause", "opensource", r"opensource org licenses? bsd 2 clause"),
    ("epl-2.0", "eclipse", r"eclipse org legal epl 2 0"),
    ("unlicense", "unlicense", r"unlicense org"),
    ("cc0-1.0", "creativecommons", r"creativecommons org publicdomain zero 1 0"),
    *((f"cc-{kind}-{v.replace(' ', '.')}", "creativecommons", f"creativecommons org licenses {kind.replace('-', ' ')} {v}") for kind in ("by-nc-nd", "by-nc-sa", "by-nc", "by-nd", "by-sa", "by") for v in ("4 0", "3 0", "2 0")),
)

#: Sentences of the licence texts themselves.
SENTENCES = (
    ("mit", "granted", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "merchantability", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("isc", "fee", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse", r"neither the name of .{1,200}? may be used to endorse or promote products"),
    ("apache-2.0", "compliance", r"you may not use this file except in compliance with the license"),
    ("gpl", "redistribute", r"(?:you can|may) redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "redistribute", r"(?:you can|may) redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("zlib", "arising", r"in no event will the authors be held liable for any damages arising from the use of this software"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", "fuck", r"you just do what the fuck you want to"),
)

#: Identifiers of the SPDX list, by the label of their tags; "-only", "-or-later" and "+" may follow.
SPDX_IDS = (
    *((f"{kind}-{v}", f"{kind}-{v}") for kind, versions in (
        ("gpl", "1.0 2.0 3.0"), ("lgpl", "2.0 2.1 3.0"), ("agpl", "1.0 3.0"), ("gfdl", "1.1 1.2 1.3"), ("apache", "1.0 1.1 2.0"), ("mpl", "1.0 1.1 2.0"),
        ("epl", "1.0 2.0"), ("cddl", "1.0 1.1"), ("cpl", "1.0"), ("eupl", "1.0 1.1 1.2"), ("bsl", "1.0"), ("artistic", "1.0 2.0"), ("psf", "2.0"), ("php", "3.0 3.01"),
        ("ofl", "1.0 1.1"), ("osl", "1.0 1.1 2.0 2.1 3.0"), ("afl", "1.1 1.2 2.0 2.1 3.0"), ("odbl", "1.0"), ("odc-by", "1.0"), ("pddl", "1.0"), ("sspl", "1.0"), ("elastic", "2.0"), ("cc0", "1.0"),
        *((f"cc-{part}", "1.0 2.0 2.5 3.0 4.0") for part in ("by-nc-nd", "by-nc-sa", "by-nc", "by-nd", "by-sa", "by")),
    ) for v in versions.split()),
    *((own, own) for own in ("mit", "isc", "zlib", "unlicense", "wtfpl", "0bsd", "bsd-2-clause", "bsd-3-clause", "ms-pl", "ms-rl", "ncsa", "postgresql", "ruby", "openssl")),
    ("bsl-1.1", "busl-1.1"),
    # of their own, though a shorter identifier stands in them
    *((own, own) for own in ("mit-0", "bsd-1-clause", "bsd-4-clause", "bsd-2-clause-patent", "bsd-3-clause-clear", "bsd-3-clause-attribution", "bsd-3-clause-lbnl")),
    # variants of a text that share its label
    *(("artistic-1.0", own) for own in ("artistic-1.0-perl", "artistic-1.0-cl8")),
    *((f"gfdl-{v}", f"gfdl-{v}-{kind}") for v in ("1.1", "1.2", "1.3") for kind in ("invariants", "no-invariants")),
    *((f"ofl-{v}", f"ofl-{v}-{kind}") for v in ("1.0", "1.1") for kind in ("rfn", "no-rfn")),
    ("mpl-2.0", "mpl-2.0-no-copyleft-exception"),
    ("psf-2.0", "python-2.0"),
)

#: How sure a form is, by form, strongest first.
FORMS = {"tag": 1.0, "address": 0.95, "sentence": 0.9, "grant": 0.85, "versioned": 0.8, "name": 0.6}


@dataclass(frozen=True)
class Signature:
    label: str
    form: str
    keyword: bytes
    pattern: re.Pattern[bytes]


def _signature(label: str, form: str, keyword: str, body: str) -> Signature:
    return Signature(label, form, f" {keyword} ".encode(), re.compile(f"(?<= )(?:{body})(?= )".encode()))


def signatures() -> list[Signature]:
    """All rules in their order: by form, then as listed (longer variants of a family first)."""
    found = [_signature(label, "address", key, body) for label, key, body in ADDRESSES]
    found += [_signature(label, "sentence", key, body) for label, key, body in SENTENCES]
    found += [_signature(label, "versioned", key, body) for label, key, body in SHORT]
    # longer identifiers first: what stands in them is suppressed; a final 0 may be missing
    for label, own in sorted(SPDX_IDS, key=lambda x: (-len(x[1]), x)):
        body = own.replace("-", " ").replace(".", " ")
        body = f"{body[:-2]}(?: 0|(?! [0-9]))" if own.endswith(".0") else body
        found.append(_signature(label, "tag", "spdx", f"spdx license identifier {body}(?: only| or later)?"))
    for label, key, name, versions in FAMILIES:
        for version in versions:
            # "version 2", "v2 0", "2 0 or later": a final 0 may be missing
            number = rf"(?:version |v)?{version[:-2]}(?: 0)?" if version.endswith(" 0") else f"(?:version |v)?{version}"
            own = f"{label}-{version.replace(' ', '.')}"
            found.append(_signature(own, "grant", key, rf"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?(?:{name}) {number}"))
            found.append(_signature(own, "versioned", key, rf"(?:{name}) {number}(?: international| unported)?"))
        found.append(_signature(label, "grant", key, rf"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?(?:{name})"))
        found.append(_signature(label, "name", key, name))
    order = {form: i for i, form in enumerate(FORMS)}
    return sorted(found, key=lambda s: order[s.form])


SIGNATURES = signatures()
_KEYWORDS = sorted({s.keyword for s in SIGNATURES})
#: A text without any of these words holds no keyword.
_FIRST_WORDS = frozenset(k.split()[0] for k in _KEYWORDS)
_BASE = [(f" {phrase} ".encode(), label) for phrase, label in BASE_PHRASES.items()]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LAYOUT).split()


def lay_out(words: list[bytes]) -> bytes:
    """The words with single spaces between and at either end."""
    return b" " + b" ".join(words) + b" "


def detect(laid: bytes) -> list[tuple[int, int, str, str]]:
    """(start, end, label, form) of the detections that stand, in order, in a single-spaced layout."""
    held = {k for k in _KEYWORDS if k in laid}
    standing: list[tuple[int, int, str, str]] = []
    # starts of those that stand, sorted, and for each the farthest end of those up to it
    starts = ends = reach = np.zeros(0, np.int64)
    for rule in SIGNATURES if held else ():
        if rule.keyword not in held:
            continue
        spans = np.array([m.span() for m in rule.pattern.finditer(laid)], np.int64).reshape(-1, 2)
        if len(spans) and len(starts):  # a rule's own matches never overlap
            before = np.searchsorted(starts, spans[:, 0], "right") - 1
            spans = spans[(before < 0) | (reach[before] < spans[:, 1])]
        if len(spans):
            standing += [(a, b, rule.label, rule.form) for a, b in spans.tolist()]
            order = np.argsort(starts := np.concatenate([starts, spans[:, 0]]), kind="stable")
            starts, ends = starts[order], np.concatenate([ends, spans[:, 1]])[order]
            reach = np.maximum.accumulate(ends)
    return sorted(standing)


def scan_text(text: str | None) -> tuple:
    """n_words, base hits [(label, word)], detections [(first word, words, label, form)]."""
    words = words_of(text)
    n_words = len(words)
    if _FIRST_WORDS.isdisjoint(words):
        return n_words, [], []
    laid = lay_out(words)
    gaps = np.flatnonzero(np.frombuffer(laid, np.uint8) == 32)
    word = lambda places: np.searchsorted(gaps, np.array(places, np.int64)).tolist()  # noqa: E731  the number of gaps before each
    base = []
    for phrase, label in _BASE:
        places, at = [], laid.find(phrase)
        while at >= 0:
            places.append(at)
            at = laid.find(phrase, at + 1)
        base += [(label, w) for w in word(places)]
    found = detect(laid)
    first, last = word([a for a, *_ in found]), word([b for _, b, *_ in found])
    return n_words, base, [(a - 1, b - a + 1, label, form) for a, b, (*_, label, form) in zip(first, last, found, strict=True)]


SCHEMA = "n_words long, base array<struct<label string, word long>>, detections array<struct<first_word long, n_words long, label string, form string>>"


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, base (every place of a base phrase), detections (those that stand)."""
    source = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    base_type = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
    found_type = pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64()), ("label", pa.string()), ("form", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in record_batches(batches, text="__text"):
            n, base, found = zip(*map(scan_text, batch.column("__text").to_pylist()), strict=True)
            base = [[{"label": label, "word": w} for label, w in x] for x in base]
            found = [[{"first_word": a, "n_words": k, "label": label, "form": form} for a, k, label, form in x] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(base, base_type), pa.array(found, found_type)], [id_col, "n_words", "base", "detections"])

    return source.mapInArrow(run, f"`{id_col}` {source.schema[id_col].dataType.simpleString()}, {SCHEMA}")


def license_summary(scanned: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score (the surest standing form)."""
    labels = lambda *c: F.array_join(F.array_sort(F.array_distinct(F.concat(*c))), ",")
    sure = F.create_map(*[F.lit(x) for form, s in FORMS.items() for x in (form, s)])
    score = F.coalesce(F.array_max(F.transform("detections.form", lambda f: sure[f])), F.lit(0.0))
    return scanned.select(
        id_col,
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.word").alias("first_word"),
        F.array_max("base.word").alias("last_word"),
        labels(F.col("base.label")).alias("base_labels"),
        labels(F.col("base.label"), F.col("detections.label")).alias("labels"),
        score.alias("score"),
    )
