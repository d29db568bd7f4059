import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np

from quorvia.llm.periods import periodic_runs, smallest_periods, stretches
from quorvia.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain(words, exponent=4, least=6):
    """Runs by their definition: every interval whose smallest period fits and that can't be extended."""
    n, found = len(words), []
    for q in range(1, n // exponent + 1):
        s = 0
        while s + q < n:
            e = s + q
            while e < n and words[e] == words[e - q]:
                e += 1
            if e - s >= max(least, exponent * q) and not any(all(words[i] == words[i + r] for i in range(s, e - r)) for r in range(1, q)):
                found.append((s, e - s, q))
            s = max(s + 1, e - q + 1)
    return sorted(set(found), key=lambda r: (r[0], r[2]))


def digest(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    text = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(text))


def test_scan_is_the_definition():
    rng = random.Random(5)
    for _ in range(400):
        words = []
        while len(words) < rng.randrange(60):
            words += [rng.randrange(3) for _ in range(rng.randrange(5))] * rng.randrange(1, 8)
        ids = np.array(words, np.int32)
        for exponent, least in ((4, 6), (2, 2), (3, 20)):
            got = smallest_periods(stretches(ids, 1, len(ids) // exponent, exponent, least))
            assert [tuple(r) for r in got.tolist()] == plain(words, exponent, least)


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    small = [d for d in docs if len((d.text or "").split()) < 800]
    got = {r.doc_id: r for r in QUERIES["op11_periodic_runs"](spark, SF).collect()}
    assert len(got) == len(docs) and len(small) > 100
    for d in small:
        r = got[d.doc_id]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == digest(d.doc_id, d.text)
    assert sum(r.n_runs > 0 for r in got.values()) > 15


def test_ranges_of_lags_find_the_same(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(30))) + " " + " ".join([*"wxyz"][: rng.randrange(1, 5)] * rng.randrange(90)) for _ in range(60)]
    docs = spark.createDataFrame([*enumerate(texts), *enumerate(texts[:9])], "doc_id long, text string").repartition(5)
    def rows(df):
        return sorted((r.doc_id, r.n_words, r.runs, r.collapsed) for r in df.collect())

    whole, dealt = rows(periodic_runs(docs)), rows(periodic_runs(docs, long_bytes=100, unit=1, least_lags=3))
    assert whole == dealt and len(whole) == 69 and any(r[2] for r in whole)
    assert rows(periodic_runs(docs, long_bytes=-1, unit=1, least_lags=1)) == whole


def test_odd_rows(spark):
    rows = [(None, "a " * 9), (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "a b a b a b a"), (4, "a b a b a b a b"), (4, "a b a b a b a b"), (5, "a a a a a"), (6, "é é " * 6), (7, "x " * 100000)]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, runs int, `a.b` int, row int")
    got = sorted((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(docs).collect())
    assert got == [
        (0, 9, [(0, 9, 1)], "a"), (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 7, [], "a b a b a b a"), (4, 8, [(0, 8, 2)], "a b"), (4, 8, [(0, 8, 2)], "a b"),
        (5, 5, [], "a a a a a"), (6, 6, [(0, 6, 1)], "é é"), (7, 100000, [(0, 100000, 1)], "x"),
    ]
    assert periodic_runs(docs.limit(0)).count() == 0
