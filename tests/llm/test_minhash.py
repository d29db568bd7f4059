import random

import numpy as np
import pytest

from quorvia.llm import minhash
from quorvia.llm.minhash import groups, jaccard, keep_one, shingles, signatures, weighted
from quorvia.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def classes(rows, least=0.8, counted=True):
    """Brute force: all pairs, then components."""
    sets = [(i, weighted(shingles(t), counted)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, a) in enumerate(sets):
        for j, b in sets[n + 1 :]:
            la, lb = a[1].sum(), b[1].sum()
            if min(la, lb) >= least * max(la, lb) > 0 and jaccard(a, b) >= least:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in sets}


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = QUERIES["op6_near_duplicates"](spark, SF).collect()
    assert len(got) == len(rows)
    want = classes(rows)
    assert {r.doc_id: r.group_id for r in got} == want and len(set(want.values())) < len(rows)
    assert all(r.kept == (r.doc_id == r.group_id) for r in got)


@pytest.mark.parametrize("counted", [False, True])
def test_signatures_estimate_weighted_similarity(counted):
    rng = np.random.default_rng(5)
    for share in (0.2, 0.5, 0.8):
        e = rng.integers(0, 2**63, 400).astype(np.uint64)
        w = rng.integers(1, 9, 400).astype(float) if counted else np.ones(400)
        v = np.where(rng.random(400) < share, w, rng.integers(1, 9, 400) if counted else 1.0)
        keep = rng.random(400) < (share if not counted else 1)
        a, b = (np.sort(e), w[np.argsort(e)]), (np.sort(e[keep]), v[keep][np.argsort(e[keep])])
        s = signatures([a, b], 2048)
        assert abs((s[0] == s[1]).mean() - jaccard(a, b)) < 0.05
    one = signatures([(np.array([7], np.uint64), np.ones(1)), (np.zeros(0, np.uint64), np.zeros(0))], 130)
    assert one[0].all() and not one[1].any()


def near_group(rng, n, size=120, changed=4):
    base = [f"w{rng.integers(1000)}" for _ in range(size)]
    out = []
    for _ in range(n):
        words = list(base)
        for at in rng.choice(size, rng.integers(0, changed + 1), replace=False):
            words[at] = f"x{rng.integers(10**6)}"
        out.append(" ".join(words))
    return out


def test_groups_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = np.random.default_rng(6)
    texts = [t for n in (2, 3, 40, 25) for t in near_group(rng, n)]
    texts += ["one two", "one two", "One  two", "three", "", None, "...", "long " * 50000, "long " * 50000]
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts, strict=True)]
    extra = [(None, "one two"), (None, None), rows[0]]
    df = spark.createDataFrame([(i, t, 1, b"") for i, t in rows + extra], "doc_id long, text string, n int, content binary")
    report = {}
    found = groups(df, report=report).collect()
    assert len(found) == len(rows) + 3
    assert {r.doc_id: r.group_id for r in found if r.doc_id is not None} == classes(rows)
    assert all(r.group_id is None for r in found if r.doc_id is None)
    assert groups(df.limit(0)).count() == 0
    kept = keep_one(df)
    assert kept.columns == df.columns
    want = {i for i, c in classes(rows).items() if i == c}
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == want


def test_counted(spark):
    rows = [(1, "a b c d e f g h " * 30), (2, "a b c d e f g h " * 2), (3, "a b c d e f g h " * 29)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    by = lambda counted: {r.doc_id: r.group_id for r in groups(df, counted=counted).collect()}
    assert by(False) == {1: 1, 2: 1, 3: 1} and by(True) == {1: 1, 2: 2, 3: 1}


def test_keep_one_counts_rows(spark):
    rng = np.random.default_rng(7)
    near = near_group(rng, 3, changed=1)
    others = [" ".join(f"v{rng.integers(10**6)}" for _ in range(60)) for _ in range(4)]
    rows = [(1, near[0]), (1, near[0]), (2, near[1]), (None, near[2]), (None, near[0])]
    rows += [(None, others[0])] * 5 + [(3, "..."), (4, "..."), (5, "===="), (None, "...")]
    # an id with two texts: one is a copy of an earlier document, the other one its own
    rows += [(6, near[0]), (6, others[1]), (7, others[2]), (7, others[3]), (8, others[3]), (8, others[3])]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, k int")
    found = keep_one(df).collect()
    assert len({r.k for r in found}) == len(found)
    want = [(1, near[0]), (None, others[0]), (3, "..."), (5, "===="), (6, others[1]), (7, others[2]), (7, others[3])]
    assert sorted((r.doc_id or 0, r.text) for r in found) == sorted((i or 0, t) for i, t in want)
    again = keep_one(df.repartition(5)).collect()
    assert {r.k for r in again} == {r.k for r in found}
    assert keep_one(df.limit(0)).count() == 0


def test_links_of_an_id_with_two_texts(spark):
    rng = np.random.default_rng(8)
    a, b = near_group(rng, 2, changed=1), near_group(rng, 2, changed=1)
    df = spark.createDataFrame([(1, a[0]), (1, b[0]), (2, a[1]), (3, b[1])], "doc_id long, text string")
    assert sorted((r.doc_id, r.group_id) for r in groups(df).collect()) == [(1, 1), (1, 1), (2, 1), (3, 1)]
    assert sorted(r.text for r in keep_one(df).collect()) == sorted([a[0], b[0]])


def test_hot_keys_large_joins_and_clashing_names(spark, monkeypatch):
    """Bands and contents of many rows by the path of hot keys, rows beyond a broadcast, columns named as inside."""
    monkeypatch.setattr(minhash, "HOT_ROWS", 5)
    monkeypatch.setattr(minhash, "SPLIT", 4)
    monkeypatch.setattr(minhash, "BROADCAST_IDS", 3)
    names = ["at_id", "at_raw", "whole_row", "id", "raw", "lead", "stays", "held", "content", "dotted.name"]
    rng = np.random.default_rng(9)
    texts = near_group(rng, 30) + near_group(rng, 4) + ["copy of a text with words"] * 20 + ["..."] * 20 + [None] * 3
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(*r, *names) for r in rows + rows[:2]], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    want = {i: i for i, _ in rows} | classes(rows) | {i: 54 for i in range(54, 74)}
    found = {r.doc_id: r.group_id for r in groups(df).collect()}
    assert {i: c for i, c in found.items() if i < 74} == {i: c for i, c in want.items() if i < 74}
    assert len({found[i] for i in (74, 75, 76)}) == 1
    kept = keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(found.values()))


def templated(n, seed=5):
    """Texts of one template of 300 words with 120 words of their own; every fiftieth also as a near copy."""
    rng = random.Random(seed)
    template = [f"t{i}" for i in range(300)]
    rows = []
    for i in range(n):
        own = template[:150] + [f"w{rng.randrange(10**9)}" for _ in range(120)] + template[150:]
        rows.append((2 * i, " ".join(own)))
        if i % 50 == 0:
            own[160] = "changed"
            rows.append((2 * i + 1, " ".join(own)))
    return rows


def test_templates_stay_below_the_square(spark):
    """Documents that share a template but no link: comparisons grow with their number, and near copies among them are found."""
    made = {}
    for n in (1500, 3000):
        rows = templated(n)
        report = {}
        found = {r.doc_id: r.group_id for r in groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), report=report).collect()}
        assert found == {i: i - i % 2 if i % 100 == 1 else i for i, _ in rows}
        made[n] = report["comparisons"] + report["listed"] + report["in_blocks"]
    assert made[3000] < 2.6 * made[1500] and made[3000] < 120 * 3000


def test_many_different_members_of_a_bucket(spark, monkeypatch):
    """Groups as of all pairs, where members meet by rare shingles, listed or in blocks."""
    rng = random.Random(6)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randrange(1, 9)):
            words[rng.randrange(60)] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(words)))
    want = classes(rows)
    for many, listed in ((0, 1), (0, 64), (3, 3)):
        monkeypatch.setattr(minhash, "MANY", many)
        monkeypatch.setattr(minhash, "LISTED", listed)
        assert {r.doc_id: r.group_id for r in groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()} == want
