import math
import re
import zlib

from pyspark.sql import functions as F

from quorvia.llm import toxicity as tox
from quorvia.llm.queries import QUERIES
from quorvia.llm.toxicity import BIAS, drop_toxic, features, fit, score_documents, toxicity

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in QUERIES["op7_toxicity"](spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    tests = [(x.toxic, rows[x.doc_id].predicted) for x in labels if x.doc_id in rows and rows[x.doc_id].held_out]
    hit = sum(a and b for a, b in tests)
    assert hit >= 0.75 * sum(a for a, _ in tests) and hit >= 0.9 * sum(b for _, b in tests)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "bad word", 1.0), (1, None, 1.0), (2, "", 1.0), (3, "word " * 100000 + "bad", 1.0), (4, "good", 1.0), (4, "good", 1.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity(docs, none).collect()} == {0.0}
    assert drop_toxic(docs, none).count() == 6 and drop_toxic(docs, none).columns == docs.columns
    learned = [(i, f"some {'bad' if i % 2 else 'nice'} thing {i}") for i in range(10, 400)]
    more = docs.select("doc_id", "text").union(spark.createDataFrame(learned, "doc_id long, text string"))
    labels = spark.createDataFrame([(i, i % 2, "x") for i, _ in learned] + [(None, 1, "x"), (3, None, "x")], "doc_id long, toxic int, text string")
    found = toxicity(more, labels).collect()
    assert len(found) == 396
    at = {r.doc_id: r for r in found if r.doc_id and r.doc_id >= 10}
    assert all(at[i].predicted == i % 2 for i, _ in learned)
    assert toxicity(more.limit(0), labels).count() == 0


def test_clashing_names(spark):
    names = ["score", "text_to_score", "__text", "label", "order", "id", "a.b"]
    rows = [(i, f"some {'bad' if i % 2 else 'nice'} thing {i}", *names) for i in range(10, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    labels = spark.createDataFrame([(i, i % 2) for i in range(10, 300)], "doc_id long, toxic int")
    kept = drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in range(10, 300) if i % 2 == 0}
    assert score_documents(docs, fit(docs, labels)).columns == [*[c for c in docs.columns if c != "score"], "score"]


def test_features_are_the_distinct_grams():
    def grams(text):
        words = re.findall(r"\w+", text.lower())
        return {(w,) for w in words} | {("n", *p) for p in zip(words, words[1:], strict=False)} | {("s", *p) for p in zip(words, words[2:], strict=False)}

    texts = ["", "one", "one two", "one two three one two three", "Ünder x, y; Z. x y", "a a a a", "word " * 50 + "end"]
    every = set().union(*map(grams, texts))
    of = {}
    for text in texts:  # equal grams of different texts are one coordinate, different grams are two
        assert len(set(features(text).tolist())) == len(grams(text)) and BIAS not in features(text)
        of[text] = set(features(text).tolist())
    assert len(set().union(*of.values())) == len(every)
    for a in texts:
        for b in texts:
            assert len(of[a] & of[b]) == len(grams(a) & grams(b))


def test_learning_follows_the_published_rule(spark):
    """Weights against a plain coordinate-by-coordinate FTRL-proximal over the same rows in the same order."""
    learned = [(i, f"some {'bad' if i % 3 == 0 else 'nice'} thing number {i % 7} of {i % 5}") for i in range(60)]
    docs = spark.createDataFrame(learned + learned[:9] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in learned], "doc_id long, toxic int")
    order = [r.doc_id for r in labels.orderBy(F.xxhash64("doc_id")).collect() if zlib.crc32(str(r.doc_id).encode()) % 5]
    z, n, w = {}, {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= tox.L1:
            return 0.0
        sign = 1 if z[i] > 0 else -1
        return -(z[i] - sign * tox.L1) / ((tox.BETA + math.sqrt(n[i])) / tox.ALPHA + tox.L2)

    texts = dict(learned)
    for _ in range(tox.EPOCHS):
        for doc in order:
            at, y = {BIAS, *features(texts[doc]).tolist()}, int(doc % 3 == 0)
            w = {i: weight(i) for i in at}
            p = 1 / (1 + math.exp(-sum(w.values())))
            g = (p - y) * (tox.TOXIC_WEIGHT if y else 1.0)
            for i in at:
                before = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / tox.ALPHA * w[i]
                n[i] = before + g * g
    want = {i: weight(i) for i in z if weight(i)}
    got = fit(docs, labels)
    assert set(got) == set(want) and len(want) > 1
    assert all(math.isclose(got[i], want[i], rel_tol=1e-6, abs_tol=1e-9) for i in want)
