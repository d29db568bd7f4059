import itertools
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from quorvia.llm.languages import BITS, SIZES, characters, fit, label_spans, languages, viterbi, words_of
from quorvia.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"
ENGLISH = "the quick brown fox jumps over the lazy dog while the old farmer watches with his hat"
GERMAN = "der schnelle braune fuchs springt über den faulen hund während der alte bauer mit seinem hut zuschaut"
GREEK = "η γρήγορη καφέ αλεπού πηδάει πάνω από το τεμπέλικο σκυλί"


def test_held_out_accuracy(spark):
    rows = QUERIES["op13_languages"](spark, SF).collect()
    docs = {d.doc_id: d for d in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text").collect()}
    assert len(rows) == len(docs)
    known = {d.lang for d in docs.values()}
    tests = 0
    right = 0
    for r in rows:
        d = docs[r.doc_id]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert r.lang_pred == "und" if not any(map(str.isalpha, d.text or "")) else r.lang_pred in known
        if r.held_out and d.lang:
            tests += 1
            right += r.lang_pred == d.lang
    assert tests > 2000 and right >= 0.99 * tests


def learned(spark, extra=""):
    texts = [(i, t, x) for i, (t, x) in enumerate([(ENGLISH, "en"), (GERMAN, "de"), (GREEK, "el")] * 40)]
    return spark.createDataFrame(texts, "doc_id long, text string, lang string")


def test_spans_of_mixed_text(spark):
    docs = learned(spark)
    model = fit(docs)
    assert model.languages == ["de", "el", "en"]
    text = f"42 {ENGLISH}. {GERMAN}! {GREEK}"
    row = label_spans(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert [s.lang for s in row.spans] == ["en", "de", "el"]
    assert text[row.spans[0].start : row.spans[0].end] == ENGLISH and text[row.spans[1].start : row.spans[1].end] == GERMAN
    assert text[row.spans[2].start : row.spans[2].end] == GREEK
    letters = sum(map(str.isalpha, text))
    assert row.lang_pred == "de" and abs(row.score - sum(map(str.isalpha, GERMAN)) / letters) < 1e-12
    # one foreign word is not worth two changes of language
    one = label_spans(spark.createDataFrame([(1, ENGLISH.replace("lazy", "und"))], "doc_id long, text string"), model).first()
    assert [s.lang for s in one.spans] == ["en"]


def test_scripts_narrow_candidates(spark):
    model = fit(learned(spark))
    words = words_of(["αβγ zzz жжж"])
    scores = model.scores(words)
    assert np.isfinite(scores).tolist() == [[False, True, False], [True, False, True], [True, True, True]]


def test_odd_rows(spark):
    odd = [(None, ENGLISH), (1001, None), (1002, ""), (1003, "123 --- 。"), (1004, GERMAN + " "), (1004, GERMAN + " "), (1005, "x" * 200000), (1006, "Ünïcödé İstanbul ß ǅ"), (1007, "a"), (1008, "жук"), (1009, ENGLISH + " word" * 100000), (1010, "̈́ 5"), (1011, "न हीं")]
    docs = learned(spark).union(spark.createDataFrame([(i, t, None) for i, t in odd], "doc_id long, text string, lang string"))
    docs = docs.select("*", F.lit(1).alias("spans"), F.lit(2).alias("score"), F.lit(3).alias("order"), F.lit(4).alias("a.b"))
    got = [r for r in languages(docs).collect() if r.doc_id is None or r.doc_id >= 1000]
    assert len(got) == len(odd)
    at = {r.doc_id: r for r in got}
    assert at[None].lang_pred == "en" and at[None].held_out is False and at[1004].lang_pred == "de" and at[1009].lang_pred == "en"
    assert all((at[i].lang_pred, at[i].score, at[i].spans) == ("und", 0.0, []) for i in (1001, 1002, 1003, 1010))
    assert all(at[i].lang_pred in ("de", "en", "el") for i in (1005, 1006, 1007, 1008, 1011))
    assert languages(docs.limit(0)).count() == 0
    none = languages(docs.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred", "score").distinct().collect()
    assert [tuple(r) for r in none] == [("und", 0.0)]


def test_only_the_bounded_sample_is_learned_from(spark):
    docs = learned(spark)
    model = fit(docs, max_rows=30)
    usable = [r.doc_id for r in docs.orderBy(F.xxhash64("doc_id")).collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2][:30]
    langs = {r.doc_id: r.lang for r in docs.collect()}
    want = {x: sum(langs[i] == x for i in usable) / 30 for x in ("de", "el", "en")}
    assert all(abs(s - want[x]) < 1e-12 for x, s in zip(model.languages, model.share, strict=True))
    again = fit(docs.union(docs).union(docs), max_rows=30)  # repeated ids are learned once
    assert again.languages == model.languages and np.array_equal(again.odds, model.odds)


def test_viterbi_is_the_best_path():
    rng = random.Random(3)
    for _ in range(60):
        lengths = [rng.randrange(1, 6) for _ in range(rng.randrange(1, 5))]
        k = rng.randrange(1, 4)
        scores = np.array([[rng.choice([0.0, 1.0, 2.5, -1.0]) for _ in range(k)] for _ in range(sum(lengths))])
        ends = np.cumsum(lengths)
        prior = np.array([rng.random() / 10 for _ in range(k)])
        best = viterbi(scores, ends - lengths, ends, prior, 1.3)

        def worth(path, own, prior=prior):
            return prior[path[0]] + sum(s[x] for s, x in zip(own, path, strict=True)) - 1.3 * sum(a != b for a, b in itertools.pairwise(path))

        for s, e in zip(ends - lengths, ends, strict=True):
            most = max(worth(p, scores[s:e]) for p in itertools.product(range(k), repeat=e - s))
            assert abs(worth(tuple(best[s:e]), scores[s:e]) - most) < 1e-9


def test_ngrams_are_those_of_the_words():
    texts = ["Ab, abc? äB", "", "12 a1b", "one two one"]
    words = words_of(texts)
    found = [texts[t][s:e] for t, s, e in zip(words.text, words.start, words.end, strict=True)]
    assert found == ["Ab", "abc", "äB", "a", "b", "one", "two", "one"]
    grams = {}
    ends = np.append(words.first[1:], words.places.shape[1])
    for word, s, e in zip(found, words.first, ends, strict=True):
        edged = f" {word.lower()} "
        want = [{edged[i : i + n] for i in range(len(edged) - n + 1)} for n in SIZES]
        got = [[x for x in places[s:e] if x < 1 << BITS] for places in words.places]
        assert [len(g) for g in got] == [max(len(edged) - n + 1, 0) for n in SIZES]
        for gram, at in ((edged[i : i + n], got[j][i]) for j, n in enumerate(SIZES) for i in range(len(edged) - n + 1)):
            assert grams.setdefault(gram, at) == at and gram in want[len(gram) - 2]
    assert len(set(grams.values())) == len(grams)


def test_characters_agree_with_python():
    lower, letter, part, script = characters()
    assert all(letter[ord(c)] == c.isalpha() for c in "aß1 .éжİ一") and lower[ord("Ä")] == ord("ä") and part[0x308] and not letter[0x308]
    assert len({int(script[ord(c)]) for c in "aжα一あ"}) == 5
