import zlib

import numpy as np
from tokenizers import Tokenizer

from quorvia.llm.packing import SquareSums, pack, pack_documents
from quorvia.llm.queries import QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"


def check(rows, texts, window=2048):
    tok = Tokenizer.from_file(tokenizer_path())
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    total = 0
    for doc, pieces in by_doc.items():
        ids = [*tok.encode(texts[doc] or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    padding = 0
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    assert padding <= 0.01 * total


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check(QUERIES["op1_packing"](spark, SF).collect(), texts)


def test_odd_rows(spark):
    from pyspark.sql import functions as F

    texts = {1: None, 2: "", 3: "a  b\n\n\tc   d", 4: "<|endoftext|> x", 5: "漢字 かな 🙂 word" * 50, 6: "word " * 30000, None: "no id", 7: "x" * 5000}
    df = spark.createDataFrame([(k, v, 0) for k, v in texts.items()], "doc_id long, text string, ids int")
    check(pack_documents(df, tokenizer_path()).withColumn("ids_crc32", F.crc32("ids")).collect(), texts)
    assert pack_documents(df.limit(0), tokenizer_path()).count() == 0
    twice = pack_documents(df.where("doc_id = 3").union(df.where("doc_id = 3")), tokenizer_path()).collect()
    assert len({(r.sequence_id, r.offset) for r in twice}) == len(twice) >= 2


def squares(counts, window, h, size, price):
    """The sum of squares after a placement at level h, by its definition."""
    m = counts.copy()
    if h:
        m[h] -= 1
    if h + size < window:
        m[h + size] += 1
    elif h + size > window:
        m[h + size - window] += 1
    return (m**2).sum() + (price if h + size > window else 0)


def test_choice_is_smallest_sum_of_squares():
    rng = np.random.default_rng(0)
    sums, window = SquareSums(50, 4.0), 50
    cuts = 0
    for _ in range(2000):
        size = int(rng.integers(1, 50))
        n = sums.count.copy()
        n[0] = n[window] = 0
        level = sums.level_for(size)
        assert squares(n, window, level, size, 4.0) == min(squares(n, window, h, size, 4.0) for h in range(window) if h == 0 or n[h])
        cuts += level + size > window
        sums.place([(0, 0, np.zeros(size), size)], size)
        assert sums.n_open == sums.count[1:window].sum() == sum(map(len, sums.open.values()))
    assert 0 < cuts < 1000


def test_open_windows_stay_few_and_are_placed_at_the_end():
    sums = SquareSums(2048)
    for _ in range(5000):  # of one size, no two of which fit together
        sums.place([(0, 0, np.zeros(1500, np.uint32), 1500)], 1500)
        assert sums.n_open <= 64
    rest = sums.n_open
    closed = list(sums.finish())
    sizes = [sum(len(p[2]) for p in w) for w in closed]
    assert sums.n_open <= 1 < rest and all(n == 2048 or n & (n - 1) == 0 for n in sizes)
    assert sum(n < 2048 for n in sizes) <= 11


def test_every_id_in_order():
    rng = np.random.default_rng(1)
    docs = [np.arange(int(n), dtype=np.uint32) for n in rng.integers(1, 900, 700)]
    windows = list(pack(enumerate(docs), 256))
    found = {}
    for w in windows:
        assert sum(len(ids) for _, _, ids, _ in w) <= 256
        for key, start, ids, total in w:
            assert total == len(docs[key]) and (ids == docs[key][start : start + len(ids)]).all()
            found.setdefault(key, []).append((start, len(ids)))
    for key, pieces in found.items():
        at = 0
        for start, n in sorted(pieces):
            assert start == at
            at += n
        assert at == len(docs[key])
