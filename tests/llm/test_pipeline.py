"""The stages against brute force, each on its own input."""

from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quorvia.llm.queries import OP8_SQL, tokenizer_path
from quorvia.llm.toxicity import toxicity
from tests.llm.oracle import views
from tests.llm.test_minhash import classes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    place = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, found[-1], SF).write.parquet(str(place / name))
        found.append(spark.read.parquet(str(place / name)))
    return found


def test_columns_and_toxicity(spark, stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "mixing", "packing"]
    assert all(s.columns == stages[0].columns for s in stages[1:4])
    judged = toxicity(stages[0], spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert {r.doc_id for r in stages[1].collect()} == {r.doc_id for r in judged if not r.predicted}


def test_one_of_each_group(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(i for i, c in classes(rows).items() if i == c)


def test_mix(stages):
    held = stages[2].toPandas()
    want = {r[0]: r[4] // r[1] for r in views(SF, documents=held).sql(OP8_SQL).fetchall() if r[1]}
    got = Counter(r.doc_id for r in stages[3].collect())
    assert {i: n for i, n in got.items() if i in want} == {i: n for i, n in want.items() if n}


def test_packed_ids(stages):
    tok = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for r in stages[3].collect():
        want[r.doc_id] += len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1
    rows = stages[4].collect()
    got = Counter()
    for r in rows:
        got[r.doc_id] += r.length
    assert got == want
    sizes = Counter()
    for r in rows:
        sizes[r.sequence_id] += r.length
    assert max(sizes.values()) <= 2048
    assert sum(sizes.values()) >= 0.99 * sum(n if n & (n - 1) == 0 else 2048 for n in sizes.values())
    assert np.unique([(r.sequence_id, r.offset) for r in rows], axis=0).shape[0] == len(rows)


def test_run(spark, stages):
    """The run takes the same ids of the same documents; where they are cut depends on its files."""

    def by_document(rows):
        held = {}
        for r in rows:
            held.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
        return {k: Counter(at for start, n in pieces for at in (start, start + n)) for k, pieces in held.items()}, Counter({k: sum(n for _, n in v) for k, v in held.items()})

    run = corpus_pipeline.run(spark, SF)
    assert run.columns == stages[4].columns
    got, want = by_document(run.collect()), by_document(stages[4].collect())
    assert got[1] == want[1]
    # as many begin and as many end a document, and every other cut ends one piece and begins one
    for (_, total), places in got[0].items():
        assert places[0] == places[total] and all(n % 2 == 0 for at, n in places.items() if 0 < at < total)


def test_run_leaves_only_the_last_stage_s_input(spark):
    from quorvia.sources.stored import tables

    before = set(tables(spark))
    found = corpus_pipeline.run(spark, SF)
    left = [t for t in tables(spark) if t not in before]
    assert len(left) == 1 and "stage-mixing" in left[0]
    assert found.count() > 0
