import bisect
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quorvia.llm import sharding
from quorvia.llm.queries import QUERIES
from quorvia.llm.sharding import bounds, ring, shard_documents, walk

SF = "/root/testdata/sf0.01"


def laws(rows, n):
    counts = Counter(r.shard for r in rows)
    assert all(0 <= s < n for s in counts)
    sizes = [counts.get(s, 0) for s in range(n)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(n):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op5_sharding"](spark, SF).collect()
    assert {r.doc_id for r in rows} == set(docs) and len(rows) == len(docs)
    for r in rows:
        utf8 = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(utf8) + 8, zlib.crc32(utf8), "rows", None)
    laws(rows, 24)
    again = {(r.doc_id, r.shard, r.slot) for r in QUERIES["op5_sharding"](spark, SF).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in rows}


def test_few_move_when_a_shard_is_added(spark):
    docs = spark.range(20000).selectExpr("id AS doc_id", "cast(id AS string) AS text")
    at = [{r.doc_id: r.shard for r in shard_documents(docs, n, slack=slack).collect()} for n, slack in ((24, 0.1), (25, 0.1))]
    moved = sum(at[0][k] != at[1][k] for k in at[0])
    assert moved < 0.15 * 20000
    assert max(Counter(at[0].values()).values()) <= -int(-1.1 * 20000 // 24)


def test_walk_is_first_node_with_room():
    counts = {c: (c * 7919) % 13 for c in range(0, 256, 3)}
    pieces = list(walk(counts, 3, 4, 8, 0.0))
    held = Counter()
    for cell, low, high, shard, slot, hops in pieces:
        held[shard] += high - low
    assert sum(held.values()) == sum(counts.values()) and max(held.values()) - min(held.values()) <= 1
    for cell, n in counts.items():
        mine = sorted(p[1:3] for p in pieces if p[0] == cell)
        assert [x for p in mine for x in range(*p)] == list(range(n))


def test_odd_rows(spark):
    rows = [(None, None, 1), (None, "", 1), (1, "a", 1), (1, "a", 1), (2, "é" * 100000, 1)] + [(None, str(i), 0) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    found = shard_documents(df, 7).collect()
    assert len(found) == len(rows)
    laws(found, 7)
    assert shard_documents(df.limit(0), 7).count() == 0


def passed(rows, n, **options):
    """Every row lies on the node that its hops lead to, and the shards of the nodes passed are full."""
    nodes = ring(n)
    places = [cell for cell, _ in nodes]
    full = bounds(len(rows), n, options.get("slack", 0.0))
    held = Counter(r.shard for r in rows)
    for r in rows:
        first = bisect.bisect_left(places, r.cell) % len(nodes)
        assert nodes[(first + r.hops) % len(nodes)][1] == r.shard
        assert all(held[nodes[(first + h) % len(nodes)][1]] == full[nodes[(first + h) % len(nodes)][1]] for h in range(r.hops))


def with_cells(docs, placed):
    """Cells by the documented rule: the leading bits of the hash of id, checksum and size."""
    cell = F.shiftrightunsigned(F.xxhash64("doc_id", "text_crc32", "size"), 48).cast("int")
    return placed.withColumn("cell", cell).collect()


@pytest.mark.parametrize("slack", [0.0, 0.2])
def test_each_row_goes_to_the_first_node_with_room(spark, slack):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = with_cells(docs, shard_documents(docs, 24, slack=slack))
    passed(rows, 24, slack=slack)
    assert (sum(r.hops > 0 for r in rows) > 0) == (slack == 0.0) or slack


def test_very_many_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "HOT_ROWS", 50)
    docs = spark.createDataFrame([(1, "again")] * 700 + [(None, "x")] * 300 + [(i, str(i)) for i in range(2, 900)], "doc_id long, text string").repartition(7)
    rows = with_cells(docs, shard_documents(docs, 5))
    assert len(rows) == 1898
    laws(rows, 5)
    passed(rows, 5)
