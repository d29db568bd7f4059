import json
import random

import pytest

from quorvia.plans import runs
from quorvia.sources.credentials import TOKEN, byte_ranges, credential_places, file_lengths
from quorvia.streaming.states import CHECKPOINT, follow, furthest, judged
from tests.duck import same, views

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(runs.QUERIES))
def test_query_against_sql(spark, name):
    assert same(runs.QUERIES[name](spark, SF), runs.ORACLE_SQL[name], views(SF)) > 0


def test_tokens_across_every_edge_are_found_once(spark, tmp_path):
    token = b"hf_" + b"Ab3" * 8
    for n, size in enumerate((64, 100, 4096)):
        folder = tmp_path / str(n)
        folder.mkdir()
        want = set()
        for shift in range(0, len(token) + 2):
            body = bytearray(b"." * (5 * size))
            for edge in range(1, 5):
                at = edge * size - shift
                body[at : at + len(token)] = token
                want.add((f"f{shift}.bin", at))
            (folder / f"f{shift}.bin").write_bytes(bytes(body))
        (folder / "empty.bin").write_bytes(b"")
        found = credential_places(file_lengths(spark, str(folder)), size=size, parts=8).collect()
        assert len(found) == len(want) and {(r.path.rsplit("/", 1)[1], r.place) for r in found} == want and {r.token.encode() for r in found} == {token}
    assert credential_places(file_lengths(spark, str(folder), "empty*")).count() == 0
    with pytest.raises(ValueError):
        credential_places(file_lengths(spark, str(folder)), size=0)


def test_a_file_of_more_than_two_gigabytes(spark, tmp_path):
    """A file with holes: it is cut into ranges, and a token at its end is found."""
    path = tmp_path / "large.bin"
    size = (2 << 30) + (300 << 20)
    token = b"hf_" + b"Z9" * 15
    with path.open("wb") as f:
        f.truncate(size)
        f.seek(size - len(token))
        f.write(token)
        f.seek((2 << 30) - 10)
        f.write(token)
    files = file_lengths(spark, str(path))
    assert byte_ranges(files, 64 << 20).count() == -(-size // (64 << 20))
    assert sorted(r.place for r in credential_places(files, size=64 << 20).collect()) == [(2 << 30) - 10, size - len(token)]


def test_pattern_is_over_bytes(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xff\xfehf_" + b"a" * 20 + b"\xff hf_" + b"b" * 19 + b" xhf_" + b"C" * 40)
    assert [(r.place, len(r.token)) for r in credential_places(file_lengths(spark, str(tmp_path)), TOKEN).orderBy("place").collect()] == [(2, 23), (51, 43)]


def line(key, status, row, *, place=0, fingerprint="f", version="v"):
    return {"schema_version": version, "run_fingerprint": fingerprint, "manifest_index": place, "row_key": key, "metrics_status": status, "row": row}


def test_any_order_gives_the_same_states(spark, tmp_path):
    """Late, repeated and foreign files, in orders of their own, at once and as a stream."""
    manifest = spark.createDataFrame([("q|a|b|x", 0), ("q|a|b|y", 1), ("q|c|d|x", 2)], "key string, place long")
    x, y, z = ["q", "a", "b", "x"], ["q", "a", "b", "y"], ["q", "c", "d", "x"]
    lines = [
        line(x, "pending", "p1"), line(x, "complete", "c1"), line(x, "complete", "c2"), line(x, "pending", "p2"), line(x, "complete", "c1"),
        line(y, "pending", "p1", place=1), line(y, "complete", "c1", place=5), line(y, "complete", "c", place=1, fingerprint="other"), line(y, "pending", "p0", place=1),
        line(z, "done", "c", place=2), line(["q"], "complete", "c"), line(None, "complete", "c"), line(z, "complete", None, place=2), line(z, "complete", "c", place=2, version="old"),
    ]
    own = {"schema_version": "v", "run_fingerprint": "f"}
    seen = set()
    for seed in range(3):
        order = list(lines)
        random.Random(seed).shuffle(order)
        folder = tmp_path / str(seed)
        folder.mkdir()
        for i, one in enumerate(order):
            (folder / f"{i:02}.json").write_text(json.dumps(one))
        found = judged(spark.read.schema(CHECKPOINT).json(str(folder)), manifest, **own)
        faults = sorted(r.fault for r in found.where("fault IS NOT NULL").collect())
        assert faults == ["manifest order", "no object", "no row", "row key", "run fingerprint", "schema", "status"]
        at_once = sorted(tuple(r) for r in furthest(found.where("fault IS NULL")).collect())
        place = tmp_path / f"out{seed}"
        follow(spark, str(folder), manifest, f"{place}/t", f"{place}/c", files_per_trigger=5, **own).awaitTermination()
        streamed = sorted(tuple(r) for r in furthest(spark.read.parquet(f"{place}/t")).select("key", "status", "digest", "row").collect())
        assert at_once == streamed and [(k, s) for k, s, _, _ in at_once] == [("q|a|b|x", "complete"), ("q|a|b|y", "pending")]
        seen.add(tuple(at_once))
    assert len(seen) == 1


def test_smoke_contract(spark):
    from quorvia.operators.smoke import smoke_contract

    pairs = spark.createDataFrame([("q", "a", "b"), ("q", "b", "a")], "question_id string, label_country string, evidence_country string")
    models = spark.createDataFrame([("m", "deterministic_smoke")], "name string, backend string")
    settings = {"conditions": ["baseline", "country_label", "population_evidence", "conflict"], "experiment": {"smoke": {"synthetic_backend": True, "scientific_inference": False, "expected_records": 8}}}
    assert set(smoke_contract(pairs, models, settings).first()) == {True}
    wrong = smoke_contract(pairs.union(pairs), models.union(models), {"conditions": settings["conditions"][::-1]}).first()
    assert set(wrong) == {False} and len(wrong) == 5


def test_older_analyses_have_one_override(spark):
    from quorvia.operators.metrics import long_metrics
    from quorvia.operators.validation import cluster_rules

    targets = spark.createDataFrame([("m", "q", c, 0.1, 0.2) for c in "ab"], "model_key string, question_id string, label_country string, country_influence double, evidence_influence double")
    directed = spark.createDataFrame([("m", "q", "a", "b", 0.3), ("m", "q", "b", "a", float("nan"))], "model_key string, question_id string, label_country string, evidence_country string, evidence_override double")
    assert {(r.metric, r.n) for r in long_metrics(targets, directed).groupBy("metric").count().withColumnRenamed("count", "n").collect()} == {("country_influence", 2), ("evidence_influence", 2), ("evidence_override", 2)}
    assert [(r.rule, r.key) for r in cluster_rules(targets, directed, ["m"]).collect()] == [("evidence_override not finite", "m|q|b|a")]
    with pytest.raises(ValueError, match="directed units need"):
        long_metrics(targets, directed.drop("evidence_override"))
