import hashlib
import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from quorvia.functions.json_text import canonical_hash, canonical_json, json_string, python_number


def odd_doubles(n: int) -> list[float]:
    rng = random.Random(7)
    found = [0.0, -0.0, 1.0, -1.0, 0.1, 1e15, 1e16, 1e17, 123456789012345680.0, 9999999999999998.0, 1e-4, 1e-5, 0.00012345, 2e23, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, 1e22, 1e23, 9007199254740993.0, 2.0**-1022, 2**-44, 0.3, 1 / 3, 1e7, 1e-3, 12345678.9, 4.35, 1.1e-5, 8.41e21, 2.0e-3]
    found += [2.0**k for k in range(-1074, 1023, 9)] + [10.0**k for k in range(-320, 308, 7)]
    while len(found) < n:
        x = struct.unpack("<d", rng.randbytes(8))[0] if rng.random() < 0.6 else rng.choice([rng.random(), rng.randrange(10**6) / 1000, rng.gauss(0, 1e9), rng.randrange(50) / rng.randrange(1, 50)])
        if x == x and abs(x) != float("inf"):
            found.append(x)
    return found


def test_numbers_are_those_of_python(spark):
    values = odd_doubles(10_000)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double")
    got = {r.i: r.t for r in df.select("i", python_number("x").alias("t")).collect()}
    assert [(x, got[i]) for i, x in enumerate(values) if got[i] != json.dumps(x)] == []


def test_what_is_no_number_is_an_error(spark):
    for x in (float("nan"), float("inf"), float("-inf")):
        with pytest.raises(Exception, match="no number of JSON"):
            spark.createDataFrame([(x,)], "x double").select(python_number("x")).collect()
    assert spark.createDataFrame([(None,)], "x double").select(python_number("x").alias("t")).first().t is None


TEXTS = ["", "plain", 'a "quote" and \\ back', "line\nbreak\ttab\r\b\f\x00\x1f\x7f", "é ü 日本 🙂  ", "/slash", "'"]


def test_texts_are_those_of_python(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for r in df.select("t", json_string("t").alias("plain"), json_string("t", ascii_only=True).alias("ascii")).collect():
        assert r.plain == json.dumps(r.t, ensure_ascii=False) and r.ascii == json.dumps(r.t)


def test_values_are_those_of_python(spark):
    kind = "STRUCT<`z`: DOUBLE, a: STRUCT<q: BIGINT, b: STRING>, m: MAP<STRING, ARRAY<DOUBLE>>, seed: DECIMAL(20, 0), flag: BOOLEAN, empty: ARRAY<STRING>>"
    values = [
        {"z": 1.5, "a": {"q": 3, "b": "x\n"}, "m": {"é": [1.0, 1e-7], "Z": [], "a\"": [2.0]}, "seed": 18446744073709551615, "flag": True, "empty": []},
        {"z": None, "a": None, "m": None, "seed": None, "flag": False, "empty": [None, "x"]},
    ]
    df = spark.createDataFrame([(json.dumps(v, ensure_ascii=False),) for v in values], "j string").select(F.from_json("j", kind).alias("v"))
    typed = df.schema["v"].dataType
    rows = df.select(canonical_json("v", typed).alias("c"), canonical_json("v", typed, compact=False, ascii_only=True).alias("s"), canonical_hash("v", typed).alias("h")).collect()
    for v, r in zip(values, rows, strict=True):
        compact = json.dumps(v, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
        assert r.c == compact and r.s == json.dumps(v, sort_keys=True) and r.h == hashlib.sha256(compact.encode()).hexdigest()
    with pytest.raises(TypeError):
        canonical_json("v", spark.createDataFrame([], "v date").schema["v"].dataType)
