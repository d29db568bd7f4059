"""The few functions that no built-in expression can give, as Arrow-batched UDFs."""

from __future__ import annotations

import json
import random

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.ArrayType(T.StringType()))
def shuffle_options(options: pd.Series, seed: pd.Series) -> pd.Series:
    """CPython's seeded shuffle (Mersenne Twister); seeds may exceed 63 bits, so they come as decimals."""

    def one(names, s):
        if names is None or s is None:
            return None
        out = list(names)
        random.Random(int(s)).shuffle(out)
        return out

    return pd.Series([one(o, s) for o, s in zip(options, seed, strict=True)])


@F.pandas_udf(T.StringType())
def python_json(keys: pd.Series, values: pd.Series) -> pd.Series:
    """A distribution as sorted JSON with Python's number texts, for byte-equal files."""
    return pd.Series([None if k is None else json.dumps(dict(zip(k, map(float, v), strict=True)), ensure_ascii=False, sort_keys=True) for k, v in zip(keys, values, strict=True)])
