"""Similarity measures."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays, 0 where a vector is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


@F.pandas_udf(T.StructType([T.StructField("selection", T.DoubleType()), T.StructField("score", T.DoubleType())]))
def matching_ratios(query: pd.Series, key: pd.Series) -> pd.DataFrame:
    """Ratcliff-Obershelp ratios both ways round: the measure is not symmetric.  ``selection``
    has the key as first sequence and decides, ``score`` has the query first and is reported."""
    out = [(SequenceMatcher(None, k, q).ratio(), SequenceMatcher(None, q, k).ratio()) for q, k in zip(query, key, strict=True)]
    return pd.DataFrame(out, columns=["selection", "score"])


#: Letters whose first three occurrences have a bit each, in two numbers; all that is beyond them is only counted.
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789' "


def letter_bits(x: Column) -> tuple[Column, Column, Column]:
    """A text's letters as two sets of bits, and the number of letters that have none."""
    halves = []
    for letters in (LETTERS[:19], LETTERS[19:]):
        bits = F.lit(0).cast("long")
        for i, letter in enumerate(letters):
            n = F.length(x) - F.length(F.replace(x, F.lit(letter), F.lit("")))
            bits = bits.bitwiseOR(F.when(n >= 3, F.lit(7 << 3 * i)).when(n == 2, F.lit(3 << 3 * i)).when(n == 1, F.lit(1 << 3 * i)).otherwise(F.lit(0)).cast("long"))
        halves.append(bits)
    return halves[0], halves[1], F.length(x) - F.bit_count(halves[0]) - F.bit_count(halves[1])


def most_shared(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    """An upper bound of the letters that two texts have in common, wherever they stand."""
    return F.bit_count(a[0].bitwiseAND(b[0])) + F.bit_count(a[1].bitwiseAND(b[1])) + F.least(a[2], b[2])
