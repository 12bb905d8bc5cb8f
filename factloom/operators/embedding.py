"""Claims and spans as sparse vectors, without a model: hashed word n-grams, weighted by how rare they are.

A text's terms are its words and pairs of neighbouring words, each at one of PLACES places by its hash; a place weighs
its count times ln((1 + N) / (1 + n)) + 1, for n of all N texts that have it.  The weights are an array with a number for each
place, so it is broadcast whatever the number of facts (16 ** DIGITS of them pass through the driver), and a fact's sums are made
where the fact lies.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import text
from factloom.operators.quality import claim, result
from factloom.plans.workspace import settle

#: Hexadecimal digits of a term's MD5 that are its place: 16 ** DIGITS places.
DIGITS = 5


def terms(x: Column) -> Column:
    """Words and pairs of words of a text, lower-cased."""
    words = F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0))
    pairs = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1)))
    return F.when(F.size(words) > 1, F.concat(words, pairs)).otherwise(words)


def places(x: Column) -> Column:
    return F.transform(terms(x), lambda t: F.substring(F.md5(t), 1, DIGITS))


def rarity(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(place, weight) over texts.  Equal ones are counted first, and their terms made once; all count themselves at a place of their own."""
    equal = texts.groupBy(text_col).agg(F.count("*").alias("n"))
    each = equal.select("n", F.explode(F.concat(F.array_distinct(places(F.col(text_col))), F.array(F.lit("")))).alias("place"))
    counts = settle(each.groupBy("place").agg(F.sum("n").alias("n")), "counts")
    total = counts.where("place = ''").select(F.col("n").alias("total"))
    return counts.where("place <> ''").crossJoin(F.broadcast(total)).select("place", (F.log((1 + F.col("total")) / (1 + F.col("n"))) + 1).alias("weight"))


def _places(low: str) -> list[int]:
    """``places`` of a lower-cased text, as numbers."""
    words = re.findall("[a-z0-9]+", low)
    return [int(md5(t.encode()).hexdigest()[:DIGITS], 16) for t in [*words, *map(" ".join, zip(words, words[1:], strict=False))]]


def _cosines(weights: Broadcast) -> Callable[[Column, Column], Column]:
    """The cosine of two lower-cased texts, a batch of rows at a time and equal pairs of a batch once; 0 where one is empty."""

    def flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [_places(t) for t in texts]
        return np.repeat(np.arange(len(found)), [len(p) for p in found]), np.array([x for p in found for x in p], dtype=np.int64)

    @F.pandas_udf("double")
    def cosines(claims: pd.Series, spans: pd.Series) -> pd.Series:
        seen: dict[tuple[str, str], int] = {}
        own = [seen.setdefault(pair, len(seen)) for pair in zip(claims, spans, strict=True)]
        (rc, pc), (rs, ps) = flat([c for c, _ in seen]), flat([s for _, s in seen])
        at, where = np.unique(np.concatenate([rc, rs]) << 4 * DIGITS | np.concatenate([pc, ps]), return_inverse=True)
        c = np.bincount(where[: len(rc)], minlength=len(at))
        s = np.bincount(where[len(rc) :], minlength=len(at))
        w2 = weights.value[at & 16**DIGITS - 1] ** 2
        dot, cc, ss = (np.bincount(at >> 4 * DIGITS, w2 * x * y, len(seen)) for x, y in ((c, s), (c, c), (s, s)))
        norm = np.sqrt(cc) * np.sqrt(ss)
        return pd.Series(np.divide(dot, norm, out=np.zeros(len(seen)), where=norm > 0)[own])

    return cosines


def with_similarity(facts: DataFrame, key: str = "fact_index") -> DataFrame:
    """Facts with ``cosine``, of the claim's and the span's vectors (0 where one is empty), and ``similarity``, what that says as a
    method of quality: percent, and whether it is above a half.  The weights, a number for each place, go to all workers,
    and a fact's cosine is made from its own row: no fact is exploded or joined for it."""
    said = facts.select(F.explode(F.array(claim(), text("span"))).alias("text"))
    found = rarity(said).toArrow()
    weights = np.zeros(16**DIGITS)
    weights[[int(p, 16) for p in found.column("place").to_pylist()]] = found.column("weight").to_numpy()
    cosine = _cosines(facts.sparkSession.sparkContext.broadcast(weights))(F.lower(claim()), F.lower(text("span")))
    return facts.withColumn("cosine", cosine).withColumn("similarity", result((F.col("cosine") * 100).cast("int"), F.col("cosine") > 0.5))
