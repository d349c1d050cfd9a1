"""Bloom filters over 64-bit key hashes: built by an aggregate, a row for each word of bits, and asked by a join with those words.

A filter's size follows from its number of keys, so it is a table, broadcast by Spark while it is small; nothing is gathered on
the driver. Runs on storage have Parquet's own filter, which its reader asks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 32


def shape(keys: int, rate: float = 0.01) -> tuple[int, int]:
    """Bits and hash functions for so many keys: ceil(-ln rate / ln 2 ** 2) bits a key, and 0.69 of that, 1 to 30, functions."""
    per_key = math.ceil(-math.log(rate) / math.log(2) ** 2)
    return max(64, -(-keys * per_key // WORD) * WORD), min(30, max(1, int(per_key * 0.69)))


def _places(key: Column, bits: int, turns: int) -> Column:
    """The bits of a key, by double hashing."""
    first, step = F.xxhash64(key), F.xxhash64(key, F.lit(1)).bitwiseOR(F.lit(1))
    return F.transform(F.sequence(F.lit(0), F.lit(turns - 1)), lambda i: F.pmod(first + F.pmod(step, F.lit(bits)) * i, F.lit(bits)))


def build(rows: DataFrame, key: str, bits: int, turns: int) -> DataFrame:
    """The filter of the keys in `rows`: (word, mask), a row for each word that has a bit. Null keys are none."""
    at = rows.where(F.col(key).isNotNull()).select(F.explode(_places(F.col(key), bits, turns)).alias("at"))
    bit = F.pow(F.lit(2), F.pmod("at", F.lit(WORD))).cast("long")
    return at.select(F.floor(F.col("at") / WORD).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("mask"))


def may_contain(probe: DataFrame, key: str, bloom: DataFrame, bits: int, turns: int) -> DataFrame:
    """The distinct keys of `probe` whose bits are all set: every key that the filter was built of, and about `rate` of the others."""
    keys = probe.select(key).where(F.col(key).isNotNull()).distinct()
    at = keys.select(key, F.explode(F.array_distinct(_places(F.col(key), bits, turns))).alias("at"))
    bit = F.pow(F.lit(2), F.pmod("at", F.lit(WORD))).cast("long")
    asked = at.select(key, F.floor(F.col("at") / WORD).alias("word"), bit.alias("bit")).join(bloom, "word", "left")
    hit = F.coalesce(F.col("mask").bitwiseAND(F.col("bit")) != 0, F.lit(False))
    return asked.groupBy(key).agg(F.bool_and(hit).alias("all_set")).where("all_set").select(key)
