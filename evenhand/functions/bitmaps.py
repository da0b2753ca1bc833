"""Bitmaps of fixed size with the hashes of keys.

They tell for certain that a key is not among some others, so rows can be kept out of a shuffle
before an exact join. The bits are a table of at most ``bits`` / WORD rows, which is broadcast
whatever the number of keys: the fuller it is, the more rows pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 32


def _place(key: str, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits))


def bitmap(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """(__word, __bits) of all keys."""
    place = _place(key, bits)
    bit = F.pow(F.lit(2), place % WORD).cast("long")
    words = keys.select(F.floor(place / WORD).alias("__word"), bit.alias("__bits"))
    return words.groupBy("__word").agg(F.bit_or("__bits").alias("__bits"))


def marked(rows: DataFrame, key: str, found: DataFrame, bits: int, name: str) -> DataFrame:
    """Adds a column that is false only for keys that are not in the bitmap."""
    place = _place(key, bits)
    placed = rows.withColumns({"__word": F.floor(place / WORD), "__bit": (place % WORD).cast("int")})
    joined = placed.join(F.broadcast(found), "__word", "left")  # at most bits / WORD rows
    held = F.coalesce(F.getbit("__bits", F.col("__bit")) == 1, F.lit(False))
    return joined.withColumn(name, held).drop("__word", "__bit", "__bits")


def only_marked(rows: DataFrame, key: str, found: DataFrame, bits: int) -> DataFrame:
    return marked(rows, key, found, bits, "__held").filter("__held").drop("__held")
