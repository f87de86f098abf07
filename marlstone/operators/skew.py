"""Joins that no key's rows land in one task: a key with very many rows is dealt over parts, and its other side repeated for each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key above which a join splits the key, and keys that a broadcast may hold (about 24 MB as a hash table).
HOT_ROWS, BROADCAST_ROWS = 1_000, 500_000


def hot_keys(counts: DataFrame, key: str, rows: str, total: int) -> DataFrame:
    """(key, parts) of the keys with more than HOT_ROWS rows, or total / BROADCAST_ROWS if that is more: BROADCAST_ROWS keys at most."""
    most = max(HOT_ROWS, total // BROADCAST_ROWS)
    return counts.where(F.col(rows) > most).select(key, F.ceil(F.col(rows) / most).cast("int").alias("parts"))


def salted_join(many: DataFrame, other: DataFrame, key: str, hot: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """``many`` joined with ``other`` on ``key``. A hot key's rows of ``many`` are dealt over its parts by the hash of ``by``,
    and its rows of ``other`` are repeated for each part. ``how``: inner or left."""
    hot = F.broadcast(hot.select(F.col(key).alias("_hot_key"), F.col("parts").alias("_parts")))
    dealt = many.join(hot, F.col(key) == F.col("_hot_key"), "left").withColumn("_salt", F.pmod(F.xxhash64(*by), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_hot_key", "_parts")
    copies = other.join(hot, F.col(key) == F.col("_hot_key"), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_hot_key", "_parts")
    return dealt.join(copies, [key, "_salt"], how).drop("_salt")
