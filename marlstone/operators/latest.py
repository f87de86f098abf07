"""The latest row of each key, the one primitive behind runs, snapshots, classifications and registries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of each key the row that is greatest by ``order``, nulls least. The order must be total for one answer.

    max_by over a struct aggregates partially before its shuffle, so a key with most of the rows is no hot task.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_latest")
    return df.groupBy(*keys).agg(best).select(*keys, *(F.col(f"_latest.{c}").alias(c) for c in rest)).select(*df.columns)


def top(df: DataFrame, n: int, *order) -> DataFrame:
    """The first n rows: TakeOrderedAndProject, no full sort."""
    return df.orderBy(*order).limit(n)
