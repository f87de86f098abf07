"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.operators.skew import BROADCAST_ROWS

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own in local mode."""
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not known:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        known = sc.getCheckpointDir()
    return known


#: Folders that stash() wrote and nothing has removed yet.
_WRITTEN: list[str] = []


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Write df once as a Parquet table in the shared folder and return a reader of it.

    It cuts the lineage, survives lost executors and gives the rows an identity that a re-run task can't change.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stashed = path
    return out


def _remove(spark: SparkSession, paths: Sequence[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _WRITTEN.remove(path)


def discard(*frames: DataFrame) -> None:
    """Remove stashed tables that no frame reads any more. Only what stash() returned is taken, once."""
    for f in frames:
        path = f.__dict__.get("_stashed")
        if path in _WRITTEN:
            _remove(f.sparkSession, [path])


def written() -> frozenset[str]:
    """What is stashed by now: a mark for cleanup()."""
    return frozenset(_WRITTEN)


def cleanup(spark: SparkSession, keep: DataFrame | None = None, since: frozenset[str] = frozenset()) -> None:
    """Remove what the operators of this process have stashed since a mark, but for ``keep``: once their results are written,
    nothing needs it. Results that aren't written yet must not have been made since then."""
    _remove(spark, [p for p in _WRITTEN if p not in since and (keep is None or p != keep.__dict__.get("_stashed"))])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """A name for each of ``names`` that no column of df has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def each_batch(df: DataFrame, columns: list[str], schema: str, fn: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """mapInArrow over the named columns only, so that other columns, whatever their names, never reach Python."""
    return df.select(*columns).mapInArrow(fn, schema)


def ascii_lower(column: str) -> F.Column:
    """Lower-case A-Z and nothing else; null becomes the empty text."""
    return F.translate(F.coalesce(F.col(column), F.lit("")), ASCII_UPPER, ASCII_LOWER)


def held_out(id_column: str) -> F.Column:
    """True for the fold that no training may see: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def bounded_sample(df: DataFrame, id_column: str, limit: int, salt: int = 0) -> DataFrame:
    """At most ``limit`` rows, the same ones in every run: those with the least hash of their id.

    Of a large table only about eight times as many rows, by another part of the hash, reach the final choice, so that
    its one task doesn't gather the best rows of every partition.
    """
    h = F.xxhash64(F.col(id_column), F.lit(salt))
    n = df.select(id_column).count()
    if n > 16 * limit:
        df = df.where(F.pmod(h, F.lit(1 << 30)) < int((1 << 30) * 8 * limit / n))
    return df.orderBy(F.shiftright(h, 30), h, F.col(id_column)).limit(limit)


def narrow_to(df: DataFrame, ids: DataFrame, n_ids: int, column: str = "doc_id") -> DataFrame:
    """Rows of df whose id is among ``ids`` (distinct): by broadcast if n_ids is within BROADCAST_ROWS, else by a shuffle."""
    (name,) = fresh(df, "narrow_id")
    ids = ids.select(F.col(column).alias(name))
    return df.join(F.broadcast(ids) if n_ids <= BROADCAST_ROWS else ids, F.col(column).eqNullSafe(F.col(name)), "left_semi")


def sampled_texts(docs: DataFrame, chosen: DataFrame, n: int) -> DataFrame:
    """chosen (doc_id, ...: n rows at most, each id once) with a text for each: of a repeated id the least, so that n bounds the rows."""
    texts = narrow_to(docs.select("doc_id", "text").where("text is not null"), chosen.select("doc_id"), n)
    return texts.groupBy("doc_id").agg(F.min("text").alias("text")).join(F.broadcast(chosen), "doc_id")


#: Rows that one range of ranged() holds, on average.
RANGE_ROWS = 100_000


def ranged(df: DataFrame, order: Sequence[F.Column], n: int, tag: str) -> DataFrame:
    """df (n rows), written in ranges of ``order``, with column _range: the ranges' numbers ascend with the order, equal rows share
    one. Rows for one range only are left where they are."""
    ranges = -(-n // RANGE_ROWS)
    if ranges <= 1:
        return df.withColumn("_range", F.lit(0))
    return stash(df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), tag)


def before_ranges(df: DataFrame, **sums: F.Column) -> DataFrame:
    """_range and, for each named aggregate, what the ranges before it sum to: one row for each range of ranged()."""
    per = df.groupBy("_range").agg(*(c.alias(k) for k, c in sums.items()))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    return F.broadcast(per.select("_range", *(F.coalesce(F.sum(k).over(before), F.lit(0)).alias(k) for k in sums)))


def apart(found: Iterable[tuple]) -> list[tuple]:
    """Those of ``found`` (any, start, end, ...) that overlap none before them in the list, by their start."""
    kept: list[tuple] = []
    starts: list[int] = []
    for f in found:
        i = bisect_right(starts, f[1])
        if (i == 0 or kept[i - 1][2] <= f[1]) and (i == len(kept) or f[2] <= starts[i]):
            starts.insert(i, f[1])
            kept.insert(i, f)
    return kept
