"""A fetch written in order, so that a writer may die at any point and run again.

A batch of captures has a name; what it writes lies in partitions of that name, and each write replaces that partition and
nothing else. The order is: the runs' beginnings, identities, snapshots, and last the runs' ends. A batch counts once its
ends are there: snapshots are read through runs that ended well, identities through ended batches, so nothing of a batch
that died is seen but runs in progress. Running it again writes the same rows into the same partitions; running an ended one
writes nothing. One writer at a time; a name stands for one input; a batch that died is run again before the next begins.

Identities are a log by hash of their key: a batch reads the buckets that its keys fall into, and appends those rows alone that
are new or changed. What is written follows the batch, not the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.sources import actions, ledger
from marlstone.sources import payloads as P

BUCKETS = 256
STEPS = ("begun", "identities", "snapshots", "ended")
EVENTS = "run_id long, company_id long, seq int, at timestamp, status string, error_message string, postings_count int, step string, batch string"
IDENTITIES = "id long, company_id long, source_url string, source_id string, first_seen_at timestamp, bucket int, batch string"
_KEY = ["company_id", "source_url"]


def bucket(buckets: int = BUCKETS) -> F.Column:
    return F.pmod(F.xxhash64(*_KEY), F.lit(buckets)).cast("int").alias("bucket")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def events(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, f"{path}/runs", EVENTS)


def batches(spark: SparkSession, path: str, step: str) -> set[str]:
    """Names of batches of which a step ("begun" or "ended") is written. The success file of the write is the sign, so that a batch
    without runs counts too."""
    root = f"{path}/runs/step={step}"
    if not _exists(spark, root):
        return set()
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    names = [s.getPath().getName().removeprefix("batch=") for s in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)]
    return {n for n in names if _exists(spark, f"{root}/batch={n}/_SUCCESS")}


def runs(spark: SparkSession, path: str) -> DataFrame:
    """The current state of each run."""
    return ledger.fold_runs(events(spark, path).drop("step", "batch"))


def identities(spark: SparkSession, path: str, buckets: list[int] | None = None) -> DataFrame:
    """Identities of ended batches, those of the given buckets only (other partitions aren't read): the newest source id of each."""
    log = _read(spark, f"{path}/identities", IDENTITIES)
    log = log if buckets is None else log.where(F.col("bucket").isin(buckets))
    begun = batches(spark, path, "begun") - batches(spark, path, "ended")  # one at most
    log = log.where(~F.col("batch").isin(*begun)) if begun else log
    return log.groupBy("id", *_KEY).agg(F.max_by("source_id", "batch").alias("source_id"), F.min("first_seen_at").alias("first_seen_at"))


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Snapshots of runs that ended well."""
    good = events(spark, path).where("status = 'success'").select(F.col("run_id").alias("fetch_run_id"))
    return spark.read.parquet(f"{path}/snapshots").join(good, "fetch_run_id", "left_semi")


def write_fetch(spark: SparkSession, path: str, batch: str, payloads: DataFrame, buckets: int = BUCKETS, after: Callable[[str], None] = lambda step: None) -> bool:
    """Writes a batch of captured pages; false if it had been written. Names of batches must ascend, as a time does: of two
    source ids the one of the later name stands. ``after`` is called when a step is written."""
    if not batch or any(c in batch for c in "/=\\ "):
        raise ValueError(f"a batch can't be called {batch!r}")
    name = f"b-{batch}"
    done = batches(spark, path, "ended")
    if name in done:
        return False
    if open_ := batches(spark, path, "begun") - done - {name}:
        raise ValueError(f"{min(open_)} has begun and not ended: run it again first")
    if done and max(done) > name:
        raise ValueError(f"{name} comes after {max(done)}")

    def write(df: DataFrame, to: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{path}/{to}")
        return spark.read.schema(df.schema).parquet(f"{path}/{to}")

    judged, found = write(P.boards(payloads), f"staged/{name}/boards"), write(P.accepted(payloads), f"staged/{name}/postings")  # bodies are parsed here only
    touched = [r.bucket for r in found.select(bucket(buckets)).distinct().collect()]  # at most ``buckets``
    known = identities(spark, path, touched)
    greatest = ledger.greatest_id(_read(spark, f"{path}/identities", IDENTITIES).where(F.col("batch") != name))
    before = events(spark, path).where(F.col("batch") != name).select(F.col("run_id").alias("id"))
    made, all_after, rows = actions.transaction_of(judged, found, before, known, greatest)
    changed = all_after.join(known.select("id", F.col("source_id").alias("_old"), F.lit(True).alias("_known")), "id", "left").where("_known is null or not (source_id <=> _old)")

    write(made.where("seq = 0"), f"runs/step=begun/batch={name}")
    after("begun")
    keyed = changed.select("id", *_KEY, "source_id", "first_seen_at", bucket(buckets), F.lit(name).alias("batch"))
    keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(f"{path}/identities")
    after("identities")
    write(rows, f"snapshots/batch={name}")
    after("snapshots")
    write(made.where("seq = 1"), f"runs/step=ended/batch={name}")
    after("ended")
    staged = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/staged/{name}")
    staged.getFileSystem(spark._jsc.hadoopConfiguration()).delete(staged, True)
    return True
