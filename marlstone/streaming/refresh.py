"""Open postings kept fresh by a stream of snapshot files. The batch read models stay the definition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.plans.read_models import latest_successful_runs

SCHEMA = "job_posting_id long, fetch_run_id long"


#: Versions that are kept, the newest included; a batch needs the one before it.
KEPT = 10


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _version(spark: SparkSession, out_dir: str, version: int) -> DataFrame:
    """A version, or an error if it isn't there as a whole: without it postings would vanish."""
    path = f"{out_dir}/version={version}"
    files, sign = _at(spark, f"{path}/_SUCCESS")
    if not files.exists(sign):
        raise FileNotFoundError(f"{path} is missing or was never finished")
    return spark.read.schema(SCHEMA).parquet(path)


def open_postings_stream(spark: SparkSession, snapshot_dir: str, schema: str, runs_dir: str, postings_dir: str, out_dir: str, checkpoint: str, kept: int = KEPT):
    """Starts a query that reads each snapshot file once and writes the open postings after each micro-batch as a version.

    A batch joins its new snapshots and the version before with the latest successful runs, so its work follows the open
    postings and the new files, not the whole log. A run whose end is logged after its snapshots were read is found again
    among ``pending`` ones, which a version keeps as long as their run isn't older than the company's latest. A batch
    that is run again overwrites its own version only. Only the first batch starts from nothing; any other fails if the
    version before its own isn't there. The newest ``kept`` versions stay, two at least, older ones are removed.
    """
    kept = max(kept, 2)

    def refresh(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        runs = session.read.parquet(runs_dir)
        latest = latest_successful_runs(runs).select("company_id", F.col("started_at").alias("latest_at"), F.col("fetch_run_id").alias("latest_id"))
        owners = session.read.parquet(postings_dir).select(F.col("id").alias("job_posting_id"), "company_id")
        before = _version(session, out_dir, batch_id - 1) if batch_id else session.createDataFrame([], SCHEMA)
        seen = before.unionByName(batch.where("fetch_run_id is not null").select("job_posting_id", "fetch_run_id")).distinct()
        placed = seen.join(runs.select(F.col("id").alias("fetch_run_id"), F.col("company_id").alias("run_company"), "started_at"), "fetch_run_id").join(owners, "job_posting_id").where("company_id = run_company").join(latest, "company_id", "left")
        still = placed.where("latest_id is null or struct(started_at, fetch_run_id) >= struct(latest_at, latest_id)")
        still.select("job_posting_id", "fetch_run_id").write.mode("overwrite").parquet(f"{out_dir}/version={batch_id}")
        files, old = _at(session, f"{out_dir}/version={batch_id - kept}")
        files.delete(old, True)  # nothing if it isn't there

    return spark.readStream.schema(schema).parquet(snapshot_dir).writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def open_now(spark: SparkSession, runs: DataFrame, out_dir: str, version: int) -> DataFrame:
    """job_posting_id, fetch_run_id of the postings that are open by a version and the runs as they stand now."""
    return _version(spark, out_dir, version).join(latest_successful_runs(runs).select("fetch_run_id"), "fetch_run_id").select("job_posting_id", "fetch_run_id")
