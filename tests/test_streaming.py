"""The stream's versions equal the batch read model after every micro-batch."""

import datetime as dt
import shutil

import pytest
from pyspark.errors import StreamingQueryException

from marlstone.plans.read_models import open_postings
from marlstone.streaming.refresh import open_now, open_postings_stream

RUNS, SNAPS, POSTINGS = "id long, company_id long, started_at timestamp, status string", "id long, job_posting_id long, fetch_run_id long", "id long, company_id long"


def test_versions_equal_the_read_model(spark, tmp_path):
    at = lambda d: dt.datetime(2024, 1, d)
    snaps, runs, postings = f"{tmp_path}/snaps", f"{tmp_path}/runs", f"{tmp_path}/postings"
    spark.createDataFrame([(10, 1), (11, 1), (12, 1), (20, 2)], POSTINGS).write.parquet(postings)
    steps = [
        ([(1, 1, at(1), "success"), (2, 2, at(1), "in_progress")], [(1, 10, 1), (2, 11, 1), (3, 20, 1), (4, 20, 2), (5, 12, None)]),
        ([(1, 1, at(1), "success"), (2, 2, at(1), "success"), (3, 1, at(2), "failed")], [(6, 12, 3), (7, 12, 1)]),
        ([(1, 1, at(1), "success"), (2, 2, at(1), "success"), (3, 1, at(2), "failed"), (4, 1, at(3), "success")], [(8, 12, 4), (9, 10, 1)]),
        ([(1, 1, at(1), "success"), (2, 2, at(1), "success"), (4, 1, at(3), "success"), (5, 2, at(4), "success")], [(10, 10, 4)]),
    ]
    every = []
    for n, (run_rows, snap_rows) in enumerate(steps):
        every += snap_rows
        spark.createDataFrame(run_rows, RUNS).write.mode("overwrite").parquet(runs)
        spark.createDataFrame(snap_rows, SNAPS).coalesce(1).write.mode("append").parquet(snaps)
        open_postings_stream(spark, snaps, SNAPS, runs, postings, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
        now = spark.createDataFrame(run_rows, RUNS)
        want = open_postings(now, spark.createDataFrame(every, SNAPS), spark.createDataFrame([(10, 1), (11, 1), (12, 1), (20, 2)], POSTINGS))
        got = [tuple(r) for r in open_now(spark, now, f"{tmp_path}/out", n).collect()]
        assert sorted(got) == sorted(tuple(r) for r in want.collect()) and len(got) == len(set(got)), n


def test_a_lost_version_fails_the_batch_and_old_ones_go(spark, tmp_path):
    snaps, runs, postings, out = (f"{tmp_path}/{d}" for d in ("snaps", "runs", "postings", "out"))
    spark.createDataFrame([(i, 1) for i in range(5)], POSTINGS).write.parquet(postings)
    spark.createDataFrame([(1, 1, dt.datetime(2024, 1, 1), "success")], RUNS).write.parquet(runs)

    def step(n: int) -> None:
        spark.createDataFrame([(n, n, 1)], SNAPS).coalesce(1).write.mode("append").parquet(snaps)
        open_postings_stream(spark, snaps, SNAPS, runs, postings, out, f"{tmp_path}/checkpoint", kept=2).awaitTermination()

    there = lambda: sorted(p.name for p in (tmp_path / "out").iterdir())
    for n in range(4):
        step(n)
    assert there() == ["version=2", "version=3"]
    (tmp_path / "out/version=3/_SUCCESS").unlink()  # as a write that was cut off
    with pytest.raises(StreamingQueryException, match="never finished"):
        step(4)
    assert there() == ["version=2", "version=3"]
    with pytest.raises(FileNotFoundError):
        open_now(spark, spark.read.parquet(runs), out, 7)
    shutil.copy(tmp_path / "out/version=2/_SUCCESS", tmp_path / "out/version=3/_SUCCESS")
    open_postings_stream(spark, snaps, SNAPS, runs, postings, out, f"{tmp_path}/checkpoint", kept=2).awaitTermination()
    assert sorted(r.job_posting_id for r in open_now(spark, spark.read.parquet(runs), out, 4).collect()) == [0, 1, 2, 3, 4]
