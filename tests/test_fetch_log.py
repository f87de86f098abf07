"""A fetch that stops after any step and runs again leaves the same log as one that never stopped."""

import json
import re
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from marlstone.sources import fetch_log as L
from marlstone.sources import ledger


class Stop(Exception):
    pass


def captured(spark, at: str, boards: dict[int, list[tuple[str, str]] | None]):
    """Boards of (id, url) jobs; None is a broken one."""
    rows = [(c, "ashby", "t", at, 0, "{" if jobs is None else json.dumps({"jobs": [{"id": i, "jobUrl": u, "title": f"{i} at {at}"} for i, u in jobs]})) for c, jobs in boards.items()]
    return spark.createDataFrame(rows, "company_id long, ats string, board_token string, fetched_at string, page_no int, body string").withColumn("fetched_at", F.col("fetched_at").cast("timestamp")).repartition(2)


FIRST = {1: [("a", "u1"), ("b", "u2")], 2: None, 3: []}
SECOND = {1: [("a2", "u1"), ("c", "u3")], 2: [("a", "u1")]}


def seen(spark, path):
    rows = lambda df: sorted(map(str, df.collect()))
    return rows(L.runs(spark, path)), rows(L.identities(spark, path)), rows(L.snapshots(spark, path).drop("batch").select("fetch_run_id", "job_posting_id", "company_id", "source_id", "source_url", "title", "raw_data"))


@pytest.fixture(scope="module")
def straight(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("straight"))
    assert L.write_fetch(spark, path, "1", captured(spark, "2024-01-01", FIRST), 8)
    assert L.write_fetch(spark, path, "2", captured(spark, "2024-01-02", SECOND), 8)
    return path, seen(spark, path)


def test_what_is_written(spark, straight):
    path, (runs, _, _) = straight
    state = {(r.company_id, r.started_at.day): (r.status, r.postings_count) for r in L.runs(spark, path).collect()}
    assert len(runs) == 5 and state == {(1, 1): ("success", 2), (2, 1): ("failed", None), (3, 1): ("success", 0), (1, 2): ("success", 2), (2, 2): ("success", 1)}
    kept = {(r.company_id, r.source_url): (r.source_id, r.first_seen_at.day) for r in L.identities(spark, path).collect()}
    assert kept == {(1, "u1"): ("a2", 1), (1, "u2"): ("b", 1), (1, "u3"): ("c", 2), (2, "u1"): ("a", 2)}
    assert len({r.id for r in L.identities(spark, path).collect()}) == 4 and L.snapshots(spark, path).count() == 5


def test_identities_equal_the_fold_and_writes_follow_the_batch(spark, straight):
    path, _ = straight
    none = spark.createDataFrame([], "id long, company_id long, source_url string, source_id string, first_seen_at timestamp")
    at = lambda day, boards: spark.createDataFrame([(c, u, i, f"2024-01-0{day}") for c, jobs in boards.items() for i, u in jobs or []], "company_id long, source_url string, source_id string, fetched_at string").withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    fold = ledger.upsert_identities(ledger.upsert_identities(none, at(1, FIRST)), at(2, SECOND))
    columns = ("company_id", "source_url", "source_id", "first_seen_at")
    assert sorted(fold.select(*columns).collect()) == sorted(L.identities(spark, path).select(*columns).collect())
    log = spark.read.schema(L.IDENTITIES).parquet(f"{path}/identities")
    assert {r.batch: r["count"] for r in log.groupBy("batch").count().collect()} == {"b-1": 2, "b-2": 3}  # u2 wasn't seen again
    part = L.identities(spark, path, [log.first().bucket])
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", part._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("step", ["identities", "snapshots"])
def test_stopped_after_a_step(spark, straight, tmp_path, step):
    path = str(tmp_path)

    def stop(at: str) -> None:
        if at == step:
            raise Stop

    shutil.copytree(straight[0], path, dirs_exist_ok=True)  # what the second batch wrote is taken away again
    for p in list(Path(path).rglob("batch=b-2")):
        shutil.rmtree(p)
    before = seen(spark, path)
    with pytest.raises(Stop):
        L.write_fetch(spark, path, "2", captured(spark, "2024-01-02", SECOND), 8, after=stop)
    if step != "ended":
        half = seen(spark, path)
        assert half[1:] == before[1:]  # nothing of it is seen but runs in progress
        with pytest.raises(ValueError):
            L.write_fetch(spark, path, "3", captured(spark, "2024-01-03", SECOND), 8)
    assert L.write_fetch(spark, path, "2", captured(spark, "2024-01-02", SECOND), 8) == (step != "ended")
    assert seen(spark, path) == straight[1]
    files = sorted(str(p.relative_to(path)) for p in Path(path).rglob("batch=*"))
    assert not L.write_fetch(spark, path, "2", captured(spark, "2024-01-02", SECOND), 8)
    assert seen(spark, path) == straight[1] and files == sorted(str(p.relative_to(path)) for p in Path(path).rglob("batch=*"))


def test_names(spark, tmp_path):
    for name in ("", "a/b", "a=b", ".. x"):
        with pytest.raises(ValueError):
            L.write_fetch(spark, str(tmp_path), name, captured(spark, "2024-01-01", FIRST))
