"""Records and logs in files, and the small predicates that writes rest on."""

import json

import pytest
from pyspark.sql import functions as F

from marlstone.sources import ledger, payloads


def test_sidecar_records(spark, tmp_path):
    good = [{"rank": 1, "name": "Acme", "source": {"industry": "x", "year_founded": 1999, "employee_change_pct": 2.5}, "url": "https://a.b", "status": "verified", "verified_at": "2024-01-02T03:04:05Z"}, {"rank": 2, "name": "Beta", "odd": 1}]
    (tmp_path / "good.jsonl").write_text("\n".join(map(json.dumps, good)))
    rows = payloads.read_sidecar(spark, str(tmp_path / "good.jsonl")).orderBy("rank").collect()
    assert [(r.rank, r.name, r.source and r.source.year_founded, r.status) for r in rows] == [(1, "Acme", 1999, "verified"), (2, "Beta", None, None)]
    (tmp_path / "bad.jsonl").write_text('{"rank": 1}\nnot json\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        payloads.read_sidecar(spark, str(tmp_path / "bad.jsonl")).collect()


def test_failures_are_appended(spark, tmp_path):
    rows = spark.createDataFrame([(1, "json_failed", False), (2, "parsed", True), (3, "validation_failed", True), (4, "cancelled", False)], "posting_id long, outcome string, was_classified boolean")
    for _ in range(2):
        ledger.write_failures(rows, f"{tmp_path}/failures.jsonl")
    assert sorted(r.posting_id for r in spark.read.json(f"{tmp_path}/failures.jsonl").collect()) == [1, 1, 3, 3]
    assert {(r.outcome, r.n, r.again) for r in ledger.outcome_tally(rows).collect()} == {("json_failed", 1, 0), ("parsed", 1, 1), ("validation_failed", 1, 1)}


def test_terms(spark):
    before = spark.createDataFrame([(1, "go", "Go")], "id long, slug string, name string")
    after = spark.createDataFrame([(1, "go", "Go"), (3, "sql", "SQL"), (2, "ml", "ML")], "id long, slug string, name string")
    uses = spark.createDataFrame([("sql", 2, 70), ("sql", 1, 90), ("go", 1, 5)], "slug string, place int, posting_id long")
    assert [r.slug for r in ledger.terms_by_slug(after).collect()] == ["go", "ml", "sql"]
    assert {(r.slug, r.source_posting) for r in ledger.new_terms(before, after, uses).collect()} == {("sql", 90), ("ml", 0)}
    # EXISTS as a value, and IS DISTINCT FROM: null is a value like any other
    assert spark.createDataFrame([(1, None), (None, None), (1, 1), (1, 2)], "a int, b int").select((~F.col("a").eqNullSafe(F.col("b"))).alias("x")).collect() == [(True,), (False,), (False,), (True,)]
    assert not ledger.orphans(spark.createDataFrame([(1,), (None,)], "term long"), before, "term").limit(1).count()
