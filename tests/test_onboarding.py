"""Research records from their addresses to verified boards: each stop, and the look-up of detected boards."""

from pyspark.sql import functions as F

from marlstone.operators import resolve

RECORDS = "record_id long, status string, verified_at string, url string, careers_url string, careers_ok boolean, ats string, board_token string"
GH, LEVER = "https://boards.greenhouse.io/", "https://jobs.lever.co/"
CASES = [  # status, verified_at, url, careers_url, careers_ok, ats, board_token -> next_status, missing, ats, board_token
    (("stale-needs-merge", None, None, None, None, None, None), ("stale-needs-merge", None, None, None)),
    ((None, "2024-01-01", None, None, None, None, None), ("verified", None, None, None)),
    ((None, None, " ", GH + "new", True, None, None), (None, "url", None, None)),
    ((None, None, "u", "", True, None, None), (None, "careers_url", None, None)),
    ((None, None, "u", None, None, "lever", "Fresh"), ("duplicate", None, "lever", "Fresh")),
    ((None, None, "u", None, None, "lever", "fresh"), (None, None, "lever", "fresh")),
    ((None, None, "u", None, None, "lever", "Old"), ("stale-needs-merge", None, "lever", "Old")),
    ((None, None, "u", LEVER + "Fresh", True, None, None), ("duplicate", None, "lever", "Fresh")),
    ((None, None, "u", LEVER + "Fresh", False, None, None), ("duplicate", None, "lever", "Fresh")),
    ((None, None, "u", LEVER + "Old", False, None, "junk"), ("stale-needs-merge", None, "lever", "Old")),
    ((None, None, "u", "https://x.example/jobs", False, None, None), ("no-careers", None, None, None)),
    ((None, None, "u", "https://x.example/jobs", None, None, "t"), ("no-careers", None, None, "t")),
    ((None, None, "u", "https://x.example/jobs", True, None, None), ("unsupported-ats", None, None, None)),
    ((None, None, "u", GH + "good", False, None, None), ("verified", None, "greenhouse", "good")),
    ((None, None, "u", "https://x.example/jobs", False, "greenhouse", "bad"), ("invalid-token", None, "greenhouse", "bad")),
    ((None, None, "u", None, None, "other", "t"), ("unsupported-ats", None, "other", "t")),
    ((None, None, "u", GH + "good", True, "greenhouse", None), (None, "ats-or-board-token", "greenhouse", None)),
    ((None, None, "u", GH + "good", True, "", "t"), (None, "ats-or-board-token", "", "t")),
    ((None, None, "u", None, None, "greenhouse", "silent"), (None, None, "greenhouse", "silent")),
]


def test_each_stop(spark):
    records = spark.createDataFrame([(i, *given) for i, (given, _) in enumerate(CASES)], RECORDS).withColumn("verified_at", F.col("verified_at").cast("timestamp")).withColumn("name", F.lit("extra"))
    companies = spark.createDataFrame([("lever", "Fresh", False), ("lever", "Fresh", True), ("lever", "Old", False), (None, "Old", True)], "ats string, board_token string, has_recent_snapshot boolean")
    boards = spark.createDataFrame([("greenhouse", "good", False), ("greenhouse", "good", True), ("greenhouse", "bad", False), ("greenhouse", "silent", None), ("lever", "Fresh", True)], "ats string, board_token string, ok boolean")
    got = {r.record_id: (r.next_status, r.missing, r.ats, r.board_token) for r in resolve.onboard_boards(resolve.onboard(records, companies), boards).collect()}
    assert [got[i] for i in range(len(CASES))] == [want for _, want in CASES]


def test_one_board_of_many_records(spark):
    records = spark.range(3000).select(F.col("id").alias("record_id"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("timestamp").alias("verified_at"), F.lit("u").alias("url"), F.lit(LEVER + "Old").alias("careers_url"), F.lit(True).alias("careers_ok"), F.lit(None).cast("string").alias("ats"), F.lit(None).cast("string").alias("board_token"))
    companies = spark.createDataFrame([("lever", "Old", False)], "ats string, board_token string, has_recent_snapshot boolean")
    opened = resolve.onboard(records, companies)
    assert [(r.next_status, r["count"]) for r in opened.groupBy("next_status").count().collect()] == [("stale-needs-merge", 3000)]
    assert resolve.onboard(records.limit(0), companies).count() == 0
