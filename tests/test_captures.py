"""Captures of paged sources: gaps and missing ends fail a board; HTML in linear time."""

import json
import time

import pytest
from pyspark.sql import functions as F

from marlstone.functions.text import html_to_text, plain_text
from marlstone.sources import payloads as P

AT = "2024-01-01 00:00:00"


def board(ats: str, pages: dict[int, tuple[int, int]], company: int = 1):
    """Rows of a capture: page number to (jobs, total)."""
    rows = []
    for no, (n, total) in pages.items():
        jobs = [{"id": f"{no}-{i}", "hostedUrl": f"https://x/{no}/{i}"} if ats == "lever" else {"externalPath": f"/job/{no}/{i}", "title": "t"} for i in range(n)]
        rows.append((company, ats, "t" if ats == "lever" else "h.example.com/Site", AT, no, json.dumps(jobs if ats == "lever" else {"total": total, "jobPostings": jobs})))
    return rows


def judged(spark, *captures):
    rows = [(i, *r[1:]) for i, c in enumerate(captures) for r in c]
    df = spark.createDataFrame(rows, "company_id long, ats string, board_token string, fetched_at string, page_no int, body string").withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    found = {r.company_id: (r.postings, r.first_issue) for r in P.boards(df).collect()}
    taken = {r.company_id: r["count"] for r in P.accepted(df).groupBy("company_id").count().collect()}
    for i, (n, issue) in found.items():
        assert taken.get(i, 0) == (0 if issue else n)
    return [found[i] for i in range(len(captures))]


CUT = (0, "incomplete capture")


def test_lever_pages(spark):
    lever = lambda *pages: board("lever", {no: (n, 0) for no, n in pages})
    got = judged(spark, lever((0, 100), (1, 5)), lever((0, 100), (1, 0)), lever((0, 0)), lever((0, 100), (2, 5)), lever((0, 100)), lever((1, 5)), lever((1, 0)), lever((0, 100), (1, 100)), lever((0, 3), (1, 100), (5, 2)))
    assert got == [(105, None), (100, None), (0, None), CUT, CUT, CUT, CUT, CUT, (3, None)]


def test_workday_pages(spark):
    workday = lambda *pages: board("workday", {no: (n, total) for no, n, total in pages})
    got = judged(spark, workday((0, 20, 60)), workday((0, 20, 60), (1, 20, 60), (2, 20, 60)), workday((0, 20, 45), (2, 5, 45)), workday((0, 20, 25), (1, 5, 25)), workday((0, 20, 40), (1, 20, 40), (2, 0, 40)), workday((0, 20, 0)), workday((0, 7, 99)), workday((0, 20, 99), (1, 0, 99)))
    assert got == [CUT, (60, None), CUT, (25, None), (40, None), (20, None), (7, None), (20, None)]


def test_other_issues_stay_and_other_sources_have_no_chain(spark):
    bad = board("lever", {0: (100, 0), 1: (1, 0)})
    bad[1] = (*bad[1][:5], "{")
    ashby = [(1, "ashby", "t", AT, no, json.dumps({"jobs": [{"id": f"{no}", "jobUrl": "https://x"}]})) for no in (0, 7)]
    assert judged(spark, bad, ashby) == [(100, "malformed body"), (2, None)]


SLOW = {"<": "<" * 2_000_000, "script": "<script " * 250_000, "style": "<style/" * 280_000, "both": "<script></style>" * 120_000, "&": "&" * 2_000_000, "closed": "<script>x</script>" * 110_000, "tags": "<a " * 600_000 + ">"}


@pytest.mark.parametrize("name", list(SLOW))
def test_html_is_read_once(name):
    began = time.time()
    plain_text(SLOW[name])
    assert time.time() - began < 2


def test_html_columns(spark):
    texts = [None, "", " a  b\t\x0bc ", "<p>A&amp;lt;b&amp;gt;</p>", "<SCRIPT src=x>y</Script>z", "<script>a</script", "1 < 2", "a<style>b</style><style>c", "<script><style></script>d</style>e", "&nbsp;&#x41;&bogus;", "é &mdash; ü", "<scripty>k</scripty>"]
    got = [r.t for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", html_to_text("t").alias("t")).orderBy("i").collect()]
    assert got == [None, "", "a b c", "A", "z", "a</script", "1 < 2", "ac", "de", "A&bogus;", "é — ü", "k"]
