import datetime as dt

import pytest
from pyspark.sql import functions as F

from marlstone.functions import expr as X
from marlstone.functions.text import html_to_text, plain_text
from marlstone.operators import boilerplate as BP
from marlstone.plans.read_models import workplace


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def values(spark, fn, inputs, kind="string"):
    df = spark.createDataFrame(list(enumerate(inputs)), f"i int, x {kind}")
    return [r.y for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_names_and_hosts(spark):
    assert values(spark, X.normalize_name, ["Acmé, Inc.", "ACMÉ inc", None, "--"]) == ["acméinc", "acméinc", None, ""]
    urls = ["https://www.Acme.com/x", "http://me:pw@acme.com:80?y", "https://[::1]:8/", "acme.com", "ftp://acme.com", None, "https://www.www.a.b"]
    assert values(spark, X.url_host, urls) == ["acme.com", "acme.com", "[::1]", None, None, None, "www.a.b"]
    assert values(spark, X.url_valid, ["https://a.b", "a.b", "https://", "http://a/%zz", "http://a/%20", None]) == [True, False, False, False, True, False]


def test_similarity(spark):
    same = one(spark, X.similarity(X.trigrams(F.lit("Acme")), X.trigrams(F.lit("acme"))).alias("a"), X.similarity(X.trigrams(F.lit("word")), X.trigrams(F.lit("two words"))).alias("b"), X.similarity(X.trigrams(F.lit("-")), X.trigrams(F.lit(""))).alias("c"))
    assert same.a == 1.0 and abs(same.b - 0.363636) < 1e-6 and same.c == 0.0


def test_wire_values(spark):
    assert values(spark, lambda c: X.employment(c, X.EMPLOYMENT_LEVER), ["Full-time / freelance", "Fixed term", "PT", "odd", "", None]) == ["contract", "contract", "part_time", None, None, None]
    assert values(spark, lambda c: X.workplace(c, X.WORKPLACE_GEM), ["In_Office", "remote", "moon"]) == ["onsite", "remote", None]
    pay = lambda lo, hi, cur, per: one(spark, X.pay(F.lit(lo), F.lit(hi), F.lit(cur), F.lit(per)).alias("p")).p
    assert tuple(pay(10.9, 20.1, " usd ", "per-hour-wage")) == (10, 20, "USD", "hour")
    assert pay(0.0, 0.0, "USD", "per-hour-wage") is None and pay(1.0, 2.0, "US1", "per-hour-wage") is None and pay(1.0, 2.0, "USD", "x") is None and pay(3.0, 2.0, "USD", "per-hour-wage") is None


def test_times(spark):
    got = values(spark, X.instant, ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05.5+01:00", "2024", "2024-01-02", "x", None])
    assert got == [dt.datetime(2024, 1, 2, 3, 4, 5), dt.datetime(2024, 1, 2, 2, 4, 5, 500000), None, None, None, None]
    assert one(spark, X.epoch_ms(F.lit(0).cast("long")).alias("x")).x is None
    today = F.lit("2024-03-10").cast("date")
    say = ["Posted Today", "posted yesterday", "Posted 3 Days Ago", "Posted 1 Day Ago", "Posted 30+ Days Ago", "2024-01-01", "2024-13-01", "whenever", ""]
    day, known = values(spark, lambda c: X.posted_on(c, today)[0].cast("date").cast("string"), say), values(spark, lambda c: X.posted_on(c, today)[1], say)
    assert day == ["2024-03-10", "2024-03-09", "2024-03-07", "2024-03-09", None, "2024-01-01", None, None, None]
    assert known == [True] * 6 + [False] * 3


def test_boards(spark):
    odd = ["HTTP://Boards.Greenhouse.IO/Acme?x#y", "https://boards.greenhouse.io:443/acme", "https://u@jobs.lever.co/acme", "https://www.jobs.lever.co/acme", "https://jobs.lever.co//acme", "https://jobs.lever.co?x=/acme", "ftp://jobs.lever.co/acme", "jobs.lever.co/acme", "https://jobs.gem.com/a b", "https://apply.workable.com/", ""]
    got = [g and (g["ats"], g["board_token"], g["pattern"]) for g in values(spark, X.detect_board, odd)]
    assert got == [("greenhouse", "acme", "greenhouse_boards"), *[None] * 7, ("gem", "a b", "gem"), None, None]
    sites = ["en/Jobs", "en-US/Jobs/x", "en-US", "en/", "eng/Jobs", "e1/Jobs", "en-us-x/Jobs", "en-USA/Jobs", "fr?x/Jobs"]
    got = [g["board_token"] for g in values(spark, X.detect_board, [f"https://Acme.wd1.myworkdayjobs.com/{x}" for x in sites])]
    assert got == [f"acme.wd1.myworkdayjobs.com/{x}" for x in ("Jobs", "Jobs", "en-US", "en", "eng", "e1", "en-us-x", "en-USA", "fr")]
    assert values(spark, X.detect_board, ["https://myworkdayjobs.com/Jobs", "https://.myworkdayjobs.com/Jobs", "https://a_b.myworkdayjobs.com/Jobs"]) == [None] * 3
    got = values(spark, X.detect_board, ["https://boards.greenhouse.io/Acme/jobs/1", "https://jobs.lever.co/AcMe?x", "https://X.myworkdayjobs.com/en-US/Jobs/1", "https://x.myworkdayjobs.com/Jobs", "https://a.b/c", None])
    assert [g and (g.ats, g.board_token) for g in got] == [("greenhouse", "acme"), ("lever", "AcMe"), ("workday", "x.myworkdayjobs.com/Jobs"), ("workday", "x.myworkdayjobs.com/Jobs"), None, None]
    ok = lambda ats, t: one(spark, X.token_valid(F.lit(ats), F.lit(t)).alias("x")).x
    assert ok("workday", "a.myworkdayjobs.com/S") and not ok("workday", "a.com/S") and ok("workable", "a-b") and not ok("workable", "A") and not ok("other", "x") and not ok("gem", "")
    assert values(spark, X.strip_code_fence, ["```json\n{}\n```", " {} "]) == ["{}", "{}"]


def test_display(spark):
    assert values(spark, X.compact_count, [0, 999, 1284, 9999, 10_000, 12_949, 12_950, 999_949, 999_950, 1_250_000, 3_000_000_000, 2 * 10**12], "long") == ["0", "999", "1,284", "9,999", "10K", "12.9K", "13K", "999.9K", "1M", "1.3M", "3B", "2T"]
    assert values(spark, X.percent_text, [0.0, 0.007, 0.014, 0.995, 0.9949, 1.0, 0.125], "double") == ["0%", "<1%", "1%", "99%", "99%", "100%", "13%"]
    assert values(spark, X.rate_text, [0.0, 0.3, 9.96, 10.0, 34.5], "double") == ["0", "0.3", "10.0", "10", "35"]
    now = dt.datetime(2024, 3, 1)
    back = [now - dt.timedelta(seconds=s) for s in (0, 59, 60, 7200, 86_400, 200_000, 2_592_000, 6_000_000, 31_536_000, 99_999_999)] + [now + dt.timedelta(hours=5), now + dt.timedelta(days=1), None]
    assert values(spark, lambda c: X.ago(c, F.lit("2024-03-01").cast("timestamp")), back, "timestamp") == ["just now", "just now", "1 minute ago", "2 hours ago", "yesterday", "2 days ago", "last month", "2 months ago", "last year", "3 years ago", "in 5 hours", "tomorrow", None]
    label = lambda a, b: one(spark, X.workplace_label(F.lit(a), F.lit(b)).alias("x")).x
    assert label("onsite", "ats") == "Onsite (reported)" and label("remote", "location_text") == "Remote (derived from location)" and label("remote", None) is None and label("remote", "guess") is None


@pytest.mark.parametrize(
    "html, want",
    [("<p>a&nbsp;b</p>\n c", "a b c"), ("&amp;lt;b&amp;gt;x", "x"), ("a<SCRIPT x>1</Script>y", "ay"), ("<script>t", "t"), ("<script>1</script><style>2</style>z", "z"), ("1 < 2", "1 < 2"), ("&#65;&#x42;&#0;&bogus;", "AB&bogus;"), ("", ""), (None, None), ("<scriptx>t", "t")],
)
def test_html(html, want):
    assert plain_text(html) == want


def test_html_is_idempotent_and_vectorised(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet").select(html_to_text("html").alias("t")).collect()
    assert rows and all(plain_text(r.t) == r.t or "&" in r.t or "<" in r.t for r in rows)


SHARED = "We are one company that many people like to work for because of all the many good things that we do each day. " * 3


def cut_by_brute_force(texts):
    n, w = len(texts), BP.WINDOW
    if n < 3:
        return texts
    raw, count = [t.encode() for t in texts], {}
    for r in raw:
        for x in {r[i : i + w] for i in range(len(r) - w + 1)}:
            count[x] = count.get(x, 0) + 1
    import math

    import numpy as np

    good = {x for x, c in count.items() if c >= math.ceil(0.6 * n)}
    spans = {s for r in raw for s in BP._spans(r, np.array([r[i : i + w] in good for i in range(len(r) - w + 1)], bool))}
    return [BP.cut_spans(t, list(spans)) for t in texts]


def test_boilerplate_against_brute_force(spark):
    texts = [f"Role {i}: do thing number {i} well. {SHARED}Apply by {i} May." for i in range(4)] + ["Short one.", SHARED.strip()]
    rows = [(1, i, t) for i, t in enumerate(texts)] + [(2, 100, SHARED), (2, 101, SHARED), (3, 102, None)]
    got = {r.job_posting_id: r.stripped for r in BP.strip_boilerplate(spark.createDataFrame(rows, "company_id long, job_posting_id long, description_text string")).collect()}
    assert [got[i] for i in range(6)] == cut_by_brute_force(texts)
    assert "many people like" not in got[0] and got[5] == SHARED.strip()
    assert got[100] == SHARED and 102 not in got
    chosen = spark.createDataFrame([(0,), (1,), (2,), (103,)], "job_posting_id long")
    out = {r.job_posting_id: r.description_text for r in BP.stripped_for(chosen, spark.createDataFrame(rows, "company_id long, job_posting_id long, description_text string")).collect()}
    assert out[0] == got[0] and out[103] == ""


CASES = [  # reported, raw JSON, location, type, source
    ("hybrid", '{"telecommuting": true}', "remote", "hybrid", "ats"),
    (None, '{"telecommuting": true}', "onsite", "remote", "raw_data"),
    (None, '{"telecommuting": false}', "remote", None, None),
    (None, '{"telecommuting": false}', "hybrid, remote", "hybrid", "location_text"),
    (None, '{"telecommuting": false}', "On site", "onsite", "location_text"),
    (None, '{"metadata": [{"name": "Remote", "value": true}]}', None, "remote", "raw_data"),
    (None, '{"metadata": [{"name": "Remote", "value": false}, {"name": "Location Type", "value": "Hybrid - 3 days"}]}', "remote", "hybrid", "raw_data"),
    (None, '{"metadata": [{"name": "Location Type", "value": ["On-site"]}]}', None, "onsite", "raw_data"),
    (None, '{"metadata": [{"name": "Location Type", "value": null}]}', "x", None, None),
    (None, '{"metadata": [{"name": "Location Type", "value": "Anywhere"}]}', "Remote", "remote", "location_text"),
    (None, '{"metadata": [{"name": "Job Posting Location", "value": ["Paris", "US Remote"]}]}', None, "remote", "raw_data"),
    (None, '{"metadata": [{"name": "Job Posting Location", "value": ["Paris Headquarters"]}]}', None, "onsite", "raw_data"),
    (None, '{"metadata": [{"name": "Job Posting Location", "value": []}]}', None, None, None),
    (None, '{"metadata": null}', "remote-friendly", None, None),
    (None, '{"metadata": {"name": "Remote", "value": true}}', "Remote friendly, Paris", None, None),
    (None, "not json", "  Hybrid  ", "hybrid", "location_text"),
    (None, None, "remote office", "remote", "location_text"),
    (None, None, None, None, None),
]


def test_workplace(spark):
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(CASES)], "i int, a string, r string, l string")
    got = df.select("i", workplace(F.col("a"), F.col("r"), F.col("l")).alias("w")).orderBy("i").collect()
    assert [(r.w.workplace_type, r.w.workplace_source) for r in got] == [c[3:] for c in CASES]
