"""Names that are alike, met block by block: the same numbers and the same best ones as all pairs give, and no row for a pair."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions import expr as X
from marlstone.operators import alike, resolve

COMPANY = "id long, name string, ats string, board_token string, careers_page_url string, has_recent_snapshot boolean"
CANDIDATE = "input_index int, name string, ats string, board_token string, careers_url string"


def _sets(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("most", [40, 400, 10**6])
def test_blocks_equal_all_pairs(spark, most):
    rng = random.Random(most)
    draw = lambda low, high: rng.sample(range(30), rng.randint(low, high))
    known = [(10 * i + 3, rng.randint(1, 4), draw(1, 12)) for i in range(60)] + [(9000, 2, list(range(300))), (9001, 1, list(range(20, 320)))]
    asked = [(i, draw(1, 14)) for i in range(40)] + [(100, list(range(290))), (101, [77777]), (102, known[0][2]), (103, known[0][2])]
    got = {r.input_index: (r.match_count, [(t.score, -t.neg) for t in r.top]) for r in alike.alike(_sets(spark, asked, "input_index int, grams array<long>"), _sets(spark, known, "id long, n long, grams array<long>"), 0.4, 3, most).collect()}
    want = {}
    for i, a in asked:
        found = [(float(np.float32(len({*a} & {*b}) / len({*a} | {*b}))), k, n) for k, n, b in known]
        found = sorted((-s, k, n) for s, k, n in found if s >= float(np.float32(0.4)))
        if found:
            want[i] = (sum(n for *_, n in found), [(-s, k) for s, k, _ in found[:3]])
    assert got == want and 101 not in got and got[100][0] == 3 and got[102] == got[103]


def test_the_least_in_common_is_exact():
    m = np.arange(1, 400)
    for n in (1, 2, 7, 10, 333):
        for threshold in (0.4, 0.5, 1.0):
            need = alike.least_common(n, m, threshold)
            for k, least in zip(m.tolist(), need.tolist(), strict=True):
                reach = [b for b in range(1, min(n, k) + 1) if np.float32(b / (n + k - b)) >= np.float32(threshold)]
                assert least == (reach[0] if reach else k + 1), (n, k, threshold)


def _like_the_given(spark, n):
    """Companies and candidates whose names differ in digits alone, some names twice."""
    none = [None] * 3
    companies = [(i, f"Customer#{i % (n - 20):09d}", *none, False) for i in range(n)] + [(n, "--", *none, False), (n + 1, None, *none, False)]
    candidates = [(i, f"Custmer {i % 25:09d}" if i % 3 else f"Else {i}", *none) for i in range(40)] + [(40, "--", *none), (41, " ", *none)]
    return spark.createDataFrame(candidates, CANDIDATE), spark.createDataFrame(companies, COMPANY)


def test_no_pair_is_a_row_where_most_names_are_alike(spark, monkeypatch):
    candidates, companies = _like_the_given(spark, 120)
    rows = lambda df: sorted(map(tuple, df.collect()))
    pairs = rows(resolve.matches(candidates, companies)), rows(resolve.verdicts(candidates, companies))
    assert any(r[2] == "fuzzy_name" for r in pairs[0]) and {r[1] for r in pairs[1]} == {"stale", "new", "invalid"}

    def joined(*_):
        raise AssertionError("pairs are joined")

    monkeypatch.setattr(resolve, "MOST_MET", 100)
    monkeypatch.setattr(resolve, "fuzzy_matches", joined)
    assert (rows(resolve.matches(candidates, companies)), rows(resolve.verdicts(candidates, companies))) == pairs


def test_names_that_rarely_meet_are_joined(spark):
    sets = lambda key, names: spark.createDataFrame(list(enumerate(names)), f"{key} int, name string").withColumn("grams", X.trigram_codes(X.trigrams(F.col("name"))))
    word = lambda i: "".join(chr(97 + i * p % 26) for p in (1, 3, 5, 7, 11, 17))
    apart = sets("input_index", [word(i) for i in range(20)]), sets("id", [word(i) + "x" for i in range(20)])
    assert not resolve._many_meet(*apart, 0.4)


def test_match_lists_never_ask_for_snapshots(spark):
    companies = spark.createDataFrame([(1, "Acme", "lever", "acme", None), (2, "Acme Tools", "lever", "tools", None)], "id long, name string, ats string, board_token string, careers_page_url string")
    broken = spark.range(1).select(F.col("id").alias("company_id"), F.raise_error(F.lit("snapshots are read")).cast("timestamp").alias("fetched_at"))
    known = resolve.recent_companies(companies, broken, F.lit("2024-01-01").cast("timestamp"))
    candidates = spark.createDataFrame([(0, "Zed", "lever", "acme", None), (1, "Acme Toolz", None, None, None)], CANDIDATE)
    assert {(r.input_index, r.id, r.match_kind) for r in resolve.matches(candidates, known).collect()} == {(0, 1, "token"), (1, 1, "fuzzy_name"), (1, 2, "fuzzy_name")}


def test_recent_companies_at_the_edge(spark):
    companies = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id long")
    seen = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2023-01-01 00:00:00"), (2, "2023-12-31 23:59:59"), (3, None), (None, "2024-02-01 00:00:00")], "company_id long, at string").select("company_id", F.to_timestamp("at").alias("fetched_at"))
    got = resolve.recent_companies(companies, seen, F.lit("2024-01-31").cast("timestamp"))
    assert sorted(map(tuple, got.collect())) == [(1, True), (2, False), (3, False), (4, False)] and got.columns == ["id", "has_recent_snapshot"]


def test_old_line_items_never_meet_orders(spark, sf):
    from marlstone.plans import catalogue

    _, companies = catalogue._candidates(spark, sf)
    plan = companies._jdf.queryExecution().optimizedPlan().toString()
    assert any("Filter" in line and "l_shipdate" in line and ">=" in line for line in plan.splitlines()), plan
    assert {f.rsplit("/", 1)[-1] for f in companies.inputFiles()} == {"customer.parquet", "orders.parquet", "lineitem.parquet"}
