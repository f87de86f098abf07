import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from marlstone import schemas
from marlstone.operators import resolve
from marlstone.operators.latest import latest_per_key
from marlstone.plans import composition as C
from marlstone.plans import gateway
from marlstone.plans import read_models as R
from marlstone.sources import ledger, payloads

T = lambda d, h=0: dt.datetime(2024, 1, d, h)


def test_openness(spark):
    runs = spark.createDataFrame([(1, 1, T(1), "success"), (2, 1, T(2), "failed"), (3, 2, T(1), "success")], "id long, company_id long, started_at timestamp, status string")
    postings = spark.createDataFrame([(10, 1, T(1)), (11, 1, T(1)), (12, 1, T(1)), (13, 2, T(1))], "id long, company_id long, first_seen_at timestamp")
    snaps = [(1, 10, 1, T(1), "old"), (2, 10, 1, T(1, 5), "tie"), (3, 10, 1, T(1, 5), "last"), (4, 10, 2, T(2), "failed"), (5, 10, None, T(3), "none"), (6, 11, None, T(3), "none"), (7, 12, 1, T(1), "x"), (8, 13, 1, T(1), "wrong company")]
    snaps = spark.createDataFrame([(i, p, r, at, t, None, None, None) for i, p, r, at, t in snaps], "id long, job_posting_id long, fetch_run_id long, fetched_at timestamp, title string, location_text string, workplace_type string, raw_data string")
    classes = spark.createDataFrame([(1, 10, T(1), "mid"), (2, 10, T(2), "lead"), (3, 10, T(2), "staff")], "id long, job_posting_id long, classified_at timestamp, seniority string")
    companies = spark.createDataFrame([(1, "A"), (2, "B")], "id long, name string")
    got = {r.job_posting_id: (r.title, r.seniority) for r in R.open_display(runs, snaps, postings, companies, classes).collect()}
    assert got == {10: ("last", "staff"), 12: ("x", None)}


def test_latest_agrees_with_a_window(spark):
    df = spark.range(3000).select((F.col("id") % 17).alias("k"), (F.hash("id") % 5).alias("a"), F.col("id").alias("b"))
    window = df.selectExpr("*", "row_number() over (partition by k order by a desc, b desc) as rn").where("rn = 1").drop("rn")
    assert sorted(latest_per_key(df, ["k"], ["a", "b"]).collect()) == sorted(window.collect())


BODIES = {
    ("greenhouse", "Acme"): {"jobs": [{"id": 7, "title": "T", "absolute_url": "u", "location": {"name": "L"}, "departments": [{"name": "D"}], "content": "&lt;p&gt;Hi&lt;/p&gt;", "updated_at": "2024-01-01T00:00:00Z"}]},
    ("greenhouse", "zero"): {"jobs": [{"id": 1}, {"id": 0}]},
    ("greenhouse", "time"): {"jobs": [{"id": 1, "updated_at": "yesterday"}]},
    ("greenhouse", "none"): {"jobs": []},
    ("greenhouse", "Co+ a/b"): {"jobs": [{"id": 8}]},
    ("lever", "l"): [{"id": "a", "hostedUrl": "u", "categories": {"allLocations": [], "location": "X"}}, {"id": "b", "hostedUrl": "v", "categories": {"location": "X", "commitment": "Intern"}, "createdAt": 0}],
    ("ashby", "a"): {"jobs": [{"id": "a", "jobUrl": "u", "location": "P", "secondaryLocations": [{"location": "Q", "address": {"postalAddress": {"addressLocality": "Rome", "addressCountry": "IT"}}}, {"location": "S"}], "employmentType": "FullTime"}]},
    ("workday", "x.myworkdayjobs.com/Site"): {"total": 1, "jobPostings": [{"title": "T", "externalPath": "/job/1", "postedOn": "Posted Yesterday"}]},
    ("workable", "Acme_Corp"): {"jobs": [{"shortcode": "S", "application_url": "u", "city": "A", "country": "B", "published_on": "2024-01-03T05:00:00Z", "created_at": "2024-01-03"}]},
    ("gem", "g"): [{"id": "i", "absolute_url": "u", "location": {"name": "N"}, "offices": [{"location": {"name": ""}}], "location_type": "in_office", "employment_type": "full_time", "content_plain": "plain"}, {"id": "j", "absolute_url": "v", "location": {"name": "N"}, "offices": [{"location": {"name": "O"}}], "first_published_at": "2024-01-02T03:04:05Z"}],
}


def test_payloads(spark):
    rows = [(i, ats, token, 0, T(5), json.dumps(b)) for i, ((ats, token), b) in enumerate(BODIES.items())] + [(99, "gem", "bad", 0, T(5), "{}"), (98, "lever", "junk", 0, T(5), "oops"), (97, "gem", "https://x/y", 0, T(5), "[]"), (96, "workday", "nohost/S", 0, T(5), '{"jobPostings": []}'), (95, "odd", "x", 0, T(5), "[]")]
    df = spark.createDataFrame(rows, schemas.PAYLOAD)
    issues = {(r.ats, r.board_token): r.first_issue for r in payloads.boards(df).collect()}
    bad = {("gem", "https://x/y"): "bad token", ("workday", "nohost/S"): "bad token", ("odd", "x"): "unsupported source", ("greenhouse", "zero"): "missing id", ("greenhouse", "time"): "malformed time", ("gem", "bad"): "malformed body", ("lever", "junk"): "malformed body"}
    assert issues == {**dict.fromkeys(BODIES), **bad}
    got = {(r.ats, r.source_id): r for r in payloads.accepted(df).collect()}
    assert set(got) == {("greenhouse", "7"), ("lever", "a"), ("lever", "b"), ("ashby", "a"), ("workday", "/job/1"), ("workable", "S"), ("gem", "i"), ("gem", "j"), ("greenhouse", "8")}
    g = got["greenhouse", "7"]
    assert (g.source_url, g.description_text, g.location_texts, g.department) == ("https://boards-api.greenhouse.io/v1/boards/Acme/jobs/7", "Hi", ["L"], "D")
    assert got["greenhouse", "8"].source_url == "https://boards-api.greenhouse.io/v1/boards/Co+%20a%2Fb/jobs/8"
    assert got["lever", "a"].location_text is None and got["lever", "b"].location_text == "X" and got["ashby", "a"].location_text == "P" and (got["gem", "j"].location_text, got["gem", "j"].posted_at) == ("O", dt.datetime(2024, 1, 2, 3, 4, 5))
    assert got["lever", "a"].location_texts == [] and got["lever", "b"].location_texts == ["X"] and got["lever", "b"].posted_at is None
    assert got["ashby", "a"].location_texts == ["P", "Rome, IT", "S"] and got["ashby", "a"].employment_type == "full_time"
    assert got["workday", "/job/1"].source_url == "https://x.myworkdayjobs.com/en-US/Site/job/1" and got["workday", "/job/1"].posted_at == T(4)
    assert got["workable", "S"].location_text == "A, B" and got["workable", "S"].source_first_published_at == T(3) and got["workable", "S"].posted_at is None
    assert got["gem", "i"].location_texts == ["N"] and got["gem", "i"].workplace_type == "onsite" and got["gem", "i"].description_text == "plain"


def test_paged_sources_end(spark):
    lever = lambda n, k: json.dumps([{"id": f"{n}-{i}", "hostedUrl": f"u{n}-{i}"} for i in range(k)])
    workday = lambda n, k, total: json.dumps({"total": total, "jobPostings": [{"externalPath": f"/{n}-{i}"} for i in range(k)]})
    host = "x.myworkdayjobs.com/S"
    rows = [(1, "lever", "l", 0, T(5), lever(0, 100)), (1, "lever", "l", 1, T(5), lever(1, 3)), (1, "lever", "l", 2, T(5), "not a page")]
    rows += [(2, "workday", host, p, T(5), workday(p, 20, 40)) for p in range(3)] + [(3, "workday", host, 0, T(5), workday(0, 20, 60)), (3, "workday", host, 1, T(5), workday(1, 0, 60)), (3, "workday", host, 2, T(5), workday(2, 20, 60))]
    rows += [(4, "workable", "w", 0, T(5), json.dumps({"jobs": [{"shortcode": f"{i}", "url": f"u{i}"} for i in range(1000)]}))]
    df = spark.createDataFrame(rows, schemas.PAYLOAD)
    got = {r.company_id: (r.postings, r.first_issue, r.warning) for r in payloads.boards(df).collect()}
    assert got == {1: (103, None, None), 2: (40, None, None), 3: (20, None, None), 4: (1000, None, "many jobs")}
    assert payloads.accepted(df).count() == 1163


def test_identities_are_idempotent(spark):
    none = spark.createDataFrame([], "id long, company_id long, source_url string, source_id string, first_seen_at timestamp")
    seen = spark.createDataFrame([(1, "u", "a", T(1)), (1, "u", "b", T(2)), (2, "u", "c", T(1))], "company_id long, source_url string, source_id string, fetched_at timestamp")
    once = ledger.upsert_identities(none, seen)
    twice = ledger.upsert_identities(once, seen)
    key = lambda df: sorted((r.id, r.company_id, r.source_url, r.source_id, r.first_seen_at) for r in df.collect())
    assert key(once) == key(twice) and sorted(r.id for r in once.collect()) == [1, 2]
    assert {(r.company_id, r.source_id, r.first_seen_at) for r in once.collect()} == {(1, "b", T(1)), (2, "c", T(1))}


def test_a_broken_posting_aborts_its_company(spark):
    rows = spark.createDataFrame([(1, "u", "a", "{}"), (1, "v", "", "{}"), (2, "w", "b", "{}")], "company_id long, source_url string, source_id string, raw_data string")
    ids = spark.createDataFrame([(5, 1, "u"), (6, 1, "v"), (7, 2, "w")], "id long, company_id long, source_url string")
    got = ledger.snapshot_rows(rows, ids, spark.createDataFrame([(1, 11), (2, 12)], "company_id long, fetch_run_id long")).collect()
    assert [(r.job_posting_id, r.fetch_run_id) for r in got] == [(7, 12)]


def test_fuzzy_prefix_join_equals_all_pairs(spark):
    names = ["Acme Robotics", "Acme Robotic Inc", "Beta Labs", "Betalabs", "Gamma", "gamma ray", "Acme", "", "--"]
    cand = spark.createDataFrame(list(enumerate(names)), "input_index int, name string")
    known = spark.createDataFrame(list(enumerate(reversed(names))), "id int, name string")
    from marlstone.functions import expr as X

    a, b = cand.select("input_index", X.trigrams(F.col("name")).alias("a")), known.select("id", X.trigrams(F.col("name")).alias("b"))
    want = {(r.input_index, r.id) for r in a.crossJoin(b).withColumn("s", X.similarity(F.col("a"), F.col("b"))).where("s >= 0.4").collect()}
    assert {(r.input_index, r.id) for r in resolve.fuzzy_matches(cand, known).collect()} == want


def test_composition_rules_and_links():
    for name, q in C.SEEDS.items():
        assert q.issues() == [], name
        assert C.from_link(q.link()) == (q.canonical(), [])
    codes = lambda **k: [c for c, _ in C.Composition(**k).issues()]
    assert codes(measure="lifespan", encoding="line", cohort="open") == ["cohort_not_allowed", "encoding_needs_week", "measure_needs_distribution_encoding"]
    assert codes(measure="count", encoding="histogram", group_by=("company", "week")) == ["encoding_needs_per_posting_measure", "encoding_needs_at_most_one_grouping"]
    assert codes(measure="share", encoding="stacked_bar") == ["encoding_needs_two_groupings", "measure_needs_grouping"]
    assert codes(measure="delta", encoding="diverging_bars") == ["measure_needs_window"] and codes(measure="pay", encoding="table") == ["shape"]
    assert C.from_link("v=1&v=1&m=count&enc=table")[1] == [("duplicate_link_key", "v")] and C.from_link("v=2&m=count&enc=table")[1] == [("version_unsupported", "")]
    assert C.from_link("v=1&m=count&enc=table&win=0w")[1] == [("shape", "window")]
    q = C.Composition("count", "table", filters=(("skill", " go "), ("company", "B"), ("skill", "go")), group_by=("week", "company", "week")).canonical()
    assert q.filters == (("company", "B"), ("skill", "go")) and q.group_by == ("company", "week") and q.needs_denominator()


def test_questions_from_plain_data():
    full = {"measure": "count", "encoding": "table", "cohort": None, "groupBy": ["week", "company"], "filters": [{"dimension": "skill", "value": " go "}], "window": {"weeks": "12"}, "sort": "desc", "limit": "5"}
    c, issues = C.from_mapping(full)
    assert issues == [] and (c.weeks, c.limit, c.cohort, c.filters, c.group_by) == (12, 5, "open", (("skill", "go"),), ("company", "week"))
    for change, slot in (({"odd": 1}, "odd"), ({"limit": "5.0"}, "limit"), ({"limit": True}, "limit"), ({"window": {"weeks": 1, "x": 2}}, "window"), ({"filters": [{"dimension": "skill"}]}, "filters"), ({"groupBy": "company"}, "groupBy"), ({"measure": None}, "measure"), ({"measure": 3}, "measure")):
        assert C.from_mapping(full | change) == (None, [("shape", slot)]), change
    assert C.from_mapping([]) == (None, [("shape", "")]) and C.from_mapping(full | {"limit": 0})[1] == [("shape", "limit")]
    schema = C.json_schema()
    assert schema["additionalProperties"] is False and schema["required"] == ["measure", "encoding"] and schema["properties"]["limit"] == {"type": "integer", "minimum": 1, "maximum": 1000}
    with pytest.raises(ValueError, match="groupBy: this measure needs a grouping"):
        C.Composition("share", "table").link()
    assert C.explain([("shape", "limit"), ("version_unsupported", "")]) == "limit: has no such value; composition: only version 1 of a link is read"


def test_the_entry_stands_without_the_subpackage(monkeypatch):
    import sys

    import __spark_entry__ as E

    for name in [n for n in sys.modules if n.startswith("marlstone.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "marlstone.llm", None)
    assert set(E.oracle_sql()) < set(E.queries()) and "pipeline" not in E.queries() and not any(n.startswith("op") and n[2].isdigit() for n in E.queries())


def test_gateway(spark):
    spark.range(5).createOrReplaceTempView("five")
    a = gateway.query(spark, "select id, timestamp'2024-01-01' as t from five order by id", rows=3, seconds=60)
    assert a.ok and a.truncated and [r["id"] for r in a.rows] == [0, 1, 2] and a.rows[0]["t"].startswith("2024-01-01T00:00:00")
    assert not gateway.query(spark, "drop view five").ok and not gateway.query(spark, "selec 1").ok and not gateway.query(spark, "create table q as select 1").ok
    assert gateway.query(spark, "select count(*) as n from five", seconds=60).rows == ({"n": 5},)


@pytest.mark.parametrize("name", ["open_count_per_company", "workplace_tiers", "dedup_verdict", "dedup_matches", "lever_boards", "workday_boards", "gem_boards", "movers", "closed_by_week", "payload_rule_failures", "payload_text_rules", "save_failures", "fetch_outcomes", "display_formats", "fuzzy_match"])
def test_queries_equal_their_sql(spark, sf, name):
    import duckdb

    from marlstone.plans.catalogue import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("customer", "supplier", "part", "orders", "lineitem", "events", "pages", "region", "benchmark", "documents"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    rows = lambda data: sorted(map(repr, data))
    assert rows(want.fetchall()) == rows(tuple(r) for r in QUERIES[name](spark, sf).select(*columns).collect())


@pytest.mark.parametrize("sql", ["execute immediate 'create table gq1 as select 1 a'", "from (select 1 a) insert into gq2 select a insert into gq2 select a", "begin create table gq1 as select 1 a; end", "with x as (select 1 a) insert into gq2 select a from x", "select transform(a) using 'cat' from (select 1 a)", "select reflect('java.lang.System', 'setProperty', 'gq', '1')", "set x = 1", "cache table gq2", "call x()"])
def test_the_gateway_writes_nothing(spark, sql):
    spark.sql("drop table if exists gq2")
    spark.sql("create table gq2 (a int) using parquet")
    try:
        assert not gateway.query(spark, sql, seconds=60).ok
        assert not spark.catalog.tableExists("gq1") and spark.table("gq2").count() == 0
        assert gateway.query(spark, "with x as (select a, row_number() over (order by a) as n from gq2 union all select 1, 2) select * from x join lateral (select 3 as c) where a in (select max(a) from x) having count(*) > 0 limit 5", seconds=60) is not None
        assert gateway.query(spark, "with x as (values (1), (2) as t(a)) select a, sum(a) over () as s from x where exists (select 1 from gq2 right join x using (a)) order by a limit 1", seconds=60).rows == ({"a": 1, "s": 3},)
    finally:
        spark.sql("drop table if exists gq2")


def test_requests_are_judged(spark):
    from marlstone.sources import actions

    adds = spark.createDataFrame([(1, " A ", "lever", "x", None), (2, None, "", " ", "nope"), (3, "B", "odd", "x", "https://a.b"), (4, "C", "workday", "a.com/S", None), (5, "D", "workday", "A.myworkdayjobs.com/S", "https://a/%zz")], "request_id long, name string, ats string, board_token string, careers_page_url string")
    got = {(r.request_id, r.path, r.code) for r in actions.add_company_failures(adds).collect()}
    assert got == {(2, "name", "missing_required"), (2, "ats", "missing_required"), (2, "board_token", "missing_required"), (2, "careers_page_url", "invalid_url"), (3, "ats", "unsupported_ats"), (4, "board_token", "invalid_board_token"), (5, "careers_page_url", "invalid_url")}
    asks = spark.createDataFrame([(1, "A", None, "no_careers"), (2, "A", " ", "unsupported_ats"), (3, "", "x", "bored"), (4, "A", "https://a.b", None)], "request_id long, name string, url string, reason string")
    got = {(r.request_id, r.path, r.code) for r in actions.record_unsupported_failures(asks).collect()}
    assert got == {(2, "url", "missing_required"), (3, "name", "missing_required"), (3, "url", "invalid_url"), (3, "reason", "invalid_reason"), (4, "reason", "missing_required")}
    looks = spark.createDataFrame([(1, None), (2, 0), (3, 30), (4, 5)], "request_id long, recency_days int")
    cand = spark.range(201).selectExpr("3L as request_id", "id").unionByName(spark.range(200).selectExpr("1L as request_id", "id"))
    assert {(r.request_id, r.code) for r in resolve.request_failures(looks, cand).collect()} == {(2, "invalid_recency_days"), (3, "too_many_candidates")}


PAYLOAD_ROW = {"payload_id": 1, "posting_id": 10, "model": " ", "prompt_version": None, "seniority": "senior", "notes": "  fine ", "roles": [("data-eng", " Data Eng ", ["eng"], None)], "specializations": [("ml", "ML")], "skills": [("go", "Golang"), ("sql", None)]}


def test_saving_is_all_or_nothing(spark):
    from marlstone.operators import validation
    from marlstone.sources import actions

    schema = validation.PAYLOAD + ", posting_id long, model string, prompt_version string"
    columns = [c.split()[0] for c in ("payload_id x, seniority x, notes x, roles x, specializations x, skills x, posting_id x, model x, prompt_version x").split(", ")]
    rows = [PAYLOAD_ROW, PAYLOAD_ROW | {"payload_id": 2, "notes": " \n ", "model": "m-1"}, PAYLOAD_ROW | {"payload_id": 3, "posting_id": 99}, PAYLOAD_ROW | {"payload_id": 4, "model": "a b", "seniority": "boss"}, PAYLOAD_ROW | {"payload_id": 5, "notes": "x\0"}, PAYLOAD_ROW | {"payload_id": 6, "notes": "y" * 4097, "skills": [("s" * 65, "S"), ("ml", "ML")]}]
    frame = spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], schema)
    known = spark.createDataFrame([("skills", "go")], "kind string, slug string")
    saved = actions.save_enrichments(frame, spark.createDataFrame([(10,)], "id long"), known, spark.createDataFrame([("eng",)], "slug string"), spark.createDataFrame([(7,)], "id long"), F.lit("2024-01-01").cast("timestamp"))
    failed = {(r.payload_id, r.path, r.code) for r in saved.failures.collect()}
    assert failed == {(3, "posting_id", "posting_not_found"), (4, "provenance.model", "invalid_provenance"), (4, "seniority", "invalid_seniority"), (5, "notes", "null_byte"), (6, "notes", "notes_too_long"), (6, "skills[0].slug", "slug_too_long"), (6, "specializations[0].slug", "slug_collision"), (6, "skills[1].slug", "slug_collision")}
    got = {r.payload_id: r for r in saved.classifications.collect()}
    assert set(got) == {1, 2} and {r.id for r in got.values()} == {8, 9}
    assert (got[1].model, got[1].prompt_version, got[1].notes) == (actions.MODEL, actions.PROMPT_VERSION, "fine") and (got[2].model, got[2].notes) == ("m-1", None)
    assert {(r.kind, r.slug, r.name) for r in saved.terms.collect()} == {("roles", "data-eng", "Data Eng"), ("specializations", "ml", "ML"), ("skills", "sql", "sql")}
    assert saved.links.count() == 8 and {(r.slug, r.dimension) for r in saved.dimensions.collect()} == {("data-eng", "eng")}


def test_a_fetch_is_one_transaction(spark, tmp_path):
    from marlstone.sources import actions

    body = lambda *ids: json.dumps({"jobs": [{"id": i, "absolute_url": "u"} for i in ids]})
    rows = [(1, "greenhouse", "a", 0, T(5), body(1, 2)), (2, "greenhouse", "b", 0, T(5), body(3, 0)), (3, "gem", "c", 0, T(5), "[]"), (1, "greenhouse", "a", 0, T(6), body(2))]
    none = spark.createDataFrame([], "id long, company_id long, source_url string, source_id string, first_seen_at timestamp")
    events, ids, snaps = actions.fetch_transaction(spark.createDataFrame(rows, schemas.PAYLOAD), spark.createDataFrame([(40,)], "id long"), none)
    state = {(r.company_id, r.started_at): r for r in ledger.fold_runs(events).collect()}
    assert {k: (r.status, r.error_message, r.postings_count) for k, r in state.items()} == {(1, T(5)): ("success", None, 2), (2, T(5)): ("failed", "missing id", None), (3, T(5)): ("success", None, 0), (1, T(6)): ("success", None, 1)}
    assert sorted(r.run_id for r in state.values()) == [41, 42, 43, 44]
    known = {r.id: r.source_id for r in ids.collect()}
    assert sorted(known.values()) == ["1", "2"]
    for _ in range(2):
        ledger.append(snaps, f"{tmp_path}/snapshots")
    assert spark.read.parquet(f"{tmp_path}/snapshots").count() == 6
    assert sorted((known[r.job_posting_id], r.fetch_run_id) for r in snaps.collect()) == sorted([("1", state[1, T(5)].run_id), ("2", state[1, T(5)].run_id), ("2", state[1, T(6)].run_id)])


def test_match_lists(spark):
    known = spark.createDataFrame([(1, "Acme Robotics", "lever", "acme", "https://acme.com", True), (2, "Acme Robotic", "lever", "b", None, True), (3, "Acme Robots", "gem", "c", None, True), (4, "Acme Robotix", "gem", "d", None, True), (5, "acme-robotics", "gem", "e", None, False)], "id long, name string, ats string, board_token string, careers_page_url string, has_recent_snapshot boolean")
    cand = spark.createDataFrame([(0, "Zed", "lever", "acme", None), (1, "ACME robotics", None, None, "http://www.acme.com/x"), (2, "Acme Roboticss", None, None, None), (3, "Nothing", None, None, None)], "input_index int, name string, ats string, board_token string, careers_url string")
    got = {}
    for r in resolve.matches(cand, known).collect():
        got.setdefault(r.input_index, []).append((r.id, r.match_kind, r.match_count))
    assert sorted(got[0]) == [(1, "token", 1)] and sorted(got[1]) == [(1, "domain", 2), (5, "name_only", 2)]
    assert len(got[2]) == 3 and {k for _, k, _ in got[2]} == {"fuzzy_name"} and {n for _, _, n in got[2]} == {5} and 3 not in got


def test_unexpected_ids(spark):
    from marlstone.operators import validation

    body = lambda *ids: json.dumps({"results": [{"posting_id": i, "payload": "{}"} for i in ids]})
    responses = spark.createDataFrame([(1, body(1, 9)), (2, body(3, 3, 8)), (3, "oops")], "batch_id long, body string")
    expected = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (3, 4)], "batch_id long, posting_id long")
    assert [tuple(r) for r in validation.unexpected_ids(responses, expected).collect()] == [(1, 9)]
    assert {(r.posting_id, r.outcome) for r in validation.response_outcomes(responses, expected).collect()} == {(1, "parsed"), (2, "missing"), (3, "json_failed"), (4, "json_failed")}
