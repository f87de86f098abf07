"""Attempts folded to outcomes, against a plain loop over each posting's calls."""

import json
import random

from pyspark.sql import functions as F

from marlstone.operators import attempts
from marlstone.sources import actions

CALLS, ASKED = "call_id long, seq long, error string, cancelled boolean, body string", "call_id long, posting_id long"


def answer(pid, seniority="senior", **more):
    return {"posting_id": pid, "summary": f"s{pid}", "classification": {"seniority": seniority, "notes": ""}, "canonical_roles": [], "specializations": [], "skills": [], **more}


def folded(spark, postings, calls, asked, retries=2):
    terms, dims = spark.createDataFrame([("skills", "java")], "kind string, slug string"), spark.createDataFrame([("engineering",)], "slug string")
    posts = spark.createDataFrame([(p,) for p in postings], "posting_id long")
    return attempts.outcomes(posts, spark.createDataFrame(calls, CALLS), spark.createDataFrame(asked, ASKED), terms, dims, retries)


def plain(postings, calls, asked, retries):
    out = {}
    for p in set(postings):
        mine = sorted({(c[1], c[0]) for c in calls if (c[0], p) in asked})
        done, said, last, attempts_ = False, None, "cancelled", 0
        for _, cid in mine:
            if done or attempts_ > retries:
                break
            _, _, error, cancelled, body = next(c for c in calls if c[0] == cid)
            if cancelled:
                last, done = "cancelled", True
                continue
            attempts_ += 1
            if error is not None:
                last = error
                continue
            try:
                results = json.loads(body or "").get("results") or []
                ids = [r["posting_id"] for r in results]
                assert len(ids) == len(set(ids))
            except (ValueError, AssertionError):
                last = "no json"
                continue
            own = [r for r in results if r["posting_id"] == p]
            if not own:
                last = "missing from the answer"
                continue
            said = own[0]["summary"]
            good = own[0]["classification"]["seniority"] == "senior"
            last, done = "" if good else "seniority: invalid_seniority", good
        out[p] = ("enriched" if said and done and last == "" else "validation_failed" if said else "json_failed", attempts_, last, said)
    return out


def test_against_a_plain_loop(spark):
    rng = random.Random(5)
    postings, calls, asked = list(range(60)), [], []
    for cid in range(150):
        ids = rng.sample(postings, rng.choice([1, 1, 5]))
        asked += [(cid, p) for p in ids] * rng.choice([1, 1, 2])
        some = [answer(p, rng.choice(["senior", "expert"])) for p in ids if rng.random() < 0.8] + ([answer(999)] if rng.random() < 0.2 else [])
        some += some[:1] if rng.random() < 0.2 else []
        body = rng.choice([json.dumps({"results": some}), json.dumps({"results": some}), "{oops", None, "", "{}"])
        calls.append((cid, rng.randrange(4), rng.choice([None, None, None, "exit 1"]), rng.choice([False, False, None, True]) if rng.random() < 0.3 else False, body))
    got = {r.posting_id: (r.outcome, r.attempts, r.last_reason, r.summary) for r in folded(spark, postings, calls, asked)[0].collect()}
    assert got == plain(postings, calls, set(asked), 2)
    assert {v[0] for v in got.values()} == {"enriched", "validation_failed", "json_failed"}


def test_odd_answers_and_limits(spark):
    body = lambda *results: json.dumps({"results": list(results)})
    calls = [
        (1, 0, None, False, "```json\n" + body(answer(1), answer(2, skills=[{"slug": "Bad Slug", "name": "x"}])) + "\n```"), (2, 0, None, False, '{"results": [{"posting_id": "three"}]}'), (3, 0, None, False, "[1]"),
        (4, 0, None, False, body(answer(5), answer(77), answer(77))), (5, 0, "exit 1", False, None), (6, 1, "exit 2", None, None), (7, 2, None, False, body(answer(6))),
    ]
    asked = [(1, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (6, 6), (7, 6), (99, 8)]
    found, sound = folded(spark, [1, 2, 3, 4, 5, 6, 7, 8, 1], calls, asked, retries=1)
    got = {r.posting_id: (r.outcome, r.attempts, r.last_reason) for r in found.collect()}
    no = ("json_failed", 1, "no json")
    assert got == {1: ("enriched", 1, ""), 2: ("validation_failed", 1, "skills[0].slug: invalid_slug"), 3: no, 4: no, 5: no, 6: ("json_failed", 2, "exit 2"), 7: ("json_failed", 0, "cancelled"), 8: ("json_failed", 0, "cancelled")}
    assert [r.posting_id for r in sound.collect()] == [1]
    ids = spark.createDataFrame([(40,)], "id long")
    for exists, outcome, reason in ((1, "enriched", ""), (2, "db_failed", "posting_id: posting_not_found")):
        after, saved = actions.write_back(found, sound, ("m", "v"), spark.createDataFrame([(exists,)], "id long"), spark.createDataFrame([], "kind string, slug string"), spark.createDataFrame([], "slug string"), ids, F.lit("2024-01-01").cast("timestamp"))
        assert {r.posting_id: (r.outcome, r.last_reason) for r in after.collect()}[1] == (outcome, reason)
        assert [(r.id, r.posting_id) for r in saved.classifications.collect()] == ([(41, 1)] if exists == 1 else [])


def test_nothing(spark):
    assert folded(spark, [], [], [])[0].collect() == []
    assert [tuple(r)[:3] for r in folded(spark, [3], [], [])[0].collect()] == [(3, "json_failed", 0)]


def test_calls_are_read_once(spark, monkeypatch):
    """A body is parsed once, and what calls gave is kept once: as the fold."""
    kept = []
    monkeypatch.setattr(attempts, "cut", lambda df: kept.append(df) or df)
    found, _ = folded(spark, [1, 2], [(1, 0, None, False, json.dumps({"results": [answer(1)]}))], [(1, 1), (1, 2)])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(kept) == 1 and plan.count("from_json(") == 1
    assert {r.posting_id: r.outcome for r in found.collect()} == {1: "enriched", 2: "json_failed"}


def test_outcomes_without_payload_are_no_hot_task(spark):
    n = 400
    found = spark.range(n).select(F.col("id").alias("posting_id"), F.lit("json_failed").alias("outcome"), F.lit(0).cast("long").alias("attempts"), F.lit("cancelled").alias("last_reason"), F.lit(None).cast("string").alias("summary"), F.lit(None).cast("string").alias("payload_id")).repartition(4)
    terms = "array<struct<slug: string, name: string>>"
    sound = spark.createDataFrame([], f"posting_id long, payload_id string, seniority string, notes string, roles array<struct<slug: string, name: string, dimensions: array<string>, notes: string>>, specializations {terms}, skills {terms}")
    after, _ = actions.write_back(found, sound, ("m", "v"), spark.range(n), spark.createDataFrame([], "kind string, slug string"), spark.createDataFrame([], "slug string"), spark.range(1), F.lit("2024-01-01").cast("timestamp"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in after.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == n and max(sizes) <= n / 2


def test_links_take_the_ids_of_their_payloads(spark):
    body = json.dumps({"results": [answer(p, skills=[{"slug": f"s{p}", "name": ""}, {"slug": "java", "name": "J"}], specializations=[{"slug": f"x{p}", "name": ""}]) for p in (1, 2, 3)]})
    found, sound = folded(spark, [1, 2, 3], [(1, 0, None, False, body)], [(1, p) for p in (1, 2, 3)])
    _, saved = actions.write_back(found, sound, ("m", "v"), spark.createDataFrame([(1,), (3,)], "id long"), spark.createDataFrame([("skills", "java")], "kind string, slug string"), spark.createDataFrame([], "slug string"), spark.createDataFrame([(40,)], "id long"), F.lit("2024-01-01").cast("timestamp"))
    of = {r.id: r.posting_id for r in saved.classifications.collect()}
    assert sorted(of) == [41, 42] and sorted(of.values()) == [1, 3]
    links = [(of[r.classification_id], r.kind, r.slug) for r in saved.links.collect()]
    assert sorted(links) == sorted((p, k, s) for p in (1, 3) for k, s in (("skills", f"s{p}"), ("skills", "java"), ("specializations", f"x{p}")))
    assert sorted((r.kind, r.slug, r.name) for r in saved.terms.collect()) == sorted((k, f"{x}{p}", f"{x}{p}") for p in (1, 3) for k, x in (("skills", "s"), ("specializations", "x")))
    assert "payload_id" not in "".join(line for line in saved.links._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line)
