from __future__ import annotations

import datetime

import pytest

from marlstone import schemas
from marlstone.sources import payloads as P

AT = datetime.datetime(2001, 6, 30)
BODIES = [
    ("ashby", '{"jobs": [{"id": 7, "jobUrl": "u", "location": {"a": 1}, "secondaryLocations": [{"location": "L"}, null, 5, {"location": "M", "address": {"postalAddress": {"addressLocality": "Rome", "addressRegion": 5}}}]}]}', "7", ['{"a":1}', "L", "Rome, 5"]),
    ("gem", '[{"id": "g", "absolute_url": "u", "location": "no object", "offices": "no list"}]', "g", None),
    ("greenhouse", '{"jobs": [{"id": "12", "location": {"name": ["x"]}, "departments": [3, {"name": "d"}]}]}', "12", ['["x"]']),
    ("lever", '[{"id": "l", "hostedUrl": "u", "categories": {"allLocations": ["a", 4, null]}}]', "l", ["a", "4", None]),
]


@pytest.fixture
def captured(spark):
    return spark.createDataFrame([(i, ats, "t", 0, AT, body) for i, (ats, body, *_) in enumerate(BODIES)], schemas.PAYLOAD)


def test_jobs_of_odd_kinds_are_read_as_before(captured):
    found = {r.company_id: (r.source_id, r.location_texts) for r in P.accepted(captured, raw=False).collect()}
    assert found == {i: (source_id, places) for i, (_, _, source_id, places) in enumerate(BODIES)}


def test_jobs_are_no_variants_and_their_text_is_cut_only_if_asked_for(captured):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    without, judged = plan(P.accepted(captured, raw=False)), plan(P.boards(captured))
    assert "json_elements" not in without and "json_elements" in plan(P.accepted(captured))
    assert "ArrayType(VariantType" not in without + judged and "array<variant>" not in without + judged
    assert "descriptionHtml" not in judged
