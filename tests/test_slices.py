"""Raw JSON of jobs: what comes out is what the source wrote."""

import json
import random

from pyspark.sql import functions as F

from marlstone.functions.slices import elements_of
from marlstone.sources import payloads as P

JOBS = ['{ "z" : 1.50,"id":"a", "hostedUrl":"https://x/1" }', '{"id":"b","hostedUrl":"https://x/2","n":1E+2,"t":"\\u00e9\\/é ]},{[ \\" \\\\","e":[],"o":{ }}', '\t{"hostedUrl":"https:\\/\\/x/3",\n"id" :"c"}\r\n']


def test_elements_by_hand():
    assert elements_of(("[" + ",".join(JOBS) + " ]").encode(), None) == [j.strip().encode() for j in JOBS]
    assert elements_of(b'{"a":[[1],[2,[3]]], "jobs" :[ 1 , "x,]" , null,[ ],{"jobs":[9]}],"b":"jobs"}', "jobs") == [b"1", b'"x,]"', b"null", b"[ ]", b'{"jobs":[9]}']
    assert elements_of(b'{"\\u006aobs":[7],"x":{"jobs":[8]}}', "jobs") == [b"7"]
    assert elements_of(b'{"jobs":[1],"jobs":[2]}', "jobs") == [b"2"]
    assert elements_of(b" [ ] ", None) == elements_of(b'{"jobs":[\n]}', "jobs") == []
    for text, name in ((b"", None), (b"{}", None), (b"{}", "jobs"), (b'{"jobs":{}}', "jobs"), (b'{"jobs":null,"a":[1]}', "jobs"), (b'{"jobs":"[1]"}', "jobs"), (b'"[1]"', None), (b"[1", None), (b'{"a":"jobs","b":[1]}', "jobs")):
        assert elements_of(text, name) is None, text


def test_elements_of_made_up_values():
    """Dumped values of any shape, with odd blanks between the elements, against the texts that they were put together from."""
    rng = random.Random(3)
    signs = ['"', "\\", "[", "]", "{", "}", ",", ":", "é", "\U0001f600", "\n", "a", "jobs"]

    def value(deep: int):
        kind = rng.randrange(7 if deep else 4)
        if kind < 2:
            return "".join(rng.choice(signs) for _ in range(rng.randrange(8)))
        if kind < 4:
            return rng.choice([None, True, 0, -1.5, 1e30])
        if kind == 4:
            return [value(deep - 1) for _ in range(rng.randrange(4))]
        return {"".join(rng.choice(signs) for _ in range(3)): value(deep - 1) for _ in range(rng.randrange(4))}

    def dumped(v):
        return json.dumps(v, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))

    for _ in range(1500):
        parts = [dumped(value(3)) for _ in range(rng.randrange(5))]
        array = "[" + rng.choice(["", " "]) + rng.choice([",", " ,\n", ", "]).join(parts) + "\t]"
        around = [f"{json.dumps('k' + str(i) + rng.choice(signs))}:{dumped(value(2))}" for i in range(rng.randrange(3))]
        around.insert(rng.randrange(len(around) + 1), '"jobs" : ' + array)
        want = [p.encode() for p in parts]
        assert elements_of(array.encode(), None) == want
        assert elements_of(("{" + ", ".join(around) + "}").encode(), "jobs") == want


def test_raw_data_is_what_was_captured(spark):
    rows = [(1, "lever", 0, "[" + ",".join(JOBS) + "]"), (2, "ashby", 0, '{"apiVersion":1,"jobs":[' + JOBS[0].replace("hostedUrl", "jobUrl") + "]}"), (3, "lever", 0, "[]"), (4, "lever", 0, '["x", null]'), (5, "lever", 0, None)]
    df = spark.createDataFrame(rows, "company_id long, ats string, page_no int, body string").withColumn("board_token", F.lit("t")).withColumn("fetched_at", F.lit("2024-01-01").cast("timestamp"))
    got = {(r.company_id, r.source_id): r.raw_data for r in P.normalize(df).where("issue is null").collect()}
    assert got == {(1, "a"): JOBS[0].strip(), (1, "b"): JOBS[1].strip(), (1, "c"): JOBS[2].strip(), (2, "a"): JOBS[0].replace("hostedUrl", "jobUrl")}
    issues = {(r.company_id, r.issue, r.raw_data) for r in P.normalize(df).where("issue is not null").collect()}
    assert issues == {(4, "missing id", '"x"'), (4, "missing id", "null"), (5, "malformed body", None)}
