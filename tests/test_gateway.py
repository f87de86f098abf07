"""The gateway reads known relations by known functions, whatever the shape of the query."""

import pytest

from marlstone.plans import gateway

WIDE = ", ".join(f"{i} as c{i}" for i in range(100))
CALL = "reflect('java.lang.System', 'getProperty', 'user.home')"


@pytest.fixture(scope="module")
def five(spark):
    spark.range(5).createOrReplaceTempView("five")
    spark.range(3).createOrReplaceTempView("hidden")
    return spark


@pytest.mark.parametrize("sql", [
    f"select {WIDE}, {CALL} as h", f"select {WIDE} from five where exists (select 1 from five where {CALL} = 'x')", f"select (select max({CALL}) from five) as h", f"select id in (select {CALL} from five) from five",
    f"with a as (select {CALL} as h) select * from a", f"with a as (with b as (select {WIDE}, {CALL} as h) select * from b) select 1", f"select sum(id) over (order by {CALL}) from five", f"select transform(array(1), x -> {CALL})", f"select case when true then upper(try_{CALL}) end",
    "select java_method('java.util.UUID', 'randomUUID')", f"select * from five lateral view explode(array({CALL})) t as h", f"select * from five, lateral (select {CALL})", f"select * from five order by {CALL}", f"select id from five group by id having max({CALL}) > ''", f"select * from explode(array({CALL}))",
    "select * from text.`/etc/hostname`", "select * from parquet.`/tmp`", "select * from five where exists (select * from binaryFile.`/etc/hostname`)", "with a as (select * from json.`/tmp`) select * from a", "select * from five union all select length(value) from text.`/etc/hostname`", "select * from default.five", "table text.`/etc/hostname`",
    "select * from identifier('five')", "select identifier('reflect')('java.lang.System', 'getProperty', 'user.home')", "select system.builtin.reflect('java.lang.System', 'getProperty', 'user.home')", "select input_file_name() from five", "select * from nowhere", "select * from sql_keywords()",
])
def test_refused(five, sql):
    assert not gateway.query(five, sql, seconds=60).ok


def test_own_functions_are_refused(five):
    five.udf.register("mine", lambda: "x")
    assert not gateway.query(five, "select mine()", seconds=60).ok


@pytest.mark.parametrize("sql", [
    f"select {WIDE}, upper('x') as h from five", "select a.id, count(*) filter (where b.id > 1) as n from five a join five b using (id) group by all", "with a as (select id from five), b as (select max(id) as m from a) select * from b", "select transform(array(1, 2), x -> x + 1) as t",
    "select id, lag(id) over (order by id) as l, nvl(null, 2) as v, cast(id as string) || 'x' as s, coalesce(null, 1) as c from five", "select * from five lateral view explode(array(1, 2)) t as h", "select * from range(3)", "select * from values (1, 'a') as t(x, y)",
    "select date_trunc('month', timestamp '2024-02-03'), from_json('{\"a\":1}', 'a int').a as a, regexp_replace('aa', 'a', 'b') as r", "select id from five where id in (select max(id) from five) order by 1 limit 2", "select json_tuple('{\"a\":1}', 'a')", "select approx_count_distinct(id), percentile(id, 0.5) from five",
])
def test_answered(five, sql):
    got = gateway.query(five, sql, seconds=60)
    assert got.ok and got.rows, got.error


def test_a_given_list_of_relations(five):
    assert gateway.query(five, "select * from FIVE", seconds=60, relations=["five"]).ok
    assert not gateway.query(five, "select * from hidden", seconds=60, relations=["five"]).ok
    assert not gateway.query(five, "select * from (with hidden as (select 1) select * from hidden) union all select * from hidden", seconds=60, relations=["five"]).ok
    assert gateway.query(five, "with a as (select * from five) select * from a", seconds=60, relations=["five"]).ok


def test_bytes_that_are_json_are_inlined(five):
    got = gateway.query(five, "select cast('{\"a\": [1, null]}' as binary) as j, cast('plain {' as binary) as t, cast(null as binary) as n, cast('12' as binary) as k, '{\"s\":1}' as s", seconds=60)
    assert got.rows == ({"j": {"a": [1, None]}, "t": "plain {", "n": None, "k": 12, "s": '{"s":1}'},), got.error
