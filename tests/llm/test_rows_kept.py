"""No stage loses, doubles or rewrites a row: repeated ids with other texts, missing ids, and columns of any name."""

from collections import Counter

import numpy as np
import pytest

from marlstone.llm import common, exact_dedup, mixing, near_dedup
from marlstone.llm import quality_rules as Q
from marlstone.operators import skew

CLASHES = "kept string, rule string, n_lines string, base_failed string, row string, counts string, _size string, _id string, _turn string, _at string, _words string, gone_id string, gone_text string, narrow_id string, row_number string, reading_at string, parts string, name string"
SCHEMA = f"doc_id long, text string, source string, {CLASHES}"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, *[f"{i}-{k}" for k in range(CLASHES.count(",") + 1)]) for i, t, s in rows], SCHEMA).repartition(3)


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def test_exact_copies_go_by_id_and_text(spark):
    docs = frame(spark, [(1, "a", "s"), (2, "A", "s"), (1, "b", "s"), (3, "b", "s"), (1, "c", "s"), (None, "c", "s"), (None, "d", "s"), (7, None, "s"), (8, "", "s"), (9, "e", "s"), (9, "e", "s")])
    out = exact_dedup.drop_copies(docs)
    assert out.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter([(2, "A"), (3, "b"), (1, "c"), (None, "d"), (8, ""), (9, "e"), (9, "e")])
    assert rows_of(out) <= rows_of(docs) and exact_dedup.drop_copies(docs.where("false")).count() == 0


def test_near_copies_go_by_their_own_text(spark):
    words = [f"w{i}" for i in range(60)]
    base, near, other = " ".join(words), " ".join(words[:-1] + ["x"]), " ".join(reversed(words))
    docs = frame(spark, [(0, base, "s"), (1, near, "s"), (1, other, "s"), (1, near, "s"), (5, other.upper(), "s"), (None, base, "s"), (6, "", "s"), (6, None, "s"), (7, "lone text", "s")])
    out = near_dedup.drop_near_copies(docs)
    assert out.columns == docs.columns and rows_of(out) <= rows_of(docs)
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter([(0, base), (1, other), (None, base), (6, ""), (6, None), (7, "lone text")])
    single = docs.where("doc_id is null or doc_id in (0, 5, 7)")
    assert rows_of(near_dedup.drop_near_copies(single)) == rows_of(single) and near_dedup.drop_near_copies(docs.where("false")).count() == 0


def test_every_row_is_mixed_for_itself(spark):
    rows = [(1, "a b", "x"), (1, "a b c d", "x"), (2, "a b c d e f", "x"), (None, "n m", "y"), (None, "n m", "y"), (None, "k", "y"), (3, None, "y"), (4, "q r s", None)] + [(10 + i, "u v w", "x") for i in range(20)]
    docs = frame(spark, rows)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and set(rows_of(out)) <= set(rows_of(docs))
    words = Counter()
    for r in out.collect():
        words[r.source] += len(r.text.split())
    taken, most = Counter(), Counter()
    source = {(i, len((t or "").split())): s for i, t, s in rows}
    for r in mixing.mix(docs).collect():
        taken[source[r.doc_id, r.size]] += r.taken
        most[source[r.doc_id, r.size]] = max(most[source[r.doc_id, r.size]], r.size)
    assert all(abs(words[s] - taken[s]) <= most[s] / 2 for s in taken)


def test_good_rows_keep_their_own_columns(spark):
    good = [(i, "plain words that say something new " + " ".join(f"w{i}x{j}" for j in range(80)), "s") for i in range(30)]
    docs = frame(spark, [*good, (3, good[3][1], "s"), (None, good[0][1], "s"), (99, "short", "s"), (98, None, "s")])
    out = Q.keep_good(docs, spark.createDataFrame([(i, 1) for i in range(30)], "doc_id long, quality int"))
    assert out.columns == docs.columns and rows_of(out) == rows_of(docs.where("doc_id is null or doc_id < 90"))


def test_rules_are_fitted_on_each_id_once(spark):
    docs = frame(spark, [(i, f"a{i} " * 60, "s") for i in range(5)] + [(1, "b " * 60, "s")] * 50)
    sampled = common.sampled_texts(docs, spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, label int"), 4).collect()
    assert {r.doc_id: r.text for r in sampled} == {i: f"a{i} " * 60 for i in range(4)} and len(sampled) == 4


@pytest.mark.parametrize("seed", range(2))
def test_many_sources_and_many_copies(spark, monkeypatch, seed):
    from .test_mixing_and_pipeline import frame as plain
    from .test_mixing_and_pipeline import wanted_targets

    monkeypatch.setattr(common, "RANGE_ROWS", 7)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 20)
    rng = np.random.default_rng(seed)
    rows = [(i, "w " * int(rng.integers(0, 30)), f"s{int(rng.integers(60))}") for i in range(600)] + [(None, "same text of five words", "s1")] * 300 + [(7, "t", None)] * 50
    got = mixing.mix(plain(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = wanted_targets({s: sizes[s] for _, _, s in rows})
    by_size = {n: want[s] for s, n in sizes.items()}
    assert all(abs(r.target - by_size[r.source_size]) < 1e-6 or r.target in [pytest.approx(want[s]) for s in want if sizes[s] == r.source_size] for r in got)
    assert sum(r.taken for r in got) == pytest.approx(sum(want.values()), abs=len(want))
    again = mixing.mix(plain(spark, rows).repartition(5)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert sorted(map(repr, mixing.mix(plain(spark, rows)).collect())) == sorted(map(repr, got))


def test_weights_and_schedules_are_parameters(spark):
    from .test_mixing_and_pipeline import frame as plain

    rows = [(i, "a b c d", "x" if i % 2 else "y") for i in range(400)]
    late = ((0.0, 0.0), (0.5, 0.0), (0.75, 2.0), (1.0, 2.0))
    got = mixing.mix(plain(spark, rows), weights=(1, 1), schedules=(((0, 1), (1, 1)), late)).collect()
    place = {r.doc_id: r.position for r in got}
    assert all(r.target == 800 and r.taken == 4 for r in got)
    assert min(place[i] for i in place if not i % 2) >= 0.5 and min(place[i] for i in place if i % 2) == 0
    # the share of the demand that stands before a position is the schedule's integral up to it
    integral = lambda t: 0 if t < 0.5 else (t - 0.5) ** 2 * 4 / 0.75 if t < 0.75 else (0.25 + 2 * (t - 0.75)) / 0.75
    for n, t in enumerate(sorted(place[i] for i in place if not i % 2)):
        assert integral(t) == pytest.approx(n / 200, abs=1e-9)
    for bad in (((0, 1),), ((0, 1), (0.5, 1)), ((0, 0), (1, 0)), ((0, -1), (1, 3))):
        with pytest.raises(ValueError):
            mixing._pieces(bad)


def test_owners_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "OWNER_ROWS", 5)
    docs = frame(spark, [(i, f"t{i % 40}", "s") for i in range(120)])
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_groups(docs).collect()}
    assert got == {i: (80 + i % 40, 3) for i in range(120)}


def test_stashes_can_be_removed(spark):
    import os

    a, b = common.stash(spark.range(3), "one"), common.stash(spark.range(4), "two")
    path = lambda df: df._stashed.removeprefix("file:")
    common.discard(a, a, spark.range(1))
    assert not os.path.exists(path(a)) and b.count() == 4
    mark = common.written()
    c = common.stash(spark.range(2), "three")
    common.cleanup(spark, keep=c, since=mark)
    assert b.count() == 4 and c.count() == 2
    common.cleanup(spark, since=mark)
    assert b.count() == 4 and not os.path.exists(path(c))
    common.cleanup(spark)
    assert not os.path.exists(path(b)) and not common._WRITTEN


def test_a_hot_key_is_dealt_over_tasks(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(skew, "HOT_ROWS", 100)
    many = spark.range(3000).select(F.col("id"), F.when(F.col("id") < 2000, 7).otherwise(F.col("id")).cast("long").alias("k"))
    counts = many.groupBy("k").count()
    hot = skew.hot_keys(counts, "k", "count", 3000)
    assert [tuple(r) for r in hot.collect()] == [(7, 20)]
    got = skew.salted_join(many, counts, "k", hot, ["id"])
    assert got.count() == 3000 and got.where("k = 7 and count = 2000").count() == 2000


def test_a_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 50)
    r = np.random.default_rng(0)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(1500):
        copy = list(base)
        copy[int(r.integers(90))] = f"z{i}"
        rows.append((i, " ".join(copy), "s"))
    rows += [(2000 + i, " ".join(f"q{i}x{j}" for j in range(40)), "s") for i in range(30)]
    got = {x.doc_id: x.component_id for x in near_dedup.near_components(frame(spark, rows)).collect()}
    assert got == {i: 0 if i < 2000 else i for i, _, _ in rows}
