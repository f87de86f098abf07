"""Matches by trigrams: equal names are compared once, and each of their companies counts."""

from pyspark.sql import functions as F

from marlstone.operators import resolve


def test_equal_names_are_compared_once(spark, monkeypatch):
    compared = []
    plain = resolve.fuzzy_matches
    monkeypatch.setattr(resolve, "fuzzy_matches", lambda a, b, *more: compared.append((a.count(), b.count())) or plain(a, b, *more))
    none = F.lit(None).cast("string")
    companies = spark.range(1, 61).select("id", F.when(F.col("id") % 3 == 0, "Acme Tools").when(F.col("id") % 3 == 1, "Acme Toolz").otherwise("Else").alias("name"), none.alias("ats"), none.alias("board_token"), none.alias("careers_page_url"), F.lit(False).alias("has_recent_snapshot"))
    cand = spark.range(1, 41).select(F.col("id").alias("input_index"), F.lit("Acme Toolss").alias("name"), none.alias("ats"), none.alias("board_token"), none.alias("careers_url"))
    found = {r.input_index: r for r in resolve.verdicts(cand, companies).collect()}
    assert {(r.verdict, r.match_kind, r.match_count, r.matched_id) for r in found.values()} == {("stale", "fuzzy_name", 40, 3)} and len(found) == 40
    shown = resolve.matches(cand, companies).where("input_index = 5").collect()
    assert sorted((r.id, r.match_count) for r in shown) == [(3, 40), (6, 40), (9, 40)]
    assert compared == [(1, 3), (1, 3)]
