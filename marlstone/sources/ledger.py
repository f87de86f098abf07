"""Writes as frames: run events, identities, snapshots, taxonomy and registry. Each gives the rows to append or the new state.

Parquet has no MERGE, so an insert that yields to what is there is an anti-join, and an update is a fold of events. New
ids continue after the greatest one by ranks within hash ranges, so that no single task numbers all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.functions import expr as X

#: Hash ranges that new ids are counted in: a table of so many starts is broadcast, and 10,000,000,000 rows are some 150,000 in each.
RANGES = 65_536


def numbered(rows: DataFrame, keys: Sequence[str], after: DataFrame, id_column: str = "id") -> DataFrame:
    """``rows`` with ids from the greatest of ``after`` (one row, column m) on, the same for the same keys in every run."""
    ranged = rows.withColumn("_r", F.pmod(F.xxhash64(*keys), F.lit(RANGES)))
    starts = ranged.groupBy("_r").count().withColumn("_before", F.sum("count").over(W.orderBy("_r")) - F.col("count")).select("_r", "_before")  # at most RANGES rows
    ranged = ranged.withColumn("_n", F.row_number().over(W.partitionBy("_r").orderBy(*keys)))
    return ranged.join(F.broadcast(starts), "_r").crossJoin(F.broadcast(after)).withColumn(id_column, F.col("m") + F.col("_before") + F.col("_n")).drop("_r", "_n", "_before", "m")


def greatest_id(df: DataFrame, id_column: str = "id") -> DataFrame:
    return df.agg(F.coalesce(F.max(id_column), F.lit(0)).cast("long").alias("m"))


def fold_runs(events: DataFrame) -> DataFrame:
    """Current state of each run from its events: start and the last status, with what came with it."""
    return events.groupBy("run_id", "company_id").agg(F.min("at").alias("started_at"), F.max_by(F.struct("status", "error_message", "postings_count", F.when(F.col("status") != "in_progress", F.col("at")).alias("completed_at")), F.struct("at", "seq")).alias("l")).select("run_id", "company_id", "started_at", "l.*")


def upsert_identities(existing: DataFrame, seen: DataFrame, greatest: DataFrame | None = None) -> DataFrame:
    """job_postings after ``seen`` (company_id, source_url, source_id, fetched_at): known ones only take the newest source_id,
    first_seen_at and id stay; new ones get ids after the greatest of ``existing``, or after ``greatest`` (one row, m)."""
    key = ["company_id", "source_url"]
    new = seen.groupBy(*key).agg(F.max_by("source_id", F.struct("fetched_at", "source_id")).alias("new_source_id"), F.min("fetched_at").alias("seen_at"))
    kept = existing.join(new, key, "left").select("id", *key, F.coalesce("new_source_id", "source_id").alias("source_id"), "first_seen_at")
    added = new.join(existing.select(*key), key, "left_anti").select(*key, F.col("new_source_id").alias("source_id"), F.col("seen_at").alias("first_seen_at"))
    return kept.unionByName(numbered(added, key, greatest_id(existing) if greatest is None else greatest))


def snapshot_rows(postings: DataFrame, identities: DataFrame, run_of: DataFrame) -> DataFrame:
    """Rows to append to the snapshot log: sound postings with their identity's id and their board's run. A row without
    url, source id or raw data aborts its company: none of that company's rows are given."""
    broken = postings.groupBy("company_id").agg(F.bool_and((F.coalesce("source_url", F.lit("")) != "") & (F.coalesce("source_id", F.lit("")) != "") & (F.coalesce("raw_data", F.lit("")) != "")).alias("ok")).where("ok").select("company_id")
    out = postings.join(broken, "company_id", "left_semi").join(run_of, "company_id").join(identities.select("company_id", "source_url", F.col("id").alias("job_posting_id")), ["company_id", "source_url"])
    return out.drop("ats", "board_token")


def get_or_create(existing: DataFrame, wanted: DataFrame, at: Column) -> DataFrame:
    """Terms (id, slug, name, created_at) after ``wanted`` (slug, name): known slugs keep name and date; of new ones the least name wins."""
    new = wanted.groupBy("slug").agg(F.min("name").alias("name")).join(existing.select("slug"), "slug", "left_anti").withColumn("created_at", at)
    return existing.unionByName(numbered(new, ["slug"], greatest_id(existing)).select(*existing.columns))


def terms_by_slug(terms: DataFrame) -> DataFrame:
    """id, slug, name in the order of slugs."""
    return terms.select("id", "slug", "name").orderBy("slug")


def new_terms(before: DataFrame, after: DataFrame, uses: DataFrame | None = None) -> DataFrame:
    """Terms of ``after`` that ``before`` doesn't have; with ``uses`` (slug, place, posting_id) also source_posting, the posting
    whose result came first of those that name the term, 0 if none does."""
    new = after.join(before.select("slug"), "slug", "left_anti")
    if uses is None:
        return new
    first = uses.groupBy("slug").agg(F.min_by("posting_id", F.struct("place", "posting_id")).alias("source_posting"))
    return new.join(first, "slug", "left").withColumn("source_posting", F.coalesce("source_posting", F.lit(0)))


def link(existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """Pairs to append to a join table: those not there yet, each once."""
    return wanted.select(*existing.columns).dropDuplicates().join(existing, existing.columns, "left_anti")


def add_companies(existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, name, ats, board_token, inserted for each wanted (ats, board_token): the known row untouched, or a new one."""
    key = ["ats", "board_token"]
    one = wanted.groupBy(*key).agg(F.min("name").alias("name"))
    new = numbered(one.join(existing.select(*key), key, "left_anti"), key, greatest_id(existing)).withColumn("inserted", F.lit(True))
    return existing.join(one.select(*key), key, "left_semi").select("id", "name", *key, F.lit(False).alias("inserted")).unionByName(new.select("id", "name", *key, "inserted"))


def fold_registry(existing: DataFrame, records: DataFrame) -> DataFrame:
    """The registry by normalized name: first name and first_seen_at stay, address, platform, reason and last_checked_at are the latest."""
    rows = existing.select("name", "url", "detected_platform", "reason", "first_seen_at", "last_checked_at").unionByName(records.select("name", "url", "detected_platform", "reason", F.col("at").alias("first_seen_at"), F.col("at").alias("last_checked_at")))
    rows = rows.withColumn("norm", X.normalize_name(F.col("name")))
    latest = F.max_by(F.struct("url", "detected_platform", "reason"), F.struct("last_checked_at", "url", "reason"))
    return rows.groupBy("norm").agg(F.min_by("name", F.struct("first_seen_at", "name")).alias("name"), F.min("first_seen_at").alias("first_seen_at"), F.max("last_checked_at").alias("last_checked_at"), latest.alias("l")).select("norm", "name", "l.*", "first_seen_at", "last_checked_at")


def rename_terms(existing: DataFrame, names: DataFrame) -> DataFrame:
    """Names by slug replaced; slugs untouched."""
    return existing.join(names.select("slug", F.col("name").alias("_new")), "slug", "left").withColumn("name", F.coalesce("_new", "name")).select(*existing.columns)


def orphans(child: DataFrame, parent: DataFrame, column: str, parent_column: str = "id") -> DataFrame:
    """Rows whose reference leads nowhere: what a foreign key would refuse."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(parent_column).alias(column)), column, "left_anti")


def outcome_tally(outcomes: DataFrame) -> DataFrame:
    """Counts by outcome, cancelled ones left out, and how many of each had been classified before."""
    return outcomes.where("outcome <> 'cancelled'").groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.count_if("was_classified").alias("again"))


def failures(outcomes: DataFrame) -> DataFrame:
    return outcomes.where(F.col("outcome").isin("json_failed", "validation_failed"))


def write_failures(outcomes: DataFrame, path: str) -> None:
    """Appends the failed outcomes as JSON lines."""
    failures(outcomes).write.mode("append").json(path)


def append(rows: DataFrame, path: str) -> None:
    """Appends rows to a log; what is there is never changed."""
    rows.write.mode("append").parquet(path)
