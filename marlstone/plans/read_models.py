"""Read models: open postings, their display and terms, fetch health, selection. Each is (tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.latest import latest_per_key, top


def latest_successful_runs(runs: DataFrame) -> DataFrame:
    """fetch_run_id, company_id, started_at of each company's latest successful run (greatest id among ties)."""
    done = runs.where("status = 'success'").select("company_id", F.col("id").alias("fetch_run_id"), "started_at")
    return latest_per_key(done, ["company_id"], ["started_at", "fetch_run_id"]).select("fetch_run_id", "company_id", "started_at")


def latest_runs(runs: DataFrame) -> DataFrame:
    """Each company's latest run of any status; companies without runs are absent."""
    return latest_per_key(runs, ["company_id"], ["started_at", "id"])


def open_postings(runs: DataFrame, snapshots: DataFrame, postings: DataFrame) -> DataFrame:
    """job_posting_id, fetch_run_id of postings seen in their company's latest successful run.

    A snapshot without a run never qualifies; the run's company and the posting's must be the same.
    """
    latest = latest_successful_runs(runs).select("fetch_run_id", "company_id")
    # lines of other runs are gone before the snapshots are dealt for a join
    seen = snapshots.where("fetch_run_id is not null").join(latest.select("fetch_run_id"), "fetch_run_id", "left_semi").select("fetch_run_id", "job_posting_id")
    return seen.join(latest, "fetch_run_id").join(postings.select(F.col("id").alias("job_posting_id"), "company_id"), ["job_posting_id", "company_id"]).select("job_posting_id", "fetch_run_id").distinct()


def current_classifications(classifications: DataFrame, key: str = "job_posting_id") -> DataFrame:
    return latest_per_key(classifications.where(F.col(key).isNotNull()), [key], ["classified_at", "id"])


def workplace(reported: Column, raw_data: Column, location_text: Column) -> Column:
    """struct(workplace_type, workplace_source): what the source reports, else what its raw JSON says, else its location text.

    The raw JSON is parsed once. Only a JSON array of metadata counts; a false boolean speaks against 'remote' in the
    location text, and against nothing else. The source is null with the type.
    """
    parsed = F.try_parse_json(F.when(reported.isNull(), raw_data))
    text = lambda v, path: F.try_variant_get(v, path, "string")
    meta = F.coalesce(F.try_variant_get(parsed, "$.metadata", "array<variant>"), F.expr("cast(array() as array<variant>)"))
    slots = lambda e: F.try_variant_get(e, "$.value", "array<string>")
    named = lambda name: F.filter(meta, lambda e: text(e, "$.name") == name)
    value_is = lambda name, v: F.exists(named(name), lambda e: F.coalesce(text(e, "$.value") == v, F.lit(False)))
    # of several location types the greatest text, each scalar or element by element
    kinds = F.flatten(F.transform(named("Location Type"), lambda e: F.coalesce(slots(e), F.array(text(e, "$.value")))))
    kind = F.array_max(F.filter(kinds, lambda x: x.isNotNull()))
    places = F.flatten(F.transform(named("Job Posting Location"), lambda e: F.coalesce(slots(e), F.expr("cast(array() as array<string>)"))))
    says = lambda pattern: F.exists(places, lambda x: F.coalesce(x.rlike(pattern), F.lit(False)))
    telecommuting = text(parsed, "$.telecommuting")
    raw = (
        F.when((telecommuting == "true") | value_is("Remote", "true"), F.lit("remote"))
        .when(kind.rlike("(?i)^on-site"), F.lit("onsite")).when(kind.rlike("(?i)^remote"), F.lit("remote")).when(kind.rlike("(?i)^hybrid"), F.lit("hybrid"))
        .when(says(r"(?i)\bremote\b"), F.lit("remote")).when(says(r"(?i)\b(office|headquarters|hq)\b"), F.lit("onsite"))
    )
    denied = F.coalesce(telecommuting == "false", F.lit(False)) | value_is("Remote", "false")
    place = F.regexp_replace(F.trim(F.regexp_replace(F.translate(location_text, "\u00a0", " "), r"\s+", " ")), "(?i)remote[- ]friendly", "")
    told = F.when(place.rlike(r"(?i)\bhybrid\b"), F.lit("hybrid")).when(place.rlike(r"(?i)\bremote\b") & ~denied, F.lit("remote")).when(place.rlike(r"(?i)\bon[- ]?site\b"), F.lit("onsite"))
    tier = lambda value, source: F.when(value.isNotNull(), F.struct(value.alias("workplace_type"), F.lit(source).alias("workplace_source")))
    none = F.struct(F.lit(None).cast("string").alias("workplace_type"), F.lit(None).cast("string").alias("workplace_source"))
    return F.coalesce(tier(reported, "ats"), tier(raw, "raw_data"), tier(told, "location_text"), none)


SNAPSHOT_SHOWN = ("title", "location_text", "workplace_type", "raw_data")


def open_display(runs: DataFrame, snapshots: DataFrame, postings: DataFrame, companies: DataFrame, classifications: DataFrame, snapshot_order: Sequence[str] = ("fetched_at", "id"), classification_key: str = "job_posting_id") -> DataFrame:
    """One row for each open posting: its content from the run that shows it open, its workplace and its current classification."""
    opened = open_postings(runs, snapshots, postings)
    started = latest_successful_runs(runs).select("fetch_run_id", F.col("started_at").alias("run_started_at"))
    shown = snapshots.join(started.select("fetch_run_id"), "fetch_run_id", "left_semi").join(opened, ["job_posting_id", "fetch_run_id"], "left_semi")
    shown = latest_per_key(shown, ["job_posting_id"], list(snapshot_order)).select("job_posting_id", "fetch_run_id", "fetched_at", *SNAPSHOT_SHOWN)
    out = shown.join(started, "fetch_run_id").join(postings.select(F.col("id").alias("job_posting_id"), *{"company_id", "first_seen_at", *({classification_key} - {"job_posting_id"})}), "job_posting_id")
    out = out.join(companies.select(F.col("id").alias("company_id"), F.col("name").alias("company_name")), "company_id")
    current = current_classifications(classifications, classification_key).select(classification_key, F.col("id").alias("classification_id"), "seniority", "classified_at")
    out = out.join(current, classification_key, "left").withColumn("_w", workplace(F.col("workplace_type"), F.col("raw_data"), F.col("location_text")))
    return out.select("job_posting_id", "company_id", "company_name", "fetch_run_id", "run_started_at", "fetched_at", "first_seen_at", "title", "location_text", F.col("_w.workplace_type").alias("workplace_type"), F.col("_w.workplace_source").alias("workplace_source"), "classification_id", "seniority", "classified_at")


def open_taxonomy(display: DataFrame, terms: DataFrame) -> DataFrame:
    """job_posting_id, term_kind, slug, name of the current classification's terms; a term that two roles share comes once."""
    return display.select("job_posting_id", "classification_id").join(terms, "classification_id").select("job_posting_id", "term_kind", "slug", "name").distinct()


def all_terms(**kinds: DataFrame) -> DataFrame:
    """Terms of several kinds as one frame: (classification_id, term_kind, slug, name)."""
    out = None
    for kind, df in kinds.items():
        part = df.select("classification_id", F.lit(kind).alias("term_kind"), "slug", "name")
        out = part if out is None else out.unionByName(part)
    return out


def fetch_health(runs: DataFrame, snapshots: DataFrame, postings: DataFrame, classifications: DataFrame, classification_skills: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """One row of counts; windows are strict (later than as_of less the days). Distinct counts are exact."""
    since = as_of - F.make_dt_interval(F.lit(days))
    recent = F.col("started_at") > since
    run = runs.agg(F.count_if(recent).alias("runs_started"), F.count_if(recent & (F.col("status") == "success")).alias("runs_succeeded"), F.count_if(recent & (F.col("status") == "failed")).alias("runs_failed"), F.min("started_at").alias("first_run_at"), F.max("started_at").alias("last_run_at"))
    parts = [snapshots.agg(F.count(F.lit(1)).alias("snapshots_harvested")), postings.agg(F.count(F.lit(1)).alias("postings_tracked")), open_postings(runs, snapshots, postings).agg(F.count(F.lit(1)).alias("postings_open"))]
    parts += [classification_skills.agg(F.count_distinct("skill").alias("skills_seen")), classifications.agg(F.count_distinct("job_posting_id").alias("postings_classified"))]
    for p in parts:  # one row each
        run = run.crossJoin(F.broadcast(p))
    return run


def coverage(health: DataFrame, days: int = 7) -> DataFrame:
    """Shares of the counts; a ratio over nothing is 0, and the error rate counts concluded runs only."""
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0)).cast("double")
    return health.select(
        share(F.col("postings_classified"), F.col("postings_tracked")).alias("classified_share"), share(F.col("postings_open"), F.col("postings_tracked")).alias("open_share"),
        (F.col("runs_started") / days).alias("runs_per_day"), share(F.col("runs_failed"), F.col("runs_failed") + F.col("runs_succeeded")).alias("error_rate"),
    )


def open_page(display: DataFrame, rows: int = 500) -> DataFrame:
    return top(display, rows, F.col("run_started_at").desc_nulls_last(), F.col("job_posting_id").desc())


def latest_descriptions(snapshots: DataFrame, order: Sequence[str] = ("fetched_at", "id")) -> DataFrame:
    """job_posting_id, description_text of each posting's latest snapshot; a posting whose latest has none is dropped, not filled from an older one."""
    return latest_per_key(snapshots, ["job_posting_id"], list(order)).where("description_text is not null").select("job_posting_id", "description_text")


def names(title: Column, description: Column, name_like: str) -> Column:
    """Whether a title or description has the text anywhere, with % and _ as wild cards."""
    pattern = F.lit(f"%{name_like}%")
    return F.coalesce(F.ilike(title, pattern), F.lit(False)) | F.ilike(description, pattern)


def selection(postings: DataFrame, snapshots: DataFrame, companies: DataFrame, classifications: DataFrame | None, name_like: str = "", newest_first: bool = False, n: int | None = 10, order: Sequence[str] = ("fetched_at", "id"), classification_key: str = "job_posting_id") -> DataFrame:
    """Postings to classify with their latest title and description: unclassified ones, or all if ``classifications`` is
    None (forced). name_like is matched anywhere in title or description; empty is no filter. ``classification_key``: what
    classifications and postings share, if that isn't the posting's id."""
    latest = latest_per_key(snapshots, ["job_posting_id"], list(order)).select("job_posting_id", "title", "description_text")
    out = postings.select(F.col("id").alias("job_posting_id"), "company_id", "first_seen_at", *({classification_key} - {"job_posting_id"}))
    if classifications is not None:
        out = out.join(classifications.select(classification_key).distinct(), classification_key, "left_anti")
    out = out.join(latest, "job_posting_id").join(companies.select(F.col("id").alias("company_id"), F.col("name").alias("company_name")), "company_id").where("description_text is not null")
    if name_like:
        out = out.where(names(F.col("title"), F.col("description_text"), name_like))
    out = out.select("job_posting_id", "company_name", F.coalesce("title", F.lit("")).alias("title"), "description_text", "first_seen_at")
    first = F.col("first_seen_at").desc() if newest_first else F.col("first_seen_at").asc()
    return out if n is None else top(out, n, first, F.col("job_posting_id"))


def preview(selected: DataFrame, count: int = 10, sort: str = "oldest_first", shown: int = 20) -> DataFrame:
    """The first ``count`` selected postings, at most ``shown`` of them, each with the number that would be taken.

    Arguments out of range are refused: count 1 to 100, sort oldest_first or newest_first.
    """
    if not 1 <= count <= 100 or sort not in ("oldest_first", "newest_first"):
        raise ValueError("count must be 1 to 100, sort oldest_first or newest_first")
    first = F.col("first_seen_at").desc() if sort == "newest_first" else F.col("first_seen_at").asc()
    taken = top(selected, count, first, F.col("job_posting_id"))
    total = taken.agg(F.count(F.lit(1)).alias("selected_count"))
    return top(taken, shown, first, F.col("job_posting_id")).crossJoin(F.broadcast(total))  # one row


def run_summary(runs: DataFrame, companies: DataFrame, supported: tuple[str, ...]) -> DataFrame:
    """attempted, succeeded, failed, aborted, unsupported, conserved: one row over each company's latest run."""
    latest = latest_runs(runs).join(companies.select(F.col("id").alias("company_id"), "ats"), "company_id")
    known = F.col("ats").isin(*supported)
    out = latest.agg(F.count_if(known).alias("attempted"), F.count_if(known & (F.col("status") == "success")).alias("succeeded"), F.count_if(known & (F.col("status") == "failed")).alias("failed"), F.count_if(known & (F.col("status") == "in_progress")).alias("aborted"), F.count_if(~known).alias("unsupported"))
    return out.withColumn("conserved", F.col("succeeded") + F.col("failed") + F.col("aborted") == F.col("attempted"))
