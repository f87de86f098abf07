"""Captured job-board payloads to postings: six source formats into one schema.

A board is all or nothing: one job that breaks its source's rules rejects the board's capture. Rows come out with the
capture's keys, an ``issue`` that is null for sound jobs, and the columns of a posting. Raw JSON of each job is kept byte
by byte as the source wrote it; its fields are read from a variant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone import schemas
from marlstone.functions import expr as X
from marlstone.functions.slices import json_elements
from marlstone.functions.text import html_to_text

KEYS = ("company_id", "ats", "board_token", "fetched_at")
#: Where a body has its jobs; jobs on a full page of the paged sources (0: the source isn't paged); pages at which those stop, and from which they warn.
ENVELOPES = {"greenhouse": "jobs", "lever": None, "ashby": "jobs", "workday": "jobPostings", "workable": "jobs", "gem": None}
#: What of a job is read, in one pass over it (a value of another kind is null), and what of it decides whether the job is sound.
READ = {
    "greenhouse": "id long, first_published string, updated_at string, title string, absolute_url string, location struct<name: string>, departments array<struct<name: string>>, content string",
    "lever": "id string, hostedUrl string, text string, createdAt long, salaryRange struct<min: double, max: double, currency: string, interval: string>, categories struct<allLocations: array<string>, location: string, department: string, team: string, commitment: string>, workplaceType string, descriptionPlain string, description string",
    "ashby": "id string, jobUrl string, publishedAt string, title string, department string, team string, location string, secondaryLocations array<struct<location: string, address: struct<postalAddress: struct<addressLocality: string, addressRegion: string, addressCountry: string>>>>, employmentType string, workplaceType string, descriptionHtml string",
    "workday": "externalPath string, externalUrl string, postedOn string, title string, locationsText string",
    "workable": "shortcode string, url string, application_url string, title string, department string, city string, state string, country string, employment_type string, published_on string, created_at string",
    "gem": "id string, absolute_url string, first_published_at string, updated_at string, title string, location struct<name: string>, offices array<struct<location: struct<name: string>>>, departments array<struct<name: string>>, content_plain string, content string, location_type string, employment_type string",
}
JUDGED = {
    "greenhouse": "id long, first_published string, updated_at string", "lever": "id string, hostedUrl string", "ashby": "id string, jobUrl string, publishedAt string",
    "workday": "externalPath string", "workable": "shortcode string, url string, application_url string", "gem": "id string, absolute_url string, first_published_at string, updated_at string",
}
PAGE = {"lever": 100, "workday": 20}
MOST_PAGES, WARN_PAGES, WARN_JOBS = 1000, 500, 1000
API = {"greenhouse": "https://boards-api.greenhouse.io/v1/boards"}


def _by_source(values: dict[str, Column | None], otherwise: Column | None = None) -> Column:
    """The value of the row's source, null (or ``otherwise``) where it has none."""
    out = F
    for ats, value in values.items():
        if value is not None:
            out = out.when(F.col("ats") == ats, value)
    return (F.lit(None) if otherwise is None else otherwise) if out is F else out if otherwise is None else out.otherwise(otherwise)


def pages(payloads: DataFrame, raw: bool = False, read: dict[str, str] = READ) -> DataFrame:
    """The pages that count, with their jobs: ``payloads`` of known sources with _jobs (null if the body isn't the source's
    envelope; an array whose elements have a struct for each source, null but for the page's own: what ``read`` names of a job),
    with ``raw`` also _raw, the text of each. A body is parsed once, whatever its source.

    A paged source is read up to its first short page; Workday's also ends where its pages have as many jobs as it says in
    total. What was captured beyond isn't the board's. _whole is false for a capture without such an end, or with a page missing
    before it: pages are numbered from 0, so the page that ends a whole capture has its own number of pages before it.
    """
    body = F.try_parse_json(F.when(F.octet_length("body") <= schemas.BODY_LIMIT, F.col("body")))
    known = payloads.where(F.col("ats").isin(*ENVELOPES)).withColumn("_body", body)
    own = lambda ats: lambda job: F.struct(*((job if k == ats else F.lit(None).cast(f"struct<{v}>")).alias(k) for k, v in read.items()))
    at = {ats: F.transform(F.try_variant_get("_body", "$" if path is None else f"$.{path}", f"array<struct<{read[ats]}>>"), own(ats)) for ats, path in ENVELOPES.items()}
    found = known.withColumn("_jobs", _by_source(at)).withColumn("_total", F.try_variant_get("_body", "$.total", "long"))
    paged = found.where(F.col("ats").isin(*(k for k, v in PAGE.items() if v))).groupBy(*KEYS, "page_no").agg(F.sum(F.coalesce(F.size("_jobs"), F.lit(0))).alias("n"), F.max("_total").alias("total"))
    chain = W.partitionBy(*KEYS).orderBy("page_no")  # as many rows as a board has pages
    so_far = F.sum("n").over(chain)
    ends = (F.col("n") < _by_source({k: F.lit(v) for k, v in PAGE.items()})) | ((F.col("ats") == "workday") & (so_far >= F.coalesce("total", F.lit(0))))
    place = F.struct("page_no", (F.col("page_no") == F.row_number().over(chain) - 1).alias("whole"))
    last = paged.withColumn("_end", F.when(ends, place)).groupBy(*KEYS).agg(F.min("_end").alias("_end")).select(*KEYS, F.col("_end.page_no").alias("_last"), F.coalesce("_end.whole", F.lit(False)).alias("_whole"))
    if raw:
        found = found.withColumn("_raw", json_elements(F.when(F.size("_jobs") > 0, F.col("body")), _by_source({k: F.lit(v) for k, v in ENVELOPES.items()}).cast("string")))
    return found.drop("_body", "_total").join(last, list(KEYS), "left").where("_last is null or page_no <= _last").drop("_last")


def field(path: str) -> Column:
    """What READ has of a job under a path: its source, then names; [0] is an array's first element."""
    head, *rest = path.split("[0].")
    return F.col(f"job.{head}") if not rest else F.get(F.col(f"job.{head}"), F.lit(0))[rest[0]]


def text(path: str) -> Column:
    return X.blank_to_null(field(path))


def _strict(path: str) -> tuple[Column, Column]:
    """An instant that must be one if it is there: (value, broken)."""
    raw = text(path)
    return X.instant(raw), raw.isNotNull() & X.instant(raw).isNull()


def _list_of(c: Column) -> Column:
    return F.when(c.isNotNull(), F.array(c))


def _named(array: str, name) -> Column:
    """What ``name`` gives for each element of an array, nulls left out; empty if there is no array."""
    return F.coalesce(F.filter(F.transform(field(array), name), lambda x: x.isNotNull()), F.expr("cast(array() as array<string>)"))


# Each source gives the columns of a posting, the HTML of its description as "html", and what is wrong with a job as "issue".


def greenhouse() -> dict[str, Column]:
    number = field("greenhouse.id")
    (first, bad1), (changed, bad2) = _strict("greenhouse.first_published"), _strict("greenhouse.updated_at")
    source_id = number.cast("string")
    return {
        "issue": F.when(F.coalesce(number, F.lit(0)) == 0, "missing id").when(bad1 | bad2, "malformed time"),
        "source_id": source_id, "source_url": F.concat_ws("/", F.lit(API["greenhouse"]), X.path_escape(F.col("board_token")), F.lit("jobs"), source_id), "title": text("greenhouse.title"), "job_url": text("greenhouse.absolute_url"),
        "location_texts": _list_of(text("greenhouse.location.name")), "department": text("greenhouse.departments[0].name"), "html": text("greenhouse.content"), "source_first_published_at": first, "source_last_modified_at": changed,
    }


def lever() -> dict[str, Column]:
    made = X.epoch_ms(field("lever.createdAt"))
    pay = X.pay(field("lever.salaryRange.min"), field("lever.salaryRange.max"), field("lever.salaryRange.currency"), field("lever.salaryRange.interval"))
    places = field("lever.categories.allLocations")  # an empty list is one, a missing one isn't
    return {
        "issue": F.when(text("lever.id").isNull(), "missing id").when(text("lever.hostedUrl").isNull(), "missing url"),
        "source_id": text("lever.id"), "source_url": text("lever.hostedUrl"), "job_url": text("lever.hostedUrl"), "title": text("lever.text"), "location_texts": F.coalesce(places, _list_of(text("lever.categories.location"))),
        "department": text("lever.categories.department"), "team": text("lever.categories.team"), "employment_type": X.employment(text("lever.categories.commitment"), X.EMPLOYMENT_LEVER), "workplace_type": X.workplace(text("lever.workplaceType")),
        "description_text": text("lever.descriptionPlain"), "html": text("lever.description"), "posted_at": made, "source_first_published_at": made,
        "compensation_min": pay["min"], "compensation_max": pay["max"], "compensation_currency": pay["currency"], "compensation_period": pay["period"],
    }


def ashby() -> dict[str, Column]:
    at, bad = _strict("ashby.publishedAt")
    postal = lambda e: X.blank_to_null(X.join_non_empty(", ", *(e["address"]["postalAddress"][p] for p in ("addressLocality", "addressRegion", "addressCountry"))))
    places = F.concat(F.coalesce(_list_of(text("ashby.location")), F.expr("cast(array() as array<string>)")), _named("ashby.secondaryLocations", lambda e: F.coalesce(postal(e), X.blank_to_null(e["location"]))))
    return {
        "issue": F.when(text("ashby.id").isNull(), "missing id").when(text("ashby.jobUrl").isNull(), "missing url").when(bad, "malformed time"),
        "source_id": text("ashby.id"), "source_url": text("ashby.jobUrl"), "job_url": text("ashby.jobUrl"), "title": text("ashby.title"), "department": text("ashby.department"), "team": text("ashby.team"), "location_texts": F.when(F.size(places) > 0, places),
        "employment_type": X.employment(text("ashby.employmentType")), "workplace_type": X.workplace(text("ashby.workplaceType")), "html": text("ashby.descriptionHtml"), "posted_at": at, "source_first_published_at": at,
    }


def workday() -> dict[str, Column]:
    token = F.trim("board_token")
    host, path = F.substring_index(token, "/", 1), text("workday.externalPath")
    site = F.substring(token, F.length(host) + 2, F.length(token))
    url = F.coalesce(text("workday.externalUrl"), F.concat(F.lit("https://"), host, F.lit("/en-US/"), site, F.lit("/"), F.regexp_replace(path, "^/", "")))
    day, _ = X.posted_on(field("workday.postedOn"), F.to_date("fetched_at"))
    return {"issue": F.when(path.isNull(), "missing path"), "source_id": path, "source_url": url, "job_url": url, "title": text("workday.title"), "location_texts": _list_of(text("workday.locationsText")), "posted_at": day}


def workable() -> dict[str, Column]:
    url = F.coalesce(text("workable.url"), text("workable.application_url"))
    place = X.blank_to_null(X.join_non_empty(", ", *(text(f"workable.{p}") for p in ("city", "state", "country"))))
    return {
        "issue": F.when(text("workable.shortcode").isNull(), "missing shortcode").when(url.isNull(), "missing url"),
        "source_id": text("workable.shortcode"), "source_url": url, "job_url": url, "title": text("workable.title"), "department": text("workable.department"), "location_texts": _list_of(place), "employment_type": X.employment(text("workable.employment_type")),
        "posted_at": X.day(text("workable.published_on")), "source_first_published_at": X.day_or_instant(text("workable.created_at")),
    }


def gem() -> dict[str, Column]:
    (first, bad1), (changed, bad2) = _strict("gem.first_published_at"), _strict("gem.updated_at")
    offices = _named("gem.offices", lambda e: X.blank_to_null(e["location"]["name"]))
    return {
        "issue": F.when(text("gem.id").isNull(), "missing id").when(text("gem.absolute_url").isNull(), "missing url").when(bad1 | bad2, "malformed time"),
        "source_id": text("gem.id"), "source_url": text("gem.absolute_url"), "job_url": text("gem.absolute_url"), "title": text("gem.title"), "location_texts": F.when(F.size(offices) > 0, offices).otherwise(_list_of(text("gem.location.name"))),
        "department": text("gem.departments[0].name"), "description_text": text("gem.content_plain"), "html": text("gem.content"), "workplace_type": X.workplace(text("gem.location_type"), X.WORKPLACE_GEM),
        "employment_type": X.employment(text("gem.employment_type")), "posted_at": first, "source_first_published_at": first, "source_last_modified_at": changed,
    }


SOURCES = {"greenhouse": greenhouse, "lever": lever, "ashby": ashby, "workday": workday, "workable": workable, "gem": gem}


def _jobs(payloads: DataFrame, raw: bool = False, read: dict[str, str] = READ) -> tuple[DataFrame, dict[str, dict[str, Column]]]:
    """One row for each job with its issue, and what each source makes of it. A body that isn't an envelope is one row with an issue,
    and so is an empty page of a capture that isn't whole; all jobs of such a capture have that issue."""
    job = F.transform("_jobs", lambda j, i: F.struct(j.alias("job"), F.get("_raw", i).alias("raw_data")) if raw else F.struct(j.alias("job")))
    exploded = pages(payloads, raw, read).select(*KEYS, F.col("_jobs").isNull().alias("_bad"), (~F.coalesce("_whole", F.lit(True))).alias("_cut"), F.explode_outer(job).alias("_e")).where("_bad or _cut or _e is not null").select(*KEYS, "_bad", "_cut", "_e.*")
    made = {ats: source() for ats, source in SOURCES.items()}
    return exploded.withColumn("issue", F.when(F.col("_bad"), "malformed body").when(F.col("_cut"), "incomplete capture").otherwise(_by_source({k: v["issue"] for k, v in made.items()}))), made


def normalize(payloads: DataFrame, raw: bool = True) -> DataFrame:
    """Postings of all sources with their issues. location_text is the first of location_texts. Without ``raw`` raw_data is left out."""
    rows, made = _jobs(payloads, raw)
    shown = [c for c in schemas.POSTING_COLUMNS if raw or c != "raw_data"]
    kinds = dict(c.split() for c in schemas.POSTING.split(", "))
    column = lambda c: _by_source({k: v.get(c) for k, v in made.items()})
    own = [c for c in schemas.POSTING_COLUMNS if c not in ("raw_data", "description_text", "location_text")]
    out = rows.select(*KEYS, "issue", *(column(c).cast(kinds[c]).alias(c) for c in own), *(["raw_data"] if raw else []), column("description_text").alias("_plain"), F.when(column("description_text").isNull(), column("html")).alias("_html"))
    out = out.withColumn("location_text", F.get("location_texts", F.lit(0))).withColumn("description_text", F.coalesce("_plain", X.blank_to_null(html_to_text("_html"))))
    return out.select(*KEYS, "issue", *shown)


def token_readable(ats: Column, token: Column) -> Column:
    """Whether a source can be asked for the token at all: a bare name for some, host and site for one, anything for the rest."""
    token = F.trim(token)
    host = F.substring_index(token, "/", 1)
    site = ~token.contains("://") & ~token.startswith("/") & ~token.endswith("/") & token.contains("/") & (F.instr(host, ".") > 1)
    return F.coalesce(F.when(ats.isin("workable", "gem"), (token != "") & ~token.rlike("[/?#]")).when(ats == "workday", site).otherwise(F.lit(True)), F.lit(False))


def boards(payloads: DataFrame) -> DataFrame:
    """company_id, ats, board_token, fetched_at, postings, first_issue, warning: a board with any issue counts as failed, also one whose
    captured pages have a gap or no end. An empty board is sound. A board near the end of what its source gives at once, or of its pages, has a warning."""
    found = _jobs(payloads, read=JUDGED)[0].groupBy(*KEYS).agg(F.count_if(F.col("issue").isNull()).alias("postings"), F.min("issue").alias("first_issue"))
    seen = payloads.groupBy(*KEYS).agg(F.max("page_no").alias("pages"))
    out = seen.join(found, list(KEYS), "left").withColumn("postings", F.coalesce("postings", F.lit(0)))
    issue = F.when(~F.col("ats").isin(*SOURCES), "unsupported source").when(~token_readable(F.col("ats"), F.col("board_token")), "bad token").when(F.col("pages") >= MOST_PAGES, "too many pages").otherwise(F.col("first_issue"))
    warning = F.when(F.col("ats").isin(*PAGE) & (F.col("pages") >= WARN_PAGES), "many pages").when(F.col("ats").isin("workable", "gem") & (F.col("postings") >= WARN_JOBS), "many jobs")
    return out.select(*KEYS, "postings", issue.alias("first_issue"), warning.alias("warning"))


def accepted(payloads: DataFrame, raw: bool = True) -> DataFrame:
    """Postings of sound boards only. Boards are judged by their jobs' issues, without the rest of a posting. Who doesn't need
    raw_data says so (``raw``): a body's text then needn't be cut into its jobs'."""
    unsound = boards(payloads).where("first_issue is not null").select(*KEYS)
    return normalize(payloads, raw).where("issue is null").join(unsound, list(KEYS), "left_anti").drop("issue")


def read_sidecar(spark, path: str) -> DataFrame:
    """Research records, one JSON object a line; a bad line fails the read."""
    return spark.read.schema(schemas.SIDECAR).option("mode", "FAILFAST").json(path)
