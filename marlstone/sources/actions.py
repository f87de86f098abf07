"""Write actions as frames: requests are judged first, then give rows to append; one with any failure writes nothing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone import schemas
from marlstone.functions import expr as X
from marlstone.operators.validation import rule_failures
from marlstone.sources import ledger

#: What a blank provenance stands for, and the form of one.
MODEL, PROMPT_VERSION, PROVENANCE = "mcp-agent", "mcp-save-enrichment-v1", "^[A-Za-z0-9._-]+$"
KINDS = ("roles", "specializations", "skills")


def _failures(requests: DataFrame, key: str, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """key, path, code of every rule that a request breaks."""
    hits = F.filter(F.array(*(F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(path).alias("path"), F.lit(code).alias("code"))) for path, code, broken in rules)), lambda x: x.isNotNull())
    return requests.select(key, F.explode(hits).alias("f")).select(key, "f.*")


def _trimmed(column: str) -> Column:
    return X.strip(F.coalesce(F.col(column), F.lit("")))


def add_company_failures(requests: DataFrame) -> DataFrame:
    """request_id, path, code of requests (request_id, name, ats, board_token, careers_page_url) to add a company."""
    name, ats, token, url = (_trimmed(c) for c in ("name", "ats", "board_token", "careers_page_url"))
    known = ats.isin(*schemas.SOURCES)
    return _failures(requests, "request_id", [
        ("name", "missing_required", name == ""), ("ats", "missing_required", ats == ""), ("ats", "unsupported_ats", (ats != "") & ~known), ("board_token", "missing_required", token == ""),
        ("board_token", "invalid_board_token", (token != "") & known & ~X.token_valid(ats, X.normalize_board_token(ats, token))), ("careers_page_url", "invalid_url", (url != "") & ~X.url_valid(url)),
    ])


def record_unsupported_failures(requests: DataFrame) -> DataFrame:
    """request_id, path, code of requests (request_id, name, url, reason) to record a company that can't be fetched."""
    name, url, reason = (_trimmed(c) for c in ("name", "url", "reason"))
    return _failures(requests, "request_id", [
        ("name", "missing_required", name == ""), ("reason", "missing_required", reason == ""), ("reason", "invalid_reason", (reason != "") & ~reason.isin(*schemas.REGISTRY_REASONS)),
        ("url", "missing_required", (reason == "unsupported_ats") & (url == "")), ("url", "invalid_url", (url != "") & ~X.url_valid(url)),
    ])


def record_unsupported(registry: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(registry after the sound requests, failures of the others): requests as above with detected_platform and at."""
    failures = record_unsupported_failures(requests)
    sound = requests.join(failures.select("request_id").distinct(), "request_id", "left_anti")
    return ledger.fold_registry(registry, sound.select(_trimmed("name").alias("name"), X.blank_to_null(_trimmed("url")).alias("url"), X.blank_to_null(_trimmed("detected_platform")).alias("detected_platform"), _trimmed("reason").alias("reason"), "at")), failures


@dataclass(frozen=True)
class Saved:
    """What saving classifications gives: rows to append and the new terms, or failures. All frames are lazy."""

    failures: DataFrame  # payload_id, path, code
    classifications: DataFrame  # payload_id, id, posting_id, model, prompt_version, seniority, notes, classified_at
    terms: DataFrame  # kind, slug, name: those that weren't known, the least name of each
    links: DataFrame  # classification_id, kind, slug
    dimensions: DataFrame  # slug, dimension: of new roles


def save_enrichments(payloads: DataFrame, postings: DataFrame, taxonomy: DataFrame, dimensions: DataFrame, classifications: DataFrame, at: Column, trim_notes: bool = True, judged: bool = False) -> Saved:
    """Classifications to append from ``payloads``: validation.PAYLOAD with posting_id, model and prompt_version.

    A payload with any failure (a broken rule, odd provenance, a posting that doesn't exist) writes nothing. Blank
    provenance takes its default. Blank notes become null; a save trims them, a batch's writeback keeps them as they are
    (``trim_notes``). Classifications are appended: ids go on after the greatest one, one for each payload, whatever the
    posting had. ``taxonomy``: (kind, slug) of known terms. A payload_id must be given once. ``judged``: the payloads were held
    against the rules already.
    """
    blank = lambda c, default: F.when(_trimmed(c) == "", default).otherwise(_trimmed(c))
    p = payloads.withColumn("model", blank("model", MODEL)).withColumn("prompt_version", blank("prompt_version", PROMPT_VERSION))
    odd = [("provenance.model", "invalid_provenance", ~F.col("model").rlike(PROVENANCE)), ("provenance.prompt_version", "invalid_provenance", ~F.col("prompt_version").rlike(PROVENANCE))]
    exists = postings.select(F.col("id").alias("posting_id"))
    lost = p.select("payload_id", "posting_id").join(exists, "posting_id", "left_anti").select("payload_id", F.lit("posting_id").alias("path"), F.lit("posting_not_found").alias("code"))
    broken = None if judged else rule_failures(p, taxonomy, dimensions)
    failures = _failures(p, "payload_id", odd).unionByName(lost)
    # what is sound keeps its place: a semi-join by posting, none by payload unless rules are still to be held
    sound = p.where(~F.coalesce(odd[0][2], F.lit(False)) & ~F.coalesce(odd[1][2], F.lit(False))).join(exists, "posting_id", "left_semi")
    if broken is not None:
        failures, sound = broken.unionByName(failures), sound.join(broken.select("payload_id").distinct(), "payload_id", "left_anti")
    notes = X.blank_to_null(_trimmed("notes"))
    notes = notes if trim_notes else F.when(notes.isNotNull(), F.col("notes"))
    slugs_of = lambda kind: F.array_distinct(F.transform(kind, lambda t: F.struct(F.lit(kind).alias("kind"), t.slug.alias("slug"))))
    slugs = F.flatten(F.array_compact(F.array(*(slugs_of(kind) for kind in KINDS))))
    # a payload's terms go with it when it is numbered, so that links take their id without a join
    wide = ledger.numbered(sound.select("payload_id", "posting_id", "model", "prompt_version", F.trim("seniority").alias("seniority"), notes.alias("notes"), at.alias("classified_at"), slugs.alias("_slugs")), ["payload_id"], ledger.greatest_id(classifications))
    rows = wide.drop("_slugs")
    links = wide.select(F.col("id").alias("classification_id"), F.explode("_slugs").alias("t")).select("classification_id", "t.kind", "t.slug")
    every = None
    for kind in KINDS:
        part = sound.select(F.explode(kind).alias("t")).select(F.lit(kind).alias("kind"), F.col("t.slug").alias("slug"), F.coalesce(X.blank_to_null(X.strip(F.col("t.name"))), F.col("t.slug")).alias("name"))
        every = part if every is None else every.unionByName(part)
    new = every.groupBy("kind", "slug").agg(F.min("name").alias("name")).join(taxonomy.select("kind", "slug"), ["kind", "slug"], "left_anti")
    roles = sound.select(F.explode("roles").alias("t")).select(F.col("t.slug").alias("slug"), F.explode("t.dimensions").alias("dimension")).distinct()
    own = roles.join(taxonomy.where("kind = 'roles'").select("slug"), "slug", "left_anti")
    return Saved(failures, rows, new, links, own)


def write_back(outcomes: DataFrame, payloads: DataFrame, provenance: tuple[str, str], postings: DataFrame, taxonomy: DataFrame, dimensions: DataFrame, classifications: DataFrame, at: Column) -> tuple[DataFrame, Saved]:
    """(outcomes with db_failed for the enriched whose save was refused, with what it was refused for; what is saved) of a wave:
    operators.attempts.outcomes and its payloads. ``provenance``: model and prompt version of the run. Notes are kept as they are."""
    saved = save_enrichments(payloads.withColumn("model", F.lit(provenance[0])).withColumn("prompt_version", F.lit(provenance[1])), postings, taxonomy, dimensions, classifications, at, trim_notes=False, judged=True)
    refused = saved.failures.groupBy("payload_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(": ", "path", "code"))), "; ").alias("_why"))  # bounded by a payload's terms
    # outcomes without a payload stay where they are: joined by a null they would all land in one task
    out = outcomes.where("payload_id is not null").join(refused, "payload_id", "left").unionByName(outcomes.where("payload_id is null").withColumn("_why", F.lit(None).cast("string")))
    lost = F.col("_why").isNotNull()
    return out.select("posting_id", F.when(lost, "db_failed").otherwise(F.col("outcome")).alias("outcome"), "attempts", F.coalesce("_why", "last_reason").alias("last_reason"), "summary", "payload_id"), saved


def fetch_transaction(payloads: DataFrame, runs: DataFrame, identities: DataFrame, greatest: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(run events, identities after, snapshot rows to append) of captured pages: one run for each board and capture.

    A board that fails, by its pages or by a posting that may not be written, keeps a failed run with its first issue and
    writes no posting. ``runs`` gives the greatest run id; a capture's runs are numbered by their keys. ``identities`` may be those
    alone that the captures touch; ``greatest`` (one row, m) then gives the greatest id of all.
    """
    from marlstone.sources import payloads as P

    return transaction_of(P.boards(payloads), P.accepted(payloads), runs, identities, greatest)


def transaction_of(judged: DataFrame, found: DataFrame, runs: DataFrame, identities: DataFrame, greatest: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same of judged boards and accepted postings, so that a writer may parse bodies once and read both again."""
    from marlstone.sources import payloads as P

    key = list(P.KEYS)
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    broken = found.where(blank("source_url") | blank("source_id") | blank("raw_data")).select(*key).distinct().withColumn("_broken", F.lit(True))
    judged = judged.join(broken, key, "left").withColumn("issue", F.coalesce("first_issue", F.when(F.col("_broken"), "posting without identity")))
    numbered = ledger.numbered(judged.select(*key, "postings", "issue"), key, ledger.greatest_id(runs), "run_id")
    begun = numbered.select("run_id", "company_id", F.lit(0).alias("seq"), F.col("fetched_at").alias("at"), F.lit("in_progress").alias("status"), F.lit(None).cast("string").alias("error_message"), F.lit(None).cast("int").alias("postings_count"))
    ended = numbered.select("run_id", "company_id", F.lit(1).alias("seq"), F.col("fetched_at").alias("at"), F.when(F.col("issue").isNull(), "success").otherwise("failed").alias("status"), F.col("issue").alias("error_message"), F.when(F.col("issue").isNull(), F.col("postings")).cast("int").alias("postings_count"))
    sound = numbered.where("issue is null").select(*key, "run_id")
    written = found.join(sound, key)
    after = ledger.upsert_identities(identities, written.select("company_id", "source_url", "source_id", "fetched_at"), greatest)
    rows = written.join(after.select("company_id", "source_url", F.col("id").alias("job_posting_id")), ["company_id", "source_url"]).withColumnRenamed("run_id", "fetch_run_id").drop("ats", "board_token")
    return begun.unionByName(ended), after, rows
