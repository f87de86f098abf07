"""Schemas of the engine's tables and its closed vocabularies."""

from __future__ import annotations

# Closed vocabularies of the data model.
SENIORITIES = ("intern", "junior", "mid", "senior", "staff", "principal", "lead", "director", "unknown")
SOURCES = ("greenhouse", "lever", "ashby", "workday", "workable", "gem")
REGISTRY_REASONS = ("unsupported_ats", "no_careers")

POSTING = (
    "source_id string, source_url string, raw_data string, title string, location_text string, location_texts array<string>, "
    "department string, team string, employment_type string, workplace_type string, job_url string, description_text string, "
    "posted_at timestamp, source_first_published_at timestamp, source_last_modified_at timestamp, "
    "compensation_min long, compensation_max long, compensation_currency string, compensation_period string"
)
POSTING_COLUMNS = tuple(c.split()[0] for c in POSTING.split(", "))
#: What a capture step hands over: one row for each page of a board.
PAYLOAD = "company_id long, ats string, board_token string, page_no int, fetched_at timestamp, body string"
SIDECAR = (
    "rank int, name string, source struct<industry: string, location: string, year_founded: int, employees: int, employee_change_pct: double>, "
    "url string, careers_url string, ats string, board_token string, notes string, status string, verified_at timestamp, verified_run_id string"
)
#: Largest body that is read.
BODY_LIMIT = 32 * 1024 * 1024
